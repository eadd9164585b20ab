"""Helpers on columns that belong to no subject."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value worked out once a row, however often use names it; an expression would be evaluated anew at each, and in a lambda for each element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))
