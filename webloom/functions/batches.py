"""Batches of pages in small pieces, so that a worker's memory goes by a piece and not by a whole Arrow batch."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd

#: Pages whose parsed rows a worker holds at once.
PIECE = 256


def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for at in range(0, len(batch), PIECE):
            yield batch.iloc[at : at + PIECE].reset_index(drop=True)
