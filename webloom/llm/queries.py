"""The queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import twins
from .op01_token_store import op1_token_store
from .op02_style_tree import op2_style_tree_text
from .op03_media import op3_webp_media
from .op04_toxicity import op4_weak_toxicity
from .op05_bpe import op5_bpe_roundtrip
from .op06_ann import op6_learned_partition_ann
from .op07_ngram_join import op7_ngram_jaccard_join
from .op08_quality import op8_nbsvm_quality
from .op09_pii import op9_bootstrapped_pii
from .op10_packing import op10_best_fit_packing
from .op11_schema import op11_nested_schema
from .op12_spelling import op12_spelling_variants
from .op13_secrets import op13_trigram_secrets


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_token_store, op2_style_tree_text, op3_webp_media, op4_weak_toxicity, op5_bpe_roundtrip, op6_learned_partition_ann, op7_ngram_jaccard_join, op8_nbsvm_quality, op9_bootstrapped_pii, op10_best_fit_packing, op11_nested_schema, op12_spelling_variants, op13_trigram_secrets)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return twins.oracle_sql()
