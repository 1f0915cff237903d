"""Queries of this subpackage, as ``__spark_entry__`` registers them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import licenses, sharding, suffix_dedup, topk
from .ann import op2_ann
from .bpe import op7_bpe
from .langid import op8_language_id
from .licenses import op5_licenses
from .packing import op9_packing
from .sharding import op4_sharding
from .simhash import op10_simhash
from .suffix_dedup import op3_suffix_dedup
from .topk import op6_topk
from .toxicity import op1_toxicity

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "op1_toxicity": op1_toxicity,
        "op2_ann": op2_ann,
        "op3_suffix_dedup": op3_suffix_dedup,
        "op4_sharding": op4_sharding,
        "op5_licenses": op5_licenses,
        "op6_topk": op6_topk,
        "op7_bpe": op7_bpe,
        "op8_language_id": op8_language_id,
        "op9_packing": op9_packing,
        "op10_simhash": op10_simhash,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_suffix_dedup": suffix_dedup.ORACLE_SQL, "op4_sharding": sharding.oracle_sql(), "op5_licenses": licenses.oracle_sql(), "op6_topk": topk.ORACLE_SQL}
