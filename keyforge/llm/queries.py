"""Queries of the corpus operators, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, jaccard_join, mixing, substring_dedup, suffix_dedup, warc
from .decontaminate import op7_decontaminate
from .embedding_dedup import op8_embedding_dedup
from .jaccard_join import op2_jaccard_join
from .mixing import op4_mixing
from .quality import op1_quality
from .secrets import op6_secrets
from .substring_dedup import op9_substring_dedup
from .suffix_dedup import op3_suffix_dedup
from .toxicity import op5_toxicity
from .warc import op10_warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_quality,
        op2_jaccard_join,
        op3_suffix_dedup,
        op4_mixing,
        op5_toxicity,
        op6_secrets,
        op7_decontaminate,
        op8_embedding_dedup,
        op9_substring_dedup,
        op10_warc,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {
        "op2_jaccard_join": jaccard_join.SQL,
        "op3_suffix_dedup": suffix_dedup.SQL,
        "op4_mixing": mixing.SQL,
        "op7_decontaminate": decontaminate.SQL,
        "op9_substring_dedup": substring_dedup.SQL,
        "op10_warc": warc.SQL,
    }
