"""The queries of this subpackage. SQL is given where it can express an operator at all."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontamination, html_text, lexical_search, licences, near_duplicates, neighbours, packing, pii, quality, quality_rules, sharding, spelling, tokens
from .common import table


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_sharding": sharding.op1_sharding,
        "op2_decontamination": decontamination.op2_decontamination,
        "op3_pii": pii.op3_pii,
        "op4_licences": licences.op4_licences,
        "op5_neighbours": neighbours.op5_neighbours,
        "op6_packing": op6_packing,
        "op7_quality": quality.op7_quality,
        "op8_token_counts": op8_token_counts,
        "op9_near_duplicates": near_duplicates.op9_near_duplicates,
        "op10_html_text": html_text.op10_html_text,
        "op11_lexical_search": lexical_search.op11_lexical_search,
        "op12_spelling_variants": spelling.op12_spelling_variants,
        "op13_quality_rules": quality_rules.op13_quality_rules,
    }


def oracle_sql() -> dict[str, str]:
    return {"op11_lexical_search": lexical_search.OP11_SQL, "op13_quality_rules": quality_rules.OP13_SQL}
