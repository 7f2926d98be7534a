"""Encoders fitted on the training split alone, their digest, and their application."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MISSING = "__missing__"


def _long(df: DataFrame, columns: list[str]) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.coalesce(F.col(c).cast("string"), F.lit(MISSING)).alias("category")) for c in columns])
    return df.select(F.explode(pairs).alias("p")).select("p.*")


def fit_frequencies(train: DataFrame, columns: list[str]) -> DataFrame:
    """``column, category, freq``; missing is a category, frequencies of a column add up to one."""
    rows = train.count()
    return _long(train, columns).groupBy("column", "category").agg((F.count("*") / F.lit(rows)).alias("freq"))


def apply_frequencies(df: DataFrame, encoders: DataFrame, columns: list[str]) -> DataFrame:
    """Unseen categories get 0. Encoder tables may be as large as a column's levels, so Spark picks the join."""
    for c in columns:
        own = encoders.filter(F.col("column") == c).select(F.col("category").alias("_k"), F.col("freq").alias("_f"))
        df = df.join(own, F.coalesce(F.col(c).cast("string"), F.lit(MISSING)) == F.col("_k"), "left").withColumn(f"{c}_freq", F.coalesce("_f", F.lit(0.0))).drop("_k", "_f")
    return df


def digest(encoders: DataFrame, definition: str = "") -> DataFrame:
    """Twelve hex digits over a column's sorted entries and the definition that made them."""
    entry = F.concat_ws("=", "category", F.format_string("%.6f", F.round("freq", 6)))
    text = F.concat(F.lit(definition), F.array_join(F.sort_array(F.collect_list(entry)), ","))
    return encoders.groupBy("column").agg(F.substring(F.sha2(text, 256), 1, 12).alias("digest"), F.count("*").alias("entries"))


def scaler(df: DataFrame, columns: list[str]) -> DataFrame:
    """Mean and population deviation of each column, nulls skipped, a deviation of 0 taken as 1."""
    parts = [F.struct(F.lit(c).alias("column"), F.avg(c).alias("mean"), F.when(F.stddev_pop(c) == 0, 1.0).otherwise(F.stddev_pop(c)).alias("std")) for c in columns]
    return df.agg(F.array(*parts).alias("a")).select(F.explode("a").alias("p")).select("p.*")


def scaled(df: DataFrame, fitted: dict[str, tuple[float, float]], clip: float = 5.0) -> DataFrame:
    """Standardised and clipped; null becomes 0, the mean."""
    for c, (mean, std) in fitted.items():
        df = df.withColumn(c, F.coalesce(F.greatest(F.least((F.col(c) - mean) / std, F.lit(clip)), F.lit(-clip)), F.lit(0.0)))
    return df


def level_codes(df: DataFrame, column: str, levels: list[str]) -> DataFrame:
    """Position in a fixed level list; unseen and missing are -1."""
    return df.withColumn(f"{column}_code", F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(v) for v in levels]), F.col(column)), F.lit(0)) - 1, F.lit(-1)).cast("int"))
