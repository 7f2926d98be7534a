"""Chronological splits, forward-chaining blocks and slices, cut where whole timestamps end."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .ordering import global_cumulate, global_rank

SPLITS = ("train", "val", "test")


def cuts(df: DataFrame, shares: list[float], time: str = "us") -> list[int]:
    """For each share f: the first timestamp whose running count exceeds ``min(floor(n f), n - 1)``."""
    running = global_cumulate(df, time, {"n": F.lit(1)})
    total = running.agg(F.sum("n")).first()[0] or 0
    wanted = [min(int(total * f), total - 1) for f in shares]
    row = running.agg(*[F.min(F.when(F.col("cum_n") > k, F.col(time))).alias(f"c{i}") for i, k in enumerate(wanted)]).first()
    return list(row)


def assign_splits(df: DataFrame, shares: tuple[float, float] = (0.7, 0.85), time: str = "us") -> DataFrame:
    """Ties go to the later side; an empty split is refused."""
    if df.filter(F.col(time).isNull()).limit(1).count():
        raise ValueError("rows without a time cannot be split")
    first, second = cuts(df, list(shares), time)
    out = df.withColumn("split", F.when(F.col(time) < first, "train").when(F.col(time) < second, "val").otherwise("test"))
    found = {r[0] for r in out.select("split").distinct().collect()}
    if found != set(SPLITS):
        raise ValueError(f"empty split: {sorted(set(SPLITS) - found)}")
    return out


def time_blocks(df: DataFrame, k: int, time: str = "us") -> DataFrame:
    """Block 0 to k-1 of near-equal counts; no timestamp lies in two."""
    edges = cuts(df, [i / k for i in range(1, k)], time)
    if len(set(edges)) < k - 1 or edges[0] == df.agg(F.min(time)).first()[0]:
        raise ValueError("an empty block")
    return df.withColumn("block", sum((F.col(time) >= e).cast("int") for e in edges))


def validation_slices(df: DataFrame, order: list[str], shares: tuple[float, float] = (0.4, 0.75)) -> DataFrame:
    """Early, middle and late by row position."""
    n = df.count()
    placed = global_rank(df, order)
    a, b = (int(n * s) for s in shares)
    return placed.withColumn("slice", F.when(F.col("position") < a, "early").when(F.col("position") < b, "middle").otherwise("late"))


def split_summary(df: DataFrame, by: str = "split", time: str = "us") -> DataFrame:
    return df.groupBy(by).agg(F.count("*").alias("n_rows"), F.min(time).alias("first_us"), F.max(time).alias("last_us"), F.count_if("is_fraud").alias("positives"), F.avg(F.col("is_fraud").cast("int")).alias("base_rate"))


def boundary_overlaps(summary: DataFrame, by: str = "split") -> DataFrame:
    """Consecutive splits that overlap in time; empty when the split is sound."""
    nxt = Window.partitionBy(F.lit(0)).orderBy("first_us")  # one row a split
    return summary.withColumn("next_first_us", F.lead("first_us").over(nxt)).filter("last_us >= next_first_us").select(by, "last_us", "next_first_us")


def class_drift(summary: DataFrame, factor: float = 1.5) -> DataFrame:
    """Splits whose positive rate is off the overall one by more than ``factor`` either way."""
    everything = Window.partitionBy(F.lit(0))
    overall = F.sum("positives").over(everything) / F.sum("n_rows").over(everything)
    return summary.withColumn("overall_rate", overall).withColumn("drifts", (F.col("base_rate") > factor * F.col("overall_rate")) | (F.col("base_rate") * factor < F.col("overall_rate")))


def fold_check(blocked: DataFrame, time: str = "us") -> DataFrame:
    """For each fold k: does everything before it end before it begins?"""
    b = blocked.groupBy("block").agg(F.min(time).alias("begins"), F.max(time).alias("ends"))
    before = Window.partitionBy(F.lit(0)).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return b.withColumn("train_ends", F.max("ends").over(before)).filter("block > 0").select("block", "train_ends", "begins", (F.col("train_ends") < F.col("begins")).alias("sound"))


def heads(df: DataFrame, n: int, by: str = "split", time: str = "us", id_: str = "transaction_id") -> DataFrame:
    """The earliest ``n`` rows of each split. A rank limit alone, so each task sends at most ``n`` of a split."""
    w = Window.partitionBy(by).orderBy(time, id_)
    return df.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n).drop("_n")


def with_positives(sliced: DataFrame, by: str = "slice", label: str = "is_fraud", wanted: tuple[str, ...] = ("early", "middle", "late")) -> DataFrame:
    """Refused where one of the slices holds no positive row: nothing could be chosen or measured there."""
    held = {r[0] for r in sliced.filter(label).select(by).distinct().collect()}  # a row a slice
    if set(wanted) - held:
        raise ValueError(f"no positive in {sorted(set(wanted) - held)}")
    return sliced
