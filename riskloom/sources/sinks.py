"""Tables at rest: splits, encoders with their digest, ring tables, registries, exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.operators.encoders import digest

RING_TABLES = ("ring_scores", "rings", "ring_edges", "seen_accounts")


def write_splits(df: DataFrame, path: str) -> None:
    """One folder a source and split; a read of one split opens no other folder."""
    df.write.mode("overwrite").partitionBy("source_dataset", "split").parquet(path)


def replace_source(df: DataFrame, path: str) -> None:
    """The sources and splits in ``df`` are replaced as wholes, all others stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source_dataset", "split").parquet(path)


def read_splits(spark: SparkSession, path: str, source: str, splits: tuple[str, ...] = ("train", "val", "test")) -> DataFrame:
    """Splits of one source, refused if two of them overlap in time."""
    df = spark.read.parquet(path).filter((F.col("source_dataset") == source) & F.col("split").isin(*splits))
    spans = {r[0]: (r[1], r[2]) for r in df.groupBy("split").agg(F.min("us"), F.max("us")).collect()}  # three rows
    held = [spans[s] for s in ("train", "val", "test") if s in spans]
    if any(a[1] >= b[0] for a, b in zip(held, held[1:], strict=False)):
        raise ValueError(f"splits of {source} overlap in time")
    return df


def save_encoders(encoders: DataFrame, path: str, version: str) -> None:
    encoders.join(digest(encoders, version).select("column", "digest"), "column").withColumn("feature_version", F.lit(version)).write.mode("overwrite").parquet(path)


def load_encoders(spark: SparkSession, path: str, version: str) -> DataFrame:
    """Refused when the version differs or the stored digest is not that of the stored rows."""
    stored = spark.read.parquet(path)
    if stored.filter(F.col("feature_version") != version).limit(1).count():
        raise ValueError("encoders of another feature version")
    now = digest(stored.select("column", "category", "freq"), version).withColumnRenamed("digest", "now")
    if stored.select("column", "digest").distinct().join(now, "column", "left").filter(~F.col("digest").eqNullSafe(F.col("now"))).limit(1).count():
        raise ValueError("encoder digest does not match")
    return stored.select("column", "category", "freq")


def verified_encoders(rebuilt: DataFrame, stored: DataFrame, within: float = 1e-9) -> DataFrame:
    """Greatest difference of each column, with the verdict; an entry one side lacks counts as 1."""
    both = rebuilt.join(stored.withColumnRenamed("freq", "other"), ["column", "category"], "full")
    gap = F.coalesce(F.abs(F.col("freq") - F.col("other")), F.lit(1.0))
    return both.groupBy("column").agg(F.max(gap).alias("greatest_gap")).withColumn("same", F.col("greatest_gap") <= within)


def save_rings(path: str, **tables: DataFrame) -> None:
    for name in RING_TABLES:
        if name in tables:
            tables[name].write.mode("overwrite").partitionBy("snapshot_end").parquet(f"{path}/{name}")


def load_rings(spark: SparkSession, path: str, end: int | None = None) -> dict[str, DataFrame]:
    """The tables of one snapshot, or of all."""
    found = {n: spark.read.parquet(f"{path}/{n}") for n in RING_TABLES}
    return {n: t if end is None else t.filter(F.col("snapshot_end") == end) for n, t in found.items()}


def append_audit(decisions: DataFrame, path: str, batch: int) -> None:
    """A batch's rows under its own number: written again they replace themselves."""
    decisions.write.mode("overwrite").parquet(f"{path}/batch={batch}")


def report(sections: dict[str, DataFrame], key: str) -> DataFrame:
    """Metric tables in long form: section, key, metric, value."""
    out = None
    for name, df in sections.items():
        metrics = [c for c, t in df.dtypes if c != key and t in ("bigint", "int", "double", "float")]
        pairs = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in metrics])
        long = df.select(F.lit(name).alias("section"), F.col(key).cast("string").alias("key"), F.explode(pairs).alias("m")).select("section", "key", "m.*")
        out = long if out is None else out.unionByName(long)
    return out
