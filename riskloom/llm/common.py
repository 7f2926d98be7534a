"""What the operators of this subpackage share: reading tables and cutting lineage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.functions.shared import cut as written
from riskloom.functions.shared import shared_dir

__all__ = ["fixed_sample", "free_name", "orderable", "shared_dir", "slots_for", "table", "text_rows", "written"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_rows(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text`` alone, null texts as empty ones; every other column stays behind."""
    return docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def slots_for(df: DataFrame, at_least: int = 1) -> int:
    """Shuffle partitions of the session, for ``repartition`` calls that need a number."""
    return max(at_least, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def fixed_sample(df: DataFrame, key: list[str], most: int) -> DataFrame:
    """At most ``most`` rows by a hash of ``key``, the same ones at any partitioning.

    Rows are thinned by the hash first, to about twice what is wanted over the whole table, so that
    what the tasks send on is bounded too, however many of them there are.
    """
    n = df.count()
    lot = F.pmod(F.xxhash64(*key), F.lit(1 << 40))
    share = min(1.0, (2 * most + 20) / max(1, n))
    return df.filter(lot < int(share * (1 << 40))).orderBy(lot, *key).limit(most)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def orderable(value: Column, kind: T.DataType) -> Column:
    """``value`` with every map in it as its sorted entries, so that it can be hashed and compared; variants as text."""
    if isinstance(kind, T.MapType):
        entries = F.transform(F.map_entries(value), lambda e: F.struct(orderable(e["key"], kind.keyType).alias("k"), orderable(e["value"], kind.valueType).alias("v")))
        return F.sort_array(entries)
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: orderable(x, kind.elementType))
    if isinstance(kind, T.StructType):
        fields = [orderable(value.getField(f.name), f.dataType).alias(f"f{i}") for i, f in enumerate(kind.fields)]
        return F.when(value.isNotNull(), F.struct(*fields)) if fields else value.isNotNull()
    return value.cast("string") if isinstance(kind, T.VariantType) else value
