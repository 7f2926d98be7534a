"""Running sums over a global order without a one-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from riskloom.functions.shared import cut


def global_cumulate(df: DataFrame, order: str, sums: dict[str, Column], descending: bool = False, by: tuple[str, ...] = ()) -> DataFrame:
    """One row for each ``(*by, order)`` with the sums of that value and, as ``cum_<name>``, all up to it.

    Ties move together. Values are range-partitioned; each partition runs its own sums, and the
    totals of the partitions before it, one row a partition and group, are added.
    """
    tied = df.groupBy(*by, order).agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    sort = F.desc(order) if descending else F.asc(order)
    # written, so that a row's partition number is a fact and not re-evaluated
    dealt = cut(tied.repartitionByRange(*[F.asc(b) for b in by], sort).withColumn("_p", F.spark_partition_id()), "ranged")
    totals = dealt.groupBy(*by, "_p").agg(*[F.sum(n).alias(f"_t_{n}") for n in sums])
    before = Window.partitionBy(*by, F.lit(0)).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*by, "_p", *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in sums])
    inside = Window.partitionBy(*by, "_p").orderBy(sort).rowsBetween(Window.unboundedPreceding, 0)
    run = dealt.select("*", *[F.sum(n).over(inside).alias(f"_r_{n}") for n in sums])
    out = run.join(offsets, [*by, "_p"])
    return out.select(*by, order, *sums, *[(F.col(f"_r_{n}") + F.col(f"_o_{n}")).alias(f"cum_{n}") for n in sums])


def global_rank(df: DataFrame, order: list[str], name: str = "position") -> DataFrame:
    """0-based positions in the total order of ``order``: ranges, then offsets, never one task."""
    dealt = cut(df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()), "ranked")
    counts = dealt.groupBy("_p").count()
    before = Window.partitionBy(F.lit(0)).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_p", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_o"))
    inside = Window.partitionBy("_p").orderBy(*order)
    return dealt.withColumn("_r", F.row_number().over(inside) - 1).join(offsets, "_p").withColumn(name, F.col("_r") + F.col("_o")).drop("_p", "_r", "_o")
