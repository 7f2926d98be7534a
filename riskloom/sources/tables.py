"""Typed sources: canonical transactions and the tables that play the other parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

CANONICAL_SCHEMA = T.StructType([
    T.StructField("source_dataset", T.StringType(), False),
    T.StructField("transaction_id", T.StringType(), False),
    T.StructField("event_time", T.TimestampType(), False),
    T.StructField("amount", T.DoubleType(), False),
    T.StructField("account_id", T.StringType(), False),
    T.StructField("counterparty_id", T.StringType()),
    T.StructField("transaction_type", T.StringType()),
    T.StructField("is_fraud", T.BooleanType(), False),
    T.StructField("device", T.StringType()),
    T.StructField("us", T.LongType(), False),
])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_csv(spark: SparkSession, path: str, schema: T.StructType, columns: list[str] | None = None) -> DataFrame:
    """A typed file scan that fails on a malformed row; only ``columns`` are parsed."""
    df = spark.read.schema(schema).csv(path, header=True, mode="FAILFAST")
    return df.select(*columns) if columns else df


def normalised(df: DataFrame) -> DataFrame:
    """Headers stripped, hyphens as underscores."""
    return df.toDF(*[c.strip().replace("-", "_") for c in df.columns])


def wide_block(df: DataFrame, key: str, prefix: str = "V") -> DataFrame:
    """The key and the numbered columns of a wide block, to be stored apart."""
    return df.select(key, *[c for c in df.columns if c.startswith(prefix) and c[len(prefix) :].isdigit()])


def with_source_rows(df: DataFrame, column: str = "source_row") -> DataFrame:
    """The position of each row in a scan: the rows of the partitions before its own, and its place there."""
    # the id holds the partition in its upper bits and the place in the lower 33
    named = df.withColumn("_row_id", F.monotonically_increasing_id())
    part = F.shiftright("_row_id", 33)
    sizes = named.groupBy(part.alias("_part")).count()  # a row a partition
    offset = sizes.select("_part", (F.sum("count").over(Window.orderBy("_part")) - F.col("count")).alias("_offset"))
    place = F.col("_row_id").bitwiseAND(F.lit((1 << 33) - 1))
    return named.withColumn("_part", part).join(offset, "_part").withColumn(column, F.col("_offset") + place).select(*df.columns, column)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fine-clock corpus: one row per event, label ``error``."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.lit("events").alias("source_dataset"),
        F.col("event_id").alias("transaction_id"),
        F.col("ts").alias("event_time"),
        F.col("value").alias("amount"),
        F.col("user_id").alias("account_id"),
        F.lit(None).cast("string").alias("counterparty_id"),
        F.col("event_type").alias("transaction_type"),
        (F.col("event_type") == "error").alias("is_fraud"),
        F.get_json_object("props", "$.k").alias("device"),
        F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts)").alias("us"),
    )


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The coarse-clock corpus, with many ties: one row per order, label status F."""
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.lit("orders").alias("source_dataset"),
        F.col("o_orderkey").alias("transaction_id"),
        F.col("o_orderdate").alias("event_time"),
        F.col("o_totalprice").alias("amount"),
        F.col("o_custkey").alias("account_id"),
        F.col("o_orderpriority").alias("transaction_type"),
        (F.col("o_orderstatus") == "F").alias("is_fraud"),
        F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', o_orderdate)").alias("us"),
    )


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score, label and amount triples: the score is a fixed formula in whole thousandths, with many ties."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_orderkey").alias("id"),
        F.col("l_linenumber").alias("line"),
        ((50 * F.round(F.col("l_discount") * 100).cast("long") + 37 * F.round(F.col("l_tax") * 100).cast("long") + 4 * F.col("l_quantity").cast("long")) / 1000.0).alias("score"),
        (F.col("l_quantity").cast("long") / 50.0).alias("other"),
        (F.col("l_returnflag") == "R").alias("label"),
        F.col("l_extendedprice").alias("amount"),
        F.col("l_shipdate").alias("at"),
        F.col("l_linestatus").alias("band"),
    )


def numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``scored`` with ``row``, its position in the order of all columns: order and line number name no row, many repeat."""
    from riskloom.operators.ordering import global_rank

    return global_rank(scored(spark, sf_dir), ["id", "line", "score", "other", "label", "amount", "band"], "row")
