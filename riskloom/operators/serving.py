"""Reads behind the API: pages, scopes, decision mixes, context, parsed payments, registries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .history import with_amount_z, with_usual_rate

PAYMENT_SCHEMA = "event string, payment struct<id: bigint, amount: bigint, notes: map<string, string>, created_at: bigint>"


def scoped(df: DataFrame, account: int | str | None, everything: bool = False) -> DataFrame:
    """One account, all of them, or nothing: without a scope the read is empty."""
    if everything:
        return df
    return df.filter(F.lit(False)) if account is None else df.filter(F.col("account_id") == account)


def latest_page(df: DataFrame, limit: int, offset: int = 0, most: int = 200) -> DataFrame:
    return df.orderBy(F.desc("us"), "transaction_id").offset(offset).limit(min(limit, most))


def decision_mix(df: DataFrame, last: int = 100) -> DataFrame:
    """Shares among an account's latest decisions."""
    w = Window.partitionBy("account_id").orderBy(F.desc("us"), F.desc("transaction_id"))
    recent = df.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= last)
    share = lambda d: F.avg((F.col("decision") == d).cast("int")).alias(f"{d}_share")
    return recent.groupBy("account_id").agg(F.count("*").alias("decisions"), share("block"), share("review"))


def risk_context(df: DataFrame, limit: float = 2.0) -> DataFrame:
    """Is the amount, or the rate, far from the account's own history? No history is not unusual."""
    z = with_usual_rate(with_amount_z(df))
    far = lambda c: F.coalesce(F.abs(F.col(c)) > limit, F.lit(False))
    out = z.withColumns({"amount_unusual": far("amount_z"), "rate_unusual": far("rate_z")})
    return out.withColumn("rationale", F.when(F.col("amount_unusual") & F.col("rate_unusual"), "unusual amount and rate").when(F.col("amount_unusual"), "unusual amount").when(F.col("rate_unusual"), "unusual rate").otherwise("in line with history"))


def account_sample(df: DataFrame, accounts: int, least: int, most: int, seed: int) -> DataFrame:
    """All rows of a fixed sample of accounts with a moderate history; a sampling operator by design."""
    fit = df.groupBy("account_id").count().filter(F.col("count").between(least, most))
    key = F.md5(F.concat_ws("|", F.col("account_id").cast("string"), F.lit(str(seed))))
    return df.join(fit.orderBy(key, "account_id").limit(accounts), "account_id", "left_semi")


def scoring_subset(df: DataFrame, rows: int, seed: int = 42) -> DataFrame:
    """Rows with history first, then first rows, each in hashed order."""
    nth = F.row_number().over(Window.partitionBy("account_id").orderBy("us", "transaction_id"))
    key = F.md5(F.concat_ws("|", F.col("transaction_id").cast("string"), F.lit(str(seed))))
    return df.withColumn("_first", (nth == 1).cast("int")).orderBy("_first", key).limit(rows).drop("_first")


def parsed_payments(envelopes: DataFrame, least_amount: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """Payment envelopes as scoring inputs, and the ones that cannot be: batch and stream alike."""
    p = envelopes.select("value", F.from_json("value", PAYMENT_SCHEMA).alias("j"))
    p = p.select("value", F.col("j.payment.id").alias("transaction_id"), (F.col("j.payment.amount") / 100).cast("decimal(20,4)").alias("amount"), F.timestamp_seconds("j.payment.created_at").alias("event_time"), F.col("j.payment.notes")["account_id"].cast("long").alias("account_id"))
    fine = F.coalesce(F.col("transaction_id").isNotNull() & F.col("account_id").isNotNull() & (F.col("amount") >= least_amount), F.lit(False))
    return p.filter(fine).drop("value"), p.filter(~fine).select("value")


def allowed_inputs(df: DataFrame, raw: str, allowed: list[str]) -> tuple[DataFrame, DataFrame]:
    """A caller may give raw columns, never derived ones."""
    foreign = F.array_except(F.map_keys(raw), F.array(*[F.lit(a) for a in allowed]))
    return df.filter(F.size(foreign) == 0), df.filter(F.size(foreign) > 0).withColumn("foreign", foreign)


def raw_columns(df: DataFrame, allowed: list[str]) -> Column:
    """Map of a row's allowed columns that are not null."""
    pairs = [x for c in allowed for x in (F.lit(c), F.col(c).cast("string"))]
    return F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull())


def appended(registry: DataFrame, entries: DataFrame) -> DataFrame:
    """Entries whose model id the registry does not hold yet."""
    return registry.unionByName(entries.join(registry, "model_id", "left_anti").select(registry.columns))


def latest_entries(registry: DataFrame) -> DataFrame:
    """The last appended entry of each layer, by sequence and not by clock."""
    return registry.groupBy("layer").agg(F.max_by("model_id", "seq").alias("model_id"))


def fused(df: DataFrame, layers: dict[str, str]) -> DataFrame:
    """Absent layers as -1 for ranking only, with the reasons of the degradation."""
    reasons = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(f"{name}_absent")) for name, c in layers.items()]))
    out = df.withColumn("degraded_reasons", reasons).withColumn("degraded", F.size("degraded_reasons") > 0)
    return out.withColumns({f"{c}_filled": F.coalesce(F.col(c), F.lit(-1.0)) for c in layers.values()})


def stripped(df: DataFrame, struct: str, secret: list[str]) -> DataFrame:
    """A struct without its thresholds and unit costs, for export."""
    return df.withColumn(struct, F.col(struct).dropFields(*secret))


def newest(df: DataFrame, key: str, ties: list[str], most: int) -> DataFrame:
    """The newest rows of each key, numbered."""
    w = Window.partitionBy(key).orderBy(F.desc("us"), *ties)
    return df.withColumn("nth", F.row_number().over(w)).filter(F.col("nth") <= most)
