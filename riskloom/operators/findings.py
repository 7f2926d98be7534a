"""Findings of profile checks and their roll-up, normalisers, guards and small projections."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FINDING = ("level", "check", "detail", "n_rows")


def span_finding(df: DataFrame, first_us: int, last_us: int, tolerance_us: int = 86_400_000_000) -> DataFrame:
    """A finding for each end of the time span that is off the expected one by more than the tolerance."""
    ends = df.agg(F.min("us").alias("lo"), F.max("us").alias("hi"), F.count("*").alias("n"))
    one = lambda name, c, wanted: F.when(F.abs(F.col(c) - wanted) > tolerance_us, F.struct(F.lit("warning").alias("level"), F.lit(name).alias("check"), F.col(c).cast("string").alias("detail"), F.col("n").alias("n_rows")))
    return ends.select(F.explode(F.array_compact(F.array(one("span_start", "lo", first_us), one("span_end", "hi", last_us)))).alias("f")).select("f.*")


def level_findings(df: DataFrame, column: str, known: list[str]) -> DataFrame:
    """One warning for each level that the spec does not know."""
    seen = df.groupBy(F.col(column).cast("string").alias("detail")).agg(F.count("*").alias("n_rows"))
    return seen.filter(~F.coalesce(F.col("detail").isin(known), F.lit(False))).select(F.lit("warning").alias("level"), F.lit("unknown_level").alias("check"), "detail", "n_rows")


def rule_finding(df: DataFrame, name: str, broken: Column, level: str = "error") -> DataFrame:
    """A finding with the number of rows that break a rule; none where no row does."""
    return df.agg(F.count_if(broken).alias("n_rows")).filter("n_rows > 0").select(F.lit(level).alias("level"), F.lit(name).alias("check"), F.lit(None).cast("string").alias("detail"), "n_rows")


def join_drift(rate: DataFrame, expected: float, within: float = 0.01) -> DataFrame:
    """A warning where a join rate is more than a percentage point off the expected one."""
    return rate.filter(F.abs(F.col("join_rate") - expected) > within).select(F.lit("warning").alias("level"), F.lit("join_rate").alias("check"), F.format_string("%.4f", "join_rate").alias("detail"), F.col("parents").alias("n_rows"))


def rolled_up(parts: list[DataFrame], strict: bool = False) -> DataFrame:
    """Counts of findings and the verdict: errors fail always, warnings in strict mode."""
    both = reduce(DataFrame.unionByName, [p.select(*FINDING) for p in parts])
    n = both.agg(F.count_if(F.col("level") == "error").alias("errors"), F.count_if(F.col("level") == "warning").alias("warnings"))
    return n.withColumn("ok", (F.col("errors") == 0) & ((F.col("warnings") == 0) | F.lit(not strict)))


def adapter_notes(df: DataFrame, matched: Column, strategy: str, account: str) -> DataFrame:
    """Join rate, distinct accounts and rows of each account strategy, in long form."""
    whole = df.agg(F.avg(matched.cast("int")).alias("join_rate"), F.count_distinct(account).cast("double").alias("accounts"))
    long = whole.select(F.explode(F.array(*[F.struct(F.lit(c).alias("note"), F.col(c).alias("value")) for c in ("join_rate", "accounts")])).alias("x")).select("x.*")
    return long.unionByName(df.groupBy(F.concat(F.lit("strategy_"), strategy).alias("note")).agg(F.count("*").cast("double").alias("value")))


def ordered_history(splits: list[DataFrame]) -> DataFrame:
    """Splits as one history: rows keep their split, and are ordered by time within it when written or windowed."""
    return reduce(DataFrame.unionByName, splits).repartitionByRange("us", "transaction_id").sortWithinPartitions("us", "transaction_id")


def balance_features(df: DataFrame) -> DataFrame:
    """What the balances say beside the amount: errors of both sides, a drained origin, a merchant end."""
    drained = (F.col("old_origin") > 0) & (F.col("new_origin") == 0)
    return df.withColumns({
        "origin_error": F.col("new_origin") + F.col("amount") - F.col("old_origin"),
        "target_error": F.col("old_target") + F.col("amount") - F.col("new_target"),
        "origin_drained": F.coalesce(drained, F.lit(False)),
        "to_merchant": F.coalesce(F.col("counterparty_id").startswith("M"), F.lit(False)),
    })


def any_known(columns: list[str]) -> Column:
    """Is any of the columns not null?"""
    return F.coalesce(*[F.col(c).cast("string") for c in columns]).isNotNull()


def normalised_score(score: Column, low: float | None = None, high: float | None = None) -> Column:
    """Min-max of fitted bounds, or the score itself, clipped to 0..1; equal bounds give 0."""
    if low is None or high is None:
        return F.greatest(F.least(score, F.lit(1.0)), F.lit(0.0))
    return F.when(F.lit(high > low), F.greatest(F.least((score - low) / (high - low or 1.0), F.lit(1.0)), F.lit(0.0))).otherwise(0.0)


def amount_reference(train: DataFrame, df: DataFrame) -> DataFrame:
    """The score that knows the amount alone: its log between the training rows' extremes."""
    low, high = train.agg(F.min(F.log1p("amount")), F.max(F.log1p("amount"))).first()
    return df.withColumn("reference", normalised_score(F.log1p("amount"), low, high))


def same_corpus(df: DataFrame, source: str, version: str) -> DataFrame:
    """Refused if a row is of another corpus or feature version than the model's."""
    if not df.filter(~(F.col("source_dataset").eqNullSafe(source) & F.col("feature_version").eqNullSafe(version))).isEmpty():
        raise ValueError(f"rows that are not of {source} at {version}")
    return df


def known_accounts(events: DataFrame, accounts: DataFrame) -> DataFrame:
    """Is the account known, and what is its baseline? Works for a stream against a table as well."""
    return events.join(accounts.withColumn("known", F.lit(True)), "account_id", "left").withColumn("known", F.coalesce("known", F.lit(False)))


def with_ring(events: DataFrame, table: DataFrame, snapshots: DataFrame) -> DataFrame:
    """The ring score of each event's account at the snapshot that serves it.

    Without that snapshot the row is degraded and goes on; an account without a ring there is not.
    """
    there = snapshots.select("snapshot_end").distinct().withColumn("_s", F.lit(True))
    out = events.join(table.select("snapshot_end", F.col("node").alias("account_id"), F.col("score").alias("ring_score")), ["snapshot_end", "account_id"], "left").join(there, "snapshot_end", "left")
    return out.withColumn("degraded", F.col("_s").isNull()).withColumn("degraded_reason", F.when(F.col("_s").isNull(), "ring_snapshot_missing")).drop("_s")


def restricted(rows: DataFrame, population: DataFrame) -> DataFrame:
    """Rows of the population's snapshots, rings and accounts alone."""
    key = ["snapshot_end", "ring", "node"]
    return rows.join(population.select(*key).distinct(), key, "left_semi")


def explanation(decisions: DataFrame, decision_id: Column, k: int = 3, key: tuple[str, ...] = ("id", "line")) -> DataFrame:
    """The strongest contributions of the decisions that ``decision_id`` picks, a row each; ``key`` names a decision."""
    ordered = F.slice(F.array_sort("top_features", lambda a, b: F.when(F.abs(a["value"]) > F.abs(b["value"]), -1).when(F.abs(a["value"]) < F.abs(b["value"]), 1).when(a["name"] < b["name"], -1).otherwise(1)), 1, k)
    return decisions.filter(decision_id).select(*key, F.posexplode(ordered).alias("nth", "f")).select(*key, (F.col("nth") + 1).alias("nth"), "f.name", "f.value")


def topology(edges: DataFrame, members: DataFrame, token) -> DataFrame:
    """The edges inside rings, entity names replaced by ``token(column)``."""
    of = lambda end: members.select("snapshot_end", F.col("node").alias(end), F.col("ring").alias(f"_{end}"))
    inside = edges.join(of("u"), ["snapshot_end", "u"]).join(of("v"), ["snapshot_end", "v"]).filter("_u = _v")
    return inside.select("snapshot_end", token(F.col("_u")).alias("ring"), token(F.col("u")).alias("u"), token(F.col("v")).alias("v"), "flow_count").dropDuplicates()


def frozen(members: DataFrame, seen: DataFrame) -> dict[str, DataFrame]:
    """What is served: the latest snapshot's rings and the accounts seen there."""
    last = members.agg(F.max("snapshot_end").alias("snapshot_end"))
    return {"rings": members.join(F.broadcast(last), "snapshot_end"), "seen_accounts": seen.join(F.broadcast(last), "snapshot_end").distinct()}  # one row


def winner(metrics: DataFrame, base_rate: float | None = None) -> DataFrame:
    """The best configuration, the next one, and whether an interval of their difference says so."""
    ranked = metrics.agg(F.sort_array(F.collect_list(F.struct((-F.col("metric")).alias("m"), "config"))).alias("r"))  # a row a configuration
    return ranked.select(F.col("r")[0]["config"].alias("winner"), (-F.col("r")[0]["m"]).alias("metric"), F.col("r")[1]["config"].alias("runner_up"), (-F.col("r")[1]["m"]).alias("next_metric"))
