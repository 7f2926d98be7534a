"""Row constraints, file profiles and findings; everything comes back as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .metrics import exact_quantiles

LEVEL_LIMIT = 50


def clock(seconds: Column, epoch: int) -> Column:
    """Microseconds of a second offset from an epoch."""
    return (seconds + epoch) * 1_000_000


def step_clock(step: Column, epoch: int) -> Column:
    """Microseconds of a 1-based hour step."""
    return ((step - 1) * 3600 + epoch) * 1_000_000


def account_ladder(card: Column, address: Column, day: Column, first_day: Column, email: Column, row: Column) -> tuple[Column, Column]:
    """Account id and the rung that gave it: card, address and start day; card and mail; card; the row itself."""
    start = F.bround(day - first_day, 0).cast("long").cast("string")
    rungs = [("card_addr_day", card.isNotNull() & address.isNotNull() & start.isNotNull(), F.concat_ws("|", card, address, start)), ("card_email", card.isNotNull() & email.isNotNull(), F.concat_ws("|", card, email)), ("card", card.isNotNull(), card)]
    account, strategy = F.concat(F.lit("row|"), row), F.lit("singleton")
    for name, ready, key in reversed(rungs):
        account, strategy = F.when(ready, key).otherwise(account), F.when(ready, name).otherwise(strategy)
    return account, strategy


def checked(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """``violations``: names of the rules a row breaks; a rule that is null counts as broken."""
    return df.withColumn("violations", F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()])))


def divided(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid rows and quarantined ones."""
    return df.filter(F.size("violations") == 0).drop("violations"), df.filter(F.size("violations") > 0)


def quantised(amount: Column) -> Column:
    """Four places, half to even."""
    return F.bround(amount, 4).cast("decimal(20,4)")


def clean_number(c: Column) -> Column:
    """NaN and infinities are null."""
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def column_findings(expected: list[str], observed: list[str]) -> list[tuple[str, str, str]]:
    """Missing and duplicate columns are errors, extra ones warnings."""
    out = [("error", "missing_column", c) for c in expected if c not in observed]
    out += [("warning", "extra_column", c) for c in dict.fromkeys(observed) if c not in expected]
    return out + [("error", "duplicate_column", c) for c in dict.fromkeys(observed) if observed.count(c) > 1]


def number_profile(df: DataFrame, key: str, positive: Column, numbers: list[str]) -> DataFrame:
    """Rows, positives, repeated keys and the range of each number in one pass."""
    return df.agg(F.count("*").alias("n_rows"), F.count_if(positive).alias("positives"), (F.count(key) - F.count_distinct(key)).alias("duplicate_keys"), *[f(c).alias(f"{n}_{c}") for c in numbers for n, f in (("min", F.min), ("max", F.max), ("sum", F.sum))])


def level_profile(df: DataFrame, columns: list[str], positive: Column, limit: int = LEVEL_LIMIT) -> DataFrame:
    """Counts and positives of each level; columns with more than ``limit`` levels are given up."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("level")) for c in columns])
    levels = df.select(F.explode(pairs).alias("p"), positive.alias("_y")).groupBy("p.column", "p.level").agg(F.count("*").alias("n_rows"), F.count_if("_y").alias("positives"))
    few = levels.groupBy("column").agg(F.count("*").alias("_n")).filter(F.col("_n") <= limit).select("column")
    return levels.join(few, "column", "left_semi")


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Child rows without a parent (an error), and the share of parents with a child."""
    p, c = parent.select(F.col(parent_key).alias("k")).distinct(), child.select(F.col(child_key).alias("k"))
    lost = c.join(p, "k", "left_anti").agg(F.count("*").alias("orphans"))
    joined = p.join(c, "k", "left_semi").agg(F.count("*").alias("parents_joined"))
    return lost.crossJoin(joined).crossJoin(p.agg(F.count("*").alias("parents"))).withColumn("join_rate", F.try_divide("parents_joined", "parents"))  # one row each


def missing_rates(df: DataFrame, groups: dict[str, list[str]]) -> DataFrame:
    """Mean missing rate over all cells of each group of columns."""
    rates = [F.struct(F.lit(g).alias("column_group"), (sum((F.avg(F.col(c).isNull().cast("int")) for c in cs), F.lit(0.0)) / len(cs)).alias("missing_rate")) for g, cs in groups.items()]
    return df.agg(F.array(*rates).alias("a")).select(F.explode("a").alias("r")).select("r.*")


def column_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """Count, mean, deviation, range, exact quartiles and missing rate; quartiles by ranges, so that no task holds a column."""
    def one(c: str) -> Column:
        return F.struct(F.lit(c).alias("column"), F.count(c).alias("n"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(c).cast("double").alias("min"), F.max(c).cast("double").alias("max"), F.avg(F.col(c).isNull().cast("int")).alias("missing_rate"))

    rows = df.agg(F.array(*map(one, columns)).alias("a")).select(F.explode("a").alias("r")).select("r.*")
    quartiles = None
    for c in columns:
        q = exact_quantiles(df, c, [0.25, 0.5, 0.75]).select(F.lit(c).alias("column"), *[F.col("q")[i].alias(n) for i, n in enumerate(("p25", "p50", "p75"))])
        quartiles = q if quartiles is None else quartiles.unionByName(q)
    return rows.join(quartiles, "column").select("column", "n", "mean", "std", "min", "p25", "p50", "p75", "max", "missing_rate")


def column_classes(df: DataFrame, columns: list[str], levels: int = 64, null_rate: float = 0.999) -> DataFrame:
    """Degenerate, numeric, native categorical or frequency-encoded."""
    kinds = dict(df.dtypes)
    def one(c: str) -> Column:
        return F.struct(F.lit(c).alias("column"), F.avg(F.col(c).isNull().cast("int")).alias("null_rate"), F.count_distinct(c).alias("levels"), F.lit(kinds[c] not in ("string", "boolean")).alias("numeric"))

    rows = df.agg(F.array(*map(one, columns)).alias("a")).select(F.explode("a").alias("r")).select("r.*")
    kind = F.when((F.col("null_rate") >= null_rate) | (F.col("levels") <= 1), "degenerate").when(F.col("numeric"), "numeric").when(F.col("levels") <= levels, "native").otherwise("frequency")
    return rows.withColumn("kind", kind).drop("numeric")


def retention(df: DataFrame, scope: Column, positive: Column) -> DataFrame:
    """Rows and positives before and after a scope filter."""
    return df.agg(F.count("*").alias("rows_in_file"), F.count_if(positive).alias("positives_in_file"), F.count_if(scope).alias("rows_kept"), F.count_if(scope & positive).alias("positives_kept"))


def count_findings(profile: DataFrame, expected: dict[str, int]) -> DataFrame:
    """Long-form findings of a one-row profile: each count beside the one expected."""
    rows = [F.struct(F.lit(n).alias("check"), F.col(n).cast("long").alias("observed"), F.lit(v).cast("long").alias("expected"), F.when(F.col(n) != v, "error").otherwise("ok").alias("level")) for n, v in expected.items()]
    return profile.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def accounts(df: DataFrame, split: str = "split") -> DataFrame:
    """One row an account: first and last seen, counts, first split and whether it straddles splits."""
    return df.groupBy("source_dataset", "account_id").agg(F.min("us").alias("first_us"), F.max("us").alias("last_us"), F.count("*").alias("n_rows"), F.count_if("is_fraud").alias("fraud_rows"), F.min_by(split, F.struct("us", "transaction_id")).alias("first_split"), (F.count_distinct(split) > 1).alias("straddles"))


def account_facts(summary: DataFrame) -> DataFrame:
    return summary.agg(F.count("*").alias("accounts"), F.count_if(F.col("n_rows") == 1).alias("singletons"), F.count_if("straddles").alias("straddlers"), F.count_if(F.col("straddles") & (F.col("fraud_rows") > 0)).alias("straddling_fraud"), F.percentile("n_rows", F.lit(0.5)).alias("median_rows"), F.max("n_rows").alias("max_rows"))


def parity(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that one store has and the other lacks, repeats counted."""
    only = lambda x, y: x.exceptAll(y).agg(F.count("*").alias("n"))
    return only(a, b).select(F.lit("only_first").alias("side"), "n").unionByName(only(b, a).select(F.lit("only_second").alias("side"), "n"))


def feature_json(df: DataFrame, names: list[str]) -> Column:
    """A row's features as one JSON object, nulls kept, NaN and infinities as null."""
    number = {c for c, t in df.dtypes if t in ("double", "float")}
    return F.to_json(F.struct(*[(clean_number(F.col(c)) if c in number else F.col(c)).alias(c) for c in names]), {"ignoreNullFields": "false"})


def recurrence(df: DataFrame, end: str) -> DataFrame:
    """How often do ends recur: one row for each of the buckets 1, 2-5, 6-20 and 21+."""
    n = F.col("n")
    bucket = F.when(n == 1, "1").when(n <= 5, "2-5").when(n <= 20, "6-20").otherwise("21+")
    return df.groupBy(end).agg(F.count("*").alias("n")).groupBy(bucket.alias("bucket")).agg(F.count("*").alias("ends"), F.sum("n").alias("n_rows"))


def graph_viability(df: DataFrame, transfer: str, cash_out: str, usable: float = 0.5, negligible: float = 0.01) -> DataFrame:
    """Can transfers be followed by account? Distinct ends, those that recur, and the share of fraudulent transfers whose end cashes out.

    One row; ``df``: account_id, counterparty_id, transaction_type, is_fraud. The link is judged by the share that meets a fraudulent
    cash-out: below ``negligible`` it is absent, below ``usable`` weak. Without fraudulent transfers both shares are 0.
    """
    ends = df.filter(F.col("counterparty_id").isNotNull()).groupBy("counterparty_id").agg(F.count("*").alias("n"))
    counts = ends.agg(F.count("*").alias("distinct_ends"), F.count_if(F.col("n") > 1).alias("recurring_ends"))
    out = df.filter(F.col("transaction_type") == cash_out).groupBy(F.col("account_id").alias("counterparty_id")).agg(F.bool_or("is_fraud").alias("_fraud"))
    asked = df.filter((F.col("transaction_type") == transfer) & F.col("is_fraud")).select("counterparty_id").join(out, "counterparty_id", "left")
    share = lambda c: F.coalesce(F.avg(c.cast("int")), F.lit(0.0))
    met = asked.agg(share(F.coalesce("_fraud", F.lit(False))).alias("chain_to_fraud"), share(F.col("_fraud").isNotNull()).alias("chain_to_any"))
    verdict = F.when(F.col("chain_to_fraud") < negligible, "absent").when(F.col("chain_to_fraud") < usable, "weak").otherwise("usable")
    return counts.crossJoin(met).withColumn("verdict", verdict)  # one row each
