"""Leak-free per-account history: every value is made of rows that came before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

HOUR = 3_600_000_000
WINDOWS = {"1h": HOUR, "24h": 24 * HOUR, "7d": 7 * 24 * HOUR}


def engineering_order(account: str = "account_id") -> WindowSpec:
    return Window.partitionBy(account).orderBy("us", "transaction_id")


def prior_rows(account: str = "account_id") -> WindowSpec:
    return engineering_order(account).rowsBetween(Window.unboundedPreceding, -1)


def trailing(micros: int, account: str = "account_id") -> WindowSpec:
    """``(t - micros, t]``, rows at the same instant included."""
    return Window.partitionBy(account).orderBy("us").rangeBetween(-(micros - 1), 0)


def with_prior_counts(df: DataFrame) -> DataFrame:
    w = engineering_order()
    return df.select("*", (F.row_number().over(w) - 1).alias("prior_count"), ((F.col("us") - F.lag("us").over(w)) / 1e6).alias("seconds_since_prior"))


def with_amount_z(df: DataFrame) -> DataFrame:
    """Prior mean from one row on; z from two on, none where the prior amounts do not vary."""
    before = prior_rows()
    mean, spread, n = F.avg("amount").over(before), F.stddev_samp("amount").over(before), F.count("*").over(before)
    z = F.when(n >= 2, (F.col("amount") - mean) / F.nullif(spread, F.lit(0.0)))
    return df.select("*", mean.alias("prior_mean"), z.alias("amount_z"))


def with_velocity(df: DataFrame, windows: dict[str, int] = WINDOWS, available: bool = True) -> DataFrame:
    """Count and sum of the trailing windows; where there is no history, nulls and a flag, not zeros."""
    out = []
    for name, micros in windows.items():
        w = trailing(micros)
        count, total = F.count("*").over(w), F.sum("amount").over(w)
        out += [(count if available else F.lit(None).cast("long")).alias(f"count_{name}"), (total if available else F.lit(None).cast("double")).alias(f"sum_{name}")]
    return df.select("*", *out, F.lit(available).alias("velocity_available"))


def with_familiarity(df: DataFrame, column: str) -> DataFrame:
    """Is the value new to the account, and what share of its earlier rows had another one? Missing is a value."""
    value = F.coalesce(F.col(column).cast("string"), F.lit("__missing__"))
    same = F.row_number().over(Window.partitionBy("account_id", "_v").orderBy("us", "transaction_id")) - 1
    before = F.row_number().over(engineering_order()) - 1
    out = df.withColumn("_v", value).select("*", same.alias("_same"), before.alias("_before"))
    share = F.when(F.col("_before") > 0, 1 - F.col("_same") / F.col("_before"))
    return out.select(*df.columns, (F.col("_same") == 0).alias(f"{column}_is_new"), share.alias(f"{column}_mismatch"))


def with_counterparty_prior(df: DataFrame, column: str = "counterparty_id") -> DataFrame:
    w = Window.partitionBy(column).orderBy("us", "transaction_id")
    return df.withColumn("counterparty_prior_count", F.row_number().over(w) - 1)


def with_usual_rate(df: DataFrame) -> DataFrame:
    """How unusual is the trailing-hour count against the account's own earlier ones?"""
    counted = df.withColumn("count_1h", F.count("*").over(trailing(HOUR)))
    before = prior_rows()
    n, mean, spread = F.count("*").over(before), F.avg("count_1h").over(before), F.stddev_samp("count_1h").over(before)
    return counted.select("*", mean.alias("usual_mean"), F.when(n >= 2, (F.col("count_1h") - mean) / F.nullif(spread, F.lit(0.0))).alias("rate_z"))


def hour_of_day(us: str = "us") -> Column:
    return F.floor(F.pmod(F.col(us), F.lit(24 * HOUR)) / HOUR).cast("int")


def day_of_week(us: str = "us") -> Column:
    """Monday is 0."""
    return F.pmod(F.floor(F.col(us) / (24 * HOUR)) + 3, F.lit(7)).cast("int")


def timestep_features(df: DataFrame) -> DataFrame:
    """The per-step projection for sequence models: logs, cycles and missingness flags."""
    w = engineering_order()
    prior, gap = F.row_number().over(w) - 1, (F.col("us") - F.lag("us").over(w)) / 1e6
    cycle = lambda part, n, f, name: f(2 * F.lit(3.141592653589793) * part / n).alias(name)
    hour, day = hour_of_day(), day_of_week()
    return df.select(
        "transaction_id", "account_id", "us",
        F.log1p("amount").alias("amount_log"),
        F.log1p(F.greatest(F.coalesce(gap, F.lit(0.0)), F.lit(0.0))).alias("gap_log"),
        cycle(hour, 24, F.sin, "hour_sin"), cycle(hour, 24, F.cos, "hour_cos"), cycle(day, 7, F.sin, "day_sin"), cycle(day, 7, F.cos, "day_cos"),
        F.log1p(F.count("*").over(trailing(24 * HOUR))).alias("count_24h_log"),
        F.log1p(F.sum("amount").over(trailing(24 * HOUR))).alias("sum_24h_log"),
        (prior > 0).cast("int").alias("has_prior"),
    )


def as_of(asked: DataFrame, history: DataFrame, rows: int, chunk: int = 30 * 24 * HOUR) -> DataFrame:
    """The latest ``rows`` rows of the same account at or before each asked row, itself left out; ids of ``history`` are unique.

    Linear in both tables: within a chunk of an account's time one pass keeps a tail of ``rows + 1`` rows at each instant,
    asked rows are sorted in and take the last tail, and chunks carry their tail on. One account is spread over its chunks.
    """
    keep = rows + 1
    here = F.floor(F.col("us") / chunk).alias("_chunk")
    h = history.filter("account_id IS NOT NULL AND us IS NOT NULL AND transaction_id IS NOT NULL")
    h = h.select("account_id", here, "us", F.struct("us", F.col("transaction_id").alias("id"), "amount").alias("_h"))
    latest = lambda c: F.slice(c, F.greatest(F.size(c) - keep + 1, F.lit(1)), F.lit(keep))
    order = Window.partitionBy("account_id", "_chunk").orderBy("us", "_h.id")
    tail = F.collect_list("_h").over(order.rowsBetween(-rows, 0)).alias("_tail")
    ends = h.select("account_id", "_chunk", "us", tail, F.lead("us").over(order).alias("_next")).filter("_next IS NULL OR _next > us")
    # what each chunk leaves to the next: every chunk with history holds a row, so as many as are kept suffice
    chunks = ends.filter("_next IS NULL").select("account_id", "_chunk", "_tail")
    by_chunk = Window.partitionBy("account_id").orderBy("_chunk")  # a row a chunk
    left = chunks.select("account_id", "_chunk", latest(F.flatten(F.collect_list("_tail").over(by_chunk.rowsBetween(-rows, 0)))).alias("_left"))
    q = asked.filter("account_id IS NOT NULL AND us IS NOT NULL AND transaction_id IS NOT NULL").select("account_id", here, "us", F.struct("*").alias("_q"))
    wanted = left.join(q.select("account_id", "_chunk").distinct(), ["account_id", "_chunk"], "full")
    before = wanted.select("account_id", "_chunk", F.last("_left", ignorenulls=True).over(by_chunk.rowsBetween(Window.unboundedPreceding, -1)).alias("_before"))
    both = q.withColumn("_tail", F.lit(None).cast(ends.schema["_tail"].dataType)).unionByName(ends.select("account_id", "_chunk", "us", F.lit(None).cast(q.schema["_q"].dataType).alias("_q"), "_tail"))
    # of one instant, history first
    pass_ = Window.partitionBy("account_id", "_chunk").orderBy("us", F.col("_q").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumn("_seen", F.last("_tail", ignorenulls=True).over(pass_)).filter("_q IS NOT NULL").join(before, ["account_id", "_chunk"], "left")
    none = F.array().cast(ends.schema["_tail"].dataType)
    found = F.filter(F.reverse(F.concat(F.coalesce("_before", none), F.coalesce("_seen", none))), lambda x: x["id"] != F.col("_q.transaction_id"))
    out = seen.select("_q", F.posexplode(F.slice(found, 1, rows)).alias("_n", "_h"))
    return out.select("_q.*", F.col("_h.us").alias("h_us"), F.col("_h.id").alias("h_id"), F.col("_h.amount").alias("h_amount"), (F.col("_n") + 1).alias("nth"))


def split_velocity(df: DataFrame, windows: dict[str, int] = WINDOWS, chunk: int | None = None) -> DataFrame:
    """The values of ``with_velocity`` when one account may hold much of the table.

    An account's time is cut into chunks of at least the widest window; rows near the end of a chunk
    are also sent to the next one as context. A task then holds a chunk of an account, not the account.
    """
    widest = max(windows.values())
    chunk = max(chunk or 4 * widest, widest)
    own = df.withColumns({"_chunk": F.floor(F.col("us") / chunk), "_own": F.lit(True)})
    context = own.filter(F.pmod("us", F.lit(chunk)) > chunk - widest).withColumns({"_chunk": F.col("_chunk") + 1, "_own": F.lit(False)})
    out = []
    for name, micros in windows.items():
        w = Window.partitionBy("account_id", "_chunk").orderBy("us").rangeBetween(-(micros - 1), 0)
        out += [F.count("*").over(w).alias(f"count_{name}"), F.sum("amount").over(w).alias(f"sum_{name}")]
    both = own.unionByName(context).select("*", *out)
    return both.filter("_own").drop("_own", "_chunk").withColumn("velocity_available", F.lit(True))


def split_prior_counts(df: DataFrame, chunk: int = 30 * 24 * HOUR) -> DataFrame:
    """The values of ``with_prior_counts`` by chunks of an account's time and the totals of earlier chunks."""
    own = df.withColumn("_chunk", F.floor(F.col("us") / chunk))
    totals = own.groupBy("account_id", "_chunk").agg(F.count("*").alias("_n"), F.max("us").alias("_last"))
    before = Window.partitionBy("account_id").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)  # a row a chunk
    offsets = totals.select("account_id", "_chunk", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.max("_last").over(before).alias("_prev"))
    w = Window.partitionBy("account_id", "_chunk").orderBy("us", "transaction_id")
    run = own.select("*", (F.row_number().over(w) - 1).alias("_r"), F.lag("us").over(w).alias("_lag")).join(offsets, ["account_id", "_chunk"])
    return run.select(*df.columns, (F.col("_r") + F.col("_before")).alias("prior_count"), ((F.col("us") - F.coalesce("_lag", "_prev")) / 1e6).alias("seconds_since_prior"))
