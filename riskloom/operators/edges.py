"""Edges between accounts: chained transfers, shared entities, snapshots in time."""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DAY = 86_400_000_000


def _bucket(amount: Column, width: float) -> Column:
    return F.when(amount > 0, F.floor(F.log(amount) / width)).otherwise(F.lit(-(10**9)))


def _within_reach(t: DataFrame, c: DataFrame, steps: int, tolerance: float, by: tuple[str, ...]) -> DataFrame:
    """Rows of ``t`` (t_step, t_amount) with those of ``c`` (step, c_amount) up to ``steps`` later and within ``tolerance``."""
    t = t.withColumn("step", F.explode(F.sequence("t_step", F.col("t_step") + steps)))
    if not tolerance:
        met = t.withColumn("_b", F.col("t_amount")).join(c.withColumn("_b", F.col("c_amount")), [*by, "step", "_b"])
    else:
        own = _bucket(F.col("t_amount"), width := -log(1 - tolerance))
        near = F.when(F.col("t_amount") > 0, F.sequence(own - 1, own + 1)).otherwise(F.array(F.lit(-(10**9)).cast("long")))
        met = t.withColumn("_b", F.explode(near)).join(c.withColumn("_b", _bucket(F.col("c_amount"), width).cast("long")), [*by, "step", "_b"])
    return met.drop("_b").filter((F.col("c_amount") >= F.col("t_amount") * (1 - tolerance)) & (F.col("c_amount") <= F.col("t_amount") * (1 + tolerance)))


def _counted(t: DataFrame, c: DataFrame, steps: int, tolerance: float, by: tuple[str, ...]) -> DataFrame:
    """Rows of ``t`` that reach any of ``c``, with their ``candidate_count``."""
    asked = [*by, "t_step", "t_amount"]
    offered = c.groupBy(*by, "step", "c_amount").agg(F.count("*").alias("_n"))
    counts = _within_reach(t.select(*asked).distinct(), offered, steps, tolerance, by).groupBy(*asked).agg(F.sum("_n").alias("candidate_count"))
    return t.join(counts, asked)


def with_candidates(transfers: DataFrame, cash_outs: DataFrame, steps: int, tolerance: float, by: tuple[str, ...] = ()) -> DataFrame:
    """Transfers that reach any cash-out, with the ``candidate_count`` of ``chain_edges`` and without the pairs."""
    t = transfers.withColumnsRenamed({"step": "t_step", "amount": "t_amount"})
    return _counted(t, cash_outs.withColumnRenamed("amount", "c_amount"), steps, tolerance, by).withColumnsRenamed({"t_step": "step", "t_amount": "amount"})


def chain_edges(transfers: DataFrame, cash_outs: DataFrame, steps: int, tolerance: float, carried: tuple[str, ...] = (), by: tuple[str, ...] = ()) -> DataFrame:
    """Every transfer with the cash-outs up to ``steps`` later whose amount is within ``tolerance``.

    The step is made an equality key by listing the steps a transfer reaches, the amount by
    logarithmic buckets as wide as the tolerance, next ones included; the exact bounds are checked
    on what meets. Zero amounts have no logarithm and meet each other alone. ``carried`` columns of both
    come along as ``t_`` and ``c_``; ``name_match`` says that both name one account. Columns in ``by`` must be equal.

    Candidates are counted by step and amount before the pairs are made, so that no pair is shuffled.
    """
    t = transfers.select(*by, F.col("transaction_id").alias("transfer_id"), F.col("account_id").alias("src"), F.col("step").alias("t_step"), F.col("amount").alias("t_amount"), *[F.col(c).alias(f"t_{c}") for c in carried])
    c = cash_outs.select(*by, F.col("transaction_id").alias("cash_out_id"), F.col("account_id").alias("dst"), "step", F.col("amount").alias("c_amount"), *[F.col(c).alias(f"c_{c}") for c in carried])
    inside = _within_reach(_counted(t, c, steps, tolerance, by), c, steps, tolerance, by)
    relative = F.coalesce(F.try_divide(F.abs(F.col("c_amount") - F.col("t_amount")), "t_amount"), F.lit(0.0))
    return inside.select(*by, "transfer_id", "cash_out_id", "src", "dst", "t_step", (F.col("step") - F.col("t_step")).alias("step_gap"), relative.alias("relative_delta"), "candidate_count", (1 / F.col("candidate_count")).alias("weight"), F.col("src").eqNullSafe(F.col("dst")).alias("name_match"), *[f"{end}_{c}" for c in carried for end in "tc"])


def snapshot_grid(df: DataFrame, cadence: int) -> tuple[int, int]:
    """First and last snapshot end: whole cadences around the data."""
    low, high = df.agg(F.min("us"), F.max("us")).first()
    return (low // cadence + 1) * cadence, (high // cadence + 1) * cadence


def snapshot_members(df: DataFrame, window: int, cadence: int) -> DataFrame:
    """Each row once for every snapshot whose ``[end - window, end)`` holds it; ends are whole cadences."""
    _, last = snapshot_grid(df, cadence)
    first_end = (F.floor(F.col("us") / cadence) + 1) * cadence
    last_end = F.least((F.floor((F.col("us") + window) / cadence)) * cadence, F.lit(last))
    ends = F.when(last_end >= first_end, F.sequence(first_end, last_end, F.lit(cadence).cast("long")))
    return df.withColumn("snapshot_end", F.explode(ends))


def scoring_snapshot(df: DataFrame, cadence: int) -> DataFrame:
    """The snapshot that scores a row: the last end at or before it; none before the first."""
    first, _ = snapshot_grid(df, cadence)
    end = F.floor(F.col("us") / cadence) * cadence
    return df.withColumn("snapshot_end", F.when(end >= first, end))


def fingerprint(columns: list[str]) -> Column:
    """Composite key, null if any part is."""
    parts = []
    for c in columns:
        parts += [F.lit("|"), F.col(c).cast("string")]
    return F.concat(*parts[1:])


def entity_edges(df: DataFrame, specs: dict[str, list[str]], greatest_degree: int) -> DataFrame:
    """Account to entity edges, weighted ``ln(accounts / degree)``; entities of one account or too many go."""
    total = df.select("account_id").distinct().count()
    keys = F.array(*[F.struct(F.lit(n).alias("spec"), fingerprint(cs).alias("entity")) for n, cs in specs.items()])
    pairs = df.select("account_id", F.explode(keys).alias("k")).select("account_id", "k.spec", "k.entity").filter(F.col("entity").isNotNull()).dropDuplicates()
    degree = pairs.groupBy("spec", "entity").agg(F.count("*").alias("degree")).filter((F.col("degree") > 1) & (F.col("degree") <= greatest_degree))
    return pairs.join(degree, ["spec", "entity"]).withColumn("idf", F.log(F.lit(total) / F.col("degree")))


def merged_edges(flow: DataFrame, chain: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Undirected union of two edge tables, self-loops dropped, with what each contributed."""
    a = flow.select(*by, "src", "dst", F.lit(1).alias("f"), F.lit(0).alias("c"), F.lit(0.0).alias("w"), F.lit(None).cast("long").alias("n"))
    b = chain.select(*by, "src", "dst", F.lit(0).alias("f"), F.lit(1).alias("c"), F.col("weight").alias("w"), F.col("candidate_count").alias("n"))
    both = a.unionByName(b).filter("src <> dst").withColumns({"u": F.least("src", "dst"), "v": F.greatest("src", "dst")})
    return both.groupBy(*by, "u", "v").agg((F.max("f") == 1).alias("has_flow"), (F.max("c") == 1).alias("has_chain"), F.sum("f").alias("flow_count"), F.sum("w").alias("chain_weight"), F.min("n").alias("least_candidates"), ((F.max("f") == 1) & (F.max("c") == 1)).alias("corroborated"))


def pairing_flags(transfers: DataFrame, chains: DataFrame) -> DataFrame:
    """The rule baseline: is a transfer matched by any cash-out?"""
    matched = chains.select(F.col("transfer_id").alias("transaction_id")).distinct().withColumn("_m", F.lit(True))
    return transfers.join(matched, "transaction_id", "left").withColumn("paired", F.coalesce("_m", F.lit(False))).drop("_m")


def keyed_hash(column: Column, key: bytes, length: int = 16) -> Column:
    """HMAC-SHA256 in hex, cut to ``length``; native, so ids never leave the JVM."""
    import hashlib

    key = hashlib.sha256(key).digest() if len(key) > 64 else key
    padded = key.ljust(64, b"\0")
    inner, outer = (F.unhex(F.lit(bytes(b ^ p for b in padded).hex())) for p in (0x36, 0x5C))
    message = F.encode(column.cast("string"), "utf-8")
    return F.substring(F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message), 256))), 256), 1, length)


def evict(df: DataFrame, cutoff: int) -> tuple[DataFrame, DataFrame]:
    """Rows from the cutoff on, and how many were older."""
    return df.filter(F.col("us") >= cutoff), df.agg(F.count_if(F.col("us") < cutoff).alias("evicted"))


def touched_accounts(df: DataFrame) -> DataFrame:
    """Both ends of the flagged rows, each once."""
    return df.filter("is_fraud").select(F.explode(F.array("src", "dst")).alias("node")).distinct()
