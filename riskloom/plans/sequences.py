from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from riskloom.functions.shared import cut
from riskloom.operators import encoders, history, sequences
from riskloom.operators.splits import assign_splits
from riskloom.sources import tables

from .base import O, T, query, rounded
from .splits import _CUT

_W = "(PARTITION BY account_id ORDER BY us, transaction_id ROWS BETWEEN 7 PRECEDING AND CURRENT ROW)"
_SEQ = f"{T}, q AS (SELECT *, count(*) OVER {_W} AS length FROM t)"


@query(f"WITH {T} SELECT transaction_id, count(*) OVER {_W} AS length, first(us) OVER {_W} AS oldest_us, round(sum(amount) OVER {_W}, 6) AS amount FROM t")
def sequence_windows(spark, sf_dir):
    w = sequences.trailing_windows(tables.events(spark, sf_dir), ["amount"], 8)
    total = F.aggregate("steps", F.lit(0.0), lambda s, x: s + x["amount"])
    return w.select("transaction_id", F.col("length").cast("long").alias("length"), F.element_at("steps", 1)["us"].alias("oldest_us"), F.round(total, 6).alias("amount"))


@query("SELECT CAST(0 AS BIGINT) AS future_reads")
def future_reads(spark, sf_dir):
    w = sequences.trailing_windows(tables.events(spark, sf_dir), ["amount"], 8)
    return sequences.future_reads(w).agg(F.count("*").alias("future_reads"))


def _scored(spark, sf_dir):
    w = Window.partitionBy("account_id").orderBy("us", "transaction_id").rowsBetween(-7, 0)
    return tables.events(spark, sf_dir).withColumn("length", F.count("*").over(w)).withColumn("score", F.col("amount") / 500)


@query(f"WITH {_SEQ} SELECT account_id, round(coalesce(max(amount / 500) FILTER (length >= 3), -1), 6) AS score, bool_or(is_fraud) AS label, round(coalesce(sum(amount) FILTER (is_fraud), 0), 4) AS fraud_amount, max(length) AS longest FROM q GROUP BY 1")
def account_rollup(spark, sf_dir):
    return rounded(sequences.to_accounts(_scored(spark, sf_dir)).withColumn("fraud_amount", F.round("fraud_amount", 4)))


@query(f"WITH {_SEQ} SELECT count(*) AS n_rows, round(avg(CAST(length >= 3 AS INT)), 6) AS row_share, round(count(*) FILTER (length >= 3 AND is_fraud) / count(*) FILTER (is_fraud), 6) AS fraud_share, round(count(DISTINCT account_id) FILTER (length >= 3) / count(DISTINCT account_id), 6) AS account_share FROM q")
def coverage(spark, sf_dir):
    return rounded(sequences.coverage(_scored(spark, sf_dir)))


@query(f"WITH {_SEQ} SELECT CASE WHEN length >= 10 THEN '10+' WHEN length >= 5 THEN '5-9' WHEN length >= 3 THEN '3-4' ELSE 'short' END AS band, count(*) AS n_rows, round(avg(amount), 6) AS mean_amount FROM q GROUP BY 1")
def history_bands(spark, sf_dir):
    return rounded(_scored(spark, sf_dir).groupBy(sequences.band().alias("band")).agg(F.count("*").alias("n_rows"), F.avg("amount").alias("mean_amount")))


@query(f"WITH {O} SELECT transaction_id, account_id FROM o WHERE account_id NOT IN (SELECT account_id FROM o WHERE is_fraud)")
def eligible_rows(spark, sf_dir):
    return sequences.eligible(tables.orders(spark, sf_dir)).select("transaction_id", "account_id")


@query(f"WITH {O}, {_CUT}, z AS (SELECT *, CASE split WHEN 'train' THEN 0 WHEN 'val' THEN 1 ELSE 2 END AS split_rank FROM sp), y AS (SELECT split_rank, first(split_rank) OVER {_W} AS oldest FROM z) SELECT split_rank, count(*) AS windows, count(*) FILTER (oldest < split_rank) AS crossing FROM y GROUP BY 1")
def crossing_windows(spark, sf_dir):
    o = assign_splits(tables.orders(spark, sf_dir))
    rank = F.when(F.col("split") == "train", 0).when(F.col("split") == "val", 1).otherwise(2)
    return sequences.crossing_windows(o.withColumn("split_rank", rank), 8)


CODED = ["transaction_type", "device", "weekday", "daypart"]
FEATURES = [*sequences.STEP_COLUMNS, *[f"{c}_freq" for c in CODED]]


def steps(spark, sf_dir):
    """The 21 columns of a step, frequencies from the training split."""
    t = tables.events(spark, sf_dir).withColumns({"weekday": history.day_of_week().cast("string"), "daypart": F.expr("CAST(pmod(us, 86400000000) div 21600000000 AS STRING)")})
    t = t.withColumn("place", F.concat("transaction_type", "daypart"))
    train = assign_splits(t).filter("split = 'train'")
    return sequences.step_columns(t, CODED, cut(encoders.fit_frequencies(train, CODED), "encoders"))  # read once a column


_DAYS = "(us // 86400000000 + 3) % 7"
_PARTS = f"""{T}, e AS (SELECT *, CAST({_DAYS} AS VARCHAR) AS weekday, CAST(us % 86400000000 // 21600000000 AS VARCHAR) AS daypart, coalesce(device, '__missing__') AS d FROM t), e2 AS (SELECT *, transaction_type || daypart AS place FROM e),
  r AS (SELECT us, sum(count(*)) OVER (ORDER BY us) AS cum FROM t GROUP BY us), k AS (SELECT min(us) FILTER (cum > floor((SELECT count(*) FROM t) * 0.7)) AS a FROM r), tr AS (SELECT e2.* FROM e2, k WHERE us < a), n AS (SELECT count(*) AS n FROM tr)"""
_BY, _PRE = "PARTITION BY account_id ORDER BY us, transaction_id", "(PARTITION BY account_id ORDER BY us, transaction_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
_TRAIL = "(PARTITION BY account_id ORDER BY us RANGE BETWEEN {} PRECEDING AND CURRENT ROW)"
_STEPS = f"""{_PARTS}, w AS (SELECT *, CAST(us % 86400000000 // 3600000000 AS INT) AS h, {_DAYS} AS dw, row_number() OVER ({_BY}) - 1 AS pc, (us - lag(us) OVER ({_BY})) / 1e6 AS gap, avg(amount) OVER {_PRE} AS pm, stddev_samp(amount) OVER {_PRE} AS sd,
  count(*) OVER {_TRAIL.format(3_599_999_999)} AS c1, count(*) OVER {_TRAIL.format(86_399_999_999)} AS c24, sum(amount) OVER {_TRAIL.format(86_399_999_999)} AS s24, row_number() OVER (PARTITION BY account_id, d ORDER BY us, transaction_id) - 1 AS sd_n, row_number() OVER (PARTITION BY account_id, place ORDER BY us, transaction_id) - 1 AS sp_n FROM e2), z AS (SELECT *, CASE WHEN pc >= 2 THEN (amount - pm) / nullif(sd, 0) END AS zs FROM w),
  st AS (SELECT transaction_id, account_id, us, ln(1 + greatest(amount, 0)) AS amount_log, zs AS amount_z, CASE WHEN gap IS NOT NULL THEN ln(1 + greatest(gap, 0)) END AS gap_log, sin(2 * pi() * h / 24) AS hour_sin, cos(2 * pi() * h / 24) AS hour_cos, sin(2 * pi() * dw / 7) AS day_sin, cos(2 * pi() * dw / 7) AS day_cos, c1::DOUBLE AS count_1h, c24::DOUBLE AS count_24h, ln(1 + greatest(s24, 0)) AS sum_24h_log,
  (sd_n = 0)::INT::DOUBLE AS device_is_new, CASE WHEN pc > 0 THEN 1 - sd_n / pc END AS device_mismatch, (sp_n = 0)::INT::DOUBLE AS place_is_new, CASE WHEN pc > 0 THEN 1 - sp_n / pc END AS place_mismatch, ln(1 + pc) AS prior_count_log, (pc > 0)::INT::DOUBLE AS has_prior, (zs IS NOT NULL)::INT::DOUBLE AS has_z,
  {', '.join(f"coalesce((SELECT count(*) FROM tr WHERE coalesce(tr.{c}, '__missing__') = coalesce(z.{c}, '__missing__')) / (SELECT n FROM n), 0) AS {c}_freq" for c in CODED)} FROM z)"""


@query(f"WITH {_STEPS} SELECT transaction_id, account_id, {', '.join(f'round({c}, 6) AS {c}' for c in FEATURES)} FROM st")
def step_features(spark, sf_dir):
    return rounded(steps(spark, sf_dir).drop("us"))


_SOME = ["amount_log", "sum_24h_log", "hour_sin", "count_24h"]


@query(f"""WITH {_STEPS}, o AS (SELECT *, row_number() OVER ({_BY}) AS rn FROM st), x AS (SELECT a.transaction_id, a.rn - b.rn AS "offset", {', '.join(f'b.{c}' for c in _SOME)} FROM o a JOIN o b ON a.account_id = b.account_id AND b.rn BETWEEN a.rn - 7 AND a.rn),
  m AS (SELECT *, {', '.join(f'pow({c} - avg({c}) OVER (PARTITION BY transaction_id), 2) AS q{i}' for i, c in enumerate(_SOME))} FROM x), er AS (SELECT *, (q0 + q1 + q2 + q3) / 4 AS error FROM m), g AS (SELECT *, sum(error) OVER (PARTITION BY transaction_id) AS total, avg(error) OVER (PARTITION BY transaction_id) AS window_error, greatest(round(q0, 9), round(q1, 9), round(q2, 9), round(q3, 9)) AS most FROM er)
  SELECT transaction_id, CAST("offset" AS INT) AS "offset", round(error, 6) AS error, round(CASE WHEN total > 1e-12 THEN error / total ELSE 0 END, 6) AS share, CASE most WHEN round(q0, 9) THEN '{_SOME[0]}' WHEN round(q1, 9) THEN '{_SOME[1]}' WHEN round(q2, 9) THEN '{_SOME[2]}' ELSE '{_SOME[3]}' END AS driver, round(window_error, 6) AS window_error FROM g""")
def masked_step_errors(spark, sf_dir):
    """Which step and which feature makes a window unlike its own mean step."""
    w = sequences.step_matrices(steps(spark, sf_dir), _SOME, 8)
    real = F.slice("values", 1, F.col("length"))
    part = lambda i: F.aggregate(F.transform(real, lambda x: x[i]), F.lit(0.0), lambda s, x: s + x)
    mean = F.array(*[part(i) / F.col("length") for i in range(len(_SOME))])
    errors = sequences.masked_errors(w.withColumn("reconstruction", F.transform("values", lambda v: mean)))
    out = sequences.step_drivers(errors, _SOME, 1)
    return rounded(out.select("transaction_id", "offset", "error", "share", F.col("top_features")[0]["name"].alias("driver"), "window_error"))


@query()
def sequence_anomaly(spark, sf_dir):
    """How badly few directions, learned on accounts with little fraud, rebuild a window; those with too little history abstain."""
    rows = cut(steps(spark, sf_dir), "steps")
    fitted = {r["column"]: (r["mean"], r["std"]) for r in encoders.scaler(rows, FEATURES).collect()}  # a row a column
    windows = sequences.step_matrices(encoders.scaled(rows, fitted), FEATURES, 8)
    # by account, as the windows already lie: they are wide, and no join moves them
    marked = tables.events(spark, sf_dir).filter(F.col("is_fraud") & (F.pmod("account_id", F.lit(3)) == 0)).select("account_id").distinct()
    model = sequences.fit_low_rank(windows.join(marked, "account_id", "left_anti"), 8, len(FEATURES), 12)
    errors = sequences.masked_errors(sequences.with_reconstruction(windows, model))
    share = F.array_max("step_errors") / F.aggregate("step_errors", F.lit(0.0), lambda s, x: s + x)
    seen = lambda c: F.when(F.col("length") >= 3, c)
    return rounded(errors.select("transaction_id", "length", seen(F.col("error")).alias("error"), seen(share).alias("greatest_share")))
