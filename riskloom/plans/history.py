from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.operators import encoders, history
from riskloom.operators.splits import assign_splits
from riskloom.sources import tables

from .base import O, T, query, rounded

_ORDER = "PARTITION BY account_id ORDER BY us, transaction_id"
_BEFORE = f"({_ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


def _range(micros: int) -> str:
    return f"(PARTITION BY account_id ORDER BY us RANGE BETWEEN {micros - 1} PRECEDING AND CURRENT ROW)"


@query(f"""WITH {T} SELECT transaction_id, account_id, row_number() OVER ({_ORDER}) - 1 AS prior_count,
  round((us - lag(us) OVER ({_ORDER})) / 1e6, 6) AS seconds_since_prior,
  {', '.join(f'count(*) OVER {_range(m)} AS count_{n}, round(sum(amount) OVER {_range(m)}, 6) AS sum_{n}' for n, m in history.WINDOWS.items())}, true AS velocity_available FROM t""")
def velocity_windows(spark, sf_dir):
    df = history.with_velocity(history.with_prior_counts(tables.events(spark, sf_dir)))
    return rounded(df.select("transaction_id", "account_id", "prior_count", "seconds_since_prior", *[f"{k}_{n}" for n in history.WINDOWS for k in ("count", "sum")], "velocity_available"))


@query(f"WITH {O} SELECT transaction_id, account_id, count(*) OVER {_range(30 * 24 * history.HOUR)} AS count_30d, round(sum(amount) OVER {_range(30 * 24 * history.HOUR)}, 4) AS sum_30d, true AS velocity_available FROM o")
def velocity_with_ties(spark, sf_dir):
    df = history.with_velocity(tables.orders(spark, sf_dir), {"30d": 30 * 24 * history.HOUR})
    return rounded(df.select("transaction_id", "account_id", "count_30d", "sum_30d", "velocity_available"), 4)


@query(f"WITH {O} SELECT transaction_id, CAST(NULL AS BIGINT) AS count_24h, CAST(NULL AS DOUBLE) AS sum_24h, false AS velocity_available FROM o")
def velocity_absent(spark, sf_dir):
    df = history.with_velocity(tables.orders(spark, sf_dir), {"24h": 24 * history.HOUR}, available=False)
    return df.select("transaction_id", "count_24h", "sum_24h", "velocity_available")


@query(f"""WITH {T}, w AS (SELECT transaction_id, amount, avg(amount) OVER {_BEFORE} AS m, stddev_samp(amount) OVER {_BEFORE} AS d, count(*) OVER {_BEFORE} AS n FROM t)
  SELECT transaction_id, round(m + 1e-9, 6) AS prior_mean, CASE WHEN n >= 2 THEN round((amount - m) / nullif(d, 0) + 1e-9, 6) END AS amount_z FROM w""")
def amount_zscore(spark, sf_dir):
    z = history.with_amount_z(tables.events(spark, sf_dir))
    return z.select("transaction_id", F.round(F.col("prior_mean") + 1e-9, 6).alias("prior_mean"), F.round(F.col("amount_z") + 1e-9, 6).alias("amount_z"))


@query(f"WITH {T} SELECT transaction_id, row_number() OVER ({_ORDER}) - 1 AS prior_count, round((us - lag(us) OVER ({_ORDER})) / 1e6, 6) AS seconds_since_prior FROM t")
def seconds_since_prior(spark, sf_dir):
    return rounded(history.with_prior_counts(tables.events(spark, sf_dir)).select("transaction_id", "prior_count", "seconds_since_prior"))


@query(f"""WITH {T}, v AS (SELECT *, coalesce(device, '__missing__') AS d FROM t), w AS (SELECT transaction_id, row_number() OVER (PARTITION BY account_id, d ORDER BY us, transaction_id) - 1 AS same, row_number() OVER ({_ORDER}) - 1 AS before FROM v)
  SELECT transaction_id, same = 0 AS device_is_new, CASE WHEN before > 0 THEN round(1 - same / before, 6) END AS device_mismatch FROM w""")
def familiarity(spark, sf_dir):
    return rounded(history.with_familiarity(tables.events(spark, sf_dir), "device").select("transaction_id", "device_is_new", "device_mismatch"))


@query(f"WITH {T} SELECT transaction_id, row_number() OVER (PARTITION BY device ORDER BY us, transaction_id) - 1 AS counterparty_prior_count FROM t")
def counterparty_prior(spark, sf_dir):
    return history.with_counterparty_prior(tables.events(spark, sf_dir), "device").select("transaction_id", "counterparty_prior_count")


@query(f"""WITH {T}, c AS (SELECT *, count(*) OVER {_range(history.HOUR)} AS count_1h FROM t), w AS (SELECT transaction_id, count_1h, avg(count_1h) OVER {_BEFORE} AS m, stddev_samp(count_1h) OVER {_BEFORE} AS d, count(*) OVER {_BEFORE} AS n FROM c)
  SELECT transaction_id, count_1h, round(m, 6) AS usual_mean, CASE WHEN n >= 2 THEN round((count_1h - m) / nullif(d, 0), 6) END AS rate_z FROM w""")
def usual_rate(spark, sf_dir):
    return rounded(history.with_usual_rate(tables.events(spark, sf_dir)).select("transaction_id", "count_1h", "usual_mean", "rate_z"))


@query(f"""WITH {T}, p AS (SELECT *, CAST(floor((us % 86400000000) / 3600000000) AS INT) AS h, CAST((us // 86400000000 + 3) % 7 AS INT) AS d, row_number() OVER ({_ORDER}) - 1 AS n, (us - lag(us) OVER ({_ORDER})) / 1e6 AS gap FROM t)
  SELECT transaction_id, account_id, round(ln(1 + amount), 6) AS amount_log, round(ln(1 + greatest(coalesce(gap, 0), 0)), 6) AS gap_log, round(sin(2 * pi() * h / 24), 6) AS hour_sin, round(cos(2 * pi() * h / 24), 6) AS hour_cos, round(sin(2 * pi() * d / 7), 6) AS day_sin, round(cos(2 * pi() * d / 7), 6) AS day_cos,
  round(ln(1 + count(*) OVER {_range(24 * history.HOUR)}), 6) AS count_24h_log, round(ln(1 + sum(amount) OVER {_range(24 * history.HOUR)}), 6) AS sum_24h_log, CAST(n > 0 AS INT) AS has_prior FROM p""")
def timestep_features(spark, sf_dir):
    return rounded(history.timestep_features(tables.events(spark, sf_dir)).drop("us"))


@query(f"""WITH {T}, a AS (SELECT * FROM t WHERE transaction_type = 'purchase'), j AS (SELECT a.transaction_id, t.transaction_id AS h_id, row_number() OVER (PARTITION BY a.transaction_id ORDER BY t.us DESC, t.transaction_id DESC) AS nth FROM a JOIN t ON a.account_id = t.account_id AND t.us <= a.us AND t.transaction_id <> a.transaction_id)
  SELECT * FROM j WHERE nth <= 5""")
def history_lookup(spark, sf_dir):
    t = tables.events(spark, sf_dir)
    return history.as_of(t.filter("transaction_type = 'purchase'"), t, 5).select("transaction_id", "h_id", "nth")


_SPLIT = "r AS (SELECT us, sum(count(*)) OVER (ORDER BY us) AS cum FROM t GROUP BY us), k AS (SELECT min(us) FILTER (cum > floor((SELECT count(*) FROM t) * 0.7)) AS a, min(us) FILTER (cum > floor((SELECT count(*) FROM t) * 0.85)) AS b FROM r)"


@query(f"""WITH {T}, {_SPLIT}, tr AS (SELECT t.* FROM t, k WHERE us < a), f AS (SELECT 'device' AS col, coalesce(device, '__missing__') AS cat, count(*) / (SELECT count(*) FROM tr) AS freq FROM tr GROUP BY 2 UNION ALL SELECT 'transaction_type', coalesce(transaction_type, '__missing__'), count(*) / (SELECT count(*) FROM tr) FROM tr GROUP BY 2)
  SELECT t.transaction_id, round(coalesce(f1.freq, 0), 6) AS device_freq, round(coalesce(f2.freq, 0), 6) AS transaction_type_freq FROM t LEFT JOIN f f1 ON f1.col = 'device' AND f1.cat = coalesce(device, '__missing__') LEFT JOIN f f2 ON f2.col = 'transaction_type' AND f2.cat = coalesce(transaction_type, '__missing__')""")
def freq_encode(spark, sf_dir):
    t = assign_splits(tables.events(spark, sf_dir))
    columns = ["device", "transaction_type"]
    fitted = encoders.fit_frequencies(t.filter("split = 'train'"), columns)
    return rounded(encoders.apply_frequencies(t, fitted, columns).select("transaction_id", "device_freq", "transaction_type_freq"))


@query(f"""WITH {T}, f AS (SELECT 'transaction_type' AS "column", transaction_type AS cat, count(*) / (SELECT count(*) FROM t) AS freq FROM t GROUP BY 2)
  SELECT "column", substr(sha256('v1' || string_agg(cat || '=' || printf('%.6f', round(freq, 6)), ',' ORDER BY cat || '=' || printf('%.6f', round(freq, 6)))), 1, 12) AS digest, count(*) AS entries FROM f GROUP BY 1""")
def encoder_digest(spark, sf_dir):
    return encoders.digest(encoders.fit_frequencies(tables.events(spark, sf_dir), ["transaction_type"]), "v1")


@query("""WITH x AS (SELECT avg(amount) AS m, stddev_pop(amount) AS d FROM (SELECT value AS amount FROM events)), y AS (SELECT avg(v) AS m, stddev_pop(v) AS d FROM (SELECT CAST(user_id AS DOUBLE) AS v FROM events))
  SELECT 'amount' AS "column", round(m, 6) AS mean, round(CASE WHEN d = 0 THEN 1 ELSE d END, 6) AS std FROM x UNION ALL SELECT 'account', round(m, 6), round(CASE WHEN d = 0 THEN 1 ELSE d END, 6) FROM y""")
def scaler_fit(spark, sf_dir):
    return rounded(encoders.scaler(tables.events(spark, sf_dir).withColumn("account", F.col("account_id").cast("double")), ["amount", "account"]))


@query("""WITH x AS (SELECT avg(value) AS m, stddev_pop(value) AS d FROM events) SELECT event_id AS transaction_id, round(coalesce(greatest(least((value - m) / d, 5), -5), 0), 6) AS amount,
  CAST(coalesce(nullif(list_position(['click', 'error', 'purchase'], event_type), 0) - 1, -1) AS INT) AS transaction_type_code FROM events, x""")
def scaled_inputs(spark, sf_dir):
    t = tables.events(spark, sf_dir)
    fitted = {r["column"]: (r["mean"], r["std"]) for r in encoders.scaler(t, ["amount"]).collect()}  # one row a column
    coded = encoders.level_codes(encoders.scaled(t, fitted), "transaction_type", ["click", "error", "purchase"])
    return rounded(coded.select("transaction_id", "amount", "transaction_type_code"))


@query(f"WITH {T} SELECT transaction_id, {', '.join(f'count(*) OVER {_range(m)} AS count_{n}, round(sum(amount) OVER {_range(m)}, 6) AS sum_{n}' for n, m in history.WINDOWS.items())}, true AS velocity_available FROM t")
def velocity_split(spark, sf_dir):
    """The trailing windows again, by chunks of an account's time."""
    df = history.split_velocity(tables.events(spark, sf_dir), chunk=8 * 24 * history.HOUR)
    return rounded(df.select("transaction_id", *[f"{k}_{n}" for n in history.WINDOWS for k in ("count", "sum")], "velocity_available"))


@query(f"WITH {T} SELECT transaction_id, row_number() OVER ({_ORDER}) - 1 AS prior_count, round((us - lag(us) OVER ({_ORDER})) / 1e6, 6) AS seconds_since_prior FROM t")
def prior_split(spark, sf_dir):
    """Prior counts and gaps again, by chunks and the totals of earlier ones."""
    df = history.split_prior_counts(tables.events(spark, sf_dir), chunk=3 * 24 * history.HOUR)
    return rounded(df.select("transaction_id", "prior_count", "seconds_since_prior"))
