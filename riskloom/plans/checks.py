from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.operators import checks, costs
from riskloom.operators.splits import assign_splits
from riskloom.sources import tables

from .base import O, T, query, rounded
from .splits import _CUT


@query(f"WITH {O}, {_CUT} SELECT 'orders' AS source_dataset, account_id, min(us) AS first_us, max(us) AS last_us, count(*) AS n_rows, count(*) FILTER (is_fraud) AS fraud_rows, arg_min(split, (us, transaction_id)) AS first_split, count(DISTINCT split) > 1 AS straddles FROM sp GROUP BY account_id")
def account_summary(spark, sf_dir):
    return checks.accounts(assign_splits(tables.orders(spark, sf_dir)))


@query(f"WITH {O}, {_CUT}, a AS (SELECT account_id, count(*) AS n, count(*) FILTER (is_fraud) AS f, count(DISTINCT split) > 1 AS st FROM sp GROUP BY account_id) SELECT count(*) AS accounts, count(*) FILTER (n = 1) AS singletons, count(*) FILTER (st) AS straddlers, count(*) FILTER (st AND f > 0) AS straddling_fraud, round(quantile_cont(n, 0.5), 6) AS median_rows, max(n) AS max_rows FROM a")
def account_facts(spark, sf_dir):
    return rounded(checks.account_facts(checks.accounts(assign_splits(tables.orders(spark, sf_dir)))))


@query("SELECT 'ids' AS column_group, round((avg(CAST(event_id IS NULL AS INT)) + avg(CAST(user_id IS NULL AS INT))) / 2, 6) AS missing_rate FROM events UNION ALL SELECT 'detail', round((avg(CAST(json_extract_string(props, '$.k') IS NULL AS INT)) + avg(CAST(nullif(event_type, 'view') IS NULL AS INT))) / 2, 6) FROM events")
def missing_rates(spark, sf_dir):
    t = tables.events(spark, sf_dir).withColumn("kind", F.nullif("transaction_type", F.lit("view")))
    return rounded(checks.missing_rates(t, {"ids": ["transaction_id", "account_id"], "detail": ["device", "kind"]}))


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", count({c}) AS n, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, round(min({c}), 4) AS min, round(quantile_cont({c}, 0.25), 4) AS p25, round(quantile_cont({c}, 0.5), 4) AS p50, round(quantile_cont({c}, 0.75), 4) AS p75, round(max({c}), 4) AS max, round(avg(CAST({c} IS NULL AS INT)), 4) AS missing_rate FROM lineitem" for c in ("l_quantity", "l_extendedprice", "l_discount")))
def column_stats(spark, sf_dir):
    return rounded(checks.column_stats(tables.table(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"]), 4)


@query("""WITH c AS (SELECT 'o_orderstatus' AS "column", avg(CAST(o_orderstatus IS NULL AS INT)) AS null_rate, count(DISTINCT o_orderstatus) AS levels, false AS num FROM orders UNION ALL SELECT 'o_orderpriority', avg(CAST(o_orderpriority IS NULL AS INT)), count(DISTINCT o_orderpriority), false FROM orders UNION ALL SELECT 'o_totalprice', avg(CAST(o_totalprice IS NULL AS INT)), count(DISTINCT o_totalprice), true FROM orders UNION ALL SELECT 'constant', 0, 1, false FROM orders GROUP BY 1, 3, 4)
  SELECT "column", round(null_rate, 6) AS null_rate, levels, CASE WHEN null_rate >= 0.999 OR levels <= 1 THEN 'degenerate' WHEN num THEN 'numeric' WHEN levels <= 4 THEN 'native' ELSE 'frequency' END AS kind FROM c""")
def column_classes(spark, sf_dir):
    o = tables.table(spark, sf_dir, "orders").withColumn("constant", F.lit("x"))
    return rounded(checks.column_classes(o, ["o_orderstatus", "o_orderpriority", "o_totalprice", "constant"], levels=4))


@query("SELECT count(*) AS n_rows, count(*) FILTER (l_returnflag = 'R') AS positives, count(l_orderkey) - count(DISTINCT l_orderkey) AS duplicate_keys, min(l_quantity) AS min_l_quantity, max(l_quantity) AS max_l_quantity, round(sum(l_quantity), 4) AS sum_l_quantity FROM lineitem")
def file_profile(spark, sf_dir):
    return rounded(checks.number_profile(tables.table(spark, sf_dir, "lineitem"), "l_orderkey", F.col("l_returnflag") == "R", ["l_quantity"]), 4)


@query("SELECT 'l_linestatus' AS \"column\", l_linestatus AS level, count(*) AS n_rows, count(*) FILTER (l_returnflag = 'R') AS positives FROM lineitem GROUP BY 2 UNION ALL SELECT 'l_linenumber', CAST(l_linenumber AS VARCHAR), count(*), count(*) FILTER (l_returnflag = 'R') FROM lineitem GROUP BY 2")
def level_profile(spark, sf_dir):
    return checks.level_profile(tables.table(spark, sf_dir, "lineitem"), ["l_linestatus", "l_linenumber", "l_partkey"], F.col("l_returnflag") == "R")


@query("SELECT 'n_rows' AS \"check\", count(*) AS observed, 60000 AS expected, CASE WHEN count(*) <> 60000 THEN 'error' ELSE 'ok' END AS level FROM lineitem UNION ALL SELECT 'positives', count(*) FILTER (l_returnflag = 'R'), 20000, CASE WHEN count(*) FILTER (l_returnflag = 'R') <> 20000 THEN 'error' ELSE 'ok' END FROM lineitem")
def profile_findings(spark, sf_dir):
    p = checks.number_profile(tables.table(spark, sf_dir, "lineitem"), "l_orderkey", F.col("l_returnflag") == "R", [])
    return checks.count_findings(p, {"n_rows": 60000, "positives": 20000})


@query("WITH p AS (SELECT DISTINCT o_orderkey AS k FROM orders WHERE o_orderstatus <> 'P') SELECT (SELECT count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT k FROM p)) AS orphans, (SELECT count(*) FROM p WHERE k IN (SELECT l_orderkey FROM lineitem)) AS parents_joined, (SELECT count(*) FROM p) AS parents, round((SELECT count(*) FROM p WHERE k IN (SELECT l_orderkey FROM lineitem)) / (SELECT count(*) FROM p), 6) AS join_rate")
def orphan_check(spark, sf_dir):
    return rounded(checks.orphans(tables.table(spark, sf_dir, "lineitem"), tables.table(spark, sf_dir, "orders").filter("o_orderstatus <> 'P'"), "l_orderkey", "o_orderkey"))


@query("""WITH x AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey % 5 = 0 THEN NULL ELSE CAST(l_partkey AS VARCHAR) END AS card, CASE WHEN l_suppkey % 3 = 0 THEN NULL ELSE CAST(l_suppkey AS VARCHAR) END AS addr, l_linenumber AS day, l_quantity / 2 AS d1, CASE WHEN l_returnflag = 'N' THEN NULL ELSE l_returnflag END AS mail FROM lineitem),
  y AS (SELECT *, CAST(CAST(round_even(day - d1, 0) AS BIGINT) AS VARCHAR) AS st FROM x)
  SELECT l_orderkey, l_linenumber, CASE WHEN card IS NOT NULL AND addr IS NOT NULL AND st IS NOT NULL THEN card || '|' || addr || '|' || st WHEN card IS NOT NULL AND mail IS NOT NULL THEN card || '|' || mail WHEN card IS NOT NULL THEN card ELSE 'row|' || CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) END AS account_id,
  CASE WHEN card IS NOT NULL AND addr IS NOT NULL AND st IS NOT NULL THEN 'card_addr_day' WHEN card IS NOT NULL AND mail IS NOT NULL THEN 'card_email' WHEN card IS NOT NULL THEN 'card' ELSE 'singleton' END AS strategy FROM y""")
def uid_ladder(spark, sf_dir):
    li = tables.table(spark, sf_dir, "lineitem")
    text = lambda c: F.col(c).cast("string")
    account, strategy = checks.account_ladder(F.when(F.col("l_partkey") % 5 != 0, text("l_partkey")), F.when(F.col("l_suppkey") % 3 != 0, text("l_suppkey")), F.col("l_linenumber"), F.col("l_quantity") / 2, F.nullif("l_returnflag", F.lit("N")), F.concat_ws("-", text("l_orderkey"), text("l_linenumber")))
    return li.select("l_orderkey", "l_linenumber", account.alias("account_id"), strategy.alias("strategy"))


@query(f"WITH {T}, x AS (SELECT transaction_id, list_filter([CASE WHEN NOT (amount >= 1 AND amount <= 400) THEN 'amount_bounds' END, CASE WHEN NOT (length(transaction_type) <= 6) THEN 'type_length' END, CASE WHEN NOT (coalesce(account_id, -1) > 3) THEN 'account_known' END], lambda v: v IS NOT NULL) AS v FROM t) SELECT transaction_id, array_to_string(v, ',') AS violations FROM x WHERE len(v) > 0")
def quarantine(spark, sf_dir):
    rules = {"amount_bounds": (F.col("amount") >= 1) & (F.col("amount") <= 400), "type_length": F.length("transaction_type") <= 6, "account_known": F.coalesce("account_id", F.lit(-1)) > 3}
    _, bad = checks.divided(checks.checked(tables.events(spark, sf_dir), rules))
    return bad.select("transaction_id", F.array_join("violations", ",").alias("violations"))


@query("SELECT count(*) AS rows_in_file, count(*) FILTER (event_type = 'error') AS positives_in_file, count(*) FILTER (event_type IN ('purchase', 'error')) AS rows_kept, count(*) FILTER (event_type = 'error') AS positives_kept FROM events")
def scope_retention(spark, sf_dir):
    t = tables.events(spark, sf_dir)
    return checks.retention(t, F.col("transaction_type").isin("purchase", "error"), F.col("is_fraud"))


@query(f"WITH {T} SELECT transaction_id, 1512086400000000 + (us // 1000000 % 86400) * 1000000 AS from_seconds, (1512086400 + (us // 3600000000 % 24) * 3600) * 1000000 AS from_step, CAST(round_even(amount / 7, 4) AS DECIMAL(20, 4)) AS amount FROM t")
def clock_anchor(spark, sf_dir):
    t = tables.events(spark, sf_dir)
    second, step = F.expr("us div 1000000 % 86400"), F.expr("us div 3600000000 % 24 + 1")
    return t.select("transaction_id", checks.clock(second, 1512086400).alias("from_seconds"), checks.step_clock(step, 1512086400).alias("from_step"), checks.quantised(F.col("amount") / 7).alias("amount"))


@query("SELECT 'only_first' AS side, (SELECT count(*) FROM (SELECT o_custkey, o_orderstatus FROM orders EXCEPT ALL SELECT o_custkey, o_orderstatus FROM orders WHERE o_orderstatus <> 'P')) AS n UNION ALL SELECT 'only_second', 0")
def store_parity(spark, sf_dir):
    o = tables.table(spark, sf_dir, "orders").select("o_custkey", "o_orderstatus")
    return checks.parity(o, o.filter("o_orderstatus <> 'P'"))


@query("SELECT event_id AS transaction_id, '{\"a\":' || CAST(event_id AS VARCHAR) || ',\"t\":' || CASE WHEN event_type = 'view' THEN 'null' ELSE '\"' || event_type || '\"' END || '}' AS features FROM events")
def feature_json(spark, sf_dir):
    t = tables.events(spark, sf_dir).select("transaction_id", F.col("transaction_id").alias("a"), F.nullif("transaction_type", F.lit("view")).alias("t"))
    return t.select("transaction_id", checks.feature_json(t, ["a", "t"]).alias("features"))


@query("WITH n AS (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1) SELECT CASE WHEN n = 1 THEN '1' WHEN n <= 5 THEN '2-5' WHEN n <= 20 THEN '6-20' ELSE '21+' END AS bucket, count(*) AS ends, sum(n)::BIGINT AS n_rows FROM n GROUP BY 1")
def end_recurrence(spark, sf_dir):
    return checks.recurrence(tables.table(spark, sf_dir, "lineitem"), "l_suppkey")


@query(f"WITH {T} SELECT transaction_id, CASE WHEN amount / 500 < 0.05 THEN 'low' WHEN amount / 500 < 0.25 THEN 'medium' ELSE 'high' END AS band FROM t")
def risk_band(spark, sf_dir):
    return tables.events(spark, sf_dir).select("transaction_id", costs.risk_band(F.col("amount") / 500).alias("band"))


@query("WITH l AS (SELECT l_suppkey AS a, l_partkey AS b, l_linestatus AS k, l_quantity > 40 AS f FROM lineitem), n AS (SELECT b, count(*) AS n FROM l GROUP BY 1), c AS (SELECT a, bool_or(f) AS f FROM l WHERE k = 'O' GROUP BY 1), m AS (SELECT avg(CAST(coalesce(c.f, false) AS INT)) AS cf, avg(CAST(c.f IS NOT NULL AS INT)) AS ca FROM l LEFT JOIN c ON c.a = l.b WHERE l.k = 'F' AND l.f) SELECT (SELECT count(*) FROM n) AS distinct_ends, (SELECT count(*) FROM n WHERE n > 1) AS recurring_ends, round(coalesce(cf, 0), 6) AS chain_to_fraud, round(coalesce(ca, 0), 6) AS chain_to_any, CASE WHEN coalesce(cf, 0) < 0.01 THEN 'absent' WHEN cf < 0.5 THEN 'weak' ELSE 'usable' END AS verdict FROM m")
def graph_viability(spark, sf_dir):
    li = tables.table(spark, sf_dir, "lineitem")
    rows = li.select(F.col("l_suppkey").alias("account_id"), F.col("l_partkey").alias("counterparty_id"), F.col("l_linestatus").alias("transaction_type"), (F.col("l_quantity") > 40).alias("is_fraud"))
    return rounded(checks.graph_viability(rows, "F", "O"))
