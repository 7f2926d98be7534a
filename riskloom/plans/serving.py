from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.operators import rings, serving
from riskloom.operators.costs import decision
from riskloom.sources import tables

from .base import T, query, rounded
from .graph import _CC, _DEG, _FEAT, _rings, _shapes


@query(f"WITH {T} SELECT transaction_id, account_id, us FROM t WHERE account_id = 7 ORDER BY us DESC, transaction_id LIMIT 50 OFFSET 10")
def latest_page(spark, sf_dir):
    return serving.latest_page(serving.scoped(tables.events(spark, sf_dir), 7), 50, 10).select("transaction_id", "account_id", "us")


@query(f"WITH {T}, r AS (SELECT account_id, CASE WHEN amount >= 400 THEN 'block' WHEN amount >= 200 THEN 'review' ELSE 'allow' END AS decision, row_number() OVER (PARTITION BY account_id ORDER BY us DESC, transaction_id DESC) AS n FROM t) SELECT account_id, count(*) AS decisions, round(avg(CAST(decision = 'block' AS INT)), 6) AS block_share, round(avg(CAST(decision = 'review' AS INT)), 6) AS review_share FROM r WHERE n <= 20 GROUP BY 1")
def decision_mix(spark, sf_dir):
    t = tables.events(spark, sf_dir).withColumn("decision", decision(F.col("amount"), 200, 400))
    return rounded(serving.decision_mix(t, 20))


_CONTEXT = f"""WITH {T}, c AS (SELECT *, count(*) OVER (PARTITION BY account_id ORDER BY us RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW) AS k FROM t), w AS (SELECT *, avg(amount) OVER b AS am, stddev_samp(amount) OVER b AS ad, avg(k) OVER b AS km, stddev_samp(k) OVER b AS kd, count(*) OVER b AS n FROM c WINDOW b AS (PARTITION BY account_id ORDER BY us, transaction_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
  z AS (SELECT transaction_id, coalesce(abs(CASE WHEN n >= 2 THEN (amount - am) / nullif(ad, 0) END) > 2, false) AS amount_unusual, coalesce(abs(CASE WHEN n >= 2 THEN (k - km) / nullif(kd, 0) END) > 2, false) AS rate_unusual FROM w)
  SELECT *, CASE WHEN amount_unusual AND rate_unusual THEN 'unusual amount and rate' WHEN amount_unusual THEN 'unusual amount' WHEN rate_unusual THEN 'unusual rate' ELSE 'in line with history' END AS rationale FROM z"""


@query(_CONTEXT)
def risk_context(spark, sf_dir):
    return serving.risk_context(tables.events(spark, sf_dir)).select("transaction_id", "amount_unusual", "rate_unusual", "rationale")


def _page(m, shapes):
    f = shapes.select("snapshot_end", "ring", "size", F.round(F.col("size") * F.col("density"), 6).alias("score"))
    return rings.ring_page(m.join(f, ["snapshot_end", "ring"]), 2.0, 4, 20)


@query(f"WITH RECURSIVE {_CC}, {_DEG}, {_FEAT} SELECT snapshot_end, ring, size, round(size * density, 6) AS score FROM ft WHERE size * density >= 2.0 AND size >= 4 ORDER BY size DESC, snapshot_end, ring LIMIT 20")
def flagged_rings_page(spark, sf_dir):
    return _page(_rings(spark, sf_dir)[0], _shapes(spark, sf_dir)).select("snapshot_end", "ring", "size", "score")


@query(f"WITH {T}, n AS (SELECT account_id FROM t GROUP BY 1 HAVING count(*) BETWEEN 2 AND 80), a AS (SELECT account_id FROM n ORDER BY md5(account_id || '|42'), account_id LIMIT 25) SELECT transaction_id, account_id FROM t SEMI JOIN a USING (account_id)")
def demo_sample(spark, sf_dir):
    return serving.account_sample(tables.events(spark, sf_dir), 25, 2, 80, 42).select("transaction_id", "account_id")


@query("WITH j AS (SELECT event_id, json_object('event', 'payment', 'id', event_id, 'amount', CAST(round(value * 100) AS BIGINT), 'account', user_id) AS v FROM events) SELECT event_id AS transaction_id, round(CAST(json_extract(v, '$.amount') AS BIGINT) / 100.0, 2) AS amount, CAST(json_extract(v, '$.account') AS BIGINT) AS account_id FROM j WHERE CAST(json_extract(v, '$.amount') AS BIGINT) >= 500")
def payment_events(spark, sf_dir):
    valid, _ = serving.parsed_payments(_envelopes(spark, sf_dir), 5.0)
    return valid.select("transaction_id", F.round(F.col("amount").cast("double"), 2).alias("amount"), "account_id")


def _envelopes(spark, sf_dir):
    t = tables.events(spark, sf_dir)
    body = F.struct(F.lit("payment").alias("event"), F.struct(F.col("transaction_id").alias("id"), F.round(F.col("amount") * 100).cast("long").alias("amount"), F.create_map(F.lit("account_id"), F.col("account_id").cast("string")).alias("notes"), F.expr("us div 1000000").alias("created_at")).alias("payment"))
    return t.select(F.to_json(body).alias("value"))


@query("SELECT source AS layer, model_id FROM (SELECT 'row' AS source, 'm' || max(o_orderkey) AS model_id FROM orders UNION ALL SELECT 'ring', 'm' || max(o_orderkey) FROM orders WHERE o_orderkey % 2 = 1)")
def latest_models(spark, sf_dir):
    o = tables.table(spark, sf_dir, "orders")
    entry = lambda layer, rows: rows.select(F.lit(layer).alias("layer"), F.concat(F.lit("m"), F.col("o_orderkey").cast("string")).alias("model_id"), F.col("o_orderkey").alias("seq"))
    registry = entry("row", o).unionByName(entry("ring", o.filter("o_orderkey % 2 = 1")))
    return serving.latest_entries(registry)


@query("SELECT o_orderkey AS id, list_aggregate(list_filter(['o_custkey', CASE WHEN o_orderstatus <> 'P' THEN 'o_orderstatus' END], lambda x: x IS NOT NULL), 'string_agg', ',') AS names FROM orders")
def raw_column_map(spark, sf_dir):
    o = tables.table(spark, sf_dir, "orders").withColumn("o_orderstatus", F.nullif("o_orderstatus", F.lit("P")))
    named = serving.raw_columns(o, ["o_custkey", "o_orderstatus"])
    return o.select(F.col("o_orderkey").alias("id"), F.array_join(F.array_sort(F.map_keys(named)), ",").alias("names"))


@query(f"WITH {T}, r AS (SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY us, transaction_id) AS n FROM t) SELECT transaction_id, account_id FROM r ORDER BY n = 1, md5(transaction_id || '|42') LIMIT 40")
def scoring_subset(spark, sf_dir):
    return serving.scoring_subset(tables.events(spark, sf_dir), 40).select("transaction_id", "account_id")


@query("WITH a AS (SELECT o_orderkey AS id, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice / 600000 END AS row_score, CASE WHEN o_custkey % 4 > 0 THEN o_custkey % 10 / 10 END AS ring_score FROM orders) SELECT id, coalesce(row_score, -1) AS row_score_filled, coalesce(ring_score, -1) AS ring_score_filled, row_score IS NULL OR ring_score IS NULL AS degraded, array_to_string(list_filter([CASE WHEN row_score IS NULL THEN 'row_absent' END, CASE WHEN ring_score IS NULL THEN 'ring_absent' END], lambda x: x IS NOT NULL), ',') AS reasons FROM a")
def degraded_vectors(spark, sf_dir):
    o = tables.table(spark, sf_dir, "orders")
    rows = o.select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice") / 600000).alias("row_score"), F.when(F.col("o_custkey") % 4 > 0, F.col("o_custkey") % 10 / 10).alias("ring_score"))
    out = serving.fused(rows, {"row": "row_score", "ring": "ring_score"})
    return out.select("id", "row_score_filled", "ring_score_filled", "degraded", F.array_join("degraded_reasons", ",").alias("reasons"))


@query("SELECT o_orderkey AS id, array_to_string(list_filter(CASE WHEN o_orderstatus = 'F' THEN ['amount', 'velocity'] ELSE ['amount'] END, lambda x: x <> 'amount'), ',') AS foreign_names FROM orders WHERE o_orderstatus = 'F'")
def refused_inputs(spark, sf_dir):
    raw = F.when(F.col("o_orderstatus") == "F", F.create_map(F.lit("amount"), F.lit("1"), F.lit("velocity"), F.lit("9"))).otherwise(F.create_map(F.lit("amount"), F.lit("1")))
    _, refused = serving.allowed_inputs(tables.table(spark, sf_dir, "orders").withColumn("raw", raw), "raw", ["amount"])
    return refused.select(F.col("o_orderkey").alias("id"), F.array_join("foreign", ",").alias("foreign_names"))


@query("SELECT o_orderkey AS id, '{\"cost\":' || CAST(o_custkey AS VARCHAR) || '}' AS exported FROM orders")
def scrubbed_export(spark, sf_dir):
    o = tables.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.struct(F.col("o_custkey").alias("cost"), F.col("o_totalprice").alias("threshold"), F.lit(3.0).alias("review")).alias("policy"))
    return serving.stripped(o, "policy", ["threshold", "review"]).select("id", F.to_json("policy").alias("exported"))


@query("WITH d AS (SELECT l_orderkey AS transaction_id, epoch_us(l_shipdate) AS us, l_linenumber, l_extendedprice, l_quantity FROM lineitem WHERE l_orderkey = 42), r AS (SELECT *, row_number() OVER (ORDER BY us DESC, l_linenumber, l_extendedprice, l_quantity) AS nth FROM d) SELECT transaction_id, nth, l_linenumber FROM r WHERE nth <= 50")
def decisions_of_one(spark, sf_dir):
    li = tables.table(spark, sf_dir, "lineitem").filter("l_orderkey = 42")
    us = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', l_shipdate)")
    return serving.newest(li.select(F.col("l_orderkey").alias("transaction_id"), us.alias("us"), "l_linenumber", "l_extendedprice", "l_quantity"), "transaction_id", ["l_linenumber", "l_extendedprice", "l_quantity"], 50).select("transaction_id", "nth", "l_linenumber")


@query(f"WITH RECURSIVE {_CC}, {_DEG}, {_FEAT}, z AS (SELECT *, round(size * density, 6) AS score FROM ft) SELECT snapshot_end, ring, score >= 2.0 AS flagged, array_to_string(list_filter([CASE WHEN size >= 6 THEN 'large' END, CASE WHEN density >= 0.5 THEN 'dense' END, CASE WHEN max_degree >= 4 THEN 'hub' END], lambda x: x IS NOT NULL), ',') AS drivers FROM z")
def ring_flags(spark, sf_dir):
    f = _shapes(spark, sf_dir).withColumn("score", F.round(F.col("size") * F.col("density"), 6))
    out = rings.flagged(f, 2.0, {"large": F.col("size") >= 6, "dense": F.col("density") >= 0.5, "hub": F.col("max_degree") >= 4})
    return out.select("snapshot_end", "ring", "flagged", F.array_join("drivers", ",").alias("drivers"))


@query(f"WITH RECURSIVE {_CC}, {_DEG}, bd AS (SELECT min(snapshot_end) AS lo, max(snapshot_end) AS hi FROM kept) SELECT DISTINCT snapshot_end, ring, CASE WHEN snapshot_end <= lo + (hi - lo) * 0.7 THEN 'train' WHEN snapshot_end <= lo + (hi - lo) * 0.85 THEN 'val' ELSE 'test' END AS split FROM kept, bd")
def ring_splits(spark, sf_dir):
    m, _ = _rings(spark, sf_dir)
    lo, hi = m.agg(F.min("snapshot_end"), F.max("snapshot_end")).first()
    return rings.split_of(m, lo + (hi - lo) * 0.7, lo + (hi - lo) * 0.85).select("snapshot_end", "ring", "split").distinct()
