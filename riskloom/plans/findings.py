from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.operators import checks, costs, edges, findings, metrics, models, rings
from riskloom.operators.splits import assign_splits, time_blocks
from riskloom.sources import tables

from .base import O, query, rounded, S, SN, T
from .graph import _CC, _DEG, _FEAT, _KEY, CADENCE, _members, _rings, _shapes
from .splits import _CUT

_SPAN = (1_600_000_000_000_000, 1_900_000_000_000_000)
_KNOWN = ["purchase", "view"]


def _found(spark, sf_dir):
    t = tables.events(spark, sf_dir)
    return [findings.span_finding(t, *_SPAN), findings.level_findings(t, "transaction_type", _KNOWN), findings.rule_finding(t, "positive_type", F.col("is_fraud") & (F.col("transaction_type") != "purchase")), findings.rule_finding(t, "amount_sign", F.col("amount") < 0)]


_FOUND = f"""{T}, sp AS (SELECT min(us) AS lo, max(us) AS hi, count(*) AS n FROM t), fd AS (SELECT 'warning' AS level, 'span_start' AS "check", CAST(lo AS VARCHAR) AS detail, n AS n_rows FROM sp WHERE abs(lo - {_SPAN[0]}) > 86400000000 UNION ALL SELECT 'warning', 'span_end', CAST(hi AS VARCHAR), n FROM sp WHERE abs(hi - {_SPAN[1]}) > 86400000000
  UNION ALL SELECT 'warning', 'unknown_level', transaction_type, count(*) FROM t WHERE transaction_type NOT IN ('purchase', 'view') GROUP BY 3 UNION ALL SELECT 'error', 'positive_type', NULL, count(*) FROM t WHERE is_fraud AND transaction_type <> 'purchase' HAVING count(*) > 0 UNION ALL SELECT 'error', 'amount_sign', NULL, count(*) FROM t WHERE amount < 0 HAVING count(*) > 0)"""


@query(f"WITH {_FOUND} SELECT * FROM fd")
def check_findings(spark, sf_dir):
    parts = [p.select(*findings.FINDING) for p in _found(spark, sf_dir)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query(f"WITH {_FOUND}, n AS (SELECT count(*) FILTER (level = 'error') AS errors, count(*) FILTER (level = 'warning') AS warnings FROM fd) SELECT *, errors = 0 AND warnings = 0 AS ok FROM n")
def findings_verdict(spark, sf_dir):
    return findings.rolled_up(_found(spark, sf_dir), strict=True)


@query("WITH p AS (SELECT count(*) AS n, count(*) FILTER (o_orderkey IN (SELECT l_orderkey FROM lineitem)) AS j FROM orders) SELECT 'warning' AS level, 'join_rate' AS \"check\", printf('%.4f', j / n) AS detail, n AS n_rows FROM p WHERE abs(j / n - 0.5) > 0.01")
def join_drift(spark, sf_dir):
    rate = checks.orphans(tables.table(spark, sf_dir, "lineitem"), tables.table(spark, sf_dir, "orders"), "l_orderkey", "o_orderkey")
    return findings.join_drift(rate, 0.5)


@query("SELECT 'join_rate' AS note, round(avg(CAST(l_returnflag <> 'N' AS INT)), 6) AS value FROM lineitem UNION ALL SELECT 'accounts', count(DISTINCT l_orderkey)::DOUBLE FROM lineitem UNION ALL SELECT 'strategy_' || l_linestatus, count(*)::DOUBLE FROM lineitem GROUP BY 1")
def adapter_notes(spark, sf_dir):
    return rounded(findings.adapter_notes(tables.table(spark, sf_dir, "lineitem"), F.col("l_returnflag") != "N", "l_linestatus", "l_orderkey"))


@query(f"WITH {O}, {_CUT} SELECT transaction_id, split, us FROM sp")
def full_history(spark, sf_dir):
    o = assign_splits(tables.orders(spark, sf_dir))
    return findings.ordered_history([o.filter(F.col("split") == s) for s in ("train", "val", "test")]).select("transaction_id", "split", "us")


@query("SELECT l_orderkey AS id, l_linenumber AS line, l_tax + l_discount - l_quantity AS origin_error, l_quantity + l_discount - l_tax AS target_error, l_quantity > 0 AND l_tax = 0 AS origin_drained, l_returnflag = 'N' AS to_merchant FROM lineitem")
def balance_features(spark, sf_dir):
    li = tables.table(spark, sf_dir, "lineitem")
    rows = li.select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), F.col("l_discount").alias("amount"), F.col("l_quantity").alias("old_origin"), F.col("l_tax").alias("new_origin"), F.col("l_quantity").alias("old_target"), F.col("l_tax").alias("new_target"), F.when(F.col("l_returnflag") == "N", "M1").otherwise("C1").alias("counterparty_id"))
    return findings.balance_features(rows).select("id", "line", "origin_error", "target_error", "origin_drained", "to_merchant")


@query("SELECT o_orderkey AS id, o_orderstatus <> 'P' OR o_orderpriority LIKE '1%' AS has_identity FROM orders")
def has_identity(spark, sf_dir):
    o = tables.table(spark, sf_dir, "orders")
    ids = o.select(F.col("o_orderkey").alias("id"), F.nullif("o_orderstatus", F.lit("P")).alias("id_01"), F.when(F.col("o_orderpriority").startswith("1"), 1).alias("id_02"))
    return ids.select("id", findings.any_known(["id_01", "id_02"]).alias("has_identity"))


@query(f"WITH {S} SELECT id, line, round(least(greatest((score - 0.2) / 0.6, 0), 1), 6) AS scaled, round(least(greatest(score, 0), 1), 6) AS same FROM s")
def score_normaliser(spark, sf_dir):
    s = tables.scored(spark, sf_dir)
    return rounded(s.select("id", "line", findings.normalised_score(F.col("score"), 0.2, 0.8).alias("scaled"), findings.normalised_score(F.col("score")).alias("same")))


@query(f"WITH {O}, {_CUT}, b AS (SELECT min(ln(1 + amount)) AS lo, max(ln(1 + amount)) AS hi FROM sp WHERE split = 'train') SELECT transaction_id, round(least(greatest((ln(1 + amount) - lo) / (hi - lo), 0), 1), 6) AS reference FROM sp, b WHERE split = 'test'")
def amount_reference(spark, sf_dir):
    o = assign_splits(tables.orders(spark, sf_dir))
    return rounded(findings.amount_reference(o.filter("split = 'train'"), o.filter("split = 'test'")).select("transaction_id", "reference"))


@query(f"WITH {O}, a AS (SELECT account_id, max(amount) AS baseline FROM o GROUP BY 1 HAVING count(*) >= 5) SELECT transaction_id, a.account_id IS NOT NULL AS known, a.baseline FROM o LEFT JOIN a USING (account_id)")
def known_accounts(spark, sf_dir):
    o = tables.orders(spark, sf_dir)
    base = o.groupBy("account_id").agg(F.max("amount").alias("baseline"), F.count("*").alias("n")).filter("n >= 5").drop("n")
    return findings.known_accounts(o, base).select("transaction_id", "known", "baseline")


_TOP = "unnest(['amount', 'other', 'score']) AS name, unnest([0.00001 * amount, -0.5 * other, 0.7 * score]) AS value"


@query(f"WITH {SN}, p AS (SELECT row, id, line, {_TOP} FROM sn WHERE id = 42), r AS (SELECT *, row_number() OVER (PARTITION BY row ORDER BY abs(value) DESC, name) AS nth FROM p) SELECT row, id, line, nth::INT AS nth, name, round(value, 6) AS value FROM r WHERE nth <= 2")
def decision_explained(spark, sf_dir):
    """Every line of one order, each by its own number."""
    c = models.contributions(tables.numbered(spark, sf_dir), {"amount": 0.00001, "other": -0.5, "score": 0.7}, 3)
    return rounded(findings.explanation(c, F.col("id") == 42, 2, ("row", "id", "line")))


@query(f"WITH RECURSIVE {_CC}, {_DEG}, x AS (SELECT m.snapshot_end, coalesce(a.ring, b.ring) AS ring, amount, is_fraud FROM m LEFT JOIN kept a ON a.snapshot_end = m.snapshot_end AND a.node = m.src LEFT JOIN kept b ON b.snapshot_end = m.snapshot_end AND b.node = m.dst), r AS (SELECT snapshot_end, ring, sum(amount) AS amount, bool_or(is_fraud) AS label, count(*) AS n FROM x WHERE ring IS NOT NULL GROUP BY 1, 2) SELECT count(*) AS n, count(*) FILTER (n >= 200) AS flagged, round(5 * 3 * count(*) FILTER (n >= 200 AND NOT label) + coalesce(sum(amount) FILTER (n < 200 AND label), 0) + 15 * count(*) FILTER (n < 200 AND label), 0) AS cost FROM r")
def ring_costs(spark, sf_dir):
    """Costs with a ring as the unit: reviewing one takes five times a row's review."""
    r = _shapes(spark, sf_dir).select("snapshot_end", "ring", F.col("exposed_amount").alias("amount"), "label", F.col("exposed_flows").alias("score"))
    return costs.at_threshold(r, 200, costs.ring_model()).select("n", "flagged", F.round("cost", 0).alias("cost"))


@query(f"WITH {S}, v(model, review, fee) AS (VALUES ('base', 3::DOUBLE, 15::DOUBLE), ('double_fee', 3, 30), ('dear_review', 30, 15)) SELECT model, id, line, score * (amount + fee) - review * (1 - score) AS saving FROM s, v")
def variant_costs(spark, sf_dir):
    s = tables.scored(spark, sf_dir)
    variants = {"base": costs.CostModel(3.0, 15.0), "double_fee": costs.CostModel(3.0, 30.0), "dear_review": costs.CostModel(30.0, 15.0)}
    pairs = F.array(*[F.struct(F.lit(n).alias("model"), costs.expected_costs(F.col("score"), F.col("amount"), m)["saving"].alias("saving")) for n, m in variants.items()])
    return s.select("id", "line", F.explode(pairs).alias("p")).select("p.model", "id", "line", "p.saving")


@query(f"WITH {O}, {_CUT}, b AS (SELECT *, amount / 600000 AS score FROM sp WHERE split <> 'test'), g AS (SELECT split, score, count(*) AS n, count(*) FILTER (is_fraud) AS tp FROM b GROUP BY 1, 2), c AS (SELECT *, sum(n) OVER (PARTITION BY split ORDER BY score DESC) AS cn, sum(tp) OVER (PARTITION BY split ORDER BY score DESC) AS ct FROM g) SELECT split, round(sum(tp * ct / cn) / sum(tp), 5) AS average_precision FROM c GROUP BY 1")
def fold_handicap(spark, sf_dir):
    """A metric per fold, side by side: what a model of less history lacks."""
    o = assign_splits(tables.orders(spark, sf_dir)).filter("split <> 'test'").withColumns({"score": F.col("amount") / 600000, "label": F.col("is_fraud")})
    return metrics.average_precision(o, by=("split",)).select("split", F.round("average_precision", 5).alias("average_precision"))


@query(f"WITH {S}, c AS (SELECT 'other' AS config, corr(other, CAST(label AS INT)) AS metric FROM s UNION ALL SELECT 'score', corr(score, CAST(label AS INT)) FROM s UNION ALL SELECT 'amount', corr(amount, CAST(label AS INT)) FROM s), r AS (SELECT *, row_number() OVER (ORDER BY metric DESC, config) AS n FROM c) SELECT max(config) FILTER (n = 1) AS winner, round(max(metric) FILTER (n = 1), 6) AS metric, max(config) FILTER (n = 2) AS runner_up, round(max(metric) FILTER (n = 2), 6) AS next_metric FROM r")
def winner_and_next(spark, sf_dir):
    y = metrics.hits()
    configs = tables.scored(spark, sf_dir).agg(F.array(*[F.struct(F.lit(c).alias("config"), F.corr(c, y).alias("metric")) for c in ("amount", "other", "score")]).alias("a")).select(F.explode("a").alias("r")).select("r.*")
    return rounded(findings.winner(configs))


@query(f"WITH RECURSIVE {_CC}, {_DEG}, l AS (SELECT max(snapshot_end) AS e FROM kept) SELECT kept.* FROM kept, l WHERE snapshot_end = e")
def served_rings(spark, sf_dir):
    m, _ = _rings(spark, sf_dir)
    seen = _members(spark, sf_dir).select("snapshot_end", F.col("src").alias("node"))
    return findings.frozen(m, seen)["rings"].select("snapshot_end", "node", "ring")


_TOKEN = "substr(sha256(unhex(o) || unhex(sha256(unhex(i) || encode({})))), 1, 16)"
_PADS = f"pads AS (SELECT '{bytes(b ^ 0x36 for b in _KEY.ljust(64, bytes(1))).hex()}' AS i, '{bytes(b ^ 0x5C for b in _KEY.ljust(64, bytes(1))).hex()}' AS o)"


@query(f"WITH RECURSIVE {_CC}, {_DEG}, {_PADS} SELECT ed.snapshot_end, {_TOKEN.format('k.ring')} AS ring, {_TOKEN.format('u')} AS u, {_TOKEN.format('v')} AS v, flow_count FROM ed JOIN kept k ON k.snapshot_end = ed.snapshot_end AND k.node = ed.u, pads")
def ring_topology(spark, sf_dir):
    m, e = _rings(spark, sf_dir)
    return findings.topology(e, m, lambda c: edges.keyed_hash(c, _KEY)).select("snapshot_end", "ring", "u", "v", "flow_count")


@query(f"WITH RECURSIVE {_CC}, {_DEG}, {_FEAT} SELECT kept.* FROM kept JOIN ft USING (snapshot_end, ring) WHERE density < 0.05")
def restricted_rows(spark, sf_dir):
    m, _ = _rings(spark, sf_dir)
    some = _shapes(spark, sf_dir).filter("density < 0.05").select("snapshot_end", "ring")
    return findings.restricted(m, m.join(some, ["snapshot_end", "ring"])).select("snapshot_end", "node", "ring")


@query(f"WITH RECURSIVE {_CC}, {_DEG}, {_FEAT}, q AS (SELECT o_orderkey AS transaction_id, 'c' || o_custkey AS node, epoch_us(o_orderdate) // {CADENCE} * {CADENCE} AS e FROM orders) SELECT transaction_id, round(size * density, 5) AS ring_score, e NOT IN (SELECT snapshot_end FROM kept) AS degraded FROM q LEFT JOIN kept k ON k.snapshot_end = e AND k.node = q.node LEFT JOIN ft ON ft.snapshot_end = e AND ft.ring = k.ring")
def ring_lookup(spark, sf_dir):
    """Orders with their account's ring score at the snapshot that serves them; none before the first."""
    m, _ = _rings(spark, sf_dir)
    f = _shapes(spark, sf_dir).select("snapshot_end", "ring", F.round(F.col("size") * F.col("density"), 5).alias("score"))
    asked = tables.orders(spark, sf_dir).select("transaction_id", F.concat(F.lit("c"), F.col("account_id").cast("string")).alias("account_id"), (F.floor(F.col("us") / CADENCE) * CADENCE).alias("snapshot_end"))
    return findings.with_ring(asked, m.join(f, ["snapshot_end", "ring"]), m).select("transaction_id", "ring_score", "degraded")
