from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.operators import costs
from riskloom.sources import tables

from .base import CURVE, O, S, query, rounded

_PRICE = "(SELECT sum(tp) AS all_tp, sum(amt) AS all_amt FROM g)"
_COST = f"{CURVE}, z AS (SELECT score AS threshold, cum_n AS flagged, cum_amt AS caught, {{review}} * (cum_n - cum_tp) + all_amt - cum_amt + {{fee}} * (all_tp - cum_tp) AS cost FROM c, {_PRICE} UNION ALL SELECT 'inf'::DOUBLE, 0, 0, all_amt + {{fee}} * all_tp FROM {_PRICE})"


@query(f"WITH {_COST.format(review=3, fee=15)} SELECT round(CASE WHEN isinf(threshold) THEN 2 ELSE threshold END, 6) AS threshold, flagged::BIGINT AS flagged, round(caught, 2) AS caught, round(cost, 2) AS cost FROM z")
def cost_curve(spark, sf_dir):
    c = costs.cost_curve(tables.scored(spark, sf_dir))
    return c.select(F.round(F.when(F.col("threshold") == float("inf"), 2.0).otherwise(F.col("threshold")), 6).alias("threshold"), "flagged", F.round("caught", 2).alias("caught"), F.round("cost", 2).alias("cost"))


@query(f"WITH {S}, f AS (SELECT count(*) AS n, count(*) FILTER (score >= 0.8) AS flagged, count(*) FILTER (score >= 0.8 AND NOT label) AS fp, count(*) FILTER (score < 0.8 AND label) AS fn, coalesce(sum(amount) FILTER (score < 0.8 AND label), 0) AS missed, coalesce(sum(amount) FILTER (score >= 0.8 AND label), 0) AS caught FROM s) SELECT n, flagged, round(flagged / n, 4) AS flag_rate, round(3 * fp + missed + 15 * fn, 2) AS cost, round(1000 * (3 * fp + missed + 15 * fn) / n, 2) AS cost_per_1000, round(caught / (caught + missed), 4) AS value_recall FROM f")
def cost_at_threshold(spark, sf_dir):
    c = costs.at_threshold(tables.scored(spark, sf_dir), 0.8)
    return c.select("n", "flagged", F.round("flag_rate", 4).alias("flag_rate"), F.round("cost", 2).alias("cost"), F.round("cost_per_1000", 2).alias("cost_per_1000"), F.round("value_recall", 4).alias("value_recall"))


_GRID = [(3.0, 15.0), (1500.0, 7.5), (3000.0, 22.5), (20000.0, 15.0), (50000.0, 500.0)]


@query("WITH " + CURVE + f", grid(review, fee) AS (VALUES {', '.join(f'({a}::DOUBLE, {b}::DOUBLE)' for a, b in _GRID)}), z AS (SELECT review, fee, score AS threshold, cum_n AS flagged, review * (cum_n - cum_tp) + all_amt - cum_amt + fee * (all_tp - cum_tp) AS cost FROM c, {_PRICE}, grid UNION ALL SELECT review, fee, 9, 0, all_amt + fee * all_tp FROM {_PRICE}, grid), r AS (SELECT *, row_number() OVER (PARTITION BY review, fee ORDER BY round(cost, 6), flagged) AS n FROM z) SELECT review, fee, threshold, round(cost, 2) AS cost, flagged::BIGINT AS flagged FROM r WHERE n = 1")
def cost_sensitivity(spark, sf_dir):
    c = costs.sensitivity(tables.scored(spark, sf_dir), _GRID)
    return c.select("review", "fee", F.when(F.col("threshold") == float("inf"), 9.0).otherwise(F.col("threshold")).alias("threshold"), F.round("cost", 2).alias("cost"), "flagged")


@query(f"WITH {_COST.format(review=20000, fee=15)} SELECT threshold, round(cost, 2) AS cost, flagged::BIGINT AS flagged FROM z ORDER BY round(cost, 6), flagged LIMIT 1")
def cost_threshold(spark, sf_dir):
    return costs.cheapest(costs.cost_curve(tables.scored(spark, sf_dir), costs.CostModel(20000.0, 15.0))).select("threshold", F.round("cost", 2).alias("cost"), "flagged")


@query(f"WITH {S}, q AS (SELECT quantile_cont(score, 0.99) AS q FROM s) SELECT min(score) AS threshold, round(any_value(q), 6) AS quantile, count(*) AS flagged FROM s, q WHERE score > q")
def flag_rate_threshold(spark, sf_dir):
    return rounded(costs.capacity_threshold(tables.scored(spark, sf_dir), 0.01))


@query(f"WITH {CURVE} SELECT max(score) AS threshold FROM c WHERE cum_tp >= 0.8 * (SELECT sum(tp) FROM g)")
def recall_threshold(spark, sf_dir):
    return costs.recall_threshold(tables.scored(spark, sf_dir), 0.8)


@query(f"WITH {_COST.format(review=20000, fee=15)}, q AS (SELECT min(score) AS cap FROM s WHERE score > (SELECT quantile_cont(score, 0.95) FROM s)), b AS (SELECT threshold AS t FROM z ORDER BY round(cost, 6), flagged LIMIT 1) SELECT t AS cost_threshold, cap AS capacity_threshold, greatest(t, cap) AS threshold, CASE WHEN t >= cap THEN 'cost' ELSE 'capacity' END AS reason FROM b, q")
def threshold_choice(spark, sf_dir):
    return costs.chosen_threshold(tables.scored(spark, sf_dir), 0.05, costs.CostModel(20000.0, 15.0))


@query(f"WITH {CURVE} SELECT min(score) AS threshold, max(cum_n)::BIGINT AS flagged FROM c WHERE cum_n >= 50 AND cum_tp >= 0.3 * cum_n")
def block_threshold(spark, sf_dir):
    return costs.block_threshold(tables.scored(spark, sf_dir), 0.3)


@query(f"WITH {S}, p AS (SELECT 'probability' AS policy, score AS r, label, amount FROM s UNION ALL SELECT 'plug_in', score * (amount + 15) - 3 * (1 - score), label, amount FROM s), q AS (SELECT policy, quantile_cont(r, 0.95) AS q FROM p GROUP BY 1) SELECT policy, count(*) FILTER (r > q) AS flagged, round(1000 * sum(CASE WHEN r > q AND NOT label THEN 3 WHEN NOT r > q AND label THEN amount + 15 ELSE 0 END) / count(*), 2) AS cost_per_1000, round(sum(amount) FILTER (r > q AND label) / sum(amount) FILTER (label), 6) AS value_recall FROM p JOIN q USING (policy) GROUP BY 1")
def policy_compare(spark, sf_dir):
    p, a = F.col("score"), F.col("amount")
    out = costs.compare_policies(tables.scored(spark, sf_dir), {"probability": p, "plug_in": costs.expected_costs(p, a)["saving"]}, 0.05)
    return out.select("policy", "flagged", F.round("cost_per_1000", 2).alias("cost_per_1000"), F.round("value_recall", 6).alias("value_recall"))


@query(f"WITH {S} SELECT id, line, round(3 * (1 - score), 6) AS cost_blocked, round(score * (amount + 15), 6) AS cost_allowed, round(3 / (3 + amount + 15), 9) AS break_even, round(score * (amount + 15) - 3 * (1 - score), 6) AS saving, CASE WHEN score >= 0.9 THEN 'block' WHEN score >= 0.6 THEN 'review' ELSE 'allow' END AS decision FROM s")
def decision_costs(spark, sf_dir):
    df, p = tables.scored(spark, sf_dir), F.col("score")
    c = costs.expected_costs(p, F.col("amount"))
    return df.select("id", "line", F.round(c["cost_blocked"], 6).alias("cost_blocked"), F.round(c["cost_allowed"], 6).alias("cost_allowed"), F.round(c["break_even"], 9).alias("break_even"), F.round(c["saving"], 6).alias("saving"), costs.decision(p, 0.6, 0.9).alias("decision"))


@query(f"WITH {S}, e AS (SELECT *, CASE WHEN score >= 0.6 AND NOT label THEN 'false_positive' WHEN score < 0.6 AND label THEN 'false_negative' END AS kind FROM s), r AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY amount DESC, id, line) AS nth FROM e WHERE kind IS NOT NULL) SELECT kind, nth, id, line, amount FROM r WHERE nth <= 5")
def audit_extremes(spark, sf_dir):
    return costs.extremes(tables.scored(spark, sf_dir), 0.6).select("kind", "nth", "id", "line", "amount")


_LOG = "CASE WHEN o_orderstatus = 'O' THEN 'allow' ELSE 'block' END AS action, CASE WHEN o_totalprice > 250000 THEN 'block' ELSE 'allow' END AS target, 0.2 + 0.6 * o_totalprice / 600000 AS propensity, CASE WHEN o_orderstatus = 'F' THEN o_totalprice / 1000 ELSE 3 END AS loss, CASE WHEN o_totalprice > 250000 THEN 3 ELSE o_totalprice / 4000 END AS model_target, CASE WHEN o_orderstatus = 'O' THEN o_totalprice / 4000 ELSE 3 END AS model_logged"


@query(f"WITH l AS (SELECT {_LOG} FROM orders), w AS (SELECT *, CAST(action = target AS INT) / greatest(propensity, 0.001) AS w FROM l) SELECT round(avg(model_target), 6) AS direct, round(avg(w * loss), 6) AS ipw, round(avg(model_target + w * (loss - model_logged)), 6) AS doubly_robust, round(avg(loss), 6) AS logged, round(min(propensity), 6) AS least_propensity, round(max(propensity), 6) AS greatest_propensity, round(avg(CAST(action = target AS INT)), 6) AS match_rate FROM w")
def off_policy(spark, sf_dir):
    o = tables.table(spark, sf_dir, "orders")
    opened, dear, price = F.col("o_orderstatus") == "O", F.col("o_totalprice") > 250000, F.col("o_totalprice")
    logged = o.select(F.when(opened, "allow").otherwise("block").alias("action"), F.when(dear, "block").otherwise("allow").alias("target"), (0.2 + 0.6 * price / 600000).alias("propensity"), F.when(F.col("o_orderstatus") == "F", price / 1000).otherwise(3.0).alias("loss"), F.when(dear, 3.0).otherwise(price / 4000).alias("model_target"), F.when(opened, price / 4000).otherwise(3.0).alias("model_logged"))
    return rounded(costs.off_policy(logged))


@query(f"WITH {O} SELECT round(sum(CASE WHEN amount > 300000 AND NOT is_fraud THEN 3 WHEN NOT amount > 300000 AND is_fraud THEN amount + 15 ELSE 0 END), 2) AS loss, round(quantile_cont(amount, 0.5) / 100, 4) AS scaled_review FROM o")
def realised_loss(spark, sf_dir):
    o = tables.orders(spark, sf_dir)
    loss = costs.realised_loss(F.col("amount") > 300000, F.col("is_fraud"), F.col("amount"))
    return o.agg(F.round(F.sum(loss), 2).alias("loss"), F.round(F.percentile("amount", F.lit(0.5)) / 100, 4).alias("scaled_review"))


@query(f"WITH {_COST.format(review=20000, fee=15)}, q AS (SELECT min(score) AS cap FROM s WHERE score > (SELECT quantile_cont(score, 0.8) FROM s)), b AS (SELECT threshold AS t FROM z ORDER BY round(cost, 6), flagged LIMIT 1), v AS (SELECT greatest(t, cap) AS r, CASE WHEN t >= cap THEN 'cost' ELSE 'capacity' END AS reason FROM b, q), bl AS (SELECT min(score) AS bt FROM c, v WHERE score >= r AND cum_n >= 50 AND cum_tp >= 0.26 * cum_n) SELECT r AS review_threshold, reason, bt AS block_threshold, (SELECT count(*) FROM s, v v2 WHERE score >= v2.r) AS at_review, (SELECT count(*) FROM s, bl b2 WHERE score >= b2.bt) AS at_block FROM v, bl")
def operating_points(spark, sf_dir):
    """A block threshold that lies within the reviewed rows, whatever precision lower ones would have."""
    return costs.operating_points(tables.scored(spark, sf_dir), 0.2, 0.26, 50, costs.CostModel(20000.0, 15.0))


_POLICIES = "p AS (SELECT 'probability' AS policy, score AS r, label, amount FROM s UNION ALL SELECT 'plug_in', score * (amount + 15) - 20000 * (1 - score), label, amount FROM s UNION ALL SELECT 'amount', amount, label, amount FROM s)"


@query(f"""WITH {S}, {_POLICIES}, g AS (SELECT policy, r, count(*) AS n, count(*) FILTER (label) AS tp, sum(CASE WHEN label THEN amount ELSE 0 END) AS amt FROM p GROUP BY 1, 2), c AS (SELECT policy, r, sum(n) OVER w AS flagged, sum(tp) OVER w AS tp, sum(amt) OVER w AS caught FROM g WINDOW w AS (PARTITION BY policy ORDER BY r DESC) UNION ALL SELECT policy, 'inf'::DOUBLE, 0, 0, 0 FROM g GROUP BY policy),
  a AS (SELECT policy, sum(tp) AS all_tp, sum(amt) AS all_amt, sum(n) AS n FROM g GROUP BY 1), z AS (SELECT c.*, n, 20000 * (flagged - tp) + all_amt - caught + 15 * (all_tp - tp) AS cost FROM c JOIN a USING (policy)), o AS (SELECT policy, flagged FROM z QUALIFY row_number() OVER (PARTITION BY policy ORDER BY round(cost, 6), flagged) = 1),
  l AS (SELECT policy, 'cap_' || rate AS point, rate::DOUBLE * n AS most FROM a, (VALUES ('0.01'), ('0.05'), ('0.2')) v(rate) UNION ALL SELECT a.policy, 'matched', (SELECT flagged FROM o WHERE policy = 'probability') FROM a), w AS (SELECT policy, point, max(flagged) AS flagged FROM z JOIN l USING (policy) WHERE flagged <= most GROUP BY 1, 2 UNION ALL SELECT policy, 'optimum', flagged FROM o)
  SELECT policy, point, round(CASE WHEN isinf(r) THEN 1e9 ELSE r END, 6) AS threshold, flagged::BIGINT AS flagged, round(cost, 2) AS cost, round(caught, 2) AS caught FROM w JOIN z USING (policy, flagged)""")
def policy_rates(spark, sf_dir):
    """Three ranking scores at shared flag rates, each at its own optimum, and at the rate of the probability's optimum."""
    p, a, m = F.col("score"), F.col("amount"), costs.CostModel(20000.0, 15.0)
    out = costs.policy_table(tables.scored(spark, sf_dir), {"probability": p, "plug_in": p * (a + 15) - 20000 * (1 - p), "amount": a}, (0.01, 0.05, 0.2), "probability", m)
    return out.select("policy", "point", F.round(F.when(F.col("threshold") == float("inf"), 1e9).otherwise(F.col("threshold")), 6).alias("threshold"), "flagged", F.round("cost", 2).alias("cost"), F.round("caught", 2).alias("caught"))


_ACT = "SELECT *, score + 0.2 * other > 0.6 AS blocked, score > 0.5 AS target, 0.1 + 0.8 * other AS propensity, 3 * (1 - score) AS cb, score * (amount + 15) AS ca FROM s"


@query(f"WITH {S}, l AS ({_ACT}), x AS (SELECT CASE WHEN target AND NOT label THEN 3 WHEN NOT target AND label THEN amount + 15 ELSE 0 END AS truth, CASE WHEN blocked AND NOT label THEN 3 WHEN NOT blocked AND label THEN amount + 15 ELSE 0 END AS seen, CASE WHEN target THEN cb ELSE ca END AS dt, CASE WHEN blocked THEN cb ELSE ca END AS dl, CASE WHEN blocked = target THEN 1 / greatest(propensity, 0.001) ELSE 0 END AS w, propensity FROM l), m AS (SELECT avg(truth) AS truth, avg(dt) AS direct, avg(w * seen) AS weighted, avg(dt + w * (seen - dl)) AS dr, avg(CAST(propensity <= 0.001 AS INT)) <= 0.01 AS positivity FROM x), e AS (SELECT 'direct' AS estimator, direct AS estimate, truth, positivity FROM m UNION ALL SELECT 'weighted', weighted, truth, positivity FROM m UNION ALL SELECT 'doubly_robust', dr, truth, positivity FROM m) SELECT estimator, round(estimate, 4) AS estimate, round(truth, 4) AS truth, round((estimate - truth) / truth, 6) AS relative_bias, positivity FROM e")
def off_policy_truth(spark, sf_dir):
    """Three estimates of a policy's cost from decisions of another, and how far each is from what it would have cost."""
    s, p = tables.scored(spark, sf_dir), F.col("score")
    c = costs.expected_costs(p, F.col("amount"))
    logged = s.withColumns({"blocked": p + 0.2 * F.col("other") > 0.6, "target": p > 0.5, "propensity": 0.1 + 0.8 * F.col("other"), "cost_blocked": c["cost_blocked"], "cost_allowed": c["cost_allowed"]})
    return costs.off_policy_report(logged).select("estimator", F.round("estimate", 4).alias("estimate"), F.round("truth", 4).alias("truth"), F.round("relative_bias", 6).alias("relative_bias"), "positivity")
