from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.operators import costs, metrics
from riskloom.sources import tables

from .base import CURVE, query, rounded, S, SN


@query(f"WITH {S}, c AS (SELECT band, count(*) FILTER (score >= 0.6 AND label) AS tp, count(*) FILTER (score >= 0.6 AND NOT label) AS fp, count(*) FILTER (score < 0.6 AND label) AS fn, count(*) FILTER (score < 0.6 AND NOT label) AS tn FROM s GROUP BY band), p AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0) AS recall FROM c) SELECT band, tp, fp, fn, tn, round(precision, 6) AS precision, round(recall, 6) AS recall, round(coalesce(2 * precision * recall / nullif(precision + recall, 0), 0), 6) AS f1 FROM p")
def confusion(spark, sf_dir):
    return rounded(metrics.confusion(tables.scored(spark, sf_dir), 0.6, by=("band",)))


@query(f"WITH {CURVE} SELECT score, n, tp::BIGINT AS tp, cum_n::BIGINT AS cum_n, cum_tp::BIGINT AS cum_tp FROM c")
def threshold_curve(spark, sf_dir):
    return metrics.curve(tables.scored(spark, sf_dir))


@query(f"WITH {CURVE} SELECT round(sum(tp * cum_tp / cum_n) / sum(tp), 6) AS average_precision, round(sum(tp) / sum(n), 6) AS base_rate FROM c")
def average_precision(spark, sf_dir):
    return rounded(metrics.average_precision(tables.scored(spark, sf_dir)))


@query(f"WITH {S}, g AS (SELECT band, score, count(*) AS n, count(*) FILTER (label) AS tp FROM s GROUP BY band, score), c AS (SELECT *, sum(n) OVER (PARTITION BY band ORDER BY score DESC) AS cum_n, sum(tp) OVER (PARTITION BY band ORDER BY score DESC) AS cum_tp FROM g) SELECT band, round(sum(tp * cum_tp / cum_n) / sum(tp), 6) AS average_precision, round(sum(tp) / sum(n), 6) AS base_rate FROM c GROUP BY band")
def banded_precision(spark, sf_dir):
    return rounded(metrics.average_precision(tables.scored(spark, sf_dir), by=("band",)))


@query(f"WITH {CURVE}, d AS (SELECT *, row_number() OVER (ORDER BY score DESC) - 1 AS position, count(*) OVER () AS k, sum(tp) OVER () AS all_tp FROM c), w AS (SELECT DISTINCT CAST(floor(i * (k - 1) / 199) AS BIGINT) AS position FROM range(200) r(i), (SELECT count(*) AS k FROM c)) SELECT position, score, round(cum_tp / cum_n, 6) AS precision, round(cum_tp / all_tp, 6) AS recall FROM d SEMI JOIN w USING (position)")
def pr_curve(spark, sf_dir):
    return rounded(metrics.pr_points(tables.scored(spark, sf_dir)))


@query(f"WITH {S}, g AS (SELECT score, count(*) FILTER (label) AS pos, count(*) FILTER (NOT label) AS neg FROM s GROUP BY score), c AS (SELECT *, sum(neg) OVER (ORDER BY score) AS cum FROM g) SELECT round(sum(pos * (cum - neg + neg / 2)) / (sum(pos) * sum(neg)), 6) AS rank_auc FROM c")
def rank_auc(spark, sf_dir):
    return rounded(metrics.rank_auc(tables.scored(spark, sf_dir)))


@query(f"WITH {S}, r AS (SELECT rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2 AS a, rank() OVER (ORDER BY other) + (count(*) OVER (PARTITION BY other) - 1) / 2 AS b FROM s) SELECT round(corr(a, b), 6) AS spearman FROM r")
def spearman(spark, sf_dir):
    return rounded(metrics.spearman(tables.scored(spark, sf_dir), "score", "other"))


@query(f"WITH {S} SELECT id, line, band, round((rank() OVER (PARTITION BY band ORDER BY score) + (count(*) OVER (PARTITION BY band, score) - 1) / 2 - 1) / greatest(count(*) OVER (PARTITION BY band) - 1, 1), 6) AS normalised FROM s")
def rank_normalise(spark, sf_dir):
    return rounded(metrics.rank_normalised(tables.scored(spark, sf_dir), "score", "band").select("id", "line", "band", "normalised"))


@query(f"WITH {S} SELECT CAST(least(floor(score * 10), 9) AS INT) AS bin, count(*) AS n, round(avg(score), 6) AS mean_p, round(avg(CAST(label AS INT)), 6) AS rate FROM s GROUP BY 1")
def calibration(spark, sf_dir):
    return rounded(metrics.calibration(tables.scored(spark, sf_dir)))


@query(f"WITH {S}, b AS (SELECT least(floor(score * 10), 9) AS bin, count(*) AS n, avg(score) AS p, avg(CAST(label AS INT)) AS r FROM s GROUP BY 1) SELECT round((SELECT sum(n * abs(p - r)) / sum(n) FROM b), 6) AS ece, round((SELECT avg((score - CAST(label AS INT)) ** 2) FROM s), 6) AS brier")
def calibration_errors(spark, sf_dir):
    return rounded(metrics.calibration_errors(tables.scored(spark, sf_dir)))


@query(f"WITH {S} SELECT band, {', '.join(f'round(quantile_cont(score, {q}), 6) AS q{int(100 * q):02d}' for q in (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99))} FROM s GROUP BY band")
def score_quantiles(spark, sf_dir):
    return rounded(metrics.quantile_table(tables.scored(spark, sf_dir), "band", "score"))


_WEIGHT = " + ".join(f"CAST(u >= {c} AS INT)" for c in metrics.STEPS)
_MIX = "(xor(h, h >> 16) * 73244475) % 4294967296"
_BOOT = f"""{SN}, h0 AS (SELECT sn.*, r AS replicate, (row % 2147483648 * 1000003 + r * 7919 + 12345) % 4294967296 AS h FROM sn, range(1000) t(r)), h1 AS (SELECT * REPLACE ({_MIX} AS h) FROM h0), h2 AS (SELECT * REPLACE ({_MIX} AS h) FROM h1), d AS (SELECT *, xor(h, h >> 16) / 4294967296.0::DOUBLE AS u FROM h2), w AS MATERIALIZED (SELECT replicate, score, other, label, amount, {_WEIGHT} AS w FROM d),
  st AS (SELECT replicate, sum(w) FILTER (label) AS wp, sum(w) FILTER (NOT label) AS wn FROM w GROUP BY 1), tot AS (SELECT count(*) FILTER (label) AS p, count(*) FILTER (NOT label) AS n FROM s)"""


def _boot(score: str) -> str:
    up, down = "ct * p / wp", "cn * n / wn"
    loss = f"CASE WHEN {score} > t AND NOT label THEN 3 WHEN NOT {score} > t AND label THEN amount + 15 ELSE 0 END"
    return f"""g_{score} AS (SELECT replicate, {score} AS v, sum(CASE WHEN label THEN w ELSE 0 END) AS tp, sum(CASE WHEN label THEN 0 ELSE w END) AS fp FROM w GROUP BY 1, 2), c_{score} AS (SELECT *, sum(tp) OVER (PARTITION BY replicate ORDER BY v DESC) AS ct, sum(fp) OVER (PARTITION BY replicate ORDER BY v DESC) AS cn FROM g_{score}),
  a_{score} AS (SELECT replicate, sum(CASE WHEN tp > 0 THEN tp * ({up}) / ({up} + {down}) ELSE 0 END) / min(wp) AS ap FROM c_{score} JOIN st USING (replicate), tot GROUP BY 1), q_{score} AS (SELECT quantile_cont({score}, 0.95) AS t FROM s), k_{score} AS (SELECT replicate, 1000 * sum(w * {loss} * CASE WHEN label THEN p / wp ELSE n / wn END) / min(p + n) AS cost, sum(CASE WHEN {score} > t AND label THEN w * amount ELSE 0 END) / sum(CASE WHEN label THEN w * amount ELSE 0 END) AS recall FROM w JOIN st USING (replicate), tot, q_{score} GROUP BY 1)"""


@query(f"WITH {_BOOT}, {_boot('score')}, {_boot('other')} SELECT replicate, round(a_score.ap, 6) AS ap_score, round(a_other.ap, 6) AS ap_other, round(k_score.cost, 1) AS cost_score, round(k_other.cost, 1) AS cost_other, round(k_score.recall, 6) AS recall_score, round(k_other.recall, 6) AS recall_other FROM a_score JOIN a_other USING (replicate) JOIN k_score USING (replicate) JOIN k_other USING (replicate)")
def paired_bootstrap(spark, sf_dir):
    out = rounded(metrics.bootstrap(tables.numbered(spark, sf_dir), ["row"], 1000, ("score", "other"), 0.05))
    return out.withColumns({c: F.round(c, 1) for c in ("cost_score", "cost_other")})


_DELTAS = (("average_precision", "ap"), ("cost_per_1000", "cost"), ("value_recall", "recall"))


@query(f"WITH {_BOOT}, {_boot('score')}, {_boot('other')}, dl AS (SELECT a_score.ap - a_other.ap AS ap, k_score.cost - k_other.cost AS cost, k_score.recall - k_other.recall AS recall FROM a_score JOIN a_other USING (replicate) JOIN k_score USING (replicate) JOIN k_other USING (replicate)), i AS (" + " UNION ALL ".join(f"SELECT '{n}' AS metric, quantile_cont({c}, 0.025) AS lo, quantile_cont({c}, 0.975) AS hi, avg({c}) AS mean FROM dl" for n, c in _DELTAS) + ") SELECT metric, round(lo, 4) AS lo, round(hi, 4) AS hi, round(mean, 4) AS mean, CASE WHEN lo <= 0 AND hi >= 0 THEN 'TIE' WHEN lo > 0 THEN 'BETTER' ELSE 'WORSE' END AS verdict FROM i")
def bootstrap_verdict(spark, sf_dir):
    """Paired differences of two scores; for costs the sign of BETTER is that of the difference, more being dearer."""
    both = metrics.cut(metrics.bootstrap(tables.numbered(spark, sf_dir), ["row"], 1000, ("score", "other"), 0.05), "replicates")
    out = None
    for name, c in _DELTAS:
        row = metrics.interval(both.withColumn("delta", F.col(f"{c}_score") - F.col(f"{c}_other")), "delta").withColumn("metric", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return rounded(out, 4)


@query(f"WITH {SN}, k AS (SELECT CAST(floor(count(*) * 0.1) AS INT) AS k, avg(CAST(label AS INT)) AS b FROM s), o AS (SELECT label, row_number() OVER (ORDER BY score DESC, row) AS n FROM sn), p AS (SELECT avg(CAST(label AS INT)) AS p FROM o, k WHERE n <= k) SELECT round(p, 6) AS precision_at_k, round(b, 6) AS base_rate, round(p / b, 6) AS lift, k FROM p, k")
def enrichment(spark, sf_dir):
    return rounded(metrics.top_k_precision(tables.numbered(spark, sf_dir), 0.1, id_="row"))


@query(f"WITH {CURVE}, x AS (SELECT (SELECT round(sum(tp * cum_tp / cum_n) / sum(tp), 6) FROM c) AS average_precision), f AS (SELECT count(*) AS n, count(*) FILTER (score >= 0.7) AS flagged, count(*) FILTER (score >= 0.7 AND NOT label) AS fp, count(*) FILTER (score < 0.7 AND label) AS fn, sum(amount) FILTER (score < 0.7 AND label) AS missed, sum(amount) FILTER (score >= 0.7 AND label) AS caught, avg(CAST(label AS INT)) AS base_rate FROM s) SELECT average_precision, round(base_rate, 6) AS base_rate, flagged, round(1000 * (3 * fp + missed + 15 * fn) / n, 2) AS cost_per_1000, round(caught / (caught + missed), 6) AS value_recall, average_precision > 0.95 AS suspicious FROM x, f")
def evaluation_row(spark, sf_dir):
    df = tables.scored(spark, sf_dir)
    ap, cost = metrics.average_precision(df), costs.at_threshold(df, 0.7)
    out = rounded(ap).crossJoin(cost.select("flagged", F.round("cost_per_1000", 2).alias("cost_per_1000"), F.round("value_recall", 6).alias("value_recall")))  # one row each
    return out.withColumn("suspicious", F.col("average_precision") > 0.95)
