from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.functions.shared import cut
from riskloom.operators import folds, history, metrics, models, rings, splits
from riskloom.sources import tables

from .base import O, query, rounded
from .graph import _reference, _rings, _shapes
from .splits import _CUT

FEATURES = ["amount_log", "gap_log", "hour_sin", "hour_cos", "count_24h_log", "sum_24h_log", "has_prior"]


def _rows(spark, sf_dir):
    t = tables.events(spark, sf_dir)
    steps = history.timestep_features(t).drop("account_id", "us")
    return t.join(steps, "transaction_id")


@query()
def row_scorer(spark, sf_dir):
    df = splits.assign_splits(_rows(spark, sf_dir))
    m = models.boosted_trees(df.filter("split = 'train'"), df.filter("split = 'val'"), FEATURES)
    return rounded(models.probability(m, df.filter("split = 'test'"), FEATURES).select("transaction_id", "score"))


@query()
def isolation_scorer(spark, sf_dir):
    df = _rows(spark, sf_dir)
    forest = models.isolation_forest(df, FEATURES, trees=200)
    return rounded(models.isolation_scores(df, forest, FEATURES).select("transaction_id", "isolation"))


@query()
def platt_calibration(spark, sf_dir):
    s = tables.scored(spark, sf_dir)
    fitted = models.platt(s)
    return rounded(s.select("id", "line", models.calibrated(F.col("score"), fitted).alias("calibrated")))


@query()
def ring_scorer(spark, sf_dir):
    m, _ = _rings(spark, sf_dir)
    f = _shapes(spark, sf_dir).drop("label", "exposed_flows", "exposed_amount")
    bad = rings.overlaps(m, _reference(spark, sf_dir)).filter("overlap >= 0.5").select("snapshot_end", F.col("a").alias("ring")).distinct().withColumn("label", F.lit(True))
    rows = f.join(bad, ["snapshot_end", "ring"], "left").withColumn("label", F.coalesce("label", F.lit(False)))
    scored, _ = models.ring_scorer(rows, ["size", "density", "max_degree", "mean_degree", "flows"])
    return rounded(scored.select("snapshot_end", "ring", "label", "score"), 4)


@query()
def expected_loss(spark, sf_dir):
    df = _rows(spark, sf_dir).withColumn("loss", F.when(F.col("is_fraud"), F.col("amount")).otherwise(0.0))
    # every iteration of the fit reads its rows, so they are made once
    df = cut(df.select("transaction_id", "loss", *FEATURES), "rows")
    m = models.expected_loss(df, FEATURES, "loss")
    return m.transform(models.assembled(df, FEATURES)).select("transaction_id", F.round("prediction", 3).alias("expected_loss"))


def _trees(rows, features):
    """Boosted trees as a function that adds their probability under a name; nothing a fold may see could stop it early."""
    m = models.boosted_trees(rows, None, features, 5)
    return lambda df, name: models.probability(m, df, features, name)


@query()
def out_of_fold(spark, sf_dir):
    """Boosted trees by folds, each with its own spec; the first block has no score."""
    df = splits.assign_splits(cut(_rows(spark, sf_dir), "rows")).withColumn("label", F.col("is_fraud"))
    f = folds.forward_chained(df.filter("split = 'train'"), df.filter("split = 'val'"), [*FEATURES, "device"], _trees, 4, "transaction_id", ("transaction_type",), 8, scores_only=True)
    return rounded(f.scores.select("transaction_id", "block", "raw", "normalised"))


@query()
def cross_fitted_calibration(spark, sf_dir):
    s = tables.scored(spark, sf_dir)
    halves = s.withColumn("late", F.col("at") >= F.lit("1998-06-01").cast("timestamp_ntz"))
    out = models.cross_fitted(halves.filter("NOT late"), halves.filter("late"))
    return rounded(metrics.calibration(out, "calibrated"))


def _rates(rows, features):
    """A model that SQL can repeat: the fraud rate of the row's level, unseen ones the overall rate, and a tenth of its customer's frequency."""
    overall = rows.agg(F.avg(F.col("label").cast("int"))).first()[0]
    rate = rows.groupBy("transaction_type_code").agg(F.avg(F.col("label").cast("int")).alias("_rate"))
    return lambda df, name: df.join(F.broadcast(rate), "transaction_type_code", "left").withColumn(name, F.round(F.coalesce("_rate", F.lit(overall)) + 0.1 * F.col("customer_freq"), 9)).drop("_rate")  # at most 8 levels


def _folds(spark, sf_dir, scores_only: bool = False):
    o = splits.assign_splits(tables.orders(spark, sf_dir)).withColumns({"label": F.col("is_fraud"), "customer": F.concat(F.lit("c"), F.col("account_id").cast("string"))})
    return folds.forward_chained(o.filter("split = 'train'"), o.filter("split = 'val'"), ["amount", "transaction_type", "customer"], _rates, 5, "transaction_id", ("is_fraud", "label"), 8, scores_only)


_CHAINED = f"""{O}, {_CUT}, tr AS (SELECT * FROM sp WHERE split = 'train'), va AS (SELECT * FROM sp WHERE split = 'val'), r2 AS (SELECT us, sum(count(*)) OVER (ORDER BY us) AS cum FROM tr GROUP BY us), n2 AS (SELECT count(*) AS n FROM tr),
  k2 AS (SELECT {', '.join(f'min(us) FILTER (cum > floor(n * {i / 5}::DOUBLE)) AS e{i}' for i in range(1, 5))} FROM r2, n2), bl AS (SELECT tr.*, {' + '.join(f'CAST(us >= e{i} AS INT)' for i in range(1, 5))} AS block FROM tr, k2), f(fold) AS (VALUES (1), (2), (3), (4), (5)),
  fit AS (SELECT fold, bl.* FROM f JOIN bl ON block < fold), nf AS (SELECT fold, count(*) AS n, count(*) FILTER (is_fraud) AS p FROM fit GROUP BY 1), lr AS (SELECT fold, transaction_type, avg(CAST(is_fraud AS INT)) AS rate FROM fit GROUP BY 1, 2), fr AS (SELECT fold, account_id, count(*) AS c FROM fit GROUP BY 1, 2),
  asked AS (SELECT fold, 'block' AS part, transaction_id, account_id, transaction_type, is_fraud FROM f JOIN bl ON block = fold UNION ALL SELECT fold, 'val', transaction_id, account_id, transaction_type, is_fraud FROM f, va UNION ALL SELECT 5, 'train', transaction_id, account_id, transaction_type, is_fraud FROM bl),
  sc AS (SELECT a.*, round(coalesce(rate, p / n) + 0.1::DOUBLE * coalesce(c / n, 0), 9) AS raw FROM asked a JOIN nf USING (fold) LEFT JOIN lr USING (fold, transaction_type) LEFT JOIN fr USING (fold, account_id))"""


@query(f"WITH {_CHAINED} SELECT transaction_id, fold::INT AS block, round(raw, 6) AS raw, round((rank() OVER (PARTITION BY fold ORDER BY raw) - 1 + (count(*) OVER (PARTITION BY fold, raw) - 1) / 2) / greatest(count(*) OVER (PARTITION BY fold) - 1, 1), 6) AS normalised FROM sc WHERE part = 'block' UNION ALL SELECT transaction_id, 0, NULL, NULL FROM bl WHERE block = 0")
def fold_scores(spark, sf_dir):
    """Forward-chained scores of a model of level rates and frequencies, refitted for each block and ranked within it."""
    return rounded(_folds(spark, sf_dir, scores_only=True).scores.select("transaction_id", F.col("block").cast("int").alias("block"), "raw", "normalised"))


@query(f"WITH {_CHAINED}, g AS (SELECT fold, raw, count(*) AS n, count(*) FILTER (is_fraud) AS tp FROM sc WHERE part = 'val' GROUP BY 1, 2), c AS (SELECT *, sum(n) OVER w AS cn, sum(tp) OVER w AS ct FROM g WINDOW w AS (PARTITION BY fold ORDER BY raw DESC)), ap AS (SELECT fold, sum(tp * ct / cn) / sum(tp) AS ap FROM c GROUP BY 1), full_ap AS (SELECT ap AS full_ap FROM ap WHERE fold = 5) SELECT fold, n AS fit_rows, p AS fit_positives, round(ap, 6) AS fold_precision, round(full_ap, 6) AS full_precision, round(full_ap - ap, 6) AS handicap FROM ap JOIN nf USING (fold), full_ap WHERE fold < 5")
def fold_handicaps(spark, sf_dir):
    """Each fold's model beside the full one, both on validation."""
    return rounded(_folds(spark, sf_dir).handicap)


@query(f"WITH {_CHAINED}, tr5 AS (SELECT list_sort(list(raw)) AS l, count(*) AS m FROM sc WHERE part = 'train'), kn AS (SELECT i, l[i * (m - 1) // 4095 + 1] + (l[least(i * (m - 1) // 4095 + 2, m)] - l[i * (m - 1) // 4095 + 1]) * (i * (m - 1) % 4095) / 4095 AS knot FROM tr5, range(4096) r(i)), kd AS (SELECT knot, min(i) AS a, max(i) AS b, lead(knot) OVER (ORDER BY knot) AS nx FROM kn GROUP BY knot), en AS (SELECT min(knot) AS lo, max(knot) AS hi FROM kn) SELECT v.transaction_id, round(v.raw, 6) AS raw, round(CASE WHEN v.raw >= hi THEN 1 WHEN v.raw <= lo THEN 0 WHEN v.raw = knot THEN (a + b) / 2 / 4095 ELSE (b + (v.raw - knot) / (nx - knot)) / 4095 END, 6) AS mapped FROM (SELECT * FROM sc WHERE part = 'val' AND fold = 5) v CROSS JOIN en ASOF LEFT JOIN kd ON v.raw >= kd.knot")
def fold_reference(spark, sf_dir):
    """The full model's validation scores on the scale of the folds' ranks, through the distribution of its training scores."""
    return rounded(_folds(spark, sf_dir).validation.select("transaction_id", "raw", "mapped"))
