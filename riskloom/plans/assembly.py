from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from riskloom.functions.shared import shared_dir
from riskloom.operators import assembly, costs, encoders, metrics, models, rings, splits
from riskloom.sources import sinks, tables

from .base import O, S, T, query, rounded
from .graph import _CC, _DEG, _FEAT, _rings, _shapes
from .metrics import _BOOT
from .splits import _CUT


@query(f"WITH {O}, {_CUT} SELECT split, count(*) AS n_rows, round(sum(amount), 2) AS amount FROM sp WHERE split <> 'test' GROUP BY 1")
def stored_splits(spark, sf_dir):
    """Written by source and split, one source replaced, two splits read back."""
    path = f"{shared_dir(spark)}/splits-{uuid.uuid4().hex}"
    o = splits.assign_splits(tables.orders(spark, sf_dir))
    sinks.write_splits(o, path)
    sinks.replace_source(o, path)
    back = sinks.read_splits(spark, path, "orders", ("train", "val"))
    return back.groupBy("split").agg(F.count("*").alias("n_rows"), F.round(F.sum("amount"), 2).alias("amount"))


@query("SELECT 'transaction_type' AS \"column\", 0.0::DOUBLE AS greatest_gap, true AS same")
def stored_encoders(spark, sf_dir):
    """Saved with a digest, loaded against it, and compared with a rebuilt table."""
    path = f"{shared_dir(spark)}/encoders-{uuid.uuid4().hex}"
    fitted = encoders.fit_frequencies(tables.events(spark, sf_dir), ["transaction_type"])
    sinks.save_encoders(fitted, path, "v1")
    return sinks.verified_encoders(fitted, sinks.load_encoders(spark, path, "v1"))


@query(f"WITH {O}, {_CUT}, su AS (SELECT split, count(*) AS n_rows, count(*) FILTER (is_fraud) AS positives FROM sp GROUP BY split) SELECT 'splits' AS section, split AS key, 'n_rows' AS metric, n_rows::DOUBLE AS value FROM su UNION ALL SELECT 'splits', split, 'positives', positives FROM su")
def report_long(spark, sf_dir):
    s = splits.split_summary(splits.assign_splits(tables.orders(spark, sf_dir))).select("split", "n_rows", "positives")
    return sinks.report({"splits": s}, "split")


@query(f"WITH {O}, {_CUT}, lv AS (SELECT list_sort(list(DISTINCT transaction_type)) AS l FROM sp WHERE split = 'train') SELECT transaction_id, amount, CAST(coalesce(nullif(list_position(l, transaction_type), 0) - 1, -1) AS INT) AS transaction_type_code FROM sp, lv WHERE split = 'test'")
def input_spec(spark, sf_dir):
    o = splits.assign_splits(tables.orders(spark, sf_dir))
    spec = assembly.fit_spec(o.filter("split = 'train'"), ["amount", "transaction_type"], denied=("is_fraud",))
    return assembly.apply_spec(o.filter("split = 'test'"), spec).select("transaction_id", "amount", "transaction_type_code")


@query("SELECT o_orderkey, o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45) AS has_large FROM orders")
def match_indicator(spark, sf_dir):
    li = tables.table(spark, sf_dir, "lineitem").filter("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey")).distinct()
    return assembly.with_match(tables.table(spark, sf_dir, "orders").select("o_orderkey"), li, "o_orderkey", "has_large")


@query("WITH a AS (SELECT l_orderkey AS k, round(sum(l_quantity), 4) AS quantity FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1), b AS (SELECT l_orderkey AS k, max(l_discount) AS discount FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1) SELECT o_orderkey AS k, coalesce(quantity, -1) AS quantity, CAST(a.k IS NOT NULL AS INT) AS returned_here, coalesce(discount, -1) AS discount, CAST(b.k IS NOT NULL AS INT) AS finished_here FROM orders LEFT JOIN a ON a.k = o_orderkey LEFT JOIN b ON b.k = o_orderkey")
def assembled_signals(spark, sf_dir):
    li = tables.table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "k")
    a = li.filter("l_returnflag = 'R'").groupBy("k").agg(F.round(F.sum("l_quantity"), 4).alias("quantity"))
    b = li.filter("l_linestatus = 'F'").groupBy("k").agg(F.max("l_discount").alias("discount"))
    base = tables.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"))
    return assembly.assembled_signals(base, {"returned": a, "finished": b}, "k")


@query("SELECT count(*) AS n, count(*) FILTER (o_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')) AS hit, round(count(*) FILTER (o_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')) / count(*), 6) AS share FROM orders WHERE o_orderstatus = 'F'")
def membership_share(spark, sf_dir):
    o = tables.table(spark, sf_dir, "orders")
    return rounded(assembly.membership_share(o.filter("o_orderstatus = 'F'"), o.filter("o_orderstatus = 'P'"), "o_custkey"))


_ABST = f"{S}, x AS (SELECT *, CASE WHEN other >= 0.1 THEN score END AS sc FROM s)"


def _abstaining(spark, sf_dir):
    return tables.scored(spark, sf_dir).withColumn("score", F.when(F.col("other") >= 0.1, F.col("score")))


@query(f"WITH {_ABST} SELECT band, round(avg(CAST(sc IS NULL AS INT)), 6) AS abstention, CASE WHEN avg(CAST(sc IS NULL AS INT)) >= 0.99 THEN 'ring' ELSE 'row' END AS unit FROM x GROUP BY band")
def abstention(spark, sf_dir):
    return rounded(assembly.abstention(_abstaining(spark, sf_dir), by=("band",)))


@query(f"WITH {_ABST} SELECT CASE WHEN sc IS NULL THEN 'abstained' WHEN sc < 0.6 THEN 'below' ELSE 'caught' END AS fate, count(*) AS n, round(quantile_cont(amount, 0.5), 3) AS median_amount, round(sum(amount), 2) AS amount FROM x WHERE label GROUP BY 1")
def missed_profile(spark, sf_dir):
    p = assembly.missed_profile(_abstaining(spark, sf_dir), 0.6)
    return p.select("fate", "n", F.round("median_amount", 3).alias("median_amount"), F.round("amount", 2).alias("amount"))


@query(f"WITH {S}, g AS (SELECT other AS v, count(*) AS n, count(*) FILTER (label) AS tp FROM s WHERE score < 0.7 GROUP BY 1), c AS (SELECT *, sum(n) OVER (ORDER BY v DESC) AS cn, sum(tp) OVER (ORDER BY v DESC) AS ct FROM g) SELECT round(sum(tp * ct / cn) / sum(tp), 6) AS average_precision, round(sum(tp) / sum(n), 6) AS base_rate FROM c")
def residual_lift(spark, sf_dir):
    return rounded(assembly.residual_lift(tables.scored(spark, sf_dir), "score", "other", 0.7))


@query(f"WITH {S}, e AS (SELECT *, unnest(['all', CASE WHEN other >= 0.5 THEN 'eligible' ELSE 'other' END]) AS grp FROM s), g AS (SELECT grp, score, count(*) FILTER (label) AS pos, count(*) FILTER (NOT label) AS neg FROM e GROUP BY 1, 2), c AS (SELECT *, sum(neg) OVER (PARTITION BY grp ORDER BY score) AS cum FROM g) SELECT grp AS \"group\", round(sum(pos * (cum - neg + neg / 2)) / (sum(pos) * sum(neg)), 6) AS rank_auc FROM c GROUP BY 1")
def memorisation(spark, sf_dir):
    return rounded(assembly.memorisation(tables.scored(spark, sf_dir), F.col("other") >= 0.5))


@query(f"WITH {S}, k AS (SELECT unnest(quantile_cont(score, [i / 4095 for i in range(4096)])) AS g, unnest(range(4096)) AS i FROM s), h AS (SELECT g, min(i) AS f, max(i) AS l, lead(g) OVER (ORDER BY g) AS nxt FROM k GROUP BY g), e AS (SELECT min(g) AS lo, max(g) AS hi FROM h) SELECT id, line, round(CASE WHEN score <= lo THEN 0 WHEN score >= hi THEN 1 WHEN score = g THEN (f + l) / 2 / 4095 ELSE (l + (score - g) / (nxt - g)) / 4095 END, 6) AS share FROM s JOIN e ON true ASOF LEFT JOIN h ON s.score >= h.g")
def empirical_cdf(spark, sf_dir):
    s = tables.scored(spark, sf_dir)
    return rounded(assembly.ecdf(s, "score", assembly.ecdf_knots(s, "score")).select("id", "line", "share"))


@query(f"WITH RECURSIVE {_CC}, {_DEG}, {_FEAT}, l AS (SELECT max(snapshot_end) AS e FROM ft), r AS (SELECT ft.*, round(size * density, 6) AS score FROM ft, l WHERE snapshot_end = e) SELECT snapshot_end, (SELECT ring FROM r ORDER BY score DESC, ring LIMIT 1) AS riskiest, (SELECT ring FROM r ORDER BY score, ring LIMIT 1) AS cleanest, count(*) AS rings FROM r GROUP BY 1")
def latest_extremes(spark, sf_dir):
    m, _ = _rings(spark, sf_dir)
    f = _shapes(spark, sf_dir).select("snapshot_end", "ring", F.round(F.col("size") * F.col("density"), 6).alias("score"))
    last = f.join(f.agg(F.max("snapshot_end").alias("snapshot_end")), "snapshot_end")
    return last.groupBy("snapshot_end").agg(F.min(F.struct((-F.col("score")).alias("s"), "ring"))["ring"].alias("riskiest"), F.min(F.struct("score", "ring"))["ring"].alias("cleanest"), F.count("*").alias("rings"))


_VT = f"{S}, v AS (SELECT * FROM s WHERE band = 'O'), te AS (SELECT * FROM s WHERE band = 'F'), q AS (SELECT min(score) AS t FROM v WHERE score > (SELECT quantile_cont(score, 0.95) FROM v))"


@query(f"WITH {_VT} SELECT t AS threshold, count(*) FILTER (score >= t) AS flagged, round(count(*) FILTER (score >= t AND label) / nullif(count(*) FILTER (score >= t), 0), 6) AS precision, round(count(*) FILTER (score >= t AND label) / count(*) FILTER (label), 6) AS recall FROM te, q GROUP BY t")
def chosen_on_validation(spark, sf_dir):
    """The threshold is chosen on one part and measured, once, on the other."""
    s = tables.scored(spark, sf_dir)
    t = costs.capacity_threshold(s.filter("band = 'O'"), 0.05).first()["threshold"]
    c = metrics.confusion(s.filter("band = 'F'"), t)
    return rounded(c.select(F.lit(t).alias("threshold"), (F.col("tp") + F.col("fp")).alias("flagged"), "precision", "recall"))


@query(f"WITH {S}, c AS (SELECT 'other' AS config, corr(other, CAST(label AS INT)) AS metric FROM s UNION ALL SELECT 'score', corr(score, CAST(label AS INT)) FROM s) SELECT config, round(metric, 6) AS metric FROM c ORDER BY metric DESC, config LIMIT 1")
def selected_config(spark, sf_dir):
    s = tables.scored(spark, sf_dir)
    y = metrics.hits()
    configs = s.agg(F.array(*[F.struct(F.lit(c).alias("config"), F.corr(c, y).alias("metric")) for c in ("other", "score")]).alias("a")).select(F.explode("a").alias("r")).select("r.*")
    return rounded(assembly.selected(configs))


@query(f"WITH {S}, k AS (SELECT *, row_number() OVER () AS k FROM s), p AS (SELECT k, id, line, unnest(['amount', 'other', 'score']) AS name, unnest([0.00001 * amount, -0.5 * other, 0.7 * score]) AS value FROM k), r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY abs(value) DESC, name) AS n FROM p) SELECT id, line, top FROM (SELECT k, id, line, string_agg(name, ',' ORDER BY n) AS top FROM r WHERE n <= 2 GROUP BY 1, 2, 3)")
def top_contributions(spark, sf_dir):
    c = models.contributions(tables.scored(spark, sf_dir), {"amount": 0.00001, "other": -0.5, "score": 0.7}, 2)
    return c.select("id", "line", F.array_join(F.transform("top_features", lambda f: f["name"]), ",").alias("top"))


@query(f"WITH {T}, d AS (SELECT transaction_id, account_id, us, row_number() OVER (PARTITION BY account_id ORDER BY us DESC, transaction_id) AS n FROM t) SELECT transaction_id, account_id FROM d WHERE n <= 3")
def latest_of_each_account(spark, sf_dir):
    w = Window.partitionBy("account_id").orderBy(F.desc("us"), "transaction_id")
    return tables.events(spark, sf_dir).withColumn("n", F.row_number().over(w)).filter("n <= 3").select("transaction_id", "account_id")


@query(f"WITH RECURSIVE {_CC}, {_DEG}, {_FEAT}, lt AS (SELECT src AS node, us, us // {30 * 86_400_000_000} * {30 * 86_400_000_000} AS e FROM f), j AS (SELECT lt.*, k.ring, ft.size FROM lt LEFT JOIN kept k ON k.snapshot_end = lt.e AND k.node = lt.node LEFT JOIN ft ON ft.snapshot_end = lt.e AND ft.ring = k.ring) SELECT node, us, round((us - e) / 3600000000, 6) AS staleness_hours, coalesce(size, -1)::DOUBLE AS ring_size, CAST(ring IS NULL AS INT) AS ring_absent FROM j")
def ring_row_features(spark, sf_dir):
    """Graph-to-row features: the last snapshot's ring, how old it is, and an indicator where there is none."""
    from .graph import CADENCE, flows

    m, _ = _rings(spark, sf_dir)
    f = _shapes(spark, sf_dir).select("snapshot_end", "ring", "size")
    of = m.join(f, ["snapshot_end", "ring"]).select("snapshot_end", "node", "size")
    rows = flows(spark, sf_dir).select(F.col("src").alias("node"), "us").withColumn("snapshot_end", F.floor(F.col("us") / CADENCE) * CADENCE)
    out = rows.join(of, ["snapshot_end", "node"], "left")
    return rounded(out.select("node", "us", ((F.col("us") - F.col("snapshot_end")) / 3_600_000_000).alias("staleness_hours"), F.coalesce(F.col("size").cast("double"), F.lit(-1.0)).alias("ring_size"), F.col("size").isNull().cast("int").alias("ring_absent")))


def _fitted(rows, features):
    """A logistic model as a function that adds its score, rounded, under a name."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import vector_to_array

    names = {"rawPredictionCol": "_raw", "probabilityCol": "_p", "predictionCol": "_y"}
    m = LogisticRegression(labelCol="y", regParam=0.001, maxIter=30, **names).fit(models.assembled(rows.withColumn("y", F.col("label").cast("double")), features))
    return lambda df, name: m.transform(models.assembled(df, features)).withColumn(name, F.round(vector_to_array("_p")[1], 6)).drop("features", *names.values())


@query()
def fusion_lift(spark, sf_dir):
    """Does a second-stage model on score and history beat the score alone? Paired interval and verdict."""
    s = tables.numbered(spark, sf_dir)
    test = _fitted(s.filter("band = 'O'"), ["score", "other"])(s.filter("band = 'F'"), "fused")
    both = metrics.bootstrap(test, ["row"], 1000, ("fused", "score"))
    return rounded(metrics.interval(both.withColumn("delta", F.col("ap_fused") - F.col("ap_score")), "delta"))


@query()
def block_ablation(spark, sf_dir):
    """Each block left out of the full model and added to the base alone, and whether either says to keep it."""
    s = tables.numbered(spark, sf_dir)
    blocks = {"risk": ["score"], "size": ["other"], "amount": ["amount"]}
    return rounded(assembly.ablation(s.filter("band = 'O'"), s.filter("band = 'F'"), blocks, ("risk",), _fitted, "row"))


@query(f"WITH {S}, b AS (SELECT score, other, label, score < 0.7 AS below FROM s), ra AS (SELECT *, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2 AS x, rank() OVER (ORDER BY other) + (count(*) OVER (PARTITION BY other) - 1) / 2 AS y FROM b), rb AS (SELECT *, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2 AS x, rank() OVER (ORDER BY other) + (count(*) OVER (PARTITION BY other) - 1) / 2 AS y FROM b WHERE below), g AS (SELECT other AS v, count(*) AS n, count(*) FILTER (label) AS tp FROM b WHERE below GROUP BY 1), c AS (SELECT *, sum(n) OVER (ORDER BY v DESC) AS cn, sum(tp) OVER (ORDER BY v DESC) AS ct FROM g) SELECT round(sum(tp * ct / cn) / sum(tp), 6) AS average_precision, round(sum(tp) / sum(n), 6) AS base_rate, (SELECT round(corr(x, y), 6) FROM rb) AS rank_correlation, (SELECT round(corr(x, y), 6) FROM ra) AS overall_correlation FROM c")
def residual_report(spark, sf_dir):
    """What a second score adds below the first one's threshold, and how alike the two rank."""
    return rounded(assembly.residual_report(tables.scored(spark, sf_dir), "score", "other", 0.7))


_RIVALS = ("score", "other", "amount")
_DRAWN = _BOOT.replace("FROM sn, range(1000)", "FROM (SELECT * FROM sn WHERE band = 'O') sn, range(1000)").replace("AS n FROM s)", "AS n FROM s WHERE band = 'O')")


def _rival(c: str) -> str:
    return f"""va_{c} AS (SELECT sum(tp * ct / cn) / sum(tp) AS ap FROM (SELECT *, sum(n) OVER (ORDER BY v DESC) AS cn, sum(tp) OVER (ORDER BY v DESC) AS ct FROM (SELECT {c} AS v, count(*) AS n, count(*) FILTER (label) AS tp FROM s WHERE band = 'F' GROUP BY 1))), te_{c} AS (SELECT sum(tp * ct / cn) / sum(tp) AS ap FROM (SELECT *, sum(n) OVER (ORDER BY v DESC) AS cn, sum(tp) OVER (ORDER BY v DESC) AS ct FROM (SELECT {c} AS v, count(*) AS n, count(*) FILTER (label) AS tp FROM s WHERE band = 'O' GROUP BY 1))),
  bg_{c} AS (SELECT replicate, {c} AS v, sum(CASE WHEN label THEN w ELSE 0 END) AS tp, sum(CASE WHEN label THEN 0 ELSE w END) AS fp FROM w GROUP BY 1, 2), bc_{c} AS (SELECT *, sum(tp) OVER (PARTITION BY replicate ORDER BY v DESC) AS ct, sum(fp) OVER (PARTITION BY replicate ORDER BY v DESC) AS cn FROM bg_{c}), bo_{c} AS (SELECT '{c}' AS name, replicate, sum(CASE WHEN tp > 0 THEN tp * (ct * p / wp) / (ct * p / wp + cn * n / wn) ELSE 0 END) / min(wp) AS ap FROM bc_{c} JOIN st USING (replicate), tot GROUP BY 2)"""


_METRICS = " UNION ALL ".join(f"SELECT '{c}' AS name, va_{c}.ap AS va, te_{c}.ap AS te FROM va_{c}, te_{c}" for c in _RIVALS)


@query(f"WITH {_DRAWN}, {', '.join(map(_rival, _RIVALS))}, al AS ({' UNION ALL '.join(f'SELECT * FROM bo_{c}' for c in _RIVALS)}), m AS ({_METRICS}), r AS (SELECT *, row_number() OVER (ORDER BY va DESC, name) AS nth FROM m), pr AS (SELECT 'runner_up' AS role, a.name AS winner, b.name AS rival, a.va, a.te, b.te AS rte FROM r a, r b WHERE a.nth = 1 AND b.nth = 2 UNION ALL SELECT 'baseline', a.name, b.name, a.va, a.te, b.te FROM r a, r b WHERE a.nth = 1 AND b.name = 'amount' AND b.nth > 1), dd AS (SELECT pr.*, x.ap - y.ap AS delta FROM pr JOIN al x ON x.name = winner JOIN al y ON y.name = rival AND x.replicate = y.replicate), i AS (SELECT role, winner, rival, va, te, rte, quantile_cont(delta, 0.025) AS lo, quantile_cont(delta, 0.975) AS hi FROM dd GROUP BY ALL) SELECT role, winner, rival, round(va, 5) AS chosen_metric, round(te, 5) AS metric, round(rte, 5) AS rival_metric, round(lo, 5) AS lo, round(hi, 5) AS hi, CASE WHEN lo > 0 THEN 'significant' WHEN hi < 0 THEN 'worse' ELSE 'not significant' END AS verdict FROM i")
def winner_report(spark, sf_dir):
    """The best of three scores on the lines of one status, measured on those of the other against the next and the amount alone."""
    s = tables.numbered(spark, sf_dir)
    return rounded(assembly.winner_report(s.filter("band = 'F'"), s.filter("band = 'O'"), ["score", "other"], "amount", "row"), 5)


@query(f"WITH {S} SELECT id, line, score, other, amount FROM s")
def block_selection(spark, sf_dir):
    """Inputs by blocks in their fixed order; the graph's block lacks a column here and is left out whole."""
    s = tables.scored(spark, sf_dir)
    blocks = {"risk": ["score", "other"], "graph": ["band", "ring_size"], "amount": ["amount"]}
    there = assembly.available_blocks(s.columns, blocks)
    return s.select("id", "line", *assembly.block_columns(s, blocks, there[::-1], ("label",)))
