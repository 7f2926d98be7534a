from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.functions.shared import cut
from riskloom.operators import chains, edges, grids, rings, tiles
from riskloom.operators.edges import DAY
from riskloom.operators.ordering import global_rank
from riskloom.operators.splits import cuts
from riskloom.sources import tables

from .base import T, query, rounded
from .graph import _CC, _DEG, _FEAT, _REACH, _TRUTH, CADENCE, _members, _reference, _rings, _shapes
from .metrics import _MIX, _WEIGHT
from .serving import _page

_WINDOW, _CADENCE, _MINUTE = 10 * DAY, 5 * DAY, 60_000_000
_SNAPS = f"""{T}, bd AS (SELECT min(us) // {_CADENCE} AS lo, max(us) // {_CADENCE} AS hi FROM t), se AS (SELECT (lo + 1 + i) * {_CADENCE} AS snapshot_end FROM bd, range(10000) r(i) WHERE lo + i <= hi),
  vw AS (SELECT account_id AS src, us AS us0, lead(account_id) OVER o AS dst, lead(us) OVER o AS us1 FROM t WHERE transaction_type = 'view' WINDOW o AS (ORDER BY us, transaction_id)),
  fs AS (SELECT snapshot_end, src, dst FROM vw JOIN se ON us0 >= snapshot_end - {_WINDOW} AND us1 < snapshot_end WHERE us1 - us0 < {_MINUTE}),
  ch AS (SELECT a.transaction_id AS transfer_id, a.account_id AS src, c.account_id AS dst, least(a.us, c.us) AS us0, greatest(a.us, c.us) AS us1 FROM t a JOIN t c ON a.transaction_type = 'purchase' AND c.transaction_type = 'error' AND c.us // 3600000000 BETWEEN a.us // 3600000000 AND a.us // 3600000000 + 12 AND c.amount >= a.amount * (1 - 0.005) AND c.amount <= a.amount * (1 + 0.005)),
  cs AS (SELECT snapshot_end, src, dst, count(*) OVER (PARTITION BY snapshot_end, transfer_id) AS n FROM ch JOIN se ON us0 >= snapshot_end - {_WINDOW} AND us1 < snapshot_end),
  xs AS (SELECT snapshot_end, src, dst, 1 AS f, 0 AS c, 0.0::DOUBLE AS w, CAST(NULL AS BIGINT) AS n FROM fs UNION ALL SELECT snapshot_end, src, dst, 0, 1, 1 / n, n FROM cs),
  ed AS (SELECT snapshot_end, least(src, dst) AS u, greatest(src, dst) AS v, max(f) = 1 AS has_flow, max(c) = 1 AS has_chain, sum(f)::BIGINT AS flow_count, sum(w) AS chain_weight, min(n) AS least_candidates, max(f) = 1 AND max(c) = 1 AS corroborated FROM xs WHERE src <> dst GROUP BY 1, 2, 3)"""


def _graph(spark, sf_dir, of=chains.dealt_graph, **options) -> DataFrame:
    """Views less than a minute apart as flows, purchases and errors of like amounts as chains."""
    t = tables.events(spark, sf_dir)
    _, last = edges.snapshot_grid(t, _CADENCE)
    v = global_rank(t.filter("transaction_type = 'view'"), ["us", "transaction_id"])
    following = v.select((F.col("position") - 1).alias("position"), F.col("account_id").alias("dst"), F.col("us").alias("late_us"))
    flow = v.select("position", F.col("account_id").alias("src"), F.col("us").alias("early_us")).join(following, "position").filter(F.col("late_us") - F.col("early_us") < _MINUTE)
    s = t.withColumn("step", F.expr("us div 3600000000"))
    return of(flow, s.filter("transaction_type = 'purchase'"), s.filter("transaction_type = 'error'"), 12, 0.005, _WINDOW, _CADENCE, last, **options)


@query(f"WITH {_SNAPS} SELECT * REPLACE (round(chain_weight, 6) AS chain_weight) FROM ed")
def chain_snapshots(spark, sf_dir):
    return rounded(_graph(spark, sf_dir))


_IN_RING = "cx AS (SELECT k.snapshot_end, k.ring, count(*) FILTER (has_chain) AS chains, count(*) FILTER (corroborated) AS corroborated, min(least_candidates) AS least_candidates FROM ed JOIN kept k ON k.snapshot_end = ed.snapshot_end AND k.node = ed.u GROUP BY 1, 2)"


@query(f"WITH RECURSIVE {_SNAPS}, {_REACH}, {_DEG}, {_FEAT}, {_IN_RING} SELECT snapshot_end, ring, size, edges, flows, max_degree, round(mean_degree, 6) AS mean_degree, round(density, 6) AS density, chains, round(chains / edges, 6) AS chain_share, corroborated, least_candidates FROM ft JOIN cx USING (snapshot_end, ring)")
def chain_rings(spark, sf_dir):
    return rounded(tiles.features(_graph(spark, sf_dir, chains.dealt_members)).select("snapshot_end", "ring", "size", "edges", "flows", "max_degree", "mean_degree", "density", "chains", "chain_share", "corroborated", "least_candidates"))


@query(f"WITH RECURSIVE {_SNAPS}, {_REACH}, {_DEG}, ce AS (SELECT snapshot_end, unnest([u, v]) AS node, has_chain FROM ed), cd AS (SELECT snapshot_end, node, count(*) AS degree, count(*) FILTER (has_chain) AS chain_degree FROM ce GROUP BY 1, 2) SELECT snapshot_end, ring, node, degree, chain_degree, round(degree / (count(*) OVER (PARTITION BY snapshot_end, ring) - 1), 6) AS centrality FROM kept JOIN cd USING (snapshot_end, node)")
def ring_accounts(spark, sf_dir):
    m = tiles.without_stars(_graph(spark, sf_dir, chains.dealt_members, weighted=False))
    return rounded(chains.member_features(m).select("snapshot_end", "ring", "node", "degree", "chain_degree", "centrality"))


@query("""WITH RECURSIVE n AS (SELECT count(DISTINCT l_orderkey) AS n FROM lineitem), p AS (SELECT DISTINCT l_orderkey AS account_id, 'part' AS spec, l_partkey::VARCHAR AS entity FROM lineitem UNION SELECT DISTINCT l_orderkey, 'part_supplier', l_partkey || '|' || l_suppkey FROM lineitem), d AS (SELECT spec, entity, count(*) AS degree FROM p GROUP BY 1, 2 HAVING count(*) BETWEEN 2 AND 8),
  l AS (SELECT account_id, p.spec, p.entity, ln(n / degree) AS idf FROM p JOIN d USING (spec, entity), n), ed AS (SELECT DISTINCT 0 AS snapshot_end, 'a' || account_id AS u, spec || ':' || entity AS v FROM l), bi AS (SELECT u AS a, v AS b FROM ed UNION SELECT v, u FROM ed),
  reach(node, ring) USING KEY (node) AS (SELECT DISTINCT a, a FROM bi UNION SELECT bi.b, min(r.ring) FROM reach r JOIN bi ON bi.a = r.node JOIN recurring.reach k ON k.node = bi.b WHERE r.ring < k.ring GROUP BY 1)
  SELECT ring, count(DISTINCT account_id) AS accounts, count(DISTINCT (spec, entity)) AS entities, count(DISTINCT spec) AS specs, round(avg(idf), 6) AS mean_idf, count(*) AS links, round(count(*) / (count(DISTINCT account_id) * count(DISTINCT (spec, entity))), 6) AS fill_rate FROM l JOIN reach ON node = 'a' || account_id GROUP BY 1""")
def entity_rings(spark, sf_dir):
    """Orders linked by the parts they share, as rings of a two-sided graph."""
    li = tables.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("account_id"), "l_partkey", "l_suppkey")
    links = cut(edges.entity_edges(li, {"part": ["l_partkey"], "part_supplier": ["l_partkey", "l_suppkey"]}, 8), "links")
    account = F.concat(F.lit("a"), F.col("account_id").cast("string"))
    found = rings.snapshot_components(links.select(F.lit(0).alias("snapshot_end"), account.alias("u"), F.concat_ws(":", "spec", "entity").alias("v")))
    members = links.select("account_id", account.alias("node")).distinct().join(found, "node").select("account_id", "ring")
    return rounded(chains.entity_features(members, links))


@query(f"WITH RECURSIVE {_CC}, {_DEG}, {_TRUTH}, na AS (SELECT snapshot_end, ring, count(*) AS n FROM kept GROUP BY 1, 2), nb AS (SELECT snapshot_end, ring, count(*) AS n FROM tc GROUP BY 1, 2), sh AS (SELECT k.snapshot_end, k.ring AS a, t.ring AS b, count(*) AS shared FROM kept k JOIN tc t ON k.snapshot_end = t.snapshot_end AND k.node = t.node GROUP BY 1, 2, 3), ov AS (SELECT sh.snapshot_end, a, b, shared / least(na.n, nb.n) AS overlap FROM sh JOIN na ON na.snapshot_end = sh.snapshot_end AND na.ring = a JOIN nb ON nb.snapshot_end = sh.snapshot_end AND nb.ring = b), th(threshold) AS (VALUES (0.3::DOUBLE), (0.5), (0.7)), hi AS (SELECT snapshot_end, threshold, count(DISTINCT a) AS detected_hit, count(DISTINCT b) AS truth_hit FROM ov JOIN th ON overlap >= threshold GROUP BY 1, 2), sn AS (SELECT snapshot_end, coalesce(d, 0) AS detected, coalesce(r, 0) AS truth FROM (SELECT snapshot_end, count(*) AS d FROM na GROUP BY 1) x FULL JOIN (SELECT snapshot_end, count(*) AS r FROM nb GROUP BY 1) y USING (snapshot_end)), pr AS (SELECT snapshot_end, threshold, detected, truth, coalesce(detected_hit, 0) AS detected_hit, coalesce(truth_hit, 0) AS truth_hit FROM sn CROSS JOIN th LEFT JOIN hi USING (snapshot_end, threshold)), ps AS (SELECT *, coalesce(detected_hit / nullif(detected, 0), 0) AS precision, coalesce(truth_hit / nullif(truth, 0), 0) AS recall FROM pr), fo AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1 FROM ps) SELECT snapshot_end, threshold, detected, truth, detected_hit, truth_hit, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, round(max(f1) OVER (PARTITION BY snapshot_end), 6) AS best_f1 FROM fo")
def ring_recovery_grid(spark, sf_dir):
    m, _ = _rings(spark, sf_dir)
    return rounded(chains.recovery_grid(m, _reference(spark, sf_dir)))


@query(f"WITH RECURSIVE {_CC}, {_DEG}, {_FEAT}, pg AS (SELECT snapshot_end, ring FROM ft WHERE size * density >= 2.0 AND size >= 4 ORDER BY size DESC, snapshot_end, ring LIMIT 20), ms AS (SELECT snapshot_end, ring, node, row_number() OVER (PARTITION BY snapshot_end, ring ORDER BY node) AS n FROM kept SEMI JOIN pg USING (snapshot_end, ring)), sw AS (SELECT * FROM ms WHERE n <= 200) SELECT ed.snapshot_end, a.ring, u, v, flow_count FROM ed JOIN sw a ON a.snapshot_end = ed.snapshot_end AND a.node = u JOIN sw b ON b.snapshot_end = ed.snapshot_end AND b.node = v AND a.ring = b.ring")
def flagged_ring_edges(spark, sf_dir):
    m, e = _rings(spark, sf_dir)
    return chains.page_edges(_page(m, _shapes(spark, sf_dir)), e)


@query(f"WITH RECURSIVE {_CC}, {_DEG}, {_FEAT}, sc AS (SELECT snapshot_end, node, ring, round(size * density, 6) AS score FROM kept JOIN ft USING (snapshot_end, ring)), sn AS (SELECT DISTINCT snapshot_end, src AS node FROM m), ak AS (SELECT snapshot_end + {CADENCE} AS snapshot_end, node FROM sn) SELECT ak.snapshot_end, ak.node, score, ring, CASE WHEN score IS NOT NULL THEN 'scored' WHEN sn.node IS NOT NULL THEN 'no_ring' ELSE 'never_seen' END AS reason FROM ak LEFT JOIN sc ON sc.snapshot_end = ak.snapshot_end AND sc.node = ak.node LEFT JOIN sn ON sn.snapshot_end = ak.snapshot_end AND sn.node = ak.node")
def score_lookup(spark, sf_dir):
    """The accounts of each snapshot looked up in the next one: scored, without a ring, or never seen there."""
    m, _ = _rings(spark, sf_dir)
    f = _shapes(spark, sf_dir).select("snapshot_end", "ring", "size", F.round(F.col("size") * F.col("density"), 6).alias("score"))
    seen = _members(spark, sf_dir).select("snapshot_end", F.col("src").alias("node")).distinct()
    asked = seen.select((F.col("snapshot_end") + CADENCE).alias("snapshot_end"), "node")
    return rings.looked_up(asked, rings.score_table(m.join(f, ["snapshot_end", "ring"])), seen).select("snapshot_end", "node", "score", "ring", "reason")


_KEYS = "ka AS (SELECT snapshot_end, ring, list_sort(list(node)) AS key FROM kept GROUP BY 1, 2)"


@query(f"WITH RECURSIVE {_CC}, {_DEG}, {_KEYS} SELECT min(ring) AS ring, len(key) AS size, min(snapshot_end) AS first_seen, max(snapshot_end) AS last_seen, count(*) AS snapshots FROM ka GROUP BY key")
def ring_identities(spark, sf_dir):
    """Rings by their members: SQL compares the sorted lists."""
    m, _ = _rings(spark, sf_dir)
    return rings.identities(m).drop("identity")


@query(f"""WITH RECURSIVE {_CC}, {_DEG}, {_TRUTH}, {_KEYS}, kb AS (SELECT snapshot_end, ring, list_sort(list(node)) AS key FROM tc GROUP BY 1, 2), sh AS (SELECT k.snapshot_end, k.ring AS a, t.ring AS b, count(*) AS shared FROM kept k JOIN tc t ON k.snapshot_end = t.snapshot_end AND k.node = t.node GROUP BY 1, 2, 3),
  ov AS (SELECT ka.key AS a, kb.key AS b, shared / least(len(ka.key), len(kb.key)) AS overlap FROM sh JOIN ka ON ka.snapshot_end = sh.snapshot_end AND ka.ring = a JOIN kb ON kb.snapshot_end = sh.snapshot_end AND kb.ring = b), th(threshold) AS (VALUES (0.3::DOUBLE), (0.5), (0.7)), hi AS (SELECT threshold, count(DISTINCT a) AS detected_hit, count(DISTINCT b) AS truth_hit FROM ov JOIN th ON overlap >= threshold GROUP BY 1),
  pr AS (SELECT threshold, (SELECT count(DISTINCT key) FROM ka) AS detected, (SELECT count(DISTINCT key) FROM kb) AS truth, coalesce(detected_hit, 0) AS detected_hit, coalesce(truth_hit, 0) AS truth_hit FROM th LEFT JOIN hi USING (threshold)), ps AS (SELECT *, coalesce(detected_hit / nullif(detected, 0), 0) AS precision, coalesce(truth_hit / nullif(truth, 0), 0) AS recall FROM pr), fo AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1 FROM ps)
  SELECT threshold, detected, truth, detected_hit, truth_hit, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, row_number() OVER (ORDER BY f1 DESC, threshold) = 1 AS best FROM fo""")
def ring_recovery_by_identity(spark, sf_dir):
    m, _ = _rings(spark, sf_dir)
    return rounded(rings.recovery_by_identity(m, _reference(spark, sf_dir)))


_GRID_CADENCE = 2 * DAY
_CONFIGURATIONS = (
    grids.Configuration("wide", 24, 0.02, 10 * DAY),
    grids.Configuration("near", 24, 0.01, 10 * DAY),
    grids.Configuration("soon", 12, 0.02, 10 * DAY),
    grids.Configuration("brief", 24, 0.02, 5 * DAY),
)
_GROWN = ", ".join(f"('{c.name}', {c.steps}, {c.tolerance}::DOUBLE, {c.window})" for c in _CONFIGURATIONS)
_CONFIGURED = f"""{T}, x AS (SELECT *, account_id || '-' || device AS entity FROM t), bd AS (SELECT min(us) // {_GRID_CADENCE} AS lo, max(us) // {_GRID_CADENCE} AS hi FROM t), cf(configuration, steps, tolerance, wide) AS (VALUES {_GROWN}), se AS (SELECT configuration, steps, tolerance, wide, (lo + 1 + i) * {_GRID_CADENCE} AS till, configuration || '|' || printf('%020d', till) AS snapshot_end FROM cf, bd, range(10000) r(i) WHERE lo + i <= hi),
  vw AS (SELECT entity AS src, us AS us0, lead(entity) OVER o AS dst, lead(us) OVER o AS us1 FROM x WHERE transaction_type = 'view' WINDOW o AS (ORDER BY us, transaction_id)), fs AS (SELECT snapshot_end, src, dst FROM vw JOIN se ON us0 >= till - wide AND us1 < till WHERE us1 - us0 < {_MINUTE}),
  ch AS (SELECT a.transaction_id AS transfer_id, a.entity AS src, c.entity AS dst, least(a.us, c.us) AS us0, greatest(a.us, c.us) AS us1, a.amount AS ta, c.amount AS ca, c.us // 3600000000 - a.us // 3600000000 AS gap FROM x a JOIN x c ON a.transaction_type = 'purchase' AND c.transaction_type = 'error' AND c.us // 3600000000 BETWEEN a.us // 3600000000 AND a.us // 3600000000 + 24 AND c.amount >= a.amount * (1 - 0.02) AND c.amount <= a.amount * (1 + 0.02)),
  cs AS (SELECT snapshot_end, src, dst FROM ch JOIN se ON us0 >= till - wide AND us1 < till AND gap <= steps AND ca >= ta * (1 - tolerance) AND ca <= ta * (1 + tolerance)), ed AS (SELECT snapshot_end, least(src, dst) AS u, greatest(src, dst) AS v, count(*) AS flow_count FROM (SELECT * FROM fs UNION ALL SELECT * FROM cs) WHERE src <> dst GROUP BY 1, 2, 3)"""
_SWEPT = f"""hit AS (SELECT DISTINCT snapshot_end, entity AS node FROM x JOIN se ON us >= till - wide AND us < till WHERE transaction_type = 'signup'), ra AS (SELECT k.snapshot_end, k.ring, bool_or(h.node IS NOT NULL) AS label, list_sort(list(k.node)) AS key FROM kept k LEFT JOIN hit h ON h.snapshot_end = k.snapshot_end AND h.node = k.node GROUP BY 1, 2), rf AS (SELECT configuration, till, ft.ring, label, round(2.0 * edges / (size - 1), 6) AS score, row_number() OVER (PARTITION BY configuration, key ORDER BY till) AS nth FROM ft JOIN ra USING (snapshot_end, ring) JOIN se USING (snapshot_end)),
  ct AS (SELECT (SELECT us FROM t ORDER BY us LIMIT 1 OFFSET (SELECT CAST(floor(count(*) * 0.5) AS BIGINT) FROM t)) AS a, (SELECT us FROM t ORDER BY us LIMIT 1 OFFSET (SELECT CAST(floor(count(*) * 0.75) AS BIGINT) FROM t)) AS b), s AS (SELECT *, CASE WHEN till <= a THEN 'train' WHEN till <= b THEN 'val' ELSE 'test' END AS split FROM rf, ct WHERE nth = 1)"""


def _swept(spark, sf_dir) -> DataFrame:
    """Rings of all configurations over accounts by device, scored by size and density, marked by sign-ups."""
    t = tables.events(spark, sf_dir)
    x = t.withColumns({"account_id": F.concat_ws("-", F.col("account_id").cast("string"), "device"), "step": F.expr("us div 3600000000")}).filter("device IS NOT NULL")
    _, last = edges.snapshot_grid(t, _GRID_CADENCE)
    v = global_rank(x.filter("transaction_type = 'view'"), ["us", "transaction_id"])
    following = v.select((F.col("position") - 1).alias("position"), F.col("account_id").alias("dst"), F.col("us").alias("late_us"))
    flow = v.select("position", F.col("account_id").alias("src"), F.col("us").alias("early_us")).join(following, "position").filter(F.col("late_us") - F.col("early_us") < _MINUTE)
    of = lambda kind: x.filter(F.col("transaction_type") == kind)
    found = grids.searched_rings(of("purchase"), of("error"), flow, of("signup").select("account_id", "us"), _CONFIGURATIONS, _GRID_CADENCE, last)
    a, b = cuts(t, [0.5, 0.75])
    split = F.when(F.col("end") <= a, "train").when(F.col("end") <= b, "val").otherwise("test")
    return found.withColumns({"score": F.round(F.col("size") * F.col("density"), 6), "split": split})


@query(f"WITH RECURSIVE {_CONFIGURED}, {_REACH}, {_DEG}, {_FEAT}, {_SWEPT} SELECT configuration, split, till AS \"end\", ring, label, score FROM s")
def configured_rings(spark, sf_dir):
    return _swept(spark, sf_dir).select("configuration", "split", "end", "ring", "label", "score")


@query(f"""WITH RECURSIVE {_CONFIGURED}, {_REACH}, {_DEG}, {_FEAT}, {_SWEPT}, vg AS (SELECT configuration, score AS v, count(*) AS n, count(*) FILTER (label) AS tp FROM s WHERE split = 'val' GROUP BY 1, 2), vc AS (SELECT *, sum(n) OVER w AS cn, sum(tp) OVER w AS ct FROM vg WINDOW w AS (PARTITION BY configuration ORDER BY v DESC)), va AS (SELECT configuration, sum(n)::BIGINT AS val_rings, sum(tp)::BIGINT AS val_positives, round(sum(tp * ct / cn) / sum(tp), 9) AS val_metric FROM vc GROUP BY 1 HAVING sum(tp) > 0 AND sum(tp) < sum(n)), be AS (SELECT configuration FROM va ORDER BY val_metric DESC, configuration LIMIT 1),
  te AS (SELECT score, label, row_number() OVER (ORDER BY till, ring) - 1 AS row FROM s SEMI JOIN be USING (configuration) WHERE split = 'test'), tg AS (SELECT score AS v, count(*) AS n, count(*) FILTER (label) AS tp FROM te GROUP BY 1), tc AS (SELECT *, sum(n) OVER w AS cn, sum(tp) OVER w AS ct FROM tg WINDOW w AS (ORDER BY v DESC)), ta AS (SELECT sum(n)::BIGINT AS test_rings, sum(tp)::BIGINT AS test_positives, coalesce(sum(tp * ct / cn) / nullif(sum(tp), 0), 0) AS test_metric, sum(tp) / sum(n) AS base_rate FROM tc HAVING count(*) > 0),
  h0 AS (SELECT te.*, r AS replicate, (row % 2147483648 * 1000003 + r * 7919 + 12345) % 4294967296 AS h FROM te, range(1000) q(r)), h1 AS (SELECT * REPLACE ({_MIX} AS h) FROM h0), h2 AS (SELECT * REPLACE ({_MIX} AS h) FROM h1), d AS (SELECT *, xor(h, h >> 16) / 4294967296.0::DOUBLE AS u FROM h2), w AS (SELECT replicate, score, label, {_WEIGHT} AS w FROM d), st AS (SELECT replicate, sum(w) FILTER (label) AS wp, coalesce(sum(w) FILTER (NOT label), 0) AS wn FROM w GROUP BY 1), g AS (SELECT replicate, score AS v, sum(CASE WHEN label THEN w ELSE 0 END) AS tp, sum(CASE WHEN label THEN 0 ELSE w END) AS fp FROM w GROUP BY 1, 2), c AS (SELECT *, sum(tp) OVER o AS ct, sum(fp) OVER o AS cn FROM g WINDOW o AS (PARTITION BY replicate ORDER BY v DESC)),
  bs AS (SELECT replicate, coalesce(sum(CASE WHEN tp > 0 THEN tp * (ct * p / wp) / (ct * p / wp + CASE WHEN wn > 0 THEN cn * n / wn ELSE 0 END) ELSE 0 END) / nullif(min(wp), 0), 0) AS ap FROM c JOIN st USING (replicate), (SELECT test_positives AS p, test_rings - test_positives AS n FROM ta) GROUP BY 1), iv AS (SELECT quantile_cont(ap, 0.025) AS lo, quantile_cont(ap, 0.975) AS hi FROM bs)
  SELECT va.configuration, val_rings, val_positives, round(val_metric, 6) AS val_metric, be.configuration IS NOT NULL AS chosen, test_rings, test_positives, round(test_metric, 6) AS test_metric, round(base_rate, 6) AS base_rate, round(test_metric - base_rate, 6) AS increment, round(lo - base_rate, 6) AS lo, round(hi - base_rate, 6) AS hi FROM va LEFT JOIN be USING (configuration) LEFT JOIN (SELECT * FROM ta, iv) ON be.configuration IS NOT NULL""")
def configuration_grid(spark, sf_dir):
    """Four graphs compared on validation rings; the best one's increment over the pairing rule on the test rings."""
    return rounded(grids.chosen_on_validation(_swept(spark, sf_dir)))
