"""Rings known by their members, and configurations that run as one job, against plain counterparts."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.operators import chains, edges, grids, rings

DAY = edges.DAY
GRID = (grids.Configuration("wide", 12, 0.05, 4 * DAY), grids.Configuration("near", 12, 0.01, 4 * DAY), grids.Configuration("soon", 3, 0.05, 4 * DAY), grids.Configuration("brief", 12, 0.05, 2 * DAY))


def members(spark, sets):
    rows = [(end, node, f"{end}-{ring}") for end, ring, nodes in sets for node in nodes]
    return spark.createDataFrame(rows, "snapshot_end long, node string, ring string")


def test_an_identity_is_the_member_set(spark):
    rng = np.random.default_rng(4)
    sets = [(end, ring, tuple(sorted({f"n{i}" for i in rng.integers(0, 5, 3)}))) for end in range(6) for ring in range(8)]
    sets += [(9, 0, ("ab", "c")), (9, 1, ("a", "bc"))]  # run together, one string
    found = rings.fingerprints(members(spark, sets).repartition(7)).collect()
    of = {r.ring: r.identity for r in found}
    key = {f"{end}-{ring}": nodes for end, ring, nodes in sets}
    for a in of:
        for b in of:
            assert (of[a] == of[b]) == (key[a] == key[b]), (a, b)
    assert {r.ring: r.size for r in found} == {r: len(n) for r, n in key.items()}
    lives = rings.identities(members(spark, sets)).collect()
    want = {nodes: sorted(end for end, _, n in sets if n == nodes) for _, _, nodes in sets}
    assert sorted((r.size, r.first_seen, r.last_seen, r.snapshots) for r in lives) == sorted((len(n), e[0], e[-1], len(e)) for n, e in want.items())


def test_a_ring_that_lives_on_counts_once(spark):
    detected = members(spark, [(1, 0, "abc"), (2, 0, "abc"), (3, 0, "abc"), (3, 1, "xyz")])
    truth = members(spark, [(1, 0, "ab"), (2, 0, "ab"), (3, 0, "pq"), (3, 1, "xw")])
    got = {r.threshold: r for r in rings.recovery_by_identity(detected, truth, (0.5, 0.7)).collect()}
    assert (got[0.7].detected, got[0.7].truth, got[0.7].detected_hit, got[0.7].truth_hit, got[0.7].best) == (2, 3, 1, 1, False)
    assert (got[0.5].detected_hit, got[0.5].truth_hit, got[0.5].precision, got[0.5].best) == (2, 2, 1.0, True)
    none = rings.recovery_by_identity(detected.limit(0), truth, (0.5,)).first()
    assert (none.detected, none.detected_hit, none.precision, none.recall, none.f1) == (0, 0, 0.0, 0.0, 0.0)


@pytest.fixture(scope="module")
def events(spark):
    rng = np.random.default_rng(12)
    rows = [(i, f"a{rng.integers(30)}", int(rng.integers(10 * DAY)), float(rng.integers(100, 140)), ["t", "c", "v", "m"][rng.integers(4)]) for i in range(500)]
    df = spark.createDataFrame(rows, "transaction_id long, account_id string, us long, amount double, kind string")
    return df.withColumn("step", F.expr("us div 3600000000"))


def views(events):
    v = events.filter("kind = 'v'")
    a, b = v.alias("a"), v.alias("b")
    near = (F.col("b.us") > F.col("a.us")) & (F.col("b.us") < F.col("a.us") + DAY // 12)
    return a.join(b, near).select(F.col("a.account_id").alias("src"), F.col("b.account_id").alias("dst"), F.col("a.us").alias("early_us"), F.col("b.us").alias("late_us"))


def test_configurations_together_are_those_alone(spark, events):
    t, c, last = events.filter("kind = 't'"), events.filter("kind = 'c'"), 11 * DAY
    together = grids.configured_graph(t, c, views(events), GRID, DAY, last)
    rounded = [F.round("chain_weight", 9), "u", "v", "has_flow", "has_chain", "flow_count", "least_candidates"]
    got = {tuple(r) for r in together.select("snapshot_end.configuration", "snapshot_end.end", *rounded).collect()}
    marked = events.filter("kind = 'm'").select("account_id", "us")
    found = grids.configured_rings(together, marked, GRID, DAY, last).collect()
    want, sizes = set(), {}
    for g in GRID:
        alone = chains.snapshot_graph(views(events), edges.chain_edges(t, c, g.steps, g.tolerance, ("us",)), g.window, DAY, last)
        want |= {(g.name, *r) for r in alone.select("snapshot_end", *rounded).collect()}
        kept, seen = {}, {}
        for r in rings.without_stars(rings.snapshot_components(alone), alone).collect():
            kept.setdefault((r.snapshot_end, r.ring), set()).add(r.node)
        marks = marked.collect()
        for (end, ring), nodes in sorted(kept.items()):
            if frozenset(nodes) not in seen:
                seen[frozenset(nodes)] = end
                sizes[g.name, end, ring] = (len(nodes), any(m.account_id in nodes and end - g.window <= m.us < end for m in marks))
    assert got == want
    assert {(r.configuration, r.end, r.ring): (r.size, r.label) for r in found} == sizes
    assert len({r.configuration for r in found}) > 2


def test_one_class_takes_no_part_and_the_losers_never_see_the_test_rings(spark):
    rows = [("a", 1, "r1", 0.9, True, "val"), ("a", 1, "r2", 0.1, False, "val"), ("a", 2, "r3", 0.2, True, "test"), ("a", 2, "r4", 0.8, False, "test")]
    rows += [("b", 1, "r1", 0.1, True, "val"), ("b", 1, "r2", 0.9, False, "val"), ("b", 2, "r3", 0.9, True, "test"), ("c", 1, "r1", 0.9, True, "val")]
    schema = "configuration string, end long, ring string, score double, label boolean, split string"
    got = {r.configuration: r for r in grids.chosen_on_validation(spark.createDataFrame(rows, schema), 50).collect()}
    assert got.keys() == {"a", "b"}
    assert got["a"].chosen and got["a"].val_metric == 1.0 and got["a"].test_metric == 0.5 and got["a"].increment == 0.0 and got["a"].test_rings == 2
    assert not got["b"].chosen and got["b"].val_metric == 0.5 and got["b"].test_metric is None and got["b"].hi is None
    assert grids.chosen_on_validation(spark.createDataFrame(rows[-1:], schema), 50).count() == 0


def test_rings_are_the_same_without_candidates(spark, events):
    t, c = events.filter("kind = 't'"), events.filter("kind = 'c'")
    marked = events.filter("kind = 'm'").select("account_id", "us")
    both = [grids.configured_graph(t, c, views(events), GRID, DAY, 11 * DAY, weighted=w) for w in (True, False)]
    plans = [g._jdf.queryExecution().executedPlan().toString() for g in both]
    assert "Window" in plans[0] and "Window" not in plans[1]
    found = [sorted((r.configuration, r.end, r.ring, r.label, r["size"], r.edges, r.density) for r in grids.configured_rings(g, marked, GRID, DAY, 11 * DAY).select("configuration", "end", "ring", "label", "size", "edges", "density").collect()) for g in both]
    assert found[0] == found[1] and found[0]


def test_degrees_of_unique_edges_take_no_distinct(spark):
    e = spark.createDataFrame([(1, "a", "b"), (1, "b", "c"), (1, "c", "c"), (2, "a", "b")], "snapshot_end long, u string, v string")
    assert sorted(rings.degrees(e, unique=True).collect()) == sorted(rings.degrees(e).collect())
    shuffles = [rings.degrees(e, unique=u)._jdf.queryExecution().executedPlan().toString().count("Exchange") for u in (False, True)]
    assert shuffles[0] > shuffles[1]
