"""Graphs counted in tiles, against the tables of their edges."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.operators import chains, edges, grids, rings, tiles

DAY = edges.DAY
BY = "snapshot_end"
AMOUNTS = [0.0, -3.0, float("nan"), *(100.0 + k / 4 for k in range(40))]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(21)
    amounts = [AMOUNTS[i] for i in rng.integers(len(AMOUNTS), size=260)]
    made = [(i, f"a{rng.integers(25)}" if rng.integers(20) else None, int(rng.integers(120)), amounts[i], int(rng.integers(2))) for i in range(260)]
    made += [(900 + i, "a3", int(rng.integers(40)), 105.0, i % 2) for i in range(30)]
    df = spark.createDataFrame(made, "transaction_id long, account_id string, step long, amount double, graph int").withColumn(BY, F.col("graph").cast("long"))
    flows = spark.createDataFrame([(int(g), f"a{a}", f"a{b}") for g, a, b in rng.integers((0, 0, 0), (2, 40, 25), (70, 3))], f"{BY} long, src string, dst string")
    return df.filter("transaction_id % 2 = 0"), df.filter("transaction_id % 2 = 1"), flows


def plain(rows, steps, tolerance):
    t, c, flows = rows
    return edges.merged_edges(flows, edges.chain_edges(t, c, steps, tolerance, by=(BY,)), (BY,))


def listed(e):
    e = e.withColumn("chain_weight", F.round("chain_weight", 9)).fillna(-1, ["least_candidates"])
    return sorted(map(tuple, e.select(BY, "u", "v", "has_flow", "has_chain", "flow_count", "chain_weight", "least_candidates", "corroborated").collect()))


@pytest.mark.parametrize("block", [1_000, 40])
@pytest.mark.parametrize("tolerance", [0.0, 0.02])
def test_edges_of_tiles_are_the_merged_edges(spark, rows, tolerance, block):
    t, c, flows = rows
    got = listed(tiles.edges(flows, edges.with_candidates(t, c, 12, tolerance, (BY,)), c, lambda _: (12, tolerance), rows=block))
    assert got == listed(plain(rows, 12, tolerance)) and any(r[3] and r[4] for r in got) and any(r[4] and not r[3] for r in got)


@pytest.mark.parametrize("block", [1_000, 40])
def test_members_of_tiles_are_those_of_the_edges(spark, rows, block):
    t, c, flows = rows
    e = plain(rows, 5, 0.01).localCheckpoint()
    marked = t.filter("account_id IN ('a1', 'a7')").select(BY, "account_id")
    found = tiles.members(flows, edges.with_candidates(t, c, 5, 0.01, (BY,)), c, lambda _: (5, 0.01), marked, rows=block).localCheckpoint()
    members = rings.rings_with_degrees(rings.snapshot_components(e), e, unique=True).localCheckpoint()
    kept = tiles.without_stars(found)
    columns = [BY, "ring", "node", "degree"]
    assert sorted(kept.select(*columns).collect()) == sorted(members.select(*columns).collect()) and kept.count() > 20
    same = lambda x: sorted(tuple(-1 if v is None else v for v in r) for r in x.select(BY, "ring", "size", "edges", "flows", "chains", "corroborated", "least_candidates", "max_degree", "mean_degree", "density").collect())
    assert same(tiles.features(found)) == same(rings.component_features(members, e))
    of = lambda x: sorted(x.select(BY, "ring", "node", "degree", "chain_degree", "centrality").collect())
    assert of(chains.member_features(kept)) == of(chains.account_features(members.drop("degree"), e))
    named = {(r[0], r.account_id) for r in marked.collect()}
    assert {(r[0], r.node) for r in found.filter("hit").collect()} == {(r[0], r.node) for r in found.collect()} & named != set()


@pytest.mark.parametrize("one", [True, False])
def test_an_edge_is_counted_once_however_its_pairs_are_dealt(monkeypatch, one):
    monkeypatch.setattr(tiles, "PAIRS", 3)
    monkeypatch.setattr(tiles, "_TOGETHER", 4)
    rng, bits = np.random.default_rng(5), 4
    side = lambda n: {"at": rng.integers(9, size=n), "step": rng.integers(4, size=n), "amount": rng.choice([5.0, 5.05, 9.0, 0.0], n), "n": rng.integers(1, 6, n)}
    t, c = side(40), side(30)
    block = rng.integers(1 if one else 2, size=9) > 0
    for x in (t, c):
        x["far"] = block[x["at"]]
    found = list(tiles._distinct(tiles._pairs(t, {k: v for k, v in c.items() if k != "n"}, 2, 0.02, one), bits, True))
    want, weight = Counter(), Counter()
    for i in range(40):
        for j in range(30):
            gap = c["step"][j] - t["step"][i]
            a, b = sorted((t["at"][i], c["at"][j]), key=lambda x: x if one else block[x])
            if 0 <= gap <= 2 and t["amount"][i] * 0.98 <= c["amount"][j] <= t["amount"][i] * 1.02 and a != b and (one or block[a] != block[b]):
                want[int(a) << bits | int(b)] += 1
                weight[int(a) << bits | int(b)] += 1 / t["n"][i]
    keys = np.concatenate([f[0] for f in found])
    assert len(found) > 10 and keys.tolist() == sorted(want)
    assert np.concatenate([f[1] for f in found]).tolist() == pytest.approx([weight[k] for k in sorted(want)])


def test_no_edge_of_a_configuration_is_made(spark, monkeypatch):
    """Every chain of every configuration and snapshot was a row, shuffled to be told from its repeats."""
    from riskloom.plans.chains import _swept

    monkeypatch.setattr(grids, "merged_edges", None)
    assert _swept(spark, "/root/testdata/sf0.001").count() > 0


def test_rings_of_configurations_by_tiles(spark):
    rng = np.random.default_rng(13)
    made = [(i, f"a{rng.integers(30)}", int(rng.integers(10 * DAY)), float(rng.integers(100, 140)), "tcvm"[rng.integers(4)]) for i in range(500)]
    df = spark.createDataFrame(made, "transaction_id long, account_id string, us long, amount double, kind string").withColumn("step", F.expr("us div 3600000000"))
    t, c, v, m = (df.filter(F.col("kind") == k) for k in "tcvm")
    flows = v.select(F.col("account_id").alias("src"), F.concat(F.lit("a"), F.col("transaction_id") % 30).alias("dst"), F.col("us").alias("early_us"), (F.col("us") + 9).alias("late_us"))
    grid = (grids.Configuration("wide", 12, 0.05, 4 * DAY), grids.Configuration("near", 3, 0.01, 2 * DAY))
    a = grids.configured_rings(grids.configured_graph(t, c, flows, grid, DAY, 11 * DAY), m, grid, DAY, 11 * DAY)
    b = grids.searched_rings(t, c, flows, m, grid, DAY, 11 * DAY)
    same = lambda x: sorted(x.select("configuration", "end", "ring", "label", "size", "edges", "density", "identity").collect())
    assert same(a) == same(b) and len(same(a)) > 5
