"""Edges and rings on graphs small enough to check by hand."""

from __future__ import annotations

import hashlib
import hmac
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.operators import edges, rings, serving
from riskloom.operators.components import connected_components
from riskloom.plans import graph
from riskloom.sources import sinks


def test_components_of_paths_stars_and_random_graphs(spark):
    rng = random.Random(2)
    pairs = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(rng.randrange(200, 320), rng.randrange(200, 320)) for _ in range(70)]
    root = {n: n for p in pairs for n in p}
    for _ in range(200):
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(pairs, "src long, dst long")).collect()}
    assert got == {n: r for n, r in root.items() if any(a != b and n in (a, b) for a, b in pairs)}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


@pytest.mark.parametrize("tolerance", [0.0, 0.02, 0.3])
def test_chains_are_those_of_the_plain_join(spark, tolerance):
    rng = random.Random(4)
    rows = [(i, i % 9, rng.randrange(30), rng.choice([0.0, 100.0, 100.0, 101.5, round(rng.uniform(1, 200), 1)])) for i in range(160)]
    t, c = rows[:80], rows[80:]
    schema = "transaction_id long, account_id long, step long, amount double"
    got = {(r.transfer_id, r.cash_out_id) for r in edges.chain_edges(spark.createDataFrame(t, schema), spark.createDataFrame(c, schema), 3, tolerance).collect()}
    assert got == {(a[0], b[0]) for a in t for b in c if a[2] <= b[2] <= a[2] + 3 and a[3] * (1 - tolerance) <= b[3] <= a[3] * (1 + tolerance)}


def test_every_row_is_in_the_snapshots_that_hold_it(spark):
    rows = [(i, u) for i, u in enumerate([5, 9, 10, 11, 25, 39, 40])]
    got = {(r.i, r.snapshot_end) for r in edges.snapshot_members(spark.createDataFrame(rows, "i long, us long"), 20, 10).collect()}
    assert got == {(i, e) for i, u in rows for e in range(10, 51, 10) if e - 20 <= u < e}


def ring_edges(spark, pairs, end=1):
    return spark.createDataFrame([(end, *sorted(p), 1, False, 0.0, None, False, 1.0) for p in pairs], "snapshot_end long, u string, v string, flow_count long, has_chain boolean, chain_weight double, least_candidates long, corroborated boolean, weight double")


def test_a_chain_is_a_ring_and_a_star_is_not(spark):
    e = ring_edges(spark, [("a", "b"), ("b", "c"), ("c", "d"), ("h", "x"), ("h", "y"), ("h", "z")])
    members = rings.without_stars(rings.snapshot_components(e), e)
    assert {r.node for r in members.collect()} == {"a", "b", "c", "d"}
    f = rings.ring_features(members, e).first()
    assert (f["size"], f["edges"], f.max_degree, f.density) == (4, 3, 2, 0.5)
    between = {r.node: r.betweenness for r in rings.betweenness(members, e).collect()}
    assert between == pytest.approx({"a": 0, "b": 4 / 6, "c": 4 / 6, "d": 0})


@pytest.mark.parametrize("exact, pivots", [(300, 64), (10, 7)])
def test_betweenness_is_brandes_and_no_ring_lies_in_one_row(spark, monkeypatch, exact, pivots):
    rng = random.Random(5)
    pairs = {tuple(sorted(rng.sample(range(30), 2))) for _ in range(45)}
    around = defaultdict(set)
    for a, b in pairs:
        around[f"n{a:02}"].add(f"n{b:02}")
        around[f"n{b:02}"].add(f"n{a:02}")
    e = ring_edges(spark, [(f"n{a:02}", f"n{b:02}") for a, b in pairs])
    members = rings.snapshot_components(e)
    ring_of = {r.node: r.ring for r in members.collect()}
    monkeypatch.setattr(F, "collect_list", None)
    got = {r.node: r.betweenness for r in rings.betweenness(members, e, exact, pivots).collect()}
    order = [r.node for r in members.select("node").orderBy(F.xxhash64("node"), "node").collect()]
    expected = dict.fromkeys(ring_of, 0.0)
    for ring in set(ring_of.values()):
        nodes = [n for n in order if ring_of[n] == ring]
        few = len(nodes) <= exact
        for s in nodes if few else nodes[:pivots]:
            distance, paths, queue = {s: 0}, defaultdict(int, {s: 1}), [s]
            for x in queue:
                for y in around[x]:
                    if y not in distance:
                        distance[y] = distance[x] + 1
                        queue.append(y)
                    if distance[y] == distance[x] + 1:
                        paths[y] += paths[x]
            carried = defaultdict(float)
            for y in reversed(queue):
                for x in around[y]:
                    if distance[x] == distance[y] - 1:
                        carried[x] += paths[x] / paths[y] * (1 + carried[y])
            for n in queue[1:]:
                expected[n] += carried[n] * (1 if few else len(nodes) / pivots) / max((len(nodes) - 1) * (len(nodes) - 2), 1)
    assert got == pytest.approx(expected)


def test_communities_beat_components_and_repeat(spark):
    clique = lambda names: [(a, b) for i, a in enumerate(names) for b in names[:i]]
    e = ring_edges(spark, clique("abcdef") + clique("uvwxyz") + [("a", "u")])
    one, two = rings.communities(e), rings.communities(e.repartition(5))
    assert {(r.node, r.community) for r in one.collect()} == {(r.node, r.community) for r in two.collect()}
    whole = rings.snapshot_components(e).withColumnRenamed("ring", "community")
    assert rings.modularity(e, one).first().modularity > 0.4 > 0.1 > rings.modularity(e, whole).first().modularity


def test_communities_end_where_no_node_gains(spark):
    names = [f"p{i:02}" for i in range(60)]
    e = ring_edges(spark, list(zip(names, names[1:], strict=False)))
    of = {r.node: r.community for r in rings.communities(e).collect()}
    around = {n: [m for m in (names[i - 1] if i else None, names[i + 1] if i < 59 else None) if m] for i, n in enumerate(names)}
    total = defaultdict(int)
    for n in names:
        total[of[n]] += len(around[n])

    def gain(n, c):
        return sum(of[m] == c for m in around[n]) - len(around[n]) * (total[c] - len(around[n]) * (c == of[n])) / 118

    assert all(gain(n, of[n]) >= gain(n, of[m]) - 1e-9 for n in names for m in around[n])
    with pytest.raises(RuntimeError):
        rings.communities(e, rounds=1)


def partitions(nodes):
    if not nodes:
        yield []
        return
    for p in partitions(nodes[1:]):
        yield [[nodes[0]], *p]
        for i, part in enumerate(p):
            yield [*p[:i], [nodes[0], *part], *p[i + 1 :]]


def modularity_of(pairs, weights, parts):
    of = {n: i for i, p in enumerate(parts) for n in p}
    m, degree = sum(weights), defaultdict(float)
    for (a, b), w in zip(pairs, weights, strict=True):
        degree[of[a]] += w
        degree[of[b]] += w
    return sum(w for (a, b), w in zip(pairs, weights, strict=True) if of[a] == of[b]) / m - sum(d * d for d in degree.values()) / (4 * m * m)


def test_levels_come_close_to_the_best_partition(spark):
    rng, graphs = random.Random(6), {}
    for g in range(60):
        nodes = [f"n{i}" for i in range(rng.randint(3, 8))]
        pairs = {tuple(sorted((nodes[i], nodes[rng.randrange(i)]))) for i in range(1, len(nodes))}
        pairs |= {tuple(sorted(rng.sample(nodes, 2))) for _ in range(rng.randint(0, 8))}
        graphs[g] = sorted(pairs), [float(rng.choice((1, 1, 2, 5))) for _ in pairs]
    rows = [(g, a, b, w) for g, (pairs, weights) in graphs.items() for (a, b), w in zip(pairs, weights, strict=True)]
    e = spark.createDataFrame(rows, "snapshot_end long, u string, v string, weight double")
    found = [sorted(map(tuple, rings.louvain(x).select("snapshot_end", "node", "community").collect())) for x in (e, e.repartition(7))]
    assert found[0] == found[1]
    parts = defaultdict(lambda: defaultdict(list))
    for g, node, community in found[0]:
        parts[g][community].append(node)
    assert all(c == min(p) for of in parts.values() for c, p in of.items())
    gaps = []
    for g, (pairs, weights) in graphs.items():
        best = max(modularity_of(pairs, weights, p) for p in partitions(sorted({n for pair in pairs for n in pair})))
        gaps.append(best - modularity_of(pairs, weights, list(parts[g].values())))
    assert max(gaps) < 0.08 and sum(gaps) / len(gaps) < 0.01 and sum(x < 1e-9 for x in gaps) > 45


def test_only_large_components_are_split(spark):
    clique = lambda names: [(a, b) for i, a in enumerate(names) for b in names[:i]]
    large = clique([f"a{i}" for i in range(7)]) + clique([f"b{i}" for i in range(7)]) + [("a0", "b0"), ("b6", "z")]
    path = [(f"p{i:02}", f"p{i + 1:02}") for i in range(11)]
    star = [("hub", f"s{i}") for i in range(20)]
    got = defaultdict(set)
    for r in rings.candidate_rings(ring_edges(spark, large + path + star + [("x", "y")])).collect():
        got[r.ring].add(r.node)
    assert got["p00"] == {f"p{i:02}" for i in range(12)} and not any(n in ("hub", "x", "y") for p in got.values() for n in p)
    assert got["a0"] == {f"a{i}" for i in range(7)} and {f"b{i}" for i in range(7)} <= got["b0"]
    assert set(got) == {"a0", "b0", "p00"} and all(len(p) >= 3 for p in got.values())
    same = rings.candidate_rings(ring_edges(spark, path))
    assert {r.ring for r in same.collect()} == {"p00"}


def test_repeats_of_a_ring_are_dropped(spark):
    rows = [(1, n, "a") for n in "abcd"] + [(2, n, "b") for n in "bcde"] + [(2, n, "p") for n in "pqr"] + [(3, n, "q") for n in "qxyz"]
    got = rings.first_occurrences(spark.createDataFrame(rows, "snapshot_end long, node string, ring string"))
    assert {(r.snapshot_end, r.ring) for r in got.collect()} == {(1, "a"), (2, "p"), (3, "q")}


def test_abstentions_are_null_and_told_apart(spark):
    scores = spark.createDataFrame([(1, "a", 0.9, "r", 4)], "snapshot_end long, node string, score double, ring string, size long")
    seen = spark.createDataFrame([(1, "a"), (1, "b")], "snapshot_end long, node string")
    asked = spark.createDataFrame([(1, "a"), (1, "b"), (1, "c")], "snapshot_end long, node string")
    got = {r.node: (r.score, r.reason) for r in rings.looked_up(asked, scores, seen).collect()}
    assert got == {"a": (0.9, "scored"), "b": (None, "no_ring"), "c": (None, "never_seen")}


def test_fingerprints_with_a_missing_part_are_no_entity(spark):
    df = spark.createDataFrame([(1, "x", "y"), (2, "x", "y"), (3, "x", None), (4, "x", None)], "account_id long, p string, q string")
    got = edges.entity_edges(df, {"pq": ["p", "q"]}, 10).collect()
    assert {(r.account_id, r.entity, r.degree) for r in got} == {(1, "x|y", 2), (2, "x|y", 2)}
    assert edges.entity_edges(df, {"p": ["p"]}, 3).count() == 0


@pytest.mark.parametrize("key", [b"short", b"k" * 100])
def test_keyed_hash_is_hmac(spark, key):
    got = spark.createDataFrame([("é17",)], "s string").select(edges.keyed_hash(F.col("s"), key).alias("h")).first().h
    assert got == hmac.new(key, "é17".encode(), hashlib.sha256).hexdigest()[:16]


def test_scope_fails_closed(spark):
    df = spark.createDataFrame([(1, 5), (2, 6)], "account_id long, us long")
    assert (serving.scoped(df, 1).count(), serving.scoped(df, None).count(), serving.scoped(df, None, True).count()) == (1, 0, 2)


def test_stores_refuse_what_does_not_belong(spark, tmp_path):
    enc = spark.createDataFrame([("c", "a", 0.25), ("c", "b", 0.75)], "column string, category string, freq double")
    sinks.save_encoders(enc, str(tmp_path / "e"), "v1")
    assert sinks.load_encoders(spark, str(tmp_path / "e"), "v1").count() == 2
    with pytest.raises(ValueError):
        sinks.load_encoders(spark, str(tmp_path / "e"), "v2")
    spark.read.parquet(str(tmp_path / "e")).withColumn("freq", F.col("freq") / 2).write.parquet(str(tmp_path / "f"))
    with pytest.raises(ValueError):
        sinks.load_encoders(spark, str(tmp_path / "f"), "v1")
    rows = spark.createDataFrame([("s", "train", 5), ("s", "val", 4), ("t", "train", 1)], "source_dataset string, split string, us long")
    sinks.write_splits(rows, str(tmp_path / "s"))
    with pytest.raises(ValueError):
        sinks.read_splits(spark, str(tmp_path / "s"), "s")
    sinks.replace_source(spark.createDataFrame([("s", "val", 9)], rows.schema), str(tmp_path / "s"))
    assert defaultdict(int, {r.split: r.us for r in sinks.read_splits(spark, str(tmp_path / "s"), "s").collect()}) == {"train": 5, "val": 9}
    assert sinks.read_splits(spark, str(tmp_path / "s"), "t").count() == 1


@pytest.fixture(scope="module")
def lines(spark, tmp_path_factory):
    """Few order lines, none discounted and most not returned, and their flows by brute force."""
    path, day = tmp_path_factory.mktemp("lines"), "CAST(TIMESTAMP_NTZ '1995-01-01 00:00:00' + make_interval(0, 0, 0, {}) AS TIMESTAMP_NTZ)"
    rng = random.Random(6)
    orders = [(i, rng.randrange(30), rng.randrange(400), rng.choice("FO")) for i in range(60)]
    items = [(o[0], n, rng.randrange(30), rng.choice("RAN"), 0.01) for o in orders for n in range(rng.randint(1, 3))]
    o = spark.createDataFrame(orders, "o_orderkey long, o_custkey long, d int, o_orderstatus string")
    o.selectExpr("o_orderkey", "o_custkey", f"{day.format('d')} AS o_orderdate", "o_orderstatus", "1.0D AS o_totalprice", "'x' AS o_orderpriority").write.parquet(str(path / "orders.parquet"))
    li = spark.createDataFrame(items, "l_orderkey long, l_linenumber int, l_suppkey long, l_returnflag string, l_discount double")
    li.selectExpr("*", "1.0D AS l_extendedprice").write.parquet(str(path / "lineitem.parquet"))
    start = 9131 * edges.DAY
    by = {o[0]: (start + o[2] * edges.DAY, f"c{o[1]}") for o in orders}
    return str(path), [(*by[i[0]], f"s{i[2]}") for i in items]


def rings_by_hand(flows):
    """Components of every snapshot that are no stars, as ``end -> list of node sets``."""
    out = {}
    last = max(u for u, _, _ in flows) // graph.CADENCE + 1
    for k in range(min(u for u, _, _ in flows) // graph.CADENCE + 1, last + 1):
        around = defaultdict(set)
        for u, a, b in flows:
            if k * graph.CADENCE - graph.WINDOW <= u < k * graph.CADENCE:
                around[a].add(b)
                around[b].add(a)
        found, seen = [], set()
        for n in around:
            ring, todo = set(), [n] if n not in seen else []
            while todo:
                x = todo.pop()
                if x not in ring:
                    ring.add(x)
                    todo += around[x]
            seen |= ring
            if len(ring) >= 3 and sum(len(around[x]) >= 2 for x in ring) >= 2:
                found.append(ring)
        out[k * graph.CADENCE] = sorted(found, key=min)
    return out


def test_rings_are_those_of_all_lines_and_snapshots(spark, lines):
    path, flows = lines
    kept = []
    for end, found in sorted(rings_by_hand(flows).items()):
        earlier = list(kept)
        kept += [(end, r) for r in found if all(len(r & k) < 0.5 * min(len(r), len(k)) for _, k in earlier)]
    got = defaultdict(set)
    for r in graph.distinct_rings(spark, path).collect():
        got[r.snapshot_end, r.ring].add(r.node)
    assert {(e, frozenset(n)) for (e, _), n in got.items()} == {(e, frozenset(n)) for e, n in kept} and len(kept) > 1
    assert graph.ring_recovery(spark, path).first().detected == sum(map(len, rings_by_hand(flows).values()))


def test_a_ring_store_is_read_at_its_version_only(spark, tmp_path):
    from riskloom.sources.ring_store import RingStore, graph_version

    flows = spark.createDataFrame([(5, "a", "b", 10.0, False), (6, "b", "c", 20.0, True), (7, "c", "d", 5.0, False), (12, "a", "x", 1.0, False), (13, "z", "y", 2.0, True)], "us long, src string, dst string, amount double, is_fraud boolean")
    members = flows.filter("us < 10").withColumn("snapshot_end", F.lit(10).cast("long"))
    store = RingStore(str(tmp_path / "rings"), "v1")
    with pytest.raises(ValueError):
        store.read(spark, "rings")
    e = ring_edges(spark, [("a", "b"), ("b", "c"), ("c", "d")], 10)
    store.write(e, members, flows, 10)
    ring = store.read(spark, "rings", 10).collect()
    assert [(r.ring, r["size"], r.label, r.exposed_flows, r.exposed_amount) for r in ring] == [("a", 4, True, 3, 35.0)]
    rows = {(r.src, r.us): (r.snapshot_end, r.ring) for r in store.read(spark, "rows").collect()}
    assert rows["a", 12] == (10, "a") and rows["z", 13] == (10, None) and rows["a", 5] == (0, None)
    with pytest.raises(ValueError):
        RingStore(store.path, "v2").read(spark, "nodes")
    flows.write.parquet(str(tmp_path / "one"))
    old = graph_version(spark, [str(tmp_path / "one")], window=1)
    assert old == graph_version(spark, [str(tmp_path / "one")], window=1) != graph_version(spark, [str(tmp_path / "one")], window=2)
    flows.write.mode("append").parquet(str(tmp_path / "one"))
    assert old != graph_version(spark, [str(tmp_path / "one")], window=1)


def test_components_shrink_from_round_to_round(spark, monkeypatch):
    import random

    from riskloom.operators import components

    random.seed(5)
    path, other = random.sample(range(3000), 3000), [(5000 + random.randrange(300), 5000 + random.randrange(300)) for _ in range(250)]
    pairs = [*zip(path, path[1:], strict=False), *other, (4999, 4999)]
    written, cut = [], components.cut

    def counted(df, *name):
        out = cut(df, *name)
        written.append(out.count())
        return out

    monkeypatch.setattr(components, "cut", counted)
    found = {r.node: r.component for r in components.connected_components(spark.createDataFrame(pairs, "src long, dst long")).collect()}
    root = {x: x for p in pairs if p[0] != p[1] for x in p}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        if a != b:
            a, b = sorted((top(a), top(b)))
            root[b] = a
    assert found == {x: top(x) for x in root}
    assert sum(written) < 8 * len(pairs)


def test_features_of_whole_components_are_those_of_the_general_form(spark):
    import random

    random.seed(6)
    rows = {(random.randrange(2), *sorted(random.sample(range(60), 2))) for _ in range(90)}
    e = spark.createDataFrame([(s, f"n{u:02d}", f"n{v:02d}", random.randrange(5), random.random() < 0.5, random.random() < 0.2, random.choice([None, 1, 2])) for s, u, v in sorted(rows)], "snapshot_end long, u string, v string, flow_count long, has_chain boolean, corroborated boolean, least_candidates long")
    members = rings.rings_with_degrees(rings.snapshot_components(e), e)
    a, b = rings.component_features(members, e), rings.ring_features(members.drop("degree"), e)
    assert sorted(a.select(*b.columns).collect()) == sorted(b.collect()) and a.count() > 0


@pytest.mark.parametrize("portion", (7, 10**6))
def test_components_end_in_a_portion_and_take_few_jobs(spark, monkeypatch, portion):
    import numpy as np

    from riskloom.operators import components

    rng = np.random.default_rng(3)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 400, (300, 2))] + [(1000 + i, 1001 + i) for i in range(200)]
    a, b = (np.array(x) for x in zip(*pairs, strict=True))
    root = {}
    for id_, up in zip(*(x.tolist() for x in components.rooted(a, b)), strict=True):
        root[id_] = up
    assert all(root[x] == root[y] <= min(x, y) for x, y in pairs) and all(root[r] == r for r in root.values())
    monkeypatch.setattr(components, "PORTION", portion)
    written, cut = [], components.cut
    monkeypatch.setattr(components, "cut", lambda df, *name: written.append(1) or cut(df, *name))
    found = {r.node: r.component for r in connected_components(spark.createDataFrame(pairs, "src long, dst long").repartition(5)).collect()}
    looped = {x for x in root if all(x not in p or p[0] == p[1] for p in pairs)}
    assert found == {x: r for x, r in root.items() if x not in looped}
    assert portion == 7 or len(written) == 4  # nodes, edges, the last level, roots


def test_no_pair_of_a_chain_is_shuffled(spark):
    from riskloom.operators import chains

    rng = random.Random(8)
    rows = [(i, f"a{rng.randrange(12)}", rng.randrange(4 * edges.DAY), rng.choice([0.0, None, *(100.0 + k for k in range(8))])) for i in range(160)]
    t, c = (spark.createDataFrame(rows[i::2], "transaction_id long, account_id string, us long, amount double").withColumn("step", F.expr("us div 3600000000")) for i in (0, 1))
    for tolerance in (0.0, 0.02):
        counted = edges.chain_edges(t, c, 20, tolerance, ("us",))
        of = Counter(r.transfer_id for r in counted.collect())
        assert of and all(r.candidate_count == of[r.transfer_id] and r.weight == 1 / of[r.transfer_id] for r in counted.collect())
        plan = counted._jdf.queryExecution().executedPlan().toString()
        assert "Window" not in plan and "cash_out_id" not in next((x for x in plan.split("\n") if "Exchange hashpartitioning(transfer_id" in x), "")
        flows = spark.createDataFrame([("a1", "a2", 5, 9)], "src string, dst string, early_us long, late_us long")
        a = chains.snapshot_graph(flows, counted, 2 * edges.DAY, edges.DAY, 5 * edges.DAY)
        b = chains.dealt_graph(flows, t, c, 20, tolerance, 2 * edges.DAY, edges.DAY, 5 * edges.DAY)
        same = lambda x: sorted(map(tuple, x.withColumn("chain_weight", F.round("chain_weight", 9)).select(*a.columns).fillna(-1, ["least_candidates"]).collect()))
        assert same(a) == same(b)


def sparse_graphs(spark, seed, snapshots, nodes, pairs):
    rng, rows = random.Random(seed), []
    for t in range(snapshots):
        rows += [(t, f"n{a:03}", f"n{b:03}", float(rng.choice((1, 1, 2, 5)))) for a, b in sorted({tuple(sorted(rng.sample(range(nodes), 2))) for _ in range(pairs)})]
    return spark.createDataFrame(rows, "snapshot_end long, u string, v string, weight double")


def test_lots_are_the_hashes_of_two_columns(spark):
    import numpy as np

    from riskloom.operators.portions import lots

    rows = spark.createDataFrame([("a",), ("n017",), ("",)], "node string").select(F.xxhash64("node").alias("h"), *[F.xxhash64("node", F.lit(r)).alias(f"h{r}") for r in (0, 5, 999)]).collect()
    for r in (0, 5, 999):
        assert lots(np.array([x.h for x in rows]), r).tolist() == [x[f"h{r}"] for x in rows]


def test_rings_within_a_task_are_searched_as_the_tables_are(spark, monkeypatch):
    e = sparse_graphs(spark, 4, 1, 30, 42).localCheckpoint()
    members = rings.snapshot_components(e).localCheckpoint()
    between = [{(r.snapshot_end, r.node): r.betweenness for r in rings.betweenness(members, e, 10, 7, whole=w).collect()} for w in (0, 1_000)]
    assert between[0] == pytest.approx(between[1]) and max(between[1].values()) > 0
    found = [sorted(map(tuple, rings.candidate_rings(e, 12, 3, members, whole=w).select("snapshot_end", "node", "ring").collect())) for w in (0, 1_000)]
    assert found[0] == found[1] and len(found[0]) > 15
    monkeypatch.setattr(rings, "louvain", None)
    monkeypatch.setattr(rings, "_passed_by_layers", None)
    assert rings.candidate_rings(e, 12, 3, members).count() == len(found[0]) and rings.betweenness(members, e, 10, 7).count() == len(between[0])


def test_a_ring_that_repeats_only_dropped_ones_is_kept(spark, monkeypatch):
    from riskloom.operators import rings as module

    rows = [(1, n, "a") for n in "abcd"] + [(2, n, "b") for n in "cdef"] + [(3, n, "c") for n in "efgh"] + [(4, n, "d") for n in "ghij"] + [(t, n, "x") for t in range(1, 40) for n in "xyz"]
    written, plain = [], module.cut
    monkeypatch.setattr(module, "cut", lambda df, *name: written.append(name) or plain(df, *name))
    got = rings.first_occurrences(spark.createDataFrame(rows, "snapshot_end long, node string, ring string"))
    assert {(r.snapshot_end, r.ring) for r in got.collect()} == {(1, "a"), (1, "x"), (3, "c")}
    assert len(written) < 20  # not a table a snapshot


def test_many_nodes_move_in_a_late_round(spark):
    """One move a community and round took a round a leaf here, and 1,000 of them were an error on six copies of the orders."""
    from riskloom.operators.portions import moved

    hub, leaves = np.zeros(1500, int), np.arange(1, 1501)
    h = np.random.default_rng(3).integers(-(2**63), 2**63 - 1, 1501)
    assert len(set(moved(hub, leaves, np.ones(1500), h, 3000.0, 100, 0).tolist())) == 1
    rng = random.Random(11)
    names = [f"n{i:02}" for i in range(70)]
    pairs = sorted({tuple(sorted(rng.sample(names, 2))) for _ in range(170)} | {("n00", n) for n in names[30:]})
    e = spark.createDataFrame([(1, a, b, float(rng.choice((1, 2, 5)))) for a, b in pairs], "snapshot_end long, u string, v string, weight double")
    hashed = {r.node: r.h for r in spark.createDataFrame([(n,) for n in names], "node string").select("node", F.xxhash64("node").alias("h")).collect()}
    rows = e.collect()
    a, b = (np.array([names.index(x[c]) for x in rows]) for c in "uv")
    weight = np.array([x.weight for x in rows])
    found = moved(a, b, weight, np.array([hashed[n] for n in names]), 2 * weight.sum(), None, 0)
    assert {r.node: r.community for r in rings.communities(e, free=0).collect()} == {n: names[c] for n, c in zip(names, found, strict=True)}
    parts = [[names[i] for i in np.flatnonzero(found == c)] for c in set(found)]
    assert modularity_of(pairs, weight, parts) > modularity_of(pairs, weight, [[n] for n in names]) + 0.1
