"""Rings of accounts in snapshot graphs: finding, describing, scoring and comparing them."""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from riskloom.functions.shared import cut

from .components import connected_components
from .portions import ring_communities, ring_paths

BY = "snapshot_end"
#: Edges up to which a ring is searched in one task; larger ones are tables throughout.
WHOLE = 1_000_000


def snapshot_components(edges: DataFrame) -> DataFrame:
    """``snapshot_end, node, ring`` for ``edges(snapshot_end, u, v)``; all snapshots run as one job."""
    as_node = lambda c: F.struct(F.col(BY), F.col(c).alias("node"))
    found = connected_components(edges.select(as_node("u").alias("src"), as_node("v").alias("dst")))
    return found.select(f"node.{BY}", "node.node", F.col("component.node").alias("ring"))


def degrees(edges: DataFrame, unique: bool = False) -> DataFrame:
    """``snapshot_end, node, degree``: the distinct neighbours of each node; ``unique`` says that ``edges`` has one row a pair."""
    pairs = edges.select(BY, F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    pairs = pairs if unique else pairs.distinct()
    ends = pairs.select(BY, F.explode(F.array_distinct(F.array("u", "v"))).alias("node"))
    return ends.groupBy(BY, "node").agg(F.count("*").alias("degree"))


def rings_with_degrees(members: DataFrame, edges: DataFrame, least: int = 3, unique: bool = False) -> DataFrame:
    """Rings of ``least`` nodes or more in which two nodes have two neighbours each, with every node's ``degree``."""
    d = cut(members.join(degrees(edges, unique), [BY, "node"]), "degrees")
    kept = d.groupBy(BY, "ring").agg(F.count("*").alias("n"), F.count_if(F.col("degree") >= 2).alias("inner")).filter((F.col("n") >= least) & (F.col("inner") >= 2))
    return d.join(kept.select(BY, "ring"), [BY, "ring"], "left_semi")


def without_stars(members: DataFrame, edges: DataFrame, least: int = 3) -> DataFrame:
    """The members of ``rings_with_degrees`` alone."""
    return rings_with_degrees(members, edges, least).select(*members.columns)


def shaped(out: DataFrame) -> DataFrame:
    """Density and chain share from sizes and counts."""
    return out.withColumn("density", 2 * F.col("edges") / (F.col("size") * (F.col("size") - 1))).withColumn("chain_share", F.col("chains") / F.col("edges"))


def _inside() -> list[Column]:
    return [F.count("*").alias("edges"), F.sum("flow_count").alias("flows"), F.count_if("has_chain").alias("chains"), F.count_if("corroborated").alias("corroborated"), F.min("least_candidates").alias("least_candidates")]


def ring_features(members: DataFrame, edges: DataFrame) -> DataFrame:
    """Size, density, degrees and the chain share of each ring; amounts play no part."""
    inside = edges.join(members.select(BY, F.col("node").alias("u"), "ring"), [BY, "u"]).join(members.select(BY, F.col("node").alias("v"), F.col("ring").alias("_rv")), [BY, "v"]).filter("ring = _rv")
    size = members.groupBy(BY, "ring").agg(F.count("*").alias("size"))
    e = inside.groupBy(BY, "ring").agg(*_inside())
    d = members.join(degrees(inside.select(BY, "u", "v")), [BY, "node"]).groupBy(BY, "ring").agg(F.max("degree").alias("max_degree"), F.avg("degree").alias("mean_degree"))
    return shaped(size.join(e, [BY, "ring"]).join(d, [BY, "ring"]))


def component_features(members: DataFrame, edges: DataFrame) -> DataFrame:
    """``ring_features`` of rings that are whole components, ``members`` being those of ``rings_with_degrees``.

    Both ends of an edge are then in one ring, so an edge is counted at its end ``u`` before it meets the members, and is joined once.
    """
    at = edges.groupBy(BY, F.col("u").alias("node")).agg(*_inside())
    sums = [F.sum(c).alias(c) for c in ("edges", "flows", "chains", "corroborated")]
    out = members.join(at, [BY, "node"], "left").groupBy(BY, "ring").agg(F.count("*").alias("size"), *sums, F.min("least_candidates").alias("least_candidates"), F.max("degree").alias("max_degree"), F.avg("degree").alias("mean_degree"))
    return shaped(out)


def _mass(edges: DataFrame) -> DataFrame:
    """Each snapshot's weight, every edge from both ends."""
    return edges.groupBy(BY).agg((2 * F.sum(F.col("weight").cast("double"))).alias("m2"))


def communities(edges: DataFrame, rounds: int | None = None, free: int = 16, mass: DataFrame | None = None) -> DataFrame:
    """Distributed local moving for weighted modularity: ``snapshot_end, node, community``.

    Each round a node looks at its neighbours' communities and joins the one with the greatest
    gain; in the first ``free`` rounds a half of the nodes, hashed anew each round, moves at a time. After
    them lots are drawn: a node moves if no neighbour with an earlier lot would, and if what the earlier lots that leave or join the same
    communities could take from its gain is at most half of it. So every round gains, the first lot always moves, and none is undone. It
    ends when no node would gain by moving; ``rounds`` makes more of them an error. Deterministic; the objective is the usual one, the
    partition need not be any other program's.
    """
    both = cut(edges.select(BY, F.col("u").alias("node"), F.col("v").alias("other"), "weight").unionByName(edges.select(BY, F.col("v").alias("node"), F.col("u").alias("other"), "weight")))
    degree = cut(both.groupBy(BY, "node").agg(F.sum("weight").alias("k")))
    mass = degree.groupBy(BY).agg(F.sum("k").alias("m2")) if mass is None else mass
    state = cut(degree.select(BY, "node", F.col("node").alias("community")))
    for r in count() if rounds is None else range(rounds):
        held = state.join(degree, [BY, "node"])
        total = held.groupBy(BY, "community").agg(F.sum("k").alias("tot"))
        toward = both.filter("node <> other").join(state.select(BY, F.col("node").alias("other"), "community"), [BY, "other"]).groupBy(BY, "node", "community").agg(F.sum("weight").alias("w"))
        own = held.select(BY, "node", "k", F.col("community").alias("own"))
        stay = own.select(BY, "node", F.col("own").alias("community"), F.lit(0.0).alias("w"))
        options = toward.unionByName(stay).groupBy(BY, "node", "community").agg(F.sum("w").alias("w")).join(own, [BY, "node"]).join(total, [BY, "community"]).join(mass, BY)
        rest = F.col("tot") - F.when(F.col("community") == F.col("own"), F.col("k")).otherwise(0.0)
        gain = F.round(F.col("w") - F.col("k") * rest / F.col("m2"), 9)
        same = F.col("community") == F.col("own")
        best = options.groupBy(BY, "node", "own", "k", "m2").agg(F.max(F.struct(gain.alias("g"), same.alias("same"), "community")).alias("b"), F.max(F.when(same, gain)).alias("stay"))
        mine = F.pmod(F.xxhash64("node", F.lit(r)), F.lit(2)) == 0
        if r >= free:
            lot = F.struct(F.xxhash64("node", F.lit(r)), "node").alias("lot")
            wish = cut(best.filter(~F.col("b.same")).select(BY, "node", "own", F.col("b.community").alias("joined"), "k", "m2", (F.col("b.g") - F.col("stay")).alias("gain"), lot))
            at = lambda end: wish.select(BY, F.col("node").alias(end), F.col("lot").alias(f"lot_{end}"))  # noqa: E731, B023
            behind = both.filter("node <> other").join(at("node"), [BY, "node"]).join(at("other"), [BY, "other"]).filter("lot_other < lot_node").select(BY, "node").distinct()
            met = lambda c: F.coalesce(F.sum("k").over(Window.partitionBy(BY, c).orderBy("lot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
            go = wish.join(behind, [BY, "node"], "left_anti").withColumn("_met", met("own") + met("joined")).filter(F.col("k") * F.col("_met") / F.col("m2") <= F.col("gain") / 2)
            best = best.join(go.select(BY, "node", F.lit(True).alias("_go")), [BY, "node"], "left")
            mine = F.coalesce("_go", F.lit(False))
        moved = cut(best.select(BY, "node", F.when(mine, F.col("b.community")).otherwise(F.col("own")).alias("community"), (~F.col("b.same")).alias("moves")))
        if moved.filter("moves").isEmpty():
            return state
        state = moved.drop("moves")
    raise RuntimeError(f"nodes still move after {rounds} rounds")


def louvain(edges: DataFrame, levels: int = 30, mass: DataFrame | None = None) -> DataFrame:
    """``snapshot_end, node, community``: local moving, then the communities as nodes of a smaller weighted graph, until none merge.

    A community's inner weight becomes a loop of its node, so that modularity is the same on every level. A community is named by its least node.
    """
    level, names = cut(edges.select(BY, "u", "v", F.col("weight").cast("double").alias("weight"))), None
    for _ in range(levels):
        state = communities(level, mass=mass)
        merged = state.filter("node <> community")
        names = state if names is None else cut(names.withColumnRenamed("community", "_c").join(state.select(BY, F.col("node").alias("_c"), "community"), [BY, "_c"]).select(BY, "node", "community"))
        if merged.isEmpty():
            least = names.groupBy(BY, "community").agg(F.min("node").alias("least"))
            return names.join(least, [BY, "community"]).select(BY, "node", F.col("least").alias("community"))
        of = lambda end: state.select(BY, F.col("node").alias(end), F.col("community").alias(f"c_{end}"))  # noqa: E731, B023
        ends = level.join(of("u"), [BY, "u"]).join(of("v"), [BY, "v"])
        level = cut(ends.groupBy(BY, F.least("c_u", "c_v").alias("u"), F.greatest("c_u", "c_v").alias("v")).agg(F.sum("weight").alias("weight")))
    raise RuntimeError(f"communities still merge after {levels} levels")


def candidate_rings(edges: DataFrame, small: int = 12, least: int = 3, members: DataFrame | None = None, whole: int = WHOLE) -> DataFrame:
    """``snapshot_end, node, ring``: components of up to ``small`` nodes as they are, larger ones by community; stars and groups of fewer than ``least`` nodes are none.

    Paths of a small component would be cut up by modularity, so only large ones are; their edges alone enter the search.
    ``members``: the components without stars, where they are known. A component of up to ``whole`` edges moves in one task, by the same
    rounds as the larger ones, whose rounds are jobs.
    """
    members = cut(without_stars(snapshot_components(edges), edges, least)) if members is None else members
    large = members.groupBy(BY, "ring").agg(F.count("*").alias("n")).filter(F.col("n") > small).select(BY, "ring")
    split = cut(members.join(large, [BY, "ring"], "left_semi"))
    as_they_are = members.join(large, [BY, "ring"], "left_anti").select(BY, "node", "ring")
    if split.isEmpty():
        return as_they_are
    inside = cut(edges.join(split.select(BY, F.col("node").alias("u"), "ring"), [BY, "u"]).select(BY, "ring", "u", "v", F.col("weight").cast("double").alias("weight")))
    mass = cut(_mass(inside))
    huge = cut(inside.groupBy(BY, "ring").agg(F.count("*").alias("n")).filter(F.col("n") > whole).select(BY, "ring"))
    of = inside.join(huge, [BY, "ring"], "left_anti").join(mass.withColumnRenamed("m2", "mass"), BY).withColumns({"hu": F.xxhash64("u"), "hv": F.xxhash64("v")})
    kinds = dict(inside.dtypes)
    parts = of.groupBy(BY, "ring").applyInPandas(lambda rows: ring_communities(rows), f"{BY} {kinds[BY]}, node {kinds['u']}, community {kinds['u']}")
    if not huge.isEmpty():
        parts = parts.unionByName(louvain(inside.join(huge, [BY, "ring"], "left_semi").drop("ring"), mass=mass))
    parts = cut(parts.withColumnRenamed("community", "ring"))
    enough = parts.groupBy(BY, "ring").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    return as_they_are.unionByName(parts.join(enough, [BY, "ring"], "left_semi").select(BY, "node", "ring"))


def modularity(edges: DataFrame, state: DataFrame) -> DataFrame:
    """Weighted modularity of a partition, one row a snapshot."""
    of = lambda end: state.select(BY, F.col("node").alias(end), F.col("community").alias(f"c_{end}"))
    e = edges.join(of("u"), [BY, "u"]).join(of("v"), [BY, "v"])
    inside = e.groupBy(BY).agg(F.sum("weight").alias("m"), F.sum(F.when(F.col("c_u") == F.col("c_v"), F.col("weight")).otherwise(0.0)).alias("inside"))
    ends = e.select(BY, F.explode(F.array("c_u", "c_v")).alias("community"), "weight").groupBy(BY, "community").agg(F.sum("weight").alias("d")).groupBy(BY).agg(F.sum(F.pow("d", F.lit(2))).alias("d2"))
    return inside.join(ends, BY).select(BY, (F.col("inside") / F.col("m") - F.col("d2") / F.pow(2 * F.col("m"), F.lit(2))).alias("modularity"))


def betweenness(members: DataFrame, edges: DataFrame, exact: int = 300, pivots: int = 64, whole: int = WHOLE) -> DataFrame:
    """Share of shortest paths through each node of its ring; exact up to ``exact`` nodes, else from pivots.

    A ring of up to ``whole`` edges is searched in one task; larger ones by layers that are tables, so no ring beyond that lies in one row or task.
    """
    ring = [BY, "ring"]
    inside = edges.join(members.select(BY, F.col("node").alias("u"), "ring"), [BY, "u"]).filter("u <> v")
    inside = cut(inside.select(*ring, F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "inside")
    sized = cut(members.join(members.groupBy(*ring).agg(F.count("*").alias("n")), ring).select(*ring, "node", "n"))
    # a rank limit alone, so that each task sends at most ``pivots`` nodes of a ring
    nth = Window.partitionBy(*ring).orderBy(F.xxhash64("node"), "node")
    chosen = sized.filter(F.col("n") > exact).withColumn("_i", F.row_number().over(nth)).filter(F.col("_i") <= pivots).drop("_i")
    sources = cut(sized.filter(F.col("n") <= exact).withColumn("scale", F.lit(1.0)).unionByName(chosen.withColumn("scale", F.col("n") / pivots)), "sources")
    huge = cut(inside.groupBy(*ring).agg(F.count("*").alias("_m")).filter(F.col("_m") > whole).select(*ring), "huge")
    kinds, one = dict(inside.dtypes), lambda x: x.join(huge, ring, "left_anti").groupBy(*ring)
    passed = one(inside).cogroup(one(sources)).applyInPandas(lambda e, s: ring_paths(e, s), f"{BY} {kinds[BY]}, ring {kinds['ring']}, node {kinds['u']}, passed double")
    if not huge.isEmpty():
        passed = passed.unionByName(_passed_by_layers(inside.join(huge, ring, "left_semi"), sources.join(huge, ring, "left_semi")))
    summed = sized.select(*ring, "node", F.lit(0.0).alias("passed")).unionByName(passed)
    total = summed.groupBy(*ring, "node").agg(F.sum("passed").alias("passed")).join(sized, [*ring, "node"])
    return total.select(*ring, "node", F.coalesce(F.try_divide("passed", (F.col("n") - 1) * (F.col("n") - 2)), F.lit(0.0)).alias("betweenness"))


def _passed_by_layers(inside: DataFrame, sources: DataFrame) -> DataFrame:
    """``snapshot_end, ring, node, passed`` from distinct pairs ``u, v`` of each ring.

    All sources search at once: a layer is a table of nodes with their distance's path counts, joined
    with the edges to give the next, and walked back the same way.
    """
    ring = [BY, "ring"]
    step = cut(inside.select(*ring, F.col("u").alias("node"), F.col("v").alias("other")).unionByName(inside.select(*ring, F.col("v").alias("node"), F.col("u").alias("other"))))
    key = [*ring, "source", "node"]
    layers = [cut(sources.select(*ring, F.col("node").alias("source"), "node", "scale", F.lit(1.0).alias("paths")))]
    while True:
        reached = layers[-1].join(step, [*ring, "node"]).groupBy(*ring, "source", "scale", F.col("other").alias("node")).agg(F.sum("paths").alias("paths"))
        for seen in layers[-2:]:  # a neighbour of a layer lies in it, in the one before or in the next
            reached = reached.join(seen.select(*key), key, "left_anti")
        following = cut(reached.select(*key, "scale", "paths"))
        if following.isEmpty():
            break
        layers.append(following)
    carried = layers[-1].withColumn("carried", F.lit(0.0))
    out = carried.select(*ring, "node", F.lit(0.0).alias("passed"))
    for before in layers[-2::-1]:
        out = out.unionByName(carried.select(*ring, "node", (F.col("carried") * F.col("scale")).alias("passed")))
        back = carried.select(*ring, "source", "node", ((1 + F.col("carried")) / F.col("paths")).alias("share")).join(step, [*ring, "node"])
        given = before.select(*key).join(back.select(*ring, "source", F.col("other").alias("node"), "share"), key).groupBy(*key).agg(F.sum("share").alias("share"))
        carried = cut(before.join(given, key, "left").withColumn("carried", F.coalesce(F.col("paths") * F.col("share"), F.lit(0.0))).drop("share"))
    return out


def overlaps(a: DataFrame, b: DataFrame) -> DataFrame:
    """Overlap of every two rings that share an account: shared over the smaller size."""
    size = lambda x, n: x.groupBy(BY, "ring").agg(F.count("*").alias(n))
    shared = a.select(BY, "node", F.col("ring").alias("a")).join(b.select(BY, "node", F.col("ring").alias("b")), [BY, "node"]).groupBy(BY, "a", "b").agg(F.count("*").alias("shared"))
    sa, sb = size(a, "na").withColumnRenamed("ring", "a"), size(b, "nb").withColumnRenamed("ring", "b")
    return shared.join(sa, [BY, "a"]).join(sb, [BY, "b"]).withColumn("overlap", F.col("shared") / F.least("na", "nb"))


def recovery(detected: DataFrame, truth: DataFrame, threshold: float) -> DataFrame:
    """How many detected rings match a reference ring, and the other way round."""
    o = overlaps(detected, truth).filter(F.col("overlap") >= threshold)
    n = lambda x, name: x.select(BY, "ring").distinct().agg(F.count("*").alias(name))
    hit = o.agg(F.count_distinct(F.struct(BY, "a")).alias("detected_hit"), F.count_distinct(F.struct(BY, "b")).alias("truth_hit"))
    both = hit.crossJoin(n(detected, "detected")).crossJoin(n(truth, "truth"))  # one row each
    p, r = F.try_divide("detected_hit", "detected"), F.try_divide("truth_hit", "truth")
    return both.withColumns({"precision": p, "recall": r}).withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)))


def fingerprints(members: DataFrame) -> DataFrame:
    """``snapshot_end, ring, size, identity``: the same identity for the same members, whatever their snapshot or order.

    Two sums of 64-bit hashes and the size: tasks add up parts, and no member list is ever held. That two sets share one by
    chance is as likely as a clash of 128-bit hashes.
    """
    return members.groupBy(BY, "ring").agg(F.count("*").alias("size"), identity().alias("identity"))


def identity() -> Column:
    """The identity of a group of members, as an aggregate."""
    part = lambda seed: F.sum(F.xxhash64(F.lit(seed), F.col("node")).cast("decimal(38,0)")).cast("string")
    return F.concat_ws(":", F.count("*").cast("string"), part(1), part(2))


def identities(members: DataFrame) -> DataFrame:
    """A row for each member set: its name, size, first and last snapshot, and in how many it is a ring."""
    seen = fingerprints(members).groupBy("identity")
    return seen.agg(F.min("ring").alias("ring"), F.min("size").alias("size"), F.min(BY).alias("first_seen"), F.max(BY).alias("last_seen"), F.count("*").alias("snapshots"))


def recovery_by_identity(detected: DataFrame, truth: DataFrame, thresholds: tuple[float, ...] = (0.3, 0.5, 0.7)) -> DataFrame:
    """Precision, recall and F1 at each overlap, a ring counted once however many snapshots it lives through.

    Rings are matched within a snapshot; a ring is found if it is in any. ``best`` marks the highest F1, ties to the smaller overlap.
    """
    of = lambda x, ring, name: fingerprints(x).select(BY, F.col("ring").alias(ring), F.col("identity").alias(name))
    a, b = cut(of(detected, "a", "_a"), "identities"), cut(of(truth, "b", "_b"), "identities")
    grid = F.explode(F.array(*[F.lit(t) for t in thresholds])).alias("threshold")
    met = overlaps(detected, truth).select(BY, "a", "b", "overlap", grid).filter(F.col("overlap") >= F.col("threshold")).join(a, [BY, "a"]).join(b, [BY, "b"])
    hit = met.groupBy("threshold").agg(F.count_distinct("_a").alias("detected_hit"), F.count_distinct("_b").alias("truth_hit"))
    sizes = a.agg(F.count_distinct("_a").alias("detected")).crossJoin(b.agg(F.count_distinct("_b").alias("truth")))  # one row each
    out = sizes.select("*", grid).join(hit, "threshold", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("detected_hit", "truth_hit")})
    share = lambda x, y: F.coalesce(F.try_divide(x, y), F.lit(0.0))
    out = out.withColumns({"precision": share("detected_hit", "detected"), "recall": share("truth_hit", "truth")})
    out = out.withColumn("f1", share(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc("f1"), "threshold")  # a row a threshold
    return out.withColumn("best", F.row_number().over(order) == 1)


def first_occurrences(members: DataFrame, least_overlap: float = 0.5) -> DataFrame:
    """Rings that do not repeat an earlier kept one. Greedy in time.

    Which rings repeat which is found in one join of the members; what is left to decide is a row a pair of rings. A ring without an
    earlier one is kept, what repeats a kept one goes, and so on with the rest: never more rounds than snapshots.
    """
    rows = cut(members)
    at = lambda e, ring: [F.col(BY).alias(e), F.col("ring").alias(ring)]
    size = rows.groupBy(BY, "ring").agg(F.count("*").alias("n"))
    met = rows.select("node", *at("_at", "a")).join(rows.select("node", *at("_e", "b")), "node").filter("_e < _at").groupBy("_at", "a", "_e", "b").agg(F.count("*").alias("shared"))
    sized = met.join(size.select(*at("_at", "a"), F.col("n").alias("na")), ["_at", "a"]).join(size.select(*at("_e", "b"), F.col("n").alias("nb")), ["_e", "b"])
    pairs = cut(sized.filter(F.col("shared") >= least_overlap * F.least("na", "nb")).select("_at", "a", "_e", "b"), "repeats")
    later, earlier = ["_at", "a"], ["_e", "b"]
    as_earlier = lambda x: x.select(F.col("_at").alias("_e"), F.col("a").alias("b"))
    still = cut(pairs.select(*later).distinct(), "open")
    fresh = cut(size.select(*at("_at", "a")).join(still, later, "left_anti"), "kept")
    kept = fresh
    while not still.isEmpty():
        gone = cut(pairs.join(as_earlier(fresh), earlier, "left_semi").select(*later).distinct(), "gone")
        pairs = cut(pairs.join(gone, later, "left_anti").join(as_earlier(gone), earlier, "left_anti"), "repeats")
        still = still.join(gone, later, "left_anti")
        fresh = cut(still.join(pairs.select(*later).distinct(), later, "left_anti"), "kept")
        kept, still = kept.unionByName(fresh), cut(still.join(fresh, later, "left_anti"), "open")
    return rows.join(kept.select(F.col("_at").alias(BY), F.col("a").alias("ring")), [BY, "ring"], "left_semi").select(*members.columns)


def score_table(scored: DataFrame) -> DataFrame:
    """An account's best score and the ring that gave it; ties to the smaller ring."""
    w = Window.partitionBy(BY, "node").orderBy(F.desc("score"), "ring")
    return scored.withColumn("_n", F.row_number().over(w)).filter("_n = 1").select(BY, "node", "score", "ring", "size")


def looked_up(asked: DataFrame, scores: DataFrame, seen: DataFrame) -> DataFrame:
    """Score or one of two abstentions: never seen, or seen but in no ring. An abstention is null, not 0."""
    known = seen.select(BY, "node").distinct().withColumn("_s", F.lit(True))
    out = asked.join(scores, [BY, "node"], "left").join(known, [BY, "node"], "left")
    return out.withColumn("reason", F.when(F.col("score").isNotNull(), "scored").when(F.col("_s"), "no_ring").otherwise("never_seen")).drop("_s")


def exposure(flows: DataFrame, members: DataFrame) -> DataFrame:
    """Amount of each ring, every flow once: the origin's ring first, else the other end's."""
    of = lambda end, name: members.select(BY, F.col("node").alias(end), F.col("ring").alias(name))
    both = flows.join(of("src", "r1"), [BY, "src"], "left").join(of("dst", "r2"), [BY, "dst"], "left")
    return both.withColumn("ring", F.coalesce("r1", "r2")).filter(F.col("ring").isNotNull()).groupBy(BY, "ring").agg(F.count("*").alias("flows"), F.sum("amount").alias("amount"))


def ring_page(scored: DataFrame, threshold: float, least: int, limit: int, offset: int = 0, members: int = 200) -> DataFrame:
    """A page of flagged rings, largest first, with at most ``members`` accounts each."""
    w = Window.partitionBy(BY, "ring").orderBy(F.desc("score"), "node")
    ranked = scored.filter((F.col("score") >= threshold) & (F.col("size") >= least)).withColumn("_n", F.row_number().over(w))
    rings = ranked.groupBy(BY, "ring").agg(F.max("size").alias("size"), F.max("score").alias("score"), F.sort_array(F.collect_list(F.when(F.col("_n") <= members, F.col("node")))).alias("accounts"))
    return rings.orderBy(F.desc("size"), BY, "ring").offset(offset).limit(limit)


def flagged(scored: DataFrame, threshold: float, drivers: dict[str, Column]) -> DataFrame:
    """Rings at or above the threshold, with what speaks for it."""
    reasons = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in drivers.items()]))
    return scored.withColumn("flagged", F.col("score") >= threshold).withColumn("drivers", reasons)


def split_of(members: DataFrame, train_end: float, val_end: float) -> DataFrame:
    """A ring's split by its snapshot's end; an end on the cut belongs to the earlier split."""
    return members.withColumn("split", F.when(F.col(BY) <= train_end, "train").when(F.col(BY) <= val_end, "val").otherwise("test"))
