"""Connected components of an edge table by contraction: every round a vertex joins the least one around it, and what joined is one vertex.

Tasks keep a spanning forest of their own edges before each round, in portions of ``PORTION``; where that many edges or fewer are left in all,
one portion ends the search. So a task holds ``PORTION`` edges at most, whatever the graph.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions.shared import cut

#: Edges that a task looks at together: 8 MB of ids.
PORTION = 500_000


def _shuffled(x: Column) -> Column:
    """Another order of all longs, one to one: shifts and exclusive ors alone, as each is undone by another."""
    x = x.bitwiseXOR(F.shiftleft(x, 13))
    x = x.bitwiseXOR(F.shiftrightunsigned(x, 7))
    return x.bitwiseXOR(F.shiftleft(x, 17))


def rooted(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every vertex of some edges with the least one that they tie it to."""
    names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    tied(up := np.arange(len(names)), *np.split(at, 2))
    return names, names[up]


def tied(up: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """The roots ``up`` of all vertices, which are their own at first, after some more edges; the least of a tree is its root."""
    while True:
        low, high = np.minimum(up[a], up[b]), np.maximum(up[a], up[b])
        open_ = low < high
        if not open_.any():
            return
        a, b = a[open_], b[open_]
        np.minimum.at(up, high[open_], low[open_])
        while (up[up] != up).any():
            up[:] = up[up]


def _portions(names: list[str], loops: bool):
    """Edges ``a, b`` of a task as ``rooted`` vertices, roots themselves only with ``loops``."""

    def run(batches):
        held, n = [], 0

        def done():
            id_, up = rooted(*(np.concatenate([h[i] for h in held]) for i in (0, 1)))
            keep = slice(None) if loops else id_ != up
            return pa.RecordBatch.from_arrays([pa.array(id_[keep]), pa.array(up[keep])], names=names)

        for batch in batches:
            held.append([batch.column(c).to_numpy() for c in ("a", "b")])
            n += batch.num_rows
            if n >= PORTION:
                yield done()
                held, n = [], 0
        if n:
            yield done()

    return run


def _forest(edges: DataFrame) -> DataFrame:
    """Edges that join what the edges of a portion join, fewer than it has vertices; no vertex is lost."""
    return edges.mapInArrow(_portions(["a", "b"], False), "a long, b long")


def _named(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges between 64-bit hashes, and ``node, id``; hashed anew until no two nodes share one."""
    pairs = edges.select("src", "dst").filter("src <> dst")
    nodes = cut(pairs.select(F.explode(F.array("src", "dst")).alias("node")).distinct(), "nodes")
    for seed in range(100):
        of = lambda c: F.xxhash64(F.lit(seed), F.col(c))  # noqa: E731, B023
        ids = nodes.select("node", of("node").alias("id"))
        if ids.groupBy("id").count().filter("count > 1").isEmpty():
            return cut(_forest(pairs.select(of("src").alias("a"), of("dst").alias("b")))), ids
    raise RuntimeError("nodes of equal hash under every seed")


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``node, component`` for every end of ``edges(src, dst)``; a component is named by its least node.

    Any orderable type serves as a node, structs too, so that many graphs run as one. Each round orders the
    vertices anew, ties each to the least of itself and its neighbours, and keeps a forest of the distinct edges between
    what is left, so that the tables shrink from round to round; a component that is one vertex has no edge and leaves.
    ``edges`` is read twice.
    """
    now, ids = _named(edges)
    levels = []
    while left := now.count():
        if left <= PORTION:
            levels.append(cut(now.coalesce(1).mapInArrow(_portions(["id", "up"], True), "id long, up long")))
            break
        if len(levels) == rounds:
            raise RuntimeError(f"edges are left after {rounds} rounds")
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(F.col("a").alias("id")).agg(F.min(_shuffled(F.col("b"))).alias("least"))
        level = cut(least.select("id", F.least("least", _shuffled(F.col("id"))).alias("up")))
        of = lambda c: level.select(F.col("id").alias(c), F.col("up").alias(f"up_{c}"))  # noqa: E731, B023
        tied = now.join(of("a"), "a").join(of("b"), "b").filter("up_a <> up_b")
        now = cut(_forest(tied.select(F.least("up_a", "up_b").alias("a"), F.greatest("up_a", "up_b").alias("b")).distinct()))
        levels.append(level)
    if not levels:
        return ids.select("node", F.col("node").alias("component"))
    root = None
    for depth, level in reversed(list(enumerate(levels))):
        # a root is known by the round it was left in as well, since each round has names of its own
        own = F.struct(F.lit(depth).alias("depth"), F.col("up").alias("id"))
        root = level.select("id", own.alias("root")) if root is None else level.join(root.withColumnRenamed("id", "up"), "up", "left").select("id", F.coalesce("root", own).alias("root"))
    found = cut(ids.join(root, "id").select("node", "root"))
    return found.join(found.groupBy("root").agg(F.min("node").alias("component")), "root").select("node", "component")
