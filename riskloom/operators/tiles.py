"""Graphs of flows and chained transfers by tiles: accounts are dealt into blocks, and a task meets the rows of two blocks of one graph.

An edge lies in the one tile of its ends, so a tile counts distinct edges by itself, and pairs are neither shuffled nor written: what is
shuffled are rows, once for each block of their graph. A graph has a block for every ``ROWS`` rows, a task two blocks and ``PAIRS`` pairs at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, GroupedData
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.functions.shared import cut

from .components import tied
from .portions import _stretches
from .rings import BY, shaped, snapshot_components

#: Rows of a block: some 20 MB.
ROWS = 1 << 19
#: Pairs that a task holds at a time: some 150 MB while they are sorted.
PAIRS = 1 << 21
#: Rows whose reach is looked up together, and rows of a batch of edges.
_TOGETHER, _BATCH = 1 << 13, 1 << 16
_TRANSFER, _CASH_OUT, _FLOW, _MARK = range(4)
#: Steps and tolerance of a graph, by its ``snapshot_end``.
Reach = Callable[[object], tuple[int, float]]
_TILE = ("_graph", "_i", "_j")


def _dealt(flows: DataFrame, transfers: DataFrame, cash_outs: DataFrame, reach: Reach, rows: int, marked: DataFrame | None = None) -> tuple[GroupedData, T.StructType, DataFrame, dict, bool]:
    """All rows by number of their graph and tile ``_i <= _j``, with ``far``: their account is in block ``_j`` of two.

    The schema of the rows, the graphs by number, whether each has one block and its reach, and whether any graph has more.
    """
    kind, none = lambda k: F.lit(k).cast("byte").alias("kind"), lambda t: F.lit(None).cast(t)
    number = F.col("candidate_count").cast("long") if "candidate_count" in transfers.columns else none("long")
    row = lambda df, k, n: df.select(BY, kind(k), F.col("account_id").alias("node"), none(dict(df.dtypes)["account_id"]).alias("other"), F.col("step").cast("long").alias("step"), F.col("amount").cast("double").alias("amount"), n.alias("n")).filter("node IS NOT NULL AND step IS NOT NULL AND amount IS NOT NULL")
    flow = flows.filter("src <> dst").select(BY, kind(_FLOW), F.col("src").alias("node"), F.col("dst").alias("other"), none("long").alias("step"), none("double").alias("amount"), none("long").alias("n"))
    every = row(transfers, _TRANSFER, number).unionByName(row(cash_outs, _CASH_OUT, none("long"))).unionByName(flow)
    if marked is not None:
        every = every.unionByName(marked.select(BY, kind(_MARK), F.col("account_id").alias("node")).filter("node IS NOT NULL").distinct(), allowMissingColumns=True)
    every = cut(every, "dealt")
    # flows go to one tile of all, marks to one of a block's
    of = lambda *kinds: F.count_if(F.col("kind").isin(*kinds)) / rows
    sizes = every.groupBy(BY).agg(F.ceil(F.greatest(of(_TRANSFER, _CASH_OUT), of(_MARK), F.sqrt(of(_FLOW)))).cast("int").alias("_blocks"))
    found = sizes.collect()  # a row a graph
    graphs = every.sparkSession.createDataFrame([(i, *r) for i, r in enumerate(found)], T.StructType([T.StructField("_graph", T.IntegerType()), *sizes.schema.fields]))
    tiles, most = sum(r["_blocks"] * (r["_blocks"] + 1) // 2 for r in found), max((r["_blocks"] for r in found), default=1)
    block = lambda c: F.pmod(F.xxhash64(c), F.col("_blocks")).cast("int")
    met = F.explode(F.when(F.col("kind") >= _FLOW, F.array(block(F.coalesce("other", "node")))).otherwise(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    out = every.join(F.broadcast(graphs), BY).withColumn("_own", block("node")).withColumn("_met", met)
    out = out.select("_graph", *every.columns[1:], F.least("_own", "_met").alias("_i"), F.greatest("_own", "_met").alias("_j"), (F.col("_own") > F.col("_met")).alias("far"))
    # dealt by number, as a tile is work whatever its bytes
    dealt = out.repartition(min(2 * max(tiles, 1), 4096), *_TILE).groupBy(*_TILE)
    return dealt, every.schema, graphs, {i: (r["_blocks"] == 1, reach(r[BY])) for i, r in enumerate(found)}, most > 1


def _numbered(node: pa.ChunkedArray, other: pa.ChunkedArray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The accounts in order, and the place of every row's ``node`` and ``other`` among them."""
    found = pa.concat_arrays([*node.chunks, *other.chunks]).dictionary_encode()
    order = pc.array_sort_indices(found.dictionary)
    place = np.empty(len(order), np.int64)
    place[order.to_numpy()] = np.arange(len(order))
    at = place[found.indices.fill_null(0).to_numpy(zero_copy_only=False)]
    return found.dictionary.take(order), at[: len(node)], at[len(node) :]


def _sorted(x: dict, amounts: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of step and amount in order, and the rows that have them."""
    key = (x["step"] - first) * (len(amounts) + 1) + np.searchsorted(amounts, x["amount"])
    return key[order := np.argsort(key, kind="stable")], order


def _ranges(x: dict, keys: np.ndarray, amounts: np.ndarray, low: np.ndarray, high: np.ndarray, first: int, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where rows of ``x`` find their equals in ``keys``, by step: start and size for each step and amount that they have, and which of them a row has.

    ``low`` and ``high``: the places of a row's reach among the other side's ``amounts``.
    """
    width = len(amounts) + 1
    own, rank = np.unique(x["amount"], return_inverse=True)
    _, some, of = np.unique((x["step"] - first) * len(own) + rank, return_index=True, return_inverse=True)
    start, size = np.zeros((2, len(some), len(reach)), np.int32)
    for i, shift in enumerate(reach):
        base = (x["step"][some] - first + shift) * width
        start[:, i] = np.searchsorted(keys, base + low[some])
        size[:, i] = np.maximum(np.searchsorted(keys, base + high[some]) - start[:, i], 0)
    return start, size, of


def _pairs(t: dict, c: dict, steps: int, tolerance: float, one: bool, weighted: bool = True) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray | None]]:
    """Accounts ``own`` in ascending order, ``other`` and, if ``weighted``, the transfer's ``n`` for every pair of the tile, at most ``PAIRS`` and one more range at a time.

    ``t``, ``c``: ``at, far, step, amount`` of transfers and cash-outs, and ``n`` of transfers. An own row looks at its ranges of amounts in the steps it
    reaches, transfers forward and cash-outs back. In a tile of ``one`` block every pair is met from both ends and kept from the lesser.
    """
    near, far = (lambda x: {k: v[~x["far"]] for k, v in x.items()}), (lambda x: x if one else {k: v[x["far"]] for k, v in x.items()})
    t0, c0, t1, c1 = near(t), near(c), far(t), far(c)
    t_amounts, c_amounts = np.unique(t1["amount"]), np.unique(c1["amount"])
    first = min((int(x["step"].min()) for x in (t1, c1) if len(x["at"])), default=0)
    (t_keys, t_order), (c_keys, c_order) = _sorted(t1, t_amounts, first), _sorted(c1, c_amounts, first)
    targets = np.concatenate([c1["at"][c_order], t1["at"][t_order]]).astype(np.int32)
    numbers = np.concatenate([np.zeros(len(c_keys), np.int64), t1["n"][t_order]])
    ahead, reach = t0["amount"], np.arange(steps + 1)
    forward = _ranges(t0, c_keys, c_amounts, np.searchsorted(c_amounts, ahead * (1 - tolerance)), np.searchsorted(c_amounts, ahead * (1 + tolerance), "right"), first, reach)
    behind = c0["amount"]
    back = _ranges(c0, t_keys, t_amounts, np.searchsorted(t_amounts * (1 + tolerance), behind), np.searchsorted(t_amounts * (1 - tolerance), behind, "right"), first, reach - steps)
    start, size_of = np.concatenate([forward[0], back[0] + np.int32(len(c_keys))]), np.concatenate([forward[1], back[1]])
    of = np.concatenate([forward[2], back[2] + len(forward[0])])
    at, n = np.concatenate([t0["at"], c0["at"]]).astype(np.int32), np.concatenate([t0["n"], np.zeros(len(c0["at"]), np.int64)])
    order = np.argsort(at, kind="stable")
    for i in range(0, len(order), _TOGETHER):
        rows = order[i : i + _TOGETHER]
        size = size_of[of[rows]].ravel()
        some = np.flatnonzero(size)
        whose, lo, size = rows[some // (steps + 1)], start[of[rows]].ravel()[some], size[some].astype(np.int64)
        ends, s = np.cumsum(size), 0
        while s < len(size):
            done = ends[s] - size[s]
            e = max(s + 1, int(np.searchsorted(ends, done + PAIRS, "right")))
            part, total = slice(s, e), ends[e - 1] - done
            where = np.arange(total) + np.repeat(lo[part] - (ends[part] - size[part] - done), size[part])
            own, other = np.repeat(at[whose[part]], size[part]), targets[where]
            keep = own < other if one else slice(None)
            number = np.maximum(np.repeat(n[whose[part]], size[part]), numbers[where])[keep] if weighted else None
            own, other = own[keep], other[keep]
            if len(own):
                yield own.astype(np.int64), other, number
            s = e


def _distinct(pairs: Iterator, bits: int, weighted: bool) -> Iterator[tuple]:
    """Edges ``own << bits | other`` in ascending order, each once; if ``weighted``, with the sum of their pairs' ``1 / n`` and their least ``n``.

    Of what was seen, only the last account's edges can come again.
    """
    held = (np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))
    for own, other, n in pairs:
        key = np.concatenate([held[0], own << bits | other])
        if weighted:
            order = np.argsort(key, kind="stable")
            first = _stretches(key := key[order])
            weight, least = np.concatenate([held[1], 1 / n])[order], np.concatenate([held[2], n])[order]
            seen = key[first], np.add.reduceat(weight, first), np.minimum.reduceat(least, first)
        else:
            key.sort()
            seen = (key[_stretches(key)],)
        last = np.searchsorted(seen[0], own[-1] << bits)
        yield tuple(x[:last] for x in seen)
        held = tuple(x[last:] for x in seen)
    yield held if weighted else held[:1]


class _Tile:
    """The rows of one tile: its accounts in order, its flows as edges with their counts, and its pairs."""

    def __init__(self, batches: Iterator[pa.RecordBatch], key: tuple, whole: bool, reach: tuple[int, float], weighted: bool):
        rows = pa.Table.from_batches(list(batches))
        self.names, node, other = _numbered(rows["node"], rows["other"])
        self.whole, marks = whole, rows["kind"].combine_chunks().to_numpy() == _MARK
        self.marked = np.bincount(node[marks], minlength=len(self.names)) > 0
        self.bits, self.one = max(1, int(len(self.names)).bit_length()), key[1].as_py() == key[2].as_py()
        flat = lambda c: rows[c].combine_chunks()
        kind, far = flat("kind").to_numpy(), flat("far").to_numpy(zero_copy_only=False)
        columns = {"at": node, "far": far, "step": flat("step").fill_null(0).to_numpy(), "amount": flat("amount").fill_null(0).to_numpy(), "n": flat("n").fill_null(0).to_numpy()}
        t, c = ({k: v[kind == x] for k, v in columns.items() if k != "n" or x == _TRANSFER} for x in (_TRANSFER, _CASH_OUT))
        a, b, far = (x[kind == _FLOW] for x in (node, other, far))
        turned = a > b if self.one else far
        self.flows, self.flow_count = np.unique(np.where(turned, b, a) << self.bits | np.where(turned, a, b), return_counts=True)
        self.pairs = _pairs(t, c, *reach, self.one, weighted)

    def ends(self, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return edges >> self.bits, edges & ((1 << self.bits) - 1)

    def met(self, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Flows that are among sorted ``edges``, and where there."""
        lo, hi = np.searchsorted(self.flows, edges[:1])[0] if len(edges) else 0, np.searchsorted(self.flows, edges[-1:], "right")[0] if len(edges) else 0
        at = np.searchsorted(edges, self.flows[lo:hi])
        both = edges[at] == self.flows[lo:hi]
        return np.flatnonzero(both) + lo, at[both]


def _batches(graph: pa.Scalar, columns: dict[str, pa.Array]) -> Iterator[pa.RecordBatch]:
    size = len(next(iter(columns.values())))
    for i in range(0, size, _BATCH):
        part = {k: v.slice(i, _BATCH) for k, v in columns.items()}
        yield pa.RecordBatch.from_arrays([pa.repeat(graph, min(_BATCH, size - i)), *part.values()], names=["_graph", *part])


def _by_graph(found: DataFrame, graphs: DataFrame) -> DataFrame:
    """A graph's ``snapshot_end`` in place of its number."""
    return found.join(F.broadcast(graphs.select("_graph", BY)), "_graph").select(BY, *found.columns[1:])


def edges(flows: DataFrame, transfers: DataFrame, cash_outs: DataFrame, reach: Reach, rows: int = ROWS) -> DataFrame:
    """``edges.merged_edges`` of the flows and of the chains that ``reach`` allows, a row a pair of accounts and graph.

    ``flows``: snapshot_end, src, dst; ``transfers``, ``cash_outs``: snapshot_end, account_id, step, amount, transfers with their ``candidate_count``.
    """

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile = _Tile(batches, key, *known[key[0].as_py()], True)
        alone = np.ones(len(tile.flows), bool)

        def rows_of(found, chain, count, weight, least):
            a, b = tile.ends(found)
            flag = lambda x: pa.array(np.broadcast_to(x, len(found)).copy())
            u, v = (tile.names.take(pa.array(x)) for x in (np.minimum(a, b), np.maximum(a, b)))
            return _batches(key[0], {"u": u, "v": v, "has_flow": flag(count > 0), "has_chain": flag(chain), "flow_count": pa.array(count), "chain_weight": pa.array(weight), "least_candidates": least, "corroborated": flag(chain & (count > 0))})

        for found, weight, least in _distinct(tile.pairs, tile.bits, True):
            flow, at = tile.met(found)
            alone[flow], count = False, np.zeros(len(found), np.int64)
            count[at] = tile.flow_count[flow]
            yield from rows_of(found, np.bool_(True), count, weight, pa.array(least))
        count = tile.flow_count[alone]
        yield from rows_of(tile.flows[alone], np.bool_(False), count.astype(np.int64), np.zeros(len(count)), pa.nulls(len(count), pa.int64()))

    dealt, of, graphs, known, _ = _dealt(flows, transfers, cash_outs, reach, rows)
    out = T.StructType([T.StructField("_graph", T.IntegerType()), *[T.StructField(c, of["node"].dataType) for c in "uv"]])
    for c, kind in (("has_flow", "boolean"), ("has_chain", "boolean"), ("flow_count", "long"), ("chain_weight", "double"), ("least_candidates", "long"), ("corroborated", "boolean")):
        out = out.add(c, kind)
    return _by_graph(dealt.applyInArrow(run, out), graphs)


def members(flows: DataFrame, transfers: DataFrame, cash_outs: DataFrame, reach: Reach, marked: DataFrame | None = None, rows: int = ROWS) -> DataFrame:
    """``snapshot_end, node, ring`` of the graphs of ``edges``, whose rows are never made, with what a node's edges say.

    A graph of one block has its rings from its task; others join the forests of their tiles.
    ``degree`` and ``chain_degree`` count an edge at both its ends; ``flows``, ``corroborated`` and ``least_candidates`` are of an edge at one of them, so that
    they can be summed by ring. Candidates need be no column of ``transfers``, and are null then. ``hit`` says that a row of ``marked`` (snapshot_end, account_id) names the node.
    """
    facts = ("degree", "chain_degree", "flows", "corroborated")
    weighted = "candidate_count" in transfers.columns

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile = _Tile(batches, key, *known[key[0].as_py()], weighted)
        size, alone = len(tile.names), np.ones(len(tile.flows), bool)
        up, (degree, flow_sum, both) = np.arange(size), np.zeros((3, size), np.int64)
        none = np.iinfo(np.int64).max
        least = np.full(size, none)

        def noted():
            for own, other, n in tile.pairs:
                if weighted:
                    first = _stretches(own)
                    least[own[first]] = np.minimum(least[own[first]], np.minimum.reduceat(n, first))
                yield own, other, n

        def seen(found):
            a, b = tile.ends(found)
            tied(up, a, b)
            return np.bincount(a, minlength=size) + np.bincount(b, minlength=size)

        for (found,) in _distinct(noted(), tile.bits, False):
            flow, _ = tile.met(found)
            alone[flow] = False
            degree += seen(found)
        chains = degree.copy()
        degree += seen(tile.flows[alone])
        at, _ = tile.ends(tile.flows)
        np.add.at(flow_sum, at, tile.flow_count)
        np.add.at(both, at[~alone], 1)
        kept = np.flatnonzero((degree > 0) | (tile.marked & (not tile.whole)))
        name = lambda x: tile.names.take(pa.array(x))
        yield from _batches(key[0], {"node": name(kept), "root": name(up[kept]), **{c: pa.array(x[kept]) for c, x in zip(facts, (degree, chains, flow_sum, both), strict=True)}, "least_candidates": pa.array(least[kept], mask=least[kept] == none), "hit": pa.array(tile.marked[kept]), "whole": pa.array(np.full(len(kept), tile.whole))})

    dealt, of, graphs, known, many = _dealt(flows, transfers, cash_outs, reach, rows, marked)
    out = T.StructType([T.StructField("_graph", T.IntegerType()), *[T.StructField(c, of["node"].dataType) for c in ("node", "root")]])
    for c in (*facts, "least_candidates"):
        out = out.add(c, "long")
    every = _by_graph(cut(dealt.applyInArrow(run, out.add("hit", "boolean").add("whole", "boolean")), "tiles"), graphs)
    whole = every.filter("whole").select(BY, "node", F.col("root").alias("ring"), *facts, "least_candidates", "hit")
    if not many:
        return whole
    parts = every.filter("NOT whole")
    ring = snapshot_components(parts.filter("node <> root").select(BY, F.col("node").alias("u"), F.col("root").alias("v")))
    at = parts.groupBy(BY, "node").agg(*[F.sum(c).alias(c) for c in facts], F.min("least_candidates").alias("least_candidates"), F.bool_or("hit").alias("hit"))
    return cut(ring.join(at, [BY, "node"]).select(*whole.columns).unionByName(whole), "members")


def _rings(members: DataFrame, least: int, more: tuple[Column, ...] = ()) -> DataFrame:
    out = members.groupBy(BY, "ring").agg(*more, F.bool_or("hit").alias("hit"), F.count("*").alias("size"), F.count_if(F.col("degree") >= 2).alias("_inner"), F.expr("sum(degree) div 2").alias("edges"), F.sum("flows").alias("flows"), F.expr("sum(chain_degree) div 2").alias("chains"), F.sum("corroborated").alias("corroborated"), F.min("least_candidates").alias("least_candidates"), F.max("degree").alias("max_degree"), F.avg("degree").alias("mean_degree"))
    return out.filter((F.col("size") >= least) & (F.col("_inner") >= 2)).drop("_inner")


def without_stars(members: DataFrame, least: int = 3) -> DataFrame:
    """``members`` of rings of ``least`` nodes or more in which two nodes have two neighbours each."""
    return members.join(_rings(members, least).select(BY, "ring"), [BY, "ring"], "left_semi")


def features(members: DataFrame, least: int = 3, more: tuple[Column, ...] = ()) -> DataFrame:
    """``rings.component_features`` of the rings of ``without_stars``, with ``more`` of their members: both ends of an edge are in one ring, so its edges are half its degrees."""
    return shaped(_rings(members, least, more))
