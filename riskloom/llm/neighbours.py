"""Approximate nearest neighbours by an inverted multi-index.

Vectors are cut in two halves, each quantised by its own codebook; a cell is a pair of centroids. A
query walks the pairs in order of summed nearness with a heap until the cells seen hold enough
distinct vectors, and every entry of those cells is scored exactly. How many are enough is found
beforehand: a bounded number of probe queries is searched exhaustively, and the walk is made long
enough that its cells hold the wanted share of the true neighbours.

Cells are put together into units of about ``BLOCK`` entries, and a cell with more is cut into
several. An entry goes to its one unit, a query to the units of the cells it walked; a task holds a unit's entries
while the queries stream past them.

Nearness is the inner product in double precision. Defined results: rows without an id, and vectors that
are null, all zero, of another length than most, or hold a null or non-finite component take no part; ties go to
the smaller id, also between repeated rows, which are all candidates; rows with a query's own id are never its neighbours; with fewer candidates than
asked for all are returned; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import fixed_sample, slots_for, table, written

#: Rows the codebooks are fitted on at most, and queries searched exhaustively; dealt by a hash of the id.
SAMPLE_ROWS, PROBES = 10_000, 100
#: Centroids of a half grow with the root of the table, up to these: a million cells are known to the driver.
MOST_CENTROIDS = 1_024
#: Entries of a unit, and queries compared with one at once; they bound a task's matrix.
BLOCK, QUERIES = 4_096, 256
#: Share of true neighbours the walk has to reach on the probes.
RECALL = 0.96
TOP = 20


@dataclass(frozen=True)
class Index:
    first: np.ndarray
    second: np.ndarray
    #: of each cell: distinct vectors, the unit it is in or begins, and the units it takes
    distinct: np.ndarray
    unit: np.ndarray
    parts: np.ndarray

    def codes(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        half = self.first.shape[1]
        return nearest(vectors[:, :half], self.first), nearest(vectors[:, half:], self.second)


def nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return ((centroids**2).sum(1) - 2 * (x @ centroids.T)).argmin(1)


def codebook(x: np.ndarray, k: int, rounds: int = 15, seed: int = 3) -> np.ndarray:
    distinct = np.unique(x, axis=0)
    k = min(k, len(distinct))
    centroids = distinct[np.random.default_rng(seed).choice(len(distinct), k, replace=False)].copy()
    for _ in range(rounds):
        at = nearest(x, centroids)
        order = np.argsort(at, kind="stable")
        here, first = np.unique(at[order], return_index=True)
        centroids[here] = np.add.reduceat(x[order], first) / np.diff(np.append(first, len(x)))[:, None]
    return centroids


def units(held: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """For each cell, by its entries: its unit (the first of several) and how many it takes."""
    parts = np.maximum(1, -(-held // most))
    unit, now, full = np.zeros(len(held), np.int64), 0, 0
    for c, (n, p) in enumerate(zip(held.tolist(), parts.tolist(), strict=True)):
        if full and full + n > most:
            now, full = now + 1, 0
        unit[c] = now
        now, full = (now + p, 0) if p > 1 else (now, full + n)
    return unit, parts


def walk(index: Index, query: np.ndarray):
    """Numbers of the cells in order of ``query . centroid pair``, by a heap over the two sorted lists."""
    half = index.first.shape[1]
    s1, s2 = index.first @ query[:half], index.second @ query[half:]
    o1, o2 = np.argsort(-s1, kind="stable").tolist(), np.argsort(-s2, kind="stable").tolist()
    r1, r2 = s1[o1].tolist(), s2[o2].tolist()
    heap = [(-(r1[0] + r2[0]), 0, 0)]
    while heap:
        _, a, b = heapq.heappop(heap)
        yield o1[a] * len(index.second) + o2[b]
        if a + 1 < len(o1) and b == 0:
            heapq.heappush(heap, (-(r1[a + 1] + r2[0]), a + 1, 0))
        if b + 1 < len(o2):
            heapq.heappush(heap, (-(r1[a] + r2[b + 1]), a, b + 1))


def usable(vectors: DataFrame, id_column: str, vector: str) -> DataFrame:
    v = F.col(vector).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.select(F.col(id_column).cast("long").alias("vec_id"), v.alias("v")).filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & F.coalesce(fine, F.lit(False)))


def matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def best_of(queries: np.ndarray, ids: np.ndarray, entries: np.ndarray, entry_ids: np.ndarray, allowed: np.ndarray | None, top: int):
    """``(query row, entry row, score)`` of the best entries of each query, ties to the smaller id.

    A fast product picks rows, with a margin for its rounding; a product whose rounding does not
    depend on where a row stands gives the scores, so that equal vectors tie exactly.
    """
    rough = queries @ entries.T
    rough[ids[:, None] == entry_ids[None, :]] = -np.inf
    if allowed is not None:
        rough[~allowed] = -np.inf
    out = []
    margin = 1e-9 * (1 + np.abs(rough, where=np.isfinite(rough), out=np.zeros_like(rough)).max(initial=0.0))
    for q in range(len(queries)):
        row = rough[q]
        bar = -np.inf if len(row) <= top else np.partition(row, len(row) - top)[len(row) - top] - margin
        at = np.flatnonzero((row >= bar) & (row > -np.inf))
        score = np.einsum("ij,j->i", entries[at], queries[q], optimize=False)
        order = np.lexsort((entry_ids[at], -score))[:top]
        out.append((np.full(len(order), q), at[order], score[order]))
    return [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0, int), np.zeros(0, int), np.zeros(0)]


def ranked(found: DataFrame, top: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order).cast("int")).filter(F.col("rank") <= top)


def search(vectors: DataFrame, id_column: str = "vec_id", vector: str = "embedding", every: int = 20, top: int = TOP, recall: float = RECALL) -> DataFrame:
    """``query_id, rank, vec_id, score``; queries are the rows whose id ``every`` divides."""
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    rows = usable(vectors, id_column, vector)
    sample = fixed_sample(rows, ["vec_id"], SAMPLE_ROWS).toPandas()
    if sample.empty:
        return spark.createDataFrame([], schema)
    lengths = sample["v"].map(len)
    width = int(lengths.mode()[0])
    rows = rows.filter(F.size("v") == width)
    x = np.stack(sample["v"][lengths == width].to_numpy())
    total = rows.count()
    k = int(min(MOST_CENTROIDS, max(4, round((total / 50) ** 0.5))))
    half = width // 2 if width > 1 else 1
    second = codebook(x[:, half:], k) if width > 1 else np.zeros((1, 0))
    none, n_second = np.zeros(0, np.int64), len(second)
    books = Index(codebook(x[:, :half], k), second, none, none, none)
    shared_books = spark.sparkContext.broadcast(books)  # MOST_CENTROIDS a half at most

    def code(batches):
        for b in batches:
            c1, c2 = shared_books.value.codes(matrix(b.column("v")))
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("v"), pa.array(c1 * n_second + c2, pa.int32())], names=["vec_id", "v", "cell"])

    entries = written(rows.mapInArrow(code, "vec_id long, v array<double>, cell int"), "entries")
    # copies of one vector count once, so that a hot vector cannot use up a walk
    per_cell = entries.groupBy("cell", F.xxhash64("v").alias("h")).count().groupBy("cell").agg(F.count("*").alias("d"), F.sum("count").alias("n")).toPandas()  # k * k rows
    distinct, held = np.zeros((2, len(books.first) * n_second), np.int64)
    distinct[per_cell["cell"]], held[per_cell["cell"]] = per_cell["d"], per_cell["n"]
    index = Index(books.first, books.second, distinct, *units(held, BLOCK))
    enough = walk_length(entries, index, every, top, recall)
    shared = spark.sparkContext.broadcast(index)  # k * k cells
    types = "query boolean, id long, v array<double>, unit long, cells array<int>"

    def place(batches):
        """Each entry with its unit; each query with every unit that it walks through."""
        own = shared.value
        for b in batches:
            ids, vectors, cell = b.column("vec_id").to_numpy(), matrix(b.column("v")), b.column("cell").to_numpy()
            # a cell's copies are dealt over its units by id; the parts of all other cells are one
            unit = own.unit[cell] + (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % own.parts[cell]
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(ids), bool)), b.column("vec_id"), b.column("v"), pa.array(unit), pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1), pa.int32()), b.column("cell"))], names=["query", "id", "v", "unit", "cells"])
            at, to, walked = [], [], []
            for i in np.flatnonzero(ids % every == 0).tolist():
                seen, by_unit = 0, {}
                for c in walk(own, vectors[i]):
                    if own.distinct[c]:
                        for u in range(own.unit[c], own.unit[c] + own.parts[c]):
                            by_unit.setdefault(u, []).append(c)
                        seen += int(own.distinct[c])
                        if seen >= enough:
                            break
                at += [i] * len(by_unit)
                to += by_unit.keys()
                walked += by_unit.values()
                if len(at) > BLOCK:
                    yield queries_at(b, at, to, walked)
                    at, to, walked = [], [], []
            yield queries_at(b, at, to, walked)

    def queries_at(b, at, to, walked):
        at = pa.array(at, pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(np.ones(len(at), bool)), b.column("vec_id").take(at), b.column("v").take(at), pa.array(to, pa.int64()), pa.array(walked, pa.list_(pa.int32()))], names=["query", "id", "v", "unit", "cells"])

    def compare(batches):
        """Of each unit first its entries, held together, then its queries, as they come."""
        now, ids, v, cell, kept = None, None, None, None, []
        for b in batches:
            unit, asks = b.column("unit").to_numpy(), b.column("query").to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((unit[1:] != unit[:-1]) | (asks[1:] != asks[:-1])) + 1
            for a, z in zip([0, *cuts.tolist()], [*cuts.tolist(), len(unit)], strict=True):
                part = b.slice(a, z - a)
                if not part.num_rows:
                    continue
                if unit[a] != now:
                    now, ids, kept = unit[a], None, []
                if not asks[a]:
                    kept.append(part)
                    continue
                if not kept:
                    continue  # no entry fell into this part of a cell
                if ids is None:
                    ids = np.concatenate([x.column("id").to_numpy() for x in kept])
                    v = np.concatenate([matrix(x.column("v")) for x in kept])
                    cell = np.concatenate([x.column("cells").flatten().to_numpy() for x in kept])
                for s in range(0, part.num_rows, QUERIES):
                    some = part.slice(s, QUERIES)
                    local, number = np.unique(cell, return_inverse=True)
                    wanted = np.zeros((some.num_rows, len(local)), bool)
                    for i, cells in enumerate(some.column("cells").to_pylist()):
                        wanted[i, np.searchsorted(local, np.intersect1d(cells, local))] = True
                    asked = some.column("id").to_numpy()
                    q, at, score = best_of(matrix(some.column("v")), asked, v, ids, wanted[:, number], top)
                    yield pa.RecordBatch.from_arrays([pa.array(asked[q], pa.int64()), pa.array(ids[at], pa.int64()), pa.array(score)], names=["query_id", "vec_id", "score"])

    placed = entries.mapInArrow(place, types).repartition(slots_for(entries), "unit").sortWithinPartitions("unit", "query")
    found = placed.mapInArrow(compare, "query_id long, vec_id long, score double")
    return ranked(found, top).select("query_id", "rank", "vec_id", "score")


def walk_length(entries: DataFrame, index: Index, every: int, top: int, recall: float) -> int:
    """Distinct vectors a walk must see before its cells hold ``recall`` of the probes' true neighbours."""
    probes = fixed_sample(entries.filter(F.col("vec_id") % every == 0).select("vec_id", "v"), ["vec_id"], PROBES).toPandas()
    if probes.empty:
        return 1
    asked, asked_ids = np.stack(probes["v"].to_numpy()), probes["vec_id"].to_numpy()

    def exhaustive(batches):
        for b in batches:
            ids, cell = (b.column(c).to_numpy() for c in ("vec_id", "cell"))
            e = matrix(b.column("v"))
            for s in range(0, len(e), BLOCK):
                q, at, score = best_of(asked, asked_ids, e[s : s + BLOCK], ids[s : s + BLOCK], None, top)
                yield pa.RecordBatch.from_arrays([pa.array(asked_ids[q]), pa.array(ids[s + at]), pa.array(score), pa.array(cell[s + at])], names=["query_id", "vec_id", "score", "cell"])

    true = ranked(entries.mapInArrow(exhaustive, "query_id long, vec_id long, score double, cell int"), top)
    cells: dict[int, list[int]] = {}
    for r in true.select("query_id", "cell").collect():  # PROBES * top rows
        cells.setdefault(r[0], []).append(r[1])
    needed = []
    for i, q in enumerate(asked_ids.tolist()):
        wanted, seen = cells.get(q, []), 0
        reach = {}
        for cell in walk(index, asked[i]):
            seen += int(index.distinct[cell])
            if cell in wanted:
                reach[cell] = seen
        needed += [reach[c] for c in wanted]
    return int(np.quantile(needed, recall)) + 1 if needed else 1


def op5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"))
