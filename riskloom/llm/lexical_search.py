"""Ranked lexical search with Block-Max MaxScore over an index of shards.

``build_index`` reads the texts once and writes a table. A shard is a stretch of documents of one task, bounded in bytes and
documents; each of its terms is a row: posting lists in compressed blocks of ``BLOCK`` documents, and of each block what bounds
its scores (least document length among postings of a few term frequencies, greatest frequency). A shard's lengths are one more row.
The bounds need no statistics of the collection, so index tables of more documents may be added by union.

``search`` takes the queries in blocks. Per shard and query, lists are added from the highest global bound to the lowest until
those left cannot lift a document over the heap's last score: these are the essential lists. For the candidates found, block
maxima of the other lists are added up first; only blocks of candidates that may still reach the heap are decompressed. A task
keeps one heap a query over all its shards, and the heaps are merged by rank.

Defined results: a null or empty text has no terms, is no document of the collection and is never found; texts, queries and
terms are read whole, at any length; equal scores go by the smaller ``doc_id``, null ids last; repeated rows are documents
each; of several texts of one item the smallest is asked; an item without terms, a term without documents and an empty table
give no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from array import array
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import table, written

TOP = 20
#: Postings a block; text bytes and documents a shard at most (one longer text is a shard alone).
BLOCK, SHARD_BYTES, SHARD_DOCS = 128, 1 << 24, 1 << 15
#: Queries searched in one pass, and bytes of their texts (one longer query is a pass alone).
ITEMS, ITEM_BYTES = 4_096, 1 << 22
#: ASCII letters lowered, other ASCII but digits a space; bytes of longer code points stay.
_TERM = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))
#: A block keeps the least length among postings of at least so many occurrences: [1, 2), [2, 4), [4, most].
LEVELS = (1, 2, 4)
_NONE = np.int32(2**31 - 1)
_FIELDS = 3 + len(LEVELS)  # last document, end of the bytes, most occurrences, least lengths
INDEX = "shard long, term string, docs long, terms long, blocks array<int>, payload binary, ids array<long>, lengths array<int>"


def terms_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_TERM).split()


def packed(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Seven bits a byte, low ones first, and where each value begins (one more at the end)."""
    size = 1 + sum((values >= 1 << s).astype(np.int64) for s in (7, 14, 21, 28))
    first = np.concatenate([[0], np.cumsum(size)])
    out = np.zeros(first[-1], np.uint8)
    for k in range(int(size.max(initial=0))):
        more = size > k
        out[first[:-1][more] + k] = (values[more] >> (7 * k)) & 127 | np.where(size[more] > k + 1, 128, 0)
    return out, first


def unpacked(raw: np.ndarray) -> np.ndarray:
    end = np.flatnonzero(raw < 128)
    if len(end) == len(raw):
        return raw.astype(np.int64)
    first = np.concatenate([[0], end[:-1] + 1])
    place = np.arange(len(raw)) - np.repeat(first, end - first + 1)
    return np.add.reduceat((raw & 127).astype(np.int64) << (7 * place), first)


def posting_lists(term: np.ndarray, doc: np.ndarray, tf: np.ndarray, lengths: np.ndarray, n_terms: int):
    """Of postings sorted by term and document: documents a term, block fields a term, bytes, first block and first byte of each term."""
    n = len(term)
    df = np.bincount(term, minlength=n_terms)
    first = np.concatenate([[0], np.cumsum(df)])[:-1]
    within = np.arange(n) - np.repeat(first, df)
    start = np.flatnonzero(within % BLOCK == 0)
    count = np.diff(np.append(start, n))
    gap = np.where(within == 0, doc + 1, doc - np.concatenate([[0], doc[:-1]]))
    s, c = np.repeat(start, count), np.repeat(count, count)
    values = np.empty(2 * n, np.int64)
    values[s + np.arange(n)] = gap
    values[s + c + np.arange(n)] = tf - 1
    raw, begins = packed(values)
    fields = np.empty((len(start), _FIELDS), np.int32)
    fields[:, 0] = doc[start + count - 1]
    n_blocks = -(-df // BLOCK)
    first_block = np.concatenate([[0], np.cumsum(n_blocks)])
    byte = begins[2 * np.append(start, n)]
    fields[:, 1] = byte[1:] - np.repeat(byte[first_block[:-1]], n_blocks)
    fields[:, 2] = np.maximum.reduceat(tf, start)
    for k, level in enumerate(LEVELS):
        below = LEVELS[k + 1] if k + 1 < len(LEVELS) else np.inf
        fields[:, 3 + k] = np.minimum.reduceat(np.where((tf >= level) & (tf < below), lengths[doc], _NONE), start)
    return df, fields, raw, first_block, byte[first_block]


def build_index(docs: DataFrame, shard_bytes: int = SHARD_BYTES, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """The index of all texts: a row for each shard and term, and one with the documents of each shard."""

    def rows(shard: int, ids: list, lengths: list[int], vocabulary: dict[bytes, int], owner: array, own: array, tf: array):
        names = sorted(vocabulary)
        number = np.empty(len(names), np.int64)
        number[[vocabulary[t] for t in names]] = np.arange(len(names))
        size, term = np.asarray(lengths, np.int64), number[np.frombuffer(own, np.int32)] if own else np.zeros(0, np.int64)
        order = np.argsort(term, kind="stable")
        null = pa.nulls(1)
        yield _batch(1, shard, null, [sum(n > 0 for n in lengths)], [int(size.sum())], null, null, pa.array([ids], pa.list_(pa.int64())), pa.array([lengths], pa.list_(pa.int32())))
        if not names:
            return
        df, fields, raw, block, byte = posting_lists(term[order], np.frombuffer(owner, np.int32)[order].astype(np.int64), np.frombuffer(tf, np.int32)[order].astype(np.int64), size, len(names))
        for a in range(0, len(names), 1 << 14):
            z = min(a + (1 << 14), len(names))
            part = pa.ListArray.from_arrays(pa.array((block[a : z + 1] - block[a]) * _FIELDS, pa.int32()), pa.array(fields[block[a] : block[z]].ravel()))
            offsets = pa.array(byte[a : z + 1] - byte[a], pa.int32()).buffers()[1]
            payload = pa.BinaryArray.from_buffers(pa.binary(), z - a, [None, offsets, pa.py_buffer(raw[byte[a] : byte[z]].tobytes())])
            yield _batch(z - a, shard, pa.array(names[a:z], pa.binary()).cast(pa.string()), df[a:z], pa.nulls(z - a), part, payload, pa.nulls(z - a), pa.nulls(z - a))

    def build(batches):
        from pyspark import TaskContext

        shard, size = TaskContext.get().partitionId() << 24, 0
        fresh = lambda: ([], [], {}, array("i"), array("i"), array("i"))
        ids, lengths, vocabulary, owner, own, tf = state = fresh()
        for b in batches:
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
                text = text.as_py() or ""
                if ids and (size + len(text) > shard_bytes or len(ids) == shard_docs):
                    yield from rows(shard, *state)
                    shard, size = shard + 1, 0
                    ids, lengths, vocabulary, owner, own, tf = state = fresh()
                words = terms_of(text)
                counts = Counter(words)
                owner.extend([len(ids)] * len(counts))
                own.extend([vocabulary.setdefault(t, len(vocabulary)) for t in counts])
                tf.extend(counts.values())
                ids.append(doc_id)
                lengths.append(len(words))
                size += len(text)
        if ids:
            yield from rows(shard, *state)

    return written(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(build, INDEX), "index")


def _batch(n: int, shard: int, *columns) -> pa.RecordBatch:
    types = (pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32()))
    arrays = [c.cast(t) if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, types, strict=True)]
    return pa.RecordBatch.from_arrays([pa.array([shard] * n, pa.int64()), *arrays], names=["shard", "term", "docs", "terms", "blocks", "payload", "ids", "lengths"])


@dataclass
class Query:
    item: int | None
    terms: list[tuple[str, int]]  # a term and its weight times its repeats


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


class PostingList:
    """One term's postings in a shard; blocks are decompressed when asked for."""

    def __init__(self, blocks: np.ndarray, payload: bytes, df: int, length_norm):
        f = blocks.reshape(-1, _FIELDS).astype(np.int64)
        self.last, self.end, self.raw, self.df = f[:, 0], f[:, 1], np.frombuffer(payload, np.uint8), df
        self.bound = np.zeros(len(f), np.int64)
        for k, level in enumerate(LEVELS):
            some = f[:, 3 + k] != _NONE
            top = f[:, 2] if k + 1 == len(LEVELS) else np.minimum(f[:, 2], LEVELS[k + 1] - 1)
            self.bound[some] = np.maximum(self.bound[some], impact(top[some], length_norm(f[some, 3 + k])))
        self.most = int(self.bound.max())
        self.known: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def block(self, b: int) -> tuple[np.ndarray, np.ndarray]:
        if b not in self.known:
            v = unpacked(self.raw[self.end[b - 1] if b else 0 : self.end[b]])
            n = len(v) // 2
            self.known[b] = np.cumsum(v[:n]) + (self.last[b - 1] if b else -1), v[n:] + 1
        return self.known[b]

    def all(self) -> tuple[np.ndarray, np.ndarray]:
        docs, tf = zip(*(self.block(b) for b in range(len(self.last))), strict=True)
        return np.concatenate(docs), np.concatenate(tf)

    def at(self, candidates: np.ndarray, block: np.ndarray, m: np.ndarray) -> np.ndarray:
        """Impacts in the candidates' blocks, 0 where a candidate is not in the list."""
        out = np.zeros(len(candidates), np.int64)
        for b in np.unique(block).tolist():
            if b < len(self.last):
                docs, tf = self.block(b)
                here = np.flatnonzero(block == b)
                at = np.minimum(np.searchsorted(docs, candidates[here]), len(docs) - 1)
                hit = docs[at] == candidates[here]
                out[here[hit]] = impact(tf[at[hit]], m[candidates[here[hit]]])
        return out


def shard_top(lists: list[tuple[int, PostingList]], m: np.ndarray, floor: int, k: int = TOP) -> tuple[np.ndarray, np.ndarray]:
    """Documents that may enter a heap whose last score is ``floor`` (with their exact scores), by Block-Max MaxScore."""
    lists = sorted(lists, key=lambda x: -x[0] * x[1].most)
    rest = np.append(np.cumsum([w * p.most for w, p in reversed(lists)])[::-1], 0)  # bounds from this list on
    score = np.zeros(len(m), np.int64)
    done = 0
    while done < len(lists) and rest[done] >= floor:
        w, p = lists[done]
        docs, tf = p.all()
        score[docs] += w * impact(tf, m[docs])
        done += 1
        if len(score) >= k:
            floor = max(floor, int(np.partition(score, len(score) - k)[len(score) - k]))
    found = np.flatnonzero((score > 0) & (score + rest[done] >= floor))
    own, others = score[found], lists[done:]
    where = [np.searchsorted(p.last, found) for _, p in others]
    most = [w * np.append(p.bound, 0)[b] for (w, p), b in zip(others, where, strict=True)]
    upper = own + sum(most)
    for j, (w, p) in enumerate(others):
        keep = upper >= floor
        found, own, upper = found[keep], own[keep], upper[keep]
        where, most = [b[keep] for b in where], [b[keep] for b in most]
        real = w * p.at(found, where[j], m)
        own, upper = own + real, upper - most[j] + real
        if len(own) >= k:
            floor = max(floor, int(np.partition(own, len(own) - k)[len(own) - k]))
    keep = own >= max(floor, 1)
    return found[keep], own[keep]


def first_ranks(score: np.ndarray, missing: np.ndarray, ids: np.ndarray, k: int = TOP) -> np.ndarray:
    return np.lexsort((ids, missing, -score))[:k]


def _search(shared):
    def run(batches):
        queries, n_docs, n_terms = shared.value
        heaps = [(np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64))] * len(queries)

        def take(rows: pa.Table) -> None:
            """All rows of one shard: its documents come first, as their term is null."""
            ids, sizes = rows.column("ids")[0].values, rows.column("lengths")[0].values.to_numpy()
            missing, ids = ids.is_null().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy()
            norm = lambda n: np.array([75 + 25 * x * n_docs // n_terms for x in n.tolist()], np.int64)
            m = norm(sizes)
            rows = rows.slice(1)
            lists = {
                t: PostingList(b.values.to_numpy(), p.as_py(), d, norm)
                for t, b, p, d in zip(rows.column("term").to_pylist(), rows.column("blocks"), rows.column("payload"), rows.column("docs").to_pylist(), strict=True)
            }
            for q, query in enumerate(queries):
                mine = [(w, lists[t]) for t, w in query.terms if w and t in lists]
                if mine:
                    score, none, own = heaps[q]
                    found, more = shard_top(mine, m, int(score[-1]) if len(score) == TOP else 1)
                    score, none, own = np.append(score, more), np.append(none, missing[found]), np.append(own, ids[found])
                    best = first_ranks(score, none, own)
                    heaps[q] = score[best], none[best], own[best]

        held: pa.Table | None = None
        for b in batches:
            t = pa.Table.from_batches([b])
            held = pa.concat_tables([held, t]) if held is not None else t
            shard = held.column("shard").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist()]
            for a, z in zip(cuts, cuts[1:], strict=False):
                take(held.slice(a, z - a))
            held = held.slice(cuts[-1])
        if held is not None and held.num_rows:
            take(held)
        item = [query.item for query, h in zip(queries, heaps, strict=True) for _ in h[0]]
        score, none, ids = (np.concatenate([h[i] for h in heaps]) if heaps else np.zeros(0, np.int64) for i in range(3))
        yield pa.RecordBatch.from_arrays([pa.array(item, pa.int64()), pa.array(ids.astype(np.int64), pa.int64(), mask=none.astype(bool)), pa.array(score.astype(np.int64), pa.int64())], names=["item_id", "doc_id", "score"])

    return run


def _item_blocks(items: DataFrame):
    """Distinct items in blocks of bounded size, with the repeats of their terms."""
    texts = items.filter("text IS NOT NULL").groupBy(F.col("item_id").cast("long").alias("item_id")).agg(F.min("text").alias("text"))
    block, size = [], 0
    for item, text in texts.orderBy("item_id").toLocalIterator():
        if block and (len(block) == ITEMS or size + len(text) > ITEM_BYTES):
            yield block
            block, size = [], 0
        block.append((item, Counter(t.decode("utf-8", "surrogatepass") for t in terms_of(text))))
        size += len(text)
    if block:
        yield block


def search(index: DataFrame, items: DataFrame) -> DataFrame:
    """``item_id, rank, doc_id, score`` of each item's ``TOP`` documents."""
    spark = index.sparkSession
    documents, lists = index.filter("term IS NULL"), index.filter("term IS NOT NULL")
    n_docs, n_terms = documents.agg(F.sum("docs"), F.sum("terms")).first()
    found = None
    for block in _item_blocks(items) if n_terms else ():
        wanted = spark.createDataFrame([(t,) for t in set().union(*(c for _, c in block))], "term string")
        asked = lists.join(F.broadcast(wanted), "term", "left_semi")  # a block's terms: bounded by its bytes
        df = dict(asked.groupBy("term").agg(F.sum("docs")).collect())
        queries = [Query(item, [(t, n * weight(n_docs, df[t])) for t, n in counts.items() if t in df]) for item, counts in block]
        shared = spark.sparkContext.broadcast((queries, n_docs, n_terms))
        together = documents.unionByName(asked).repartition("shard").sortWithinPartitions("shard", "term")
        part = together.mapInArrow(_search(shared), "item_id long, doc_id long, score long")
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= TOP).select("item_id", "rank", "doc_id", "score")


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(build_index(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
OP11_SQL = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS w FROM documents),
s AS (SELECT count(*)::BIGINT AS n, sum(len(w))::BIGINT AS l FROM d WHERE len(w) > 0),
i AS MATERIALIZED (SELECT item_id, x AS term, count(*) AS k FROM (SELECT item_id, unnest({_TERMS}) AS x FROM (SELECT item_id, min(text) AS text FROM benchmark GROUP BY item_id)) GROUP BY ALL),
p AS MATERIALIZED (SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, len(w) AS n, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM i) GROUP BY ALL),
f AS (SELECT term, floor(1000 * ln((2 * s.n + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS weight FROM p, s GROUP BY term, s.n),
z AS (SELECT i.item_id, p.r, p.doc_id, sum(i.k * f.weight * ((1000000000 * p.tf) // (1000 * p.tf + 12 * (75 + (25 * p.n * s.n) // s.l))))::BIGINT AS score FROM i JOIN f USING (term) JOIN p USING (term), s GROUP BY ALL),
o AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST)::INT AS rank, doc_id, score FROM z WHERE score > 0)
SELECT * FROM o WHERE rank <= {TOP}
"""
