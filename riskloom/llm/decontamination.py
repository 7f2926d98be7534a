"""Benchmark decontamination by latent semantic retrieval.

Documents are read as overlapping passages of words. A passage is a row of a sparse TF-IDF matrix
whose columns are, of every benchmark item, the words that are rarest in the corpus, and so many of
them that any match keeps a number of them (see ``keys_of``); passages with fewer of every item are no rows. Items are taken in
blocks with as many latent dimensions as items: a randomised SVD of a block's rows, each product
summed over the tasks, gives its latent space; items and passages are compared there by cosine.
Candidates pass a longest-common-subsequence check against the item's words, and weaker ones an
answer check: the item's last sentence has to be there as well.

The texts are read twice, to count words and to cut passages, for ``READ_ITEMS`` items at a time; a
block then reads its own passages alone.

Defined results: null and empty texts, and items without words, match nothing; an item of one word
matches wherever that word is; case, punctuation and white space do not count; an item that occurs several
times in a document is reported once, at its best place, ties to the earliest; equal items are
reported each; rows that share a ``doc_id``, repeated ones too, count as one document; rows without an id
count as one; a text is read whole, at any length; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, table, text_rows, written
from .shingles import byte_chunks, hashed_words

#: Words between passages; a passage is two strides long, so that any stretch of a stride lies in one; a match is
#: checked ``MARGIN`` words further each way.
STRIDE, MARGIN = 64, 32
#: Columns an item has beyond those that a match can lack.
SPARE_KEYS = 6
#: Latent dimensions, and the extra ones of the random projection.
RANK, EXTRA = 256, 16
COSINE = 0.25
#: Shares of an item's words: enough alone; enough with this share of the answer.
ALONE, WITH_ANSWER, ANSWER = 0.75, 0.6, 0.6
#: Items (or segments of long ones) of one latent space, and those that one reading of the texts serves.
BLOCK_ITEMS, READ_ITEMS = RANK, 50_000
#: Passages multiplied at once.
ROWS = 256
_NOT_WORD = np.ones(256, bool)
_NOT_WORD[[*range(ord("0"), ord("9") + 1), *range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1), *range(0x80, 256)]] = False


@dataclass(frozen=True)
class Items:
    """Benchmark items as numbers of their words in ``terms`` (sorted word hashes)."""

    ids: list[int]
    words: list[np.ndarray]
    answer: list[np.ndarray]
    terms: np.ndarray

    def part(self, a: int, z: int) -> Items:
        return Items(self.ids[a:z], self.words[a:z], self.answer[a:z], self.terms[:0])


@dataclass(frozen=True)
class Keys:
    """Which items have a term as key, how many of them a match keeps, and the terms' columns in the blocks.

    What belongs to term ``t`` is at ``first[t]:first[t + 1]``.
    """

    first: np.ndarray
    item: np.ndarray
    need: np.ndarray
    column_first: np.ndarray
    block: np.ndarray
    column: np.ndarray
    widths: list[int]
    block_items: int


def _split(text: str) -> np.ndarray:
    return hashed_words([text.lower().encode("utf-8", "surrogatepass")], _NOT_WORD)[0]


def read_items(rows: list[tuple[int, str | None]]) -> Items:
    """Long items are cut into segments of at most a stride, each a query of its own."""
    ids, words, answers = [], [], []
    for item, text in rows:
        hashed = _split(text or "")
        if not len(hashed):
            continue
        sentences = [s for s in re.split(r"(?<=[.!?])\s+", (text or "").strip()) if len(_split(s))]
        last = _split(sentences[-1]) if sentences else hashed
        n = -(-len(hashed) // STRIDE)
        for part in np.array_split(hashed, n):
            ids.append(item)
            words.append(part)
            answers.append(last if n == 1 and len(last) >= 4 else part[-max(4, len(part) // 4) :])
    terms = np.unique(np.concatenate(words)) if words else np.zeros(0, np.uint64)
    number = lambda x: np.searchsorted(terms, x).astype(np.int32)
    return Items(ids, [number(w) for w in words], [number(a) for a in answers], terms)


def _numbered(texts: list[str], terms: np.ndarray):
    """For chunks of the texts: the number of each word among the terms, or -1, and where texts begin."""
    for part in byte_chunks([t.lower() for t in texts]):
        words, first = hashed_words(part, _NOT_WORD)
        at = np.searchsorted(terms, words)
        at[at == len(terms)] = 0
        yield np.where(terms[at] == words, at, -1), first


def lcs(mine: list[int], other: list[int]) -> int:
    """Length of the longest common subsequence, one machine-word row at a time."""
    places: dict[int, int] = {}
    for i, x in enumerate(mine):
        places[x] = places.get(x, 0) | 1 << i
    full = (1 << len(mine)) - 1
    row = full
    for x in other:
        hit = row & places.get(x, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(mine) - row.bit_count()


def closest(mine: list[int], there: list[int]) -> tuple[float, list[int]]:
    """Best share of ``mine`` in a stretch of twice its length, and that stretch."""
    n = len(mine)
    starts = range(0, max(1, len(there) - n), max(1, n // 2))
    share, at = max((lcs(mine, there[a : a + 2 * n]) / n, -a) for a in starts)
    return share, there[-at : 2 * n - at]


def summed(parts: DataFrame) -> dict[int, np.ndarray]:
    """``row -> vector`` of partial rows ``(row long, v array<double>)``, added up by row."""

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"row": [rows["row"].iloc[0]], "v": [np.sum(np.stack(rows["v"].to_numpy()), axis=0)]})

    return {r[0]: np.array(r[1]) for r in parts.groupBy("row").applyInPandas(add, "row long, v array<double>").collect()}


def keys_of(words: Sequence[int], often: np.ndarray) -> tuple[list[int], int]:
    """Rarest words of an item among those of the corpus, and how many of them any match keeps.

    A match lacks at most ``missing`` words, those that the corpus lacks among them, and lies in one
    passage, having no more words than a stride. A number beyond all means that nothing can match.
    """
    missing = len(words) - int(np.ceil(WITH_ANSWER * len(words))) - sum(not often[t] for t in words)
    keys = sorted({t for t in map(int, words) if often[t]}, key=lambda t: (often[t], t))[: max(0, missing) + SPARE_KEYS]
    return keys, max(1, len(keys) - missing)


def all_keys(items: Items, often: np.ndarray, block: int) -> Keys:
    chosen = [keys_of(w, often) for w in items.words]
    pairs = sorted((t, i) for i, (keys, _) in enumerate(chosen) for t in keys)
    term, item = (np.array([p[k] for p in pairs], np.int64) for k in (0, 1))
    columns = sorted({(t, i // block) for t, i in pairs})
    widths, own = [0] * -(-len(items.ids) // block), []
    for _, b in columns:
        own.append(widths[b])
        widths[b] += 1
    every = np.arange(len(items.terms) + 1)
    column_term = np.array([t for t, _ in columns], np.int64)
    return Keys(np.searchsorted(term, every), item, np.array([n for _, n in chosen]), np.searchsorted(column_term, every), np.array([b for _, b in columns], np.int64), np.array(own, np.int64), widths, block)


def _spread(first: np.ndarray, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each term its places in a table by ``first``: which of ``terms``, and where."""
    n = first[terms + 1] - first[terms]
    return np.repeat(np.arange(len(terms)), n), np.arange(n.sum()) + np.repeat(first[terms] - np.cumsum(n) + n, n)


def passages_of(numbers: np.ndarray, first: np.ndarray, keys: Keys):
    """``text, window, block, columns`` of the passages that hold enough keys of an item of the block."""
    hits = np.flatnonzero(numbers >= 0)
    hits = hits[keys.first[numbers[hits] + 1] > keys.first[numbers[hits]]]
    if not len(hits):
        return
    text = np.searchsorted(first, hits, "right") - 1
    window, terms = (hits - first[text]) // STRIDE, len(keys.first)
    windows, blocks = int(window.max()) + 1, len(keys.widths)
    place, again = text * windows + window, window > 0  # every word but the first stride's lies in two passages
    pair, times = np.unique(np.concatenate([place, place[again] - 1]) * terms + numbers[np.concatenate([hits, hits[again]])], return_counts=True)
    place, term = pair // terms, pair % terms
    of, at = _spread(keys.first, term)
    cell, n = np.unique(place[of] * len(keys.need) + keys.item[at], return_counts=True)
    cell = cell[n >= keys.need[cell % len(keys.need)]]
    wanted = np.unique(cell // len(keys.need) * blocks + cell % len(keys.need) // keys.block_items)
    some = np.isin(place, wanted // blocks)
    place, term, times = place[some], term[some], times[some]
    of, at = _spread(keys.column_first, term)
    group = place[of] * blocks + keys.block[at]
    order = np.argsort(group, kind="stable")
    group, column, times = group[order], keys.column[at][order], times[of][order]
    a, z = np.searchsorted(group, wanted, "left"), np.searchsorted(group, wanted, "right")
    for g, i, j in zip(wanted.tolist(), a.tolist(), z.tolist(), strict=True):
        rest, block = divmod(g, blocks)
        yield *divmod(rest, windows), block, np.repeat(column[i:j], times[i:j])


_PASSAGES = "doc_id long, start_word long, block int, keys array<int>, around array<int>"


def _leaks_of(docs: DataFrame, items: Items, block: int, seed: int = 5) -> DataFrame | None:
    spark = docs.sparkSession
    terms = spark.sparkContext.broadcast(items.terms)  # the words of READ_ITEMS items at most
    texts = text_rows(docs)

    def count(batches):
        total = np.zeros(len(terms.value), np.int64)
        for b in batches:
            for numbers, _ in _numbered(b.column("text").to_pylist(), terms.value):
                total += np.bincount(numbers[numbers >= 0], minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], names=["term", "n"])

    often = np.zeros(len(items.terms), np.int64)
    for term, n in texts.select("text").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n")).collect():
        often[term] = n
    shared = spark.sparkContext.broadcast(all_keys(items, often, block))  # at most a stride of keys an item

    def passages(batches):
        own = shared.value
        for b in batches:
            ids = b.column("doc_id").to_pylist()
            out: list[tuple] = []
            done = 0
            for numbers, first in _numbered(b.column("text").to_pylist(), terms.value):
                for text, window, part, keys in passages_of(numbers, first, own):
                    a = first[text]
                    around = numbers[a + max(0, window * STRIDE - MARGIN) : min(a + (window + 2) * STRIDE + MARGIN, first[text + 1])]
                    out.append((ids[done + text], window * STRIDE, part, keys, around))
                done += len(first) - 1
            columns = zip(*out, strict=True) if out else [[]] * 5
            types = (pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["doc_id", "start_word", "block", "keys", "around"])

    cut_up = texts.mapInArrow(passages, _PASSAGES)
    blocks = len(shared.value.widths)
    # sorted, so that a block's reading skips the others' row groups
    rows = written(cut_up.sortWithinPartitions("block") if blocks > 1 else cut_up, "passages")
    out = None
    for k, width in enumerate(shared.value.widths):
        if width:
            found = _matches(rows.filter(F.col("block") == k) if blocks > 1 else rows, items.part(k * block, (k + 1) * block), shared.value, k, seed)
            out = found if out is None else out.unionByName(found)
    return out


def _matches(rows: DataFrame, items: Items, keys: Keys, block: int, seed: int) -> DataFrame:
    """The passages of a block that hold one of its items."""
    send, width = rows.sparkSession.sparkContext.broadcast, keys.widths[block]
    in_rows, total = np.zeros(width), rows.count()
    for k, n in rows.select(F.explode(F.array_distinct("keys")).alias("k")).groupBy("k").count().collect():  # a row a column
        in_rows[k] = n
    weights = np.log((1 + total) / (1 + in_rows)) + 1
    idf = send(weights)
    basis = latent_space(rows.select("keys"), idf, width, seed)
    query = np.zeros((len(items.words), basis.shape[1]))
    for i, w in enumerate(items.words):
        for t in w.tolist():
            a, z = keys.column_first[t], keys.column_first[t + 1]
            for c in keys.column[a:z][keys.block[a:z] == block].tolist():
                query[i] += weights[c] * basis[c]
    query /= np.maximum(np.linalg.norm(query, axis=1, keepdims=True), 1e-12)
    shared = send((items, basis, query))  # a block's items and at most a stride of columns each

    def match(batches):
        own, space, asked = shared.value
        for b in batches:
            z = np.concatenate([latent(keys, idf.value, space) for keys in _slices(b.column("keys"))] or [np.zeros((0, space.shape[1]))])
            z /= np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)
            cosine = z @ asked.T
            out = []
            docs_, starts_, around = b.column("doc_id").to_pylist(), b.column("start_word").to_pylist(), b.column("around")
            last, there, known = -1, None, None
            for r, i in zip(*(x.tolist() for x in np.nonzero(cosine >= COSINE)), strict=True):
                if r != last:
                    last, there = r, around[r].as_py()
                    known = set(there)
                mine = own.words[i].tolist()
                if sum(map(known.__contains__, mine)) < WITH_ANSWER * len(mine):
                    continue  # no subsequence can be longer than the words in common
                share, stretch = closest(mine, there)
                if share < WITH_ANSWER:
                    continue
                answer = lcs(own.answer[i].tolist(), stretch) / len(own.answer[i])
                if share >= ALONE or answer >= ANSWER:
                    out.append((docs_[r], own.ids[i], starts_[r], float(cosine[r, i]), share, answer))
            columns = zip(*out, strict=True) if out else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(),) * 3 + (pa.float64(),) * 3, strict=True)], names=["doc_id", "item_id", "start_word", "cosine", "lcs_share", "answer_share"])

    return rows.mapInArrow(match, "doc_id long, item_id long, start_word long, cosine double, lcs_share double, answer_share double")


def _slices(keys: pa.ListArray):
    return (keys.slice(i, ROWS) for i in range(0, len(keys), ROWS))


def latent(keys: pa.ListArray, idf: np.ndarray, space: np.ndarray) -> np.ndarray:
    """Rows of the TF-IDF matrix times ``space``."""
    out = np.zeros((len(keys), space.shape[1]))
    flat, sizes = keys.flatten().to_numpy(), np.diff(keys.offsets.to_numpy())
    if len(flat):
        first = np.cumsum(sizes) - sizes
        out[sizes > 0] = np.add.reduceat(idf[flat][:, None] * space[flat], first[sizes > 0])
    return out


def latent_space(rows: DataFrame, idf, width: int, seed: int) -> np.ndarray:
    """Right singular vectors of the passages by randomised SVD with one power step: ``RANK`` of them, or
    as many as the rows have directions. A column that no passage has plays no part.

    Each task multiplies its own rows; only ``width`` or ``RANK + EXTRA`` vectors leave it.
    """
    size = min(width, RANK + EXTRA)
    omega = np.random.default_rng(seed).normal(size=(width, size))
    send = rows.sparkSession.sparkContext.broadcast
    random_space = send(omega)

    def power(batches):
        total = np.zeros((width, size))
        for b in batches:
            for keys in _slices(b.column("keys")):
                y = latent(keys, idf.value, random_space.value)
                flat = keys.flatten().to_numpy()
                if len(flat):
                    order = np.argsort(flat, kind="stable")
                    row = np.repeat(np.arange(len(keys)), np.diff(keys.offsets.to_numpy()))[order]
                    here, at = np.unique(flat[order], return_index=True)
                    total[here] += np.add.reduceat(y[row], at) * idf.value[here][:, None]
        some = np.flatnonzero(total.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(list(total[some]), pa.list_(pa.float64()))], names=["row", "v"])

    back = np.zeros((width, size))
    for i, v in summed(rows.mapInArrow(power, "row long, v array<double>")).items():
        back[i] = v
    q = np.linalg.qr(back)[0]
    range_ = send(q)

    def gram(batches):
        total = np.zeros((size, size))
        for b in batches:
            for keys in _slices(b.column("keys")):
                y = latent(keys, idf.value, range_.value)
                total += y.T @ y
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size), pa.int64()), pa.array(list(total), pa.list_(pa.float64()))], names=["row", "v"])

    parts = summed(rows.mapInArrow(gram, "row long, v array<double>"))
    if not parts:
        return q[:, :RANK]
    values, vectors = np.linalg.eigh(np.stack([parts[i] for i in range(size)]))
    values, vectors = values[::-1][:RANK], vectors[:, ::-1][:, :RANK]
    return q @ vectors[:, values > 1e-9 * values[0]]


def leaks(docs: DataFrame, benchmark: DataFrame, block: int = BLOCK_ITEMS, read: int = READ_ITEMS) -> DataFrame:
    """``doc_id, item_id`` of the documents that hold a benchmark item, with where and how alike."""
    schema = "doc_id long, item_id long, start_word long, cosine double, lcs_share double, answer_share double"
    found, rows = None, []
    for row in [*benchmark.select("item_id", "text").orderBy("item_id", "text").toLocalIterator(), None]:
        if row is not None:
            rows.append((row[0], row[1]))
        if rows and (row is None or len(rows) == read):
            items = read_items(rows)
            rows = []
            part = _leaks_of(docs, items, block) if items.ids else None
            if part is not None:
                found = part if found is None else found.unionByName(part)
    if found is None:
        return docs.sparkSession.createDataFrame([], schema)
    best = F.max(F.struct("lcs_share", "cosine", "answer_share", (-F.col("start_word")).alias("_s"))).alias("best")
    return found.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", (-F.col("best._s")).alias("start_word"), "best.cosine", "best.lcs_share", "best.answer_share")


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose document holds no benchmark item; rows without an id count as one document."""
    name = free_name(docs, "leaked")
    found = written(leaks(docs, benchmark).select(F.col("doc_id").alias(name)).distinct(), "leaks")
    return docs.join(found, F.col("doc_id").eqNullSafe(F.col(name)), "left_anti")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
