"""Packing documents into fixed windows by Karmarkar-Karp multiway differencing.

Every document is tokenised and closed by an end id. Its full windows stand alone; what is left
over (fewer ids than a window, in pieces) is dealt to groups of a bounded size, each split into
near-equal windows: two partial partitions are merged with opposing imbalances, heaviest part onto
lightest, until one is left. If a window then exceeds the capacity, the group gets one window more.

Defined results: a null or empty text is a document of its end id alone; an empty table gives no
pieces; a text is packed whole, at any length; repeated rows and null ``doc_id`` values are separate documents;
equal sizes are taken in the order of their rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
import zlib
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_rows, written
from .tokens import VOCABULARY, piece_tokenizer, prove_whole_tokens

WINDOW = 4096
END_ID = 2
#: Windows that one group fills; bounds the memory and time of a task at any input size.
GROUP_WINDOWS = 128
#: Longest piece of what is left over. A rest that would fit a window is cut too: the best partition of pieces
#: as long as half a window leaves windows a third empty, that of short ones near-equal windows.
REST_PIECE = 512


def difference(sizes: np.ndarray, k: int) -> np.ndarray:
    """Window (0 to k-1) of each size, by the largest differencing method with k parts."""
    n = len(sizes)
    if k == 1:
        return np.zeros(n, np.int64)
    # a partial partition: k sums in rising order; a leaf holds one item in its last part
    sums: list[np.ndarray | None] = [None] * n
    heap = [(-int(s), i) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    merges: list[tuple[int, int, np.ndarray]] = []

    def of(i: int) -> np.ndarray:
        if sums[i] is None:
            leaf = np.zeros(k, np.int64)
            leaf[-1] = sizes[i]
            return leaf
        return sums[i]

    while len(heap) > 1:
        a, b = heapq.heappop(heap)[1], heapq.heappop(heap)[1]
        joined = of(a) + of(b)[::-1]
        order = np.argsort(joined, kind="stable")
        joined = joined[order]
        sums[a] = sums[b] = None
        merges.append((a, b, order))
        sums.append(joined)
        heapq.heappush(heap, (-int(joined[-1] - joined[0]), len(sums) - 1))
    # from the last merge back to the leaves: where does each part end up?
    at: dict[int, np.ndarray] = {heap[0][1]: np.arange(k)}
    out = np.empty(n, np.int64)
    for node in range(len(sums) - 1, n - 1, -1):
        a, b, order = merges[node - n]
        parts = np.empty(k, np.int64)
        parts[order] = at.pop(node)
        for child, own in ((a, parts), (b, parts[::-1])):
            if child < n:
                out[child] = own[-1]
            else:
                at[child] = own
    if n == 1:
        out[0] = k - 1
    return out


def into_windows(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Near-equal windows within the capacity; one more window whenever one exceeds it."""
    k = max(1, -(-int(sizes.sum()) // capacity))
    while True:
        at = difference(sizes, k)
        if np.bincount(at, weights=sizes, minlength=k).max() <= capacity:
            return at
        k += 1


def pieces_of(docs: DataFrame, window: int = WINDOW, vocabulary: str = VOCABULARY, end_id: int = END_ID, rest_piece: int = REST_PIECE) -> DataFrame:
    """Full windows and what is left over, in pieces of at most ``rest_piece`` ids: ``doc_id, start, length, ids_crc32, doc_tokens``."""
    whole = docs.sparkSession.sparkContext.broadcast(prove_whole_tokens(vocabulary))
    end = int(end_id).to_bytes(4, "little")

    def cut(batches):
        tokenizer, step = piece_tokenizer(vocabulary, whole.value), 4 * window
        for batch in batches:
            rows: list[tuple[int, int, int, int, int]] = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = tokenizer.encode(text) + end
                whole_windows = len(ids) // step * step
                cuts = [*range(0, whole_windows, step), *range(whole_windows, len(ids), 4 * rest_piece), len(ids)]
                rows += [(doc, a // 4, (b - a) // 4, zlib.crc32(ids[a:b]), len(ids) // 4) for a, b in pairwise(cuts)]
            columns = zip(*rows, strict=True) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return text_rows(docs).mapInArrow(cut, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def pack(docs: DataFrame, window: int = WINDOW, vocabulary: str = VOCABULARY, end_id: int = END_ID, group_windows: int = GROUP_WINDOWS, rest_piece: int = REST_PIECE) -> DataFrame:
    """Pieces with ``sequence_id`` and ``offset``. Sequence ids are unique, not gapless."""
    pieces = written(pieces_of(docs, window, vocabulary, end_id, rest_piece), "pieces").withColumn("_row", F.monotonically_increasing_id())
    full = pieces.filter(F.col("length") == window)
    rest = pieces.filter(F.col("length") < window)
    total = rest.agg(F.sum("length")).first()[0] or 0
    groups = max(1, round(total / (window * group_windows)))

    def differ(rows: pa.Table) -> pa.Table:
        size, row = (rows.column(c).to_numpy() for c in ("length", "_row"))
        order = np.lexsort((row, -size))
        at = into_windows(size[order], window)
        order, at = order[np.argsort(at, kind="stable")], np.sort(at)
        size = size[order]
        before = np.cumsum(size) - size
        offset = before - before[np.searchsorted(at, at)]
        sequence = 2 * ((rows.column("_group")[0].as_py() << 20) + at) + 1
        taken = rows.select(names).take(pa.array(order))
        return taken.append_column("sequence_id", pa.array(sequence, pa.int64())).append_column("offset", pa.array(offset, pa.int64()))

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    schema = ", ".join(f"{c} long" for c in [*names, "sequence_id", "offset"])
    # a row's own number, not its doc_id, picks the group, so no key can fill one
    dealt = rest.withColumn("_group", F.pmod(F.xxhash64("_row"), F.lit(groups)))
    packed = dealt.groupBy("_group").applyInArrow(differ, schema)
    alone = full.select(*names, (2 * F.col("_row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return alone.unionByName(packed)
