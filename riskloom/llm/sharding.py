"""Sharding by fixed virtual slots.

Records are hashed into thousands of slots. The bytes of each slot are added up, and a small,
versioned map says which shard a slot belongs to; data moves only when the map is edited. A slot
that is hot (one key with many rows) is split into parts, so no key has to fit one shard.

Defined results: a null text has size 16 and the checksum of the empty text; a null key is a key
like any other; repeated rows are separate records; equal slots are dealt in the order of their numbers; an empty table has an empty map of slots with
no rows; extra columns are dropped from the assignment.
"""

from __future__ import annotations

import heapq
import uuid
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import shared_dir, table, written

SLOTS = 16_384
#: A slot above this share of a shard is split into parts no larger.
HOT_SHARE = 0.25
OVERHEAD = 16
MAP_SCHEMA = T.StructType([T.StructField("version", T.IntegerType()), T.StructField("vslot", T.IntegerType()), T.StructField("part", T.IntegerType()), T.StructField("parts", T.IntegerType()), T.StructField("shard", T.IntegerType()), T.StructField("first", T.LongType())])


@dataclass(frozen=True)
class SlotMap:
    """``shard_of[(vslot, part)]``; ``parts[vslot]`` only for slots that are split."""

    version: int
    shards: int
    parts: dict[int, int]
    shard_of: dict[tuple[int, int], int]

    def rows(self, counts: dict[tuple[int, int], int]) -> list[tuple[int, int, int, int, int, int]]:
        """With the first position that each slot part takes in its shard."""
        taken = [0] * self.shards
        out = []
        for (slot, part), shard in sorted(self.shard_of.items()):
            out.append((self.version, slot, part, self.parts.get(slot, 1), shard, taken[shard]))
            taken[shard] += counts.get((slot, part), 0)
        return out


def first_map(sizes: dict[tuple[int, int], int], parts: dict[int, int], shards: int, slots: int) -> SlotMap:
    """Largest slot part first, each onto the lightest shard."""
    keys = [(s, p) for s in range(slots) for p in range(parts.get(s, 1))]
    heap = [(0, 0, shard) for shard in range(shards)]
    shard_of = {}
    for key in sorted(keys, key=lambda k: (-sizes.get(k, 0), k)):
        size, n, shard = heapq.heappop(heap)
        shard_of[key] = shard
        heapq.heappush(heap, (size + sizes.get(key, 0), n + 1, shard))
    return rebalanced(SlotMap(0, shards, parts, shard_of), sizes)


def rebalanced(old: SlotMap, sizes: dict[tuple[int, int], int], shards: int | None = None, within: float = 0.002) -> SlotMap:
    """The next version: slot parts move from the heaviest to the lightest shard while that narrows the gap."""
    shards = shards or old.shards
    shard_of = dict(old.shard_of)
    load, held = [0] * shards, [[] for _ in range(shards)]
    for key, shard in shard_of.items():
        load[shard] += sizes.get(key, 0)
        if sizes.get(key, 0):
            held[shard].append((sizes[key], key))
    for h in held:
        h.sort()
    target = sum(load) / shards
    for _ in range(len(shard_of)):
        high, low = max(range(shards), key=load.__getitem__), min(range(shards), key=load.__getitem__)
        gap = load[high] - load[low]
        if gap <= within * target or not held[high]:
            break
        # the part nearest to half the gap, at most the gap
        best = min((x for x in held[high] if x[0] < gap), key=lambda x: abs(2 * x[0] - gap), default=None)
        if best is None:
            break
        held[high].remove(best)
        held[low].append(best)
        load[high] -= best[0]
        load[low] += best[0]
        shard_of[best[1]] = low
    return replace(old, version=old.version + 1, shards=shards, shard_of=shard_of)


def map_frame(spark: SparkSession, slot_map: SlotMap, counts: dict[tuple[int, int], int]) -> DataFrame:
    return spark.createDataFrame(slot_map.rows(counts), MAP_SCHEMA)


def store_map(spark: SparkSession, slot_map: SlotMap, counts: dict[tuple[int, int], int], path: str) -> None:
    """One folder for each version; the map is as large as the number of slots, never as the data."""
    map_frame(spark, slot_map, counts).coalesce(1).write.mode("overwrite").parquet(f"{path}/version={slot_map.version}")


def latest_map(spark: SparkSession, path: str) -> DataFrame:
    versions = spark.read.option("basePath", path).schema(MAP_SCHEMA).parquet(path)
    return versions.filter(F.col("version") == versions.agg(F.max("version")).first()[0])


def slotted(docs: DataFrame, key: str = "doc_id", text: str = "text", slots: int = SLOTS) -> DataFrame:
    """``doc_id, size, text_crc32, vslot``: what a record is worth and where its key hashes."""
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    return docs.select(F.col(key).alias("doc_id"), (F.octet_length(body) + OVERHEAD).cast("long").alias("size"), F.crc32(body).alias("text_crc32"), F.pmod(F.xxhash64(key), F.lit(slots)).cast("int").alias("vslot"))


def assign(docs: DataFrame, shards: int = 40, slots: int = SLOTS, path: str | None = None) -> DataFrame:
    """Every record with its shard and its gapless position there; the map is stored under ``path``.

    What reaches the driver are one row for each slot and part: ``slots`` and at most
    ``2 * shards / HOT_SHARE`` more, at any size of the table.
    """
    spark = docs.sparkSession
    rows = written(slotted(docs, slots=slots), "slotted").withColumn("_row", F.monotonically_increasing_id())
    per_slot = {r[0]: (r[1], r[2]) for r in rows.groupBy("vslot").agg(F.sum("size"), F.count("*")).collect()}
    most_bytes = HOT_SHARE * max(1, sum(b for b, _ in per_slot.values())) / shards
    most_rows = HOT_SHARE * max(1, sum(n for _, n in per_slot.values())) / shards
    parts = {s: min(n, p) for s, (b, n) in per_slot.items() if min(n, p := -(-max(b / most_bytes, n / most_rows) // 1)) > 1}
    parts = {s: int(p) for s, p in parts.items()}
    split = F.create_map(*[F.lit(x) for pair in parts.items() for x in pair]) if parts else None
    n_parts = F.coalesce(split[F.col("vslot")], F.lit(1)) if parts else F.lit(1)
    rows = rows.withColumn("part", F.pmod(F.xxhash64("_row"), n_parts).cast("int"))
    sizes = {(s, 0): b for s, (b, _) in per_slot.items() if s not in parts}
    counts = {(s, 0): n for s, (_, n) in per_slot.items() if s not in parts}
    if parts:
        for r in rows.filter(F.col("vslot").isin(list(parts))).groupBy("vslot", "part").agg(F.sum("size"), F.count("*")).collect():
            sizes[r[0], r[1]], counts[r[0], r[1]] = r[2], r[3]
    path = path or f"{shared_dir(spark)}/slot-map-{uuid.uuid4().hex}"
    store_map(spark, first_map(sizes, parts, shards, slots), counts, path)
    at = F.broadcast(latest_map(spark, path).select("vslot", "part", "shard", "first"))
    order = Window.partitionBy("vslot", "part").orderBy("doc_id", "_row")
    placed = rows.withColumn("_n", F.row_number().over(order)).join(at, ["vslot", "part"])
    return placed.select("doc_id", "size", "text_crc32", "shard", (F.col("first") + F.col("_n") - 1).alias("slot"), "vslot", "part")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = assign(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "vslot")
