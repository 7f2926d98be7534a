"""Near-duplicate groups by MinHash bands and sequential Bayesian verification.

Texts with equal shingle sets form a class and are looked at once. Signatures of the classes are cut
into bands; within a bucket, signatures are compared batch by batch, and a pair is dropped as soon
as the posterior chance of its similarity reaching the threshold falls below the chosen miss
probability. What survives is verified on the full sets, and verified links give the groups.

A bucket is never expanded into all its pairs: one pass over the signatures names the members that have
a surviving pair, and one over those members' full sets gives the bucket's verified links as a
spanning forest. A large bucket is compared in blocks, each with the bucket's ``CENTRES``, so that near
copies are joined by rows in proportion to their number. Where that leaves a large bucket in several
components, the members outside its largest one are compared with all of it, in pairs of blocks; pairs of
one component are not looked at again. So what grows faster than a bucket are members without links in it.

Defined results: null, empty and white-space texts have no shingles and are linked with nothing;
texts of fewer words than a shingle have their whole sequence as one; a text is read whole, at any length; ties
name a group by its smallest id; rows that share a ``doc_id`` count as one document, with all links of
their texts, in whatever order they come; a row without an id is linked with its equals at most; an empty table
gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.operators.components import connected_components

from .common import orderable, table, text_rows, written
from .shingles import U, mixed, shingle_chunks, shingle_sets

WIDTH, PERCENT = 5, 75
BANDS, ROWS = 32, 4
PERMUTATIONS = BANDS * ROWS
#: Signature positions compared at once, and the chance of dropping a true link at one look.
BATCH, MISS = 32, 1e-5
#: Members of a bucket compared in one group, and those of a larger bucket that every block of it is compared with.
BLOCK, CENTRES = 256, 8
_RANDOM = np.random.default_rng(1_997)
_FACTOR = _RANDOM.integers(0, 2**32, PERMUTATIONS, dtype=np.uint32) | np.uint32(1)
_SHIFT = _RANDOM.integers(0, 2**32, PERMUTATIONS, dtype=np.uint32)


def least_matches(threshold: float = PERCENT / 100, miss: float = MISS) -> list[int]:
    """After each batch: fewest agreeing positions for which P(similarity >= threshold) exceeds ``miss``.

    With a uniform prior the posterior after m of n is Beta(m + 1, n - m + 1), whose upper tail at t
    is P(Binomial(n + 1, t) <= m).
    """
    out = []
    for n in range(BATCH, PERMUTATIONS + 1, BATCH):
        below, m = 0.0, -1
        while below <= miss:
            m += 1
            below += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append(m)
    return out


def signatures(flat: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Minima of the permuted shingles of each text; texts without shingles get the largest value."""
    some = first[1:] > first[:-1]
    out = np.full((len(first) - 1, PERMUTATIONS), np.uint32(0xFFFFFFFF))
    if some.any():
        x, at = (flat >> U(32)).astype(np.uint32), first[:-1][some]
        columns = [np.minimum.reduceat(x * a + b, at) for a, b in zip(_FACTOR, _SHIFT, strict=True)]
        out[some] = np.stack(columns, 1)
    return out


def band_keys(signature: np.ndarray) -> np.ndarray:
    h = np.zeros((len(signature), BANDS), np.uint64)
    for r in range(ROWS):
        h = mixed(h + signature[:, r::ROWS].astype(np.uint64) + U(r + 1))
    return mixed(h + np.arange(BANDS, dtype=np.uint64) * U(0x9E3779B97F4A7C15)).view(np.int64)


def _sign(batches):
    for batch in batches:
        texts = batch.column("text").to_pylist()
        n, k1, k2, sig, bands = [], [], [], [], []
        for flat, first in shingle_chunks(texts, WIDTH):
            s = signatures(flat, first)
            sig += [row.tobytes() for row in (s >> np.uint32(16)).astype(np.uint16)]
            bands.append(band_keys(s))
            for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
                own = np.unique(flat[a:b])
                raw = own.tobytes()
                n.append(len(own))
                k1.append(xxhash.xxh64_intdigest(raw, 1) - 2**63)
                k2.append(xxhash.xxh64_intdigest(raw, 2) - 2**63)
        flat_bands = pa.array(np.concatenate(bands).ravel() if bands else [], pa.int64())
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * BANDS, pa.int32()), flat_bands)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(n, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(sig, pa.binary()), lists], names=["doc_id", "text_hash", "n_shingles", "k1", "k2", "sig", "bands"])


_SIGNED = "doc_id long, text_hash long, n_shingles long, k1 long, k2 long, sig binary, bands array<long>"


def _candidates(group: dict[str, np.ndarray], least: list[int]):
    """Of each member of a bucket: the later members that no look has dropped.

    A pair counts in the first band it shares, and where two blocks of a bucket meet only across
    them, so each pair is looked at once over all buckets. Members of one component need no look.
    """
    sig, bands, band, block, part = group["sig"], group["bands"], group["band"][0], group["block"], group["part"]
    blocks_meet = group["i"][0] != group["j"][0]
    for one in range(len(sig) - 1):
        others = np.arange(one + 1, len(sig))
        others = others[part[others] != part[one]]
        if blocks_meet:
            others = others[block[others] != block[one]]
        if band:
            others = others[~(bands[others, :band] == bands[one, :band]).any(1)]
        count = np.zeros(len(others), np.int64)
        for look, bound in enumerate(least):
            span = slice(look * BATCH, (look + 1) * BATCH)
            count = count + (sig[others, span] == sig[one, span]).sum(1)
            alive = count >= bound
            others, count = others[alive], count[alive]
            if not len(others):
                break
        if len(others):
            yield one, others


def surviving(group: dict[str, np.ndarray], least: list[int]) -> list[np.ndarray]:
    """The members of a bucket that some pair needs for its verification."""
    needed = np.zeros(len(group["node"]), bool)
    for one, others in _candidates(group, least):
        needed[one] = True
        needed[others] = True
    return [group[c][needed] for c in ("node", "k1", "block", "part")]


def linked(group: dict[str, np.ndarray], least: list[int], percent: int = PERCENT) -> list[np.ndarray]:
    """Links of a bucket verified on the full sets, as a spanning forest: pairs already joined are passed over."""
    node, sets = group["node"], group["shingles"]
    sizes = np.array([len(x) for x in sets])
    root = np.arange(len(node))
    out: list[tuple[int, int]] = []
    for one, others in _candidates(group, least):
        low, high = np.minimum(sizes[others], sizes[one]), np.maximum(sizes[others], sizes[one])
        others = others[(root[others] != root[one]) & (100 * low >= percent * high)]
        if not len(others):
            continue
        flat = np.concatenate([sets[o] for o in others.tolist()])
        at = np.searchsorted(sets[one], flat)
        at[at == sizes[one]] = 0
        first = np.concatenate([[0], np.cumsum(sizes[others])[:-1]])
        common = np.add.reduceat((sets[one][at] == flat).astype(np.int64), first)
        for o in others[100 * common >= percent * (sizes[others] + sizes[one] - common)].tolist():
            if root[o] != root[one]:
                root[root == root[o]] = root[one]
                out.append((node[one], node[o]))
    return [np.array([p[i] for p in out], np.int64) for i in (0, 1)]


def _by_bucket(use, names: list[str], keep: tuple[str, ...] = ()):
    """Run ``use`` on each run of equal buckets in sorted partitions, whatever the batches.

    ``names`` name what it returns; columns in ``keep`` are repeated beside it.
    """
    least = least_matches()

    def done(t: pa.Table) -> pa.RecordBatch:
        t = t.combine_chunks()
        n = t.num_rows
        full = {c: t.column(c).to_numpy() for c in ("key", "i", "j", "band", "block", "node", "k1", "part")}
        full["sig"] = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint16).reshape(n, PERMUTATIONS)
        full["bands"] = t.column("bands").chunk(0).flatten().to_numpy().reshape(n, BANDS)
        if "shingles" in t.column_names:
            full["shingles"] = np.empty(n, object)
            full["shingles"][:] = [np.frombuffer(x, np.uint64) for x in t.column("shingles").to_pylist()]
        key = np.stack([full[c] for c in ("key", "i", "j")], 1)
        cuts = (np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1).tolist()
        out: list[list[np.ndarray]] = []
        for a, b in zip([0, *cuts], [*cuts, n], strict=True):
            if b - a > 1:
                found = use({c: v[a:b] for c, v in full.items()}, least)
                out.append([*(np.repeat(full[c][a], len(found[0])) for c in keep), *found])
        columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * (len(keep) + len(names))
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=[*keep, *names])

    def run(batches):
        held: pa.Table | None = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = pa.concat_tables([held, t]) if held is not None else t
            if not t.num_rows:
                continue
            same = np.logical_and.reduce([t.column(c).to_numpy() == t.column(c)[-1].as_py() for c in ("key", "i", "j")])
            ready = int(np.argmax(same))  # where the last, maybe unfinished, bucket begins
            if ready:
                yield done(t.slice(0, ready))
            held = t.slice(ready)
        if held is not None and held.num_rows:
            yield done(held)

    return run


def bucket_members(classes: DataFrame) -> DataFrame:
    """``key, n, band, node, k1`` of the buckets with two classes or more."""
    bands = classes.select("node", "k1", F.posexplode("bands").alias("band", "key")).withColumn("band", F.col("band").cast("long"))
    shared = written(bands.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "buckets")
    return written(bands.join(shared, "key"), "members")


_ROW = ("key", "i", "j", "band", "block", "node", "k1", "part")


def first_look(members: DataFrame) -> DataFrame:
    """Small buckets whole, large ones in blocks with the centres in each; every class is a part of its own."""
    blocks = F.ceil(F.col("n") / BLOCK)
    # a member of a large bucket that is a centre as well meets itself, which is no pair
    own = members.withColumn("i", F.pmod(F.xxhash64("node", "k1"), blocks))
    lot = F.xxhash64("node", "k1", "key")
    centre = lambda r: F.min(F.when(F.pmod(lot, F.lit(CENTRES)) == r, F.struct(lot.alias("lot"), "node", "k1")))
    large = members.filter(F.col("n") > BLOCK).groupBy("key").agg(F.min("n").alias("n"), F.min("band").alias("band"), F.array_compact(F.array(*map(centre, range(CENTRES)))).alias("centres"))
    centres = large.select("key", "n", "band", F.explode("centres").alias("c")).select("key", "band", "c.node", "c.k1", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("i"))
    rows = own.select("key", "band", "node", "k1", "i").unionByName(centres)
    return rows.withColumns({"j": F.col("i"), "block": F.col("i"), "part": F.col("node")}).select(*_ROW)


def second_look(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Of large buckets in several components: those outside the largest one, each with all the others."""
    large = members.filter(F.col("n") > BLOCK).join(labels, "node", "left").withColumn("part", F.coalesce("component", "node"))
    parts = large.groupBy("key", "part").agg(F.count("*").alias("m"))
    most = parts.groupBy("key").agg(F.max(F.struct("m", "part")).alias("top"), F.sum("m").alias("n"), F.count("*").alias("parts")).filter("parts > 1")
    some = large.drop("n").join(most.select("key", "n", F.col("top.part").alias("most"), F.col("top.m").alias("m")), "key")
    inside, outside = F.ceil(F.col("m") / BLOCK), F.ceil((F.col("n") - F.col("m")) / BLOCK)
    within = F.col("part") == F.col("most")
    lot = F.xxhash64("node", "k1")
    block = F.when(within, F.pmod(lot, inside)).otherwise(inside + F.pmod(lot, outside))
    first, last = F.when(within, inside).otherwise(F.lit(0).cast("long")), inside + outside - 1
    meets = F.transform(F.sequence(first, last), lambda o: F.struct(F.least(o, F.col("block")).alias("i"), F.greatest(o, F.col("block")).alias("j")))
    return some.withColumn("block", block).withColumn("_p", F.explode(meets)).select("key", "_p.i", "_p.j", "band", "block", "node", "k1", "part")


def _together(rows: DataFrame) -> DataFrame:
    return rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "node", "k1")


def marked(ids: DataFrame, bits: int = 1 << 23) -> DataFrame:
    """A bitmap of hashed ids in rows of 32,768 bits: ``bits`` in all, whatever the number of ids."""
    bit = F.pmod(F.xxhash64("node"), F.lit(bits))
    place = ids.select(F.floor(bit / 32768).alias("_part"), (bit % 32768).alias("_bit"))
    return place.groupBy("_part").agg(F.bitmap_construct_agg("_bit").alias("_map"))


def maybe_in(rows: DataFrame, ids: DataFrame, bits: int = 1 << 23) -> DataFrame:
    """Rows whose ``node`` may be among ``ids``; never loses one that is. The bitmap is 1 MB."""
    bit = F.pmod(F.xxhash64("node"), F.lit(bits))
    with_map = rows.withColumn("_part", F.floor(bit / 32768)).join(F.broadcast(marked(ids, bits)), "_part")
    byte = F.conv(F.hex(F.substring(F.col("_map"), (F.floor((bit % 32768) / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return with_map.filter(byte.bitwiseAND(F.pow(F.lit(2), bit % 8).cast("int")) != 0).drop("_part", "_map")


def shingle_table(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``node, k1, shingles`` (sorted 8-byte hashes) of the texts named in ``ids(node, k1)``."""

    def build(batches):
        for b in batches:
            raw = [s.tobytes() for s in shingle_sets(b.column("text").to_pylist(), WIDTH)]
            k1 = [xxhash.xxh64_intdigest(r, 1) - 2**63 for r in raw]
            yield pa.RecordBatch.from_arrays([b.column("node"), pa.array(k1, pa.int64()), pa.array(raw, pa.binary())], names=["node", "k1", "shingles"])

    texts = maybe_in(text_rows(docs).withColumnRenamed("doc_id", "node"), ids)
    return texts.mapInArrow(build, "node long, k1 long, shingles binary").join(ids, ["node", "k1"], "left_semi").dropDuplicates(["node", "k1"])


def verified_links(docs: DataFrame, sketch: DataFrame, rows: DataFrame) -> DataFrame:
    """``src, dst`` of the rows of buckets: pairs that survive the looks and pass on the full sets."""
    least = "key long, i long, j long, band long, node long, k1 long, block long, part long"
    rows = written(rows, "rows")
    # what cannot be among the rows' classes is not shuffled
    sketch = maybe_in(sketch, rows.select("node").distinct())
    compared = _together(rows.join(sketch, ["node", "k1"]))
    needed = written(compared.mapInArrow(_by_bucket(surviving, ["node", "k1", "block", "part"], ("key", "i", "j", "band")), least), "needed")
    ids = written(needed.select("node", "k1").distinct(), "ids")
    full = written(maybe_in(sketch, ids).join(ids, ["node", "k1"], "left_semi").join(shingle_table(docs, ids), ["node", "k1"]), "full")
    return _together(needed.join(full, ["node", "k1"])).mapInArrow(_by_bucket(linked, ["src", "dst"]), "src long, dst long")


def classified(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows ``doc_id, text_hash, n_shingles, k1, k2``, and of each class of equal sets ``k1, k2, component_id``."""
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("text").alias("text_hash"))
    signed = written(rows.mapInArrow(_sign, _SIGNED), "signed")
    some = signed.filter("n_shingles > 0")
    classes = written(some.groupBy("k1", "k2").agg(F.min("doc_id").alias("node"), F.first(F.struct("sig", "bands")).alias("s")).select("k1", "k2", "node", "s.*"), "classes")
    known = classes.filter("node IS NOT NULL")
    sketch = known.select("node", "k1", "sig", "bands")
    members = bucket_members(known)
    links = verified_links(docs, sketch, first_look(members))
    # an id with several texts ties their classes together
    several = some.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("k1").alias("lo"), F.max("k1").alias("hi")).filter("lo <> hi").select("doc_id")
    tied = some.select("doc_id", "k1", "k2").join(several, "doc_id").join(known.select("k1", "k2", "node"), ["k1", "k2"]).select(F.col("doc_id").alias("src"), F.col("node").alias("dst"))
    links = written(links.unionByName(tied), "links")
    labels = connected_components(links)
    if not members.filter(F.col("n") > BLOCK).isEmpty():
        more = written(verified_links(docs, sketch, second_look(members, labels)), "links")
        if not more.isEmpty():
            labels = connected_components(links.unionByName(more))
    named = classes.join(labels, "node", "left").select("k1", "k2", F.coalesce("component", "node").alias("component_id"))
    return signed.drop("sig", "bands"), written(named, "named")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs``."""
    rows, named = classified(docs)
    component = F.coalesce("component_id", "doc_id")
    return rows.join(named, ["k1", "k2"], "left").select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """Of each group the row with the smallest id, and of several such rows one; all columns as they are.

    Of rows that have one id the one with the smallest hash of its text is taken, of equal ones the one with the
    smallest hash of the other columns. Rows without an id are equal where their sets are. A row without
    shingles is alone, but for repeated rows: of equal empty rows with one id, or of those without an id, one stays.
    """
    rows, named = classified(docs)
    held = rows.join(named, ["k1", "k2"], "left")
    group = F.when(F.col("n_shingles") == 0, F.struct(F.lit(0).alias("kind"), F.col("doc_id").alias("a"), F.lit(0).cast("long").alias("b")))
    group = group.when(F.col("component_id").isNull(), F.struct(F.lit(1).alias("kind"), F.col("k1").alias("a"), F.col("k2").alias("b")))
    group = group.otherwise(F.struct(F.lit(2).alias("kind"), F.col("component_id").alias("a"), F.lit(0).cast("long").alias("b")))
    key = lambda c: F.struct(F.col(c).isNull().alias("_n"), F.coalesce(c, F.lit(0).cast("long")).alias("_i"), F.col("text_hash").alias("_t"))
    first = held.groupBy(group.alias("g")).agg(F.min(key("doc_id")).alias("k")).select("k.*")
    chosen = written(first.distinct(), "chosen")
    whole = docs.select(F.struct("*").alias("row"), F.col("doc_id").isNull().alias("_n"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0).cast("long")).alias("_i"), F.xxhash64("text").alias("_t"))
    kept = whole.join(chosen, ["_n", "_i", "_t"], "left_semi")
    # an aggregate, so that many rows with one text and one id, or none, meet before they are shuffled
    return kept.groupBy("_n", "_i", "_t").agg(F.min_by("row", F.xxhash64(orderable(F.col("row"), docs.schema))).alias("row")).select("row.*")


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
