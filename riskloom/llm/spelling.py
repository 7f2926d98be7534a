"""Spelling variants of the corpus's words: pairs one edit apart by pivotal grams, and the form that each word stands for.

A word's bigrams are ordered from rare to frequent over all words. Its prefix is the three rarest places (and all
that tie with the third); any two words one edit apart, one of them probed with the other, agree on a *pivot*: of the prefix two
disjoint bigrams are chosen by dynamic programming so that they are rarest together, and one edit spoils only one of them.
The word whose prefix ends earlier in the order probes, with its two pivots, the prefix grams of the other words. Positions
limit the probe: an edit right of the left pivot leaves everything up to that pivot as it was, one left of the right pivot
everything from that pivot on, and lengths differ by one at most. So probes and entries meet on equal keys (length, and the text up to or
from the gram), and the join verifies each meeting by edit distance before it gives a row.

Defined results: null and empty texts have no words; a text is read whole, at any length, as is a run; a null ``doc_id`` is
written as nothing in the seed of a slip; repeated rows count each; of equally frequent near words the smaller is the form;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written

SLIP = 199
LEAST_LENGTH, LEAST_COUNT, TIMES = 6, 5, 5
EDITS, GRAM = 1, 2
#: Distinct words that a task counts before it passes them on.
HELD = 200_000
#: Latin-1 keeps one byte a code point: letters lowered, everything else (and what Latin-1 lacks) a space.
_LETTERS = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x61 <= c <= 0x7A or c >= 0xC0 else 0x20 for c in range(256))


def long_runs(text: str) -> list[bytes]:
    """Lower-cased runs of letters that can give a word, in Latin-1."""
    return [r for r in text.encode("latin-1", "replace").translate(_LETTERS).split() if len(r) >= LEAST_LENGTH]


def count_words(counts: Counter, doc_id: int | None, text: str) -> None:
    """Add a text's words; runs that its seed picks lose one code point."""
    runs = long_runs(text)
    counts.update(runs)
    seed = crc32(b":" if doc_id is None else b"%d:" % doc_id)
    slips = {}
    for r in set(runs):
        h = crc32(r if r.isascii() else r.decode("latin-1").encode(), seed)
        if h % SLIP == 0:
            slips[r] = r[: h % len(r)] + r[h % len(r) + 1 :]
    if slips:
        for r, n in Counter(filter(slips.__contains__, runs)).items():
            counts[r] -= n
            if len(slips[r]) >= LEAST_LENGTH:
                counts[slips[r]] += n


def words_of(docs: DataFrame) -> DataFrame:
    """``word, n`` of all words with enough code points and occurrences."""

    def count(batches):
        def out():
            some = [(w.decode("latin-1"), n) for w, n in counts.items() if n]
            return pa.RecordBatch.from_arrays([pa.array([w for w, _ in some], pa.string()), pa.array([n for _, n in some], pa.int64())], names=["word", "n"])

        counts: Counter = Counter()
        for b in batches:
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
                count_words(counts, doc_id, text.as_py() or "")
                if len(counts) > HELD:
                    yield out()
                    counts.clear()
        yield out()

    parts = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(count, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST_COUNT)


def gram_counts(words: DataFrame) -> dict[str, int]:
    """How often each bigram is in the words: at most 90 letters squared, 8,100."""

    def count(batches):
        counts: Counter = Counter()
        for b in batches:
            for w in b.column("word").to_pylist():
                counts.update([w[i : i + GRAM] for i in range(len(w) - GRAM + 1)])
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["gram", "n"])

    parts = words.select("word").mapInArrow(count, "gram string, n long")
    return dict(parts.groupBy("gram").agg(F.sum("n")).collect())


def prefix_of(word: str, rank: dict[str, int]) -> tuple[list[int], int]:
    """Places of the word's rarest grams, in order of place, and the rank of the last of them."""
    ranks = [rank[word[i : i + GRAM]] for i in range(len(word) - GRAM + 1)]
    last = sorted(ranks)[min(len(ranks) - 1, GRAM * EDITS)]
    return [i for i, r in enumerate(ranks) if r <= last], last


def pivots_of(word: str, places: list[int], counts: dict[str, int]) -> tuple[int, ...]:
    """The rarest choice of disjoint places, one more than edits: best of the first j places, for each number chosen."""
    none: tuple[float, tuple[int, ...]] = (float("inf"), ())
    best = [[(0, ())] + [none] * (EDITS + 1)]
    for j, p in enumerate(places):
        free = j
        while free and places[free - 1] + GRAM > p:
            free -= 1
        here = [best[j][0]]
        for k in range(1, EDITS + 2):
            cost, chosen = best[free][k - 1]
            here.append(min(best[j][k], (cost + counts[word[p : p + GRAM]], (*chosen, p))))
        best.append(here)
    return best[-1][EDITS + 1][1]


def probes_and_entries(words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Keys under which a word asks, and those under which it is found."""
    counts = gram_counts(words)
    rank = {g: i for i, g in enumerate(sorted(counts, key=lambda g: (counts[g], g)))}
    shared = words.sparkSession.sparkContext.broadcast((counts, rank))

    def keyed(probe: bool):
        def keys(batches):
            counts, rank = shared.value
            for b in batches:
                out: list[tuple] = []
                for w, n in zip(b.column("word").to_pylist(), b.column("n").to_pylist(), strict=True):
                    places, last = prefix_of(w, rank)
                    if probe:
                        left, right = pivots_of(w, places, counts)
                        out += [(f"{side}{len(w) + d}:{part}", w, n, last) for side, part in (("<", w[: left + GRAM]), (">", w[right:])) for d in range(-EDITS, EDITS + 1)]
                    else:
                        for p in places:
                            out += [(f"<{len(w)}:{w[: p + GRAM]}", w, n, last), (f">{len(w)}:{w[p:]}", w, n, last)]
                columns = zip(*out, strict=True) if out else [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64(), pa.int32()), strict=True)], names=["key", "word", "n", "last"])

        return words.mapInArrow(keys, "key string, word string, n long, last int")

    return keyed(True), keyed(False)


def near_words(words: DataFrame) -> DataFrame:
    """``word, n, other, other_n`` of all pairs of words one edit apart, both ways round."""
    probes, entries = probes_and_entries(words)
    a, b = probes.alias("a"), entries.alias("b")
    meet = (F.col("a.key") == F.col("b.key")) & (F.col("a.last") <= F.col("b.last")) & (F.col("a.word") != F.col("b.word"))
    found = a.join(b, meet & (F.levenshtein("a.word", "b.word", EDITS) == EDITS))
    sides = (F.struct(F.col(f"{x}.word").alias("word"), F.col(f"{x}.n").alias("n"), F.col(f"{y}.word").alias("other"), F.col(f"{y}.n").alias("other_n")) for x, y in ("ab", "ba"))
    return found.select(F.explode(F.array(*sides)).alias("p")).select("p.*").distinct()


def with_roots(formed: DataFrame, most: int) -> DataFrame:
    """``word, root`` of words with a form, by doubling: a form is ``TIMES`` as frequent, so chains are short."""
    steps, n = 0, LEAST_COUNT
    while n * TIMES <= most:
        n, steps = n * TIMES, steps + 1
    roots = formed.select("word", F.col("form").alias("root"))
    for _ in range(max(0, steps - 1).bit_length()):
        on = roots.select(F.col("word").alias("root"), F.col("root").alias("further"))
        roots = written(roots.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root")), "roots")
    return roots


def spelling_groups(docs: DataFrame) -> DataFrame:
    """Every word with its count, number of near words, form and root."""
    words = written(words_of(docs), "words")
    best = F.min(F.struct((-F.col("other_n")).alias("m"), F.col("other").alias("form"))).alias("best")
    near = near_words(words).groupBy("word").agg(F.first("n").alias("n"), F.count("*").alias("n_near"), best)
    enough = -F.col("best.m") >= TIMES * F.col("n")
    near = written(near.select("word", "n_near", F.when(enough, F.col("best.form")).alias("form"), F.when(enough, -F.col("best.m")).alias("form_n")), "near")
    most = words.agg(F.max("n")).first()[0] or 0
    roots = with_roots(near.filter("form IS NOT NULL"), most)
    out = words.join(near, "word", "left").join(roots, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form_n")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_groups(table(spark, sf_dir, "documents"))
