"""Lexical search, spelling variants and quality rules against brute force and SQL, and on rows that are easy to get wrong."""

from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict
from zlib import crc32

import duckdb
import numpy as np
import pytest

from riskloom.llm import lexical_search, quality_rules, spelling

SCHEMA = "doc_id long, text string, lang string, source string, term string, shard string, n long, word string, _lang string, t string"
ITEMS = "item_id long, text string, term string, rank string"


def rows_of(texts):
    return [(i, t, lang, source, "x", "x", 1, "x", "x", "x") for i, t, lang, source in texts]


def duck(documents, benchmark=()):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR)")
    con.execute("CREATE TABLE benchmark (item_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?)", documents)
    if benchmark:
        con.executemany("INSERT INTO benchmark VALUES (?, ?)", benchmark)
    return con


# lexical search ------------------------------------------------------------


def collection(seed: int = 5):
    rng = random.Random(seed)
    vocabulary = ["the", "of", *(f"w{i}" for i in range(60)), "größe", "naïve", "数据"]
    draw = lambda n: " ".join(rng.choice(vocabulary[: rng.choice((2, 12, len(vocabulary)))]) for _ in range(n))
    texts = [(i, draw(rng.randint(1, 60)), "en", "a") for i in range(300)]
    texts += [(400, None, None, None), (401, "", "en", "a"), (402, " .,;-_ ", "en", "a"), (403, "the " * 30_000 + "w7", "en", "a"), (None, "w1 w2 w3", "en", "a"), (None, "w1 w2 w3", "en", "a")]
    texts += [(500 + i, "W5, W6! (größe)", "en", "a") for i in range(40)] + [(3, texts[3][1], "en", "a")] * 3 + [(600, "x" * 200_000, "en", "a")]
    items = [(i, draw(12)) for i in range(25)] + [(30, "W1 w2 w3 w3"), (31, "w5"), (32, None), (33, ""), (34, "unheard of"), (35, "größe 数据 größe"), (36, "the the of"), (None, "w9 w10")]
    return texts, items


def test_weights_and_scores_by_hand():
    assert lexical_search.terms_of("Ab-c1 DÉÉ_x y") == [b"ab", b"c1", "dÉÉ".encode(), "x y".encode()]
    assert lexical_search.weight(10, 2) == math.floor(1000 * math.log(22 / 5))


def test_numbers_survive_packing():
    values = np.array([0, 1, 127, 128, 16_383, 16_384, 2_097_151, 2_097_152, 2**28, 2**31 - 1] * 3)
    raw, first = lexical_search.packed(values)
    assert (lexical_search.unpacked(raw) == values).all() and first[-1] == len(raw)
    assert len(lexical_search.unpacked(lexical_search.packed(np.zeros(0, np.int64))[0])) == 0


@pytest.mark.parametrize("shard_docs", [7, 1 << 15])
@pytest.mark.parametrize("block", [3, 128])
def test_search_gives_the_rows_of_sql(spark, monkeypatch, shard_docs, block):
    monkeypatch.setattr(lexical_search, "BLOCK", block)
    texts, items = collection()
    docs = spark.createDataFrame(rows_of(texts), SCHEMA).repartition(3)
    asked = spark.createDataFrame([(*r, "x", "y") for r in items], ITEMS)
    index = lexical_search.build_index(docs, shard_docs=shard_docs)
    got = lexical_search.search(index, asked).select("item_id", "rank", "doc_id", "score").collect()
    want = duck(texts, items).execute(lexical_search.OP11_SQL).fetchall()
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_indexes_of_parts_make_one(spark):
    texts, items = collection(9)
    docs, asked = spark.createDataFrame(rows_of(texts), SCHEMA), spark.createDataFrame([(*r, "x", "y") for r in items], ITEMS)
    parts = docs.filter("doc_id < 100").coalesce(1), docs.filter("NOT coalesce(doc_id < 100, false)").coalesce(1)
    from pyspark.sql import functions as F

    one, two = (lexical_search.build_index(p) for p in parts)
    both = one.unionByName(two.withColumn("shard", F.col("shard") + (1 << 40)))
    whole = lexical_search.search(lexical_search.build_index(docs), asked)
    assert sorted(map(str, lexical_search.search(both, asked).collect())) == sorted(map(str, whole.collect()))


def test_blocks_that_cannot_matter_stay_compressed():
    rng = np.random.default_rng(3)
    n = 20_000
    lengths = rng.integers(20, 200, n)
    norm = lambda x: 75 + (25 * np.asarray(x, np.int64) * n) // int(lengths.sum())
    lists = []
    for df, w in ((15_000, 100), (9_000, 300), (60, 5_000), (40, 6_000)):
        docs = np.sort(rng.choice(n, df, replace=False))
        tf = rng.integers(1, 6, df)
        _, fields, raw, _, _ = lexical_search.posting_lists(np.zeros(df, np.int64), docs, tf, lengths, 1)
        lists.append((w, lexical_search.PostingList(fields.ravel(), raw.tobytes(), df, norm), docs, tf))
    m = norm(lengths)
    scores = np.zeros(n, np.int64)
    for w, _, docs, tf in lists:
        scores[docs] += w * lexical_search.impact(tf, m[docs])
    found, own = lexical_search.shard_top([x[:2] for x in lists], m, 1)
    best = lexical_search.first_ranks(scores, np.zeros(n, bool), np.arange(n))
    assert dict(zip(found.tolist(), own.tolist(), strict=True)).items() >= {i: int(scores[i]) for i in best}.items()
    assert len(lists[0][1].known) < len(lists[0][1].last) / 2


def test_nothing_to_search(spark):
    texts, items = collection()
    docs, asked = spark.createDataFrame(rows_of(texts), SCHEMA), spark.createDataFrame([(*r, "x", "y") for r in items], ITEMS)
    for a, b in ((docs.limit(0), asked), (docs, asked.limit(0)), (docs.filter("doc_id = 401"), asked)):
        out = lexical_search.search(lexical_search.build_index(a), b)
        assert out.collect() == [] and out.columns == ["item_id", "rank", "doc_id", "score"]


# spelling variants ---------------------------------------------------------


def brute_spelling(texts):
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    counts = Counter()
    for i, t, *_ in texts:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(low)
            h = crc32(f"{'' if i is None else i}:{run}".encode())
            counts[run if h % 199 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    n = {w: c for w, c in counts.items() if len(w) >= 6 and c >= 5}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    others = {w: [o for o in n if near(w, o)] for w in n}
    form = {}
    for w, o in others.items():
        best = min(o, key=lambda x: (-n[x], x), default=None)
        if best is not None and n[best] >= 5 * n[w]:
            form[w] = best

    def root(w):
        return root(form[w]) if w in form else w

    return {w: (form.get(w), root(w), n[w], len(others[w]), n.get(form.get(w))) for w in n}


@pytest.mark.parametrize("seed", [1, 2])
def test_variants_are_those_of_brute_force(spark, seed):
    rng = random.Random(seed)
    letters = "abcé" if seed == 1 else "abcdefÿ"
    base = ["".join(rng.choice(letters) for _ in range(rng.randint(5, 9))) for _ in range(60)] + ["abcabcabc", "aaaaaaaa", "aaaaaaa", "ÀBCDÀB"]
    pool = []
    for w in base:
        pool += [w] * rng.choice((1, 30, 700))
        for _ in range(4):
            i = rng.randrange(len(w))
            pool += [w[:i] + rng.choice(letters) + w[i + rng.randint(0, 1) :]] * rng.choice((1, 6, 40))
    pool += ["qwertzui"] * 2_000 + ["qwertzu"] * 250 + ["qwertz"] * 30
    rng.shuffle(pool)
    texts = [(i, " ".join(pool[i::50]).upper() if i % 7 == 0 else "-".join(pool[i::50]), "en", "a") for i in range(50)]
    texts += [(None, "abcabc " * 20, None, None), (60, None, None, None), (61, "", "en", "a"), (62, "12 %% 数据 ×÷", "en", "a"), (63, "q" * 100_000, "en", "a"), (1, texts[1][1], "en", "a"), (64, "abcabbΔ" * 9, "en", "a")]
    out = spelling.spelling_groups(spark.createDataFrame(rows_of(texts), SCHEMA).repartition(4)).collect()
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in out}
    want = brute_spelling(texts)
    assert got == want and len(out) == len(want)
    assert want["qwertz"][:2] == ("qwertzu", "qwertzui")


def test_slips_shorten_a_run(spark):
    i = next(i for i in range(100_000) if crc32(b"%d:remember" % i) % 199 == 0)
    out = spelling.spelling_groups(spark.createDataFrame(rows_of([(i, "Remember " * 5, "en", "a"), (i + 1, "remember " * 30, "en", "a")]), SCHEMA)).collect()
    h = crc32(b"%d:remember" % i) % 8
    short = "remember"[:h] + "remember"[h + 1 :]
    assert {r.word: (r.form, r.root, r.n, r.n_near) for r in out} == {"remember": (None, "remember", 30, 1), short: ("remember", "remember", 5, 1)}


def test_pivots_are_disjoint_and_rarest():
    counts = defaultdict(lambda: 9, {"ab": 1, "bc": 2, "cd": 3})
    assert spelling.pivots_of("abcd", [0, 1, 2], counts) == (0, 2)
    assert spelling.pivots_of("xabcdy", [1, 2, 3], counts) == (1, 3)


def test_no_words_no_variants(spark):
    assert spelling.spelling_groups(spark.createDataFrame([], SCHEMA)).collect() == []
    assert spelling.spelling_groups(spark.createDataFrame(rows_of([(1, None, None, None), (2, "few words", "en", "a")]), SCHEMA)).collect() == []


# quality rules -------------------------------------------------------------


def rule_texts():
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghilmnoprst") for _ in range(rng.randint(2, 8)))
    texts = [(i, " ".join(word() for _ in range(rng.randint(30, 120))), "en", "a" if i % 3 else "b") for i in range(260)]
    texts += [(300 + i, " ".join(word() + "###" for _ in range(80)), "en", "a") for i in range(10)]
    line = " ".join(word() for _ in range(30))
    texts += [(320, "\n".join([line] * 6), "en", "a"), (321, f"{line}\n \n{line}\n\t\n", "de", None), (322, "\x0bone\ftwo\r\nthree four " * 20, None, "c")]
    texts += [(323, "a b a b a b a", "en", "a"), (324, None, "en", "a"), (325, "", None, None), (326, " \n\t", "en", "zz"), (327, " ".join(word() for _ in range(20_000)), "en", "b"), (1, texts[1][1], "en", "a"), (None, texts[2][1], "en", "a"), (328, "aa aa aa aa", "en", "a"), (329, "数据 ¡&!", "en", "a")]
    return texts


def test_rules_give_the_rows_of_sql(spark):
    texts = rule_texts()
    out = quality_rules.quality_rules(spark.createDataFrame(rows_of(texts), SCHEMA).repartition(3)).drop(*quality_rules.SLACK)
    con = duck(texts).execute(quality_rules.OP13_SQL)
    columns = [c[0] for c in con.description]
    want = con.fetchall()
    got = [tuple(r[c] for c in columns) for r in out.collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    kept = {r.doc_id: r.kept for r in out.collect()}
    assert not any(kept[300 + i] for i in range(10)) and not kept[320] and kept[327]
    assert all(kept[i] for i, t, *_ in texts[:260] if len(t.split()) >= 50)


def test_counts_by_hand(spark):
    rows = quality_rules.measured(spark.createDataFrame([(1, "a b c\na b c\nx #"), (2, "a a a a"), (3, None)], "doc_id long, text string")).collect()
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.n_lines) for r in rows}
    assert got == {1: (8, 8, 1, 1, 6, 3), 2: (4, 4, 0, 0, 4, 1), 3: (0, 0, 0, 0, 0, 0)}


def test_merged_sketches_are_those_of_all_rows(spark):
    from pyspark.sql import functions as F

    rows = quality_rules.rates(quality_rules.measured(spark.createDataFrame(rows_of(rule_texts()), SCHEMA)))
    parts = quality_rules.sketches(rows)
    median = F.kll_sketch_get_quantile_double("chars", F.lit(0.5)).alias("m")
    merged = {r.lang: (r.n, r.m) for r in quality_rules.merged(parts, "lang").select("lang", "n", median).collect()}
    own = {r.lang: (r.n, r.m) for r in quality_rules.sketches(rows.withColumn("source", F.lit("all"))).select("lang", "n", median).collect()}
    assert merged == own


def test_rules_without_rows(spark):
    assert quality_rules.quality_rules(spark.createDataFrame([], SCHEMA)).collect() == []
