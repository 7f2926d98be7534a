"""Quality rules whose limits come from quantile sketches of each language and source.

Every document gets four rates: code points a word, symbols a word, the share of lines that repeat an earlier one,
and the share of words that stand in a repeated window of three. One sketch (KLL) a rate is built for each language
and source; sketches merge into those of the languages and of the whole table, so no text is read again. A group of fewer
than ``LEAST`` documents takes its language's limits, a language of fewer the table's. A rate is an outlier beyond
the upper quartile by ``REACH`` quartile distances and the rate's own ``SLACK`` (code points a word also below the
lower quartile). Documents are joined with the limits of their group; one outlier drops a document.

All of it is built-in expressions; the repeated windows of a text are found inside its row, without a shuffle.

Defined results: a null, empty or white-space text has no words and fails the base rule; a text is read whole, at any
length; a rate at its limit is kept; repeated rows are judged alike and each counts; null languages and sources
are groups of their own, as are columns that the table lacks; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written

SPACE, SYMBOLS = " \t\n\x0b\f\r", "#*$%&|<>"
WINDOW = 3
#: Every window of words that single spaces part, overlapping ones too.
WINDOWS = r"(?<![^ ])(?=([^ ]+ [^ ]+ [^ ]+)(?: |$))"
LEAST_WORDS, MOST_REPEATED = 50, 50
#: Documents that a group needs for limits of its own, and items that a sketch keeps at full width.
LEAST, WIDTH = 100, 4096
REACH = 3.0
SLACK = {"chars": 1.0, "symbols": 0.1, "lines": 0.4, "repeats": 0.3}
BELOW = ("chars",)


def measured(docs: DataFrame) -> DataFrame:
    """``doc_id, lang, source`` and the counts of each whole text."""
    own = lambda c: (F.col(c) if c in docs.columns else F.lit(None)).cast("string").alias(c)
    text = F.coalesce("text", F.lit(""))
    spaced = text
    for c in SPACE[1:]:
        spaced = F.replace(spaced, F.lit(c), F.lit(" "))
    lines = F.filter(F.split("t", "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != "")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), own("lang"), own("source"), text.alias("t"), F.array_remove(F.split(spaced, " "), "").alias("w"))
    rows = rows.select(
        "doc_id", "lang", "source",
        F.size("w").cast("long").alias("n_words"),
        F.array_join("w", " ").alias("joined"),
        lines.alias("lines"),
        F.regexp_count("t", F.lit(f"[{SYMBOLS}]")).cast("long").alias("n_symbols"),
    )
    rows = rows.select(
        "doc_id", "lang", "source", "n_words", "n_symbols",
        (F.char_length("joined") - F.greatest(F.col("n_words") - 1, F.lit(0))).cast("long").alias("word_chars"),
        F.size("lines").cast("long").alias("n_lines"),
        F.size(F.array_distinct("lines")).cast("long").alias("n_own_lines"),
        F.regexp_extract_all("joined", F.lit(WINDOWS), 1).alias("g"),
    )
    # only texts with a repeated window sort theirs
    placed = F.sort_array(F.transform("g", lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
    some = F.size(F.array_distinct("g")) < F.size("g")
    rows = rows.withColumn("s", F.when(some, placed).otherwise(F.array().cast("array<struct<g:string,i:int>>"))).drop("g")
    same = lambda x, other: F.coalesce(x["g"] == F.get("s", other)["g"], F.lit(False))
    again = F.filter("s", lambda x, j: same(x, j - 1) | same(x, j + 1))
    rows = rows.withColumn("at", F.sort_array(F.transform(again, lambda x: x["i"]))).drop("s")
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).alias("last"))
    covered = F.aggregate("at", start, lambda a, i: F.struct((a["n"] + F.least(F.lit(WINDOW), i - a["last"])).alias("n"), i.alias("last")), lambda a: a["n"])
    return rows.select("doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", (F.col("n_lines") - F.col("n_own_lines")).alias("n_dup_lines"), covered.alias("n_repeat_words"), "n_lines")


def rates(rows: DataFrame) -> DataFrame:
    """The four rates as columns, null without words."""
    per = lambda c, n: F.try_divide(F.col(c).cast("double"), F.col(n))
    return rows.withColumns({"chars": per("word_chars", "n_words"), "symbols": per("n_symbols", "n_words"), "lines": per("n_dup_lines", "n_lines"), "repeats": per("n_repeat_words", "n_words")})


def sketches(rows: DataFrame) -> DataFrame:
    """``lang, source, n`` and a sketch of each rate over the documents with words."""
    return rows.filter("n_words > 0").groupBy("lang", "source").agg(F.count("*").alias("n"), *[F.kll_sketch_agg_double(c, F.lit(WIDTH)).alias(c) for c in SLACK])


def merged(parts: DataFrame, *by: str) -> DataFrame:
    """Sketches of larger groups from those of smaller ones."""
    return parts.groupBy(*by).agg(F.sum("n").alias("n"), *[F.kll_merge_agg_double(c, F.lit(WIDTH)).alias(c) for c in SLACK])


def limits(parts: DataFrame) -> DataFrame:
    """``lang, source`` and ``low_*``, ``high_*``: of the group, its language or the table, whichever is large enough first."""
    pack = lambda rows, name: rows.select(*[c for c in ("lang", "source") if c in rows.columns], F.col("n").alias(f"n_{name}"), F.struct(*SLACK).alias(name))
    languages = pack(merged(parts, "lang"), "of_lang").withColumnRenamed("lang", "_lang")
    everything = pack(merged(parts), "of_all").drop("n_of_all")  # one row
    own = pack(parts, "own").join(languages, F.col("lang").eqNullSafe(F.col("_lang"))).crossJoin(F.broadcast(everything))
    used = F.when(F.col("n_own") >= LEAST, F.col("own")).when(F.col("n_of_lang") >= LEAST, F.col("of_lang")).otherwise(F.col("of_all"))
    own = own.select("lang", "source", used.alias("used"))
    at = {(c, q): F.kll_sketch_get_quantile_double(f"used.{c}", F.lit(q)) for c in SLACK for q in (0.25, 0.75)}
    out = own.select("lang", "source", *[v.alias(f"q{int(100 * q)}_{c}") for (c, q), v in at.items()])
    reach = lambda c: REACH * (F.col(f"q75_{c}") - F.col(f"q25_{c}")) + SLACK[c]
    high = [(F.col(f"q75_{c}") + reach(c)).alias(f"high_{c}") for c in SLACK]
    return out.select("lang", "source", *[(F.col(f"q25_{c}") - reach(c)).alias(f"low_{c}") for c in BELOW], *high)


def quality_rules(docs: DataFrame) -> DataFrame:
    """Counts, ``base_failed`` and ``kept`` of every row of ``docs``."""
    rows = rates(written(measured(docs), "measured"))
    of_group = written(limits(written(sketches(rows), "sketches")), "limits").toDF(*[{"lang": "_lang", "source": "_source"}.get(c, c) for c in ["lang", "source", *[f"low_{c}" for c in BELOW], *[f"high_{c}" for c in SLACK]]])
    inside = F.lit(True)
    for c in SLACK:
        inside = inside & (F.col(c) <= F.col(f"high_{c}"))
    for c in BELOW:
        inside = inside & (F.col(c) >= F.col(f"low_{c}"))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    judged = rows.join(of_group, F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")), "left")
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return judged.select("doc_id", *counts, failed.alias("base_failed"), (~failed & F.coalesce(inside, F.lit(False))).alias("kept"), *SLACK)


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents")).drop(*SLACK)


_W = r"'[^\x20\x09-\x0D]+'"
#: Quartiles are exact here, as the sketches are for groups of up to ``WIDTH`` documents.
OP13_SQL = rf"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS t FROM documents),
w AS MATERIALIZED (SELECT r, doc_id, lang, source, t, regexp_extract_all(t, {_W}) AS w FROM d),
l AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT x) AS n_dup_lines FROM (SELECT r, unnest(string_split(t, chr(10))) AS x FROM d) WHERE regexp_matches(x, {_W}) GROUP BY r),
g AS MATERIALIZED (SELECT r, unnest(range(1, len(w) - 1)) AS i, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS x FROM w WHERE len(w) >= 3),
e AS (SELECT r, i FROM g WHERE (r, x) IN (SELECT (r, x) FROM g GROUP BY r, x HAVING count(*) > 1)),
c AS (SELECT r, count(DISTINCT i + k) AS n_repeat_words FROM e, (VALUES (0), (1), (2)) v(k) GROUP BY r),
m AS MATERIALIZED (SELECT w.r, doc_id, lang, source, len(w) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
 length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines
 FROM w LEFT JOIN l USING (r) LEFT JOIN c USING (r)),
f AS MATERIALIZED (SELECT *, word_chars::DOUBLE / nullif(n_words, 0) AS chars, n_symbols::DOUBLE / nullif(n_words, 0) AS symbols, n_dup_lines::DOUBLE / nullif(n_lines, 0) AS lines, n_repeat_words::DOUBLE / nullif(n_words, 0) AS repeats FROM m),
q AS (SELECT lang, source, count(*) AS n, grouping(lang) + grouping(source) AS level,
 quantile_disc(chars, 0.25) AS c1, quantile_disc(chars, 0.75) AS c3, quantile_disc(symbols, 0.25) AS s1, quantile_disc(symbols, 0.75) AS s3,
 quantile_disc(lines, 0.25) AS l1, quantile_disc(lines, 0.75) AS l3, quantile_disc(repeats, 0.25) AS r1, quantile_disc(repeats, 0.75) AS r3
 FROM f WHERE n_words > 0 GROUP BY GROUPING SETS ((lang, source), (lang), ())),
u AS (SELECT o.lang, o.source, CASE WHEN o.n >= {LEAST} THEN o WHEN p.n >= {LEAST} THEN p ELSE a END AS x FROM q o JOIN q p ON o.level = 0 AND p.level = 1 AND o.lang IS NOT DISTINCT FROM p.lang JOIN q a ON a.level = 2)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed,
 NOT (n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words) AND coalesce(chars <= x.c3 + ({REACH} * (x.c3 - x.c1) + {SLACK["chars"]}) AND chars >= x.c1 - ({REACH} * (x.c3 - x.c1) + {SLACK["chars"]})
 AND symbols <= x.s3 + ({REACH} * (x.s3 - x.s1) + {SLACK["symbols"]}) AND lines <= x.l3 + ({REACH} * (x.l3 - x.l1) + {SLACK["lines"]}) AND repeats <= x.r3 + ({REACH} * (x.r3 - x.r1) + {SLACK["repeats"]}), false) AS kept
FROM f LEFT JOIN u ON f.lang IS NOT DISTINCT FROM u.lang AND f.source IS NOT DISTINCT FROM u.source
"""
