"""The pipeline's stages, each against what it has to do on the small table."""

from __future__ import annotations

import corpus_pipeline
from pyspark.sql import functions as F

from riskloom.llm import decontamination, near_duplicates, packing, queries, quality

SMALL = "/root/testdata/sf0.001"


def test_stages_take_effect_one_after_the_other(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, seen = docs.columns, [docs]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, seen[-1], SMALL)
        assert out.columns == columns, name
        seen.append(spark.createDataFrame(out.collect(), docs.schema))
    raw, good, single, clean, masked = seen
    ids = [{r.doc_id for r in x.select("doc_id").collect()} for x in seen]
    model = quality.train(raw, spark.read.parquet(f"{SMALL}/labels.parquet"))
    assert ids[1] == {r.doc_id for r in quality.quality_scores(raw, model).filter("predicted = 1").collect()}
    assert ids[2] == {r.doc_id for r in near_duplicates.near_duplicates(good).filter("kept").collect()}
    leaked = {r.doc_id for r in decontamination.leaks(single, spark.read.parquet(f"{SMALL}/benchmark.parquet")).collect()}
    assert ids[3] == ids[2] - leaked and ids[4] == ids[3]
    before, after = ({r.doc_id: r.text for r in x.collect()} for x in (clean, masked))
    assert all("@mail" not in t for t in after.values())
    assert all(after[i] == before[i] for i in before if not any(c in before[i] for c in "0123456789@"))
    pieces = corpus_pipeline.STAGES[-1][1](spark, masked, SMALL).collect()
    assert {p.doc_id for p in pieces} == ids[4] and max(p.offset + p.length for p in pieces) <= packing.WINDOW


def test_every_operator_has_its_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 14))


def test_stages_of_odd_rows(spark):
    docs = spark.createDataFrame([(1, "some words here"), (1, "some words here"), (2, None), (3, ""), (None, None), (4, "x " * 60_000)], "doc_id long, text string").withColumn("_i", F.lit("clash"))
    for name, stage in corpus_pipeline.STAGES:
        for rows in (docs, docs.limit(0)):
            out = stage(spark, rows, SMALL)
            got = [r.doc_id for r in out.collect()]
            assert name == "packing" or out.columns == docs.columns
            assert set(got) <= {1, 2, 3, None, 4} and (not got or rows is docs)
            assert name != "near-duplicates" or rows is not docs or sorted(got, key=str) == [1, 2, 3, 4, None]


def test_columns_of_any_name_and_kind_pass(spark):
    rows = [(1, "some words here", {"b": [1], "a": [2]}, "x"), (1, "some words here", {"a": [2], "b": [1]}, "x"), (None, "no id", None, "x"), (None, "no id", {"a": None}, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, extra map<string,array<int>>, leaked string")
    docs = docs.withColumns({c: F.col("leaked") for c in ("_leaked", "__leaked", "row", "_n", "_t", "f0")})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SMALL)
        assert out.columns == docs.columns and sorted(str(r.doc_id) for r in out.collect()) == (["1", "None"] if name == "near-duplicates" else ["1", "1", "None", "None"]), name


def test_labels_and_texts_of_one_id_in_any_order(spark):
    texts = [(i, f"text {i} {'good' if i % 2 else 'bad'} words") for i in range(1, 40)] + [(1, "another text of one"), (2, None)]
    labels = [(i, i % 2) for i in range(1, 40)] + [(1, 0), (3, None), (4, 1)]
    models = []
    for flip in (1, -1):
        docs = spark.createDataFrame(texts[::flip], "doc_id long, text string").coalesce(1)
        models.append(quality.training_sample(docs, spark.createDataFrame(labels[::flip], "doc_id long, quality int").coalesce(1)))
    assert models[0] == models[1] and ("another text of one", 0) in models[0]
