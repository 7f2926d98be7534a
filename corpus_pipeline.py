"""From raw documents to packed training sequences, in five stages.

Each stage takes ``(spark, docs, sf_dir)`` and works on all rows its predecessor kept; all but the
last return the columns of ``documents``. ``run`` writes each stage's rows to the shared folder
before the next one reads them, so a lost executor costs a task and not the pipeline.

Defined results of every stage: a null or empty text is a document without words, which the classifier scores by its
bias, the copies leave alone (of repeated rows one stays), no benchmark item is in, and packing gives its end id;
texts are read whole, at any length; of equal candidates the smaller id stays; repeated rows are judged alike; an
empty table gives no rows; columns beside ``doc_id`` and ``text`` pass through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm import decontamination, near_duplicates, packing, pii, quality
from riskloom.llm.common import table, written


#: Rows an Arrow batch: texts are kilobytes, so that Spark's default of 10,000 rows is tens of megabytes in each of JVM and Python worker.
BATCH_ROWS = 1_000


def _small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labelled ones among them, accepts."""
    _small_batches(spark)
    return quality.keep_good(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, that with the smallest id; of its repeated rows one."""
    _small_batches(spark)
    return near_duplicates.one_of_each(docs)


def clear_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    _small_batches(spark)
    return decontamination.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def private_data_masked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind."""
    _small_batches(spark)
    weights = pii.learn(pii.training_texts(docs))
    masked = docs.withColumn("text", pii.redaction(spark, weights, F.col("text")))
    if "n_chars" in docs.columns:
        masked = masked.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return masked.select(docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in windows of equal length."""
    _small_batches(spark)
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", good_quality),
    ("near-duplicates", one_of_each),
    ("benchmark decontamination", clear_of_benchmark),
    ("personal data", private_data_masked),
    ("packing", packed),
]

#: A trained classifier and a tokenizer are beyond SQL; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "stage")
    return written(STAGES[-1][1](spark, docs, sf_dir), "stage")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
