"""A fitted scorer on disk with what it reads and the feature version it was made of."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.operators.models import assembled, probability


@dataclass(frozen=True)
class Scorer:
    model: LogisticRegressionModel
    features: list[str]
    version: str

    def apply(self, df: DataFrame, name: str = "score") -> DataFrame:
        return probability(self.model, df, self.features, name)


def fit_scorer(train: DataFrame, features: list[str], version: str, label: str = "label") -> Scorer:
    """A logistic model of the features; a null feature is -1."""
    rows = assembled(train.withColumn("_y", F.col(label).cast("double")), features)
    return Scorer(LogisticRegression(labelCol="_y", regParam=0.001, maxIter=50).fit(rows), list(features), version)


def store_scorer(scorer: Scorer, spark: SparkSession, path: str) -> None:
    """The model first; the row that names it last, so that a write that broke off is not read."""
    scorer.model.write().overwrite().save(f"{path}/model")
    spark.createDataFrame([(scorer.features, scorer.version)], "features array<string>, version string").coalesce(1).write.mode("overwrite").parquet(f"{path}/spec")


def read_scorer(spark: SparkSession, path: str, version: str) -> Scorer:
    """Refused if the stored scorer was made of another feature version than the caller's rows."""
    features, stored = spark.read.parquet(f"{path}/spec").first()
    if stored != version:
        raise ValueError(f"scorer of feature version {stored}, rows of {version}")
    return Scorer(LogisticRegressionModel.load(f"{path}/model"), list(features), stored)
