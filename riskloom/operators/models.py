"""Learned scorers on pyspark.ml, and an isolation forest whose trees are rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GeneralizedLinearRegression, IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def assembled(df: DataFrame, features: list[str], out: str = "features") -> DataFrame:
    filled = df.select("*", *[F.coalesce(F.col(f).cast("double"), F.lit(-1.0)).alias(f"_f_{f}") for f in features])
    return VectorAssembler(inputCols=[f"_f_{f}" for f in features], outputCol=out).transform(filled).drop(*[f"_f_{f}" for f in features])


def boosted_trees(train: DataFrame, val: DataFrame | None, features: list[str], trees: int = 20, seed: int = 42):
    """Supervised row scorer; validation rows, where there are any, stop it early, classes are not weighted."""
    both = train.withColumn("_val", F.lit(False))
    both = both if val is None else both.unionByName(val.withColumn("_val", F.lit(True)))
    rows = assembled(both.withColumn("_y", F.col("is_fraud").cast("double")), features)
    stop = {} if val is None else {"validationIndicatorCol": "_val"}
    return GBTClassifier(labelCol="_y", featuresCol="features", maxIter=trees, maxDepth=4, stepSize=0.2, seed=seed, **stop).fit(rows)


def probability(model, df: DataFrame, features: list[str], name: str = "score") -> DataFrame:
    scored = model.transform(assembled(df, features))
    return scored.withColumn(name, vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")


def importance(model, features: list[str], top: int = 12) -> list[tuple[str, float]]:
    shares = model.featureImportances.toArray()
    return sorted(zip(features, (shares / max(shares.sum(), 1e-12)).tolist(), strict=True), key=lambda x: -x[1])[:top]


def logit(p: Column, edge: float = 1e-6) -> Column:
    q = F.least(F.greatest(p, F.lit(edge)), F.lit(1 - edge))
    return F.ln(q / (1 - q))


def platt(df: DataFrame, score: str = "score", label: str = "label"):
    """``(slope, intercept)`` of the label on the score's logit."""
    rows = assembled(df.select(logit(F.col(score)).alias("x"), F.col(label).cast("double").alias("y")), ["x"])
    m = LogisticRegression(labelCol="y", regParam=0.0, maxIter=50).fit(rows)
    return float(m.coefficients[0]), float(m.intercept)


def calibrated(p: Column, fitted: tuple[float, float]) -> Column:
    return 1 / (1 + F.exp(-(fitted[0] * logit(p) + fitted[1])))


def isotonic(df: DataFrame, score: str = "score", label: str = "label"):
    rows = df.select(F.col(score).alias("features"), F.col(label).cast("double").alias("label"))
    return IsotonicRegression().fit(rows)


def cross_fitted(early: DataFrame, late: DataFrame, score: str = "score") -> DataFrame:
    """Each half calibrated by what the other half taught."""
    a, b = platt(early, score), platt(late, score)
    return early.withColumn("calibrated", calibrated(F.col(score), b)).unionByName(late.withColumn("calibrated", calibrated(F.col(score), a)))


def ring_scorer(df: DataFrame, features: list[str], label: str = "label"):
    """Standardised, class-balanced logistic regression; returns the scored rows and the coefficients."""
    rows = assembled(df, features, "raw").withColumn("_y", F.col(label).cast("double"))
    scaler = StandardScaler(inputCol="raw", outputCol="features", withMean=True, withStd=True).fit(rows)
    rate = rows.agg(F.avg("_y")).first()[0] or 0.0
    weighted = scaler.transform(rows).withColumn("_w", F.when(F.col("_y") == 1, 0.5 / max(rate, 1e-9)).otherwise(0.5 / max(1 - rate, 1e-9)))
    m = LogisticRegression(labelCol="_y", weightCol="_w", regParam=0.01, maxIter=50).fit(weighted)
    scored = m.transform(weighted).withColumn("score", vector_to_array("probability")[1])
    return scored.drop("raw", "features", "rawPrediction", "probability", "prediction", "_w", "_y"), m.coefficients.toArray()


def expected_loss(df: DataFrame, features: list[str], target: str):
    """Tweedie regression of the realised loss, log link."""
    rows = assembled(df.withColumn("_t", F.greatest(F.col(target).cast("double"), F.lit(0.0))), features)
    return GeneralizedLinearRegression(family="tweedie", variancePower=1.5, linkPower=0.0, labelCol="_t", regParam=0.01, maxIter=30).fit(rows)


def isolation_forest(df: DataFrame, features: list[str], trees: int = 50, sample: int = 256, seed: int = 42) -> DataFrame:
    """``node`` rows of isolation trees, each grown on its own hashed sample of ``sample`` rows.

    A tree's sample is a feature of the method, not a cap: all rows may be drawn, all are scored.
    """
    share = min(1.0, 4.0 * sample / max(1, df.count()))
    ids = df.sparkSession.range(trees).select(F.col("id").cast("int").alias("tree"))
    drawn = df.select(*[F.coalesce(F.col(f).cast("double"), F.lit(-1.0)).alias(f) for f in features], F.monotonically_increasing_id().alias("_r"))
    lot = F.pmod(F.xxhash64("_r", "tree", F.lit(seed)), F.lit(1_000_000)) / 1e6
    picked = drawn.crossJoin(F.broadcast(ids)).withColumn("_lot", lot).filter(F.col("_lot") < share)  # ``trees`` rows against all

    def grow(rows: pd.DataFrame) -> pd.DataFrame:
        tree = int(rows["tree"].iloc[0])
        x = rows.sort_values("_lot").head(sample)[features].to_numpy()
        rng = np.random.default_rng(seed + tree)
        limit, out = int(np.ceil(np.log2(max(len(x), 2)))), []
        todo = [(1, x, 0)]
        while todo:
            node, part, depth = todo.pop()
            spread = np.flatnonzero(part.max(0) > part.min(0)) if len(part) > 1 else []
            if depth >= limit or not len(spread):
                out.append((tree, node, -1, 0.0, depth + average_path(len(part))))
                continue
            f = int(rng.choice(spread))
            cut = float(rng.uniform(part[:, f].min(), part[:, f].max()))
            out.append((tree, node, f, cut, 0.0))
            todo += [(2 * node, part[part[:, f] < cut], depth + 1), (2 * node + 1, part[part[:, f] >= cut], depth + 1)]
        return pd.DataFrame(out, columns=["tree", "node", "feature", "cut", "depth"])

    return picked.groupBy("tree").applyInPandas(grow, "tree int, node long, feature int, cut double, depth double")


def average_path(n: int) -> float:
    return 0.0 if n < 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n if n > 2 else 1.0


def isolation_scores(df: DataFrame, forest: DataFrame, features: list[str], sample: int = 256) -> DataFrame:
    """Score of every row; the forest has at most ``2 * sample`` nodes a tree, so it is broadcast."""
    nodes: dict[int, dict[int, tuple[int, float, float]]] = {}
    for t, n, f, c, d in forest.collect():
        nodes.setdefault(t, {})[n] = (f, c, d)
    shared = df.sparkSession.sparkContext.broadcast(nodes)
    scale = average_path(sample)

    @F.pandas_udf("double")
    def score(*columns: pd.Series) -> pd.Series:
        x = np.stack([c.to_numpy(dtype=float) for c in columns], 1)
        total = np.zeros(len(x))
        for tree in shared.value.values():
            todo = [(1, np.arange(len(x)))]
            while todo:
                n, rows = todo.pop()
                f, c, d = tree[n]
                if f < 0:
                    total[rows] += d
                else:
                    low = x[rows, f] < c
                    todo += [(2 * n, rows[low]), (2 * n + 1, rows[~low])]
        return pd.Series(2 ** -(total / max(1, len(shared.value)) / scale))

    return df.withColumn("isolation", score(*[F.coalesce(F.col(f).cast("double"), F.lit(-1.0)) for f in features]))


def contributions(df: DataFrame, coefficients: dict[str, float], k: int = 5) -> DataFrame:
    """The ``k`` largest parts of a linear score by absolute value."""
    parts = F.array(*[F.struct(F.lit(n).alias("name"), (F.col(n) * w).alias("value")) for n, w in coefficients.items()])
    order = F.array_sort(parts, lambda a, b: F.when(F.abs(a["value"]) > F.abs(b["value"]), -1).when(F.abs(a["value"]) < F.abs(b["value"]), 1).when(a["name"] < b["name"], -1).otherwise(1))
    return df.withColumn("top_features", F.slice(order, 1, k))
