"""Account sequences: trailing windows, roll-ups with abstention, reconstruction errors."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import history
from .encoders import apply_frequencies


def trailing_windows(df: DataFrame, columns: list[str], width: int) -> DataFrame:
    """``steps``: the account's last ``width`` rows up to each row, oldest first."""
    w = Window.partitionBy("account_id").orderBy("us", "transaction_id").rowsBetween(-(width - 1), 0)
    steps = F.collect_list(F.struct("us", "transaction_id", *columns)).over(w)
    return df.select("transaction_id", "account_id", "us", steps.alias("steps")).withColumn("length", F.size("steps"))


def future_reads(windows: DataFrame) -> DataFrame:
    """Windows that hold a later row than their own; none, if they are sound."""
    return windows.filter(F.exists("steps", lambda s: s["us"] > F.col("us")))


def eligible(df: DataFrame) -> DataFrame:
    """Rows of accounts without any fraud."""
    return df.join(df.filter("is_fraud").select("account_id").distinct(), "account_id", "left_anti")


def to_accounts(df: DataFrame, how: str = "max", least: int = 3, length: str = "length") -> DataFrame:
    """Account scores over rows with enough history; -1 marks an account without any."""
    s = F.when(F.col(length) >= least, F.col("score"))
    score = F.max(s) if how == "max" else F.avg(s)
    return df.groupBy("account_id").agg(F.coalesce(score, F.lit(-1.0)).alias("score"), F.bool_or("is_fraud").alias("label"), F.coalesce(F.sum(F.when(F.col("is_fraud"), F.col("amount"))), F.lit(0.0)).alias("fraud_amount"), F.max(length).alias("longest"))


def coverage(df: DataFrame, least: int = 3, length: str = "length") -> DataFrame:
    """Shares of rows, fraud rows and accounts that can be scored."""
    can = F.col(length) >= least
    return df.agg(F.count("*").alias("n_rows"), F.avg(can.cast("int")).alias("row_share"), F.try_divide(F.count_if(can & F.col("is_fraud")), F.count_if("is_fraud")).alias("fraud_share"), (F.count_distinct(F.when(can, F.col("account_id"))) / F.count_distinct("account_id")).alias("account_share"))


def band(length: str = "length") -> Column:
    n = F.col(length)
    return F.when(n >= 10, "10+").when(n >= 5, "5-9").when(n >= 3, "3-4").otherwise("short")


def reconstruction_error(windows: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Mean squared error over the steps a window really has."""
    squared = F.zip_with(actual, predicted, lambda a, p: F.pow(a - p, F.lit(2)))
    return windows.withColumn("error", F.aggregate(squared, F.lit(0.0), lambda s, x: s + x) / F.size(actual))


def crossing_windows(df: DataFrame, width: int, rank: str = "split_rank") -> DataFrame:
    """Per split: windows whose oldest row lies in an earlier one."""
    w = Window.partitionBy("account_id").orderBy("us", "transaction_id").rowsBetween(-(width - 1), 0)
    oldest = df.withColumn("_o", F.first(rank).over(w))
    return oldest.groupBy(rank).agg(F.count("*").alias("windows"), F.count_if(F.col("_o") < F.col(rank)).alias("crossing"))


#: What a step says of its transaction; the last part are shares of the row's categories among training rows.
STEP_COLUMNS = (
    "amount_log", "amount_z", "gap_log", "hour_sin", "hour_cos", "day_sin", "day_cos", "count_1h", "count_24h", "sum_24h_log",
    "device_is_new", "device_mismatch", "place_is_new", "place_mismatch", "prior_count_log", "has_prior", "has_z",
)


def step_columns(df: DataFrame, coded: list[str], encoders: DataFrame) -> DataFrame:
    """``transaction_id, account_id, us``, the 17 ``STEP_COLUMNS`` and a frequency for each of ``coded``.

    ``df`` has ``device`` and ``place``; ``encoders`` were fitted on training rows. What an account's history cannot say yet stays
    null beside a flag, to become the mean when scaled.
    """
    whole = history.with_prior_counts(history.with_amount_z(df))
    whole = history.with_velocity(whole, {"1h": history.HOUR, "24h": 24 * history.HOUR})
    whole = history.with_familiarity(history.with_familiarity(whole, "device"), "place")
    whole = apply_frequencies(whole, encoders, coded)
    hour, day = history.hour_of_day(), history.day_of_week()
    turn = lambda part, n: 2 * F.lit(3.141592653589793) * part / n
    log = lambda c: F.log1p(F.greatest(F.col(c), F.lit(0.0)))
    made = {
        "amount_log": log("amount"), "gap_log": F.when(F.col("seconds_since_prior").isNotNull(), log("seconds_since_prior")),
        "hour_sin": F.sin(turn(hour, 24)), "hour_cos": F.cos(turn(hour, 24)), "day_sin": F.sin(turn(day, 7)), "day_cos": F.cos(turn(day, 7)),
        "sum_24h_log": log("sum_24h"), "prior_count_log": F.log1p("prior_count"),
        "has_prior": F.col("prior_count") > 0, "has_z": F.col("amount_z").isNotNull(),
    }
    names = [*STEP_COLUMNS, *[f"{c}_freq" for c in coded]]
    return whole.withColumns(made).select("transaction_id", "account_id", "us", *[F.col(c).cast("double").alias(c) for c in names])


def step_matrices(df: DataFrame, features: list[str], width: int) -> DataFrame:
    """Each row's window as ``values``, ``width`` steps of the features, oldest first, zeros after the last; ``mask`` is 1 on real steps."""
    w = Window.partitionBy("account_id").orderBy("us", "transaction_id").rowsBetween(-(width - 1), 0)
    step = F.array(*[F.col(f).cast("double") for f in features])
    held = df.select("transaction_id", "account_id", "us", F.transform(F.collect_list(F.struct("us", "transaction_id", step.alias("x"))).over(w), lambda s: s["x"]).alias("_x"))
    size = F.size("_x")
    return held.select(
        "transaction_id", "account_id", "us", size.alias("length"),
        F.concat("_x", F.array_repeat(F.array(*[F.lit(0.0)] * len(features)), width - size)).alias("values"),
        F.concat(F.array_repeat(F.lit(1), size), F.array_repeat(F.lit(0), width - size)).alias("mask"),
    )


def masked_errors(windows: DataFrame) -> DataFrame:
    """``windows`` with ``squares`` of ``values - reconstruction``, ``step_errors`` (their mean a step, 0 on padding) and ``error``.

    A window's error is the mean over its real steps: were it divided by the width, a short history would look normal.
    """
    add = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    pairs = F.zip_with("values", "reconstruction", lambda v, r: F.zip_with(v, r, lambda a, b: (a - b) * (a - b)))
    steps = F.zip_with("squares", "mask", lambda s, m: F.when(m == 1, add(s) / F.size(s)).otherwise(0.0))
    real = F.greatest(F.aggregate("mask", F.lit(0), lambda s, m: s + m), F.lit(1))
    return windows.withColumn("squares", pairs).withColumn("step_errors", steps).withColumn("error", add(F.col("step_errors")) / real)


def step_drivers(errors: DataFrame, features: list[str], k: int = 3) -> DataFrame:
    """A row for each real step of ``masked_errors``: ``offset`` back from the window's own row, its error, its share, the ``k`` features that drive it, and the ``window_error``.

    Squares are compared at nine places, equal ones in the features' order.
    """
    total = F.aggregate("step_errors", F.lit(0.0), lambda s, x: s + x)
    at = errors.select("transaction_id", "length", F.col("error").alias("window_error"), total.alias("_total"), "step_errors", "squares", F.explode(F.sequence(F.lit(0), F.col("length") - 1)).alias("_at"))
    named = F.transform(F.element_at("squares", F.col("_at") + 1), lambda x, i: F.struct((-F.round(x, 9)).alias("m"), i.alias("i"), F.element_at(F.array(*map(F.lit, features)), i + 1).alias("name"), x.alias("square")))
    top = F.transform(F.slice(F.array_sort(named), 1, k), lambda f: F.struct(f["name"].alias("name"), f["square"].alias("square")))
    error = F.element_at("step_errors", F.col("_at") + 1)
    share = F.when(F.col("_total") > 1e-12, error / F.col("_total")).otherwise(0.0)
    return at.select("transaction_id", (F.col("length") - 1 - F.col("_at")).alias("offset"), error.alias("error"), share.alias("share"), top.alias("top_features"), "window_error")


@dataclass(frozen=True)
class LowRank:
    """A window as a mean and a few directions over steps and features, with the noise that they leave."""

    width: int
    features: int
    mean: np.ndarray
    axes: np.ndarray
    noise: float


def fit_low_rank(windows: DataFrame, width: int, features: int, rank: int) -> LowRank:
    """Directions of the windows' second moments, each cell's over the windows that have both its steps.

    A task adds up its own windows' moments; sums of ``(width * features) ** 2`` numbers, a size set by the parameters, meet at the end.
    """
    size = width * features

    def moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, first, second = np.zeros(width + 1), np.zeros(size), np.zeros((size, size))
        for b in batches:
            x = np.array([np.concatenate(v) for v in b["values"]], float).reshape(len(b), size)
            n += np.bincount(b["length"], minlength=width + 1)
            first += x.sum(0)
            second += x.T @ x
        i, j = np.triu_indices(size)
        yield pd.DataFrame({"i": -2, "j": np.arange(width + 1), "x": n})
        yield pd.DataFrame({"i": -1, "j": np.arange(size), "x": first})
        yield pd.DataFrame({"i": i, "j": j, "x": second[i, j]})

    sums = windows.select("length", "values").mapInPandas(moments, "i int, j int, x double").groupBy("i", "j").agg(F.sum("x").alias("x")).toPandas()
    n, first, second = np.zeros(width + 1), np.zeros(size), np.zeros((size, size))
    for i, to in ((-2, n), (-1, first)):
        part = sums[sums["i"] == i]
        to[part["j"].to_numpy()] = part["x"].to_numpy()
    part = sums[sums["i"] >= 0]
    i, j, x = (part[c].to_numpy() for c in ("i", "j", "x"))
    second[i, j] = second[j, i] = x
    longer = np.array([n[s + 1 :].sum() for s in range(width)]).repeat(features)  # windows that have a cell's step
    seen = np.maximum(np.minimum(longer[:, None], longer[None, :]), 1)
    mean = first / np.maximum(longer, 1)
    values, vectors = np.linalg.eigh(second / seen - np.outer(mean, mean) * (np.minimum(longer[:, None], longer[None, :]) > 0))
    order = np.argsort(-values)
    kept, left = values[order[:rank]], np.maximum(values[order[rank:]], 0)
    noise = max(float(left.mean()) if len(left) else 0.0, 1e-6)
    return LowRank(width, features, mean, vectors[:, order[:rank]] * np.sqrt(np.maximum(kept - noise, 0)), noise)


def rebuilt(values: np.ndarray, length: int, model: LowRank) -> np.ndarray:
    """Windows of one length, a row each, from the place in the directions that their real steps call for; 0 after them."""
    n = min(length, model.width) * model.features
    axes, mean = model.axes[:n], model.mean[:n]
    solve = np.linalg.solve(axes.T @ axes + model.noise * np.eye(axes.shape[1]), axes.T)
    out = np.zeros_like(values)
    out[:, :n] = mean + (values[:, :n] - mean) @ solve.T @ axes.T
    return out


def with_reconstruction(windows: DataFrame, model: LowRank) -> DataFrame:
    """``windows`` with their low-rank ``reconstruction``; padding takes no part in it."""
    shared = windows.sparkSession.sparkContext.broadcast(model)  # a size set by the parameters

    @F.pandas_udf("array<array<double>>")
    def again(values: pd.Series, length: pd.Series) -> pd.Series:
        m, out = shared.value, [None] * len(values)
        for n in length.unique():
            rows = np.flatnonzero((length == n).to_numpy())
            x = np.array([np.concatenate(values.iloc[r]) for r in rows], float).reshape(len(rows), -1)
            for r, y in zip(rows, rebuilt(x, int(n), m), strict=True):
                out[r] = y.reshape(-1, m.features).tolist()
        return pd.Series(out)

    return windows.withColumn("reconstruction", again("values", "length"))
