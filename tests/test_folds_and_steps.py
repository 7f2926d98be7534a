"""Folds learn from what came before alone; padding never changes a window's error."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.operators import folds, sequences
from riskloom.operators.encoders import fit_frequencies


def rates(rows, features):
    overall = rows.agg(F.avg(F.col("label").cast("int"))).first()[0]
    return lambda df, name: df.withColumn(name, sum((F.col(f) for f in features if f != "amount"), F.lit(overall)) + F.pmod("id", F.lit(3)))


@pytest.fixture(scope="module")
def chained(spark):
    rows = [(i, i * 10, f"k{i // 25}", f"s{i // 10}", float(i), i % 3 == 0) for i in range(100)]  # levels come up with time
    df = spark.createDataFrame(rows, "id long, us long, kind string, shop string, amount double, label boolean")
    return folds.forward_chained(df.filter("id < 80"), df.filter("id >= 80"), ["amount", "kind", "shop"], rates, 4, "id", ("label",), 3)


def test_no_spec_holds_a_level_of_its_own_block(chained):
    for k, spec in chained.specs.items():
        if k < 4:
            known = {r.category for r in spec.encoders.collect()} | {v for levels in spec.levels.values() for v in levels}
            assert known
            assert not known & {f"s{i}" for i in range(2 * k, 10)}  # a block is 20 rows, two shops
            assert not known & {f"k{i}" for i in range(4) if i * 25 >= 20 * k}
    versions = {(str(s.levels), frozenset((r.category, r.freq) for r in s.encoders.collect())) for s in chained.specs.values()}
    assert len(versions) == len(chained.specs)


def test_every_later_block_is_scored_once_and_ranked_within_itself(chained):
    rows = chained.scores.collect()
    assert sorted(r.id for r in rows) == list(range(80))
    assert all((r.raw is None) == (r.block == 0) == (r.normalised is None) for r in rows)
    for k in (1, 2, 3):
        raw = np.array([r.raw for r in rows if r.block == k])
        want = [((raw < x).sum() + ((raw == x).sum() - 1) / 2) / (len(raw) - 1) for x in raw]
        assert [r.normalised for r in rows if r.block == k] == pytest.approx(want)


def test_handicaps_have_both_metrics_and_growing_fits(chained):
    rows = sorted(chained.handicap.collect(), key=lambda r: r.fold)
    assert [r.fit_rows for r in rows] == [20, 40, 60]
    assert [r.fit_positives for r in rows] == [7, 14, 20]
    assert all(r.handicap == pytest.approx(r.full_precision - r.fold_precision) for r in rows)
    assert chained.validation.filter("mapped BETWEEN 0 AND 1").count() == 20


def test_denied_columns_and_blocks_of_one_instant_are_refused(spark):
    df = spark.createDataFrame([(i, 5, True, 1.0) for i in range(8)], "id long, us long, label boolean, amount double")
    with pytest.raises(ValueError):
        folds.forward_chained(df, df, ["amount"], rates, 2, "id")
    df = df.withColumn("us", F.col("id"))
    with pytest.raises(ValueError):
        folds.forward_chained(df, df, ["amount", "label"], rates, 2, "id", ("label",))


WIDTH, FEATURES = 5, ["a", "b", "c"]


@pytest.fixture(scope="module")
def windows(spark):
    rng = np.random.default_rng(3)
    rows = []
    for account in range(40):
        level = rng.normal(size=3)
        rows += [(100 * account + i, account, i, *(level + 0.3 * i * np.array([1.0, -1.0, 0.5]) + 0.1 * rng.normal(size=3)).tolist()) for i in range(rng.integers(1, 9))]
    df = spark.createDataFrame(rows, "transaction_id long, account_id long, us long, a double, b double, c double")
    return df, sequences.step_matrices(df, FEATURES, WIDTH)


def arrays(rows, width):
    return np.array([np.concatenate(r["values"]) for r in rows], float).reshape(len(rows), width * 3), np.array([r["length"] for r in rows])


def test_directions_are_those_of_numpy(windows):
    model = sequences.fit_low_rank(windows[1].repartition(7), WIDTH, 3, 3)
    x, n = arrays(windows[1].collect(), WIDTH)
    here = np.repeat(np.arange(WIDTH)[None, :] < n[:, None], 3, axis=1)
    mean = np.array([x[here[:, i], i].mean() for i in range(15)])
    second = np.array([[(x[both, i] * x[both, j]).mean() - mean[i] * mean[j] for j in range(15) for both in [here[:, i] & here[:, j]]] for i in range(15)])
    values, vectors = np.linalg.eigh(second)
    noise = np.maximum(values[:-3], 0).mean()
    assert model.mean == pytest.approx(mean) and model.noise == pytest.approx(noise)
    assert model.axes @ model.axes.T == pytest.approx(vectors[:, -3:] @ np.diag(np.maximum(values[-3:] - noise, 0)) @ vectors[:, -3:].T)


def test_padding_changes_no_error(windows):
    df, narrow = windows
    model = sequences.fit_low_rank(narrow, WIDTH, 3, 3)
    short = narrow.filter(F.col("length") < WIDTH)
    padded = short.withColumn("values", F.concat("values", F.array_repeat(F.array(*[F.lit(0.0)] * 3), 4))).withColumn("mask", F.concat("mask", F.array_repeat(F.lit(0), 4)))
    bare = short.withColumn("values", F.slice("values", 1, F.col("length"))).withColumn("mask", F.slice("mask", 1, F.col("length")))
    errors = [{r.transaction_id: r.error for r in sequences.masked_errors(sequences.with_reconstruction(w, model)).collect()} for w in (short, padded, bare)]
    assert len(errors[0]) > 40
    assert errors[0] == pytest.approx(errors[1]) and errors[0] == pytest.approx(errors[2])


def test_errors_shares_and_drivers_are_those_of_a_loop(windows):
    model = sequences.fit_low_rank(windows[1], WIDTH, 3, 2)
    rows = sequences.masked_errors(sequences.with_reconstruction(windows[1], model)).cache()
    got = {(r.transaction_id, r.offset): r for r in sequences.step_drivers(rows, FEATURES, 2).collect()}
    assert len(got) == sum(r.length for r in rows.collect())
    for r in rows.collect():
        x = np.array(r["values"][: r.length])
        axes, mean = model.axes[: 3 * r.length], model.mean[: 3 * r.length]
        z = np.linalg.inv(axes.T @ axes + model.noise * np.eye(2)) @ axes.T @ (x.ravel() - mean)
        squares = (x - (mean + axes @ z).reshape(-1, 3)) ** 2
        assert r.error == pytest.approx(squares.mean())
        assert r.step_errors[r.length :] == [0.0] * (WIDTH - r.length)
        for i, s in enumerate(squares):
            d = got[r.transaction_id, r.length - 1 - i]
            assert d.share == pytest.approx(s.sum() / squares.sum())
            assert [f.name for f in d.top_features] == [FEATURES[j] for j in np.argsort(-s, kind="stable")[:2]]


def test_first_rows_have_flags_and_no_made_up_history(spark):
    rows = [(1, 7, 0, 10.0, "x", "p"), (2, 7, 60_000_000, 20.0, None, "p"), (3, 7, 120_000_000, 40.0, "x", "q"), (4, 8, 0, None, None, None)]
    df = spark.createDataFrame(rows, "transaction_id long, account_id long, us long, amount double, device string, place string")
    out = {r.transaction_id: r for r in sequences.step_columns(df, ["device"], fit_frequencies(df.filter("transaction_id < 3"), ["device"])).collect()}
    assert (out[1].gap_log, out[1].amount_z, out[1].device_mismatch, out[1].has_prior, out[1].has_z) == (None, None, None, 0.0, 0.0)
    assert out[2].gap_log == pytest.approx(np.log(61)) and out[2].device_is_new == 1.0 and out[2].device_freq == 0.5
    assert out[3].amount_z == pytest.approx((40 - 15) / np.std([10, 20], ddof=1)) and out[3].has_z == 1.0 and out[3].device_mismatch == 0.5
    assert out[4].amount_log is None or out[4].amount_log == 0.0
    empty = sequences.step_columns(df.limit(0), ["device"], fit_frequencies(df, ["device"]))
    assert empty.columns == ["transaction_id", "account_id", "us", *sequences.STEP_COLUMNS, "device_freq"] and empty.count() == 0
