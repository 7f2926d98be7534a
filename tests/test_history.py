"""History features must not read ahead, and must not depend on how rows are dealt."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from riskloom.operators import encoders, history, sequences, splits
from riskloom.operators.history import HOUR


@pytest.fixture(scope="module")
def frame(spark):
    rng = random.Random(1)
    rows, us = [], 1_700_000_000_000_000
    for i in range(300):
        us += rng.choice([0, 60, 600, 7200]) * 1_000_000
        rows.append((i, us, round(rng.lognormvariate(3, 1), 3), rng.randrange(12) ** 2 // 12, rng.choice(["a", "b", None]), rng.random() < 0.1))
    return spark.createDataFrame(rows, "transaction_id long, us long, amount double, account_id long, device string, is_fraud boolean")


def features(df):
    out = history.with_velocity(history.with_familiarity(history.with_amount_z(history.with_prior_counts(df)), "device"))
    return {r.transaction_id: r for r in out.collect()}


def plain(rows):
    """Every value from the account's earlier rows, one row at a time."""
    out, seen = {}, {}
    for r in sorted(rows, key=lambda r: (r.us, r.transaction_id)):
        before = seen.setdefault(r.account_id, [])
        amounts = [b.amount for b in before]
        mean = sum(amounts) / len(amounts) if amounts else None
        spread = (sum((a - mean) ** 2 for a in amounts) / (len(amounts) - 1)) ** 0.5 if len(amounts) > 1 else 0
        hour = [x for x in rows if x.account_id == r.account_id and r.us - HOUR < x.us <= r.us]
        out[r.transaction_id] = (len(before), (r.us - before[-1].us) / 1e6 if before else None, mean, (r.amount - mean) / spread if spread else None, not any(b.device == r.device for b in before), len(hour))
        before.append(r)
    return out


def test_values_are_those_of_a_row_by_row_walk(frame):
    expected = plain(frame.collect())
    for i, r in features(frame).items():
        n, gap, mean, z, new, hour = expected[i]
        assert (r.prior_count, r.seconds_since_prior, r.device_is_new, r.count_1h) == (n, gap, new, hour)
        assert r.prior_mean == pytest.approx(mean) and r.amount_z == pytest.approx(z)


@pytest.mark.parametrize("cut", [40, 155, 260])
def test_a_row_s_features_do_not_change_when_later_rows_go(frame, cut):
    end = frame.filter(f"transaction_id = {cut}").first().us
    whole, early = features(frame), features(frame.filter(f"us <= {end}"))
    assert early and all(whole[i] == r for i, r in early.items())


def test_the_truncation_check_catches_a_leak(frame):
    leaky = lambda df: {r.transaction_id: r.m for r in df.withColumn("m", F.avg("amount").over(history.Window.partitionBy("account_id"))).collect()}
    whole, early = leaky(frame), leaky(frame.filter("transaction_id < 150"))
    assert any(whole[i] != m for i, m in early.items())


def test_dealing_rows_differently_changes_nothing(frame):
    assert features(frame) == features(frame.orderBy(F.rand(3)).repartition(7))


def test_identical_amounts_have_no_z(spark):
    same = spark.createDataFrame([(i, i * 1_000_000, 0.1, 1) for i in range(50)], "transaction_id long, us long, amount double, account_id long")
    assert {r.amount_z for r in history.with_amount_z(same).collect()} == {None}


def test_as_of_leaves_the_row_itself_out(frame):
    got = history.as_of(frame, frame, 3).collect()
    assert all(r.h_id != r.transaction_id and r.h_us <= r.us and r.nth <= 3 for r in got)


def test_windows_read_no_future(frame):
    w = sequences.trailing_windows(frame, ["amount"], 5)
    assert sequences.future_reads(w).count() == 0
    assert sequences.future_reads(w.withColumn("us", F.col("us") - 10**9)).count() > 0
    assert {r.length for r in w.collect()} == {1, 2, 3, 4, 5}


def test_splits_cut_between_timestamps_and_refuse_empty_ones(spark):
    days = [1] * 7 + [2] * 7 + [3] * 3 + [4] * 3
    df = spark.createDataFrame([(i, d, i % 3 == 0) for i, d in enumerate(days)], "transaction_id long, us long, is_fraud boolean")
    got = splits.assign_splits(df)
    assert {(r.us, r.split) for r in got.collect()} == {(1, "train"), (2, "train"), (3, "val"), (4, "test")} and got.count() == 20
    assert splits.boundary_overlaps(splits.split_summary(got)).count() == 0
    with pytest.raises(ValueError):
        splits.assign_splits(df.filter("us < 3"))
    with pytest.raises(ValueError):
        splits.assign_splits(df.withColumn("us", F.lit(None).cast("long")))
    sliced = splits.validation_slices(df, ["us", "transaction_id"])
    assert sorted(r.position for r in sliced.collect()) == list(range(20))
    assert [r.sound for r in splits.fold_check(splits.time_blocks(df, 2)).collect()] == [True]
    with pytest.raises(ValueError):
        splits.time_blocks(df, 3)  # the first timestamp alone is past a third


def test_encoders_know_only_the_training_rows(spark, frame):
    train = frame.filter("transaction_id < 100")
    fitted = encoders.fit_frequencies(train, ["device"])
    assert sum(r.freq for r in fitted.collect()) == pytest.approx(1)
    odd = frame.limit(1).withColumn("device", F.lit("never seen"))
    assert encoders.apply_frequencies(odd, fitted, ["device"]).first().device_freq == 0
    changed = encoders.digest(fitted.withColumn("freq", F.col("freq") + 1e-5)).first().digest
    assert encoders.digest(fitted).first().digest != changed
    codes = encoders.level_codes(frame, "device", ["a", "b"]).select("device", "device_code").distinct().collect()
    assert {(r.device, r.device_code) for r in codes} == {("a", 0), ("b", 1), (None, -1)}


@pytest.mark.parametrize("chunk", [HOUR, 5 * HOUR, 1000 * HOUR])
def test_splitting_an_account_s_time_changes_no_value(frame, chunk):
    windows = {"1h": HOUR}
    whole = {r.transaction_id: (r.count_1h, round(r.sum_1h, 9), r.prior_count, r.seconds_since_prior) for r in history.with_velocity(history.with_prior_counts(frame), windows).collect()}
    split = history.split_velocity(history.split_prior_counts(frame, chunk), windows, chunk)
    assert whole == {r.transaction_id: (r.count_1h, round(r.sum_1h, 9), r.prior_count, r.seconds_since_prior) for r in split.collect()}


@pytest.mark.parametrize("chunk", [3 * HOUR, 10**15])
def test_as_of_is_that_of_brute_force(spark, frame, chunk):
    rows = frame.select("transaction_id", "us", "account_id", "amount").collect()
    rng = random.Random(5)
    asked = [(r.transaction_id, r.us, r.account_id) for r in rows if r.transaction_id % 3 == 0]
    asked += [(10_000 + i, rng.choice(rows).us + rng.choice((-1, 0, 1, 10**13)), rng.choice([*range(14), 99])) for i in range(60)] + [(20_000, None, 1), (20_001, rows[5].us, None)]
    got = {}
    for r in history.as_of(spark.createDataFrame(asked, "transaction_id long, us long, account_id long").repartition(5), frame.repartition(3), 4, chunk).collect():
        got.setdefault(r.transaction_id, {})[r.nth] = (r.h_us, r.h_id, r.h_amount)
    want = {}
    for i, us, account in asked:
        before = [] if us is None else sorted(((h.us, h.transaction_id, h.amount) for h in rows if h.account_id == account and h.us <= us and h.transaction_id != i), reverse=True)[:4]
        if before:
            want[i] = dict(enumerate(before, 1))
    assert got == want
