"""Threshold operators against a walk over all thresholds, resampling against itself."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from riskloom.operators import assembly, costs, metrics
from riskloom.operators.costs import CostModel
from riskloom.operators.ordering import global_cumulate, global_rank


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    out = []
    for i in range(400):
        s = round(rng.random(), 2)
        out.append((i, i % 7, s, round(rng.random(), 1), rng.random() < 0.1 + 0.5 * s, round(rng.lognormvariate(4, 1), 2)))
    return out


@pytest.fixture(scope="module")
def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, line long, score double, other double, label boolean, amount double").repartition(5)


def arrays(rows):
    return np.array([r[2] for r in rows]), np.array([r[4] for r in rows]), np.array([r[5] for r in rows])


def test_running_sums_over_a_global_order(spark):
    df = spark.createDataFrame([(i % 50, i) for i in range(1000)], "k long, v long")
    got = {r.k: (r.v, r.cum_v) for r in global_cumulate(df.repartition(9), "k", {"v": F.col("v")}).collect()}
    total = 0
    for k in range(50):
        own = sum(i for i in range(1000) if i % 50 == k)
        total += own
        assert got[k] == (own, total)
    assert sorted(r.position for r in global_rank(df, ["k", "v"]).collect()) == list(range(1000))
    assert global_cumulate(df.limit(0), "k", {"v": F.col("v")}).count() == 0


def test_average_precision_and_rank_auc(frame, rows):
    s, y, _ = arrays(rows)
    ap = before = 0.0
    for t in sorted(set(s), reverse=True):
        flag = s >= t
        recall = (flag & y).sum() / y.sum()
        ap += (recall - before) * (flag & y).sum() / flag.sum()
        before = recall
    assert metrics.average_precision(frame).first().average_precision == pytest.approx(ap)
    auc = np.mean([(p > n) + (p == n) / 2 for p in s[y] for n in s[~y]])
    assert metrics.rank_auc(frame).first().rank_auc == pytest.approx(auc)


def test_cost_curve_and_its_minimum(frame, rows):
    s, y, a = arrays(rows)
    model = CostModel(40.0, 15.0)
    expected = {t: 40 * ((s >= t) & ~y).sum() + (a + 15)[(s < t) & y].sum() for t in [*sorted(set(s)), float("inf")]}
    got = {r.threshold: r.cost for r in costs.cost_curve(frame, model).collect()}
    assert got.keys() == expected.keys() and all(got[t] == pytest.approx(expected[t]) for t in got)
    assert costs.cheapest(costs.cost_curve(frame, model)).first().cost == pytest.approx(min(expected.values()))
    at = costs.at_threshold(frame, 0.5, model).first()
    assert at.cost == pytest.approx(expected[0.5]) and at.flagged == (s >= 0.5).sum()


def test_threshold_choices(frame, rows):
    s, y, _ = arrays(rows)
    assert costs.capacity_threshold(frame, 0.1).first().threshold == s[s > np.quantile(s, 0.9)].min()
    reach = [t for t in set(s) if ((s >= t) & y).sum() >= 0.8 * y.sum()]
    assert costs.recall_threshold(frame, 0.8).first().threshold == max(reach)
    fine = [t for t in set(s) if (s >= t).sum() >= 50 and (y & (s >= t)).sum() >= 0.5 * (s >= t).sum()]
    assert costs.block_threshold(frame, 0.5).first().threshold == min(fine)


def test_a_policy_against_itself_is_a_tie_and_noise_is_worse(frame):
    same = metrics.bootstrap(frame.withColumn("again", F.col("score")), ["id"], 30, ("score", "again"))
    row = metrics.interval(same.withColumn("d", F.col("ap_score") - F.col("ap_again")), "d").first()
    assert row.lo == row.hi == 0 and row.verdict == "TIE"
    noise = metrics.bootstrap(frame.withColumn("noise", metrics.uniform(F.lit("n"), F.col("id"))), ["id"], 60, ("score", "noise"))
    assert metrics.interval(noise.withColumn("d", F.col("ap_noise") - F.col("ap_score")), "d").first().verdict == "WORSE"


def test_models_and_intervals_have_their_size(monkeypatch):
    from types import SimpleNamespace

    from riskloom.plans import assembly as plans
    from riskloom.plans import models as scorers

    class Stop(Exception):
        pass

    def stop(*args, **more):
        raise Stop({"args": args, **more})

    monkeypatch.setattr(scorers, "_rows", lambda *_: None)
    monkeypatch.setattr(scorers, "models", SimpleNamespace(isolation_forest=stop))
    with pytest.raises(Stop) as forest:
        scorers.isolation_scorer(None, "")
    assert forest.value.args[0]["trees"] >= 200
    monkeypatch.setattr(plans.metrics, "bootstrap", stop)
    spark, small = SparkSession.active(), "/root/testdata/sf0.001"
    for q in (plans.fusion_lift, plans.block_ablation):
        with pytest.raises(Stop) as drawn:
            q(spark, small)
        assert drawn.value.args[0]["args"][2] >= 200


def test_poisson_weights_have_mean_and_variance_one(spark):
    w = spark.range(40_000).select(metrics.poisson_weight(metrics.uniform(F.lit("s"), F.col("id"))).alias("w")).agg(F.avg("w"), F.var_pop("w")).first()
    assert w[0] == pytest.approx(1, abs=0.02) and w[1] == pytest.approx(1, abs=0.04)


def test_off_policy_estimates_recover_the_truth(spark):
    rng = np.random.default_rng(0)
    rows = []
    for _ in range(20_000):
        x = rng.random()
        p = 0.2 + 0.6 * x
        action = "block" if rng.random() < p else "allow"
        loss = {"block": 3.0, "allow": 20 * x}[action] + rng.normal()
        rows.append((action, "block", p if action == "block" else 1 - p, loss, 0.0, 0.0))
    logged = spark.createDataFrame(rows, "action string, target string, propensity double, loss double, model_target double, model_logged double")
    out = costs.off_policy(logged).first()
    assert out.ipw == pytest.approx(3.0, abs=0.15) and out.doubly_robust == pytest.approx(3.0, abs=0.15) and out.direct == 0


def test_empirical_cdf_is_linear_between_knots(spark):
    df = spark.createDataFrame([(float(x),) for x in [0, 1, 2, 2, 2, 3, 10]], "x double")
    knots = assembly.ecdf_knots(df, "x", 7)
    got = {r.x: r.share for r in assembly.ecdf(spark.createDataFrame([(float(x),) for x in (-1, 0, 0.5, 2, 6.5, 10, 11)], "x double"), "x", knots).collect()}
    assert got[-1.0] == 0 and got[0.5] == pytest.approx(0.5 / 6) and got[2.0] == pytest.approx(0.5) and got[6.5] == pytest.approx(5.5 / 6) and got[11.0] == 1


@pytest.mark.parametrize("size", [1, 2, 7, 300])
def test_knots_and_shares_are_those_of_numpy(spark, size):
    rng = np.random.default_rng(size)
    x = rng.normal(size=size).round(2) * np.where(rng.random(size) < 0.1, 50, 1)
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "x double")
    for n in (2, 13, 500):
        knots = {r.i: r.knot for r in assembly.ecdf_knots(df, "x", n).collect()}
        want = np.quantile(x, np.linspace(0, 1, n))
        assert [knots[i] for i in range(n)] == pytest.approx(want.tolist(), abs=1e-9)
        asked = [float(v) for v in np.concatenate([x, rng.normal(size=40), [x.min() - 1, x.max() + 1]])]
        table = spark.createDataFrame(list(enumerate(want.tolist())), "i int, knot double")
        got = assembly.ecdf(spark.createDataFrame([(v,) for v in asked] + [(None,)], "x double"), "x", table, buckets=17).collect()
        assert len(got) == len(asked) + 1 and [r.share for r in got if r.x is None] == [None]
        distinct = [v for v in asked if v not in set(want)]
        assert {r.x: r.share for r in got if r.x in distinct} == pytest.approx({v: float(np.interp(v, want, np.linspace(0, 1, n))) for v in distinct})


def test_ablation_looks_both_ways(spark):
    rng = np.random.default_rng(4)
    rows = [(i, bool(y), float(y + rng.normal()), float(rng.normal()), float(rng.normal())) for i, y in enumerate(rng.integers(0, 2, 400))]
    df = spark.createDataFrame(rows, "row long, label boolean, good double, base double, noise double").withColumn("same", F.col("good"))
    fitted = lambda fit, columns: lambda x, name: x.withColumn(name, F.round(sum(({"good": 1.0, "same": 1.0, "noise": 0.1, "base": 0.2}[c] * F.col(c) for c in columns), F.lit(0.0)), 6))
    out = assembly.ablation(df, df, {"b": ["base"], "g": ["good"], "s": ["same"], "n": ["noise"]}, ("b",), fitted, "row", 200).collect()
    by = {(r.block, r.kind): r for r in out}
    assert set(by) == {(b, "leave_one_out") for b in "bgsn"} | {(b, "add_one") for b in "gsn"} and all(r.rows == 400 for r in out)

    def precision(columns):
        weight = {"good": 1.0, "same": 1.0, "noise": 0.1, "base": 0.2}
        score = np.array([sum(weight[c] * {"good": r[2], "same": r[2], "base": r[3], "noise": r[4]}[c] for c in columns) for r in rows]).round(6)
        y = np.array([r[1] for r in rows])
        order = np.argsort(-score, kind="stable")
        return float((np.cumsum(y[order]) / np.arange(1, 401))[y[order]].mean())

    assert by["g", "leave_one_out"].delta == pytest.approx(precision(["base", "good", "same", "noise"]) - precision(["base", "same", "noise"]))
    assert by["s", "add_one"].delta == pytest.approx(precision(["base", "same"]) - precision(["base"]))
    assert by["g", "leave_one_out"].lo < 0.02 < by["g", "add_one"].lo
    assert {r.block for r in out if r.retained} >= {"b", "g", "s"} and not by["n", "add_one"].retained


def test_guards(spark):
    with pytest.raises(ValueError):
        assembly.guard(["amount", "ring_is_fraud"], ("is_fraud",))
    with pytest.raises(ValueError):
        assembly.checked_join(spark.range(3), spark.createDataFrame([(1, 2), (1, 3)], "id long, v long"), ["id"])


def test_draws_are_those_of_the_plain_hash_and_take_a_byte_each():
    import numpy as np

    from riskloom.operators import metrics

    key, every = np.array([0, 1, 7, 2**31 - 1, 123_456_789]), np.arange(300)
    got = metrics.drawn_weights(key, every)
    assert got.dtype.itemsize == 1 and got.shape == (300, 5)
    for r in every.tolist():
        for i, k in enumerate(key.tolist()):
            h = (k * 1_000_003 + r * 7_919 + 12_345) % 2**32
            for _ in range(2):
                h = ((h ^ (h >> 16)) * 73_244_475) % 2**32
            h ^= h >> 16
            assert got[r, i] == sum(h / 2**32 >= s for s in metrics.STEPS)


def test_many_rows_are_many_ranges_of_the_bootstrap():
    from riskloom.operators import metrics

    assert [metrics._ranges(n) for n in (0, 60_000, 36_000_000, 400_000_000)] == [1, 3, 96, 200]


def test_column_quartiles_hold_no_column_in_one_task(spark):
    from riskloom.operators import checks

    rows = [(float(i * i % 97), None if i % 3 else float(i)) for i in range(200)]
    out = checks.column_stats(spark.createDataFrame(rows, "a double, b double"), ["a", "b"])
    assert "percentile" not in out._jdf.queryExecution().toString()
    got = {r.column: (r.n, r.p25, r.p50, r.p75) for r in out.collect()}
    for i, c in enumerate("ab"):
        held = [r[i] for r in rows if r[i] is not None]
        assert got[c] == pytest.approx((len(held), *pd_quartiles(held)))


def pd_quartiles(values):
    import pandas as pd

    return pd.Series(values).quantile([0.25, 0.5, 0.75]).tolist()


def test_quantiles_of_few_groups_deal_no_group_to_one_task(spark):
    from riskloom.operators.metrics import exact_quantiles

    df = spark.range(400).select((F.col("id") % 2).alias("g"), F.col("id").cast("double").alias("x"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = exact_quantiles(df, "x", [0.5], ("g",))
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert {r.g: r.q[0] for r in out.collect()} == {0: 199.0, 1: 200.0} and "BroadcastHashJoin" in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_precisions_of_replicates_are_those_of_plain_loops_and_few_values_draw_once(spark, monkeypatch):
    from riskloom.operators import metrics

    rng = np.random.default_rng(3)
    rows = [(i, float(rng.integers(9)) / 8, float(rng.integers(5)), float(rng.random()), bool(rng.random() < 0.3)) for i in range(3_000)]
    df = spark.createDataFrame(rows, "id long, a double, b double, amount double, label boolean")
    w = metrics.drawn_weights(np.arange(3_000), np.arange(45)).astype(float)
    y = np.array([r[4] for r in rows])
    monkeypatch.setattr(metrics, "_ROWS", 700)
    got = {r.replicate: r for r in metrics.bootstrap(df, ["id"], 45, ("a", "b", "amount")).collect()}
    assert sorted(got) == list(range(45))
    for name, column in (("a", 1), ("b", 2), ("amount", 3)):
        v = np.array([r[column] for r in rows])
        for r in (0, 17, 44):
            scaled = w[r] * np.where(y, y.sum() / w[r][y].sum(), (~y).sum() / w[r][~y].sum())
            want = sum(scaled[y & (v == t)].sum() * scaled[y & (v >= t)].sum() / max(scaled[v >= t].sum(), 1e-300) for t in set(v.tolist()))
            assert got[r][f"ap_{name}"] == pytest.approx(want / y.sum())

    def dealt(*_):
        raise AssertionError("a score of few values is drawn for by itself")

    monkeypatch.setattr(metrics, "_replicated", dealt)
    assert metrics.bootstrap(df, ["id"], 45, ("a", "b")).count() == 45
