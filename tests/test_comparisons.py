"""Operating points, policies at shared rates, off-policy estimates and the winner's report, against loops."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.operators import assembly, costs


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(5)
    score = np.round(rng.random(300), 2)  # many ties
    return [(i, float(s), bool(rng.random() < s / 3), float(np.round(rng.gamma(2, 50), 2))) for i, s in enumerate(score)]


@pytest.fixture(scope="module")
def df(spark, rows):
    return spark.createDataFrame(rows, "row long, score double, label boolean, amount double")


def test_points_of_each_policy_are_those_of_a_loop(df, rows):
    policies = {"score": F.col("score"), "amount": F.col("amount"), "same": F.lit(1.0)}
    got = {(r.policy, r.point): r for r in costs.policy_table(df, policies, (0.1, 0.3), "score", costs.CostModel(20.0, 15.0)).collect()}
    ranks = {"score": [r[1] for r in rows], "amount": [r[3] for r in rows], "same": [1.0] * len(rows)}
    curves = {}
    for name, rank in ranks.items():
        curves[name] = []
        for t in [*sorted(set(rank)), float("inf")]:
            flag = [x >= t for x in rank]
            cost = sum(20 if f and not r[2] else r[3] + 15 if r[2] and not f else 0 for f, r in zip(flag, rows, strict=True))
            curves[name].append((sum(flag), t, cost))
    best = {name: min(c, key=lambda x: (round(x[2], 6), x[0])) for name, c in curves.items()}
    for name, c in curves.items():
        most = {"cap_0.1": 30, "cap_0.3": 90, "matched": best["score"][0]}
        want = {p: max((x for x in c if x[0] <= m), key=lambda x: x[0]) for p, m in most.items()} | {"optimum": best[name]}
        for point, (flagged, threshold, cost) in want.items():
            r = got[name, point]
            assert (r.flagged, r.threshold) == (flagged, threshold) and r.cost == pytest.approx(cost), (name, point)
    assert len(got) == 12 and got["same", "cap_0.3"].flagged == 0  # one tie of all rows is over any cap


def test_no_block_threshold_lies_below_review(df):
    free = costs.block_threshold(df, 0.05, 10).first()
    point = costs.operating_points(df, 0.1, 0.05, 10, costs.CostModel(20.0, 15.0)).first()
    assert free.threshold < point.review_threshold <= point.block_threshold
    assert point.at_block <= point.at_review
    never = costs.operating_points(df, 0.1, 1.01, 10).first()
    assert never.block_threshold is None and never.at_block == 0


def test_the_weighted_estimate_meets_the_truth(spark):
    rng = np.random.default_rng(11)
    n = 20_000
    label, amount, chance = rng.random(n) < 0.3, rng.gamma(2, 20, n), rng.uniform(0.2, 0.8, n)
    blocked, target = rng.random(n) < chance, amount > 40
    rows = list(zip(label.tolist(), amount.tolist(), blocked.tolist(), target.tolist(), np.where(blocked, chance, 1 - chance).tolist(), [1.0] * n, [1.0] * n, strict=True))
    logged = spark.createDataFrame(rows, "label boolean, amount double, blocked boolean, target boolean, propensity double, cost_blocked double, cost_allowed double")
    out = {r.estimator: r for r in costs.off_policy_report(logged).collect()}
    truth = np.where(target & ~label, 3.0, np.where(~target & label, amount + 15, 0.0)).mean()
    assert all(r.truth == pytest.approx(truth) and r.positivity for r in out.values())
    assert abs(out["weighted"].relative_bias) < 0.05 and abs(out["doubly_robust"].relative_bias) < 0.05
    assert out["direct"].relative_bias == pytest.approx((1 - truth) / truth)  # the outcome model here is no good
    rare = logged.withColumn("propensity", F.when(F.rand(1) < 0.1, 1e-4).otherwise(F.col("propensity")))
    assert not costs.off_policy_report(rare).first().positivity


def test_the_winner_is_chosen_apart_from_where_it_is_measured(df):
    scores = df.withColumns({"good": F.col("score"), "copy": F.col("score"), "noise": F.rand(3), "late": F.when(F.col("row") < 150, F.rand(4)).otherwise(F.col("label").cast("double"))})
    early, late = scores.filter("row < 150"), scores.filter("row >= 150")
    out = {r.role: r for r in assembly.winner_report(early, late, ["good", "copy", "late"], "noise", "row", 200).collect()}
    assert {r.winner for r in out.values()} == {"copy"}  # the one that is perfect on the measured rows is not chosen
    assert (out["runner_up"].rival, out["runner_up"].lo, out["runner_up"].hi, out["runner_up"].verdict) == ("good", 0.0, 0.0, "not significant")
    assert out["baseline"].rival == "noise" and out["baseline"].lo < out["baseline"].metric - out["baseline"].rival_metric < out["baseline"].hi
    assert (out["baseline"].verdict == "significant") == (out["baseline"].lo > 0)
