"""Stream state carried from one micro-batch to the next, against brute force."""

from __future__ import annotations

import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from riskloom.operators import serving
from riskloom.streaming import jobs

DAY = jobs.DAY_US


def brute_force(batches):
    out, seen, n = {}, [], {}
    for batch in batches:
        rows = sorted(batch, key=lambda r: (r[2], r[0]))
        here = [r[1:] for r in rows]
        for i, (t, account, us) in enumerate(rows):
            earlier = [x for a, x in seen if a == account and x <= us] + [x for a, x in here[:i] if a == account]
            gap = (us - max(earlier)) / 1e6 if earlier else None
            count = sum(a == account and us - DAY < x <= us for a, x in seen + here)
            out[t] = (account, n.get(account, 0), gap, count)
            n[account] = n.get(account, 0) + 1
        seen += here
    return out


def some_batches():
    rng = np.random.default_rng(8)
    batches, t = [], 0
    for b in range(4):
        rows = []
        for account, n in ((1, 900), (2, 7), (b + 10, 3)):  # account 1 has far more than 500 events a day
            for us in rng.integers(b * DAY // 2, (b + 1) * DAY // 2, n).tolist():
                rows.append((t, account, us))
                t += 1
        rows.append((t, 1, rows[0][2]))  # two at one instant
        rows.append((t + 1, 2, max(0, b * DAY // 2 - DAY // 3)))  # late by a third of a day
        t += 2
        batches.append(rows)
    return batches


@pytest.fixture
def streamed(spark, tmp_path):
    def run(batches):
        folder = tmp_path / "in"
        folder.mkdir()
        for i, rows in enumerate(batches):
            path = folder / f"part-{i}.parquet"
            pd.DataFrame(rows, columns=["transaction_id", "account_id", "us"]).to_parquet(path)
            os.utime(path, (1_700_000_000 + i, 1_700_000_000 + i))  # the source takes files by age
        return jobs.source(spark, str(folder), files=1)

    return run


def test_history_is_carried_between_batches(streamed):
    batches = some_batches()
    got = {r[0]: (r[1], r[2], r[3], r[4]) for r in jobs.replayed(jobs.keyed_history(streamed(batches))).collect()}
    want = brute_force(batches)
    assert got.keys() == want.keys()
    for t, (account, prior, gap, count) in want.items():
        assert got[t][:2] == (account, prior) and got[t][3] == count, t
        assert got[t][2] is None if gap is None else got[t][2] == pytest.approx(gap), t
    assert max(r[3] for r in got.values()) > 500


def test_repeats_of_another_batch_are_dropped(streamed):
    first = [(i, 1, DAY + i * 1_000_000) for i in range(20)]
    events = streamed([first, first[10:] + [(50, 2, DAY + 5_000_000)]])
    out = jobs.replayed(jobs.without_repeats(events.withColumn("event_time", F.timestamp_micros("us")), ["transaction_id"]))
    assert sorted(r[0] for r in out.collect()) == [*range(20), 50]


def test_late_rows_go_aside(spark):
    rows = spark.createDataFrame([(1, 0), (2, DAY), (3, 2 * DAY)], "transaction_id long, us long")
    on_time, late = jobs.late_rows(rows, 2 * DAY)
    assert sorted(r[0] for r in on_time.collect()) == [2, 3] and [r[0] for r in late.collect()] == [1]


def rebuilt(rows):
    """Rings of undirected edges by union-find, named by their least node."""
    root = {}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for _, a, b in rows:
        for x in (a, b):
            root.setdefault(x, x)
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {x: find(x) for x in root}


def test_rolling_rings_equal_a_rebuild_after_every_batch(spark, tmp_path):
    from collections import Counter

    from riskloom.streaming.rolling import RollingGraph

    rng = np.random.default_rng(12)
    graph, held, cutoff = RollingGraph(str(tmp_path / "rolling"), 100), [], -(10**9)
    for n in range(6):
        high = 60 * (n + 1)
        size = (12, 9, 0, 14, 5, 3)[n]
        batch = [(int(t), f"n{a:02}", f"n{b:02}") for t, a, b in zip(rng.integers(high - 90, high, size), rng.integers(0, 14, size), rng.integers(0, 14, size), strict=True)]
        df = spark.createDataFrame([*batch, (None, "n01", "n02"), (high, None, "n03")], "us long, src string, dst string")
        before = {r.node: r.ring for r in graph.rings(spark, n - 1).collect()}
        for _ in range(2 if n == 3 else 1):  # one batch is delivered twice
            graph.apply(df, n)
        cutoff = max([cutoff, *(t - 100 for t, _, _ in batch)])
        fresh = [r for r in batch if r[0] >= cutoff]
        gone = [r for r in held if r[0] < cutoff]
        held = [r for r in held if r[0] >= cutoff] + fresh
        want = rebuilt(held)
        assert {r.node: r.ring for r in graph.rings(spark, n).collect()} == want
        assert {(r.u, r.v): r.flows for r in graph.edges(spark, n).collect()} == Counter(tuple(sorted(r[1:])) for r in held)
        assert {r.node for r in graph.touched(spark, n).collect()} == {x for r in fresh + gone for x in r[1:]}
        notes = graph.notes(spark, n).first()
        assert (notes.inserted, notes.late, notes.evicted) == (len(fresh), len(batch) - len(fresh), len(gone))
        assert notes.recomputed <= len(set(before) | set(want))
        if n == 2:
            assert notes.recomputed == 0
    graph.snapshot(spark, 5, max(r[0] for r in held) + 1)
    with pytest.raises(ValueError):
        graph.snapshot(spark, 5, max(r[0] for r in held))


def test_scores_in_the_stream_are_those_of_the_table(spark, tmp_path):
    """Several micro-batches with late rows: the same features, so the same scores, prices and decisions as in one table."""
    from riskloom.operators.costs import CostModel
    from riskloom.sources import scorers

    rng = np.random.default_rng(2)
    batches = some_batches()
    amount = {t: float(np.round(rng.gamma(2, 60), 2)) for b in batches for t, _, _ in b}
    amount[batches[1][5][0]] = None
    folder = tmp_path / "in"
    folder.mkdir()
    for i, rows in enumerate(batches):
        frame = pd.DataFrame([(*r, amount[r[0]]) for r in rows], columns=["transaction_id", "account_id", "us", "amount"])
        frame.to_parquet(folder / f"part-{i}.parquet")
        os.utime(folder / f"part-{i}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))
    known = brute_force(batches)
    schema = "transaction_id long, account_id long, prior_count long, seconds_since_prior double, count_24h long, amount double"
    table = spark.createDataFrame([(t, *v, amount[t]) for t, v in known.items()], schema)
    labelled = jobs.stream_features(table.filter("amount IS NOT NULL")).withColumn("label", (F.col("amount") > 150) & (F.pmod("transaction_id", F.lit(7)) != 0))
    scorers.store_scorer(scorers.fit_scorer(labelled, jobs.STREAM_FEATURES, "v1"), spark, str(tmp_path / "scorer"))
    with pytest.raises(ValueError):
        scorers.read_scorer(spark, str(tmp_path / "scorer"), "v2")
    scorer = scorers.read_scorer(spark, str(tmp_path / "scorer"), "v1")
    live = jobs.keyed_history(jobs.source(spark, str(folder), files=1), carry=("amount",))
    columns = ["transaction_id", "score", "cost_blocked", "cost_allowed", "degraded", "decision"]
    got = {r[0]: r for r in jobs.replayed(jobs.scored(live, scorer, 0.3, 0.7).select(*columns)).collect()}
    want = {r[0]: r for r in jobs.scored(table, scorer, 0.3, 0.7).select(*columns).collect()}
    assert got == want and len(got) == sum(map(len, batches))
    assert {r.decision for r in got.values()} == {"allow", "review", "block"}
    lost = got[batches[1][5][0]]
    assert (lost.score, lost.cost_blocked, lost.degraded, lost.decision) == (None, None, True, "review")
    some, costs = got[batches[0][3][0]], CostModel()
    assert some.cost_blocked == pytest.approx(costs.review * (1 - some.score))
    assert some.cost_allowed == pytest.approx(some.score * (amount[some.transaction_id] + costs.fee))


def test_the_feed_is_the_page_after_every_batch(spark, tmp_path):
    rng = np.random.default_rng(6)
    folder = tmp_path / "in"
    folder.mkdir()
    batches, t = [], 0
    for i in range(4):
        rows = [(t + k, int(rng.integers(0, 3)), int(rng.integers(i * 50, i * 50 + 90)), str(rng.choice(["allow", "review", "block"]))) for k in range(40)]
        t += 40
        batches.append(rows + (batches[-1][:5] if i == 2 else []))  # some come twice
        pd.DataFrame(batches[-1], columns=["transaction_id", "account_id", "us", "decision"]).to_parquet(folder / f"part-{i}.parquet")
        os.utime(folder / f"part-{i}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))
    pages = {}
    jobs.replayed(jobs.decision_feed(jobs.source(spark, str(folder), files=1), 25), lambda df, n: pages.__setitem__(n, df.collect()))
    assert len(pages) == 4
    for n, page in pages.items():
        seen = {r for b in batches[: n + 1] for r in b}
        assert {r.account_id for r in page} == {r[1] for r in batches[n]}
        for r in page:
            want = sorted(((us, i, d) for i, a, us, d in seen if a == r.account_id), reverse=True)[:25]
            assert list(zip(r.us, r.transaction_id, r.decision, strict=True)) == want
            assert r.block_share == pytest.approx(np.mean([d == "block" for _, _, d in want]))
            assert r.review_share == pytest.approx(np.mean([d == "review" for _, _, d in want]))


def test_context_in_the_stream_is_that_of_the_table(spark, tmp_path):
    rng = np.random.default_rng(21)
    rows, t = [], 0
    for account, n, level in ((1, 500, 1e6), (2, 60, 3.0), (3, 1, 1.0), (4, 40, 7.0)):
        for us in np.sort(rng.integers(0, 2 * DAY, n)).tolist():
            far = 40 if rng.random() < 0.05 else 1
            amount = 7.0 if account == 4 else level + far * float(rng.normal())  # account 4 always pays the same
            rows.append((t, account, us, None if account == 1 and t % 50 == 7 else amount))
            t += 1
    rows += [(t + i, 2, DAY + i, 3.0) for i in range(15)]  # a rush within one hour
    rows.sort(key=lambda r: (r[2], r[0]))
    folder = tmp_path / "in"
    folder.mkdir()
    bounds = [0, 90, 300, 301, len(rows)]
    for i, (a, b) in enumerate(zip(bounds, bounds[1:])):
        path = folder / f"part-{i}.parquet"
        spark.createDataFrame(rows[a:b], "transaction_id long, account_id long, us long, amount double").toPandas().to_parquet(path)
        os.utime(path, (1_700_000_000 + i, 1_700_000_000 + i))
    schema = "transaction_id long, account_id long, us long, amount double"
    columns = ["transaction_id", "amount_unusual", "rate_unusual", "rationale", "amount"]
    live = jobs.risk_context(jobs.source(spark, str(folder), files=1), carry=("amount",))
    got = {tuple(r) for r in jobs.replayed(live).select(*columns).fillna(-1.0).collect()}
    table = serving.risk_context(spark.createDataFrame(rows, schema))
    want = {tuple(r) for r in table.select(*columns).fillna(-1.0).collect()}
    assert got == want
    assert {r[3] for r in want} >= {"unusual amount", "unusual rate", "in line with history"}


def test_keyed_history_makes_no_column_into_pandas_unread(spark):
    from riskloom.plans import streams

    stream = streams._events(spark, "/root/testdata/sf0.001")
    assert {"event_time", "transaction_type"} <= set(stream.columns)
    plan = jobs.keyed_history(stream, carry=("amount", "us"))._jdf.queryExecution().analyzed().toString().splitlines()
    at = next(i for i, line in enumerate(plan) if "FlatMapGroupsInPandasWithState" in line)
    read = " ".join(plan[at + 1 : at + 3])
    assert "amount" in read and "event_time" not in read.split("Project")[1] and "transaction_type" not in read.split("Project")[1]
