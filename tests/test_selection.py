"""Viability, heads, slices and blocks: what they give and what they refuse."""

from __future__ import annotations

import pytest

from riskloom.operators import assembly, checks, splits


@pytest.mark.parametrize(("links", "verdict"), [(0, "absent"), (4, "weak"), (5, "usable"), (10, "usable")])
def test_the_link_is_judged_by_fraud_that_cashes_out(spark, links, verdict):
    rows = [("a", f"m{i}", "t", True) for i in range(10)] + [("a", "m0", "t", False), ("a", None, "t", False)]
    rows += [(f"m{i}", "x", "c", i < links) for i in range(8)]
    r = checks.graph_viability(spark.createDataFrame(rows, "account_id string, counterparty_id string, transaction_type string, is_fraud boolean"), "t", "c").first()
    assert (r.distinct_ends, r.recurring_ends, r.chain_to_any, r.verdict) == (11, 2, 0.8, verdict if links < 10 else "usable")
    assert r.chain_to_fraud == min(links, 8) / 10


def test_no_fraud_is_no_link(spark):
    r = checks.graph_viability(spark.createDataFrame([], "account_id string, counterparty_id string, transaction_type string, is_fraud boolean"), "t", "c").first()
    assert tuple(r) == (0, 0, 0.0, 0.0, "absent")


def test_heads_are_the_earliest_of_each_split_with_ties_by_id(spark):
    rows = [(i, 5 if i % 2 else i, "ab"[i > 6]) for i in range(10)]
    got = splits.heads(spark.createDataFrame(rows, "transaction_id long, us long, split string").repartition(3), 2).collect()
    assert {(r.split, r.transaction_id) for r in got} == {("a", 0), ("a", 2), ("b", 7), ("b", 9)}


def test_a_slice_without_a_positive_is_refused(spark):
    df = spark.createDataFrame([(i, i, i in (1, 5)) for i in range(10)], "transaction_id long, us long, is_fraud boolean")
    sliced = splits.validation_slices(df, ["us", "transaction_id"])
    with pytest.raises(ValueError, match="late"):
        splits.with_positives(sliced)
    assert splits.with_positives(sliced, wanted=("early", "middle")).count() == 10


def test_blocks_are_whole_and_in_their_order(spark):
    df = spark.createDataFrame([], "a int, b int, c int, label int")
    blocks = {"one": ["b", "a"], "two": ["c", "d"], "three": ["c"], "bad": ["label"]}
    assert assembly.available_blocks(df.columns, blocks) == ["one", "three", "bad"]
    assert assembly.block_columns(df, blocks, ["three", "one"]) == ["b", "a", "c"]
    for chosen in (["two"], ["four"], ["bad"]):
        with pytest.raises(ValueError, match="columns"):
            assembly.block_columns(df, blocks, chosen, ("label",))
