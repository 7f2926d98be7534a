"""Fits and windows read rows that were made once, and no wide row is joined again."""

import pytest

SMALL = "/root/testdata/sf0.001"


class Stop(Exception):
    pass


def stopped(monkeypatch, module, name, query, spark):
    def stop(df, *_):
        raise Stop(df)

    monkeypatch.setattr(module, name, stop)
    with pytest.raises(Stop) as held:
        query(spark, SMALL)
    return held.value.args[0]._jdf.queryExecution().optimizedPlan().toString()


def test_a_fit_of_many_rounds_reads_written_rows(spark, monkeypatch):
    from riskloom.plans import models as plans

    plan = stopped(monkeypatch, plans.models, "expected_loss", plans.expected_loss, spark)
    assert "Window" not in plan and "Join" not in plan


def test_windows_are_picked_by_account_and_steps_are_written(spark, monkeypatch):
    from riskloom.plans import sequences as plans

    plan = stopped(monkeypatch, plans.sequences, "fit_low_rank", plans.sequence_anomaly, spark)
    assert "LeftSemi" not in plan and "LeftAnti" in plan and plan.count("Window [") == 1


def test_step_errors_join_no_window_to_itself(spark, monkeypatch):
    from riskloom.plans import sequences as plans

    monkeypatch.setattr(plans, "steps", lambda *_: spark.range(3).selectExpr("id AS transaction_id", "1L AS account_id", "id AS us", *[f"CAST(id AS DOUBLE) AS {c}" for c in plans._SOME]))
    out = plans.masked_step_errors(spark, SMALL)
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString() and out.count() == 6


def test_scores_of_folds_need_no_full_model(spark, monkeypatch):
    from riskloom.plans import models as plans

    fitted, plain = [], plans._rates
    monkeypatch.setattr(plans, "_rates", lambda rows, features: fitted.append(rows) or plain(rows, features))
    assert plans.fold_scores(spark, SMALL).count() and len(fitted) == 4
    assert all("Aggregate" not in rows._jdf.queryExecution().optimizedPlan().toString() for rows in fitted)
