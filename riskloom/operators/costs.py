"""Cost curves, thresholds and policies: a review costs for false alarms, a miss its amount and a fee."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from riskloom.functions.shared import cut

from .metrics import exact_quantiles, hits
from .ordering import global_cumulate


@dataclass(frozen=True)
class CostModel:
    review: float = 3.0
    fee: float = 15.0


def ring_model(row: CostModel = CostModel()) -> CostModel:
    """With a ring as the unit a review takes five times a row's."""
    return CostModel(5 * row.review, row.fee)


def at_threshold(df: DataFrame, threshold: float, model: CostModel = CostModel(), score: str = "score") -> DataFrame:
    flag, y = F.col(score) >= threshold, F.col("label")
    out = df.agg(F.count("*").alias("n"), F.count_if(flag).alias("flagged"), F.count_if(flag & ~y).alias("fp"), F.count_if(~flag & y).alias("fn"), F.coalesce(F.sum(F.when(~flag & y, F.col("amount"))), F.lit(0.0)).alias("missed"), F.coalesce(F.sum(F.when(flag & y, F.col("amount"))), F.lit(0.0)).alias("caught"))
    cost = model.review * F.col("fp") + F.col("missed") + model.fee * F.col("fn")
    return out.select("n", "flagged", (F.col("flagged") / F.col("n")).alias("flag_rate"), cost.alias("cost"), (1000 * cost / F.col("n")).alias("cost_per_1000"), F.try_divide("caught", F.col("caught") + F.col("missed")).alias("value_recall"))


def cost_curve(df: DataFrame, model: CostModel = CostModel(), score: str = "score") -> DataFrame:
    """Cost, caught value and flagged rows at every distinct score, and at the threshold that flags nothing."""
    return priced(_running(df, score), score, F.lit(model.review), F.lit(model.fee))


def _running(df: DataFrame, score: str) -> DataFrame:
    run = global_cumulate(df, score, {"n": F.lit(1), "tp": hits(), "amt": F.when(F.col("label"), F.col("amount")).otherwise(0.0)}, descending=True)
    nothing = run.agg(*[F.lit(float("inf") if c == score else 0).cast(t).alias(c) for c, t in run.dtypes])
    total = run.agg(F.sum("tp").alias("all_tp"), F.sum("amt").alias("all_amt"))
    return run.unionByName(nothing).crossJoin(F.broadcast(total))  # one row


def priced(run: DataFrame, score: str, review: Column, fee: Column, *more: str) -> DataFrame:
    missed = F.col("all_amt") - F.col("cum_amt")
    cost = review * (F.col("cum_n") - F.col("cum_tp")) + missed + fee * (F.col("all_tp") - F.col("cum_tp"))
    return run.select(*more, F.col(score).alias("threshold"), F.col("cum_n").alias("flagged"), F.col("cum_amt").alias("caught"), cost.alias("cost"))


def cheapest(curve: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """The least cost; among equals the fewest flagged."""
    return curve.groupBy(*by).agg(F.min(F.struct(F.round("cost", 6).alias("cost"), "flagged", "threshold")).alias("b")).select(*by, "b.threshold", "b.cost", "b.flagged")


def sensitivity(df: DataFrame, grid: list[tuple[float, float]], score: str = "score") -> DataFrame:
    """The cheapest threshold under each pair of review cost and fee; the curve is run once."""
    costs = df.sparkSession.createDataFrame(grid, "review double, fee double")
    both = _running(df, score).crossJoin(F.broadcast(costs))  # the grid is a literal
    return cheapest(priced(both, score, F.col("review"), F.col("fee"), "review", "fee"), ("review", "fee"))


def capacity_threshold(df: DataFrame, rate: float, score: str = "score") -> DataFrame:
    """The lowest score above the ``1 - rate`` quantile, so that no more than ``rate`` are flagged."""
    q = exact_quantiles(df, score, [1 - rate]).select(F.col("q")[0].alias("quantile"))
    return df.crossJoin(F.broadcast(q)).filter(F.col(score) > F.col("quantile")).agg(F.min(score).alias("threshold"), F.first("quantile").alias("quantile"), F.count("*").alias("flagged"))  # one row


def recall_threshold(df: DataFrame, recall: float, score: str = "score") -> DataFrame:
    """The highest threshold that reaches the recall."""
    run = global_cumulate(df, score, {"n": F.lit(1), "tp": hits()}, descending=True)
    total = run.agg(F.sum("tp").alias("all_tp"))
    return run.crossJoin(F.broadcast(total)).filter(F.col("cum_tp") >= recall * F.col("all_tp")).agg(F.max(score).alias("threshold"))  # one row


def chosen_threshold(df: DataFrame, rate: float, model: CostModel = CostModel()) -> DataFrame:
    """The cheapest threshold, raised to what the review capacity allows, with the reason."""
    best = cheapest(cost_curve(df, model)).select(F.col("threshold").alias("cost_threshold"))
    cap = capacity_threshold(df, rate).select(F.col("threshold").alias("capacity_threshold"))
    both = best.crossJoin(cap)  # one row each
    return both.select("*", F.greatest("cost_threshold", "capacity_threshold").alias("threshold"), F.when(F.col("cost_threshold") >= F.col("capacity_threshold"), "cost").otherwise("capacity").alias("reason"))


def block_threshold(df: DataFrame, precision: float = 0.8, rows: int = 50) -> DataFrame:
    """The lowest score from which on at least ``rows`` rows are hit with the wanted precision."""
    run = global_cumulate(df, "score", {"n": F.lit(1), "tp": hits()}, descending=True)
    return run.filter((F.col("cum_n") >= rows) & (F.col("cum_tp") >= precision * F.col("cum_n"))).agg(F.min("score").alias("threshold"), F.max("cum_n").alias("flagged"))


def expected_costs(p: Column, amount: Column, model: CostModel = CostModel()) -> dict[str, Column]:
    """What blocking and allowing cost on average, where they break even, what blocking saves."""
    blocked, allowed = model.review * (1 - p), p * (amount + model.fee)
    return {"cost_blocked": blocked, "cost_allowed": allowed, "break_even": model.review / (model.review + amount + model.fee), "saving": allowed - blocked}


def decision(p: Column, review: float, block: float) -> Column:
    return F.when(p >= block, "block").when(p >= review, "review").otherwise("allow")


def risk_band(p: Column) -> Column:
    return F.when(p < 0.05, "low").when(p < 0.25, "medium").otherwise("high")


def realised_loss(flagged: Column, label: Column, amount: Column, model: CostModel = CostModel()) -> Column:
    """A review costs only where it was wrong; a miss its amount and the fee."""
    return F.when(flagged & ~label, model.review).when(~flagged & label, amount + model.fee).otherwise(0.0)


def compare_policies(df: DataFrame, policies: dict[str, Column], rate: float, model: CostModel = CostModel()) -> DataFrame:
    """Each ranking score cut at the same flag rate: cost per 1,000 and value recall."""
    long = df.select("label", "amount", F.explode(F.array(*[F.struct(F.lit(n).alias("policy"), c.cast("double").alias("rank")) for n, c in policies.items()])).alias("p")).select("label", "amount", "p.*")
    q = exact_quantiles(long, "rank", [1 - rate], ("policy",)).select("policy", F.col("q")[0].alias("q"))
    flagged = long.join(F.broadcast(q), "policy").withColumn("flag", F.col("rank") > F.col("q"))  # one row a policy
    loss = realised_loss(F.col("flag"), F.col("label"), F.col("amount"), model)
    caught = F.sum(F.when(F.col("flag") & F.col("label"), F.col("amount")).otherwise(0.0))
    return flagged.groupBy("policy").agg(F.count_if("flag").alias("flagged"), (1000 * F.sum(loss) / F.count("*")).alias("cost_per_1000"), F.try_divide(caught, F.sum(F.when(F.col("label"), F.col("amount")))).alias("value_recall"))


def extremes(df: DataFrame, threshold: float, k: int = 5) -> DataFrame:
    """The ``k`` largest false alarms and misses by amount."""
    flag = F.col("score") >= threshold
    kind = F.when(flag & ~F.col("label"), "false_positive").when(~flag & F.col("label"), "false_negative")
    w = Window.partitionBy("kind").orderBy(F.desc("amount"), "id", "line")
    return df.withColumn("kind", kind).filter(F.col("kind").isNotNull()).withColumn("nth", F.row_number().over(w)).filter(F.col("nth") <= k)


def off_policy(logged: DataFrame, clip: float = 1e-3) -> DataFrame:
    """Value of a target policy from logged decisions: direct method, weighted, doubly robust.

    ``logged``: action, target, propensity of the logged action, loss seen, ``model_target`` and
    ``model_logged`` losses predicted for the two actions. A propensity of 0 is refused by a null.
    """
    match = (F.col("action") == F.col("target")).cast("double")
    weight = match / F.greatest("propensity", F.lit(clip))
    return logged.agg(
        F.avg("model_target").alias("direct"), F.avg(weight * F.col("loss")).alias("ipw"),
        F.avg(F.col("model_target") + weight * (F.col("loss") - F.col("model_logged"))).alias("doubly_robust"),
        F.avg("loss").alias("logged"), F.min("propensity").alias("least_propensity"), F.max("propensity").alias("greatest_propensity"), F.avg(match).alias("match_rate"),
    )


def operating_points(df: DataFrame, review_rate: float, precision: float = 0.8, rows: int = 50, model: CostModel = CostModel()) -> DataFrame:
    """Where to review and where to block, one row: the block threshold is the lowest from which on ``rows`` rows or more are hit with
    the wanted precision, among those above the review threshold alone; null where there is none."""
    review = chosen_threshold(df, review_rate, model).select(F.col("threshold").alias("review_threshold"), "reason")
    above = df.crossJoin(F.broadcast(review)).filter(F.col("score") >= F.col("review_threshold"))  # one row
    block = block_threshold(above, precision, rows).select(F.col("threshold").alias("block_threshold"), F.col("flagged").alias("blocked"))
    mix = above.crossJoin(F.broadcast(block)).agg(F.count("*").alias("at_review"), F.count_if(F.col("score") >= F.col("block_threshold")).alias("at_block"))  # one row
    return review.crossJoin(block.select("block_threshold")).crossJoin(mix)  # one row each


def policy_table(df: DataFrame, policies: dict[str, Column], rates: tuple[float, ...], baseline: str, model: CostModel = CostModel()) -> DataFrame:
    """``policy, point, threshold, flagged, cost, caught``: each policy at shared flag rates, at its own cheapest point and at the baseline's.

    ``point`` is ``cap_<rate>`` (the lowest score that flags no more than the rate), ``optimum`` (the least cost, fewest flagged) or
    ``matched`` (as many rows as the baseline flags at its optimum, or the most below that, where scores tie).
    All points are read from one running count a policy.
    """
    long = df.select("label", "amount", F.explode(F.array(*[F.struct(F.lit(n).alias("policy"), c.cast("double").alias("score")) for n, c in policies.items()])).alias("p")).select("label", "amount", "p.*")
    hit = {"n": F.lit(1), "tp": hits(), "amt": F.when(F.col("label"), F.col("amount")).otherwise(0.0)}
    run = global_cumulate(long, "score", hit, descending=True, by=("policy",))
    total = run.groupBy("policy").agg(F.sum("tp").alias("all_tp"), F.sum("amt").alias("all_amt"), F.sum("n").alias("all_n"))
    nothing = total.select("policy", F.lit(float("inf")).alias("score"), *[F.lit(0).cast(t).alias(c) for c, t in run.dtypes if c not in ("policy", "score")])
    curve = priced(run.unionByName(nothing).join(F.broadcast(total), "policy"), "score", F.lit(model.review), F.lit(model.fee), "policy", "all_n")  # a row a policy
    curve = cut(curve, "policies")
    best = cheapest(curve, ("policy",)).select("policy", "flagged", F.lit("optimum").alias("point"))
    match = best.filter(F.col("policy") == baseline).select(F.col("flagged").alias("_most"))
    caps = F.explode(F.array(*[F.struct(F.lit(f"cap_{r:g}").alias("point"), F.lit(r).alias("rate")) for r in rates])).alias("c")
    limits = curve.select("policy", "all_n").distinct().select("policy", "all_n", caps).select("policy", "c.point", (F.col("c.rate") * F.col("all_n")).alias("_most"))
    limits = limits.unionByName(best.select("policy", F.lit("matched").alias("point")).crossJoin(match))  # one row
    within = curve.join(F.broadcast(limits), "policy").filter(F.col("flagged") <= F.col("_most"))  # some rows a policy
    wanted = within.groupBy("policy", "point").agg(F.max("flagged").alias("flagged")).unionByName(best.select("policy", "point", "flagged"))
    return curve.drop("all_n").join(F.broadcast(wanted), ["policy", "flagged"]).select("policy", "point", "threshold", "flagged", "cost", "caught")


def off_policy_report(logged: DataFrame, model: CostModel = CostModel(), clip: float = 1e-3, share: float = 0.01) -> DataFrame:
    """A target policy's mean cost by three estimators beside the truth, with their relative bias; one row an estimator.

    ``logged``: label, amount, ``blocked`` and ``target`` (booleans), ``propensity`` of the logged action, ``cost_blocked`` and
    ``cost_allowed`` as a model predicts them. Both outcomes of a row follow from its label and amount, so that the truth is known.
    Where more than ``share`` of the propensities are at most ``clip``, weights rest on rows that are hardly ever
    logged: ``positivity`` is false.
    """
    seen = realised_loss(F.col("blocked"), F.col("label"), F.col("amount"), model)
    truth = realised_loss(F.col("target"), F.col("label"), F.col("amount"), model)
    weight = F.when(F.col("blocked") == F.col("target"), 1 / F.greatest("propensity", F.lit(clip))).otherwise(0.0)
    of = lambda flag: F.when(F.col(flag), F.col("cost_blocked")).otherwise(F.col("cost_allowed"))
    parts = {"direct": of("target"), "weighted": weight * seen, "doubly_robust": of("target") + weight * (seen - of("blocked"))}
    one = logged.agg(F.avg(truth).alias("truth"), F.avg((F.col("propensity") <= clip).cast("int")).alias("_low"), *[F.avg(c).alias(n) for n, c in parts.items()])
    rows = one.select("truth", "_low", F.explode(F.array(*[F.struct(F.lit(n).alias("estimator"), F.col(n).alias("estimate")) for n in parts])).alias("e"))
    return rows.select("e.estimator", "e.estimate", "truth", F.try_divide(F.col("e.estimate") - F.col("truth"), F.col("truth")).alias("relative_bias"), (F.col("_low") <= share).alias("positivity"))
