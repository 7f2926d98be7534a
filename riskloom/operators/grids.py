"""Configurations of the snapshot graph: all of them walked as one job, chosen on validation, measured once on test."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from riskloom.functions.shared import cut

from . import metrics, rings, tiles
from .chains import window_ends
from .edges import chain_edges, merged_edges
from .ordering import global_rank
from .rings import BY


@dataclass(frozen=True)
class Configuration:
    """What makes a graph: how many steps and how far in amount a chain reaches, and how much time a snapshot holds."""

    name: str
    steps: int
    tolerance: float
    window: int


def _dealt(df: DataFrame, grid: tuple[Configuration, ...], early: Column, late: Column, cadence: int, last: int, fits: Column | None = None) -> DataFrame:
    """Each row once for every configuration that it fits and every snapshot that holds it; the two are one key."""
    each = F.array(*[F.struct(F.lit(c.name).alias("configuration"), F.lit(c.steps).alias("steps"), F.lit(c.tolerance).alias("tolerance"), F.lit(c.window).cast("long").alias("window")) for c in grid])
    out = df.withColumn("k", F.explode(each))
    out = out if fits is None else out.filter(fits)
    out = out.withColumn("_end", F.explode(window_ends(early, late, F.col("k.window"), cadence, last)))
    return out.withColumn(BY, F.struct("k.configuration", F.col("_end").alias("end"))).drop("k", "_end")


def configured_graph(transfers: DataFrame, cash_outs: DataFrame, flows: DataFrame, grid: tuple[Configuration, ...], cadence: int, last: int, weighted: bool = True) -> DataFrame:
    """Edges of every configuration's every snapshot; ``snapshot_end`` is a struct of the two, so that all later steps run as they do for one.

    Chains are searched once, at the widest reach, and each configuration keeps those within its own. ``transfers``, ``cash_outs``:
    transaction_id, account_id, step, amount, us; ``flows``: src, dst and the times ``early_us``, ``late_us``. Where edges need not be ``weighted`` by
    their candidates, none are counted and ``chain_weight`` and ``least_candidates`` are null.
    """
    valued = lambda df: df.withColumn("value", F.col("amount"))
    pairs = chain_edges(valued(transfers), valued(cash_outs), max(c.steps for c in grid), max(c.tolerance for c in grid), ("us", "value"))
    near = (F.col("c_value") >= F.col("t_value") * (1 - F.col("k.tolerance"))) & (F.col("c_value") <= F.col("t_value") * (1 + F.col("k.tolerance")))
    held = _dealt(pairs, grid, F.least("t_us", "c_us"), F.greatest("t_us", "c_us"), cadence, last, near & (F.col("step_gap") <= F.col("k.steps")))
    number = F.count("*").over(Window.partitionBy(BY, "transfer_id")) if weighted else F.lit(None).cast("long")
    counted = held.withColumn("candidate_count", number)
    flow = _dealt(flows, grid, F.col("early_us"), F.col("late_us"), cadence, last)
    return merged_edges(flow, counted.withColumn("weight", 1 / F.col("candidate_count")), (BY,))


def configured_rings(edges: DataFrame, marked: DataFrame, grid: tuple[Configuration, ...], cadence: int, last: int) -> DataFrame:
    """A row a ring of a configuration, where it is seen first: its shape and whether a marked row of its window touches it.

    ``marked``: account_id, us. A ring that has the very members of an earlier one of the same configuration is that ring.
    """
    e = cut(edges, "configured")
    members = cut(rings.rings_with_degrees(rings.snapshot_components(e), e, unique=True), "configured")
    hit = _dealt(marked, grid, F.col("us"), F.col("us"), cadence, last).select(BY, F.col("account_id").alias("node"), F.lit(True).alias("_hit")).distinct()
    label = members.join(hit, [BY, "node"], "left").groupBy(BY, "ring").agg(F.coalesce(F.bool_or("_hit"), F.lit(False)).alias("label"))
    identity = rings.fingerprints(members).select(BY, "ring", "identity")
    return _first_seen(rings.component_features(members, e).join(label, [BY, "ring"]).join(identity, [BY, "ring"]))


def searched_rings(transfers: DataFrame, cash_outs: DataFrame, flows: DataFrame, marked: DataFrame, grid: tuple[Configuration, ...], cadence: int, last: int) -> DataFrame:
    """``configured_rings`` of the edges of ``configured_graph``, which are counted in tiles and never made."""
    held = lambda df, early="us", late="us": _dealt(df, grid, F.col(early), F.col(late), cadence, last)
    reach = {c.name: (c.steps, c.tolerance) for c in grid}
    found = tiles.members(held(flows, "early_us", "late_us"), held(transfers), held(cash_outs), lambda graph: reach[graph["configuration"]], held(marked))
    return _first_seen(cut(tiles.features(found, more=(rings.identity().alias("identity"),)).withColumnRenamed("hit", "label"), "configured"))


def _first_seen(every: DataFrame) -> DataFrame:
    first = every.groupBy(f"{BY}.configuration", "identity").agg(F.min(f"{BY}.end").alias("end"))
    flat = every.select(f"{BY}.configuration", f"{BY}.end", *[c for c in every.columns if c != BY])
    return flat.join(first, ["configuration", "identity", "end"])


def chosen_on_validation(scored: DataFrame, replicates: int = 1000) -> DataFrame:
    """One row a configuration with its validation metric; the best alone also has what it does on the test rings.

    ``scored``: configuration, end, ring, score, label, split. A configuration whose validation rings are all of one class takes
    no part. The increment is the average precision above the base rate, which is what the rule that made the rings reaches there: it
    flags all of them and ranks none. Its interval is that of the resampled rings, whose classes keep their sizes.
    """
    val = scored.filter("split = 'val'")
    counts = val.groupBy("configuration").agg(F.count("*").alias("val_rings"), F.count_if("label").alias("val_positives")).filter("val_positives > 0 AND val_positives < val_rings")
    ap = metrics.average_precision(val, by=("configuration",)).select("configuration", F.round("average_precision", 9).alias("val_metric"))
    swept = cut(counts.join(ap, "configuration"), "swept")  # a row a configuration
    best = swept.orderBy(F.desc("val_metric"), "configuration").limit(1).select("configuration")
    test = cut(scored.filter("split = 'test'").join(best, "configuration"), "swept")
    base = test.agg(F.count("*").alias("test_rings"), F.count_if("label").alias("test_positives"))
    found = metrics.average_precision(test).select(F.col("average_precision").alias("test_metric"), "base_rate").crossJoin(base)  # one row each
    drawn = metrics.bootstrap(global_rank(test, ["end", "ring"], "row"), ["row"], replicates)
    span = metrics.interval(drawn, "ap_score").select(F.col("lo").alias("_lo"), F.col("hi").alias("_hi"))
    measured = best.crossJoin(found.filter("test_rings > 0")).crossJoin(span)  # one row each
    measured = measured.withColumns({"increment": F.col("test_metric") - F.col("base_rate"), "lo": F.col("_lo") - F.col("base_rate"), "hi": F.col("_hi") - F.col("base_rate")}).drop("_lo", "_hi")
    out = swept.join(best.withColumn("chosen", F.lit(True)), "configuration", "left").withColumn("chosen", F.coalesce("chosen", F.lit(False)))
    return out.join(measured, "configuration", "left")
