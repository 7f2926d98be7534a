"""Snapshot graphs of flows and chained transfers, and the rings, accounts and entities in them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import tiles
from .edges import merged_edges, with_candidates
from .rings import BY, overlaps


def window_ends(early: Column, late: Column, window: int, cadence: int, last: int) -> Column:
    """The snapshot ends whose ``[end - window, end)`` holds both times; null if none does."""
    first_end = (F.floor(late / cadence) + 1) * cadence
    last_end = F.least(F.floor((early + window) / cadence) * cadence, F.lit(last))
    return F.when(last_end >= first_end, F.sequence(first_end, last_end, F.lit(cadence).cast("long")))


def snapshot_graph(flows: DataFrame, pairs: DataFrame, window: int, cadence: int, last: int) -> DataFrame:
    """Flow and chain edges of every snapshot, each made of rows before its end alone.

    ``flows``: src, dst and the times ``early_us``, ``late_us`` between which it came about; ``pairs``: chain
    edges with both times. A transfer's candidates are counted anew in each snapshot.
    """
    flow = flows.withColumn(BY, F.explode(window_ends(F.col("early_us"), F.col("late_us"), window, cadence, last)))
    held = pairs.withColumn(BY, F.explode(window_ends(F.least("t_us", "c_us"), F.greatest("t_us", "c_us"), window, cadence, last)))
    counted = held.withColumn("candidate_count", F.count("*").over(Window.partitionBy(BY, "transfer_id")))
    return merged_edges(flow, counted.withColumn("weight", 1 / F.col("candidate_count")), (BY,))


def dealt_graph(flows: DataFrame, transfers: DataFrame, cash_outs: DataFrame, steps: int, tolerance: float, window: int, cadence: int, last: int) -> DataFrame:
    """``snapshot_graph`` from the rows themselves.

    ``flows``: as there; ``transfers``, ``cash_outs``: as
    for ``chain_edges``, with ``us``. Both are dealt to the snapshots that hold them before they meet, so that a
    transfer's candidates are counted in each snapshot and pairs meet in tiles, without a shuffle of pairs.
    """
    flow, t, c = _held(flows, transfers, cash_outs, window, cadence, last)
    return tiles.edges(flow, with_candidates(t, c, steps, tolerance, (BY,)), c, lambda _: (steps, tolerance))


def dealt_members(flows: DataFrame, transfers: DataFrame, cash_outs: DataFrame, steps: int, tolerance: float, window: int, cadence: int, last: int, weighted: bool = True) -> DataFrame:
    """``tiles.members`` of the graphs of ``dealt_graph``; candidates are counted if it is ``weighted``."""
    flow, t, c = _held(flows, transfers, cash_outs, window, cadence, last)
    t = with_candidates(t, c, steps, tolerance, (BY,)) if weighted else t
    return tiles.members(flow, t, c, lambda _: (steps, tolerance))


def _held(flows: DataFrame, transfers: DataFrame, cash_outs: DataFrame, window: int, cadence: int, last: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    at = lambda df, early, late: df.withColumn(BY, F.explode(window_ends(F.col(early), F.col(late), window, cadence, last)))
    return at(flows, "early_us", "late_us"), at(transfers, "us", "us"), at(cash_outs, "us", "us")


def member_features(members: DataFrame) -> DataFrame:
    """``account_features`` of rings that are whole components, from the degrees that ``members`` have."""
    size = members.groupBy(BY, "ring").agg(F.count("*").alias("size"))
    return members.join(size, [BY, "ring"]).withColumn("centrality", F.coalesce(F.try_divide("degree", F.col("size") - 1), F.lit(0.0)))


def account_features(members: DataFrame, edges: DataFrame) -> DataFrame:
    """Degree, centrality and chain degree of each account inside its ring."""
    inside = edges.join(members.select(BY, F.col("node").alias("u"), "ring"), [BY, "u"]).join(members.select(BY, F.col("node").alias("v"), F.col("ring").alias("_rv")), [BY, "v"]).filter("ring = _rv")
    ends = inside.select(BY, "ring", F.explode(F.array("u", "v")).alias("node"), "has_chain")
    degree = ends.groupBy(BY, "ring", "node").agg(F.count("*").alias("degree"), F.count_if("has_chain").alias("chain_degree"))
    size = members.groupBy(BY, "ring").agg(F.count("*").alias("size"))
    out = members.join(degree, [BY, "ring", "node"], "left").join(size, [BY, "ring"])
    return out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("degree", "chain_degree")}).withColumn("centrality", F.coalesce(F.try_divide("degree", F.col("size") - 1), F.lit(0.0)))


def entity_features(members: DataFrame, entities: DataFrame) -> DataFrame:
    """Rings of accounts that share entities: sizes of both sides, kinds, mean rarity, share of the possible links.

    ``members``: account_id, ring; ``entities``: account_id, spec, entity, idf.
    """
    of = entities.join(members.select("account_id", "ring"), "account_id")
    out = of.groupBy("ring").agg(F.count_distinct("account_id").alias("accounts"), F.count_distinct(F.struct("spec", "entity")).alias("entities"), F.count_distinct("spec").alias("specs"), F.avg("idf").alias("mean_idf"), F.count("*").alias("links"))
    return out.withColumn("fill_rate", F.col("links") / (F.col("accounts") * F.col("entities")))


def recovery_grid(detected: DataFrame, truth: DataFrame, thresholds: tuple[float, ...] = (0.3, 0.5, 0.7)) -> DataFrame:
    """Per snapshot and overlap threshold: precision, recall and F1 of the rings, and the best F1 of the snapshot.

    Snapshots that only one side has are there as well, with zeros.
    """
    grid = F.explode(F.array(*[F.lit(t) for t in thresholds])).alias("threshold")
    sizes = lambda x, name: x.select(BY, "ring").distinct().groupBy(BY).agg(F.count("*").alias(name))
    o = overlaps(detected, truth).select(BY, "a", "b", "overlap", grid).filter(F.col("overlap") >= F.col("threshold"))
    hit = o.groupBy(BY, "threshold").agg(F.count_distinct("a").alias("detected_hit"), F.count_distinct("b").alias("truth_hit"))
    every = sizes(detected, "detected").join(sizes(truth, "truth"), BY, "full").select("*", grid).join(hit, [BY, "threshold"], "left")
    out = every.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("detected", "truth", "detected_hit", "truth_hit")})
    share = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    out = out.withColumns({"precision": share("detected_hit", "detected"), "recall": share("truth_hit", "truth")})
    out = out.withColumn("f1", share(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    return out.withColumn("best_f1", F.max("f1").over(Window.partitionBy(BY)))  # a row a threshold


def page_edges(page: DataFrame, edges: DataFrame) -> DataFrame:
    """The edges between the accounts that a page of rings shows."""
    shown = page.select(BY, "ring", F.explode("accounts").alias("node"))
    of = lambda end: shown.select(BY, F.col("node").alias(end), F.col("ring").alias(f"_{end}"))
    return edges.join(of("u"), [BY, "u"]).join(of("v"), [BY, "v"]).filter("_u = _v").select(BY, F.col("_u").alias("ring"), "u", "v", "flow_count")
