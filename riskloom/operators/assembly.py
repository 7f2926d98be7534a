"""Model inputs: specs fitted on training rows, checked joins, signal assembly, guards, comparisons."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from riskloom.functions.shared import cut

from . import metrics
from .checks import column_classes
from .encoders import apply_frequencies, fit_frequencies, level_codes
from .metrics import average_precision, interval, rank_auc, spearman
from .ordering import global_cumulate


@dataclass(frozen=True)
class InputSpec:
    """What a scorer reads; everything in it was learned from training rows."""

    numeric: list[str]
    levels: dict[str, list[str]]
    frequency: list[str]
    encoders: DataFrame


def fit_spec(train: DataFrame, columns: list[str], denied: tuple[str, ...] = (), native_levels: int = 64) -> InputSpec:
    guard(columns, denied)
    kinds = {r["column"]: r["kind"] for r in column_classes(train, columns, native_levels).collect()}  # a row a column
    native = [c for c in columns if kinds[c] == "native"]
    sets = train.agg(*[F.sort_array(F.collect_set(c)).alias(c) for c in native]).first() if native else {}  # at most ``native_levels`` each
    frequency = [c for c in columns if kinds[c] == "frequency"]
    return InputSpec([c for c in columns if kinds[c] == "numeric"], {c: list(sets[c]) for c in native}, frequency, fit_frequencies(train, frequency) if frequency else train.sparkSession.createDataFrame([], "column string, category string, freq double"))


def apply_spec(df: DataFrame, spec: InputSpec, numeric_only: bool = False, without: tuple[str, ...] = ()) -> DataFrame:
    """Numbers as they are, native levels as codes, the rest as frequencies; unseen levels are -1 or 0."""
    if not numeric_only:
        for c, levels in spec.levels.items():
            df = level_codes(df, c, levels)
        df = apply_frequencies(df, spec.encoders, spec.frequency)
    return df.drop(*without)


def guard(columns: list[str], denied: tuple[str, ...]) -> None:
    """Leaked or decision columns must never be inputs, under any graph prefix either."""
    found = [c for c in columns if c in denied or c.removeprefix("ring_") in denied]
    if found:
        raise ValueError(f"denied inputs: {found}")


def with_match(left: DataFrame, right: DataFrame, key: str, flag: str) -> DataFrame:
    """Left join that says whether there was a match."""
    return left.join(right.withColumn(flag, F.lit(True)), key, "left").withColumn(flag, F.coalesce(flag, F.lit(False)))


def checked_join(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left join refused when the right side repeats a key."""
    twice = right.groupBy(*keys).count().filter("count > 1").limit(1).count()
    if twice:
        raise ValueError(f"{keys} repeat on the right side")
    return left.join(right, keys, "left")


def assembled_signals(base: DataFrame, blocks: dict[str, DataFrame], key: str) -> DataFrame:
    """Blocks joined one by one; an absent value is -1 beside an indicator, never a plausible score."""
    out = base
    for name, block in blocks.items():
        columns = [c for c in block.columns if c != key]
        out = checked_join(out, block.withColumn(f"{name}_here", F.lit(1)), [key])
        out = out.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(-1.0)) for c in columns}).withColumn(f"{name}_here", F.coalesce(f"{name}_here", F.lit(0)))
    return out


def membership_share(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Share of the rows of ``a`` whose key occurs in ``b``."""
    known = b.select(key).distinct()
    n = a.agg(F.count("*").alias("n"))
    hit = a.join(known, key, "left_semi").agg(F.count("*").alias("hit"))
    return n.crossJoin(hit).withColumn("share", F.try_divide("hit", "n"))  # one row each


def abstention(df: DataFrame, score: str = "score", by: tuple[str, ...] = ()) -> DataFrame:
    """How often there is no score, and which unit that calls for."""
    rate = F.avg(F.col(score).isNull().cast("int"))
    return df.groupBy(*by).agg(rate.alias("abstention"), F.when(rate >= 0.99, "ring").otherwise("row").alias("unit"))


def missed_profile(df: DataFrame, threshold: float) -> DataFrame:
    """Positives by what became of them: caught, below the threshold, or without a score."""
    kind = F.when(F.col("score").isNull(), "abstained").when(F.col("score") < threshold, "below").otherwise("caught")
    return df.filter("label").groupBy(kind.alias("fate")).agg(F.count("*").alias("n"), F.percentile("amount", F.lit(0.5)).alias("median_amount"), F.sum("amount").alias("amount"))


def ablation(fit: DataFrame, arbiter: DataFrame, blocks: dict[str, list[str]], base: tuple[str, ...], fitted, key: str, replicates: int = 1000) -> DataFrame:
    """``block, kind, delta, lo, hi, mean, rows, positives, retained``: what each block of columns is worth, both ways.

    ``fitted(rows, columns)`` gives a function that adds a model's score to rows under a name. Models learn from ``fit`` and
    are compared on ``arbiter``, all with the same draws. ``leave_one_out`` is the full model against it without the
    block, ``add_one`` the base with the block against the base: of two blocks that say the same, the first sees neither and the second both. A block stays
    if an interval of either lies above zero; those of the base always do.
    """
    subset = lambda *names: tuple(sorted(names))
    full, least = subset(*blocks), subset(*base)
    pairs = {(b, "leave_one_out"): (full, subset(*(x for x in blocks if x != b))) for b in blocks if len(blocks) > 1}
    pairs |= {(b, "add_one"): (subset(*base, b), least) for b in blocks if base and b not in base}
    names, scored = {}, arbiter
    for s in dict.fromkeys(s for pair in pairs.values() for s in pair):
        names[s] = f"variant_{len(names)}"
        scored = fitted(fit, [c for b in blocks if b in s for c in blocks[b]])(scored, names[s])
    scored = cut(scored.select(key, "label", *names.values()), "variants")
    whole = {s: average_precision(scored, n).first()[0] for s, n in names.items()}  # one number a variant
    size = scored.agg(F.count("*"), F.count_if("label")).first()
    draws = cut(metrics.bootstrap(scored, [key], replicates, tuple(names.values())), "draws")
    out = None
    for (block, kind), (more, less) in pairs.items():
        row = interval(draws.withColumn("delta", F.col(f"ap_{names[more]}") - F.col(f"ap_{names[less]}")), "delta")
        row = row.select(F.lit(block).alias("block"), F.lit(kind).alias("kind"), F.lit(whole[more] - whole[less]).alias("delta"), "lo", "hi", "mean", F.lit(size[0]).alias("rows"), F.lit(size[1]).alias("positives"))
        out = row if out is None else out.unionByName(row)
    kept = out.groupBy("block").agg((F.max("lo") > 0).alias("_kept"))
    return out.join(kept, "block").select(*out.columns, (F.col("_kept") | F.col("block").isin(*base)).alias("retained"))


def residual_lift(df: DataFrame, first: str, second: str, threshold: float) -> DataFrame:
    """What the second score is worth among the rows that the first does not flag."""
    return average_precision(df.filter(F.col(first) < threshold), second)


def residual_report(df: DataFrame, first: str, second: str, threshold: float) -> DataFrame:
    """``residual_lift`` beside how far both scores rank those rows, and all rows, alike; one row."""
    below = df.filter(F.col(first) < threshold)
    return residual_lift(df, first, second, threshold).crossJoin(spearman(below, first, second).select(F.col("spearman").alias("rank_correlation"))).crossJoin(spearman(df, first, second).select(F.col("spearman").alias("overall_correlation")))


def winner_report(chosen_on: DataFrame, measured_on: DataFrame, scores: list[str], baseline: str, key: str, replicates: int = 1000) -> DataFrame:
    """The score with the best average precision on ``chosen_on``, against the next one and the baseline on ``measured_on``.

    A row a rival: both metrics there, the paired interval of their difference, and a verdict, ``not significant`` where it holds zero. The
    measured rows choose nothing. Ties go to the smaller name; a baseline that comes second is reported once as each.
    """
    names = sorted(set(scores) | {baseline})
    validation = {s: average_precision(chosen_on, s).first()[0] for s in names}  # one number a score
    first, second = sorted(names, key=lambda s: (-validation[s], s))[:2]
    rivals = [("runner_up", second)] + ([("baseline", baseline)] if baseline != first else [])
    held = {s: average_precision(measured_on, s).first()[0] for s in {first, *(r for _, r in rivals)}}
    draws = cut(metrics.bootstrap(measured_on, [key], replicates, tuple(sorted(held))), "draws")
    out = None
    for role, rival in rivals:
        row = interval(draws.withColumn("delta", F.col(f"ap_{first}") - F.col(f"ap_{rival}")), "delta")
        verdict = F.when(F.col("lo") > 0, "significant").when(F.col("hi") < 0, "worse").otherwise("not significant")
        row = row.select(F.lit(role).alias("role"), F.lit(first).alias("winner"), F.lit(rival).alias("rival"), F.lit(validation[first]).alias("chosen_metric"), F.lit(held[first]).alias("metric"), F.lit(held[rival]).alias("rival_metric"), "lo", "hi", verdict.alias("verdict"))
        out = row if out is None else out.unionByName(row)
    return out


def memorisation(df: DataFrame, eligible: Column) -> DataFrame:
    """Rank-AUC over all rows, and over rows in and out of the eligible group."""
    group = F.explode(F.array(F.lit("all"), F.when(eligible, "eligible").otherwise("other")))
    return rank_auc(df.withColumn("group", group), by=("group",))


def ecdf_knots(df: DataFrame, column: str, knots: int = 4096) -> DataFrame:
    """``i, knot``: the quantile grid of the training scores, linear between neighbours, from one running count of the distinct values.

    Knot ``i`` of ``knots`` lies at place ``i (m - 1) / (knots - 1)`` of ``m`` sorted scores. A value knows the places it fills, so
    it names the knots that need it; all in whole numbers.
    """
    step = knots - 1
    run = global_cumulate(df.filter(F.col(column).isNotNull()), column, {"n": F.lit(1)})
    run = run.crossJoin(F.broadcast(run.agg(F.sum("n").alias("m"))))  # one row
    run = run.select(F.col(column).cast("double").alias("v"), (F.col("cum_n") - F.col("n")).alias("a"), (F.col("cum_n") - 1).alias("b"), (F.col("m") - 1).alias("w"))
    up = lambda x: F.when(F.col("w") == 0, 0).otherwise(-F.floor(-x * step / F.greatest("w", F.lit(1)))).cast("long")
    down = lambda x: F.when(F.col("w") == 0, step).otherwise(F.floor(x * step / F.greatest("w", F.lit(1)))).cast("long")
    a, b = F.col("a"), F.col("b")
    last = F.when(F.col("w") == 0, step).otherwise(F.least(up(b + 1) - 1, F.lit(step)))
    first = F.when((F.col("w") == 0) | (a == 0), 0).otherwise(down(a - 1) + 1)
    spans = {"low": (up(a), last), "high": (first, down(b))}
    ends = [run.filter(z >= y).select("w", F.lit(name).alias("end"), "v", F.explode(F.sequence(y.cast("long"), z.cast("long"))).alias("i")) for name, (y, z) in spans.items()]
    both = ends[0].unionByName(ends[1]).groupBy("i").agg(F.min("w").alias("w"), *[F.max(F.when(F.col("end") == e, F.col("v"))).alias(e) for e in spans])
    return both.select(F.col("i").cast("int").alias("i"), (F.col("low") + (F.col("high") - F.col("low")) * F.pmod(F.col("i") * F.col("w"), F.lit(step)) / step).alias("knot"))


def ecdf(df: DataFrame, column: str, knots: DataFrame, name: str = "share", buckets: int = 4096) -> DataFrame:
    """``df`` with the share of training scores below ``column``, linear between knots; 0 and 1 outside. Equal knots give their middle.

    A range lookup: the stretches between neighbouring knots are laid into equal buckets of the knots' range, and a score meets
    those of its bucket. Stretches are at most as many as knots, and buckets a parameter, so that side is broadcast.
    """
    held = cut(knots.groupBy("knot").agg(F.min("i").alias("_f"), F.max("i").alias("_l")), "knots")
    order = Window.partitionBy(F.lit(0)).orderBy("knot")  # a row a knot
    ends = held.agg(F.min("knot").alias("_lo"), F.max("knot").alias("_hi"), F.max("_l").alias("_n"))  # one row
    at = lambda x: F.least(F.floor((x - F.col("_lo")) / F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0)) * buckets), F.lit(buckets - 1))
    parts = held.select(F.col("knot").alias("_from"), F.lead("knot").over(order).alias("_to"), "_f", "_l").filter("_to IS NOT NULL").crossJoin(F.broadcast(ends.select("_lo", "_hi")))
    parts = parts.select("_from", "_to", "_f", "_l", F.explode(F.sequence(at(F.col("_from")), at(F.col("_to")))).alias("_bucket"))
    x = F.col(column)
    inside = df.crossJoin(F.broadcast(ends)).withColumn("_at", F.when((x >= F.col("_lo")) & (x < F.col("_hi")), at(x)))
    met = inside.join(F.broadcast(parts), (F.col("_at") == F.col("_bucket")) & (x >= F.col("_from")) & (x < F.col("_to")), "left")
    between = F.col("_l") + (x - F.col("_from")) / (F.col("_to") - F.col("_from"))
    place = F.when(x == F.col("_from"), (F.col("_f") + F.col("_l")) / 2).otherwise(between) / F.col("_n")
    share = F.when(x >= F.col("_hi"), 1.0).when(x < F.col("_lo"), 0.0).otherwise(F.when(x == F.col("_lo"), 0.0).otherwise(place))
    return met.withColumn(name, share).drop("_lo", "_hi", "_n", "_at", "_from", "_to", "_f", "_l", "_bucket")


def selected(configs: DataFrame) -> DataFrame:
    """The configuration with the best validation metric; ties to the smaller name."""
    return configs.groupBy().agg(F.min(F.struct((-F.col("metric")).alias("m"), "config")).alias("b")).select("b.config", (-F.col("b.m")).alias("metric"))


def available_blocks(columns: list[str], blocks: dict[str, list[str]]) -> list[str]:
    """The blocks that are there whole, in the order of ``blocks``: one with a column missing is not there."""
    return [name for name, wanted in blocks.items() if set(wanted) <= set(columns)]


def block_columns(df: DataFrame, blocks: dict[str, list[str]], chosen: list[str], denied: tuple[str, ...] = ()) -> list[str]:
    """The columns of the chosen blocks, in the order of ``blocks`` however they were asked for; unknown, incomplete or denied ones are refused."""
    unknown, out = sorted(set(chosen) - set(blocks)), [c for name, columns in blocks.items() if name in chosen for c in columns]
    absent, leaked = [c for c in out if c not in df.columns], [c for c in out if c in denied]
    if unknown or absent or leaked:
        raise ValueError(f"unknown blocks {unknown}, absent columns {absent}, denied columns {leaked}")
    return out
