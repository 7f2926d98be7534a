"""Ranking and calibration metrics over ``score, label``; only distinct scores are thresholds."""

from __future__ import annotations

from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from riskloom.functions.shared import cut

from .ordering import global_cumulate, global_rank


def hits(label: str = "label") -> Column:
    return F.col(label).cast("long")


def confusion(df: DataFrame, threshold: float, score: str = "score", by: tuple[str, ...] = ()) -> DataFrame:
    """Counts at ``score >= threshold`` with precision, recall and F1; an empty denominator gives 0."""
    flag, y = F.col(score) >= threshold, F.col("label")
    c = df.groupBy(*by).agg(F.count_if(flag & y).alias("tp"), F.count_if(flag & ~y).alias("fp"), F.count_if(~flag & y).alias("fn"), F.count_if(~flag & ~y).alias("tn"))
    p, r = (F.coalesce(F.try_divide("tp", F.col("tp") + F.col(x)), F.lit(0.0)) for x in ("fp", "fn"))
    f1 = F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0))
    return c.withColumns({"precision": p, "recall": r}).withColumn("f1", f1)


def curve(df: DataFrame, score: str = "score", by: tuple[str, ...] = (), weight: Column | None = None) -> DataFrame:
    """Running counts from the highest score down, one row for each distinct score."""
    w = F.lit(1) if weight is None else weight
    return global_cumulate(df, score, {"n": w, "tp": w * hits()}, descending=True, by=by)


def average_precision(df: DataFrame, score: str = "score", by: tuple[str, ...] = (), weight: Column | None = None) -> DataFrame:
    """Sum over distinct scores of the recall gained there times the precision there."""
    c = curve(df, score, by, weight)
    return c.groupBy(*by).agg(F.coalesce(F.try_divide(F.sum(F.col("tp") * F.try_divide("cum_tp", "cum_n")), F.sum("tp")), F.lit(0.0)).alias("average_precision"), F.try_divide(F.sum("tp"), F.sum("n")).alias("base_rate"))


def pr_points(df: DataFrame, points: int = 200) -> DataFrame:
    """Precision and recall at evenly spaced positions among the distinct scores, ends included."""
    c = curve(df)
    # a score's position among the distinct ones is itself a running count
    place = global_cumulate(c, "score", {"one": F.lit(1)}, descending=True).select("score", (F.col("cum_one") - 1).alias("position"))
    size = c.agg(F.count("*").alias("k"), F.sum("tp").alias("all_tp"))
    kept = F.explode(F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: F.floor(i * (F.col("k") - 1) / (points - 1))))).alias("position")
    wanted = size.select(kept)  # ``points`` rows
    return c.join(place, "score").join(F.broadcast(wanted), "position").crossJoin(F.broadcast(size)).select("position", "score", (F.col("cum_tp") / F.col("cum_n")).alias("precision"), (F.col("cum_tp") / F.col("all_tp")).alias("recall"))


def rank_auc(df: DataFrame, score: str = "score", by: tuple[str, ...] = ()) -> DataFrame:
    """Chance that a positive outranks a negative, ties half."""
    c = global_cumulate(df, score, {"pos": hits(), "neg": 1 - hits()}, by=by)
    wins = F.sum(F.col("pos") * (F.col("cum_neg") - F.col("neg") + F.col("neg") / 2))
    return c.groupBy(*by).agg(F.try_divide(wins, F.sum("pos") * F.sum("neg")).alias("rank_auc"))


def average_ranks(df: DataFrame, column: str, name: str) -> DataFrame:
    """``column, name``: the mean 1-based rank of each distinct value."""
    c = global_cumulate(df, column, {"n": F.lit(1)})
    return c.select(column, (F.col("cum_n") - (F.col("n") - 1) / 2).alias(name))


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    ranked = df.join(average_ranks(df, a, "_ra"), a).join(average_ranks(df, b, "_rb"), b)
    return ranked.agg(F.corr("_ra", "_rb").alias("spearman"))


def rank_normalised(df: DataFrame, score: str, by: str) -> DataFrame:
    """Average rank within a fold scaled to 0..1."""
    c = global_cumulate(df, score, {"n": F.lit(1)}, by=(by,))
    size = df.groupBy(by).agg(F.count("*").alias("_m"))
    scale = c.join(size, by).select(by, score, ((F.col("cum_n") - (F.col("n") - 1) / 2 - 1) / F.greatest(F.col("_m") - 1, F.lit(1))).alias("normalised"))
    return df.join(scale, [by, score])


def calibration(df: DataFrame, probability: str = "score", bins: int = 10) -> DataFrame:
    """Equal-width bins with mean probability and positive rate."""
    b = F.least(F.floor(F.col(probability) * bins), F.lit(bins - 1)).cast("int")
    return df.groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.avg(probability).alias("mean_p"), F.avg(hits()).alias("rate"))


def calibration_errors(df: DataFrame, probability: str = "score", bins: int = 10) -> DataFrame:
    b = calibration(df, probability, bins)
    ece = b.agg((F.sum(F.col("n") * F.abs(F.col("mean_p") - F.col("rate"))) / F.sum("n")).alias("ece"))
    return ece.crossJoin(df.agg(F.avg(F.pow(F.col(probability) - hits(), 2)).alias("brier")))  # one row each


def quantile_table(df: DataFrame, by: str, score: str, grid: tuple[float, ...] = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)) -> DataFrame:
    q = exact_quantiles(df, score, list(grid), (by,))
    return q.select(by, *[F.col("q")[i].alias(f"q{int(100 * g):02d}") for i, g in enumerate(grid)])


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) fixed by the parts' text, the same in any engine with MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[p.cast("string") for p in parts])), 1, 8), 16, 10).cast("double") / 4294967296.0




def _ranges(rows: int) -> int:
    """Ranges of scores, each a task whose work is its rows times the replicates: enough for many cores, few for few rows."""
    return max(1, min(96, rows // 20_000), rows // 2_000_000)


#: Chances of Poisson(1) up to 0, 1, ... 7.
STEPS = (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.999916758850712, 0.9999897508033253)


def poisson_weight(u: Column) -> Column:
    """Poisson(1) by inversion; the tail beyond 7 has a chance of a millionth and counts as 8."""
    return sum((u >= s).cast("long") for s in STEPS)


#: The same steps for 32-bit hashes: ``h / 2 ** 32 >= s`` is ``h >= ceil(s * 2 ** 32)``.
_LEVELS = tuple(np.uint32(ceil(s * 4294967296.0)) for s in STEPS)


def drawn_weights(key: np.ndarray, replicates: np.ndarray) -> np.ndarray:
    """Poisson(1) weights, a row a replicate, by an integer hash that any engine can repeat; 32-bit products wrap as the hash asks."""
    rows = (key.astype(np.uint64) * np.uint64(1_000_003) + np.uint64(12_345)).astype(np.uint32)
    h = (replicates.astype(np.uint64) * np.uint64(7_919)).astype(np.uint32)[:, None] + rows[None, :]
    shifted = np.empty_like(h)
    for _ in range(2):
        h ^= np.right_shift(h, 16, out=shifted)
        h *= np.uint32(73_244_475)
    h ^= np.right_shift(h, 16, out=shifted)
    w = (h >= _LEVELS[0]).view(np.uint8)
    above = np.empty(h.shape, bool)
    for level in _LEVELS[1:4]:
        w += np.greater_equal(h, level, out=above).view(np.uint8)
    # one draw in fifty is above 3, and looked up alone
    rare = np.flatnonzero(above)
    w.reshape(-1)[rare] += np.searchsorted(_LEVELS[4:], h.reshape(-1)[rare], "right").astype(np.uint8)
    return w


#: Rows of scores, all of them together, up to which weights are summed by them.
GROUPS = 65_536

#: Rows whose draws are made together, and the draws: their arrays stay in a core's cache.
_ROWS, _DRAWS, _BLOCK = 8_192, 1 << 17, 20


def bootstrap(df: DataFrame, key: list[str], replicates: int = 1000, scores: tuple[str, ...] = ("score",), rate: float | None = None, review: float = 3.0, fee: float = 15.0) -> DataFrame:
    """Stratified bootstrap of each score's average precision; all scores see the same draws.

    With a ``rate`` also cost per 1,000 and value recall, flagged above each score's ``1 - rate`` quantile. Rows draw
    Poisson weights, and each class's weights are scaled to the class's size. Scores that have few distinct rows together are
    drawn for once: a task sums its weights by them (``_grouped``). Any other score is ordered and dealt into ranges once,
    for all replicates; a range draws its rows' weights in blocks and sends one row a replicate. ``df`` needs ``amount``
    for costs only.
    """
    code = F.lit(0).cast("long")
    for k in key:
        code = code * 1_009 + F.col(k).cast("long")
    out, totals = None, None
    amount = F.col("amount").cast("double") if rate is not None else F.lit(0.0)
    held = cut(df.select(*[F.col(s).cast("double").alias(s) for s in scores], F.col("label").cast("int").alias("_y"), amount.alias("_amount"), F.pmod(code, F.lit(1 << 31)).alias("_key")), "drawn")
    size = held.agg(F.sum("_y"), F.sum(1 - F.col("_y"))).first()
    rows_ = sum(x or 0 for x in size)
    ranges = _ranges(rows_)
    together = _together(held, scores, rows_) if rate is None else []
    if together:
        out = _grouped(held, together, replicates, ranges, float(size[0] or 0), float(size[1] or 0))
    for s in [s for s in scores if s not in together]:
        least = float("inf") if rate is None else exact_quantiles(held, s, [1 - rate]).first()["q"][0]
        rows = held.select(F.col(s).alias("score"), *[F.col(f"_{c}").alias(c) for c in ("y", "amount", "key")])
        dealt = cut(rows.repartitionByRange(ranges, F.desc("score")).withColumn("p", F.spark_partition_id()), "ranged")
        # a stated number of tasks: the rows are few bytes and much work, so Spark would put many ranges into one
        every = dealt.repartition(ranges, "p").groupBy("p").applyInPandas(_class_weights(replicates), "p int, replicate int, wp double, wn double")
        before = Window.partitionBy("replicate").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
        each = cut(every, "weights")
        totals = cut(each.groupBy("replicate").agg(F.sum("wp").alias("twp"), F.sum("wn").alias("twn")), "totals") if totals is None else totals
        offset = each.select("p", "replicate", *[F.coalesce(F.sum(c).over(before), F.lit(0.0)).alias(f"o{c}") for c in ("wp", "wn")]).join(F.broadcast(totals), "replicate")  # a row a replicate
        run = _replicated(least, review, fee, float(size[0] or 0), float(size[1] or 0), rate is not None)
        part = dealt.repartition(ranges, "p").groupBy("p").cogroup(offset.repartition(ranges, "p").groupBy("p")).applyInPandas(run, "replicate int, ap double, cost double, caught double, amount double")
        summed = part.groupBy(F.col("replicate").cast("long").alias("replicate")).agg(F.sum("ap").alias(f"ap_{s}"), (1000 * F.sum("cost") / max(1.0, float(rows_))).alias(f"cost_{s}"), F.try_divide(F.sum("caught"), F.sum("amount")).alias(f"recall_{s}"))
        summed = summed if rate is not None else summed.select("replicate", f"ap_{s}")
        out = summed if out is None else out.join(summed, "replicate")
    return out


def _together(held: DataFrame, scores: tuple[str, ...], rows: int) -> list[str]:
    """The scores, those of fewest values first, whose distinct rows are at most some ``GROUPS`` and a sixteenth of all; counted roughly, as either way gives the same."""
    scores = list(dict.fromkeys(scores))
    each = held.agg(*[F.approx_count_distinct(s) for s in scores]).first()
    order = [s for _, s in sorted(zip(each, scores, strict=True))]
    joint = held.agg(*[F.approx_count_distinct(F.struct(*order[: i + 1])) for i in range(len(order))]).first()
    return [s for s, n in zip(order, joint, strict=True) if n <= min(GROUPS, rows / 16)]


def _grouped(held: DataFrame, scores: list[str], replicates: int, ranges: int, positives: float, negatives: float) -> DataFrame:
    """``replicate`` and each score's precision. Rows are dealt by their scores, equal ones over several tasks where they are many, and draw once.

    A task sends the weights of each stretch of equal scores and class, so a block of replicates meets at most ``GROUPS`` of them a class, and one more every ``_ROWS`` rows.
    """
    dealt = held.select(*scores, "_y", "_key").repartitionByRange(ranges, *scores, "_y", "_key").sortWithinPartitions(*scores, "_y")
    kinds = ", ".join(f"`{s}` double" for s in scores)
    sums = cut(dealt.mapInArrow(_stretches(scores, replicates), f"{kinds}, _y int, _block int, _w binary"), "stretches")
    blocks, ap = -(-replicates // _BLOCK), ", ".join(f"`ap_{s}` double" for s in scores)
    return sums.repartition(blocks, "_block").groupBy("_block").applyInPandas(_precisions(scores, positives, negatives), f"replicate long, {ap}")


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Where a stretch of equal rows begins; missing values are equal to none."""
    new = np.zeros(max(len(columns[0]) - 1, 0), bool)
    for c in columns:
        new |= c[1:] != c[:-1]
    return np.flatnonzero(np.concatenate([[True], new])) if len(columns[0]) else np.zeros(0, int)


def _stretches(scores: list[str], replicates: int):
    blocks = range(0, replicates, _BLOCK)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                rows = batch.slice(at, _ROWS)
                key, y, *values = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("_key", "_y", *scores))
                first = _starts(y, *values)
                sums = np.concatenate([np.add.reduceat(drawn_weights(key, b), first, axis=1, dtype=np.int64) for b in _blocks(len(key), replicates)]).astype(np.int32)
                parts = [np.ascontiguousarray(sums[b : b + _BLOCK].T) for b in blocks]
                ends = np.concatenate([[0], np.cumsum(np.repeat([p.shape[1] * 4 for p in parts], len(first)))]).astype(np.int32)
                held = pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(b"".join(p.tobytes() for p in parts))])
                again = lambda x: pa.array(np.tile(x[first], len(parts)))  # noqa: E731, B023
                yield pa.RecordBatch.from_arrays([*map(again, values), again(y), pa.array(np.repeat(np.arange(len(parts), dtype=np.int32), len(first))), held], names=[*scores, "_y", "_block", "_w"])

    return run


def _precisions(scores: list[str], positives: float, negatives: float):
    """Average precision of each score for a block of replicates, from the sums of all stretches."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        w = np.frombuffer(b"".join(rows["_w"]), np.int32).reshape(len(rows), -1).T
        hit = rows["_y"].to_numpy() == 1
        kinds = [np.where(c, w, 0) for c in (hit, ~hit)]
        tp, tn = (k.sum(1, dtype=np.int64) for k in kinds)
        by_p, by_n = (np.divide(n, t, out=np.zeros(len(t)), where=t > 0)[:, None] for n, t in ((positives, tp), (negatives, tn)))
        out = {"replicate": int(rows["_block"].iloc[0]) * _BLOCK + np.arange(len(w))}
        for s in scores:
            order = np.argsort(-rows[s].to_numpy(), kind="stable")
            first = _starts(rows[s].to_numpy()[order])
            mine, others = (np.add.reduceat(k[:, order], first, axis=1, dtype=np.int64) for k in kinds)
            up, down = np.cumsum(mine, 1) * by_p, np.cumsum(others, 1) * by_n
            precision = np.divide(up, up + down, out=np.zeros_like(up), where=up + down > 0)
            out[f"ap_{s}"] = (mine * precision).sum(1) / np.maximum(tp, 1e-300)
        return pd.DataFrame(out)

    return run


def _blocks(rows: int, replicates: int):
    """Replicates in runs whose weights stay in a core's cache."""
    step = max(1, _DRAWS // max(1, rows))
    return (np.arange(r, min(r + step, replicates)) for r in range(0, replicates, step))


def _class_weights(replicates: int):
    def total(rows: pd.DataFrame) -> pd.DataFrame:
        key, y, sums = rows["key"].to_numpy(), rows["y"].to_numpy() == 1, []
        for part in (key[y], key[~y]):
            sums.append(np.zeros(replicates, np.int64))
            for at in range(0, len(part), _ROWS):
                some = part[at : at + _ROWS]
                sums[-1] += np.concatenate([drawn_weights(some, b).sum(1, dtype=np.int64) for b in _blocks(len(some), replicates)])
        return pd.DataFrame({"p": rows["p"].iloc[0], "replicate": np.arange(replicates, dtype=np.int32), "wp": sums[0].astype(float), "wn": sums[1].astype(float)})

    return total


def _tied_sums(w: np.ndarray, group: np.ndarray, first: np.ndarray, groups: int) -> np.ndarray:
    """Weights of each replicate summed over rows of one score, ``group`` ascending; a column a score, 0 where a class has none."""
    out = np.zeros((len(w), groups))
    if w.shape[1]:
        out[:, group[first]] = np.add.reduceat(w, first, axis=1, dtype=np.int64)
    return out


def _replicated(least: float, review: float, fee: float, positives: float, negatives: float, costs: bool = True):
    """One row a replicate for a range of scores, given the weights of the ranges before it; runs through it by some rows, equal scores together."""

    def run(rows: pd.DataFrame, offset: pd.DataFrame) -> pd.DataFrame:
        rows, offset = rows.sort_values("score", ascending=False, kind="stable"), offset.sort_values("replicate")
        score, hit, amount, key = rows["score"].to_numpy(), rows["y"].to_numpy() == 1, rows["amount"].to_numpy(), rows["key"].to_numpy()
        op, on, tp, tn = offset[["owp", "own", "twp", "twn"]].to_numpy().T.copy()
        by_p, by_n = (np.divide(n, t, out=np.zeros(len(t)), where=t > 0) for n, t in ((positives, tp), (negatives, tn)))
        ap, (cost, caught, whole) = np.zeros(len(tp)), np.zeros((3, len(tp)))
        first = _starts(score)
        near = np.searchsorted(first, np.arange(0, len(score), _ROWS))
        cuts = np.unique(np.append(first[near[near < len(first)]], len(score)))
        for at, end in zip(cuts[:-1], cuts[1:], strict=True):
            h, a, k = hit[at:end], amount[at:end], key[at:end]
            begun = _starts(score[at:end])
            group, flag = np.repeat(np.arange(len(begun)), np.diff([*begun, end - at])), score[at:end] > least
            classes = [(k[c], group[c], _starts(group[c])) for c in (h, ~h)]
            # per class: what a row costs, catches and holds
            sums = [np.stack([np.where(flag[h], 0.0, a[h] + fee), a[h] * flag[h], a[h]]), np.where(flag[~h], review, 0.0)[None, :]] if costs else []
            for block in _blocks(end - at, len(tp)):
                drawn = [drawn_weights(c, block) for c, _, _ in classes]
                mine, others = (_tied_sums(w, g, f, len(begun)) for w, (_, g, f) in zip(drawn, classes, strict=True))
                if costs:
                    (lost, got, all_), (reviewed,) = (s @ w.T.astype(float) for s, w in zip(sums, drawn, strict=True))
                    cost[block] += lost * by_p[block] + reviewed * by_n[block]
                    caught[block] += got
                    whole[block] += all_
                up, down = np.cumsum(mine, 1) + op[block, None], np.cumsum(others, 1) + on[block, None]
                op[block], on[block] = up[:, -1], down[:, -1]
                up *= by_p[block, None]
                down *= by_n[block, None]
                down += up
                np.divide(up, down, out=up, where=down > 0)
                ap[block] += np.einsum("ij,ij->i", mine, up)
        return pd.DataFrame({"replicate": offset["replicate"].to_numpy().astype(np.int32), "ap": ap / np.maximum(tp, 1e-300), "cost": cost, "caught": caught, "amount": whole})

    return run


def exact_quantiles(df: DataFrame, column: str, grid: list[float], by: tuple[str, ...] = ()) -> DataFrame:
    """``*by, q``: exact quantiles with linear interpolation, nulls left out, by positions in a running count of the distinct values."""
    run = global_cumulate(df.filter(F.col(column).isNotNull()), column, {"n": F.lit(1)}, by=by)
    size = run.groupBy(*by).agg(F.sum("n").alias("_m"))
    held = run.join(F.broadcast(size), list(by)) if by else run.crossJoin(F.broadcast(size))  # a row a group
    at = lambda place: F.min(F.when(F.col("cum_n") > place, F.col(column).cast("double")))
    parts = []
    for g in grid:
        place = F.lit(g) * (F.col("_m") - 1)
        parts += [at(F.floor(place)), at(F.ceil(place)), F.first(place - F.floor(place))]
    out = held.groupBy(*by).agg(F.array(*parts).alias("_a"))
    value = lambda i: F.col("_a")[3 * i] + (F.col("_a")[3 * i + 1] - F.col("_a")[3 * i]) * F.col("_a")[3 * i + 2]
    return out.select(*by, F.array(*[value(i) for i in range(len(grid))]).alias("q"))


def interval(df: DataFrame, column: str, level: float = 0.95) -> DataFrame:
    """Percentile interval and the verdict of a difference: a tie when it holds zero."""
    lo, hi = (F.percentile(column, F.lit(q)) for q in ((1 - level) / 2, (1 + level) / 2))
    out = df.agg(lo.alias("lo"), hi.alias("hi"), F.avg(column).alias("mean"))
    return out.withColumn("verdict", F.when((F.col("lo") <= 0) & (F.col("hi") >= 0), "TIE").when(F.col("lo") > 0, "BETTER").otherwise("WORSE"))


def top_k_precision(df: DataFrame, share: float = 0.1, score: str = "score", id_: str = "id") -> DataFrame:
    """Precision among the best ``share`` against the base rate."""
    k = max(1, int(df.count() * share))
    run = global_rank(df.select((-F.col(score)).alias("score"), F.col(id_).alias("_id"), "label"), ["score", "_id"])
    top = run.filter(F.col("position") < k).agg(F.avg(hits()).alias("precision_at_k"))
    return top.crossJoin(df.agg(F.avg(hits()).alias("base_rate"))).withColumn("lift", F.try_divide("precision_at_k", "base_rate")).withColumn("k", F.lit(k))  # one row each


def last_of(df: DataFrame, by: str, order: str) -> DataFrame:
    w = Window.partitionBy(by).orderBy(F.desc(order))
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
