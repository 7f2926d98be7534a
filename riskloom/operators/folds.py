"""Forward-chaining folds: each fits its own input spec and model on earlier blocks, and shows what it lacks."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.functions.shared import cut

from .assembly import InputSpec, apply_spec, ecdf, ecdf_knots, fit_spec
from .metrics import average_precision, rank_normalised
from .splits import fold_check, time_blocks

#: ``fitted(rows, features)`` gives a function that adds a model's score to rows under a name.
Fitted = Callable[[DataFrame, list[str]], Callable[[DataFrame, str], DataFrame]]


@dataclass(frozen=True)
class Folds:
    """``scores``: key, label, block, raw, normalised (null in block 0). ``validation``: key, label, raw, mapped.

    ``handicap``: a row a fold with its fit rows and positives and what its model and the full one reach on validation.
    ``specs``: what each fold reads; the full model's is under the number of blocks.
    """

    scores: DataFrame
    validation: DataFrame | None
    handicap: DataFrame | None
    specs: dict[int, InputSpec]


def spec_inputs(spec: InputSpec) -> list[str]:
    return [*spec.numeric, *[f"{c}_code" for c in spec.levels], *[f"{c}_freq" for c in spec.frequency]]


def forward_chained(train: DataFrame, validation: DataFrame, columns: list[str], fitted: Fitted, blocks: int, key: str, denied: tuple[str, ...] = (), native_levels: int = 64, scores_only: bool = False) -> Folds:
    """Every block of ``train`` but the first scored by a model of all blocks before it; rows need ``us`` and ``label``.

    Levels and frequencies are learned anew for each fold, so that no block's own ones reach its scores. Raw scores of
    folds differ in level, as later ones know more; they are ranked within their block. The full model's scores go through
    the distribution of its training scores, to the same scale. ``validation`` is fitted by nobody. The loop runs
    once a block, each over all rows before it. Who asks for ``scores_only`` gets neither ``validation`` nor ``handicap``, and no full model is fitted.
    """
    blocked, validation = cut(time_blocks(train, blocks), "blocks"), None if scores_only else cut(validation, "held")
    if not fold_check(blocked).filter("NOT sound").isEmpty():
        raise ValueError("a block begins before the ones it is learned from end")
    specs, parts, notes = {}, [], []
    for k in range(1, blocks if scores_only else blocks + 1):
        before = blocked.filter(F.col("block") < k)
        spec = fit_spec(before, columns, denied, native_levels)
        specs[k] = replace(spec, encoders=cut(spec.encoders, "encoders"))
        score = fitted(cut(apply_spec(before, specs[k]), "fit"), spec_inputs(specs[k]))
        of = lambda rows, *more, spec=specs[k], score=score: score(apply_spec(rows, spec), "raw").select(key, "label", *more, "raw")
        if not scores_only:
            unseen = cut(of(validation), "validation")
            notes.append((k, *before.agg(F.count("*"), F.count_if("label")).first(), average_precision(unseen, "raw").first()[0]))
        if k < blocks:
            parts.append(cut(of(blocked.filter(F.col("block") == k), "block"), "fold"))
    scored = parts[0]
    for p in parts[1:]:
        scored = scored.unionByName(p)
    first = blocked.filter("block = 0").select(key, "label", "block", F.lit(None).cast("double").alias("raw"), F.lit(None).cast("double").alias("normalised"))
    scores = rank_normalised(scored, "raw", "block").select(*first.columns).unionByName(first)
    if scores_only:
        return Folds(scores, None, None, specs)
    mapped = ecdf(unseen, "raw", ecdf_knots(of(blocked), "raw"), "mapped")
    full = notes.pop()[3]
    table = train.sparkSession.createDataFrame([(*n, full, full - n[3]) for n in notes], "fold int, fit_rows long, fit_positives long, fold_precision double, full_precision double, handicap double")
    return Folds(scores, mapped, table, specs)
