from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.operators import splits
from riskloom.sources import tables

from .base import O, query, rounded

_CUT = "r AS (SELECT us, sum(count(*)) OVER (ORDER BY us) AS cum FROM o GROUP BY us), n AS (SELECT count(*) AS n FROM o), k AS (SELECT min(us) FILTER (cum > floor(n * 0.7)) AS a, min(us) FILTER (cum > floor(n * 0.85)) AS b FROM r, n), sp AS (SELECT o.*, CASE WHEN us < a THEN 'train' WHEN us < b THEN 'val' ELSE 'test' END AS split FROM o, k)"
_SUM = _CUT + ", su AS (SELECT split, count(*) AS n_rows, min(us) AS first_us, max(us) AS last_us, count(*) FILTER (is_fraud) AS positives, avg(CAST(is_fraud AS INT)) AS base_rate FROM sp GROUP BY split)"


@query(f"WITH {O}, {_CUT} SELECT transaction_id, split FROM sp")
def chrono_split(spark, sf_dir):
    return splits.assign_splits(tables.orders(spark, sf_dir)).select("transaction_id", "split")


@query(f"WITH {O}, {_SUM} SELECT split, n_rows, first_us, last_us, positives, round(base_rate, 6) AS base_rate FROM su")
def split_summary(spark, sf_dir):
    return rounded(splits.split_summary(splits.assign_splits(tables.orders(spark, sf_dir))))


@query(f"WITH {O}, {_SUM}, b AS (SELECT *, lead(first_us) OVER (ORDER BY first_us) AS nx FROM su) SELECT split, last_us, nx AS next_first_us FROM b WHERE last_us >= nx")
def boundary_check(spark, sf_dir):
    return splits.boundary_overlaps(splits.split_summary(splits.assign_splits(tables.orders(spark, sf_dir))))


@query(f"WITH {O}, {_SUM} SELECT split, n_rows, positives, round(base_rate, 6) AS base_rate, round(sum(positives) OVER () / sum(n_rows) OVER (), 6) AS overall_rate, (base_rate > 1.5 * sum(positives) OVER () / sum(n_rows) OVER ()) OR (base_rate * 1.5 < sum(positives) OVER () / sum(n_rows) OVER ()) AS drifts FROM su")
def class_drift(spark, sf_dir):
    return rounded(splits.class_drift(splits.split_summary(splits.assign_splits(tables.orders(spark, sf_dir)))).select("split", "n_rows", "positives", "base_rate", "overall_rate", "drifts"))


_BLOCK = "r AS (SELECT us, sum(count(*)) OVER (ORDER BY us) AS cum FROM o GROUP BY us), n AS (SELECT count(*) AS n FROM o), k AS (SELECT min(us) FILTER (cum > floor(n * 0.2)) AS a, min(us) FILTER (cum > floor(n * 0.4)) AS b, min(us) FILTER (cum > floor(n * 0.6)) AS c, min(us) FILTER (cum > floor(n * 0.8)) AS d FROM r, n), bl AS (SELECT o.*, CAST(us >= a AS INT) + CAST(us >= b AS INT) + CAST(us >= c AS INT) + CAST(us >= d AS INT) AS block FROM o, k)"


@query(f"WITH {O}, {_BLOCK} SELECT transaction_id, block FROM bl")
def time_blocks(spark, sf_dir):
    return splits.time_blocks(tables.orders(spark, sf_dir), 5).select("transaction_id", "block")


@query(f"WITH {O}, {_BLOCK}, e AS (SELECT block, min(us) AS begins, max(us) AS ends FROM bl GROUP BY block), f AS (SELECT block, max(ends) OVER (ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS train_ends, begins FROM e) SELECT block, train_ends, begins, train_ends < begins AS sound FROM f WHERE block > 0")
def fold_check(spark, sf_dir):
    return splits.fold_check(splits.time_blocks(tables.orders(spark, sf_dir), 5))


@query(f"WITH {O}, p AS (SELECT *, row_number() OVER (ORDER BY us, transaction_id) - 1 AS position, count(*) OVER () AS n FROM o) SELECT transaction_id, position, CASE WHEN position < floor(n * 0.4) THEN 'early' WHEN position < floor(n * 0.75) THEN 'middle' ELSE 'late' END AS slice FROM p")
def validation_slices(spark, sf_dir):
    return splits.validation_slices(tables.orders(spark, sf_dir), ["us", "transaction_id"]).select("transaction_id", F.col("position").cast("long").alias("position"), "slice")


@query(f"WITH {O}, p AS (SELECT *, row_number() OVER (ORDER BY us, transaction_id) - 1 AS position FROM o) SELECT transaction_id, account_id FROM p WHERE position % 7 = 0")
def strided_sample(spark, sf_dir):
    return splits.global_rank(tables.orders(spark, sf_dir), ["us", "transaction_id"]).filter("position % 7 = 0").select("transaction_id", "account_id")


@query(f"WITH {O}, {_CUT}, p AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY us, transaction_id) AS n FROM sp) SELECT split, transaction_id, us FROM p WHERE n <= 100")
def split_heads(spark, sf_dir):
    """The hundred earliest orders of each split."""
    return splits.heads(splits.assign_splits(tables.orders(spark, sf_dir)), 100).select("split", "transaction_id", "us")


@query(f"WITH {O}, p AS (SELECT *, row_number() OVER (ORDER BY us, transaction_id) - 1 AS position, count(*) OVER () AS n FROM o), sl AS (SELECT *, CASE WHEN position < floor(n * 0.4) THEN 'early' WHEN position < floor(n * 0.75) THEN 'middle' ELSE 'late' END AS slice FROM p) SELECT slice, count(*) AS n_rows, min(us) AS first_us, max(us) AS last_us, count(*) FILTER (is_fraud) AS positives, round(avg(CAST(is_fraud AS INT)), 6) AS base_rate FROM sl GROUP BY 1")
def slice_summary(spark, sf_dir):
    """What each slice holds; slices without a positive are refused."""
    sliced = splits.with_positives(splits.validation_slices(tables.orders(spark, sf_dir), ["us", "transaction_id"]))
    return rounded(splits.split_summary(sliced, "slice"))
