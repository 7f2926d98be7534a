"""Structured Streaming jobs: keyed history, scores and prices, decisions and their feed, duplicate suppression, rolling edges."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from riskloom.functions.shared import shared_dir
from riskloom.operators.costs import CostModel, decision, expected_costs
from riskloom.sources.scorers import Scorer

DAY_US = 86_400_000_000


def replayed(stream: DataFrame, sink: Callable[[DataFrame, int], None] | None = None, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there, into a table of the shared folder, and read it back."""
    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True)
    writer = writer.foreachBatch(sink or (lambda df, batch: df.write.mode("overwrite").parquet(f"{base}/out/batch={batch}")))
    q = writer.start()
    q.awaitTermination()
    if q.exception():
        raise q.exception()
    return spark.read.schema(stream.schema).parquet(f"{base}/out/*") if sink is None else spark.createDataFrame([], stream.schema)


def source(spark: SparkSession, path: str, files: int | None = None) -> DataFrame:
    """A table's files as a stream, with the table's own schema.

    The path is given as a pattern of itself: a stream takes a folder or a pattern, and a table may be one file.
    """
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    pattern = f"{path[:-1]}[{path[-1]}]"
    return (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(pattern)


def keyed_history(stream: DataFrame, delay_us: int = DAY_US, carry: tuple[str, ...] = ()) -> DataFrame:
    """Per event: how many came before, how long ago the last one was, how many in 24 hours.

    State of an account: a counter without bound, as in training, and its distinct times of the last 24 hours
    and ``delay_us``, each with its number of events, so that no count is short however busy an account is. A
    micro-batch's rows of an account are taken in time order, those of one instant see each other. An event that
    comes after younger ones counts what came before it in time; one later than ``delay_us`` may miss
    forgotten events (see ``late_rows``), and with none left it has no gap. Columns named in ``carry`` come along.
    """
    kinds, read = dict(stream.dtypes), list(dict.fromkeys(["transaction_id", "us", *carry]))
    out = ", ".join(["transaction_id long, account_id long, prior_count long, seconds_since_prior double, count_24h long", *[f"`{c}` {kinds[c]}" for c in carry]])

    def update(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        n, times, numbers = state.get if state.exists else (0, [], [])
        held = list(batches)
        rows = held[0] if len(held) == 1 else pd.concat(held)
        rows = {c: rows[c].to_numpy() for c in read}
        order = np.lexsort((rows["transaction_id"], rows["us"]))
        rows = {c: x[order] for c, x in rows.items()}
        us, known = rows["us"].astype(np.int64), np.array(times, np.int64)
        every, place = np.unique(np.concatenate([known, us]), return_inverse=True)
        held = np.zeros(len(every), np.int64)
        np.add.at(held, place, np.concatenate([np.array(numbers, np.int64), np.ones(len(us), np.int64)]))
        up_to = np.concatenate([[0], np.cumsum(held)])
        count = up_to[np.searchsorted(every, us, "right")] - up_to[np.searchsorted(every, us - DAY_US, "right")]
        never = np.iinfo(np.int64).min
        before = np.concatenate([[never], known])[np.searchsorted(known, us, "right")]
        last = np.maximum(before, np.concatenate([[never], us[:-1]]))
        gap = np.where(last == never, np.nan, (us - np.where(last == never, us, last)) / 1e6)  # Arrow takes it as null
        kept = every > every[-1] - DAY_US - delay_us
        state.update((n + len(us), every[kept].tolist(), held[kept].tolist()))
        yield pd.DataFrame({"transaction_id": rows["transaction_id"], "account_id": key[0], "prior_count": n + np.arange(len(us)), "seconds_since_prior": gap, "count_24h": count, **{c: rows[c] for c in carry}}, copy=False)

    # every column is made into pandas once an account, read or not
    return stream.select(*dict.fromkeys(["account_id", *read])).groupBy("account_id").applyInPandasWithState(update, out, "n long, times array<long>, numbers array<long>", "append", GroupStateTimeout.NoTimeout)


def scored(history: DataFrame, scorer: Scorer, review: float, block: float, costs: CostModel = CostModel()) -> DataFrame:
    """Rows of ``keyed_history`` with the stored model's probability, what blocking and allowing would cost, and the decision.

    A stream and a table alike: nothing here looks beyond its row, so that both give the same scores. A row whose amount is null is
    ``degraded``: it has neither score nor price and is reviewed.
    """
    p = F.when(F.col("amount").isNotNull(), F.col("score"))
    priced = expected_costs(p, F.col("amount"), costs)
    out = scorer.apply(stream_features(history)).withColumns({"cost_blocked": priced["cost_blocked"], "cost_allowed": priced["cost_allowed"], "degraded": F.col("amount").isNull()})
    return out.withColumn("decision", F.when(F.col("degraded"), "review").otherwise(decision(F.col("score"), review, block))).withColumn("score", p)


STREAM_FEATURES = ["amount_log", "gap_log", "prior_log", "count_24h_log", "has_prior"]


def stream_features(history: DataFrame) -> DataFrame:
    """What the scorer reads, made of an event's amount and its account's history alone."""
    gap = F.greatest(F.coalesce("seconds_since_prior", F.lit(0.0)), F.lit(0.0))
    made = {"amount_log": F.log1p(F.greatest("amount", F.lit(0.0))), "gap_log": F.log1p(gap), "prior_log": F.log1p("prior_count"), "count_24h_log": F.log1p("count_24h"), "has_prior": (F.col("prior_count") > 0).cast("double")}
    return history.withColumns(made)


def decision_feed(stream: DataFrame, keep: int = 100) -> DataFrame:
    """After each micro-batch, a row for each of its accounts: the ``keep`` newest decisions, newest first, and the shares of blocks and reviews among them.

    State of an account: those decisions, older ones are evicted. A delivery that comes twice counts once as long as it is held.
    """
    out = "account_id long, us array<long>, transaction_id array<long>, decision array<string>, block_share double, review_share double"

    def update(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held = set(zip(*state.get, strict=True)) if state.exists else set()
        for b in batches:  # never more than ``keep`` and one Arrow batch
            held |= set(b[["us", "transaction_id", "decision"]].itertuples(index=False, name=None))
            held = set(sorted(held, reverse=True)[:keep])
        us, ids, kinds = (list(x) for x in zip(*sorted(held, reverse=True), strict=True))
        state.update((us, ids, kinds))
        yield pd.DataFrame({"account_id": [key[0]], "us": [us], "transaction_id": [ids], "decision": [kinds], "block_share": [kinds.count("block") / len(kinds)], "review_share": [kinds.count("review") / len(kinds)]})

    return stream.groupBy("account_id").applyInPandasWithState(update, out, "us array<long>, ids array<long>, kinds array<string>", "append", GroupStateTimeout.NoTimeout)


def risk_context(stream: DataFrame, limit: float = 2.0, delay_us: int = DAY_US, carry: tuple[str, ...] = ()) -> DataFrame:
    """Per event: are its amount and its account's rate of the last hour far from what the account did before, and the sentence that says so.

    State of an account: number, mean and squared deviations of its amounts and of its hourly counts, and its distinct times of the last hour
    and ``delay_us`` with their numbers. A micro-batch's rows are taken in time order; what came in earlier batches is before them, so that an
    account's rows that come in order give what the table gives. A null amount is not unusual and is left out of the account's mean.
    """
    kinds = dict(stream.dtypes)
    out = ", ".join(["transaction_id long, account_id long, amount_unusual boolean, rate_unusual boolean, rationale string", *[f"`{c}` {kinds[c]}" for c in carry]])

    def update(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        seen, amounts, rates, times, numbers = state.get if state.exists else (0, (0, 0.0, 0.0), (0, 0.0, 0.0), [], [])
        rows = pd.concat(batches).sort_values(["us", "transaction_id"])
        us, known = rows["us"].to_numpy(np.int64), np.array(times, np.int64)
        every, place = np.unique(np.concatenate([known, us]), return_inverse=True)
        held = np.zeros(len(every), np.int64)
        np.add.at(held, place, np.concatenate([np.array(numbers, np.int64), np.ones(len(us), np.int64)]))
        up_to = np.concatenate([[0], np.cumsum(held)])
        rate = (up_to[np.searchsorted(every, us, "right")] - up_to[np.searchsorted(every, us - DAY_US // 24, "right")]).astype(float)
        earlier = seen + np.arange(len(us))
        amount_far, amounts = _far(rows["amount"].to_numpy(float), amounts, earlier, limit)
        rate_far, rates = _far(rate, rates, earlier, limit)
        kept = every > every[-1] - DAY_US // 24 - delay_us
        state.update((seen + len(us), amounts, rates, every[kept].tolist(), held[kept].tolist()))
        said = np.select([amount_far & rate_far, amount_far, rate_far], ["unusual amount and rate", "unusual amount", "unusual rate"], "in line with history")
        yield pd.DataFrame({"transaction_id": rows["transaction_id"].to_numpy(), "account_id": key[0], "amount_unusual": amount_far, "rate_unusual": rate_far, "rationale": said, **{c: rows[c].to_numpy() for c in carry}})

    moments = "struct<n: long, mean: double, m2: double>"
    held = f"seen long, amounts {moments}, rates {moments}, times array<long>, numbers array<long>"
    return stream.groupBy("account_id").applyInPandasWithState(update, out, held, "append", GroupStateTimeout.NoTimeout)


def _far(values: np.ndarray, before: tuple, earlier: np.ndarray, limit: float) -> tuple[np.ndarray, tuple]:
    """Is each value more than ``limit`` sample deviations off the mean of all before it? And the moments after the last.

    Sums are of differences from a value near the mean, so that they do not cancel.
    """
    n, mean, m2 = before
    there = ~np.isnan(values)
    pivot = mean if n else (values[there][0] if there.any() else 0.0)
    shifted = np.where(there, values - pivot, 0.0)
    count = n + np.concatenate([[0], np.cumsum(there)])
    total = n * (mean - pivot) + np.concatenate([[0.0], np.cumsum(shifted)])
    square = m2 + n * (mean - pivot) ** 2 + np.concatenate([[0.0], np.cumsum(shifted**2)])
    centre = np.divide(total, count, out=np.zeros(len(total)), where=count > 0)
    left = np.maximum(square - total * centre, 0.0)
    spread = np.sqrt(np.divide(left, count - 1, out=np.zeros(len(left)), where=count > 1))
    # equal values leave what rounding leaves
    some = (earlier >= 2) & there & (spread[:-1] > 1e-9 * np.maximum(1.0, np.abs(centre[:-1] + pivot)))
    far = some & (np.abs(shifted - centre[:-1]) > limit * spread[:-1])
    return far, (int(count[-1]), float(centre[-1] + pivot), float(left[-1]))


def without_repeats(stream: DataFrame, keys: list[str], time: str = "event_time", delay: str = "1 day") -> DataFrame:
    """A delivery seen before, within the delay, is dropped; so are times up to 1970, where watermarks begin."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def rolling_edges(stream: DataFrame, window: str = "7 days", slide: str = "1 day", delay: str = "1 day") -> DataFrame:
    """Edge counts of every sliding window: the moving graph that a refresh takes its snapshot from."""
    w = F.window("event_time", window, slide).alias("w")
    return stream.withWatermark("event_time", delay).groupBy(w, "src", "dst").agg(F.count("*").alias("flows"), F.sum("amount").alias("amount")).select(F.unix_micros("w.end").alias("snapshot_end"), "src", "dst", "flows", "amount")


def late_rows(batch: DataFrame, high_us: int, delay_us: int = DAY_US) -> tuple[DataFrame, DataFrame]:
    """Rows in time, and those older than the watermark, which go to a side table."""
    late = F.col("us") < high_us - delay_us
    return batch.filter(~late), batch.filter(late)


def audited_decisions(batch: DataFrame, batch_id: int, audit_path: str, feed_path: str) -> None:
    """One micro-batch: the audit rows first, then the feed; a repeated batch overwrites its own rows."""
    named = batch.withColumn("batch_id", F.lit(batch_id))
    named.write.mode("overwrite").parquet(f"{audit_path}/batch={batch_id}")
    batch.sparkSession.read.parquet(f"{audit_path}/batch={batch_id}").select("transaction_id", "account_id", "decision").write.mode("overwrite").parquet(f"{feed_path}/batch={batch_id}")
