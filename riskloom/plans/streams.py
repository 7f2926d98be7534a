from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from riskloom.functions.shared import shared_dir
from riskloom.operators import history, serving
from riskloom.operators.costs import decision
from riskloom.operators.splits import assign_splits
from riskloom.sources import scorers, tables
from riskloom.streaming import jobs
from riskloom.streaming.rolling import RollingGraph

from .base import T, query, rounded
from .serving import _CONTEXT

_ORDER = "PARTITION BY account_id ORDER BY us, transaction_id"


def _events(spark, sf_dir):
    e = jobs.source(spark, f"{sf_dir}/events.parquet")
    us = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts)")
    return e.select(F.col("event_id").alias("transaction_id"), F.col("user_id").alias("account_id"), us.alias("us"), F.timestamp_micros(us).alias("event_time"), F.col("value").alias("amount"), F.col("event_type").alias("transaction_type"))


@query(f"WITH {T} SELECT transaction_id, account_id, row_number() OVER ({_ORDER}) - 1 AS prior_count, round((us - lag(us) OVER ({_ORDER})) / 1e6, 6) AS seconds_since_prior, count(*) OVER (PARTITION BY account_id ORDER BY us RANGE BETWEEN 86399999999 PRECEDING AND CURRENT ROW) AS count_24h FROM t")
def stream_history(spark, sf_dir):
    return rounded(jobs.replayed(jobs.keyed_history(_events(spark, sf_dir).select("transaction_id", "account_id", "us"))))


@query(f"WITH {T} SELECT transaction_id, account_id, amount FROM t")
def stream_dedup(spark, sf_dir):
    e = _events(spark, sf_dir)
    twice = e.unionByName(_events(spark, sf_dir))  # every delivery arrives twice
    return jobs.replayed(jobs.without_repeats(twice, ["transaction_id"]).select("transaction_id", "account_id", "amount"))


@query("SELECT event_id AS transaction_id, user_id AS account_id, CASE WHEN round(value * 100) / 100 >= 400 THEN 'block' WHEN round(value * 100) / 100 >= 200 THEN 'review' ELSE 'allow' END AS decision FROM events WHERE round(value * 100) >= 500")
def stream_decisions(spark, sf_dir):
    """Envelope, parse and route, decide, audit, then feed; the feed is what comes back."""
    body = F.struct(F.lit("payment").alias("event"), F.struct(F.col("transaction_id").alias("id"), F.round(F.col("amount") * 100).cast("long").alias("amount"), F.create_map(F.lit("account_id"), F.col("account_id").cast("string")).alias("notes"), F.expr("us div 1000000").alias("created_at")).alias("payment"))
    valid, _ = serving.parsed_payments(_events(spark, sf_dir).select(F.to_json(body).alias("value")), 5.0)
    priced = valid.withColumn("decision", decision(F.col("amount").cast("double"), 200, 400))
    base = f"{shared_dir(spark)}/decisions-{uuid.uuid4().hex}"
    jobs.replayed(priced, lambda df, n: jobs.audited_decisions(df, n, f"{base}/audit", f"{base}/feed"))
    return spark.read.schema("transaction_id long, account_id long, decision string").parquet(f"{base}/feed/*")


_DAY = 86_400_000_000


@query(f"WITH {T}, e AS (SELECT us, account_id AS src, transaction_type AS dst, amount, unnest(range(0, 7)) AS i FROM t) SELECT (us // {_DAY} + 1 + i) * {_DAY} AS snapshot_end, src, dst, count(*) AS flows, round(sum(amount), 4) AS amount FROM e GROUP BY 1, 2, 3")
def stream_rolling_edges(spark, sf_dir):
    e = _events(spark, sf_dir).select("event_time", F.col("account_id").alias("src"), F.col("transaction_type").alias("dst"), "amount")
    out = jobs.replayed(jobs.rolling_edges(e), mode="complete")
    return out.withColumn("amount", F.round("amount", 4))


_CYCLE, _ROLL = 10, 14 * _DAY


@query(f"WITH RECURSIVE {T}, f AS (SELECT 'a' || account_id AS a, 'd' || account_id % 7 || '-' || us // {_DAY} % {_CYCLE} AS b FROM t, (SELECT max(us) AS hi FROM t) WHERE us >= hi - {_ROLL}), bi AS (SELECT a, b FROM f UNION SELECT b, a FROM f), reach(node, ring) USING KEY (node) AS (SELECT DISTINCT a, a FROM bi UNION SELECT bi.b, min(r.ring) FROM reach r JOIN bi ON bi.a = r.node JOIN recurring.reach k ON k.node = bi.b WHERE r.ring < k.ring GROUP BY 1) SELECT node, ring FROM reach")
def stream_rolling_rings(spark, sf_dir):
    """Rings of the last two weeks, kept up batch by batch; SQL builds them from the rows alone."""
    graph = RollingGraph(f"{shared_dir(spark)}/rolling-{uuid.uuid4().hex}", _ROLL)
    e = _events(spark, sf_dir).select("us", F.concat(F.lit("a"), F.col("account_id").cast("string")).alias("src"), F.concat(F.lit("d"), (F.col("account_id") % 7).cast("string"), F.lit("-"), F.expr(f"us div {_DAY} % {_CYCLE}").cast("string")).alias("dst"))
    versions = []

    def in_parts(batch, n):
        """A replay comes as one batch; it is taken in by thirds of its time, as a live stream would be."""
        lo, hi = batch.agg(F.min("us"), F.max("us")).first()
        if lo is None:
            return
        width = (hi - lo) // 3 + 1
        for k in range(3):
            versions.append(len(versions))
            graph.apply(batch.filter(F.expr(f"(us - {lo}) div {width}") == k), versions[-1])

    jobs.replayed(e, in_parts)
    return graph.rings(spark, len(versions) - 1)


_VERSION = "stream-1"


def batch_history(events):
    """The stream's history features of a whole table, by windows."""
    counted = history.with_velocity(history.with_prior_counts(events), {"24h": 24 * history.HOUR})
    return counted.select("transaction_id", "account_id", "prior_count", "seconds_since_prior", "count_24h", "amount", "us")


@query()
def stream_scores(spark, sf_dir):
    """A model learned on the training split's table, stored, read back and applied, with prices and decisions, to the stream's own features."""
    t = tables.events(spark, sf_dir)
    train = assign_splits(t).filter("split = 'train'").select("transaction_id", F.col("is_fraud").alias("label"))
    base = f"{shared_dir(spark)}/scores-{uuid.uuid4().hex}"
    rows = jobs.stream_features(batch_history(t)).join(train, "transaction_id")
    scorers.store_scorer(scorers.fit_scorer(rows, jobs.STREAM_FEATURES, _VERSION), spark, f"{base}/scorer")
    scorer = scorers.read_scorer(spark, f"{base}/scorer", _VERSION)
    live = jobs.keyed_history(_events(spark, sf_dir), carry=("amount", "us"))
    decided = jobs.scored(live, scorer, 0.2, 0.25).select("transaction_id", "account_id", "score", "cost_blocked", "cost_allowed", "decision")
    return rounded(jobs.replayed(decided))


@query(f"WITH {T}, d AS (SELECT *, CASE WHEN amount >= 400 THEN 'block' WHEN amount >= 200 THEN 'review' ELSE 'allow' END AS decision, row_number() OVER (PARTITION BY account_id ORDER BY us DESC, transaction_id DESC) AS nth FROM t) SELECT account_id, count(*) AS held, max(transaction_id) FILTER (nth = 1) AS newest, min(us) AS oldest_us, round(avg(CAST(decision = 'block' AS INT)), 6) AS block_share, round(avg(CAST(decision = 'review' AS INT)), 6) AS review_share FROM d WHERE nth <= 100 GROUP BY 1")
def stream_feed(spark, sf_dir):
    """Each account's hundred newest decisions as the feed holds them after the replay."""
    e = _events(spark, sf_dir).withColumn("decision", decision(F.col("amount"), 200, 400)).select("account_id", "us", "transaction_id", "decision")
    out = jobs.replayed(jobs.decision_feed(e))
    return rounded(out.select("account_id", F.size("us").cast("long").alias("held"), F.col("transaction_id")[0].alias("newest"), F.array_min("us").alias("oldest_us"), "block_share", "review_share"))


@query(_CONTEXT)
def stream_context(spark, sf_dir):
    """The context that each decision carries, made in the stream; SQL is that of the table."""
    e = _events(spark, sf_dir).select("transaction_id", "account_id", "us", "amount")
    return jobs.replayed(jobs.risk_context(e)).drop("account_id")
