"""How queries are registered, and the SQL that the plans share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its name, with the SQL its rows are checked against."""

    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Sums of doubles depend on their order; six places do not."""
    return df.select(*[F.round(c, places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


T = "t AS (SELECT event_id AS transaction_id, user_id AS account_id, epoch_us(ts) AS us, value AS amount, event_type AS transaction_type, event_type = 'error' AS is_fraud, json_extract_string(props, '$.k') AS device FROM events)"
O = "o AS (SELECT o_orderkey AS transaction_id, o_custkey AS account_id, epoch_us(o_orderdate) AS us, o_totalprice AS amount, o_orderpriority AS transaction_type, o_orderstatus = 'F' AS is_fraud FROM orders)"
S = "s AS (SELECT l_orderkey AS id, l_linenumber AS line, (50 * CAST(round(l_discount * 100) AS BIGINT) + 37 * CAST(round(l_tax * 100) AS BIGINT) + 4 * CAST(l_quantity AS BIGINT)) / 1000.0::DOUBLE AS score, CAST(l_quantity AS BIGINT) / 50.0::DOUBLE AS other, l_returnflag = 'R' AS label, l_extendedprice AS amount, l_linestatus AS band FROM lineitem)"
#: The same with a number for each row, as order and line number repeat; rows equal in all of these are alike.
SN = S + ", sn AS (SELECT *, row_number() OVER (ORDER BY id, line, score, other, label, amount, band) - 1 AS row FROM s)"
#: Runs of the score from the top, one row for each distinct value.
CURVE = S + ", g AS (SELECT score, count(*) AS n, count(*) FILTER (label) AS tp, sum(CASE WHEN label THEN amount ELSE 0 END) AS amt FROM s GROUP BY score), c AS (SELECT *, sum(n) OVER (ORDER BY score DESC) AS cum_n, sum(tp) OVER (ORDER BY score DESC) AS cum_tp, sum(amt) OVER (ORDER BY score DESC) AS cum_amt FROM g)"
