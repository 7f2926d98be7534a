"""Reads that no query of the synthetic tables needs."""

from __future__ import annotations

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.sql import types as T

from riskloom.sources import tables

SCHEMA = T.StructType([T.StructField("id-01", T.LongType()), T.StructField("V1", T.DoubleType()), T.StructField("V12", T.DoubleType()), T.StructField("Vx", T.StringType())])


@pytest.fixture
def file(tmp_path):
    path = tmp_path / "rows.csv"
    path.write_text("id-01,V1,V12,Vx\n" + "".join(f"{i * 7},{i}.5,,word{i}\n" for i in range(3_000)))
    return str(path)


def test_source_rows_are_positions_in_the_file(spark, file):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")  # many partitions
    try:
        rows = tables.read_csv(spark, file, SCHEMA)
        assert rows.rdd.getNumPartitions() > 3
        got = tables.with_source_rows(rows).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted(r.source_row for r in got) == [*range(3_000)]
    assert all(r["id-01"] == 7 * r.source_row for r in got)


def test_source_rows_of_nothing(spark):
    assert tables.with_source_rows(spark.createDataFrame([], "a long")).collect() == []


def test_headers_and_wide_blocks(spark, file):
    rows = tables.normalised(tables.read_csv(spark, file, SCHEMA))
    assert rows.columns == ["id_01", "V1", "V12", "Vx"]
    assert tables.wide_block(rows, "id_01").columns == ["id_01", "V1", "V12"]
    assert tables.read_csv(spark, file, SCHEMA, ["V1"]).first().asDict() == {"V1": 0.5}


def test_a_malformed_row_fails_the_scan(spark, tmp_path):
    path = tmp_path / "bad.csv"
    path.write_text("id-01,V1,V12,Vx\nnot a number,1,2,x\n")
    with pytest.raises(Py4JJavaError, match="(?i)malformed"):
        tables.read_csv(spark, str(path), SCHEMA).collect()
