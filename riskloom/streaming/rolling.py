"""A moving window of flows as a graph whose rings follow each micro-batch.

The state is a set of tables in the shared folder, a version a batch: edge counts, the rings of nodes, the accounts that the
batch touched and one row of notes. A batch adds its rows, evicts those that left the window, and finds components anew only
among rings that gained or lost an edge. Version ``n`` is written from version ``n - 1`` alone, so a batch that is
delivered again writes the same version again. Rows are kept by batch; evicted ones are those between two cutoffs.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.functions.shared import cut
from riskloom.operators.components import connected_components

_EDGES, _RINGS, _ROWS = "u string, v string, flows long", "node string, ring string", "us long, u string, v string"
_NOTES = "batch long, cutoff long, inserted long, late long, evicted long, touched long, recomputed long"


@dataclass(frozen=True)
class RollingGraph:
    """``path`` is in the shared folder; a row stays for ``window_us`` behind the latest time seen."""

    path: str
    window_us: int

    def _read(self, spark: SparkSession, name: str, version: int, schema: str) -> DataFrame:
        return spark.createDataFrame([], schema) if version < 0 else spark.read.schema(schema).parquet(f"{self.path}/{name}/version={version}")

    def edges(self, spark: SparkSession, version: int) -> DataFrame:
        return self._read(spark, "edges", version, _EDGES)

    def rings(self, spark: SparkSession, version: int) -> DataFrame:
        return self._read(spark, "rings", version, _RINGS)

    def touched(self, spark: SparkSession, version: int) -> DataFrame:
        return self._read(spark, "touched", version, "node string")

    def notes(self, spark: SparkSession, version: int) -> DataFrame:
        return self._read(spark, "notes", version, _NOTES)

    def rows(self, spark: SparkSession, version: int, since: int) -> DataFrame:
        """Rows of the batches up to ``version``, from ``since`` on; older files are skipped by their statistics."""
        paths = [f"{self.path}/rows/version={n}" for n in range(version + 1)]
        return spark.read.schema(_ROWS).parquet(*paths).filter(F.col("us") >= since) if paths else spark.createDataFrame([], _ROWS)

    def snapshot(self, spark: SparkSession, version: int, end: int) -> DataFrame:
        """The edges that may score rows from ``end`` on; refused where a row of the window is not before it."""
        late = self.rows(spark, version, end)
        if not late.isEmpty():
            raise ValueError(f"the window holds rows at or after the snapshot's end {end}")
        return self.edges(spark, version)

    def apply(self, batch: DataFrame, n: int) -> None:
        """Take in ``batch(us, src, dst)`` as version ``n``."""
        spark, write = batch.sparkSession, lambda df, name: df.write.mode("overwrite").parquet(f"{self.path}/{name}/version={n}")
        last = self.notes(spark, n - 1).first()
        known = batch.filter("us IS NOT NULL AND src IS NOT NULL AND dst IS NOT NULL")
        came = cut(known.select("us", F.least(F.col("src").cast("string"), F.col("dst").cast("string")).alias("u"), F.greatest(F.col("src").cast("string"), F.col("dst").cast("string")).alias("v")), "came")
        old = last.cutoff if last else -(1 << 62)
        high = came.agg(F.max("us")).first()[0]
        cutoff = max(old, high - self.window_us) if high is not None else old
        write(came.filter(F.col("us") >= cutoff), "rows")
        fresh = self._read(spark, "rows", n, _ROWS)
        gone = self.rows(spark, n - 1, old).filter(F.col("us") < cutoff)
        of = lambda rows, sign: rows.groupBy("u", "v").agg((sign * F.count("*")).alias("change"))
        delta = cut(of(fresh, 1).unionByName(of(gone, -1)).groupBy("u", "v").agg(F.sum("change").alias("change"), F.sum(F.abs("change")).alias("moved")), "delta")
        before = self.edges(spark, n - 1)
        both = before.withColumn("change", F.lit(0).cast("long")).unionByName(delta.select("u", "v", F.lit(0).cast("long").alias("flows"), "change"))
        now = cut(both.groupBy("u", "v").agg(F.sum("flows").alias("was"), F.sum(F.col("flows") + F.col("change")).alias("flows")), "now")
        write(now.filter("flows > 0").select("u", "v", "flows"), "edges")
        ends = lambda df: df.select(F.explode(F.array("u", "v")).alias("node")).distinct()
        write(ends(delta.filter("moved > 0")), "touched")
        changed = ends(now.filter("(was > 0) <> (flows > 0)"))
        rings, edges = self.rings(spark, n - 1), self.edges(spark, n)
        hit = rings.join(changed, "node", "left_semi").select("ring").distinct()
        affected = cut(changed.unionByName(rings.join(hit, "ring", "left_semi").select("node")).distinct(), "affected")
        # a ring is hit whole, so an edge at one affected node lies among affected nodes
        again = edges.join(affected.withColumnRenamed("node", "u"), "u", "left_semi").select(F.col("u").alias("src"), F.col("v").alias("dst"))
        found = connected_components(again).withColumnRenamed("component", "ring")
        alone = again.filter("src = dst").select(F.col("src").alias("node"), F.col("src").alias("ring")).join(found.select("node"), "node", "left_anti").distinct()
        write(rings.join(affected, "node", "left_anti").unionByName(found).unionByName(alone), "rings")
        count = lambda df: df.agg(F.count("*")).first()[0]
        inserted = count(fresh)
        notes = (n, cutoff, inserted, count(came) - inserted, count(gone), count(self.touched(spark, n)), count(affected))
        write(spark.createDataFrame([notes], _NOTES), "notes")
