"""The driver tables seen as the tables that operators work on, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

GAP, CELL = 43_200.0, 86_400.0

#: The same views for DuckDB.
SQL = f"""
WITH frames AS (
  SELECT vec_id // 50 AS file_id, vec_id % 50 AS frame, list_transform(embedding, lambda x: x::DOUBLE) AS vec, label AS gold FROM embeddings),
signal AS (
  SELECT user_id AS file_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx,
         epoch(ts) - epoch(TIMESTAMP '2024-01-01') AS t, value AS v, event_type FROM events),
cut AS (SELECT *, CASE WHEN t - lag(t) OVER w > {GAP} OR lag(t) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM signal WINDOW w AS (PARTITION BY file_id ORDER BY idx)),
named AS (SELECT *, sum(new) OVER (PARTITION BY file_id ORDER BY idx) - 1 AS segment_id FROM cut),
segs AS (
  SELECT file_id, segment_id::BIGINT AS segment_id, min(t) AS start, arg_max(t, (v, -idx)) AS peak, max(t) AS "end", count(*) AS n FROM named GROUP BY ALL),
cells AS (SELECT *, floor(t / {CELL})::BIGINT AS interval_idx FROM signal),
tiers AS (
  SELECT file_id, interval_idx, interval_idx * {CELL} AS xmin, (interval_idx + 1) * {CELL} AS xmax, arg_min(event_type, idx) AS text FROM cells GROUP BY ALL),
files AS (SELECT o_orderkey AS file_id, 'audio/' || o_orderstatus || '/' || lpad(o_orderkey::VARCHAR, 9, '0') || '.wav' AS audio_path FROM orders),
fsegs AS (
  SELECT l_orderkey AS file_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) - 1 AS segment_id,
         l_quantity AS start, l_quantity + l_discount AS peak, l_quantity + l_discount + l_tax AS "end", l_suppkey AS suppkey FROM lineitem)
"""


class Views:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def frames(self) -> DataFrame:
        return self.table("embeddings").select(
            F.expr("vec_id div 50").alias("file_id"), (F.col("vec_id") % 50).alias("frame"), F.col("embedding").cast("array<double>").alias("vec"), F.col("label").alias("gold")
        )

    def signal(self) -> DataFrame:
        w = W.partitionBy("user_id").orderBy("ts", "event_id")
        t = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6 - F.lit(1704067200.0)
        return self.table("events").select(
            F.col("user_id").alias("file_id"), (F.row_number().over(w) - 1).cast("long").alias("idx"), t.alias("t"), F.col("value").alias("v"), "event_type"
        )

    def segs(self) -> DataFrame:
        from voxloom.operators.frames import split_at_gaps

        return split_at_gaps(self.signal(), GAP).withColumn("segment_id", F.col("segment_id").cast("long"))

    def tiers(self) -> DataFrame:
        cell = F.floor(F.col("t") / CELL).alias("interval_idx")
        rows = self.signal().select("file_id", cell, F.struct("idx", "event_type").alias("e")).groupBy("file_id", "interval_idx").agg(F.min("e").alias("e"))
        return rows.select("file_id", "interval_idx", (F.col("interval_idx") * CELL).alias("xmin"), ((F.col("interval_idx") + 1) * CELL).alias("xmax"), F.col("e.event_type").alias("text"))

    def files(self) -> DataFrame:
        path = F.concat(F.lit("audio/"), F.col("o_orderstatus"), F.lit("/"), F.lpad(F.col("o_orderkey").cast("string"), 9, "0"), F.lit(".wav"))
        return self.table("orders").select(F.col("o_orderkey").alias("file_id"), path.alias("audio_path"))

    def fsegs(self) -> DataFrame:
        w = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
        q, d, x = F.col("l_quantity"), F.col("l_discount"), F.col("l_tax")
        return self.table("lineitem").select(
            F.col("l_orderkey").alias("file_id"), (F.row_number().over(w) - 1).cast("long").alias("segment_id"), q.alias("start"), (q + d).alias("peak"), (q + d + x).alias("end"), F.col("l_suppkey").alias("suppkey")
        )
