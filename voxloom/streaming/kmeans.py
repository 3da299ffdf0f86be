"""Incremental k-means, for batches or a stream.

A batch's rows are assigned to the nearest centroid by expressions; only k sums and counts come
back, and each centroid moves by its share of the batch in all that it has seen.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


class IncrementalKMeans:
    def __init__(self, k: int = 50, seed: int = 0):
        self.k, self.seed = k, seed
        self.centres: np.ndarray | None = None
        self.weights: np.ndarray | None = None

    def _start(self, rows: DataFrame) -> bool:
        """First centroids: the rows of least hash (k at most), vectors that repeat once."""
        picked = rows.filter(F.col("embedding").isNotNull()).select("embedding").distinct().orderBy(F.xxhash64("embedding", F.lit(self.seed))).limit(self.k).collect()
        if not picked:
            return False
        self.centres = np.array([r[0] for r in picked], float)
        self.weights = np.zeros(len(picked))
        return True

    def nearest(self, vec: Column) -> Column:
        """The nearest centroid's number, the smaller on ties."""
        if self.centres is None:
            raise RuntimeError("fit first")
        half = (self.centres**2).sum(axis=1) / 2
        far = [
            F.struct((F.lit(float(h)) - F.aggregate(F.zip_with(vec, F.lit(c.tolist()).cast("array<double>"), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)).alias("d"), F.lit(i).alias("k"))
            for i, (c, h) in enumerate(zip(self.centres, half, strict=True))
        ]
        return F.array_min(F.array(*far))["k"]

    def predict(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("cluster_label", self.nearest(F.col("embedding").cast("array<double>")).cast("int"))

    def update(self, rows: DataFrame) -> None:
        """Learn from one batch; an empty batch changes nothing."""
        if self.centres is None and not self._start(rows):
            return
        labelled = self.predict(rows.filter(F.col("embedding").isNotNull()))
        cells = labelled.select("cluster_label", F.posexplode(F.col("embedding").cast("array<double>")).alias("dim", "x"))
        for r in cells.groupBy("cluster_label", "dim").agg(F.avg("x").alias("mean"), F.count("*").alias("n")).collect():  # k x dimensions
            c, total = r["cluster_label"], self.weights[r["cluster_label"]] + r["n"]
            self.centres[c, r["dim"]] += (r["mean"] - self.centres[c, r["dim"]]) * r["n"] / total
        for r in labelled.groupBy("cluster_label").count().collect():
            self.weights[r["cluster_label"]] += r["count"]

    def save(self, spark: SparkSession, path: str) -> None:
        rows = [(i, c.tolist(), float(w), self.k, self.seed) for i, (c, w) in enumerate(zip(self.centres, self.weights, strict=True))]
        spark.createDataFrame(rows, "k long, centre array<double>, weight double, n long, seed long").write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> IncrementalKMeans:
        rows = sorted(spark.read.parquet(path).collect(), key=lambda r: r["k"])
        out = cls(int(rows[0]["n"]), int(rows[0]["seed"]))
        out.centres, out.weights = np.array([r["centre"] for r in rows]), np.array([r["weight"] for r in rows])
        return out

    def learn_from(self, stream: DataFrame, checkpoint: str, **trigger: object) -> StreamingQuery:
        """Learn from a streaming DataFrame with a column ``embedding``, batch by batch."""
        writer = stream.writeStream.foreachBatch(lambda rows, _: self.update(rows)).option("checkpointLocation", checkpoint)
        return writer.trigger(**(trigger or {"availableNow": True})).start()
