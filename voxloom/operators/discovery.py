"""Clusters of segment embeddings: k-means, incremental k-means and Ward's agglomeration."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.operators import clusterquality
from voxloom.streaming.kmeans import IncrementalKMeans

#: Distances that Ward's agglomeration holds at a time.
WARD_CELLS = 1 << 21


def with_features(rows: DataFrame, vec: str = "embedding") -> DataFrame:
    return rows.withColumn("_features", array_to_vector(F.col(vec).cast("array<double>")))


class KMeansDiscovery:
    """pyspark.ml's k-means; the number of clusters falls back to the number of rows where there are fewer."""

    streams = False

    def __init__(self, n_clusters: int = 50, random_state: int = 0, **options: Any):
        self.n_clusters, self.seed, self.options = n_clusters, random_state, options
        self.model: KMeansModel | None = None

    def fit(self, rows: DataFrame) -> KMeansDiscovery:
        data = with_features(rows)
        k = max(2, min(self.n_clusters, data.limit(self.n_clusters + 1).count()))
        self.model = KMeans(k=k, seed=self.seed, featuresCol="_features", predictionCol="cluster_label", **self.options).fit(data)
        return self

    def predict(self, rows: DataFrame) -> DataFrame:
        if self.model is None:
            raise RuntimeError("fit first")
        return self.model.transform(with_features(rows)).drop("_features")

    def save(self, path: str) -> None:
        self.model.write().overwrite().save(path)

    @classmethod
    def load(cls, path: str) -> KMeansDiscovery:
        out = cls()
        out.model = KMeansModel.load(path)
        out.n_clusters = out.model.summary.k if out.model.hasSummary else len(out.model.clusterCenters())
        return out


class MiniBatchKMeansDiscovery:
    """Centroids moved batch by batch; only k centroids and their weights are held."""

    streams = True

    def __init__(self, n_clusters: int = 50, random_state: int = 0, batch_size: int = 4096):
        self.batch_size = batch_size
        self.state = IncrementalKMeans(n_clusters, random_state)

    def partial_fit(self, rows: DataFrame) -> MiniBatchKMeansDiscovery:
        self.state.update(rows)
        return self

    def fit(self, rows: DataFrame) -> MiniBatchKMeansDiscovery:
        """Batches by a hash of the row, about ``batch_size`` rows each, at most 32 of them a pass."""
        n = rows.count()
        parts = max(1, min(32, -(-n // self.batch_size)))
        split = F.pmod(F.xxhash64("file_id", "segment_id"), F.lit(parts))
        for k in range(parts):
            self.partial_fit(rows.filter(split == k))
        return self

    def predict(self, rows: DataFrame) -> DataFrame:
        return self.state.predict(rows)

    def save(self, path: str, spark: SparkSession | None = None) -> None:
        self.state.save(spark or SparkSession.active(), path)

    @classmethod
    def load(cls, path: str) -> MiniBatchKMeansDiscovery:
        out = cls()
        out.state = IncrementalKMeans.load(SparkSession.active(), path)
        return out


def nearest(queries: np.ndarray, alive: np.ndarray, centres: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each query (a place in ``centres``) the other cluster alive whose union with it adds the least variance, and that gain."""
    points, square, size = centres[alive], (centres[alive] ** 2).sum(axis=1), sizes[alive]
    near, step = np.empty(len(queries), np.int64), max(1, WARD_CELLS // len(alive))
    for at in range(0, len(queries), step):
        q = queries[at : at + step]
        gain = centres[q] @ points.T
        gain *= -2
        gain += square
        gain += (centres[q] ** 2).sum(axis=1)[:, None]
        if sizes[q].max() > 1 or size.max() > 1:
            gain *= size
            gain /= size + sizes[q][:, None]
        gain[np.arange(len(q)), np.searchsorted(alive, q)] = np.inf
        near[at : at + step] = alive[gain.argmin(axis=1)]
    # the sum of squares above loses digits, so gains that are compared between queries come from differences
    apart = ((centres[queries] - centres[near]) ** 2).sum(axis=1)
    return near, sizes[queries] * sizes[near] / (sizes[queries] + sizes[near]) * apart


def ward_merges(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of clusters, each named by its first row, in the order in which Ward's agglomeration joins them.

    Two clusters that are each other's nearest are joined at once, many in a round: a union of others is never nearer
    than both were, so the tree is that of joining the nearest pair each time. What has neither changed nor lost its
    nearest keeps it. Equal rows are joined first. Memory is linear in the rows, time quadratic.
    """
    _, first, which = np.unique(x, axis=0, return_index=True, return_inverse=True)
    lead = first[which.reshape(-1)]
    again = np.nonzero(lead != np.arange(len(x)))[0]
    again = again[np.argsort(lead[again], kind="stable")]
    into, gone, heights = [lead[again]], [again], [np.zeros(len(again))]
    centres, sizes, height = x - x.mean(axis=0), np.bincount(lead, minlength=len(x)).astype(float), np.zeros(len(x))
    alive, near, gain = np.sort(first), np.zeros(len(x), np.int64), np.zeros(len(x))
    stale = alive
    while len(alive) > 1:
        near[stale], gain[stale] = nearest(stale, alive, centres, sizes)
        a = alive[(near[near[alive]] == alive) & (alive < near[alive])]
        if not len(a):  # only where rounding hides the nearest pair
            a = alive[[gain[alive].argmin()]]
        a, b = np.minimum(a, near[a]), np.maximum(a, near[a])
        height[a] = np.maximum(gain[a], np.maximum(height[a], height[b]))  # never below its parts
        into.append(a), gone.append(b), heights.append(height[a])
        centres[a] = (sizes[a][:, None] * centres[a] + sizes[b][:, None] * centres[b]) / (sizes[a] + sizes[b])[:, None]
        sizes[a] += sizes[b]
        changed = np.zeros(len(x), bool)
        changed[a] = changed[b] = True
        alive = alive[~np.isin(alive, b)]
        stale = alive[changed[alive] | changed[near[alive]]]
    order = np.argsort(np.concatenate(heights), kind="stable")
    return np.concatenate(into)[order], np.concatenate(gone)[order]


def ward_labels(x: np.ndarray, k: int) -> np.ndarray:
    """Labels 0 to k-1, by first member, after joining the two clusters whose union adds the least variance until k are left."""
    into, gone = ward_merges(x.astype(float))
    up, joins = np.arange(len(x)), max(0, len(x) - k)
    up[gone[:joins]] = into[:joins]
    while ((top := up[up]) != up).any():
        up = top
    return np.unique(up, return_inverse=True)[1].reshape(-1).astype(np.int64)


class AgglomerativeDiscovery:
    """Ward's agglomeration of all rows, exactly; it has no labels for rows it was not fitted on.

    The driver holds the vectors (8 bytes a component) and no distances but a few rows of them.
    """

    streams = False

    def __init__(self, n_clusters: int = 50):
        self.n_clusters = n_clusters
        self.labels: DataFrame | None = None

    def fit(self, rows: DataFrame) -> AgglomerativeDiscovery:
        got = rows.select("file_id", "segment_id", F.col("embedding").cast("array<double>").alias("embedding")).orderBy("file_id", "segment_id").toArrow()
        labels = np.zeros(0, np.int64)
        if got.num_rows:
            vectors = got.column("embedding").combine_chunks()
            if vectors.null_count or len(set(vectors.value_lengths().to_pylist())) > 1:
                raise ValueError("agglomerative clustering needs vectors of one length")
            labels = ward_labels(vectors.flatten().to_numpy(zero_copy_only=False).reshape(got.num_rows, -1), min(self.n_clusters, got.num_rows))
        told = pd.DataFrame({c: got.column(c).to_numpy() for c in ("file_id", "segment_id")} | {"cluster_label": labels})
        self.labels = rows.sparkSession.createDataFrame(told.astype("int64"), "file_id long, segment_id long, cluster_label long")
        return self

    def predict(self, rows: DataFrame) -> DataFrame:
        if self.labels is None:
            raise RuntimeError("fit first")
        unknown = F.raise_error(F.lit("agglomerative clustering has no label for this row")).cast("int")
        out = rows.join(self.labels, ["file_id", "segment_id"], "left")
        return out.withColumn("cluster_label", F.coalesce(F.col("cluster_label").cast("int"), unknown))

    def save(self, path: str) -> None:
        self.labels.write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, path: str) -> AgglomerativeDiscovery:
        out = cls()
        out.labels = SparkSession.active().read.parquet(path)
        return out


_MODELS: dict[str, Callable[..., Any]] = {"kmeans": KMeansDiscovery, "minibatch_kmeans": MiniBatchKMeansDiscovery, "agglomerative": AgglomerativeDiscovery}


def register_discovery_model(name: str, model: Callable[..., Any]) -> None:
    _MODELS[name.lower().replace("-", "_")] = model


def list_discovery_models() -> list[str]:
    return sorted(_MODELS)


def get_discovery_model(name: str, **options: Any) -> Any:
    key = name.lower().replace("-", "_")
    if key not in _MODELS:
        raise ValueError(f"unknown discovery model: {name}; there are {', '.join(list_discovery_models())}")
    return _MODELS[key](**options)


@dataclass
class DiscoveryResult:
    labels: DataFrame
    num_clusters: int
    model_name: str
    metrics: DataFrame | None = None
    metadata: dict[str, Any] = field(default_factory=dict)


class DiscoveryPipeline:
    """Fit a model on (file_id, segment_id, embedding) rows and label them; labels stay on their rows."""

    def __init__(self, method: str = "kmeans", **options: Any):
        self.method, self.options = method, options
        self.model = get_discovery_model(method, **options)
        self.fitted = False

    def fit(self, rows: DataFrame) -> DiscoveryPipeline:
        self.model.fit(rows)
        self.fitted = True
        return self

    def fit_batches(self, batches: Any) -> DiscoveryPipeline:
        """Feed DataFrames one after another to a model that learns in steps."""
        if not getattr(self.model, "streams", False):
            raise ValueError(f"{self.method} does not learn in steps")
        for rows in batches:
            self.model.partial_fit(rows)
            self.fitted = True
        if not self.fitted:
            raise ValueError("no data")
        return self

    def fit_storage(self, spark: SparkSession, path: str) -> DiscoveryPipeline:
        return self.fit(spark.read.parquet(path))

    def predict(self, rows: DataFrame) -> DataFrame:
        return self.model.predict(rows)

    def predict_storage(self, spark: SparkSession, path: str) -> DataFrame:
        return self.predict(spark.read.parquet(path))

    def predict_batches(self, batches: Any) -> DataFrame:
        """Labels of DataFrames that come one after another, as one DataFrame; empty ones add no row."""
        out: DataFrame | None = None
        for rows in batches:
            labels = self.predict(rows)
            out = labels if out is None else out.unionByName(labels)
        if out is None:
            raise ValueError("no data")
        return out

    def discover_storage(self, spark: SparkSession, path: str, *, metrics: bool = True) -> DiscoveryResult:
        """Fit and label the vectors stored at ``path``; by steps over them where the model can."""
        rows = spark.read.parquet(path)
        if not getattr(self.model, "streams", False):
            return self.fit(rows)._result(self.predict(rows), metrics, path=path)
        return self.fit_batches([rows])._result(self.predict(rows), metrics, path=path)

    def discover(self, rows: DataFrame, *, metrics: bool = True, exact_silhouette: bool = False) -> DiscoveryResult:
        return self._result(self.fit(rows).predict(rows), metrics, exact_silhouette=exact_silhouette)

    def _result(self, labels: DataFrame, metrics: bool, *, exact_silhouette: bool = False, **about: Any) -> DiscoveryResult:
        scored = labels.select(F.xxhash64("file_id", "segment_id").alias("id"), F.col("embedding").alias("vec"), F.col("cluster_label").alias("label"))
        n = labels.select("cluster_label").distinct().count()
        return DiscoveryResult(labels, n, self.method, clusterquality.intrinsic_metrics(scored, exact_silhouette=exact_silhouette) if metrics else None, {**self.options, **about})

    def save(self, path: str, *, metadata: dict[str, Any] | None = None, overwrite: bool = False) -> None:
        """The model below ``path``, and what describes it as JSON; refuses a path that holds one unless told to overwrite."""
        spark = SparkSession.active()
        if not overwrite and exists(spark, f"{path}/about"):
            raise FileExistsError(path)
        self.model.save(f"{path}/model")
        about = json.dumps({"method": self.method, "options": self.options, "metadata": metadata or {}}, sort_keys=True)
        spark.createDataFrame([(about,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/about")

    @classmethod
    def load(cls, path: str) -> DiscoveryPipeline:
        spark = SparkSession.active()
        if not exists(spark, f"{path}/about"):
            raise FileNotFoundError(path)
        about = json.loads(spark.read.text(f"{path}/about").first()[0])
        out = cls(about["method"], **about["options"])
        out.model = type(out.model).load(f"{path}/model")
        out.fitted = True
        return out


def save_pipeline(pipeline: DiscoveryPipeline, path: str, *, metadata: dict[str, Any] | None = None, overwrite: bool = False) -> None:
    pipeline.save(path, metadata=metadata, overwrite=overwrite)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
