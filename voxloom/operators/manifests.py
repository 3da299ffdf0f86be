"""Manifests of files, segments, embeddings and clusters, and their joins."""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T


def load(spark: SparkSession, data: Any, schema: str | None = None) -> DataFrame:
    """A DataFrame, a list of dicts, or a path of CSV, TSV or Parquet files."""
    if isinstance(data, DataFrame):
        return data
    if isinstance(data, list):
        return spark.createDataFrame(data, schema) if data or schema else spark.createDataFrame([], "file_id long")
    path = str(data)
    kind = path.rsplit(".", 1)[-1].lower() if "." in path.rsplit("/", 1)[-1] else ""
    reader = spark.read.schema(schema) if schema else spark.read
    if kind in ("csv", "tsv"):
        return reader.csv(path, header=True, sep="\t" if kind == "tsv" else ",", inferSchema=not schema)
    if kind in ("parquet", "pq"):
        return reader.parquet(path)
    raise ValueError(f"unsupported manifest format: {path}")


def need(df: DataFrame, *names: str) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def has(df: DataFrame, name: str, otherwise: Column) -> Column:
    return F.col(name) if name in df.columns else otherwise


def ordinal(order: list[Column]) -> Column:
    """Row numbers from 0 in a global order; only for small driver-side tables such as file lists."""
    return (F.row_number().over(W.orderBy(*order)) - 1).cast("long")


def file_manifest(rows: DataFrame, path_col: str = "audio_path") -> DataFrame:
    """file_id long, audio_path string, then the other columns.

    A missing or null file_id becomes the row's place by path. Without a path column an error is raised.
    """
    need(rows, path_col)
    rest = [c for c in rows.columns if c not in ("file_id", path_col)]
    own = F.col("file_id").cast("long") if "file_id" in rows.columns else None
    place = ordinal([F.col(path_col)]) if own is None else F.coalesce(own, ordinal([F.col(path_col)])) if rows.schema["file_id"].nullable else own
    return rows.select(place.alias("file_id"), F.col(path_col).cast("string").alias("audio_path"), *rest)


def segment_manifest(files: DataFrame) -> DataFrame:
    """One row a segment of each file's nested ``segments`` (or ``syllables``), numbered within the file."""
    nested = [F.col(c) for c in ("segments", "syllables") if c in files.columns]
    if not nested:
        raise ValueError("missing columns: segments")
    spans = F.coalesce(*nested, *([F.array().cast(files.schema[[c for c in ("segments", "syllables") if c in files.columns][0]].dataType)]))
    kwargs = has(files, "segmentation_kwargs", F.lit(None).cast("string"))
    if "segmentation_kwargs" in files.columns and not isinstance(files.schema["segmentation_kwargs"].dataType, T.StringType):
        kwargs = sorted_json(files, "segmentation_kwargs")
    keep = ["file_id", *(c for c in ("audio_path",) if c in files.columns)]
    rows = files.select(
        *keep,
        has(files, "segmentation_method", F.lit(None).cast("string")).alias("segmentation_method"),
        kwargs.alias("segmentation_kwargs_ref"),
        F.size(spans).alias("num_segments"),
        F.posexplode(spans).alias("pos", "s"),
    )
    field = lambda n: F.coalesce(F.col(f"s.{n}").cast("double"), F.raise_error(F.lit("a segment needs start, peak and end")))
    head = ["file_id", F.col("pos").cast("long").alias("segment_id"), field("start").alias("start"), field("peak").alias("peak"), field("end").alias("end")]
    return rows.select(*head, "segmentation_method", "segmentation_kwargs_ref", "num_segments", *keep[1:])


def discovery_manifest(rows: DataFrame) -> DataFrame:
    """Clustered segments with all columns of the discovery manifest; embedding_id defaults to segment_id."""
    need(rows, "file_id", "segment_id", "start", "end", "cluster_label")
    none = lambda kind: F.lit(None).cast(kind)
    text = lambda n: has(rows, n, none("string")).cast("string").alias(n)
    out = [
        F.col("file_id").cast("long").alias("file_id"),
        F.col("segment_id").cast("long").alias("segment_id"),
        F.coalesce(has(rows, "embedding_id", none("long")), F.col("segment_id")).cast("long").alias("embedding_id"),
        F.col("start").cast("double").alias("start"),
        has(rows, "peak", none("double")).cast("double").alias("peak"),
        F.col("end").cast("double").alias("end"),
        F.col("cluster_label").cast("int").alias("cluster_label"),
        *(text(n) for n in ("embedding_path", "discovery_method", "discovery_model_path", "discovery_kwargs_ref")),
    ]
    return rows.select(*out, *(c for c in ("audio_path", "cluster_score") if c in rows.columns))


def sorted_json(df: DataFrame, name: str) -> Column:
    """A map or struct as JSON with its keys in order; arrays as they are."""
    kind, col = df.schema[name].dataType, F.col(name)
    if isinstance(kind, T.MapType):
        return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(col))))
    if isinstance(kind, T.StructType):
        return F.to_json(F.struct(*(F.col(f"{name}.{f}").alias(f) for f in sorted(kind.names))))
    return F.to_json(col)


def label_manifest(rows: DataFrame) -> DataFrame:
    """Nested columns as JSON text, for sinks that hold flat columns only."""
    nested = (T.ArrayType, T.MapType, T.StructType)
    return rows.select(*(sorted_json(rows, f.name).alias(f.name) if isinstance(f.dataType, nested) else F.col(f.name) for f in rows.schema.fields))


def left_join(left: DataFrame, right: DataFrame, keys: list[str], mark: str) -> DataFrame:
    """Left join on keys that match even when null; other columns of the right that clash get ``mark`` as an ending."""
    held = {c: f"_k_{c}" for c in keys}
    renamed = right.select(*(F.col(c).alias(held.get(c, f"{c}{mark}" if c in left.columns else c)) for c in right.columns))
    on = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(held[k])) for k in keys))
    return left.join(renamed, on, "left").drop(*held.values())


def join_corpus(segments: DataFrame, files: DataFrame | None = None, embeddings: DataFrame | None = None, discovery: DataFrame | None = None, labels: DataFrame | None = None) -> DataFrame:
    """Segments with what the other manifests say of their file, embedding, cluster and label.

    Files and embeddings join on file_id; clusters on file_id and segment_id where both have it;
    labels on these or else on file_id, start and end. ``audio_path`` is the first that is not null.
    """
    need(segments, "file_id")
    out = segments
    if files is not None:
        need(files, "file_id", "audio_path")
        out = left_join(out, files.select("file_id", F.col("audio_path").alias("audio_path_file")), ["file_id"], "_file")
        first = [F.col(c) for c in ("audio_path", "audio_path_file") if c in out.columns]
        out = out.withColumn("audio_path", F.coalesce(*first)).drop("audio_path_file")
    if embeddings is not None:
        need(embeddings, "file_id")
        out = left_join(out, embeddings, ["file_id"], "_embedding")
    for other, mark in ((discovery, "_discovery"), (labels, "_label")):
        if other is None:
            continue
        need(other, "file_id")
        by_id = "segment_id" in other.columns and "segment_id" in out.columns
        spans = ["start", "end"] if mark == "_label" and {"start", "end"} <= {*other.columns} & {*out.columns} else []
        out = left_join(out, other, ["file_id", *(["segment_id"] if by_id else spans)], mark)
    return out


def lookup(embeddings: DataFrame, requests: DataFrame | list[tuple[int, int]], *, value: str = "embedding") -> DataFrame:
    """Rows for (file_id, segment_id) requests, in their order (``ord``); a missing row raises when it is read.

    Requests are a DataFrame of ord, file_id and segment_id, or a short list of pairs.
    """
    need(embeddings, "file_id", "segment_id", value)
    asked = requests.select("ord", "file_id", "segment_id") if isinstance(requests, DataFrame) else embeddings.sparkSession.createDataFrame([(k, int(f), int(s)) for k, (f, s) in enumerate(requests)], "ord long, file_id long, segment_id long")
    found = asked.join(embeddings.select("file_id", "segment_id", F.col(value).alias("_v"), F.lit(True).alias("_hit")), ["file_id", "segment_id"], "left")
    missing = F.raise_error(F.concat(F.lit("no row for file "), F.col("file_id").cast("string"), F.lit(", segment "), F.col("segment_id").cast("string")))
    return found.select("ord", "file_id", "segment_id", F.when(F.col("_hit"), F.col("_v")).otherwise(missing).alias(value)).orderBy("ord")
