"""Embedding bundles, label artefacts and flat manifests as files."""

from __future__ import annotations

import io
import json
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.operators.contingency import ClusterScores, score
from voxloom.operators.discovery import exists
from voxloom.operators.manifests import label_manifest
from voxloom.schemas import BUNDLE, EMBEDDING_MANIFEST

FORMATS = ("parquet", "orc", "json", "csv", "tsv")


def _format(path: str, given: str = "auto") -> str:
    if given != "auto":
        kind = given
    else:
        tail = path.rstrip("/").rsplit("/", 1)[-1]
        kind = tail.rsplit(".", 1)[-1].lower() if "." in tail else "parquet"
    if kind not in FORMATS:
        raise ValueError(f"unknown format: {kind}; there are {', '.join(FORMATS)}")
    return kind


def write_flat(rows: DataFrame, path: str, kind: str = "auto", mode: str = "errorifexists") -> None:
    """CSV and TSV hold nested columns as JSON text; the other formats hold them as they are."""
    kind = _format(path, kind)
    if kind in ("csv", "tsv"):
        label_manifest(rows).write.mode(mode).csv(path, header=True, sep="\t" if kind == "tsv" else ",")
    else:
        rows.write.mode(mode).format(kind).save(path)


def save_embeddings(bundle: DataFrame, path: str, kind: str = "auto", *, partition_by: str | None = None, compression: str = "zstd", mode: str = "errorifexists") -> None:
    """A row a file with all its vectors; failed files keep their error."""
    writer = bundle.write.mode(mode).option("compression", compression if _format(path, kind) in ("parquet", "orc") else "none")
    (writer.partitionBy(partition_by) if partition_by else writer).format(_format(path, kind)).save(path)


def load_embeddings(spark: SparkSession, path: str, kind: str = "auto", *, filter_failed: bool = True, file_ids: list[int] | None = None) -> DataFrame:
    """The bundle, of some files where ``file_ids`` names them; filters reach the scan."""
    kind = _format(path, kind)
    reader = spark.read.schema(BUNDLE) if kind == "json" else spark.read
    rows = reader.format(kind).load(path)
    if filter_failed:
        rows = rows.filter("success")
    return rows if file_ids is None else rows.filter(F.col("file_id").isin(file_ids))


# ---- array archives ------------------------------------------------------------------------------


def _npz(rows: list[dict[str, Any]], compress: bool) -> bytes:
    held: dict[str, Any] = {
        "audio_paths": np.array([r["audio_path"] or "" for r in rows]), "success_flags": np.array([bool(r["success"]) for r in rows]),
        "file_ids": np.array([r["file_id"] for r in rows], np.int64), "num_files": len(rows),
    }
    for k, r in enumerate(rows):
        held[f"embeddings_{k}"] = r["embeddings"]
        held[f"metadata_{k}"] = json.dumps(r["metadata"] if r["success"] else {"error": r["error"], "audio_path": r["audio_path"]})
    out = io.BytesIO()
    (np.savez_compressed if compress else np.savez)(out, **held)
    return out.getvalue()


def _from_npz(content: bytes) -> Iterator[dict[str, Any]]:
    with np.load(io.BytesIO(content), allow_pickle=False) as held:
        ids = held["file_ids"] if "file_ids" in held.files else np.arange(int(held["num_files"]))
        for k in range(int(held["num_files"])):
            about, ok = json.loads(str(held[f"metadata_{k}"])), bool(held["success_flags"][k])
            yield {"file_id": int(ids[k]), "audio_path": str(held["audio_paths"][k]), "embeddings": held[f"embeddings_{k}"], "metadata": about if ok else {}, "success": ok, "error": None if ok else about.get("error")}


def _h5py() -> Any:
    try:
        import h5py
    except ImportError as e:
        raise ImportError("HDF5 bundles need h5py") from e
    return h5py


def _hdf5(rows: list[dict[str, Any]], compress: bool) -> bytes:
    out = io.BytesIO()
    with _h5py().File(out, "w") as f:
        for k, r in enumerate(rows):
            group = f.create_group(f"file_{k}")
            if r["success"]:
                group.create_dataset("embeddings", data=r["embeddings"], compression="gzip" if compress else None)
                group.attrs.update(r["metadata"])
            else:
                group.attrs["error"] = r["error"] or ""
            group.attrs.update({"audio_path": r["audio_path"] or "", "success": bool(r["success"]), "file_id": r["file_id"]})
        f.attrs.update({"num_files": len(rows), "num_success": sum(bool(r["success"]) for r in rows)})
    return out.getvalue()


def _from_hdf5(content: bytes) -> Iterator[dict[str, Any]]:
    with _h5py().File(io.BytesIO(content), "r") as f:
        for k in range(int(f.attrs["num_files"])):
            group, ok = f[f"file_{k}"], bool(f[f"file_{k}"].attrs["success"])
            about = {n: str(v) for n, v in group.attrs.items() if n not in ("audio_path", "success", "file_id", "error")}
            yield {"file_id": int(group.attrs.get("file_id", k)), "audio_path": str(group.attrs["audio_path"]), "embeddings": group["embeddings"][:] if ok else np.zeros((0, 0)), "metadata": about if ok else {}, "success": ok, "error": None if ok else str(group.attrs.get("error", "unknown error"))}


_ARCHIVES: dict[str, tuple[Callable[..., bytes], Callable[..., Iterator[dict[str, Any]]]]] = {"npz": (_npz, _from_npz), "h5": (_hdf5, _from_hdf5)}


def save_archives(bundle: DataFrame, path: str, kind: str = "npz", *, compress: bool = True, files: int = 256) -> int:
    """Write a bundle as array archives (npz or h5) of up to ``files`` files each below the folder ``path``; returns how many.

    A task writes its own archives and names them by its partition, so one that runs again replaces them.
    """
    import pyarrow.fs as pafs

    pack = _ARCHIVES[kind][0]
    if kind == "h5":
        _h5py()
    target, root = pafs.FileSystem.from_uri(path)
    target.create_dir(root, recursive=True)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, at = pafs.FileSystem.from_uri(path)
        part, count, held = TaskContext.get().partitionId(), 0, []

        def out() -> None:
            name = f"{at}/part-{part:05d}-{count:05d}.{kind}"
            with fs.open_output_stream(f"{name}.writing-{TaskContext.get().taskAttemptId()}") as f:
                f.write(pack(held, compress))
            fs.move(f"{name}.writing-{TaskContext.get().taskAttemptId()}", name)

        for frame in frames:
            for r in frame.to_dict("records"):
                vectors = r["embeddings"] if r["embeddings"] is not None else []
                held.append({**r, "embeddings": np.array([np.asarray(v, float) for v in vectors]), "metadata": dict(r["metadata"] or {})})
                if len(held) == files:
                    out()
                    count, held = count + 1, []
        if held:
            out()
            count += 1
        yield pd.DataFrame({"n": [count]})

    rows = bundle.select("file_id", "audio_path", "embeddings", "metadata", "success", "error")
    return rows.mapInPandas(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def load_archives(spark: SparkSession, path: str, kind: str = "npz", *, filter_failed: bool = True) -> DataFrame:
    """The bundle of all archives (npz or h5) below ``path``; an archive is read by one task. Pickled arrays are refused."""
    unpack = _ARCHIVES[kind][1]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for content in frame["content"]:
                rows = list(unpack(content))
                yield pd.DataFrame([{**r, "embeddings": np.asarray(r["embeddings"], float).tolist()} for r in rows], columns=["file_id", "audio_path", "embeddings", "metadata", "success", "error"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*.{kind}").load(path).select("content")
    rows = files.mapInPandas(run, BUNDLE)
    return rows.filter("success") if filter_failed else rows


def embedding_rows(bundle: DataFrame) -> DataFrame:
    """One row a vector: file_id, segment_id, embedding."""
    rows = bundle.filter("success").select("file_id", F.posexplode("embeddings").alias("segment_id", "embedding"))
    return rows.withColumn("segment_id", F.col("segment_id").cast("long"))


def write_embedding_manifest(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    rows.write.mode(mode).csv(path, header=True)


def load_embedding_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Typed columns; ``success`` is true where its text is, in any case."""
    rows = spark.read.csv(path, header=True)
    kinds = dict(f.strip().split(" ") for f in EMBEDDING_MANIFEST.split(","))
    cast = lambda c: (F.lower(c) == "true") if kinds.get(c) == "boolean" else F.col(c).cast(kinds.get(c, "string"))
    return rows.select(*(cast(c).alias(c) for c in rows.columns))


def chunks(rows: DataFrame, size: int = 10_000) -> Any:
    """The rows in lists of ``size`` at most, without bringing them all to the driver at once."""
    held = []
    for row in rows.toLocalIterator(prefetchPartitions=True):
        held.append(row)
        if len(held) == size:
            yield held
            held = []
    if held:
        yield held


PARTS = ("segments", "clusters", "labels", "overall")


def export_label_artifacts(rows: DataFrame, base: str, *, cluster: str = "cluster_label", label: str = "primary_label", mode: str = "overwrite") -> ClusterScores:
    """Four tables below ``base``: the labelled segments, scores by cluster and by label, and the overall scores as JSON."""
    scores = score(rows, cluster, label)
    write_flat(rows, f"{base}/segments.parquet", mode=mode)
    write_flat(scores.clusters, f"{base}/clusters.parquet", mode=mode)
    write_flat(scores.labels, f"{base}/labels.parquet", mode=mode)
    scores.overall.coalesce(1).write.mode(mode).json(f"{base}/overall.json")  # one row
    return scores


def load_label_artifacts(spark: SparkSession, base: str) -> dict[str, DataFrame]:
    """The tables that are there; those that are missing are empty."""
    out = {}
    for part in PARTS:
        path = f"{base}/{part}.{'json' if part == 'overall' else 'parquet'}"
        out[part] = spark.read.format("json" if part == "overall" else "parquet").load(path) if exists(spark, path) else spark.createDataFrame([], "cluster int")
    return out
