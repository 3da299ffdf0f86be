"""Helpers shared by the training-data operators: shared storage, Arrow batches, words."""

from __future__ import annotations

import contextlib
import ctypes
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of anything but space and the control characters 0x09 to 0x0D.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows that a Python worker holds at a time; one very long text must fit beside the others.
SLICE = 512


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as ``spark.checkpoint.dir`` names it; an error where it is unset."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return path.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/voxloom/{name}-{uuid.uuid4().hex}"


def write_table(df: DataFrame, path: str) -> DataFrame:
    """Write ``df`` as Parquet at ``path`` and read it back: lineage ends here, and any executor may be lost after."""
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder, for as long as that folder's owner keeps it."""
    return write_table(df, shared_path(df.sparkSession, name))


class Scratch:
    """Tables in the shared folder that go when the ``with`` block ends, or before, when ``drop`` names them.

    What an operator returns lazily must not read from them: write that by ``materialize``.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.paths = spark, {}

    def __enter__(self) -> Scratch:
        return self

    def table(self, df: DataFrame, name: str) -> DataFrame:
        path = shared_path(self.spark, name)
        out = write_table(df, path)
        self.paths[id(out)] = (out, path)
        return out

    def drop(self, *tables: DataFrame | None) -> None:
        for t in tables:
            if t is not None and id(t) in self.paths:
                delete(self.spark, self.paths.pop(id(t))[1])

    def __exit__(self, *why: object) -> None:
        self.drop(*[t for t, _ in self.paths.values()])


def delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def arrow_rows(spark: SparkSession) -> None:
    """Bound what one Arrow batch holds, in rows and bytes, since texts may be long.

    The bounds are the same wherever this is called, so a lazy plan does not depend on what ran since.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4096")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(32 << 20))


def slices(batches: Iterable[pa.RecordBatch], rows: int = SLICE) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def as_bytes(values: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null is empty."""
    return [x or b"" for x in values.cast(pa.binary()).to_pylist()]


def give_back() -> None:
    """Return what this process has freed to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):
        ctypes.CDLL(None).malloc_trim(0)


def text_column(name: str) -> Column:
    return F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(""))


def crc_mod(name: str, modulus: int) -> Column:
    """crc32 of the id as text, mod ``modulus``; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(f"`{name}`").cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def thinned(key: Column, rows: int, wanted: int) -> Column:
    """True for about twice ``wanted`` of ``rows`` rows, told by a hash of ``key``: what is left is few enough to sort."""
    return F.pmod(F.xxhash64(key), F.lit(1 << 30)) <= F.lit(int(min(1.0, 2 * wanted / max(rows, 1)) * (1 << 30)))
