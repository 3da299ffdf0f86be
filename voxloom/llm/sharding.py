"""Rendezvous hashing of record keys over weighted shards.

Each shard draws a number from the record's key and its own number alone; the record goes to the
shard with the greatest weighted draw. A further shard adds one draw and changes none, so it only
takes records in. DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voxloom.llm.common import text_column

DRAWS = float(1 << 52)


def draw(key: Column, shard: int, weight: float) -> Column:
    """Weighted draw: the logarithm of a uniform number, by weight; the greatest wins."""
    uniform = (F.shiftrightunsigned(F.xxhash64(key, F.lit(shard)), 12) + F.lit(0.5)) / F.lit(DRAWS)
    return F.log(uniform) / F.lit(float(weight))


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard of ``key``; shards of weight 0 or less take nothing, equal draws go to the smaller shard."""
    draws = [F.struct(draw(key, k, w).alias("draw"), F.lit(-k).alias("shard")) for k, w in enumerate(weights) if w > 0]
    if not draws:
        raise ValueError("no shard has a positive weight")
    return (-F.array_max(F.array(*draws))["shard"]).cast("int")


def shard_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    *,
    weights: Sequence[float] = (1.0,) * 8,
    grown_weight: float = 1.0,
    buckets: int = 1024,
) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every row.

    The key is the id as text; a null id is a key of its own, so all such rows share a shard. Rows
    with the same id share a shard. Null text has size 1 and the checksum of the empty text. Slots
    number a shard's rows from 0 without gaps, in the order of (bucket, id, checksum); rows equal in
    both get neighbouring slots. An empty table gives no row; other columns are not read.

    A shard's rows are numbered in ``buckets`` parts. The parts' sizes, weights x buckets rows at
    most, are summed up first and broadcast; so no shard and no id is one task's work.
    """
    text = text_column(text_col).cast("binary")
    key = F.coalesce(F.concat(F.lit("id:"), F.col(f"`{id_col}`").cast("string")), F.lit("null"))
    slim = docs.select(
        F.col(f"`{id_col}`").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        rendezvous(key, weights).alias("shard"),
        rendezvous(key, [*weights, grown_weight]).alias("grown_shard"),
    ).withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.lit(buckets)))
    parts = slim.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    upto = W.partitionBy("shard").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.select("shard", "bucket", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("before"))
    within = F.row_number().over(W.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32"))
    return slim.withColumn("within", within).join(F.broadcast(parts), ["shard", "bucket"]).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("key").alias("law"),
        "shard",
        (F.col("before") + F.col("within") - 1).cast("long").alias("slot"),
        "grown_shard",
    )


def write_shards(docs: DataFrame, path: str, id_col: str = "doc_id", *, weights: Sequence[float] = (1.0,) * 8, files_per_shard: int = 16) -> None:
    """Write whole rows as Parquet below ``path``, a folder ``_shard=k`` for each shard, in several files each."""
    key = F.coalesce(F.concat(F.lit("id:"), F.col(f"`{id_col}`").cast("string")), F.lit("null"))
    salt = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]), F.lit(files_per_shard))
    (
        docs.withColumn("_shard", rendezvous(key, weights))
        .repartition(len(weights) * files_per_shard, "_shard", salt)
        .write.partitionBy("_shard")
        .parquet(path)
    )
