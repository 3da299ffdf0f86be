"""Approximate nearest neighbours by multiprobe p-stable hashing.

Unit vectors are projected on random normal directions and cut into cells of one width; a table's
bucket is the tuple of cells of several directions. A query visits its own bucket and, in order of
estimated success (the sum of squared distances to the cell borders that a perturbation crosses),
the buckets around it. Everything met is ranked by the exact cosine of the original vectors.

Vectors that are equal are indexed once, with their few smallest ids: more than the wanted number
and the query's own can never be asked for. A bucket's vectors and the queries that visit it are
both dealt out in chunks of bounded size, and a task keeps only the best few of each query.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxloom.llm.common import arrow_rows, materialize, slices

TABLES, HASHES, WIDTH, PROBES = 4, 4, 1.0, 120
#: Vectors and queries that meet in one task at a time.
CHUNK = 4096


def usable(vec: Column) -> Column:
    """Neither null nor zero, with no null, NaN or infinite component."""
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vec.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(vec, lambda x: x != 0)


class Hashes:
    """The random directions and offsets of all tables."""

    def __init__(self, dim: int, tables: int, hashes: int, width: float, seed: int):
        rng = np.random.default_rng(seed)
        self.direction = rng.normal(size=(tables, dim, hashes))
        self.offset = rng.uniform(0, width, (tables, 1, hashes))
        self.width = width

    def cells(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each table and vector: cells, and places in them between 0 and 1."""
        x = (unit @ self.direction + self.offset) / self.width
        cell = np.floor(x)
        return cell.astype(np.int64), x - cell


def bucket_ids(cells: np.ndarray) -> np.ndarray:
    """A number for a tuple of cells (the last axis)."""
    out = np.zeros(cells.shape[:-1], np.int64)
    for k in range(cells.shape[-1]):
        out = out * 1_000_003 + cells[..., k]
    return out


def probes(cell: np.ndarray, place: np.ndarray, most: int) -> np.ndarray:
    """Cells of the ``most`` buckets likeliest to hold near vectors, the own bucket first."""
    n = len(cell)
    steps = sorted([(place[j] ** 2, j, -1) for j in range(n)] + [((1 - place[j]) ** 2, j, 1) for j in range(n)])
    out, heap = [cell], [(steps[0][0], (0,))]
    while heap and len(out) < most:
        cost, chosen = heapq.heappop(heap)
        if len({steps[s][1] for s in chosen}) == len(chosen):
            near = cell.copy()
            for s in chosen:
                near[steps[s][1]] += steps[s][2]
            out.append(near)
        last = chosen[-1]
        if last + 1 < len(steps):
            heapq.heappush(heap, (cost - steps[last][0] + steps[last + 1][0], (*chosen[:-1], last + 1)))
            heapq.heappush(heap, (cost + steps[last + 1][0], (*chosen, last + 1)))
    return np.stack(out)


def best(pairs: list[tuple[float, int]], most: int) -> list[tuple[float, int]]:
    """The ``most`` greatest by score, ties to the smaller id, each id once."""
    out, seen = [], set()
    for score, i in sorted(pairs, key=lambda x: (-x[0], x[1])):
        if i not in seen:
            seen.add(i)
            out.append((score, i))
            if len(out) == most:
                break
    return out


def merging(batches: Iterator[pa.RecordBatch], most: int, limit: int = 200_000) -> Iterator[pa.RecordBatch]:
    """Merge rows (query, ids, scores) that share a query; those held are sent on when there are many."""

    def out() -> pa.RecordBatch:
        rows = [(q, best(p, most)) for q, p in held.items()]
        return pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int64()), pa.array([[i for _, i in r[1]] for r in rows], pa.list_(pa.int64())), pa.array([[s for s, _ in r[1]] for r in rows], pa.list_(pa.float64()))],
            names=["query", "ids", "scores"],
        )

    held: dict[int, list[tuple[float, int]]] = {}
    for batch in batches:
        for q, ids, scores in zip(*(batch.column(n).to_pylist() for n in ("query", "ids", "scores")), strict=True):
            mine = held.setdefault(q, [])
            mine.extend(zip(scores, ids, strict=True))
            if len(mine) > 16 * most:
                held[q] = best(mine, most)
        if len(held) > limit:
            yield out()
            held = {}
    yield out()


def distinct_vectors(rows: DataFrame, most: int) -> DataFrame:
    """Of rows (vec_id, vec binary): each vector once, with the ``most`` smallest ids that it has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array([sorted(x)[:most] for x in held.values()], pa.list_(pa.int64()))], names=["vec", "ids"])

        held: dict[bytes, set[int]] = {}
        for batch in slices(batches, 4096):
            for vec, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                mine = held.setdefault(vec, set())
                mine.update(ids)
                if len(mine) > 64 * most:
                    held[vec] = set(sorted(mine)[:most])
            if len(held) > 50_000:
                yield out()
                held = {}
        yield out()

    once = rows.select("vec", F.array("vec_id").alias("ids")).mapInArrow(run, "vec binary, ids array<long>")
    met = once.groupBy("vec").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, most).alias("ids"))
    return met.withColumn("key", F.xxhash64("vec"))


def search_units(units: DataFrame, most: int) -> DataFrame:
    """Rows (table, bucket, i, j, asks, key, ids, vec) -> (query, ids, scores): the best few of each query and task."""

    def meet(group: pa.RecordBatch) -> pa.RecordBatch | None:
        asks = group.column("asks").to_numpy(zero_copy_only=False).astype(bool)
        if asks.all() or not asks.any():
            return None
        x = np.stack([np.frombuffer(v, "<f8") for v in group.column("vec").to_pylist()])
        norm = np.sqrt(np.einsum("ij,ij->i", x, x))
        ids = group.column("ids").to_pylist()
        there = np.nonzero(~asks)[0]
        query = group.column("key").to_numpy(zero_copy_only=False)[asks]
        cos = (x[asks] @ x[there].T) / (norm[asks][:, None] * norm[there][None])
        k = min(most, len(there))
        out_ids, out_scores = [], []
        low = np.partition(cos, len(there) - k, axis=1)[:, len(there) - k]
        for row, bound in zip(cos, low, strict=True):
            near = np.nonzero(row >= bound)[0]
            found = best([(float(row[n]), i) for n in near.tolist() for i in ids[there[n]]], most)
            out_ids.append([i for _, i in found])
            out_scores.append([s for s, _ in found])
        return pa.RecordBatch.from_arrays([pa.array(query, pa.int64()), pa.array(out_ids, pa.list_(pa.int64())), pa.array(out_scores, pa.list_(pa.float64()))], names=["query", "ids", "scores"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[pa.RecordBatch]:
            for group in by_unit(batches):
                if (said := meet(group)) is not None:
                    yield said

        yield from merging(found(), most)

    dealt = units.repartition("table", "bucket", "i", "j").sortWithinPartitions("table", "bucket", "i", "j", "asks")
    arrow_rows(units.sparkSession)
    return dealt.mapInArrow(run, "query long, ids array<long>, scores array<double>")


def by_unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows that follow one another with the same table, bucket and chunks, together."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        cols = [batch.column(n).to_numpy(zero_copy_only=False) for n in ("table", "bucket", "i", "j")]
        ends = np.nonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0))[0] + 1 if batch.num_rows > 1 else np.zeros(0, int)
        for a, b in zip([0, *ends.tolist()], [*ends.tolist(), batch.num_rows], strict=True):
            if a == b:
                continue
            key = tuple(c[a] for c in cols)
            if held and key != last:
                yield pa.concat_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield pa.concat_batches(held)


def nearest(
    table: DataFrame,
    asked: Callable[[Column], Column],
    k: int = 5,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    *,
    tables: int = TABLES,
    hashes: int = HASHES,
    width: float = WIDTH,
    probe: int = PROBES,
    chunk: int = CHUNK,
    seed: int = 7,
) -> DataFrame:
    """query_id, rank, vec_id and score: the ``k`` nearest found of each row whose id is ``asked`` for.

    Rows with a null id, and vectors that are null, zero or hold null or non-finite components, take
    no part; nor do vectors whose length is not the most frequent one. Rows that repeat with one id
    are one row, and never their own neighbours. Where the buckets visited hold fewer than ``k``
    others, the query is put to all vectors; so it gets ``k`` wherever there are as many. An empty
    table gives no row; other columns are not read.
    """
    spark, most = table.sparkSession, k + 1
    vec = F.col(f"`{vec_col}`").cast("array<double>")
    rows = table.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), vec.alias("vec")).filter(F.col("vec_id").isNotNull() & usable(F.col("vec")))
    lengths = rows.groupBy(F.size("vec").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").limit(1).collect()
    dim = lengths[0]["dim"] if lengths else 1
    rows = rows.filter(F.size("vec") == dim)

    def to_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = batch.column("vec")
            flat = np.ascontiguousarray(col.flatten().to_numpy(zero_copy_only=False), "<f8").reshape(-1, dim) + 0.0
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([v.tobytes() for v in flat], pa.binary())], names=["vec_id", "vec"])

    arrow_rows(spark)
    packed = rows.mapInArrow(to_bytes, "vec_id long, vec binary")
    asks = packed.filter(asked(F.col("vec_id"))).select("vec_id", F.xxhash64("vec").alias("key")).distinct()
    queries = materialize(asks, "queries")
    vectors = materialize(distinct_vectors(packed, most), "vectors")
    wanted = vectors.join(queries.select("key").distinct(), "key", "left_semi")
    maker = Hashes(dim, tables, hashes, width, seed)

    def hashed(batches: Iterator[pa.RecordBatch], most_probes: int) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1024):
            x = np.frombuffer(b"".join(batch.column("vec").to_pylist()), "<f8").reshape(-1, dim)
            cell, place = maker.cells(x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None])
            at = np.arange(len(x))
            for t in range(tables):
                if most_probes:
                    visits = [bucket_ids(probes(cell[t, i], place[t, i], most_probes)) for i in at]
                    rows_at, buckets = np.repeat(at, [len(v) for v in visits]), np.concatenate(visits) if len(at) else np.zeros(0, np.int64)
                else:
                    rows_at, buckets = at, bucket_ids(cell[t])
                keys = batch.column("key").take(pa.array(rows_at))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows_at), t, np.int32)), pa.array(buckets), keys], names=["table", "bucket", "key"])

    kinds = "table int, bucket long, key long"
    index = vectors.select("key", "vec").mapInArrow(lambda b: hashed(b, 0), kinds)
    visits = wanted.select("key", "vec").mapInArrow(lambda b: hashed(b, probe), kinds)
    found = search(index, visits, vectors, most, chunk)
    said = materialize(merge(found, most), "found")
    few = said.filter(F.size("ids") < most).select(F.col("query").alias("key"))
    none = wanted.select("key").join(said.select(F.col("query").alias("key")), "key", "left_anti")
    short = materialize(few.unionAll(none), "short")
    if not short.isEmpty():
        everywhere = [F.lit(-1).alias("table"), F.lit(0).cast("long").alias("bucket"), "key"]
        again = search(vectors.select(*everywhere), short.select(*everywhere), vectors, most, chunk)
        said = materialize(merge(again.unionAll(said), most), "found")
    out = queries.join(said, queries["key"] == said["query"]).select(F.col("vec_id").alias("query_id"), F.arrays_zip("ids", "scores").alias("near"))
    others = F.slice(F.filter("near", lambda x: x["ids"] != F.col("query_id")), 1, k)
    return out.select("query_id", F.posexplode(others).alias("pos", "hit")).select(
        "query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("hit.ids").alias("vec_id"), F.col("hit.scores").alias("score")
    )


def search(index: DataFrame, visits: DataFrame, vectors: DataFrame, most: int, chunk: int) -> DataFrame:
    """Let vectors of ``index`` and queries of ``visits`` (table, bucket, key) meet, both in chunks of bounded size."""
    at = ["table", "bucket"]
    held = index.groupBy(*at).agg(F.count("*").alias("n_there"))
    come = visits.groupBy(*at).agg(F.count("*").alias("n_ask"))
    parts = held.join(come, at).select(*at, F.ceil(F.col("n_there") / chunk).cast("int").alias("ni"), F.ceil(F.col("n_ask") / chunk).cast("int").alias("nj"))
    parts = materialize(parts, "parts")
    spread = lambda n: F.pmod(F.hash("key"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    there = index.join(parts, at).withColumn("i", spread("ni")).withColumn("j", every("nj")).withColumn("asks", F.lit(False))
    ask = visits.join(parts, at).withColumn("j", spread("nj")).withColumn("i", every("ni")).withColumn("asks", F.lit(True))
    cols = [*at, "i", "j", "asks", "key"]
    both = there.select(*cols).unionAll(ask.select(*cols))
    return search_units(both.join(vectors, "key").select(*cols, "ids", "vec"), most)


def merge(found: DataFrame, most: int) -> DataFrame:
    return found.repartition("query").mapInArrow(lambda b: merging(b, most, 1 << 62), "query long, ids array<long>, scores array<double>")
