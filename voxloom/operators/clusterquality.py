"""Intrinsic scores of a clustering: silhouette, Davies-Bouldin and Calinski-Harabasz.

Rows are (id, vec, label). Centroid scores are sums by cluster and dimension. The exact silhouette
needs all pairwise distances, which blocks of rows meet for; for large inputs use the centroid
scores, or pyspark.ml's squared Euclidean silhouette under its own name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a block, two of which one task holds, and least number of blocks.
BLOCK, LEAST_BLOCKS = 16_384, 4
#: Distances, and pairs of vectors, that a task holds at a time.
CELLS, STEP = 1 << 21, 1 << 15


def cells(rows: DataFrame) -> DataFrame:
    return rows.select("id", "label", F.posexplode("vec").alias("dim", "x")).withColumn("x", F.col("x").cast("double"))


def centroids(rows: DataFrame) -> DataFrame:
    return cells(rows).groupBy("label", "dim").agg(F.avg("x").alias("c"), F.count("*").alias("n"))


def calinski_harabasz(rows: DataFrame) -> DataFrame:
    """Between-cluster over within-cluster variance, each by its degrees of freedom."""
    c = cells(rows)
    mid, overall = centroids(rows), c.groupBy("dim").agg(F.avg("x").alias("g"))
    within = c.join(mid, ["label", "dim"]).agg(F.sum((F.col("x") - F.col("c")) * (F.col("x") - F.col("c"))).alias("w"))
    between = mid.join(overall, "dim").agg(F.sum(F.col("n") * (F.col("c") - F.col("g")) * (F.col("c") - F.col("g"))).alias("b"))
    size = rows.agg(F.count("*").alias("n_rows"), F.countDistinct("label").alias("k"))
    return size.crossJoin(within).crossJoin(between).select(F.try_divide(F.col("b") * (F.col("n_rows") - F.col("k")), F.col("w") * (F.col("k") - 1)).alias("calinski_harabasz"))  # one row each


def davies_bouldin(rows: DataFrame) -> DataFrame:
    """Mean over clusters of the worst ratio of summed spreads to centroid distance."""
    mid = centroids(rows)
    spread = cells(rows).join(mid, ["label", "dim"]).groupBy("label", "id").agg(F.sqrt(F.sum((F.col("x") - F.col("c")) * (F.col("x") - F.col("c")))).alias("d"))
    spread = spread.groupBy("label").agg(F.avg("d").alias("s"))
    other = mid.select(F.col("label").alias("l2"), "dim", F.col("c").alias("c2"))
    far = mid.join(other, "dim").filter("label <> l2").groupBy("label", "l2").agg(F.sqrt(F.sum((F.col("c") - F.col("c2")) * (F.col("c") - F.col("c2")))).alias("m"))
    ratio = far.join(spread, "label").join(spread.select(F.col("label").alias("l2"), F.col("s").alias("s2")), "l2")
    worst = ratio.groupBy("label").agg(F.max(F.try_divide(F.col("s") + F.col("s2"), F.col("m"))).alias("r"))
    return worst.agg(F.avg("r").alias("davies_bouldin"))


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of rows; those in which the sum of squares loses its digits come from differences."""
    with np.errstate(invalid="ignore", over="ignore"):
        size = (a**2).sum(axis=1)[:, None] + (b**2).sum(axis=1)
        out = a @ b.T
        out *= -2
        out += size
        size *= 1e-9
        i, j = np.nonzero(~(out > size))
        for at in range(0, len(i), STEP):
            p, q = i[at : at + STEP], j[at : at + STEP]
            out[p, q] = ((a[p] - b[q]) ** 2).sum(axis=1)
        return np.sqrt(out, out=out)


def block_sums(table: pa.Table) -> pa.Table:
    """(id, label, l2, d, n) of two blocks of rows (i, j, own, id, label, vec): for each row of one block the sum of
    its distances to the rows with label l2 of the other (null if there are none) and their number."""
    table = table.combine_chunks()
    first, second = table.column("i")[0].as_py(), table.column("j")[0].as_py()
    own, labels = table.column("own").to_numpy(), pc.unique(table.column("label"))
    code = pc.index_in(table.column("label"), value_set=labels).to_numpy()
    vec = table.column("vec").combine_chunks()
    length = pc.fill_null(pc.list_value_length(vec), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    holes = pc.is_null(vec.flatten()).to_numpy(zero_copy_only=False)
    begin = np.append(0, np.cumsum(np.maximum(length, 0)))
    gaps = np.append(0, np.cumsum(holes))
    length[gaps[begin[1:]] > gaps[begin[:-1]]] = -1  # a null component has no distance
    flat = vec.flatten().to_numpy(zero_copy_only=False).astype(float)
    d, seen, n = (np.zeros((len(own), len(labels)), t) for t in (float, np.int64, np.int64))
    for block, other in {(first, second), (second, first)}:
        n[own == block] += np.bincount(code[own == other], minlength=len(labels))
    for size in np.unique(length[length >= 0]):
        with np.errstate(invalid="ignore", over="ignore"):
            rows = np.nonzero(length == size)[0]
            x = flat[begin[rows][:, None] + np.arange(size)]
            whole = np.isfinite(x).all(axis=1)
            x -= x[whole].mean(axis=0) if whole.any() else 0.0
        left, right = (np.nonzero(own[rows] == block)[0] for block in (first, second))
        left, right = (k[np.argsort(code[rows[k]], kind="stable")] for k in (left, right))
        if not len(left) or not len(right):
            continue
        here, starts = np.unique(code[rows[right]], return_index=True)
        seen[np.ix_(rows[left], here)] += np.diff(np.append(starts, len(right)))
        if first != second:
            seen[rows[right]] += np.bincount(code[rows[left]], minlength=len(labels))
        for label in np.unique(code[rows[left]]):
            of = left[code[rows[left]] == label]
            step = max(1, CELLS // len(right))
            for at in range(0, len(of), step):
                k = of[at : at + step]
                far = distances(x[k], x[right])
                d[np.ix_(rows[k], here)] += np.add.reduceat(far, starts, axis=1)
                if first != second:
                    d[rows[right], label] += far.sum(axis=0)
    at, l2 = np.nonzero(n)
    sums = pa.array(d[at, l2], mask=seen[at, l2] == 0)
    columns = [table.column("id").take(pa.array(at)), table.column("label").take(pa.array(at)), labels.take(pa.array(l2)), sums, pa.array(n[at, l2])]
    return pa.table(columns, names=["id", "label", "l2", "d", "n"])


def silhouette(rows: DataFrame) -> DataFrame:
    """Mean of (b - a) / max(a, b) with Euclidean distances; 0 for the only member of a cluster, or without a label.

    Rows are dealt out as pairs of blocks, each of which one task compares; what leaves it is a row for each row and label.
    """
    rows = rows.select("id", "label", "vec")
    told = rows.filter("label IS NOT NULL")
    blocks = max(LEAST_BLOCKS, -(-told.count() // BLOCK))
    dealt = told.withColumn("own", F.pmod(F.xxhash64("id", "vec"), F.lit(blocks)).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    dealt = dealt.select(F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "id", "label", "vec")
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    met = dealt.groupBy("i", "j").applyInArrow(block_sums, f"id {kinds['id']}, label {kinds['label']}, l2 {kinds['label']}, d double, n long")
    sums = met.groupBy("id", "label", "l2").agg(F.sum("d").alias("d"), F.sum("n").alias("n"))
    mean = F.when(F.col("label") == F.col("l2"), F.try_divide(F.col("d"), F.col("n") - 1)).otherwise(F.col("d") / F.col("n"))
    each = sums.groupBy("id", "label").agg(
        F.max(F.when(F.col("label") == F.col("l2"), mean)).alias("a"), F.min(F.when(F.col("label") != F.col("l2"), mean)).alias("b")
    )
    value = F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.when(F.greatest("a", "b") > 0, F.greatest("a", "b"))), F.lit(0.0))
    scores = each.select(F.when(F.col("a").isNull(), 0.0).otherwise(value).alias("s"))
    untold = rows.filter("label IS NULL").select("id").distinct().select(F.lit(0.0).alias("s"))
    return scores.unionAll(untold).agg(F.avg("s").alias("silhouette"))


def intrinsic_metrics(rows: DataFrame, exact_silhouette: bool = True) -> DataFrame:
    """All scores with a status: empty_input, insufficient_cluster_structure (fewer than 2 clusters, or one a row) or ok."""
    size = rows.agg(F.count("*").alias("n"), F.countDistinct("label").alias("k"))
    status = F.when(F.col("n") == 0, "empty_input").when((F.col("k") < 2) | (F.col("k") >= F.col("n")), "insufficient_cluster_structure").otherwise("ok")
    out = size.withColumn("status", status).crossJoin(calinski_harabasz(rows)).crossJoin(davies_bouldin(rows))
    names = ["davies_bouldin", "calinski_harabasz"]
    if exact_silhouette:
        out, names = out.crossJoin(silhouette(rows)), ["silhouette", *names]
    return out.select("n", "k", "status", *(F.when(F.col("status") == "ok", F.col(c)).alias(c) for c in names))
