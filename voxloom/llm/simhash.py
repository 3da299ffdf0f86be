"""Near-duplicates by SimHash fingerprints and the generalised pigeonhole principle.

Fingerprints of all texts are reduced to the distinct ones. Their 64 bits are grouped into
partitions so that correlated bits stand together. If two fingerprints differ in at most ``k`` bits
and the partitions' thresholds sum up to ``k - parts + 1``, then in some partition they differ in no
more than its threshold. A dynamic program picks number of parts and thresholds (-1 leaves a
partition out) for the least estimated number of probes and candidates at the corpus's size. Each
fingerprint is entered under its partitions' keys and those within the threshold, all that meet
under a key are compared exactly, and only a spanning forest of the links of each group leaves it.
A large group is dealt out as pairs of blocks, none of which is more than one task can hold.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxloom.llm.common import Scratch, arrow_rows, as_bytes, materialize, slices
from voxloom.llm.graph import components

BITS, SEED = 64, 42
#: A group of g fingerprints is compared in blocks of BLOCK times the root of g.
BLOCK = 16
#: Costs of a probe (a row that is written, sorted and read) and of a comparison (a few machine operations in an array).
PROBE_COST, PAIR_COST = 1000.0, 1.0


def majority(hashes: np.ndarray) -> bytes:
    """The bits (little-endian) that are set in over half of the hashes (rows of unsigned longs)."""
    rows = hashes.reshape(len(hashes), -1).astype("<u8").view(np.uint8)
    ones = np.zeros(8 * rows.shape[1], np.int64)
    for at in range(0, len(rows), 8192):
        ones += np.unpackbits(rows[at : at + 8192], axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(rows), bitorder="little").tobytes()


def shingle_hashes(words: list[bytes], width: int, seed: int = SEED) -> np.ndarray:
    """Hashes of the windows of ``width`` words, repeats included; of all words if there are fewer; none without words."""
    from xxhash import xxh64_intdigest

    if not words:
        return np.zeros(0, np.uint64)
    joined, n = b" ".join(words), max(len(words) - width + 1, 1)
    if n == 1:
        return np.array([xxh64_intdigest(joined, seed)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    first, last = [0, *(ends[: n - 1] + 1).tolist()], ends[width - 1 :].tolist()
    return np.fromiter(map(xxh64_intdigest, [joined[a:b] for a, b in zip(first, last, strict=True)], repeat(seed)), np.uint64, n)


def fingerprint(text: bytes, width: int = 3, seed: int = SEED) -> int:
    """64 majority bits over the hashes of all word shingles of a text; 0 where there is no word."""
    hashes = shingle_hashes(text.lower().split(), width, seed)
    return int.from_bytes(majority(hashes), "little") if len(hashes) else 0


def fingerprints(docs: DataFrame, text_col: str, keep: list[str], names: list[str], width: int = 3) -> DataFrame:
    """The columns ``keep`` as ``names``, and ``fp``, the fingerprint as a signed long."""
    rows = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in zip(keep, names, strict=True)), F.col(f"`{text_col}`").cast("string").alias("body"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = as_bytes(batch.column(len(names)))
            fps = np.fromiter((fingerprint(t, width) for t in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(fps.view(np.int64))], names=[*names, "fp"])

    arrow_rows(docs.sparkSession)
    return rows.mapInArrow(run, f"{fields}, fp long")


# ---- partitions and thresholds -----------------------------------------------------------------


def bit_counts(fps: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints, and how many have bits i and j both, over all of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((BITS, BITS), np.int64), 0
        for batch in slices(batches, 65536):
            x = batch.column(0).to_numpy(zero_copy_only=False).astype("<i8").view(np.uint8).reshape(-1, 8)
            bits = np.unpackbits(x, axis=1, bitorder="little").astype(np.float32)
            total += (bits.T @ bits).astype(np.int64)
            n += len(x)
        yield pa.RecordBatch.from_arrays([pa.array(range(BITS * BITS + 1), pa.int64()), pa.array([*total.ravel().tolist(), n], pa.int64())], names=["at", "n"])

    rows = fps.select("fp").mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()  # 4097 rows
    found = np.zeros(BITS * BITS + 1, np.int64)
    for r in rows:
        found[r["at"]] = r["n"]
    return int(found[-1]), found[:-1].reshape(BITS, BITS)


def group_bits(n: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """Bits in ``parts`` groups of nearly equal size; the bit most correlated with a group joins it first."""
    p = both.diagonal() / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    like = np.abs(both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread)
    np.fill_diagonal(like, 0)
    free, out = set(range(BITS)), []
    for k in range(parts):
        size = len(free) // (parts - k)
        first = max(sorted(free), key=lambda b: like[b, sorted(free)].sum())
        group = [first]
        free.discard(first)
        while len(group) < size:
            best = max(sorted(free), key=lambda b: like[b, group].sum())
            group.append(best)
            free.discard(best)
        out.append(sorted(group))
    return out


def estimate(n: int, both: np.ndarray, group: list[int], most: int) -> list[float]:
    """Cost of a partition at thresholds -1, 0, 1, ...: pairs expected to meet, and probes, each a row for every block of its group."""
    p = both.diagonal() / max(n, 1)
    differ = np.zeros(most + 1)
    differ[0] = 1.0
    for b in group:
        q = 2 * p[b] * (1 - p[b])
        differ[1:] = differ[1:] * (1 - q) + differ[:-1] * q
        differ[0] *= 1 - q
    costs, near, keys = [0.0], 0.0, 0
    for t in range(most + 1):
        near += differ[t]
        keys += len(list(combinations(range(len(group)), t))) if t < 3 else len(group) ** t
        blocks = max(1.0, np.sqrt(near * n) / BLOCK)
        costs.append(PROBE_COST * n * keys * blocks + PAIR_COST * near * n * n / 2)
    return costs


def allot(costs: list[list[float]], total: int) -> tuple[float, list[int]]:
    """Thresholds (-1 upwards) that sum up to ``total`` at least cost, by dynamic programming."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for cost in costs:
        more: dict[int, tuple[float, list[int]]] = {}
        for used, (c, chosen) in best.items():
            for t in range(-1, len(cost) - 1):
                x = (c + cost[t + 1], [*chosen, t])
                if used + t not in more or x < more[used + t]:
                    more[used + t] = x
        best = more
    return best[total]


def plan(n: int, both: np.ndarray, k: int) -> list[tuple[list[int], int]]:
    """(bits, threshold) of the partitions that are probed."""
    options, n = [], max(n, 2)
    for parts in range(1, k + 3):
        groups = group_bits(n, both, parts)
        cost, chosen = allot([estimate(n, both, g, k) for g in groups], k - parts + 1)
        options.append((cost, parts, [(g, t) for g, t in zip(groups, chosen, strict=True) if t >= 0]))
    return min(options, key=lambda x: x[:2])[2]


# ---- links ---------------------------------------------------------------------------------------


def forest(fps: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links: places of each node but a root, and of its root."""
    n = len(fps)
    root = np.arange(n)
    step = max(1, (1 << 22) // max(n, 1))
    for at in range(0, n, step):
        near = np.bitwise_count(fps[at : at + step, None] ^ fps[None, at:]) <= k
        i, j = np.nonzero(near)
        i, j = i + at, j + at
        i, j = root[i], root[j]
        while (open_ := i != j).any():  # hook the larger root to the smaller one, then follow to the end
            i, j = i[open_], j[open_]
            np.minimum.at(root, np.maximum(i, j), np.minimum(i, j))
            while ((up := root[root]) != root).any():
                root = up
            i, j = root[i], root[j]
    node = np.nonzero(root != np.arange(n))[0]
    return node, root[node]


def bit_mask(bits: list[int]) -> int:
    x = sum(1 << b for b in bits)
    return x - (1 << 64) if x >> 63 else x


def keys(fp: Column, parts: list[tuple[list[int], int]]) -> Column:
    """All (part, key) under which a fingerprint is entered."""
    out = []
    for p, (bits, threshold) in enumerate(parts):
        key = fp.bitwiseAND(F.lit(bit_mask(bits)))
        for t in range(threshold + 1):
            for flip in combinations(bits, t):
                out.append(F.struct(F.lit(p).alias("part"), (key.bitwiseXOR(F.lit(bit_mask(list(flip)))) if flip else key).alias("key")))
    return F.array(*out)


def links(rows: DataFrame, parts: list[tuple[list[int], int]], k: int, scratch: Scratch | None = None) -> DataFrame:
    """Edges (a, b) that join the nodes of linked rows into the right components.

    ``rows`` has node (distinct longs) and fp.
    """
    scratch = scratch or Scratch(rows.sparkSession)
    entered = rows.select("node", "fp", F.explode(keys(F.col("fp"), parts)).alias("at")).select("node", "fp", "at.*")
    sizes = rows.select(F.explode(keys(F.col("fp"), parts)).alias("at")).select("at.*").groupBy("part", "key").agg(F.count("*").alias("n"))
    sizes = scratch.table(sizes.filter("n > 1"), "groups")
    blocks = F.ceil(F.sqrt("n") / BLOCK).cast("int")
    met = entered.join(sizes, ["part", "key"]).withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select("node", "fp", "part", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    dealt = met.repartition("part", "key", "i", "j").sortWithinPartitions("part", "key", "i", "j", "node")
    group = ["part", "key", "i", "j"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def compare(cols: dict[str, np.ndarray]) -> pa.RecordBatch:
            change = np.any([cols[c][1:] != cols[c][:-1] for c in group], axis=0)
            ends = np.append(np.nonzero(change)[0] + 1, len(change) + 1)
            begins, fp, node = np.append(0, ends[:-1]), cols["fp"].view(np.uint64), cols["node"]
            pairs = begins[ends - begins == 2]
            near = pairs[np.bitwise_count(fp[pairs] ^ fp[pairs + 1]) <= k]
            a, b = [node[near]], [node[near + 1]]
            for x, y in zip(begins, ends, strict=True):
                if y - x > 2:
                    child, root = forest(fp[x:y], k)
                    a.append(node[x:y][child])
                    b.append(node[x:y][root])
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

        for cols in whole_groups(batches, group):
            yield compare(cols)

    arrow_rows(rows.sparkSession)
    return dealt.mapInArrow(run, "a long, b long").filter("a <> b")


def whole_groups(batches: Iterator[pa.RecordBatch], group: list[str]) -> Iterator[dict[str, np.ndarray]]:
    """Columns of sorted rows, cut where the columns ``group`` change, so that no group is parted."""
    held: dict[str, np.ndarray] | None = None
    for batch in batches:
        cols = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in batch.schema.names}
        if held is not None:
            cols = {c: np.concatenate([held[c], x]) for c, x in cols.items()}
        n = batch.num_rows and len(cols[group[0]])
        if not n:
            continue
        same = np.all([cols[c] == cols[c][-1] for c in group], axis=0)
        start = 0 if same.all() else n - int(np.argmin(same[::-1]))
        if start:
            yield {c: x[:start] for c, x in cols.items()}
        held = {c: x[start:] for c, x in cols.items()}
    if held is not None and len(held[group[0]]):
        yield held


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, k: int = 2, width: int = 3) -> DataFrame:
    """doc_id, fingerprint and component_id of every row.

    Null, empty and blank texts have fingerprint 0 and link like any other. Texts of fewer words
    than ``width`` are one shingle. Rows that repeat are in one component. A component's id is its
    smallest id; rows with a null id take part but name a component only if all its ids are null.
    An empty table gives no row; other columns are not read.
    """
    found = materialize(fingerprints(docs, text_col, [id_col], ["doc_id"], width), "fingerprints")
    with Scratch(docs.sparkSession) as scratch:
        fps = scratch.table(found.groupBy("fp").agg(F.min("doc_id").alias("low")), "distinct")
        named = component_of(fps, k, scratch)
    return found.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("low").alias("component_id"))


def component_of(fps: DataFrame, k: int, scratch: Scratch) -> DataFrame:
    """(fp, low): for each distinct fingerprint the least ``low`` of its component."""
    rows = fps.select(F.col("fp").alias("node"), "fp")
    n, both = bit_counts(rows)
    linked = components(links(rows, plan(n, both, k), k, scratch), scratch).withColumnsRenamed({"node": "fp"})
    lows = linked.join(fps, "fp").groupBy("root").agg(F.min("low").alias("least"))
    moved = linked.join(lows, "root").select("fp", "least")
    both = fps.join(moved, "fp", "left").withColumn("low", F.coalesce("least", "low")).select("fp", "low")
    return materialize(both, "classes")


# ---- similar texts ---------------------------------------------------------------------------------
#
# Fingerprints of texts that are similar by 0.8 differ in some 10 of 64 bits: a pigeonhole over bits
# that finds all of these has to compare nearly all pairs. So fingerprints find the near copies, in
# large groups too, and a pigeonhole over the shingles themselves finds every other similar pair: in
# any one order of all shingles, similar texts have one in common among the first of each.

#: Bits in which fingerprints of the first candidates differ at most.
NEAR_BITS = 3
#: Texts under one shingle beyond that number first meet by way of one of them, for LEADS rounds.
GROUP, LEADS = 256, 3
#: Counters (a power of two) of the sketch that puts shingles in order, bits of a bitmap of nodes, and how many of either a row holds.
COUNTERS, PLACES, SEGMENT = 1 << 22, 1 << 24, 1 << 16
#: Shingles more than one that two texts must share among their first, where their sizes allow to ask for as many.
SPARE = 7
#: From a table of nodes to their texts' distinct shingles (node, shingles, size).
Sets = Callable[[DataFrame], DataFrame]
#: From classes (node, root) that are known to the shingles (key, node, root, place, size) that texts are entered under.
Entries = Callable[[DataFrame], DataFrame]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of unsigned longs that spreads all bits."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def distinct_shingles(texts: list[bytes], width: int) -> list[np.ndarray]:
    return [np.unique(shingle_hashes(t.lower().split(), width)) for t in texts]


def mark_of(shingles: np.ndarray) -> bytes:
    """The parities of how many distinct shingles fall to each of m places, m a power of two not below their number.

    The marks of two texts, XORed, are the mark of what only one of them has, so the bits set are no more than that.
    """
    m = max(64, 1 << (max(len(shingles), 1) - 1).bit_length())
    return np.packbits(np.bincount((shingles & np.uint64(m - 1)).astype(np.int64), minlength=m) & 1, bitorder="little").tobytes()


def may_be_similar(a: bytes, b: bytes, size: int, similarity: float) -> bool:
    """False only for marks of texts (of ``size`` distinct shingles in all) that are not similar; the longer mark is folded."""
    if len(a) < len(b):
        a, b = b, a
    x, y, half = int.from_bytes(a, "little"), int.from_bytes(b, "little"), 4 * len(a)
    while half >= 8 * len(b):
        x, half = (x >> half) ^ (x & ((1 << half) - 1)), half // 2
    return (x ^ y).bit_count() <= size * (1 - similarity) / (1 + similarity) + 1e-6


def counter_of(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(64 - COUNTERS.bit_length() + 1)).astype(np.int64)


def gathered(rows: DataFrame, places: int, kind: str, join: np.ufunc, enter: Callable[[np.ndarray, pa.RecordBatch], None], done: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """``places`` numbers of type ``kind`` that all rows are entered in, after ``done``, which keeps their order.

    A task enters its rows in an array and sends segments of it, which are joined one row after
    another. The result has the same size whatever the corpus.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(places, kind)
        for batch in slices(batches):
            enter(total, batch)
        for at in range(0, places, SEGMENT):
            part = total[at : at + SEGMENT]
            if part.any():
                data = pa.compress(part.tobytes(), codec="zstd", asbytes=True)
                yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([data], pa.binary())], names=["at", "data"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for at, data in zip(*(batch.column(c).to_pylist() for c in ("at", "data")), strict=True):
                part = np.frombuffer(pa.decompress(data, np.dtype(kind).itemsize * SEGMENT, codec="zstd", asbytes=True), kind)
                total[at] = join(total[at], part) if at in total else part
        for at, part in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([done(part).tobytes()], pa.binary())], names=["at", "data"])

    arrow_rows(rows.sparkSession)
    parts = rows.mapInArrow(count, "at int, data binary")
    out = [done(np.zeros(SEGMENT, kind))] * (places // SEGMENT)
    for r in parts.repartition("at").mapInArrow(add, "at int, data binary").collect():  # places / SEGMENT rows
        out[r["at"] // SEGMENT] = np.frombuffer(r["data"], out[0].dtype)
    return np.concatenate(out)


def levels(bodies: DataFrame, width: int, without: Broadcast | None = None) -> np.ndarray:
    """For each counter 256 times the binary logarithm of how many shingles of all texts (node, body) fall to it.

    Nodes in the bitmap ``without`` are left out. Shingles that are far more frequent than a
    counter's usual load stand out, and only the speed depends on which do.
    """

    def enter(total: np.ndarray, batch: pa.RecordBatch) -> None:
        batch = batch if without is None else batch.filter(pa.array(~is_in(without.value, batch.column(0))))
        sets = distinct_shingles(as_bytes(batch.column(1)), width)
        np.add.at(total, counter_of(np.concatenate([np.zeros(0, np.uint64), *sets])), 1)

    return gathered(bodies.select("node", "body"), COUNTERS, "<i8", np.add, enter, lambda x: (256 * np.log2(1.0 + x)).astype("<u2"))


def bitmap(nodes: DataFrame) -> Broadcast:
    """A bit for each of PLACES places, set where a node falls to it: 2 MB, broadcast.

    Rows with other nodes need not be moved to a join with ``nodes``; the fuller the bitmap, the more are moved in vain.
    """

    def enter(total: np.ndarray, batch: pa.RecordBatch) -> None:
        total[place_of(batch.column(0))] = 1

    bits = gathered(nodes.select("node"), PLACES, "u1", np.maximum, enter, lambda x: np.packbits(x, bitorder="little"))
    return nodes.sparkSession.sparkContext.broadcast(bits)


def place_of(nodes: pa.Array) -> np.ndarray:
    return (mixed(nodes.to_numpy(zero_copy_only=False).view(np.uint64)) >> np.uint64(64 - PLACES.bit_length() + 1)).astype(np.int64)


def is_in(bits: np.ndarray, nodes: pa.Array) -> np.ndarray:
    """False only for nodes that are not in the bitmap's table."""
    at = place_of(nodes)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def parted(rows: DataFrame, bits: Broadcast, inside: bool) -> DataFrame:
    """Those rows whose ``row`` is in the bitmap, or those whose is not."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(is_in(bits.value, batch.column(batch.schema.names.index("row"))) == inside))

    arrow_rows(rows.sparkSession)
    return rows.mapInArrow(run, rows.schema)


def near_at_hand(bodies: DataFrame, bits: Broadcast) -> DataFrame:
    """(node, body) of the bodies that are in the bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(is_in(bits.value, batch.column(0))))

    arrow_rows(bodies.sparkSession)
    return bodies.select("node", "body").mapInArrow(run, "node long, body string")


def first_shingles(shingles: np.ndarray, level: np.ndarray, similarity: float) -> np.ndarray:
    """Those of a text's distinct shingles, rare ones first, that it must be entered under.

    Of n shingles a similar text has ``similarity * n`` at least, so it cannot miss all of the first
    n - ceil(similarity * n) + 1. Both texts take theirs in the same order, so the first shingle that
    they have in common is among these of each.
    """
    order = np.lexsort((mixed(shingles), level[counter_of(shingles)]))
    return shingles[order[: len(order) - int(np.ceil(similarity * len(order) - 1e-6)) + 1]]


def signed_texts(docs: DataFrame, text_col: str, keep: list[str], names: list[str], width: int) -> DataFrame:
    """The columns ``keep`` as ``names``, two hashes of the words in order, and of the distinct shingles the fingerprint, number and mark."""
    from xxhash import xxh3_64_intdigest, xxh64_intdigest

    rows = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in zip(keep, names, strict=True)), F.col(f"`{text_col}`").cast("string").alias("body"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found: list[tuple[int, int, int]] = []
            sizes, marks = [], []
            for text in as_bytes(batch.column(len(names))):
                words = text.lower().split()
                joined, shingles = b" ".join(words), np.unique(shingle_hashes(words, width))
                found.append((xxh3_64_intdigest(joined), xxh64_intdigest(joined, SEED), int.from_bytes(majority(shingles), "little") if len(shingles) else 0))
                sizes.append(len(shingles))
                marks.append(mark_of(shingles))
            hashes = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in zip(*found, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], *hashes, pa.array(sizes, pa.int32()), pa.array(marks, pa.binary())], names=[*names, "whole", "other", "fp", "size", "mark"])

    arrow_rows(docs.sparkSession)
    return rows.mapInArrow(run, f"{fields}, whole long, other long, fp long, size int, mark binary")


def shingle_sets(rows: DataFrame, width: int, bits: Broadcast) -> DataFrame:
    """(node, body) -> (node, shingles, size): the distinct shingle hashes of each text that is in the bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices([whole.filter(pa.array(is_in(bits.value, whole.column(0))))], 64):
                sets = distinct_shingles(as_bytes(batch.column(1)), width)
                cols = [batch.column(0), pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64())), pa.array([len(x) for x in sets], pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, names=["node", "shingles", "size"])

    arrow_rows(rows.sparkSession)
    return rows.select("node", "body").mapInArrow(run, "node long, shingles array<long>, size long")


def entered(rows: DataFrame, level: Broadcast, width: int, similarity: float, without: Broadcast | None = None) -> DataFrame:
    """(key, node, root, place, size): the shingles that texts (node, root, body) are entered under, but for nodes in a bitmap.

    ``place`` (from 1) is the shingle's among all of the text in their order, ``size`` their number.
    """
    names = ["key", "node", "root", "place", "size"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            left = whole if without is None else whole.filter(pa.array(~is_in(without.value, whole.column(0))))
            for batch in slices([left]):
                sets = distinct_shingles(as_bytes(batch.column(2)), width)
                found = [first_shingles(x, level.value, similarity) if len(x) else x for x in sets]
                many = np.array([len(x) for x in found], np.int64)
                node, root = (np.repeat(batch.column(c).to_numpy(zero_copy_only=False), many) for c in (0, 1))
                size = np.repeat(np.array([len(x) for x in sets], np.int32), many)
                place = np.concatenate([np.arange(1, n + 1, dtype=np.int32) for n in many])
                key = np.concatenate(found).view(np.int64)
                for at in range(0, len(key), 1 << 16):
                    yield pa.RecordBatch.from_arrays([pa.array(x[at : at + (1 << 16)]) for x in (key, node, root, place, size)], names=names)

    arrow_rows(rows.sparkSession)
    return rows.select("node", "root", "body").mapInArrow(run, "key long, node long, root long, place int, size int")


def text_entries(bodies: DataFrame, others: DataFrame, linked: DataFrame, level: Broadcast, width: int, similarity: float) -> DataFrame:
    """Entries of all texts (node, body) but ``others`` (node), with their roots in ``linked`` (node, root).

    Texts that are in neither table, as most are, are entered where they are read; only those of the
    others that may be in one are moved to a join.
    """
    known = linked.select("node", "root").unionAll(others.select("node", F.lit(None).cast("long").alias("root"))).withColumn("known", F.lit(True))
    bits = bitmap(known)
    joined = near_at_hand(bodies, bits).join(known, "node", "left").filter("known IS NULL OR root IS NOT NULL")
    most = entered(bodies.select("node", F.col("node").alias("root"), "body"), level, width, similarity, bits)
    return most.unionAll(entered(joined.select("node", F.coalesce("root", "node").alias("root"), "body"), level, width, similarity))


def met_texts(entries: DataFrame, similarity: float) -> DataFrame:
    """What meets under a key: pairs (a, b, need, first) of texts with different roots, and entries (key, node, place, size)
    of keys of more than GROUP entries, the columns of the other kind being null.

    Texts of sizes m and n that are similar share o = similarity / (1 + similarity) * (m + n) shingles
    at least. So of the first m - o + 1 + s of one and n - o + 1 + s of the other they share ``need``
    = 1 + s at least, and the first that they share is among the first m - o + 1 and n - o + 1: it
    is marked ``first``. Texts are entered under enough shingles for s up to SPARE unless their sizes
    differ much. One shuffle of the entries; a task holds GROUP entries and a batch at a time.
    """
    most = GROUP
    names, fields = ["key", "node", "root", "place", "size"], "key long, node long, place int, size int, a long, b long, need int, first boolean"
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.bool_()]
    out = [x.split()[0] for x in fields.split(", ")]

    def rows_of(n: int, cols: dict[str, np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(cols[c], k) if c in cols else pa.nulls(n, k) for c, k in zip(out, kinds, strict=True)], names=out)

    def large(cols: dict[str, np.ndarray]) -> pa.RecordBatch:
        return rows_of(len(cols["key"]), {c: cols[c] for c in ("key", "node", "place", "size")})

    def pairs(cols: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        key, node, root, size = (cols[c] for c in ("key", "node", "root", "size"))
        size = size.astype(np.int64)
        left, i, d = size - cols["place"] + 1, np.arange(len(key) - 1), 1
        while True:
            i = i[i + d < len(key)]
            i = i[key[i] == key[i + d]]
            if not len(i):
                return
            j = i + d
            least = np.ceil((size[i] + size[j]) * (similarity / (1 + similarity)) - 1e-6).astype(np.int64)
            spare = np.clip(least - np.ceil(similarity * np.maximum(size[i], size[j]) - 1e-6).astype(np.int64), 0, SPARE)
            both = np.minimum(left[i], left[j])
            ok = (root[i] != root[j]) & (np.minimum(size[i], size[j]) >= least) & (both >= least - spare)
            if ok.any():
                a, b = node[i[ok]], node[j[ok]]
                yield rows_of(len(a), {"a": np.minimum(a, b), "b": np.maximum(a, b), "need": (1 + spare[ok]).astype(np.int32), "first": both[ok] >= least[ok]})
            d += 1

    def meet(cols: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        key = cols["key"]
        begins = np.append(0, np.nonzero(key[1:] != key[:-1])[0] + 1)
        n = np.diff(np.append(begins, len(key)))
        n = np.repeat(n, n)
        if (n > most).any():
            yield large({c: x[n > most] for c, x in cols.items()})
        some = (n > 1) & (n <= most)
        if some.any():
            yield from pairs({c: x[some] for c, x in cols.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] | None = None
        sent: int | None = None  # a key of which more than GROUP entries have been sent
        for batch in batches:
            cols = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in names}
            if held is not None:
                cols = {c: np.concatenate([held[c], x]) for c, x in cols.items()}
            held = cols
            if sent is not None and len(cols["key"]):
                same = cols["key"] == sent
                if same.any():
                    yield large({c: x[same] for c, x in cols.items()})
                held = cols = {c: x[~same] for c, x in cols.items()}
            if not len(cols["key"]):
                continue
            start = int(np.argmax(cols["key"] == cols["key"][-1]))
            sent = None
            if len(cols["key"]) - start > most:
                start, sent = len(cols["key"]), int(cols["key"][-1])
            if start:
                yield from meet({c: x[:start] for c, x in cols.items()})
            held = {c: x[start:] for c, x in cols.items()}
        if held is not None and len(held["key"]):
            yield from meet(held)

    arrow_rows(entries.sparkSession)
    return entries.repartition("key").sortWithinPartitions("key").mapInArrow(run, fields)


def is_similar(a: Column, b: Column, similarity: float) -> Column:
    both = F.size(F.array_intersect(a, b))
    return both >= F.lit(similarity) * (F.size(a) + F.size(b) - both)


def close(pairs: DataFrame, marks: DataFrame, similarity: float) -> DataFrame:
    """Those of the pairs (a, b) that are similar as far as marks (node, size, mark) tell: all that are, and few others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("mark_a", "mark_b", "size")), strict=True)
            yield batch.select(["a", "b"]).filter(pa.array([may_be_similar(x, y, n, similarity) for x, y, n in rows], pa.bool_()))

    left, right = (marks.select(F.col("node").alias(x), F.col("size").alias(f"size_{x}"), F.col("mark").alias(f"mark_{x}")) for x in "ab")
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "mark_a", "mark_b", (F.col("size_a") + F.col("size_b")).alias("size"))
    arrow_rows(pairs.sparkSession)
    return both.mapInArrow(run, "a long, b long")


def verified(pairs: DataFrame, sets: Sets, marks: DataFrame, similarity: float, scratch: Scratch) -> DataFrame:
    """Those of the pairs (a, b) whose texts' shingles are similar. Only shingles of texts in a pair that marks leave are moved."""
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    pairs = scratch.table(close(pairs, marks, similarity), "pairs")
    ends = pairs.select(F.col("a").alias("node")).unionAll(pairs.select(F.col("b").alias("node"))).distinct()
    few = scratch.table(sets(ends), "sets")
    left, right = (few.select(F.col("node").alias(x), F.col("shingles").alias(f"of_{x}")) for x in "ab")
    like = pairs.join(left, "a").join(right, "b").filter(is_similar(F.col("of_a"), F.col("of_b"), similarity))
    out = scratch.table(like.select("a", "b"), "similar")
    scratch.drop(pairs, few)
    return out


def met_pairs(dealt: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of texts with different roots that meet in a group (key, i, j), by their places may have that key as
    the first in common, and may be similar by their marks. ``dealt`` has own, node, root, place, size and mark beside."""
    group, names = ["key", "i", "j"], ["key", "i", "j", "own", "node", "root", "place", "size", "mark"]

    def compare(cols: dict[str, np.ndarray]) -> pa.RecordBatch:
        change = np.any([cols[c][1:] != cols[c][:-1] for c in group], axis=0)
        ends = np.append(np.nonzero(change)[0] + 1, len(change) + 1)
        begins = np.append(0, ends[:-1])
        node, root, own, place, size, mark = (cols[c] for c in ("node", "root", "own", "place", "size", "mark"))
        inside, left = cols["i"] == cols["j"], size - place + 1

        def may(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            least = (size[a] + size[b]) * (similarity / (1 + similarity)) - 1e-6
            ok = (node[a] != node[b]) & (root[a] != root[b]) & ((own[a] != own[b]) | inside[a]) & (np.minimum(left[a], left[b]) >= least)
            return a[ok], b[ok]

        two = begins[ends - begins == 2]
        found = [may(two, two + 1)]
        for x, y in zip(begins, ends, strict=True):
            if y - x > 2:
                a, b = np.triu_indices(y - x, 1)
                found.append(may(a + x, b + x))
        told: dict[tuple[int, int], bool] = {}
        for a, b in found:
            for p, q in zip(a.tolist(), b.tolist(), strict=True):
                pair = (int(node[p]), int(node[q]))
                if pair not in told:
                    told[pair] = may_be_similar(mark[p], mark[q], int(size[p]) + int(size[q]), similarity)
        pairs = np.array([pair for pair, ok in told.items() if ok], np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols in whole_groups(batches, group):
            yield compare(cols)

    arrow_rows(dealt.sparkSession)
    return dealt.select(*names).repartition(*group).sortWithinPartitions(*group, "node").mapInArrow(run, "a long, b long")


def similar_classes(entries: Entries, sets: Sets, marks: DataFrame, seeds: DataFrame | None, similarity: float, scratch: Scratch) -> DataFrame:
    """(node, root) for every text that is similar to another one, or by way of others.

    ``entries`` gives the shingles that texts are entered under, ``sets`` the shingles of texts,
    ``marks`` (node, size, mark) their marks, ``seeds`` are pairs (a, b) known to be similar. Texts
    that meet under a key in a group of no more than GROUP are compared if they share as many keys as
    similar texts must, keys of larger groups counted in. In larger groups,
    texts are compared with one of them (first the one that shares most keys), for up to LEADS
    rounds, or until a round links nothing; what has been linked need not be compared again. All
    others of a group meet in pairs, large groups by pairs of blocks; and pairs are compared that,
    by their places, may have that shingle as the first in common.
    """
    similar = scratch.table(marks.select(F.col("node").alias("a"), F.col("node").alias("b")).limit(0) if seeds is None else seeds, "similar")
    linked = components(similar, scratch)
    met = scratch.table(met_texts(entries(linked), similarity), "met")
    members = met.filter("key IS NOT NULL").select("key", "node", "place", "size")
    shares = scratch.table(members.groupBy("node").agg(F.count("*").alias("shares")), "shares")
    counted = met.filter("a IS NOT NULL").groupBy("a", "b").agg(F.count("*").alias("n"), F.max("need").alias("need"), F.max("first").alias("first"))
    counted = scratch.table(counted.filter("first"), "counted")
    pairs, few = counted.filter("n >= need").select("a", "b"), shares.isEmpty()
    if not few:
        left, right = (shares.select(F.col("node").alias(x), F.col("shares").alias(f"shares_{x}")) for x in "ab")
        some = counted.filter("n < need").join(left, "a").join(right, "b").filter(F.col("n") + F.least("shares_a", "shares_b") >= F.col("need"))
        pairs = pairs.unionAll(some.select("a", "b"))
    found = verified(pairs, sets, marks, similarity, scratch)
    more = scratch.table(similar.unionAll(found), "similar")
    scratch.drop(similar, linked, found, counted)
    similar, linked = more, components(more, scratch)
    if few:
        scratch.drop(met, shares, similar)
        return linked
    now: DataFrame | None = None
    for turn in range(LEADS + 1):
        roots = shares.join(linked, "node", "left").withColumn("root", F.coalesce("root", "node"))
        rooted = scratch.table((members if now is None else now).select("key", "node", "place", "size").join(roots, "node"), "members")
        scratch.drop(now)
        first = F.struct((F.lit(0).cast("long") if turn else -F.col("shares")).alias("shares"), F.xxhash64("node", F.lit(turn)).alias("h"), "node", "root", "size")
        groups = rooted.groupBy("key").agg(F.count("*").alias("n"), F.min("root").alias("low"), F.max("root").alias("high"), F.min(first).alias("lead"))
        groups = groups.filter("low <> high").select("key", "n", F.col("lead.node").alias("lead"), F.col("lead.root").alias("lead_root"), F.col("lead.size").alias("lead_size"))
        now = scratch.table(rooted.join(groups, "key"), "members")
        scratch.drop(rooted)
        large = F.col("n") > GROUP
        if turn == LEADS or now.filter(large).isEmpty():
            break
        pairs = now.filter(large & (F.col("root") != F.col("lead_root")) & (F.least("size", "lead_size") >= shared(F.col("size"), F.col("lead_size"), similarity)))
        found = verified(pairs.select(F.col("node").alias("a"), F.col("lead").alias("b")), sets, marks, similarity, scratch)
        if found.isEmpty():
            break
        more = scratch.table(similar.unionAll(found), "similar")
        scratch.drop(similar, linked, found)
        similar, linked = more, components(more, scratch)
    blocks = F.ceil(F.col("n") / GROUP).cast("int")
    dealt = now.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "root", "place", "size")
    met = met_pairs(dealt.join(marks.select("node", "mark"), "node"), similarity)
    found = verified(met, sets, marks, similarity, scratch)
    more = scratch.table(similar.unionAll(found), "similar")
    out = components(more, scratch)
    scratch.drop(met, shares, similar, more, found, now, linked)
    return out


def shared(a: Column, b: Column, similarity: float) -> Column:
    """How many shingles similar texts of so many share at least."""
    return (a + b) * F.lit(similarity / (1 + similarity)) - F.lit(1e-6)


def in_the_middle(linked: DataFrame, texts: DataFrame, sets: Sets, scratch: Scratch) -> DataFrame:
    """(root, lead): of each class (node, root) the text that differs least from the shingles that over half of its
    texts have, ties by ``low``."""
    few = scratch.table(sets(linked.select("node")), "sets")
    rows = linked.join(few, "node")
    each = rows.select("root", "node", F.explode("shingles").alias("shingle"))
    n = linked.groupBy("root").agg(F.count("*").alias("n"))
    major = each.groupBy("root", "shingle").agg(F.count("*").alias("c")).join(n, "root").filter(F.col("c") * 2 > F.col("n")).select("root", "shingle")
    both = each.join(major, ["root", "shingle"]).groupBy("node").agg(F.count("*").alias("both"))
    # the number of common shingles is the same for all texts of a class
    far = F.col("size") - 2 * F.coalesce("both", F.lit(0))
    told = rows.select("root", "node", "size").join(both, "node", "left").join(texts.select("node", "low"), "node")
    first = told.groupBy("root").agg(F.min(F.struct(far.alias("far"), "low", "node")).alias("first"))
    out = scratch.table(first.select("root", F.col("first.node").alias("lead")), "leads")
    scratch.drop(few)
    return out


def is_alike(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Sorted distinct shingles of two texts."""
    if min(len(a), len(b)) < similarity * max(len(a), len(b)) - 1e-6:
        return False
    at = np.minimum(np.searchsorted(b, a), max(len(b) - 1, 0))
    both = int((b[at] == a).sum()) if len(b) else 0
    return both >= similarity * (len(a) + len(b) - both)


def apart(classes: DataFrame, texts: DataFrame, sets: Sets, similarity: float) -> DataFrame:
    """(node) of texts of each class (node, root) no two of which are similar, while all others are similar to one of them.

    They are taken in order of their difference from the shingles that over half of the class have,
    ties by ``low`` (of two texts the one with the smaller ``low`` is taken). A class is held in one task and has GROUP texts at most.
    """
    rows = classes.join(texts.select("node", "low.*"), "node")

    def run(table: pa.Table) -> pa.Table:
        low = list(zip(*(table.column(c).to_pylist() for c in ("no_id", "id", "row")), strict=True))
        shingles = [np.sort(x.values.to_numpy(zero_copy_only=False)) for x in table.column("shingles")]
        every, times = np.unique(np.concatenate(shingles), return_counts=True)
        major = every[2 * times > len(low)]
        far = [len(x) - 2 * int(np.isin(x, major, assume_unique=True).sum()) for x in shingles]
        kept: list[int] = []
        for k in sorted(range(len(low)), key=lambda k: (far[k], low[k])):
            if not any(is_alike(shingles[k], shingles[j], similarity) for j in kept):
                kept.append(k)
        return pa.table({"node": table.column("node").take(pa.array(kept))})

    two = rows.groupBy("root").agg(F.count("*").alias("n"), F.min(F.struct("no_id", "id", "row", "node"))["node"].alias("node"))
    larger = rows.join(two.filter("n > 2").select("root"), "root", "left_semi")
    more = larger.join(sets(larger.select("node")).select("node", "shingles"), "node").groupBy("root").applyInArrow(run, "node long")
    return two.filter("n <= 2").select("node").unionAll(more)


def staying(linked: DataFrame, texts: DataFrame, again: Callable[[DataFrame], Entries], sets: Sets, marks: DataFrame, similarity: float, scratch: Scratch) -> DataFrame:
    """(node) of the texts of all classes (node, root) that stay: no two are similar, and all others are similar to one.

    A class of more than GROUP texts is first compared with the text in its middle, and what is not
    similar to that is parted into classes again; so a class falls apart around its middle. ``again``
    gives the entries of some texts (node) alone.
    """
    stay: DataFrame | None = None
    while True:
        counts = linked.groupBy("root").agg(F.count("*").alias("n"))
        sized = scratch.table(linked.join(counts, "root"), "sized")
        small = scratch.table(apart(sized.filter(F.col("n") <= GROUP).drop("n"), texts, sets, similarity), "small")
        stay = small if stay is None else scratch.table(stay.unionAll(small), "stay")
        large = sized.filter(F.col("n") > GROUP).drop("n")
        if large.isEmpty():
            return stay
        leads = in_the_middle(large, texts, sets, scratch)
        stay = scratch.table(stay.unionAll(leads.select(F.col("lead").alias("node"))), "stay")
        pairs = large.join(leads, "root").filter("node <> lead").select(F.col("node").alias("a"), F.col("lead").alias("b"))
        near = verified(pairs, sets, marks, similarity, scratch)
        met = near.select(F.col("a").alias("node")).unionAll(near.select(F.col("b").alias("node"))).unionAll(leads.select(F.col("lead").alias("node")))
        rest = scratch.table(large.select("node").join(met.distinct(), "node", "left_anti"), "rest")
        scratch.drop(sized, leads, near)
        linked = similar_classes(again(rest), sets, marks, None, similarity, scratch)
        alone = rest.join(linked, "node", "left_anti").select("node")
        stay = scratch.table(stay.unionAll(alone), "stay")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each class of texts one stays.

    Texts are similar whose distinct shingles of ``width`` words share ``similarity`` of all that
    the two have; a class holds all that are similar, directly or by way of others. Of equal texts
    (in words, but for case) the one with the smallest id stands for all (null last). Of two texts
    in a class that with the smaller id stays; of more the one in their middle, so an original
    stays for its edited copies whatever its id, and of those that are not similar to it again one
    a class, until every text that goes is similar to one that stays. Null, empty and blank texts
    are equal to each other. Rows equal in id are told apart by where they stand in the written
    table. An empty table gives no row; all columns are returned as they are, whatever their names.
    """
    names = docs.columns
    out = [f"k{i}" for i in range(len(names))]
    rows = materialize(signed_texts(docs, text_col, names, out, width).withColumn("row", F.monotonically_increasing_id()), "signed")
    ident, body = F.col(out[names.index(id_col)]), F.col(out[names.index(text_col)])
    own = F.struct(ident.isNull().alias("no_id"), ident.alias("id"), "row")
    with Scratch(docs.sparkSession) as scratch:
        first = rows.groupBy("whole", "other").agg(F.min(F.struct(own.alias("low"), "fp")).alias("one"))
        texts = scratch.table(first.select(F.col("one.low.row").alias("node"), F.col("one.low").alias("low"), F.col("one.fp").alias("fp")), "texts")
        bodies = rows.select(F.col("row").alias("node"), body.cast("string").alias("body"))
        marks = rows.select(F.col("row").alias("node"), "size", "mark")
        others = scratch.table(marks.select("node").join(texts.select("node"), "node", "left_anti"), "others")
        level = docs.sparkSession.sparkContext.broadcast(levels(bodies, width, bitmap(others)))  # COUNTERS short numbers

        def sets(nodes: DataFrame) -> DataFrame:
            return shingle_sets(bodies, width, bitmap(nodes)).join(nodes, "node", "left_semi")

        def entries(linked: DataFrame) -> DataFrame:
            return text_entries(bodies, others, linked, level, width, similarity)

        def again(nodes: DataFrame) -> Entries:
            alone = near_at_hand(bodies, bitmap(nodes)).join(nodes, "node", "left_semi").select("node", F.col("node").alias("root"), "body")
            return lambda linked: entered(alone, level, width, similarity)

        fps = texts.select("node", "fp")
        n, both = bit_counts(fps)
        seeds = verified(links(fps, plan(n, both, NEAR_BITS), NEAR_BITS, scratch), sets, marks, similarity, scratch)
        linked = similar_classes(entries, sets, marks, seeds, similarity, scratch)
        stay = staying(linked, texts, again, sets, marks, similarity, scratch)
        gone = linked.select("node").join(stay, "node", "left_anti")
        gone = materialize(gone.select(F.col("node").alias("row")).unionAll(others.select(F.col("node").alias("row"))), "gone")
    bits = bitmap(gone.select(F.col("row").alias("node")))
    kept = parted(rows, bits, False).unionAll(parted(rows, bits, True).join(gone, "row", "left_anti").select(*rows.columns))
    return kept.select(*(F.col(o).alias(n) for n, o in zip(names, out, strict=True)))
