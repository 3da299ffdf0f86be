"""Packing documents into fixed-length sequences by cutting-stock column generation.

A document's ids are cut by its length alone: whole sequences of ``capacity`` first, then of what
is left a *main* part, a multiple of ``grid``, and a *crumb* shorter than two grids. So there are
few size classes, all exact, and the histogram of the corpus over them is the cutting-stock
demand. A linear program over patterns (multisets of classes that fit a sequence) is solved by
column generation: the simplex duals price classes, an unbounded knapsack by dynamic programming
finds the best new pattern, until none has negative reduced cost. The solution is rounded down, what
remains is solved and rounded again, and crumbs and the last few pieces are filled in by a bounded
subset sum. Patterns are then dealt to the pieces by their rank in their class. Only the histogram and
the patterns, both bounded by the number of classes, ever reach the driver.
"""

from __future__ import annotations

import os
import re
import unicodedata
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voxloom.llm.common import arrow_rows, as_bytes, materialize, slices

TOKENIZER = "word_bpe_49k.json"
END_ID = 2
CACHE = 500_000
BUCKET_ROWS = 1 << 22


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: ASCII punctuation; after an ASCII letter, what of it ends a word is a token run of its own.
PUNCTUATION = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


#: The alphabet of byte-level vocabularies: printable bytes stand for themselves, the others follow from 256 on.
PRINTABLE = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
BYTES = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in PRINTABLE)}


class WordIds:
    """Ids of whole texts by a tokenizer that lower-cases and never joins text across ASCII white space.

    Such a tokenizer's ids are the concatenation of its ids word by word, so words are encoded once
    and kept, as little-endian 32-bit bytes, in a cache that is emptied when full. Strings of special
    tokens are found in the text as it is, before anything is lower-cased, and part what stands around
    them; what is left is ordinary text.
    """

    def __init__(self, path: str, cache: int = CACHE):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # words hold none that the text itself holds
        self.cache, self.most = {}, cache
        added = self.tokenizer.get_added_tokens_decoder()
        if any(t.normalized or t.lstrip or t.rstrip or t.single_word for t in added.values()):
            raise ValueError("only special tokens that are taken literally are known here")
        self.special = {t.content.encode(): array("I", [k]).tobytes() for k, t in added.items()}
        self.parting = re.compile(b"(" + b"|".join(sorted(map(re.escape, self.special), key=len, reverse=True)) + b")")

    def words(self, new: list[bytes]) -> list[bytes]:
        """Ids of single words. A run of lower-case letters needs the model alone, on the byte alphabet."""
        tokenize, out, odd = self.tokenizer.model.tokenize, [], []
        for w in new:
            if w.isalpha():
                said = tokenize(w.decode())
            else:
                text = w.decode("utf-8", "replace")
                if not (text.isalpha() and max(text) < "\u0250" and text == unicodedata.normalize("NFC", text.lower())):
                    odd.append(len(out))
                    out.append(b"")
                    continue
                said = tokenize(w.decode("latin-1").translate(BYTES))
            out.append(array("I", [t.id for t in said]).tobytes())
        for at in range(0, len(odd), 2048):
            part = odd[at : at + 2048]
            for k, e in zip(part, self.tokenizer.encode_batch_fast([new[k].decode("utf-8", "replace") for k in part], add_special_tokens=False), strict=True):
                out[k] = array("I", e.ids).tobytes()
        return out

    def __call__(self, texts: list[bytes]) -> list[bytes]:
        marked = [k for k, t in enumerate(texts) if any(s in t for s in self.special)]
        if not marked:
            return self.plain(texts)
        parts = [[t] for t in texts]
        for k in marked:
            parts[k] = self.parting.split(texts[k])
        ids = iter(self.plain([p for ps in parts for p in ps[::2]]))  # every second one is a special token
        return [b"".join(self.special[p] if i % 2 else next(ids) for i, p in enumerate(ps)) for ps in parts]

    def plain(self, texts: list[bytes]) -> list[bytes]:
        split = [t.lower().split() for t in texts]
        all_words, cache = set().union(*split), self.cache
        new = [w for w in all_words if w not in cache]
        if len(cache) + len(new) > self.most:
            cache.clear()
            new = list(all_words)
        # a word and the punctuation at its end, where they part after an ASCII letter
        cores = [c if len(c) < len(w) and c[-1:].isalpha() else w for w, c in zip(new, (w.rstrip(PUNCTUATION) for w in new), strict=True)]
        parts = [x for x in dict.fromkeys([*cores, *(w[len(c) :] for w, c in zip(new, cores, strict=True))]) if x and x not in cache]
        cache.update(zip(parts, self.words(parts), strict=True))
        for w, c in zip(new, cores, strict=True):
            if len(c) < len(w):
                cache[w] = cache[c] + cache[w[len(c) :]]
        return [b"".join([cache[w] for w in words]) for words in split]


def cut(length: int, capacity: int, grid: int) -> list[int]:
    """Lengths of the pieces of a document, in order: full sequences, main part, crumb."""
    full, rest = divmod(length, capacity)
    crumb = rest % grid if rest < 2 * grid else rest % grid + grid
    if rest < 2 * grid:
        crumb, main = rest, 0
    else:
        main = rest - crumb
    return [capacity] * full + [x for x in (main, crumb) if x]


def classes(capacity: int, grid: int) -> np.ndarray:
    """All lengths below ``capacity`` that ``cut`` can give."""
    return np.array(sorted({*range(1, min(2 * grid, capacity)), *range(grid, capacity, grid)}), dtype=np.int64)


# ---- the cutting-stock problem -------------------------------------------------------------


def price(lengths: np.ndarray, value: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack: the pattern of greatest value, as counts of each length."""
    best, take = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    order = np.argsort(lengths)
    sizes, worth = lengths[order], value[order]
    upto = np.searchsorted(sizes, np.arange(capacity + 1), side="right")
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        if k := upto[c]:
            got = best[c - sizes[:k]] + worth[:k]
            i = int(got.argmax())
            if got[i] > best[c] + 1e-12:
                best[c], take[c] = got[i], i
    counts, c = np.zeros(len(lengths), np.int64), capacity
    while c > 0:
        if take[c] < 0:
            c -= 1
        else:
            counts[order[take[c]]] += 1
            c -= sizes[take[c]]
    return float(best[capacity]), counts


def solve(lengths: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = 600) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (one a row) and how often each is used, of the linear program that covers ``demand``.

    Revised simplex with an explicit inverse of the basis; the first basis repeats each length alone.
    """
    n = len(lengths)
    basis = np.diag(capacity // lengths).astype(float)
    patterns = np.diag(capacity // lengths)
    inverse = np.diag(1.0 / np.diag(basis))
    use = inverse @ demand
    for k in range(rounds):
        duals = inverse.sum(axis=0)
        worth, column = price(lengths, np.maximum(duals, 0), capacity)
        if worth <= 1 + 1e-9:
            break
        step = inverse @ column
        ratio = np.where(step > 1e-9, use / np.where(step > 1e-9, step, 1), np.inf)
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            break
        use = use - ratio[out] * step
        use[out] = ratio[out]
        patterns[out] = column
        if k % 50 == 49:
            inverse = np.linalg.inv(patterns.T.astype(float))
            use = inverse @ demand
        else:
            pivot = inverse[out] / step[out]
            inverse = inverse - np.outer(step, pivot)
            inverse[out] = pivot
        use = np.maximum(use, 0)
    assert patterns.shape == (n, n)
    return patterns, use


def fill(lengths: np.ndarray, left: np.ndarray, capacity: int) -> np.ndarray:
    """Counts of the pieces still left that fill a sequence best (bounded subset sum).

    Each capacity keeps the count of the last length tried that reaches it, so a total is reached
    with as few of that length as can be; longer lengths are tried first.
    """
    reach = np.zeros(capacity + 1, bool)
    reach[0] = True
    steps = []
    for i in np.argsort(-lengths):
        if not left[i]:
            continue
        size, used = int(lengths[i]), np.where(reach, 0, -1)
        for c in range(size, capacity + 1, size):  # capacities c .. c + size - 1 follow those one piece below
            low, high = slice(c - size, min(c, capacity + 1 - size)), slice(c, min(c + size, capacity + 1))
            more = (used[high] < 0) & (used[low] >= 0) & (used[low] < left[i])
            used[high] = np.where(more, used[low] + 1, used[high])
        reach = used >= 0
        steps.append((i, size, used))
        if reach[capacity]:
            break
    at, counts = int(np.nonzero(reach)[0][-1]), np.zeros(len(lengths), np.int64)
    for i, size, used in reversed(steps):
        counts[i] = used[at]
        at -= counts[i] * size
    return counts


def by_program(sizes: np.ndarray, left: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """Rounded-down patterns of the linear program, solved again for what rounding leaves; ``left`` goes down."""
    out = []
    for _ in range(6):
        have = np.nonzero(left)[0]
        if len(have) < 2 or left.sum() < 2 * len(have):
            break
        rows, use = solve(sizes[have], left[have].astype(float), capacity)
        before = left.sum()
        for row, n in zip(rows, np.floor(use + 1e-7).astype(np.int64), strict=True):
            n = min([int(n), *(int(left[have[j]] // row[j]) for j in np.nonzero(row)[0])])
            if n > 0:
                counts = np.zeros(len(sizes), np.int64)
                counts[have] = row
                out.append((counts, n))
                left -= n * counts
        if left.sum() > 0.9 * before:
            break
    return out


def patterns_for(lengths: np.ndarray, demand: np.ndarray, capacity: int, grid: int) -> list[tuple[np.ndarray, int]]:
    """Whole-number cutting patterns that use each length exactly ``demand`` times.

    Main parts, which hold nearly all ids, are multiples of the grid: their program has one row for
    each multiple. Crumbs then fill what its patterns leave open, and with the main parts that
    rounding left over make up the last sequences.
    """
    left, main = demand.astype(np.int64).copy(), np.nonzero(lengths % grid == 0)[0]
    part = left[main]
    out = []
    for units, n in by_program(lengths[main] // grid, part, capacity // grid):
        counts = np.zeros(len(lengths), np.int64)
        counts[main] = units
        out.append((counts, n))
    left[main] = part
    crumbs, made = lengths % grid != 0, []
    for counts, n in out:
        gap = capacity - int(counts @ lengths)
        while gap and n:
            extra = fill(lengths, np.where(crumbs, left, 0), gap)
            if not extra.any():
                break
            k = min([n, *(int(left[i] // extra[i]) for i in np.nonzero(extra)[0])])
            made.append((counts + extra, k))
            left, n = left - k * extra, n - k
        if n:
            made.append((counts, n))
    while left.any():
        counts = fill(lengths, left, capacity)
        n = int(min(left[i] // counts[i] for i in np.nonzero(counts)[0]))
        made.append((counts, n))
        left -= n * counts
    return made


@dataclass
class Deal:
    """For each class: from which rank on which pattern's sequences take the pieces, and where."""

    lengths: np.ndarray
    first: list[np.ndarray]  # first rank of each share
    base: list[np.ndarray]  # first sequence of the pattern
    each: list[np.ndarray]  # pieces of this class in a sequence of the pattern
    offset: list[np.ndarray]  # where the class starts in the sequence

    def place(self, k: int, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        share = np.searchsorted(self.first[k], rank, side="right") - 1
        step, slot = np.divmod(rank - self.first[k][share], self.each[k][share])
        return self.base[k][share] + step, self.offset[k][share] + slot * self.lengths[k]


def deal(lengths: np.ndarray, chosen: list[tuple[np.ndarray, int]], start: int) -> Deal:
    rows: list[list[tuple[int, int, int, int]]] = [[] for _ in lengths]
    used = np.zeros(len(lengths), np.int64)
    for counts, n in chosen:
        at = 0
        for k in sorted(np.nonzero(counts)[0], key=lambda k: -lengths[k]):
            rows[k].append((int(used[k]), start, int(counts[k]), at))
            used[k] += n * counts[k]
            at += int(counts[k] * lengths[k])
        start += n
    cols = [np.array(r, np.int64).reshape(-1, 4).T for r in rows]
    return Deal(lengths, *[[c[i] for c in cols] for i in range(4)])


# ---- on Spark --------------------------------------------------------------------------------

PIECES = "doc_id {id}, start long, length long, ids_crc32 long, doc_tokens long, row_crc32 long"


def pieces(docs: DataFrame, id_col: str, text_col: str, *, capacity: int, grid: int, path: str, with_ids: bool = False) -> DataFrame:
    """Tokenize and cut: one row a piece. Where the cuts lie depends on the document's length alone."""
    kind = docs.schema[id_col].dataType
    schema = PIECES.format(id=kind.simpleString()) + (", ids array<long>" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = WordIds(path), np.array([END_ID], "<u4").tobytes()
        for batch in slices(batches):
            texts = encode(as_bytes(batch.column(1)))
            doc, cols, kept = [], [[] for _ in range(5)], []
            for i, text in enumerate(texts):
                ids, at = text + end, 0
                whole = zlib.crc32(ids)
                for size in cut(len(ids) // 4, capacity, grid):
                    part = ids[4 * at : 4 * (at + size)]
                    doc.append(i)
                    for col, x in zip(cols, (at, size, zlib.crc32(part), len(ids) // 4, whole), strict=True):
                        col.append(x)
                    if with_ids:
                        kept.append(np.frombuffer(part, "<u4").astype(np.int64))
                    at += size
            arrays = [batch.column(0).take(pa.array(doc, pa.int64())), *(pa.array(c, pa.int64()) for c in cols)]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "row_crc32"]
            if with_ids:
                arrays, names = [*arrays, pa.array(kept, pa.list_(pa.int64()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    arrow_rows(docs.sparkSession)
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(run, schema)


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    *,
    capacity: int = 4096,
    grid: int = 64,
    tokenizer: str | None = None,
    buckets: int | None = None,
    with_ids: bool = False,
) -> DataFrame:
    """Every document's pieces with their places in sequences of at most ``capacity`` ids.

    Returns doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids). Null and
    empty texts hold the end id alone. Rows that repeat are packed as often as they occur; rows
    with the same id are told apart by their ids' checksum. An empty table gives no row. Other
    columns are neither read nor returned.

    Ranks are counted in ``buckets`` parts of each class, which hold about the same number of
    rows whatever the ids are, so a class that holds most rows is not one task's work. There are
    as many as keep a part of a class below some BUCKET_ROWS documents.
    """
    buckets = buckets or max(128, -(-docs.count() // BUCKET_ROWS))
    assert capacity % grid == 0 and capacity >= 4 * grid
    spark = docs.sparkSession
    made = pieces(docs, id_col, text_col, capacity=capacity, grid=grid, path=tokenizer or tokenizer_path(), with_ids=with_ids)
    own = F.struct("doc_id", "row_crc32", "start")
    made = materialize(made.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "row_crc32", "start", F.monotonically_increasing_id()), F.lit(buckets))), "pieces")
    sizes = made.groupBy("length", "bucket").agg(F.count("*").alias("n")).toPandas()  # classes x buckets
    lengths = np.append(classes(capacity, grid), capacity)
    at = {int(x): k for k, x in enumerate(lengths)}
    counts = np.zeros((len(lengths), buckets), np.int64)
    counts[sizes["length"].map(at).to_numpy(np.int64), sizes["bucket"].to_numpy(np.int64)] = sizes["n"].to_numpy()
    before = np.cumsum(counts, axis=1) - counts
    demand = counts.sum(axis=1)
    chosen = patterns_for(lengths[:-1], demand[:-1], capacity, grid)
    if demand[-1]:
        whole = np.zeros(len(lengths), np.int64)
        whole[-1] = 1
        chosen = [(np.append(c, 0), n) for c, n in chosen] + [(whole, int(demand[-1]))]
    else:
        chosen = [(np.append(c, 0), n) for c, n in chosen]
    plan = spark.sparkContext.broadcast((deal(lengths, chosen, 0), before, at))
    ranked = made.withColumn("rank", F.row_number().over(W.partitionBy("length", "bucket").orderBy(own)).cast("long") - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, offsets, index = plan.value
        for batch in batches:
            size, bucket, rank = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("length", "bucket", "rank"))
            seq, off = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
            for x in np.unique(size):
                here, k = size == x, index[int(x)]
                seq[here], off[here] = where.place(k, rank[here] + offsets[k, bucket[here]])
            cols = [batch.column(n) for n in keep]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(seq), pa.array(off)], names=[*keep, "sequence_id", "offset"])

    keep = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", *(["ids"] if with_ids else [])]
    kinds = ", ".join(f"{n} {made.schema[n].dataType.simpleString()}" for n in keep)
    return ranked.select(*keep, "bucket", "rank").mapInArrow(run, f"{kinds}, sequence_id long, offset long")

