"""Toxicity scores from a factorization machine over hashed terms.

A text's terms are its distinct words and their first letters, hashed into a fixed number of
slots. Besides a weight, each slot has a short vector; the product of two slots' vectors is the
weight of their meeting in one text, so an insult beside a group's name can count for more than
both alone. Weights are learned by gradient descent on the logistic loss from a bounded sample of
labelled rows and sent to the executors, which score whole texts.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.llm.common import arrow_rows, as_bytes, crc_mod, give_back, slices, thinned

SLOTS, RANK = 1 << 18, 4
#: Bounds of the training sample: this many rows of either label at most, those of the least hash.
SAMPLE = {1: 6_000, 0: 12_000}
PREFIXES = (4, 5)
CACHE = 400_000
#: ASCII punctuation and digits part words; letters are lower-cased.
PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 or c == 39 else 32 for c in range(256))


def word_slots(word: bytes) -> tuple[int, ...]:
    """Slots of a word and of its first letters (code points)."""
    text = word if word.isascii() else word.decode("utf-8", "replace")
    starts = [text[:k] for k in PREFIXES if len(text) > k]
    terms = [b"w" + word, *(b"%d" % len(t) + (t if text is word else t.encode()) for t in starts)]
    return tuple([zlib.crc32(t) % SLOTS for t in terms])


class Terms:
    """Distinct slots of whole texts; the slots of words are kept in a cache that is emptied when full.

    With ``only``, a mask, slots outside it are left out: they count for nothing.
    """

    def __init__(self, only: np.ndarray | None = None):
        self.cache: dict[bytes, tuple[int, ...]] = {}
        self.only = None if only is None else only.tolist()

    def __call__(self, text: bytes) -> np.ndarray:
        words, cache, only = set(text.translate(PLAIN).split()), self.cache, self.only
        if len(cache) > CACHE:
            cache.clear()
        for w in words:
            if w not in cache:
                slots = word_slots(w)
                cache[w] = slots if only is None else tuple([s for s in slots if only[s]])
        ids = {s for w in words for s in cache[w]}
        return np.sort(np.fromiter(ids, np.int32, len(ids)))


@dataclass
class Machine:
    bias: float
    weight: np.ndarray  # SLOTS
    vector: np.ndarray  # SLOTS x RANK

    def logits(self, rows: list[np.ndarray]) -> np.ndarray:
        """Of each row of distinct slots: bias, weights, and half of squared sums less sums of squares."""
        size = np.array([len(r) for r in rows])
        out, full = np.full(len(rows), self.bias), np.nonzero(size)[0]
        if len(full):
            ids = np.concatenate([rows[i] for i in full])
            at = np.append(0, np.cumsum(size[full])[:-1])
            v = self.vector[ids].astype(np.float64)
            once, square = np.add.reduceat(v, at, axis=0), np.add.reduceat(v * v, at, axis=0)
            out[full] += np.add.reduceat(self.weight[ids].astype(np.float64), at) + 0.5 * (once * once - square).sum(axis=1)
        return out


def telling(rows: list[np.ndarray], label: np.ndarray, least: float = 15.0) -> np.ndarray:
    """Which slots tell the labels apart: chi-square of presence against label, corrected for continuity.

    All others would only add noise that grows with a text's length.
    """
    n1, n = float(label.sum()), float(len(label))
    seen, toxic = np.zeros(SLOTS), np.zeros(SLOTS)
    for at in range(0, len(rows), 512):  # the driver holds the rows, and no second copy of them
        part = rows[at : at + 512]
        seen += np.bincount(np.concatenate(part), minlength=SLOTS)
        toxic += np.bincount(np.concatenate([r for r, y in zip(part, label[at : at + 512], strict=True) if y] or [part[0][:0]]), minlength=SLOTS)
    gap = np.maximum(np.abs(toxic * n - seen * n1) - n / 2, 0)
    return n * gap**2 / np.maximum(seen * (n - seen) * n1 * (n - n1), 1e-9) * (seen > 0) >= least


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit(rows: list[np.ndarray], label: np.ndarray, *, epochs: int = 12, batch: int = 128, rate: float = 0.15, decay: float = 2e-4, seed: int = 7, prior: float | None = None) -> Machine:
    """AdaGrad on the logistic loss over shuffled batches; ``prior`` is the share of label 1 among all labelled rows.

    Without rows the machine scores everything at ``prior``, or at 0 if that is unknown too.
    """
    rng = np.random.default_rng(seed)
    m = Machine(0.0, np.zeros(SLOTS), rng.normal(0, 0.01, (SLOTS, RANK)))
    prior = min(max(float(label.mean()) if prior is None and len(label) else prior or 0.0, 1e-6), 1 - 1e-6)
    if not len(rows) or label.min() == label.max():
        return Machine(float(np.log(prior / (1 - prior))), m.weight.astype(np.float32), np.zeros((SLOTS, RANK), np.float32))
    use = telling(rows, label)
    rows = [r[use[r]] for r in rows]
    m.vector[~use] = 0
    share = float(label.mean())
    m.bias = float(np.log(share / (1 - share)))
    gb, gw, gv = 1.0, np.full(SLOTS, 1.0), np.full((SLOTS, RANK), 1.0)
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for k in range(0, len(order), batch):
            part = [rows[i] for i in order[k : k + batch]]
            size = np.array([len(r) for r in part])
            if not size.sum():
                continue
            ids = np.concatenate(part)
            owner = np.repeat(np.arange(len(part)), size)
            v = m.vector[ids]
            once = np.zeros((len(part), RANK))
            for f in range(RANK):
                once[:, f] = np.bincount(owner, v[:, f], len(part))
            square = np.bincount(owner, (v * v).sum(axis=1), len(part))
            z = m.bias + np.bincount(owner, m.weight[ids], len(part)) + 0.5 * ((once**2).sum(axis=1) - square)
            err = sigmoid(z) - label[order[k : k + batch]]
            slots, where = np.unique(ids, return_inverse=True)
            g = np.bincount(where, err[owner], len(slots)) + decay * m.weight[slots] * len(part)
            gw[slots] += g * g
            m.weight[slots] -= rate * g / np.sqrt(gw[slots])
            for f in range(RANK):
                d = np.bincount(where, err[owner] * (once[owner, f] - v[:, f]), len(slots)) + decay * m.vector[slots, f] * len(part)
                gv[slots, f] += d * d
                m.vector[slots, f] -= 0.3 * rate * d / np.sqrt(gv[slots, f])
            gb += err.sum() ** 2
            m.bias -= rate * err.sum() / np.sqrt(gb)
    # the sample may hold more of one label than there is
    m.bias += float(np.log(prior / (1 - prior)) - np.log(share / (1 - share)))
    return Machine(m.bias, m.weight.astype(np.float32), m.vector.astype(np.float32))


# ---- on Spark ------------------------------------------------------------------------------------


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", *, held_out_mod: int = 5) -> Machine:
    """Fit on labelled rows whose crc32 of the id is not 0 mod ``held_out_mod``.

    At most SAMPLE rows of each label take part, those whose ids have the least hash; rows with a
    null id or label take none. Their slots, not their texts, come to the driver.
    """
    known = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").cast("int").alias("label"))
    known = known.filter(F.col("id").isNotNull() & F.col("label").isin(0, 1)).filter(crc_mod("id", held_out_mod) != 0).groupBy("id").agg(F.max("label").alias("label"))
    counts = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    picked = [known.filter((F.col("label") == k) & thinned(F.col("id"), counts.get(k, 0), n)).orderBy(F.xxhash64("id"), "id").limit(n) for k, n in SAMPLE.items()]
    sample = F.broadcast(picked[0].unionAll(picked[1]))  # the sum of SAMPLE rows at most
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text")).join(sample, "id").select("id", "label", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Terms()
        for batch in slices(batches):
            slots = [terms(t).astype("<i4").tobytes() for t in as_bytes(batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(slots, pa.binary())], names=["id", "label", "slots"])

    arrow_rows(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    found = rows.mapInArrow(run, f"id {kind}, label int, slots binary").dropDuplicates(["id"]).orderBy("id").limit(sum(SAMPLE.values()))
    got = found.select("label", "slots").toArrow()
    label = got.column("label").to_numpy().astype(np.float64)
    slots = [np.frombuffer(x.as_buffer(), "<i4") for x in got.column("slots")]
    machine = fit(slots, label, prior=counts.get(1, 0) / max(sum(counts.values()), 1))
    del got, slots, found
    give_back()
    return machine


def score(docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text", *, held_out_mod: int = 5, keep: list[str] | None = None) -> DataFrame:
    """doc_id (or the columns of ``keep`` as k0, k1, ...), held_out, score and predicted of every row.

    Null and empty texts have no term and score the bias; a null id counts as the empty text where
    held-out rows are told. Rows that repeat score alike; other columns take no part.
    """
    names = ["doc_id"] if keep is None else [f"k{i}" for i in range(len(keep))]
    cols = [F.col(f"`{c}`").alias(n) for c, n in zip([id_col] if keep is None else keep, names, strict=True)]
    rows = docs.select(*cols, (crc_mod(id_col, held_out_mod) == 0).alias("held_out"), F.col(f"`{text_col}`").cast("string").alias("body"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    sent = docs.sparkSession.sparkContext.broadcast(machine)  # SLOTS x (RANK + 1) floats

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        terms = Terms((m.weight != 0) | m.vector.any(axis=1))
        for batch in slices(batches, 256):
            said = sigmoid(m.logits([terms(t) for t in as_bytes(batch.column(len(names) + 1))]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(said), pa.array((said >= 0.5).astype(np.int32))], names=[*names, "held_out", "score", "predicted"])

    arrow_rows(docs.sparkSession)
    return rows.mapInArrow(run, f"{fields}, score double, predicted int")


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Scores of all ``docs`` by a machine that is trained on their labelled rows, as ``train`` and ``score`` take them.

    An empty table gives no row; without labels every text scores 0 to six digits.
    """
    return score(docs, train(docs, labels, id_col, text_col, **options), id_col, text_col)


def filter_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that are not predicted toxic, with the same columns, whatever their names.

    Null and empty texts score the bias and so stay where toxic texts are the fewer; rows that repeat
    stay or go together, texts are read whole, and an empty table gives no row.
    """
    names = docs.columns
    rows = score(docs, train(docs, labels, id_col, text_col), id_col, text_col, keep=names).filter("predicted = 0")
    return rows.select(*(F.col(f"k{i}").alias(n) for i, n in enumerate(names)))
