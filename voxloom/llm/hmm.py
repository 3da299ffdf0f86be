"""A hidden Markov language model, trained by Baum-Welch over the whole corpus.

Words are counted over all training documents. The ``own`` most frequent ones are symbols that the
hidden states emit directly; all others share ``shared`` symbols by a hash, and a word's share of
its symbol is the same in every state, as its count has it. So states are trained on a bounded
alphabet while every word of the corpus keeps its own probability.

Training starts from a few rounds on a bounded sample, only to part the states; what counts are
full rounds: each partition runs the scaled forward and backward recursions over all its training
documents and sends expected counts, which are summed by symbol. Scoring runs the scaled forward
recursion over whole texts. The most frequent words are sent to the executors (a fixed number);
rarer words of each document are joined to the table of counts instead, so no word is left out.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.llm.common import arrow_rows, as_bytes, crc_mod, materialize, slices, thinned

STATES, OWN, SHARED, KNOWN = 8, 1 << 15, 1 << 11, 1 << 18
ROUNDS, WARM_ROUNDS, WARM_DOCS = 2, 12, 1_500
#: Pseudo-counts: least of a state's emissions, by the corpus's own distribution; of each transition.
EMIT, MOVE = 25.0, 0.5
TOKENS = 300_000


# ---- recursions over many documents at once ------------------------------------------------------


@dataclass
class Packed:
    """Documents' symbols by position: first all documents' first symbols, longest document first."""

    symbols: np.ndarray
    active: np.ndarray  # documents that have a symbol at each position
    order: np.ndarray  # of documents, longest first


def packed(docs: list[np.ndarray]) -> Packed:
    size = np.array([len(d) for d in docs])
    order = np.argsort(-size, kind="stable")
    flat, at = np.concatenate([docs[i] for i in order]), size[order]
    position = np.arange(len(flat)) - np.repeat(np.cumsum(at) - at, at)
    active = np.bincount(position)
    return Packed(flat[np.argsort(position, kind="stable")], active, order)


@dataclass
class Model:
    start: np.ndarray  # states
    move: np.ndarray  # states x states
    emit: np.ndarray  # symbols x states


def forward(m: Model, p: Packed) -> np.ndarray:
    """Natural logarithm of each document's likelihood, in the order of ``p.order``, by the scaled recursion."""
    out, at, a = np.zeros(len(p.order)), 0, None
    for n in p.active:
        e = m.emit[p.symbols[at : at + n]]
        a = (m.start if a is None else a[:n] @ m.move) * e
        scale = a.sum(axis=1)
        a /= scale[:, None]
        out[:n] += np.log(scale)
        at += n
    return out


def expected(m: Model, p: Packed) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Baum-Welch: expected starts, transitions, and states of every symbol of ``p``."""
    e = m.emit[p.symbols]
    alpha, scale, first = np.empty_like(e), np.empty(len(e), e.dtype), np.append(0, np.cumsum(p.active))
    for t, n in enumerate(p.active):
        here = slice(first[t], first[t] + n)
        a = (np.broadcast_to(m.start, (n, len(m.start))) if t == 0 else alpha[first[t - 1] : first[t - 1] + n] @ m.move) * e[here]
        scale[here] = s = a.sum(axis=1)
        alpha[here] = a / s[:, None]
    back = np.ones_like(e)
    e /= scale[:, None]
    for t in range(len(p.active) - 1, 0, -1):
        here, n = slice(first[t], first[t + 1]), p.active[t]
        e[here] *= back[here]
        back[first[t - 1] : first[t - 1] + n] = e[here] @ m.move.T
    later = np.concatenate([np.arange(first[t - 1], first[t - 1] + n) for t, n in enumerate(p.active) if t]) if len(p.active) > 1 else np.zeros(0, int)
    moves = m.move * (alpha[later].T @ e[p.active[0] :]).astype(np.float64)
    alpha *= back
    alpha /= alpha.sum(axis=1, keepdims=True)
    return alpha[: p.active[0]].sum(axis=0), moves, alpha


def gather(sums: np.ndarray, symbols: np.ndarray, states: np.ndarray) -> None:
    for k in range(states.shape[1]):
        sums[:, k] += np.bincount(symbols, states[:, k], len(sums))


def updated(starts: np.ndarray, moves: np.ndarray, emits: np.ndarray, share: np.ndarray) -> Model:
    start = starts + 1.0
    move = moves + MOVE + 10 * MOVE * np.eye(len(starts))
    # a state that has shown many symbols for its size will show others: their number is the weight of the corpus's own
    weight = EMIT + (emits > 0.5).sum(axis=0)
    emit = emits + weight * share[:, None]
    return Model(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))


def groups(docs: list[np.ndarray], most: int = TOKENS) -> Iterator[list[np.ndarray]]:
    """Documents in groups of a bounded number of symbols (one document may be longer)."""
    held, n = [], 0
    for d in docs:
        if held and n + len(d) > most:
            yield held
            held, n = [], 0
        held.append(d)
        n += len(d)
    if held:
        yield held


def warm_start(docs: list[np.ndarray], share: np.ndarray, states: int, rounds: int, seed: int) -> Model:
    """A model whose states have parted on a sample of documents."""
    rng = np.random.default_rng(seed)
    # documents, not words, are dealt to states at first, since what lasts over a document parts states best
    emits = np.zeros((len(share), states))
    kind = spread(docs, len(share), states, rng)
    for d, k in zip(docs, kind, strict=True):
        np.add.at(emits[:, k], d, 1.0)
    m = updated(np.ones(states), np.eye(states) * 50 + 1, emits, share)
    for _ in range(rounds):
        starts, moves, emits = np.zeros(states), np.zeros((states, states)), np.zeros_like(emits)
        for part in groups(docs):
            p = packed(part)
            s, t, g = expected(m, p)
            starts, moves = starts + s, moves + t
            gather(emits, p.symbols, g)
        m = updated(starts, moves, emits, share)
    return m


def spread(docs: list[np.ndarray], symbols: int, kinds: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    """Documents by kind: a mixture of unigrams fitted by hard assignment from random seeds."""
    if not docs:
        return np.zeros(0, np.int64)
    kind = rng.integers(0, kinds, len(docs))
    seeds = rng.choice(len(docs), min(kinds, len(docs)), replace=False)
    logs = np.zeros((symbols, kinds))
    for round_ in range(rounds):
        counts = np.full((symbols, kinds), 0.05)
        for i, d in enumerate(docs):
            if round_ or i in seeds:
                np.add.at(counts[:, kind[i] if round_ else int(np.nonzero(seeds == i)[0][0])], d, 1.0)
        logs = np.log(counts / counts.sum(axis=0))
        kind = np.array([int(logs[d].sum(axis=0).argmax()) for d in docs])
    return kind


# ---- the vocabulary --------------------------------------------------------------------------------


@dataclass
class Vocabulary:
    """The most frequent words with counts and symbols, and what the shared symbols hold.

    Symbol 0 ends a text; 1 to ``own`` are words of their own; the rest are shared by a hash.
    """

    words: list[bytes]
    counts: np.ndarray
    own: int
    tokens: int  # N, with ends
    ends: int
    distinct: int  # V, with the end
    shared_counts: np.ndarray  # of each shared symbol: words' counts, and number of words
    shared_words: np.ndarray
    index: dict[bytes, int] = field(default_factory=dict)

    def __getstate__(self) -> dict:
        return {**self.__dict__, "index": {}}

    def ready(self) -> Vocabulary:
        if not self.index:
            self.index = {w: k for k, w in enumerate(self.words)}
            symbols = np.arange(1, len(self.words) + 1)
            rare = self.words[self.own :]
            if rare:
                symbols[self.own :] = [self.symbol(w) for w in rare]
            self.symbols = symbols.astype(np.int32)
            self.base = np.log10((self.counts + 0.1) / self.total)
            self.part = np.zeros(len(self.words))
            hashed = self.symbols[self.own :] - 1 - self.own
            self.part[self.own :] = np.log10((self.counts[self.own :] + 0.1) / self.shared_total(hashed))
        return self

    @property
    def total(self) -> float:
        return self.tokens + 0.1 * (self.distinct + 1)

    def shared_total(self, k: np.ndarray) -> np.ndarray:
        return self.shared_counts[k] + 0.1 * (self.shared_words[k] + 1)

    def symbol(self, word: bytes) -> int:
        return 1 + self.own + zlib.crc32(word) % len(self.shared_counts)

    def share(self) -> np.ndarray:
        """The corpus's own distribution over symbols."""
        c = np.concatenate([[self.ends], self.counts[: self.own], self.shared_counts]) + 0.1
        return c / c.sum()

    def read(self, text: bytes) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """Symbols with the end, places in the vocabulary (-1: not there) and the words not there."""
        words = text.lower().split()
        at = np.fromiter(map(self.index.get, words, repeat(-1)), np.int64, len(words))
        symbols = np.zeros(len(words) + 1, np.int32)
        symbols[:-1] = self.symbols[at] if len(self.symbols) else 0
        out = np.nonzero(at < 0)[0]
        rest = [words[k] for k in out.tolist()]
        symbols[out] = [self.symbol(w) for w in rest]
        return symbols, at, rest


def count_words(docs: DataFrame, text_col: str) -> DataFrame:
    """(word binary, n) over all rows of ``docs``; each task sums up what it reads before it sends it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])

        seen: Counter = Counter()
        for batch in slices(batches):
            for text in as_bytes(batch.column(0)):
                seen.update(text.lower().split())
            if len(seen) > 400_000:
                yield out()
                seen = Counter()
        yield out()

    arrow_rows(docs.sparkSession)
    rows = docs.select(F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(run, "word binary, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n"))


def vocabulary(counts: DataFrame, documents: int, own: int = OWN, known: int = KNOWN, shared: int = SHARED) -> tuple[Vocabulary, int, int]:
    """The vocabulary, and the least counts of words with symbols of their own and of words in it.

    Both bounds are read off a histogram of counts in steps of an eighth of an octave, so at most
    ``own`` and ``known`` words pass them at any size of corpus.
    """
    step = F.floor(F.log2("n") * 8).cast("int")
    rows = sorted((r["step"], r["words"], r["tokens"]) for r in counts.groupBy(step.alias("step")).agg(F.count("*").alias("words"), F.sum("n").alias("tokens")).collect())

    def least(most: int) -> int:
        bound, seen = 1 << 62, 0
        for s, words, _ in reversed(rows):
            seen += words
            if seen > most:
                break
            bound = s
        return bound

    at_own, at_known = least(own), least(known)
    got = counts.filter(step >= at_known).select("word", "n", (step >= at_own).alias("own")).toArrow()  # ``known`` rows at most
    words = sorted(zip(got.column("word").to_pylist(), got.column("n").to_pylist(), got.column("own").to_pylist(), strict=True), key=lambda x: (-x[2], -x[1], x[0]))
    n_own = sum(x[2] for x in words)
    held = np.zeros((2, shared), np.int64)
    slot = F.pmod(F.crc32("word"), F.lit(shared)).cast("int")
    for r in counts.filter(step < at_own).groupBy(slot.alias("slot")).agg(F.sum("n").alias("tokens"), F.count("*").alias("words")).collect():  # ``shared`` rows
        held[:, r["slot"]] = r["tokens"], r["words"]
    tokens, distinct = sum(r[2] for r in rows) + documents, sum(r[1] for r in rows) + (documents > 0)
    vocab = Vocabulary([x[0] for x in words], np.array([x[1] for x in words], np.int64), n_own, tokens, documents, distinct, held[0], held[1])
    return vocab, at_own, at_known


# ---- training and scoring --------------------------------------------------------------------------


def train(docs: DataFrame, text_col: str, vocab: Vocabulary, documents: int, *, states: int = STATES, rounds: int = ROUNDS, seed: int = 7, id_col: str = "doc_id") -> Model:
    spark = docs.sparkSession
    share, vocab = vocab.share(), vocab.ready()
    key = F.col(f"`{id_col}`").cast("string")
    few = docs.filter(thinned(key, documents, WARM_DOCS)).select(F.col(f"`{text_col}`").cast("string").alias("text"), F.xxhash64(key).alias("h"))
    picked = few.orderBy("h", F.length("text")).limit(WARM_DOCS)
    sample = [vocab.read((r["text"] or "").encode())[0] for r in picked.select("text").toLocalIterator()]
    model = warm_start(sample, share, states, WARM_ROUNDS, seed)
    sent_vocab = spark.sparkContext.broadcast(vocab)  # ``known`` words
    texts = docs.select(F.col(f"`{text_col}`").cast("string").alias("text"))
    names = [f"s{k}" for k in range(states)]
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast(Model(model.start.astype(np.float32), model.move.astype(np.float32), model.emit.astype(np.float32)))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            v, m = sent_vocab.value.ready(), sent.value
            n = len(m.emit)
            starts, moves, emits = np.zeros(states), np.zeros((states, states)), np.zeros((n, states))
            for batch in slices(batches, 1024):
                for part in groups([v.read(t)[0] for t in as_bytes(batch.column(0))]):
                    p = packed(part)
                    s, t, g = expected(m, p)
                    starts += s
                    moves += t
                    gather(emits, p.symbols, g)
            rows = np.nonzero(emits.any(axis=1))[0]
            key = np.concatenate([rows, n + np.arange(states), [n + states]])
            all_rows = np.concatenate([emits[rows], moves, starts[None]])
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), *(pa.array(c) for c in all_rows.T.astype(np.float32))], names=["at", *names])

        arrow_rows(spark)
        sums = texts.mapInArrow(run, "at long, " + ", ".join(f"{x} float" for x in names))
        got = sums.groupBy("at").agg(*(F.sum(F.col(x).cast("double")).alias(x) for x in names)).toArrow()  # a row a symbol
        table = np.zeros((len(share) + states + 1, states))
        table[got.column("at").to_numpy()] = np.stack([got.column(x).to_numpy() for x in names], axis=1)
        model = updated(table[-1], table[len(share) : -1], table[: len(share)], share)
        sent.unpersist()
    return model


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, held_out_mod: int = 10, states: int = STATES, rounds: int = ROUNDS, own: int = OWN, known: int = KNOWN, shared: int = SHARED) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row.

    Rows whose crc32 of the id (null: the empty text) is 0 mod ``held_out_mod`` are scored but not
    learned from. Null and empty texts are an end alone. Rows that repeat count and score each for
    itself. Without training rows every count is 0 and the model is uniform. Other columns are not read.
    """
    spark = docs.sparkSession
    held = (crc_mod(id_col, held_out_mod) == 0).alias("held_out")
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"), held)
    learned = rows.filter(~F.col("held_out"))
    counts = materialize(count_words(learned, "text"), "words")
    documents = learned.select("doc_id").count()
    vocab, _, at_known = vocabulary(counts, documents, own, known, shared)
    model = train(learned, "text", vocab, documents, states=states, rounds=rounds)
    sent = spark.sparkContext.broadcast((vocab, model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, m = sent.value
        v = vocab.ready()
        end = np.log10((v.ends + 0.1) / v.total)
        for batch in slices(batches, 1024):
            docs, cols, rare = [], [[], [], [], []], []
            for text in as_bytes(batch.column(1)):
                symbols, at, rest = v.read(text)
                docs.append(symbols)
                at = at[at >= 0]
                for c, x in zip(cols, (len(symbols), len(at) + (v.ends > 0), end + (v.base[at].sum() if len(at) else 0.0), v.part[at].sum() if len(at) else 0.0), strict=True):
                    c.append(x)
                rare.append(rest)
            ll, done = np.zeros(len(docs)), 0
            for part in groups(docs):
                p = packed(part)
                ll[done + p.order] = forward(m, p)
                done += len(part)
            ll = ll / np.log(10) + np.array(cols[3])
            arrays = [batch.column(0), batch.column(2), *(pa.array(c, t) for c, t in zip(cols[:3], (pa.int64(), pa.int64(), pa.float64()), strict=True)), pa.array(ll), pa.array(rare, pa.list_(pa.binary()))]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "rare"])

    arrow_rows(spark)
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double, rare array<binary>"
    said = materialize(rows.mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id()), "scored")
    low = counts.filter(F.floor(F.log2("n") * 8).cast("int") < at_known).select("word", "n")
    slots = spark.createDataFrame([(k, float(x)) for k, x in enumerate(vocab.shared_total(np.arange(shared)))], "slot int, total double")
    words = said.select("row", F.explode("rare").alias("word")).groupBy("row", "word").agg(F.count("*").alias("times"))
    c = F.coalesce("n", F.lit(0)) + F.lit(0.1)
    joined = words.join(low, "word", "left").withColumn("slot", F.pmod(F.crc32("word"), F.lit(shared)).cast("int")).join(F.broadcast(slots), "slot")
    added = joined.groupBy("row").agg(
        F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("more"),
        F.sum(F.col("times") * F.log10(c / F.lit(float(vocab.total)))).alias("base"),
        F.sum(F.col("times") * F.log10(c / F.col("total"))).alias("part"),
    )
    zero = lambda c: F.coalesce(c, F.lit(0))
    return said.drop("rare").join(added, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + zero("more")).alias("n_known"),
        F.lit(vocab.tokens).cast("long").alias("train_tokens"),
        (F.col("base_score") + zero("base")).alias("base_score"),
        (F.col("score") + zero("part")).alias("score"),
    )
