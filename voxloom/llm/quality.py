"""Quality rules kept as a ledger of failure bits.

``ledger`` evaluates every rule once and stores, for each document, its measurements and one bit
for each rule that it fails. Policies are versioned sets of rules; applying one, comparing two or
asking what a rule alone costs are bitwise operations on the stored bits, without the texts.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxloom.llm.common import arrow_rows, as_bytes, slices

#: Characters that count as symbols.
SYMBOLS = b"#*$%&|<>"
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]

#: Each rule holds where a document fails it. A rule's bit is its place here and never changes.
RULES: dict[str, Callable[[dict[str, Column]], Column]] = {
    "few_words": lambda m: m["n_words"] < 50,
    "repeated_words": lambda m: 100 * m["n_repeat_words"] > 50 * m["n_words"],
    "symbols": lambda m: 10 * m["n_symbols"] > m["n_words"],
    "repeated_lines": lambda m: 2 * m["n_dup_lines"] > m["n_lines"],
    "word_length_low": lambda m: m["word_chars"] < 3 * m["n_words"],
    "word_length_high": lambda m: m["word_chars"] > 12 * m["n_words"],
}
#: Version -> the rules that reject.
POLICIES: dict[str, tuple[str, ...]] = {
    "base-1": ("few_words", "repeated_words"),
    "web-1": ("few_words", "repeated_words", "symbols", "repeated_lines", "word_length_low", "word_length_high"),
}


def bit(rule: str) -> int:
    return 1 << list(RULES).index(rule)


def mask(rules: tuple[str, ...]) -> int:
    return sum(bit(r) for r in dict.fromkeys(rules))


def repeated(words: list[bytes]) -> int:
    """Words that lie in a window of three found twice or more in ``words``."""
    windows = list(zip(words, words[1:], words[2:], strict=False))
    found = Counter(windows)
    if len(found) == len(windows):
        return 0
    twice = np.fromiter((found[x] > 1 for x in windows), bool, len(windows))
    inside = np.zeros(len(words), bool)
    for k in range(3):
        inside[k : k + len(twice)] |= twice
    return int(inside.sum())


def measure(text: bytes) -> tuple[int, ...]:
    """The measurements of one whole text, in the order of MEASURES."""
    words = text.split()
    lines = [x for x in text.split(b"\n") if not x.isspace() and x] if b"\n" in text else [text] * bool(words)
    return (
        len(words),
        len(b"".join(words).decode("utf-8", "replace")),
        len(text) - len(text.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated(words),
        len(lines),
    )


def measurements(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """doc_id (or the columns of ``keep``) and the measurements; null text counts as empty."""
    names = keep if keep is not None else [id_col]
    out = [f"k{i}" for i in range(len(names))] if keep is not None else ["doc_id"]
    rows = docs.select(*(F.col(f"`{n}`").alias(o) for n, o in zip(names, out, strict=True)), F.col(f"`{text_col}`").cast("string").alias("body"))
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            cols = zip(*map(measure, as_bytes(batch.column(len(out)))), strict=True)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(out)], *(pa.array(c, pa.int64()) for c in cols)], names=[*out, *MEASURES])

    arrow_rows(docs.sparkSession)
    return rows.mapInArrow(run, f"{fields}, " + ", ".join(f"{x} long" for x in MEASURES))


def fail_bits() -> Column:
    bits, m = F.lit(0).cast("long"), {x: F.col(x) for x in MEASURES}
    for rule, fails in RULES.items():
        bits = bits.bitwiseOR(F.when(fails(m), F.lit(bit(rule))).otherwise(F.lit(0)).cast("long"))
    return bits


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """One row a document: its measurements and ``fail_bits``.

    Null and empty texts measure 0 and fail ``few_words``; rows that repeat keep a row each; other
    columns take no part; an empty table gives an empty ledger.
    """
    return measurements(docs, id_col, text_col, keep).withColumn("fail_bits", fail_bits())


def passes(version: str = "web-1", bits: str = "fail_bits") -> Column:
    return F.col(bits).bitwiseAND(F.lit(mask(POLICIES[version]))) == 0


def apply_policy(rows: DataFrame, version: str = "web-1") -> DataFrame:
    """The ledger with ``kept`` by the policy and ``policy``, its version."""
    return rows.withColumns({"kept": passes(version), "policy": F.lit(version)})


def ablations(rows: DataFrame, version: str = "web-1") -> DataFrame:
    """For each rule of a policy: how many documents fail it, fail it alone, and would be kept without it.

    One pass counts the distinct bit patterns, at most two to the number of rules; the rest is on them.
    """
    rules, all_bits = POLICIES[version], mask(POLICIES[version])
    seen = rows.groupBy(F.col("fail_bits").bitwiseAND(F.lit(all_bits)).alias("bits")).agg(F.count("*").alias("n"))
    each = F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), F.lit(bit(r)).alias("bit")) for r in rules))).alias("r")
    return (
        seen.select("bits", "n", each)
        .groupBy(F.col("r.rule").alias("rule"))
        .agg(
            F.sum(F.when(F.col("bits").bitwiseAND(F.col("r.bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
            F.sum(F.when(F.col("bits") == F.col("r.bit"), F.col("n")).otherwise(0)).alias("n_failed_alone"),
            F.sum(F.when(F.col("bits").bitwiseAND(F.lit(all_bits) - F.col("r.bit")) == 0, F.col("n")).otherwise(0)).alias("n_kept_without"),
        )
    )


def filter_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", version: str = "web-1") -> DataFrame:
    """The rows that the policy keeps, with the same columns, whatever their names.

    Null, empty and blank texts have no word and go; rows that repeat stay or go together; texts are measured
    whole; an empty table gives no row.
    """
    rows = ledger(docs, id_col, text_col, keep=docs.columns + [text_col])
    names = docs.columns
    return apply_policy(rows, version).filter("kept").select(*(F.col(f"k{i}").alias(n) for i, n in enumerate(names)))


