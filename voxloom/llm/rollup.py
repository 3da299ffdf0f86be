"""Token counts kept up by signed deltas.

A store holds a ledger of signed rows by document and their sums by source, language and tokenizer
version. A batch of inserts, deletes and revisions adds rows: what a document counted before, with
a minus, and what it counts now. Totals are sums of the batches' sums, never recounted.

A batch is written under its id, its ledger rows first, then their sums, then a commit row; only
committed batches are read. Committing an id again changes nothing, and a batch that was cut
short is overwritten when it is run again.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.llm.common import arrow_rows, as_bytes, materialize, slices
from voxloom.llm.packing import TOKENIZER, WordIds, tokenizer_path

KEYS = ["source", "lang", "tokenizer"]
LEDGER = "doc_id string, source string, lang string, tokenizer string, docs long, tokens long"
#: The ledger is sorted by parts, a hash of the document; a batch reads only row groups of those that it touches.
PARTS = 64
TOTALS = "source string, lang string, tokenizer string, docs long, tokens long"


def count_tokens(rows: DataFrame, path: str) -> DataFrame:
    """``rows`` with their column ``text`` (the last) replaced by ``tokens``; null text has none."""
    names = rows.columns[:-1]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = WordIds(path)
        for batch in slices(batches):
            n = [len(ids) // 4 for ids in encode(as_bytes(batch.column(len(names))))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(n, pa.int64())], names=[*names, "tokens"])

    arrow_rows(rows.sparkSession)
    return rows.mapInArrow(run, f"{fields}, tokens long")


class TokenRollup:
    """A store below ``root``, a folder that all executors share."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _exists(self, path: str) -> bool:
        jvm = self.spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)

    def committed(self) -> list[str]:
        if not self._exists(f"{self.root}/commits"):
            return []
        return sorted(r["batch"] for r in self.spark.read.schema("batch string").parquet(f"{self.root}/commits/*").collect())

    def _read(self, what: str, schema: str) -> DataFrame:
        paths = [f"{self.root}/{what}/{b}" for b in self.committed()]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def commit(self, batch: str, changes: DataFrame, tokenizer: str = TOKENIZER, path: str | None = None) -> bool:
        """Apply a batch once; False if it was committed before.

        ``changes`` has op ("insert", "delete" or "revise"), doc_id, source, lang, text and, where a
        batch may hold several changes of a document, ``seq``: the greatest holds, ties to a delete
        last of all. An insert of a known document revises it; a delete of an unknown one does
        nothing; other ops raise an error. A null id is a document of its own; null source and lang are
        groups of their own; null text has no token. Rows that repeat are one change.
        """
        if not batch or "/" in batch:
            raise ValueError("a batch id is a file name")
        if batch in self.committed():
            return False
        seq = F.col("seq").cast("long") if "seq" in changes.columns else F.lit(0).cast("long")
        op = F.when(F.col("op").isin("insert", "delete", "revise"), F.col("op")).otherwise(F.raise_error(F.concat(F.lit("unknown op: "), F.coalesce("op", F.lit("null")))))
        text = F.when(F.col("op") != "delete", F.col("text").cast("string"))
        rows = changes.select(F.col("doc_id").cast("string").alias("doc_id"), seq.alias("seq"), (op != "delete").alias("stays"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), text.alias("text"))
        last = F.max(F.struct("seq", "stays", "source", "lang", "tokens")).alias("c")
        now = count_tokens(rows, path or tokenizer_path(tokenizer)).groupBy("doc_id").agg(last)
        now = materialize(now.select("doc_id", "c.stays", "c.source", "c.lang", "c.tokens"), "changes")
        part = F.pmod(F.xxhash64("doc_id"), F.lit(PARTS)).cast("int")
        touched = [r["part"] for r in now.select(part.alias("part")).distinct().collect()]  # PARTS at most
        held = self._read("ledger", f"{LEDGER}, part int").filter(F.col("part").isin(touched)).alias("held")
        held = held.join(now.select(F.col("doc_id").alias("changed")), F.col("held.doc_id").eqNullSafe(F.col("changed")), "left_semi")
        held = held.groupBy("doc_id", *KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).filter("docs <> 0 OR tokens <> 0")
        minus = held.select("doc_id", *KEYS, (-F.col("docs")).alias("docs"), (-F.col("tokens")).alias("tokens"))
        plus = now.filter("stays").select("doc_id", "source", "lang", F.lit(tokenizer).alias("tokenizer"), F.lit(1).cast("long").alias("docs"), "tokens")
        ledger = f"{self.root}/ledger/{batch}"
        minus.unionByName(plus).withColumn("part", part).repartition("part").sortWithinPartitions("part").write.mode("overwrite").parquet(ledger)
        rows = self.spark.read.schema(f"{LEDGER}, part int").parquet(ledger)
        sums = rows.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        sums.write.mode("overwrite").parquet(f"{self.root}/totals/{batch}")
        self.spark.createDataFrame([(batch,)], "batch string").coalesce(1).write.mode("overwrite").parquet(f"{self.root}/commits/{batch}")
        return True

    def totals(self) -> DataFrame:
        """docs and tokens by source, lang and tokenizer; groups that are empty by now are left out."""
        sums = self._read("totals", TOTALS).groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        return sums.filter("docs <> 0 OR tokens <> 0")


def rollup_by_batches(docs: DataFrame, root: str) -> TokenRollup:
    """Bring all of ``docs`` into a new store: two batches of inserts, one of them sent twice, then a tenth deleted and brought back.

    A document is known by its id and what it holds, so rows that share an id or have none count each for
    itself unless they are equal in id, source, lang and text; equal rows are one document. Null source
    and lang are groups of their own, null and empty texts have no token, texts are read whole, an empty
    table gives empty totals, and other columns are not read.
    """
    store = TokenRollup(docs.sparkSession, root)
    rows = docs.select("doc_id", "source", "lang", "text")
    held = F.sha2(F.to_json(F.struct("source", "lang", "text")).cast("binary"), 256)
    rows = rows.withColumn("doc_id", F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), held))
    part = F.pmod(F.xxhash64("doc_id"), F.lit(10))
    store.commit("insert-0", rows.filter(part < 5).withColumn("op", F.lit("insert")))
    store.commit("insert-1", rows.filter(part >= 5).withColumn("op", F.lit("insert")))
    store.commit("insert-0", rows.filter(part < 5).withColumn("op", F.lit("insert")))
    store.commit("delete-0", rows.filter(part == 3).withColumn("op", F.lit("delete")))
    store.commit("insert-2", rows.filter(part == 3).withColumn("op", F.lit("insert")))
    return store
