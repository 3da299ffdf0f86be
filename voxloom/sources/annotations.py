"""Annotation files in the long TextGrid text format, as a table of intervals.

``read_tiers`` scans whole files with Spark's text reader and cuts them by expressions;
``register`` adds the Python data source ``textgrid`` for use by name. Both give one row an interval,
so the choice of a tier is a filter.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from voxloom.schemas import INTERVAL, TIER

NUMBER = r"([-+0-9.eE]+)"
ITEM = r'item \[\d+\]:\s*class = "IntervalTier"\s*name = "((?:[^"]|"")*)"'
SPAN = rf'intervals \[\d+\]:\s*xmin = {NUMBER}\s*xmax = {NUMBER}\s*text = "((?:[^"]|"")*)"'


def read_tiers(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """(path, tier_idx, tier_name, interval_idx, xmin, xmax, text) of all files below ``path``, from 0.

    Only interval tiers count. Files in another format give no row.
    """
    if encoding.upper().replace("-", "") == "UTF8":
        files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("body"))
    else:
        files = spark.read.format("binaryFile").load(path).select("path", F.decode("content", F.lit(encoding)).alias("body"))
    parts = F.split(F.regexp_replace("body", r"item \[\d+\]:", "\u0001$0"), "\u0001")
    numbered = files.select("path", F.posexplode(F.filter(parts, lambda x: x.rlike(r'^item \[\d+\]:\s*class = "IntervalTier"'))).alias("tier_idx", "item"))
    unquote = lambda c: F.replace(c, F.lit('""'), F.lit('"'))
    named = numbered.select("path", F.col("tier_idx").cast("int").alias("tier_idx"), unquote(F.regexp_extract("item", ITEM, 1)).alias("tier_name"), F.regexp_extract_all("item", F.lit(SPAN), F.lit(0)).alias("spans"))
    rows = named.select("path", "tier_idx", "tier_name", F.posexplode("spans").alias("interval_idx", "span"))
    get = lambda k: F.regexp_extract("span", SPAN, k)
    return rows.select("path", "tier_idx", "tier_name", F.col("interval_idx").cast("int").alias("interval_idx"), get(1).cast("double").alias("xmin"), get(2).cast("double").alias("xmax"), unquote(get(3)).alias("text"))


def read_intervals(spark: SparkSession, path: str, tier_idx: int) -> DataFrame:
    """The intervals of one tier; negative numbers count from the last tier of each file."""
    rows = read_tiers(spark, path)
    if tier_idx >= 0:
        return rows.filter(F.col("tier_idx") == tier_idx)
    from pyspark.sql import Window as W

    last = F.max("tier_idx").over(W.partitionBy("path"))
    return rows.withColumn("_last", last).filter(F.col("tier_idx") == F.col("_last") + 1 + tier_idx).drop("_last")


def generated_syllables(spark: SparkSession) -> DataFrame:
    """Syllables made from a phone tier are not defined: an empty table."""
    return spark.createDataFrame([], INTERVAL)


def parse(body: str) -> Iterator[tuple[int, str, int, float, float, str]]:
    """The same rows of one file's text."""
    items = [x for x in re.split(r"(?=item \[\d+\]:)", body) if re.match(r'item \[\d+\]:\s*class = "IntervalTier"', x)]
    for k, item in enumerate(items):
        name = re.match(ITEM, item)
        for n, (a, b, text) in enumerate(re.findall(SPAN, item)):
            yield k, name[1].replace('""', '"') if name else "", n, float(a), float(b), text.replace('""', '"')


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, pattern: str, encoding: str):
        self.pattern, self.encoding = pattern, encoding

    def partitions(self) -> list[_File]:
        import glob

        return [_File(p) for p in sorted(glob.glob(self.pattern, recursive=True)) or [self.pattern]]

    def read(self, partition: _File) -> Iterator[tuple]:
        with open(partition.path, encoding=self.encoding) as f:
            for row in parse(f.read()):
                yield (partition.path, *row)


class TextGridSource(DataSource):
    """``spark.read.format("textgrid").load(pattern)`` for paths that every worker can open."""

    @classmethod
    def name(cls) -> str:
        return "textgrid"

    def schema(self) -> str:
        return TIER

    def reader(self, schema: object) -> _Reader:
        return _Reader(self.options["path"], self.options.get("encoding", "utf-8"))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(TextGridSource)
