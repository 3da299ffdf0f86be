"""WARC archives of pages, and their index by an external merge of sorted runs.

Writing: pages with equal payloads of at least a given size are stored once, as the response with the
smallest id; the others become revisits that refer to it. Records go out through Spark's text
writer, whose line separator is the two empty lines that end a record, so every file is a plain
WARC file on whatever storage Spark writes to.

Reading: each archive file is parsed by the lengths in its headers. Its captures, sorted by URL key
and timestamp, are one run. Runs are cut at common keys into ranges, and a loser tree merges the
slices of all runs in each range, so the ranges one after another are the globally ordered index.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from urllib.parse import parse_qsl, urlencode, urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.llm.common import arrow_rows, materialize, shared_path

LEAST, END = 100, "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bytes of pages that a file holds, about.
FILE_BYTES = 16 << 20


# ---- writing -------------------------------------------------------------------------------------


def record_id(page: Column, digest: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page.cast("string"), F.lit("none")), F.lit(":"), F.substring(digest, 1, 16), F.lit(">"))


def plan_records(pages: DataFrame, id_col: str, url_col: str, html_col: str, time: Column | None, least: int) -> DataFrame:
    """Every page with its payload's size and digest, and the id of the response it refers to, if any."""
    html = F.coalesce(F.col(f"`{html_col}`").cast("string"), F.lit(""))
    stamp = F.lit(0).cast("timestamp") if time is None else F.coalesce(time, F.lit(0).cast("timestamp"))
    rows = pages.select(F.col(f"`{id_col}`").alias("page_id"), F.coalesce(F.col(f"`{url_col}`").cast("string"), F.lit("")).alias("url"), html.alias("html"), stamp.alias("time"))
    rows = rows.withColumns({"payload_bytes": F.octet_length("html").cast("long"), "payload_digest": F.sha2(F.col("html").cast("binary"), 256)})
    slim = rows.filter(F.col("payload_bytes") >= least).select("page_id", "payload_digest")
    first = materialize(slim.groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1"), "first-payloads").drop("n")
    # the pairs are small and adaptive execution splits a payload that most pages share
    later = slim.join(first, "payload_digest").filter("page_id > first OR page_id IS NULL").distinct()
    later = materialize(later, "revisits").withColumnsRenamed({"page_id": "p", "payload_digest": "d", "first": "refers_to"})
    same = F.col("page_id").eqNullSafe(F.col("p")) & (F.col("payload_digest") == F.col("d"))
    return rows.join(later, same, "left").drop("p", "d")


def records(rows: DataFrame) -> DataFrame:
    """One WARC record a row, without the empty lines that end it."""
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    revisit = F.col("refers_to").isNotNull()
    url = F.regexp_replace("url", r"[\x00-\x20\x7F]", "_")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"), line("Content-Length", F.col("payload_bytes").cast("string")), F.lit("\r\n"))
    size = F.octet_length(http) + F.when(revisit, 0).otherwise(F.octet_length("html"))
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", record_id(F.col("page_id"), F.col("payload_digest"))),
        line("WARC-Date", F.concat(F.translate(F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00' + make_dt_interval(0, 0, 0, unix_seconds(time))").cast("string"), " ", "T"), F.lit("Z"))),  # UTC in any session
        line("WARC-Target-URI", url),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("payload_digest"))),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", record_id(F.col("refers_to"), F.col("payload_digest"))))).otherwise(""),
        F.lit("Content-Type: application/http;msgtype=response\r\n"),
        line("Content-Length", size.cast("string")),
        F.lit("\r\n"),
    )
    return rows.select(F.concat(head, http, F.when(revisit, "").otherwise(F.col("html"))).alias("value"))


def write_archive(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", *, time: Column | None = None, least: int = LEAST, file_bytes: int = FILE_BYTES) -> None:
    """Write a record for every page as WARC files below ``path``.

    A null html is an empty payload, a null url an empty one, a null time 1970. Control characters
    and blanks in a url become underscores. Of rows that repeat with one id, all are the response;
    rows without an id never are one that others refer to. An empty table writes no record.
    """
    size = pages.select(F.avg(F.octet_length(F.col(f"`{html_col}`")) + 600)).first()[0] or 1
    rows = plan_records(pages, id_col, url_col, html_col, time, least)
    # records leave the tasks that read or joined their pages; only a file's number of records is bounded
    records(rows).write.option("lineSep", END).option("maxRecordsPerFile", max(1, int(file_bytes // size))).text(path)


# ---- reading -------------------------------------------------------------------------------------


def url_key(url: str) -> str:
    """The host's parts from the last to the first, then path and sorted query; without www, port 80 or 443, fragment and case."""
    try:
        at = urlsplit(url.strip())
        host, port = at.hostname or "", at.port
    except ValueError:
        return url.strip().lower()
    parts = host.lower().split(".")
    if len(parts) > 2 and parts[0] == "www":
        parts = parts[1:]
    query = urlencode(sorted(parse_qsl(at.query, keep_blank_values=True)))
    return ",".join(reversed(parts)) + (f":{port}" if port and port not in (80, 443) else "") + ")" + (at.path.lower() or "/") + (f"?{query.lower()}" if query else "")


def parse(content: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """Offset, length, headers and block of each record of a WARC file."""
    at = 0
    while at < len(content):
        end = content.index(b"\r\n\r\n", at)
        first, *lines = content[at:end].decode("utf-8", "replace").split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError(f"no WARC record at {at}")
        head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        size = int(head["content-length"])
        block = content[end + 4 : end + 4 + size]
        if len(block) != size or content[end + 4 + size : end + 8 + size] != b"\r\n\r\n":
            raise ValueError(f"the record at {at} is cut short")
        yield at, end + 8 + size - at, head, block
        at = end + 8 + size


def capture(head: dict[str, str], block: bytes) -> tuple:
    """What the index says of a record; a response's payload is measured, a revisit's taken from its headers."""
    http, _, payload = block.partition(b"\r\n\r\n")
    told = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in http.decode("utf-8", "replace").split("\r\n")[1:])}
    page = lambda text: None if (p := text.split(":")[2]) == "none" else int(p)
    digest, refers = head["warc-payload-digest"].removeprefix("sha256:"), None
    if head["warc-type"] == "response":
        if hashlib.sha256(payload).hexdigest() != digest:
            raise ValueError(f"the payload of {head['warc-record-id']} does not match its digest")
        size = len(payload)
    else:
        size, refers = int(told["content-length"]), page(head["warc-refers-to"])
    return url_key(head["warc-target-uri"]), head["warc-date"], page(head["warc-record-id"]), head["warc-target-uri"], head["warc-type"], refers, size, digest


#: Captures that a task merges at a time.
RANGE_ROWS = 100_000
FIELDS = {
    "url_key": pa.string(), "timestamp": pa.string(), "page_id": pa.int64(), "url": pa.string(), "record_type": pa.string(),
    "refers_to": pa.int64(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "offset": pa.int64(), "length": pa.int64(), "file": pa.string(),
}
INDEX = "url_key string, timestamp string, page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, offset long, length long, file string"


def order(row: tuple) -> tuple:
    """Captures by URL key, timestamp, page (null first), and place in the archive."""
    return row[0], row[1], row[2] is not None, row[2] or 0, row[10], row[8]


def runs(spark: SparkSession, path: str) -> DataFrame:
    """The captures of every archive file, sorted within it: one run a file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1), strict=True):
                rows = [(*capture(head, block), at, size, name.as_py()) for at, size, head, block in parse(content.as_py())]
                rows.sort(key=order)
                for at in range(0, len(rows), 8192):
                    cols = list(zip(*rows[at : at + 8192], strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, FIELDS.values(), strict=True)], names=list(FIELDS))

    arrow_rows(spark)  # a file at a time
    found = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return found.select("path", "content").mapInArrow(run, INDEX)


# ---- merging -------------------------------------------------------------------------------------


def merge_runs(parts: list[list[tuple]]) -> Iterator[tuple]:
    """Merge sorted runs with a loser tree.

    Leaves are the runs' heads; each inner node keeps the run that lost there, node 0 the winner.
    When the winner's next head is put in, it plays only the losers between its leaf and the root.
    """
    k = len(parts)
    if not k:
        return
    heads = [iter(p) for p in parts]
    now = [next(h, None) for h in heads]
    keys = [None if x is None else order(x) for x in now]

    def beats(a: int, b: int) -> bool:
        if keys[a] is None or keys[b] is None:
            return keys[b] is None and (keys[a] is not None or a < b)
        return (keys[a], a) < (keys[b], b)

    losers = [-1] * k
    for run in range(k):
        player, node = run, (run + k) // 2
        while node and losers[node] >= 0:
            if beats(losers[node], player):
                player, losers[node] = losers[node], player
            node //= 2
        losers[node] = player
    while now[winner := losers[0]] is not None:
        yield now[winner]
        now[winner] = next(heads[winner], None)
        keys[winner] = None if now[winner] is None else order(now[winner])
        player, node = winner, (winner + k) // 2
        while node:
            if beats(losers[node], player):
                player, losers[node] = losers[node], player
            node //= 2
        losers[0] = player


def merge_index(found: DataFrame, ranges: int | None = None) -> DataFrame:
    """All captures in global order: ``part`` numbers the ranges, ``place`` the captures within one.

    Ranges are cut by URL key, timestamp, page and file, so a page or host captured over and over is
    spread over several; the slice of a run in a range keeps the run's order by its ``place``. There are
    as many ranges as keep one near RANGE_ROWS captures, which is what the task that merges it holds.
    """
    spark = found.sparkSession
    n = ranges or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-found.count() // RANGE_ROWS))
    dealt = found.repartitionByRange(n, "url_key", "timestamp", F.col("page_id").asc_nulls_first(), "file", "offset")
    dealt = dealt.sortWithinPartitions("file", "url_key", "timestamp", F.col("page_id").asc_nulls_first(), "offset")  # slices of runs, one after another

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slices: dict[str, list[tuple]] = {}
        part = 0
        for batch in batches:
            cols = [c.to_pylist() for c in batch.columns]
            for row in zip(*cols[:-1], strict=True):
                slices.setdefault(row[10], []).append(row)
            part = cols[-1][0] if cols[-1] else part
        held = []
        for place, row in enumerate(merge_runs(list(slices.values()))):
            held.append((*row, part, place))
            if len(held) == 8192:
                yield batch_of(held)
                held = []
        if held:
            yield batch_of(held)

    types = [*FIELDS.values(), pa.int32(), pa.int64()]
    batch_of = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=[*FIELDS, "part", "place"])
    arrow_rows(spark)
    return dealt.withColumn("part", F.spark_partition_id()).mapInArrow(run, INDEX + ", part int, place long")


def archive_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", *, time: Column | None = None, path: str | None = None) -> DataFrame:
    """Write the pages to an archive, read it back and return its merged index.

    Rows are taken as ``write_archive`` takes them, each is one capture, and payloads of any length are
    written and read whole; an empty table gives no row. Other columns are not read.
    """
    spark = pages.sparkSession
    path = path or shared_path(spark, "archive")
    write_archive(pages, path, id_col, url_col, html_col, time=time)
    return merge_index(materialize(runs(spark, path), "runs"))
