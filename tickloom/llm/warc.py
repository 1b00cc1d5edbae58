"""WARC archives of pages, and an index of captures merged from locally sorted runs.

Records are built with built-in functions and written by Spark's text writer: the record separator
of the format (two line ends) is the line separator of the writer, so its commit protocol holds for
the archives too. Equal payloads are stored once; the others are revisit records. Reading gives one
sorted run of captures per batch of archives; runs are dealt by ranges of (URL key, time) and each
range merges its runs with a loser tree, so that ranges in order are the ordered capture history.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import or_empty, run_folder, written

#: Payloads of fewer bytes are always stored.
LEAST_BYTES = 1000
#: Records of an archive file; a file is read as a whole.
RECORDS = 5000
END = "\r\n"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

CAPTURE = T.StructType(
    [
        T.StructField("url_key", T.StringType()), T.StructField("captured", T.StringType()), T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()),
        T.StructField("record_type", T.StringType()), T.StructField("refers_to", T.LongType()), T.StructField("payload_bytes", T.LongType()), T.StructField("payload_digest", T.StringType()),
        T.StructField("file", T.StringType()), T.StructField("record_at", T.LongType()), T.StructField("record_bytes", T.LongType()),
    ]
)


def typed(pages: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """``page_id``, ``url``, ``payload``, ``payload_bytes``, ``payload_digest``, ``refers_to``.

    Of equal payloads of ``least`` bytes or more, the largest id is stored and the rest refer to it.
    Rows that share that id are all stored; without any id, all rows are. NULL payloads are empty.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", or_empty("html").alias("payload"))
    rows = rows.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("payload_digest", F.sha1("payload"))
    groups = rows.where(F.col("payload_bytes") >= least).groupBy("payload_digest").agg(F.max("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1")
    groups = written(groups.select(F.col("payload_digest").alias("group_digest"), "first_id"), "equal-payloads")  # its size decides on a broadcast
    joined = rows.join(groups, (F.col("payload_digest") == F.col("group_digest")) & (F.col("payload_bytes") >= least), "left")
    refers = F.when(F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id")), F.col("first_id"))
    return joined.withColumn("refers_to", refers).drop("group_digest", "first_id")


def record(rows: DataFrame) -> Column:
    """The text of a record, without the two line ends that close it."""
    header = lambda name, value: F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value, F.lit(END))).otherwise("")
    stored = F.col("refers_to").isNull()
    url = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    # The table has no capture time: one second per id from a fixed start.
    time = F.date_format(F.timestamp_seconds(F.lit(1_700_000_000) + F.pmod(F.coalesce("page_id", F.lit(0)), F.lit(10**9))), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    name = lambda c: F.concat(F.lit("<urn:page:"), c.cast("string"), F.lit(">"))
    return F.concat(
        F.lit("WARC/1.1" + END),
        header("WARC-Type", F.when(stored, "response").otherwise("revisit")),
        header("WARC-Record-ID", name(F.col("page_id"))),
        header("WARC-Target-URI", url),
        header("WARC-Date", time),
        header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        header("WARC-Refers-To", name(F.col("refers_to"))),
        header("WARC-Profile", F.when(~stored, REVISIT)),
        header("X-Payload-Length", F.col("payload_bytes").cast("string")),
        header("Content-Type", F.when(stored, "text/html; charset=utf-8")),
        header("Content-Length", F.when(stored, F.col("payload_bytes")).otherwise(0).cast("string")),
        F.lit(END),
        F.when(stored, F.col("payload")).otherwise(""),
    )


def write(pages: DataFrame, folder: str, least: int = LEAST_BYTES, records: int = RECORDS) -> None:
    """Archives of all pages below a folder, one record per row."""
    rows = typed(pages, least)
    rows.select(record(rows).alias("value")).write.option("lineSep", END + END).option("maxRecordsPerFile", records).text(folder)


HEAD = re.compile(rb"^([^:\r\n]+): ([^\r\n]*)\r$", re.M)


def records_of(raw: bytes) -> Iterator[tuple[int, int, dict[bytes, bytes], bytes]]:
    """Place, length, headers and body of each record of an archive."""
    at = 0
    while at < len(raw):
        stop = raw.index(b"\r\n\r\n", at)
        head = dict(HEAD.findall(raw[at : stop + 1]))
        body = stop + 4
        end = body + int(head[b"Content-Length"])
        if raw[end : end + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at {at} does not end where its length says")
        yield at, end + 4 - at, head, raw[body:end]
        at = end + 4


def url_key(url: str | None) -> str:
    """The key captures are ordered by: host labels from the right, then path and query, lower-cased."""
    if not url:
        return ""
    try:
        parts = urlsplit(url.strip())
        host = parts.hostname or ""
    except ValueError:  # not a URL
        return url.lower()
    host = host.removeprefix("www.")
    return ",".join(reversed(host.split("."))) + ")" + (parts.path or "/").lower() + (f"?{parts.query.lower()}" if parts.query else "")


def _id(value: bytes | None) -> int | None:
    found = re.search(rb"urn:page:(-?\d+)", value or b"")
    return int(found[1]) if found else None


def captures(spark: SparkSession, folder: str) -> DataFrame:
    """The captures of all archives as sorted runs: ``run``, ``nth``, and the columns of ``CAPTURE``.

    The digest and size of a stored payload are taken from the payload read; of a revisit, from its headers.
    """
    schema = T.StructType([T.StructField("run", T.LongType()), T.StructField("nth", T.LongType()), *CAPTURE])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            rows = []
            for path, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for at, size, head, body in records_of(raw.as_py()):
                    url = head.get(b"WARC-Target-URI")
                    url = None if url is None else url.decode()
                    kind, digest = head[b"WARC-Type"].decode(), head[b"WARC-Payload-Digest"].decode().removeprefix("sha1:")
                    if kind == "response":
                        found = hashlib.sha1(body).hexdigest()
                        if found != digest:
                            raise ValueError(f"{path}: the payload at {at} is not the one written")
                        length = len(body)
                    else:
                        length = int(head[b"X-Payload-Length"])
                    rows.append((url_key(url), head[b"WARC-Date"].decode(), _id(head.get(b"WARC-Record-ID")), url, kind, _id(head.get(b"WARC-Refers-To")), length, digest, path.rsplit("/", 1)[-1], at, size))
            rows.sort(key=order)
            columns = zip(*rows, strict=True) if rows else [[] for _ in CAPTURE]
            arrays = [pa.array(list(c), t) for c, t in zip(columns, ARROW, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([number] * len(rows), pa.int64()), pa.array(range(len(rows)), pa.int64()), *arrays], schema.names)
            number += 1

    return spark.read.format("binaryFile").load(folder).select("path", "content").mapInArrow(run, schema)


ARROW = [pa.int64() if f.dataType == T.LongType() else pa.string() for f in CAPTURE]


def order(row: Sequence) -> tuple:
    """Captures go by URL key, time, id (none first), file and place."""
    return row[0], row[1], row[2] is not None, row[2] or 0, row[8], row[9]


class LoserTree:
    """Merges sorted runs: an inner node holds the run that lost there, so one path is replayed per row."""

    def __init__(self, runs: list[list[tuple]]):
        self.runs, self.at = runs, [0] * len(runs)
        self.keys = [order(r[0]) if r else None for r in runs]
        self.losers = [-1] * len(runs)
        for run in range(len(runs)):
            self._replay(run, filling=True)

    def _before(self, x: int, y: int) -> bool:
        kx, ky = self.keys[x], self.keys[y]
        return kx is not None and (ky is None or (kx, x) < (ky, y))

    def _replay(self, run: int, filling: bool = False) -> None:
        node = (run + len(self.runs)) // 2
        while node > 0:
            other = self.losers[node]
            if other < 0 and filling:
                self.losers[node] = run
                return
            if self._before(other, run):
                self.losers[node], run = run, other
            node //= 2
        self.losers[0] = run

    def __iter__(self) -> Iterator[tuple]:
        while self.runs and self.keys[first := self.losers[0]] is not None:
            run = self.runs[first]
            yield run[self.at[first]]
            self.at[first] += 1
            self.keys[first] = order(run[self.at[first]]) if self.at[first] < len(run) else None
            self._replay(first)


def merged(runs: DataFrame, ranges: int | None = None) -> DataFrame:
    """The captures of all runs and ``place``, which ascends in the order of the whole history.

    Rows are dealt once, by ranges of (URL key, time, id), so a URL with a third of all captures is
    split by time. A range holds its part of each run in memory: index rows, no payloads.
    """
    spark = runs.sparkSession
    n = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    schema = T.StructType([T.StructField("place", T.LongType()), *CAPTURE])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, list[tuple]] = {}
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                parts.setdefault(row[0], []).append(row[1:])
        lists = []
        for part in parts.values():
            part.sort()  # by place in the run: blocks of one run may arrive in any order
            lists.append([row[1:] for row in part])
        place, held = TaskContext.get().partitionId() << 40, []

        def out() -> pa.RecordBatch:
            nonlocal place
            arrays = [pa.array(list(c), t) for c, t in zip(zip(*held, strict=True), ARROW, strict=True)]
            places = pa.array(range(place, place + len(held)), pa.int64())
            place += len(held)
            return pa.RecordBatch.from_arrays([places, *arrays], schema.names)

        for row in LoserTree(lists):
            held.append(row)
            if len(held) == 5000:
                yield out()
                held = []
        if held:
            yield out()

    dealt = runs.repartitionByRange(n, "url_key", "captured", "page_id", "file", "record_at")
    return dealt.mapInArrow(run, schema)


def stored(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write the archives, read them back, and merge the index of their captures."""
    spark = pages.sparkSession
    folder = folder or run_folder(spark, "warc")
    write(pages, folder)
    return merged(written(captures(spark, folder), "runs"))


def digest(pages: DataFrame) -> DataFrame:
    return stored(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


DIGEST_SQL = f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
g AS (SELECT payload_digest, max(page_id) AS first_id FROM p WHERE payload_bytes >= {LEAST_BYTES} GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first_id IS NULL OR first_id = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first_id <> page_id THEN first_id END AS refers_to
FROM p LEFT JOIN g USING (payload_digest)"""
