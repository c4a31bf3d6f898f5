"""WARC archives: writing, reading back, and an index merged externally.

* ``write_archives`` writes one record per page.  The text writer does it: a row
  is a whole record and the line separator is the two line ends that close one,
  so any file system works and lost executors are made up for by Spark's commit.
  Pages with equal payloads of at least ``MIN_REVISIT`` bytes are written once,
  as the response of the smallest page_id; the others are revisit records.
* ``read_archives`` parses the files by Content-Length and computes lengths and
  digests from the payload bytes.  Records go to files by classes of their size,
  so a file holds about ``FILE_BYTES`` of payloads at most, or one longer record;
  the longest record that can be read back is what a Spark binary value holds
  (2 GB).
* ``capture_index`` makes capture histories: the captures of each archive are
  sorted and written as a run; runs are dealt out by ranges of (url key, time,
  page), about ``SLICE_ROWS`` rows to a task however many there are, and each task
  merges the slices it gets by a loser tree that reads every run a few rows at a
  time.  A hot url is divided among tasks, as time and page take part in the
  ranges.

Defined results: a null html is an empty payload; a null url has no target line
and an empty url key; line ends in urls are percent-encoded.  A null page_id is
written without an identifier and is never a response that others refer to; it
is a revisit if its payload has one.  Rows that repeat a response's page_id are
responses too.  An empty table makes an empty archive.  Other columns are
ignored, unless one is named as the time of the captures: seconds or a timestamp,
null or unreadable values take the default time.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import Workspace, lean, prepare

MIN_REVISIT = 100
#: Bytes of payloads in a file, about; and the greatest sizes of a class of records (beyond the last: one record a file).
FILE_BYTES = 64 << 20
CLASSES = (16 << 10, 256 << 10, 4 << 20)
#: Captures that one task merges, about.
SLICE_ROWS = 250_000
END = "\r\n\r\n"
#: The time of page 0; page n is n seconds later unless a time column is named.
EPOCH = 1577836800
#: Times are written with four digits of a year.
LAST_TIME = 253402300799


def _time(pages: DataFrame, column: str | None):
    default = F.lit(EPOCH) + F.pmod(F.coalesce(F.col("page_id").cast("long"), F.lit(0)), F.lit(10**9))
    if column is None:
        return default
    kind = pages.schema[column].dataType.typeName()
    given = F.col(f"`{column}`")
    given = given.cast("timestamp").cast("long") if kind in ("date", "timestamp", "timestamp_ntz") else F.expr(f"try_cast(`{column}` as bigint)")
    return F.when(given.between(0, LAST_TIME), given).otherwise(default)


def _records(pages: DataFrame, ws: Workspace, min_revisit: int, time: str | None) -> DataFrame:
    """(size_class, value) of every record."""
    time = _time(pages, time)
    plain = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("payload"), time.alias("time"))
    plain = plain.withColumns({"size": F.octet_length("payload"), "digest": F.sha2(F.col("payload").cast("binary"), 256)})
    shared = plain.where(F.col("size") >= min_revisit).groupBy("digest").agg(F.min("page_id").alias("refers"), F.count(F.lit(1)).alias("k")).where("k > 1 and refers is not null").select("digest", "refers")
    shared = ws.save(shared, "shared")  # few rows, or many: its size is known to the join
    joined = plain.join(shared, "digest", "left")
    revisit = F.col("refers").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("refers"))
    url = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    # concat gives null for a null value; coalesce leaves the line out.
    optional = lambda x: F.coalesce(x, F.lit(""))
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        optional(line("WARC-Target-URI", url)),
        line("WARC-Date", F.date_format(F.timestamp_seconds("time"), "yyyy-MM-dd'T'HH:mm:ss'Z'")),
        optional(line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.col("page_id").cast("string"), F.lit(">")))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "digest")),
        optional(F.when(revisit, F.concat(line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("refers").cast("string"), F.lit(">"))), line("X-Payload-Length", F.col("size").cast("string"))))),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.when(revisit, 0).otherwise(F.col("size")).cast("string")),
        F.lit("\r\n"),
    )
    stored = F.when(revisit, 0).otherwise(F.col("size"))
    return joined.select(sum((stored > c).cast("int") for c in CLASSES).alias("size_class"), F.concat(head, F.when(revisit, F.lit("")).otherwise(F.col("payload"))).alias("value"))


def write_archives(pages: DataFrame, path: str, ws: Workspace, min_revisit: int = MIN_REVISIT, compression: str = "none", time: str | None = None) -> None:
    spark = pages.sparkSession
    before = spark.conf.get("spark.sql.session.timeZone")
    if before != "UTC":  # record times are UTC
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    try:
        records = _records(pages, ws, min_revisit, time)
        longest = pages.agg(F.max(F.octet_length(F.col("html").cast("string")))).first()[0] or 0
        mode = "overwrite"
        for k, most in enumerate((*CLASSES, FILE_BYTES)):
            if k and longest <= CLASSES[k - 1]:
                break
            of_class = records if longest <= CLASSES[0] else records.where(F.col("size_class") == k)
            of_class.select("value").write.option("lineSep", END).option("maxRecordsPerFile", FILE_BYTES // most).option("compression", compression).mode(mode).text(path)
            mode = "append"
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


_HOST = re.compile(r"^[^:/?#]*://(?:[^/?#@]*@)?([^/?#:]*)(?::\d*)?([^?#]*)(\?[^#]*)?")


def url_key(url: str) -> str:
    """Host labels in reverse, then path and query: keys of one site sort together."""
    m = _HOST.match(url)
    if not m:
        return url.lower()
    return ",".join(reversed(m[1].lower().split("."))) + ")" + (m[2] or "/") + (m[3] or "")


def _page(value: str | None) -> int | None:
    return int(value[len("<urn:page:") : -1]) if value else None


def parse(data: bytes):
    """(offset, headers, payload) of the records of one file."""
    at, n = 0, len(data)
    while at < n:
        stop = data.find(b"\r\n\r\n", at)
        if stop < 0 or not data.startswith(b"WARC/1.", at):
            raise ValueError(f"no WARC record at byte {at}")
        headers = dict(x.split(": ", 1) for x in data[at:stop].decode().split("\r\n")[1:])
        size = int(headers["Content-Length"])
        payload = data[stop + 4 : stop + 4 + size]
        if len(payload) != size or data[stop + 4 + size : stop + 8 + size] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} is cut short")
        yield at, headers, payload
        at = stop + 8 + size


CAPTURES = "url_key string, time string, page_id long, record_type string, payload_bytes long, payload_digest string, refers_to long, file string, offset long"


def _parsed(batches):
    import gzip

    for b in batches:
        for path, content in zip(b.column(0), b.column(1)):
            data = content.as_py()
            if data[:2] == b"\x1f\x8b":
                data = gzip.decompress(data)
            rows = []
            for at, h, payload in parse(data):
                url, revisit = h.get("WARC-Target-URI"), h["WARC-Type"] == "revisit"
                digest = h["WARC-Payload-Digest"].removeprefix("sha256:")
                if not revisit and hashlib.sha256(payload).hexdigest() != digest:
                    raise ValueError(f"the digest of the record at byte {at} of {path} does not match")
                rows.append((url_key(url) if url is not None else "", re.sub(r"\D", "", h["WARC-Date"]), _page(h.get("WARC-Record-ID")), h["WARC-Type"], int(h["X-Payload-Length"]) if revisit else len(payload), digest, _page(h.get("WARC-Refers-To")), path.as_py(), at))
            types = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=[x.split()[0] for x in CAPTURES.split(", ")])


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The captures of all archives under a path."""
    prepare(spark)
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(lean(_parsed), CAPTURES)


class LoserTree:
    """k-way merge: inner nodes keep losers, so each next item costs log2(k) comparisons."""

    _END = (1,)

    def __init__(self, runs):
        self.runs = [iter(r) for r in runs]
        k = self.k = max(1, len(self.runs))
        self.heads = [self._next(i) for i in range(len(self.runs))] or [self._END]
        self.tree = [-1] * k
        for i in range(k - 1, -1, -1):
            self._play(i)

    def _next(self, i):
        for row in self.runs[i]:
            return (0, row)
        return self._END

    def _play(self, winner):
        node = (winner + self.k) // 2
        while node:
            other = self.tree[node]
            if other < 0:
                self.tree[node] = winner
                return
            if self.heads[other] < self.heads[winner]:
                self.tree[node], winner = winner, other
            node //= 2
        self.tree[0] = winner

    def __iter__(self):
        while self.heads[self.tree[0]] != self._END:
            winner = self.tree[0]
            yield self.heads[winner][1]
            self.heads[winner] = self._next(winner)
            self._play(winner)


def _items(table: pa.Table, first: int, last: int, step: int = 512):
    """The merge keys of a run, rows first to last of the table, a few at a time."""
    for at in range(first, last, step):
        part = table.slice(at, min(step, last - at))
        for i, (key, time, page) in enumerate(zip(*(part.column(c).to_pylist() for c in ("url_key", "time", "page_id")))):
            yield key, time, page is not None, page or 0, at + i


def _merge(batches):
    """Slices of sorted runs, one after another -> one sorted stream."""
    got = [b for b in batches if b.num_rows]
    if not got:
        return
    table = pa.Table.from_batches(got).combine_chunks()
    run = pa.compute.dictionary_encode(table.column("run")).combine_chunks().indices.to_numpy(zero_copy_only=False)
    cuts = [0, *(np.flatnonzero(run[1:] != run[:-1]) + 1).tolist(), len(run)]
    table, order = table.drop_columns(["run"]), []

    def ordered():
        out = table.take(pa.array(order)).combine_chunks().to_batches()
        order.clear()
        return out

    for item in LoserTree([_items(table, a, z) for a, z in zip(cuts, cuts[1:])]):
        order.append(item[-1])
        if len(order) == 10_000:
            yield from ordered()
    if order:
        yield from ordered()


def capture_index(captures: DataFrame, ws: Workspace, name: str = "runs") -> DataFrame:
    """Captures in order of (url_key, time, page_id); partitions follow each other in that order."""
    keys = ["url_key", "time", "page_id"]
    runs = ws.save(captures.sortWithinPartitions(*keys), name)
    named = runs.withColumn("run", F.input_file_name())
    # A task's rows are bounded by dealing them to as many tasks as they need, never fewer than the session asks for.
    tasks = max(int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-runs.count() // SLICE_ROWS))
    return named.repartitionByRange(tasks, *keys).sortWithinPartitions("run", *keys).mapInArrow(lean(_merge), CAPTURES)


def archive_pages(pages: DataFrame, time: str | None = None) -> DataFrame:
    """Writes pages as WARC, reads the archives back, and returns the merged index of all captures.  time: the column of capture times."""
    ws = Workspace(pages.sparkSession, "warc")
    write_archives(pages, ws.path("archives"), ws, time=time)
    index = capture_index(read_archives(pages.sparkSession, ws.path("archives")), ws)
    ws.drop("archives", "shared")
    return index
