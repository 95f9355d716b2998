"""WARC archives: writing with revisit records, reading, and a merged capture index.

Writing: every page becomes a record; of pages with equal payloads (at least `least_bytes` bytes) that with the
smallest page_id is the response and the others are revisits that refer to it and hold no payload. Records are UTF-8
text, so Spark's own text writer commits them, gzipped, to any file system; a lost executor costs a task.

Reading: archives come back as binary files and are cut into records by their Content-Length. Each archive's captures
form a run sorted by URL key, time and page. The runs are merged in ranges: a range exchange deals them
out by (key, time, page) — time and page split a key that holds many captures — as many ranges as it takes for
about RANGE captures each. In each range a loser tree merges the slices of the runs, so that the partitions, in order, are the
globally ordered capture history. The slices stay in Arrow's columns; only the heads of the runs are rows, a few at a time.

A null html is an empty payload, a null URL an empty one; line breaks in a URL are percent-encoded. Rows with a null page_id
are captures too. Rows that share the smallest page_id of a payload are all responses. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrograph.llm.shared import BROADCAST_ROWS, met, new_path, saved
from ferrograph.plans.store import forget_at_exit

END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Captures of a range that is merged by a task, about, and rows of a run that are read ahead.
RANGE, AHEAD = 200_000, 256
CAPTURE = (
    "url_key string, captured string, page_id long, payload_bytes long, payload_digest string, record_type string, "
    "refers_to long, url string, archive string, place long"
)
URL = re.compile(r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)([^#]*)")


def revisits(pages: DataFrame, least_bytes: int) -> DataFrame:
    """page_id, refers_to of the pages whose payload a page with a smaller id has."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    keyed = pages.filter("page_id is not null").select("page_id", F.octet_length(payload).alias("size"), F.unhex(F.sha2(payload, 256)).alias("digest"))
    keyed = saved(keyed.filter(F.col("size") >= least_bytes).select("page_id", "digest"), "digests")
    first = keyed.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).filter("n > 1")
    # a payload that very many pages have is met by a broadcast
    again = met(keyed, saved(first, "payloads"), "digest", "n").filter("page_id <> refers_to")
    return saved(again.select("page_id", "refers_to").distinct(), "revisits")


def _name(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("null")), F.lit(">"))


def write_archives(pages: DataFrame, path: str, least_bytes: int = 100, records_per_file: int = 4000) -> None:
    """Write `pages` (page_id, url, html, captured as a timestamp) as .warc records under `path`."""
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"), "captured")
    again = revisits(pages, least_bytes)
    if again.count() <= BROADCAST_ROWS:
        again = F.broadcast(again)
    payload = F.coalesce("html", F.lit(""))
    is_revisit = F.col("refers_to").isNotNull()
    size = F.octet_length(payload).cast("string")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), size, F.lit(END))
    body = F.when(is_revisit, http).otherwise(F.concat(http, payload))
    url = F.replace(F.replace(F.coalesce("url", F.lit("")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(is_revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", _name(F.col("page_id"))),
        line("WARC-Target-URI", url),
        line("WARC-Date", F.coalesce(F.date_format("captured", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit(""))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.sha2(payload, 256))),
        F.when(is_revisit, F.concat(line("WARC-Refers-To", _name(F.col("refers_to"))), line("WARC-Profile", F.lit(PROFILE)))).otherwise(""),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length("body").cast("string")),
        F.lit("\r\n"),
    )
    records = pages.join(again, "page_id", "left").withColumn("body", body).select(F.concat(head, "body").alias("value"))
    records.write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(path)


def records(content: bytes):
    """(headers, block) of each record of a gzipped archive (any number of members)."""
    buffer, data = bytearray(), content

    def more() -> bool:
        nonlocal data, unzip
        if unzip.eof:
            data = unzip.unused_data
            if not data:
                return False
            unzip = zlib.decompressobj(31)
        piece = unzip.decompress(data, 1 << 20)
        data = unzip.unconsumed_tail
        buffer.extend(piece)
        return bool(piece or data or unzip.eof)

    unzip = zlib.decompressobj(31)
    while True:
        while (at := buffer.find(b"\r\n\r\n")) < 0:
            if not more():
                return
        head = dict(x.split(": ", 1) for x in buffer[:at].decode().split("\r\n")[1:])
        end = at + 4 + int(head["Content-Length"])
        while len(buffer) < end + 4:
            if not more():
                raise ValueError("an archive ends inside a record")
        yield head, bytes(buffer[at + 4 : end])
        del buffer[: end + 4]


def url_key(url: str) -> str:
    """The host's labels from the last to the first, and the path with its query; URLs without a host as they are."""
    m = URL.match(url)
    if not m:
        return url
    return ",".join(reversed(m[1].lower().split("."))) + ")" + (m[2] or "/")


def _page(name: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", name or "")
    return int(found[1]) if found else None


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """A row per capture, in runs sorted by (url_key, captured, page_id): one run an archive."""

    def run(batches):
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1)):
                rows = []
                for place, (head, block) in enumerate(records(content.as_py())):
                    cut = block.index(b"\r\n\r\n") + 4
                    http = block[:cut].decode().lower()
                    if head["WARC-Type"] == "revisit":
                        size, digest = int(http.split("content-length: ")[1].split("\r\n")[0]), head["WARC-Payload-Digest"].removeprefix("sha256:")
                    else:
                        size, digest = len(block) - cut, hashlib.sha256(block[cut:]).hexdigest()
                        if head["WARC-Payload-Digest"] != "sha256:" + digest:
                            raise ValueError(f"a payload in {name} does not have its digest")
                    url = head["WARC-Target-URI"]
                    rows.append(
                        (url_key(url), head["WARC-Date"], _page(head["WARC-Record-ID"]), size, digest, head["WARC-Type"], _page(head.get("WARC-Refers-To")), url, name.as_py(), place)
                    )
                rows.sort(key=_order)
                for lo in range(0, len(rows), 10_000):
                    yield _batch(rows[lo : lo + 10_000])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("path", "content")
    return files.mapInArrow(run, CAPTURE)


def _order(row):
    return row[0], row[1], row[2] is not None, row[2] or 0, row[8], row[9]


_TYPES = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]
_NAMES = [c.split()[0] for c in CAPTURE.split(", ")]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [[]] * len(_NAMES)
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, _TYPES)], _NAMES)


class LoserTree:
    """Merges sorted runs: every inner node keeps the loser of its match, so the next row costs one match a level.

    runs: iterables of rows; of each only the head is held.
    """

    def __init__(self, runs: list, key):
        self.key = key
        self.its = [iter(r) for r in runs]
        self.k = max(1, len(runs))
        self.head: list = [None] * self.k
        for i in range(len(runs)):
            self._advance(i)
        self.loser = [-1] * self.k
        for i in range(self.k):
            self._play(i, first=True)

    def _advance(self, i: int) -> None:
        row = next(self.its[i], None)
        self.head[i] = None if row is None else (self.key(row), i, row)

    def _beats(self, i: int, j: int) -> bool:
        a, b = self.head[i], self.head[j]
        return a is not None and (b is None or a[:2] < b[:2])

    def _play(self, i: int, first: bool = False) -> None:
        at = (i + self.k) // 2
        while at:
            if first and self.loser[at] < 0:
                self.loser[at] = i
                return
            if self._beats(self.loser[at], i):
                self.loser[at], i = i, self.loser[at]
            at //= 2
        self.loser[0] = i

    def __iter__(self):
        while (top := self.head[self.loser[0]]) is not None:
            yield top[2]
            self._advance(top[1])
            self._play(top[1])


def _ahead(slices: list[pa.RecordBatch]):
    """The rows of a run's slice, a few at a time."""
    for batch in slices:
        for lo in range(0, batch.num_rows, AHEAD):
            yield from zip(*(c.to_pylist() for c in batch.slice(lo, AHEAD).columns))


def merged(captures: DataFrame) -> DataFrame:
    """The runs in one global order by (url_key, captured, page_id)."""
    order = [F.col(c) for c in ("url_key", "captured", "page_id")]
    ranges = captures.count() // RANGE + 1
    dealt = captures.repartitionByRange(ranges, *order) if ranges > 1 else captures.repartitionByRange(*order)
    dealt = dealt.sortWithinPartitions("archive", "url_key", "captured", "page_id", "place")

    def run(batches):
        runs: dict[str, list[pa.RecordBatch]] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            # rows come archive by archive: a batch is cut where the archive changes
            names = batch.column(8).dictionary_encode()
            codes = names.indices.to_numpy()
            cuts = [0, *(np.flatnonzero(codes[1:] != codes[:-1]) + 1).tolist(), batch.num_rows]
            for lo, hi in zip(cuts, cuts[1:]):
                runs.setdefault(names.dictionary[int(codes[lo])].as_py(), []).append(batch.slice(lo, hi - lo))
        out = []
        for row in LoserTree([_ahead(r) for r in runs.values()], _order):
            out.append(row)
            if len(out) == 10_000:
                yield _batch(out)
                out = []
        yield _batch(out)

    return dealt.mapInArrow(run, CAPTURE)


def archived(pages: DataFrame, least_bytes: int = 100) -> DataFrame:
    """Write `pages` to archives in the shared folder, which go when the driver ends, and give the merged capture index of what is read back."""
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    write_archives(pages, path, least_bytes)
    forget_at_exit(spark, path)
    return merged(saved(read_archives(spark, path), "captures"))


ORACLE = r"""
WITH p AS (
  SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html, sha256(coalesce(html, '')) AS payload_digest,
         strlen(coalesce(html, '')) AS payload_bytes
  FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to,
       CASE WHEN regexp_matches(url, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN
         array_to_string(list_reverse(string_split(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)([^#]*)', 1)), '.')), ',') || ')' ||
         coalesce(nullif(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)([^#]*)', 2), ''), '/') ELSE url END AS url_key,
       strftime(TIMESTAMP '2024-01-01' + to_seconds(page_id), '%Y-%m-%dT%H:%M:%SZ') AS captured
FROM f
"""
