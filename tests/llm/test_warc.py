"""WARC round trip against brute force."""

import gzip
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from ferrograph.llm import warc

ROW = "page_id long, url string, html string, place string, archive int"


def run(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], ROW).withColumn("captured", F.timestamp_seconds(F.coalesce("page_id", F.lit(0)) % 7))
    return df, warc.archived(df).collect()


def test_round_trip(spark):
    big, small = "é<p>\r\n\r\nWARC/1.1\r\nx" * 20, "tiny"
    rows = [(9, "http://b.org/x", big), (3, "http://a.org", big), (4, "https://A.ORG/y?z#f", big), (5, "x", small), (6, "u\r\nWARC-Type: evil", small), (7, None, None), (8, "http://a.org", ""), (1, "http://long.net/", "ab" * 400_000), (None, "http://n.org", big), (9, "http://b.org/x", big)]
    _, got = run(spark, rows)
    want = []
    for i, _, h in rows:
        b = (h or "").encode()
        same = [j for j, _, g in rows if j is not None and (g or "") == (h or "")]
        again = len(b) >= 100 and i is not None and i != min(same)
        want.append((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", min(same) if again else None))
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == sorted(want, key=str)
    order = [(r.url_key, r.captured, r.page_id or 0) for r in got]
    assert order == sorted(order)


def test_order_and_empty(spark):
    rng = random.Random(1)
    rows = [(i, f"http://h{rng.randrange(5)}.org/{rng.randrange(4)}", "x" * rng.randrange(300)) for i in range(500)]
    _, got = run(spark, rows)
    order = [(r.url_key, r.captured, r.page_id) for r in got]
    assert len(order) == 500 and order == sorted(order)
    assert run(spark, [])[1] == []


@pytest.mark.parametrize("k", [0, 1, 2, 3, 5, 8, 13])
def test_loser_tree(k):
    rng = random.Random(k)
    runs = [sorted(rng.randrange(50) for _ in range(rng.randrange(30))) for _ in range(k)]
    assert list(warc.LoserTree(runs, lambda x: x)) == sorted(x for r in runs for x in r)


def test_members():
    record = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    assert [b for _, b in warc.records(gzip.compress(record) + gzip.compress(record))] == [b"abc", b"abc"]


def test_many_archives_of_one_host(spark, tmp_path, monkeypatch):
    """Runs of one URL over many archives, in several ranges, with a hot payload and one larger than a decompressed piece."""
    from ferrograph.llm import shared

    monkeypatch.setattr(shared, "BROADCAST_ROWS", 3)
    monkeypatch.setattr(shared, "HOT", 40)
    monkeypatch.setattr(warc, "RANGE", 60)
    hot, rng = "hot " * 50, random.Random(3)
    rows = [(i, "http://one.org/", hot if i % 3 else f"page {i % 20} " * 30) for i in range(240)] + [(999, "http://big.org/", "".join(rng.choice("abcdef") for _ in range(3_000_000)))]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], ROW).repartition(3).withColumn("captured", F.timestamp_seconds(F.col("page_id") % 11))
    path = str(tmp_path / "warc")
    warc.write_archives(df, path, 100, records_per_file=9)
    captures = warc.saved(warc.read_archives(spark, path), "captures")
    assert captures.select("archive").distinct().count() > 20
    got = warc.merged(captures).collect()
    assert [(r.url_key, r.captured, r.page_id) for r in got] == sorted((r.url_key, r.captured, r.page_id) for r in got) and len(got) == len(rows)
    first = {}
    for i, _, h in rows:
        first.setdefault(h, i)
    assert all(r.refers_to == (first[h] if first[h] != r.page_id else None) for r in got for h in [rows[r.page_id][2] if r.page_id < 999 else rows[-1][2]])


def test_heads_are_read_ahead(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(warc, "AHEAD", 2)
    batch = pa.RecordBatch.from_arrays([pa.array(range(7))], ["a"])
    assert list(warc._ahead([batch, batch.slice(3, 2)])) == [(i,) for i in [*range(7), 3, 4]]
