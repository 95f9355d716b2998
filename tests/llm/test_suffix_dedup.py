"""Substring removal against brute force, and its parts."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from ferrograph.llm import suffix_dedup as sd

ROW = "doc_id long, text string, node string, lo int"


def brute(rows, length):
    raw = [(i, (t or "").encode()) for i, t in rows]
    count = Counter(b[j : j + length] for _, b in raw for j in range(len(b) - length + 1))
    out = []
    for i, b in raw:
        gone = bytearray(len(b))
        for j in range(len(b) - length + 1):
            if count[b[j : j + length]] > 1:
                gone[j : j + length] = b"\x01" * length
        spans = sum(1 for j, g in enumerate(gone) if g and (j == 0 or not gone[j - 1]))
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def run(spark, rows, length, passage=256):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], ROW)
    got = sd.deduplicated(df, length, passage).collect()
    assert all(sum(s.hi - s.lo for s in r.spans) == r.n_removed for r in got)
    shorter = brute(rows, min(passage, length))
    assert sorted(((r.doc_id, r.n_repeated) for r in got), key=str) == sorted(((i, gone) for i, _, gone, _, _ in shorter), key=str)
    return sorted((tuple(r)[:5] for r in got), key=str)


def say(rng, n):
    return " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 8))) for _ in range(n))


def sample(seed):
    rng = random.Random(seed)
    shared = [say(rng, n) for n in (100, 140, 300)]
    rows = [(1, None), (2, ""), (3, "short"), (4, "x" * 1500), (5, "ha " * 900), (6, say(rng, 400)), (None, say(rng, 300))]
    for i in range(12):
        parts = [say(rng, rng.randrange(40)), rng.choice(shared), say(rng, 30), rng.choice(shared)[rng.randrange(60) :], say(rng, 20)]
        rows.append((10 + i, " ".join(parts)))
    rows += [rows[8], rows[9], (50, rows[10][1]), (51, rows[10][1][:-3]), (52, "ha " * 500), (53, say(rng, 2000) + shared[1] + shared[1])]
    return rows


@pytest.mark.parametrize(("length", "passage"), [(400, 256), (64, 64), (130, 48), (400, 399)])
def test_against_brute_force(spark, length, passage):
    rows = sample(length)
    assert run(spark, rows, length, passage) == brute(rows, length)


def test_hashes_that_collide(spark, monkeypatch):
    """Contexts of a text that are equal by their hash only are no repeats; texts of one node hash are told apart."""
    rng = random.Random(2)
    rows = [(1, "".join(rng.choice("abcdefgh") for _ in range(5000))), (2, "ha " * 400)]
    real = sd.anchors

    def same(*a):
        r, fp, place, first, last, context, left, right = real(*a)
        n = len(r)
        return r, np.zeros(n, np.int64) + 5, place, first, last, np.zeros(n, np.uint64), left, right

    texts = [t.encode() for _, t in rows]
    b, off = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    assert len({*real(b, off, 400, 256)[1].tolist()}) > 20
    import pyarrow as pa

    monkeypatch.setattr(sd, "anchors", same)
    held = {}
    fake = type("F", (), {"mapInArrow": lambda self, f, schema: held.update(f=f)})()
    sd.fingerprints(fake, 400, 256)
    out = next(iter(held["f"](iter([pa.RecordBatch.from_arrays([pa.array([7, 8]), pa.array([t for _, t in rows])], ["node", "text"])])))).to_pylist()
    assert not [r for r in out if r["fp"] is None and r["node"] == 7]
    assert [r for r in out if r["fp"] is None and r["node"] == 8]


def test_too_long_a_text(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(sd, "PLACE", 10)
    held = {}
    sd.fingerprints(type("F", (), {"mapInArrow": lambda self, f, schema: held.update(f=f)})(), 400, 256)
    with pytest.raises(ValueError, match="too long"):
        list(held["f"](iter([pa.RecordBatch.from_arrays([pa.array([1]), pa.array(["x" * 2000])], ["node", "text"])])))


def test_salted_anchors(spark, monkeypatch):
    rng = random.Random(9)
    passage = say(rng, 200)
    rows = [(i, say(rng, rng.randrange(5, 30)) + " " + passage[: 900 if i % 3 else 500] + say(rng, 9)) for i in range(60)] + sample(3)
    monkeypatch.setattr(sd, "SALTED", 7)
    assert run(spark, rows, 400) == brute(rows, 400)


def test_on_data(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    assert run(spark, rows, 400) == brute(rows, 400)


def test_empty(spark):
    assert run(spark, [], 400) == []


@pytest.mark.parametrize("seed", range(4))
def test_suffix_array_and_common_prefixes(seed):
    rng = random.Random(seed)
    texts = ["".join(rng.choice("ab") for _ in range(rng.randrange(30, 60))).encode() for _ in range(20)] + [b"a" * 50] * 2
    size = np.array([len(t) for t in texts])
    begin = np.r_[0, np.cumsum(size)]
    text = np.frombuffer(b"".join(texts), np.uint8)
    end = np.repeat(begin[1:], size)
    length = 30
    start = np.flatnonzero(np.arange(len(text)) + length <= end)
    sa, word, alone = sd.suffix_array(text, end, start, length)
    strings = [text[i : i + length].tobytes() for i in sa]
    assert strings == sorted(text[i : i + length].tobytes() for i in start)
    lcp = sd.common_prefixes(sa, word, (begin[:-1], begin[1:] - length), length)
    for i in range(1, len(sa)):
        want = next((k for k in range(length) if strings[i][k] != strings[i - 1][k]), length)
        assert lcp[i] == want
        if want >= length:
            assert not alone[sa[i]] and not alone[sa[i - 1]]
    some = sd.common_prefixes(sa, word, (begin[:-1], begin[1:] - length), length, alone)
    assert ((some >= length) == (lcp >= length)).all()


def test_runs_of_many_arrays_end_at_each_array():
    rng = np.random.default_rng(1)
    flags = [rng.random(n) < 0.6 for n in (0, 1, 7, 0, 30, 2)] + [np.ones(4, bool), np.ones(3, bool), np.zeros(0, bool)]
    assert sd.runs_of(flags) == [(i, a, z) for i, f in enumerate(flags) for a, z in sd.runs(f)]
    assert sd.runs_of([]) == []
