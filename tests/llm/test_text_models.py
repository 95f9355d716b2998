"""SentencePiece against the library; language identification by held-out accuracy and edge cases."""

import hashlib
import zlib

import numpy as np
import pytest
import sentencepiece
import xxhash
import zstandard

from ferrograph.llm import language_id, pieces, queries

DOCS = "doc_id long, text string, lang string, score string"
ODD = [
    None, "", " ", "\na b", "a\n", "a\n\nb c", " a", "a ", "a\n b", "\n", "a b\tc", "  a  b\n\tc ▁ d 　 é\x00 ﻿ 𝒳 <s> <unk> <0x41> ", "▁", "▁▁x",
    "a" * 500 + " " + "é" * 300, "x" * 3000, " " * 100, "\r\n\t", "😀😀" * 50, "ab\x00\x01\x7f̀​", "the thing " * 20000,
]


def test_round_trip_equals_library(spark):
    model = queries.tokenizer()
    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    rows = [(i, t, "en", "x") for i, t in enumerate(ODD)]
    rows += [(100 + r.doc_id, r.text, "en", "x") for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    got = {r.doc_id: r for r in pieces.round_trip(spark.createDataFrame(rows, DOCS), model, texts=True).collect()}
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for i, t, _, _ in rows:
        ids = sp.encode(t or "")
        assert list(got[i].ids) == ids and got[i].n_tokens == len(ids) and got[i].ids_sha256 == digest(",".join(map(str, ids)))
        assert got[i].decoded == sp.decode(ids) and got[i].decoded_sha256 == digest(sp.decode(ids))


WORDS = ["▁therention", "▁éauxment", "▁" + "ab" * 200, "zzz", "▁#$%", "▁▁▁▁x", "▁" + "é" * 70, "▁" + "the" * 40]


def test_own_merges_equal_library(monkeypatch):
    p = pieces.Pieces(queries.tokenizer())
    text = "".join(w.replace("▁", " ") for w in WORDS) + "\n" + "\n".join(WORDS[:3])
    ids, starts = p.encode([text, "", text[5:]])
    assert ids.tolist() == p.sp.encode(text) + p.sp.encode(text[5:]) and starts[1] == starts[2]
    # chunks that merge in step, and those that have a heap each
    for most in (1, 10_000):
        monkeypatch.setattr(pieces, "LONG", most)
        assert (p.encode([text, "", text[5:]])[0] == ids).all()


def test_ids_come_from_the_agenda():
    p = pieces.Pieces(queries.tokenizer())
    texts = ["the thing that is there and the other", "in the end"]
    want = [i for t in texts for i in p.sp.encode(t)]
    assert p.encode(texts, 0)[0].tolist() == want
    p.made[:, 0] = -1  # no pair is in the vocabulary
    broken = p.encode(texts)[0].tolist()
    assert broken != want and len(broken) == sum(len(t) + 1 for t in texts)
    with pytest.raises(pieces.Differs):
        p.encode(texts, 0)


def test_every_chunk_is_checked_in_turn():
    p = pieces.Pieces(queries.tokenizer())
    text = " ".join(f"w{i}th" for i in range(200))
    seen = set()
    plain = p.library
    p.library = lambda chunks: (seen.update(chunks), plain(chunks))[1]
    for turn in range(pieces.CHECKED):
        p.encode([text], turn)
    assert len(seen) == 200


def test_hashes_that_collide(monkeypatch):
    p = pieces.Pieces(queries.tokenizer())
    texts = ["the thing", "that is", "a\n\nb"]
    want = [i for t in texts for i in p.sp.encode(t)]
    monkeypatch.setattr(pieces.tk, "mix", lambda x: x * pieces.U(0))
    assert p.encode(texts, 0)[0].tolist() == want


@pytest.mark.parametrize("ids", [[5, 200, 300], [200, 201, 1000], [3, 130], [0, 5], [1, 400, 2], [], [1, 2], [2, 29871, 29871, 500]])
def test_decode_any_ids(ids):
    p = pieces.Pieces(queries.tokenizer())
    assert p.decode(np.array(ids, np.int64), np.array([0, len(ids)]))[0].decode() == p.sp.decode(ids)


def test_language_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    lang = {r.doc_id: r.lang for r in docs.collect()}
    got = queries.op8_language_id(spark, "/root/testdata/sf0.01").collect()
    held = [r for r in got if r.held_out]
    assert len(got) == len(lang) and len(held) > 200
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in got) and sum(r.rejected for r in got) < 20


def brute_languages(rows):
    """doc_id, language, score and rejection, by a plain classifier with the operator's parameters."""
    held = {i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 3 == 1}
    bare = lambda t: " ".join("".join(c if c.isalpha() else " " for c in t.lower()).split()).encode()
    by = {}
    for i, t, lang in rows:
        if i not in held and t is not None and lang is not None:
            h = xxhash.xxh64_intdigest(str(i).encode(), 42)
            by.setdefault(lang, []).append((h - (h >> 63 << 64), i, t))
    pack = []
    for lang, own in sorted(by.items(), key=lambda x: (-len(x[1]), x[0])):
        raw = b" ".join(bare(t[:2000]) for _, _, t in sorted(own)[:400])[:64_000]
        pack.append((lang, zstandard.ZstdCompressor(level=6, dict_data=zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_dict_id=False)))
    out = []
    for i, t, _ in rows:
        x = bare(t or "")
        if not x:
            out.append((i, "und", 0.0, True))
            continue
        x = x if len(x) >= 512 else b" " * 256 + x
        size = [sum(len(c.compress(x[at : at + 4096])) for at in range(0, len(x), 4096)) for _, c in pack]
        first, second = sorted(size)[:2]
        out.append((i, pack[size.index(first)][0], round((second - first) / second, 9), (second - first) / second < 0.005))
    return sorted(out, key=str)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_languages_against_brute_force(spark, sf):
    rows = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").collect()]
    got = [(r.doc_id, r.lang_pred, round(r.score, 9), r.rejected) for r in queries.op8_language_id(spark, f"/root/testdata/{sf}").collect()]
    assert sorted(got, key=str) == brute_languages(rows)


def test_language_edges(spark):
    rows = [(1, None, "en", "x"), (2, "", None, "x"), (3, "123 !!", "en", "x"), (4, "the and of " * 50000, "en", "x"), (4, "le de la " * 40, "fr", "x"), (5, "the", None, "x")]
    df = spark.createDataFrame(rows, DOCS)
    got = sorted((r.doc_id, r.lang_pred, r.rejected) for r in language_id.identify(df, language_id.train(df)).collect())
    assert got == [(1, "und", True), (2, "und", True), (3, "und", True), (4, "en", False), (4, "fr", False), (5, "en", True)]  # the last is a tie: no dictionary has a match
    assert {r.lang_pred for r in language_id.identify(df, language_id.train(df.limit(0))).collect()} == {"und"}
