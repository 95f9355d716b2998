"""The pipeline against a brute-force version, and its stages on odd tables."""

import hashlib
import itertools
import re

import pytest
import sentencepiece

import corpus_pipeline
from ferrograph.llm import language_id, queries
from tests.llm.test_contamination import sets
from tests.llm.test_ngram_join import brute

DATA = "/root/testdata/sf0.001"
WHITE = re.compile(r"[\x20\x09-\x0D]")


def test_against_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    out = {r.doc_id for r in language_id.identify(docs, language_id.train(docs)).collect() if r.rejected}
    rows = {i: t for i, t in rows.items() if i not in out}
    best = {}
    for i, t in rows.items():
        n = WHITE.sub("", t)
        best[n] = min(best.get(n, (0, 10**9)), (-len(t), i))
    rows = {i: rows[i] for _, i in best.values()}
    comp = brute(list(rows.items()), 5, 80, 100)
    rows = {i: rows[i] for i, _, c in comp if i == c}
    items = [sets(r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    rows = {i: t for i, t in rows.items() if not any(s and len(s & sets(t)) >= 0.8 * len(s) for s in items)}
    sp = sentencepiece.SentencePieceProcessor(model_proto=queries.tokenizer())
    want = {i: sp.encode(t) for i, t in rows.items()}
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, DATA).collect()}
    assert {i: list(r.ids) for i, r in got.items()} == want
    assert all(r.decoded_sha256 == hashlib.sha256(rows[i].encode()).hexdigest() for i, r in got.items())
    assert 100 < len(got) < docs.count()


@pytest.mark.parametrize("stage", range(5))
def test_stages_on_odd_tables(spark, stage):
    name, f = corpus_pipeline.STAGES[stage]
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, _id string"
    rows = [(1, None), (2, ""), (3, "the and of to " * 30_000), (4, "one of them is that"), (4, "one of them is that"), (None, "and the other one"), (5, "one  of them is that ")]
    for data in (rows, []):
        df = spark.createDataFrame([(i, t, "en", None, 3, 0.5, "q") for i, t in data], schema)
        out = f(spark, df, DATA)
        got = out.collect()
        if stage == 4:
            assert len(got) == len(data)
            continue
        assert out.schema == df.schema
        # by stage: rows without letters go; longest of equal texts; smallest id of equal shingles; nothing is in the benchmark
        stays = [(2, 3, 4, 5, 6), (0, 2, 5, 6), (0, 1, 2, 3, 4, 5), range(7)][stage]
        assert sorted(((r.doc_id, r.text) for r in got), key=str) == sorted((data[i] for i in stays if data), key=str)


def test_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "near_dedup", "decontaminate", "sentencepiece"]
    assert all(a != b for a, b in itertools.combinations([f for _, f in corpus_pipeline.STAGES], 2))
