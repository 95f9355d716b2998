"""LM scores: the base exactly, the model's probabilities and its gain on held-out texts."""

import collections
import math
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from ferrograph.llm import language_id, lm_score, queries
from ferrograph.llm import textkit as tk

UPPER = {c: c + 32 for c in range(65, 91)}


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UPPER)) + [None]


def check_base(rows, got):
    count = collections.Counter()
    for i, t in rows:
        if zlib.crc32(str(i).encode()) % 7 != 2:
            count.update(words(t))
    n, v = sum(count.values()), len(count)
    want = sorted(
        (i, zlib.crc32(str(i).encode()) % 7 == 2, len(w := words(t)), sum(count[x] > 0 for x in w), n, round(sum(math.log10((count[x] + 1) / (n + v + 1)) for x in w), 6))
        for i, t in rows
    )
    assert sorted((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want


def test_on_data(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = queries.op4_lm_scoring(spark, "/root/testdata/sf0.01").collect()
    check_base([(r.doc_id, r.text) for r in docs.collect()], got)
    for held in (True, False):
        part = [r for r in got if r.held_out == held]
        assert sum(r.score for r in part) > sum(r.base_score for r in part)
    assert all(r.score < 0 for r in got)


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, " \n "), (4, "A b B a ſ"), (4, "A b B a ſ"), (5, "x" * 100_000), (6, "w " * 200_000), (7, "Q"), (8, "b")]
    df = spark.createDataFrame([(i, t, 1, 2.0) for i, t in rows], "doc_id long, text string, n long, score double")
    small = lm_score.Settings(table=3, slab=1 << 10)  # most words are met by the join
    for s in (None, small):
        got = lm_score.score_texts(df, language_id.fold("doc_id", 7) == 2, s).collect()
        check_base(rows, got)
        assert all(math.isfinite(r.score) and r.score <= 1e-9 for r in got)
    assert lm_score.score_texts(df.limit(0), F.lit(False)).collect() == []
    nothing = lm_score.score_texts(df, F.lit(True)).collect()
    assert all(r.train_tokens == 0 and r.n_known == 0 and r.base_score == 0 and abs(r.score) < 1e-9 for r in nothing)


def test_probabilities_sum_to_one(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    for table in (100, 1 << 19):
        m, vocabulary = lm_score.fit(docs, lm_score.Settings(table=table, groups=3))
        read = lm_score.Reader(m)
        b = np.frombuffer(docs.first()["text"].encode(), np.uint8)
        _, _, feats, _, _ = read(b, np.array([0, len(b)]))
        p = np.exp(lm_score.log_softmax(m.weight, feats).astype(float))
        assert len(m.words) <= table
        hist = np.repeat(np.arange(1, 5, dtype=np.uint64)[None] * np.uint64(0x9E3779B97F4A7C15), len(m.words), axis=0)
        inside = np.bincount(m.cls, np.exp(lm_score.within(m, np.arange(len(m.words)), hist)), m.settings.classes)
        rest = vocabulary.orderBy(F.desc("n"), "word").offset(len(m.words)).toPandas()["n"].to_numpy()
        inside[m.rare] = lm_score.discounted(rest).sum() / max(m.mass[m.rare], 1e-300)
        inside[m.unknown] = 1
        assert np.allclose((p * inside).sum(axis=1), 1, atol=1e-4)


def test_word_hashes_follow_words():
    import pyarrow as pa

    texts = ["A b", None, "", "a  B\tc", "\x0bé É", "x" * 70_000 + " b"]
    got = []
    for _, _, b, off in tk.slabs(pa.array(texts), 5):
        h, first = tk.word_hashes(b, off, ~tk.SPACE)
        got += [h[s:e].tolist() for s, e in zip(first, first[1:])]
    names = {}
    for t, h in zip(texts, got):
        w = words(t)[:-1]
        assert len(w) == len(h)
        for x, y in zip(w, h):
            assert names.setdefault(x, y) == y
    assert len(set(names.values())) == len(names)


def test_words_of_a_class_follow_histories(spark):
    """Within a class a word's probability depends on its history, and the words of a class sum to one."""
    rows = [(i, " ".join(f"{a} {b}" for a, b in ([("left", "red"), ("right", "blue")] if i % 2 else [("right", "blue"), ("left", "red")]) * 30)) for i in range(300)]
    m, _ = lm_score.fit(spark.createDataFrame(rows, "doc_id long, text string"), lm_score.Settings(groups=2))
    find = lm_score.Table(m.words)

    def inside(before, word):
        t, first = lm_score.tokens(np.frombuffer(f"{before} {word}".encode(), np.uint8), np.array([0, len(before) + 1 + len(word)]))
        at = len(t) - 2
        hist = lm_score.histories(t, first)[at : at + 1]
        every = np.flatnonzero(m.cls == m.cls[find(t)[at]])
        assert np.isclose(np.exp(lm_score.within(m, every, np.repeat(hist, len(every), axis=0))).sum(), 1)
        return lm_score.within(m, find(t)[at : at + 1], hist)[0]

    assert inside("left", "red") > inside("right", "red") + 0.5
    assert inside("right", "blue") > inside("left", "blue") + 0.5


def test_groups_come_from_all_documents(spark):
    """The words of the groups are the most frequent of all 12,000 documents, and words that meet share a group."""
    text = "concat_ws(' ', concat('a', id * id % 1009), concat('a', id % 1013), if(id % 2 = 0, 'red left', 'blue right'))"
    docs = spark.range(12_000).selectExpr("id doc_id", f"{text} text")
    s = lm_score.Settings(groups=2)
    found = lm_score.fit_groups(docs, s)
    count = collections.Counter(w for r in docs.collect() for w in r.text.split())
    hashes = {w: int(lm_score.tokens(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w)]))[0][0]) for w in count}
    hashes[None], count[None] = int(lm_score.END), docs.count()
    least = sorted(count.values(), reverse=True)[s.frequent - 1]
    sure = {hashes[w] for w, n in count.items() if n > least}
    maybe = {hashes[w] for w, n in count.items() if n == least}
    assert len(found.words) == s.frequent and sure <= set(found.words.tolist()) <= sure | maybe
    group = {w: found.weight[found.words == hashes[w]][0].argmax() for w in ("red", "left", "blue", "right")}
    assert group["red"] == group["left"] != group["blue"] == group["right"]
    assert len(lm_score.fit_groups(docs.limit(0), s).words) == 0


def test_groups_fit_every_document(spark):
    """The groups are those of plain passes over all rows, and fit the rows better than where they started."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    odd = [(-1, None), (-2, ""), (-3, "the " * 50_000), (-4, " "), (-4, " ")]
    docs = docs.unionByName(spark.createDataFrame(odd, docs.schema)).repartition(3, "doc_id")
    s = lm_score.Settings(groups=3, frequent=300)
    found = lm_score.fit_groups(docs, s)
    place = {h: i for i, h in enumerate(found.words.tolist())}
    rows = docs.collect()
    x = np.zeros((len(rows), len(place)))
    for i, r in enumerate(rows):
        t, _ = lm_score.tokens(b := np.frombuffer((r.text or "").encode(), np.uint8), np.array([0, len(b)]))
        for h, n in collections.Counter(t.tolist()).items():
            if h in place:
                x[i, place[h]] = math.sqrt(n)
    start = weight = lm_score._starts(x.T @ x, x.sum(axis=0), s)
    for _ in range(s.passes):
        fits = np.array([x @ w.T for w in weight])
        n = np.array([[x[f.argmax(axis=1) == g].sum(axis=0) for g in range(s.groups)] for f in fits])
        n += 20 * x.sum(axis=0) / x.sum() + 1e-6
        weight = np.log(n / n.sum(axis=2, keepdims=True))
    best = fits.max(axis=2).sum(axis=1).argmax()
    assert np.allclose(found.weight, weight[best].T, atol=1e-3)
    assert (x @ found.weight).max(axis=1).sum() > max((x @ w.T).max(axis=1).sum() for w in start)


def test_class_steps_are_those_of_tokens_summed_by_bucket():
    rng = np.random.default_rng(3)
    feats = [rng.integers(0, 40, 300) + i * lm_score.BUCKETS for i in range(lm_score.FEATURES)]
    p = rng.normal(size=(300, 5)).astype(np.float32)
    w = rng.normal(size=(lm_score.BUCKETS * lm_score.FEATURES + 1, 5)).astype(np.float32)
    square = np.ones_like(w)
    want, seen = w.astype(float), square.astype(float)
    for f in feats:
        for b in set(f.tolist()):
            grad = p[f == b].sum(axis=0, dtype=float) / np.sqrt(len(p) * (f == b).sum() / 16 + 1) ** 0.5
            seen[b] += grad * grad
            want[b] -= 0.8 * grad / np.sqrt(seen[b])
    lm_score.class_steps(w, square, feats, p, 0.8)
    assert np.allclose(w, want, atol=1e-5) and np.allclose(square, seen, atol=1e-4)
    z, e, whole = lm_score.logits(w, feats)
    assert np.allclose(z - np.log(whole)[:, None], lm_score.log_softmax(w, feats)) and np.allclose((e / whole[:, None]).sum(axis=1), 1, atol=1e-5)


def test_branches_on_the_way_to_a_leaf():
    """Ways are those of trees: shares hold without weights, classes sum to one with any; a step is that of tokens summed by cell, and a history's cells lie side by side."""
    rng = np.random.default_rng(4)
    s = lm_score.Settings(groups=3, bands=(), levels=5)
    n, cls = np.sort(rng.zipf(1.5, 300).clip(1, 5000))[::-1], np.r_[2, rng.integers(0, 2, 299)]  # a class of one word
    weighed = lm_score.discounted(n)
    tree = lm_score.grow(cls, weighed, s.classes, s.levels)
    m = lm_score.Model(s, np.arange(300, dtype=np.uint64), n, cls, None, 0.0, int(n.sum()), 300, None, tree, np.zeros(1 << 12, np.float32))
    every, hist = np.arange(300), rng.integers(0, 2**63, (300, lm_score.FEATURES)).astype(np.uint64)
    mass = np.bincount(cls, weighed, s.classes)[cls]
    assert np.allclose(lm_score.within(m, every, hist), np.log(weighed / mass), atol=1e-5)
    m.fine = rng.normal(size=1 << 12).astype(np.float32)
    same = np.repeat(hist[:1], 300, axis=0)
    assert np.allclose(np.bincount(cls, np.exp(lm_score.within(m, every, same)))[:3], 1, atol=1e-5)
    m.fine[:] = 60  # exponentials of all levels multiplied don't fit
    assert np.isfinite(lm_score.within(m, every, hist)).all()

    m.fine = rng.normal(size=1 << 12).astype(np.float32)
    place, y = np.r_[rng.integers(0, 300, 700), -1, 5], np.r_[np.zeros(701, int), m.unknown]
    hist = rng.integers(0, 2**63, (702, lm_score.FEATURES)).astype(np.uint64)
    leaf = tree.leaf[place[:700]].astype(np.int64)
    z, first, turn = tree.odds(m.fine, leaf, hist[:700])
    grad, touched = np.zeros(1 << 12), first[:, :, None] ^ turn
    assert touched.shape == (lm_score.FEATURES, 2, lm_score.NEAR, 700) and (touched >> lm_score.NEAR == first[:, :, None] >> lm_score.NEAR).all()
    for i in range(700):
        for level in range(s.levels):
            cells = touched[:, level // lm_score.NEAR, level % lm_score.NEAR, i]
            assert np.isclose(z[level, i], tree.bias[level, leaf[i]] + m.fine[cells].sum(), atol=1e-3)
            np.add.at(grad, cells, 1 / (1 + np.exp(-float(z[level, i]))) - tree.right[level, leaf[i]])
    fine, learnt, sums = m.fine.copy(), np.zeros(1 << 12, np.float32), np.zeros(1 << 12, np.float32)
    lm_score.words_in(m, fine, learnt, sums, place, y, hist)
    assert np.allclose(learnt, grad**2, atol=1e-3) and not sums.any()
    assert np.allclose(fine, m.fine - lm_score.FINE_RATE * grad / np.sqrt(grad**2 + 1), atol=1e-4)
