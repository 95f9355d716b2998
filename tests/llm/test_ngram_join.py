"""The Jaccard join against brute force, with lists of common elements made to matter on small data."""

import itertools
import random
import re

import numpy as np
import pytest

from ferrograph.llm import ngram_join as nj
from ferrograph.llm.queries import op1_ngram_jaccard_join

UPPER = {c: c + 32 for c in range(65, 91)}


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UPPER))
    return frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def brute(rows, k, num, den):
    sets = [(i, shingles(t, k)) for i, t in rows]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (p, (_, s)), (q, (_, t)) in itertools.combinations(enumerate(sets), 2):
        if s and t and den * len(s & t) >= num * len(s | t):
            root[find(q)] = find(p)
    low = {}
    for p, (i, _) in enumerate(sets):
        low[find(p)] = min(low.get(find(p), i), i)
    return sorted((i, len(s), low[find(p)] if s else i) for p, (i, s) in enumerate(sets))


def run(spark, rows, k=4, num=85, den=100):
    df = spark.createDataFrame([(i, t, 7, "n") for i, t in rows], "doc_id long, text string, node int, prefix string")
    return sorted((r.doc_id, r.n_shingles, r.component_id) for r in nj.jaccard_components(df, k, num, den).collect())


def sample(seed, size=160):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)]
    say = lambda n: [rng.choice(vocab) for _ in range(n)]
    passage, base = say(60), say(90)
    rows = [(1000, None), (1001, ""), (1002, " \n"), (1003, "one"), (1004, "One"), (1005, "one two three"), (1006, "a b c d"), (1007, "a b c d e"), (1008, "x " * 5000)]
    for i in range(size):
        kind = i % 5
        if kind == 0:
            w = say(rng.randrange(1, 60))
        elif kind == 1:  # a passage that many share
            w = say(rng.randrange(2, 20)) + passage + say(rng.randrange(2, 20))
        elif kind in (2, 3):  # copies of one text with a few words changed, around the threshold
            w = list(base)
            for _ in range(rng.randrange(0, 5)):
                w[rng.randrange(len(w))] = rng.choice(vocab)
        else:  # short sets: subsets
            w = say(14)[: rng.randrange(5, 15)] if i % 2 else list(passage[:16])
            if rng.random() < 0.7:
                w = w[: rng.randrange(5, len(w) + 1)] if len(w) > 5 else w
        rows.append((rng.randrange(10_000) * 1000 + i, " ".join(w)))
    return rows + [rows[-1], (5, rows[-2][1].upper())]


@pytest.mark.parametrize("seed", range(3))
def test_against_brute_force(spark, seed):
    rows = sample(seed)
    assert run(spark, rows) == brute(rows, 4, 85, 100)


def test_common_elements_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(nj, "OFTEN", 3)
    monkeypatch.setattr(nj, "BLOCK", 8)
    rows = sample(7)
    assert run(spark, rows) == brute(rows, 4, 85, 100)
    assert run(spark, rows, 5, 80, 100) == brute(rows, 5, 80, 100)


def test_long_lists_of_rare_elements(spark, monkeypatch):
    """Lists that turn out longer than their count promised are led and compared too."""
    monkeypatch.setattr(nj, "OFTEN", 30)
    short = nj.scan
    monkeypatch.setattr(nj, "scan", lambda lists, ratio, x, often: short(lists, ratio, x, often, long=3))
    rows = sample(11, 250)
    assert run(spark, rows) == brute(rows, 4, 85, 100)


def test_on_data(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in op1_ngram_jaccard_join(spark, "/root/testdata/sf0.001").collect())
    assert got == brute(rows, 4, 85, 100)


def test_empty(spark):
    assert run(spark, []) == []


def test_parity_never_exceeds_the_difference():
    rng = np.random.default_rng(1)
    for n in (3, 600, 20_000):
        g = rng.integers(0, 2**63, n).astype(np.uint64)
        h = np.r_[g[: n * 9 // 10], rng.integers(0, 2**63, n // 20).astype(np.uint64)]
        a, b = (np.frombuffer(nj.parity(v), np.uint64) for v in (g, h))
        if len(a) == len(b):
            assert np.bitwise_count(a ^ b).sum() <= len(np.setxor1d(g, h))


def test_boundary_weighs_both_costs():
    r = nj.Ratio(17, 20)
    assert [r.subsets(n) for n in (1, 5, 6, 7)] == [1, 1, 2, 9]
    assert 5 <= nj.boundary({n: 100 for n in range(1, 40)}, r, 4.0) < nj.LIGHT_MOST


def test_full_round_follows_an_empty_one(spark, monkeypatch):
    """If the nearest pairs give nothing new, the farther pairs of led lists are compared all the same."""
    rounds, apart = [], nj.apart

    def none_near(led, comp, cand, sig, ratio, x, best):
        rounds.append(best)
        return cand.limit(0) if best else apart(led, comp, cand, sig, ratio, x, best)

    monkeypatch.setattr(nj, "OFTEN", 3)
    monkeypatch.setattr(nj, "BLOCK", 8)
    monkeypatch.setattr(nj, "apart", none_near)
    rows = sample(7)
    assert run(spark, rows) == brute(rows, 4, 85, 100)
    assert rounds == [True, False]


def test_links_through_rows_without_an_id(spark):
    w = [f"w{i}" for i in range(80)]
    near = lambda lo: " ".join(w[:lo] + ["x", "y"] + w[lo:])
    texts = {5: " ".join(w[:60]), None: " ".join(w[3:63]), 7: " ".join(w[6:66])}
    df = spark.createDataFrame([(i, t) for i, t in texts.items()] + [(None, None), (None, near(3))], "doc_id long, text string")
    ends = shingles(texts[5], 4), shingles(texts[7], 4)
    assert 100 * len(ends[0] & ends[1]) < 85 * len(ends[0] | ends[1])
    got = nj.jaccard_components(df).collect()
    assert len(got) == 5 and {r.component_id for r in got if r.n_shingles == 57} == {5}
    assert {(r.n_shingles, r.component_id) for r in got if r.doc_id is None} == {(57, 5), (0, None), (len(shingles(near(3), 4)), None)}


def test_digests_that_sets_share(spark, monkeypatch):
    """Sets of one digest that are not equal are told apart by the second one."""
    rows = sample(5, 60)
    sig = nj.signatures(spark.createDataFrame([(i, i, t) for i, t in rows], "doc_id long, key long, text string"), 4, nj.Ratio(17, 20))
    assert nj.shared_digests(sig) == set()
    bad = sig.withColumn("node", nj.F.when(nj.F.col("n") > 0, nj.F.lit(3)).otherwise(0))
    assert nj.shared_digests(bad) == {3}
    g = np.arange(1, 9, dtype=np.uint64)
    d = nj._digest(g)
    assert nj._node(g, set()) == d and nj._node(g, {d}) == d ^ nj._check(g) != d
    real = nj.shared_digests
    every = [r.node for r in sig.filter("n > 0").select("node").distinct().limit(50).collect()]
    monkeypatch.setattr(nj, "shared_digests", lambda s: real(s) | set(every))  # as if these were shared
    assert run(spark, rows) == brute(rows, 4, 85, 100)
