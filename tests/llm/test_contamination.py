"""Containment search against brute force."""

import random
import re

from ferrograph.llm import contamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = {c: c + 32 for c in range(65, 91)}


def sets(text, k=5):
    w = WORD.findall((text or "").translate(UPPER))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def brute(docs, items):
    out = []
    for i, t in docs:
        d = sets(t)
        for j, q in items:
            s = sets(q)
            if s and len(s & d) >= 0.8 * len(s):
                out.append((i, j, len(s), len(s & d)))
    return sorted(out)


def run(spark, docs, items, **kw):
    d = spark.createDataFrame([(i, t, 0, "x") for i, t in docs], "doc_id long, text string, item_id int, n_item string")
    q = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    return sorted((r.doc_id, r.item_id, r.n_item, r.n_common) for r in contamination.contained(d, q, **kw).collect())


def test_against_brute_force(spark):
    rng = random.Random(5)
    vocab = [f"w{i}é" for i in range(400)]
    say = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(i, say(n)) for i, n in enumerate([1, 3, 5, 6, 9, 20, 40, 41, 80, 300, 1000, 12])] + [(90, None), (91, "..."), (5, say(7))]
    docs = [(i, say(rng.choice([2, 50, 3000]))) for i in range(10)] + [(50, None), (51, ""), (52, "-- !")]
    for i, (_, q) in enumerate(items[:12]):
        w = q.split()
        docs.append((100 + i, say(4000) + ", " + q.upper().replace("É", "é") + "! " + say(20000)))
        docs.append((200 + i, say(30) + " " + " ".join(w[: len(w) * 9 // 10]) + " " + say(30)))
        docs.append((300 + i, " ".join(x + (" " + say(1) if j % 13 == 12 else "") for j, x in enumerate(w))))
        half = len(w) // 2  # the two halves far apart
        docs.append((400 + i, " ".join(w[:half]) + " " + say(5000) + " " + " ".join(w[half:])))
    docs += [docs[-1], docs[-1]]
    want = brute(docs, items)
    assert len(want) > 20
    assert run(spark, docs, items) == want
    assert run(spark, docs, items, block_shingles=50) == want


def test_empty(spark):
    assert run(spark, [], [(1, "a b c")]) == [] and run(spark, [(1, "a b c")], []) == []


def test_items_of_few_shingles(spark):
    """Short items whole in a document are found whatever other shingles their windows hold."""
    rng = random.Random(8)
    vocab = [f"w{i}" for i in range(3000)]
    say = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(i, say(5 + i % 3)) for i in range(300)] + [(900, say(12)), (901, say(13))]
    docs = [(i, " . ".join(say(30) + " " + q for _, q in items[i::10]) + " " + say(30)) for i in range(10)]
    want = brute(docs, items)
    assert len(want) == len(items)
    assert run(spark, docs, items) == want


def test_recall_of_all_size_classes(spark):
    """2,000 items of one to three shingles in long texts, and longer ones of which four fifths are there: recall is one."""
    rng = random.Random(12)
    vocab = [f"w{i}" for i in range(5000)]
    say = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    short = [(i, say(5 + i % 3)) for i in range(2000)]
    longer = [(5000 + i, say(rng.randrange(13, 90))) for i in range(300)]
    part = {}
    for i, q in longer:
        w = q.split()
        part[i] = " ".join(w[: 4 + -(-8 * (len(w) - 4) // 10)])  # that share of the shingles, and no more
    docs = [(d, " ".join(say(40) + " " + q for _, q in short[d::20]) + " " + " ".join(say(60) + " " + part[i] for i, _ in longer[d::20])) for d in range(20)]
    want = brute(docs, short + longer)
    assert len(want) >= len(short) + len(longer)
    assert run(spark, docs, short + longer) == want
    assert run(spark, docs, short + longer, block_shingles=4000) == want
