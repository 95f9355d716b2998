"""Exact dedup, secret scans and chat formatting against brute force."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from ferrograph.llm import chat, exact_dedup, secret_scan

DOCS = "doc_id long, text string, source string, kept string, digest int"
WHITE = re.compile(r"[\x20\x09-\x0D]")


def docs(spark, rows):
    return spark.createDataFrame([(i, t, s, "x", 1) for i, t, s in rows], DOCS)


ROWS = [
    (5, "a b\tc", "s1"), (3, "abc", "s2"), (9, "a  b  c", "s1"), (8, "a  b  c", None), (1, None, "s1"), (2, "", "s2"),
    (4, " \n", "s2"), (7, "xé" * 5000, "s1"), (6, "xé" * 5000, "s1"), (6, "xé" * 5000, "s1"), (10, "a bc", "s3"), (None, "q q", "s3"), (11, "qq", "s3"),
]


def brute(rows):
    groups = {}
    for i, t, _ in rows:
        groups.setdefault(WHITE.sub("", t or ""), []).append((-len(t or ""), i is None, i or 0))
    out = []
    for i, t, _ in rows:
        n = WHITE.sub("", t or "")
        best = min(groups[n])
        keep = None if best[1] else best[2]
        out.append((i, keep, len(groups[n]), i == keep, hashlib.sha256(n.encode()).hexdigest()))
    return sorted(out, key=str)


def test_exact_groups(spark):
    got = [tuple(r) for r in exact_dedup.exact_groups(docs(spark, ROWS)).collect()]
    assert sorted(got, key=str) == brute(ROWS)


DIGESTS = {
    "weak": lambda c: F.substring(F.sha2(c, 256), 1, 0),  # all texts have one
    "short": lambda c: F.substring(F.sha2(c, 256), 1, 1),
    "long": lambda c: F.sha2(c, 512),
}


@pytest.mark.parametrize("name", list(DIGESTS))
def test_other_digests(spark, name):
    """Null and repeated ids included: no row vanishes or multiplies."""
    rows = [*ROWS, (None, "qq", "s1"), (None, None, "s1"), (6, "other", "s1")]
    got = exact_dedup.exact_groups(docs(spark, rows), digest=DIGESTS[name]).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows)


def test_hot_digests_beyond_a_broadcast(spark, monkeypatch):
    from ferrograph.llm import shared

    rows = [(i, "hot" if i % 3 else f"t{i % 30}", "s") for i in range(300)] + [(None, "hot", "s")]
    monkeypatch.setattr(shared, "BROADCAST_ROWS", 2)
    monkeypatch.setattr(shared, "HOT", 50)
    got = [tuple(r) for r in exact_dedup.exact_groups(docs(spark, rows)).collect()]
    assert sorted(got, key=str) == brute(rows)


def test_index_over_deliveries(spark):
    index = exact_dedup.Index(spark)
    assert index.lookup(docs(spark, ROWS)).collect() == []
    parts = [[(10 * d + i, f"t{(d * i) % 7} x", "s") for i in range(10)] for d in range(9)]
    for part in parts:
        index.add(docs(spark, part))
    assert [len(level) for level in index.levels] == [1, 2]
    old = [r for part in parts for r in part]
    new = [(900, "t3x", "s"), (901, "none", "s"), (902, "t 0 x", "s"), (None, "t0x", "s")]
    want = {}
    for i, t, _ in old:
        want.setdefault(WHITE.sub("", t), []).append((-len(t), i))
    expect = sorted(((i, min(g)[1], len(g)) for i, t, _ in new if (g := want.get(WHITE.sub("", t)))), key=str)
    for few in (2000, 0):  # by the files' filters, and by a join
        exact_dedup.PROBES = few
        got = [(r.doc_id, r.keep_id, r.group_size) for r in index.lookup(docs(spark, new)).collect()]
        assert sorted(got, key=str) == expect
    exact_dedup.PROBES = 2000
    plan = index.runs()[0].filter(F.col("digest").isin("a", "b"))._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(digest" in plan or "Or(EqualTo(digest" in plan


def test_exact_groups_empty(spark):
    assert exact_dedup.exact_groups(docs(spark, [])).collect() == []


ASSIGN = re.compile(r"""((?a:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def spans(text):
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    return ",".join(f"{secret_scan.KINDS[k]}:{s}:{e}" for s, k, e in sorted(out))


def test_secrets(spark):
    live = "Zx9" + "aB3d" * 8
    texts = [
        "password = 'hunter2hunter2' and API_KEY:short secret: token: abcdefgh12", "é𝒳 AKIA" + "Q" * 16 + " AKIAXX " + "0af" * 12,
        "PassWd==" + "x" * 9 + "ToKen='a-b.c/d+e'", None, "", f"plain {live} tail", "copied " + "Cp7" + "eF3d" * 8, "copied " + "Cp7" + "eF3d" * 8,
        "x password=" + "k" * 20 + " ", " ".join("token=abcdefgh%04d" % i for i in range(900)), "éé" * 9000 + "secret=abcdefghij",
    ]
    rows = [(i, t, f"s{i}") for i, t in enumerate(texts)]
    got = {r.doc_id: r for r in secret_scan.secrets(docs(spark, rows)).collect()}
    for i, t in enumerate(texts):
        base = spans(t or "")
        assert got[i].base_sha256 == hashlib.sha256(base.encode()).hexdigest(), (i, base, got[i].spans)
        assert set(filter(None, base.split(","))) <= set(got[i].spans.split(","))
        assert (got[i].n_assign, got[i].n_access, got[i].n_hex) == tuple(base.count(k + ":") for k in ("assign", "access", "hex"))
    assert got[5].spans == f"opaque:6:{6 + len(live)}" and got[6].spans == "" and got[6].max_owners == 2
    assert secret_scan.secrets(docs(spark, [])).collect() == []


def test_repositories_tell_examples(spark):
    """A value that many documents of one owner hold is an example; a document that repeats it counts once."""
    copied, live, rows = "Cp7" + "eF3d" * 8, "Zx9" + "aB3d" * 60, []
    rows += [(i, f"a {copied} b", "hot") for i in range(25)] + [(100, f"{live} x {live}", "hot")] * 3 + [(101, f"see {live}", "hot"), (None, "q" * 200, None)]
    got = {r.doc_id: r for r in secret_scan.secrets(docs(spark, rows)).collect()}
    assert got[0].spans == "" and (got[0].n_live, got[0].n_example, got[0].max_repositories) == (0, 1, 25)
    assert got[100].spans == f"opaque:0:{len(live)},opaque:{len(live) + 3}:{2 * len(live) + 3}" and got[100].max_repositories == 2
    assert got[101].spans == f"opaque:4:{4 + len(live)}" and got[101].n_live == 1 and got[None].spans == ""


def test_secrets_on_data(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: r for r in secret_scan.secrets(df).collect()}
    for r in df.collect():
        assert got[r.doc_id].base_sha256 == hashlib.sha256(spans(r.text or "").encode()).hexdigest()


def test_chat(spark):
    conv = {1: ["a", "b"], 2: ["a", "b", "c"], 3: ["a", "b", "c"], 4: ["b"], 5: ["a", "c"], 6: [None], 7: ["", "z"], 8: ["a", "b", "d"], None: ["a"]}
    rows = [(c, t, "u", x, "y") for c, xs in conv.items() for t, x in enumerate(xs)] + [(4, 0, "u", "b", "y")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, place string")
    got = {r.conv_id: (r.n_turns, r.absorbed, r.rendered) for r in chat.formatted(df).collect()}
    assert set(got) == {2, 4, 5, 7, 8}
    assert got[2] == (3, 1, "".join(f"<|u|>\n{x}\n<|end|>\n" for x in "abc"))
    assert chat.formatted(df.limit(0)).collect() == []


def brute_chat(rows):
    """conv_id, n_turns, absorbed, rendered of the conversations that no longer one begins with."""
    conv = {}
    for c, t, role, text in rows:
        conv.setdefault(c, set()).add((t is not None, t or 0, role or "", text or ""))
    # turns are ordered by hash where turn and role are equal, so such ties stay out of the fixture
    seqs = {c: tuple((r, x) for _, _, r, x in sorted(ts)) for c, ts in conv.items()}
    out = []
    for seq in set(seqs.values()):
        if any(len(o) > len(seq) and o[: len(seq)] == seq for o in seqs.values()):
            continue
        ids = [c for c, s in seqs.items() if s == seq]
        keep = min(ids, key=lambda c: (c is None, c or 0))
        out.append((keep, len(seq), len(ids) - 1, "".join(f"<|{r}|>\n{x}\n<|end|>\n" for r, x in seq)))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", range(4))
def test_chat_against_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = []
    for c in [None, *range(40)]:
        n = rng.randrange(1, 6)
        for t in range(n):
            rows.append((c, None if t == 0 and rng.random() < 0.2 else t, rng.choice(["u", "u", "a", None]) if t < 2 else "u", rng.choice(["x", "x", "y", "", None])))
    rows += rng.sample(rows, 20)
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, key int")
    got = sorted((tuple(r) for r in chat.formatted(df).collect()), key=str)
    assert got == brute_chat(rows)
