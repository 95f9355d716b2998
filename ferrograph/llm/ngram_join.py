"""Jaccard self-join of documents on word n-grams, as connected components.

Sets of hashed shingles are joined by a size-aware scheme. Two sets of sizes a and b link
when the intersection has at least ceil(17 (a + b) / 37) elements (for 85 %).

* Light sets (up to a boundary x): every subset of exactly that many elements, for each
  partner size, is a key; two sets that share a key are linked, with nothing to verify.
* Heavy sets: each set posts its first a - ceil(17 a / 20) + 1 elements in a global order to
  inverted lists, and the lists are scanned. The order puts elements that are found in many
  lists last (counted over all sets), so a passage that many documents share is not posted by
  documents that have enough other elements. Pairs are counted over the lists and dropped when the
  count can't reach the wanted overlap; the rest is verified on the whole texts.
* The boundary x is the one with the least expected cost: subsets on one side, list entries
  and the pairs they are expected to bring on the other.

Lists of very common elements would yield pairs by the square of their length. They are
first scanned against leaders, which links groups of near copies; only pairs that are then
still in different components are compared, list by list in blocks of bounded size; of a long list's blocks only
those whose sizes may link meet. There
each set has a parity bitmap, a bit for every bucket of elements: two sets differ in at least as many
elements as their bitmaps differ in bits, so pairs with too many are out without a look at the texts, and no
others are. Of each set the nearest partner is tried first, and the rest after components are joined.
No pair of linked sets is lost: sharing a list, it is compared or already connected.

Equal sets are one node from the start, known by a 64-bit digest of the set. A second digest finds sets that share the
first without being equal; these take another node, so no two sets are taken for one by less than 128 bits.

Nulls and texts without words are empty sets, which link with nothing. Rows without a doc_id link like others, and have
the component of what they link with (null if no row there has an id). Rows that repeat a doc_id are kept, each with the
component of its own text. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrograph.llm import textkit as tk
from ferrograph.llm.shared import BROADCAST_ROWS, components, most_frequent, saved, small

U = np.uint64
#: Elements in the list of common ones that is broadcast at most (16 bytes each), and in how many lists they are at least.
COMMON, OFTEN = 1 << 18, 24
#: Largest boundary that is tried.
LIGHT_MOST = 16


class Ratio:
    """The threshold num/den on Jaccard similarity, in whole numbers."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den

    def overlap(self, a, b):
        """Least intersection of linked sets of sizes a and b."""
        return -(-(a + b) * self.num // (self.num + self.den))

    def prefix(self, a):
        return a - -(-a * self.num // self.den) + 1

    def sizes(self, a, b):
        """Can sizes a <= b link?"""
        return a * self.den >= b * self.num

    def partners(self, a: int) -> range:
        return range(-(-a * self.num // self.den), a * self.den // self.num + 1)

    def subsets(self, a: int) -> int:
        return sum(comb(a, o) for b in self.partners(a) if (o := self.overlap(a, b)) <= min(a, b))


def _digest(g: np.ndarray) -> int:
    """Of a sorted set; 0 only for the empty one."""
    if not len(g):
        return 0
    with np.errstate(over="ignore"):
        x = tk.mix(np.bitwise_xor.reduce(tk.mix(g + U(0x632BE59BD9B4E019)), keepdims=True) + g.sum(dtype=U) * U(3) + U(len(g)))
    return int(x.view(np.int64)[0]) or 1


def _check(g: np.ndarray) -> int:
    """A second digest, of other sums than the first."""
    if not len(g):
        return 0
    with np.errstate(over="ignore"):
        x = tk.mix(tk.mix(g ^ U(0xC2B2AE3D27D4EB4F)).sum(dtype=U, keepdims=True) * U(0x165667B19E3779F9) + U(len(g)))
    return int(x.view(np.int64)[0])


def _node(g: np.ndarray, shared: set[int]) -> int:
    """The node of a set; shared: digests that several sets have."""
    d = _digest(g)
    return d ^ _check(g) if d in shared else d


def _sets(batch: pa.RecordBatch, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, set) of a batch with a column text."""
    col = batch.column(batch.schema.get_field_index("text"))
    for lo, _, b, off in tk.slabs(col):
        h, first = tk.word_hashes(b, off, ~tk.SPACE)
        yield from enumerate(tk.row_shingles(h, first, k), lo)


SIGNATURE = "doc_id long, key long, node long, other long, n long, prefix array<long>, parity binary"
POSTING = "token long, node long, n int, pos int, common int"
PAIR = "a long, b long, na int, nb int, shared int, common int"


def signatures(docs: DataFrame, k: int, ratio: Ratio) -> DataFrame:
    """doc_id, key (of the row's text), node (set digest), other (a second one), n (set size), prefix (its smallest elements),
    parity; the last two null for sets the task had before."""

    def run(batches):
        tk.lean()
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            nodes, others, sizes, prefixes, bits = [], [], [], [], []
            for _, g in _sets(batch, k):
                node = _digest(g)
                nodes.append(node)
                others.append(_check(g))
                sizes.append(len(g))
                if len(g) and (node, others[-1]) not in seen:
                    if len(seen) < 500_000:
                        seen.add((node, others[-1]))
                    prefixes.append(g[: ratio.prefix(len(g))].view(np.int64))
                    bits.append(parity(g))
                else:
                    prefixes.append(None)
                    bits.append(None)
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "key")),
                    pa.array(nodes, pa.int64()),
                    pa.array(others, pa.int64()),
                    pa.array(sizes, pa.int64()),
                    _lists(prefixes),
                    pa.array(bits, pa.binary()),
                ],
                ["doc_id", "key", "node", "other", "n", "prefix", "parity"],
            )

    return docs.select("doc_id", "key", "text").mapInArrow(run, SIGNATURE)


def shared_digests(sig: DataFrame) -> set[int]:
    """Digests that sets of different second digests have: about one for 10**10 sets, so they are few."""
    two = sig.filter("n > 0").groupBy("node").agg(F.min("other").alias("least"), F.max("other").alias("most"))
    return {r["node"] for r in two.filter("least <> most").select("node").collect()}


def parity(g: np.ndarray) -> bytes:
    """A bit for each bucket of elements, set if their number is odd; as many buckets as elements, 512 to 8192."""
    m = 1 << min(13, max(9, int(len(g) - 1).bit_length()))
    odd = np.bincount((g >> U(20)).astype(np.int64) & (m - 1), minlength=m) & 1
    return np.packbits(odd.astype(bool), bitorder="little").tobytes()


def _lists(parts: list[np.ndarray | None]) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([0 if p is None else len(p) for p in parts])]).astype(np.int32)
    there = [p for p in parts if p is not None]
    flat = pa.array(np.concatenate(there) if there else np.empty(0, np.int64))
    mask = pa.array([p is None for p in parts], pa.bool_())
    return pa.ListArray.from_arrays(pa.array(ends), flat, mask=mask)


def common_elements(sig: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The elements in most prefixes, sorted by value, and their places in order of frequency. At most COMMON of them."""
    counts = saved(sig.select(F.explode("prefix").alias("token")).groupBy("token").count().filter(F.col("count") >= OFTEN), "often")
    top = most_frequent(counts, "token", "count", COMMON, OFTEN).toPandas()
    tokens = top["token"].to_numpy(np.int64).view(U)
    place = np.lexsort((tokens, top["count"].to_numpy(np.int64))).argsort()
    order = np.argsort(tokens)
    return tokens[order], place[order].astype(np.int64)


def boundary(sizes: dict[int, int], ratio: Ratio, length: float) -> int:
    """Largest size handled by subsets: least expected rows. sizes: number of sets by size; length: mean length of a list."""

    def cost(x: int) -> float:
        light = sum(c * ratio.subsets(n) for n, c in sizes.items() if n <= x)
        # sets just below the boundary are in the lists too, for partners beyond it
        heavy = sum(c * ratio.prefix(n) * (1 + length) for n, c in sizes.items() if n >= -(-(x + 1) * ratio.num // ratio.den))
        return light + heavy

    return min(range(LIGHT_MOST + 1), key=cost)


def light_links(docs_sets: DataFrame) -> DataFrame:
    """Links of light sets: those with a subset key in common, as a star around the key's smallest node."""
    low = docs_sets.groupBy("token").agg(F.min("node").alias("a"))
    return docs_sets.join(low, "token").filter("a <> node").select("a", F.col("node").alias("b"))


def postings(docs: DataFrame, k: int, ratio: Ratio, often: tuple[np.ndarray, np.ndarray], x: int, twins: set[int] = frozenset()) -> DataFrame:
    """Postings of heavy sets (pos >= 0), and subset keys of light ones (pos = -1); of equal sets of a task only once."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(often)
    least = -(-(x + 1) * ratio.num // ratio.den)

    def run(batches):
        tk.lean()
        tokens, place = shared.value
        bits = np.zeros(1 << 22, bool)
        bits[(tokens >> U(8)).astype(np.int64) & 0x3FFFFF] = True
        seen: set[int] = set()
        out: list[list[np.ndarray]] = [[], [], [], [], []]
        held = 0

        def put(token, node, n, pos, common):
            nonlocal held
            m = len(token)
            held += m
            for col, v in zip(out, (token.view(np.int64), node, n, pos, common)):
                col.append(np.full(m, v, np.int64) if np.isscalar(v) else v)

        def flush():
            nonlocal held
            cols = [np.concatenate(c) for c in out]
            for c in out:
                c.clear()
            held = 0
            for lo in range(0, len(cols[0]), 50_000):
                part = [c[lo : lo + 50_000] for c in cols]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part[0]), pa.array(part[1]), *(pa.array(c.astype(np.int32)) for c in part[2:])],
                    ["token", "node", "n", "pos", "common"],
                )

        for batch in batches:
            for _, g in _sets(batch, k):
                n = len(g)
                node = _node(g, twins)
                if not n or node in seen:
                    continue
                if len(seen) < 500_000:
                    seen.add(node)
                if n <= x:
                    put(_subset_keys(g, ratio), node, n, -1, 0)
                if n >= least:
                    p, common = ratio.prefix(n), 0
                    maybe = np.flatnonzero(bits[(g >> U(8)).astype(np.int64) & 0x3FFFFF])
                    if len(maybe) and len(tokens):
                        at = np.minimum(np.searchsorted(tokens, g[maybe]), len(tokens) - 1)
                        hit = tokens[at] == g[maybe]
                        maybe, at = maybe[hit], at[hit]
                        rest = np.ones(n, bool)
                        rest[maybe] = False
                        last = g[maybe][np.argsort(place[at])]
                        g = np.concatenate([g[rest], last])
                        common = max(0, p - int(rest.sum()))
                    put(g[:p], node, n, np.arange(p), common)
                if held > 100_000:
                    yield from flush()
        if held:
            yield from flush()

    return docs.select("text").mapInArrow(run, POSTING)


def _subset_keys(g: np.ndarray, ratio: Ratio) -> np.ndarray:
    """A key for each subset that is large enough to link the set with one of some size."""
    keys = []
    n = len(g)
    for b in ratio.partners(n):
        o = ratio.overlap(n, b)
        if o <= min(n, b):
            sets = np.array(list(combinations(g.tolist(), o)), U).reshape(-1, o)
            with np.errstate(over="ignore"):
                keys.append(tk.mix(tk.mix(sets).sum(axis=1, dtype=U) + U(min(n, b) * 4099 + max(n, b)) * U(0x9E3779B97F4A7C15)))
    return np.concatenate(keys) if keys else np.empty(0, U)


def scan(lists: DataFrame, ratio: Ratio, x: int, often: tuple[np.ndarray, np.ndarray], long: int = 48) -> DataFrame:
    """Pairs from the lists, which come sorted by token, n, node.

    From lists of common elements, and those over `long`, a pair has shared = -1 (a leader's
    pair, always verified), and a row with shared = -2 names the list's element in a; from the
    rest shared counts the lists of this task.
    """
    shared = lists.sparkSession.sparkContext.broadcast(often)

    def groups(t, node, n, pos, common, tokens):
        """Pairs of whole lists."""
        m = len(t)
        start = np.flatnonzero(np.r_[True, t[1:] != t[:-1]]) if m else np.empty(0, int)
        length = np.diff(np.r_[start, m])
        is_common = np.isin(t[start].view(U), tokens) | (length > long)
        size = np.repeat(np.where(is_common, 0, length), length)
        ai, bi = [], []
        for step in range(1, int(size.max(initial=0))):
            i = np.flatnonzero(size[:-step] > step) if step < m else np.empty(0, int)
            i = i[t[i] == t[i + step]]
            if not len(i):
                break
            j = i + step
            ok = ratio.sizes(n[i], n[j]) & (n[j] > x)  # every element in common counts here, so no test of positions
            ai.append(i[ok])
            bi.append(j[ok])
        a = np.concatenate(ai) if ai else np.empty(0, int)
        b = np.concatenate(bi) if bi else np.empty(0, int)
        la, lb = [], []
        for s, size_ in zip(start[is_common & (length > 1)].tolist(), length[is_common & (length > 1)].tolist()):
            left = np.arange(s, s + size_)
            while len(left) > 1:
                # the leader has the fewest rarer elements before this one: it is nearest to what the list has in common
                at = int(pos[left].argmin())
                lead, left = left[at], np.delete(left, at)
                small_, large_ = np.minimum(n[lead], n[left]), np.maximum(n[lead], n[left])
                ok = ratio.sizes(small_, large_) & (large_ > x)
                ok &= 1 + np.minimum(n[lead] - pos[lead] - 1, n[left] - pos[left] - 1) >= ratio.overlap(small_, large_)
                lb.append(left[ok])
                la.append(np.full(int(ok.sum()), lead))
                left = left[~ok]
        la_, lb_ = (np.concatenate(v) if v else np.empty(0, int) for v in (la, lb))
        return (a, b, 1), (la_, lb_, -1), t[start[is_common & (length > 1)]]

    def run(batches):
        tk.lean()
        tokens = shared.value[0]
        rest = None
        found: dict[int, list] = {1: [], -1: []}
        held, leads = 0, []

        def work(cols):
            nonlocal held
            t, node, n, pos, common = cols
            if not len(t):
                return
            keep = np.r_[True, (t[1:] != t[:-1]) | (node[1:] != node[:-1])]
            t, node, n, pos, common = (c[keep] for c in (t, node, n, pos, common))
            *pairs, led = groups(t, node, n, pos, common, tokens)
            leads.append(led)
            for i, j, kind in pairs:
                if len(i):
                    swap = node[i] > node[j]
                    u, v = np.where(swap, j, i), np.where(swap, i, j)
                    found[kind].append(np.stack([node[u], node[v], n[u], n[v], np.minimum(common[u], common[v])]))
                    held += len(i)

        def flush():
            nonlocal held
            for kind, parts in found.items():
                if parts:
                    a, b, na, nb, common = np.concatenate(parts, axis=1)
                    order = np.lexsort((b, a))
                    a, b, na, nb, common = (c[order] for c in (a, b, na, nb, common))
                    first = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
                    count = np.diff(np.r_[first, len(a)]) if kind == 1 else np.full(len(first), -1)
                    cols = [a[first], b[first], *(c.astype(np.int32) for c in (na[first], nb[first], count, common[first]))]
                    for lo in range(0, len(first), 50_000):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(c[lo : lo + 50_000]) for c in cols], ["a", "b", "na", "nb", "shared", "common"]
                        )
                    parts.clear()
            led = np.concatenate(leads) if leads else np.empty(0, np.int64)
            leads.clear()
            none = pa.array(np.zeros(len(led), np.int64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(led), none, *[none.cast(pa.int32())] * 2, pa.array(np.full(len(led), -2, np.int32)), none.cast(pa.int32())],
                ["a", "b", "na", "nb", "shared", "common"],
            )
            held = 0

        for batch in batches:
            cols = [batch.column(i).to_numpy().astype(np.int64) for i in range(5)]
            if rest is not None:
                cols = [np.concatenate([r, c]) for r, c in zip(rest, cols)]
            cut = int(np.searchsorted(cols[0], cols[0][-1])) if len(cols[0]) else 0
            work([c[:cut] for c in cols])
            rest = [c[cut:] for c in cols]
            if held > 300_000:
                yield from flush()
        if rest is not None:
            work(rest)
        yield from flush()

    return lists.mapInArrow(run, PAIR)


def candidates(pairs: DataFrame, ratio: Ratio) -> DataFrame:
    """Pairs that may reach the wanted overlap: the shared elements of the prefixes, with all that stands after them."""
    num, den = ratio.num, ratio.den
    both = pairs.filter("shared > -2").groupBy("a", "b").agg(
        F.max("na").alias("na"), F.max("nb").alias("nb"), F.sum("shared").alias("shared"), F.min("shared").alias("least"), F.max("common").alias("common")
    )
    wanted = F.expr(f"((na + nb) * {num} + {num + den - 1}) div {num + den}")
    after = F.expr(f"greatest((na * {num} + {den - 1}) div {den}, (nb * {num} + {den - 1}) div {den}) - 1")
    return both.filter((F.col("least") < 0) | (F.col("shared") + F.col("common") + after >= wanted)).select("a", "b")


def verified(cand: DataFrame, reps: DataFrame, docs: DataFrame, k: int, ratio: Ratio, twins: set[int] = frozenset()) -> DataFrame:
    """Those candidates whose whole texts' sets link: (a, b)."""
    need = cand.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(reps, "node")
    need = saved(need.select("node", "key"), "need")
    ids = F.broadcast(need) if need.count() <= BROADCAST_ROWS else need
    texts = docs.select("key", "text").join(ids, "key").select("node", "text")
    texts = saved(texts, "texts")
    both = cand.join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a").join(
        texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b"
    )

    def run(batches):
        tk.lean()
        for batch in (whole.slice(lo, 500) for whole in batches for lo in range(0, whole.num_rows, 500)):
            ab = [batch.column(batch.schema.get_field_index(c)) for c in ("a", "b")]
            sets = [
                _sets(pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(c))], ["text"]), k)
                for c in ("ta", "tb")
            ]
            # a key may stand for several texts: the digests tell which ones the pair is of
            keep = [
                len(np.intersect1d(g, h, assume_unique=True)) >= ratio.overlap(len(g), len(h)) and (_node(g, twins), _node(h, twins)) == ids
                for (_, g), (_, h), ids in zip(*sets, zip(*(c.to_pylist() for c in ab)))
            ]
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([c.filter(mask) for c in ab], ["a", "b"])

    return both.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def jaccard_components(docs: DataFrame, k: int = 4, num: int = 85, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links), for each row of `docs` (doc_id, text)."""
    g = np.gcd(num, den)
    ratio = Ratio(num // g, den // g)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # rows are found again by their id, and those without one by their text
    docs = docs.withColumn("key", F.coalesce("doc_id", F.xxhash64("text")))
    sig = saved(signatures(docs, k, ratio), "sig")
    twins = shared_digests(sig)
    if twins:
        sig = saved(sig.withColumn("node", F.when(F.col("node").isin(*twins), F.col("node").bitwiseXOR(F.col("other"))).otherwise(F.col("node"))), "sig")
    often = common_elements(sig)
    counted = sig.filter("n > 0").agg(F.sum(F.size("prefix")).alias("all")).first()["all"] or 0
    few = sig.filter(f"n between 1 and {2 * LIGHT_MOST}").groupBy("n").count().limit(2 * LIGHT_MOST).collect()
    x = boundary({r["n"]: r["count"] for r in few}, ratio, min(4.0, 1 + len(often[0]) * OFTEN / max(1, counted)))
    reps = sig.filter("n > 0").groupBy("node").agg(F.min("doc_id").alias("rep"), F.min("key").alias("key"))

    posted = saved(postings(docs, k, ratio, often, x, twins), "post")
    linked = light_links(posted.filter("pos < 0").select("token", "node").distinct())
    lists = posted.filter("pos >= 0").repartition("token").sortWithinPartitions("token", "n", "node")
    pairs = saved(scan(lists, ratio, x, often), "pairs")
    cand = saved(candidates(pairs, ratio), "cand")
    links = saved(verified(cand, reps, docs, k, ratio, twins).union(linked), "links")
    comp = saved(components(links), "comp")

    # lists that were only scanned against leaders: compare what is still apart
    led = led_lists(posted.filter("pos >= 0"), pairs.filter("shared = -2").select(F.col("a").alias("token")))
    for best in (True, False):  # the nearest first: then most sets of a group are connected, and few pairs are left
        far = apart(led, comp, cand, sig, ratio, x, best)
        if far.isEmpty():
            continue
        cand = cand.unionByName(far)
        comp = merged(comp, saved(verified(far, reps, docs, k, ratio, twins), "links"))
    root = reps.join(comp, "node", "left").select("node", "rep", F.coalesce("root", "node").alias("root"))
    low = root.groupBy("root").agg(F.min("rep").alias("component_id"))
    label = root.join(low, "root").select("node", "component_id")
    return sig.join(label, "node", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id")
    )


def one_of_each(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of `docs`, with all their columns, without those that are in a component of a smaller doc_id."""
    comp = jaccard_components(docs, k, num, den)
    stays = F.max((F.col("doc_id") == F.col("component_id")).cast("int"))
    gone = saved(comp.groupBy("doc_id").agg(stays.alias("stays")).filter("stays = 0").select(F.col("doc_id").alias("_gone")), "gone")
    return docs.join(small(gone, gone.count()), docs["doc_id"].cast("long") == gone["_gone"], "left_anti")


def merged(comp: DataFrame, links: DataFrame) -> DataFrame:
    """(node, root) after more links: only the roots that they join are worked on."""
    ends = comp.select(F.col("node").alias("a"), F.col("root").alias("ra")), comp.select(F.col("node").alias("b"), F.col("root").alias("rb"))
    edges = links.join(ends[0], "a", "left").join(ends[1], "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
    moved = components(edges).select(F.col("node").alias("root"), F.col("root").alias("to"))
    new = links.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(comp, "node", "left_anti")
    every = comp.unionByName(new.withColumn("root", F.col("node")))
    return saved(every.join(moved, "root", "left").select("node", F.coalesce("to", "root").alias("root")), "comp")


def led_lists(posted: DataFrame, token: DataFrame) -> DataFrame:
    """token, node, n of the lists that were only scanned against leaders; of equal sets once."""
    return saved(posted.join(token.distinct(), "token").select("token", "node", "n").distinct(), "led")


def apart(led: DataFrame, comp: DataFrame, done: DataFrame, sig: DataFrame, ratio: Ratio, x: int, best: bool) -> DataFrame:
    """Pairs of one of these lists in different components that may link and have not been compared.

    With `best`, of each set and list only the pair whose bitmaps differ least.
    """
    hot = led.join(comp, "node", "left").withColumn("root", F.coalesce("root", "node"))
    mixed = hot.groupBy("token").agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.count("*").alias("m"))
    mixed = mixed.filter("r0 <> r1").select("token", "m")
    # long lists are cut by size, into classes of which only a class and the next hold sets that may link, and these by hash
    step = float(np.log(ratio.den / ratio.num)) * 1.0001
    hot = hot.join(mixed, "token").withColumn("size", F.when(F.col("m") <= BLOCK, 0).otherwise(F.floor(F.log("n") / step)).cast("int"))
    blocks = hot.groupBy("token", "size").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    blocks = blocks.groupBy("token").agg(F.map_from_entries(F.collect_list(F.struct("size", "blocks"))).alias("blocks"))
    hot = saved(hot.join(blocks, "token").drop("m"), "hot")
    bits = sig.filter("parity is not null").join(hot.select("node").distinct(), "node", "left_semi").groupBy("node").agg(F.first("parity").alias("parity"))
    own = F.col("size") * 1_000_000 + F.pmod(F.xxhash64("node"), F.element_at("blocks", F.col("size"))).cast("int")
    hot = hot.join(bits, "node").withColumn("own", own)
    # a list of several blocks is dealt as pairs of blocks
    near = F.expr(
        "flatten(transform(filter(array(size - 1, size, size + 1), c -> map_contains_key(blocks, c)), "
        "c -> transform(sequence(0, element_at(blocks, c) - 1), i -> c * 1000000 + i)))"
    )
    hot = hot.withColumn("other", F.explode(near))
    hot = hot.select("token", F.least("own", "other").alias("one"), F.greatest("own", "other").alias("two"), "own", "node", "n", "root", "parity")
    hot = hot.repartition("token", "one", "two").sortWithinPartitions("token", "one", "two", "n")

    def run(batches):
        tk.lean()
        names = ("token", "one", "two", "own", "node", "n", "root", "parity")
        held, last, found = [[] for _ in names], None, set()
        for batch in batches:
            for row in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in names)):
                if row[:3] != last:
                    found.update(_near(held, ratio, x, best))
                    held, last = [[] for _ in names], row[:3]
                for col, v in zip(held, row):
                    col.append(v)
            if len(found) > 100_000:
                yield _pairs(found)
                found = set()
        found.update(_near(held, ratio, x, best))
        yield _pairs(found)

    return saved(hot.mapInArrow(run, "a long, b long").distinct().join(done, ["a", "b"], "left_anti"), "far")


#: Sets of a list that are compared with one another in one go.
BLOCK = 4096


def _pairs(found: set[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*found) if found else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _near(cols: list[list], ratio: Ratio, x: int, best: bool):
    """Pairs of a list (or of two of its blocks), sorted by size, that sizes and bitmaps allow to link.

    Places in the order tell nothing here: the pair's first element in common may stand in another list.
    """
    if len(cols[0]) < 2:
        return
    at_best: dict[int, tuple[int, int]] = {}
    one, two = cols[1][0], cols[2][0]
    own, node, n, root = (np.array(c, np.int64) for c in cols[3:7])
    width = np.array([len(p) for p in cols[7]])
    # for each width the bitmaps of that width, and those twice as wide folded to it
    table: dict[int, np.ndarray] = {}
    for w in set(width.tolist()):
        m = np.zeros((len(n), w // 8), U)
        for i, p in enumerate(cols[7]):
            if len(p) == w:
                m[i] = np.frombuffer(p, U)
            elif len(p) == 2 * w:
                m[i] = np.frombuffer(p, U)[: w // 8] ^ np.frombuffer(p, U)[w // 8 :]
        table[w] = m
    last = np.searchsorted(n, n * ratio.den // ratio.num, "right")
    for i in range(len(n) - 1):
        j = np.arange(i + 1, last[i])
        j = j[(root[j] != root[i]) & (n[j] > x)]
        if one != two:
            j = j[own[j] != own[i]]
        wanted = ratio.overlap(n[i], n[j])
        if len(j):
            m = table[width[i]]
            differ = np.bitwise_count(m[j] ^ m[i]).sum(axis=1, dtype=np.int64)
            j, differ = (v[differ <= n[i] + n[j] - 2 * wanted] for v in (j, differ))
            if best:
                for k, d in zip(j.tolist(), differ.tolist()):
                    at_best[k] = min(at_best.get(k, (1 << 40, 0)), (d, i))
                if len(j):
                    at_best[i] = min(at_best.get(i, (1 << 40, 0)), (int(differ.min()), int(j[differ.argmin()])))
            else:
                for k in j.tolist():
                    yield (int(min(node[i], node[k])), int(max(node[i], node[k])))
    for i, (_, k) in at_best.items():
        yield (int(min(node[i], node[k])), int(max(node[i], node[k])))


ORACLE = r"""
WITH RECURSIVE t AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, hash(unnest(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda x: array_to_string(w[x:x + 3], ' '))
                                           WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)) AS g FROM t),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
f AS (SELECT g FROM s GROUP BY g HAVING count(*) > 1),
r AS (SELECT s.* FROM s SEMI JOIN f ON s.g = f.g),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM r a JOIN r b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 85 * (x.n + y.n - o)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
c AS (SELECT doc_id AS id, doc_id AS low FROM t UNION SELECT e.b, c.low FROM c JOIN e ON e.a = c.id AND c.low < e.b)
SELECT t.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(c.low) AS component_id
FROM t JOIN c ON c.id = t.doc_id LEFT JOIN n ON n.doc_id = t.doc_id GROUP BY t.doc_id
"""
