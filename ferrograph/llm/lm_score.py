"""Language-model scoring with a hashed maximum-entropy model.

p(word | history) = p(class | history) p(word | class). The class softmax has hashed features of the history: the word
before, the two words before as one, and the skipped-to words two and three back. The words of a class hang on a binary
tree that halves its mass, `levels` deep at most; each branch is a logistic step with the same features, hashed with the
branch into `fine`, over a bias that gives the discounted share. So a frequent word is a leaf of its own, and rarer ones
share a leaf by their discounted counts. Classes cross topic groups of words with bands of frequency; one more holds
the words beyond the table, which have this share only, and one the unknown word.

* Counts cover all training tokens: tasks pre-aggregate, one shuffle sums. The most frequent words, `table` of them at
  most, are broadcast; the rest is met by a join of the rare tokens with the whole vocabulary.
* Topic groups are a mixture of multinomials over the `frequent` most frequent words of all training documents. `starts` mixtures
  begin with groups of words that meet in the same documents, all of them; each is fitted in `passes` passes over all, with a
  document in the group that fits it best, and the one that fits all documents best is taken.
  A document's group follows from these words, and a word belongs to the group where most of its occurrences are.
* `fine` has a cell for every four training tokens, in powers of two and 2 ** FINE at most: every task sends its cells.
* The softmax and the branches are trained on all training tokens, once, in rounds over disjoint parts of the documents: tasks
  take AdaGrad steps from the shared weights, and the weights are averaged by tokens. Averages are summed by
  block in a shuffle, not on the driver. A cell of `fine` is averaged by what each task has learnt of it.
* The unknown word has half the mass of the words seen once (Good and Turing's estimate, for texts seen and unseen
  alike); these words keep the other half. In training the label of such tokens is drawn by the hash of the word.
  Probabilities over the vocabulary and the unknown word sum to one.

A null text counts as empty: it has the end token only. Repeated rows and ids are scored apart. With nothing to learn
from, every token is the unknown word with probability one. Each task steps alone from the shared weights, so
the weights depend somewhat on how the input is dealt to tasks; the counts and base_score don't. Words are known by 64-bit hashes. Other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrograph.llm import textkit as tk
from ferrograph.llm.shared import forget, most_frequent, saved

U = np.uint64
END = U(0x1F3D5B79A2C4E681)
#: Buckets of features: frequent words have their own, the rest share the others. Powers of two.
OWN, BUCKETS = 4096, 8192
BLOCKS = 16
#: Partial averages of a block.
FAN_IN = 64
FEATURES = 4
#: Most cells of the words' features, as a power of two, and the rate of their steps.
FINE, FINE_RATE = 21, 0.3
#: Cells, tokens, and bytes of texts that are worked on in one go, to stay in the cache.
STRETCH, CHUNK, PIECE = 1 << 14, 1 << 12, 1 << 16
#: Levels of a tree whose cells of one history lie side by side.
NEAR = 3


@dataclass
class Settings:
    groups: int = 6
    bands: tuple[int, ...] = (200, 5000)  # ranks at which a band of frequency ends
    table: int = 1 << 19
    frequent: int = 512
    starts: int = 12
    passes: int = 4
    rounds: int = 3
    rate: float = 0.8
    slab: int = 1 << 18
    levels: int = 6
    task_tokens: int = 1_000_000  # of a round, that make a task worth the weights it sends

    @property
    def classes(self) -> int:
        return self.groups * (len(self.bands) + 1) + 2


def tokens(b: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of a slab's rows, each row closed by the end token, and the rows' first tokens."""
    h, first = tk.word_hashes(b, off, ~tk.SPACE)
    rows = len(off) - 1
    out = np.empty(len(h) + rows, U)
    last = first[1:] + np.arange(rows)
    out[last] = END
    keep = np.ones(len(out), bool)
    keep[last] = False
    out[keep] = h
    return out, np.r_[first + np.arange(rows + 1)]


class Table:
    """Places of 64-bit keys: each key stands in the slot that its leading bits name, or in the next free one."""

    def __init__(self, keys: np.ndarray):
        order = np.argsort(keys)
        self.shift = U(64 - len(keys).bit_length() - 1)
        step = np.arange(len(keys))
        slot = np.maximum.accumulate((keys[order] >> self.shift).astype(np.int64) - step) + step
        size = max(2 << len(keys).bit_length(), int(slot[-1]) + 1 if len(keys) else 0) + 1  # the last one is free
        self.keys, self.place = np.zeros(size, U), np.full(size, -1, np.int32)
        self.keys[slot], self.place[slot] = keys[order], order

    def __call__(self, h: np.ndarray) -> np.ndarray:
        """Place of each key as given, or -1."""
        slot = (h >> self.shift).astype(np.int64)
        out = self.place[slot].astype(np.int64)
        left = np.flatnonzero((self.keys[slot] != h) & (out >= 0))
        while len(left):
            slot[left] += 1
            out[left] = self.place[slot[left]]
            left = left[(self.keys[slot[left]] != h[left]) & (out[left] >= 0)]
        return out


@dataclass
class Groups:
    """Frequent words, and for each the log probability in every group."""

    words: np.ndarray
    weight: np.ndarray

    def of(self, ids: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
        """The group of each row. ids: place of each token's word among `words` or -1; row: the token's row."""
        there = np.flatnonzero(ids >= 0)
        ids, row = ids[there], row[there]
        score = np.zeros((rows, self.weight.shape[1]))
        for g, weight in enumerate(np.ascontiguousarray(self.weight.T)):
            score[:, g] = np.bincount(row, np.take(weight, ids), rows)
        return score.argmax(axis=1)


def fit_groups(train: DataFrame, s: Settings) -> Groups:
    """Groups of the most frequent words of all training documents: of several mixtures, each fitted to all of these, the best."""
    none = Groups(np.empty(0, U), np.zeros((0, s.groups)))
    top = count_words(train, None, s).orderBy(F.desc("n"), "word").limit(s.frequent).select("word").toArrow()["word"].to_numpy()
    if not len(top):
        return none
    words = np.sort(top.view(U))
    rows = saved(train.select("text").mapInArrow(_rows(words), "ends binary, word binary, n binary"), "groups")
    met = _summed(rows, _meetings(len(words))).reshape(-1, len(words))
    weight = _starts(met[:-1], met[-1], s)
    for _ in range(s.passes):
        sums = _summed(rows, _group_sums(weight)).reshape(s.starts, s.groups, -1)
        n, fits = sums[:, :, :-1], sums[:, :, -1].sum(axis=1)
        n = n + 20 * n.sum(axis=1, keepdims=True) / max(n[0].sum(), 1e-9) + 1e-6
        weight = np.log(n / n.sum(axis=2, keepdims=True))
    forget(rows)
    return Groups(words, weight[fits.argmax()].T)


def _starts(x: np.ndarray, n: np.ndarray, s: Settings) -> np.ndarray:
    """Log probabilities by start, group and word, from groups of words that keep the same company. x: sums of products of every two words' counts; n: of counts."""
    # each word's company, as if it were a document of a hundred words; a word weighs by its count
    x = x * 100 / np.maximum(x.sum(axis=1, keepdims=True), 1e-9)
    share = n / n.sum()
    total = (share * len(n)) @ x + 0.1
    prior = total / total.sum() * 20
    rng = np.random.default_rng(5)
    out = []
    for _ in range(s.starts):
        n = x[rng.choice(len(x), s.groups, replace=len(x) < s.groups, p=share)] + prior
        for _ in range(20):
            logp = np.log(n / n.sum(axis=1, keepdims=True))
            group = (x @ logp.T).argmax(axis=1)
            n = np.array([(share * len(x) * (group == g)) @ x for g in range(s.groups)]) + prior
        out.append(logp)
    return np.array(out)


def _rows(words: np.ndarray):
    """Documents by slab: where each one's words end, the words' places, and the square roots of their counts: a text that repeats a word must not make a group of its own."""

    def run(batches):
        tk.lean()
        find, n = Table(words), len(words)
        for batch in batches:
            for _, _, b, off in tk.slabs(batch.column(0), 1 << 18):
                t, first = tokens(b, off)
                at, row = find(t), np.repeat(np.arange(len(off) - 1), np.diff(first))
                there = at >= 0
                count = np.bincount(row[there] * n + at[there], minlength=n * (len(off) - 1))
                cell = np.flatnonzero(count)
                ends = np.searchsorted(cell, np.arange(1, len(off)) * n)
                parts = ends.astype(np.int32), (cell % n).astype(np.min_scalar_type(n)), np.sqrt(count[cell]).astype(np.float32)
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in parts], ["ends", "word", "n"])

    return run


def _matrices(batches, n: int):
    """Documents by words, as `_rows` has them."""
    for batch in batches:
        for ends, word, count in zip(*(batch.column(j).to_pylist() for j in range(3))):
            ends = np.frombuffer(ends, np.int32)
            x = np.zeros((len(ends), n), np.float32)
            x[np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0)), np.frombuffer(word, np.min_scalar_type(n))] = np.frombuffer(count, np.float32)
            yield x


#: Rows of a matrix that are added up together.
TOGETHER = 8


def _summed(rows: DataFrame, run) -> np.ndarray:
    """The sum of the tasks' matrices, flat."""

    def parts(batches):
        tk.lean()
        sums = run(batches)
        blocks = [sums[lo : lo + TOGETHER].tobytes() for lo in range(0, len(sums), TOGETHER)]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(blocks)), pa.int32()), pa.array(blocks, pa.binary())], ["block", "part"])

    schema = "block int, part binary"
    found = rows.mapInArrow(parts, schema).groupBy("block").applyInArrow(_added, schema).collect()
    return np.concatenate([np.frombuffer(r["part"]) for r in sorted(found, key=lambda r: r["block"])])


def _added(table: pa.Table) -> pa.Table:
    total = 0.0
    for part in table["part"]:
        total = total + np.frombuffer(part.as_py())
    return pa.table({"block": table["block"].slice(0, 1), "part": pa.array([total.tobytes()], pa.binary())})


def _meetings(n: int):
    """A task's sums over documents of the products of every two words' counts, and in a last row of the counts."""

    def run(batches):
        sums = np.zeros((n + 1, n))
        for x in _matrices(batches, n):
            sums[:-1] += x.T @ x
            sums[-1] += x.sum(axis=0)
        return sums

    return run


def _group_sums(weight: np.ndarray):
    """A task's sums, by start and group, of the words' counts and of the log probability, each document in the group that fits it best."""
    starts, groups, n = weight.shape
    flat = weight.reshape(-1, n).T.astype(np.float32)

    def run(batches):
        sums = np.zeros((starts * groups, n + 1))
        for x in _matrices(batches, n):
            fits = (x @ flat).reshape(-1, starts, groups)
            own = (fits.argmax(axis=2)[:, :, None] == np.arange(groups)).astype(np.float32)
            sums[:, :-1] += own.reshape(len(x), -1).T @ x
            sums[:, -1] += (own * fits).sum(axis=0, dtype=float).ravel()
        return sums

    return run


def count_words(train: DataFrame, groups: Groups | None, s: Settings) -> DataFrame:
    """word (hash), n, group if there are groups: over all training tokens."""
    shared = train.sparkSession.sparkContext.broadcast(groups)

    def run(batches):
        tk.lean()
        g = shared.value
        find = Table(g.words) if g else None
        held, size = [], 0

        def flush():
            h = np.concatenate([t for t, _ in held])
            of = np.concatenate([k for _, k in held])
            for k in np.unique(of):
                key, c = np.unique(h[of == k], return_counts=True)
                for lo in range(0, len(key), 100_000):
                    part = key[lo : lo + 100_000].view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(np.full(len(part), k, np.int32)), pa.array(c[lo : lo + 100_000])], ["word", "grp", "n"])

        for batch in batches:
            for _, _, b, off in tk.slabs(batch.column(0), PIECE):
                t, first = tokens(b, off)
                row = np.repeat(np.arange(len(off) - 1), np.diff(first))
                held.append((t, g.of(find(t), row, len(off) - 1)[row].astype(np.int8) if g else np.zeros(len(t), np.int8)))
                size += len(t)
                if size > 3_000_000:
                    yield from flush()
                    held, size = [], 0
        if held:
            yield from flush()

    rows = train.select("text").mapInArrow(run, "word long, grp int, n long")
    if not groups:
        return rows.groupBy("word").agg(F.sum("n").alias("n"))
    per = [F.sum(F.when(F.col("grp") == g, F.col("n")).otherwise(0)).alias(f"g{g}") for g in range(s.groups)]
    wide = rows.groupBy("word").agg(F.sum("n").alias("n"), *per)
    first = F.array_position(F.array(*(f"g{g}" for g in range(s.groups))), F.greatest(*(f"g{g}" for g in range(s.groups))))
    return wide.select("word", "n", (first - 1).cast("int").alias("grp"))


@dataclass
class Tree:
    """Branches that halve the mass of each class's words, by level on the way to each leaf. Levels below a leaf are passed with certainty."""

    leaf: np.ndarray  # of each word
    home: np.ndarray  # hash of the branch that each NEAR levels begin with
    turn: np.ndarray  # place of a branch below that one
    right: np.ndarray  # 1 for the right side
    bias: np.ndarray  # log odds of the right side
    share: np.ndarray  # of each word, log of its share of its leaf

    def odds(self, fine: np.ndarray, leaf: np.ndarray, hist: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """By level the log odds of the right side; the first cells, by feature and NEAR levels, and the turns from these.

        Cells of NEAR levels differ in their last bits only, so a history meets them side by side.
        """
        side = 1 << NEAR
        first = hist.T[:, None] ^ np.take(self.home, leaf, axis=1)
        first *= U(0xD6E8FEB86659FD93)
        first >>= U(64 - (len(fine).bit_length() - 1))
        first = first.view(np.int64)
        turn = np.take(self.turn, leaf, axis=1).reshape(len(self.home), NEAR, len(leaf))
        near = np.take(fine.reshape(-1, side), first >> NEAR, axis=0)
        own = first & (side - 1)
        own += np.arange(0, near.size, side).reshape(first.shape)
        z = np.take(near, own[:, :, None] ^ turn).sum(axis=0, dtype=np.float32).reshape(self.bias.shape[0], len(leaf))
        z += np.take(self.bias, leaf, axis=1)
        return z, first, turn


def grow(cls: np.ndarray, weighed: np.ndarray, classes: int, levels: int) -> Tree:
    order = np.argsort(cls, kind="stable")
    spot = np.empty(len(cls), np.int64)
    spot[order] = np.arange(len(cls))
    mass = np.r_[0.0, np.cumsum(weighed[order])]
    start = np.searchsorted(cls[order], np.arange(classes + 1))
    lo, hi = start[:-1][np.diff(start) > 0], start[1:][np.diff(start) > 0]
    deep = -(-levels // NEAR) * NEAR
    leaf, whole = np.zeros(len(cls), np.int32), np.zeros(len(cls))  # of each spot, and its leaf's mass
    # of each run of spots: the branches on its way, the sides and the odds
    way, right, bias = np.full((len(lo), deep), -1), np.ones((len(lo), deep), np.float32), np.full((len(lo), deep), 1e4, np.float32)
    found, leaves, made, level = [], 0, 0, 0
    while len(lo):
        done = (hi - lo < 2) | (level == levels)
        for i, (a, z) in enumerate(zip(lo[done].tolist(), hi[done].tolist())):
            leaf[a:z], whole[a:z] = leaves + i, mass[z] - mass[a]
        leaves += int(done.sum())
        found.append((way[done], right[done], bias[done]))
        lo, hi, way, right, bias = (x[~done] for x in (lo, hi, way, right, bias))
        if not len(lo):
            break
        mid = np.clip(np.searchsorted(mass, (mass[lo] + mass[hi]) / 2), lo + 1, hi - 1)
        way[:, level] = made + np.arange(len(lo))
        bias[:, level] = np.log(mass[hi] - mass[mid]) - np.log(mass[mid] - mass[lo])
        made += len(lo)
        lo, hi, way, right, bias = np.r_[lo, mid], np.r_[mid, hi], np.r_[way, way], np.r_[right, right], np.r_[bias, bias]
        right[: len(lo) // 2, level] = 0
        level += 1
    way, right, bias = (np.concatenate(x) for x in zip(*found)) if found else (way, right, bias)
    home, turn = way[:, ::NEAR].copy(), np.zeros(way.shape, np.int64)
    for i in range(1, home.shape[1]):  # where there is no branch, cells that were met before
        home[:, i] = np.where(home[:, i] < 0, home[:, i - 1], home[:, i])
    for i in range(deep):
        if i % NEAR:
            turn[:, i] = np.where(way[:, i] < 0, turn[:, i - 1], 2 * turn[:, i - 1] + 1 + (right[:, i - 1] > 0))
    share = np.log(weighed) - np.log(whole[spot]) if len(cls) else np.empty(0)
    home = home.astype(U) * U(0x9E3779B97F4A7C15)
    return Tree(leaf[spot], *(np.ascontiguousarray(x.T) for x in (home, turn, right, bias)), share.astype(np.float32))


@dataclass
class Model:
    settings: Settings
    words: np.ndarray  # most frequent first
    n: np.ndarray
    cls: np.ndarray  # of each word
    mass: np.ndarray  # of each class
    unknown_share: float  # of rare tokens, in training
    total: int
    distinct: int
    weight: np.ndarray | None = None
    tree: Tree | None = None
    fine: np.ndarray | None = None  # weights of branches and histories

    @property
    def bits(self) -> int:
        return len(self.fine).bit_length() - 1

    @property
    def rare(self) -> int:
        return self.settings.classes - 2

    @property
    def unknown(self) -> int:
        return self.settings.classes - 1


def discounted(n):
    return np.where(n == 1, 0.5, n)


def lay_out(vocabulary: DataFrame, s: Settings) -> Model:
    """The tables of the model from the counts; weights are zero but for the bias."""
    all_ = vocabulary.agg(F.sum("n").alias("n"), F.count("*").alias("v"), F.count_if(F.col("n") == 1).alias("one")).first()
    top = most_frequent(vocabulary, "word", "n", s.table).toArrow()
    n, words, grp = top["n"].to_numpy(), top["word"].to_numpy().view(U), top["grp"].to_numpy()
    order = np.lexsort((words, -n))
    n, words, grp = n[order], words[order], grp[order].astype(np.int64)
    band = np.searchsorted(np.array(s.bands), np.arange(len(n)), "right")
    cls = grp * (len(s.bands) + 1) + band
    total, distinct, one = all_["n"] or 0, all_["v"], all_["one"]
    weighed = discounted(n)
    mass = np.bincount(cls, weighed, s.classes)
    rare_n, rare_one = total - int(n.sum()), one - int((n == 1).sum())
    mass[s.classes - 2] = rare_n - 0.5 * rare_one
    mass[s.classes - 1] = 0.5 * one + 1
    with np.errstate(divide="ignore"):
        bias = np.where(mass > 0, np.log(np.maximum(mass, 1e-300) / mass.sum()), -1e4)
    weight = np.zeros((BUCKETS * FEATURES + 1, s.classes), np.float32)
    weight[-1] = bias
    share = 0.5 * rare_one / rare_n if rare_n else 0.0
    bits = min(max(int(total).bit_length() - 2, 12), FINE)
    return Model(s, words, n, cls.astype(np.int8), mass, share, total, distinct, weight, grow(cls, weighed, s.classes, s.levels), np.zeros(1 << bits, np.float16))


class Reader:
    """Turns slabs into places of words, features and labels."""

    def __init__(self, m: Model):
        self.m = m
        self.find = Table(m.words)

    def __call__(self, b: np.ndarray, off: np.ndarray):
        t, first = tokens(b, off)
        place = self.find(t)
        # the bucket of each word as history; 0 stands for no word
        bucket = np.where((place >= 0) & (place < OWN - 1), place + 1, OWN + (t & U(BUCKETS - OWN - 1)).astype(np.int64))
        rows = len(off) - 1
        at = np.arange(len(t)) - np.repeat(first[:-1], np.diff(first))
        back = []
        for d in (1, 2, 3):
            x = np.zeros(len(t), np.int64)
            x[d:] = bucket[:-d] if d <= len(t) else 0
            x[at < d] = 0
            back.append(x)
        pair = np.where(back[1] > 0, (back[0] * 31_337 + back[1] * 7_919) & (BUCKETS - 1), back[0])
        feats = [back[0], pair + BUCKETS, back[1] + 2 * BUCKETS, back[2] + 3 * BUCKETS]
        return t, place, feats, first, rows


def histories(t: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Hashes of the four features of each token's history."""
    at = np.arange(len(t)) - np.repeat(first[:-1], np.diff(first))
    back = []
    for d in (1, 2, 3):
        x = np.zeros(len(t), U)
        x[d:] = t[:-d] if d <= len(t) else 0
        x[at < d] = 0
        back.append(tk.mix(x + U(d)))
    return np.stack([back[0], tk.mix(back[0] * U(3) + back[1]), back[1], back[2]]).T


def within(m: Model, place: np.ndarray, hist: np.ndarray) -> np.ndarray:
    """Natural log of the words' probabilities in their classes, after their histories."""
    tree, out = m.tree, m.tree.share[place].astype(float)
    every = tree.leaf[place].astype(np.int64)
    for lo in range(0, len(out), CHUNK):
        leaf = every[lo : lo + CHUNK]
        z, _, _ = tree.odds(m.fine, leaf, hist[lo : lo + CHUNK])
        z *= 1 - 2 * np.take(tree.right, leaf, axis=1)
        with np.errstate(over="ignore"):
            whole = np.multiply.reduce(1 + np.exp(z), axis=0, dtype=float)
        out[lo : lo + CHUNK] -= np.log(whole) if np.isfinite(whole).all() else np.logaddexp(0, z.astype(float)).sum(axis=0)
    return out


def logits(weight: np.ndarray, feats: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By token and class the sums of weights (less the highest, where exponentials may be too large or too small), their exponentials, and by token the sum of these."""
    z = np.empty((len(feats[0]), weight.shape[1]), weight.dtype)
    e, whole, one = np.empty_like(z), np.empty(len(z), z.dtype), np.ones(z.shape[1], z.dtype)
    for lo in range(0, len(z), CHUNK):
        own = slice(lo, lo + CHUNK)
        x = np.take(weight, feats[0][own], axis=0, out=z[own], mode="clip")
        for f in feats[1:]:
            x += np.take(weight, f[own], axis=0)
        x += weight[-1]
        safe = x.max() < 80
        if safe:
            np.matmul(np.exp(x, out=e[own]), one, out=whole[own])
        if not safe or whole[own].min() < 1e-30:
            x -= x.max(axis=1, keepdims=True)
            np.matmul(np.exp(x, out=e[own]), one, out=whole[own])
    return z, e, whole


def log_softmax(weight: np.ndarray, feats: list[np.ndarray]) -> np.ndarray:
    z, _, whole = logits(weight, feats)
    return z - np.log(whole)[:, None]


def class_steps(w: np.ndarray, square: np.ndarray, feats: list[np.ndarray], p: np.ndarray, rate: float) -> None:
    """An AdaGrad step of the softmax; p: the gradient of each token by class; square: the sums of squared gradients."""
    own = [f - i * BUCKETS for i, f in enumerate(feats)]
    grads = np.empty((len(feats), BUCKETS, p.shape[1]), np.float32)
    for c in range(p.shape[1]):
        column = p[:, c].astype(np.float64)
        for grad, f in zip(grads, own):
            grad[:, c] = np.bincount(f, column, BUCKETS)
    for i, (grad, f) in enumerate(zip(grads, own)):
        times = np.bincount(f, minlength=BUCKETS).astype(np.float32)
        grad /= np.sqrt(np.float32(len(p)) * times[:, None] / 16 + 1) ** np.float32(0.5)
        at = slice(i * BUCKETS, (i + 1) * BUCKETS)
        step = grad * grad
        square[at] += step
        np.sqrt(square[at], out=step)
        grad *= np.float32(rate)
        grad /= step
        w[at] -= grad


def labels(m: Model, t: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The class that each training token teaches."""
    known = place >= 0
    at = np.maximum(place, 0)
    if not len(m.words):
        return np.full(len(t), m.unknown)
    out = np.where(known, m.cls[at], m.rare).astype(np.int64)
    open_ = np.flatnonzero(~known | (m.n[at] == 1))
    draw = (tk.mix(t[open_]) >> U(40)).astype(np.float64) / (1 << 24)
    out[open_[draw < np.where(known[open_], 0.5, m.unknown_share)]] = m.unknown
    return out


def words_in(m: Model, fine: np.ndarray, learnt: np.ndarray, sums: np.ndarray, place: np.ndarray, y: np.ndarray, hist: np.ndarray) -> None:
    """An AdaGrad step of the branches that lead to a slab's words; learnt: the sums of squared gradients; sums: zeros, and zeros again at the end."""
    use = np.flatnonzero((place >= 0) & (y != m.unknown))
    if not len(use):
        return
    tree, hist, every = m.tree, np.take(hist.T, use, axis=1).T, m.tree.leaf[place[use]].astype(np.int64)
    for lo in range(0, len(use), CHUNK):
        leaf = every[lo : lo + CHUNK]
        z, first, turn = tree.odds(fine, leaf, hist[lo : lo + CHUNK])
        np.exp(np.negative(z, out=z), out=z)
        z += 1
        np.divide(1, z, out=z)
        z -= np.take(tree.right, leaf, axis=1)
        np.add.at(sums, (first[:, :, None] ^ turn).ravel(), np.tile(z.ravel(), FEATURES))
    for lo in range(0, len(fine), STRETCH):
        own = slice(lo, lo + STRETCH)
        grad = sums[own]
        step = grad * grad
        learnt[own] += step
        np.sqrt(np.add(learnt[own], 1, out=step), out=step)
        grad *= np.float32(FINE_RATE)
        np.divide(grad, step, out=step)
        fine[own] -= step
        grad[:] = 0


class Shared:
    """A model on its way to the tasks: its tables are sent once, its weights anew."""

    def __init__(self, spark: SparkSession, m: Model):
        self.context = spark.sparkContext
        self.tables = self.context.broadcast(replace(m, weight=None, fine=None))
        self.weights = None

    def send(self, m: Model):
        """A function that gives the model in a task; the weights sent before are dropped."""
        if self.weights is not None:
            self.weights.destroy()
        self.weights = self.context.broadcast((m.weight, m.fine))
        tables, weights = self.tables, self.weights
        return lambda: replace(tables.value, weight=weights.value[0], fine=weights.value[1])


def train_round(docs: DataFrame, m: Model, shared: Shared) -> None:
    """AdaGrad steps in every task over its documents, then the average of the weights."""
    given = shared.send(m)
    width = m.weight.shape[1]
    edges = np.linspace(0, len(m.weight), BLOCKS + 1).astype(int)

    def run(batches):
        tk.lean()
        m = given()
        read = Reader(m)
        w = m.weight.copy()
        square = np.full(w.shape, 1.0, np.float32)
        fine, learnt, sums = m.fine.astype(np.float32), *np.zeros((2, len(m.fine)), np.float32)
        seen = 0
        for batch in batches:
            for _, _, b, off in tk.slabs(batch.column(0), m.settings.slab):
                t, place, feats, first_of, _ = read(b, off)
                y = labels(m, t, place)
                words_in(m, fine, learnt, sums, place, y, histories(t, first_of))
                _, p, whole = logits(w, feats)
                p /= whole[:, None]
                p[np.arange(len(t)), y] -= 1
                seen += len(t)
                class_steps(w, square, feats, p, m.settings.rate)
        if seen:
            for i in range(BLOCKS):
                part = w[edges[i] : edges[i + 1]].astype(np.float32)
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([seen], pa.int64()), pa.array([part.tobytes()], pa.binary())], ["block", "seen", "part"])
            for i, both in enumerate(np.stack([fine, np.log1p(learnt)]).reshape(2, BLOCKS, -1).swapaxes(0, 1)):
                yield pa.RecordBatch.from_arrays([pa.array([BLOCKS + i], pa.int32()), pa.array([seen], pa.int64()), pa.array([both.astype(np.float16).tobytes()], pa.binary())], ["block", "seen", "part"])

    def add(batches):
        sums: dict[int, list] = {}
        for batch in batches:
            for i, seen, part in zip(*(batch.column(j).to_pylist() for j in range(3))):
                if i < BLOCKS:
                    x = np.frombuffer(part, np.float32).astype(np.float64) * seen
                else:
                    value, n = np.frombuffer(part, np.float16).astype(np.float64).reshape(2, -1)
                    x = np.stack([value * np.expm1(n), np.expm1(n)])
                if i in sums:
                    sums[i][0] += seen
                    sums[i][1] += x
                else:
                    sums[i] = [seen, x]
        for i, (seen, x) in sums.items():
            if i < BLOCKS:
                x = (x / seen).astype(np.float32)
            else:
                x = np.stack([x[0] / np.where(x[1] > 0, x[1], 1), np.log1p(x[1])]).astype(np.float16)
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([seen], pa.int64()), pa.array([x.tobytes()], pa.binary())], ["block", "seen", "part"])

    schema = "block int, seen long, part binary"
    # each task sends all weights, so small partitions are read by one task
    tasks = 1 + m.total // (m.settings.rounds * m.settings.task_tokens)
    docs = docs.select("text").coalesce(max(tasks, 8))
    # in two steps, so that no task adds up the parts of all others; the first joins eight at least, for its results are written again
    parts = docs.mapInArrow(run, schema).withColumn("salt", F.floor(F.spark_partition_id() / 8) % FAN_IN)
    parts = parts.repartition("block", "salt").select("block", "seen", "part").mapInArrow(add, schema)
    parts = parts.repartition(2 * BLOCKS, "block").mapInArrow(add, schema)
    weight, fine = m.weight.copy(), m.fine.copy()
    for r in parts.collect():
        i = r["block"]
        if i < BLOCKS:
            weight[edges[i] : edges[i + 1]] = np.frombuffer(r["part"], np.float32).reshape(-1, width)
        else:
            value, n = np.frombuffer(r["part"], np.float16).reshape(2, -1)
            block = fine.reshape(BLOCKS, -1)[i - BLOCKS]
            block[n > 0] = value[n > 0]
    m.weight, m.fine = weight, fine


def scored(docs: DataFrame, vocabulary: DataFrame, m: Model, shared: Shared | None = None) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score, score."""
    given = (shared or Shared(docs.sparkSession, m)).send(m)
    ln10 = float(np.log(10))
    schema = "key long, word long, doc_id long, n long, known long, base double, score double, unknown double, rare boolean"

    def run(batches):
        tk.lean()
        m = given()
        m.fine = m.fine.astype(np.float32)
        read = Reader(m)
        key = TaskContext.get().partitionId() << 36
        logn = np.log(m.n + 1.0)
        for batch in batches:
            for lo, hi, b, off in tk.slabs(batch.column(1), PIECE):
                t, place, feats, first, rows = read(b, off)
                row = np.repeat(np.arange(rows), np.diff(first))
                z, _, whole = logits(m.weight, feats)
                whole = np.log(whole)
                known = place >= 0
                at = place[known]
                total = np.bincount(row[known], z[known, m.cls[at]] - whole[known] + within(m, at, np.take(histories(t, first).T, np.flatnonzero(known), axis=1).T), rows) if len(m.words) else np.zeros(rows)
                base = np.bincount(row[known], logn[at], rows) if len(m.words) else np.zeros(rows)
                keys = key + np.arange(rows)
                none = np.zeros(rows)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys), pa.array(tk.mix(keys.astype(U)).view(np.int64)), batch.column(0).slice(lo, rows), pa.array(np.diff(first).astype(np.int64)),
                     pa.array(np.bincount(row[known], minlength=rows).astype(np.int64)), pa.array(base), pa.array(total), pa.array(none), pa.array(none > 0)],
                    NAMES,
                )
                rest = np.flatnonzero(~known)
                if len(rest):
                    zero = np.zeros(len(rest), np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(keys[row[rest]]), pa.array(t[rest].view(np.int64)), pa.nulls(len(rest), pa.int64()), pa.array(zero), pa.array(zero),
                         pa.array(zero.astype(float)), pa.array((z[rest, m.rare] - whole[rest]).astype(float)), pa.array((z[rest, m.unknown] - whole[rest]).astype(float)), pa.array(zero == 0)],
                        NAMES,
                    )
                key += rows

    rows = docs.select("doc_id", "text").mapInArrow(run, schema)
    n = F.when(F.col("rare"), F.col("c"))
    share = F.log(F.when(F.col("c") == 1, 0.5).otherwise(F.col("c"))) - float(np.log(max(m.mass[m.rare], 1e-300)))
    both = rows.join(vocabulary.select("word", F.col("n").alias("c")), "word", "left")
    per_row = both.groupBy("key").agg(
        F.max("doc_id").alias("doc_id"),
        F.sum("n").alias("n_tokens"),
        F.sum(F.col("known") + F.when(n.isNotNull(), 1).otherwise(0)).alias("n_known"),
        F.sum(F.col("base") + F.when(n.isNotNull(), F.log(n + 1.0)).otherwise(0.0)).alias("base"),
        F.sum(F.when(~F.col("rare"), F.col("score")).when(n.isNotNull(), F.col("score") + share).otherwise(F.col("unknown"))).alias("score"),
    )
    return per_row.select(
        "doc_id",
        "n_tokens",
        "n_known",
        F.lit(m.total).cast("long").alias("train_tokens"),
        ((F.col("base") - F.col("n_tokens") * float(np.log(m.total + m.distinct + 1.0))) / ln10).alias("base_score"),
        (F.col("score") / ln10).alias("score"),
    )


NAMES = ["key", "word", "doc_id", "n", "known", "base", "score", "unknown", "rare"]


def fit(train: DataFrame, s: Settings) -> tuple[Model, DataFrame]:
    m, vocabulary, _ = _fit(train, s)
    return m, vocabulary


def _fit(train: DataFrame, s: Settings) -> tuple[Model, DataFrame, Shared]:
    vocabulary = saved(count_words(train, fit_groups(train, s), s), "vocabulary")
    m = lay_out(vocabulary, s)
    shared = Shared(train.sparkSession, m)
    if m.distinct:
        for r in range(s.rounds):
            train_round(train.filter(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(s.rounds)) == r), m, shared)
    return m, vocabulary, shared


def score_texts(docs: DataFrame, held_out: Column, s: Settings | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; rows where `held_out` don't train.

    `held_out` is an expression over doc_id; null counts as training.
    """
    s = s or Settings()
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    m, vocabulary, shared = _fit(docs.filter(~F.coalesce(held_out, F.lit(False))), s)
    out = scored(docs, vocabulary, m, shared).withColumn("held_out", F.coalesce(held_out, F.lit(False)))
    return out.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
