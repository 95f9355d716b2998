"""Removal of repeated substrings with sharded suffix arrays.

Every byte that lies in a string of `length` bytes that also starts somewhere else (in any row, its own included) is
removed; matches don't cross rows. Shorter repeats are not removed but reported: `n_repeated` counts the bytes in strings
of `passage` bytes (some fifty short words) that also start somewhere else.

* Winnowing gives each start of a string of `passage` bytes an anchor: the least hash (leftmost if equal) of the k-byte
  grams inside it. Equal strings have equal anchors at equal distances, so a string can only be repeated if its anchor is.
  A string reaches `side` bytes beyond its anchor to the left or to the right at least; an anchor whose bytes on either
  side are found nowhere else by their hash is out too. All other starts are out without a comparison.
* Shards are made by anchor. Each start that is left brings its bytes, as a context: the starts of one anchor's place, and
  `length` bytes after the last (less at the row's end). A shard's starts are sorted into a suffix array by
  Larsson and Sadakane's refinement in numpy, tripling the depth and leaving out what is alone in its class. At the depth
  of `passage` its classes are the repeats of that length; beyond, Kasai's algorithm, in step over all contexts,
  gives the common prefixes of neighbours, and `length` bytes in common make a repeat.
* An anchor with very many places is salted over several shards. Those write sorted keys of their distinct strings, and
  the sorted runs are merged by binary search for strings that several shards hold.

Rows of equal text are one node; if there are two or more, all bytes are repeated. Only texts with a repeated anchor are
shuffled, once. A null text counts as empty; texts shorter than `passage` bytes stay whole. Repeated ids are rows like
others. Strings are known by their bytes in a shard and inside a text, by 128-bit keys across salted shards, and equal texts by
SHA-256; texts that share the 64-bit hash by which nodes go are told apart by another. A row may have 2 ** PLACE bytes; a longer
one is an error. Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrograph.llm import textkit as tk
from ferrograph.llm.shared import BROADCAST_ROWS, saved

U = np.uint64
GRAM = 32
#: Bits of a packed hash that hold the place; a row may have 2**PLACE bytes.
PLACE = 28
#: Bytes of a shard (three ranks fit 63 bits), and places of an anchor over which it is salted.
SHARD, SALTED = 1 << 20, 6000


def side(passage: int) -> int:
    """Bytes that a string of `passage` bytes has left or right of its anchor at least."""
    return (passage - min(GRAM, passage)) // 2


def anchors(b: np.ndarray, off: np.ndarray, length: int, passage: int | None = None) -> tuple[np.ndarray, ...]:
    """(row, hash, place, first start, last start, context, left, right) of the anchors of a slab's rows; places count from the
    row's start, the context is a hash of the bytes from the first start to `length` after the last (or the row's end), left
    and right are hashes of the bytes beside the anchor (0 where the row has too few)."""
    passage = passage or length
    k = min(GRAM, passage)
    w = passage - k + 1
    n = len(b)
    if n < passage:
        return tuple(np.empty(0, np.int64) for _ in range(8))
    h = tk.prefix_hash(b)
    with np.errstate(over="ignore"):
        inverse = tk.powers(n + 1, tk.BASE_INV)
        grams = tk.mix((h[k:] - h[:-k]) * inverse[: n - k + 1])
    low = U((1 << PLACE) - 1)
    packed = (grams & ~low) | np.arange(len(grams), dtype=U)
    m = len(grams) - w + 1  # windows
    blocks = -(-len(grams) // w)
    pad = np.full(blocks * w, U(2**64 - 1), U)
    pad[: len(grams)] = packed
    pad = pad.reshape(blocks, w)
    ahead = np.minimum.accumulate(pad, axis=1).ravel()
    back = np.minimum.accumulate(pad[:, ::-1], axis=1)[:, ::-1].ravel()
    owner = (np.minimum(back[:m], ahead[w - 1 : w - 1 + m]) & low).astype(np.int64)
    row = np.repeat(np.arange(len(off) - 1), np.diff(off))[:m]
    whole = np.arange(m) + passage <= off[row + 1]
    change = np.empty(m, bool)
    change[0] = True
    change[1:] = (owner[1:] != owner[:-1]) | (row[1:] != row[:-1]) | (whole[1:] != whole[:-1])
    first = np.flatnonzero(change)
    last = np.r_[first[1:], m] - 1
    keep = whole[first]
    first, last = first[keep], last[keep]
    r = row[first]
    place = owner[first]
    end = np.minimum(last + length, off[r + 1])
    reach = side(passage)
    with np.errstate(over="ignore"):
        context = tk.mix((h[end] - h[first]) * inverse[first]) + (end - first).astype(U)
        lo, hi = np.maximum(place - reach, 0), np.minimum(place + k + reach, n)
        left = tk.mix((h[place] - h[lo]) * inverse[lo] + U(1)) | U(1)
        right = tk.mix((h[hi] - h[place + k]) * inverse[np.minimum(place + k, n)] + U(2)) | U(1)
    left = np.where(place - reach >= off[r], left, U(0))
    right = np.where(place + k + reach <= off[r + 1], right, U(0))
    return r, grams[place].view(np.int64), place - off[r], first - off[r], last - off[r], context, left.view(np.int64), right.view(np.int64)


def fingerprints(rows: DataFrame, length: int, passage: int) -> DataFrame:
    """fp, node, place, lo, hi, size, left, right for each anchor of rows (node, text); of equal texts of a task only once.

    Contexts that a text holds twice are repeats by themselves: their starts come as ranges without fp, and one of them
    goes on as an anchor. So a text that repeats a word a thousand times has few anchors.
    """

    def run(batches):
        tk.lean()
        seen: set[int] = set()
        for batch in batches:
            nodes = batch.column(0).to_numpy()
            for lo, hi, b, off in tk.slabs(batch.column(1)):
                size = np.diff(off)
                if size.max(initial=0) >> PLACE:
                    raise ValueError(f"a text of {int(size.max())} bytes is too long: {1 << PLACE} at most")
                r, fp, place, first, last, context, left, right = anchors(b, off, length, passage)
                new = []
                for x in nodes[lo:hi].tolist():
                    new.append(x not in seen)
                    if len(seen) < 500_000:
                        seen.add(x)
                keep = np.array(new)[r]
                r, fp, place, first, last, context, left, right = (c[keep] for c in (r, fp, place, first, last, context, left, right))
                with np.errstate(over="ignore"):
                    kind = tk.mix(tk.mix(context + fp.view(U)) + tk.mix(r.astype(U) * U(1 << 32) + (last - first).astype(U) * U(1 << 16) + (place - first).astype(U)))
                _, one, which, times = np.unique(kind, return_index=True, return_inverse=True, return_counts=True)
                again = np.flatnonzero(times[which] > 1)
                stays = np.zeros(len(r), bool)
                stays[one] = True
                inner: dict[int, list] = {}
                for i in again.tolist():
                    at = int(one[which[i]])
                    if i == at:
                        continue
                    (x, a, z), (y, c, d) = ([int(v[j]) for v in (r, first, last)] for j in (i, at))
                    one_, other = (b[off[u] + v : off[u] + min(e + length, int(size[u]))].tobytes() for u, v, e in ((x, a, z), (y, c, d)))
                    if x != y or z - a != d - c or one_ != other:  # equal by their hash only
                        stays[i] = True
                    else:
                        inner.setdefault(x, []).extend([(a, z), (c, d)])
                marks = [(nodes[lo + x], a, z, int(size[x])) for x, parts in inner.items() for a, z in _joined(sorted(set(parts)))]
                own = [c[stays] for c in (fp, nodes[lo:hi][r], place, first, last, size[r])]
                ends = [c[stays] for c in (left, right)]
                cols = [list(c) for c in zip(*marks)] if marks else [[], [], [], []]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.concat_arrays([pa.array(own[0], pa.int64()), pa.nulls(len(marks), pa.int64())]),
                        pa.concat_arrays([pa.array(own[1], pa.int64()), pa.array(cols[0], pa.int64())]),
                        *(
                            pa.concat_arrays([pa.array(x.astype(np.int32)), pa.array(y, pa.int32())])
                            for x, y in zip(own[2:], ([0] * len(marks), *cols[1:]))
                        ),
                        *(pa.concat_arrays([pa.array(x, mask=x == 0), pa.nulls(len(marks), pa.int64())]) for x in ends),
                    ],
                    ["fp", "node", "place", "lo", "hi", "size", "left", "right"],
                )

    return rows.mapInArrow(run, "fp long, node long, place int, lo int, hi int, size int, left long, right long")


def contexts(rows: DataFrame, length: int) -> DataFrame:
    """From node, text and its shared anchors: fp, salt, node, lo, hi and the bytes from lo to hi + length."""

    def run(batches):
        tk.lean()
        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            size = 0
            for node, text, found in zip(*(batch.column(batch.schema.get_field_index(c)) for c in ("node", "text", "found"))):
                node, raw = node.as_py(), text.as_py().encode()
                for f, s, a, z in zip(*(found.values.field(c).to_pylist() for c in ("fp", "salts", "lo", "hi"))):
                    for col, v in zip(out, (f, node % s, node, a, z, raw[a : z + length])):
                        col.append(v)
                    size += z + length - a
                if size > 2_000_000:
                    yield _contexts(out)
                    out, size = [[], [], [], [], [], []], 0
            yield _contexts(out)

    return rows.mapInArrow(run, "fp long, salt long, node long, lo int, hi int, bytes binary")


def beside(found: DataFrame) -> DataFrame:
    """Those anchors whose bytes on one side at least are found beside an equal anchor at another place."""
    out = found.withColumn("_i", F.lit(False))
    for c in ("left", "right"):
        again = found.filter(F.col(c).isNotNull()).groupBy("fp", c).agg(
            F.min("node").alias("n0"), F.max("node").alias("n1"), F.min("place").alias("p0"), F.max("place").alias("p1")
        )
        again = again.filter("n0 <> n1 or p0 <> p1").select("fp", c, F.lit(True).alias("_again"))
        out = out.join(again, ["fp", c], "left").withColumn("_i", F.col("_i") | F.coalesce("_again", F.lit(False))).drop("_again")
    return out.filter("_i").drop("_i", "left", "right")


def _joined(parts: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges (last one included), sorted, those that meet as one."""
    out: list[tuple[int, int]] = []
    for a, z in sorted(parts):
        if out and a <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(z, out[-1][1]))
        else:
            out.append((a, z))
    return out


def _contexts(cols: list) -> pa.RecordBatch:
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["fp", "salt", "node", "lo", "hi", "bytes"])


def suffix_array(text: np.ndarray, end: np.ndarray, start: np.ndarray, length: int, early: np.ndarray | None = None, passage: int = 0):
    """`start` sorted by the `length` bytes from each; for every byte's place the eight bytes from it as a number, and
    whether it was alone in its class before the refinement ended. With `passage`, also the ranks of the places `early`, which have
    that many bytes, at this depth.

    end: for each place, where its context ends. Ranks are refined from depth h to 3 h; a rank whose bytes would cross
    the end of its context is never asked for. A place that is alone in its class keeps its rank.
    """
    n = len(text)
    word = np.zeros(n + 8, U)
    word[:n] = text
    for i in (1, 2, 4):  # of one byte, two, four and eight
        word[:-i] = (word[:-i] << U(8 * i)) | word[i:]
    word = word[:n].copy()
    depth = min(8, length)
    todo = np.flatnonzero(np.arange(n) + depth <= end)
    keys = (word >> U(8 * (8 - depth)))[todo]
    rank = np.zeros(n, np.int64)
    times = 3 if n < 1 << 21 else 2  # ranks that fit one key
    bits = U(21 if times == 3 else 32)
    base = np.zeros(len(todo), np.int64)
    alone = np.ones(n + 1, bool)
    middle = None
    while len(todo):
        order = np.argsort(keys)
        at, value, base = todo[order], keys[order], base[order]
        new = np.r_[True, value[1:] != value[:-1]]
        first = np.flatnonzero(new)
        size = np.diff(np.r_[first, len(at)])
        # a class is numbered by the place of its first member in the sorted order of the class it was part of
        group = np.flatnonzero(np.r_[True, base[1:] != base[:-1]])
        inside = first - np.repeat(group, np.diff(np.r_[np.searchsorted(first, group), len(first)]))
        rank[at] = base + np.repeat(inside, size)
        alone[at] = np.repeat(size == 1, size)
        if depth == passage:
            middle = rank[early]
        if depth >= length:
            break
        step = min(times * depth, passage if depth < passage else length)
        # what is alone is done; the rest is sorted by what follows
        more = np.zeros(n, bool)
        more[at[np.repeat(size > 1, size)]] = True
        todo = np.flatnonzero(more)
        todo = todo[todo + step <= end[todo]]
        base = rank[todo]
        keys = base.astype(U)
        for shift in range(1, times):
            keys = (keys << bits) | rank[todo + min(shift * depth, step - depth)].astype(U)
        depth = step
    # equal ranks stay in order, as Kasai's algorithm is quicker then
    out = (np.sort((rank[start].astype(U) << U(32)) | start.astype(U)) & U(0xFFFFFFFF)).astype(np.int64) if n < 1 << 32 else start[np.argsort(rank[start], kind="stable")]
    out = out, word, alone
    return out if early is None else (*out, rank[early] if middle is None else middle)


#: Inverted words with one to seven equal leading bytes begin here.
_LEADING = np.array([2**64 - 2 ** (8 * (8 - k)) for k in range(1, 8)], U)


def common_prefixes(sa: np.ndarray, word: np.ndarray, own: np.ndarray, length: int, skip: np.ndarray | None = None) -> np.ndarray:
    """For each place of `sa` the bytes in common with its predecessor, `length` at most (Kasai's algorithm).

    own: (first, last) start of each context. Starts in `skip` are known to have fewer than `length` and get 0. All contexts go on in step: the start after one whose common prefix has h
    bytes has h - 1 at least, if the predecessor's next start comes before it.
    """
    n = len(word)
    at = np.full(n + 1, -1)
    at[sa] = np.arange(len(sa))
    lcp = np.zeros(len(sa), np.int64)
    first, last = own
    h = np.zeros(len(first), np.int64)
    before = np.full(len(first), -1)  # predecessor of the start before
    for d in range(int((last - first).max(initial=-1)) + 1):
        live = np.flatnonzero(first + d <= last)
        if skip is not None:
            passed = skip[first[live] + d]
            before[live[passed]] = -1
            live = live[~passed]
        i = first[live] + d
        p = at[i]
        j = np.where(p > 0, sa[np.maximum(p - 1, 0)], -1)
        b = before[live]
        sure = (b >= 0) & (at[np.minimum(b + 1, n)] >= 0) & (at[np.minimum(b + 1, n)] < p)
        got = np.where(sure, np.maximum(h[live] - 1, 0), 0)
        go = np.flatnonzero((j >= 0) & (got < length))
        while len(go):
            x, y = word[np.minimum(i[go] + got[go], n - 1)], word[np.minimum(j[go] + got[go], n - 1)]
            differ = x ^ y
            same = differ == 0
            got[go[same]] += 8
            ends, left = go[~same], differ[~same]
            if len(ends):  # equal leading bytes
                got[ends] += np.searchsorted(_LEADING, ~left, "right")
            go = go[same]
            go = go[got[go] < length]
        got = np.where(j >= 0, np.minimum(got, length), 0)
        lcp[p] = got
        h[live], before[live] = got, j
    return lcp


def repeats(texts: list[bytes], starts: list[int], length: int, passage: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each context and its first `starts` places: which strings of `passage` bytes are repeated among all, and which of
    `length` bytes (of the places that have so many)."""
    size, starts = np.array([len(t) for t in texts]), np.array(starts)
    begin = np.r_[0, np.cumsum(size)]
    text = np.frombuffer(b"".join(texts), np.uint8)
    end = np.repeat(begin[1:], size)
    first, last = begin[:-1], begin[:-1] + starts - 1
    own = first, np.minimum(last, begin[1:] - length)
    place = np.arange(len(text))
    early = place[place <= np.repeat(last, size)]
    start = early[early + length <= end[early]]
    sa, word, alone, middle = suffix_array(text, end, start, length, early, passage)
    some = np.zeros(len(text) + 1, bool)
    some[early] = np.bincount(middle)[middle] > 1
    flag = np.zeros(len(text) + 1, bool)
    if len(sa):
        joined = common_prefixes(sa, word, own, length, alone) >= length
        joined[:1] = False
        twice = joined.copy()
        twice[:-1] |= joined[1:]
        flag[sa[twice]] = True
    return [(some[a : z + 1], flag[a : y + 1]) for a, z, y in zip(first.tolist(), last.tolist(), np.maximum(own[1], first - 1).tolist())]


def _flags(fps: list, salts: list, texts: list[bytes], starts: list[int], length: int, passage: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """The repeated starts of a shard's contexts, for both lengths.

    Contexts of an anchor that are equal in full are repeats as they stand; one of them goes on, and only if its anchor
    has others that differ.
    """
    first: dict[tuple, int] = {}
    same = [first.setdefault(x, i) for i, x in enumerate(zip(fps, salts, texts, starts))]
    twin = {x for i, x in enumerate(same) if x != i}
    kinds: dict[tuple, int] = {}
    for f, s, *_ in first:
        kinds[f, s] = kinds.get((f, s), 0) + 1
    open_ = [i for (f, s, *_), i in first.items() if kinds[f, s] > 1]
    found = dict(zip(open_, repeats([texts[i] for i in open_], [starts[i] for i in open_], length, passage))) if open_ else {}
    out = []
    for i in same:
        sizes = starts[i], max(0, min(starts[i], len(texts[i]) - length + 1))
        out.append(tuple(np.ones(n, bool) for n in sizes) if i in twin else found[i] if i in found else tuple(np.zeros(n, bool) for n in sizes))
    return out


MARK = "node long, lo int, hi int, len int, fp long, salt long, k1 long, k2 long"


def search(ctx: DataFrame, length: int, passage: int) -> DataFrame:
    """Repeated starts (node, lo, hi) of strings of `len` bytes; for salted anchors, keys (k1, k2) of the strings that are alone in
    their shard, and a key without a place (node null) of each that is repeated there."""

    def work(part):
        fps, salts, nodes, los, his, texts, salted = part
        out, known = [], set()
        starts = [z - a + 1 for a, z in zip(los, his)]
        every = _flags(fps, salts, texts, starts, length, passage)
        for flags, wide in zip(zip(*every), (passage, length)):
            for i, a, z in runs_of(flags):
                out.append((nodes[i], los[i] + a, los[i] + z - 1, wide, 0, 0, 0, 0))
        for i, both in enumerate(every):
            if salted[i]:
                h = tk.prefix_hash(np.frombuffer(texts[i], np.uint8))
                for flag, wide in zip(both, (passage, length)):
                    n = len(flag)
                    with np.errstate(over="ignore"):
                        inverse = tk.powers(n, tk.BASE_INV)
                        whole = tk.mix((h[wide : wide + n] - h[:n]) * inverse)
                        half = tk.mix((h[wide // 2 : wide // 2 + n] - h[:n]) * inverse + whole)
                    for d, (k1, k2) in enumerate(zip(whole.view(np.int64).tolist(), half.view(np.int64).tolist())):
                        if not flag[d]:
                            out.append((nodes[i], los[i] + d, los[i] + d, wide, fps[i], salts[i] + 1, k1, k2))
                        elif (fps[i], salts[i], wide, k1, k2) not in known:
                            known.add((fps[i], salts[i], wide, k1, k2))
                            out.append((None, 0, 0, wide, fps[i], salts[i] + 1, k1, k2))
        return out

    def run(batches):
        tk.lean()
        part: list[list] = [[] for _ in range(7)]
        size, last = 0, None
        for batch in batches:
            cols = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("fp", "salt", "node", "lo", "hi", "bytes", "salts")]
            out = []
            for fp, salt, node, lo, hi, text, salts in zip(*cols):
                if (fp, salt) != last and size > SHARD // 2:
                    out += work(part)
                    part, size = [[] for _ in range(7)], 0
                last = (fp, salt)
                for col, v in zip(part, (fp, salt, node, lo, hi, text, salts > 1)):
                    col.append(v)
                size += len(text)
            if out:
                yield _marks(out)
        if part[0]:
            yield _marks(work(part))

    return ctx.mapInArrow(run, MARK)


def _marks(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 8, types)], [c.split()[0] for c in MARK.split(", ")])


def runs(flag: np.ndarray) -> list[tuple[int, int]]:
    """(first, last + 1) of the runs of true values."""
    edge = np.flatnonzero(np.diff(np.r_[False, flag, False].astype(np.int8)))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist()))


def runs_of(flags: list[np.ndarray]) -> list[tuple[int, int, int]]:
    """(which, first, last + 1) of the runs of true values in each of several arrays; none goes from one array into the next."""
    size = np.array([len(f) for f in flags], np.int64) + 1  # a false value stands after each
    begin = np.cumsum(size) - size
    flag = np.ones(int(size.sum()), bool)
    flag[begin + size - 1] = False
    if len(flags):
        flag[flag] = np.concatenate(flags)
    edge = np.flatnonzero(np.diff(np.r_[False, flag].astype(np.int8)))
    which = np.searchsorted(begin, edge[::2], "right") - 1
    return list(zip(which.tolist(), (edge[::2] - begin[which]).tolist(), (edge[1::2] - begin[which]).tolist()))


def across(keys: DataFrame) -> DataFrame:
    """(node, lo, hi, len) of the strings that more than one salted shard holds."""
    per = keys.groupBy("fp", "len", "k1", "k2").agg(F.min("salt").alias("s0"), F.max("salt").alias("s1"))
    both = per.filter("s0 <> s1").select("fp", "len", "k1", "k2")
    return keys.filter("node is not null").join(both, ["fp", "len", "k1", "k2"]).select("node", "lo", "hi", "len")


def cut(rows: DataFrame, length: int) -> DataFrame:
    """From node, text and its repeated starts of both lengths: node, n_removed, n_spans, kept_sha256, spans, n_repeated."""

    def run(batches):
        for batch in batches:
            out = []
            for node, text, marks in zip(*(batch.column(batch.schema.get_field_index(c)) for c in ("node", "text", "marks"))):
                raw = text.as_py().encode()
                lo, hi, wide = (marks.values.field(c).to_numpy() for c in ("lo", "hi", "len"))
                gone, again = (_covered(len(raw), lo[x], hi[x] + wide[x]) for x in (wide == length, wide > 0))
                spans = runs(gone)
                kept, at = hashlib.sha256(), 0
                for a, z in spans:
                    kept.update(raw[at:a])
                    at = z
                kept.update(raw[at:])
                out.append((node.as_py(), int(gone.sum()), len(spans), kept.hexdigest(), [{"lo": a, "hi": z} for a, z in spans], int(again.sum())))
            cols = list(zip(*out)) if out else [[]] * 6
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())])), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types)], ["node", "n_removed", "n_spans", "kept_sha256", "spans", "n_repeated"])

    schema = "node long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<lo:long,hi:long>>, n_repeated long"
    return rows.mapInArrow(run, schema)


def _covered(n: int, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, lo, 1)
    np.add.at(edge, hi, -1)
    return np.cumsum(edge[:-1]) > 0


def deduplicated(docs: DataFrame, length: int = 400, passage: int = 256) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_repeated, spans (the bytes removed, end exclusive) of each row of `docs`."""
    passage = min(passage, length)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    rows = docs.select("doc_id", F.xxhash64("text").alias("node"), F.octet_length("text").cast("long").alias("n_bytes"), "text")
    keys = saved(rows.select("doc_id", "node", "n_bytes", F.sha2("text", 256).alias("whole")), "nodes")
    two = keys.groupBy("node").agg(F.min("whole").alias("w0"), F.max("whole").alias("w1"), F.count("*").alias("copies"))
    shared = [r["node"] for r in two.filter("w0 <> w1").select("node").collect()]  # texts of one hash: a pair in 10**9 texts or so
    if shared:
        apart = lambda other: F.when(F.col("node").isin(*shared), other).otherwise(F.col("node"))
        rows = rows.withColumn("node", apart(F.xxhash64(F.sha2("text", 256))))
        keys = saved(keys.withColumn("node", apart(F.xxhash64("whole"))), "nodes")
        two = keys.groupBy("node").agg(F.count("*").alias("copies"))
    long = rows.filter(F.col("n_bytes") >= passage).select("node", "text")

    every = saved(fingerprints(long, length, passage), "anchors")
    found = every.filter("fp is not null").drop("size")
    inner = every.filter("fp is null").select("node", "lo", "hi", "size").distinct()
    # starts of strings of the full length lie `length` before the end at the latest
    tops = F.array(F.struct("hi", F.lit(passage).alias("len")), F.struct(F.least("hi", F.col("size") - length).alias("hi"), F.lit(length).alias("len")))
    inner = inner.select("node", "lo", F.explode(F.array_distinct(tops)).alias("x")).select("node", "lo", "x.hi", "x.len").filter("lo <= hi")
    count = found.groupBy("fp").agg(
        F.min("node").alias("n0"), F.max("node").alias("n1"), F.min("place").alias("p0"), F.max("place").alias("p1"), F.count("*").alias("n")
    )
    count = count.filter("n0 <> n1 or p0 <> p1").select("fp", (F.floor(F.col("n") / SALTED) + 1).cast("long").alias("salts"))
    left = beside(saved(found.join(count, "fp"), "twice"))
    by_node = left.groupBy("node").agg(F.collect_set(F.struct("fp", "salts", "place", "lo", "hi")).alias("found"))
    by_node = saved(by_node, "shared")
    some = saved(by_node.select("node").union(inner.select("node")).distinct(), "some")
    some = F.broadcast(some) if some.count() <= BROADCAST_ROWS else some
    texts = saved(long.join(some, "node", "left_semi").groupBy("node").agg(F.first("text").alias("text")), "texts")

    ctx = contexts(texts.join(by_node, "node").select("node", "text", "found"), length)
    ctx = ctx.join(saved(count.filter("salts > 1"), "salts"), "fp", "left").withColumn("salts", F.coalesce("salts", F.lit(1)))
    ctx = ctx.repartition("fp", "salt").sortWithinPartitions("fp", "salt")
    marks = saved(search(ctx, length, passage), "marks")
    starts = marks.filter("salt = 0").select("node", "lo", "hi", "len").unionAll(across(marks.filter("salt > 0"))).unionAll(inner)
    starts = starts.groupBy("node").agg(F.collect_list(F.struct("lo", "hi", "len")).alias("marks"))
    done = cut(texts.join(starts, "node").select("node", "text", "marks"), length)

    copies = two.filter("copies > 1").select("node", "copies")
    out = keys.join(copies, "node", "left").join(done, "node", "left")
    all_gone = (F.col("copies") > 1) & (F.col("n_bytes") >= length)
    return out.select(
        "doc_id",
        "n_bytes",
        F.when(all_gone, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(all_gone, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(all_gone, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha256", "whole")).alias("kept_sha256"),
        F.when((F.col("copies") > 1) & (F.col("n_bytes") >= passage), F.col("n_bytes")).otherwise(F.coalesce("n_repeated", F.lit(0))).alias("n_repeated"),
        F.when(all_gone, F.array(F.struct(F.lit(0).cast("long").alias("lo"), F.col("n_bytes").alias("hi"))))
        .otherwise(F.coalesce("spans", F.array().cast("array<struct<lo:long,hi:long>>")))
        .alias("spans"),
    )
