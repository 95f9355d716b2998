"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

Encoding keeps an agenda of adjacent symbol pairs ordered by the score of the piece they make, then by place, and merges
the best until none is in the vocabulary; what is then in no piece becomes bytes. No piece holds a word mark after another
character, so a text falls into chunks (word marks and what follows) that merge apart from each other. The distinct chunks
of a slab of texts merge in step: each takes the best pair of its own agenda, one merge a round, in numpy arrays that hold
every pair's score and place. Chunks of over LONG symbols have a heap each.

The ids are the agenda's alone. In each Arrow batch the sentencepiece library encodes one chunk in CHECKED and one text
(whole, the first of at most CHECK_CHARS characters), and a difference raises an error: no result is replaced by the library's.

A null text counts as empty; an empty text has no ids. Rows are independent; repeated ids are rows like others, and other
columns are ignored. Nothing is kept from one batch to the next, so memory is bounded by a slab or by the longest text.
"""

from __future__ import annotations

import hashlib
import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrograph.llm import textkit as tk

MARK = "▁"
#: Symbols up to which a chunk merges in step with others; one chunk in CHECKED is held against the library.
LONG, CHECKED, CHECK_CHARS = 64, 16, 4096
#: Characters of the texts that are worked on together: arrays take some 80 bytes for each.
SLAB = 1 << 17
U = np.uint64
_NEVER = np.int64(2**63 - 1)
_SPREAD = U(0x9E3779B97F4A7C15)


class Differs(RuntimeError):
    """The agenda and the library do not agree."""


class Pieces:
    """A vocabulary read from the bytes of a model file."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.sp = sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = self.n = sp.vocab_size()
        normal = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.id = {sp.id_to_piece(i): i for i in normal}
        if any(MARK in p.lstrip(MARK) for p in self.id):
            raise ValueError("a piece holds a word mark after another character")
        scores = sorted({-sp.get_score(i) for i in normal})
        place = {s: r for r, s in enumerate(scores)}
        self.rank = {sp.id_to_piece(i): place[-sp.get_score(i)] for i in normal}
        self.byte = {int(sp.id_to_piece(i)[1:-1], 16): i for i in range(n) if sp.is_byte(i)}
        self.unk = sp.unk_id()
        # white space that no merge takes in ends a chunk too
        self.solo = [ord(c) for c in "\n\t\r" if not any(c in p and len(p) > 1 for p in self.id)]
        # symbols: ids of pieces; characters that are no piece lie behind them
        self.symbol = np.arange(0x110000, dtype=np.int32) + np.int32(n)
        for p, i in self.id.items():
            if len(p) == 1:
                self.symbol[ord(p)] = i
        self._pairs()
        texts = [b""] * n
        for p, i in self.id.items():
            texts[i] = p.replace(MARK, " ").encode()
        for b, i in self.byte.items():
            texts[i] = bytes([b])
        texts[self.unk] = " ⁇ ".encode()
        self.size = np.array([len(t) for t in texts])
        self.begin = np.r_[0, np.cumsum(self.size)[:-1]]
        self.text = np.frombuffer(b"".join(texts), np.uint8)
        self.marked = np.zeros(n, bool)
        self.marked[[i for p, i in self.id.items() if p[0] == MARK]] = True
        # a comma and the number, from the right
        self.digits = np.frombuffer("".join(f",{i}".rjust(8) for i in range(n)).encode(), np.uint8).reshape(n, 8)

    def _pairs(self) -> None:
        """A hash table of pairs of symbols: key, rank and the piece they make."""
        found = {}
        for p, i in self.id.items():
            for cut in range(1, len(p)):
                a, b = p[:cut], p[cut:]
                if (len(a) == 1 or a in self.id) and (len(b) == 1 or b in self.id):
                    x = int(self.symbol[ord(a)]) if len(a) == 1 else self.id[a]
                    y = int(self.symbol[ord(b)]) if len(b) == 1 else self.id[b]
                    found[x << 21 | y] = (self.rank[p], i)
        keys = np.array(list(found), np.int64).reshape(-1)
        bits = self.bits = max(8, int(4 * len(keys)).bit_length())
        self.key = np.full(1 << bits, -1, np.int64)
        self.made = np.zeros((1 << bits, 2), np.int64)
        values = np.array(list(found.values()), np.int64).reshape(-1, 2)
        left = np.arange(len(keys))
        at = (keys.view(U) * _SPREAD >> U(64 - bits)).astype(np.int64)
        self.probes = 0
        while len(left):  # linear probing; of those that want one cell the first gets it
            self.probes += 1
            _, one = np.unique(at[left], return_index=True)
            one = one[self.key[at[left[one]]] < 0]
            put = left[one]
            self.key[at[put]], self.made[at[put]] = keys[put], values[put]
            rest = np.ones(len(left), bool)
            rest[one] = False
            left = left[rest]
            at[left] = (at[left] + 1) & ((1 << bits) - 1)

    def lookup(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For pairs of symbols, the rank of the piece they make (-1 if none), and the piece."""
        want = a.astype(np.int64) << 21 | b
        at = (want.view(U) * _SPREAD >> U(64 - self.bits)).astype(np.int64)
        have = self.key[at]
        miss = np.flatnonzero((have != want) & (have >= 0))
        for _ in range(self.probes - 1):
            if not len(miss):
                break
            at[miss] = (at[miss] + 1) & ((1 << self.bits) - 1)
            have[miss] = self.key[at[miss]]
            miss = miss[(have[miss] != want[miss]) & (have[miss] >= 0)]
        got = self.made[at]
        return np.where(have == want, got[:, 0], -1), got[:, 1]

    def merged(self, sym: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Merge chunks in step: `sym` holds their symbols, which are replaced by pieces; the mask of those that remain.

        first: for each chunk the place of its first symbol, and the end.
        """
        n = len(sym)
        last = first[1:] - 1
        ends = np.zeros(n, bool)
        ends[last] = True
        after = np.arange(1, n + 1)
        after[ends] = n
        before = np.arange(-1, n - 1)
        before[first[:-1]] = -1
        sym = np.append(sym.astype(np.int64), 0)
        rank, makes = self.lookup(sym[:-1], np.r_[sym[1:-1], 0])
        rank[ends] = -1
        place = np.arange(n)
        agenda = np.where(rank >= 0, rank << 32 | place, _NEVER)
        left = np.ones(n, bool)
        # the chunks that still have pairs, as (place in the agenda, first symbol there): the agenda shrinks with them
        part, where, starts = agenda, None, first[:-1]
        sizes = np.diff(first)
        while True:
            best = np.minimum.reduceat(part, starts) if len(starts) else np.empty(0, np.int64)
            open_ = best != _NEVER
            n_open = int(open_.sum())
            if not n_open:
                break
            i = best[open_] & 0xFFFFFFFF
            if n_open * 4 < len(starts) * 3:  # leave out the chunks that are done
                take = np.repeat(open_, sizes)
                where = np.flatnonzero(take) if where is None else where[take]
                sizes = sizes[open_]
                starts = np.r_[0, np.cumsum(sizes)[:-1]]
            j = after[i]
            k = after[j]
            sym[i] = makes[i]
            left[j] = False
            agenda[j] = _NEVER
            after[i] = k
            inside = k < n
            before[k[inside]] = i[inside]
            r, m = self.lookup(sym[i], sym[k])
            agenda[i] = np.where(inside & (r >= 0), r << 32 | i, _NEVER)
            makes[i] = m
            h = before[i]
            has = np.flatnonzero(h >= 0)
            i, h = i[has], h[has]
            r, m = self.lookup(sym[h], sym[i])
            agenda[h] = np.where(r >= 0, r << 32 | h, _NEVER)
            makes[h] = m
            part = agenda if where is None else agenda[where]
        self._out = sym[:-1]
        return left

    def heaped(self, sym: list[int]) -> list[int]:
        """The same for one long chunk, with a heap as its agenda."""
        n = len(sym)
        s = np.array(sym, np.int64)
        rank, makes = self.lookup(s[:-1], s[1:])
        agenda = [(r, i, a, b, m) for i, (r, m, a, b) in enumerate(zip(rank.tolist(), makes.tolist(), sym, sym[1:])) if r >= 0]
        heapq.heapify(agenda)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        known: dict[tuple[int, int], tuple[int, int]] = {}

        def push(i: int, j: int) -> None:
            pair = sym[i], sym[j]
            if pair not in known:
                r, m = self.lookup(np.array([pair[0]]), np.array([pair[1]]))
                known[pair] = int(r[0]), int(m[0])
            r, m = known[pair]
            if r >= 0:
                heapq.heappush(agenda, (r, i, *pair, m))

        while agenda:
            _, i, a, b, made = heapq.heappop(agenda)
            j = after[i]
            if sym[i] != a or j >= n or sym[j] != b:
                continue
            sym[i], sym[j] = made, -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
                push(i, after[j])
            if before[i] >= 0:
                push(before[i], i)
        return [x for x in sym if x >= 0]

    def spelled(self, sym: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of symbols, and of how many each consists: characters that are no piece are spelled in bytes."""
        odd = np.flatnonzero(sym >= self.n)
        times = np.ones(len(sym), np.int64)
        if not len(odd):
            return sym, times
        kinds, which = np.unique(sym[odd], return_inverse=True)
        spelt = [[self.byte[b] for b in chr(c - self.n).encode()] if self.byte else [self.unk] for c in kinds.tolist()]
        times[odd] = np.array([len(x) for x in spelt])[which]
        out = np.repeat(sym, times)
        at = np.repeat(np.r_[0, np.cumsum(times)[:-1]][odd], times[odd])
        out[at + _within(times[odd])] = np.concatenate([np.array(spelt[w]) for w in which.tolist()])
        return out, times

    def chunk_ids(self, sym: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all chunks one after another, and the number of each chunk's ids."""
        n = np.diff(first)
        long = np.flatnonzero(n > LONG)
        if not len(long):
            left = self.merged(sym, first)
            owner = np.repeat(np.arange(len(n)), n)[left]
            out = self._out[left]
        else:
            short = np.flatnonzero(n <= LONG)
            parts, owners = [], []
            if len(short):
                at = np.repeat(first[:-1][short], n[short]) + _within(n[short])
                left = self.merged(sym[at], np.r_[0, np.cumsum(n[short])])
                parts.append(self._out[left])
                owners.append(np.repeat(short, n[short])[left])
            for x in long.tolist():
                got = self.heaped(sym[first[x] : first[x + 1]].tolist())
                parts.append(np.array(got, np.int64))
                owners.append(np.full(len(got), x))
            owner, out = np.concatenate(owners), np.concatenate(parts)
            order = np.argsort(owner, kind="stable")
            owner, out = owner[order], out[order]
        ids, times = self.spelled(out)
        return ids, np.bincount(owner, times, len(n)).astype(np.int64)

    def encode(self, texts: list[str], turn: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and where each text's begin (and the end).

        turn: the number of the batch, by which its part of the chunks is chosen that the library checks; None: no check.
        """
        size = np.array([len(t) for t in texts], np.int64)
        full = np.flatnonzero(size)
        x = np.frombuffer("".join(MARK + t for t in texts if t).encode("utf-32-le", "surrogatepass"), np.uint32)
        if not len(x):
            return np.empty(0, np.int64), np.zeros(len(texts) + 1, np.int64)
        mark = ord(MARK)
        x = np.where(x == 0x20, np.uint32(mark), x)
        begins = np.r_[0, np.cumsum(size[full] + 1)]
        marks = x == mark
        head = marks.copy()
        head[1:] &= ~marks[:-1]
        for c in self.solo:
            alone = np.flatnonzero(x == c)
            head[alone] = True
            head[alone[alone + 1 < len(x)] + 1] = True
        head[begins[:-1]] = True
        first = np.flatnonzero(head)
        n = np.diff(np.r_[first, len(x)])
        with np.errstate(over="ignore"):
            h = np.r_[U(0), np.cumsum(tk.mix(x.astype(U) + U(1)) * tk.powers(len(x), tk.BASE))]
            key = tk.mix((h[first + n] - h[first]) * tk.powers(len(x), tk.BASE_INV)[first] + n.astype(U))
        _, one, which = np.unique(key, return_index=True, return_inverse=True)
        # a hash only proposes equal chunks: each is held against the one that stands for it
        place = _within(n)
        if (n != n[one][which]).any() or (x != x[np.repeat(first[one][which], n) + place]).any():
            one = which = np.arange(len(first))
        held = n[one]
        at = np.repeat(first[one], held) + _within(held)
        ids, count = self.chunk_ids(self.symbol[x[at]], np.r_[0, np.cumsum(held)])
        ends = np.cumsum(count)
        if turn is not None:
            some = np.arange(turn % CHECKED, len(one), CHECKED)
            chunks = [x[first[one[c]] : first[one[c]] + held[c]].astype("<u4").tobytes().decode("utf-32-le") for c in some.tolist()]
            for c, chunk, want in zip(some.tolist(), chunks, self.library(chunks)):
                if want is not None and ids[ends[c] - count[c] : ends[c]].tolist() != want:
                    raise Differs(f"the library encodes {chunk!r} otherwise")
        each = count[which]
        out = ids[np.repeat((ends - count)[which], each) + _within(each)]
        per = np.zeros(len(texts), np.int64)
        per[full] = np.add.reduceat(each, np.searchsorted(first, begins[:-1]))
        starts = np.r_[0, np.cumsum(per)]
        if turn is not None:
            short = next((i for i in full.tolist() if size[i] <= CHECK_CHARS), None)
            if short is not None and out[starts[short] : starts[short + 1]].tolist() != self.sp.encode(texts[short]):
                raise Differs(f"the library encodes a text otherwise that begins with {texts[short][:80]!r}")
        return out, starts

    def library(self, chunks: list[str]) -> list[list[int] | None]:
        """What the library makes of chunks: those that don't begin with a mark are encoded behind a line feed, whose ids
        are cut off; a lone mark can't be asked for."""
        plain = [c[1:].replace(MARK, " ") if c[0] == MARK else "\n" + c for c in chunks]
        skip = len(self.sp.encode("\n"))
        got = self.sp.encode(plain, num_threads=1) if plain else []
        return [g if c[0] == MARK and len(c) > 1 else g[skip:] if c[0] != MARK else None for g, c in zip(got, chunks)]

    def written(self, ids: np.ndarray, starts: np.ndarray) -> list[bytes]:
        """Each text's ids in decimal, joined by commas."""
        rows = self.digits[ids]
        used = rows != 0x20
        ends = np.r_[0, np.cumsum(used.sum(axis=1))][starts]
        raw = rows[used].tobytes()
        return [raw[a + 1 : z] for a, z in zip(ends[:-1].tolist(), ends[1:].tolist())]

    def decode(self, ids: np.ndarray, starts: np.ndarray) -> list[bytes]:
        """The text of each row's ids in UTF-8; bytes that form no character become U+FFFD each."""
        size = self.size[ids]
        raw = self.text[np.repeat(self.begin[ids], size) + _within(size)].tobytes()
        ends = np.r_[0, np.cumsum(size)][starts]
        out = []
        for i, (a, z) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist())):
            # the mark before the first word goes
            lead = starts[i]
            while lead < starts[i + 1] and not self.size[ids[lead]]:
                lead += 1
            t = raw[a + int(lead < starts[i + 1] and self.marked[ids[lead]]) : z]
            try:
                t.decode()
            except UnicodeDecodeError:
                t = _repaired(t)
            out.append(t)
        return out


def _within(sizes: np.ndarray) -> np.ndarray:
    """0 .. size - 1 for each size, one after another."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - sizes, sizes)


def _repaired(raw: bytes) -> bytes:
    out, i = [], 0
    while i < len(raw):
        for n in (1, 2, 3, 4):
            try:
                out.append(raw[i : i + n].decode("utf-8"))
                i += n
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            i += 1
    return "".join(out).encode()


_LOADED: dict[str, Pieces] = {}


def loaded(model: bytes) -> Pieces:
    """A worker's vocabulary, which it keeps from task to task."""
    key = hashlib.sha256(model).hexdigest()
    if key not in _LOADED:
        _LOADED[key] = Pieces(model)
    return _LOADED[key]


def batches_of(column: pa.Array, most: int):
    """Lists of texts of about `most` characters together."""
    texts, size = [], 0
    for value in column:
        texts.append(value.as_py() or "")
        size += len(texts[-1])
        if size >= most:
            yield texts
            texts, size = [], 0
    if texts:
        yield texts


def round_trip(docs: DataFrame, model: bytes, texts: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row of `docs`; with `texts`, also ids (array) and decoded."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if texts else "")

    def run(batches):
        tk.lean()
        p = loaded(shared.value)
        digest = lambda b: hashlib.sha256(b).hexdigest()
        turn = 0
        for batch in batches:
            at = 0
            for group in batches_of(batch.column(1), SLAB):
                ids, starts = p.encode(group, turn)
                turn += 1
                back = p.decode(ids, starts)
                cols = [
                    batch.column(0).slice(at, len(group)),
                    pa.array(np.diff(starts), pa.int64()),
                    pa.array([digest(x) for x in p.written(ids, starts)]),
                    pa.array([digest(x) for x in back]),
                ]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if texts:
                    cols += [pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(ids, pa.int32())), pa.array([x.decode() for x in back])]
                    names += ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays(cols, names)
                at += len(group)
        tk.lean()  # what the arrays took goes back before another stage has this worker

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, schema)
