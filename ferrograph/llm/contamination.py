"""Benchmark decontamination: size-partitioned MinHash containment search, verified exactly.

Texts are reduced to words of ASCII letters and digits and all characters beyond ASCII (A-Z in lower case), and words
to `k`-word shingles (all words, if fewer). An item is contained in a document when at least `threshold` of its
distinct shingles are among the document's.

A short item inside a long document has a tiny Jaccard similarity, so items are partitioned by size, in powers
of two, and for each size class a document is cut into overlapping windows of that scale: windows of twice the
class's largest size, half overlapping, of which one holds any stretch of that size whole. A window and an item of its class
are compared by one-permutation MinHash with twice as many bins as the window has shingles: every bin keeps
its least hash, and one equal bin makes a candidate. Of an item's shingle in a window some other shingle takes the bin in about one case of nine;
a contained item of nine shingles has eight there at least, and is lost if all lose theirs (2e-8). Items of the least class
(up to 8 shingles) don't depend on bins: one equal shingle makes them candidates, so none is lost. Candidates are verified
on the document's whole set of shingles.

The items are a stated query set: their signatures and shingles are broadcast block by block, each block
of at most `block_shingles` shingles, against all documents; documents are never shuffled or collected, but read once a block.

Null or wordless texts contain nothing and are contained in nothing. Of rows with the same item_id each counts for itself;
a document row that is repeated gives its rows again. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrograph.llm import textkit as tk
from ferrograph.llm.shared import saved, small

U = np.uint64
#: The size class that is looked up by all its shingles, not by bins.
EXACT = 8
HIT = "doc_id long, item_id long, n_item long, n_common long, containment double"


def shingles(text: str, k: int) -> np.ndarray:
    for _, _, b, off in tk.slabs(pa.array([text], pa.string())):
        return next(tk.row_shingles(*tk.word_hashes(b, off, tk.ALNUM), k))
    raise AssertionError


def size_class(n: int) -> int:
    """The largest size of the class that holds n: a power of two."""
    return 1 << max(3, int(n - 1).bit_length())


def bins_of(cls: int) -> int:
    return 4 * cls


class Items:
    """A block of items, by size class: bin signatures to look up, and the shingle sets."""

    def __init__(self, items: list[tuple[int, np.ndarray]]):
        self.ids = np.array([i for i, _ in items], np.int64)
        self.sets = [g for _, g in items]
        self.by_class: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for cls in sorted({size_class(len(g)) for g in self.sets}):
            keys, who = [], []
            for at, g in enumerate(self.sets):
                if size_class(len(g)) == cls:
                    sig = g if cls <= EXACT else least_by_bin(g, np.zeros(len(g), np.int64), bins_of(cls))[1]
                    keys.append(sig)
                    who.append(np.full(len(sig), at))
            keys, who = np.concatenate(keys), np.concatenate(who)
            order = np.argsort(keys, kind="stable")
            self.by_class[cls] = keys[order], who[order]
        # a table of bits in front of the sorted signatures: most shingles stop there
        self.bits = {c: _bits(k) for c, (k, _) in self.by_class.items()}


def _bits(keys: np.ndarray) -> np.ndarray:
    out = np.zeros(1 << 20, bool)
    out[(keys >> U(12)).astype(np.int64) & 0xFFFFF] = True
    return out


def least_by_bin(g: np.ndarray, window: np.ndarray, bins: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window and bin (the hash modulo bins) the least hash: (windows, hashes)."""
    key = window * bins + (g % U(bins)).astype(np.int64)
    order = np.lexsort((g, key))
    first = np.r_[True, key[order][1:] != key[order][:-1]] if len(g) else np.empty(0, bool)
    return window[order][first], g[order][first]


def candidates(grams: np.ndarray, items: Items) -> set[int]:
    """Places of the items of which some window of a document (its shingles in order) has an equal bin."""
    out: set[int] = set()
    for cls, (keys, who) in items.by_class.items():
        maybe = np.flatnonzero(items.bits[cls][(grams >> U(12)).astype(np.int64) & 0xFFFFF])
        if not len(maybe):
            continue
        at = np.minimum(np.searchsorted(keys, grams[maybe]), len(keys) - 1)
        maybe = maybe[keys[at] == grams[maybe]]
        if not len(maybe):
            continue
        if cls <= EXACT:
            equal = np.unique(grams[maybe])
            for a, b in zip(np.searchsorted(keys, equal).tolist(), np.searchsorted(keys, equal, "right").tolist()):
                out.update(who[a:b].tolist())
            continue
        # only windows with a shingle of an item can have an equal bin: build those
        starts = np.unique(np.concatenate([maybe // cls, np.maximum(maybe // cls - 1, 0)]))
        place = (starts[:, None] * cls + np.arange(2 * cls)).ravel()
        window = np.repeat(np.arange(len(starts)), 2 * cls)
        inside = place < len(grams)
        _, least = least_by_bin(grams[place[inside]], window[inside], bins_of(cls))
        lo, hi = np.searchsorted(keys, least), np.searchsorted(keys, least, "right")
        for a, b in zip(lo[hi > lo].tolist(), hi[hi > lo].tolist()):
            out.update(who[a:b].tolist())
    return out


def _blocks(items: DataFrame, k: int, block_shingles: int) -> Iterator[Items]:
    block, size = [], 0
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("text is not null")
    for r in rows.orderBy("item_id", "text").toLocalIterator():
        g = shingles(r["text"], k)
        if len(g):
            block.append((r["item_id"], g))
            size += len(g)
        if size >= block_shingles:
            yield Items(block)
            block, size = [], 0
    if block:
        yield Items(block)


def contained(docs: DataFrame, items: DataFrame, k: int = 5, threshold: float = 0.8, block_shingles: int = 2_000_000) -> DataFrame:
    """A row for each document and item contained in it: doc_id, item_id, n_item, n_common, containment."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = None
    for block in _blocks(items, k, block_shingles):
        hits = rows.mapInArrow(_search(spark.sparkContext.broadcast(block), k, threshold), HIT)
        out = hits if out is None else out.unionAll(hits)
    return spark.createDataFrame([], HIT) if out is None else out


def clean(docs: DataFrame, items: DataFrame, k: int = 5, threshold: float = 0.8) -> DataFrame:
    """The rows of `docs`, with all their columns, whose id has no text that contains an item."""
    hits = saved(contained(docs, items, k, threshold).select(F.col("doc_id").alias("_hit")).distinct(), "hits")
    return docs.join(small(hits, hits.count()), docs["doc_id"].cast("long") == hits["_hit"], "left_anti")


def _search(shared, k: int, threshold: float):
    def run(batches):
        tk.lean()
        items = shared.value
        for batch in batches:
            found = []
            for lo, hi, b, off in tk.slabs(batch.column(1)):
                h, first = tk.word_hashes(b, off, tk.ALNUM)
                grams = tk.grams(h, k)
                for row in range(lo, hi):
                    s, e = int(first[row - lo]), int(first[row - lo + 1])
                    if e - s >= k:
                        own = grams[s : e - k + 1]
                    elif e > s:
                        own = next(tk.row_shingles(h[s:e], np.array([0, e - s]), k))
                    else:
                        continue
                    who = candidates(own, items)
                    if who:
                        whole = np.unique(own)
                        for i in sorted(who):
                            g = items.sets[i]
                            at = np.minimum(np.searchsorted(whole, g), len(whole) - 1)
                            n = int((whole[at] == g).sum())
                            if n >= threshold * len(g) - 1e-9:
                                found.append((batch.column(0)[row].as_py(), int(items.ids[i]), len(g), n, n / len(g)))
            cols = list(zip(*found)) if found else [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(list(c), pa.int64()) for c in cols[:4]), pa.array(list(cols[4]), pa.float64())],
                ["doc_id", "item_id", "n_item", "n_common", "containment"],
            )

    return run


ORACLE = r"""
WITH d AS (
  SELECT doc_id AS id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents),
i AS (
  SELECT item_id AS id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
ds AS (
  SELECT DISTINCT id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda x: array_to_string(w[x:x + 4], ' '))
                                  WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM d),
si AS (
  SELECT DISTINCT id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda x: array_to_string(w[x:x + 4], ' '))
                                  WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM i),
n AS (SELECT id, count(*) AS n FROM si GROUP BY id)
SELECT ds.id AS doc_id, si.id AS item_id, any_value(n.n) AS n_item, count(*) AS n_common,
       count(*)::DOUBLE / any_value(n.n) AS containment
FROM ds JOIN si ON ds.s = si.s JOIN n ON n.id = si.id
GROUP BY ds.id, si.id HAVING 10 * count(*) >= 8 * any_value(n.n)
"""
