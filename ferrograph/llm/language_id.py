"""Language identification by compression: zstandard with one raw-content dictionary per language.

A text is reduced to its lower-cased letters, cut into blocks, and compressed with each dictionary; the
language with the smallest sum of bytes wins. Equal sizes go to the language with more training rows, then by name.
`margin` is the lead over the second smallest as a share of it, and the score. A text is `rejected` if it
has no letter (null included, language `und`), or if its margin is under `min_margin`, whatever its length. A short
text's least lead, one byte, is a wide margin, so of those only ties are rejected.

The dictionaries are fitted on a bounded sample: at most `sample_docs` rows of each language, those of smallest hash
of doc_id, and `dict_bytes` bytes. Rows without language or text don't train. With no training row all is `und`.
Very long texts are compressed block by block. Repeated rows and ids are classified alike; other columns are ignored.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferrograph.llm import textkit as tk

UNKNOWN = "und"
#: Longest sample of one row, in characters.
SAMPLE_CHARS = 2000
_NOT_LETTERS = re.compile(r"[\W\d_]+")
_FILLER = b" " * 256


def letters(text: str | None) -> bytes:
    return _NOT_LETTERS.sub(" ", (text or "").lower()).strip().encode("utf-8", "replace")


def train(labelled: DataFrame, sample_docs: int = 400, dict_bytes: int = 64_000) -> list[tuple[str, bytes, int]]:
    """(language, dictionary, rows) of `labelled` (doc_id, text, lang), most rows first."""
    rows = labelled.filter("lang is not null and text is not null")
    rows = rows.withColumn("h", F.xxhash64(F.col("doc_id").cast("string")))
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return []
    # about three times the wanted rows by a threshold on the hash, so that no window sorts the corpus
    share = F.create_map(*(F.lit(v) for k, n in counts.items() for v in (k, min(1.0, 3 * sample_docs / n + 100 / n))))
    some = rows.filter((F.col("h") % 1_000_000).cast("double") / 1_000_000 < F.element_at(share, F.col("lang")) * 2 - 1)
    some = some.select("lang", "h", "doc_id", F.substring("text", 1, SAMPLE_CHARS).alias("text"))
    picked = some.orderBy("h", "doc_id").limit(4 * sample_docs * len(counts) + 200 * len(counts)).collect()
    out = []
    for lang, n in sorted(counts.items(), key=lambda x: (-x[1], x[0])):
        own = [letters(r["text"]) for r in picked if r["lang"] == lang][:sample_docs]
        out.append((lang, b" ".join(own)[:dict_bytes], n))
    return out


def sizes_of(compressors: list, text: bytes, block: int) -> list[int]:
    if len(text) < 512:  # what is too short would be stored as it is; a filler makes the matches count
        text = _FILLER + text
    parts = [text[i : i + block] for i in range(0, len(text), block)]
    return [sum(len(c.compress(p)) for p in parts) for c in compressors]


def identify(
    docs: DataFrame,
    model: list[tuple[str, bytes, int]],
    level: int = 6,
    block: int = 4096,
    min_margin: float = 0.005,
) -> DataFrame:
    """Adds lang_pred, score and rejected to doc_id."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        judge = _judge(shared.value, level, block, min_margin)
        for batch in batches:
            lang, score, out = zip(*map(judge, batch.column(1).to_pylist())) if batch.num_rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(out, pa.bool_())],
                ["doc_id", "lang_pred", "score", "rejected"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id long, lang_pred string, score double, rejected boolean"
    )


def _judge(model, level: int, block: int, min_margin: float):
    """A function from a text to (language, score, rejected)."""
    import zstandard as z

    tk.lean()
    names = [m[0] for m in model]
    compressors = []
    for _, raw, _ in model:
        # eight bytes at least: the library takes no less
        d = z.ZstdCompressionDict(raw.ljust(8), dict_type=z.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=level)
        compressors.append(z.ZstdCompressor(level=level, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))

    def judge(value: str | None) -> tuple[str, float, bool]:
        text = letters(value)
        if not names or not any(map(str.isalpha, value or "")):
            return UNKNOWN, 0.0, True
        sizes = sizes_of(compressors, text, block)
        order = sorted(range(len(sizes)), key=sizes.__getitem__)
        margin = 1.0 if len(order) == 1 else (sizes[order[1]] - sizes[order[0]]) / max(1, sizes[order[1]])
        return names[order[0]], margin, margin < min_margin

    return judge


def accepted(
    docs: DataFrame, model: list[tuple[str, bytes, int]], level: int = 6, block: int = 4096, min_margin: float = 0.005
) -> DataFrame:
    """The rows of `docs`, with all their columns, that are not rejected."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        judge = _judge(shared.value, level, block, min_margin)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            yield batch.filter(pa.array([not judge(t)[2] for t in texts], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def fold(doc_id: str = "doc_id", folds: int = 3) -> Column:
    """crc32 of doc_id as text, modulo folds."""
    return F.crc32(F.col(doc_id).cast("string")) % folds
