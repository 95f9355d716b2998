"""Exact deduplication with a log-structured merge index, in DataFrame operations only.

Each input task is a memtable: it flushes one run, a Parquet file sorted by digest with a Bloom filter and min/max
statistics on the digest. Compaction merges runs by digest and keeps for each the identifier that stays and the number
of rows. Digests hit more than once are then verified on the bytes: the least and the greatest normalised text of a
digest must be the same, which is aggregated before the shuffle. Should a digest stand for different texts, its rows are
grouped by the text itself.

`Index` keeps such runs over several deliveries, in levels: FAN_IN compacted runs of a level are merged into one of the
next. New digests are looked up in every older run, and while they are few the runs' filters pass over what can't hold them.

Rows of digests with very many rows are met by a broadcast, the rest of the repeated ones by a join; rows whose digest is
found once need neither.

A null text counts as empty. A null doc_id sorts after all others. Rows with the same doc_id and
text count separately in group_size and share `kept`. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrograph.llm.shared import BROADCAST_ROWS, forget, met, new_path, saved
from ferrograph.plans.store import forget_at_exit

#: What normalising deletes: space and U+0009 to U+000D.
WHITE = " \t\n\x0b\x0c\r"
#: Runs of a level that make one of the next, and digests that are looked up by the filters at most.
FAN_IN, PROBES = 4, 2000


def normal(text: str = "text") -> Column:
    return F.translate(F.coalesce(text, F.lit("")), WHITE, "")


def sha256(value: Column) -> Column:
    return F.sha2(value, 256)


def _rows(docs: DataFrame, digest) -> DataFrame:
    """doc_id, chars, digest; and text_sha256, if the digest is another."""
    more = [] if digest is sha256 else [sha256(normal()).alias("text_sha256")]
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.length(F.coalesce("text", F.lit(""))).cast("long").alias("chars"), digest(normal()).alias("digest"), *more
    )


def _run(rows: DataFrame, *order: str) -> DataFrame:
    """Rows written as runs: files sorted by digest, with a Bloom filter each."""
    spark = rows.sparkSession
    path = new_path(spark, "runs")
    write = rows.sortWithinPartitions(*order).write.option("parquet.bloom.filter.enabled#digest", "true")
    write.option("parquet.bloom.filter.max.bytes", str(1 << 17)).parquet(path)
    forget_at_exit(spark, path)
    out = spark.read.schema(rows.schema).parquet(path)
    out._saved_at = path
    return out


def flush_runs(docs: DataFrame, digest=sha256) -> DataFrame:
    """The memtables of all tasks, as runs."""
    return _run(_rows(docs, digest), "digest", "doc_id")


def compact(runs: DataFrame, *by: str) -> DataFrame:
    """For each digest the identifier that stays (most characters, then smallest doc_id) and the number of rows."""
    best = F.min(F.struct((-F.col("chars")).alias("c"), F.col("doc_id").isNull().alias("z"), "doc_id"))
    return runs.groupBy(*by).agg(best.alias("best"), F.count("*").alias("group_size")).select(
        *by, F.col("best.doc_id").alias("keep_id"), "group_size"
    )


def collisions(docs: DataFrame, repeated: DataFrame, digest=sha256) -> DataFrame:
    """Digests of more than one row whose normalised texts differ."""
    hits = repeated.select("digest")
    n = hits.count()
    texts = docs.select(normal().alias("norm")).withColumn("digest", digest(F.col("norm")))
    texts = texts.join(F.broadcast(hits) if n <= BROADCAST_ROWS else hits, "digest", "left_semi")
    ends = texts.groupBy("digest").agg(F.min("norm").alias("lo"), F.max("norm").alias("hi"))
    return ends.filter("lo <> hi").select("digest")


def exact_groups(docs: DataFrame, digest=sha256) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for each row of `docs` (doc_id, text)."""
    runs = flush_runs(docs, digest)
    repeated = saved(compact(runs, "digest").filter("group_size > 1"), "repeated")
    wrong = saved(collisions(docs, repeated, digest), "wrong")
    found = met(runs, repeated, "digest", "group_size")
    sha = F.col("digest" if digest is sha256 else "text_sha256").alias("text_sha256")
    out = [
        "doc_id",
        F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        sha,
    ]
    if wrong.isEmpty():
        result = found.select(*out)
    else:  # never seen with SHA-256; a digest of one's own may be weaker
        bad = docs.withColumn("_norm", normal()).withColumn("digest", digest(F.col("_norm")))
        bad = bad.join(wrong, "digest", "left_semi").select(
            F.col("doc_id").cast("long").alias("doc_id"), F.length(F.coalesce("text", F.lit(""))).cast("long").alias("chars"), F.col("_norm").alias("norm")
        )
        by_text = bad.join(compact(bad, "norm"), "norm").select("doc_id", "keep_id", "group_size", sha256(F.col("norm")).alias("text_sha256"))
        result = found.join(wrong, "digest", "left_anti").select(*out).unionByName(by_text)
    return result.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


class Index:
    """Compacted runs of several deliveries: digest, chars, doc_id (of the row that stays) and group_size, in levels."""

    def __init__(self, spark: SparkSession, digest=sha256):
        self.spark, self.digest = spark, digest
        self.levels: list[list[DataFrame]] = []

    @staticmethod
    def _merge(rows: DataFrame) -> DataFrame:
        best = F.min(F.struct((-F.col("chars")).alias("c"), F.col("doc_id").isNull().alias("z"), "doc_id"))
        one = rows.groupBy("digest").agg(best.alias("best"), F.sum("group_size").alias("group_size"))
        return one.select("digest", (-F.col("best.c")).alias("chars"), F.col("best.doc_id").alias("doc_id"), "group_size")

    def add(self, docs: DataFrame) -> None:
        """Flush a delivery as a run of the first level, and merge levels that are full."""
        flushed = flush_runs(docs, self.digest)
        self._put(0, _run(self._merge(flushed.withColumn("group_size", F.lit(1).cast("long"))), "digest"))
        forget(flushed)

    def _put(self, level: int, run: DataFrame) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) == FAN_IN:
            old, self.levels[level] = self.levels[level], []
            every = old[0]
            for r in old[1:]:
                every = every.unionByName(r)
            self._put(level + 1, _run(self._merge(every), "digest"))
            for r in old:
                forget(r)

    def runs(self) -> list[DataFrame]:
        return [r for level in self.levels for r in level]

    def lookup(self, docs: DataFrame) -> DataFrame:
        """doc_id, digest, keep_id, group_size of the rows of `docs` whose text the index has."""
        new = saved(_rows(docs, self.digest).select("doc_id", "digest"), "probes")
        wanted = saved(new.select("digest").distinct(), "digests")
        few = [r["digest"] for r in wanted.limit(PROBES + 1).collect()]
        every = None
        for run in self.runs():
            # the list goes to the files' filters and statistics; beyond it a join looks for the digests
            part = run.filter(F.col("digest").isin(*few)) if len(few) <= PROBES else run.join(wanted, "digest", "left_semi")
            every = part if every is None else every.unionByName(part)
        if every is None:
            return new.select("doc_id", "digest", F.lit(None).cast("long").alias("keep_id"), F.lit(0).cast("long").alias("group_size")).limit(0)
        hits = saved(self._merge(every).select("digest", F.col("doc_id").alias("keep_id"), "group_size"), "hits")
        return met(new, hits, "digest", "group_size").filter("group_size is not null").select("doc_id", "digest", "keep_id", "group_size")


def first_copies(docs: DataFrame) -> DataFrame:
    """The rows of `docs`, with all their columns, that stay; of rows that repeat id and text one."""
    groups = saved(exact_groups(docs).select("doc_id", "text_sha256", "kept", "group_size"), "groups")
    dropped = groups.filter("not kept").select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha"))
    again = groups.filter("kept and group_size > 1").groupBy("doc_id", "text_sha256").count().filter("count > 1")
    again = again.select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha"))

    def same(right: DataFrame) -> Column:  # by frame: `docs` may have any other columns
        return docs["doc_id"].cast("long").eqNullSafe(right["_id"]) & (sha256(F.translate(F.coalesce(docs["text"], F.lit("")), WHITE, "")) == right["_sha"])

    out = docs.join(F.broadcast(dropped) if dropped.count() <= BROADCAST_ROWS else dropped, same(dropped), "left_anti")
    if again.isEmpty():
        return out
    single = out.join(again, same(again), "left_anti")
    return single.unionByName(out.join(again, same(again), "left_semi").dropDuplicates(["doc_id", "text"]))


ORACLE = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents),
g AS (
  SELECT doc_id, text_sha256,
         first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g
"""
