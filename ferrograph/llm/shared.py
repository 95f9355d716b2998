"""Session, storage and component helpers used by several operators."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrograph.plans import store

#: Sides of a join with at most this many narrow rows are broadcast; larger ones are shuffled.
BROADCAST_ROWS = 300_000
#: Rows of a key from which it is broadcast, and such keys at most.
HOT, HOT_MOST = 1000, 20_000
#: Bytes of an Arrow batch on its way to or from Python.
ARROW_BYTES = str(4 << 20)


def ship(spark: SparkSession) -> None:
    """Send the package to the executors; Arrow batches are bounded in bytes too, for texts may be long."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)
    store.ship(spark)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


shared_dir = store.shared_dir


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: it cuts lineage and survives lost executors. It goes when the driver ends."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    store.forget_at_exit(spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._saved_at = path
    return out


forget = store.forget


def most_frequent(counts: DataFrame, key: str, n: str, most: int, least: int = 1) -> DataFrame:
    """The rows with the highest counts, `most` at most, none cut off among equal counts, with at least `least`.

    A threshold from the histogram of counts: a top-k of this size would send k rows of every task to the driver.
    """
    high = 100_000
    steps = counts.filter(F.col(n) >= least).groupBy(F.least(F.col(n), F.lit(high)).alias("n")).agg(F.count(key).alias("rows"))
    total, cut = 0, None
    for r in sorted(steps.collect(), key=lambda r: -r["n"]):
        total += r["rows"]
        if total > most:
            break
        cut = r["n"]
    return counts.filter(F.lit(False)) if cut is None else counts.filter(F.col(n) >= cut)


def small(df: DataFrame, rows: int) -> DataFrame:
    """Hint a broadcast if `rows`, counted beforehand, is within the bound."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def met(rows: DataFrame, groups: DataFrame, key: str, n: str) -> DataFrame:
    """`rows` with the columns of `groups` (one row a key, counted by `n`), null where there is none.

    All of `groups` is broadcast if it is small. Else its keys with HOT rows or more are, so that their rows stay where
    they are, and the rest is joined.
    """
    if groups.count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(groups), key, "left")
    own = [c for c in groups.columns if c != key]
    hot = saved(most_frequent(groups, key, n, HOT_MOST, HOT), "hot")
    cold = groups.join(F.broadcast(hot.select(key)), key, "left_anti")
    both = rows.join(F.broadcast(hot.select(key, F.struct(*own).alias("_hot"))), key, "left")
    done = both.filter("_hot is not null").select(*rows.columns, *(F.col(f"_hot.{c}").alias(c) for c in own))
    return done.unionByName(both.filter("_hot is null").drop("_hot").join(cold, key, "left").select(*rows.columns, *own))


def components(edges: DataFrame, limit: int = 60) -> DataFrame:
    """(node, root): the smallest node reachable over undirected `edges` (a, b), for nodes with an edge.

    Alternates large-star and small-star rounds; every round only groups by a node with a
    partial minimum and joins that minimum back, so a node with very many neighbours is
    pre-aggregated and its rows can be split by the skew join.
    """
    e = saved(
        edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "cc"
    )
    sign = None
    for _ in range(limit):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        before, e = e, saved(
            large.join(low, "u")
            .select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("x"))
            .select(F.col("x.u").alias("u"), F.col("x.m").alias("v"))
            .filter("u <> v")
            .distinct(),
            "cc",
        )
        forget(before)
        now = e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == sign:
            break
        sign = now
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
