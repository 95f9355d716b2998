"""Chat formatting after collapsing cumulative snapshots, in DataFrame operations only.

Logged conversations often repeat an earlier one and go on. Every turn gets the rolling hash of
the turns up to it: the exclusive or of hashes that hold each turn's place, taken over a running
window, 128 bits in all. A conversation whose last hash and length are found inside a longer one is
its prefix and is dropped by an anti-join; of equal conversations the smallest conv_id stays.
What remains is rendered.

A null role or text counts as empty (a null and an empty one are the same). Turns are ordered by turn,
nulls first, then role and text; rows repeated in full count once. Rows without a conv_id are one conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ferrograph.llm.shared import saved, small


def _rows(conversations: DataFrame) -> DataFrame:
    """key (of the conversation, never null), conv_id, turn, role, text and two hashes of role and text."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), text("role").alias("role"), text("text").alias("text"))
    return rows.select(
        F.coalesce(F.col("conv_id").cast("string"), F.lit("-")).alias("key"),
        "*",
        F.xxhash64("role", "text").alias("h"),
        F.xxhash64("text", F.lit("turn"), "role").alias("g"),
    )


def turns(conversations: DataFrame) -> DataFrame:
    """key, conv_id, place (from 1), h1, h2: the rolling hashes of the first `place` turns. Texts stay where they are:
    turns go by their hashes, dealt by conversation once."""
    rows = _rows(conversations).select("key", "conv_id", "turn", "role", "h", "g").repartition("key").distinct()
    placed = rows.withColumn("place", F.row_number().over(Window.partitionBy("key").orderBy("turn", "role", "h", "g")))
    running = Window.partitionBy("key").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    mixed = placed.select("key", "conv_id", "place", F.xxhash64("place", "h", "g").alias("x"), F.xxhash64("g", "place", "h").alias("y"))
    return mixed.select("key", "conv_id", "place", F.bit_xor("x").over(running).alias("h1"), F.bit_xor("y").over(running).alias("h2"))


def maximal(conversations: DataFrame) -> DataFrame:
    """key, conv_id and n_turns of the conversations that stay, and `absorbed`: how many equal ones they stand for besides."""
    prefix = turns(conversations)
    last = F.max("place").over(Window.partitionBy("key"))
    prefix = saved(prefix.withColumn("last", last), "turns")
    ends = prefix.filter("place = last")
    one = ends.groupBy("place", "h1", "h2").agg(
        F.min(F.struct(F.col("conv_id").isNull().alias("z"), "conv_id", "key")).alias("k"), (F.count("*") - 1).alias("absorbed")
    )
    inner = prefix.filter("place < last").select("place", "h1", "h2").distinct()
    return one.join(inner, ["place", "h1", "h2"], "left_anti").select(
        F.col("k.key").alias("key"), F.col("k.conv_id").alias("conv_id"), F.col("place").cast("long").alias("n_turns"), "absorbed"
    )


def rendered(role: Column, text: Column) -> Column:
    """The format of one turn."""
    return F.concat(F.lit("<|"), role, F.lit("|>\n"), text, F.lit("\n<|end|>\n"))


def formatted(conversations: DataFrame) -> DataFrame:
    """conv_id, n_turns, absorbed, rendered: the maximal conversations as training texts."""
    keep = saved(maximal(conversations), "maximal")
    kept = small(keep.select("key", "n_turns", "absorbed"), keep.count())
    item = F.struct("turn", "role", "h", "g", "text")
    texts = (
        _rows(conversations)
        .join(kept, "key")
        .groupBy("key")
        .agg(F.first("conv_id").alias("conv_id"), F.array_distinct(F.sort_array(F.collect_list(item))).alias("items"), F.first("n_turns").alias("n_turns"), F.first("absorbed").alias("absorbed"))
    )
    return texts.select(
        "conv_id", "n_turns", "absorbed", F.array_join(F.transform("items", lambda t: rendered(t["role"], t["text"])), "").alias("rendered")
    )


ORACLE = r"""
WITH r AS (
  SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
c AS (
  SELECT conv_id, count(*) AS n_turns,
         string_agg('<|' || role || '|>' || chr(10) || text || chr(10) || '<|end|>' || chr(10), '' ORDER BY turn, role, text) AS rendered
  FROM r GROUP BY conv_id),
u AS (SELECT min(conv_id) AS conv_id, n_turns, count(*) - 1 AS absorbed, rendered FROM c GROUP BY n_turns, rendered)
SELECT conv_id, n_turns, absorbed, rendered FROM u
WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.n_turns > u.n_turns AND starts_with(c.rendered, u.rendered))
"""
