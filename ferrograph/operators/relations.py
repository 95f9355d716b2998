"""Relationships between entities: signals, their fusion, names and types."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ferrograph.config import EngineConfig
from ferrograph.functions.text import name_tokens
from ferrograph.operators import keys

# The verb for a pair of types (in this order when matched in part), and the words after a reference.
VERBS = (
    ("person", "transaction", "PLACES"),
    ("business_object", "transaction", "PLACES"),
    ("transaction", "document", "GENERATES"),
    ("document", "transaction", "SETTLES"),
    ("business_object", "product", "ORDERS"),
    ("person", "document", "RECEIVES"),
    ("transaction", "product", "CONTAINS"),
    ("reference", "transaction", "CLASSIFIES"),
    ("person", "business_object", "MANAGES"),
)
KEY_WORDS = ("id", "key", "no", "num")
# Confidence that each signal adds.
FK, PREFIX, CORRELATION, TEMPORAL = 0.5, 0.4, 0.3, 0.2

SIGNAL = "src string, tgt string, confidence double, evidence string"


def corr_pairs(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """col_a, col_b, r of all pairs of columns, in one aggregation."""
    pairs = list(combinations(columns, 2))
    rows = F.array(*(F.struct(F.lit(a).alias("col_a"), F.lit(b).alias("col_b"), F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias("r")) for a, b in pairs))
    return df.agg(rows.alias("x")).select(F.explode("x").alias("x")).select("x.*")


def mean_times(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """entity, mean_us: the mean of each entity's time column in microseconds. columns: entity -> column."""
    rows = F.array(*(F.struct(F.lit(e).alias("entity"), F.avg(F.unix_micros(F.col(c).cast("timestamp"))).alias("mean_us")) for e, c in columns.items()))
    return df.agg(rows.alias("x")).select(F.explode("x").alias("x")).select("x.*").filter("mean_us is not null")


def temporal_order(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """src, tgt, days: whole days between the mean times of all ordered pairs of entities with one."""
    m = mean_times(df, columns)
    a, b = m.select(F.col("entity").alias("src"), F.col("mean_us").alias("a")), m.select(F.col("entity").alias("tgt"), F.col("mean_us").alias("b"))
    return a.crossJoin(F.broadcast(b)).filter("src <> tgt").select("src", "tgt", F.floor(F.abs(F.col("b") - F.col("a")) / 86_400_000_000).cast("long").alias("days"))


def prefix_refs(columns: DataFrame) -> DataFrame:
    """src, tgt, column: columns of one entity that name another, followed by a key word. Of (entity, column, place)."""
    t = columns.select("entity", "column", "place", F.posexplode(name_tokens(F.col("column"))).alias("at", "token"))
    after = Window.partitionBy("entity", "column").orderBy("at")
    t = t.withColumn("follow", F.lead("token").over(after)).filter(F.col("follow").isin(*KEY_WORDS))
    other = F.broadcast(columns.select(F.col("entity").alias("tgt")).distinct())
    name = F.lower("tgt")
    hit = t.join(other, (F.col("entity") != F.col("tgt")) & ((F.col("token") == name) | F.startswith("token", F.substring(name, 1, 4))))
    return hit.groupBy(F.col("entity").alias("src"), "tgt").agg(F.min_by("column", "place").alias("column"))


def fuse(signals: DataFrame, prune: float = 0.15, keep: int = 5) -> DataFrame:
    """src, tgt, confidence (the signals' sum, 1 at most) and the first pieces of evidence. Of (src, tgt, place, confidence, evidence)."""
    out = signals.groupBy("src", "tgt").agg(
        F.least(F.sum("confidence"), F.lit(1.0)).alias("confidence"),
        F.transform(F.slice(F.array_sort(F.collect_list(F.struct("place", "evidence"))), 1, keep), lambda s: s["evidence"]).alias("evidence"),
    )
    return out.filter(F.col("confidence") >= prune)


def first_direction(pairs: DataFrame, order: str) -> DataFrame:
    """Of two directions of a pair the one that comes first in `order`."""
    w = Window.partitionBy(F.least("src", "tgt"), F.greatest("src", "tgt")).orderBy(order)
    return pairs.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def verb(source: Column, target: Column) -> Column:
    """The verb for two types: an exact pair, else the first that one side holds, else RELATED_TO."""
    out = None
    for s, t, v in VERBS:
        hit = (source == s) & (target == t)
        out = F.when(hit, v) if out is None else out.when(hit, v)
    for s, t, v in VERBS:
        out = out.when(F.contains(source, F.lit(s)) | F.contains(target, F.lit(t)), v)
    return out.otherwise("RELATED_TO")


def type_label(source: Column, target: Column, cardinality: Column) -> Column:
    return (
        F.when(target.isin("transaction", "document"), "GENERATES")
        .when(source == "transaction", "PROCESSES")
        .when(cardinality == "1:1", "HAS")
        .when(cardinality == "N:N", "REFERENCES")
        .otherwise("HAS")
    )


def discover(df: DataFrame, entities: list[dict], types: dict[str, str], config: EngineConfig | None = None) -> list[dict]:
    """Relationships between `entities` (each with name, type and columns) found in `df`, best first.

    The work on rows is distributed; what is fused here is one number per signal and pair of entities.
    """
    config = config or EngineConfig()
    spark = df.sparkSession
    found: list[tuple] = []
    order = {(a["name"], b["name"]): i for i, (a, b) in enumerate((a, b) for a in entities for b in entities if a is not b)}
    ids = [c for e in entities for c in e["columns"] if types.get(c) == "id"]
    owner = {c: e["name"] for e in entities for c in e["columns"]}
    links: dict[tuple, tuple] = {}
    if len(ids) > 1:
        for r in keys.overlaps(keys.value_sets(df, ids)).collect():
            for x, y, n in ((r["col_a"], r["col_b"], r["n_a"]), (r["col_b"], r["col_a"], r["n_b"])):
                pair = (owner[x], owner[y])
                if pair in order and n and r["n_both"] / n >= config.fk_subset and pair not in links:
                    links[pair] = (x, y)
                    found.append((*pair, 0, FK, f"FK: {x} in {y} for {r['n_both'] / n:.2f}"))
    rows = [(e["name"], c, i) for e in entities for i, c in enumerate(e["columns"])]
    for r in prefix_refs(spark.createDataFrame(rows, "entity string, column string, place int")).collect():
        found.append((r["src"], r["tgt"], 1, PREFIX, f"Prefix: {r['column']} names {r['tgt']}"))
    numbers = [c for e in entities for c in e["columns"] if types.get(c) == "numeric"]
    best: dict[tuple, tuple] = {}
    for r in corr_pairs(df, numbers).collect() if len(numbers) > 1 else []:
        a, b = owner[r["col_a"]], owner[r["col_b"]]
        if a != b and r["r"] is not None and abs(r["r"]) == abs(r["r"]):
            pair = (a, b) if order.get((a, b), 0) < order.get((b, a), 0) else (b, a)
            best[pair] = max(best.get(pair, (0.0, "", "")), (abs(r["r"]), r["col_a"], r["col_b"]))
    found += [(*p, 2, CORRELATION * v, f"Correlation: {a} and {b} at {v:.2f}") for p, (v, a, b) in best.items() if v > config.correlation]
    dates = {e["name"]: c for e in entities for c in reversed(e["columns"]) if types.get(c) == "datetime"}
    for r in temporal_order(df, dates).collect() if len(dates) > 1 else []:
        found.append((r["src"], r["tgt"], 3, TEMPORAL, f"Temporal: {r['src']} precedes {r['tgt']} by {r['days']} days"))
    if not found:
        return []
    signals = spark.createDataFrame(found, "src string, tgt string, place int, confidence double, evidence string")
    places = spark.createDataFrame([(a, b, i) for (a, b), i in order.items()], "src string, tgt string, seq int")
    kind = {e["name"]: e["type"] for e in entities}
    fused = first_direction(fuse(signals, config.relationship_prune).join(places, ["src", "tgt"]), "seq").collect()
    fused.sort(key=lambda r: (-r["confidence"], r["seq"]))
    if not fused:
        return []
    linking = [links.get((r["src"], r["tgt"])) for r in fused]
    cards = _cardinalities(df, {x for x in linking if x})
    rows = [(i, kind[r["src"]], kind[r["tgt"]], cards.get(x, "1:N")) for i, (r, x) in enumerate(zip(fused, linking))]
    named = spark.createDataFrame(rows, "i int, s string, t string, card string")
    named = {r["i"]: r for r in named.select("i", "card", verb(F.col("s"), F.col("t")).alias("v"), type_label(F.col("s"), F.col("t"), F.col("card")).alias("l")).collect()}
    return [
        {"source": r["src"], "target": r["tgt"], "name": named[i]["v"], "type": named[i]["l"], "confidence": round(r["confidence"], 3), "evidence": list(r["evidence"]), "cardinality": named[i]["card"], "linking": x}
        for i, (r, x) in enumerate(zip(fused, linking))
    ]


def _cardinalities(df: DataFrame, pairs: set[tuple[str, str]]) -> dict[tuple[str, str], str]:
    """The cardinality of each pair of columns, in one job."""
    every = None
    for a, b in sorted(pairs):
        one = keys.cardinality(df, a, b).select(F.lit(a).alias("a"), F.lit(b).alias("b"), "cardinality")
        every = one if every is None else every.unionAll(one)
    return {(r["a"], r["b"]): r["cardinality"] for r in every.collect()} if every is not None else {}
