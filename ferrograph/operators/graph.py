"""Property graphs as DataFrames, and analytics on them.

Vertices have an id; edges src, dst and a weight. Loops write each round to the shared folder. What has no relational
form (Brandes, breadth-first search, Louvain) works on an adjacency of checked size: sources are dealt to tasks.
"""

from __future__ import annotations

import logging
from collections import deque
from collections.abc import Iterator
from functools import reduce
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ferrograph.config import EngineConfig
from ferrograph.errors import GraphError
from ferrograph.plans.store import forget, saved, ship

#: Edges that an adjacency in memory may have.
IN_MEMORY = 2_000_000
#: Pairs that dictionaries in memory may hold.
IN_DICTS = 500_000
#: Vertices of which all pairs may be held in matrices.
IN_MATRIX = 20_000


# --- building -------------------------------------------------------------------------------------------------------


def entity_nodes(entities: DataFrame, df: DataFrame) -> DataFrame:
    """id, label, entity_name, entity_type, column_count, row_count, confidence. Of (entity_name, entity_type, columns, confidence)."""
    n = df.agg(F.count("*").alias("row_count"))
    return entities.crossJoin(F.broadcast(n)).select(
        F.concat(F.lit("entity::"), "entity_name").alias("id"),
        F.col("entity_name").alias("label"),
        "entity_name",
        "entity_type",
        F.size("columns").cast("long").alias("column_count"),
        "row_count",
        "confidence",
    )


def instance_nodes(df: DataFrame, entity: str, key: str, label: str, order: str, most: int = 200, seed: int = 42) -> DataFrame:
    """id, entity_name, key_value, display_label: a seeded sample of the key's values, each with its first row's label."""
    first = df.filter(F.col(key).isNotNull()).groupBy(F.col(key).cast("string").alias("key_value")).agg(
        F.substring(F.min_by(F.col(label).cast("string"), order), 1, 50).alias("display_label")
    )
    some = first.orderBy(F.xxhash64("key_value", F.lit(seed)), "key_value").limit(most)
    return some.select(F.concat(F.lit(f"{entity}::"), "key_value").alias("id"), F.lit(entity).alias("entity_name"), "key_value", "display_label")


def member_edges(instances: DataFrame) -> DataFrame:
    """An edge from each instance to its entity."""
    return instances.select(
        F.col("id").alias("src"), F.concat(F.lit("entity::"), "entity_name").alias("dst"), F.lit("MEMBER_OF").alias("edge_type"), F.lit(1.0).alias("weight")
    )


def fk_edges(df: DataFrame, source: DataFrame, target: DataFrame, source_key: str, target_key: str, order: str, weight: float, name: str, rows: int = 150, most: int = 50) -> DataFrame:
    """Edges between instances whose keys stand in one of the first `rows` rows; after `most` hits none; repeats overwrite."""
    pairs = df.orderBy(order).limit(rows).select(F.col(order).alias("_o"), F.col(source_key).cast("string").alias("a"), F.col(target_key).cast("string").alias("b"))
    hit = pairs.join(F.broadcast(source.select(F.col("key_value").alias("a"), F.col("id").alias("src"))), "a")
    hit = hit.join(F.broadcast(target.select(F.col("key_value").alias("b"), F.col("id").alias("dst"))), "b")
    hit = hit.orderBy("_o").limit(most).select("src", "dst").distinct()
    return hit.select("src", "dst", F.lit(name).alias("edge_type"), F.lit(float(weight)).alias("weight"))


def last_edges(edges: DataFrame, order: str) -> DataFrame:
    """One edge a pair: the last in `order` overwrites the others."""
    w = Window.partitionBy("src", "dst").orderBy(F.desc(order))
    return edges.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def drop_isolated(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    return vertices.join(endpoints(edges).select("id").distinct(), "id", "left_semi")


def prune_weak(edges: DataFrame, least: float = 0.1) -> DataFrame:
    return edges.filter(F.col("weight") >= least)


# --- counts ---------------------------------------------------------------------------------------------------------


def endpoints(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("id"), F.lit(1).alias("out"), F.lit(0).alias("into")).unionAll(
        edges.select(F.col("dst"), F.lit(0), F.lit(1))
    )


def degrees(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """id, in_degree, out_degree, degree."""
    n = endpoints(edges).groupBy("id").agg(F.sum("into").alias("in_degree"), F.sum("out").alias("out_degree"))
    return vertices.select("id").join(n, "id", "left").fillna(0).withColumn("degree", F.col("in_degree") + F.col("out_degree"))


def degree_centrality(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """id, centrality: degree by the other vertices."""
    n = vertices.agg((F.count("*") - 1).alias("n"))
    return degrees(vertices, edges).crossJoin(F.broadcast(n)).select("id", F.coalesce(F.try_divide("degree", "n"), F.lit(1.0)).alias("centrality"))


def density(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """n_nodes, n_edges, avg_degree, density of a directed graph."""
    return vertices.agg(F.count("*").alias("n_nodes")).crossJoin(edges.agg(F.count("*").alias("n_edges"))).select(
        "n_nodes",
        "n_edges",
        F.coalesce(F.try_divide(2 * F.col("n_edges"), F.col("n_nodes")), F.lit(0.0)).alias("avg_degree"),
        F.coalesce(F.try_divide(F.col("n_edges"), F.col("n_nodes") * (F.col("n_nodes") - 1)), F.lit(0.0)).alias("density"),
    )


def within(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """The edges with both ends among the vertices."""
    for end in ("src", "dst"):
        edges = edges.join(vertices.select(F.col("id").alias(end)).distinct(), end, "left_semi")
    return edges


def undirected(edges: DataFrame) -> DataFrame:
    """a < b, each pair once, without loops."""
    return edges.filter("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()


def triangles(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """id, triangles, clustering. Edges point from the smaller degree to the larger, so hubs don't pair their neighbours."""
    e = undirected(edges)
    deg = e.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("deg"))
    e = e.join(deg.select(F.col("id").alias("a"), F.col("deg").alias("da")), "a").join(deg.select(F.col("id").alias("b"), F.col("deg").alias("db")), "b")
    up = (F.col("da") < F.col("db")) | ((F.col("da") == F.col("db")) & (F.col("a") < F.col("b")))
    o = e.select(F.when(up, F.col("a")).otherwise(F.col("b")).alias("u"), F.when(up, F.col("b")).otherwise(F.col("a")).alias("v"))
    x, y = o.select("u", F.col("v").alias("v1")), o.select("u", F.col("v").alias("v2"))
    wedge = x.join(y, "u").filter("v1 < v2")
    closing = undirected(edges).select(F.col("a").alias("v1"), F.col("b").alias("v2"))
    tri = wedge.join(closing, ["v1", "v2"]).select(F.explode(F.array("u", "v1", "v2")).alias("id")).groupBy("id").agg(F.count("*").alias("triangles"))
    out = vertices.select("id").join(tri, "id", "left").join(deg, "id", "left").fillna(0)
    return out.select(
        "id", "triangles", F.coalesce(F.try_divide(2.0 * F.col("triangles"), F.col("deg") * (F.col("deg") - 1)), F.lit(0.0)).alias("clustering")
    )


# --- loops ----------------------------------------------------------------------------------------------------------


def components(vertices: DataFrame, edges: DataFrame, limit: int = 60) -> DataFrame:
    """id, component: the smallest id of the connected component, by large-star and small-star rounds."""
    e = saved(undirected(edges).select(F.col("b").alias("u"), F.col("a").alias("v")))
    sign = None
    for _ in range(limit):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(low, "u")
        before, e = e, saved(moved.select("u", F.col("m").alias("v")).union(moved.select("v", "m")).filter("u <> v").distinct())
        forget(before)
        now = e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == sign:
            break
        sign = now
    else:
        raise GraphError("components did not settle", rounds=limit)
    return vertices.select("id").join(e.select(F.col("u").alias("id"), "v"), "id", "left").select("id", F.coalesce("v", "id").alias("component"))


def hierarchy(vertices: DataFrame, edges: DataFrame, bound: int = 64) -> DataFrame:
    """id, level: the longest path from a vertex without predecessors; unreached is 0.

    A cycle has no longest path, so levels end at `bound`, and a warning names it if the graph goes deeper.
    """
    ids = vertices.select("id")
    e = edges.filter("src <> dst").select("src", "dst").distinct()
    front = ids.join(e.select(F.col("dst").alias("id")).distinct(), "id", "left_anti").select("id", F.lit(0).alias("level"))
    level = front = saved(front)
    for depth in range(1, bound + 1):
        front = saved(front.join(e, front["id"] == e["src"]).select(F.col("dst").alias("id")).distinct().withColumn("level", F.lit(depth)))
        if front.isEmpty():
            break
        level = level.unionAll(front)
    else:
        logging.getLogger(__name__).warning("levels end at %d: the graph has a cycle or longer paths", bound)
    best = level.groupBy("id").agg(F.max("level").alias("level"))
    return ids.join(best, "id", "left").fillna(0, ["level"])


def pagerank(vertices: DataFrame, edges: DataFrame, rounds: int = 100, alpha: float = 0.85, tolerance: float | None = 1e-6) -> DataFrame:
    """id, rank: weighted PageRank; the mass of vertices without successors is dealt evenly. Stops at n * tolerance."""
    ids = saved(vertices.select("id").distinct())
    n = ids.count()
    if not n:
        return ids.withColumn("rank", F.lit(0.0))
    out = edges.groupBy("src").agg(F.sum("weight").alias("total"))
    share = saved(edges.groupBy("src", "dst").agg(F.sum("weight").alias("w")).join(out, "src").select("src", "dst", (F.col("w") / F.col("total")).alias("p")))
    ends = saved(ids.join(share.select(F.col("src").alias("id")).distinct(), "id", "left_anti"))
    rank = saved(ids.withColumn("rank", F.lit(1.0 / n)))
    for _ in range(rounds):
        lost = rank.join(ends, "id", "left_semi").agg(F.coalesce(F.sum("rank"), F.lit(0.0)).alias("lost"))
        got = share.join(rank, share["src"] == rank["id"]).groupBy("dst").agg(F.sum(F.col("rank") * F.col("p")).alias("got"))
        new = rank.join(got, rank["id"] == got["dst"], "left").crossJoin(F.broadcast(lost))
        new = new.select("id", (alpha * (F.coalesce("got", F.lit(0.0)) + F.col("lost") / n) + (1 - alpha) / n).alias("rank"), F.col("rank").alias("was"))
        new, before = saved(new), rank
        forget(before)
        moved = new.agg(F.sum(F.abs(F.col("rank") - F.col("was")))).first()[0] if tolerance is not None else None
        rank = new.drop("was")
        rank._saved_at = new._saved_at
        if moved is not None and moved < n * tolerance:
            break
    return rank


def label_propagation(vertices: DataFrame, edges: DataFrame, rounds: int = 10) -> DataFrame:
    """id, community: every vertex takes the label with most weight around it (its own counts half), the smallest of several."""
    e = edges.filter("src <> dst")
    both = saved(e.select("src", "dst", "weight").unionAll(e.select("dst", "src", "weight")))
    label = saved(vertices.select("id", F.col("id").alias("community")))
    for _ in range(rounds):
        votes = both.join(label, both["dst"] == label["id"]).select(F.col("src").alias("id"), "community", "weight")
        votes = votes.unionAll(label.select("id", "community", F.lit(0.5)))
        sums = votes.groupBy("id", "community").agg(F.sum("weight").alias("w"))
        w = Window.partitionBy("id").orderBy(F.desc("w"), "community")
        before, label = label, saved(sums.withColumn("n", F.row_number().over(w)).filter("n = 1").select("id", "community"))
        forget(before)
    return label


# --- in memory ------------------------------------------------------------------------------------------------------


def adjacency(vertices: DataFrame, edges: DataFrame) -> tuple[list, np.ndarray, np.ndarray, np.ndarray]:
    """Ids, and the edges as places of their ends with weights; of a graph of checked size."""
    if edges.count() > IN_MEMORY:
        raise GraphError("the graph is too large to be held in memory", most=IN_MEMORY)
    ids = vertices.select("id").distinct().orderBy("id").toArrow()["id"].combine_chunks()
    kind = vertices.schema["id"].dataType
    e = edges.select(F.col("src").cast(kind), F.col("dst").cast(kind), F.col("weight").cast("double")).toArrow()
    src, dst = (pc.fill_null(pc.index_in(e[c], ids), -1).to_numpy().astype(int) for c in ("src", "dst"))
    there = (src >= 0) & (dst >= 0)
    return ids.to_pylist(), src[there], dst[there], e["weight"].to_numpy().astype(float)[there]


def numbered(vertices: DataFrame) -> DataFrame:
    """id, place: the ids in order, from 0."""
    ids = saved(vertices.select("id").distinct().orderBy("id").withColumn("_m", F.monotonically_increasing_id()))
    part = F.shiftright("_m", 33)
    before, n = [], 0
    for r in ids.groupBy(part.alias("part")).count().orderBy("part").collect():
        before.append((r["part"], n))
        n += r["count"]
    before = ids.sparkSession.createDataFrame(before, "_part long, _before long")
    place = F.col("_before") + F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))
    return saved(ids.withColumn("_part", part).join(F.broadcast(before), "_part").select("id", place.cast("int").alias("place")))


def _neighbours(n: int, src, dst, w) -> list[list[tuple[int, float]]]:
    out: list[list] = [[] for _ in range(n)]
    for s, d, x in zip(src.tolist(), dst.tolist(), w.tolist()):
        out[s].append((d, x))
    return out


class _Near:
    """The neighbours of each vertex with the weights of the edges, out of sorted arrays; -1 has neighbours of its own."""

    def __init__(self, n: int, src: np.ndarray, dst: np.ndarray, w: np.ndarray):
        order = np.argsort(src, kind="stable")
        self.first, self.dst, self.w = np.searchsorted(src[order], np.arange(n + 1)), dst[order].astype(np.int32), w[order]
        self.own: list[tuple[int, float]] = []

    def __getitem__(self, v: int) -> list[tuple[int, float]]:
        if v < 0:
            return self.own
        a, z = self.first[v], self.first[v + 1]
        return list(zip(self.dst[a:z].tolist(), self.w[a:z].tolist()))


def betweenness(vertices: DataFrame, edges: DataFrame, pivots: int | None = None, weighted: bool = True, seed: int = 42) -> DataFrame:
    """id, betweenness, normalised for directed graphs. Brandes' algorithm: sources (all, or a sample by hash scaled up)
    are dealt to tasks; partial sums meet in an aggregation. A weight is a distance.

    Only vertices with edges in and out lie on paths. Tasks hold the edges that leave these, of checked number; other sources
    come with their own edges, those with equal edges once.
    """
    spark = vertices.sparkSession
    ship(spark)
    ids = saved(vertices.select("id").distinct())
    kind = ids.schema["id"].dataType
    n = ids.count()
    weight = F.col("weight").cast("double") if weighted else F.lit(1.0)
    e = saved(within(ids, edges.select(F.col("src").cast(kind), F.col("dst").cast(kind), weight.alias("weight"))))
    middle = saved(e.select("src").distinct().join(e.select(F.col("dst").alias("src")).distinct(), "src", "left_semi"))
    core = e.join(middle, "src", "left_semi")
    held, src, dst, w = adjacency(core.select(F.col("src").alias("id")).union(core.select("dst")), core)
    if not held:
        return ids.select("id", F.lit(0.0).alias("betweenness"))
    shared = spark.sparkContext.broadcast(_Near(len(held), src, dst, w))
    passed = np.bincount(src, minlength=len(held)) > 0
    names = spark.createDataFrame(pa.table({"i": pa.array(range(len(held)), pa.int32()), "id": held, "middle": passed}))
    chosen, taken = None, n
    if pivots and pivots < n:
        chosen, taken = saved(ids.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(pivots)), pivots
    first = names.filter("middle")
    outer = e.join(middle, "src", "left_anti")
    if chosen is not None:
        first = first.join(chosen, "id", "left_semi")
        outer = outer.join(chosen.select(F.col("id").alias("src")), "src", "left_semi")
    # ends that no vertex in between leads to are reached by these edges only, so nothing depends on them
    outer = outer.join(names.select(F.col("id").alias("dst"), "i", "middle"), "dst")
    outer = outer.groupBy("src").agg(F.array_sort(F.collect_list(F.struct("i", "weight"))).alias("near"), F.max("middle").alias("any")).filter("any")
    outer = outer.groupBy("near").agg(F.count("*").alias("times"))
    start = first.select(F.col("i").alias("s"), F.lit(1).cast("long").alias("times"), F.array().cast("array<int>").alias("to"), F.array().cast("array<double>").alias("far"))
    start = start.unionByName(outer.select(F.lit(-1).alias("s"), "times", F.col("near.i").alias("to"), F.col("near.weight").alias("far")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near = shared.value
        total = np.zeros(len(near.first) - 1)
        for batch in batches:
            for s, times, to, far in zip(*(c.to_pylist() for c in batch.columns)):
                near.own = list(zip(to, far))
                for v, x in _dependencies(near, s).items():
                    total[v] += x * times
        hit = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(hit.astype(np.int32)), pa.array(total[hit])], ["i", "v"])

    scale = (1 / ((n - 1) * (n - 2)) if n > 2 else 1.0) * (n / max(1, taken))
    sums = start.repartition(64).mapInArrow(run, "i int, v double").groupBy("i").agg((F.sum("v") * scale).alias("v"))
    found = names.select("i", "id").join(sums, "i").select("id", "v")
    return ids.join(found, "id", "left").select("id", F.coalesce("v", F.lit(0.0)).alias("betweenness"))


def _dependencies(near: list, s: int) -> dict[int, float]:
    """Brandes' dependencies of one source on the vertices it reaches, with Dijkstra's order. What it costs goes by these, not by the graph."""
    import heapq

    dist, paths, before, order, done = {s: 0.0}, {s: 1.0}, {s: []}, [], set()
    heap = [(0.0, s)]
    while heap:
        d, v = heapq.heappop(heap)
        if v in done:
            continue
        done.add(v)
        order.append(v)
        for u, x in near[v]:
            old = dist.get(u, np.inf)
            if d + x < old - 1e-12:
                dist[u], paths[u], before[u] = d + x, paths[v], [v]
                heapq.heappush(heap, (d + x, u))
            elif abs(d + x - old) <= 1e-12 and u not in done:
                paths[u] += paths[v]
                before[u].append(v)
    out = dict.fromkeys(order, 0.0)
    for v in reversed(order):
        for u in before[v]:
            out[u] += paths[u] / paths[v] * (1 + out[v])
    del out[s]
    return out


def modularity(n: int, src, dst, w, label: np.ndarray, resolution: float = 1.0) -> float:
    """Of an undirected graph whose edges stand once."""
    m = w.sum()
    if not m:
        return 0.0
    k = np.bincount(src, w, n) + np.bincount(dst, w, n)
    inside = w[label[src] == label[dst]].sum() / m
    total = np.bincount(label, k)
    return float(inside - resolution * ((total / (2 * m)) ** 2).sum())


def louvain(vertices: DataFrame, edges: DataFrame, resolution: float = 1.0, seed: int = 42) -> dict:
    """Communities by id, of a graph whose ids fit the driver."""
    return {r["id"]: r["community"] for r in louvain_communities(vertices, edges, resolution, seed).orderBy("id").collect()}


def louvain_communities(vertices: DataFrame, edges: DataFrame, resolution: float = 1.0, seed: int = 42) -> DataFrame:
    """id, community: Louvain's moves and merges until modularity stands still. Communities are numbered by their smallest ids.

    A pair has the greatest weight of its edges. Graphs of over IN_DICTS pairs are merged by moves in rounds over tables, until
    what is left has no more; then vertices move in turn.
    """
    spark = vertices.sparkSession
    label = saved(vertices.select("id").distinct().withColumn("community", F.col("id")))
    e = within(label, edges).groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))
    e = saved(e.agg(F.max(F.col("weight").cast("double")).alias("weight")))
    ends = label
    while e.count() > IN_DICTS:
        merged = _louvain_rounds(e, resolution, seed)
        if merged is None:  # no move gains
            e = None
            break
        label = saved(label.join(merged.select(F.col("id").alias("community"), F.col("community").alias("_to")), "community", "left").select("id", F.coalesce("_to", "community").alias("community")))
        e = saved(_merged_pairs(e, merged))
        ends = endpoints(e)
    if e is not None:
        ids, src, dst, w = adjacency(ends, e)
        if ids:
            table = pa.table({"community": ids, "_to": _louvain(len(ids), src, dst, w, resolution, seed)})
            last = spark.createDataFrame(table).withColumn("_to", F.concat(F.lit("_"), "_to"))
            label = label.withColumn("own", F.col("community").cast("string")).join(last, "community", "left").select("id", F.coalesce("_to", F.concat(F.lit("="), "own")).alias("community"))
    first = label.groupBy("community").agg(F.min("id").alias("_first"))
    number = first.select("community", (F.row_number().over(Window.orderBy("_first")) - 1).alias("_n"))
    return label.join(number, "community").select("id", F.col("_n").alias("community"))


def _merged_pairs(e: DataFrame, label: DataFrame) -> DataFrame:
    """The pairs of communities with the weight between; within one it is a loop."""
    for end in ("src", "dst"):
        e = e.join(label.select(F.col("id").alias(end), F.col("community").alias(f"_{end}")), end)
    return e.groupBy(F.least("_src", "_dst").alias("src"), F.greatest("_src", "_dst").alias("dst")).agg(F.sum("weight").alias("weight"))


def _louvain_rounds(e: DataFrame, resolution: float, seed: int, rounds: int = 30) -> DataFrame | None:
    """id, community of the ends of the pairs: in each round half of the vertices (by hash) move where modularity would gain most.

    Moves of one round don't see each other, so the labels with the greatest modularity are kept; two rounds without a gain end it.
    """
    two_ends = lambda x: x.filter("src <> dst").select("src", "dst", "weight").unionAll(x.filter("src <> dst").select("dst", "src", "weight"))
    both = saved(two_ends(e))
    k = both.select(F.col("src").alias("id"), "weight").unionAll(e.filter("src = dst").select("src", 2 * F.col("weight")))
    label = saved(k.groupBy("id").agg(F.sum("weight").alias("k")).withColumn("community", F.col("id")))
    two_m = label.agg(F.sum("k")).first()[0]
    loops = e.filter("src = dst").agg(F.coalesce(F.sum("weight"), F.lit(0.0))).first()[0]
    if not two_m:
        return None
    best, kept, since = -np.inf, None, 0
    for r in range(rounds):
        total = saved(label.groupBy("community").agg(F.sum("k").alias("total")))
        near = both.join(label.select(F.col("id").alias("dst"), "community"), "dst").groupBy(F.col("src").alias("id"), "community").agg(F.sum("weight").alias("w"))
        near = near.unionAll(label.select("id", "community", F.lit(0.0))).groupBy("id", "community").agg(F.sum("w").alias("w"))
        near = near.join(label.select("id", "k", F.col("community").alias("own")), "id").join(total, "community")
        rest = F.col("total") - F.when(F.col("community") == F.col("own"), F.col("k")).otherwise(0.0)
        near = near.withColumn("gain", F.col("w") - resolution * rest * F.col("k") / two_m)
        own = F.max(F.when(F.col("community") == F.col("own"), F.struct("gain", "w")))
        step = near.groupBy("id").agg(F.first("k").alias("k"), F.first("own").alias("own"), own.alias("now"), F.min(F.struct((-F.col("gain")).alias("loss"), "community")).alias("to"))
        gains = (-F.col("to.loss") > F.col("now.gain") + 1e-12) & (F.pmod(F.xxhash64("id", F.lit(seed + r)), F.lit(2)) == 0)
        new = saved(step.select("id", "k", F.when(gains, F.col("to.community")).otherwise(F.col("own")).alias("community"), F.col("now.w").alias("w"), (-F.col("to.loss") > F.col("now.gain") + 1e-12).alias("more")))
        seen = new.agg(F.sum("w").alias("w"), F.count_if("more").alias("more")).first()
        square = total.agg(F.sum(F.col("total") * F.col("total"))).first()[0]
        value = (seen["w"] / 2 + loops) * 2 / two_m - resolution * square / two_m**2
        forget(total)
        if value > best + 1e-7:
            if kept is not None:
                forget(kept)
            best, kept, since = value, label, 0
        else:
            forget(label)
            since += 1
        if since == 2 or not seen["more"]:
            forget(new)
            break
        label = new.select("id", "k", "community")
        label._saved_at = new._saved_at
    forget(both)
    return kept.select("id", "community") if kept.filter("id <> community").limit(1).count() else None


def _louvain(n: int, src: np.ndarray, dst: np.ndarray, w: np.ndarray, resolution: float, seed: int) -> np.ndarray:
    """The community of each vertex, by moves in turn."""
    pair: dict[tuple, float] = {}
    for s, d, x in zip(src.tolist(), dst.tolist(), w.tolist()):
        key = (min(s, d), max(s, d))
        pair[key] = max(pair.get(key, 0.0), x)
    member = np.arange(n)
    rng = np.random.default_rng(seed)
    while True:
        size = int(member.max(initial=-1)) + 1
        near: list[dict] = [{} for _ in range(size)]
        loop = np.zeros(size)
        for (s, d), x in pair.items():
            if s == d:
                loop[s] += x
            else:
                near[s][d] = near[s].get(d, 0) + x
                near[d][s] = near[d].get(s, 0) + x
        degree = np.array([sum(a.values()) for a in near]) + 2 * loop if size else np.empty(0)
        two_m = degree.sum()
        label, total = np.arange(size), degree.copy()
        moved_any = False
        while two_m:
            moved = False
            for v in rng.permutation(size).tolist():
                links: dict[int, float] = {}
                for u, x in near[v].items():
                    links[label[u]] = links.get(label[u], 0) + x
                own = label[v]
                total[own] -= degree[v]
                gain = lambda c: links.get(c, 0.0) - resolution * total[c] * degree[v] / two_m  # noqa: B023, E731
                best = max(sorted(links), key=gain, default=own)
                if gain(best) <= gain(own) + 1e-12:
                    best = own
                total[best] += degree[v]
                if best != own:
                    label[v] = best
                    moved = moved_any = True
            if not moved:
                break
        if not moved_any:
            break
        _, label = np.unique(label, return_inverse=True)
        member = label[member]
        merged: dict[tuple, float] = {}
        for (s, d), x in pair.items():
            key = (min(label[s], label[d]), max(label[s], label[d]))
            merged[key] = merged.get(key, 0) + x
        pair = merged
    return member


def diameter(vertices: DataFrame, edges: DataFrame, most: int | None = 500, parts: DataFrame | None = None) -> int:
    """Of the largest component (of several the one with the smallest id), if it has 2 to `most` - 1 vertices; else -1. None: of any size.

    Of vertices with equal neighbours one is kept. Then breadth-first searches bound what is left until no vertex can see further than
    was seen: in memory, or over tables if there are more edges than an adjacency may have. parts: (id, component), if known.
    """
    if parts is None:
        parts = saved(components(vertices.select("id").distinct(), within(vertices, edges)))
    top = parts.groupBy("component").agg(F.count_distinct("id").alias("n")).orderBy(F.desc("n"), "component").first()
    if top is None or top["n"] < 2 or (most is not None and top["n"] >= most):
        return -1
    largest = parts.filter(F.col("component") == top["component"]).select("id")
    pairs = within(largest, undirected(edges).select(F.col("a").alias("src"), F.col("b").alias("dst")))
    both, twins = _without_twins(saved(pairs.select("src", "dst").unionAll(pairs.select("dst", "src"))))
    return max(2 if twins else 1, _widest(both))


def _without_twins(both: DataFrame) -> tuple[DataFrame, bool]:
    """Of vertices with the same neighbours the first only, again and again: paths lead through each alike. And if there were some.

    Digests of the neighbours find them; that these are the same is counted.
    """
    some = False
    while True:
        hashed = [F.bit_xor(F.xxhash64("dst", F.lit(i))).alias(f"_h{i}") for i in range(2)]
        near = both.groupBy("src").agg(F.count("*").alias("_k"), *hashed)
        like = near.groupBy("_k", "_h0", "_h1").agg(F.min("src").alias("rep"))
        like = saved(near.join(like, ["_k", "_h0", "_h1"]).select("src", "rep"))
        if like.filter("src <> rep").isEmpty():
            return both, some
        first = like.filter("src = rep").select("src")
        kept = both.join(first, "src", "left_semi")
        if both.join(like, "src").select("rep", "dst").distinct().count() != kept.count():  # digests are equal by chance
            return both, some
        before, both, some = both, saved(kept.join(first.select(F.col("src").alias("dst")), "dst", "left_semi").select("src", "dst")), True
        forget(before)


def _widest(both: DataFrame) -> int:
    """The diameter of a connected graph. both: its edges, both ways.

    A search from v bounds all others: at distance d from v one sees as far as the greater of d and far(v) - d, and no further than far(v) + d.
    """
    if both.count() > 2 * IN_MEMORY:
        return _widest_of_tables(both)
    ids, src, dst, _ = adjacency(both.select(F.col("src").alias("id")), both.filter("src < dst").withColumn("weight", F.lit(1.0)))
    src, dst = np.r_[src, dst], np.r_[dst, src]
    near, size = dst[np.argsort(src, kind="stable")], np.bincount(src, minlength=len(ids))
    first = np.cumsum(size) - size
    low, high, best, inner = np.zeros(len(ids), int), np.full(len(ids), len(ids)), 0, True
    while (high > best).any():
        left = np.flatnonzero(high > best)
        v = left[np.lexsort((-size[left], low[left] if inner else -high[left]))[0]]
        d = _distances(first, size, near, v)
        best = max(best, int(d.max()))
        low, high = np.maximum(low, np.maximum(d, d.max() - d)), np.minimum(high, d.max() + d)
        inner = not inner
    return best


def _distances(first: np.ndarray, size: np.ndarray, near: np.ndarray, v: int) -> np.ndarray:
    """From v to each vertex, level by level."""
    dist, front, d = np.full(len(size), -1), np.array([v]), 0
    dist[v] = 0
    while len(front):
        d, n = d + 1, size[front]
        reached = near[np.repeat(first[front] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        front = np.unique(reached[dist[reached] < 0])
        dist[front] = d
    return dist


def _widest_of_tables(both: DataFrame) -> int:
    """As `_widest`, with a row a vertex."""
    n = both.select("src").distinct().count()
    state = saved(both.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("k")).select("id", "k", F.lit(0).alias("low"), F.lit(n).cast("int").alias("high")))
    best, inner = 0, True
    while True:
        v = state.filter(F.col("high") > best).orderBy(F.col("low") if inner else F.desc("high"), F.desc("k"), "id").select("id").first()
        if v is None:
            return best
        far = _levels(both, state.filter(F.col("id") == v["id"]).select("id"))
        deepest = far.agg(F.max("d")).first()[0]
        best = max(best, deepest)
        low, high = F.greatest("low", "d", deepest - F.col("d")), F.least("high", deepest + F.col("d"))
        before, state = state, saved(state.join(far, "id").select("id", "k", low.alias("low"), high.alias("high")))
        forget(before)
        forget(far)
        inner = not inner


def _levels(both: DataFrame, start: DataFrame) -> DataFrame:
    """id, d: the distances from a vertex. What a level leads to lies in it, in the one before or in the next."""
    before = front = saved(start.withColumn("d", F.lit(0)))
    levels = [front]
    for d in count(1):
        new = front.join(both, front["id"] == both["src"]).select(F.col("dst").alias("id")).distinct()
        new = new.join(front, "id", "left_anti").join(before, "id", "left_anti")
        before, front = front, saved(new.withColumn("d", F.lit(d)))
        levels.append(front)
        if front.isEmpty() or len(levels) > 50:
            all_levels = saved(reduce(DataFrame.unionAll, levels))
            for x in levels:
                if x is not front and x is not before:
                    forget(x)
            if front.isEmpty():
                return all_levels
            levels = [all_levels]


def _bfs(near: list, s: int) -> list[tuple[int, int]]:
    dist, queue = {s: 0}, deque([s])
    while queue:
        v = queue.popleft()
        for u, _ in near[v]:
            if u not in dist:
                dist[u] = dist[v] + 1
                queue.append(u)
    return list(dist.items())


def statistics(vertices: DataFrame, edges: DataFrame, communities: dict | DataFrame | None = None, most: int | None = 500) -> dict:
    """most: see `diameter`."""
    row = density(vertices, edges).first().asDict()
    parts = saved(components(vertices, edges))
    row["n_components"] = parts.select("component").distinct().count()
    row["avg_clustering"] = triangles(vertices, edges).agg(F.avg("clustering")).first()[0] or 0.0
    # edges to other than vertices link components, but are no way
    row["diameter"] = diameter(vertices, edges, most, parts if within(vertices, edges).count() == row["n_edges"] else None)
    if isinstance(communities, DataFrame):
        row["n_communities"] = communities.select("community").distinct().count()
    else:
        row["n_communities"] = len(set(communities.values())) if communities else 0
    return row


def hierarchical_layout(levels: DataFrame) -> DataFrame:
    """id, x (level), y (community, with a jitter by hash). Of (id, level, community)."""
    jitter = (F.pmod(F.xxhash64("id"), F.lit(1000)) / 1000.0 - 0.5) * 0.4
    return levels.select("id", F.col("level").cast("double").alias("x"), (F.col("community") + jitter).alias("y"))


def spring_layout(vertices: DataFrame, edges: DataFrame, rounds: int = 50, seed: int = 42) -> dict:
    """Positions by Fruchterman and Reingold's forces, in numpy."""
    ids, src, dst, _ = adjacency(vertices, edges)
    n = len(ids)
    pos = np.random.default_rng(seed).random((n, 2))
    k, t = np.sqrt(1 / max(n, 1)), 0.1
    block = max(1, 4_000_000 // max(n, 1))  # rows of the distances that are held at once
    for _ in range(rounds):
        push = np.empty((n, 2))
        for lo in range(0, n, block):
            delta = pos[lo : lo + block, None] - pos[None]
            far = np.maximum(np.linalg.norm(delta, axis=2), 0.01)
            push[lo : lo + block] = (delta * (k * k / far**2)[:, :, None]).sum(axis=1)
        pull = pos[src] - pos[dst]
        pull = pull * np.linalg.norm(pull, axis=1, keepdims=True) / k
        np.add.at(push, src, -pull)
        np.add.at(push, dst, pull)
        length = np.maximum(np.linalg.norm(push, axis=1, keepdims=True), 0.01)
        pos += push / length * np.minimum(length, t)
        t -= 0.1 / (rounds + 1)
    return {v: tuple(p) for v, p in zip(ids, pos.tolist())}


def kamada_kawai_layout(vertices: DataFrame, edges: DataFrame, rounds: int = 60, seed: int = 42) -> dict:
    """Positions whose distances follow path lengths, by majorising the weighted stress; parts lie one diameter and a step apart.

    It needs matrices of all pairs, so graphs of over IN_MATRIX vertices are refused.
    """
    ids, src, dst, w = adjacency(vertices, edges)
    n = len(ids)
    if n > IN_MATRIX:
        raise GraphError("the graph is too large for a matrix of all pairs", most=IN_MATRIX)
    near = _neighbours(n, np.r_[src, dst], np.r_[dst, src], np.r_[w, w])
    far = np.full((n, n), np.nan)
    for s in range(n):
        for v, d in _bfs(near, s):
            far[s, v] = d
    far = np.where(np.isnan(far), np.nanmax(far, initial=0) + 1, far)
    weight = np.where(far > 0, 1 / np.maximum(far, 1) ** 2, 0.0)
    lap = np.diag(weight.sum(axis=1)) - weight
    inverse = np.linalg.pinv(lap) if n else lap
    pos = np.random.default_rng(seed).random((n, 2))
    for _ in range(rounds):
        delta = np.linalg.norm(pos[:, None] - pos[None], axis=2)
        b = -weight * far / np.where(delta > 1e-9, delta, 1)
        np.fill_diagonal(b, 0)
        np.fill_diagonal(b, -b.sum(axis=1))
        pos = inverse @ (b @ pos)
    return {v: tuple(p) for v, p in zip(ids, pos.tolist())}


def sample_neighbours(edges: DataFrame, seeds: DataFrame, fanout: tuple[int, ...] = (10, 5), seed: int = 42) -> DataFrame:
    """src, dst, hop: for each hop at most `fanout` neighbours (by hash) of the vertices that the hop before reached."""
    both = edges.select("src", "dst").union(edges.select("dst", "src")).distinct()
    front, out = seeds.select("id"), None
    for hop, most in enumerate(fanout, 1):
        w = Window.partitionBy("src").orderBy(F.xxhash64("src", "dst", F.lit(seed)), "dst")
        step = both.join(front, both["src"] == front["id"], "left_semi").withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= most)
        step = saved(step.select("src", "dst", F.lit(hop).alias("hop")))
        out = step if out is None else out.unionAll(step)
        front = step.select(F.col("dst").alias("id")).distinct()
    return out


def build(df: DataFrame, entities: list[dict], relations: list[dict], order: str, config: EngineConfig | None = None) -> tuple[DataFrame, DataFrame]:
    """Vertices and edges: entities, sampled instances, memberships, relationships and instance links; then pruned."""
    g = (config or EngineConfig()).graph
    spark = df.sparkSession
    rows = [(e["name"], e["type"], e["columns"], float(e["confidence"])) for e in entities]
    ents = spark.createDataFrame(rows, "entity_name string, entity_type string, columns array<string>, confidence double")
    nodes = entity_nodes(ents, df).withColumn("node_type", F.lit("entity"))
    places, parts = {}, []
    for e in entities:
        inst = saved(instance_nodes(df, e["name"], e["representative"], e["representative"], order, g.instances_per_entity))
        places[e["name"]] = inst
        parts.append(member_edges(inst))
        nodes = nodes.unionByName(inst.withColumn("label", F.col("display_label")).withColumn("node_type", F.lit("instance")), allowMissingColumns=True)
    if relations:
        rel = [(f"entity::{r['source']}", f"entity::{r['target']}", r["name"], float(r["confidence"])) for r in relations]
        parts.append(spark.createDataFrame(rel, "src string, dst string, edge_type string, weight double"))
    for r in relations:
        if r["linking"]:
            parts.append(fk_edges(df, places[r["source"]], places[r["target"]], *r["linking"], order, r["confidence"], r["name"], g.fk_rows, g.fk_edges))
    edges = None
    for i, p in enumerate(parts):
        p = p.withColumn("_i", F.lit(i))
        edges = p if edges is None else edges.unionByName(p)
    edges = saved(last_edges(edges, "_i").drop("_i"))
    if g.drop_isolated:
        nodes = drop_isolated(nodes, edges)
    return saved(nodes), prune_weak(edges, g.prune_edges)
