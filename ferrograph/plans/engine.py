"""The whole way from a table to a graph and a report."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrograph.config import EngineConfig
from ferrograph.operators import clean, entities, graph, insight, network, profile, relations
from ferrograph.plans.session import ContextLogger
from ferrograph.plans.store import saved

log = ContextLogger("ferrograph")


@dataclass
class Result:
    table: DataFrame
    types: dict[str, str]
    entities: list[dict]
    relations: list[dict]
    vertices: DataFrame
    edges: DataFrame
    communities: dict = field(default_factory=dict)
    embeddings: DataFrame | None = None
    report: dict = field(default_factory=dict)
    tracker: network.Tracker | None = None


def prepare(df: DataFrame, order: str | None = None, config: EngineConfig | None = None) -> tuple[DataFrame, str]:
    """The cleaned table, with a row number where it has no column to order by. Types are inferred before and after."""
    config = config or EngineConfig()
    if order is None:
        order = "__row_idx"
        df = df.withColumn(order, F.monotonically_increasing_id())
    df = saved(df)
    types = {r["column"]: r["semantic_type"] for r in profile.semantic_types(df, [order], [c for c in df.columns if c != order], config).collect()}
    return saved(clean.clean(df, types, order, config)), order


def build_graph(df: DataFrame, order: str | None = None, config: EngineConfig | None = None) -> Result:
    """Clean, discover entities and relationships, and build the graph with communities."""
    config = config or EngineConfig()
    df, order = prepare(df, order, config)
    found, types = entities.discover(df.drop(order), [df.drop(order).columns[0]], config)
    log.bind(step="entities").info("%d entities", len(found))
    links = relations.discover(df, found, types, config)
    log.bind(step="relationships", entities=len(found)).info("%d relationships", len(links))
    vertices, edges = graph.build(df, found, links, order, config)
    out = Result(df, types, found, links, vertices, edges)
    out.communities = graph.louvain(vertices, edges, config.graph.resolution, config.seed)
    return out


def infer(result: Result, config: EngineConfig | None = None) -> Result:
    """Train the network on the graph, and fill in embeddings and the report."""
    config = config or EngineConfig()
    spark = result.table.sparkSession
    v, e = result.vertices, result.edges
    comm = spark.createDataFrame([(k, int(c)) for k, c in result.communities.items()], "id string, community int")
    rank, deg = graph.pagerank(v, e).withColumnRenamed("rank", "pagerank"), graph.degrees(v, e)
    nodes = v.select("id", "node_type", "entity_type", "entity_name").join(rank, "id").join(deg, "id").join(graph.hierarchy(v, e), "id").join(comm, "id")
    nodes = saved(nodes)
    trainer, places = network.train_graph(v, e, network.node_features(nodes), config)
    ids = [r["id"] for r in places.orderBy("place").collect()]
    result.tracker = trainer.train()
    z = trainer.embeddings()
    result.embeddings = saved(spark.createDataFrame([(i, [float(x) for x in row]) for i, row in zip(ids, z)], "id string, embedding array<double>"))
    length = spark.createDataFrame([(i, float(np.linalg.norm(row))) for i, row in zip(ids, z)], "id string, embedding_norm double")
    between = saved(graph.betweenness(v, e, pivots=50, seed=config.seed))
    scores = saved(nodes.join(length, "id").join(between, "id"))
    weight = insight.importance(scores.select("id", "embedding_norm", "pagerank", "betweenness", F.col("degree").cast("double").alias("degree")), config)
    ents = nodes.filter("node_type = 'entity'")
    anomalies = insight.neighbour_anomaly(result.embeddings, e).join(ents.select("id"), "id", "left_semi")
    links = insight.link_candidates(result.embeddings.join(ents.select("id"), "id", "left_semi"), e, config.inference.link, config.inference.top_links)
    odd = anomalies.filter(F.abs("z") > config.inference.anomaly_z).count()
    health = insight.health(v.count(), e.count(), len(set(result.communities.values())), len(result.entities), odd)
    exact = graph.betweenness(v, e).join(ents.select("id", "out_degree"), "id")
    result.report = insight.report(
        weight.join(ents.select("id", "entity_name"), "id"), links, anomalies, insight.community_summary(ents.select("community", "entity_name")), insight.bottlenecks(exact), health, config
    )
    return result


def run(df: DataFrame, order: str | None = None, config: EngineConfig | None = None) -> Result:
    return infer(build_graph(df, order, config), config)
