"""Data behind the five charts, ready to be drawn; nothing here draws."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def graph_chart(vertices: DataFrame, edges: DataFrame, positions: DataFrame, instances: int = 100) -> tuple[DataFrame, DataFrame]:
    """Entities and at most `instances` instances (by hash) with positions (id, x, y), and the edges between them."""
    some = vertices.filter("node_type <> 'entity'").orderBy(F.xxhash64("id"), "id").limit(instances)
    shown = vertices.filter("node_type = 'entity'").unionByName(some).join(positions, "id")
    ids = shown.select("id")
    lines = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return shown, lines


def embedding_chart(embeddings: np.ndarray) -> np.ndarray:
    """Two principal components."""
    x = embeddings - embeddings.mean(axis=0)
    u, s, _ = np.linalg.svd(x, full_matrices=False)
    return (u * s)[:, :2]


def training_chart(history: DataFrame) -> DataFrame:
    """step and a column per metric."""
    return history.groupBy("step").pivot("metric").agg(F.first("value")).orderBy("step")


def matrix_chart(edges: DataFrame) -> DataFrame:
    """src, dst, confidence: the greatest of each pair."""
    return edges.groupBy("src", "dst").agg(F.max("weight").alias("confidence"))


def report_chart(report: dict) -> dict[str, list]:
    """Bars of the business report: importance, anomalies, community sizes, and the health score."""
    return {
        "importance": [(r["id"], r["importance"]) for r in report["most_influential_nodes"]],
        "anomalies": [(r["id"], abs(r["z"])) for r in report["anomalous_entities"]],
        "communities": [(r["community"], r["n"]) for r in report["community_summary"]],
        "health": [("score", report["graph_health_score"])],
    }
