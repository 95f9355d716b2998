"""Exports of a graph: JSON, GraphML, Cytoscape.js, Markdown. Row-wise formats stream; no table is collected whole."""

from __future__ import annotations

import json
from pathlib import Path
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrograph.config import EngineConfig


def _rows(df: DataFrame):
    """JSON texts of the rows, partition by partition."""
    for r in df.select(F.to_json(F.struct(*df.columns)).alias("j")).toLocalIterator():
        yield r["j"]


def to_json(vertices: DataFrame, edges: DataFrame, path: str, entities: list[dict] = (), relations: list[dict] = (), config: EngineConfig | None = None) -> None:
    """One document with nodes, edges, entities, relationships and metadata."""
    with open(path, "w", encoding="utf-8") as f:
        f.write('{"nodes": [')
        f.writelines(("," if i else "") + j for i, j in enumerate(_rows(vertices)))
        f.write('], "edges": [')
        f.writelines(("," if i else "") + j for i, j in enumerate(_rows(edges)))
        meta = {"version": (config or EngineConfig()).version}
        f.write(f'], "entities": {json.dumps(list(entities))}, "relationships": {json.dumps(list(relations))}, "metadata": {json.dumps(meta)}}}')


def to_graphml(vertices: DataFrame, edges: DataFrame, path: str) -> None:
    """Lists become comma-joined texts, other values texts; nulls are left out."""
    keys = sorted({("node", c) for c in vertices.columns if c != "id"} | {("edge", c) for c in edges.columns if c not in ("src", "dst")})
    text = lambda v: ",".join(map(str, v)) if isinstance(v, list) else str(v)
    with open(path, "w", encoding="utf-8") as f:
        f.write('<?xml version="1.0" encoding="UTF-8"?>\n<graphml xmlns="http://graphml.graphdrawing.org/xmlns">\n')
        f.writelines(f'<key id="{k}_{c}" for="{k}" attr.name={quoteattr(c)} attr.type="string"/>\n' for k, c in keys)
        f.write('<graph edgedefault="directed">\n')
        data = lambda kind, r, skip: "".join(f'<data key="{kind}_{c}">{escape(text(v))}</data>' for c, v in r.items() if c not in skip and v is not None)
        for r in vertices.toLocalIterator():
            r = r.asDict()
            f.write(f"<node id={quoteattr(str(r['id']))}>{data('node', r, ('id',))}</node>\n")
        for r in edges.toLocalIterator():
            r = r.asDict()
            f.write(f"<edge source={quoteattr(str(r['src']))} target={quoteattr(str(r['dst']))}>{data('edge', r, ('src', 'dst'))}</edge>\n")
        f.write("</graph>\n</graphml>\n")


def cytoscape_elements(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """element: a JSON text for each node (position times 1000, where x and y are given) and edge (id source__target)."""
    at = F.struct((F.col("x") * 1000).alias("x"), (F.col("y") * 1000).alias("y")) if {"x", "y"} <= set(vertices.columns) else F.lit(None)
    node = F.struct(F.lit("nodes").alias("group"), F.struct(*(c for c in vertices.columns if c not in ("x", "y"))).alias("data"), at.alias("position"))
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    data = F.struct(F.concat(F.col("src").cast("string"), F.lit("__"), F.col("dst").cast("string")).alias("id"), F.col("src").alias("source"), F.col("dst").alias("target"), *rest)
    edge = F.struct(F.lit("edges").alias("group"), data.alias("data"))
    return vertices.select(F.to_json(node).alias("element")).unionAll(edges.select(F.to_json(edge).alias("element")))


def to_cytoscape(vertices: DataFrame, edges: DataFrame, path: str) -> None:
    with open(path, "w", encoding="utf-8") as f:
        f.write('{"elements": [')
        f.writelines(("," if i else "") + r["element"] for i, r in enumerate(cytoscape_elements(vertices, edges).toLocalIterator()))
        f.write("]}")


def _table(head: list[str], rows: list[list]) -> str:
    line = lambda cells: "| " + " | ".join(str(c).replace("|", "\\|") for c in cells) + " |"
    return "\n".join([line(head), line(["---"] * len(head)), *map(line, rows)])


def model_card(entities: list[dict], relations: list[dict], metrics: dict, statistics: dict, config: EngineConfig | None = None) -> str:
    """Markdown with tables of entities, relationships, metrics and graph statistics."""
    parts = [
        f"# Model card\n\nVersion {(config or EngineConfig()).version}",
        "## Entities\n\n" + _table(["name", "type", "columns", "confidence"], [[e["name"], e["type"], len(e["columns"]), e["confidence"]] for e in entities]),
        "## Relationships\n\n" + _table(["source", "relationship", "target", "cardinality", "confidence"], [[r["source"], r["name"], r["target"], r["cardinality"], r["confidence"]] for r in relations]),
        "## Metrics\n\n" + _table(["metric", "value"], [[k, f"{v:.4f}"] for k, v in metrics.items()]),
        "## Graph\n\n" + _table(["statistic", "value"], [[k, v] for k, v in statistics.items()]),
    ]
    return "\n\n".join(parts) + "\n"


def write_model_card(path: str, *args, **kw) -> None:
    Path(path).write_text(model_card(*args, **kw), encoding="utf-8")
