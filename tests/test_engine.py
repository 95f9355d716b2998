"""The engine from a made-up table to a report, and its exports."""

import json
from xml.etree import ElementTree as ET

import pytest

from ferrograph.config import EngineConfig, Network, Training
from ferrograph.errors import ConfigError, DataError
from ferrograph.plans import charts, engine
from ferrograph.sources import readers, writers


@pytest.fixture(scope="module")
def result(spark):
    df = readers.synthetic_erp(spark, 200)
    config = EngineConfig(training=Training(epochs=4), network=Network(hidden=16, out=8, heads=2))
    return engine.run(df, config=config)


def test_entities_cover_all_columns(result):
    columns = [c for e in result.entities for c in e["columns"]]
    assert sorted(columns) == sorted(set(columns)) and len(columns) >= 20
    assert len({e["name"] for e in result.entities}) == len(result.entities)
    named = " ".join(e["name"].lower() for e in result.entities)
    assert sum(w in named for w in ("customer", "order", "product", "invoice", "payment", "employee")) >= 4


def test_relations(result):
    pairs = [frozenset((r["source"], r["target"])) for r in result.relations]
    assert len(pairs) == len(set(pairs))
    assert all(0.15 <= r["confidence"] <= 1 for r in result.relations)


def test_graph_and_report(result):
    ids = {r["id"] for r in result.vertices.collect()}
    ends = {x for r in result.edges.collect() for x in (r["src"], r["dst"])}
    assert ends <= ids and len(ids) > 50
    r = result.report
    assert set(r) == {"most_influential_nodes", "missing_connections", "anomalous_entities", "community_summary", "workflow_bottlenecks", "graph_health_score"}
    assert 0 <= r["graph_health_score"] <= 1
    assert all(0 <= x["importance"] <= 1 + 1e-9 for x in r["most_influential_nodes"])
    assert set(charts.report_chart(r)) == {"importance", "anomalies", "communities", "health"}


def test_exports(result, spark, tmp_path):
    v, e = result.vertices, result.edges
    writers.to_json(v, e, str(tmp_path / "g.json"), result.entities, result.relations)
    writers.to_graphml(v, e, str(tmp_path / "g.graphml"))
    writers.to_cytoscape(v, e, str(tmp_path / "c.json"))
    writers.write_model_card(str(tmp_path / "m.md"), result.entities, result.relations, {"auc": 0.5}, {"n_nodes": v.count()})
    g = json.loads((tmp_path / "g.json").read_text())
    assert len(g["nodes"]) == v.count() and len(g["edges"]) == e.count()
    assert len([x for x in ET.parse(tmp_path / "g.graphml").iter() if x.tag.endswith("}node")]) == v.count()
    assert len(json.loads((tmp_path / "c.json").read_text())["elements"]) == v.count() + e.count()
    assert "| auc | 0.5000 |" in (tmp_path / "m.md").read_text()
    assert charts.training_chart(result.tracker.table(spark)).count() == len(result.tracker.history("auc"))


def test_config():
    with pytest.raises(ConfigError):
        EngineConfig(training=Training(val=0.6, test=0.5))
    assert EngineConfig().to_dict()["graph"]["instances_per_entity"] == 200


def test_load_errors(spark):
    with pytest.raises(DataError):
        readers.load(spark, "/nowhere/x.csv")
    with pytest.raises(DataError):
        readers.load(spark, "/nowhere/x.sql")


def test_bootstrap_and_logger(spark, caplog):
    import logging

    from ferrograph.errors import ConfigError
    from ferrograph.plans import session

    got, config = session.bootstrap(config=None, spark_sql_session_timeZone="UTC")
    assert got is spark and config.version and got.conf.get("spark.sql.adaptive.skewJoin.enabled") == "true"
    log = session.ContextLogger(run=7).bind(step="load")
    session.set_level("info")
    with caplog.at_level(logging.INFO, logger="ferrograph"):
        log.info("%d rows", 3)
    assert "3 rows [run=7, step=load]" in caplog.text
    with pytest.raises(ConfigError):
        session.set_level("loud")


def test_shared_folder_is_required_off_local_mode():
    from types import SimpleNamespace

    from ferrograph.errors import ConfigError
    from ferrograph.plans import store

    context = SimpleNamespace(master="yarn", getCheckpointDir=lambda: None)
    cluster = SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: d), sparkContext=context)
    with pytest.raises(ConfigError):
        store.shared_dir(cluster)
    context.master = "local[2]"
    assert store.shared_dir(cluster)
