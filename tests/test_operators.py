"""Algorithms against small brute-force versions, and properties."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ferrograph.config import EngineConfig, Network, Training
from ferrograph.errors import ConfigError, GraphError, TrainingError
from ferrograph.functions.autograd import Tensor
from ferrograph.operators import clean, entities, graph, insight, keys, network, profile
from ferrograph.streaming import events as stream

E = [("a", "b", 1.0), ("b", "c", 1.0), ("c", "a", 1.0), ("r", "a", 1.0), ("c", "d", 2.0), ("x", "y", 1.0), ("d", "e", 1.0)]


@pytest.fixture(scope="module")
def small(spark):
    e = spark.createDataFrame(E, "src string, dst string, weight double")
    v = spark.createDataFrame([(x,) for x in sorted({n for s, d, _ in E for n in (s, d)} | {"alone"})], "id string")
    return v, e


def test_pagerank_sums_to_one(small):
    ranks = {r["id"]: r["rank"] for r in graph.pagerank(*small).collect()}
    assert abs(sum(ranks.values()) - 1) < 1e-6 and ranks["a"] > ranks["r"]


def test_hierarchy_ends_on_cycles(small):
    level = {r["id"]: r["level"] for r in graph.hierarchy(*small, bound=5).collect()}
    assert level["r"] == 0 and level["alone"] == 0 and level["y"] == 1 and max(level.values()) <= 5


def test_components_and_diameter(small):
    comp = {r["id"]: r["component"] for r in graph.components(*small).collect()}
    assert comp["e"] == "a" and comp["y"] == "x" and comp["alone"] == "alone" and comp["r"] == "a"
    assert graph.diameter(*small) == 4
    assert graph.statistics(*small)["n_components"] == 3


def shortest(v, e):
    """Brute-force betweenness on unit weights: all shortest paths of all pairs."""
    near = {x: sorted({d for s, d in e if s == x}) for x in v}
    score = dict.fromkeys(v, 0.0)
    for s in v:
        paths = {s: [[s]]}
        front, seen = [s], {s}
        while front:
            new = {}
            for u in front:
                for w in near[u]:
                    if w not in seen:
                        new.setdefault(w, []).extend([*p, w] for p in paths[u])
            paths |= new
            front = list(new)
            seen |= set(new)
        for d, ps in paths.items():
            for p in ps:
                for w in p[1:-1]:
                    score[w] += 1 / len(ps)
    n = len(v)
    return {x: y / ((n - 1) * (n - 2)) for x, y in score.items()}


def test_betweenness(small):
    v, e = small
    got = {r["id"]: r["betweenness"] for r in graph.betweenness(v, e, weighted=False).collect()}
    want = shortest([r["id"] for r in v.collect()], [(s, d) for s, d, _ in E])
    assert got == pytest.approx(want)
    some = graph.betweenness(v, e, pivots=3, seed=1).collect()
    assert len(some) == len(want)


def test_louvain_finds_cliques(spark):
    rows = [(f"{g}{i}", f"{g}{j}", 1.0) for g in "abc" for i in range(5) for j in range(i)] + [("a0", "b0", 1.0), ("b1", "c1", 1.0)]
    e = spark.createDataFrame(rows, "src string, dst string, weight double")
    v = e.select(F.col("src").alias("id")).union(e.select("dst")).distinct()
    found = graph.louvain(v, e)
    assert len(set(found.values())) == 3 and all(found[f"{g}0"] == found[f"{g}4"] for g in "abc")
    ids, src, dst, w = graph.adjacency(v, e)
    assert graph.modularity(len(ids), src, dst, w, np.array([found[i] for i in ids])) > 0.5
    label = {r["id"]: r["community"] for r in graph.label_propagation(v, e).collect()}
    assert label["a1"] == label["a4"]


def test_levels_of_a_long_cycle_are_bounded(spark, caplog):
    n = 200
    e = spark.createDataFrame([(i, (i + 1) % n) for i in range(n)] + [(-1, 0)], "src long, dst long")
    v = e.select(F.col("src").alias("id")).union(e.select("dst")).distinct()
    got = {r.id: r.level for r in graph.hierarchy(v, e, bound=6).collect()}
    assert max(got.values()) == 6 and got[4] == 5 and "cycle" in caplog.text


def test_ward_by_hand():
    x = np.array([[0.0], [0.1], [5.0], [5.2], [20.0]])
    a = entities.ward(x, 1.5)
    assert a[0] == a[1] and a[2] == a[3] and len(set(a)) == 3


def test_entity_rules():
    assert entities.entity_name(["customer_id", "customer_name"]) == "Customer"
    assert entities.entity_name(["id_x", "data_y", "id_q"]) == "X"
    assert entities.entity_type(["order_total", "order_price"]) == "transaction"
    assert entities.entity_type(["foo"]) == "business_object"
    types = {"a_id": "categorical", "b_id": "categorical", "a_x": "numeric"}
    assert entities.split_by_values([["a_id", "b_id", "a_x"]], types, {}) == [["a_id", "a_x"], ["b_id"]]
    assert entities.merge_by_names([["a"], ["b"], ["c"]], {("a", "b"): 0.6}, 0.5) == [["a", "b"], ["c"]]


def test_fk_threshold(spark):
    rows = [(f"k{i}", f"k{i}" if i < 6 else f"z{i}", f"k{i % 5}") for i in range(10)]
    df = spark.createDataFrame(rows, "p string, q string, c string")
    found = {(r.child_col, r.parent_col): r.overlap for r in keys.fk_pairs(keys.value_sets(df, ["p", "q", "c"])).collect()}
    assert found == {("c", "p"): 1.0, ("c", "q"): 1.0}
    j = {(r.col_a, r.col_b): r.jaccard for r in keys.jaccard_overlap(keys.value_sets(df, ["p", "q", "c"])).collect()}
    assert j["p", "q"] == pytest.approx(6 / 14)


def test_profile_edges(spark):
    df = spark.createDataFrame([(1, float("nan"), None), (2, 1.0, None), (3, 1.0, None)], "k long, x double, nothing string")
    r = {x["column"]: x for x in profile.column_profile(df, ["k"]).collect()}
    assert r["x"]["n_missing"] == 1 and r["nothing"]["n_distinct"] == 0 and r["nothing"]["semantic_type"] == "boolean"
    assert r["x"]["entropy"] == 0 and r["k"]["top1"] == pytest.approx(1 / 3)
    assert clean.columns_to_drop(df) == ["x", "nothing"] or set(clean.columns_to_drop(df)) == {"x", "nothing"}
    assert "to drop" in profile.quality_summary(profile.column_profile(df, ["k"]))


def test_exact_median_by_brackets(spark):
    rng = np.random.default_rng(4)
    cases = {
        "even": list(rng.normal(size=400)),
        "odd": list(rng.normal(size=401)),
        "ties": [1.0] * 150 + [2.0] * 100 + list(rng.random(151)),
        "hot": [5.0] * 390 + [1.0, 9.0],
        "halves": [0.0] * 200 + [1.0] * 200,
    }
    for name, x in cases.items():
        df = spark.createDataFrame([(float(v),) for v in [*x, float("nan")]] + [(None,)], "x double").repartition(3)
        for most in (1, 10, 1000):
            assert clean.medians(df, ["x"], most) == {"x": pytest.approx(np.median(x))}, (name, most)
    empty = spark.createDataFrame([(None, 1.0)], "x double, y double")
    assert clean.medians(empty, ["x", "y"]) == {"x": None, "y": 1.0}
    assert [r.x for r in clean.fill_median(empty, ["x"]).collect()] == [None]


def test_fill_along_takes_linear_time(spark):
    df = spark.range(300_000).select(F.col("id").alias("k"), F.lit(None).cast("double").alias("x"))
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        assert clean.fill_along(df, ["x"], "k").filter("x is null").count() == 300_000
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_fill_along_without_order(spark):
    df = spark.createDataFrame([(None, 7.0), (3, None), (5, None), (9, 2.0)], "k long, x double")
    assert sorted((r.k or -1, r.x) for r in clean.fill_along(df, ["x"], "k").collect()) == [(-1, 7.0), (3, 7.0), (5, 7.0), (9, 2.0)]


def test_fill_along_crosses_ranges(spark):
    df = spark.createDataFrame([(i, float(i) if i in (3, 700) else None) for i in range(1000)], "k long, x double").repartition(5)
    got = [r.x for r in clean.fill_along(df, ["x"], "k").orderBy("k").collect()]
    assert got == [3.0] * 700 + [700.0] * 300


def test_gradients():
    rng = np.random.default_rng(0)
    src, dst = np.array([0, 1, 2, 3, 0]), np.array([1, 2, 3, 4, 4])
    x = rng.normal(size=(5, 4))
    for name in network.ARCHITECTURES:
        net = network.create(4, Network(architecture=name, hidden=6, out=3, heads=2, layers=2, latent=3, dropout=0.0))
        e = network.Edges(5, src, dst)
        goal = rng.normal(size=(5, 3))
        loss = lambda: ((net(x, e) - goal) * (net(x, e) - goal)).sum()  # noqa: B023, E731
        out = loss()
        out.backward()
        for k in list(net.p)[:3]:
            p = net.p[k]
            at = tuple(0 for _ in p.shape)
            grad, keep = p.grad[at], p.data[at]
            p.data[at] = keep + 1e-6
            up = float(loss().data)
            p.data[at] = keep - 1e-6
            down = float(loss().data)
            p.data[at] = keep
            assert grad == pytest.approx((up - down) / 2e-6, rel=1e-3, abs=1e-5), (name, k)


@pytest.mark.parametrize("name", list(network.ARCHITECTURES))
def test_training(name, tmp_path):
    rng = np.random.default_rng(3)
    n = 40
    group = np.arange(n) % 2
    pairs = np.array([(i, j) for i in range(n) for j in range(i) if group[i] == group[j] and rng.random() < 0.4])
    x = np.eye(2)[group] + rng.normal(0, 0.3, (n, 2))
    config = EngineConfig(network=Network(architecture=name, hidden=8, out=4, heads=2, layers=2, dropout=0.0, latent=4), training=Training(epochs=25, rate=0.03, warmup=2))
    t = network.Trainer(x, pairs[:, 0], pairs[:, 1], config)
    tracker = t.train(str(tmp_path))
    assert tracker.best("auc")[1] > 0.6
    assert tracker.history("loss")[-1][1] < tracker.history("loss")[0][1]
    again = network.Trainer(x, pairs[:, 0], pairs[:, 1], config)
    network.load(again.params(), tmp_path / "best.npz")
    assert np.allclose(again.embeddings(), t.embeddings())


@pytest.mark.parametrize("name", ["GCN", "GraphSAGE"])
def test_training_on_sampled_neighbours(name):
    rng = np.random.default_rng(5)
    n = 60
    group = np.arange(n) % 2
    pairs = np.array([(i, j) for i in range(n) for j in range(i) if group[i] == group[j] and rng.random() < 0.4])
    x = np.eye(2)[group] + rng.normal(0, 0.3, (n, 2))
    config = EngineConfig(network=Network(architecture=name, hidden=8, out=4, layers=2, dropout=0.0), training=Training(epochs=6, rate=0.02, warmup=1, batch=32, neighbours=(4, 2)))
    t = network.Trainer(x, pairs[:, 0], pairs[:, 1], config)
    nodes, edges = t.subgraph(np.array([3, 3, 7]))
    known = {tuple(sorted(p)) for p in t.train_pairs.tolist()}
    assert {3, 7} <= set(nodes.tolist()) and len(set(nodes.tolist())) == len(nodes)
    assert all(tuple(sorted((nodes[a], nodes[b]))) in known for a, b in zip(edges.src, edges.dst))
    assert np.bincount(edges.dst, minlength=len(nodes)).sum() <= 2 * (2 * 4 + 8 * 2)
    assert t.train().best("auc")[1] > 0.6 and t.steps == 6 * -(-len(t.train_pairs) // 32)


def test_network_errors():
    with pytest.raises(ConfigError):
        network.create(3, Network(architecture="other"))
    with pytest.raises(TrainingError):
        network.Trainer(np.zeros((2, 2)), np.array([0]), np.array([1]))


def test_multitask_and_metrics():
    m = network.MultiTask(4, 3, 2, 5)
    out = m(Tensor(np.ones((6, 4))))
    loss = m.loss(out, np.zeros(6, int), np.zeros((6, 5)))
    loss.backward()
    assert np.isfinite(loss.data) and np.abs(m.p["class"].grad).sum() > 0 and out["anomaly"].data.max() < 1
    assert network.auc(np.array([3.0, 2, 1]), np.array([1, 1, 0])) == 1 and network.auc(np.array([1.0, 1]), np.array([1, 0])) == 0.5
    assert network.average_precision(np.array([3.0, 2, 1]), np.array([1, 0, 1])) == pytest.approx((1 + 2 / 3) / 2)
    assert network.silhouette(np.array([[0.0], [0.1], [9.0], [9.1]]), np.array([0, 0, 1, 1])) > 0.9


def test_links_leave_out_edges(spark):
    v = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(5)], "id long, embedding array<double>")
    e = spark.createDataFrame([(0, 1), (3, 2)], "src long, dst long")
    got = {(r.src, r.dst) for r in insight.link_candidates(v, e).collect()}
    assert (0, 1) not in got and (2, 3) in got
    assert insight.explain(v, e, 0, k=2)["neighbours"] == [1]


def test_stream_equals_batch(spark, tmp_path):
    df = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    df.write.parquet(str(tmp_path / "in"))
    q = stream.profile_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination(60)
    got = spark.read.schema("hour timestamp, event_type string, n long").parquet(str(tmp_path / "out"))
    want = {(r.hour, r.event_type): r.n for r in stream.hourly(df).collect()}
    rows = got.collect()
    assert rows and all(want[r.hour, r.event_type] == r.n for r in rows)


def test_without_llm():
    import __spark_entry__ as entry

    assert {"column_profile", "components"} <= set(entry.queries())


def test_layouts_and_samples(spark, small):
    v, e = small
    far = graph.kamada_kawai_layout(v, e)
    d = lambda a, b: np.hypot(far[a][0] - far[b][0], far[a][1] - far[b][1])
    assert d("a", "b") < d("r", "e") and len(graph.spring_layout(v, e, rounds=5)) == v.count()
    one = graph.sample_neighbours(e, v.filter("id = 'a'"), (2, 1)).collect()
    assert sum(r.hop == 1 for r in one) == 2 and all(r.src == "a" for r in one if r.hop == 1)
    assert [r.id for r in graph.sample_neighbours(e, v, (1,)).select("src").distinct().withColumnRenamed("src", "id").collect()]


def test_registry(tmp_path):
    reg = network.Registry(str(tmp_path))
    p = {"w": Tensor(np.ones(3))}
    reg.put("m", p, auc=0.5)
    p["w"].data += 1
    reg.put("m", p, auc=0.7)
    assert reg.get("m", p, 1)["auc"] == 0.5 and p["w"].data.tolist() == [1, 1, 1]
    assert reg.get("m", p)["number"] == 2
    with pytest.raises(TrainingError):
        reg.get("other", p)


def test_accumulated_steps():
    x = np.eye(6)
    pairs = np.array([(i, j) for i in range(6) for j in range(i)])
    t = network.Trainer(x, pairs[:, 0], pairs[:, 1], EngineConfig(network=Network(hidden=4, out=2, layers=2), training=Training(epochs=4, accumulate=2)))
    assert len(t.train().history("loss")) == 4


def test_schema_summary(spark):
    df = spark.createDataFrame([(i, f"o{i}", f"c{i % 3}", f"c{i}") for i in range(60)], "k long, order_id string, a_id string, b_id string")
    types = profile.semantic_types(df, ["k"])
    pairs = keys.fk_pairs(keys.value_sets(df, keys.pair_columns({r["column"]: r["semantic_type"] for r in types.collect()})))
    text = profile.schema_summary(types, keys.primary_keys(df, ["k"]), pairs)
    assert "a_id -> b_id (1.00)" in text and "key: b_id" in text


def test_whole_graph_against_brute_force(spark):
    """All customers, orders, nations and suppliers are in the graph of the queries."""
    from collections import Counter

    from ferrograph import catalog
    from tests.conftest import DATA

    read = lambda name, *cols: [tuple(r) for r in spark.read.parquet(f"{DATA}/{name}.parquet").select(*cols).collect()]
    nations = read("nation", "n_nationkey", "n_regionkey")
    e = [(f"c{c}", f"n{n}", 1.0) for c, n in read("customer", "c_custkey", "c_nationkey")] + [(f"n{n}", f"r{r}", 0.5) for n, r in nations]
    e += [(f"c{c}", f"p{p[0]}", float(k)) for (c, p), k in Counter(read("orders", "o_custkey", "o_orderpriority")).items()]
    e += [(f"r{r}", f"p{r + 1}", 0.25) for r in {r for _, r in nations}]
    v = {x for a, b, _ in e for x in (a, b)} | {f"s{s}" for s, in read("supplier", "s_suppkey")}
    q = catalog.queries()
    ran = lambda name: [tuple(r) for r in q[name](spark, DATA).collect()]
    ends = Counter(x for a, b, _ in e for x in (a, b))
    assert {r[0]: r[-1] for r in ran("degree")} == {x: ends[x] for x in v}
    assert sorted(ran("weak_prune")) == sorted(x for x in e if x[2] >= 0.4)
    root = {x: x for x in v}
    for _ in v:
        for a, b, _ in e:
            root[a] = root[b] = min(root[a], root[b])
    assert dict(ran("components")) == root
    near = {x: {b for a, b, _ in e if a == x} | {a for a, b, _ in e if b == x} for x in v}
    assert {r[0]: r[1] for r in ran("triangles")} == {x: sum(len(near[x] & near[y]) for y in near[x]) // 2 for x in v}
    best = {}
    for a, b, w in e:
        if b[0] == "p":
            best[a, b] = max(w, best.get((a, b), 0))
    assert {(r[0], f"p{i}"): r[i] for r in ran("relationship_matrix") for i in range(1, 6) if r[i]} == best
    assert {r[0] for r in ran("louvain")} == {r[0] for r in ran("label_communities")} == v


def test_links_of_all_vectors(spark):
    """Pairs of all embeddings, whatever the blocks, and not of the first sixty."""
    from ferrograph import catalog
    from tests.conftest import DATA

    rows = sorted(tuple(r) for r in catalog.vectors(spark, DATA).select("id", "embedding").collect())
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    p = 1 / (1 + np.exp(-(x @ x.T)))
    linked = {tuple(r) for r in catalog.ring(spark, DATA).collect()}
    every = ((ids[i], ids[j], p[i, j]) for i in range(len(ids)) for j in range(i + 1, len(ids)) if (ids[i], ids[j]) not in linked)
    want = sorted(every, key=lambda r: -r[2])[:20]
    assert max(r[1] for r in want) >= 60
    near = lambda got: np.allclose(sorted(r[2] for r in got), sorted(r[2] for r in want), atol=1e-5) and {tuple(r[:2]) for r in got} == {r[:2] for r in want}
    assert near(catalog.queries()["link_candidates"](spark, DATA).collect())
    v = catalog.vectors(spark, DATA).select("id", "embedding")
    assert near(insight.link_candidates(v, catalog.ring(spark, DATA), block=70).collect())


def test_statistics_of_a_graph_beyond_memory(spark, small, monkeypatch):
    """Only a largest component of under 500 vertices comes to the driver, so the bound holds for that one."""
    monkeypatch.setattr(graph, "IN_MEMORY", 8)
    v, e = small
    assert graph.statistics(v, e)["diameter"] == 4
    more = e.unionByName(spark.range(600).selectExpr("concat('s', id) src", "'hub' dst", "1.0D weight"))
    every = v.union(more.select("src")).union(more.select("dst")).distinct()
    row = graph.statistics(every, more)
    assert (row["diameter"], row["n_components"], row["n_edges"]) == (-1, 4, len(E) + 600)
    assert graph.diameter(v, e.union(spark.createDataFrame([("x", "else", 1.0), ("else", "e", 1.0)], e.schema))) == 4  # no way over a stranger


def test_betweenness_holds_only_what_paths_lead_through(spark, small, monkeypatch):
    """Sources without edges into them bring their own edges, so they don't count against the bound."""
    monkeypatch.setattr(graph, "IN_MEMORY", 8)
    v, e = small
    rows = [(f"s{i}", x, 1.0) for i in range(12) for x in ("a", "d", "end")[: 1 + i % 3]] + [("d", "end", 1.0)]
    e = e.union(spark.createDataFrame(rows, e.schema))
    v = v.union(e.select("src")).union(e.select("dst")).distinct()
    got = {r["id"]: r["betweenness"] for r in graph.betweenness(v, e, weighted=False).collect()}
    assert got == pytest.approx(shortest([r["id"] for r in v.collect()], [(r.src, r.dst) for r in e.collect()]))
    assert len(graph.betweenness(v, e, pivots=3).collect()) == len(got)
    with pytest.raises(GraphError):  # all of a ring leads through
        ring = spark.range(9).selectExpr("id src", "(id + 1) % 9 dst", "1.0D weight")
        graph.betweenness(spark.range(9), ring).collect()


def test_louvain_beyond_memory(spark, monkeypatch):
    """Rounds over tables and then moves in turn find communities as good as moves in turn alone, and leave out no vertex."""
    rng = np.random.default_rng(3)
    rows = {(int(a), int(b)) for a, b in rng.integers(0, 12, (400, 2)) * 8 + rng.integers(0, 8, (400, 2)) if a // 8 == b // 8}
    rows |= {(8 * g + i, 8 * g + (i + 1) % 8) for g in range(12) for i in range(8)} | {(8 * g, (8 * g + 8) % 96) for g in range(12)} | {(3, 3)}
    e = spark.createDataFrame([(a, b, 1.0) for a, b in sorted(rows)], "src long, dst long, weight double")
    v = spark.range(97)  # the last is alone
    ids, src, dst, w = graph.adjacency(v, e)
    want = graph.louvain(v, e)
    monkeypatch.setattr(graph, "IN_MEMORY", 100)
    monkeypatch.setattr(graph, "IN_DICTS", 100)
    got = graph.louvain(v, e)
    assert set(got) == set(range(97)) and set(got.values()) == set(range(len(set(got.values()))))
    value = lambda found: graph.modularity(97, src, dst, w, np.array([found[i] for i in ids]))
    assert value(got) > value(want) - 0.02 and got[96] not in [got[i] for i in range(96)]


def test_links_of_many_vectors_in_time(spark):
    """Copies, ties, odd vectors and repeated ids give what a comparison of all pairs gives; 12,000 vectors are done in seconds."""
    import time

    rng = np.random.default_rng(8)
    x = rng.normal(size=(60, 3)).round(1).tolist()
    x[3], x[4], x[5], x[6:12] = None, [0.0] * 3, [1.0, 2.0], [x[0]] * 6
    ids = [i if i != 20 else 19 for i in range(60)]
    v = spark.createDataFrame(list(zip(ids, x)), "id long, embedding array<double>")
    linked = {(0, 6), (0, 7), (7, 8), (9, 6)}
    e = spark.createDataFrame(sorted(linked), "src long, dst long")

    def p(a, b):
        if not a or not b or len(a) != len(b) or not any(a) or not any(b):
            return 0.5
        dot = lambda a, b: sum(s * t for s, t in zip(a, b))
        return 1 / (1 + np.exp(-dot(a, b) / (dot(a, a) ** 0.5 * dot(b, b) ** 0.5)))

    pairs = [(ids[i], ids[j], p(x[i], x[j])) for i in range(60) for j in range(60) if ids[i] < ids[j] and (ids[i], ids[j]) not in linked]
    want = sorted(((a, b, round(q, 9)) for a, b, q in pairs if q >= 0.5), key=lambda r: (-r[2], r[0], r[1]))
    for most, block in ((12, 7), (12, None), (400, 25)):
        got = [(r.src, r.dst, round(r.probability, 9)) for r in insight.link_candidates(v, e, most=most, block=block).collect()]
        assert sorted(r[2] for r in got) == sorted(r[2] for r in want[:most])
        worst = got[-1][2]
        assert sorted(r for r in got if r[2] > worst) == sorted(r for r in want if r[2] > worst) and set(got) <= set(want)
    many = spark.createDataFrame([(i, y) for i, y in enumerate(rng.normal(size=(12_000, 64)).tolist())], "id long, embedding array<double>")
    began = time.perf_counter()
    assert len(insight.link_candidates(many, e).collect()) == 20 and time.perf_counter() - began < 60


def test_training_holds_no_array_of_edges():
    """On 150,000 edges training takes little more than its edges and layers; gradients are those of the plain operations."""
    import tracemalloc

    rng = np.random.default_rng(4)
    z, pairs, neg = Tensor(rng.normal(size=(9, 4))), rng.integers(0, 9, (20, 2)), rng.integers(0, 9, (15, 2))
    z.link_loss(pairs, neg, chunk=6).backward()
    plain = Tensor(z.data)
    both, label = np.r_[pairs, neg], np.r_[np.ones(20), np.zeros(15)]
    p = network.sigmoid((plain[both[:, 0]] * plain[both[:, 1]]).sum(axis=1))
    (((p + 1e-9).log() * label + (p * -1.0 + (1 + 1e-9)).log() * (1 - label)).mean() * -1.0).backward()
    assert np.allclose(z.grad, plain.grad)
    e, weight = network.Edges(9, pairs[:, 0], pairs[:, 1]), rng.normal(size=(9, 4))
    z.grad = np.zeros((9, 4))
    (z.linear(e.spread).normed() * weight).sum().backward()
    k = np.bincount(e.ldst, minlength=9)
    h = (plain[e.lsrc] * (1 / np.sqrt(k[e.lsrc] * k[e.ldst]))[:, None]).scatter(e.ldst, 9)
    c = h - h.mean(axis=0, keepdims=True)
    plain.grad = np.zeros((9, 4))
    (c * ((c * c).mean(axis=0, keepdims=True) + 1e-5) ** -0.5 * weight).sum().backward()
    assert np.allclose(e.spread(z.data, chunk=4), h.data) and np.allclose(z.grad, plain.grad)
    x = rng.normal(size=(20_000, 4))
    src, dst = rng.integers(0, 20_000, (2, 150_000))
    tracemalloc.start()
    t = network.Trainer(x, src, dst, EngineConfig(network=Network(hidden=16, out=8), training=Training(epochs=1)))
    t.train()
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 130e6


@pytest.mark.parametrize("name", ["GCN", "VGAE"])
def test_training_on_a_graph_beyond_memory(spark, monkeypatch, name):
    """Graphs of more edges than an adjacency may have are trained on whole, with the same numbers if all arrays lie in files."""
    from ferrograph.functions import autograd

    rows = sorted({(f"c{i}", f"p{i * k % 7}") for i in range(60) for k in (1, 2, 3)})
    e = spark.createDataFrame([(a, b, 1.0) for a, b in rows] + [("c1", "c1", 1.0), ("c1", "p1", 1.0), ("c2", "stranger", 1.0)], "src string, dst string, weight double")
    v = spark.createDataFrame([(x,) for x in sorted({x for r in rows for x in r} | {"alone"})], "id string")
    f = v.select("id", F.array((F.substring("id", 1, 1) == "c").cast("double"), F.length("id").cast("double")).alias("features"))
    config = EngineConfig(network=Network(architecture=name, hidden=8, out=4, latent=4), training=Training(epochs=4, rate=0.02))
    monkeypatch.setattr(graph, "IN_MEMORY", 8)
    trainer, places = network.train_graph(v, e, f, config)
    at = {r["id"]: r["place"] for r in places.collect()}
    assert at == {x: i for i, x in enumerate(sorted(at))} and len(trainer.x) == len(at) == v.count()
    assert {(int(a), int(b)) for a, b in zip(*np.divmod(trainer.known, len(at)))} == {(at[a], at[b]) for a, b in rows}
    assert all(trainer.x[at[r["id"]]].tolist() == r["features"] for r in f.collect())
    want = trainer.train().rows
    monkeypatch.setattr(autograd, "HELD", 16)
    again, _ = network.train_graph(v, e, f, config)
    got = again.train().rows
    assert [r[:2] for r in got] == [r[:2] for r in want] and np.allclose([r[2] for r in got], [r[2] for r in want])
    with pytest.raises(GraphError):  # arrays with a row an edge
        network.train_graph(v, e, f, EngineConfig(network=Network(architecture="GAT")))
    with pytest.raises(TrainingError):
        network.train_graph(v, e, f.filter("id <> 'c3'"), config)


def test_spread_over_hubs():
    """Nodes with more edges than are added rank by rank, and chunks smaller than their edges."""
    rng = np.random.default_rng(2)
    src, dst = rng.integers(0, 40, 300), np.r_[rng.integers(0, 40, 200), np.full(100, 7)]
    e, x = network.Edges(42, src, dst), rng.normal(size=(42, 3))
    k = np.bincount(e.ldst, minlength=42)
    want = np.zeros((42, 3))
    np.add.at(want, e.ldst, x[e.lsrc] / np.sqrt(k[e.lsrc] * k[e.ldst])[:, None])
    for chunk, few in ((1 << 17, 64), (30, 5), (4, 0)):
        assert np.allclose(e.spread(x, chunk, few), want)


def test_diameter_of_any_size(spark, monkeypatch):
    """As by breadth-first searches from all vertices, whatever the size: with twins, in memory and over tables, and of the whole query."""
    rng = np.random.default_rng(6)
    path = [(i, i + 1) for i in range(600)]
    leaves = [(1000 + i, 2000 + i % 3) for i in range(590)] + [(2000, 2001), (2001, 2002), (2002, 9)]
    loose = [(int(a), int(b)) for a, b in rng.integers(0, 60, (90, 2))]
    ring = [(i, (i + 1) % 9) for i in range(9)]

    def want(rows):
        near = {}
        for a, b in rows:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
        seen = {s: dict(graph._bfs({k: [(x, 1.0) for x in v] for k, v in near.items()}, s)) for s in near}
        most = max(len(d) for d in seen.values())
        start = min(s for s, d in seen.items() if len(d) == most)
        return max(max(seen[s].values()) for s in seen[start])

    def got(rows):
        e = spark.createDataFrame([(a, b, 1.0) for a, b in rows], "src long, dst long, weight double")
        v = e.select(F.col("src").alias("id")).union(e.select("dst")).distinct()
        return graph.statistics(v, e, most=None)["diameter"]

    assert got(path) == 600 and got(leaves) == want(leaves) == 4
    for rows in (loose, ring, [(1, 2), (4, 4)]):
        assert got(rows) == want(rows)
    monkeypatch.setattr(graph, "IN_MEMORY", 0)
    rows = [(1, 2), (2, 3), (3, 4), (2, 5), (5, 4), (4, 6), (6, 7), (7, 5)]
    e = spark.createDataFrame(rows + [(b, a) for a, b in rows], "src long, dst long")
    assert graph._widest(e) == want(rows) == 4
    assert graph.diameter(spark.range(3), spark.createDataFrame([], "src long, dst long, weight double"), most=None) == -1


def test_statistics_query_equals_sql(spark):
    """Over a component of more than 500 vertices."""
    import duckdb

    from ferrograph import catalog

    d = "/root/testdata/sf0.01"
    con = duckdb.connect()
    for name in ("customer", "orders", "nation", "supplier"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{d}/{name}.parquet'")
    want = dict(con.sql(catalog.oracle_sql()["graph_statistics"]).fetchall())
    row = {r["statistic"]: r["value"] for r in catalog.queries()["graph_statistics"](spark, d).collect()}
    assert row == want and row["diameter"] == 4
