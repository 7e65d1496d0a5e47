import collections
import math

import pytest

import quillspark.function_queries  # noqa: F401  registers its queries
from quillspark.operators import graph
from quillspark.queries import ORACLE_SQL, QUERIES, _supply, _trade


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_twin(name, same):
    same(name)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 10


@pytest.mark.parametrize("name", ["hnsw_recall", "ivf_recall", "ivfpq_recall", "lsh_recall"])
def test_recall(name, spark, sf_dir):
    assert QUERIES[name](spark, sf_dir).first()["recall"] >= 0.9


# -- queries that SQL cannot express, against plain Python ----------------------
@pytest.fixture(scope="module")
def supply(spark, sf_dir):
    return [tuple(r) for r in _supply(spark, sf_dir).collect()]


def test_label_propagation(spark, sf_dir, supply):
    near = collections.defaultdict(set)
    for a, b in supply:
        if a != b:
            near[a].add(b)
            near[b].add(a)
    label = {v: v for v in near}
    for _ in range(5):
        votes = {v: collections.Counter(label[u] for u in near[v]) for v in near}
        label = {v: min(votes[v], key=lambda x: (-votes[v][x], x)) for v in near}
    assert {r["id"]: r["label"] for r in QUERIES["label_propagation"](spark, sf_dir).collect()} == label


def test_eigenvector(spark, sf_dir, supply):
    score = dict.fromkeys({x for e in supply for x in e}, 1.0)
    for _ in range(10):
        new = dict.fromkeys(score, 0.0)
        for a, b in supply:
            new[b] += score[a]
        size = math.sqrt(sum(x * x for x in new.values()))
        score = {v: x / size for v, x in new.items()}
    got = {r["id"]: r["score"] for r in QUERIES["eigenvector"](spark, sf_dir).collect()}
    assert got.keys() == score.keys() and all(abs(got[v] - score[v]) < 1e-9 for v in got)


def test_betweenness(spark, sf_dir):
    edges = {(r["src"], r["dst"]) for r in _trade(spark, sf_dir).collect()}
    ids = {x for e in edges for x in e}
    hops = {(a, b): 0 if a == b else 1 if (a, b) in edges else 10**6 for a in ids for b in ids}
    for k in ids:
        for a in ids:
            for b in ids:
                hops[a, b] = min(hops[a, b], hops[a, k] + hops[k, b])
    ways = {(a, a): 1 for a in ids}
    for d in range(1, len(ids)):
        for a in ids:
            for b in ids:
                if hops[a, b] == d:
                    ways[a, b] = sum(ways[a, v] for v, w in edges if w == b and hops[a, v] == d - 1)
    want = {v: sum(ways[a, v] * ways[v, b] / ways[a, b] for a in ids for b in ids if len({a, b, v}) == 3 and hops[a, b] < 10**6 and hops[a, v] + hops[v, b] == hops[a, b]) for v in ids}
    got = {r["id"]: r["betweenness"] for r in QUERIES["betweenness"](spark, sf_dir).collect()}
    assert all(abs(got[v] - want[v]) < 1e-6 for v in ids)


def test_ring_load(spark, sf_dir, duck):
    got = {r["node"]: r["keys"] for r in QUERIES["ring_load"](spark, sf_dir).collect()}
    assert set(got) <= set("abcd") and sum(got.values()) == duck.execute("select count(*) from part").fetchone()[0]


def test_cache_simulation(spark, sf_dir, duck):
    got = {(r["shard"], r["policy"]): (r["accesses"], r["hits"]) for r in QUERIES["cache_simulation"](spark, sf_dir).collect()}
    trace = collections.defaultdict(list)
    for shard, user in duck.execute("select user_id % 8, user_id from events order by event_id").fetchall():
        trace[shard].append(user)
    for shard, keys in trace.items():
        held, hits = [], 0
        for k in keys:
            hits += k in held
            held = [k, *[x for x in held if x != k]][:8]
        assert got[shard, "lru"] == (len(keys), hits)
        assert all(got[shard, p][0] == len(keys) for p in ("lfu", "clock"))


def test_projections_and_clusters(spark, sf_dir, duck):
    share = [r["share"] for r in QUERIES["pca_variance"](spark, sf_dir).orderBy("components").collect()]
    assert share == sorted(share) and abs(share[-1] - 1) < 1e-9
    n = duck.execute("select count(*) from embeddings").fetchone()[0]
    clusters = QUERIES["kmeans_clusters"](spark, sf_dir).collect()
    assert sum(r["n"] for r in clusters) == n and all(-1 <= r["silhouette"] <= 1 for r in clusters)
    codes = QUERIES["product_codes"](spark, sf_dir).first()
    assert codes["mse"] > 0 and 0 < codes["entropy"] <= 4 and codes["near"] >= 0


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL) - {"hnsw_recall", "ivf_recall", "ivfpq_recall", "lsh_recall", "label_propagation", "eigenvector", "betweenness", "ring_load", "cache_simulation", "pca_variance", "kmeans_clusters", "product_codes"}))
def test_runs(name, spark, sf_dir):
    assert QUERIES[name](spark, sf_dir).count() > 0


# -- no caps ----------------------------------------------------------------------
def test_long_paths(spark):
    path = spark.createDataFrame([(i, i + 1) for i in range(80)], "src long, dst long")
    assert {r["id"]: r["depth"] for r in graph.bfs(path, 0).collect()} == {i: i for i in range(81)}
    deep = spark.createDataFrame([(i, i + 1) for i in range(2000)] + [(0, 1000)], "src long, dst long")
    levels, cyclic = graph.topological_levels(deep)
    assert not cyclic and {r["id"]: r["level"] for r in levels.collect()} == {i: i for i in range(2001)}
    ring = spark.createDataFrame([(0, 1), (1, 2), (2, 1)], "src long, dst long")
    levels, cyclic = graph.topological_levels(ring)
    assert cyclic and [tuple(r) for r in levels.collect()] == [(0, 0)]


def test_levels_by_jobs(spark, monkeypatch):
    monkeypatch.setattr(graph, "SMALL_EDGES", 3)
    e = spark.createDataFrame([(0, 1), (1, 2), (2, 3), (3, 4), (0, 4), (7, 8)], "src long, dst long")
    levels, cyclic = graph.topological_levels(e)
    assert not cyclic and {r["id"]: r["level"] for r in levels.collect()} == {0: 0, 1: 1, 2: 2, 3: 3, 4: 4, 7: 0, 8: 1}
