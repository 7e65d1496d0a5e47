import pytest
from pyspark.sql import functions as F

from quillspark.operators import graph, integrity, relational, search, vectors, versioned
from quillspark.plans import boolean, pattern
from quillspark.streaming import log, windows


def test_join_keeps_duplicates(spark):
    u = spark.createDataFrame([(i, f"u{i}") for i in range(1, 6)], "uid int, name string")
    o = spark.createDataFrame([(k, u_, k * 10) for k, u_ in enumerate((1, 2, 1, 3, 2, 5, 1))], "oid int, uid int, amount int")
    assert {r.rows for r in relational.compare_strategies(o, u, "uid").collect()} == {7}


def test_nested_loops_stay_in_buckets(spark):
    a = spark.createDataFrame([(i % 50 if i % 7 else None, i) for i in range(400)], "k long, x int")
    b = spark.createDataFrame([(i % 60 if i % 9 else None, -i) for i in range(200)], "k long, y int")
    shown = lambda df: sorted(map(str, df.collect()))
    for how in ("inner", "left", "right", "full", "left_semi", "left_anti"):
        one = relational.join(a, b, "k", how, "nested_loop")
        want = a.join(b, "k", how)
        assert one.columns == want.columns and shown(one) == shown(want), how
    c = b.withColumnRenamed("k", "j")
    one = relational.join(a, c, [("k", "j")], strategy="nested_loop")
    assert shown(one) == shown(a.join(c, a.k == c.j))
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoop" not in plan and "xxhash64" in plan


def test_versions(spark):
    v = versioned.Versions(spark.createDataFrame([("a", "1", 1, False), ("a", "2", 3, False), ("b", "x", 2, False)], "k string, v string, seqno long, is_deleted boolean"))
    v = v.delete(spark.createDataFrame([("b", 4)], "k string, seqno long")).put(spark.createDataFrame([("c", "z", 5)], "k string, v string, seqno long"))
    assert [tuple(r) for r in v.latest().orderBy("k").collect()] == [("a", "2", 3), ("c", "z", 5)]
    assert [r.k for r in v.latest(2).orderBy("k").collect()] == ["a", "b"]
    assert [r.v for r in v.get("a", 2).collect()] == ["1"]
    assert [r.k for r in v.scan("a", "c", low_open=True).collect()] == ["c"]
    assert v.gc(3).count() == 4
    empty = versioned.Versions(v.df.where("false"))
    assert empty.latest().count() == 0


def test_boolean_queries(spark):
    docs = spark.createDataFrame([(1, "apple banana"), (2, "apple orange kiwi"), (3, "kiwi"), (4, None)], "doc_id int, text string")
    post = search.postings(search.token_rows(docs))

    def ask(q):
        return sorted(r.doc_id for r in boolean.evaluate(boolean.parse(q), post, docs.select("doc_id")).collect())

    assert ask("apple AND orange") == [2] and ask("apple OR kiwi") == [1, 2, 3] and ask("apple NOT banana") == [2]
    assert ask("NOT apple") == [3, 4] and ask("ki*") == [2, 3] and ask('"orange kiwi"') == [2] and ask("(apple OR kiwi) AND NOT orange") == [1, 3]
    for bad in ("", "AND", "(a", "a)", "a OR"):
        with pytest.raises(ValueError):
            boolean.parse(bad)


def test_metrics(spark):
    r = spark.createDataFrame([("q", i, x) for i, x in enumerate((1, 0, 1, 0, 1), 1)], "q string, rank int, rel int")
    m = search.ir_metrics(r, ["q"], 3).first()
    assert m.precision == pytest.approx(2 / 3) and m.recall == pytest.approx(2 / 3) and m.rr == 1
    assert search.ir_metrics(r.where("rel = 0"), ["q"], 3).first().ap == 0
    c = spark.createDataFrame([(1, 0.9), (2, 0.8), (3, 0.1)], "doc_id int, score double")
    s = spark.createDataFrame([(1, 2, 1.0)], "a int, b int, sim double")
    assert [x.doc_id for x in search.mmr(c, s, 3, 0.5).orderBy("place").collect()] == [1, 3, 2]


EDGES = [(1, 2), (1, 3), (2, 4), (3, 4), (4, 5), (5, 6), (6, 7), (7, 8), (8, 1)]


def test_graph(spark):
    e = spark.createDataFrame(EDGES, "src long, dst long")
    assert {tuple(r) for r in graph.bfs(e, 1).collect()} >= {(4, 2), (8, 6)}
    assert graph.spanning_forest(e).count() == 7
    assert graph.components(e).select("component").distinct().count() == 1
    assert graph.topological_levels(e)[1] is True
    assert sum(r["rank"] for r in graph.pagerank(e, 20).collect()) == pytest.approx(1)
    assert graph.simple_paths(e, 1, 4, 3).count() == 2
    two = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4)], "src long, dst long")
    assert {tuple(r) for r in graph.strong_components(two).collect()} == {(1, 1), (2, 1), (3, 1), (4, 4)}
    color = graph.coloring(e)
    assert all(color[a] != color[b] for a, b in EDGES)
    assert graph.depth_first(e, 1)[:3] == [1, 2, 4]
    assert graph.max_flow(e.withColumn("cap", F.lit(1)), 1, 4, "cap") == 2
    star = spark.createDataFrame([(1, i) for i in range(2, 7)] + [(i, 1) for i in range(2, 7)], "src long, dst long")
    b = {r.id: r.betweenness for r in graph.betweenness(star).collect()}
    assert b[1] == 20 and b[2] == 0
    assert graph.path_statistics(e).first().diameter == 7
    none = spark.createDataFrame([], "src long, dst long")
    assert graph.components(none).count() == 0 and graph.triangles(none).count() == 0


def test_patterns(spark):
    n = spark.createDataFrame([(1, ["Person"], {"name": "a"}), (2, ["Person"], {}), (3, ["Person", "Admin"], {})], "id long, labels array<string>, props map<string,string>")
    e = spark.createDataFrame([(10, 1, 2, "KNOWS"), (11, 1, 3, "KNOWS"), (12, 2, 3, "LIKES")], "id long, src long, dst long, type string")
    assert pattern.match("(a:Person)-[:KNOWS]->(b)", n, e).count() == 2
    assert pattern.match("(a)-[:KNOWS]->(b:Admin)", n, e).count() == 1
    assert pattern.match("(b:Admin)<-[]-(a)", n, e).count() == 2
    assert pattern.match('(a {name: "a"})', n, e).count() == 1
    assert pattern.match("(a)-[]->(b)-[]->(c)", n, e).count() == 1


def test_windows(spark):
    e = spark.createDataFrame([(f"2024-01-01 00:00:{s:02d}", "k", float(s)) for s in (1, 5, 9, 30)], "ts string, key string, v double").withColumn("ts", F.col("ts").cast("timestamp"))
    assert windows.windowed(e, windows.WindowSpec("session", 10), "ts", "v", ["key"], ["count"]).count() == 2
    hop = windows.windowed(e, windows.WindowSpec("hopping", 10, 5), "ts", "v", [], ["count", "sum"])
    assert hop.agg(F.sum("count")).first()[0] == 8
    for bad in (("tumbling", 0), ("hopping", 5, 7), ("round", 5)):
        with pytest.raises(ValueError):
            windows.WindowSpec(*bad)


def test_appended_rows_stay_out_of_the_driver(spark, tmp_path):
    e = spark.createDataFrame([(f"2024-01-0{d} 00:00:0{s}", k, 1.0) for d in (1, 2, 9) for s in (1, 5) for k in "ab"], "ts string, key string, v double").withColumn("ts", F.col("ts").cast("timestamp"))
    e.write.parquet(str(tmp_path / "in"))
    e.limit(0).write.parquet(str(tmp_path / "none"))
    spec = windows.WindowSpec("session", 10, grace_s=60)
    for folder, rows in (("in", 4), ("none", 0)):
        stream = windows.stream_windowed(spark.readStream.schema(e.schema).parquet(str(tmp_path / folder)), spec, "ts", "v", ["key"], ["count"])
        out = windows.run_available(stream, f"appended_{folder}", str(tmp_path / f"state_{folder}"))
        assert out.columns == ["start", "end", "key", "count"] and [r["count"] for r in out.collect()] == [2] * rows
        assert "parquet" in out._jdf.queryExecution().executedPlan().toString().lower()
    (tmp_path / "nothing").mkdir()
    stream = windows.stream_windowed(spark.readStream.schema(e.schema).parquet(str(tmp_path / "nothing")), spec, "ts", "v", ["key"], ["count"])
    assert windows.run_available(stream, "appended_nothing", str(tmp_path / "state_nothing")).count() == 0


def test_log(spark):
    recs = [("t", 0, i, f"k{i % 100}", "v") for i in range(150)] + [("t", 0, 150, None, "v"), ("t", 0, 151, "k1", None)]
    df = spark.createDataFrame(recs, "topic string, partition int, offset long, key string, value string")
    assert log.compacted(df, "key", "offset").count() == 101
    assert log.tombstones(df, "key", "value").first()[0] == 1
    votes = spark.createDataFrame([(1, 2, 1), (2, 1, 1), (2, 2, 2)], "voter int, candidate int, cast_seq int")
    assert log.elect(votes).first().candidate == 1


def test_integrity(spark):
    df = spark.createDataFrame([(i, f"d{i}") for i in range(7)], "k int, d string")
    tree = integrity.levels(integrity.leaves(df, "k", "d"))
    root = tree[-1].first().h
    for i in (0, 3, 6):
        assert integrity.verify(tree[0].where(F.col("i") == i).first().h, integrity.proof(tree, i), root)
    other = df.withColumn("d", F.when(F.col("k") == 4, "x").otherwise(F.col("d")))
    assert [r.i for r in integrity.differing(tree[0], integrity.leaves(other, "k", "d")).collect()] == [4]
    assert integrity._lru([1, 2, 1, 3, 1], 2) == 2 and integrity._clock([1, 1, 2, 1], 2) == 2


def test_vectors(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    z = vectors.standardized(e.select("vec_id", "embedding"))
    assert abs(vectors.mean_vector(z).agg(F.max(F.abs(F.col("mean")))).first()[0]) < 1e-6
    assert vectors.paired_t([1, 2, 3], [1, 2, 3]) == (0.0, 1.0)
    assert vectors.IndexConfig.for_size(5_000_000, 64).kind == "ivfpq"
    m = vectors.random_projection(64, 32)
    assert len(vectors.project(e, m).first()["projected"]) == 32


def test_probes_send_k_rows_a_task(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    x = np.round(rng.standard_normal((600, 8)), 1)
    x[300:340] = x[0]  # equal vectors: the smaller ids stay
    rows = spark.createDataFrame([(i, [float(v) for v in x[i]]) for i in rng.permutation(600).tolist()], "vec_id long, embedding array<float>").repartition(3)
    q = rows.where("vec_id % 100 = 0")
    x = x.astype(np.float32).astype(float)
    got = {(r.query_id, r["rank"]): (r.vec_id, round(r.distance, 6)) for r in vectors.knn_join(rows, q, 10).collect()}
    ivf = vectors.IVF(lists=6, probes=2).fit(rows)
    probed = {(r.query_id, r["rank"]): r.vec_id for r in ivf.search(ivf.build(rows), q, 10).collect()}
    own = vectors._distances(x, ivf.centres, "sq_l2").argmin(1)
    for i in range(0, 600, 100):
        d = np.sqrt(((x - x[i]) ** 2).sum(1))
        order = sorted(range(600), key=lambda j: (round(d[j], 9), j))
        assert [got[i, k + 1] for k in range(10)] == [(j, round(d[j], 6)) for j in order[:10]]
        near = np.argsort(vectors._distances(x[i : i + 1], ivf.centres, "sq_l2")[0])[:2]
        assert [probed[i, k + 1] for k in range(10)] == [j for j in order if own[j] in near][:10]
    coded = vectors.IVF(lists=6, probes=2, parts=4, codes=8).fit(rows)
    plan = coded.search(coded.build(rows), q, 10)._jdf.queryExecution().optimizedPlan().toString()
    sent = plan.split("MapInPandas")[1].split("\n")[0]
    assert "Join" not in plan and "vec_id" in sent and plan.count("MapInPandas") == 2  # no vectors and no pairs are shuffled
