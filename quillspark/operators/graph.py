"""Property-graph algorithms on vertex and edge DataFrames.

Distributed algorithms loop over joins and write each round in the shared folder.  Algorithms whose result depends on
a visiting order, or that are cubic, are marked small: they run on one collected graph and check its size.
"""

from __future__ import annotations

import heapq
import itertools
import math
from collections import defaultdict, deque

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.session import ready, written

#: Edges that a small algorithm may collect.
SMALL_EDGES = 200_000


def vertices(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id"))).distinct()


def degrees(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """id, out_degree, in_degree of all vertices."""
    nodes = nodes if nodes is not None else vertices(edges)
    out = edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("out_degree"))
    into = edges.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("in_degree"))
    return nodes.select("id").join(out, "id", "left").join(into, "id", "left").na.fill(0, ["out_degree", "in_degree"])


def degree_histogram(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    return degrees(edges, nodes).groupBy("out_degree").agg(F.count("*").alias("n"))


def undirected(edges: DataFrame) -> DataFrame:
    """Distinct pairs a < b, loops left out."""
    return edges.where("src != dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()


def triangles(edges: DataFrame) -> DataFrame:
    """(a, b, c), each once. Every edge is owned by its end of smaller degree, so a hub opens few wedges."""
    und = undirected(edges)
    deg = und.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("d"))
    r = und.join(deg.select(F.col("id").alias("a"), F.col("d").alias("da")), "a").join(deg.select(F.col("id").alias("b"), F.col("d").alias("db")), "b")
    first = (F.col("da") < F.col("db")) | ((F.col("da") == F.col("db")) & (F.col("a") < F.col("b")))
    own = r.select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("u"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("v"))
    wedge = own.alias("x").join(own.alias("y"), F.col("x.u") == F.col("y.u")).where(F.col("x.v") < F.col("y.v"))
    wedge = wedge.select(F.col("x.u").alias("u"), F.col("x.v").alias("a"), F.col("y.v").alias("b"))
    t = F.array_sort(F.array("u", "a", "b"))
    return wedge.join(und, ["a", "b"]).select(t[0].alias("a"), t[1].alias("b"), t[2].alias("c"))


def clustering(edges: DataFrame) -> DataFrame:
    """id, degree, triangles and local clustering coefficient in the undirected graph."""
    und = undirected(edges)
    deg = und.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))
    tri = triangles(edges).select(F.explode(F.array("a", "b", "c")).alias("id")).groupBy("id").agg(F.count("*").alias("triangles"))
    out = deg.join(tri, "id", "left").na.fill(0, ["triangles"])
    pairs = F.col("degree") * (F.col("degree") - 1) / 2
    return out.withColumn("clustering", F.when(F.col("degree") > 1, F.col("triangles") / pairs).otherwise(0.0))


def statistics(edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, density, triangles, global clustering, degree assortativity (undirected)."""
    und = undirected(edges)
    c = clustering(edges).agg(F.count("*").alias("nodes"), (F.sum("triangles") / 3).cast("long").alias("triangles"), F.sum(F.col("degree") * (F.col("degree") - 1) / 2).alias("triplets"))
    deg = und.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").cast("double").alias("d"))
    both = und.unionByName(und.select(F.col("b").alias("a"), F.col("a").alias("b")))
    ends = both.join(deg.select(F.col("id").alias("a"), F.col("d").alias("x")), "a").join(deg.select(F.col("id").alias("b"), F.col("d").alias("y")), "b")
    m = ends.agg((F.count("*") / 2).cast("long").alias("edges"), F.corr("x", "y").alias("assortativity"))
    n = F.col("nodes")
    return c.crossJoin(m).select("nodes", "edges", F.when(n > 1, 2 * F.col("edges") / (n * (n - 1))).otherwise(0.0).alias("density"), "triangles", F.when(F.col("triplets") > 0, 3 * F.col("triangles") / F.col("triplets")).otherwise(0.0).alias("global_clustering"), "assortativity")


def pagerank(edges: DataFrame, rounds: int = 10, damping: float = 0.85, nodes: DataFrame | None = None, tolerance: float | None = None) -> DataFrame:
    """(id, rank); the weight of vertices without out-edges goes to all. Stops early below an L1 change of tolerance."""
    ready(edges.sparkSession)
    nodes = written((nodes if nodes is not None else vertices(edges)).select("id"), "nodes")
    n = nodes.count()
    if n == 0:
        return nodes.withColumn("rank", F.lit(0.0))
    out = edges.groupBy("src").agg(F.count("*").alias("d"))
    links = written(edges.join(out, "src").select("src", "dst", "d"), "links")
    ranks = nodes.withColumn("rank", F.lit(1.0 / n))
    for _ in range(rounds):
        dangling = ranks.join(out, ranks.id == out.src, "left_anti").agg(F.sum("rank")).first()[0] or 0.0
        given = links.join(ranks, links.src == ranks.id).groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("rank") / F.col("d")).alias("got"))
        new = written(nodes.join(given, "id", "left").select("id", (F.lit((1 - damping) / n) + damping * (F.coalesce("got", F.lit(0.0)) + F.lit(dangling / n))).alias("rank")), "ranks")
        if tolerance is not None:
            moved = new.join(ranks.withColumnRenamed("rank", "old"), "id").agg(F.sum(F.abs(F.col("rank") - F.col("old")))).first()[0]
            ranks = new
            if moved < tolerance:
                break
        ranks = new
    return ranks


def bfs(edges: DataFrame, source, max_depth: int | None = None, directed: bool = True) -> DataFrame:
    """(id, depth) of what is reachable from source, to any depth unless max_depth is given. Each round joins the frontier only."""
    spark = ready(edges.sparkSession)
    both = edges.select("src", "dst")
    if not directed:
        both = both.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    kind = edges.schema["src"].dataType.simpleString()
    seen = frontier = spark.createDataFrame([(source, 0)], f"id {kind}, depth int")
    for depth in itertools.count(1):
        if max_depth is not None and depth > max_depth:
            break
        nxt = both.join(frontier.select(F.col("id").alias("src")), "src").select(F.col("dst").alias("id")).distinct().join(seen.select("id"), "id", "left_anti")
        frontier = written(nxt.withColumn("depth", F.lit(depth)), "frontier")
        if not frontier.take(1):
            break
        seen = seen.unionByName(frontier)
        if depth % 16 == 0:  # else plans of long paths grow with every round
            seen = written(seen, "seen")
    return seen


def shortest_paths(edges: DataFrame, source, weight: str | None = None) -> DataFrame:
    """(id, dist) by relaxing the edges of vertices that have moved until none moves; weights are not negative (others raise)."""
    spark = ready(edges.sparkSession)
    kind = edges.schema["src"].dataType.simpleString()
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    links = edges.select("src", "dst", w.alias("w"))
    if weight and links.where("w < 0").take(1):
        raise ValueError("weights are not negative")
    dist = moved = spark.createDataFrame([(source, 0.0)], f"id {kind}, dist double")
    while True:
        step = links.join(moved, links.src == moved.id).groupBy(F.col("dst").alias("id")).agg(F.min(F.col("dist") + F.col("w")).alias("new"))
        both = dist.join(step, "id", "full_outer").select("id", F.least("dist", "new").alias("dist"), (F.col("dist").isNull() | (F.col("new") < F.col("dist"))).alias("moved"))
        table = written(both, "dist")
        dist, moved = table.select("id", "dist"), table.where("moved").select("id", "dist")
        if not moved.take(1):
            return dist


def a_star(edges: DataFrame, source, target, weight: str, estimate: DataFrame) -> tuple[list, float | None]:
    """Vertices of a shortest path and its length ([] and None if there is none). estimate: id, h, never more than what is left to target
    (missing: 0). Vertices go out in order of dist + h; small, as that order is sequential."""
    adj: dict = defaultdict(list)
    for s, d, w in _collected(edges, weight):
        adj[s].append((float(w), d))
    ids = edges.sparkSession.createDataFrame([(v,) for v in {source, *adj}], f"id {edges.schema['src'].dataType.simpleString()}")
    left = {r["id"]: float(r["h"]) for r in estimate.select("id", "h").join(ids, "id", "left_semi").collect()}
    heap, came, dist, done = [(left.get(source, 0.0), source)], {source: None}, {source: 0.0}, set()
    while heap:
        _, v = heapq.heappop(heap)
        if v == target:
            path = []
            while v is not None:
                path.append(v)
                v = came[v]
            return path[::-1], dist[target]
        if v in done:
            continue
        done.add(v)
        for w, u in adj[v]:
            if u not in dist or dist[v] + w < dist[u]:
                dist[u], came[u] = dist[v] + w, v
                done.discard(u)
                heapq.heappush(heap, (dist[u] + left.get(u, 0.0), u))
    return [], None


def all_pairs(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(src, dst, hops) of all ordered reachable pairs, by doubling: log2(diameter) min-plus joins. For graphs of some thousand vertices,
    as the result has a row for each pair."""
    ready(edges.sparkSession)
    nodes = (nodes if nodes is not None else vertices(edges)).select("id")
    zero = nodes.select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(0).alias("hops"))
    dist = written(edges.select("src", "dst", F.lit(1).alias("hops")).unionByName(zero).groupBy("src", "dst").agg(F.min("hops").alias("hops")), "hops")
    while True:
        two = dist.alias("x").join(dist.alias("y"), F.col("x.dst") == F.col("y.src")).select(F.col("x.src").alias("src"), F.col("y.dst").alias("dst"), (F.col("x.hops") + F.col("y.hops")).alias("hops"))
        new = written(two.groupBy("src", "dst").agg(F.min("hops").alias("hops")), "hops")
        a, b = (d.agg(F.count("*"), F.sum("hops")).first() for d in (dist, new))
        dist = new
        if tuple(a) == tuple(b):
            break
    return dist


def closeness(edges: DataFrame) -> DataFrame:
    """id, vertices reached and their number over the sum of distances."""
    d = all_pairs(edges).where("src != dst")
    return d.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("reached"), (F.count("*") / F.sum("hops")).alias("closeness"))


def path_statistics(edges: DataFrame) -> DataFrame:
    """One row: diameter (-1 if some pair is unreachable) and mean distance of reachable ordered pairs."""
    n = vertices(edges).count()
    d = all_pairs(edges).where("src != dst").agg(F.count("*").alias("pairs"), F.max("hops").alias("most"), F.avg("hops").alias("mean"))
    return d.select(F.when(F.col("pairs") == n * (n - 1), F.col("most")).otherwise(-1).alias("diameter"), F.col("mean").alias("average_path"))


def components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(id, component): the smallest vertex of each weak component; labels spread and are followed once each round."""
    ready(edges.sparkSession)
    nodes = (nodes if nodes is not None else vertices(edges)).select("id")
    both = written(edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))), "both")
    labels = written(nodes.withColumn("c", F.col("id")), "labels")
    while True:
        heard = both.join(labels, both.src == labels.id).groupBy("dst").agg(F.min("c").alias("m"))
        low = labels.join(heard, labels.id == heard.dst, "left").select("id", "c", F.least("c", F.coalesce("m", "c")).alias("l"))
        up = labels.select(F.col("id").alias("l"), F.col("c").alias("p"))
        new = written(low.join(up, "l", "left").select("id", F.least("l", F.coalesce("p", "l")).alias("c"), (F.least("l", F.coalesce("p", "l")) != F.col("c")).alias("moved")), "labels")
        labels = new.select("id", "c")
        if not new.where("moved").take(1):
            break
    return labels.select("id", F.col("c").alias("component"))


def topological_levels(edges: DataFrame) -> tuple[DataFrame, bool]:
    """(id, level) of the vertices that no cycle leads to, by repeatedly taking those without open in-edges, and whether a cycle is left.

    When at most SMALL_EDGES edges are open the rest is done on the driver, so that deep graphs do not cost a job for each level.
    """
    spark = ready(edges.sparkSession)
    nodes = written(vertices(edges), "nodes")
    kind = edges.schema["src"].dataType.simpleString()
    live, left, out = written(edges.select("src", "dst"), "open"), nodes, None
    for level in itertools.count():
        if live.limit(SMALL_EDGES + 1).count() <= SMALL_EDGES:
            break
        free = written(left.join(live.select(F.col("dst").alias("id")).distinct(), "id", "left_anti").withColumn("level", F.lit(level)), "level")
        if not free.take(1):
            return (out if out is not None else free), True
        out = free if out is None else out.unionByName(free)
        left = written(left.join(free.select("id"), "id", "left_anti"), "left")
        live = written(live.join(left.select(F.col("id").alias("src")), "src", "left_semi"), "open")
    after, waits = defaultdict(list), defaultdict(int)
    for s, d in _collected(live):
        after[s].append(d)
        waits[d] += 1
    ends = {x for s, ds in after.items() for x in (s, *ds)}
    rows, now = [], [v for v in ends if not waits[v]]
    depth = level
    while now:
        rows += [(v, depth) for v in now]
        nxt = []
        for v in now:
            for d in after[v]:
                waits[d] -= 1
                if not waits[d]:
                    nxt.append(d)
        now, depth = nxt, depth + 1
    met = spark.createDataFrame([(v,) for v in ends], f"id {kind}")
    rest = left.join(met, "id", "left_anti").withColumn("level", F.lit(level)).unionByName(spark.createDataFrame(rows, f"id {kind}, level int"))
    return (rest if out is None else out.unionByName(rest)), len(rows) < len(ends)


def label_propagation(edges: DataFrame, rounds: int = 10) -> DataFrame:
    """(id, label): in each round, all at once, a vertex takes its neighbours' most frequent label, ties to the smallest."""
    ready(edges.sparkSession)
    both = written(undirected(edges).select(F.col("a").alias("src"), F.col("b").alias("dst")).unionByName(undirected(edges).select(F.col("b").alias("src"), F.col("a").alias("dst"))), "both")
    labels = vertices(edges).withColumn("label", F.col("id"))
    for _ in range(rounds):
        votes = both.join(labels, both.src == labels.id).groupBy("dst", "label").agg(F.count("*").alias("n"))
        best = votes.groupBy("dst").agg(F.min_by("label", F.struct((-F.col("n")).alias("n"), "label")).alias("won"))
        labels = written(labels.join(best, labels.id == best.dst, "left").select("id", F.coalesce("won", "label").alias("label")), "labels")
    return labels


def spanning_forest(edges: DataFrame, weight: str | None = None) -> DataFrame:
    """(a, b, w) of a minimum spanning forest, direction ignored: each round every component takes its lightest edge (ties by ends)."""
    ready(edges.sparkSession)
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    und = edges.where("src != dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), w.alias("w")).groupBy("a", "b").agg(F.min("w").alias("w"))
    und = written(und, "undirected")
    chosen, comp = None, vertices(edges).withColumn("component", F.col("id"))
    while True:
        ca, cb = comp.select(F.col("id").alias("a"), F.col("component").alias("ca")), comp.select(F.col("id").alias("b"), F.col("component").alias("cb"))
        cross = written(und.join(ca, "a").join(cb, "b").where("ca != cb"), "cross")
        if not cross.take(1):
            break
        sides = cross.select(F.col("ca").alias("c"), "w", "a", "b").unionByName(cross.select(F.col("cb").alias("c"), "w", "a", "b"))
        light = sides.groupBy("c").agg(F.min(F.struct("w", "a", "b")).alias("e")).select(F.col("e.a").alias("a"), F.col("e.b").alias("b"), F.col("e.w").alias("w")).distinct()
        chosen = written(light if chosen is None else chosen.unionByName(light).distinct(), "chosen")
        comp = components(chosen.select(F.col("a").alias("src"), F.col("b").alias("dst")), vertices(edges))
    return chosen if chosen is not None else und.where("false")


def strong_components(edges: DataFrame) -> DataFrame:
    """(id, component): vertices are coloured with the smallest vertex that reaches them; those of one colour that
    reach that vertex back are a component and are taken out."""
    ready(edges.sparkSession)
    left, out, live = written(vertices(edges), "nodes"), None, edges.select("src", "dst")
    while left.take(1):
        color = written(left.withColumn("c", F.col("id")), "color")
        while True:
            heard = live.join(color, live.src == color.id).groupBy("dst").agg(F.min("c").alias("m"))
            new = written(color.join(heard, color.id == heard.dst, "left").select("id", F.least("c", F.coalesce("m", "c")).alias("c"), (F.coalesce("m", "c") < F.col("c")).alias("moved")), "color")
            color = new.select("id", "c")
            if not new.where("moved").take(1):
                break
        inside = live.join(color.select(F.col("id").alias("src"), F.col("c").alias("x")), "src").join(color.select(F.col("id").alias("dst"), F.col("c").alias("y")), "dst").where("x = y").select("src", "dst")
        inside = written(inside, "inside")
        back = frontier = written(color.where("id = c").select("id", "c"), "roots")
        while frontier.take(1):
            nxt = inside.join(frontier, inside.dst == frontier.id).select(F.col("src").alias("id"), "c").distinct().join(back.select("id"), "id", "left_anti")
            frontier = written(nxt, "back")
            back = back.unionByName(frontier)
        done = written(back.select("id", F.col("c").alias("component")), "scc")
        out = done if out is None else out.unionByName(done)
        left = written(left.join(done.select("id"), "id", "left_anti"), "left")
        live = written(live.join(left.select(F.col("id").alias("src")), "src", "left_semi").join(left.select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst"), "live")
    return out if out is not None else left.withColumn("component", F.col("id"))


def eigenvector(edges: DataFrame, rounds: int = 20) -> DataFrame:
    """(id, score): power iteration along edges from ones, scaled to length 1 each round."""
    ready(edges.sparkSession)
    nodes = written(vertices(edges), "nodes")
    score = nodes.withColumn("score", F.lit(1.0))
    for _ in range(rounds):
        got = edges.join(score, edges.src == score.id).groupBy(F.col("dst").alias("id")).agg(F.sum("score").alias("got"))
        new = written(nodes.join(got, "id", "left").select("id", F.coalesce("got", F.lit(0.0)).alias("score")), "score")
        size = math.sqrt(new.agg(F.sum(F.col("score") * F.col("score"))).first()[0] or 0.0)
        score = new.select("id", (F.col("score") / (size or 1.0)).alias("score"))
    return score


def simple_paths(edges: DataFrame, source, target, max_depth: int) -> DataFrame:
    """(path) of all paths without repeated vertices from source to target with at most max_depth edges."""
    spark = ready(edges.sparkSession)
    kind = edges.schema["src"].dataType.simpleString()
    paths = spark.createDataFrame([([source],)], f"path array<{kind}>")
    hits = None
    for _ in range(max_depth):
        ends = paths.withColumn("__end", F.element_at("path", -1))
        paths = written(ends.join(edges.select(F.col("src").alias("__end"), "dst").distinct(), "__end").where(~F.array_contains("path", F.col("dst"))).select(F.array_append("path", F.col("dst")).alias("path")), "paths")
        found = paths.where(F.element_at("path", -1) == F.lit(target))
        hits = found if hits is None else hits.unionByName(found)
        paths = paths.where(F.element_at("path", -1) != F.lit(target))
    return hits


# -- small graphs ------------------------------------------------------------
def _collected(edges: DataFrame, *extra: str) -> list[tuple]:
    rows = edges.select("src", "dst", *extra).limit(SMALL_EDGES + 1).collect()
    if len(rows) > SMALL_EDGES:
        raise ValueError(f"more than {SMALL_EDGES} edges: this algorithm visits vertices in turn and takes small graphs only")
    return [tuple(r) for r in rows]


def betweenness(edges: DataFrame) -> DataFrame:
    """(id, betweenness): Brandes, unweighted, not normalised. Small: the edge list is broadcast, sources are spread over tasks."""
    spark = ready(edges.sparkSession)
    adj: dict = defaultdict(list)
    for s, d in sorted(set(_collected(edges))):
        adj[s].append(d)
    ids = sorted({x for s, ds in adj.items() for x in (s, *ds)})
    held = spark.sparkContext.broadcast(dict(adj))
    kind = edges.schema["src"].dataType

    def run(parts):
        import pandas as pd

        for p in parts:
            total: dict = defaultdict(float)
            for s in p["id"]:
                order, before, count, dist = [], defaultdict(list), defaultdict(float, {s: 1.0}), {s: 0}
                queue = deque([s])
                while queue:
                    v = queue.popleft()
                    order.append(v)
                    for u in held.value.get(v, ()):
                        if u not in dist:
                            dist[u] = dist[v] + 1
                            queue.append(u)
                        if dist[u] == dist[v] + 1:
                            count[u] += count[v]
                            before[u].append(v)
                share: dict = defaultdict(float)
                for u in reversed(order):
                    for v in before[u]:
                        share[v] += count[v] / count[u] * (1 + share[u])
                    if u != s:
                        total[u] += share[u]
            yield pd.DataFrame({"id": list(total), "betweenness": list(total.values())})

    nodes = spark.createDataFrame([(i,) for i in ids], T.StructType([T.StructField("id", kind)]))
    part = nodes.repartition(8).mapInPandas(run, T.StructType([T.StructField("id", kind), T.StructField("betweenness", T.DoubleType())]))
    return nodes.join(part.groupBy("id").agg(F.sum("betweenness").alias("betweenness")), "id", "left").na.fill(0.0)


def depth_first(edges: DataFrame, source) -> list:
    """Vertices in the order in which a depth-first walk (smaller neighbours first) meets them. Small."""
    adj: dict = defaultdict(list)
    for s, d in sorted(set(_collected(edges)), reverse=True):
        adj[s].append(d)
    seen, order, stack = set(), [], [source]
    while stack:
        v = stack.pop()
        if v not in seen:
            seen.add(v)
            order.append(v)
            stack += [u for u in adj[v] if u not in seen]
    return order


def max_flow(edges: DataFrame, source, sink, capacity: str) -> float:
    """Value of a maximum flow by shortest augmenting paths; parallel edges add up. Small."""
    room: dict = defaultdict(lambda: defaultdict(float))
    for s, d, c in _collected(edges, capacity):
        room[s][d] += float(c)
        room[d][s] += 0.0
    flow = 0.0
    while True:
        came, queue = {source: None}, deque([source])
        while queue and sink not in came:
            v = queue.popleft()
            for u, c in room[v].items():
                if c > 1e-12 and u not in came:
                    came[u] = v
                    queue.append(u)
        if sink not in came:
            return flow
        path, v = [], sink
        while came[v] is not None:
            path.append((came[v], v))
            v = came[v]
        step = min(room[a][b] for a, b in path)
        for a, b in path:
            room[a][b] -= step
            room[b][a] += step
        flow += step


def coloring(edges: DataFrame) -> dict:
    """A proper colouring: vertices of larger degree first, each with the smallest free colour. Small."""
    adj: dict = defaultdict(set)
    for s, d in _collected(edges):
        if s != d:
            adj[s].add(d)
            adj[d].add(s)
    out: dict = {}
    for v in sorted(adj, key=lambda x: (-len(adj[x]), x)):
        used = {out[u] for u in adj[v] if u in out}
        out[v] = next(c for c in range(len(adj) + 1) if c not in used)
    return out


def walk(edges: DataFrame, source, visit, directed: bool = True) -> int:
    """Calls visit(id, depth) for what is reachable from source, nearest first and by id; a false answer ends the walk. The number of calls."""
    n = 0
    for row in bfs(edges, source, directed=directed).orderBy("depth", "id").toLocalIterator():
        n += 1
        if visit(row["id"], row["depth"]) is False:
            break
    return n


def centralities(edges: DataFrame, rounds: int = 20) -> DataFrame:
    """id, out_degree, in_degree, closeness, betweenness and eigenvector score of every vertex. Small: betweenness and closeness are."""
    out = degrees(edges).join(closeness(edges).select("id", "closeness"), "id", "left").join(betweenness(edges), "id", "left")
    return out.join(eigenvector(edges, rounds).withColumnRenamed("score", "eigenvector"), "id", "left").na.fill(0.0)


# -- property graphs as tables -------------------------------------------------
def add_nodes(nodes: DataFrame, more: DataFrame) -> DataFrame:
    """nodes with those of more (id, labels, props) whose id is new."""
    return nodes.unionByName(more.dropDuplicates(["id"]).join(nodes.select("id"), "id", "left_anti").select(*nodes.columns))


def add_edges(nodes: DataFrame, edges: DataFrame, more: DataFrame) -> DataFrame:
    """edges with those of more (id, src, dst, type) whose id is new and whose ends are in nodes."""
    known = more.join(nodes.select(F.col("id").alias("src")), "src", "left_semi").join(nodes.select(F.col("id").alias("dst")), "dst", "left_semi")
    return edges.unionByName(known.dropDuplicates(["id"]).join(edges.select("id"), "id", "left_anti").select(*edges.columns))


def remove_nodes(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """nodes and edges without the ids in gone and without the edges at them."""
    g = gone.select("id")
    return nodes.join(g, "id", "left_anti"), edges.join(g.withColumnRenamed("id", "src"), "src", "left_anti").join(g.withColumnRenamed("id", "dst"), "dst", "left_anti").select(*edges.columns)


def set_property(nodes: DataFrame, which, name: str, value) -> DataFrame:
    """nodes with property name set to value where the condition holds."""
    new = F.map_concat(F.map_filter("props", lambda k, _: k != name), F.create_map(F.lit(name), F.lit(value)))
    return nodes.withColumn("props", F.when(which, new).otherwise(F.col("props")))


def in_box(points: DataFrame, x: str, y: str, box: tuple[float, float, float, float]) -> DataFrame:
    """Points inside min_x, min_y, max_x, max_y (bounds included)."""
    return points.where(F.col(x).between(box[0], box[2]) & F.col(y).between(box[1], box[3]))


def grid_cell(x, y, bounds: tuple[float, float, float, float], n: int = 16):
    """Row and column of an n by n grid over bounds, clamped; the partitioning key of a spatial index."""
    def place(v, lo, hi):
        return F.least(F.lit(n - 1), F.greatest(F.lit(0), F.floor((v - lo) / ((hi - lo) / n)))).cast("int")

    return place(y, bounds[1], bounds[3]), place(x, bounds[0], bounds[2])
