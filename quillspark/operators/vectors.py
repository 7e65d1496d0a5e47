"""Vector search and analysis: exact and approximate neighbours, product quantisation, clusters, projections, metrics.

Query sets are stated sets: they are collected in blocks and broadcast; the data side is never collected.  Approximate indexes
are fitted on a bounded sample of SAMPLE vectors and hold every vector.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.functions.scoring import METRICS, cosine

SAMPLE = 20_000
QUERY_BLOCK = 4096


def pair_distance(df: DataFrame, a: str, b: str, metric: str) -> DataFrame:
    return df.withColumn("distance", METRICS[metric](F.col(a), F.col(b)))


def knn(data: DataFrame, query: list[float], k: int, metric: str = "l2", vec_id: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """The k nearest to one vector: vec_id, distance; ties go to the smaller id. A top-k, so each task keeps k rows."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return data.select(vec_id, METRICS[metric](F.col(vec), q).alias("distance")).orderBy("distance", vec_id).limit(k)


def _distances(x: np.ndarray, q: np.ndarray, metric: str) -> np.ndarray:
    if metric in ("l2", "sq_l2"):
        d = np.maximum((x * x).sum(1)[:, None] - 2 * x @ q.T + (q * q).sum(1)[None, :], 0)
        return np.sqrt(d) if metric == "l2" else d
    if metric == "ip":
        return -(x @ q.T)
    if metric == "cosine":
        n = np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(q, axis=1)[None, :]
        return 1 - np.divide(x @ q.T, n, out=np.zeros_like(n), where=n > 0)
    if metric == "l1":
        return np.stack([np.abs(x - v).sum(1) for v in q], 1)
    if metric == "linf":
        return np.stack([np.abs(x - v).max(1) for v in q], 1)
    a, b = x > 0, q > 0
    if metric == "hamming":
        return np.stack([(a != v).sum(1) for v in b], 1).astype(float)
    both, either = np.stack([(a & v).sum(1) for v in b], 1), np.stack([(a | v).sum(1) for v in b], 1)
    return 1 - np.divide(both, either, out=np.ones(both.shape), where=either > 0)


class _Nearest:
    """The k nearest of all rows seen to each query, ties by the smaller id: query's place, distance, id and, where given, a second number."""

    def __init__(self, queries: int, k: int):
        self.queries, self.k = queries, k
        self.kept = (np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64), np.zeros(0))
        self.bar, self.last = np.full(queries, np.inf), np.full(queries, np.iinfo(np.int64).max)  # of the k-th, once there are k
        self.held, self.n = [], 0

    def add(self, d: np.ndarray, ids: np.ndarray, which: np.ndarray, second=None) -> None:
        """d: distances by row and query (which); second: from rows and places in which to a second number."""
        bar = self.bar[which]
        if len(d) > self.k and np.isinf(bar).any():
            bar = np.minimum(np.partition(d, self.k - 1, axis=0)[self.k - 1], bar)
        row, at = np.nonzero(~(d > bar))
        near, of = d[row, at], ids[row]
        new = (near < self.bar[which][at]) | (of < self.last[which][at])
        row, at, near, of = row[new], at[new], near[new], of[new]
        step = 1 << 14
        more = np.concatenate([second(row[i : i + step], at[i : i + step]) for i in range(0, len(row), step)]) if second and len(row) else np.zeros(len(row))
        self.held.append((which[at], near, of, more))
        self.n += len(row)
        if 2 * self.n > self.queries * self.k:
            self.best()

    def best(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        q, near, of, more = (np.concatenate(x) for x in zip(self.kept, *self.held, strict=True))
        order = np.lexsort((of, near, q))
        own = q[order]
        place = np.arange(len(order)) - np.searchsorted(own, np.arange(self.queries))[own]
        order, place = order[place < self.k], place[place < self.k]
        self.kept = q, near, of, more = q[order], near[order], of[order], more[order]
        full = place == self.k - 1
        self.bar[q[full]], self.last[q[full]] = np.where(np.isnan(near[full]), np.inf, near[full]), of[full]
        self.held, self.n = [], 0
        return self.kept


def _query_blocks(queries: DataFrame, vec_id: str, vec: str):
    """(ids, vectors) of a stated query set, in blocks; one empty block if there are none."""
    block, none = [], True
    for row in queries.select(vec_id, vec).toLocalIterator():
        block.append(row)
        if len(block) == QUERY_BLOCK:
            yield np.array([r[0] for r in block], np.int64), np.array([r[1] for r in block], float)
            block, none = [], False
    if block or none:
        yield np.array([r[0] for r in block], np.int64), np.array([r[1] for r in block], float)


def _united(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def knn_join(data: DataFrame, queries: DataFrame, k: int, metric: str = "l2", vec_id: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, distance) for a stated query set against all rows, in query blocks: each task keeps k
    rows a query, and only those are shuffled."""
    spark = data.sparkSession

    def one(ids: np.ndarray, mat: np.ndarray) -> DataFrame:
        held = spark.sparkContext.broadcast((ids, mat))

        def run(parts):
            ids, mat = held.value
            nearest, every = _Nearest(len(ids), k), np.arange(len(ids))
            for p in parts:
                for at in range(0, len(p) if len(ids) else 0, 1024):
                    own = p.iloc[at : at + 1024]
                    nearest.add(_distances(np.stack(own[vec].to_numpy()).astype(float), mat, metric), own[vec_id].to_numpy(), every)
            q, d, of, _ = nearest.best()
            yield pd.DataFrame({"query_id": ids[q], "vec_id": of, "distance": d})

        return data.select(vec_id, vec).mapInPandas(run, "query_id long, vec_id long, distance double")

    out = _united([one(*b) for b in _query_blocks(queries, vec_id, vec)])
    w = Window.partitionBy("query_id").orderBy("distance", "vec_id")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "distance")


def recall(found: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """One row: mean share of the true k neighbours found."""
    seen = found.select("query_id", "vec_id").distinct().withColumn("seen", F.lit(1))
    hits = truth.join(seen, ["query_id", "vec_id"], "left").groupBy("query_id").agg(F.count("seen").alias("hits"))
    return hits.agg(F.avg(F.col("hits") / k).alias("recall"))


def _sample(data: DataFrame, vec: str, n: int = SAMPLE) -> np.ndarray:
    """At most n vectors, chosen by hash, for fitting."""
    rows = data.select(vec).orderBy(F.xxhash64(vec)).limit(n).toPandas()[vec]
    return np.stack(rows.to_numpy()).astype(float) if len(rows) else np.zeros((0, 0))


def kmeans_fit(x: np.ndarray, k: int, rounds: int = 25, seed: int = 7) -> np.ndarray:
    """k-means++ seeds and Lloyd rounds; empty clusters keep their centre."""
    rng = np.random.default_rng(seed)
    k = min(k, len(x))
    centres = [x[rng.integers(len(x))]]
    for _ in range(1, k):
        d = _distances(x, np.array(centres), "sq_l2").min(1)
        centres.append(x[rng.choice(len(x), p=d / d.sum())] if d.sum() > 0 else x[rng.integers(len(x))])
    c = np.array(centres)
    for _ in range(rounds):
        own = _distances(x, c, "sq_l2").argmin(1)
        new = np.stack([x[own == i].mean(0) if (own == i).any() else c[i] for i in range(len(c))])
        if np.allclose(new, c):
            break
        c = new
    return c


def assign(data: DataFrame, centres: np.ndarray, vec: str = "embedding", column: str = "cluster") -> DataFrame:
    """data with the nearest centre of each vector; the centres are k rows."""
    held = data.sparkSession.sparkContext.broadcast(centres)

    @F.pandas_udf("int")
    def nearest(v: pd.Series) -> pd.Series:
        return pd.Series(_distances(np.stack(v.to_numpy()).astype(float), held.value, "sq_l2").argmin(1) if len(v) else [], dtype="int32")

    return data.withColumn(column, nearest(vec))


def wcss(data: DataFrame, centres: np.ndarray, vec: str = "embedding") -> DataFrame:
    """One row: the sum of squared distances to the own centre."""
    table = F.array(*[F.array(*[F.lit(float(x)) for x in c]) for c in centres])
    a = assign(data, centres, vec)
    return a.agg(F.sum(METRICS["sq_l2"](F.col(vec), F.element_at(table, F.col("cluster") + 1))).alias("wcss"))


@dataclass
class IVF:
    """Lists by coarse centre, with product codes of residuals if parts > 0. The index table holds every vector."""

    lists: int = 16
    probes: int = 4
    parts: int = 0
    codes: int = 32
    seed: int = 7
    centres: np.ndarray = field(default=None, repr=False)
    books: list = field(default=None, repr=False)

    def fit(self, data: DataFrame, vec: str = "embedding") -> IVF:
        x = _sample(data, vec)
        self.centres = kmeans_fit(x, self.lists, seed=self.seed)
        if self.parts:
            rest = x - self.centres[_distances(x, self.centres, "sq_l2").argmin(1)]
            self.books = [kmeans_fit(p, self.codes, seed=self.seed + i) for i, p in enumerate(np.array_split(rest, self.parts, axis=1))]
        return self

    def encode(self, x: np.ndarray, own: np.ndarray) -> np.ndarray:
        rest = x - self.centres[own]
        return np.stack([_distances(p, b, "sq_l2").argmin(1) for p, b in zip(np.array_split(rest, self.parts, axis=1), self.books, strict=True)], 1)

    def decode(self, codes: np.ndarray, own: np.ndarray) -> np.ndarray:
        return self.centres[own] + np.concatenate([b[codes[:, i]] for i, b in enumerate(self.books)], 1)

    def build(self, data: DataFrame, vec_id: str = "vec_id", vec: str = "embedding") -> DataFrame:
        """vec_id, list, codes (if any) and the vector, one row each; partition the table by list to prune probes."""
        held = data.sparkSession.sparkContext.broadcast(self)

        def run(parts):
            for p in parts:
                if not len(p):
                    continue
                x = np.stack(p[vec].to_numpy()).astype(float)
                own = _distances(x, held.value.centres, "sq_l2").argmin(1)
                codes = list(held.value.encode(x, own)) if held.value.parts else [None] * len(p)
                yield pd.DataFrame({"vec_id": p[vec_id], "list": own, "codes": codes, "vec": p[vec]})

        return data.select(vec_id, vec).mapInPandas(run, "vec_id long, list int, codes array<int>, vec array<float>")

    def search(self, index: DataFrame, queries: DataFrame, k: int, rerank: int = 4, vec_id: str = "vec_id", vec: str = "embedding") -> DataFrame:
        """(query_id, rank, vec_id, distance) among the rows of the lists nearest to each query of a stated set; with codes, the rerank * k
        best by distance from the decoded codes are compared exactly. Goes in query blocks: each task keeps so many rows a query, without their vectors, and only those are shuffled."""
        spark = index.sparkSession
        keep = rerank * k if self.parts else k

        def one(ids: np.ndarray, mat: np.ndarray) -> DataFrame:
            near = np.argsort(_distances(mat, self.centres, "sq_l2"), 1)[:, : self.probes] if len(ids) else np.zeros((0, 1), int)
            probed = np.zeros((len(self.centres), len(ids)), bool)
            probed[near, np.arange(len(ids))[:, None]] = True
            held = spark.sparkContext.broadcast((self, ids, mat, probed))

            def run(parts):
                me, ids, mat, probed = held.value
                nearest = _Nearest(len(ids), keep)
                for p in parts:
                    for of in np.unique(p["list"]):
                        which = np.flatnonzero(probed[of])
                        for at in range(0, int((p["list"] == of).sum()) if len(which) else 0, 1024):
                            own = p[p["list"] == of].iloc[at : at + 1024]
                            x, asked = np.stack(own["vec"].to_numpy()).astype(float), mat[which]
                            seen = me.decode(np.stack(own["codes"].to_numpy()), own["list"].to_numpy()) if me.parts else x
                            nearest.add(_distances(seen, asked, "sq_l2"), own["vec_id"].to_numpy(), which, lambda r, q, x=x, asked=asked: np.sqrt(((x[r] - asked[q]) ** 2).sum(1)))
                q, rough, of, d = nearest.best()
                yield pd.DataFrame({"query_id": ids[q], "vec_id": of, "rough": rough, "distance": d})

            return index.select("vec_id", "list", "codes", "vec").mapInPandas(run, "query_id long, vec_id long, rough double, distance double")

        out = _united([one(*b) for b in _query_blocks(queries, vec_id, vec)])
        w = Window.partitionBy("query_id")
        if self.parts:
            out = out.withColumn("r", F.row_number().over(w.orderBy("rough", "vec_id"))).where(F.col("r") <= keep)
        return out.withColumn("rank", F.row_number().over(w.orderBy("distance", "vec_id"))).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "distance")

    def _decoder(self):
        me = self

        @F.pandas_udf("array<double>")
        def decode(codes: pd.Series, own: pd.Series) -> pd.Series:
            return pd.Series(list(me.decode(np.stack(codes.to_numpy()), own.to_numpy()))) if len(codes) else pd.Series([], dtype=object)

        return decode


def lsh(data: DataFrame, queries: DataFrame, k: int, tables: int = 32, n_bits: int = 6, flips: int = 2, seed: int = 7, vec_id: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """Neighbours by signs of random projections: vectors that share a bucket in some table with the query are compared exactly (L2).

    A query also looks into the buckets that differ in one or two of the flips signs nearest to a plane. Each pair met is counted once.
    """
    dim = len(data.select(vec).first()[0])
    planes = np.random.default_rng(seed).standard_normal((tables, n_bits, dim))
    power = 1 << np.arange(n_bits)

    def buckets(name: str, flips: int):
        def run(parts):
            for p in parts:
                if not len(p):
                    continue
                side = np.einsum("nd,tbd->ntb", np.stack(p[vec].to_numpy()).astype(float), planes)
                b = ((side > 0) * power).sum(2)
                near = power[np.argsort(np.abs(side), 2)[:, :, :flips]]
                probes = [b, *(b ^ near[:, :, i] for i in range(flips)), *(b ^ near[:, :, i] ^ near[:, :, j] for i in range(flips) for j in range(i))]
                for found in probes:
                    yield pd.DataFrame({name: np.repeat(p[vec_id].to_numpy(), tables), "t": np.tile(np.arange(tables), len(p)), "b": found.ravel()})

        return run

    a = data.select(vec_id, vec).mapInPandas(buckets("vec_id", 0), "vec_id long, t int, b int")
    q = queries.select(vec_id, vec).mapInPandas(buckets("query_id", min(flips, n_bits)), "query_id long, t int, b int")
    pairs = q.join(a, ["t", "b"]).select("query_id", "vec_id").distinct()
    pairs = pairs.join(data.select(F.col(vec_id).alias("vec_id"), F.col(vec).alias("v")), "vec_id").join(queries.select(F.col(vec_id).alias("query_id"), F.col(vec).alias("q")), "query_id")
    pairs = pairs.select("query_id", "vec_id", METRICS["l2"](F.col("v"), F.col("q")).alias("distance"))
    return pairs.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "vec_id"))).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "distance")


# -- product codes -------------------------------------------------------------
def symmetric_tables(books: list) -> list[np.ndarray]:
    """Squared distances between all codes of each part."""
    return [_distances(b, b, "sq_l2") for b in books]


def symmetric_distance(books: list, a: str, b: str):
    """Column: squared distance of two code arrays by the tables of symmetric_tables, which hold codes * codes numbers a part."""
    total = F.lit(0.0)
    for i, t in enumerate(symmetric_tables(books)):
        flat = F.array(*[F.lit(float(v)) for v in t.ravel()])
        total = total + F.element_at(flat, (F.col(a)[i] * len(t) + F.col(b)[i] + 1).cast("int"))
    return total


def codes_differ(a, b):
    """Column: in how many parts two code arrays differ."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x != y), lambda x: x))


def codes_text(codes):
    return F.concat_ws(",", F.transform(codes, lambda x: x.cast("string")))


def reconstruction_error(index: DataFrame, ivf: IVF) -> DataFrame:
    """One row: the mean over vectors of the mean squared difference from their decoded codes."""
    back = ivf._decoder()
    return index.withColumn("back", back("codes", "list")).agg(F.avg(METRICS["sq_l2"](F.col("vec"), F.col("back")) / F.size("vec")).alias("mse"))


def code_entropy(index: DataFrame) -> DataFrame:
    """(part, entropy): bits of the codes of each part."""
    n = index.select(F.posexplode("codes").alias("part", "code")).groupBy("part", "code").agg(F.count("*").alias("n"))
    total = n.groupBy("part").agg(F.sum("n").alias("total"))
    p = F.col("n") / F.col("total")
    return n.join(total, "part").groupBy("part").agg((-F.sum(p * F.log2(p))).alias("entropy"))


# -- evaluation ------------------------------------------------------------------
def batch_metrics(found: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """One row: queries, mean recall at k, share of queries whose nearest is right, mean reciprocal rank of the true nearest."""
    best = truth.where("rank = 1").select("query_id", F.col("vec_id").alias("best"))
    place = found.join(best, "query_id").where("vec_id = best").select("query_id", F.col("rank").alias("place"))
    hits = truth.where(F.col("rank") <= k).join(found.where(F.col("rank") <= k).select("query_id", "vec_id"), ["query_id", "vec_id"], "left_semi").groupBy("query_id").agg(F.count("*").alias("hits"))
    rows = best.join(hits, "query_id", "left").join(place, "query_id", "left")
    return rows.agg(F.count("*").alias("queries"), F.avg(F.coalesce("hits", F.lit(0)) / k).alias("recall"), F.avg(F.when(F.col("place") == 1, 1.0).otherwise(0.0)).alias("first_right"), F.avg(F.coalesce(1 / F.col("place"), F.lit(0.0))).alias("mrr"))


def metric_axioms(triples: DataFrame, metric: str, a: str = "a", b: str = "b", c: str = "c", tolerance: float = 1e-5) -> DataFrame:
    """One row: how many triples of vectors break identity, symmetry and the triangle inequality."""
    d = METRICS[metric]
    ab, bc, ac = d(F.col(a), F.col(b)), d(F.col(b), F.col(c)), d(F.col(a), F.col(c))
    return triples.agg(F.count_if(F.abs(d(F.col(a), F.col(a))) > tolerance).alias("identity"), F.count_if(F.abs(ab - d(F.col(b), F.col(a))) > tolerance).alias("symmetry"), F.count_if(ac > ab + bc + tolerance).alias("triangle"))


def random_vectors(ids: DataFrame, dim: int, seed: int = 7, normal: bool = False) -> DataFrame:
    """ids with a column embedding: dim values from -1 to 1, or normal ones, that depend on the id and the seed only."""
    even = lambda i, s: (F.pmod(F.xxhash64(ids.columns[0], i, F.lit(s)), F.lit(1 << 53)) + F.lit(0.5)) / F.lit(float(1 << 53))
    if normal:
        value = lambda i: F.sqrt(-2 * F.log(even(i, seed))) * F.cos(2 * math.pi * even(i, seed + 1))
    else:
        value = lambda i: 2 * even(i, seed) - 1
    return ids.withColumn("embedding", F.transform(F.sequence(F.lit(1), F.lit(dim)), value).cast("array<float>"))


def mean_vector(data: DataFrame, vec: str = "embedding") -> DataFrame:
    """(pos, mean, std): population deviation, in double. One aggregate over exploded values; its result has a row per dimension."""
    e = data.select(F.posexplode(F.col(vec).cast("array<double>")).alias("pos", "x"))
    return e.groupBy("pos").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"))


def standardized(data: DataFrame, vec: str = "embedding") -> DataFrame:
    """Vectors less the mean, over the deviation (1 where it is below 1e-8)."""
    rows = sorted(mean_vector(data, vec).collect())
    m = F.array(*[F.lit(r["mean"]) for r in rows])
    s = F.array(*[F.lit(r["std"] if r["std"] > 1e-8 else 1.0) for r in rows])
    z = F.zip_with(F.zip_with(F.col(vec).cast("array<double>"), m, lambda x, y: x - y), s, lambda x, y: x / y)
    return data.withColumn(vec, z)


def covariance(data: DataFrame, vec: str = "embedding") -> tuple[np.ndarray, np.ndarray, int]:
    """Mean, sample covariance and count; tasks send dim * dim sums each."""
    def run(parts):
        n, s, ss = 0, 0.0, 0.0
        for p in parts:
            if len(p):
                x = np.stack(p[vec].to_numpy()).astype(float)
                n, s, ss = n + len(x), s + x.sum(0), ss + x.T @ x
        if n:
            yield pd.DataFrame({"n": [n], "s": [s], "ss": [ss.ravel()]})

    rows = data.select(vec).mapInPandas(run, "n long, s array<double>, ss array<double>").collect()
    n = sum(r["n"] for r in rows)
    s, ss = sum(np.array(r["s"]) for r in rows), sum(np.array(r["ss"]) for r in rows)
    mean = s / n
    d = len(mean)
    return mean, (ss.reshape(d, d) - n * np.outer(mean, mean)) / max(n - 1, 1), n


def pca(data: DataFrame, k: int, vec: str = "embedding") -> tuple[np.ndarray, np.ndarray]:
    """The k leading components (rows, largest entry positive) and all variances, descending."""
    _, cov, _ = covariance(data, vec)
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(values)[::-1]
    top = vectors[:, order[:k]].T
    signs = np.sign(top[np.arange(len(top)), np.abs(top).argmax(1)])
    return top * signs[:, None], values[order]


def project(data: DataFrame, matrix: np.ndarray, vec: str = "embedding", column: str = "projected") -> DataFrame:
    m = np.asarray(matrix)

    @F.pandas_udf("array<double>")
    def f(v: pd.Series) -> pd.Series:
        return pd.Series(list(np.stack(v.to_numpy()).astype(float) @ m.T)) if len(v) else pd.Series([], dtype=object)

    return data.withColumn(column, f(vec))


def random_projection(dim: int, to: int, seed: int = 7) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((to, dim)) / math.sqrt(to)


def silhouette(data: DataFrame, cluster: str, vec_id: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """(vec_id, silhouette) on squared distances from cluster sums: d(x, C) needs only C's count, sum and sum of squares, so no pairs are made."""
    e = data.select(cluster, F.posexplode(F.col(vec).cast("array<double>")).alias("pos", "x"))
    sums = e.groupBy(cluster, "pos").agg(F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("ss"), F.count("*").alias("n")).collect()
    ids = sorted({r[cluster] for r in sums})
    dim = 1 + max(r["pos"] for r in sums)
    s, ss, n = np.zeros((len(ids), dim)), np.zeros(len(ids)), np.zeros(len(ids))
    for r in sums:
        i = ids.index(r[cluster])
        s[i, r["pos"]], n[i] = r["s"], r["n"]
        ss[i] += r["ss"]

    def run(parts):
        for p in parts:
            if not len(p):
                continue
            x = np.stack(p[vec].to_numpy()).astype(float)
            own = np.array([ids.index(c) for c in p[cluster]])
            total = (x * x).sum(1)[:, None] * n - 2 * x @ s.T + ss
            rows = np.arange(len(x))
            a = np.divide(total[rows, own], n[own] - 1, out=np.zeros(len(x)), where=n[own] > 1)
            mean = total / n
            mean[rows, own] = np.inf
            b = mean.min(1)
            yield pd.DataFrame({"vec_id": p[vec_id], "silhouette": np.where(n[own] > 1, (b - a) / np.maximum(np.maximum(a, b), 1e-300), 0.0)})

    return data.select(vec_id, cluster, vec).mapInPandas(run, "vec_id long, silhouette double")


def pairwise(a: DataFrame, b: DataFrame, metric: str, vec_id: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """(a, b, distance) of two stated sets, of which b has at most QUERY_BLOCK vectors (else ValueError): b is broadcast, a is not shuffled."""
    rows = b.select(vec_id, vec).limit(QUERY_BLOCK + 1).collect()
    if len(rows) > QUERY_BLOCK:
        raise ValueError(f"more than {QUERY_BLOCK} vectors on the second side: use knn_join for neighbours")
    held = a.sparkSession.sparkContext.broadcast(([r[0] for r in rows], np.array([r[1] for r in rows], float)))

    def run(parts):
        ids, mat = held.value
        for p in parts:
            for at in range(0, len(p) if len(ids) else 0, 1024):
                own = p.iloc[at : at + 1024]
                d = _distances(np.stack(own[vec].to_numpy()).astype(float), mat, metric)
                yield pd.DataFrame({"a": np.repeat(own[vec_id].to_numpy(), len(ids)), "b": np.tile(ids, len(own)), "distance": d.ravel()})

    return a.select(vec_id, vec).mapInPandas(run, "a long, b long, distance double")


def paired_t(a: np.ndarray, b: np.ndarray) -> tuple[float, float]:
    """t of paired differences and the two-sided normal probability."""
    d = np.asarray(a, float) - np.asarray(b, float)
    if len(d) < 2 or d.std(ddof=1) == 0:
        return 0.0, 1.0
    t = float(d.mean() / (d.std(ddof=1) / math.sqrt(len(d))))
    return t, math.erfc(abs(t) / math.sqrt(2))


def cosine_top(data: DataFrame, query_id: int, k: int, vec_id: str = "vec_id", vec: str = "embedding") -> DataFrame:
    q = data.where(F.col(vec_id) == query_id).select(F.col(vec).alias("__q"))
    return data.crossJoin(F.broadcast(q)).select(vec_id, cosine(F.col(vec), F.col("__q")).alias("similarity")).orderBy(F.desc("similarity"), vec_id).limit(k)


@dataclass(frozen=True)
class IndexConfig:
    """Parameters of a vector index, with a choice by size and an estimate of memory."""

    kind: str = "flat"
    metric: str = "l2"
    lists: int = 0
    probes: int = 0
    tables: int = 0
    bits: int = 0
    parts: int = 0

    def __post_init__(self) -> None:
        if self.kind not in ("flat", "ivf", "ivfpq", "lsh") or self.metric not in METRICS or (self.kind.startswith("ivf") and not 0 < self.probes <= self.lists) or (self.kind == "lsh" and not (self.tables and self.bits)):
            raise ValueError(f"not an index: {self}")

    @classmethod
    def for_size(cls, n: int, dim: int) -> IndexConfig:
        if n < 10_000:
            return cls()
        lists = max(16, int(math.sqrt(n)))
        return cls("ivf" if n < 1_000_000 else "ivfpq", lists=lists, probes=max(4, lists // 16), parts=0 if n < 1_000_000 else max(1, dim // 8))

    def bytes(self, n: int, dim: int) -> int:
        own = 4 * n * dim
        return {"flat": own, "ivf": own + 4 * n + 4 * self.lists * dim, "ivfpq": n * (4 + self.parts) + 4 * self.lists * dim + 1024 * dim, "lsh": own + 12 * n * self.tables}[self.kind]
