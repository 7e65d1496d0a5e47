"""Approximate neighbours by navigable small-world graphs, one for each shard of a collection.

A shard is what one task reads.  Its graph has layers: a vector is in layer l and all below with chance exp(-l * log(M)).
Vectors are put in one by one; each is linked with up to M near ones (2 M in the lowest layer), chosen so that links point in
different directions.  The index is a table with a row for each shard, so a search is a map over shards that keeps k rows a query.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

INDEX_SCHEMA = "shard long, ids array<long>, vectors binary, links binary"


class Graph:
    """vectors (n, dim) and, for each layer, the neighbours of its vectors."""

    def __init__(self, dim: int, m: int = 12, ef: int = 64, seed: int = 7):
        self.m, self.ef, self.rng = m, ef, np.random.default_rng(seed)
        self.x = np.zeros((0, dim))
        self.layers: list[dict[int, list[int]]] = []
        self.entry = -1

    def _far(self, q: np.ndarray, at: list[int]) -> np.ndarray:
        d = self.x[at] - q
        return np.einsum("ij,ij->i", d, d)

    def _layer(self, q: np.ndarray, entries: list[int], ef: int, layer: int) -> list[tuple[float, int]]:
        """The ef nearest that a best-first walk from the entries finds, nearest first."""
        links = self.layers[layer]
        found = [(-float(d), v) for d, v in zip(self._far(q, entries), entries, strict=True)]
        heapq.heapify(found)
        todo = [(-d, v) for d, v in found]
        heapq.heapify(todo)
        seen = set(entries)
        while todo:
            d, v = heapq.heappop(todo)
            if len(found) >= ef and d > -found[0][0]:
                break
            new = [u for u in links[v] if u not in seen]
            if not new:
                continue
            seen.update(new)
            for du, u in zip(self._far(q, new).tolist(), new, strict=True):
                if len(found) < ef or du < -found[0][0]:
                    heapq.heappush(found, (-du, u))
                    heapq.heappush(todo, (du, u))
                    if len(found) > ef:
                        heapq.heappop(found)
        return sorted((-d, v) for d, v in found)

    def _chosen(self, near: list[tuple[float, int]], most: int) -> list[int]:
        """Of near ones (nearest first) those nearer to the vector than to any chosen before; then the nearest of the rest."""
        out: list[int] = []
        for d, v in near:
            if len(out) == most:
                break
            if not out or float(self._far(self.x[v], out).min()) > d:
                out.append(v)
        return out + [v for _, v in near if v not in out][: most - len(out)]

    def add_all(self, vectors: np.ndarray) -> Graph:
        self.x = np.concatenate([self.x, vectors])
        for v in range(len(self.x) - len(vectors), len(self.x)):
            self._add(v)
        return self

    def _add(self, v: int) -> None:
        top = int(-math.log(1 - self.rng.random()) / math.log(self.m))
        q, entries = self.x[v], [self.entry]
        for layer in range(len(self.layers) - 1, top, -1):
            entries = [self._layer(q, entries, 1, layer)[0][1]]
        for layer in range(min(top, len(self.layers) - 1), -1, -1):
            near = self._layer(q, entries, self.ef, layer)
            most = self.m * (1 if layer else 2)
            links = self.layers[layer]
            links[v] = self._chosen(near, self.m)
            for u in links[v]:
                links[u].append(v)
                if len(links[u]) > most:
                    links[u] = self._chosen(sorted(zip(self._far(self.x[u], links[u]).tolist(), links[u], strict=True)), most)
            entries = [u for _, u in near]
        while len(self.layers) <= top:
            self.layers.append({v: []})
            self.entry = v

    def search(self, q: np.ndarray, k: int, ef: int) -> list[tuple[float, int]]:
        if self.entry < 0:
            return []
        entries = [self.entry]
        for layer in range(len(self.layers) - 1, 0, -1):
            entries = [self._layer(q, entries, 1, layer)[0][1]]
        return self._layer(q, entries, max(ef, k), 0)[:k]

    def to_bytes(self) -> bytes:
        """Entry, then each layer as its size and, for each vector, its number, the number of links and the links."""
        out = [self.entry, len(self.layers)]
        for layer in self.layers:
            out.append(len(layer))
            for v, links in layer.items():
                out += [v, len(links), *links]
        return np.array(out, "<i4").tobytes()

    @classmethod
    def from_bytes(cls, data: bytes, vectors: np.ndarray) -> Graph:
        out = cls(vectors.shape[1])
        out.x = vectors
        z = np.frombuffer(data, "<i4").tolist()
        out.entry, at = z[0], 2
        for _ in range(z[1]):
            layer, n = {}, z[at]
            at += 1
            for _ in range(n):
                layer[z[at]] = z[at + 2 : at + 2 + z[at + 1]]
                at += 2 + z[at + 1]
            out.layers.append(layer)
        return out


def build(data: DataFrame, m: int = 12, ef: int = 64, shard_rows: int = 20_000, vec_id: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """The index: a row for each shard of at most shard_rows vectors. Null ids and vectors are left out; all vectors have one length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held_ids, held = TaskContext.get().partitionId() << 32, [], []

        def close() -> pa.RecordBatch:
            nonlocal shard
            x = np.array(held, np.float32)
            graph = Graph(x.shape[1], m, ef).add_all(x.astype(float))
            out = pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([list(held_ids)], pa.list_(pa.int64())), pa.array([x.tobytes()], pa.binary()), pa.array([graph.to_bytes()], pa.binary())], names=["shard", "ids", "vectors", "links"])
            shard += 1
            held_ids.clear()
            held.clear()
            return out

        for batch in batches:
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held_ids.append(i)
                held.append(v)
                if len(held) == shard_rows:
                    yield close()
        if held:
            yield close()

    return data.where(F.col(vec_id).isNotNull() & F.col(vec).isNotNull()).select(F.col(vec_id).cast("long"), F.col(vec).cast("array<float>")).mapInArrow(run, INDEX_SCHEMA)


def search(index: DataFrame, queries: DataFrame, k: int, ef: int = 128, vec_id: str = "vec_id", vec: str = "embedding", block: int = 4096) -> DataFrame:
    """(query_id, rank, vec_id, distance) of a stated query set, in broadcast blocks of at most block queries; L2."""
    out, held = None, []

    def one(rows: list) -> DataFrame:
        asked = queries.sparkSession.sparkContext.broadcast(([r[0] for r in rows], np.array([r[1] for r in rows], float)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, x = asked.value
            for batch in batches:
                for row in batch.to_pylist():
                    graph = Graph.from_bytes(row["links"], np.frombuffer(row["vectors"], np.float32).reshape(len(row["ids"]), -1).astype(float))
                    found = [(i, row["ids"][v], math.sqrt(d)) for i, q in zip(ids, x, strict=True) for d, v in graph.search(q, k, ef)]
                    if found:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), (pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["query_id", "vec_id", "distance"])

        return index.mapInArrow(run, "query_id long, vec_id long, distance double")

    for row in queries.select(vec_id, vec).toLocalIterator():
        held.append(row)
        if len(held) == block:
            out, held = one(held) if out is None else out.unionByName(one(held)), []
    if held or out is None:
        out = one(held) if out is None else out.unionByName(one(held))
    w = Window.partitionBy("query_id").orderBy("distance", "vec_id")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "distance")
