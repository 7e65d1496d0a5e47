"""A distributed positional inverted index, and decontamination with it.

The index is cut by document: each shard covers some megabytes of whole texts and keeps, for
each of its terms in order of hash, the ascending positions of all its occurrences (positions count the
shard's words).  Nothing is shuffled, and no term's postings are ever in one place, so a very frequent term
costs each shard its own share.  Shards are rows of a Parquet table in the shared folder.

A phrase is found in a shard by starting from the postings of its rarest term, moved back by the
term's place in the phrase, and intersecting them with the moved postings of the other terms, rarest first.
All phrases of a query block go through these steps side by side.  A shard tells its terms apart by two hashes
of 64 bits, and a query's words are compared with the terms byte by byte.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.bytesnp import ALNUM, blocks, lower_ascii, repeat_ranges, span_hashes, text_buffer, tidy, words
from quillspark.session import ready, written

SHARD_BYTES = 3 << 20
#: A query block is broadcast; its texts take at most this many bytes. More blocks mean more passes over the index.
QUERY_BYTES = 16 << 20
INDEX_SCHEMA = "shard long, doc_ids array<long>, n_words array<long>, hashes binary, term_sizes binary, terms binary, counts binary, gaps binary"
_NAMES = [x.split()[0] for x in INDEX_SCHEMA.split(", ")]


def _z(data: np.ndarray) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(data).tobytes())


def _unz(data: bytes, kind) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), kind)


def term_bytes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return raw[repeat_ranges(starts, ends - starts)]


def _shard_row(shard: int, doc_ids: list[int], part: np.ndarray, off: np.ndarray) -> pa.RecordBatch:
    """The index of some texts. Its arrays go before the next shard's are made."""
    starts, ends, bounds = words(part, off, ALNUM)
    h, check = span_hashes(part, starts, ends), span_hashes(part, starts, ends, 1)
    order = np.argsort(h, kind="stable").astype(np.int32)
    h, sorted_c = h[order], check[order]
    new = h[1:] != h[:-1]
    if ((sorted_c[1:] != sorted_c[:-1]) > new).any():  # two words of one hash
        again = np.lexsort((sorted_c, h))  # stable, so words of one term stay in order
        order, h, sorted_c = order[again], h[again], sorted_c[again]
        new = (h[1:] != h[:-1]) | (sorted_c[1:] != sorted_c[:-1])
    del check, sorted_c
    first = np.flatnonzero(np.r_[True, new]) if len(h) else np.zeros(0, np.int64)
    counts = np.diff(np.r_[first, len(h)])
    h = h[first]
    gaps = np.diff(order, prepend=np.int32(0))
    gaps[first] = order[first]
    s, e = starts[order[first]], ends[order[first]]
    del starts, ends, order
    row = [shard, doc_ids, np.diff(bounds), _z(h.astype("<u8")), _z((e - s).astype("<u4")), _z(term_bytes(part, s, e)), _z(counts.astype("<u4")), _z(gaps.astype("<u4"))]
    kinds = (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), *[pa.binary()] * 5)
    return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, kinds, strict=True)], names=_NAMES)


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Writes the index of all whole texts and returns it. Null texts have no words; rows with equal ids stay apart."""
    ready(docs.sparkSession)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId() << 32
        for batch in batches:
            raw, offsets = text_buffer(batch.column(1))
            for a, b in blocks(offsets, shard_bytes):
                yield _shard_row(shard, batch.column(0)[a:b].to_pylist(), lower_ascii(raw[offsets[a] : offsets[b]]), offsets[a : b + 1] - offsets[a])
                shard += 1

    d = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return written(d.mapInArrow(tidy(build), INDEX_SCHEMA), "positions")


class Shard:
    """One row of the index, opened."""

    def __init__(self, row: dict):
        self.doc_ids = row["doc_ids"]
        self.bounds = np.r_[0, np.cumsum(np.array(row["n_words"], np.int64))].astype(np.int64)
        self.hashes, self.counts = _unz(row["hashes"], "<u8"), _unz(row["counts"], "<u4").astype(np.int64)
        self.terms = _unz(row["terms"], np.uint8).tobytes()
        self.term_ends = np.cumsum(_unz(row["term_sizes"], "<u4").astype(np.int64))
        self.first = np.cumsum(self.counts) - self.counts
        gaps = _unz(row["gaps"], "<u4").astype(np.int64)
        sums = np.cumsum(gaps)
        self.positions = sums - np.repeat(sums[self.first] - gaps[self.first], self.counts) if len(gaps) else gaps
        self.n = int(self.bounds[-1])
        #: term * n + position, ascending: all postings as one sorted list
        self.postings = np.repeat(np.arange(len(self.counts)), self.counts) * self.n + self.positions

    def term_ids(self, names: list[bytes], hashes: np.ndarray) -> np.ndarray:
        """Numbers of terms in this shard, -1 if absent."""
        if not len(self.hashes):
            return np.full(len(names), -1)
        first, last = np.searchsorted(self.hashes, hashes), np.searchsorted(self.hashes, hashes, "right")
        out = np.full(len(names), -1)
        for i in np.flatnonzero(first < last).tolist():
            for k in range(int(first[i]), int(last[i])):
                if self.terms[self.term_ends[k - 1] if k else 0 : self.term_ends[k]] == names[i]:
                    out[i] = k
        return out

    def phrases(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For phrases (rows of term numbers): all occurrences inside single texts, as phrase and first position."""
        empty = np.zeros(0, np.int64), np.zeros(0, np.int64)
        live = np.flatnonzero((terms >= 0).all(1))
        if not len(live):
            return empty
        counts = self.counts[terms[live]]
        order = np.argsort(counts, axis=1, kind="stable")
        rare = order[:, 0]
        term = terms[live, rare]
        phrase = np.repeat(np.arange(len(live)), self.counts[term])
        start = self.positions[repeat_ranges(self.first[term], self.counts[term])] - rare[phrase]
        width = terms.shape[1]
        doc = np.searchsorted(self.bounds, start, "right")
        ok = (start >= 0) & (start + width <= self.bounds[np.minimum(doc, len(self.bounds) - 1)])
        phrase, start = phrase[ok], start[ok]
        for k in range(1, width):
            if not len(start):
                return empty
            place = order[phrase, k]
            want = terms[live[phrase], place] * self.n + start + place
            at = np.minimum(np.searchsorted(self.postings, want), len(self.postings) - 1)
            ok = self.postings[at] == want
            phrase, start = phrase[ok], start[ok]
        return live[phrase], start

    def near(self, terms: list[int], slop: int) -> list[tuple[int, int, int]]:
        """Smallest spans, as text, first and last position, that hold all terms in any order and at most slop other words."""
        if not terms or min(terms) < 0:
            return []
        need = {t: terms.count(t) for t in terms}
        lists = [(t, self.positions[self.first[t] : self.first[t] + self.counts[t]]) for t in need]
        at = np.concatenate([p for _, p in lists])
        who = np.repeat([t for t, _ in lists], [len(p) for _, p in lists])
        order = np.argsort(at)
        at, who = at[order].tolist(), who[order].tolist()
        out, have, missing, lo = [], dict.fromkeys(need, 0), len(need), 0
        for hi, t in enumerate(who):
            have[t] += 1
            missing -= have[t] == need[t]
            while not missing:
                a, b = at[lo], at[hi]
                doc = int(np.searchsorted(self.bounds, a, "right")) - 1
                if have[who[lo]] == need[who[lo]]:  # no smaller span ends here
                    if b < self.bounds[doc + 1] and b - a + 1 <= len(terms) + slop:
                        out.append((doc, a - int(self.bounds[doc]), b - int(self.bounds[doc])))
                    missing += 1
                have[who[lo]] -= 1
                lo += 1
        return out


class QueryBlock:
    """Items cut into windows: distinct windows by length, and the items of each."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        raw, offsets = text_buffer(pa.array([t for _, t in items], pa.string()))
        raw = lower_ascii(raw)
        starts, ends, bounds = words(raw, offsets, ALNUM)
        data = raw.tobytes()
        names = [data[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        number: dict[bytes, int] = {}
        ids = [number.setdefault(x, len(number)) for x in names]
        self.items = [i for i, _ in items]
        self.names = list(number)
        sizes = np.array([len(x) for x in self.names], np.int64)
        self.hashes = span_hashes(np.frombuffer(b"".join(self.names), np.uint8), np.cumsum(sizes) - sizes, np.cumsum(sizes)) if sizes.size else np.zeros(0, np.uint64)
        found: dict[int, dict[tuple, set]] = {}
        for k, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
            width = min(window, b - a)
            for s in range(a, b - width + 1) if width else ():
                found.setdefault(width, {}).setdefault(tuple(ids[s : s + width]), set()).add(k)
        self.windows = []
        for width, by in sorted(found.items()):
            owners = list(by.values())
            self.windows.append((np.array(list(by), np.int64).reshape(-1, width), np.cumsum([0, *map(len, owners)]), np.array([k for o in owners for k in sorted(o)], np.int64)))


def _hits(row: dict, q: QueryBlock) -> pa.RecordBatch:
    """One row per text of a shard. What the search holds goes before the next shard is opened."""
    shard = Shard(row)
    ids = shard.term_ids(q.names, q.hashes)
    edge, owned = np.zeros(shard.n + 1, np.int32), []
    for terms, first, owners in q.windows:
        phrase, start = shard.phrases(ids[terms])
        np.add.at(edge, start, 1)
        np.add.at(edge, start + terms.shape[1], -1)
        n = first[phrase + 1] - first[phrase]
        doc = np.searchsorted(shard.bounds, start, "right") - 1
        owned.append(np.unique(np.repeat(doc, n) * len(q.items) + owners[repeat_ranges(first[phrase], n)]))
    hit = (np.cumsum(edge[:-1]) > 0).astype(np.int8)
    docs = len(shard.doc_ids)
    edges = np.diff(hit, prepend=np.int8(0), append=np.int8(0))
    # a span stops where its text does
    inner = shard.bounds[1:-1]
    inner = np.unique(inner[(inner > 0) & (inner < shard.n)])
    cuts = inner[(hit[inner - 1] == 1) & (hit[inner] == 1)] if len(inner) else inner
    a, b = np.sort(np.r_[np.flatnonzero(edges == 1), cuts]), np.sort(np.r_[np.flatnonzero(edges == -1), cuts])
    doc = np.searchsorted(shard.bounds, a, "right") - 1
    pairs = pa.StructArray.from_arrays([pa.array(a - shard.bounds[doc]), pa.array(b - shard.bounds[doc])], ["a", "b"])
    spans = pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(docs + 1)), pa.int32()), pairs)
    items: list[list[str]] = [[] for _ in range(docs)]
    for x in np.unique(np.concatenate(owned)).tolist() if owned else ():
        items[x // len(q.items)].append(q.items[x % len(q.items)])
    columns = [pa.array([row["shard"]] * docs, pa.int64()), pa.array(range(docs), pa.int32()), pa.array(shard.doc_ids, pa.int64()), pa.array(row["n_words"], pa.int64()), spans, pa.array(items, pa.list_(pa.string()))]
    return pa.RecordBatch.from_arrays(columns, names=["shard", "place", "doc_id", "n_words", "spans", "items"])


def _search(index: DataFrame, block: QueryBlock) -> DataFrame:
    """One row per text: shard, place, doc_id, n_words, spans (words hit, from a up to b) and items."""
    held = index.sparkSession.sparkContext.broadcast(block)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                yield _hits({name: batch.column(i)[k].as_py() for i, name in enumerate(_NAMES)}, held.value)

    return index.mapInArrow(tidy(search), "shard long, place int, doc_id long, n_words long, spans array<struct<a: long, b: long>>, items array<string>")


def _united(spans):
    """Spans of several passes, as disjoint ascending ones."""
    kind = "array<struct<a: long, b: long>>"

    def step(out, x):
        last = F.try_element_at(out, F.lit(-1))
        joined = F.concat(F.slice(out, 1, F.size(out) - 1), F.array(F.struct(last.a.alias("a"), F.greatest(last.b, x.b).alias("b"))))
        return F.when((F.size(out) > 0) & (x.a < last.b), joined).otherwise(F.concat(out, F.array(x)))

    return F.aggregate(F.array_sort(F.flatten(spans)), F.array().cast(kind), step)


def query_blocks(items: DataFrame, window: int, id_col: str, text_col: str, query_bytes: int) -> list[QueryBlock]:
    """The stated query set, in blocks of bounded size. Items without words fall out; a null id is written null."""
    rows = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("i"), F.col(text_col).cast("string").alias("t")).where(F.col("t").isNotNull())
    out: list[QueryBlock] = []
    held: list[tuple[str, str]] = []
    size = 0
    for i, t in rows.toLocalIterator():
        if held and size + len(t) * 4 > query_bytes:
            out.append(QueryBlock(held, window))
            held, size = [], 0
        held.append((i, t))
        size += len(t) * 4
    return [*out, QueryBlock(held, window)]


def contamination(docs: DataFrame, items: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", query_bytes: int = QUERY_BYTES) -> DataFrame:
    """For every row of docs: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items and spans (words hit).

    Words are runs of digits, letters a-z and characters beyond ASCII, after lower-casing A-Z. An item's
    windows are its runs of `window` words (all its words if fewer). A word is hit if it lies inside an occurrence of a
    window. Null or empty texts have no words; items without words match nothing; items of one
    id count once; repeated documents are judged each by itself.
    """
    spark: SparkSession = ready(docs.sparkSession)
    index = build_index(docs, id_col, text_col)
    passes = [_search(index, b) for b in query_blocks(items, window, item_col, item_text_col, query_bytes)]
    if len(passes) == 1:
        found = passes[0].withColumn("items", F.array_sort(F.array_distinct("items")))
    else:
        rows = passes[0]
        for p in passes[1:]:
            rows = rows.unionByName(p)
        found = rows.groupBy("shard", "place").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), _united(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x.b - x.a)
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"), "items", "spans")


def proximity(docs: DataFrame, items: DataFrame, slop: int = 0, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", query_bytes: int = QUERY_BYTES) -> DataFrame:
    """doc_id, item and spans (words from a up to b): the smallest spans of a text that hold all words of an item, as often as it
    does and in any order, and at most slop other words.

    One row for each row of docs and item with such a span. Words, nulls and repeated documents are as in contamination();
    items of one id with different texts are judged each.
    """
    ready(docs.sparkSession)
    index = build_index(docs, id_col, text_col)
    passes = [_near(index, b, slop) for b in query_blocks(items, 1 << 30, item_col, item_text_col, query_bytes)]
    found = passes[0]
    for p in passes[1:]:
        found = found.unionByName(p)
    return found


def _near(index: DataFrame, block: QueryBlock, slop: int) -> DataFrame:
    held = index.sparkSession.sparkContext.broadcast(block)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = held.value
        for batch in batches:
            for k in range(batch.num_rows):
                shard = Shard({name: batch.column(i)[k].as_py() for i, name in enumerate(_NAMES)})
                ids = shard.term_ids(q.names, q.hashes)
                for terms, first, owners in q.windows:
                    for row in range(len(terms)):
                        by: dict[int, list[dict]] = {}
                        for doc, a, b in shard.near(ids[terms[row]].tolist(), slop):
                            by.setdefault(doc, []).append({"a": a, "b": b + 1})
                        out = [(shard.doc_ids[d], q.items[x], spans) for d, spans in by.items() for x in owners[first[row] : first[row + 1]].tolist()]
                        if out:
                            kinds = (pa.int64(), pa.string(), pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())])))
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["doc_id", "item", "spans"])

    return index.mapInArrow(tidy(search), "doc_id long, item string, spans array<struct<a: long, b: long>>")
