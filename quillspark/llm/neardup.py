"""Near-duplicate documents by bottom-k sketches from one hash function.

A document's sketch is the k smallest hashes of its distinct word shingles.  Texts with equal sets
are first folded into one class, so thousands of copies cost no more than one.  The classes'
retained values form inverted lists, each list being of some values that stand next to each other in a sketch: single values are
held by very many unrelated texts, neighbours hardly ever.  Sets with the wanted similarity of 0.8 or more hold neighbours
in common.  If they are no larger than the sketch they always share two: at most a fifth of the union's values stand between the four fifths
that both hold.  Larger sets share three but for a chance of 5e-8 (no run of three in 48 values of which both hold 0.8); so small sets
are listed by twos, large ones by threes, and those in between by both.  Below 0.8, lists are of single values.  Lists are cut by
classes of set size, two for each document, so that documents whose sizes alone forbid a link do not meet.

Links inside a list are found without all pairs.  First every member is compared with the list's
pivot, its smallest document.  Pairs pass a size bound and an estimate from
the sketch of the union and are then verified on their full sets.  After the components of these links only
members in other components than their pivot (strays) are open.  They are compared with all
members of other components: pair by pair in small families, in larger ones block against block, on sketches first.  A
cell of two blocks gives its likely pairs, or, where there are many, its documents for a comparison on full sets of which only a
spanning forest of the links leaves the task.  So components are those of all links.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.bytesnp import NOT_BLANK, blocks, lower_ascii, shingle_hashes, span_hashes, text_buffer, tidy, words
from quillspark.llm.components import components
from quillspark.llm.packed import packed_of, unpack
from quillspark.session import discard, ready, release, written

SKETCH = 48
#: From this similarity on, lists are of neighbouring values.
NEIGHBOURS_FROM = 80
#: Up to so many pairs of a pivot's strays and members go one by one; beyond that they meet in blocks of so many documents.
PAIRS = 256
BLOCK_MEMBERS = 512


def least_shared(k: int, percent: int) -> int:
    """Sketches of sets with the wanted similarity share as many values (for sets above k: but for chances below 1e-8)."""
    p = percent / 100
    return max(1, math.floor(k * p - 6 * math.sqrt(k * p * (1 - p))))


def shingle_sets(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes (int64) of its shingles of width lower-cased words; a text of fewer words has its whole sequence as one."""
    raw, offsets = text_buffer(column)
    for a, b in blocks(offsets):
        part, off = lower_ascii(raw[offsets[a] : offsets[b]]), offsets[a : b + 1] - offsets[a]
        starts, ends, bounds = words(part, off, NOT_BLANK)
        h = span_hashes(part, starts, ends)
        wide = shingle_hashes(h, width).view(np.int64)
        for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if e - s >= width:
                yield np.unique(wide[s : e - width + 1])
            elif e > s:
                yield shingle_hashes(h[s:e], e - s).view(np.int64)
            else:
                yield np.zeros(0, np.int64)


def sketches(docs: DataFrame, width: int, k: int = SKETCH) -> DataFrame:
    """From (id, text): id, n (distinct shingles), f1 and f2 (digest of the whole set), sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, f1, f2, kept = [], [], [], []
            for s in shingle_sets(batch.column(1), width):
                d = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
                sizes.append(len(s))
                f1.append(int.from_bytes(d[:8], "little", signed=True))
                f2.append(int.from_bytes(d[8:], "little", signed=True))
                kept.append(s[:k])
            ends = np.r_[0, np.cumsum([len(x) for x in kept])].astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(kept) if kept else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), lists], names=["id", "n", "f1", "f2", "sketch"])

    return docs.mapInArrow(tidy(run), "id long, n long, f1 long, f2 long, sketch array<long>")


def estimate(a: Column, b: Column, k: int) -> Column:
    """Share of the union's sketch that both sketches hold."""
    union = F.slice(F.array_sort(F.array_union(a, b)), 1, k)
    return F.size(F.array_intersect(union, F.array_intersect(a, b))) / F.size(union)


def verified(pairs: DataFrame, docs: DataFrame, sketched: DataFrame, width: int, percent: int, k: int) -> DataFrame:
    """Of the pairs (x, y), those whose full sets have the similarity. sketched: id, n, sketch; docs: id, text."""
    lean = sketched.select("id", "sketch")
    one = lean.select(F.col("id").alias("x"), F.col("sketch").alias("sx"))
    two = lean.select(F.col("id").alias("y"), F.col("sketch").alias("sy"))
    near = pairs.join(one, "x").join(two, "y")
    near = written(near.where(estimate(F.col("sx"), F.col("sy"), k) >= least_shared(k, percent) / k).select("x", "y"), "candidates")
    texts = packed_of(docs, near.select(F.explode(F.array("x", "y")).alias("id")))
    full = near.join(texts.select(F.col("id").alias("x"), F.col("packed").alias("tx")), "x")
    full = full.join(texts.select(F.col("id").alias("y"), F.col("packed").alias("ty")), "y").select("x", "y", "tx", "ty")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = max(1, min(batch.num_rows, (2 << 20) * batch.num_rows // max(1, batch.nbytes)))
            for a in range(0, batch.num_rows, step):
                part = batch.slice(a, step)
                keep = []
                ys, last, set_y = part.column(1).to_pylist(), None, None
                # neighbouring rows often have the same y; its set is made once
                new = [i for i, y in enumerate(ys) if i == 0 or y != ys[i - 1]]
                y_sets = shingle_sets(unpack(part.column(3).take(pa.array(new, pa.int32()))), width)
                for y, s in zip(ys, shingle_sets(unpack(part.column(2)), width), strict=True):
                    if set_y is None or y != last:
                        last, set_y = y, next(y_sets)
                    both = len(np.intersect1d(s, set_y, assume_unique=True))
                    keep.append(100 * both >= percent * (len(s) + len(set_y) - both) and both > 0)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], names=["x", "y"]).filter(pa.array(keep, pa.bool_()))

    return written(full.mapInArrow(tidy(compare), "x long, y long"), "links")


def _shared_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """|intersection| of each set on the left with each on the right, through the values that both sides hold."""
    out = np.zeros((len(left), len(right)), np.float32)
    if not left or not right:
        return out
    rows, cols = (np.repeat(np.arange(len(x)), [len(v) for v in x]) for x in (left, right))
    a, b = np.concatenate(left), np.concatenate(right)
    common = np.intersect1d(np.unique(a), np.unique(b), assume_unique=True)
    for at in range(0, len(common), 2048):
        part = common[at : at + 2048]
        grids = []
        for values, owner, n in ((a, rows, len(left)), (b, cols, len(right))):
            place = np.minimum(np.searchsorted(part, values), len(part) - 1)
            hit = part[place] == values
            grid = np.zeros((n, len(part)), np.float32)
            grid[owner[hit], place[hit]] = 1
            grids.append(grid)
        out += grids[0] @ grids[1].T
    return out


CELL = ("pivot", "i", "j")
CELL_SCHEMA = "pivot long, i int, j int, side boolean, id long, comp long, x long, y long"


def blocks_of(family: DataFrame, block: int) -> DataFrame:
    """Deals a family (pivot, id, comp, stray, m members, s strays) into cells: every block of strays (side) meets every block of members."""
    ns, nm = (F.ceil(F.col(c) / block).cast("int") for c in ("s", "m"))
    rows = family.select("pivot", "id", "comp", "stray", ns.alias("ns"), nm.alias("nm"))
    own = F.pmod(F.xxhash64("id"), F.col("nm")).cast("int")
    members = rows.select("pivot", "id", "comp", F.lit(False).alias("side"), F.explode(F.sequence(F.lit(0), F.col("ns") - 1)).alias("i"), own.alias("j"))
    strays = rows.where("stray").select("pivot", "id", "comp", F.lit(True).alias("side"), F.pmod(F.xxhash64("id", F.lit(1)), F.col("ns")).cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.col("nm") - 1)).alias("j"))
    return members.unionByName(strays).select(*CELL, "side", "id", "comp")


def sifted(cells: DataFrame, heads: DataFrame, least: int, percent: int) -> DataFrame:
    """Pairs (x, y) of different components in a cell whose sketches share enough values; where these are more than a few per document,
    the cell's documents that have such a partner instead. So what leaves a cell is in proportion to its documents."""

    def sift(table: pa.Table) -> pa.Table:
        side, ids, comps = (np.asarray(table.column(c)) for c in ("side", "id", "comp"))
        sets = [np.asarray(x.values) for x in table.column("sketch").combine_chunks()]
        s, m = np.flatnonzero(side), np.flatnonzero(~side)
        shared = _shared_counts([sets[i] for i in s], [sets[i] for i in m])
        size = np.array([len(x) for x in sets])
        enough = np.minimum(least, -(-percent * np.maximum(size[s][:, None], size[m][None, :]) // 100))
        good = (shared >= enough) & (comps[s][:, None] != comps[m][None, :])
        x, y = np.nonzero(good)
        if len(x) <= 4 * len(ids):
            keep = ids[s[x]] != ids[m[y]]
            low, high = np.minimum(ids[s[x]], ids[m[y]])[keep], np.maximum(ids[s[x]], ids[m[y]])[keep]
            n = len(low)
            return pa.table({**{c: pa.nulls(n, t) for c, t in (("pivot", pa.int64()), ("i", pa.int32()), ("j", pa.int32()), ("side", pa.bool_()), ("id", pa.int64()), ("comp", pa.int64()))}, "x": pa.array(low), "y": pa.array(high)})
        rows = np.concatenate([s[good.any(1)], m[good.any(0)]])
        out = table.select([*CELL, "side", "id", "comp"]).take(pa.array(rows))
        return out.append_column("x", pa.nulls(len(rows), pa.int64())).append_column("y", pa.nulls(len(rows), pa.int64()))

    with_sketch = cells.join(heads.select("id", "sketch"), "id").select(*CELL, "side", "id", "comp", "sketch")
    return written(with_sketch.groupBy(*CELL).applyInArrow(sift, CELL_SCHEMA), "sifted")


def links_in_cells(cells: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Links between different components inside cells, on full sets; a spanning forest of them leaves the task, never all."""

    def link(table: pa.Table) -> pa.Table:
        sides = np.asarray(table.column("side"))
        ids, comps = np.asarray(table.column("id")), np.asarray(table.column("comp"))
        sets = list(shingle_sets(unpack(table.column("packed").combine_chunks()), width))
        s, m = np.flatnonzero(sides), np.flatnonzero(~sides)
        shared = _shared_counts([sets[i] for i in s], [sets[i] for i in m])
        n = np.array([len(x) for x in sets])
        good = (100 * shared >= percent * (n[s][:, None] + n[m][None, :] - shared)) & (shared > 0) & (comps[s][:, None] != comps[m][None, :])
        top: dict[int, int] = {}

        def find(x: int) -> int:
            while top.setdefault(x, x) != x:
                top[x] = top[top[x]]
                x = top[x]
            return x

        x_out, y_out = [], []
        for i, j in zip(*(v.tolist() for v in np.nonzero(good)), strict=True):
            x, y = find(int(comps[s[i]])), find(int(comps[m[j]]))
            if x != y:
                top[x] = y
                x_out.append(int(ids[s[i]]))
                y_out.append(int(ids[m[j]]))
        return pa.table({"x": pa.array(x_out, pa.int64()), "y": pa.array(y_out, pa.int64())})

    full = cells.join(texts, "id").select(*CELL, "side", "id", "comp", "packed")
    return written(full.groupBy(*CELL).applyInArrow(link, "x long, y long"), "links")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, k: int = SKETCH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id and kept (doc_id = component_id).

    Documents are linked if 100 * |intersection| >= percent * |union| of their shingle sets; component_id is the smallest id
    that a document is connected with. Words are runs without ASCII blanks, A-Z lower-cased. Texts that are null or
    have no words have no shingles and are linked with nothing. Rows with one id count as one document, judged by
    the smallest of its texts. A null id is linked with nothing, has a null component and is kept.
    """
    spark = ready(docs.sparkSession)
    everything = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    ids = everything.where("id is not null").select("id")
    nameless = sketches(everything.where("id is null"), width, k)
    texts = everything.where("id is not null")
    repeats = bool(ids.groupBy("id").count().where("count > 1").take(1))
    if repeats:
        texts = written(texts.groupBy("id").agg(F.min("text").alias("text")), "once")
    rows = written(sketches(texts, width, k), "sketches")
    classes = rows.where("n > 0").groupBy("n", "f1", "f2").agg(F.min("id").alias("rep"))
    members = written(rows.select("id", "n", "f1", "f2").join(classes, ["n", "f1", "f2"], "left").select("id", "n", F.coalesce("rep", "id").alias("rep")), "members")
    chosen = members.where("n > 0 and id = rep").select("id")
    heads = written(rows.join(chosen, "id", "left_semi").select("id", "n", "sketch"), "heads")
    discard(rows)

    # inverted lists of neighbouring retained values, cut by size
    if percent >= NEIGHBOURS_FROM:
        at = lambda i, n: F.slice("sketch", F.lit(i), F.greatest(F.size("sketch") - (n - 1), F.lit(0)))
        twos = F.zip_with(at(1, 2), at(2, 2), lambda a, b: F.xxhash64(a, b))
        threes = F.zip_with(F.zip_with(at(1, 3), at(2, 3), lambda a, b: F.xxhash64(a, b)), at(3, 3), lambda a, b: F.xxhash64(a, b))
        none = F.array().cast("array<long>")
        value = F.concat(F.when(F.col("n") * percent <= 100 * k, twos).otherwise(none), F.when(F.col("n") > k, threes).otherwise(none))
    else:
        value = F.col("sketch")
    values = heads.select("id", "n", F.explode(value).alias("value"))
    common = values.groupBy("value").agg(F.count("*").alias("df")).where("df > 1").select("value")
    size_class = F.floor(F.log("n") / math.log(101 / percent)).cast("int")  # sizes that allow a link are at most one class apart
    lists = values.join(common, "value").select("id", "n", F.explode(F.array(size_class, size_class + 1)).alias("c"), "value")
    lists = written(lists.select("id", "n", F.xxhash64("value", "c").alias("value")), "lists")
    fits = lambda a, b: 100 * F.least(a, b) >= percent * F.greatest(a, b)
    pivots = lists.groupBy("value").agg(F.min(F.struct("id", "n")).alias("p"), F.count("*").alias("size")).where("size > 1").select("value", F.col("p.id").alias("pivot"), F.col("p.n").alias("np"))
    pivots = written(pivots, "pivots")
    stars = lists.join(pivots, "value").where((F.col("id") != F.col("pivot")) & fits("n", "np")).select(F.col("id").alias("x"), F.col("pivot").alias("y")).distinct()
    release(spark)
    links = verified(stars, texts, heads, width, percent, k)
    release(spark)
    comps = components(links)

    # what the pivots left open: members of a pivot's lists in different components
    placed = lists.join(comps, lists.id == comps.v, "left").select("value", "id", "n", F.coalesce("c", "id").alias("comp"))
    pivot_comp = pivots.join(comps, pivots.pivot == comps.v, "left").select("value", "pivot", F.coalesce("c", "pivot").alias("pivot_comp"))
    placed = placed.join(pivot_comp, "value").where("id != pivot")
    placed = written(placed.select("value", "pivot", "id", "n", "comp", (F.col("comp") != F.col("pivot_comp")).alias("stray")), "placed")
    discard(lists)
    discard(pivots)
    family = written(placed.select("pivot", "id", "comp", "stray").distinct(), "family")
    sizes = family.groupBy("pivot").agg(F.count("*").alias("m"), F.count_if("stray").alias("s")).where("s > 0 and m > 1")
    sizes = written(sizes, "sizes")
    few = placed.join(sizes.where(F.col("m") * F.col("s") <= PAIRS).select("pivot"), "pivot", "left_semi")
    strays = few.where("stray").select("value", F.col("id").alias("x"), F.col("n").alias("nx"), F.col("comp").alias("cx"))
    rest = few.select("value", F.col("id").alias("y"), F.col("n").alias("ny"), F.col("comp").alias("cy"), "stray")
    pairs = strays.join(rest, "value").where("cx != cy and (not stray or x < y)").where(fits("nx", "ny"))
    many = family.join(sizes.where(F.col("m") * F.col("s") > PAIRS), "pivot")
    found = sifted(blocks_of(many, BLOCK_MEMBERS), heads, least_shared(k, percent), percent)
    release(spark)
    pairs = pairs.select("x", "y").unionByName(found.where("x is not null").select("x", "y"))
    more = verified(pairs.distinct(), texts, heads, width, percent, k)
    release(spark)
    dense = found.where("x is null").drop("x", "y")
    if dense.take(1):
        more = more.unionByName(links_in_cells(dense, packed_of(texts, dense.select("id")), width, percent))
        release(spark)
    if more.take(1):
        comps = components(links.unionByName(more))
    for table in (heads, placed, family, sizes, found):  # the result is read from members and components
        discard(table)

    found = members.join(comps, members.rep == comps.v, "left").select("id", "n", F.coalesce("c", "rep").alias("comp"))
    if repeats:
        found = ids.join(found, "id")
    out = found.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("comp").alias("component_id"), (F.col("id") == F.col("comp")).alias("kept"))
    return out.unionByName(nameless.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.lit(None).cast("long").alias("component_id"), F.lit(True).alias("kept")))
