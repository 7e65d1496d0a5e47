"""Hash trees, consistent-hash rings, log recovery and cache simulations."""

from __future__ import annotations

from collections import OrderedDict

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.functions.codecs import ring_hash


def leaves(df: DataFrame, key: str, data: str) -> DataFrame:
    """(i, h): leaf hashes numbered by key. Numbers come from a two-step count, so no task sees all rows."""
    hashed = df.select(F.col(key).alias("k"), F.sha2(F.col(data).cast("string"), 256).alias("h"))
    ranged = hashed.repartitionByRange("k").sortWithinPartitions("k").withColumn("p", F.spark_partition_id())
    from quillspark.session import written

    ranged = written(ranged, "leaves")
    base = ranged.groupBy("p").agg(F.count("*").alias("n")).select("p", (F.sum("n").over(Window.orderBy("p")) - F.col("n")).alias("base"))
    place = F.row_number().over(Window.partitionBy("p").orderBy("k")) - 1
    return ranged.withColumn("r", place).join(F.broadcast(base), "p").select((F.col("base") + F.col("r")).alias("i"), "h")


def levels(leaf: DataFrame) -> list[DataFrame]:
    """All levels (i, h) from the leaves up; an odd last node moves up as it is. A parent hashes its children's raw bytes."""
    from quillspark.session import written

    out = [written(leaf, "level")]
    while out[-1].limit(2).count() > 1:
        pair = out[-1].groupBy(F.floor(F.col("i") / 2).alias("i")).agg(F.array_sort(F.collect_list(F.struct("i", "h"))).alias("c"))
        both = F.sha2(F.unhex(F.concat(F.col("c")[0].h, F.col("c")[1].h)), 256)
        out.append(written(pair.select("i", F.when(F.size("c") == 2, both).otherwise(F.col("c")[0].h).alias("h")), "level"))
    return out


def root(leaf: DataFrame) -> DataFrame:
    return levels(leaf)[-1].select(F.col("h").alias("root"))


def proof(tree: list[DataFrame], i: int) -> list[tuple[str, bool]]:
    """Sibling hashes from leaf i up, and whether each stands on the right."""
    out = []
    for level in tree[:-1]:
        sibling = level.where(F.col("i") == (i ^ 1)).select("h").first()
        if sibling:
            out.append((sibling[0], i % 2 == 0))
        i //= 2
    return out


def verify(leaf_hash: str, path: list[tuple[str, bool]], root_hash: str) -> bool:
    import hashlib

    h = leaf_hash
    for sibling, right in path:
        h = hashlib.sha256(bytes.fromhex(h + sibling if right else sibling + h)).hexdigest()
    return h == root_hash


def differing(a: DataFrame, b: DataFrame) -> DataFrame:
    """Leaf numbers whose hashes differ or that one side lacks."""
    x, y = a.select("i", F.col("h").alias("ha")), b.select("i", F.col("h").alias("hb"))
    return x.join(y, "i", "full_outer").where(~F.col("ha").eqNullSafe(F.col("hb"))).select("i")


def ring(nodes: list[str], replicas: int = 128) -> list[tuple[int, str]]:
    """Places of all virtual nodes, ascending."""
    return sorted((ring_hash(f"{n}#{i}"), n) for n in nodes for i in range(replicas))


def locate(keys: DataFrame, key: str, nodes: list[str], replicas: int = 128, n: int = 1) -> DataFrame:
    """keys with owners: the next n distinct nodes clockwise. The ring has a row per virtual node, and is searched by halving."""
    import bisect

    places = ring(nodes, replicas)
    hashes = [h for h, _ in places]

    @F.pandas_udf("array<string>")
    def owners(k: pd.Series) -> pd.Series:
        out = []
        for x in k:
            at, found = bisect.bisect_left(hashes, ring_hash(x or "")), []
            for step in range(len(places)):
                name = places[(at + step) % len(places)][1]
                if name not in found:
                    found.append(name)
                    if len(found) == n:
                        break
            out.append(found)
        return pd.Series(out)

    return keys.withColumn("owners", owners(key))


def ring_load(located: DataFrame) -> DataFrame:
    """Keys of each first owner."""
    return located.groupBy(F.col("owners")[0].alias("node")).agg(F.count("*").alias("keys"))


def redo_and_undo(log: DataFrame, txn: str = "txn", kind: str = "kind", lsn: str = "lsn") -> tuple[DataFrame, DataFrame]:
    """Changes after the last checkpoint of committed transactions in order, and of others backwards."""
    last = log.where(F.col(kind) == "CHECKPOINT").agg(F.coalesce(F.max(lsn), F.lit(-1)).alias("c"))
    changes = log.where(F.col(kind) == "UPDATE").crossJoin(F.broadcast(last)).where(F.col(lsn) > F.col("c")).drop("c")
    done = log.where(F.col(kind) == "COMMIT").select(txn).distinct()
    return changes.join(done, txn, "left_semi").orderBy(lsn), changes.join(done, txn, "left_anti").orderBy(F.desc(lsn))


def lock_conflicts(locks: DataFrame) -> DataFrame:
    """locks: txn, rid, mode (S or X), start, end. Pairs that hold one resource at once and not both shared."""
    a, b = locks.alias("a"), locks.alias("b")
    on = (F.col("a.rid") == F.col("b.rid")) & (F.col("a.txn") < F.col("b.txn")) & (F.col("a.start") < F.col("b.end")) & (F.col("b.start") < F.col("a.end")) & ((F.col("a.mode") == "X") | (F.col("b.mode") == "X"))
    return a.join(b, on).select(F.col("a.txn").alias("first"), F.col("b.txn").alias("second"), F.col("a.rid").alias("rid"))


def _lru(trace, capacity: int) -> int:
    held: OrderedDict = OrderedDict()
    hits = 0
    for k in trace:
        if k in held:
            hits += 1
            held.move_to_end(k)
        else:
            if len(held) == capacity:
                held.popitem(last=False)
            held[k] = True
    return hits


def _lfu(trace, capacity: int) -> int:
    count: dict = {}
    last: dict = {}
    hits = 0
    for t, k in enumerate(trace):
        if k in count:
            hits += 1
            count[k] += 1
        else:
            if len(count) == capacity:
                out = min(count, key=lambda x: (count[x], -last[x]))  # the newest of the least used goes
                del count[out], last[out]
            count[k] = 1
        last[k] = t
    return hits


def _clock(trace, capacity: int) -> int:
    slots: list = []
    used: dict = {}
    hand = hits = 0
    for k in trace:
        if k in used:
            hits += 1
            used[k] = True
            continue
        if len(slots) < capacity:
            slots.append(k)
        else:
            while used[slots[hand]]:
                used[slots[hand]] = False
                hand = (hand + 1) % capacity
            del used[slots[hand]]
            slots[hand] = k
            hand = (hand + 1) % capacity
        used[k] = True
    return hits


POLICIES = {"lru": _lru, "lfu": _lfu, "clock": _clock}


def simulate_caches(trace: DataFrame, shard: str, order: str, key: str, capacity: int) -> DataFrame:
    """(shard, policy, accesses, hits): each shard's cache replays its own accesses in order, in one task a shard."""

    def run(k, p: pd.DataFrame) -> pd.DataFrame:
        keys = p.sort_values(order)[key].tolist()
        return pd.DataFrame([(k[0], name, len(keys), f(keys, capacity)) for name, f in POLICIES.items()], columns=["shard", "policy", "accesses", "hits"])

    kind = trace.schema[shard].dataType.simpleString()
    return trace.groupBy(shard).applyInPandas(run, f"shard {kind}, policy string, accesses long, hits long")


def quorum(placed: DataFrame, alive: list[str], need: int) -> DataFrame:
    """placed (with owners) with answers (owners that are alive) and whether they reach the quorum."""
    answers = F.size(F.array_intersect("owners", F.array(*[F.lit(n) for n in alive])))
    return placed.withColumn("answers", answers).withColumn("reached", F.col("answers") >= need)


def drain_hints(hints: DataFrame, node: str, most: int | None = None) -> tuple[DataFrame, DataFrame]:
    """hints: node, key, value, seq. Those for a node in order (at most so many), and what is left."""
    own = hints.where(F.col("node") == node).orderBy("seq")
    if most is None:
        return own, hints.where(F.col("node") != node)
    own = own.limit(most)
    return own, hints.join(own.select("node", "seq"), ["node", "seq"], "left_anti")
