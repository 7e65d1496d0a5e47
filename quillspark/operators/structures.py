"""List, set, sorted-set and hash structures as Column expressions and relational forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def lpush(items: Column, x: Column) -> Column:
    return F.concat(F.array(x), items)


def rpush(items: Column, x: Column) -> Column:
    return F.array_append(items, x)


def lpop(items: Column) -> tuple[Column, Column]:
    """The first element (null if none) and the rest."""
    return F.try_element_at(items, F.lit(1)), F.when(F.size(items) > 1, F.slice(items, 2, F.size(items))).otherwise(F.slice(items, 1, 0))


def rpop(items: Column) -> tuple[Column, Column]:
    n = F.size(items)
    return F.try_element_at(items, F.lit(-1)), F.slice(items, 1, F.greatest(n - 1, F.lit(0)))


def _index(n: Column, i: int) -> Column:
    return F.lit(i) if i >= 0 else F.greatest(n + i, F.lit(0))


def lrange(items: Column, start: int, stop: int) -> Column:
    """Inclusive slice; negative places count from the end."""
    n = F.size(items)
    a = _index(n, start)
    b = F.lit(stop) if stop >= 0 else n + stop
    b = F.least(b, n - 1)
    return F.when(b >= a, F.slice(items, a + 1, b - a + 1)).otherwise(F.slice(items, 1, 0))


def lindex(items: Column, i: int) -> Column:
    return F.try_element_at(items, F.lit(i + 1 if i >= 0 else i))


def sadd(items: Column, x: Column) -> Column:
    return F.array_union(items, F.array(x))


def srem(items: Column, x: Column) -> Column:
    return F.array_remove(items, x)


def sismember(items: Column, x: Column) -> Column:
    return F.array_contains(items, x)


sunion, sinter, scard, llen = F.array_union, F.array_intersect, F.size, F.size


def hset(m: Column, k: Column, v: Column) -> Column:
    return F.map_concat(F.map_filter(m, lambda a, _: a != k), F.create_map(k, v))


def hget(m: Column, k: Column) -> Column:
    return F.try_element_at(m, k)


def hdel(m: Column, k: Column) -> Column:
    return F.map_filter(m, lambda a, _: a != k)


hkeys, hvals, hgetall, hlen = F.map_keys, F.map_values, F.map_entries, F.size


def hexists(m: Column, k: Column) -> Column:
    return F.map_contains_key(m, k)


def zset(df: DataFrame, member: str, score: str, seq: str) -> DataFrame:
    """One row per member with its newest score."""
    return df.groupBy(member).agg(F.max_by(score, seq).alias(score))


def zrank(z: DataFrame, member: str, score: str, keys: list[str]) -> DataFrame:
    """Places from 0 by score, then member, within each sorted set."""
    return z.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(score, member)) - 1)


def zrange(z: DataFrame, member: str, score: str, keys: list[str], start: int, stop: int) -> DataFrame:
    ranked = zrank(z, member, score, keys)
    n = F.count("*").over(Window.partitionBy(*keys))
    a = F.lit(start) if start >= 0 else n + start
    b = F.lit(stop) if stop >= 0 else n + stop
    return ranked.withColumns({"__a": a, "__b": b}).where(F.col("rank").between(F.col("__a"), F.col("__b"))).drop("__a", "__b")


def zrangebyscore(z: DataFrame, score: str, low: float, high: float) -> DataFrame:
    return z.where(F.col(score).between(low, high))
