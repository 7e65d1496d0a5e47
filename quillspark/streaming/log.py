"""Partitioned logs: reads, compaction, retention, replication, consumer groups.

A log is a DataFrame of topic, partition, offset, timestamp (ms), key and value; segments are a column.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def read_from(log: DataFrame, partition: int, offset: int, limit: int) -> DataFrame:
    return log.where((F.col("partition") == partition) & (F.col("offset") >= offset)).orderBy("offset").limit(limit)


def end_offsets(log: DataFrame) -> DataFrame:
    return log.groupBy("topic", "partition").agg((F.max("offset") + 1).alias("end_offset"))


def compacted(log: DataFrame, key: str, offset: str, active: Column | None = None) -> DataFrame:
    """The newest record of each key; records without a key, and those of active segments, stay."""
    newest = log.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(offset).alias("__top"))
    keep = F.col("__top").isNull() | (F.col(offset) == F.col("__top"))
    if active is not None:
        keep = keep | active
    return log.join(newest, key, "left").where(keep).select(*log.columns)


def without_old_tombstones(log: DataFrame, key: str, value: str, ts: str, now: int, retention: int) -> DataFrame:
    tomb = F.col(key).isNotNull() & F.col(value).isNull()
    return log.where(~(tomb & (F.lit(now) - F.col(ts) > retention)))


def tombstones(log: DataFrame, key: str, value: str) -> DataFrame:
    return log.agg(F.count_if(F.col(key).isNotNull() & F.col(value).isNull()).alias("tombstones"))


def retained_by_time(log: DataFrame, segment: str, ts: str, now: int, retention: int, active: int | None = None) -> DataFrame:
    """Segments whose newest record is young enough, and the active one."""
    seg = log.groupBy(segment).agg(F.max(ts).alias("__newest"))
    keep = F.lit(now) - F.col("__newest") <= retention
    if active is not None:
        keep = keep | (F.col(segment) == active)
    return log.join(seg.where(keep).select(segment), segment, "left_semi")


def retained_by_size(log: DataFrame, segment: str, size: Column, limit: int) -> DataFrame:
    """The newest segments whose sizes together stay within limit, the newest one in any case.

    The running sum is over one row per segment.
    """
    seg = log.groupBy(segment).agg(F.sum(size).alias("__bytes"))
    run = F.sum("__bytes").over(Window.orderBy(F.col(segment).desc()))
    first = F.max(segment).over(Window.partitionBy(F.lit(0)))
    keep = seg.withColumns({"__run": run, "__first": first}).where((F.col("__run") <= limit) | (F.col(segment) == F.col("__first")))
    return log.join(keep.select(segment), segment, "left_semi")


def dirty_ratio(log: DataFrame, key: str) -> DataFrame:
    """Share of keyed records that a newer one supersedes, over all records."""
    per = log.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"))
    old = per.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("superseded"))
    return log.agg(F.count("*").alias("total")).crossJoin(old).select("total", "superseded", (F.col("superseded") / F.greatest("total", F.lit(1))).alias("dirty_ratio"))


def lag(end: Column, committed: Column) -> Column:
    """Records not consumed; a negative committed offset is none."""
    return F.when(committed < 0, end).otherwise(F.greatest(F.lit(0), end - committed))


def committed_offsets(commits: DataFrame) -> DataFrame:
    return commits.groupBy("group_id", "topic", "partition").agg(F.max_by("offset", "commit_seq").alias("committed"))


def assign_range(partitions: DataFrame, members: list[str], order: list[str]) -> DataFrame:
    """Neighbouring partitions to one member; the first members take one more if there is a remainder."""
    n = len(members)
    ranked = partitions.withColumn("i", F.row_number().over(Window.orderBy(*order)) - 1).withColumn("total", F.count("*").over(Window.partitionBy(F.lit(0))))
    base, more = F.floor(F.col("total") / n), F.col("total") % n
    member = F.when(F.col("i") < more * (base + 1), F.floor(F.col("i") / (base + 1))).otherwise(more + F.floor((F.col("i") - more * (base + 1)) / F.greatest(base, F.lit(1))))
    names = F.array(*[F.lit(m) for m in members])
    return ranked.withColumn("member", F.element_at(names, member.cast("int") + 1)).drop("i", "total")


def assign_round_robin(partitions: DataFrame, members: list[str], order: list[str]) -> DataFrame:
    names = F.array(*[F.lit(m) for m in members])
    i = F.row_number().over(Window.orderBy(*order)) - 1
    return partitions.withColumn("member", F.element_at(names, (i % len(members)).cast("int") + 1))


def high_watermark(replicas: DataFrame, keys: list[str], previous: int = 0) -> DataFrame:
    """Smallest end offset of the in-sync replicas, never below the previous one; replicas in sync and status."""
    agg = replicas.groupBy(*keys).agg(F.greatest(F.lit(previous), F.coalesce(F.min(F.when(F.col("in_sync"), F.col("leo"))), F.lit(previous))).alias("high_watermark"), F.count_if("in_sync").alias("in_sync"), F.count("*").alias("replicas"))
    status = F.when(F.col("in_sync") == F.col("replicas"), "HEALTHY").when(F.col("in_sync") > 1, "DEGRADED").otherwise("UNDER_REPLICATED")
    return agg.withColumn("status", status)


def truncation_offset(follower_end: Column, leader_watermark: Column) -> Column:
    return F.least(follower_end, leader_watermark)


def elect(votes: DataFrame) -> DataFrame:
    """votes: voter, candidate, cast_seq. A voter's first vote counts; most votes win, ties go to the smallest candidate."""
    first = votes.groupBy("voter").agg(F.min_by("candidate", "cast_seq").alias("candidate"))
    return first.groupBy("candidate").agg(F.count("*").alias("votes")).orderBy(F.desc("votes"), "candidate").limit(1)


@dataclass(frozen=True)
class CleanerConfig:
    """What a cleaner keeps: policy time (retention_ms), size (max_bytes) or compact."""

    policy: str
    retention_ms: int = 0
    max_bytes: int = 0
    tombstone_ms: int = 0

    def __post_init__(self) -> None:
        if self.policy not in ("time", "size", "compact") or (self.policy == "time" and self.retention_ms <= 0) or (self.policy == "size" and self.max_bytes <= 0):
            raise ValueError(f"not a cleaner: {self}")


def clean(log: DataFrame, config: CleanerConfig, now: int, segment: str = "segment", key: str = "key", value: str = "value", ts: str = "timestamp", offset: str = "offset", size: Column | None = None) -> DataFrame:
    """What one cleaner cycle leaves of a log."""
    if config.policy == "time":
        return retained_by_time(log, segment, ts, now, config.retention_ms)
    if config.policy == "size":
        return retained_by_size(log, segment, F.lit(1) if size is None else size, config.max_bytes)
    return without_old_tombstones(compacted(log, key, offset), key, value, ts, now, config.tombstone_ms)
