"""Appending to partitioned logs, and consumer groups."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.functions.text import djb2_partition
from quillspark.streaming import log


def partitioned(records: DataFrame, key: str, partitions: int) -> DataFrame:
    """records with the partition that a producer sends them to: by the key's hash, 0 without a key."""
    return records.withColumn("partition", F.coalesce(djb2_partition(partitions)(key), F.lit(0)))


def append(existing: DataFrame, records: DataFrame, order: str) -> DataFrame:
    """existing (with offset) and records (partition and the other columns), which get the next offsets of their partitions in the given order.

    One partition is one sequence, so its records are numbered by one task; a topic's rows are spread over its partitions.
    """
    ends = existing.groupBy("partition").agg((F.max("offset") + 1).alias("__end"))
    place = F.row_number().over(Window.partitionBy("partition").orderBy(order)) - 1
    new = records.withColumn("__place", place).join(ends, "partition", "left").withColumn("offset", (F.coalesce("__end", F.lit(0)) + F.col("__place")).cast("long"))
    return existing.unionByName(new.select(*existing.columns))


@dataclass(frozen=True)
class Group:
    """A consumer group. Each change of members makes a new generation."""

    group_id: str
    members: tuple[str, ...] = ()
    beats: tuple[tuple[str, int], ...] = ()
    generation: int = 0
    strategy: str = "range"
    timeout_ms: int = 30_000

    def __post_init__(self) -> None:
        if self.strategy not in ("range", "round_robin"):
            raise ValueError(f"no strategy {self.strategy}")

    def _with(self, members: tuple[str, ...], beats: dict[str, int]) -> Group:
        return Group(self.group_id, members, tuple(sorted(beats.items())), self.generation + (members != self.members), self.strategy, self.timeout_ms)

    def join(self, member: str, now_ms: int = 0) -> Group:
        return self._with(self.members if member in self.members else (*self.members, member), {**dict(self.beats), member: now_ms})

    def leave(self, member: str) -> Group:
        return self._with(tuple(m for m in self.members if m != member), {m: t for m, t in self.beats if m != member})

    def heartbeat(self, member: str, now_ms: int) -> Group:
        if member not in self.members:
            raise ValueError(f"{member} is not in {self.group_id}")
        return self._with(self.members, {**dict(self.beats), member: now_ms})

    def expire(self, now_ms: int) -> Group:
        """Without the members whose last heartbeat is older than the timeout."""
        live = {m: t for m, t in self.beats if now_ms - t <= self.timeout_ms}
        return self._with(tuple(m for m in self.members if m in live), live)

    @property
    def state(self) -> str:
        return "STABLE" if self.members else "EMPTY"

    def assignment(self, partitions: DataFrame, order: list[str]) -> DataFrame:
        """partitions with their member; without members, null."""
        if not self.members:
            return partitions.withColumn("member", F.lit(None).cast("string"))
        deal = log.assign_range if self.strategy == "range" else log.assign_round_robin
        return deal(partitions, list(self.members), order)
