"""Key-value, document and wide-column reads over append-only version tables.

A version table has key, value, sequence number and tombstone columns; writing appends rows.  Reads
are aggregates with max_by, which combine before the shuffle, so a key with very many versions costs each task one row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


@dataclass(frozen=True)
class Versions:
    """A version table and the names of its columns."""

    df: DataFrame
    key: str = "k"
    value: str = "v"
    seq: str = "seqno"
    deleted: str = "is_deleted"

    def latest(self, snapshot: int | None = None) -> DataFrame:
        """Newest version of each key (at or below a snapshot), tombstones left out."""
        df = self.df if snapshot is None else self.df.where(F.col(self.seq) <= snapshot)
        top = df.groupBy(self.key).agg(F.max_by(F.struct(self.value, self.deleted, self.seq), self.seq).alias("__t"))
        return top.where(~F.col(f"__t.{self.deleted}")).select(self.key, F.col(f"__t.{self.value}").alias(self.value), F.col(f"__t.{self.seq}").alias(self.seq))

    def get(self, key: object, snapshot: int | None = None) -> DataFrame:
        """The key is filtered before versions are compared, so the filter reaches the scan."""
        return Versions(self.df.where(F.col(self.key) == F.lit(key)), self.key, self.value, self.seq, self.deleted).latest(snapshot)

    def scan(self, low=None, high=None, low_open: bool = False, high_open: bool = False, limit: int | None = None) -> DataFrame:
        """A range of keys in order, either bound open or absent."""
        df = self.df
        if low is not None:
            df = df.where(F.col(self.key) > F.lit(low) if low_open else F.col(self.key) >= F.lit(low))
        if high is not None:
            df = df.where(F.col(self.key) < F.lit(high) if high_open else F.col(self.key) <= F.lit(high))
        out = Versions(df, self.key, self.value, self.seq, self.deleted).latest().orderBy(self.key)
        return out if limit is None else out.limit(limit)

    def prefix(self, prefix: str, limit: int | None = None) -> DataFrame:
        df = self.df.where(F.col(self.key).startswith(prefix))
        out = Versions(df, self.key, self.value, self.seq, self.deleted).latest().orderBy(self.key)
        return out if limit is None else out.limit(limit)

    def put(self, rows: DataFrame) -> Versions:
        """rows: key, value, seq."""
        more = rows.select(self.key, self.value, self.seq, F.lit(False).alias(self.deleted))
        return Versions(self.df.select(*more.columns).unionByName(more), self.key, self.value, self.seq, self.deleted)

    def delete(self, rows: DataFrame) -> Versions:
        """rows: key, seq."""
        more = rows.select(self.key, F.lit(None).cast(self.df.schema[self.value].dataType).alias(self.value), self.seq, F.lit(True).alias(self.deleted))
        return Versions(self.df.select(*more.columns).unionByName(more), self.key, self.value, self.seq, self.deleted)

    def gc(self, oldest_snapshot: int) -> DataFrame:
        """Versions that some snapshot from the oldest on can still see."""
        nxt = F.lead(self.seq).over(Window.partitionBy(self.key).orderBy(self.seq))
        return self.df.withColumn("__next", nxt).where(F.col("__next").isNull() | (F.col("__next") > oldest_snapshot)).drop("__next")

    def compact(self, path: str, partitions: int | None = None) -> DataFrame:
        """Writes the newest versions as one sorted run, with bloom filters on the key, and returns it."""
        out = self.latest()
        ranged = out.repartitionByRange(partitions, self.key) if partitions else out.repartitionByRange(self.key)
        ranged.sortWithinPartitions(self.key).write.mode("overwrite").option(f"parquet.bloom.filter.enabled#{self.key}", "true").parquet(path)
        return self.df.sparkSession.read.parquet(path)


def merge_runs(runs: list[DataFrame], key: str, value: str) -> DataFrame:
    """Sorted runs merged; of equal keys the last run's value stays."""
    tagged = None
    for k, run in enumerate(runs):
        one = run.select(key, value, F.lit(k).alias("__run"))
        tagged = one if tagged is None else tagged.unionByName(one)
    return tagged.groupBy(key).agg(F.max_by(value, "__run").alias(value)).orderBy(key)


def live(ttl: Column, now: int) -> Column:
    """An absolute time to live in seconds; 0 is forever."""
    return (ttl == 0) | (ttl >= now)


def overlapping_runs(runs: DataFrame, low, high) -> DataFrame:
    """Of run metadata (run, min_key, max_key), those a leveled compaction takes along."""
    return runs.where((F.col("min_key") <= F.lit(high)) & (F.col("max_key") >= F.lit(low)))


def insert_unique(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not there yet, appended."""
    return table.unionByName(rows.dropDuplicates([key]).join(table.select(key), key, "left_anti").select(*table.columns))


# -- documents ---------------------------------------------------------------
def field(doc: Column, name: str) -> Column:
    """A field of JSON text, as text."""
    return F.get_json_object(doc, f"$.{name}")


def field_equals(df: DataFrame, doc: str, name: str, value: str) -> DataFrame:
    return df.where(field(F.col(doc), name) == value)


def field_range(df: DataFrame, doc: str, name: str, low=None, high=None, kind: str | None = None) -> DataFrame:
    """A closed range on a field, by its text or cast to kind; a bound of None is open."""
    c = field(F.col(doc), name)
    c = c.try_cast(kind) if kind else c
    if low is not None:
        df = df.where(c >= F.lit(low))
    if high is not None:
        df = df.where(c <= F.lit(high))
    return df.where(c.isNotNull())


def field_index(df: DataFrame, doc: str, name: str, doc_id: str) -> DataFrame:
    """(value, doc_id) for equality look-ups by field."""
    return df.select(field(F.col(doc), name).alias("value"), doc_id).where("value is not null")


# -- wide columns ------------------------------------------------------------
def cell_versions(cells: DataFrame, keys: list[str], ts: str, versions: int = 5, tie: str | None = None) -> DataFrame:
    """The newest versions of each cell."""
    order = [F.col(ts).desc()] + ([F.col(tie).desc()] if tie else [])
    return cells.withColumn("version", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("version") <= versions)


def cell_latest(cells: DataFrame, keys: list[str], ts: str, value: str, deleted: str | None = None) -> DataFrame:
    fields = [value, ts] + ([deleted] if deleted else [])
    top = cells.groupBy(*keys).agg(F.max_by(F.struct(*fields), ts).alias("__t"))
    if deleted:
        top = top.where(~F.col(f"__t.{deleted}"))
    return top.select(*keys, F.col(f"__t.{value}").alias(value), F.col(f"__t.{ts}").alias(ts))


def cell_scan(cells: DataFrame, row: str, low, high, family: str, name: str) -> DataFrame:
    return cells.where(F.col(row).between(low, high) & (F.col(family) == name))


# -- policies ----------------------------------------------------------------
def universal_pick(runs: DataFrame, threshold: int) -> DataFrame:
    """All runs of the lowest level once there are threshold of them, else none."""
    return runs if runs.limit(threshold).count() >= threshold else runs.where("false")


def needs_compaction(runs_in_level: dict[int, int], level0: int = 4, growth: int = 10) -> int | None:
    """The first level with too many runs: level0 of them in level 0, growth times as many in each next one."""
    for level in sorted(runs_in_level):
        if runs_in_level[level] >= level0 * growth**level:
            return level
    return None


def split_tablet(tablets: list[tuple], row) -> list[tuple]:
    """Tablets (from, to; to is not in it, None is open) with the one that holds row cut there; a row at a bound cuts nothing."""
    out: list[tuple] = []
    for low, high in tablets:
        inside = (low is None or row > low) and (high is None or row < high)
        out += [(low, row), (row, high)] if inside else [(low, high)]
    return out


def tablet_of(row: Column, tablets: list[tuple]) -> Column:
    """Number of the tablet that holds a row; tablets ascend and cover all rows."""
    return sum((F.when(row >= F.lit(low), 1).otherwise(0) for low, _ in tablets[1:]), F.lit(0))


def needed_collection(collections: dict[str, DataFrame], name: str, schema: str, spark) -> DataFrame:
    """A document collection by name, made empty if it is new."""
    return collections.setdefault(name, spark.createDataFrame([], schema))
