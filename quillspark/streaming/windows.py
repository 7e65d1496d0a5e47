"""Event-time windows, as one specification for batches and for streams.

Batch forms take an explicit watermark where lateness matters; stream forms let Spark derive it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

KINDS = ("tumbling", "hopping", "sliding", "session")


@dataclass(frozen=True)
class WindowSpec:
    """size_s: length, or the gap of sessions; hop_s: of hopping windows; grace_s: how late an event may come."""

    kind: str
    size_s: int
    hop_s: int = 0
    grace_s: int = 0

    def __post_init__(self) -> None:
        if self.kind not in KINDS or self.size_s <= 0 or self.grace_s < 0 or (self.kind == "hopping" and not 0 < self.hop_s <= self.size_s):
            raise ValueError(f"not a window: {self}")

    def column(self, ts: str) -> Column:
        size = f"{self.size_s} seconds"
        if self.kind == "session":
            return F.session_window(ts, size)
        if self.kind == "hopping":
            return F.window(ts, size, f"{self.hop_s} seconds")
        return F.window(ts, size)


AGGREGATES = {
    "count": lambda v: F.count(v),
    "sum": lambda v: F.sum(v),
    "avg": lambda v: F.avg(v),
    "min": lambda v: F.min(v),
    "max": lambda v: F.max(v),
    "distinct": lambda v: F.countDistinct(v),
}


def windowed(events: DataFrame, spec: WindowSpec, ts: str, value: str, keys: list[str], aggregates: list[str]) -> DataFrame:
    """Aggregates by window and keys: start, end, keys and a column named after each aggregate. Sessions are by key."""
    if spec.kind == "sliding":
        raise ValueError("sliding windows belong to events: see sliding()")
    grouped = events.groupBy(spec.column(ts).alias("w"), *keys).agg(*[AGGREGATES[a](F.col(value)).alias(a) for a in aggregates])
    return grouped.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, *aggregates)


def sliding(events: DataFrame, size_s: int, ts: str, value: str, keys: list[str]) -> DataFrame:
    """For each event the count and sum over (ts - size, ts] of its keys, in one ordered pass."""
    order = F.unix_micros(F.col(ts).cast("timestamp"))
    w = Window.partitionBy(*keys).orderBy(order).rangeBetween(-size_s * 1_000_000 + 1, 0)
    return events.withColumns({"n": F.count(value).over(w), "total": F.sum(value).over(w)})


def top_values(events: DataFrame, spec: WindowSpec, ts: str, value: str, k: int) -> DataFrame:
    """The k largest values of each window: start, rank, value."""
    w = events.select(spec.column(ts).alias("w"), F.col(value).alias("value")).select(F.col("w.start").alias("start"), "value")
    return w.withColumn("rank", F.row_number().over(Window.partitionBy("start").orderBy(F.col("value").desc()))).where(F.col("rank") <= k)


def lateness(events: DataFrame, ts: str, watermark: str, grace_s: int) -> DataFrame:
    """Counts against a given watermark: events, late (before it), dropped (before it by more than grace), lag in seconds of the watermark."""
    wm = F.lit(watermark).cast("timestamp")
    t = F.col(ts).cast("timestamp")
    dropped = t < wm - F.expr(f"INTERVAL {grace_s} SECONDS")
    lag = F.greatest(F.lit(0), F.unix_seconds(F.max(t)) - F.unix_seconds(F.first(wm)))
    return events.agg(F.count("*").alias("n"), F.count_if(t < wm).alias("late"), F.count_if(dropped).alias("dropped"), lag.alias("lag_s"))


def closed(events: DataFrame, spec: WindowSpec, ts: str, value: str, watermark: str, aggregates: list[str]) -> DataFrame:
    """Windows whose end and grace lie before a watermark."""
    out = windowed(events, spec, ts, value, [], aggregates)
    return out.where(F.col("end").cast("timestamp") + F.expr(f"INTERVAL {spec.grace_s} SECONDS") <= F.lit(watermark).cast("timestamp"))


def stream_windowed(stream: DataFrame, spec: WindowSpec, ts: str, value: str, keys: list[str], aggregates: list[str]) -> DataFrame:
    """The stream form, for append mode: a window comes out once the watermark (largest time less grace) has passed it."""
    late = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, f"{spec.grace_s} seconds")
    if "distinct" in aggregates:
        raise ValueError("streams take approx_count_distinct instead of distinct")
    return windowed(late, spec, ts, value, keys, aggregates)


def run_available(stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there and returns the rows it put out. Appended rows go to Parquet below the checkpoint, written by the tasks; those of other
    modes, which no file sink takes, to the driver's memory (small outputs)."""
    spark = stream.sparkSession
    w = stream.writeStream.outputMode(mode).queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if mode != "append":
        w.format("memory").start().awaitTermination()
        return spark.table(name)
    out = f"{checkpoint}-rows"
    w.format("parquet").option("path", out).start().awaitTermination()
    target = spark._jvm.org.apache.hadoop.fs.Path(out)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(target)  # a stream without a batch makes none
    return spark.read.schema(stream.schema).parquet(out)


def first_seen(stream: DataFrame, keys: list[str], ts: str, delay_s: int) -> DataFrame:
    """Drops repeated keys inside the watermark, with bounded state."""
    return stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, f"{delay_s} seconds").dropDuplicatesWithinWatermark(keys)


def running_totals(stream: DataFrame, key: str, value: str) -> DataFrame:
    """A custom stateful operator: after each batch the count and sum of the keys in it so far. Keys must not be null."""
    import pandas as pd
    from pyspark.sql.streaming.state import GroupStateTimeout

    def step(k, parts, state):
        n, total = state.get if state.exists else (0, 0.0)
        for p in parts:
            n, total = n + len(p), total + float(p[value].sum())
        state.update((n, total))
        yield pd.DataFrame({key: [k[0]], "n": [n], "total": [total]})

    kind = stream.schema[key].dataType.simpleString()
    return stream.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, n long, total double", "n long, total double", "update", GroupStateTimeout.NoTimeout)


def event_time_skew(events: DataFrame, event_ts: str, seen_ts: str) -> DataFrame:
    """One row: mean seconds between an event's time and its arrival."""
    seconds = lambda c: F.col(c).cast("timestamp").cast("double")
    return events.agg(F.avg(seconds(seen_ts) - seconds(event_ts)).alias("skew_s"))


def open_windows(events: DataFrame, ts: str, size: str, watermark) -> DataFrame:
    """One row: tumbling windows with events that end after the watermark."""
    w = events.select(F.window(ts, size).alias("w")).distinct()
    return w.where(F.col("w.end") > F.lit(watermark)).agg(F.count("*").alias("open_windows"))
