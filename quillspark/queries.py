"""Registered queries of the library's own operators, and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.functions import scoring, text
from quillspark.operators import graph, hnsw, integrity, relational, search, structures, vectors, versioned
from quillspark.plans import boolean, pattern
from quillspark.session import load, new_path, ready, written
from quillspark.sources import tables
from quillspark.streaming import log, windows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def register(sql: str | None = None, name: str | None = None):
    """Registers a query under its function's name, with its twin if SQL can express it."""

    def keep(f):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLE_SQL[name or f.__name__] = sql
        return f

    return keep


def r4(c, name: str):
    return F.round(c, 4).alias(name)


def big(c, name: str):
    return c.cast("long").alias(name)


# -- scans, projections, filters ----------------------------------------------
@register("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity > 45 AND l_returnflag = 'R'")
def scan_filter_project(spark, d):
    df = relational.filter_compare(load(spark, d, "lineitem"), "l_quantity", ">", 45)
    return relational.project(relational.filter_compare(df, "l_returnflag", "=", "R"), ["l_orderkey", "l_linenumber", "l_quantity"])


@register("SELECT p_partkey, coalesce(TRY_CAST(regexp_extract(p_brand, '(\\d+)', 1) AS INTEGER), 0) AS brand_no FROM part WHERE coalesce(TRY_CAST(regexp_extract(p_brand, '(\\d+)', 1) AS INTEGER), 0) >= 3")
def atoi_filter(spark, d):
    n = relational.as_int(F.regexp_extract("p_brand", r"(\d+)", 1))
    return load(spark, d, "part").select("p_partkey", n.alias("brand_no")).where(F.col("brand_no") >= 3)


@register("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def sort_limit(spark, d):
    return load(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25)


@register("SELECT substr(p_name, 1, 8) AS p_name, p_size FROM part")
def project_ordinals(spark, d):
    df = load(spark, d, "part")
    return relational.project_ordinals(df, [df.columns.index("p_name"), df.columns.index("p_size")], [8, 4])


@register("SELECT o_orderkey AS k, o_custkey AS v FROM orders WHERE o_orderkey >= 100 AND o_orderkey < 300")
def range_scan_inclusive(spark, d):
    rows = load(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("v"), F.lit(1).alias("seqno"), F.lit(False).alias("is_deleted"))
    return versioned.Versions(rows).scan(100, 300, high_open=True).select("k", "v")


@register("SELECT p_type AS k, min(p_partkey) AS v FROM part WHERE starts_with(p_type, 'S') GROUP BY 1 ORDER BY 1 LIMIT 20")
def prefix_scan(spark, d):
    rows = load(spark, d, "part").select(F.col("p_type").alias("k"), F.col("p_partkey").alias("v"), (-F.col("p_partkey")).alias("seqno"), F.lit(False).alias("is_deleted"))
    return versioned.Versions(rows).prefix("S", 20).select("k", "v")


@register("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey = 42")
def point_lookup(spark, d):
    return load(spark, d, "orders").where(F.col("o_orderkey") == 42).select("o_orderkey", "o_custkey")


@register("SELECT o_orderkey AS row_id, o_custkey FROM orders WHERE o_orderkey >= 500 AND o_orderstatus <> 'F' ORDER BY 1 LIMIT 1")
def next_live_row(spark, d):
    rows = load(spark, d, "orders").select(F.col("o_orderkey").alias("row_id"), "o_custkey", (F.col("o_orderstatus") == "F").alias("is_deleted"))
    return relational.next_row(rows, 500).select("row_id", "o_custkey")


@register("SELECT c_custkey, c_name FROM customer WHERE c_acctbal > 5000 ORDER BY c_name")
def sql_select(spark, d):
    load(spark, d, "customer").createOrReplaceTempView("customer_rows")
    return spark.sql("SELECT c_custkey, c_name FROM customer_rows WHERE c_acctbal > 5000 ORDER BY c_name")


# -- joins -------------------------------------------------------------------
JOIN_SQL = "SELECT c_custkey, o_orderkey, c_nationkey FROM customer JOIN orders ON c_custkey = o_custkey"


def _join(strategy):
    def run(spark, d):
        c = load(spark, d, "customer").select("c_custkey", "c_nationkey")
        o = load(spark, d, "orders").select("o_orderkey", "o_custkey")
        return relational.join(o, c, [("o_custkey", "c_custkey")], strategy=strategy).select("c_custkey", "o_orderkey", "c_nationkey")

    return run


for _s, _n in (("hash", "join_hash"), ("merge", "join_merge"), ("nested_loop", "join_nl"), ("broadcast", "join_broadcast"), ("grace", "join_grace")):
    register(JOIN_SQL, _n)(_join(_s))


@register("SELECT s, count(*) AS rows FROM (SELECT unnest(['hash', 'merge', 'nested_loop', 'broadcast', 'grace']) AS s) JOIN supplier ON TRUE JOIN nation ON s_nationkey = n_nationkey GROUP BY s".replace("SELECT s,", "SELECT s AS strategy,"))
def join_compare(spark, d):
    return relational.compare_strategies(load(spark, d, "supplier"), load(spark, d, "nation"), [("s_nationkey", "n_nationkey")])


@register("SELECT s_suppkey, n_nationkey FROM supplier JOIN nation ON s_nationkey < n_nationkey AND n_regionkey = 2")
def join_theta(spark, d):
    n = load(spark, d, "nation").where("n_regionkey = 2")
    return load(spark, d, "supplier").join(n, F.col("s_nationkey") < F.col("n_nationkey")).select("s_suppkey", "n_nationkey")


@register("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)")
def join_semi(spark, d):
    o = load(spark, d, "orders").where("o_totalprice > 200000")
    return load(spark, d, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@register("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)")
def join_anti(spark, d):
    o = load(spark, d, "orders").where("o_totalprice > 200000")
    return load(spark, d, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@register("""SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS lines FROM lineitem JOIN orders ON l_orderkey = o_orderkey
JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE l_shipdate >= TIMESTAMP '1995-01-01' GROUP BY n_name ORDER BY revenue DESC, n_name LIMIT 10""")
def join_multiway(spark, d):
    """Revenue by nation. The date filter reaches the scan; nation is joined after aggregation by its key."""
    li = load(spark, d, "lineitem").where(F.col("l_shipdate") >= F.lit("1995-01-01").cast("timestamp_ntz")).select("l_orderkey", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("v"))
    o = load(spark, d, "orders").select("o_orderkey", "o_custkey")
    c = load(spark, d, "customer").select("c_custkey", "c_nationkey")
    by = li.join(o, li.l_orderkey == o.o_orderkey).join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy("c_nationkey").agg(F.sum("v").alias("v"), F.count("*").alias("lines"))
    n = load(spark, d, "nation")
    return by.join(n, by.c_nationkey == n.n_nationkey).select("n_name", F.round("v", 2).alias("revenue"), "lines").orderBy(F.desc("revenue"), "n_name").limit(10)


# -- aggregates, top-k, sets --------------------------------------------------
@register("SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY 1")
def agg_count(spark, d):
    return relational.group_count(load(spark, d, "lineitem"), "l_returnflag")


@register("SELECT event_type, count(value) AS n, round(sum(value), 4) AS total, round(avg(value), 4) AS mean, min(value) AS least, max(value) AS most FROM events GROUP BY 1")
def agg_all(spark, d):
    return relational.aggregate_all(load(spark, d, "events"), ["event_type"], "value").withColumns({"total": F.round("total", 4), "mean": F.round("mean", 4)})


@register("SELECT event_type, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
def agg_distinct(spark, d):
    return load(spark, d, "events").groupBy("event_type").agg(F.countDistinct("user_id").alias("users"))


@register("SELECT event_type, l[CAST(floor((1 - 90 / 100.0::DOUBLE) * (len(l) - 1)) AS BIGINT) + 1] AS percentile FROM (SELECT event_type, list(value ORDER BY value DESC) AS l FROM events WHERE value IS NOT NULL GROUP BY 1)")
def agg_percentile_ref(spark, d):
    return relational.percentile_desc(load(spark, d, "events"), ["event_type"], "value", 90)


@register("SELECT user_id, event_id, value, rank FROM (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rank FROM events) WHERE rank <= 3")
def topk_per_group(spark, d):
    return relational.top_k(load(spark, d, "events").select("user_id", "event_id", "value"), ["user_id"], [F.desc("value"), F.col("event_id")], 3)


def _nations(spark, d):
    return load(spark, d, "customer").select(F.col("c_nationkey").alias("k")), load(spark, d, "supplier").where("s_acctbal > 0").select(F.col("s_nationkey").alias("k"))


@register("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier WHERE s_acctbal > 0")
def set_union(spark, d):
    return relational.union(*_nations(spark, d))


@register("SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier WHERE s_acctbal > 0")
def set_intersect(spark, d):
    return relational.intersect(*_nations(spark, d))


@register("SELECT c_nationkey AS k FROM customer EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 0")
def set_except(spark, d):
    return relational.subtract(*_nations(spark, d))


# -- versions, documents, cells -----------------------------------------------
def _versions(spark, d):
    e = load(spark, d, "events").select(F.col("user_id").alias("k"), F.col("value").alias("v"), F.col("event_id").alias("seqno"), (F.col("event_type") == "error").alias("is_deleted"))
    return versioned.Versions(e)


LATEST = "SELECT user_id AS k, value AS v, event_id AS seqno FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events{}) WHERE rn = 1 AND event_type <> 'error'"


@register(LATEST.format(""))
def latest_version(spark, d):
    return _versions(spark, d).latest()


@register(LATEST.format(" WHERE event_id <= 500"))
def snapshot_read(spark, d):
    return _versions(spark, d).latest(500)


@register("SELECT user_id AS k, event_id AS seqno FROM (SELECT *, lead(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS nx FROM events) WHERE nx IS NULL OR nx > 500")
def version_gc(spark, d):
    return _versions(spark, d).gc(500).select("k", "seqno")


@register("SELECT event_id FROM events WHERE user_id % 7 = 0 OR event_id % 100 >= 50 OR event_id % 100 = 0")
def ttl_filter(spark, d):
    e = load(spark, d, "events").select("event_id", F.when(F.col("user_id") % 7 == 0, 0).otherwise(F.col("event_id") % 100).alias("ttl"))
    return e.where(versioned.live(F.col("ttl"), 50)).select("event_id")


@register(LATEST.format(""))
def kv_compaction(spark, d):
    return _versions(ready(spark), d).compact(new_path(spark, "run"), 4)


@register("SELECT o_custkey AS k, max_by(o_orderkey, o_orderkey % 3 * 1000000000 + o_orderkey) AS v FROM orders GROUP BY 1")
def merge_runs(spark, d):
    o = load(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("v"))
    runs = [o.where(F.col("v") % 3 == i).groupBy("k").agg(F.max("v").alias("v")) for i in range(3)]
    return versioned.merge_runs(runs, "k", "v")


@register("SELECT event_id, user_id FROM events WHERE json_extract_string(props, '$.k') = '42'")
def doc_field_eq(spark, d):
    return versioned.field_equals(load(spark, d, "events"), "props", "k", "42").select("event_id", "user_id")


@register("SELECT event_id FROM events WHERE json_extract_string(props, '$.k') >= '30' AND json_extract_string(props, '$.k') <= '40'")
def doc_range_text(spark, d):
    return versioned.field_range(load(spark, d, "events"), "props", "k", "30", "40").select("event_id")


@register("SELECT event_id FROM events WHERE TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) BETWEEN 30 AND 40")
def doc_range_typed(spark, d):
    return versioned.field_range(load(spark, d, "events"), "props", "k", 30, 40, "int").select("event_id")


@register("SELECT json_extract_string(props, '$.k') AS value, count(*) AS docs FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL GROUP BY 1")
def doc_field_index(spark, d):
    return versioned.field_index(load(spark, d, "events"), "props", "k", "event_id").groupBy("value").agg(F.count("*").alias("docs"))


@register("SELECT user_id, event_type, event_id, version FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS version FROM events) WHERE version <= 5")
def cell_versions_top5(spark, d):
    return versioned.cell_versions(load(spark, d, "events"), ["user_id", "event_type"], "ts", 5, "event_id").select("user_id", "event_type", "event_id", "version")


@register("SELECT user_id, event_type, max_by(value, event_id) AS value, max(event_id) AS event_id FROM events GROUP BY 1, 2")
def cell_latest(spark, d):
    return versioned.cell_latest(load(spark, d, "events"), ["user_id", "event_type"], "event_id", "value")


@register("SELECT user_id, event_id, value FROM events WHERE user_id BETWEEN 10 AND 20 AND event_type = 'click'")
def cell_scan(spark, d):
    return versioned.cell_scan(load(spark, d, "events"), "user_id", 10, 20, "event_type", "click").select("user_id", "event_id", "value")


# -- structures ---------------------------------------------------------------
def _zset(spark, d):
    return load(spark, d, "events").groupBy("event_type", "user_id").agg(F.max_by("value", "event_id").alias("score"))


ZSET = "(SELECT event_type, user_id, max_by(value, event_id) AS score FROM events GROUP BY 1, 2)"


@register(f"SELECT event_type, user_id, row_number() OVER (PARTITION BY event_type ORDER BY score, user_id) - 1 AS rank FROM {ZSET}")
def zset_rank(spark, d):
    return structures.zrank(_zset(spark, d), "user_id", "score", ["event_type"]).select("event_type", "user_id", big(F.col("rank"), "rank"))


@register(f"SELECT event_type, user_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY score DESC, user_id DESC) AS b FROM {ZSET}) WHERE b <= 3")
def zset_range_last(spark, d):
    return structures.zrange(_zset(spark, d), "user_id", "score", ["event_type"], -3, -1).select("event_type", "user_id")


@register(f"SELECT event_type, user_id, score FROM {ZSET} WHERE score BETWEEN 10 AND 20")
def zrangebyscore(spark, d):
    return structures.zrangebyscore(_zset(spark, d), "score", 10, 20)


@register("SELECT u, count(*) AS n FROM (SELECT user_id, unnest(list_distinct(list(event_type) || ['extra'])) AS u FROM events GROUP BY user_id) GROUP BY u")
def set_ops_structures(spark, d):
    s = load(spark, d, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("s"))
    return s.select(F.explode(structures.sadd(F.col("s"), F.lit("extra"))).alias("u")).groupBy("u").agg(F.count("*").alias("n"))


@register("SELECT user_id, unnest(list_slice(list(event_id ORDER BY event_id), greatest(len(list(event_id)) - 2, 1), len(list(event_id)))) AS event_id FROM events GROUP BY user_id")
def list_slice(spark, d):
    s = load(spark, d, "events").groupBy("user_id").agg(F.array_sort(F.collect_list("event_id")).alias("l"))
    return s.select("user_id", F.explode(structures.lrange(F.col("l"), -3, -1)).alias("event_id"))


@register("SELECT c_custkey, k, v FROM (SELECT c_custkey, 'segment' AS k, c_mktsegment AS v FROM customer UNION ALL SELECT c_custkey, 'name', c_name FROM customer) WHERE k <> 'name'")
def hash_entries(spark, d):
    m = F.create_map(F.lit("segment"), F.col("c_mktsegment"), F.lit("name"), F.col("c_name"))
    return load(spark, d, "customer").select("c_custkey", F.explode(structures.hdel(m, F.lit("name"))).alias("k", "v"))


# -- event time ---------------------------------------------------------------
AGG = "count(value) AS count, round(sum(value), 4) AS sum, min(value) AS min, max(value) AS max"
DAY = 86_400


@register(f"SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, {AGG} FROM events GROUP BY 1, 2")
def win_tumbling(spark, d):
    out = windows.windowed(load(spark, d, "events"), windows.WindowSpec("tumbling", DAY), "ts", "value", ["event_type"], ["count", "sum", "min", "max"])
    return out.withColumn("sum", F.round("sum", 4)).drop("end")


@register(f"SELECT time_bucket(INTERVAL 1 DAY, ts) - INTERVAL 1 DAY * i AS start, {AGG} FROM events, (SELECT unnest([0, 1]) AS i) GROUP BY 1")
def win_hopping(spark, d):
    out = windows.windowed(load(spark, d, "events"), windows.WindowSpec("hopping", 2 * DAY, DAY), "ts", "value", [], ["count", "sum", "min", "max"])
    return out.withColumn("sum", F.round("sum", 4)).drop("end")


@register("SELECT event_id, count(value) OVER w AS n, round(sum(value) OVER w, 4) AS total FROM events WINDOW w AS (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 86399999999 PRECEDING AND CURRENT ROW)")
def win_sliding(spark, d):
    return windows.sliding(load(spark, d, "events"), DAY, "ts", "value", ["user_id"]).select("event_id", "n", r4(F.col("total"), "total"))


@register("""WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS f FROM events),
s AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM g)
SELECT user_id, min(ts) AS start, count(value) AS count FROM s GROUP BY user_id, sid""")
def win_session(spark, d):
    out = windows.windowed(load(spark, d, "events"), windows.WindowSpec("session", 21_600), "ts", "value", ["user_id"], ["count"])
    return out.select("user_id", "start", "count")


@register("SELECT start, rank, value FROM (SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, value, row_number() OVER (PARTITION BY time_bucket(INTERVAL 1 DAY, ts) ORDER BY value DESC) AS rank FROM events) WHERE rank <= 3")
def win_topk(spark, d):
    return windows.top_values(load(spark, d, "events"), windows.WindowSpec("tumbling", DAY), "ts", "value", 3)


@register("SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, count(DISTINCT user_id) AS distinct FROM events GROUP BY 1".replace("AS distinct", 'AS "distinct"'))
def win_distinct(spark, d):
    return windows.windowed(load(spark, d, "events"), windows.WindowSpec("tumbling", DAY), "ts", "user_id", [], ["distinct"]).drop("end")


WM = "2024-01-15 00:00:00"


@register(f"SELECT count(*) AS n, count(*) FILTER (ts < TIMESTAMP '{WM}') AS late, count(*) FILTER (ts < TIMESTAMP '{WM}' - INTERVAL 3 DAY) AS dropped, greatest(0, CAST(floor(epoch(max(ts))) - epoch(TIMESTAMP '{WM}') AS BIGINT)) AS lag_s FROM events")
def win_late(spark, d):
    return windows.lateness(load(spark, d, "events"), "ts", WM, 3 * DAY).withColumn("lag_s", F.col("lag_s").cast("long"))


@register(f"SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, count(value) AS count FROM events GROUP BY 1 HAVING time_bucket(INTERVAL 1 DAY, ts) + INTERVAL 1 DAY <= TIMESTAMP '{WM}'")
def win_closed(spark, d):
    return windows.closed(load(spark, d, "events"), windows.WindowSpec("tumbling", DAY), "ts", "value", WM, ["count"]).drop("end")


def _stream(spark, d, table="events"):
    schema = load(spark, d, table).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{table}.parquet").parquet(d)


@register("SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1")
def stream_running_totals(spark, d):
    """All events through a stateful stream; the last totals of each key."""
    name = new_path(ready(spark), "q").rsplit("-", 1)[1]
    out = windows.run_available(windows.running_totals(_stream(spark, d), "event_type", "value"), f"t{name}", new_path(spark, "stream"), "update")
    return out.groupBy("event_type").agg(F.max("n").alias("n"), r4(F.max_by("total", "n"), "total"))


@register()
def stream_tumbling(spark, d):
    """Windows that a watermark one day behind the largest time has closed."""
    name = new_path(ready(spark), "q").rsplit("-", 1)[1]
    s = windows.stream_windowed(_stream(spark, d), windows.WindowSpec("tumbling", DAY, grace_s=DAY), "ts", "value", ["event_type"], ["count"])
    return windows.run_available(s, f"t{name}", new_path(spark, "stream"))


@register()
def stream_session(spark, d):
    name = new_path(ready(spark), "q").rsplit("-", 1)[1]
    s = windows.stream_windowed(_stream(spark, d), windows.WindowSpec("session", 21_600, grace_s=DAY), "ts", "value", ["user_id"], ["count"])
    return windows.run_available(s, f"t{name}", new_path(spark, "stream"))


# -- logs ---------------------------------------------------------------------
def _log(spark, d):
    e = load(spark, d, "events")
    return e.select(F.lit("events").alias("topic"), (F.col("user_id") % 4).cast("int").alias("partition"), F.col("event_id").alias("offset"), F.unix_millis(F.col("ts").cast("timestamp")).alias("timestamp"), F.when(F.col("user_id") % 10 != 0, F.col("user_id")).alias("key"), F.when(F.col("event_type") != "error", F.col("value")).alias("value"), F.floor(F.col("event_id") / 100).alias("segment"))


@register("SELECT event_id AS \"offset\" FROM events WHERE user_id % 10 = 0 OR event_id IN (SELECT max(event_id) FROM events WHERE user_id % 10 <> 0 GROUP BY user_id)")
def log_compaction(spark, d):
    return log.compacted(_log(spark, d), "key", "offset").select("offset")


@register("SELECT event_id // 100 AS segment, count(*) AS n FROM events WHERE event_id // 100 >= 3 GROUP BY 1")
def segment_retention(spark, d):
    g = _log(spark, d).withColumn("age", F.col("segment"))
    return log.retained_by_time(g, "segment", "age", 10, 7).groupBy("segment").agg(F.count("*").alias("n"))


@register("SELECT event_id // 100 AS segment, count(*) AS n FROM events WHERE event_id // 100 > (SELECT max(event_id // 100) - 4 FROM events) GROUP BY 1")
def size_retention(spark, d):
    return log.retained_by_size(_log(spark, d), "segment", F.lit(1), 400).groupBy("segment").agg(F.count("*").alias("n"))


@register("SELECT (SELECT count(*) FROM events) AS total, CAST(sum(n - 1) AS BIGINT) AS superseded, round(sum(n - 1) / (SELECT count(*) FROM events), 4) AS dirty_ratio FROM (SELECT count(*) AS n FROM events WHERE user_id % 10 <> 0 GROUP BY user_id)")
def dirty_ratio(spark, d):
    return log.dirty_ratio(_log(spark, d), "key").withColumn("dirty_ratio", F.round("dirty_ratio", 4))


@register("SELECT CAST(user_id % 4 AS INTEGER) AS partition, max(event_id) + 1 AS end_offset, greatest(0, max(event_id) + 1 - 700) AS lag FROM events GROUP BY 1")
def consumer_lag(spark, d):
    e = log.end_offsets(_log(spark, d))
    return e.select("partition", "end_offset", log.lag(F.col("end_offset"), F.lit(700)).alias("lag"))


@register("SELECT count(*) AS tombstones FROM events WHERE user_id % 10 <> 0 AND event_type = 'error'")
def tombstone_count(spark, d):
    return log.tombstones(_log(spark, d), "key", "value")


@register("SELECT event_id AS \"offset\" FROM events WHERE user_id % 4 = 1 AND event_id >= 100 ORDER BY 1 LIMIT 20")
def log_read(spark, d):
    return log.read_from(_log(spark, d), 1, 100, 20).select("offset")


@register("SELECT n_nationkey, CASE WHEN n_nationkey < 9 THEN 'a' WHEN n_nationkey < 17 THEN 'b' ELSE 'c' END AS member FROM nation")
def assign_range(spark, d):
    return log.assign_range(load(spark, d, "nation").select("n_nationkey"), ["a", "b", "c"], ["n_nationkey"])


@register("SELECT n_nationkey, ['a', 'b', 'c'][n_nationkey % 3 + 1] AS member FROM nation")
def assign_round_robin(spark, d):
    return log.assign_round_robin(load(spark, d, "nation").select("n_nationkey"), ["a", "b", "c"], ["n_nationkey"])


@register("""SELECT partition, coalesce(min(leo) FILTER (in_sync), 0) AS high_watermark, count(*) FILTER (in_sync) AS in_sync, count(*) AS replicas,
CASE WHEN count(*) FILTER (in_sync) = count(*) THEN 'HEALTHY' WHEN count(*) FILTER (in_sync) > 1 THEN 'DEGRADED' ELSE 'UNDER_REPLICATED' END AS status
FROM (SELECT user_id % 4 AS partition, user_id % 3 AS broker, max(event_id) AS leo, user_id % 3 <> 1 OR user_id % 4 <> 2 AS in_sync FROM events GROUP BY 1, 2, 4) GROUP BY 1""")
def isr_high_watermark(spark, d):
    e = load(spark, d, "events")
    r = e.groupBy((F.col("user_id") % 4).alias("partition"), (F.col("user_id") % 3).alias("broker"), ((F.col("user_id") % 3 != 1) | (F.col("user_id") % 4 != 2)).alias("in_sync")).agg(F.max("event_id").alias("leo"))
    return log.high_watermark(r, ["partition"])


@register("SELECT candidate, count(*) AS votes FROM (SELECT user_id, min_by(event_type, event_id) AS candidate FROM events GROUP BY 1) GROUP BY 1 ORDER BY votes DESC, candidate LIMIT 1")
def leader_election(spark, d):
    return log.elect(load(spark, d, "events").select(F.col("user_id").alias("voter"), F.col("event_type").alias("candidate"), F.col("event_id").alias("cast_seq")))


# -- text search --------------------------------------------------------------
TOKENS = "(SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[ \\t\\n\\x0b\\f\\r]+'), lambda x: x <> '')) AS term FROM documents)"


def _tokens(spark, d):
    return search.token_rows(load(spark, d, "documents").select("doc_id", "text"))


def _docs(spark, d):
    return load(spark, d, "documents").select("doc_id", "text")


@register(f"SELECT doc_id, count(*) AS dl FROM {TOKENS} GROUP BY 1")
def tokenize_counts(spark, d):
    return search.doc_lengths(_tokens(spark, d))


@register(f"SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM (SELECT term, doc_id, count(*) AS tf FROM {TOKENS} GROUP BY 1, 2) GROUP BY 1 HAVING count(*) > 20")
def postings_stats(spark, d):
    return search.term_stats(search.term_frequencies(_tokens(spark, d))).where("df > 20")


@register(f"SELECT doc_id, count(*) AS n FROM {TOKENS} WHERE term NOT IN ({', '.join(repr(w) for w in text.STOP_WORDS)}) GROUP BY 1")
def stopword_filter(spark, d):
    return _tokens(spark, d).where(~F.col("term").isin(*text.STOP_WORDS)).groupBy("doc_id").agg(F.count("*").alias("n"))


def _boolean(query):
    def run(spark, d):
        tokens = _tokens(spark, d)
        return boolean.evaluate(boolean.parse(query), search.postings(tokens), load(spark, d, "documents").select("doc_id")).select("doc_id")

    return run


HAS = f"SELECT DISTINCT doc_id FROM {TOKENS} WHERE term = "
register(f"{HAS} 'thing' INTERSECT {HAS} 'erer'", "bool_and")(_boolean("thing AND erer"))
register(f"{HAS} 'thing' UNION {HAS} 'erer'", "bool_or")(_boolean("thing OR erer"))
register(f"{HAS} 'the' EXCEPT {HAS} 'of'", "bool_not")(_boolean("the NOT of"))
register(f"SELECT DISTINCT doc_id FROM {TOKENS} WHERE starts_with(term, 'thing')", "prefix_query")(_boolean("thing*"))
register(f"(({HAS} 'thing') UNION ({HAS} 'erer')) EXCEPT ({HAS} 'was')", "bool_nested")(_boolean("(thing OR erer) AND NOT was"))


POSITIONS = "(SELECT doc_id, unnest(ws) AS term, generate_subscripts(ws, 1) AS pos FROM (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[ \\t\\n\\x0b\\f\\r]+'), lambda x: x <> '') AS ws FROM documents))"


@register(f"SELECT DISTINCT a.doc_id FROM {POSITIONS} a JOIN {POSITIONS} b ON a.doc_id = b.doc_id AND b.pos - a.pos BETWEEN 0 AND 3 WHERE a.term = 'was' AND b.term = 'for'")
def phrase_proximity(spark, d):
    return boolean.proximity(search.postings(_tokens(spark, d).where(F.col("term").isin("was", "for"))), "was", "for", 3)


@register(f"SELECT a.doc_id, count(DISTINCT b.pos) AS tf FROM {POSITIONS} a JOIN {POSITIONS} b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1 WHERE a.term = 'of' AND b.term = 'the' GROUP BY 1")
def phrase_exact(spark, d):
    return boolean.phrase(search.postings(_tokens(spark, d).where(F.col("term").isin("of", "the"))), ["of", "the"])


TERMS = ["thing", "erer", "onthe"]
SCORED = f"""WITH t AS (SELECT * FROM {TOKENS}), tf AS (SELECT term, doc_id, count(*) AS tf FROM t WHERE term IN ('thing', 'erer', 'onthe') GROUP BY 1, 2), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
dl AS (SELECT doc_id, count(*) AS dl FROM t GROUP BY 1), st AS (SELECT (SELECT count(*) FROM documents) AS n, (SELECT count(*) FROM t)::DOUBLE / (SELECT count(*) FROM documents) AS avgdl),
x AS (SELECT *, ln(1 + tf) * greatest(0, ln((n + 1) / (df + 0.5))) AS ti, greatest(0, ln((n - df + 0.5) / (df + 0.5))) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)) AS bm FROM tf JOIN df USING (term) JOIN dl USING (doc_id), st)
SELECT doc_id, round(sum({{}}), 4) AS score FROM x GROUP BY 1"""


def _score(f):
    def run(spark, d):
        return f(_docs(spark, d), _tokens(spark, d), TERMS).select("doc_id", r4(F.col("score"), "score"))

    return run


register(SCORED.format("ti"), "tfidf_scores")(_score(search.tfidf))
register(SCORED.format("bm"), "bm25_multi")(_score(search.bm25))
register(SCORED.format("(ti + bm) / 2"), "combined_scores")(_score(search.combined))


@register(SCORED.format("(ti + bm) / 2").replace("IN ('thing', 'erer', 'onthe')", "IN ('thing', 'erer')") + " ORDER BY sum((ti + bm) / 2) DESC, doc_id LIMIT 10")
def engine_search(spark, d):
    return search.search(_docs(spark, d), "thing OR erer", 10).select("doc_id", r4(F.col("score"), "score"))


LM = f"""WITH t AS (SELECT * FROM {TOKENS}), p AS (SELECT term, count(*)::DOUBLE / (SELECT count(*) FROM t) AS p FROM t WHERE term IN ('thing', 'erer', 'onthe') GROUP BY 1), dl AS (SELECT doc_id, count(*) AS dl FROM t GROUP BY 1),
tf AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY 1, 2), x AS (SELECT dl.doc_id, greatest(1e-10, {{}}) AS q FROM dl CROSS JOIN p LEFT JOIN tf ON tf.doc_id = dl.doc_id AND tf.term = p.term)
SELECT doc_id, round(sum(ln(q)), 4) AS ll, round(pow(2, -avg(log2(q))), 2) AS perplexity FROM x GROUP BY 1"""


@register(LM.format("(coalesce(tf, 0) + 1000 * p) / (dl + 1000)"))
def lm_dirichlet(spark, d):
    return search.query_likelihood(_tokens(spark, d), TERMS).select("doc_id", r4(F.col("ll"), "ll"), F.round("perplexity", 2).alias("perplexity"))


@register(LM.format("0.6 * coalesce(tf, 0) / dl + 0.4 * p"))
def lm_jelinek_mercer(spark, d):
    return search.query_likelihood(_tokens(spark, d), TERMS, "jm", 0.4).select("doc_id", r4(F.col("ll"), "ll"), F.round("perplexity", 2).alias("perplexity"))


@register("""WITH w AS (SELECT DISTINCT unnest(string_split(lower(p_name), ' ')) AS w FROM part), p AS (SELECT a.w AS word, b.w AS entry, levenshtein(a.w, b.w) AS distance FROM w a, w b WHERE levenshtein(a.w, b.w) <= 2)
SELECT word, entry, distance, rank FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY distance, entry) AS rank FROM p) WHERE rank <= 3""")
def spell_candidates(spark, d):
    w = load(spark, d, "part").select(F.explode(F.split(F.lower("p_name"), " ")).alias("w")).distinct()
    return text.corrections(w, w, "w", "w", 2, 3).select("word", "entry", big(F.col("distance"), "distance"), big(F.col("rank"), "rank"))


@register("""WITH m AS (SELECT source, doc_id, quality, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank, row_number() OVER (PARTITION BY source ORDER BY quality DESC, n_chars DESC, doc_id) AS ideal FROM documents JOIN labels USING (doc_id)),
s AS (SELECT *, sum(quality) OVER (PARTITION BY source ORDER BY rank) AS seen FROM m)
SELECT source, round(sum(CASE WHEN rank <= 5 THEN quality ELSE 0 END) / 5, 4) AS precision, round(CASE WHEN sum(quality) > 0 THEN sum(CASE WHEN rank <= 5 THEN quality ELSE 0 END) / sum(quality) ELSE 0 END, 4) AS recall,
round(CASE WHEN sum(quality) > 0 THEN sum(CASE WHEN quality = 1 THEN seen / rank ELSE 0 END) / sum(quality) ELSE 0 END, 4) AS ap,
round(CASE WHEN sum(quality) > 0 THEN sum(CASE WHEN rank <= 5 THEN quality / log2(rank + 1) ELSE 0 END) / sum(CASE WHEN ideal <= 5 THEN quality / log2(ideal + 1) ELSE 0 END) ELSE 0 END, 4) AS ndcg,
round(coalesce(1 / min(CASE WHEN quality = 1 THEN rank END), 0), 4) AS rr FROM s GROUP BY source""")
def ir_metrics(spark, d):
    m = load(spark, d, "documents").select("doc_id", "source", "n_chars").join(load(spark, d, "labels"), "doc_id")
    m = m.withColumn("rank", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id")))
    out = search.ir_metrics(m.select("source", "rank", F.col("quality").alias("rel")), ["source"], 5)
    return out.select("source", *[r4(F.col(c), c) for c in ("precision", "recall", "ap", "ndcg", "rr")])


# -- vectors ------------------------------------------------------------------
ZIPPED = "list_zip(a.embedding, b.embedding)"
DISTANCE = {
    "l2": f"sqrt(list_sum(list_transform({ZIPPED}, lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) ** 2)))",
    "cosine": f"1 - list_sum(list_transform({ZIPPED}, lambda p: p[1]::DOUBLE * p[2]::DOUBLE)) / (sqrt(list_sum(list_transform(a.embedding, lambda x: x::DOUBLE ** 2))) * sqrt(list_sum(list_transform(b.embedding, lambda x: x::DOUBLE ** 2))))",
    "ip": f"-list_sum(list_transform({ZIPPED}, lambda p: p[1]::DOUBLE * p[2]::DOUBLE))",
    "linf": f"list_max(list_transform({ZIPPED}, lambda p: abs(p[1]::DOUBLE - p[2]::DOUBLE)))",
    "l1": f"list_sum(list_transform({ZIPPED}, lambda p: abs(p[1]::DOUBLE - p[2]::DOUBLE)))",
    "hamming": f"list_sum(list_transform({ZIPPED}, lambda p: CASE WHEN (p[1] > 0) <> (p[2] > 0) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END))",
}


def _knn(metric):
    def run(spark, d):
        e = load(spark, d, "embeddings").select("vec_id", "embedding")
        q = [float(x) for x in e.where("vec_id = 7").first()["embedding"]]
        return vectors.knn(e, q, 10, metric).select("vec_id", r4(F.col("distance"), "distance"))

    return run


for _m, _sql in DISTANCE.items():
    register(f"SELECT a.vec_id, round({_sql}, 4) AS distance FROM embeddings a, (SELECT embedding FROM embeddings WHERE vec_id = 7) b ORDER BY {_sql}, a.vec_id LIMIT 10", f"knn_{_m}")(_knn(_m))


@register(f"SELECT query_id, rank, vec_id FROM (SELECT b.vec_id AS query_id, a.vec_id, row_number() OVER (PARTITION BY b.vec_id ORDER BY {DISTANCE['l2']}, a.vec_id) AS rank FROM embeddings a, embeddings b WHERE b.vec_id % 100 = 0) WHERE rank <= 5")
def knn_many(spark, d):
    """The stated query set against all rows."""
    e = load(spark, d, "embeddings").select("vec_id", "embedding")
    return vectors.knn_join(e, e.where("vec_id % 100 = 0"), 5).select("query_id", big(F.col("rank"), "rank"), "vec_id")


@register("SELECT CAST(pos - 1 AS INTEGER) AS pos, round(avg(x), 4) AS mean, round(stddev_pop(x), 4) AS std FROM (SELECT unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings) GROUP BY pos")
def mean_vector(spark, d):
    return vectors.mean_vector(load(spark, d, "embeddings")).select("pos", r4(F.col("mean"), "mean"), r4(F.col("std"), "std"))


def _recall(index):
    def run(spark, d):
        e = load(ready(spark), d, "embeddings").select("vec_id", "embedding")
        q = e.where("vec_id % 100 = 0")
        return vectors.recall(index(e, q), vectors.knn_join(e, q, 10), 10)

    return run


def _ivf(**options):
    def run(e, q):
        i = vectors.IVF(**options).fit(e)
        return i.search(i.build(e), q, 10)

    return run


def _hnsw(e, q):
    return hnsw.search(hnsw.build(e), q, 10)


register(name="hnsw_recall")(_recall(_hnsw))
register(name="ivf_recall")(_recall(_ivf(lists=16, probes=12)))
register(name="ivfpq_recall")(_recall(_ivf(lists=8, probes=7, parts=32)))
register(name="lsh_recall")(_recall(lambda e, q: vectors.lsh(e, q, 10)))


@register()
def kmeans_clusters(spark, d):
    """Size and spread of eight clusters."""
    e = load(spark, d, "embeddings").select("vec_id", "embedding")
    c = vectors.kmeans_fit(vectors._sample(e, "embedding"), 8)
    a = vectors.assign(e, c)
    return vectors.silhouette(a, "cluster").join(a.select("vec_id", "cluster"), "vec_id").groupBy("cluster").agg(F.count("*").alias("n"), F.avg("silhouette").alias("silhouette"))


@register()
def pca_variance(spark, d):
    _, values = vectors.pca(load(spark, d, "embeddings"), 4)
    share = (values.cumsum() / values.sum()).tolist()
    return spark.createDataFrame([(i, s) for i, s in enumerate(share, 1)], "components int, share double")


# -- graph: who supplies whom, in which nation; nations that trade ---------------
#: Fixed places of ids: suppliers, customers and nations have their own ranges.
SUPPLIER, CUSTOMER = 10**12, 2 * 10**12
#: Suppliers point to the customers they have sold to, customers to their nation, nations to their suppliers.
SUPPLY = f"(SELECT DISTINCT {SUPPLIER} + l_suppkey AS src, {CUSTOMER} + o_custkey AS dst FROM lineitem JOIN orders ON l_orderkey = o_orderkey UNION ALL SELECT {CUSTOMER} + c_custkey, c_nationkey FROM customer UNION ALL SELECT s_nationkey, {SUPPLIER} + s_suppkey FROM supplier)"
#: Nations by what their suppliers sold to customers of which nation; w is the price of the cheapest such line.
TRADE = "(SELECT CAST(s_nationkey AS BIGINT) AS src, CAST(c_nationkey AS BIGINT) AS dst, min(l_extendedprice) AS w FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)"


def _supply(spark, d):
    li = load(ready(spark), d, "lineitem").select("l_orderkey", "l_suppkey")
    o = load(spark, d, "orders").select("o_orderkey", "o_custkey")
    sold = li.join(o, li.l_orderkey == o.o_orderkey).select((F.lit(SUPPLIER) + F.col("l_suppkey")).alias("src"), (F.lit(CUSTOMER) + F.col("o_custkey")).alias("dst")).distinct()
    lives = load(spark, d, "customer").select((F.lit(CUSTOMER) + F.col("c_custkey")).alias("src"), F.col("c_nationkey").cast("long").alias("dst"))
    return written(sold.unionByName(lives).unionByName(load(spark, d, "supplier").select(F.col("s_nationkey").cast("long").alias("src"), (F.lit(SUPPLIER) + F.col("s_suppkey")).alias("dst"))), "supply")


def _trade(spark, d):
    li = load(ready(spark), d, "lineitem").select("l_orderkey", "l_suppkey", "l_extendedprice")
    s = load(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").cast("long").alias("src"))
    o = load(spark, d, "orders").select("o_orderkey", "o_custkey")
    c = load(spark, d, "customer").select("c_custkey", F.col("c_nationkey").cast("long").alias("dst"))
    joined = li.join(s, li.l_suppkey == s.s_suppkey).join(o, li.l_orderkey == o.o_orderkey).join(c, F.col("o_custkey") == F.col("c_custkey"))
    return written(joined.groupBy("src", "dst").agg(F.min("l_extendedprice").alias("w")), "trade")


@register(f"WITH e AS MATERIALIZED {SUPPLY}, v AS (SELECT src AS id FROM e UNION SELECT dst FROM e), o AS (SELECT src, count(*) AS n FROM e GROUP BY 1), i AS (SELECT dst, count(*) AS n FROM e GROUP BY 1) SELECT id, coalesce(o.n, 0) AS out_degree, coalesce(i.n, 0) AS in_degree FROM v LEFT JOIN o ON o.src = id LEFT JOIN i ON i.dst = id")
def graph_degree(spark, d):
    return graph.degrees(_supply(spark, d))


@register(f"WITH e AS {SUPPLY}, v AS (SELECT src AS id FROM e UNION SELECT dst FROM e), g AS (SELECT id, count(e.src) AS out_degree FROM v LEFT JOIN e ON e.src = id GROUP BY 1) SELECT out_degree, count(*) AS n FROM g GROUP BY 1")
def degree_histogram(spark, d):
    return graph.degree_histogram(_supply(spark, d))


UND = f"e AS MATERIALIZED {SUPPLY}, u AS MATERIALIZED (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM e WHERE src <> dst)"


@register(f"WITH {UND} SELECT x.a, x.b, y.b AS c FROM u x JOIN u y ON x.b = y.a JOIN u z ON z.a = x.a AND z.b = y.b")
def triangles(spark, d):
    return graph.triangles(_supply(spark, d))


@register(f"""WITH {UND}, t AS (SELECT x.a, x.b, y.b AS c FROM u x JOIN u y ON x.b = y.a JOIN u z ON z.a = x.a AND z.b = y.b), deg AS (SELECT id, count(*) AS degree FROM (SELECT a AS id FROM u UNION ALL SELECT b FROM u) GROUP BY 1),
k AS (SELECT id, count(*) AS triangles FROM (SELECT a AS id FROM t UNION ALL SELECT b FROM t UNION ALL SELECT c FROM t) GROUP BY 1)
SELECT id, degree, coalesce(triangles, 0) AS triangles, round(CASE WHEN degree > 1 THEN coalesce(triangles, 0) / (degree * (degree - 1) / 2) ELSE 0 END, 4) AS clustering FROM deg LEFT JOIN k USING (id)""")
def clustering(spark, d):
    return graph.clustering(_supply(spark, d)).withColumn("clustering", F.round("clustering", 4))


@register(f"""WITH {UND}, t AS (SELECT count(*) AS n FROM u x JOIN u y ON x.b = y.a JOIN u z ON z.a = x.a AND z.b = y.b), b AS (SELECT a AS x, b AS y FROM u UNION ALL SELECT b, a FROM u), deg AS (SELECT x AS id, count(*)::DOUBLE AS d FROM b GROUP BY 1),
c AS (SELECT corr(p.d, q.d) AS r FROM b JOIN deg p ON p.id = b.x JOIN deg q ON q.id = b.y), s AS (SELECT count(*) AS nodes, sum(d * (d - 1) / 2) AS triplets FROM deg)
SELECT nodes, (SELECT count(*) FROM u) AS edges, round(2 * (SELECT count(*) FROM u) / (nodes * (nodes - 1)), 6) AS density, t.n AS triangles, round(3 * t.n / triplets, 6) AS global_clustering, round(r, 4) AS assortativity FROM s, t, c""")
def graph_size(spark, d):
    out = graph.statistics(_supply(spark, d))
    return out.select("nodes", "edges", F.round("density", 6).alias("density"), "triangles", F.round("global_clustering", 6).alias("global_clustering"), r4(F.col("assortativity"), "assortativity"))


@register("SELECT s.s_suppkey AS a, c.c_custkey AS b FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey JOIN customer c ON c.c_nationkey = n.n_nationkey WHERE n.n_regionkey = 1 AND s.s_acctbal > 5000 AND c.c_mktsegment = 'BUILDING'")
def pattern_match(spark, d):
    """Suppliers and customers of one nation: (a:Supplier)-[:IN]->(n:Nation)<-[:IN]-(b:Customer)."""
    s, n, c = (load(spark, d, t) for t in ("supplier", "nation", "customer"))
    node = lambda df, kind, key, label, props: df.select(F.concat(F.lit(kind), F.col(key)).alias("id"), label.alias("labels"), props.alias("props"))
    nodes = node(s, "s", "s_suppkey", F.when(F.col("s_acctbal") > 5000, F.array(F.lit("Supplier"), F.lit("Rich"))).otherwise(F.array(F.lit("Supplier"))), F.create_map(F.lit("name"), F.col("s_name")))
    nodes = nodes.unionByName(node(n, "n", "n_nationkey", F.array(F.lit("Nation")), F.create_map(F.lit("region"), F.col("n_regionkey").cast("string"))))
    nodes = nodes.unionByName(node(c, "c", "c_custkey", F.array(F.lit("Customer")), F.create_map(F.lit("segment"), F.col("c_mktsegment"))))
    edge = lambda df, kind, key, nation: df.select(F.concat(F.lit("e" + kind), F.col(key)).alias("id"), F.concat(F.lit(kind), F.col(key)).alias("src"), F.concat(F.lit("n"), F.col(nation)).alias("dst"), F.lit("IN").alias("type"))
    edges = edge(s, "s", "s_suppkey", "s_nationkey").unionByName(edge(c, "c", "c_custkey", "c_nationkey"))
    m = pattern.match('(a:Supplier:Rich)-[:IN]->(n:Nation {region: "1"})<-[:IN]-(b:Customer {segment: "BUILDING"})', nodes, edges)
    return m.select(F.substring("a", 2, 20).cast("long").alias("a"), F.substring("b", 2, 20).cast("long").alias("b"))


def _pagerank_sql(rounds: int) -> str:
    parts = [f"WITH e AS MATERIALIZED {SUPPLY}, v AS MATERIALIZED (SELECT src AS id FROM e UNION SELECT dst FROM e), o AS MATERIALIZED (SELECT src, count(*) AS d FROM e GROUP BY 1), n AS (SELECT count(*)::DOUBLE AS n FROM v), r0 AS (SELECT id, 1 / n AS rank FROM v, n)"]
    for i in range(rounds):
        parts.append(f"r{i + 1} AS MATERIALIZED (SELECT v.id, 0.15 / n + 0.85 * (coalesce(g, 0) + coalesce((SELECT sum(rank) FROM r{i} WHERE id NOT IN (SELECT src FROM o)), 0) / n) AS rank FROM v CROSS JOIN n LEFT JOIN (SELECT dst, sum(rank / d) AS g FROM e JOIN o USING (src) JOIN r{i} ON r{i}.id = e.src GROUP BY 1) q ON q.dst = v.id)")
    return ", ".join(parts) + f" SELECT id, round(rank, 6) AS rank FROM r{rounds}"


@register(_pagerank_sql(5))
def pagerank_5(spark, d):
    return graph.pagerank(_supply(spark, d), 5).select("id", F.round("rank", 6).alias("rank"))


HOPS = f"WITH RECURSIVE e AS MATERIALIZED {TRADE}, h AS (SELECT id AS src, id AS dst, 0 AS hops FROM (SELECT src AS id FROM e UNION SELECT dst FROM e) UNION SELECT h.src, e.dst, hops + 1 FROM h JOIN e ON h.dst = e.src WHERE hops < 25), m AS (SELECT src, dst, min(hops) AS hops FROM h GROUP BY 1, 2)"


@register(f"{HOPS} SELECT src, dst, hops FROM m")
def all_pairs_hops(spark, d):
    return graph.all_pairs(_trade(spark, d))


@register(f"{HOPS} SELECT src AS id, count(*) AS reached, round(count(*) / sum(hops), 4) AS closeness FROM m WHERE src <> dst GROUP BY 1")
def closeness(spark, d):
    return graph.closeness(_trade(spark, d)).withColumn("closeness", F.round("closeness", 4))


@register(f"{HOPS}, p AS (SELECT count(*) AS pairs, max(hops) AS most, avg(hops) AS mean FROM m WHERE src <> dst), v AS (SELECT count(DISTINCT src) AS n FROM m) SELECT CASE WHEN pairs = n * (n - 1) THEN most ELSE -1 END AS diameter, round(mean, 4) AS average_path FROM p, v")
def path_statistics(spark, d):
    return graph.path_statistics(_trade(spark, d)).select("diameter", r4(F.col("average_path"), "average_path"))


FROM_FIRST = f"WITH RECURSIVE e AS MATERIALIZED {SUPPLY}, h AS (SELECT min(src) AS id, 0 AS depth FROM e UNION SELECT e.dst, depth + 1 FROM h JOIN e ON h.id = e.src WHERE depth < 12)"


@register(f"{FROM_FIRST} SELECT id, min(depth) AS depth FROM h GROUP BY 1")
def bfs_levels(spark, d):
    e = _supply(spark, d)
    return graph.bfs(e, e.agg(F.min("src")).first()[0])


@register(f"{FROM_FIRST} SELECT id, min(depth)::DOUBLE AS dist FROM h GROUP BY 1")
def shortest_paths(spark, d):
    e = _supply(spark, d)
    return graph.shortest_paths(e, e.agg(F.min("src")).first()[0])


def _relaxed_sql(rounds: int) -> str:
    parts = [f"WITH e AS MATERIALIZED {TRADE}, d0 AS (SELECT min(src) AS id, 0.0::DOUBLE AS dist FROM e)"]
    for i in range(rounds):
        parts.append(f"d{i + 1} AS MATERIALIZED (SELECT id, min(dist) AS dist FROM (SELECT * FROM d{i} UNION ALL SELECT e.dst, dist + w FROM d{i} JOIN e ON e.src = d{i}.id) GROUP BY 1)")
    return ", ".join(parts)


@register(f"{_relaxed_sql(25)} SELECT id, round(dist, 2) AS dist FROM d25")
def weighted_paths(spark, d):
    e = _trade(spark, d)
    return graph.shortest_paths(e, e.agg(F.min("src")).first()[0], "w").select("id", F.round("dist", 2).alias("dist"))


@register(f"{_relaxed_sql(25)} SELECT round(dist, 2) AS dist FROM d25 ORDER BY id DESC LIMIT 1")
def a_star(spark, d):
    """The way to the last nation; what is left is at least the cheapest edge."""
    e = _trade(spark, d)
    first, last, least = e.agg(F.min("src"), F.max("dst"), F.min("w")).first()
    h = graph.vertices(e).select("id", F.when(F.col("id") == last, 0.0).otherwise(least).alias("h"))
    return spark.createDataFrame([(round(graph.a_star(e, first, last, "w", h)[1], 2),)], "dist double")


@register(f"{HOPS} SELECT a.dst AS id, CASE WHEN a.dst = b.src THEN 0 ELSE 1 END AS depth FROM m a, (SELECT min(src) AS src FROM e) b WHERE a.src = b.src")
def walk_order(spark, d):
    """Visitor calls: every reachable nation once, in order."""
    e, seen = _trade(spark, d), []
    graph.walk(e, e.agg(F.min("src")).first()[0], lambda v, depth: seen.append((v, min(depth, 1))))
    return spark.createDataFrame(seen, "id long, depth int")


@register(f"WITH e AS {TRADE}, s AS (SELECT min(src) AS s, max(dst) AS t FROM e) SELECT (SELECT count(*) FROM e, s WHERE src = s AND dst = t) + (SELECT count(*) FROM e a JOIN e b ON a.dst = b.src, s WHERE a.src = s AND b.dst = t AND a.dst NOT IN (s, t)) AS paths")
def simple_paths(spark, d):
    e = _trade(spark, d)
    first, last = e.agg(F.min("src"), F.max("dst")).first()
    return graph.simple_paths(e, first, last, 2).agg(F.count("*").alias("paths"))


REACH = f"WITH RECURSIVE e AS MATERIALIZED {SUPPLY}, b AS MATERIALIZED (SELECT src, dst FROM e UNION SELECT dst, src FROM e), n AS (SELECT DISTINCT src AS id FROM b WHERE src < {SUPPLIER}), r AS (SELECT id, id AS c FROM n UNION SELECT b.dst, r.c FROM r JOIN b ON r.id = b.src), k AS (SELECT id, min(c) AS component FROM r GROUP BY 1)"


@register(f"{REACH} SELECT id, component FROM k")
def components(spark, d):
    """Every customer and supplier hangs on a nation, so components are named by nations."""
    return graph.components(_supply(spark, d))


@register(f"{REACH} SELECT count(*) - count(DISTINCT component) AS edges FROM k")
def spanning_forest(spark, d):
    return graph.spanning_forest(_supply(spark, d)).agg(F.count("*").alias("edges"))


@register(f"WITH RECURSIVE u AS MATERIALIZED (SELECT row_number() OVER (ORDER BY w, a, b) AS k, * FROM (SELECT least(src, dst) AS a, greatest(src, dst) AS b, min(w) AS w FROM {TRADE} WHERE src <> dst GROUP BY 1, 2)), r AS (SELECT k, a AS id FROM u UNION SELECT r.k, CASE WHEN u.a = r.id THEN u.b ELSE u.a END FROM r JOIN u ON u.k < r.k AND r.id IN (u.a, u.b)) SELECT count(*) AS edges, round(sum(w), 2) AS weight FROM u WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.k = u.k AND r.id = u.b)")
def spanning_tree_weight(spark, d):
    """An edge belongs to the tree if no lighter ones connect its ends."""
    return graph.spanning_forest(_trade(spark, d), "w").agg(F.count("*").alias("edges"), F.round(F.sum("w"), 2).alias("weight"))


@register(f"{REACH.replace('b AS MATERIALIZED (SELECT src, dst FROM e UNION SELECT dst, src FROM e)', 'b AS MATERIALIZED (SELECT src, dst FROM e)').replace(', k AS (', ', back AS (SELECT id, id AS c FROM n UNION SELECT e.src, back.c FROM back JOIN e ON back.id = e.dst), s AS (SELECT r.id, min(r.c) AS c FROM r JOIN back USING (id, c) GROUP BY 1), k AS (')} SELECT v.id, coalesce(s.c, v.id) AS component FROM (SELECT src AS id FROM e UNION SELECT dst FROM e) v LEFT JOIN s USING (id)")
def strong_components(spark, d):
    """Every cycle goes through a nation, so a component is a nation's that is reached from it and reaches it, or one vertex."""
    return graph.strong_components(_supply(spark, d))


@register()
def label_propagation(spark, d):
    return graph.label_propagation(_supply(spark, d), 5)


@register()
def betweenness(spark, d):
    return graph.betweenness(_trade(spark, d).select("src", "dst"))


@register()
def eigenvector(spark, d):
    return graph.eigenvector(_supply(spark, d), 10)


@register(f"WITH e AS {TRADE}, v AS (SELECT src AS id FROM e UNION SELECT dst FROM e) SELECT id, (SELECT count(*) FROM e WHERE src = id) AS out_degree, (SELECT count(*) FROM e WHERE dst = id) AS in_degree FROM v")
def all_centralities(spark, d):
    return graph.centralities(_trade(spark, d).select("src", "dst")).select("id", "out_degree", "in_degree")


@register(f"WITH e AS MATERIALIZED {TRADE}, p AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM e WHERE src <> dst) SELECT count(*) AS edges, 0::BIGINT AS clashes FROM p")
def coloring(spark, d):
    e = _trade(spark, d)
    colors = graph.coloring(e)
    table = spark.createDataFrame(list(colors.items()), "id long, color int")
    both = graph.undirected(e).join(table.select(F.col("id").alias("a"), F.col("color").alias("x")), "a").join(table.select(F.col("id").alias("b"), F.col("color").alias("y")), "b")
    return both.agg(F.count("*").alias("edges"), F.count_if(F.col("x") == F.col("y")).alias("clashes"))


@register(f"WITH e AS {TRADE}, s AS (SELECT min(src) AS s, max(dst) AS t FROM e) SELECT CAST((SELECT count(*) FROM e, s WHERE src = s AND dst = t) + (SELECT count(*) FROM e a JOIN e b ON a.dst = b.src, s WHERE a.src = s AND b.dst = t AND a.dst NOT IN (s, t)) AS DOUBLE) AS at_least")
def max_flow(spark, d):
    """With unit capacities, ways of one or two edges are disjoint; between nations that all trade they are a maximum flow."""
    e = _trade(spark, d)
    first, last = e.agg(F.min("src"), F.max("dst")).first()
    flow = graph.max_flow(e.where("src != dst").withColumn("c", F.lit(1.0)), first, last, "c")
    return spark.createDataFrame([(flow,)], "at_least double")


@register(f"WITH e AS {TRADE}, s AS (SELECT min(src) AS s FROM e) SELECT count(DISTINCT dst) AS reached FROM e, s")
def depth_first(spark, d):
    e = _trade(spark, d)
    order = graph.depth_first(e, e.agg(F.min("src")).first()[0])
    return spark.createDataFrame([(len(set(order)),)], "reached long")


@register("SELECT event_id AS id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INTEGER) AS level FROM events QUALIFY count(*) OVER (PARTITION BY user_id) > 1")
def topological_levels(spark, d):
    """Each event waits for the same user's event before it."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = load(ready(spark), d, "events").select(F.lag("event_id").over(w).alias("src"), F.col("event_id").alias("dst")).where("src is not null")
    return graph.topological_levels(e)[0]


@register("SELECT page_id, target FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a\\s+href=\"([^\"]*)\"', 1)) AS target FROM pages)")
def page_links(spark, d):
    return tables.page_links(load(spark, d, "pages"))


GROWN = "SELECT count(*) AS nodes, (SELECT count(*) FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal >= 0) AS edges, (SELECT count(*) FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal >= 0) AS marked FROM (SELECT c_custkey FROM customer WHERE c_acctbal >= 0 UNION ALL SELECT o_orderkey FROM orders)"


@register(GROWN)
def graph_changes(spark, d):
    """Customers, then orders and the edges to their customers; customers in debt go; a property is set."""
    c, o = load(ready(spark), d, "customer"), load(spark, d, "orders")
    node = lambda df, kind, key: df.select(F.concat(F.lit(kind), F.col(key)).alias("id"), F.array(F.lit(kind)).alias("labels"), F.create_map(F.lit("key"), F.col(key).cast("string")).alias("props"))
    nodes = graph.add_nodes(node(c, "c", "c_custkey"), node(o, "o", "o_orderkey").unionByName(node(c, "c", "c_custkey")))
    edges = o.select(F.concat(F.lit("e"), F.col("o_orderkey")).alias("id"), F.concat(F.lit("o"), F.col("o_orderkey")).alias("src"), F.concat(F.lit("c"), F.col("o_custkey")).alias("dst"), F.lit("BY").alias("type"))
    edges = graph.add_edges(nodes, edges.where("false"), edges)
    nodes, edges = graph.remove_nodes(nodes, edges, c.where("c_acctbal < 0").select(F.concat(F.lit("c"), F.col("c_custkey")).alias("id")))
    building = c.where("c_mktsegment = 'BUILDING'").select(F.concat(F.lit("c"), F.col("c_custkey")).alias("id"), F.lit(True).alias("b"))
    nodes = graph.set_property(nodes.join(building, "id", "left"), F.col("b"), "segment", "BUILDING")
    return nodes.agg(F.count("*").alias("nodes"), F.count_if(F.col("props")["segment"] == "BUILDING").alias("marked")).crossJoin(edges.agg(F.count("*").alias("edges")))


# -- integrity ----------------------------------------------------------------
@register("SELECT p_partkey AS k, sha256(p_name) AS h FROM part")
def leaf_hashes(spark, d):
    return load(spark, d, "part").select(F.col("p_partkey").alias("k"), F.sha2("p_name", 256).alias("h"))


@register("WITH RECURSIVE t(l) AS (SELECT list(sha256(c_name) ORDER BY c_custkey) FROM customer UNION ALL SELECT list_transform(range(1, len(l) + 1, 2), lambda i: CASE WHEN i < len(l) THEN sha256(unhex(l[i] || l[i + 1])) ELSE l[i] END) FROM t WHERE len(l) > 1) SELECT l[1] AS root FROM t WHERE len(l) = 1")
def merkle_root(spark, d):
    return integrity.root(integrity.leaves(load(ready(spark), d, "customer"), "c_custkey", "c_name"))


@register()
def ring_load(spark, d):
    return integrity.ring_load(integrity.locate(load(spark, d, "part").select("p_name"), "p_name", ["a", "b", "c", "d"]))


@register()
def cache_simulation(spark, d):
    t = load(spark, d, "events").select((F.col("user_id") % 8).alias("shard"), "event_id", "user_id")
    return integrity.simulate_caches(t, "shard", "event_id", "user_id", 8)


@register("SELECT a.o_orderkey AS first, b.o_orderkey AS second, a.o_custkey AS rid FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey AND a.o_orderkey < b.o_orderkey + 200 AND b.o_orderkey < a.o_orderkey + 200 AND (a.o_orderstatus = 'F' OR b.o_orderstatus = 'F')")
def lock_conflicts(spark, d):
    o = load(spark, d, "orders").select(F.col("o_orderkey").alias("txn"), F.col("o_custkey").alias("rid"), F.when(F.col("o_orderstatus") == "F", "X").otherwise("S").alias("mode"), F.col("o_orderkey").alias("start"), (F.col("o_orderkey") + 200).alias("end"))
    return integrity.lock_conflicts(o)


@register("SELECT event_id AS lsn FROM events WHERE event_type NOT IN ('error', 'click') AND user_id IN (SELECT user_id FROM events WHERE event_type = 'click') AND event_id > (SELECT max(event_id) FROM events WHERE event_type = 'error' AND event_id < 300)")
def redo_log(spark, d):
    kind = F.when((F.col("event_type") == "error") & (F.col("event_id") < 300), "CHECKPOINT").when(F.col("event_type") == "click", "COMMIT").when(F.col("event_type") == "error", "NOTE").otherwise("UPDATE")
    rows = load(spark, d, "events").select(F.col("user_id").alias("txn"), kind.alias("kind"), F.col("event_id").alias("lsn"))
    return integrity.redo_and_undo(rows)[0].select("lsn")


@register("SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE ** 2))), 4) AS norm FROM embeddings")
def vector_norm(spark, d):
    return load(spark, d, "embeddings").select("vec_id", r4(scoring.norm(F.col("embedding")), "norm"))
