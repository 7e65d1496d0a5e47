"""Registered queries of functions, structures, codecs, writes and policies, with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.functions import codecs, scoring, text
from quillspark.operators import integrity, search, structures, vectors, versioned
from quillspark.plans import explain, statements
from quillspark.queries import r4, register
from quillspark.session import load, new_path, ready, written
from quillspark.sources import records, tables
from quillspark.streaming import groups, log

# -- scores --------------------------------------------------------------------
#: Lines as documents: quantity is the term's count, the line number its document count, price the length.
IDF = "greatest(0, ln((50 + 1) / (l_linenumber + 0.5)))"
REL = "((l_extendedprice - 30000) / 30000)"


@register(f"""SELECT l_orderkey, l_linenumber, round(l_quantity * {IDF}, 4) AS raw, round((0.5 + 0.5 * l_quantity / 50) * {IDF}, 4) AS augmented,
round(l_quantity * least(2.0, greatest(0.1, 1 / sqrt(greatest(1 + {REL}, 1e-12)))), 4) AS by_length,
round(l_quantity * (1 / greatest(0.01, 1 - 0.2 + 0.2 * greatest(0.01, l_extendedprice / 30000))) / greatest(0.01, l_extendedprice / 30000), 4) AS pivoted,
round(l_quantity / (1 + exp(-0.1 * (l_quantity - 25))), 4) AS boosted,
round(exp(-((greatest(0, abs(l_quantity - 25) - 5) / 10) ** 2) / 2) * 0.5 + 0.5, 4) AS decayed,
round((2 * l_quantity + 3 * l_tax) / 5, 4) AS weighted FROM lineitem""")
def score_variants(spark, d):
    q, n, p = F.col("l_quantity"), F.col("l_linenumber"), F.col("l_extendedprice")
    return load(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber",
        r4(scoring.tfidf_raw(q, n, 50), "raw"), r4(scoring.tfidf_augmented(q, n, 50, F.lit(50)), "augmented"), r4(scoring.by_length(q, p, 30000.0), "by_length"), r4(scoring.pivoted(q, p, 30000.0, 0.2), "pivoted"),
        r4(scoring.sigmoid_boost(q, 25.0, 0.1), "boosted"), r4(scoring.gauss_decay(q, 25.0, 10.0, 5.0, 0.5), "decayed"), r4(scoring.weighted([q, F.col("l_tax")], [2.0, 3.0]), "weighted"),
    )


@register("""SELECT l_orderkey, l_linenumber, round(CASE WHEN tf > 0 THEN greatest(0, ln((50 - l_linenumber + 0.5) / (l_linenumber + 0.5))) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l_extendedprice / 30000)) ELSE 0 END, 4) AS bm25f,
round(greatest(l_quantity - 0.7, 0) / l_extendedprice + 0.7 * l_linenumber / l_extendedprice * l_tax, 6) AS discounted, round(0.6 * (l_quantity + 100 * l_tax) / (l_extendedprice + 100) + 0.4 * l_discount, 6) AS two_stage
FROM (SELECT *, 2 * l_quantity + 0.5 * l_linenumber AS tf FROM lineitem)""")
def score_models(spark, d):
    q, n, p = F.col("l_quantity"), F.col("l_linenumber"), F.col("l_extendedprice")
    return load(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", r4(scoring.bm25f([q, n], [2.0, 0.5], n, 50, p, 30000.0), "bm25f"),
        F.round(scoring.absolute_discount(q, p, n, F.col("l_tax"), 0.7), 6).alias("discounted"), F.round(scoring.two_stage(q, p, F.col("l_tax"), 100.0, 0.4, F.col("l_discount")), 6).alias("two_stage"),
    )


@register("SELECT p_partkey, round(len(list_intersect(string_split(p_type, ' '), ['STEEL', 'PROMO', 'COPPER'])) / 3, 4) AS share FROM part")
def term_overlap(spark, d):
    return load(spark, d, "part").select("p_partkey", r4(scoring.overlap(F.array(F.lit("STEEL"), F.lit("PROMO"), F.lit("COPPER")), F.split("p_type", " ")), "share"))


@register("SELECT a.vec_id, round(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: p[1]::DOUBLE + p[2]::DOUBLE)), 3) AS total, round(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: p[1]::DOUBLE - p[2]::DOUBLE)), 3) AS rest, len(list_filter(a.embedding, lambda x: x > 0)) AS set_bits, round(coalesce(1 - len(list_filter(list_zip(a.embedding, b.embedding), lambda p: p[1] > 0 AND p[2] > 0)) / nullif(len(list_filter(list_zip(a.embedding, b.embedding), lambda p: p[1] > 0 OR p[2] > 0)), 0), 0), 4) AS jaccard FROM embeddings a, (SELECT embedding FROM embeddings WHERE vec_id = 3) b")
def vector_algebra(spark, d):
    e = load(spark, d, "embeddings")
    b = F.array(*[F.lit(float(x)) for x in e.where("vec_id = 3").first()["embedding"]])
    a = F.col("embedding")
    total = lambda v: F.round(F.aggregate(v, F.lit(0.0), lambda s, x: s + x), 3)
    return e.select("vec_id", total(scoring.add(a, b)).alias("total"), total(scoring.sub(a, b)).alias("rest"), F.size(F.filter(scoring.bits(a), lambda x: x)).cast("long").alias("set_bits"), r4(scoring.jaccard_bits(scoring.bits(a), scoring.bits(b)), "jaccard"))


@register("SELECT a.vec_id AS a, b.vec_id AS b, round(list_max(list_transform(list_zip(a.embedding, b.embedding), lambda p: abs(p[1]::DOUBLE - p[2]::DOUBLE))), 4) AS distance FROM embeddings a, embeddings b WHERE b.vec_id % 100 = 0")
def pairwise_linf(spark, d):
    """The stated query set against all rows."""
    e = load(spark, d, "embeddings")
    return vectors.pairwise(e, e.where("vec_id % 100 = 0"), "linf").select("a", "b", r4(F.col("distance"), "distance"))


@register("WITH m AS (SELECT p, avg(x) AS m FROM (SELECT unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS p FROM embeddings) GROUP BY 1) SELECT vec_id, round(sqrt(sum((x - m.m) ** 2)), 3) AS spread FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS p FROM embeddings) e JOIN m USING (p) GROUP BY 1")
def centered_norms(spark, d):
    e = load(spark, d, "embeddings")
    mean = [r["mean"] for r in sorted(vectors.mean_vector(e).collect())]
    return e.select("vec_id", F.round(scoring.norm(scoring.sub(F.col("embedding"), F.array(*[F.lit(x) for x in mean]))), 3).alias("spread"))


@register("SELECT count(*) AS n, 0::BIGINT AS identity, 0::BIGINT AS symmetry, 0::BIGINT AS triangle FROM embeddings WHERE vec_id + 2 IN (SELECT vec_id FROM embeddings) AND vec_id + 1 IN (SELECT vec_id FROM embeddings)")
def metric_axioms(spark, d):
    e = load(spark, d, "embeddings").select("vec_id", "embedding")
    at = lambda k, name: e.select((F.col("vec_id") - k).alias("vec_id"), F.col("embedding").alias(name))
    t = written(at(0, "a").join(at(1, "b"), "vec_id").join(at(2, "c"), "vec_id"), "triples")
    return t.agg(F.count("*").alias("n")).crossJoin(vectors.metric_axioms(t, "l2"))


@register("SELECT count(*) AS n, 16::BIGINT AS dim, 0::BIGINT AS outside FROM part")
def random_vectors(spark, d):
    v = vectors.random_vectors(load(spark, d, "part").select("p_partkey"), 16)
    return v.agg(F.count("*").alias("n"), F.max(F.size("embedding")).cast("long").alias("dim"), F.count_if(F.exists("embedding", lambda x: F.abs(x) > 1)).alias("outside"))


@register("SELECT count(*) // 100 + 1 AS queries, 1.0::DOUBLE AS recall, 1.0::DOUBLE AS first_right, 1.0::DOUBLE AS mrr FROM embeddings WHERE vec_id > 0")
def batch_metrics(spark, d):
    """Exact neighbours held against themselves."""
    e = load(spark, d, "embeddings").select("vec_id", "embedding")
    truth = written(vectors.knn_join(e, e.where("vec_id % 100 = 0"), 10), "truth")
    return vectors.batch_metrics(truth, truth, 10)


@register()
def product_codes(spark, d):
    """Error of codes, their entropy, and pairs of neighbours by code."""
    e = load(ready(spark), d, "embeddings").select("vec_id", "embedding")
    ivf = vectors.IVF(lists=4, probes=4, parts=8, codes=16).fit(e)
    index = written(ivf.build(e), "codes")
    pairs = index.alias("x").join(index.alias("y"), (F.col("x.vec_id") + 1 == F.col("y.vec_id")) & (F.col("x.list") == F.col("y.list"))).select(F.col("x.codes").alias("a"), F.col("y.codes").alias("b"))
    near = pairs.agg(F.count_if(vectors.codes_differ(F.col("a"), F.col("b")) <= 4).alias("near"), F.avg(vectors.symmetric_distance(ivf.books, "a", "b")).alias("mean_distance"))
    return vectors.reconstruction_error(index, ivf).crossJoin(vectors.code_entropy(index).agg(F.avg("entropy").alias("entropy"))).crossJoin(near)


# -- text ------------------------------------------------------------------------
NAMES = "(SELECT a.n_nationkey AS a, b.n_nationkey AS b, a.n_name AS x, b.n_name AS y FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey)"


def _names(spark, d):
    n = load(spark, d, "nation")
    return n.select(F.col("n_nationkey").alias("a"), F.col("n_name").alias("x")).join(n.select(F.col("n_nationkey").alias("b"), F.col("n_name").alias("y")), F.col("a") < F.col("b"))


@register(f"SELECT a, b, damerau_levenshtein(x, y) AS edits FROM {NAMES}")
def osa_edits(spark, d):
    return _names(spark, d).select("a", "b", text.osa_distance()("x", "y").cast("long").alias("edits"))


GRAMS = "list_transform(range(1, len({0}) + 2), lambda i: substr('_' || {0} || '_', i, 2))"


@register(f"SELECT a, b, round(CASE WHEN x = y THEN 1 ELSE list_sum(list_transform(g, lambda k: least(len(list_filter(p, lambda z: z = k)), len(list_filter(q, lambda z: z = k))))) / list_sum(list_transform(g, lambda k: greatest(len(list_filter(p, lambda z: z = k)), len(list_filter(q, lambda z: z = k))))) END, 4) AS jaccard FROM (SELECT *, list_distinct(p || q) AS g FROM (SELECT *, {GRAMS.format('x')} AS p, {GRAMS.format('y')} AS q FROM {NAMES}))")
def ngram_similarity(spark, d):
    return _names(spark, d).select("a", "b", r4(text.ngram_jaccard(F.col("x"), F.col("y"), 2), "jaccard"))


CODE = "CASE WHEN c IN ('B','F','P','V') THEN '1' WHEN c IN ('C','G','J','K','Q','S','X','Z') THEN '2' WHEN c IN ('D','T') THEN '3' WHEN c = 'L' THEN '4' WHEN c IN ('M','N') THEN '5' WHEN c = 'R' THEN '6' ELSE '' END"


@register(f"SELECT p_partkey, CASE WHEN w = '' THEN '' ELSE substr(w[1] || coalesce(list_aggregate(list_transform(range(2, len(k) + 1), lambda i: CASE WHEN k[i] <> '' AND k[i] <> k[i - 1] THEN k[i] ELSE '' END), 'string_agg', ''), '') || '000', 1, 4) END AS code FROM (SELECT p_partkey, w, list_transform(string_split(w, ''), lambda c: {CODE}) AS k FROM (SELECT p_partkey, regexp_replace(upper(p_name), '[^A-Z]', '', 'g') AS w FROM part))")
def soundex(spark, d):
    return load(spark, d, "part").select("p_partkey", text.soundex_code()("p_name").alias("code"))


@register("SELECT n_name AS word, 54 * length(n_name) + 25 AS variants FROM nation WHERE length(n_name) > 0")
def one_edit_variants(spark, d):
    return text.edit_variants(load(spark, d, "nation"), "n_name").groupBy("word").agg(F.count("*").alias("variants"))


@register("SELECT c_custkey, CAST(list_reduce([5381::BIGINT] || list_transform(string_split(c_name, ''), lambda c: ascii(c)::BIGINT), lambda h, b: (h * 33 + b) % 4294967296) % 12 AS INTEGER) AS partition FROM customer")
def hash_partition(spark, d):
    return load(spark, d, "customer").select("c_custkey", text.djb2_partition(12)("c_name").alias("partition"))


@register("SELECT doc_id, CAST(len(list_distinct(list_filter(regexp_split_to_array(regexp_replace(lower(coalesce(text, '')), '[.,;:!?()\\[\\]{}\"'']', '', 'g'), '\\s+'), lambda x: x <> ''))) AS BIGINT) AS terms FROM documents")
def analyzed_terms(spark, d):
    return load(spark, d, "documents").select("doc_id", F.size(F.array_distinct(text.analyzed(F.col("text"), stop=()))).cast("long").alias("terms"))


# -- structures ------------------------------------------------------------------
ITEMS = "(SELECT user_id, list(event_id ORDER BY event_id) AS l FROM events GROUP BY 1)"


def _items(spark, d):
    return load(spark, d, "events").groupBy("user_id").agg(F.array_sort(F.collect_list("event_id")).alias("l"))


@register(f"SELECT user_id, l[1] AS popped, l[-1] AS right_popped, len(l) AS n, ([-1] || l)[1] AS pushed, len(list_append(l, 0)) AS longer, l[2] AS second, l[-1] AS last, len(l) - 1 AS rest FROM {ITEMS}")
def list_ends(spark, d):
    l = F.col("l")
    first, rest = structures.lpop(l)
    last, _ = structures.rpop(l)
    size = lambda x, name: F.size(x).cast("long").alias(name)
    return _items(spark, d).select("user_id", first.alias("popped"), last.alias("right_popped"), size(l, "n"), structures.lindex(structures.lpush(l, F.lit(-1).cast("long")), 0).alias("pushed"), size(structures.rpush(l, F.lit(0).cast("long")), "longer"), structures.lindex(l, 1).alias("second"), structures.lindex(l, -1).alias("last"), size(rest, "rest"))


@register("SELECT c_custkey, len(list_distinct(['a', c_mktsegment, 'b'])) AS n, c_mktsegment <> 'b' AS member, len(list_distinct(['a', c_mktsegment])) AS less FROM customer")
def set_members(spark, d):
    s = structures.sadd(structures.sadd(F.array(F.lit("a")), F.col("c_mktsegment")), F.lit("b"))
    return load(spark, d, "customer").select("c_custkey", F.size(s).cast("long").alias("n"), (structures.sismember(s, F.col("c_mktsegment")) & (F.col("c_mktsegment") != "b")).alias("member"), F.size(structures.srem(s, F.lit("b"))).cast("long").alias("less"))


@register("SELECT c_custkey, c_mktsegment AS segment, 2::BIGINT AS n, true AS has, NULL::VARCHAR AS gone FROM customer")
def hash_fields(spark, d):
    m = structures.hset(structures.hset(F.create_map(F.lit("name"), F.col("c_name")), F.lit("segment"), F.lit("old")), F.lit("segment"), F.col("c_mktsegment"))
    less = structures.hdel(m, F.lit("name"))
    return load(spark, d, "customer").select("c_custkey", structures.hget(m, F.lit("segment")).alias("segment"), F.size(structures.hkeys(m)).cast("long").alias("n"), structures.hexists(m, F.lit("name")).alias("has"), structures.hget(less, F.lit("name")).alias("gone"))


# -- codecs ------------------------------------------------------------------------
@register(f"SELECT user_id, CAST(list_sum(list_transform(g, lambda v: CASE WHEN v < 128 THEN 1 WHEN v < 16384 THEN 2 WHEN v < 2097152 THEN 3 WHEN v < 268435456 THEN 4 ELSE 5 END)) AS BIGINT) AS n_bytes, true AS back FROM (SELECT user_id, list_transform(range(1, len(l) + 1), lambda i: CASE WHEN i = 1 THEN l[1] ELSE l[i] - l[i - 1] END) AS g FROM {ITEMS})")
def gap_bytes(spark, d):
    """Ascending ids as gaps in variable bytes."""
    enc = codecs.column_codec(lambda v: codecs.varint_encode(codecs.delta_encode([int(x) for x in v])), "binary")
    dec = codecs.column_codec(lambda b: codecs.delta_decode(codecs.varint_decode(bytes(b))), "array<long>")
    return _items(spark, d).withColumn("b", enc("l")).select("user_id", F.length("b").cast("long").alias("n_bytes"), (dec("b") == F.col("l")).alias("back"))


BITS = "(floor(log2(p_partkey + 1))::BIGINT)"


@register(f"SELECT p_partkey, 2 * {BITS} + 1 AS gamma, {BITS} + 2 * floor(log2({BITS} + 1))::BIGINT + 1 AS delta, (p_partkey + 1) // 16 + 5 AS rice, true AS back FROM part")
def code_lengths(spark, d):
    """Bits of each key plus one, as these codes start at one. A code is as long as its key is large, so few rows are much work: they are dealt over all cores."""

    def codes(v):
        gamma, delta, rice = codecs.gamma_encode([v]), codecs.delta_code_encode([v]), codecs.rice_encode([v], 4)
        back = [v] == codecs.gamma_decode(*gamma) == codecs.delta_code_decode(*delta) == codecs.rice_decode(*rice, 4)
        return [gamma[1], delta[1], rice[1], int(back)]

    rows = load(spark, d, "part").select("p_partkey").repartition(4 * spark.sparkContext.defaultParallelism)
    c = F.col("codes")
    rows = rows.withColumn("codes", codecs.column_codec(codes, "array<long>")(F.col("p_partkey") + 1))
    return rows.select("p_partkey", c[0].alias("gamma"), c[1].alias("delta"), c[2].alias("rice"), (c[3] == 1).alias("back"))


@register(f"SELECT user_id, len(l) AS n, true AS back FROM {ITEMS}")
def packed_words(spark, d):
    check = codecs.column_codec(lambda v: codecs.simple9_decode(codecs.simple9_encode([int(x) for x in v]), len(v)) == [int(x) for x in v], "boolean")
    return _items(spark, d).select("user_id", F.size("l").cast("long").alias("n"), check("l").alias("back"))


@register("SELECT c_custkey, true AS back, true AS same_crc FROM customer")
def envelopes(spark, d):
    def back(name):
        data = codecs.envelope_encode(7, b"k", name.encode())
        return codecs.envelope_decode(data) == (7, b"k", name.encode(), b"") and codecs.rle_decode(codecs.rle_encode(data)) == data

    def crc(name):
        raw = name.encode()
        return codecs.crc32c(raw[3:], codecs.crc32c(raw[:3])) == codecs.crc32c(raw)

    return load(spark, d, "customer").select("c_custkey", codecs.column_codec(back, "boolean")("c_name").alias("back"), codecs.column_codec(crc, "boolean")("c_name").alias("same_crc"))


@register("SELECT o_orderkey FROM orders ORDER BY o_custkey, o_orderkey LIMIT 50")
def ordered_keys(spark, d):
    """Bytes that sort as their parts."""
    key = codecs.column_codec(lambda v: codecs.composite_key(int(v[0]), int(v[1])), "binary")
    return load(spark, d, "orders").select("o_orderkey", key(F.array("o_custkey", "o_orderkey")).alias("k")).orderBy("k").limit(50).select("o_orderkey")


@register("SELECT count(*) AS n, count(*) AS found FROM part")
def bloom_members(spark, d):
    p = load(spark, d, "part").select("p_partkey")
    bloom = codecs.Bloom(1 << 18, 4)
    for row in p.toLocalIterator():
        bloom.add(str(row[0]).encode())
    return p.agg(F.count("*").alias("n"), F.count_if(codecs.column_codec(lambda v: str(int(v)).encode() in bloom, "boolean")("p_partkey")).alias("found"))


@register("SELECT user_id, count(*) AS n, CAST(min(event_id) AS BIGINT) AS base FROM events GROUP BY 1")
def message_sets(spark, d):
    """A user's records as one set with a base offset, and back."""
    size = codecs.column_codec(lambda v: len(codecs.message_set_decode(codecs.message_set_encode(int(v[0]), [(int(x), b"k", str(x).encode()) for x in v]))[1]), "long")
    base = codecs.column_codec(lambda v: codecs.message_set_decode(codecs.message_set_encode(int(v[0]), [(int(x), b"k", b"") for x in v]))[0], "long")
    return _items(spark, d).select("user_id", size("l").alias("n"), base("l").alias("base"))


@register(f"SELECT user_id, round(8.0 * len(l) / list_sum(list_transform(g, lambda v: CASE WHEN v < 128 THEN 1 WHEN v < 16384 THEN 2 WHEN v < 2097152 THEN 3 ELSE 4 END)), 4) AS ratio FROM (SELECT *, list_transform(range(1, len(l) + 1), lambda i: CASE WHEN i = 1 THEN l[1] ELSE l[i] - l[i - 1] END) AS g FROM {ITEMS})")
def compression_ratio(spark, d):
    f = codecs.column_codec(lambda v: codecs.compression_ratio(8 * len(v), len(codecs.varint_encode(codecs.delta_encode([int(x) for x in v])))), "double")
    return _items(spark, d).select("user_id", r4(f("l"), "ratio"))


# -- writes ------------------------------------------------------------------------
ORDER_KV = "(SELECT o_orderkey AS k, o_custkey AS v FROM orders)"


def _versions(spark, d):
    o = load(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("v"), F.lit(1).cast("long").alias("seqno"), F.lit(False).alias("is_deleted"))
    return versioned.Versions(o)


@register("SELECT k, CASE WHEN k % 7 = 0 THEN v + 1000000 ELSE v END AS v FROM " + ORDER_KV + " WHERE k % 5 <> 0 UNION ALL SELECT k + 100000000, v FROM " + ORDER_KV + " WHERE k % 11 = 0")
def put_and_delete(spark, d):
    """Updates, then deletions, then keys that are new."""
    kv = _versions(spark, d)
    rows = kv.df
    kv = kv.put(rows.where("k % 7 = 0").select("k", (F.col("v") + 1000000).alias("v"), F.lit(2).cast("long").alias("seqno")))
    kv = kv.delete(rows.where("k % 5 = 0").select("k", F.lit(3).cast("long").alias("seqno")))
    kv = kv.put(rows.where("k % 11 = 0").select((F.col("k") + 100000000).alias("k"), "v", F.lit(4).cast("long").alias("seqno")))
    return kv.latest().select("k", "v")


@register("SELECT c_custkey, c_name FROM customer UNION ALL SELECT c_custkey + 1000000, 'new' FROM customer WHERE c_custkey % 3 = 0")
def insert_new_keys(spark, d):
    c = load(spark, d, "customer").select("c_custkey", "c_name")
    more = c.where("c_custkey % 3 = 0").select((F.col("c_custkey") + 1000000).alias("c_custkey"), F.lit("new").alias("c_name"))
    return versioned.insert_unique(c, more.unionByName(c.withColumn("c_name", F.lit("clash"))), "c_custkey")


@register("SELECT o_orderkey AS k, o_custkey AS v FROM orders WHERE o_orderkey BETWEEN 100 AND 400")
def sorted_run(spark, d):
    path = new_path(ready(spark), "run")
    tables.write_sorted(load(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("v")), path, "k", 4)
    return tables.read(spark, path).where("k between 100 and 400")


@register("SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1")
def csv_round_trip(spark, d):
    path = new_path(ready(spark), "csv")
    tables.write(load(spark, d, "customer").select("c_custkey", "c_nationkey"), path, "csv", header="true")
    return tables.read(spark, path, "csv", "c_custkey long, c_nationkey int", header="true").groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("n"))


@register("SELECT count(*) AS nodes, (SELECT count(*) FROM customer) AS edges FROM (SELECT c_custkey FROM customer UNION ALL SELECT n_nationkey FROM nation)")
def graph_round_trip(spark, d):
    c, n = load(ready(spark), d, "customer"), load(spark, d, "nation")
    nodes = c.select(F.concat(F.lit("c"), F.col("c_custkey")).alias("id")).unionByName(n.select(F.concat(F.lit("n"), F.col("n_nationkey")).alias("id")))
    edges = c.select(F.concat(F.lit("c"), F.col("c_custkey")).alias("src"), F.concat(F.lit("n"), F.col("c_nationkey")).alias("dst"), F.lit("IN").alias("type"))
    path = new_path(spark, "graph")
    tables.save_graph(nodes, edges, path)
    nodes, edges = tables.load_graph(spark, path)
    return nodes.agg(F.count("*").alias("nodes")).crossJoin(edges.agg(F.count("*").alias("edges")))


@register("SELECT vec_id, len(embedding) AS dim FROM embeddings")
def collection_round_trip(spark, d):
    path = new_path(ready(spark), "collection")
    e = load(spark, d, "embeddings").select("vec_id", "embedding")
    ivf = vectors.IVF(lists=4, probes=4).fit(e)
    tables.save_collection(e, ivf.build(e), path)
    _, index = tables.load_collection(spark, path)
    return index.select("vec_id", F.size("vec").cast("long").alias("dim"))


@register("SELECT event_id AS lsn, event_type AS payload FROM events WHERE event_id >= 500")
def record_log(spark, d):
    path = new_path(ready(spark), "log")
    spark.dataSource.register(records.RecordLog)
    load(spark, d, "events").select(F.col("event_id").alias("lsn"), F.col("event_type").cast("binary").alias("payload")).write.format("recordlog").mode("append").save(path)
    return spark.read.format("recordlog").option("since", "500").load(path).select("lsn", F.col("payload").cast("string").alias("payload"))


@register("SELECT c_custkey, c_name AS name, c_acctbal AS balance FROM customer")
def bson_fields(spark, d):
    enc = codecs.column_codec(lambda v: records.bson_document({"name": v[0], "balance": float(v[1])}), "binary")
    doc = records.bson_json()(enc(F.array("c_name", F.col("c_acctbal").cast("string"))))
    return load(spark, d, "customer").withColumn("doc", doc).select("c_custkey", versioned.field(F.col("doc"), "name").alias("name"), versioned.field(F.col("doc"), "balance").cast("double").alias("balance"))


@register("SELECT c_custkey AS id, c_name AS name FROM customer WHERE c_acctbal > 9000 UNION ALL SELECT 0, 'it''s new'")
def ddl_and_dml(spark, d):
    """CREATE, INSERT of values, a load, SELECT and DROP on a catalog of tables in the shared folder."""
    db = statements.Catalog(ready(spark))
    db.run("CREATE TABLE people(id BIGINT, name VARCHAR(40), balance DOUBLE)")
    db.run("INSERT INTO people VALUES (0, 'it''s new', 10000)")
    db.append("people", load(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance")))
    out = written(db.run("SELECT id, name FROM people WHERE balance > 9000 ORDER BY id"), "people")
    db.run("DROP TABLE people")
    return out


# -- policies ------------------------------------------------------------------------
@register("SELECT event_id // 100 AS run, min(event_id) AS min_key, max(event_id) AS max_key FROM events GROUP BY 1 HAVING max(event_id) >= 250 AND min(event_id) <= 460")
def leveled_pick(spark, d):
    runs = load(spark, d, "events").groupBy(F.expr("event_id div 100").alias("run")).agg(F.min("event_id").alias("min_key"), F.max("event_id").alias("max_key"))
    return versioned.overlapping_runs(runs, 250, 460)


@register("SELECT event_id // 100 AS run FROM events GROUP BY 1 HAVING (SELECT count(DISTINCT event_id // 100) FROM events) >= 4")
def universal_pick(spark, d):
    runs = load(spark, d, "events").groupBy(F.expr("event_id div 100").alias("run")).agg(F.count("*").alias("n"))
    return versioned.universal_pick(runs, 4).select("run")


@register("SELECT tablet, count(*) AS n FROM (SELECT CASE WHEN c_custkey < 40 THEN 0 WHEN c_custkey < 100 THEN 1 ELSE 2 END AS tablet FROM customer) GROUP BY 1")
def tablet_split(spark, d):
    parts = versioned.split_tablet(versioned.split_tablet([(None, None)], 100), 40)
    return load(spark, d, "customer").select(versioned.tablet_of(F.col("c_custkey"), parts).cast("int").alias("tablet")).groupBy("tablet").agg(F.count("*").alias("n"))


@register("SELECT count(*) FILTER (WHERE v IS NOT NULL) AS kept, 0::BIGINT AS old FROM (SELECT CASE WHEN event_type = 'click' THEN NULL ELSE value END AS v, event_id FROM events)")
def tombstone_removal(spark, d):
    e = load(spark, d, "events").select(F.col("user_id").alias("k"), F.when(F.col("event_type") != "click", F.col("value")).alias("v"), F.col("event_id").alias("ts"))
    now = e.agg(F.max("ts")).first()[0] + 10
    left = log.without_old_tombstones(e, "k", "v", "ts", now, 9)
    return left.agg(F.count_if(F.col("v").isNotNull()).alias("kept"), F.count_if(F.col("v").isNull()).alias("old"))


@register("SELECT CAST(user_id % 3 AS VARCHAR) AS group_id, 'events' AS topic, CAST(user_id % 4 AS INTEGER) AS partition, max(event_id) AS committed FROM events GROUP BY ALL")
def offset_store(spark, d):
    commits = load(spark, d, "events").select((F.col("user_id") % 3).cast("string").alias("group_id"), F.lit("events").alias("topic"), (F.col("user_id") % 4).cast("int").alias("partition"), F.col("event_id").alias("offset"), F.col("event_id").alias("commit_seq"))
    return log.committed_offsets(commits)


@register("SELECT user_id, least(max(event_id), 700) AS cut FROM events GROUP BY 1")
def replica_truncation(spark, d):
    return load(spark, d, "events").groupBy("user_id").agg(F.max("event_id").alias("leo")).select("user_id", log.truncation_offset(F.col("leo"), F.lit(700).cast("long")).alias("cut"))


@register("SELECT member, count(*) AS partitions FROM (SELECT CASE WHEN r < 4 THEN 'a' WHEN r < 8 THEN 'c' ELSE 'd' END AS member FROM range(12) t(r)) GROUP BY 1")
def group_rebalance(spark, d):
    """Members a, b and c join, b leaves, d joins; twelve partitions of the events are dealt out by range."""
    g = groups.Group("readers").join("a").join("b").join("c").leave("b").join("d")
    parts = spark.range(12).select(F.col("id").cast("int").alias("partition"))
    return g.assignment(parts, ["partition"]).groupBy("member").agg(F.count("*").alias("partitions"))


@register("SELECT CAST(user_id % 4 AS INTEGER) AS partition, count(*) AS n, max(\"offset\") + 1 AS end_offset FROM (SELECT user_id, row_number() OVER (PARTITION BY user_id % 4 ORDER BY event_id) - 1 AS \"offset\" FROM events) GROUP BY 1")
def produced(spark, d):
    """Records get the next offsets of their partitions, in order, in two batches."""
    e = load(spark, d, "events").select((F.col("user_id") % 4).cast("int").alias("partition"), F.col("event_id").alias("seq"), F.col("event_type").alias("value"))
    empty = e.where("false").withColumn("offset", F.lit(0).cast("long"))
    half = e.agg(F.expr("median(seq)")).first()[0]
    out = groups.append(groups.append(empty, e.where(F.col("seq") <= half), "seq"), e.where(F.col("seq") > half), "seq")
    return out.groupBy("partition").agg(F.count("*").alias("n"), (F.max("offset") + 1).alias("end_offset"))


@register("SELECT count(*) AS records FROM events WHERE event_id // 100 >= 3")
def cleaner_cycle(spark, d):
    e = load(spark, d, "events").select(F.col("user_id").alias("key"), "value", F.col("event_id").alias("offset"), F.col("event_id").alias("timestamp"), F.expr("event_id div 100").alias("segment"))
    now = e.agg(F.max("timestamp")).first()[0]
    return log.clean(e, log.CleanerConfig("time", retention_ms=now - 300), now).agg(F.count("*").alias("records"))


@register("SELECT count(*) AS written, count(*) AS read FROM part")
def quorums(spark, d):
    """Three replicas a key, one node down: two answers are enough for all."""
    keys = load(spark, d, "part").select("p_partkey", F.col("p_partkey").cast("string").alias("key"))
    placed = integrity.locate(keys, "key", ["a", "b", "c", "d"], n=3)
    ok = integrity.quorum(placed, ["a", "b", "c"], 2)
    return ok.agg(F.count_if("reached").alias("written"), F.count_if("reached").alias("read"))


@register("SELECT count(*) AS n, count(*) AS keys, 0::BIGINT AS left FROM customer".replace("AS left", 'AS "left"'))
def hinted_handoff(spark, d):
    hints = load(spark, d, "customer").select(F.lit("b").alias("node"), F.col("c_custkey").cast("string").alias("key"), F.col("c_name").alias("value"), F.col("c_custkey").alias("seq"))
    drained, left = integrity.drain_hints(hints, "b")
    return drained.agg(F.count("*").alias("n"), F.countDistinct("key").alias("keys")).crossJoin(left.agg(F.count("*").alias("left")))


@register("SELECT p_partkey, 3::BIGINT AS copies FROM part")
def ring_replicas(spark, d):
    placed = integrity.locate(load(spark, d, "part").select("p_partkey", "p_name"), "p_name", ["a", "b", "c", "d"], n=3)
    return placed.select("p_partkey", F.size(F.array_distinct("owners")).cast("long").alias("copies"))


@register("SELECT k AS i FROM (SELECT *, row_number() OVER (ORDER BY c_custkey) - 1 AS k FROM customer) WHERE c_acctbal < 0")
def merkle_difference(spark, d):
    c = load(ready(spark), d, "customer").select("c_custkey", "c_name", "c_acctbal")
    changed = c.withColumn("c_name", F.when(F.col("c_acctbal") < 0, F.concat("c_name", F.lit("!"))).otherwise(F.col("c_name")))
    return integrity.differing(integrity.leaves(c, "c_custkey", "c_name"), integrity.leaves(changed, "c_custkey", "c_name"))


@register("SELECT true AS proved, false AS forged")
def merkle_proof(spark, d):
    tree = integrity.levels(integrity.leaves(load(ready(spark), d, "supplier"), "s_suppkey", "s_name"))
    leaf, root = tree[0].where("i = 3").first()["h"], tree[-1].first()["h"]
    path = integrity.proof(tree, 3)
    return spark.createDataFrame([(integrity.verify(leaf, path, root), integrity.verify("00" * 32, path, root))], "proved boolean, forged boolean")


@register("SELECT term, round(greatest(0, sum(w)), 4) AS w FROM (SELECT 'steel' AS term, 1.0 AS w UNION ALL SELECT lower(t), 0.75 * count(*) / (SELECT count(*) FROM part WHERE p_size > 25) FROM (SELECT unnest(string_split(p_type, ' ')) AS t FROM part WHERE p_size > 25) GROUP BY 1 UNION ALL SELECT lower(t), -0.15 * count(*) / (SELECT count(*) FROM part WHERE p_size <= 25) FROM (SELECT unnest(string_split(p_type, ' ')) AS t FROM part WHERE p_size <= 25) GROUP BY 1) GROUP BY 1")
def query_feedback(spark, d):
    docs = load(spark, d, "part").select(F.col("p_partkey").alias("doc_id"), (F.col("p_size") > 25).alias("relevant"), F.explode(F.split(F.lower("p_type"), " ")).alias("term")).withColumn("w", F.lit(1.0))
    return search.rocchio(spark.createDataFrame([("steel", 1.0)], "term string, w double"), docs).select("term", r4(F.col("w"), "w"))


@register("SELECT doc_id, CAST(rank AS INTEGER) AS place FROM (SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS rank FROM documents) WHERE rank <= 5")
def diverse_ranking(spark, d):
    """With a weight of 1 on relevance the order is that of the scores."""
    c = load(spark, d, "documents").select("doc_id", F.col("n_chars").cast("double").alias("score")).orderBy(F.desc("score"), "doc_id").limit(20)
    return search.mmr(c, spark.createDataFrame([], "a long, b long, sim double"), 5, 1.0)


@register("SELECT 1::BIGINT AS shuffles, true AS pushed, true AS narrow")
def plan_text(spark, d):
    df = load(spark, d, "orders").where("o_totalprice > 1000").groupBy("o_custkey").agg(F.count("*").alias("n"))
    return spark.createDataFrame([(explain.exchanges(df), any("o_totalprice" in f for f in explain.pushed_filters(df)), "o_orderdate" not in " ".join(explain.read_columns(df)))], "shuffles long, pushed boolean, narrow boolean")


@register("SELECT round(avg(epoch(ts) - epoch(lag)), 3) AS skew_s FROM (SELECT ts, lag(ts) OVER (ORDER BY ts, event_id) AS lag FROM events) WHERE lag IS NOT NULL")
def time_skew(spark, d):
    from quillspark.streaming import windows

    w = Window.orderBy("ts", "event_id")
    e = load(spark, d, "events").select("ts", F.lag("ts").over(w).alias("before")).where("before is not null")
    return windows.event_time_skew(e, "before", "ts").select(F.round("skew_s", 3).alias("skew_s"))


@register("SELECT count(*) AS open_windows FROM (SELECT DISTINCT time_bucket(INTERVAL 1 DAY, ts) AS s FROM events) WHERE s + INTERVAL 1 DAY > (SELECT max(ts) - INTERVAL 2 DAY FROM events)")
def open_windows(spark, d):
    from quillspark.streaming import windows

    e = load(spark, d, "events")
    mark = e.agg(F.expr("max(ts) - interval 2 days")).first()[0]
    return windows.open_windows(e, "ts", "1 day", mark)

