"""The thin queries over the operators of this subpackage, and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillspark.llm import chat, licenses, neardup, packing, passages, positional, quality, transducer, urls, wavelet
from quillspark.session import load, ready


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_wavelet_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wavelet.token_files(load(ready(spark), sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transducer.token_counts(load(ready(spark), sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), limit=2048)


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(load(ready(spark), sf_dir, "documents"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = positional.contamination(load(ready(spark), sf_dir, "documents"), load(spark, sf_dir, "benchmark"), window=10)
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


#: The rules of the query's contract.
URL_RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(load(ready(spark), sf_dir, "pages"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(load(ready(spark), sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), capacity=4096, end_id=1)


def op7_chat_prefix_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(ready(spark), sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "\\### Assistant: </turn> ok"
    own = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat.read_conversations(chat.prefix_trees(rows.unionByName(own)))


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(load(ready(spark), sf_dir, "documents"), width=2, percent=80)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.quality(load(ready(spark), sf_dir, "documents"), unit="word")
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated_passages(load(ready(spark), sf_dir, "documents"), width=5, min_words=50, percent=80)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_wavelet_tokens": op1_wavelet_tokens,
    "op2_token_counts": op2_token_counts,
    "op3_license_scan": op3_license_scan,
    "op4_decontamination": op4_decontamination,
    "op5_url_filter": op5_url_filter,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_chat_prefix_trees": op7_chat_prefix_trees,
    "op8_minhash_near_dedup": op8_minhash_near_dedup,
    "op9_quality_rules": op9_quality_rules,
    "op10_repeated_passages": op10_repeated_passages,
}

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWERED = f"translate(text, '{UPPER}', '{UPPER.lower()}')"

def _op3_sql() -> str:
    word = "'[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'"
    bigrams = "list_distinct(list_transform(range(1, len(ws)), lambda k: ws[k] || ' ' || ws[k + 1]))"
    rows = ", ".join("('{}', '{}')".format(n, t.replace("'", "''")) for n, t in licenses.TEMPLATES)
    return f"""
WITH t AS (
  SELECT name, {bigrams} AS g FROM (SELECT name, regexp_extract_all({LOWERED}, {word}) AS ws FROM (VALUES {rows}) AS v(name, text))
), u AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS text FROM documents
  UNION ALL SELECT doc_id, unnest(string_split(text, chr(10) || chr(10))) FROM documents
  UNION ALL SELECT doc_id, text FROM documents
), g AS (
  SELECT doc_id, {bigrams} AS g FROM (SELECT doc_id, regexp_extract_all({LOWERED}, {word}) AS ws FROM u WHERE text IS NOT NULL) WHERE len(ws) > 1
), m AS (
  SELECT doc_id, name, len(list_intersect(g.g, t.g)) AS shared, len(g.g) + len(t.g) AS sizes
  FROM g JOIN t ON 115 * least(len(g.g), len(t.g)) >= 85 * greatest(len(g.g), len(t.g))
  WHERE 200 * len(list_intersect(g.g, t.g)) >= 85 * (len(g.g) + len(t.g))
), b AS (
  SELECT doc_id, name, max(2.0 * shared / sizes) AS dice FROM m GROUP BY doc_id, name
), f AS (
  SELECT doc_id, string_agg(name, ',' ORDER BY name) AS licenses, first(name ORDER BY dice DESC, name) AS best_license, max(dice) AS best_dice FROM b GROUP BY doc_id
)
SELECT doc_id, coalesce(licenses, '') AS licenses, best_license, CAST(best_dice AS DOUBLE) AS best_dice FROM documents LEFT JOIN f USING (doc_id)
"""


OP4_SQL = f"""
WITH d AS (
  SELECT doc_id, coalesce(regexp_extract_all({LOWERED}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), []) AS ws FROM documents
), i AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({LOWERED}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM benchmark WHERE text IS NOT NULL
), iw AS (
  SELECT DISTINCT item, n, array_to_string(ws[s:s + n - 1], ' ') AS win
  FROM (SELECT item, ws, least(10, len(ws)) AS n, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS s FROM i WHERE len(ws) > 0)
), dw AS (
  SELECT doc_id, s, n, array_to_string(ws[s:s + n - 1], ' ') AS win
  FROM (SELECT doc_id, ws, n, unnest(range(1, greatest(len(ws) - n + 2, 1))) AS s FROM d, (SELECT DISTINCT n FROM iw))
), m AS (
  SELECT doc_id, s, n, item FROM dw JOIN iw USING (n, win)
), h AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM m) GROUP BY doc_id
), t AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item FROM m) GROUP BY doc_id
)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""

OP7_SQL = """
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL
  SELECT -7, t, r, '\\### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) AS v(t, r)
), t AS (
  SELECT *, CASE WHEN role = 'assistant' THEN text ELSE '' END AS loss,
         length('### ') + length(role) + length(': ') + length(text) + length('</turn>') + 1
         + length(text) - length(replace(text, chr(92), ''))
         + (length(text) - length(replace(text, '</turn>', ''))) // 7
         + coalesce(list_sum(list_transform(regexp_extract_all(text, '#{3,}'), lambda x: length(x) - 2)), 0) AS size
  FROM c
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(sum(length(loss)) AS BIGINT) AS loss_chars, sha256(string_agg(loss, '' ORDER BY turn, role, text)) AS loss_sha256, CAST(sum(size) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""

OP8_SQL = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, coalesce(regexp_extract_all({LOWERED}, '[^\\x20\\x09-\\x0D]+'), []) AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(ws) < 2 THEN array_to_string(ws, ' ') ELSE ws[k] || ' ' || ws[k + 1] END AS g
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws), 2))) AS k FROM w WHERE len(ws) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
), l AS (
  SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * shared >= 80 * (a.n + b.n - shared)
), e AS (
  SELECT x, y FROM l UNION ALL SELECT y, x FROM l
), r AS (
  SELECT doc_id AS v, doc_id AS c FROM documents
  UNION
  SELECT e.y, r.c FROM r JOIN e ON e.x = r.v
), m AS (
  SELECT v AS doc_id, min(c) AS component_id FROM r GROUP BY v
)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept
FROM documents LEFT JOIN n USING (doc_id) JOIN m USING (doc_id)
"""

ORACLE_SQL: dict[str, str] = {
    "op3_license_scan": _op3_sql(),
    "op4_decontamination": OP4_SQL,
    "op7_chat_prefix_trees": OP7_SQL,
    "op8_minhash_near_dedup": OP8_SQL,
}
