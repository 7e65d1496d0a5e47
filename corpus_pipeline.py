"""From raw documents to packed training sequences, in five stages.

Each stage is a function of (spark, docs, sf_dir) and works on everything its predecessor kept.  Rows without a
doc_id are kept by all filters.  Rows that share a doc_id are one document to stages that compare documents; deduplication
leaves one of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.llm import neardup, packing, passages, positional, quality
from quillspark.llm.queries import tokenizer_path
from quillspark.session import load, ready, slim, written


def _fresh(docs: DataFrame, name: str) -> str:
    """A column name that docs does not have."""
    while name in docs.columns:
        name += "_"
    return name


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs but for those with a doc_id in gone (doc_id)."""
    name = _fresh(docs, "gone")
    ids = gone.where("doc_id is not null").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(ids, docs.doc_id == F.col(name), "left_anti")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the counts or the perplexity band reject go."""
    slim(spark)
    return quality.passing(docs, unit="word")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, similarity 0.8) the document with the smallest id stays."""
    slim(spark)
    found = neardup.near_duplicates(docs, width=5, percent=80)
    left = _without(docs, found.where("not kept"))
    if docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").take(1):
        # of rows with one id the one whose text has been compared stays
        place = _fresh(docs, "place")
        order = Window.partitionBy("doc_id").orderBy(F.col("text").asc_nulls_last(), F.xxhash64(*docs.columns))
        left = left.withColumn(place, F.row_number().over(order)).where((F.col(place) == 1) | F.col("doc_id").isNull()).drop(place)
    return left


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A passage of 50 words or more that nearly repeats stays in its smallest document only."""
    slim(spark)
    out = passages.without_repeats(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a ten-word window of a benchmark item go."""
    slim(spark)
    found = positional.contamination(docs, load(spark, sf_dir, "benchmark"), window=10)
    return _without(docs, found.where("contaminated").select("doc_id"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 4096 tokens in sequences of 4096."""
    slim(spark)
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"), capacity=4096, end_id=1)


STAGES = [
    ("quality rules", quality_rules),
    ("near dedup", near_dedup),
    ("substring dedup", substring_dedup),
    ("decontamination", decontamination),
    ("packing", best_fit_packing),
]

#: SQL cannot express the stages on perplexity, passages and tokens; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written before the next."""
    docs = load(ready(spark), sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, "stage")
    return docs
