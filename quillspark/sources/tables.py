"""Tables on disk: plain reads and writes, sorted runs with bloom filters, graphs and vector collections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, path: str, form: str = "parquet", schema: str | None = None, **options: str) -> DataFrame:
    """parquet, orc, json, csv or text; give csv and json a schema, so that nothing is read twice to guess it."""
    r = spark.read.format(form).options(**options)
    return (r.schema(schema) if schema else r).load(path)


def write(df: DataFrame, path: str, form: str = "parquet", mode: str = "errorifexists", partition_by: list[str] | None = None, **options: str) -> None:
    w = df.write.format(form).mode(mode).options(**options)
    (w.partitionBy(*partition_by) if partition_by else w).save(path)


def write_sorted(df: DataFrame, path: str, key: str, partitions: int | None = None) -> None:
    """A sorted run: ranges of keys by file, sorted inside, so that min/max statistics and bloom filters prune look-ups."""
    ranged = df.repartitionByRange(partitions, key) if partitions else df.repartitionByRange(key)
    ranged.sortWithinPartitions(key).write.option(f"parquet.bloom.filter.enabled#{key}", "true").parquet(path)


def write_bucketed(df: DataFrame, name: str, key: str, buckets: int) -> None:
    """A catalog table whose joins and groupings on key need no shuffle."""
    df.write.bucketBy(buckets, key).sortBy(key).mode("overwrite").saveAsTable(name)


def save_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    nodes.write.parquet(f"{path}/nodes")
    edges.write.partitionBy("type").parquet(f"{path}/edges")


def load_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")


def save_collection(vectors: DataFrame, index: DataFrame | None, path: str) -> None:
    """Vectors, and an index table partitioned by list, so that a search reads its probes only."""
    vectors.write.parquet(f"{path}/vectors")
    if index is not None:
        index.write.partitionBy("list").parquet(f"{path}/index")


def load_collection(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame | None]:
    from pyspark.errors import AnalysisException

    try:
        index = spark.read.parquet(f"{path}/index")
    except AnalysisException:  # a collection may have no index
        index = None
    return spark.read.parquet(f"{path}/vectors"), index


def page_links(pages: DataFrame) -> DataFrame:
    """(page_id, target) of every ``<a href="...">``."""
    return pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit(r'<a\s+href="([^"]*)"'), 1)).alias("target"))
