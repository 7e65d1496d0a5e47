"""What the optimizer plans: cost and text of a plan, statistics for it, and a few checks on plans."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession


def text(df: DataFrame, mode: str = "formatted") -> str:
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), mode)


def analyze(spark: SparkSession, table: str) -> None:
    """Row and column statistics for the cost-based optimizer."""
    spark.sql(f"ANALYZE TABLE {table} COMPUTE STATISTICS FOR ALL COLUMNS")


def exchanges(df: DataFrame) -> int:
    """Shuffles in the planned query."""
    return len(re.findall(r"^\(\d+\) Exchange", text(df), re.M))


def pushed_filters(df: DataFrame) -> list[str]:
    return re.findall(r"PushedFilters: \[([^\]]+)\]", text(df))


def read_columns(df: DataFrame) -> list[str]:
    return re.findall(r"ReadSchema: (struct<[^\n]*)", text(df))


def join_reorder(spark: SparkSession, on: bool = True) -> None:
    """Lets the optimizer enumerate join orders by cost."""
    spark.conf.set("spark.sql.cbo.enabled", str(on).lower())
    spark.conf.set("spark.sql.cbo.joinReorder.enabled", str(on).lower())
