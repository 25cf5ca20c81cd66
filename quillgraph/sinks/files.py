"""File outputs: graphs, metrics with summary rows, per-document folders, appended tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Nodes and edges as two Parquet tables."""
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").parquet(f"{path}/edges")


def read_graph(spark, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")


def append_csv(df: DataFrame, path: str) -> None:
    """Append rows as CSV files with a header each."""
    df.write.mode("append").option("header", True).csv(path)


def write_per_document(df: DataFrame, key: str, path: str) -> None:
    """One folder per document (``key=value``); rows of a document are brought together first, so each folder gets few files."""
    df.repartition(F.col(key)).write.mode("overwrite").partitionBy(key).option("header", True).csv(path)


def write_metrics(report: DataFrame, path: str) -> None:
    """A classification report as CSV, classes first, then the summary rows."""
    order = F.when(F.col("label").isin("MICRO", "MACRO", "WEIGHTED"), 1).otherwise(0)
    report.orderBy(order, "label").coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_lines(df: DataFrame, text_col: str, path: str) -> None:
    df.select(F.col(text_col).cast("string").alias("value")).write.mode("overwrite").text(path)
