"""Document directories ``<pmid>/{relations.csv, entities.txt, authors.txt, doc.txt}``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _pmid():
    return F.regexp_extract(F.col("_metadata.file_path"), r"/([^/]+)/[^/]+$", 1).alias("pmid")


def read_relations(spark: SparkSession, root: str, known: DataFrame | None = None) -> DataFrame:
    """``pmid, idx, subject, action, object, negation`` of all directories but those of ``known`` documents."""
    df = spark.read.option("header", True).option("escape", '"').schema("idx int, Subject string, Action string, Object string, Negation boolean").option(
        "enforceSchema", True).csv(f"{root}/*/relations.csv")
    out = df.select(_pmid(), "idx", F.col("Subject").alias("subject"), F.col("Action").alias("action"), F.col("Object").alias("object"), F.col("Negation").alias("negation")).where("idx is not null")
    return out if known is None else out.join(known.select("pmid").distinct(), "pmid", "left_anti")


def read_lines(spark: SparkSession, root: str, name: str) -> DataFrame:
    """``pmid, line`` of a text file of every directory (entities.txt, authors.txt); blank lines are skipped."""
    return spark.read.text(f"{root}/*/{name}").select(_pmid(), F.trim("value").alias("line")).where("line <> ''")


def read_documents(spark: SparkSession, root: str) -> DataFrame:
    """``pmid, text`` of every doc.txt."""
    return spark.read.text(f"{root}/*/doc.txt", wholetext=True).select(_pmid(), F.col("value").alias("text"))


def authors(lines: DataFrame) -> DataFrame:
    """``pmid, last_name, fore_name`` of lines "Last, Fore"."""
    return lines.select("pmid", F.trim(F.split_part("line", F.lit(","), F.lit(1))).alias("last_name"), F.nullif(F.trim(F.split_part("line", F.lit(","), F.lit(2))), F.lit("")).alias("fore_name"))
