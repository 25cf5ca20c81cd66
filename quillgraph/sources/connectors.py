"""Sources behind a pluggable reader: web pages, PDF files, literature services, lists and schemas."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, LongType, MapType, StringType, StructField, StructType


def fetch_pages(urls: DataFrame, url_col: str, fetch: Callable[[str], str | None]) -> DataFrame:
    """``url, html``: pages by a pluggable reader in the executors; a reader that raises or finds nothing gives null."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            pages = []
            for u in b["url"]:
                try:
                    pages.append(fetch(u))
                except Exception:
                    pages.append(None)
            yield pd.DataFrame({"url": b["url"], "html": pd.Series(pages, dtype=object)})

    return urls.select(F.col(url_col).alias("url")).where("url is not null").distinct().mapInPandas(run, "url string, html string")


def read_binary_texts(spark: SparkSession, path: str, extract: Callable[[bytes], list[str]]) -> DataFrame:
    """``path, page_no, text``: pages of binary files (PDF, scans) by a pluggable extractor; an unreadable file gives no page."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for p, c in zip(b["path"], b["content"], strict=True):
                try:
                    rows += [(p, k, t) for k, t in enumerate(extract(bytes(c)))]
                except Exception:
                    continue
            yield pd.DataFrame(rows, columns=["path", "page_no", "text"])

    return files.mapInPandas(run, "path string, page_no int, text string")


def search_literature(spark: SparkSession, queries: list[str], search: Callable[[str, int], list[dict]], most: int = 100) -> DataFrame:
    """``query, pmid, title, abstract`` of a literature service behind a callable, one query per task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(q, str(d.get("pmid")), d.get("title"), d.get("abstract")) for q in b["query"] for d in search(q, most)]
            yield pd.DataFrame(rows, columns=["query", "pmid", "title", "abstract"])

    q = spark.createDataFrame([(x,) for x in queries], "query string").repartition(max(1, len(queries)))
    return q.mapInPandas(run, "query string, pmid string, title string, abstract string")


def read_word_list(spark: SparkSession, path: str) -> DataFrame:
    """``word``: distinct lower-case lines of a list file; blank lines and lines that start with # are skipped."""
    w = spark.read.text(path).select(F.lower(F.trim("value")).alias("word"))
    return w.where("word <> '' and not startswith(word, '#')").distinct()


def struct_of(schema: dict) -> StructType:
    """Spark type of an object in JSON schema: properties by name, unknown types as text."""
    simple = {"string": StringType(), "integer": LongType(), "number": DoubleType(), "boolean": BooleanType()}

    def one(s: dict):
        kind = s.get("type")
        if kind == "object":
            return struct_of(s) if s.get("properties") else MapType(StringType(), StringType())
        if kind == "array":
            return ArrayType(one(s.get("items", {})))
        return simple.get(kind, StringType())

    required = set(schema.get("required", ()))
    return StructType([StructField(k, one(v), k not in required) for k, v in schema.get("properties", {}).items()])


def read_json_schema(spark: SparkSession, path: str) -> StructType:
    """Type of a JSON schema file."""
    return struct_of(json.loads(spark.read.text(path, wholetext=True).first()[0]))
