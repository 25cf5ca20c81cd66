"""Ontology graph tables from the term rows: nodes, typed edges, triples and labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.operators.hierarchy import curie


def _matches(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/ontology_match.parquet").withColumn("id", curie(F.col("ontology_id")))


def nodes(spark: SparkSession, sf: str) -> DataFrame:
    """One row per term: ``id, name, ontology, definition, synonyms, biolink_type``; attributes of the latest row that has them."""
    m = _matches(spark, sf).where("id is not null")
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("match_id"))).alias
    base = m.groupBy("id").agg(last("canonical_name")("name"), last("definition")("definition"), last("biolink_type")("biolink_type"),
                               F.sort_array(F.array_distinct(F.flatten(F.collect_set(F.coalesce("synonyms", F.array().cast("array<string>")))))).alias("synonyms"))
    named = edges(spark, sf).select(F.col("src").alias("id")).union(edges(spark, sf).select("dst")).distinct()
    return named.join(base, "id", "full").select(
        "id", "name", F.lower(F.split_part("id", F.lit(":"), F.lit(1))).alias("ontology"), "definition",
        F.coalesce("synonyms", F.array().cast("array<string>")).alias("synonyms"), "biolink_type")


def edges(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct links parent to child: ``src, dst, relation``; self-links are left out."""
    m = _matches(spark, sf).where("id is not null")
    up = m.select(F.explode(F.transform("parents", curie)).alias("src"), F.col("id").alias("dst"))
    down = m.select(F.col("id").alias("src"), F.explode(F.transform("children", curie)).alias("dst"))
    return up.union(down).where("src is not null and dst is not null and src <> dst").distinct().withColumn("relation", F.lit("is_a"))


def literature(spark: SparkSession, sf: str) -> DataFrame:
    """Literature graph: distinct normalised ``src, dst, relation`` of the extracted relations, with their publication count."""
    r = spark.read.parquet(f"{sf}/relations.parquet").where("not coalesce(negation, false)")
    norm = lambda c: F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " "))
    return r.select(norm("subject").alias("src"), norm("object").alias("dst"), norm("action").alias("relation"), "pmid").where(
        "src <> '' and dst <> '' and relation <> '' and src <> dst").groupBy("src", "dst", "relation").agg(F.count_distinct("pmid").alias("n_docs"))


def triples(spark: SparkSession, sf: str) -> DataFrame:
    """``s, p, o, o_kind``: links as iris, names and synonyms as literals."""
    n = nodes(spark, sf)
    e = edges(spark, sf).select(F.col("dst").alias("s"), F.lit("rdfs:subClassOf").alias("p"), F.col("src").alias("o"), F.lit("iri").alias("o_kind"))
    labels = n.where("name is not null").select(F.col("id").alias("s"), F.lit("rdfs:label").alias("p"), F.col("name").alias("o"), F.lit("literal").alias("o_kind"))
    syn = n.select(F.col("id").alias("s"), F.lit("oboInOwl:hasExactSynonym").alias("p"), F.explode("synonyms").alias("o"), F.lit("literal").alias("o_kind"))
    return e.union(labels).union(syn)
