"""Ontology files: OBO stanzas and OWL classes to nodes and edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.functions.text import iri_to_curie

_OWL = ("`_rdf:about` string, `rdfs:label` array<struct<_VALUE:string>>, `oboInOwl:hasExactSynonym` array<struct<_VALUE:string>>, `oboInOwl:hasRelatedSynonym` array<struct<_VALUE:string>>, "
        "`obo:IAO_0000115` struct<_VALUE:string>, `rdfs:subClassOf` array<struct<`_rdf:resource`:string, `owl:Restriction`:struct<"
        "`owl:onProperty`:struct<`_rdf:resource`:string>, `owl:someValuesFrom`:struct<`_rdf:resource`:string>, `owl:allValuesFrom`:struct<`_rdf:resource`:string>>>>")


def read_stanzas(spark: SparkSession, path: str) -> DataFrame:
    """One row per stanza of an OBO file: ``stanza``."""
    return spark.read.option("lineSep", "\n\n").text(path).select(F.trim("value").alias("stanza"))


def _tags(c: Column, tag: str, pattern: str) -> Column:
    return F.regexp_extract_all(c, F.lit(rf"(?m)^{tag}: {pattern}"), F.lit(1))


def parse_terms(stanzas: DataFrame, ontology: str | Column) -> DataFrame:
    """``id, name, ontology, definition, synonyms, is_a, relationships`` of the term stanzas that are not obsolete.

    ``relationships`` is an array of (relation, target).  Missing tags give null or an empty array.
    """
    c = F.col("stanza")
    one = lambda tag, p: F.nullif(F.regexp_extract(c, rf"(?m)^{tag}: {p}", 1), F.lit(""))
    rel = F.transform(_tags(c, "relationship", r"(\S+ \S+)"), lambda r: F.struct(F.split_part(r, F.lit(" "), F.lit(1)).alias("relation"), F.split_part(r, F.lit(" "), F.lit(2)).alias("target")))
    return stanzas.where(F.startswith(c, F.lit("[Term]")) & ~c.rlike(r"(?m)^is_obsolete: true")).select(
        one("id", r"(\S+)").alias("id"), one("name", "(.+)").alias("name"), (F.lit(ontology) if isinstance(ontology, str) else ontology).alias("ontology"),
        one("def", r'"((?:[^"\\]|\\.)*)"').alias("definition"), _tags(c, "synonym", r'"((?:[^"\\]|\\.)*)"').alias("synonyms"),
        _tags(c, "is_a", r"(\S+)").alias("is_a"), rel.alias("relationships"))


def term_edges(terms: DataFrame) -> DataFrame:
    """``src, dst, relation``: is_a links parent to child, other relations subject to object."""
    up = terms.select(F.explode("is_a").alias("src"), F.col("id").alias("dst"), F.lit("is_a").alias("relation"))
    other = terms.select(F.col("id").alias("src"), F.explode("relationships").alias("r")).select("src", F.col("r.target").alias("dst"), "r.relation")
    return up.union(other)


def read_owl(spark: SparkSession, path: str, ontology: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of the classes of an RDF/XML file; restrictions become edges class to filler named by the property."""
    raw = spark.read.schema(_OWL).option("rowTag", "owl:Class").xml(path)
    text = lambda c: F.coalesce(F.transform(c, lambda x: x["_VALUE"]), F.array().cast("array<string>"))
    cls = raw.select(iri_to_curie(F.col("`_rdf:about`")).alias("id"), F.col("`_rdf:about`").alias("iri"), F.try_element_at(text(F.col("`rdfs:label`")), F.lit(1)).alias("name"),
                     F.concat(text(F.col("`oboInOwl:hasExactSynonym`")), text(F.col("`oboInOwl:hasRelatedSynonym`"))).alias("synonyms"),
                     F.col("`obo:IAO_0000115`._VALUE").alias("definition"), F.col("`rdfs:subClassOf`").alias("up")).where("id is not null")
    nodes = cls.select("id", "name", F.lit(ontology).alias("ontology"), "definition", "synonyms", "iri")
    sup = cls.select("id", F.explode("up").alias("u"))
    isa = sup.where(F.col("u.`_rdf:resource`").isNotNull()).select(iri_to_curie(F.col("u.`_rdf:resource`")).alias("src"), F.col("id").alias("dst"), F.lit("is_a").alias("relation"))
    r = F.col("u.`owl:Restriction`")
    filler = F.coalesce(r["owl:someValuesFrom"]["_rdf:resource"], r["owl:allValuesFrom"]["_rdf:resource"])
    prop = F.coalesce(F.element_at(F.split(r["owl:onProperty"]["_rdf:resource"], "[/#]"), -1), F.lit("owl_restriction"))
    other = sup.where(r.isNotNull()).select(F.col("id").alias("src"), iri_to_curie(filler).alias("dst"), prop.alias("relation")).where("dst is not null")
    return nodes, isa.union(other)
