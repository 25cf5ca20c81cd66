"""Annotated documents in BioC XML: passages, annotations, relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_INFON = "infon:array<struct<_key:string, _VALUE:string>>"
SCHEMA = ("id string, passage array<struct<offset:long, text:string, annotation:array<struct<_id:string, " + _INFON + ", location:array<struct<_offset:long, _length:long>>, text:string>>>>, "
          "relation array<struct<_id:string, " + _INFON + ">>")


def read_bioc(spark: SparkSession, path: str) -> DataFrame:
    """One row per document of BioC XML files: ``id, passage, relation``."""
    return spark.read.schema(SCHEMA).option("rowTag", "document").xml(path)


def parse_bioc(col: Column) -> Column:
    """The same structure from a text column that holds one ``<document>`` element."""
    return F.from_xml(col, SCHEMA)


def _infons(c: Column) -> Column:
    return F.map_from_entries(F.transform(c, lambda x: F.struct(x["_key"], x["_VALUE"])))


def annotations(docs: DataFrame) -> DataFrame:
    """``doc_id, identifier, type, text, start, stop``: every location, offsets counted over the passages joined by one character each."""
    p = docs.select(F.col("id").alias("doc_id"), F.posexplode("passage").alias("k", "p"))
    before = F.aggregate(F.slice(F.col("passage"), F.lit(1), F.col("k")), F.lit(0).cast("long"), lambda acc, x: acc + F.length(F.coalesce(x["text"], F.lit(""))) + 1)
    p = docs.select(F.col("id").alias("doc_id"), "passage", F.posexplode("passage").alias("k", "p")).select("doc_id", before.alias("base"), "p")
    a = p.select("doc_id", "base", F.col("p.offset").alias("po"), F.explode("p.annotation").alias("a")).select(
        "doc_id", "base", "po", _infons(F.col("a.infon")).alias("i"), F.col("a.text").alias("text"), F.explode("a.location").alias("l"))
    start = F.col("l._offset") - F.coalesce("po", F.lit(0)) + F.col("base")
    return a.select("doc_id", F.try_element_at("i", F.lit("identifier")).alias("identifier"), F.coalesce(F.try_element_at("i", F.lit("type")), F.lit("ENTITY")).alias("type"), "text",
                    start.alias("start"), (start + F.col("l._length")).alias("stop"))


def relations(docs: DataFrame) -> DataFrame:
    """``doc_id, entity1, entity2, type, novel`` of the stated relations."""
    r = docs.select(F.col("id").alias("doc_id"), F.explode("relation").alias("r")).select("doc_id", _infons(F.col("r.infon")).alias("i"))
    get = lambda k: F.try_element_at("i", F.lit(k))
    return r.select("doc_id", get("entity1").alias("entity1"), get("entity2").alias("entity2"), get("type").alias("type"), (F.lower(get("novel")) == "novel").alias("novel"))


def document_text(docs: DataFrame) -> DataFrame:
    """``doc_id, text``: passages joined by line breaks."""
    return docs.select(F.col("id").alias("doc_id"), F.array_join(F.transform("passage", lambda p: F.coalesce(p["text"], F.lit(""))), "\n").alias("text"))


def gold_relations(docs: DataFrame) -> DataFrame:
    """Relations with the texts of both entities, of the first annotation with each id; a relation with an unknown end is dropped."""
    first = annotations(docs).where("identifier is not null").groupBy("doc_id", "identifier").agg(F.min_by("text", "start").alias("text"), F.min_by("type", "start").alias("kind"))
    side = lambda n: first.select("doc_id", F.col("identifier").alias(f"entity{n}"), F.col("text").alias(f"text{n}"), F.col("kind").alias(f"kind{n}"))
    return relations(docs).join(side(1), ["doc_id", "entity1"]).join(side(2), ["doc_id", "entity2"]).select("doc_id", "text1", "text2", "type", "novel", "kind1", "kind2")


def statistics(docs: DataFrame) -> DataFrame:
    """``measure, key, n``: documents, relations, entities, and relations and entities by type."""
    r, a = relations(docs), annotations(docs)
    one = lambda d, m: d.agg(F.count("*").alias("n")).select(F.lit(m).alias("measure"), F.lit("").alias("key"), "n")
    by = lambda d, m: d.groupBy(F.coalesce("type", F.lit("none")).alias("key")).agg(F.count("*").alias("n")).select(F.lit(m).alias("measure"), "key", "n")
    return one(docs, "documents").union(one(r, "relations")).union(one(a, "entities")).union(by(r, "relation_type")).union(by(a, "entity_type"))


def mesh_pairs(docs: DataFrame) -> DataFrame:
    """``pmid, chemical, disease``: gold pairs from MESH infons, several ids of one annotation split at bars."""
    p = docs.select(F.col("id").alias("pmid"), F.explode("passage").alias("p")).select("pmid", F.explode("p.annotation").alias("a")).select(
        "pmid", _infons(F.col("a.infon")).alias("i"), F.col("a.text").alias("text"))
    names = p.select("pmid", F.explode(F.split(F.try_element_at("i", F.lit("MESH")), r"\|")).alias("mesh"), "text").groupBy("pmid", "mesh").agg(F.min("text").alias("text"))
    r = docs.select(F.col("id").alias("pmid"), F.explode("relation").alias("r")).select("pmid", _infons(F.col("r.infon")).alias("i")).select(
        "pmid", F.try_element_at("i", F.lit("Chemical")).alias("c"), F.try_element_at("i", F.lit("Disease")).alias("d"))
    return r.join(names.select("pmid", F.col("mesh").alias("c"), F.col("text").alias("chemical")), ["pmid", "c"]).join(
        names.select("pmid", F.col("mesh").alias("d"), F.col("text").alias("disease")), ["pmid", "d"]).select("pmid", "chemical", "disease")
