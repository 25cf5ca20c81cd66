"""Look-ups on a stored graph, grouping of predictions, sampling protocols and pluggable models."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions import constants as K
from quillgraph.operators.contains import top_per_key
from quillgraph.operators.graph import closure


class Embedder(Protocol):
    """Texts to vectors of one length."""

    def __call__(self, texts: list[str]) -> np.ndarray: ...


class RelationExtractor(Protocol):
    """Text to (subject, predicate, object, confidence) rows."""

    def __call__(self, text: str) -> list[tuple[str, str, str, float]]: ...


def direct_neighbours(triples: DataFrame, limit: int = K.LIMIT_NEIGHBOURS, relation: str | None = None) -> DataFrame:
    """``node, neighbour, rank``: neighbours in either direction over links between iris, at most ``limit`` per node; with ``relation`` only links whose predicate contains it."""
    t = triples.where("o_kind = 'iri' and p <> 'rdf:type'")
    if relation:
        t = t.where(F.contains(F.lower("p"), F.lit(relation.lower())))
    both = t.select(F.col("s").alias("node"), F.col("o").alias("neighbour")).union(t.select("o", "s")).where("node <> neighbour").distinct()
    return top_per_key(both, ["node"], [F.col("neighbour")], limit)


def entity_details(triples: DataFrame, limit: int = K.LIMIT_DETAILS) -> DataFrame:
    """``entity, label, synonyms, parents``: a label is required, all else optional; at most ``limit`` synonyms, smallest label."""
    label = triples.where("p = 'rdfs:label'").groupBy(F.col("s").alias("entity")).agg(F.min("o").alias("label"))
    few = top_per_key(triples.where("p = 'oboInOwl:hasExactSynonym'").select("s", "o").distinct(), ["s"], [F.col("o")], limit)
    syn = few.groupBy(F.col("s").alias("entity")).agg(F.sort_array(F.collect_list("o")).alias("synonyms"))
    up = triples.where("p = 'rdfs:subClassOf'").groupBy(F.col("s").alias("entity")).agg(F.sort_array(F.collect_set("o")).alias("parents"))
    return label.join(syn, "entity", "left").join(up, "entity", "left")


def domain_range(triples: DataFrame) -> DataFrame:
    """``property, domain, range``: smallest stated domain and range of every property, null where none is stated."""
    one = lambda p, name: triples.where(F.col("p") == p).groupBy(F.col("s").alias("property")).agg(F.min("o").alias(name))
    return one("rdfs:domain", "domain").join(one("rdfs:range", "range"), "property", "full")


def restriction_scan(triples: DataFrame, limit: int = 5000) -> DataFrame:
    """``cls, prop, filler, kind``: restrictions reached from classes through blank nodes, at most ``limit`` in a fixed order."""
    sub = triples.where("p = 'rdfs:subClassOf' and o_kind = 'bnode'").select(F.col("s").alias("cls"), F.col("o").alias("b"))
    prop = triples.where("p = 'owl:onProperty'").select(F.col("s").alias("b"), F.col("o").alias("prop"))
    fill = triples.where("p in ('owl:someValuesFrom', 'owl:allValuesFrom')").select(F.col("s").alias("b"), F.col("o").alias("filler"), F.col("p").alias("kind"))
    return sub.join(prop, "b").join(fill, "b").select("cls", "prop", "filler", "kind").distinct().orderBy("cls", "prop", "filler", "kind").limit(limit)


def schema_closure(triples: DataFrame) -> DataFrame:
    """``sub, sup``: reflexive and transitive closure of subClassOf, equivalent classes standing for each other."""
    eq = triples.where("p = 'owl:equivalentClass'").select(F.col("s").alias("src"), F.col("o").alias("dst"))
    up = triples.where("p = 'rdfs:subClassOf' and o_kind = 'iri'").select(F.col("s").alias("src"), F.col("o").alias("dst"))
    links = up.union(eq).union(eq.select("dst", "src")).distinct()
    own = links.select(F.col("src").alias("x")).union(links.select("dst")).distinct().select(F.col("x").alias("sub"), F.col("x").alias("sup"))
    return closure(links).select(F.col("start").alias("sub"), F.col("node").alias("sup")).union(own)


def query_relationships(store: DataFrame, subject: str | None = None, predicate: str | None = None, obj: str | None = None, min_confidence: float = 0.0, limit: int = 100) -> DataFrame:
    """Stored relations that fit the given parts and confidence, the surest first, at most ``limit``."""
    df = store.where(F.col("confidence") >= min_confidence)
    for name, value in (("subject", subject), ("predicate", predicate), ("object", obj)):
        if value is not None:
            df = df.where(F.lower(name) == value.lower())
    return df.orderBy(F.desc("confidence"), "subject", "predicate", "object").limit(limit)


def group_predictions(rows: DataFrame) -> DataFrame:
    """``document_id, entities, n_relations, abstract``: per document its distinct entities, number of distinct predicted relations and smallest abstract."""
    ents = rows.select("document_id", F.explode(F.array("entity1", "entity2")).alias("e")).where("e is not null").groupBy("document_id").agg(F.sort_array(F.collect_set("e")).alias("entities"))
    rel = rows.groupBy("document_id").agg(F.count_distinct(F.struct("entity1", "predicted_relation", "entity2")).alias("n_relations"), F.min("abstract").alias("abstract"))
    return rel.join(ents, "document_id", "left")


def mentions_of(mentions: DataFrame, known: DataFrame, column: str = "mention") -> DataFrame:
    """Mentions that are in a table of known names (genes, say), whatever the case."""
    k = known.select(F.lower(F.trim("name")).alias("_qg_k")).distinct()
    return mentions.join(k, F.lower(F.trim(column)) == F.col("_qg_k"), "left_semi")


def bootstrap_documents(docs: DataFrame, rounds: int, size: int, key: str = "pmid") -> DataFrame:
    """``round, pmid, draw``: ``size`` documents drawn with replacement per round, repeatable: draw j takes the document at a hashed position of the key order."""
    ids = docs.select(key).distinct()
    n = ids.count()
    spark = docs.sparkSession
    draws = spark.range(rounds * size).select((F.col("id") / size).cast("int").alias("round"), F.col("id").alias("draw"), F.pmod(F.xxhash64(F.lit(11), "id"), F.lit(max(n, 1))).alias("at"))
    # ranks by prefix counts over hash chunks, so no task holds all keys
    from quillgraph.skew import segmented_prefix

    ranked = segmented_prefix(ids.withColumn("_qg_all", F.lit(0)), ["_qg_all"], [key], F.lit(1).cast("long"), "at").select(key, "at")
    return draws.join(ranked, "at").select("round", key, "draw")


def sample_report(rows: DataFrame, key: str, text: list[str], per_mille: int = 100) -> DataFrame:
    """``key, line``: side-by-side lines of a sample of documents, chosen by the MD5 of their key; one row per line, a document may have any number."""
    at = F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 6), 16, 10).cast("long")
    return rows.where(F.pmod(at, F.lit(1000)) < per_mille).select(key, F.concat_ws(" | ", *text).alias("line"))


def dependency_paths(tokens: DataFrame) -> DataFrame:
    """``doc_id, sent_id, leaf, path``: words from the root to every leaf of a dependency tree; (doc_id, sent_id, i, text, head_i)."""
    from quillgraph.operators.hierarchy import hierarchy

    key = lambda i: F.concat_ws("\x1f", "doc_id", "sent_id", F.lpad(F.col(i).cast("string"), 6, "0"))
    t = tokens.select("doc_id", "sent_id", "i", "text", key("i").alias("id"), F.when(F.col("head_i") != F.col("i"), key("head_i")).alias("parent"))
    tree = hierarchy(t.select("id", "parent")).where("n_descendants = 0").select("id", F.posexplode("path").alias("k", "at"))
    words = tree.join(t.select(F.col("id").alias("at"), "text"), "at").groupBy("id").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "text"))), lambda x: x["text"]).alias("path"))
    return words.join(t.select("id", "doc_id", "sent_id", F.col("i").alias("leaf")), "id").select("doc_id", "sent_id", "leaf", "path")


def most_similar(vectors: DataFrame, positive: list[int], negative: list[int], top: int = 10) -> DataFrame:
    """``id, similarity``: nearest vectors to the sum of the unit vectors of ``positive`` minus those of ``negative``, those themselves left out."""
    named = {r.id: np.array(r.vector, float) for r in vectors.where(F.col("id").isin(positive + negative)).select("id", "vector").collect()}
    unit = {k: v / max(np.linalg.norm(v), 1e-8) for k, v in named.items()}
    goal = sum(unit[k] for k in positive if k in unit) - sum(unit[k] for k in negative if k in unit)
    from quillgraph.operators.search import cosine_topk

    q = vectors.sparkSession.createDataFrame([(0, [float(x) for x in goal])], "query_id bigint, vector array<double>")
    rest = vectors.where(~F.col("id").isin(positive + negative))
    return cosine_topk(q, rest, top).select("id", "similarity")


def hashed_embedding(texts: list[str], size: int = 64) -> np.ndarray:
    """Default embedder: signed hashes of the words, one unit vector per text."""
    import zlib

    out = np.zeros((len(texts), size), np.float32)
    for r, t in enumerate(texts):
        for w in t.lower().split():
            h = zlib.crc32(w.encode())
            out[r, h % size] += 1 if h >> 16 & 1 else -1
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-8)


def embed(df: DataFrame, id_col: str, text_col: str, embedder: Callable[[list[str]], np.ndarray] = hashed_embedding, batch: int = 1024) -> DataFrame:
    """``id_col, vector`` by a pluggable embedder, in Arrow batches; null texts count as empty."""
    kind = dict(df.dtypes)[id_col]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for lo in range(0, len(b), batch):
                part = b.iloc[lo:lo + batch]
                v = embedder(part["t"].fillna("").tolist())
                yield pd.DataFrame({id_col: part[id_col].to_numpy(), "vector": [x.tolist() for x in v]})

    return df.select(id_col, F.col(text_col).alias("t")).mapInPandas(run, f"{id_col} {kind}, vector array<float>")


def rule_extractor(text: str) -> list[tuple[str, str, str, float]]:
    """Default extractor: "X verb Y" sentences of a few fixed verbs."""
    import re

    out = []
    for s in re.split(r"(?<=[.!?])\s+", text):
        m = re.match(r"(.{2,80}?)\s+(treats|causes|inhibits|reduces|increases|induces|binds)\s+(.{2,80}?)(?:[.,;]|$)", s)
        if m:
            out.append((m.group(1), m.group(2), m.group(3), 0.5))
    return out


def extract_with(df: DataFrame, id_col: str, text_col: str, extractor: Callable[[str], list[tuple[str, str, str, float]]] = rule_extractor) -> DataFrame:
    """``id_col, subject, predicate, object, confidence`` by a pluggable extractor, in Arrow batches."""
    kind = dict(df.dtypes)[id_col]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(k, *r) for k, t in zip(b[id_col], b["t"], strict=True) if t for r in extractor(t)]
            yield pd.DataFrame(rows, columns=[id_col, "subject", "predicate", "object", "confidence"])

    return df.select(id_col, F.col(text_col).alias("t")).mapInPandas(run, f"{id_col} {kind}, subject string, predicate string, object string, confidence double")


def first_sentences(df: DataFrame, key: str, sentence: str, position: str, n: int) -> DataFrame:
    """``key, text``: the first ``n`` sentences of every document joined by blanks."""
    w = Window.partitionBy(key).orderBy(position)
    f = df.withColumn("_qg_n", F.row_number().over(w)).where(F.col("_qg_n") <= n)
    return f.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_qg_n", F.col(sentence).alias("s")))), lambda x: x["s"]), " ").alias("text"))
