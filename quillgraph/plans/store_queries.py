"""Look-ups, grouping, sampling and pluggable models."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillgraph.operators import store as S
from quillgraph.plans.graph_queries import GRAPH
from quillgraph.plans.tables import table
from quillgraph.sources import star


def direct_neighbours(spark, sf):
    return S.direct_neighbours(star.triples(spark, sf)).select("node", "neighbour", F.col("rank").cast("long"))


def related_nodes(spark, sf):
    return S.direct_neighbours(star.triples(spark, sf), 20, "subclass").groupBy("node").agg(F.count("*").alias("n"))


def entity_details(spark, sf):
    d = S.entity_details(star.triples(spark, sf))
    return d.select("entity", "label", F.array_join("synonyms", "|").alias("synonyms"), F.array_join("parents", "|").alias("parents"))


def schema_closure(spark, sf):
    return S.schema_closure(star.triples(spark, sf))


def _typed(spark, sf):
    """Property, domain and restriction triples made from the term links."""
    e = star.edges(spark, sf)
    prefix = lambda c: F.split_part(c, F.lit(":"), F.lit(1))
    prop = F.concat(F.lit("has_"), F.lower(prefix("dst")))
    row = lambda s, p, o, k: e.select(s.alias("s"), F.lit(p).alias("p"), o.alias("o"), F.lit(k).alias("o_kind"))
    b = F.concat(F.lit("_:"), "src", F.lit("-"), "dst")
    return row(prop, "rdfs:domain", F.col("src"), "iri").union(row(prop, "rdfs:range", F.col("dst"), "iri").where("s <> 'has_go'")).union(row(F.col("src"), "rdfs:subClassOf", b, "bnode")).union(
        row(b, "owl:onProperty", prop, "iri")).union(row(b, "owl:someValuesFrom", F.col("dst"), "iri"))


def domain_range(spark, sf):
    return S.domain_range(_typed(spark, sf))


def restriction_scan(spark, sf):
    return S.restriction_scan(_typed(spark, sf))


def query_relationships(spark, sf):
    return S.query_relationships(table(spark, sf, "extracted_relationship"), predicate="causes", min_confidence=0.5).select("er_id", "subject", "object", "confidence").drop("er_id")


def grouped_predictions(spark, sf):
    g = S.group_predictions(table(spark, sf, "results_bioc"))
    return g.select("document_id", F.array_join("entities", "|").alias("entities"), "n_relations", F.md5("abstract").alias("abstract_md5"))


def known_mentions(spark, sf):
    m = table(spark, sf, "relations").select("rel_id", F.col("object").alias("mention"))
    known = table(spark, sf, "ontology_match").select(F.col("canonical_name").alias("name"))
    return S.mentions_of(m, known).select("rel_id", "mention")


def bootstrap(spark, sf):
    """Five rounds of 400 documents, drawn with replacement: draws per round, and whether the distinct documents are as many as chance gives, within 10 %."""
    r = table(spark, sf, "relations")
    n = r.select("pmid").distinct().count()
    draws = S.bootstrap_documents(r, 5, 400).groupBy("round").agg(F.count("*").alias("n"), F.count_distinct("pmid").alias("d"))
    return draws.select(F.col("round").cast("long"), "n", (F.abs(F.col("d") - n * (1 - (1 - 1 / max(n, 1)) ** 400)) <= 40).alias("by_chance"))


def sample_report(spark, sf):
    r = table(spark, sf, "relations").where("subject is not null and action is not null and object is not null")
    return S.sample_report(r, "pmid", ["subject", "action", "object"])


def dependency_paths(spark, sf):
    """Root-to-leaf word paths of the three-token trees of the stored relations."""
    r = table(spark, sf, "relations").where("subject is not null and action is not null and object is not null")
    tok = lambda i, c: F.struct(F.lit(i).alias("i"), F.col(c).alias("text"), F.lit(2).alias("head_i"))
    t = r.select(F.col("rel_id").alias("doc_id"), F.lit(0).alias("sent_id"), F.explode(F.array(tok(1, "subject"), tok(2, "action"), tok(3, "object"))).alias("t")).select("doc_id", "sent_id", "t.*")
    return S.dependency_paths(t).select(F.col("doc_id").alias("rel_id"), F.col("leaf").cast("long"), F.array_join("path", " > ").alias("path"))


def most_similar(spark, sf):
    v = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return S.most_similar(v, [0, 1], [2]).select("id", F.round("similarity", 5).alias("similarity"))


def text_embeddings(spark, sf):
    return S.embed(table(spark, sf, "canonical_terms"), "ontology_id", "canonical_name")


def rule_extraction(spark, sf):
    return S.extract_with(table(spark, sf, "extracted_relationship"), "er_id", "evidence_text")


def group_text(spark, sf):
    """The first three relations of every publication as one text."""
    r = table(spark, sf, "relations").where("subject is not null and action is not null and object is not null").select("pmid", "idx", F.concat_ws(" ", "subject", "action", "object").alias("s"))
    return S.first_sentences(r, "pmid", "s", "idx", 3)


QUERIES = {f.__name__: f for f in (direct_neighbours, related_nodes, entity_details, schema_closure, domain_range, restriction_scan, query_relationships, grouped_predictions, known_mentions,
                                   bootstrap, sample_report, dependency_paths, most_similar, text_embeddings, rule_extraction, group_text)}

_G = "WITH RECURSIVE " + GRAPH
_B = "b AS (SELECT src AS a, dst AS b FROM e UNION SELECT dst, src FROM e)"
_P = "'has_' || lower(split_part(dst, ':', 1))"
ORACLES = {
    "bootstrap": "SELECT r AS round, 400::BIGINT AS n, true AS by_chance FROM range(5) t(r)",
    "sample_report": """SELECT pmid, concat_ws(' | ', subject, action, object) AS line FROM relations WHERE subject IS NOT NULL AND action IS NOT NULL AND object IS NOT NULL
 AND pmid IS NOT NULL AND ('0x' || substr(md5(pmid), 1, 6))::BIGINT % 1000 < 100""",
    "most_similar": """WITH u AS (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS e FROM embeddings),
 g AS (SELECT list_transform(range(1, len(a.e) + 1), lambda i: a.e[i] + b.e[i] - c.e[i]) AS g FROM u a, u b, u c WHERE a.vec_id = 0 AND b.vec_id = 1 AND c.vec_id = 2)
 SELECT vec_id AS id, round(list_cosine_similarity(e, g), 5) AS similarity FROM u, g WHERE vec_id NOT IN (0, 1, 2) ORDER BY list_cosine_similarity(e, g) DESC, vec_id LIMIT 10""",
    "direct_neighbours": f"{_G}, {_B} SELECT a AS node, b AS neighbour, row_number() OVER (PARTITION BY a ORDER BY b) AS rank FROM b QUALIFY rank <= 50",
    "related_nodes": f"{_G}, {_B} SELECT a AS node, least(count(*), 20) AS n FROM b GROUP BY a",
    "entity_details": f"""{_G} SELECT n.id AS entity, name AS label, nullif(array_to_string(list_slice(synonyms, 1, 10), '|'), '') AS synonyms, u.p AS parents FROM n
 LEFT JOIN (SELECT dst AS id, string_agg(src, '|' ORDER BY src) AS p FROM e GROUP BY dst) u ON u.id = n.id WHERE name IS NOT NULL""",
    "schema_closure": f"{_G}, r AS (SELECT dst AS sub, src AS sup FROM e UNION SELECT r.sub, e.src FROM r JOIN e ON e.dst = r.sup) SELECT sub, sup FROM r WHERE sub <> sup UNION SELECT src, src FROM e UNION SELECT dst, dst FROM e",
    "domain_range": f"{_G} SELECT {_P} AS property, min(src) AS domain, CASE WHEN {_P} <> 'has_go' THEN min(dst) END AS range FROM e GROUP BY 1",
    "restriction_scan": f"{_G} SELECT src AS cls, {_P} AS prop, dst AS filler, 'owl:someValuesFrom' AS kind FROM e ORDER BY cls, prop, filler LIMIT 5000",
    "query_relationships": """SELECT subject, object, confidence FROM (SELECT * FROM extracted_relationship WHERE confidence >= 0.5 AND lower(predicate) = 'causes'
 ORDER BY confidence DESC, subject NULLS FIRST, predicate, object NULLS FIRST LIMIT 100)""",
    "grouped_predictions": """WITH x AS (SELECT document_id, unnest([entity1, entity2]) AS e FROM results_bioc), g AS (SELECT document_id, string_agg(DISTINCT e, '|' ORDER BY e) AS entities FROM x WHERE e IS NOT NULL GROUP BY 1)
 SELECT document_id, entities, n_relations, abstract_md5 FROM (SELECT document_id, count(DISTINCT {'a': entity1, 'b': predicted_relation, 'c': entity2}) AS n_relations, md5(min(abstract)) AS abstract_md5 FROM results_bioc GROUP BY 1) LEFT JOIN g USING (document_id)""",
    "known_mentions": "SELECT rel_id, object AS mention FROM relations WHERE lower(trim(object, ' ')) IN (SELECT lower(trim(canonical_name, ' ')) FROM ontology_match WHERE canonical_name IS NOT NULL)",
    "dependency_paths": """WITH r AS (SELECT * FROM relations WHERE subject IS NOT NULL AND action IS NOT NULL AND object IS NOT NULL)
 SELECT rel_id, 1::BIGINT AS leaf, action || ' > ' || subject AS path FROM r UNION ALL SELECT rel_id, 3, action || ' > ' || object FROM r""",
    "group_text": """WITH r AS (SELECT pmid, idx, subject || ' ' || action || ' ' || object AS s FROM relations WHERE subject IS NOT NULL AND action IS NOT NULL AND object IS NOT NULL QUALIFY row_number() OVER (PARTITION BY pmid ORDER BY idx) <= 3)
 SELECT pmid, string_agg(s, ' ' ORDER BY idx) AS text FROM r GROUP BY pmid""",
}
