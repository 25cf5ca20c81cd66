"""Walks through the literature graph, connecting paths, tagging, model extraction and the whole way from text to graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillgraph.functions import constants as K
from quillgraph.functions import text as T
from quillgraph.operators import graph as G
from quillgraph.operators import pipeline as P
from quillgraph.operators import traversal as W
from quillgraph.operators.contains import contains_join, top_per_key
from quillgraph.plans.graph_queries import _NORM, GRAPH, LIT, _starts50
from quillgraph.plans.search_queries import _TR, _matches
from quillgraph.plans.tables import table
from quillgraph.sources import star

_LABELS = ["no_relation", *dict.fromkeys(K.EVAL_PREDICATES.values())]
_RELS = "src", "dst", "relation"


def explore_levels(spark, sf):
    """Two levels of the literature graph from the subjects of the query rows (ids divisible by 50)."""
    return W.explore_levels(star.literature(spark, sf).select(*_RELS), _starts50(spark, sf)).select("start", F.col("depth").cast("long"), "src", "relation", "dst")


def explore_depth_first(spark, sf):
    return W.explore_depth_first(star.literature(spark, sf).select(*_RELS), _starts50(spark, sf))


def explore_planned(spark, sf):
    return W.explore_planned(star.literature(spark, sf).select(*_RELS), _starts50(spark, sf)).select("start", "node", F.col("depth").cast("long"))


def _pairs50(spark, sf):
    r = table(spark, sf, "relations").where("rel_id % 50 = 0")
    norm = lambda c: F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " "))
    return r.select(norm("subject").alias("start"), norm("object").alias("end")).where("start <> '' and end <> '' and start <> end").distinct()


def connecting_paths(spark, sf):
    """Best paths between both ends of the query rows (ids divisible by 50)."""
    p = W.connecting_paths(star.literature(spark, sf).select(*_RELS), _pairs50(spark, sf))
    return p.select("start", "end", "mid", F.array_join("relations", "|").alias("relations"), F.round("score", 9).alias("score"), "rank")


def query_expansion(spark, sf):
    """Follow-up queries of the query rows by their direct neighbours."""
    q = _starts50(spark, sf).select(F.col("start").alias("query_id"), F.col("start").alias("query"))
    near = star.literature(spark, sf).join(q.select(F.col("query").alias("src")), "src").select(F.col("src").alias("query_id"), F.col("dst").alias("node"))
    return W.expand_queries(q, near)


def label_codes(spark, sf):
    r = table(spark, sf, "results_bioc")
    return r.select("document_id", "entity1", "entity2", P.label_code(T.eval_predicate(F.col("relation")), _LABELS).cast("long").alias("code"))


def node_types(spark, sf):
    n = star.nodes(spark, sf)
    return n.select("id", P.node_type(F.array_compact(F.array("ontology", "biolink_type", "name"))).alias("type"))


def missed_relations(spark, sf):
    return _matches(spark, sf).where("status = 'FN'").select("gold_id", F.col("gold_p").alias("predicate"))


def false_positives(spark, sf):
    return _matches(spark, sf).where("status = 'FP'").select("pred_id", F.col("pred_p").alias("predicate"), F.round("confidence", 9).alias("confidence"))


def evidence_candidates(spark, sf):
    """The first five terms whose name contains the subject of a query row (ids divisible by 50)."""
    q = _starts50(spark, sf).select(F.col("start").alias("term"))
    n = star.nodes(spark, sf).where("name is not null").select("id", F.col("name").alias("label"), F.lower("name").alias("low"))
    hit = contains_join(q, "term", n, "low").select("term", "id", "label")
    return top_per_key(hit, ["term"], [F.col("id")], 5).select("term", "id", "label", F.col("rank").cast("long"))


def tagged_words(spark, sf):
    e = table(spark, sf, "extracted_relationship").where("evidence_text is not null")
    return e.select("er_id", F.array_join(P.tagged_words(F.col("evidence_text"), K.STOP_WORDS), "\n").alias("words"))


def dictionary_tags(spark, sf):
    """Names of the canonical list in the typed entity texts."""
    names = [(r[0], r[1]) for r in table(spark, sf, "canonical_terms").select("canonical_name", "biolink_type").collect()]  # the fixed reference list
    return P.tag_with(table(spark, sf, "stored_entity"), "entity_id", "text", P.DictionaryTagger(names))


def model_extraction(spark, sf):
    """Relations of the evidence texts by the default model, asked twice."""
    return P.extract_with_model(table(spark, sf, "extracted_relationship"), "er_id", "evidence_text")


def case_graph(spark, sf):
    """Evidence texts to mapped relations."""
    d = table(spark, sf, "extracted_relationship").where("evidence_text is not null").select(F.col("er_id").alias("doc_id"), F.col("evidence_text").alias("text"))
    return P.text_to_graph(d, star.nodes(spark, sf), G.degrees(star.edges(spark, sf)), lambda t: P.extract_with_model(t, "doc_id", "text"))


QUERIES = {f.__name__: f for f in (explore_levels, explore_depth_first, explore_planned, connecting_paths, query_expansion, label_codes, node_types, missed_relations,
                                   false_positives, evidence_candidates, tagged_words, dictionary_tags, model_extraction, case_graph)}

_L = "WITH " + LIT
_ST = f"st AS (SELECT DISTINCT {_NORM.format('subject')} AS start FROM relations WHERE rel_id % 50 = 0 AND {_NORM.format('subject')} <> '')"
_FL = f"{_L}, {_ST}, fl AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY dst) AS k FROM (SELECT src, dst, min(relation) AS relation FROM lit GROUP BY 1, 2) QUALIFY k <= 20), o AS (SELECT start, dst, relation, k FROM st JOIN fl ON src = start)"
_BONUS = lambda r: "CASE WHEN regexp_matches(lower(" + r + "), '" + "|".join(K.BONUS_RELATIONS) + "') THEN 1.3::DOUBLE ELSE 1.0::DOUBLE END"
_EP = "CASE p " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in K.EVAL_PREDICATES.items()) + " ELSE p END"
_STOP = "(" + ", ".join(f"'{w}'" for w in K.STOP_WORDS) + ")"
ORACLES = {
    "explore_levels": f"""{_FL}, t AS (SELECT o.start, fl.src, fl.dst, fl.relation FROM o JOIN fl ON fl.src = o.dst WHERE fl.dst <> o.start AND (o.start, fl.dst) NOT IN (SELECT start, dst FROM o))
 SELECT start, 1::BIGINT AS depth, start AS src, relation, dst FROM o UNION ALL SELECT start, 2, src, relation, dst FROM t""",
    "explore_depth_first": f"""{_FL}, t AS (SELECT o.start, fl.src, fl.dst, fl.relation, o.k, fl.k AS j FROM o JOIN fl ON fl.src = o.dst LEFT JOIN o v ON v.start = o.start AND v.dst = fl.dst AND v.k <= o.k WHERE fl.dst <> o.start AND v.k IS NULL),
 w AS (SELECT start, 1::BIGINT AS depth, start AS src, relation, dst, k, 0 AS j FROM o UNION ALL SELECT start, 2, src, relation, dst, k, j FROM t)
 SELECT start, row_number() OVER (PARTITION BY start ORDER BY k, j) - 1 AS step, depth, src, relation, dst FROM w""",
    "explore_planned": f"""{_L}, {_ST}, h AS (SELECT DISTINCT src, dst, w FROM lit, (SELECT unnest({W.FALLBACK_PLAN}) AS w) WHERE contains(relation, w)),
 f AS (SELECT DISTINCT src, dst FROM (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY src, w ORDER BY dst) <= 5)),
 o AS (SELECT start, dst AS node, 1 AS d FROM st JOIN f ON src = start), t AS (SELECT * FROM o UNION ALL SELECT o.start, f.dst, 2 FROM o JOIN f ON f.src = o.node)
 SELECT start, node, CAST(min(d) AS BIGINT) AS depth FROM t WHERE start <> node GROUP BY start, node""",
    "connecting_paths": f"""{_L}, pr AS (SELECT DISTINCT {_NORM.format('subject')} AS s, {_NORM.format('object')} AS e FROM relations WHERE rel_id % 50 = 0), p AS (SELECT * FROM pr WHERE s <> '' AND e <> '' AND s <> e),
 a AS (SELECT s, e, NULL::VARCHAR AS mid, relation AS relations, 1.2 * {_BONUS('relation')} AS score FROM p JOIN lit ON src = s AND dst = e), fu AS (SELECT s, e FROM a GROUP BY 1, 2 HAVING count(*) >= 10),
 b AS (SELECT s, e, x.dst AS mid, x.relation || '|' || y.relation AS relations, {_BONUS('x.relation')} * {_BONUS('y.relation')} AS score FROM p JOIN lit x ON x.src = s JOIN lit y ON y.src = x.dst AND y.dst = e
  WHERE x.dst <> e AND (s, e) NOT IN (SELECT s, e FROM fu) QUALIFY row_number() OVER (PARTITION BY s, e ORDER BY mid, relations) <= 10)
 SELECT s AS start, e AS "end", mid, relations, round(score, 9) AS score, row_number() OVER (PARTITION BY s, e ORDER BY score DESC, mid NULLS FIRST, relations) AS rank FROM (SELECT * FROM a UNION ALL SELECT * FROM b) QUALIFY rank <= 5""",
    "query_expansion": f"""{_L}, {_ST}, d AS (SELECT DISTINCT start, dst FROM st JOIN lit ON src = start)
 SELECT start AS query_id, row_number() OVER (PARTITION BY start ORDER BY dst) AS rank, start || ' ' || dst AS query FROM d QUALIFY rank <= 5""",
    "label_codes": f"""WITH x AS (SELECT *, regexp_replace(trim(lower(relation), ' '), '[ -]', '_', 'g') AS p FROM results_bioc)
 SELECT document_id, entity1, entity2, coalesce(list_position({_LABELS}, {_EP}) - 1, 0)::BIGINT AS code FROM x""",
    "node_types": f"""WITH RECURSIVE {GRAPH}, t AS (SELECT id, lower(concat_ws(' ', ontology, biolink_type, name)) AS t FROM n)
 SELECT id, CASE WHEN regexp_matches(t, 'drug|compound|chemical|disease|disorder|phenotype|protein|gene') THEN 'entity' WHEN regexp_matches(t, 'pathway|process') THEN 'concept' ELSE 'entity' END AS type FROM t""",
    "missed_relations": f"WITH {_TR} SELECT gold_id, gold_p AS predicate FROM x WHERE status = 'FN'",
    "false_positives": f"WITH {_TR} SELECT pred_id, pred_p AS predicate, round(confidence, 9) AS confidence FROM x WHERE status = 'FP'",
    "evidence_candidates": f"""WITH RECURSIVE {GRAPH}, {_ST} SELECT start AS term, id, name AS label, row_number() OVER (PARTITION BY start ORDER BY id) AS rank FROM st, n
 WHERE name IS NOT NULL AND contains(lower(name), start) QUALIFY rank <= 5""",
    "tagged_words": rf"""SELECT er_id, array_to_string(list_sort(list_filter(list_distinct(regexp_extract_all(evidence_text, '[^\s]+')), lambda w: w NOT IN {_STOP})), chr(10)) AS words
 FROM extracted_relationship WHERE evidence_text IS NOT NULL""",
}
