"""Search, resolution, retrieval and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillgraph.functions import constants as K
from quillgraph.functions import text as T
from quillgraph.operators import evaluation as E
from quillgraph.operators import graph as G
from quillgraph.operators import search as S
from quillgraph.plans.graph_queries import ORACLES as GRAPH_ORACLES
from quillgraph.plans.tables import table
from quillgraph.plans.text_queries import _case
from quillgraph.sources import star


def _terms(spark, sf):
    return table(spark, sf, "canonical_terms").select(F.col("ontology_id").alias("id"), F.col("canonical_name").alias("name"), "synonyms")


def _queries(spark, sf):
    """The stated query set of searches: every row whose id is divisible by 50."""
    return table(spark, sf, "stored_entity").where("entity_id % 50 = 0 and text is not null").select(F.col("entity_id").alias("query_id"), F.col("text").alias("query"))


def scored_search(spark, sf):
    return S.scored_search(_queries(spark, sf), _terms(spark, sf)).select("query_id", "id", "score", F.col("rank").cast("long"))


def search_by_ontology(spark, sf):
    t = _terms(spark, sf).where(F.lower(F.split_part("id", F.lit(":"), F.lit(1))).isin("mondo", "doid"))
    return S.scored_search(_queries(spark, sf), t, 3).select("query_id", "id", "score", F.col("rank").cast("long"))


def term_index(spark, sf):
    return S.term_index(_terms(spark, sf)).groupBy("kind", "key").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))


def exact_lookup(spark, sf):
    return S.exact_matches(_queries(spark, sf), _terms(spark, sf)).select("query_id", "id")


def word_overlap(spark, sf):
    return S.word_matches(_queries(spark, sf), _terms(spark, sf)).select("query_id", "id", F.round("confidence", 9).alias("confidence"))


def prefix_suffix(spark, sf):
    return S.partial_matches(_queries(spark, sf), _terms(spark, sf)).select("query_id", "id", F.round("confidence", 9).alias("confidence"))


def abbreviation_search(spark, sf):
    return S.abbreviation_matches(_queries(spark, sf), _terms(spark, sf)).select("query_id", "id", "confidence")


def fuzzy_search(spark, sf):
    return S.fuzzy_matches(_queries(spark, sf), _terms(spark, sf)).select("query_id", "id", F.round("confidence", 6).alias("confidence"))


def mapping_cascade(spark, sf):
    return S.mapping_cascade(_queries(spark, sf), _terms(spark, sf), fuzzy=True).select("query_id", "id", F.round("confidence", 6).alias("confidence"), F.col("rank").cast("long"))


def best_synonym(spark, sf):
    q, t = _queries(spark, sf), _terms(spark, sf)
    return S.best_synonym(q, t, S.word_matches(q, t)).select("query_id", "id", "synonym", F.round("similarity", 6).alias("similarity"))


def token_jaccard_topk(spark, sf):
    texts = _terms(spark, sf).select("id", F.col("name").alias("text"))
    return S.token_jaccard(_queries(spark, sf), texts).select("query_id", "id", F.round("similarity", 9).alias("similarity"), F.col("rank").cast("long"))


def cosine_topk(spark, sf):
    v = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return S.cosine_topk(v.where("id % 50 = 0").select(F.col("id").alias("query_id"), "vector"), v).select("query_id", "id", F.round("similarity", 5).alias("similarity"))


def tfidf_topk(spark, sf):
    m = table(spark, sf, "canonical_terms").select(F.col("ontology_id").alias("id"), F.concat_ws(" ", "canonical_name", F.array_join(F.slice("synonyms", 1, 5), " ")).alias("text"))
    return S.tfidf_topk(_queries(spark, sf), m).select("query_id", "id", F.round("similarity", 6).alias("similarity"))


def enriched_text(spark, sf):
    """Every stored entity text with the context of the terms it names exactly."""
    n, e = star.nodes(spark, sf), star.edges(spark, sf)
    docs = table(spark, sf, "ontology_match").select(F.col("match_id").alias("doc_id"), F.col("entity_text").alias("text")).where("text is not null")
    index = n.where("name is not null").select("id", T.index_text(F.col("name")).alias("t"))
    mentions = docs.select("doc_id", T.index_text(F.col("text")).alias("t")).join(index, "t").select("doc_id", "id")
    return S.enriched_text(docs, mentions, G.context_sentences(n, e).select("id", "context"))


def _triples(spark, sf):
    """Predicted and true triples of the evaluation rows; the time of a row is its id, and stands in for the confidence the table lacks."""
    r = table(spark, sf, "results_bioc").withColumn("id", F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', evaluated_at)")).select(
        "id", T.eval_entity(F.col("entity1")).alias("s"), T.eval_entity(F.col("entity2")).alias("o"), T.eval_predicate(F.col("predicted_relation")).alias("pp"), T.eval_predicate(F.col("relation")).alias("gp"))
    p = r.where("s <> '' and o <> '' and pp <> 'no_relation'").select(F.col("id").alias("pred_id"), "s", F.col("pp").alias("p"), "o", ((F.col("id") % 1000) / 1000).alias("confidence"))
    g = r.where("s <> '' and o <> '' and gp <> 'no_relation'").select(F.col("id").alias("gold_id"), "s", F.col("gp").alias("p"), "o")
    return p, g


def _matches(spark, sf):
    return E.match_exact(*_triples(spark, sf))


def match_exact(spark, sf):
    return _matches(spark, sf).select("status", "pred_id", "gold_id")


def _r(df, *cols):
    return df.select(*[F.round(c, 9).alias(c) if c in cols else c for c in df.columns])


def overall_metrics(spark, sf):
    return _r(E.overall_metrics(_matches(spark, sf)), "precision", "recall", "f1")


def per_predicate(spark, sf):
    return _r(E.per_predicate_metrics(_matches(spark, sf)), "precision", "recall", "f1")


def confusion(spark, sf):
    return E.confusion(_matches(spark, sf))


def confidence_stats(spark, sf):
    return _r(E.confidence_statistics(_matches(spark, sf)), "mean", "std")


def fuzzy_match(spark, sf):
    return E.match_fuzzy(*_triples(spark, sf))


def _pairs(spark, sf):
    p = table(spark, sf, "relations").select("pmid", F.trim("subject").alias("a"), F.trim("object").alias("b"))
    g = table(spark, sf, "extracted_relationship").select(F.col("document_id").alias("pmid"), F.trim("subject").alias("a"), F.trim("object").alias("b"))
    return E.pair_match(p, g)


def cdr_pairs(spark, sf):
    return _pairs(spark, sf)


def cdr_metrics(spark, sf):
    return _r(E.pair_metrics(_pairs(spark, sf)), "precision", "recall", "f1")


def _labels(spark, sf):
    return table(spark, sf, "results_bioc").select(F.col("relation").alias("truth"), F.col("predicted_relation").alias("pred"))


def classifier_report(spark, sf):
    return _r(E.classifier_report(_labels(spark, sf)), "precision", "recall", "f1")


def error_patterns(spark, sf):
    return _r(E.error_patterns(_labels(spark, sf)), "share").select("pattern", "n", "share", F.col("rank").cast("long"))


QUERIES = {f.__name__: f for f in (scored_search, search_by_ontology, term_index, exact_lookup, word_overlap, prefix_suffix, abbreviation_search, fuzzy_search, mapping_cascade,
                                   best_synonym, token_jaccard_topk, cosine_topk, tfidf_topk, enriched_text, match_exact, overall_metrics, per_predicate, confusion,
                                   confidence_stats, fuzzy_match, cdr_pairs, cdr_metrics, classifier_report, error_patterns)}

_IX = r"replace(replace(replace(regexp_replace(trim(regexp_replace(lower({0}), '[ \t\n\r\f]+', ' ', 'g'), ' '), '[^\p{{L}}\p{{N}}_ .\-]', '', 'g'), 'α', 'alpha'), 'β', 'beta'), 'γ', 'gamma')"
_T = "t AS (SELECT ontology_id AS id, canonical_name AS name, synonyms FROM canonical_terms), q AS (SELECT entity_id AS query_id, text AS query FROM stored_entity WHERE entity_id % 50 = 0 AND text IS NOT NULL)"
_VAR = r"""raw AS (SELECT id, unnest(list_concat([name], coalesce(synonyms, []))) AS c FROM t),
 vw AS (SELECT id, c, list_filter(regexp_extract_all(c, '[A-Za-z0-9_]+'), lambda x: regexp_matches(x, '^[A-Za-z]+$')) AS ws, trim(regexp_replace(c, '[ \t\n\r\f]*\([^)]*\)', '', 'g'), ' ') AS bare FROM raw WHERE c IS NOT NULL AND trim(c, ' ') <> ''),
 vi AS (SELECT *, array_to_string([x[1] FOR x IN ws], '') AS ini FROM vw),
 va AS (SELECT id, unnest([CASE WHEN len(ws) > 1 THEN upper(ini) END, CASE WHEN len(ws) BETWEEN 2 AND 4 THEN lower(ini) END, CASE WHEN c LIKE '%s' AND length(c) > 3 THEN c[1:length(c) - 1] WHEN c NOT LIKE '%s' THEN c || 's' END,
 CASE WHEN bare <> c THEN bare END, CASE WHEN contains(c, '-') THEN replace(c, '-', ' ') END, CASE WHEN contains(c, '-') THEN replace(c, '-', '') END, c, id]) AS v FROM vi),
 al AS (SELECT DISTINCT id, """ + _IX.format("v") + """ AS term FROM va WHERE v IS NOT NULL AND """ + _IX.format("v") + """ <> '')"""
_IDX = _VAR + """, ix AS (SELECT 'exact' AS kind, term AS key, id FROM al UNION SELECT 'word', w, id FROM (SELECT id, unnest(string_split(term, ' ')) AS w FROM al) WHERE length(w) > 2
 UNION SELECT 'prefix', term[1:k], id FROM al, range(3, 8) r(k) WHERE length(term) >= k UNION SELECT 'suffix', right(term, k), id FROM al, range(3, 8) r(k) WHERE length(term) >= k)"""


def _scored(where: str, top: int) -> str:
    return f"""WITH {_T}, tt AS (SELECT id, lower(name) AS name, [lower(x) FOR x IN coalesce(synonyms, [])] AS syn FROM t WHERE {where}), qq AS (SELECT query_id, lower(trim(query, ' ')) AS q FROM q WHERE trim(query, ' ') <> ''),
 s AS (SELECT query_id, id, CASE WHEN q = name THEN 1.0::DOUBLE WHEN contains(name, q) THEN 0.8::DOUBLE WHEN contains(q, name) THEN 0.7::DOUBLE ELSE 0.0::DOUBLE END AS n,
 CASE WHEN list_contains(syn, q) THEN 0.95::DOUBLE WHEN len(list_filter(syn, lambda x: contains(x, q))) > 0 THEN 0.75::DOUBLE ELSE 0.0::DOUBLE END AS y FROM qq, tt),
 f AS (SELECT query_id, id, CASE WHEN n >= 0.8 THEN n ELSE greatest(n, y) END AS score FROM s)
 SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM f WHERE score > 0.6 QUALIFY rank <= {top}"""


_N = r"trim(regexp_replace(lower({0}), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"
_EE = lambda c: _case(f"translate(trim(lower({c}), ' '), '-_', '  ')", K.ENTITY_ABBREVIATIONS, f"translate(trim(lower({c}), ' '), '-_', '  ')")
_EP = lambda c: _case(f"regexp_replace(trim(lower({c}), ' '), '[ -]', '_', 'g')", K.EVAL_PREDICATES, f"regexp_replace(trim(lower({c}), ' '), '[ -]', '_', 'g')")
_TR = f"""r AS (SELECT epoch_us(evaluated_at) AS id, {_EE('entity1')} AS s, {_EE('entity2')} AS o, {_EP('predicted_relation')} AS pp, {_EP('relation')} AS gp FROM results_bioc),
 p AS (SELECT id AS pred_id, s, pp AS p, o, (id % 1000) / 1000 AS confidence FROM r WHERE s <> '' AND o <> '' AND pp <> 'no_relation'),
 g AS (SELECT max(id) AS gold_id, s, gp AS p, o FROM r WHERE s <> '' AND o <> '' AND gp <> 'no_relation' GROUP BY ALL),
 x AS (SELECT CASE WHEN gold_id IS NULL THEN 'FP' ELSE 'TP' END AS status, pred_id, gold_id, p.p AS pred_p, CASE WHEN gold_id IS NOT NULL THEN p.p END AS gold_p, confidence FROM p LEFT JOIN g USING (s, p, o)
 UNION ALL SELECT 'FN', NULL, gold_id, NULL, g.p, NULL FROM g ANTI JOIN p USING (s, p, o))"""
_SC = """round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 9) AS precision, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 9) AS recall,
 round(CASE WHEN tp > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END, 9) AS f1, tp + fn AS support"""
_CNT = "count(*) FILTER (status = 'TP') AS tp, count(*) FILTER (status = 'FP') AS fp, count(*) FILTER (status = 'FN') AS fn"
_PAIR = """p AS (SELECT DISTINCT pmid, lower(trim(subject, ' ')) AS a, lower(trim(object, ' ')) AS b FROM relations WHERE pmid IS NOT NULL AND subject IS NOT NULL AND object IS NOT NULL),
 g AS (SELECT DISTINCT document_id AS pmid, lower(trim(subject, ' ')) AS a, lower(trim(object, ' ')) AS b FROM extracted_relationship WHERE document_id IS NOT NULL AND subject IS NOT NULL AND object IS NOT NULL),
 x AS (SELECT pmid, a, b, 'tp' AS status FROM p SEMI JOIN g USING (pmid, a, b) UNION ALL SELECT pmid, a, b, 'fp' FROM p ANTI JOIN g USING (pmid, a, b) WHERE pmid IN (SELECT pmid FROM g) UNION ALL SELECT pmid, a, b, 'fn' FROM g ANTI JOIN p USING (pmid, a, b))"""
_LAB = """l AS (SELECT coalesce(relation, 'null') AS t, coalesce(predicted_relation, 'null') AS p FROM results_bioc), cl AS (SELECT t AS label FROM l UNION SELECT p FROM l),
 c AS (SELECT label, (SELECT count(*) FROM l WHERE t = label) AS support, (SELECT count(*) FROM l WHERE p = label) AS predicted, (SELECT count(*) FROM l WHERE t = label AND p = label) AS tp FROM cl),
 m AS (SELECT *, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0 END AS pr, CASE WHEN support > 0 THEN tp / support ELSE 0 END AS re FROM c), mm AS (SELECT *, CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0 END AS f FROM m)"""
_STOP = "(" + ", ".join(f"'{w}'" for w in K.STOP_WORDS) + ")"


def _tf(src: str, key: str, col: str) -> str:
    return f"""(SELECT {key}, unnest(list_concat(w, [w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))])) AS term FROM (SELECT {key}, list_filter(regexp_extract_all(lower({col}), '[a-z0-9]{{2,}}'), lambda x: x NOT IN {_STOP}) AS w FROM {src}))"""


_ENRICHED = """, idx AS (SELECT id, """ + _IX.format("name") + """ AS t FROM n WHERE name IS NOT NULL), dc AS (SELECT match_id AS doc_id, entity_text AS text FROM ontology_match WHERE entity_text IS NOT NULL),
 mt AS (SELECT doc_id, idx.id FROM dc JOIN idx ON idx.t = """ + _IX.format("dc.text") + """),
 cx AS (SELECT id, s, row_number() OVER (PARTITION BY id ORDER BY o) - 1 AS k FROM (SELECT * FROM dd QUALIFY row_number() OVER (PARTITION BY id ORDER BY o) <= 6)),
 li AS (SELECT doc_id, s, min((cx.id, k)) AS o FROM mt JOIN cx USING (id) GROUP BY doc_id, s), fw AS (SELECT * FROM li QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY o, s) <= 8),
 jo AS (SELECT doc_id, string_agg(s, ' ; ' ORDER BY o, s) AS c FROM fw GROUP BY doc_id)
 SELECT dc.doc_id, CASE WHEN c IS NULL THEN text ELSE text || ' [ONTO] ' || c END AS text FROM dc LEFT JOIN jo USING (doc_id)"""
_CONTEXT = GRAPH_ORACLES["entity_context"]

ORACLES = {
    "enriched_text": _CONTEXT[:_CONTEXT.index(" SELECT id, string_agg(s, ' ; ' ORDER BY o) AS context")].rstrip() + _ENRICHED,
    "scored_search": _scored("true", 5),
    "search_by_ontology": _scored("lower(split_part(id, ':', 1)) IN ('mondo', 'doid')", 3),
    "term_index": f"WITH {_T}, {_IDX} SELECT kind, key, count(*) AS n, min(id) AS first_id FROM ix GROUP BY kind, key",
    "exact_lookup": f"WITH {_T}, {_VAR} SELECT DISTINCT query_id, al.id FROM q JOIN al ON al.term = {_IX.format('q.query')} WHERE al.term <> ''",
    "word_overlap": f"""WITH {_T}, n AS (SELECT DISTINCT id, list_distinct(list_filter(string_split({_IX.format('c')}, ' '), lambda w: w <> '')) AS tw FROM (SELECT id, unnest(list_concat([name], list_slice(coalesce(synonyms, []), 1, 3))) AS c FROM t)),
 z AS (SELECT query_id, list_distinct(list_filter(string_split({_IX.format('query')}, ' '), lambda w: w <> '')) AS qw FROM q),
 s AS (SELECT query_id, id, len(list_intersect(qw, tw)) / len(list_distinct(list_concat(qw, tw))) AS c FROM z, n WHERE len(list_filter(list_intersect(qw, tw), lambda w: length(w) > 2)) > 0)
 SELECT query_id, id, round(max(c), 9) AS confidence FROM s WHERE c > 0.4 GROUP BY query_id, id""",
    "prefix_suffix": f"""WITH {_T}, {_IDX}, z AS (SELECT query_id, {_IX.format('query')} AS s FROM q), k AS (SELECT query_id, 'prefix' AS kind, s[1:k] AS key, k / length(s) * 0.6 AS c FROM z, range(3, 8) r(k) WHERE length(s) >= k
 UNION ALL SELECT query_id, 'suffix', right(s, k), k / length(s) * 0.5 FROM z, range(3, 8) r(k) WHERE length(s) >= k)
 SELECT query_id, id, round(max(c), 9) AS confidence FROM k JOIN ix USING (kind, key) GROUP BY query_id, id""",
    "abbreviation_search": f"""WITH {_T}, u AS (SELECT id, a FROM (SELECT id, unnest(list_concat([name], coalesce(synonyms, []))) AS a FROM t) WHERE regexp_matches(a, '^[A-Z][A-Z0-9]+$')),
 w AS (SELECT query_id, query, list_filter(string_split_regex(trim(query, ' '), '[^A-Za-z]+'), lambda x: x <> '') AS ws FROM q),
 z AS (SELECT query_id, trim(query, ' ') AS a, 0.9::DOUBLE AS c FROM q UNION ALL SELECT query_id, upper(array_to_string([x[1] FOR x IN ws], '')), 0.8::DOUBLE FROM w WHERE len(ws) > 1)
 SELECT query_id, id, max(c) AS confidence FROM z JOIN u USING (a) GROUP BY query_id, id""",
    "token_jaccard_topk": f"""WITH {_T}, a AS (SELECT query_id, list_distinct(regexp_extract_all(lower(query), '[a-z0-9]+')) AS qt FROM q), b AS (SELECT id, list_distinct(regexp_extract_all(lower(name), '[a-z0-9]+')) AS tt FROM t),
 s AS (SELECT query_id, id, len(list_intersect(qt, tt)) AS i, len(qt) + len(tt) AS u FROM a, b)
 SELECT query_id, id, round(i / (u - i), 9) AS similarity, row_number() OVER (PARTITION BY query_id ORDER BY i / (u - i) DESC, id) AS rank FROM s WHERE i > 0 QUALIFY rank <= 5""",
    "cosine_topk": """WITH v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e FROM embeddings), s AS (SELECT q.id AS query_id, v.id, round(list_cosine_similarity(q.e, v.e), 9) AS s FROM v q, v WHERE q.id % 50 = 0)
 SELECT query_id, id, round(s, 5) AS similarity FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) <= 10""",
    "tfidf_topk": f"""WITH {_T}, d AS (SELECT ontology_id AS id, concat_ws(' ', canonical_name, coalesce(array_to_string(list_slice(synonyms, 1, 5), ' '), '')) AS text FROM canonical_terms),
 tf AS (SELECT id, term, count(*) AS tf FROM {_tf('d', 'id', 'text')} GROUP BY ALL), vo AS (SELECT term, sum(tf) AS total, count(*) AS df FROM tf GROUP BY term ORDER BY total DESC, term LIMIT 1000),
 idf AS (SELECT term, ln((1 + (SELECT count(*) FROM d)) / (1 + df)) + 1 AS idf FROM vo), x AS (SELECT id, term, tf * idf AS x FROM tf JOIN idf USING (term)),
 w AS (SELECT id, term, x / sqrt(sum(x * x) OVER (PARTITION BY id)) AS w FROM x), qx AS (SELECT query_id, term, count(*) * any_value(idf) AS x FROM {_tf('q', 'query_id', 'query')} JOIN idf USING (term) GROUP BY query_id, term),
 qw AS (SELECT query_id, term, x / sqrt(sum(x * x) OVER (PARTITION BY query_id)) AS w FROM qx), s AS (SELECT query_id, id, round(sum(qw.w * w.w), 9) AS s FROM qw JOIN w USING (term) GROUP BY ALL)
 SELECT query_id, id, round(s, 6) AS similarity FROM s WHERE s > 0.3 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) <= 10""",
    "match_exact": f"WITH {_TR} SELECT status, pred_id, gold_id FROM x",
    "overall_metrics": f"WITH {_TR}, c AS (SELECT {_CNT} FROM x) SELECT tp, fp, fn, {_SC} FROM c",
    "per_predicate": f"WITH {_TR}, c AS (SELECT coalesce(pred_p, gold_p) AS predicate, {_CNT} FROM x GROUP BY 1) SELECT predicate, tp, fp, fn, {_SC} FROM c",
    "confusion": f"WITH {_TR} SELECT coalesce(pred_p, 'NOT_PREDICTED') AS row_label, coalesce(gold_p, 'NOT_IN_GOLD') AS col_label, count(*) AS n FROM x GROUP BY 1, 2",
    "confidence_stats": f"WITH {_TR} SELECT status, count(confidence) AS n, round(coalesce(avg(confidence), 0), 9) AS mean, round(coalesce(stddev_pop(confidence), 0), 9) AS std FROM x WHERE status IN ('TP', 'FP') GROUP BY status",
    "cdr_pairs": f"WITH {_PAIR} SELECT * FROM x",
    "cdr_metrics": f"""WITH {_PAIR}, c AS (SELECT count(DISTINCT (a, b)) FILTER (status = 'tp') AS tp, count(DISTINCT (a, b)) FILTER (status = 'fn') AS fn, count(DISTINCT (a, b)) FILTER (status = 'fp') AS fp FROM x),
 d AS (SELECT *, tp > 0 AND fn > 0 AND fp > 0 AS ok FROM c) SELECT tp, fn, fp, round(CASE WHEN ok THEN tp / (tp + fn) ELSE 0 END, 9) AS precision, round(CASE WHEN ok THEN tp / (tp + fp) ELSE 0 END, 9) AS recall,
 round(CASE WHEN ok THEN 2 * tp / (2 * tp + fn + fp) ELSE 0 END, 9) AS f1 FROM d""",
    "classifier_report": f"""WITH {_LAB} SELECT label, round(pr, 9) AS precision, round(re, 9) AS recall, round(f, 9) AS f1, support FROM mm
 UNION ALL SELECT 'MICRO', round(sum(tp) / sum(support), 9), round(sum(tp) / sum(support), 9), round(sum(tp) / sum(support), 9), sum(support)::BIGINT FROM mm
 UNION ALL SELECT 'MACRO', round(avg(pr), 9), round(avg(re), 9), round(avg(f), 9), sum(support)::BIGINT FROM mm
 UNION ALL SELECT 'WEIGHTED', round(sum(pr * support) / sum(support), 9), round(sum(re * support) / sum(support), 9), round(sum(f * support) / sum(support), 9), sum(support)::BIGINT FROM mm""",
    "error_patterns": """WITH e AS (SELECT relation || ' -> ' || predicted_relation AS pattern, count(*) AS n FROM results_bioc WHERE relation <> predicted_relation GROUP BY 1)
 SELECT pattern, n, round(n / sum(n) OVER (), 9) AS share, row_number() OVER (ORDER BY n DESC, pattern) AS rank FROM e QUALIFY rank <= 10""",
}
