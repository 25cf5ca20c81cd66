"""Projection and scalar operators over the text tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillgraph.functions import constants as K
from quillgraph.functions import text as T
from quillgraph.plans.tables import table


def strip_citations(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.strip_citations(F.col("text")).alias("clean"))


def normalize_term(spark, sf):
    r = table(spark, sf, "relations")
    return r.select("rel_id", T.resolver_term(F.col("subject")).alias("subject"), T.resolver_term(F.col("object")).alias("object"),
                    T.query_literal(F.col("action")).alias("action"))


def index_text(spark, sf):
    return table(spark, sf, "stored_entity").select("entity_id", T.index_text(F.col("text")).alias("indexed"))


def iri_to_curie(spark, sf):
    ids = table(spark, sf, "ontology_match").select(F.explode("parents").alias("iri"))
    return ids.groupBy(T.iri_to_curie(F.trim(F.regexp_replace("iri", "[<>]", ""))).alias("curie")).agg(F.count("*").alias("n"))


def biolink_type(spark, sf):
    m = table(spark, sf, "ontology_match")
    ont = F.lower(F.regexp_extract("ontology_id", "([A-Za-z]+)[:_][0-9]+", 1))
    return m.select("match_id", T.biolink_type(ont, F.col("canonical_name")).alias("type"),
                    T.accepts_type(F.when(F.col("biolink_type") == "Disease", "disease").otherwise("process"), ont).alias("accepted"))


def eval_normalize(spark, sf):
    e = table(spark, sf, "extracted_relationship")
    return e.select("er_id", T.eval_entity(F.col("subject")).alias("subject"), T.eval_predicate(F.col("predicate")).alias("predicate"),
                    T.extractor_predicate(F.col("predicate")).alias("standard"))


def snake_case(spark, sf):
    return table(spark, sf, "extracted_relationship").select("er_id", T.snake_case(F.col("predicate")).alias("name"))


def term_variants(spark, sf):
    c = table(spark, sf, "canonical_terms")
    return c.select("ontology_id", F.explode(T.term_variants(F.col("canonical_name"))).alias("variant"))


def entity_variants(spark, sf):
    c = table(spark, sf, "stored_entity").where("text is not null")
    return c.select("entity_id", F.explode(T.entity_variants(F.col("text"))).alias("variant"))


def tokens(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.explode(T.token_set(F.col("text"))).alias("token"))
    return d.groupBy("token").agg(F.count("*").alias("n_docs"))


def node_text(spark, sf):
    m = table(spark, sf, "ontology_match")
    return m.select("match_id", T.node_text(F.col("canonical_name"), F.col("synonyms"), F.col("definition")).alias("text"))


def entity_markers(spark, sf):
    e = table(spark, sf, "extracted_relationship").where("evidence_text is not null and subject is not null and object is not null")
    marked = e.select("er_id", T.mark_mentions(F.col("evidence_text"), F.col("subject"), F.col("object")).alias("marked"))
    toks = F.split("marked", r"[ \t\n\r]+")
    at = lambda tag: F.array_position(F.transform(toks, lambda t: F.startswith(t, F.lit(tag))), F.lit(True)).cast("long")
    return marked.select("er_id", "marked", at("[E1]").alias("e1_token"), at("[E2]").alias("e2_token"))


def definition_mining(spark, sf):
    m = table(spark, sf, "ontology_match")
    return m.select("match_id", T.definition_context(F.col("definition")).alias("context"))


def iri_prefix(spark, sf):
    m = table(spark, sf, "ontology_match").withColumn("iri", F.translate("ontology_id", ":", "_"))
    d, r = K.PREFIX_SCHEMA["treats"]
    arr = lambda xs: F.array(*map(F.lit, xs))
    return m.select("match_id", T.has_prefix(F.col("iri"), arr(d)).alias("in_domain"), T.has_prefix(F.col("iri"), arr(r)).alias("in_range"))


def llm_json_parse(spark, sf):
    """Answers of an extractor rebuilt from stored rows, with talk around the list, and parsed again."""
    e = table(spark, sf, "extracted_relationship")
    row = F.to_json(F.struct("subject", "predicate", "object", F.when(F.col("er_id") % 3 != 0, F.col("confidence")).alias("confidence")))
    answer = F.concat(F.lit("Here you are:\n["), F.coalesce(row, F.lit("")), F.lit("]\nAnything else?"))
    return e.select("er_id", F.explode(T.parse_relations(answer)).alias("r")).select(
        "er_id", "r.subject", "r.predicate", "r.object", "r.confidence", "r.evidence")


def prompts(spark, sf):
    v = table(spark, sf, "verifier_state")
    return v.select("state_id", F.md5(T.extraction_prompt(F.col("original_text"), F.col("lang"))).alias("prompt_md5"))


def query_blocks(spark, sf):
    """Queries in fenced blocks around every predicate, and publication addresses of the documents."""
    e = table(spark, sf, "extracted_relationship").where("predicate is not null")
    talk = F.concat(F.lit("Try ```sparql\nSELECT "), F.col("predicate"), F.lit("``` or ```\nnothing```"))
    return e.select("er_id", F.array_join(T.code_blocks(talk), "|").alias("queries"),
                    F.concat(F.lit("https://example.org/?term="), F.col("document_id"), F.lit("[uid]")).alias("publication"))


def relation_rendering(spark, sf):
    r = table(spark, sf, "relations").where("subject is not null and action is not null and object is not null")
    line = F.concat_ws(" -> ", "subject", "action", "object")
    return r.groupBy("pmid").agg(F.md5(F.array_join(F.sort_array(F.collect_set(line)), "\n")).alias("rendered_md5"), F.count_distinct(line).alias("n"))


QUERIES = {f.__name__: f for f in (strip_citations, normalize_term, index_text, iri_to_curie, biolink_type, eval_normalize, snake_case, term_variants, entity_variants,
                                   tokens, node_text, entity_markers, definition_mining, iri_prefix, llm_json_parse, prompts, query_blocks, relation_rendering)}


def _case(col: str, pairs: dict[str, str], default: str) -> str:
    return "CASE " + col + " " + " ".join("WHEN '{}' THEN '{}'".format(k.replace("'", "''"), v) for k, v in pairs.items()) + f" ELSE {default} END"


_RES = r"trim(regexp_replace(regexp_replace(regexp_replace(lower({0}), '[ \t\n\r\f]*-[ \t\n\r\f]*', '-', 'g'), '[^a-z0-9\- ]+', ' ', 'g'), ' +', ' ', 'g'))"
_ONT = "lower(regexp_extract(ontology_id, '([A-Za-z]+)[:_][0-9]+', 1))"
_EXTRACT = {m: k for k, ms in reversed(list(K.EXTRACTOR_PREDICATES.items())) for m in [k, *ms]}
_CUR = r"""CASE WHEN regexp_matches(x, '^[A-Za-z]+:[0-9]+$') THEN x
 WHEN regexp_matches(x, '([A-Za-z]+)_([0-9]+)$') THEN regexp_extract(x, '([A-Za-z]+)_([0-9]+)$', 1) || ':' || regexp_extract(x, '([A-Za-z]+)_([0-9]+)$', 2)
 WHEN regexp_matches(x, '/obo/([A-Za-z]+)_([0-9]+)') THEN regexp_extract(x, '/obo/([A-Za-z]+)_([0-9]+)', 1) || ':' || regexp_extract(x, '/obo/([A-Za-z]+)_([0-9]+)', 2)
 ELSE x END"""
_LEMMA = r"""array_to_string([CASE WHEN regexp_matches(w, '[a-z]{2}ies$') THEN regexp_replace(w, 'ies$', 'y') WHEN regexp_matches(w, '[a-z]{2}[^siu ]s$') THEN regexp_replace(w, 's$', '') ELSE w END
 FOR w IN string_split_regex(lower(trim(text, ' ')), ' +')], ' ')"""
_STOP = "(" + ", ".join(f"'{w}'" for w in K.STOP_WORDS) + ")"
_ARR = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"

ORACLES = {
    "strip_citations": r"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\(\D*\d{4}(;\D*\d{4})*\)', ' ', 'g'),
 '(\s*)?\(\s*REF\s*\.\s*\d*\s*\)(\s*)?', ' ', 'g'), '(\s*)?\(\s*REFS\s*\.*\s*\d*,*\s*\d*\s*\)(\s*)?', ' ', 'g'), '[\[(]\d+[)\]]', ' ', 'g') AS clean FROM documents""",
    "normalize_term": f"""SELECT rel_id, {_RES.format('subject')} AS subject, {_RES.format('object')} AS object,
 trim(regexp_replace(action, '["''\\\\\\n\\r\\t]+', ' ', 'g'), ' ') AS action FROM relations""",
    "index_text": r"""SELECT entity_id, replace(replace(replace(regexp_replace(trim(regexp_replace(lower(coalesce(text, '')), '[ \t\n\r\f]+', ' ', 'g')), '[^\p{L}\p{N}_ .\-]', '', 'g'),
 'α', 'alpha'), 'β', 'beta'), 'γ', 'gamma') AS indexed FROM stored_entity""",
    "iri_to_curie": f"SELECT {_CUR} AS curie, count(*) AS n FROM (SELECT trim(regexp_replace(unnest(parents), '[<>]', '', 'g')) AS x FROM ontology_match) GROUP BY 1",
    "biolink_type": f"""SELECT match_id, CASE WHEN o = 'go' THEN CASE WHEN n LIKE '%process%' OR n LIKE '%pathway%' THEN 'BiologicalProcess'
 WHEN n LIKE '%activity%' OR n LIKE '%function%' THEN 'MolecularActivity' WHEN n LIKE '%component%' OR n LIKE '%complex%' THEN 'CellularComponent' ELSE 'BiologicalProcess' END
 ELSE {_case('o', K.BIOLINK_BY_ONTOLOGY, "'NamedThing'")} END AS type,
 CASE WHEN biolink_type = 'Disease' THEN coalesce(o IN ('mondo', 'doid'), true) ELSE coalesce(o = 'go', true) END AS accepted
 FROM (SELECT *, {_ONT} AS o, lower(coalesce(canonical_name, '')) AS n FROM ontology_match)""",
    "eval_normalize": f"""SELECT er_id, {_case("translate(trim(lower(subject)), '-_', '  ')", K.ENTITY_ABBREVIATIONS, "translate(trim(lower(subject)), '-_', '  ')")} AS subject,
 {_case("regexp_replace(trim(lower(predicate)), '[ -]', '_', 'g')", K.EVAL_PREDICATES, "regexp_replace(trim(lower(predicate)), '[ -]', '_', 'g')")} AS predicate,
 {_case("predicate", _EXTRACT, "predicate")} AS standard FROM extracted_relationship""",
    "snake_case": r"""SELECT er_id, regexp_replace(lower(regexp_replace(regexp_replace(regexp_replace(predicate, '[ \t\n\r\f]+', '_', 'g'), '([a-zA-Z])([A-Z][a-z]+)', '\1_\2', 'g'),
 '([a-z0-9])([A-Z])', '\1_\2', 'g')), '^([^-]*)-([a-zA-Z0-9_]*).*$', '\1_\2') AS name FROM extracted_relationship""",
    "term_variants": r"""WITH w AS (SELECT ontology_id, canonical_name AS c, list_filter(regexp_extract_all(canonical_name, '[A-Za-z0-9_]+'), lambda x: regexp_matches(x, '^[A-Za-z]+$')) AS ws,
 trim(regexp_replace(canonical_name, '[ \t\n\r\f]*\([^)]*\)', '', 'g')) AS bare FROM canonical_terms),
 i AS (SELECT *, array_to_string([x[1] FOR x IN ws], '') AS ini FROM w)
 SELECT ontology_id, unnest(list_filter([CASE WHEN len(ws) > 1 THEN upper(ini) END, CASE WHEN len(ws) BETWEEN 2 AND 4 THEN lower(ini) END,
 CASE WHEN c LIKE '%s' AND length(c) > 3 THEN c[1:length(c) - 1] WHEN c NOT LIKE '%s' THEN c || 's' END, CASE WHEN bare <> c THEN bare END,
 CASE WHEN contains(c, '-') THEN replace(c, '-', ' ') END, CASE WHEN contains(c, '-') THEN replace(c, '-', '') END], lambda v: v IS NOT NULL)) AS variant FROM i""",
    "entity_variants": rf"""WITH b AS (SELECT entity_id, text, {_LEMMA} AS lemma, regexp_extract_all(text, '[a-zA-Z]*\([a-zA-Z]*\)') AS gs FROM stored_entity WHERE text IS NOT NULL),
 v AS (SELECT entity_id, list_distinct([lemma, array_to_string(list_filter(string_split_regex(trim(lemma, ' '), ' +'), lambda w: lower(w) NOT IN {_STOP}), ' '),
 CASE WHEN len(gs) > 0 THEN array_to_string(list_filter(flatten([string_split(regexp_replace(g, '\)$', ''), '(') FOR g IN gs]), lambda w: w <> ''), '-') ELSE text END,
 trim(regexp_replace(regexp_replace(text, '[!-/:-@\[-`{{-~]+', ' ', 'g'), ' +', ' ', 'g'))]) AS vs FROM b)
 SELECT entity_id, unnest(list_filter(vs, lambda x: x <> '')) AS variant FROM v""",
    "tokens": "SELECT token, count(*) AS n_docs FROM (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS token FROM documents) GROUP BY token",
    "node_text": """SELECT match_id, coalesce(array_to_string(list_filter(list_concat(list_concat([canonical_name], coalesce(synonyms, [])), [definition]),
 lambda x: x IS NOT NULL AND x <> ''), ' . '), '') AS text FROM ontology_match""",
    "entity_markers": r"""WITH b AS (SELECT er_id, evidence_text AS t, subject AS s, object AS o, instr(evidence_text, subject) AS a, instr(evidence_text, object) AS c
 FROM extracted_relationship WHERE evidence_text IS NOT NULL AND subject IS NOT NULL AND object IS NOT NULL),
 x AS (SELECT er_id, CASE
 WHEN a > 0 AND c > 0 AND a + length(s) <= c THEN t[1:a-1] || '[E1]' || s || '[/E1]' || t[a+length(s):c-1] || '[E2]' || o || '[/E2]' || t[c+length(o):]
 WHEN a > 0 AND c > 0 AND c + length(o) <= a THEN t[1:c-1] || '[E2]' || o || '[/E2]' || t[c+length(o):a-1] || '[E1]' || s || '[/E1]' || t[a+length(s):]
 WHEN a > 0 THEN t[1:a-1] || '[E1]' || s || '[/E1]' || t[a+length(s):] WHEN c > 0 THEN t[1:c-1] || '[E2]' || o || '[/E2]' || t[c+length(o):] ELSE t END AS marked FROM b)
 SELECT er_id, marked, coalesce(list_position([starts_with(w, '[E1]') FOR w IN string_split_regex(marked, '[ \t\n\r]+')], true), 0)::BIGINT AS e1_token,
 coalesce(list_position([starts_with(w, '[E2]') FOR w IN string_split_regex(marked, '[ \t\n\r]+')], true), 0)::BIGINT AS e2_token FROM x""",
    "definition_mining": """SELECT match_id, context FROM (SELECT match_id, CASE """ + " ".join(
        f"WHEN regexp_extract(definition, '(?i){p} (.+?)[.,]', 1) <> '' THEN '{p} ' || regexp_extract(definition, '(?i){p} (.+?)[.,]', 1)"
        for p in ("characterized by", "caused by", "results in", "associated with")) + " END AS context FROM ontology_match)",
    "iri_prefix": f"""SELECT match_id, len(list_filter({_ARR(K.PREFIX_SCHEMA['treats'][0])}, lambda p: contains(iri, p))) > 0 AS in_domain,
 len(list_filter({_ARR(K.PREFIX_SCHEMA['treats'][1])}, lambda p: contains(iri, p))) > 0 AS in_range FROM (SELECT match_id, translate(ontology_id, ':', '_') AS iri FROM ontology_match)""",
    "llm_json_parse": """SELECT er_id, trim(subject) AS subject, trim(predicate) AS predicate, trim(object) AS object, CASE WHEN er_id % 3 <> 0 THEN coalesce(confidence, 0.5) ELSE 0.5 END AS confidence,
 '' AS evidence FROM extracted_relationship WHERE subject IS NOT NULL AND predicate IS NOT NULL AND object IS NOT NULL""",
    "prompts": r"""SELECT state_id, md5(e'List the relations stated in the text as a JSON list of subject, predicate, object, confidence and evidence.\n\nText: ' || original_text ||
 CASE WHEN lang IS NULL THEN '' ELSE e'\n\nAdditional context: ' || lang END) AS prompt_md5 FROM verifier_state""",
    "query_blocks": """SELECT er_id, 'SELECT ' || predicate AS queries, 'https://example.org/?term=' || document_id || '[uid]' AS publication FROM extracted_relationship WHERE predicate IS NOT NULL""",
    "relation_rendering": r"""SELECT pmid, md5(array_to_string(list_sort(list_distinct(list(l))), e'\n')) AS rendered_md5, count(DISTINCT l) AS n
 FROM (SELECT pmid, subject || ' -> ' || action || ' -> ' || object AS l FROM relations WHERE subject IS NOT NULL AND action IS NOT NULL AND object IS NOT NULL) GROUP BY pmid""",
}
