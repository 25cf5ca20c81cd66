"""Extraction, mapping, verification, sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillgraph.functions import constants as K
from quillgraph.functions import text as T
from quillgraph.operators import graph as G
from quillgraph.operators import relations as R
from quillgraph.operators import verification as V
from quillgraph.operators.hierarchy import curie
from quillgraph.operators.subgraph import latent_subgraph as build_subgraph
from quillgraph.plans.graph_queries import _ID, _NORM, GRAPH, LIT
from quillgraph.plans.tables import table
from quillgraph.plans.text_queries import _LEMMA, _STOP, _case
from quillgraph.sinks.merge import flatten_graph, upsert
from quillgraph.sources import bioc, html_pages, obo, star
from quillgraph.streaming.ingest import unseen


def _xml(c):
    c = F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return F.replace(c, F.lit('"'), F.lit("&quot;"))


def svo_extract(spark, sf):
    """Subject-verb-object relations from the token trees of the stored relations."""
    r = table(spark, sf, "relations").where("subject is not null and action is not null and object is not null").withColumn("doc_id", F.col("rel_id"))
    tok = lambda i, text, pos, dep, head, ent: F.struct(F.lit(i).alias("i"), F.col(text).alias("text") if text != "not" else F.lit("not").alias("text"), F.lit(pos).alias("pos"), F.lit(dep).alias("dep"),
                                                       F.lit(head).alias("head_i"), F.lit(ent).alias("ent_type"))
    base = F.array(tok(1, "subject", "NOUN", "nsubj", 2, "ENTITY"), tok(2, "action", "VERB", "ROOT", 2, ""), tok(3, "object", "NOUN", "dobj", 2, "ENTITY"))
    full = F.when(F.coalesce("negation", F.lit(False)), F.concat(base, F.array(tok(4, "not", "PART", "neg", 2, "")))).otherwise(base)
    tokens = r.select("doc_id", F.lit(0).alias("sent_id"), F.explode(full).alias("t")).select("doc_id", "sent_id", "t.*")
    return R.extract_svo(tokens).select(F.col("doc_id").alias("rel_id"), "subject", "action", "object", "negation")


def bio_chunks(spark, sf):
    """Chunks of the words of every canonical name; the word "type" is outside."""
    c = table(spark, sf, "canonical_terms").select(F.col("ontology_id").alias("doc_id"), F.lit(0).alias("sent_id"), F.posexplode(F.split("canonical_name", " ")).alias("i", "base"))
    tag = F.when(F.col("base") == "type", "O").when((F.col("i") == 0) | F.col("base").rlike("^[0-9]+$"), "B-NP").otherwise("I-NP")
    return R.bio_chunks(c.withColumn("tag", tag)).select(F.col("doc_id").alias("ontology_id"), F.col("chunk_no").cast("long"), "chunk")


def _concepts(spark, sf):
    r = table(spark, sf, "relations").where("rel_id % 50 = 0 and subject is not null and trim(subject) <> ''")
    return r.select(F.col("rel_id").alias("concept_id"), F.trim("subject").alias("trigger"))


def concept_alignment(spark, sf):
    s = table(spark, sf, "extracted_relationship").where("evidence_text is not null").select(F.col("er_id").alias("sent_id"), F.col("evidence_text").alias("sentence"))
    return R.align_concepts(s, _concepts(spark, sf))


def phrase_match(spark, sf):
    t = table(spark, sf, "extracted_relationship").where("evidence_text is not null").select(F.col("er_id").alias("id"), F.col("evidence_text").alias("text"))
    return R.phrase_matches(t, _concepts(spark, sf).select(F.col("concept_id").alias("phrase_id"), F.col("trigger").alias("phrase"))).select("id", "phrase_id", F.col("start").cast("long"))


def _mapped(spark, sf):
    r = table(spark, sf, "relations")
    mentions = r.select(F.col("subject").alias("mention")).union(r.select("object"))
    return R.ontology_lookup(mentions, star.nodes(spark, sf), G.degrees(star.edges(spark, sf)))


def ontology_lookup(spark, sf):
    return _mapped(spark, sf).select("mention", "id", F.col("score").cast("long"))


def resolved_relations(spark, sf):
    r = table(spark, sf, "relations").select("rel_id", "subject", "object")
    return R.resolved_relations(r, _mapped(spark, sf))


def association_type(spark, sf):
    """Association of every parent and child by their classes."""
    n = star.nodes(spark, sf).select("id", F.coalesce("biolink_type", F.lit("NamedThing")).alias("c"))
    e = star.edges(spark, sf).join(n.select(F.col("id").alias("src"), F.col("c").alias("sc")), "src").join(n.select(F.col("id").alias("dst"), F.col("c").alias("dc")), "dst")
    return e.select("src", "dst", R.association_type(F.col("sc"), F.col("dc")).alias("association"))


def class_mapping(spark, sf):
    n = star.nodes(spark, sf)
    return n.select("id", R.class_of(F.split_part("id", F.lit(":"), F.lit(1)), F.when(F.col("biolink_type") == "BiologicalProcess", "biological_process")).alias("class"))


def entity_resolver(spark, sf):
    terms = _concepts(spark, sf).select(F.col("trigger").alias("term")).distinct()
    n = star.nodes(spark, sf)
    labels = n.where("name is not null").select(F.col("id").alias("entity"), F.col("name").alias("label")).union(n.select("id", F.explode("synonyms")))
    return V.resolve_entities(terms, labels)


_norm = lambda c: F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " "))


def _evidence(spark, sf):
    """Stored extractions against the literature graph, predicates in standard form."""
    e = table(spark, sf, "extracted_relationship").select(F.col("er_id").alias("rel_id"), F.nullif(_norm("subject"), F.lit("")).alias("s"), F.nullif(_norm("object"), F.lit("")).alias("o"),
                                                          _norm("predicate").alias("p"))
    t = star.literature(spark, sf).select(F.col("src").alias("s"), F.col("relation").alias("p"), F.col("dst").alias("o"))
    sub = spark.createDataFrame([(m, k) for k, ms in K.EXTRACTOR_PREDICATES.items() for m in ms], "child string, parent string")
    names = t.select(F.col("s").alias("entity")).union(t.select("o")).distinct()
    return e, V.evidence(e, t, sub, names.select("entity", F.col("entity").alias("label")))


def evidence_hits(spark, sf):
    return _evidence(spark, sf)[1]


def evidence_score(spark, sf):
    return V.evidence_score(_evidence(spark, sf)[1]).select("rel_id", F.round("score", 9).alias("score"))


def ontology_verdict(spark, sf):
    """Direction of every link between terms for every predicate with a schema, by identifier prefixes."""
    e = star.edges(spark, sf).select("src", "dst", F.explode(F.array(*map(F.lit, K.PREFIX_SCHEMA))).alias("predicate"), F.translate("src", ":", "_").alias("s_iri"), F.translate("dst", ":", "_").alias("o_iri"))
    return V.verdict(e).select("src", "dst", "predicate", "subject_in_domain", "object_in_range", "direction_ok")


def verify_relations(spark, sf):
    e, ev = _evidence(spark, sf)
    ids = star.nodes(spark, sf).where("name is not null").select(_norm("name").alias("t"), "id").groupBy("t").agg(F.min("id").alias("id"))
    d = e.join(ids.select(F.col("t").alias("s"), F.translate("id", ":", "_").alias("s_iri")), "s", "left").join(ids.select(F.col("t").alias("o"), F.translate("id", ":", "_").alias("o_iri")), "o", "left")
    d = V.verdict(d.withColumn("predicate", T.extractor_predicate(F.col("p")))).withColumn("known", F.col("s_iri").isNotNull() & F.col("o_iri").isNotNull() & F.col("predicate").isin(list(K.PREDICATE_RO)))
    scored = V.decide(V.evidence_score(ev).join(d.select("rel_id", "direction_ok", "known"), "rel_id"))
    return scored.select("rel_id", F.round("final_score", 9).alias("score"), "decision", F.col("attempts").cast("long"), "explanation")


def infer_relations(spark, sf):
    t = star.literature(spark, sf).select(F.col("src").alias("s"), F.col("relation").alias("p"), F.col("dst").alias("o"))
    return V.infer_relations(t)


def prefix_schema(spark, sf):
    """Schemas from links between terms, the child's prefix as property and the parent as restriction filler."""
    e = star.edges(spark, sf).select(F.concat(F.lit("associated_"), F.split_part("dst", F.lit(":"), F.lit(1))).alias("prop"), F.concat(F.lit("http://x/"), F.translate("src", ":", "_")).alias("on_class"))
    half = e.withColumn("prop", F.when(F.col("prop").isin("associated_GO", "associated_HP"), F.col("prop")).otherwise(F.replace("prop", F.lit("associated_"), F.lit("has_"))))
    return V.prefix_schema(half).select("prop", F.array_join("domain_prefixes", "|").alias("domain_prefixes"), F.array_join("range_prefixes", "|").alias("range_prefixes"))


def latent_subgraph(spark, sf):
    """Subgraph around a fixed question."""
    return build_subgraph("moderate glucose uptake in the liver after chronic nephropathy and cytokine release", ["glucose uptake", "nephropathy", "cytokine release"],
                          star.nodes(spark, sf), star.edges(spark, sf)).select("src", "dst", F.round("weight", 6).alias("weight"), "src_source", "dst_source")


def _bioc_docs(spark, sf):
    """The evaluation rows as BioC documents, parsed back."""
    r = table(spark, sf, "results_bioc").where("abstract is not null and entity1 is not null and entity2 is not null and relation is not null")
    ann = lambda n, e, off: F.concat(F.lit(f'<annotation id="{n}"><infon key="identifier">'), _xml(F.col(e)), F.lit('</infon><infon key="type">Entity'), F.lit(f'{n}</infon><infon key="MESH">'), _xml(F.col(e)),
                                     F.lit('</infon><location offset="'), off.cast("string"), F.lit('" length="'), F.length(e).cast("string"), F.lit('"/><text>'), _xml(F.col(e)), F.lit("</text></annotation>"))
    text = F.regexp_replace("abstract", r"[\x00-\x1f]", " ")
    doc = F.concat(F.lit("<document><id>"), _xml(F.col("document_id")), F.lit("</id><passage><offset>0</offset><text>"), F.lit("Title"), F.lit("</text></passage><passage><offset>6</offset><text>"), _xml(text), F.lit("</text>"),
                   ann(1, "entity1", F.lit(6)), ann(2, "entity2", F.lit(6) + F.length("entity1")), F.lit("</passage><relation id=\"R1\"><infon key=\"entity1\">"), _xml(F.col("entity1")), F.lit("</infon><infon key=\"entity2\">"),
                   _xml(F.col("entity2")), F.lit("</infon><infon key=\"type\">"), _xml(F.col("relation")), F.lit("</infon><infon key=\"novel\">Novel</infon><infon key=\"Chemical\">"), _xml(F.col("entity1")),
                   F.lit("</infon><infon key=\"Disease\">"), _xml(F.col("entity2")), F.lit("</infon></relation></document>"))
    return r.select(bioc.parse_bioc(doc).alias("d")).select("d.*")


def bioc_parse(spark, sf):
    return bioc.annotations(_bioc_docs(spark, sf)).select(F.trim("doc_id").alias("doc_id"), F.col("type"), "text", "start", "stop")


def bioc_stats(spark, sf):
    return bioc.statistics(_bioc_docs(spark, sf))


def bioc_relations(spark, sf):
    return bioc.relations(_bioc_docs(spark, sf)).groupBy("type", "novel").agg(F.count("*").alias("n"))


def cdr_gold(spark, sf):
    return bioc.mesh_pairs(_bioc_docs(spark, sf)).distinct().groupBy(F.trim("pmid").alias("pmid")).agg(F.count("*").alias("n_pairs"))


def html_paragraphs(spark, sf):
    """Documents as publisher pages (navigation, script and style around them), parsed back."""
    d = table(spark, sf, "documents")
    paras = F.array_join(F.transform(F.split("text", "\n"), lambda p: F.concat(F.lit("<p>"), _xml(p), F.lit("</p>"))), "")
    page = F.concat(F.lit("<html><head><title>x</title><style>p{}</style><script>var a='</p><p>no';</script></head><body><nav><p>menu</p></nav><h1>"), _xml(F.coalesce("title", F.lit(""))),
                    F.lit("</h1><p>This page requires JavaScript to run.</p>"), paras, F.lit("<h2>References</h2><p>not this</p></body></html>"))
    got = html_pages.read_pages(d.select("doc_id", page.alias("html")), "html", "default", "doc_id")
    squeezed = F.regexp_replace(F.array_join("paragraphs", ""), r"[\s\p{Z}\x1c-\x1f\x85]+", "")
    return got.select("doc_id", F.regexp_replace(F.trim("title"), r"\s+", " ").alias("title"), F.md5(squeezed).alias("text_md5"))


def obo_terms(spark, sf):
    """Terms as OBO stanzas, parsed back to links."""
    n = star.nodes(spark, sf)
    up = star.edges(spark, sf).groupBy(F.col("dst").alias("id")).agg(F.array_join(F.transform(F.sort_array(F.collect_set("src")), lambda s: F.concat(F.lit("is_a: "), s)), "\n").alias("isa"))
    syn = F.array_join(F.transform("synonyms", lambda s: F.concat(F.lit('synonym: "'), s, F.lit('" EXACT []'))), "\n")
    stanza = F.concat_ws("\n", F.lit("[Term]"), F.concat(F.lit("id: "), "id"), F.concat(F.lit("name: "), "name"), syn, "isa")
    terms = obo.parse_terms(n.join(up, "id", "left").select(stanza.alias("stanza")), F.lit("x"))
    return terms.select("id", "name", F.size("synonyms").cast("long").alias("n_synonyms"), F.array_join("is_a", "|").alias("is_a"))


def kg_merge(spark, sf):
    """Term rows with even ids merged with those with odd ids: last name per term."""
    m = table(spark, sf, "ontology_match").select(curie(F.col("ontology_id")).alias("id"), F.col("canonical_name").alias("name"), "match_id")
    old = upsert(None, m.where("match_id % 2 = 0"), ["id"], [F.col("match_id")])
    return upsert(old, m.where("match_id % 2 = 1"), ["id"], [F.col("match_id")])


def kg_flatten(spark, sf):
    r = table(spark, sf, "relations").where("subject is not null and object is not null and action is not null")
    located = r.select(F.col("subject").alias("name"), "pmid").union(r.select("object", "pmid"))
    links = table(spark, sf, "extracted_relationship").select("subject", "predicate", "object").distinct()
    return flatten_graph(located, links)


def unseen_documents(spark, sf):
    """Relations of publications without a stored document."""
    r = table(spark, sf, "relations").where("pmid is not null").select("rel_id", "pmid")
    return unseen(r, table(spark, sf, "documents").where("pmid is not null").select("pmid"), "pmid").select("rel_id", "pmid")


QUERIES = {f.__name__: f for f in (svo_extract, bio_chunks, concept_alignment, phrase_match, ontology_lookup, resolved_relations, association_type, class_mapping, entity_resolver,
                                   evidence_hits, evidence_score, ontology_verdict, verify_relations, infer_relations, prefix_schema, latent_subgraph, bioc_parse, bioc_stats,
                                   bioc_relations, cdr_gold, html_paragraphs, obo_terms, kg_merge, kg_flatten, unseen_documents)}

_CON = "con AS (SELECT rel_id AS concept_id, trim(subject, ' ') AS tr FROM relations WHERE rel_id % 50 = 0 AND subject IS NOT NULL AND trim(subject, ' ') <> '')"
_IN = lambda c, xs: f"{c} IN (" + ", ".join(f"'{x}'" for x in xs) + ")"
_ASSOC = "CASE " + " ".join(f"WHEN {_IN('sc', s)} AND {_IN('dc', o)} THEN '{n}'" for n, s, o in K.ASSOCIATIONS) + " ELSE 'Association' END"
_CLASS = "CASE " + " ".join(f"WHEN coalesce({_IN('pre', r)}, false) OR coalesce({_IN('ns', r)}, false) THEN '{n}'" for n, r in sorted(K.CLASS_TABLE, key=lambda x: -len(x[1]))) + " ELSE 'NamedThing' END"
_SUB = "(VALUES " + ", ".join(f"('{m}', '{k}')" for k, ms in K.EXTRACTOR_PREDICATES.items() for m in ms) + ") sp(child, parent)"
_HITS = lambda c: f"CASE WHEN {c} > 0 THEN least(0.85, 0.4 + {c} / 20.0) WHEN {c} = 0 THEN 0.15 END"
_EV = f"""{LIT}, x AS (SELECT er_id AS rel_id, nullif({_NORM.format('subject')}, '') AS s, nullif({_NORM.format('object')}, '') AS o, {_NORM.format('predicate')} AS p FROM extracted_relationship),
 pr AS MATERIALIZED (SELECT DISTINCT s, o FROM x WHERE s IS NOT NULL AND o IS NOT NULL), ln AS MATERIALIZED (SELECT src, dst, count(*) AS n FROM lit GROUP BY 1, 2),
 tw AS (SELECT pr.s, pr.o, least(sum(a.n * b.n), 200) AS n FROM pr JOIN ln a ON a.src = pr.s JOIN ln b ON b.src = a.dst AND b.dst = pr.o WHERE a.dst <> pr.o AND a.dst <> pr.s GROUP BY 1, 2),
 nd AS (SELECT src AS e FROM lit UNION SELECT dst FROM lit), tx AS (SELECT s AS q FROM pr UNION SELECT o FROM pr), nm AS MATERIALIZED (SELECT q, e FROM tx JOIN nd ON contains(e, q)),
 sl AS MATERIALIZED (SELECT q, dst AS mid, sum(n) AS n FROM nm JOIN ln ON src = e GROUP BY 1, 2), ol AS MATERIALIZED (SELECT q, src AS mid, sum(n) AS n FROM nm JOIN ln ON dst = e GROUP BY 1, 2),
 fl AS (SELECT pr.s, pr.o, least(sum(ln.n), 120) AS n FROM ln JOIN nm a ON a.e = src JOIN nm b ON b.e = dst JOIN pr ON pr.s = a.q AND pr.o = b.q GROUP BY 1, 2),
 tl AS (SELECT pr.s, pr.o, least(sum(sl.n * ol.n), 200) AS n FROM pr JOIN sl ON sl.q = pr.s JOIN ol ON ol.q = pr.o AND ol.mid = sl.mid GROUP BY 1, 2),
 ev AS (SELECT rel_id, CASE WHEN h THEN EXISTS (SELECT 1 FROM lit WHERE src = s AND dst = o AND relation = p) END AS exact,
  CASE WHEN h THEN EXISTS (SELECT 1 FROM lit LEFT JOIN {_SUB} ON child = relation WHERE src = s AND dst = o AND (relation = p OR parent = p)) END AS subproperty,
  CASE WHEN h THEN coalesce(tw.n, 0)::BIGINT END AS twohop, CASE WHEN h THEN coalesce(fl.n, 0)::BIGINT END AS flexible, CASE WHEN h THEN coalesce(tl.n, 0)::BIGINT END AS twohop_label
  FROM (SELECT *, s IS NOT NULL AND o IS NOT NULL AS h FROM x) LEFT JOIN tw USING (s, o) LEFT JOIN fl USING (s, o) LEFT JOIN tl USING (s, o)),
 sc AS (SELECT *, coalesce(greatest(CASE WHEN exact THEN 0.95 WHEN NOT exact THEN 0.2 END, CASE WHEN subproperty THEN 0.95 WHEN NOT subproperty THEN 0.2 END, {_HITS('twohop')}, {_HITS('flexible')}, {_HITS('twohop_label')}), 0)::DOUBLE AS score FROM ev)"""
_EXT = {m: k for k, ms in reversed(list(K.EXTRACTOR_PREDICATES.items())) for m in [k, *ms]}
_PFX = lambda iri, xs: f"len(list_filter([{', '.join(repr(x) for x in xs)}], lambda q: contains({iri}, q))) > 0"
_SCH = lambda iri, k: "CASE pred " + " ".join(f"WHEN '{n}' THEN {_PFX(iri, v[k])}" for n, v in K.PREFIX_SCHEMA.items()) + " END"
_DOCS = "b AS (SELECT trim(document_id, ' ') AS d, entity1, entity2, relation FROM results_bioc WHERE abstract IS NOT NULL AND entity1 IS NOT NULL AND entity2 IS NOT NULL AND relation IS NOT NULL)"
_FORMS = rf"""men AS (SELECT DISTINCT text FROM (SELECT subject AS text FROM relations UNION ALL SELECT object FROM relations) WHERE text IS NOT NULL),
 mv AS (SELECT text, {_LEMMA} AS lemma, regexp_extract_all(text, '[a-zA-Z]*\([a-zA-Z]*\)') AS gs FROM men),
 fo AS (SELECT DISTINCT text AS mention, lower(trim(f, ' ')) AS form FROM (SELECT text, unnest(list_concat([text], list_filter([lemma, array_to_string(list_filter(string_split_regex(trim(lemma, ' '), ' +'), lambda w: lower(w) NOT IN {_STOP}), ' '),
  CASE WHEN len(gs) > 0 THEN array_to_string(list_filter(flatten([string_split(regexp_replace(g, '\)$', ''), '(') FOR g IN gs]), lambda w: w <> ''), '-') ELSE text END,
  trim(regexp_replace(regexp_replace(text, '[!-/:-@\[-`{{-~]+', ' ', 'g'), ' +', ' ', 'g'), ' ')], lambda v: v <> ''))) AS f FROM mv)),
 la AS (SELECT DISTINCT id, lower(trim(f, ' ')) AS form FROM (SELECT id, unnest(list_concat([name], synonyms)) AS f FROM n) WHERE f IS NOT NULL),
 dg AS (SELECT id, count(*) AS degree FROM (SELECT src AS id FROM e UNION ALL SELECT dst FROM e) GROUP BY id),
 mp AS (SELECT mention, id, CAST({_case("split_part(id, ':', 1)", {k: str(v) for k, v in K.MAPPING_WEIGHTS.items()}, "'1'")} AS BIGINT) * degree AS score FROM (SELECT DISTINCT mention, la.id FROM fo JOIN la USING (form)) JOIN dg USING (id))"""

ORACLES = {
    "svo_extract": "SELECT rel_id, subject, action, object, coalesce(negation, false) AS negation FROM relations WHERE subject IS NOT NULL AND action IS NOT NULL AND object IS NOT NULL",
    "bio_chunks": """WITH w AS (SELECT ontology_id, unnest(string_split(canonical_name, ' ')) AS b, generate_subscripts(string_split(canonical_name, ' '), 1) AS i FROM canonical_terms),
 t AS (SELECT *, CASE WHEN b = 'type' THEN 'O' WHEN i = 1 OR regexp_matches(b, '^[0-9]+$') THEN 'B' ELSE 'I' END AS tag FROM w), c AS (SELECT *, sum(CASE WHEN tag = 'B' THEN 1 ELSE 0 END) OVER (PARTITION BY ontology_id ORDER BY i) AS k FROM t)
 SELECT ontology_id, CAST(k AS BIGINT) AS chunk_no, string_agg(b, ' ' ORDER BY i) AS chunk FROM c WHERE tag <> 'O' AND k > 0 GROUP BY ontology_id, k""",
    "concept_alignment": f"WITH {_CON} SELECT DISTINCT er_id AS sent_id, concept_id FROM extracted_relationship, con WHERE contains(lower(evidence_text), lower(tr))",
    "phrase_match": rf"""WITH {_CON}, p AS (SELECT concept_id, regexp_extract_all(lower(tr), '[\p{{L}}\p{{N}}]+') AS w FROM con), t AS (SELECT er_id, regexp_extract_all(lower(evidence_text), '[\p{{L}}\p{{N}}]+') AS w FROM extracted_relationship WHERE evidence_text IS NOT NULL),
 s AS (SELECT er_id, w, unnest(range(len(w))) AS i FROM t) SELECT er_id AS id, concept_id AS phrase_id, i AS start FROM s JOIN p ON len(p.w) > 0 AND s.w[i + 1] = p.w[1] AND s.w[i + 1:i + len(p.w)] = p.w""",
    "ontology_lookup": f"WITH RECURSIVE {GRAPH}, {_FORMS} SELECT mention, id, score FROM mp",
    "resolved_relations": f"""WITH RECURSIVE {GRAPH}, {_FORMS}, be AS (SELECT mention, max_by(id, (score, id)) AS id FROM mp GROUP BY mention)
 SELECT rel_id, a.id AS subject_id, b.id AS object_id FROM relations JOIN be a ON a.mention = subject JOIN be b ON b.mention = object""",
    "association_type": f"""WITH RECURSIVE {GRAPH}, c AS (SELECT id, coalesce(biolink_type, 'NamedThing') AS c FROM n), j AS (SELECT src, dst, a.c AS sc, b.c AS dc FROM e JOIN c a ON a.id = src JOIN c b ON b.id = dst)
 SELECT src, dst, {_ASSOC} AS association FROM j""",
    "class_mapping": f"WITH RECURSIVE {GRAPH}, c AS (SELECT id, split_part(id, ':', 1) AS pre, CASE WHEN biolink_type = 'BiologicalProcess' THEN 'biological_process' END AS ns FROM n) SELECT id, {_CLASS} AS class FROM c",
    "entity_resolver": f"""WITH RECURSIVE {GRAPH}, {_CON}, lb AS (SELECT id, lower(f) AS l FROM (SELECT id, unnest(list_concat([name], synonyms)) AS f FROM n) WHERE f IS NOT NULL), q AS (SELECT DISTINCT tr AS term, lower(tr) AS q FROM con),
 d AS (SELECT q, min(id) AS id FROM (SELECT DISTINCT q FROM q), lb WHERE contains(l, q) GROUP BY q), r AS (SELECT DISTINCT q, list_filter(string_split_regex(q, '[^a-z0-9]+'), lambda w: w <> '') AS w FROM q WHERE q NOT IN (SELECT q FROM d)),
 f AS (SELECT q, min(id) AS id FROM r, lb WHERE len(w) > 1 AND len(list_filter(w, lambda x: NOT contains(l, x))) = 0 GROUP BY q) SELECT DISTINCT term, id AS entity FROM q JOIN (SELECT * FROM d UNION ALL SELECT * FROM f) USING (q)""",
    "evidence_hits": f"WITH {_EV} SELECT rel_id, exact, subproperty, twohop, flexible, twohop_label FROM ev",
    "evidence_score": f"WITH {_EV} SELECT rel_id, round(score, 9) AS score FROM sc",
    "ontology_verdict": f"""WITH RECURSIVE {GRAPH}, k AS (SELECT *, translate(src, ':', '_') AS si, translate(dst, ':', '_') AS oi FROM e, (SELECT unnest({list(K.PREFIX_SCHEMA)}) AS pred)),
 v AS (SELECT src, dst, pred, ({_SCH('si', 0)}) AS a, ({_SCH('oi', 1)}) AS b FROM k)
 SELECT src, dst, pred AS predicate, a AS subject_in_domain, b AS object_in_range, a AND b AS direction_ok FROM v""",
    "verify_relations": f"""WITH RECURSIVE {GRAPH}, {_EV}, ids AS (SELECT {_NORM.format('name')} AS t, translate(min(id), ':', '_') AS iri FROM n WHERE name IS NOT NULL GROUP BY 1),
 j AS (SELECT sc.*, a.iri AS si, b.iri AS oi, {_case('x.p', _EXT, 'x.p')} AS pred FROM sc JOIN x USING (rel_id) LEFT JOIN ids a ON a.t = x.s LEFT JOIN ids b ON b.t = x.o),
 k AS (SELECT *, coalesce(si IS NOT NULL AND oi IS NOT NULL AND {_IN('pred', K.PREDICATE_RO)}, false) AND coalesce(({_SCH('si', 0)}) AND ({_SCH('oi', 1)}), false) AS cons FROM j),
 f AS (SELECT *, CASE WHEN cons THEN greatest(score, 0.9) ELSE score END AS fs FROM k)
 SELECT rel_id, round(fs, 9) AS score, CASE WHEN cons OR fs >= 0.7 THEN 'accept' ELSE 'reject' END AS decision, CAST(CASE WHEN cons OR fs >= 0.7 THEN 0 ELSE 2 END AS BIGINT) AS attempts,
 CASE WHEN cons THEN 'typing consistent' WHEN coalesce(exact, false) THEN 'exact statement found' ELSE 'unsupported' END AS explanation FROM f""",
    "infer_relations": f"""WITH {LIT}, r AS (SELECT DISTINCT a.src AS s, 'association' AS p, b.dst AS o FROM lit a JOIN lit b ON a.dst = b.src WHERE a.relation = 'treats' AND b.relation = 'causes' AND a.src <> b.dst)
 SELECT s, p, o FROM r WHERE (s, p, o) NOT IN (SELECT src, relation, dst FROM lit)""",
    "prefix_schema": f"""WITH RECURSIVE {GRAPH}, a AS (SELECT CASE WHEN split_part(dst, ':', 1) IN ('GO', 'HP') THEN 'associated_' ELSE 'has_' END || split_part(dst, ':', 1) AS prop, split_part(src, ':', 1) || '_' AS root, translate(src, ':', '_') AS c FROM e),
 g AS (SELECT prop, contains(prop, 'associated') AS sym, list_distinct(list(root) FILTER ({_PFX('c', K.CHEMICAL_MARKS)})) AS d, list_distinct(list(root) FILTER ({_PFX('c', K.CHEMICAL_MARKS + K.RANGE_MARKS)})) AS r FROM a GROUP BY prop)
 SELECT prop, array_to_string(list_sort(CASE WHEN sym THEN list_distinct(list_concat(coalesce(d, []), {K.SYMMETRIC_MARKS})) ELSE coalesce(d, []) END), '|') AS domain_prefixes,
 array_to_string(list_sort(CASE WHEN sym THEN list_distinct(list_concat(coalesce(r, []), {K.SYMMETRIC_MARKS})) ELSE coalesce(r, []) END), '|') AS range_prefixes FROM g""",
    "bioc_parse": f"WITH {_DOCS} SELECT d AS doc_id, 'Entity1' AS type, entity1 AS text, 6::BIGINT AS start, 6 + length(entity1) AS stop FROM b UNION ALL SELECT d, 'Entity2', entity2, 6 + length(entity1), 6 + length(entity1) + length(entity2) FROM b",
    "bioc_stats": f"""WITH {_DOCS} SELECT 'documents' AS measure, '' AS key, count(*) AS n FROM b UNION ALL SELECT 'relations', '', count(*) FROM b UNION ALL SELECT 'entities', '', 2 * count(*) FROM b
 UNION ALL SELECT 'relation_type', relation, count(*) FROM b GROUP BY relation UNION ALL SELECT 'entity_type', k, (SELECT count(*) FROM b) FROM (VALUES ('Entity1'), ('Entity2')) v(k)""",
    "bioc_relations": f"WITH {_DOCS} SELECT relation AS type, true AS novel, count(*) AS n FROM b GROUP BY relation",
    "cdr_gold": f"WITH {_DOCS} SELECT d AS pmid, count(DISTINCT (entity1, entity2)) AS n_pairs FROM b GROUP BY d",
    "html_paragraphs": r"""SELECT doc_id, nullif(trim(regexp_replace(coalesce(title, 'x'), '\s+', ' ', 'g')), '') AS title, md5(regexp_replace(text, '[\s\p{Z}\x1c-\x1f\x{85}]+', '', 'g')) AS text_md5 FROM documents""",
    "obo_terms": f"""WITH RECURSIVE {GRAPH}, u AS (SELECT dst AS id, string_agg(src, '|' ORDER BY src) AS is_a FROM e GROUP BY dst) SELECT n.id, name, len(synonyms) AS n_synonyms, coalesce(is_a, '') AS is_a FROM n LEFT JOIN u USING (id)""",
    "kg_merge": f"""WITH m AS (SELECT {_ID.format('ontology_id')} AS id, canonical_name AS name, match_id FROM ontology_match), r AS (SELECT * FROM m WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY match_id % 2 DESC, match_id DESC) = 1) SELECT id, name, match_id FROM r""",
    "kg_flatten": """WITH l AS (SELECT subject AS n, pmid FROM relations WHERE subject IS NOT NULL AND object IS NOT NULL AND action IS NOT NULL UNION SELECT object, pmid FROM relations WHERE subject IS NOT NULL AND object IS NOT NULL AND action IS NOT NULL)
 SELECT DISTINCT subject, predicate, object, a.pmid FROM extracted_relationship JOIN l a ON a.n = subject JOIN l b ON b.n = object AND a.pmid = b.pmid""",
    "unseen_documents": "SELECT rel_id, pmid FROM relations WHERE pmid IS NOT NULL AND pmid NOT IN (SELECT pmid FROM documents WHERE pmid IS NOT NULL)",
}
