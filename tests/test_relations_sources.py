import pytest
from helpers import rows
from pyspark.sql import functions as F

from quillgraph.operators import relations as R
from quillgraph.operators import verification as V
from quillgraph.sinks.merge import read_merged, upsert, write_merged
from quillgraph.sources import bioc, cdr, obo
from quillgraph.sources.html_pages import parse_page
from quillgraph.streaming.ingest import ingest_stream, unseen


def test_svo(spark):
    toks = [(1, 0, 1, "aspirin", "NOUN", "nsubj", 3, "ENTITY"), (1, 0, 2, "not", "PART", "neg", 3, ""), (1, 0, 3, "reduces", "VERB", "ROOT", 3, ""), (1, 0, 4, "acute", "ADJ", "amod", 5, ""),
            (1, 0, 5, "pain", "NOUN", "dobj", 3, "ENTITY"), (1, 0, 6, "is", "VERB", "aux", 3, ""), (2, 0, 1, "x", "NOUN", "nsubj", 2, "ENTITY"), (2, 0, 2, "runs", "VERB", "ROOT", 2, "")]
    got = R.extract_svo(spark.createDataFrame(toks, "doc_id int, sent_id int, i int, text string, pos string, dep string, head_i int, ent_type string"))
    assert rows(got) == [(1, 0, "aspirin", "reduces", "pain", True)]


def test_chunks_alignment_phrases(spark):
    t = spark.createDataFrame([(1, 0, 0, "e.g.", "B-NP"), (1, 0, 1, "Red", "I-NP"), (1, 0, 2, "algae", "I-NP"), (1, 0, 3, ":", "O"), (1, 1, 0, "lost", "I-NP"), (1, 1, 1, "Aqueous", "B-NP"), (1, 1, 2, "extract", "I-NP")],
                              "doc_id int, sent_id int, i int, base string, tag string")
    assert [r.chunk for r in R.bio_chunks(t).orderBy("sent_id", "chunk_no").collect()] == ["e.g. Red algae", "Aqueous extract"]
    s = spark.createDataFrame([(1, "The Red Algae grow"), (2, "ethanol in water"), (3, None)], "sent_id int, sentence string")
    c = spark.createDataFrame([(10, "Red Algae"), (11, "ETHANOL"), (12, ""), (13, None)], "concept_id int, trigger string")
    assert rows(R.align_concepts(s, c)) == [(1, 10), (2, 11)]
    p = R.phrase_matches(s.select(F.col("sent_id").alias("id"), F.col("sentence").alias("text")), c.select(F.col("concept_id").alias("phrase_id"), F.col("trigger").alias("phrase")))
    assert rows(p) == [(1, 10, 1), (2, 11, 0)]


def test_association_and_class(spark):
    d = spark.createDataFrame([("ChemicalSubstance", "Disease"), ("Cell", "OrganismalEntity"), ("Gene", "Disease"), (None, "Gene")], "s string, o string")
    assert [r[0] for r in d.select(R.association_type(F.col("s"), F.col("o"))).collect()] == [
        "ChemicalToDiseaseOrPhenotypicFeatureAssociation", "AnatomicalEntityToAnatomicalEntityAssociation", "Association", "Association"]
    c = spark.createDataFrame([("FMA", None), ("DOID", None), ("BOQ", None), (None, "biological_process")], "p string, n string")
    assert [r[0] for r in c.select(R.class_of(F.col("p"), F.col("n"))).collect()] == ["OrganismalEntity", "Disease", "NamedThing", "BiologicalProcess"]


def test_verification(spark):
    t = spark.createDataFrame([("a", "causes", "b"), ("a", "x", "m"), ("m", "y", "c"), ("a", "sub", "d"), ("a2", "z", "c")], "s string, p string, o string")
    labels = spark.createDataFrame([("a", "A !"), ("b", "b !"), ("c", "c"), ("d", "d"), ("m", "m"), ("a2", "big a")], "entity string, label string")
    sub = spark.createDataFrame([("sub", "top")], "child string, parent string")
    r = spark.createDataFrame([(1, "a", "causes", "b"), (2, "a", "p", "c"), (3, "a", "top", "d"), (4, None, "p", "c"), (5, "q", "p", "c")], "rel_id int, s string, p string, o string")
    ev = V.evidence(r, t, sub, labels)
    assert rows(ev) == [(1, True, True, 0, 1, 0), (2, False, False, 1, 1, 1), (3, False, True, 0, 1, 0), (4, None, None, None, None, None), (5, False, False, 0, 0, 0)]
    score = {x.rel_id: x.score for x in V.evidence_score(ev).collect()}
    assert score == {1: 0.95, 2: pytest.approx(0.45), 3: 0.95, 4: 0.0, 5: 0.2}
    v = V.verdict(spark.createDataFrame([("treats", "CHEBI_1", "MONDO_1"), ("treats", "MONDO_1", "CHEBI_1"), ("odd", "CHEBI_1", "MONDO_1")], "predicate string, s_iri string, o_iri string"))
    assert [(x.subject_in_domain, x.object_in_range, x.direction_ok) for x in v.collect()] == [(True, True, True), (False, False, False), (None, None, False)]
    d = V.decide(V.evidence_score(ev).withColumns({"direction_ok": F.col("rel_id") == 2, "known": F.lit(True)})).orderBy("rel_id").collect()
    assert [(x.decision, x.attempts) for x in d] == [("accept", 0), ("accept", 0), ("accept", 0), ("reject", 2), ("reject", 2)] and d[1].final_score == 0.9
    assert rows(V.infer_relations(spark.createDataFrame([("a", "treats", "b"), ("b", "causes", "c"), ("b", "causes", "a")], "s string, p string, o string"))) == [("a", "association", "c")]
    res = V.resolve_entities(spark.createDataFrame([("Heart",), ("attack heart",), ("zzz",), ("",)], "term string"), spark.createDataFrame([("e2", "heart attack"), ("e1", "The heart")], "entity string, label string"))
    assert rows(res) == [("Heart", "e1"), ("attack heart", "e2")]
    schema = V.prefix_schema(spark.createDataFrame([("p1", "http://x/MONDO_1"), ("p1", "http://x/CHEBI_2"), (None, "x")], "prop string, on_class string")).first()
    assert schema.domain_prefixes == ["CHEBI_"] and schema.range_prefixes == ["CHEBI_", "MONDO_"]


OBO = '''format-version: 1.2

[Term]
id: X:1
name: root
def: "A \\"thing\\"." [ref]
synonym: "top" EXACT []
synonym: "head" RELATED []

[Term]
id: X:2
name: child
is_a: X:1 ! root
relationship: part_of X:1 ! root

[Term]
id: X:3
name: gone
is_obsolete: true

[Typedef]
id: part_of
'''
OWL = '''<?xml version="1.0"?><rdf:RDF xmlns:rdf="r" xmlns:owl="o" xmlns:rdfs="s" xmlns:oboInOwl="b" xmlns:obo="c">
<owl:Class rdf:about="http://purl.x/obo/X_1"><rdfs:label>root</rdfs:label><oboInOwl:hasExactSynonym>top</oboInOwl:hasExactSynonym></owl:Class>
<owl:Class rdf:about="http://purl.x/obo/X_2"><rdfs:label>child</rdfs:label><rdfs:subClassOf rdf:resource="http://purl.x/obo/X_1"/>
<rdfs:subClassOf><owl:Restriction><owl:onProperty rdf:resource="http://purl.x/obo/part_of"/><owl:someValuesFrom rdf:resource="http://purl.x/obo/X_9"/></owl:Restriction></rdfs:subClassOf></owl:Class></rdf:RDF>'''
BIOC = '''<collection><document><id>7</id><passage><offset>0</offset><text>Aspirin</text><annotation id="1"><infon key="identifier">C1</infon><infon key="type">Chemical</infon><location offset="0" length="7"/><text>Aspirin</text></annotation></passage>
<passage><offset>8</offset><text>helps pain</text><annotation id="2"><infon key="identifier">D1</infon><location offset="14" length="4"/><text>pain</text></annotation></passage>
<relation id="R"><infon key="entity1">C1</infon><infon key="entity2">D1</infon><infon key="type">treats</infon><infon key="novel">Novel</infon></relation>
<relation id="S"><infon key="entity1">C1</infon><infon key="entity2">ZZ</infon><infon key="type">treats</infon></relation></document></collection>'''


def test_ontology_files(spark, tmp_path):
    (tmp_path / "x.obo").write_text(OBO)
    terms = obo.parse_terms(obo.read_stanzas(spark, str(tmp_path / "x.obo")), "x")
    got = {r.id: r for r in terms.collect()}
    assert set(got) == {"X:1", "X:2"} and got["X:1"].synonyms == ["top", "head"] and got["X:2"].is_a == ["X:1"]
    assert rows(obo.term_edges(terms)) == [("X:1", "X:2", "is_a"), ("X:2", "X:1", "part_of")]
    (tmp_path / "x.owl").write_text(OWL)
    nodes, edges = obo.read_owl(spark, str(tmp_path / "x.owl"), "x")
    assert [(r.id, r.name, r.synonyms) for r in nodes.orderBy("id").collect()] == [("X:1", "root", ["top"]), ("X:2", "child", [])]
    assert rows(edges) == [("X:1", "X:2", "is_a"), ("X:2", "X:9", "part_of")]


def test_bioc(spark, tmp_path):
    (tmp_path / "b.xml").write_text(BIOC)
    docs = bioc.read_bioc(spark, str(tmp_path / "b.xml"))
    assert rows(bioc.annotations(docs)) == [("7", "C1", "Chemical", "Aspirin", 0, 7), ("7", "D1", "ENTITY", "pain", 14, 18)]
    assert rows(bioc.document_text(docs)) == [("7", "Aspirin\nhelps pain")]
    assert [tuple(r) for r in bioc.gold_relations(docs).collect()] == [("7", "Aspirin", "pain", "treats", True, "Chemical", "ENTITY")]


def test_document_directories(spark, tmp_path):
    for pmid, rel, ent in (("11", ',Subject,Action,Object,Negation\n0,"a, b",causes,c,False\n', "a\n\nb\n"), ("12", ",Subject,Action,Object,Negation\n", "")):
        d = tmp_path / pmid
        d.mkdir()
        (d / "relations.csv").write_text(rel)
        (d / "entities.txt").write_text(ent)
        (d / "authors.txt").write_text("Weiss, M\nNoname\n")
        (d / "doc.txt").write_text("line one\nline two")
    assert rows(cdr.read_relations(spark, str(tmp_path))) == [("11", 0, "a, b", "causes", "c", False)]
    assert cdr.read_relations(spark, str(tmp_path), spark.createDataFrame([("11",)], "pmid string")).count() == 0
    assert rows(cdr.read_lines(spark, str(tmp_path), "entities.txt")) == [("11", "a"), ("11", "b")]
    assert rows(cdr.authors(cdr.read_lines(spark, str(tmp_path), "authors.txt")).where("pmid = '11'")) == [("11", "Noname", None), ("11", "Weiss", "M")]
    assert rows(cdr.read_documents(spark, str(tmp_path)))[0] == ("11", "line one\nline two")


def test_pages():
    html = ("<html><title>t</title><script>var x='</p><p>no'</script><nav><p>menu</p></nav><h1>My <i>title</i></h1><span class='author'>A. B.</span><div class='abstract'><p>Short &amp; sweet.</p></div>"
            "<p>One<br>two<p>Three [1]</p><p>this requires JavaScript</p><h2>References</h2><p>gone</p></html>")
    assert parse_page(html) == ("My title", ["A. B."], "Short & sweet.", ["One two", "Three [1]"])
    assert parse_page(None) == (None, [], None, []) and parse_page("") == (None, [], None, []) and parse_page("no tags")[3] == []


def test_merge_is_idempotent(spark, tmp_path):
    new = spark.createDataFrame([("a", 1, 1), ("a", 2, 2), (None, 3, 1), ("b", 5, 1)], "k string, v int, seq int")
    once = upsert(None, new, ["k"], [F.col("seq")])
    assert rows(once) == [("a", 2, 2), ("b", 5, 1)] and rows(upsert(once, new, ["k"], [F.col("seq")])) == rows(once)
    path = str(tmp_path / "t")
    write_merged(path, new, ["k"], [F.col("seq")])
    write_merged(path, spark.createDataFrame([("a", 9, 3)], "k string, v int, seq int"), ["k"], [F.col("seq")])
    assert rows(read_merged(spark, path)) == [("a", 9, 3), ("b", 5, 1)]
    assert rows(unseen(new.select("k"), once, "k")) == [(None,)]


def test_stream(spark, tmp_path):
    src, target = str(tmp_path / "in"), str(tmp_path / "out")
    for k in range(2):
        spark.createDataFrame([("a", k, k), (f"x{k}", 0, k)], "k string, v int, seq int").write.mode("append").parquet(src)
        ingest_stream(spark, src, target, "k string, v int, seq int", ["k"], "seq", str(tmp_path / "cp")).awaitTermination()
    assert rows(read_merged(spark, target)) == [("a", 1, 1), ("x0", 0, 0), ("x1", 0, 1)]


def test_phrases_of_any_length(spark):
    from quillgraph.operators.relations import phrase_matches

    t = spark.createDataFrame([(1, "Old lolirol induced dorsal root ganglia damage, again a b c d e f g h")], "id int, text string")
    p = spark.createDataFrame([(1, "lolirol induced dorsal root ganglia damage"), (2, "a b c d e f g h"), (3, "damage"), (4, "a b c d e f g h i"), (5, "...")], "phrase_id int, phrase string")
    assert sorted((r.phrase_id, r.start) for r in phrase_matches(t, p).collect()) == [(1, 1), (2, 8), (3, 6)]
