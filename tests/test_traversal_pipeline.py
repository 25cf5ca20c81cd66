import struct

import numpy as np
from helpers import rows
from pyspark.sql import functions as F

from quillgraph.functions.similarity import ratio, weighted
from quillgraph.operators import evaluation as E
from quillgraph.operators import pipeline as P
from quillgraph.operators import search as S
from quillgraph.operators import traversal as W
from quillgraph.sinks.merge import read_merged, write_merged
from quillgraph.sources import vectors as V


def graph(spark):
    e = [("a", "b", "treats"), ("a", "c", "causes"), ("b", "c", "x"), ("b", "d", "regulates y"), ("c", "a", "x"), ("c", "e", "x"), ("d", "f", "treats"), ("a", "a", "x"), ("a", "b", "also")]
    return spark.createDataFrame(e, "src string, dst string, relation string"), spark.createDataFrame([("a",), ("a",), ("zz",)], "start string")


def test_walks(spark):
    e, s = graph(spark)
    got = rows(W.explore_levels(e, s, 2), "depth", "src", "dst")
    assert got == [(1, "a", "b"), (1, "a", "c"), (2, "b", "d"), (2, "c", "e")]
    deep = [(r.step, r.src, r.dst) for r in W.explore_depth_first(e, s, 3).orderBy("step").collect()]
    assert deep == [(0, "a", "b"), (1, "b", "c"), (2, "c", "e"), (3, "b", "d"), (4, "d", "f")]
    assert rows(W.explore_depth_first(e, s, 2, most=1), "src", "dst") == [("a", "b"), ("b", "c")]
    assert rows(W.explore_planned(e, s), "node", "depth") == [("b", 1), ("c", 1), ("d", 2)]
    assert rows(W.explore_planned(e, s, lambda n: n.select("node", F.lit("also").alias("word"))), "node") == [("b",)]
    assert W.explore_levels(e, s.limit(0), 2).count() == 0 and W.explore_depth_first(e.limit(0), s, 2).count() == 0


def test_connecting_paths(spark):
    e, _ = graph(spark)
    p = spark.createDataFrame([("a", "b"), ("a", "c"), ("a", "d"), ("a", "f"), ("a", "b")], "start string, end string")
    got = [(r.end, r.mid, r.relations, round(r.score, 2), r.rank) for r in W.connecting_paths(e, p).orderBy("end", "rank").collect()]
    assert got == [("b", None, ["treats"], 1.56, 1), ("b", None, ["also"], 1.2, 2), ("c", None, ["causes"], 1.56, 1), ("c", "b", ["treats", "x"], 1.3, 2), ("c", "b", ["also", "x"], 1.0, 3),
                   ("d", "b", ["treats", "regulates y"], 1.69, 1), ("d", "b", ["also", "regulates y"], 1.3, 2)]


def test_expansion(spark):
    q = spark.createDataFrame([(1, "x"), (2, "y")], "query_id int, query string")
    c = spark.createDataFrame([(1, "n2"), (1, "n1"), (1, "n1")], "query_id int, node string")
    assert rows(W.expand_queries(q, c)) == [(1, 1, "x n1"), (1, 2, "x n2")]
    assert rows(W.expand_queries(q, c, lambda t, n: [t + str(len(n))])) == [(1, 1, "x2")]


def test_similar_texts_and_exact_fuzzy_search(spark):
    import random

    r = random.Random(8)
    base = ["".join(r.choice("abcde ") for _ in range(r.randrange(1, 24))) for _ in range(60)]
    other = [t[:k] + r.choice("abcde") + t[k + r.randrange(3):] for t in base for k in [r.randrange(len(t))]]
    got = {(x.x, x.y) for x in E.similar_texts(spark.createDataFrame([(t,) for t in [*base, None]], "x string"), spark.createDataFrame([(t,) for t in other], "y string")).collect()}
    assert got == {(a, b) for a in base for b in other if a and b and ratio(a, b) >= 0.8} and got
    terms = spark.createDataFrame([(str(i), t, [t[::-1]]) for i, t in enumerate(base)], "id string, name string, synonyms array<string>")
    q = spark.createDataFrame(list(enumerate(other[:15])) + [(99, None), (98, "")], "query_id bigint, query string")
    every = [(x.id, x.term) for x in S.all_terms(terms).collect()]
    want = set()
    for i, t in ((x.query_id, x.t) for x in q.select("query_id", S.index_text(F.col("query")).alias("t")).collect()):
        best = {}
        for k, term in every:
            if t and (v := weighted(t, term)) >= 0.85:
                best[k] = max(v, best.get(k, 0))
        want |= {(i, k) for k, _ in sorted(best.items(), key=lambda z: (-z[1], z[0]))[:10]}
    assert {(x.query_id, x.id) for x in S.fuzzy_matches(q, terms).collect()} == want
    assert S.fuzzy_matches(q.limit(0), terms).count() == 0


def test_taggers_and_models(spark):
    tagger = P.DictionaryTagger([("renal failure", "D"), ("failure", "X"), ("KX-4", "G"), (" ", "none")])
    df = spark.createDataFrame([(1, "Acute renal Failure by KX-4, not KX-45."), (2, None), (3, "")], "id int, text string")
    assert set(rows(P.tag_with(df, "id", "text", tagger))) == {(1, 6, 19, "D", "renal Failure"), (1, 23, 27, "G", "KX-4")}
    t = spark.createDataFrame([(1, "Aspirin treats headache. Nothing here."), (2, "none"), (3, None)], "id int, text string")
    assert rows(P.extract_with_model(t, "id", "text"), "id", "subject", "predicate", "object") == [(1, "Aspirin", "treats", "headache")]
    asked = '[{"subject": "a", "predicate": "leads to", "object": "b"}, {"subject": "a"}]'
    model = lambda p: asked if "Answer: " in p else "nonsense"
    assert rows(P.extract_with_model(t, "id", "text", model), "id", "predicate") == [(1, "causes"), (2, "causes")]
    assert P.extract_with_model(t, "id", "text", model, verify=False).count() == 0 and P.extract_with_model(t, "id", "text", lambda p: 1 / 0).count() == 0
    d = spark.createDataFrame([("the b a the b",)], "t string")
    assert d.select(P.tagged_words(F.col("t"), ["the"])).first()[0] == ["a", "b"]
    c = spark.createDataFrame([("x",), ("y",), (None,), ("z",)], "l string").select(P.label_code(F.col("l"), ["o", "x", "y"]))
    assert [r[0] for r in c.collect()] == [1, 2, 0, 0]
    n = spark.createDataFrame([(["Drug"],), (["a pathway"],), (["gene process"],), ([],)], "t array<string>").select(P.node_type(F.col("t")))
    assert [r[0] for r in n.collect()] == ["entity", "concept", "entity", "entity"]


def test_text_to_graph_and_store(spark, tmp_path):
    texts = spark.createDataFrame([(1, "Aspirin treats headache (Li, 2010). Aspirin causes rash."), (2, None)], "doc_id int, text string")
    nodes = spark.createDataFrame([("CHEBI:1", "aspirin", []), ("HP:2", "headache", [])], "id string, name string, synonyms array<string>")
    degrees = spark.createDataFrame([("CHEBI:1", 2), ("HP:2", 1)], "id string, degree int")
    store = P.TableStore(spark, str(tmp_path / "kg"))
    got = P.text_to_graph(texts, nodes, degrees, lambda t: P.extract_with_model(t, "doc_id", "text"), store)
    assert rows(got, "subject", "predicate", "object", "subject_id", "object_id") == [("Aspirin", "causes", "rash", None, None), ("Aspirin", "treats", "headache", "CHEBI:1", "HP:2")]
    store.add(spark.createDataFrame([("Aspirin", "treats", "headache", 0.9), ("x", "y", None, 1.0)], "subject string, predicate string, object string, confidence double"))
    assert rows(store.find(predicate="treats"), "object", "confidence") == [("headache", 0.9)] and store.find().count() == 2


def test_merge_rewrites_only_touched_buckets(spark, tmp_path):
    path = str(tmp_path / "t")
    write_merged(path, spark.range(300).select(F.col("id").alias("k"), F.lit(1).alias("v")), ["k"])
    write_merged(path, spark.createDataFrame([(7, 2)], "k bigint, v int"), ["k"])
    parts = [p.name for p in (tmp_path / "t" / "data-2").iterdir() if p.name.startswith("part=")]
    got = read_merged(spark, path)
    assert len(parts) == 1 and got.count() == 300 and rows(got.where("v = 2")) == [(7, 2)]


def test_readers(spark, tmp_path):
    np.savez(tmp_path / "e.npz", ids=np.array(["a", "b"]), embs=np.array([[1, 2], [3, 4]], np.float32))
    assert rows(V.read_npz(spark, str(tmp_path / "e.npz"))) == [("a", [1.0, 2.0]), ("b", [3.0, 4.0])]
    with open(tmp_path / "w.bin", "wb") as f:
        f.write(b"2 2\n")
        for w, v in (("x", (1, 2)), ("yé", (3, 4))):
            f.write(w.encode() + b" " + struct.pack("<2f", *v) + b"\n")
    assert rows(V.read_word2vec(spark, str(tmp_path / "w.bin"))) == [("x", [1.0, 2.0]), ("yé", [3.0, 4.0])]
    (tmp_path / "good.owl").write_text("""<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:o="http://o/" xml:base="http://b/">
 <o:Class rdf:about="http://x/1"><o:label>one</o:label><o:sub rdf:resource="http://x/2"/><o:sub><o:R><o:on rdf:resource="#p"/></o:R></o:sub></o:Class></rdf:RDF>""")
    (tmp_path / "bad.owl").write_text("<rdf:RDF><broken")
    got = rows(V.read_rdf_xml(spark, str(tmp_path / "*.owl")))
    assert ("http://x/1", "http://o/label", "one", "literal") in got and ("http://x/1", "http://o/sub", "http://x/2", "iri") in got
    assert ("_:b1@good.owl", "http://o/on", "http://b/#p", "iri") in got and ("http://x/1", "http://o/sub", "_:b1@good.owl", "bnode") in got and len(got) == 6
