from helpers import rows

from quillgraph.operators import store as S


def test_lookups(spark):
    t = spark.createDataFrame([("a", "p", "b", "iri"), ("b", "regulates", "a", "iri"), ("a", "rdf:type", "c", "iri"), ("a", "rdfs:label", "x", "literal"), ("a", "p", "a", "iri")], "s string, p string, o string, o_kind string")
    assert rows(S.direct_neighbours(t)) == [("a", "b", 1), ("b", "a", 1)]
    assert rows(S.direct_neighbours(t, relation="REGUL"), "node") == [("a",), ("b",)]
    assert [tuple(r) for r in S.entity_details(t).collect()] == [("a", "x", None, None)]
    r = spark.createDataFrame([("c", "rdfs:subClassOf", "_:1", "bnode"), ("_:1", "owl:onProperty", "p", "iri"), ("_:1", "owl:allValuesFrom", "d", "iri"), ("p", "rdfs:domain", "z", "iri"), ("p", "rdfs:domain", "y", "iri")], "s string, p string, o string, o_kind string")
    assert rows(S.restriction_scan(r)) == [("c", "p", "d", "owl:allValuesFrom")] and rows(S.domain_range(r)) == [("p", "y", None)]
    k = spark.createDataFrame([("x", "rdfs:subClassOf", "y", "iri"), ("y", "owl:equivalentClass", "w", "iri"), ("w", "rdfs:subClassOf", "v", "iri")], "s string, p string, o string, o_kind string")
    assert ("x", "v") in rows(S.schema_closure(k)) and ("w", "y") in rows(S.schema_closure(k)) and ("v", "x") not in rows(S.schema_closure(k))


def test_store_query_and_groups(spark):
    s = spark.createDataFrame([("a", "p", "b", 0.9), ("A", "q", "c", 0.4), ("z", "p", "b", None)], "subject string, predicate string, object string, confidence double")
    assert rows(S.query_relationships(s, subject="a")) == [("A", "q", "c", 0.4), ("a", "p", "b", 0.9)] and S.query_relationships(s, predicate="p", min_confidence=0.5, limit=1).count() == 1
    d = spark.createDataFrame([("1", "x", "y", "p", "t"), ("1", "x", "y", "p", None), ("1", "y", None, "q", "a")], "document_id string, entity1 string, entity2 string, predicted_relation string, abstract string")
    g = S.group_predictions(d).first()
    assert (g.entities, g.n_relations, g.abstract) == (["x", "y"], 2, "a")


def test_bootstrap_is_repeatable(spark):
    docs = spark.createDataFrame([(f"d{i}",) for i in range(30)], "pmid string")
    one = rows(S.bootstrap_documents(docs, 3, 20))
    assert one == rows(S.bootstrap_documents(docs, 3, 20)) and len(one) == 60 and len({r[1] for r in one}) > 15
    assert S.bootstrap_documents(docs.limit(0), 2, 5).count() == 0


def test_trees_and_models(spark):
    t = spark.createDataFrame([(1, 0, 1, "he", 2), (1, 0, 2, "takes", 2), (1, 0, 3, "red", 4), (1, 0, 4, "pills", 2)], "doc_id int, sent_id int, i int, text string, head_i int")
    assert [(r.leaf, r.path) for r in S.dependency_paths(t).orderBy("leaf").collect()] == [(1, ["takes", "he"]), (3, ["takes", "pills", "red"])]
    d = spark.createDataFrame([(1, "Aspirin treats pain. It works."), (2, None), (3, "")], "id int, text string")
    assert rows(S.extract_with(d, "id", "text")) == [(1, "Aspirin", "treats", "pain", 0.5)]
    assert [len(r.vector) for r in S.embed(d, "id", "text").collect()] == [64] * 3
    v = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.1]), (3, [-1.0, 0.0])], "id bigint, vector array<double>")
    assert S.most_similar(v, [0], [3], 1).first().id == 2


def test_flatten_graph_does_not_carry_every_place_of_a_subject(spark, monkeypatch):
    import random

    from quillgraph.sinks import merge as M

    rnd = random.Random(5)
    loc = [(f"n{rnd.randrange(30)}", f"p{rnd.randrange(50)}") for _ in range(400)] + [(f"n{k}", "crowd") for k in range(30)] + [("n1", None), (None, "p1"), ("other", "p2")]
    links = [(f"n{rnd.randrange(33)}", rnd.choice(["x", "y", None]), f"n{rnd.randrange(33)}") for _ in range(90)] + [("n3", "self", "n3"), (None, "x", "n1")]
    loc += loc[:50]
    monkeypatch.setattr(M, "CROWD", 25)
    monkeypatch.setattr(M, "PAIRS_AT_ONCE", 40)
    monkeypatch.setattr(M, "ROWS_OUT", 3)
    got = M.flatten_graph(spark.createDataFrame(loc, "name string, pmid string"), spark.createDataFrame(links, "subject string, predicate string, object string"))
    there = {x for x in loc if None not in x}
    want = {(s, p, o, d) for s, p, o in links for d in {d for _, d in there} if (s, d) in there and (o, d) in there}
    assert sorted(map(str, got.collect())) == sorted(f"Row(subject={s!r}, predicate={p!r}, object={o!r}, pmid={d!r})" for s, p, o, d in want)
    # a subject and an object of one link in many places, never in the same one: no candidate may leave the search
    apart = spark.createDataFrame([("a", f"p{k}") for k in range(3000)] + [("b", f"q{k}") for k in range(3000)], "name string, pmid string")
    rows_met, pairer = spark.sparkContext.accumulator(0), M._pairer

    def counted(*args):
        def run(batches):
            for b in pairer(*args)(batches):
                rows_met.add(b.num_rows)
                yield b
        return run

    monkeypatch.setattr(M, "_pairer", counted)
    assert M.flatten_graph(apart, spark.createDataFrame([("a", "x", "b")], "subject string, predicate string, object string")).count() == 0
    assert rows_met.value < 3000
