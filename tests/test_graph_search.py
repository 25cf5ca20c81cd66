import random

import pytest
from helpers import rows
from pyspark.sql import functions as F

from quillgraph.functions import similarity as S
from quillgraph.operators import evaluation as E
from quillgraph.operators import graph as G
from quillgraph.operators import search as Q
from quillgraph.operators.contains import contains_join

EDGES = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "d"), ("x", "y")]


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame([(a, b, "treats" if a < b else "other") for a, b in EDGES], "src string, dst string, relation string")


def test_reach_and_closure(spark, edges):
    starts = spark.createDataFrame([("a",), ("zz",)], "start string")
    assert rows(G.reach(starts, edges)) == [("a", "b", 1), ("a", "c", 2), ("a", "d", 3)]
    assert rows(G.reach(starts, edges, 1)) == [("a", "b", 1)]
    assert rows(G.closure(edges).where("start = 'a'")) == [("a", "b", 1), ("a", "c", 2), ("a", "d", 3)]


def test_paths(spark, edges):
    pairs = spark.createDataFrame([("a", "d"), ("a", "a"), ("a", "x")], "a string, b string")
    assert [(r.a, r.b, r.hops, r.path) for r in G.shortest_paths(pairs, edges).orderBy("b").collect()] == [("a", "a", 0, ["a"]), ("a", "d", 2, ["a", "c", "d"])]
    two = G.two_hop_paths(edges, spark.createDataFrame([("a",)], "start string")).collect()
    assert [(r.start, r.mid, r.end) for r in two] == [("a", "b", "c")] and two[0].score == pytest.approx(1.3 * 1.3)
    score = spark.createDataFrame([(["treats"],), (["a", "b", "c"],)], "r array<string>").select(G.path_score(F.col("r"))).collect()
    assert [s[0] for s in score] == pytest.approx([1.2 * 1.3, 0.8])


def test_pagerank(spark, edges):
    got = {r.id: r.score for r in G.pagerank(spark.createDataFrame([("a",), ("nowhere",)], "id string"), edges).collect()}
    assert sum(got.values()) == pytest.approx(1) and got["x"] == 0 and got["a"] == max(got.values())
    assert G.pagerank(spark.createDataFrame([("nowhere",)], "id string"), edges).count() == 0


def test_similarity_of_terms(spark):
    tree = spark.createDataFrame([("r", "a"), ("r", "b"), ("a", "c")], "src string, dst string")
    got = {(r.a, r.b): r.similarity for r in G.semantic_similarity(spark.createDataFrame([("c", "b"), ("c", "a"), ("r", "r")], "a string, b string"), tree).collect()}
    assert got == {("c", "b"): pytest.approx(1 / 4), ("c", "a"): pytest.approx(2 / 3), ("r", "r"): 1.0}


def test_last_edge_wins(spark):
    e = spark.createDataFrame([("a", "b", "old", 1), ("a", "b", "new", 2)], "src string, dst string, relation string, seq int")
    assert rows(G.last_edges(e, "seq")) == [("a", "b", "new")]


def test_contains_join_brute_force(spark):
    rnd = random.Random(2)
    texts = ["".join(rnd.choice("abc ") for _ in range(rnd.randrange(0, 12))) for _ in range(80)] + [None]
    needles = ["".join(rnd.choice("abc") for _ in range(rnd.randrange(0, 6))) for _ in range(40)] + [None]
    n = spark.createDataFrame([(i, x) for i, x in enumerate(needles)], "ni int, q string")
    t = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "ti int, txt string")
    want = sorted((i, j) for i, q in enumerate(needles) if q for j, x in enumerate(texts) if x is not None and q in x)
    assert sorted((r.ni, r.ti) for r in contains_join(n, "q", t, "txt").collect()) == want


def test_scored_search_and_cascade(spark):
    terms = spark.createDataFrame([("1", "heart attack", ["myocardial infarction", "MI"]), ("2", "heart", None), ("3", "attack rate", []), ("4", None, ["odd"])], "id string, name string, synonyms array<string>")
    q = spark.createDataFrame([(0, "Heart Attack"), (1, "infarction"), (2, "severe heart attack"), (3, None), (4, "")], "query_id int, query string")
    got = [(r.query_id, r.id, r.score) for r in Q.scored_search(q, terms).orderBy("query_id", "rank").collect()]
    assert got == [(0, "1", 1.0), (0, "2", 0.7), (1, "1", 0.75), (2, "1", 0.7), (2, "2", 0.7)]
    best = {r.query_id: (r.id, r.confidence) for r in Q.mapping_cascade(q, terms, fuzzy=True).where("rank = 1").collect()}
    assert best[0] == ("1", 1.0) and best[2][0] == "1"
    assert Q.scored_search(q, terms.limit(0)).count() == 0


def test_cosine_blocks(spark, monkeypatch):
    v = spark.createDataFrame([(i, [float(i % 5), 1.0, 0.0]) for i in range(40)] + [(99, None)], "id bigint, vector array<double>")
    q = v.where("id in (0, 3, 4)").select(F.col("id").alias("query_id"), "vector")
    whole = rows(Q.cosine_topk(q, v, 3))
    monkeypatch.setattr(Q, "VECTOR_BLOCK", 1)
    assert rows(Q.cosine_topk(q, v, 3)) == whole and len(whole) == 9


def test_string_similarity():
    assert S.ratio("abcd", "bcde") == 0.75 and S.composite("A b", "a B") == 1.0 and S.partial("abc", "xxabcxx") == 1.0
    assert S.weighted("acute anemia", "anemia acute") > 0.9 and S.weighted("", "x") == 0.0


def test_evaluation(spark):
    p = spark.createDataFrame([(1, "a", "p", "b", 0.9), (2, "a", "p", "c", 0.4), (3, "heart attacks", "q", "x", 0.5)], "pred_id bigint, s string, p string, o string, confidence double")
    g = spark.createDataFrame([(1, "a", "p", "b"), (2, "a", "p", "b"), (3, "heart attack", "q", "x"), (4, "n", "p", "m")], "gold_id bigint, s string, p string, o string")
    m = E.match_exact(p, g)
    assert rows(m, "status", "pred_id", "gold_id") == [("FN", None, 3), ("FN", None, 4), ("FP", 2, None), ("FP", 3, None), ("TP", 1, 2)] or len(m.collect()) == 5
    r = E.overall_metrics(m).first()
    assert (r.tp, r.fp, r.fn) == (1, 2, 2) and r.precision == pytest.approx(1 / 3)
    assert rows(E.match_fuzzy(p, g)) == [(1, 1), (3, 3)]
    z = E.overall_metrics(m.limit(0)).first()
    assert (z.precision, z.recall, z.f1) == (0.0, 0.0, 0.0)
    x = E.pair_match(spark.createDataFrame([("1", "A", "b"), ("1", "c", "d"), ("2", "a", "b")], "pmid string, a string, b string"), spark.createDataFrame([("1", "a", "B"), ("1", "e", "f")], "pmid string, a string, b string"))
    assert rows(x) == [("1", "a", "b", "tp"), ("1", "c", "d", "fp"), ("1", "e", "f", "fn")]
    assert E.pair_metrics(x).first().f1 == pytest.approx(0.5)
    rep = {r.label: r for r in E.classifier_report(spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), (None, "b")], "truth string, pred string")).collect()}
    assert rep["MICRO"].f1 == 0.5 and rep["a"].precision == 1.0 and rep["a"].recall == 0.5 and rep["null"].support == 1


def test_two_hop_query_keeps_ten_paths(spark, monkeypatch):
    from quillgraph.plans import graph_queries as P

    lit = spark.createDataFrame([x for m in range(12) for x in (("s", f"m{m:02}", "treats", 1), (f"m{m:02}", "e", "treats", 1))], "src string, dst string, relation string, n_docs long")
    monkeypatch.setattr(P.star, "literature", lambda *_: lit)
    monkeypatch.setattr(P, "_starts50", lambda *_: spark.createDataFrame([("s",)], "start string"))
    assert sorted(r.mid for r in P.two_hop_paths(spark, "").collect()) == [f"m{m:02}" for m in range(10)]


def test_shortest_path_has_no_depth_limit(spark):
    chain = spark.createDataFrame([(f"n{k:02}", f"n{k + 1:02}") for k in range(14)] + [("x", "y")], "src string, dst string")
    pairs = spark.createDataFrame([("n00", "n14"), ("n00", "x")], "a string, b string")
    assert [(r.b, r.hops) for r in G.shortest_paths(pairs, chain).collect()] == [("n14", 14)]


def _paths_by_hand(links, pairs):
    near = {}
    for x, y in links:
        if x != y:
            near.setdefault(x, set()).add(y)
            near.setdefault(y, set()).add(x)
    found = []
    for a, b in pairs:
        level, seen = {a: [a]}, {a}
        while level and b not in level:
            ahead = {}
            for n, p in level.items():
                for m in near.get(n, ()):
                    if m not in seen and (m not in ahead or p + [m] < ahead[m]):
                        ahead[m] = p + [m]
            level, seen = ahead, seen | ahead.keys()
        if b in level:
            found.append((a, b, len(level[b]) - 1, level[b]))
    return sorted(found)


def test_shortest_paths_against_search_by_hand(spark):
    rnd = random.Random(3)
    names = [f"n{k:02}" for k in range(60)]
    links = [(rnd.choice(names[:40]), rnd.choice(names[:40])) for _ in range(48)] + [(rnd.choice(names[40:]), rnd.choice(names[40:])) for _ in range(22)]
    pairs = sorted({(rnd.choice(names), rnd.choice(names)) for _ in range(60)} | {(n, names[0]) for n in names} | {(names[1], n) for n in names})
    p, e = spark.createDataFrame(pairs, "a string, b string"), spark.createDataFrame(links, "src string, dst string")
    want = _paths_by_hand(links, pairs)
    assert max(w[2] for w in want) > 4
    for most in (None, 1, 3):
        got = sorted((r.a, r.b, r.hops, r.path) for r in G.shortest_paths(p, e, most).collect())
        assert got == [w for w in want if most is None or w[2] <= most]


def test_shortest_path_query_is_not_quadratic_in_siblings(spark, monkeypatch):
    from quillgraph.plans import graph_queries as P
    from quillgraph.session import Scratch

    links = [("r", f"k{k:03}") for k in range(300)] + [("k000", "z"), ("z", "zz"), ("zz", "zzz")]
    links += [("u", "v"), ("v", "w"), ("t", "w"), ("w", "x"), ("x", "y"), ("u", "y0"), ("c", "d"), ("d", "c"), ("d", "f")]  # w has two parents; c and d are a circle
    edges = spark.createDataFrame(links, "src string, dst string").withColumn("relation", F.lit("is_a"))
    monkeypatch.setattr(P.star, "edges", lambda *_: edges)
    rows_kept, keep = [], Scratch.keep

    def counted(self, df):
        out = keep(self, df)
        rows_kept.append(out.count())
        return out

    monkeypatch.setattr(Scratch, "keep", counted)
    got = sorted((r.a, r.b, r.hops, r.path.split(">")) for r in P.shortest_path(spark, "").collect())
    kids = [f"k{k:03}" for k in range(300)]
    pairs = list(zip(kids, kids[1:])) + [(k, "r") for k in kids] + [("z", "r"), ("zz", "r"), ("zzz", "r")]
    pairs += [("v", "y0"), ("c", "f"), ("v", "u"), ("y0", "u"), *[(x, "t") for x in "wxy"]]
    assert got == _paths_by_hand(links, pairs)
    assert max(rows_kept) <= 2 * len(links)
