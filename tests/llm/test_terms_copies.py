import random
from collections import Counter, defaultdict

import pytest
from helpers import rows

from quillgraph.llm import term_frequency as TF
from quillgraph.llm.format_dedup import canonical_key, collapse, copies


def test_burst_trie_matches_counter():
    rnd = random.Random(1)
    trie, want = TF.BurstTrie(limit=4), defaultdict(lambda: [0, 0])
    for _ in range(3000):
        t = "".join(rnd.choice("ab ") for _ in range(rnd.randrange(0, 9)))
        trie.add(t, 2, 1)
        want[t][0] += 2
        want[t][1] += 1
    got = {p + s: c for p, held in trie.leaves() for s, c in held.items()}
    assert got == dict(want) and len(list(trie.leaves())) > 20


def test_routes():
    over = {"", "a", "ab"}
    assert [TF.route_of(t, over) for t in ("ab", "abc", "b", "a", "")] == ["ab", "abc", "b", "a", ""]


def brute(rows_):
    n, docs, all_docs = Counter(), defaultdict(set), defaultdict(set)
    for f, v, d in rows_:
        t = " ".join("".join(c if c.isalnum() else " " for c in v.lower()).split()) if v else ""
        if t:
            n[f, t] += 1
            if d is not None:
                docs[f, t].add(d)
                all_docs[f].add(d)
    return {k: (c, len(docs[k]), "rare" if len(docs[k]) <= 2 else "common" if len(docs[k]) > 0.05 * len(all_docs[k[0]]) else None) for k, c in n.items()}


@pytest.mark.parametrize("burst", [512, 3])
def test_frequencies(spark, monkeypatch, burst):
    monkeypatch.setattr(TF, "BURST", burst)
    rnd = random.Random(2)
    words = ["is linked to", "IS-linked  to", "treats", "", None, "...", "Δ causes", "is"] + [f"is term {i}" for i in range(60)]
    data = [("f", rnd.choice(words) if rnd.random() < 0.7 else "treats", rnd.choice([None, *map(str, range(40))])) for _ in range(900)]
    a = spark.createDataFrame([(v, d, 1) for _, v, d in data], "value string, doc string, term int")
    b = spark.createDataFrame([("x y", "1", 0)] * 3, "value string, doc string, field int")
    got = {(r.field, r.term): (r.n_rows, r.n_docs, r.mark) for r in TF.term_frequencies([("f", a, "value", "doc"), ("g", b, "value", "doc")]).collect()}
    assert got == brute([*data, *[("g", "x y", "1")] * 3])


def test_frequencies_of_nothing(spark):
    empty = spark.createDataFrame([], "value string, doc string")
    assert TF.term_frequencies([("f", empty, "value", "doc")]).count() == 0


def records(seed, n):
    rnd = random.Random(seed)
    pool = ["Heart attack", "heart-attack ", "HEART ATTACK", "causes", "Causes!", "pain", "β-x", None, "", " . "]
    out = []
    for i in range(n):
        v = ["heart attack", "causes", "pain"] if rnd.random() < 0.4 else [rnd.choice(pool) for _ in range(3)]
        rnd.shuffle(v)
        out.append((i, *v, rnd.choice([True, False, None])))
    return out


def classes(data):
    groups = defaultdict(list)
    for i, a, b, c, neg in data:
        vals = ["".join(ch for ch in (x or "").lower() if ch.isalnum()) for x in (a, b, c)]
        if neg is not None and all(vals):
            groups[(neg, tuple(sorted(vals)))].append(i)
    return list(groups.values())


@pytest.mark.parametrize("parts", [1, 7])
def test_copies(spark, parts):
    data = records(3, 700)
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # hot keys must span partitions
    try:
        df = spark.createDataFrame([(*r, "k") for r in data], "id bigint, a string, b string, c string, neg boolean, key string")
        key = canonical_key(["neg"], ["a", "b", "c"])
        want = classes(data)
        assert rows(copies(df, "id", key)) == sorted(((g[0], i) for g in want for i in g[1:]), key=lambda t: tuple((x is None, str(x)) for x in t))
        assert rows(collapse(df, "id", key)) == sorted(((g[0], len(g)) for g in want), key=lambda t: tuple((x is None, str(x)) for x in t))
        assert max(map(len, want)) > 60
        assert copies(df.limit(0), "id", key).count() == 0 and collapse(df.limit(0), "id", key).count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
