import random

import pytest
from helpers import rows

from pyspark.sql import functions as F

from quillgraph import skew
from quillgraph.operators import hierarchy as H
from quillgraph.operators.hierarchy import _blocks, descendants_of, hierarchy, links_from_lists


def brute(links):
    par = {}
    for i, p in links:
        if i is None:
            continue
        par.setdefault(i, set())
        if p is not None:
            par[i].add(p)
            par.setdefault(p, set())
    par = {i: min(ps) if ps else None for i, ps in par.items()}
    out = {}
    for i in par:
        seen, at = [], i
        while at is not None and at not in seen:
            seen.append(at)
            at = par[at]
        if at is None:
            out[i] = (seen[-1], len(seen) - 1)
        else:
            ring = seen[seen.index(at):]
            out[i] = (min(ring), -1 if i in ring else -2)
    return out


def check(spark, links):
    df = spark.createDataFrame(links, "id string, parent string")
    got = hierarchy(df)
    table = {r.id: r for r in got.collect()}
    want = brute(links)
    assert {i: (r.root_id, r.depth) for i, r in table.items()} == want
    tree = {i: r for i, r in table.items() if r.depth >= 0}
    for r in tree.values():
        assert r.path[0] == r.root_id and r.path[-1] == r.id and len(r.path) == r.depth + 1
        assert r.rgt - r.lft == r.n_descendants == sum(r.id in t.path[:-1] for t in tree.values())
        if r.parent:
            up = tree[r.parent]
            assert up.lft < r.lft <= r.rgt <= up.rgt
    assert {r.lft for r in tree.values()} == set(range(len(tree)))
    return got


def test_shapes(spark):
    check(spark, [("a", None), ("b", "a"), ("c", "a"), ("d", "b"), ("e", "d"), ("x", "y"), ("y", "x"), ("t", "y"), ("u", "t"), ("s", "s"), ("lone", None), ("k", "unlisted"), (None, "a"), ("b", "a")])
    check(spark, [("r1", "r2"), ("r2", "r3"), ("r3", "r1")])
    check(spark, [(f"n{i:03}", f"n{i - 1:03}" if i else None) for i in range(40)])


@pytest.mark.parametrize("heavy", [500_000, 4])
def test_random(spark, monkeypatch, heavy):
    monkeypatch.setattr(skew, "HEAVY_ROWS", heavy)
    rnd = random.Random(3)
    ids = [f"v{i}" for i in range(120)]
    check(spark, [(i, rnd.choice([None, *ids[:40]])) for i in ids] + [(f"kid{i}", ids[0]) for i in range(30)])


def test_empty_and_extra_columns(spark):
    assert hierarchy(spark.createDataFrame([], "id string, parent string")).count() == 0
    df = spark.createDataFrame([("b", "a", 1, "z")], "id string, parent string, depth int, anc string")
    assert rows(hierarchy(df), "id", "root_id", "depth") == [("a", "a", 0), ("b", "a", 1)]
    assert "path" not in hierarchy(df, paths=False).columns


def test_lists_and_descendants(spark):
    df = spark.createDataFrame([("go:1", None, ["http://x/GO_2", None]), ("GO_2 ", ["GO:1"], []), ("<http://x/go_3>", ["GO:2"], None), ("bad", None, None)], "n string, p array<string>, c array<string>")
    links = links_from_lists(df, "n", "p", "c")
    assert rows(links) == [("GO:1", None), ("GO:2", "GO:1"), ("GO:3", "GO:2")]
    tree = hierarchy(links)
    assert rows(descendants_of(tree)) == [("GO:1", "GO:2", 1), ("GO:1", "GO:3", 2), ("GO:2", "GO:3", 1)]
    assert rows(descendants_of(tree, spark.createDataFrame([("GO:2",)], "id string"))) == [("GO:2", "GO:3", 1)]


@pytest.mark.parametrize("top", [16, 2, 0])
def test_descendants_by_blocks(spark, monkeypatch, top):
    monkeypatch.setattr(H, "TOP_BLOCK", top)
    rnd = random.Random(9)
    links = [(f"v{i}", f"v{rnd.randrange(i)}" if i % 17 else None) for i in range(150)]
    tree = hierarchy(spark.createDataFrame(links, "id string, parent string"))
    want = sorted((a, r.id, r.depth - k) for r in tree.collect() for k, a in enumerate(r.path[:-1]))
    assert sorted(map(tuple, descendants_of(tree).collect())) == want


def test_blocks_make_up_the_range(spark):
    pairs = [(a, b) for a in range(0, 40, 3) for b in range(a, 44, 5)]
    df = spark.createDataFrame(pairs, "lo bigint, hi bigint")
    for top in (0, 2, 6):
        for r in df.select("lo", "hi", _blocks(F.col("lo"), F.col("hi"), top).alias("b")).collect():
            got = sorted(x for b in r.b for x in range(b.block << b.level, (b.block + 1) << b.level))
            assert got == list(range(r.lo, r.hi))
