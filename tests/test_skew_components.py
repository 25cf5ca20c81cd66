import random

import pytest
from helpers import rows
from pyspark.sql import functions as F

from quillgraph import skew
from quillgraph.operators.components import components
from quillgraph.skew import checked_broadcast, heavy_keys, salted_lookup, segmented_prefix


def test_salted_lookup(spark):
    left = spark.range(1000).select((F.col("id") % 3 == 0).cast("int").alias("k"), F.col("id").alias("v"))
    right = spark.createDataFrame([(0, "zero"), (1, "one"), (2, "two")], "k int, name string")
    heavy = heavy_keys(left.groupBy("k").count(), "k", "count", 1000, rows=100)
    assert sorted(heavy) == [0, 1]
    assert rows(salted_lookup(left, right, "k", F.col("v"), heavy), "v", "name") == rows(left.join(right, "k"), "v", "name")
    assert heavy_keys(left.groupBy("k").count(), "k", "count", 1000) == []


def test_segmented_prefix(spark):
    rnd = random.Random(1)
    data = [("hot" if rnd.random() < 0.7 else f"g{rnd.randrange(5)}", i, rnd.randrange(1, 9)) for i in range(400)]
    got = segmented_prefix(spark.createDataFrame(data, "g string, i int, v int"), ["g"], ["i"], F.col("v"), "before", chunks=7).collect()
    for g in {d[0] for d in data}:
        part = sorted((r.before, r.v) for r in got if r.g == g)
        at = 0
        for before, v in part:
            assert before == at
            at += v
    assert len(got) == 400


def test_checked_broadcast(spark):
    assert checked_broadcast(spark.range(5), 5)[1] and not checked_broadcast(spark.range(6), 5)[1]


def find(edges, nodes):
    p = {n: n for n in nodes}

    def f(x):
        while p[x] != x:
            x = p[x]
        return x

    for a, b in edges:
        a, b = f(a), f(b)
        p[max(a, b)] = min(a, b)
    return sorted((n, f(n)) for n in nodes)


@pytest.mark.parametrize("heavy", [500_000, 5])
def test_components(spark, monkeypatch, heavy):
    monkeypatch.setattr(skew, "HEAVY_ROWS", heavy)
    rnd = random.Random(5)
    shapes = [[(f"c{i:02}", f"c{i + 1:02}") for i in range(30)], [("hub", f"l{i}") for i in range(50)], [(f"r{rnd.randrange(60)}", f"r{rnd.randrange(60)}") for _ in range(50)], [("self", "self")], [("a", "b"), ("b", "a"), ("a", "b")]]
    edges = [e for s in shapes for e in s]
    nodes = sorted({x for e in edges for x in e} | {"alone"})
    df = spark.createDataFrame([*edges, (None, "a")], "src string, dst string")
    assert rows(components(df, nodes=spark.createDataFrame([("alone",), ("a",)], "id string"))) == sorted(find(edges, nodes))
    assert components(spark.createDataFrame([], "src string, dst string")).count() == 0
