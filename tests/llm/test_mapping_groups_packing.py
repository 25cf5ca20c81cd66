import itertools
import random
from pathlib import Path

import pytest
from helpers import rows
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillgraph.llm import canonical as C
from quillgraph.llm.group_split import assign_splits, deal_bins, difference, nine_digits, related_groups
from quillgraph.llm.packing import byte_tokens, pack, plan

TEXTS = [
    ("Acute Renal Failure, type I", "1"), ("type 2 acute renal failure", "2"), ("acute renal failure type 7", C.UNMATCHED), ("chronic renal failure", C.UNMATCHED),
    ("patients with renal failure [12]", "3"), ("renal failure (disorder)", "3"), ("renal failrue, unspecified", "3"), ("arf1", "1"), ("ARF2", C.UNMATCHED), ("α-lipoic acid sodium", "4"),
    ("alphalipoic acid sodium", "4"), ("beta-lipoic acid sodium", C.UNMATCHED), ("alpha-lipoic acid", C.UNMATCHED), ("lipocalin biosynthetic prócess n.o.s.", "5"), ("Marfan disorder", "6"), ("control", C.UNMATCHED),
    ("ｒｅｎａｌ ｆａｉｌｕｒｅ", "3"), ("renal failures", "3"), ("acute renal failure type", C.UNMATCHED),
]


def frames(spark):
    e = spark.createDataFrame([("1", "acute renal failure type 1", ["ARF1", None]), ("2", "acute renal failure type 2", None), ("3", "renal failure", []), ("4", "alpha-lipoic acid sodium", []),
                               ("5", "lipocalin biosynthetic process", []), ("6", "Marfan disorder", []), (None, "x", []), ("7", None, [""])], "oid string, name string, alias array<string>")
    d = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(TEXTS)] + [(100, None), (101, " "), (102, "")], "tier bigint, text string")
    return d, e


@pytest.mark.parametrize("block", [100_000, 3, 2])
def test_mapping(spark, monkeypatch, block):
    monkeypatch.setattr(C, "BLOCK", block)
    d, e = frames(spark)
    got = {r[0]: r[1] for r in C.map_to_list(d.withColumnRenamed("tier", "id"), "id", "text", e, "oid", "name", "alias").collect()}
    assert got == {i: want for i, (_, want) in enumerate(TEXTS)}


def test_mapping_edges(spark):
    d, e = frames(spark)
    d = d.withColumnRenamed("tier", "id")
    assert {r[1] for r in C.map_to_list(d, "id", "text", e.limit(0), "oid", "name", "alias").collect()} == {C.UNMATCHED}
    assert C.map_to_list(d.limit(0), "id", "text", e, "oid", "name", "alias").count() == 0
    two = spark.createDataFrame([("a", "kadesine"), ("b", "kadexine")], "oid string, name string")
    tie = spark.createDataFrame([(1, "kadefine")], "id bigint, text string")
    assert C.map_to_list(tie, "id", "text", two, "oid", "name").first()[1] == C.UNMATCHED


def test_mapping_does_not_depend_on_blocks(spark, monkeypatch):
    """Words of another block are known words, ties and longest mentions are settled over all blocks."""
    names = ["serum gastrin", "gastric ulcer", "marfan syndrome", "marfan syndrome type 2", "ulcer", "chronic gastric ulcer", "kadesine", "kadexine", "nephritis of the left kidney"]
    e = spark.createDataFrame([(str(i), n) for i, n in enumerate(names)], "oid string, name string")
    values = ["serum gastric", "serum gastrim", "marfan disorder", "marfan syndrom", "chronic gastric ulcer", "gastric ulcer in the cohort", "kadefine", "ulcer gastric", "marfan syndrome typ 2",
              "gastricc ulcer " + "nos " * 12, "left kidney nephritis", "the kidney left nephritiss of"]
    d = spark.createDataFrame(list(enumerate(values)), "id bigint, text string")
    seen = []
    for block in (100_000, 4, 1):
        monkeypatch.setattr(C, "BLOCK", block)
        seen.append(rows(C.map_to_list(d, "id", "text", e, "oid", "name")))
    assert seen[0] == seen[1] == seen[2]
    got = {r[0]: r[1] for r in seen[0]}
    assert got[0] == C.UNMATCHED and got[1] == "0" and got[4] == "5" and got[5] == "1" and got[6] == C.UNMATCHED and got[9] == "1" and got[11] == "8"


DATA = Path("/root/testdata/sf0.001")


@pytest.mark.skipif(not DATA.exists(), reason="test tables are not here")
def test_mapping_of_whole_tables_by_block(spark, monkeypatch):
    d, e = spark.read.parquet(str(DATA / "stored_entity.parquet")), spark.read.parquet(str(DATA / "canonical_terms.parquet"))
    seen = []
    for block in (100_000, 1_500):
        monkeypatch.setattr(C, "BLOCK", block)
        seen.append(rows(C.map_to_list(d, "entity_id", "text", e, "ontology_id", "canonical_name", "synonyms")))
    assert seen[0] == seen[1] and len({r[1] for r in seen[0]}) > 50


@settings(max_examples=200, deadline=None)
@given(st.lists(st.dictionaries(st.integers(0, 3), st.integers(0, 2), max_size=3), min_size=1, max_size=5), st.integers(1, 4), st.data())
def test_assignment(costs, wanted, data):
    spare = [data.draw(st.sampled_from([None, 0, 1])) for _ in costs]
    costs = [{j: c for j, c in x.items() if j < wanted} for x in costs]
    best = None
    for pick in itertools.product(*[[*c.items(), *([(None, s)] if s is not None else [])] for c, s in zip(costs, spare, strict=True)]):
        if sorted(p[0] for p in pick if p[0] is not None) == list(range(wanted)):
            best = min(x for x in (best, sum(p[1] for p in pick)) if x is not None)
    assert C.assign(costs, wanted, spare) == best


def test_document_ids(spark):
    d = spark.createDataFrame([(x,) for x in ("200000001", "PMID:200000001", " 200000001 ", "0200000001", "200000001.0", "pmid200000001", None, "none")], "d string")
    assert [r[0] for r in d.select(nine_digits(F.col("d"))).collect()] == ["200000001"] * 6 + [None, None]


def test_related_groups_and_splits(spark):
    docs = spark.createDataFrame([(f"d{i:03}",) for i in range(60)] + [(None,), ("d001",)], "doc string")
    authors = spark.createDataFrame([(f"d{i:03}", "star") for i in range(20)] + [("d020", "x"), ("d021", "x"), ("d022", None), ("d023", None), ("ghost", "x"), ("ghost", "star")], "document string, key string")
    texts = spark.createDataFrame([("d021", "t"), ("d030", "t")], "document string, key string")
    g = related_groups(docs, "doc", [authors, texts])
    by = {r.document: r.group_id for r in g.collect()}
    assert len(by) == 60 and {by[f"d{i:03}"] for i in range(20)} == {"d000"} and by["d020"] == by["d021"] == by["d030"] == "d020" and by["d022"] == "d022" != by["d023"]
    w = docs.where("doc is not null").distinct().select(F.col("doc").alias("document"), F.lit(1).alias("weight"))
    s = {r.document: (r.group_id, r.split, r.group_size) for r in assign_splits(g, w, ["train", "validation", "test"], [0.6, 0.2, 0.2]).collect()}
    assert set(s) == set(by) and all(s[a][1] == s[b][1] for a in by for b in by if by[a] == by[b])
    counts = {k: sum(v[1] == k for v in s.values()) for k in ("train", "validation", "test")}
    assert abs(counts["train"] - 36) <= 3 and min(counts.values()) >= 9 and s["d000"][2] == 20
    assert assign_splits(g.limit(0), w, ["a", "b"], [0.5, 0.5]).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=40), st.integers(2, 6))
def test_differencing(weights, bins):
    got = difference([(w, str(i)) for i, w in enumerate(weights)], bins)
    assert sorted(int(i) for _, items in got for i in items) == list(range(len(weights)))
    assert all(s == sum(weights[int(i)] for i in items) for s, items in got)
    if weights:
        assert max(s for s, _ in got) - min(s for s, _ in got) <= max(weights)


def test_many_groups_in_blocks(spark, monkeypatch):
    """10^5 groups over many blocks: no group is torn apart, the splits have their shares."""
    from quillgraph.llm import group_split as G

    monkeypatch.setattr(G, "BLOCK_GROUPS", 2_000)
    monkeypatch.setattr(G, "FAN", 8)
    docs = spark.range(130_000).select(F.col("id").cast("string").alias("document"))
    groups = docs.select("document", F.when(F.col("document") < 30_000, F.concat(F.lit("g"), F.pmod(F.xxhash64("document"), F.lit(900)))).otherwise(F.col("document")).alias("group_id"))
    w = docs.select("document", (F.lit(1) + F.pmod(F.xxhash64("document", F.lit(1)), F.lit(9))).alias("weight"))
    s = assign_splits(groups, w, ["a", "b", "c"], [0.8, 0.1, 0.1])
    got = s.join(w, "document").groupBy("group_id").agg(F.count_distinct("split").alias("k"), F.first("split").alias("split"), F.sum("weight").alias("w")).cache()
    assert got.where("k > 1").count() == 0 and s.count() == 130_000
    by = {r.split: r.w for r in got.groupBy("split").agg(F.sum("w").alias("w")).collect()}
    total = sum(by.values())
    assert all(abs(by[k] / total - x) < 0.01 for k, x in zip("abc", (0.8, 0.1, 0.1), strict=True))


def test_deal_bins():
    assert deal_bins([10] * 10, [0.8, 0.1, 0.1]).count(0) == 8 and deal_bins([], [0.5, 0.5]) == []


def check_plan(histogram, capacity):
    placements, bins = plan(histogram, capacity)
    load = [0] * bins
    for size, count in histogram.items():
        mine = sorted(p for p in placements if p[0] == size)
        at = 0
        for k, (_, start, first, per, n) in enumerate(mine):
            assert start == at
            stop = mine[k + 1][1] if k + 1 < len(mine) else count
            for i in range(start, stop):
                b = first + (i - start) // per
                assert b < first + n
                load[b] += size
            at = stop
        assert at == count or not count
    assert all(0 < x <= capacity for x in load)
    return load


@settings(max_examples=120, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 9), max_size=14))
def test_plan_is_valid_and_tight(histogram):
    load = check_plan(histogram, 40)
    total = sum(s * c for s, c in histogram.items())
    assert len(load) <= max(1, 1.7 * total / 40 + 1)


def test_pack(spark):
    rnd = random.Random(4)
    data = [(i, "x" * (99 if i % 3 == 0 else rnd.randrange(0, 250)), "c") for i in range(300)] + [(900, None, "c"), (901, "é" * 130, "c"), (5, "dup", "c")]
    df = spark.createDataFrame(data, "id bigint, text string, container string")
    got = pack(df, "id", byte_tokens(F.col("text")), 100).collect()
    load = {}
    for r in got:
        load[r.container] = load.get(r.container, 0) + r["size"]
        assert (r.n_pieces > 1) == (r.id == 901 or r.id < 300 and sum(len(t or "") + 1 > 100 for i, t, _ in data if i == r.id) > 0 and r.n_pieces > 1)
    assert max(load.values()) <= 100 and sum(load.values()) == sum(len(t.encode()) + 1 for _, t, _ in data if t is not None)
    assert set(load) == set(range(len(load))) and {r.id for r in got} == {i for i, t, _ in data if t is not None}
    assert [(r.piece, r.piece_start, r["size"]) for r in sorted(got, key=lambda r: r.piece) if r.id == 901] == [(0, 0, 100), (1, 100, 100), (2, 200, 61)]
    assert pack(df.limit(0), "id", byte_tokens(F.col("text")), 100).count() == 0
    assert rows(pack(df.where("id = 901"), "id", byte_tokens(F.col("text")), 1000), "n_pieces") == [(1,)]
