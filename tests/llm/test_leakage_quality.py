import random
import sys
import tracemalloc
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from helpers import rows
from pyspark.sql import functions as F

from quillgraph.llm import leakage as L
from quillgraph.llm import quality as Q
from quillgraph.llm.quality_examples import HOLDOUT

sys.path.append(str(Path(__file__).parent))
from checked_documents import CHECKED  # noqa: E402

NAMES = [f"{a}{b}{c}" for a in ("ka", "lo", "mi", "zu", "pe", "ra") for b in ("di", "fo", "gu", "te", "vo") for c in ("ne", "xin", "lol", "mab")]


def sentence(r):
    return f"The effect of {r.choice(NAMES)} on {r.choice(NAMES)} was strong in {r.choice(NAMES)} cells, and {r.choice(NAMES)} fell by {r.randrange(9, 99)} percent after {r.randrange(2, 99)} days."


def corpus():
    r = random.Random(7)
    items = [(i, " ".join(sentence(r) for _ in range(4)) + (" Answer: yes, through KX-4." if i == 0 else "")) for i in range(12)]
    shared = "All procedures were approved by the local ethics board and written consent was obtained from all."
    docs, truth = [], set()
    for d in range(240):
        parts = [sentence(r) for _ in range(r.randrange(2, 9))]
        if d % 5 == 0:
            parts.append(shared)
        if d % 4 == 0:
            k = r.randrange(12)
            w = items[k][1].split()
            n = round(len(w) * r.choice([0.5, 0.7, 1.0]))
            s = r.randrange(0, len(w) - n + 1)
            cut = w[s:s + n]
            if d % 8 == 0:
                cut[len(cut) // 2] = "typo"
            parts.insert(r.randrange(len(parts)), " ".join(cut).upper() if d % 12 == 0 else "  ".join(cut))
            truth.add((d, k))
        docs.append((d, " ".join(parts)))
    return docs, items, truth


@pytest.mark.parametrize("block", [2000, 5])
def test_leaks(spark, monkeypatch, block):
    monkeypatch.setattr(L, "ITEM_BLOCK", block)
    docs, items, truth = corpus()
    d = spark.createDataFrame([*docs, (900, None), (901, ""), (902, "!!!")], "doc bigint, text string")
    i = spark.createDataFrame([*items, (90, None), (91, "..."), (None, "x")], "item bigint, text string")
    got = {(r[0], r[1]) for r in L.find_leaks(d, "doc", "text", i, "item", "text").collect()}
    assert len(got & truth) >= 0.9 * len(truth) and len(got - truth) <= 0.02 * len(truth) + 1
    # against brute force over all pairs: common subsequence of the names and numbers alone
    telling = lambda t: [w for w in L.words(t) if w in NAMES or w.isdigit()]
    brute = {(a, b) for a, t in docs for b, x in items if L.common_subsequence(telling(x), telling(t)) >= 0.45 * len(telling(x))}
    assert brute >= truth and len(got & brute) >= 0.9 * len(brute)


def test_leak_edges(spark):
    d = spark.createDataFrame([(1, "a b c")], "doc bigint, text string")
    i = spark.createDataFrame([(1, "a b c d e f")], "item bigint, text string")
    assert L.find_leaks(d.limit(0), "doc", "text", i, "item", "text").count() == 0
    assert L.find_leaks(d, "doc", "text", i.limit(0), "item", "text").count() == 0


def test_common_subsequence():
    def slow(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for x in range(len(a)):
            for y in range(len(b)):
                t[x + 1][y + 1] = t[x][y] + 1 if a[x] == b[y] else max(t[x][y + 1], t[x + 1][y])
        return t[-1][-1]

    r = random.Random(3)
    for _ in range(60):
        a, b = [[r.randrange(5) for _ in range(r.randrange(0, 30))] for _ in range(2)]
        assert L.common_subsequence(a, b) == slow(a, b)


def test_passages_cover_texts():
    x = [np.arange(70) % 9, np.array([], np.int32), np.array([-1, 3])]
    r, c, owner, start = L.passages(x, np.ones(9, bool))
    assert owner.tolist() == [0, 0, 0, 0, 1, 2] and start.tolist() == [0, 16, 32, 48, 0, 0]
    assert c[r == 0].tolist() == (np.arange(32) % 9).tolist() and c[r == 5].tolist() == [3]


def test_holdout_and_kinds(spark):
    texts = [(i, t) for i, (_, t) in enumerate(HOLDOUT)] + [(900, None), (901, ""), (902, "   ")]
    df = spark.createDataFrame(texts, "kind bigint, text string").withColumnRenamed("kind", "id")
    model = Q.fit_kind_model(df, "text")
    assert model.holdout_accuracy >= 0.95
    got = {r.id: (r.kind, r.probability) for r in Q.classify_kind(df, "id", "text", model=model).collect()}
    assert sum(got[i][0] == k for i, (k, _) in enumerate(HOLDOUT)) >= 0.95 * len(HOLDOUT) and 900 not in got and {901, 902} <= set(got)
    assert Q.classify_kind(df.limit(0), "id", "text", model=model).count() == 0


@pytest.mark.skipif(not Path("/root/testdata/sf0.1").exists(), reason="test tables are not here")
def test_documents_checked_by_hand(spark):
    """Trained without them, the model agrees with the kinds read off documents of the table."""
    kind = {h: k for k, hs in CHECKED.items() for h in hs.split()}
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").withColumn("h", F.substring(F.sha1("text"), 1, 16))
    model = Q.fit_kind_model(docs.where(~F.col("h").isin(list(kind))), "text")
    got = {r.h: r.kind for r in Q.classify_kind(docs.where(F.col("h").isin(list(kind))), "h", "text", model=model).collect()}
    assert set(got) == set(kind) and sum(got[h] == k for h, k in kind.items()) >= 0.95 * len(kind) and model.holdout_accuracy >= 0.9


def test_labels_do_not_come_from_inputs():
    assert not {"common_share", "ends_per_word", "line_end_share", "zip_ratio"} & set(Q.STATISTICS)
    label = lambda t: {-1: None, **dict(enumerate(Q.KINDS))}[Q.weak_label(t)]
    assert label("| QT4 | 7.5 |\n" * 20) == "table" and label("".join(f"- name{i}\n" for i in range(40))) == "list"
    assert label("The drug was given to the rats in the first week, and it had no effect on them. " * 3) == "prose" and label("null " * 99) == "junk" and label("short text") is None
    mixed = Q.mixtures([("The drug was given to the rats. " * 9, 0), ("".join(f"- name{i}\n" for i in range(40)), 1)] * 20, 1)
    assert {k for _, k in mixed} == {0, 1}


def test_hex_is_counted_over_all_tokens():
    prose = "The drug was given to the rats in the first week and it had no effect on any of them. "
    s = lambda t: dict(zip(Q.STATISTICS, Q.structure_statistics(t), strict=True))
    assert s("a1 b2 c3 d4 " * 40 + prose * 60)["prose_part"] > 0.8 and s("a1 b2 c3 d4 " * 60)["junk_part"] == 1


def test_bulk_decides():
    model = Q.KindModel(np.zeros((0, len(Q.STATISTICS))), np.zeros(0, int))
    prose = "The drug was given to the rats in the first week. It had no effect on them, and the dose was raised. "
    rows_ = "\n".join(f"{n}\t{n * 3}\t{n % 7}" for n in range(60))
    kind = lambda t: Q.KINDS[model.probabilities(np.array([Q.structure_statistics(t)])).argmax()]
    assert kind(prose * 6 + "\n\na\tb\tc\n1\t2\t3") == "prose" and kind(prose + "\n\n" + rows_) == "table" and kind("null " * 80) == "junk"


def test_very_long_text():
    text = "The drug was given to the rats. " * 40_000
    assert np.allclose(Q.structure_statistics(text)[3:8], Q.structure_statistics(text[:32_000])[3:8], atol=0.01)


def test_trees_learn():
    r = np.random.default_rng(1)
    x = r.random((600, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 2] > 0.5)).astype(float)
    assert ((Q.Trees().fit(x, y).score(x) > 0) == (y > 0)).mean() > 0.97


def test_plain_statistics(spark):
    df = spark.createDataFrame([(1, "The cat. A dog!\nno end", 0), (2, "", 0), (3, None, 0)], "id int, text string, n_words int")
    got = rows(Q.text_statistics(df, "id", "text"))
    assert got[0][:3] == (1, 22, 6) and got[0][5] == 2 and got[0][6] == 0.5 and got[1][1:] == (0, 0, None, None, 0, None, None) and got[2][1] is None


def test_short_runs(spark):
    """Runs of little more than a third of an item, anywhere in unrelated text, are all found."""
    r = random.Random(11)
    items = [(i, " ".join(sentence(r) for _ in range(5))) for i in range(40)]
    docs, truth = [], set()
    for d in range(400):
        k = d % 40
        w = L.words(items[k][1])
        n = -(-len(w) * 36 // 100)
        s = r.randrange(0, len(w) - n + 1)
        own = L.words(" ".join(sentence(r) for _ in range(6)))
        at = r.randrange(len(own))
        docs.append((d, " ".join(own[:at] + w[s:s + n] + own[at:])))
        truth.add((d, k))
    got = {(x[0], x[1]) for x in L.find_leaks(spark.createDataFrame(docs, "doc bigint, text string"), "doc", "text",
                                              spark.createDataFrame(items, "item bigint, text string"), "item", "text").collect()}
    assert truth <= got


@pytest.mark.parametrize("way", ["replaced", "filler"])
def test_paraphrases(spark, way):
    """Items without a common word run: every third word replaced, or a filler behind every second word."""
    r = random.Random(13)
    names = [f"{x}{y}" for x in NAMES for y in NAMES[:20]]
    say = lambda: f"The effect of {r.choice(names)} on {r.choice(names)} was strong in {r.choice(names)} cells, and {r.choice(names)} fell by {r.randrange(9, 99)} percent."
    items = [(i, " ".join(say() for _ in range(5))) for i in range(30)]
    docs, truth = [], set()
    for d in range(300):
        own = L.words(" ".join(say() for _ in range(6)))
        if d % 3 == 0:
            w = L.words(items[d % 30][1])
            w = [f"zq{r.randrange(900)}" if way == "replaced" and k % 3 == 2 else x for k, x in enumerate(w)]
            if way == "filler":
                w = [y for k, x in enumerate(w) for y in ((x, f"zq{r.randrange(900)}") if k % 2 else (x,))]
            at = r.randrange(len(own))
            own = own[:at] + w + own[at:]
            truth.add((d, d % 30))
        docs.append((d, " ".join(own)))
    got = {(x[0], x[1]) for x in L.find_leaks(spark.createDataFrame(docs, "doc bigint, text string"), "doc", "text",
                                              spark.createDataFrame(items, "item bigint, text string"), "item", "text").collect()}
    assert len(got & truth) >= 0.9 * len(truth) and got <= truth


def test_anchor_chain_passes_repeated_words():
    item = np.array([0, 1] * 40 + [2, 3, 4, 5])
    assert len(L._anchors(L.content_positions(item, np.ones(6, bool)), item.tolist())) == len(item)


def test_triple_index():
    r = np.random.default_rng(5)
    items = [r.integers(0, 6, 20) for _ in range(5)]
    docs = [r.integers(-1, 6, n) for n in (0, 2, 3, 30, 60)]
    triples = [frozenset(L._triples(x, 6)) for x in items]
    got = L.TripleIndex(triples, 6).shared(docs, np.full(5, 3))
    assert set(got) == {(d, i) for d, x in enumerate(docs) for i in range(5) if len(triples[i] & set(L._triples(x, 6))) >= 3}
    for (d, i), pos in got.items():
        x = docs[d].astype(np.int64)
        assert pos == [p for p in range(len(x) - 2) if min(x[p:p + 3]) >= 0 and L._triples(x[p:p + 3], 6)[0] in triples[i]]


def test_long_documents(spark):
    """Items in documents so long that each holds nearly every word of the field are found."""
    r = random.Random(17)
    names = [f"{x}{y}" for x in NAMES for y in NAMES]
    say = lambda: f"The effect of {r.choice(names)} on {r.choice(names)} was strong in {r.choice(names)} cells, and {r.choice(names)} fell by {r.randrange(9, 99)} percent."
    items = [(i, " ".join(say() for _ in range(5)) + f" Answer: yes, through KX{i}q.") for i in range(20)]
    docs, truth = [], set()
    for d in range(12):
        own = [say() for _ in range(1_500)]
        for k in {d % 20, (d + 7) % 20}:
            own.insert(r.randrange(len(own)), " ".join(items[k][1].split()[:40]))
            truth.add((d, k))
        docs.append((d, " ".join(own)))
    got = {(x[0], x[1]) for x in L.find_leaks(spark.createDataFrame(docs, "doc bigint, text string"), "doc", "text",
                                              spark.createDataFrame(items, "item bigint, text string"), "item", "text").collect()}
    assert got == truth


def test_memory_of_long_documents():
    """A task holds the words of a few documents at a time, however long a batch of them is."""
    r = random.Random(19)
    items = L.Items([(i, " ".join(sentence(r) for _ in range(4))) for i in range(12)])
    some = np.ones(len(items.vocab), bool)
    space = np.random.default_rng(1).standard_normal((len(some), L.RANK)).astype(np.float32)
    text = " ".join(" ".join(r.choice(NAMES) for _ in range(3)) + " zq" * 20 for _ in range(14_000))
    batch = pa.RecordBatch.from_arrays([pa.array(range(20), pa.int64()), pa.array([text] * 20)], names=["doc", "text"])
    tracemalloc.start()
    try:
        for _ in L._searcher([(items, some, some, space)], 1 / 3)(iter([batch])):
            pass
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert most < 8 * batch.nbytes


def test_pieces_keep_passages(monkeypatch):
    monkeypatch.setattr(L, "PIECE", 64)
    texts = [np.arange(n) % 7 for n in (0, 5, 64, 80, 81, 96, 97, 300)]
    keep = np.ones(7, bool)
    whole = [(o, s) for o, s in zip(*[x.tolist() for x in L.passages(texts, keep)[2:]], strict=True)]
    cut = []
    for group in L.pieces(texts):
        assert sum(len(x) for _, _, x in group) <= 80
        _, _, owner, start = L.passages([x for _, _, x in group], keep)
        cut += [(group[o][0], group[o][1] + s) for o, s in zip(owner.tolist(), start.tolist(), strict=True)]
    assert cut == whole


def test_few_shared_triples():
    """Documents that share triples with items, but none of them enough."""
    item = np.arange(40)
    index = L.TripleIndex([frozenset(L._triples(item, 40))], 40)
    assert index.shared([item[:5], item[20:24]], np.array([6.0])) == {}


def test_vectors_only_for_documents_that_can_hold_an_item(monkeypatch):
    docs, items, _ = corpus()
    items = L.Items(items)
    some = np.ones(len(items.vocab), bool)
    search = L.Search(items, some, some, np.random.default_rng(1).standard_normal((len(some), L.RANK)).astype(np.float32), 1 / 3)
    seen = []
    project = L.Search._project
    monkeypatch.setattr(L.Search, "_project", lambda self, coded: seen.append(len(coded)) or project(self, coded))
    assert not list(search.leaks([["zq"] * 90, []])) and not seen
    full = items.words[3]
    assert {x[:2] for x in search.leaks([["zq"] * 90, full, []])} >= {(1, 3)} and seen == [1]


def test_word_index_and_sums():
    r = np.random.default_rng(9)
    sets = [frozenset(r.integers(0, 12, n).tolist()) for n in (0, 3, 8, 20)]
    holds = r.random((5, 12)) < 0.4
    got = L.WordIndex(sets, 12).held(*np.nonzero(holds), 5)
    assert got.tolist() == [[sum(h[w] for w in x) for x in sets] for h in holds]
    rows_, cols = np.sort(r.integers(0, 9, 40)), r.integers(0, 12, 40)
    matrix = r.standard_normal((12, 4)).astype(np.float32)
    want = np.zeros((9, 4), np.float32)
    np.add.at(want, rows_, matrix[cols])
    assert np.allclose(L.sums(rows_, cols, matrix, 9), want, atol=1e-5)
