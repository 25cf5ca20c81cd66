"""Train, validation and test splits that keep related records together.

Documents are linked through hub nodes (one per author or source text), so a
hub with a third of all rows costs one edge per row and no pairs.  After the
connected components, largest differencing (Karmarkar-Karp) balances component
weights over many equal bins: the components are spread over blocks of bounded
size, each block is differenced by repeatedly combining its two most uneven
partial solutions, and the blocks' bins are differenced again in a tree, some
blocks per task.  Whole bins then go to the splits by their target shares.
"""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.operators.components import components
from quillgraph.session import Scratch
from quillgraph.skew import heavy_keys, salted_lookup

#: Bins that are balanced before they are dealt to the splits.
BINS = 100
#: Groups in a block (about 2 s and 30 MB of one task), and blocks that one task combines.
BLOCK_GROUPS, FAN = 10_000, 64


def nine_digits(col: Column) -> Column:
    """A document id in any notation (prefix, blanks, leading zero, ".0") as nine digits."""
    digits = F.regexp_extract(col, r"([0-9]+)(?:\.0*)?\s*$", 1)
    return F.when(digits != "", F.lpad(F.regexp_replace(digits, r"^0+(?=\d)", ""), 9, "0"))


def related_groups(docs: DataFrame, doc_col: str, shared: list[DataFrame]) -> DataFrame:
    """``document, group_id``: documents related through equal keys, directly or through others.

    ``shared``: tables (document, key); null keys relate nothing; links of documents
    that are not in ``docs`` count for nothing.  The group id is the smallest document.
    """
    ids = docs.select(F.col(doc_col).alias("document")).where("document is not null").distinct()
    links = None
    for k, df in enumerate(shared):
        # "~" sorts behind digits and letters, so the smallest id of a component is a document
        part = df.select(F.col("document"), F.concat(F.lit(f"~{k}:"), F.col("key")).alias("key")).where("document is not null and key is not null")
        links = part if links is None else links.unionByName(part)
    links = links.join(ids, "document", "left_semi")
    comp = components(links, "document", "key", ids, "document")
    return comp.where(~F.col("id").startswith("~")).select(F.col("id").alias("document"), F.col("component").alias("group_id"))


def difference(weights: list[tuple[int, str]], bins: int) -> list[tuple[int, list]]:
    """Largest differencing of (weight, item) into ``bins``: (sum, items), sums as even as the method gets."""
    return [(s, _flat(items)) for s, items in combine([[(w, item)] for w, item in sorted(weights, key=lambda x: (-x[0], x[1]))], bins)]


def combine(solutions: list[list[tuple[int, object]]], bins: int) -> list[tuple[int, object]]:
    """Repeatedly joins the two partial solutions with the largest spread, heaviest bin with lightest.

    A solution is the list of its filled bins (sum, content) by rising sum, at most ``bins``.
    """
    heap = []
    for n, sol in enumerate(solutions):
        sol = sorted(sol, key=_sum)
        heap.append((-(sol[-1][0] - (sol[0][0] if len(sol) == bins else 0)), n, sol))
    if not heap:
        return [(0, None)] * bins
    heapq.heapify(heap)
    n = len(heap)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        b = b[::-1]
        # with the empty bins in front, the lightest of a meets what is left of b behind its heaviest
        free = bins - len(a)
        both = b[:free] + [(x[0] + y[0], (x[1], y[1])) for x, y in zip(a, b[free:], strict=False)] + a[max(0, len(b) - free):]
        both.sort(key=_sum)
        heapq.heappush(heap, (-(both[-1][0] - (both[0][0] if len(both) == bins else 0)), n, both))
        n += 1
    return [(0, None)] * (bins - len(heap[0][2])) + heap[0][2]


def _sum(x: tuple[int, object]) -> int:
    return x[0]


def _flat(items) -> list:
    out, stack = [], [items]
    while stack:
        x = stack.pop()
        if isinstance(x, tuple):
            stack.extend(x)
        elif x is not None:
            out.append(x)
    return out


def _bin_block(bins: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = [(item, slot) for slot, (_, items) in enumerate(difference(list(zip(pdf["weight"].tolist(), pdf["group_id"], strict=True)), bins)) for item in items]
        out = pd.DataFrame(rows, columns=["group_id", "slot"]).merge(pdf, on="group_id")
        return out[["block", "slot", "group_id", "weight", "n"]]
    return run


def _combine_blocks(bins: int):
    """(parent, block, slot) -> slot of the parent, for the blocks of one parent."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["block", "slot"])
        solutions: dict[int, list[tuple[int, str]]] = {}
        for r in pdf.itertuples():
            solutions.setdefault(r.block, []).append((int(r.w), f"{r.block}:{r.slot}"))
        rows = [(*map(int, item.split(":")), slot) for slot, (_, items) in enumerate(combine(list(solutions.values()), bins)) for item in _flat(items)]
        out = pd.DataFrame(rows, columns=["block", "slot", "into"]).merge(pdf, on=["block", "slot"])
        return out[["parent", "block", "slot", "into", "w"]]
    return run


def deal_bins(sums: list[int], shares: list[float]) -> list[int]:
    """Split of each bin: heaviest first to the split that lacks most of its target."""
    total = sum(sums)
    left = [s * total for s in shares]
    out = [0] * len(sums)
    for b in sorted(range(len(sums)), key=lambda i: (-sums[i], i)):
        k = max(range(len(shares)), key=lambda i: (left[i], -i))
        out[b] = k
        left[k] -= sums[b]
    return out


def assign_splits(groups: DataFrame, weights: DataFrame, names: list[str], shares: list[float], bins: int = BINS) -> DataFrame:
    """``document, group_id, group_size, split`` with the shares of rows as near to ``shares`` as whole groups allow.

    ``groups``: (document, group_id); ``weights``: (document, weight), a missing
    weight counts 0.  A group heavier than a target fills that split; an empty table
    gives no rows.  Equal input gives equal output.
    """
    spark = groups.sparkSession
    scratch = Scratch(spark, "splits")
    groups, seen = scratch.keep_counted(groups, n=F.count("*"))
    totals, counted = scratch.keep_counted(groups.join(weights, "document", "left").groupBy("group_id").agg(
        F.coalesce(F.sum("weight"), F.lit(0)).cast("long").alias("weight"), F.count("*").alias("n")), n=F.count("*"))
    blocks = max(1, -(-counted["n"] // BLOCK_GROUPS))
    totals = totals.withColumn("block", F.pmod(F.xxhash64("group_id"), F.lit(blocks)).cast("int"))
    placed = scratch.keep(totals.groupBy("block").applyInPandas(_bin_block(bins), "block int, slot int, group_id string, weight bigint, n bigint"))
    sums = placed.groupBy("block", "slot").agg(F.sum("weight").alias("w"))
    levels: list[DataFrame] = []
    while blocks > 1:
        blocks = -(-blocks // FAN)
        level = sums.withColumn("parent", F.floor(F.col("block") / FAN).cast("int")).groupBy("parent").applyInPandas(
            _combine_blocks(bins), "parent int, block int, slot int, into int, w bigint")
        levels.append(scratch.keep(level))
        sums = levels[-1].groupBy(F.col("parent").alias("block"), F.col("into").alias("slot")).agg(F.sum("w").alias("w"))
    last = sorted((r.slot, int(r.w)) for r in sums.collect())  # at most ``bins`` rows
    dealt = deal_bins([w for _, w in last], shares)
    split = spark.createDataFrame([(0, slot, names[k]) for (slot, _), k in zip(last, dealt, strict=True)], "block int, slot int, split string")
    for level in reversed(levels):
        split = level.join(split.select(F.col("block").alias("parent"), F.col("slot").alias("into"), "split"), ["parent", "into"]).select("block", "slot", "split")
    by_group = placed.join(split, ["block", "slot"]).select("group_id", F.col("n").alias("group_size"), "split")
    heavy = heavy_keys(placed, "group_id", "n", seen["n"])
    return salted_lookup(groups, by_group, "group_id", F.col("document"), heavy).select("document", "group_id", "group_size", "split")
