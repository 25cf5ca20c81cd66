"""Filling fixed-capacity containers with documents.

Method: large-item matching.  No container holds more than two items above a
third of its capacity, so those are matched greedily, largest with the largest
partner that still fits; smaller items go best-fit into the gaps.

Sizes are whole numbers up to the capacity, so the plan is made on the histogram
of sizes (at most ``capacity`` rows) as runs of identical containers.  The work
on the driver depends on the capacity, not on the number of documents.  Items
then find their container from their rank among the items of equal size; the
ranks are prefix sums over hash chunks, so a size shared by a third of all items
is never in one task.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.session import Scratch
from quillgraph.skew import segmented_prefix


def byte_tokens(col: Column) -> Column:
    """Size in tokens of the byte-level tokenizer ByT5: one per UTF-8 byte and one end token."""
    return F.octet_length(col).cast("long") + 1


class _Gaps:
    """Open runs by gap, for the smallest gap that is large enough."""

    def __init__(self):
        self.keys: list[int] = []
        self.runs: dict[int, list[int]] = {}

    def add(self, gap: int, run: int) -> None:
        if gap > 0:
            if gap not in self.runs:
                bisect.insort(self.keys, gap)
                self.runs[gap] = []
            self.runs[gap].append(run)

    def best(self, size: int) -> tuple[int, int] | None:
        i = bisect.bisect_left(self.keys, size)
        return (self.keys[i], self.runs[self.keys[i]][-1]) if i < len(self.keys) else None

    def pop(self, gap: int) -> int:
        run = self.runs[gap].pop()
        if not self.runs[gap]:
            del self.runs[gap]
            self.keys.pop(bisect.bisect_left(self.keys, gap))
        return run


def plan(histogram: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Placements (size, first rank, first container, per container, containers) and the number of containers.

    The n-th item of a size, n counted from the first rank of a placement, goes to
    container ``first container + n // per container``.
    """
    left = {s: c for s, c in histogram.items() if c > 0}
    used = dict.fromkeys(left, 0)
    runs: list[list[int]] = []  # [first container, number of containers]
    gaps = _Gaps()
    out: list[tuple[int, int, int, int, int]] = []
    bins = 0

    def put(size: int, first: int, per: int, n: int, items: int) -> None:
        out.append((size, used[size], first, per, n))
        used[size] += items
        left[size] -= items

    def new_run(n: int) -> int:
        nonlocal bins
        runs.append([bins, n])
        bins += n
        return len(runs) - 1

    large = sorted(s for s in left if 3 * s > capacity)
    for size in reversed(large):
        while left[size]:
            i = bisect.bisect_right(large, min(capacity - size, size)) - 1
            while i >= 0 and (left[large[i]] == 0 or large[i] == size and left[size] < 2):
                i -= 1
            mate = large[i] if i >= 0 else None
            if mate is None:
                n = left[size]
                r = new_run(n)
                put(size, runs[r][0], 1, n, n)
                gaps.add(capacity - size, r)
            elif mate == size:
                n = left[size] // 2
                r = new_run(n)
                put(size, runs[r][0], 2, n, 2 * n)
                gaps.add(capacity - 2 * size, r)
            else:
                n = min(left[size], left[mate])
                r = new_run(n)
                put(size, runs[r][0], 1, n, n)
                put(mate, runs[r][0], 1, n, n)
                gaps.add(capacity - size - mate, r)
    for size in sorted((s for s in left if 3 * s <= capacity), reverse=True):
        while left[size]:
            hit = gaps.best(size)
            if hit is None:
                per = capacity // size
                full, rest = divmod(left[size], per)
                if full:
                    r = new_run(full)
                    put(size, runs[r][0], per, full, full * per)
                    gaps.add(capacity - per * size, r)
                if rest:
                    r = new_run(1)
                    put(size, runs[r][0], rest, 1, rest)
                    gaps.add(capacity - rest * size, r)
                continue
            gap, _ = hit
            r = gaps.pop(gap)
            first, n = runs[r]
            per = gap // size
            full = min(n, left[size] // per)
            if full:
                put(size, first, per, full, full * per)
                runs.append([first, full])
                gaps.add(gap - per * size, len(runs) - 1)
            if full < n:
                rest = min(left[size], per - 1) if left[size] < per else 0
                if rest:  # the last items of this size share one container
                    put(size, first + full, rest, 1, rest)
                    runs.append([first + full, 1])
                    gaps.add(gap - rest * size, len(runs) - 1)
                    full += 1
                if full < n:
                    runs.append([first + full, n - full])
                    gaps.add(gap, len(runs) - 1)
    return out, bins


def _placer(placements: list[tuple[int, int, int, int, int]]):
    by_size: dict[int, np.ndarray] = {}
    for p in sorted(placements):
        by_size.setdefault(p[0], []).append(p[1:4])
    by_size = {s: np.array(v, dtype=np.int64) for s, v in by_size.items()}

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size = b.column("size").to_numpy(zero_copy_only=False)
            rank = b.column("rank").to_numpy(zero_copy_only=False)
            bins = np.empty(len(size), np.int64)
            order = np.argsort(size, kind="stable")
            for part in np.split(order, np.nonzero(np.diff(size[order]))[0] + 1) if len(size) else []:
                rows = by_size[int(size[part[0]])]
                k = np.searchsorted(rows[:, 0], rank[part], side="right") - 1
                bins[part] = rows[k, 1] + (rank[part] - rows[k, 0]) // rows[k, 2]
            yield pa.RecordBatch.from_arrays([b.column(c) for c in range(b.num_columns)] + [pa.array(bins)], names=[*b.schema.names, "container"])
    return place


def pack(df: DataFrame, id_col: str, size: Column, capacity: int = 4096) -> DataFrame:
    """Every item with its container: ``id_col, piece, n_pieces, piece_start, size, container``.

    An item is split only if it exceeds the capacity by itself, into full pieces and
    one rest; full pieces fill a container each.  Sizes are sums of ``size`` per row
    in tokens; null or non-positive sizes give no row.  Repeated rows are packed
    each.  An empty table gives no rows.  Containers are numbered from 0.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "packing")
    items = df.select(F.col(id_col).alias("item"), size.cast("long").alias("total")).where("total > 0 and item is not null")
    pieces = items.withColumn("n_pieces", F.ceil(F.col("total") / capacity).cast("int")).select(
        "item", "total", "n_pieces", F.explode(F.sequence(F.lit(0), F.col("n_pieces") - 1)).alias("piece"))
    pieces = scratch.keep(pieces.select("item", "piece", "n_pieces", (F.col("piece") * F.lit(capacity).cast("long")).alias("piece_start"),
                                        F.least(F.lit(capacity).cast("long"), F.col("total") - F.col("piece") * F.lit(capacity).cast("long")).alias("size")))
    histogram = {int(r["size"]): int(r["n"]) for r in pieces.groupBy("size").agg(F.count("*").alias("n")).collect()}  # at most ``capacity`` rows
    placements, _ = plan(histogram, capacity)
    ranked = segmented_prefix(pieces, ["size"], ["item", "piece"], F.lit(1).cast("long"), "rank")
    kind = pieces.schema["item"].dataType.simpleString()
    placed = ranked.select("item", "piece", "n_pieces", "piece_start", "size", "rank").mapInArrow(
        _placer(placements), f"item {kind}, piece int, n_pieces int, piece_start bigint, size bigint, rank bigint, container bigint")
    return placed.select(F.col("item").alias(id_col), "piece", "n_pieces", "piece_start", "size", "container")
