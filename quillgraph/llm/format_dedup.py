"""Duplicates hidden by formatting differences.

Method: canonical records are range-partitioned and sorted (Spark's external
sort), then adjacent runs are scanned comparing full keys.  The range key ends
with the record id, so a key that holds a third of all rows is spread over many
partitions; only the first run of each partition can continue a run of an
earlier one, and those are corrected from one marker per partition and run end.  Keyed rows are
written once, so the sample for the ranges does not make the keys again; markers
carry a SHA-256 of their key, so their size does not follow the records.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.session import Scratch

_OUT = pa.schema([("kind", pa.int8()), ("first_id", pa.int64()), ("row_id", pa.int64()), ("n", pa.int64()), ("head_key", pa.string())])
_DDL = "kind tinyint, first_id bigint, row_id bigint, n bigint, head_key string"
MEMBER, RUN, MARK = 0, 1, 2


def bare(col: Column) -> Column:
    """Letters and digits of a value without regard to case."""
    return F.regexp_replace(F.translate(F.lower(col), "ς", "σ"), r"[^\p{L}\p{N}]+", "")


def canonical_key(same: list[str], unordered: list[str]) -> Column:
    """Key of a record: the columns ``same`` as they are, the bare values of ``unordered`` in any order.

    Null if a column of ``same`` is null or one of ``unordered`` is null or bare of letters and digits.
    """
    values = [bare(F.col(c)) for c in unordered]
    valid = F.lit(True)
    for v in values:
        valid = valid & v.isNotNull() & (v != "")
    for c in same:
        valid = valid & F.col(c).isNotNull()
    parts = F.array_join(F.sort_array(F.array(*values)), "\x1f")
    return F.when(valid, F.concat_ws("\x1f", *[F.col(c).cast("string") for c in same], parts))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of equal keys in one sorted partition: members, run lengths, and marks of the outer runs."""
    key = first = None  # open run
    length, head = 0, True

    def batch(kind, firsts, ids, ns, keys):
        n = len(firsts)
        return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int8)), pa.array(firsts, pa.int64()), pa.array(ids, pa.int64()),
                                           pa.array(ns, pa.int64()), pa.array(keys, pa.string())], schema=_OUT)

    for b in batches:
        n = b.num_rows
        if n == 0:
            continue
        keys, ids = b.column("key"), b.column("id").to_numpy(zero_copy_only=False)
        change = np.ones(n, bool)
        if n > 1:
            change[1:] = pc.not_equal(keys.slice(1), keys.slice(0, n - 1)).to_numpy(zero_copy_only=False)
        change[0] = key is None or keys[0].as_py() != key
        starts = np.nonzero(change)[0]
        run = np.cumsum(change) - 1  # -1: continues the open run
        run_first = ids[starts]
        firsts = np.where(run >= 0, run_first[np.maximum(run, 0)] if len(starts) else 0, first if first is not None else 0)
        # rows of the partition's first run carry its key, all others need no correction
        in_head = (run == (0 if key is None else -1)) & head
        head_key = key if key is not None else keys[0].as_py()
        want = (firsts != ids) | in_head
        w = np.nonzero(want)[0]
        if len(w):
            yield batch(MEMBER, firsts[w], ids[w], np.zeros(len(w), np.int64), [head_key if h else None for h in in_head[w]])
        bounds = np.append(starts, n)
        lengths = np.diff(bounds)
        if key is not None:
            length += int(starts[0]) if len(starts) else n
        if len(starts):
            if key is not None:  # the open run ends here
                yield batch(RUN, [first], [first], [length], [key if head else None])
                if head:
                    yield batch(MARK, [first], [first], [0], [key])
                head = False
            inner = slice(0, len(starts) - 1)
            if len(starts) > 1:
                k0 = [keys[0].as_py() if head and i == 0 else None for i in range(len(starts) - 1)]
                yield batch(RUN, run_first[inner], run_first[inner], lengths[inner], k0)
                if head:
                    yield batch(MARK, run_first[:1], run_first[:1], [0], [keys[0].as_py()])
                head = False
            key, first, length = keys[n - 1].as_py(), int(run_first[-1]), int(lengths[-1])
    if key is not None:
        yield batch(RUN, [first], [first], [length], [key if head else None])
        yield batch(MARK, [first], [first], [0], [key])


def _resolved(df: DataFrame, id_col: str, key: Column) -> tuple[DataFrame, DataFrame]:
    spark = df.sparkSession
    scratch = Scratch(spark, "runs")
    keyed = scratch.keep(df.select(key.alias("key"), F.col(id_col).cast("long").alias("id")).where("key is not null and id is not null"))
    runs = scratch.keep(keyed.repartitionByRange(F.col("key"), F.col("id")).sortWithinPartitions("key", "id").mapInArrow(_scan, _DDL))
    # at most two marks per partition, small whatever the number of rows and the length of keys
    marks = F.broadcast(runs.where(F.col("kind") == MARK).groupBy(F.sha2("head_key", 256).alias("head")).agg(F.min("first_id").alias("true_first")))
    fixed = runs.where(F.col("kind") != MARK).withColumn("head", F.sha2("head_key", 256)).join(marks, "head", "left").select(
        "kind", F.coalesce("true_first", "first_id").alias("first_id"), "row_id", "n")
    return fixed.where(F.col("kind") == MEMBER), fixed.where(F.col("kind") == RUN)


def copies(df: DataFrame, id_col: str, key: Column) -> DataFrame:
    """(first_id, copy_id): every row but the first of each class of equal keys.

    Rows with a null key or id are in no class; ids are expected unique (of rows
    that repeat an id, the repeats are no copies of it).  Empty tables give no rows.
    """
    members, _ = _resolved(df, id_col, key)
    return members.where("row_id <> first_id").select("first_id", F.col("row_id").alias("copy_id"))


def collapse(df: DataFrame, id_col: str, key: Column) -> DataFrame:
    """(first_id, n_copies): one row per class with its exact number of rows, itself included."""
    _, runs = _resolved(df, id_col, key)
    return runs.groupBy("first_id").agg(F.sum("n").alias("n_copies"))
