"""Helpers for keys that may hold a third of all rows.

* ``salted_lookup`` joins a large, possibly skewed side to a side with one row
  per key: heavy keys are spread over salts, all other keys keep salt 0.
* ``segmented_prefix`` gives running sums inside groups without ever putting a
  whole group into one task.
* ``checked_broadcast`` broadcasts a side only when its row count is proven small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A key with more rows than this is spread over several tasks.
HEAVY_ROWS = 500_000
#: At most this many keys can be heavy: the threshold grows with the row count.
MAX_HEAVY = 1024


def heavy_keys(counts: DataFrame, key: str, count: str, total: int, rows: int | None = None) -> list:
    """Keys whose ``count`` exceeds ``max(rows, total / MAX_HEAVY)``: at most MAX_HEAVY values; ``rows`` defaults to HEAVY_ROWS."""
    limit = max(HEAVY_ROWS if rows is None else rows, total // MAX_HEAVY)
    if total <= limit:
        return []
    return [r[0] for r in counts.where(F.col(count) > limit).select(key).collect()]


def salted_lookup(left: DataFrame, right: DataFrame, key: str, spread: Column, heavy: list, how: str = "inner",
                  salts: int = 64) -> DataFrame:
    """Join ``left`` to ``right`` (unique on ``key``); rows of heavy keys are spread by ``spread``.

    ``spread`` is any column of ``left`` that varies inside a key.  Without heavy
    keys this is the plain join, which adaptive execution may still split.
    """
    if not heavy:
        return left.join(right, key, how)
    hot = F.col(key).isin(heavy)
    lhs = left.withColumn("_qg_salt", F.when(hot, F.pmod(F.xxhash64(spread), F.lit(salts))).otherwise(F.lit(0)).cast("int"))
    rhs = right.withColumn("_qg_salt", F.explode(
        F.when(hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))))
    return lhs.join(rhs, [key, "_qg_salt"], how).drop("_qg_salt")


def segmented_prefix(df: DataFrame, group: list[str], order: list[str], value: Column, out: str, chunks: int | None = None) -> DataFrame:
    """Add ``out``: the sum of ``value`` over the rows before this one in its group.

    The order inside a group is (hash chunk, order columns): total and repeatable,
    though not the plain sort order.  A group of any size is split over ``chunks``
    tasks; only one row per (group, chunk) meets in the second step.
    """
    if chunks is None:
        chunks = max(16, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))
    d = df.withColumn("_qg_chunk", F.pmod(F.xxhash64(*order), F.lit(chunks)).cast("int")).withColumn("_qg_v", value)
    local = Window.partitionBy(*group, "_qg_chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("_qg_before", F.coalesce(F.sum("_qg_v").over(local), F.lit(0)))
    totals = df.withColumn("_qg_chunk", F.pmod(F.xxhash64(*order), F.lit(chunks)).cast("int")).groupBy(*group, "_qg_chunk").agg(
        F.sum(value).alias("_qg_total"))
    across = Window.partitionBy(*group).orderBy("_qg_chunk").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*group, "_qg_chunk", F.coalesce(F.sum("_qg_total").over(across), F.lit(0)).alias("_qg_base"))
    return (d.join(totals, [*group, "_qg_chunk"]).withColumn(out, F.col("_qg_before") + F.col("_qg_base"))
            .drop("_qg_chunk", "_qg_v", "_qg_before", "_qg_base"))


def checked_broadcast(df: DataFrame, max_rows: int) -> tuple[DataFrame, bool]:
    """``(broadcast hint, True)`` if ``df`` has at most ``max_rows`` rows, else ``(df, False)``."""
    small = df.limit(max_rows + 1).count() <= max_rows
    return (F.broadcast(df) if small else df), small
