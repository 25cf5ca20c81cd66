"""Containment joins and top-k per key."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GRAM = 3
#: Needles, and characters of all of them, that one automaton holds (about 100 MB in a task).
NEEDLES, NEEDLE_CHARS = 100_000, 3_000_000


def _grams(c: Column, n: int) -> Column:
    return F.when(F.length(c) >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - (n - 1), F.lit(1))), lambda i: F.substring(c, i, F.lit(n)))).otherwise(
        F.array().cast("array<string>"))


def contains_join(needles: DataFrame, needle: str, hay: DataFrame, text: str) -> DataFrame:
    """All pairs where ``text`` contains ``needle``; the columns of both sides (names must differ).

    Exact either way: up to ``NEEDLES`` needles of ``NEEDLE_CHARS`` characters in all
    go to the tasks as an automaton that reads every text once; more of them are
    looked up by the rarest of their character triples among the texts (shorter
    needles by the whole needle's length), an equi-join in which only hashes travel
    with the triples.  Null and empty needles and null texts give no pairs.
    """
    n = needles.select(F.col(needle).alias("_qg_q")).where("length(_qg_q) > 0").distinct()
    t = hay.select(F.col(text).alias("_qg_t")).where("_qg_t is not null").distinct()
    size = n.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("_qg_q")), F.lit(0)).alias("chars")).first()
    if size["n"] <= NEEDLES and size["chars"] <= NEEDLE_CHARS:
        found = t.mapInArrow(_finder([r[0] for r in n.collect()]), "_qg_q string, _qg_t string")
    else:
        found = _by_rarest_gram(n, t)
    pairs = needles.join(found, F.col(needle) == F.col("_qg_q")).drop("_qg_q")
    return pairs.join(hay, F.col("_qg_t") == F.col(text)).drop("_qg_t")


def _finder(words: list[str]):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for k, w in enumerate(words):
            automaton.add_word(w, k)
        if words:
            automaton.make_automaton()
        for b in batches:
            got, texts = [], []
            for t in b.column(0).to_pylist() if words else ():
                hits = {k for _, k in automaton.iter(t)}
                got.extend(words[k] for k in hits)
                texts.extend([t] * len(hits))
            yield pa.RecordBatch.from_arrays([pa.array(got, pa.string()), pa.array(texts, pa.string())], names=["_qg_q", "_qg_t"])
    return find


def _by_rarest_gram(n: DataFrame, t: DataFrame) -> DataFrame:
    sized = F.when(F.length("_qg_q") >= GRAM, _grams(F.col("_qg_q"), GRAM)).otherwise(F.array("_qg_q"))
    mine = n.select("_qg_q", F.explode(F.array_distinct(sized)).alias("_qg_g"))
    every = F.array_distinct(F.flatten(F.array(*[_grams(F.col("_qg_t"), k) for k in range(1, GRAM + 1)])))
    theirs = t.select(F.xxhash64("_qg_t").alias("_qg_h"), F.explode(every).alias("_qg_g")).join(mine.select("_qg_g").distinct(), "_qg_g", "left_semi")
    counts = theirs.groupBy("_qg_g").agg(F.count("*").alias("_qg_n"))
    rare = mine.join(counts, "_qg_g").groupBy("_qg_q").agg(F.min(F.struct("_qg_n", "_qg_g")).getField("_qg_g").alias("_qg_g"))
    return theirs.join(rare, "_qg_g").select("_qg_h", "_qg_q").join(t.withColumn("_qg_h", F.xxhash64("_qg_t")), "_qg_h").where(F.contains("_qg_t", "_qg_q")).select("_qg_q", "_qg_t")


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of every key in a given total order, with their ``rank`` from 1."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
