"""Idempotent merge of new rows into a stored table, by key."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.session import Scratch


def upsert(stored: DataFrame | None, new: DataFrame, keys: list[str], order: list[Column] | None = None) -> DataFrame:
    """Stored rows whose key is not among the new ones, and the last new row per key.

    Rows with a null key column are dropped.  Merging the same rows twice changes nothing.
    """
    fresh = new.dropna(subset=keys)
    rest = [c for c in new.columns if c not in keys]
    if rest:
        rank = F.struct(*order) if order else F.struct(*rest)
        fresh = fresh.groupBy(*keys).agg(F.max_by(F.struct(*rest), rank).alias("_qg_row")).select(*keys, *[F.col(f"_qg_row.{c}").alias(c) for c in rest])
    else:
        fresh = fresh.distinct()
    if stored is None:
        return fresh
    kept = stored.join(fresh.select(*keys), keys, "left_anti")
    return kept.select(*fresh.columns).unionByName(fresh)


#: Parts of a merged table; a merge rewrites only those that new rows fall into.
BUCKETS = 64


def _files(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), spark._jvm.org.apache.hadoop.fs.Path


def _manifest(spark: SparkSession, folder: str) -> tuple[int, dict]:
    """Number and content of the newest version; (0, empty) if there is none."""
    fs, path = _files(spark, folder)
    numbers = [int(m.group(1)) for f in (fs.globStatus(path(f"{folder}/version-*.json")) or []) if (m := re.search(r"version-(\d+)\.json$", f.getPath().toString()))]
    if not numbers:
        return 0, {"buckets": BUCKETS, "parts": {}}
    n = max(numbers)
    return n, json.loads(spark.read.text(f"{folder}/version-{n}.json", wholetext=True).first()[0])


def read_merged(spark: SparkSession, folder: str) -> DataFrame:
    """The newest version of a merged table."""
    _, manifest = _manifest(spark, folder)
    return spark.read.parquet(*sorted(f"{folder}/{p}" for p in manifest["parts"].values())).drop("_qg_bucket")


def write_merged(folder: str, new: DataFrame, keys: list[str], order: list[Column] | None = None) -> None:
    """Merge new rows into the table of a folder, by key.

    Rows are kept in buckets by the hash of their key.  Only buckets with new rows
    are written again, beside the old ones; a version file that lists the part of
    every bucket then appears by one rename.  Readers see the old version or the new
    one, always whole; a failure before the rename leaves the old one.
    """
    spark = new.sparkSession
    number, manifest = _manifest(spark, folder)
    version = number + 1
    bucket = F.pmod(F.xxhash64(*keys), F.lit(manifest["buckets"])).cast("int")
    fresh = new.withColumn("_qg_bucket", bucket)
    touched = [r[0] for r in fresh.where(F.col("_qg_bucket").isNotNull()).select("_qg_bucket").distinct().collect()]  # at most the number of buckets
    old = [f"{folder}/{manifest['parts'][str(b)]}" for b in touched if str(b) in manifest["parts"]]
    stored = spark.read.parquet(*old) if old else None
    merged = upsert(stored, fresh, [*keys, "_qg_bucket"], order)
    merged.repartition("_qg_bucket").withColumn("part", F.col("_qg_bucket")).write.mode("overwrite").partitionBy("part").parquet(f"{folder}/data-{version}")
    fs, path = _files(spark, folder)
    parts = manifest["parts"] | {str(b): f"data-{version}/part={b}" for b in touched if fs.exists(path(f"{folder}/data-{version}/part={b}"))}
    text = json.dumps({"buckets": manifest["buckets"], "parts": parts})
    draft = path(f"{folder}/draft-{version}")
    out = fs.create(draft, True)
    out.write(text.encode())
    out.close()
    if not fs.rename(draft, path(f"{folder}/version-{version}.json")):
        raise RuntimeError(f"version {version} of {folder} was written by somebody else")


#: Publications with more names than this are searched along the links, not by pairs of their names.
CROWD = 1024
#: Largest table of link marks: 2**MARK_BITS bits.
MARK_BITS = 29
#: Pairs that a task looks up at once.
PAIRS_AT_ONCE = 2_000_000
#: Names that a task holds, and pairs that it hands out at once.
ROWS_HELD, ROWS_OUT = 300_000, 100_000


def flatten_graph(located: DataFrame, links: DataFrame) -> DataFrame:
    """Distinct (subject, predicate, object, pmid) of links whose both ends are located in the same publication.

    ``located``: (name, pmid); ``links``: (subject, predicate, object).
    Names meet inside their publication.  A table of bits tells pairs that can be a link
    before they leave the task; what passes is joined to the links.
    """
    spark = links.sparkSession
    scratch = Scratch(spark, "flatten")
    links = scratch.keep(links.select("subject", "predicate", "object").where("subject is not null and object is not null").distinct())
    names, seen = scratch.keep_counted(links.select(F.col("subject").alias("name")).union(links.select("object")).distinct(), n=F.count("*"))
    n_names = seen["n"]
    names = _numbered(scratch, names)
    links = scratch.keep(links.join(names.select(F.col("name").alias("subject"), F.col("i").alias("s")), "subject").join(names.select(F.col("name").alias("object"), F.col("i").alias("o")), "object").select(
        "subject", "predicate", "object", "s", "o", (F.col("s") * n_names + F.col("o")).alias("pair")))
    ends, seen = scratch.keep_counted(links.select("s", "o", "pair").distinct(), n=F.count("*"))
    there = located.select("name", "pmid").where("name is not null and pmid is not null").join(names, "name").select("i", "pmid")
    crowded = scratch.keep(there.groupBy("pmid").agg(F.count("*").alias("n")).where(F.col("n") > CROWD).select("pmid"))

    size = min(MARK_BITS, max(10, (16 * seen["n"]).bit_length()))
    marks = ends.select("pair").mapInArrow(_marker(size), "word bigint, bits bigint")
    marks = marks.groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()  # at most 2**MARK_BITS bits
    table = np.zeros(1 << size - 6, np.int64)
    table[marks["word"].to_numpy()] = marks["bits"].to_numpy()
    shared = spark.sparkContext.broadcast(table)
    few = there.join(crowded, "pmid", "left_anti").repartition("pmid").sortWithinPartitions("pmid", "i")
    met = few.mapInArrow(_pairer(shared, size, n_names), f"pair bigint, pmid {dict(there.dtypes)['pmid']}")
    many = scratch.keep(there.join(crowded, "pmid", "left_semi").distinct())
    along = ends.join(many.withColumnRenamed("i", "s"), "s").join(many.withColumnRenamed("i", "o"), ["o", "pmid"], "left_semi")
    return met.unionByName(along.select("pair", "pmid")).join(links, "pair").select("subject", "predicate", "object", "pmid")


def _numbered(scratch: Scratch, names: DataFrame) -> DataFrame:
    """``name, i``: numbers from 0 without gaps."""
    part = scratch.keep(names.select("name", F.monotonically_increasing_id().alias("i")))
    first, offset = {}, 0
    for k, n in sorted(part.groupBy(F.shiftright("i", 33).alias("k")).count().collect()):  # one row for each partition
        first[k], offset = offset, offset + n
    if not first:
        return part
    base = F.element_at(F.create_map(*[F.lit(x) for kv in first.items() for x in kv]).cast("map<bigint,bigint>"), F.shiftright("i", 33))
    return scratch.keep(part.select("name", (F.col("i").bitwiseAND((1 << 33) - 1) + base).alias("i")))


def _place(pair: np.ndarray, size: int) -> np.ndarray:
    """Bit of a pair in the table of marks."""
    x = pair.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    return x >> np.uint64(64 - size)


def _marker(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = _place(b.column("pair").to_numpy(), size)
            bits = (np.uint64(1) << (at & np.uint64(63))).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(6)).view(np.int64)), pa.array(bits)], ["word", "bits"])

    return run


def _pairer(shared, size: int, n_names: int):
    """Pairs of names of one publication that are marked; rows come sorted by publication and name."""

    def marked(i: np.ndarray, start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Marked pairs of some groups, and a row of each."""
        each = np.repeat(n, n)  # rows of the group of every row
        left = np.repeat(np.arange(len(each)), each)
        right = np.arange(len(left)) - np.repeat(np.cumsum(each) - each, each) + np.repeat(np.repeat(start - start[0], n), each)
        own = i[start[0]:start[0] + len(each)]
        pair = own[left] * n_names + own[right]
        at = _place(pair, size)
        hit = np.flatnonzero((shared.value[(at >> np.uint64(6)).view(np.int64)].view(np.uint64) >> (at & np.uint64(63))) & np.uint64(1))
        return pair[hit], left[hit] + start[0]

    def found(t: pa.Table, start: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Marked pairs and their publications, in order of the pairs."""
        i, total, parts, k = t["i"].to_numpy(), np.cumsum(n * n), [], 0
        while k < len(n):
            to = max(k + 1, int(np.searchsorted(total, (total[k - 1] if k else 0) + PAIRS_AT_ONCE, "right")))
            parts.append(marked(i, start[k:to], n[k:to]))
            k = to
        if not parts:
            return
        pair, row = (np.concatenate(x) for x in zip(*parts))
        order = np.argsort(pair, kind="stable")
        pair, row = pair[order], row[order]
        for k in range(0, len(pair), ROWS_OUT):
            yield pa.RecordBatch.from_arrays([pa.array(pair[k:k + ROWS_OUT]), t["pmid"].take(pa.array(row[k:k + ROWS_OUT])).combine_chunks()], ["pair", "pmid"])

    def once(t: pa.Table) -> pa.Table:
        """Without repeated rows, which follow each other."""
        same = pc.and_(pc.equal(t["pmid"].slice(1), t["pmid"].slice(0, len(t) - 1)), pc.equal(t["i"].slice(1), t["i"].slice(0, len(t) - 1))).to_numpy()
        return t.filter(pa.array(np.concatenate([[True], ~same.astype(bool)])))

    def groups(t: pa.Table, last: bool) -> tuple[np.ndarray, np.ndarray, int]:
        """Starts and sizes of the whole groups, and where the open one begins."""
        new = pc.not_equal(t["pmid"].slice(1), t["pmid"].slice(0, len(t) - 1)).to_numpy()
        start = np.concatenate([[0], np.flatnonzero(new) + 1])
        n = np.diff(np.append(start, len(t)))
        return (start, n, len(t)) if last else (start[:-1], n[:-1], int(start[-1]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for b in chain(batches, [None]):
            if b is not None:
                held.append(pa.Table.from_batches([b]))
                rows += len(b)
                if rows < ROWS_HELD:
                    continue
            if not rows:
                continue
            t = once(pa.concat_tables(held).combine_chunks()).combine_chunks()
            start, n, rest = groups(t, b is None)
            yield from found(t, start, n)
            held = [t.slice(rest)]
            rows = len(held[0])

    return run
