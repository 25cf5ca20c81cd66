"""Parent-child rows to full hierarchies with nested-set ranges and cycle reports.

Method: subtree sizes are gathered upward, preorder ranges are handed down from
prefix sums over siblings (the roots being siblings of each other), and one sweep
over the ranges in order gives depth and root of every node; ancestors and
descendants follow from the ranges, and nodes whose size is never complete reveal
cycles.  Both directions run by pointer doubling: round k works with 2**k-step
ancestors, so a tree of depth d takes about log2(d) rounds instead of d.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.session import Scratch
from quillgraph.skew import heavy_keys, salted_lookup, segmented_prefix

MAX_ROUNDS = 40  # 2**40 levels
#: Ranges are matched by blocks of up to 2**TOP_BLOCK positions.
TOP_BLOCK = 16


def curie(col: Column) -> Column:
    """``PREFIX:number`` in upper case from CURIE, underscore and IRI notations; null if none fits."""
    prefix = F.regexp_extract(col, r"([A-Za-z]+)[:_]([0-9]+)[>\s]*$", 1)
    number = F.regexp_extract(col, r"([A-Za-z]+)[:_]([0-9]+)[>\s]*$", 2)
    return F.when(number != "", F.concat(F.upper(prefix), F.lit(":"), number))


def links_from_lists(df: DataFrame, node: str, parents: str, children: str) -> DataFrame:
    """Rows (id, parent) from a node column and two list columns, stated on either side.

    Every id that appears anywhere is kept; one without a stated parent has a null
    ``parent``.  Null lists, null entries and ids without a recognisable notation
    are skipped.  The result has one row per id: should data state several parents
    the smallest wins.
    """
    base = df.select(curie(F.col(node)).alias("n"), F.transform(parents, curie).alias("p"), F.transform(children, curie).alias("c"))
    pairs = base.select(F.explode(F.concat(
        F.array(F.struct(F.col("n").alias("id"), F.lit(None).cast("string").alias("parent"))),
        F.coalesce(F.transform("p", lambda x: F.struct(F.col("n").alias("id"), x.alias("parent"))), F.array()),
        F.coalesce(F.transform("p", lambda x: F.struct(x.alias("id"), F.lit(None).cast("string").alias("parent"))), F.array()),
        F.coalesce(F.transform("c", lambda x: F.struct(x.alias("id"), F.col("n").alias("parent"))), F.array()),
    )).alias("e")).select("e.id", "e.parent")
    return pairs.where("id is not null").groupBy("id").agg(F.min("parent").alias("parent"))


def _lookup(state: DataFrame, columns: list[str], total: int) -> DataFrame:
    """``state`` with the ``columns`` of each row's current ancestor ``anc`` as ``o_*``; null where there is none."""
    right = state.select(F.col("id").alias("anc"), *[F.col(c).alias(f"o_{c}") for c in columns])
    heavy = heavy_keys(state.where("anc is not null").groupBy("anc").count(), "anc", "count", total)
    return salted_lookup(state, right, "anc", F.col("id"), heavy, "left")


def hierarchy(links: DataFrame, id_col: str = "id", parent_col: str = "parent", paths: bool = True) -> DataFrame:
    """Every node with root, depth, path, subtree size and nested-set range.

    Input: rows (id, parent), parent null for roots; repeated rows and several
    parents are reduced to the smallest parent; parents that are nowhere an id
    become roots; null ids are dropped; an empty table gives an empty result.

    Output: ``id, parent, root_id, depth, path, n_descendants, lft, rgt``.
    ``lft``/``rgt`` number the nodes of the whole forest in preorder from 0: u is an
    ancestor of v iff ``u.lft < v.lft <= u.rgt``.
    Nodes on a cycle (self-links included) have the smallest id of their cycle as
    root and depth -1, nodes hanging below one take its root and depth -2; for
    both, path, size and range are null.  ``path`` runs from the root to the node
    and is left out with ``paths=False``.
    """
    spark = links.sparkSession
    scratch = Scratch(spark, "hierarchy")
    raw = links.select(F.col(id_col).cast("string").alias("id"), F.col(parent_col).cast("string").alias("parent")).where("id is not null")
    nodes = raw.union(raw.where("parent is not null").select("parent", F.lit(None).cast("string")))
    nodes, seen = scratch.keep_counted(nodes.groupBy("id").agg(F.min("parent").alias("parent")), n=F.count("*"), open=F.count("parent"))
    total, left = seen["n"], seen["open"]

    # upward: size covers the descendants nearer than 2**k; a node is processed once its ancestor is past the root
    state, before = nodes.select("id", "parent", F.col("parent").alias("anc"), F.lit(1).cast("long").alias("size")), None
    while left and left != before:
        gained = state.where("anc is not null").groupBy(F.col("anc").alias("id")).agg(F.sum("size").alias("more"))
        sized = state.join(gained, "id", "left").select("id", "parent", "anc", (F.col("size") + F.coalesce("more", F.lit(0))).alias("size"))
        right = state.select(F.col("id").alias("anc"), F.col("anc").alias("o_anc"))
        heavy = heavy_keys(state.where("anc is not null").groupBy("anc").count(), "anc", "count", total)
        new, seen = scratch.keep_counted(salted_lookup(sized, right, "anc", F.col("id"), heavy, "left").select("id", "parent", F.col("o_anc").alias("anc"), "size"), open=F.count("anc"))
        scratch.drop(state)
        state, before = new, left
        left = seen["open"]
    out = _placed(scratch, state.where("anc is null").select("id", "parent", "size"), total, paths)
    if left:
        none = F.lit(None)
        cyclic = state.where("anc is not null").select("id", "parent")
        out = out.unionByName(_cycles(scratch, cyclic, total).select(
            "id", "parent", "root_id", "depth", none.cast("array<string>").alias("path"),
            *[none.cast("long").alias(c) for c in ("n_descendants", "lft", "rgt")]))
    return out if paths else out.drop("path")


def _placed(scratch: Scratch, tree: DataFrame, total: int, paths: bool) -> DataFrame:
    """Ranges from sibling prefix sums handed down, then depth and root from a sweep over the ranges."""
    own = tree.select("id", "parent", "size", F.coalesce("parent", F.lit("\x00")).alias("group"))
    start = segmented_prefix(own, ["group"], ["id"], F.col("size"), "before").select(
        "id", "parent", "size", F.col("parent").alias("anc"), (F.col("before") + F.when(F.col("parent").isNull(), 0).otherwise(1)).cast("long").alias("lft"),
        (F.array("id") if paths else F.array().cast("array<string>")).alias("path"))
    pos, seen = scratch.keep_counted(start, open=F.count("anc"))
    while seen["open"]:
        far = _lookup(pos, ["anc", "lft", *(["path"] if paths else [])], total)
        new, seen = scratch.keep_counted(far.select(
            "id", "parent", "size", F.col("o_anc").alias("anc"), (F.col("lft") + F.coalesce("o_lft", F.lit(0))).alias("lft"),
            (F.when(F.col("o_path").isNull(), F.col("path")).otherwise(F.concat("o_path", "path")) if paths else F.col("path")).alias("path")), open=F.count("anc"))
        scratch.drop(pos)
        pos = new
    none = F.lit(None)
    events = pos.select(F.col("lft").alias("pos"), F.lit(1).alias("kind"), "id", "parent", "size", "path").unionByName(pos.select(
        (F.col("lft") + F.col("size")).alias("pos"), F.lit(0).alias("kind"), none.cast("string").alias("id"), none.cast("string").alias("parent"),
        none.cast("long").alias("size"), none.cast("array<string>").alias("path")))
    swept = scratch.keep(events.repartitionByRange("pos", "kind").sortWithinPartitions("pos", "kind").mapInArrow(
        _sweep, "part int, id string, parent string, level bigint, root_id string, lft bigint, size bigint, path array<string>"))
    # one row for each partition
    base, level, root = [], 0, None
    for r in sorted(swept.where("id is null").select("part", "level", "root_id").collect()):
        base.append((r.part, level, root))
        level, root = level + r.level, r.root_id or root
    begin = scratch.spark.createDataFrame(base, "part int, above bigint, last_root string")
    return swept.where("id is not null").join(F.broadcast(begin), "part").select(
        "id", "parent", F.coalesce("root_id", "last_root").alias("root_id"), (F.col("level") + F.col("above")).alias("depth"), "path",
        (F.col("size") - 1).alias("n_descendants"), "lft", (F.col("lft") + F.col("size") - 1).alias("rgt"))


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Open ranges and the last root before every start, within one partition; a last row gives both for its end."""
    part, level, root = TaskContext.get().partitionId(), 0, None
    names = ["part", "id", "parent", "level", "root_id", "lft", "size", "path"]
    kinds = [pa.int32(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.string())]
    for b in batches:
        if not b.num_rows:
            continue
        starts = b.column("kind").to_numpy(zero_copy_only=False) == 1
        delta = np.where(starts, 1, -1)
        open_ = level + np.cumsum(delta) - delta
        level += int(delta.sum())
        is_root = starts & b.column("parent").is_null().to_numpy(zero_copy_only=False)
        at = np.maximum.accumulate(np.where(is_root, np.arange(len(starts)), -1))
        roots = b.column("id").take(pa.array(np.maximum(at, 0)))
        if at[0] < 0:
            roots = pa.array([root if k < 0 else x for k, x in zip(at.tolist(), roots.to_pylist(), strict=True)], pa.string())
        root = roots[len(starts) - 1].as_py()
        keep = pa.array(starts)
        cols = [pa.array(np.full(len(starts), part, np.int32)), b.column("id"), b.column("parent"), pa.array(open_), roots, b.column("pos"), b.column("size"), b.column("path")]
        yield pa.RecordBatch.from_arrays([c.filter(keep).cast(t) for c, t in zip(cols, kinds, strict=True)], names=names)
    yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((part, None, None, level, root, None, None, None), kinds, strict=True)], names=names)


def _cycles(scratch: Scratch, cyclic: DataFrame, total: int) -> DataFrame:
    """Cycle members and their tails among nodes without a root.

    The image of the 2**k-step map shrinks to exactly the cycle members, and the
    smallest id within 2**k steps of a member settles to the smallest of its cycle;
    both are settled once a round changes neither.
    """
    state = cyclic.select("id", "parent", F.col("parent").alias("anc"), F.col("id").alias("low"))
    before = None
    for _ in range(MAX_ROUNDS):
        state = scratch.keep(_lookup(state, ["anc", "low"], total).select("id", "parent", F.col("o_anc").alias("anc"), F.least("low", "o_low").alias("low")))
        mark = state.agg(F.count_distinct("anc"), F.sum(F.xxhash64("id", "low").cast("decimal(38,0)"))).first()
        if mark == before:
            break
        before = mark
    members = state.select(F.col("anc").alias("id")).distinct().withColumn("member", F.lit(True))
    marked = state.join(members, "id", "left")
    # the ancestor of a node off the cycle stands on it
    return _lookup(marked, ["low"], total).select("id", "parent", F.when(F.col("member"), F.col("low")).otherwise(F.col("o_low")).alias("root_id"),
                                                  F.when(F.col("member"), F.lit(-1)).otherwise(F.lit(-2)).cast("long").alias("depth"))


def _blocks(lo: Column, hi: Column, top: int) -> Column:
    """Fewest blocks ``(level, block)`` of 2**level positions, level at most ``top``, that make up [lo, hi)."""
    none = F.array().cast("array<struct<level:int,block:bigint>>")
    one = lambda j, x: F.array(F.struct(j.cast("int").alias("level"), x.cast("long").alias("block")))

    def step(acc, j):
        live = acc["lo"] < acc["hi"]
        odd_lo, odd_hi = live & (acc["lo"] % 2 == 1), live & (acc["hi"] % 2 == 1)
        a = acc["lo"] + F.when(odd_lo, 1).otherwise(0)
        b = acc["hi"] - F.when(odd_hi, 1).otherwise(0)
        return F.struct(F.shiftright(a, 1).cast("long").alias("lo"), F.shiftright(b, 1).cast("long").alias("hi"), F.concat(
            acc["out"], F.when(odd_lo, one(j, acc["lo"])).otherwise(none), F.when(odd_hi & (b >= a), one(j, b)).otherwise(none)).alias("out"))

    start = F.struct(lo.cast("long").alias("lo"), hi.cast("long").alias("hi"), none.alias("out"))
    done = F.aggregate(F.sequence(F.lit(0), F.lit(top - 1)), start, step) if top else start
    rest = F.when(done["lo"] < done["hi"], F.transform(F.sequence(done["lo"], done["hi"] - 1), lambda x: F.struct(F.lit(top).alias("level"), x.alias("block")))).otherwise(none)
    return F.concat(done["out"], rest)


def descendants_of(tree: DataFrame, wanted: DataFrame | None = None, id_col: str = "id") -> DataFrame:
    """``ancestor, descendant, distance`` by nested-set ranges, of all nodes or of the ids in ``wanted``.

    Every range is cut into blocks of powers of two and every position knows the
    blocks it lies in, so a pair meets once, in an equi-join; no block holds more
    than 2**TOP_BLOCK positions, whatever the size of a tree.
    """
    nodes = tree.where("lft is not null").select("id", "depth", "lft", "rgt")
    top = nodes if wanted is None else nodes.join(wanted.select(F.col(id_col).alias("id")).distinct(), "id", "left_semi")
    widest = top.agg(F.max(F.col("rgt") - F.col("lft")).alias("n")).first()["n"] or 0
    level = min(TOP_BLOCK, int(widest).bit_length())
    ranges = top.where("rgt > lft").select(F.col("id").alias("ancestor"), F.col("depth").alias("up"), F.explode(_blocks(F.col("lft") + 1, F.col("rgt") + 1, level)).alias("b")).select(
        "ancestor", "up", "b.level", "b.block")
    points = nodes.select(F.col("id").alias("descendant"), "depth", F.explode(F.transform(F.sequence(F.lit(0), F.lit(level)), lambda j: F.struct(
        j.alias("level"), F.call_function("shiftright", F.col("lft"), j).alias("block")))).alias("b")).select("descendant", "depth", "b.level", "b.block")
    return ranges.join(points, ["level", "block"]).select("ancestor", "descendant", (F.col("depth") - F.col("up")).alias("distance"))
