"""Connected components by local forests and randomised contraction.

Before every round each task replaces the edges it holds, in chunks of bounded
size, by stars of the same connectivity (union-find), which needs no shuffle.
The round then maps each node to the neighbour (or itself) with the smallest rank,
relabels the edges and drops loops and repeats; ranks are the ids first, which
ends a star at once, and fresh hashes later, so that a constant share of the nodes
disappears per round in expectation, whatever the shape of the graph (long chains
included).  The maps are then composed backwards.  Hubs are safe: the minimum is
combined map-side and look-ups of heavy nodes are salted.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.session import Scratch
from quillgraph.skew import heavy_keys, salted_lookup

MAX_ROUNDS = 60
#: Edges that one union-find holds.
CHUNK = 200_000


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks of edges as (node, smallest node of its component in the chunk)."""
    up: dict = {}
    held = 0

    def find(x):
        root = x
        while up[root] != root:
            root = up[root]
        while up[x] != root:
            up[x], x = root, up[x]
        return root

    def flush(schema: pa.Schema) -> pa.RecordBatch:
        rows = [(x, r) for x in up if (r := find(x)) != x]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], schema.field(k).type) for k in range(2)], names=["u", "v"])

    schema = None
    for b in batches:
        schema = b.schema
        for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if x not in up:
                up[x] = x
            if y not in up:
                up[y] = y
            x, y = find(x), find(y)
            if x < y:
                up[y] = x
            elif y < x:
                up[x] = y
        held += b.num_rows
        if held >= CHUNK:
            yield flush(schema)
            up.clear()
            held = 0
    if up:
        yield flush(schema)


def components(edges: DataFrame, src: str = "src", dst: str = "dst", nodes: DataFrame | None = None, node_col: str = "id") -> DataFrame:
    """``id, component``: every node with the smallest id of its (weakly) connected component.

    Direction, repeated edges and self-links do not matter; rows with a null end
    are dropped.  ``nodes`` adds nodes without edges.  Empty input gives no rows.
    """
    scratch = Scratch(edges.sparkSession, "components")
    e = scratch.keep(edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null").distinct())
    every = e.select(F.col("u").alias("id")).union(e.select("v"))
    if nodes is not None:
        every = every.union(nodes.select(F.col(node_col).alias("id")).where("id is not null"))
    ddl = f"u {dict(e.dtypes)['u']}, v {dict(e.dtypes)['v']}"
    cur, seen = scratch.keep_counted(e.where("u <> v").mapInArrow(_stars, ddl), n=F.count("*"))
    maps: list[tuple[DataFrame, int]] = []
    for r in range(MAX_ROUNDS):
        if seen["n"] == 0:
            break
        both = cur.select("u", "v").union(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        rank = lambda c, r=r: F.struct((F.xxhash64(c, F.lit(r)) if r else F.lit(0)).alias("h"), F.col(c).alias("n"))
        to = both.groupBy("u").agg(F.min(rank("v")).alias("m"), F.count("*").alias("deg")).select(
            "u", F.least(F.col("m"), rank("u"))["n"].alias("to"), "deg")
        to, counted = scratch.keep_counted(to, n=F.count("*"))
        maps.append((to, counted["n"]))
        heavy = heavy_keys(to, "u", "deg", 2 * seen["n"])
        look = to.select("u", "to")
        a = salted_lookup(cur, look, "u", F.col("v"), heavy).select(F.col("to").alias("x"), "v")
        b = salted_lookup(a.withColumnRenamed("v", "u"), look, "u", F.col("x"), heavy).select("x", F.col("to").alias("y"))
        new = b.where("x <> y").select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v")).distinct().mapInArrow(_stars, ddl)
        new, seen = scratch.keep_counted(new, n=F.count("*"))
        scratch.drop(cur)
        cur = new
    label: DataFrame | None = None  # node of a later round -> final node
    for to, n in reversed(maps):
        if label is None:
            label = to.select(F.col("u").alias("id"), F.col("to").alias("rep"))
        else:
            # nodes that fell out of later rounds are final themselves
            many = heavy_keys(to.groupBy("to").count(), "to", "count", n)
            hop = salted_lookup(to.select("u", "to"), label.select(F.col("id").alias("to"), "rep"), "to", F.col("u"), many, "left")
            label = scratch.keep(hop.select(F.col("u").alias("id"), F.coalesce("rep", "to").alias("rep")))
    ids = every.distinct()
    if label is None:
        return ids.select("id", F.col("id").alias("component"))
    reps, counted = scratch.keep_counted(ids.join(label, "id", "left").select("id", F.coalesce("rep", "id").alias("rep")), n=F.count("*"))
    low = reps.groupBy("rep").agg(F.min("id").alias("component"), F.count("*").alias("n"))
    big = heavy_keys(low, "rep", "n", counted["n"])
    return salted_lookup(reps, low.select("rep", "component"), "rep", F.col("id"), big).select("id", "component")
