"""Explorations of a graph from many starts at once: level by level, depth first, planned, and connecting paths.

Edges are (src, dst, relation).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions import constants as K
from quillgraph.operators.contains import top_per_key
from quillgraph.operators.graph import path_score, reach

#: Links of a node that a traversal follows.
MAX_NODES = 20
#: Relations that a plan falls back on.
FALLBACK_PLAN = ["treats", "causes", "regulates"]


def first_links(edges: DataFrame, most: int = MAX_NODES) -> DataFrame:
    """``src, dst, relation, k``: the first ``most`` neighbours of every node in the order of their names, each with its smallest relation."""
    one = edges.where("src <> dst").groupBy("src", "dst").agg(F.min("relation").alias("relation"))
    return top_per_key(one, ["src"], [F.col("dst")], most).withColumnRenamed("rank", "k")


def explore_levels(edges: DataFrame, starts: DataFrame, depth: int = 2, most: int = MAX_NODES) -> DataFrame:
    """``start, depth, src, relation, dst``: links of a breadth-first walk, from every node first seen one level up to the next level."""
    links = first_links(edges, most)
    seen = reach(starts, links, depth).union(starts.select("start", F.col("start").alias("node"), F.lit(0).alias("depth")).distinct())
    here = seen.select("start", F.col("node").alias("src"), F.col("depth").alias("up"))
    there = seen.select("start", F.col("node").alias("dst"), "depth")
    return here.where(F.col("up") < depth).join(links, "src").join(there, ["start", "dst"]).where("depth = up + 1").select("start", "depth", "src", "relation", "dst")


def explore_depth_first(edges: DataFrame, starts: DataFrame, depth: int = 2, most: int = MAX_NODES) -> DataFrame:
    """``start, step, depth, src, relation, dst``: links in the order of a depth-first walk that enters each node once.

    A walk sees at most ``most`` ** ``depth`` links, which meet in one row per start.
    """
    links = first_links(edges, most)
    inside = reach(starts, links, max(depth - 1, 0)).select("start", "node").union(starts.select("start", F.col("start").alias("node")).distinct())
    local = inside.select("start", F.col("node").alias("src")).join(links, "src").groupBy("start").agg(F.sort_array(F.collect_list(F.struct("src", "k", "dst", "relation"))).alias("links"))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: list[list] = [[] for _ in range(6)]
            for start, found in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                out: dict[str, list] = {}
                for x in found:
                    out.setdefault(x["src"], []).append((x["dst"], x["relation"]))
                visited, step = {start}, 0
                stack = [(start, 0, iter(out.get(start, ())))]
                while stack:
                    node, level, rest = stack[-1]
                    nxt = next(rest, None)
                    if nxt is None:
                        stack.pop()
                    elif nxt[0] not in visited:
                        for c, v in zip(cols, (start, step, level + 1, node, nxt[1], nxt[0]), strict=True):
                            c.append(v)
                        step += 1
                        if level + 1 < depth:
                            visited.add(nxt[0])
                            stack.append((nxt[0], level + 1, iter(out.get(nxt[0], ()))))
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["start", "step", "depth", "src", "relation", "dst"])

    return local.mapInArrow(walk, "start string, step bigint, depth bigint, src string, relation string, dst string")


def explore_planned(edges: DataFrame, starts: DataFrame, plan: Callable[[DataFrame], DataFrame] | None = None, depth: int = 2, per_relation: int = 5) -> DataFrame:
    """``start, node, depth``: nodes reached along the relations that a plan names for each node.

    ``plan`` maps the nodes (node) to (node, word), at most three words each, as a
    language model would; without one every node has the fallback plan.
    """
    nodes = edges.select(F.col("src").alias("node")).distinct()
    words = plan(nodes) if plan else nodes.select("node", F.explode(F.array(*map(F.lit, FALLBACK_PLAN))).alias("word"))
    words = top_per_key(words.distinct(), ["node"], [F.col("word")], 3).select(F.col("node").alias("src"), "word")
    hits = edges.join(words, "src").where(F.contains(F.col("relation"), F.col("word"))).select("src", "word", "dst").distinct()
    return reach(starts, top_per_key(hits, ["src", "word"], [F.col("dst")], per_relation).select("src", "dst").distinct(), depth)


def expand_queries(queries: DataFrame, context: DataFrame, suggest: Callable[[str, list[str]], list[str]] | None = None, most: int = 5) -> DataFrame:
    """``query_id, rank, query``: follow-up queries for a query and the nodes found for it (query_id, node), by a pluggable model.

    The default asks for the relation of the query with each of the first nodes.
    """
    suggest = suggest or (lambda query, nodes: [f"{query} {n}" for n in nodes])
    kind = dict(queries.dtypes)["query_id"]
    few = top_per_key(context.select("query_id", "node").distinct(), ["query_id"], [F.col("node")], most).groupBy("query_id").agg(F.sort_array(F.collect_list("node")).alias("nodes"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, rank, text = [], [], []
            for n, (query, nodes) in enumerate(zip(b.column("query").to_pylist(), b.column("nodes").to_pylist(), strict=True)):
                for k, q in enumerate(suggest(query, nodes)[:most]):
                    rows.append(n)
                    rank.append(k + 1)
                    text.append(q)
            yield pa.RecordBatch.from_arrays([b.column("query_id").take(pa.array(rows, pa.int64())), pa.array(rank, pa.int64()), pa.array(text, pa.string())], names=["query_id", "rank", "query"])

    return queries.select("query_id", "query").join(few, "query_id").mapInArrow(run, f"query_id {kind}, rank bigint, query string")


def connecting_paths(edges: DataFrame, pairs: DataFrame, enough: int = K.LIMIT_PATHS, best: int = 5) -> DataFrame:
    """``start, end, mid, relations, score, rank``: the ``best`` paths of one or two links between the ends of each pair (start, end).

    Links come first; two-link paths (middle node apart from both ends, at most
    ``enough`` by middle node and relations) are added where there are fewer than ``enough`` links.
    """
    p = pairs.select("start", "end").distinct()
    one = p.join(edges.select(F.col("src").alias("start"), F.col("dst").alias("end"), "relation").distinct(), ["start", "end"]).select("start", "end", F.lit(None).cast("string").alias("mid"), F.array("relation").alias("relations"))
    full = one.groupBy("start", "end").count().where(F.col("count") >= enough)
    left = p.join(full, ["start", "end"], "left_anti")
    first = left.join(edges.select(F.col("src").alias("start"), F.col("dst").alias("mid"), F.col("relation").alias("r1")), "start").where("mid <> start and mid <> end")
    two = first.join(edges.select(F.col("src").alias("mid"), F.col("dst").alias("end"), F.col("relation").alias("r2")), ["mid", "end"]).select("start", "end", "mid", F.array("r1", "r2").alias("relations"))
    few = top_per_key(two, ["start", "end"], [F.col("mid"), F.array_join("relations", "|")], enough).drop("rank")
    scored = one.unionByName(few).withColumn("score", path_score(F.col("relations")))
    w = Window.partitionBy("start", "end").orderBy(F.desc("score"), F.col("mid").asc_nulls_first(), F.array_join("relations", "|"))
    return scored.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= best)
