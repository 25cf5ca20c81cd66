"""Graph operators over edge tables (src, dst[, relation]).

Traversals from many starts carry (start, node) pairs and advance level by
level; each level is one join on the frontier and ends in a durable table.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions import constants as K
from quillgraph.operators.components import components
from quillgraph.session import Scratch


def last_edges(edges: DataFrame, order: str) -> DataFrame:
    """One edge per (src, dst): the one written last (largest ``order``)."""
    rest = [c for c in edges.columns if c not in ("src", "dst", order)]
    best = edges.groupBy("src", "dst").agg(F.max_by(F.struct(*rest), F.col(order)).alias("e"))
    return best.select("src", "dst", *[F.col(f"e.{c}").alias(c) for c in rest])


def undirected(edges: DataFrame) -> DataFrame:
    """Both directions of every edge, distinct, without self-links: ``a, b``."""
    return edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).union(edges.select(F.col("dst").alias("a"), F.col("src").alias("b"))).where("a <> b").distinct()


def neighbours(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``id, n_parents, n_children, parents, children``: sorted lists of in- and out-neighbours."""
    up = edges.groupBy(F.col("dst").alias("id")).agg(F.sort_array(F.collect_set("src")).alias("parents"))
    down = edges.groupBy(F.col("src").alias("id")).agg(F.sort_array(F.collect_set("dst")).alias("children"))
    none = F.array().cast("array<string>")
    out = nodes.select("id").join(up, "id", "left").join(down, "id", "left").select("id", F.coalesce("parents", none).alias("parents"), F.coalesce("children", none).alias("children"))
    return out.withColumns({"n_parents": F.size("parents"), "n_children": F.size("children")})


def degrees(edges: DataFrame) -> DataFrame:
    """``id, degree``: number of links of every node, both directions."""
    return edges.select(F.col("src").alias("id")).union(edges.select("dst")).groupBy("id").agg(F.count("*").alias("degree"))


def reach(starts: DataFrame, edges: DataFrame, max_depth: int | None = None) -> DataFrame:
    """``start, node, depth``: every node reachable from each start along the edges, at its smallest depth; cycle-safe.

    ``starts`` has a column ``start``.  The start itself is not in its result, even on a cycle.
    """
    spark = edges.sparkSession
    scratch = Scratch(spark, "reach")
    e = scratch.keep(edges.select("src", "dst").distinct())
    front = starts.select("start", F.col("start").alias("node")).distinct()
    seen = scratch.keep(front.withColumn("depth", F.lit(0)))
    front = seen.select("start", "node")
    depth = 0
    while max_depth is None or depth < max_depth:
        depth += 1
        step = front.join(e, front["node"] == e["src"]).select("start", F.col("dst").alias("node")).distinct()
        new = scratch.keep(step.join(seen.select("start", "node"), ["start", "node"], "left_anti").withColumn("depth", F.lit(depth)))
        if new.isEmpty():
            break
        seen = seen.union(new)
        front = new.select("start", "node")
    return seen.where("depth > 0")


def closure(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """``start, node, depth``: all pairs reachable along the edges with their smallest depth, by doubling (log2 of the depth rounds)."""
    scratch = Scratch(edges.sparkSession, "closure")
    c = scratch.keep(edges.where("src <> dst").select(F.col("src").alias("start"), F.col("dst").alias("node"), F.lit(1).cast("long").alias("depth")).distinct())
    before = None
    for _ in range(max_rounds):
        far = c.alias("x").join(c.alias("y"), F.col("x.node") == F.col("y.start")).select("x.start", "y.node", (F.col("x.depth") + F.col("y.depth")).alias("depth")).where("start <> node")
        new = scratch.keep(c.union(far).groupBy("start", "node").agg(F.min("depth").alias("depth")))
        mark = new.agg(F.count("*").alias("n"), F.sum("depth").alias("s")).first()
        scratch.drop(c)
        c = new
        if mark == before:
            break
        before = mark
    return c


def semantic_similarity(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """``a, b, similarity`` of node pairs: Jaccard of their ancestor sets, each node in its own set; edges run parent to child."""
    both = pairs.select(F.col("a").alias("start")).union(pairs.select("b")).distinct()
    up = closure(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).join(both, "start", "left_semi")
    own = up.select("start", "node").union(both.select("start", F.col("start").alias("node")))
    size = own.groupBy("start").agg(F.count("*").alias("n"))
    p = pairs.select("a", "b").distinct()
    hit = p.join(own.select(F.col("start").alias("a"), "node"), "a").join(own.select(F.col("start").alias("b"), "node"), ["b", "node"]).groupBy("a", "b").agg(F.count("*").alias("i"))
    return (p.join(hit, ["a", "b"], "left").join(size.select(F.col("start").alias("a"), F.col("n").alias("na")), "a").join(size.select(F.col("start").alias("b"), F.col("n").alias("nb")), "b")
            .select("a", "b", (F.coalesce("i", F.lit(0)) / (F.col("na") + F.col("nb") - F.coalesce("i", F.lit(0)))).alias("similarity")))


def shortest_paths(pairs: DataFrame, edges: DataFrame, max_depth: int | None = None) -> DataFrame:
    """``a, b, hops, path`` of node pairs on the undirected graph; of equally short paths the smallest one; unreachable pairs give no row, nor do pairs further apart than ``max_depth`` if it is given.

    Up to two links are found by looking for a common neighbour among those of the end
    that has fewer.  Pairs further apart are searched level by level from the end that
    more of them share, so pairs with one end in common cost one search.
    """
    spark = edges.sparkSession
    scratch = Scratch(spark, "paths")
    e = scratch.keep(undirected(edges))
    todo = scratch.keep(pairs.select("a", "b").where("a is not null and b is not null").distinct())
    found = _near_paths(todo, e, 2 if max_depth is None else min(2, max_depth))
    if max_depth is not None and max_depth <= 2:
        return found
    found = scratch.keep(found)
    rest = todo.join(found, ["a", "b"], "left_anti")
    as_a, as_b = rest.groupBy("a").agg(F.count("*").alias("n_a")), rest.groupBy("b").agg(F.count("*").alias("n_b"))
    todo, seen_todo = scratch.keep_counted(rest.join(as_a, "a").join(as_b, "b").withColumn("back", F.col("n_b") > F.col("n_a")).select(
        "a", "b", "back", F.when(F.col("back"), F.col("b")).otherwise(F.col("a")).alias("start"), F.when(F.col("back"), F.col("a")).otherwise(F.col("b")).alias("node")), n=F.count("*"))
    if not seen_todo["n"]:
        return found
    key = ["start", "back", "node"]
    front = scratch.keep(todo.select("start", "back").distinct().select("start", "back", F.col("start").alias("node"), F.array("start").alias("path")))
    before = front.select(key).limit(0)
    link = e.select(F.col("a").alias("node"), F.col("b").alias("to"))
    for depth in count(1) if max_depth is None else range(1, max_depth + 1):
        live = todo.select("start", "back").distinct()
        step = front.join(live, ["start", "back"], "left_semi").join(link, "node").select("start", "back", F.col("to").alias("node"), "path")
        step = step.join(front.select(key).union(before), key, "left_anti")  # links lead at most one level back
        new, reached = scratch.keep_counted(step.groupBy(key).agg(F.min("path").alias("path")).select(
            *key, F.when(F.col("back"), F.concat(F.array("node"), "path")).otherwise(F.concat("path", F.array("node"))).alias("path")), n=F.count("*"))
        if not reached["n"]:
            break
        before, front = front.select(key), new
        if depth <= 2:
            continue
        found = found.union(todo.join(front, key).select("a", "b", F.lit(depth).alias("hops"), "path"))
        todo, seen_todo = scratch.keep_counted(todo.join(front.select(key), key, "left_anti"), n=F.count("*"))
        if not seen_todo["n"]:
            break
        if depth % 8 == 7:  # one table instead of a growing union
            found = scratch.keep(found)
    return found


def _near_paths(pairs: DataFrame, e: DataFrame, most: int) -> DataFrame:
    """``a, b, hops, path`` of the pairs at most ``most`` <= 2 links apart; ``e`` has both directions of every edge as ``a, b``."""
    found = pairs.where("a = b").select("a", "b", F.lit(0).alias("hops"), F.array("a").alias("path"))
    if most >= 1:
        found = found.union(pairs.join(e, ["a", "b"], "left_semi").select("a", "b", F.lit(1).alias("hops"), F.array("a", "b").alias("path")))
    if most >= 2:
        n = e.groupBy("a").agg(F.count("*").alias("n"))
        p = pairs.where("a <> b").join(e, ["a", "b"], "left_anti").join(n.withColumnRenamed("n", "n_a"), "a").join(n.select(F.col("a").alias("b"), F.col("n").alias("n_b")), "b")
        p = p.select("a", "b", F.when(F.col("n_a") <= F.col("n_b"), F.col("a")).otherwise(F.col("b")).alias("x"), F.when(F.col("n_a") <= F.col("n_b"), F.col("b")).otherwise(F.col("a")).alias("y"))
        mid = p.join(e.select(F.col("a").alias("x"), F.col("b").alias("mid")), "x").join(e.select(F.col("a").alias("mid"), F.col("b").alias("y")), ["mid", "y"], "left_semi")
        found = found.union(mid.groupBy("a", "b").agg(F.min("mid").alias("mid")).select("a", "b", F.lit(2).alias("hops"), F.array("a", "mid", "b").alias("path")))
    return found


def tree_paths(tree: DataFrame, edges: DataFrame) -> DataFrame:
    """``a, b, hops, path`` from every node to its root, for the components that are trees: there the way up is the only path.

    ``tree``: ``id, parent, root_id, path`` below the roots, as ``hierarchy`` gives them.
    Components with a link besides those to the parents are left out.
    """
    more = edges.select("src", "dst").join(tree.select(F.col("parent").alias("src"), F.col("id").alias("dst")), ["src", "dst"], "left_anti")
    ends = more.select(F.col("src").alias("id")).union(more.select("dst")).distinct()
    mixed = tree.select("id", "root_id").join(ends, "id", "left_semi").select("root_id").union(ends).distinct()
    return tree.join(mixed, "root_id", "left_anti").select(
        F.col("id").alias("a"), F.col("root_id").alias("b"), (F.size("path") - 1).alias("hops"), F.reverse("path").alias("path"))


def induced(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges whose both ends are in ``nodes`` (column ``id``)."""
    keep = nodes.select("id").distinct()
    return edges.join(keep.withColumnRenamed("id", "src"), "src", "left_semi").join(keep.withColumnRenamed("id", "dst"), "dst", "left_semi")


def one_hop_subgraph(terms: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges of the subgraph induced by the terms and their direct neighbours."""
    e = undirected(edges)
    around = terms.select("id").union(e.join(terms.select(F.col("id").alias("a")), "a", "left_semi").select("b")).distinct()
    return induced(around, edges)


def two_hop_paths(edges: DataFrame, starts: DataFrame, limit: int = K.LIMIT_PATHS) -> DataFrame:
    """``start, mid, end, relations, score``: up to ``limit`` two-step paths per (start, end), distinct nodes, best score first."""
    one = edges.join(starts.select(F.col("start").alias("src")), "src", "left_semi").select(F.col("src").alias("start"), F.col("dst").alias("mid"), F.col("relation").alias("r1"))
    two = one.join(edges.select(F.col("src").alias("mid"), F.col("dst").alias("end"), F.col("relation").alias("r2")), "mid").where("start <> end and mid <> end and mid <> start")
    scored = two.select("start", "mid", "end", F.array("r1", "r2").alias("relations")).withColumn("score", path_score(F.col("relations")))
    w = Window.partitionBy("start", "end").orderBy(F.desc("score"), "mid", F.array_join("relations", "|"))
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def path_score(relations: Column) -> Column:
    """Score of a path by length and by relations that carry mechanism."""
    n = F.size(relations)
    length = F.when(n == 1, F.lit(1.2)).when(n == 2, F.lit(1.0)).otherwise(F.pow(F.lit(0.8), (n - 2).cast("double")))
    bonus = F.aggregate(relations, F.lit(1.0), lambda acc, r: acc * F.when(
        F.greatest(*[F.contains(F.lower(r), F.lit(b)).cast("int") for b in K.BONUS_RELATIONS]) == 1, F.lit(1.3)).otherwise(F.lit(1.0)))
    return length * bonus


def targeted_traversal(edges: DataFrame, starts: DataFrame, relations: list[str] = K.PRIORITY_RELATIONS, per_relation: int = 5, depth: int = 2) -> DataFrame:
    """``start, node, depth``: nodes within ``depth`` steps along edges whose relation contains a wanted word, at most ``per_relation`` per node and word."""
    words = F.array(*map(F.lit, relations))
    hits = edges.select("src", "dst", F.explode(F.filter(words, lambda w: F.contains(F.col("relation"), w))).alias("word")).distinct()
    w = Window.partitionBy("src", "word").orderBy("dst")
    few = hits.withColumn("k", F.row_number().over(w)).where(F.col("k") <= per_relation).select("src", "dst").distinct()
    return reach(starts, few, depth)


def pagerank(seeds: DataFrame, edges: DataFrame, damping: float = 0.8, rounds: int = 30, tolerance: float = 1e-6) -> DataFrame:
    """``id, score``: personalised PageRank on the undirected graph, restart uniform over the seeds that are in the graph.

    Scores sum to 1; no valid seed gives no rows.  Iterates until the total change
    is below ``tolerance`` times the number of nodes, at most ``rounds`` times.
    """
    spark = edges.sparkSession
    scratch = Scratch(spark, "pagerank")
    e = undirected(edges)
    out = e.groupBy("a").agg(F.count("*").alias("deg"))
    link = scratch.keep(e.join(out, "a").select("a", "b", (F.lit(1.0) / F.col("deg")).alias("w")))
    nodes = link.select(F.col("a").alias("id")).distinct()
    start = nodes.join(seeds.select("id").distinct(), "id", "left_semi").withColumn("seed", F.lit(1))
    n_seeds = start.count()
    if not n_seeds:
        return nodes.select("id", F.lit(0.0).alias("score")).limit(0)
    base = scratch.keep(nodes.join(start, "id", "left").select("id", F.when(F.col("seed") == 1, F.lit(1.0 / n_seeds)).otherwise(F.lit(0.0)).alias("restart")))
    n = base.count()
    score = base.select("id", F.col("restart").alias("score"))
    for _ in range(rounds):
        got = link.join(score.withColumnRenamed("id", "a"), "a").groupBy(F.col("b").alias("id")).agg(F.sum(F.col("score") * F.col("w")).alias("in"))
        new = base.join(got, "id", "left").join(score.withColumnRenamed("score", "old"), "id").select(
            "id", (F.coalesce("in", F.lit(0.0)) * damping + F.col("restart") * (1 - damping)).alias("score"), "old")
        new = scratch.keep(new)
        change = new.agg(F.sum(F.abs(F.col("score") - F.col("old")))).first()[0]
        score = new.select("id", "score")
        if change < tolerance * n:
            break
    return score


def graph_statistics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``ontology, n_terms, n_links, n_components``: per ontology, and for all with ontology ``all``."""
    comp = components(edges, nodes=nodes).select(F.col("component")).distinct().agg(F.count("*").alias("n_components"))
    per = nodes.groupBy("ontology").agg(F.count("*").alias("n_terms"))
    links = edges.join(nodes.select(F.col("id").alias("src"), "ontology"), "src").groupBy("ontology").agg(F.count("*").alias("n_links"))
    one = per.join(links, "ontology", "left").select("ontology", "n_terms", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.lit(None).cast("long").alias("n_components"))
    # one row each
    total = nodes.agg(F.count("*").alias("n_terms")).join(edges.agg(F.count("*").alias("n_links")), F.lit(True)).join(comp, F.lit(True)).select(
        F.lit("all").alias("ontology"), "n_terms", "n_links", "n_components")
    return one.unionByName(total)


def message_passing(features: DataFrame, edges: DataFrame, vector: str = "vector") -> DataFrame:
    """``id, vector``: sum of the vectors of all in-neighbours (one step of message passing), element by element."""
    sent = edges.join(features.select(F.col("id").alias("src"), F.col(vector).alias("v")), "src").select("dst", F.posexplode("v").alias("k", "x"))
    return sent.groupBy("dst", "k").agg(F.sum("x").alias("x")).groupBy(F.col("dst").alias("id")).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("k", "x"))), lambda s: s["x"]).alias(vector))


def link_score(u: Column, r: Column, v: Column) -> Column:
    """Bilinear score of a link: sum of the element-wise products of head, relation and tail."""
    return F.aggregate(F.zip_with(F.zip_with(u, r, lambda x, y: x * y), v, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def context_sentences(nodes: DataFrame, edges: DataFrame, parents: int = 2, neighbours_: int = 3, most: int = 6) -> DataFrame:
    """``id, context``: defining phrase, up to two ``is_a`` parents and three related successors of every node, as sentences in order."""
    from quillgraph.functions.text import definition_context

    named = nodes.where("name is not null").select("id", "name", "ontology", "definition")
    up = edges.select(F.col("dst").alias("id"), F.col("src").alias("other")).join(named.select(F.col("id").alias("other"), F.col("name").alias("o_name")), "other").join(named.select("id", "name"), "id")
    w = Window.partitionBy("id").orderBy("other")
    up = up.withColumn("k", F.row_number().over(w)).where(F.col("k") <= parents).select("id", F.lit(1).alias("part"), "k", F.concat_ws(" ", "name", F.lit("is_a"), "o_name").alias("s"))
    down = edges.select(F.col("src").alias("id"), F.col("dst").alias("other")).join(
        named.select(F.col("id").alias("other"), F.col("name").alias("o_name"), F.col("ontology").alias("o_ont")), "other").join(named.select("id", "name", "ontology"), "id")
    pair = lambda a, b: (F.col("ontology") == a) & (F.col("o_ont") == b)
    said = (F.when(pair("mondo", "chebi"), F.concat_ws(" ", "o_name", F.lit("treats"), "name")).when(pair("chebi", "mondo"), F.concat_ws(" ", "name", F.lit("treats"), "o_name"))
            .when(pair("mondo", "hp"), F.concat_ws(" ", "name", F.lit("causes"), "o_name")).otherwise(F.concat_ws(" ", "name", F.lit("related_to"), "o_name")))
    down = down.withColumn("k", F.row_number().over(w)).where(F.col("k") <= neighbours_).select("id", F.lit(2).alias("part"), "k", said.alias("s"))
    first = named.select("id", F.lit(0).alias("part"), F.lit(0).alias("k"), F.concat_ws(" ", "name", definition_context(F.col("definition"))).alias("s"), definition_context(F.col("definition")).alias("d")).where(
        "d is not null").drop("d")
    every = first.union(up).union(down).where(F.length("s") > 5)
    lines = every.groupBy("id").agg(F.array_distinct(F.transform(F.sort_array(F.collect_list(F.struct("part", "k", "s"))), lambda x: x["s"])).alias("context"))
    return lines.select("id", F.slice("context", 1, most).alias("context"))
