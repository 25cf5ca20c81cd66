"""Latent subgraph around a text: seeds, expansion, scores, pruning, induced links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.functions import constants as K
from quillgraph.functions.text import node_text
from quillgraph.operators import graph as G
from quillgraph.operators.components import components
from quillgraph.operators.search import scored_search, token_jaccard
from quillgraph.session import Scratch


def latent_subgraph(text: str, mentions: list[str], nodes: DataFrame, edges: DataFrame, final_k: int = K.SUBGRAPH["final_k"], types: list[str] | None = None,
                    relations: list[str] | None = None) -> DataFrame:
    """``src, dst, relation, weight, src_source, dst_source``: links among the best nodes for a text.

    Seeds are the best node of every mention and the nodes most similar to the text;
    they are expanded over the undirected graph, scored by text similarity and
    personalised PageRank, filtered by type, cut to ``final_k``, and the largest
    component of the induced graph is kept.
    """
    p = K.SUBGRAPH
    spark = nodes.sparkSession
    scratch = Scratch(spark, "subgraph")
    q = spark.createDataFrame([(i, m) for i, m in enumerate(mentions)], "query_id int, query string")
    named = scored_search(q, nodes, 1).select("id").distinct()
    texts = nodes.select("id", node_text(F.col("name"), F.col("synonyms"), F.col("definition")).alias("text"))
    whole = spark.createDataFrame([(0, text)], "query_id int, query string")
    similar = scratch.keep(token_jaccard(whole, texts, 1_500).select("id", "similarity", "rank"))
    got = similar.where(F.col("rank") <= p["seed_top_k"]).select("id")
    seeds = scratch.keep(named.withColumn("source", F.lit("seed")).union(got.join(named, "id", "left_anti").withColumn("source", F.lit("retrieved"))))
    around = seeds
    e = scratch.keep(G.undirected(edges))
    for _ in range(p["hops"]):
        new = e.join(around.select(F.col("id").alias("a")), "a", "left_semi").select(F.col("b").alias("id")).distinct().join(around, "id", "left_anti")
        around = scratch.keep(around.union(new.withColumn("source", F.lit("expanded"))))
    ppr = G.pagerank(seeds, G.induced(around, edges), damping=1 - p["alpha"])
    scored = around.join(similar.select("id", "similarity"), "id", "left").join(ppr, "id", "left").select(
        "id", "source", (p["w_text"] * F.coalesce("similarity", F.lit(0.0)) + p["w_ppr"] * F.coalesce("score", F.lit(0.0)) +
                         F.when(F.col("source") == "seed", p["seed_bonus"]).otherwise(0.0)).alias("score"))
    if types:
        scored = scored.join(nodes.where(F.col("biolink_type").isin(types)).select("id"), "id", "left_semi")
    best = scratch.keep(scored.orderBy(F.desc("score"), "id").limit(final_k))
    links = G.induced(best, edges)
    if relations:
        links = links.where(F.col("relation").isin(relations))
    links = scratch.keep(links)
    comp = components(links)
    size = comp.groupBy("component").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "component").limit(1)
    main = comp.join(F.broadcast(size.select("component")), "component", "left_semi").select("id")
    kept = G.induced(main, links)
    end = lambda c: best.select(F.col("id").alias(c), F.col("score").alias(f"{c}_score"), F.col("source").alias(f"{c}_source"))
    return kept.join(end("src"), "src").join(end("dst"), "dst").select(
        "src", "dst", "relation", ((F.col("src_score") + F.col("dst_score")) / 2).alias("weight"), "src_source", "dst_source")
