"""Graph operators over the ontology and the literature graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillgraph.operators import graph as G
from quillgraph.operators.components import components
from quillgraph.operators.hierarchy import hierarchy
from quillgraph.plans.tables import table
from quillgraph.session import Scratch
from quillgraph.sources import star


def graph_nodes(spark, sf):
    return star.nodes(spark, sf).select("id", "name", "ontology", F.array_join("synonyms", "|").alias("synonyms"))


def graph_edges(spark, sf):
    """One link per (src, dst) of the literature graph: the relation stated in most documents, the larger text on a tie."""
    e = star.literature(spark, sf).withColumn("seq", F.struct("n_docs", "relation"))
    return G.last_edges(e, "seq").select("src", "dst", "relation", "n_docs")


def parents_children(spark, sf):
    n = G.neighbours(star.nodes(spark, sf), star.edges(spark, sf))
    return n.select("id", F.array_join("parents", "|").alias("parents"), F.array_join("children", "|").alias("children"), F.col("n_parents").cast("long"), F.col("n_children").cast("long"))


def degree(spark, sf):
    return G.degrees(star.literature(spark, sf))


def graph_stats(spark, sf):
    return G.graph_statistics(star.nodes(spark, sf), star.edges(spark, sf))


def _all_nodes(spark, sf):
    return star.nodes(spark, sf).select(F.col("id").alias("start"))


def ancestors(spark, sf):
    e = star.edges(spark, sf)
    return G.closure(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).select("start", "node", "depth")


def descendants(spark, sf):
    return G.closure(star.edges(spark, sf)).select("start", "node", "depth")


def k_hop(spark, sf):
    """Two-hop context of every term on the undirected graph, counted."""
    e = G.undirected(star.edges(spark, sf)).select(F.col("a").alias("src"), F.col("b").alias("dst"))
    return G.reach(_all_nodes(spark, sf), e, 2).groupBy("start").agg(F.count_if(F.col("depth") == 1).alias("one_hop"), F.count_if(F.col("depth") == 2).alias("two_hop"))


def _sibling_pairs(spark, sf):
    return _siblings(star.edges(spark, sf))


def _siblings(e):
    nxt = e.groupBy("src").agg(F.sort_array(F.collect_set("dst")).alias("kids")).where(F.size("kids") > 1)
    return nxt.select(F.explode(F.transform(F.sequence(F.lit(1), F.size("kids") - 1), lambda i: F.struct(
        F.element_at("kids", i).alias("a"), F.element_at("kids", i + 1).alias("b")))).alias("p")).select("p.a", "p.b")


def semantic_similarity(spark, sf):
    """Ancestor Jaccard of neighbouring siblings and of every parent and child."""
    pairs = _sibling_pairs(spark, sf).union(star.edges(spark, sf).select("src", "dst"))
    return G.semantic_similarity(pairs, star.edges(spark, sf)).select("a", "b", F.round("similarity", 9).alias("similarity"))


def shortest_path(spark, sf):
    """Shortest paths between neighbouring siblings and from every term to the root of its tree, on the ontology."""
    scratch = Scratch(spark, "shortest_path")
    e = scratch.keep(star.edges(spark, sf).select("src", "dst"))
    tree = scratch.keep(hierarchy(e.select(F.col("dst").alias("id"), F.col("src").alias("parent"))).where("depth > 0").select("id", "parent", "root_id", "path"))
    known = scratch.keep(G.tree_paths(tree, e))
    rest = _siblings(e).union(tree.select(F.col("id").alias("a"), F.col("root_id").alias("b"))).join(known, ["a", "b"], "left_anti")
    return known.unionByName(G.shortest_paths(rest, e)).select("a", "b", F.col("hops").cast("long"), F.array_join("path", ">").alias("path"))


def component_labels(spark, sf):
    return components(star.literature(spark, sf)).groupBy("component").agg(F.count("*").alias("n"), F.max("id").alias("last"))


def induced_subgraph(spark, sf):
    """Links among the terms of phenotypes and their neighbours."""
    terms = star.nodes(spark, sf).where("ontology = 'hp'")
    return G.one_hop_subgraph(terms, star.edges(spark, sf)).select("src", "dst")


def _starts50(spark, sf):
    r = table(spark, sf, "relations").where("rel_id % 50 = 0")
    norm = F.trim(F.regexp_replace(F.lower("subject"), r"[^\p{L}\p{N}]+", " "))
    return r.select(norm.alias("start")).where("start <> ''").distinct()


def two_hop_paths(spark, sf):
    """Two-step paths, up to the operator's limit for each pair of ends, from the subjects of the query rows (ids divisible by 50) through the literature graph."""
    return G.two_hop_paths(star.literature(spark, sf), _starts50(spark, sf)).select("start", "mid", "end", F.array_join("relations", "|").alias("relations"), F.round("score", 9).alias("score"))


def targeted_traversal(spark, sf):
    words = ["treats", "causes", "prevents", "inhibits", "reduces"]
    return G.targeted_traversal(star.literature(spark, sf), _starts50(spark, sf), words).select("start", "node", F.col("depth").cast("long"))


def pagerank(spark, sf):
    seeds = star.nodes(spark, sf).where("ontology = 'chebi'")
    return G.pagerank(seeds, star.edges(spark, sf), rounds=20, tolerance=0.0).select("id", F.round("score", 9).alias("score"))


def message_passing(spark, sf):
    n = star.nodes(spark, sf)
    feats = n.select("id", F.array(F.lit(1.0), F.length(F.coalesce("name", F.lit(""))).cast("double"), F.size("synonyms").cast("double")).alias("vector"))
    out = G.message_passing(feats, star.edges(spark, sf))
    return out.select("id", F.col("vector")[0].alias("x0"), F.col("vector")[1].alias("x1"), F.col("vector")[2].alias("x2"),
                      G.link_score(F.col("vector"), F.array(F.lit(1.0), F.lit(0.5), F.lit(2.0)), F.col("vector")).alias("self_score"))


def entity_context(spark, sf):
    return G.context_sentences(star.nodes(spark, sf), star.edges(spark, sf)).select("id", F.array_join("context", " ; ").alias("context"))


QUERIES = {f.__name__: f for f in (graph_nodes, graph_edges, parents_children, degree, graph_stats, ancestors, descendants, k_hop, semantic_similarity, shortest_path,
                                   component_labels, induced_subgraph, two_hop_paths, targeted_traversal, pagerank, message_passing, entity_context)}

_ID = r"nullif(upper(regexp_extract({0}, '([A-Za-z]+)[:_]([0-9]+)[>\s]*$', 1)) || ':' || regexp_extract({0}, '([A-Za-z]+)[:_]([0-9]+)[>\s]*$', 2), ':')"
_NORM = r"trim(regexp_replace(lower({0}), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"
GRAPH = f"""
m AS (SELECT *, {_ID.format('ontology_id')} AS id FROM ontology_match),
e AS (SELECT DISTINCT src, dst FROM (
  SELECT {_ID.format('x')} AS src, id AS dst FROM (SELECT id, unnest(parents) AS x FROM m) UNION ALL
  SELECT id, {_ID.format('x')} FROM (SELECT id, unnest(children) AS x FROM m)) WHERE src IS NOT NULL AND dst IS NOT NULL AND src <> dst),
nb AS (SELECT id, max_by(canonical_name, CASE WHEN canonical_name IS NOT NULL THEN match_id END) AS name, max_by(definition, CASE WHEN definition IS NOT NULL THEN match_id END) AS definition,
  max_by(biolink_type, CASE WHEN biolink_type IS NOT NULL THEN match_id END) AS biolink_type, list_sort(list_distinct(flatten(list(coalesce(synonyms, []))))) AS synonyms FROM m WHERE id IS NOT NULL GROUP BY id),
ni AS (SELECT src AS id FROM e UNION SELECT dst FROM e UNION SELECT id FROM nb),
n AS (SELECT ni.id, name, lower(split_part(ni.id, ':', 1)) AS ontology, definition, coalesce(synonyms, []) AS synonyms, biolink_type FROM ni LEFT JOIN nb ON ni.id = nb.id)"""
LIT = f"""
lit AS (SELECT src, dst, relation, count(DISTINCT pmid) AS n_docs FROM (SELECT {_NORM.format('subject')} AS src, {_NORM.format('object')} AS dst, {_NORM.format('action')} AS relation, pmid
  FROM relations WHERE NOT coalesce(negation, false)) WHERE src <> '' AND dst <> '' AND relation <> '' AND src <> dst GROUP BY ALL)"""
_G = "WITH RECURSIVE " + GRAPH
_L = "WITH RECURSIVE " + LIT
_STARTS = f"st AS (SELECT DISTINCT {_NORM.format('subject')} AS start FROM relations WHERE rel_id % 50 = 0 AND {_NORM.format('subject')} <> '')"
_SIB = """sib AS (SELECT a, b FROM (SELECT dst AS a, lead(dst) OVER (PARTITION BY src ORDER BY dst) AS b FROM e) WHERE b IS NOT NULL)"""


def _reach(edges: str, depth: str = "") -> str:
    return f"""r AS (SELECT src AS start, dst AS node, 1 AS depth FROM {edges} UNION SELECT r.start, x.dst, r.depth + 1 FROM r JOIN {edges} x ON r.node = x.src
  WHERE r.depth < {depth or '60'})"""


ORACLES = {
    "graph_nodes": _G + " SELECT id, name, ontology, array_to_string(synonyms, '|') AS synonyms FROM n",
    "graph_edges": _L + " SELECT src, dst, max_by(relation, (n_docs, relation)) AS relation, max(n_docs) AS n_docs FROM lit GROUP BY src, dst",
    "parents_children": _G + """ SELECT n.id, coalesce(p, '') AS parents, coalesce(c, '') AS children, coalesce(np, 0) AS n_parents, coalesce(nc, 0) AS n_children FROM n
 LEFT JOIN (SELECT dst AS id, string_agg(src, '|' ORDER BY src) AS p, count(*) AS np FROM e GROUP BY dst) u USING (id)
 LEFT JOIN (SELECT src AS id, string_agg(dst, '|' ORDER BY dst) AS c, count(*) AS nc FROM e GROUP BY src) d USING (id)""",
    "degree": _L + " SELECT id, count(*) AS degree FROM (SELECT src AS id FROM lit UNION ALL SELECT dst FROM lit) GROUP BY id",
    "graph_stats": _G + """, s AS (SELECT src AS a, dst AS b FROM e UNION SELECT dst, src FROM e),
 rc AS (SELECT a AS id, a AS z FROM s UNION SELECT rc.id, s.b FROM rc JOIN s ON rc.z = s.a), lab AS (SELECT id, min(z) AS c FROM rc GROUP BY id),
 k AS (SELECT count(DISTINCT coalesce(lab.c, n.id)) AS n_components FROM n LEFT JOIN lab USING (id))
 SELECT ontology, count(*) AS n_terms, (SELECT count(*) FROM e WHERE lower(split_part(src, ':', 1)) = n.ontology) AS n_links, NULL::BIGINT AS n_components FROM n GROUP BY ontology
 UNION ALL SELECT 'all', (SELECT count(*) FROM n), (SELECT count(*) FROM e), n_components FROM k""",
    "ancestors": _G + ", ue AS (SELECT dst AS src, src AS dst FROM e), " + _reach("ue") + " SELECT start, node, CAST(min(depth) AS BIGINT) AS depth FROM r WHERE start <> node GROUP BY start, node",
    "descendants": _G + ", " + _reach("e") + " SELECT start, node, CAST(min(depth) AS BIGINT) AS depth FROM r WHERE start <> node GROUP BY start, node",
    "k_hop": _G + """, s AS (SELECT src AS a, dst AS b FROM e UNION SELECT dst, src FROM e),
 h AS (SELECT a AS start, b AS node, 1 AS d FROM s UNION ALL SELECT x.a, y.b, 2 FROM s x JOIN s y ON x.b = y.a WHERE x.a <> y.b),
 f AS (SELECT start, node, min(d) AS d FROM h GROUP BY ALL) SELECT start, count(*) FILTER (d = 1) AS one_hop, count(*) FILTER (d = 2) AS two_hop FROM f GROUP BY start""",
    "semantic_similarity": _G + ", ue AS (SELECT dst AS src, src AS dst FROM e), " + _SIB + ", " + _reach("ue") + """,
 c AS (SELECT DISTINCT start, node FROM r UNION SELECT id, id FROM n), p AS (SELECT a, b FROM sib UNION SELECT src, dst FROM e),
 i AS (SELECT a, b, count(*) AS i FROM p JOIN c x ON x.start = a JOIN c y ON y.start = b AND x.node = y.node GROUP BY a, b), z AS (SELECT start, count(*) AS n FROM c GROUP BY start)
 SELECT p.a, p.b, round(coalesce(i, 0) / (x.n + y.n - coalesce(i, 0)), 9) AS similarity FROM p LEFT JOIN i USING (a, b) JOIN z x ON x.start = p.a JOIN z y ON y.start = p.b""",
    "shortest_path": _G + ", " + _SIB + """, s AS (SELECT src AS a, dst AS b FROM e UNION SELECT dst, src FROM e), pa AS (SELECT dst AS id, min(src) AS parent FROM e GROUP BY dst),
 t AS (SELECT id, parent AS cur, id || '>' || parent AS path, 1 AS hops FROM pa UNION ALL SELECT t.id, p.parent, t.path || '>' || p.parent, t.hops + 1 FROM t JOIN pa p ON p.id = t.cur WHERE t.hops < 60),
 up AS (SELECT id AS a, cur AS b, hops, path FROM t WHERE cur NOT IN (SELECT id FROM pa)), p AS (SELECT DISTINCT a, b FROM sib WHERE (a, b) NOT IN (SELECT a, b FROM up)),
 d1 AS (SELECT p.a, p.b, 1 AS hops, p.a || '>' || p.b AS path FROM p JOIN s USING (a, b)),
 d2 AS (SELECT p.a, p.b, 2 AS hops, min(p.a || '>' || x.b || '>' || p.b) AS path FROM p JOIN s x ON x.a = p.a JOIN s y ON y.a = x.b AND y.b = p.b GROUP BY p.a, p.b)
 SELECT a, b, CAST(hops AS BIGINT) AS hops, path FROM (SELECT * FROM up UNION ALL SELECT * FROM d1 UNION ALL SELECT * FROM d2 WHERE (a, b) NOT IN (SELECT a, b FROM d1))""",
    "induced_subgraph": _G + """, s AS (SELECT src AS a, dst AS b FROM e UNION SELECT dst, src FROM e), t AS (SELECT id FROM n WHERE ontology = 'hp'),
 k AS (SELECT id FROM t UNION SELECT b FROM s WHERE a IN (SELECT id FROM t)) SELECT src, dst FROM e WHERE src IN (SELECT id FROM k) AND dst IN (SELECT id FROM k)""",
    "two_hop_paths": _L + ", " + _STARTS + """, b AS (SELECT *, CASE WHEN regexp_matches(lower(relation), 'treats|causes|regulates|interacts_with|part_of') THEN 1.3::DOUBLE ELSE 1.0::DOUBLE END AS w FROM lit),
 t AS (SELECT x.src AS start, x.dst AS mid, y.dst AS end_, x.relation || '|' || y.relation AS relations, x.w * y.w AS score FROM b x JOIN b y ON x.dst = y.src WHERE x.src IN (SELECT start FROM st) AND x.src <> y.dst)
 SELECT start, mid, end_ AS "end", relations, round(score, 9) AS score FROM t QUALIFY row_number() OVER (PARTITION BY start, end_ ORDER BY score DESC, mid, relations) <= 10""",
    "targeted_traversal": _L + ", " + _STARTS + """, h AS (SELECT DISTINCT src, dst, w FROM lit, (SELECT unnest(['treats', 'causes', 'prevents', 'inhibits', 'reduces']) AS w) WHERE contains(relation, w)),
 f AS (SELECT DISTINCT src, dst FROM (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY src, w ORDER BY dst) <= 5)),
 o AS (SELECT start, dst AS node, 1 AS d FROM st JOIN f ON src = start), t AS (SELECT * FROM o UNION ALL SELECT o.start, f.dst, 2 FROM o JOIN f ON f.src = o.node)
 SELECT start, node, CAST(min(d) AS BIGINT) AS depth FROM t WHERE start <> node GROUP BY start, node""",
    "pagerank": _G + """, b AS MATERIALIZED (SELECT src AS a, dst AS b FROM e UNION SELECT dst, src FROM e), w AS MATERIALIZED (SELECT a, b, 1.0::DOUBLE / count(*) OVER (PARTITION BY a) AS w FROM b),
 r AS MATERIALIZED (SELECT id, CASE WHEN ontology = 'chebi' THEN 1.0::DOUBLE / sum(CASE WHEN ontology = 'chebi' THEN 1 ELSE 0 END) OVER () ELSE 0.0::DOUBLE END AS r FROM n WHERE id IN (SELECT a FROM b)), s0 AS (SELECT id, r AS s FROM r)"""
    + "".join(f", s{k} AS MATERIALIZED (SELECT r.id, coalesce(g.x, 0) * 0.8::DOUBLE + r.r * (1 - 0.8::DOUBLE) AS s FROM r LEFT JOIN (SELECT w.b AS id, sum(s.s * w.w) AS x FROM w JOIN s{k - 1} s ON s.id = w.a GROUP BY 1) g USING (id))" for k in range(1, 21))
    + " SELECT id, round(s, 9) AS score FROM s20",
    "message_passing": _G + """, v AS (SELECT id, 1.0::DOUBLE AS a, length(coalesce(name, ''))::DOUBLE AS b, len(synonyms)::DOUBLE AS c FROM n),
 g AS (SELECT dst AS id, sum(a) AS x0, sum(b) AS x1, sum(c) AS x2 FROM e JOIN v ON v.id = e.src GROUP BY dst) SELECT *, x0 * x0 + 0.5 * x1 * x1 + 2.0 * x2 * x2 AS self_score FROM g""",
    "entity_context": _G + """, nn AS (SELECT * FROM n WHERE name IS NOT NULL),
 d AS (SELECT id, name, CASE """ + " ".join(f"WHEN regexp_extract(definition, '(?i){p} (.+?)[.,]', 1) <> '' THEN '{p} ' || regexp_extract(definition, '(?i){p} (.+?)[.,]', 1)" for p in (
        "characterized by", "caused by", "results in", "associated with")) + """ END AS c FROM nn),
 u AS (SELECT e.dst AS id, 1 AS part, row_number() OVER (PARTITION BY e.dst ORDER BY e.src) AS k, a.name || ' is_a ' || b.name AS s FROM e JOIN nn a ON a.id = e.dst JOIN nn b ON b.id = e.src),
 w AS (SELECT e.src AS id, 2 AS part, row_number() OVER (PARTITION BY e.src ORDER BY e.dst) AS k, CASE WHEN a.ontology = 'mondo' AND b.ontology = 'chebi' THEN b.name || ' treats ' || a.name
   WHEN a.ontology = 'chebi' AND b.ontology = 'mondo' THEN a.name || ' treats ' || b.name WHEN a.ontology = 'mondo' AND b.ontology = 'hp' THEN a.name || ' causes ' || b.name
   ELSE a.name || ' related_to ' || b.name END AS s FROM e JOIN nn a ON a.id = e.src JOIN nn b ON b.id = e.dst),
 al AS (SELECT id, 0 AS part, 0 AS k, name || ' ' || c AS s FROM d WHERE c IS NOT NULL UNION ALL SELECT * FROM u WHERE k <= 2 UNION ALL SELECT * FROM w WHERE k <= 3),
 dd AS (SELECT id, s, min(part * 100 + k) AS o FROM al WHERE length(s) > 5 GROUP BY id, s)
 SELECT id, string_agg(s, ' ; ' ORDER BY o) AS context FROM (SELECT * FROM dd QUALIFY row_number() OVER (PARTITION BY id ORDER BY o) <= 6) GROUP BY id""",
}
