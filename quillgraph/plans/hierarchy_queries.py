"""Problem 5: parent-child links to full hierarchies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.operators.hierarchy import descendants_of, hierarchy, links_from_lists
from quillgraph.plans.tables import table


def _links(spark: SparkSession, sf: str) -> DataFrame:
    return links_from_lists(table(spark, sf, "ontology_match"), "ontology_id", "parents", "children")


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return hierarchy(_links(spark, sf), paths=False).select(F.col("id").alias("ontology_id"), "root_id", "depth")


def p5_paths(spark: SparkSession, sf: str) -> DataFrame:
    tree = hierarchy(_links(spark, sf))
    return tree.where("path is not null").select(
        F.col("id").alias("ontology_id"), F.array_join("path", "/").alias("path"), "n_descendants")


def p5_descendants(spark: SparkSession, sf: str) -> DataFrame:
    return descendants_of(hierarchy(_links(spark, sf), paths=False)).select("ancestor", "descendant", "distance")


QUERIES = {"p5_found": p5_found, "p5_paths": p5_paths, "p5_descendants": p5_descendants}

_ID = r"upper(regexp_extract({0}, '([A-Za-z]+)[:_]([0-9]+)[>\s]*$', 1)) || ':' || regexp_extract({0}, '([A-Za-z]+)[:_]([0-9]+)[>\s]*$', 2)"
_LINKS = f"""
WITH RECURSIVE raw AS (
  SELECT {_ID.format('ontology_id')} AS id, NULL AS parent FROM ontology_match
  UNION ALL SELECT {_ID.format('ontology_id')}, {_ID.format('x')} FROM (SELECT ontology_id, unnest(parents) AS x FROM ontology_match)
  UNION ALL SELECT {_ID.format('x')}, NULL FROM (SELECT unnest(parents) AS x FROM ontology_match)
  UNION ALL SELECT {_ID.format('x')}, {_ID.format('ontology_id')} FROM (SELECT ontology_id, unnest(children) AS x FROM ontology_match)),
links AS (SELECT id, min(nullif(parent, ':')) AS parent FROM raw WHERE id IS NOT NULL AND id <> ':' GROUP BY id),
tree AS (
  SELECT id, id AS root_id, CAST(0 AS BIGINT) AS depth, id AS path FROM links WHERE parent IS NULL
  UNION ALL SELECT l.id, t.root_id, t.depth + 1, t.path || '/' || l.id FROM links l JOIN tree t ON l.parent = t.id),
up AS (
  SELECT id AS start, parent AS cur FROM links WHERE parent IS NOT NULL AND id NOT IN (SELECT id FROM tree)
  UNION SELECT u.start, l.parent FROM up u JOIN links l ON u.cur = l.id WHERE l.parent IS NOT NULL),
ring AS (SELECT start AS id FROM up WHERE start = cur),
low AS (SELECT u.start AS id, min(u.cur) AS root_id FROM up u WHERE u.cur IN (SELECT id FROM ring) GROUP BY u.start),
desc_pairs AS (
  SELECT parent AS ancestor, id AS descendant, CAST(1 AS BIGINT) AS distance FROM links WHERE parent IS NOT NULL AND id IN (SELECT id FROM tree)
  UNION ALL SELECT l.parent, d.descendant, d.distance + 1 FROM desc_pairs d JOIN links l ON d.ancestor = l.id WHERE l.parent IS NOT NULL)
"""

ORACLES = {
    "p5_found": _LINKS + """
SELECT id AS ontology_id, root_id, depth FROM tree
UNION ALL
SELECT low.id, low.root_id, CASE WHEN low.id IN (SELECT id FROM ring) THEN CAST(-1 AS BIGINT) ELSE CAST(-2 AS BIGINT) END FROM low""",
    "p5_paths": _LINKS + """
SELECT tree.id AS ontology_id, tree.path, coalesce(n.n, 0) AS n_descendants
FROM tree LEFT JOIN (SELECT ancestor, count(*) AS n FROM desc_pairs GROUP BY ancestor) n ON n.ancestor = tree.id""",
    "p5_descendants": _LINKS + "SELECT ancestor, descendant, distance FROM desc_pairs",
}
