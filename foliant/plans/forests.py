"""Queries of problem 6 over documents with folders, and over the tag registry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.forest import counted, descendants, hierarchy
from ..session import checkpoint, table

SEP = "\u0001"


def links(spark: SparkSession, d: str) -> DataFrame:
    """(node, parent) of both forests; a node's key is its tree's name, a separator and its id."""
    ids = [table(spark, d, t).select(F.lit("documents").alias("tree"), F.col("id").alias("node"), F.col("parent_id").alias("parent")) for t in ("documents", "folders")]
    strip = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    tags = table(spark, d, "tags").select(F.lit("tags").alias("tree"), strip("name").alias("node"), strip("parent").alias("parent"))
    every = ids[0].unionAll(ids[1]).unionAll(tags).where(F.col("node").isNotNull())
    key = lambda c: F.concat(F.col("tree"), F.lit(SEP), F.col(c))
    return every.select(key("node").alias("node"), F.when(F.col("parent").rlike(r"\S"), key("parent")).alias("parent"))


def split(c: str):
    return F.substring_index(c, SEP, 1), F.expr(f"substring({c}, instr({c}, '\\u0001') + 1)")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    h = hierarchy(links(spark, d))
    return h.select(split("node")[0].alias("tree"), split("node")[1].alias("node"), split("root")[1].alias("root"), "depth")


def p6_paths(spark: SparkSession, d: str) -> DataFrame:
    """Path of every node outside rings, from the root to the node, joined by ' > '."""
    h = hierarchy(links(spark, d), paths=True).where("depth >= 0")
    names = F.expr("transform(path, x -> substring(x, instr(x, '\\u0001') + 1))")
    return h.select(split("node")[0].alias("tree"), split("node")[1].alias("node"), F.array_join(names, " > ").alias("path"))


def p6_descendants(spark: SparkSession, d: str) -> DataFrame:
    """Number of descendants, by counting the nodes whose position lies within the interval."""
    h = checkpoint(hierarchy(links(spark, d), intervals=True).where("depth >= 0"))
    return counted(h).select(split("node")[0].alias("tree"), split("node")[1].alias("node"), F.col("n").alias("n_descendants"))


def p6_below(spark: SparkSession, d: str) -> DataFrame:
    """The descendants themselves: a row for every node outside rings and each node below it, found by the interval."""
    h = checkpoint(hierarchy(links(spark, d), intervals=True).where("depth >= 0"))
    return descendants(h).select(split("node")[0].alias("tree"), split("ancestor")[1].alias("ancestor"), split("node")[1].alias("node"))


NODES_SQL = r"""
raw AS (
  SELECT 'documents' AS tree, id AS node, parent_id AS parent FROM documents
  UNION ALL SELECT 'documents', id, parent_id FROM folders
  UNION ALL SELECT 'tags', regexp_replace(name, '^\s+|\s+$', '', 'g'), regexp_replace(parent, '^\s+|\s+$', '', 'g') FROM tags),
one AS (SELECT tree, node, min(CASE WHEN regexp_matches(parent, '\S') THEN parent END) AS parent FROM raw WHERE node IS NOT NULL GROUP BY 1, 2),
nodes AS (SELECT a.tree, a.node, b.node AS parent FROM one a LEFT JOIN one b ON a.tree = b.tree AND a.parent = b.node),
down AS (
  SELECT tree, node, node AS root, CAST(0 AS BIGINT) AS depth, node AS path FROM nodes WHERE parent IS NULL
  UNION ALL SELECT n.tree, n.node, d.root, d.depth + 1, d.path || ' > ' || n.node FROM nodes n JOIN down d ON n.tree = d.tree AND n.parent = d.node)
"""

SQL = {
    "p6_found": f"""WITH RECURSIVE {NODES_SQL},
lost AS (SELECT n.* FROM nodes n LEFT JOIN down d ON n.tree = d.tree AND n.node = d.node WHERE d.node IS NULL),
up AS (
  SELECT tree, node, parent AS above FROM lost
  UNION SELECT u.tree, u.node, l.parent FROM up u JOIN lost l ON u.tree = l.tree AND u.above = l.node),
onring AS (SELECT tree, node FROM up WHERE node = above),
ringed AS (SELECT u.tree, u.node, min(u.above) AS root FROM up u JOIN onring r ON u.tree = r.tree AND u.above = r.node GROUP BY 1, 2)
SELECT tree, node, root, depth FROM down UNION ALL SELECT tree, node, root, CAST(-1 AS BIGINT) FROM ringed""",
    "p6_paths": f"WITH RECURSIVE {NODES_SQL} SELECT tree, node, path FROM down",
    "p6_descendants": f"""WITH RECURSIVE {NODES_SQL},
anc AS (
  SELECT tree, node, parent AS a FROM nodes WHERE (tree, node) IN (SELECT (tree, node) FROM down)
  UNION ALL SELECT x.tree, x.node, n.parent FROM anc x JOIN nodes n ON x.tree = n.tree AND x.a = n.node)
SELECT d.tree, d.node, count(x.node) AS n_descendants FROM down d LEFT JOIN anc x ON d.tree = x.tree AND d.node = x.a GROUP BY 1, 2""",
    "p6_below": f"""WITH RECURSIVE {NODES_SQL},
anc AS (
  SELECT tree, node, parent AS a FROM nodes WHERE (tree, node) IN (SELECT (tree, node) FROM down)
  UNION ALL SELECT x.tree, x.node, n.parent FROM anc x JOIN nodes n ON x.tree = n.tree AND x.a = n.node)
SELECT tree, a AS ancestor, node FROM anc WHERE a IS NOT NULL""",
}

QUERIES = {"p6_found": p6_found, "p6_paths": p6_paths, "p6_descendants": p6_descendants, "p6_below": p6_below}
