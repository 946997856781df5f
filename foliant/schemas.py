"""Schemas of the relations, and the relations as they are read from a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .operators.filters import one_row_each
from .session import table


# As DDL, which readers and createDataFrame take; parsing it needs no session at import.
DOCUMENTS = "id string, parent_id string, kind string, title string, mime_type string, size_bytes long, checksum_sha256 string, created_at_ms long, updated_at_ms long, extra map<string,string>"
CONTENT = "document_id string, text string, source string"
TAGS = "name string, parent string, color string"
DOCUMENT_TAGS = "document_id string, tag string"
LINKS = "parent_id string, child_id string, position int"
SUGGESTIONS = "id string, document_id string, kind string, payload string, rank int, source string, confidence double, status string, created_at_ms long"
FEEDBACK = "id string, kind string, context string, term string, action string, weight double, created_at_ms long"
VIEWS = "name string, tags array<string>"
MANIFEST = "id string, checksum_sha256 string, updated_at_ms long, parent_id string, tags array<string>, title string, mime_type string, kind string, size_bytes long, created_at_ms long"
TREE = "rel_dir string, name string, size long, modified_ms long"
RELATIONS = {"documents": DOCUMENTS, "content": CONTENT, "tags": TAGS, "document_tags": DOCUMENT_TAGS, "links": LINKS, "suggestions": SUGGESTIONS, "feedback": FEEDBACK, "views": VIEWS}


def stripped(c: str):
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def library(spark: SparkSession, d: str, *cols: str) -> DataFrame:
    """One row per document id, the latest delivery; only the named columns are carried."""
    docs = table(spark, d, "documents").where("id IS NOT NULL")
    return docs.groupBy("id").agg(F.max_by(F.struct("doc_id", *cols), F.struct("ingested_at", "doc_id")).alias("x")).select("id", "x.*")


def contents(spark: SparkSession, d: str) -> DataFrame:
    """One row per document with its extracted text; texts are moved only where a document has several rows."""
    return one_row_each(table(spark, d, "content").select("document_id", "text", "source"), "document_id", F.min(F.struct("text", "source")))


def own_tags(spark: SparkSession, d: str) -> DataFrame:
    """Distinct (document_id, tag), trimmed and not blank, without ancestors added."""
    return table(spark, d, "document_tags").where("document_id IS NOT NULL").select("document_id", stripped("tag").alias("tag")).where("tag <> ''").distinct()


def feedback(spark: SparkSession, d: str) -> DataFrame:
    """Feedback events, as which the event stream stands in: term, action, weight."""
    e = table(spark, d, "events")
    return e.select(F.col("event_id").cast("string").alias("id"), F.lit("tags").alias("kind"), F.lit("tag").alias("context"), F.col("event_type").alias("term"), F.when(F.col("event_id") % 3 == 0, "rejected").otherwise("accepted").alias("action"), (F.col("event_id") % 2 + 1).cast("double").alias("weight"), F.unix_millis(F.col("ts").cast("timestamp")).alias("created_at_ms"), "user_id")


def tag_feedback(spark: SparkSession, d: str) -> DataFrame:
    """Feedback on tags, as which the peers' reports stand in: one that carries a document's tag accepts it, one without rejects it."""
    said = table(spark, d, "manifest").where("id IS NOT NULL AND tags IS NOT NULL").select("id", F.transform("tags", stripped).alias("said"))
    both = own_tags(spark, d).join(said, F.col("document_id") == F.col("id"))
    return both.select(F.lit("tags").alias("kind"), F.lit("tag").alias("context"), F.col("tag").alias("term"), F.when(F.array_contains("said", F.col("tag")), "accepted").otherwise("rejected").alias("action"), F.lit(1.0).alias("weight"))


# The same in SQL, as common table expressions.
LIB = "lib AS (SELECT * FROM documents WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY ingested_at DESC NULLS LAST, doc_id DESC) = 1)"
CON = "con AS (SELECT document_id, min(text) AS text FROM content GROUP BY 1)"
OWN = r"own AS (SELECT DISTINCT * FROM (SELECT document_id, regexp_replace(tag, '^\s+|\s+$', '', 'g') AS tag FROM document_tags WHERE document_id IS NOT NULL) WHERE tag <> '')"
UP = OWN + r""", ups AS (SELECT document_id, string_split(tag, '/') AS s FROM own),
up AS (SELECT DISTINCT document_id, array_to_string(s[1:i], '/') AS tag FROM (SELECT document_id, s, unnest(range(1, len(s) + 1)) AS i FROM ups))"""
FB = "fb AS (SELECT event_type AS term, CASE WHEN event_id % 3 = 0 THEN 'rejected' ELSE 'accepted' END AS action, CAST(event_id % 2 + 1 AS DOUBLE) AS weight, user_id FROM events)"
TAG_FB = r"""tfb AS (SELECT own.tag AS term, CASE WHEN list_contains(said, own.tag) THEN 'accepted' ELSE 'rejected' END AS action, 1.0 AS weight
FROM own JOIN (SELECT id, list_transform(tags, lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')) AS said FROM manifest WHERE id IS NOT NULL AND tags IS NOT NULL) m ON own.document_id = m.id)"""
