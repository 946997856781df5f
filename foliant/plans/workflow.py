"""Queries of organisation, suggestions, synchronisation, naming, reconciliation and retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import assistant, lsh, organize, relations as rel, sync, tfidf, vectors
from ..operators.tags import with_ancestors
from ..schemas import CON, LIB, OWN, UP, contents, library, own_tags, tag_feedback
from ..session import checkpoint, table
from ..sources.files import expected_places, reconciliation
from .browsing import MAIN_PATHS, file_name_sql, unique_names_sql

QUERIES, SQL = {}, {}
NOW = 1_700_000_000_000
PLACES = f"{LIB}, {UP}, {MAIN_PATHS}, named AS (SELECT id, coalesce(path, '') AS rel_dir, {file_name_sql('extra[' + chr(39) + 'original_name' + chr(39) + ']')} AS wanted FROM lib LEFT JOIN paths ON id = document_id WHERE kind <> 'folder'), {unique_names_sql('named', 'rel_dir', 'wanted')}, place AS (SELECT id, rel_dir, unique_name AS name FROM unique_names)"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def corpus(spark: SparkSession, d: str) -> DataFrame:
    docs = library(spark, d, "kind", "title").where("kind <> 'folder'")
    return docs.join(contents(spark, d), F.col("id") == F.col("document_id"), "left").select("id", "doc_id", "title", F.when(F.col("text").rlike(r"\S"), F.col("text")).otherwise(F.col("title")).alias("text"))


def emergent(c: DataFrame) -> list[str]:
    """The heaviest term of each cluster of the corpus, at most vectors.default_k terms, in the clusters' order."""
    assigned, _ = vectors.kmeans(vectors.embed(c, "id", "text", 64), "id", "vector")
    tf = tfidf.term_frequencies(c, "id", "text")
    rows = vectors.emergent_tags(assigned, tfidf.vectors(tf, tfidf.inverse_frequencies(tf, c.count()))).orderBy("cluster").collect()
    return list(dict.fromkeys(r.term for r in rows))


def planned(spark: SparkSession, d: str) -> DataFrame:
    c = checkpoint(corpus(spark, d))
    asked = c.where("doc_id % 100 = 0").select(F.col("id").alias("doc"))
    twins = lsh.duplicates(c, "id", "text").join(asked, F.col("id") == F.col("doc"), "left_semi")
    return organize.plans(c, own_tags(spark, d), asked, emergent(c), rel.feedback_stats(tag_feedback(spark, d)), twins)


@query()
def organise_plans(spark: SparkSession, d: str) -> DataFrame:
    """Plans for every document whose number is divisible by 100, against the whole corpus (OR1-OR4)."""
    p = planned(spark, d)
    return p.select("document_id", F.array_join("tags", "|").alias("tags"), F.to_json("alt_tag_sets").alias("alt_tag_sets"), "suggested_title", F.array_join("alt_titles", "|").alias("alt_titles"), "is_duplicate_of")


@query()
def plan_suggestions(spark: SparkSession, d: str) -> DataFrame:
    """Suggestions made from these plans (OR7, TOP14)."""
    now = rel.with_tag_arrays(library(spark, d, "title"), own_tags(spark, d)).select(F.col("id").alias("document_id"), "title", "tags")
    return organize.suggestions_of(planned(spark, d), now, "bulk", NOW)


MAN = "man AS (SELECT * FROM manifest WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY received_at DESC NULLS LAST, entry_id DESC) = 1)"
DIFF = f"""{LIB}, {MAN}, diff AS (SELECT man.id, man.checksum_sha256, man.updated_at_ms, lib.checksum_sha256 AS l_checksum, lib.updated_at_ms AS l_updated,
CASE WHEN lib.id IS NULL THEN 'new' WHEN man.checksum_sha256 IS NOT DISTINCT FROM lib.checksum_sha256 THEN 'agree' ELSE 'conflict' END AS state FROM man LEFT JOIN lib ON man.id = lib.id)"""


def local_and_remote(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The library's manifest and the last report of each document by any peer."""
    lib = rel.with_tag_arrays(library(spark, d, *[c for c in sync.FIELDS if c not in ("id", "tags")]), own_tags(spark, d))
    m = table(spark, d, "manifest").where("id IS NOT NULL")
    last = m.groupBy("id").agg(F.max_by(F.struct(*[c for c in sync.FIELDS if c != "id"]), F.struct("received_at", "entry_id")).alias("x")).select("id", "x.*")
    return sync.manifest(lib), last


@query(f"WITH {DIFF} SELECT id, state FROM diff")
def manifest_difference(spark: SparkSession, d: str) -> DataFrame:
    """New, agreeing and conflicting documents (SY1-SY3, JN6)."""
    return sync.difference(*local_and_remote(spark, d)).select("id", "state")


@query(f"WITH {DIFF} SELECT id, CASE state WHEN 'new' THEN 'adopted' WHEN 'agree' THEN 'none' ELSE CASE WHEN updated_at_ms > l_updated OR (coalesce(updated_at_ms, -1) = coalesce(l_updated, -1) AND coalesce(checksum_sha256, '') > coalesce(l_checksum, '')) OR (updated_at_ms IS NOT NULL AND l_updated IS NULL) THEN 'remote_won' ELSE 'local_won' END END AS outcome FROM diff")
def manifest_newest(spark: SparkSession, d: str) -> DataFrame:
    """Conflicts resolved by the newest version (SY7)."""
    return sync.resolved(sync.difference(*local_and_remote(spark, d)), "newest").select("id", "outcome")


@query(f"WITH {DIFF} SELECT CASE WHEN state = 'conflict' THEN id || '.conflict.' || left(checksum_sha256, 8) ELSE id END AS id, state FROM diff WHERE state <> 'agree' AND (state = 'new' OR checksum_sha256 IS NOT NULL)")
def manifest_forks(spark: SparkSession, d: str) -> DataFrame:
    """Ids under which remote versions are filed where both stay (SY5, SY8, FN35)."""
    diff = sync.resolved(sync.difference(*local_and_remote(spark, d)), "fork").where("state = 'new' OR (state = 'conflict' AND checksum_sha256 IS NOT NULL)")
    return diff.select(F.when(F.col("state") == "conflict", sync.fork_id("id", "checksum_sha256")).otherwise(F.col("id")).alias("id"), "state")


@query(f"WITH {DIFF} SELECT DISTINCT checksum_sha256 FROM diff WHERE state <> 'agree' AND checksum_sha256 IS NOT NULL")
def wanted_blobs(spark: SparkSession, d: str) -> DataFrame:
    """Checksums to fetch (SY4, AGG15)."""
    return sync.wanted_blobs(sync.difference(*local_and_remote(spark, d)))


@query(f"WITH {DIFF} SELECT CASE state WHEN 'new' THEN 'document_received' ELSE 'conflict_resolved' END AS kind, id AS document_id, CASE state WHEN 'conflict' THEN 'forked' END AS winner FROM diff WHERE state <> 'agree'")
def sync_events(spark: SparkSession, d: str) -> DataFrame:
    """The log of a pull (SY10, SY11, X13)."""
    local, remote = local_and_remote(spark, d)
    return sync.events(sync.pulled(local, remote, "fork"), NOW).select("kind", "document_id", "winner")


@query("""WITH p AS (SELECT peer, id, checksum_sha256, updated_at_ms FROM manifest WHERE id IS NOT NULL AND peer IS NOT NULL QUALIFY row_number() OVER (PARTITION BY peer, id ORDER BY received_at DESC NULLS LAST, entry_id DESC) = 1)
SELECT peer, count(*) AS documents, max(updated_at_ms) AS newest_ms FROM p GROUP BY 1""")
def peer_manifests(spark: SparkSession, d: str) -> DataFrame:
    """What each peer last reported (SY9, ST6)."""
    m = table(spark, d, "manifest").where("id IS NOT NULL AND peer IS NOT NULL")
    last = m.groupBy("peer", "id").agg(F.max_by("updated_at_ms", F.struct("received_at", "entry_id")).alias("updated_at_ms"))
    return last.groupBy("peer").agg(F.count("*").alias("documents"), F.max("updated_at_ms").alias("newest_ms"))


@query(f"WITH {PLACES} SELECT id, rel_dir, name FROM place")
def library_places(spark: SparkSession, d: str) -> DataFrame:
    """Folder and file name of every document by its tags and title (LIB1, HIER15)."""
    docs = library(spark, d, "kind", "title", "mime_type", "checksum_sha256", "extra")
    return expected_places(docs, with_ancestors(own_tags(spark, d)))


@query(f"""WITH {PLACES}, st AS (SELECT lib.id, lib.title AS stamp, m.rel_dir AS stamped_dir FROM lib LEFT JOIN (SELECT id, min(coalesce(peer, '')) AS rel_dir FROM manifest GROUP BY 1) m ON m.id = lib.id WHERE kind <> 'folder'),
tree AS (SELECT DISTINCT coalesce(peer, '') AS rel_dir, title AS name, lower(checksum_sha256) AS hash FROM manifest WHERE title IS NOT NULL AND checksum_sha256 IS NOT NULL),
d AS (SELECT place.id, place.rel_dir, place.name, stamp, stamped_dir FROM place JOIN st ON place.id = st.id),
cd AS (SELECT d.*, t_dir, CASE WHEN t_dir IS NULL THEN 9 WHEN t_dir = d.rel_dir THEN 0 WHEN t_dir = stamped_dir THEN 1 ELSE 2 END AS o FROM d LEFT JOIN (SELECT DISTINCT rel_dir AS t_dir, name AS t_name FROM tree) t ON stamp = t_name WHERE stamp IS NOT NULL),
best AS (SELECT * FROM cd QUALIFY row_number() OVER (PARTITION BY id ORDER BY o, t_dir) = 1),
loose AS (SELECT * FROM tree WHERE name NOT IN (SELECT stamp FROM st WHERE stamp IS NOT NULL) QUALIFY row_number() OVER (PARTITION BY hash ORDER BY rel_dir, name) = 1)
SELECT 'backfill' AS action, id, NULL AS rel_dir, NULL AS name, rel_dir AS to_dir, name AS to_name FROM d WHERE stamp IS NULL
UNION ALL SELECT CASE WHEN t_dir IS NULL THEN 'delete' WHEN t_dir = rel_dir AND stamp = name THEN 'keep' ELSE 'move' END, id, t_dir, stamp, rel_dir, name FROM best
UNION ALL SELECT CASE WHEN hash IN (SELECT id FROM lib) THEN 'link' ELSE 'ingest' END, hash, rel_dir, name, NULL, NULL FROM loose""")
def library_reconciliation(spark: SparkSession, d: str) -> DataFrame:
    """Actions that bring a directory and the library together (LIB1-LIB4, JN7-JN9).

    What peers report stands in for the directory (a folder a peer, a file a report), and a document's title for the file name it was stamped with.
    """
    docs = library(spark, d, "kind", "title", "mime_type", "checksum_sha256", "extra")
    m = table(spark, d, "manifest")
    folder = m.groupBy(F.col("id").alias("m_id")).agg(F.min(F.coalesce("peer", F.lit(""))).alias("m_dir"))
    kept = F.map_filter(F.coalesce("extra", F.create_map().cast("map<string,string>")), lambda k, v: ~k.isin("file_name", "main_path"))
    marks = F.map_filter(F.create_map(F.lit("file_name"), F.col("title"), F.lit("main_path"), F.col("m_dir")), lambda k, v: v.isNotNull())
    stamped = docs.join(folder, F.col("id") == F.col("m_id"), "left").withColumn("extra", F.map_concat(kept, marks)).drop("m_id", "m_dir")
    tree = m.where("title IS NOT NULL AND checksum_sha256 IS NOT NULL").select(F.coalesce("peer", F.lit("")).alias("rel_dir"), F.col("title").alias("name"), F.lower("checksum_sha256").alias("hash")).distinct()
    return reconciliation(stamped, with_ancestors(own_tags(spark, d)), tree)


@query(rf"""WITH {CON}, b AS (SELECT document_id, text, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') AS t FROM con), q AS (SELECT ['which', 'invoice', 'did', 'the', 'accountant', 'file'] AS q),
s AS (SELECT document_id AS doc, len(list_filter(q, lambda x: list_contains(t, x))) / 6 AS score, left(regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '^ | $', '', 'g'), 240) AS excerpt FROM b, q)
SELECT n, doc, round(score, 6) AS score, excerpt FROM (SELECT *, row_number() OVER (ORDER BY score DESC, doc) AS n FROM s WHERE score > 0 AND excerpt <> '') WHERE n <= 5""")
def assistant_sources(spark: SparkSession, d: str) -> DataFrame:
    """The five sources for a question; five is the feature (AS1)."""
    return assistant.retrieve(contents(spark, d), "Which invoice did the accountant file?").select("n", "doc", F.round("score", 6).alias("score"), "excerpt")


@query(rf"""WITH {CON}, b AS (SELECT document_id, text, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') AS t FROM con), q AS (SELECT ['which', 'invoice', 'did', 'the', 'accountant', 'file'] AS q),
s AS (SELECT document_id AS doc, len(list_filter(q, lambda x: list_contains(t, x))) / 6 AS score, left(regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '^ | $', '', 'g'), 240) AS excerpt FROM b, q),
r AS (SELECT *, row_number() OVER (ORDER BY score DESC, doc) AS n FROM s WHERE score > 0 AND excerpt <> '' QUALIFY n <= 5)
SELECT 0 AS pos, 'system' AS role, 'Answer from the sources and cite them as [n].' AS text UNION ALL SELECT 1, 'user', 'Hello' UNION ALL SELECT 2, 'assistant', 'Hello.'
UNION ALL SELECT 3, 'user', 'Sources:' || chr(10) || coalesce(string_agg('[' || n || '] (document ' || doc || ') ' || excerpt, chr(10) ORDER BY n), '') || chr(10) || chr(10) || 'Question: Which invoice did the accountant file?' FROM r""")
def assistant_prompt(spark: SparkSession, d: str) -> DataFrame:
    """The messages for that question (AS2, AS3)."""
    refs = assistant.retrieve(contents(spark, d), "Which invoice did the accountant file?")
    history = spark.createDataFrame([(0, "user", "Hello"), (1, "assistant", "Hello.")], "turn long, role string, text string")
    return assistant.messages(history, refs, "Which invoice did the accountant file?")


@query()
def related_versions(spark: SparkSession, d: str) -> DataFrame:
    """For documents whose number is divisible by 100, the most similar other document at 0.6 (SY6, TOP13)."""
    members, texts = lsh.classes(contents(spark, d), "document_id", "text", blank=False)
    asked = library(spark, d).where("doc_id % 100 = 0").select("id")
    return sync.related_versions(checkpoint(members), lsh.signatures(texts), asked)
