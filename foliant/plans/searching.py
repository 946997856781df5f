"""Queries of search, vectors and near-duplicate indexes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import fts, lsh, tfidf, vectors
from ..schemas import CON, OWN, contents, library, own_tags
from ..session import checkpoint, table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def bm25(match: str, leaves: list[str], where: str) -> str:
    """SQL of a ranked match: leaves are expressions that count a leaf's hits in the token list t."""
    fs = ", ".join(f"{x} AS f{i}" for i, x in enumerate(leaves))
    ns = ", ".join(f"count(*) FILTER (f{i} > 0) AS n{i}" for i in range(len(leaves)))
    score = " + ".join(f"greatest(ln((docs - n{i} + 0.5) / (n{i} + 0.5)), 1e-6) * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * len / av))" for i in range(len(leaves)))
    return rf"""WITH {CON}, tk AS (SELECT document_id AS doc, regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}]+') AS t FROM con), h AS (SELECT doc, len(t) AS len, {fs} FROM tk),
s AS (SELECT count(*) AS docs, avg(len) AS av, {ns} FROM h) SELECT doc, round(-({score}), 9) AS rank FROM h, s WHERE {where}"""


def count_of(w: str) -> str:
    return f"len(list_filter(t, lambda x: x = '{w}'))"


@query(f"SELECT doc, round(1 / (1 + exp(rank)), 6) AS score FROM ({bm25('', [count_of('invoice'), count_of('kitchen')], 'f0 > 0 AND NOT f1 > 0')} ORDER BY rank, doc LIMIT 50)")
def search_exact(spark: SparkSession, d: str) -> DataFrame:
    """The fifty best texts for a boolean query; the limit is the result page (SE1-SE3, TOP2, FN28)."""
    return fts.search_exact(contents(spark, d), "document_id", "text", "invoice NOT kitchen").select("doc", F.round("score", 6).alias("score"))


@query("SELECT doc, round(rank, 6) AS rank FROM (" + bm25("", [count_of("travel"), count_of("boiler"), "len(list_filter(range(1, len(t)), lambda i: t[i] = 'reading' AND t[i + 1] = 'list'))"], "(f0 > 0 OR f1 > 0) AND f2 > 0") + ")")
def match_phrase(spark: SparkSession, d: str) -> DataFrame:
    """All matches of a query with OR, brackets and a phrase, ranked by BM25 (SE2)."""
    return fts.match(contents(spark, d), "document_id", "text", '(travel OR boiler) AND "reading list"').select("doc", F.round("rank", 6).alias("rank"))


@query("SELECT doc FROM (" + bm25("", ["len(list_filter(range(1, len(t) + 1), lambda i: t[i] = 'landlord' AND len(list_filter(range(1, len(t) + 1), lambda j: t[j] = 'folder' AND abs(i - j) <= 13)) > 0))"], "f0 > 0") + ")")
def match_near(spark: SparkSession, d: str) -> DataFrame:
    """Texts with two words at most twelve others apart (SE2)."""
    return fts.match(contents(spark, d), "document_id", "text", "NEAR(landlord folder, 12)").select("doc")


@query(f"WITH {OWN}, hits AS ({bm25('', [count_of('invoice')], 'f0 > 0')} ORDER BY rank, doc LIMIT 50) SELECT doc, round(1 / (1 + exp(rank)), 6) AS score FROM hits WHERE doc IN (SELECT document_id FROM own WHERE tag = 'finance')")
def search_tagged(spark: SparkSession, d: str) -> DataFrame:
    """The best hits, then those of them with a tag (SE9, FLT9, JN4)."""
    return fts.unified(contents(spark, d), own_tags(spark, d), " invoice ", "exact", ["finance"]).select("doc", F.round("score", 6).alias("score"))


@query()
def search_semantic(spark: SparkSession, d: str) -> DataFrame:
    """The fifty texts nearest to a question (SE4-SE7)."""
    return vectors.semantic(contents(spark, d), "document_id", "text", "the travel expenses and the deposit")


@query()
def search_hybrid(spark: SparkSession, d: str) -> DataFrame:
    """Exact hits, then semantic ones (SE8, SET1)."""
    c = contents(spark, d)
    return fts.merge_stages(fts.search_exact(c, "document_id", "text", '"lease for the upper flat" AND boiler'), vectors.semantic(c, "document_id", "text", "lease boiler"), 60)


@query()
def search_page(spark: SparkSession, d: str) -> DataFrame:
    """A hybrid result page with title, snippet and highlights (SET2, SE9, FN19, FN22, JN5)."""
    c = contents(spark, d)
    hits = fts.unified(c, own_tags(spark, d), "travel AND invoice", "hybrid").join(c, F.col("doc") == F.col("document_id")).join(library(spark, d, "title"), F.col("doc") == F.col("id"), "left")
    return fts.with_highlights(hits.select("doc", "score", "title", "text"), "text", "travel AND invoice").drop("text")


@query("""WITH q AS (SELECT vec_id AS query, embedding AS a FROM embeddings WHERE vec_id % 100 = 0), s AS (SELECT query, vec_id AS other, round(list_cosine_similarity(CAST(a AS DOUBLE[]), CAST(embedding AS DOUBLE[])), 9) AS cosine FROM q, embeddings WHERE vec_id <> query)
SELECT query, other, round(cosine, 6) AS cosine, row_number() OVER (PARTITION BY query ORDER BY cosine DESC, other) AS rank FROM s QUALIFY rank <= 10""")
def nearest_vectors(spark: SparkSession, d: str) -> DataFrame:
    """The ten nearest of all vectors for every one whose id is divisible by 100 (JN11, TOP3, SE6)."""
    v = table(spark, d, "embeddings")
    return vectors.nearest(v, v.where("vec_id % 100 = 0"), "vec_id", "embedding").select("query", "other", F.round("cosine", 6).alias("cosine"), F.col("rank").cast("long").alias("rank"))


@query()
def clusters(spark: SparkSession, d: str) -> DataFrame:
    """Deterministic k-means over all vectors (ML5, ML6, AGG8, FN30)."""
    return vectors.kmeans(table(spark, d, "embeddings"), "vec_id", "embedding")[0].withColumnRenamed("id", "vec_id")


@query()
def topics(spark: SparkSession, d: str) -> DataFrame:
    """Clusters of hashed text vectors with the heaviest term of each (ML7, TOP7)."""
    c = contents(spark, d)
    assigned, _ = vectors.kmeans(vectors.embed(c, "document_id", "text", 64), "id", "vector", 8)
    tf = tfidf.term_frequencies(c, "document_id", "text")
    return vectors.emergent_tags(assigned, tfidf.vectors(tf, tfidf.inverse_frequencies(tf, c.count())))


@query()
def label_scores(spark: SparkSession, d: str) -> DataFrame:
    """Zero-shot labels of every title (ML14)."""
    return vectors.classify(library(spark, d, "title").where("title IS NOT NULL"), "id", "title", ["invoice", "lease", "recipe", "lecture notes"])


@query()
def near_duplicate_probe(spark: SparkSession, d: str) -> DataFrame:
    """Near-duplicates at 0.8 of every document whose number is divisible by 100, against all texts (SE12-SE15).

    A row per asked document and class of equal texts, the own one if others have it; text_classes has the ids of a class.
    """
    members, texts = lsh.classes(contents(spark, d), "document_id", "text")
    asked = library(spark, d).where("doc_id % 100 = 0").select("id")
    return lsh.alike(checkpoint(members), lsh.signatures(texts), asked, 0.8).withColumnRenamed("id", "document_id")


@query(f"WITH {CON} SELECT document_id, sha256(text) AS class FROM con WHERE text IS NOT NULL")
def text_classes(spark: SparkSession, d: str) -> DataFrame:
    """The class of equal texts that each document is in (SE12)."""
    return lsh.classes(contents(spark, d), "document_id", "text")[0].withColumnRenamed("id", "document_id")


@query()
def organiser_duplicates(spark: SparkSession, d: str) -> DataFrame:
    """Each document's best duplicate at 0.85 (ML9-ML11, TOP12)."""
    return lsh.duplicates(contents(spark, d), "document_id", "text")


@query(f"WITH {CON} SELECT sha256(text) AS class, count(*) AS copies, min(document_id) AS first FROM con GROUP BY 1")
def exact_duplicates(spark: SparkSession, d: str) -> DataFrame:
    """Classes of equal texts (FN23, SNK1)."""
    members, _ = lsh.classes(contents(spark, d), "document_id", "text")
    return members.groupBy("class").agg(F.count("*").alias("copies"), F.min("id").alias("first"))


@query(rf"""WITH {CON}, f AS (SELECT document_id, lower(regexp_replace(text, '\s', '', 'g')) AS f FROM con)
SELECT document_id, CASE WHEN length(f) < 5 THEN 1 ELSE len(list_distinct(list_transform(range(1, CAST(length(f) - 3 AS BIGINT)), lambda i: substr(f, i, 5)))) END AS shingles FROM f""")
def shingle_counts(spark: SparkSession, d: str) -> DataFrame:
    """Number of distinct runs of five characters of every text (SE12)."""
    f = F.lower(F.regexp_replace("text", r"\s", ""))
    n = F.size(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("f") - 4), lambda i: F.substring("f", i, 5))))
    return contents(spark, d).select("document_id", f.alias("f")).select("document_id", F.when(F.length("f") < 5, 1).otherwise(n).cast("long").alias("shingles"))


@query()
def candidate_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Every two classes of equal texts that share a band, without a threshold, with their estimated similarity (SE16, JN14, TOP11); text_classes has their ids."""
    return lsh.candidates(lsh.blocks(lsh.classes(contents(spark, d), "document_id", "text")[1]))
