"""Queries on term statistics: tokens, frequencies, keywords, titles, neighbours' tags, scripts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, Window as W

from ..functions import text as fx
from ..operators import relations as rel, tfidf
from ..schemas import CON, LIB, OWN, TAG_FB, contents, library, own_tags, tag_feedback
from ..session import checkpoint

QUERIES, SQL = {}, {}
STOPS = ", ".join(f"'{w}'" for w in fx.STOP_WORDS)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TF = rf"""{CON}, tok AS (SELECT document_id AS doc, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[\p{{L}}\p{{N}}]+')) AS term FROM con),
tf AS (SELECT doc, term, CAST(count(*) AS DOUBLE) AS tf FROM tok WHERE length(term) > 1 AND term NOT IN ({STOPS}) GROUP BY 1, 2),
idf AS (SELECT term, count(*) AS df, ln(((SELECT count(*) FROM con) + 1) / (count(*) + 1)) + 1 AS idf FROM tf GROUP BY 1),
vec AS (SELECT doc, term, tf * idf AS weight FROM tf JOIN idf USING (term))"""


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def model(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(contents, term frequencies, inverse frequencies)."""
    docs = contents(spark, d)
    tf = checkpoint(tfidf.term_frequencies(docs, "document_id", "text"))
    return docs, tf, tfidf.inverse_frequencies(tf, docs.count())


@query(f"WITH {TF} SELECT doc, count(*) AS terms, sum(tf) AS tokens FROM tf GROUP BY 1")
def term_counts(spark: SparkSession, d: str) -> DataFrame:
    """Terms and tokens of every text (FN1, AGG3)."""
    return tfidf.term_frequencies(contents(spark, d), "document_id", "text").groupBy("doc").agg(F.count("*").alias("terms"), F.sum("tf").alias("tokens"))


@query(f"WITH {TF} SELECT term, df, round(idf, 6) AS idf FROM idf")
def inverse_frequencies(spark: SparkSession, d: str) -> DataFrame:
    """Document frequency and idf of every term (AGG4, AGG15)."""
    return model(spark, d)[2].select("term", "df", F.round("idf", 6).alias("idf"))


@query(f"WITH {TF} SELECT doc, rank, term, round(weight, 6) AS weight FROM (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY round(weight, 9) DESC, term) AS rank FROM vec) WHERE rank <= 5")
def keywords(spark: SparkSession, d: str) -> DataFrame:
    """The five heaviest terms of every text (ML1, ML2, TOP4)."""
    _, tf, idf = model(spark, d)
    v = tfidf.vectors(tf, idf).withColumn("weight", F.round("weight", 9))
    return tfidf.top_terms(v, 5).select("doc", "rank", "term", F.round("weight", 6).alias("weight"))


@query(rf"""WITH {LIB}, {TF}, nm AS (SELECT con.document_id AS doc, title, CASE WHEN (regexp_matches(title, '[Ѐ-ӿ]') AND regexp_matches(con.text, '[A-Za-zÀ-ɏ]') AND NOT regexp_matches(con.text, '[Ѐ-ӿ]')) OR (regexp_matches(con.text, '[Ѐ-ӿ]') AND regexp_matches(title, '[A-Za-zÀ-ɏ]') AND NOT regexp_matches(title, '[Ѐ-ӿ]') AND length(regexp_replace(con.text, '[^Ѐ-ӿ]', '', 'g')) >= length(regexp_replace(con.text, '[^A-Za-zÀ-ɏ]', '', 'g'))) THEN 0.01 ELSE 0.25 END AS fw FROM con JOIN lib ON id = con.document_id),
nt AS (SELECT doc, fw, unnest(regexp_extract_all(translate(coalesce(title, ''), '{UPPER}', '{LOWER}'), '[\p{{L}}\p{{N}}]+')) AS term FROM nm),
allw AS (SELECT doc, term, weight FROM vec UNION ALL SELECT doc, term, fw FROM nt WHERE length(term) > 1 AND term NOT IN ({STOPS})),
w AS (SELECT doc, term, round(sum(weight), 9) AS weight FROM allw WHERE doc IN (SELECT doc FROM nm) GROUP BY 1, 2)
SELECT doc, rank, term, round(weight, 6) AS weight FROM (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY weight DESC, term) AS rank FROM w) WHERE rank <= 3""")
def title_terms(spark: SparkSession, d: str) -> DataFrame:
    """Title candidates from text and name, the name down-weighted, more so in another script (ML3, FN3, FN4)."""
    docs, tf, idf = model(spark, d)
    named = docs.join(library(spark, d, "title"), F.col("document_id") == F.col("id"))
    mine = tf.join(named.select(F.col("document_id").alias("doc")), "doc", "left_semi")
    pool = tfidf.title_pool(named, "document_id", "text", "title", idf, mine)
    return tfidf.top_terms(pool.withColumn("weight", F.round("weight", 9)), 3).select("doc", "rank", "term", F.round("weight", 6).alias("weight"))


@query(f"""WITH {LIB}, {OWN}, {TF}, nrm AS (SELECT doc, sqrt(sum(weight * weight)) AS n FROM vec GROUP BY 1), u AS (SELECT vec.doc, term, weight / n AS w FROM vec JOIN nrm ON vec.doc = nrm.doc WHERE n > 0),
q AS (SELECT u.* FROM u JOIN lib ON doc = id WHERE doc_id % 100 = 0), b AS (SELECT * FROM u WHERE doc IN (SELECT document_id FROM own)),
s AS (SELECT q.doc, b.doc AS other, round(sum(q.w * b.w), 9) AS score FROM q JOIN b ON q.term = b.term AND q.doc <> b.doc GROUP BY 1, 2),
k AS (SELECT * FROM s WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY doc ORDER BY score DESC, other) <= 5)
SELECT doc, tag, round(sum(score), 6) AS votes FROM k JOIN own ON other = document_id GROUP BY 1, 2""")
def neighbour_tags(spark: SparkSession, d: str) -> DataFrame:
    """Tags of the five most similar tagged documents, for every document whose number is divisible by 100 (ML8, JN12, JN13, TOP5, TOP6, AGG5)."""
    docs, tags = contents(spark, d), own_tags(spark, d)
    idf = checkpoint(tfidf.document_frequencies(docs, "text", docs.count()))
    asked = checkpoint(library(spark, d).where("doc_id % 100 = 0").select(F.col("id").alias("doc")))
    near = tfidf.near_texts(docs, "document_id", "text", idf, asked, tags.select(F.col("document_id").alias("doc")))
    return tfidf.tag_votes(near, tags).select("doc", "tag", F.round("votes", 6).alias("votes"))


@query(rf"WITH {CON} SELECT document_id, CASE WHEN c > 0 AND c >= l THEN 'Cyrillic' WHEN l > 0 AND c = 0 THEN 'Latin' ELSE 'Other' END AS script FROM (SELECT document_id, length(regexp_replace(coalesce(text, ''), '[^Ѐ-ӿ]', '', 'g')) AS c, length(regexp_replace(coalesce(text, ''), '[^A-Za-zÀ-ɏ]', '', 'g')) AS l FROM con)")
def scripts(spark: SparkSession, d: str) -> DataFrame:
    """Script of every text (FN3)."""
    return contents(spark, d).select("document_id", fx.script("text").alias("script"))


@query(rf"""WITH {CON}, b AS (SELECT document_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') AS t FROM con), q AS (SELECT ['invoice', 'travel', 'kitchen'] AS q)
SELECT document_id, round(len(list_filter(q, lambda x: list_contains(t, x))) / 3, 6) AS score FROM b, q WHERE len(list_filter(q, lambda x: list_contains(t, x))) > 0""")
def term_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Share of a question's words that a text has (SE17, FN2)."""
    words = ["invoice", "travel", "kitchen"]
    t = contents(spark, d).select("document_id", fx.tokens("text").alias("t"))
    hit = F.size(F.filter(F.array(*map(F.lit, words)), lambda w: F.array_contains("t", w)))
    return t.select("document_id", F.round(hit / len(words), 6).alias("score")).where("score > 0")


@query(rf"""WITH {OWN}, {TAG_FB}, st AS (SELECT term, coalesce(sum(weight) FILTER (action = 'accepted'), 0.0) AS a, coalesce(sum(weight) FILTER (action = 'rejected'), 0.0) AS r FROM tfb GROUP BY 1),
p AS (SELECT own.document_id, own.tag, row_number() OVER (PARTITION BY own.document_id ORDER BY own.tag) AS pos FROM own),
x AS (SELECT document_id, tag, pos, round(greatest(0.25, least(4.0, 1 + 0.35 * coalesce(a, 0.0) - 0.30 * coalesce(r, 0.0))) / pos, 6) AS score FROM p LEFT JOIN st ON tag = term)
SELECT document_id, tag, score, CAST(row_number() OVER (PARTITION BY document_id ORDER BY score DESC, pos) AS INT) AS rank FROM x""")
def preferred_tags(spark: SparkSession, d: str) -> DataFrame:
    """Tags per document re-ranked by what was accepted or rejected (ML13, OR2)."""
    stats = rel.feedback_stats(tag_feedback(spark, d))
    t = own_tags(spark, d).withColumn("pos", F.row_number().over(W.partitionBy("document_id").orderBy("tag")))
    j = t.join(stats, F.col("tag") == F.col("term"), "left").withColumn("score", F.round(rel.preference() / F.col("pos"), 6))
    return j.select("document_id", "tag", "score", F.row_number().over(W.partitionBy("document_id").orderBy(F.desc("score"), "pos")).alias("rank"))
