"""Queries on the library's relations: lookups, filters, feedback, tags, upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..blobs import unreferenced
from ..functions import text as fx
from ..operators import relations as rel, tags as tg
from ..schemas import CON, FB, LIB, OWN, UP, contents, feedback, library, own_tags
from ..session import table

QUERIES, SQL = {}, {}


MAIN_PATHS = r"""c AS (SELECT tag, count(DISTINCT document_id) AS n FROM up WHERE NOT contains(tag, ':') GROUP BY 1),
p AS (SELECT document_id, c.n, up.tag, regexp_replace(regexp_replace(string_split(up.tag, '/')[-1], '[^\p{L}\p{N} ._()-]', '_', 'g'), '^[_.\- ]+|[_.\- ]+$', '', 'g') AS seg FROM up JOIN c ON up.tag = c.tag),
paths AS (SELECT document_id, coalesce(string_agg(seg, '/' ORDER BY n DESC, tag) FILTER (seg <> ''), '') AS path FROM p GROUP BY 1)"""


def file_name_sql(original: str = "CAST(NULL AS VARCHAR)") -> str:
    """SQL for the friendly file name, from title, mime_type and checksum_sha256."""
    mime = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in fx.MIME_EXTENSION.items())
    ext = rf"coalesce(nullif(lower(regexp_extract({original}, '\.([A-Za-z0-9]{{1,8}})$', 1)), ''), CASE mime_type {mime} END)"
    stem = r"left(regexp_replace(regexp_replace(regexp_replace(coalesce(title, ''), '[^\p{L}\p{N} ._()-]', '_', 'g'), '_+', '_', 'g'), '^[_.\- ]+|[_.\- ]+$', '', 'g'), 80)"
    safe = rf"CASE WHEN regexp_matches(upper(string_split({stem}, '.')[1]), '^(CON|PRN|AUX|NUL|(COM|LPT)[1-9])$') THEN '_' || {stem} ELSE {stem} END"
    base = f"coalesce(nullif({safe}, ''), 'document-' || coalesce(left(checksum_sha256, 8), ''))"
    return f"CASE WHEN {ext} IS NULL THEN {base} WHEN ends_with(lower({base}), '.' || {ext}) THEN left({base}, length({base}) - length({ext}) - 1) || '.' || {ext} ELSE {base} || '.' || {ext} END"


def unique_names_sql(table: str, folder: str, name: str) -> str:
    """SQL tables that end in unique_names: the rows of a table (id, folder, name) with unique_name."""
    return rf"""rk AS (SELECT *, row_number() OVER (PARTITION BY {folder}, {name} ORDER BY id) AS r, coalesce(nullif(regexp_extract({name}, '^(.+?)(\.[^.]*)?$', 1), ''), '') AS st, regexp_extract({name}, '^.+?(\.[^.]*)$', 1) AS ex FROM {table}),
taken AS (SELECT DISTINCT {folder} AS f, {name} AS taken_name FROM {table}),
forms AS (SELECT DISTINCT rk.{folder} AS f, rk.{name} AS nm, k FROM (SELECT {folder}, {name}, any_value(st) AS st, any_value(ex) AS ex, count(*) AS n, unnest(range(2, count(*) + 64)) AS k FROM rk GROUP BY 1, 2 HAVING count(*) > 1) rk
 WHERE NOT EXISTS (SELECT 1 FROM taken WHERE taken.f = rk.{folder} AND taken_name = rk.st || ' (' || k || ')' || rk.ex)),
freed AS (SELECT f, nm, k, row_number() OVER (PARTITION BY f, nm ORDER BY k) + 1 AS r FROM forms),
unique_names AS (SELECT rk.*, CASE WHEN rk.r = 1 THEN rk.{name} ELSE rk.st || ' (' || freed.k || ')' || rk.ex END AS unique_name FROM rk LEFT JOIN freed ON freed.f = rk.{folder} AND freed.nm = rk.{name} AND freed.r = rk.r)"""


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def joined(c: str = "tags"):
    return F.array_join(c, "|").alias(c)


@query(f"WITH {LIB}, {CON} SELECT id, CASE WHEN regexp_matches(con.text, '\\S') THEN con.text ELSE title END AS text FROM lib LEFT JOIN con ON id = document_id WHERE kind <> 'folder'")
def corpus(spark: SparkSession, d: str) -> DataFrame:
    """Documents with their extracted text, or their title where it is missing or blank (SRC22, JN3)."""
    docs = library(spark, d, "kind", "title").where("kind <> 'folder'")
    return docs.join(contents(spark, d), F.col("id") == F.col("document_id"), "left").select("id", F.when(F.col("text").rlike(r"\S"), F.col("text")).otherwise(F.col("title")).alias("text"))


@query(f"WITH {LIB} SELECT id, CASE WHEN kind = 'folder' THEN 'folder' ELSE 'document' END AS kind, parent_id FROM lib WHERE parent_id = (SELECT parent_id FROM lib WHERE regexp_matches(parent_id, '\\S') GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)")
def children_of_fullest(spark: SparkSession, d: str) -> DataFrame:
    """Children of the folder with most of them (FLT2, FLT3, JN16)."""
    lib = library(spark, d, "kind", "parent_id")
    top = lib.where(F.col("parent_id").rlike(r"\S")).groupBy("parent_id").count().orderBy(F.desc("count"), "parent_id").limit(1)
    return lib.join(F.broadcast(top.select("parent_id")), "parent_id").select("id", rel.node_kind("kind").alias("kind"), "parent_id")


@query(f"WITH {LIB} SELECT id, title, updated_at_ms FROM lib WHERE kind = 'document' ORDER BY updated_at_ms DESC NULLS LAST, id LIMIT 1000 OFFSET 20")
def newest_page(spark: SparkSession, d: str) -> DataFrame:
    """A page of a thousand documents, newest first (TOP1, FLT5); the limit is the page."""
    return rel.query(library(spark, d, "kind", "title", "updated_at_ms"), kind="document", limit=1000, offset=20).select("id", "title", "updated_at_ms")


@query(f"WITH {LIB}, {UP} SELECT lib.id, coalesce(t.tags, '') AS tags FROM lib LEFT JOIN (SELECT document_id, string_agg(tag, '|' ORDER BY tag) AS tags FROM up GROUP BY 1) t ON id = document_id")
def tag_arrays(spark: SparkSession, d: str) -> DataFrame:
    """Every document with its sorted tags, ancestors included (FLT16, JN2, HIER1)."""
    return rel.with_tag_arrays(library(spark, d), tg.with_ancestors(own_tags(spark, d))).select("id", joined())


@query(f"WITH {UP} SELECT document_id AS id FROM up WHERE tag = 'finance' INTERSECT SELECT document_id FROM up WHERE tag = 'urgent' INTERSECT SELECT id FROM documents")
def all_of_tags(spark: SparkSession, d: str) -> DataFrame:
    """Documents that have all of several tags (FLT4, JN1)."""
    return rel.tagged(library(spark, d), own_tags(spark, d), ["finance", "urgent"]).select("id")


@query(f"""WITH {LIB}, {OWN} SELECT id, title FROM lib WHERE (contains(lower(title), '20') OR contains(lower(id), '20')) AND mime_type = 'application/pdf'
AND id IN (SELECT document_id FROM own WHERE tag = 'finance' OR starts_with(tag, 'finance/')) AND id IN (SELECT document_id FROM own WHERE tag = 'inbox' OR starts_with(tag, 'inbox/'))""")
def browse_filter(spark: SparkSession, d: str) -> DataFrame:
    """Browse filters by tag trees, text and file category (FLT6, FLT7, FLT8)."""
    return rel.browse(library(spark, d, "title", "mime_type"), ["finance", "inbox"], " 20 ", "pdf", own_tags(spark, d)).select("id", "title")


@query(f"""WITH {LIB} SELECT id, CASE WHEN mime_type IS NULL THEN NULL WHEN mime_type = 'application/pdf' THEN 'pdf' WHEN starts_with(mime_type, 'text/') THEN 'text' WHEN starts_with(mime_type, 'image/') THEN 'images'
WHEN mime_type IN ('{fx.DOCX_MIME}', '{fx.ODT_MIME}') THEN 'documents' WHEN mime_type = 'message/rfc822' THEN 'email' ELSE 'other' END AS category,
coalesce(regexp_matches(mime_type, '^text/|json|xml|csv'), false) AS text_like, CASE WHEN starts_with(lower(mime_type), 'image/') THEN 'image' WHEN lower(mime_type) = 'application/pdf' THEN 'pdf' WHEN lower(mime_type) = '{fx.DOCX_MIME}' OR regexp_matches(lower(title), '\\.docx$') THEN 'docx' END AS preview FROM lib""")
def file_types(spark: SparkSession, d: str) -> DataFrame:
    """Category, text-likeness and kind of preview by MIME type (FLT8, FLT12, FLT17)."""
    return library(spark, d, "mime_type", "title").select("id", fx.mime_category("mime_type").alias("category"), fx.text_like("mime_type").alias("text_like"), fx.preview_kind("mime_type", "title").alias("preview"))


@query(r"SELECT DISTINCT trim(name) AS name FROM tags WHERE trim(name) IN (SELECT trim(tag) FROM document_tags)")
def tags_in_use(spark: SparkSession, d: str) -> DataFrame:
    """Registry tags that some document has (FLT11, SNK8)."""
    reg = table(spark, d, "tags").select(F.trim("name").alias("name")).distinct()
    return rel.prune_tags(reg, table(spark, d, "document_tags").select(F.trim("tag").alias("tag")))


@query(f"WITH {FB} SELECT term, coalesce(sum(weight) FILTER (action = 'accepted'), 0.0) AS accepts, coalesce(sum(weight) FILTER (action = 'rejected'), 0.0) AS rejects FROM fb GROUP BY 1")
def feedback_totals(spark: SparkSession, d: str) -> DataFrame:
    """Accepted and rejected weight by term (AGG1)."""
    return rel.feedback_stats(feedback(spark, d))


@query(f"""WITH {FB}, s AS (SELECT user_id, coalesce(sum(weight) FILTER (action = 'accepted'), 0.0) AS a, coalesce(sum(weight) FILTER (action = 'rejected'), 0.0) AS r FROM fb GROUP BY 1)
SELECT user_id, round(greatest(0.25, least(4.0, 1 + 0.35 * a - 0.30 * r)), 6) AS score FROM s""")
def preference_scores(spark: SparkSession, d: str) -> DataFrame:
    """Preference by user as term (ML12, JN19)."""
    s = rel.feedback_stats(feedback(spark, d).withColumn("term", F.col("user_id")))
    return s.select(F.col("term").alias("user_id"), F.round(rel.preference(), 6).alias("score"))


@query(f"WITH {UP} SELECT tag AS path, count(DISTINCT document_id) AS documents FROM up WHERE NOT contains(tag, ':') GROUP BY 1")
def contained_counts(spark: SparkSession, d: str) -> DataFrame:
    """Documents below every path (AGG10, HIER4)."""
    return tg.contained_counts(own_tags(spark, d))


@query(f"WITH {OWN} SELECT tag, count(DISTINCT document_id) AS documents FROM own WHERE NOT contains(tag, ':') GROUP BY 1")
def tag_dispersion(spark: SparkSession, d: str) -> DataFrame:
    """Documents per tag (AGG2)."""
    return tg.dispersion(own_tags(spark, d))


@query(f"""WITH {OWN} SELECT s AS segment, count(DISTINCT document_id) AS documents, NOT bool_or(deep) AS is_leaf FROM
(SELECT document_id, string_split(tag, '/')[2] AS s, len(string_split(tag, '/')) > 2 AS deep FROM own WHERE starts_with(tag, 'study/') AND NOT contains(tag, ':')) GROUP BY 1""")
def sub_tags(spark: SparkSession, d: str) -> DataFrame:
    """Next segments below a path (HIER5, TOP8)."""
    return tg.sub_tags(own_tags(spark, d), "study")


@query(f"WITH {OWN} SELECT s AS segment, count(DISTINCT document_id) AS documents, NOT bool_or(deep) AS is_leaf FROM (SELECT document_id, string_split(tag, '/')[1] AS s, contains(tag, '/') AS deep FROM own WHERE NOT contains(tag, ':')) GROUP BY 1")
def top_level_tags(spark: SparkSession, d: str) -> DataFrame:
    """Top-level tags with their documents (HIER7, HIER3)."""
    return tg.sub_tags(own_tags(spark, d))


@query(f"""WITH {OWN}, p AS (SELECT unnest(['finance', 'finance/bank']) AS p), c AS (SELECT DISTINCT p, string_split(substr(tag, length(p) + 2), '/')[1] AS s FROM own, p WHERE starts_with(tag, p || '/') AND NOT contains(tag, ':'))
SELECT DISTINCT p || '/' || s AS tag FROM c WHERE s NOT IN ('finance', 'bank', 'savin')""")
def derived_sub_tags(spark: SparkSession, d: str) -> DataFrame:
    """Children of every prefix of a path (HIER6)."""
    return tg.derived_sub_tags(own_tags(spark, d), "finance/bank/savin")


@query(f"WITH {UP} SELECT DISTINCT document_id FROM up WHERE tag = 'inbox' AND document_id NOT IN (SELECT document_id FROM up WHERE starts_with(tag, 'inbox/'))")
def directly_assigned(spark: SparkSession, d: str) -> DataFrame:
    """Documents with a tag and nothing deeper (HIER9)."""
    return tg.direct(tg.with_ancestors(own_tags(spark, d)), "inbox")


@query(f"""WITH {UP}, held AS (SELECT * FROM up WHERE document_id IN (SELECT document_id FROM up WHERE tag = 'finance')), x AS (SELECT document_id, tag, string_split(tag, '/') AS s FROM held WHERE tag <> 'finance' AND NOT contains(tag, ':'))
SELECT tag, count(DISTINCT document_id) AS documents FROM x WHERE len(s) = 1 OR (len(s) = 2 AND s[1] = 'finance') GROUP BY 1""")
def children_of_walk(spark: SparkSession, d: str) -> DataFrame:
    """Tags that go on from a walk (HIER8, TOP9, SET4)."""
    return tg.children_of_walk(tg.with_ancestors(own_tags(spark, d)), ["finance"])


@query(f"WITH {UP} SELECT u.document_id, u.tag FROM up u WHERE contains(u.tag, ':') OR NOT EXISTS (SELECT 1 FROM up o WHERE o.document_id = u.document_id AND NOT contains(o.tag, ':') AND starts_with(o.tag, u.tag || '/'))")
def maximal_tags(spark: SparkSession, d: str) -> DataFrame:
    """Tags without their ancestors (HIER10)."""
    return tg.maximal(tg.with_ancestors(own_tags(spark, d)))


@query(f"""WITH {UP}, t AS (SELECT DISTINCT tag, lower(tag) AS l FROM up WHERE NOT contains(tag, ':')), m AS (SELECT tag, CASE WHEN l = 'le' THEN 1 WHEN starts_with(l, 'le') THEN 2 WHEN len(list_filter(string_split(l, '/'), lambda s: starts_with(s, 'le'))) > 0 THEN 3 WHEN regexp_matches(replace(l, '/', ''), 'l.*e') THEN 4 END AS tier FROM t)
SELECT tag, tier FROM m WHERE tier IS NOT NULL ORDER BY tier, length(tag), tag LIMIT 8""")
def tag_completions(spark: SparkSession, d: str) -> DataFrame:
    """Completions of a typed prefix; the limit is the feature (HIER11, TOP10, FN33)."""
    return tg.completions(tg.with_ancestors(own_tags(spark, d)), "le")


@query(f"WITH {OWN} SELECT DISTINCT document_id, CASE WHEN tag = 'urgent' THEN 'todo/now' ELSE tag END AS tag FROM own WHERE document_id IN (SELECT document_id FROM own WHERE tag = 'urgent')")
def tag_rename(spark: SparkSession, d: str) -> DataFrame:
    """Tag sets after a rename, of the documents it touches (HIER12, AGG16)."""
    return tg.renamed(own_tags(spark, d), "urgent", "todo/now")


@query(f"""WITH {OWN}, u AS (SELECT DISTINCT tag FROM own) SELECT tag, CASE WHEN starts_with(tag, '/') THEN 'Tag must not start with a slash' WHEN ends_with(tag, '/') THEN 'Tag must not end with a slash' WHEN contains(tag, '//') THEN 'Tag must not contain double slashes'
WHEN len(string_split(tag, '/')) > 8 THEN 'Tag must have at most 8 segments' WHEN list_max(list_transform(string_split(tag, '/'), lambda s: length(s))) > 60 THEN 'Segment must be at most 60 characters' WHEN regexp_matches(tag, '[\\x00-\\x1f\\x7f:]') THEN 'Segment contains invalid characters' END AS error,
string_split(tag, '/')[1] AS top, CASE WHEN contains(tag, '/') THEN regexp_extract(tag, '^(.*)/[^/]*$', 1) ELSE '' END AS parent, string_split(tag, '/')[-1] AS last FROM u""")
def tag_paths(spark: SparkSession, d: str) -> DataFrame:
    """Validity and parts of every tag (FLT14, FN34, HIER2)."""
    return own_tags(spark, d).select("tag").distinct().select("tag", tg.path_error("tag").alias("error"), tg.top_level("tag").alias("top"), tg.parent("tag").alias("parent"), tg.last_segment("tag").alias("last"))


@query(f"WITH {UP}, {MAIN_PATHS} SELECT document_id, path FROM paths")
def main_paths(spark: SparkSession, d: str) -> DataFrame:
    """The folder path that a document's tags give it (HIER15)."""
    return tg.main_paths(tg.with_ancestors(own_tags(spark, d)))


@query(f"WITH {OWN}, x AS (SELECT document_id, tag FROM own UNION SELECT DISTINCT document_id, 'kept' FROM own) SELECT document_id, string_agg(tag, '|' ORDER BY tag) AS tags FROM x WHERE tag <> 'inbox' GROUP BY 1")
def bulk_tag_edit(spark: SparkSession, d: str) -> DataFrame:
    """Tags added and taken off in bulk (SNK21, SET3)."""
    g = own_tags(spark, d).groupBy("document_id").agg(F.collect_set("tag").alias("tags"))
    return g.select("document_id", F.array_join(F.array_sort(rel.bulk_tags(F.col("tags"), [" kept ", ""], ["inbox"])), "|").alias("tags"))


@query("""WITH n AS (SELECT id, checksum_sha256, updated_at_ms, title FROM manifest WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY updated_at_ms DESC NULLS LAST, entry_id DESC) = 1),
l AS (SELECT id, checksum_sha256, updated_at_ms, title FROM documents WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY ingested_at DESC NULLS LAST, doc_id DESC) = 1)
SELECT * FROM n UNION ALL SELECT * FROM l WHERE id NOT IN (SELECT id FROM n)""")
def upsert_documents(spark: SparkSession, d: str) -> DataFrame:
    """Documents with what peers report put over them (SNK3, SNK5, SNK6)."""
    cols = ["id", "checksum_sha256", "updated_at_ms", "title"]
    new = table(spark, d, "manifest").where("id IS NOT NULL").groupBy("id").agg(F.max_by(F.struct(*cols[1:]), F.struct("updated_at_ms", "entry_id")).alias("x")).select("id", "x.*")
    return rel.upsert(library(spark, d, *cols[1:]).select(*cols), new, ["id"])


@query(f"WITH {LIB}, {OWN} SELECT document_id, tag FROM own WHERE document_id IN (SELECT id FROM lib WHERE mime_type IS DISTINCT FROM 'message/rfc822')")
def delete_cascade(spark: SparkSession, d: str) -> DataFrame:
    """Tags that are left when all mail is deleted (SNK4, JN18)."""
    lib = library(spark, d, "mime_type")
    out = rel.delete_documents({"documents": lib, "document_tags": own_tags(spark, d).join(lib.select("id"), F.col("document_id") == F.col("id"), "left_semi")}, lib.where("mime_type = 'message/rfc822'"))
    return out["document_tags"]


@query(rf"""WITH {LIB} SELECT id, lower(string_split(title, '.')[-1]) AS extension, CASE WHEN length(array_to_string(w, '_')) = 0 THEN 'document' ELSE '' END AS empty_name, left(regexp_replace(regexp_replace(title, '\s+', ' ', 'g'), '^ | $', '', 'g'), 240) AS excerpt, regexp_replace(title, '[-_. ]+$', '') AS trimmed
FROM (SELECT *, list_filter(string_split(regexp_replace(coalesce(title, ''), '[/\\:*?"<>|\s._]+', ' ', 'g'), ' '), lambda x: x <> '') AS w FROM lib)""")
def title_forms(spark: SparkSession, d: str) -> DataFrame:
    """Extension, excerpt and trimmed form of titles (FN8, FN10, FN32, FN5)."""
    return library(spark, d, "title").select("id", fx.extension("title").alias("extension"), F.when(fx.sanitized("title") == "document", "document").otherwise("").alias("empty_name"), fx.excerpt("title").alias("excerpt"), fx.trailing_separators("title").alias("trimmed"))


@query(f"WITH {LIB}, named AS (SELECT id, coalesce(parent_id, '') AS folder, {file_name_sql()} AS name FROM lib), {unique_names_sql('named', 'folder', 'name')} SELECT id, folder, name, unique_name FROM unique_names")
def file_names(spark: SparkSession, d: str) -> DataFrame:
    """A friendly and unique file name for every document within its folder (FN14, FN15, TOP15)."""
    docs = library(spark, d, "parent_id", "title", "mime_type", "checksum_sha256").withColumn("name", fx.file_name("title", F.lit(None).cast("string"), "mime_type", "checksum_sha256")).withColumn("folder", F.coalesce("parent_id", F.lit("")))
    return rel.sibling_names(docs, "folder", "name", "id").select("id", "folder", "name", "unique_name")


@query(rf"""WITH {CON}, x AS (SELECT document_id, coalesce(text, '') AS t, greatest(instr(lower(coalesce(text, '')), 'invoice') - 1, 0) AS pos FROM con WHERE text IS NOT NULL),
y AS (SELECT *, greatest(pos - 70, 0) AS a, least(pos + 177, length(t)) AS b FROM x)
SELECT document_id, CASE WHEN a > 0 THEN '…' ELSE '' END || substr(t, CAST(a + 1 AS BIGINT), CAST(b - a AS BIGINT)) || CASE WHEN b < length(t) THEN '…' ELSE '' END AS snippet,
greatest(len(list_filter(regexp_split_to_array(t, '\s+'), lambda x: x <> '')), 1) AS words_used FROM y""")
def snippets(spark: SparkSession, d: str) -> DataFrame:
    """The text around a query's first place in every text, and how many words a model is charged for it (FN21, AGG14)."""
    return contents(spark, d).where("text IS NOT NULL").select("document_id", fx.centred_snippet("text", "invoice").alias("snippet"), fx.words_used("text").cast("long").alias("words_used"))


@query(rf"""WITH {OWN}, u AS (SELECT DISTINCT tag FROM own), c AS (SELECT tag, list_transform(string_split(tag, ''), lambda x: CAST(unicode(x) AS BIGINT)) AS u FROM u)
SELECT tag, list_reduce(list_prepend(CAST(2166136261 AS BIGINT), u), lambda h, x: (xor(h, x) * 16777619) % 4294967296) AS colour FROM c""")
def tag_colours(spark: SparkSession, d: str) -> DataFrame:
    """The hash that picks each tag's colour (FN26)."""
    return own_tags(spark, d).select("tag").distinct().select("tag", fx.fnv32("tag").alias("colour"))


@query(rf"""WITH {LIB}, r AS (SELECT id, regexp_extract(coalesce(extra['original_name'], 'document-' || id), '([^/\\]*)$', 1) AS base FROM lib),
k AS (SELECT id, regexp_replace(regexp_replace(regexp_replace(base, '[^A-Za-z0-9._-]+', '_', 'g'), '^[_\\.]+', ''), '[_\\.]+$', '') AS kept FROM r)
SELECT id, CASE WHEN kept = '' THEN 'document-' || id ELSE kept END AS name FROM k""")
def temporary_names(spark: SparkSession, d: str) -> DataFrame:
    """The name of each document's temporary copy (FN38)."""
    return library(spark, d, "extra").select("id", fx.safe_base_name(F.try_element_at("extra", F.lit("original_name")), "id").alias("name"))


@query(f"WITH {LIB}, {OWN} SELECT DISTINCT tag FROM own WHERE document_id IN (SELECT id FROM lib WHERE mime_type = 'application/pdf')")
def removable_tags(spark: SparkSession, d: str) -> DataFrame:
    """The tags that can be taken off a choice of documents, here all PDF files (SET8)."""
    return rel.removable(own_tags(spark, d), library(spark, d, "mime_type").where("mime_type = 'application/pdf'"))


@query(f"""WITH {OWN}, h AS (SELECT document_id, list(tag ORDER BY tag) AS tags FROM own GROUP BY 1), k AS (SELECT list(DISTINCT tag) AS known FROM own WHERE NOT contains(tag, '/'))
SELECT document_id, array_to_string(list_sort(list_filter(known, lambda x: NOT list_contains(tags, x))), '|') AS offered, tags = ['finance', 'finance/tax'] AS active FROM h, k""")
def tag_offers(spark: SparkSession, d: str) -> DataFrame:
    """Top-level tags that each document lacks, offered for one tap, and whether its tags are just those of a saved view (SET6, FLT13)."""
    own = own_tags(spark, d)
    known = own.where("NOT contains(tag, '/')").agg(F.collect_set("tag").alias("known"))  # one row: the registry's top level
    h = own.groupBy("document_id").agg(F.collect_set("tag").alias("tags")).crossJoin(F.broadcast(known))
    view = F.array(F.lit("finance/tax"), F.lit("finance"))
    return h.select("document_id", F.array_join(F.array_sort(rel.one_tap("known", F.array().cast("array<string>"), "tags")), "|").alias("offered"), rel.view_active("tags", view).alias("active"))


@query(f"WITH {LIB} SELECT checksum_sha256 FROM (SELECT DISTINCT lower(checksum_sha256) AS checksum_sha256 FROM manifest WHERE regexp_matches(lower(checksum_sha256), '^[0-9a-f]{{64}}$')) WHERE checksum_sha256 NOT IN (SELECT lower(checksum_sha256) FROM lib WHERE checksum_sha256 IS NOT NULL)")
def unreferenced_blobs(spark: SparkSession, d: str) -> DataFrame:
    """Hashes that peers report and no document refers to: blobs to delete (JN10, SNK2, SNK4)."""
    keys = table(spark, d, "manifest").select(F.lower("checksum_sha256").alias("checksum_sha256")).where("checksum_sha256 RLIKE '^[0-9a-f]{64}$'").distinct()
    return unreferenced(keys, library(spark, d, "checksum_sha256"))


@query(f"""WITH RECURSIVE {UP}, c AS (SELECT tag, count(DISTINCT document_id) AS n FROM up WHERE NOT contains(tag, ':') GROUP BY 1),
ch AS (SELECT CASE WHEN contains(tag, '/') THEN regexp_extract(tag, '^(.*)/[^/]*$', 1) ELSE '' END AS parent, tag, n FROM c),
only_ AS (SELECT ch.parent, any_value(ch.tag) AS tag FROM ch JOIN c ON c.tag = ch.parent GROUP BY ch.parent, c.n HAVING count(*) = 1 AND any_value(ch.n) = c.n),
walk AS (SELECT tag AS path, tag AS shown FROM c UNION ALL SELECT path, only_.tag FROM walk JOIN only_ ON shown = only_.parent)
SELECT path, max_by(shown, length(shown)) AS shown FROM walk GROUP BY 1""")
def collapsed_paths(spark: SparkSession, d: str) -> DataFrame:
    """For every path the deepest one that holds just its documents, through only children (HIER14)."""
    return tg.collapsed(own_tags(spark, d))
