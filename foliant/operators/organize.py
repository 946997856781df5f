"""Plans of organisation (title, tags, duplicate) and the suggestions made from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import rendered_title, squeeze, tokens_ascii
from ..session import checkpoint, small
from . import tfidf
from .relations import preference

MOST_TAGS, MOST_ALTERNATIVES, NEIGHBOURS = 4, 5, 5


def ordered(df: DataFrame, keys: list[Column], value: str, name: str) -> DataFrame:
    """(doc, name): the values of each document as an array in the order of the keys."""
    return df.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct(*[k.alias(f"k{i}") for i, k in enumerate(keys)], F.col(value).alias("v")))).alias("x")).select("doc", F.transform("x", lambda s: s["v"]).alias(name))


def empty() -> Column:
    return F.array().cast("array<string>")


def by_preference(values: Column, score) -> Column:
    """An array by falling score, in its own order where scores are equal."""
    keyed = F.transform(values, lambda x, i: F.struct((-F.round(score(x), 9)).alias("s"), i.alias("i"), x.alias("v")))
    return F.transform(F.array_sort(keyed), lambda x: x["v"])


def applied_title(suggested: Column | str) -> Column:
    """The title that is set for a suggestion: trimmed, without separators at its end unless nothing else is left."""
    s = F.col(suggested) if isinstance(suggested, str) else suggested
    cut = F.regexp_replace(F.trim(s), r"[-_. ]+$", "")
    return F.when(cut == "", s).otherwise(cut)


def applied_at_ingest(plan: DataFrame, documents: DataFrame) -> DataFrame:
    """documents (document_id, title, tags) with the planned tags and title; those without a plan stay as they are."""
    p = plan.select(F.col("document_id").alias("p"), F.col("tags").alias("p_tags"), "suggested_title")
    j = documents.join(p, F.col("document_id") == F.col("p"), "left")
    title = F.when(F.col("suggested_title").rlike(r"\S"), applied_title("suggested_title")).otherwise(F.col("title"))
    return j.select("document_id", title.alias("title"), F.coalesce("p_tags", "tags").alias("tags"))


def suggest(plan: DataFrame, current: DataFrame, stored: DataFrame, kind: str, now_ms: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(outcome, documents afterwards, suggestions afterwards) of asking for titles or for tags.

    outcome: document_id, status, pending. The first suggestion is applied if it isn't what the document has:
    Applied, AlreadyCurrent or NoSuggestion; pending counts the alternatives left to choose from.
    """
    rows = suggestions_of(plan, current, "manual_request", now_ms).where(F.col("kind") == kind)
    after = store_suggestions(stored, rows)
    j = current.join(plan.select(F.col("document_id").alias("p"), F.col("tags").alias("p_tags"), "suggested_title"), F.col("document_id") == F.col("p"))
    new = applied_title("suggested_title") if kind == "title" else F.col("p_tags")
    given = F.col("suggested_title").rlike(r"\S") if kind == "title" else F.size("p_tags") > 0
    differs = ~new.eqNullSafe(F.col("title")) if kind == "title" else F.array_sort("p_tags") != F.array_sort("tags")
    j = j.withColumn("status", F.when(~F.coalesce(given, F.lit(False)), "NoSuggestion").when(differs, "Applied").otherwise("AlreadyCurrent")).withColumn("new", new)
    open_ = after.where((F.col("kind") == kind) & (F.col("status") == "pending")).groupBy(F.col("document_id").alias("o")).agg(F.count("*").alias("pending"))
    outcome = j.join(open_, F.col("document_id") == F.col("o"), "left").select("document_id", "status", F.coalesce("pending", F.lit(0)).alias("pending"))
    column = "title" if kind == "title" else "tags"
    done = j.where("status = 'Applied'").select(F.col("document_id").alias("d"), "new")
    docs = current.join(done, F.col("document_id") == F.col("d"), "left").withColumn(column, F.coalesce("new", column)).drop("d", "new")
    return outcome, docs, after


def plans(corpus: DataFrame, tags: DataFrame, asked: DataFrame, emergent: list[str] = (), stats: DataFrame | None = None, duplicates: DataFrame | None = None, title_stats: DataFrame | None = None) -> DataFrame:
    """(document_id, tags, alt_tag_sets, suggested_title, alt_titles, is_duplicate_of) for the asked documents.

    corpus: id, title, text. tags: document_id, tag. asked: doc, a stated set. emergent: top terms of the
    corpus' clusters. stats: term, accepts, rejects of tags; with it tags go by weight times preference and alternative
    sets by the sum of their tags' preferences. title_stats: the same of titles, for the alternative ones. All asked documents are
    planned on one snapshot in one job; ids that aren't in the corpus get no row.
    """
    idf = checkpoint(tfidf.document_frequencies(corpus, "text", corpus.count()))
    own = checkpoint(asked.select("doc").distinct())
    votes = tfidf.tag_votes(tfidf.near_texts(corpus, "id", "text", idf, own, tags.select(F.col("document_id").alias("doc")), NEIGHBOURS), tags)
    knn = ordered(votes.withColumn("votes", F.round("votes", 9)), [-F.col("votes"), F.col("tag")], "tag", "knn")
    mine = corpus.join(small(own), F.col("id") == F.col("doc"), "left_semi")
    vec = tfidf.vectors(tfidf.term_frequencies(mine, "id", "text"), idf)
    top = tfidf.top_terms(vec.withColumn("weight", F.round("weight", 9)), 5)
    kw = ordered(top, [F.col("rank")], "term", "kw")
    pool = tfidf.top_terms(tfidf.title_pool(mine, "id", "text", "title", idf).withColumn("weight", F.round("weight", 9)), 5)
    tt = ordered(pool, [F.col("rank")], "term", "tt")
    base = mine.select(F.col("id").alias("doc"), "title").join(knn, "doc", "left").join(kw, "doc", "left").join(tt, "doc", "left")
    base = base.select("doc", "title", *[F.coalesce(c, empty()).alias(c) for c in ("knn", "kw", "tt")], F.array(*map(F.lit, emergent)).cast("array<string>").alias("cl"))
    # keywords fall back to the title's words, in order of the alphabet
    base = base.withColumn("kw", F.when(F.size("kw") > 0, F.col("kw")).otherwise(F.array_sort(F.array_distinct(tokens_ascii("title")))))
    chosen = F.slice(F.array_distinct(F.concat("knn", "cl")), 1, MOST_TAGS)
    base = base.withColumn("tags", F.when(F.size(chosen) > 0, chosen).otherwise(F.slice("kw", 1, MOST_TAGS)))
    if stats is not None:
        scores = stats.select("term", preference().alias("s"))
        pos = base.select("doc", F.posexplode("tags").alias("p", "term")).join(scores, "term", "left")
        n = F.size("tags")
        ranked = ordered(pos.join(base.select("doc", n.alias("n")), "doc"), [-F.round((F.col("n") - F.col("p")) * F.coalesce("s", F.lit(1.0)), 9), F.col("p")], "term", "reranked")
        base = base.join(ranked, "doc", "left").withColumn("tags", F.coalesce("reranked", "tags")).drop("reranked")
        mine_too = base.select("doc", F.explode(F.array_union(F.concat("knn", "cl"), "kw")).alias("term")).distinct()
        liked = mine_too.join(scores, "term").groupBy("doc").agg(F.map_from_entries(F.collect_list(F.struct("term", "s"))).alias("liked"))
        base = base.join(liked, "doc", "left")
    title = rendered_title("tt")
    alt = F.array(F.when(F.size("tt") >= 2, F.concat_ws(" ", F.get("tt", F.lit(0)), F.get("tt", F.lit(1)))), F.when(F.size("tt") >= 3, F.concat_ws(" ", F.get("tt", F.lit(0)), F.get("tt", F.lit(1)), F.get("tt", F.lit(2)))), F.get("tt", F.lit(0)), F.nullif(squeeze("title"), F.lit("")))
    sets = F.array("knn", "cl", F.slice("kw", 1, 4), F.slice("tags", 1, 3))
    keyed = F.filter(F.transform(sets, F.array_distinct), lambda s: F.size(s) > 0)
    seen = F.aggregate(keyed, F.array().cast("array<array<string>>"), lambda acc, s: F.when(F.exists(acc, lambda o: F.array_sort(o) == F.array_sort(s)), acc).otherwise(F.concat(acc, F.array(s))))
    if stats is not None:
        seen = by_preference(seen, lambda x: F.aggregate(x, F.lit(0.0), lambda a, t: a + F.coalesce(F.try_element_at("liked", t), F.lit(1.0))))
    titles = F.array_distinct(F.filter(alt, lambda t: t.isNotNull()))
    if title_stats is not None:
        asked_titles = base.select("doc", F.explode(titles).alias("term")).join(title_stats.select("term", preference().alias("s")), "term")
        base = base.join(asked_titles.groupBy("doc").agg(F.map_from_entries(F.collect_list(F.struct("term", "s"))).alias("liked_titles")), "doc", "left")
        titles = by_preference(titles, lambda t: F.coalesce(F.try_element_at("liked_titles", t), F.lit(1.0)))
    out = base.withColumn("suggested_title", title).select(
        F.col("doc").alias("document_id"),
        "tags",
        F.slice(F.filter(seen, lambda s: F.array_sort(s) != F.array_sort(F.col("tags"))), 1, MOST_ALTERNATIVES).alias("alt_tag_sets"),
        "suggested_title",
        F.slice(F.filter(titles, lambda t: t != F.col("suggested_title")), 1, MOST_ALTERNATIVES).alias("alt_titles"),
    )
    if duplicates is None:
        return out.withColumn("is_duplicate_of", F.lit(None).cast("string"))
    d = duplicates.select(F.col("id").alias("document_id"), F.col("duplicate_of").alias("is_duplicate_of"))
    return out.join(d, "document_id", "left")


def suggestions_of(plan: DataFrame, current: DataFrame, source: str, now_ms: int) -> DataFrame:
    """Suggestion rows of plans: rank 0 applied, others pending; a document's old title or tags come in at rank 1.

    current: document_id, title, tags. Ids are <document>-<kind>-<rank>.
    """
    j = plan.join(current.select("document_id", F.col("title").alias("old_title"), F.array_sort("tags").alias("old_tags")), "document_id", "left")
    titles = F.concat(F.array("suggested_title"), F.when(F.col("old_title").isNotNull() & (F.col("old_title") != F.col("suggested_title")), F.array("old_title")).otherwise(empty()), "alt_titles")
    old = F.when((F.size("old_tags") > 0) & (F.col("old_tags") != F.array_sort("tags")), F.array(F.col("old_tags"))).otherwise(F.array().cast("array<array<string>>"))
    sets = F.transform(F.concat(F.array("tags"), old, "alt_tag_sets"), lambda x: F.to_json(x))
    parts = [j.select("document_id", F.lit(kind).alias("kind"), F.posexplode(F.array_distinct(values)).alias("rank", "payload")) for kind, values in (("title", titles), ("tags", sets))]
    every = parts[0].unionAll(parts[1])
    return every.select(F.concat_ws("-", "document_id", "kind", F.col("rank").cast("string")).alias("id"), "document_id", "kind", "payload", "rank", F.lit(source).alias("source"), F.lit(1.0).alias("confidence"), F.when(F.col("rank") == 0, "applied").otherwise("pending").alias("status"), F.lit(now_ms).cast("long").alias("created_at_ms"))


def store_suggestions(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old rows of the documents in new are dismissed unless applied, then new rows take the place of those with their id.

    A replaced row keeps its kind, document and time of creation.
    """
    from .relations import upsert

    hit = new.select(F.col("document_id").alias("d")).distinct()
    marked = old.join(hit, F.col("document_id") == F.col("d"), "left").withColumn("status", F.when(F.col("d").isNotNull() & (F.col("status") != "applied"), "dismissed").otherwise(F.col("status"))).drop("d")
    return upsert(marked, new, ["id"], ["kind", "document_id", "created_at_ms"])


def terms_of(s: DataFrame) -> DataFrame:
    """(document_id, kind, status, id, term): a title is one term, a payload of tags as many; a corrupt payload none."""
    terms = F.when(F.col("kind") == "tags", F.coalesce(F.from_json("payload", "array<string>"), empty())).otherwise(F.array("payload"))
    return s.select("document_id", "kind", "status", "id", F.explode(terms).alias("term"))


def feedback_rows(terms: DataFrame, action: str, weight: float, now_ms: int) -> DataFrame:
    return terms.select(F.concat_ws("-", "document_id", "kind", "term", F.lit(action), F.lit(str(now_ms))).alias("id"), "kind", F.when(F.col("kind") == "tags", "tag").otherwise("title").alias("context"), "term", F.lit(action).alias("action"), F.lit(weight).alias("weight"), F.lit(now_ms).cast("long").alias("created_at_ms")).distinct()


def apply_suggestion(s: DataFrame, ident: str, now_ms: int) -> tuple[DataFrame, DataFrame]:
    """(suggestions, feedback): one applied, its siblings dismissed; its terms accepted at 1, tags at 2 more for the user's edit."""
    one = s.where(F.col("id") == ident)
    key = one.select(F.col("document_id").alias("d"), F.col("kind").alias("k"))
    out = s.join(F.broadcast(key), (F.col("document_id") == F.col("d")) & (F.col("kind") == F.col("k")), "left")
    out = out.withColumn("status", F.when(F.col("id") == ident, "applied").when(F.col("d").isNotNull(), "dismissed").otherwise(F.col("status"))).drop("d", "k")
    t = terms_of(one)
    return out, feedback_rows(t, "accepted", 1.0, now_ms).unionByName(feedback_rows(t, "accepted", 2.0, now_ms + 1))


def confirm_current(s: DataFrame, asked: DataFrame, now_ms: int) -> tuple[DataFrame, DataFrame]:
    """(suggestions, feedback): for documents with something pending, applied terms are accepted, terms only pending rejected.

    asked: document_id. Pending rows are dismissed; documents without any stay as they are.
    """
    t = terms_of(s.join(asked, "document_id", "left_semi"))
    busy = t.where("status = 'pending'").select("document_id").distinct()
    t = t.join(busy, "document_id", "left_semi")
    applied = t.where("status = 'applied'").select("document_id", "kind", "term").distinct()
    pending = t.where("status = 'pending'").select("document_id", "kind", "term").distinct().join(applied, ["document_id", "kind", "term"], "left_anti")
    out = s.join(busy.withColumnRenamed("document_id", "b"), F.col("document_id") == F.col("b"), "left").withColumn("status", F.when(F.col("b").isNotNull() & (F.col("status") == "pending"), "dismissed").otherwise(F.col("status"))).drop("b")
    return out, feedback_rows(applied, "accepted", 1.0, now_ms).unionByName(feedback_rows(pending, "rejected", 1.0, now_ms))


def dismiss(s: DataFrame, ident: str, now_ms: int) -> tuple[DataFrame, DataFrame]:
    """(suggestions, feedback): one dismissed, its terms rejected."""
    out = s.withColumn("status", F.when(F.col("id") == ident, "dismissed").otherwise(F.col("status")))
    return out, feedback_rows(terms_of(s.where(F.col("id") == ident)), "rejected", 1.0, now_ms)


def resolve_edit(s: DataFrame, document: str, kind: str, kept: list[str], now_ms: int) -> tuple[DataFrame, DataFrame, int]:
    """(suggestions, feedback, number dismissed) after a user's own edit: open rows of the kind are dismissed, terms not kept rejected."""
    hit = (F.col("document_id") == document) & (F.col("kind") == kind) & F.col("status").isin("pending", "applied")
    n = s.where(hit).count()
    t = terms_of(s.where(hit))
    t = t.where(~F.col("term").isin(kept)) if kept else t
    return s.withColumn("status", F.when(hit, "dismissed").otherwise(F.col("status"))), feedback_rows(t, "rejected", 1.0, now_ms), n


def pruned(s: DataFrame, before_ms: int) -> DataFrame:
    """Without rows that aren't pending and older than the cutoff."""
    return s.where((F.col("status") == "pending") | (F.col("created_at_ms") >= before_ms))


def listed(s: DataFrame, document: str, kind: str | None = None) -> DataFrame:
    out = s.where(F.col("document_id") == document)
    return (out.where(F.col("kind") == kind) if kind else out).orderBy("kind", "rank", "created_at_ms")


def bulk_outcome(before: DataFrame, after: DataFrame, same_sets: bool = True) -> DataFrame:
    """One row total, updated, skipped: how many documents a plan changes. before and after: document_id, title, tags.

    With same_sets, tags in another order are no change.
    """
    form = F.array_sort if same_sets else (lambda c: F.col(c))
    a = before.select("document_id", F.col("title").alias("t0"), form("tags").alias("g0"))
    b = after.select("document_id", F.col("title").alias("t1"), form("tags").alias("g1"))
    changed = ~(F.col("t0").eqNullSafe(F.col("t1")) & F.col("g0").eqNullSafe(F.col("g1")))
    return a.join(b, "document_id").agg(F.count("*").alias("total"), F.coalesce(F.sum(changed.cast("long")), F.lit(0)).alias("updated")).withColumn("skipped", F.col("total") - F.col("updated"))


def changed(before: DataFrame, after: DataFrame) -> DataFrame:
    """The rows of after (document_id, title, tags) that differ from before in title or set of tags."""
    a = before.select(F.col("document_id").alias("b_id"), F.col("title").alias("b_title"), F.array_sort("tags").alias("b_tags"))
    j = after.join(a, F.col("document_id") == F.col("b_id"))
    return j.where(~(F.col("title").eqNullSafe(F.col("b_title")) & F.col("b_tags").eqNullSafe(F.array_sort("tags")))).select(after.columns)
