"""Upserts, deletes and predicates on the library's relations, as pure transforms."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..session import checkpoint
from .ranking import numbered
from .tags import with_ancestors


def upsert(old: DataFrame, new: DataFrame, keys: list[str], keep: list[str] = ()) -> DataFrame:
    """Rows of new replace those of old with the same keys; columns in keep stay as they were.

    If new has several rows for a key the last one by all its columns counts, so the result is the same
    whatever the partitions. One shuffle on the keys.
    """
    rest = [c for c in old.columns if c not in keys]
    both = old.select(*old.columns, F.lit(0).alias("_new")).unionByName(new.select(*old.columns, F.lit(1).alias("_new")))
    sort = [F.col(c) for c in rest if old.schema[c].dataType.typeName() != "map"]
    latest = F.max_by(F.struct(*rest), F.struct("_new", *sort)).alias("x")
    first = [F.min_by(c, "_new").alias(f"_keep_{c}") for c in keep]
    g = both.groupBy(*keys).agg(latest, *first)
    return g.select(*[c if c in keys else F.col(f"_keep_{c}").alias(c) if c in keep else F.col(f"x.{c}").alias(c) for c in old.columns])


def delete(df: DataFrame, gone: DataFrame, key: str, by: str = "id") -> DataFrame:
    return df.join(gone.select(F.col(by).alias("_gone")).distinct(), F.col(key) == F.col("_gone"), "left_anti")


def delete_documents(relations: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """Documents out of all relations: their content, tags, links and suggestions go with them; unused tags too."""
    out = dict(relations)
    out["documents"] = delete(out["documents"], gone, "id")
    for name, keys in (("content", ["document_id"]), ("document_tags", ["document_id"]), ("suggestions", ["document_id"]), ("links", ["parent_id", "child_id"])):
        for k in keys if name in out else []:
            out[name] = delete(out[name], gone, k)
    if "tags" in out:
        out["tags"] = prune_tags(out["tags"], out["document_tags"])
    return out


def prune_tags(registry: DataFrame, tags: DataFrame) -> DataFrame:
    """The registry without tags that no document has."""
    return registry.join(tags.select(F.col("tag").alias("name")).distinct(), "name", "left_semi")


def set_tags(tags: DataFrame, new: DataFrame, documents: DataFrame) -> DataFrame:
    """The tag sets of the documents in new replaced, ancestors added; ids that are no document are ignored."""
    known = new.join(documents.select(F.col("id").alias("document_id")), "document_id", "left_semi")
    return delete(tags, known, "document_id", "document_id").unionByName(with_ancestors(known.where("tag IS NOT NULL")))


def bulk_tags(tags: Column, add: list[str], remove: list[str]) -> Column:
    """An array of tags with blanks dropped, missing ones appended, then the removals taken out."""
    plus = [t.strip() for t in add if t.strip()]
    minus = [t.strip() for t in remove if t.strip()]
    out = F.array_union(tags, F.array(*map(F.lit, plus)).cast("array<string>"))
    return F.array_except(out, F.array(*map(F.lit, minus)).cast("array<string>"))


def with_tag_arrays(documents: DataFrame, tags: DataFrame) -> DataFrame:
    """documents with column tags: sorted, empty where there is none."""
    g = tags.groupBy("document_id").agg(F.array_sort(F.collect_set("tag")).alias("tags"))
    return documents.join(g, F.col("id") == F.col("document_id"), "left").drop("document_id").withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))


def stamped(extra, key: str, value: str | Column) -> Column:
    """extra with the key set, whether or not it was there."""
    base = F.coalesce(extra, F.create_map().cast("map<string,string>"))
    return F.map_concat(F.map_filter(base, lambda k, v: k != key), F.create_map(F.lit(key), F.lit(value) if isinstance(value, str) else value))


def node_kind(c) -> Column:
    """What isn't a folder reads as a document."""
    return F.when(F.col(c) == "folder", "folder").otherwise("document")


def decoded_extra(c) -> Column:
    """The JSON text of extra as a map; a corrupt one as an empty map."""
    return F.coalesce(F.from_json(c, "map<string,string>"), F.create_map().cast("map<string,string>"))


def query(documents: DataFrame, kind: str | None = None, parent: str | None = None, tags: list[str] = (), limit: int | None = None, offset: int = 0) -> DataFrame:
    """Documents by optional predicates, all of which must hold; newest first, ids breaking ties.

    documents needs the column tags where tags are asked for.
    """
    where = [F.lit(True)]
    if kind is not None:
        where.append(node_kind("kind") == kind)
    if parent is not None:
        where.append(F.col("parent_id") == parent)
    where += [F.array_contains("tags", t) for t in tags]
    out = documents.where(reduce(lambda a, b: a & b, where))
    if limit is not None or offset:
        out = out.orderBy(F.desc_nulls_last("updated_at_ms"), "id")
        out = out.offset(offset) if offset else out
        out = out.limit(limit) if limit is not None else out
    return out


def tagged(documents: DataFrame, tags: DataFrame, wanted: list[str]) -> DataFrame:
    """Documents with every wanted tag or one under it; tags: document_id, tag, whether or not with ancestors.

    One semi-join per tag; only the tags in question reach it.
    """
    for w in dict.fromkeys(wanted):
        held = tags.where(_under(w)(F.col("tag"))).select(F.col("document_id").alias("_d"))
        documents = documents.join(held, F.col("id") == F.col("_d"), "left_semi")
    return documents


def browse(documents: DataFrame, tags: list[str] = (), text: str = "", category: str | None = None, long: DataFrame | None = None) -> DataFrame:
    """Documents with every selected tag or one under it, a title or id that contains the text, and a file category.

    The tags are looked for in column tags, or in long (document_id, tag) where that is given.
    """
    from ..functions.text import mime_category

    if long is not None:
        return tagged(browse(documents, [], text, category), long, tags)
    where = [F.exists("tags", _under(f)) for f in tags]
    q = text.strip().lower()
    if q:
        where.append(F.contains(F.lower("title"), F.lit(q)) | F.contains(F.lower("id"), F.lit(q)))
    if category and category != "all":
        where.append(mime_category("mime_type") == category)
    return documents.where(reduce(lambda a, b: a & b, where)) if where else documents


def _under(f: str):
    return lambda t: (t == f) | t.startswith(f + "/")


def feedback_stats(feedback: DataFrame, kind: str | None = None, context: str | None = None) -> DataFrame:
    """(term, accepts, rejects): weights summed by action."""
    for c, v in (("kind", kind), ("context", context)):
        feedback = feedback.where(F.col(c) == v) if v is not None else feedback
    w = lambda a: F.coalesce(F.sum(F.when(F.col("action") == a, F.col("weight"))), F.lit(0.0))
    return feedback.groupBy("term").agg(w("accepted").alias("accepts"), w("rejected").alias("rejects"))


def preference(accepts="accepts", rejects="rejects") -> Column:
    """1 + 0.35 accepts - 0.30 rejects, between 0.25 and 4; 1 where nothing is known."""
    a, r = F.coalesce(F.col(accepts), F.lit(0.0)), F.coalesce(F.col(rejects), F.lit(0.0))
    return F.greatest(F.lit(0.25), F.least(F.lit(4.0), 1 + 0.35 * a - 0.30 * r))


def sibling_names(df: DataFrame, folder: str, name: str, ident: str) -> DataFrame:
    """Column unique_name: the first of a folder's equal names as it is, others with ' (2)', ' (3)' before the extension.

    A numbered name that another row has as its own is passed over. Taken names meet the name they number by
    an equi-join, and equal names are numbered in parts, so that neither a folder nor a name is one task's.
    """
    n = checkpoint(numbered(df, [folder, name], [ident], "_r"))
    stem_, ext = (lambda c: F.regexp_extract(c, r"^(.+?)(\.[^.]*)?$", 1)), (lambda c: F.regexp_extract(c, r"^.+?(\.[^.]*)$", 1))
    # which numbered forms of a name are somebody's own
    taken = n.where("_r = 1").select(F.col(folder).alias("_cf"), stem_(name).alias("_s"), ext(name).alias("_e"))
    taken = taken.withColumn("_k", F.regexp_extract("_s", r" \(([1-9]\d{0,8})\)$", 1)).where("_k <> ''")
    taken = taken.select("_cf", F.concat(F.expr("left(_s, length(_s) - length(_k) - 3)"), "_e").alias("_cn"), F.col("_k").cast("int").alias("_k")).where("_k >= 2")
    several = n.where("_r = 2").select(F.col(folder).alias("_mf"), F.col(name).alias("_mn"))
    taken = taken.join(several, F.col("_cf").eqNullSafe(F.col("_mf")) & (F.col("_cn") == F.col("_mn")), "left_semi")
    clash = taken.groupBy("_cf", "_cn").agg(F.array_sort(F.collect_set("_k")).alias("_ks"))
    j = n.withColumn("_s", stem_(name)).withColumn("_e", ext(name)).join(clash, F.col(folder).eqNullSafe(F.col("_cf")) & (F.col(name) == F.col("_cn")), "left")
    step = F.aggregate(F.coalesce("_ks", F.array().cast("array<int>")), F.col("_r"), lambda acc, k: F.when(k <= acc, acc + 1).otherwise(acc))
    return j.withColumn("unique_name", F.when(F.col("_r") == 1, F.col(name)).otherwise(F.concat("_s", F.lit(" ("), step.cast("string"), F.lit(")"), "_e"))).drop("_r", "_s", "_e", "_cf", "_cn", "_ks")


def view_active(filters: Column | str, view: Column | str) -> Column:
    """Whether the tags filtered by are those of a saved view, in any order."""
    same = lambda c: F.array_sort(F.array_distinct(c))
    return same(filters) == same(view)


def toggled(filters: Column | str, view: Column | str) -> Column:
    """The tags to filter by after a view is chosen: its own, or none if they were chosen already."""
    return F.when(view_active(filters, view), F.array().cast("array<string>")).otherwise(F.array_sort(F.array_distinct(view)))


def one_tap(known: Column | str, last: Column | str, applied: Column | str) -> Column:
    """The tags to offer for a document: those last suggested, then all known ones, without those it has."""
    return F.array_except(F.array_union(last, known), applied)


def removable(tags: DataFrame, chosen: DataFrame) -> DataFrame:
    """(tag): the tags that any of the chosen documents (column id) has."""
    return tags.join(chosen.select(F.col("id").alias("document_id")), "document_id", "left_semi").select("tag").distinct()
