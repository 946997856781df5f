"""Algebra of slash paths: ancestors, containment, children, completion, renaming.

Frames are in long form, (document_id, tag), with ancestors materialised by with_ancestors where
an operator says so. Tags with a colon are property tags and belong to no hierarchy.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

MAX_SEGMENTS, MAX_SEGMENT = 8, 60


def prefixes(c, proper: bool = False) -> Column:
    """All paths from the top down to a path, or to its parent."""
    s = F.split(F.col(c) if isinstance(c, str) else c, "/")
    n = F.size(s) - (1 if proper else 0)
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.array_join(F.slice(s, F.lit(1), i), "/"))).otherwise(F.array().cast("array<string>"))


def is_property(c) -> Column:
    return F.contains(F.col(c) if isinstance(c, str) else c, F.lit(":"))


def with_ancestors(tags: DataFrame) -> DataFrame:
    """Each document's tags with all their ancestors, each once."""
    return tags.select("document_id", F.explode(prefixes("tag")).alias("tag")).distinct()


def top_level(c: str) -> Column:
    return F.substring_index(c, "/", 1)


def parent(c: str) -> Column:
    return F.when(F.contains(F.col(c), F.lit("/")), F.regexp_extract(c, r"^(.*)/[^/]*$", 1)).otherwise("")


def last_segment(c: str) -> Column:
    return F.substring_index(c, "/", -1)


def under(c, path: str) -> Column:
    """Whether a tag is the path or lies below it."""
    c = F.col(c) if isinstance(c, str) else c
    return (c == path) | c.startswith(path + "/")


def path_error(c: str) -> Column:
    """Null for a valid path, else what is wrong with it. The messages."""
    t = F.col(c)
    s = F.split(t, "/")
    return (
        F.when(t == "", "Tag must not be empty")
        .when(t.startswith("/"), "Tag must not start with a slash")
        .when(t.endswith("/"), "Tag must not end with a slash")
        .when(F.contains(t, F.lit("//")), "Tag must not contain double slashes")
        .when(F.size(s) > MAX_SEGMENTS, f"Tag must have at most {MAX_SEGMENTS} segments")
        .when(F.exists(s, lambda x: F.length(x) > MAX_SEGMENT), f"Segment must be at most {MAX_SEGMENT} characters")
        .when(t.rlike(r"[\x00-\x1f\x7f:]"), "Segment contains invalid characters")
    )


def dispersion(tags: DataFrame) -> DataFrame:
    """(tag, documents) for every tag that is no property."""
    return tags.where(~is_property("tag")).groupBy("tag").agg(F.countDistinct("document_id").alias("documents"))


def contained(tags: DataFrame, path: str) -> DataFrame:
    """Documents with the path or anything below it."""
    return tags.where(under("tag", path) & ~is_property("tag")).select("document_id").distinct()


def contained_counts(tags: DataFrame) -> DataFrame:
    """(path, documents) for every path and every ancestor of one."""
    every = with_ancestors(tags.where(~is_property("tag")))  # each document and path once
    return every.groupBy(F.col("tag").alias("path")).agg(F.count("*").alias("documents"))


def sub_tags(tags: DataFrame, path: str = "") -> DataFrame:
    """(segment, documents, is_leaf) of the next segments below a path; inner ones first, by count, then leaves by name."""
    at = len(path.split("/")) if path else 0
    t = tags.where(~is_property("tag"))
    if path:
        t = t.where(F.col("tag").startswith(path + "/"))
    s = F.split("tag", "/")
    g = t.select("document_id", F.get(s, F.lit(at)).alias("segment"), (F.size(s) > at + 1).alias("deeper")).groupBy("segment").agg(F.countDistinct("document_id").alias("documents"), (~F.max("deeper")).alias("is_leaf"))
    return g.orderBy("is_leaf", F.when(~F.col("is_leaf"), -F.col("documents")), "segment")


def derived_sub_tags(tags: DataFrame, path: str) -> DataFrame:
    """(tag): children of every proper prefix of the path, other than the path's own parts."""
    parts = path.split("/")
    out = [sub_tags(tags, p).where(~F.col("segment").isin(parts)).select(F.concat(F.lit(p + "/"), "segment").alias("tag")) for p in ("/".join(parts[:i]) for i in range(1, len(parts)))]
    return reduce(DataFrame.unionAll, out).distinct() if out else tags.select("tag").limit(0)


def direct(tags: DataFrame, path: str) -> DataFrame:
    """Documents with exactly this tag and nothing deeper."""
    deeper = tags.where(F.col("tag").startswith(path + "/")).select("document_id")
    return tags.where(F.col("tag") == path).select("document_id").distinct().join(deeper, "document_id", "left_anti")


def with_all(tags: DataFrame, wanted: list[str], below: bool = False) -> DataFrame:
    """Documents that have every wanted tag, or with below, that or one under it."""
    if not wanted:
        return tags.select("document_id").distinct()
    hit = [under("tag", w) if below else F.col("tag") == w for w in dict.fromkeys(wanted)]
    g = tags.groupBy("document_id").agg(*[F.max(h).alias(f"w{i}") for i, h in enumerate(hit)])
    return g.where(reduce(lambda a, b: a & b, [F.col(f"w{i}") for i in range(len(hit))])).select("document_id")


def children_of_walk(tags: DataFrame, walked: list[str]) -> DataFrame:
    """(tag, documents): tags that go on from a walk: all their ancestors are walked, on documents that have the whole walk.

    Ordered by how recently the parent was walked (top-level tags last), then by documents left, then by name.
    """
    held = tags.join(with_all(tags, walked), "document_id", "left_semi").where(~is_property("tag") & ~F.col("tag").isin(walked or [""]))
    ok = F.forall(prefixes("tag", proper=True), lambda p: p.isin(walked or [""]))
    place = F.array_position(F.array(*map(F.lit, reversed(walked))) if walked else F.array(F.lit("")), parent("tag"))
    g = held.where(ok).groupBy("tag").agg(F.countDistinct("document_id").alias("documents"))
    return g.orderBy(F.when(parent("tag") == "", len(walked)).otherwise(place - 1), F.desc("documents"), last_segment("tag"), "tag")


def maximal(tags: DataFrame) -> DataFrame:
    """Each document's tags without those that are an ancestor of another one; property tags stay."""
    anc = tags.where(~is_property("tag")).select("document_id", F.explode(prefixes("tag", proper=True)).alias("tag")).distinct()
    return tags.join(anc, ["document_id", "tag"], "left_anti")


def completions(tags: DataFrame, query: str, limit: int = 8) -> DataFrame:
    """(tag, tier): exact, prefix, segment prefix, subsequence; shorter and alphabetically earlier ones first."""
    q = query.strip().lower()
    t = tags.select("tag").distinct().where(~is_property("tag"))
    if not q or limit <= 0:
        return t.select("tag", F.lit(0).alias("tier")).limit(0)
    low = F.lower("tag")
    inside = ".*".join("\\" + c if not c.isalnum() and c.isascii() else c for c in q)
    tier = F.when(low == q, 1).when(low.startswith(q), 2).when(F.exists(F.split(low, "/"), lambda s: s.startswith(q)), 3).when(F.regexp_replace(low, "/", "").rlike(inside), 4)
    return t.withColumn("tier", tier).where("tier IS NOT NULL").orderBy("tier", F.length("tag"), "tag").limit(limit)


def renamed(tags: DataFrame, old: str, new: str) -> DataFrame:
    """(document_id, tag) of the documents that have the old tag, with the new one in its place; none if both are one."""
    if old == new:
        return tags.limit(0)
    hit = tags.where(F.col("tag") == old).select("document_id").distinct()
    return tags.join(hit, "document_id", "left_semi").select("document_id", F.when(F.col("tag") == old, new).otherwise(F.col("tag")).alias("tag")).distinct()


def main_paths(tags: DataFrame) -> DataFrame:
    """(document_id, path): last segments of a document's tags, the most widely used tag first, joined by /."""
    counts = dispersion(tags).withColumnRenamed("tag", "t")
    j = tags.where(~is_property("tag")).join(counts, F.col("tag") == F.col("t")).groupBy("document_id").agg(F.array_sort(F.collect_set(F.struct((-F.col("documents")).alias("n"), "tag"))).alias("x"))
    part = lambda x: F.regexp_replace(F.regexp_replace(F.substring_index(x["tag"], "/", -1), r"[^\p{IsAlphabetic}\p{N} ._()-]", "_"), r"^[_.\- ]+|[_.\- ]+$", "")
    return j.select("document_id", F.array_join(F.filter(F.transform("x", part), lambda p: p != ""), "/").alias("path"))


def collapse_chains(children, path: str = "") -> list[tuple[str, int]]:
    """Single-child chains whose only child has as many documents become one step; children(path) lists (tag, documents)."""
    out = []
    for tag, n in children(path):
        while len(below := children(tag)) == 1 and below[0][1] == n:
            tag = below[0][0]
        out.append((tag, n))
    return out


def rebased(tags: DataFrame, selected: list[str]) -> DataFrame:
    """(document_id, tag, rest): what is left of each tag below the longest selected path, null where none holds it."""
    rest = reduce(lambda a, p: F.when(F.col("tag").startswith(p + "/"), F.substr(F.col("tag"), F.lit(len(p) + 2))).when(F.col("tag") == p, F.lit("")).otherwise(a), sorted(selected, key=len), F.lit(None).cast("string"))
    return tags.withColumn("rest", rest)


def collapsed(tags: DataFrame) -> DataFrame:
    """(path, shown): a path whose only child holds as many documents is shown as that child, through to the last such one."""
    from .graph import double_pointers

    counts = contained_counts(tags)
    child = counts.select(parent("path").alias("above"), F.col("path").alias("child"), F.col("documents").alias("held"))
    only = child.groupBy("above").agg(F.count("*").alias("n"), F.min("child").alias("child"), F.min("held").alias("held")).where("n = 1")
    j = counts.join(only, (F.col("path") == F.col("above")) & (F.col("documents") == F.col("held")), "left")
    state = j.select(F.col("path").alias("node"), F.col("child").alias("ptr"), F.coalesce("child", "path").alias("shown"))
    return double_pointers(state, {"shown": lambda own, up: F.when(F.length(up) > F.length(own), up).otherwise(own)}).select(F.col("node").alias("path"), "shown")


def visible(tags: DataFrame, selected: list[str]) -> tuple[DataFrame, DataFrame]:
    """((segment, documents) of the tree below the selected paths, (document_id) of those left with nothing below them).

    Only documents that have every selected path count; of each tag what follows the longest selected path is shown.
    """
    held = tags.where(~is_property("tag")).join(with_all(tags, selected, below=True), "document_id", "left_semi")
    rest = rebased(held, selected).withColumn("rest", F.coalesce("rest", "tag") if not selected else F.col("rest")).where("rest <> ''")
    tree = rest.groupBy(top_level("rest").alias("segment")).agg(F.countDistinct("document_id").alias("documents"))
    return tree, held.select("document_id").distinct().join(rest.select("document_id").distinct(), "document_id", "left_anti")
