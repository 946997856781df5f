"""Library: the relations of a document library in a folder, with the operations that change them.

Every change is a pure transform of relations, written as a new version of those it touches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .blobs import BlobStore, read_bytes, unreferenced
from .functions.text import rank_score, relevance
from .operators import fts, lsh, organize, relations as rel, vectors
from .operators.tags import with_ancestors
from .schemas import RELATIONS
from .session import checkpoint
from .sources.files import ingested
from .streaming.upkeep import VersionedTable, upsert_documents


class NotFound(KeyError):
    """No document of that id."""


class Library:
    """Opens (and makes) a library under a folder that all executors share."""

    SCHEMA_VERSION = 2

    def __init__(self, spark: SparkSession, root: str) -> None:
        """Opens the library; tables of an older schema gain the columns they lack as they are read."""
        self.spark, self.root = spark, root.rstrip("/")
        self.blobs = BlobStore(spark, f"{self.root}/blobs")
        have = self.setting("schema_version")
        if have is not None and int(have) > self.SCHEMA_VERSION:
            raise ValueError(f"the library has schema {have}, newer than {self.SCHEMA_VERSION}")
        if have != str(self.SCHEMA_VERSION):
            self.set_setting("schema_version", str(self.SCHEMA_VERSION))

    def _table(self, name: str) -> VersionedTable:
        return VersionedTable(self.spark, f"{self.root}/{name}")

    def read(self, name: str) -> DataFrame:
        empty = self.spark.createDataFrame([], RELATIONS[name])
        got = self._table(name).read()
        return empty if got is None else got if set(empty.columns) <= set(got.columns) else empty.unionByName(got, allowMissingColumns=True)

    def _write(self, **frames: DataFrame) -> None:
        for name, df in frames.items():
            self._table(name).write(df)

    def setting(self, name: str) -> str | None:
        got = self._table("settings").read()
        row = None if got is None else got.where(F.col("name") == name).first()
        return row and row["value"]

    def set_setting(self, name: str, value: str | None) -> None:
        """Sets a setting; null removes it. library_dir names the folder that documents are mirrored in."""
        old = self._table("settings").read()
        new = self.spark.createDataFrame([(name, value)], "name string, value string")
        rows = new if old is None else rel.upsert(old, new, ["name"])
        self._table("settings").write(rows.where("value IS NOT NULL"))

    def put(self, documents: DataFrame, tags: DataFrame | None = None, contents: DataFrame | None = None) -> None:
        """Documents by id, all columns replaced; with tags (document_id, tag) also their tag sets, with contents (id, content) their bytes.

        A checksum that is neither null, empty nor 64 hexadecimal digits is an error, and so is one that isn't
        that of the document's bytes; then nothing is written. An empty one is taken from the bytes.
        """
        bad = documents.where("checksum_sha256 IS NOT NULL AND checksum_sha256 <> '' AND NOT lower(checksum_sha256) RLIKE '^[0-9a-f]{64}$'")
        if not bad.isEmpty():
            raise ValueError("a checksum is not well-formed")
        if contents is not None:
            sums = contents.where("content IS NOT NULL").select(F.col("id").alias("c_id"), F.sha2("content", 256).alias("c_sum"))
            j = documents.join(sums, F.col("id") == F.col("c_id"), "left")
            if not j.where("checksum_sha256 <> '' AND lower(checksum_sha256) <> c_sum").isEmpty():
                raise ValueError("a checksum is not that of the bytes")
            documents = j.withColumn("checksum_sha256", F.coalesce("c_sum", "checksum_sha256")).drop("c_id", "c_sum")
            self.blobs.put(contents)
        docs = rel.upsert(self.read("documents"), documents, ["id"])
        self._write(documents=docs)
        if tags is not None:
            self._write_tags(rel.set_tags(self.read("document_tags"), tags, self.read("documents")))

    def read_bytes(self, ident: str, files: DataFrame | None = None) -> bytes | None:
        """The bytes of a document; NotFound where there is no document, null where there are no bytes."""
        one = self.read("documents").where(F.col("id") == ident)
        if one.isEmpty():
            raise NotFound(ident)
        row = read_bytes(one, self.blobs.get(one.where("checksum_sha256 <> ''")), files).first()
        return row and row["content"] and bytes(row["content"])

    def _write_tags(self, tags: DataFrame) -> None:
        self._write(document_tags=tags)
        now = self.read("document_tags")
        own = now.select(F.col("tag").alias("name")).distinct()
        known = self.read("tags")
        self._write(tags=rel.prune_tags(known, now).unionByName(own.join(known.select("name"), "name", "left_anti").select("name", F.lit(None).cast("string").alias("parent"), F.lit(None).cast("string").alias("color"))))

    def get(self, ident: str) -> DataFrame:
        """The document with its tags; NotFound where there is none."""
        one = rel.with_tag_arrays(self.read("documents").where(F.col("id") == ident), self.read("document_tags"))
        if one.isEmpty():
            raise NotFound(ident)
        return one

    def set_tags(self, ident: str, tags: list[str], manual: bool = False, now_ms: int = 0) -> None:
        """A document's tag set. manual: by the user, so the document is stamped and each tag accepted with weight 2."""
        self.get(ident)
        new = self.spark.createDataFrame([(ident, t) for t in tags] or [(ident, None)], "document_id string, tag string")
        self._write_tags(rel.delete(self.read("document_tags"), new, "document_id", "document_id").unionByName(with_ancestors(new.where("tag IS NOT NULL"))))
        if manual:
            self._edited(ident, {"extra": rel.stamped("extra", "tags_manual", "true")}, now_ms)
            self._accept(ident, "tags", "tag", tags, now_ms)

    def rename(self, ident: str, title: str, manual: bool = True, now_ms: int = 0) -> None:
        """A document's title. manual: by the user, so the document is stamped and the title accepted with weight 2."""
        self.get(ident)
        stamp = {"extra": rel.stamped("extra", "title_manual", "true")} if manual else {}
        self._edited(ident, {"title": F.lit(title)} | stamp, now_ms)
        if manual:
            self._accept(ident, "title", "title", [title], now_ms)

    def _edited(self, ident: str, columns: dict, now_ms: int) -> None:
        docs, mine = self.read("documents"), F.col("id") == ident
        changes = columns | {"updated_at_ms": F.greatest("updated_at_ms", F.lit(now_ms))}
        self._write(documents=docs.withColumns({c: F.when(mine, v).otherwise(F.col(c)) for c, v in changes.items()}))

    def _accept(self, ident: str, kind: str, context: str, terms: list[str], now_ms: int) -> None:
        if terms:
            rows = [(f"{ident}-{kind}-{t}-user-{now_ms}", kind, context, t, "accepted", 2.0, now_ms) for t in terms]
            self.record_feedback(self.spark.createDataFrame(rows, RELATIONS["feedback"]))

    def ingest(self, files: DataFrame, organise: bool = True, now_ms: int = 0) -> DataFrame:
        """Files (name, modified_ms, content) as documents: put, indexed, and organised; gives (id, name, error) of those that are new.

        A file that can't be read is reported and left out; the others go on.
        """
        done = checkpoint(ingested(files, self.read("documents"), now_ms))
        fit = done.where("error IS NULL")
        if not fit.isEmpty():
            self.put(fit.select(*self.read("documents").columns))
            self.put_content(fit.select(F.col("id").alias("document_id"), "text", "source"))
            if organise:
                self.organise(fit.select(F.col("id").alias("doc")), "ingest", now_ms)
        return done.select("id", F.element_at("extra", "original_name").alias("name"), "error")

    def corpus(self) -> DataFrame:
        """id, title and text of every document; its title where it has no text."""
        c = self.read("content").select(F.col("document_id").alias("c"), "text")
        j = self.read("documents").where(rel.node_kind("kind") == "document").join(c, F.col("id") == F.col("c"), "left")
        return j.select("id", "title", F.when(F.col("text").rlike(r"\S"), F.col("text")).otherwise(F.col("title")).alias("text"))

    def organise(self, asked: DataFrame, source: str = "bulk", now_ms: int = 0, emergent: list[str] = ()) -> DataFrame:
        """Plans the asked documents (column doc) on one snapshot, applies what differs and stores the suggestions; one row total, updated, skipped."""
        corpus, tags, feedback = checkpoint(self.corpus()), self.read("document_tags"), self.read("feedback")
        stats = {k: rel.feedback_stats(feedback, k) if not feedback.where(F.col("kind") == k).isEmpty() else None for k in ("tags", "title")}
        twins = lsh.duplicates(corpus, "id", "text").join(asked, F.col("id") == F.col("doc"), "left_semi")
        plan = checkpoint(organize.plans(corpus, tags, asked, emergent, stats["tags"], twins, stats["title"]))
        docs = rel.with_tag_arrays(self.read("documents"), tags)
        before = checkpoint(docs.join(asked, F.col("id") == F.col("doc"), "left_semi").select(F.col("id").alias("document_id"), "title", "tags"))
        after = checkpoint(organize.applied_at_ingest(plan, before))
        new = organize.changed(before, after).select(F.col("document_id").alias("n_id"), F.col("title").alias("n_title"))
        titled = self.read("documents").join(new, F.col("id") == F.col("n_id"), "left").withColumn("title", F.coalesce("n_title", "title"))
        self._write(documents=titled.drop("n_id", "n_title"))
        planned = after.select("document_id", F.explode_outer("tags").alias("tag"))
        self._write_tags(rel.set_tags(tags, planned, self.read("documents")))
        self.store_suggestions(organize.suggestions_of(plan, before, source, now_ms))
        return organize.bulk_outcome(before, after)

    def mark_suggestion(self, ident: str, status: str) -> None:
        """pending, applied or dismissed."""
        if status not in ("pending", "applied", "dismissed"):
            raise ValueError(status)
        s = self.read("suggestions")
        self._write(suggestions=s.withColumn("status", F.when(F.col("id") == ident, status).otherwise(F.col("status"))))

    def names(self, relation: str) -> DataFrame:
        """Tags or views by name."""
        return self.read(relation).orderBy("name")

    def query(self, **clauses) -> DataFrame:
        return rel.query(rel.with_tag_arrays(self.read("documents"), self.read("document_tags")), **clauses)

    def delete(self, ids: list[str]) -> None:
        gone = self.spark.createDataFrame([(i,) for i in ids], "id string")
        left = self.read("documents").where(F.col("id").isin(ids)).select(F.lower("checksum_sha256").alias("checksum_sha256")).where("checksum_sha256 <> ''")
        left = checkpoint(left)
        self._write(**rel.delete_documents({n: self.read(n) for n in ("documents", "content", "document_tags", "tags", "links", "suggestions")}, gone))
        self._unindex(gone.select(F.col("id").alias("doc")))
        if not left.isEmpty():
            self.blobs.delete(unreferenced(left, self.read("documents")))

    def put_content(self, content: DataFrame) -> None:
        """Texts of documents, and with them the three search indexes: postings with lengths, vectors, signatures."""
        self._write(content=rel.upsert(self.read("content"), content, ["document_id"]))
        self.index(content)

    def index(self, content: DataFrame | None = None) -> None:
        """Indexes the given texts anew, or all of the documents that have one."""
        rows = content if content is not None else self.read("content").join(self.read("documents").select(F.col("id").alias("document_id")), "document_id", "left_semi")
        gone = rows.select(F.col("document_id").alias("doc"))
        made = {
            "postings": fts.postings(rows, "document_id", "text"),
            "lengths": fts.lengths(rows, "document_id", "text"),
            "vectors": vectors.embed(rows, "document_id", "text").select(F.col("id").alias("doc"), "vector"),
        }
        for name, df in made.items():
            upsert_documents(self._table(f"index/{name}"), df, "doc", gone)

    def _unindex(self, gone: DataFrame) -> None:
        for name in ("postings", "lengths", "vectors"):
            old = self._table(f"index/{name}").read()
            if old is not None:
                self._table(f"index/{name}").write(old.join(gone, "doc", "left_anti"))

    def search(self, query: str, mode: str = "exact", limit: int = 50) -> DataFrame:
        """(doc, score) from the indexes: exact, semantic, or hybrid (exact hits first). A blank query, a wrong one and an empty index give no row."""
        tables = {n: self._table(f"index/{n}").read() for n in ("postings", "lengths", "vectors")}
        none = self.spark.createDataFrame([], "doc string, score double")
        if not query.strip() or tables["postings"] is None:
            return none
        near = vectors.semantic_index(tables["vectors"].withColumnRenamed("doc", "id"), query, limit) if mode != "exact" else None
        if mode == "semantic":
            return near
        try:
            hits = fts.match_index(tables["postings"], tables["lengths"], query, limit)
        except fts.InvalidQuery:
            return none
        exact = hits.select("doc", relevance(rank_score("rank")).alias("score"))
        return exact if near is None else fts.merge_stages(exact, near, limit)

    def link(self, links: DataFrame) -> None:
        self._write(links=rel.upsert(self.read("links"), links, ["parent_id", "child_id"]))

    def children(self, parent: str) -> DataFrame:
        return self.read("links").where(F.col("parent_id") == parent).orderBy("position", "child_id").select("child_id")

    def record_feedback(self, rows: DataFrame) -> None:
        self._write(feedback=self.read("feedback").unionByName(rows))

    def clear_feedback(self) -> None:
        self._write(feedback=self.spark.createDataFrame([], RELATIONS["feedback"]))

    def save_view(self, name: str, tags: list[str]) -> None:
        """A named set of tags; the same name replaces. A blank name or no tags is an error."""
        if not name.strip() or not tags:
            raise ValueError("a view needs a name and tags")
        self._write(views=rel.upsert(self.read("views"), self.spark.createDataFrame([(name.strip(), sorted(tags))], RELATIONS["views"]), ["name"]))

    def delete_view(self, name: str) -> None:
        self._write(views=self.read("views").where(F.col("name") != name))

    def store_suggestions(self, rows: DataFrame) -> None:
        self._write(suggestions=organize.store_suggestions(self.read("suggestions"), rows))

    def apply_suggestion(self, ident: str, now_ms: int) -> None:
        s, f = organize.apply_suggestion(self.read("suggestions"), ident, now_ms)
        self._write(suggestions=s)
        self.record_feedback(f)
