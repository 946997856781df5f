"""Files as rows: directories, batch ingest, and the reconciliation of a library with its directory."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, Window as W

from ..functions.text import extension, file_name, format_class, mime_for, stem
from ..operators.relations import sibling_names
from ..operators.tags import main_paths
from ..session import checkpoint
from .extract import extract, html_text


def walk(spark: SparkSession, root: str, recursive: bool = True, content: bool = False) -> DataFrame:
    """(rel_dir, name, size, modified_ms, path[, content]) of the files below a root; dot files and *.tmp are skipped."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(root)
    return listed(f, root, content)


def listed(f: DataFrame, root: str, content: bool = False) -> DataFrame:
    base = root.rstrip("/") + "/"
    rel = F.expr("substring(path, instr(path, '" + base.replace("'", "\\'") + f"') + {len(base)})")
    out = f.withColumn("rel", rel).select(F.regexp_extract("rel", r"^(?:(.*)/)?[^/]*$", 1).alias("rel_dir"), F.substring_index("rel", "/", -1).alias("name"), F.col("length").alias("size"), F.unix_millis("modificationTime").alias("modified_ms"), "path", *(["content"] if content else []))
    return out.where(~F.col("name").startswith(".") & ~F.lower("name").endswith(".tmp") & ~F.concat(F.lit("/"), "rel_dir").rlike(r"/\."))


def ingested(files: DataFrame, known: DataFrame | None = None, now_ms: int = 0) -> DataFrame:
    """Document rows with text, source and error of files with their bytes: name, modified_ms, content.

    The id is the SHA-256 of the bytes; equal bytes give one row, the name that comes last wins. A file that
    can't be read gives an error, not an end of the batch. known: ids that are skipped.
    """
    f = files.withColumn("id", F.sha2("content", 256)).withColumn("ext", F.when(F.contains(F.col("name"), F.lit(".")), extension("name")).otherwise(""))
    f = f.groupBy("id").agg(F.max_by(F.struct("name", "ext", "modified_ms", "content"), F.struct("modified_ms", "name")).alias("x")).select("id", "x.*")
    if known is not None:
        f = f.join(known.select("id"), "id", "left_anti")
    f = f.withColumn("format", format_class("ext"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = [extract(k, bytes(c)) for k, c in zip(pdf["format"], pdf["content"])]
            yield pdf.drop(columns="content").assign(size_bytes=[len(c) for c in pdf["content"]], text=[g[0] for g in got], source=[g[1] for g in got], error=[g[2] for g in got])

    g = f.select("id", "name", "ext", "modified_ms", "format", "content").mapInPandas(run, "id string, name string, ext string, modified_ms long, format string, size_bytes long, text string, source string, error string")
    at = F.greatest(F.coalesce("modified_ms", F.lit(0)), F.lit(now_ms)).cast("long")
    return g.select("id", F.lit(None).cast("string").alias("parent_id"), F.lit("document").alias("kind"), stem("name").alias("title"), mime_for("ext", "source").alias("mime_type"), "size_bytes", F.col("id").alias("checksum_sha256"), at.alias("created_at_ms"), at.alias("updated_at_ms"), F.create_map(F.lit("original_name"), F.col("name"), F.lit("extractor"), F.col("source")).alias("extra"), "text", "source", "error")


def progress_events(done: DataFrame) -> DataFrame:
    """(kind, file, percent, error): what a batch reports of each file, in the order processing, extracting, outcome."""
    name = F.element_at("extra", "original_name")
    step = lambda n, kind, percent: F.struct(F.lit(n).alias("step"), kind.alias("kind"), F.lit(percent).cast("int").alias("percent"))
    outcome = F.when(F.col("error").isNull(), "completed").otherwise("failed")
    steps = F.array(step(0, F.lit("processing"), None), step(1, F.lit("extracting"), 0), step(2, F.lit("extracting"), 100), step(3, outcome, None))
    return done.select(name.alias("file"), "error", F.explode(steps).alias("s")).select("file", "s.step", "s.kind", "s.percent", F.when(F.col("s.kind") == "failed", F.col("error")).alias("error"))


def stripped_html(df: DataFrame, html: str, to: str = "text") -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(**{to: [html_text(x) if x is not None else None for x in pdf[html]]})

    return df.mapInPandas(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + f", `{to}` string")


def expected_places(documents: DataFrame, tags: DataFrame) -> DataFrame:
    """(id, rel_dir, name): where each document belongs by its tags and title, names unique within a folder."""
    paths = main_paths(tags).withColumnsRenamed({"document_id": "d", "path": "rel_dir"})
    docs = documents.where("kind <> 'folder'").join(paths, F.col("id") == F.col("d"), "left").withColumn("rel_dir", F.coalesce("rel_dir", F.lit("")))
    original = F.try_element_at("extra", F.lit("original_name"))
    named = docs.withColumn("wanted", file_name("title", original, "mime_type", "checksum_sha256")).select("id", "rel_dir", "wanted")
    return sibling_names(named, "rel_dir", "wanted", "id").select("id", "rel_dir", F.col("unique_name").alias("name"))


def reconciliation(documents: DataFrame, tags: DataFrame, tree: DataFrame) -> DataFrame:
    """Plan rows (action, id, rel_dir, name, to_dir, to_name) that bring a directory and a library together.

    documents: id, kind, title, mime_type, checksum_sha256, extra. tree: rel_dir, name, hash. Actions:
    backfill (a document without a file name is written), keep, move (its file is elsewhere), delete (its
    file is nowhere), link (an unclaimed file has the bytes of a document), ingest (an unclaimed file is new).
    A file is claimed by its name alone; it is looked for at the expected place, then at the stamped one,
    then anywhere.
    """
    place = expected_places(documents, tags)
    stamp = documents.where("kind <> 'folder'").select("id", F.try_element_at("extra", F.lit("file_name")).alias("stamp"), F.try_element_at("extra", F.lit("main_path")).alias("stamped_dir"))
    d = place.join(stamp, "id")
    backfill = d.where("stamp IS NULL").select(F.lit("backfill").alias("action"), "id", F.lit(None).cast("string").alias("rel_dir"), F.lit(None).cast("string").alias("name"), F.col("rel_dir").alias("to_dir"), F.col("name").alias("to_name"))
    t = tree.select(F.col("rel_dir").alias("t_dir"), F.col("name").alias("t_name")).distinct()
    first = t.groupBy("t_name").agg(F.min("t_dir").alias("any_dir"))  # a common name is one row here
    at = lambda c, as_: (t.select(F.col("t_name").alias(f"n_{as_}"), F.col("t_dir").alias(as_)), (F.col("stamp") == F.col(f"n_{as_}")) & (F.col(c) == F.col(as_)))
    (own, on_own), (old, on_old) = at("rel_dir", "own_dir"), at("stamped_dir", "old_dir")
    found = d.where("stamp IS NOT NULL").join(own, on_own, "left").join(old, on_old, "left").join(first, F.col("stamp") == F.col("t_name"), "left")
    there = F.coalesce("own_dir", "old_dir", "any_dir")
    placed = found.select(F.when(there.isNull(), "delete").when((there == F.col("rel_dir")) & (F.col("stamp") == F.col("name")), "keep").otherwise("move").alias("action"), "id", there.alias("rel_dir"), F.col("stamp").alias("name"), F.col("rel_dir").alias("to_dir"), F.col("name").alias("to_name"))
    claimed = stamp.where("stamp IS NOT NULL").select(F.col("stamp").alias("name"))
    loose = tree.join(claimed.distinct(), "name", "left_anti")
    w = W.partitionBy("hash").orderBy("rel_dir", "name")
    loose = loose.withColumn("r", F.row_number().over(w)).where("r = 1")
    new = loose.join(documents.select(F.col("id").alias("known")).distinct(), F.col("hash") == F.col("known"), "left")
    added = new.select(F.when(F.col("known").isNotNull(), "link").otherwise("ingest").alias("action"), F.col("hash").alias("id"), "rel_dir", "name", F.lit(None).cast("string").alias("to_dir"), F.lit(None).cast("string").alias("to_name"))
    return backfill.unionByName(placed).unionByName(added)


def safe_dir(c: str):
    """Whether a relative folder stays within the root."""
    return ~F.concat(F.lit("/"), F.col(c), F.lit("/")).rlike(r"/\.\./") & ~F.col(c).startswith("/")


def check_dir(rel_dir: str) -> None:
    """An error for a folder that would lead out of the root."""
    if rel_dir.startswith("/") or ".." in rel_dir.split("/"):
        raise ValueError(f"not below the root: {rel_dir}")


def mirrored(files: DataFrame, root: str) -> DataFrame:
    """(rel_dir, name, error): writes files (rel_dir, name, content) below a root that all executors share.

    Each file is written beside its place and renamed, so a task that runs twice leaves the same files. One that
    can't be written gives an error, not an end of the batch.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            errors = []
            for rel_dir, name, content in zip(pdf["rel_dir"], pdf["name"], pdf["content"]):
                try:
                    check_dir(f"{rel_dir or ''}/{name}".lstrip("/"))
                    folder = os.path.join(root, rel_dir or "")
                    os.makedirs(folder, exist_ok=True)
                    part = os.path.join(folder, f".{uuid.uuid4().hex}.tmp")
                    with open(part, "wb") as f:
                        f.write(bytes(content))
                    os.replace(part, os.path.join(folder, name))
                    errors.append(None)
                except Exception as e:
                    errors.append(f"{type(e).__name__}: {e}"[:300])
            yield pd.DataFrame({"rel_dir": pdf["rel_dir"], "name": pdf["name"], "error": pd.Series(errors, dtype=object)})

    return checkpoint(files.select("rel_dir", "name", "content").mapInPandas(run, "rel_dir string, name string, error string"))


def removed(files: DataFrame, root: str) -> DataFrame:
    """(rel_dir, name, existed): removes files (rel_dir, name) below a root, and folders that are empty then."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            existed = []
            for rel_dir, name in zip(pdf["rel_dir"], pdf["name"]):
                check_dir(f"{rel_dir or ''}/{name}".lstrip("/"))
                folder = os.path.join(root, rel_dir or "")
                try:
                    os.remove(os.path.join(folder, name))
                    existed.append(True)
                except FileNotFoundError:
                    existed.append(False)
                while os.path.realpath(folder) != os.path.realpath(root):
                    try:
                        os.rmdir(folder)
                    except OSError:
                        break
                    folder = os.path.dirname(folder)
            yield pd.DataFrame({"rel_dir": pdf["rel_dir"], "name": pdf["name"], "existed": existed})

    return checkpoint(files.select("rel_dir", "name").mapInPandas(run, "rel_dir string, name string, existed boolean"))


def mirrored_paths(documents: DataFrame, tree: DataFrame) -> DataFrame:
    """(id, path): where each document's mirrored file is, null if it has none or it is gone. tree: rel_dir, name."""
    at = documents.select("id", F.try_element_at("extra", F.lit("file_name")).alias("stamp"), F.coalesce(F.try_element_at("extra", F.lit("main_path")), F.lit("")).alias("dir"))
    t = tree.select(F.col("rel_dir").alias("t_dir"), F.col("name").alias("t_name")).distinct()
    j = at.join(t, (F.col("stamp") == F.col("t_name")) & (F.col("dir") == F.col("t_dir")), "left")
    return j.select("id", F.when(F.col("t_name").isNotNull(), F.concat(F.when(F.col("dir") == "", "").otherwise(F.concat("dir", F.lit("/"))), "stamp")).alias("path"))


def outcome_counts(plan: DataFrame) -> DataFrame:
    """(action, n): how many of each action a reconciliation holds; a second run after it has only keep."""
    return plan.groupBy("action").agg(F.count("*").alias("n"))
