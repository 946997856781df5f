"""Streams: files to documents, content to search indexes, peer events to the peers' last state.

Index upkeep is an idempotent upsert by document, so a batch that runs twice changes nothing.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.fts import lengths, postings
from ..sources.files import ingested, listed


class ConcurrentWrite(RuntimeError):
    """Another writer made the version that this one was going to make."""


class VersionedTable:
    """A folder of parquet versions; readers see the last one that was committed.

    A version is written to a folder of its own and becomes visible by a file that only one writer can
    create, so two writers never destroy each other: the later one gets ConcurrentWrite and changes nothing.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(self.path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def _commits(self) -> dict[int, str]:
        """Folder by version."""
        fs, path = self._fs()
        if not fs.exists(path(f"{self.path}/_log")):
            return {}
        names = [s.getPath().getName() for s in fs.listStatus(path(f"{self.path}/_log"))]
        return {int(n.split("-", 1)[0]): fs.open(path(f"{self.path}/_log/{n}")).readUTF() for n in names if n[0].isdigit()}

    def version(self) -> int | None:
        return max(self._commits(), default=None)

    def read(self) -> DataFrame | None:
        done = self._commits()
        return self.spark.read.parquet(f"{self.path}/{done[max(done)]}") if done else None

    def write(self, df: DataFrame, keep: int = 2, partition_by: tuple[str, ...] = ()) -> int:
        """The next version; all but the last few older ones are removed."""
        done = self._commits()
        v, (fs, path) = max(done, default=-1) + 1, self._fs()
        folder = f"v={v}-{uuid.uuid4().hex[:12]}"
        df.write.partitionBy(*partition_by).parquet(f"{self.path}/{folder}")
        try:
            out = fs.create(path(f"{self.path}/_log/{v:010d}"), False)
            out.writeUTF(folder)
            out.close()
        except Exception as e:
            fs.delete(path(f"{self.path}/{folder}"), True)
            raise ConcurrentWrite(f"{self.path}: version {v}") from e
        for old, name in done.items():
            if old <= v - keep:
                fs.delete(path(f"{self.path}/_log/{old:010d}"), False)
                fs.delete(path(f"{self.path}/{name}"), True)
        return v


def upsert_documents(table: VersionedTable, rows: DataFrame, key: str, gone: DataFrame | None = None) -> int:
    """Rows of the keys in rows (and gone) leave the table, rows come in."""
    old = table.read()
    if old is None:
        return table.write(rows)
    kept = old.join(rows.select(key).distinct(), key, "left_anti")
    if gone is not None:
        kept = kept.join(gone.select(key).distinct(), key, "left_anti")
    return table.write(kept.unionByName(rows))


def keep_postings(content: DataFrame, index: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """A stream of content rows (document_id, text, at_ms) into an index of postings, and of lengths beside it; the last row of a document counts."""
    spark = content.sparkSession

    def batch(df: DataFrame, _: int) -> None:
        last = df.groupBy("document_id").agg(F.max_by("text", F.struct("at_ms", "text")).alias("text"))
        gone = last.select(F.col("document_id").alias("doc"))
        upsert_documents(VersionedTable(spark, index), postings(last, "document_id", "text"), "doc", gone)
        upsert_documents(VersionedTable(spark, f"{index}-lengths"), lengths(last, "document_id", "text"), "doc", gone)

    return content.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def keep_documents(spark: SparkSession, root: str, documents: str, checkpoint: str, on_batch: Callable[[DataFrame], None] | None = None, trigger: dict | None = None) -> StreamingQuery:
    """New files of a folder into a table of documents with their text; a file that can't be read has an error."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", "true").load(root)

    def batch(df: DataFrame, _: int) -> None:
        rows = ingested(listed(df, os.path.abspath(root) if root.startswith("/") else root, content=True))
        upsert_documents(VersionedTable(spark, documents), rows, "id")
        if on_batch:
            on_batch(rows)

    return files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def peer_states(events: DataFrame) -> DataFrame:
    """(peer, state, address, at_ms): each peer's last event; works on batches and, in update or complete mode, on streams."""
    return events.groupBy("peer").agg(F.max_by(F.struct("state", "address", "at_ms"), F.struct("at_ms", "state")).alias("x")).select("peer", "x.*")


def keep_events(events: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """A stream of events (synchronisation, peers, chat) into a log of parquet files; every event is in it once."""
    return events.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
