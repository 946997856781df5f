"""Bytes by their SHA-256: a content-addressed store of parquet files, parted by the first digits of the hash."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .operators.filters import among
from .session import checkpoint

SCHEMA = "checksum_sha256 string, content binary, prefix string"


class BlobStore:
    """put, get, contains and delete by hash. Bytes are written once; only keys are compared to find what is new."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _all(self) -> DataFrame:
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(self.path)
        if not p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).parquet(self.path)

    def keys(self) -> DataFrame:
        return self._all().select("checksum_sha256").distinct()

    def put(self, contents: DataFrame) -> DataFrame:
        """(checksum_sha256) of the bytes in column content; those that are there already aren't written again. Null bytes are ignored."""
        new = contents.where("content IS NOT NULL").select(F.sha2("content", 256).alias("checksum_sha256"), "content")
        hashes = checkpoint(new.select("checksum_sha256").distinct())
        wanted = checkpoint(hashes.join(self.keys(), "checksum_sha256", "left_anti"))
        if not wanted.isEmpty():
            first = among(new, "checksum_sha256", wanted).join(wanted, "checksum_sha256", "left_semi").dropDuplicates(["checksum_sha256"])
            first.withColumn("prefix", F.left("checksum_sha256", F.lit(2))).write.mode("append").partitionBy("prefix").parquet(self.path)
        return hashes

    def get(self, wanted: DataFrame) -> DataFrame:
        """(checksum_sha256, content) of the wanted hashes (column checksum_sha256) that are there."""
        keys = wanted.select(F.lower("checksum_sha256").alias("checksum_sha256")).distinct()
        held = among(self._all(), "checksum_sha256", keys).join(keys, "checksum_sha256", "left_semi")
        return held.dropDuplicates(["checksum_sha256"]).select("checksum_sha256", "content")

    def contains(self, checksum: str) -> bool:
        return not self._all().where((F.col("prefix") == checksum[:2]) & (F.col("checksum_sha256") == checksum)).isEmpty()

    def delete(self, gone: DataFrame) -> DataFrame:
        """(checksum_sha256) of those in gone that were there; only the parts of the store that hold them are written anew."""
        hit = checkpoint(gone.select("checksum_sha256").distinct().join(self.keys(), "checksum_sha256", "left_semi"))
        parts = hit.select(F.left("checksum_sha256", F.lit(2)).alias("prefix")).distinct()
        touched = [r.prefix for r in parts.collect()]  # at most 256
        if touched:
            every = self._all().where(F.col("prefix").isin(touched))
            kept = checkpoint(every.join(hit, "checksum_sha256", "left_anti").select("checksum_sha256", "content", "prefix"))
            left = {r.prefix for r in kept.select("prefix").distinct().collect()}
            kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("prefix").parquet(self.path)
            jvm = self.spark.sparkContext._jvm
            for p in set(touched) - left:
                folder = jvm.org.apache.hadoop.fs.Path(f"{self.path}/prefix={p}")
                folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
        return hit


def unreferenced(keys: DataFrame, documents: DataFrame) -> DataFrame:
    """The hashes that no document has any more."""
    return keys.join(documents.select(F.lower("checksum_sha256").alias("checksum_sha256")).distinct(), "checksum_sha256", "left_anti")


def read_bytes(documents: DataFrame, blobs: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """(id, content): a document's library file if it is stamped with one that is there, else its blob, else null.

    documents: id, checksum_sha256, extra. blobs: checksum_sha256, content. files: rel_dir, name, content.
    """
    b = blobs.select(F.col("checksum_sha256").alias("b_sum"), F.col("content").alias("b_content"))
    j = documents.select("id", F.lower("checksum_sha256").alias("sum"), "extra").join(b, F.col("sum") == F.col("b_sum"), "left")
    if files is None:
        return j.select("id", F.col("b_content").alias("content"))
    f = files.select("rel_dir", F.col("name").alias("f_name"), F.col("content").alias("f_content"))
    at = F.coalesce(F.try_element_at("extra", F.lit("main_path")), F.lit(""))
    j = j.join(f, (F.try_element_at("extra", F.lit("file_name")) == F.col("f_name")) & (at == F.col("rel_dir")), "left")
    return j.select("id", F.coalesce("f_content", "b_content").alias("content"))
