"""Synchronisation of libraries by their manifests: difference, conflicts, resolution, events."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.text import fork_id

FIELDS = ["id", "checksum_sha256", "updated_at_ms", "parent_id", "tags", "title", "mime_type", "kind", "size_bytes", "created_at_ms"]


def manifest(documents: DataFrame) -> DataFrame:
    """A library's manifest: documents need the column tags."""
    return documents.select(*FIELDS)


def difference(local: DataFrame, remote: DataFrame) -> DataFrame:
    """Remote rows with the column state: new, conflict (another checksum) or agree, and the local row's version.

    Only what the remote side holds is looked at. Null checksums differ from all but null. One equi-join on id.
    """
    mine = local.select(F.col("id").alias("l_id"), F.col("checksum_sha256").alias("l_checksum"), F.col("updated_at_ms").alias("l_updated"))
    j = remote.join(mine, F.col("id") == F.col("l_id"), "left")
    state = F.when(F.col("l_id").isNull(), "new").when(F.col("checksum_sha256").eqNullSafe(F.col("l_checksum")), "agree").otherwise("conflict")
    return j.withColumn("state", state).drop("l_id")


def resolved(diff: DataFrame, how: str = "fork") -> DataFrame:
    """diff with the column outcome: adopted, forked, remote_won, local_won or none.

    how: fork (both stay), remote, local, or newest: the greater (updated_at_ms, checksum) wins.
    """
    newer = F.struct(F.coalesce("updated_at_ms", F.lit(-1)), F.coalesce("checksum_sha256", F.lit(""))) > F.struct(F.coalesce("l_updated", F.lit(-1)), F.coalesce("l_checksum", F.lit("")))
    won = {"fork": F.lit("forked"), "remote": F.lit("remote_won"), "local": F.lit("local_won"), "newest": F.when(newer, "remote_won").otherwise("local_won")}[how]
    return diff.withColumn("outcome", F.when(F.col("state") == "new", "adopted").when(F.col("state") == "conflict", won).otherwise("none"))


def applied(local: DataFrame, diff: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(the local manifest afterwards, links parent_id, child_id, position of forks to their originals)."""
    cols = [c for c in local.columns]
    won = diff.where("outcome IN ('adopted', 'remote_won')").select(*cols)
    forks = diff.where("outcome = 'forked'").withColumn("original", F.col("id")).withColumn("id", fork_id("id", "checksum_sha256"))
    kept = local.join(won.select("id"), "id", "left_anti").select(*cols)
    new_forks = forks.join(local.select("id"), "id", "left_anti")
    return kept.unionByName(won).unionByName(new_forks.select(*cols)), forks.select(F.col("original").alias("parent_id"), F.col("id").alias("child_id"), F.lit(0).alias("position"))


def pulled(local: DataFrame, peers: DataFrame, how: str = "newest") -> DataFrame:
    """Every peer's rows against one snapshot of the local manifest, with peer, state and outcome."""
    return resolved(difference(local, peers), how)


def events(diff: DataFrame, now_ms: int) -> DataFrame:
    """One event a row that isn't agreed on: kind, document_id, winner, local and remote checksum."""
    return diff.where("outcome <> 'none'").select(F.when(F.col("state") == "new", "document_received").otherwise("conflict_resolved").alias("kind"), F.col("id").alias("document_id"), F.when(F.col("state") == "conflict", F.col("outcome")).alias("winner"), F.col("l_checksum").alias("local_checksum"), F.col("checksum_sha256").alias("remote_checksum"), F.lit(now_ms).cast("long").alias("at_ms"))


def wanted_blobs(diff: DataFrame) -> DataFrame:
    """Distinct checksums to fetch."""
    return diff.where("state <> 'agree' AND checksum_sha256 IS NOT NULL").select("checksum_sha256").distinct()


def holders(documents: DataFrame, blobs: DataFrame) -> DataFrame:
    """All documents that share one of the checksums."""
    return documents.join(blobs.select("checksum_sha256").distinct(), "checksum_sha256", "left_semi")


def related_versions(members: DataFrame, sig: DataFrame, asked: DataFrame, threshold: float = 0.6) -> DataFrame:
    """(document_id, related_to, similarity): for each asked id the most similar document under another id (ties: the smallest id)."""
    from pyspark.sql import Window as W

    from .lsh import alike

    w = W.partitionBy("id").orderBy(F.desc("similarity"), "first")
    best = alike(members, sig, asked, threshold).withColumn("r", F.row_number().over(w)).where("r = 1")
    return best.select(F.col("id").alias("document_id"), F.col("first").alias("related_to"), "similarity")
