"""Session helpers: building a local session, checkpoints, table loading."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession, functions as F


def local_session(cores: int | str = 8, memory: str = "8g", partitions: int = 8) -> SparkSession:
    """A session for tests and benches; on a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("foliant")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.host", "127.0.0.1")
        .getOrCreate()
    )


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir.

    A folder of our own is made only if the session names none and runs in one local JVM; on a cluster
    a machine-local folder would not survive an executor, so that is an error.
    """
    sc = spark.sparkContext
    have = sc._jsc.sc().getCheckpointDir()
    if have.isDefined():
        return have.get()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not (sc.master or "").startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="foliant-")
    sc.setCheckpointDir(named)
    return named


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage by a reliable checkpoint in the shared folder."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder; only the columns used later are read."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def _partitions(plan, spark: SparkSession) -> int:
    """How many partitions a logical plan reads at least, as far as they reach its end without a shuffle."""
    kind, children = plan.nodeName(), [plan.children().apply(i) for i in range(plan.children().size())]
    if kind == "LogicalRelation":
        size, cores = int(str(plan.stats().sizeInBytes())), spark.sparkContext.defaultParallelism
        most = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
        return size // max(1, min(most, max(4 << 20, size // cores)))
    if kind == "LogicalRDD":
        return plan.rdd().getNumPartitions()
    if kind == "Union":
        return sum(_partitions(c, spark) for c in children)
    if kind in ("Project", "Filter") or (kind == "Join" and plan.joinType().toString() in ("LeftSemi", "LeftAnti") and "broadcast" in plan.hint().toString()):
        return _partitions(children[0], spark)
    return 0


def spread(df: DataFrame, width: int = 32 << 20) -> DataFrame:
    """Spread rows over all cores before CPU-heavy work, where they come in fewer partitions than cores.

    A scan, also one filtered by a broadcast semi-join, with as many partitions as there are cores is left
    alone, without a shuffle. What comes out of a join or an aggregation may have been coalesced to few
    partitions; it is spread over twice the cores or, if that is more, over one partition for every width
    bytes that were read for it.
    """
    spark = df.sparkSession
    cores, plan = spark.sparkContext.defaultParallelism, df._jdf.queryExecution().optimizedPlan()
    if _partitions(plan, spark) >= cores:
        return df
    leaves = plan.collectLeaves()
    read = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    return df.repartition(max(2 * cores, min(100_000, read // width)))


def small(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """df to be broadcast if it has no more than so many rows, else as it is; for short rows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
