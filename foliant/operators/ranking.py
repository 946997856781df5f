"""Numbering of rows within groups, however large a group is."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, Window as W

from ..session import checkpoint


def numbered(df: DataFrame, keys: list[str], order: list[str], name: str = "r") -> DataFrame:
    """df with the place of each row within its group, from 1, in the order of the given columns.

    Rows are parted by ranges of keys and order together, so that a large group lies in several
    partitions; each numbers its own rows and adds what the ones before it hold of the group. Null keys
    are a group. Rows that agree in keys and order are numbered in any order among themselves.
    """
    n = max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    parted = checkpoint(df.repartitionByRange(n, *keys, *order).withColumn("_p", F.spark_partition_id()))
    held = parted.groupBy(*keys, "_p").agg(F.count("*").alias("_n"))
    before = held.withColumn("_b", F.coalesce(F.sum("_n").over(W.partitionBy(*keys).orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    before = before.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_p").alias("_q"), "_b")
    own = parted.withColumn("_r", F.row_number().over(W.partitionBy(*keys, "_p").orderBy(*order)))
    same = F.col("_p") == F.col("_q")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return own.join(before, same).withColumn(name, (F.col("_r") + F.col("_b")).cast("int")).select(*df.columns, name)
