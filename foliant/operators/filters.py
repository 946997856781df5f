"""Semi-joins by a Bloom filter of bounded size, so that wide rows stay where they are read.

The filter is a table of at most WORDS words of 64 bits; a key sets four bits of one word. It is
broadcast, which its bound allows whatever the number of keys. With more keys than it has room for,
more rows pass, never fewer: what passes must meet an exact join or grouping afterwards.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

WORDS = 1 << 20
BITS = 4


def _hash(key: str | Column) -> Column:
    return F.xxhash64(F.col(key) if isinstance(key, str) else key)


def _word(h: Column) -> Column:
    return h.bitwiseAND(F.lit(WORDS - 1))


def _mask(h: Column) -> Column:
    one = lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 24 + 6 * i).bitwiseAND(F.lit(63)).cast("int"))
    return reduce(lambda a, b: a.bitwiseOR(b), map(one, range(BITS)))


def _words(need: DataFrame, key: str) -> DataFrame:
    h = _hash(key)
    return F.broadcast(need.select(_word(h).alias("_w"), _mask(h).alias("_m")).groupBy("_w").agg(F.bit_or("_m").alias("_m")))


def _joined(df: DataFrame, key: str, need: DataFrame, how: str) -> DataFrame:
    x = df.withColumn("_h", _hash(key)).withColumn("_k", _mask(F.col("_h")))
    return x.join(_words(need, key), (_word(F.col("_h")) == F.col("_w")) & (F.col("_m").bitwiseAND(F.col("_k")) == F.col("_k")), how).drop("_h", "_k")


def among(df: DataFrame, key: str, need: DataFrame) -> DataFrame:
    """All rows of df whose key is in need (column of the same name), and a few others."""
    return _joined(df, key, need, "left_semi")


def surely_not(df: DataFrame, key: str, need: DataFrame) -> DataFrame:
    """The rows that among() leaves out: none of them has a key in need."""
    return _joined(df, key, need, "left_anti")


def one_row_each(df: DataFrame, key: str, pick: Column) -> DataFrame:
    """(key, fields of pick): one row per key; only rows whose key may come twice are moved for it.

    pick is an aggregate that gives a struct of columns of df, by their names. A null key is a key.
    """
    again = df.groupBy(key).agg(F.count("*").alias("_n")).where("_n > 1").select(key)
    several = among(df, key, again).groupBy(key).agg(pick.alias("_x")).select(key, "_x.*")
    return surely_not(df, key, again).select(*several.columns).unionAll(several)


def distinct_rows(df: DataFrame, key: str) -> DataFrame:
    """df.distinct(), for which only rows are moved whose key may come twice. No column may be a map."""
    again = df.groupBy(key).agg(F.count("*").alias("_n")).where("_n > 1").select(key)
    return surely_not(df, key, again).unionAll(among(df, key, again).distinct())
