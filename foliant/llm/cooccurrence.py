"""Items that appear together, by a blocked Gram matrix (problem 5).

A basket is a row of a binary sparse matrix X, an item one of its columns; the counts of pairs are X'X.
The rows are split into record blocks; each block adds up its own product before anything is
shuffled: short rows by a sparse product (shifts of the sorted row against itself), long rows by dense
products of item blocks. A block holds so many rows that its pairs fit into a task; a row whose pairs
alone would be too many is parted into tiles, one task for each two of its item blocks. Then the sums are added. Items that occur in fewer baskets than a
pair needs cannot be in a result and are left out beforehand; this changes no count.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, Window as W

from ..operators.filters import among, surely_not
from ..session import checkpoint, table

ENTRIES_PER_BLOCK = 200_000
PAIRS_PER_BLOCK = 4_000_000
HUGE_ROW = 2048
LONG_ROW = 96
ITEM_BLOCK = 512
BROADCAST_ITEMS = 200_000


def product(basket: np.ndarray, item: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, n) with a < b of one record block; its entries must be distinct."""
    order = np.lexsort((item, basket))
    basket, item = basket[order], item[order]
    ids, col = np.unique(item, return_inverse=True)
    t, found = len(ids), []
    _, start, length = np.unique(basket, return_index=True, return_counts=True)
    long = np.repeat(length > LONG_ROW, length)
    row, c = np.repeat(np.arange(len(start)), length)[~long], col[~long].astype(np.int64)
    for s in range(1, int(length[length <= LONG_ROW].max(initial=1))):
        same = row[s:] == row[:-s]
        if not same.any():
            break
        found.append(np.unique(c[:-s][same] * t + c[s:][same], return_counts=True))
    wide = np.flatnonzero(length > LONG_ROW)
    for at in range(0, len(wide), 4096):
        rows = wide[at : at + 4096]
        parts = np.concatenate([col[start[r] : start[r] + length[r]] for r in rows])
        which = np.repeat(np.arange(len(rows)), length[rows])
        used = np.unique(parts)
        place = np.searchsorted(used, parts)
        blocks = []
        for lo in range(0, len(used), ITEM_BLOCK):
            x = np.zeros((len(rows), min(ITEM_BLOCK, len(used) - lo)), np.float32)
            inside = (place >= lo) & (place < lo + ITEM_BLOCK)
            x[which[inside], place[inside] - lo] = 1
            blocks.append((lo, x))
        for i, (lo, x) in enumerate(blocks):
            for hi, y in blocks[i:]:
                a, b = np.nonzero(g := x.T @ y)
                n = g[a, b]
                up = (a + lo) < (b + hi)
                found.append((used[a[up] + lo].astype(np.int64) * t + used[b[up] + hi], n[up].astype(np.int64)))
    if not found:
        return (np.zeros(0, np.int64),) * 3
    codes, at = np.unique(np.concatenate([f[0] for f in found]), return_inverse=True)
    n = np.bincount(at, np.concatenate([f[1] for f in found])).astype(np.int64)
    return ids[codes // t], ids[codes % t], n


def _block(pdf: pd.DataFrame) -> pd.DataFrame:
    a, b, n = product(pd.factorize(pdf["basket"])[0], pdf["item"].to_numpy(np.int64))
    return pd.DataFrame({"a": a, "b": b, "n": n})


NO_PAIRS = pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64), "n": np.zeros(0, np.int64)})


def _tile(pdf: pd.DataFrame) -> pd.DataFrame:
    """The pairs between two item blocks of one basket, or within one."""
    at = pdf["tile"].to_numpy()
    items = pdf["item"].to_numpy(np.int64)
    x, y = items[at == at.min()], items[at == at.max()]
    a, b = np.repeat(x, len(y)), np.tile(y, len(x))
    keep = a < b if at.min() == at.max() else np.ones(len(a), bool)
    return pd.DataFrame({"a": np.minimum(a, b)[keep], "b": np.maximum(a, b)[keep], "n": np.ones(int(keep.sum()), np.int64)})


def tiles(rows: DataFrame, huge: DataFrame) -> DataFrame:
    """(a, b, n) of the baskets in huge (basket, len), whose entries are parted into tiles of about HUGE_ROW / 2 items."""
    own = among(rows, "basket", huge).join(huge, "basket").withColumn("parts", F.ceil(F.col("len") * 2 / HUGE_ROW).cast("int"))
    own = own.withColumn("tile", F.pmod(F.xxhash64("item"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    keyed = own.select("basket", F.least("tile", "other").alias("lo"), F.greatest("tile", "other").alias("hi"), "tile", "item")
    return keyed.groupBy("basket", "lo", "hi").applyInPandas(lambda pdf: _tile(pdf) if pdf["tile"].nunique() == 2 or pdf["lo"].iat[0] == pdf["hi"].iat[0] else NO_PAIRS, "a long, b long, n long")


def pair_counts(df: DataFrame, basket: str, item: str, at_least: int = 1, share: float = 0.0) -> tuple[DataFrame, int]:
    """((item_a, item_b, n_ab, n_a, n_b) with item_a < item_b and n_ab >= max(at_least, share * baskets), number of baskets).

    Null baskets or items are ignored, repeated rows count once. An empty table gives an empty result.
    """
    d = checkpoint(df.where(F.col(basket).isNotNull() & F.col(item).isNotNull()).select(F.col(basket).alias("basket"), F.col(item).alias("item")).distinct())
    baskets = d.select("basket").distinct().count()
    floor = max(at_least, math.ceil(share * baskets - 1e-9), 1)
    often = d.groupBy("item").agg(F.count("*").alias("n")).where(F.col("n") >= floor)
    # numbers for items: dense within hash buckets, so no task orders all of them
    slot = F.pmod(F.xxhash64("item"), F.lit(1024))
    often = checkpoint(often.withColumn("slot", slot).withColumn("no", F.row_number().over(W.partitionBy("slot").orderBy("item")) * F.lit(1024).cast("long") + F.col("slot")).select("item", "n", "no"))
    kept = often.agg(F.count("*").alias("items"), F.coalesce(F.sum("n"), F.lit(0)).alias("entries")).first()
    small = F.broadcast if kept["items"] <= BROADCAST_ITEMS else (lambda x: x)
    rows = d.join(small(often.select("item", F.col("no"))), "item").select("basket", F.col("no").alias("item"))
    length = checkpoint(rows.groupBy("basket").agg(F.count("*").alias("len")))
    huge = length.where(F.col("len") > HUGE_ROW)
    work = length.where(F.col("len") <= HUGE_ROW).agg(F.coalesce(F.sum(F.col("len") * F.col("len") / 2), F.lit(0.0))).first()[0]
    cores = d.sparkSession.sparkContext.defaultParallelism
    blocks = max(1, math.ceil(kept["entries"] / ENTRIES_PER_BLOCK), math.ceil(work / PAIRS_PER_BLOCK), cores)
    some = not huge.isEmpty()
    usual = surely_not(rows, "basket", huge).unionAll(among(rows, "basket", huge).join(huge, "basket", "left_anti")) if some else rows
    part = usual.withColumn("block", F.pmod(F.xxhash64("basket"), F.lit(blocks))).groupBy("block").applyInPandas(_block, "a long, b long, n long")
    part = part.unionAll(tiles(rows, huge)) if some else part
    sums = part.groupBy("a", "b").agg(F.sum("n").alias("n_ab")).where(F.col("n_ab") >= floor)
    side = lambda x: small(often.select(F.col("no").alias(x), F.col("item").alias(f"item_{x}"), F.col("n").alias(f"n_{x}")))
    out = sums.join(side("a"), "a").join(side("b"), "b")
    swap = F.col("item_a") > F.col("item_b")
    first = lambda x, y: F.when(swap, F.col(y)).otherwise(F.col(x))
    return out.select(first("item_a", "item_b").alias("item_a"), first("item_b", "item_a").alias("item_b"), "n_ab", first("n_a", "n_b").alias("n_a"), first("n_b", "n_a").alias("n_b")), baskets


def above_chance(pairs: DataFrame, baskets: int, lift: int | float) -> DataFrame:
    """Pairs found at least lift times as often as if their items were independent, with that lift."""
    big = lambda c: F.col(c).cast("decimal(19,0)")
    enough = big("n_ab") * F.lit(baskets).cast("decimal(19,0)") >= F.lit(lift) * big("n_a") * big("n_b")
    return pairs.where(enough).withColumn("lift", F.col("n_ab") * F.lit(float(baskets)) / (F.col("n_a") * F.col("n_b").cast("double")))


def clean_tags(spark: SparkSession, d: str) -> DataFrame:
    tag = F.lower(F.regexp_replace("tag", r"^\s+|\s+$", ""))
    return table(spark, d, "document_tags").select("document_id", tag.alias("tag")).where("tag <> ''")


def tag_pairs(spark: SparkSession, d: str) -> DataFrame:
    pairs, n = pair_counts(clean_tags(spark, d), "document_id", "tag", 5, 1 / 2000)
    below: Column = F.expr("startswith(item_b, concat(item_a, '/'))")
    return above_chance(pairs, n, 4).where(~below).withColumnsRenamed({"item_a": "tag_a", "item_b": "tag_b"})


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return tag_pairs(spark, d).select("tag_a", "tag_b")


def p5_lift(spark: SparkSession, d: str) -> DataFrame:
    """The same pairs with their counts and lift."""
    return tag_pairs(spark, d).select("tag_a", "tag_b", "n_ab", "n_a", "n_b", F.round("lift", 6).alias("lift"))


PAIRS = r"""
t AS (SELECT DISTINCT document_id, lower(regexp_replace(tag, '^\s+|\s+$', '', 'g')) AS tag FROM document_tags),
d AS (SELECT * FROM t WHERE tag <> '' AND document_id IS NOT NULL),
k AS (SELECT tag, count(*) AS n FROM d GROUP BY 1),
p AS (SELECT a.tag AS tag_a, b.tag AS tag_b, count(*) AS n_ab FROM d a JOIN d b ON a.document_id = b.document_id AND a.tag < b.tag GROUP BY 1, 2),
r AS (SELECT p.*, x.n AS n_a, y.n AS n_b, (SELECT count(DISTINCT document_id) FROM d) AS n FROM p JOIN k x ON tag_a = x.tag JOIN k y ON tag_b = y.tag),
f AS (SELECT * FROM r WHERE n_ab >= 5 AND 2000 * n_ab >= n AND n_ab * n >= 4 * n_a * n_b AND NOT starts_with(tag_b, tag_a || '/'))
"""
SQL = {
    "p5_found": f"WITH {PAIRS} SELECT tag_a, tag_b FROM f",
    "p5_lift": f"WITH {PAIRS} SELECT tag_a, tag_b, n_ab, n_a, n_b, round(n_ab * CAST(n AS DOUBLE) / (n_a * CAST(n_b AS DOUBLE)), 6) AS lift FROM f",
}
QUERIES = {"p5_found": p5_found, "p5_lift": p5_lift}
