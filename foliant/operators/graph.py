"""Graph primitives on edge tables: components and pointer doubling.

Nothing here collects nodes or labels to the driver; each round cuts its lineage by a reliable
checkpoint and asks the driver only for a count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import checkpoint


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """Components of an undirected graph: (node, component), component = smallest node.

    Alternates the large-star and the small-star step; both are a grouped minimum (combined before the
    shuffle, so a hub costs no more than its edges) and an equi-join. Rows with a null end are ignored,
    repeated edges count once, a loop keeps its node as a component of its own.
    """
    e = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u IS NOT NULL AND v IS NOT NULL")
    nodes = e.select(F.col("u").alias("node")).union(e.select("v")).distinct()
    cur = checkpoint(e.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = None
    for _ in range(max_rounds):
        both = cur.union(cur.select(F.col("v"), F.col("u")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("x")).select("x.*")
        cur = checkpoint(small.where("u <> v").distinct())
        now = cur.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0)).alias("h")).first()
        if mark == (now.n, now.h):
            break
        mark = (now.n, now.h)
    else:
        raise RuntimeError("components did not settle")
    return nodes.join(cur.withColumnRenamed("u", "node"), "node", "left").select("node", F.coalesce("v", "node").alias("component"))


def double_pointers(state: DataFrame, fold: dict, max_rounds: int = 64) -> DataFrame:
    """Follow pointers to their ends in O(log longest path) rounds of equi-joins.

    state has node, ptr (null at an end) and the columns named in fold. In each round a row whose
    pointer isn't at its end takes over its target's pointer; fold[c](own, target) gives the new value
    of column c. The pointers must form no ring.
    """
    cur = checkpoint(state)
    for _ in range(max_rounds):
        if cur.where("ptr IS NOT NULL").isEmpty():
            return cur
        t = cur.select(F.col("node").alias("t_node"), F.col("ptr").alias("t_ptr"), *[F.col(c).alias(f"t_{c}") for c in fold])
        live = cur.where("ptr IS NOT NULL").join(t, F.col("ptr") == F.col("t_node"), "left")
        moved = live.select("node", F.col("t_ptr").alias("ptr"), *[f(F.col(c), F.col(f"t_{c}")).alias(c) for c, f in fold.items()])
        cur = checkpoint(cur.where("ptr IS NULL").select(moved.columns).unionAll(moved))
    raise RuntimeError("the pointers hold a ring")
