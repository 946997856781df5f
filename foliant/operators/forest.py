"""Parent-child rows to full hierarchies by heavy-path decomposition (problem 6).

1. Rings are separated: pointers are doubled until a round ends no further node; what is still
   running lies in or below a ring. Subtree sizes are summed in the same rounds.
2. Each inner node's heavy child is the child with the largest subtree (ties: the smallest id). Runs of
   heavy edges are chains; every node gets its chain's head and its place in the chain.
3. Any path crosses at most log2(n) chains. Depth, root, path and pre-order number of a chain's head
   are the sums (or concatenation) of chain segments above it.
4. With pre-order numbers, the descendants of a node are one interval: (lo, lo + size).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window as W

from ..session import checkpoint
from .graph import double_pointers

SIBLING_BUCKETS = 512
BASE = 8
STRETCH = 65536


def parents(rows: DataFrame, node: str = "node", parent: str = "parent") -> DataFrame:
    """One row per node with its parent, or null where it is a root.

    A null node is ignored. A null, blank or unknown parent makes a root. If rows of one node name
    several parents, the smallest one that is not blank counts; the caller may resolve it otherwise.
    """
    named = F.when(F.col(parent).rlike(r"\S"), F.col(parent))
    one = rows.where(F.col(node).isNotNull()).groupBy(F.col(node).alias("node")).agg(F.min(named).alias("parent"))
    known = one.select(F.col("node").alias("k"))
    return one.join(known, F.col("parent") == F.col("k"), "left").select("node", F.col("k").alias("parent"))


def separate(one: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes free of rings with their subtree size, nodes in or below a ring with the ring's smallest node)."""
    cur = checkpoint(one.select("node", "parent", F.col("parent").alias("ptr"), F.lit(1.0).alias("size"), F.col("node").alias("low")))
    live, k = cur.where("ptr IS NOT NULL").count(), 0
    while live:
        add = cur.where("ptr IS NOT NULL").groupBy(F.col("ptr").alias("a_node")).agg(F.sum("size").alias("a_size"))
        t = cur.select(F.col("node").alias("t_node"), F.col("ptr").alias("t_ptr"), F.col("low").alias("t_low"))
        ran = cur.where("ptr IS NOT NULL").join(t, F.col("ptr") == F.col("t_node"), "left").select("node", "parent", F.col("t_ptr").alias("ptr"), "size", F.least("low", "t_low").alias("low"))
        both = cur.where("ptr IS NULL").unionAll(ran)
        cur = checkpoint(both.join(add, F.col("node") == F.col("a_node"), "left").select("node", "parent", "ptr", (F.col("size") + F.coalesce("a_size", F.lit(0.0))).alias("size"), "low"))
        k, was = k + 1, live
        live = cur.where("ptr IS NOT NULL").count()
        if live == was:
            break
    free = cur.where("ptr IS NULL").select("node", "parent", F.col("size").cast("long").alias("size"))
    ring = cur.where("ptr IS NOT NULL").select("node", "ptr", "low")
    while live > 2**k:
        t = ring.select(F.col("node").alias("t_node"), F.col("ptr").alias("t_ptr"), F.col("low").alias("t_low"))
        ring = checkpoint(ring.join(t, F.col("ptr") == F.col("t_node")).select("node", F.col("t_ptr").alias("ptr"), F.least("low", "t_low").alias("low")))
        k += 1
    inside = ring.select(F.col("node").alias("t_node"), F.col("low").alias("t_low"))
    return free, ring.join(inside, F.col("ptr") == F.col("t_node")).select("node", F.col("t_low").alias("root"))


def hierarchy(rows: DataFrame, node: str = "node", parent: str = "parent", paths: bool = False, intervals: bool = False) -> DataFrame:
    """Per node: node, parent, root, depth, size; with paths also path (array from the root to the node);
    with intervals also lo and hi, where u lies below v if they have one root and v.lo < u.lo < v.hi.

    Nodes in or below a ring have depth -1, the ring's smallest node as root and null elsewhere. An
    empty table gives an empty result. See parents() for nulls, blanks, repeated and contradicting rows.
    Siblings are numbered within SIBLING_BUCKETS hash buckets a parent, so no task holds all children
    of a parent with very many.
    """
    one = checkpoint(parents(rows, node, parent))
    free, ring = separate(one)
    heavy = free.where("parent IS NOT NULL").groupBy(F.col("parent").alias("h_parent")).agg(F.min_by(F.struct("node", "size"), F.struct(-F.col("size"), F.col("node"))).alias("h"))
    cut = free.join(heavy, F.col("parent") == F.col("h_parent"), "left").select("node", "parent", "size", (F.col("parent").isNotNull() & (F.col("node") == F.col("h.node"))).alias("is_heavy"), F.coalesce("h.size", F.lit(0)).alias("beside"))
    cut = checkpoint(cut)

    # chains
    start = cut.select("node", F.when(F.col("is_heavy"), F.col("parent")).alias("ptr"), F.when(F.col("is_heavy"), F.col("parent")).otherwise(F.col("node")).alias("head"), F.col("is_heavy").cast("long").alias("pos"), *([F.array("node").alias("seg")] if paths else []))
    fold = {"head": lambda own, up: up, "pos": lambda own, up: own + up} | ({"seg": lambda own, up: F.concat(up, own)} if paths else {})
    chain = double_pointers(start, fold).drop("ptr")

    # one row per chain: the chain above, and what the segment above adds
    top = cut.where(~F.col("is_heavy")).select("node", "parent", "size", "beside")
    if intervals:
        bucket = F.pmod(F.xxhash64("node"), F.lit(SIBLING_BUCKETS))
        light = top.where("parent IS NOT NULL").withColumn("b", bucket)
        within = W.partitionBy("parent", "b").orderBy("node").rowsBetween(W.unboundedPreceding, -1)
        before = W.partitionBy("b_parent").orderBy("b_b").rowsBetween(W.unboundedPreceding, -1)
        sums = light.groupBy(F.col("parent").alias("b_parent"), F.col("b").alias("b_b")).agg(F.sum("size").alias("s")).withColumn("s", F.coalesce(F.sum("s").over(before), F.lit(0)))
        light = light.withColumn("o", F.coalesce(F.sum("size").over(within), F.lit(0))).join(sums, (F.col("parent") == F.col("b_parent")) & (F.col("b") == F.col("b_b")))
        top = top.where("parent IS NULL").select("node", "parent", F.lit(0).cast("long").alias("off")).unionAll(light.select("node", "parent", (F.col("beside") + F.col("s") + F.col("o")).alias("off")))
    above = chain.select(F.col("node").alias("c_node"), F.col("head").alias("c_head"), F.col("pos").alias("c_pos"), *([F.col("seg").alias("c_seg")] if paths else []))
    links = top.join(above, F.col("parent") == F.col("c_node"), "left").select(
        "node",
        F.col("c_head").alias("ptr"),
        F.coalesce("c_head", "node").alias("root"),
        F.coalesce(F.col("c_pos") + 1, F.lit(0)).alias("depth"),
        *([F.coalesce(F.col("c_pos") + 1 + F.col("off"), F.lit(0)).alias("lo")] if intervals else []),
        *([F.coalesce("c_seg", F.array().cast("array<string>")).alias("path")] if paths else []),
    )
    fold = {"root": lambda own, up: up, "depth": lambda own, up: own + up}
    fold |= {"lo": lambda own, up: own + up} if intervals else {}
    fold |= {"path": lambda own, up: F.concat(up, own)} if paths else {}
    heads = double_pointers(links, fold).drop("ptr").withColumnsRenamed({"node": "h_node", "depth": "h_depth", "lo": "h_lo", "path": "h_path"})

    whole = chain.join(heads, F.col("head") == F.col("h_node")).join(free.withColumnRenamed("node", "f_node"), F.col("node") == F.col("f_node"))
    out = whole.select(
        "node",
        "parent",
        "root",
        (F.col("h_depth") + F.col("pos")).alias("depth"),
        "size",
        *([(F.col("h_lo") + F.col("pos")).alias("lo"), (F.col("h_lo") + F.col("pos") + F.col("size")).alias("hi")] if intervals else []),
        *([F.concat("h_path", "seg").alias("path")] if paths else []),
    )
    rings = ring.join(one, "node").select("node", "parent", "root", F.lit(-1).cast("long").alias("depth"))
    return out.unionByName(rings, allowMissingColumns=True)


def blocks(at: Column, levels: Column) -> Column:
    """The blocks of BASE ** level positions that hold a position, for the levels 0 to levels."""
    return F.transform(F.sequence(F.lit(0), levels), lambda k: F.struct(k.alias("level"), F.floor(at / F.pow(F.lit(BASE), k)).alias("block")))


def cover(lo: Column, hi: Column, levels: Column) -> Column:
    """The fewest whole blocks that make up the positions from lo to hi - 1: at each level those beyond the ones of the next."""
    up = lambda x, k: F.ceil(x / F.pow(F.lit(BASE), k))
    down = lambda x, k: F.floor(x / F.pow(F.lit(BASE), k))
    run = lambda a, b: F.when(a < b, F.sequence(a, b - 1)).otherwise(F.array().cast("array<bigint>"))

    def level(k: Column) -> Column:
        a, b, c, e = up(lo, k), down(hi, k), up(lo, k + 1) * BASE, down(hi, k + 1) * BASE
        own = F.when((c < e) & (k < levels), F.concat(run(a, c), run(e, b))).otherwise(run(a, b))
        return F.transform(own, lambda x: F.struct(k.alias("level"), x.alias("block")))

    return F.flatten(F.transform(F.sequence(F.lit(0), levels), level))


def descendants(labels: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(ancestor, node) of the given nodes (column node), or of all, by the interval of each within its root's tree.

    Intervals are made up of whole blocks of positions, which meet the nodes' blocks by an equi-join: every row
    it yields is a descendant, however large the trees are.
    """
    free = labels.where("depth >= 0")
    asked = free if nodes is None else free.join(nodes.select("node").distinct(), "node", "left_semi")
    sized = asked.where("hi > lo + 1")
    top = free.where("node = root AND hi > lo + 1").select("root", F.floor(F.log(float(BASE), F.col("hi").cast("double"))).cast("int").alias("levels"))
    v = sized.join(top, "root").select(F.col("node").alias("ancestor"), "root", F.explode(cover(F.col("lo") + 1, F.col("hi"), F.col("levels"))).alias("x")).select("ancestor", "root", "x.*")
    u = free.where("node <> root").join(top, "root").select("node", "root", F.explode(blocks(F.col("lo"), F.col("levels"))).alias("x")).select("node", "root", "x.*")
    return v.join(u, ["root", "level", "block"]).select("ancestor", "node")


def counted(labels: DataFrame) -> DataFrame:
    """(node, n): how many nodes' positions lie within each node's interval, counted among the positions themselves.

    Positions are counted up within stretches of a tree, so no task holds a whole tree.
    """
    free = labels.where("depth >= 0")
    begin = free.select("root", "node", F.col("lo").alias("at"), F.lit(1).alias("one"))
    end = free.where("hi > lo + 1").select("root", "node", F.col("hi").alias("at"), F.lit(0).alias("one"))
    marks = checkpoint(begin.unionAll(end).withColumn("b", F.floor(F.col("at") / STRETCH)))
    within = W.partitionBy("root", "b").orderBy("at", "one").rowsBetween(W.unboundedPreceding, 0)
    before = W.partitionBy("s_root").orderBy("s_b").rowsBetween(W.unboundedPreceding, -1)
    sums = marks.groupBy(F.col("root").alias("s_root"), F.col("b").alias("s_b")).agg(F.sum("one").alias("s")).withColumn("s", F.coalesce(F.sum("s").over(before), F.lit(0)))
    upto = marks.withColumn("c", F.sum("one").over(within)).join(sums, (F.col("root") == F.col("s_root")) & (F.col("b") == F.col("s_b")))
    c = F.col("c") + F.col("s")
    both = upto.groupBy("node").agg(F.sum(F.when(F.col("one") == 0, c)).alias("last"), F.sum(F.when(F.col("one") == 1, c)).alias("first"))
    return both.select("node", F.coalesce(F.col("last") - F.col("first"), F.lit(0)).alias("n"))


class WouldBeRing(ValueError):
    """A node can't be moved below itself."""


def moved(rows: DataFrame, which: str, below: str | None, node: str = "node", parent: str = "parent") -> DataFrame:
    """rows with one node under another parent, or a root if that is null; WouldBeRing if the parent is the node or below it."""
    if below is not None:
        place = hierarchy(rows, node, parent, paths=True).where(F.col("node") == below).select("path").first()
        if below == which or (place is not None and which in (place["path"] or [])):
            raise WouldBeRing(f"{which} below {below}")
    return rows.withColumn(parent, F.when(F.col(node) == which, F.lit(below)).otherwise(F.col(parent)))


def by_tag(tags: DataFrame, links: DataFrame, tag: str) -> DataFrame:
    """(document_id) of the documents with the tag or one below it in a registry (name, parent), whatever the tags' names."""
    h = checkpoint(hierarchy(links, "name", "parent", intervals=True))
    one = h.where(F.col("node") == tag).select("node")
    under = descendants(h, one).select(F.col("node").alias("tag")).unionAll(one.select(F.col("node").alias("tag")))
    return tags.join(under, "tag", "left_semi").select("document_id").distinct()
