import random

import pytest
from pyspark.sql import functions as F

from foliant.operators import filters
from foliant.operators.forest import counted, descendants, hierarchy
from foliant.operators.graph import connected_components, double_pointers


def test_components_against_union_find(spark):
    rnd = random.Random(1)
    nodes = [f"n{i:03d}" for i in range(200)]
    edges = [(rnd.choice(nodes), rnd.choice(nodes)) for _ in range(150)] + [("hub", n) for n in nodes[:40]] + [(None, "n001"), ("n002", None), ("self", "self"), ("a", "b"), ("a", "b")]
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a and b:
            x, y = sorted((find(a), find(b)))
            up[y] = x
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "src string, dst string")).collect()}
    low = {}
    for n in up:
        low[find(n)] = min(low.get(find(n), n), n)
    assert got == {n: low[find(n)] for n in up}


def test_components_long_chain_and_empty(spark):
    chain = [(f"{i:04d}", f"{i + 1:04d}") for i in range(300)]
    got = connected_components(spark.createDataFrame(chain, "src string, dst string"))
    assert {r.component for r in got.collect()} == {"0000"}
    assert connected_components(spark.createDataFrame([], "src string, dst string")).count() == 0


def test_pointers_in_a_ring_are_an_error(spark):
    ring = spark.createDataFrame([("a", "b"), ("b", "a")], "node string, ptr string")
    with pytest.raises(RuntimeError):
        double_pointers(ring, {}, max_rounds=5)


def brute(rows):
    parent = {}
    for n, p in rows:
        if n is not None:
            parent.setdefault(n, None)
            if p is not None and p.strip():
                parent[n] = min(parent[n], p) if parent[n] else p
    parent = {n: p if p in parent else None for n, p in parent.items()}
    out = {}
    for n in parent:
        path, at = [n], n
        while parent[at] is not None and parent[at] not in path:
            at = parent[at]
            path.append(at)
        if parent[at] is None:
            out[n] = (at, len(path) - 1, tuple(reversed(path)))
        else:
            ring = path[path.index(parent[at]) :]
            out[n] = (min(ring), -1, None)
    return out


def random_forest(seed):
    rnd = random.Random(seed)
    rows = [(f"n{i}", f"n{rnd.randrange(max(1, i))}" if i and rnd.random() < 0.9 else rnd.choice([None, "", "  ", "unknown"])) for i in range(150)]
    rows += [(f"c{i}", f"c{i - 1}" if i else "n3") for i in range(70)]  # a long chain
    rows += [(f"k{i}", "n1") for i in range(60)]  # a parent of many
    rows += [(f"r{i}", f"r{(i + 1) % 5}") for i in range(5)] + [(f"t{i}", f"t{i - 1}" if i else "r2") for i in range(9)] + [("own", "own")]
    return rows + [rows[5], rows[6], (None, "n1")]


@pytest.mark.parametrize("seed", [1, 2])
def test_hierarchy(spark, seed):
    rows = random_forest(seed)
    df = spark.createDataFrame(rows, "node string, parent string").selectExpr("*", "1 AS size", "'x' AS root", "2 AS t_node")
    want = brute(rows)
    h = hierarchy(df, paths=True, intervals=True).cache()
    got = h.collect()
    assert {r.node: (r.root, r.depth, tuple(r.path) if r.path else None) for r in got} == want
    below = {n: {m for m, x in want.items() if x[2] and n in x[2] and m != n} for n in want}
    for r in got:
        if r.depth >= 0:
            assert r.size == len(below[r.node]) + 1 == r.hi - r.lo
    asked = ["n1", "c0", "k3", "n3"]
    pairs = {(r.ancestor, r.node) for r in descendants(h, spark.createDataFrame([(a,) for a in asked], "node string")).collect()}
    assert pairs == {(a, m) for a in asked for m in below[a]}


def test_hierarchy_of_nothing(spark):
    assert hierarchy(spark.createDataFrame([], "node string, parent string"), paths=True, intervals=True).count() == 0
    one = hierarchy(spark.createDataFrame([("a", "a")], "node string, parent string")).first()
    assert (one.root, one.depth) == ("a", -1)


def test_descendants_of_every_node_by_position(spark):
    want = brute(random_forest(3))
    below = {n: {m for m, x in want.items() if x[2] and n in x[2] and m != n} for n, w in want.items() if w[2]}
    h = hierarchy(spark.createDataFrame(random_forest(3), "node string, parent string"), intervals=True).cache()
    assert sorted((r.ancestor, r.node) for r in descendants(h).collect()) == sorted((a, m) for a in below for m in below[a])
    assert {r.node: r.n for r in counted(h).collect()} == {n: len(b) for n, b in below.items()}
    # a wrong numbering shows: hi - lo - 1 would still be the size of the subtree
    wrong = h.selectExpr("node", "root", "depth", "IF(node = 'n1', lo + 100000, lo) AS lo", "IF(node = 'n1', hi + 100000, hi) AS hi")
    assert {r.node: r.n for r in counted(wrong).collect()}["n1"] == 0


def test_descendants_have_registered_queries():
    from foliant.plans import registry

    assert "p6_below" in registry.QUERIES and "p6_below" in registry.SQL


def test_bloom_filter_keeps_all(spark):
    df = spark.range(20_000).selectExpr("id AS row")
    need = df.where("row % 7 = 0")
    got = {r.row for r in filters.among(df, "row", need).collect()}
    assert set(range(0, 20_000, 7)) <= got and len(got) < 3_400
    rest = {r.row for r in filters.surely_not(df, "row", need).collect()}
    assert not rest & got and len(rest) + len(got) == 20_000
    assert filters.among(df, "row", need.limit(0)).count() == 0


def test_one_row_each(spark):
    rows = [("a", "x"), ("a", "x"), ("b", "y"), ("c", None), ("d", "2"), ("d", "1"), (None, "n"), (None, "n")]
    got = filters.one_row_each(spark.createDataFrame(rows, "id string, t string"), "id", F.min(F.struct("t")))
    assert sorted(map(tuple, got.collect()), key=str) == sorted([("a", "x"), ("b", "y"), ("c", None), ("d", "1"), (None, "n")], key=str)
    two = spark.createDataFrame(rows, "id string, t string")
    assert sorted(map(tuple, filters.distinct_rows(two, "id").collect()), key=str) == sorted(set(rows), key=str)
