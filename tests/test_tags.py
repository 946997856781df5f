from pyspark.sql import functions as F

from foliant.operators import relations as rel, tags as tg

DDL = "document_id string, tag string"
ROWS = [("knn", "study/lecture"), ("knn", "study/mit/ml"), ("qsort", "study/seminar"), ("qsort", "study/mit/cprog")]


def tags(spark, rows):
    return spark.createDataFrame(rows, DDL)


def ids(df):
    return sorted(r[0] for r in df.collect())


def test_containment(spark):
    t = tags(spark, ROWS)
    counts = {r.path: r.documents for r in tg.contained_counts(t).collect()}
    assert (counts["study"], counts["study/mit"], counts["study/lecture"]) == (2, 2, 1)
    assert ids(tg.contained(t, "study/mit")) == ["knn", "qsort"]


def test_sub_tags(spark):
    t = tags(spark, ROWS)
    assert [r.segment for r in tg.sub_tags(t, "study").collect()] == ["mit", "lecture", "seminar"]
    assert [r.segment for r in tg.sub_tags(t, "study/mit").collect()] == ["cprog", "ml"]
    assert [r.segment for r in tg.sub_tags(t).collect()] == ["study"]
    assert tg.sub_tags(tags(spark, [("d", "student:Alice")])).count() == 0


def test_direct(spark):
    t = tg.with_ancestors(tags(spark, ROWS))
    assert ids(tg.direct(t, "study")) == [] and ids(tg.direct(t, "study/lecture")) == ["knn"]
    more = tags(spark, [("deep", "study/mit/ml"), ("exact", "study/mit"), ("both", "study/mit"), ("both", "study/mit/ml")])
    assert ids(tg.direct(more, "study/mit")) == ["exact"]


def test_completions(spark):
    t = tags(spark, [(str(i), x) for i, x in enumerate(["ma/x", "a/ma", "mxa", "ma", "ma:p"])])
    assert [r.tag for r in tg.completions(t, "ma").collect()] == ["ma", "ma/x", "a/ma", "mxa"]
    assert tg.completions(t, "  ").count() == 0 and tg.completions(t, "m(").count() == 0


def test_maximal(spark):
    t = tags(spark, [("d", x) for x in ["study", "study/mit", "study/mit/ml", "student:Alice"]])
    assert sorted(r.tag for r in tg.maximal(t).collect()) == ["student:Alice", "study/mit/ml"]


def test_derived(spark):
    t = tags(spark, [("1", x) for x in ["t1/t2/t3", "t1/t2/s3", "t1/t2/s4", "t1/s5", "t1/s6"]])
    assert sorted(r.tag for r in tg.derived_sub_tags(t, "t1/t2/t3").collect()) == ["t1/s5", "t1/s6", "t1/t2/s3", "t1/t2/s4"]


def test_children_of_walk(spark):
    t = tags(spark, [(d, x) for d in "ab" for x in ["p1", "p2", "p2/p2s1", "p2/p2s1/s3"]] + [("a", "p1/p1s2")])
    assert [r.tag for r in tg.children_of_walk(t, ["p1", "p2", "p2/p2s1"]).collect()] == ["p2/p2s1/s3", "p1/p1s2"]
    assert [r.tag for r in tg.children_of_walk(t, []).collect()] == ["p1", "p2"]


def test_rename(spark):
    t = tags(spark, [("d", "a/b"), ("d", "b"), ("e", "c")])
    assert [tuple(r) for r in tg.renamed(t, "b", "a/b").collect()] == [("d", "a/b")]
    assert tg.renamed(t, "b", "b").count() == 0


def test_main_path(spark):
    rows = [(f"s{i}", "study") for i in range(20)] + [(f"m{i}", "study/mit") for i in range(14)] + [(f"a{i}", "article") for i in range(3)] + [("l", "study/lecture")] + [("d", x) for x in ("study", "study/mit", "study/lecture", "article", "p:q")]
    assert tg.main_paths(tags(spark, rows)).where("document_id = 'd'").first().path == "study/mit/article/lecture"
    assert tg.main_paths(tags(spark, [("d", "zeta"), ("d", "alpha")])).first().path == "alpha/zeta"
    assert tg.main_paths(tags(spark, [("d", "p:q")])).count() == 0


def test_paths(spark):
    rows = ["a/b/c", "", "/a", "a/", "a//b", "a:b", "x" * 61, "/".join("abcdefghi")]
    got = [r.e for r in tags(spark, [("d", x) for x in rows]).select(tg.path_error("tag").alias("e")).collect()]
    assert got[0] is None and all(got[1:]) and len(set(got[1:])) == 7
    r = tags(spark, [("d", "a/b/c")]).select(tg.prefixes("tag").alias("p"), tg.prefixes("tag", True).alias("q"), tg.parent("tag").alias("u"), tg.last_segment("tag").alias("l")).first()
    assert (r.p, r.q, r.u, r.l) == (["a", "a/b", "a/b/c"], ["a", "a/b"], "a/b", "c")


def test_rebase_and_chains(spark):
    r = tg.rebased(tags(spark, [("d", "a/b/c"), ("d", "a"), ("d", "z")]), ["a", "a/b"]).collect()
    assert [x.rest for x in r] == ["c", "", None]
    tree = {"": [("a", 2), ("z", 1)], "a": [("a/b", 2)], "a/b": [("a/b/c", 2), ("a/b/d", 1)], "z": []}
    assert tg.collapse_chains(lambda p: tree.get(p, [])) == [("a/b", 2), ("z", 1)]


def test_browse_and_query(spark):
    docs = spark.createDataFrame([("i-1", "Invoice", "application/pdf", ["finance"], "document", "f", 100), ("i-2", "Letter", None, ["personal"], "document", "f", 300), ("i-3", "Both", "text/plain", ["finance/tax", "personal"], "document", None, 200), ("f", "Folder", "x", [], "folder", None, 1)], "id string, title string, mime_type string, tags array<string>, kind string, parent_id string, updated_at_ms long")
    assert ids(rel.browse(docs, ["finance", "personal"])) == ["i-3"]
    assert ids(rel.browse(docs, text=" INV ")) == ["i-1"] and ids(rel.browse(docs, category="text")) == ["i-3"]
    assert rel.browse(docs).count() == 4
    assert [r.id for r in rel.query(docs, kind="document", limit=2).collect()] == ["i-2", "i-3"]
    assert [r.id for r in rel.query(docs, kind="document", limit=2, offset=1).collect()] == ["i-3", "i-1"]
    assert ids(rel.query(docs, parent="f")) == ["i-1", "i-2"] and ids(rel.query(docs, tags=["personal"])) == ["i-2", "i-3"]


def test_upsert_and_delete(spark):
    old = spark.createDataFrame([("1", "a", 1), ("2", "b", 2)], "id string, v string, c long")
    new = spark.createDataFrame([("2", "x", 9), ("2", "y", 8), ("3", None, 7)], "id string, v string, c long")
    assert sorted(map(tuple, rel.upsert(old, new, ["id"], ["c"]).collect())) == [("1", "a", 1), ("2", "y", 2), ("3", None, 7)]
    gone = {"documents": old, "document_tags": spark.createDataFrame([("1", "t"), ("2", "u")], DDL), "tags": spark.createDataFrame([("t",), ("u",)], "name string")}
    left = rel.delete_documents(gone, spark.createDataFrame([("1",)], "id string"))
    assert ids(left["documents"]) == ["2"] and ids(left["tags"]) == ["u"]


def test_feedback_and_preference(spark):
    f = spark.createDataFrame([("invoice", "accepted", 1.0), ("invoice", "accepted", 1.0), ("tax", "rejected", 1.0)], "term string, action string, weight double").withColumns({"kind": F.lit("tags"), "context": F.lit("tag")})
    assert sorted(map(tuple, rel.feedback_stats(f).collect())) == [("invoice", 2.0, 0.0), ("tax", 0.0, 1.0)]
    s = spark.createDataFrame([(3.0, 0.0), (0.0, 10.0), (100.0, 0.0), (None, None)], "accepts double, rejects double").select(rel.preference().alias("s")).collect()
    assert s[0].s > 1 and [x.s for x in s[1:]] == [0.25, 4.0, 1.0]


def test_unique_names(spark):
    df = spark.createDataFrame([("d", "x.pdf", "1"), ("d", "x.pdf", "2"), ("d", "x.pdf", "3"), ("d", "x (2).pdf", "4"), ("e", "x.pdf", "5"), ("d", "n", "6"), ("d", "n", "7")], "dir string, name string, id string")
    got = {r.id: r.unique_name for r in rel.sibling_names(df, "dir", "name", "id").collect()}
    assert got == {"1": "x.pdf", "2": "x (3).pdf", "3": "x (4).pdf", "4": "x (2).pdf", "5": "x.pdf", "6": "n", "7": "n (2)"}


def test_bulk_tags(spark):
    r = spark.createDataFrame([(["a", "b"],)], "tags array<string>").select(rel.bulk_tags(F.col("tags"), [" c ", "", "a"], ["b"]).alias("t")).first()
    assert r.t == ["a", "c"]


def test_names_in_one_large_folder(spark):
    """A tenth of all rows with one name in one folder, numbers taken among them: unique names, numbered in order."""
    rows = [("hot", "n.txt", f"{i:04d}") for i in range(400)] + [("hot", f"n ({k}).txt", f"k{k}") for k in (2, 3, 7)] + [(None, "n.txt", "z1"), (None, "n.txt", "z2")]
    got = {r.id: r.unique_name for r in rel.sibling_names(spark.createDataFrame(rows, "dir string, name string, id string"), "dir", "name", "id").collect()}
    assert [got[f"{i:04d}"] for i in range(5)] == ["n.txt", "n (4).txt", "n (5).txt", "n (6).txt", "n (8).txt"]
    assert len({got[f"{i:04d}"] for i in range(400)} | {"n (2).txt", "n (3).txt", "n (7).txt"}) == 403 and got["z2"] == "n (2).txt"


def test_views_and_choices(spark):
    df = spark.createDataFrame([(["b", "a"], ["a", "b", "a"], ["x", "a"])], "f array<string>, v array<string>, k array<string>")
    r = df.select(rel.view_active("f", "v").alias("on"), rel.toggled("f", "v").alias("off"), rel.toggled("k", "v").alias("to"), rel.one_tap("k", "v", "f").alias("offer")).first()
    assert r.on and r.off == [] and r.to == ["a", "b"] and r.offer == ["x"]
    t = spark.createDataFrame([("1", "a"), ("1", "b"), ("2", "b"), ("3", "c")], "document_id string, tag string")
    assert {r.tag for r in rel.removable(t, spark.createDataFrame([("1",), ("2",)], "id string")).collect()} == {"a", "b"}
