import pytest

from foliant.library import Library
from foliant.operators import assistant, forest, tags as tg
from foliant.sources import files
from foliant.streaming import upkeep


def test_mirror_and_remove(spark, tmp_path):
    root = str(tmp_path / "lib")
    rows = spark.createDataFrame([("a/b", "x.txt", b"one"), ("", "y.txt", b"two"), ("../out", "z.txt", b"no")], "rel_dir string, name string, content binary")
    for _ in range(2):
        got = {r.name: r.error for r in files.mirrored(rows, root).collect()}
        assert got["x.txt"] is None and got["y.txt"] is None and "ValueError" in got["z.txt"]
    tree = files.walk(spark, root, content=False)
    assert {(r.rel_dir, r.name) for r in tree.collect()} == {("a/b", "x.txt"), ("", "y.txt")}
    docs = spark.createDataFrame([("1", {"file_name": "x.txt", "main_path": "a/b"}), ("2", {"file_name": "y.txt"}), ("3", {"file_name": "gone"}), ("4", None)], "id string, extra map<string,string>")
    assert {r.id: r.path for r in files.mirrored_paths(docs, tree).collect()} == {"1": "a/b/x.txt", "2": "y.txt", "3": None, "4": None}
    gone = files.removed(spark.createDataFrame([("a/b", "x.txt"), ("a", "none")], "rel_dir string, name string"), root).collect()
    assert {r.name: r.existed for r in gone} == {"x.txt": True, "none": False} and not (tmp_path / "lib" / "a").exists() and (tmp_path / "lib" / "y.txt").exists()


def test_second_reconciliation_keeps_all(spark):
    tags = spark.createDataFrame([("1", "work")], "document_id string, tag string")
    doc = lambda extra: spark.createDataFrame([("1", "document", "Alpha", "text/plain", "c", extra)], "id string, kind string, title string, mime_type string, checksum_sha256 string, extra map<string,string>")
    first = files.reconciliation(doc({"file_name": "Alpha.txt", "main_path": "old"}), tags, spark.createDataFrame([("old", "Alpha.txt", "1")], "rel_dir string, name string, hash string"))
    assert [(r.action, r.to_dir) for r in first.collect()] == [("move", "work")]
    again = files.reconciliation(doc({"file_name": "Alpha.txt", "main_path": "work"}), tags, spark.createDataFrame([("work", "Alpha.txt", "1"), ("x", "Alpha.txt", "2")], "rel_dir string, name string, hash string"))
    assert [tuple(r) for r in files.outcome_counts(again).collect()] == [("keep", 1)]


def test_move_and_by_tag(spark):
    rows = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b"), ("d", None)], "name string, parent string")
    with pytest.raises(forest.WouldBeRing):
        forest.moved(rows, "a", "c", "name", "parent")
    with pytest.raises(forest.WouldBeRing):
        forest.moved(rows, "a", "a", "name", "parent")
    assert {r.name: r.parent for r in forest.moved(rows, "b", "d", "name", "parent").collect()} == {"a": None, "b": "d", "c": "b", "d": None}
    assert {r.name: r.parent for r in forest.moved(rows, "b", None, "name", "parent").collect()}["b"] is None
    tags = spark.createDataFrame([("1", "c"), ("2", "a"), ("3", "d")], "document_id string, tag string")
    assert {r.document_id for r in forest.by_tag(tags, rows, "a").collect()} == {"1", "2"}


def test_answers(spark):
    refs = spark.createDataFrame([(1, "d", "an excerpt")], "n int, doc string, excerpt string")
    answers = spark.createDataFrame([("x", "two  words", None), ("y", None, "timeout")], "id string, text string, error string")
    got = {}
    for r in assistant.answer_events(answers, refs).orderBy("id", "seq").collect():
        got.setdefault(r.id, []).append((r.kind, r.text))
    assert got["x"][-1] == ("done", "two  words") and "".join(t for k, t in got["x"] if k == "token") == "two  words" and len(got["x"]) == 3
    assert len(got["y"]) == 2 and "an excerpt [1]" in got["y"][0][1] and got["y"][1][0] == "done"
    r = assistant.respond(spark.createDataFrame([("p", "tax tax invoice"), ("q", None)], "id string, text string"), ["one", "two words"]).collect()
    assert {x.id for x in r} == {"p", "q"} and all(x.completion_tokens == len(x.text.split()) for x in r) and {x.id: x.prompt_tokens for x in r} == {"p": 3, "q": 1}


def test_visible_and_collapsed(spark):
    t = spark.createDataFrame([("1", "study/mit/ml"), ("2", "study/mit/ml"), ("3", "work/a"), ("4", "work/b"), ("5", "study/mit/ml"), ("5", "work/a"), ("6", "p:x")], "document_id string, tag string")
    shown = {r.path: r.shown for r in tg.collapsed(t).collect()}
    assert shown["study"] == shown["study/mit"] == "study/mit/ml" and shown["work"] == "work" and shown["work/a"] == "work/a" and "p:x" not in shown
    tree, rest = tg.visible(t, ["study/mit"])
    assert {(r.segment, r.documents) for r in tree.collect()} == {("ml", 3)} and rest.count() == 0
    tree, rest = tg.visible(t, ["work/a"])
    assert tree.count() == 0 and {r.document_id for r in rest.collect()} == {"3", "5"}


def test_event_log(spark, tmp_path):
    src, log = str(tmp_path / "in"), str(tmp_path / "log")
    for n in (1, 2):
        spark.createDataFrame([(f"p{n}", "connected")], "peer string, kind string").write.mode("append").parquet(src)
        upkeep.keep_events(spark.readStream.schema("peer string, kind string").parquet(src), log, str(tmp_path / "cp")).awaitTermination()
    assert sorted(r.peer for r in spark.read.parquet(log).collect()) == ["p1", "p2"]


def test_ingest_organises_and_indexes(spark, tmp_path):
    lib, root = Library(spark, str(tmp_path / "lib")), tmp_path / "files"
    root.mkdir()
    for name, text in {"old.txt": "invoice payment tax office bill", "food.txt": "recipe sugar flour butter oven"}.items():
        (root / name).write_text(text)
    first = lib.ingest(files.walk(spark, str(root), content=True), organise=False)
    old = {r.name: r.id for r in first.collect()}
    lib.set_tags(old["old.txt"], ["finance/tax"])
    (root / "scan01.txt").write_text("invoice payment tax office reminder")
    (root / "bad.docx").write_bytes(b"junk")
    done = {r.name: r for r in lib.ingest(files.walk(spark, str(root), content=True), now_ms=7).collect()}
    assert set(done) == {"scan01.txt", "bad.docx"} and done["bad.docx"].error and not done["scan01.txt"].error
    new = lib.get(done["scan01.txt"].id).first()
    assert {"finance", "finance/tax"} <= set(new.tags) and new.title != "scan01" and lib.read("documents").count() == 3
    assert {r.status for r in lib.read("suggestions").where("rank = 0").collect()} == {"applied"}
    assert [r.doc for r in lib.search("reminder").collect()] == [new.id]
    assert lib.organise(spark.createDataFrame([(new.id,)], "doc string")).first().skipped <= 1
    one = lib.read("suggestions").where("status = 'pending'").first()
    lib.mark_suggestion(one.id, "dismissed")
    assert lib.read("suggestions").where("status = 'dismissed'").count() >= 1 and lib.ingest(files.walk(spark, str(root), content=True)).where("error IS NULL").count() == 0
    assert [r["name"] for r in lib.names("tags").collect()] == sorted(r["name"] for r in lib.read("tags").collect())
