import io
import json
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from foliant import schemas
from foliant.library import Library, NotFound
from foliant.operators import assistant, organize, sync
from foliant.sources import files
from foliant.sources.extract import extract, html_text
from foliant.streaming import upkeep

SUG = schemas.SUGGESTIONS
MAN = schemas.MANIFEST


def zipped(name, body):
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        z.writestr(name, body)
    return b.getvalue()


W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
DOCX = zipped("word/document.xml", f'<w:document xmlns:w="{W}"><w:body><w:p><w:r><w:t>Hello </w:t></w:r><w:r><w:t>world</w:t></w:r></w:p><w:p><w:r><w:t>Two</w:t></w:r></w:p></w:body></w:document>')
ODT = zipped("content.xml", '<d xmlns:text="urn:t"><text:p> One <text:span>more</text:span></text:p><text:p>Two</text:p></d>')
EML = b"Subject: Hi\r\nFrom: a@x\r\nTo: b@y\r\nMIME-Version: 1.0\r\nContent-Type: multipart/alternative; boundary=q\r\n\r\n--q\r\nContent-Type: text/html\r\n\r\n<p>html</p>\r\n--q\r\nContent-Type: text/plain\r\n\r\nplain body\r\n--q--\r\n"


def test_extract():
    assert extract("plain", b"text\n\n") == ("text", "plain", None)
    assert extract("plain", "﻿grün".encode("utf-16-le")) [0] == "grün"
    assert extract("plain", "grün".encode("latin-1"))[0] == "grün"
    assert extract("markdown", b"# T")[:2] == ("# T", "markdown")
    assert extract("docx", DOCX)[:2] == ("Hello world\nTwo", "docx") and extract("odt", ODT)[:2] == ("One more\nTwo", "odt")
    assert extract("email", EML)[0] == "Subject: Hi\nFrom: a@x\nTo: b@y\n\nplain body"
    assert extract("image", b"\x89PNG") == ("", "none", None)
    assert extract("unsupported", b"")[2] and extract("docx", b"junk")[2]
    assert html_text("<style>p{}</style><p class='x'>a &amp; b</p><script>x</script><div>c</div>").strip() == "a & b\nc"


def test_ingest_and_stream(spark, tmp_path):
    root, state = tmp_path / "files", tmp_path / "state"
    (root / "sub").mkdir(parents=True)
    for name, data in {"a.txt": b"hello", "sub/b.md": b"# T", "sub/copy.txt": b"hello", "c.docx": b"junk", ".hidden": b"x", "d.tmp": b"x", "e.docx": DOCX}.items():
        (root / name).write_bytes(data)
    tree = files.walk(spark, str(root)).orderBy("rel_dir", "name").collect()
    assert [(r.rel_dir, r.name) for r in tree] == [("", "a.txt"), ("", "c.docx"), ("", "e.docx"), ("sub", "b.md"), ("sub", "copy.txt")]
    done = files.ingested(files.walk(spark, str(root), content=True)).cache()
    assert done.count() == 4 and done.where("error IS NOT NULL").count() == 1
    assert done.where("title = 'e'").first().text == "Hello world\nTwo"
    assert {r.kind for r in files.progress_events(done).collect()} == {"processing", "extracting", "completed", "failed"}
    assert files.ingested(files.walk(spark, str(root), content=True), done.select("id")).count() == 0
    seen = []
    for _ in range(2):
        upkeep.keep_documents(spark, str(root), str(state / "docs"), str(state / "cp"), lambda rows: seen.append(rows.count())).awaitTermination()
    assert seen == [4] and upkeep.VersionedTable(spark, str(state / "docs")).read().count() == 4


def test_index_upkeep(spark, tmp_path):
    src = str(tmp_path / "in")
    schema = "document_id string, text string, at_ms long"
    index = upkeep.VersionedTable(spark, str(tmp_path / "index"))
    for rows in ([("a", "old words", 1), ("b", "stays here", 1)], [("a", "new", 2), ("a", "older", 1)]):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(src)
        upkeep.keep_postings(spark.readStream.schema(schema).parquet(src), index.path, str(tmp_path / "cp")).awaitTermination()
    assert {(r.doc, r.term) for r in index.read().collect()} == {("a", "new"), ("b", "stays"), ("b", "here")}
    assert len([n for n in os.listdir(index.path) if n.startswith("v=")]) == 2


def test_peer_states(spark):
    e = spark.createDataFrame([("p", "discovered", "x", 1), ("p", "connected", "x", 3), ("p", "expired", "x", 2)], "peer string, state string, address string, at_ms long")
    assert upkeep.peer_states(e).first().state == "connected"


def test_library(spark, tmp_path):
    lib = Library(spark, str(tmp_path / "lib"))
    docs = spark.createDataFrame([("d1", None, "document", "One", "text/plain", 5, "a" * 64, 1, 100, {"k": "v"}), ("d2", "f", "document", "Two", "text/plain", 5, "b" * 64, 1, 200, None)], schemas.DOCUMENTS)
    lib.put(docs, spark.createDataFrame([("d1", "work/tax"), ("d2", "work"), ("zz", "ghost")], "document_id string, tag string"))
    assert lib.get("d1").first().tags == ["work", "work/tax"]
    lib.put(docs.withColumn("title", F.lit("New")))
    assert lib.read("documents").count() == 2 and lib.get("d2").first().title == "New"
    with pytest.raises(ValueError):
        lib.put(docs.withColumn("checksum_sha256", F.lit("deadbeef")))
    with pytest.raises(NotFound):
        lib.set_tags("nobody", ["x"])
    lib.set_tags("d1", ["solo"])
    assert sorted(r.name for r in lib.read("tags").collect()) == ["solo", "work"]
    lib.put_content(spark.createDataFrame([("d1", "t", "plain")], schemas.CONTENT))
    lib.link(spark.createDataFrame([("r", "c2", 0), ("r", "c1", 1)], schemas.LINKS))
    assert [r.child_id for r in lib.children("r").collect()] == ["c2", "c1"]
    assert [r.id for r in lib.query(kind="document", limit=1).collect()] == ["d2"]
    lib.save_view(" v ", ["b", "a"])
    lib.save_view("v", ["c"])
    assert [tuple(r) for r in lib.read("views").collect()] == [("v", ["c"])]
    with pytest.raises(ValueError):
        lib.save_view(" ", ["a"])
    lib.delete_view("none")
    lib.delete(["d1"])
    assert lib.read("content").count() == 0 and sorted(r.name for r in lib.read("tags").collect()) == ["work"]
    reopened = Library(spark, str(tmp_path / "lib"))
    assert reopened.read("documents").count() == 1


def test_blobs_and_bytes(spark, tmp_path):
    import hashlib

    from foliant.blobs import read_bytes

    lib = Library(spark, str(tmp_path / "lib"))
    sha = lambda b: hashlib.sha256(b).hexdigest()
    doc = lambda i, c="": (i, None, "document", i, "text/plain", 1, c, 1, 1, {})
    docs = lambda *rows: spark.createDataFrame(rows, schemas.DOCUMENTS)
    contents = spark.createDataFrame([("d1", b"hello world"), ("d2", b"hello world")], "id string, content binary")
    lib.put(docs(doc("d1"), doc("d2", sha(b"hello world").upper())), contents=contents)
    assert lib.read_bytes("d1") == b"hello world" and lib.get("d1").first().checksum_sha256 == sha(b"hello world")
    with pytest.raises(ValueError):
        lib.put(docs(doc("d3", sha(b"other"))), contents=spark.createDataFrame([("d3", b"bytes")], "id string, content binary"))
    assert lib.read("documents").count() == 2 and lib.blobs.keys().count() == 1
    lib.delete(["d1"])
    assert lib.blobs.contains(sha(b"hello world"))
    lib.delete(["d2"])
    assert not lib.blobs.contains(sha(b"hello world")) and lib.blobs.keys().count() == 0
    lib.blobs.put(contents.unionAll(contents))
    assert lib.blobs._all().count() == 1 and lib.blobs.put(contents).count() == 1 and lib.blobs._all().count() == 1
    stamped = spark.createDataFrame([("x", sha(b"hello world"), {"file_name": "a.txt", "main_path": "p"}), ("y", sha(b"hello world"), {"file_name": "gone.txt"}), ("z", None, None)], "id string, checksum_sha256 string, extra map<string,string>")
    files_ = spark.createDataFrame([("p", "a.txt", b"from file")], "rel_dir string, name string, content binary")
    got = {r.id: r.content and bytes(r.content) for r in read_bytes(stamped, lib.blobs.get(stamped), files_).collect()}
    assert got == {"x": b"from file", "y": b"hello world", "z": None}


def test_user_edits_and_settings(spark, tmp_path):
    lib = Library(spark, str(tmp_path / "lib"))
    lib.put(spark.createDataFrame([("d", None, "document", "Old", "text/plain", 1, "", 1, 5, {"a": "b"})], schemas.DOCUMENTS))
    lib.set_tags("d", ["x/y"], manual=True, now_ms=9)
    lib.rename("d", "New", now_ms=10)
    one = lib.get("d").first()
    assert one.title == "New" and one.tags == ["x", "x/y"] and one.extra == {"a": "b", "tags_manual": "true", "title_manual": "true"} and one.updated_at_ms == 10
    assert {(r.kind, r.term, r.weight) for r in lib.read("feedback").collect()} == {("tags", "x/y", 2.0), ("title", "New", 2.0)}
    lib.rename("d", "Suggested", manual=False)
    assert lib.read("feedback").count() == 2
    lib.set_setting("library_dir", "/shared/lib")
    assert lib.setting("library_dir") == "/shared/lib" and Library(spark, lib.root).setting("schema_version") == "2"
    lib.set_setting("library_dir", None)
    assert lib.setting("library_dir") is None
    with pytest.raises(NotFound):
        lib.rename("none", "x")


def test_search_from_the_index(spark, tmp_path):
    from foliant.operators import fts, vectors

    lib = Library(spark, str(tmp_path / "lib"))
    rows = [("a", "The quick fox and the lazy dog", "plain"), ("b", "An office supplies invoice for the office", "plain"), ("c", "A cookie recipe from the office party", "plain"), ("e", "", "plain")]
    content = spark.createDataFrame(rows, schemas.CONTENT)
    lib.put_content(content)
    for q in ("office", '"office supplies"', "office NOT invoice", "recipe OR fox", "NEAR(cookie office, 4)"):
        scan = {tuple(r) for r in fts.search_exact(content, "document_id", "text", q).collect()}
        assert {tuple(r) for r in lib.search(q).collect()} == scan and scan
    near = [r.doc for r in vectors.semantic(content, "document_id", "text", "office invoice").collect()]
    assert [r.doc for r in lib.search("office invoice", "semantic").collect()] == near and lib.search("fox", "hybrid").first().doc == "a"
    lib.put_content(spark.createDataFrame([("b", "nothing here", "plain")], schemas.CONTENT))
    assert [r.doc for r in lib.search("office").collect()] == ["c"] and lib.search("(").count() == lib.search(" ").count() == 0


def test_two_writers(spark, tmp_path):
    one, two = upkeep.VersionedTable(spark, str(tmp_path / "t")), upkeep.VersionedTable(spark, str(tmp_path / "t"))
    one.write(spark.range(1))
    seen = two._commits()
    one.write(spark.range(2))
    two._commits = lambda: seen
    with pytest.raises(upkeep.ConcurrentWrite):
        two.write(spark.range(3))
    assert one.read().count() == 2


def test_plans(spark):
    corpus = spark.createDataFrame([("inv-1", "Invoice one", "invoice acme payment total due"), ("inv-2", "Invoice two", "invoice acme payment overdue"), ("rec", "Cookies", "cookie recipe butter sugar flour"), ("new", "scan 7", "invoice acme payment due soon")], "id string, title string, text string")
    tags = spark.createDataFrame([("inv-1", "invoice"), ("inv-1", "finance"), ("inv-2", "invoice"), ("rec", "recipe")], "document_id string, tag string")
    asked = spark.createDataFrame([("new",), ("missing",)], "doc string")
    p = organize.plans(corpus, tags, asked).collect()
    assert len(p) == 1 and p[0].tags[0] == "invoice" and p[0].suggested_title.split()[0][0].isupper()
    assert p == organize.plans(corpus.repartition(3), tags, asked).collect()
    stats = spark.createDataFrame([("finance", 20.0, 0.0), ("invoice", 0.0, 5.0)], "term string, accepts double, rejects double")
    assert organize.plans(corpus, tags, asked, stats=stats).first().tags[0] == "finance"
    now = spark.createDataFrame([("new", "scan 7", ["old"])], "document_id string, title string, tags array<string>")
    s = organize.suggestions_of(organize.plans(corpus, tags, asked), now, "ingest", 5).collect()
    assert {r.status for r in s if r["rank"] == 0} == {"applied"} and any(r.id == "new-title-1" and r.payload == "scan 7" for r in s)


def sug(spark, rows):
    return spark.createDataFrame([(i, d, k, json.dumps(p) if k == "tags" else p, r, "ingest", 1.0, st, 1) for i, d, k, p, r, st in rows], SUG)


def test_preferences_order_alternatives(spark):
    corpus = spark.createDataFrame([("n", "notes", "invoice tax payment"), ("a", "x", "invoice tax payment bill"), ("b", "y", "recipe sugar flour")], "id string, title string, text string")
    tags = spark.createDataFrame([("a", "finance"), ("b", "food")], "document_id string, tag string")
    asked = spark.createDataFrame([("n",)], "doc string")
    stats = spark.createDataFrame([("payment", 5.0, 0.0), ("invoice", 5.0, 0.0), ("tax", 5.0, 0.0)], "term string, accepts double, rejects double")
    titles = spark.createDataFrame([("notes", 9.0, 0.0)], "term string, accepts double, rejects double")
    plain = organize.plans(corpus, tags, asked, ["topic"]).first()
    liked = organize.plans(corpus, tags, asked, ["topic"], stats=stats, title_stats=titles).first()
    assert sorted(map(tuple, plain.alt_tag_sets)) == sorted(map(tuple, liked.alt_tag_sets)) and len(liked.alt_tag_sets[0]) == 3
    assert liked.alt_titles[0] == "notes" != plain.alt_titles[0]


def test_suggesting_and_applying(spark):
    plan = spark.createDataFrame([("d", ["a"], [["b"]], "New title-", ["other"]), ("e", ["x"], [], "Same", [])], "document_id string, tags array<string>, alt_tag_sets array<array<string>>, suggested_title string, alt_titles array<string>")
    now = spark.createDataFrame([("d", "Old", ["z"]), ("e", "Same", ["x"]), ("f", "F", ["q"])], "document_id string, title string, tags array<string>")
    out, docs, after = organize.suggest(plan, now, spark.createDataFrame([], SUG), "title", 5)
    assert {(r.document_id, r.status, r.pending) for r in out.collect()} == {("d", "Applied", 2), ("e", "AlreadyCurrent", 0)}
    assert {r.document_id: r.title for r in docs.collect()} == {"d": "New title", "e": "Same", "f": "F"} and after.where("kind = 'tags'").count() == 0
    out, docs, _ = organize.suggest(plan, now, spark.createDataFrame([], SUG), "tags", 5)
    assert {r.document_id: r.tags for r in docs.collect()} == {"d": ["a"], "e": ["x"], "f": ["q"]}
    assert {r.document_id: (r.title, r.tags) for r in organize.applied_at_ingest(plan, now).collect()} == {"d": ("New title", ["a"]), "e": ("Same", ["x"]), "f": ("F", ["q"])}


def test_suggestions(spark):
    s = sug(spark, [("1", "d", "tags", ["acme", "invoice"], 0, "applied"), ("2", "d", "tags", ["acme", "finance"], 1, "pending"), ("3", "d", "tags", ["urgent"], 2, "pending"), ("4", "d", "title", "T", 0, "applied")])
    out, f, n = organize.resolve_edit(s, "d", "tags", ["acme", "kept"], 9)
    assert n == 3 and sorted(r.term for r in f.collect()) == ["finance", "invoice", "urgent"]
    assert {r.status for r in out.where("kind = 'title'").collect()} == {"applied"}
    out, f = organize.apply_suggestion(s, "2", 9)
    assert {r.id: r.status for r in out.collect()} == {"1": "dismissed", "2": "applied", "3": "dismissed", "4": "applied"}
    assert sorted((r.term, r.weight) for r in f.collect()) == [("acme", 1.0), ("acme", 2.0), ("finance", 1.0), ("finance", 2.0)]
    out, f = organize.confirm_current(s, spark.createDataFrame([("d",)], "document_id string"), 9)
    assert sorted((r.term, r.action) for r in f.where("kind = 'tags'").collect()) == [("acme", "accepted"), ("finance", "rejected"), ("invoice", "accepted"), ("urgent", "rejected")]
    assert organize.dismiss(s, "3", 9)[1].first().term == "urgent"
    assert organize.pruned(s, 2).count() == 2
    stored = organize.store_suggestions(s, sug(spark, [("2", "d", "tags", ["x"], 0, "applied")]))
    assert {r.id: r.status for r in stored.collect()} == {"1": "applied", "2": "applied", "3": "dismissed", "4": "applied"}


def entry(i, c, at, tags=("t",)):
    return (i, c, at, "p", list(tags), "T", "m", "document", 1, 0)


def test_sync(spark):
    local = spark.createDataFrame([entry("same", "x", 1), entry("c", "hash-a-0", 1000), entry("n", "old", 1000)], MAN)
    remote = spark.createDataFrame([entry("same", "x", 5), entry("c", "hash-b-0", 2000), entry("n", "new", 9000), entry("doc-1", "z", 1)], MAN)
    d = sync.difference(local, remote)
    assert {r.id: r.state for r in d.collect()} == {"same": "agree", "c": "conflict", "n": "conflict", "doc-1": "new"}
    after, links = sync.applied(local, sync.resolved(d, "fork"))
    assert sorted(r.id for r in after.collect()) == ["c", "c.conflict.hash-b-0", "doc-1", "n", "n.conflict.new", "same"]
    assert {(r.parent_id, r.child_id) for r in links.collect()} == {("c", "c.conflict.hash-b-0"), ("n", "n.conflict.new")}
    won = sync.resolved(d, "newest")
    assert {r.id: r.outcome for r in won.collect()} == {"same": "none", "c": "remote_won", "n": "remote_won", "doc-1": "adopted"}
    after, _ = sync.applied(local, won)
    assert {r.id: r.checksum_sha256 for r in after.collect()} == {"same": "x", "c": "hash-b-0", "n": "new", "doc-1": "z"}
    assert sync.resolved(sync.difference(after, remote), "newest").where("outcome <> 'none'").count() == 0
    assert sync.events(won, 1).count() == 3 and sync.wanted_blobs(d).count() == 3


def test_reconciliation(spark):
    docs = spark.createDataFrame([("d1", "document", "Alpha", "text/plain", "d1", {"file_name": "Alpha.txt", "main_path": "keeper"}), ("d2", "document", "Beta", "text/plain", "d2", {"file_name": "Beta.txt"}), ("d3", "document", "Gamma", "text/plain", "d3", None), ("d4", "document", "Delta", "text/plain", "d4", {"file_name": "gone.txt"}), ("f", "folder", "F", None, "f", None)], "id string, kind string, title string, mime_type string, checksum_sha256 string, extra map<string,string>")
    tags = spark.createDataFrame([("d1", "keeper")], "document_id string, tag string")
    tree = spark.createDataFrame([("elsewhere", "Alpha.txt", "d1"), ("", "Beta.txt", "d2"), ("new", "n.txt", "h9"), ("new", "again.txt", "d3")], "rel_dir string, name string, hash string")
    plan = {(r.action, r.id) for r in files.reconciliation(docs, tags, tree).collect()}
    assert plan == {("move", "d1"), ("keep", "d2"), ("backfill", "d3"), ("delete", "d4"), ("ingest", "h9"), ("link", "d3")}
    ok = spark.createDataFrame([("a/b",), ("../x",), ("/abs",), ("a/../b",), ("",)], "d string").select(files.safe_dir("d").alias("s")).collect()
    assert [r.s for r in ok] == [True, False, False, False, True]


def test_assistant(spark):
    content = spark.createDataFrame([("a", "the invoice total is ten"), ("b", "cookies and milk"), ("c", "")], "document_id string, text string")
    refs = assistant.retrieve(content, "invoice total")
    assert [(r.n, r.doc) for r in refs.collect()] == [(1, "a")]
    assert assistant.context(refs).first().context == "[1] (document a) the invoice total is ten"
    assert "ten [1]" in assistant.fallback(refs).first().answer
    assert assistant.fallback(assistant.retrieve(content, "zzz")).first().answer == assistant.NOTHING
    assert assistant.cited(spark.createDataFrame([("see [1] and [2]",)], "text string"), refs).first().text == "see ⟨src a⟩ and [2]"
    history = spark.createDataFrame([(0, "user", "hi")], "turn long, role string, text string")
    assert [r.role for r in assistant.messages(history, refs, "q").orderBy("pos").collect()] == ["system", "user", "user"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("data"))
    lease = "the lease for the upper flat names the landlord, the tenant, the deposit and the boiler that is serviced every year in autumn"
    invoice = "invoice acme payment total due within thirty days of delivery to the account named below in the letter"
    texts = {"a": lease, "b": lease, "c": lease + "!", "e": invoice, "f": "cookie recipe with butter, sugar and flour, baked for ten minutes", "g": "one text that stands entirely alone among lectures on glaciers"}
    spark.createDataFrame([(n * 100 if i in "abg" else n, i, "document", f"title {i}", n) for n, i in enumerate(texts, 1)], "doc_id long, id string, kind string, title string, ingested_at long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, t, "plain") for i, t in texts.items()], schemas.CONTENT).write.parquet(f"{d}/content.parquet")
    spark.createDataFrame([("b", "flat"), ("b", "rent"), ("e", "money")], schemas.DOCUMENT_TAGS).write.parquet(f"{d}/document_tags.parquet")
    spark.createDataFrame([("b", [" rent "])] * 3, "id string, tags array<string>").write.parquet(f"{d}/manifest.parquet")
    return d


def test_plans_of_a_library_have_duplicates_clusters_and_feedback(spark, folder):
    from foliant.plans import workflow

    p = {r.document_id: r for r in workflow.organise_plans(spark, folder).collect()}
    assert {i: r.is_duplicate_of for i, r in p.items()} == {"a": "b", "b": "a", "g": None}
    assert p["a"].tags.startswith("rent|") and "|flat" in p["a"].tags  # without feedback the order is flat, rent
    terms = set(workflow.emergent(workflow.corpus(spark, folder)))
    assert terms and set(p["g"].tags.split("|")) - {"rent", "flat", "money"} <= terms and "lease" not in set(p["g"].tags.split("|")) - terms


def test_copies_under_other_ids_are_near_duplicates(spark, folder):
    from foliant.plans import searching, workflow

    ids = {}
    for r in searching.text_classes(spark, folder).collect():
        ids.setdefault(r["class"], set()).add(r.document_id)
    got = {(r.document_id, m, r.similarity == 1.0, r.others, r.first) for r in searching.near_duplicate_probe(spark, folder).collect() for m in ids[r["class"]] - {r.document_id}}
    assert {x for x in got if x[1] in "ab"} == {("a", "b", True, 1, "b"), ("b", "a", True, 1, "a")}
    assert {x[:2] for x in got} == {("a", "b"), ("b", "a"), ("a", "c"), ("b", "c")}
    assert {r.document_id: (r.related_to, r.similarity) for r in workflow.related_versions(spark, folder).collect()} == {"a": ("b", 1.0), "b": ("a", 1.0)}


def test_plans_without_joins_of_postings(spark, monkeypatch):
    def never(*_):
        raise AssertionError("the corpus' postings were joined")

    monkeypatch.setattr(organize.tfidf, "neighbours", never)
    corpus = spark.createDataFrame([("a", "x", "oak elm fir"), ("b", "y", "oak elm ash"), ("c", "z", "salt pepper")], "id string, title string, text string")
    tags = spark.createDataFrame([("b", "trees"), ("c", "food")], "document_id string, tag string")
    assert organize.plans(corpus, tags, spark.createDataFrame([("a",)], "doc string")).first().tags == ["trees"]
