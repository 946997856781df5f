import math
import random
import subprocess
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliant.functions import hashing as h
from foliant.operators import fts, lsh, vectors

ROWS = [("a", "The quick fox jumps over the sleeping dog"), ("b", "Invoice for office supplies and a printer"), ("c", "A cookie recipe for the office party"), ("n", None), ("e", "")]


def docs(spark, rows=ROWS):
    return spark.createDataFrame(rows, "document_id string, text string")


def found(spark, q):
    return sorted(r.doc for r in fts.match(docs(spark), "document_id", "text", q).collect())


@pytest.mark.parametrize("q,want", [("office", ["b", "c"]), ('"office supplies"', ["b"]), ("office AND invoice", ["b"]), ("office NOT invoice", ["c"]), ("fox OR cookie", ["a", "c"]), ("(fox OR office) party", ["c"]), ("NEAR(invoice supplies, 2)", ["b"]), ("NEAR(invoice supplies, 1)", []), ("", []), ("nothing", []), ("office party NOT cookie OR dog", ["a"])])
def test_query_language(spark, q, want):
    assert found(spark, q) == want


@pytest.mark.parametrize("q", ['"open', "AND", "a AND", "(a", "a )", "a*b"])
def test_wrong_queries(spark, q):
    with pytest.raises(fts.InvalidQuery):
        fts.match(docs(spark), "document_id", "text", q)
    assert fts.unified(docs(spark), spark.createDataFrame([], "document_id string, tag string"), q).count() == 0


def test_scores_and_modes(spark):
    tags = spark.createDataFrame([("b", "finance"), ("b", "x"), ("c", "x")], "document_id string, tag string")
    for mode in ("exact", "semantic", "hybrid"):
        got = fts.unified(docs(spark), tags, "office", mode).collect()
        assert got and all(0 <= r.score <= 1 for r in got)
    assert [r.doc for r in fts.unified(docs(spark), tags, "office", "exact", ["finance", "x"]).collect()] == ["b"]
    exact = spark.createDataFrame([("a", 0.2)], "doc string, score double")
    semantic = spark.createDataFrame([("a", 0.9), ("b", 0.5), ("c", 0.4)], "doc string, score double")
    assert [r.doc for r in fts.merge_stages(exact, semantic, 2).collect()] == ["a", "b"]
    assert {r.doc: r.score for r in fts.merge_best(exact, semantic).collect()}["a"] == 0.9


def test_overlap(spark):
    got = {r.doc: r.score for r in fts.overlap(docs(spark), "document_id", "text", "office Office dog").collect()}
    assert got == pytest.approx({"a": 1 / 3, "b": 2 / 3, "c": 2 / 3})


def test_prompt_first_in_a_session():
    run = "import __spark_entry__ as e\nfrom foliant.session import local_session\nprint(max(r.pos for r in e.queries()['assistant_prompt'](local_session(2, '2g', 2), '/root/testdata/sf0.001').collect()))"
    out = subprocess.run([sys.executable, "-c", run], cwd=Path(__file__).resolve().parents[1], capture_output=True, text=True, timeout=300)
    assert out.returncode == 0 and out.stdout.split()[-1] == "3", out.stderr[-2000:]


def test_snippets_and_spans(spark):
    assert "<b>printer</b>" in fts.snippet(ROWS[1][1], ["printer"])
    assert fts.spans("Ärger mit Office und office", ["office", "ärger"]) == [(0, 6), (11, 17)]
    r = fts.with_highlights(docs(spark).where("document_id = 'b'"), "text", "Supplies AND PRINTER").first()
    assert [(x.start, x.end) for x in r.highlights] == [(19, 27), (34, 41)]


def test_embedding(spark):
    v = {r.id: np.array(r.vector) for r in vectors.embed(docs(spark), "document_id", "text").collect()}
    assert abs(np.linalg.norm(v["a"]) - 1) < 1e-4 and not v["e"].any() and not v["n"].any()
    assert v["b"] @ h.embedded("office supplies invoice") > v["a"] @ h.embedded("office supplies invoice")


def test_nearest_against_brute_force(spark):
    rnd = np.random.default_rng(3)
    m = np.concatenate([rnd.normal(size=(80, 8)), np.zeros((1, 8))])
    m[5] = m[6] = m[7]  # ties
    df = spark.createDataFrame([(i, list(map(float, x))) for i, x in enumerate(m)] + [(999, None)], "i long, v array<double>").repartition(3)
    got = {(r.query, r["rank"]): r.other for r in vectors.nearest(df, df.where("i IN (5, 20, 80)"), "i", "v", 6).collect()}
    n = np.linalg.norm(m, axis=1, keepdims=True)
    u = m / np.where(n == 0, 1, n)
    for q in (5, 20, 80):
        want = sorted((i for i in range(81) if i != q), key=lambda i: (-round(float(u[q] @ u[i]), 9), i))[:6]
        assert [got[q, k] for k in range(1, 7)] == want
    assert vectors.nearest(df, df.limit(0), "i", "v").count() == 0


def test_kmeans(spark):
    rows = [(i, list(map(float, v))) for i, v in enumerate([[1, 1, 0, 0, 0, 0], [1, 0.9, 0.1, 0, 0, 0], [0, 0, 0, 0, 1, 1], [0, 0, 0, 0.1, 1, 0.9]])]
    df = spark.createDataFrame(rows, "i long, v array<double>")
    for parts in (1, 3):
        c = {r.id: r.cluster for r in vectors.kmeans(df.repartition(parts), "i", "v", 2)[0].collect()}
        assert c[0] == c[1] != c[2] == c[3]
    assert vectors.default_k(1) == 2 and vectors.default_k(100) == 10 and vectors.default_k(10_000) == 16
    assert vectors.kmeans(df.limit(0), "i", "v")[0].count() == 0
    assert {r.cluster for r in vectors.kmeans(spark.createDataFrame([(1, [0.0, 0.0])], "i long, v array<double>"), "i", "v")[0].collect()} == {0}


def test_classify(spark):
    got = vectors.classify(docs(spark), "document_id", "text", ["office invoice", "cookie recipe"]).where("rank = 1").collect()
    best = {r.doc: r.label for r in got}
    assert best["b"] == "office invoice" and best["c"] == "cookie recipe"


def slow_fnv(data, seed=0):
    x = h.FNV_BASIS ^ seed
    for b in data:
        x = (x ^ b) * h.FNV_PRIME % 2**64
    return x


def test_hashes_match_plain_arithmetic():
    text = "Größe 12"
    got = h.window_hashes(text, 3, h.FNV_BASIS, h.fold_fnv)
    assert got.tolist() == [slow_fnv(text[i : i + 3].encode()) for i in range(len(text) - 2)]
    sig = h.small_signature(text, 3)
    s = {slow_fnv(text.lower()[i : i + 3].encode()) for i in range(len(text) - 2)}
    assert int(sig[5]) == min(slow_fnv(x.to_bytes(8, "little"), 6) for x in s)


def test_near_duplicates(spark):
    rows = [("a", "The committee met on Tuesday to discuss the annual budget of the library."), ("b", "The committee met on Tuesday to discuss the annual budget of the library. Tea was served."), ("c", "A wholly different sentence about sailing boats in winter."), ("d", "The committee met on Tuesday to discuss the annual budget of the library."), ("e", ""), ("f", None)]
    df = docs(spark, rows)
    members, texts = lsh.classes(df, "document_id", "text")
    sig = lsh.signatures(texts)
    s = {(r.a, r.b): r.similarity for r in lsh.pairs(sig).collect()}
    cls = {r.id: r["class"] for r in members.collect()}
    assert cls["a"] == cls["d"] and s[tuple(sorted((cls["a"], cls["b"])))] > 0.5
    assert not any(cls["c"] in k for k in s)
    dup = {r.id: (r.duplicate_of, r.similarity) for r in lsh.duplicates(df, "document_id", "text").collect()}
    assert dup["a"] == ("d", 1.0) and dup["d"] == ("a", 1.0) and "c" not in dup and "e" not in dup
    asked = sig.where(sig["class"] == cls["b"])
    assert [r["class"] for r in lsh.probe(asked, sig, 0.5).collect()] == [cls["a"]]


def test_agreement_is_an_estimate():
    rnd = random.Random(1)
    a = "".join(rnd.choice("abcdefgh") for _ in range(600))
    b = a[:500] + "".join(rnd.choice("ijklmnop") for _ in range(100))
    x = {a[i : i + 5] for i in range(596)}
    y = {b[i : i + 5] for i in range(596)}
    got = (h.near_signature(a) == h.near_signature(b)).mean()
    assert math.isclose(got, len(x & y) / len(x | y), abs_tol=0.12)


def test_hot_bands_lose_no_pair(spark):
    rnd = random.Random(2)
    base = " ".join(rnd.choice("river table lamp green quick stone paper cloud".split()) for _ in range(80))
    rows = [(str(i), base[: 300 - rnd.randint(0, 40)] + "".join(rnd.choice("xyz ") for _ in range(rnd.randint(0, 30)))) for i in range(40)]
    sig = lsh.signatures(lsh.classes(docs(spark, rows), "document_id", "text")[1], "small")
    for t in (0.6, 0.85):
        a, b = ({(r.a, r.b) for r in lsh.pairs(sig, t, hot).collect()} for hot in (1, 10_000))
        assert a == b and a


def test_candidate_pairs_are_not_moved(spark):
    rnd = random.Random(3)
    base = " ".join(rnd.choice("river table lamp green quick stone paper cloud".split()) for _ in range(60))
    rows = [(str(i), base[: 200 - rnd.randint(0, 120)] + "".join(rnd.choice("xyz ") for _ in range(rnd.randint(0, 90)))) for i in range(60)] + [("blank", " "), ("none", None)]
    texts = lsh.classes(docs(spark, rows), "document_id", "text")[1]
    sig = lsh.signatures(texts)
    kept = [(r["class"], r.sig, r["keys"]) for r in sig.collect()]
    want = {(a, b): sum(map(int.__eq__, s, t)) / len(s) for a, s, k in kept for b, t, m in kept if a < b and any(map(int.__eq__, k, m))}
    assert len(want) > 100 and min(want.values()) < 0.5
    for got in (lsh.pairs(sig.repartition(5)), lsh.candidates(lsh.blocks(texts))):
        assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
        found = [((r.a, r.b), r.similarity) for r in got.collect()]
        assert len(found) == len(want) and dict(found) == want


def test_candidate_pairs_of_a_task_name_few_classes(spark):
    rnd = random.Random(4)
    words = "river table lamp green quick stone paper cloud".split()
    bases = [" ".join(rnd.choice(words) + str(i) for _ in range(30)) for i in range(60)]
    rows = [(str(i), bases[i % 60][: 150 - rnd.randint(0, 60)] + "".join(rnd.choice("xyz ") for _ in range(rnd.randint(0, 40)))) for i in range(1200)]
    texts = lsh.classes(docs(spark, rows), "document_id", "text")[1]
    blocks = lsh.blocks(texts)
    of = {c: i for i, r in enumerate(blocks.orderBy("number").collect()) for c in r["class"]}
    assert len(of) == texts.count() and max(of.values()) > 1 and sorted(of) == sorted(of, key=of.get)
    parts = {}
    for r in lsh.candidates(blocks).withColumn("part", F.spark_partition_id()).collect():
        parts.setdefault(r.part, []).append(r)
    for rs in parts.values():  # what a file's dictionaries hold, and runs in the first column
        assert len({of[r.a] for r in rs}) == len({of[r.b] for r in rs}) == 1
        assert 1 + sum(r.a != s.a for r, s in zip(rs, rs[1:])) == len({r.a for r in rs})
    kept = [(r["class"], set(enumerate(r["keys"]))) for r in lsh.signatures(texts).collect()]
    got = [(r.a, r.b) for rs in parts.values() for r in rs]
    assert len(got) == len(set(got)) > 1000 and set(got) == {(a, b) for a, k in kept for b, m in kept if a < b and k & m}


def test_blocks_of_a_range_are_cut():
    rnd = np.random.default_rng(5)
    n = lsh.BLOCK + 500
    names, sig = [f"{x:064x}" for x in rnd.permutation(n)], rnd.integers(0, 9, (n, 3))
    moved = list(lsh._split(((names[i : i + 1000], sig[i : i + 1000], sig[i : i + 1000, :1]) for i in range(0, n, 1000)), 1))
    got = [(b.column(0)[0].as_py(), lsh._arrays(b, 0, 1)) for b in lsh._merged(iter(moved))]
    assert [i for i, _ in got] == [0, 1] and [len(c) for _, (c, _, _) in got] == [lsh.BLOCK, 500]
    assert [c for _, (cs, _, _) in got for c in cs.to_pylist()] == sorted(names)
    want = dict(zip(names, sig.tolist()))
    assert all(want[c] == s and want[c][:1] == k for _, (cs, ss, ks) in got for c, s, k in zip(cs.to_pylist(), ss.tolist(), ks.tolist()))
