import pytest
from pyspark.sql import functions as F

from foliant.functions import text as fx
from foliant.operators import tfidf


def one(spark, expr, *values):
    df = spark.createDataFrame([values], ", ".join(f"c{i} string" for i in range(len(values))))
    return df.select(expr.alias("x")).first().x


def test_tokens(spark):
    assert one(spark, fx.tokens_ascii("c0"), "The Invoice, a Привет-ÉTÉ 2x") == ["invoice", "Привет", "ÉtÉ", "2x"]
    assert one(spark, fx.tokens("c0"), "The A-Привет") == ["the", "a", "привет"]
    assert one(spark, fx.tokens("c0"), None) == []


@pytest.mark.parametrize("t,want", [("Привет мир", "Cyrillic"), ("Hello 12", "Latin"), ("12 34", "Other"), ("", "Other"), ("αβγ", "Other"), (None, "Other")])
def test_script(spark, t, want):
    assert one(spark, fx.script("c0"), t) == want


def test_names(spark):
    assert one(spark, fx.sanitized("c0"), 'a/b\\c:d*e?f"g<h>i|j') == "a_b_c_d_e_f_g_h_i_j"
    assert one(spark, fx.sanitized("c0"), "") == one(spark, fx.sanitized("c0"), None) == "document"
    assert len(one(spark, fx.sanitized("c0"), "x" * 200)) == 120
    assert one(spark, fx.fs_stem("c0"), "con") == "_con" and one(spark, fx.fs_stem("c0"), "Größe: a//b.") == "Größe_ a_b"
    assert one(spark, fx.stem("c0"), ".hidden") == ".hidden" and one(spark, fx.stem("c0"), "a.b.pdf") == "a.b"
    assert one(spark, fx.extension("c0"), "a.PDF") == "pdf" and one(spark, fx.extension("c0"), "none") == "none"
    assert one(spark, fx.original_extension("c0"), "a.toolongextension") is None
    assert one(spark, fx.file_name("c0", "c1", "c2", "c3"), "Tax 2020", "x.pdf", None, "abcdef0123") == "Tax 2020.pdf"
    assert one(spark, fx.file_name("c0", "c1", "c2", "c3"), "Tax.pdf", None, "application/pdf", "abcdef0123") == "Tax.pdf"
    assert one(spark, fx.file_name("c0", "c1", "c2", "c3"), "", None, None, "abcdef0123") == "document-abcdef01"
    assert one(spark, fx.file_name("c0", "c1", "c2", "c3"), "Tax.PDF", None, "application/pdf", "abcdef0123") == "Tax.pdf"


def test_types(spark):
    assert [one(spark, fx.format_class("c0"), e) for e in ("pdf", "csv", "md", "docx", "ott", "eml", "heic", "xls", "", "zip")] == ["pdf", "plain", "markdown", "docx", "odt", "email", "image", "unsupported", "unknown", "unknown"]
    assert one(spark, fx.mime_for("c0", "c1"), "xyz", "plain") == "text/plain" and one(spark, fx.mime_for("c0", "c1"), "jpg", "none") == "image/jpeg"
    assert one(spark, fx.mime_extension("c0"), "message/rfc822") == "eml"


def test_titles_and_templates(spark):
    df = spark.createDataFrame([(["invoice", "acme corp", "2026", "x"], [], "t", "2024-01-01", "pdf")], "k array<string>, g array<string>, t string, d string, e string")
    r = df.select(fx.rendered_title("k").alias("a"), fx.rendered_title("g").alias("b"), fx.rendered_filename("{keywords}-{date}.{ext}", "k", "g", "t", "d", "e").alias("c")).first()
    assert (r.a, r.b, r.c) == ("Invoice Acme Corp 2026", "document", "invoice-acme corp-2026-2024-01-01.pdf")


def test_text_forms(spark):
    assert one(spark, fx.excerpt("c0"), "  a \n b ") == "a b"
    assert one(spark, fx.preview("c0"), "x" * 2001) == "x" * 2000 + "…" and one(spark, fx.preview("c0"), " ") is None
    assert one(spark, fx.normalized_newlines("c0"), "a  \r\n\n\n\nb\n\n") == "a\n\nb"
    assert one(spark, fx.trailing_separators("c0"), "a-_. ") == "a"
    assert one(spark, fx.relevance(F.lit(float("nan"))), "x") == 0.0 and one(spark, fx.relevance(F.lit(3.0)), "x") == 1.0


def test_term_statistics(spark):
    docs = spark.createDataFrame([("1", "invoice invoice receipt"), ("2", "receipt cookie"), ("3", ""), ("4", None)], "id string, text string")
    tf = tfidf.term_frequencies(docs, "id", "text")
    assert {(r.term, r.tf) for r in tf.where("doc = '1'").collect()} == {("invoice", 2.0), ("receipt", 1.0)}
    idf = {r.term: r.idf for r in tfidf.inverse_frequencies(tf, 4).collect()}
    assert idf["invoice"] > idf["receipt"] > 1
    assert [r.term for r in tfidf.top_terms(tf.withColumnRenamed("tf", "weight"), 2).where("doc = '1'").orderBy("rank").collect()] == ["invoice", "receipt"]
    near = spark.createDataFrame([("q", "a", 0.9), ("q", "b", 0.6)], "doc string, other string, score double")
    votes = {r.tag: round(r.votes, 6) for r in tfidf.tag_votes(near, spark.createDataFrame([("a", "invoice"), ("a", "receipt"), ("b", "receipt")], "document_id string, tag string")).collect()}
    assert votes == {"receipt": 1.5, "invoice": 0.9}


def test_small_forms(spark):
    assert one(spark, fx.safe_base_name("c0", "c1"), "a/b\\c d.pdf_", "7") == "c_d.pdf" and one(spark, fx.safe_base_name("c0", "c1"), None, "7") == "document-7" and one(spark, fx.safe_base_name("c0", "c1"), "/_._", "7") == "document-7"
    assert one(spark, fx.without_marks("c0"), "a <b>b</b> c") == "a b c"
    long = "x" * 100 + " Needle " + "y" * 300
    assert one(spark, fx.centred_snippet("c0", " needle "), long) == "…" + long[31 : 101 + 6 + 170] + "…"
    assert one(spark, fx.centred_snippet("c0", "none"), "short") == "short" and one(spark, fx.centred_snippet("c0", " "), " a  b ") == "a b"
    assert one(spark, fx.words_used("c0"), " two  words ") == 2 and one(spark, fx.words_used("c0"), " ") == one(spark, fx.words_used("c0"), None) == 1

    def fnv(text):
        h = 0x811C9DC5
        raw = text.encode("utf-16-le")
        for i in range(0, len(raw), 2):
            h = ((h ^ int.from_bytes(raw[i : i + 2], "little")) * 0x01000193) & 0xFFFFFFFF
        return h

    assert [one(spark, fx.fnv32("c0"), t) for t in ("", "tax", "größe", "a😀b")] == [fnv(t) for t in ("", "tax", "größe", "a😀b")]
    assert spark.createDataFrame([([1.0, 3.0, 3.0],)], "v array<double>").select(fx.greatest_at("v").alias("x")).first().x == 1


def test_small_vectors():
    from foliant.functions import hashing as h

    assert abs((h.token_vector("tax Tax invoice") ** 2).sum() - 1) < 1e-9 and len(h.token_vector("x")) == 32 and not h.token_vector(" ").any()
    assert (h.trigram_vector("abcabc") == h.trigram_vector("abcab")).all() and h.trigram_vector("ab").any() and not h.trigram_vector("").any()


def test_neighbours_from_texts(spark, monkeypatch):
    import random

    rng = random.Random(4)
    rows = [(f"d{i:02}", " ".join(rng.choices(["oak", "elm", "fir", "ash", "Erle", "7b"], k=rng.randint(0, 9)))) for i in range(60)] + [("n", None), (None, "oak elm")]
    docs = spark.createDataFrame(rows, "id string, text string")
    asked, tagged = ([f"d{i:02}" for i in range(0, 60, 7)] + ["gone"]), [f"d{i:02}" for i in range(0, 60, 2)] * 2
    asked, tagged = (spark.createDataFrame([(x,) for x in ids], "doc string").coalesce(1) for ids in (asked, tagged))
    idf = tfidf.document_frequencies(docs, "text", len(rows)).coalesce(1).cache()
    weights = tfidf.vectors(tfidf.term_frequencies(docs, "id", "text"), idf)
    want = sorted((r.doc, r.rank, r.other, r.score) for r in tfidf.neighbours(weights, asked, tagged, 4).collect())
    monkeypatch.setattr(tfidf, "QUERY_BLOCK", 5)  # two blocks of questions, few rows at a time
    monkeypatch.setattr(tfidf, "CELLS", 60)
    got = sorted((r.doc, r.rank, r.other, r.score) for r in tfidf.near_texts(docs, "id", "text", idf, asked, tagged, 4).collect())
    assert got == want and len(got) > 20
