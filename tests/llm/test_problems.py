"""Operators of the subpackage against brute force, round trips and edge cases."""

import itertools
import os
import random
import re

import numpy as np
import pytest

from foliant.llm import cooccurrence, encodings, languages, leakage, mixture, neardup, scans, survivors
from foliant.llm.words import words

TEXT = "id string, text string"
LONG = "word " * 200_000


def frame(spark, rows, schema=TEXT):
    return spark.createDataFrame(rows, schema)


def sentence(rnd, n):
    return " ".join(rnd.choice("river table lamp green quick stone paper cloud music train winter bottle garden silver window".split()) + str(rnd.randint(0, 40)) for _ in range(n))


# words


def test_words():
    assert words("Ｆｕｌｌ wi­dth, don't STOP_now 3,5") == ["full", "width", "don", "t", "stop", "now", "3", "5"]
    assert words(None) == words("") == []


# near-duplicates


def brute_pairs(rows, k, t):
    sets = [(i, set(zip(*[words(x)[j:] for j in range(k)]))) for i, x in rows if i is not None and x]
    return {(min(a, b), max(a, b)) for (a, x), (b, y) in itertools.combinations(sets, 2) if a != b and x and y and len(x & y) / len(x | y) >= t}


@pytest.mark.parametrize("hot", [500, 1])
def test_near_duplicates(spark, hot):
    rnd = random.Random(1)
    rows = []
    for i in range(25):
        base = sentence(rnd, 60).split()
        for j in range(4):
            w = list(base)
            for _ in range(rnd.randint(0, 6)):
                w[rnd.randrange(len(w))] = "edit" + str(rnd.randint(0, 999))
            rows.append((f"d{i}-{j}", " ".join(w)))
    rows += [("x", None), (None, "a b c d e f"), ("short", "a b"), ("empty", ""), rows[0], ("copy", rows[0][1]), ("long", LONG)]
    members, links = neardup.near_duplicates(frame(spark, rows).selectExpr('*', 'id AS fp', '1 AS c', '2 AS key'), "id", "text", 4, 0.6, hot=hot)
    got = {(r.a, r.b) for r in neardup.record_pairs(members, links).collect()}
    assert got == brute_pairs(set(rows), 4, 0.6)
    groups = {r.id: (r.class_id, r.group_id, r.links) for r in neardup.record_groups(members, links).collect()}
    assert groups["copy"][0] == groups["d0-0"][0] and "short" not in groups


def test_near_duplicates_empty(spark):
    members, links = neardup.near_duplicates(frame(spark, []), "id", "text")
    assert members.count() == links.count() == neardup.record_groups(members, links).count() == 0


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.01"), reason="no test tables")
def test_near_duplicates_recall(spark):
    """Every pair that brute force finds in the test table, and the compact form multiplied out is the same."""
    d = "/root/testdata/sf0.01"
    rows = {(r.document_id, r.text) for r in spark.read.parquet(f"{d}/content.parquet").collect()}
    want = brute_pairs(rows, 4, 0.6)
    assert {(r.a, r.b) for r in neardup.p3_found(spark, d).collect()} == want and len(want) > 50
    groups = {r.document_id: r.class_id for r in neardup.p3_groups(spark, d).collect()}
    ids = {}
    for i, c in groups.items():
        ids.setdefault(c, []).append(i)
    out = {(min(p), max(p)) for x in ids.values() for p in itertools.combinations(x, 2)}
    out |= {(min(x, y), max(x, y)) for r in neardup.p3_links(spark, d).collect() for x in ids[r.class_a] for y in ids[r.class_b]}
    assert out == want


def test_hot_key_is_parted(spark):
    rows = spark.range(300).selectExpr("'k' AS key", "300L AS n", "id AS c", "1 AS m")
    got = neardup.paired(rows, ["key"], "n", 40).select("x.c", "y.c").collect()
    assert len(got) == len(set(map(tuple, got))) == 300 * 299 // 2


def test_minhash_estimates_jaccard():
    rnd = np.random.default_rng(0)
    a = rnd.integers(0, 2**63, 300).astype(np.uint64)
    b = np.concatenate([a[:200], rnd.integers(0, 2**63, 100).astype(np.uint64)])
    s = neardup.signatures([a, b], 2000)
    assert abs((s[0] == s[1]).mean() - 0.5) < 0.05


# evaluation texts


def brute_leaks(docs, items, window=13):
    out = set()
    for d, t in docs:
        w = words(t)
        for i, x in items:
            q = words(x)
            n = min(window, len(q))
            if n and any(w[s : s + n] == q[o : o + n] for s in range(len(w) - n + 1) for o in range(len(q) - n + 1)):
                out.add((d, i))
    return out


def test_leakage(spark):
    rnd = random.Random(2)
    items = [(i, sentence(rnd, rnd.choice([2, 4, 9, 13, 30]))) for i in range(20)] + [(90, ""), (91, None), (92, "...")]
    docs = []
    for d in range(60):
        t = sentence(rnd, 50)
        i, x = rnd.choice(items[:20])
        w = x.split()
        n = rnd.choice([5, 12, 13, 20])
        docs.append((d, f"{t} {' '.join(w[:n]).upper() if d % 2 else ' '.join(w[-n:])}, {t}"))
    docs += [(100, None), (101, ""), docs[0], (102, LONG)]
    d = frame(spark, docs, "doc_id long, text string").selectExpr("*", "1 AS item_id", "'x' AS d")
    got = {(r.doc_id, r.item_id) for r in leakage.contained(d, frame(spark, items, "item_id long, text string")).collect()}
    assert got == brute_leaks(set(docs), items)
    assert leakage.contained(d, frame(spark, [], "item_id long, text string")).count() == 0
    assert leakage.contained(d.limit(0), frame(spark, items, "item_id long, text string")).count() == 0


def test_leakage_in_blocks(spark, monkeypatch):
    rnd = random.Random(3)
    items = [(i, sentence(rnd, 15)) for i in range(10)]
    docs = [(i, sentence(rnd, 5) + " " + x) for i, x in items]
    monkeypatch.setattr(leakage, "ITEM_WORDS", 20)
    got = leakage.contained(frame(spark, docs, "doc_id long, text string"), frame(spark, items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in got.collect()} == {(i, i) for i, _ in items}


# pairs of items


def test_product_matches_counting():
    rnd = random.Random(4)
    baskets = {b: set(rnd.sample(range(400), rnd.choice([1, 3, 8, 150]))) for b in range(60)}
    flat = [(b, i) for b, s in baskets.items() for i in s]
    a, b, n = cooccurrence.product(np.array([x for x, _ in flat]), np.array([y for _, y in flat]))
    want = {}
    for s in baskets.values():
        for p in itertools.combinations(sorted(s), 2):
            want[p] = want.get(p, 0) + 1
    assert dict(zip(zip(a.tolist(), b.tolist()), n.tolist())) == want


def test_pair_counts(spark):
    rows = [("1", "a"), ("1", "b"), ("1", "b"), ("2", "a"), ("2", "b"), ("2", None), (None, "a"), ("3", "c")]
    pairs, n = cooccurrence.pair_counts(frame(spark, rows, "item_a string, tag string"), "item_a", "tag")
    assert n == 3 and [tuple(r) for r in pairs.collect()] == [("a", "b", 2, 2, 2)]
    assert cooccurrence.pair_counts(frame(spark, [], "b string, i string"), "b", "i")[0].count() == 0
    assert cooccurrence.above_chance(pairs, n, 1).first().lift == pytest.approx(1.5)


def test_pair_counts_of_a_huge_basket(spark, monkeypatch):
    """One basket with a third of all entries is parted into tiles; the counts are those of counting."""
    monkeypatch.setattr(cooccurrence, "HUGE_ROW", 16)
    rnd = random.Random(13)
    rows = {(b, f"i{rnd.randint(0, 60):02d}") for b in range(30) for _ in range(4)} | {(99, f"i{i:02d}") for i in range(60)} | {(98, f"i{i:02d}") for i in range(0, 60, 3)}
    pairs, n = cooccurrence.pair_counts(frame(spark, sorted(rows), "basket long, item string"), "basket", "item")
    want = {}
    for b in {b for b, _ in rows}:
        for p in itertools.combinations(sorted(i for x, i in rows if x == b), 2):
            want[p] = want.get(p, 0) + 1
    assert n == 32 and {(r.item_a, r.item_b): r.n_ab for r in pairs.collect()} == want


# survivors


def test_survivors_layers(spark):
    from pyspark.sql import functions as F

    rows = [("g", 1, "t1", None, 10), ("g", 2, None, "c2", 20), ("g", 3, "t3", "c3", 5), ("g", 4, None, None, 30), ("h", 5, None, None, None), (None, 6, "n", None, 1)]
    df = frame(spark, rows, "grp string, n long, title string, check string, at long").withColumn("ident", F.lit(0))
    s = survivors.survivors(df, "grp", "n", {"title": F.col("title").isNotNull(), "check": F.col("check").isNotNull()}, F.lit(True), F.col("at"))
    got = {r.grp: r for r in s.collect()}
    assert (got["g"].title, got["g"].title_from, got["g"].check, got["g"].check_from, got["g"].n) == ("t1", 1, "c2", 2, 4)
    assert got["h"].title is None and got["h"].title_from is None and got[None].title == "n"
    assert survivors.survivors(df.limit(0), "grp", "n", {"title": F.col("title").isNotNull()}, F.lit(True), F.col("at")).count() == 0


def test_survivors_from_deeper_layers(spark):
    """A later and fuller record puts the only giver of a field into layer 2, one more below it into layer 3."""
    from pyspark.sql import functions as F

    rows = [("g", 1, "a", "b", None, None, 9), ("g", 2, None, None, "c", None, 5), ("g", 3, None, None, None, "d", 4), ("h", 4, "x", None, None, None, 1), ("h", 5, None, "y", "z", None, 1)]
    df = frame(spark, rows, "g string, i long, a string, b string, c string, d string, at long")
    s = survivors.survivors(df, "g", "i", {f: F.col(f).isNotNull() for f in "abcd"}, F.lit(True), F.col("at"))
    got = {r.grp: r for r in s.collect()}
    assert [(got["g"][f"{f}_from"], got["g"][f"{f}_layer"], got["g"][f]) for f in "abcd"] == [(1, 1, "a"), (1, 1, "b"), (2, 2, "c"), (3, 3, "d")]
    assert [(got["h"][f"{f}_from"], got["h"][f"{f}_layer"]) for f in "abcd"] == [(4, 1), (5, 1), (5, 1), (None, None)]


def test_survivors_order(spark):
    """A random table against sorting: trusted first, then the later time, then the greater tie, then the smaller id."""
    from pyspark.sql import functions as F

    rnd = random.Random(5)
    rows = [(f"g{rnd.randint(0, 5)}", i, rnd.choice([None, f"t{i}"]), rnd.random() < 0.5, rnd.choice([None, 1, 2, 3]), rnd.choice(["a", "b"])) for i in range(200)]
    df = frame(spark, rows, "g string, i long, title string, ok boolean, at long, tie string")
    got = {r.grp: r.title_from for r in survivors.survivors(df, "g", "i", {"title": F.col("title").isNotNull()}, F.col("ok"), F.col("at"), [F.col("tie")]).collect()}
    for g in {r[0] for r in rows}:
        best = max((r for r in rows if r[0] == g and r[2]), key=lambda r: (r[3], -1 if r[4] is None else r[4], r[5], -r[1]))
        assert got[g] == best[1]


# languages


LINES = {
    "en": "the committee of the town has decided that the new bridge will not be built before the end of the year because there is no money for it",
    "de": "der ausschuss der stadt hat beschlossen dass die neue brücke nicht vor dem ende des jahres gebaut wird weil es dafür kein geld gibt",
    "fr": "le comité de la ville a décidé que le nouveau pont ne sera pas construit avant la fin de cette année parce qu'il n'y a pas d'argent pour cela",
}


def detector():
    rnd = random.Random(6)
    rows = []
    for lang, line in LINES.items():
        for _ in range(30):
            w = line.split()
            rnd.shuffle(w)
            rows.append((lang, " ".join(w * 3)))
    rows += [("en", LINES["de"] * 3)]  # a wrong label
    return languages.Detector(languages.train(rows))


def test_languages(spark):
    text = f"{LINES['en']}\n\n{LINES['fr']}\n \nOsko 7\n\nFrom: a\nTo: b"
    rows = [("1", text), ("1", text), ("2", LINES["de"]), ("3", None), ("4", ""), ("5", "12 / 7"), ("6", LINES["de"] + " " + LONG[:50])]
    got = {(r.id, r.para_no): r.lang for r in languages.detect(frame(spark, rows).selectExpr("*", "'x' AS lang", "1 AS para_no"), "id", "text", detector()).collect()}
    assert got == {("1", 0): "en", ("1", 2): "fr", ("2", 0): "de", ("6", 0): "de"}
    assert languages.detect(frame(spark, []), "id", "text", detector()).count() == 0


def test_unknown_language_and_confidence():
    det = detector()
    unknown, mixed = "ez a szöveg magyarul íródott és egyik ismert nyelvhez sem tartozik mert a magyar egészen más nyelv", "\n\n".join([LINES["en"]] * 3 + [LINES["fr"]])
    (a, b) = det.documents([unknown, mixed])
    assert a == (-1, []) and det.documents([None, "", "12"]) == [(-1, [])] * 3
    assert languages.LANGUAGES[b[0]] == "en" and abs(b[1][0][2] - 0.74) < 0.06 and [languages.LANGUAGES[l] for _, l, _ in b[1][1:]] == ["fr"]


def test_many_short_paragraphs(monkeypatch):
    """Counts are the same whether paragraphs are counted together or a few at a time."""
    f = detector().filter
    texts = [" a ", " the bridge ", "", " stadt brücke "] * 50
    whole = f.counts(texts)
    monkeypatch.setattr(languages, "TEXTS", 7)
    part = f.counts(texts)
    assert (whole[0] == part[0]).all() and np.allclose(whole[1], part[1])


def test_rare_language_is_learned(spark):
    rows = [(f"e{i}", "EN-us", LINES["en"] * 3 + str(i)) for i in range(400)] + [(f"f{i}", "fr", LINES["fr"] * 3 + str(i)) for i in range(8)] + [("x", None, "y"), ("z", "??", None)]
    det = languages.detector_for(frame(spark, rows, "id string, lang string, text string"), "id", "lang", "text", 90)
    assert languages.LANGUAGES[det.documents([LINES["fr"]])[0][0]] == "fr"


def test_mask_filter():
    f = languages.MaskFilter(3)
    h = np.arange(1, 3000, dtype=np.uint64)
    f.add(h, (1 << (h % 3).astype(int)))
    assert ((f.languages_of(h) >> (h % 3).astype(np.uint32)) & 1).all() and f.false_rates().max() < 0.01


def test_long_text_language(spark):
    assert languages.detect(frame(spark, [("1", LINES["de"] + " " + LINES["de"] * 20_000)]), "id", "text", detector()).first().lang == "de"


# encodings


CLEAN = ["Der Prüfer schätzt die Größe der Bücher für die Küche über Straßen und Brücken", "L'équipe a reçu le reçu impayé après la réunion d'été à côté du café", "El señor Muñoz compró el jamón de la región según el año próximo", "Земля и небо были тихими перед рассветом когда мы вышли"]


def judge():
    rnd = random.Random(7)
    texts = []
    for i in range(400):
        w = CLEAN[i % 4].split()
        rnd.shuffle(w)
        texts.append(" ".join(w))
    return encodings.train(texts)


@pytest.mark.parametrize("right,wrong", [("utf-8", "cp1252"), ("utf-8", "cp850"), ("utf-8", "mac-roman"), ("cp1251", "cp1252"), ("koi8-r", "cp1251")])
def test_encoding_round_trip(right, wrong):
    j = judge()
    for t in CLEAN:
        try:
            bad = t.encode(right).decode(wrong)
        except (UnicodeEncodeError, UnicodeDecodeError):
            continue
        found, _, back = j.verdict(bad)
        assert found and back == t


def test_clean_and_lost_texts(spark):
    j = judge()
    assert not any(j.verdict(t)[0] for t in CLEAN + ["", None, "plain text", "Ｗｉｄｅ Brücken"])
    assert j.verdict("Br�cken für")[0] and j.verdict("Br�cken für")[2] is None
    rows = [(i, CLEAN[i % 4]) for i in range(200)] + [(900, CLEAN[0].encode().decode("cp1252")), (900, CLEAN[0].encode().decode("cp1252")), (901, None), (902, ""), (903, "ü" * 100_000)]
    df = frame(spark, rows, "id long, text string").selectExpr("*", "1 AS chain", "'x' AS _h")
    assert 900 in {r.id for r in encodings.garbled(df, "id", "text").collect()}
    assert encodings.garbled(df.limit(0), "id", "text").count() == 0


def test_bounds_are_validated():
    """Margins lie between what clean held-out texts gain and what garbled tokens do; the rates are noted."""
    j = judge()
    assert j.rates["utf-8 missed"] < 0.05 and j.rates["utf-8 false"] == 0 and j.rates["lost false"] <= 0.01
    assert 0 < j.margins[0] < 40 and 0 < j.margins[1] and j.plain < 0 < j.lost
    gains = encodings.np.array([0.0] * 990 + [float(i % 7) for i in range(10)])
    assert encodings.rare_above(gains, 1e-3) > encodings.rare_above(gains, 1e-2) >= 0 == encodings.rare_above(gains[:0], 1e-3)


def test_garbled_part_of_a_long_text():
    rnd = random.Random(4)
    words_ = ["größe", "schön", "über", "prüfen", "für", "möglich", "zurück", "läuft"]
    clean = [" ".join(rnd.choice(words_) for _ in range(60)) for _ in range(200)]
    judge = encodings.train(clean)
    lost = " ".join(w.encode("utf-8").decode("gbk", "ignore") for w in words_)
    assert not judge.verdict(" ".join(clean))[0]
    assert judge.verdict(" ".join(clean[:100] + [lost] + clean[100:]))[0]
    assert all(f"utf-8 as {e}, lower-cased" in encodings.chains() for e in encodings.SINGLE)


# scanned pages


def test_scanned_page():
    body = ["The accountant checked the quarterly invoice and the reading group returned the long-term loan offer to the office before the end of the month."] * 6
    r = scans.Reader(scans.learn(["\n".join(body)] * 40), {w: 500 for w in re.findall(r"[a-z-]+", body[0].lower())} | {"quarterly": 500})
    page = "Lecture notes Osko 2020\nThe accountant checked the quar-\nterly invoice and tbe reading group\nreturned without any delay the long-\nterm loan offer to the office before\n— 12 —\n\nLecture notes Osko 2020\nthe end of the month. The accountant\nchecked the invoice and the office.\n— 13 —"
    cases, paras = r.read(page)
    got = set(cases)
    assert {(1, "furniture"), (6, "furniture"), (8, "furniture"), (11, "furniture"), (2, "hyphen"), (3, "glyph")} <= got
    assert (4, "hyphen") not in got and not any(k == "furniture" and n in (2, 3, 4, 5, 9, 10) for n, k in got)
    assert paras[0].startswith("The accountant checked the quarterly invoice and the reading group returned without any delay the long-term loan offer to the office before the end")


@pytest.mark.parametrize("change", [lambda p: p.replace("without any delay the", "without any delay the   " + "x " * 40), lambda p: p.replace("\nreturned", "\n> returned"), lambda p: "To: the office\n" + p, lambda p: p.replace("— 13 —", " " * 80 + "— 13 —")])
def test_scanned_page_of_any_width_and_beginning(change):
    body = ["The accountant checked the quarterly invoice and the reading group returned the long-term loan offer to the office before the end of the month."] * 6
    r = scans.Reader(scans.learn(["\n".join(body)] * 40), {w: 500 for w in re.findall(r"[a-z-]+", body[0].lower())})
    page = change("Lecture notes Osko 2020\nThe accountant checked the quar-\nterly invoice and tbe reading group\nreturned without any delay the long-\nterm loan offer to the office before\n— 12 —\n\nLecture notes Osko 2020\nthe end of the month. The accountant\nchecked the invoice and the office.\n— 13 —")
    at = page.split("\n").index("The accountant checked the quar-") + 1
    got = set(r.read(page)[0])
    assert {(at, "hyphen"), (at + 1, "glyph"), (at + 4, "furniture")} <= got
    assert r.read("The accountant checked tbe quarterly invoice and tbe reading qroup before fhe end of tbe month.".replace("qroup", "gr0up"))[0] == [(1, "glyph")]
    assert r.read("\n".join(body) + "\n> quoted")[0] == r.read("From: Osko\n" + "\n".join(body))[0] == []


def test_rare_words_keep_their_count(spark):
    """A floor above a real word's count doesn't make it a misread one, nor a compound a broken word."""
    rows = [(str(i), "the tree stands near the house") for i in range(60)] + [(f"r{i}", "a free house") for i in range(20)]
    rows += [(f"c{i}", "a well-kept house") for i in range(5)] + [("p", "the house is well-\nkept now")]
    r = scans.reader_for(frame(spark, rows), "id", "text", share=30 / 550)
    assert "free" not in r.lexicon and r.count("free") == 20 and r.count("well-kept") == 5
    assert scans.Reader(r.labeller, {"tree": 60}).correct("free") == "tree" and r.correct("free") is None
    assert not r.broken("well", "kept", scans.Counter())


def test_scans_edges(spark):
    rows = [("1", None), ("2", ""), (None, "x"), ("3", LONG), ("4", "one line"), ("4", "one line")]
    df = frame(spark, rows).selectExpr("*", "1 AS line_no", "'x' AS t")
    assert scans.line_cases(df, "id", "text").count() == 0
    assert {(r.id, r.para_no) for r in scans.repaired(df, "id", "text").collect()} == {("3", 1), ("4", 1)}
    assert scans.line_cases(df.limit(0), "id", "text").count() == 0


def test_held_out_lines():
    """Lines of made pages that weren't trained on."""
    rnd = random.Random(9)
    texts = ["\n".join(" ".join(sentence(rnd, 1) for _ in range(40)).capitalize() + "." for _ in range(4)) for _ in range(60)]
    m = scans.learn(texts[:40])
    right = total = 0
    for t in texts[40:]:
        lines, gold = scans.made_page(t.split("\n"), ["Report Ostara 2019", "Minutes Belko 2021"], rnd)
        got = m(lines)
        right += sum(g == y for g, y in zip(got, gold))
        total += len(gold)
    assert right / total > 0.95


def test_paragraphs_without_blank_lines():
    """A paragraph that begins with an indentation is told from one that goes on."""
    rnd = random.Random(9)
    texts = ["\n".join(" ".join(sentence(rnd, 1) for _ in range(40)).capitalize() + "." for _ in range(4)) for _ in range(60)]
    m = scans.learn(texts)
    lines = ["    The first paragraph begins here and goes", "on for a line that fills it, then it", "ends.", "    The second one begins without a blank", "line before it, and goes on a while more."]
    assert m(lines) == [scans.BREAK, scans.BODY, scans.BODY, scans.BREAK, scans.BODY]


def test_chain_gradient():
    """The likelihood's gradient against differences, by way of a model that must not get worse where it is trained."""
    pages = [([["a"], ["b"], ["b"]], [2, 0, 0]), ([["a"], ["c"], ["b"], ["a"]], [2, 1, 0, 2]), ([["b"]], [0])] * 5
    m = scans.chain(pages, 0.01)
    assert all(m.decode(f) == y for f, y in pages) and m.decode([]) == []
    seen = []

    def bowl(x):
        seen.append(x)
        return float(((x - 3) ** 2).sum()), 2 * (x - 3)

    assert np.allclose(scans.minimum(bowl, np.zeros(4)), 3, atol=1e-2)


def test_pages_by_source(spark):
    """What a page is is learned from its source; a sample that is drawn twice, in other partitions, is the same."""
    rnd = random.Random(12)
    wide = [(f"w{i}", sentence(rnd, 60), "plain") for i in range(60)]
    narrow = [(f"n{i}", "\n".join(sentence(rnd, 5) for _ in range(12)), " OCR ") for i in range(60)]
    df = frame(spark, wide + narrow, "id string, text string, source string")
    one, two = (scans.reader_for(x, "id", "text", "source") for x in (df.repartition(3), df.repartition(11)))
    assert one.pages.w == two.pages.w and (one.labeller.own == two.labeller.own).all()
    assert one.pages.by_layout(narrow[0][1].split("\n")) and not one.pages.by_layout([wide[0][1]])


def test_page_model_counts_all_texts(spark):
    """More texts than a sample would have: the regression is the one of every text's layout."""
    rnd = random.Random(13)
    texts = [(f"t{i}", "\n".join(sentence(rnd, 2 + i % 4) for _ in range(1 + i % 5)), ["plain", "ocr"][rnd.random() < (0.8 if i % 5 else 0.1)]) for i in range(9000)]
    n = scans.Counter((tuple(scans.Pages.layout(t.split("\n"))), s == "ocr") for _, t, s in texts)
    reader = scans.reader_for(frame(spark, texts, "id string, text string, source string"), "id", "text", "source")
    assert reader.pages.w == scans.Pages.learn(sorted((list(f), s, c) for (f, s), c in n.items())).w


def test_labeller_learns_from_all_texts(spark, monkeypatch):
    """The weights are those of least loss over the pages of every clean text, in whatever partitions they come."""
    monkeypatch.setattr(scans, "BEGIN", 100, raising=False)
    rnd = random.Random(14)
    df = frame(spark, [(f"t{i}", "\n".join(sentence(rnd, 22).capitalize() + "." for _ in range(2))) for i in range(400)])
    one, two = (scans.reader_for(x, "id", "text").labeller for x in (df.repartition(3), df.repartition(11)))
    assert one.names == two.names and (one.own == two.own).all() and (one.pairs == two.pairs).all()
    block = scans.Block()
    for r in df.selectExpr("text", "pmod(xxhash64(id, text), 1L << 40) AS drawn").collect():
        for page in scans.training_pages([r.text], random.Random(r.drawn)):
            block.add(*page)
    assert sorted(block.packed().names) == sorted(one.names)
    loss = scans.loss_of(lambda w: scans.total_sums([block], one.names, w), 0.3)
    w = scans.np.concatenate([one.own.ravel(), one.pairs.ravel()])
    assert loss(w)[0] < 1.001 * loss(scans.minimum(loss, w))[0]


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.01"), reason="no test tables")
def test_search_for_weights_takes_few_passes(spark, monkeypatch):
    """The pages of all texts are read a few times, and those of few texts not once for each weight."""
    monkeypatch.setattr(scans, "BEGIN", 40)
    passes, loss_of = [], scans.loss_of

    def counted(*args):
        passes.append(0)
        loss = loss_of(*args)

        def count(w):
            passes[-1] += 1
            return loss(w)

        return count

    monkeypatch.setattr(scans, "loss_of", counted)
    content = spark.read.parquet("/root/testdata/sf0.01/content.parquet").where("document_id IS NOT NULL AND text IS NOT NULL")
    scans.learn_all(content, "document_id", "text")
    assert 1 < passes[-1] <= 25 and sum(passes) < 200


def test_products_of_gradients():
    """Those of all pages in a block against those of each page by itself."""
    rnd, blocks, every = random.Random(17), [], scans.Block()
    for _ in range(40):
        page = [([rnd.choice("abcd"), rnd.choice("xyz")], rnd.randrange(3)) for _ in range(rnd.randint(1, 6))]
        blocks.append(scans.Block())
        for b in (blocks[-1], every):
            b.add([f for f, _ in page], [y for _, y in page])
    names, w = {x: i for i, x in enumerate("abcdxyz")}, scans.np.array([rnd.gauss(0, 1) for _ in range(30)])
    each = scans.np.array([scans.total_sums([b.packed()], names, w)[1:] / scans.UNIT for b in blocks])
    assert scans.np.allclose(scans.products_of([every.packed()], names, w), each.T @ each, atol=0.05)


def test_features_of_many_pages_at_once():
    """They are those of each page by itself, whatever its lines are."""
    rnd = random.Random(18)
    odd = ["", "  x", "\f", "\fPage 3", "Ⅷ 12", "ſs K", "\x1c a\x1c b", "𝒜𝒷 12", "\ud800x", "12", "— 12 —", " \t12,50", "ÀÉÎÕ", "ǅa", "A", "ﬁx  1999 2", "SCAN_00123", "\xa0b c\xa0", " ", "x_(123)", "Amt   1200", "iv", "Kelvin K", "K k"]
    pages = [[rnd.choice(odd) for _ in range(rnd.randint(0, 9))] for _ in range(2000)] + [[], [""]]
    text = "\n".join(" ".join(sentence(rnd, 1) for _ in range(40)).capitalize() + rnd.choice([".", " 1998", " 3,50"]) for _ in range(4))
    pages += [lines for lines, _ in scans.made_pages([text], 40, rnd)]
    for some in (pages, pages[:1], [[]], [["a"]]):
        sets, at, filled = scans.feature_sets(some)
        want = [f for lines in some for f in scans.features(lines)]
        assert [bool(f) for f in want] == filled.tolist()
        assert [list(sets[k]) for k in at] == [f for f in want if f]
    one, two = scans.Block(), scans.Block()
    made = scans.made_pages([text], 4, random.Random(19))
    one.add_all(made)
    for feats, gold in scans.training_pages([text], random.Random(19)):
        two.add(feats, gold)
    tell = lambda b: [([list(b.sets)[k] for k in ids], y.tolist()) for ids, y in b.pages]
    assert tell(one) == tell(two) and one.lines == two.lines


def test_encoding_model_counts_all_records(spark):
    """More records than a sample would have: every one that isn't held out is counted, in whatever parts they come."""
    words = ["Straße", "Übung", "café", "naïve", "Žižek", "größer"]
    texts = [f"{words[i % 6]} und {words[(i // 6) % 6]} {i}" for i in range(9000)]
    df = frame(spark, list(enumerate(texts)), "id long, text string")
    one, two = (encodings.judge_for(x, "id", "text") for x in (df, df.where("id % 2 = 1").unionAll(df.where("id % 2 = 0"))))
    want = sum(r.text.count("Straße") for r in df.where("pmod(xxhash64(id, text), 1L << 40) % 5 > 0").collect())
    assert round(one.model.three["raß"]) == want > 2000
    assert one.model.three == two.model.three and one.margins == two.margins and one.lost == two.lost and one.plain == two.plain
    x = (1.5, {"utf-8 as cp1252": 2.5, "cp1251 as cp1252": 0.25})
    one.token("é")
    assert encodings.unpacked(one, encodings.packed(one, x)) == x


def test_chains_that_agree_are_tried_once(monkeypatch):
    """Scores and changes of tokens are those of every chain by itself; no text is scored twice for a token."""
    words = ["Straße", "Übung", "naïve", "Žižek", "größer", "ÃŸÃ¼", "Ð¿Ñ€Ð¸", "ñandú\xa0é", "при"] + [w.encode("utf-8").decode("cp850") for w in ("Straße", "größer")]
    judge = encodings.Judge(encodings.Trigrams(encodings.Counter({"Straße": 9, "größer": 5, "при": 7})), plain=0.0)
    scored, score = [], encodings.Trigrams.score
    monkeypatch.setattr(encodings.Trigrams, "score", lambda self, t: scored.append(t) or score(self, t))
    calls, others = [], encodings.reread("cp1252", "cp1251")
    for w in words:
        scored.clear()
        got = judge.token(w)[1]
        assert len(scored) == len(set(scored))
        results = {n: c(w) for n, c in judge.chains.items()}
        own = score(judge.model, encodings.folded(w))
        assert got == {n: g for n, r in results.items() if r != w and (g := score(judge.model, r) - own) > 0}
        done = [judge.family(n) for n, r in results.items() if r != w]
        assert encodings.changes(judge, w) == (done.count(0), done.count(1))
        monkeypatch.setattr(encodings, "_bytes_of", lambda e: calls.append(e))  # tables are made once, not for every token
    assert not calls and others("é") != "é" and len(encodings.rereadings("é")) < sum(map(len, encodings.rereadings("é").values()))


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.01"), reason="no test tables")
def test_planted_pages_are_repaired(spark):
    """Pages made of clean texts of the test table, with paragraphs as they were before."""
    content = spark.read.parquet("/root/testdata/sf0.01/content.parquet")
    clean = [(r.document_id, "\n".join(scans.prose(r.text))) for r in content.where("text RLIKE '(?m)^[^\\n]{120,}$'").orderBy("document_id").limit(60).collect()]
    rnd, pages = random.Random(15), []
    for i, t in clean:
        if t:
            lines, _ = scans.made_page(t.split("\n"), ["Report Ostara 2019", "Minutes Belko Tarn 2021"], rnd)
            pages.append((f"made-{i}", "\n".join(lines), "ocr"))
    every = content.select("document_id", "text", "source").unionAll(frame(spark, pages, "document_id string, text string, source string"))
    got = {}
    for r in scans.repaired(every, "document_id", "text", "source").where("id LIKE 'made-%'").orderBy("id", "para_no").collect():
        got.setdefault(r.id, []).append(r.text)
    squeezed = lambda t: " ".join(t.split())
    words_ = [(set(squeezed(t).split()), set(" ".join(got[f"made-{i}"]).split())) for i, t in clean if f"made-{i}" in got]
    assert len(words_) >= 0.95 * len(pages)
    assert sum(len(a & b) for a, b in words_) > 0.97 * sum(len(a) for a, _ in words_)
    whole = sum(squeezed(p) in got.get(f"made-{i}", []) for i, t in clean for p in t.split("\n"))
    assert whole > 0.6 * sum(len(t.split("\n")) for _, t in clean)


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.01"), reason="no test tables")
def test_planted_garbling_is_restored(spark):
    """Clean texts of the test table, garbled whole in known ways: found, and restored to what they were."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("text IS NOT NULL").select("doc_id", "text")
    bad = {r.id for r in encodings.garbled(docs, "doc_id", "text").collect()}
    plain = [r for r in docs.orderBy("doc_id").collect() if r.doc_id not in bad and len(re.findall(r"[^\x00-\x7f]", r.text)) > 20][:90]
    planted, want = [], {}
    for n, r in enumerate(plain):
        try:
            right, wrong = [("utf-8", "cp1252"), ("utf-8", "cp850"), ("utf-8", "mac-roman")][n % 3]
            planted.append((10**9 + r.doc_id, r.text.encode(right).decode(wrong)))
            want[10**9 + r.doc_id] = r.text
        except UnicodeError:
            pass
    got = {r.id: r.restored for r in encodings.garbled(docs.unionAll(frame(spark, planted, "doc_id long, text string")), "doc_id", "text").collect()}
    assert want.keys() <= got.keys() and len(want) > 30
    assert sum(got[i] == t for i, t in want.items()) > 0.9 * len(want)


# mixture


def test_mixture(spark):
    rnd = random.Random(10)
    rows = [(f"{s}{i}", s, rnd.randint(1, 20)) for s, n in (("a", 2000), ("b", 300), ("c", 5)) for i in range(n)] + [("n", None, 5), ("z", "a", 0), ("u", "untargeted", 9)]
    df = frame(spark, rows, "id string, source string, tokens long").selectExpr("*", "1 AS h", "2 AS prefix", "3 AS repeats")
    goal = frame(spark, [("a", 0.5, 1), ("b", 0.3, 4), ("c", 0.1, 3), ("gone", 0.1, 2)], "source string, target_share double, max_repeats int")
    chosen, shares = mixture.mixture(df, goal)
    s = {r.source: r for r in shares.collect()}
    assert s["gone"].used == 0 and s["c"].most_repeats == 3 and s["b"].most_repeats <= 4
    assert sum(r.used for r in s.values()) == sum(r.tokens * r.repeats for r in chosen.collect())
    for name in ("a", "b", "c"):
        assert s[name].wanted - 20 <= s[name].used <= s[name].wanted + 1e-3
    small, _ = mixture.mixture(df, goal, 500)
    large, _ = mixture.mixture(df, goal, 900)
    lo, hi = ({r.id: r.repeats for r in x.collect()} for x in (small, large))
    assert all(hi.get(i, 0) >= n for i, n in lo.items())
    assert mixture.mixture(df.limit(0), goal)[0].count() == 0 and mixture.mixture(df, goal.limit(0))[0].count() == 0


def test_mixture_thresholds_recomputed(spark):
    """The chosen documents against sorting each source by the hash and adding up."""
    from pyspark.sql import functions as F

    rnd = random.Random(14)
    rows = [(f"{s}{i}", s, rnd.randint(1, 50)) for s, n in (("a", 500), ("b", 80), ("c", 20)) for i in range(n)]
    df = frame(spark, rows, "id string, source string, tokens long")
    goal = frame(spark, [("a", 0.6, 1), ("b", 0.25, 2), ("c", 0.15, 3)], "source string, target_share double, max_repeats int")
    chosen, shares = mixture.mixture(df, goal, 9000)
    got, wanted = {r.id: r.repeats for r in chosen.collect()}, {r.source: r.wanted for r in shares.collect()}
    hashed = df.withColumn("h", F.shiftrightunsigned(F.xxhash64("id"), 16)).collect()
    want = {}
    for s, most in (("a", 1), ("b", 2), ("c", 3)):
        mine = sorted((r.h, r.id, r.tokens) for r in hashed if r.source == s)
        have = sum(t for _, _, t in mine)
        budget = min(int(wanted[s] + 1e-6), have * most)
        full, left = budget // have, budget % have
        for _, i, t in mine:
            extra = left >= t and left >= 0
            left = left - t if extra else -1
            if full + extra:
                want[i] = full + extra
    assert got == want


def test_token_counts(spark):
    import tiktoken

    own = tiktoken.Encoding("own", pat_str=mixture.PATTERN, mergeable_ranks=mixture.read_ranks(), special_tokens={})
    texts = ["Hello world", "  größer\n\nals 12345 ", "", None, "Привет"]
    got = [r.tokens for r in mixture.with_tokens(frame(spark, list(enumerate(texts)), "id long, text string"), "text").orderBy("id").collect()]
    assert got == [len(own.encode_ordinary(t or "")) for t in texts]
