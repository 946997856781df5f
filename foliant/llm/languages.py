"""Language of documents and of paragraphs in another language, by n-gram bitmask filters (problem 2).

One Bloom filter holds the character n-grams of all languages: each slot is a mask with a bit per language,
and the conjunction of an n-gram's slots gives every language that contains it (a bit-sliced set of one
filter per language). A paragraph's score for a language is its number of n-grams with that bit, corrected
for the filter's false positives. The filters are trained on a bounded sample of labelled documents; since
some labels are wrong, an n-gram counts for a language only if it is not much rarer there than elsewhere,
and the sample is relabelled once by the first filters.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, Window as W

from ..session import spread, table

# The languages told apart, by their code.
LANGUAGES = ["en", "de", "fr", "es", "it", "pt", "nl", "pl", "ru"]
SAMPLE = 3600
SIZES = (3, 4, 5)
TEXTS = 4096
CHARACTERS = 1_000_000
LETTERS = re.compile(r"[^\W\d_]+")
MAIL_HEADER = re.compile(r"[A-Z][A-Za-z-]{1,20}:(\s|$)")
BROKEN = re.compile("[-‐­][ \t]*\n")


def paragraphs(text: str | None) -> list[str]:
    """Maximal runs of lines that aren't blank."""
    out, run = [], []
    for line in (text or "").split("\n"):
        if line.strip():
            run.append(line)
        elif run:
            out.append("\n".join(run))
            run = []
    return [*out, "\n".join(run)] if run else out


def bare(paragraph: str) -> str:
    """A paragraph's words between single blanks, broken words joined; one of mail headers alone has none."""
    p = "" if all(map(MAIL_HEADER.match, paragraph.split("\n"))) else paragraph
    if not p.isascii():
        p = unicodedata.normalize("NFKC", p)
    return " " + " ".join(LETTERS.findall(BROKEN.sub("", p).lower())) + " "


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all n-grams within words, one blank at their ends allowed; the text each belongs to)."""
    c = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    stop, blank = np.cumsum(c == 10), (c == 32) | (c == 10)
    gaps = np.concatenate([[0], np.cumsum(blank)])
    hashes, owners = [], []
    for n in SIZES:
        m = len(c) - n + 1
        if m < 1:
            continue
        ok = (gaps[n - 1 : n - 1 + m] - gaps[1 : 1 + m] == 0) & (stop[:m] == stop[n - 1 : n - 1 + m]) & (c[:m] != 10)
        at = np.flatnonzero(ok)
        h = np.full(len(at), n, np.uint64)
        for i in range(n):
            h = (h ^ c[at + i]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        hashes.append(h)
        owners.append(stop[at])
    return np.concatenate(hashes) if hashes else np.zeros(0, np.uint64), np.concatenate(owners) if owners else np.zeros(0, np.int64)


class MaskFilter:
    """A Bloom filter whose slots are masks of languages."""

    def __init__(self, bits: int, hashes: int = 3, slots: int = 1 << 20) -> None:
        self.bits, self.k, self.slots = bits, hashes, np.zeros(slots, np.uint32)

    def places(self, h: np.ndarray) -> Iterator[np.ndarray]:
        n = np.uint64(len(self.slots) - 1)
        for i in range(self.k):
            h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9 + 2 * i)
            yield (h >> np.uint64(20)) & n

    def add(self, h: np.ndarray, masks: np.ndarray) -> None:
        for p in self.places(h):
            np.bitwise_or.at(self.slots, p, masks.astype(np.uint32))

    def languages_of(self, h: np.ndarray) -> np.ndarray:
        out = np.full(len(h), 0xFFFFFFFF, np.uint32)
        for p in self.places(h):
            out &= self.slots[p]
        return out

    def false_rates(self) -> np.ndarray:
        return np.array([((self.slots >> np.uint32(b)) & 1).mean() ** self.k for b in range(self.bits)])

    def counts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(number of n-grams of each text; for each text and language those it contains, false ones taken off)."""
        h, owner = grams(texts)
        # how often each mask occurs in each text, then the bits of the masks; so many texts at a time that the table stays small
        kinds, masks = 1 << self.bits, self.languages_of(h).astype(np.int64)
        bit, hit, n = (np.arange(kinds)[:, None] >> np.arange(self.bits)) & 1, np.zeros((len(texts), self.bits)), np.zeros(len(texts))
        order = np.argsort(owner, kind="stable") if len(texts) > TEXTS else None
        for lo in range(0, len(texts), TEXTS):
            hi = min(lo + TEXTS, len(texts))
            at = slice(None) if order is None else order[np.searchsorted(owner, lo, sorter=order) : np.searchsorted(owner, hi, sorter=order)]
            seen = np.bincount((owner[at] - lo) * kinds + masks[at], minlength=(hi - lo) * kinds)[: (hi - lo) * kinds].reshape(hi - lo, kinds)
            hit[lo:hi], n[lo:hi] = seen @ bit, seen.sum(1)
        f = self.false_rates()
        return n, np.clip((hit - n[:, None] * f) / (1 - f), 0, None)


def fit(texts: list[str], labels: np.ndarray, bits: int) -> MaskFilter:
    """labels: the number of each text's language. Every n-gram in at least 3 of a language's texts is weighed."""
    h, owner = grams(texts)
    _, first = np.unique((h ^ (owner.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))) * np.uint64(0x9E3779B97F4A7C15), return_index=True)
    ids, at = np.unique(h[first], return_inverse=True)
    seen = np.bincount(at * bits + labels[owner[first]], minlength=len(ids) * bits).reshape(len(ids), bits).astype(float)
    share = seen / np.maximum(1, np.bincount(labels, minlength=bits))
    take = (seen >= 3) & (share >= 0.004) & (share >= 0.2 * share.max(1, keepdims=True))
    f = MaskFilter(bits)
    use = take.any(1)
    f.add(ids[use], (take[use] * (1 << np.arange(bits))).sum(1))
    return f


def train(rows: list[tuple[str, str]]) -> MaskFilter:
    """From (label, text) with labels among LANGUAGES; relabels once."""
    rows = [(LANGUAGES.index(a), " ".join(map(bare, paragraphs(b)))) for a, b in rows]
    labels, texts = np.array([a for a, _ in rows], int), [" " + " ".join(b.split()) + " " for _, b in rows]
    f = fit(texts, labels, len(LANGUAGES))
    if len(texts):
        f = fit(texts, f.counts(texts)[1].argmax(1), len(LANGUAGES))
    return f


class Detector:
    """least, lead: a language is told if its score leads the next one's (or the main language's) by lead of all n-grams and by least of them.

    known: a text of whose n-grams no language has this share is in none of them. The confidence of a main
    language is its share of the n-grams in paragraphs whose language is told, that of another paragraph the
    share of its own n-grams by which it is ahead of the main language.
    """

    def __init__(self, f: MaskFilter, least: float = 25.0, lead: float = 0.12, known: float = 0.3) -> None:
        self.filter, self.least, self.lead, self.known = f, least, lead, known

    def documents(self, texts: list[str | None]) -> list[tuple[int, list[tuple[int, int, float]]]]:
        """Of each text the main language (-1: none) with the paragraphs (0: the text itself), language and confidence."""
        parts = [[bare(p) for p in paragraphs(t)] for t in texts]
        n, c = self.filter.counts([p for ps in parts for p in ps])
        out, at = [], 0
        for ps in parts:
            m, s = n[at : at + len(ps)], c[at : at + len(ps)]
            at += len(ps)
            order = np.sort(s, 1)[:, ::-1] if len(ps) else np.zeros((0, 2))
            told = (order[:, 0] - order[:, 1] >= self.least) & (order[:, 0] - order[:, 1] >= self.lead * m) if len(ps) else np.zeros(0, bool)
            weight = np.zeros(len(LANGUAGES))
            for i in np.flatnonzero(told):
                weight[s[i].argmax()] += m[i]
            if not weight.any():
                weight = s.sum(0) if len(ps) else weight
            if not weight.any() or s.sum(0).max() < self.known * m.sum():
                out.append((-1, []))
                continue
            main = int(weight.argmax())
            found = [(0, main, float(weight[main] / weight.sum()))]
            for i in range(len(ps)):
                b = int(s[i].argmax())
                ahead = s[i, b] - s[i, main]
                if b != main and ahead >= self.least and ahead >= self.lead * m[i] and s[i, b] >= 0.4 * m[i]:
                    found.append((i + 1, b, float(min(1.0, ahead / max(1.0, s[i, b])))))
            out.append((main, found))
        return out


def detector_for(labelled: DataFrame, ident: str, lang: str, text: str, sample: int = SAMPLE) -> Detector:
    """Trained on at most sample documents with a label among LANGUAGES, as many of each as there are, up to a ninth.

    Labels are counted over all rows first, and each language is thinned by its own count, so that a rare one
    keeps its documents.
    """
    code, each = F.lower(F.substring(lang, 1, 2)), sample // len(LANGUAGES)
    rows = labelled.where(code.isin(LANGUAGES)).select(code.alias("l"), F.col(ident).alias("i"), F.col(text).alias("t"))
    step = {r.l: max(1, r.n // (4 * each)) for r in rows.groupBy("l").agg(F.count("*").alias("n")).collect()}
    if not step:
        return Detector(train([]))
    every = F.element_at(F.create_map(*[F.lit(x) for kv in step.items() for x in kv]), F.col("l"))
    held = rows.where((F.pmod(F.xxhash64("i"), every) == 0) & (F.length("t") > 200)).select("l", "t", F.xxhash64("t").alias("h"))
    ranked = held.withColumn("r", F.row_number().over(W.partitionBy("l").orderBy("h", "t")))
    return Detector(train([(r.l, r.t) for r in ranked.where(F.col("r") <= each).orderBy("l", "r").select("l", "t").collect()]))


def detect(df: DataFrame, ident: str, text: str, detector: Detector) -> DataFrame:
    """(id, para_no, lang, confidence): para_no 0 is the text's main language, others are paragraphs in another one.

    A null, empty or letterless text, and one in none of the languages, gives no row. Repeated rows count once. An empty table gives an
    empty result.
    """
    kind, shared = df.schema[ident].dataType.simpleString(), df.sparkSession.sparkContext.broadcast(detector)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            # a million characters at a time
            block = (pdf["t"].str.len().cumsum() // CHARACTERS).to_numpy()
            for b in np.unique(block):
                part = pdf[block == b]
                out = [(i, *f) for i, (_, fs) in zip(part["id"], shared.value.documents(list(part["t"]))) for f in fs]
                yield pd.DataFrame([(i, p, LANGUAGES[l], c) for i, p, l, c in out], columns=["id", "para_no", "lang", "confidence"])

    rows = df.where(F.col(text).rlike(r"\p{L}")).select(F.col(ident).alias("id"), F.col(text).alias("t"))
    return spread(rows).mapInPandas(run, f"id {kind}, para_no long, lang string, confidence double").dropDuplicates(["id", "para_no", "lang"])


def detected(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return detect(table(spark, d, "content"), "document_id", "text", detector_for(docs, "doc_id", "lang", "text"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    found = detected(spark, d)
    labels = table(spark, d, "documents").select(F.col("id").alias("doc"), F.lower(F.substring("lang", 1, 2)).alias("code")).distinct()
    main = found.where("para_no = 0").join(labels, F.col("id") == F.col("doc")).where("code IS NULL OR code <> lang")
    return main.select(F.col("id").alias("document_id"), "para_no", "lang").distinct().unionAll(found.where("para_no > 0").select("id", "para_no", "lang"))


def p2_languages(spark: SparkSession, d: str) -> DataFrame:
    """Main language and paragraphs in another one, with confidence, whatever the label says; and the language of the title."""
    docs = table(spark, d, "documents")
    det = detector_for(docs, "doc_id", "lang", "text")
    texts = detect(table(spark, d, "content"), "document_id", "text", det).select(F.col("id").alias("document_id"), F.lit("text").alias("part"), "para_no", "lang", F.round("confidence", 6).alias("confidence"))
    titles = detect(docs, "id", "title", det).where("para_no = 0").select("id", F.lit("title"), "para_no", "lang", F.round("confidence", 6))
    return texts.unionAll(titles).distinct()


SQL: dict[str, str] = {}
QUERIES = {"p2_found": p2_found, "p2_languages": p2_languages}
