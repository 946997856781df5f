"""Full-text search: query language, postings, BM25, snippets and highlights.

Query language: words, "quoted phrases", NEAR(a b, n), AND, OR, NOT and brackets; neighbours without an
operator are joined by AND. NOT binds tighter than AND, AND tighter than OR. A word is a run of letters
and digits, lowered.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Row, functions as F

from ..functions.text import WORDS, excerpt, rank_score, relevance, tokens
from ..session import checkpoint

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6


class InvalidQuery(ValueError):
    """The query can't be parsed."""


@dataclass(frozen=True)
class Leaf:
    """Words that must stand behind each other; with near, groups that must be within so many words."""

    words: tuple[str, ...]
    near: int | None = None


@dataclass(frozen=True)
class Node:
    op: str
    left: Node | Leaf
    right: Node | Leaf


LEXER = re.compile(r'\s*(?:"([^"]*)"|(NEAR)\s*\(([^()]*)\)|([()])|([^\s()"]+))')


def parse(text: str) -> Node | Leaf | None:
    """The query's tree; None for a blank one."""
    if not text.strip():
        return None
    if text.count('"') % 2:
        raise InvalidQuery("unterminated string")
    items, at = [], 0
    text = text.strip()
    while at < len(text):
        m = LEXER.match(text, at)
        if not m:
            raise InvalidQuery(f"syntax error near {text[at : at + 10]!r}")
        at = m.end()
        phrase, near, inside, bracket, word = m.groups()
        if phrase is not None:
            items.append(Leaf(tuple(re.findall(r"[^\W_]+", phrase.lower()))))
        elif near:
            body, _, n = inside.partition(",")
            items.append(Leaf(tuple(re.findall(r"[^\W_]+", body.lower())), int(n) if n.strip() else 10))
        elif bracket or word in ("AND", "OR", "NOT"):
            items.append(bracket or word)
        else:
            ws = re.findall(r"[^\W_]+", word.lower())
            if not ws or re.search(r"[^\w]", word):
                raise InvalidQuery(f"syntax error near {word!r}")
            items.append(Leaf(tuple(ws)))
    tree, rest = _or(items)
    if rest:
        raise InvalidQuery("syntax error")
    return tree


def _or(items: list) -> tuple[Node | Leaf, list]:
    left, items = _and(items)
    while items and items[0] == "OR":
        right, items = _and(items[1:])
        left = Node("OR", left, right)
    return left, items


def _and(items: list) -> tuple[Node | Leaf, list]:
    left, items = _not(items)
    while items and items[0] not in ("OR", ")"):
        right, items = _not(items[1:] if items[0] == "AND" else items)
        left = Node("AND", left, right)
    return left, items


def _not(items: list) -> tuple[Node | Leaf, list]:
    left, items = _one(items)
    while items and items[0] == "NOT":
        right, items = _one(items[1:])
        left = Node("NOT", left, right)
    return left, items


def _one(items: list) -> tuple[Node | Leaf, list]:
    if not items:
        raise InvalidQuery("unexpected end")
    first, rest = items[0], items[1:]
    if first == "(":
        inner, rest = _or(rest)
        if not rest or rest[0] != ")":
            raise InvalidQuery("missing )")
        return inner, rest[1:]
    if not isinstance(first, Leaf):
        raise InvalidQuery(f"syntax error near {first!r}")
    return first, rest


def leaves(tree: Node | Leaf) -> list[Leaf]:
    return [tree] if isinstance(tree, Leaf) else leaves(tree.left) + leaves(tree.right)


def postings(docs: DataFrame, ident: str, text: str) -> DataFrame:
    """(doc, term, positions): the inverted index, from 1; an empty text has no row."""
    t = docs.select(F.col(ident).alias("doc"), F.posexplode(tokens(text)).alias("p", "term"))
    return t.groupBy("doc", "term").agg(F.array_sort(F.collect_list(F.col("p") + 1)).alias("positions"))


def _hits(leaf: Leaf, place: dict[str, Column]) -> Column:
    """Places where a leaf matches in a document."""
    none = F.array().cast("array<int>")
    if not leaf.words:
        return none
    first = F.coalesce(place[leaf.words[0]], none)
    if leaf.near is not None:
        for w in leaf.words[1:]:
            other = F.coalesce(place[w], none)
            first = F.filter(first, _close(other, leaf.near))
        return first
    for i, w in enumerate(leaf.words[1:], 1):
        first = F.filter(first, _followed(F.coalesce(place[w], none), i))
    return first


def _close(other: Column, n: int):
    return lambda x: F.exists(other, lambda y: F.abs(x - y) <= n + 1)


def _followed(other: Column, i: int):
    return lambda x: F.array_contains(other, x + i)


def match(docs: DataFrame, ident: str, text: str, query: str, limit: int | None = None) -> DataFrame:
    """(doc, rank): matching documents with rank = -BM25, best first, from the texts themselves.

    Two passes: one counts documents, their lengths and those that each part of the query hits, the second
    scores. Only texts that hold one of the words as a substring are parted into words. A blank query gives
    no row, one that can't be parsed raises InvalidQuery. Without a limit all matches are given.
    """
    tree = parse(query)
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    base = docs.select(F.col(ident).alias("doc"), low.alias("low"))
    ls = list(dict.fromkeys(leaves(tree))) if tree else []
    words = sorted({w for leaf in ls for w in leaf.words})
    if not words:
        return base.select("doc", F.lit(0.0).alias("rank")).limit(0)
    may = reduce(lambda a, b: a | b, [F.contains("low", F.lit(w)) for w in words])
    counted = base.select("doc", F.regexp_count("low", F.lit(WORDS)).alias("len"), F.when(may, F.regexp_extract_all("low", F.lit(WORDS), 1)).alias("t"))
    stats = _leaf_hits(counted, ls, words).agg(F.count("*").alias("docs"), F.coalesce(F.avg("len"), F.lit(1.0)).alias("avg"), *_found(ls)).first()
    held = base.where(may).select("doc", F.regexp_extract_all("low", F.lit(WORDS), 1).alias("t")).select("doc", F.size("t").alias("len"), "t")
    return _ranked(_leaf_hits(held, ls, words), tree, ls, stats, limit)


def _leaf_hits(t: DataFrame, ls: list[Leaf], words: list[str]) -> DataFrame:
    """(doc, len, f0, f1, ...): how often each leaf hits, from the words t of each document, null where none can hit."""
    p = t.select("doc", "len", *[_positions(w).alias(f"w{i}") for i, w in enumerate(words)])
    place = {w: F.col(f"w{i}") for i, w in enumerate(words)}
    return p.select("doc", "len", *[F.size(_hits(leaf, place)).alias(f"f{i}") for i, leaf in enumerate(ls)])


def _found(ls: list[Leaf]) -> list[Column]:
    return [F.coalesce(F.sum((F.col(f"f{i}") > 0).cast("long")), F.lit(0)).alias(f"n{i}") for i in range(len(ls))]


def _ranked(h: DataFrame, tree: Node | Leaf, ls: list[Leaf], stats: Row, limit: int | None) -> DataFrame:
    """(doc, rank) of the rows of _leaf_hits() for which the query holds."""

    def true(x: Node | Leaf) -> Column:
        if isinstance(x, Leaf):
            return F.col(f"f{ls.index(x)}") > 0
        a, b = true(x.left), true(x.right)
        return a & b if x.op == "AND" else a | b if x.op == "OR" else a & ~b

    score = F.lit(0.0)
    for i in range(len(ls)):
        n = stats[f"n{i}"]
        idf = F.greatest(F.log(F.lit((stats["docs"] - n + 0.5) / (n + 0.5))), F.lit(LEAST_IDF))
        f = F.col(f"f{i}").cast("double")
        score = score + idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("len") / F.lit(float(stats["avg"] or 1.0))))
    out = h.where(true(tree)).select("doc", F.round(-score, 9).alias("rank"))
    return out.orderBy("rank", "doc").limit(limit) if limit is not None else out


def lengths(docs: DataFrame, ident: str, text: str) -> DataFrame:
    """(doc, len): number of words of every document, also of an empty one."""
    return docs.select(F.col(ident).alias("doc"), F.regexp_count(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(WORDS)).alias("len"))


def match_index(index: DataFrame, sizes: DataFrame, query: str, limit: int | None = None) -> DataFrame:
    """(doc, rank) as match() gives it, from postings() and lengths(): only the query's words are read."""
    tree = parse(query)
    ls = list(dict.fromkeys(leaves(tree))) if tree else []
    words = sorted({w for leaf in ls for w in leaf.words})
    if not words:
        return sizes.select("doc", F.lit(0.0).alias("rank")).limit(0)
    mine = index.where(F.col("term").isin(words)).groupBy("doc").agg(*[F.first(F.when(F.col("term") == w, F.col("positions")), ignorenulls=True).alias(f"w{i}") for i, w in enumerate(words)])
    place = {w: F.col(f"w{i}") for i, w in enumerate(words)}
    h = checkpoint(mine.select("doc", *[F.size(_hits(leaf, place)).alias(f"f{i}") for i, leaf in enumerate(ls)]))
    stats = sizes.agg(F.count("*").alias("docs"), F.coalesce(F.avg("len"), F.lit(1.0)).alias("avg")).join(h.agg(*_found(ls))).first()
    return _ranked(h.join(sizes, "doc"), tree, ls, stats, limit)


def _positions(w: str) -> Column:
    return F.coalesce(F.filter(F.transform("t", lambda x, i: F.when(x == w, i)), lambda i: i.isNotNull()), F.array().cast("array<int>"))


def search_exact(docs: DataFrame, ident: str, text: str, query: str, limit: int = 50) -> DataFrame:
    """(doc, score): scores in [0, 1] by the logistic function of the rank."""
    return match(docs, ident, text, query, limit).select("doc", relevance(rank_score("rank")).alias("score"))


def overlap(docs: DataFrame, ident: str, text: str, query: str) -> DataFrame:
    """(doc, score, excerpt): share of the query's words, repeated ones counted again, that a text has.

    Hits are added word by word: with a lambda over the words Spark fails to infer constraints of a join with the
    result (key not found), where the texts are among the first columns read in a session.
    """
    words = re.findall(r"[^\W_]+", query.lower())
    base = docs.select(F.col(ident).alias("doc"), F.col(text).alias("x"), tokens(text).alias("t"))
    if not words:
        return base.select("doc", F.lit(0.0).alias("score"), excerpt("x").alias("excerpt")).limit(0)
    hit = sum(F.coalesce(F.array_contains("t", w), F.lit(False)).cast("int") for w in words)
    return base.select("doc", (hit / len(words)).alias("score"), excerpt("x").alias("excerpt")).where("score > 0")


def merge_stages(exact: DataFrame, semantic: DataFrame, limit: int) -> DataFrame:
    """All exact hits, then semantic ones that aren't among them, up to the limit. Columns doc, score."""
    rest = semantic.join(exact.select("doc"), "doc", "left_anti")
    both = exact.select("doc", "score", F.lit(0).alias("stage")).unionByName(rest.select("doc", "score", F.lit(1).alias("stage")))
    return both.orderBy("stage", F.desc("score"), "doc").limit(max(limit, 1)).select("doc", "score")


def merge_best(exact: DataFrame, semantic: DataFrame) -> DataFrame:
    """Every hit once with its best score."""
    return exact.select("doc", "score").unionByName(semantic.select("doc", "score")).groupBy("doc").agg(F.max("score").alias("score"))


def spans(text: str, words: list[str]) -> list[tuple[int, int]]:
    """UTF-8 byte spans of the first free occurrence of each word in the lowered text, longer words first."""
    low, out = text.lower(), []
    for w in sorted(dict.fromkeys(words), key=lambda w: (-len(w.encode()), w)):
        at = low.find(w)
        while at >= 0:
            a = len(low[:at].encode())
            b = a + len(w.encode())
            if all(b <= x or a >= y for x, y in out):
                out.append((a, b))
                break
            at = low.find(w, at + 1)
    return sorted(out)


def snippet(text: str, words: list[str], most: int = 24, mark: tuple[str, str] = ("<b>", "</b>")) -> str:
    """The window of at most 24 tokens with most query words, these marked; an ellipsis where text is left out."""
    at = [(m.start(), m.end(), m.group().lower() in set(words)) for m in re.finditer(r"[^\W_]+", text)]
    if not at:
        return text
    best = max(range(max(1, len(at) - most + 1)), key=lambda i: (sum(h for _, _, h in at[i : i + most]), -i))
    part = at[best : best + most]
    out, last = ["…"] if best else [], part[0][0] if best else 0
    for a, b, hit in part:
        out += [text[last:a], mark[0] + text[a:b] + mark[1] if hit else text[a:b]]
        last = b
    out.append("…" if best + most < len(at) else text[last:])
    return "".join(out)


def with_highlights(hits: DataFrame, text: str, query: str) -> DataFrame:
    """hits with snippet and highlights (byte spans in the excerpt). For the rows of a result page."""
    words = re.findall(r"[^\W_]+", re.sub(r"\b(AND|OR|NOT|NEAR)\b", " ", query).lower())
    cut = hits.withColumn("excerpt", excerpt(text))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(snippet=[snippet(t or "", words) for t in pdf[text]], highlights=[[{"start": a, "end": b} for a, b in spans(t or "", words)] for t in pdf["excerpt"]])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema)
    return cut.mapInPandas(run, f"{fields}, snippet string, highlights array<struct<start:int,end:int>>")


def unified(content: DataFrame, tags: DataFrame, query: str, mode: str = "exact", wanted: list[str] = (), limit: int = 50) -> DataFrame:
    """(doc, score): exact, semantic or hybrid search; the wanted tags are tested after the best hits are found.

    content: document_id, text. tags: document_id, tag. A blank or wrong query gives no row.
    """
    from .vectors import semantic

    q = query.strip()
    none = content.select(F.col("document_id").alias("doc"), F.lit(0.0).alias("score")).limit(0)
    try:
        if not q:
            return none
        exact = search_exact(content, "document_id", "text", q, limit) if mode != "semantic" else None
    except InvalidQuery:
        return none
    near = semantic(content, "document_id", "text", q, limit) if mode != "exact" else None
    hits = exact if near is None else near if exact is None else merge_best(exact, near)
    if wanted:
        held = tags.where(F.col("tag").isin(list(wanted))).groupBy(F.col("document_id").alias("doc")).agg(F.countDistinct("tag").alias("n")).where(F.col("n") == len(set(wanted)))
        hits = hits.join(held.select("doc"), "doc", "left_semi")
    return hits.orderBy(F.desc("score"), "doc").limit(limit)
