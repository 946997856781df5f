"""Evaluation texts leaking into training text, by a prefix-filtered set join (problem 7).

An item's windows (runs of 13 words, or all its words if it has fewer) are sets of shingles, at most
five words each. A text that contains a window contains all its shingles, so at overlap 1 the prefix
that must be joined is a single shingle; the rarest one in the corpus is taken. Two passes over the
corpus: the first counts the items' shingles over all texts, the second joins the rarest ones, applies
the bounds of position and length, and compares the words of the window.

The items are a stated query set; they go to the tasks in blocks of at most ITEM_WORDS words, each
against all texts. Neither words nor hits of the corpus reach the driver, only one count per shingle of
the block's items.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import spread, table
from .words import sql_words, words

ITEM_WORDS = 2_000_000


class Items:
    """Windows of a block of items over a vocabulary of their own, in which 0 is any other word."""

    def __init__(self, items: list[tuple[int, str]], window: int, k: int) -> None:
        self.vocabulary: dict[str, int] = {}
        self.texts: list[np.ndarray] = []
        self.windows: list[tuple[int, int, int, int]] = []  # item, text, start, length
        for item, text in items:
            ids = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words(text)], np.uint32)
            n = min(window, len(ids))
            if n:
                self.windows += [(item, len(self.texts), s, n) for s in range(len(ids) - n + 1)]
            self.texts.append(ids)
        self.sizes = sorted({min(k, n) for _, _, _, n in self.windows})
        self.own = {s: np.unique(np.concatenate([self.shingles(t, s) for t in self.texts])) for s in self.sizes}
        self.k = k

    @staticmethod
    def shingles(ids: np.ndarray, k: int) -> np.ndarray:
        """Hashes of the runs of k ids; equal hashes are told apart later, when the window is compared."""
        h = np.zeros(max(0, len(ids) - k + 1), np.uint64)
        for i in range(k):
            h = h * np.uint64(0x9E3779B97F4A7C15) + ids[i : i + len(h)]
        return h

    def read(self, texts: Iterable[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The texts' words behind each other, each text followed by a 0, and where the texts begin."""
        get, flat, starts = self.vocabulary.get, [], [0]
        for t in texts:
            flat.extend(map(get, words(t), repeat(0)))
            flat.append(0)
            starts.append(len(flat))
        return np.array(flat, np.uint64), np.array(starts)

    def hits(self, ids: np.ndarray, which: dict[int, np.ndarray]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(shingle size, places, shingles) in a batch of texts; a run with a 0 in it is no shingle of an item."""
        known = np.concatenate([[0], np.cumsum(ids > 0)])
        for k in self.sizes:
            if len(ids) < k or not len(which[k]):
                continue
            at = np.flatnonzero(known[k:] - known[:-k] == k)
            h = self.shingles(ids, k)[at]
            i = np.searchsorted(which[k], h)
            i[i == len(which[k])] = 0
            ok = which[k][i] == h
            if ok.any():
                yield k, at[ok], h[ok]

    def prefixes(self, counts: dict[tuple[int, int], int]) -> dict[int, dict[int, list[tuple[int, int, int]]]]:
        """By shingle size and rarest shingle: (window, its offset). Ties go to the smaller hash."""
        out: dict[int, dict[int, list]] = {k: {} for k in self.sizes}
        for w, (_, t, start, n) in enumerate(self.windows):
            k = min(self.k, n)
            sh = self.shingles(self.texts[t][start : start + n], k).tolist()
            rare = min(range(len(sh)), key=lambda i: (counts.get((k, sh[i]), 0), sh[i]))
            out[k].setdefault(sh[rare], []).append((w, rare))
        return out


def _blocks(rows: Iterator, most: int) -> Iterator[list[tuple[int, str]]]:
    block, size = [], 0
    for r in rows:
        if block and size + len(r[1] or "") // 5 > most:
            yield block
            block, size = [], 0
        block.append((r[0], r[1]))
        size += len(r[1] or "") // 5
    if block:
        yield block


def contained(docs: DataFrame, items: DataFrame, doc: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", window: int = 13, k: int = 5) -> DataFrame:
    """(doc, item) for every item of which the text holds a window of words.

    A null or empty text holds nothing; an item without words, or with a null id or text, is held by
    nothing. Repeated rows give one pair. Items of one block are held by the driver, the texts never.
    """
    spark, parts = docs.sparkSession, []
    doc_type, item_type = docs.schema[doc].dataType.simpleString(), items.schema[item].dataType.simpleString()
    d = docs.where(F.col(text).isNotNull() & F.col(doc).isNotNull()).select(F.col(doc).alias("d"), F.col(text).alias("t"))
    d = spread(d)
    rows = items.where(F.col(item).isNotNull() & F.col(item_text).isNotNull()).select(item, item_text).distinct().toLocalIterator()
    for block in _blocks(rows, ITEM_WORDS):
        q = Items(block, window, k)
        if not q.windows:
            continue
        shared = spark.sparkContext.broadcast(q)

        def count(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            q, got = shared.value, {}
            for pdf in batches:
                for k, _, h in q.hits(q.read(pdf["t"])[0], q.own):
                    for x, n in zip(*map(np.ndarray.tolist, np.unique(h, return_counts=True))):
                        got[k, x] = got.get((k, x), 0) + n
            yield pd.DataFrame({"k": [a for a, _ in got], "h": np.array([b for _, b in got], np.uint64).view(np.int64), "n": list(got.values())})

        seen = d.select("t").mapInPandas(count, "k int, h long, n long").groupBy("k", "h").agg(F.sum("n").alias("n")).collect()
        counts = {(r.k, r.h & (2**64 - 1)): r.n for r in seen}
        rare = spark.sparkContext.broadcast((p := q.prefixes(counts), {s: np.array(sorted(v), np.uint64) for s, v in p.items()}))

        def verify(batches: Iterator[pd.DataFrame], shared=shared, rare=rare) -> Iterator[pd.DataFrame]:
            q, (probes, known) = shared.value, rare.value
            for pdf in batches:
                (ids, starts), found = q.read(pdf["t"]), set()
                for k, at, h in q.hits(ids, known):
                    for a, x, row in zip(at.tolist(), h.tolist(), (np.searchsorted(starts, at, "right") - 1).tolist()):
                        for w, offset in probes[k][x]:
                            item, text, start, n = q.windows[w]
                            lo = a - offset
                            if (row, item) in found or lo < starts[row] or lo + n > starts[row + 1] - 1:
                                continue
                            if (ids[lo : lo + n] == q.texts[text][start : start + n]).all():
                                found.add((row, item))
                out = [(pdf["d"].iat[row], item) for row, item in found]
                yield pd.DataFrame(out, columns=["d", "i"])

        parts.append(d.mapInPandas(verify, f"d {doc_type}, i {item_type}"))
    if not parts:
        return spark.createDataFrame([], f"{doc} {doc_type}, {item} {item_type}")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out.distinct().toDF(doc, item)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return contained(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p7_leaked_items(spark: SparkSession, d: str) -> DataFrame:
    """Per leaked item the number of documents that hold a passage of it."""
    return p7_found(spark, d).groupBy("item_id").agg(F.count("*").alias("documents"))


# Windows of items meet runs of as many words of the texts.
LEAKS = f"""
item AS (SELECT item_id, {sql_words("text")} AS w FROM eval_items WHERE text IS NOT NULL AND item_id IS NOT NULL),
sized AS (SELECT *, least(13, len(w)) AS l FROM item WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, l, array_to_string(w[i : i + l - 1], ' ') AS s FROM (SELECT *, unnest(range(1, CAST(len(w) - l + 2 AS BIGINT))) AS i FROM sized)),
doc AS (SELECT doc_id, {sql_words("text")} AS w FROM documents WHERE text IS NOT NULL),
run AS (SELECT doc_id, l, array_to_string(w[i : i + l - 1], ' ') AS s FROM (SELECT doc_id, w, l, unnest(range(1, CAST(len(w) - l + 2 AS BIGINT))) AS i FROM doc, (SELECT DISTINCT l FROM sized))),
leak AS (SELECT DISTINCT doc_id, item_id FROM run JOIN win USING (l, s))
"""
SQL = {
    "p7_found": f"WITH {LEAKS} SELECT doc_id, item_id FROM leak",
    "p7_leaked_items": f"WITH {LEAKS} SELECT item_id, count(*) AS documents FROM leak GROUP BY 1",
}
QUERIES = {"p7_found": p7_found, "p7_leaked_items": p7_leaked_items}
