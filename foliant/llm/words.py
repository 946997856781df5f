"""Words of a text: invisible format characters dropped, NFKC, lower case, maximal runs of letters and digits."""

from __future__ import annotations

import re
import sys
import unicodedata
from functools import lru_cache

import numpy as np
import xxhash

WORD = re.compile(r"[^\W_]+")


@lru_cache(1)
def _invisible() -> dict[str, None]:
    return dict.fromkeys(c for c in map(chr, range(sys.maxunicode + 1)) if unicodedata.category(c) == "Cf")


def normal(text: str | None) -> str:
    """The text as its words are taken from it; null counts as empty."""
    if not text:
        return ""
    if text.isascii():
        return text.lower()
    if hidden := set(text) & _invisible().keys():
        text = text.translate(dict.fromkeys(map(ord, hidden)))
    return unicodedata.normalize("NFKC", text).lower()


def words(text: str | None) -> list[str]:
    return WORD.findall(normal(text))


class WordHashes:
    """64-bit hashes of words; those seen are remembered, in a table emptied at a million."""

    def __init__(self) -> None:
        self.seen: dict[str, int] = {}

    def __call__(self, ws: list[str]) -> np.ndarray:
        if len(self.seen) > 1_000_000:
            self.seen.clear()
        seen, of = self.seen, xxhash.xxh3_64_intdigest
        for w in set(ws) - seen.keys():
            seen[w] = of(w)
        return np.fromiter(map(seen.__getitem__, ws), np.uint64, len(ws))


MIX = np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers (finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the runs of k words, in order of the text, from the hashes of its words."""
    n = len(h) - k + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = mix64(out + h[i : i + n] + MIX)
    return out


def sql_words(text: str) -> str:
    """SQL for the list of words of a text. Of the compatibility forms it knows full-width characters and those named here."""
    wide = "".join(map(chr, range(0xFF01, 0xFF5F)))
    # Compatibility forms and what they stand for.
    single, plain = "ºª¹²³µ", "oa123μ"
    x = f"regexp_replace({text}, '\\p{{Cf}}', '', 'g')"
    for form, long in (("№", "No"), ("™", "TM"), ("…", "..."), ("ﬁ", "fi"), ("ﬂ", "fl"), ("¼", "1⁄4"), ("½", "1⁄2"), ("¾", "3⁄4")):
        x = f"replace({x}, '{form}', '{long}')"
    to = "".join(chr(ord(c) - 0xFEE0) for c in wide).replace("'", "''")
    return f"regexp_extract_all(lower(nfc_normalize(translate({x}, '{wide}{single}', '{to}{plain}'))), '[\\p{{L}}\\p{{N}}]+')"
