"""Noise in text from scanned pages: furniture, broken words, misread characters (problem 1).

Lines are labelled body, furniture (running header or footer, page number) or break (a line that begins a
paragraph, with or without a blank line before it) by a linear-chain conditional random field: weights of
layout features of each line and of pairs of labels, trained together by the gradient of the likelihood
(forward-backward) on pages made from all clean texts of the corpus (wrapped, with furniture put between
their lines), and decoded by Viterbi. Whether a text is a page at all is told by a logistic regression on
its layout, trained on all texts by what the extractor says of them, or by several signs of scanning
in it, whatever its layout. Whether a word is broken or misread is told by the counts of words over
all texts: those with at least a millionth of all words form the lexicon, which therefore has at most a
million entries. Rarer words keep their count where a verdict hangs on it.
"""

from __future__ import annotations

import pickle
import random
import re
from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import accumulate
from operator import itemgetter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.filters import distinct_rows
from ..session import checkpoint, spread, table

SHARE = 1e-6
UNIT = 1 << 30  # shares of lines are counted in whole units, whose sums are the same in any order
BEGIN = 600  # texts whose pages say where the search for the weights begins, about; it goes on with five times as many and ends at all texts
FINE = 1 << 10  # likewise a page's gradient, where it is multiplied with itself
BODY, FURNITURE, BREAK = range(3)
# Extractors that read images.
RECOGNISED = ("ocr", "scan")
WORD = re.compile(r"[@$]?(?=[^\W_])(?:(?<![@$])|(?=[^\W\d_]))[^\W_](?:[^\W_]|(?<=\w)[@$|](?=\w)|(?<=[^\W\d_])[@$](?!\w))*")
UNWRAPPED = re.compile(r"(?m)^[^\n]{120,}$")
COMPOUND_END = re.compile(r"[^\W\d_][-‐]$")
PLAIN = re.compile(r"[^\W_]+")
COMPOUND = re.compile(r"(?<![^\W\d_])[^\W\d_]++(?:[-‐][^\W\d_]+)+")
HYPHEN_END = re.compile(r"([^\W\d_][\w@$'’]*|\w[\w@$'’]*[^\W\d_])[-‐‑­¬][ \t]*$")
HYPHENS = "-‐‑­¬"
PARTED = re.compile(r"[-‐‑][ \t]*\n\s*([\w@$]+)")
LAST = re.compile(r"[^\W_][\w@$]*$")
# How a page number may look; digits may be misread as letters.
NUMBER = r"[\dlIiOoSsBbQqgZz|]{1,4}"
PAGE = re.compile(rf"^[\W_]*(?:(?:page|seite|página|pagina|strona|str|страница|стр|pág|pag|blz|bladzijde|p|s)[\s.:]*)?(?:{NUMBER}|[ivxlc]{{1,6}})(?:\s*(?:/|of|von|sur|de|di|van|z|из)\s*{NUMBER})?[\W_]*$", re.I)
FIGURES = re.compile(r"^[\w'’ ]*? {2,}\d[\d.,\- ]*$|^\d[\d.]*,\d+$|^\d+-\d+$")
YEAR_END = re.compile(r"(?:19|20|[l1I]9|Z0|2[Oo])[\dlIOoSsB]{2}(?:\s+\W*[\dlIOoSsB]{1,3}\W*)?$")
TITLE_YEAR = re.compile(r"^[^.,;:?!()–/]+ (?:19|20|[l1I]9|Z0|2[Oo])[\dlIOoSsBZ]{2}(?:\s+\W*[\dlIOoSsBZ]{1,3}\W*)?$")
AMOUNT = re.compile(r"^\d+,\d+$")
TITLE_NUMBER = re.compile(r"(?:(?:19|20|[l1I]9|Z0|2[Oo])[\dlIOoSsBZ]{2}|[_(]\d{3,6}\)?)\s+\W*[\dlIOoSsBZ]{1,3}\W*$")
# What is printed, and what recognition makes of it.
MISREAD = [("e", "c"), ("n", "ri"), ("t", "f"), ("o", "0"), ("a", "@"), ("s", "5"), ("i", "l"), ("u", "ii"), ("l", "1"), ("d", "cl"), ("g", "9"), ("h", "b"), ("m", "rn"), ("in", "m"), ("w", "vv"), ("li", "h"), ("s", "$"), ("b", "8"), ("ó", "6"), ("é", "6"), ("b", "6"), ("ä", "a"), ("ü", "ii"), ("i", "1"), ("l", "i"), ("rn", "m"), ("z", "2"), ("q", "9"), ("l", "|"), ("fi", "ﬁ"), ("fl", "ﬂ"), ("о", "0"), ("в", "b"), ("е", "с"), ("ы", "ьi"), ("и", "u"), ("ç", "g"), ("ñ", "fi"), ("ł", "t"), ("cl", "d"), ("л", "п"), ("з", "3"), ("п", "n"), ("н", "и"), ("а", "@"), ("б", "6"), ("я", "9"), ("т", "m"), ("о", "o"), ("а", "a"), ("с", "c"), ("е", "e"), ("р", "p"), ("х", "x"), ("у", "y")]


DIGIT = re.compile(r"\d")
DIGITS = re.compile(r"\d+")
GAPS = re.compile(r"[\W_]+")
FILE_NAME = re.compile(r"^[\w@$]{2,10}(?:_[\dlIOoSsBZ]{3,6}|\([\dlIOoSsBZ]{3,6}\))(?:\s+\S{1,4})?$")
LETTERS_NUMBER = re.compile(r"[^\W\d_]{2,5}[ _-]?\d{3,6}")
ROMAN = re.compile(r"\W*[ivxlcIVXLC]+\W*")
SET_APART = re.compile(r"(?:19|20|[l1I]9|Z0|2[Oo])[\dlIOoSsBZ]{2}\s{2,}\W*[\dlIOoSsBZ]{1,3}\W*$")
NO_LETTER = bytes(sorted(set(range(256)) - set(range(ord("a"), ord("z") + 1))))
JOINED = ("page+number", "names only", "year end", "capitals", "figures", "title and number", "file name", "roman")
JOINED_ANY = frozenset(JOINED)


@lru_cache(1 << 14)
def key(line: str) -> str:
    """A line with its digits made alike, for comparison within a text."""
    return GAPS.sub(" ", DIGITS.sub("9", line.lower())).strip()


def compounds(text: str) -> list[str]:
    """Words with hyphens inside; they have no white space, so that only what has a hyphen is searched."""
    return COMPOUND.findall(" ".join([x for x in text.split() if "-" in x or "‐" in x]))


def keyed(s: list[str], most: int = 60) -> list[tuple[str, str]]:
    """(line, its key) for those below a length; lines that can't come again, by their letters from a to z, are left out."""
    short = [x for x in s if 0 < len(x) < most]
    crude = [x.lower().encode("utf-8", "surrogatepass").translate(None, NO_LETTER) for x in short]
    n = Counter(crude)
    return [(x, key(x)) for x, c in zip(short, crude) if n[c] > 1]


def repeated(s: list[str]) -> Counter:
    """How often the key of each short line comes in a text; lines that can't come again are left out."""
    return Counter(k for _, k in keyed(s))


def usual_width(s: list[str]) -> int:
    """The width that nine tenths of the lines don't pass."""
    full = sorted(len(x) for x in s if x)
    return full[int((len(full) - 1) * 0.9)] if full else 0


def features(lines: list[str]) -> list[list[str]]:
    """Layout features of each line that isn't blank."""
    s = [x.strip() for x in lines]
    width, short = usual_width(s), keyed(s)
    often = Counter(k for _, k in short)
    again = {x for x, k in short if often[k] > 1}
    filled = [i for i, x in enumerate(s) if x]
    out: list[list[str]] = [[] for _ in s]
    for n, i in enumerate(filled):
        x, raw = s[i], lines[i]
        before, after = (s[filled[n - 1]] if n else ""), (s[filled[n + 1]] if n + 1 < len(filled) else "")
        f = ["bias"]
        ends = x[-1] in ".?!:…" or x.endswith((").", "”"))
        digit = DIGIT.search(x) is not None
        words = x.split()
        page = len(x) < 40 and PAGE.match(x) is not None
        numbered = digit and len(words) > 1 and TITLE_NUMBER.search(x) is not None
        figures = digit and not numbered and FIGURES.match(x) is not None
        first = after.find(" ")
        fits = len(x) + 1 + (first if first >= 0 else len(after)) < width if after else len(x) < width - 12
        if raw[:1] == "\f":
            f.append("page begins")
            if fits and not ends:
                f.append("page begins short")
        if i + 1 < len(s) and lines[i + 1][:1] == "\f" or after and lines[filled[n + 1]][:1] == "\f":
            f.append("page ends")
            if page:
                f.append("page ends number")
        if page:
            f.append("page+number" if digit else "page")
            if not digit:
                f.append("roman" if ROMAN.fullmatch(x) else "letters for digits")
            if i + 1 < len(s) and n and FIGURES.match(before) and x.isdigit():
                f.append("page after figures")
        if digit and len(x) < 14 and LETTERS_NUMBER.fullmatch(x):
            f.append("letters and number")
        if figures:
            f.append("figures")
            if AMOUNT.match(after) or AMOUNT.match(x):
                f.append("table")
        if numbered:
            f.append("title and number")
            f.append("set apart " + ("year" if SET_APART.search(x) else "no"))
        if digit and len(x) < 60 and len(words) <= 9 and YEAR_END.search(x):
            f.append("year end")
            if TITLE_YEAR.match(x):
                f.append("title year")
        if x.isupper() and sum(map(str.isalpha, x)) > 3:
            f.append("capitals")
        if ("_" in x[:11] or "(" in x[:11]) and FILE_NAME.search(x):
            f.append("file name")
        if x in again:
            f.append("repeated")
        f.append("ends" if ends else "open")
        lower = x[0].islower()
        f.append("lower first" if lower else "upper first" if x[0].isupper() else "other first")
        f.append(f"fits {fits} {'ends' if ends else 'open'}")
        if len(words) <= 3 and all(w[:1].isupper() and len(w) > 2 and sum(map(str.isalpha, w)) > 0.7 * len(w) for w in words):
            f.append("names only")
        if len(x) < 0.6 * width:
            f.append("short")
        if raw[:1] in " \t":
            f.append("indented far" if (far := len(raw) - len(raw.lstrip())) > 5 else "indented" if far > 1 else "indented by one")
        if i == filled[0]:
            f.append("first")
        if i == filled[-1]:
            f.append("last")
        if before:
            closed = before[-1] in ".?!:…)”"
            if after and before[-1] not in ".?!:…" and after[0].islower():
                f.append("interrupts " + ("lower" if lower else "other"))
            # what a paragraph that begins here looks like
            f.append(f"begins {closed} {len(before) + 1 + len(words[0]) < width} {'lower' if lower else 'other'}")
            if raw[:1] in " \t" and not lines[filled[n - 1]][:1] in " \t":
                f.append("indented more")
        if fits and not ends and after[:1].isupper():
            f.append("title place")
        if i and not s[i - 1]:
            f.append("after blank")
            f.append(f"after blank {before[-1:] in '.?!:…)”'}")
        if i + 1 < len(s) and not s[i + 1]:
            f.append("before blank")
        for a in () if JOINED_ANY.isdisjoint(f) else JOINED:
            if a in f:
                f.append(f"{a} & {'fits' if fits else 'full'} & {'ends' if ends else 'open'}")
                f.append(f"{a} & {len(words) // 3} & {'lower' if lower else 'other'}")
        out[i] = f
    return out


PLANE = 1 << 16
SPACE, DECIMAL, LOWER, UPPER, ENDS, CLOSES, STOPS, OPENS, WORDLY, ALNUM, NUMERAL, AMOUNTS = (1 << k for k in range(12))


@lru_cache(1)
def _characters() -> tuple[np.ndarray, np.ndarray]:
    """For characters of the first plane: their kinds, and numbers whose sums agree where the letters from a to z agree in lower case."""
    kinds, letters = np.zeros(PLANE, np.uint16), np.zeros(PLANE, np.uint32)
    number = {chr(ord("a") + k): (k + 1) * 0x9E3779B1 % (1 << 32) for k in range(26)}
    for k, c in enumerate(map(chr, range(PLANE))):
        kinds[k] = c.isspace() * SPACE | c.isdecimal() * DECIMAL | c.islower() * LOWER | c.isupper() * UPPER | (c in ".?!:…”") * ENDS | (c in ".?!:…)”") * CLOSES | (c in ".?!:…") * STOPS | (c in "_(") * OPENS
        kinds[k] |= (c.isalnum() or c == "_") * WORDLY | c.isalnum() * ALNUM | (c.isdecimal() or c in "lIOoSsBZ") * NUMERAL | (c.isdecimal() or c in ".,-") * AMOUNTS
        letters[k] = sum(number.get(x, 0) for x in c.lower()) % (1 << 32)
    return kinds, letters


@lru_cache(1 << 14)
def _odd(x: str, after_figures: bool, before_amount: bool) -> tuple[tuple[str, ...], bool, int]:
    """What features() finds by expressions in a line: before its repetition, whether it is names only, and a third of its words if other features hang on it."""
    f, n = [], len(x.split())
    digit = DIGIT.search(x) is not None
    page = len(x) < 40 and PAGE.match(x) is not None
    numbered = digit and n > 1 and TITLE_NUMBER.search(x) is not None
    figures = digit and not numbered and FIGURES.match(x) is not None
    if page:
        f.append("page+number" if digit else "page")
        if not digit:
            f.append("roman" if ROMAN.fullmatch(x) else "letters for digits")
        if after_figures and x.isdigit():
            f.append("page after figures")
    if digit and len(x) < 14 and LETTERS_NUMBER.fullmatch(x):
        f.append("letters and number")
    if figures:
        f.append("figures")
        if before_amount or AMOUNT.match(x):
            f.append("table")
    if numbered:
        f.append("title and number")
        f.append("set apart " + ("year" if SET_APART.search(x) else "no"))
    if digit and len(x) < 60 and n <= 9 and YEAR_END.search(x):
        f.append("year end")
        if TITLE_YEAR.match(x):
            f.append("title year")
    if x.isupper() and sum(map(str.isalpha, x)) > 3:
        f.append("capitals")
    if ("_" in x[:11] or "(" in x[:11]) and FILE_NAME.search(x):
        f.append("file name")
    names = n <= 3 and all(w[:1].isupper() and len(w) > 2 and sum(map(str.isalpha, w)) > 0.7 * len(w) for w in x.split())
    return tuple(f), names, n // 3 if names or not JOINED_ANY.isdisjoint(f) else 0


@lru_cache(1 << 16)
def _described(code: int, odd: tuple[tuple[str, ...], bool, int]) -> tuple[str, ...]:
    """The features that features() gives a line, in its order, from the bits of feature_sets()."""
    bit = lambda k: bool(code >> k & 1)
    found, names, thirds = odd
    ends, fits, lower, f = bit(3), bit(6), bit(4), ["bias"]
    begins, page_ends = bit(0), bit(1)
    f += ["page begins"] * begins + ["page begins short"] * (begins and fits and not ends)
    f += ["page ends"] * page_ends + ["page ends number"] * (page_ends and ("page" in found or "page+number" in found))
    f += found
    f += ["repeated"] * bit(2) + ["ends" if ends else "open", "lower first" if lower else "upper first" if bit(5) else "other first"]
    f.append(f"fits {fits} {'ends' if ends else 'open'}")
    f += ["names only"] * names + ["short"] * bit(7)
    f += [[], ["indented by one"], ["indented"], ["indented far"]][code >> 8 & 3]
    f += ["first"] * bit(10) + ["last"] * bit(11)
    if bit(12):
        f += ["interrupts " + ("lower" if lower else "other")] * bit(13)
        f.append(f"begins {bit(14)} {bit(15)} {'lower' if lower else 'other'}")
        f += ["indented more"] * bit(16)
    f += ["title place"] * bit(17)
    f += ["after blank", f"after blank {bit(19)}"] * bit(18) + ["before blank"] * bit(20)
    for a in JOINED:
        if a in found or a == "names only" and names:
            f.append(f"{a} & {'fits' if fits else 'full'} & {'ends' if ends else 'open'}")
            f.append(f"{a} & {thirds} & {'lower' if lower else 'other'}")
    return tuple(f)


def feature_sets(pages: list[list[str]]) -> tuple[list[tuple[str, ...]], np.ndarray, np.ndarray]:
    """(sets of features, for each line that isn't blank the number of its set, for each line whether it isn't blank).

    The features are those of features(), for many pages at once.
    """
    raw, size = [x for lines in pages for x in lines], np.array([len(lines) for lines in pages], np.int64)
    bare = [x.strip() for x in raw]
    length = np.fromiter(map(len, bare), np.int64, len(raw))
    filled = length > 0
    s = [x for x in bare if x]
    if not s:
        return [], np.zeros(0, np.int64), filled
    # what comes before a line's first character
    feed, lead, tab = np.zeros(len(raw), bool), np.zeros(len(raw), np.int64), np.zeros(len(raw), bool)
    for i in np.flatnonzero(np.fromiter(map(len, raw), np.int64, len(raw)) != length).tolist():
        c = raw[i][0]
        feed[i], tab[i] = c == "\f", c in " \t"
        if tab[i]:
            lead[i] = len(raw[i]) - len(raw[i].lstrip())
    page_of_raw, last_raw = np.repeat(np.arange(len(pages)), size), np.zeros(len(raw), bool)
    last_raw[(np.cumsum(size) - 1)[size > 0]] = True
    first_raw = np.roll(last_raw, 1)
    first_raw[0] = True
    at = np.flatnonzero(filled)
    page, n = page_of_raw[at], length[at]
    has_before, has_after = np.zeros(len(at), bool), np.zeros(len(at), bool)
    has_before[1:] = page[1:] == page[:-1]
    has_after[:-1] = has_before[1:]
    prev, next_ = np.maximum(np.arange(len(at)) - 1, 0), np.minimum(np.arange(len(at)) + 1, len(at) - 1)
    # characters of all lines, each followed by a line end
    codes = np.frombuffer("\n".join([*s, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    end = np.cumsum(n + 1) - 1
    start = end - n
    kinds, letters = _characters()
    beyond = codes >= PLANE
    strange = np.add.reduceat(beyond, start, dtype=np.int64) > 0 if beyond.any() else None
    if strange is not None:
        codes = np.where(beyond, 0, codes)
    kind = kinds[codes]
    space = kind & SPACE > 0
    words = np.add.reduceat(space[1:] & ~space[:-1], np.maximum(start - 1, 0), dtype=np.int64) if len(codes) > 1 else np.ones(1, np.int64)
    where = np.flatnonzero(space)
    word = where[np.searchsorted(where, start)] - start
    blank = codes == 32
    blank[end] = True
    where = np.flatnonzero(blank)
    until = where[np.searchsorted(where, start)] - start
    any_, head, tail = np.bitwise_or.reduceat(kind, start), kind[start], kind[end - 1]
    per_page = np.bincount(page, minlength=len(pages))
    order, begin = np.lexsort((n, page)), np.cumsum(per_page) - per_page
    width = np.zeros(len(pages), np.int64)
    width[per_page > 0] = n[order][(begin + ((per_page - 1) * 0.9).astype(np.int64))[per_page > 0]]
    width = width[page]
    ends, lower, upper = tail & ENDS > 0, head & LOWER > 0, head & UPPER > 0
    fits = np.where(has_after, n + 1 + until[next_] < width, n < width - 12)
    # lines that come again, by their letters, and then as features() tells them
    again = np.zeros(len(at), bool)
    short = np.flatnonzero(n < 60)
    total = np.add.reduceat(letters[codes], start, dtype=np.uint32)[short].astype(np.int64) | page[short] << 32
    _, of, many = np.unique(total, return_inverse=True, return_counts=True)
    alike: dict[int, list[int]] = {}
    for i in short[many[of] > 1].tolist():
        alike.setdefault(page[i], []).append(i)
    for lines in alike.values():
        pairs = keyed([s[i] for i in lines])
        often = Counter(k for _, k in pairs)
        twice = {x for x, k in pairs if often[k] > 1}
        again[[i for i in lines if s[i] in twice]] = True
    blank_before, blank_after = ~first_raw[at], ~last_raw[at]
    blank_before[blank_before] = ~filled[at[blank_before] - 1]
    feeds_next = blank_after.copy()
    feeds_next[blank_after] = feed[at[blank_after] + 1]
    blank_after[blank_after] = ~filled[at[blank_after] + 1]
    feed, tab, lead = feed[at], tab[at], lead[at]
    before = tail[prev]
    bits = [
        feed, feeds_next | has_after & feed[next_], again, ends, lower, upper, fits, n < 0.6 * width,
        (lead == 1) | (lead > 5), lead > 1, ~has_before, ~has_after, has_before,
        has_before & has_after & (before & STOPS == 0) & (head[next_] & LOWER > 0),
        has_before & (before & CLOSES > 0), has_before & (n[prev] + 1 + word < width), has_before & tab & ~tab[prev],
        fits & ~ends & has_after & (head[next_] & UPPER > 0),
        blank_before, blank_before & (~has_before | (before & CLOSES > 0)), blank_after,
    ]
    code = np.zeros(len(at), np.int64)
    for k, b in enumerate(bits):
        code |= b.astype(np.int64) << k
    # what only expressions tell
    plain: tuple[tuple[str, ...], bool, int] = ((), False, 0)
    odds = {plain: 0}
    # a page number has no more letters and digits than those of "bladzijde", two numbers and "von"; other expressions for
    # digits hold only lines whose last letter or digit is one or looks like one, or which end as figures do
    where = np.flatnonzero(kind & WORDLY)
    known = np.concatenate([[0], kind[where] & NUMERAL])[np.searchsorted(where, end)] > 0
    gap = np.add.reduceat(blank[1:] & blank[:-1], np.maximum(start - 1, 0), dtype=np.int64) > 0 if len(codes) > 1 else np.zeros(1, bool)
    digits = (any_ & DECIMAL > 0) & (known | (n < 14) | (tail & AMOUNTS > 0) & (gap | (head & DECIMAL > 0)))
    look = digits | (n < 40) & (np.add.reduceat(kind & ALNUM > 0, start, dtype=np.int64) <= 24) | ((any_ & LOWER == 0) & (any_ & UPPER > 0)) | (words <= 3) & upper | (words <= 2) & (any_ & OPENS > 0)
    odd = np.zeros(len(at), np.int64)
    after_figures = has_before & ~last_raw[at] & (before & AMOUNTS > 0) & (head & tail & NUMERAL > 0)
    before_amount = digits & has_after & (head[next_] & tail[next_] & DECIMAL > 0)
    for i, a, b in zip(*(x.tolist() for x in (np.flatnonzero(look), after_figures[look], before_amount[look]))):
        o = _odd(s[i], a and FIGURES.match(s[i - 1]) is not None, b and AMOUNT.match(s[i + 1]) is not None)
        if o != plain:
            odd[i] = odds.setdefault(o, len(odds))
    tell = list(odds)
    distinct, seq = np.unique(code | odd << 32, return_inverse=True)
    sets = [_described(c & 0xFFFFFFFF, tell[c >> 32]) for c in distinct.tolist()]
    if strange is not None:
        seq = seq.copy()
        of_raw = np.cumsum(size) - size
        for k in set(page[strange].tolist()):
            mine = [tuple(f) for f in features(raw[of_raw[k] : of_raw[k] + size[k]]) if f]
            seq[page == k] = range(len(sets), len(sets) + len(mine))
            sets += mine
    return sets, seq, filled


class Labeller:
    """Linear-chain model: weights of features (a row a feature, a column a label) and of pairs of labels."""

    def __init__(self, names: dict[str, int] | None = None, own: np.ndarray | None = None, pairs: np.ndarray | None = None) -> None:
        self.names, self.own, self.pairs = names or {}, np.zeros((0, 3)) if own is None else own, np.zeros((3, 3)) if pairs is None else pairs

    def scores(self, feats: list[list[str]]) -> np.ndarray:
        get = self.names.get
        ids = [[k for x in f if (k := get(x)) is not None] or [len(self.own)] for f in feats]
        w = np.vstack([self.own, np.zeros((1, 3))])
        return np.add.reduceat(w[[k for f in ids for k in f]], np.cumsum([0] + [len(f) for f in ids[:-1]]), axis=0)

    def decode(self, feats: list[list[str]]) -> list[int]:
        """The likeliest labels of lines with these features."""
        if not feats:
            return []
        p = self.pairs.tolist()
        (p00, p01, p02), (p10, p11, p12), (p20, p21, p22) = p
        score, back = None, []
        for e0, e1, e2 in self.scores(feats).tolist():
            if score is None:
                score = (e0, e1, e2)
                continue
            s0, s1, s2 = score
            a = max((s0 + p00, 0), (s1 + p10, 1), (s2 + p20, 2), key=itemgetter(0))
            b = max((s0 + p01, 0), (s1 + p11, 1), (s2 + p21, 2), key=itemgetter(0))
            c = max((s0 + p02, 0), (s1 + p12, 1), (s2 + p22, 2), key=itemgetter(0))
            score = (a[0] + e0, b[0] + e1, c[0] + e2)
            back.append((a[1], b[1], c[1]))
        y = [max(range(3), key=score.__getitem__)]
        for from_ in reversed(back):
            y.append(from_[y[-1]])
        return y[::-1]

    def __call__(self, lines: list[str]) -> list[int | None]:
        """A label for every line; blank ones have none."""
        feats = features(lines)
        at = [i for i, f in enumerate(feats) if f]
        out: list[int | None] = [None] * len(lines)
        for i, y in zip(at, self.decode([feats[i] for i in at])):
            out[i] = y
        return out


def minimum(f: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, rounds: int = 60, memory: int = 8, curvature: Callable[[], np.ndarray] | None = None, longest: float = 1.0) -> np.ndarray:
    """Where a smooth convex function with its gradient is least (limited-memory BFGS with backtracking).

    curvature: gives second derivatives, about, of which steps begin, once f is known at x; then no step is longer than
    longest in any direction, and the last one is where the next would gain as little. Without them a step is as long
    as the last one says.
    """
    v, g = f(x)
    bend = None if curvature is None else curvature()
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        q, alphas = g.copy(), []
        for s, y in reversed(past):
            a = (s @ q) / (y @ s)
            alphas.append(a)
            q -= a * y
        if bend is not None:
            q = np.linalg.solve(bend, q)
        else:
            q *= (past[-1][0] @ past[-1][1]) / (past[-1][1] @ past[-1][1]) if past else 1 / max(1.0, np.abs(g).sum())
        for (s, y), a in zip(past, reversed(alphas)):
            q += s * (a - (y @ q) / (y @ s))
        step, slope = 1.0, g @ q
        if bend is not None:
            if slope / 2 <= 1e-5 * abs(v):
                break
            step = min(1.0, longest / np.abs(q).max())
        while True:
            nx = x - step * q
            nv, ng = f(nx)
            if nv <= v - 1e-4 * step * slope or step < 1e-6:
                break
            step /= 2
        if (nx - x) @ (ng - g) > 1e-12:
            past = [*past[1 - memory :], (nx - x, ng - g)]
        done = abs(v - nv) <= 1e-5 * abs(v)
        x, v, g = nx, nv, ng
        if done:
            break
    return x


class Block:
    """Pages to train on: the distinct sets of features, and for each step of the recursions the sets of the lines
    there, of the longest page first."""

    def __init__(self) -> None:
        self.sets: dict[tuple[str, ...], int] = {}
        self.pages: list[tuple[np.ndarray, np.ndarray]] = []
        self.lines = 0

    def add(self, feats: list[list[str]], gold: list[int]) -> None:
        """A page by the features of its lines and their labels."""
        self.pages.append((np.array([self.sets.setdefault(tuple(f), len(self.sets)) for f in feats], np.uint32), np.array(gold, np.int8)))
        self.lines += len(gold)

    def add_all(self, pages: list[tuple[list[str], list[int | None]]]) -> None:
        """Many pages by their lines and labels; blank lines have none."""
        sets, seq, filled = feature_sets([lines for lines, _ in pages])
        ids = np.array([self.sets.setdefault(f, len(self.sets)) for f in sets], np.uint32)[seq]
        gold = np.array([-1 if y is None else y for _, gold in pages for y in gold], np.int8)
        page = np.repeat(np.arange(len(pages)), [len(gold) for _, gold in pages])[filled]
        gold = gold[filled]
        told = gold >= 0
        ids, gold, cuts = ids[told], gold[told], np.cumsum(np.bincount(page[told], minlength=len(pages)))[:-1]
        self.pages += [(i, y) for i, y in zip(np.split(ids, cuts), np.split(gold, cuts)) if len(y)]
        self.lines += len(gold)

    def packed(self) -> Block:
        """The block with its pages beside each other, to which none can be added."""
        names: dict[str, int] = {}
        sets = [[names.setdefault(x, len(names)) for x in f] for f in self.sets]
        self.names, self.of = list(names), np.repeat(np.arange(len(sets)), [len(f) for f in sets])
        self.ids, self.starts = np.array([k for f in sets for k in f]), np.cumsum([0] + [len(f) for f in sets[:-1]])
        self.pages.sort(key=lambda p: -len(p[0]))
        seq, gold = (np.concatenate([p[k] for p in self.pages]) for k in (0, 1))
        length = np.array([len(y) for _, y in self.pages])
        begin = np.cumsum(length) - length
        # step t takes the first left[t] of the pages
        self.left = [int(np.searchsorted(-length, -t)) for t in range(length[0])]
        at = np.concatenate([begin[:k] + t for t, k in enumerate(self.left)])
        self.seq, self.labels = seq[at], gold[at]
        self.seen, self.gold, after = np.zeros((3, 3), np.int64), np.zeros((len(sets), 3), np.int64), np.ones(len(gold), bool)
        after[begin] = False
        after = np.flatnonzero(after)
        np.add.at(self.seen, (gold[after - 1], gold[after]), 1)
        np.add.at(self.gold, (seq, gold), 1)
        self.sets, self.pages = {}, []
        return self

    def posteriors(self, own: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(scores of the sets, probabilities of labels before and after the pair that ends at each line, those of the lines' labels,
        what the likelihood is scaled by)."""
        e = np.add.reduceat(own[self.ids], self.starts, axis=0)
        x, m = np.ascontiguousarray(np.exp(e - e.max(1)[:, None]).T)[:, self.seq], np.exp(pairs - pairs.max())
        fwd, bwd, step, before, scale = np.empty_like(x), np.ones_like(x), np.zeros_like(x), np.zeros_like(x), np.empty(len(self.seq))
        begin = [0, *np.cumsum(self.left).tolist()]
        for t, k in enumerate(self.left):
            i = slice(begin[t], begin[t] + k)
            f = x[:, i]
            if t:
                p = before[:, i] = fwd[:, begin[t - 1] : begin[t - 1] + k]
                f = (m[0, :, None] * p[0] + m[1, :, None] * p[1] + m[2, :, None] * p[2]) * f
            scale[i] = f[0] + f[1] + f[2]
            fwd[:, i] = f / scale[i]
        for t in range(len(self.left) - 1, 0, -1):
            i = slice(begin[t], begin[t + 1])
            g = step[:, i] = x[:, i] * bwd[:, i] / scale[i]
            bwd[:, begin[t - 1] : begin[t - 1] + self.left[t]] = m[:, :1] * g[0] + m[:, 1:2] * g[1] + m[:, 2:] * g[2]
        return e, before, step, fwd * bwd, scale

    def sums(self, own: np.ndarray, pairs: np.ndarray, variances: bool = False) -> tuple[int, np.ndarray, np.ndarray, np.ndarray | int]:
        """Units of what the likelihood's logarithm lacks, of its gradient by the weights of self.names and of pairs, and
        of the variances of labels by the weights of self.names, if wanted."""
        whole = lambda x: np.rint(x * UNIT)
        e, before, step, p, scale = self.posteriors(own, pairs)
        top, high, m = e.max(1), pairs.max(), np.exp(pairs - pairs.max())
        by_name = lambda x: np.stack([np.bincount(self.ids, x[self.of, k], len(self.names)) for k in range(3)], 1).astype(np.int64)
        by_set = lambda x: np.stack([np.bincount(self.seq, x[k], len(e)) for k in range(3)], 1)
        grad, spread_ = by_name(by_set(whole(p)) - self.gold * UNIT), by_name(by_set(whole(p * (1 - p)))) if variances else 0
        joint = np.array([[whole(before[a] * step[b] * m[a, b]).sum() for b in range(3)] for a in range(3)]).astype(np.int64)
        fixed = lambda x: whole(x).astype(np.int64)
        value = fixed(np.log(scale)).sum() + (fixed(top) * self.gold.sum(1)).sum() - (fixed(e) * self.gold).sum() + (fixed(high - pairs) * self.seen).sum()
        return int(value), grad, joint - self.seen * UNIT, spread_

    def products(self, own: np.ndarray, pairs: np.ndarray) -> np.ndarray:
        """The pages' gradients multiplied with each other, by the weights of self.names and of pairs, in units of FINE * FINE."""
        _, before, step, p, _ = self.posteriors(own, pairs)
        m, page = np.exp(pairs - pairs.max()), np.concatenate([np.arange(k) for k in self.left])
        off = p - np.eye(3)[:, self.labels]
        many = np.diff([*self.starts, len(self.ids)])[self.seq]
        line = np.repeat(np.arange(len(self.seq)), many)
        name = self.ids[np.arange(len(line)) + np.repeat(self.starts[self.seq] - np.cumsum(many) + many, many)]
        own_ = [np.bincount(page[line] * len(self.names) + name, off[k][line], self.left[0] * len(self.names)).reshape(-1, len(self.names)) for k in range(3)]
        later = np.arange(len(self.seq)) >= self.left[0]
        was = np.concatenate([np.zeros(self.left[0], np.int64), *(self.labels[b : b + k] for b, k in zip(np.cumsum([0, *self.left]), self.left[1:]))])
        pair = [np.bincount(page, (before[a] * step[b] * m[a, b] - (was == a) * (self.labels == b)) * later, self.left[0]) for a in range(3) for b in range(3)]
        g = np.rint(np.concatenate([np.stack(own_, 2).reshape(self.left[0], -1), np.stack(pair, 1)], 1) * FINE)
        return g.T @ g


def sums_and_variances(blocks: Iterable[Block], names: dict[str, int], w: np.ndarray, wanted: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """The sums of all blocks in the order of the weights, the value first; and the variances of labels, if wanted, by all but the last weights."""
    own, pairs = w[:-9].reshape(-1, 3), w[-9:].reshape(3, 3)
    out, variances = np.zeros(1 + len(w), np.int64), np.zeros(len(w) - 9, np.int64)
    for b in blocks:
        at = [names[x] for x in b.names]
        value, grad, joint, spread_ = b.sums(own[at], pairs, wanted)
        out[0] += value
        out[1:-9].reshape(-1, 3)[at] += grad
        out[-9:] += joint.ravel()
        variances.reshape(-1, 3)[at] += spread_
    return out, variances


def products_of(blocks: Iterable[Block], names: dict[str, int], w: np.ndarray) -> np.ndarray:
    """The sum over all pages of their gradients multiplied with each other: the second derivatives, about, near the least loss."""
    own, pairs = w[:-9].reshape(-1, 3), w[-9:].reshape(3, 3)
    out = np.zeros((len(w), len(w)))
    for b in blocks:
        at = np.array([names[x] for x in b.names])
        at = np.concatenate([(3 * at[:, None] + np.arange(3)).ravel(), np.arange(len(w) - 9, len(w))])
        out[np.ix_(at, at)] += b.products(own[at[:-9:3] // 3], pairs)
    return out / FINE**2


def total_sums(blocks: Iterable[Block], names: dict[str, int], w: np.ndarray) -> np.ndarray:
    """The sums of all blocks in the order of the weights, the value first."""
    return sums_and_variances(blocks, names, w, False)[0]


def loss_of(sums: Callable[[np.ndarray], np.ndarray], ridge: float) -> Callable[[np.ndarray], tuple[float, np.ndarray]]:
    """The penalised loss with its gradient, from sums for weights."""
    def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
        s = sums(w) / UNIT
        return float(s[0] + ridge / 2 * (w @ w)), s[1:] + ridge * w

    return loss


def labeller_of(names: dict[str, int], w: np.ndarray) -> Labeller:
    return Labeller(names, w[:-9].reshape(-1, 3), w[-9:].reshape(3, 3))


def chain(pages: list[tuple[list[list[str]], list[int]]], ridge: float = 0.3) -> Labeller:
    """The random field's weights of greatest penalised likelihood, for (features of the lines, their labels) of pages."""
    block = Block()
    for feats, gold in pages:
        block.add(feats, gold)
    if not block.lines:
        return Labeller()
    names = {x: i for i, x in enumerate(sorted(block.packed().names))}
    return labeller_of(names, minimum(loss_of(lambda w: total_sums([block], names, w), ridge), np.zeros(3 * len(names) + 9)))


@lru_cache(1024)
def _split(paragraph: str) -> tuple[str, list[str], list[int]]:
    """A paragraph with its words one space apart, its words, and where the word after each begins."""
    words = paragraph.split()
    return " ".join(words), words, list(accumulate([len(w) + 1 for w in words]))


def made_page(paragraphs: list[str], titles: list[str], rnd: random.Random) -> tuple[list[str], list[int | None]]:
    """A clean text wrapped and cut into pages with furniture between them, with labels; blank lines have none.

    Paragraphs are set apart by a blank line, by an indentation, or only by where their last line ends.
    """
    width, lines, apart = rnd.randint(40, 72), [], rnd.choices(("blank", "indent", "nothing"), (6, 2, 1))[0]
    for p in paragraphs:
        begin = len(lines)
        if rnd.random() < 0.25:
            name = rnd.choice(titles).split(" ")[1 : rnd.randint(2, 3)] or ["Amt"]
            lines += [(f"{' '.join(name).title()}   {rnd.randint(10, 99999)}", BODY), (f"{rnd.randint(10, 999)},{rnd.randint(10, 99)}", BODY)]
        at = " " * rnd.randint(2, 5) if apart == "indent" else ""
        p, words, ends = _split(p)
        lo = i = 0  # the line begins there in the paragraph, with a word or the rest of one
        while i < len(words):
            j = max(i + 1, bisect_right(ends, width - len(at) + lo + 1))
            hi = ends[j - 1] - 1
            if j < len(words):
                room, word = width - len(at) - (hi - lo) - 2, words[j]
                if rnd.random() < 0.3 and 2 <= room < len(word) - 1 and word.isalpha():
                    lines.append((f"{at}{p[lo : hi + 1 + room]}-", BODY))
                    at, lo, i = "", hi + 1 + room, j
                    continue
            lines.append((at + p[lo:hi], BODY))
            at, lo, i = "", hi + 1, j
        if len(lines) > begin:
            lines[begin] = (lines[begin][0], BREAK)
        if apart == "blank":
            lines.append(("", None))
    while lines and lines[-1][1] is None:
        lines.pop()
    title, number, total = rnd.choice(titles), rnd.randint(1, 150), rnd.randint(1, 20)
    if rnd.random() < 0.3:
        title = title.upper()
    if rnd.random() < 0.2:
        title = f"SCAN_{rnd.randint(0, 99999):05d}"
    if rnd.random() < 0.25:
        title = " ".join(w for w in title.split()[1:] if w[:1].isupper() and w.isalpha())[:30] or title
    if rnd.random() < 0.25:
        title = title.lower()
    if rnd.random() < 0.05:
        title = f"{rnd.choice(['document', 'scan', 'IMG'])}{rnd.choice(['({})', '_{:05d}', '_{:05d}']).format(rnd.randint(1000, 9999))}"
    if rnd.random() < 0.1:
        title = f"{rnd.choice(['neu', 'Scan', 'IMG', 'doc'])} {rnd.randint(100, 9999)}"
    style = rnd.choice(["— {} —", "- {} -", "[{}]", "{}", "Page {}", "S. {}", "p. {}", "{} / " + str(total), "Page {} of " + str(total)])
    head, foot, join, far = rnd.random() < 0.7, rnd.random() < 0.75, rnd.random() < 0.35 and bool(re.search(r"\d", title)), rnd.random() < 0.2

    roman, feed = rnd.random() < 0.12, rnd.random() < 0.35
    if roman:
        number, style = rnd.randint(1, 30), "{}"

    def no() -> str:
        shown = str(number)
        if roman:
            shown = "x" * (number // 10) + ["", "i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix"][number % 10]
        elif rnd.random() < 0.1:
            shown = shown.translate(str.maketrans("105", "lOS"))
        return " " * (rnd.randint(5, 25) * far) + style.format(shown)

    out, left = [], rnd.randint(6, 20)
    if head and rnd.random() < 0.7:
        out.append((title, FURNITURE))
    if not foot and rnd.random() < 0.4:
        out.append((no(), FURNITURE))
    for line in lines:
        out.append(line)
        left -= 1
        if left <= 0:
            if rnd.random() < 0.25:
                out.append(("", None))
            number += 1
            if foot:
                out.append((no(), FURNITURE))
                if rnd.random() < 0.25:
                    out.append(("", None))
            if head:
                out.append((f"{title}{' ' * rnd.randint(2, 10)}{number}" if join else title, FURNITURE))
                if not foot and not join and rnd.random() < 0.5:
                    out.append((no(), FURNITURE))
            if feed:  # the form feed comes before the first line of the new page
                k = next((k for k in range(len(out) - 1, -1, -1) if out[k][1] in (BODY, BREAK)), 0) + 1 + bool(foot)
                while k < len(out) and not out[k][0].strip():
                    k += 1
                if k < len(out):
                    out[k] = ("\f" + out[k][0], out[k][1])
            left = rnd.randint(8, 24)
    if foot and rnd.random() < 0.6:
        out.append((no(), FURNITURE))
    return [a for a, _ in out], [b for _, b in out]


def prose(text: str) -> list[str]:
    """The paragraphs of a text whose lines are paragraphs."""
    return [p.strip(" #*->") for p in text.split("\n") if len(p) > 60]


def made_pages(texts: list[str], each: int, rnd: random.Random) -> list[tuple[list[str], list[int | None]]]:
    pages = []
    for ps in filter(None, map(prose, texts)):
        names = [w for p in ps for w in re.findall(r"(?<=[a-zа-я] )[A-ZА-Я][a-zа-я]{3,}", p)] or ["Amt"]
        words = [w for p in ps for w in p.split()[1:3]] or ["Notiz"]
        titles = [f"{rnd.choice(words).capitalize()} {' '.join(rnd.choice(names) for _ in range(rnd.randint(1, 2)))} {rnd.randint(1990, 2026)}" for _ in range(3)]
        pages += [made_page(ps, titles, rnd) for _ in range(each)]
    return pages


def training_pages(texts: list[str], rnd: random.Random) -> Iterator[tuple[list[list[str]], list[int]]]:
    """(features of the lines, their labels) of four pages made of each text."""
    for lines, gold in made_pages(texts, 4, rnd):
        feats = features(lines)
        if at := [i for i, y in enumerate(gold) if y is not None and feats[i]]:
            yield [feats[i] for i in at], [gold[i] for i in at]


def learn(texts: list[str], ridge: float = 0.3, seed: int = 7) -> Labeller:
    """The labeller from pages made of the texts, whose lines are paragraphs."""
    return chain(list(training_pages(texts, random.Random(seed))), ridge)


def learn_all(texts: DataFrame, ident: str, text: str, ridge: float = 0.3, lines: int = 200_000, together: int = 10_000) -> Labeller:
    """As learn(), from pages made of all texts that aren't wrapped; only sums for each set of weights come to the driver.

    The search begins at the weights for the pages of some texts, and ends at those for all; these are few enough for the driver.
    """
    drawn, n = F.pmod(F.xxhash64(ident, text), F.lit(1 << 40)), texts.count()
    some = lambda k: drawn % F.lit(max(1, n // k)) == 0
    rows = texts.select(F.col(text).alias("t"), drawn.alias("drawn"), F.when(some(BEGIN), 0).when(some(5 * BEGIN), 1).otherwise(2).alias("level"))

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def out(block: Block, level: int) -> pd.DataFrame:
            return pd.DataFrame({"names": [block.packed().names], "block": [pickle.dumps(block)], "level": [level], "lines": [block.lines]})

        blocks, pages, waiting = [Block() for _ in range(3)], [[] for _ in range(3)], [0] * 3
        for pdf in batches:
            for t, seed, level in zip(pdf["t"], pdf["drawn"], pdf["level"]):
                if not UNWRAPPED.search(t):
                    continue
                made = made_pages([t], 4, random.Random(seed))
                pages[level] += made
                waiting[level] += sum(len(gold) for _, gold in made)
                if waiting[level] >= together:
                    blocks[level].add_all(pages[level])
                    pages[level], waiting[level] = [], 0
                if blocks[level].lines >= lines:
                    yield out(blocks[level], level)
                    blocks[level] = Block()
        for level, block in enumerate(blocks):
            block.add_all(pages[level])
            if block.lines:
                yield out(block, level)

    blocks = checkpoint(rows.mapInPandas(pack, "names array<string>, block binary, level int, lines long"))
    names = {x: i for i, x in enumerate(sorted(r[0] for r in blocks.select(F.explode("names")).distinct().collect()))}
    size = {r.level: r.n for r in blocks.groupBy("level").agg(F.sum("lines").alias("n")).collect()}
    w, sc = np.zeros(3 * len(names) + 9), texts.sparkSession.sparkContext
    here: dict[int, list[Block]] = {0: [], 1: []}
    for r in blocks.where("level < 2").select("level", "block").collect():
        here[r.level].append(pickle.loads(r.block))
    few = here[0] or here[1]

    def there(w: np.ndarray, wanted: bool) -> tuple[np.ndarray, np.ndarray]:
        """The sums and variances of all blocks, also of those that aren't here."""
        shared = sc.broadcast((names, w))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            s = np.concatenate(sums_and_variances((pickle.loads(b) for pdf in batches for b in pdf["block"]), *shared.value, wanted))
            yield pd.DataFrame({"s": [s.tobytes()]})

        found = blocks.select("block").mapInPandas(run, "s binary").collect()
        shared.unpersist()
        s, v = np.split(sum((np.frombuffer(r.s, np.int64) for r in found), np.zeros(2 * len(w) - 8, np.int64)), [1 + len(w)])
        return s, v

    def onward(w: np.ndarray, of: Callable[[np.ndarray, bool], tuple[np.ndarray, np.ndarray]], few: list[Block], n: int) -> np.ndarray:
        """Where the loss over n lines is least, from w; of: their sums and variances; few: some of their pages."""
        variances = None

        def sums(w: np.ndarray) -> np.ndarray:
            nonlocal variances
            s, v = of(w, variances is None)
            variances = v if variances is None else variances  # those where the search begins
            return s

        def bend() -> np.ndarray:
            """Second derivatives at w: those over few pages, stretched by the labels' variances, which are known for all."""
            stretch = np.concatenate([np.sqrt(variances / (sums_and_variances(few, names, w)[1] + UNIT)), np.full(9, np.sqrt(n / sum(b.lines for b in few)))])
            return (products_of(few, names, w) + np.eye(len(w))) * stretch * stretch[:, None] + ridge * np.eye(len(w))

        return minimum(loss_of(sums, ridge), w, curvature=bend if few else None)

    if few:
        # few pages' weights are held back more than those of all, or rare features' would be too sure
        w = minimum(loss_of(lambda w: total_sums(few, names, w), 1.0 if len(size) > 1 else ridge), w)
    if len(few) < len(here[0] + here[1]):
        w = onward(w, lambda w, wanted: sums_and_variances(here[0] + here[1], names, w, wanted), few, size[0] + size[1])
    if 2 in size:
        w = onward(w, there, here[0] + here[1], sum(size.values()))
    return labeller_of(names, w)


def logistic(rows: list[tuple[list[str], bool, int]], ridge: float = 0.3) -> dict[str, float]:
    """Weights of features by a logistic regression on (features, label, how often)."""
    names: dict[str, int] = {}
    at = [[names.setdefault(x, len(names)) for x in f] for f, _, _ in rows]
    m, y, n = np.zeros((len(rows), len(names))), np.array([float(y) for _, y, _ in rows]), np.array([float(n) for *_, n in rows])
    for i, f in enumerate(at):
        m[i, f] = 1

    def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
        z = m @ w
        return float(n @ (np.logaddexp(0, z) - y * z) + ridge / 2 * (w @ w)), m.T @ (n * (1 / (1 + np.exp(-z)) - y)) + ridge * w

    w = minimum(loss, np.zeros(len(names)))
    return {x: float(w[i]) for x, i in names.items()}


class Pages:
    """Whether a text is a page: by a logistic regression on its layout, or if it has at least so many signs of scanning.

    Without training, signs alone decide.
    """

    SIGNS = 3

    def __init__(self, weights: dict[str, float] | None = None, enough: int = 2) -> None:
        self.w, self.enough = weights or {}, enough

    @staticmethod
    def layout(lines: list[str]) -> list[str]:
        s = [x.strip() for x in lines]
        f = ["bias", f"width {min(usual_width(s) // 6, 20)}"]
        f += ["one line"] * (len(lines) == 1)
        f += ["mail"] * bool(re.match(r"(From|To|Subject|Date): ", lines[0]))
        f += ["markup"] * any(x.startswith(("# ", "## ", "> ")) for x in lines)
        return f

    def by_layout(self, lines: list[str]) -> bool:
        return sum(self.w.get(x, 0.0) for x in self.layout(lines)) > 0

    @classmethod
    def learn(cls, said: list[tuple[list[str], bool, int]]) -> Pages:
        """From (layout, whether said to be a page, how often)."""
        return cls(logistic(said)) if len({y for _, y, _ in said}) == 2 else cls()

    def bounded(self, said: int, other: dict[int, int]) -> None:
        """As many signs are enough as not one in five hundred texts has that is no page by its layout.

        said: of how many texts it is said whether they are pages; other: how many texts that are none by layout have so many signs.
        """
        if said >= 500:
            self.enough = next((k for k in range(1, self.SIGNS) if sum(c for n, c in other.items() if n >= k) < 0.002 * sum(other.values())), self.SIGNS)


class Reader:
    """Verdicts on lines and words, from the labeller and the lexicon."""

    RATIO = 25
    REMEMBERED = 200_000

    def __init__(self, labeller: Labeller, lexicon: dict[str, int], rare: dict[str, int] | None = None, pages: Pages | None = None) -> None:
        self.labeller, self.lexicon, self.rare, self.pages, self.known = labeller, lexicon, rare or {}, pages or Pages(), {}
        self.doubtful: dict[str, tuple] = {}
        self.right: set[str] = set()  # tokens that are no sign
        self.sure: set[str] = set()  # tokens without a word that may be misread
        self.undo = defaultdict(list)
        for right, seen in MISREAD:
            self.undo[seen[0]].append((seen, right))

    def __getstate__(self) -> dict:
        return self.__dict__ | {"known": {}, "doubtful": {}, "right": set(), "sure": set()}

    def scanned(self, lines: list[str]) -> bool:
        """Whether the text is a page, by its layout or by the signs of scanning in it."""
        return self.pages.by_layout(lines) or self.signs(lines, self.pages.enough) >= self.pages.enough

    def signs(self, lines: list[str], enough: int) -> int:
        """How many signs of scanning there are, counted until there are enough.

        Signs are page numbers between the lines, short lines that come again beside them, words broken
        at line ends and misread words.
        """
        text = "\n".join(lines).lower()
        signs = 0
        if len(self.right) > self.REMEMBERED:
            self.right.clear()
        for token in set(text.split()) - self.right:
            if any(self.correct(w) is not None for w in self.doubts(token)):
                signs += 1
            else:
                self.right.add(token)
            if signs >= enough:
                return signs
        here, numbers = None, []
        for i, x in enumerate(lines):
            x = x.strip()
            if 0 < len(x) < 40 and i and DIGIT.search(x) and PAGE.match(x) and not FIGURES.match(x):
                numbers.append(i)
            elif x and x[-1] in HYPHENS and i + 1 < len(lines) and (m := HYPHEN_END.search(x)) and (first := re.match(r"[\w@$'’]+", lines[i + 1].lstrip())):
                here = here or Counter(WORD.findall(text) + compounds(text))
                a, b = m.group(1).split("'")[-1].split("’")[-1], first.group()
                signs += x[-1] in "­¬" or (self.count((a + b).lower()) > 0 and self.broken(a, b, here))
        if numbers:
            signs += sum(y == FURNITURE for y in map(self.labeller(lines).__getitem__, numbers))
            signs += sum(n > 1 and len(k) > 3 and not k.isdigit() for k, n in repeated([x.strip() for x in lines]).items())
        return signs

    def undone(self, w: str) -> set[str]:
        return {w[:i] + right + w[i + len(seen) :] for i in range(len(w)) for seen, right in self.undo.get(w[i], ()) if w.startswith(seen, i)}

    def correct(self, w: str) -> str | None:
        """What a misread word most likely was, itself if it is misread but not known, else null."""
        if (x := self.known.get(w, "")) != "":
            return x
        if len(self.known) > self.REMEMBERED:
            self.known.clear()
        x = self.known[w] = self.most_likely(w, self.count(w))
        return x

    def doubts(self, token: str) -> tuple:
        """The words of a token that may be misread, whatever else is in the text."""
        if (x := self.doubtful.get(token)) is None:
            if len(self.doubtful) > self.REMEMBERED:
                self.doubtful.clear()
                self.sure.clear()
            ws = [w for w in WORD.findall(token) if not w.isdigit()]
            x = self.doubtful[token] = tuple(w for w in ws if self.correct(w) is not None or (len(w) > 4 and w not in self.lexicon))
            if not x:
                self.sure.add(token)
        return x

    def misread(self, w: str, here: Counter) -> str | None:
        """What a word most likely was if it is misread, also by what else is in the text; else null."""
        c = self.correct(w)
        if c is None and len(w) > 4 and w not in self.lexicon:
            c = next((u for u in sorted(self.undone(w)) if here[u] > here[w] or (here[u] and not w.isalpha())), None)
        return c

    def count(self, w: str) -> int:
        return self.lexicon.get(w) or self.rare.get(w, 0)

    def hangs_on(self, w: str, n: int) -> bool:
        """Whether a word under the lexicon's floor is judged otherwise with its own count n than with none."""
        return self.most_likely(w, n) != self.most_likely(w, 0)

    def most_likely(self, w: str, own: int) -> str | None:
        """Correct, for a word with a count of own."""
        x = None
        mixed = bool(re.search(r"[^\W\d_][\d@$|]+[^\W\d_]|[ﬁﬂﬀﬃﬄ@$]", w)) or bool(re.search(r"[a-z]", w) and re.search(r"[а-яё]", w))
        odd = mixed or bool(re.search(r"[^\W\d_]{2}[\d@$|]$|^[\d@$|][^\W\d_]{2}", w))
        one = self.undone(w) if not w.isdigit() and len(w) > 1 else set()
        best = max(one, key=lambda c: self.lexicon.get(c, 0), default="")
        if self.lexicon.get(best, 0) >= (self.RATIO if len(w) < 6 else self.RATIO // 4) * max(1, own):
            x = best
        elif (w not in self.lexicon or odd) and one and len(w) > 4:
            two = {d for c in one for d in self.undone(c)}
            best = max(two, key=lambda c: self.lexicon.get(c, 0), default="")
            if self.lexicon.get(best, 0) >= self.RATIO * 4 * (1 if w in self.lexicon else max(1, own)):
                x = best
        if x is None and mixed:
            x = w
        return x

    def broken(self, left: str, right: str, here: Counter) -> bool:
        """Whether left and right, parted at a line end, are one word without a hyphen."""
        if not right or not (right[0].islower() or (left.isupper() and right[0].isupper())):
            return False
        a, b = left.lower(), right.lower()
        joined = self.count(a + b) + here[a + b]
        real = max(self.count(f"{a}-{b}"), here[f"{a}-{b}"])
        if real and real >= joined:
            return False
        fixed = self.correct(a) or a
        return joined > 0 or not self.count(f"{fixed}-{self.correct(b) or b}")

    def read(self, text: str, rebuild: bool = True) -> tuple[list[tuple[int, str]], list[str]]:
        """((line, kind) cases, the paragraphs put together, if wanted)."""
        lines = text.split("\n")
        if not self.scanned(lines):
            return [], [] if not rebuild else [" ".join(p.split()) for p in re.split(r"\n\s*\n", text) if p.strip()]
        labels = self.labeller(lines)
        cases = [(i + 1, "furniture") for i, y in enumerate(labels) if y == FURNITURE]
        running = [i for i, y in enumerate(labels) if y in (BODY, BREAK)]
        all_ = "\n".join(lines[i] for i in running).lower()
        here = Counter(WORD.findall(all_))
        here.update(compounds(all_))
        cut: set[int] = set()
        for i, j in zip(running, running[1:]):
            if lines[i].rstrip(" \t")[-1:] in HYPHENS and (m := HYPHEN_END.search(lines[i])):
                first = re.match(r"[\w@$'’]+", lines[j].lstrip())
                if lines[i].rstrip()[-1] in "­¬" or (first and self.broken(m.group(1).split("'")[-1].split("’")[-1], first.group(), here)):
                    if first:
                        cut.add(i)
                        cases.append((i + 1, "hyphen"))
        # words as they are in the running text, with the lines they touch
        pieces, misread, out = [], set(), []
        for n, i in enumerate(running):
            body = lines[i].strip()
            if i in cut:
                body = HYPHEN_END.sub(lambda m: m.group(1), body)
            pieces.append((i, body, i in cut))
        para: list[str] = []
        skip = 0
        for n, (i, body, goes_on) in enumerate(pieces):
            text_line = body[skip:] if skip else body
            tail = ""
            skip_next = 0
            if goes_on and n + 1 < len(pieces):
                first = re.match(r"[\w@$'’]+", pieces[n + 1][1])
                tail = first.group() if first else ""
                skip_next = len(tail)
            whole = text_line + tail
            if not tail:
                tokens = whole.lower().split()
                if not self.sure.issuperset(tokens) and any(self.misread(w, here) for token in tokens for w in self.doubts(token)):
                    misread.add(i)
            else:
                for m in WORD.finditer(whole):
                    w = m.group().lower()
                    if w.isdigit() or (c := self.misread(w, here)) is None:
                        continue
                    if m.end() <= len(text_line):
                        misread.add(i)
                    else:  # the wrong character is in the part that differs
                        part = len(text_line) - m.start()
                        k = next((p for p in range(min(len(c), len(w))) if c[p] != w[p]), min(len(c), len(w)) - 1)
                        misread.add(i if k < part else pieces[n + 1][0])
            skip = skip_next
            if not rebuild:
                continue
            fixed = WORD.sub(self._fix, whole) if any(map(self.doubts, whole.lower().split())) else whole
            if n and labels[i] == BREAK and para and not pieces[n - 1][2]:
                out.append(" ".join(para))
                para = []
            if fixed.strip():
                if para and para[-1][-1] in "-‐" and COMPOUND_END.search(para[-1]):  # a hyphen that belongs to the word
                    para[-1] += fixed.strip()
                else:
                    para.append(fixed.strip())
        if para:
            out.append(" ".join(para))
        cases += [(i + 1, "glyph") for i in misread]
        return cases, [" ".join(p.split()) for p in out]

    def _fix(self, m: re.Match) -> str:
        w = m.group()
        c = self.correct(w.lower())
        if not c or c == w.lower():
            return w
        return c.upper() if w.isupper() and len(w) > 1 else c[0].upper() + c[1:] if w[0].isupper() else c


def word_counts(df: DataFrame, text: str) -> DataFrame:
    """(word, n, parted) over all texts: lower-cased words, and those with hyphens inside; parted tells of words that
    may be meant where a line ends with a hyphen, as one word and with the hyphen (n may be 0)."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            n: Counter = Counter()
            parted: set[str] = set()
            for t in pdf["t"]:
                low = t.lower()
                n.update(PLAIN.findall(low))
                if "-" in low or "‐" in low:
                    n.update(compounds(low))
                    for m in PARTED.finditer(low):
                        if a := LAST.search(low[max(0, m.start() - 60) : m.start()]):
                            parted |= {a.group() + m.group(1), f"{a.group()}-{m.group(1)}"}
            if n:
                words = list(n.keys() | parted)
                yield pd.DataFrame({"word": words, "n": [n[w] for w in words], "parted": [w in parted for w in words]})

    rows = df.select(F.col(text).alias("t")).mapInPandas(run, "word string, n long, parted boolean")
    return rows.groupBy("word").agg(F.sum("n").alias("n"), F.max("parted").alias("parted"))


def rare_counts(counts: DataFrame, lexicon: dict[str, int], floor: float) -> dict[str, int]:
    """Counts under the floor on which a verdict hangs: those of words that may be parted at a line end, and of
    words that would be taken for a misread one if they had none."""
    shared = counts.sparkSession.sparkContext.broadcast(Reader(Labeller(), lexicon))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf[[bool(p) or shared.value.hangs_on(w, n) for w, n, p in zip(pdf["word"], pdf["n"], pdf["parted"])]][["word", "n"]]

    few = counts.where((F.col("n") >= 2) & (F.col("n") < floor))
    return {r.word: r.n for r in few.mapInPandas(run, "word string, n long").collect()}


def reader_for(df: DataFrame, ident: str, text: str, source: str | None = None, share: float = SHARE) -> Reader:
    """The lexicon and the models over all texts.

    The labeller learns from all texts that aren't wrapped; what a page is by its layout is learned from all
    texts by their source. Without a source only signs of scanning tell.
    """
    counts = checkpoint(word_counts(df, text))
    floor = max(2, (counts.agg(F.sum("n")).first()[0] or 0) * share)
    lexicon = {r.word: r.n for r in counts.where(F.col("n") >= floor).select("word", "n").collect()}
    rare = rare_counts(counts, lexicon, floor) if floor > 2 else {}
    reader = Reader(learn_all(df, ident, text), lexicon, rare)
    said = F.lower(F.trim(source)).isin(*RECOGNISED) if source else F.lit(None).cast("boolean")
    reader.pages = page_model(reader, df.select(F.col(text).alias("t"), said.alias("said")).where(F.col("t").rlike(r"\S")))
    return reader


def page_model(reader: Reader, texts: DataFrame) -> Pages:
    """From all texts (t) with what is said of them (said), which may be null; only counts come to the driver."""
    def layouts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = Counter((tuple(Pages.layout(t.split("\n"))), bool(said)) for pdf in batches for t, said in zip(pdf["t"], pdf["said"]))
        yield pd.DataFrame([(list(f), said, c) for (f, said), c in n.items()], columns=["layout", "said", "n"])

    rows = texts.where("said IS NOT NULL").mapInPandas(layouts, "layout array<string>, said boolean, n long").groupBy("layout", "said").agg(F.sum("n").alias("n")).collect()
    pages = Pages.learn(sorted((list(r.layout), r.said, r.n) for r in rows))
    shared = texts.sparkSession.sparkContext.broadcast((reader, pages))

    def signs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        (reader, pages), n = shared.value, Counter()
        for pdf in batches:
            for lines in (t.split("\n") for t in pdf["t"]):
                if not pages.by_layout(lines):
                    n[min(reader.signs(lines, Pages.SIGNS - 1), Pages.SIGNS - 1)] += 1
        yield pd.DataFrame(list(n.items()), columns=["signs", "n"])

    if (said := sum(r.n for r in rows)) >= 500:
        other = texts.select("t").mapInPandas(signs, "signs long, n long").groupBy("signs").agg(F.sum("n").alias("n")).collect()
        pages.bounded(said, {r.signs: r.n for r in other})
    return pages


def _texts(df: DataFrame, ident: str, text: str, source: str | None) -> DataFrame:
    rows = df.where(F.col(ident).isNotNull() & F.col(text).isNotNull())
    return spread(rows.select(F.col(ident).alias("id"), F.col(text).alias("t"), *([F.col(source).alias("source")] if source else [])))


def line_cases(df: DataFrame, ident: str, text: str, source: str | None = None) -> DataFrame:
    """(id, line_no, kind) for every line of furniture, broken word or misread character.

    Lines are counted from 1. source: a column that names the extractor; it is used to learn what a page
    is, not to decide on its own. Null and empty texts, and texts that are no pages, give no row. Repeated
    rows count once. An empty table gives an empty result.
    """
    texts = _texts(df, ident, text, source)
    shared = df.sparkSession.sparkContext.broadcast(reader_for(texts, "id", "t", source and "source"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([(i, *c) for i, t in zip(pdf["id"], pdf["t"]) for c in shared.value.read(t, False)[0]], columns=["id", "line_no", "kind"])

    return texts.select("id", "t").mapInPandas(run, f"id {df.schema[ident].dataType.simpleString()}, line_no long, kind string").distinct()


def repaired(df: DataFrame, ident: str, text: str, source: str | None = None) -> DataFrame:
    """(id, para_no, text): the continuous paragraphs, words joined, furniture out, known misreadings set right.

    Repeated rows count once; they are taken out before the texts are read, so that paragraphs aren't moved.
    """
    texts = _texts(df, ident, text, source)
    shared = df.sparkSession.sparkContext.broadcast(reader_for(texts, "id", "t", source and "source"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for lo in range(0, len(whole), 500):
                pdf = whole.iloc[lo : lo + 500]
                yield pd.DataFrame([(i, n, p) for i, t in zip(pdf["id"], pdf["t"]) for n, p in enumerate(shared.value.read(t)[1], 1)], columns=["id", "para_no", "text"])

    return spread(distinct_rows(texts.select("id", "t"), "id")).mapInPandas(run, f"id {df.schema[ident].dataType.simpleString()}, para_no long, text string")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return line_cases(table(spark, d, "content"), "document_id", "text", "source").withColumnRenamed("id", "document_id")


def p1_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    """The repaired text of every document as paragraphs."""
    return repaired(table(spark, d, "content"), "document_id", "text", "source").withColumnRenamed("id", "document_id")


SQL: dict[str, str] = {}
QUERIES = {"p1_found": p1_found, "p1_paragraphs": p1_paragraphs}
