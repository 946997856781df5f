"""Garbled text from a wrong character encoding: finding and restoring it (problem 9).

Wrong decoding shows in the tokens that aren't pure ASCII. A smoothed character trigram model is trained
on clean records; every distinct token that the model finds unlikely is put through every chain of
encoding and decoding, and the gains in log-likelihood are summed per record and chain. The likeliest
chain is accepted if its gain passes the margin of its family (UTF-8 read as something else, or one byte
for another). Where no chain helps (replacement characters, garbling followed by lower-casing) a record
counts as garbled, but lost, if its tokens are too unlikely by themselves.

Counts of the model come from all records but those held out, a fifth by a hash of their id and text; tokens are
judged once for all records, and what is found of the commonest is handed to every task.

All bounds are validated on all held-out records: margins by the gains of tokens garbled on purpose (what would
be missed) and by those of clean records (what would be found wrongly), the bound of the unlikely by
clean records. Wrong decoding that leaves pure ASCII, such as question marks, isn't looked for.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import checkpoint, spread, table

READY = 20_000  # tokens whose scores are handed to the tasks; the others are scored there
TOKEN = re.compile(r"[^ \t\r\n]{1,200}")  # longer runs are looked at piece by piece
# Single-byte encodings, as Python names them.
SINGLE = ["cp1252", "cp1250", "cp1251", "cp437", "cp850", "cp852", "cp866", "iso8859-2", "iso8859-5", "koi8-r", "mac-roman", "mac-cyrillic"]


def _bytes_of(encoding: str) -> dict[str, int]:
    """Non-ASCII characters to their byte; bytes an encoding leaves open stand for the control of that number."""
    out = {chr(b): b for b in range(128, 256)} if encoding in ("cp1252", "iso8859-2", "iso8859-5") else {}
    for b in range(128, 256):
        try:
            out[bytes([b]).decode(encoding)] = b
        except UnicodeDecodeError:
            out.setdefault(chr(b), b)
    return out


RUN = re.compile(r"[^\x00-\x7f]+")
SEQUENCE = re.compile(rb"[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3}")


def utf8_under(encoding: str, lowered: bool = False) -> Callable[[str], str]:
    """Undo UTF-8 read as a single-byte encoding; with lowered, if it was lower-cased afterwards."""
    table, chars = _bytes_of(encoding), {b: c for c, b in reversed(list(_bytes_of(encoding).items()))}
    raise_to = {b: table[u] for b, c in chars.items() if len(u := c.upper()) == 1 and u in table and u != c}

    def run(m: re.Match) -> str:
        s = m.group()
        raw = bytes(table.get(c, 0) for c in s)
        out, at = [], 0
        if lowered:
            lifted = bytearray(raw)
            for i in range(len(lifted) - 1):
                if lifted[i] in raise_to and 0xC2 <= raise_to[lifted[i]] <= 0xDF and 0x80 <= lifted[i + 1] <= 0xBF and (i == 0 or lifted[i - 1] < 0xC2):
                    lifted[i] = raise_to[lifted[i]]
            raw = bytes(lifted)
        for q in SEQUENCE.finditer(raw):
            try:
                c = q.group().decode("utf-8")
            except UnicodeDecodeError:
                continue
            out += [s[at : q.start()], c]
            at = q.end()
        return "".join([*out, s[at:]])

    return lambda t: RUN.sub(run, t)


def _others(wrong: str, right: str) -> dict[int, str]:
    """Characters in the encoding right by those that were read as wrong."""
    to = {}
    for c, b in _bytes_of(wrong).items():
        try:
            to[ord(c)] = bytes([b]).decode(right)
        except UnicodeDecodeError:
            pass
    return to


def reread(wrong: str, right: str) -> Callable[[str], str]:
    """Undo a text in the encoding right that was read as wrong; other characters stay."""
    to = _others(wrong, right)
    return lambda t: t.translate(to)


REREAD = {f"{r} as {w}": (w, r) for w in SINGLE for r in SINGLE if w != r}


@lru_cache(1)
def _tables() -> list[dict[int, str]]:
    return [_others(*x) for x in REREAD.values()]


@lru_cache(20_000)
def _swapped(c: str) -> tuple[str, ...]:
    """What a character is by each chain of REREAD."""
    return tuple(to.get(ord(c), c) for to in _tables())


def rereadings(token: str) -> dict[str, list[str]]:
    """What a token is by the chains of REREAD that change it, with their names; chains that agree are tried once."""
    chars = [c for c in dict.fromkeys(token) if not c.isascii()]
    alike = defaultdict(list)
    for name, to in zip(REREAD, zip(*map(_swapped, chars))):
        alike[to].append(name)
    alike.pop(tuple(chars), None)
    return {token.translate(dict(zip(map(ord, chars), to))): names for to, names in alike.items()}


def chains() -> dict[str, Callable[[str], str]]:
    """All candidate chains by name."""
    one = {f"utf-8 as {e}": lru_cache(10_000)(utf8_under(e)) for e in SINGLE}
    twice = {f"{a}, again {b}": (lambda t, f=f, g=g: g(f(t))) for a, f in one.items() for b, g in one.items() if a == b or "cp1252" in a + b}
    low = {f"utf-8 as {e}, lower-cased": utf8_under(e, True) for e in SINGLE}
    return one | twice | low | {name: reread(*x) for name, x in REREAD.items()}


def folded(token: str) -> str:
    """Wide forms to plain ones, invisible characters dropped: not what wrong decoding makes."""
    if any("＀" <= c <= "￯" or "̀" <= c <= "ͯ" for c in token):
        token = unicodedata.normalize("NFKC", token)
    return token.replace("­", "").replace("⁠", "").replace("​", "").replace("﻿", "")


class Trigrams:
    """Interpolated character trigrams over tokens between blanks."""

    WEIGHTS = (0.7, 0.22, 0.07)

    def __init__(self, tokens: Counter) -> None:
        self.three, self.two, self.one, self.ctx2, self.ctx1 = Counter(), Counter(), Counter(), Counter(), Counter()
        for t, n in tokens.items():
            t = folded(t)
            for u, k in ((t, n), (t.upper(), n * 0.01)):  # a little of it in capitals
                u = f"  {u} "
                for i in range(2, len(u)):
                    self.three[u[i - 2 : i + 1]] += k
                    self.ctx2[u[i - 2 : i]] += k
                    self.two[u[i - 1 : i + 1]] += k
                    self.ctx1[u[i - 1]] += k
                    self.one[u[i]] += k
        self.total = sum(self.one.values()) or 1
        self.logs: dict[str, float] = {}

    @classmethod
    def of(cls, three: dict[str, float]) -> Trigrams:
        """From counts of trigrams; all others are sums of them."""
        model = cls(Counter())
        for g, k in three.items():
            for counts, part in ((model.three, g), (model.ctx2, g[:2]), (model.two, g[1:]), (model.ctx1, g[1]), (model.one, g[2])):
                counts[part] += k
        model.total = sum(model.one.values()) or 1
        return model

    def log(self, g: str) -> float:
        if (x := self.logs.get(g)) is None:
            a, b, c = self.WEIGHTS
            p = a * self.three[g] / max(self.ctx2[g[:2]], 20) + b * self.two[g[1:]] / max(self.ctx1[g[1]], 20) + c * self.one[g[2]] / self.total + 1e-7
            x = self.logs[g] = math.log(p)
            if len(self.logs) > 500_000:
                self.logs.clear()
        return x

    def score(self, token: str) -> float:
        get, log = self.logs.get, self.log
        return sum([x if (x := get(g := u[i - 2 : i + 1])) is not None else log(g) for p in token.split("\xa0") for u in (f"  {p} ",) for i in range(2, len(u))])

    def beyond(self, token: str) -> list[float]:
        """Log-probabilities of the trigrams that touch a character beyond ASCII; a hard space parts tokens."""
        parts = [f"  {p} " for p in token.split("\xa0") if not p.isascii()]
        return [self.log(u[i - 2 : i + 1]) for u in parts for i in range(2, len(u)) if not u[i - 2 : i + 1].isascii()]


class Judge:
    """Scores of tokens, kept per distinct token, and the verdict on a text.

    margins: by family of chains; lost: the bound of unlikeliness; plain: the log-probability under which a
    trigram isn't usual. They are set by validate(); rates then holds the error rates found there.
    """

    def __init__(self, model: Trigrams, margins: tuple[float, float] = (8.0, 16.0), lost: float = 30.0, plain: float = -7.0) -> None:
        self.model, self.margins, self.lost, self.plain = model, margins, lost, plain
        self.chains, self.rank, self.seen, self.ready = None, {}, {}, {}
        self.rates: dict[str, float] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"chains": None, "seen": {}}

    def token(self, t: str) -> tuple[float, dict[str, float]] | None:
        """None for a likely token, else (how unlikely beyond the usual, gain by chain)."""
        if self.chains is None:
            self.chains = chains()
            self.rank = {n: i for i, n in enumerate(self.chains)}
        if (x := self.seen.get(t, self)) is not self:
            return x
        if t in self.ready:
            x = self.seen[t] = unpacked(self, self.ready[t])
            return x
        if len(self.seen) > 300_000:
            self.seen.clear()
        f, x = folded(t), None
        logs = [] if f.isascii() else self.model.beyond(f)
        if min(logs, default=0.0) < self.plain:
            own = self.model.score(f)
            gains = {}
            for r, names in self.undone(t).items():
                if (g := self.model.score(r) - own) > 0:
                    gains |= dict.fromkeys(names, g)
            x = (sum(max(0.0, self.plain - p) for p in logs), gains)
        self.seen[t] = x
        return x

    def undone(self, t: str) -> dict[str, list[str]]:
        """What a token is by the chains that change it, with their names."""
        out = rereadings(t)
        for name, chain in self.chains.items():
            if name not in REREAD and (r := chain(t)) != t:
                out.setdefault(r, []).append(name)
        return out

    @staticmethod
    def family(chain: str) -> int:
        """0: UTF-8 read as a single-byte encoding; 1: one byte for another, which fits by chance more easily."""
        return 0 if chain.startswith("utf-8") else 1

    def weigh(self, text: str | None) -> tuple[tuple[tuple[str, float], tuple[str, float]], float]:
        """(for each family its best chain and that one's gain; unlikeliness beyond the usual of the unlikeliest run of tokens, or of all).

        A run is as long as a token adds over half a unit on average, wherever it lies; its number of tokens
        doesn't depend on how long the text around it is.
        """
        total, deficit, run, over, every = defaultdict(float), 0.0, 0.0, 0.0, 0.0
        tokens = beyond_ascii(text or "")
        for t in tokens:
            x = self.token(t)
            every += x[0] if x is not None else 0.0
            over += (x[0] if x is not None else 0.0) - 0.5
            run += x[0] if x is not None else 0.0
            if over <= 0:
                run = over = 0.0
            deficit = max(deficit, run if over > 0 else 0.0)
            if x is not None:
                for name, g in x[1].items():
                    total[name] += g
        best: list[tuple[str, float]] = [("", 0.0), ("", 0.0)]
        for n in sorted(total, key=self.rank.__getitem__):  # of equal ones the simplest
            if total[n] > best[self.family(n)][1] + 1e-6:
                best[self.family(n)] = (n, total[n])
        return (best[0], best[1]), max(deficit, every if every > len(tokens) / 2 else 0.0)

    def verdict(self, text: str | None) -> tuple[bool, str | None, str | None]:
        """(garbled, chain or null if it can't be undone, restored text or null)."""
        if not text or text.isascii():
            return False, None, None
        by_family, deficit = self.weigh(text)
        (best, _), above = max(((x, x[1] - m) for x, m in zip(by_family, self.margins)), key=lambda x: x[1])
        if above > 0:
            chain = self.chains[best]
            fix = lambda m: chain(m.group()) if not m.group().isascii() and (x := self.token(m.group())) is not None and best in x[1] else m.group()
            return True, best, TOKEN.sub(fix, text)
        return "�" in text or deficit > self.lost, None, None


def tokens_of(texts: Iterable[str]) -> Counter:
    return Counter(t for x in texts for t in beyond_ascii(x))


def beyond_ascii(text: str) -> list[str]:
    return [t for t in TOKEN.findall(text) if not t.isascii()]


def untouched(text: str, words: list[str] | None = None) -> bool:
    """Whether no sequence of UTF-8 is found under the common encodings: a clean record to train on.

    Those in which Cyrillic letters stand for such bytes are left out, clean text has such sequences there.
    """
    return "�" not in text and not any(map(_touched, set(beyond_ascii(text) if words is None else words)))


_LOOK: list = []


@lru_cache(200_000)
def _touched(token: str) -> bool:
    global _LOOK
    if not _LOOK:
        _LOOK = [utf8_under(e) for e in ("cp1252", "cp1251", "cp437", "cp850", "mac-roman")] + [utf8_under("cp1252", True)]
    return any(f(token) != token for f in _LOOK)


def train(texts: list[str], rounds: int = 2) -> Judge:
    """A judge from texts at hand, most of them clean: those untouched() are trained on.

    The texts that the judge of one round finds garbled are left out of the next one's training. A fifth
    is held out, and sets the bounds.
    """
    hold, rest = texts[::5], [t for i, t in enumerate(texts) if i % 5]
    rest = [t for t in rest if untouched(t)]
    judge = Judge(Trigrams(tokens_of(rest)))
    for _ in range(rounds):
        rest = [t for t in rest if not judge.verdict(t)[0]]
        judge = Judge(Trigrams(tokens_of(rest)))
    validate(judge, [t for t in hold if untouched(t)])
    return judge


def rare_above(values: np.ndarray, rate: float) -> float:
    """The level that a value passes at the given rate, by an exponential tail beyond the 99th percentile."""
    if not len(values):
        return 0.0
    high = float(np.quantile(values, 0.99))
    beyond = values[values > high] - high
    return high + (float(beyond.mean()) * math.log(0.01 / rate) if len(beyond) else 0.0)


FALSE_TOKEN, FALSE_RECORD, FALSE_LOST, USUAL = 1e-5, 1e-3, 1e-5, 1 / 80


def validate(judge: Judge, hold: list[str]) -> None:
    """Sets the judge's bounds by held-out texts, most of them clean, and notes the error rates at them.

    plain is what one in eighty of their tokens falls below. One token of each is garbled on purpose. A margin is half of
    what 99 in 100 of those gain, so that few are missed, but at least the gain by which one token in 100,000 would be
    taken wrongly if all chains that change it were tried (a likelihood ratio of 100,000 for each of them). If more than one
    in a thousand held-out clean texts passes it nevertheless, it is raised to where no more do. Texts that gain as much as 95 in 100
    garbled tokens aren't taken for clean.
    """
    words = [beyond_ascii(t) for t in hold]
    least = [min(judge.model.beyond(folded(w)), default=0.0) for ws in words for w in ws]
    if not least:
        return
    judge.plain, judge.seen = float(np.quantile(least, USUAL)), {}
    bad = [x for i, ws in enumerate(words) for x in spoilt(judge, ws, i)]
    odd = {w for ws in words for w in ws if judge.token(w) is not None}
    tried = [float(np.mean([changes(judge, t)[k] for t in odd])) if odd else 0.0 for k in (0, 1)]
    bounded(judge, bad, [gains_of(judge.weigh(t)) for t in hold], tried)


READS = [[("utf-8", w) for w in ("cp1252", "cp850", "mac-roman")], [("cp1251", "cp1252"), ("cp1252", "cp850"), ("cp1250", "mac-roman"), ("koi8-r", "cp1251")]]


def packed(judge: Judge, x: tuple[float, dict[str, float]]) -> bytes:
    """A token's scores, in short."""
    return np.array([x[0], *x[1].values()]).tobytes() + np.array([judge.rank[n] for n in x[1]], np.int16).tobytes()


def unpacked(judge: Judge, raw: bytes) -> tuple[float, dict[str, float]]:
    names, n = list(judge.chains), (len(raw) - 8) // 10
    values = np.frombuffer(raw, np.float64, n + 1).tolist()
    return values[0], {names[r]: g for r, g in zip(np.frombuffer(raw, np.int16, n, 8 * n + 8).tolist(), values[1:])}


def gains_of(weighed: tuple) -> tuple[float, float, float]:
    """(gain of the best chain of either family, unlikeliness)."""
    return weighed[0][0][1], weighed[0][1][1], weighed[1]


def changes(judge: Judge, token: str) -> tuple[int, int]:
    """How many chains of either family change a token."""
    done = [judge.family(n) for names in judge.undone(token).values() for n in names]
    return done.count(0), done.count(1)


def spoilt(judge: Judge, words: list[str], i: int) -> Iterator[tuple[int, float, float]]:
    """(family, gain, unlikeliness) of one of a text's tokens, the i-th, garbled on purpose in the i-th way of either family."""
    for k in (0, 1):
        right, wrong = READS[k][i % len(READS[k])]
        try:
            token = words[i % len(words)].encode(right).decode(wrong)
        except UnicodeError:
            continue
        if token != words[i % len(words)]:
            x = gains_of(judge.weigh(token))
            yield k, x[k], x[2]


def bounded(judge: Judge, bad: list[tuple[int, float, float]], every: list[tuple[float, float, float]], tried: list[float]) -> None:
    """The judge's margins and bound of the unlikely, from garbled tokens, held-out texts and the number of chains tried."""
    every_, margins = np.array(every).reshape(-1, 3), []
    for k, name in enumerate(("utf-8", "byte")):
        gains = np.array([g for f, g, _ in bad if f == k])
        few, sure = (float(np.quantile(gains, 0.01)), float(np.quantile(gains, 0.05))) if len(gains) else (0.0, math.inf)
        clean = every_[every_[:, k] < sure, k]
        m = max(few / 2, math.log1p(tried[k]) - math.log(FALSE_TOKEN))
        if len(clean) and (clean > m).mean() > FALSE_RECORD:
            m = float(np.quantile(clean, 1 - FALSE_RECORD))
        margins.append(m)
        judge.rates |= {f"{name} missed": float((gains <= m).mean()) if len(gains) else 0.0, f"{name} false": float((clean > m).mean()) if len(clean) else 0.0}
    judge.margins = (margins[0], margins[1])
    sure = float(np.median([d for _, _, d in bad])) if bad else math.inf
    clean = every_[(every_[:, 2] < sure) & (every_[:, 0] <= margins[0]) & (every_[:, 1] <= margins[1]), 2]
    judge.lost = max(-judge.plain, rare_above(clean, FALSE_LOST))
    judge.rates["lost false"] = float((clean > judge.lost).mean()) if len(clean) else 0.0
    judge.seen = {}


def _vocabulary(rows: DataFrame) -> DataFrame:
    """(token, n, train, held): how often every token beyond ASCII comes in all texts, and in the untouched ones to train on; in how many held-out texts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            n, train_, held = Counter(), Counter(), Counter()
            for t, drawn in zip(pdf["t"], pdf["drawn"]):
                words = beyond_ascii(t)
                n.update(words)
                if untouched(t, words):
                    train_.update(words) if drawn % 5 else held.update(set(words))
            yield pd.DataFrame([(w, k, train_[w], held[w]) for w, k in n.items()], columns=["token", "n", "train", "held"])

    counts = rows.mapInPandas(run, "token string, n long, train long, held long").groupBy("token").agg(*[F.sum(c).alias(c) for c in ("n", "train", "held")])
    return checkpoint(counts.repartition(2 * rows.sparkSession.sparkContext.defaultParallelism))


def _model(counts: DataFrame) -> Trigrams:
    """Of (token, n), which may come in parts; only counts of trigrams come to the driver."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            grams: tuple[Counter, Counter] = (Counter(), Counter())
            for t, n in zip(pdf["token"], pdf["n"]):
                t = folded(t)
                for k, u in enumerate((f"  {t} ", f"  {t.upper()} ")):
                    for i in range(2, len(u)):
                        grams[k][u[i - 2 : i + 1]] += n
            yield pd.DataFrame([(g, grams[0][g], grams[1][g]) for g in grams[0].keys() | grams[1].keys()], columns=["gram", "n", "upper"])

    rows = counts.mapInPandas(run, "gram string, n long, upper long").groupBy("gram").agg(F.sum("n").alias("n"), F.sum("upper").alias("upper")).collect()
    return Trigrams.of({r.gram: r.n + 0.01 * r.upper for r in sorted(rows)})


def _with_ready(judge: Judge, words: DataFrame, count: bool = False) -> DataFrame:
    """Hands the judge the scores of the commonest unlikely tokens; (token, n, held, score, a, b): all unlikely ones, with their changes() if they are held out and to be counted."""
    shared = words.sparkSession.sparkContext.broadcast(judge)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [(t, n, h, packed(shared.value, x), *(changes(shared.value, t) if count and h else (None, None))) for t, n, h in zip(pdf["token"], pdf["n"], pdf["held"]) if (x := shared.value.token(t)) is not None]
            yield pd.DataFrame(out, columns=["token", "n", "held", "score", "a", "b"])

    odd = checkpoint(words.select("token", "n", "held").mapInPandas(run, "token string, n long, held long, score binary, a long, b long"))
    judge.ready = {r.token: bytes(r.score) for r in odd.orderBy(F.desc("n"), "token").limit(READY).select("token", "score").collect()}
    return odd


def _usual(judge: Judge, words: DataFrame) -> float | None:
    """What one in eighty of all held-out tokens falls below."""
    shared = words.sparkSession.sparkContext.broadcast(judge.model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"x": [min(shared.value.beyond(folded(t)), default=0.0) for t in pdf["token"]], "n": pdf["held"]})

    rows = words.where("held > 0").select("token", "held").mapInPandas(run, "x double, n long").groupBy("x").agg(F.sum("n").alias("n")).orderBy("x").toPandas()
    if not len(rows):
        return None
    ends, at = np.cumsum(rows["n"].to_numpy()), (rows["n"].sum() - 1) * USUAL
    low, high = (float(rows["x"].iloc[min(len(rows) - 1, int(np.searchsorted(ends, i, "right")))]) for i in (math.floor(at), math.ceil(at)))
    return low + (high - low) * (at - math.floor(at))


def judge_for(df: DataFrame, ident: str, text: str, rounds: int = 2) -> Judge:
    """As train(), from all records that hold a character beyond ASCII: counts by trigram, bounds by all that are held out."""
    rows = spread(df.where(F.col(text).rlike(r"[^\x00-\x7f]")).select(F.col(text).alias("t"), F.pmod(F.xxhash64(ident, text), F.lit(1 << 40)).alias("drawn")))
    words, sc = _vocabulary(rows), df.sparkSession.sparkContext
    judge, judges = Judge(_model(words.where("train > 0").select("token", F.col("train").alias("n")))), []
    for _ in range(rounds):
        _with_ready(judge, words)
        judges.append(judge)
        before = sc.broadcast(judges)

        def kept(batches: Iterator[pd.DataFrame], before=before) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                n = tokens_of(t for t, drawn in zip(pdf["t"], pdf["drawn"]) if drawn % 5 and untouched(t) and not any(j.verdict(t)[0] for j in before.value))
                yield pd.DataFrame(list(n.items()), columns=["token", "n"])

        judge = Judge(_model(rows.mapInPandas(kept, "token string, n long")))
    if (plain := _usual(judge, words)) is None:
        return judge
    judge.plain, judge.seen = plain, {}
    tried = _with_ready(judge, words, True).where("held > 0").agg(F.avg("a"), F.avg("b")).first()
    shared = sc.broadcast(judge)

    def held(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for t, i in zip(pdf["t"], pdf["drawn"]):
                if not i % 5 and untouched(t, words := beyond_ascii(t)):
                    out += [(k, g, 0.0, d) for k, g, d in (spoilt(shared.value, words, i // 5) if words else ())] + [(2, *gains_of(shared.value.weigh(t)))]
            yield pd.DataFrame(out, columns=["kind", "g", "h", "d"])

    found = rows.mapInPandas(held, "kind long, g double, h double, d double").toPandas()
    clean, bad = found[found["kind"] == 2], found[found["kind"] < 2]
    bounded(judge, list(zip(bad["kind"], bad["g"], bad["d"])), clean[["g", "h", "d"]].to_numpy(), [x or 0.0 for x in tried])
    return judge


def garbled(df: DataFrame, ident: str, text: str) -> DataFrame:
    """(id, chain, restored) of the garbled records; chain and restored are null where the original is lost.

    Null, empty and pure ASCII texts are never garbled. Repeated rows of an id give one row if their
    texts agree. An empty table gives an empty result.
    """
    judge = df.sparkSession.sparkContext.broadcast(judge_for(df, ident, text))
    kind = df.schema[ident].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [(i, *v[1:]) for i, t in zip(pdf["id"], pdf["t"]) if (v := judge.value.verdict(t))[0]]
            yield pd.DataFrame(out, columns=["id", "chain", "restored"])

    rows = df.where(F.col(text).rlike(r"[^\x00-\x7f]")).select(F.col(ident).alias("id"), F.col(text).alias("t"))
    return spread(rows).mapInPandas(run, f"id {kind}, chain string, restored string").distinct()


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return garbled(table(spark, d, "documents"), "doc_id", "text").select(F.col("id").alias("doc_id")).distinct()


def p9_restored(spark: SparkSession, d: str) -> DataFrame:
    """The garbled documents with the chain that was undone and the text as it was before."""
    return garbled(table(spark, d, "documents"), "doc_id", "text").withColumnRenamed("id", "doc_id")


SQL: dict[str, str] = {}
QUERIES = {"p9_found": p9_found, "p9_restored": p9_restored}
