"""Near-duplicate records by circulant MinHash, banding and exact Jaccard verification (problem 3).

A text is the set of its runs of k words. Coordinate j of a signature is the minimum over the set of
pi(sigma(x) + j): sigma and pi are two fixed permutations of the 32-bit numbers, and the second one is
shifted circularly by j instead of drawing a permutation per coordinate. Texts with equal sets are one
class and are signed once. Classes that share a band become candidates; a bound on their sizes is
applied in the join, sketches of two bits a coordinate put aside those that are nowhere near the
threshold, and every other candidate is verified on the whole sets.

Bands that a great many classes share aren't paired within themselves: their classes are joined by the
rarest shingles of each (prefix filter), which loses no pair at or above the threshold.

Texts are never shuffled. They are read twice: to be signed, and to give the sets of those that have
a candidate, which a Bloom filter of bounded size picks where the texts are read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, Window as W

from ..operators.filters import among, surely_not
from ..operators.graph import connected_components
from ..session import checkpoint, spread, table
from .words import MIX, WordHashes, mix64, shingles, sql_words, words

HOT_BAND = 500
CHUNK = 1 << 15
SKETCHED = 256


def bands_for(threshold: float, recall: float = 0.9998) -> tuple[int, int]:
    """(rows a band, bands) that catch a pair just at the threshold with the given probability."""
    rows = max(1, math.floor(math.log(0.1) / math.log(threshold))) if threshold < 1 else 16
    return rows, max(1, math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))) if threshold < 1 else 1


def permuted(x: np.ndarray, out: np.ndarray, spare: np.ndarray) -> np.ndarray:
    """A permutation of the 32-bit numbers (xor-shifts and odd factors)."""
    for factor in (0x7FEB352D, 0x846CA68B):
        np.right_shift(x, 15, out=spare)
        np.bitwise_xor(x, spare, out=out)
        np.multiply(out, np.uint32(factor), out=out)
        x = out
    return out


def signatures(sets: list[np.ndarray], rows: int) -> np.ndarray:
    """One signature a set of 64-bit hashes, none of them empty, by two permutations."""
    out = np.empty((len(sets), rows), np.uint32)
    at = 0
    while at < len(sets):
        end, n = at, 0
        while end < len(sets) and (n == 0 or n + len(sets[end]) <= CHUNK):
            n += len(sets[end])
            end += 1
        part = sets[at:end]
        x = np.concatenate(part)
        x = mix64(x).astype(np.uint32)  # the first permutation, of the hashes, folded to 32 bits
        y, spare = np.empty_like(x), np.empty_like(x)
        starts = np.concatenate([[0], np.cumsum([len(s) for s in part])[:-1]])
        for j in range(rows):
            np.add(x, np.uint32(j), out=y)
            out[at:end, j] = np.minimum.reduceat(permuted(y, y, spare), starts)
        at = end
    return out


def folded(columns: np.ndarray, seed: int) -> np.ndarray:
    """One hash a row."""
    h = np.full(len(columns), seed, np.uint64)
    for j in range(columns.shape[1]):
        h = mix64(h + columns[:, j] + MIX)
    return h


def shingle_sets(texts: Iterable[str], k: int, of: WordHashes) -> list[np.ndarray]:
    """The sorted shingle hashes of each text."""
    ws = [words(t) for t in texts]
    h = shingles(of([w for x in ws for w in x]), k)
    ends = np.cumsum([len(x) for x in ws])
    return [np.unique(h[e - len(x) : max(e - len(x), e - k + 1)]) for x, e in zip(ws, ends.tolist())]


def signed(df: DataFrame, ident: str, text: str, k: int, rows: int, bands: int) -> DataFrame:
    """(id, fp, m, keys, sketch): fingerprint and size of the set, a key per band, two bits of each of 256 coordinates.

    Texts of under k words are left out.
    """
    kind = df.schema[ident].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of = WordHashes()
        for whole in batches:
            for lo in range(0, len(whole), 1000):
                pdf = whole.iloc[lo : lo + 1000]
                sets = shingle_sets(pdf["t"], k, of)
                keep = [i for i, s in enumerate(sets) if len(s)]
                if not keep:
                    continue
                sets = [sets[i] for i in keep]
                sig = signatures(sets, max(rows * bands, SKETCHED)).astype(np.uint64)
                keys = np.stack([folded(sig[:, b * rows : (b + 1) * rows], b) for b in range(bands)], 1)
                two = (sig[:, :SKETCHED].reshape(len(sets), SKETCHED // 32, 32) & np.uint64(3)) << (2 * np.arange(32, dtype=np.uint64))
                sketch = np.bitwise_or.reduce(two, axis=2)
                yield pd.DataFrame({"id": pdf["id"].iloc[keep].to_numpy(), "fp": [hashlib.md5(s.tobytes()).digest() for s in sets], "m": np.array([len(s) for s in sets], np.int32), "keys": list(keys.view(np.int64)), "sketch": list(sketch.view(np.int64))})

    rows_ = df.where(F.col(ident).isNotNull() & F.col(text).isNotNull()).select(F.col(ident).alias("id"), F.col(text).alias("t"))
    return spread(rows_).mapInPandas(run, f"id {kind}, fp binary, m int, keys array<long>, sketch array<long>")


def paired(rows: DataFrame, on: list[str], n: str, most: int) -> DataFrame:
    """(columns in on, x, y): rows of one key (columns c, m and others, as structs) with each other, c rising.

    n rows share a key; where they are more than most, one side is parted by a hash of c and the other
    one repeated for every part, so that no task holds a hot key.
    """
    rest = [c for c in rows.columns if c not in (*on, n)]
    parts = F.ceil(F.col(n) / most).cast("int")
    x = rows.select(*on, F.pmod(F.xxhash64("c"), parts).cast("int").alias("part"), F.struct(*rest).alias("x"))
    y = rows.select(*on, F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), F.struct(*rest).alias("y"))
    return x.join(y, [*on, "part"]).where("x.c < y.c")


def candidates(bands: DataFrame, sets_of: Callable[[DataFrame], DataFrame], threshold: float, hot: int) -> DataFrame:
    """(a, b): classes, a < b, that share a band; where they are many, their sizes and rarest shingles allow the threshold.

    bands: (c, m, key). A key of two classes is a pair by its least and greatest one, without a join. sets_of
    gives (c, sh) for the classes in a table; it is asked only for those in bands that more than hot share.
    """
    fits = F.least("x.m", "y.m") >= F.greatest("x.m", "y.m") * F.lit(threshold)
    groups = checkpoint(bands.groupBy("key").agg(F.count("*").alias("n"), F.min("c").alias("a"), F.max("c").alias("b")).where("n > 1"))
    out = groups.where("n = 2").select("a", "b")
    more = groups.where("n > 2").select("key", "n")
    if more.isEmpty():
        return out.distinct()
    shared = checkpoint(among(bands, "key", more).join(more, "key"))
    few, many = shared.where(F.col("n") <= hot), shared.where(F.col("n") > hot)
    out = out.union(paired(few, ["key"], "n", HOT_BAND).where(fits).select("x.c", "y.c"))
    if not many.isEmpty():
        token = sets_of(many.select("c").distinct()).select("c", F.size("sh").alias("m"), F.explode("sh").alias("s"))
        # a shingle that only one class has takes a place in the prefix but joins nothing
        seen = token.groupBy("s").agg(F.count("*").alias("df")).where("df > 1")
        ranked = token.join(seen, "s", "left").withColumn("r", F.row_number().over(W.partitionBy("c").orderBy(F.coalesce("df", F.lit(1)), "s")))
        prefix = ranked.where((F.col("r") <= F.col("m") - F.ceil(F.col("m") * F.lit(threshold) - 1e-9) + 1) & F.col("df").isNotNull()).select("s", "df", "c", "m", "r")
        # the first shared shingle bounds the overlap by what is left behind it
        left = F.least(F.col("x.m") - F.col("x.r"), F.col("y.m") - F.col("y.r")) + 1
        enough = left >= (F.col("x.m") + F.col("y.m")) * F.lit(threshold / (1 + threshold)) - 1e-6
        out = out.union(paired(prefix, ["s"], "df", HOT_BAND).where(fits & enough).select("x.c", "y.c"))
    return out.distinct()


def likely(pairs: DataFrame, sketches: DataFrame, threshold: float) -> DataFrame:
    """Pairs whose sizes allow the threshold and whose sketches agree as often as a pair at it does, less six standard deviations.

    sketches: c, m, sketch. Two bits of a coordinate agree with probability j + (1 - j) / 4, so less than one in a
    hundred million pairs at the threshold is lost, and unlike ones aren't carried to the verification.
    """
    p = threshold + (1 - threshold) / 4
    least = SKETCHED * p - 6 * math.sqrt(SKETCHED * p * (1 - p))
    some = among(sketches, "c", pairs.select(F.col("a").alias("c")).union(pairs.select("b")).distinct())
    both = pairs.join(some.toDF("a", "ma", "ka"), "a").join(some.toDF("b", "mb", "kb"), "b")
    both = both.where(F.least("ma", "mb") >= F.greatest("ma", "mb") * F.lit(threshold))
    odd = F.lit(0x5555555555555555)
    differ = F.zip_with("ka", "kb", lambda x, y: F.bit_count((x.bitwiseXOR(y).bitwiseOR(F.shiftrightunsigned(x.bitwiseXOR(y), 1))).bitwiseAND(odd)))
    return both.where(F.lit(SKETCHED) - F.aggregate(differ, F.lit(0), lambda s, x: s + x) >= least).select("a", "b")


def near_duplicates(df: DataFrame, ident: str, text: str, k: int = 5, threshold: float = 0.8, recall: float = 0.9998, hot: int = HOT_BAND) -> tuple[DataFrame, DataFrame]:
    """((id, c, m) of every record that has a shingle, (a, b, similarity) between classes c of equal sets).

    Records with a null id or text, or with fewer than k words, are alike to none. Repeated rows count
    once; an id with two texts is in two classes. An empty table gives empty results.
    """
    rows, bands = bands_for(threshold, recall)
    sig = checkpoint(signed(df, ident, text, k, rows, bands).withColumn("row", F.monotonically_increasing_id()))
    first = sig.groupBy("fp").agg(F.min("row").alias("c"))
    whole = checkpoint(sig.select("id", "fp", "m", "row").join(first, "fp"))
    members = whole.select("id", "fp", "m", "c").distinct()
    # one record a class: only the few rows that may be a repeated one are looked up exactly
    again = whole.where("row <> c").select("row")
    one = surely_not(sig, "row", again).unionAll(among(sig, "row", again).join(again, "row", "left_anti").select(*sig.columns))

    def sets_of(need: DataFrame) -> DataFrame:
        """(c, sh) of the classes in need, from the texts of one record each."""
        who = checkpoint(members.join(need, "c").groupBy("c", "fp").agg(F.min("id").alias("id")))
        texts = among(df.select(F.col(ident).alias("id"), F.col(text).alias("t")).where("t IS NOT NULL AND id IS NOT NULL"), "id", who.select("id").distinct())

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            of = WordHashes()
            for whole in batches:
                for lo in range(0, len(whole), 1000):
                    sets = [s for s in shingle_sets(whole["t"].iloc[lo : lo + 1000], k, of) if len(s)]
                    if sets:
                        yield pd.DataFrame({"fp": [hashlib.md5(s.tobytes()).digest() for s in sets], "sh": [s.view(np.int64) for s in sets]})

        sets = texts.mapInPandas(run, "fp binary, sh array<long>")
        return sets.groupBy("fp").agg(F.first("sh").alias("sh")).join(who.select("c", "fp"), "fp").select("c", "sh")

    cand = candidates(one.select(F.col("row").alias("c"), "m", F.explode("keys").alias("key")), sets_of, threshold, hot)
    pairs = checkpoint(likely(checkpoint(cand), sig.select(F.col("row").alias("c"), "m", "sketch"), threshold))
    sets = checkpoint(sets_of(pairs.select(F.col("a").alias("c")).union(pairs.select("b")).distinct()))
    both = pairs.join(sets.toDF("a", "sa"), "a").join(sets.toDF("b", "sb"), "b").withColumn("i", F.size(F.array_intersect("sa", "sb")))
    links = both.withColumn("similarity", F.col("i") / (F.size("sa") + F.size("sb") - F.col("i"))).where(F.col("similarity") >= threshold).select("a", "b", "similarity")
    return members.select("id", "c", "m"), checkpoint(links)


def record_pairs(members: DataFrame, links: DataFrame) -> DataFrame:
    """(a, b, similarity) with a < b between records: of linked classes, and within a class."""
    m = members.select("id", "c")
    x, y = m.toDF("x", "fa"), m.toDF("y", "fb")
    apart = links.join(x, links["a"] == F.col("fa")).join(y, links["b"] == F.col("fb")).select("x", "y", "similarity")
    repeated = members.groupBy(F.col("c").alias("rep")).agg(F.count("*").alias("n")).where("n > 1")
    again = m.join(repeated, F.col("c") == F.col("rep")).select("rep", "n", F.col("id").alias("c"))
    same = paired(again, ["rep"], "n", 5_000).select(F.col("x.c").alias("x"), F.col("y.c").alias("y"), F.lit(1.0).alias("similarity"))
    every = apart.unionAll(same).where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "similarity")
    return every.groupBy("a", "b").agg(F.max("similarity").alias("similarity"))


def class_links(members: DataFrame, links: DataFrame) -> DataFrame:
    """(class_a, class_b, similarity) with class_a < class_b, each class by the smallest record id in it."""
    first = members.groupBy("c").agg(F.min("id").alias("class_id"))
    l = links.join(first.toDF("a", "x"), "a").join(first.toDF("b", "y"), "b")
    return l.select(F.least("x", "y").alias("class_a"), F.greatest("x", "y").alias("class_b"), "similarity").distinct()


def record_groups(members: DataFrame, links: DataFrame) -> DataFrame:
    """(id, class_id, group_id, links): class = equal sets, group = classes linked directly or through others.

    Ids are the smallest record id of the class and group; links counts the other classes linked to the record's.
    """
    first = members.groupBy("c").agg(F.min("id").alias("class_id"))
    l = links.join(first.toDF("a", "ca"), "a").join(first.toDF("b", "cb"), "b").select("ca", "cb")
    n = l.select(F.col("ca").alias("l")).unionAll(l.select("cb")).groupBy("l").agg(F.count("*").alias("links"))
    comp = connected_components(l, "ca", "cb")
    out = members.select("id", "c").join(first, "c").join(n, F.col("class_id") == F.col("l"), "left").join(comp, F.col("class_id") == F.col("node"), "left")
    return out.select("id", "class_id", F.coalesce("component", "class_id").alias("group_id"), F.coalesce("links", F.lit(0)).alias("links")).distinct()


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    members, links = near_duplicates(table(spark, d, "content"), "document_id", "text", k=4, threshold=0.6)
    return record_pairs(members, links).select("a", "b")


def p3_groups(spark: SparkSession, d: str) -> DataFrame:
    """Per document its class of equal sets, its group and the number of other classes linked to it, at the similarity of p3_found.

    With p3_links it holds what p3_found lists, without multiplying out groups of exact copies.
    """
    members, links = near_duplicates(table(spark, d, "content"), "document_id", "text", k=4, threshold=0.6)
    return record_groups(members, links).withColumnRenamed("id", "document_id")


def p3_links(spark: SparkSession, d: str) -> DataFrame:
    """(class_a, class_b, similarity): the links between classes; a class goes by the smallest id in it, p3_groups has the rest."""
    members, links = near_duplicates(table(spark, d, "content"), "document_id", "text", k=4, threshold=0.6)
    return class_links(members, links).withColumn("similarity", F.round("similarity", 9))


# Every pair of texts that share a run of four words, with the similarity of their sets.
ALIKE = f"""
t AS (SELECT DISTINCT document_id AS id, {sql_words("text")} AS w FROM content WHERE document_id IS NOT NULL AND text IS NOT NULL),
s AS (SELECT DISTINCT id, array_to_string(w[i : i + 3], ' ') AS s FROM (SELECT id, w, unnest(range(1, CAST(len(w) - 2 AS BIGINT))) AS i FROM t WHERE len(w) >= 4)),
n AS (SELECT id, count(*) AS n, md5(string_agg(s, '|' ORDER BY s)) AS fp FROM s GROUP BY 1),
met AS (SELECT x.id AS a, y.id AS b, count(*) AS i FROM s x JOIN s y ON x.s = y.s AND x.id < y.id GROUP BY 1, 2),
pair AS (SELECT a, b, i / (p.n + q.n - i) AS similarity FROM met JOIN n p ON a = p.id JOIN n q ON b = q.id WHERE i / (p.n + q.n - i) >= 0.6)
"""
CLASSES = f"""{ALIKE},
cls AS (SELECT id, min(id) OVER (PARTITION BY fp) AS class_id FROM n),
link AS (SELECT a AS class_a, b AS class_b, similarity FROM pair WHERE a IN (SELECT class_id FROM cls) AND b IN (SELECT class_id FROM cls))
"""
SQL = {
    "p3_found": f"WITH {ALIKE} SELECT a, b FROM pair",
    "p3_links": f"WITH {CLASSES} SELECT class_a, class_b, round(similarity, 9) AS similarity FROM link",
    "p3_groups": f"""WITH RECURSIVE {CLASSES},
edge AS (SELECT class_a AS a, class_b AS b FROM link UNION SELECT class_b, class_a FROM link),
reach AS (SELECT DISTINCT class_id AS a, class_id AS b FROM cls UNION SELECT r.a, e.b FROM reach r JOIN edge e ON r.b = e.a),
grp AS (SELECT a, min(b) AS group_id FROM reach GROUP BY 1)
SELECT id AS document_id, class_id, group_id, (SELECT count(*) FROM edge WHERE edge.a = class_id) AS links FROM cls JOIN grp ON class_id = grp.a""",
}
QUERIES = {"p3_found": p3_found, "p3_groups": p3_groups, "p3_links": p3_links}
