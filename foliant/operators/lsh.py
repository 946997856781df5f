"""MinHash with banding, in the two families of the library: near-duplicate index and organiser.

Texts are brought to one class per exact copy first; signatures, bands and pairs are between classes.
Pairs above a threshold come from joins of bands; all pairs of all bands, of which there may be as many as
the square of the classes, from tiles of two blocks of signatures, so that no pair is moved or kept. The rows
of a tile name few classes, so that in files with dictionaries a row takes some bytes, not two names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, functions as F, Window as W

from ..functions import hashing as h
from ..session import checkpoint, spread
from .filters import one_row_each

HOT_BAND = 500
# Classes of a partition (a megabyte of names, Parquet's limit for a dictionary, holds 15,420 of 64 characters), of a block,
# rows of a strip of a tile, pairs looked at together, pairs handed over together, partitions of blocks.
TOGETHER, BLOCK, STRIP, AT_ONCE, HANDED, PARTS = 14_500, 7500, 2048, 1 << 14, 1 << 18, 256
FAMILIES = {"near": (h.near_signatures, h.near_bands, 5), "small": (h.small_signatures, h.small_bands, 3)}


def classes(docs: DataFrame, ident: str, text: str, blank: bool = True) -> tuple[DataFrame, DataFrame]:
    """((id, class), (class, text)): class is the text's SHA-256. blank: whether texts of white space alone count.

    Only texts that may come twice are moved, to keep one of each.
    """
    d = docs.where(F.col(text).isNotNull()).select(F.col(ident).alias("id"), F.col(text).alias("text"))
    d = d if blank else d.where(F.col("text").rlike(r"\S"))
    d = d.withColumn("class", F.sha2("text", 256))
    return d.select("id", "class").distinct(), one_row_each(d.select("class", "text"), "class", F.first(F.struct("text")))


def signatures(texts: DataFrame, family: str = "near", k: int | None = None) -> DataFrame:
    """(class, sig, keys): the signature and the key of each band."""
    sign, band, size = FAMILIES[family]
    size = k or size

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for lo in range(0, len(whole), 1000):
                pdf = whole.iloc[lo : lo + 1000]
                sig = sign(list(pdf["text"]), size)
                yield pd.DataFrame({"class": pdf["class"], "sig": list(sig.view(np.int64)), "keys": list(band(sig).view(np.int64))})

    return checkpoint(spread(texts).mapInPandas(run, "class string, sig array<long>, keys array<long>"))


PACKED = "number int, class array<string>, sig binary, keys binary"
Signed = Iterator[tuple[list[str], np.ndarray, np.ndarray]]


def _row(number: int, names: list[str], sig: np.ndarray, keys: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([names], pa.list_(pa.string())), pa.array([sig.tobytes()]), pa.array([keys.tobytes()])], ["number", "class", "sig", "keys"])


def _gathered(parts: Signed, many: float = np.inf) -> Signed:
    """The same rows, at least so many at a time but the last, ascending by class."""
    names, sigs, keys = [], [], []

    def ordered() -> tuple[list[str], np.ndarray, np.ndarray]:
        order = pa.compute.array_sort_indices(pa.array(names, pa.string())).to_numpy()
        return [names[i] for i in order], np.concatenate(sigs)[order], np.concatenate(keys)[order]

    for some, sig, key in parts:
        names, sigs, keys = names + some, [*sigs, sig], [*keys, key]
        if len(names) >= many:
            yield ordered()
            names, sigs, keys = [], [], []
    if names:
        yield ordered()


def _split(parts: Signed, groups: int) -> Iterator[pa.RecordBatch]:
    """Rows of PACKED, whose number is the range of classes: these are SHA-256, so that equal ranges hold about equally many."""
    for names, sig, keys in _gathered(parts, TOGETHER):
        number = np.array([int(c[:8], 16) for c in names]) * groups >> 32
        cuts = [0, *(np.flatnonzero(np.diff(number)) + 1).tolist(), len(names)]
        for x, y in zip(cuts, cuts[1:]):
            yield _row(int(number[x]), names[x:y], sig[x:y], keys[x:y])


def _arrays(b: pa.RecordBatch, i: int, at: int) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Classes, signatures and keys of the i-th row, from column at on."""
    names = b.column(at)[i].values
    return names, *(np.frombuffer(b.column(at + j)[i].as_buffer(), np.int64).reshape(len(names), -1) for j in (1, 2))


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of each number in blocks of up to BLOCK classes, numbered anew in the order of classes."""
    of: dict[int, list] = {}
    for b in batches:
        for i in range(b.num_rows):
            names, sig, keys = _arrays(b, i, 1)
            of.setdefault(b.column(0)[i].as_py(), []).append((names.to_pylist(), sig, keys))
    for number in sorted(of):
        for whole in _gathered(iter(of.pop(number))):
            for j, lo in enumerate(range(0, len(whole[0]), BLOCK)):
                yield _row(number << 8 | j, *(v[lo : lo + BLOCK] for v in whole))


def _blocks(df: DataFrame, rows: int, parts: Callable[[Iterator[pa.RecordBatch]], Signed]) -> DataFrame:
    """PACKED, checkpointed, of df, from whose batches parts makes signatures and keys of so many classes.

    Each partition holds a range of classes, about TOGETHER at most as long as PARTS of them do; only signatures are moved.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    groups = max(1, -(-rows // TOGETHER), min(-(-rows // 500), round(2 * cores**0.5)))
    few = min(groups, PARTS)
    packed = df.mapInArrow(lambda batches: _split(parts(batches), groups), PACKED)
    return checkpoint(packed.repartitionById(few, F.floor(F.col("number") * few / groups).cast("int")).mapInArrow(_merged, PACKED))


def blocks(texts: DataFrame, family: str = "near", k: int | None = None) -> DataFrame:
    """Signatures and keys as in signatures(), many classes a row, for candidates()."""
    sign, band, size = FAMILIES[family]
    size = k or size

    def signed(batches: Iterator[pa.RecordBatch]) -> Signed:
        for whole in batches:
            for lo in range(0, whole.num_rows, 1000):
                b = whole.slice(lo, 1000)
                sig = sign(b.column(1).to_pylist(), size)
                yield b.column(0).to_pylist(), sig, band(sig)

    return _blocks(spread(texts.select("class", "text")), texts.count(), signed)


def _blocks_of(sig: DataFrame) -> DataFrame:
    def parts(batches: Iterator[pa.RecordBatch]) -> Signed:
        for whole in batches:
            for lo in range(0, whole.num_rows, 1000):
                b = whole.slice(lo, 1000)
                yield b.column(0).to_pylist(), *(c.flatten().to_numpy().reshape(b.num_rows, -1) for c in (b.column(1), b.column(2)))

    return _blocks(sig.select("class", "sig", "keys"), sig.count(), parts)


def _sharing(ka: np.ndarray, kb: np.ndarray, orders: list[np.ndarray]) -> Iterator[np.ndarray]:
    """x * len(kb) + y of every two rows of ka and kb that agree in a band, each once, ascending. orders sorts kb's bands."""
    met = np.zeros(len(ka) * len(kb), bool)
    for band, order in enumerate(orders):
        there = kb[order, band]
        lo = np.searchsorted(there, ka[:, band])
        n = np.searchsorted(there, ka[:, band], "right") - lo
        some = np.flatnonzero(n)
        while len(some):
            ends = np.cumsum(n[some])
            now = max(1, int(np.searchsorted(ends, AT_ONCE)))
            x, c = some[:now], n[some[:now]]
            y = np.arange(ends[now - 1]) - np.repeat(ends[:now] - c - lo[x], c)
            met[np.repeat(x * len(kb), c) + order[y]] = True
            some = some[now:]
    at = np.flatnonzero(met)
    for i in range(0, len(at), AT_ONCE):
        yield at[i : i + AT_ONCE]


def _equal_rows(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The number of equal columns in each row."""
    same = (a == b).view(np.uint8)
    if same.shape[1] % 8 or same.shape[1] > 248:
        return same.sum(1, dtype=np.int64)
    lanes = same.view(np.uint64).sum(1)  # eight counts side by side, each under 32
    return ((lanes * np.uint64(0x0101010101010101)) >> np.uint64(56)).astype(np.int64)


def _tile(sa: np.ndarray, ka: np.ndarray, sb: np.ndarray, kb: np.ndarray, alone: bool) -> Iterator[np.ndarray]:
    """x << 40 | y << 16 | equal rows of every two rows x of the one, y of the other block that share a band; alone: of two rows x < y of one block."""
    orders = [np.argsort(kb[:, r], kind="stable") for r in range(kb.shape[1])]
    for lo in range(0, len(ka), STRIP):
        low = lo if alone else 0
        for at in _sharing(ka[lo : lo + STRIP], kb[low:], [o[o >= low] - low for o in orders]):
            x, y = at // (len(kb) - low) + lo, at % (len(kb) - low) + low
            if alone:
                x, y = x[x < y], y[x < y]
            yield x << 40 | y << 16 | _equal_rows(sa[x], sb[y])


def candidates(packed: DataFrame) -> DataFrame:
    """(a, b, similarity) of every two classes, a < b, that share a band.

    Every two blocks meet in the task of their partitions, which finds their pairs band by band in a table of bits and compares the
    signatures at once. Blocks are read again from the checkpoint; what is kept on disk grows with the classes only.
    Pairs leave Python as numbers of classes in the blocks; a comes from the lower block, b from the other, and the
    rows of one a follow each other.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            for i in range(t.num_rows):
                (a, sa, ka), (b, sb, kb) = _arrays(t, i, 0), _arrays(t, i, 3)

                def row(pairs: list[np.ndarray]) -> pa.RecordBatch:
                    lists = [pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v) for v in (a, b, pa.array(np.concatenate(pairs)))]
                    return pa.RecordBatch.from_arrays([*lists, pa.array([float(sa.shape[1])])], ["a", "b", "pairs", "rows"])

                have: list[np.ndarray] = []
                for pairs in _tile(sa, ka, sb, kb, t.column(6)[i].as_py()):
                    have.append(pairs)
                    if sum(map(len, have)) >= HANDED:
                        yield row(have)
                        have = []
                if have:
                    yield row(have)

    x, y = (packed.select(*[F.col(c).alias(f"{c}_{side}") for c in ("number", "class", "sig", "keys")]) for side in "xy")
    tiles = x.hint("shuffle_replicate_nl").join(y, F.col("number_x") <= F.col("number_y"))
    tiles = tiles.select("class_x", "sig_x", "keys_x", "class_y", "sig_y", "keys_y", (F.col("number_x") == F.col("number_y")).alias("alone"))
    found = tiles.mapInArrow(run, "a array<string>, b array<string>, pairs array<long>, rows double").select("a", "b", "rows", F.explode("pairs").alias("p"))
    part = lambda by, mask: F.shiftright("p", by).bitwiseAND(F.lit(mask)).cast("int")
    return found.select(F.col("a")[part(40, 0xFFFFFF)].alias("a"), F.col("b")[part(16, 0xFFFFFF)].alias("b"), (part(0, 0xFFFF) / F.col("rows")).alias("similarity"))


def agreement(a: str | Column, b: str | Column) -> Column:
    """Share of equal rows of two signatures."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x) / F.size(a)


def bands(sig: DataFrame) -> DataFrame:
    return sig.select("class", F.posexplode("keys").alias("band", "key"))


def probe(asked: DataFrame, index: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(probe, class, similarity) at or above the threshold; asked and index are frames of signatures.

    The asked ones are a stated query set; their bands meet the index by an equi-join.
    """
    a = bands(asked).withColumnRenamed("class", "probe")
    pairs = a.join(bands(index), ["band", "key"]).where("probe <> class").select("probe", "class").distinct()
    s = pairs.join(asked.select(F.col("class").alias("probe"), F.col("sig").alias("sa")), "probe").join(index.select("class", F.col("sig").alias("sb")), "class")
    return s.select("probe", "class", agreement("sa", "sb").alias("similarity")).where(F.col("similarity") >= threshold)


def alike(members: DataFrame, sig: DataFrame, asked: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(id, class, similarity, others, first): for each asked id every class at or above the threshold, with the number
    of its ids besides the asked one and the smallest of them. The own class comes at 1, if it has other ids.

    members: (id, class), which leads to all ids of a class; asked: id, a stated set. Groups of copies are not multiplied out.
    """
    mine = members.join(asked.select("id").distinct(), "id", "left_semi")
    least = members.groupBy("class").agg(F.min("id").alias("low"), F.count("*").alias("n"))
    second = members.join(least.where("n > 1"), "class").where("id <> low").groupBy("class").agg(F.min("id").alias("next"))
    own = mine.join(least.where("n > 1"), "class").join(second, "class")
    own = own.select("id", "class", F.lit(1.0).alias("similarity"), (F.col("n") - 1).alias("others"), F.when(F.col("id") == F.col("low"), F.col("next")).otherwise(F.col("low")).alias("first"))
    near = probe(sig.join(mine.select("class").distinct(), "class", "left_semi"), sig, threshold)
    near = mine.withColumnRenamed("class", "probe").join(near, "probe").join(least, "class")
    return own.unionByName(near.select("id", "class", "similarity", F.col("n").alias("others"), F.col("low").alias("first")))


def pairs(sig: DataFrame, threshold: float = 0.0, hot: int = HOT_BAND) -> DataFrame:
    """(a, b, similarity) of classes, a < b, that share a band. Bands of one class are dropped before the join.

    In bands that more than hot classes share, the threshold narrows the join without losing a pair:
    signatures that may differ in d rows agree in all of at least one of d + 1 slices, so classes must share
    such a slice besides the band. Without a threshold every pair of a band is asked for; see candidates().
    """
    if threshold <= 0:
        return candidates(_blocks_of(sig))
    b = bands(sig)
    shared = checkpoint(b.join(b.groupBy("band", "key").agg(F.count("*").alias("n")).where("n > 1"), ["band", "key"]))
    few = shared.where(F.col("n") <= hot)
    x, y = few.select("band", "key", F.col("class").alias("a")), few.select("band", "key", F.col("class").alias("b"))
    both = x.join(y, ["band", "key"]).where("a < b").select("a", "b")
    many = shared.where(F.col("n") > hot)
    if not many.isEmpty():
        rows = sig.select(F.size("sig").alias("n")).first()["n"]
        slices = int(rows * (1 - threshold) + 1e-9) + 1
        cuts = [round(i * rows / slices) for i in range(slices + 1)]
        keys = F.array(*[F.xxhash64(F.lit(i), F.slice("sig", p + 1, q - p)) for i, (p, q) in enumerate(zip(cuts, cuts[1:])) if q > p])
        cut = many.select("class", "band", "key").join(sig.select("class", F.explode(keys).alias("slice")), "class")
        x, y = cut.withColumnRenamed("class", "a"), cut.withColumnRenamed("class", "b")
        both = both.union(x.join(y, ["band", "key", "slice"]).where("a < b").select("a", "b"))
    both = both.distinct()
    s = both.join(sig.select(F.col("class").alias("a"), F.col("sig").alias("sa")), "a").join(sig.select(F.col("class").alias("b"), F.col("sig").alias("sb")), "b")
    return s.select("a", "b", agreement("sa", "sb").alias("similarity")).where(F.col("similarity") >= threshold)


def duplicates(docs: DataFrame, ident: str, text: str, threshold: float = 0.85, k: int = 3) -> DataFrame:
    """(id, duplicate_of, similarity): for every record with one, its most similar other record (ties: the smallest id).

    Blank texts are left out. A record with exact copies has the smallest of them, at similarity 1.
    """
    members, texts = classes(docs, ident, text, blank=False)
    both = checkpoint(pairs(signatures(texts, "small", k), threshold))
    sym = both.unionAll(both.select(F.col("b").alias("a"), F.col("a").alias("b"), "similarity"))
    two = members.groupBy("class").agg(F.min("id").alias("low"), F.count("*").alias("n"))
    second = members.join(two.where("n > 1"), "class").where("id <> low").groupBy("class").agg(F.min("id").alias("next"))
    own = members.join(two, "class").join(second, "class", "left").where("n > 1").select("id", F.when(F.col("id") == F.col("low"), F.col("next")).otherwise(F.col("low")).alias("duplicate_of"), F.lit(1.0).alias("similarity"))
    reps = two.select(F.col("class").alias("b"), F.col("low").alias("duplicate_of"))
    w = W.partitionBy("a").orderBy(F.desc("similarity"), "duplicate_of")
    best = sym.join(reps, "b").withColumn("r", F.row_number().over(w)).where("r = 1")
    other = members.join(best, F.col("class") == F.col("a")).select("id", "duplicate_of", "similarity")
    w2 = W.partitionBy("id").orderBy(F.desc("similarity"), "duplicate_of")
    return own.unionByName(other).withColumn("r", F.row_number().over(w2)).where("r = 1").drop("r")
