"""Vectors: hashed embedding, exact nearest neighbours, classification by labels, k-means."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, Window as W

from ..functions.hashing import embedded, embedded_all
from ..functions.text import cosine_score, relevance
from ..session import checkpoint, spread

QUERY_BLOCK = 4096


def embed(docs: DataFrame, ident: str, text: str, dim: int = 256) -> DataFrame:
    """(id, vector): a unit vector per text, zeros for an empty or null one."""
    kind = docs.schema[ident].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"id": pdf["id"], "vector": list(embedded_all([t or "" for t in pdf["t"]], dim).astype(np.float32))})

    return spread(docs.select(F.col(ident).alias("id"), F.col(text).alias("t"))).mapInPandas(run, f"id {kind}, vector array<float>")


def semantic(docs: DataFrame, ident: str, text: str, query: str, limit: int = 50, dim: int = 256) -> DataFrame:
    """(doc, score): the texts nearest to a question; score = (cosine + 1) / 2. Vectors never leave the tasks."""
    q, kind = embedded(query, dim), docs.schema[ident].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"doc": pdf["id"], "cosine": embedded_all([t or "" for t in pdf["t"]], dim) @ q})

    near = spread(docs.select(F.col(ident).alias("id"), F.col(text).alias("t"))).mapInPandas(run, f"doc {kind}, cosine double")
    return near.select("doc", F.round(relevance(cosine_score("cosine")), 9).alias("score")).orderBy(F.desc("score"), "doc").limit(limit)


def semantic_index(vectors: DataFrame, query: str, limit: int = 50) -> DataFrame:
    """(doc, score) as semantic() gives it, from stored vectors (id, vector) of any one length."""
    kind = vectors.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        q: dict[int, np.ndarray] = {}
        for pdf in batches:
            m = np.array(pdf["vector"].tolist(), np.float64)
            if len(m):
                if (n := m.shape[1]) not in q:
                    q[n] = embedded(query, n)
                yield pd.DataFrame({"doc": pdf["id"], "cosine": m @ q[n]})

    near = vectors.where("vector IS NOT NULL").select("id", "vector").mapInPandas(run, f"doc {kind}, cosine double")
    return near.select("doc", F.round(relevance(cosine_score("cosine")), 6).alias("score")).orderBy(F.desc("score"), "doc").limit(limit)


def nearest(vectors: DataFrame, queries: DataFrame, ident: str, vector: str, k: int = 10) -> DataFrame:
    """(query, other, cosine, rank): the exact k nearest rows of each query by cosine, itself left out.

    queries has the same columns; it is a stated set, sent to the tasks in blocks of QUERY_BLOCK, each
    against all rows. Every task keeps the k best per query of what it reads, so what is shuffled is k rows
    per query and task. Null vectors are no neighbours; a zero vector has cosine 0 to all.
    """
    kind, parts = vectors.schema[ident].dataType.simpleString(), []
    rows = spread(vectors.where(F.col(vector).isNotNull()).select(F.col(ident).alias("id"), F.col(vector).alias("v")))
    it, block = queries.where(F.col(vector).isNotNull()).select(ident, vector).orderBy(ident).toLocalIterator(), []
    while True:
        r = next(it, None)
        if r is not None:
            block.append(r)
        if block and (r is None or len(block) == QUERY_BLOCK):
            parts.append(_against(rows, [b[0] for b in block], np.array([b[1] for b in block], np.float64), k, kind))
            block = []
        if r is None:
            break
    if not parts:
        return vectors.sparkSession.createDataFrame([], f"query {kind}, other {kind}, cosine double, rank int")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    w = W.partitionBy("query").orderBy(F.desc("cosine"), "other")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _unit(m: np.ndarray) -> np.ndarray:
    n = np.sqrt((m * m).sum(1, keepdims=True))
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


def _against(rows: DataFrame, ids: list, q: np.ndarray, k: int, kind: str) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast((np.array(ids), _unit(q)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, unit = shared.value
        held: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0), np.zeros(0, names.dtype)) for _ in names]
        for pdf in batches:
            if not len(pdf):
                continue
            own = pdf["id"].to_numpy()
            m = np.round(unit @ _unit(np.array(pdf["v"].tolist(), np.float64)).T, 9)
            for i, row in enumerate(m):
                keep = np.argpartition(-row, min(len(row) - 1, k + 1))[: k + 2] if len(row) > k + 2 else np.arange(len(row))
                if len(row) > k + 2:  # ties at the edge are decided by id, so all of them stay
                    keep = np.flatnonzero(row >= row[keep].min())
                keep = keep[own[keep] != names[i]]
                s, o = np.concatenate([held[i][0], row[keep]]), np.concatenate([held[i][1], own[keep]])
                best = np.lexsort((o, -s))[:k]
                held[i] = (s[best], o[best])
        out = [(a, b, float(c)) for a, (s, o) in zip(names.tolist(), held) for b, c in zip(o.tolist(), s.tolist())]
        yield pd.DataFrame(out, columns=["query", "other", "cosine"])

    return rows.mapInPandas(run, f"query {kind}, other {kind}, cosine double")


def classify(docs: DataFrame, ident: str, text: str, labels: list[str], dim: int = 256) -> DataFrame:
    """(doc, label, score): cosine of text and label, between 0 and 1, best first by rank."""
    names, m, kind = list(dict.fromkeys(labels)), np.array([embedded(x, dim) for x in dict.fromkeys(labels)]), docs.schema[ident].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            s = np.clip(embedded_all([t or "" for t in pdf["t"]], dim) @ m.T, 0, 1)
            yield pd.DataFrame([(i, n, float(round(x, 9))) for i, row in zip(pdf["id"], s) for n, x in zip(names, row)], columns=["doc", "label", "score"])

    w = W.partitionBy("doc").orderBy(F.desc("score"), "label")
    return spread(docs.select(F.col(ident).alias("id"), F.col(text).alias("t"))).mapInPandas(run, f"doc {kind}, label string, score double").withColumn("rank", F.row_number().over(w))


def default_k(n: int) -> int:
    """Round(sqrt n) between 2 and 16."""
    return int(min(16, max(2, math.floor(math.sqrt(n) + 0.5))))


def kmeans(vectors: DataFrame, ident: str, vector: str, k: int | None = None, iterations: int = 50) -> tuple[DataFrame, np.ndarray]:
    """((id, cluster), centroids): deterministic k-means.

    Seeds: the row of greatest norm (ties: the greatest id), then each time the row farthest from all seeds
    (ties: the smallest id). Clusters that lose all rows keep their centroid. Rows of zeros are never
    seeds but are assigned. Centroids and their sums are all that reaches the driver, k rows a step.
    """
    v = checkpoint(vectors.where(F.col(vector).isNotNull()).select(F.col(ident).alias("id"), F.col(vector).cast("array<double>").alias("v")))
    spark, n = v.sparkSession, v.count()
    kind = v.schema["id"].dataType.simpleString()
    if not n:
        return spark.createDataFrame([], f"id {kind}, cluster int"), np.zeros((0, 0))
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    first = v.withColumn("n", norm).where("n > 0").orderBy(F.desc("n"), F.desc("id")).first()
    if first is None:
        return v.select("id", F.lit(0).alias("cluster")), np.zeros((1, 0))
    seeds, k = [np.array(first.v)], k or default_k(n)
    while len(seeds) < k:
        far = _distances(v, np.array(seeds)).where("n > 0").orderBy(F.desc("d"), "id").first()
        if far is None or far.d <= 0:
            break
        seeds.append(np.array(far.v))
    c = np.array(seeds)
    before = None
    for _ in range(iterations):
        sums = _sums(v, c)
        mark = tuple((i, s[0]) for i, s in sorted(sums.items()))
        new = c.copy()
        for i, (m, total) in sums.items():
            new[i] = total / m
        if mark == before and np.allclose(new, c, rtol=0, atol=1e-12):
            break
        before, c = mark, new

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"id": pdf["id"], "cluster": _cluster(pdf["v"], c).astype(np.int32)})

    return v.mapInPandas(assign, f"id {kind}, cluster int"), c


def _cluster(col: pd.Series, c: np.ndarray) -> np.ndarray:
    if not len(col):
        return np.zeros(0, int)
    m = np.array(col.tolist())
    return ((m[:, None, :] - c[None]) ** 2).sum(2).argmin(1)


def _distances(v: DataFrame, c: np.ndarray) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                m = np.array(pdf["v"].tolist())
                yield pdf.assign(n=(m * m).sum(1), d=((m[:, None, :] - c[None]) ** 2).sum(2).min(1))

    return v.mapInPandas(run, f"id {v.schema['id'].dataType.simpleString()}, v array<double>, n double, d double")


def _sums(v: DataFrame, c: np.ndarray) -> dict[int, tuple[int, np.ndarray]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, s = np.zeros(len(c), np.int64), np.zeros_like(c)
        for pdf in batches:
            if len(pdf):
                a = _cluster(pdf["v"], c)
                n += np.bincount(a, minlength=len(c))
                np.add.at(s, a, np.array(pdf["v"].tolist()))
        yield pd.DataFrame({"i": np.repeat(np.arange(len(c)), c.shape[1]), "j": np.tile(np.arange(c.shape[1]), len(c)), "n": np.repeat(n, c.shape[1]), "s": s.ravel()})

    got = v.mapInPandas(run, "i int, j int, n long, s double").groupBy("i", "j").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).where("n > 0").collect()
    out: dict[int, tuple[int, np.ndarray]] = {}
    for r in got:
        out.setdefault(r.i, (r.n, np.zeros(c.shape[1])))[1][r.j] = r.s
    return out


def emergent_tags(assigned: DataFrame, weights: DataFrame) -> DataFrame:
    """(cluster, term, weight): the heaviest term of every cluster's centroid. assigned: id, cluster; weights: doc, term, weight."""
    size = assigned.groupBy("cluster").agg(F.count("*").alias("size"))
    total = weights.join(assigned, F.col("doc") == F.col("id")).groupBy("cluster", "term").agg(F.sum("weight").alias("w"))
    mean = total.join(size, "cluster").select("cluster", "term", F.round(F.col("w") / F.col("size"), 9).alias("weight"))
    w = W.partitionBy("cluster").orderBy(F.desc("weight"), "term")
    return mean.where("weight > 0").withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")
