"""Mixing sources to target weights, by hash-threshold histograms (problem 8).

Each document has a hash of its id; a source's budget is met by using all its documents a whole number of
times, and once more those below a threshold of the hash. The threshold is found from sums of tokens
per source and bucket of 16 bits of the hash: all buckets below the one in which the budget ends are
taken whole, and only that one bucket is looked at again by the next 16 bits. Nothing is sorted, and a
smaller budget always takes a subset of what a larger one takes.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, Window as W

from ..session import checkpoint, small, spread, table

VOCABULARY = os.environ.get("TOKENIZER_RANKS", "/opt/tokenizers/byte_bpe_50k.tiktoken")
# Fixed value: how this vocabulary's tokenizer parts a text before byte pairs are merged.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class TokenCounter:
    """Number of tokens of a text under a byte-pair vocabulary; counts of pieces are remembered."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        import regex
        import tiktoken

        self.encode = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.split, self.seen = regex.compile(PATTERN).findall, {}

    def __call__(self, text: str | None) -> int:
        seen, n = self.seen, 0
        if len(seen) > 500_000:
            seen.clear()
        for p in self.split(text or ""):
            if (k := seen.get(p)) is None:
                k = seen[p] = len(self.encode(p))
            n += k
        return n


def read_ranks(path: str = VOCABULARY) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def with_tokens(df: DataFrame, text: str, path: str = VOCABULARY) -> DataFrame:
    """df with the text replaced by its number of tokens; null and empty texts have none.

    The vocabulary is read once, by the driver, and broadcast: its size is the file's.
    """
    shared = df.sparkSession.sparkContext.broadcast(read_ranks(path))
    keep = [c for c in df.columns if c != text]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count = TokenCounter(shared.value)
        for pdf in batches:
            yield pdf[keep].assign(tokens=[count(t) for t in pdf[text]])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != text)
    return spread(df).mapInPandas(run, f"{fields}, tokens long")


def bits(level: int):
    """The 16 bits of the 48-bit hash that a level looks at, from the highest down."""
    return F.shiftright("h", 32 - 16 * level).bitwiseAND(F.lit(0xFFFF))


def thresholds(rows: DataFrame, budgets: DataFrame) -> DataFrame:
    """(source, prefix): documents with a hash below the prefix fit the budget.

    rows: source, h, tokens. budgets: source, budget. A bucket that holds the budget's end is refined
    until it can't be split; hashes that agree in all bits stay together.
    """
    open_ = budgets.select("source", F.col("budget").alias("left"), F.lit(0).cast("long").alias("prefix"))
    for level in range(3):
        inside = rows.join(small(open_), "source")
        if level:
            inside = inside.where(F.shiftright("h", 48 - 16 * level) == F.col("prefix"))
        sums = inside.groupBy("source", "left", "prefix", bits(level).alias("b")).agg(F.sum("tokens").alias("t"))
        upto = sums.withColumn("upto", F.sum("t").over(W.partitionBy("source").orderBy("b")))  # at most 65536 buckets a source
        taken = upto.where("upto <= left").groupBy("source").agg(F.max("upto").alias("used"))
        nxt = upto.where("upto > left").groupBy("source").agg(F.min("b").alias("edge"))
        # all buckets below the edge are in; without an edge all that were looked at are
        step = open_.join(taken, "source", "left").join(nxt, "source", "left")
        open_ = checkpoint(step.select("source", (F.col("left") - F.coalesce("used", F.lit(0))).alias("left"), (F.col("prefix") * 65536 + F.coalesce("edge", F.when(F.col("used").isNotNull(), F.lit(65536)), F.lit(0))).alias("prefix")))
    return open_.select("source", "prefix")


def mixture(rows: DataFrame, targets: DataFrame, total: float | None = None, keep: list[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(chosen, shares). rows: id, source, tokens, one row a document. targets: source, target_share, max_repeats.

    chosen has id, source, tokens, the columns in keep, and repeats >= 1; other columns of rows are dropped.

    Without total the mixture is as large as the targets can be met exactly, up to one document a
    source. shares has per target source what there is, what was
    wanted, what is used and its actual share. Sources without a target and documents without tokens are
    not used; a source without tokens is left out, and the shares of the others are scaled up. A null
    max_repeats counts as 1, a null or negative share as 0. Empty tables give empty results.
    """
    goal = targets.where("source IS NOT NULL").groupBy("source").agg(F.greatest(F.coalesce(F.max("target_share"), F.lit(0.0)), F.lit(0.0)).alias("target_share"), F.coalesce(F.max("max_repeats"), F.lit(1)).alias("max_repeats"))
    held = checkpoint(rows.select("id", "source", "tokens", *keep).where("tokens > 0 AND source IS NOT NULL").join(small(goal), "source").withColumn("h", F.shiftrightunsigned(F.xxhash64("id"), 16)))
    have = held.groupBy("source").agg(F.sum("tokens").alias("available"), F.count("*").alias("documents"))
    plan = have.join(goal, "source", "right").withColumn("available", F.coalesce("available", F.lit(0))).withColumn("documents", F.coalesce("documents", F.lit(0)))
    whole = plan.where("available > 0").agg(F.sum("target_share").alias("s"), F.min(F.when(F.col("target_share") > 0, F.col("available") * F.col("max_repeats") / F.col("target_share"))).alias("t")).first()
    scale = whole["s"] or 1.0
    size = float(total) if total is not None else (whole["t"] or 0.0) * scale
    plan = plan.withColumn("wanted", F.when(F.col("available") > 0, F.col("target_share") / F.lit(scale) * F.lit(size)).otherwise(F.lit(0.0)))
    plan = plan.withColumn("budget", F.least(F.floor(F.col("wanted") + 1e-6), F.col("available") * F.col("max_repeats")))
    plan = checkpoint(plan.withColumn("full", F.when(F.col("available") > 0, F.floor(F.col("budget") / F.col("available"))).otherwise(F.lit(0)).cast("long")))
    rest = plan.select("source", (F.col("budget") - F.col("full") * F.col("available")).alias("budget"))
    edge = thresholds(held, rest)
    once = F.col("h") < F.col("prefix")
    use = held.drop("target_share", "max_repeats").join(small(edge.join(plan.select("source", "full"), "source")), "source")
    chosen = use.withColumn("repeats", F.col("full") + once.cast("long")).where("repeats > 0").drop("h", "prefix", "full")
    used = chosen.groupBy("source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("used"), F.max("repeats").alias("most_repeats"))
    shares = plan.select("source", "target_share", "max_repeats", "documents", "available", F.round("wanted", 3).alias("wanted")).join(used, "source", "left").withColumn("used", F.coalesce("used", F.lit(0))).withColumn("most_repeats", F.coalesce("most_repeats", F.lit(0)))
    sum_ = shares.agg(F.sum("used").alias("all"))
    return chosen, shares.crossJoin(F.broadcast(sum_)).withColumn("share", F.when(F.col("all") > 0, F.col("used") / F.col("all")).otherwise(F.lit(0.0))).drop("all")


def clean(c: str):
    return F.lower(F.regexp_replace(c, r"^\s+|\s+$", ""))


def documents_with_tokens(spark: SparkSession, d: str) -> DataFrame:
    """One row per id (the delivery with the smallest doc_id) with a text, its source in one spelling and its tokens.

    Tokens are counted where the texts are read; only ids, sources and numbers are moved.
    """
    docs = table(spark, d, "documents").where("text IS NOT NULL AND kind <> 'folder'").select("doc_id", "id", clean("source").alias("source"), "text")
    counted = checkpoint(with_tokens(docs, "text"))
    first = counted.groupBy("id").agg(F.min("doc_id").alias("doc_id"))
    return counted.where("source IS NOT NULL").join(first.select("doc_id"), "doc_id", "left_semi")


def _mixed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    targets = table(spark, d, "mix_targets").select(clean("source").alias("source"), "target_share", "max_repeats")
    return mixture(documents_with_tokens(spark, d), targets, keep=["doc_id"])


def p8_mixture(spark: SparkSession, d: str) -> DataFrame:
    """The chosen documents and how often each is used."""
    return _mixed(spark, d)[0].select("doc_id", "id", "source", "tokens", "repeats")


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    """Per source what was wanted and what was reached."""
    return _mixed(spark, d)[1]


SQL: dict[str, str] = {}
QUERIES = {"p8_mixture": p8_mixture, "p8_shares": p8_shares}
