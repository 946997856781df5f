"""Retrieval for question answering: sources, context, prompts, citations."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .fts import overlap

TOP_K = 5
NOTHING = "No matching documents were found."


def retrieve(content: DataFrame, question: str, k: int = TOP_K) -> DataFrame:
    """(n, doc, score, excerpt): the best texts by word overlap, numbered from 1; k is the feature."""
    from pyspark.sql import Window as W

    hits = overlap(content, "document_id", "text", question).where("excerpt <> ''").orderBy(F.desc("score"), "doc").limit(k)
    return hits.withColumn("n", F.row_number().over(W.orderBy(F.desc("score"), "doc")))


def context(refs: DataFrame) -> DataFrame:
    """One row context: the sources as '[n] (document id) excerpt', a line each; empty without any."""
    lines = F.array_sort(F.collect_list(F.struct("n", F.concat(F.lit("["), F.col("n").cast("string"), F.lit("] (document "), "doc", F.lit(") "), "excerpt").alias("line"))))
    return refs.agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("context"))


def fallback(refs: DataFrame) -> DataFrame:
    """One row answer: the excerpts themselves, or a fixed text without any."""
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", F.concat(F.lit("- "), "excerpt", F.lit(" ["), F.col("n").cast("string"), F.lit("]")).alias("line")))), lambda x: x["line"]), "\n")
    return refs.agg(F.count("*").alias("c"), body.alias("b")).select(F.when(F.col("c") == 0, NOTHING).otherwise(F.concat(F.lit("Found in the library:\n"), "b")).alias("answer"))


def cited(answers: DataFrame, refs: DataFrame) -> DataFrame:
    """answers (text) with [n] replaced by the source's mark."""
    got = refs.agg(F.array_sort(F.collect_list(F.struct("n", "doc"))).alias("r"))
    out = F.aggregate("r", F.col("text"), lambda t, x: F.replace(t, F.concat(F.lit("["), x["n"].cast("string"), F.lit("]")), F.concat(F.lit("⟨src "), x["doc"], F.lit("⟩"))))
    return answers.crossJoin(F.broadcast(got)).select(*[out.alias("text") if c == "text" else F.col(c) for c in answers.columns])


def messages(history: DataFrame, refs: DataFrame, question: str, system: str = "Answer from the sources and cite them as [n].") -> DataFrame:
    """(pos, role, text): the system text, the history (turn, role, text), and the question framed with its sources."""
    past = history.select((F.col("turn") + 1).alias("pos"), "role", "text")
    first = history.sparkSession.range(1).select(F.lit(0).cast("long").alias("pos"), F.lit("system").alias("role"), F.lit(system).alias("text"))
    last = context(refs).crossJoin(F.broadcast(history.agg((F.coalesce(F.max("turn"), F.lit(-1)) + 2).alias("pos")))).select("pos", F.lit("user").alias("role"), F.concat(F.lit("Sources:\n"), "context", F.lit(f"\n\nQuestion: {question}")).alias("text"))
    return first.unionAll(past).unionAll(last)


def answer_events(answers: DataFrame, refs: DataFrame) -> DataFrame:
    """(id, seq, kind, text): an answer as it streams, a row a word with the white space behind it, and a last row done with the whole.

    answers: id, text, error. Where the provider failed, the excerpts themselves are the answer, in one piece.
    """
    whole = answers.crossJoin(F.broadcast(fallback(refs))).withColumn("whole", F.when(F.col("error").isNull(), F.coalesce("text", F.lit(""))).otherwise(F.col("answer")))
    pieces = F.when(F.col("error").isNull(), F.regexp_extract_all("whole", F.lit(r"(\s*\S+\s*|\s+)"), 1)).otherwise(F.array("whole"))
    tokens = F.transform(F.filter(pieces, lambda x: x != ""), lambda x: F.struct(F.lit("token").alias("kind"), x.alias("text")))
    done = F.array(F.struct(F.lit("done").alias("kind"), F.col("whole").alias("text")))
    return whole.select("id", F.posexplode(F.concat(tokens, done)).alias("seq", "e")).select("id", "seq", "e.kind", "e.text")


def respond(prompts: DataFrame, templates: list[str]) -> DataFrame:
    """(id, text, prompt_tokens, completion_tokens): the built-in answer to prompts (id, text), a template picked by the prompt's dominant topic."""
    from ..functions.hashing import token_vector
    from ..functions.text import words_used

    texts = list(templates) or ["I am the built-in model."]

    def run(batches):
        for pdf in batches:
            yield pdf.assign(topic=[int(token_vector(t or "").argmax()) for t in pdf["text"]])

    kind = prompts.schema["id"].dataType.simpleString()
    picked = prompts.select("id", "text").mapInPandas(run, f"id {kind}, text string, topic int")
    answer = F.element_at(F.array(*map(F.lit, texts)), F.col("topic") % len(texts) + 1)
    return picked.select("id", answer.alias("answer"), words_used("text").alias("prompt_tokens")).select("id", F.col("answer").alias("text"), "prompt_tokens", words_used("answer").alias("completion_tokens"))
