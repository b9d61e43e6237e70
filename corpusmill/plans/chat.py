"""Question answering over chunks: retrieval, prompt, answer, citations, for many questions at once."""

from __future__ import annotations

import time
from collections.abc import Callable
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.operators import search
from corpusmill.operators.embed import EmbeddingProvider, embed, with_backoff
from corpusmill.session import saved

OUT_OF_SCOPE = "The indexed pages do not answer this question."
INSTRUCTIONS = "\n".join([
    "# Task",
    "Answer from the sources below and from nothing else.",
    f"Where they do not hold the answer, reply: {OUT_OF_SCOPE}",
    "Name the sources you used by their numbers, as in [Source 1].",
])
NO_CONTEXT = "(no source was found)"
RULE = "\n\n---\n\n"


class ChatProvider(Protocol):
    def generate(self, prompt: str, temperature: float | None = None, max_output_tokens: int | None = None) -> str: ...


class ExtractiveChat:
    """Offline stand-in: the first line of the first source's content, or the out-of-scope reply."""

    def generate(self, prompt: str, temperature: float | None = None, max_output_tokens: int | None = None) -> str:
        # The instructions speak of sources, too: only the context's first one counts.
        _, found, rest = prompt.partition("\n\n# Context\n\n[Source 1]\n")
        if not found:
            return OUT_OF_SCOPE
        body = rest.split("\n\n", 1)[-1].strip().split("\n", 1)[0]
        return f"{body[: max_output_tokens or 400]} [Source 1]"


class BackingOffChat:
    """Wraps a chat provider: rate limits, broken connections and server errors are tried again, each wait twice the one before."""

    def __init__(self, provider: ChatProvider, most: int = 3, first: float = 1.0, sleep: Callable[[float], None] = time.sleep) -> None:
        self.provider, self.most, self.first, self.sleep = provider, most, first, sleep

    def generate(self, prompt: str, temperature: float | None = None, max_output_tokens: int | None = None) -> str:
        return with_backoff(lambda: self.provider.generate(prompt, temperature, max_output_tokens), self.most, self.first, self.sleep)


def source_block(rank: Column, title: Column, url: Column, index: Column, total: Column, content: Column) -> Column:
    s = lambda c: c.cast("string")
    return F.concat(F.lit("[Source "), s(rank), F.lit("]\nTitle: "), title, F.lit("\nURL: "), url, F.lit("\nChunk: "), s(index + 1), F.lit(" of "), s(total), F.lit("\n\n"), content)


def prompt(question: Column, sources: Column) -> Column:
    """Instructions, context, question, answer header. `sources` is an array of (rank, title, url, chunkIndex, totalChunks, content)."""
    ordered = F.array_sort(F.coalesce(sources, F.array().cast("array<struct<rank:int,title:string,url:string,chunkIndex:int,totalChunks:int,content:string>>")))
    blocks = F.array_join(F.transform(ordered, lambda x: source_block(x["rank"], x["title"], x["url"], x["chunkIndex"], x["totalChunks"], x["content"])), RULE)
    context = F.when(F.size(ordered) > 0, blocks).otherwise(F.lit(NO_CONTEXT))
    return F.concat(F.lit(INSTRUCTIONS + "\n\n# Context\n\n"), context, F.lit("\n\n# Question\n\n"), question, F.lit("\n\n# Answer\n"))


def retrieve(questions: DataFrame, chunks: DataFrame, provider: EmbeddingProvider, top_k: int = 3, metric: str = "cosine") -> DataFrame:
    """(qid, rank, score) and the columns of the chunk, for questions (qid, text) over chunks with id and embedding."""
    asked = questions.select("qid", embed(F.col("text"), provider).alias("embedding"))
    chunks = saved(chunks, "chunks")  # cut and embedded once, read by the search and by the join back
    found = search.batch_top_k(chunks, asked, top_k, metric)
    return found.join(chunks.drop("embedding"), "id").select("qid", F.col("rank").cast("int").alias("rank"), "score", "id", "title", "url", "content", "chunkIndex", "totalChunks")


def citations(found: DataFrame) -> DataFrame:
    """(qid, rank, title, url, chunkNumber, totalChunks, distance): chunk numbers start at 1."""
    return found.select("qid", "rank", "title", "url", (F.col("chunkIndex") + 1).cast("int").alias("chunkNumber"), "totalChunks", F.col("score").alias("distance"))


def prompts(questions: DataFrame, found: DataFrame) -> DataFrame:
    """(qid, text, prompt, sources) for every question, also those without any source."""
    packed = found.groupBy("qid").agg(F.collect_list(F.struct("rank", "title", "url", "chunkIndex", "totalChunks", "content")).alias("hits"), F.collect_list(F.struct("rank", "title", "url", (F.col("chunkIndex") + 1).cast("int").alias("chunkNumber"), "totalChunks", F.col("score").alias("distance"))).alias("sources"))
    return questions.join(packed, "qid", "left").select("qid", "text", prompt(F.col("text"), F.col("hits")).alias("prompt"), F.array_sort("sources").alias("sources"))


def ask(questions: DataFrame, chunks: DataFrame, provider: EmbeddingProvider, chat: ChatProvider | None = None, top_k: int = 3, temperature: float | None = None, max_output_tokens: int | None = None) -> DataFrame:
    """(qid, answer, sources). An empty answer of the provider is an error."""
    model = chat or ExtractiveChat()

    @F.arrow_udf(T.StringType())
    def answer(text: pa.Array) -> pa.Array:
        out = [model.generate(t.as_py(), temperature, max_output_tokens) for t in text]
        if not all(out):
            raise ValueError("the chat provider gave an empty answer")
        return pa.array(out, pa.string())

    rows = prompts(questions, retrieve(questions, chunks, provider, top_k))
    return rows.select("qid", answer(F.col("prompt")).alias("answer"), "sources")
