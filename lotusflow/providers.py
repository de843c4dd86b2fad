"""External models behind small protocols, with deterministic offline stand-ins.

A provider is a plain object with one method over a list of texts; it is called in
Arrow batches on the workers, a bounded number of texts at a time, with retries.
"""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotusflow.functions import text as T
from lotusflow.functions.fixed import REWRITE_REQUEST, SUITE_REQUEST
from lotusflow.runtime import arrow_map


class Embedder(Protocol):
    """Texts to vectors."""

    dim: int

    def embed(self, texts: Sequence[str]) -> list[list[float]]: ...


class Writer(Protocol):
    """Prompts to texts: rewriting, answering, summarizing, judging, suggesting."""

    def write(self, prompts: Sequence[str]) -> list[str | None]: ...


class HashEmbedder:
    """Unit vectors from the hashes of the words; the same text gives the same vector."""

    def __init__(self, dim: int = 64) -> None:
        self.dim = dim

    def embed(self, texts: Sequence[str]) -> list[list[float]]:
        out = []
        for text in texts:
            v = np.zeros(self.dim)
            for word in text.lower().split():
                h = hashlib.blake2b(word.encode(), digest_size=8).digest()
                v[int.from_bytes(h[:4], "little") % self.dim] += 1 if h[4] & 1 else -1
            n = np.linalg.norm(v)
            out.append((v / n if n else v).tolist())
        return out


class EchoWriter:
    """Returns the last line of each prompt."""

    def write(self, prompts: Sequence[str]) -> list[str | None]:
        return [p.strip().split("\n")[-1] if p.strip() else None for p in prompts]


class KeywordJudge:
    """Judges a prompt by the keywords and the answer in it: the share of keywords the answer has, as fenced JSON."""

    def write(self, prompts: Sequence[str]) -> list[str | None]:
        out = []
        for p in prompts:
            part = lambda mark, p=p: p.split(mark, 1)[-1].split("\n", 1)[0] if mark in p else ""
            words = [w for w in part("Từ khóa: ").split(", ") if w]
            answer = part("Trả lời: ").lower()
            found = sum(w.lower() in answer for w in words)
            score = 1 + 4 * found // max(1, len(words))
            out.append(f'```json\n{{"correctness": {score}, "relevance": {5 if answer else 1}, "hallucination": {str(not found).lower()}, "refusal_appropriate": "n/a", "reasoning": "{found}"}}\n```')
        return out


def rewrite_queries(queries: DataFrame, writer: Writer | None = None) -> DataFrame:
    """Adds ``rewritten_query`` and ``intent`` to ``(query, ...)``.

    Without a writer, and where it fails, the normalized query stands as it is with the
    default intent.
    """
    plain = queries.withColumn("_normal", T.normalize_query(F.col("query")))
    if writer is None:
        asked = plain.withColumn("_written", F.lit(None).cast("string"))
    else:
        asked = write_texts(plain.withColumn("_ask", F.concat(F.lit(REWRITE_REQUEST), F.col("_normal"))), "_ask", writer, "_written").drop("_ask")
    made = F.from_json(T.fenced_json(F.col("_written")), "rewritten_query string, intent string")
    return asked.withColumn("_made", made).select(
        *queries.columns, F.coalesce("_made.rewritten_query", "_normal").alias("rewritten_query"), F.coalesce("_made.intent", F.lit("factual")).alias("intent")
    )


def chat_prompt(messages: DataFrame) -> DataFrame:
    """``(session_id, prompt)`` of message rows ``(session_id, part, turn_no, role, content)``: the system message first, then the others in order.

    What meets is one prompt, which the history keeps below its budget.
    """
    line = F.concat(F.col("role"), F.lit(": "), F.coalesce("content", F.lit("")))
    place = F.struct("part", "turn_no", F.when(F.col("role") == "assistant", 1).otherwise(0).alias("second"), line.alias("line"))
    return messages.groupBy("session_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(place)), lambda x: x["line"]), "\n\n").alias("prompt"))


def suggest(answers: DataFrame, writer: Writer, limit: int = 4) -> DataFrame:
    """Adds ``suggestions`` to ``(question, answer)``: the lines the writer gives; a failure gives none."""
    asked = answers.withColumn("_ask", F.concat_ws("\n", "question", "answer"))
    made = write_texts(asked, "_ask", writer, "_written")
    return made.withColumn("suggestions", F.coalesce(T.suggestion_lines(F.col("_written"), limit), F.array().cast("array<string>"))).drop("_ask", "_written")


def suite_prompt(corpus: str, examples: str) -> str:
    """What a writer of evaluation suites is asked."""
    return f"{SUITE_REQUEST}{corpus}\n\n{examples}"


def attempt(call: Callable[[list[str]], list], texts: list[str], tries: int = 3, wait: float = 1.0) -> list:
    """Call with retries, waiting twice as long each time; the last error is raised."""
    for i in range(tries):
        try:
            made = call(texts)
            if len(made) != len(texts):
                raise ValueError("the provider returned another number of results")
            return made
        except Exception:
            if i == tries - 1:
                raise
            time.sleep(wait * 2**i)
    raise AssertionError


def embed_texts(df: DataFrame, text: str, provider: Embedder, into: str = "dense_vector", batch: int = 32) -> DataFrame:
    """Adds the vector of each text; null texts give a null vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(text).to_pylist()
            at = [i for i, t in enumerate(texts) if t is not None]
            made: list[list[float] | None] = [None] * len(texts)
            for i in range(0, len(at), batch):
                part = at[i : i + batch]
                for j, v in zip(part, attempt(provider.embed, [texts[j] for j in part]), strict=True):
                    made[j] = v
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(made, pa.list_(pa.float32()))], names=[*b.schema.names, into])

    fields = [f"`{n}` {t}" for n, t in df.dtypes] + [f"`{into}` array<float>"]
    return arrow_map(df, run, ", ".join(fields))


def write_texts(df: DataFrame, prompt: str, provider: Writer, into: str, batch: int = 8) -> DataFrame:
    """Adds the text written for each prompt; null prompts and failures give null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            prompts = b.column(prompt).to_pylist()
            made: list[str | None] = [None] * len(prompts)
            at = [i for i, t in enumerate(prompts) if t is not None]
            for i in range(0, len(at), batch):
                part = at[i : i + batch]
                try:
                    for j, v in zip(part, attempt(provider.write, [prompts[j] for j in part]), strict=True):
                        made[j] = v
                except Exception:  # noqa: S112
                    continue
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(made, pa.string())], names=[*b.schema.names, into])

    fields = [f"`{n}` {t}" for n, t in df.dtypes] + [f"`{into}` string"]
    return arrow_map(df, run, ", ".join(fields))
