"""The answer event stream: events, payloads and token batching."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState

from lotusflow.functions.fixed import FLUSH_CHARS, FLUSH_MS, STEPS
from lotusflow.runtime import arrow_map, ship

#: The message where nothing was found.
NO_CONTEXT = "Không tìm thấy thông tin phù hợp."


def answer_events(answers: DataFrame) -> DataFrame:
    """``(query_id, seq, type, step, message, data)`` of answers ``(query_id, results, tokens, answer)``.

    Four progress events, one event per token and a final one; without a result two
    progress events and an error.
    """
    event = lambda kind, step, message, data: F.struct(
        F.lit(kind).alias("type"), step.alias("step"), message.alias("message"), data.alias("data")
    )
    none = F.lit(None).cast("string")
    progress = [event("progress", F.lit(s), F.replace(F.lit(m), F.lit("{n}"), F.col("results").cast("string")), none) for s, m in STEPS]
    tokens = F.transform(F.coalesce("tokens", F.array().cast("array<string>")), lambda t: event("token", none, none, t))
    full = F.concat(F.array(*progress), tokens, F.array(event("done", none, none, F.col("answer"))))
    failed = F.array(*progress[:2], event("error", none, F.lit(NO_CONTEXT), none))
    stream = F.when(F.coalesce("results", F.lit(0)) > 0, full).otherwise(failed)
    return answers.select("query_id", F.posexplode(stream).alias("seq", "e")).select("query_id", "seq", "e.*")


def payload(kind: Column, step: Column, message: Column, data: Column) -> Column:
    """The JSON of an event."""
    return (
        F.when(kind == "progress", F.to_json(F.struct(kind.alias("type"), step.alias("step"), message.alias("message"))))
        .when(kind == "token", F.to_json(F.struct(kind.alias("type"), data.alias("content"))))
        .when(kind == "done", F.to_json(F.struct(kind.alias("type"), data.alias("answer"))))
        .otherwise(F.to_json(F.struct(F.lit("error").alias("type"), F.coalesce(message, F.lit("Unknown error")).alias("message"))))
    )


def final_answers(events: DataFrame) -> DataFrame:
    """``(query_id, ok, answer)``: the first final event of each stream; an error gives its message.

    Streams without a final event give the message for missing context.
    """
    end = F.min(F.when(F.col("type").isin("done", "error"), F.struct("seq", (F.col("type") == "done").alias("ok"), F.coalesce(F.when(F.col("type") == "done", F.col("data")), F.col("message")).alias("text"))))
    met = events.groupBy("query_id").agg(end.alias("e"))
    return met.select("query_id", F.coalesce("e.ok", F.lit(False)).alias("ok"), F.when(F.col("e").isNull(), F.lit(NO_CONTEXT)).otherwise(F.col("e.text")).alias("answer"))


def join_tokens(tokens: DataFrame) -> DataFrame:
    """``(stream_id, text)``: the tokens ``(stream_id, seq, token)`` of each stream in order; one answer meets, never more."""
    ordered = F.array_sort(F.collect_list(F.struct("seq", "token")))
    return tokens.groupBy("stream_id").agg(F.array_join(F.transform(ordered, lambda x: x["token"]), "").alias("text"))


def steady_schedule(tokens: DataFrame, first_ms: float, gap_ms: float) -> DataFrame:
    """Adds ``at_ms`` to tokens ``(stream_id, seq, token)``: the first after ``first_ms``, each next one ``gap_ms`` later."""
    return tokens.withColumn("at_ms", F.lit(float(first_ms)) + F.col("seq") * float(gap_ms))


def bursty_schedule(tokens: DataFrame, burst: int = 5, gap_ms: float = 5.0, pause_ms: float = 60.0) -> DataFrame:
    """Adds ``at_ms``: bursts of tokens ``gap_ms`` apart, with a pause after each burst."""
    return tokens.withColumn("at_ms", F.col("seq") * gap_ms + F.floor(F.col("seq") / burst) * pause_ms)


class Batcher:
    """Gathers the tokens of one stream into batches."""

    def __init__(self, chars: int, interval_ms: float, held: str = "", opened: float | None = None, number: int = 0) -> None:
        self.chars, self.interval_ms = chars, interval_ms
        self.held, self.opened, self.number = held, opened, number

    def flush(self, now: float | None = None) -> list[tuple[int, str]]:
        """What is held as a batch, if anything is."""
        out = [(self.number, self.held)] if self.held else []
        self.number += len(out)
        self.held, self.opened = "", now
        return out

    def add(self, at: float, token: str | None) -> list[tuple[int, str]]:
        """The batches that a token at a time completes."""
        if self.opened is None:
            self.opened = at
        due = lambda: self.held and at - self.opened >= self.interval_ms
        out = self.flush(at) if due() else []
        self.held += token or ""
        return out + (self.flush(at) if len(self.held) >= self.chars or due() else [])


def batch_tokens(tokens: DataFrame, chars: int = FLUSH_CHARS, interval_ms: int = FLUSH_MS) -> DataFrame:
    """``(stream_id, batch_no, content)`` of tokens ``(stream_id, seq, at_ms, token)``.

    A batch is flushed when it has ``chars`` characters, when the next token comes
    ``interval_ms`` or more after the last flush, and at the end. Rows of a stream
    are read in order from a sorted partition, one row at a time. A stream of tokens is
    batched the same way, and a timer flushes what no further token follows.
    """
    ordered = tokens.select(F.col("stream_id").cast("string"), F.col("seq").cast("long"), F.col("at_ms").cast("double"), "token")
    schema = "stream_id string, batch_no int, content string"
    if tokens.isStreaming:
        ship(tokens.sparkSession)
        return ordered.groupBy("stream_id").applyInPandasWithState(
            _stateful(chars, interval_ms), schema, "held string, opened double, number int", "append", "ProcessingTimeTimeout"
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream, batcher = None, Batcher(chars, interval_ms)
        out: list[tuple] = []

        def made() -> pa.RecordBatch:
            rows = pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate((pa.string(), pa.int32(), pa.string()))], names=["stream_id", "batch_no", "content"])
            out.clear()
            return rows

        for batch in batches:
            for s, at, token in zip(*(batch.column(c).to_pylist() for c in ("stream_id", "at_ms", "token")), strict=True):
                if s != stream:
                    out += [(stream, *b) for b in batcher.flush()]
                    stream, batcher = s, Batcher(chars, interval_ms)
                out += [(s, *b) for b in batcher.add(at, token)]
            if out:
                yield made()
        out += [(stream, *b) for b in batcher.flush()]
        if out:
            yield made()

    ordered = ordered.repartition("stream_id").sortWithinPartitions("stream_id", "seq").select("stream_id", "at_ms", "token")
    return arrow_map(ordered, run, schema)


#: Milliseconds after which an idle stream is forgotten.
IDLE_MS = 600_000


def _stateful(chars: int, interval_ms: float):
    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        batcher = Batcher(chars, interval_ms, *(state.get if state.exists else ("", None, 0)))
        if state.hasTimedOut and not batcher.held:
            state.remove()
            return
        if state.hasTimedOut:
            out = batcher.flush()
        else:
            rows = pd.concat(list(frames)).sort_values("seq", kind="stable")
            out = [b for at, token in zip(rows["at_ms"], rows["token"], strict=True) for b in batcher.add(at, token)]
        state.update((batcher.held, batcher.opened, batcher.number))
        state.setTimeoutDuration(max(1, int(interval_ms)) if batcher.held else IDLE_MS)
        if out:
            yield pd.DataFrame({"stream_id": [key[0]] * len(out), "batch_no": [n for n, _ in out], "content": [c for _, c in out]})

    return run
