"""Conversation state: turns, budgets, compaction, history and expiry.

A session may hold a large share of all turns. Totals are partial aggregations, the
last turns of a session are a row-number filter that each partition applies before
the shuffle, and whole histories are only assembled below the token budget.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lotusflow.functions import text as T
from lotusflow.functions.fixed import (
    CHARS_PER_TOKEN, INPUT_CHARS, KEEP_TURNS, OUTPUT_TOKENS, SESSION_HOURS, SUMMARY_BEFORE, SUMMARY_MARK, SUMMARY_REQUEST, SUMMARY_TURNS,
)
from lotusflow.operators.context import system_message
from lotusflow.operators.indexing import latest, upsert
from lotusflow.providers import Writer, write_texts
from lotusflow.runtime import materialize

#: Tokens of raw history from which a session is compacted.
THRESHOLD = int(0.7 * KEEP_TURNS * (-(-INPUT_CHARS // CHARS_PER_TOKEN) + OUTPUT_TOKENS))


def current_turns(log: DataFrame) -> DataFrame:
    """The latest state of each turn id in an append-only log.

    A row with an answer beats one without; then the later ``created_at``, the
    higher number, and the larger texts decide, so the result is the same each time.
    """
    return latest(
        log,
        ["id"],
        F.col("answer").isNotNull().desc(),
        F.col("created_at").desc_nulls_last(),
        F.col("turn_no").desc_nulls_last(),
        F.col("question").desc_nulls_last(),
        F.col("answer").desc_nulls_last(),
    )


def completed_turns(log: DataFrame) -> DataFrame:
    """Current turns that have an answer."""
    return current_turns(log).where(F.col("answer").isNotNull())


def session_tokens(turns: DataFrame) -> DataFrame:
    """``(session_id, raw_tokens, needs_compact)`` of completed turns."""
    spent = T.turn_tokens(F.col("question"), F.col("answer"), CHARS_PER_TOKEN)
    return (
        turns.groupBy("session_id")
        .agg(F.sum(spent).cast("long").alias("raw_tokens"))
        .withColumn("needs_compact", F.col("raw_tokens") >= THRESHOLD)
    )


def token_totals(turns: DataFrame) -> DataFrame:
    """``(session_id, token_total)``: the sum of the hints."""
    return turns.groupBy("session_id").agg(F.sum(F.coalesce("tokens_hint", F.lit(0))).cast("long").alias("token_total"))


def last_turns(turns: DataFrame, n: int = KEEP_TURNS) -> DataFrame:
    """The last n turns of each session, ``from_end`` counting from 1."""
    order = Window.partitionBy("session_id").orderBy(F.col("turn_no").desc_nulls_last(), F.col("id"))
    return turns.withColumn("from_end", F.row_number().over(order)).where(F.col("from_end") <= n)


def next_turn_numbers(turns: DataFrame) -> DataFrame:
    """``(session_id, next_turn_no, turns)``."""
    return turns.groupBy("session_id").agg(
        (F.coalesce(F.max("turn_no"), F.lit(0)) + 1).cast("int").alias("next_turn_no"), F.count(F.lit(1)).alias("turns")
    )


def latest_summaries(turns: DataFrame) -> DataFrame:
    """``(session_id, summary, summary_turn_no)`` of the highest turn with a summary."""
    best = F.max(F.when(F.col("summary").isNotNull() & F.col("turn_no").isNotNull(), F.struct("turn_no", "summary")))
    return turns.groupBy("session_id").agg(best.alias("b")).where("b is not null").select(
        "session_id", "b.summary", F.col("b.turn_no").alias("summary_turn_no")
    )


def compaction_ranges(turns: DataFrame, keep: int = KEEP_TURNS) -> DataFrame:
    """``(session_id, after_turn, to_turn)``: the completed turns the next summary must cover.

    Sessions with at most ``keep`` completed turns, or nothing new since the last
    summary, give no row. ``after_turn`` is null where no summary exists.
    """
    cutoff = last_turns(turns, keep + 1).where(F.col("from_end") == keep + 1).select("session_id", F.col("turn_no").alias("to_turn"))
    known = latest_summaries(turns).select("session_id", F.col("summary_turn_no").alias("after_turn"))
    return cutoff.join(known, "session_id", "left").where("after_turn is null or after_turn < to_turn").select("session_id", "after_turn", "to_turn")


def turns_to_summarize(turns: DataFrame, keep: int = KEEP_TURNS) -> DataFrame:
    """The turns inside the compaction ranges."""
    ranges = compaction_ranges(turns, keep)
    return turns.join(ranges, "session_id").where("turn_no <= to_turn and (after_turn is null or turn_no > after_turn)")


def rewrite_context(turns: DataFrame, n: int = KEEP_TURNS) -> DataFrame:
    """``(session_id, context)``: the last turns as lines of text, long answers shortened."""
    line = F.concat(F.lit("User: "), F.coalesce("question", F.lit("")), F.lit("\nAssistant: "), T.shorten(F.col("answer")))
    rows = last_turns(turns, n).select("session_id", (-F.col("from_end")).alias("at"), line.alias("line"))
    ordered = F.array_sort(F.collect_list(F.struct("at", "line")))
    return rows.groupBy("session_id").agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("context"))


def history_turns(turns: DataFrame, compacted: Column | None = None, has_compactor: bool = False) -> DataFrame:
    """The raw turns that go into the next prompt of each session.

    Below the threshold all of them. From it on the last three, if there is no
    compactor or the compactor gave a summary (``compacted``, a condition on
    ``session_id``); all of them where it gave none.
    """
    totals = session_tokens(turns)
    fits = ~F.col("needs_compact")
    if has_compactor:
        fits = fits | ~F.coalesce(compacted if compacted is not None else F.lit(False), F.lit(False))
    whole = turns.join(totals.where(fits).select("session_id"), "session_id", "left_semi")
    rest = last_turns(turns).drop("from_end").join(totals.where(~fits).select("session_id"), "session_id", "left_semi")
    return whole.unionByName(rest)


def history_messages(turns: DataFrame, questions: DataFrame, compacted: Column | None = None, has_compactor: bool = False) -> DataFrame:
    """The message list of each question ``(session_id, question, context)`` as rows; see ``history_turns`` for the compactor.

    Columns ``session_id, part, turn_no, role, content``, ordered by part (0 system,
    1 summary, 2 raw turns, 3 question), turn number and role (the user first).
    """
    # Every branch reads the current turns, so they are found once.
    turns = materialize(turns)
    asked = questions.select("session_id", F.col("question").alias("q"), "context")
    part = lambda df, no, turn, role, content: df.select(
        "session_id", F.lit(no).alias("part"), turn.cast("int").alias("turn_no"), F.lit(role).alias("role"), content.alias("content")
    )
    none = F.lit(0)
    known = latest_summaries(turns).join(asked.select("session_id"), "session_id", "left_semi")
    raw = history_turns(turns, compacted, has_compactor).join(asked.select("session_id"), "session_id", "left_semi")
    return (
        part(asked, 0, none, "system", system_message(F.col("context")))
        .unionByName(part(known, 1, none, "user", F.concat(F.lit(SUMMARY_MARK), F.col("summary"))))
        .unionByName(part(raw, 2, F.col("turn_no"), "user", F.col("question")))
        .unionByName(part(raw, 2, F.col("turn_no"), "assistant", F.col("answer")))
        .unionByName(part(asked, 3, none, "user", F.col("q")))
    )


def message_pairs(turns: DataFrame) -> DataFrame:
    """``(id, session_id, turn_no, role, content)``: the user's message of each turn, and the assistant's where there is an answer."""
    said = F.filter(
        F.array(F.struct(F.lit("user").alias("role"), F.col("question").alias("content")), F.struct(F.lit("assistant").alias("role"), F.col("answer").alias("content"))),
        lambda m: (m["role"] == "user") | m["content"].isNotNull(),
    )
    return turns.select("id", "session_id", "turn_no", F.explode(said).alias("m")).select("id", "session_id", "turn_no", "m.role", "m.content")


def summary_prompts(turns: DataFrame, keep: int = KEEP_TURNS) -> DataFrame:
    """``(session_id, up_to_turn, old_summary, prompt)``: what the next summary of each session must be written from.

    The prompt holds the summary so far and the completed turns since, in order. A
    session is summarized in steps, so what meets here is what was added since the
    last step; the first step of a session holds all but its last turns.
    """
    due = turns_to_summarize(turns, keep)
    line = F.concat(F.lit("User: "), F.coalesce("question", F.lit("")), F.lit("\nAssistant: "), F.coalesce("answer", F.lit("")))
    ordered = F.array_sort(F.collect_list(F.struct("turn_no", "id", line.alias("line"))))
    said = due.groupBy("session_id").agg(F.max("turn_no").alias("up_to_turn"), F.array_join(F.transform(ordered, lambda x: x["line"]), "\n\n").alias("said"))
    known = latest_summaries(turns).select("session_id", F.col("summary").alias("old_summary"))
    before = F.when(F.coalesce("old_summary", F.lit("")) != "", F.concat(F.lit(SUMMARY_BEFORE), F.col("old_summary"), F.lit("\n\n"))).otherwise("")
    return said.join(known, "session_id", "left").select(
        "session_id", "up_to_turn", "old_summary", F.concat(F.lit(SUMMARY_REQUEST), before, F.lit(SUMMARY_TURNS), F.col("said")).alias("prompt")
    )


def compact(turns: DataFrame, writer: Writer, keep: int = KEEP_TURNS) -> DataFrame:
    """``(session_id, summary, up_to_turn)`` after a compaction of completed turns.

    Sessions with something new get the text of ``writer``; where it fails or gives
    none, the old summary stays with its turn. Sessions with nothing new keep their
    summary; those without any give no row. No lock is needed: a session is one row.
    """
    asked = write_texts(summary_prompts(turns, keep), "prompt", writer, "written")
    made = asked.where(F.length(T.strip(F.col("written"))) > 0).select("session_id", T.strip(F.col("written")).alias("summary"), "up_to_turn")
    old = latest_summaries(turns).select("session_id", "summary", F.col("summary_turn_no").alias("up_to_turn"))
    return upsert(old, made, ["session_id"])


def save_summaries(turns: DataFrame, summaries: DataFrame) -> DataFrame:
    """The turns with each summary ``(session_id, summary, up_to_turn)`` on the turn it reaches to.

    Of several turns with that number the one with the smallest id takes it.
    """
    order = Window.partitionBy("session_id", "turn_no").orderBy("id")
    place = summaries.select("session_id", F.col("up_to_turn").alias("turn_no"), F.col("summary").alias("new_summary"))
    marked = turns.join(place, ["session_id", "turn_no"], "left").withColumn("n", F.row_number().over(order))
    kept = F.when((F.col("n") == 1) & F.col("new_summary").isNotNull(), F.col("new_summary")).otherwise(F.col("summary"))
    return marked.withColumn("summary", kept).select(*turns.columns)


def session_exists(asked: DataFrame, sessions: DataFrame) -> DataFrame:
    """``(session_id, known)`` of the sessions asked for."""
    known = sessions.select("session_id").distinct().withColumn("known", F.lit(True))
    return asked.join(known, "session_id", "left").select("session_id", F.coalesce("known", F.lit(False)).alias("known"))


def duplicate_turns(turns: DataFrame) -> DataFrame:
    """``(session_id, turn_no, n)`` of numbers that more than one turn claims; they must be rejected."""
    return turns.groupBy("session_id", "turn_no").agg(F.count(F.lit(1)).alias("n")).where("n > 1 and turn_no is not null")


def pending_turns(log: DataFrame) -> DataFrame:
    """Current turns without an answer."""
    return current_turns(log).where(F.col("answer").isNull())


def expired_sessions(sessions: DataFrame, log: DataFrame, now: Column, hours: int = SESSION_HOURS) -> DataFrame:
    """Sessions idle for longer than ``hours`` without a pending turn."""
    idle = sessions.where(F.col("last_active_at") < now - F.make_dt_interval(hours=F.lit(hours)))
    return idle.join(pending_turns(log).select("session_id"), "session_id", "left_anti")


def touch_sessions(activity: DataFrame) -> DataFrame:
    """``(session_id, created_at, last_active_at)`` of an activity log ``(session_id, at)``."""
    return activity.groupBy("session_id").agg(F.min("at").alias("created_at"), F.max("at").alias("last_active_at"))


def orphan_turns(turns: DataFrame, sessions: DataFrame) -> DataFrame:
    """Turns whose session does not exist."""
    return turns.join(sessions.select("session_id"), "session_id", "left_anti")
