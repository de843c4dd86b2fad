"""Rebuilding conversations from message rows (problem 4).

Chat turns arrive as versioned rows in any order. Their messages form a reply graph:
an answer replies to the question of its turn, a question to the last message of the
turn numbered one less; a turn without any text stands in the graph as a silent node.
Turns that share a number reply to the same message. Kahn's algorithm orders the graph,
of several messages that are ready the earlier one first; messages it cannot reach hang
behind a gap, behind an answer whose question is missing, or on a cycle. Along the
order the roles must alternate, and every question must have a reply.

A session may hold a large share of all rows, so the graph of a session is cut
into blocks of ``BLOCK`` consecutive turn numbers. Turns are first met per (session,
turn number), where the earliest and the latest stay and the others are only counted,
so a block has at most four nodes for each of its numbers; the first turn of a block
hangs on the block before, and a session is whole when all its blocks are full.
"""

from __future__ import annotations

import heapq
from collections.abc import Hashable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lotusflow.llm.common import arrow_map, has_text, materialize, sorted_groups, table

#: Turn numbers in one block of a session's reply graph.
BLOCK = 4096


def kahn_order(
    nodes: Sequence[Hashable],
    parents: dict[Hashable, Hashable],
    stamps: dict[Hashable, object],
) -> tuple[list[Hashable], list[Hashable]]:
    """Topological order of a reply graph and the nodes left over.

    ``parents`` maps a node to the message it replies to. Among nodes that are
    ready at the same time the earlier stamp comes first, then the smaller node.
    Nodes on a cycle, or behind one, or behind a missing parent are left over.
    """
    known = set(nodes)
    children: dict[Hashable, list[Hashable]] = {}
    waiting: dict[Hashable, int] = {}
    ready: list[tuple] = []
    for node in known:
        parent = parents.get(node)
        if parent is None:
            heapq.heappush(ready, (stamps.get(node, 0), node))
            continue
        waiting[node] = 1
        if parent in known:
            children.setdefault(parent, []).append(node)
    order: list[Hashable] = []
    while ready:
        _, node = heapq.heappop(ready)
        order.append(node)
        for child in children.get(node, ()):
            waiting[child] -= 1
            if waiting[child] == 0:
                del waiting[child]
                heapq.heappush(ready, (stamps.get(child, 0), child))
    return order, sorted(waiting)


def text_digest(question: Column, answer: Column) -> Column:
    """A hash of both texts that tells versions of one turn apart."""
    return F.xxhash64(F.coalesce(question, F.lit("")), question.isNull(), F.coalesce(answer, F.lit("")), answer.isNull())


def latest_turns(turns: DataFrame) -> DataFrame:
    """One row per turn id: the version whose answer has a letter or digit.

    Among several such versions, or if there is none, the latest ``created_at``
    wins, then the one with a question, then the larger values; exact repeats
    collapse. Turns without an id are kept row by row as turns of their own;
    turns without a session belong to no conversation and are left out. The texts
    stay behind; ``digest`` finds them again.
    """
    flags = turns.where(F.col("session_id").isNotNull()).select(
        "id",
        "session_id",
        "turn_no",
        "created_at",
        has_text(F.col("question")).alias("has_q"),
        has_text(F.col("answer")).alias("has_a"),
        text_digest(F.col("question"), F.col("answer")).alias("digest"),
    )
    value = F.struct("has_a", "created_at", "has_q", "turn_no", "session_id", "digest")
    best = flags.where(F.col("id").isNotNull()).groupBy("id").agg(F.max(value).alias("v")).select("id", "v.*")
    return best.select(*flags.columns).unionByName(flags.where(F.col("id").isNull()))


_USER, _ASSISTANT, _SILENT = "user", "assistant", "silent"


def reply_graph(turns: Sequence[tuple]) -> tuple[dict, dict, dict]:
    """Parents, stamps and roles of the messages of ``(number, key, stamp, has_q, has_a)`` turns.

    A message is ``(number, key, role)``. A question replies to the last message of the
    first turn with the number before, if the first number of the turns is smaller; a
    parent that is not among the messages is missing.
    """
    turns = sorted(turns, key=lambda t: (t[0], t[2], t[1]))
    parents: dict = {}
    stamps: dict = {}
    roles: dict = {}
    ends: dict = {}
    for number, key, stamp, has_q, has_a in turns:
        made = [(number, key, role) for role, there in ((_USER, has_q), (_ASSISTANT, has_a), (_SILENT, not has_q and not has_a)) if there]
        for m in made:
            stamps[m], roles[m] = stamp, m[2]
            if m[2] == _ASSISTANT:
                parents[m] = (number, key, _USER)
        ends.setdefault(number, made[-1])
    first = turns[0][0]
    for m, role in roles.items():
        if role != _ASSISTANT and m[0] > first:
            parents[m] = ends.get(m[0] - 1, "missing")
    return parents, stamps, roles


def check_thread(parents: dict, stamps: dict, roles: dict) -> tuple[list, set, set, set]:
    """(order, left over, out of turn, unanswered) of the messages of any reply graph.

    Out of turn are answers that do not follow a question in Kahn's order; unanswered
    are questions no answer replies to, reached or not.
    """
    order, left = kahn_order(list(roles), parents, stamps)
    odd, before = set(), _ASSISTANT
    for m in order:
        if roles[m] == _ASSISTANT and before != _USER:
            odd.add(m)
        if roles[m] != _SILENT:
            before = roles[m]
    answered = {parents.get(m) for m, role in roles.items() if role == _ASSISTANT}
    return order, set(left), odd, {m for m, role in roles.items() if role == _USER and m not in answered}


def order_turns(turns: Sequence[tuple], opens: bool) -> list[tuple]:
    """``(key, place, reached, sound, replied)`` of each turn of a block.

    ``place`` counts messages before the turn in Kahn's order, a silent turn counting
    as two; ``reached`` is false for turns with a message left over, or for all of them
    where the block should open with its first number and does not (``opens``);
    ``sound`` is false where the roles stop alternating; ``replied`` is false for a
    question without a reply.
    """
    parents, stamps, roles = reply_graph(turns)
    order, left, odd, open_questions = check_thread(parents, stamps, roles)
    place: dict = {}
    at = 0
    for m in order:
        place.setdefault(m[:2], at)
        at += 2 if roles[m] == _SILENT else 1
    lost, odd, waiting = ({m[:2] for m in some} for some in (left, odd, open_questions))
    return [
        (key, place.get((number, key), 0), opens and (number, key) not in lost, (number, key) not in odd, (number, key) not in waiting)
        for number, key, *_ in turns
    ]


def _order_blocks(block: int):
    schema = pa.schema(
        [
            ("session_id", pa.string()), ("turn_id", pa.string()), ("turn_no", pa.int64()), ("digest", pa.int64()), ("place", pa.int64()),
            ("reached", pa.bool_()), ("sound", pa.bool_()), ("replied", pa.bool_()), ("asked", pa.bool_()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []

        def flush() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
            rows.clear()
            return made

        for group in sorted_groups(batches, ["session_id", "block"]):
            session, start = group.column("session_id")[0].as_py(), group.column("block")[0].as_py() * block
            turns, kept = [], []
            for number, n, low, high in zip(*(group.column(c).to_pylist() for c in ("turn_no", "n", "low", "high")), strict=True):
                # Two turns of one number differ in their stamp, id or texts, or come from the same row.
                for i, t in enumerate((low,) if n == 1 else (low, high)):
                    turns.append((number, (t["id"] or "", i), t["stamp"] or 0, t["has_q"], t["has_a"]))
                    kept.append((t["id"], number, t["digest"], t["has_q"]))
            opens = min(t[0] for t in turns) == start + 1
            for (key, number, digest, asked), (_, place, reached, sound, replied) in zip(kept, order_turns(turns, opens), strict=True):
                rows.append((session, key, number, digest, 2 * start + place, reached, sound, replied, asked))
            if len(rows) >= 8192:
                yield flush()
        if rows:
            yield flush()

    return run, "session_id string, turn_id string, turn_no long, digest long, place long, reached boolean, sound boolean, replied boolean, asked boolean"


def ordered_turns(latest: DataFrame, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """The turns of ``latest_turns`` per number, and those in the reply graph with their order.

    The first has ``n`` turns of each (session, number) with the flags of all of them.
    """
    turn = F.struct(
        F.unix_micros("created_at").alias("stamp"), F.col("id"), F.col("has_q"), F.col("has_a"), F.col("digest")
    )
    per_number = latest.groupBy("session_id", "turn_no").agg(
        F.count(F.lit(1)).alias("n"),
        F.max(F.col("has_q") | F.col("has_a")).alias("any_text"),
        F.max(F.col("has_q") & ~F.col("has_a")).alias("open_question"),
        F.min(turn).alias("low"),
        F.max(turn).alias("high"),
    )
    placed = per_number.where(F.col("turn_no") >= 1).select(
        "session_id",
        F.expr(f"cast(floor((turn_no - 1) / {block}) as bigint)").alias("block"),
        F.col("turn_no").cast("long").alias("turn_no"),
        "n",
        "low",
        "high",
    )
    run, schema = _order_blocks(block)
    blocks = placed.repartition("session_id", "block").sortWithinPartitions("session_id", "block")
    return per_number, arrow_map(blocks, run, schema)


def session_report(turns: DataFrame, sessions: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per session with what is wrong with it.

    Columns: ``session_id``, ``empty`` (no turn has a question or an answer),
    ``broken`` (numbers are not exactly 1..n each once, an answer lacks its
    question, or the session is unknown), ``missing_reply`` (a question lacks its
    answer). ``empty`` excludes the other two. Null turn numbers count as broken;
    null sessions are ignored; sessions without any turn are empty. With no rows
    in either table the result has no rows.
    """
    return _report(*ordered_turns(latest_turns(turns), block), sessions)


def _report(per_number: DataFrame, ordered: DataFrame, sessions: DataFrame) -> DataFrame:
    graph = ordered.groupBy("session_id").agg(
        F.count_if("reached").alias("reached"),
        F.max("turn_no").alias("last"),
        F.bool_and(F.col("reached") & F.col("sound")).alias("in_order"),
        F.bool_or(~F.col("replied")).alias("unanswered"),
    )
    # Turns outside the graph: without a number, and between the two of one number.
    outside = F.col("turn_no").isNull() | (F.col("turn_no") < 1) | (F.col("n") > 2)
    counted = per_number.groupBy("session_id").agg(
        F.sum("n").alias("turns"),
        F.max("any_text").alias("any_text"),
        F.max(F.col("open_question") & outside).alias("open_outside"),
    )
    known = sessions.where(F.col("session_id").isNotNull()).select("session_id").distinct().withColumn("known", F.lit(True))
    joined = counted.join(graph, "session_id", "left").join(known, "session_id", "full_outer")
    empty = ~F.coalesce(F.col("any_text"), F.lit(False))
    whole = (
        F.coalesce("in_order", F.lit(False))
        & (F.coalesce("reached", F.lit(0)) == F.col("turns"))
        & (F.coalesce("last", F.lit(0)) == F.col("turns"))
    )
    return joined.select(
        "session_id",
        empty.alias("empty"),
        (~empty & (~whole | F.col("known").isNull())).alias("broken"),
        (~empty & (F.coalesce("unanswered", F.lit(False)) | F.col("open_outside"))).alias("missing_reply"),
    )


def dropped_sessions(turns: DataFrame, sessions: DataFrame, block: int = BLOCK) -> DataFrame:
    """``(session_id, reason)`` of every session that must be dropped."""
    reasons = F.array_compact(
        F.array(*[F.when(F.col(r), F.lit(r)) for r in ("empty", "broken", "missing_reply")])
    )
    return session_report(turns, sessions, block).select("session_id", F.explode(reasons).alias("reason"))


def conversation_messages(turns: DataFrame, sessions: DataFrame, block: int = BLOCK) -> DataFrame:
    """The messages of every sound session, one row each, in order.

    ``message_no`` is the place in Kahn's order, so a session of any size stays a set of
    rows; a turn without any text leaves its two numbers unused. Sessions with a
    defect are left out. The order is written once to the shared folder, without texts;
    the texts join it by key and digest, which shuffles each of them once.
    """
    per_number, ordered = ordered_turns(latest_turns(turns), block)
    ordered = materialize(ordered)
    sound = _report(per_number, ordered, sessions).where(~F.col("empty") & ~F.col("broken") & ~F.col("missing_reply"))
    kept = ordered.where("asked").join(sound.select("session_id"), "session_id", "left_semi").select(
        F.coalesce("turn_id", F.lit("")).alias("key"), "session_id", "turn_no", "digest", "place", "turn_id"
    )
    keys = ["key", "session_id", "turn_no", "digest"]
    texts = turns.select(
        F.coalesce("id", F.lit("")).alias("key"), "session_id", F.col("turn_no").cast("long").alias("turn_no"),
        text_digest(F.col("question"), F.col("answer")).alias("digest"), "question", "answer", F.unix_micros("created_at").alias("created_us"),
    ).groupBy(*keys).agg(F.max("created_us").alias("created_us"), F.first("question").alias("question"), F.first("answer").alias("answer"))
    messages = F.array(
        F.struct((F.col("place") + 1).alias("message_no"), F.lit("user").alias("role"), F.col("question").alias("content")),
        F.struct((F.col("place") + 2).alias("message_no"), F.lit("assistant").alias("role"), F.col("answer").alias("content")),
    )
    return texts.join(kept, keys).select("session_id", "turn_id", "created_us", F.explode(messages).alias("m")).select(
        "session_id", "m.message_no", "m.role", "m.content", "turn_id", "created_us"
    )


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions to be dropped, with the reasons."""
    return dropped_sessions(table(spark, sf_dir, "chat_turns"), table(spark, sf_dir, "chat_sessions"))


def p4_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ordered messages of the sound sessions."""
    return conversation_messages(table(spark, sf_dir, "chat_turns"), table(spark, sf_dir, "chat_sessions"))


P4_FOUND_SQL = r"""
WITH v AS (
  SELECT id, session_id, turn_no, created_at,
         coalesce(regexp_matches(question, '[\p{L}\p{N}]'), false) AS has_q,
         coalesce(regexp_matches(answer, '[\p{L}\p{N}]'), false) AS has_a
  FROM chat_turns WHERE session_id IS NOT NULL),
t AS (
  SELECT * FROM v
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY has_a DESC, created_at DESC NULLS LAST, has_q DESC, turn_no DESC NULLS LAST) = 1),
s AS (
  SELECT session_id, count(*) AS n, count(DISTINCT turn_no) AS d, count(turn_no) AS c,
         min(turn_no) AS lo, max(turn_no) AS hi,
         bool_or(has_q OR has_a) AS any_text,
         bool_or(has_a AND NOT has_q) AS orphan,
         bool_or(has_q AND NOT has_a) AS open_q
  FROM t GROUP BY session_id),
k AS (SELECT DISTINCT session_id FROM chat_sessions WHERE session_id IS NOT NULL),
j AS (
  SELECT coalesce(s.session_id, k.session_id) AS session_id,
         NOT coalesce(any_text, false) AS is_empty,
         coalesce(orphan, false) OR k.session_id IS NULL OR NOT coalesce(n = d AND n = c AND lo = 1 AND hi = n, false) AS is_broken,
         coalesce(open_q, false) AS is_open
  FROM s FULL OUTER JOIN k ON s.session_id = k.session_id)
SELECT session_id, 'empty' AS reason FROM j WHERE is_empty
UNION ALL SELECT session_id, 'broken' FROM j WHERE NOT is_empty AND is_broken
UNION ALL SELECT session_id, 'missing_reply' FROM j WHERE NOT is_empty AND is_open
"""

P4_MESSAGES_SQL = rf"""
WITH bad AS ({P4_FOUND_SQL}),
v AS (
  SELECT *, coalesce(regexp_matches(question, '[\p{{L}}\p{{N}}]'), false) AS has_q,
         coalesce(regexp_matches(answer, '[\p{{L}}\p{{N}}]'), false) AS has_a
  FROM chat_turns WHERE session_id IS NOT NULL),
t AS (
  SELECT * FROM v
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY has_a DESC, created_at DESC NULLS LAST, has_q DESC, turn_no DESC NULLS LAST) = 1),
g AS (SELECT * FROM t WHERE has_q AND has_a AND session_id NOT IN (SELECT session_id FROM bad))
SELECT session_id, CAST(turn_no * 2 - 1 AS BIGINT) AS message_no, 'user' AS role, question AS content, id AS turn_id, epoch_us(created_at) AS created_us FROM g
UNION ALL
SELECT session_id, CAST(turn_no * 2 AS BIGINT), 'assistant', answer, id, epoch_us(created_at) FROM g
"""
