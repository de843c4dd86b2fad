"""Queries of conversations, caches, evaluation and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotusflow.functions import text as T
from lotusflow.functions.fixed import JUDGE_REQUEST, NO_KEYWORDS, SUMMARY_BEFORE, SUMMARY_MARK, SUMMARY_REQUEST, SUMMARY_TURNS, SYSTEM_PROMPT
from lotusflow.operators import cache, context, evaluate, indexing, memory
from lotusflow.plans.tables import sql, table, turns
from lotusflow.providers import EchoWriter, KeywordJudge
from lotusflow.streaming import events as event_stream
from lotusflow.streaming import sessions as session_stream


def _done(spark: SparkSession, sf: str) -> DataFrame:
    return memory.completed_turns(turns(spark, sf).where("session_id is not null"))


def session_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """Tokens of each session's history and whether it must be compacted."""
    return memory.session_tokens(_done(spark, sf))


def token_totals(spark: SparkSession, sf: str) -> DataFrame:
    """Sum of the token hints of each session."""
    return memory.token_totals(_done(spark, sf))


def last_turns(spark: SparkSession, sf: str) -> DataFrame:
    """The last three completed turns of each session."""
    return memory.last_turns(_done(spark, sf)).select("session_id", "id", "turn_no", F.col("from_end").cast("long").alias("from_end"))


def next_turn_numbers(spark: SparkSession, sf: str) -> DataFrame:
    """The number of the next turn and the number of turns of each session."""
    return memory.next_turn_numbers(memory.current_turns(turns(spark, sf).where("session_id is not null")))


def latest_summaries(spark: SparkSession, sf: str) -> DataFrame:
    """The summary of the highest turn that has one."""
    return memory.latest_summaries(_done(spark, sf))


def compaction_ranges(spark: SparkSession, sf: str) -> DataFrame:
    """The turns the next summary of each session must cover."""
    done = _done(spark, sf).where("turn_no is not null")
    return memory.compaction_ranges(done)


def rewrite_context(spark: SparkSession, sf: str) -> DataFrame:
    """The last turns of each session as lines of text."""
    return memory.rewrite_context(_done(spark, sf))


def history_messages(spark: SparkSession, sf: str) -> DataFrame:
    """The messages of the next prompt of each session, for one question."""
    done = _done(spark, sf)
    asked = done.select("session_id").distinct().select("session_id", F.lit("Còn gì nữa không?").alias("question"), F.lit("").alias("context"))
    return memory.history_messages(done, asked)


def duplicate_turns(spark: SparkSession, sf: str) -> DataFrame:
    """Turn numbers that several turns of a session claim."""
    return memory.duplicate_turns(memory.current_turns(turns(spark, sf).where("session_id is not null")))


def session_gc(spark: SparkSession, sf: str) -> DataFrame:
    """Sessions to expire a day after the latest activity of all."""
    sessions = table(spark, sf, "chat_sessions").select("session_id", "last_active_at").distinct()
    now = sessions.agg(F.unix_micros(F.max("last_active_at")).alias("now")).first()["now"]
    return memory.expired_sessions(sessions, turns(spark, sf), F.timestamp_micros(F.lit(now).cast("long"))).select("session_id", F.unix_micros("last_active_at").alias("last_active"))


def deleted_sessions(spark: SparkSession, sf: str) -> DataFrame:
    """Turns that stay when the sessions without a token are deleted."""
    gone = table(spark, sf, "chat_sessions").where("token_total = 0")
    return indexing.remove_keys(turns(spark, sf).where("session_id is not null"), gone, ["session_id"]).select("id", "session_id", "turn_no").distinct()


def orphan_turns(spark: SparkSession, sf: str) -> DataFrame:
    """Turns of unknown sessions."""
    return memory.orphan_turns(turns(spark, sf), table(spark, sf, "chat_sessions")).select("id", "session_id", "turn_no").distinct()


def session_exists(spark: SparkSession, sf: str) -> DataFrame:
    """Sessions of the turns, and whether they are known."""
    asked = turns(spark, sf).where("session_id is not null").select("session_id").distinct()
    return memory.session_exists(asked, table(spark, sf, "chat_sessions"))


def touched_sessions(spark: SparkSession, sf: str) -> DataFrame:
    """The sessions after their turns have touched them."""
    known = table(spark, sf, "chat_sessions").select("session_id", F.col("created_at").alias("at"))
    seen = turns(spark, sf).where("session_id is not null").select("session_id", F.col("created_at").alias("at"))
    made = memory.touch_sessions(known.unionByName(seen))
    return made.select("session_id", F.unix_micros("created_at").alias("created_us"), F.unix_micros("last_active_at").alias("active_us"))


def message_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """The messages of each current turn, an unanswered one without its assistant."""
    return memory.message_pairs(memory.current_turns(turns(spark, sf).where("session_id is not null"))).select("id", "role", "content")


def summary_prompts(spark: SparkSession, sf: str) -> DataFrame:
    """What the writer of summaries is asked for each session that must be compacted."""
    return memory.summary_prompts(_done(spark, sf).where("turn_no is not null"))


def compacted_sessions(spark: SparkSession, sf: str) -> DataFrame:
    """The summaries after a compaction with the offline writer."""
    return memory.compact(_done(spark, sf).where("turn_no is not null"), EchoWriter())


def saved_summaries(spark: SparkSession, sf: str) -> DataFrame:
    """The turns that hold a summary after the compaction."""
    done = _done(spark, sf).where("turn_no is not null")
    return memory.save_summaries(done, memory.compact(done, EchoWriter())).where("summary is not null").select("id", "session_id", "turn_no", "summary")


def _cache(spark: SparkSession, sf: str) -> DataFrame:
    """The questions of the evaluation as a cache; entries of one category are older than the others."""
    rows = table(spark, sf, "eval_results").where("question is not null").groupBy(F.col("question").alias("raw_query")).agg(F.min("category").alias("category"))
    entries = rows.select(
        T.cache_key(F.lit("m"), F.lit("v1"), F.col("raw_query")).alias("cache_key"), "raw_query", T.normalize_query(F.col("raw_query")).alias("rewritten_query"),
        F.when(F.col("category") == "hard", F.lit("2025-05-01 00:00:00")).otherwise(F.lit("2025-06-01 00:00:00")).cast("timestamp").alias("created_at"),
    )
    return cache.put(entries.limit(0), entries)


def cache_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Questions of the turns looked up in a cache filled by the evaluation; expired and unknown ones have no rewriting."""
    asked = turns(spark, sf).where("question is not null").select(F.col("question").alias("raw_query")).distinct()
    found = cache.lookup(asked, _cache(spark, sf), F.lit("2025-06-15 00:00:00").cast("timestamp"), "m", "v1")
    return found.select("cache_key", "raw_query", "rewritten_query")


def cache_expiry(spark: SparkSession, sf: str) -> DataFrame:
    """The entries of the cache that an expiry removes."""
    return cache.expired(_cache(spark, sf), F.lit("2025-06-15 00:00:00").cast("timestamp")).select("cache_key", "raw_query")


def answer_citations(spark: SparkSession, sf: str) -> DataFrame:
    """Citation numbers of the answers."""
    return turns(spark, sf).select("id", F.explode(T.citations(F.col("answer"))).alias("n")).distinct()


def echo_strip(spark: SparkSession, sf: str) -> DataFrame:
    """Answers without a repeated question, with their token hint."""
    done = context.finish_answers(_done(spark, sf).select("id", "question", "answer"))
    return done.select("id", "answer", "tokens_hint")


def set_recall(spark: SparkSession, sf: str) -> DataFrame:
    """Share of the chunks with an expected keyword, over all cases that retrieved them, that a case has among its first three."""
    r = table(spark, sf, "eval_results").select("id", "retrieved_chunks", "expected_keywords").distinct()
    texts = table(spark, sf, "chunks").select(F.col("id").alias("chunk_id"), F.lower("content").alias("low")).dropDuplicates(["chunk_id"])
    good = r.select("id", "expected_keywords", F.explode("retrieved_chunks").alias("chunk_id")).distinct().join(texts, "chunk_id").where(
        evaluate.is_relevant(F.col("low"), F.lit(""), F.col("expected_keywords"))
    ).groupBy("id").agg(F.collect_set("chunk_id").alias("good"))
    both = r.join(good, "id", "left").withColumn("good", F.coalesce("good", F.array().cast("array<string>")))
    return both.select("id", F.round(evaluate.set_recall(F.col("retrieved_chunks"), F.col("good"), 3), 6).alias("recall")).distinct()


def _eval_rows(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "eval_results").dropDuplicates(["id"])


def eval_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Metrics of the evaluation, overall and by category."""
    return evaluate.eval_summary(_eval_rows(spark, sf))


def latency_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Mean and exact quantiles of the event values by type."""
    return evaluate.latency_summary(table(spark, sf, "events"), "event_type", "value")


def suite_problems(spark: SparkSession, sf: str) -> DataFrame:
    """What is wrong with the evaluation as a suite."""
    return evaluate.suite_problems(_eval_rows(spark, sf), ["question", "answer", "expected_behavior", "judge_reasoning"])


def _streams(spark: SparkSession, sf: str) -> DataFrame:
    r = _eval_rows(spark, sf).select(
        F.col("id").alias("query_id"), F.size("retrieved_chunks").alias("results"), F.split("answer", " ").alias("tokens"), "answer"
    )
    return event_stream.answer_events(r)


def answer_events(spark: SparkSession, sf: str) -> DataFrame:
    """The events of each answer of the evaluation, in order."""
    return _streams(spark, sf)


def event_payloads(spark: SparkSession, sf: str) -> DataFrame:
    """The events as JSON."""
    return _streams(spark, sf).select("query_id", "seq", event_stream.payload(F.col("type"), F.col("step"), F.col("message"), F.col("data")).alias("payload"))


def sync_answers(spark: SparkSession, sf: str) -> DataFrame:
    """The answer or error that ends each stream."""
    return event_stream.final_answers(_streams(spark, sf))


def joined_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """The tokens of each stream joined again."""
    tokens = _streams(spark, sf).where("type = 'token'").select(F.col("query_id").alias("stream_id"), "seq", F.col("data").alias("token"))
    return event_stream.join_tokens(tokens)


def bursty_batching(spark: SparkSession, sf: str) -> DataFrame:
    """Words of the answers in bursts of five, gathered into batches."""
    words = _eval_rows(spark, sf).where("answer is not null").select(F.col("id").alias("stream_id"), F.posexplode(F.split("answer", "(?<= )")).alias("seq", "token"))
    return event_stream.batch_tokens(event_stream.bursty_schedule(words))


def judge_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Scores of the answers of the evaluation by the offline judge."""
    return evaluate.judge(evaluate.judge_cases(_eval_rows(spark, sf), table(spark, sf, "chunks")), KeywordJudge()).select(
        "id", "correctness", "relevance", "hallucination", "refusal_appropriate", "reasoning"
    )


def judge_prompts(spark: SparkSession, sf: str) -> DataFrame:
    """What the judge is asked for each case."""
    return evaluate.judge_cases(_eval_rows(spark, sf), table(spark, sf, "chunks")).select("id", "prompt")


def token_batching(spark: SparkSession, sf: str) -> DataFrame:
    """Words of the answers, 3 ms apart, gathered into batches."""
    words = _eval_rows(spark, sf).where("answer is not null").select(F.col("id").alias("stream_id"), F.posexplode(F.split("answer", "(?<= )")).alias("seq", "token"))
    return event_stream.batch_tokens(words.withColumn("at_ms", F.col("seq") * 3.0))


def session_activity(spark: SparkSession, sf: str) -> DataFrame:
    """Runs of activity of each user, closed by an idle half hour."""
    made = session_stream.session_activity(
        table(spark, sf, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts")), "user_id", "ts", "30 minutes"
    )
    return made.select("user_id", F.unix_micros("started").alias("started"), F.unix_micros("ended").alias("ended"), "events")


QUERIES = {
    f.__name__: f
    for f in (
        session_tokens, token_totals, last_turns, next_turn_numbers, latest_summaries, compaction_ranges, rewrite_context, history_messages, duplicate_turns,
        session_gc, deleted_sessions, orphan_turns, session_exists, touched_sessions, message_pairs, summary_prompts, compacted_sessions, saved_summaries,
        cache_lookup, cache_expiry, answer_citations, echo_strip, set_recall, eval_summary, latency_summary, suite_problems,
        answer_events, event_payloads, sync_answers, joined_tokens, token_batching, bursty_batching, judge_prompts, judge_scores, session_activity,
    )
}

_CUR = """
cur AS (SELECT * FROM chat_turns WHERE session_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY (answer IS NOT NULL) DESC, created_at DESC NULLS LAST,
  turn_no DESC NULLS LAST, question DESC NULLS LAST, answer DESC NULLS LAST) = 1),
don AS (SELECT *, CAST(ceil(length(coalesce(question, '')) / 3) AS BIGINT) + CAST(ceil(length(answer) / 3) AS BIGINT) AS tok FROM cur WHERE answer IS NOT NULL)
"""
_LAST = "lst AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY turn_no DESC NULLS LAST, id) AS from_end FROM don)"

_COMPACT = f"""{_CUR}, {_LAST.replace('FROM don', 'FROM don WHERE turn_no IS NOT NULL')},
sm AS (SELECT session_id, summary, turn_no AS after_turn FROM don WHERE summary IS NOT NULL AND turn_no IS NOT NULL QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY turn_no DESC, summary DESC) = 1),
rg AS (SELECT l.session_id, sm.after_turn, l.turn_no AS to_turn, sm.summary AS old_summary FROM lst l LEFT JOIN sm ON sm.session_id = l.session_id
       WHERE l.from_end = 4 AND (sm.after_turn IS NULL OR sm.after_turn < l.turn_no)),
du AS (SELECT d.session_id, d.turn_no, d.id, rg.old_summary, 'User: ' || coalesce(question, '') || chr(10) || 'Assistant: ' || answer AS line
       FROM don d JOIN rg ON rg.session_id = d.session_id WHERE d.turn_no <= to_turn AND (after_turn IS NULL OR d.turn_no > after_turn)),
pr AS (SELECT session_id, max(turn_no) AS up_to_turn, any_value(old_summary) AS old_summary, '{SUMMARY_REQUEST}' || coalesce('{SUMMARY_BEFORE}' || nullif(any_value(old_summary), '') || chr(10) || chr(10), '')
       || '{SUMMARY_TURNS}' || string_agg(line, chr(10) || chr(10) ORDER BY turn_no, id) AS prompt FROM du GROUP BY session_id),
mad AS (SELECT session_id, up_to_turn, regexp_replace(list_last(string_split(regexp_replace(prompt, '\\A[@B@]+|[@B@]+\\z', '', 'g'), chr(10))), '\\A[@B@]+|[@B@]+\\z', '', 'g') AS summary FROM pr)"""

_EVENTS = """e AS (SELECT * FROM eval_results QUALIFY row_number() OVER (PARTITION BY id) = 1),
st(seq, step, message) AS (VALUES (0, 'rewrite', 'Đang viết lại câu hỏi...'), (1, 'retrieval', 'Đang tìm kiếm thông tin...'), (2, 'context', 'Tìm thấy {n} đoạn văn bản'), (3, 'generation', 'Đang tạo câu trả lời...')),
good AS (SELECT id, answer, len(retrieved_chunks) AS n, string_split(answer, ' ') AS w FROM e WHERE len(retrieved_chunks) > 0),
bad AS (SELECT id FROM e WHERE NOT coalesce(len(retrieved_chunks) > 0, false)),
ev AS (SELECT id AS query_id, seq, 'progress' AS type, step, replace(message, '{n}', CAST(n AS VARCHAR)) AS message, CAST(NULL AS VARCHAR) AS data FROM good, st
  UNION ALL SELECT id, CAST(3 + generate_subscripts(w, 1) AS INTEGER), 'token', NULL, NULL, unnest(w) FROM good
  UNION ALL SELECT id, CAST(4 + coalesce(len(w), 0) AS INTEGER), 'done', NULL, NULL, answer FROM good
  UNION ALL SELECT id, seq, 'progress', step, message, NULL FROM bad, st WHERE seq < 2
  UNION ALL SELECT id, 2, 'error', NULL, 'Không tìm thấy thông tin phù hợp.', NULL FROM bad)"""

_JUDGE = f"""e AS (SELECT * FROM eval_results QUALIFY row_number() OVER (PARTITION BY id) = 1),
c AS (SELECT id AS chunk_id, any_value(content) AS content FROM chunks GROUP BY id),
nm AS (SELECT id, unnest(retrieved_chunks[1:3]) AS chunk_id, generate_subscripts(retrieved_chunks[1:3], 1) AS pos FROM e),
se AS (SELECT id, string_agg('[' || pos || '] ' || content, chr(10) || chr(10) ORDER BY pos) AS shown FROM nm JOIN c ON c.chunk_id = nm.chunk_id GROUP BY id),
jp AS (SELECT e.*, '{JUDGE_REQUEST}' || 'Loại: ' || coalesce(category, '') || chr(10) || 'Câu hỏi: ' || coalesce(question, '') || chr(10) || 'Mong đợi: ' || coalesce(expected_behavior, '') || chr(10)
       || 'Từ khóa: ' || CASE WHEN len(expected_keywords) > 0 THEN array_to_string(expected_keywords, ', ') ELSE '{NO_KEYWORDS}' END || chr(10)
       || 'Trả lời: ' || replace(coalesce(answer, ''), chr(10), ' ') || chr(10) || 'Đoạn văn:' || chr(10) || coalesce(shown, '') AS prompt FROM e LEFT JOIN se ON se.id = e.id)"""


def _batches(at: str) -> str:
    """Batches of the words of the answers, word ``i`` arriving at ``at`` milliseconds."""
    return f"""WITH RECURSIVE e AS (SELECT * FROM eval_results QUALIFY row_number() OVER (PARTITION BY id) = 1),
w AS (SELECT id, regexp_extract_all(answer, '[^ ]* |[^ ]+') AS w FROM e WHERE answer IS NOT NULL),
k AS (SELECT id, unnest(w) AS token, generate_subscripts(w, 1) AS i FROM w),
t AS (SELECT id, i, token, length(token) AS n, {at} AS at_ms FROM k),
walk AS (
  SELECT id, i, 0 AS batch, CASE WHEN n >= 32 THEN 1 ELSE 0 END AS next, CASE WHEN n >= 32 THEN 0 ELSE n END AS held, at_ms AS opened FROM t WHERE i = 1
  UNION ALL SELECT id, i, batch, CASE WHEN full_up THEN batch + 1 ELSE batch END, CASE WHEN full_up THEN 0 ELSE total END, CASE WHEN full_up THEN at_ms ELSE opened END FROM
    (SELECT *, total >= 32 OR (total > 0 AND at_ms - opened >= 10) AS full_up FROM
      (SELECT t.id, t.i, t.at_ms, CASE WHEN due THEN next + 1 ELSE next END AS batch, CASE WHEN due THEN n ELSE held + n END AS total, CASE WHEN due THEN t.at_ms ELSE opened END AS opened FROM
        (SELECT s.*, x.at_ms AS now, s.held > 0 AND x.at_ms - s.opened >= 10 AS due FROM walk s JOIN t x ON x.id = s.id AND x.i = s.i + 1) r JOIN t ON t.id = r.id AND t.i = r.i + 1)))
SELECT walk.id AS stream_id, CAST(batch AS INTEGER) AS batch_no, string_agg(token, '' ORDER BY walk.i) AS content FROM walk JOIN t ON t.id = walk.id AND t.i = walk.i GROUP BY walk.id, batch"""


ORACLES = {
    "session_tokens": f"WITH {_CUR} SELECT session_id, CAST(sum(tok) AS BIGINT) AS raw_tokens, sum(tok) >= 2030 AS needs_compact FROM don GROUP BY session_id",
    "token_totals": f"WITH {_CUR} SELECT session_id, CAST(sum(coalesce(tokens_hint, 0)) AS BIGINT) AS token_total FROM don GROUP BY session_id",
    "last_turns": f"WITH {_CUR}, {_LAST} SELECT session_id, id, turn_no, from_end FROM lst WHERE from_end <= 3",
    "next_turn_numbers": f"WITH {_CUR} SELECT session_id, CAST(coalesce(max(turn_no), 0) + 1 AS INTEGER) AS next_turn_no, count(*) AS turns FROM cur GROUP BY session_id",
    "latest_summaries": f"""WITH {_CUR} SELECT session_id, summary, turn_no AS summary_turn_no FROM don WHERE summary IS NOT NULL AND turn_no IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY turn_no DESC, summary DESC) = 1""",
    "compaction_ranges": f"""WITH {_CUR}, {_LAST.replace('FROM don', 'FROM don WHERE turn_no IS NOT NULL')},
k AS (SELECT session_id, max(turn_no) AS after_turn FROM don WHERE summary IS NOT NULL AND turn_no IS NOT NULL GROUP BY session_id)
SELECT l.session_id, k.after_turn, l.turn_no AS to_turn FROM lst l LEFT JOIN k ON k.session_id = l.session_id
WHERE l.from_end = 4 AND (k.after_turn IS NULL OR k.after_turn < l.turn_no)""",
    "rewrite_context": f"""WITH {_CUR}, {_LAST} SELECT session_id, string_agg('User: ' || coalesce(question, '') || chr(10) || 'Assistant: ' ||
  CASE WHEN length(answer) > 300 THEN answer[1:300] || '...' ELSE answer END, chr(10) ORDER BY from_end DESC) AS context FROM lst WHERE from_end <= 3 GROUP BY session_id""",
    "duplicate_turns": f"WITH {_CUR} SELECT session_id, turn_no, count(*) AS n FROM cur WHERE turn_no IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1",
    "session_gc": """WITH cur AS (SELECT * FROM chat_turns QUALIFY row_number() OVER (PARTITION BY id ORDER BY (answer IS NOT NULL) DESC, created_at DESC NULLS LAST) = 1),
s AS (SELECT DISTINCT session_id, last_active_at FROM chat_sessions)
SELECT session_id, epoch_us(last_active_at) AS last_active FROM s
WHERE last_active_at < (SELECT max(last_active_at) FROM s) - INTERVAL 24 HOURS AND session_id NOT IN (SELECT session_id FROM cur WHERE answer IS NULL AND session_id IS NOT NULL)""",
    "history_messages": f"""WITH {_CUR}, {_LAST},
tot AS (SELECT session_id, sum(tok) >= 2030 AS big FROM don GROUP BY session_id),
sm AS (SELECT session_id, summary FROM don WHERE summary IS NOT NULL AND turn_no IS NOT NULL QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY turn_no DESC, summary DESC) = 1),
raw AS (SELECT l.* FROM lst l JOIN tot t ON t.session_id = l.session_id WHERE NOT big OR from_end <= 3)
SELECT session_id, 0 AS part, 0 AS turn_no, 'system' AS role, '{SYSTEM_PROMPT}' AS content FROM tot
UNION ALL SELECT session_id, 1, 0, 'user', '{SUMMARY_MARK}' || summary FROM sm
UNION ALL SELECT session_id, 2, turn_no, 'user', question FROM raw
UNION ALL SELECT session_id, 2, turn_no, 'assistant', answer FROM raw
UNION ALL SELECT session_id, 3, 0, 'user', 'Còn gì nữa không?' FROM tot""",
    "deleted_sessions": """SELECT DISTINCT id, session_id, turn_no FROM chat_turns WHERE session_id IS NOT NULL AND session_id NOT IN (SELECT session_id FROM chat_sessions WHERE token_total = 0)""",
    "orphan_turns": """SELECT DISTINCT id, session_id, turn_no FROM chat_turns t WHERE NOT EXISTS (SELECT 1 FROM chat_sessions s WHERE s.session_id = t.session_id)""",
    "session_exists": """SELECT DISTINCT session_id, session_id IN (SELECT session_id FROM chat_sessions) AS known FROM chat_turns WHERE session_id IS NOT NULL""",
    "touched_sessions": """SELECT session_id, epoch_us(min(created_at)) AS created_us, epoch_us(max(created_at)) AS active_us FROM
(SELECT session_id, created_at FROM chat_sessions UNION ALL SELECT session_id, created_at FROM chat_turns WHERE session_id IS NOT NULL) GROUP BY session_id""",
    "message_pairs": f"WITH {_CUR} SELECT id, 'user' AS role, question AS content FROM cur UNION ALL SELECT id, 'assistant', answer FROM cur WHERE answer IS NOT NULL",
    "summary_prompts": f"WITH {_COMPACT} SELECT session_id, up_to_turn, old_summary, prompt FROM pr",
    "compacted_sessions": f"""WITH {_COMPACT}
SELECT session_id, summary, up_to_turn FROM mad UNION ALL SELECT session_id, summary, after_turn FROM sm WHERE session_id NOT IN (SELECT session_id FROM mad)""",
    "saved_summaries": f"""WITH {_COMPACT},
al AS (SELECT session_id, summary, up_to_turn FROM mad UNION ALL SELECT session_id, summary, after_turn FROM sm WHERE session_id NOT IN (SELECT session_id FROM mad)),
nu AS (SELECT d.*, row_number() OVER (PARTITION BY session_id, turn_no ORDER BY id) AS n FROM don d WHERE turn_no IS NOT NULL)
SELECT id, nu.session_id, turn_no, coalesce(CASE WHEN n = 1 THEN al.summary END, nu.summary) AS summary FROM nu LEFT JOIN al ON al.session_id = nu.session_id AND al.up_to_turn = nu.turn_no
WHERE coalesce(CASE WHEN n = 1 THEN al.summary END, nu.summary) IS NOT NULL""",
    "cache_lookup": """WITH e AS (SELECT question, min(category) AS c FROM eval_results WHERE question IS NOT NULL GROUP BY question)
SELECT DISTINCT sha256('m|v1|' || t.question) AS cache_key, t.question AS raw_query, CASE WHEN e.question IS NOT NULL AND coalesce(c, '') <> 'hard'
  THEN trim(regexp_replace(lower(t.question), '[@B@]+', ' ', 'g')) END AS rewritten_query
FROM chat_turns t LEFT JOIN e ON e.question = t.question WHERE t.question IS NOT NULL""",
    "cache_expiry": """SELECT sha256('m|v1|' || question) AS cache_key, question AS raw_query FROM eval_results WHERE question IS NOT NULL GROUP BY question HAVING min(category) = 'hard'""",
    "echo_strip": r"""WITH """ + _CUR + r""",
b AS (SELECT id, answer, regexp_replace(answer, '\A[@B@]+', '') AS body, regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(question), '[@B@]+', ' ', 'g'), '\A | \z', '', 'g'), '[?!.,;:]+\z', ''), '\A[@B@]+|[@B@]+\z', '', 'g') AS want FROM don),
c AS (SELECT id, answer, body, want, string_split(body, '') AS ch, length(regexp_replace(want, '[@B@]', '', 'g')) AS letters,
  want <> '' AND starts_with(regexp_replace(lower(body), '[@B@]+', ' ', 'g'), want) AS echoes FROM b),
e AS (SELECT id, answer, CASE WHEN echoes THEN body[list_filter(range(1, len(ch) + 1), lambda i: NOT regexp_matches(ch[i], '[@B@]'))[letters] + 1 :] END AS tail FROM c),
f AS (SELECT id, answer, regexp_replace(tail, '\A[@B@]+', '') AS follows, regexp_replace(regexp_replace(tail, '\A[.!?,;:\n\r\t ]+', ''), '\A[@B@]+', '') AS rest FROM e),
g AS (SELECT id, CASE WHEN coalesce(follows, '') <> '' AND NOT regexp_matches(follows, '\A[\p{L}\p{Nd}]') AND length(regexp_replace(rest, '[@B@]+\z', '')) >= 5 THEN rest ELSE answer END AS answer FROM f)
SELECT id, answer, CAST(ceil(length(answer) / 200) AS INTEGER) AS tokens_hint FROM g""",
    "answer_citations": r"SELECT DISTINCT id, unnest(regexp_extract_all(answer, '\[(\d+)\]', 1)) AS n FROM chat_turns",
    "set_recall": """WITH e AS (SELECT DISTINCT id, retrieved_chunks, expected_keywords FROM eval_results),
c AS (SELECT id AS chunk_id, any_value(lower(content)) AS low FROM chunks GROUP BY id),
u AS (SELECT DISTINCT id, expected_keywords, unnest(retrieved_chunks) AS chunk_id FROM e),
g AS (SELECT id, list(DISTINCT u.chunk_id) AS good FROM u JOIN c ON c.chunk_id = u.chunk_id WHERE len(list_filter(expected_keywords, lambda k: contains(low, lower(k)))) > 0 GROUP BY id)
SELECT DISTINCT e.id, round(CASE WHEN good IS NOT NULL THEN len(list_intersect(retrieved_chunks[1:3], good)) / len(good) ELSE 0.0 END, 6) AS recall FROM e LEFT JOIN g ON g.id = e.id""",
    "eval_summary": """WITH e AS (SELECT * FROM eval_results QUALIFY row_number() OVER (PARTITION BY id) = 1)
SELECT category, count(*) AS cases, round(avg(recall_at_k), 6) AS recall_at_k_mean, round(avg(mrr), 6) AS mrr_mean, round(avg(correctness), 6) AS correctness_mean,
round(avg(relevance), 6) AS relevance_mean, round(median(recall_at_k), 6) AS recall_at_k_p50, round(median(mrr), 6) AS mrr_p50,
round(median(correctness), 6) AS correctness_p50, round(median(relevance), 6) AS relevance_p50, round(avg(CAST(hallucination AS DOUBLE)), 6) AS hallucination_rate,
round(avg(latency_ms), 4) AS latency_mean,
CASE WHEN category IS NOT NULL AND count_if(refusal_appropriate IN ('yes', 'no')) > 0
  THEN round(count_if(refusal_appropriate = 'yes') / count_if(refusal_appropriate IN ('yes', 'no')), 6) END AS refusal_rate
FROM e GROUP BY GROUPING SETS ((category), ())""",
    "latency_summary": """WITH v AS (SELECT event_type, list_sort(list(value)) AS v FROM events WHERE value IS NOT NULL GROUP BY event_type)
SELECT event_type, len(v) AS n, round(list_avg(v), 6) AS mean, round((v[(len(v) - 1) // 2 + 1] + v[len(v) // 2 + 1]) / 2, 6) AS p50,
v[CAST(floor(len(v) * 0.95) AS BIGINT) + 1] AS p95, v[least(CAST(floor(len(v) * 0.99) AS BIGINT), len(v) - 1) + 1] AS p99 FROM v""",
    "suite_problems": """WITH e AS (SELECT * FROM eval_results QUALIFY row_number() OVER (PARTITION BY id) = 1)
SELECT id AS subject, 'missing ' || f AS problem FROM (SELECT id, unnest([CASE WHEN question IS NULL THEN 'question' END, CASE WHEN answer IS NULL THEN 'answer' END,
  CASE WHEN expected_behavior IS NULL THEN 'expected_behavior' END, CASE WHEN judge_reasoning IS NULL THEN 'judge_reasoning' END]) AS f FROM e) WHERE f IS NOT NULL
UNION ALL SELECT id, 'unknown category' FROM e WHERE NOT coalesce(category IN ('easy', 'hard', 'ambiguous', 'missing', 'out-of-scope'), false)
UNION ALL SELECT category, 'has ' || count(*) || ' cases' FROM e WHERE category IS NOT NULL GROUP BY category HAVING count(*) <> 5""",
    "answer_events": f"WITH {_EVENTS} SELECT query_id, seq, type, step, message, data FROM ev",
    "event_payloads": f"""WITH {_EVENTS} SELECT query_id, seq, CASE type WHEN 'progress' THEN '{{"type":"progress","step":' || to_json(step) || ',"message":' || to_json(message) || '}}'
WHEN 'token' THEN '{{"type":"token","content":' || to_json(data) || '}}' WHEN 'done' THEN '{{"type":"done"' || coalesce(',"answer":' || to_json(data), '') || '}}'
ELSE '{{"type":"error","message":' || to_json(message) || '}}' END AS payload FROM ev""",
    "sync_answers": f"WITH {_EVENTS} SELECT query_id, type = 'done' AS ok, CASE WHEN type = 'done' THEN data ELSE message END AS answer FROM ev WHERE type IN ('done', 'error')",
    "joined_tokens": f"WITH {_EVENTS} SELECT query_id AS stream_id, string_agg(data, '' ORDER BY seq) AS text FROM ev WHERE type = 'token' GROUP BY query_id",
    "token_batching": _batches("(i - 1) * 3.0"),
    "bursty_batching": _batches("(i - 1) * 5.0 + ((i - 1) // 5) * 60.0"),
    "judge_prompts": f"WITH {_JUDGE} SELECT id, prompt FROM jp",
    "judge_scores": f"""WITH {_JUDGE},
k AS (SELECT id, CASE WHEN len(expected_keywords) > 0 THEN list_filter(string_split(array_to_string(expected_keywords, ', '), ', '), lambda w: w <> '') ELSE ['{NO_KEYWORDS}'] END AS words,
      lower(replace(coalesce(answer, ''), chr(10), ' ')) AS low FROM jp),
f AS (SELECT id, words, low, len(list_filter(words, lambda w: contains(low, lower(w)))) AS n FROM k)
SELECT id, CAST(1 + 4 * n // greatest(1, len(words)) AS DOUBLE) AS correctness, CASE WHEN low <> '' THEN 5.0 ELSE 1.0 END AS relevance, n = 0 AS hallucination,
'n/a' AS refusal_appropriate, CAST(n AS VARCHAR) AS reasoning FROM f""",
    "session_activity": """WITH g AS (SELECT user_id, epoch_us(ts) AS t, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) < 1800000000 THEN 0 ELSE 1 END AS new FROM events WHERE ts IS NOT NULL),
s AS (SELECT user_id, t, sum(new) OVER (PARTITION BY user_id ORDER BY t RANGE UNBOUNDED PRECEDING) AS s FROM g)
SELECT user_id, min(t) AS started, max(t) + 1800000000 AS ended, count(*) AS events FROM s GROUP BY user_id, s""",
}
ORACLES = {k: sql(v) for k, v in ORACLES.items()}
