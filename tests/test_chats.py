import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from lotusflow.operators import cache, evaluate, memory
from lotusflow.sources import files
from lotusflow.sources.tables import Store
from lotusflow.streaming import events, sessions

DAY = dt.datetime(2025, 1, 1)


def log(spark, rows):
    return spark.createDataFrame(
        [(f"{s}{n}", s, n, q, a, 0, m, DAY) for s, n, q, a, m in rows],
        "id string, session_id string, turn_no int, question string, answer string, tokens_hint int, summary string, created_at timestamp",
    )


def long_turns(n, summary_at=None):
    return [("s", i, f"q{i} " + "x" * 900, f"a{i} " + "y" * 900, "old" if i == summary_at else None) for i in range(1, n + 1)]


def test_threshold():
    assert memory.THRESHOLD == 2030


def test_pending_and_duplicate_turns(spark):
    turns = log(spark, [("s", 1, "q", "a", None), ("s", 2, "q", None, None)])
    assert [r.turn_no for r in memory.completed_turns(turns).collect()] == [1]
    twice = turns.unionByName(turns.withColumn("id", F.concat("id", F.lit("x"))))
    assert memory.duplicate_turns(twice).count() == 2


def test_versions_collapse(spark):
    first = log(spark, [("s", 1, "q", None, None)])
    second = log(spark, [("s", 1, "q", "a", None)])
    rows = memory.current_turns(first.unionByName(second).unionByName(second)).collect()
    assert len(rows) == 1 and rows[0].answer == "a"


@pytest.mark.parametrize(("turns", "summary_at", "expected"), [(5, None, (None, 2)), (7, 2, (2, 4)), (3, None, None), (5, 2, None)])
def test_compaction_range(spark, turns, summary_at, expected):
    rows = memory.compaction_ranges(log(spark, long_turns(turns, summary_at))).collect()
    assert ([(r.after_turn, r.to_turn) for r in rows] or [None])[0] == expected


def messages(spark, turns, context=""):
    asked = spark.createDataFrame([("s", "now?", context)], "session_id string, question string, context string")
    made = memory.history_messages(turns, asked)
    return made.orderBy("part", "turn_no", F.desc("role")).collect()


def test_history(spark):
    assert [m.role for m in messages(spark, log(spark, []))] == ["system", "user"]
    short = log(spark, [("s", 1, "q1", "a1", None), ("s", 2, "q2", "a2", "kept")])
    made = messages(spark, short)
    assert [m.role for m in made] == ["system", "user", "user", "assistant", "user", "assistant", "user"]
    assert made[1].content == "[TÓM TẮT LỊCH SỬ]: kept" and made[-1].content == "now?"


def test_history_beyond_the_budget_keeps_three_turns(spark):
    made = messages(spark, log(spark, long_turns(5)))
    assert [m.turn_no for m in made if m.role == "assistant"] == [3, 4, 5]
    turns = log(spark, long_turns(5))
    assert memory.history_turns(turns, F.lit(False), has_compactor=True).count() == 5
    assert memory.history_turns(turns, F.lit(True), has_compactor=True).count() == 3


def test_session_expiry(spark):
    state = spark.createDataFrame(
        [("old", DAY), ("busy", DAY), ("new", DAY + dt.timedelta(hours=30))], "session_id string, last_active_at timestamp"
    )
    turns = log(spark, [("busy", 1, "q", None, None)])
    gone = memory.expired_sessions(state, turns, F.lit(DAY + dt.timedelta(hours=31)))
    assert [r.session_id for r in gone.collect()] == ["old"]


def test_cache(spark):
    from lotusflow.functions import text as T

    entry = spark.createDataFrame([("q", "r", DAY)], "raw_query string, rewritten_query string, created_at timestamp").withColumn(
        "cache_key", T.cache_key(F.lit("m"), F.lit("v"), F.col("raw_query"))
    )
    asked = spark.createDataFrame([("q",)], "raw_query string")
    hit = lambda model, version, days: cache.lookup(asked, entry, F.lit(DAY + dt.timedelta(days=2)), model, version, days).first().rewritten_query
    assert hit("m", "v", 30) == "r" and hit("m", "v", None) == "r"
    assert hit("m2", "v", 30) is None and hit("m", "v2", 30) is None and hit("m", "v", 1) is None


def test_event_stream(spark):
    rows = [("a", 1, ["x", "y"], "xy"), ("b", 0, None, None)]
    made = events.answer_events(spark.createDataFrame(rows, "query_id string, results int, tokens array<string>, answer string"))
    kinds = {k: [r.type for r in made.where(F.col("query_id") == k).orderBy("seq").collect()] for k in "ab"}
    assert kinds["a"] == ["progress"] * 4 + ["token"] * 2 + ["done"]
    assert kinds["b"] == ["progress"] * 2 + ["error"]
    p = made.where("type = 'token'").select(events.payload(F.col("type"), F.col("step"), F.col("message"), F.col("data")).alias("p")).first().p
    assert json.loads(p) == {"type": "token", "content": "x"}


def test_token_batching(spark):
    rows = [("s", i, float(i), "abcdefgh") for i in range(6)] + [("s", 6, 50.0, "z"), ("t", 0, 0.0, "q")]
    made = events.batch_tokens(spark.createDataFrame(rows, "stream_id string, seq int, at_ms double, token string"))
    got = {(r.stream_id, r.batch_no): r.content for r in made.collect()}
    assert got == {("s", 0): "abcdefgh" * 4, ("s", 1): "abcdefgh" * 2, ("s", 2): "z", ("t", 0): "q"}


def test_session_stream_equals_the_batch(spark, tmp_path):
    rows = [(u, DAY + dt.timedelta(minutes=m)) for u, m in [(1, 0), (1, 10), (1, 100), (2, 5), (9, 100000)]]
    data = spark.createDataFrame(rows, "user_id long, ts timestamp")
    data.write.parquet(str(tmp_path / "in"))
    batch = {tuple(r) for r in sessions.session_activity(data, "user_id", "ts", "30 minutes").collect()}
    stream = spark.readStream.schema(data.schema).parquet(str(tmp_path / "in"))
    query = (
        sessions.session_activity(stream, "user_id", "ts", "30 minutes")
        .writeStream.format("memory").queryName("activity").outputMode("append")
        .option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    got = {tuple(r) for r in spark.table("activity").collect()}
    assert got == {b for b in batch if b[0] != 9}


def test_recall_and_rank(spark):
    cases = spark.createDataFrame([("a", ["x", "y"], ""), ("b", [], "ctx"), ("c", ["x"], None)], "case_id string, keywords array<string>, context string")
    results = spark.createDataFrame([("a", 1, "none"), ("a", 2, "has X"), ("b", 3, "the CTX"), ("b", 6, "ctx")], "case_id string, rank int, content string")
    got = {r.case_id: (r.recall, r.mrr) for r in evaluate.retrieval_metrics(cases, results).collect()}
    assert got == {"a": (0.5, 0.5), "b": (1.0, pytest.approx(1 / 3)), "c": (0.0, 0.0)}


def test_latency_summary_against_sorting(spark):
    import random

    r = random.Random(2)
    values = [("a", float(r.randint(0, 500))) for _ in range(5000)] + [("b", 1.0), ("b", 2.0), ("b", 3.0), ("c", 5.0), ("c", None)]
    got = {x.g: x for x in evaluate.latency_summary(spark.createDataFrame(values, "g string, v double"), "g", "v").collect()}
    for g in "abc":
        v = sorted(x for k, x in values if k == g and x is not None)
        n = len(v)
        middle = (v[(n - 1) // 2] + v[n // 2]) / 2
        assert (got[g].n, got[g].p50, got[g].p95, got[g].p99) == (n, middle, v[min(int(n * 0.95), n - 1)], v[min(int(n * 0.99), n - 1)])


def test_dataset(spark, tmp_path):
    topics = [
        {"title": "A", "paragraphs": [{"context": "one", "qas": [{"id": "1", "question": "q", "answers": [{"text": "t"}]}]}, {"context": "  "}]},
        {"title": "B", "paragraphs": [{"context": " "}]},
        {"paragraphs": [{"context": "three", "qas": [{"id": "2", "question": "p", "answers": []}]}]},
    ]
    path = tmp_path / "d.json"
    path.write_text(json.dumps({"data": topics}))
    rows = files.read_dataset(spark, str(path)).orderBy("topic_no").collect()
    assert [(r.title, r.context) for r in rows] == [("A", "one"), ("", "three")]
    source, docs = files.raw_documents(files.read_dataset(spark, str(path)), "t", "dataset", "1")
    assert source.count() == 1 and docs.select("document_id").distinct().count() == 2
    assert {(r.question, r.answer) for r in files.extract_questions(spark, str(path)).collect()} == {("q", "t"), ("p", "")}
    assert files.corpus_sample(spark, str(path), 1, 2).first().context == "on"


def test_event_lines(spark):
    lines = ['data: {"choices":[{"delta":{"content":"a"}}]}', ": ping", "data: broken", 'data: {"choices":[]}', "data: [DONE]", 'data: {"choices":[{"delta":{"content":"z"}}]}']
    df = spark.createDataFrame(list(enumerate(lines)), "line_no int, line string")
    assert [r.token for r in files.parse_event_lines(df).collect()] == ["a"]


def test_report_csv(spark, tmp_path):
    df = spark.createDataFrame([('say "x"\ny', ["a", "b"], 1)], "t string, l array<string>, n int")
    files.write_report_csv(df.coalesce(1), str(tmp_path / "r"))
    text = next((tmp_path / "r").glob("*.csv")).read_text()
    assert text.splitlines()[1] == '"say ""x"" y","a|b","1"'


def test_store(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}")
    assert store.table("documents").count() == 0
    rows = lambda status: spark.createDataFrame([("1", "s", "c", status, None), ("2", "t", "c", status, None)], "id string, source_id string, checksum string, status string, metadata map<string,string>")
    store.save("documents", rows("pending"))
    store.save("documents", rows("indexed").limit(1))
    assert {(r.id, r.status) for r in store.documents().collect()} == {("1", "indexed"), ("2", "pending")}
    assert store.documents("s", "pending").count() == 0 and store.get("documents", ["2", "9"]).count() == 1


def test_providers(spark):
    from lotusflow import providers

    df = spark.createDataFrame([("a b",), (None,), ("",)], "t string")
    rows = providers.embed_texts(df, "t", providers.HashEmbedder(8)).collect()
    assert len(rows[0].dense_vector) == 8 and rows[1].dense_vector is None
    assert providers.write_texts(df, "t", providers.EchoWriter(), "w").first().w == "a b"


def test_suite_problems(spark):
    df = spark.createDataFrame([("1", "easy", None), ("2", "odd", "q")], "id string, category string, question string")
    got = {tuple(r) for r in evaluate.suite_problems(df, ["question"]).collect()}
    assert got == {("1", "missing question"), ("2", "unknown category"), ("easy", "has 1 cases"), ("odd", "has 1 cases")}
