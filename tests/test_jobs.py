import json

import pytest
from pyspark.sql import functions as F

from lotusflow import providers, runtime
from lotusflow.operators import bm25, evaluate, ingest, memory
from lotusflow.operators.retrieval import Retrieval, leg_payloads
from lotusflow.sources import files
from lotusflow.sources.tables import Store
from lotusflow.streaming import events


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, f"file://{tmp_path}/store")


def dataset(tmp_path, words=40):
    body = " ".join(f"từ{i}" for i in range(words))
    data = {"data": [{"title": "Hồ", "paragraphs": [{"context": f"# Lịch sử\n\n{body}", "qas": []}, {"context": "  ", "qas": []}]}, {"title": None, "paragraphs": [{"context": body, "qas": []}]}]}
    (tmp_path / "data.json").write_text(json.dumps(data, ensure_ascii=False))
    return f"file://{tmp_path}/data.json"


def test_ingest_and_deploy(spark, store, tmp_path):
    path, embedder = dataset(tmp_path), providers.HashEmbedder(8)
    assert ingest.deploy(store, path, "t", "qa", "1", embedder) == "ingested"
    assert store.summary() | {"query_cache": 0} == {"sources": 1, "documents": 2, "chunks": 2, "index_entries": 2, "query_cache": 0, "chat_sessions": 0, "chat_turns": 0}
    assert ingest.deploy(store, path, "t", "qa", "1", embedder) == "ready"
    assert {r.status for r in store.documents().collect()} == {"indexed"}
    entry = store.entries().first()
    assert len(entry.dense_vector) == 8 and entry.sparse_vector and entry.metadata["source_id"] == store.sources().first().id
    ingest.ingest_dataset(store, path, "t", "qa", "1")
    assert store.summary()["documents"] == 2
    store.replace("index_entries", store.table("index_entries").limit(0))
    assert ingest.deploy(store, path, "t", "qa", "1", embedder) == "indexed"
    assert ingest.index_chunks(store, embedder) == 0


def test_collections_refuse_other_vectors(spark, store):
    entry = lambda k, v: spark.createDataFrame([(k, v, None, None)], "chunk_id string, dense_vector array<float>, sparse_vector map<int,double>, metadata map<string,string>")
    store.create_collection(2)
    store.save_entries(entry("a", [1.0, 2.0]).unionByName(entry("n", None)))
    assert [r.chunk_id for r in store.entries().collect()] == ["a"] and store.collection_dim() == 2
    store.create_collection(2)
    with pytest.raises(ValueError, match="2 values"):
        store.create_collection(3)
    with pytest.raises(ValueError, match="2 values"):
        store.save_entries(entry("b", [1.0]))
    store.create_collection(3, recreate=True)
    assert store.summary()["index_entries"] == 0


def test_a_failed_write_leaves_the_table(spark, store):
    rows = spark.createDataFrame([("a", "t", "k", "1", None)], "id string, tenant_id string, type string, version string, metadata map<string,string>")
    for v in "123":
        store.save("sources", rows.withColumn("version", F.lit(v)))
    with pytest.raises(Exception, match="boom"):
        store.save("sources", rows.withColumn("version", F.raise_error(F.lit("boom")).cast("string")))
    assert [r.version for r in store.table("sources").collect()] == ["3"]
    store.remove("sources", rows)
    assert store.table("sources").count() == 0


def test_turns_and_cache_of_a_store(spark, store):
    cols = "id string, session_id string, turn_no int, question string, answer string, intent string, tokens_hint int, summary string, created_at timestamp"
    turn = lambda i, n, a: spark.createDataFrame([(i, "s", n, "q", a, None, 0, None, None)], cols)
    store.start_turn(turn("1", 1, None))
    with pytest.raises(ValueError, match="number"):
        store.start_turn(turn("2", 1, None))
    store.finish_turn(turn("1", 1, "a"))
    assert [r.answer for r in store.turns("s").collect()] == ["a"]
    assert not store.has_session("s") and store.clear_cache() == 0


def test_json_lines_with_a_limit(spark, tmp_path):
    (tmp_path / "q.jsonl").write_text('{"question": "a"}\n\n{"question": "b"}\n{"question": "c"}\n')
    path = f"file://{tmp_path}/q.jsonl"
    assert [r.question for r in files.read_questions(spark, path, 2).collect()] == ["a", "b"]
    assert files.read_questions(spark, path).count() == 3
    assert files.read_questions(spark, f"file://{tmp_path}/none.jsonl").count() == 0
    assert json.loads(files.example_lines(spark, path, "question string", 2).first().examples) == [{"question": "a"}, {"question": "b"}]


def test_json_codec(spark):
    df = spark.createDataFrame([({"k": "Hồ"},), (None,)], "m map<string,string>")
    back = df.select(files.load_json(files.dump_json(F.col("m")), "map<string,string>").alias("m"), files.dump_json(F.col("m")).alias("j")).collect()
    assert [(r.m, r.j) for r in back] == [({"k": "Hồ"}, '{"k":"Hồ"}'), (None, None)]
    assert spark.createDataFrame([("",), ("{",)], "t string").select(files.load_json(F.col("t"), "a int").alias("v")).where("v.a is not null").count() == 0


def test_every_event_stream_has_its_own_end(spark, tmp_path):
    line = lambda t: "data: " + json.dumps({"choices": [{"delta": {"content": t}}]})
    (tmp_path / "a.txt").write_text("\n".join([line("x"), "data: [DONE]", line("late")]))
    (tmp_path / "b.txt").write_text("\n".join([line("1"), "", line("2"), ": note", "data: {", line("3"), "data: [DONE]"]))
    got = {}
    for r in files.read_event_stream(spark, f"file://{tmp_path}/*.txt").orderBy("line_no").collect():
        got.setdefault(r.file[-5:], []).append(r.token)
    assert got == {"a.txt": ["x"], "b.txt": ["1", "2", "3"]}


def test_streams_in_pieces(spark):
    df = spark.createDataFrame([("s", 0, "data: a\nda"), ("s", 2, "x\n\ndata: tail"), ("s", 1, "ta: b"), ("e", 0, None)], "stream_id string, seq int, chunk string")
    assert [r.data for r in files.split_stream(df).orderBy("line_no").collect()] == ["a", "bx"]


def test_reports(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.5)], "stage string, value double")
    files.write_report_json(df, f"file://{tmp_path}/r", df.agg(F.count(F.lit(1)).alias("n")))
    assert spark.read.json(f"file://{tmp_path}/r/summary").first().n == 1 and spark.read.json(f"file://{tmp_path}/r/results").count() == 1
    files.write_timings(df, f"file://{tmp_path}/t")
    assert {r.value for r in spark.read.text(f"file://{tmp_path}/t/csv").collect()} == {"stage,value", "a,1.5"}
    took = ingest.timed({"one": lambda: spark.range(3)})
    assert set(took) == {"one_ms"} and evaluate.latency_summary(ingest.timings_table(spark, [took, took]), "stage", "value").first().n == 2


def log(spark, n, summary_at=None):
    rows = [(f"t{i}", "s", i, f"q{i}", f"a{i}", "old" if i == summary_at else None) for i in range(1, n + 1)]
    return spark.createDataFrame(rows, "id string, session_id string, turn_no int, question string, answer string, summary string")


def fixed():
    return type("Fixed", (), {"write": lambda self, prompts: [f"new of {p.count('User: ')}" for p in prompts]})()


@pytest.mark.parametrize(("turns", "at", "expected"), [(5, None, ("new of 2", 2)), (7, 2, ("new of 2", 4)), (3, 1, ("old", 1)), (3, None, None)])
def test_compaction(spark, turns, at, expected):
    rows = memory.compact(log(spark, turns, at), fixed()).collect()
    assert ((rows[0].summary, rows[0].up_to_turn) if rows else None) == expected


def test_a_failed_writer_leaves_the_old_summary(spark):
    turns = log(spark, 7, 2)
    silent = type("Silent", (), {"write": lambda self, prompts: [None] * len(prompts)})()
    kept = memory.compact(turns, silent)
    assert [(r.summary, r.up_to_turn) for r in kept.collect()] == [("old", 2)]
    saved = {r.turn_no: r.summary for r in memory.save_summaries(turns, memory.compact(turns, fixed())).collect()}
    assert saved[2] == "old" and saved[4] == "new of 2" and sum(v is not None for v in saved.values()) == 2


def test_summaries_name_the_turns_in_order(spark):
    prompt = memory.summary_prompts(log(spark, 6, 1)).first().prompt
    assert prompt.endswith("User: q2\nAssistant: a2\n\nUser: q3\nAssistant: a3") and "old" in prompt


def test_judging(spark):
    cases = spark.createDataFrame(
        [("a", "easy", "q", "answerable", ["hồ", "núi"], "Có hồ.", ["c1"]), ("b", None, None, None, None, None, None)],
        "id string, category string, question string, expected_behavior string, expected_keywords array<string>, answer string, retrieved_chunks array<string>",
    )
    chunks = spark.createDataFrame([("c1", "đoạn")], "id string, content string")
    asked = evaluate.judge_cases(cases, chunks)
    assert "[1] đoạn" in asked.where("id = 'a'").first().prompt
    got = {r.id: (r.correctness, r.hallucination) for r in evaluate.judge(asked, providers.KeywordJudge()).collect()}
    assert got == {"a": (3.0, False), "b": (1.0, True)} or got["a"] == (3.0, False)
    bad = evaluate.judge(asked, providers.EchoWriter()).where("id = 'a'").first()
    assert (bad.correctness, bad.refusal_appropriate, bad.reasoning) == (0.0, "n/a", "Judge error")


def test_run_of_an_evaluation(spark):
    embed = providers.HashEmbedder(8)
    texts = spark.createDataFrame([("d1", "hồ xanh yên tĩnh", "Hồ", embed.embed(["hồ xanh"])[0]), ("d2", "núi cao", "Núi", embed.embed(["núi"])[0])], "id string, content string, title string, vector array<float>")
    cases = spark.createDataFrame([("q1", "easy", "hồ xanh", "answerable", ["xanh"], "", None)], "id string, category string, question string, expected_behavior string, expected_keywords array<string>, relevant_context string, notes string")
    asked = spark.createDataFrame([("q1", "hồ xanh", embed.embed(["hồ xanh"])[0])], "query_id string, query string, vector array<float>")
    row = ingest.run_evaluation(cases, Retrieval(texts, "id", 8), asked, providers.EchoWriter(), providers.KeywordJudge(), "none").first()
    assert row.recall == 1.0 and row.mrr == 1.0 and row.retrieved_chunks[0] == "d1" and row.answer.endswith("hồ xanh")


def test_stream_ends_and_tokens(spark):
    answers = spark.createDataFrame([("a", 2, ["x ", "y"], "x y"), ("b", 0, None, None)], "query_id string, results int, tokens array<string>, answer string")
    made = events.answer_events(answers)
    assert {(r.query_id, r.ok, r.answer) for r in events.final_answers(made).collect()} == {("a", True, "x y"), ("b", False, events.NO_CONTEXT)}
    tokens = made.where("type = 'token'").select(F.col("query_id").alias("stream_id"), "seq", F.col("data").alias("token"))
    assert events.join_tokens(tokens).first().text == "x y"
    five = spark.createDataFrame([("s", i, "t") for i in range(7)], "stream_id string, seq int, token string")
    assert [r.at_ms for r in events.bursty_schedule(five).orderBy("seq").collect()] == [0, 5, 10, 15, 20, 85, 90]
    assert [r.at_ms for r in events.steady_schedule(five, 100, 2).orderBy("seq").collect()][:2] == [100, 102]


def test_a_stream_of_tokens_is_batched_with_a_timer(spark, tmp_path):
    rows = [("a", i, float(i), f"token{i} ") for i in range(9)] + [("b", 0, 0.0, "short")]
    schema = "stream_id string, seq int, at_ms double, token string"
    df = spark.createDataFrame(rows, schema)
    df.coalesce(1).write.parquet(f"file://{tmp_path}/in")
    made = events.batch_tokens(spark.readStream.schema(schema).parquet(f"file://{tmp_path}/in"))
    query = made.writeStream.format("memory").queryName("batched").option("checkpointLocation", f"file://{tmp_path}/check").trigger(processingTime="200 milliseconds").start()
    try:
        want = sorted(map(tuple, events.batch_tokens(df).collect()))
        for _ in range(120):
            if sorted(map(tuple, spark.table("batched").collect())) == want:
                break
            query.awaitTermination(0.25)
        assert sorted(map(tuple, spark.table("batched").collect())) == want and query.exception() is None
    finally:
        query.stop()


def test_an_index_is_written_and_grows(spark, tmp_path):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["hồ xanh", "hồ núi núi", "", None, "biển xanh xanh"])], "doc long, text string")
    asked = spark.createDataFrame([(1, "xanh hồ"), (2, "không có"), (None, "hồ"), (3, None)], "query_id int, query string")
    whole = bm25.search_texts(docs, "doc", "text", asked).orderBy("query_id", "rank").collect()
    assert {r.query_id for r in whole} == {1} and whole[0].doc == 0 and len(whole) == 3
    part = bm25.SparseIndex.build(docs.where("doc < 2"), "doc", "text").save(f"file://{tmp_path}/one")
    grown = part.add(docs.where("doc >= 2"), "text").save(f"file://{tmp_path}/two")
    assert bm25.SparseIndex.load(spark, f"file://{tmp_path}/two").search(asked).orderBy("query_id", "rank").collect() == whole
    assert grown.totals == (5, 8)
    assert bm25.search_texts(docs.limit(0), "doc", "text", asked).count() == 0


def test_ties_are_ordered_by_key_and_bounded(spark):
    docs = spark.createDataFrame([(f"d{i:03d}", "hồ") for i in range(200)], "doc string, text string").repartition(3)
    asked = spark.createDataFrame([(1, "hồ")], "query_id int, query string")
    assert [r.doc for r in bm25.search_texts(docs, "doc", "text", asked, 4).orderBy("rank").collect()] == ["d000", "d001", "d002", "d003"]


def test_quantiles_from_counts(spark):
    import random

    r = random.Random(3)
    values = [("a", float(r.choice([1, 2, 2, 3, r.randint(0, 5000)]))) for _ in range(3000)] + [("b", 7.0), ("b", None)]
    got = {x.g: x for x in evaluate.latency_summary(spark.createDataFrame(values, "g string, v double"), "g", "v").collect()}
    v = sorted(x for g, x in values if g == "a")
    assert (got["a"].p50, got["a"].p95, got["a"].p99) == ((v[1499] + v[1500]) / 2, v[2850], v[2970]) and got["b"].p99 == 7.0


def test_payload_of_the_other_leg(spark):
    leg = lambda rows: spark.createDataFrame(rows, "query_id int, k string, metadata map<string,string>")
    got = leg_payloads(leg([(1, "a", {"s": "d"}), (1, "b", {}), (1, "c", None)]), leg([(1, "b", {"s": "w"}), (1, "x", {"s": "y"})]), "k").collect()
    assert {(r.k, (r.metadata or {}).get("s")) for r in got} == {("a", "d"), ("b", "w"), ("c", None), ("x", "y")}


def test_rewriting_suggestions_and_prompts(spark):
    asked = spark.createDataFrame([("  Hồ  XANH ",)], "query string")
    assert providers.rewrite_queries(asked).first()[1:] == ("hồ xanh", "factual")
    writer = type("W", (), {"write": lambda self, ps: ['```json\n{"rewritten_query": "hồ", "intent": "list"}\n```'] * len(ps)})()
    assert providers.rewrite_queries(asked, writer).first()[1:] == ("hồ", "list")
    assert providers.suggest(spark.createDataFrame([("q", "a")], "question string, answer string"), providers.EchoWriter()).first().suggestions == ["a"]
    rows = [("s", 3, 0, "user", "now"), ("s", 0, 0, "system", "be kind"), ("s", 2, 1, "assistant", "a"), ("s", 2, 1, "user", "q")]
    messages = spark.createDataFrame(rows, "session_id string, part int, turn_no int, role string, content string")
    assert providers.chat_prompt(messages).first().prompt == "system: be kind\n\nuser: q\n\nassistant: a\n\nuser: now"
    assert providers.suite_prompt("c", "e").endswith("c\n\ne")


def test_written_folders_are_removed(spark):
    kept = dict(runtime._made)
    runtime._made.clear()
    df = runtime.materialize(spark.range(3))
    path = next(iter(runtime._made.values()))[0]
    assert df.count() == 3 and files.path_exists(spark, path)
    runtime.remove_folders(spark)
    assert not files.path_exists(spark, path)
    runtime._made.update(kept)
