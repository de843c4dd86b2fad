"""Ingest, index and answer as whole jobs over a store."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lotusflow.functions import text as T
from lotusflow.functions.fixed import CONTEXT_CHUNKS, MAX_TOKENS
from lotusflow.operators import bm25, chunking, context, evaluate, indexing
from lotusflow.operators.retrieval import Retrieval
from lotusflow.providers import Embedder, Writer, embed_texts, write_texts
from lotusflow.sources import files
from lotusflow.sources.tables import Store

NONE = "map<string,string>"


def document_rows(raw: DataFrame, status: str | Column) -> DataFrame:
    """Rows of the table of documents for raw documents, with the checksum of their text; repeated rows count once."""
    return raw.select(
        F.col("document_id").alias("id"), "source_id", T.checksum(F.coalesce("raw_content", F.lit(""))).alias("checksum"),
        (F.lit(status) if isinstance(status, str) else status).alias("status"), F.coalesce("metadata", F.create_map().cast(NONE)).alias("metadata"),
    ).dropDuplicates(["id"])


def chunk_rows(raw: DataFrame, limit: int = MAX_TOKENS) -> DataFrame:
    """Valid chunks of raw documents: normalized, cleaned, enriched, sectioned, cut and validated."""
    stages = [
        lambda d: chunking.normalize_documents(d).dropDuplicates(["document_id"]), chunking.clean_documents, chunking.enrich_metadata,
        lambda d: chunking.chunk_documents(d, limit=limit), chunking.valid_chunks,
    ]
    return chunking.chunk_pipeline(raw, stages)


def ingest_dataset(store: Store, path: str, tenant_id: str, kind: str, version: str, embedder: Embedder | None = None) -> str:
    """Read a dataset into the sources, documents and chunks of a store, and index it where an embedder is given; returns the source's id.

    Ids depend on the contents alone, so a second run changes nothing.
    """
    source, raw = files.raw_documents(files.read_dataset(store.spark, path), tenant_id, kind, version)
    store.save("sources", source.select(*store.table("sources").columns))
    store.save("chunks", chunk_rows(raw).select(*store.table("chunks").columns))
    store.save("documents", document_rows(raw, "indexed").select(*store.table("documents").columns))
    if embedder is not None:
        index_chunks(store, embedder)
    return source.first()["id"]


def index_chunks(store: Store, embedder: Embedder) -> int:
    """Give every chunk without an index entry its vectors; returns how many.

    Dense vectors come from the embedder. Sparse ones weigh the terms by all chunks
    and name them by their place in the vocabulary of all chunks.
    """
    chunks = store.table("chunks")
    todo = indexing.not_indexed(chunks, store.table("index_entries"))
    n = todo.count()
    if n:
        store.create_collection(embedder.dim)
        frequencies = bm25.term_frequencies(chunks, "id", "content")
        stats = store.spark.createDataFrame([bm25.corpus_stats(chunks, "content").first()], "total_docs long, avg_len double")
        vocabulary = bm25.with_term_ids(bm25.term_stats(frequencies, stats))
        mine = bm25.encode(frequencies.join(todo.select("id"), "id", "left_semi"), vocabulary, stats, "id")
        sparse = bm25.sparse_vectors(mine, vocabulary, "id").withColumnRenamed("sparse", "sparse_vector")
        dense = embed_texts(todo.select("id", "document_id", "is_reference_section", "content"), "content", embedder).drop("content")
        owner = store.table("documents").select(F.col("id").alias("document_id"), "source_id")
        made = dense.join(sparse, "id", "left").join(owner, "document_id", "left")
        payload = F.map_filter(
            F.create_map(F.lit("source_id"), F.col("source_id"), F.lit("is_reference_section"), F.col("is_reference_section").cast("string")), lambda _, v: v.isNotNull()
        )
        entries = made.select(F.col("id").alias("chunk_id"), "dense_vector", F.col("sparse_vector").cast("map<int,double>"), payload.alias("metadata"))
        store.save_entries(entries.select(*store.table("index_entries").columns))
    return n


def deploy(store: Store, path: str, tenant_id: str, kind: str, version: str, embedder: Embedder) -> str:
    """Bring a store into service: nothing where entries exist, indexing where chunks exist, else the whole ingest; returns which."""
    if not store.table("index_entries").isEmpty():
        return "ready"
    if not store.table("chunks").isEmpty():
        index_chunks(store, embedder)
        return "indexed"
    ingest_dataset(store, path, tenant_id, kind, version, embedder)
    return "ingested"


def run_evaluation(cases: DataFrame, retrieval: Retrieval, queries: DataFrame, writer: Writer, judge: Writer, no_context: str, top_k: int = CONTEXT_CHUNKS) -> DataFrame:
    """Search, answer and judge the cases of a suite; one row per case with its metrics and scores.

    ``cases`` has ``id, category, question, expected_behavior, expected_keywords,
    relevant_context``; ``queries`` is ``(query_id, query, vector)`` with the case's id.
    A case that finds nothing is answered by ``no_context`` without the writer.
    """
    key = retrieval.key
    found = retrieval.search(queries, top_k=top_k)
    built = context.build_context(found, top_k)
    asked = cases.join(built.withColumnRenamed("query_id", "id"), "id", "left").withColumn(
        "ask", F.when(F.col("context").isNotNull(), context.user_prompt(F.col("question"), F.col("context")))
    )
    answered = write_texts(asked, "ask", writer, "written").withColumn("answer", F.when(F.col("context").isNull(), F.lit(no_context)).otherwise(F.coalesce("written", F.lit(""))))
    listed = F.array_sort(F.collect_list(F.struct("rank", F.col(key).cast("string").alias("k"))))
    lists = found.groupBy(F.col("query_id").alias("id")).agg(F.transform(listed, lambda x: x["k"]).alias("retrieved_chunks"))
    rows = answered.drop("ask", "written", "context").join(lists, "id", "left").withColumn("retrieved_chunks", F.coalesce("retrieved_chunks", F.array().cast("array<string>")))
    metrics = evaluate.retrieval_metrics(
        cases.select(F.col("id").alias("case_id"), F.col("expected_keywords").alias("keywords"), F.col("relevant_context").alias("context")),
        found.select(F.col("query_id").alias("case_id"), "rank", "content"), top_k,
    )
    texts = retrieval.texts.select(F.col(key).cast("string").alias("id"), "content")
    return evaluate.judge(evaluate.judge_cases(rows, texts), judge).drop("prompt").join(metrics.withColumnRenamed("case_id", "id"), "id")


def timed(stages: dict[str, Callable[[], DataFrame]]) -> dict[str, float]:
    """Milliseconds of each stage, with all its columns computed and thrown away."""
    took = {}
    for name, stage in stages.items():
        began = time.perf_counter()
        stage().write.format("noop").mode("overwrite").save()
        took[f"{name}_ms"] = (time.perf_counter() - began) * 1000
    return took


def timings_table(spark: SparkSession, timings: list[dict[str, float]]) -> DataFrame:
    """Timings of several runs as rows ``(stage, value)``, for ``evaluate.latency_summary``."""
    return spark.createDataFrame([(s, float(v)) for t in timings for s, v in t.items()], "stage string, value double")
