"""Queries of indexing and search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lotusflow.operators import bm25, context, dense, evaluate, indexing, retrieval
from lotusflow.plans.tables import document_queries, documents, sql, table
from lotusflow.runtime import shared_folder

DIM = 64


def corpus_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Number of documents and their mean length in words."""
    return bm25.corpus_stats(documents(spark, sf), "text").select(
        F.col("total_docs").cast("long").alias("total_docs"), F.round("avg_len", 6).alias("avg_len")
    )


def _vocabulary(spark: SparkSession, sf: str) -> DataFrame:
    docs = documents(spark, sf)
    return bm25.term_stats(bm25.term_frequencies(docs, "doc_id", "text"), bm25.corpus_stats(docs, "text"))


def term_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Document frequency and weight of every word, with its position in the vocabulary."""
    return bm25.with_term_ids(_vocabulary(spark, sf)).select("term", "term_id", F.col("df").cast("long").alias("df"), F.round("idf", 6).alias("idf"))


def doc_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """The sparse vectors of the documents, one row per document and term id."""
    docs = documents(spark, sf)
    frequencies = bm25.term_frequencies(docs, "doc_id", "text")
    stats = spark.createDataFrame([bm25.corpus_stats(docs, "text").first()], "total_docs long, avg_len double")
    vocabulary = bm25.with_term_ids(bm25.term_stats(frequencies, stats))
    vectors = bm25.sparse_vectors(bm25.encode(frequencies, vocabulary, stats, "doc_id"), vocabulary, "doc_id")
    return vectors.select("doc_id", F.explode("sparse").alias("term_id", "weight")).select("doc_id", "term_id", F.round("weight", 6).alias("weight"))


def sparse_search(spark: SparkSession, sf: str) -> DataFrame:
    """The 25 best documents of each query by words."""
    return bm25.search_texts(documents(spark, sf), "doc_id", "text", document_queries(spark, sf)).select("query_id", "doc_id", "rank", "score")


def indexed_search(spark: SparkSession, sf: str) -> DataFrame:
    """The same from an index that is written, extended by a second part of the documents, and read back."""
    docs = documents(spark, sf)
    first = bm25.SparseIndex.build(docs.where("doc_id % 2 = 0"), "doc_id", "text").save(shared_folder(spark))
    whole = first.add(docs.where("doc_id % 2 <> 0"), "text").save(shared_folder(spark))
    return whole.search(document_queries(spark, sf)).select("query_id", "doc_id", "rank", "score")


def dense_search(spark: SparkSession, sf: str) -> DataFrame:
    """The 25 nearest vectors of each vector whose id is divisible by 100."""
    vectors = table(spark, sf, "embeddings")
    queries = vectors.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return dense.dense_search(vectors, "vec_id", "embedding", queries, DIM).select("query_id", "vec_id", "rank", "score")


def _texts(spark: SparkSession, sf: str) -> DataFrame:
    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))
    return (
        documents(spark, sf).withColumnRenamed("text", "content").join(vectors, "doc_id", "left").select("doc_id", "content", "title", "vector", "lang")
    )


def hybrid_retrieve(spark: SparkSession, sf: str) -> DataFrame:
    """Words and vectors fused, over Vietnamese documents, for the queries that have a vector."""
    texts = _texts(spark, sf)
    queries = document_queries(spark, sf).join(
        table(spark, sf, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector")), "query_id"
    )
    found = retrieval.Retrieval(texts, "doc_id", DIM).search(queries, {"lang": "vi"})
    return found.select(
        "query_id", "doc_id", "rank", F.round("rrf_score", 8).alias("rrf_score"), "dense_score", "sparse_score",
        "title", F.length("content").cast("long").alias("n_content"),
    )


def rrf_fuse(spark: SparkSession, sf: str) -> DataFrame:
    """Two ranked lists of vectors per label, by id and by first value, fused."""
    e = table(spark, sf, "embeddings").select(F.col("label").alias("query_id"), "vec_id", F.col("embedding")[0].cast("double").alias("score"))
    order = F.row_number().over
    by_id = e.withColumn("rank", order(Window.partitionBy("query_id").orderBy("vec_id"))).where("rank <= 25")
    by_value = e.withColumn("rank", order(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).where("rank <= 25")
    return retrieval.fuse(by_id, by_value, "vec_id").select("query_id", "vec_id", "rank", F.round("rrf_score", 8).alias("rrf_score"))


def incremental_index(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks without an index entry, with the payload of their document."""
    chunks = table(spark, sf, "chunks").select("id", "document_id", "chunk_order").distinct()
    todo = indexing.not_indexed(chunks, table(spark, sf, "index_entries"))
    return indexing.with_payload(todo, table(spark, sf, "raw_documents")).select("id", "document_id", "chunk_order", "source_id", "title")


def chunks_of_sources(spark: SparkSession, sf: str) -> DataFrame:
    """Documents, chunks and entries per source, from the whole tree."""
    chunks = table(spark, sf, "chunks").select("id", "document_id").distinct()
    found = indexing.chunks_with_source(chunks, table(spark, sf, "raw_documents"))
    entries = table(spark, sf, "index_entries").select(F.col("chunk_id").alias("id")).distinct().withColumn("indexed", F.lit(1))
    return found.join(entries, "id", "left").groupBy("source_id").agg(
        F.count_distinct("document_id").alias("documents"), F.count(F.lit(1)).alias("chunks"), F.count("indexed").alias("entries")
    )


def source_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """The chunks of one source."""
    chunks = table(spark, sf, "chunks").select("id", "document_id", "chunk_order").distinct()
    first = table(spark, sf, "sources").agg(F.min("id").alias("id")).first()["id"]
    return indexing.chunks_of_source(chunks, table(spark, sf, "raw_documents"), first)


def wanted_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """The chunks that the evaluation retrieved, by id."""
    chunks = table(spark, sf, "chunks").select("id", "document_id", "chunk_order").distinct()
    return indexing.chunks_by_id(chunks, table(spark, sf, "eval_results").select(F.explode("retrieved_chunks").alias("id")))


def storable_entries(spark: SparkSession, sf: str) -> DataFrame:
    """The entries a collection takes: with a vector, and of its size."""
    entries = table(spark, sf, "index_entries").select("chunk_id", "dense_vector", "sparse_vector").dropDuplicates(["chunk_id"])
    return indexing.storable(entries, DIM).select("chunk_id", F.size("dense_vector").alias("n_dense"), F.size("sparse_vector").alias("n_sparse"))


def filtered_results(spark: SparkSession, sf: str) -> DataFrame:
    """Ranked lists of two legs with their payload, from the dense leg and else from the sparse one."""
    e = table(spark, sf, "index_entries").select("chunk_id", "metadata").dropDuplicates(["chunk_id"])
    ranked = table(spark, sf, "eval_results").select(F.col("id").alias("query_id"), F.posexplode("retrieved_chunks").alias("at", "chunk_id")).distinct()
    near, words = ranked.where("at % 2 = 0"), ranked.where("at % 2 = 1")
    legs = retrieval.leg_payloads(near.join(e, "chunk_id"), words.join(e, "chunk_id"), "chunk_id")
    return legs.select("query_id", "chunk_id", F.col("metadata")["source_id"].alias("source_id")).distinct()


def keyed_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """The first half of the events as a table per user and type, changed by the latest of the second half."""
    events = table(spark, sf, "events").select("event_id", "user_id", "event_type", "value", F.unix_micros(F.col("ts").cast("timestamp")).alias("at_us"))
    last = lambda df: indexing.latest(df, ["user_id", "event_type"], F.desc("at_us"), F.desc("event_id"))
    middle = events.agg(F.avg("event_id").alias("m")).first()["m"]
    before, after = events.where(F.col("event_id") < F.lit(middle)), events.where(F.col("event_id") >= F.lit(middle))
    return indexing.upsert(last(before), last(after), ["user_id", "event_type"])


def payload_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Entries per intent that a filter on the payload lets through."""
    chunks = table(spark, sf, "chunks").select("id", "is_reference_section", "section_title").distinct()
    intents = F.array(*[F.lit(i) for i in ("factual", "recommendation", "comparison", "list", "procedural", "booking")])
    kept = chunks.withColumn("intent", F.explode(intents)).where(retrieval.intent_filter(F.col("intent"), F.col("is_reference_section")))
    return kept.where(retrieval.payload_filter({"section_title": "Lưu trú"}) | F.col("is_reference_section")).groupBy("intent").agg(F.count(F.lit(1)).alias("n"))


def context_build(spark: SparkSession, sf: str) -> DataFrame:
    """The context of each query from its best documents."""
    ranked = sparse_search(spark, sf).where("rank <= 5")
    texts = documents(spark, sf).select("doc_id", F.col("text").alias("content"), "title")
    return context.build_context(ranked.join(texts, "doc_id"))


def cited_sources(spark: SparkSession, sf: str) -> DataFrame:
    """The sources cited by the answers of the evaluation, by place among the chunks retrieved."""
    results = table(spark, sf, "eval_results").select("id", "answer", "retrieved_chunks").distinct()
    ranked = results.select(F.col("id").alias("query_id"), F.posexplode("retrieved_chunks").alias("at", "chunk_id"))
    texts = table(spark, sf, "chunks").select(F.col("id").alias("chunk_id"), "content", F.col("section_title").alias("title")).dropDuplicates(["chunk_id"])
    found = ranked.join(texts, "chunk_id").select("query_id", (F.col("at") + 1).alias("rank"), "title", "content")
    return context.cited_sources(results.select(F.col("id").alias("query_id"), "answer"), found).select(
        "query_id", "citation", "title", F.length("content").cast("long").alias("n_content")
    )


def recall_mrr(spark: SparkSession, sf: str) -> DataFrame:
    """Recall and reciprocal rank of the chunks retrieved for the evaluation; the first keyword stands for the expected context."""
    results = table(spark, sf, "eval_results").select("id", "expected_keywords", "retrieved_chunks").distinct()
    cases = results.select(F.col("id").alias("case_id"), F.slice("expected_keywords", 2, 1000).alias("keywords"), F.get("expected_keywords", F.lit(0)).alias("context"))
    ranked = results.select(F.col("id").alias("case_id"), F.posexplode("retrieved_chunks").alias("at", "chunk_id"))
    texts = table(spark, sf, "chunks").select(F.col("id").alias("chunk_id"), "content").dropDuplicates(["chunk_id"])
    found = ranked.join(texts, "chunk_id").select("case_id", (F.col("at") + 1).alias("rank"), "content")
    return evaluate.retrieval_metrics(cases, found).select("case_id", F.round("recall", 6).alias("recall"), F.round("mrr", 6).alias("mrr"))


QUERIES = {
    f.__name__: f
    for f in (
        corpus_stats, term_stats, doc_vectors, sparse_search, indexed_search, dense_search, hybrid_retrieve, rrf_fuse, incremental_index, chunks_of_sources,
        source_chunks, wanted_chunks, storable_entries, filtered_results, keyed_upsert, payload_filter, context_build, cited_sources, recall_mrr,
    )
}

_TF = """
d AS (SELECT doc_id, coalesce(text, '') AS text, title, lang FROM documents),
w AS (SELECT doc_id, list_transform(regexp_extract_all(text, '@T@'), lambda x: lower(x)) AS ws FROM d),
st AS (SELECT count(*) AS n, avg(len(ws)) AS al FROM w),
tf AS (SELECT doc_id, term, len, count(*) AS tf FROM (SELECT doc_id, len(ws) AS len, unnest(ws) AS term FROM w) GROUP BY 1, 2, 3),
vo AS (SELECT term, count(*) AS df, ln((any_value(n) - count(*) + 0.5) / (count(*) + 0.5) + 1) AS idf FROM tf, st GROUP BY term),
po AS (SELECT doc_id, term, idf * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * len / greatest(al, 1.0))) AS w FROM tf JOIN vo USING (term), st)
"""
_SPARSE = (
    _TF
    + """,
q AS (SELECT doc_id AS query_id, trim(regexp_replace(lower(coalesce(title, '')), '[@B@]+', ' ', 'g')) AS query FROM d WHERE doc_id % 100 = 0),
qw AS (SELECT query_id, list_transform(regexp_extract_all(query, '@T@'), lambda x: lower(x)) AS ws FROM q),
qt AS (SELECT query_id, term, len, count(*) AS tf FROM (SELECT query_id, len(ws) AS len, unnest(ws) AS term FROM qw) GROUP BY 1, 2, 3),
qp AS (SELECT query_id, term, idf * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * len / greatest(al, 1.0))) AS qw FROM qt JOIN vo USING (term), st)
"""
)
_RANKED = """
sc AS (SELECT query_id, doc_id, round(sum(w * qw), 6) AS score FROM po JOIN qp USING (term) @KEEP@ GROUP BY 1, 2),
sr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM sc)
"""
_DENSE = """
ev AS (SELECT vec_id, CAST(embedding AS DOUBLE[64]) AS v FROM embeddings),
"""

ORACLES = {
    "corpus_stats": f"WITH {_TF} SELECT n AS total_docs, round(al, 6) AS avg_len FROM st",
    "term_stats": f"WITH {_TF} SELECT term, row_number() OVER (ORDER BY term) - 1 AS term_id, df, round(idf, 6) AS idf FROM vo",
    "doc_vectors": f"""WITH {_TF}, ids AS (SELECT term, row_number() OVER (ORDER BY term) - 1 AS term_id FROM vo)
SELECT doc_id, CAST(term_id AS INTEGER) AS term_id, round(w, 6) AS weight FROM po JOIN ids ON ids.term = po.term""",
    "indexed_search": f"WITH {_SPARSE}, {_RANKED.replace('@KEEP@', '')} SELECT query_id, doc_id, CAST(rank AS INTEGER) AS rank, score FROM sr WHERE rank <= 25",
    "source_chunks": """SELECT DISTINCT c.id, c.document_id, c.chunk_order FROM chunks c JOIN raw_documents r ON r.document_id = c.document_id WHERE r.source_id = (SELECT min(id) FROM sources)""",
    "wanted_chunks": """SELECT DISTINCT id, document_id, chunk_order FROM chunks WHERE id IN (SELECT unnest(retrieved_chunks) FROM eval_results)""",
    "storable_entries": """SELECT DISTINCT chunk_id, CAST(len(dense_vector) AS INTEGER) AS n_dense, CAST(cardinality(sparse_vector) AS INTEGER) AS n_sparse FROM index_entries
WHERE (dense_vector IS NOT NULL OR sparse_vector IS NOT NULL) AND (dense_vector IS NULL OR len(dense_vector) = 64)""",
    "filtered_results": """WITH r AS (SELECT DISTINCT id AS query_id, unnest(retrieved_chunks) AS chunk_id FROM eval_results)
SELECT DISTINCT query_id, r.chunk_id, metadata['source_id'] AS source_id FROM r JOIN index_entries e ON e.chunk_id = r.chunk_id""",
    "sparse_search": f"WITH {_SPARSE}, {_RANKED.replace('@KEEP@', '')} SELECT query_id, doc_id, CAST(rank AS INTEGER) AS rank, score FROM sr WHERE rank <= 25",
    "dense_search": f"""WITH {_DENSE}
s AS (SELECT q.vec_id AS query_id, e.vec_id, round(array_cosine_similarity(q.v, e.v), 6) AS score FROM ev q, ev e WHERE q.vec_id % 100 = 0)
SELECT query_id, vec_id, CAST(rank AS INTEGER) AS rank, score FROM
  (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 25""",
    "hybrid_retrieve": f"""WITH {_DENSE} {_SPARSE}, {_RANKED.replace("@KEEP@", "WHERE doc_id IN (SELECT doc_id FROM d WHERE lang = 'vi') AND query_id IN (SELECT vec_id FROM embeddings)")},
ds AS (SELECT q.vec_id AS query_id, e.vec_id AS doc_id, round(array_cosine_similarity(q.v, e.v), 6) AS score FROM ev q, ev e JOIN d ON d.doc_id = e.vec_id
       WHERE d.lang = 'vi' AND q.vec_id IN (SELECT query_id FROM q)),
dr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM ds),
u AS (SELECT query_id, doc_id, rank, score AS dense_score, NULL AS sparse_score FROM dr WHERE rank <= 25
      UNION ALL SELECT query_id, doc_id, rank, NULL, score FROM sr WHERE rank <= 25),
f AS (SELECT query_id, doc_id, round(sum(1 / (60 + rank)), 9) AS rrf, max(dense_score) AS ds, max(sparse_score) AS ss FROM u GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, doc_id) AS rank FROM f)
SELECT query_id, r.doc_id, CAST(rank AS INTEGER) AS rank, round(rrf, 8) AS rrf_score, ds AS dense_score, ss AS sparse_score, title,
       CAST(length(text) AS BIGINT) AS n_content
FROM r JOIN d ON d.doc_id = r.doc_id WHERE rank <= 20""",
    "rrf_fuse": """WITH e AS (SELECT label AS query_id, vec_id, CAST(embedding[1] AS DOUBLE) AS score FROM embeddings),
a AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY vec_id) AS rank FROM e),
b AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM e),
f AS (SELECT query_id, vec_id, round(sum(1 / (60 + rank)), 9) AS rrf FROM (SELECT * FROM a WHERE rank <= 25 UNION ALL SELECT * FROM b WHERE rank <= 25) GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, vec_id) AS rank FROM f)
SELECT query_id, vec_id, CAST(rank AS INTEGER) AS rank, round(rrf, 8) AS rrf_score FROM r WHERE rank <= 20""",
    "incremental_index": """SELECT DISTINCT c.id, c.document_id, c.chunk_order, r.source_id, r.title FROM chunks c LEFT JOIN raw_documents r ON r.document_id = c.document_id
WHERE c.id NOT IN (SELECT chunk_id FROM index_entries)""",
    "chunks_of_sources": """WITH d AS (SELECT DISTINCT document_id, source_id FROM raw_documents), c AS (SELECT DISTINCT id, document_id FROM chunks),
e AS (SELECT DISTINCT chunk_id FROM index_entries)
SELECT source_id, count(DISTINCT c.document_id) AS documents, count(*) AS chunks, count(e.chunk_id) AS entries
FROM c JOIN d ON d.document_id = c.document_id LEFT JOIN e ON e.chunk_id = c.id GROUP BY source_id""",
    "keyed_upsert": """WITH v AS (SELECT event_id, user_id, event_type, value, epoch_us(ts) AS at_us FROM events)
SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id >= (SELECT avg(event_id) FROM events) DESC, at_us DESC, event_id DESC) = 1""",
    "payload_filter": """WITH c AS (SELECT DISTINCT id, is_reference_section, section_title FROM chunks),
i AS (SELECT unnest(['factual', 'recommendation', 'comparison', 'list', 'procedural', 'booking']) AS intent)
SELECT intent, count(*) AS n FROM c, i WHERE (intent IN ('procedural', 'booking') OR NOT coalesce(is_reference_section, false))
  AND (section_title = 'Lưu trú' OR is_reference_section) GROUP BY intent""",
    "context_build": f"""WITH {_SPARSE}, {_RANKED.replace('@KEEP@', '')},
b AS (SELECT query_id, rank, '[' || rank || ']' || CASE WHEN coalesce(title, '') <> '' THEN ' Tiêu đề: ' || title ELSE '' END || chr(10) ||
      regexp_replace(text, '\\A[@B@]+|[@B@]+\\z', '', 'g') AS block FROM sr JOIN d USING (doc_id) WHERE rank <= 5)
SELECT query_id, string_agg(block, chr(10) || chr(10) ORDER BY rank) AS context FROM b GROUP BY query_id""",
    "cited_sources": r"""WITH e AS (SELECT DISTINCT id, answer, retrieved_chunks FROM eval_results),
u AS (SELECT DISTINCT id, unnest(regexp_extract_all(answer, '\[(\d+)\]', 1)) AS n FROM e),
c AS (SELECT DISTINCT id, content, section_title FROM chunks),
r AS (SELECT id, unnest(retrieved_chunks) AS chunk_id, generate_subscripts(retrieved_chunks, 1) AS rank FROM e)
SELECT u.id AS query_id, '[' || n || ']' AS citation, c.section_title AS title, CAST(length(c.content) AS BIGINT) AS n_content
FROM u JOIN r ON r.id = u.id AND CAST(r.rank AS VARCHAR) = u.n JOIN c ON c.id = r.chunk_id WHERE r.rank <= 5""",
    "recall_mrr": """WITH e AS (SELECT DISTINCT id, expected_keywords[2:] AS kw, expected_keywords[1] AS ctx, retrieved_chunks FROM eval_results),
c AS (SELECT DISTINCT id, content FROM chunks),
r AS (SELECT id, unnest(retrieved_chunks) AS chunk_id, generate_subscripts(retrieved_chunks, 1) AS rank FROM e),
h AS (SELECT r.id, count(*) AS hits, min(rank) AS first FROM r JOIN c ON c.id = r.chunk_id JOIN e ON e.id = r.id
      WHERE rank <= 5 AND (len(list_filter(kw, lambda k: contains(lower(content), lower(k)))) > 0 OR (ctx <> '' AND contains(lower(content), lower(ctx)))) GROUP BY r.id)
SELECT e.id AS case_id, round(CASE WHEN hits IS NULL THEN 0.0 WHEN len(kw) > 0 THEN least(1.0, hits / len(kw)) ELSE 1.0 END, 6) AS recall,
       round(coalesce(1.0 / first, 0.0), 6) AS mrr FROM e LEFT JOIN h ON h.id = e.id""",
}
ORACLES = {k: sql(v) for k, v in ORACLES.items()}
