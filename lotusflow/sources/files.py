"""Readers and writers of files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lotusflow import schemas
from lotusflow.functions import text as T


def read_dataset(spark: SparkSession, path: str) -> DataFrame:
    """Paragraphs of a question-answering dataset: ``topic_no, paragraph_no, title, context``.

    Blank paragraphs are dropped and with them topics that have no other; missing
    titles become empty.
    """
    data = spark.read.schema(schemas.DATASET).json(path, multiLine=True)
    topics = data.select(F.posexplode("data").alias("topic_no", "t"))
    rows = topics.select("topic_no", F.coalesce("t.title", F.lit("")).alias("title"), F.posexplode("t.paragraphs").alias("paragraph_no", "p"))
    return rows.select("topic_no", "paragraph_no", "title", F.col("p.context").alias("context")).where(F.length(T.strip(F.col("context"))) > 0)


def raw_documents(paragraphs: DataFrame, tenant_id: str, kind: str, version: str) -> tuple[DataFrame, DataFrame]:
    """The source row and the documents of a dataset, with ids that depend only on the contents."""
    source = F.sha2(F.concat_ws("|", F.lit(tenant_id), F.lit(kind), F.lit(version)), 256)
    documents = paragraphs.select(
        F.sha2(F.concat_ws("|", source, "topic_no", "paragraph_no", "context"), 256).alias("document_id"),
        source.alias("source_id"),
        "title",
        F.col("context").alias("raw_content"),
        F.create_map(F.lit("topic_title"), F.col("title")).alias("metadata"),
    )
    rows = paragraphs.sparkSession.range(1).select(
        source.alias("id"), F.lit(tenant_id).alias("tenant_id"), F.lit(kind).alias("type"), F.lit(version).alias("version"),
        F.create_map().cast("map<string,string>").alias("metadata"),
    )
    return rows, documents


def extract_questions(spark: SparkSession, path: str) -> DataFrame:
    """The first question of the first paragraph of each topic with its first answer."""
    data = spark.read.schema(schemas.DATASET).json(path, multiLine=True)
    first = data.select(F.posexplode("data").alias("topic_no", "t")).select(
        "topic_no", "t.title", F.get("t.paragraphs", F.lit(0)).alias("p")
    ).withColumn("q", F.get("p.qas", F.lit(0)))
    return first.where("p is not null and q is not null").select(
        "topic_no", "title", F.col("q.id").alias("id"), F.col("q.question").alias("question"),
        F.coalesce(F.get("q.answers", F.lit(0))["text"], F.lit("")).alias("answer"), F.col("p.context").alias("context"),
    )


def corpus_sample(spark: SparkSession, path: str, topics: int = 5, chars: int = 800) -> DataFrame:
    """The first topics with a shortened context, for prompts."""
    return extract_questions(spark, path).where(F.col("topic_no") < topics).withColumn("context", F.substring("context", 1, chars))


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, on any file system."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def dump_json(value: Column) -> Column:
    """A struct, map or array as JSON with its letters kept; null stays null."""
    return F.to_json(value)


def load_json(text: Column, schema: str) -> Column:
    """The value of a JSON text; null, empty and broken texts give null."""
    return F.from_json(F.when(F.length(T.strip(text)) > 0, text), schema)


def read_json_lines(spark: SparkSession, path: str, schema: str, limit: int | None = None) -> DataFrame:
    """JSON lines with a declared schema; blank lines are skipped.

    ``limit`` takes the first lines of each file, which are read in order up to there.
    A missing file gives no rows.
    """
    if not path_exists(spark, path):
        return spark.createDataFrame([], schema)
    source = spark.read.text(path) if limit is None else _numbered_lines(spark, path)
    lines = source.where(F.length(T.strip(F.col("value"))) > 0)
    if limit is not None:
        first = Window.partitionBy("file").orderBy("line_no")
        lines = lines.withColumn("n", F.row_number().over(first)).where(F.col("n") <= limit)
    return lines.select(F.from_json("value", schema).alias("v")).select("v.*")


def read_questions(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """``(question)`` of a file of questions in JSON lines."""
    return read_json_lines(spark, path, "question string", limit)


def example_lines(spark: SparkSession, path: str, schema: str, limit: int = 10) -> DataFrame:
    """``(examples)``: the first objects as one JSON array, for prompts; none for a missing file."""
    rows = read_json_lines(spark, path, schema, limit)
    return rows.agg(F.to_json(F.collect_list(F.struct(*rows.columns))).alias("examples"))


def _numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(file, line_no, value)``: lines with the file they stand in, numbered in its order.

    Files are read in splits; a split gets its place from its offset, so no file has to
    fit into one row.
    """
    rows = spark.read.text(path).select(
        F.input_file_name().alias("file"), F.input_file_block_start().alias("block"), F.monotonically_increasing_id().alias("at"), "value"
    )
    order = Window.partitionBy("file").orderBy("block", "at")
    return rows.withColumn("line_no", F.row_number().over(order)).select("file", "line_no", "value")


def read_event_stream(spark: SparkSession, path: str) -> DataFrame:
    """``(file, line_no, token)`` of recorded event streams: data lines up to the end mark of their file, with a token in them."""
    return parse_event_lines(_numbered_lines(spark, path).withColumnRenamed("value", "line"), "file")


def parse_event_lines(lines: DataFrame, stream: str | None = None) -> DataFrame:
    """Tokens of event lines ``(line_no, line)`` of one stream, or of each ``stream``; broken JSON and lines without a choice give nothing.

    Each stream ends at its own mark, found by an aggregation of the marks alone.
    """
    keys = [] if stream is None else [stream]
    payload = F.regexp_extract("line", r"^data: ?(.*)$", 1)
    data = lines.where(F.startswith("line", F.lit("data:"))).withColumn("payload", T.strip(payload))
    ends = data.where("payload = '[DONE]'").groupBy(*keys).agg(F.min("line_no").alias("end"))
    if keys:
        before = data.join(ends, keys, "left")
    else:
        first = ends.first()
        before = data.withColumn("end", F.lit(None if first is None else first["end"]).cast("long"))
    parsed = before.where("end is null or line_no < end").withColumn("token", F.get_json_object("payload", "$.choices[0].delta.content"))
    return parsed.where(F.length("token") > 0).select(*keys, "line_no", "token")


def split_stream(chunks: DataFrame) -> DataFrame:
    """``(stream_id, line_no, data)``: the data lines of texts ``(stream_id, seq, chunk)`` that arrive in pieces.

    A line may begin in one piece and end in another; what follows the last line end is
    incomplete and gives nothing. One stream meets, as one answer is never long.
    """
    ordered = F.array_sort(F.collect_list(F.struct("seq", "chunk")))
    whole = chunks.groupBy("stream_id").agg(F.array_join(F.transform(ordered, lambda x: x["chunk"]), "").alias("text"))
    lines = whole.select("stream_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"), F.size(F.split("text", "\n")).alias("n"))
    data = F.regexp_extract("line", r"^data: (.*?)\r?$", 1)
    return lines.where((F.col("line_no") < F.col("n") - 1) & F.startswith("line", F.lit("data: "))).select("stream_id", "line_no", data.alias("data"))


def write_report_csv(df: DataFrame, path: str) -> None:
    """CSV with every value quoted, lists joined by a bar, line ends in texts as blanks."""
    columns = []
    for name, kind in df.dtypes:
        c = F.col(name)
        if kind.startswith("array"):
            c = F.array_join(c.cast("array<string>"), "|")
        elif kind == "string":
            c = F.regexp_replace(c, "\n", " ")
        columns.append(c.alias(name))
    df.select(*columns).write.option("quoteAll", True).option("escape", '"').option("header", True).csv(path)


def write_report_json(results: DataFrame, path: str, summary: DataFrame | None = None) -> None:
    """JSON lines of the results; with a summary a folder each for ``summary`` and ``results``."""
    if summary is None:
        results.write.json(path)
        return
    summary.coalesce(1).write.json(f"{path}/summary")
    results.write.json(f"{path}/results")


def write_timings(timings: DataFrame, path: str) -> None:
    """Stage timings as JSON lines and as CSV without quotes."""
    timings.write.json(f"{path}/json")
    timings.write.option("header", True).option("quote", "").csv(f"{path}/csv")
