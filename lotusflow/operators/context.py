"""Context for answers, citations and answer clean-up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotusflow.functions import text as T
from lotusflow.functions.fixed import CONTEXT_CHUNKS, CONTEXT_MARK, SYSTEM_PROMPT, TITLE_MARK


def citation_blocks(results: DataFrame, most: int = CONTEXT_CHUNKS, with_title: bool = True) -> DataFrame:
    """The first results ``(query_id, rank, title, content)`` with their ``citation`` and ``block``."""
    number = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("]"))
    title = F.coalesce(F.col("title"), F.lit(""))
    header = F.when(F.lit(with_title) & (title != ""), F.concat(number, F.lit(" " + TITLE_MARK), title)).otherwise(number)
    block = F.concat(header, F.lit("\n"), T.strip(F.col("content")))
    return results.where(F.col("rank") <= most).withColumns({"citation": number, "block": block})


def build_context(results: DataFrame, most: int = CONTEXT_CHUNKS, with_title: bool = True) -> DataFrame:
    """``(query_id, context)``; at most ``most`` blocks meet per query, queries without a result give no row."""
    blocks = citation_blocks(results, most, with_title)
    ordered = F.array_sort(F.collect_list(F.struct("rank", "block")))
    return blocks.groupBy("query_id").agg(F.array_join(F.transform(ordered, lambda x: x["block"]), "\n\n").alias("context"))


def cited_sources(answers: DataFrame, results: DataFrame, most: int = CONTEXT_CHUNKS) -> DataFrame:
    """``(query_id, citation, title, content)`` of the citations in answers ``(query_id, answer)``; unknown numbers give nothing."""
    used = answers.select("query_id", F.explode(T.citations(F.col("answer"))).alias("n")).select(
        "query_id", F.concat(F.lit("["), "n", F.lit("]")).alias("citation")
    )
    known = citation_blocks(results, most).select("query_id", "citation", "title", "content")
    return used.join(known, ["query_id", "citation"])


def user_prompt(question: Column, context: Column) -> Column:
    """The prompt of a single question."""
    return F.concat(F.lit("Ngữ cảnh:\n"), context, F.lit("\n\nCâu hỏi: "), question)


def system_message(context: Column) -> Column:
    """The system message with the context, if there is one."""
    return F.when(F.coalesce(context, F.lit("")) != "", F.concat(F.lit(SYSTEM_PROMPT + "\n\n" + CONTEXT_MARK), context)).otherwise(
        F.lit(SYSTEM_PROMPT)
    )


def finish_answers(answers: DataFrame) -> DataFrame:
    """Answers ``(question, answer)`` without a repeated question, with ``tokens_hint``."""
    done = answers.withColumn("answer", T.strip_echo(F.col("question"), F.col("answer")))
    return done.withColumn("tokens_hint", T.estimated_tokens(F.col("answer"), 200))
