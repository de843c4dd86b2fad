"""Reading the project's tables for the queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lotusflow.functions import text as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with an empty text for a null one."""
    return table(spark, sf_dir, "documents").withColumn("text", F.coalesce("text", F.lit("")))


def document_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(query_id, query)``: the titles of the documents whose id is divisible by 100."""
    return documents(spark, sf_dir).where("doc_id % 100 = 0").select(
        F.col("doc_id").alias("query_id"), T.normalize_query(F.coalesce("title", F.lit(""))).alias("query")
    )


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log of chat turns."""
    return table(spark, sf_dir, "chat_turns")


def micros(column: str) -> Column:
    """A timestamp as microseconds."""
    return F.unix_micros(column)


#: The blanks of ``functions.text.BLANK`` as a class of a regular expression without Unicode classes.
BLANKS = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"

#: The words of ``functions.text.TERM``.
WORDS = r"[\p{L}\p{N}_\x{C0}-\x{24F}\x{1EA0}-\x{1EFF}]+"


def sql(text: str) -> str:
    """Fill the named classes into a statement."""
    return text.replace("@B@", BLANKS).replace("@T@", WORDS)
