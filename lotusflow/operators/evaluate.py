"""Evaluation metrics and latency summaries."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lotusflow.functions import text as T
from lotusflow.functions.fixed import EVAL_CATEGORIES, JUDGE_REQUEST, NO_KEYWORDS
from lotusflow.providers import Writer, write_texts


def is_relevant(content: Column, context: Column, keywords: Column) -> Column:
    """The content holds the expected context or any keyword, case apart."""
    low = F.lower(content)
    by_context = (F.coalesce(context, F.lit("")) != "") & F.contains(low, F.lower(context))
    return F.coalesce(by_context, F.lit(False)) | F.coalesce(F.exists(keywords, lambda k: F.contains(low, F.lower(k))), F.lit(False))


def retrieval_metrics(cases: DataFrame, results: DataFrame, k: int = 5) -> DataFrame:
    """``(case_id, recall, mrr)`` of cases ``(case_id, keywords, context)`` over results ``(case_id, rank, content)``."""
    hits = (
        cases.join(results.where(F.col("rank") <= k), "case_id")
        .where(is_relevant(F.col("content"), F.col("context"), F.col("keywords")))
        .groupBy("case_id")
        .agg(F.count(F.lit(1)).alias("hits"), F.min("rank").alias("first"))
    )
    wanted = F.coalesce(F.size("keywords"), F.lit(0))
    return cases.join(hits, "case_id", "left").select(
        "case_id",
        F.when(F.col("hits").isNull(), 0.0).when(wanted > 0, F.least(F.lit(1.0), F.col("hits") / wanted)).otherwise(1.0).alias("recall"),
        F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("mrr"),
    )


def set_recall(retrieved: Column, relevant: Column, k: int) -> Column:
    """Share of the relevant ids among the first k; none relevant gives 0."""
    shared = F.size(F.array_intersect(F.slice(retrieved, 1, k), relevant))
    return F.when(F.size(relevant) > 0, shared / F.size(relevant)).otherwise(0.0)


#: What a judge returns.
JUDGEMENT = "correctness double, relevance double, hallucination boolean, refusal_appropriate string, reasoning string"


def judge_cases(results: DataFrame, chunks: DataFrame, shown: int = 3) -> DataFrame:
    """Adds ``prompt`` to evaluation results: the case, its answer and the first ``shown`` chunks it retrieved.

    Chunks ``(id, content)`` that do not exist leave their place out.
    """
    named = results.select("id", F.posexplode(F.slice("retrieved_chunks", 1, shown)).alias("at", "chunk_id"))
    texts = chunks.select(F.col("id").alias("chunk_id"), "content").dropDuplicates(["chunk_id"])
    block = F.concat(F.lit("["), (F.col("at") + 1).cast("string"), F.lit("] "), F.col("content"))
    ordered = F.array_sort(F.collect_list(F.struct("at", block.alias("block"))))
    seen = named.join(texts, "chunk_id").groupBy("id").agg(F.array_join(F.transform(ordered, lambda x: x["block"]), "\n\n").alias("chunks"))
    words = F.when(F.size("expected_keywords") > 0, F.array_join("expected_keywords", ", ")).otherwise(F.lit(NO_KEYWORDS))
    line = lambda name, c: F.concat(F.lit(f"{name}: "), F.coalesce(c, F.lit("")), F.lit("\n"))
    prompt = F.concat(
        F.lit(JUDGE_REQUEST), line("Loại", F.col("category")), line("Câu hỏi", F.col("question")), line("Mong đợi", F.col("expected_behavior")),
        line("Từ khóa", words), line("Trả lời", F.regexp_replace("answer", "\n", " ")), F.lit("Đoạn văn:\n"), F.coalesce("chunks", F.lit("")),
    )
    return results.join(seen, "id", "left").withColumn("prompt", prompt)


def judge(cases: DataFrame, writer: Writer) -> DataFrame:
    """Cases with a ``prompt`` and what the judge gave: ``correctness, relevance, hallucination, refusal_appropriate, reasoning``.

    A failed judge, or one that gives no JSON, leaves zeros, no hallucination, n/a and
    says so in ``reasoning``.
    """
    names = [n.split()[0] for n in JUDGEMENT.split(", ")]
    rest = [c for c in cases.columns if c not in names]
    asked = write_texts(cases.select(*rest), "prompt", writer, "written").withColumn("j", F.from_json(T.fenced_json(F.col("written")), JUDGEMENT))
    bad = F.col("j").isNull() | (F.col("j.correctness").isNull() & F.col("j.relevance").isNull() & F.col("j.reasoning").isNull())
    return asked.select(
        *rest,
        F.coalesce("j.correctness", F.lit(0.0)).alias("correctness"),
        F.coalesce("j.relevance", F.lit(0.0)).alias("relevance"),
        F.coalesce("j.hallucination", F.lit(False)).alias("hallucination"),
        F.coalesce("j.refusal_appropriate", F.lit("n/a")).alias("refusal_appropriate"),
        F.when(bad, F.lit("Judge error")).otherwise(F.coalesce("j.reasoning", F.lit(""))).alias("reasoning"),
    )


def eval_summary(results: DataFrame) -> DataFrame:
    """Overall (null category) and per category: count, mean and median of four metrics, rates and latency.

    A metric counts each of its values once with the number of rows that have it, so
    medians come from counts (see ``rank_values``) and no task holds a category.
    """
    yes, no = (F.count_if(F.col("refusal_appropriate") == v) for v in ("yes", "no"))
    metrics = ["recall_at_k", "mrr", "correctness", "relevance"]
    grouped = results.groupingSets([[F.col("category")], []], F.col("category")).agg(
        F.grouping_id().alias("level"),
        F.count(F.lit(1)).alias("cases"),
        *[F.round(F.avg(m), 6).alias(f"{m}_mean") for m in metrics],
        F.round(F.avg(F.col("hallucination").cast("double")), 6).alias("hallucination_rate"),
        F.round(F.avg("latency_ms"), 4).alias("latency_mean"),
        F.when(F.col("category").isNotNull() & (yes + no > 0), F.round(yes / (yes + no), 6)).alias("refusal_rate"),
    )
    # One row per category and metric value, and the same for all categories together.
    long = results.select("category", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])).alias("m"))
    counted = long.where("m.value is not null").groupBy("category", "m.metric", "m.value").agg(F.count(F.lit(1)).alias("c"))
    levels = F.array(F.struct(F.lit(0).alias("level"), F.col("category")), F.struct(F.lit(1).alias("level"), F.lit(None).cast("string").alias("category")))
    both = counted.select(F.explode(levels).alias("g"), "metric", "value", "c")
    keyed = both.select(F.concat_ws("|", F.col("g.level").cast("string"), "metric", F.coalesce("g.category", F.lit(""))).alias("group"), "g.level", "g.category", "metric", "value", "c")
    summed = keyed.groupBy("group", "level", "category", "metric", "value").agg(F.sum("c").alias("c"))
    n = F.col("n")
    middle = ranks_of_counts(summed.select("group", "value", "c"), "group", "value", {"low": F.floor((n - 1) / 2), "high": F.floor(n / 2)})
    named = middle.select(
        F.split("group", r"\|", 3).alias("p"), F.round((F.col("low") + F.col("high")) / 2, 6).alias("p50")
    ).select(F.col("p")[0].cast("int").alias("level"), F.col("p")[1].alias("metric"), F.col("p")[2].alias("key"), "p50")
    wide = named.groupBy("level", "key").agg(*[F.max(F.when(F.col("metric") == m, F.col("p50"))).alias(f"{m}_p50") for m in metrics])
    joined = grouped.withColumn("key", F.coalesce("category", F.lit(""))).join(wide, ["level", "key"], "left")
    return joined.select("category", "cases", *[f"{m}_mean" for m in metrics], *[f"{m}_p50" for m in metrics], "hallucination_rate", "latency_mean", "refusal_rate")


#: Ranges of values into which the distinct values of a group are cut.
RANGES = 256


def ranks_of_counts(counted: DataFrame, group: str, value: str, positions: dict[str, Column]) -> DataFrame:
    """Exact order statistics ``(group, name...)`` of values ``(group, value, c)`` that occur ``c`` times.

    ``positions`` gives the 0-based rank wanted of ``n`` values, counted with repeats.
    The values of a group are cut into ranges at approximate quantiles; the ranges are
    added up, of which there are ``RANGES`` a group at most, and only inside the ranges
    that hold a position are values sorted. All positions come from the same pass.
    """
    cuts = counted.groupBy(group).agg(F.percentile_approx(value, [i / RANGES for i in range(1, RANGES)], 4 * RANGES).alias("cuts"), F.sum("c").alias("n"))
    # One row per group: as many as groups, each of bounded size.
    placed = counted.join(cuts, group).withColumn("range", F.size(F.filter("cuts", lambda x: x < F.col(value))))
    ranges = placed.groupBy(group, "range").agg(F.sum("c").alias("c"), F.max("n").alias("n"))
    before = F.coalesce(F.sum("c").over(Window.partitionBy(group).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    wanted = F.array(*[F.struct(F.lit(name).alias("name"), p.cast("long").alias("at")) for name, p in positions.items()])
    found = ranges.withColumn("before", before).select(group, "range", "c", "before", F.explode(wanted).alias("w")).where("w.at >= before and w.at < before + c")
    held = found.select(group, "range", "before", "w.name", "w.at")
    upto = F.col("before") + F.sum("c").over(Window.partitionBy(group, "range", "name").orderBy(value))
    inside = placed.select(group, "range", value, "c").join(held, [group, "range"]).withColumn("upto", upto).where("upto > at")
    return inside.groupBy(group).agg(*[F.min(F.when(F.col("name") == name, F.col(value))).alias(name) for name in positions])


def rank_values(df: DataFrame, group: str, value: str, positions: dict[str, Column]) -> DataFrame:
    """Exact order statistics per group: ``(group, name...)``; see ``ranks_of_counts``. Null values do not count."""
    counted = df.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count(F.lit(1)).alias("c"))
    return ranks_of_counts(counted, group, value, positions)


def latency_summary(df: DataFrame, group: str, value: str) -> DataFrame:
    """``(group, n, mean, p50, p95, p99)``: median, and the values at int(.95 n) and min(int(.99 n), n-1)."""
    n = F.col("n")
    picked = rank_values(
        df,
        group,
        value,
        {
            "low": F.floor((n - 1) / 2),
            "high": F.floor(n / 2),
            "p95": F.least(F.floor(n * 0.95), n - 1),
            "p99": F.least(F.floor(n * 0.99), n - 1),
        },
    )
    means = df.where(F.col(value).isNotNull()).groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(value), 6).alias("mean"))
    return means.join(picked, group).select(group, "n", "mean", F.round((F.col("low") + F.col("high")) / 2, 6).alias("p50"), "p95", "p99")


def suite_problems(cases: DataFrame, required: Sequence[str], per_category: int = 5) -> DataFrame:
    """``(subject, problem)``: missing fields, unknown categories, categories of a wrong size."""
    missing = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in required]))
    fields = cases.select(F.col("id").alias("subject"), F.explode(F.transform(missing, lambda m: F.concat(F.lit("missing "), m))).alias("problem"))
    unknown = cases.where(~F.coalesce(F.col("category").isin(EVAL_CATEGORIES), F.lit(False))).select(
        F.col("id").alias("subject"), F.lit("unknown category").alias("problem")
    )
    sizes = (
        cases.groupBy("category").count().where((F.col("count") != per_category) & F.col("category").isNotNull())
        .select(F.col("category").alias("subject"), F.concat(F.lit("has "), F.col("count").cast("string"), F.lit(" cases")).alias("problem"))
    )
    return reduce(DataFrame.unionByName, [fields, unknown, sizes])
