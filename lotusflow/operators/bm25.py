"""BM25 statistics, sparse encoding and sparse search.

Postings are keyed by the term itself; term ids are a derived view. All statistics
come from partial aggregations. An index keeps one row per text with its terms, so a
search needs no shuffle of postings: a bounded block of queries travels to the texts,
every task keeps the best k of each query, and only those meet.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lotusflow.functions import text as T
from lotusflow.functions.fixed import BM25_B, BM25_K, LEG_TOP_K
from lotusflow.operators.topk import BestK, key_array
from lotusflow.runtime import arrow_map, materialize

#: Queries of one pass, and scores a task holds at a time.
QUERY_BLOCK, SCORES = 1024, 4_000_000


def document_terms(texts: DataFrame, key: str, text: str, *rest: Column | str) -> DataFrame:
    """``(key, length, terms, rest...)``: each text's number of words, and its distinct terms with their counts.

    The words of a text are sorted inside its row and counted by runs, so no
    shuffle is needed. A text without a word has an empty list.
    """
    def runs(w: Column) -> Column:
        n = F.size(w)
        heads = F.filter(F.sequence(F.lit(0), n), lambda i: (i < n) & ((i == 0) | (F.get(w, i) != F.get(w, i - 1))))
        run = lambda h: lambda s, j: F.struct(F.get(w, s).alias("term"), (F.coalesce(F.get(h, j + 1), n) - s).alias("tf"))
        return F.transform(F.array(heads), lambda h: F.transform(h, run(h)))[0]

    # Arrays of one element bind a value, so that nothing is sorted anew for every word.
    words = F.array(F.sort_array(T.terms(F.col(text))))
    counted = F.transform(words, lambda w: F.struct(F.size(w).alias("length"), runs(w).alias("terms")))
    return texts.select(key, F.explode(counted).alias("d"), *rest).select(key, "d.length", "d.terms", *(texts.select(*rest).columns if rest else []))


def term_frequencies(texts: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, term, tf, length)``; texts without a word give no row."""
    return document_terms(texts, key, text).select(key, "length", F.explode("terms").alias("r")).select(key, "r.term", "r.tf", "length")


def corpus_stats(texts: DataFrame, text: str) -> DataFrame:
    """One row ``(total_docs, avg_len)``; texts without a word count, a corpus without a text gives 0 and null."""
    return texts.select(F.size(T.terms(F.col(text))).alias("n")).agg(
        F.count(F.lit(1)).alias("total_docs"), F.avg("n").alias("avg_len")
    )


def term_stats(frequencies: DataFrame, stats: DataFrame) -> DataFrame:
    """``(term, df, idf)``; the one row of ``stats`` is read first and enters as a literal."""
    counted = frequencies.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    n = F.lit(stats.first()["total_docs"])
    return counted.select("term", "df", F.log((n - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1).alias("idf"))


def with_term_ids(stats: DataFrame) -> DataFrame:
    """Adds ``term_id``, the position of the term in code-point order.

    The terms are cut into ranges of like size, whatever they begin with, and written
    in order; each is numbered inside its range and shifted by the sizes of the ranges
    before, of which there are as many as partitions.
    """
    row = F.monotonically_increasing_id()
    ranged = stats.repartitionByRange("term").sortWithinPartitions("term")
    kept = materialize(ranged.select("term", "df", "idf", F.shiftright(row, 33).alias("part"), row.bitwiseAND(F.lit((1 << 33) - 1)).alias("at")))
    sizes = {r["part"]: r["n"] for r in kept.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}
    before, total = {}, 0
    for part in sorted(sizes):
        before[part], total = total, total + sizes[part]
    shift = F.create_map(*[F.lit(x) for pair in before.items() for x in pair])[F.col("part")] if before else F.lit(0)
    return kept.select("term", "df", "idf", (shift + F.col("at")).cast("long").alias("term_id"))


def weight(tf: Column, length: Column, idf: Column, avg_len: Column, k: float = BM25_K, b: float = BM25_B) -> Column:
    """The BM25 weight of a term in a text."""
    return idf * tf * (k + 1) / (tf + k * (1 - b + b * length / F.greatest(avg_len, F.lit(1.0))))


def encode(frequencies: DataFrame, terms: DataFrame, stats: DataFrame, key: str) -> DataFrame:
    """Postings ``(key, term, weight)``; words outside the vocabulary are dropped."""
    average = F.lit(stats.first()["avg_len"]).cast("double")
    return frequencies.join(terms.select("term", "idf"), "term").select(
        key, "term", weight(F.col("tf"), F.col("length"), F.col("idf"), average).alias("weight")
    )


def sparse_vectors(postings: DataFrame, term_ids: DataFrame, key: str) -> DataFrame:
    """``(key, sparse map<int,double>)`` from postings; bounded by the words of one text."""
    entry = F.struct(F.col("term_id").cast("int").alias("k"), F.col("weight").alias("v"))
    return (
        postings.join(term_ids.select("term", "term_id"), "term")
        .groupBy(key)
        .agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("sparse"))
    )


class SparseIndex:
    """An index of texts: ``docs`` (see ``document_terms``), ``vocabulary`` (term, df) and two totals.

    ``save`` writes it to a folder, ``load`` reads it back, ``add`` merges new texts
    into it without reading the texts it has.
    """

    def __init__(self, docs: DataFrame, key: str, vocabulary: DataFrame | None = None, total_docs: int | None = None, total_length: int | None = None) -> None:
        self.docs, self.key = docs, key
        self._vocabulary, self._totals = vocabulary, None if total_docs is None else (total_docs, total_length)

    @classmethod
    def build(cls, texts: DataFrame, key: str, text: str, *rest: Column | str) -> SparseIndex:
        """The index of texts, not yet written; ``rest`` are columns to filter by."""
        return cls(document_terms(texts, key, text, *rest), key)

    @property
    def vocabulary(self) -> DataFrame:
        """``(term, df)`` of all terms."""
        if self._vocabulary is None:
            self._vocabulary = self.docs.select(F.explode("terms.term").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
        return self._vocabulary

    @property
    def totals(self) -> tuple[int, int]:
        """Number of texts and of their words."""
        if self._totals is None:
            r = self.docs.agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("w")).first()
            self._totals = (r["n"], r["w"] or 0)
        return self._totals

    def add(self, texts: DataFrame, text: str, *rest: Column | str) -> SparseIndex:
        """The index with new texts; their keys must be new."""
        new = SparseIndex.build(texts, self.key, text, *rest)
        both = self.vocabulary.unionByName(new.vocabulary).groupBy("term").agg(F.sum("df").alias("df"))
        (n, w), (m, v) = self.totals, new.totals
        return SparseIndex(self.docs.unionByName(new.docs), self.key, both, n + m, w + v)

    def save(self, path: str) -> SparseIndex:
        """Write the index to an empty folder and return it as read from there."""
        spark = self.docs.sparkSession
        self.docs.write.parquet(f"{path}/docs")
        written = SparseIndex(spark.read.parquet(f"{path}/docs"), self.key, self._vocabulary, *(self._totals or (None, None)))
        written.vocabulary.write.parquet(f"{path}/vocabulary")
        n, w = written.totals
        spark.createDataFrame([(self.key, n, w)], "key string, total_docs long, total_length long").coalesce(1).write.parquet(f"{path}/totals")
        return SparseIndex.load(spark, path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> SparseIndex:
        """The index of a folder."""
        t = spark.read.parquet(f"{path}/totals").first()
        return cls(spark.read.parquet(f"{path}/docs"), t["key"], spark.read.parquet(f"{path}/vocabulary"), t["total_docs"], t["total_length"])

    def _known(self, words: list[str]) -> tuple[dict[str, int], int, int]:
        """Document frequencies of some words, number of texts and of words; one pass over the index where nothing is written."""
        spark = self.docs.sparkSession
        wanted = F.broadcast(spark.createDataFrame([(w,) for w in words], "term string"))
        if self._vocabulary is not None:
            n, w = self.totals
            return {r["term"]: r["df"] for r in self._vocabulary.join(wanted, "term").collect()}, n, w
        # An empty word in front of each text counts the texts and their lengths.
        terms = F.concat(F.array(F.lit("")), F.col("terms.term"))
        found = self.docs.select("length", F.explode(terms).alias("term")).join(F.broadcast(wanted.unionByName(spark.createDataFrame([("",)], "term string"))), "term")
        counted = {r["term"]: r for r in found.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("length").alias("w")).collect()}
        total = counted.pop("", None)
        self._totals = (total["df"], total["w"]) if total else (0, 0)
        return {t: r["df"] for t, r in counted.items()}, *self._totals

    def search(self, queries: DataFrame, k: int = LEG_TOP_K, keep: Column | None = None) -> DataFrame:
        """``(query_id, key, score, rank)``: the best texts of queries ``(query_id, query)`` by words.

        Texts without a shared word never appear; scores count to 6 decimals, ties are
        ordered by key. ``keep`` filters the texts that may be returned, while the
        statistics come from all of them. Null keys and null query ids take no part.
        """
        spark = self.docs.sparkSession
        kinds = {"query_id": dict(queries.dtypes)["query_id"], self.key: dict(self.docs.dtypes)[self.key]}
        schema = f"query_id {kinds['query_id']}, `{self.key}` {kinds[self.key]}, score double"
        asked = queries.where(F.col("query_id").isNotNull()).select("query_id", T.terms(F.col("query")).alias("w"))
        blocks = max(1, -(-asked.count() // QUERY_BLOCK))
        rows = (self.docs if keep is None else self.docs.where(keep)).where(F.col(self.key).isNotNull())
        passes = []
        for b in range(blocks):
            held = (asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b)).toArrow()
            words = held.column("w").to_pylist()
            vocabulary = sorted({w for ws in words for w in ws})
            if not vocabulary:
                continue
            df, n, total = self._known(vocabulary)
            average = max(1.0, total / n) if n else 1.0
            at = {w: i for i, w in enumerate(x for x in vocabulary if x in df)}
            if not at:
                continue
            idf = np.array([np.log((n - df[w] + 0.5) / (df[w] + 0.5) + 1) for w in at])
            weights = np.zeros((len(at), len(words)))
            for q, ws in enumerate(words):
                for w, tf in Counter(ws).items():
                    if w in at:
                        weights[at[w], q] = idf[at[w]] * tf * (BM25_K + 1) / (tf + BM25_K * (1 - BM25_B + BM25_B * len(ws) / average))
            # At most the words of one block of queries.
            known = F.broadcast(spark.createDataFrame(list(at.items()), "term string, at int"))
            # Numbered before the terms are taken apart, so that the terms of a text share their number.
            numbered = rows.select(self.key, "length", "terms", F.monotonically_increasing_id().alias("row"))
            found = numbered.select(self.key, "length", "row", F.explode("terms").alias("t")).join(known, F.col("t.term") == known["term"])
            found = found.select(self.key, "length", "row", "at", F.col("t.tf").alias("tf"))
            names = pa.concat_arrays(held.column("query_id").chunks)
            passes.append(arrow_map(found, _score(names, weights, idf, average, self.key, k), schema))
        if not passes:
            return spark.createDataFrame([], f"{schema}, rank int")
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), self.key)
        return reduce(DataFrame.unionByName, passes).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _score(names: pa.Array, weights: np.ndarray, idf: np.ndarray, average: float, key: str, k: int):
    """Scores the texts of a partition; the matched terms of a text are rows that follow each other."""
    step = max(256, SCORES // max(1, weights.shape[1]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, kind, rest = None, None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            if best is None:
                kind = batch.column(key).type
                best = BestK(weights.shape[1], k, pa.types.is_integer(kind))
            part = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
            row = part.column("row").to_numpy()
            # The last text may go on in the next batch.
            done = int(np.searchsorted(row, row[-1]))
            score(best, part.slice(0, done))
            rest = part.slice(done)
        if best is not None:
            score(best, rest)
            made = best.table(names, key, kind)
            if made.num_rows:
                yield made

    def score(best: BestK, part: pa.Table) -> None:
        if not part.num_rows:
            return
        row, at = part.column("row").to_numpy(), part.column("at").to_numpy()
        tf, length = part.column("tf").to_numpy().astype(float), part.column("length").to_numpy()
        weight = idf[at] * tf * (BM25_K + 1) / (tf + BM25_K * (1 - BM25_B + BM25_B * length / average))
        heads = np.flatnonzero(np.diff(row, prepend=-1))
        keys = key_array(pa.concat_arrays(part.column(key).take(pa.array(heads)).chunks), best.whole)
        ends = np.append(heads[1:], len(row))
        first = 0
        while first < len(heads):
            last = max(first + 1, int(np.searchsorted(ends, heads[first] + step, "right")))
            span = slice(heads[first], ends[last - 1])
            scores = np.add.reduceat(weight[span, None] * weights[at[span]], heads[first:last] - heads[first], axis=0).round(6).T
            scores[scores <= 0] = -np.inf
            best.add(0, scores, keys[first:last])
            first = last

    return run


def search_texts(texts: DataFrame, key: str, text: str, queries: DataFrame, k: int = LEG_TOP_K, keep: Column | None = None) -> DataFrame:
    """Answer queries ``(query_id, query)`` from texts that have no index; the texts are read twice."""
    index = SparseIndex.build(texts, key, text, *([] if keep is None else [keep.alias("_keep")]))
    return index.search(queries, k, None if keep is None else F.col("_keep"))
