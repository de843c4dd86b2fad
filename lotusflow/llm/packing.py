"""Filling fixed-capacity containers (problem 7).

Variable-capacity best fit over the histogram of sizes. Sizes are whole numbers
up to the capacity, so the corpus is described by at most ``capacity`` counts,
however many items there are. The planner looks at the largest size left, builds
for each permitted container length the best-fitting contents, opens the length
with the least cost (share of unused space), and applies that pattern as often as
the counts allow; at the end each container is downsized to the smallest permitted
length that holds its contents. Items get their containers by their rank within
their size: a join of every row with a bounded table of intervals, no row meets
another.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lotusflow.llm.common import arrow_map, materialize, table
from lotusflow.llm.encoding import count_ids
from lotusflow.llm.splitting import split_limits

#: Permitted container lengths, as shares of the capacity.
LENGTH_SHARES = (0.25, 0.5, 0.75, 1.0)

#: Rows of one size that are ranked together; hot sizes are cut into buckets of about this many.
RANK_ROWS = 250_000


def plan_bins(histogram: dict[int, int], lengths: Sequence[int]) -> list[tuple[int, int, int, list[int]]]:
    """Patterns ``(length, times, used, sizes)`` that use up the histogram.

    ``sizes`` is the contents of one container, largest first; the pattern is used
    ``times`` times. ``length`` is the downsized length. Sizes must lie between 1
    and the largest length.
    """
    lengths = sorted(set(lengths))
    counts = {s: c for s, c in histogram.items() if c > 0}
    if counts and (min(counts) < 1 or max(counts) > lengths[-1]):
        raise ValueError("sizes must lie between 1 and the largest length")
    left = sorted(counts)

    def fill(size: int, length: int) -> tuple[int, list[tuple[int, int]]]:
        """Best-fit contents beside one item of ``size``: unused space and (size, number)."""
        room, taken = length - size, [(size, 1)]
        top = len(left)
        while room > 0:
            i = bisect.bisect_right(left, room, 0, top) - 1
            if i < 0:
                break
            s = left[i]
            n = min(counts[s] - (s == size), room // s)
            if n > 0:
                room -= n * s
                taken.append((s, n))
            top = i
        return room, taken

    patterns = []
    while left:
        size = left[-1]
        cost, length, taken = None, 0, []
        for candidate in lengths[bisect.bisect_left(lengths, size) :]:
            unused, contents = fill(size, candidate)
            # Cheapest share of unused space; the longer container on a tie.
            if cost is None or unused / candidate <= cost:
                cost, length, taken = unused / candidate, candidate, contents
        need: dict[int, int] = {}
        for s, n in taken:
            need[s] = need.get(s, 0) + n
        times = min(counts[s] // n for s, n in need.items())
        for s, n in need.items():
            counts[s] -= n * times
            if counts[s] == 0:
                del counts[s]
                left.pop(bisect.bisect_left(left, s))
        used = sum(s * n for s, n in need.items())
        down = lengths[bisect.bisect_left(lengths, used)]
        patterns.append((down, times, used, [s for s in sorted(need, reverse=True) for _ in range(need[s])]))
    return patterns


def _intervals(patterns) -> dict[str, np.ndarray]:
    """Which ranks of a size go to which containers, as columns sorted by size and rank."""
    position: dict[int, int] = {}
    rows = []
    first_bin = 0
    for _, times, _, contents in patterns:
        seen: dict[int, int] = {}
        for s in contents:
            seen[s] = seen.get(s, 0) + 1
        for s, n in seen.items():
            at = position.get(s, 0)
            rows.append((s, at, first_bin, n))
            position[s] = at + n * times
        first_bin += times
    rows.sort()
    columns = np.array(rows, np.int64).reshape(-1, 4).T
    made = dict(zip(("size", "rank", "bin", "per_bin"), columns, strict=True))
    made["first"] = np.cumsum([0, *(times for _, times, _, _ in patterns)]).astype(np.int64)
    made["length"] = np.array([length for length, _, _, _ in patterns], np.int64)
    made["used"] = np.array([used for _, _, used, _ in patterns], np.int64)
    return made


def _place(key: str, plan: dict[str, np.ndarray], offsets: dict[tuple[int, int], int], capacity: int, full_bins: int, smallest: int):
    # One number per (size, rank), so that one search finds the interval.
    base = np.int64(1) << np.int64(44)
    heads = plan["size"] * base + plan["rank"]
    planned = int(plan["first"][-1])
    every = max(1, planned + full_bins)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = batch.column("size").to_numpy().astype(np.int64)
            bucket = batch.column("bucket").to_numpy()
            rank = batch.column("rank").to_numpy().astype(np.int64)
            rank = rank + np.array(
                [offsets.get((int(s), int(b)), 0) for s, b in zip(size, bucket, strict=True)], np.int64
            ).reshape(-1)
            full = size == capacity
            bin_id = np.where(full, planned + rank, rank % every)
            rest = ~full & (size > 0)
            at = np.searchsorted(heads, size[rest] * base + rank[rest], side="right") - 1
            bin_id[rest] = plan["bin"][at] + (rank[rest] - plan["rank"][at]) // plan["per_bin"][at]
            length = np.full(len(size), capacity if full_bins else smallest, np.int64)
            used = np.full(len(size), capacity if full_bins else 0, np.int64)
            mixed = bin_id < planned
            at = np.searchsorted(plan["first"], bin_id[mixed], side="right") - 1
            length[mixed], used[mixed] = plan["length"][at], plan["used"][at]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(key),
                    batch.column("part_no"),
                    batch.column("start"),
                    pa.array(size.astype(np.int32)),
                    pa.array(bin_id),
                    pa.array(length.astype(np.int32)),
                    pa.array(used.astype(np.int32)),
                ],
                names=[key, "part_no", "start", "size", "bin_id", "bin_length", "bin_used"],
            )

    return run


def pack_items(items: DataFrame, key: str, capacity: int, lengths: Sequence[int] | None = None) -> DataFrame:
    """Containers of the items ``(key, n_tokens)``.

    Columns ``key, part_no, start, size, bin_id, bin_length, bin_used``. An item
    larger than the capacity is cut into full containers and a remainder, which is
    packed like any item; no other item is cut. Null or negative sizes count as 0;
    items of size 0 are spread over the containers (one empty container if there
    is no other). Repeated rows are
    packed as items of their own; ties are ordered by key. No items, no rows.
    """
    if lengths is None:
        lengths = sorted({max(1, int(capacity * share)) for share in LENGTH_SHARES})
    kind = dict(items.dtypes)[key]
    n = F.greatest(F.coalesce(F.col("n_tokens"), F.lit(0)), F.lit(0))
    parts = F.greatest(F.ceil(n / F.lit(capacity)).cast("int"), F.lit(1))
    pieces = items.select(key, n.alias("n"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("part_no")).select(
        key,
        "part_no",
        (F.col("part_no").cast("long") * capacity).alias("start"),
        F.least(F.lit(capacity), F.col("n") - F.col("part_no") * capacity).cast("int").alias("size"),
    )
    # The sizes are needed twice, the texts behind them must be encoded once.
    pieces = materialize(pieces)
    per_size = {r["size"]: r["count"] for r in pieces.groupBy("size").count().collect()}
    # Cut only the hot sizes: bucket number = hash modulo the buckets of the size.
    buckets = {s: -(-c // RANK_ROWS) for s, c in per_size.items() if c > RANK_ROWS}
    modulus = F.lit(1)
    if buckets:
        pairs = [F.lit(x) for s, b in sorted(buckets.items()) for x in (int(s), int(b))]
        modulus = F.coalesce(F.create_map(*pairs)[F.col("size")], F.lit(1))
    bucketed = pieces.withColumn("bucket", F.pmod(F.xxhash64(key, "part_no"), modulus).cast("int"))
    offsets: dict[tuple[int, int], int] = {}
    if buckets:
        counts = bucketed.where(F.col("size").isin([int(s) for s in buckets])).groupBy("size", "bucket").count().collect()
        running: dict[int, int] = {}
        for r in sorted(counts, key=lambda r: (r["size"], r["bucket"])):
            offsets[r["size"], r["bucket"]] = running.get(r["size"], 0)
            running[r["size"]] = offsets[r["size"], r["bucket"]] + r["count"]
    ranked = bucketed.withColumn(
        "rank", F.row_number().over(Window.partitionBy("size", "bucket").orderBy(key, "part_no")).cast("long") - 1
    )
    histogram = {s: c for s, c in per_size.items() if 0 < s < capacity}
    intervals = _intervals(plan_bins(histogram, lengths))
    return arrow_map(
        ranked,
        _place(key, intervals, offsets, capacity, per_size.get(capacity, 0), min(lengths)),
        f"`{key}` {kind}, part_no int, start long, size int, bin_id long, bin_length int, bin_used int",
    )


def p7_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The container of every document, or of its parts."""
    capacity, _ = split_limits(spark, sf_dir, "pack")
    sizes = count_ids(table(spark, sf_dir, "documents"), "doc_id", "text")
    return pack_items(sizes, "doc_id", capacity)
