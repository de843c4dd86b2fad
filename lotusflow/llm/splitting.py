"""Splitting oversized items at natural boundaries (problem 2).

Agglomerative merging: a text above the limit is cut into atomic segments
(sentences, lines, and runs of tokens where a sentence alone is too long);
adjacent segments sit in a heap keyed by the strength of the boundary between
them, and the weakest boundaries are merged first as long as the merged body and
the overlap stay within the limit. What is left of the boundaries becomes the
cuts. Every piece but the first repeats the last ``overlap`` tokens of the piece
before it.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotusflow.llm.common import NOT_SPACE, arrow_map, distinct_rows, table

#: The code points with the Unicode property White_Space.
WHITE_POINTS = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: Those that end a line; the last one ends a paragraph by itself.
BREAK_POINTS = [0x0A, 0x0B, 0x0C, 0x0D, 0x85, 0x2028, 0x2029]

WHITE = "".join(map(chr, WHITE_POINTS))
_TOKEN = re.compile(f"[^{WHITE}]+")
_BREAK = "(?:\r\n|[" + "".join(map(chr, BREAK_POINTS)) + "])"
_BLANK = "[" + "".join(chr(p) for p in WHITE_POINTS if p not in BREAK_POINTS) + "]*"
_PARAGRAPH = re.compile(f"{_BREAK}{_BLANK}{_BREAK}|{chr(0x2029)}")
_LINE = re.compile(_BREAK)
_HEADING = re.compile(r"#{1,6}\s|={2,}")
_SENTENCE_END = re.compile(r"[.!?…。！？;][\"'”’)\]»]*$")

#: Strength of a boundary: within a sentence, after a sentence, line, paragraph, before a heading.
INSIDE, SENTENCE, LINE, PARAGRAPH, HEADING = range(5)


def count_tokens(text: str | None) -> int:
    """Number of longest runs of characters that are not white space; null counts 0."""
    return len(_TOKEN.findall(text)) if text else 0


def _atoms(text: str, spans: list[tuple[int, int]], body: int) -> tuple[list[int], list[int]]:
    """First token of each atomic segment, and the strength of the boundary before it."""
    starts, strength = [0], [HEADING]
    for i in range(1, len(spans)):
        gap = text[spans[i - 1][1] : spans[i][0]]
        kind = INSIDE
        if _LINE.search(gap):
            kind = PARAGRAPH if _PARAGRAPH.search(gap) else LINE
            if _HEADING.match(text, spans[i][0]):
                kind = HEADING
        elif _SENTENCE_END.search(text, max(spans[i - 1][0], spans[i - 1][1] - 8), spans[i - 1][1]):
            kind = SENTENCE
        if kind != INSIDE:
            starts.append(i)
            strength.append(kind)
    # A segment that alone exceeds the room is cut into runs of tokens.
    out_starts, out_strength = [], []
    for k, s in enumerate(starts):
        end = starts[k + 1] if k + 1 < len(starts) else len(spans)
        for j, cut in enumerate(range(s, end, body)):
            out_starts.append(cut)
            out_strength.append(strength[k] if j == 0 else INSIDE)
    return out_starts, out_strength


def merge_segments(sizes: list[int], strength: list[int], room: int) -> list[int]:
    """Indices of the segments that begin a piece.

    ``strength[i]`` is the boundary before segment i. Adjacent groups are merged
    weakest boundary first (then smallest result, then leftmost) while the
    result is at most ``room``.
    """
    n = len(sizes)
    before, after, size, alive = list(range(-1, n - 1)), list(range(1, n + 1)), list(sizes), [True] * n
    heap = [(strength[i], sizes[i - 1] + sizes[i], i) for i in range(1, n)]
    heapq.heapify(heap)
    while heap:
        _, total, right = heapq.heappop(heap)
        if not alive[right]:
            continue
        left = before[right]
        if size[left] + size[right] != total:
            continue
        if total > room:
            continue
        size[left] = total
        alive[right] = False
        after[left] = nxt = after[right]
        if nxt < n:
            before[nxt] = left
            heapq.heappush(heap, (strength[nxt], total + size[nxt], nxt))
        if left > 0:
            heapq.heappush(heap, (strength[left], size[before[left]] + total, left))
    return [i for i in range(n) if alive[i]]


def split_text(text: str, limit: int, overlap: int) -> list[tuple[int, int, int]]:
    """Pieces of a text as (start, end, tokens), in characters of the text.

    A text of at most ``limit`` tokens is one piece over the whole text. Pieces of
    longer texts run from token to token; together they cover every token.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and below the limit")
    spans = [m.span() for m in _TOKEN.finditer(text)]
    if len(spans) <= limit:
        return [(0, len(text), len(spans))]
    room = limit - overlap
    starts, strength = _atoms(text, spans, room)
    ends = [*starts[1:], len(spans)]
    heads = merge_segments([e - s for s, e in zip(starts, ends, strict=True)], strength, room)
    cuts = [starts[h] for h in heads] + [len(spans)]
    pieces = []
    for k in range(len(cuts) - 1):
        first = max(0, cuts[k] - overlap) if k else 0
        pieces.append((spans[first][0], spans[cuts[k + 1] - 1][1], cuts[k + 1] - first))
    return pieces


def _split_batches(limit: int, overlap: int, with_content: bool):
    fields = [
        ("tbl", pa.string()),
        ("id", pa.string()),
        ("piece_no", pa.int32()),
        ("start", pa.int64()),
        ("token_count", pa.int32()),
        ("pieces", pa.int32()),
        *([("content", pa.string())] if with_content else []),
    ]
    schema = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: dict[str, list] = {n: [] for n in schema.names}
            held = 0
            for tbl, key, text in zip(*(batch.column(c).to_pylist() for c in ("tbl", "id", "content")), strict=True):
                pieces = split_text(text or "", limit, overlap)
                for no, (a, b, n) in enumerate(pieces):
                    for name, v in zip(schema.names, (tbl, key, no, a, n, len(pieces)), strict=False):
                        rows[name].append(v)
                    if with_content:
                        rows["content"].append(text[a:b] if text is not None else None)
                        held += b - a
                if held > 16_000_000:
                    yield pa.RecordBatch.from_pydict(rows, schema=schema)
                    rows, held = {n: [] for n in schema.names}, 0
            if rows["id"]:
                yield pa.RecordBatch.from_pydict(rows, schema=schema)

    names = {"string": "string", "int32": "int", "int64": "long"}
    return run, ", ".join(f"{n} {names[str(t)]}" for n, t in fields)


def split_items(items: DataFrame, limit: int, overlap: int, with_content: bool = True) -> DataFrame:
    """Pieces of the items ``(tbl, id, content)``.

    Columns ``tbl, id, piece_no, start, token_count, pieces`` and ``content``.
    An item within the limit passes as a single piece without leaving the JVM;
    only larger ones go through the merging. Null contents give one null piece of
    0 tokens, empty and blank ones one piece of 0 tokens. Repeated rows give
    repeated pieces; use distinct items where that matters. Extra columns of the
    input are ignored.
    """
    text = F.col("content")
    # n tokens need 2n-1 characters, so short texts need no counting to be small.
    tokens = F.coalesce(F.regexp_count(text, F.lit(f"{NOT_SPACE}+")), F.lit(0))
    large = (F.length(text) >= 2 * limit + 1) & (tokens > limit)
    items = items.select("tbl", "id", "content")
    small = items.where(~F.coalesce(large, F.lit(False))).select(
        "tbl",
        "id",
        F.lit(0).alias("piece_no"),
        F.lit(0).cast("long").alias("start"),
        tokens.cast("int").alias("token_count"),
        F.lit(1).alias("pieces"),
        *([text] if with_content else []),
    )
    run, schema = _split_batches(limit, overlap, with_content)
    return small.unionByName(arrow_map(items.where(large), run, schema))


def split_limits(spark: SparkSession, sf_dir: str, purpose: str) -> tuple[int, int]:
    """Limit and overlap of a purpose, from the table of limits."""
    row = table(spark, sf_dir, "size_limits").where(F.col("purpose") == purpose).select("max_tokens", "overlap_tokens").first()
    return int(row[0]), int(row[1])


def oversize_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contents of raw documents and chunks as ``(tbl, id, content)``."""
    raw = table(spark, sf_dir, "raw_documents").select(
        F.lit("raw_documents").alias("tbl"), F.col("document_id").alias("id"), F.col("raw_content").alias("content")
    )
    chunks = table(spark, sf_dir, "chunks").select(F.lit("chunks").alias("tbl"), "id", "content")
    return raw.unionByName(chunks)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that had to be split: the items the operator gave more than one piece."""
    limit, overlap = split_limits(spark, sf_dir, "split")
    pieces = split_items(oversize_items(spark, sf_dir), limit, overlap, with_content=False)
    return pieces.where("pieces > 1 and piece_no = 0").select("tbl", "id").distinct()


def p2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every item; repeated rows count once, and no row that occurs once is moved."""
    limit, overlap = split_limits(spark, sf_dir, "split")
    return split_items(distinct_rows(oversize_items(spark, sf_dir), ["tbl", "id"]), limit, overlap)


P2_FOUND_SQL = r"""
WITH items AS (
  SELECT 'raw_documents' AS tbl, document_id AS id, raw_content AS content FROM raw_documents
  UNION ALL SELECT 'chunks', id, content FROM chunks)
SELECT DISTINCT tbl, id FROM items
WHERE len(regexp_extract_all(content, '[^\x09-\x0d\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+')) > 300
"""
