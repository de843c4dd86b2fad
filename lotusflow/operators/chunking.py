"""Sections and chunks of documents.

Cleaning is done with JVM expressions. Sections and chunks are sequential folds
over the lines and paragraphs of one text, so they run in Arrow batches, one narrow
pass without a shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotusflow.functions import text as T
from lotusflow.functions.fixed import MAX_CHUNK, MAX_TOKENS, MIN_CHUNK, OVERLAP_TOKENS, REFERENCE_HEADINGS
from lotusflow.runtime import arrow_map

_MARKED = re.compile(r"^(#{1,6})\s*(.+)$")
_ANY_MARKED = re.compile(r"^(#{1,6})\s*(.+)$", re.MULTILINE)
_LIST = re.compile(r"^(?:[*#\-]|\d+[.)]\s)")
_SENTENCES = re.compile(r"(?<=[.!?;…])\s+")
_HEAD_CHAR = re.compile(f"^[A-Z{chr(0xC0)}-{chr(0x1EF8)}{chr(0x110)}0-9]")

Section = tuple[str, int, str]


def count_words(text: str) -> int:
    """Runs of characters that are not white space."""
    return len(text.split())


def is_list_line(line: str) -> bool:
    """A line that begins with a bullet, a heading mark or a number."""
    return _LIST.match(line.strip()) is not None


def looks_like_heading(line: str) -> bool:
    """Short, capital or digit first, no closing mark."""
    return bool(line) and count_words(line) <= 10 and len(line) <= 100 and line[-1] not in ".!?;:," and _HEAD_CHAR.match(line) is not None


def is_reference_heading(title: str) -> bool:
    """A title of a section of references."""
    return title.strip().lower() in REFERENCE_HEADINGS


def context_prefix(title: str, path: Sequence[str]) -> str:
    """The sentence that tells a chunk's document and section."""
    where = f", specifically the '{' > '.join(path[1:])}' section" if len(path) > 1 else ""
    return f"This chunk is from the '{title}' document{where}."


def sections_of(text: str, title: str) -> list[Section]:
    """(title, level, content) of a text; lines before the first heading have no title.

    Marked headings decide if there is any, else lines that look like headings. A
    heading without a line below it gives nothing; a text without a section is one
    section under the document's title.
    """
    if not text:
        return []
    marked = _ANY_MARKED.search(text) is not None
    out: list[Section] = []
    head, level, body = "", 1, []

    def close() -> None:
        if body:
            out.append((head, level, "\n".join(body).strip()))

    for line in text.split("\n"):
        if marked:
            m = _MARKED.match(line)
            found = (m.group(2).strip(), len(m.group(1))) if m else None
        else:
            found = (line.strip(), 1) if looks_like_heading(line.strip()) else None
        if found:
            close()
            (head, level), body = found, []
        else:
            body.append(line)
    close()
    return out or [(title, 1, text.strip())]


def blocks_of(content: str) -> list[tuple[bool, str]]:
    """Paragraphs of a section; the flag tells those whose lines are all list items."""
    out = []
    for part in content.split("\n\n"):
        part = part.strip()
        if part:
            out.append((all(is_list_line(x) for x in part.split("\n") if x.strip()), part))
    return out


def pack(sizes: list[int], limit: int, opens: Callable[[int], bool] = lambda i: False) -> list[list[int]]:
    """Greedy groups of consecutive items; an item too large stands alone, ``opens`` forces a new group."""
    groups: list[list[int]] = []
    room = 0
    for i, size in enumerate(sizes):
        if not groups or opens(i) or size > room:
            groups.append([])
            room = limit
        groups[-1].append(i)
        room -= size
    return groups


def word_windows(text: str, limit: int, overlap: int) -> list[str]:
    """Windows of ``limit`` words, each sharing ``overlap`` with the one before; a short text stays as it is."""
    found = text.split()
    if len(found) <= limit:
        return [text]
    step = max(1, limit - overlap)
    last = next(s for s in range(0, len(found), step) if s + limit >= len(found))
    return [" ".join(found[s : s + limit]) for s in range(0, last + 1, step)]


def recursive_pieces(content: str, limit: int, overlap: int) -> list[str]:
    """Paragraphs packed to the limit; larger ones by sentences, then by windows of words."""

    def packed(parts: list[str]) -> list[str]:
        return ["\n\n".join(parts[i] for i in group) for group in pack([count_words(p) for p in parts], limit)]

    out: list[str] = []
    for piece in packed([p.strip() for p in content.split("\n\n") if p.strip()]):
        if count_words(piece) <= limit:
            out.append(piece)
            continue
        sentences = [s.strip() for s in _SENTENCES.split(piece) if s.strip()]
        for part in packed(sentences) if len(sentences) > 1 else [piece]:
            out += word_windows(part, limit, overlap)
    return out


def structure_pieces(content: str, limit: int) -> list[str]:
    """Paragraphs and lists packed to the limit; a list begins a new piece."""
    blocks = blocks_of(content)
    groups = pack([count_words(b) for _, b in blocks], limit, lambda i: blocks[i][0])
    return ["\n\n".join(blocks[i][1] for i in group) for group in groups]


def clean_documents(documents: DataFrame, text: str = "content") -> DataFrame:
    """Markup removed from ``text``; the other columns stay."""
    return documents.withColumn(text, T.clean_text(F.coalesce(F.col(text), F.lit(""))))


def normalize_documents(raw: DataFrame) -> DataFrame:
    """``document_id, source_id, title, content, metadata`` of raw documents; null texts become empty."""
    return raw.select(
        "document_id", "source_id", T.strip(F.col("title")).alias("title"), T.normalize_text(F.col("raw_content")).alias("content"), "metadata"
    )


def detect_sections(documents: DataFrame) -> DataFrame:
    """One row per section of ``(document_id, title, content)``: ``section_no, section_title, level, content``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: dict[str, list] = {n: [] for n in ("document_id", "section_no", "section_title", "level", "content")}
            for key, title, text in zip(*(batch.column(c).to_pylist() for c in ("document_id", "title", "content")), strict=True):
                for no, (head, level, body) in enumerate(sections_of(text or "", title or "")):
                    for name, v in zip(rows, (key, no, head, level, body), strict=True):
                        rows[name].append(v)
            yield pa.RecordBatch.from_pydict(
                rows, pa.schema([("document_id", pa.string()), ("section_no", pa.int32()), ("section_title", pa.string()), ("level", pa.int32()), ("content", pa.string())])
            )

    return arrow_map(documents.select("document_id", "title", "content"), run, "document_id string, section_no int, section_title string, level int, content string")


_CHUNK = pa.schema(
    [
        ("document_id", pa.string()), ("chunk_order", pa.int32()), ("content", pa.string()), ("token_count", pa.int32()),
        ("section_path", pa.list_(pa.string())), ("section_title", pa.string()), ("is_reference_section", pa.bool_()),
    ]
)


def chunk_documents(
    documents: DataFrame,
    structured: bool = True,
    limit: int = MAX_TOKENS,
    overlap: int = OVERLAP_TOKENS,
    with_prefix: bool = True,
    sectioner: Callable[[str, str], list[Section]] = sections_of,
    chunker: Callable[[str], list[str]] | None = None,
) -> DataFrame:
    """Chunks of ``(document_id, title, content)`` before validation.

    ``structured`` keeps lists whole and names the document and section at the head
    of each chunk; otherwise paragraphs, sentences and windows of words are packed.
    ``sectioner`` finds the sections of a text and ``chunker`` cuts the content of one;
    both can be replaced. ``chunk_order`` counts through the document. Null and empty
    texts give none.
    """
    cut = chunker or ((lambda body: structure_pieces(body, limit)) if structured else (lambda body: recursive_pieces(body, limit, overlap)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: dict[str, list] = {n: [] for n in _CHUNK.names}
            for key, title, text in zip(*(batch.column(c).to_pylist() for c in ("document_id", "title", "content")), strict=True):
                title = title or ""
                order = 0
                for head, _, body in sectioner(text or "", title):
                    path = [title, head] if head else [title]
                    for piece in cut(body):
                        if structured and with_prefix:
                            piece = f"{context_prefix(title, path)}\n\n{piece}"
                        reference = structured and is_reference_heading(head)
                        for name, v in zip(rows, (key, order, piece, count_words(piece), path, head, reference), strict=True):
                            rows[name].append(v)
                        order += 1
            yield pa.RecordBatch.from_pydict(rows, _CHUNK)

    schema = "document_id string, chunk_order int, content string, token_count int, section_path array<string>, section_title string, is_reference_section boolean"
    return arrow_map(documents.select("document_id", "title", "content"), run, schema)


def valid_chunks(chunks: DataFrame, least: int = MIN_CHUNK, most: int = MAX_CHUNK) -> DataFrame:
    """Chunks that are not blank and have a permitted number of tokens; the order keeps its gaps."""
    return chunks.where((F.length(T.strip(F.col("content"))) > 0) & F.col("token_count").between(least, most))


def enrich_metadata(documents: DataFrame) -> DataFrame:
    """``metadata`` with title, source and id of the document, where it has no value of that name; null metadata counts as empty."""
    kept = F.coalesce("metadata", F.create_map().cast("map<string,string>"))
    own = F.create_map(*[x for c in ("title", "source_id", "document_id") for x in (F.lit(c), F.col(c))])
    return documents.withColumn("metadata", F.map_concat(kept, F.map_filter(own, lambda k, _: ~F.map_contains_key(kept, k))))


def chunk_pipeline(documents: DataFrame, stages: list[Callable[[DataFrame], DataFrame]] | None = None) -> DataFrame:
    """Normalized documents to valid chunks with ids; any stage can be replaced."""
    for stage in stages or [clean_documents, chunk_documents, valid_chunks]:
        documents = stage(documents)
    return documents.withColumn("id", F.sha2(F.concat_ws("|", "document_id", "chunk_order"), 256))


def describe_lines(documents: DataFrame) -> DataFrame:
    """``(document_id, list_lines, headings, reference_headings)`` of ``(document_id, content)``, as the chunker sees its lines."""
    names = ("list_lines", "headings", "reference_headings")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: list[list[int]] = [[], [], []]
            for text in batch.column("content").to_pylist():
                lines = (text or "").split("\n")
                counts[0].append(sum(map(is_list_line, lines)))
                counts[1].append(sum(looks_like_heading(x.strip()) for x in lines))
                counts[2].append(sum(is_reference_heading(re.sub("^#{1,6}", "", x)) for x in lines))
            yield pa.RecordBatch.from_arrays([batch.column("document_id"), *(pa.array(c, pa.int64()) for c in counts)], names=["document_id", *names])

    return arrow_map(documents.select("document_id", "content"), run, f"document_id string, {', '.join(f'{n} long' for n in names)}")


def window_texts(df: DataFrame, key: str, text: str, limit: int = MAX_TOKENS, overlap: int = OVERLAP_TOKENS) -> DataFrame:
    """``(key, window_no, content)``: the windows of words of each text; a null text counts as empty and gives one empty window."""
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [word_windows(t or "", limit, overlap) for t in batch.column("text").to_pylist()]
            rows = [i for i, w in enumerate(made) for _ in w]
            yield pa.RecordBatch.from_arrays(
                [batch.column(key).take(pa.array(rows, pa.int64())), pa.array([n for w in made for n in range(len(w))], pa.int64()), pa.array([x for w in made for x in w], pa.string())],
                names=[key, "window_no", "content"],
            )

    return arrow_map(df.select(key, F.col(text).alias("text")), run, f"`{key}` {kind}, window_no long, content string")


def prefix_chunks(chunks: DataFrame) -> DataFrame:
    """``(id, prefix)``: the sentence for each chunk ``(id, section_path)``; a path without a document gives none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [context_prefix(p[0], [x for x in p if x is not None]) if p and p[0] is not None else None for p in batch.column("section_path").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(made, pa.string())], names=["id", "prefix"])

    return arrow_map(chunks.select("id", "section_path"), run, "id string, prefix string")
