"""Encoding a corpus with a public byte-level BPE tokenizer (problem 6).

The text is cut by the tokenizer's own pattern; each piece is merged over its
bytes. A segment tree over the byte positions holds the rank of the pair that
starts at each live position; its root gives the leftmost pair of the lowest
rank, and a merge updates the two or three positions it touches in logarithmic
time. So a piece of n bytes costs O(n log n) however long it is. Pieces recur,
so short ones are remembered per worker.

The vocabulary is read on the workers from ``tokenizer_path``, the folder of the
public tokenizers, which every machine of the cluster has.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from lotusflow.llm.common import arrow_map, table

#: Folder of the public tokenizers, and the tokenizer used for this project.
TOKENIZER_PATH = os.environ.get("LOTUSFLOW_TOKENIZERS", "/opt/tokenizers")
TOKENIZER = "byte_bpe_50k"

#: Fixed value: the pattern that cuts a text before the merges.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Remembered pieces per worker, and the longest piece remembered, in characters.
CACHE_PIECES, CACHE_CHARS = 400_000, 48

_NO_PAIR = 1 << 60


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in the vocabulary file."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = dict(zip(map(chr, printable), printable, strict=True))
    spare = 256
    for byte in range(256):
        if byte not in printable:
            letters[chr(spare)] = byte
            spare += 1
    return letters


class PairTree:
    """Segment tree over byte positions: the leftmost minimum pair rank."""

    def __init__(self, ranks: list[int]) -> None:
        size = 1
        while size < len(ranks):
            size *= 2
        self.size = size
        # Rank and position in one number: the minimum is the leftmost lowest rank.
        self.shift = size.bit_length()
        keys = [(r << self.shift) | i for i, r in enumerate(ranks)]
        self.tree = tree = [_NO_PAIR << self.shift] * size + keys + [_NO_PAIR << self.shift] * (size - len(ranks))
        for i in range(size - 1, 0, -1):
            a, b = tree[2 * i], tree[2 * i + 1]
            tree[i] = a if a <= b else b

    def lowest(self) -> tuple[int, int]:
        top = self.tree[1]
        return top >> self.shift, top & ((1 << self.shift) - 1)

    def put(self, position: int, rank: int) -> None:
        tree, i = self.tree, position + self.size
        tree[i] = (rank << self.shift) | position
        i //= 2
        while i:
            a, b = tree[2 * i], tree[2 * i + 1]
            least = a if a <= b else b
            if tree[i] == least:
                break
            tree[i] = least
            i //= 2


class ByteBPE:
    """A byte-level BPE tokenizer read from its public file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab = model["vocab"]
        self.byte_id = [0] * 256
        for letter, byte in byte_alphabet().items():
            self.byte_id[byte] = vocab[letter]
        # Pair of ids -> rank of the merge and the id it makes.
        self.merge: dict[int, tuple[int, int]] = {}
        for rank, (a, b) in enumerate(model["merges"]):
            self.merge.setdefault(vocab[a] << 20 | vocab[b], (rank, vocab[a + b]))
        self.cut = regex.compile(PATTERN).findall
        self.known: dict[str, list[int]] = {}

    def piece(self, text: str) -> list[int]:
        """Ids of one piece."""
        ids = [self.byte_id[b] for b in text.encode("utf-8", "surrogatepass")]
        n = len(ids)
        if n < 2:
            return ids
        merge = self.merge
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        none = (_NO_PAIR, 0)
        tree = PairTree([merge.get(ids[i] << 20 | ids[i + 1], none)[0] for i in range(n - 1)])
        while True:
            rank, i = tree.lowest()
            if rank >= _NO_PAIR:
                break
            j = after[i]
            ids[i] = merge[ids[i] << 20 | ids[j]][1]
            ids[j] = -1
            nxt = after[i] = after[j]
            if j < n - 1:
                tree.put(j, _NO_PAIR)
            if nxt < n:
                before[nxt] = i
                tree.put(i, merge.get(ids[i] << 20 | ids[nxt], none)[0])
            else:
                tree.put(i, _NO_PAIR)
            prev = before[i]
            if prev >= 0:
                tree.put(prev, merge.get(ids[prev] << 20 | ids[i], none)[0])
        return [t for t in ids if t >= 0]

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text; null and empty texts give an empty list.

        Nothing in the text is taken for a special token.
        """
        if not text:
            return []
        known, out = self.known, []
        for piece in self.cut(text):
            ids = known.get(piece)
            if ids is None:
                ids = self.piece(piece)
                if len(piece) <= CACHE_CHARS:
                    if len(known) >= CACHE_PIECES:
                        known.clear()
                    known[piece] = ids
            out += ids
        return out


_loaded: dict[str, ByteBPE] = {}


def tokenizer(path: str = TOKENIZER_PATH, name: str = TOKENIZER) -> ByteBPE:
    """The tokenizer, read once per worker."""
    file = f"{path}/{name}.json"
    if file not in _loaded:
        _loaded[file] = ByteBPE(file)
    return _loaded[file]


def _encoder(key: str, text: str, path: str, name: str, counts: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(path, name).encode
        for batch in batches:
            keys, texts = batch.column(key), batch.column(text).to_pylist()
            if counts:
                made = pa.array([len(encode(t)) for t in texts], pa.int32())
                yield pa.RecordBatch.from_arrays([keys, made], names=[key, "n_tokens"])
                continue
            flat: list[int] = []
            ends = [0]
            first = 0
            for i, t in enumerate(texts):
                flat += encode(t)
                ends.append(len(flat))
                # Long texts make early batches, so no batch grows without bound.
                if len(flat) > 4_000_000 or i == len(texts) - 1:
                    ids = pa.ListArray.from_arrays(
                        pa.array(np.array(ends, np.int32)), pa.array(np.array(flat, np.int32))
                    )
                    yield pa.RecordBatch.from_arrays([keys.slice(first, i + 1 - first), ids], names=[key, "ids"])
                    flat, ends, first = [], [0], i + 1

    return run


def encode_texts(
    df: DataFrame, key: str, text: str, path: str = TOKENIZER_PATH, name: str = TOKENIZER
) -> DataFrame:
    """``(key, ids array<int>)`` for each row; one narrow pass, no shuffle.

    Null and empty texts give an empty list, a row of any length its whole ids.
    Repeated rows are encoded each; other columns are left out.
    """
    kind = dict(df.dtypes)[key]
    return arrow_map(df.select(key, text), _encoder(key, text, path, name, False), f"`{key}` {kind}, ids array<int>")


def count_ids(
    df: DataFrame, key: str, text: str, path: str = TOKENIZER_PATH, name: str = TOKENIZER
) -> DataFrame:
    """``(key, n_tokens)`` for each row, by the same encoding."""
    kind = dict(df.dtypes)[key]
    return arrow_map(df.select(key, text), _encoder(key, text, path, name, True), f"`{key}` {kind}, n_tokens int")


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document."""
    return encode_texts(table(spark, sf_dir, "documents"), "doc_id", "text")
