"""One form for text that looks the same (problem 3).

Look-alike classes are the transitive closure, by union-find, of relations over
strings and code points: canonical decomposition, full-width and half-width
forms, font variants, one blank for another, line ends, invisible characters
(alike with nothing), and letters of different scripts that share a shape. The
classes are built for the code points the corpus really has, and the member seen
most often in the corpus represents its class. A multi-pattern automaton then
rewrites each text, longest match first from the left.

Letter case, accents, digits and visible marks are never merged, nor is the number
of blanks or line ends.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotusflow.llm.common import HAS_TEXT, arrow_map, distinct_rows, materialize, table

#: Letters that share the shape of a Latin letter, by that letter.
SAME_SHAPE = {
    "A": "Α А Ꭺ", "B": "Β В Ᏼ", "C": "С Ϲ Ꮯ", "D": "Ꭰ", "E": "Ε Е Ꭼ", "F": "Ϝ", "G": "Ԍ Ꮐ",
    "H": "Η Н Ꮋ", "I": "Ι І Ӏ", "J": "Ј Ꭻ Ϳ", "K": "Κ К Ꮶ", "L": "Ꮮ", "M": "Μ М Ϻ Ꮇ", "N": "Ν",
    "O": "Ο О Օ", "P": "Ρ Р Ꮲ", "Q": "Ԛ", "R": "Ꭱ", "S": "Ѕ Տ Ꮪ", "T": "Τ Т Ꭲ", "U": "Ս", "V": "Ꮩ Ѵ",
    "W": "Ԝ Ꮃ", "X": "Χ Х", "Y": "Υ Ү", "Z": "Ζ Ꮓ",
    "a": "а ɑ", "c": "с ϲ", "d": "ԁ", "e": "е", "g": "ɡ ց", "h": "һ հ", "i": "і", "j": "ј ϳ",
    "n": "ո", "o": "о ο օ", "p": "р", "q": "ԛ գ", "s": "ѕ", "u": "ս", "v": "ѵ",
    "w": "ԝ ѡ", "x": "х", "y": "у ү", "z": "ᴢ",
    "Đ": "Ð Ɖ", "æ": "ӕ", "Æ": "Ӕ", "ə": "ә ǝ",
}

#: Code points that show nothing, besides those of the category Cf.
INVISIBLE = {0x00AD, 0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180B, 0x180C, 0x180D, 0x180E, 0x3164, 0xFFA0,
             *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0)}

#: Kinds of compatibility decomposition that keep the look of a text.
SAME_LOOK = {"<wide>", "<narrow>", "<font>", "<noBreak>", "<isolated>", "<initial>", "<medial>", "<final>"}

_LINE_ENDS = ["\n", "\r\n", "\r", chr(0x85), chr(0x2028)]
_JOINER = chr(0x200D)


class Classes:
    """Union-find over strings; the empty string is the class of invisible characters."""

    def __init__(self) -> None:
        self.parent: dict[str, str] = {}

    def find(self, s: str) -> str:
        self.parent.setdefault(s, s)
        root = s
        while self.parent[root] != root:
            root = self.parent[root]
        while self.parent[s] != root:
            self.parent[s], s = root, self.parent[s]
        return root

    def join(self, a: str, b: str) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)

    def groups(self) -> dict[str, list[str]]:
        made: dict[str, list[str]] = {}
        for s in list(self.parent):
            made.setdefault(self.find(s), []).append(s)
        return made


def _shape_of() -> dict[str, str]:
    return {c: letter for letter, others in SAME_SHAPE.items() for c in others.split()}


def _is_invisible(c: str) -> bool:
    # The format characters of the Arabic block are visible signs.
    return ord(c) in INVISIBLE or (unicodedata.category(c) == "Cf" and not 0x0600 <= ord(c) <= 0x08E2)


def build_classes(frequency: dict[str, int]) -> dict[str, str]:
    """Rewriting rules of a corpus: each string to the representative of its class.

    ``frequency`` counts the code points of the corpus. Classes of letters and marks
    without parts come first: their most frequent code point represents them (the
    smaller one on a tie), and a class with the empty string is represented by it.
    Accented letters and other strings with parts are represented by the
    representatives of their parts, so every right-hand side is in final form.
    """
    shape = _shape_of()
    classes = Classes()
    seen = set(frequency) | set(shape) | set(SAME_SHAPE)
    for c in frequency:
        seen.update(unicodedata.normalize("NFD", c))
    for end in _LINE_ENDS[1:]:
        classes.join(end, "\n")
    for c in sorted(seen):
        classes.find(c)
        if c in shape:
            classes.join(c, shape[c])
        if _is_invisible(c):
            classes.join(c, "")
        elif c == "\t" or (unicodedata.category(c) == "Zs" and c != " "):
            classes.join(c, " ")
        kind, _, points = unicodedata.decomposition(c).partition(" ")
        if kind in SAME_LOOK:
            classes.join(c, "".join(chr(int(p, 16)) for p in points.split()))
    # Strings are alike when their parts are: an accented look-alike letter and the
    # accented letter it looks like meet through their decompositions.
    for c in sorted(seen):
        plain = unicodedata.normalize("NFD", c)
        if plain == c and len(c) == 1 and not unicodedata.combining(c):
            continue
        classes.join(c, plain)
        alike = "".join(map(classes.find, plain))
        classes.join(plain, alike)
        classes.join(alike, unicodedata.normalize("NFC", alike))
    rules: dict[str, str] = {}
    groups = classes.groups()
    final: dict[str, str] = {}

    def represent(root: str) -> str:
        if root not in final:
            members = groups[root]
            parts = [p for p in (unicodedata.normalize("NFD", m) for m in members) if len(p) > 1 and p not in _LINE_ENDS]
            if "" in members:
                final[root] = ""
            elif parts:
                final[root] = unicodedata.normalize("NFC", "".join(represent(classes.find(c)) if c in classes.parent else c for c in min(parts)))
            else:
                single = [m for m in members if len(m) == 1 and unicodedata.normalize("NFD", m) == m]
                final[root] = min(single, key=lambda m: (-frequency.get(m, 0), m))
        return final[root]

    for root, members in groups.items():
        best = represent(root)
        for m in members:
            if m and m != best:
                rules[m] = best
    return rules


class Rewriter:
    """Rewrites texts by an Aho-Corasick automaton over the rules."""

    def __init__(self, rules: dict[str, str]) -> None:
        # Texts are rewritten in decomposed form, so rules are too.
        split = lambda s: unicodedata.normalize("NFD", s)
        self.rules = {a: b for a, b in ((split(a), split(b)) for a, b in rules.items()) if a != b}
        self.automaton = ahocorasick.Automaton()
        for a, b in self.rules.items():
            self.automaton.add_word(a, (len(a), b))
        if self.rules:
            self.automaton.make_automaton()
        heads = {c for a in [*rules, *self.rules] for c in a if c != "\n"}
        marks = "".join(f"{chr(a)}-{chr(b)}" for a, b in ((0x300, 0x36F), (0x1AB0, 0x1AFF), (0x20D0, 0x20FF), (0x3099, 0x309A)))
        plain = {c for b in rules.values() for c in b}
        odd = sorted(c for c in heads if len(unicodedata.normalize("NFD", c)) == 1 and (c in rules or c in self.rules) and c not in plain)
        odd += sorted(c for c in rules if len(c) == 1 and c not in plain)
        #: Texts in composed form without any of these are in their final form already.
        self.suspect = re.compile("[" + marks + "".join(map(re.escape, dict.fromkeys(odd))) + "]").search
        # An emoji sequence keeps its joiners: without them it looks different.
        emoji = "[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in ((0x2600, 0x27BF), (0x1F000, 0x1FAFF))) + "]"
        tail = f"[{chr(0xFE0F)}{chr(0x1F3FB)}-{chr(0x1F3FF)}]?"
        self.emoji = re.compile(f"({emoji}{tail}){_JOINER}(?={emoji})")

    def _rewrite(self, text: str) -> str:
        out, at = [], 0
        for end, (size, new) in self.automaton.iter_long(text):
            start = end - size + 1
            out += (text[at:start], new)
            at = end + 1
        out.append(text[at:])
        return "".join(out)

    def __call__(self, text: str | None) -> str | None:
        """The final form of a text; null stays null."""
        if not text or (not self.suspect(text) and unicodedata.is_normalized("NFC", text)):
            return text
        keep = chr(0xF8FF)
        held = _JOINER in text and self.emoji.search(text) is not None
        if held:
            text = self.emoji.sub(rf"\1{keep}", text)
        # Removing an invisible character can bring a letter and its accent
        # together, so repeat until nothing changes.
        while True:
            new = self._rewrite(unicodedata.normalize("NFD", text)) if self.rules else text
            new = unicodedata.normalize("NFD", new)
            if new == unicodedata.normalize("NFD", text):
                break
            text = new
        if held:
            text = text.replace(keep, _JOINER)
        return unicodedata.normalize("NFC", text)


def _count_points(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(0x110000, np.int64)
    for batch in batches:
        texts = [t for t in batch.column(0).to_pylist() if t]
        for i in range(0, len(texts), 512):
            points = np.frombuffer("".join(texts[i : i + 512]).encode("utf-32-le", "surrogatepass"), np.uint32)
            counted = np.bincount(points)
            total[: len(counted)] += counted
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], names=["point", "n"])


def point_frequency(texts: DataFrame) -> dict[str, int]:
    """How often each code point occurs in the only column of ``texts``.

    Counted per partition first; what reaches the driver is at most one row per
    code point of Unicode.
    """
    counted = arrow_map(texts, _count_points, "point int, n long").groupBy("point").agg(F.sum("n").alias("n"))
    return {chr(r["point"]): r["n"] for r in counted.collect()}


def unify_texts(df: DataFrame, text: str, rules: dict[str, str], into: str = "unified") -> DataFrame:
    """Add a column with the final form of ``text``; nulls stay null, empty texts empty.

    A column ``into`` that exists already is replaced.
    """
    rest = [c for c in df.columns if c != into]
    kinds = dict(df.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rewrite = Rewriter(rules)
        for batch in batches:
            made = pa.array([rewrite(t) for t in batch.column(text).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), made], names=[*rest, into])

    return arrow_map(df.select(*rest), run, ", ".join([f"`{c}` {kinds[c]}" for c in rest] + [f"`{into}` string"]))


def _digests(rules: dict[str, str]):
    def digest(text: str) -> bytes:
        return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rewrite = Rewriter(rules)
        for batch in batches:
            looks, exact = [], []
            for t in batch.column("content").to_pylist():
                exact.append(digest(t))
                new = rewrite(t)
                looks.append(exact[-1] if new is t or new == t else digest(new))
            yield pa.RecordBatch.from_arrays(
                [batch.column("tbl"), batch.column("id"), pa.array(looks, pa.binary()), pa.array(exact, pa.binary())],
                names=["tbl", "id", "looks", "exact"],
            )

    return run


#: Parts into which the rows of one form are dealt when they meet its summary, and members of a class per task of its pairs.
FORM_PARTS, CLASS_ROWS = 16, 10_000


def lookalike_members(texts: DataFrame, rules: dict[str, str]) -> DataFrame:
    """``(tbl, id, looks, exact, members)`` of the texts that look like a different string.

    Takes ``(tbl, id, content)``. Every text is rewritten once; the digests of its
    final form and of itself are written to the shared folder, and everything after
    works on those 128-bit digests, so no text is shuffled. Only forms with at
    least two different strings go on. ``members`` counts the rows of the class,
    repeated ones included. Null texts, texts without a letter or digit and null ids
    take no part; repeated rows count once.
    """
    wanted = texts.where(F.col("content").rlike(HAS_TEXT) & F.col("id").isNotNull()).select("tbl", "id", "content")
    keyed = materialize(arrow_map(wanted, _digests(rules), "tbl string, id string, looks binary, exact binary"))
    mixed = (
        keyed.groupBy("tbl", "looks")
        .agg(F.min("exact").alias("low"), F.max("exact").alias("high"), F.count(F.lit(1)).alias("members"))
        .where("low <> high")
        .select("tbl", "looks", "members", F.explode(F.sequence(F.lit(0), F.lit(FORM_PARTS - 1))).alias("part"))
    )
    dealt = keyed.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(FORM_PARTS)).cast("int"))
    return dealt.join(mixed, ["tbl", "looks", "part"]).select("tbl", "id", "looks", "exact", "members").distinct()


def lookalike_classes(texts: DataFrame, rules: dict[str, str]) -> DataFrame:
    """``(tbl, id, class_id, spelling_id, links)``: one row per text that looks like another string.

    Texts of one class look alike; those of one spelling are the same string. ``links``
    counts the texts of the class with another spelling. Its size follows the number
    of texts, however large a class is.
    """
    members = lookalike_members(texts, rules)
    spelled = members.groupBy("tbl", "looks", "exact").agg(F.count(F.lit(1)).alias("same"))
    sized = spelled.groupBy("tbl", "looks").agg(F.sum("same").alias("all"))
    links = spelled.join(sized, ["tbl", "looks"]).select("tbl", "looks", "exact", (F.col("all") - F.col("same")).alias("links"))
    return members.join(links, ["tbl", "looks", "exact"]).select(
        "tbl", "id", F.lower(F.hex("looks")).alias("class_id"), F.lower(F.hex("exact")).alias("spelling_id"), "links"
    )


def lookalike_pairs(texts: DataFrame, rules: dict[str, str]) -> DataFrame:
    """Pairs ``(tbl, id_a, id_b)``, id_a < id_b, of texts that look alike but differ.

    Copies of one string are never paired with each other. A class of many rows is
    dealt to one task for every ``CLASS_ROWS`` of them; the pairs themselves are as many
    as there are. See ``lookalike_members`` for what takes part.
    """
    kept = lookalike_members(texts, rules).withColumn("parts", F.ceil(F.col("members") / CLASS_ROWS).cast("int"))
    a = kept.select("tbl", "looks", F.col("id").alias("id_a"), F.col("exact").alias("exact_a"), F.expr("cast(pmod(xxhash64(id), parts) as int)").alias("part"))
    b = kept.select("tbl", "looks", F.col("id").alias("id_b"), F.col("exact").alias("exact_b"), F.explode(F.expr("sequence(0, parts - 1)")).alias("part"))
    return a.join(b, ["tbl", "looks", "part"]).where("id_a < id_b and exact_a <> exact_b").select("tbl", "id_a", "id_b")


def lookalike_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts of the three tables as ``(tbl, id, content)``."""
    parts = [
        ("raw_documents", "document_id", "raw_content"),
        ("normalized_documents", "document_id", "content"),
        ("chat_turns", "id", "question"),
    ]
    made = [
        table(spark, sf_dir, name).select(F.lit(name).alias("tbl"), F.col(key).alias("id"), F.col(text).alias("content"))
        for name, key, text in parts
    ]
    return made[0].unionByName(made[1]).unionByName(made[2])


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of rows that look the same to a reader but are different strings."""
    texts = lookalike_texts(spark, sf_dir)
    rules = build_classes(point_frequency(texts.select("content")))
    return lookalike_pairs(texts, rules).distinct()


def p3_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The classes of those rows, with the number of links of each row."""
    texts = lookalike_texts(spark, sf_dir)
    return lookalike_classes(texts, build_classes(point_frequency(texts.select("content"))))


def p3_unified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text in its final form; repeated rows count once, and no row whose key occurs once is moved."""
    texts = lookalike_texts(spark, sf_dir)
    rules = build_classes(point_frequency(texts.select("content")))
    texts = distinct_rows(texts, ["tbl", "id"])
    return unify_texts(texts, "content", rules).select("tbl", "id", F.col("unified").alias("content"))
