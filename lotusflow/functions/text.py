"""Text expressions; all but the compatibility normalization stay in the JVM.

Null texts stay null unless a docstring says otherwise.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lotusflow.functions.fixed import MAGIC_WORDS
from lotusflow.runtime import ship

#: White space as Python counts it: Unicode blanks and the four separators.
BLANK = r"[\s\x1c-\x1f]"
NOT_BLANK = r"[^\s\x1c-\x1f]"

#: Words of the sparse index: letters, digits, underscore and the Latin blocks.
TERM = r"[\p{L}\p{N}_\x{C0}-\x{24F}\x{1EA0}-\x{1EFF}]+"


def strip(text: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(text, rf"(?U)\A{BLANK}+|{BLANK}+\z", "")


@F.pandas_udf(StringType())
def _compatible(texts: pd.Series) -> pd.Series:
    form = "NFKC"
    return texts.map(lambda t: t if t is None or t.isascii() or unicodedata.is_normalized(form, t) else unicodedata.normalize(form, t))


def normalize_text(text: Column) -> Column:
    """Compatibility form, LF line ends, single blanks, at most one empty line; null gives an empty text."""
    ship(SparkSession.active())
    t = F.regexp_replace(_compatible(F.coalesce(text, F.lit(""))), "\r\n?", "\n")
    t = F.regexp_replace(F.regexp_replace(t, "[ \t]+", " "), "\n{3,}", "\n\n")
    return strip(t)


def remove_templates(text: Column, passes: int = 30) -> Column:
    """Double-brace templates to a blank, from the inside out, at most ``passes`` levels deep."""
    step = lambda t: F.regexp_replace(t, r"\{\{[^{}]*?\}\}", " ")
    nested = F.aggregate(F.sequence(F.lit(1), F.lit(passes)), text, lambda t, _: step(t))
    return F.when(F.contains(text, F.lit("{{")), nested).otherwise(text)


def remove_references(text: Column) -> Column:
    """Reference elements with their contents to a blank."""
    return F.regexp_replace(text, "(?is)<ref[^>]*>.*?</ref>", " ")


def remove_tags(text: Column) -> Column:
    """Markup tags to a blank; their contents stay."""
    return F.regexp_replace(text, "<[^>]+>", " ")


def unwrap_links(text: Column) -> Column:
    """Double-bracket links to their label, or to their target without one."""
    return F.regexp_replace(text, r"(?U)\[\[(?=[^\[\]])(?:[^\[\]|]*\|)?\s*([^\[\]]*?)\s*\]\]", "$1")


def remove_emphasis(text: Column) -> Column:
    """Without the quotes of bold and italic."""
    return F.regexp_replace(text, "'''|''", "")


def remove_magic_words(text: Column) -> Column:
    """Layout switches to a blank."""
    return F.regexp_replace(text, "|".join(MAGIC_WORDS), " ")


def clean_text(text: Column) -> Column:
    """All markup removed, blanks and empty lines collapsed."""
    t = remove_emphasis(unwrap_links(remove_tags(remove_references(remove_templates(text)))))
    t = F.regexp_replace(F.regexp_replace(remove_magic_words(t), "[ \t]+", " "), "\n{3,}", "\n\n")
    return strip(t)


def checksum(text: Column) -> Column:
    """SHA-256 of the UTF-8 text in hex."""
    return F.sha2(text.cast("binary"), 256)


def token_count(text: Column) -> Column:
    """Runs of characters that are not white space; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(f"(?U){NOT_BLANK}+")), F.lit(0)).cast("int")


def terms(text: Column) -> Column:
    """Lower-case words in order, repeats kept; null gives none."""
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TERM), F.lit(0)), F.lower)


def normalize_query(text: Column) -> Column:
    """Lower case, words joined by one blank."""
    return F.trim(F.regexp_replace(F.lower(text), rf"(?U){BLANK}+", " "))


def estimated_tokens(text: Column, divisor: int = 3) -> Column:
    """Characters over ``divisor``, rounded up; null counts 0."""
    return F.coalesce(F.ceil(F.length(text) / F.lit(divisor)), F.lit(0)).cast("int")


def turn_tokens(question: Column, answer: Column, divisor: int = 3) -> Column:
    """Estimated tokens of a question and its answer."""
    return estimated_tokens(question, divisor) + estimated_tokens(answer, divisor)


def cache_key(model: Column, version: Column, query: Column) -> Column:
    """Key of a rewritten query."""
    return F.sha2(F.concat_ws("|", model, version, query), 256)


def is_session_id(value: Column) -> Column:
    """A well-formed session id."""
    return value.rlike(r"\A[A-Za-z0-9_-]{8,64}\z")


def is_question(value: Column) -> Column:
    """A question of a permitted length."""
    return F.length(value).between(1, 500)


def citations(answer: Column) -> Column:
    """Distinct citation numbers of an answer, ordered as strings."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.coalesce(answer, F.lit("")), F.lit(r"\[(\d+)\]"), F.lit(1))))


def shorten(text: Column, limit: int = 300) -> Column:
    """The first ``limit`` characters and three dots, if longer; null gives an empty text."""
    t = F.coalesce(text, F.lit(""))
    return F.when(F.length(t) > limit, F.concat(F.substring(t, 1, limit), F.lit("..."))).otherwise(t)


def suggestion_lines(text: Column, limit: int = 4) -> Column:
    """The first lines of a list without their numbering."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(strip(x), r"^[0-9.\-) ]+", ""))
    return F.slice(F.filter(lines, lambda x: F.length(x) > 0), 1, limit)


def fenced_json(text: Column) -> Column:
    """The text inside a code fence, or the text itself."""
    return strip(F.regexp_replace(strip(text), r"(?s)\A```[^\n]*\n|\n?```\s*\z", ""))


def iso_time(value: Column) -> Column:
    """A timestamp with microseconds and Z."""
    return F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def parse_iso(text: Column) -> Column:
    """The timestamp of such a text; anything else gives null."""
    return F.try_to_timestamp(text)


@F.pandas_udf(StringType())
def _strip_echo(questions: pd.Series, answers: pd.Series) -> pd.Series:
    return pd.Series([_without_echo(q, a) for q, a in zip(questions, answers, strict=True)], dtype=object)


def strip_echo(question: Column, answer: Column) -> Column:
    """An answer without the question repeated at its start.

    The echo goes only if something other than a letter or digit follows it and at
    least five characters remain after the separator.
    """
    ship(SparkSession.active())
    return _strip_echo(question, answer)


def _without_echo(question: str | None, answer: str | None) -> str | None:
    if not question or not answer:
        return answer
    wanted = " ".join(question.lower().split()).rstrip("?!.,;:").strip()
    body = answer.lstrip()
    if not wanted or not " ".join(body.lower().split()).startswith(wanted):
        return answer
    # Consume the letters of the echo; blanks may differ in kind and number.
    letters = [c for c in wanted if not c.isspace()]
    at = used = 0
    lowered = body.lower()
    while used < len(letters) and at < len(lowered):
        if not lowered[at].isspace():
            if lowered[at] != letters[used]:
                return answer
            used += 1
        at += 1
    follows = body[at:].lstrip() if used == len(letters) else ""
    if not follows or follows[0].isalpha() or follows[0].isdigit():
        return answer
    rest = body[at:].lstrip(".!?,;:\n\r\t ").lstrip()
    return rest if len(rest.strip()) >= 5 else answer
