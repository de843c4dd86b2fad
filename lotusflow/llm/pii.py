"""Personal information inside free text (problem 8).

A semi-Markov conditional random field. Shapes propose candidate segments (email,
phone, identity number, address, name), more than can be right; whole-segment features
and the words around them score each candidate, and a dynamic program over the text
picks the best set of segments that do not overlap, deciding boundaries and types
together. Text outside the segments scores nothing.

A feature depends on the shape of the segment, on what stands before it or on what
follows it. Training names features by strings; in use the weights of each shape,
left side and right side met are summed once and kept, so a candidate costs three
look-ups.

The field is trained at run time on sentences filled from the patterns in
``pii_phrases``, which are general knowledge, and then on at most ``SAMPLE_DOCS``
documents of the corpus that it labels itself: there only segments it is sure of count
as right and only those it rejects as clearly count as wrong, so it learns which words
of this corpus stand around names. Values are reported exactly as they stand in the
text, decomposed accents and full-width digits included.
"""

from __future__ import annotations

import bisect
import math
import random
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotusflow.llm import pii_phrases as words
from lotusflow.llm.answers import fold
from lotusflow.llm.common import arrow_map, spread, table

KINDS = ("email", "phone", "id_number", "address", "name")

#: Words up to which every part of a run of capitalized words is a candidate name; beyond, the whole run is one.
NAME_WORDS = 6

#: Digits of a number at most (the longest international number).
NUMBER_DIGITS = 15

#: Training sentences made from each pattern, and passes over them.
COPIES, EPOCHS = 40, 4

#: Documents the field labels itself at most, the score beyond which a label counts, rounds of labelling, and passes over them in a round.
SAMPLE_DOCS, SURE, OWN_ROUNDS, OWN_EPOCHS = 1_500, 2.0, 3, 1

_DIGIT = f"[0-9{chr(0xFF10)}-{chr(0xFF19)}]"
_SPACE = "[ " + "".join(map(chr, (0xA0, 0x2007, 0x2009, 0x202F, 0x3000))) + "]"
_TOKEN = re.compile(r"[^\W\d_]+(?:['’\-][^\W\d_]+)*|\d+|[^\w\s]|_|\n")
_NUMBER = re.compile(
    rf"(?:\(?[+＋]?{_DIGIT}+\)?)(?:(?:{_SPACE}|[.\-‐‑–]|{_SPACE}\(?|-\()?\(?{_DIGIT}+\)?)*"
)
_GROUP = re.compile(f"{_DIGIT}+")
_PASSPORT = re.compile(rf"(?<![\w])[A-Z]{_DIGIT}{{7}}(?!\w)")
_AT = r"(?:[@＠]|\s?[\(\[\{](?:at|a|a còng|@)[\)\]\}]\s?)"
_DOT_WORD = r"(?:\s?[\(\[\{](?:dot|chấm|\.)[\)\]\}]\s?|\s(?:dot|chấm)\s)"
_DOT = rf"(?:\.|{_DOT_WORD})"
_USER, _LABEL = r"(?<![\w.+\-])[A-Za-z0-9][\w.+\-]*", r"[A-Za-z0-9][A-Za-z0-9\-]*"
# A bare "at" counts only where the dots are written out too.
_EMAIL = re.compile(
    rf"{_USER}(?:{_AT}{_LABEL}(?:{_DOT}{_LABEL})*{_DOT}[A-Za-z]{{2,}}|\s(?:at|a còng)\s{_LABEL}(?:{_DOT_WORD}{_LABEL})*{_DOT_WORD}[A-Za-z]{{2,}})(?![\w@])"
)
#: Without one of these a text has no email address.
_AT_HINT = re.compile(r"[@＠]|[\s(\[{](?:at|a|a còng)[\s)\]}]")
_LEVELS = (
    r"đường|phố|ngõ|ngách|hẻm|kiệt|thôn|ấp|xóm|bản|tổ|khu phố|khu|phường|quận|thành phố|thị xã|thị trấn|xã|huyện|tỉnh"
    r"|Đường|Phố|Phường|Quận|Thành phố|Xã|Huyện|Tỉnh|P\.|Q\.|TP\.|Tp\.|H\.|T\.|Đ\.|đ\.|X\."
    r"|duong|pho|ngo|ngach|hem|thon|phuong|quan|thanh pho|xa|huyen"
)
_UPPER = "".join(c for c in map(chr, range(0x41, 0x1F00)) if c.isupper())
_CAP = rf"[{_UPPER}][^\W\d_]*"
_HOUSE = re.compile(rf"(?<![\w/.,\-])\d{{1,4}}[A-Z]?(?:/\d{{1,4}}[A-Z]?)*(?=,? (?:{_LEVELS})\s?[\w])")
_PART = re.compile(rf",? (?:{_LEVELS})\s?(?:\d+[A-Z]?(?:/\d+[A-Z]?)*(?!\w)|(?={_CAP}))")
_ROADS = "Street|Road|Lane|Alley|Avenue|Boulevard|St\\.|Rd\\.|street|road|lane|alley"
_WARDS = "Ward|District|City|Province|Commune|Town|ward|district|city"
_ENGLISH = re.compile(rf"(?<![\w/.,\-])\d{{1,4}}[A-Z]?(?:/\d{{1,4}}[A-Z]?)* {_CAP}(?: {_CAP}){{0,3}}? (?:{_ROADS})(?!\w)")
_ENGLISH_PART = re.compile(rf", (?:{_CAP}(?: {_CAP}){{0,2}}? (?:{_WARDS})(?!\w)|(?:Ward|District) \d+)")
_CAP_WORD = re.compile(rf" ({_CAP})")
#: The first word of a place, which may stand right behind its kind (P.5, Q. Name).
_FIRST_CAP = re.compile(rf"\s?({_CAP})")
_BARE_PART = re.compile(rf", (?={_CAP} {_CAP})")
#: A character with the combining marks that follow it.
_CLUSTER = re.compile("(?s).[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in ((0x300, 0x36F), (0x3099, 0x309A))) + "]*")
#: A house number before a street named without its kind.
_STREET = re.compile(rf"(?<![\w/.,\-])\d{{1,4}}[A-Z]?(?:/\d{{1,4}}[A-Z]?)*(?= {_CAP})")
_TITLES = {fold(t).strip(".") for t in words.TITLES}
_LOWER_SURNAMES = {s.lower() for s in words.SURNAMES}


def _both(some: list[str]) -> frozenset[str]:
    """Words as they are written, and without accents, for texts written so."""
    return frozenset(x for w in some for x in (w.lower(), fold(w)))


_SURNAMES, _GIVEN, _MIDDLE = _both(words.SURNAMES), _both(words.GIVEN), _both(words.MIDDLE)
_FOREIGN, _CITY = _both(words.FOREIGN_FIRST), _both(words.CITIES)
#: Classes of the words beside a segment and at its head; terms of several words count by their last two. A word with
#: accents counts only as it is written.
_CLASS: dict[str, str] = {}
for _name, _list in (
    ("title", [*words.TITLES, "bạn"]), ("place", words.PLACE_KINDS), ("street", words.STREET_KINDS), ("firm", words.FIRM_KINDS),
    ("place", "street road lane avenue ward district city lake river mountain island bay beach park bridge market village museum".split()),
    ("firm", "company hotel restaurant school hospital bank shop university group festival airlines".split()),
    ("by", "by của do bởi cùng gặp gọi cho hỏi nhờ tên gửi contact from to ask call meet thanks par von por de".split()),
    ("in", "ở tại tới đến từ ra lên về qua đi in at near thăm ghé quanh khu vùng tỉnh với for".split()),
    ("says", "viết nói kể đã đưa dẫn chụp said wrote was will took showed who has told".split()),
    ("role", "hướng dẫn viên|nhân viên|diễn viên|giáo viên|sinh viên|tài xế|lái xe|lễ tân|khách|chủ quán|chủ nhà|đầu bếp|bác sĩ|nhạc sĩ|giám đốc|nghệ nhân|trưởng đoàn|trưởng phòng|đội trưởng|chủ thuyền|tác giả|trưởng nhóm|guide|driver|host|hostess|guest|chef|manager|doctor|author|owner|captain|passenger|teacher".split("|")),
    ("code", "mã|mã số|mã đơn|đơn hàng|hóa đơn|số vé|vé|lô|lô hàng|sê-ri|seri|serial|series|order|invoice|ticket|code|tracking|isbn|reference|lot|account|tài khoản|vận đơn|số hiệu|mã thuế|tham chiếu".split("|")),
    ("call", "điện thoại|đt|sđt|số máy|máy bàn|di động|zalo|phone|tel|hotline|mobile|nhắn|nhắn tin|telephone|whatsapp|viber|liên lạc|liên hệ|gọi số".split("|")),
    ("paper", "cccd|cmnd|căn cước|chứng minh|công dân|chứng minh thư|nhân dân|hộ chiếu|passport|citizen|id|identity".split("|")),
):
    for _w in _list:
        for _x in _both([" ".join(_w.split()[-2:]).strip(".")]):
            _CLASS.setdefault(_x, _name)


def _class(word: str, before: str = "") -> str:
    return _CLASS.get(f"{before} {word}") or _CLASS.get(word, "-")


_DASH = re.compile(f"[{chr(0x2010)}-{chr(0x2015)}]")


class Text:
    """A text in composed form with the way back to its own characters."""

    def __init__(self, text: str) -> None:
        self.raw = text
        self.found: list[Candidate] | None = None
        self.back: list[int] | None = None
        if unicodedata.is_normalized("NFC", text):
            self.text = text
        else:
            out, back = [], []
            for m in _CLUSTER.finditer(text):
                c = unicodedata.normalize("NFC", m.group())
                out.append(c)
                back += [m.start()] * len(c)
            self.text, self.back = "".join(out), [*back, len(text)]
        # Dashes of every kind are one, character for character.
        if _DASH.search(self.text):
            self.text = _DASH.sub("-", self.text)
        self.tokens = [(m.group(), *m.span()) for m in _TOKEN.finditer(self.text)]
        self.starts = [s for _, s, _ in self.tokens]

    def value(self, start: int, end: int) -> str:
        if self.back is None:
            return self.raw[start:end]
        return self.raw[self.back[start] : self.back[end]]


def _around(doc: Text, start: int, end: int) -> tuple[int, int]:
    """Index of the first token at or after start, and of the first at or after end."""
    return bisect.bisect_left(doc.starts, start), bisect.bisect_left(doc.starts, end)


_folded: dict[str, str] = {}


def _fold(token: str) -> str:
    made = _folded.get(token)
    if made is None:
        if len(_folded) > 200_000:
            _folded.clear()
        made = _folded[token] = fold(token)
    return made


def _left(doc: Text, a: int) -> tuple[str, ...]:
    """The words before token ``a``: three next to it, then up to four words of its sentence."""
    t = doc.tokens
    near = []
    for i in range(a - 1, max(-1, a - 7), -1):
        w = t[i][0]
        if w in ".!?\n;" and (i < a - 2 or w == ";"):
            break
        if w[0].isalpha():
            near.append(w.lower())
            if len(near) == 4:
                break
    return (*(t[i][0].lower() if i >= 0 else "^" for i in (a - 1, a - 2, a - 3)), *near)


_CONTACT = re.compile(rf"[@＠]|\bat\b|{_DIGIT}{{3}}")


def _right(doc: Text, b: int) -> tuple[str, ...]:
    """The two words from token ``b`` on, whether an address or number follows on the line, and how the next name or place begins."""
    t = doc.tokens
    if b >= len(t):
        return ("$", "$", "-", "-")
    ahead = doc.text[t[b][1] : t[b][1] + 30].split("\n")[0]
    found = _CONTACT.search(ahead)
    contact = "-" if not found else "n" if found.group()[0].isdigit() else "a"
    head = next((_CLASS.get(w.lower(), "+") for w, _, _ in t[b : b + 3] if w[0].isupper()), "-")
    return (t[b][0].lower(), t[b + 1][0].lower() if b + 1 < len(t) else "$", contact, head)


def left_features(key: tuple[str, ...]) -> list[str]:
    """Features of what stands before a segment."""
    one, two, three, *near = key
    classes = [_class(one, two), _class(two, three), _class(three)]
    kinds = "".join(sorted({_class(w, v) for w, v in zip(near, [*near[1:], ""], strict=False)}))
    one, two, *near = (_fold(w) for w in (one, two, *near))
    return [
        f"l1={one}", f"l2={two} {one}", f"c1={classes[0]}", f"c2={classes[1]}{classes[0]}", f"c3={classes[2]}{classes[1]}{classes[0]}",
        *(f"n={w}" for w in near), f"near={kinds}",
    ]


def right_features(key: tuple[str, ...]) -> list[str]:
    """Features of what follows a segment."""
    one, two, contact, head = key
    mark = one if not one[:1].isalnum() else "w" if one[:1].isalpha() else "d"
    return [f"r1={_fold(one)}", f"r2={_fold(one)} {_fold(two)}", f"d1={_CLASS.get(one, '-')}", f"m={mark}", f"m={mark} contact={contact}", f"head={head}"]


#: A candidate: start, end, kind, shape (its features as a tuple), and the words around it.
Candidate = tuple[int, int, str, tuple, tuple, tuple]


def _number_candidates(doc: Text) -> Iterator[tuple[int, int, str, tuple]]:
    text = doc.text
    for run in _NUMBER.finditer(text):
        if run.end() - run.start() < 7:
            continue
        groups = [m.span() for m in _GROUP.finditer(text, run.start(), run.end())]
        for i in range(len(groups)):
            digits = 0
            for j in range(i, len(groups)):
                digits += groups[j][1] - groups[j][0]
                if digits > NUMBER_DIGITS:
                    break
                if digits < 8:
                    continue
                start, end = groups[i][0], groups[j][1]
                if text[end : end + 1] == ")" and "(" in text[max(run.start(), start - 2) : end]:
                    end += 1
                while start > run.start() and text[start - 1] in "+＋(":
                    start -= 1
                if text[start] == "(" and ")" not in text[start:end]:
                    continue
                before, after = text[start - 1 : start], text[end : end + 1]
                if before.isalnum() or after.isalnum() or (before and before in "@/_"):
                    continue
                value = unicodedata.normalize("NFKC", text[start:end])
                shape = re.sub(r"\d+", lambda m: str(len(m.group())), value)
                lead = re.match(r"[(+]*\d{0,2}", value).group()
                sep = "".join(sorted(set(re.sub(r"[\d+()]", "", value))))
                whole = (i == 0) + 2 * (j == len(groups) - 1)
                joined = text[end : end + 2]
                tail = "d" if re.match(rf"[.,\-/]{_DIGIT}", joined) else ""
                head = "d" if re.match(rf"{_DIGIT}[.,\-/]", text[max(0, start - 2) : start]) else ""
                basic = (f"n={digits}", f"lead={lead[:1]}", f"n={digits} lead={lead[:1]}", f"lead2={lead}", f"s={shape}", f"sep={sep}", f"w={whole}", f"j={head}|{tail}", f"n={digits} w={whole}")
                yield start, end, "phone", basic
                if digits in (9, 12) and value[0].isdigit():
                    yield start, end, "id_number", basic
    for m in _PASSPORT.finditer(text):
        yield m.start(), m.end(), "id_number", ("letter",)


def _next_of(text: str, end: int, part: re.Pattern) -> str:
    """What stands behind a part of an address."""
    if re.match(rf"\s{_CAP}", text[end : end + 3]):
        return "cap"
    return "part" if part.match(text, end) or _BARE_PART.match(text, end) else text[end : end + 2][:1]


def _address_candidates(doc: Text) -> Iterator[tuple[int, int, str, tuple]]:
    text = doc.text
    for first, style in ((_HOUSE, "kind"), (_STREET, "bare")):
        for house in first.finditer(text):
            at, parts, ends = house.end(), [], []
            while True:
                m = _PART.match(text, at)
                bare = None if m else _BARE_PART.match(text, at)
                if style == "bare" and not parts:
                    at, level = at + 1, "street"
                elif m or bare:
                    at = (m or bare).end()
                    level = "bare" if bare else _fold(re.sub(r"[\d/]+[A-Z]?|[, ]", "", m.group()))
                else:
                    break
                if text[at - 1].isdigit() or (text[at - 1].isupper() and text[at - 2 : at - 1].isdigit()):
                    parts.append(level)
                    ends.append((at, list(parts), 0, False))
                    continue
                n, begin = 0, at
                while w := (_CAP_WORD if n else _FIRST_CAP).match(text, at):
                    at, n = w.end(), n + 1
                    ends.append((at, [*parts, level], n, text[begin:at].strip().lower() in _CITY))
                if n == 0:
                    break
                parts.append(level)
            for end, names, n, city in ends:
                kind, size = _next_of(text, end, _PART), min(len(names), 5)
                # A street without its kind is an address only with a place behind it.
                if style == "bare" and len(names) < 2:
                    continue
                last, n = names[-1], min(n, 5)
                yield house.start(), end, "address", (
                    f"{style}", f"{style} parts={size}", f"last={last}", f"first={names[0]}", f"capn={n}", f"next={kind}", f"last={last} next={kind}",
                    f"capn={n} next={kind}", f"city={city}", f"city={city} next={kind}", f"{style} city={city}", f"levels={sum(x not in ('bare', 'street') for x in names) > 0} {style}",
                )
    for house in _ENGLISH.finditer(text):
        at, parts = house.end(), ["road"]
        ends = [(at, 1, "road")]
        while True:
            m = _ENGLISH_PART.match(text, at)
            bare = None if m else _BARE_PART.match(text, at)
            if m:
                at = m.end()
                parts.append("ward")
                ends.append((at, len(parts), "ward"))
            elif bare:
                at, n = bare.end(), 0
                parts.append("bare")
                while w := _CAP_WORD.match(text, at):
                    at, n = w.end(), n + 1
                    ends.append((at, len(parts), f"bare{min(n, 4)}"))
            else:
                break
        for end, size, last in ends:
            kind = _next_of(text, end, _ENGLISH_PART)
            yield house.start(), end, "address", (f"english={min(size, 4)}", f"last={last}", f"next={kind}", f"last={last} next={kind}")


def _known(word: str) -> str:
    return "m" if word in _MIDDLE else "s" if word in _SURNAMES else "g" if word in _GIVEN else "f" if word in _FOREIGN else "-"


#: What is known of a word, kept per worker: capital, in capitals, Vietnamese by its letters, ASCII, its lists at the head and inside, its class.
_words: dict[str, tuple | None] = {}


def _word(token: str) -> tuple | None:
    made = _words.get(token, 0)
    if made == 0:
        if len(_words) > 200_000:
            _words.clear()
        made = None
        if token[0].isalpha() and not any(ord(c) > 0x2000 for c in token if c != "’"):
            low = token.lower()
            made = (
                token[0].isupper(), token.isupper() and len(token) > 1, len(token) <= 7 and token.isalpha() and not re.search("[fjwzFJWZ]", token), token.isascii(),
                "s" if low in _SURNAMES else "f" if low in _FOREIGN else "-", _known(low), _CLASS.get(low, "-"), low, token in _LOWER_SURNAMES,
            )
        _words[token] = made
    return made


def _name_shape(head: tuple, last: tuple, middle: str, size: int, flags: tuple) -> tuple:
    """The features of a run of words as a name; made once for each different shape."""
    lower, caps, native, latin, left, right, titled, opening, city = flags
    first, kind, low = head[4], head[6], head[7]
    style = "lower" if lower else "upper" if caps == size else "title" if caps == 0 else "mixed"
    fl = f"{first}{middle}{last[5]}"
    return (
        f"size={size}", f"fl={fl}", f"first={first} size={size}", f"style={style}", f"style={style} fl={fl}", f"edge={left}{right}",
        f"native={native}{latin}", f"native={native} size={size}", f"open={opening}", f"open={opening} first={first}", f"titled={titled}", f"titled={titled} lower={lower}",
        f"city={city}", f"w0={kind}", f"w0={kind} fl={fl}", f"h={low}", f"wl={last[6]}", f"edge={left}{right} first={first}",
    )


_shapes: dict[tuple, tuple] = {}


def _name_candidates(doc: Text) -> Iterator[tuple[int, int, str, tuple]]:
    t, text = doc.tokens, doc.text
    n = len(t)
    known = [_word(w) for w, _, _ in t]
    # Whether a word stands one blank behind the word before it.
    near = [False] * (n + 1)
    for i in range(1, n):
        s = t[i][1]
        near[i] = s - t[i - 1][2] == 1 and known[i] is not None and known[i - 1] is not None and text[s - 1] != "\n"
    for i in range(n - 1):
        head = known[i]
        if head is None or not near[i + 1] or not (head[0] or head[8]):
            continue
        lower = not head[0]
        if known[i + 1][0] == lower:
            continue
        before = t[i - 1][0] if i else "^"
        titled = i > 0 and (_fold(before) in _TITLES or (before == "." and i > 1 and _fold(t[i - 2][0]) in _TITLES))
        # A name may be written in lower case, family name first.
        if lower and near[i] and before in _LOWER_SURNAMES and not titled:
            continue
        left = near[i] and known[i - 1][0]
        opening = i == 0 or before in ".!?\n#:"
        end = i + 1
        while end + 1 < n and near[end + 1] and known[end + 1][0] != lower and not (lower and end - i == 4):
            end += 1
        caps, native, latin = int(head[1]), head[2], head[3]
        for j in range(i + 1, end + 1):
            word, size = known[j], j - i + 1
            caps += word[1]
            native, latin = native and word[2], latin and word[3]
            if size > NAME_WORDS and j < end:
                continue
            right = j < end or (not lower and near[j + 1] and known[j + 1][0])
            city = size < 4 and " ".join(w[7] for w in known[i : j + 1]) in _CITY
            middle = "" if size < 3 else known[i + 1][5]
            shown = min(size, NAME_WORDS + 1)
            flags = (lower, shown if caps == size else min(caps, 1), native, latin, left, right, titled, opening, city)
            key = (head[4], head[6], head[7], word[5], word[6], middle, shown, flags)
            shape = _shapes.get(key)
            if shape is None:
                if len(_shapes) > 200_000:
                    _shapes.clear()
                shape = _shapes[key] = _name_shape(head, word, middle, shown, flags)
            yield t[i][1], t[j][2], "name", shape


def candidates(doc: Text) -> list[Candidate]:
    """Candidate segments of a text, looked for once."""
    if doc.found is not None:
        return doc.found
    found = []
    for m in _EMAIL.finditer(doc.text) if _AT_HINT.search(doc.text) else ():
        value = m.group()
        form = "sign" if re.search("[@＠]", value) else "word"
        found.append((m.start(), m.end(), "email", (f"form={form}", f"space={' ' in value}")))
    for some in (_number_candidates(doc), _address_candidates(doc), _name_candidates(doc)):
        found += some
    lefts: dict[int, tuple] = {}
    rights: dict[int, tuple] = {}
    made = []
    for start, end, kind, shape in found:
        if start not in lefts:
            lefts[start] = _left(doc, bisect.bisect_left(doc.starts, start))
        if end not in rights:
            rights[end] = _right(doc, bisect.bisect_left(doc.starts, end))
        made.append((start, end, kind, shape, lefts[start], rights[end]))
    doc.found = made
    return made


def best_segments(scored: list[tuple[int, int, str, float]]) -> list[tuple[int, int, str]]:
    """The set of disjoint segments with the largest total score above nothing."""
    useful = sorted((s for s in scored if s[3] > 0), key=lambda s: (s[1], s[0], s[2]))
    if not useful:
        return []
    ends = [s[1] for s in useful]
    best, choice = [0.0], []
    for i, (start, _, _, score) in enumerate(useful):
        before = bisect.bisect_right(ends, start, 0, i)
        take = best[before] + score
        if take > best[i]:
            best.append(take)
            choice.append(before)
        else:
            best.append(best[i])
            choice.append(-1)
    out, i = [], len(useful)
    while i > 0:
        before = choice[i - 1]
        if before < 0:
            i -= 1
        else:
            out.append(useful[i - 1][:3])
            i = before
    return out[::-1]


class Recognizer:
    """The weights of the field, and their sums for shapes and surroundings met before."""

    def __init__(self) -> None:
        self.weights: dict[str, float] = {}
        self.power: dict[str, float] = {}
        self.sums: dict[tuple, float] = {}

    def __getstate__(self) -> dict:
        return {"weights": self.weights, "power": {}, "sums": {}}

    def _sum(self, key: tuple) -> float:
        kind, side, what = key
        named = what if side == 0 else left_features(what) if side == 1 else right_features(what)
        if len(self.sums) > 500_000:
            self.sums.clear()
        made = self.sums[key] = sum(self.weights.get(f"{kind}|{f}", 0.0) for f in named) + (self.weights.get(kind, 0.0) if side == 0 else 0.0)
        return made

    def scores(self, some: list[Candidate]) -> list[tuple[int, int, str, float]]:
        """(start, end, kind, score) of candidates."""
        get, add = self.sums.get, self._sum
        out = []
        for start, end, kind, *sides in some:
            total = 0.0
            for side in (0, 1, 2):
                key = (kind, side, sides[side])
                v = get(key)
                total += add(key) if v is None else v
            out.append((start, end, kind, total))
        return out

    def segments(self, doc: Text) -> list[tuple[int, int, str]]:
        return best_segments(self.scores(candidates(doc)))

    def find(self, text: str | None) -> list[tuple[str, str, int, int]]:
        """(kind, value, start, end) in order; start and end are characters of the text."""
        if not text:
            return []
        doc = Text(text)
        back = doc.back
        return [
            (k, doc.value(s, e), s if back is None else back[s], e if back is None else back[e])
            for s, e, k in self.segments(doc)
        ]

    def mask(self, text: str | None) -> str | None:
        """The text with each value replaced by its kind in brackets."""
        if not text:
            return text
        out, at = [], 0
        for kind, _, start, end in self.find(text):
            out += (text[at:start], f"[{kind.upper()}]")
            at = end
        return "".join([*out, text[at:]])

    def fit(self, samples: list[tuple[Text, set[tuple[int, int, str]], set | None]], epochs: int, rate: float = 0.4, decay: float = 1e-4, drop: float = 0.25) -> None:
        """Maximum likelihood over all segmentations, by AdaGrad on the exact gradient.

        A sample is a text with its right segments, and with the candidates that
        count (all without). A part ``drop`` of the surrounding words is hidden at
        random, so that shape and surroundings each learn to decide alone.
        """
        chance = random.Random(5)
        known: dict[tuple, list[str]] = {}

        def named(c: Candidate) -> list[list[str]]:
            kind = c[2]
            out = []
            for side in (0, 1, 2):
                key = (kind, side, c[3 + side])
                if key not in known:
                    fs = [f"{kind}|{f}" for f in (c[3] if side == 0 else left_features(c[4]) if side == 1 else right_features(c[5]))]
                    known[key] = [kind, *fs] if side == 0 else fs
                out.append(known[key])
            return out

        prepared = []
        for doc, gold, counts in samples:
            cand = sorted((c for c in candidates(doc) if counts is None or c[:3] in counts), key=lambda c: (c[1], c[0]))
            if cand:
                bounds = sorted({c[0] for c in cand} | {c[1] for c in cand})
                place = {p: i for i, p in enumerate(bounds)}
                prepared.append(([(place[c[0]], place[c[1]], *named(c), c[:3] in gold) for c in cand], len(bounds)))
        weights, power = self.weights, self.power
        total_weights: dict[str, float] = {}
        for _ in range(epochs):
            chance.shuffle(prepared)
            for some, n in prepared:
                hide_left, hide_right = chance.random() < drop, chance.random() < drop
                cand = []
                for s, e, own, left, right, good in some:
                    cand.append((s, e, own + ([] if hide_left else left) + ([] if hide_right else right), good))
                scores = [sum(weights.get(f, 0.0) for f in fs) for _, _, fs, _ in cand]
                ahead = [0.0] * n
                i = 0
                for p in range(1, n):
                    ahead[p] = ahead[p - 1]
                    while i < len(cand) and cand[i][1] == p:
                        ahead[p] = _logadd(ahead[p], ahead[cand[i][0]] + scores[i])
                        i += 1
                behind = [0.0] * n
                by_start: dict[int, list[int]] = {}
                for j, c in enumerate(cand):
                    by_start.setdefault(c[0], []).append(j)
                for p in range(n - 2, -1, -1):
                    behind[p] = behind[p + 1]
                    for j in by_start.get(p, ()):
                        behind[p] = _logadd(behind[p], scores[j] + behind[cand[j][1]])
                total = ahead[-1]
                for j, (s, e, fs, right) in enumerate(cand):
                    error = right - math.exp(min(0.0, ahead[s] + scores[j] + behind[e] - total))
                    if abs(error) < 1e-3:
                        continue
                    for f in fs:
                        w = weights.get(f, 0.0)
                        g = error - decay * w
                        power[f] = p2 = power.get(f, 1e-3) + g * g
                        weights[f] = w + rate * g / math.sqrt(p2)
            for f, w in weights.items():
                total_weights[f] = total_weights.get(f, 0.0) + w
        # The mean over the passes depends less on the order of the samples than the last pass does.
        self.weights = {f: w / max(1, epochs) for f, w in total_weights.items()}
        self.sums.clear()


def _logadd(a: float, b: float) -> float:
    if a < b:
        a, b = b, a
    return a + math.log1p(math.exp(b - a))


class _Maker:
    """Fills the patterns with invented values."""

    def __init__(self, seed: int) -> None:
        self.r = random.Random(seed)

    def digits(self, n: int, first: str = "") -> str:
        return first + "".join(self.r.choice("0123456789") for _ in range(n - len(first)))

    def word(self) -> str:
        """A name of no known language."""
        r = self.r
        return "".join(r.choice(words.ONSETS) + r.choice(words.VOWELS) + (r.choice(words.CODAS) if r.random() < 0.6 else "") for _ in range(r.randint(2, 3))).capitalize()

    def syllable(self) -> str:
        """A Vietnamese syllable."""
        r = self.r
        return (r.choice(words.VI_ONSETS) + r.choice(words.VI_RIMES)).capitalize()

    def name(self) -> str:
        r = self.r
        roll = r.random()
        if roll < 0.15:
            made = f"{r.choice(words.FOREIGN_FIRST)} {r.choice(words.FOREIGN_LAST)}"
        elif roll < 0.3:
            parts = [self.word() if r.random() < 0.7 else r.choice(words.FOREIGN_FIRST), self.word() if r.random() < 0.8 else r.choice(words.FOREIGN_LAST)]
            if r.random() < 0.12:
                parts[1] += "-" + self.word()
            elif r.random() < 0.08:
                parts[1] = "O'" + parts[1]
            if r.random() < 0.08:
                parts.insert(1, self.word())
            made = " ".join(parts)
        else:
            family, given = r.choice(words.SURNAMES), r.choice(words.GIVEN)
            if r.random() < 0.4:
                given = r.choice(words.PLACE_ENDS) if r.random() < 0.3 else self.syllable()
            middle = [r.choice(words.MIDDLE)] if r.random() < 0.75 else []
            if r.random() < 0.2:
                middle.append(r.choice(words.GIVEN) if r.random() < 0.6 else self.syllable())
            made = f"{given} {family}" if r.random() < 0.06 else " ".join([family, *middle, given])
        roll = r.random()
        if roll < 0.1:
            made = made.upper()
        elif roll < 0.2:
            made = _strip(made)
        return made

    def place(self, kind: bool) -> str:
        r = self.r
        roll = r.random()
        if roll < 0.35:
            made = r.choice(words.CITIES)
        elif roll < 0.45:
            made = f"{r.choice(words.SURNAMES)} {r.choice(words.PLACE_ENDS)}"
        elif roll < 0.55:
            made = f"{r.choice(words.GIVEN)} {r.choice(words.PLACE_ENDS)}"
        elif roll < 0.8:
            made = f"{r.choice(words.PLACE_HEADS)} {r.choice(words.PLACE_ENDS)}"
        else:
            made = f"{self.syllable()} {r.choice((self.syllable(), r.choice(words.PLACE_ENDS)))}"
        if not kind:
            return made
        if r.random() < 0.3:
            made = f"{r.choice(words.SURNAMES)} {r.choice(words.GIVEN + words.PLACE_ENDS)}"
        head = r.choice(words.PLACE_KINDS)
        return f"{head.capitalize() if r.random() < 0.6 else head} {made}"

    def firm(self) -> str:
        """A street or firm named after a person or a place."""
        r = self.r
        made = " ".join([r.choice(words.SURNAMES), *([r.choice(words.MIDDLE)] if r.random() < 0.5 else []), r.choice(words.GIVEN + words.PLACE_ENDS)])
        if r.random() < 0.2:
            made = f"{self.word()} {self.word()}" if r.random() < 0.5 else f"{r.choice(words.FOREIGN_FIRST)} {r.choice(words.FOREIGN_LAST)}"
        if r.random() < 0.2:
            return f"{_strip(made)} {r.choice(('Street', 'Road', 'Hotel', 'Museum', 'Bridge', 'School', 'Avenue', 'Market', 'Company', 'Airport', 'Lane', 'Restaurant'))}"
        head = r.choice(words.STREET_KINDS if r.random() < 0.5 else words.FIRM_KINDS)
        return f"{head.capitalize() if r.random() < 0.4 else head} {made}"

    def phone(self) -> str:
        r = self.r
        roll = r.random()
        if roll < 0.12:
            sep = r.choice([" ", "-", "."])
            return f"{r.choice(['(020', '(024', '(028', '(023'])}{r.choice(['', r.choice('0123456789')])}){' '}{self.digits(4, '3')}{sep}{self.digits(3)}"
        if roll < 0.2:
            return f"+1 (555) 555-0{self.digits(3, '1')}" if r.random() < 0.5 else f"+44 7700 900{self.digits(3)}"
        body = r.choice("3456789") + self.digits(8)
        if roll < 0.45:
            lead = r.choice(["+84", "(+84) ", "+84 ", "84", "+84-"])
            sep = r.choice(["", " ", "-", "."])
            return lead + sep.join([body[:3], body[3:6], body[6:]]) if lead != "84" else "+84" + body
        full = "0" + body
        roll = r.random()
        if roll < 0.25:
            return full
        if roll < 0.33:
            return "".join(chr(ord(c) - 48 + 0xFF10) for c in full)
        if roll < 0.38:
            return " ".join(full)
        sep = r.choice([" ", "-", ".", chr(0xA0)])
        cut = r.choice([(4, 7), (3, 6), (4, 6), (5, 7)])
        return sep.join([full[: cut[0]], full[cut[0] : cut[1]], full[cut[1] :]])

    def email(self) -> str:
        r = self.r
        part = lambda: _strip(r.choice(words.GIVEN + words.FOREIGN_FIRST + words.FOREIGN_LAST)).lower()
        user = part() + r.choice(["", ".", "_", "-"]) + part() + r.choice(["", self.digits(2), self.digits(3)]) + r.choice(["", "", "", "", "+" + part()])
        site = ".".join([self.word().lower() + r.choice(["", "", "-" + self.word().lower()]), *([self.word().lower()] if r.random() < 0.2 else [])])
        domain = f"{site}.{r.choice('com net org vn com.vn edu.vn info travel fr de co.uk io example test invalid'.split())}"
        roll = r.random()
        if roll < 0.5:
            return f"{user}@{domain}"
        if roll < 0.65:
            return f"{user}＠{domain}"
        if roll < 0.8:
            return f"{user}[at]{domain}"
        if roll < 0.92:
            return f"{user} (at) {domain.replace('.', ' (dot) ')}"
        return f"{user} at {domain.replace('.', ' dot ')}"

    def identity(self, text: str) -> str:
        r = self.r
        if "hộ chiếu" in text.lower() or "passport" in text.lower():
            return r.choice("BCEQXZNPK") + self.digits(7)
        n = 9 if "CMND" in text or "hứng minh" in text or (text == "ID no." and r.random() < 0.5) else 12
        made = self.digits(n, "0" if n == 12 else "")
        return " ".join(made[i : i + 3] for i in range(0, n, 3)) if r.random() < 0.25 else made

    def address(self) -> str:
        r = self.r
        p = lambda: self.place(False)
        house = str(r.randint(1, 399)) + (r.choice("ABC") if r.random() < 0.15 else "") + (f"/{r.randint(1, 60)}" if r.random() < 0.25 else "")
        street = " ".join([r.choice(words.SURNAMES), r.choice(words.MIDDLE + words.GIVEN), r.choice(words.GIVEN)][: r.choice([2, 2, 3])]) if r.random() < 0.6 else p()
        if r.random() < 0.12:
            made = f"{house} {street} {r.choice(('Street', 'Road', 'Lane', 'Avenue'))}" + (f", {p()} {r.choice(('Ward', 'District'))}" if r.random() < 0.5 else "") + (f", {p()}" if r.random() < 0.7 else "")
            return _strip(made)
        lane = f"{r.choice(('ngõ', 'hẻm', 'ngách', 'kiệt'))} {r.randint(2, 90)}{r.choice(('', ','))} " if r.random() < 0.2 else ""
        short = r.random() < 0.3
        kind = r.random()
        if kind < 0.15:
            return f"{house} {street}, {p() if r.random() < 0.6 else ('Q.' if short else 'quận ') + str(r.randint(1, 12))}" + (f", {p()}" if r.random() < 0.4 else "")
        if kind < 0.3:
            made = [f"{house} {r.choice(('thôn', 'ấp', 'xóm', 'bản', 'khu phố', 'tổ'))} {r.choice((p(), str(r.randint(1, 20))))}", f"{'X.' if short else 'xã'} {p()}", f"{'H.' if short else 'huyện'} {p()}", f"tỉnh {p()}"]
            return ", ".join(made[: r.randint(2, 4)])
        made = [f"{house} {lane}{'Đ.' if short and not lane else r.choice(('đường', 'phố'))} {street}"]
        gap = r.choice((" ", "")) if short else " "
        made += [f"{'P.' if short else 'phường'}{gap if r.random() < 0.5 else ' '}{r.choice((p(), str(r.randint(1, 20))))}"] if r.random() < 0.6 else []
        made += [f"{'Q.' if short else 'quận'} {r.choice((p(), str(r.randint(1, 12))))}"] if r.random() < 0.5 else []
        made += [f"{r.choice(('TP.', 'Tp.')) if short else 'thành phố'} {p()}" if r.random() < 0.6 else p()] if r.random() < 0.6 else []
        return ", ".join(made)

    def fill(self, phrase: str) -> tuple[str, set[tuple[int, int, str]]]:
        """A sentence and its gold segments."""
        r = self.r
        kinds = {"N": "name", "P": "phone", "E": "email", "I": "id_number", "A": "address"}
        out, gold, at, length = [], set(), 0, 0
        title = label = ""
        for m in re.finditer(r"\{(\w)\}", phrase):
            out.append(phrase[at : m.start()])
            length += m.start() - at
            at = m.end()
            slot = m.group(1)
            if slot == "N":
                v = self.name()
                if r.random() < (0.15 if title else 0.06) and v.split()[0] in words.SURNAMES:
                    v = v.lower()
            elif slot == "T":
                v = title = r.choice(words.TITLES)
            elif slot == "P":
                v = self.phone()
            elif slot == "E":
                v = self.email()
            elif slot == "I":
                v = self.identity(label)
            elif slot == "Q":
                v = label = r.choice(words.LABELS)
                v = label + r.choice([" ", ": ", ":", " số ", " "])
            elif slot == "A":
                v = self.address()
            elif slot == "L":
                v = self.place(True)
            elif slot == "G":
                v = self.place(False)
            elif slot == "F":
                v = self.firm()
            elif slot == "R":
                v = r.choice(words.ROLES)
            elif slot == "O":
                v = r.choice(words.ENGLISH_ROLES)
            elif slot == "W":
                v = r.choice(words.THINGS) if r.random() < 0.7 else " ".join(r.choice(words.PLACE_HEADS + words.PLACE_ENDS) for _ in range(r.randint(2, 3)))
            elif slot == "M":
                v = str(r.randint(1, 60))
            elif slot == "C":
                v = r.choice("KQXBTZC") + self.digits(r.choice([6, 7, 7, 7, 8, 8, 9, 10]))
            else:
                v = self.digits(r.choice([7, 8, 9, 9, 10, 10, 11, 12, 12, 13, 16]), r.choice(["", "0", "09", "04", "06"]))
                if r.random() < 0.25:
                    v = f"{self.digits(r.choice([6, 7]), '0')}–{self.digits(6, '0')}"
            if slot in kinds:
                gold.add((length, length + len(v), kinds[slot]))
            out.append(v)
            length += len(v)
        out.append(phrase[at:])
        return "".join(out), gold


def _strip(s: str) -> str:
    plain = unicodedata.normalize("NFD", s)
    return "".join(c for c in plain if not unicodedata.combining(c)).replace("đ", "d").replace("Đ", "D")


def training_samples(copies: int = COPIES, seed: int = 17, personal: str = words.PERSONAL, other: str = words.OTHER) -> list[tuple[str, set[tuple[int, int, str]]]]:
    """Short texts of a few filled patterns each, with their right segments."""
    maker = _Maker(seed)
    good, plain = _patterns(personal), _patterns(other)
    phrases = good * copies + plain * copies
    maker.r.shuffle(phrases)
    made = []
    i = 0
    while i < len(phrases):
        n = maker.r.randint(1, 4)
        text, gold = "", set()
        for p in phrases[i : i + n]:
            if text:
                # Sentences follow each other after a blank; what has no end mark ends its line.
                text += maker.r.choice([" ", " ", " ", "\n", "\n\n"] if text[-1] in ".!?" else ["\n", "\n", "\n\n", ". ", "; "])
            s, g = maker.fill(p)
            gold |= {(a + len(text), b + len(text), k) for a, b, k in g}
            text += s
        made.append((text, gold))
        i += n
    return made


def _patterns(text: str) -> list[str]:
    """One pattern a line; a line that ends with a comma goes on, as signatures do."""
    out: list[str] = []
    for line in text.strip().split("\n"):
        if out and (out[-1].endswith(",") or (line == "{P}" and out[-1].endswith("{N}"))):
            out[-1] += "\n" + line
        elif line:
            out.append(line)
    return out


def own_labels(recognizer: Recognizer, texts: list[Text], sure: float = SURE) -> list[tuple[Text, set, set]]:
    """Texts with the segments the field is sure of, and the candidates that may teach it.

    A chosen segment scores at least ``sure``. Candidates that overlap none of the
    chosen ones and score below ``-sure`` are as surely wrong, and so are those that
    overlap a sure one; the rest teaches nothing.
    """
    out = []
    for doc in texts:
        scored = recognizer.scores(candidates(doc))
        chosen = best_segments(scored)
        value = {c[:3]: c[3] for c in scored}
        good = {c for c in chosen if value[c] >= sure}
        counts = set()
        for c in scored:
            over = [g for g in chosen if g[0] < c[1] and c[0] < g[1]]
            if (over and all(g in good for g in over)) or (not over and c[3] <= -sure):
                counts.add(c[:3])
        if counts:
            out.append((doc, good, counts))
    return out


def train_recognizer(texts: list[str] = (), copies: int = COPIES, epochs: int = EPOCHS, seed: int = 17) -> Recognizer:
    """Train on invented sentences, then on ``texts`` of the corpus; the same weights every time."""
    recognizer = Recognizer()
    made = [(Text(t), gold, None) for t, gold in training_samples(copies, seed)]
    recognizer.fit(made, epochs)
    docs = [Text(t) for t in texts]
    for _ in range(OWN_ROUNDS if docs else 0):
        recognizer.fit(made + own_labels(recognizer, docs), OWN_EPOCHS)
    recognizer.weights = {f: round(w, 4) for f, w in recognizer.weights.items() if abs(w) > 0.02}
    recognizer.sums.clear()
    return recognizer


def sample_texts(df: DataFrame, text: str, rows: int = SAMPLE_DOCS) -> list[str]:
    """At most ``rows`` different texts of the corpus, whole, the same ones each time."""
    mark = F.xxhash64("text")
    share = min(1.0, 2.0 * rows / max(1, df.count()))
    texts = df.select(df[text].alias("text")).where(F.length("text") > 0)
    if share < 1:
        texts = texts.where(F.pmod(mark, F.lit(1 << 30)) < int(share * (1 << 30)))
    return [r["text"] for r in texts.distinct().orderBy(mark, "text").limit(rows).collect()]


def _find_batches(recognizer: Recognizer, key: str, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, kinds, values, starts = [], [], [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                for k, v, s, _ in recognizer.find(text):
                    rows.append(i)
                    kinds.append(k)
                    values.append(v)
                    starts.append(s)
            yield pa.RecordBatch.from_arrays(
                [batch.column(key).take(pa.array(rows, pa.int64())), pa.array(kinds, pa.string()), pa.array(values, pa.string()), pa.array(starts, pa.int64())],
                names=[key, "kind", "value", "start"],
            )

    return run, f"`{key}` {kind}, kind string, value string, start long"


def find_personal(df: DataFrame, key: str, text: str, recognizer: Recognizer | None = None) -> DataFrame:
    """``(key, kind, value, start)`` of every personal item; one narrow pass (see ``runtime.spread`` for small inputs).

    Null and empty texts give no rows; texts of any length are read whole; repeated
    rows give repeated items. Other columns are left out.
    """
    run, schema = _find_batches(recognizer or train_recognizer(sample_texts(df, text)), key, dict(df.dtypes)[key])
    return arrow_map(spread(df.select(key, df[text].alias("text"))), run, schema)


def mask_personal(df: DataFrame, key: str, text: str, recognizer: Recognizer | None = None) -> DataFrame:
    """``(key, text)`` with the items replaced by typed placeholders, the rest unchanged.

    Null texts stay null.
    """
    recognizer = recognizer or train_recognizer(sample_texts(df, text))
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = pa.array([recognizer.mask(t) for t in batch.column("text").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(key), made], names=[key, "text"])

    return arrow_map(spread(df.select(key, df[text].alias("text"))), run, f"`{key}` {kind}, text string")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal items in the documents."""
    found = find_personal(table(spark, sf_dir, "documents"), "doc_id", "text")
    return found.select("doc_id", "kind", "value").distinct()


def p8_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents with personal items replaced by placeholders."""
    masked = mask_personal(table(spark, sf_dir, "documents"), "doc_id", "text")
    return masked.select("doc_id", F.col("text"))
