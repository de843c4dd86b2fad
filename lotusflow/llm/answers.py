"""Broken prompt and response pairs (problem 5).

A linear-chain conditional random field tags each clause of a response as answer,
refusal, echo, foreign or unfinished, from its words, its overlap with the
question, its language against the language the question asks for, and its end.
The words covered by each tag decide the defect of the pair.

The field alone decides: its features say how far words are shared or foreign and how
the text ends, none of them forbids a tag, but that only the last clause can be
unfinished. It is trained at run time on a bounded sample of the corpus (``SAMPLE_ROWS``
pairs): complete answers as they stand and without their full stop, cut off at random
places (unfinished), questions as answers (echo), and the phrases below as refusals and
as sentences in other languages. The table of known words comes from all answers.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotusflow.llm.common import HAS_TEXT, arrow_map, has_text, spread, table
from lotusflow.llm.crf import ChainCRF

ANSWER, REFUSAL, ECHO, FOREIGN, UNFINISHED = range(5)

#: Pairs of the corpus the tagger is trained on, at most.
SAMPLE_ROWS = 2_500

#: Clauses of a training sequence; longer answers are learned in parts of this many.
TRAIN_CLAUSES = 24

#: Hashed word features.
BUCKETS = 1 << 16

LANGUAGES = ("vi", "en", "fr", "de", "es", "ru", "zh", "ja", "ko", "other", "it", "pt", "nl", "pl", "id", "tr", "sv", "cs")

#: Frequent words by language, without accents.
FREQUENT_WORDS = {
    "vi": "khong nhung trong duoc nguoi ban mot voi khi nhat noi nen ngay gan thang nay cac hon moi dem khoang gio"
    " dong hai mon thanh pho duong len tham quan khach can cho bang toi minh sau truoc tren duoi vao den la co cua va"
    " tu gia nam di ve nhieu rat cung cach o se thi da con neu hay thuong lam gi nao bao bi theo quanh dau khac phong"
    " xin vui vi chi hien giup goi ghe an buoi sang chieu tien nho tre em le hoi",
    "en": "visit eat get much the is and you for of to in at with from are this that it on by or be not can have has will your more an as"
    " but about how what when where which per if so there they should try i me my we our was than then them us could"
    " would do does did must no yes above all near before after",
    "fr": "la le les des du de et est une un au aux en que qui pour dans sur se vous on avec par pas plus sont ce il"
    " elle son ses quand bonnes bonne meilleure a d l y ou mais nous leur matin",
    "de": "der die das und ist nicht ein eine mit von zu den dem im am auf fur wird werden kann sich sobald etwa nach"
    " aus bei oder sie es kleine beste gut",
    "es": "el la los las de y es en un una por para con que se del al esta son muy cuando mejor a su mas pero o lo como"
    " ninos entrada",
    "it": "il lo la gli le di e un una per con che si della del dei nel nella sono molto anche piu questo non alla da come quando ma",
    "pt": "o a os as de e um uma para com que nao do da dos das em no na mais muito por sao voce pelo pela esta mas quando ao",
    "nl": "de het een en van is op te dat niet met voor er zijn aan ook naar door maar je bij uit om wordt kan meer",
    "pl": "i w z na do sie jest nie to od po za ale jak lub przez dla oraz sa tam ze przy bardzo mozna ktory juz",
    "id": "yang dan di ke dari untuk dengan ini itu ada tidak pada adalah anda bisa akan juga atau lebih saya kami sangat",
    "tr": "ve bir bu da de icin ile cok daha en gibi olarak var yok degil ne ya kadar sonra her",
    "sv": "och att det som en pa ar av for med den till inte om ett kan du har vid fran eller men och af er ikke",
    "cs": "a v na je se s z do to ze za po ale jako pro od jsou neni nebo ktery u pri velmi",
}

#: Names of languages in questions, Vietnamese (accents optional) and English.
ASKED = {
    "en": r"ti[eế]ng\s+anh|english",
    "fr": r"ti[eế]ng\s+ph[aá]p|french",
    "de": r"ti[eế]ng\s+[đd][uứ]c|german",
    "es": r"ti[eế]ng\s+t[aâ]y\s+ban\s+nha|spanish",
    "ru": r"ti[eế]ng\s+nga|russian",
    "zh": r"ti[eế]ng\s+(?:trung|hoa)|chinese|mandarin",
    "ja": r"ti[eế]ng\s+nh[aậ]t|japanese",
    "ko": r"ti[eế]ng\s+h[aà]n|korean",
    "vi": r"ti[eế]ng\s+vi[eệ]t|vietnamese",
    "it": r"ti[eế]ng\s+[yý]\b|italian",
    "pt": r"ti[eế]ng\s+b[oồ]\s+[dđ][aà]o\s+nha|portuguese",
    "nl": r"ti[eế]ng\s+h[aà]\s+lan|dutch",
    "pl": r"ti[eế]ng\s+ba\s+lan|polish",
    "id": r"ti[eế]ng\s+indonesia|indonesian|malay",
    "tr": r"ti[eế]ng\s+th[oổ]\s+nh[iĩ]\s+k[yỳ]|turkish",
    "sv": r"ti[eế]ng\s+th[uụ]y\s+[dđ]i[eể]n|swedish|danish|norwegian",
    "cs": r"ti[eế]ng\s+s[eé]c|czech",
    "other": r"ti[eế]ng\s+(?:th[aá]i|[aả]\s+r[aậ]p|hindi|khmer|l[aà]o)|thai\b|arabic|hindi|khmer",
}

#: Phrases that decline to answer, for training; general knowledge, in many wordings.
REFUSALS = """
Tôi không thể trả lời.
Mình chịu, không biết câu này.
Mình không nắm rõ chuyện này.
Chuyện đó mình không nắm được.
Mình không nắm được thông tin về {x}.
Việc này ngoài phạm vi của tôi nên tôi từ chối.
Đây là chủ đề tôi không tư vấn, tôi xin từ chối.
Sorry, no idea about that.
Em không rành về {x}, anh chị hỏi chỗ khác giúp em.
Tôi không có dữ liệu về {x}.
Tôi không tìm được thông tin nào về {x}.
Tôi không có thông tin để trả lời câu này.
Tôi không đủ thông tin để trả lời bạn.
Không có thông tin trong tài liệu.
Không tìm thấy câu trả lời trong tài liệu.
Tài liệu không nhắc đến {x}.
Tài liệu tôi có không chứa nội dung này.
Trong phần văn bản được cung cấp không có chi tiết về {x}.
Nguồn tư liệu hiện có không nói đến {x} nên tôi không trả lời được.
Ngữ cảnh không có câu trả lời.
Không có căn cứ nào để trả lời câu hỏi.
Xin lỗi, mình không giúp được việc này.
Xin lỗi, tôi không trả lời được câu hỏi của bạn.
Xin lỗi, câu hỏi vượt quá khả năng của tôi.
Rất tiếc, tôi chưa có câu trả lời cho bạn.
Rất tiếc, tôi không hỗ trợ được chủ đề này.
Thật tiếc là hệ thống chưa có dữ liệu về {x}.
Câu này ngoài khả năng của mình.
Chủ đề này nằm ngoài phạm vi của trợ lý.
Câu hỏi không thuộc lĩnh vực tôi phụ trách.
Nội dung ngoài phạm vi, mời bạn hỏi chuyện khác.
Tôi xin phép không trả lời câu này.
Tôi từ chối trả lời.
Tôi phải từ chối yêu cầu của bạn.
Mình xin không bàn về vấn đề này.
Tôi không được phép nói về việc đó.
Là một mô hình ngôn ngữ, tôi không thể đưa ra ý kiến.
Tôi chỉ là trợ lý tự động nên không thể làm việc này.
Hiện chưa có thông tin, bạn vui lòng quay lại sau.
Hiện tôi chưa được cập nhật về {x}.
Em chưa được cung cấp thông tin phần này ạ.
Mình chưa nghe nói về {x}, bạn thông cảm.
Bạn vui lòng liên hệ nơi khác vì mình không có số liệu.
Bạn nên hỏi ban quản lý, tôi không có thông tin.
Yêu cầu này tôi không thực hiện được.
I cannot answer that.
I can't answer this one.
I can't help you with this.
I am unable to help with that request.
I'm not able to answer, sorry.
No idea, sorry.
I don't know.
I do not know anything about {x}.
I have no information on {x}.
Sorry, there is no information about {x}.
Sorry, I can't say.
I'm afraid I don't have an answer.
I'm afraid that is beyond what I can do.
Unfortunately, I don't have enough details to answer.
The documents do not mention {x}.
The material says nothing on {x}, so I cannot tell.
My sources say nothing about that.
I was given no details on {x} and am unable to say.
Nothing was given to me about {x}, so no answer is possible.
The text provided does not contain the answer.
Nothing in the context answers this question.
There isn't enough information in the sources.
I couldn't find any details about {x}.
It is outside my scope.
That topic falls outside what I was made for.
I must decline.
I would rather not answer that.
As an AI model, I can't give opinions.
I'm only an assistant and not allowed to discuss this.
Please ask someone else, I have no data.
"""

#: Answers that only sound like the phrases above, for training.
NOT_REFUSALS = """
Bạn không thể bỏ lỡ {x} nếu đã tới đây.
Không có vé nào đắt hơn 100.000 đồng ở {x}.
Rất tiếc là mùa này hay mưa, nhưng {x} vẫn đông khách.
Người dân ở đây hay nói lời xin lỗi khi đi ngang mặt khách ở {x}.
Không có cầu sang {x}, bạn đi đò mất 10 phút.
Tài liệu ở quầy ghi rõ giờ mở cửa của {x}.
Bạn không cần xin phép, cứ vào {x} và mua vé.
Không được hút thuốc trong {x}.
Chủ quán sẽ từ chối nếu khách quá đông, nên hãy tới {x} sớm.
Thông tin về {x} có ở bảng tin ngoài cổng.
Không phải ngày nào {x} cũng mở, hãy đi thứ bảy.
Nếu không biết đường, bạn hỏi người bán hàng gần {x}.
Bạn có thể hỏi ban quản lý {x} để thuê xe đạp.
Ngoài phạm vi 2 km quanh {x} thì có nhiều quán ăn.
Không, {x} không thu phí.
Không bao xa đâu, từ bến tới {x} chừng 2 km.
The sorry state of the road to {x} was mended last year.
You can't go wrong with {x}; go early.
Unfortunately {x} is closed on Mondays, so go on Tuesday.
There is no fee at {x}.
No, {x} does not open at night.
I don't think you need a guide for {x}; the path is marked.
Nobody is allowed to swim at {x} after dark.
If you don't know the way to {x}, follow the river.
Information about {x} is posted at the gate.
You cannot park at {x}, use the lot by the market.
"""

#: Openings that carry no content, for training.
OPENINGS = ("", "", "", "Chào bạn! ", "Vâng ạ. ", "Chào bạn! ", "Dạ vâng ạ. ", "Xin chào. ", "Dạ vâng, ", "Cảm ơn bạn đã hỏi. ", "Hello! ", "Thank you for asking. ", "Vâng, ", "Dạ, ")

#: Sentences for the tag foreign, by language, for training.
SENTENCES = {
    "vi": "Đường tới {x} khá dễ đi và có nhiều quán ăn ở hai bên.|Bạn nên tới {x} vào buổi sáng khi trời mát.|Vé vào {x} là 50.000 đồng cho mỗi người.",
    "en": "The road to {x} is quiet and there are many places to eat.|You should visit {x} in the morning, when the air is cool.|Tickets for {x} cost 50.000 đồng for each person.",
    "fr": "La route vers {x} est tranquille et on y trouve de bons restaurants.|Il faut visiter {x} le matin, quand il fait frais.|Le billet pour {x} coûte 50.000 đồng par personne.",
    "de": "Die Straße nach {x} ist ruhig und es gibt viele Lokale.|Am besten besucht man {x} am Morgen, wenn die Luft kühl ist.",
    "es": "El camino a {x} es tranquilo y hay muchos lugares para comer.|La entrada a {x} cuesta 50.000 đồng por persona.",
    "ru": "Дорога до {x} спокойная, по пути много кафе.|Лучше приехать в {x} утром, когда прохладно.|Билет стоит 50.000 đồng на человека.",
    "zh": "去{x}的路很安静，路边有很多小吃。|早上去{x}最好，天气凉爽。|门票每人50.000 đồng。|下雨天请带伞。",
    "ja": "{x}までの道は静かで、食べる所もたくさんあります。|{x}へは涼しい朝に行くのがおすすめです。|入場料は一人50.000 đồngです。|駅から歩いて十分ほどです。",
    "other": "ถนนไป {x} เงียบและมีร้านอาหารมากมาย|ควรไปตอนเช้าเพราะอากาศเย็น|الطريق إلى {x} هادئ وفيه مطاعم كثيرة|من الأفضل الزيارة في الصباح|{x} की सड़क शांत है और वहाँ कई दुकानें हैं|सुबह जाना सबसे अच्छा है",
    "it": "La strada per {x} è tranquilla e ci sono molti posti dove mangiare.|Il biglietto costa 50.000 đồng per persona.",
    "pt": "A estrada para {x} é calma e há muitos lugares para comer.|É melhor ir de manhã, quando está fresco.",
    "nl": "De weg naar {x} is rustig en er zijn veel eethuizen.|Het is het beste om in de ochtend te gaan.",
    "pl": "Droga do {x} jest spokojna i jest tam wiele miejsc do jedzenia.|Najlepiej jechać rano, kiedy jest chłodno.",
    "id": "Jalan ke {x} tenang dan ada banyak tempat makan.|Sebaiknya datang pada pagi hari karena udara sejuk.",
    "sv": "Vägen till {x} är lugn och det finns många ställen att äta på.|Det är bäst att åka på morgonen.",
    "ko": "{x}까지 가는 길은 조용하고 식당이 많습니다.|{x}에는 시원한 아침에 가는 것이 좋습니다.|입장료는 한 사람에 50.000 đồng입니다.|역에서 걸어서 십 분쯤 걸립니다.",
}

#: Short complete answers, for training.
SHORT_ANSWERS = ("30k mỗi người", "60k một vé nhé", "chừng 15 phút đi bộ", "tầm 5 giờ sáng", "sáng sớm là đẹp nhất", "không cần đâu bạn", "có nhé", "miễn phí", "gần chợ", "ở cuối đường", "tùy ngày ạ", "được bạn nhé", "khoảng hai tiếng", "áo ấm và giày bệt", "mở cả tuần")

#: Frames around a repeated question, for training.
ECHO_FRAMES = (
    "{q}", "{q}", "{q}", "Câu hỏi: {q}", "Hỏi: {q}", "Bạn hỏi: {q}", "“{q}”", "\"{q}\"", "{q}\n{q}", "{q} {q}", "{q}...",
    "Bạn muốn hỏi: {q}", "Question: {q}", "You asked: {q}", "Q: {q}",
)

#: What a cut-off answer may end with, for training.
CUT_ENDS = ("", "", "", "", "", "...", "…", ",", ", bao gồm:", " như “", " (xem thêm", " (tức là", " **Lưu ý", " và", " vì", " nhưng", " với", " hoặc", " là", " cho", " như", " -", ":", " and", " but", " such as", " because", " (see", " of", " to")

#: The Vietnamese "and so on" ends no sentence.
_TOKEN = re.compile(r"\n|\b[vV]\.\s?[vV]\b\.?|\d+(?:[.,]\d+)*\w*|\w+|[^\w\s]")
_WORDS = re.compile(r"[^\W\d_]+")
_STUB = re.compile(r"\n\s*(?:\d+[.)]|[-*•])\s*$")
_LIST = re.compile(r"\s*(?:\d+[.)]|[-*•])\s")
_ASKED = re.compile("|".join(f"(?P<{k}>{v})" for k, v in ASKED.items()), re.IGNORECASE)
#: A question that names a language has one of these; the pattern is tried only then.
_ASK_HINTS = tuple(
    "tiếng tieng english french german spanish russian chinese mandarin japanese korean vietnamese italian portuguese dutch polish indonesian malay turkish"
    " swedish danish norwegian czech thai arabic hindi khmer".split()
)
_TERMINAL, _NEWLINE, _HANGING, _OPEN, _CLOSE, _OTHER, _WORD, _NUMBER = range(8)
_KIND = {c: _TERMINAL for c in ".!?。！？…؟"}
_KIND |= {c: _HANGING for c in ",;:-–—*/&+、，：；"}
_KIND |= {c: _OPEN for c in "([{“‘«「（"}
_KIND |= {c: _CLOSE for c in ")]}”’»」）"}
_VI_LETTERS = set("ăđĩũơư") | {chr(c) for c in range(0x1EA0, 0x1EFA)}
_DENSE = 32


def fold(token: str) -> str:
    """Lower case without accents."""
    plain = unicodedata.normalize("NFD", token.lower()).replace("đ", "d")
    return "".join(c for c in plain if not unicodedata.combining(c))


def _hash(s: str) -> int:
    h = 2166136261
    for b in s.encode("utf-8", "surrogatepass"):
        h = ((h ^ b) * 16777619) & 0xFFFFFFFF
    return h


def _word_votes() -> dict[str, np.ndarray]:
    votes: dict[str, np.ndarray] = {}
    for language, words in FREQUENT_WORDS.items():
        for w in words.split():
            votes.setdefault(w, np.zeros(len(LANGUAGES), np.float32))[LANGUAGES.index(language)] = 1
    return votes


class Tokens:
    """What is known of each distinct token, kept per worker."""

    def __init__(self, limit: int = 300_000) -> None:
        self.limit = limit
        self.words = _word_votes()
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.plain: list[int] = []
        self.masked: list[int] = []
        self.kind: list[int] = []
        self.votes: list[np.ndarray] = []
        self.capital: list[bool] = []
        self.arrays: tuple | None = None

    def _add(self, token: str) -> int:
        self.arrays = None
        votes = np.zeros(len(LANGUAGES), np.float32)
        kind, plain, masked, capital = _OTHER, _hash(token), _hash(token), False
        if token == "\n":
            kind = _NEWLINE
        elif token[0].isdigit():
            unit = token.lstrip("0123456789.,")
            kind, plain, masked = _NUMBER, _hash("0" + unit), _hash("0" + unit)
        elif token[0].isalpha():
            kind = _WORD
            folded = fold(token)
            plain = _hash(folded)
            capital = token[0].isupper()
            masked = _hash("#") if capital else plain
            votes += self.words.get(folded, 0)
            if any(c in _VI_LETTERS for c in token.lower()):
                votes[0] += 1
            latin = _LETTERS.search(token) is not None
            for c in () if token.isascii() else token:
                if ord(c) < 0x370:
                    continue
                p = ord(c)
                if latin and p < 0x530:
                    continue
                if 0x400 <= p < 0x530:
                    votes[5] += 0.3
                elif 0x4E00 <= p < 0xA000:
                    votes[6] += 0.7
                elif 0x3040 <= p < 0x3100:
                    votes[7] += 0.7
                elif 0xAC00 <= p < 0xD7B0:
                    votes[8] += 0.7
                elif not 0x1E00 <= p < 0x1F00:
                    votes[9] += 0.5
        elif token in _KIND:
            kind = _KIND[token]
        i = len(self.plain)
        self.index[token] = i
        for name, v in (("plain", plain), ("masked", masked), ("kind", kind), ("votes", votes), ("capital", capital)):
            getattr(self, name).append(v)
        return i

    def ids(self, tokens: list[str]) -> np.ndarray:
        get, add = self.index.get, self._add
        return np.array([i if (i := get(t)) is not None else add(t) for t in tokens], np.int64)

    def tables(self) -> tuple:
        if self.arrays is None:
            self.arrays = (
                np.array(self.plain, np.int64),
                np.array(self.masked, np.int64),
                np.array(self.kind, np.int8),
                np.array(self.votes, np.float32).reshape(-1, len(LANGUAGES)),
                np.array(self.capital, bool),
            )
        return self.arrays


_HIDDEN = re.compile("[" + "".join(map(chr, (0xAD, *range(0x200B, 0x2010), 0x2060, 0xFEFF))) + "]")
_WIDE = re.compile(f"[{chr(0xFF01)}-{chr(0xFF5E)}]")
_LETTERS = re.compile("[A-Za-z]")


def _composed(text: str | None) -> str:
    if not text:
        return ""
    if text.isascii():
        return text
    if _HIDDEN.search(text):
        text = _HIDDEN.sub("", text)
    if _WIDE.search(text):
        text = _WIDE.sub(lambda m: chr(ord(m.group()) - 0xFEE0) if m.group().isalnum() else m.group(), text)
    return text if unicodedata.is_normalized("NFC", text) else unicodedata.normalize("NFC", text)


def _names(capital: np.ndarray, opening: np.ndarray) -> np.ndarray:
    """Tokens that belong to a name: capitalized ones, and single ones between two of them."""
    before = np.concatenate([[False], capital[:-1]]) & ~opening
    after = np.concatenate([capital[1:] & ~opening[1:], [False]]) if len(capital) else capital
    return (capital & (~opening | after)) | (before & after)


class Clauses:
    """The clauses of a batch of pairs with their features."""

    def __init__(self, tokens: Tokens, questions: Sequence[str | None], answers: Sequence[str | None], known: np.ndarray | None = None) -> None:
        if len(tokens.index) > tokens.limit:
            tokens.clear()
        n = len(answers)
        qs, answers = [_composed(q) for q in questions], [_composed(a) for a in answers]
        q_lists, a_lists = [_TOKEN.findall(q) for q in qs], [_TOKEN.findall(a) for a in answers]
        q_ids = tokens.ids([t for x in q_lists for t in x])
        a_ids = tokens.ids([t for x in a_lists for t in x])
        plain, masked, kind, votes, capital = tokens.tables()
        q_row = np.repeat(np.arange(n), [len(x) for x in q_lists])
        a_count = np.array([len(x) for x in a_lists], np.int64)
        row = np.repeat(np.arange(n), a_count)
        k = kind[a_ids]
        content = k >= _WORD

        # Clauses end after terminal marks and line ends, and with the answer.
        new_row = np.diff(row, prepend=-1) != 0
        ends_before = np.concatenate([[False], (k[:-1] == _TERMINAL) | (k[:-1] == _NEWLINE)]) if len(k) else new_row
        # A mark that follows a mark (?! or ...) belongs to the same clause.
        ends_before &= ~((k == _TERMINAL) | (k == _CLOSE) & ~new_row)
        clause = np.cumsum(new_row | ends_before) - 1
        words = np.bincount(clause[content], minlength=(clause[-1] + 1) if len(clause) else 0)
        real = words > 0
        renumber = np.cumsum(real) - 1
        use = content & real[clause] if len(clause) else content
        at = renumber[clause[use]]
        ids, rows = a_ids[use], row[use]
        total = int(real.sum())
        self.words = words[real]
        self.row = np.zeros(total, np.int64)
        self.row[at] = rows
        self.lengths = np.bincount(self.row, minlength=n)
        self.has_text = self.lengths > 0
        first = np.diff(self.row, prepend=-1) != 0
        last = np.diff(self.row, append=-1) != 0

        # Language: names (capitalized inside a clause, and what stands between two
        # capitalized words) do not vote.
        opening = np.diff(at, prepend=-1) != 0
        silent = _names(capital[ids], opening)
        silent[1:] |= (kind[ids[:-1]] == _NUMBER) & ~opening[1:]  # units such as the currency
        vote = votes[ids] * ~silent[:, None]
        heads = np.flatnonzero(opening)
        spoken = np.add.reduceat(vote, heads, axis=0) if total else np.zeros((0, len(LANGUAGES)), np.float32)
        kana = spoken[:, 7] > 0
        spoken[kana, 7] += spoken[kana, 6]
        spoken[kana, 6] = 0
        q_vote = votes[q_ids] * ~_names(capital[q_ids], np.diff(q_row, prepend=-1) != 0)[:, None]
        asked = np.zeros((n, len(LANGUAGES)), np.float32)
        if len(q_row):
            q_heads = np.flatnonzero(np.diff(q_row, prepend=-1))
            asked[q_row[q_heads]] = np.add.reduceat(q_vote, q_heads, axis=0)
        allowed = np.zeros((n, len(LANGUAGES)), bool)
        sure = asked.max(1, initial=0) > 0.9
        allowed[np.flatnonzero(sure), asked[sure].argmax(1)] = True
        for i, q in enumerate(qs):
            low = q.lower()
            for m in _ASKED.finditer(q) if any(w in low for w in _ASK_HINTS) else ():
                allowed[i, LANGUAGES.index(m.lastgroup)] = True
        open_row = ~allowed.any(1)
        # Words shared by languages count for each of them, and once among the words heard.
        heard = np.add.reduceat(vote.max(1), heads) if total else np.zeros(0, np.float32)
        fits = (spoken * allowed[self.row]).max(1, initial=0)
        main = spoken.argmax(1)
        mismatch = (heard > 0.9) & (fits < spoken.max(1, initial=0)) & ~open_row[self.row]
        strange = np.where(open_row[self.row], 0, (heard - fits) / (heard + 0.5))

        # The language of the whole answer: a clause of few known words follows the others.
        all_heard = np.bincount(self.row, weights=heard, minlength=n)
        all_fits = np.bincount(self.row, weights=fits, minlength=n)
        far = (all_heard > 1.9) & (all_fits < 0.5 * all_heard) & allowed.any(1)
        all_strange = np.where(allowed.any(1), (all_heard - all_fits) / (all_heard + 0.5), 0)

        # Echo: words and word pairs of the clause that the question has, and the reverse.
        q_content = kind[q_ids] >= _WORD
        span = np.int64(1) << 32
        q_key = q_row[q_content] * span + plain[q_ids[q_content]]
        a_key = rows * span + plain[ids]
        echo = np.isin(a_key, q_key)
        words_echoed = np.bincount(at, weights=echo, minlength=total) / self.words
        a_next = np.flatnonzero(at[1:] == at[:-1])
        a_pair = rows[a_next] * span + (plain[ids[a_next]] * 31 + plain[ids[a_next + 1]]) % span
        qr, qp = q_row[q_content], plain[q_ids[q_content]]
        q_next = np.flatnonzero(qr[1:] == qr[:-1])
        q_pair = qr[q_next] * span + (qp[q_next] * 31 + qp[q_next + 1]) % span
        pairs_echoed = np.bincount(at[a_next], weights=np.isin(a_pair, q_pair), minlength=total) / np.maximum(self.words - 1, 1)
        q_words = np.bincount(qr, minlength=n)
        covered = np.bincount(qr, weights=np.isin(q_key, a_key), minlength=n) / np.maximum(q_words, 1)

        # The end of the answer.
        end_kind = np.full(n, _WORD)
        dots = np.zeros(n, bool)
        open_end = np.zeros(n, bool)
        stub, listed = np.zeros(n, bool), np.zeros(n, bool)
        for i, a in enumerate(answers):
            t = a.rstrip()
            if not t:
                continue
            c = t[-1]
            end_kind[i] = _WORD if c.isalnum() else _KIND.get(c, _OTHER)
            dots[i] = t.endswith("...") or c == "…"
            if end_kind[i] != _TERMINAL:
                open_end[i] = t.rfind("(") > t.rfind(")") or t.rfind("“") > t.rfind("”") or t.count("**") % 2 == 1
            stub[i] = _STUB.search(t, max(0, len(t) - 12)) is not None
            listed[i] = _LIST.match(t) is not None
        r = self.row
        bare = last & (end_kind[r] == _WORD)
        single = self.lengths[r] == 1
        tails = np.append(heads[1:], len(ids)) - 1 if total else heads
        rare = np.zeros(total, bool)
        if known is not None and total:
            end_token = ids[tails]
            rare = bare & ~known[plain[end_token] % len(known)] & (kind[end_token] == _WORD)
        whole = (words_echoed > 0.99) & (pairs_echoed > 0.9) & (covered[r] > 0.95)
        echoing = (words_echoed >= 0.7) & (covered[r] >= 0.5)
        loose = (end_kind != _TERMINAL) | dots | stub | open_end
        columns = [
            last & (end_kind[r] == _CLOSE), last & (end_kind[r] == _OTHER), 3 * whole, echoing, 3 * (far[r] & (fits < heard)), 2 * all_strange[r], mismatch & (strange > 0.75) & (heard >= 3), mismatch & (heard >= 2), last & loose[r], last & ~loose[r],
            np.ones(total), first, last, np.log1p(self.words), strange, mismatch, heard == 0,
            words_echoed, pairs_echoed, covered[r], (words_echoed > 0.85) & (covered[r] > 0.85), pairs_echoed > 0.8,
            bare, last & (end_kind[r] == _HANGING), last & dots[r], last & stub[r], last & open_end[r],
            last & listed[r], bare & single & (self.words <= 7), rare, last & (end_kind[r] == _OPEN), bare & (self.words <= 2),
        ]
        self.dense = np.stack([np.asarray(c, np.float32) for c in columns], 1) if total else np.zeros((0, _DENSE), np.float32)

        # Only the last clause of an answer can be unfinished.
        self.barred = np.zeros((total, 5), bool)
        self.barred[:, UNFINISHED] = ~last
        self.allowed = allowed
        self.foreign_words = np.bincount(r, weights=np.where(mismatch, self.words, 0), minlength=n)

        # Hashed words, word pairs, and the last words of an answer without an end mark.
        one = plain[ids] % BUCKETS
        two = (plain[ids[a_next]] * 31 + plain[ids[a_next + 1]] * 17 + 7) % BUCKETS
        # Long clauses must not drown the other features by their mass of words.
        weight = (1 / np.sqrt(2 * np.maximum(self.words, 1))).astype(np.float32)
        parts_at, parts_id, parts_value = [at, at[a_next]], [one, two], [weight[at], weight[at[a_next]]]
        cut = last & ((end_kind[r] != _TERMINAL) | dots[r])
        tail = tails[cut] if total else tails
        clause_of = np.flatnonzero(cut)
        code = np.full(len(tail), 977, np.int64)
        alive = np.ones(len(tail), bool)
        for back in range(4):
            j = tail - back
            alive &= (j >= 0) & (at[np.maximum(j, 0)] == clause_of)
            code = (code * 1000003 + masked[ids[np.maximum(j, 0)]] + back) & 0xFFFFFFFF
            parts_at.append(clause_of[alive])
            parts_id.append(code[alive] % BUCKETS)
            parts_value.append(np.ones(int(alive.sum()), np.float32))
        joined = np.concatenate(parts_at)
        order = np.argsort(joined, kind="stable")
        self.ids = np.concatenate(parts_id)[order]
        self.values = np.concatenate(parts_value)[order]
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(joined, minlength=total))]).astype(np.int64)
        self.vocabulary = plain[ids]


def _training_pairs(rows: list[tuple[str, str]], rng: np.random.Generator) -> list[tuple[str, str, int, bool]]:
    """(question, answer, tag, whole): the tag of the whole answer, or of its last clause only."""
    lines = lambda s: [x for x in s.strip().split("\n") if x]
    pick = lambda seq: seq[int(rng.integers(len(seq)))]
    plain = lambda s: "".join(c for c in unicodedata.normalize("NFD", s) if not unicodedata.combining(c)).replace("đ", "d").replace("Đ", "D")
    cues = re.compile(r"xin l[oỗ]i|kh[oô]ng (?:th[eể]|bi[eế]t|[đd][uủ]|c[oó])|t[uừ] ch[oố]i|r[aấ]t ti[eế]c|ngo[aà]i ph[aạ]m vi|ch[uư]a (?:t[iì]m th[aấ]y|[đd][uư][oợ]c cung c[aấ]p|c[oó] th[oô]ng tin)|xin ph[eé]p|kh[oô]ng t[uư] v[aấ]n|kh[oô]ng r[oõ]|outside (?:what|the)|could not find|not able|apolog|sorry|cannot|can't|unable|decline|say nothing|kh[oô]ng [đd][uượơ]+c ph[eé]p|kh[oô]ng [đd][eề] c[aậ]p", re.IGNORECASE)
    questions = [q for q, _ in rows if re.search(r"\w", q)] or ["Vé vào cổng giá bao nhiêu?", "How much is the ticket?"]
    places = sorted({m for q in questions for m in re.findall(r"(?:[A-ZĐ][^\W\d_]*\s){1,2}[A-ZĐÁÂẤẨỔỐÔ][^\W\d_]*", q)}) or ["Hồ Xanh"]
    phrases = [m for _, a in rows for m in re.findall(r"[,:] (\w+ \w+(?: \w+)?)(?=,| và| and)", a)] or ["chè bắp", "xôi sen"]
    made: list[tuple[str, str, int, bool]] = []
    complete = re.compile(r"[.!?。](?:\s*(?:\[\d+\]|[^\w\s]))*\s*$")
    for q, a in rows:
        if not complete.search(a) or a.rstrip().endswith(("...", "…")) or cues.search(a):
            continue
        made.append((q, a, ANSWER, True))
        if rng.random() < 0.5:
            made.append((q, pick(OPENINGS) + a, ANSWER, True))
        bare = re.sub(r"[\s.!。]+$", "", complete.sub("", a))
        if bare.strip():
            made.append((q, bare, ANSWER, True))
            made.append((q, bare + pick((" (theo tài liệu)", " [1]", " 😊", "!", " v.v.", " (nguồn: sách hướng dẫn)", ". 🙏", ". (xem trang 2)", "! (see the map)")), ANSWER, True))
            items = [x.strip(" .") for x in re.split(r"(?<=[.!?])\s+", a) if x.strip(" .")]
            mark = pick(("- ", "* ", "• "))
            made.append((q, "\n".join(mark + x for x in items), ANSWER, True))
        # Cuts: after a word or inside one, never at the end of a sentence.
        for _ in range(3):
            spots = [m.end() for m in re.finditer(r"\w+(?=[\s,;:]*\s\w)", a)]
            if len(spots) < 3:
                break
            at = pick(spots[1:])
            cut = a[:at]
            if rng.random() < 0.35:
                word = re.search(r"[^\W\d_]{3,}$", cut)
                if word:
                    cut = cut[: word.start() + int(rng.integers(1, len(word.group())))]
            made.append((q, cut + pick(CUT_ENDS), UNFINISHED, False))
        if rng.random() < 0.15:
            made.append((q, a.rstrip() + "\n1. " + pick(places) + "\n2. " + pick(places) + "\n3.", UNFINISHED, False))
    for q in questions:
        text = pick(ECHO_FRAMES).format(q=pick((q, q, q.rstrip(" ?.!"), q.lower(), q.upper(), plain(q), q.split("\n")[0], "  " + q.replace(" ", "  "))))
        made.append((q, text, ECHO, True))
        if rng.random() < 0.5:
            made.append((q, pick((q.rstrip(" ?.!"), q + "\n" + q, q)), ECHO, True))
        # A question repeated and then answered, and a short direct answer, are answers.
        if rng.random() < 0.3 and rows:
            made.append((q, pick(("{q} {a}", "{q} — {a}", "{q}: {a}", "{q}\n{a}")).format(q=q, a=pick(("Có, từ tháng 3 trở đi", "Khoảng 20 km", pick(places) + " nhé bạn", "9 giờ 30"))), -1, True))
        home = "vi" if re.search(f"[{''.join(sorted(_VI_LETTERS))}]", q.lower()) and not re.match(r"\W*[A-Z]?[a-z]+ [a-z]+ [a-zI]+\b", q) else None
        if home and rng.random() < 0.4:
            made.append((q, pick(phrases) + pick((" và ", ", ", " hoặc ")) + pick(phrases), ANSWER, True))
        if home and rng.random() < 0.5:
            made.append((q, pick(("Có, từ tháng 3 trở đi", "Khoảng 20 km", "9 giờ 30", "50.000 đồng", "50,000 VND", "120k", pick(places) + " nhé bạn", "Đi phà rồi đi bộ 9 phút 🙂", "xôi sen và chè bắp", *SHORT_ANSWERS)), ANSWER, True))
        asks = {k for k in ASKED if re.search(ASKED[k], q, re.IGNORECASE)}
        for text, tag, times in ((REFUSALS, REFUSAL, 0.9), (NOT_REFUSALS, ANSWER, 0.6)):
            if rng.random() < times:
                # A sound answer speaks the language of the question.
                own = [x for x in lines(text) if x.isascii() == (home is None)]
                some = lines(text) if tag == REFUSAL and rng.random() < 0.08 else own
                line = pick(some).format(x=pick(places))
                if rng.random() < 0.15:
                    line = plain(line)
                made.append((q, pick(OPENINGS) + line, tag, True))
        if home and rng.random() < 0.9:
            language = pick([k for k in SENTENCES if k != home and k not in asks])
            some = SENTENCES[language].split("|")
            made.append((q, pick(OPENINGS) + " ".join(pick(some).format(x=pick(places)) for _ in range(int(rng.integers(1, 4)))), FOREIGN, True))
            if rng.random() < 0.4:
                made.append((q, plain(" ".join(pick(SENTENCES["vi"].split("|")).format(x=pick(places)) for _ in range(2))), ANSWER, True))
    for _ in range(300):
        language = pick(("en", "fr", "de", "es"))
        q = pick(SENTENCES[language].split("|")).format(x=pick(places)).rstrip(".") + "?"
        other = pick([k for k in SENTENCES if k != language])
        made.append((q, pick(SENTENCES[other].split("|")).format(x=pick(places)), FOREIGN, True))
        made.append((q, pick(SENTENCES[language].split("|")).format(x=pick(places)), ANSWER, True))
    return made


class Tagger:
    """The trained field with the words it knows."""

    def __init__(self, crf: ChainCRF, known: np.ndarray) -> None:
        self.crf, self.known = crf, known

    def defects(self, tokens: Tokens, questions: Sequence[str | None], answers: Sequence[str | None]) -> list[str | None]:
        """The defect of each pair, or none."""
        c = Clauses(tokens, questions, answers, self.known)
        n = len(answers)
        scores = self.crf.emissions(c.dense, c.ids, c.values, c.starts)
        scores[c.barred] = -1e4
        tags = self.crf.decode(scores, c.lengths)
        share = np.zeros((n, 5))
        np.add.at(share, (c.row, tags), c.words)
        share /= np.maximum(share.sum(1, keepdims=True), 1)
        last = np.full(n, ANSWER)
        ends = np.cumsum(c.lengths) - 1
        last[c.has_text] = tags[ends[c.has_text]]
        out: list[str | None] = []
        for i in range(n):
            s = share[i]
            if not c.has_text[i]:
                out.append("empty")
            elif s[ECHO] >= 0.75:
                out.append("copy")
            elif s[REFUSAL] >= 0.5:
                out.append("refusal")
            elif s[FOREIGN] >= 0.5:
                out.append("other_language")
            elif last[i] == UNFINISHED:
                out.append("truncated")
            else:
                out.append(None)
        return out


#: Bits of the table of known words, and of one of its parts.
WORD_BITS, PART_BITS = 1 << 20, 1 << 15


def _own_words(text: str) -> list[str]:
    """The words of a text without its last one, which may be cut off."""
    return _WORDS.findall(_composed(text))[:-1]


def _mark(table: np.ndarray, found: set[str]) -> None:
    table[[_hash(fold(w)) % WORD_BITS for w in found]] = True


def known_words(answers: DataFrame, column: str) -> np.ndarray:
    """A table of bits of the words of all answers, by the hash of their folded form.

    Every partition marks its own bits, which meet by or; 32 rows of 4 kB reach the
    driver, however many answers there are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[str] = set()
        marked = np.zeros(WORD_BITS, bool)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text:
                    seen.update(_own_words(text))
            if len(seen) > 500_000:
                _mark(marked, seen)
                seen.clear()
        _mark(marked, seen)
        bits = np.packbits(marked, bitorder="little").reshape(-1, PART_BITS // 8)
        used = np.flatnonzero(bits.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array([bits[i].tobytes() for i in used], pa.binary())], names=["part", "bits"])

    met = arrow_map(answers.select(column), run, "part int, bits binary").groupBy("part").agg(F.bitmap_or_agg("bits").alias("bits"))
    table = np.zeros((WORD_BITS // PART_BITS, PART_BITS // 8), np.uint8)
    for r in met.collect():
        table[r["part"]] = np.frombuffer(r["bits"], np.uint8)
    return np.unpackbits(table.ravel(), bitorder="little").astype(bool)


def train_tagger(rows: list[tuple[str, str]], seed: int = 11, known: np.ndarray | None = None) -> Tagger:
    """Train on pairs of the corpus; without any, on the phrases alone.

    ``known`` has the words of all answers (see ``known_words``); without it the words of
    ``rows`` count.
    """
    rng = np.random.default_rng(seed)
    tokens = Tokens()
    # Answers in a strange language, or without words, teach nothing about sound ones.
    c = Clauses(tokens, [q for q, _ in rows], [a for _, a in rows])
    kept = np.flatnonzero(c.foreign_words == 0)
    # Sound answers beside questions in another language: the same words become foreign.
    speaks = c.allowed[kept].argmax(1) if len(kept) else kept
    swapped = []
    for i in rng.permutation(len(kept))[:1200]:
        others = [g for g in np.unique(speaks) if g != speaks[i] and c.allowed[kept[i]].sum() == 1]
        if others:
            j = rng.choice(np.flatnonzero(speaks == rng.choice(others)))
            swapped.append((rows[kept[j]][0], OPENINGS[int(rng.integers(len(OPENINGS)))] + rows[kept[i]][1]))
            swapped.append((rows[kept[i]][0], OPENINGS[int(rng.integers(len(OPENINGS)))] + rows[kept[j]][1]))
    rows = [rows[i] for i in kept]
    made = _training_pairs(rows, rng)
    if swapped:
        c = Clauses(tokens, [q for q, _ in swapped], [a for _, a in swapped])
        spoken = np.bincount(c.row, weights=c.words, minlength=len(swapped))
        made += [(q, a, FOREIGN, True) for (q, a), f, w in zip(swapped, c.foreign_words, spoken, strict=True) if f > 0.6 * w]
    known = np.zeros(WORD_BITS, bool) if known is None else known.copy()
    _mark(known, {w for _, a in rows for w in _own_words(a)} | {w for text in (REFUSALS, NOT_REFUSALS, *SENTENCES.values()) for w in _WORDS.findall(text)})
    c = Clauses(tokens, [m[0] for m in made], [m[1] for m in made], known)
    gold = np.full(len(c.row), ANSWER, np.int64)
    whole = np.array([m[3] for m in made])
    tag = np.array([m[2] for m in made])
    first = np.diff(c.row, prepend=-1) != 0
    last = np.diff(c.row, append=-1) != 0
    gold = np.where(whole[c.row], tag[c.row], np.where(last, tag[c.row], ANSWER))
    # -1: a repeated question followed by an answer.
    gold = np.where(gold == -1, np.where(last & ~first, ANSWER, np.where(first & last, ANSWER, ECHO)), gold)
    crf = ChainCRF(5, _DENSE, BUCKETS)
    # Long answers are learned in parts of TRAIN_CLAUSES, none is left out.
    parts = [part for n in c.lengths if n for part in [TRAIN_CLAUSES] * (n // TRAIN_CLAUSES) + [n % TRAIN_CLAUSES] if part]
    crf.fit(c.dense, c.ids, c.values, c.starts, np.array(parts), gold, epochs=8, batch=768, rate=0.08)
    return Tagger(crf, known)


_tokens: Tokens | None = None


def _worker_tokens() -> Tokens:
    global _tokens
    if _tokens is None:
        _tokens = Tokens()
    return _tokens


def _tag_batches(tagger: Tagger, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _worker_tokens()
        for batch in batches:
            found: list[str | None] = []
            questions, answers = batch.column("question").to_pylist(), batch.column("answer").to_pylist()
            for i in range(0, len(answers), 2048):
                found += tagger.defects(tokens, questions[i : i + 2048], answers[i : i + 2048])
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), pa.array(found, pa.string())], names=[*keep, "defect"])

    return run


def tag_answers(pairs: DataFrame, tagger: Tagger) -> DataFrame:
    """Add ``defect`` to pairs with ``question`` and ``answer``, and drop the texts.

    Null and blank answers are ``empty``; with a null or blank question there is
    nothing to copy and no language to miss. A sound answer has a null defect.
    """
    kinds = dict(pairs.dtypes)
    keep = [c for c in pairs.columns if c not in ("question", "answer", "defect")]
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in keep] + ["defect string"])
    return arrow_map(spread(pairs.select(*keep, "question", "answer")), _tag_batches(tagger, keep), schema)


def sample_pairs(turns: DataFrame, rows: int = SAMPLE_ROWS) -> list[tuple[str, str]]:
    """At most ``rows`` pairs with a question and an answer, the same ones each time."""
    whole = turns.where(F.col("question").rlike(HAS_TEXT) & F.col("answer").rlike(HAS_TEXT))
    share = min(1.0, 2.0 * rows / max(1, turns.count()))
    mark = F.xxhash64("question", "answer")
    if share < 1:
        whole = whole.where(F.pmod(mark, F.lit(1 << 30)) < int(share * (1 << 30)))
    picked = whole.select("question", "answer", mark.alias("mark")).orderBy("mark").limit(rows)
    return [(r["question"], r["answer"]) for r in picked.collect()]


def defective_answers(turns: DataFrame, results: DataFrame, tagger: Tagger | None = None) -> DataFrame:
    """``(tbl, id, defect)`` of chat turns and evaluation results.

    Every version of a turn is tagged where it is read; then the valid version of
    each id is chosen by its small columns: the latest with an answer, then by a hash of
    its texts. Texts are shuffled only where the input has fewer partitions than cores
    (see ``runtime.spread``). A refusal is no defect where ``expected_behavior`` is ``refuse``. Null ids are left out.
    """
    if tagger is None:
        tagger = train_tagger(sample_pairs(turns), known=known_words(turns, "answer"))
    both = turns.select(
        F.lit("chat_turns").alias("tbl"), "id", "created_at", has_text(F.col("question")).alias("has_q"),
        F.lit(False).alias("may_refuse"), "question", "answer",
    ).unionByName(
        results.select(
            F.lit("eval_results").alias("tbl"), "id", F.lit(None).cast("timestamp").alias("created_at"), F.lit(True).alias("has_q"),
            F.coalesce(F.col("expected_behavior") == "refuse", F.lit(False)).alias("may_refuse"), "question", "answer",
        )
    )
    both = both.where(F.col("id").isNotNull()).withColumns({"has_a": has_text(F.col("answer")), "digest": F.xxhash64("question", "answer")})
    tagged = tag_answers(both, tagger)
    defect = F.when(F.col("may_refuse") & (F.col("defect") == "refusal"), None).otherwise(F.col("defect"))
    valid = tagged.groupBy("tbl", "id").agg(F.max(F.struct("has_a", "created_at", "has_q", "digest", defect.alias("defect"))).alias("v"))
    return valid.where("v.defect is not null").select("tbl", "id", "v.defect")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns and evaluation results with a defective answer."""
    return defective_answers(table(spark, sf_dir, "chat_turns"), table(spark, sf_dir, "eval_results"))
