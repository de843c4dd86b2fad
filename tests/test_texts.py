import pytest
from pyspark.sql import functions as F

from lotusflow.functions import text as T
from lotusflow.operators import chunking
from lotusflow.plans import texts


def one(spark, expression, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return row.select(expression).first()[0]


def test_query_normalization(spark):
    assert one(spark, T.normalize_query(F.col("q")), q="  Hello   WORLD  ") == "hello world"


@pytest.mark.parametrize(
    ("raw", "clean"),
    [
        ("{{a {{b}} c}} x", "x"),
        ("a<ref name=1>cite</ref> b", "a b"),
        ("<b>x</b>", "x"),
        ("[[Việt Nam|Nam]] và [[Lịch sử]]", "Nam và Lịch sử"),
        ("[[a|b|c]] [[]]", "b|c [[]]"),
        ("'''x''' ''y'' __NOTOC__", "x y"),
        ("a\n\n\n\nb  \t c", "a\n\nb c"),
        ("{{ unbalanced", "{{ unbalanced"),
    ],
)
def test_cleaning(spark, raw, clean):
    assert one(spark, T.clean_text(F.col("t")), t=raw) == clean


def test_normalization(spark):
    assert one(spark, T.normalize_text(F.col("t")), t=" ｆｕｌｌ\r\nx\t\ty\r\rz\n\n\n\nw ") == "full\nx y\n\nz\n\nw"
    assert one(spark, T.normalize_text(F.col("t")), t=None) == ""


def test_documents_not_yet_normalized_are_normalized_too(spark, tmp_path):
    raw = "document_id string, source_id string, title string, raw_content string, metadata map<string,string>"
    done = "document_id string, source_id string, title string, content string, metadata map<string,string>"
    rows = [("a", "s", " A ", "x\t\ty", None), ("b", "s", "B", "ｆｕｌｌ\r\nz", None), ("b", "s", "B", "ｆｕｌｌ\r\nz", None), ("c", None, None, None, None)]
    spark.createDataFrame(rows, raw).write.parquet(f"{tmp_path}/raw_documents.parquet")
    spark.createDataFrame([("a", "s", "A", "x y", None)], done).write.parquet(f"{tmp_path}/normalized_documents.parquet")
    got = {tuple(r) for r in texts.normalized_texts(spark, str(tmp_path)).collect()}
    assert got == {("a", "s", "A", "x y"), ("b", "s", "B", "full\nz"), ("c", None, None, "")}


def test_tokens_and_estimates(spark):
    assert [one(spark, T.estimated_tokens(F.col("t")), t=t) for t in ("", "abc", "abcdef", None)] == [0, 1, 2, 0]
    assert one(spark, T.turn_tokens(F.col("a"), F.col("b")), a="abc", b="abcdefgh") == 4
    assert one(spark, T.token_count(F.col("t")), t="a b c") == 3


@pytest.mark.parametrize(
    ("question", "answer", "left"),
    [
        ("Hà Nội ở đâu?", "Hà Nội ở đâu? Ở miền Bắc Việt Nam.", "Ở miền Bắc Việt Nam."),
        ("Hà Nội", "Hà Nội là thủ đô của Việt Nam", "Hà Nội là thủ đô của Việt Nam"),
        ("Hà  Nội ở đâu", "hà nội ở  đâu\n\nỞ miền Bắc nhé", "hà nội ở  đâu\n\nỞ miền Bắc nhé"),
        ("Hà  Nội ở đâu", "hà nội ở  đâu:\n\nỞ miền Bắc nhé", "Ở miền Bắc nhé"),
        ("a?", "a? b", "a? b"),
        ("x", None, None),
        ("Giá vé?", "Không rõ giá vé", "Không rõ giá vé"),
    ],
)
def test_echo(spark, question, answer, left):
    assert one(spark, T.strip_echo(F.col("q"), F.col("a")), q=question, a=answer) == left


def test_small_parsers(spark):
    assert one(spark, T.fenced_json(F.col("t")), t='```json\n{"a": 1}\n```') == '{"a": 1}'
    assert one(spark, T.suggestion_lines(F.col("t")), t="1. a\n2) b\n\n- c\nd\ne") == ["a", "b", "c", "d"]
    assert one(spark, T.citations(F.col("t")), t="x [2] y [10] z [2]") == ["10", "2"]
    assert one(spark, T.shorten(F.col("t"), 3), t="abcd") == "abc..."
    assert one(spark, T.is_session_id(F.col("t")), t="abc") is False


def test_sections():
    text = "preamble\n# Section A\nbody a\n# Section B\nbody b"
    assert chunking.sections_of(text, "T") == [("", 1, "preamble"), ("Section A", 1, "body a"), ("Section B", 1, "body b")]
    assert chunking.sections_of("", "T") == []
    assert chunking.sections_of("Lịch sử\nnội dung dài, có dấu phẩy.", "T") == [("Lịch sử", 1, "nội dung dài, có dấu phẩy.")]
    assert chunking.sections_of("#\ntext", "T")[0][2] == "#\ntext"


def test_packing_and_windows():
    sizes = [50, 60, 5, 20]
    assert chunking.pack(sizes, 100, lambda i: i == 2) == [[0], [1], [2, 3]]
    words = [str(i) for i in range(25)]
    assert [w.split()[0] for w in chunking.word_windows(" ".join(words), 10, 2)] == ["0", "8", "16"]
    assert chunking.word_windows("a  b", 10, 2) == ["a  b"]


def brute_pieces(content, limit, overlap):
    """Greedy packing written as a plain loop over word counts."""
    import re

    def merge(parts):
        done, now = [], []
        for p in parts:
            if now and sum(len(x.split()) for x in now) + len(p.split()) > limit:
                done.append("\n\n".join(now))
                now = []
            now.append(p)
        return done + (["\n\n".join(now)] if now else [])

    out = []
    for piece in merge([p.strip() for p in content.split("\n\n") if p.strip()]):
        if len(piece.split()) <= limit:
            out.append(piece)
            continue
        sentences = [s.strip() for s in re.split(r"(?<=[.!?;…])\s+", piece) if s.strip()]
        for part in merge(sentences) if len(sentences) > 1 else [piece]:
            w = part.split()
            if len(w) <= limit:
                out.append(part)
                continue
            s = 0
            while True:
                out.append(" ".join(w[s : s + limit]))
                if s + limit >= len(w):
                    break
                s += max(1, limit - overlap)
    return out


def test_recursive_pieces_against_brute_force():
    import random

    r = random.Random(1)
    for _ in range(300):
        text = "".join(r.choice(["a ", "bb ", "c. ", "d! ", "\n\n", "e\n"]) for _ in range(r.randint(0, 120)))
        assert chunking.recursive_pieces(text, 7, 2) == brute_pieces(text, 7, 2)


def documents(spark, rows):
    return spark.createDataFrame(rows, "document_id string, title string, content string")


def test_chunk_pipeline(spark):
    body = " ".join(["từ"] * 30)
    text = f"{body}\n\n# Lịch sử\n\n{body}\n\n* một hai ba\n* bốn năm sáu\n\n# Tham khảo\n\n{body}"
    docs = documents(spark, [("d", "Việt Nam", text), ("e", "x", "A " * 5), ("n", None, None)])
    rows = chunking.valid_chunks(chunking.chunk_documents(docs, limit=50)).orderBy("chunk_order").collect()
    assert {r.document_id for r in rows} == {"d"}
    assert rows[0].content.startswith("This chunk is from the 'Việt Nam' document.")
    assert "specifically the 'Lịch sử' section" in rows[1].content
    assert [r.is_reference_section for r in rows][-1] is True
    assert all(r.token_count >= 20 for r in rows)
    lists = [r for r in rows if "* một" in r.content]
    assert len(lists) == 1 and "* bốn" in lists[0].content


def test_chunk_pipeline_on_an_empty_table(spark):
    assert chunking.chunk_pipeline(documents(spark, [])).count() == 0
