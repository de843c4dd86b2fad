"""Queries of text processing and chunking."""

from __future__ import annotations

import unicodedata

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotusflow.functions import text as T
from lotusflow.operators import chunking, ingest
from lotusflow.plans.tables import documents, sql, table, turns
from lotusflow.providers import rewrite_queries
from lotusflow.sources import files


def normalized_texts(spark: SparkSession, sf: str) -> DataFrame:
    """All raw documents normalized, also those the table of normalized documents lacks."""
    made = chunking.normalize_documents(table(spark, sf, "raw_documents"))
    return made.select("document_id", "source_id", "title", "content").distinct()


def _content(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "normalized_documents").select("document_id", "title", "content").distinct()


def clean_markup(spark: SparkSession, sf: str) -> DataFrame:
    """All markup removed from the normalized documents."""
    return chunking.clean_documents(_content(spark, sf)).select("document_id", "content")


def text_measures(spark: SparkSession, sf: str) -> DataFrame:
    """Checksum, tokens, estimated tokens and normalized title of the documents."""
    return documents(spark, sf).select(
        "doc_id",
        T.checksum(F.col("text")).alias("checksum"),
        T.token_count(F.col("text")).cast("long").alias("tokens"),
        T.estimated_tokens(F.col("text")).cast("long").alias("estimated"),
        T.normalize_query(F.col("title")).alias("query"),
    )


def line_kinds(spark: SparkSession, sf: str) -> DataFrame:
    """How many lines of each document are list items, look like headings, and open sections of references."""
    return chunking.describe_lines(_content(spark, sf))


def sections(spark: SparkSession, sf: str) -> DataFrame:
    """The sections of the cleaned documents."""
    return chunking.detect_sections(chunking.clean_documents(_content(spark, sf)))


def structure_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Valid chunks with lists kept whole, as in production (200 tokens)."""
    return chunking.chunk_pipeline(
        _content(spark, sf), [chunking.clean_documents, lambda d: chunking.chunk_documents(d, limit=200), chunking.valid_chunks]
    )


def recursive_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Valid chunks by paragraphs, sentences and windows of words."""
    return chunking.chunk_pipeline(
        _content(spark, sf), [chunking.clean_documents, lambda d: chunking.chunk_documents(d, structured=False), chunking.valid_chunks]
    )


def word_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Windows of 300 words sharing 40, of the documents."""
    return chunking.window_texts(documents(spark, sf), "doc_id", "text")


def context_prefixes(spark: SparkSession, sf: str) -> DataFrame:
    """The sentence before each chunk that tells its place; null where the chunk has no path."""
    return chunking.prefix_chunks(table(spark, sf, "chunks")).distinct()


def enriched_metadata(spark: SparkSession, sf: str) -> DataFrame:
    """The metadata of the normalized documents with what they lack, one row per entry."""
    docs = table(spark, sf, "normalized_documents").select("document_id", "source_id", "title", "metadata")
    return chunking.enrich_metadata(docs).select("document_id", F.explode("metadata").alias("name", "value")).distinct()


def valid_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks of a permitted size, counted anew."""
    chunks = table(spark, sf, "chunks").withColumn("token_count", T.token_count(F.col("content")))
    return chunking.valid_chunks(chunks).select("id", "token_count").distinct()


def ingest_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Document rows with checksum and a status from the index."""
    chunks = table(spark, sf, "chunks").select("document_id").distinct().withColumn("has", F.lit(True))
    docs = table(spark, sf, "raw_documents").select("document_id", "source_id", T.checksum(F.coalesce("raw_content", F.lit(""))).alias("checksum")).distinct()
    return docs.join(chunks, "document_id", "left").select(
        "document_id", "source_id", "checksum", F.when(F.col("has"), "indexed").otherwise("pending").alias("status")
    )


def ingest_job(spark: SparkSession, sf: str) -> DataFrame:
    """The whole way from raw documents to chunks: each document with its checksum and its number of chunks."""
    raw = table(spark, sf, "raw_documents")
    counted = ingest.chunk_rows(raw).groupBy(F.col("document_id").alias("id")).agg(F.count(F.lit(1)).alias("chunks"))
    return ingest.document_rows(raw, "indexed").join(counted, "id", "left").select("id", "source_id", "checksum", "status", F.coalesce("chunks", F.lit(0)).alias("chunks"))


def rewritten_queries(spark: SparkSession, sf: str) -> DataFrame:
    """The titles of the documents as queries, rewritten by nobody."""
    asked = documents(spark, sf).where("title is not null").select("doc_id", F.col("title").alias("query"))
    return rewrite_queries(asked).select("doc_id", "rewritten_query", "intent")


def metadata_json(spark: SparkSession, sf: str) -> DataFrame:
    """The metadata of the raw documents written as JSON and read again, one row per entry."""
    text = table(spark, sf, "raw_documents").select("document_id", files.dump_json(F.col("metadata")).alias("j"))
    return text.select("document_id", F.explode(files.load_json(F.col("j"), "map<string,string>")).alias("name", "value")).distinct()


def request_checks(spark: SparkSession, sf: str) -> DataFrame:
    """Whether the service would accept the session id and the question of each turn."""
    return turns(spark, sf).select(
        "id", F.coalesce(T.is_session_id(F.col("session_id")), F.lit(False)).alias("good_session"), F.coalesce(T.is_question(F.col("question")), F.lit(False)).alias("good_question")
    ).distinct()


QUERIES = {
    f.__name__: f
    for f in (
        normalized_texts, clean_markup, text_measures, line_kinds, sections, structure_chunks, recursive_chunks, word_windows, context_prefixes,
        enriched_metadata, valid_chunks, ingest_documents, ingest_job, rewritten_queries, metadata_json, request_checks,
    )
}

_templates = "content"
for _ in range(30):
    _templates = f"regexp_replace({_templates}, '\\{{\\{{[^{{}}]*?\\}}\\}}', ' ', 'g')"

#: The steps of the cleaning, from ``n(document_id, title, content)`` to ``f(document_id, title, t)``.
_CLEAN = rf"""n AS (SELECT DISTINCT document_id, title, content FROM normalized_documents),
a AS (SELECT document_id, title, {_templates} AS t FROM n),
b AS (SELECT document_id, title, regexp_replace(regexp_replace(t, '(?is)<ref[^>]*>.*?</ref>', ' ', 'g'), '<[^>]+>', ' ', 'g') AS t FROM a),
c AS (SELECT document_id, title, regexp_replace(t, '\[\[(?:[^\[\]|]*\|)?[@B@]*([^\[\]]*?)[@B@]*\]\]', '\1', 'g') AS t FROM b),
e AS (SELECT document_id, title, regexp_replace(regexp_replace(t, '''''''|''''', '', 'g'), '__NOTOC__|__NOEDITSECTION__|__TOC__', ' ', 'g') AS t FROM c),
f AS (SELECT document_id, title, regexp_replace(regexp_replace(t, '[ \t]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g') AS t FROM e)"""

_HEADING = r"""(length(@) BETWEEN 1 AND 100 AND len(regexp_extract_all(@, '[^@B@]+')) <= 10 AND NOT regexp_matches(@, '[.!?;:,]\z')
         AND regexp_matches(@, '^[A-Z\x{C0}-\x{1EF8}\x{110}0-9]'))"""
_REFERENCES = """('tham khảo', 'liên kết ngoài', 'xem thêm', 'chú thích', 'tài liệu tham khảo', 'nguồn tham khảo', 'đọc thêm', 'tham khảo thêm', 'ghi chú',
  'chú giải', 'trích dẫn', 'references', 'see also', 'external links', 'notes', 'footnotes', 'further reading', 'bibliography')"""


def _strip(column: str) -> str:
    return rf"regexp_replace({column}, '\A[@B@]+|[@B@]+\z', '', 'g')"


def _words(column: str) -> str:
    return f"len(regexp_extract_all({column}, '[^@B@]+'))"


#: Sections of the cleaned texts: ``sec(rid, document_id, doc_title, section_no, section_title, level, content)``.
_SECTIONS = rf"""{_CLEAN},
g AS (SELECT row_number() OVER () AS rid, document_id, coalesce(title, '') AS doc_title, {_strip("t")} AS text FROM f),
m AS (SELECT *, regexp_matches(text, '(?m)^#{{1,6}}[@B@]*.+$') AS marked FROM g WHERE text <> ''),
l AS (SELECT *, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM m),
k AS (SELECT *, {_strip("line")} AS bare FROM l),
h AS (SELECT *, CASE WHEN marked THEN regexp_matches(line, '^#{{1,6}}[@B@]*.+$') ELSE {_HEADING.replace("@ ", "bare ").replace("(@", "(bare").replace("@,", "bare,")} END AS head FROM k),
s AS (SELECT *, sum(CASE WHEN head THEN 1 ELSE 0 END) OVER (PARTITION BY rid ORDER BY i) AS part FROM h),
t AS (SELECT rid, part, max(CASE WHEN head THEN CASE WHEN marked THEN {_strip("regexp_extract(line, '^(#{1,6})[@B@]*(.+)$', 2)")} ELSE bare END END) AS section_title,
      max(CASE WHEN head AND marked THEN length(regexp_extract(line, '^(#{{1,6}})', 1)) END) AS level,
      count(*) FILTER (WHERE NOT head) AS body, string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT head) AS content FROM s GROUP BY rid, part),
u AS (SELECT rid, CAST(row_number() OVER (PARTITION BY rid ORDER BY part) - 1 AS INTEGER) AS section_no, coalesce(section_title, '') AS section_title,
      CAST(coalesce(level, 1) AS INTEGER) AS level, {_strip("content")} AS content FROM t WHERE body > 0),
sec AS (SELECT m.rid, document_id, doc_title, section_no, section_title, level, content FROM u JOIN m ON m.rid = u.rid
        UNION ALL SELECT rid, document_id, doc_title, 0, doc_title, 1, text FROM m WHERE rid NOT IN (SELECT rid FROM u))"""


def _packed(name: str, items: str, limit: int) -> str:
    """Greedy groups of ``items(key, i, size, opens, part)`` as ``name(key, grp, content)``."""
    return f"""{name}_walk AS (
  SELECT key, i, 1 AS grp, {limit} - size AS room FROM {items} WHERE i = 1
  UNION ALL SELECT x.key, x.i, CASE WHEN x.opens OR x.size > w.room THEN w.grp + 1 ELSE w.grp END, CASE WHEN x.opens OR x.size > w.room THEN {limit} ELSE w.room END - x.size
  FROM {name}_walk w JOIN {items} x ON x.key = w.key AND x.i = w.i + 1),
{name} AS (SELECT x.key, w.grp, string_agg(x.part, chr(10) || chr(10) ORDER BY x.i) AS content FROM {name}_walk w JOIN {items} x ON x.key = w.key AND x.i = w.i GROUP BY x.key, w.grp)"""


#: Paragraphs of the sections, ``para(key, i, part, size, opens)`` with ``key`` of document and section.
_PARAGRAPHS = rf"""sid AS (SELECT *, row_number() OVER (ORDER BY rid, section_no) AS key FROM sec),
raw_para AS (SELECT key, unnest(string_split(content, chr(10) || chr(10))) AS p, generate_subscripts(string_split(content, chr(10) || chr(10)), 1) AS pos FROM sid),
full_para AS (SELECT key, pos, {_strip("p")} AS part FROM raw_para WHERE {_strip("p")} <> ''),
para AS (SELECT key, row_number() OVER (PARTITION BY key ORDER BY pos) AS i, part, {_words("part")} AS size,
         len(list_filter(string_split(part, chr(10)), lambda x: {_strip("x")} <> '' AND NOT regexp_matches({_strip("x")}, '^([*#\-]|\p{{Nd}}+[.)][@B@])'))) = 0 AS opens FROM full_para)"""

_CHUNK_ROWS = """SELECT document_id, chunk_order, content, CAST(n AS INTEGER) AS token_count,
  CASE WHEN section_title <> '' THEN [doc_title, section_title] ELSE [doc_title] END AS section_path, section_title, @REF@ AS is_reference_section,
  sha256(document_id || '|' || chunk_order) AS id FROM numbered WHERE n BETWEEN 20 AND 2000 AND @STRIP@ <> ''"""


def _compatible_rows() -> str:
    """Code points with a compatibility form, each with that form, as SQL values."""
    rows = []
    for point in range(0x110000):
        c = chr(point)
        if unicodedata.category(c) != "Cs" and (full := unicodedata.normalize("NFKD", c)) != unicodedata.normalize("NFD", c):
            quoted = full.replace("'", "''")
            rows.append(f"({point}, '{quoted}')")
    return ", ".join(rows)


_NORMALIZED = rf"""comp(point, form) AS (VALUES {_compatible_rows()}),
r AS (SELECT row_number() OVER () AS rid, document_id, source_id, title, coalesce(raw_content, '') AS t FROM (SELECT DISTINCT document_id, source_id, title, raw_content FROM raw_documents)),
ch AS (SELECT rid, unnest(string_split(t, '')) AS c, generate_subscripts(string_split(t, ''), 1) AS i FROM r WHERE t <> ''),
jo AS (SELECT rid, nfc_normalize(string_agg(coalesce(form, c), '' ORDER BY i)) AS t FROM ch LEFT JOIN comp ON point = unicode(c) GROUP BY rid),
lf AS (SELECT rid, regexp_replace(t, '\r\n?', chr(10), 'g') AS t FROM jo),
bl AS (SELECT rid, regexp_replace(regexp_replace(t, '[ \t]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g') AS t FROM lf),
normal AS (SELECT DISTINCT document_id, source_id, {_strip("title")} AS title, coalesce({_strip("bl.t")}, '') AS content FROM r LEFT JOIN bl ON bl.rid = r.rid)"""

_INGEST = f"""{_NORMALIZED}, {_SECTIONS.replace("FROM normalized_documents", "FROM normal")}, {_PARAGRAPHS}, {_packed("packed", "para", 300)},
counted AS (SELECT document_id, {_words("""'This chunk is from the ''' || doc_title || ''' document' || CASE WHEN section_title <> '' THEN ', specifically the ''' || section_title || ''' section' ELSE '' END
  || '.' || chr(10) || chr(10) || packed.content""")} AS n FROM packed JOIN sid ON sid.key = packed.key)"""

ORACLES = {
    "ingest_job": f"""WITH RECURSIVE {_INGEST}
SELECT d.document_id AS id, d.source_id, sha256(coalesce(d.raw_content, '')) AS checksum, 'indexed' AS status, CAST(coalesce(c.chunks, 0) AS BIGINT) AS chunks
FROM (SELECT DISTINCT document_id, source_id, raw_content FROM raw_documents) d
LEFT JOIN (SELECT document_id, count(*) AS chunks FROM counted WHERE n BETWEEN 20 AND 2000 GROUP BY document_id) c ON c.document_id = d.document_id""",
    "rewritten_queries": "SELECT doc_id, trim(regexp_replace(lower(title), '[@B@]+', ' ', 'g')) AS rewritten_query, 'factual' AS intent FROM documents WHERE title IS NOT NULL",
    "metadata_json": "SELECT DISTINCT document_id, unnest(map_keys(metadata)) AS name, unnest(map_values(metadata)) AS value FROM raw_documents",
    "normalized_texts": f"WITH {_NORMALIZED} SELECT document_id, source_id, title, content FROM normal",
    "clean_markup": rf"WITH {_CLEAN} SELECT document_id, {_strip('t')} AS content FROM f",
    "sections": f"WITH {_SECTIONS} SELECT document_id, section_no, section_title, level, content FROM sec",
    "structure_chunks": f"""WITH RECURSIVE {_SECTIONS}, {_PARAGRAPHS}, {_packed("packed", "para", 200)},
numbered AS (SELECT document_id, doc_title, section_title, CAST(row_number() OVER (PARTITION BY rid ORDER BY section_no, grp) - 1 AS INTEGER) AS chunk_order,
  'This chunk is from the ''' || doc_title || ''' document' || CASE WHEN section_title <> '' THEN ', specifically the ''' || section_title || ''' section' ELSE '' END
  || '.' || chr(10) || chr(10) || packed.content AS content, {_words("""'This chunk is from the ''' || doc_title || ''' document' || CASE WHEN section_title <> '' THEN ', specifically the ''' || section_title || ''' section' ELSE '' END
  || '.' || chr(10) || chr(10) || packed.content""")} AS n FROM packed JOIN sid ON sid.key = packed.key)
{_CHUNK_ROWS.replace("@STRIP@", _strip("content")).replace("@REF@", f"lower({_strip('section_title')}) IN {_REFERENCES}")}""",
    "recursive_chunks": rf"""WITH RECURSIVE {_SECTIONS}, {_PARAGRAPHS.replace("= 0 AS opens", "< 0 AS opens")}, {_packed("packed", "para", 300)},
pieces AS (SELECT key, grp, content, {_words("content")} AS n, row_number() OVER (ORDER BY key, grp) AS pid FROM packed),
cut AS (SELECT pid, unnest(string_split(regexp_replace(content, '([.!?;…])[@B@]+', '\1' || chr(1), 'g'), chr(1))) AS p,
        generate_subscripts(string_split(regexp_replace(content, '([.!?;…])[@B@]+', '\1' || chr(1), 'g'), chr(1)), 1) AS pos FROM pieces WHERE n > 300),
sent AS (SELECT pid AS key, row_number() OVER (PARTITION BY pid ORDER BY pos) AS i, {_strip("p")} AS part, {_words("p")} AS size, false AS opens FROM cut WHERE {_strip("p")} <> ''),
{_packed("joined", "sent", 300)},
parts AS (SELECT pid, 1 AS sub, content, n FROM pieces WHERE n <= 300
          UNION ALL SELECT key, grp, content, {_words("content")} FROM joined WHERE key IN (SELECT key FROM sent GROUP BY key HAVING count(*) > 1)
          UNION ALL SELECT pid, 1, content, n FROM pieces WHERE n > 300 AND pid IN (SELECT key FROM sent GROUP BY key HAVING count(*) = 1)),
wins AS (SELECT pid, sub, 0 AS win, content FROM parts WHERE n <= 300
         UNION ALL SELECT pid, sub, win, array_to_string(w[win * 260 + 1 : win * 260 + 300], ' ') FROM
           (SELECT pid, sub, regexp_extract_all(content, '[^@B@]+') AS w, unnest(range(0, CAST(ceil((n - 300) / 260) AS BIGINT) + 1)) AS win FROM parts WHERE n > 300)),
numbered AS (SELECT document_id, doc_title, section_title, CAST(row_number() OVER (PARTITION BY rid ORDER BY section_no, pieces.grp, sub, win) - 1 AS INTEGER) AS chunk_order,
  wins.content, {_words("wins.content")} AS n FROM wins JOIN pieces ON pieces.pid = wins.pid JOIN sid ON sid.key = pieces.key)
{_CHUNK_ROWS.replace("@STRIP@", _strip("content")).replace("@REF@", "false")}""",
    "enriched_metadata": """WITH d AS (SELECT DISTINCT document_id, source_id, title, metadata FROM normalized_documents)
SELECT DISTINCT document_id, unnest(map_keys(metadata)) AS name, unnest(map_values(metadata)) AS value FROM d
UNION SELECT document_id, 'title', title FROM d WHERE metadata IS NULL OR NOT list_contains(map_keys(metadata), 'title')
UNION SELECT document_id, 'source_id', source_id FROM d WHERE metadata IS NULL OR NOT list_contains(map_keys(metadata), 'source_id')
UNION SELECT document_id, 'document_id', document_id FROM d WHERE metadata IS NULL OR NOT list_contains(map_keys(metadata), 'document_id')""",
    "text_measures": """SELECT doc_id, sha256(coalesce(text, '')) AS checksum, CAST(len(regexp_extract_all(coalesce(text, ''), '[^@B@]+')) AS BIGINT) AS tokens,
CAST(ceil(length(coalesce(text, '')) / 3) AS BIGINT) AS estimated, trim(regexp_replace(lower(title), '[@B@]+', ' ', 'g')) AS query FROM documents""",
    "word_windows": r"""WITH w AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^@B@]+') AS w FROM documents),
s AS (SELECT doc_id, t, w, unnest(range(0, CASE WHEN len(w) > 300 THEN CAST(ceil((len(w) - 300) / 260) AS BIGINT) + 1 ELSE 1 END)) AS no FROM w)
SELECT doc_id, no AS window_no, CASE WHEN len(w) <= 300 THEN t ELSE array_to_string(w[no * 260 + 1 : no * 260 + 300], ' ') END AS content FROM s""",
    "context_prefixes": """SELECT DISTINCT id, CASE WHEN len(section_path) > 0 AND section_path[1] IS NOT NULL THEN 'This chunk is from the ''' || section_path[1] || CASE WHEN len(section_path) > 1
THEN ''' document, specifically the ''' || array_to_string(section_path[2:], ' > ') || ''' section.' ELSE ''' document.' END END AS prefix FROM chunks""",
    "valid_chunks": """SELECT DISTINCT id, CAST(n AS INTEGER) AS token_count FROM (SELECT id, len(regexp_extract_all(content, '[^@B@]+')) AS n FROM chunks) WHERE n BETWEEN 20 AND 2000""",
    "ingest_documents": """SELECT DISTINCT document_id, source_id, sha256(coalesce(raw_content, '')) AS checksum,
CASE WHEN document_id IN (SELECT document_id FROM chunks) THEN 'indexed' ELSE 'pending' END AS status FROM raw_documents""",
    "request_checks": r"""SELECT DISTINCT id, coalesce(regexp_matches(session_id, '\A[A-Za-z0-9_-]{8,64}\z'), false) AS good_session,
coalesce(length(question) BETWEEN 1 AND 500, false) AS good_question FROM chat_turns""",
    "line_kinds": rf"""WITH l AS (SELECT document_id, unnest(string_split(content, chr(10))) AS line FROM (SELECT DISTINCT document_id, title, content FROM normalized_documents)),
s AS (SELECT document_id, {_strip("line")} AS t, lower({_strip("regexp_replace(line, '^#{1,6}', '')")}) AS h FROM l)
SELECT document_id, CAST(count_if(regexp_matches(t, '^([*#\-]|\p{{Nd}}+[.)][@B@])')) AS BIGINT) AS list_lines,
CAST(count_if({_HEADING.replace("@ ", "t ").replace("(@", "(t").replace("@,", "t,")}) AS BIGINT) AS headings, CAST(count_if(h IN {_REFERENCES}) AS BIGINT) AS reference_headings FROM s GROUP BY document_id""",
}
ORACLES = {k: sql(v) for k, v in ORACLES.items()}
