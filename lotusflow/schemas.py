"""Declared schemas of the tables and files."""

from __future__ import annotations

DATASET = (
    "data array<struct<title:string, paragraphs:array<struct<context:string, qas:array<struct<id:string, question:string,"
    " answers:array<struct<text:string>>>>>>>>"
)
SOURCE = "id string, tenant_id string, type string, version string, metadata map<string,string>"
DOCUMENT = "id string, source_id string, checksum string, status string, metadata map<string,string>"
RAW_DOCUMENT = "document_id string, source_id string, title string, raw_content string, metadata map<string,string>"
CHUNK = (
    "id string, document_id string, chunk_order int, content string, token_count int, section_path array<string>,"
    " section_title string, is_reference_section boolean"
)
INDEX_ENTRY = "chunk_id string, dense_vector array<float>, sparse_vector map<int,double>, metadata map<string,string>"
QUERY_CACHE = (
    "cache_key string, raw_query string, rewritten_query string, intent string, model_name string, prompt_version string, created_at timestamp"
)
CHAT_SESSION = "session_id string, created_at timestamp, last_active_at timestamp, token_total bigint, compacting boolean"
CHAT_TURN = (
    "id string, session_id string, turn_no int, question string, answer string, intent string, tokens_hint int, summary string, created_at timestamp"
)
EVAL_CASE = (
    "id string, category string, question string, expected_behavior string, expected_keywords array<string>, relevant_context string, notes string"
)
STAGE_TIMING = "query string, stage string, ms double"
