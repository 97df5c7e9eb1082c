"""Typed decode of structured model responses (JSON text -> struct)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Response shapes, one DDL per prompt family.
RESPONSE_DDL = {
    "check": "contradictory_info_found BOOLEAN",
    "extract": "contradictory_info_found BOOLEAN, "
               "contradictions ARRAY<STRUCT<quote_from_document1: STRING, quote_from_document2: STRING>>",
    "qa": "answer STRING",
    "completeness": "keypoint_coverage ARRAY<BOOLEAN>",
    "hallucination": "keypoint_contradiction ARRAY<BOOLEAN>",
    "keypoints": "keypoints ARRAY<STRING>",
    "single_textual": "text_new STRING, answer_new STRING, references_new ARRAY<STRING>",
    "single_tabular": "answer_new STRING, description STRING, value STRING",
    "multi_textual": "text_new STRING, qa_pairs_new ARRAY<STRUCT<question: STRING, answer: STRING, quote: STRING>>",
}

_OPTS = {"mode": "PERMISSIVE", "allowSingleQuotes": "true", "allowBackslashEscapingAnyCharacter": "true"}


def decode(c, shape_or_ddl: str) -> Column:
    """Decode JSON text to a struct. Malformed input gives null fields."""
    ddl = RESPONSE_DDL.get(shape_or_ddl, shape_or_ddl)
    col = F.col(c) if isinstance(c, str) else c
    return F.from_json(col, ddl, _OPTS)


def undecodable(c) -> Column:
    """True where there is a text that isn't a JSON object (null without a text)."""
    col = F.col(c) if isinstance(c, str) else c
    return F.when(col.isNotNull(), F.from_json(col, "map<string,string>", _OPTS).isNull())


def decode_list_literal(c, element_type: str = "string") -> Column:
    """Decode Python list-literal text (mixed quotes, backslash escapes)."""
    col = F.col(c) if isinstance(c, str) else c
    return F.from_json(col, f"array<{element_type}>", _OPTS)
