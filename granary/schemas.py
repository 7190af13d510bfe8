"""Schemas of the tables that operators read and write."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHUNK_SCHEMA = """
    chunk_id bigint, text string, source string, source_type string, page_start int,
    page_end int, section_title string, symbol_id string, module string, qualname string,
    signature string, kind string, file_path string, line int, summary string,
    example_count int
"""
SYMBOL_SCHEMA = """
    id string, module string, qualname string, kind string, signature string, summary string,
    docstring string, example_count int, examples array<string>, file_path string, line int
"""
NARRATIVE_SCHEMA = """
    section_id string, module string, section_title string, text string, source_file string,
    raw_refs array<string>, resolved_symbol_ids array<string>, resolved_count int
"""
RULE_SCHEMA = "rule_no int, id string, scope string, when_any array<string>, message string"

CHUNK_COLUMNS = tuple(part.split()[0] for part in CHUNK_SCHEMA.split(","))


def chunk_row(**given: Column) -> list[Column]:
    """The 16 chunk columns; those not given take their default."""
    defaults: dict[str, Column] = {name: F.lit("") for name in CHUNK_COLUMNS}
    defaults["chunk_id"] = F.lit(None).cast("bigint")
    for name in ("page_start", "page_end", "line"):
        defaults[name] = F.lit(None)
    defaults["example_count"] = F.lit(0)
    types = dict(part.split()[:2] for part in CHUNK_SCHEMA.split(","))
    return [
        given.get(name, defaults[name]).cast(types[name]).alias(name) for name in CHUNK_COLUMNS
    ]
