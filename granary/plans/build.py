"""Index build: extracted records to a stored corpus index."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.operators import chunking as C
from granary.operators import index as I
from granary.plans.retrieve import CorpusIndex
from granary.runtime import materialize, scratch, with_position
from granary.schemas import CHUNK_COLUMNS
from granary.sources import tables


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """Rows with the document keys that chunk numbering sorts by."""
    return with_position(rows, order, "doc_id").withColumn("chunk_no", F.lit(0).cast("bigint"))


def numbered_narratives(cut: DataFrame) -> DataFrame:
    """Narrative chunks in file order, else by module and section, and by window."""
    place = ["position"] if "position" in cut.columns else ["module", "section"]
    section = F.regexp_replace("symbol_id", ":[0-9]+$", "")
    own = F.when(F.col("window") == 0, F.col("symbol_id")).otherwise(section)
    rows = cut.withColumnRenamed("chunk_no", "window").withColumn("section", own)
    return numbered(rows, [*place, "window"]).drop("window", "section", "position")


def chunk_ids(mode: str, parts: dict[str, DataFrame]) -> DataFrame:
    """The chunks that ``assign_chunk_ids`` gives, numbered source by source.

    Records that ``numbered`` has placed are not dealt and written again.
    """
    names = C.chosen_sources(mode, parts)
    if len({parts[name].schema["doc_id"].dataType for name in names}) > 1:
        # Keys of one common type order the sources.
        return C.assign_chunk_ids(C.select_sources(mode, **parts))
    start, done = 0, []
    for name in names:
        rows = parts[name].drop("chunk_id")
        if name in ("generated", "narrative"):
            own = rows.withColumn("chunk_id", F.col("doc_id") + F.lit(start))
        else:
            own = with_position(rows, ["doc_id", "chunk_no"], "chunk_id", start)
        start += own.count()
        done.append(own.select(*CHUNK_COLUMNS))
    return functools.reduce(DataFrame.unionByName, done)


def build_index(
    mode: str,
    symbols: DataFrame | None = None,
    api_docs: DataFrame | None = None,
    narratives: DataFrame | None = None,
    pages: DataFrame | None = None,
    make_encoder: Callable[[], object] | None = None,
    path: str | None = None,
) -> CorpusIndex:
    """Chunks of all sources with contiguous ids, term tables and vectors.

    ``pages``: doc_id, page, text, source; ``api_docs``: doc_id, text. Narratives
    keep the order of their ``position``, which the reader of their file gives.
    """
    with scratch() as made:
        parts: dict[str, DataFrame] = {}
        if symbols is not None:
            rendered = C.render_symbol_chunks(symbols)
            order = ["module", "qualname", "kind", "file_path", "line", "symbol_id"]
            parts["generated"] = numbered(rendered, order)
        if api_docs is not None:
            parts["api"] = C.api_reference_chunks(api_docs, F.lit("API_REFERENCE.md"))
        if narratives is not None:
            parts["narrative"] = numbered_narratives(C.narrative_windows(narratives))
        if pages is not None:
            titled = C.carry_forward_section(
                pages.withColumn("section_title", C.detect_section_title("text"))
            )
            packed = C.pack_pages(titled).join(
                pages.select("doc_id", "source").distinct(), "doc_id"
            )
            # Written here, so that what packing shuffled is gone when the chunks are dealt.
            parts["pdf"] = C.page_chunks(materialize(packed, "packed-pages", codec="zstd"), "source")
        # Numbering writes the chunks in the order of their ids; they are read from there.
        chunks = chunk_ids(mode, parts)
        made.keep(chunks)
    if not chunks.take(1):
        raise RuntimeError("no chunks were produced for indexing")
    lexical = I.lexical_index(chunks)
    # Written here, whatever becomes of the index: encoding is the costly part.
    vectors = None
    if make_encoder is not None:
        vectors = materialize(I.embed_chunks(chunks, make_encoder), "chunk-vectors")
    if path is not None:
        tables.write_index(path, chunks, lexical, vectors, sources=sorted(parts))
        chunks, lexical, vectors, _ = tables.read_index(chunks.sparkSession, path)
    return CorpusIndex(chunks, lexical, vectors, make_encoder)
