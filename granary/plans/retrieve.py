"""Retrieval plans: one question table against one corpus index."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.operators import search as S
from granary.operators.index import LexicalIndex, embed_chunks
from granary.runtime import materialize

MODES = ("auto", "lexical", "dense", "hybrid")


@dataclass(frozen=True)
class CorpusIndex:
    """Chunk table with its lexical index and, optionally, dense vectors."""

    chunks: DataFrame
    lexical: LexicalIndex
    vectors: DataFrame | None = None
    make_encoder: Callable[[], object] | None = None

    @property
    def has_dense(self) -> bool:
        return self.vectors is not None and self.make_encoder is not None

    def has_source(self, kind: str) -> bool:
        return bool(self.chunks.filter(F.col("source_type") == kind).take(1))


def pick_mode(index: CorpusIndex, mode: str) -> str:
    """auto and hybrid fall back to lexical without vectors; dense does not."""
    if mode not in MODES:
        raise ValueError(f"unsupported retrieval mode: {mode}")
    if index.has_dense:
        return "hybrid" if mode == "auto" else mode
    if mode == "dense":
        raise RuntimeError("dense retrieval needs chunk vectors and an encoder")
    return "lexical"


def candidates(k: int) -> int:
    """Rows fetched per query, to which the source quotas are applied."""
    return max(5 * k, 25)


def retrieve(
    queries: DataFrame,
    index: CorpusIndex,
    k: int = 6,
    mode: str = "auto",
    alpha: float = 0.7,
    priority: str = "symbols-first",
    symbols_ratio: float = 0.75,
    max_pdf_extras: int = 2,
    found: DataFrame | None = None,
) -> DataFrame:
    """(query_id, chunk_id, rank, score, mode_used), k results per query.

    Fetches max(5k, 25) candidates in the mode that is available and applies
    the source quotas to them. ``found`` are the ranked results of a lexical search
    that asked for no fewer, also for other queries; it stands in for that search.
    """
    if not 0.0 <= alpha <= 1.0:
        raise ValueError(f"alpha must be between 0 and 1, got {alpha}")
    used = pick_mode(index, mode)
    fetch = candidates(k)
    if used == "lexical" and found is not None:
        found = found.filter(F.col("rank") <= fetch).join(queries.select("query_id"), "query_id", "left_semi")
    elif used == "lexical":
        found = S.lexical_search(queries, index.lexical, fetch)
    else:
        # Encoded once, however many blocks the search reads them in.
        vectors = materialize(embed_chunks(queries, index.make_encoder, key="query_id"), "query-vectors")
        if used == "dense":
            found = S.dense_search(vectors, index.vectors, fetch)
        else:
            found = S.hybrid_search(queries, vectors, index.lexical, index.vectors, fetch, alpha)
    auto = priority == "auto"
    typed = found.join(index.chunks.select("chunk_id", "source_type"), "chunk_id")
    picked = S.source_quota(
        typed,
        k,
        priority,
        symbols_ratio,
        max_pdf_extras,
        index_has_generated=not auto or index.has_source("generated"),
        index_has_pdf=not auto or index.has_source("pdf"),
    )
    return picked.select(
        "query_id", "chunk_id", "rank", "score", F.lit(used).alias("mode_used")
    )
