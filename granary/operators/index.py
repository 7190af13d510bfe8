"""Term weights and vectors of a chunk table."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions import text as T
from granary.functions.kernels import count_kernel, posting_kernel
from granary.runtime import (
    BROADCAST_ROWS,
    at_most,
    let,
    materialize,
    materialize_all,
    remove_table,
    scratch,
    ship_package,
    spread,
)

# Terms joined by broadcast ahead of the shuffle join, most frequent first.
HOT_TERMS = 65_536
# Neighbouring chunk ids whose postings of a term share a row.
POSTING_BLOCK = 2_048
# Id ranges that a partition of the index build holds on average, at most.
PARTITION_BLOCKS = 4
# Chunks whose postings are made in one job, at least, and jobs that make them, at most.
SLICE_CHUNKS = 32_768
SLICES = 64


@dataclass(frozen=True)
class LexicalIndex:
    """idf(term, df, idf) and postings(term, block, top, ids, weights).

    A posting row holds the chunks of one id range that have the term, with
    their weights over their norms, and the largest of these.
    """

    idf: DataFrame
    postings: DataFrame
    width: int = POSTING_BLOCK


def chunk_terms(chunks: DataFrame) -> DataFrame:
    """One row per chunk: array of (term, tf). No shuffle besides ``spread``."""
    ship_package()
    rows = spread(chunks.select("chunk_id", "text"), "chunk_id")
    key = rows.schema["chunk_id"].dataType.simpleString()
    return rows.mapInArrow(count_kernel, f"chunk_id {key}, counts array<struct<term:string,tf:int>>")


def postings(terms: DataFrame) -> DataFrame:
    # Outer generators: the plain ones infer a filter on the array, which is
    # pushed to the scan and would count all terms a second time there.
    return terms.select("chunk_id", F.inline_outer("counts")).filter("term IS NOT NULL")


def document_frequency(terms: DataFrame) -> DataFrame:
    """Chunks per term; a chunk holds each term once, so this is a plain count
    with map-side partial sums."""
    return (
        terms.select(F.explode_outer("counts.term").alias("term"))
        .filter("term IS NOT NULL")
        .groupBy("term")
        .agg(F.count("*").alias("df"))
    )


def idf(df: DataFrame, chunks: DataFrame) -> DataFrame:
    """ln((1 + N) / (1 + df)) + 1, N being all chunks, also those without terms."""
    n = chunks.agg(F.count("*")).scalar()
    return df.withColumn(
        "idf", F.log((F.lit(1.0) + n) / (F.lit(1.0) + F.col("df"))) + F.lit(1.0)
    )


def _weigh(rows: DataFrame, *keep: str) -> DataFrame:
    weight = (F.lit(1.0) + F.log(F.col("tf").cast("double"))) * F.col("idf")
    return rows.select(*keep, "chunk_id", "term", "tf", weight.alias("w"))


def tf_weights(
    terms: DataFrame,
    idf_table: DataFrame,
    hot_terms: int = 0,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """(1 + ln tf) * idf per chunk and term.

    With ``hot_terms`` and an idf table too long to broadcast, the most
    frequent terms are joined by broadcast (their number is fixed, so is the
    size) and only the rest meets its idf in a shuffle; no single term can then
    fill a partition. Meant for written tables, which are read once per part.
    """
    rows = postings(terms)
    if not hot_terms:
        return _weigh(rows.join(idf_table.select("term", "idf"), "term"))
    if at_most(idf_table, broadcast_rows):
        return _weigh(rows.join(F.broadcast(idf_table.select("term", "idf")), "term"))
    hot = F.broadcast(
        idf_table.orderBy(F.desc("df"), "term").limit(hot_terms).select("term", "idf")
    )
    head = rows.join(hot, "term")
    rest = rows.join(hot.select("term"), "term", "left_anti").join(
        idf_table.select("term", "idf"), "term"
    )
    return _weigh(head.unionByName(rest))


def doc_norms(chunks: DataFrame, weights: DataFrame) -> DataFrame:
    """Square root of the summed squared weights; 1 for a chunk without terms."""
    squares = weights.groupBy("chunk_id").agg(F.sum(F.col("w") * F.col("w")).alias("sq"))
    norm = F.when(F.col("sq") > 0, F.sqrt("sq")).otherwise(F.lit(1.0))
    return chunks.select("chunk_id").join(squares, "chunk_id", "left").select(
        "chunk_id", norm.alias("norm")
    )


def hot_table(idf_table: DataFrame, hot_terms: int = HOT_TERMS) -> DataFrame:
    """The most frequent terms with their idf."""
    return materialize(idf_table.orderBy(F.desc("df"), "term").limit(hot_terms), "hot-terms")


def unit_weights(
    terms: DataFrame,
    idf_table: DataFrame,
    width: int = POSTING_BLOCK,
    hot_terms: int = HOT_TERMS,
    broadcast_rows: int = BROADCAST_ROWS,
    hot: DataFrame | None = None,
) -> DataFrame:
    """(term, block, ids, weights): term weights divided by the norm of their chunk.

    Chunks are dealt by id range while their terms are still packed, so norms and
    posting blocks are made where the range lies and single postings are not
    shuffled. Of an idf table too long to broadcast, ``hot_terms`` are; only the
    postings of the others travel to their idf and on to their range; ``hot`` is
    the table of these if it has been made. A chunk without an id lies in no range.
    """
    ship_package()
    block = F.floor(F.col("chunk_id") / width).alias("block")
    known = idf_table.select("term", "idf")
    none = F.lit(None).cast("double").alias("idf")
    # A token has no blank, so the terms of a chunk travel as one text.
    names = F.array_join("counts.term", " ").alias("names")
    rows = terms.select(block, "chunk_id", names, F.col("counts.tf").alias("tfs"), none)
    if not at_most(idf_table, broadcast_rows):
        hot = hot or hot_table(idf_table, hot_terms)
        rest = postings(terms).join(F.broadcast(hot.select("term")), "term", "left_anti")
        late = rest.join(idf_table.select("term", "idf"), "term")
        rows = rows.unionByName(
            late.select(block, "chunk_id", F.col("term").alias("names"), F.array("tf").alias("tfs"), "idf")
        )
        known = hot.select("term", "idf")
    parts = max(
        int(terms.sparkSession.conf.get("spark.sql.shuffle.partitions")),
        -(-terms.count() // (PARTITION_BLOCKS * width)),
    )
    dealt = rows.filter("names <> '' AND block IS NOT NULL").repartition(parts, "block").sortWithinPartitions("block")
    # No longer than ``broadcast_rows`` or ``hot_terms``.
    table = known.toArrow()
    terms_known = pa.concat_arrays([pa.array([], pa.string()), *table["term"].cast(pa.string()).chunks])
    kernel = posting_kernel(terms_known, np.asarray(table["idf"], dtype=np.float64))
    return dealt.withColumn("chunk_id", F.col("chunk_id").cast("bigint")).mapInArrow(
        kernel, "term string, block bigint, ids array<bigint>, weights array<double>"
    )


def posting_blocks(weights: DataFrame) -> DataFrame:
    """Postings by term and id range, with the largest weight of each.

    A frequent term has one row per id range, never one long list, and its rows
    spread over the files; the rows of a range share one, sorted by term.
    """
    return weights.select("term", "block", F.array_max("weights").alias("top"), "ids", "weights")


def lexical_index(chunks: DataFrame, width: int = POSTING_BLOCK) -> LexicalIndex:
    """Index of a chunk table. Texts are read and tokenised once; what searches
    read (posting blocks, idf) is written to the shared folder.

    Terms are written in slices of id ranges. A slice of them goes when its postings
    are written, so neither they nor what is shuffled lie beside the whole index.
    """
    with scratch() as made:
        slices = min(SLICES, max(1, -(-chunks.count() // SLICE_CHUNKS)))
        own = F.coalesce(F.pmod(F.floor(F.col("chunk_id") / width), F.lit(slices)).cast("int"), F.lit(0))
        terms = materialize(chunk_terms(chunks).withColumn("slice", own), "terms", codec="zstd", by="slice")
        folder = made.paths[-1]
        table = materialize(idf(document_frequency(terms), chunks), "idf", codec="zstd")
        hot = None if at_most(table, BROADCAST_ROWS) else hot_table(table)

        def blocks() -> Iterator[DataFrame]:
            for i in range(slices):
                rows = terms.filter(F.col("slice") == i).drop("slice")
                yield posting_blocks(unit_weights(rows, table, width, hot=hot))
                remove_table(chunks.sparkSession, f"{folder}/slice={i}")

        found = LexicalIndex(table, materialize_all(blocks(), "postings", codec="zstd"), width)
        made.keep(found.idf, found.postings)
    return found


def l2_normalize(c: Column | str) -> Column:
    """Unit vector in double precision; a zero vector stays as it is."""
    values = T.col(c).cast("array<double>")
    squares = F.aggregate(values, F.lit(0.0), lambda a, x: a + x * x)
    return let(
        F.sqrt(squares),
        lambda n: F.when(n > 0, F.transform(values, lambda x: x / n)).otherwise(values),
    )


def embed_chunks(
    chunks: DataFrame, make_encoder: Callable[[], object], key: str = "chunk_id", batch: int = 32
) -> DataFrame:
    """Texts to unit vectors with a model that each Python worker builds once.

    ``make_encoder()`` returns an object with ``encode(list[str])``; texts are
    handed over in batches of ``batch``.
    """

    def run(frames: Iterator) -> Iterator:
        import numpy as np
        import pandas as pd

        encoder = make_encoder()
        for frame in frames:
            texts = frame["text"].fillna("").tolist()
            parts = [
                np.asarray(encoder.encode(texts[i : i + batch]), dtype=np.float64)
                for i in range(0, len(texts), batch)
            ]
            vectors = np.concatenate(parts) if parts else np.empty((0, 0))
            norms = np.linalg.norm(vectors, axis=1, keepdims=True) if len(vectors) else vectors
            unit = np.divide(vectors, norms, out=vectors.copy(), where=norms > 0)
            yield pd.DataFrame({key: frame[key], "embedding": list(unit)})

    ship_package()
    source = spread(chunks.select(key, "text"), key)
    return source.mapInPandas(run, f"{key} bigint, embedding array<double>")


def chunk_stats(chunks: DataFrame) -> DataFrame:
    """Number of chunks in all and per source type."""
    kind = F.col("source_type")
    return chunks.agg(
        F.count("*").alias("chunks"),
        F.count_if(kind == "pdf").alias("pdf"),
        F.count_if(~kind.isin("pdf", "narrative")).alias("generated"),
        F.count_if(kind == "narrative").alias("narrative"),
    )
