"""Pass rates and ranking quality."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pass_rate(cases: DataFrame, suite: str = "suite", passed: str = "passed") -> DataFrame:
    """(suite, passed, total) of case rows with a boolean outcome."""
    return cases.groupBy(suite).agg(
        F.count_if(F.col(passed)).alias("passed"), F.count("*").alias("total")
    )


def first_relevant(queries: DataFrame, results: DataFrame, relevant: DataFrame) -> DataFrame:
    """(query_id, rank): rank of the first relevant result, NULL if none.

    ``results``: query_id, chunk_id, rank; ``relevant``: query_id, chunk_id.
    """
    hits = results.join(relevant.distinct(), ["query_id", "chunk_id"], "left_semi")
    first = hits.groupBy("query_id").agg(F.min("rank").alias("rank"))
    return queries.select("query_id").join(first, "query_id", "left")


def mrr(queries: DataFrame, results: DataFrame, relevant: DataFrame) -> DataFrame:
    """(queries, mrr): mean reciprocal rank, 0 for queries without a hit."""
    ranks = first_relevant(queries, results, relevant)
    return ranks.agg(
        F.count("*").alias("queries"),
        F.avg(F.coalesce(F.lit(1.0) / F.col("rank"), F.lit(0.0))).alias("mrr"),
    )


def hit_at_k(queries: DataFrame, results: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """(queries, hits, rate): queries with a relevant result among the first k."""
    ranks = first_relevant(queries, results, relevant)
    hit = F.coalesce(F.col("rank") <= k, F.lit(False))
    return ranks.agg(
        F.count("*").alias("queries"),
        F.count_if(hit).alias("hits"),
        F.avg(hit.cast("double")).alias("rate"),
    )
