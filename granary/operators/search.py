"""Top-k search of a question table over a chunk index.

Lexical search reads posting blocks by term and leaves out id ranges that cannot
hold a result. Dense search compares blocks of questions with shards of the chunk
vectors, each of which keeps k rows per question. No question passes through the
driver.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from granary.functions import text as T
from granary.functions.kernels import dense_kernel, range_kernel
from granary.operators.index import LexicalIndex
from granary.runtime import BROADCAST_ROWS, at_most, materialize, ship_package

MET = ["block", "part", "ids", "weights", "queries", "w"]
RESULT = "query_id bigint, chunk_id bigint, score double"
SCORE_DIGITS = 9
# Ranges of a question that are scored first, beyond those that k chunks fill.
FIRST_BLOCKS = 8
# Questions that meet the postings of a range together.
QUESTIONS = 512
# Cells of the question matrix of a dense block.
QUESTION_CELLS = 4_000_000


def take_top(scored: DataFrame, k: int, *order) -> DataFrame:
    """Best k rows per query with their 1-based rank."""
    order = order or (F.desc("score"), F.asc("chunk_id"))
    window = Window.partitionBy("query_id").orderBy(*order)
    return scored.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= k)


def query_weights(queries: DataFrame, idf_table: DataFrame) -> DataFrame:
    """(query_id, term, w) of known query terms, w divided by the query norm."""
    counts = queries.select(
        "query_id", F.inline_outer(T.term_counts(T.tokenize("text")))
    ).filter("term IS NOT NULL")
    weight = (F.lit(1.0) + F.log(F.col("tf").cast("double"))) * F.col("idf")
    weighted = counts.join(idf_table.select("term", "idf"), "term").select(
        "query_id", "term", weight.alias("w")
    )
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("query_id")))
    return weighted.withColumn("w", F.col("w") / norm)


def block_bounds(weights: DataFrame, index: LexicalIndex) -> DataFrame:
    """(query_id, block, bound): no chunk of the id range scores higher.

    Reads the maxima of the blocks of the terms asked for, not their postings.
    """
    few = at_most(weights, BROADCAST_ROWS)
    heads = index.postings.select("term", "block", "top").join(F.broadcast(weights) if few else weights, "term")
    return heads.groupBy("query_id", "block").agg(F.sum(F.col("w") * F.col("top")).alias("bound"))


def score_blocks(asked: DataFrame, index: LexicalIndex, k: int) -> DataFrame:
    """Best k (query_id, chunk_id, score) of every question in every range it asks.

    ``asked`` has (term, query_id, w, part) and, unless all ranges are asked, block;
    ``part`` deals the questions into parts of bounded number. The postings that a
    part of the questions asks for in a range meet in one task, which adds up a
    matrix of questions by chunks.
    """
    ship_package()
    keys = [c for c in ("term", "block", "part") if c in asked.columns]
    packed = asked.groupBy(*keys).agg(F.collect_list("query_id").alias("queries"), F.collect_list("w").alias("w"))
    n = int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    few = at_most(asked, BROADCAST_ROWS)
    if few or "block" not in keys:
        met = index.postings.join(F.broadcast(packed) if few else packed, keys[:-1])
        dealt = met.select(*MET).repartition(n, "block", "part")
    else:
        named, terms = index.postings, asked.select("term").distinct()
        if at_most(terms, BROADCAST_ROWS):
            named = named.join(F.broadcast(terms), "term", "left_semi")
        # A join that is not broadcast deals both sides by all of its keys, whatever they were
        # dealt by, so what met is dealt once more: a part of a range must lie in one task.
        met = named.join(packed.repartition(n, "block", "term"), ["block", "term"])
        dealt = met.select(*MET).repartition(n, "block", "part")
    return dealt.sortWithinPartitions("block", "part").mapInArrow(range_kernel(index.width, k, SCORE_DIGITS), RESULT)


@dataclass(frozen=True)
class BlockSearch:
    """A lexical search cut into the ranges scored first, the best of these per
    question, and the ranges that may still hold better chunks."""

    weights: DataFrame
    first: DataFrame
    best: DataFrame
    rest: DataFrame


def _parts(weights: DataFrame) -> DataFrame:
    """Deals the questions into parts of about ``QUESTIONS`` by a hash."""
    count = weights.agg(F.approx_count_distinct("query_id")).first()[0]
    parts = max(1, -(-2 * count // QUESTIONS))
    return weights.withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(parts)).cast("int"))


def plan_blocks(
    weights: DataFrame, index: LexicalIndex, k: int, first_blocks: int = FIRST_BLOCKS
) -> BlockSearch:
    """Stop early: the k-th score of the most promising ranges bounds the others."""
    bounds = materialize(block_bounds(weights, index), "block-bounds")
    promising = take_top(bounds, first_blocks, F.desc("bound"), F.asc("block"))
    first = materialize(promising.select("query_id", "block"), "first-blocks")
    best = materialize(take_top(score_blocks(first.join(weights, "query_id"), index, k), k), "first-scores")
    least = best.filter(F.col("rank") == k).select("query_id", F.col("score").alias("least"))
    # Rounding moves a score by half of the last digit at most.
    open_ = F.col("least").isNull() | (F.col("bound") >= F.col("least") - 10.0**-SCORE_DIGITS)
    rest = bounds.join(first, ["query_id", "block"], "left_anti")
    rest = rest.join(least, "query_id", "left").filter(open_)
    return BlockSearch(weights, first, best, rest.select("query_id", "block"))


def lexical_search(
    queries: DataFrame, index: LexicalIndex, k: int, first_blocks: int = FIRST_BLOCKS
) -> DataFrame:
    """TF-IDF cosine, scores above zero, best k per query, ties by chunk_id.

    Results do not depend on the blocks: a range is left out only if the sum of
    its block maxima lies below the k-th score already found. An index of no
    more than ``first_blocks`` ranges is scored as it is.
    """
    weights = materialize(_parts(query_weights(queries, index.idf)), "query-weights")
    if at_most(index.postings.select("block").distinct(), first_blocks):
        return take_top(score_blocks(weights, index, k), k)
    plan = plan_blocks(weights, index, k, first_blocks)
    rest = take_top(score_blocks(plan.rest.join(weights, "query_id"), index, k), k)
    return take_top(plan.best.drop("rank").unionByName(rest.drop("rank")), k)


def dense_search(
    query_vectors: DataFrame, vectors: DataFrame, k: int, cells: int = QUESTION_CELLS
) -> DataFrame:
    """Exact inner-product search over unit vectors, best k per query.

    Questions are cut into blocks whose matrix has at most about ``cells`` cells, and
    chunks into shards; a block and a shard meet in one task, which holds the
    matrix and k rows per question while the chunks stream by. Chunks are
    shuffled once per block of questions.
    """
    ship_package()
    asked = query_vectors.select("query_id", F.col("embedding").cast("array<double>").alias("embedding"))
    size = asked.agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("width")).first()
    blocks = max(1, -(-2 * size["n"] * (size["width"] or 1) // (2 * cells)))
    shards = int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def every(count: int):
        return F.explode(F.sequence(F.lit(0), F.lit(count - 1)))

    def hashed(key: str, count: int):
        return F.pmod(F.xxhash64(key), F.lit(count)).cast("int")

    questions = asked.select(
        every(shards).alias("shard"),
        hashed("query_id", blocks).alias("block"),
        F.lit(0).alias("side"),
        F.col("query_id").cast("long").alias("id"),
        "embedding",
    )
    chunks = vectors.select(
        hashed("chunk_id", shards).alias("shard"),
        every(blocks).alias("block"),
        F.lit(1).alias("side"),
        F.col("chunk_id").cast("long").alias("id"),
        F.col("embedding").cast("array<double>").alias("embedding"),
    )
    place = ["shard", "block"]
    met = questions.unionByName(chunks).repartition(shards, *place).sortWithinPartitions(*place, "side")
    found = met.mapInArrow(dense_kernel(k, SCORE_DIGITS), RESULT)
    return take_top(found, k)


def minmax_normalize(results: DataFrame, out: str = "score") -> DataFrame:
    """Scores of each query's result list scaled to [0, 1]; flat lists become 1."""
    window = Window.partitionBy("query_id")
    low, high = F.min("score").over(window), F.max("score").over(window)
    scaled = F.when(high - low < 1e-12, F.lit(1.0)).otherwise(
        (F.col("score") - low) / (high - low)
    )
    return results.withColumn(out, scaled)


def fuse(lexical: DataFrame, dense: DataFrame, k: int, alpha: float) -> DataFrame:
    """alpha * dense + (1 - alpha) * lexical of normalized lists, best k."""
    left = minmax_normalize(lexical).select("query_id", "chunk_id", F.col("score").alias("l"))
    right = minmax_normalize(dense).select("query_id", "chunk_id", F.col("score").alias("d"))
    zero = F.lit(0.0)
    score = F.lit(alpha) * F.coalesce("d", zero) + F.lit(1.0 - alpha) * F.coalesce("l", zero)
    both = left.join(right, ["query_id", "chunk_id"], "full_outer").select(
        "query_id", "chunk_id", F.round(score, SCORE_DIGITS).alias("score")
    )
    return take_top(both, k)


def hybrid_search(
    queries: DataFrame,
    query_vectors: DataFrame,
    index: LexicalIndex,
    vectors: DataFrame,
    k: int,
    alpha: float = 0.7,
) -> DataFrame:
    if not 0.0 <= alpha <= 1.0:
        raise ValueError(f"alpha must be between 0 and 1, got {alpha}")
    fetch = max(4 * k, 20)
    return fuse(
        lexical_search(queries, index, fetch), dense_search(query_vectors, vectors, fetch), k, alpha
    )


def dedupe_results(results: DataFrame) -> DataFrame:
    """First occurrence of each chunk within its query."""
    window = Window.partitionBy("query_id", "chunk_id").orderBy("rank")
    return (
        results.withColumn("__n", F.row_number().over(window)).filter("__n = 1").drop("__n")
    )


PRIORITIES = ("auto", "flat", "symbols-first")


def source_quota(
    results: DataFrame,
    k: int,
    priority: str = "symbols-first",
    symbols_ratio: float = 0.75,
    max_pdf_extras: int = 2,
    index_has_generated: bool = True,
    index_has_pdf: bool = True,
) -> DataFrame:
    """Select k results per query with quotas for the source types.

    Order of the output is slot order: the symbol quota, the page quota, the
    remaining symbols, the remaining pages, everything else.
    """
    if priority not in PRIORITIES:
        raise ValueError(f"unsupported source priority: {priority}")
    if not 0.0 <= symbols_ratio <= 1.0:
        raise ValueError(f"symbols_ratio must be between 0 and 1, got {symbols_ratio}")
    if max_pdf_extras < 0:
        raise ValueError(f"max_pdf_extras must not be negative, got {max_pdf_extras}")
    if priority == "auto":
        priority = "symbols-first" if index_has_generated and index_has_pdf else "flat"
    ranked = dedupe_results(results)
    if priority == "flat":
        return take_top(ranked, k, F.asc("rank"))
    kind = (
        F.when(F.col("source_type") == "generated", "G")
        .when(F.col("source_type") == "pdf", "P")
        .otherwise("O")
    )
    per_query = Window.partitionBy("query_id")
    nth = F.row_number().over(Window.partitionBy("query_id", "__kind").orderBy("rank"))
    quota = max(1, round(k * symbols_ratio))  # half to even
    typed = (
        ranked.withColumn("__kind", kind)
        .withColumn("__nth", nth)
        .withColumn("__g", F.count_if(F.col("__kind") == "G").over(per_query))
        .withColumn("__p", F.count_if(F.col("__kind") == "P").over(per_query))
    )
    s = F.least(F.lit(quota), F.col("__g"), F.lit(k))
    p = F.least(F.lit(k) - s, F.col("__p"), F.lit(max_pdf_extras))
    phase = (
        F.when(F.col("__g") == 0, 0)
        .when((F.col("__kind") == "G") & (F.col("__nth") <= s), 0)
        .when((F.col("__kind") == "P") & (F.col("__nth") <= p), 1)
        .when(F.col("__kind") == "G", 2)
        .when(F.col("__kind") == "P", 3)
        .otherwise(4)
    )
    slots = typed.withColumn("__phase", phase)
    return take_top(slots, k, F.asc("__phase"), F.asc("rank")).drop(
        "__kind", "__nth", "__g", "__p", "__phase"
    )


def merge_result_sets(results: DataFrame) -> DataFrame:
    """Several ranked lists per question as one.

    Input: question_id, sub_no (list order), rank (1-based), chunk_id, score.
    Order: hits, best score, best rank, first seen.
    """
    first = F.struct("sub_no", "rank")
    merged = results.groupBy("question_id", "chunk_id").agg(
        F.count("*").alias("hits"),
        F.max("score").alias("score"),
        F.min("rank").alias("best_rank"),
        F.min(first).alias("first_seen"),
    )
    order = Window.partitionBy("question_id").orderBy(
        F.desc("hits"), F.desc("score"), F.asc("best_rank"), F.asc("first_seen")
    )
    return merged.withColumn("rank", F.row_number().over(order)).drop("first_seen")
