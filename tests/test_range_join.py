"""Scores of ranges whose questions and postings meet in a join without broadcast."""

import random

from pyspark.sql import functions as F

from granary.operators import index as I
from granary.operators import search as S
from granary.runtime import materialize

WORDS = "ring map ideal field group sum kernel".split()


def test_ranges_are_scored_whole_by_a_join_of_both_shuffled_sides(spark, monkeypatch):
    """Without any broadcast the join deals by range and term, and scores were sums of a part of the terms."""
    rng = random.Random(5)
    texts = [" ".join(rng.choices(WORDS, k=rng.randint(1, 9))) for _ in range(60)]
    chunks = spark.createDataFrame(list(enumerate(texts)), "chunk_id long, text string")
    index = I.lexical_index(chunks, 7)
    queries = spark.createDataFrame([(i, " ".join(WORDS[: 2 + i])) for i in range(5)], "query_id long, text string")
    weights = S.query_weights(queries, index.idf).withColumn("part", (F.col("query_id") % 2).cast("int"))
    asked = materialize(index.postings.select("block").distinct().crossJoin(weights), "asked")

    def best():
        rows = S.take_top(S.score_blocks(asked, index, 4), 4).collect()
        return {(r["query_id"], r["rank"]): (r["chunk_id"], r["score"]) for r in rows}

    broadcast = best()
    monkeypatch.setattr(S, "BROADCAST_ROWS", 1)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert best() == broadcast and len(broadcast) == 20
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
