"""Routing of question streams.

The routing operators read one question at a time and keep no state, so a
stream takes the same expressions as a table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from granary import vocab
from granary.operators import routing
from granary.operators.features import classify_intent, question_features


def route_stream(
    questions: DataFrame, registry: routing.Registry, names: vocab.Names = vocab.Names()
) -> DataFrame:
    """Streaming questions (question_id, text) with evidence type, complexity
    and selected workflow."""
    scored = questions.withColumn("evidence", routing.evidence_type("text")).withColumn(
        "complexity", routing.complexity_score("text", names)["score"]
    )
    return routing.choose_workflow(scored, registry, names)


def intent_stream(questions: DataFrame, names: vocab.Names = vocab.Names()) -> DataFrame:
    return classify_intent(question_features(questions, names), names)


def write_stream(routed: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append routed questions to a Parquet table, all available input at once."""
    return (
        routed.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
