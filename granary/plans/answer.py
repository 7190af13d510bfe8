"""Retrieval plans over several queries, passes or steps per question.

Passes and steps come as tables, so every plan has a fixed number of joins;
nothing loops over questions.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from granary import vocab
from granary.functions import text as T
from granary.operators import rerank as R
from granary.operators import routing
from granary.operators import search as S
from granary.operators.context import chunk_results
from granary.operators.graph import SymbolGraph, graph_expand
from granary.plans.retrieve import CorpusIndex, candidates, pick_mode, retrieve
from granary.runtime import materialize, with_position

MULTI_QUERY_K = 10
CONTEXT_CAP = 10

Scorer = Callable[[Sequence[str], Sequence[str]], Sequence[float]]


@dataclass(frozen=True)
class Settings:
    """Options that all plans share."""

    k: int = 6
    mode: str = "auto"
    alpha: float = 0.7
    priority: str = "symbols-first"
    symbols_ratio: float = 0.75
    max_pdf_extras: int = 2
    names: vocab.Names = vocab.Names()
    scorer: Scorer | None = None


def _retrieve(
    queries: DataFrame, index: CorpusIndex, k: int, options: Settings, found: DataFrame | None = None
) -> DataFrame:
    return retrieve(
        queries,
        index,
        k,
        options.mode,
        options.alpha,
        options.priority,
        options.symbols_ratio,
        options.max_pdf_extras,
        found,
    )


def retrieved_lists(
    selected: DataFrame, index: CorpusIndex, options: Settings = Settings()
) -> DataFrame:
    """(question_id, sub_no, queries, query_id, chunk_id, rank, score): one list
    per retrieval query of each question, all searched in one batch."""
    several = Window.partitionBy("question_id")
    wanted = materialize(
        routing.expand_queries(selected, options.names).select(
            "question_id",
            "sub_no",
            "query",
            F.count("*").over(several).alias("queries"),
        ),
        "asked",
    )
    # Equal queries are searched once, whoever asks them; they are numbered, as
    # hashes of their text could meet.
    numbers = with_position(wanted.select("query").distinct(), ["query"], "query_id")
    wanted = materialize(wanted.join(numbers, "query"), "asked-numbered")
    depths = {options.k: F.col("queries") == 1, max(options.k, MULTI_QUERY_K): F.col("queries") > 1}
    found = None
    if len(depths) > 1 and pick_mode(index, options.mode) == "lexical":
        # A shorter list is the head of a longer one, so the index is searched once.
        texts = numbers.select("query_id", F.col("query").alias("text"))
        deepest = S.lexical_search(texts, index.lexical, candidates(max(depths)))
        found = materialize(deepest, "found")
    lists = []
    for depth, test in depths.items():
        asking = wanted if len(depths) == 1 else wanted.filter(test)
        distinct = asking.select("query_id", F.col("query").alias("text")).dropDuplicates(
            ["query_id"]
        )
        lists.append(asking.join(_retrieve(distinct, index, depth, options, found), "query_id"))
    return reduce(DataFrame.unionByName, lists)


def workflow_retrieve(
    questions: DataFrame,
    index: CorpusIndex,
    registry: routing.Registry,
    options: Settings = Settings(),
    graph: SymbolGraph | None = None,
) -> DataFrame:
    """(question_id, rank, chunk_id, score, mode_label).

    Expands each question to its retrieval queries, retrieves all of them in
    one batch, merges per question, expands along the graph if one is given,
    reranks and keeps k. ``questions``: question_id, text, optionally
    family_hint; rows that carry a selection (workflow_id, ...) keep it.
    """
    selected = questions
    if "workflow_id" not in questions.columns:
        chosen = routing.choose_workflow(questions, registry, options.names)
        selected = materialize(chosen, "selected")
    lists = materialize(retrieved_lists(selected, index, options), "lists")
    merged = S.merge_result_sets(lists).select("question_id", "chunk_id", "rank", "score")
    if graph is not None:
        merged = graph_expand(selected, merged, index.chunks, graph)
    asked_by = selected.select(
        "question_id", F.col("text").alias("question"), "preferred_symbols"
    )
    rows = chunk_results(merged, index.chunks).join(asked_by, "question_id")
    reranked = (
        R.rerank_graph(rows, options.names)
        if graph is not None
        else R.rerank_workflow(rows, options.names)
    )
    if options.scorer is not None:
        reranked = R.topn_rerank(reranked, options.scorer)
    label = F.concat(
        F.lit(pick_mode(index, options.mode)),
        F.when(F.col("queries") > 1, "+workflow").otherwise(""),
        F.lit("+graph" if graph is not None else ""),
        F.lit("+ce" if options.scorer is not None else ""),
    )
    counts = lists.select("question_id", "queries").distinct()
    kept = reranked.filter(F.col("rank") <= options.k)
    return kept.join(counts, "question_id").select(
        "question_id", "rank", "chunk_id", "score", label.alias("mode_label")
    )


def collect_passes(results: DataFrame, cap: int = CONTEXT_CAP) -> DataFrame:
    """Results of several passes as one capped list per question.

    ``results``: question_id, pass_no, step_id, rank, chunk_id, score. The
    first occurrence of a chunk stays; ``step_id`` is that of its first pass.
    """
    chunk = Window.partitionBy("question_id", "chunk_id").orderBy("pass_no", "rank")
    first = results.withColumn("n", F.row_number().over(chunk)).filter("n = 1")
    order = Window.partitionBy("question_id").orderBy("pass_no", F.col("rank"))
    return (
        first.withColumn("place", F.row_number().over(order))
        .filter(F.col("place") <= cap)
        .select(
            "question_id", F.col("place").alias("rank"), "chunk_id", "score", "step_id"
        )
    )


def retry_retrieve(
    questions: DataFrame,
    index: CorpusIndex,
    registry: routing.Registry,
    budget: int = 1,
    options: Settings = Settings(),
    first_pass: DataFrame | None = None,
    cap: int = CONTEXT_CAP,
) -> DataFrame:
    """One pass, and a second one with a query rewritten from the first results.

    ``questions``: question_id, text, and optionally retries (per-question
    budget). ``first_pass`` replaces the first retrieval. The rewritten query
    depends on the question and the results, so passes after the second would
    repeat it only if it stopped changing; the budget is at most 1 in practice.
    """
    columns = ["question_id", "rank", "chunk_id", "score"]
    first = first_pass
    if first is None:
        first = workflow_retrieve(questions, index, registry, options)
    passes = [first.select(*columns, F.lit(1).alias("pass_no"))]
    asked, last = questions, first
    for number in range(2, budget + 2):
        named = chunk_results(
            last.select(*columns), index.chunks, ("source_type", "qualname", "symbol_id")
        )
        again = routing.retry_query(questions, named, options.names)
        if "retries" in questions.columns:
            open_ = questions.filter(F.col("retries") >= number - 1).select("question_id")
            again = again.join(open_, "question_id", "left_semi")
        before = asked.select("question_id", T.strip("text").alias("__before"))
        changed = again.join(before, "question_id").filter(
            (F.col("query") != "") & (F.col("query") != F.col("__before"))
        )
        asked = changed.select("question_id", F.col("query").alias("text"))
        last = workflow_retrieve(asked, index, registry, options)
        passes.append(last.select(*columns, F.lit(number).alias("pass_no")))
    union = passes[0]
    for part in passes[1:]:
        union = union.unionByName(part)
    return collect_passes(union.withColumn("step_id", F.col("pass_no")), cap)


def effective_steps(subtasks: DataFrame, decisions: DataFrame) -> DataFrame:
    """Steps that run, with the query whose results count.

    ``decisions``: question_id, position, action, next_query. A refined query
    replaces the step's own; a stop cuts the steps after it.
    """
    joined = subtasks.join(
        decisions.select("question_id", "position", "action", "next_query"),
        ["question_id", "position"],
        "left",
    )
    before = (
        Window.partitionBy("question_id")
        .orderBy("position")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    action = F.lower(T.strip("action"))
    refined = F.when(action == "refine_query", T.blank_to_null(T.strip("next_query")))
    stopped = F.max(F.when(action == "stop", 1).otherwise(0)).over(before)
    own = F.coalesce(
        T.blank_to_null("retrieval_query"), T.blank_to_null("instruction"), F.col("title")
    )
    return (
        joined.withColumn("__stopped", F.coalesce(stopped, F.lit(0)))
        .filter(F.col("__stopped") == 0)
        .select(
            "question_id", "position", "step_id", "family_id", F.coalesce(refined, own).alias("query")
        )
    )


def plan_retrieve(
    subtasks: DataFrame,
    decisions: DataFrame,
    index: CorpusIndex,
    registry: routing.Registry,
    options: Settings = Settings(),
    cap: int = CONTEXT_CAP,
) -> DataFrame:
    """Results of all steps of each question's plan as one capped list."""
    steps = effective_steps(subtasks, decisions)
    # Each step is a question of its own to the retrieval plan.
    steps = materialize(with_position(steps, ["question_id", "position", "step_id"], "__step"), "steps")
    asked = steps.select(
        F.col("__step").alias("question_id"),
        F.col("query").alias("text"),
        F.col("family_id").alias("family_hint"),
    )
    found = workflow_retrieve(asked, index, registry, options)
    back = steps.select("__step", "question_id", "position", "step_id")
    rows = (
        found.withColumnRenamed("question_id", "__step")
        .join(back, "__step")
        .withColumnRenamed("position", "pass_no")
    )
    return collect_passes(rows, cap)


STATE_COLUMNS = (
    "question_id", "mode", "route_mode", "reason", "confidence", "budget", "passes", "escalated",
)


def route_states(
    questions: DataFrame,
    first: DataFrame,
    index: CorpusIndex,
    options: Settings = Settings(),
    max_retries: int = 1,
) -> DataFrame:
    """One state row per question: ``STATE_COLUMNS``, the text and what was asked last.

    ``questions``: question_id, text, mode (fast, plan, or auto for anything else);
    ``first``: results of the first pass, which decide how an ``auto`` question goes
    on. ``budget`` counts the passes that may follow; a planned question has none.
    """
    top = first.select("question_id", "rank", "chunk_id", "score")
    typed = chunk_results(top, index.chunks, ("source_type",))
    facts = routing.retrieval_confidence(questions, typed)
    asked = F.lower(T.strip("mode"))
    mode = F.when(asked.isin("fast", "plan"), asked).otherwise("auto")
    found, why = routing.route(
        routing.complexity_score("text", options.names)["score"],
        F.col("confidence"),
        routing.evidence_type("text"),
        F.col("has_pdf"),
    )
    reasons = vocab.ROUTE_REASONS
    rows = questions.select("question_id", "text", mode.alias("mode")).join(facts, "question_id")
    routed = rows.select(
        "*",
        F.when(F.col("mode") == "auto", found).otherwise(F.col("mode")).alias("route_mode"),
        F.when(F.col("mode") == "fast", reasons["fast_asked"])
        .when(F.col("mode") == "plan", reasons["plan_asked"])
        .otherwise(why)
        .alias("reason"),
    )
    budget = routing.retry_budget(F.col("mode"), F.col("route_mode"), max_retries)
    return routed.select(
        "*",
        F.when(F.col("route_mode") == "plan", 0).otherwise(budget).alias("budget"),
        F.lit(1).alias("passes"),
        F.lit(False).alias("escalated"),
        F.col("text").alias("asked"),
    )


def route_questions(
    questions: DataFrame,
    index: CorpusIndex,
    registry: routing.Registry,
    options: Settings = Settings(),
    max_retries: int = 1,
    subtasks: DataFrame | None = None,
    decisions: DataFrame | None = None,
    cap: int = CONTEXT_CAP,
) -> tuple[DataFrame, DataFrame]:
    """(states, results) of a table of questions that each go their own way.

    All questions are searched once. Each further pass reads the states that are
    still open (a pass left in the budget, and asked in the pass before), asks their
    rewritten queries in one batch and writes the states back, so a pass costs what
    is open and not what was asked. A query that stays the same closes its question.
    Planned questions take the results of their steps if ``subtasks`` and
    ``decisions`` have any, else those of the first pass. ``results``: question_id,
    rank, chunk_id, score, step_id. ``questions``: question_id, text, mode.
    """
    columns = ["question_id", "rank", "chunk_id", "score"]
    texts = questions.select("question_id", "text")
    first = materialize(workflow_retrieve(texts, index, registry, options).select(*columns), "pass-1")
    states = materialize(route_states(questions, first, index, options, max_retries), "states")
    passes, last = [first.withColumn("pass_no", F.lit(1))], first
    for number in range(2, max_retries + 2):
        open_ = states.filter((F.col("passes") == number - 1) & (F.col("budget") >= number - 1))
        named = chunk_results(
            last.join(open_.select("question_id"), "question_id", "left_semi"),
            index.chunks,
            ("source_type", "qualname", "symbol_id"),
        )
        again = routing.retry_query(open_.select("question_id", "text"), named, options.names)
        changed = again.join(open_.select("question_id", "asked"), "question_id").filter(
            (F.col("query") != "") & (F.col("query") != T.strip("asked"))
        )
        changed = materialize(changed.select("question_id", F.col("query").alias("text")), "open")
        if not changed.take(1):
            break
        found = workflow_retrieve(changed, index, registry, options).select(*columns)
        last = materialize(found, f"pass-{number}")
        passes.append(last.withColumn("pass_no", F.lit(number)))
        renewed = changed.select("question_id", F.col("text").alias("__asked"))
        states = materialize(
            states.join(renewed, "question_id", "left")
            .withColumn("passes", F.when(F.col("__asked").isNotNull(), number).otherwise(F.col("passes")))
            .withColumn("asked", F.coalesce("__asked", "asked"))
            .drop("__asked"),
            "states",
        )
    rows = reduce(DataFrame.unionByName, passes).withColumn("step_id", F.col("pass_no").cast("string"))
    results = collect_passes(rows, cap)
    if subtasks is not None and decisions is not None:
        planned = states.filter("route_mode = 'plan'").select("question_id")
        steps = materialize(subtasks.join(planned, "question_id", "left_semi"), "planned-steps")
        by_plan = plan_retrieve(steps, decisions, index, registry, options, cap)
        by_plan = by_plan.withColumn("step_id", F.col("step_id").cast("string"))
        results = results.join(steps.select("question_id").distinct(), "question_id", "left_anti")
        results = results.unionByName(by_plan)
    return states.select(*STATE_COLUMNS), results


def escalate_questions(states: DataFrame, outcomes: DataFrame) -> DataFrame:
    """States after their answers were tried: questions that need more become planned.

    ``outcomes``: question_id, status, errors, missing, passed; the answers of one
    question count together, and questions without any stay as they are. A question
    escalates once, and only from an automatic route.
    """
    gap = F.coalesce(routing.evidence_gap(F.col("status"), F.col("errors")), F.lit(False))
    tried = outcomes.groupBy("question_id").agg(
        F.bool_or(F.coalesce("missing", F.lit(False))).alias("__missing"),
        F.bool_or(gap).alias("__gap"),
        F.bool_or(F.coalesce("passed", F.lit(False))).alias("__passed"),
    )
    needs = routing.needs_escalation(
        F.col("route_mode"), F.col("escalated"), F.col("__missing"), F.col("__gap"), F.col("__passed")
    )
    rows = states.join(tried, "question_id", "left").withColumn("__up", F.coalesce(needs, F.lit(False)))
    return rows.select(
        *[c for c in states.columns if c not in ("route_mode", "budget", "escalated")],
        F.when(F.col("__up"), "plan").otherwise(F.col("route_mode")).alias("route_mode"),
        F.when(F.col("__up"), 0).otherwise(F.col("budget")).alias("budget"),
        (F.col("escalated") | F.col("__up")).alias("escalated"),
    ).select(*states.columns)
