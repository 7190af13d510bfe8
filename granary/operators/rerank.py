"""Rerank features and orders.

Rows are results joined with their chunk columns and their question:
question_id, rank, score, question tokens, preferred symbols. All features
are computed inside the row; the only shuffle is the per-question order.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary import vocab
from granary.functions import text as T
from granary.runtime import let, ship_package

NO_MATCH = 10**6
TOP_N = 20
CANDIDATE_CHARS = 800
DEFAULT_NAMES = vocab.Names()


def search_text() -> Column:
    parts = ("qualname", "symbol_id", "module", "signature", "summary", "text")
    return T.normalize_text(F.concat_ws(" ", *[T.blank_to_null(p) for p in parts]))


def _any_form(token: Column, test: Callable[[Column], Column]) -> Column:
    return F.exists(T.token_forms(token), test)


def query_overlap(tokens: Column, haystack: Column) -> Column:
    """Query tokens of which some form occurs in the text."""
    return let(
        haystack,
        lambda text: F.size(
            F.filter(tokens, lambda t: _any_form(t, lambda form: F.contains(text, form)))
        ),
    )


def _hits(tokens: Column, words: Column) -> Column:
    return let(
        words,
        lambda known: F.size(
            F.filter(tokens, lambda t: _any_form(t, lambda form: F.array_contains(known, form)))
        ),
    )


def preferred_match(preferred: Column) -> Column:
    """(level, index, matched) of the first preferred symbol that matches at all."""

    def match(name, ident):
        def level(symbol, at):
            tail = F.substring_index(symbol, ".", -1)
            full = F.endswith(name, symbol) | F.endswith(ident, symbol)
            last = (tail != "") & (F.endswith(name, tail) | F.endswith(ident, tail))
            found = F.when(symbol == "", 0).when(full, 3).when(last, 2).otherwise(0)
            return F.struct(
                found.alias("level"), at.cast("int").alias("index"), symbol.alias("matched")
            )

        levels = F.transform(F.transform(preferred, T.normalize_text), level)
        none = F.struct(
            F.lit(0).alias("level"), F.lit(NO_MATCH).alias("index"), F.lit("").alias("matched")
        )
        first = F.try_element_at(F.filter(levels, lambda x: x["level"] > 0), F.lit(1))
        return F.coalesce(first, none)

    return let(
        T.normalize_text("qualname"),
        lambda name: let(T.normalize_text("symbol_id"), lambda ident: match(name, ident)),
    )


def _expanded(tail: Column, token_aliases: Mapping, query_aliases: Mapping) -> Column:
    words = T.split_symbol_words(tail)
    return F.concat(
        F.array(tail),
        words,
        F.flatten(F.transform(words, lambda w: T.aliases_of(w, token_aliases))),
        T.aliases_of(tail, query_aliases),
    )


def preferred_affinity(
    symbol: Column,
    tokens: Column,
    names: vocab.Names = DEFAULT_NAMES,
    token_aliases: Mapping[str, Sequence[str]] = vocab.SYMBOL_TOKEN_ALIASES,
    query_aliases: Mapping[str, Sequence[str]] = vocab.SYMBOL_QUERY_ALIASES,
) -> Column:
    """Query tokens that speak of a symbol: its name, words or aliases."""
    tail = F.lower(F.substring_index(symbol, ".", -1))
    words = _expanded(tail, token_aliases, names.fill_map(query_aliases))
    return F.when(symbol == "", 0).otherwise(_hits(tokens, words))


def symbol_affinity(
    tokens: Column,
    names: vocab.Names = DEFAULT_NAMES,
    token_aliases: Mapping[str, Sequence[str]] = vocab.SYMBOL_TOKEN_ALIASES,
    query_aliases: Mapping[str, Sequence[str]] = vocab.SYMBOL_QUERY_ALIASES,
) -> Column:
    """The same for the result's own names, with bonuses for kinds asked for."""
    empty = F.array().cast("array<string>")

    def words(name: str) -> Column:
        tail = F.lower(T.tail_of(name))
        return F.when(tail == "", empty).otherwise(
            _expanded(tail, token_aliases, names.fill_map(query_aliases))
        )

    known = F.concat(words("qualname"), words("symbol_id"), T.split_symbol_words("module"))

    def bonus(word: str, kind: str, value: int) -> Column:
        asked = F.array_contains(tokens, word) & (F.col("kind") == kind)
        return F.when(asked, value).otherwise(0)

    return (
        _hits(tokens, known)
        + bonus("helper", "class", 2)
        + bonus("class", "class", 2)
        + bonus("method", "method", 1)
    )


def _features(rows: DataFrame, names: vocab.Names) -> DataFrame:
    generated = (F.col("source_type") == "generated").cast("int")
    symbol = ((T.or_empty("qualname") != "") | (T.or_empty("symbol_id") != "")).cast("int")
    tokens = F.col("__tokens")
    return (
        rows.withColumn("__tokens", T.query_tokens("question"))
        .withColumn("__match", preferred_match(F.col("preferred_symbols")))
        .withColumn("__pref", preferred_affinity(F.col("__match.matched"), tokens, names))
        .withColumn("__overlap", query_overlap(tokens, search_text()))
        .withColumn("__generated", generated)
        .withColumn("__symbol", symbol)
        .withColumn("__affinity", symbol_affinity(tokens, names))
    )


def _ranked(rows: DataFrame, keys: list[Column], apply: Column | None = None) -> DataFrame:
    if apply is not None:
        keys = [F.when(apply, key) for key in keys]
    order = [F.desc(key) for key in keys] + [F.asc("rank")]
    window = Window.partitionBy("question_id").orderBy(*order)
    kept = [c for c in rows.columns if not c.startswith("__")]
    return rows.withColumn("__new", F.row_number().over(window)).select(
        *[c for c in kept if c != "rank"], F.col("__new").alias("rank")
    )


def rerank_workflow(rows: DataFrame, names: vocab.Names = DEFAULT_NAMES) -> DataFrame:
    """Order by preferred symbols first; no change for questions without any.

    ``rows``: question_id, question, preferred_symbols, rank, score, chunk columns.
    """
    featured = _features(rows, names)
    keys = [
        F.col("__match.level"),
        F.col("__pref"),
        -F.col("__match.index"),
        F.col("__overlap"),
        F.col("__generated"),
        F.col("__symbol"),
        F.col("score"),
    ]
    return _ranked(featured, keys, F.size("preferred_symbols") > 0)


def rerank_graph(rows: DataFrame, names: vocab.Names = DEFAULT_NAMES) -> DataFrame:
    """Order by what the question says about the result's own symbol."""
    featured = _features(rows, names)
    keys = [
        F.col("__affinity"),
        F.col("__pref"),
        F.col("__symbol"),
        F.col("__overlap"),
        F.col("__generated"),
        F.col("score"),
        F.col("__match.level"),
        -F.col("__match.index"),
    ]
    return _ranked(featured, keys)


def candidate_text(limit: int = CANDIDATE_CHARS) -> Column:
    """What a pair scorer reads about a result."""
    name = F.coalesce(T.blank_to_null("qualname"), T.blank_to_null("symbol_id"))
    summary = T.blank_to_null("summary")
    body = F.when(summary.isNull(), T.blank_to_null("text"))
    return F.left(
        F.concat_ws("\n", name, T.blank_to_null("signature"), summary, body), F.lit(limit)
    )


def topn_rerank(
    rows: DataFrame,
    scorer: Callable[[Sequence[str], Sequence[str]], Sequence[float]],
    top_n: int = TOP_N,
    report: bool = False,
) -> DataFrame:
    """Reorder the first ``top_n`` results of each question by a pair scorer.

    The rows of a question are packed into one, so the scorer is always given a
    whole list, however rows are cut into batches. Ties keep their order, and a
    question keeps its whole order if it is blank or any of its pairs failed to
    score; other questions are not touched by that. With ``report`` the column
    ``rerank_error`` tells what the scorer raised.
    """

    @F.pandas_udf("struct<values:array<double>,problem:string>")
    def score(queries: pd.Series, texts: pd.Series) -> pd.DataFrame:
        out = []
        for query, own in zip(queries, texts):
            try:
                values = [float(v) for v in scorer([query] * len(own), list(own))]
                if len(values) != len(own):
                    raise ValueError(f"{len(values)} scores for {len(own)} texts")
                out.append((values, None))
            except Exception as problem:
                out.append((None, f"{type(problem).__name__}: {problem}"))
        return pd.DataFrame(out, columns=["values", "problem"])

    ship_package()
    in_head = F.col("rank") <= top_n
    texts = rows.withColumn("__text", F.when(in_head, candidate_text()))
    # At most top_n texts a question; a question has one row.
    packed = texts.filter(in_head).groupBy("question_id").agg(
        F.first("question").alias("__question"),
        F.sort_array(F.collect_list(F.struct("rank", "__text"))).alias("__head"),
    )
    listed = F.transform("__head", lambda r: F.coalesce(r["__text"], F.lit("")))
    scored = packed.withColumn("__scored", score(F.col("__question"), listed)).select(
        F.col("question_id").alias("__id"),
        F.transform("__head", lambda r: r["rank"]).alias("__ranks"),
        F.col("__scored.values").alias("__values"),
        F.col("__scored.problem").alias("rerank_error"),
        F.exists("__head", lambda r: r["__text"] != "").alias("__some"),
        (T.strip("__question") != "").alias("__asked"),
    )
    kept = [c for c in rows.columns if c not in ("rank", "rerank_error")]
    both = rows.drop("rerank_error").join(scored, F.col("question_id").eqNullSafe(F.col("__id")), "left")
    value = F.try_element_at("__values", F.array_position("__ranks", F.col("rank")).cast("int"))
    whole = F.forall("__values", lambda v: v.isNotNull() & ~F.isnan(v))
    usable = F.coalesce(F.col("__asked") & F.col("__some") & whole, F.lit(False))
    both = both.withColumn("__usable", usable).withColumn("__value", F.when(in_head, value))
    first = F.when(F.col("__usable") & in_head, F.col("__value"))
    order = Window.partitionBy("question_id").orderBy(
        F.asc(~in_head), F.desc_nulls_last(first), F.asc("rank")
    )
    if report:
        kept.append("rerank_error")
    return both.select(*kept, F.row_number().over(order).alias("rank"))
