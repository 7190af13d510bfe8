"""Queries over rerank features, merging and evaluation."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from granary import vocab
from granary.catalog.base import CHECK_ONLY, VIEWS, register
from granary.catalog.search import long
from granary.catalog.texts import sql_list
from granary.functions import text as T
from granary.operators import evaluate as E
from granary.operators import rerank as R
from granary.operators import search as S


def singular(t: str) -> str:
    return f"""CASE WHEN length({t}) > 4 AND {t} LIKE '%ies'
        THEN substr({t}, 1, length({t}) - 3) || 'y'
      WHEN length({t}) > 3 AND {t} LIKE '%s' AND {t} NOT LIKE '%ss'
        THEN substr({t}, 1, length({t}) - 1) ELSE {t} END"""


def plain(expr: str) -> str:
    return f"trim(regexp_replace(lower({expr}), '\\s+', ' ', 'g'))"


SEARCH_TEXT = plain(
    "concat_ws(' ', nullif(qualname, ''), nullif(symbol_id, ''), nullif(module, ''), "
    "nullif(signature, ''), nullif(summary, ''), nullif(text, ''))"
)
WORDS = (
    "list_transform(regexp_extract_all(regexp_replace({0}, '([A-Z]+)([A-Z][a-z])', '\\1 \\2', "
    "'g'), '[A-Z]?[a-z]+|[A-Z]+|[0-9]+'), lambda w: lower(w))"
)
FEATURE_VIEWS: dict[str, str] = {}
FEATURE_VIEWS["v_ask_tokens"] = f"""
    SELECT question_id, t, {singular("t")} AS s FROM (SELECT DISTINCT question_id,
        unnest(regexp_extract_all(lower(text), '[A-Za-z_][A-Za-z0-9_]*')) AS t FROM {{v_asks}}) AS a
    WHERE length(t) > 1 AND t NOT IN ({sql_list(vocab.RERANK_STOPWORDS)})"""
FEATURE_VIEWS["v_pairs"] = f"""
    SELECT r.question_id, r.chunk_id, r.rank, r.score, c.source_type, c.qualname, c.symbol_id,
      c.kind, {SEARCH_TEXT.replace("text", "c.text")} AS search_text,
      lower(split_part(c.qualname, '.', -1)) AS tail,
      list_concat([lower(split_part(c.qualname, '.', -1))],
        {WORDS.format("lower(split_part(c.qualname, '.', -1))")}) AS own,
      [lower(split_part(c.symbol_id, '.', -1))] AS id_tail,
      {WORDS.format("lower(split_part(c.symbol_id, '.', -1))")} AS id_words,
      {WORDS.format("c.module")} AS module_words
    FROM {{v_results}} AS r JOIN {{v_chunks}} AS c ON r.chunk_id = c.chunk_id"""
FEATURE_VIEWS["v_overlap"] = """
    SELECT p.question_id, p.chunk_id, count(t) FILTER (WHERE contains(search_text, t)
        OR contains(search_text, s)) AS overlap
    FROM {v_pairs} AS p LEFT JOIN {v_ask_tokens} AS k ON p.question_id = k.question_id
    GROUP BY p.question_id, p.chunk_id"""
FEATURE_VIEWS["v_preferred"] = """
    SELECT question_id, unnest(range(len(preferred))) AS pos, lower(unnest(preferred)) AS sym
    FROM {v_asks}"""
FEATURE_VIEWS["v_matches"] = """
    SELECT question_id, chunk_id, coalesce(arg_min(level, pos), 0) AS level,
      coalesce(min(pos), 1000000) AS pos, coalesce(arg_min(sym, pos), '') AS matched FROM (
      SELECT p.question_id, p.chunk_id, f.pos, f.sym, CASE
          WHEN ends_with(lower(qualname), sym) OR ends_with(lower(symbol_id), sym) THEN 3
          WHEN ends_with(lower(qualname), split_part(sym, '.', -1))
            OR ends_with(lower(symbol_id), split_part(sym, '.', -1)) THEN 2 END AS level
      FROM {v_pairs} AS p LEFT JOIN (SELECT * FROM {v_preferred} WHERE sym <> '') AS f
        ON f.question_id = p.question_id) AS m
    WHERE level IS NOT NULL GROUP BY question_id, chunk_id"""
FEATURE_VIEWS["v_all_matches"] = """
    SELECT question_id, chunk_id, coalesce(level, 0) AS level, coalesce(m.pos, 1000000) AS pos,
      coalesce(matched, '') AS matched
    FROM {v_results} LEFT JOIN {v_matches} AS m USING (question_id, chunk_id)"""
FEATURE_VIEWS["v_preferred_affinity"] = f"""
    SELECT m.question_id, m.chunk_id, count(t) FILTER (WHERE matched <> '' AND (
        list_contains(words, t) OR list_contains(words, s))) AS affinity
    FROM (SELECT *, list_concat([split_part(matched, '.', -1)],
        {WORDS.format("split_part(matched, '.', -1)")}) AS words FROM {{v_all_matches}}) AS m
      LEFT JOIN {{v_ask_tokens}} AS k ON m.question_id = k.question_id
    GROUP BY m.question_id, m.chunk_id"""
FEATURE_VIEWS["v_symbol_affinity"] = """
    SELECT question_id, chunk_id, hits + CASE WHEN kind = 'class' THEN 2 * helper + 2 * class
        WHEN kind = 'method' THEN method ELSE 0 END AS affinity FROM (
      SELECT p.question_id, p.chunk_id, p.kind, count(t) FILTER (WHERE
          (qualname <> '' AND (list_contains(own, t) OR list_contains(own, s)))
          OR (symbol_id <> '' AND (list_contains(id_tail, t) OR list_contains(id_tail, s)
            OR list_contains(id_words, t) OR list_contains(id_words, s)))
          OR list_contains(module_words, t) OR list_contains(module_words, s)) AS hits,
        count(*) FILTER (WHERE t = 'helper') AS helper, count(*) FILTER (WHERE t = 'class') AS class,
        count(*) FILTER (WHERE t = 'method') AS method
      FROM {v_pairs} AS p LEFT JOIN {v_ask_tokens} AS k ON p.question_id = k.question_id
      GROUP BY p.question_id, p.chunk_id, p.kind) AS a"""


def feature_views(prefix: str, results: str, asks: str) -> None:
    """Check views of the rerank features of a result view and its questions.

    ``results``: question_id, chunk_id, rank, score; ``asks``: question_id, text,
    preferred (a list, blank first entry for none).
    """
    own = {v: f"v_{prefix}{v[2:]}" for v in FEATURE_VIEWS}
    own |= {"v_results": results, "v_asks": asks}
    for view, text in FEATURE_VIEWS.items():
        CHECK_ONLY[own[view]] = re.sub(
            r"\{(\w+)\}", lambda m: "{" + own.get(m.group(1), m.group(1)) + "}", text
        )


feature_views("", "v_results", "v_asks")


def pairs(src):
    """Result rows with chunk columns, question and preferred symbols."""
    asks = src.view("v_asks").select(
        "question_id",
        F.col("text").alias("question"),
        F.filter("preferred", lambda p: p != "").alias("preferred_symbols"),
    )
    rows = src.view("v_results").join(src.view("v_chunks"), "chunk_id")
    return rows.join(asks, "question_id")


@register(
    "search_text",
    f"SELECT chunk_id, {SEARCH_TEXT} AS search_text FROM {{v_chunks}}",
)
def search_text(src):
    return src.view("v_chunks").select("chunk_id", R.search_text().alias("search_text"))


@register("query_overlap", "SELECT question_id, chunk_id, overlap FROM {v_overlap}")
def query_overlap(src):
    overlap = R.query_overlap(T.query_tokens("question"), R.search_text())
    return pairs(src).select("question_id", "chunk_id", overlap.cast("bigint").alias("overlap"))


@register("preferred_match", "SELECT question_id, chunk_id, level, pos, matched FROM {v_all_matches}")
def preferred_match(src):
    rows = pairs(src).withColumn("m", R.preferred_match(F.col("preferred_symbols")))
    # Positions of the view count an empty list's blank entry, which never matches.
    out = rows.select(
        "question_id", "chunk_id", "m.level", F.col("m.index").alias("pos"), "m.matched"
    )
    return long(out, "pos")


@register(
    "preferred_affinity",
    "SELECT question_id, chunk_id, affinity FROM {v_preferred_affinity}",
)
def preferred_affinity(src):
    rows = pairs(src).withColumn("m", R.preferred_match(F.col("preferred_symbols")))
    hits = R.preferred_affinity(F.col("m.matched"), T.query_tokens("question"))
    return rows.select("question_id", "chunk_id", hits.cast("bigint").alias("affinity"))


@register("symbol_affinity", "SELECT question_id, chunk_id, affinity FROM {v_symbol_affinity}")
def symbol_affinity(src):
    hits = R.symbol_affinity(T.query_tokens("question"))
    return pairs(src).select("question_id", "chunk_id", hits.cast("bigint").alias("affinity"))


_FEATURES = """
    {v_pairs} AS p JOIN {v_all_matches} AS m USING (question_id, chunk_id)
    JOIN {v_preferred_affinity} AS a USING (question_id, chunk_id)
    JOIN {v_overlap} AS o USING (question_id, chunk_id)
    JOIN {v_symbol_affinity} AS y USING (question_id, chunk_id)
    JOIN {v_asks} AS q USING (question_id)"""
_SYMBOL = "CASE WHEN qualname <> '' OR symbol_id <> '' THEN 1 ELSE 0 END"
_GENERATED = "CASE WHEN source_type = 'generated' THEN 1 ELSE 0 END"


@register(
    "rerank_workflow",
    f"""SELECT question_id, chunk_id, row_number() OVER (PARTITION BY question_id ORDER BY
          CASE WHEN preferred[1] = '' THEN 0 ELSE level END DESC,
          CASE WHEN preferred[1] = '' THEN 0 ELSE a.affinity END DESC,
          CASE WHEN preferred[1] = '' THEN 0 ELSE m.pos END ASC,
          CASE WHEN preferred[1] = '' THEN 0 ELSE overlap END DESC,
          CASE WHEN preferred[1] = '' THEN 0 ELSE {_GENERATED} END DESC,
          CASE WHEN preferred[1] = '' THEN 0 ELSE {_SYMBOL} END DESC,
          CASE WHEN preferred[1] = '' THEN 0 ELSE score END DESC, rank) AS rank
        FROM {_FEATURES}""",
)
def rerank_workflow(src):
    return long(R.rerank_workflow(pairs(src)).select("question_id", "chunk_id", "rank"), "rank")


@register(
    "rerank_graph",
    f"""SELECT question_id, chunk_id, row_number() OVER (PARTITION BY question_id ORDER BY
          y.affinity DESC, a.affinity DESC, {_SYMBOL} DESC, overlap DESC, {_GENERATED} DESC,
          score DESC, level DESC, m.pos ASC, rank) AS rank
        FROM {_FEATURES}""",
)
def rerank_graph(src):
    return long(R.rerank_graph(pairs(src)).select("question_id", "chunk_id", "rank"), "rank")


_CANDIDATE = """substr(concat_ws(chr(10), coalesce(nullif(qualname, ''), nullif(symbol_id, '')),
    nullif(signature, ''), nullif(summary, ''), CASE WHEN summary = '' THEN nullif(text, '') END),
    1, 800)"""


@register("candidate_text", f"SELECT chunk_id, {_CANDIDATE} AS candidate FROM {{v_chunks}}")
def candidate_text(src):
    return src.view("v_chunks").select("chunk_id", R.candidate_text().alias("candidate"))


def length_scorer(queries, texts):
    """Deterministic stand-in for a pair model."""
    return [float((len(q) * 7 + len(t) * 3) % 5) for q, t in zip(queries, texts, strict=True)]


@register(
    "topn_rerank",
    f"""SELECT question_id, chunk_id, row_number() OVER (PARTITION BY question_id ORDER BY
          CASE WHEN rank <= 12 THEN 0 ELSE 1 END,
          CASE WHEN rank <= 12 THEN (length(q.text) * 7 + length(candidate) * 3) % 5 ELSE 0 END DESC,
          rank) AS rank
        FROM {{v_results}} JOIN {{v_asks}} AS q USING (question_id) JOIN (
          SELECT chunk_id, {_CANDIDATE} AS candidate FROM {{v_chunks}}) AS c USING (chunk_id)""",
)
def topn_rerank(src):
    ranked = R.topn_rerank(pairs(src), length_scorer, 12)
    return long(ranked.select("question_id", "chunk_id", "rank"), "rank")


# Three lists per question out of its results, overlapping in part.
VIEWS["v_result_sets"] = """
    SELECT question_id, sub_no, chunk_id, score * (1 + sub_no) AS score,
      row_number() OVER (PARTITION BY question_id, sub_no
        ORDER BY score * (1 + sub_no) DESC, chunk_id) AS rank
    FROM {v_results} CROSS JOIN (VALUES (0), (1), (2)) AS n(sub_no)
    WHERE (rank + question_id) % 3 <= sub_no"""


@register(
    "merge_result_sets",
    """WITH f AS (SELECT *, row_number() OVER (PARTITION BY question_id, chunk_id
           ORDER BY sub_no, rank) AS nth FROM {v_result_sets}),
         g AS (SELECT question_id, chunk_id, count(*) AS hits, max(score) AS score,
           min(rank) AS best_rank, max(CASE WHEN nth = 1 THEN sub_no END) AS s,
           max(CASE WHEN nth = 1 THEN rank END) AS r FROM f GROUP BY question_id, chunk_id)
       SELECT question_id, chunk_id, hits, round(score, 6) AS score, best_rank, row_number() OVER (
         PARTITION BY question_id ORDER BY hits DESC, score DESC, best_rank, s, r) AS rank FROM g""",
)
def merge_result_sets(src):
    merged = S.merge_result_sets(src.view("v_result_sets"))
    return long(merged.withColumn("score", F.round("score", 6)), "rank", "best_rank")


# A result is relevant when it is of the language of its question's shortest text.
VIEWS["v_relevant"] = """
    SELECT question_id AS query_id, chunk_id FROM {v_results} JOIN {labels}
      ON chunk_id = doc_id AND quality = 1 AND toxic = 0 WHERE score < 0.6"""
_RANKS = """(SELECT q.question_id, min(r.rank) AS rank FROM {v_asks} AS q LEFT JOIN (
      SELECT * FROM {v_results} JOIN {v_relevant} AS k ON k.query_id = question_id
        AND k.chunk_id = v_results.chunk_id) AS r ON r.question_id = q.question_id
    GROUP BY q.question_id) AS x"""


def judged(src):
    results = src.view("v_results").withColumnRenamed("question_id", "query_id")
    queries = src.view("v_asks").withColumnRenamed("question_id", "query_id")
    return queries, results, src.view("v_relevant")


@register(
    "mrr",
    f"""SELECT count(*) AS queries, round(avg(coalesce(1.0::DOUBLE / rank, 0.0::DOUBLE)), 6) AS mrr
        FROM {_RANKS}""",
)
def mrr(src):
    return E.mrr(*judged(src)).withColumn("mrr", F.round("mrr", 6))


@register(
    "hit_at_k",
    f"""SELECT count(*) AS queries, count(*) FILTER (WHERE rank <= 15) AS hits,
          round(avg(CASE WHEN rank <= 15 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS rate
        FROM {_RANKS}""",
)
def hit_at_k(src):
    return E.hit_at_k(*judged(src), 15).withColumn("rate", F.round("rate", 6))


@register(
    "pass_rate",
    """SELECT event_type AS suite, count(*) FILTER (WHERE value > 5) AS passed, count(*) AS total
       FROM {events} GROUP BY event_type""",
)
def pass_rate(src):
    cases = src.table("events").select(
        F.col("event_type").alias("suite"), (F.col("value") > 5).alias("passed")
    )
    return E.pass_rate(cases)
