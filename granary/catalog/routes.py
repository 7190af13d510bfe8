"""Queries over routing, features, intents, rules and obligations."""

from __future__ import annotations

from pyspark.sql import functions as F

from granary import vocab
from granary.catalog.base import CHECK_ONLY, VIEWS, register
from granary.catalog.ranking import plain
from granary.catalog.search import long
from granary.operators import features as Q
from granary.operators import routing as R
from granary.operators.context import chunk_results, context_items
from granary.functions import text as T

NAMES = vocab.Names(package="quarry", constructor="MainThing", algebra="main algebra")


def any_of(text: str, markers) -> str:
    items = ", ".join("'" + m.replace("'", "''") + "'" for m in markers)
    return f"(len(list_filter([{items}], lambda m: contains({text}, m))) > 0)"


def count_of(text: str, markers) -> str:
    items = ", ".join("'" + m.replace("'", "''") + "'" for m in markers)
    return f"len(list_filter([{items}], lambda m: contains({text}, m)))"


def registry(src) -> R.Registry:
    return R.Registry.of(src.view("v_families"), src.view("v_workflows"))


# Questions with retrieved context and family hints on some of them.
VIEWS["v_hinted"] = """
    SELECT question_id, text,
      CASE WHEN question_id % 3 = 0 THEN concat('Uses OP_', CAST(question_id % 30 AS STRING),
        ' and  Cls', CAST(question_id % 7 AS STRING), '.op_', CAST(question_id % 32 AS STRING),
        ' une de la') ELSE '' END AS context,
      CASE (question_id / 100) % 6 WHEN 0 THEN ' b. French' WHEN 1 THEN 'german' WHEN 2 THEN 'a'
        WHEN 3 THEN 'unknown' ELSE '' END AS family_hint
    FROM {v_asked}""".replace("(question_id / 100)", "CAST(floor(question_id / 100) AS BIGINT)")
CHECK_ONLY["v_q"] = f"""
    SELECT question_id, {plain("text")} AS q, {plain("context")} AS c, CASE trim(family_hint)
        WHEN 'b. French' THEN 'B' WHEN 'german' THEN 'C' WHEN 'a' THEN 'A' ELSE '' END AS forced
    FROM {{v_hinted}}"""
CHECK_ONLY["v_gates"] = f"""
    SELECT question_id, {any_of("q", NAMES.fill_all(vocab.OUT_OF_SCOPE))} OR (contains(q, 'prove')
        AND {any_of("q", vocab.PROOF_SUBJECTS)}) AS out_of_scope,
      {any_of("q", vocab.CONCEPTUAL)} AND NOT {any_of("q", vocab.ACTIONS)} AS conceptual,
      {any_of("q", vocab.FAMILY_META)} AS family_meta FROM {{v_q}}"""


def _hits(rows: str, text: str, rank: int, weight: int, field: str) -> str:
    return f"""SELECT question_id, no, keyword, {rank} * 1000 + pos AS ord, CASE
          WHEN contains({text}, p) THEN {weight} + CASE WHEN contains(p, ' ') THEN 1 ELSE 0 END
          WHEN contains(p, ' ') AND len(list_filter(string_split(p, ' '),
            lambda w: NOT contains({text}, w))) = 0 THEN {weight} END AS points
        FROM {{v_q}} CROSS JOIN (SELECT no, keyword, pos, lower(keyword) AS p FROM (
          SELECT {rows}, unnest(range(len({field}))) AS pos, unnest({field}) AS keyword
          FROM {{{'v_families' if 'family' in rows else 'v_workflows'}}}) AS u) AS k"""


CHECK_ONLY["v_family_scores"] = f"""
    SELECT q.question_id, f.family_no AS no, f.id, f.name, coalesce(score, 0)
        + CASE WHEN q.forced = f.id THEN 6 ELSE 0 END AS score, coalesce(matched, '') AS matched
    FROM {{v_q}} AS q CROSS JOIN {{v_families}} AS f LEFT JOIN (
      SELECT question_id, no, sum(points) AS score, string_agg(keyword, '|' ORDER BY ord) AS matched
      FROM (SELECT question_id, no, keyword, min(ord) AS ord, sum(points) AS points FROM (
          {_hits("family_no AS no", "q", 0, 3, "keywords")}
          UNION ALL {_hits("family_no AS no", "c", 1, 1, "keywords")}) AS h
        WHERE points IS NOT NULL GROUP BY question_id, no, keyword) AS g
      GROUP BY question_id, no) AS s ON s.question_id = q.question_id AND s.no = f.family_no"""
CHECK_ONLY["v_workflow_scores"] = f"""
    SELECT question_id, no, w.id, w.family_id, w.title, w.preferred_symbols, score, matched
    FROM (SELECT question_id, no, sum(points) AS score, string_agg(keyword, '|' ORDER BY ord)
          AS matched FROM (SELECT question_id, no, keyword, min(ord) AS ord, sum(points) AS points
        FROM ({_hits("workflow_no AS no", "q", 0, 4, "keywords")}
          UNION ALL {_hits("workflow_no AS no", "c", 1, 2, "keywords")}
          UNION ALL {_hits("workflow_no AS no", "c", 2, 3, "preferred_symbols")}) AS h
        WHERE points IS NOT NULL GROUP BY question_id, no, keyword) AS g
      GROUP BY question_id, no) AS s JOIN {{v_workflows}} AS w ON w.workflow_no = s.no"""
CHECK_ONLY["v_best_family"] = """
    SELECT * FROM (SELECT s.*, row_number() OVER (PARTITION BY s.question_id
        ORDER BY score DESC, no) AS n FROM {v_family_scores} AS s JOIN {v_q} AS q
        ON q.question_id = s.question_id
      WHERE CASE WHEN forced = '' THEN score > 0 ELSE s.id = forced END) AS b WHERE n = 1"""
CHECK_ONLY["v_ranked_workflows"] = """
    SELECT s.*, row_number() OVER (PARTITION BY s.question_id ORDER BY score DESC, no) AS n,
      lead(score) OVER (PARTITION BY s.question_id ORDER BY score DESC, no) AS second
    FROM {v_workflow_scores} AS s JOIN {v_q} AS q ON q.question_id = s.question_id
    WHERE forced = '' OR family_id = forced"""
CHECK_ONLY["v_selected"] = """
    SELECT question_id, text, CASE WHEN by_workflow THEN wf.id ELSE coalesce(b_id, '') END
        AS family_id,
      CASE WHEN by_workflow THEN wf.name ELSE coalesce(b_name, '') END AS family_name,
      CASE WHEN by_workflow THEN w_id ELSE '' END AS workflow_id,
      CASE WHEN by_workflow THEN w_title ELSE '' END AS workflow_title,
      CASE WHEN by_workflow THEN least(0.98::DOUBLE, 0.55::DOUBLE
          + greatest(w_score - coalesce(second, 0), 0)::DOUBLE / greatest(w_score + 6, 1))
        WHEN b_id IS NULL THEN 0.0::DOUBLE WHEN meta THEN 0.4::DOUBLE ELSE 0.35::DOUBLE END
        AS confidence,
      CASE WHEN by_workflow THEN w_matched ELSE coalesce(b_matched, '') END AS matched,
      CASE WHEN by_workflow THEN preferred_symbols ELSE [] END AS preferred_symbols
    FROM (SELECT y.*, w.id AS w_id, w.title AS w_title, w.score AS w_score, w.second,
        w.matched AS w_matched, w.family_id AS w_family, w.preferred_symbols,
        w.id IS NOT NULL AND NOT closed AND NOT meta AS by_workflow
      FROM (SELECT q.question_id, h.text, forced = '' AND (out_of_scope OR conceptual) AS closed,
          b.id IS NOT NULL AND forced = '' AND family_meta AS meta,
          CASE WHEN forced <> '' OR NOT (out_of_scope OR conceptual) THEN b.id END AS b_id,
          CASE WHEN forced <> '' OR NOT (out_of_scope OR conceptual) THEN b.name END AS b_name,
          CASE WHEN forced <> '' OR NOT (out_of_scope OR conceptual) THEN b.matched END AS b_matched
        FROM {v_q} AS q JOIN {v_gates} AS g ON g.question_id = q.question_id
          JOIN {v_hinted} AS h ON h.question_id = q.question_id
          LEFT JOIN {v_best_family} AS b ON b.question_id = q.question_id) AS y
      LEFT JOIN {v_ranked_workflows} AS w ON w.question_id = y.question_id AND w.n = 1) AS x
    LEFT JOIN {v_families} AS wf ON wf.id = w_family"""


@register(
    "keyword_hits",
    """SELECT question_id, id, score, matched FROM {v_family_free} WHERE score > 0""",
)
def keyword_hits(src):
    q = T.normalize_text("text")
    rows = src.view("v_hinted")
    found = None
    for family in registry(src).families:
        part = rows.select(
            "question_id",
            F.lit(family.id).alias("id"),
            R.keyword_hits(q, family.keywords, 3).alias("h"),
        )
        found = part if found is None else found.unionByName(part)
    return long(
        found.select(
            "question_id", "id", "h.score", F.array_join("h.hits", "|").alias("matched")
        ).filter("score > 0"),
        "score",
    )


CHECK_ONLY["v_family_free"] = f"""
    SELECT question_id, f.id, CAST(sum(points) AS BIGINT) AS score,
      string_agg(keyword, '|' ORDER BY ord) AS matched
    FROM ({_hits("family_no AS no", "q", 0, 3, "keywords")}) AS h
      JOIN {{v_families}} AS f ON f.family_no = h.no
    WHERE points IS NOT NULL GROUP BY question_id, f.id"""


@register(
    "scope_gates",
    "SELECT question_id, out_of_scope, conceptual, family_meta FROM {v_gates}",
)
def scope_gates(src):
    gates = R.scope_gates(T.normalize_text("text"), NAMES)
    return src.view("v_hinted").select(
        "question_id", *[test.alias(name) for name, test in gates.items()]
    )


def selected(src):
    return R.choose_workflow(src.view("v_hinted"), registry(src), NAMES)


@register(
    "choose_workflow",
    """SELECT question_id, family_id, family_name, workflow_id, workflow_title,
         round(confidence, 6) AS confidence, matched,
         array_to_string(preferred_symbols, '|') AS symbols
       FROM {v_selected}""",
)
def choose_workflow(src):
    return selection_fields(selected(src))


register(
    "choose_workflow_tables",
    """SELECT question_id, family_id, family_name, workflow_id, workflow_title,
         round(confidence, 6) AS confidence, matched,
         array_to_string(preferred_symbols, '|') AS symbols
       FROM {v_selected}""",
)(
    lambda src: selection_fields(
        R.choose_workflow(
            src.view("v_hinted"), R.RegistryTables(src.view("v_families"), src.view("v_workflows")), NAMES
        )
    )
)


def selection_fields(rows):
    return rows.select(
        "question_id",
        "family_id",
        "family_name",
        "workflow_id",
        "workflow_title",
        F.round("confidence", 6).alias("confidence"),
        F.array_join("matched_on", "|").alias("matched"),
        F.array_join("preferred_symbols", "|").alias("symbols"),
    )


@register(
    "normalize_family_id",
    """SELECT question_id, forced AS family_id FROM {v_q}""",
)
def normalize_family_id(src):
    ident = R.normalize_family_id("family_hint", registry(src))
    return src.view("v_hinted").select("question_id", ident.alias("family_id"))


CHECK_ONLY["v_focus"] = f"""
    SELECT question_id, arg_max(sym, score * 1000 - pos) AS sym, max(score) AS score FROM (
      SELECT question_id, pos, sym, CASE WHEN contains(q, tail) THEN 4 ELSE 0 END
        + len(list_filter(regexp_split_to_array(tail, '[^a-z0-9]+'),
            lambda w: length(w) > 2 AND contains(q, w))) AS score
      FROM (SELECT question_id, {plain("text")} AS q, pos, sym,
          lower(split_part(sym, '.', -1)) AS tail
        FROM (SELECT question_id, text, unnest(range(len(preferred_symbols))) AS pos,
            unnest(preferred_symbols) AS sym FROM {{v_named}}) AS u WHERE pos < 3) AS t) AS s
    GROUP BY question_id"""
# Selections as they are, with questions that name one of the symbols.
CHECK_ONLY["v_named"] = """
    SELECT question_id, family_id, family_name, workflow_id, workflow_title, preferred_symbols,
      concat(text, ' op_', CAST(question_id % 11 AS VARCHAR), ' ') AS text FROM {v_selected}"""


def named(src):
    text = F.concat("text", F.lit(" op_"), (F.col("question_id") % 11).cast("string"), F.lit(" "))
    return selected(src).withColumn("text", text)


@register(
    "focused_symbol",
    """SELECT question_id, sym AS symbol, CAST(score AS BIGINT) AS score FROM {v_focus}""",
)
def focused_symbol(src):
    best = R.focused_symbol(F.col("text"), F.slice("preferred_symbols", 1, 3), NAMES)
    rows = named(src).select("question_id", best.alias("b")).filter("b.symbol IS NOT NULL")
    return long(rows.select("question_id", "b.symbol", "b.score"), "score")


@register(
    "expand_queries",
    """WITH c AS (SELECT question_id, trim(text, ' ' || chr(10)) AS base, n.*, f.sym, f.score
           FROM {v_named} AS n LEFT JOIN {v_focus} AS f USING (question_id)),
         e AS (SELECT question_id, 0 AS place, base AS query FROM c
           UNION ALL SELECT question_id, 1, concat_ws(' ', base, 'quarry', workflow_title,
             array_to_string(preferred_symbols, ' ')) FROM c WHERE workflow_id <> ''
           UNION ALL SELECT question_id, 2, concat_ws(' ', base, 'quarry', sym) FROM c
             WHERE workflow_id <> '' AND score > 0
           UNION ALL SELECT question_id, 1, concat_ws(' ', base, 'quarry', family_name) FROM c
             WHERE workflow_id = '' AND family_id <> '')
       SELECT question_id, row_number() OVER (PARTITION BY question_id ORDER BY place) - 1 AS sub_no,
         query FROM e""".replace("n.*", "n.workflow_id, n.workflow_title, n.preferred_symbols, "
    "n.family_id, n.family_name"),
)
def expand_queries(src):
    return long(
        R.expand_queries(named(src), NAMES).select("question_id", "sub_no", "query"), "sub_no"
    )


@register(
    "context_haystack",
    f"""SELECT question_id, {plain("string_agg(t, chr(10) ORDER BY rank)")} AS context FROM (
          SELECT question_id, rank, concat_ws(chr(10), title, location, trim(shown,
              ' ' || chr(10))) AS t FROM {{v_items}}) AS i GROUP BY question_id""",
)
def context_haystack(src):
    return R.context_haystack(items(src))


CHECK_ONLY["v_items"] = """
    SELECT question_id, rank, chunk_id, source_type, score, coalesce(nullif(qualname, ''),
        nullif(symbol_id, ''), nullif(section_title, ''), source) AS title,
      location, CASE WHEN source_type = 'generated' THEN text ELSE substr(text, 1, 1600) END
        AS shown
    FROM {v_results} JOIN {v_located} USING (chunk_id)"""
CHECK_ONLY["v_located"] = """
    SELECT *, CASE WHEN file_path <> '' AND line IS NOT NULL
        THEN file_path || ':' || CAST(line AS VARCHAR) WHEN file_path <> '' THEN file_path
      WHEN source_type = 'pdf' AND page_start IS NOT NULL AND page_end IS NOT NULL
        THEN 'pp. ' || CAST(page_start AS VARCHAR) || '-' || CAST(page_end AS VARCHAR)
      WHEN source_type = 'pdf' AND page_start IS NOT NULL
        THEN 'p. ' || CAST(page_start AS VARCHAR) ELSE source END AS location
    FROM {v_chunks}"""


def items(src, by_source: bool = False):
    results = chunk_results(src.view("v_results"), src.view("v_chunks"))
    return context_items(results, by_source=by_source)


@register(
    "evidence_type",
    f"""SELECT question_id, CASE WHEN {any_of("lower(text)", vocab.DOCUMENT_MARKERS)}
          THEN 'symbol+pdf' ELSE 'symbol-only' END AS evidence FROM {{v_hinted}}""",
)
def evidence_type(src):
    return src.view("v_hinted").select("question_id", R.evidence_type("text").alias("evidence"))


def complexity_sql(asked: str) -> str:
    return f"""
    SELECT question_id, text, words, refs, goals, limits, asked,
      least(refs, 3) + CASE WHEN words > 20 THEN 1 ELSE 0 END + CASE WHEN words > 40 THEN 1
        ELSE 0 END + least(goals, 2) + least(limits, 2) AS score,
      least(refs, 3) + CASE WHEN words > 20 THEN 1 ELSE 0 END + CASE WHEN words > 40 THEN 1
        ELSE 0 END + least(goals, 3) + least(limits, 2) + CASE WHEN asked > 1 THEN 1 ELSE 0 END
        AS wide_score
    FROM (SELECT question_id, text, len(regexp_extract_all(text, '[A-Za-z0-9_]+')) AS words,
        len(list_distinct(regexp_extract_all(text,
          '[A-Za-z_][A-Za-z0-9_]*\\.[A-Za-z_][A-Za-z0-9_]*')))
          + {count_of("lower(text)", NAMES.fill_all(vocab.KNOWN_API_MARKERS))} AS refs,
        {count_of("' ' || lower(trim(text)) || ' '", vocab.GOAL_MARKERS)} AS goals,
        {count_of("' ' || lower(trim(text)) || ' '", vocab.CONSTRAINT_MARKERS)} AS limits,
        length(text) - length(replace(text, '?', '')) AS asked
      FROM ({asked}) AS a) AS f"""


CHECK_ONLY["v_complexity"] = complexity_sql(
    """SELECT question_id, concat(text, ' The recurrence and annihilator? Or with MainThing?')
          AS text FROM {v_asked}"""
)
CHECK_ONLY["v_ask_complexity"] = complexity_sql("SELECT question_id, text FROM {v_asks}")


@register(
    "complexity_score",
    """SELECT question_id, score, wide_score, words, refs, goals, limits FROM {v_complexity}""",
)
def complexity_score(src):
    text = F.concat("text", F.lit(" The recurrence and annihilator? Or with MainThing?"))
    rows = src.view("v_asked").select(
        "question_id",
        R.complexity_score(text, NAMES).alias("c"),
        R.complexity_score(text, NAMES, goal_cap=3, count_questions=True).alias("w"),
    )
    return long(
        rows.select(
            "question_id",
            "c.score",
            F.col("w.score").alias("wide_score"),
            F.col("c.word_count").alias("words"),
            F.col("c.api_refs").alias("refs"),
            F.col("c.goal_markers").alias("goals"),
            F.col("c.constraint_markers").alias("limits"),
        ),
        "score", "wide_score", "words", "refs", "goals", "limits",
    )


# Results of the questions.
CHECK_ONLY["v_confidence"] = """
    SELECT q.question_id, coalesce(CASE WHEN symbols >= 2 THEN least(1.0::DOUBLE, mean + 0.03::DOUBLE)
        ELSE mean END, 0.0::DOUBLE) AS confidence, coalesce(has_pdf, FALSE) AS has_pdf
    FROM {v_asks} AS q LEFT JOIN (SELECT question_id,
        avg(CASE WHEN rank > 4 THEN NULL WHEN score <= 0 THEN 0.0::DOUBLE WHEN score <= 1
          THEN score ELSE score / (score + 1) END) AS mean,
        count(*) FILTER (WHERE rank <= 4 AND source_type = 'generated') AS symbols,
        bool_or(source_type = 'pdf') AS has_pdf
      FROM {v_results} JOIN {v_chunks} USING (chunk_id)
      WHERE rank <= 5 GROUP BY question_id) AS r
      ON r.question_id = q.question_id"""


def confidence(src):
    results = src.view("v_results").join(
        src.view("v_chunks").select("chunk_id", "source_type"), "chunk_id"
    )
    return R.retrieval_confidence(src.view("v_asks"), results)


@register(
    "retrieval_confidence",
    "SELECT question_id, round(confidence, 6) AS confidence, has_pdf FROM {v_confidence}",
)
def retrieval_confidence(src):
    return confidence(src).withColumn("confidence", F.round("confidence", 6))


_ROUTED = f"""SELECT question_id, mode, CASE WHEN no_pdf THEN 'plan'
      WHEN score <= 3 AND confidence >= 0.60 THEN 'auto_fast'
      WHEN score <= 6 AND confidence >= 0.30 THEN 'auto' ELSE 'plan' END AS route,
    CASE WHEN no_pdf THEN '{vocab.ROUTE_REASONS["plan_pdf"]}'
      WHEN score <= 3 AND confidence >= 0.60 THEN '{vocab.ROUTE_REASONS["auto_fast"]}'
      WHEN score <= 6 AND confidence >= 0.30 THEN '{vocab.ROUTE_REASONS["auto"]}'
      ELSE '{vocab.ROUTE_REASONS["plan"]}' END AS reason
  FROM (SELECT question_id, confidence, score,
      CASE question_id % 3 WHEN 0 THEN 'fast' ELSE 'auto' END AS mode,
      {any_of("lower(text)", vocab.DOCUMENT_MARKERS)} AND NOT has_pdf AS no_pdf
    FROM {{v_confidence}} JOIN {{v_ask_complexity}} USING (question_id)) AS c"""


@register(
    "route",
    f"""SELECT question_id, route, reason, CASE WHEN mode = 'fast' THEN 2
          WHEN route = 'auto_fast' THEN 0 ELSE 1 END AS retries FROM ({_ROUTED}) AS r""",
)
def route(src):
    rows = confidence(src).join(src.view("v_asks").select("question_id", "text"), "question_id")
    mode, why = R.route(
        R.complexity_score("text", NAMES)["score"], F.col("confidence"), R.evidence_type("text"), F.col("has_pdf")
    )
    asked = F.when(F.col("question_id") % 3 == 0, "fast").otherwise("auto")
    routed = rows.select("question_id", mode.alias("route"), why.alias("reason"), asked.alias("m"))
    return routed.select(
        "question_id", "route", "reason", R.retry_budget(F.col("m"), F.col("route"), 2).alias("retries")
    )


@register(
    "retry_query",
    """WITH h AS (SELECT question_id, hint, row_number() OVER (PARTITION BY question_id
           ORDER BY min(rank)) AS n FROM (SELECT question_id, rank,
             coalesce(nullif(qualname, ''), symbol_id) AS hint
           FROM {v_results} JOIN {v_chunks} USING (chunk_id) WHERE source_type = 'generated') AS r
         GROUP BY question_id, hint)
       SELECT question_id, trim(concat_ws(' ', text, CASE WHEN question_id % 2 = 0
             THEN 'missing: ring order' END,
           'related_apis: ' || (SELECT string_agg(hint, ' ' ORDER BY n) FROM h
             WHERE h.question_id = q.question_id AND n <= 2),
           CASE WHEN """
    + any_of("lower(text)", vocab.DOCUMENT_MARKERS)
    + """ THEN 'user guide documentation section' ELSE 'runnable example quarry' END)) AS query
       FROM {v_asks} AS q""",
)
def retry_query(src):
    missing = F.when(
        F.col("question_id") % 2 == 0, T.strings([" ring", "", "order ", "degree"])
    )
    asks = src.view("v_asks").withColumn("missing", missing)
    results = chunk_results(src.view("v_results"), src.view("v_chunks"))
    return R.retry_query(asks, results, NAMES)


# Runs with outcomes and messages made of the events.
VIEWS["v_runs"] = """
    SELECT event_id AS run_id, CASE event_type WHEN 'error' THEN 'error' WHEN 'click'
        THEN 'success' WHEN 'view' THEN 'timeout' WHEN 'signup' THEN 'error'
        ELSE CAST(NULL AS STRING) END AS status,
      concat(CASE event_id % 7 WHEN 0 THEN 'NameError: x is not defined' WHEN 1
          THEN 'SyntaxError near ImportError' WHEN 2 THEN 'Object has no attribute gen'
        WHEN 3 THEN 'Unbound generator issue: dx' WHEN 4 THEN 'Execution timed out, unknown'
        WHEN 5 THEN 'cannot import name y' ELSE 'ValueError' END, ' ', props) AS errors,
      CASE event_id % 5 WHEN 0 THEN 'auto' WHEN 1 THEN 'auto_fast' WHEN 2 THEN 'plan'
        ELSE 'fast' END AS route, value > 50 AS passed, value < 2 AS missing,
      user_id % 3 = 0 AS escalated
    FROM {events}"""
_GAP = (
    f"(status IS NOT NULL AND status <> 'success' AND NOT {any_of('lower(errors)', vocab.NOT_A_GAP)}"
    f" AND {any_of('lower(errors)', vocab.GAP)})"
)


@register(
    "evidence_gap",
    f"""SELECT run_id, {_GAP} AS gap, coalesce(status = 'error' AND
          {any_of("lower(errors)", vocab.IMPORT_ERRORS)}, FALSE) AS import_gap,
          {any_of("lower(errors)", vocab.GENERATOR_ERRORS)} AS generator_issue FROM {{v_runs}}""",
)
def evidence_gap(src):
    status, errors = F.col("status"), F.col("errors")
    return src.view("v_runs").select(
        "run_id",
        F.coalesce(R.evidence_gap(status, errors), F.lit(False)).alias("gap"),
        F.coalesce(R.import_gap(status, errors), F.lit(False)).alias("import_gap"),
        R.generator_issue(F.array(errors)).alias("generator_issue"),
    )


@register(
    "needs_escalation",
    f"""SELECT run_id, route IN ('auto', 'auto_fast') AND NOT escalated
          AND (missing OR {_GAP} OR NOT passed) AS escalate FROM {{v_runs}}""",
)
def needs_escalation(src):
    gap = F.coalesce(R.evidence_gap(F.col("status"), F.col("errors")), F.lit(False))
    test = R.needs_escalation(
        F.col("route"), F.col("escalated"), F.col("missing"), gap, F.col("passed")
    )
    return src.view("v_runs").select("run_id", test.alias("escalate"))


# ---- features --------------------------------------------------------------------------

# Questions that use the phrases the features look for, around the given texts.
PHRASES = (
    "Find the right factors of the first-order operator Dx^2 + x in Q, is there one for",
    "Compute the gcrd and lclm of Sn - n and",
    "Does the differential equation have series solutions at x = 0 with order of 12 near",
    "Local basis of (x^2-1)*Dx + 1 at the second real root of the leading coefficient, base ring of",
    "Indicial polynomial around 3/4 using a recurrence",
    "Which algebra: main algebra with several generators, list generators for",
    "Annihilating operator of p(x) for q-shift, print only the first element of",
    "Groebner basis of the left ideal and eliminate fglm in",
    "convert to recurrence with to_s and to_d, first 15 terms, precision 200 bits of",
    "Is the change ring of MainThing is_q true in QQ[x, y][Dx, Dy] for",
    "generalized series solution at 0, a real root of",
    "Leading monomials at sqrt(2) of operator Qx + 1",
    "symmetric square with mixed generators dx sn of",
    "",
)
VIEWS["v_technical"] = (
    "SELECT conv_id * 100 + turn AS question_id, concat(CASE (conv_id + turn) % 14 "
    + " ".join(f"WHEN {n} THEN '{p}'" for n, p in enumerate(PHRASES))
    + " END, ' ', text) AS text FROM {conversations} WHERE role = 'user'"
)
_MULTI = any_of("q", NAMES.fill_all(Q.MULTIVARIATE))
_DY = any_of("q", ("differential operator", "differential equation"))


def _word(words) -> str:
    return f"len(list_filter(tokens, lambda t: t IN ({', '.join(repr(w) for w in words)}))) > 0"


CHECK_ONLY["v_features"] = f"""
    SELECT *, CASE WHEN contains(q, 'mixed generators') OR (has_d AND (has_r OR has_q)) THEN 'mixed'
        WHEN has_q THEN 'q_recurrence' WHEN has_r THEN 'recurrence' WHEN has_d THEN 'differential'
        ELSE '' END AS operator_kind,
      feature <> '' OR {any_of("q", NAMES.fill_all(Q.SETUP))} AS wants_algebra_setup,
      CASE WHEN NOT (feature <> '' OR {any_of("q", NAMES.fill_all(Q.SETUP))}) THEN ''
        WHEN {_MULTI} OR regexp_matches(text, '{Q.TWO_GENERATORS}') THEN 'multivariate'
        ELSE 'univariate' END AS algebra_scope,
      CASE WHEN gcrd AND lclm THEN 'gcrd_lclm' WHEN gcrd THEN 'gcrd' WHEN lclm THEN 'lclm' ELSE ''
        END AS common_operator_task,
      CASE WHEN at_root THEN 'leading_coefficient_root' WHEN has_point THEN 'explicit_point'
        ELSE '' END AS point_source,
      CASE WHEN at_root OR NOT has_point THEN '' ELSE point END AS point_text,
      CASE WHEN contains(q, 'second real root') THEN 'second_real'
        WHEN contains(q, 'first real root') THEN 'first_real'
        WHEN contains(q, 'one real root') OR contains(q, 'a real root') THEN 'one_real'
        WHEN at_root THEN 'unspecified_root' ELSE '' END AS point_selection,
      CASE WHEN at_root THEN 'algebraic'
        WHEN has_point AND point IN ('0', 'x=0', 'y=0', 't=0', 'u=0', 'z=0') THEN 'zero'
        WHEN has_point AND {any_of("point", Q.ALGEBRAIC_POINTS)} THEN 'algebraic'
        WHEN has_point AND regexp_matches(point, '^[-+]?\\d+(/\\d+)?$') THEN 'rational'
        WHEN {any_of("q", ("second real root", "first real root", "one real root", "a real root"))}
          THEN 'algebraic' ELSE '' END AS point_kind,
      CASE {" ".join(f"WHEN {any_of('q', m)} THEN '{v}'" for v, m in Q.SOLUTION_KINDS)} ELSE '' END
        AS solution_kind,
      coalesce(CASE {" ".join(f"WHEN regexp_matches(q, '{p}') THEN try_cast(regexp_extract(q, '{p}', 1) AS BIGINT)" for p in Q.PRECISIONS)} END, -1) AS precision,
      contains(q, 'basis') AS needs_basis, contains(q, 'base ring') AS needs_base_ring,
      {any_of("q", ("series", "frobenius"))} AS wants_series,
      {any_of("q", ("generalized series", "generalised series"))} AS wants_generalized,
      {any_of("q", Q.FIRST_ELEMENT)} AS wants_first,
      regexp_matches(q, '^(does|do|is|are|has|have)\\b') AS wants_existence,
      CASE {" ".join(f"WHEN {any_of('q', m)} THEN '{v}'" for v, m in Q.CLOSURES)} ELSE '' END
        AS closure_variant
    FROM (SELECT question_id, text, q, tokens,
        contains(q, 'q-shift') OR contains(q, 'q_recurrence') OR {_word(Q.Q_TOKENS)} AS has_q,
        contains(q, 'recurrence') OR contains(q, 'shift operator') OR {_word(Q.SHIFT_TOKENS)}
          AS has_r, {_DY} OR {_word(Q.DERIVATION_TOKENS)} AS has_d,
        {any_of("q", ("gcrd", "greatest common right divisor", "common divisor"))} AS gcrd,
        {any_of("q", ("lclm", "least common left multiple", "common multiple"))} AS lclm,
        contains(q, 'leading coefficient') AND contains(q, 'root') AS at_root,
        regexp_matches(q, '{Q.POINT}') AS has_point,
        trim(regexp_extract(q, '{Q.POINT}', 1)) AS point,
        CASE WHEN contains(q, 'change ring') THEN 'change_ring'
          WHEN contains(q, 'differential operators') THEN 'DifferentialOperators'
          WHEN regexp_matches(q, '\\bis_(c|d|delta|e|f|j|q|s)\\b') THEN 'is_Q'
          WHEN {any_of("q", Q.GENS)} THEN 'gens'
          WHEN {any_of("q", NAMES.fill_all(Q.CONSTRUCTOR_MARKERS))} THEN 'MainThing'
          ELSE '' END AS feature
      FROM (SELECT question_id, text, {plain("text")} AS q, list_transform(regexp_extract_all(
          lower(text), '[A-Za-z_][A-Za-z0-9_]*'), lambda t: lower(t)) AS tokens
        FROM {{v_technical}}) AS a) AS b"""
_SHOWN = (
    "operator_kind, algebra_scope, common_operator_task, point_source, point_text, "
    "point_selection, point_kind, solution_kind, wants_algebra_setup, needs_basis, "
    "needs_base_ring, wants_series, wants_generalized, closure_variant"
)


def features(src):
    return Q.question_features(src.view("v_technical"), NAMES)


def _expr_sql(number: int) -> str:
    ends = Q.OPERATOR_ENDS
    pattern = (
        rf"(?i)\b(?:of|for)\s+(.+?)\s+(?:{ends})\b",
        rf"(?i)\boperator\s+(.+?)\s+(?:{ends})\b",
        r"(?i)\b(?:equation|operator)\s+([^\n]+)$",
    )[number]
    raw = f"trim(regexp_extract(trim(text, ' ' || chr(10)), '{pattern}', 1), ' .,:;')"
    gens = "|".join(Q.GENERATORS)
    return f"""CASE WHEN regexp_matches({raw}, '{gens}') AND NOT starts_with(lower({raw}), 'algebra ')
        AND NOT (contains({raw}, '[') AND contains({raw}, ']')
          AND NOT regexp_matches({raw}, '[-+*^/()]')
          AND NOT regexp_matches({raw}, '^({gens})')) THEN {raw} END"""


@register(
    "question_features",
    f"""SELECT question_id, feature AS algebra_feature, wants_first, wants_existence, precision,
          q AS normalized_question, {_SHOWN},
          coalesce({_expr_sql(0)}, {_expr_sql(1)}, {_expr_sql(2)}, '') AS operator_text
        FROM {{v_features}}""",
)
def question_features(src):
    rows = features(src).withColumnsRenamed(
        {"wants_first_element_only": "wants_first", "wants_existence_check": "wants_existence"}
    )
    rows = rows.withColumn("precision", F.coalesce("precision", F.lit(-1)))
    return rows.drop("text", "needs_code")


_INTENTS = """
    SELECT question_id, needs_base_ring, point_source, wants_first, CASE
      WHEN closure_variant <> '' THEN 'C1_closure_combinatorics'
      WHEN {conv} THEN 'C2_algebra_conversion'
      WHEN common_operator_task <> '' THEN 'B1_gcrd_lclm'
      WHEN contains(q, 'right factor') THEN 'B2_factor_right_factor'
      WHEN solution_kind IN ('indicial_polynomial', 'local_basis_monomials') OR wants_series
        OR solution_kind IN ('generalized_series', 'local_basis_expansions')
        THEN 'B3_local_singularity_analysis'
      WHEN {ideal} THEN 'B4_multivariate_ideal_groebner_basis'
      WHEN wants_algebra_setup AND algebra_scope = 'multivariate'
        THEN 'A2_create_or_choose_multivariate_algebra'
      WHEN wants_algebra_setup THEN 'A1_create_or_choose_algebra' ELSE '' END AS workflow_id,
    CASE WHEN closure_variant <> '' THEN closure_variant
      WHEN {conv} THEN concat_ws('|', CASE WHEN contains(q, 'to_s')
          OR contains(q, 'convert to recurrence') THEN 'to_S' END,
        CASE WHEN contains(q, 'to_d') THEN 'to_D' END, CASE WHEN contains(q, 'to_f') THEN 'to_F' END,
        CASE WHEN contains(q, 'to_t') THEN 'to_T' END)
      WHEN common_operator_task = 'gcrd' THEN 'Operator.gcrd|gcrd'
      WHEN common_operator_task = 'lclm' THEN 'Operator.lclm|lclm'
      WHEN common_operator_task <> '' THEN 'Operator.gcrd|gcrd|Operator.lclm|lclm'
      WHEN contains(q, 'right factor') THEN 'right_factors'
      WHEN solution_kind IN ('indicial_polynomial', 'local_basis_monomials') THEN solution_kind
      WHEN wants_series OR solution_kind IN ('generalized_series', 'local_basis_expansions')
        THEN concat_ws('|', CASE WHEN wants_generalized AND point_text IN ('', '0')
          THEN 'generalized_series_solutions' END, 'local_basis_expansions')
      WHEN {ideal} THEN concat_ws('|', CASE WHEN contains(q, 'groebner basis')
          THEN 'LeftIdeal.groebner_basis' END, CASE WHEN contains(q, 'fglm') THEN 'fglm' END,
        CASE WHEN contains(q, 'eliminat') THEN 'LeftIdeal.eliminate' END, 'MainThing_generic.ideal')
      WHEN wants_algebra_setup AND algebra_scope = 'multivariate' THEN CASE WHEN feature = 'gens'
        THEN 'MainThing_generic.gens|MainThing|MainThing_generic.ideal'
        ELSE 'MainThing|MainThing_generic.gens|MainThing_generic.ideal' END
      WHEN wants_algebra_setup THEN CASE feature WHEN 'gens' THEN 'MainThing_generic.gens|gens|MainThing'
        WHEN 'MainThing' THEN 'MainThing' WHEN '' THEN 'MainThing' ELSE feature || '|MainThing' END
      ELSE '' END AS methods
    FROM {{v_features}}""".replace("{conv}", any_of("q", Q.CONVERSIONS)).replace(
    "{ideal}", any_of("q", Q.IDEALS)
).replace("{{", "{").replace("}}", "}")


@register(
    "classify_intent",
    f"""SELECT question_id, workflow_id, methods, substr(workflow_id, 1, 1) AS family_id
        FROM ({_INTENTS}) AS i""",
)
def classify_intent(src):
    decided = Q.classify_intent(features(src), NAMES)
    return decided.select(
        "question_id",
        "workflow_id",
        F.array_join("preferred_methods", "|").alias("methods"),
        "family_id",
    )


@register(
    "selection_override",
    f"""SELECT question_id, workflow_id, CASE substr(workflow_id, 1, 1) WHEN 'A' THEN 'English'
            WHEN 'B' THEN 'French' ELSE 'German' END AS family_name,
          methods || CASE WHEN workflow_id = 'B2_factor_right_factor' THEN '|factor'
            WHEN workflow_id = 'B1_gcrd_lclm' AND NOT contains(methods, 'gcrd')
              THEN '|gcrd|other' WHEN workflow_id = 'B1_gcrd_lclm' THEN '|other' ELSE '' END AS symbols,
          concat_ws('|', CASE workflow_id WHEN 'B1_gcrd_lclm' THEN 'use gcrd' END,
            CASE WHEN needs_base_ring THEN '{Q.OVERRIDE_RULES["base_ring"]}' END,
            CASE WHEN point_source = 'leading_coefficient_root'
              THEN '{Q.OVERRIDE_RULES["root"]}' END,
            CASE WHEN wants_first THEN '{Q.OVERRIDE_RULES["first"]}' END) AS rules
        FROM ({_INTENTS}) AS i WHERE workflow_id IN ('B1_gcrd_lclm', 'B2_factor_right_factor',
          'B3_local_singularity_analysis')""",
)
def selection_override(src):
    registry_ = R.Registry(
        R.Registry.of(src.view("v_families")).families,
        (
            R.Workflow("B1_gcrd_lclm", "B", "Common", "", (), ("gcrd", "other"), ("use gcrd",)),
            R.Workflow("B2_factor_right_factor", "B", "Factors", "", (), ("right_factors", "factor")),
            R.Workflow("B3_local_singularity_analysis", "B", "Local"),
        ),
    )
    chosen = Q.selection_override(Q.classify_intent(features(src), NAMES), registry_)
    return chosen.select(
        "question_id",
        "workflow_id",
        "family_name",
        F.array_join("preferred_symbols", "|").alias("symbols"),
        F.array_join("prompt_rules", "|").alias("rules"),
    )


# ---- rules and obligations -------------------------------------------------------------

RULES = (
    R.Rule("Mind the articles.", ("The ", "de la"), "question", "articles"),
    R.Rule("Check the imports.", ("op_1", "Cls2"), "context", ""),
    R.Rule("Keep it short.", ("und",), "all", "short"),
    R.Rule("Mind the articles.", ("of",), "all", "again"),
    R.Rule("Name the ring.", ("that", "une"), "anything", "ring"),
    R.Rule("Say why.", (" in ",), "question", "why"),
    R.Rule("Cite pages.", ("pp.", "p. "), "context", "pages"),
    R.Rule("Prefer methods.", ("s",), "all", "methods"),
    R.Rule("Never reached by most.", ("e",), "all", "last"),
)
GLOBALS = ("Prefer explicit names. ", "", "Prefer explicit names.", "Test the result.")
_RULE_ROWS = ", ".join(
    "({}, '{}', '{}', '{}', {})".format(
        n, r.id or f"rule_{n}", r.scope if r.scope in ("question", "context") else "all",
        r.message, "[" + ", ".join(f"'{w.lower()}'" for w in r.when_any) + "]",
    )
    for n, r in enumerate(RULES, start=1)
)


RULE_LINES_SQL = f"""WITH h AS (SELECT question_id, lower(text) AS q, coalesce(context, '') AS c,
            lower(text) || chr(10) || coalesce(context, '') AS b
          FROM {{v_asks}} LEFT JOIN (SELECT question_id, string_agg(lower(title || chr(10) || location
              || chr(10) || shown), chr(10) ORDER BY rank) AS context FROM {{v_items}}
            GROUP BY question_id) AS i USING (question_id)),
          r AS (SELECT * FROM (VALUES {_RULE_ROWS}) AS v(no, id, scope, message, needles)),
          m AS (SELECT question_id, no, id, message, row_number() OVER (
              PARTITION BY question_id, message ORDER BY no) AS seen FROM h CROSS JOIN r
            WHERE len(list_filter(needles, lambda n: contains(CASE scope WHEN 'question' THEN q
              WHEN 'context' THEN c ELSE b END, n))) > 0),
          k AS (SELECT question_id, no, '- [' || id || '] ' || message AS line, row_number() OVER (
              PARTITION BY question_id ORDER BY no) AS place FROM m WHERE seen = 1)
        SELECT question_id, line FROM k WHERE place <= 6
        UNION ALL SELECT question_id, unnest(['- Prefer explicit names.', '- Test the result.'])
        FROM {{v_asks}}"""


def rule_questions(src):
    """Questions with the text of their context."""
    shown = items(src).withColumn(
        "t", F.concat("title", F.lit("\n"), "location", F.lit("\n"), "text")
    )
    ordered = F.sort_array(F.collect_list(F.struct("ctx_no", "t")))
    context = shown.groupBy("question_id").agg(
        F.array_join(F.transform(ordered, lambda x: x["t"]), "\n").alias("context")
    )
    return src.view("v_asks").join(context, "question_id", "left")


@register("match_rules", RULE_LINES_SQL)
def match_rules(src):
    lines = R.match_rules(F.col("text"), F.col("context"), RULES, GLOBALS)
    return rule_questions(src).select("question_id", F.explode(lines).alias("line"))


@register("match_rule_table", RULE_LINES_SQL)
def match_rule_table(src):
    rows = [(n, r.id, r.scope, list(r.when_any), r.message) for n, r in enumerate(RULES, start=1)]
    rules = src.spark.createDataFrame(
        rows, "rule_no long, id string, scope string, when_any array<string>, message string"
    )
    found = R.match_rule_table(rule_questions(src), rules, GLOBALS)
    return found.select("question_id", F.explode("lines").alias("line"))


# Generated texts that meet some of what their method asks for.
VIEWS["v_tasks"] = """
    SELECT doc_id AS task_id, CASE doc_id % 7 WHEN 0 THEN 'right_factors'
        WHEN 1 THEN 'local_basis_expansions' WHEN 2 THEN 'indicial_polynomial'
        WHEN 3 THEN 'annihilator_of_polynomial' WHEN 4 THEN 'annihilator_of_associate'
        WHEN 5 THEN 'other' ELSE CAST(NULL AS STRING) END AS method_name,
      concat(CASE doc_id % 3 WHEN 0 THEN 'L = op; r = L.right_factors(); bool(r) '
          WHEN 1 THEN 'b = L.local_basis_expansions(0)[0]; b.base_ring() '
          ELSE 'leading_coefficient().roots(x); L.indicial_polynomial(x) ' END,
        CASE doc_id % 5 WHEN 0 THEN 'p = x; A.annihilator_of_polynomial(p) '
          WHEN 1 THEN 'F = g; L . annihilator_of_associate( F ) '
          WHEN 2 THEN 'A.annihilator_of_associate(F) M=2' ELSE '' END, text) AS code,
      doc_id % 2 = 0 AS wants_boolean_answer, doc_id % 4 < 2 AS at_leading_root,
      doc_id % 3 = 1 AS needs_base_ring, doc_id % 8 < 4 AS wants_first_element_only,
      CASE WHEN doc_id % 11 = 0 THEN 'M' ELSE '' END AS receiver, '' AS argument,
      'y^2' AS expression, CASE doc_id % 4 WHEN 0 THEN 'success' WHEN 1 THEN 'error'
        WHEN 2 THEN 'success' ELSE CAST(NULL AS STRING) END AS status,
      CASE doc_id % 9 WHEN 0 THEN ' ' WHEN 1 THEN concat('True', chr(10), ' x ') ELSE 'one line' END
        AS stdout
    FROM {documents}"""
_NEED = {
    "right_factors": (
        ("TRUE", "contains(code, '.right_factors(')", 0),
        ("wants_boolean_answer", "contains(code, 'len(factors) > 0') OR contains(code, 'bool(')", 1),
    ),
    "local_basis_expansions": (
        ("TRUE", "contains(code, '.local_basis_expansions(')", 2),
        ("at_leading_root", "contains(code, 'leading_coefficient') AND contains(code, '.roots(')", 3),
        ("needs_base_ring", "contains(code, 'base_ring()')", 4),
        ("wants_first_element_only", "contains(code, '[0]')", 5),
    ),
    "indicial_polynomial": (("TRUE", "contains(code, '.indicial_polynomial(')", 6),),
    "annihilator_of_polynomial": (
        ("TRUE", "contains(code, '.annihilator_of_polynomial(')", 7),
        ("TRUE", "contains(code, 'p =') OR contains(code, expression)", 8),
    ),
    "annihilator_of_associate": (
        ("TRUE", "contains(code, '.annihilator_of_associate(')", 9),
        ("TRUE", "contains(packed, recv || '.annihilator_of_associate(F)')", 10),
        ("TRUE", "contains(packed, recv || '=')", 11),
        ("TRUE", "contains(packed, 'F=')", 12),
        ("TRUE", "NOT contains(packed, 'A.annihilator_of_associate(')", 13),
    ),
}
_ISSUES = ",\n".join(
    f"CASE WHEN method_name = '{method}' AND {flag} AND NOT ({test}) THEN "
    f"'{NAMES.fill(Q.OBLIGATIONS[n].message)}' END"
    for method, tests in _NEED.items()
    for flag, test, n in tests
)


@register(
    "check_obligations",
    f"""SELECT task_id, coalesce(blocking, '') = '' AS passed, coalesce(blocking, '') AS blocking,
          CASE WHEN method_name IS NOT NULL AND status = 'success' AND wants_boolean_answer
            AND NOT starts_with(stdout, 'True') THEN
            'Execution output does not visibly include a boolean existence answer.' ELSE '' END
            AS advisory
        FROM (SELECT *, CASE WHEN method_name IS NOT NULL THEN concat_ws('|', {_ISSUES},
            CASE WHEN status <> 'success' THEN 'Execution status was `' || status
              || '`, so the request was not fully satisfied.' END,
            CASE WHEN status = 'success' AND needs_base_ring AND NOT contains(stdout, chr(10)) THEN
              'Execution output does not show both the local basis result and the requested base ring.'
              END,
            CASE WHEN status = 'success' AND trim(stdout) = '' AND method_name IN
              ('annihilator_of_polynomial', 'annihilator_of_associate') THEN
              'Execution output is empty, so no annihilating operator was shown.' END) END AS blocking
          FROM (SELECT *, regexp_replace(code, '\\s+', '', 'g') AS packed,
            coalesce(nullif(receiver, ''), 'L') AS recv FROM {{v_tasks}}) AS t) AS u""",
)
def check_obligations(src):
    checked = Q.check_obligations(src.view("v_tasks"), NAMES)
    return checked.select(
        "task_id",
        "passed",
        F.array_join("blocking", "|").alias("blocking"),
        F.array_join("advisory", "|").alias("advisory"),
    )
