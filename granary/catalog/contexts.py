"""Queries over context assembly, citations, responses and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from granary.catalog.base import CHECK_ONLY, VIEWS, register
from granary.catalog.ranking import plain
from granary.catalog.routes import any_of, items, registry
from granary.catalog.search import long
from granary.functions import text as T
from granary.operators import context as C
from granary.operators import reports as P
from granary.operators import responses as M

SEP = "chr(10) || chr(10) || '---' || chr(10) || chr(10)"


def shown(src):
    return C.chunk_results(src.view("v_results"), src.view("v_chunks"))


@register(
    "context_items",
    """SELECT question_id, 'ctx_' || CAST(rank AS VARCHAR) AS context_id, source_type, title,
         location, shown AS text, round(score, 6) AS score FROM {v_items}""",
)
def context_items(src):
    rows = items(src).withColumn("score", F.round("score", 6))
    return rows.drop("ctx_no", "chunk_id")


@register(
    "context_items_by_source",
    """SELECT question_id, rank AS ctx_no, chunk_id, CASE WHEN source_type = 'generated'
           THEN coalesce(nullif(qualname, ''), nullif(symbol_id, ''), 'unknown_symbol')
           ELSE coalesce(nullif(section_title, ''), source) END AS title
       FROM {v_results} JOIN {v_chunks} USING (chunk_id)""",
)
def context_items_by_source(src):
    rows = items(src, by_source=True).select("question_id", "ctx_no", "chunk_id", "title")
    return long(rows, "ctx_no")


CHECK_ONLY["v_blocks"] = f"""
    SELECT question_id, string_agg(block, {SEP} ORDER BY rank) AS context FROM (
      SELECT question_id, rank, concat_ws(chr(10), '[CHUNK ' || CAST(chunk_id AS VARCHAR) || ']',
        'Source: ' || source || ' (' || source_type || ')',
        CASE WHEN source_type = 'pdf' AND page_start IS NOT NULL THEN
          CASE WHEN page_end IS NULL THEN 'Page: ' || CAST(page_start AS VARCHAR)
          ELSE 'Pages: ' || CAST(page_start AS VARCHAR) || '-' || CAST(page_end AS VARCHAR) END END,
        CASE WHEN source_type = 'pdf' THEN 'Section: '
          || coalesce(nullif(section_title, ''), '(section unknown)') END,
        CASE WHEN source_type <> 'pdf' THEN 'Symbol: '
          || coalesce(nullif(qualname, ''), nullif(symbol_id, '')) END,
        CASE WHEN source_type <> 'pdf' THEN 'Signature: ' || nullif(signature, '') END,
        CASE WHEN source_type <> 'pdf' THEN 'Module: ' || nullif(module, '') END,
        CASE WHEN source_type <> 'pdf' THEN 'Kind: ' || nullif(kind, '') END,
        CASE WHEN source_type <> 'pdf' THEN 'Location: ' || location END, 'Text:',
        CASE WHEN source_type = 'generated' THEN text ELSE substr(text, 1, 2200) END) AS block
      FROM {{v_results}} JOIN {{v_located}} USING (chunk_id)) AS b GROUP BY question_id"""


@register("context_block", "SELECT question_id, context FROM {v_blocks}")
def context_block(src):
    return C.context_block(shown(src))


@register(
    "item_block",
    f"""SELECT question_id, string_agg(concat_ws(chr(10), '[ctx_' || CAST(rank AS VARCHAR) || ']',
            'source_type: ' || source_type, 'title: ' || title, 'location: ' || location,
            'score: ' || printf('%.4f', score), 'text:', shown), {SEP} ORDER BY rank) AS context
        FROM {{v_items}} GROUP BY question_id""",
)
def item_block(src):
    return C.item_block(items(src))


@register(
    "build_prompts",
    """SELECT question_id, 'Answer with care.' || chr(10) || 'Question: ' || text || chr(10)
         || 'Flow: ' || workflow_id || chr(10) || 'Context:' || chr(10) || context AS prompt
       FROM {v_asks} JOIN {v_blocks} USING (question_id)""",
)
def build_prompts(src):
    template = "Answer with care.\nQuestion: {question}\nFlow: {workflow_id}\nContext:\n{context}"
    asks = src.view("v_asks").select("question_id", "text", "workflow_id")
    return C.build_prompts(asks, C.context_block(shown(src)), template)


@register(
    "citations",
    """WITH c AS (SELECT question_id, rank, CASE WHEN source_type = 'pdf' THEN
           CASE WHEN page_start IS NOT NULL AND page_end IS NOT NULL THEN '- pp. '
               || CAST(page_start AS VARCHAR) || '-' || CAST(page_end AS VARCHAR)
             WHEN page_start IS NOT NULL THEN '- p. ' || CAST(page_start AS VARCHAR)
             ELSE '- source: ' || source END || ', section: '
             || coalesce(nullif(section_title, ''), 'unknown')
           ELSE '- symbol: ' || coalesce(nullif(qualname, ''), nullif(symbol_id, ''),
               'unknown_symbol') || coalesce(', signature: ' || nullif(signature, ''), '')
             || ', source: ' || location END AS line,
         CASE WHEN source_type = 'pdf' THEN concat_ws('|', 'pdf', source, section_title,
             coalesce(CAST(page_start AS VARCHAR), '-'), coalesce(CAST(page_end AS VARCHAR), '-'))
           ELSE concat_ws('|', 'generated', coalesce(nullif(qualname, ''), nullif(symbol_id, ''),
             'unknown_symbol'), location) END AS key
         FROM {v_results} JOIN {v_located} USING (chunk_id)),
       f AS (SELECT *, row_number() OVER (PARTITION BY question_id, key ORDER BY rank) AS n FROM c)
       SELECT question_id, line, row_number() OVER (PARTITION BY question_id ORDER BY rank)
         AS cite_no FROM f WHERE n = 1""",
)
def citations(src):
    return long(C.citations(shown(src)), "cite_no")


# Ids a response cites: known ones, repeated ones and unknown ones.
VIEWS["v_cited"] = """
    SELECT question_id, split(concat('ctx_', CAST(question_id % 19 + 1 AS STRING), ',ctx_99,ctx_',
      CAST(question_id % 5 + 1 AS STRING), ',ctx_', CAST(question_id % 19 + 1 AS STRING)), ',')
      AS citations_used FROM {v_asks}"""
CHECK_ONLY["v_valid"] = """
    SELECT question_id, cite_no, context_id FROM (SELECT question_id,
        unnest(range(len(citations_used))) + 1 AS cite_no, unnest(citations_used) AS context_id
      FROM {v_cited}) AS c
    WHERE (question_id, context_id) IN (SELECT question_id, 'ctx_' || CAST(rank AS VARCHAR)
      FROM {v_results})"""


def valid(src):
    return C.valid_citations(src.view("v_cited"), items(src))


@register("valid_citations", "SELECT question_id, cite_no, context_id FROM {v_valid}")
def valid_citations(src):
    return long(valid(src), "cite_no")


@register(
    "citation_lines",
    """SELECT v.question_id, cite_no, '- [' || CAST(cite_no AS VARCHAR) || '] ' || title || ' ('
         || location || ')' AS line
       FROM {v_valid} AS v JOIN {v_items} AS i ON i.question_id = v.question_id
         AND v.context_id = 'ctx_' || CAST(rank AS VARCHAR)""",
)
def citation_lines(src):
    return long(C.citation_lines(valid(src), items(src)), "cite_no")


@register(
    "order_cited_first",
    """SELECT question_id, context_id, row_number() OVER (PARTITION BY question_id
         ORDER BY cited, rank) AS place FROM (SELECT question_id, rank,
           'ctx_' || CAST(rank AS VARCHAR) AS context_id,
           CASE WHEN (question_id, 'ctx_' || CAST(rank AS VARCHAR)) IN (
             SELECT question_id, context_id FROM {v_valid}) THEN 0 ELSE 1 END AS cited
         FROM {v_results}) AS r""",
)
def order_cited_first(src):
    ordered = C.order_cited_first(items(src), valid(src))
    return long(ordered.select("question_id", "context_id", "place"), "place")


NEEDLES = ("Cls1.op_8", "  DE la ", "section 2", "of the of")


@register(
    "cite_by_needle",
    f"""SELECT question_id, 'ctx_' || CAST(rank AS VARCHAR) AS context_id FROM {{v_items}}
        WHERE {any_of(plain("title || chr(10) || location || chr(10) || shown"),
                      [" ".join(n.lower().split()) for n in NEEDLES])}""",
)
def cite_by_needle(src):
    return C.cite_by_needle(items(src), NEEDLES).select("question_id", "context_id")


# ---- responses ---------------------------------------------------------------------------

# Raw responses around the given texts: fenced, bare, repaired and broken ones.
_PLAIN = "replace(replace(replace(text, '\\\\', ''), '\"', ''), '\\n', ' ')"


def raw_plans(src):
    words = F.translate("text", '\\"\n', "   ")
    fam = F.element_at(
        T.strings(["a", "b. French", "german", "Z"]), (F.col("doc_id") % 4 + 1).cast("int")
    )
    step = F.concat(
        F.lit('{"step_id": '),
        (F.col("doc_id") % 3).cast("string"),
        F.lit(', "family_id": "'),
        fam,
        F.lit('", "title": "'),
        F.when(F.col("doc_id") % 2 == 0, F.col("lang")).otherwise(""),
        F.lit('", "instruction": " look '),
        F.col("source"),
        F.lit(' ", "retrieval_query": "'),
        F.when(F.col("doc_id") % 5 == 0, "").otherwise(words),
        F.lit('"}'),
    )
    body = F.concat(
        F.lit('{"subtasks": ['), step, F.lit(', "junk", '), step, F.lit(", "), step, F.lit("]}")
    )
    raw = (
        F.when(F.col("doc_id") % 6 == 0, F.concat(F.lit("Plan:\n```json\n"), body, F.lit("\n```")))
        .when(F.col("doc_id") % 6 == 1, F.concat(F.lit("So {this} is it "), body, F.lit(" done")))
        .when(F.col("doc_id") % 6 == 2, F.lit('{"subtasks": []}'))
        .otherwise(body)
    )
    docs = src.table("documents")
    return docs.select(
        F.col("doc_id").alias("question_id"), raw.alias("raw"), F.col("source").alias("text")
    )


@register(
    "parse_responses",
    """SELECT question_id, '' AS error, CASE WHEN question_id % 6 = 2 THEN 0 ELSE 4 END AS steps
       FROM (SELECT doc_id AS question_id FROM {documents}) AS d""",
)
def parse_responses(src):
    parsed = M.parse_responses(raw_plans(src))
    items_ = F.from_json(F.get_json_object("payload", "$.subtasks"), "array<string>")
    return parsed.select(
        "question_id", F.coalesce("error", F.lit("")).alias("error"), F.size(items_).alias("steps")
    )


@register(
    "explode_subtasks",
    """WITH d AS (SELECT doc_id, lang, source,
           trim(translate(text, '\\"' || chr(10), '   ')) AS words FROM {documents}),
         s AS (SELECT doc_id, lang, source, words, p FROM d CROSS JOIN (VALUES (1), (3)) AS n(p)
           WHERE doc_id % 6 <> 2)
       SELECT doc_id AS question_id, p AS position,
         CASE WHEN doc_id % 3 = 0 THEN p ELSE CAST(doc_id % 3 AS INT) END AS step_id,
         CASE WHEN doc_id % 2 = 0 THEN lang ELSE 'Step ' || CAST(p AS VARCHAR) END AS title,
         'look ' || source AS instruction,
         CASE WHEN doc_id % 5 = 0 OR words = '' THEN 'look ' || source ELSE words END
           AS retrieval_query,
         CASE doc_id % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'B' WHEN 2 THEN 'C' ELSE '' END AS family_id
       FROM s
       UNION ALL SELECT doc_id, 1, 1, 'Direct retrieval',
         'Retrieve direct evidence for the user question', source, '' FROM d WHERE doc_id % 6 = 2""",
)
def explode_subtasks(src):
    return M.explode_subtasks(M.parse_responses(raw_plans(src)), 3, registry=registry(src))


def raw_decisions(src):
    act = F.element_at(
        T.strings([" Continue", "refine_query", "STOP ", "skip"]),
        (F.col("doc_id") % 4 + 1).cast("int"),
    )
    conf = F.element_at(
        T.strings(["0.5", '"0.25"', '"high"', "null", "1"]), (F.col("doc_id") % 5 + 1).cast("int")
    )
    raw = F.concat(
        F.lit('{"action": "'), act, F.lit('", "reason": "see \\alpha '), F.col("source"),
        F.lit('", "next_query": " '), F.col("lang"), F.lit(' ", "confidence": '), conf, F.lit("}"),
    )
    return src.table("documents").select(F.col("doc_id").alias("question_id"), raw.alias("raw"))


@register(
    "parse_decisions",
    """SELECT doc_id AS question_id, CASE doc_id % 4 WHEN 1 THEN 'refine_query' WHEN 2 THEN 'stop'
           ELSE 'continue' END AS action, concat('see ', chr(92), 'alpha ', source) AS reason,
         lang AS next_query, CASE doc_id % 5 WHEN 0 THEN 0.5::DOUBLE WHEN 1 THEN 0.25::DOUBLE
           WHEN 4 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS confidence FROM {documents}""",
)
def parse_decisions(src):
    parsed = M.parse_decisions(M.parse_responses(raw_decisions(src)))
    return parsed.select("question_id", "action", "reason", "next_query", "confidence")


# ---- reports -----------------------------------------------------------------------------

VIEWS["v_report_symbols"] = """
    SELECT p_partkey AS seq, module, concat(qualname, CASE WHEN p_partkey % 9 = 0 THEN '|x'
        ELSE '' END) AS qualname, kind, concat(replace(p_name, ' ', '_'), '(a|b)') AS signature,
      CAST(p_partkey % 3 AS INT) AS example_count, concat('lib/', module, '.py') AS file_path,
      CAST(p_partkey AS INT) AS line, concat('Makes ', p_type, CASE WHEN p_partkey % 4 = 0
        THEN concat(chr(10), 'more') ELSE '' END) AS summary
    FROM {v_symbols} JOIN {part} ON seq = p_partkey"""


def _cell(c: str) -> str:
    return f"replace(replace({c}, '|', chr(92) || '|'), chr(10), '<br>')"


@register(
    "api_reference_report",
    f"""SELECT module, 1 AS part, qualname, kind, line, '| `' || {_cell("qualname")} || '` | `'
          || kind || '` | `' || {_cell("signature")} || '` | ' || CAST(example_count AS VARCHAR)
          || ' | `' || file_path || ':' || CAST(line AS VARCHAR) || '` | ' || {_cell("summary")}
          || ' |' AS text FROM {{v_report_symbols}}
        UNION ALL SELECT DISTINCT module, 0, '', '', 0, '## `' || module || '`' || chr(10) || chr(10)
          || '| Symbol | Kind | Signature | Examples | Source | Summary |' || chr(10)
          || '| --- | --- | --- | ---: | --- | --- |' FROM {{v_report_symbols}}
        UNION ALL SELECT DISTINCT module, 2, '', '', 0, '' FROM {{v_report_symbols}}
        UNION ALL SELECT '', 0, '', '', 0, '# API Reference' || chr(10) || chr(10)
          || '- Generated: `1970-01-01T00:00:00Z`' || chr(10) || '- Modules scanned: `'
          || CAST(count(DISTINCT module) AS VARCHAR) || '`' || chr(10) || '- Symbols extracted: `'
          || CAST(count(*) AS VARCHAR) || '`' || chr(10) || '- Symbols with examples: `'
          || CAST(count(*) FILTER (WHERE example_count > 0) AS VARCHAR) || '`' || chr(10)
        FROM {{v_report_symbols}}""",
)
def api_reference_report(src):
    return P.api_reference_report(src.view("v_report_symbols"))


@register(
    "refresh_timestamp",
    """SELECT strftime(max(ts), '%Y-%m-%dT%H:%M:%SZ') AS refreshed FROM {events}""",
)
def refresh_timestamp(src):
    return P.refresh_timestamp(src.table("events"), "ts")
