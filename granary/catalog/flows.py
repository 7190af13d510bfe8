"""Queries over sources, sinks and whole plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from granary import vocab
from granary.catalog.base import CHECK_ONLY, VIEWS, register
from granary.catalog.chunks import MERGED_SQL, MERGED_TEXT, REFS_SQL, SECTIONS_SQL
from granary.catalog.ranking import feature_views, length_scorer
from granary.catalog.routes import NAMES, any_of, complexity_sql, registry
from granary.catalog.search import index_of, long, quota_sql
from granary.functions import text as T
from granary.operators import extract as X
from granary.operators import graph as G
from granary.plans import answer as A
from granary.plans import build as B
from granary.plans import narratives as N
from granary.runtime import scratch_path
from granary.schemas import NARRATIVE_SCHEMA
from granary.sources import config, records, tables

# ---- files -----------------------------------------------------------------------------


def symbol_records(src):
    rows = src.view("v_symbol_records").withColumn("examples", F.array("lang", "file_path"))
    return rows.drop("seq", "lang")


_RECORDS = """SELECT id, module, qualname, kind, signature, summary, docstring,
    coalesce(example_count, -1) AS example_count, lang || '|' || file_path AS examples, file_path,
    line FROM {v_symbol_records}"""


def _flat(df):
    return df.withColumn("examples", F.array_join("examples", "|")).withColumn(
        "example_count", F.coalesce("example_count", F.lit(-1))
    )


def odd_lines(rows, *more: str):
    """Records as JSON lines, each followed by lines that a reader has to skip."""
    return rows.select(
        F.explode(F.array(F.to_json(F.struct("*")), *(F.lit(m) for m in ("[1, 2]", "5", "  ", *more)))).alias("value")
    )


def loose(rows):
    """The same records with their line numbers written as text."""
    return rows.withColumn("line", F.concat(F.lit(" "), F.col("line").cast("string")))


@register("read_symbols_jsonl", _RECORDS)
def read_symbols_jsonl(src):
    """Records between lines that are no objects, with numbers as text."""
    path = scratch_path(src.spark, "symbols")
    odd_lines(loose(symbol_records(src))).write.text(path)
    return _flat(records.read_symbols_jsonl(src.spark, path))


@register("write_symbols_jsonl", _RECORDS + " ORDER BY module, qualname, kind, file_path, line")
def write_symbols_jsonl(src):
    path = scratch_path(src.spark, "symbols")
    records.write_symbols_jsonl(symbol_records(src), path)
    return _flat(src.spark.read.schema(symbol_records(src).schema).json(path))


@register("read_symbols_jsonl_drop", _RECORDS)
def read_symbols_jsonl_drop(src):
    """Records with a broken line after each of them, which the reader drops."""
    path = scratch_path(src.spark, "broken")
    odd_lines(loose(symbol_records(src)), '{"id": "x", "line": ').write.text(path)
    return _flat(records.read_symbols_jsonl(src.spark, path, mode="drop"))


VIEWS["v_sections"] = """
    SELECT concat('s', CAST(doc_id AS STRING)) AS section_id, concat('mod_', lang) AS module,
      concat('Part ', CAST(doc_id % 40 AS STRING)) AS section_title, text, source AS source_file,
      split(concat(source, '|', lang, '|x'), '[|]') AS raw_refs,
      split(concat('mod_', lang, '|op_', CAST(doc_id % 50 AS STRING)), '[|]') AS resolved_symbol_ids
    FROM {documents}"""
CHECK_ONLY["v_sections"] = VIEWS["v_sections"].replace("STRING", "VARCHAR").replace("'[|]'", "'|'")
_SECTIONS = """SELECT section_id, module, section_title, text, source_file,
    array_to_string(raw_refs, '|') AS refs, array_to_string(resolved_symbol_ids, '|') AS resolved,
    CAST(len(resolved_symbol_ids) AS BIGINT) AS resolved_count FROM {v_sections}"""


def _flat_sections(rows):
    return long(
        rows.select(
            "section_id", "module", "section_title", "text", "source_file",
            F.array_join("raw_refs", "|").alias("refs"),
            F.array_join("resolved_symbol_ids", "|").alias("resolved"),
            "resolved_count",
        ),
        "resolved_count",
    )


@register("write_narratives_jsonl", _SECTIONS)
def write_narratives_jsonl(src):
    """Whole texts written as sections and read by Spark's own reader."""
    path = scratch_path(src.spark, "written")
    records.write_narratives_jsonl(src.view("v_sections"), path)
    return _flat_sections(src.spark.read.schema(NARRATIVE_SCHEMA).json(path))


@register("read_narratives_jsonl", _SECTIONS)
def read_narratives_jsonl(src):
    """Whole texts as sections between lines that are no objects; counts as text."""
    path = scratch_path(src.spark, "narratives")
    rows = src.view("v_sections").withColumn("resolved_count", F.size("resolved_symbol_ids").cast("string"))
    odd_lines(rows, '{"module": "no id"}').write.text(path)
    return _flat_sections(records.read_narratives_jsonl(src.spark, path))


FILE_DOCS = 1_000  # documents per file; a file is read as one text
END = "\x02"


@register("read_markdown", "SELECT text, length(text) AS chars FROM {v_markdown}")
def read_markdown(src):
    """Documents written to markdown files, read back as whole files."""
    path = scratch_path(src.spark, "markdown")
    docs = src.view("v_markdown").select(F.col("text").alias("value"))
    docs.write.option("maxRecordsPerFile", FILE_DOCS).option("lineSep", END).text(path)
    files = records.read_markdown(src.spark, f"{path}/*.txt")
    parts = F.split(F.rtrim("text", F.lit(END)), END)
    read = files.select(F.explode_outer(parts).alias("text")).filter("text IS NOT NULL")
    return long(read.withColumn("chars", F.length("text")), "chars")


@register(
    "scan_source_tree",
    """SELECT lang, count(*) AS docs, CAST(sum(length(text)) AS BIGINT) AS chars FROM {documents}
       GROUP BY lang""",
)
def scan_source_tree(src):
    """Documents in files below a folder per language."""
    path = scratch_path(src.spark, "tree")
    docs = src.table("documents").select("lang", F.col("text").alias("value"))
    writer = docs.write.option("maxRecordsPerFile", FILE_DOCS).option("lineSep", END)
    writer.partitionBy("lang").text(f"{path}/src")
    found = records.scan_source_tree(src.spark, path, "TXT, .md")
    parts = F.split(F.rtrim("source", F.lit(END)), END)
    read = found.select(
        F.regexp_extract("path", r"\Asrc/lang=([a-z]+)/", 1).alias("lang"),
        F.explode_outer(parts).alias("text"),
    )
    return read.groupBy("lang").agg(
        F.count("text").alias("docs"), F.sum(F.length("text")).alias("chars")
    )


def _write_registry(src, path: str) -> None:
    """The registry views as one JSON document, as a registry file holds them."""
    families = src.view("v_families").agg(
        F.sort_array(F.collect_list(F.struct("family_no", "id", "name", "summary", "keywords")))
        .alias("families")
    )
    workflows = src.view("v_workflows").agg(
        F.sort_array(F.collect_list(F.struct("workflow_no", *[
            c for c in src.view("v_workflows").columns if c != "workflow_no"
        ]))).alias("workflows")
    )
    both = families.crossJoin(F.broadcast(workflows))  # one row each
    both.coalesce(1).write.json(path)


@register(
    "load_registry",
    """SELECT 'family' AS part, family_no AS no, id, name, array_to_string(keywords, '|') AS words
       FROM {v_families}
       UNION ALL SELECT 'workflow', workflow_no, id, title, array_to_string(preferred_symbols, '|')
       FROM {v_workflows}""",
)
def load_registry(src):
    path = scratch_path(src.spark, "registry")
    _write_registry(src, path)
    families, workflows = config.load_registry(src.spark, path)
    first = families.select(
        F.lit("family").alias("part"), F.col("family_no").alias("no"), "id", "name",
        F.array_join("keywords", "|").alias("words"),
    )
    return first.unionByName(
        workflows.select(
            F.lit("workflow").alias("part"), F.col("workflow_no").alias("no"), "id",
            F.col("title").alias("name"), F.array_join("preferred_symbols", "|").alias("words"),
        )
    )


@register(
    "load_rules",
    """SELECT CAST(n_nationkey + 1 AS INT) AS rule_no, CASE WHEN n_nationkey % 3 = 0 THEN ''
           ELSE n_name END AS id, CASE n_regionkey % 3 WHEN 0 THEN 'question' WHEN 1 THEN 'context'
           ELSE 'all' END AS scope, n_name || '|x' AS needles, 'Mind ' || n_name AS message
       FROM {nation}""",
)
def load_rules(src):
    path = scratch_path(src.spark, "rules")
    scope = F.element_at(
        T.strings(["Question ", "context", ""]), (F.col("n_regionkey") % 3 + 1).cast("int")
    )
    rules = src.table("nation").agg(
        F.transform(
            F.sort_array(
                F.collect_list(
                    F.struct(
                        "n_nationkey",
                        F.when(F.col("n_nationkey") % 3 == 0, "").otherwise(F.col("n_name")).alias("id"),
                        scope.alias("scope"),
                        F.array("n_name", F.lit("x")).alias("when_any"),
                        F.concat(F.lit(" Mind "), "n_name").alias("message"),
                    )
                )
            ),
            lambda r: F.struct(*[r[c].alias(c) for c in ("id", "scope", "when_any", "message")]),
        ).alias("rules"),
        F.array(F.lit("Be brief.")).alias("global"),
    )
    rules.coalesce(1).write.json(path)
    loaded, _ = config.load_rules(src.spark, path)
    return loaded.select(
        "rule_no", "id", "scope", F.array_join("when_any", "|").alias("needles"), "message"
    )


# Chunks as an old index holds them: no source type on some, loose numbers.
VIEWS["v_stored"] = """
    SELECT chunk_id, concat(' ', text, ' ') AS text, CASE WHEN chunk_id % 5 = 0 THEN ' ' ELSE source
        END AS source, CASE WHEN chunk_id % 3 = 0 THEN '' ELSE source_type END AS source_type,
      CASE WHEN chunk_id % 7 = 0 THEN 'x' WHEN page_start IS NULL THEN ''
        ELSE concat(' ', CAST(page_start AS STRING), ' ') END AS page_start,
      CAST(page_end AS STRING) AS page_end, section_title, symbol_id, module, qualname, signature,
      kind, file_path, CAST(line AS STRING) AS line, summary,
      CASE WHEN chunk_id % 4 = 0 THEN 'many' ELSE CAST(example_count AS STRING) END AS example_count
    FROM {v_chunks}"""


@register(
    "read_index",
    """SELECT chunk_id, trim(text, ' ' || chr(10)) AS text, CASE WHEN trim(source) = ''
           THEN 'unknown' ELSE source END AS source, CASE WHEN source_type <> '' THEN source_type
           WHEN (chunk_id % 7 <> 0 AND page_start <> '') OR page_end IS NOT NULL THEN 'pdf'
           ELSE 'generated' END AS source_type,
         coalesce(CASE WHEN chunk_id % 7 = 0 THEN NULL
           ELSE try_cast(nullif(trim(page_start), '') AS INT) END, -1) AS page_start,
         CASE WHEN chunk_id % 4 = 0 THEN 0 ELSE CAST(example_count AS INT) END AS example_count
       FROM {v_stored}""",
)
def read_index(src):
    path = scratch_path(src.spark, "index")
    stored = src.view("v_stored")
    index = index_of(src, dense=False)
    tables.write_index(path, stored, index.lexical, created_at="2024-01-01T00:00:00Z")
    chunks, _, _, _ = tables.read_index(src.spark, path)
    return chunks.select(
        "chunk_id", "text", "source", "source_type",
        F.coalesce("page_start", F.lit(-1)).alias("page_start"), "example_count",
    )


# ---- plans ----------------------------------------------------------------------------

def lexical_sql(queries: str, fetch: int) -> str:
    """Ranked TF-IDF results of (query_id, text) rows."""
    return f"""
    SELECT query_id, chunk_id, score, rank FROM (SELECT query_id, chunk_id, score,
        row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM (
        SELECT query_id, chunk_id, round(sum(q.w * d.w) / max(norm), 9) AS score FROM (
          SELECT query_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY query_id)) AS w FROM (
            SELECT query_id, term, (1.0::DOUBLE + ln(count(*)::DOUBLE)) * max(idf) AS w FROM (
              SELECT query_id, unnest(list_transform(regexp_extract_all(text,
                '[A-Za-z_][A-Za-z0-9_]*'), lambda t: lower(t))) AS term
              FROM (SELECT DISTINCT query_id, text FROM {{{queries}}}) AS u) AS t
              JOIN {{v_idf}} USING (term) GROUP BY query_id, term) AS x) AS q
          JOIN {{v_weights}} AS d USING (term) JOIN {{v_norms}} USING (chunk_id)
        GROUP BY query_id, chunk_id) AS s WHERE score > 0) AS r WHERE rank <= {fetch}"""


def _points(weight: int) -> str:
    return f"""CASE WHEN contains(q, k) THEN {weight} + CASE WHEN contains(k, ' ') THEN 1 ELSE 0 END
        WHEN contains(k, ' ') AND len(list_filter(string_split(k, ' '),
          lambda x: NOT contains(q, x))) = 0 THEN {weight} ELSE 0 END"""


def flow_views(name: str, asks: str) -> None:
    """Check views of multi-query retrieval (lexical) of an ask view.

    ``asks``: question_id, text, forced (family id or ''). No text of the given
    tables trips a gate. The last view is ``v_<name>_top``.
    """
    v = lambda part: f"v_{name}_{part}"
    CHECK_ONLY[v("plain")] = f"""
    SELECT question_id, forced, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) AS q,
      trim(text, ' ' || chr(10)) AS base FROM {{{asks}}}"""
    CHECK_ONLY[v("workflow")] = f"""
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, no)
        AS n FROM (SELECT question_id, q, forced, w.no, w.id, w.family_id, w.title,
          w.preferred_symbols, sum({_points(4)}) AS score FROM {{{v("plain")}}} CROSS JOIN (
          SELECT workflow_no AS no, id, family_id, title, preferred_symbols, unnest(keywords) AS k
          FROM {{v_workflows}}) AS w WHERE forced = '' OR forced = family_id
        GROUP BY question_id, q, forced, w.no, w.id, w.family_id, w.title, w.preferred_symbols) AS s
      WHERE score > 0) AS r WHERE n = 1"""
    CHECK_ONLY[v("family")] = f"""
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, no)
        AS n FROM (SELECT question_id, forced, f.no, f.id, f.name, sum({_points(3)}) AS score
        FROM {{{v("plain")}}} CROSS JOIN (SELECT family_no AS no, id, name, unnest(keywords) AS k
          FROM {{v_families}}) AS f GROUP BY question_id, forced, f.no, f.id, f.name) AS s
      WHERE CASE WHEN forced = '' THEN score > 0 ELSE id = forced END) AS r WHERE n = 1"""
    CHECK_ONLY[v("focus")] = f"""
    SELECT question_id, arg_max(sym, score * 1000 - pos) AS sym, max(score) AS focus FROM (
      SELECT question_id, pos, sym, CASE WHEN contains(q, tail) THEN 4 ELSE 0 END
        + len(list_filter(regexp_split_to_array(tail, '[^a-z0-9]+'),
          lambda t: length(t) > 2 AND contains(q, t))) AS score
      FROM (SELECT question_id, q, pos, sym, lower(split_part(sym, '.', -1)) AS tail FROM (
          SELECT question_id, q, unnest(range(len(preferred_symbols))) AS pos,
            unnest(preferred_symbols) AS sym FROM {{{v("workflow")}}}) AS u) AS t) AS z
    GROUP BY question_id"""
    CHECK_ONLY[v("selected")] = f"""
    SELECT a.question_id, a.base, coalesce(w.id, '') AS workflow_id,
      coalesce(w.title, '') AS workflow_title, coalesce(w.preferred_symbols, []) AS preferred_symbols,
      coalesce(w.family_id, f.id, '') AS family_id, coalesce(f.name, '') AS family_name, s.sym,
      coalesce(s.focus, 0) AS focus
    FROM {{{v("plain")}}} AS a LEFT JOIN {{{v("workflow")}}} AS w ON w.question_id = a.question_id
      LEFT JOIN {{{v("family")}}} AS f ON f.question_id = a.question_id
      LEFT JOIN {{{v("focus")}}} AS s ON s.question_id = a.question_id"""
    own = "{" + v("selected") + "}"
    CHECK_ONLY[v("queries")] = f"""
    SELECT question_id, sub_no, query AS text, dense_rank() OVER (ORDER BY query) AS query_id,
      count(*) OVER (PARTITION BY question_id) AS queries FROM (
      SELECT question_id, 0 AS sub_no, base AS query FROM {own}
      UNION ALL SELECT question_id, 1, concat_ws(' ', base, 'quarry', workflow_title,
        array_to_string(preferred_symbols, ' ')) FROM {own} WHERE workflow_id <> ''
      UNION ALL SELECT question_id, 2, concat_ws(' ', base, 'quarry', sym) FROM {own}
        WHERE workflow_id <> '' AND focus > 0
      UNION ALL SELECT question_id, 1, concat_ws(' ', base, 'quarry', family_name)
        FROM {own} WHERE workflow_id = '' AND family_id <> '') AS e"""
    CHECK_ONLY[v("deep")] = lexical_sql(v("queries"), 50)
    CHECK_ONLY[v("shallow")] = f"SELECT * FROM {{{v('deep')}}} WHERE rank <= 30"
    CHECK_ONLY[v("lists")] = f"""
    SELECT s.question_id, s.sub_no, d.chunk_id, d.rank, d.score FROM {{{v("queries")}}} AS s
      JOIN ({quota_sql(v("deep"), 10, 8, 2)}) AS d ON d.query_id = s.query_id AND s.queries > 1
    UNION ALL SELECT s.question_id, s.sub_no, d.chunk_id, d.rank, d.score
    FROM {{{v("queries")}}} AS s
      JOIN ({quota_sql(v("shallow"), 6, 4, 2)}) AS d ON d.query_id = s.query_id AND s.queries = 1"""
    CHECK_ONLY[v("merged")] = f"""
    SELECT question_id, chunk_id, score, row_number() OVER (PARTITION BY question_id
        ORDER BY hits DESC, score DESC, best, s, r) AS rank FROM (
      SELECT question_id, chunk_id, count(*) AS hits, max(score) AS score, min(rank) AS best,
        max(CASE WHEN nth = 1 THEN sub_no END) AS s, max(CASE WHEN nth = 1 THEN rank END) AS r
      FROM (SELECT *, row_number() OVER (PARTITION BY question_id, chunk_id ORDER BY sub_no, rank)
          AS nth FROM {{{v("lists")}}}) AS f GROUP BY question_id, chunk_id) AS g"""
    CHECK_ONLY[v("asked")] = f"""
    SELECT question_id, text, CASE WHEN len(preferred_symbols) = 0 THEN [''] ELSE preferred_symbols
      END AS preferred FROM {{{asks}}} JOIN {own} USING (question_id)"""
    feature_views(f"{name}_", v("merged"), v("asked"))
    off = "preferred[1] = ''"
    CHECK_ONLY[v("top")] = f"""
    SELECT * FROM (SELECT question_id, p.chunk_id, p.score, row_number() OVER (
        PARTITION BY question_id ORDER BY CASE WHEN {off} THEN 0 ELSE level END DESC,
          CASE WHEN {off} THEN 0 ELSE a.affinity END DESC,
          CASE WHEN {off} THEN 0 ELSE m.pos END ASC, CASE WHEN {off} THEN 0 ELSE overlap END DESC,
          CASE WHEN NOT {off} AND source_type = 'generated' THEN 1 ELSE 0 END DESC,
          CASE WHEN NOT {off} AND (qualname <> '' OR symbol_id <> '') THEN 1 ELSE 0 END DESC,
          CASE WHEN {off} THEN 0 ELSE score END DESC, p.rank) AS rank
      FROM {{v_{name}_pairs}} AS p JOIN {{v_{name}_all_matches}} AS m USING (question_id, chunk_id)
        JOIN {{v_{name}_preferred_affinity}} AS a USING (question_id, chunk_id)
        JOIN {{v_{name}_overlap}} AS o USING (question_id, chunk_id)
        JOIN {{v_{name}_asked}} AS q USING (question_id)) AS t WHERE rank <= 6"""


VIEWS["v_short_asks"] = """
    SELECT item_id AS question_id, text, '' AS forced FROM {benchmark}"""
flow_views("flow", "v_short_asks")


def short_asks(src):
    return src.view("v_short_asks").drop("forced")


@register(
    "workflow_retrieve",
    """SELECT t.question_id, rank, chunk_id, round(score, 6) AS score,
         CASE WHEN queries > 1 THEN 'lexical+workflow' ELSE 'lexical' END AS mode_label
       FROM {v_flow_top} AS t JOIN (SELECT question_id, max(queries) AS queries
         FROM {v_flow_queries} GROUP BY question_id) AS n ON n.question_id = t.question_id""",
)
def workflow_retrieve(src):
    found = A.workflow_retrieve(
        short_asks(src), index_of(src, dense=False), registry(src), A.Settings(names=NAMES)
    )
    return long(found.withColumn("score", F.round("score", 6)), "rank")


@register("workflow_retrieve_graph")
def workflow_retrieve_graph(src):
    graph = G.symbol_graph(
        src.view("v_chunks"), src.view("v_workflows"), src.view("v_narratives")
    )
    options = A.Settings(names=NAMES, scorer=length_scorer)
    found = A.workflow_retrieve(
        short_asks(src), index_of(src, dense=False), registry(src), options, graph
    )
    return long(found.withColumn("score", F.round("score", 6)), "rank")


@register(
    "workflow_merge",
    """SELECT question_id, chunk_id, round(score, 6) AS score, rank FROM {v_flow_merged}""",
)
def workflow_merge(src):
    """The merged lists of all retrieval queries, before any rerank."""
    from granary.operators import routing, search

    chosen = routing.choose_workflow(short_asks(src), registry(src), NAMES)
    lists = A.retrieved_lists(chosen, index_of(src, dense=False), A.Settings(names=NAMES))
    merged = search.merge_result_sets(lists).select("question_id", "chunk_id", "score", "rank")
    return long(merged.withColumn("score", F.round("score", 6)), "rank")


# Two passes over the result lists; the second starts at half of the first.
VIEWS["v_passes"] = """
    SELECT question_id, 1 AS pass_no, 1 AS step_id, rank, chunk_id, score FROM {v_results}
    WHERE rank <= 6
    UNION ALL SELECT question_id, 2, 2, rank - 3, chunk_id, score / 2 FROM {v_results}
    WHERE rank BETWEEN 4 AND 13"""


@register(
    "collect_passes",
    """WITH f AS (SELECT *, row_number() OVER (PARTITION BY question_id, chunk_id
           ORDER BY pass_no, rank) AS n FROM {v_passes}),
         o AS (SELECT question_id, chunk_id, score, step_id, row_number() OVER (
           PARTITION BY question_id ORDER BY pass_no, rank) AS rank FROM f WHERE n = 1)
       SELECT question_id, rank, chunk_id, round(score, 6) AS score, step_id FROM o
       WHERE rank <= 10""",
)
def collect_passes(src):
    kept = A.collect_passes(src.view("v_passes")).withColumn("score", F.round("score", 6))
    return long(kept, "rank")


def collected_sql(passes: str) -> str:
    """First occurrence of each chunk over the passes, capped at ten."""
    return f"""
    SELECT question_id, rank, chunk_id, round(score, 6) AS score, step_id FROM (
      SELECT question_id, chunk_id, score, step_id, row_number() OVER (PARTITION BY question_id
          ORDER BY pass_no, rank) AS rank FROM (
        SELECT *, row_number() OVER (PARTITION BY question_id, chunk_id ORDER BY pass_no, rank)
          AS n FROM ({passes}) AS p) AS f WHERE n = 1) AS c WHERE rank <= 10"""


CHECK_ONLY["v_second_asks"] = (
    """SELECT question_id, '' AS forced, trim(concat_ws(' ', text, 'related_apis: ' || hints,
        CASE WHEN """
    + any_of("lower(text)", vocab.DOCUMENT_MARKERS)
    + """ THEN 'user guide documentation section' ELSE 'runnable example quarry' END)) AS text
    FROM {v_short_asks} LEFT JOIN (SELECT question_id, string_agg(hint, ' ' ORDER BY n) AS hints
      FROM (SELECT question_id, hint, row_number() OVER (PARTITION BY question_id ORDER BY min(rank))
          AS n FROM (SELECT question_id, rank, coalesce(nullif(qualname, ''), symbol_id) AS hint
          FROM {v_flow_top} JOIN {v_chunks} USING (chunk_id) WHERE source_type = 'generated') AS r
        GROUP BY question_id, hint) AS h WHERE n <= 2 GROUP BY question_id) AS g USING (question_id)
    WHERE question_id % 2 = 1"""
)
flow_views("again", "v_second_asks")


@register(
    "retry_retrieve",
    collected_sql(
        """SELECT question_id, chunk_id, score, rank, 1 AS pass_no, 1 AS step_id FROM {v_flow_top}
        UNION ALL SELECT question_id, chunk_id, score, rank, 2, 2 FROM {v_again_top}"""
    ),
)
def retry_retrieve(src):
    """Odd questions have a budget of one retry."""
    asks = short_asks(src).withColumn("retries", (F.col("question_id") % 2).cast("int"))
    found = A.retry_retrieve(
        asks, index_of(src, dense=False), registry(src), 1, A.Settings(names=NAMES)
    )
    return long(found.withColumn("score", F.round("score", 6)), "rank")


CHECK_ONLY["v_short_complexity"] = complexity_sql("SELECT question_id, text FROM {v_short_asks}")
CHECK_ONLY["v_states"] = f"""
    SELECT *, CASE WHEN route_mode IN ('plan', 'auto_fast') THEN 0 ELSE 1 END AS budget FROM (
      SELECT question_id, text, confidence, CASE WHEN mode <> 'auto' THEN mode WHEN no_pdf THEN 'plan'
          WHEN score <= 3 AND confidence >= 0.60 THEN 'auto_fast'
          WHEN score <= 6 AND confidence >= 0.30 THEN 'auto' ELSE 'plan' END AS route_mode,
        CASE WHEN mode = 'fast' THEN '{vocab.ROUTE_REASONS["fast_asked"]}'
          WHEN mode = 'plan' THEN '{vocab.ROUTE_REASONS["plan_asked"]}'
          WHEN no_pdf THEN '{vocab.ROUTE_REASONS["plan_pdf"]}'
          WHEN score <= 3 AND confidence >= 0.60 THEN '{vocab.ROUTE_REASONS["auto_fast"]}'
          WHEN score <= 6 AND confidence >= 0.30 THEN '{vocab.ROUTE_REASONS["auto"]}'
          ELSE '{vocab.ROUTE_REASONS["plan"]}' END AS reason
      FROM (SELECT q.question_id, q.text, score, coalesce(CASE WHEN symbols >= 2
            THEN least(1.0::DOUBLE, mean + 0.03::DOUBLE) ELSE mean END, 0.0::DOUBLE) AS confidence,
          {any_of("lower(q.text)", vocab.DOCUMENT_MARKERS)} AND NOT coalesce(has_pdf, FALSE) AS no_pdf,
          CASE q.question_id % 5 WHEN 0 THEN 'fast' WHEN 1 THEN 'plan' ELSE 'auto' END AS mode
        FROM {{v_short_asks}} AS q JOIN {{v_short_complexity}} AS c ON c.question_id = q.question_id
          LEFT JOIN (SELECT question_id,
              avg(CASE WHEN rank > 4 THEN NULL WHEN score <= 0 THEN 0.0::DOUBLE WHEN score <= 1
                THEN score ELSE score / (score + 1) END) AS mean,
              count(*) FILTER (WHERE rank <= 4 AND source_type = 'generated') AS symbols,
              bool_or(source_type = 'pdf') AS has_pdf
            FROM {{v_flow_top}} JOIN {{v_chunks}} USING (chunk_id) WHERE rank <= 5
            GROUP BY question_id) AS r ON r.question_id = q.question_id) AS f) AS s"""
CHECK_ONLY["v_open_asks"] = CHECK_ONLY["v_second_asks"].replace(
    "WHERE question_id % 2 = 1", "WHERE question_id IN (SELECT question_id FROM {v_states} WHERE budget > 0)"
)
flow_views("open", "v_open_asks")


@register(
    "route_questions",
    f"""SELECT c.*, route_mode, reason, round(confidence, 6) AS confidence, budget,
          CASE WHEN budget > 0 THEN 2 ELSE 1 END AS passes FROM ({collected_sql(
              """SELECT question_id, chunk_id, score, rank, 1 AS pass_no, '1' AS step_id FROM {v_flow_top}
              UNION ALL SELECT question_id, chunk_id, score, rank, 2, '2' FROM {v_open_top}"""
          )}) AS c JOIN {{v_states}} AS s ON s.question_id = c.question_id""",
)
def route_questions(src):
    """Whole benchmark texts as fast, planned and automatic questions, each with its state."""
    mode = F.when(F.col("question_id") % 5 == 0, "fast").when(F.col("question_id") % 5 == 1, " Plan")
    asks = short_asks(src).withColumn("mode", mode)
    states, results = A.route_questions(
        asks, index_of(src, dense=False), registry(src), A.Settings(names=NAMES)
    )
    rows = results.join(states.drop("mode", "escalated"), "question_id")
    rows = rows.withColumn("score", F.round("score", 6)).withColumn("confidence", F.round("confidence", 6))
    return long(rows, "rank", "budget", "passes")


# Plans of three steps per question with decisions on some of them.
VIEWS["v_steps"] = """
    SELECT item_id AS question_id, position, position * 10 AS step_id,
      CASE (item_id + position) % 4 WHEN 0 THEN 'B' WHEN 1 THEN 'c' ELSE '' END AS family_id,
      'Look' AS title, CASE WHEN position = 2 THEN '' ELSE 'see the text' END AS instruction,
      CASE position WHEN 1 THEN text WHEN 2 THEN '' ELSE concat('of that ', text) END
        AS retrieval_query
    FROM {benchmark} CROSS JOIN (VALUES (1), (2), (3)) AS n(position)"""
VIEWS["v_step_decisions"] = """
    SELECT question_id, position, CASE (question_id + position) % 5 WHEN 0 THEN 'refine_query'
        WHEN 1 THEN 'Stop ' ELSE 'continue' END AS action,
      CASE WHEN question_id % 2 = 0 THEN 'une de la' ELSE ' ' END AS next_query
    FROM {v_steps} WHERE position < 3"""


CHECK_ONLY["v_run_steps"] = """
    SELECT question_id, position, step_id, family_id, CASE WHEN action = 'refine_query'
        AND trim(next_query) <> '' THEN trim(next_query)
        ELSE coalesce(nullif(retrieval_query, ''), nullif(instruction, ''), title) END AS query
    FROM (SELECT s.*, d.action, d.next_query, coalesce(max(CASE WHEN lower(trim(d.action)) = 'stop'
          THEN 1 ELSE 0 END) OVER (PARTITION BY s.question_id ORDER BY s.position
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS stopped
      FROM {v_steps} AS s LEFT JOIN {v_step_decisions} AS d
        ON d.question_id = s.question_id AND d.position = s.position) AS t WHERE stopped = 0"""
CHECK_ONLY["v_step_asks"] = """
    SELECT question_id * 10 + position AS question_id, query AS text, upper(family_id) AS forced
    FROM {v_run_steps}"""
flow_views("plan", "v_step_asks")


@register("effective_steps", "SELECT question_id, position, step_id, family_id, query FROM {v_run_steps}")
def effective_steps(src):
    return A.effective_steps(src.view("v_steps"), src.view("v_step_decisions"))


@register(
    "plan_retrieve",
    collected_sql(
        """SELECT r.question_id, t.chunk_id, t.score, t.rank, r.position AS pass_no, r.step_id
        FROM {v_plan_top} AS t JOIN {v_run_steps} AS r
          ON t.question_id = r.question_id * 10 + r.position"""
    ),
)
def plan_retrieve(src):
    found = A.plan_retrieve(
        src.view("v_steps"), src.view("v_step_decisions"), index_of(src, dense=False),
        registry(src), A.Settings(names=NAMES),
    )
    return long(found.withColumn("score", F.round("score", 6)), "rank")


@register(
    "build_index",
    """SELECT 'generated' AS source_type, count(*) AS chunks FROM {v_symbol_records}
       UNION ALL SELECT 'pdf', count(*) FROM {documents} WHERE length(text) >= 0""",
)
def build_index(src):
    """Index over symbols and one-page documents, counted by source type."""
    pages = src.table("documents").select(
        "doc_id", F.lit(1).alias("page"), "text", "source"
    )
    index = B.build_index("both", symbols=symbol_records(src), pages=pages)
    return index.chunks.groupBy("source_type").agg(F.count("*").alias("chunks"))


@register(
    "narrative_sections",
    f"""WITH {SECTIONS_SQL.strip()},
      {MERGED_SQL},
      t AS (SELECT doc_id, arg_min(title, no) AS section_title, {MERGED_TEXT} AS text
        FROM c GROUP BY doc_id, g)
      SELECT module, 'x.py' AS source_file, section_title, t.text, 'narrative:' || module || ':'
        || CASE WHEN slug = '' THEN 'untitled' ELSE substr(slug, 1, 60) END AS section_id
      FROM (SELECT *, trim(regexp_replace(lower(section_title), '[^a-z0-9]+', '_', 'g'), '_')
          AS slug FROM t) AS t
        JOIN (SELECT doc_id, module, text AS doc FROM {{v_headed}}) AS h USING (doc_id)
      WHERE length(doc) >= 300""",
)
def narrative_sections(src):
    docs = src.view("v_headed").select(
        "module", F.col("text").alias("docstring"), F.lit("x.py").alias("source_file")
    )
    return X.narrative_sections(docs, "quarry").drop("section_no")


# Module texts with headings and references to the symbols of the chunks.
VIEWS["v_modules"] = r"""
    SELECT doc_id, concat(lang, '.d', CAST(doc_id AS STRING)) AS module,
      concat('root/', lang, '/d', CAST(doc_id AS STRING), '.py') AS path,
      concat('Module ', replace(replace(replace(replace(replace(replace(replace(replace(replace(text,
        chr(34), ''), chr(92), ''),
        '. ', concat('.', chr(10))),
        ' the ', concat(chr(10), 'sage: obj.op_', CAST(doc_id % 60 AS STRING), ' (x) ')),
        ' and ', concat(chr(10), '.. rubric:: And ')),
        ' de ', concat(chr(10), chr(10), 'De', chr(10), '===', chr(10))),
        ' la ', concat(' :class:`~Cls1.op_', CAST(doc_id % 50 AS STRING),
          '` :meth:` MOD_EN.Cls2.op_9() ` ')),
        ' die ', concat(chr(10), 'sage: from pack.mod import Cls3, op_3, * ', chr(10))),
        ' und ', concat(chr(10), 'sage: Cls5 (2) '))) AS text
    FROM {documents}"""
_MODULE_ROWS = f"""WITH {SECTIONS_SQL.strip().replace("{v_headed}", "{v_modules}")},
      {MERGED_SQL},
      merged AS (SELECT doc_id * 100000 + g AS doc_id, doc_id AS module_id,
          arg_min(title, no) AS section_title, {MERGED_TEXT} AS text FROM c GROUP BY doc_id, g),
      kept AS (SELECT s.*, d.module, path FROM merged AS s JOIN {{v_modules}} AS d
          ON d.doc_id = module_id WHERE length(d.text) >= 300 AND module_id % 10 <> 4),
      {REFS_SQL.strip().replace("{v_narrative_text}", "kept")},
      records AS (SELECT seq, symbol_id, qualname FROM {{v_pre}}),
      exact AS (SELECT text, arg_max(symbol_id, seq * 2 + nth) AS symbol_id FROM (
          SELECT seq, 0 AS nth, lower(symbol_id) AS text, symbol_id FROM records
          UNION ALL SELECT seq, 1, lower(qualname), symbol_id FROM records) AS i GROUP BY text),
      ends AS (SELECT DISTINCT lower(split_part(qualname, '.', -1)) AS tail, symbol_id FROM records),
      places AS (SELECT symbol_id, min(seq) AS seq FROM records GROUP BY symbol_id),
      one AS (SELECT doc_id, ref, row_number() OVER (PARTITION BY doc_id ORDER BY kind, i, j) AS pos,
          lower(regexp_replace(trim(ref), '\\(\\)$', '')) AS whole FROM o WHERE n = 1),
      hits AS (SELECT doc_id, pos, symbol_id FROM one JOIN exact ON exact.text = whole
        UNION ALL SELECT doc_id, pos, symbol_id FROM one
          JOIN ends ON tail = split_part(whole, '.', -1) WHERE whole NOT IN (SELECT text FROM exact)),
      found AS (SELECT doc_id, string_agg(symbol_id, '|' ORDER BY pos, seq) AS resolved,
          count(*) AS resolved_count FROM (SELECT doc_id, symbol_id, min(pos) AS pos FROM hits
            GROUP BY doc_id, symbol_id) AS h JOIN places USING (symbol_id) GROUP BY doc_id),
      said AS (SELECT doc_id, string_agg(ref, '|' ORDER BY pos) AS refs FROM one GROUP BY doc_id)
      SELECT 'narrative:' || module || ':' || CASE WHEN slug = '' THEN 'untitled'
          ELSE substr(slug, 1, 60) END AS section_id, module, section_title, text,
        path AS source_file, coalesce(refs, '') AS refs, coalesce(resolved, '') AS resolved,
        coalesce(resolved_count, 0) AS resolved_count
      FROM (SELECT *, trim(regexp_replace(lower(section_title), '[^a-z0-9]+', '_', 'g'), '_')
          AS slug FROM kept) AS k LEFT JOIN said USING (doc_id) LEFT JOIN found USING (doc_id)"""


def module_files(src):
    """Source files whose docstrings are the module texts; some do not parse."""
    rows = src.view("v_modules")
    broken = F.when(F.col("doc_id") % 10 == 4, "def broken(:\n").otherwise("")
    quotes = F.lit('"""')
    return rows.select(
        "doc_id", "path", F.concat(broken, quotes, "text", quotes, F.lit("\n\nx = 1\n")).alias("source")
    )


def chunk_records(src):
    return G.chunk_symbols(src.view("v_chunks"))


@register("extract_narratives", _MODULE_ROWS)
def extract_narratives(src):
    """Whole documents as module docstrings: parsed, cut, merged, referenced, resolved."""
    made = N.extract_narratives(module_files(src), chunk_records(src), "pack", "root", "root")
    return _flat_sections(made)


@register("refresh_narratives", _MODULE_ROWS)
def refresh_narratives(src):
    """The same from a store that saw two thirds of the files before, some of them
    with other texts, and files that are gone since."""
    path = scratch_path(src.spark, "narratives")
    now = module_files(src).withColumn("modificationTime", F.timestamp_seconds(F.col("doc_id") % 5 + 100))
    gone = F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit("root/gone/"), "doc_id")).otherwise("")
    old = F.col("doc_id") % 5 == 1
    before = now.filter("doc_id % 3 <> 0").select(
        F.when(gone != "", F.concat(gone, F.lit(".py"))).otherwise(F.col("path")).alias("path"),
        F.when(old, F.replace("source", F.lit("e"), F.lit("E"))).otherwise(F.col("source")).alias("source"),
        F.when(old, F.timestamp_seconds(F.lit(50))).otherwise(F.col("modificationTime")).alias("modificationTime"),
    )
    for files in (before, now.drop("doc_id")):
        N.refresh_narratives(files, path, "pack", "root", "root")
    return _flat_sections(N.read_narratives(src.spark, path, chunk_records(src)))
