"""Queries over chunking and extraction."""

from __future__ import annotations

from pyspark.sql import functions as F

from granary.catalog.base import VIEWS, CHECK_ONLY, SPARK_ONLY, register
from granary.functions import text as T
from granary.operators import chunking as C
from granary.operators import extract as X

# Lines of documents as pages, some of them turned into headings.
VIEWS["v_line_pages"] = r"""
    SELECT doc_id, page, text, CASE WHEN page % 3 = 1 AND length(text) % 4 = 0
        THEN concat('Part ', CAST(page AS STRING)) ELSE '' END AS section_title
    FROM {v_lines}"""
SPARK_ONLY["v_lines"] = r"""
    SELECT doc_id, CAST(pos + 1 AS INT) AS page, line AS text FROM {documents}
    LATERAL VIEW posexplode(split(text, '\n')) l AS pos, line"""
CHECK_ONLY["v_lines"] = """
    SELECT doc_id, CAST(unnest(range(len(ls))) + 1 AS INT) AS page, unnest(ls) AS text
    FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM {documents}) AS d"""
# Documents whose sentences start lines and whose articles become headings.
VIEWS["v_headed"] = r"""
    SELECT doc_id, concat('mod_', lang) AS module,
      replace(replace(replace(replace(replace(text, '. ', concat('.', chr(10))),
        ' and ', concat(chr(10), '.. rubric:: And ')),
        ' the ', concat(' the', chr(10), '-----', chr(10))),
        ' de ', concat(chr(10), chr(10), 'De', chr(10), '===', chr(10))),
        ' die ', concat(chr(10), chr(10), '  ', chr(10))) AS text
    FROM {documents}"""
VIEWS["v_paged"] = r"""
    SELECT doc_id, replace(replace(replace(text, '. ', concat('.', chr(10))),
        ' the ', concat(' the', chr(10), '3.1 ')), ' de ', concat(chr(10), 'Chapter 4: '))
      AS text
    FROM {documents}"""
# Documents as markdown.
VIEWS["v_markdown"] = r"""
    SELECT doc_id, replace(replace(text, ' the ', concat(chr(10), '## `The` ')),
        ' de ', concat(chr(10), '## De', chr(10))) AS text
    FROM {documents}"""
# Documents with references of every kind.
VIEWS["v_narrative_text"] = r"""
    SELECT doc_id, replace(replace(replace(replace(replace(text,
        ' the ', concat(chr(10), 'sage: obj.solve_it (x) ')),
        ' and ', concat(chr(10), 'sage: Ring(QQ).Gen(y) ')),
        ' de ', concat(chr(10), 'sage: from pack.mod import A_', lang, ', b, * ', chr(10))),
        ' la ', ' :class:`~pack.Cls` :meth:` run() ` '),
        ' die ', concat(chr(10), 'sage: x._hidden(3) sage: Call (2) ')) AS text
    FROM {documents}"""

NUMBERED = r"'^\s*(\d+(?:\.\d+)*)\s+(.{3,120})\s*$'"
CHAPTER = r"'(?i)^\s*Chapter\s+\d+\s*[:.-]?\s*(.{3,120})\s*$'"


@register(
    "read_page_table",
    """SELECT doc_id, page, text FROM {v_lines}""",
)
def read_page_table(src):
    from granary.sources.pages import page_table

    return page_table(src.table("documents"), "doc_id", F.split("text", "\n"))


@register(
    "detect_section_title",
    rf"""WITH ls AS (SELECT doc_id, unnest(range(len(x))) AS i, trim(unnest(x)) AS t
           FROM (SELECT doc_id, string_split(text, chr(10))[1:35] AS x FROM {{v_paged}}) AS d),
         hit AS (SELECT doc_id, i, CASE WHEN regexp_matches(t, {NUMBERED})
               THEN regexp_extract(t, {NUMBERED}, 1) || ' ' || trim(regexp_extract(t, {NUMBERED}, 2))
             ELSE t END AS title
           FROM ls WHERE t <> '' AND length(t) <= 140
             AND NOT (upper(t) = t AND lower(t) <> t AND len(regexp_split_to_array(t, '\s+')) > 10)
             AND (regexp_matches(t, {NUMBERED}) OR regexp_matches(t, {CHAPTER})))
         SELECT doc_id, coalesce(arg_min(title, i), '') AS section_title
         FROM {{documents}} LEFT JOIN hit USING (doc_id) GROUP BY doc_id""",
)
def detect_section_title(src):
    return src.view("v_paged").select(
        "doc_id", C.detect_section_title("text").alias("section_title")
    )


@register(
    "carry_forward_section",
    """SELECT doc_id, page, coalesce(last_value(nullif(section_title, '') IGNORE NULLS) OVER (
         PARTITION BY doc_id ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), '')
         AS section_title FROM {v_line_pages}""",
)
def carry_forward_section(src):
    filled = C.carry_forward_section(src.view("v_line_pages"))
    return filled.select("doc_id", "page", "section_title")


@register(
    "pack_pages",
    # Walks the pages of each document in order: the state of the chunk that
    # begins at each page is computed first, reachable starts are then followed.
    """WITH RECURSIVE p AS (SELECT doc_id, page, length(text) AS n,
           count(*) OVER (PARTITION BY doc_id) AS pages,
           sum(length(text) + 20) OVER (PARTITION BY doc_id ORDER BY page) AS c,
           sum(length(text)) OVER (PARTITION BY doc_id ORDER BY page) AS r FROM {v_lines}),
         e AS (SELECT a.doc_id, a.page, a.pages, greatest(a.page, max(b.page)) AS stop
           FROM p AS a JOIN p AS b ON a.doc_id = b.doc_id AND b.page >= a.page
             AND (b.page = a.page OR b.c - (a.c - a.n - 20) <= 600)
           GROUP BY a.doc_id, a.page, a.pages),
         s AS (SELECT e.doc_id, e.page, e.pages, e.stop, greatest(e.page + 1,
             max(CASE WHEN t.r - (q.r - q.n) >= 80 OR q.page = e.page THEN q.page END)) AS nxt
           FROM e JOIN p AS t ON t.doc_id = e.doc_id AND t.page = e.stop
             JOIN p AS q ON q.doc_id = e.doc_id AND q.page BETWEEN e.page AND e.stop
           GROUP BY e.doc_id, e.page, e.pages, e.stop),
         w(doc_id, chunk_no, page, stop, nxt, pages) AS (
           SELECT doc_id, 0, page, stop, nxt, pages FROM s WHERE page = 1
           UNION ALL
           SELECT w.doc_id, w.chunk_no + 1, s.page, s.stop, s.nxt, s.pages
           FROM w JOIN s ON s.doc_id = w.doc_id AND s.page = w.nxt WHERE w.stop < w.pages)
       SELECT w.doc_id, CAST(w.chunk_no AS BIGINT) AS chunk_no, w.page AS page_start,
         w.stop AS page_end,
         string_agg('[PAGE ' || CAST(v.page AS VARCHAR) || ']' || chr(10) || v.text,
           chr(10) || chr(10) ORDER BY v.page) AS text,
         coalesce(arg_min(nullif(v.section_title, ''), v.page)
           FILTER (WHERE v.section_title <> ''), '') AS section_title
       FROM w JOIN {v_line_pages} AS v ON v.doc_id = w.doc_id AND v.page BETWEEN w.page AND w.stop
       GROUP BY w.doc_id, w.chunk_no, w.page, w.stop""",
)
def pack_pages(src):
    return C.pack_pages(src.view("v_line_pages"), 600, 80)


def _v_symbol_records() -> None:
    VIEWS["v_symbol_records"] = """
        SELECT doc_id AS seq, CASE WHEN doc_id % 11 = 0 THEN '' ELSE concat('mod_', lang, '.f',
            CAST(doc_id AS STRING)) END AS id,
          CASE WHEN doc_id % 13 = 0 THEN '' ELSE concat('mod_', lang) END AS module,
          CASE WHEN doc_id % 7 = 0 THEN '' ELSE concat('f', CAST(doc_id AS STRING)) END AS qualname,
          CASE WHEN doc_id % 2 = 0 THEN 'function' ELSE 'class' END AS kind,
          CASE WHEN doc_id % 3 = 0 THEN '' ELSE concat('f', CAST(doc_id AS STRING), '(x)') END
            AS signature,
          CASE WHEN doc_id % 4 = 0 THEN '' ELSE concat('About ', source) END AS summary,
          CASE WHEN doc_id % 5 = 0 THEN '' ELSE text END AS docstring,
          CASE WHEN doc_id % 9 = 0 THEN CAST(NULL AS INT) ELSE CAST(doc_id % 3 AS INT) END
            AS example_count,
          concat('lib/', source, '.py') AS file_path, CAST(doc_id % 900 AS INT) AS line, lang
        FROM {documents}"""


_v_symbol_records()
_EXAMPLES_SPARK = (
    "CASE WHEN seq % 6 = 0 THEN array() WHEN seq % 6 = 1 THEN array('run(1)', '  ', ' go ') "
    "ELSE transform(sequence(1, 12), i -> concat('ex', CAST(i AS STRING))) END"
)


@register(
    "render_symbol_chunks",
    """SELECT CASE WHEN seq % 11 = 0 THEN '' ELSE id END AS symbol_id, qualname, module, line,
         concat_ws(chr(10),
           'Symbol: ' || coalesce(nullif(qualname, ''), nullif(id, ''), 'unknown_symbol'),
           'ID: ' || coalesce(nullif(id, ''), nullif(qualname, ''), 'unknown_symbol'),
           'Module: ' || coalesce(nullif(module, ''), 'unknown'), 'Kind: ' || kind,
           'Signature: ' || coalesce(nullif(signature, ''), 'unknown'),
           'Summary: ' || nullif(summary, ''), 'Docstring:' || chr(10) || nullif(docstring, ''),
           CASE WHEN seq % 6 = 0 THEN NULL
             WHEN seq % 6 = 1 THEN 'Examples:' || chr(10) || '- run(1)' || chr(10) || '- go'
             ELSE 'Examples:' || chr(10) || array_to_string(list_transform(range(1, 11),
               lambda i: '- ex' || CAST(i AS VARCHAR)), chr(10)) END,
           'Search keys: ' || nullif(concat_ws(' ', nullif(id, ''), nullif(qualname, ''),
             nullif(signature, ''), nullif(module, '')), '')) AS text,
         CAST(coalesce(nullif(example_count, 0),
           CASE WHEN seq % 6 = 0 THEN 0 WHEN seq % 6 = 1 THEN 2 ELSE 12 END) AS INT)
           AS example_count
       FROM {v_symbol_records}""",
)
def render_symbol_chunks(src):
    records = src.view("v_symbol_records").withColumn("examples", F.expr(_EXAMPLES_SPARK))
    return C.render_symbol_chunks(records).select(
        "symbol_id", "qualname", "module", "line", "text", "example_count"
    )


@register(
    "split_markdown_sections",
    """WITH l AS (SELECT doc_id, unnest(range(len(x))) AS i, unnest(x) AS t FROM (
           SELECT doc_id, string_split(text, chr(10)) AS x FROM {v_markdown}) AS d),
         s AS (SELECT doc_id, i, t, sum(CASE WHEN t LIKE '## %' THEN 1 ELSE 0 END)
           OVER (PARTITION BY doc_id ORDER BY i) AS sec FROM l),
         g AS (SELECT doc_id, sec, arg_min(t, i) AS head,
             trim(string_agg(t, chr(10) ORDER BY i), ' ' || chr(10)) AS body
           FROM s GROUP BY doc_id, sec)
       SELECT doc_id, CASE WHEN head LIKE '## %'
           THEN trim(trim(ltrim(head, '#')), '`') ELSE 'API Reference' END AS title, body
       FROM g WHERE body <> ''""",
)
def split_markdown_sections(src):
    return C.split_markdown_sections(src.view("v_markdown")).select("doc_id", "title", "body")


WINDOWS_SQL = """
    SELECT doc_id, i, trim(substr(text, CAST(i * 2150 + 1 AS BIGINT), 2400), ' ' || chr(10))
      AS piece
    FROM (SELECT doc_id, text, unnest(range(CASE WHEN length(text) = 0 THEN 0
        WHEN length(text) <= 2400 THEN 1
        ELSE CAST(ceil((length(text) - 2400) / 2150.0) AS BIGINT) + 1 END)) AS i
      FROM {documents}) AS w"""


@register(
    "fixed_windows",
    f"""SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS window_no, piece
        FROM ({WINDOWS_SQL}) AS p WHERE piece <> ''""",
)
def fixed_windows(src):
    return src.table("documents").select(
        "doc_id", F.posexplode_outer(C.fixed_windows("text", 2400, 250)).alias("window_no", "piece")
    ).filter("piece IS NOT NULL").withColumn("window_no", F.col("window_no").cast("bigint"))


@register(
    "narrative_windows",
    # Follows the windows of each text: a window ends at the last line break of
    # its second half, and the next one starts 400 characters before that.
    """WITH RECURSIVE n AS (SELECT doc_id, 'Topic ' || source AS title, 'mod_' || lang AS module,
           source || '.py' AS origin, 'Narrative: Topic ' || source || chr(10) || 'Module: mod_'
             || lang || chr(10) || 'Source: ' || source || '.py' || chr(10)
             || 'Related symbols: ref.' || lang || ', ref.all' || chr(10) || chr(10)
             || trim(text, ' ' || chr(10)) AS body FROM {documents}
           WHERE trim(text, ' ' || chr(10)) <> ''),
         w(doc_id, body, start, stop) AS (
           SELECT doc_id, body, 0, CASE WHEN length(body) <= 3500 THEN length(body) ELSE 3500
             - coalesce(nullif(strpos(reverse(substr(body, 1751, 1750)), chr(10)), 0), 0) END FROM n
           UNION ALL
           SELECT doc_id, body, b, CASE WHEN length(body) <= b + 3500 THEN length(body)
             ELSE b + 3500 - strpos(reverse(substr(body, b + 1751, 1750)), chr(10)) END
           FROM (SELECT doc_id, body, greatest(stop - 400, start + 1) AS b FROM w
             WHERE stop < length(body)) AS x),
         p AS (SELECT doc_id, start, trim(substr(body, start + 1, stop - start), ' ' || chr(10))
           AS text FROM w),
         k AS (SELECT doc_id, text, row_number() OVER (PARTITION BY doc_id ORDER BY start) - 1
           AS chunk_no FROM p WHERE text <> '')
       SELECT 'narrative:' || CAST(doc_id AS VARCHAR) || CASE WHEN chunk_no = 0 THEN ''
           ELSE ':' || CAST(chunk_no AS VARCHAR) END AS symbol_id, chunk_no, k.text,
         title AS section_title, module, origin AS file_path
       FROM k JOIN n USING (doc_id)""",
)
def narrative_windows(src):
    rows = src.sql(
        """SELECT concat('narrative:', CAST(doc_id AS STRING)) AS section_id,
             concat('mod_', lang) AS module, concat('Topic ', source) AS section_title, text,
             concat(source, '.py') AS source_file, array(concat('ref.', lang), 'ref.all')
             AS resolved_symbol_ids FROM {documents}"""
    )
    cut = C.narrative_windows(rows, separator="\n").select(
        "symbol_id", "chunk_no", "text", "section_title", "module", "file_path"
    )
    return cut.withColumn("chunk_no", F.col("chunk_no").cast("bigint"))


def _sources(src) -> dict:
    chunks = src.view("v_chunks").withColumn("doc_id", F.col("chunk_id"))
    chunks = chunks.withColumn("chunk_no", F.lit(0).cast("bigint"))
    kind = F.col("source_type")
    return {
        "generated": chunks.filter((kind == "generated") & (F.col("signature") != "")),
        "api": chunks.filter((kind == "generated") & (F.col("signature") == "")),
        "narrative": chunks.filter(kind == "narrative"),
        "pdf": chunks.filter(kind == "pdf"),
    }


@register(
    "assign_chunk_ids",
    """SELECT row_number() OVER (ORDER BY CASE source_type WHEN 'generated' THEN
           CASE WHEN signature <> '' THEN 0 ELSE 1 END WHEN 'narrative' THEN 2 ELSE 3 END,
           chunk_id) - 1 AS chunk_id, source_type, text, symbol_id
       FROM {v_chunks}""",
)
def assign_chunk_ids(src):
    rows = C.select_sources("both", **_sources(src))
    return C.assign_chunk_ids(rows).select("chunk_id", "source_type", "text", "symbol_id")


@register(
    "select_sources",
    """SELECT mode, source_type, count(*) AS chunks FROM {v_chunks} JOIN
         (VALUES ('pdf', 'pdf'), ('generated', 'generated'), ('generated', 'narrative'),
          ('both', 'pdf'), ('both', 'generated'), ('both', 'narrative')) AS m(mode, wanted)
         ON wanted = source_type GROUP BY mode, source_type""",
)
def select_sources(src):
    tables = _sources(src)
    parts = [
        C.select_sources(mode, **tables)
        .groupBy("source_type")
        .agg(F.count("*").alias("chunks"))
        .select(F.lit(mode).alias("mode"), "source_type", "chunks")
        for mode in ("pdf", "generated", "both")
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


# Line-wise reading of headings. No line of the view underlines another
# underline, so one look ahead decides.
SECTIONS_SQL = r"""
    l AS (SELECT doc_id, module, unnest(range(len(x))) AS i, unnest(x) AS t FROM (
        SELECT doc_id, module, string_split(text, chr(10)) AS x FROM {v_headed}) AS d),
    m AS (SELECT doc_id, module, i, t, trim(t) AS s,
        regexp_extract(trim(t), '^\.\.\s+rubric::\s*(.*)$', 1) AS rubric,
        regexp_matches(trim(coalesce(lead(t) OVER w, '')), '^(={3,}|-{3,}|~{3,}|\^{3,}|#{3,})')
          AS over
      FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
    h AS (SELECT *, CASE WHEN rubric <> '' THEN trim(rubric)
        WHEN over AND s <> '' AND s NOT LIKE '..%' THEN s END AS heading FROM m),
    k AS (SELECT *, coalesce(lag(heading) OVER w, '') <> '' AND coalesce(lag(rubric) OVER w, '') = ''
        AS under FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
    n AS (SELECT *, sum(CASE WHEN heading IS NOT NULL AND NOT under THEN 1 ELSE 0 END)
        OVER (PARTITION BY doc_id ORDER BY i) AS sec FROM k),
    q AS (SELECT doc_id, sec, max(CASE WHEN heading IS NOT NULL AND NOT under THEN heading END)
          AS heading, max(module) AS module,
        string_agg(t, chr(10) ORDER BY i) FILTER (WHERE under OR heading IS NULL) AS raw,
        count(*) FILTER (WHERE NOT under AND heading IS NULL) AS lines,
        string_agg(t, chr(10) ORDER BY i) FILTER (WHERE NOT under AND heading IS NULL) AS body
      FROM n GROUP BY doc_id, sec),
    sections AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY sec) AS no,
        coalesce(heading, module) AS title, trim(body, ' ' || chr(10)) AS text
      FROM q WHERE lines > 0)"""


@register(
    "split_doc_sections",
    f"WITH {SECTIONS_SQL.strip()} SELECT doc_id, no AS section_no, title, text FROM sections",
)
def split_doc_sections(src):
    sections = X.split_doc_sections("text", "module")
    return src.view("v_headed").select(
        "doc_id", F.posexplode_outer(sections).alias("section_no", "s")
    ).filter("s IS NOT NULL").select(
        "doc_id",
        (F.col("section_no") + 1).cast("bigint").alias("section_no"),
        "s.title",
        "s.text",
    )


MERGED_SQL = """a AS (SELECT *, length(text) >= 200 AS long,
          min(CASE WHEN text <> '' THEN no END) OVER (PARTITION BY doc_id) AS first
        FROM sections),
      b AS (SELECT *, sum(CASE WHEN (long AND no >= first) OR no = first THEN 1 ELSE 0 END)
          OVER (PARTITION BY doc_id ORDER BY no) AS g FROM a),
      c AS (SELECT *, row_number() OVER (PARTITION BY doc_id, g ORDER BY no) AS nth FROM b
        WHERE g > 0)"""
MERGED_TEXT = """trim(string_agg(CASE WHEN nth = 1 THEN text WHEN text = '' THEN title
          ELSE title || chr(10) || text END, chr(10) || chr(10) ORDER BY no), ' ' || chr(10))"""


@register(
    "merge_short_sections",
    f"""WITH {SECTIONS_SQL.strip()},
      {MERGED_SQL}
      SELECT doc_id, arg_min(title, no) AS title, {MERGED_TEXT} AS text
      FROM c GROUP BY doc_id, g""",
)
def merge_short_sections(src):
    merged = X.merge_short_sections(X.split_doc_sections("text", "module"))
    return src.view("v_headed").select("doc_id", F.inline_outer(merged)).filter(
        "title IS NOT NULL"
    )


@register(
    "filter_short_docs", "SELECT doc_id, n_chars FROM {documents} WHERE length(text) >= 300"
)
def filter_short_docs(src):
    return X.filter_short_docs(src.table("documents")).select("doc_id", "n_chars")


# References of texts (doc_id, text) in order; ``o`` holds each once with n = 1.
REFS_SQL = r"""
      t AS (SELECT doc_id, text,
          regexp_extract_all(text, ':(?:meth|func|class|mod|attr|obj|data|exc):`~?([^`]+)`', 1)
            AS roles,
          regexp_extract_all(text, 'sage:\s*from\s+([\w.]+)\s+import\s+([^\n]+)', 1) AS mods,
          regexp_extract_all(text, 'sage:\s*from\s+([\w.]+)\s+import\s+([^\n]+)', 2) AS imps,
          regexp_extract_all(text, 'sage:[^\n]*?\.([A-Za-z_][A-Za-z0-9_]*)\s*\(', 1) AS methods,
          regexp_extract_all(text,
            'sage:(?:[^\n]*?[^.\w\n])?([A-Za-z_][A-Za-z0-9_]*)\s*\(', 1) AS calls
        FROM {v_narrative_text}),
      r AS (
        SELECT doc_id, 0 AS kind, unnest(range(len(roles))) AS i, 0 AS j,
          regexp_replace(trim(unnest(roles)), '^~', '') AS ref FROM t
        UNION ALL
        SELECT doc_id, 1, i, unnest(range(len(ns))), trim(unnest(ns)) FROM (
          SELECT doc_id, i, list_concat(list_filter(list_transform(string_split(imp, ','),
              lambda n: trim(n)), lambda n: n <> '' AND n <> '*'),
              CASE WHEN contains(mod, 'pack') THEN [mod] ELSE [] END) AS ns
          FROM (SELECT doc_id, unnest(range(len(mods))) AS i, unnest(mods) AS mod,
              unnest(imps) AS imp FROM t) AS u) AS v
        UNION ALL
        SELECT doc_id, 2, unnest(range(len(methods))), 0, unnest(methods) FROM t
        UNION ALL
        SELECT doc_id, 3, unnest(range(len(calls))), 0, unnest(calls) FROM t),
      f AS (SELECT doc_id, kind, i, j, ref FROM r WHERE ref <> ''
          AND NOT (kind = 2 AND ref LIKE '\_%' ESCAPE '\')
          AND NOT (kind = 3 AND NOT regexp_matches(ref, '^[A-Z]'))),
      o AS (SELECT *, row_number() OVER (PARTITION BY doc_id, lower(ref) ORDER BY kind, i, j)
          AS n FROM f)"""


@register(
    "extract_refs",
    "WITH " + REFS_SQL.strip() + """
      SELECT doc_id, coalesce(string_agg(ref, ' ' ORDER BY kind, i, j), '') AS refs
      FROM {documents} LEFT JOIN (SELECT * FROM o WHERE n = 1) AS k USING (doc_id)
      GROUP BY doc_id""",
)
def extract_refs(src):
    refs = X.extract_refs("text", package="pack")
    return src.view("v_narrative_text").select("doc_id", F.array_join(refs, " ").alias("refs"))


@register(
    "extract_examples",
    r"""SELECT doc_id, len(ex) AS n, array_to_string(ex, chr(10)) AS examples FROM (
          SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)),
            lambda x: trim(x)), lambda x: starts_with(x, 'sage:')) AS ex
          FROM {v_narrative_text}) AS e""",
)
def extract_examples(src):
    found = T.extract_examples("text")
    return src.view("v_narrative_text").select("doc_id", found.alias("e")).select(
        "doc_id",
        F.size("e").cast("bigint").alias("n"),
        F.array_join("e", "\n").alias("examples"),
    )


@register(
    "sort_symbols",
    """SELECT module, qualname, kind, seq, line FROM {v_symbols}
       ORDER BY module, qualname, kind, line""",
)
def sort_symbols(src):
    symbols = src.view("v_symbols").withColumn("file_path", F.lit(""))
    return X.sort_symbols(symbols).select("module", "qualname", "kind", "seq", "line")


# Source files made of the document texts, one class with methods each.
def source_files(src):
    return src.sql(
        r'''SELECT concat('root/', lang, '/d', CAST(doc_id AS STRING),
              CASE WHEN doc_id % 2 = 0 THEN '.py' ELSE '.pyx' END) AS path,
              concat(CASE WHEN doc_id % 10 = 4 THEN 'def broken(:\n' ELSE '' END,
                '"""', 'Module ', replace(replace(text, '"', ''), '\\', ''), '"""\n\n',
                'class Box', CAST(doc_id AS STRING), '(Base, k=1):\n    """Box.\n\n    sage: Box(1)',
                '\n    """\n    def get(self, x, *rest):\n        """Get ', source,
                '."""\n        return x\n\n    def _hide(self):\n        pass\n\n',
                'def free(a, b=2):\n    return a\n') AS source
            FROM {documents}'''
    )


@register(
    "extract_symbols",
    """SELECT concat(module, '.', qualname) AS id, module, qualname, kind, signature, summary,
         file_path FROM (
         SELECT concat(lang, '.d', CAST(doc_id AS VARCHAR)) AS module,
           concat('root/', lang, '/d', CAST(doc_id AS VARCHAR),
             CASE WHEN doc_id % 2 = 0 THEN '.py' ELSE '.pyx' END) AS file_path,
           CASE n WHEN 2 THEN 'free' WHEN 1 THEN concat('Box', CAST(doc_id AS VARCHAR), '.get')
             ELSE concat('Box', CAST(doc_id AS VARCHAR)) END AS qualname,
           CASE n WHEN 2 THEN 'function' WHEN 1 THEN 'method' ELSE 'class' END AS kind,
           CASE n WHEN 2 THEN CASE WHEN doc_id % 2 = 0 THEN 'free(a, b=2)' ELSE 'free(a, b=2)' END
             WHEN 1 THEN 'get(self, x, *rest)'
             ELSE concat('Box', CAST(doc_id AS VARCHAR),
               CASE WHEN doc_id % 2 = 0 THEN '(Base, k=1)' ELSE '' END) END AS signature,
           CASE n WHEN 2 THEN '' WHEN 1 THEN concat('Get ', source, '.') ELSE 'Box.' END AS summary
         FROM {documents} CROSS JOIN (VALUES (0), (1), (2)) AS k(n) WHERE doc_id % 10 <> 4) AS s""",
)
def extract_symbols(src):
    scanned = X.scan_sources(source_files(src))
    return X.extract_symbols(scanned, "root").select(
        "id", "module", "qualname", "kind", "signature", "summary", "file_path"
    )


@register(
    "extract_module_docs",
    r"""SELECT concat(lang, '.d', CAST(doc_id AS VARCHAR)) AS module,
          coalesce(CASE WHEN doc_id % 10 IN (0, 2, 6, 8) THEN
            trim('Module ' || replace(replace(text, '"', ''), '\', ''), ' ' || chr(10)) END, '')
            AS docstring
        FROM {documents}""",
)
def extract_module_docs(src):
    docs = X.extract_module_docs(X.scan_sources(source_files(src)), "root", "root")
    return docs.select("module", T.strip("docstring").alias("docstring"))


@register(
    "extraction_errors",
    """SELECT concat('root/', lang, '/d', CAST(doc_id AS VARCHAR), '.py') AS path
       FROM {documents} WHERE doc_id % 10 = 4""",
)
def extraction_errors(src):
    return X.extraction_errors(X.scan_sources(source_files(src))).select("path")
