"""Queries over the text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from granary import vocab
from granary.catalog.base import register
from granary.functions import text as T

TOKENS = (
    "list_transform(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*'), lambda t: lower(t))"
)


def sql_list(items) -> str:
    return ", ".join("'" + item.replace("'", "''") + "'" for item in items)


@register(
    "tokenize",
    f"""SELECT doc_id, len({TOKENS}) AS n, array_to_string({TOKENS}, ' ') AS tokens
        FROM {{documents}}""",
)
def tokenize(src):
    tokens = T.tokenize("text")
    return src.table("documents").select("doc_id", tokens.alias("t")).select(
        "doc_id", F.size("t").cast("bigint").alias("n"), F.array_join("t", " ").alias("tokens")
    )


@register(
    "normalize_text",
    r"""SELECT page_id, trim(regexp_replace(lower(html), '\s+', ' ', 'g')) AS text
        FROM {pages}""",
)
def normalize_text(src):
    return src.table("pages").select("page_id", T.normalize_text("html").alias("text"))


def _query_tokens_sql(stopwords) -> str:
    return f"""
      SELECT question_id, coalesce(string_agg(t, ' ' ORDER BY first), '') AS tokens,
        count(t) AS n
      FROM {{v_questions}} LEFT JOIN (
        SELECT question_id, t, min(i) AS first FROM (
          SELECT question_id, unnest(x) AS t, unnest(range(len(x))) AS i FROM (
            SELECT question_id, regexp_extract_all(lower(text), '[A-Za-z_][A-Za-z0-9_]*') AS x
            FROM {{v_questions}}) AS a) AS b
        WHERE length(t) > 1 AND t NOT IN ({sql_list(stopwords)})
        GROUP BY question_id, t) AS k USING (question_id)
      GROUP BY question_id"""


def _query_tokens(src, stopwords):
    tokens = T.query_tokens("text", stopwords)
    return src.view("v_questions").select("question_id", tokens.alias("t")).select(
        "question_id",
        F.array_join("t", " ").alias("tokens"),
        F.size("t").cast("bigint").alias("n"),
    )


@register("query_tokens", _query_tokens_sql(vocab.RERANK_STOPWORDS))
def query_tokens(src):
    return _query_tokens(src, vocab.RERANK_STOPWORDS)


@register("query_tokens_graph", _query_tokens_sql(vocab.GRAPH_STOPWORDS))
def query_tokens_graph(src):
    return _query_tokens(src, vocab.GRAPH_STOPWORDS)


@register(
    "token_forms",
    f"""SELECT token, CASE
          WHEN length(token) > 4 AND token LIKE '%ies'
            THEN token || ' ' || substr(token, 1, length(token) - 3) || 'y'
          WHEN length(token) > 3 AND token LIKE '%s' AND token NOT LIKE '%ss'
            THEN token || ' ' || substr(token, 1, length(token) - 1)
          ELSE token END AS forms
        FROM (SELECT DISTINCT unnest({TOKENS}) AS token FROM {{documents}}) AS t""",
)
def token_forms(src):
    tokens = src.table("documents").select(F.explode_outer(T.tokenize("text")).alias("token"))
    tokens = tokens.filter("token IS NOT NULL").distinct()
    return tokens.select("token", F.array_join(T.token_forms(F.col("token")), " ").alias("forms"))


@register(
    "split_symbol_words",
    r"""SELECT doc_id, coalesce(array_to_string(list_transform(
            regexp_extract_all(regexp_replace(text, '([A-Z]+)([A-Z][a-z])', '\1 \2', 'g'),
              '[A-Z]?[a-z]+|[A-Z]+|[0-9]+'), lambda w: lower(w)), ' '), '') AS words
        FROM {documents}""",
)
def split_symbol_words(src):
    return src.table("documents").select(
        "doc_id", F.array_join(T.split_symbol_words("text"), " ").alias("words")
    )


@register(
    "qualname_parts",
    """SELECT seq, split_part(symbol_id, '.', -1) AS tail,
         CASE WHEN contains(symbol_id, '.') THEN substr(symbol_id, 1,
           length(symbol_id) - length(split_part(symbol_id, '.', -1)) - 1) ELSE '' END AS owner,
         CASE WHEN contains(symbol_id, '.') THEN split_part(symbol_id, '.', -2) ELSE '' END
           AS owner_tail
       FROM {v_symbols}""",
)
def qualname_parts(src):
    return src.view("v_symbols").select(
        "seq",
        T.tail_of("symbol_id").alias("tail"),
        T.owner_of("symbol_id").alias("owner"),
        T.tail_of(T.owner_of("symbol_id")).alias("owner_tail"),
    )


@register(
    "slugify",
    """SELECT doc_id, CASE WHEN s = '' THEN 'untitled' ELSE substr(s, 1, 60) END AS slug
       FROM (SELECT doc_id, trim(regexp_replace(lower(text), '[^a-z0-9]+', '_', 'g'), '_') AS s
             FROM {documents}) AS d""",
)
def slugify(src):
    return src.table("documents").select("doc_id", T.slugify("text").alias("slug"))


_PATH = """regexp_replace(url, '^https?://', '') ||
  CASE page_id % 4 WHEN 0 THEN '.py' WHEN 1 THEN '.pyx' WHEN 2 THEN '/__init__.py'
    ELSE '.spyx' END"""


@register(
    "module_name",
    f"""SELECT page_id, array_to_string(list_filter(string_split(bare, '/'),
            lambda p: p <> ''), '.') AS module,
          array_to_string(list_filter(string_split(regexp_replace(bare, '(^|/)__init__$', ''),
            '/'), lambda p: p <> ''), '.') AS package_module
        FROM (SELECT page_id, regexp_replace(path, '\\.(py|pyx|spyx)$', '') AS bare
              FROM (SELECT page_id, {_PATH} AS path FROM {{pages}}) AS p) AS b""",
)
def module_name(src):
    paths = src.sql(f"SELECT page_id, {_PATH} AS path FROM {{pages}}")
    return paths.select(
        "page_id",
        T.module_name("path").alias("module"),
        T.package_module_name("path", "root").alias("package_module"),
    )


LOCATION_SQL = """CASE WHEN file_path <> '' AND line IS NOT NULL
    THEN file_path || ':' || CAST(line AS VARCHAR)
  WHEN file_path <> '' THEN file_path
  WHEN source_type = 'pdf' AND page_start IS NOT NULL AND page_end IS NOT NULL
    THEN 'pp. ' || CAST(page_start AS VARCHAR) || '-' || CAST(page_end AS VARCHAR)
  WHEN source_type = 'pdf' AND page_start IS NOT NULL
    THEN 'p. ' || CAST(page_start AS VARCHAR)
  ELSE source END"""


@register("location_label", f"SELECT chunk_id, {LOCATION_SQL} AS location FROM {{v_chunks}}")
def location_label(src):
    return src.view("v_chunks").select("chunk_id", T.location_label().alias("location"))


_HINT = (
    "'[Output Truncated] ... Total length: ' || CAST(length(text) AS VARCHAR) || ' chars. "
    "Suggest querying specific properties like .degree() or .coefficient().'"
)


@register(
    "truncate_output",
    f"""SELECT doc_id, length(text) > 2000 AS truncated,
          CASE WHEN length(text) > 2000
            THEN substr(text, 1, 2000 - length({_HINT})) || {_HINT} ELSE text END AS shown
        FROM {{documents}}""",
)
def truncate_output(src):
    shown, cut = T.truncate_output("text")
    return src.table("documents").select(
        "doc_id", shown.alias("shown"), cut.alias("truncated")
    )


@register(
    "referenced_names",
    """SELECT doc_id, coalesce(string_agg(t, ' ' ORDER BY first), '') AS names
       FROM {documents} LEFT JOIN (SELECT doc_id, t, min(i) AS first FROM (
           SELECT doc_id, unnest(x) AS t, unnest(range(len(x))) AS i FROM (
             SELECT doc_id, regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*') AS x
             FROM {documents}) AS a) AS b
         GROUP BY doc_id, t) AS c USING (doc_id) GROUP BY doc_id""",
)
def referenced_names(src):
    return src.table("documents").select(
        "doc_id", F.array_join(T.referenced_names("text"), " ").alias("names")
    )


@register(
    "nonempty_lines",
    r"""SELECT page_id, len(ls) AS n, array_to_string(ls, chr(10)) AS lines,
          coalesce(trim(ls[1]), '') AS first_line
        FROM (SELECT page_id, list_filter(list_transform(
                string_split(replace(html, '.', '. ' || chr(10) || ' '), chr(10)),
                lambda x: rtrim(x)), lambda x: x <> '') AS ls FROM {pages}) AS p""",
)
def nonempty_lines(src):
    rows = src.table("pages").withColumn("html", F.expr("replace(html, '.', '. \n ')"))
    return rows.select(
        "page_id", T.nonempty_lines("html").alias("ls"), T.first_nonempty_line("html").alias("f")
    ).select(
        "page_id",
        F.size("ls").cast("bigint").alias("n"),
        F.array_join("ls", "\n").alias("lines"),
        F.col("f").alias("first_line"),
    )


_FENCED = """CASE doc_id % 3 WHEN 0 THEN concat('See: ```Python\n', text, '\n``` and ```b```')
  WHEN 1 THEN concat('```', text, '```') ELSE concat('  ', text) END"""


@register(
    "extract_fenced_block",
    f"""SELECT doc_id, CASE doc_id % 3 WHEN 2 THEN trim(t, ' ' || chr(10))
          ELSE trim(regexp_extract(t, '(?is)```(?:python|sage|sagemath)?\\s*(.*?)```', 1),
                    ' ' || chr(10)) END AS code
        FROM (SELECT doc_id, {_FENCED} AS t
              FROM {{documents}}) AS d""",
)
def extract_fenced_block(src):
    texts = src.sql(f"SELECT doc_id, {_FENCED} AS t FROM {{documents}}")
    return texts.select("doc_id", T.extract_fenced_block("t").alias("code"))
