"""Registered queries and the SQL they are checked against.

A view is one SQL text that Spark and the checking engine both run over the
given tables, so an operator and its check start from the same rows.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from granary.runtime import spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()

# {name} is a given table or another view.
VIEWS: dict[str, str] = {
    # Documents as chunks of three source types with all 16 chunk columns.
    "v_chunks": """
        SELECT doc_id AS chunk_id, text, source, source_type, page_start, page_end,
          CASE source_type WHEN 'generated' THEN concat('mod_', lang)
            WHEN 'pdf' THEN CASE WHEN doc_id % 5 = 0 THEN ''
              ELSE concat('Section ', CAST(doc_id % 12 AS STRING)) END
            ELSE concat('Topic ', CAST(doc_id % 9 AS STRING)) END AS section_title,
          CASE source_type WHEN 'generated'
              THEN concat(CASE WHEN doc_id % 20 = 0 THEN 'Mod_' ELSE 'mod_' END, lang, '.Cls', CAST(doc_id % 7 AS STRING), '.op_',
                          CAST(doc_id % 50 AS STRING))
            WHEN 'narrative' THEN concat('narrative:', CAST(doc_id AS STRING))
            ELSE '' END AS symbol_id,
          concat('mod_', lang) AS module,
          CASE WHEN source_type = 'generated' THEN concat('Cls', CAST(doc_id % 7 AS STRING),
            '.op_', CAST(doc_id % 50 AS STRING)) ELSE '' END AS qualname,
          CASE WHEN source_type = 'generated' AND doc_id % 3 <> 0
            THEN concat('op_', CAST(doc_id % 50 AS STRING), '(x, y)') ELSE '' END AS signature,
          CASE WHEN source_type = 'generated' THEN CASE WHEN doc_id % 3 = 0 THEN 'class'
            ELSE 'method' END WHEN source_type = 'narrative' THEN 'narrative'
            ELSE '' END AS kind,
          CASE WHEN source_type = 'generated' THEN concat('lib/', lang, '/', source, '.py')
            ELSE '' END AS file_path,
          CASE WHEN source_type = 'generated' AND doc_id % 5 <> 1
            THEN CAST(doc_id % 997 AS INT) END AS line,
          CASE WHEN source_type = 'generated' AND doc_id % 2 = 0
            THEN concat('The ', lang, ' helper of ', source) ELSE '' END AS summary,
          CAST(doc_id % 4 AS INT) AS example_count
        FROM (SELECT doc_id, text, lang, source,
            CASE WHEN doc_id % 4 IN (0, 1) THEN 'generated' WHEN doc_id % 4 = 2 THEN 'pdf'
              ELSE 'narrative' END AS source_type,
            CASE WHEN doc_id % 4 = 2 AND doc_id % 16 <> 2 THEN CAST(doc_id % 90 AS INT) END
              AS page_start,
            CASE WHEN doc_id % 4 = 2 AND doc_id % 16 <> 2 AND doc_id % 16 <> 6
              THEN CAST(doc_id % 90 + 1 AS INT) END AS page_end
          FROM {documents}) AS d""",
    "v_queries": "SELECT item_id AS query_id, text FROM {benchmark}",
    "v_questions": """
        SELECT conv_id * 100 + turn AS question_id, text FROM {conversations}
        WHERE role = 'user'""",
    "v_vectors": "SELECT vec_id AS chunk_id, embedding FROM {embeddings}",
    # Query vectors: the mean direction of each label.
    "v_query_vectors": """
        SELECT query_id, array_agg(x ORDER BY pos) AS embedding FROM (
          SELECT query_id, pos, m / sqrt(sum(m * m) OVER (PARTITION BY query_id)) AS x FROM (
            SELECT CAST(label AS BIGINT) AS query_id, pos, avg(CAST(x AS DOUBLE)) AS m
            FROM {v_vector_cells} GROUP BY label, pos) AS c) AS u
        GROUP BY query_id""",
    # Symbols with duplicate ids; the lowest seq is first.
    "v_symbols": """
        SELECT p_partkey AS seq, replace(p_brand, '#', '_') AS module,
          CASE WHEN p_size % 3 = 0 THEN replace(p_name, ' ', '_')
            ELSE concat(p_type, '.', replace(p_name, ' ', '_')) END AS qualname,
          concat(replace(p_brand, '#', '_'), '.',
            CASE WHEN p_size % 3 = 0 THEN replace(p_name, ' ', '_')
              ELSE concat(p_type, '.', replace(p_name, ' ', '_')) END) AS symbol_id,
          CASE WHEN p_size % 3 = 0 THEN 'function' ELSE 'method' END AS kind,
          p_size AS line
        FROM {part}""",
    # A small keyword registry whose words occur in the prose.
    "v_families": """
        SELECT family_no, id, name, '' AS summary, split(words, ',') AS keywords
        FROM (VALUES (0, 'A', 'English', 'the,of the,that'), (1, 'B', 'French', 'une,de la,pour'),
          (2, 'C', 'German', 'nicht,in der,sich')) AS t(family_no, id, name, words)""",
    # Workflows made of the nations; their words occur in the prose.
    "v_workflows": """
        SELECT CAST(n_nationkey AS INT) AS workflow_no,
          concat('w', CAST(n_nationkey AS STRING)) AS id,
          CASE n_regionkey % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'C' END AS family_id,
          concat('On ', lower(n_name)) AS title, '' AS summary,
          split(CASE n_nationkey % 5 WHEN 0 THEN 'and that,of the that' WHEN 1 THEN 'une,de la'
            WHEN 2 THEN 'nicht,in der die' WHEN 3 THEN 'compute that,pour'
            ELSE 'sich und,for the' END, ',') AS keywords,
          split(concat('op_', CAST(n_nationkey AS STRING), ',Cls',
            CAST(n_nationkey % 7 AS STRING), '.op_', CAST(n_nationkey + 7 AS STRING),
            ',mod_en.Cls1.op_', CAST(n_nationkey * 2 AS STRING)), ',') AS preferred_symbols,
          split(concat('Rule of ', n_name), ',') AS prompt_rules,
          split('order,degree', ',') AS tuning_params
        FROM {nation}""",
    # Result lists of 20 chunks, each with a question made of its shortest text.
    "v_results": """
        SELECT question_id, chunk_id, score,
          row_number() OVER (PARTITION BY question_id ORDER BY score DESC, chunk_id) AS rank
        FROM (SELECT CAST(floor(chunk_id / 20) AS BIGINT) AS question_id, chunk_id,
            CAST((chunk_id * 37) % 101 AS DOUBLE) / 64 AS score FROM {v_chunks}) AS s""",
    "v_asks": """
        SELECT question_id, concat(CASE question_id % 4 WHEN 0 THEN 'Find the helper class op_'
            WHEN 1 THEN 'Which method is op_' WHEN 2 THEN 'Class and method of cls op_'
            ELSE 'What does mod op_' END, CAST((question_id * 20) % 50 AS STRING), ' series ',
            text) AS text,
          split(CASE question_id % 5 WHEN 0 THEN '' WHEN 1 THEN concat('none,Op_',
              CAST(question_id % 50 AS STRING), ',x.op_21') WHEN 2 THEN 'Cls1.op_1,op_5,en'
            WHEN 3 THEN 'a.OP_7,s2.op_9' ELSE 'mod_en.Cls4.op_4,op_2,op_3' END, ',') AS preferred,
          concat('w', CAST(question_id % 27 AS STRING)) AS workflow_id
        FROM (SELECT CAST(floor(doc_id / 20) AS BIGINT) AS question_id,
            min_by(text, n_chars * 100000000 + doc_id) AS text
          FROM {documents} GROUP BY floor(doc_id / 20)) AS q""",
    # Question texts with routing phrases worked in.
    "v_asked": """
        SELECT conv_id * 100 + turn AS question_id,
          CASE conv_id % 8 WHEN 0 THEN concat('Which category covers ', text)
            WHEN 1 THEN concat('At a high level, ', text)
            WHEN 2 THEN concat('At a high level, how do I compute ', text)
            WHEN 3 THEN concat('Prove this theorem: ', text)
            WHEN 4 THEN concat('Use A.gen and B.mul and then compare with the user guide. ', text)
            ELSE text END AS text
        FROM {conversations} WHERE role = 'user'""",
}

# Same rows, spelled per engine where array functions differ.
SPARK_ONLY = {
    "v_vector_cells": """
        SELECT vec_id, label, pos, x FROM {embeddings}
        LATERAL VIEW posexplode(embedding) e AS pos, x""",
}
CHECK_ONLY = {
    "v_vector_cells": """
        SELECT vec_id, label, unnest(generate_series(0, len(embedding) - 1)) AS pos,
          unnest(embedding) AS x FROM {embeddings}""",
}
SPARK_SQL = {
    "v_query_vectors": VIEWS["v_query_vectors"].replace(
        "array_agg(x ORDER BY pos)",
        "transform(array_sort(collect_list(struct(pos, x))), e -> e.x)",
    )
}

_schemas: dict[str, object] = {}


class Source:
    """Tables and views of one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def table(self, name: str) -> DataFrame:
        path = f"{self.folder}/{name}.parquet"
        if path not in _schemas:
            _schemas[path] = self.spark.read.parquet(path).schema
        df = self.spark.read.schema(_schemas[path]).parquet(path)
        # One small file is one task; the text functions are worth more.
        return spread(df, "doc_id") if name == "documents" else df

    def view(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.table(name)
        text = SPARK_SQL.get(name) or SPARK_ONLY.get(name) or VIEWS[name]
        return self.sql(text)

    def sql(self, text: str) -> DataFrame:
        names = set(re.findall(r"\{(\w+)\}", text))
        return self.spark.sql(text, **{name: self.view(name) for name in names})


def check_sql(text: str) -> str:
    """SQL with the views it names as common table expressions."""
    ordered: list[str] = []

    def need(part: str) -> None:
        for name in re.findall(r"\{(\w+)\}", part):
            if name not in TABLES and name not in ordered:
                need(CHECK_ONLY.get(name) or VIEWS[name])
                ordered.append(name)

    def plain(part: str) -> str:
        return re.sub(r"\{(\w+)\}", r"\1", part).strip()

    need(text)
    # A view that several others read is computed once.
    everything = " ".join([text, *[CHECK_ONLY.get(n) or VIEWS[n] for n in ordered]])
    once = {n for n in ordered if everything.count("{" + n + "}") > 1}
    heads = [
        f"{n} AS {'MATERIALIZED ' if n in once else ''}({plain(CHECK_ONLY.get(n) or VIEWS[n])})"
        for n in ordered
    ]
    body = plain(text)
    if not heads:
        return body
    if re.match(r"(?i)with\s+recursive\s", body):
        return "WITH RECURSIVE " + ", ".join(heads) + ", " + body[len("with recursive ") :]
    if re.match(r"(?i)with\s", body):
        return "WITH " + ", ".join(heads) + ", " + body[len("with ") :]
    return "WITH " + ", ".join(heads) + " " + body


def register(name: str, sql: str | None = None):
    """Register a query; ``sql`` is its check, if the engine can express it."""

    def wrap(build: Callable[[Source], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query registered twice: {name}")
        QUERIES[name] = lambda spark, folder: build(Source(spark, folder))
        if sql is not None:
            CHECKS[name] = sql
        return build

    return wrap
