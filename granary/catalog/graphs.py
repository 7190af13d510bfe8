"""Queries over the symbol graph, references, imports and expansion."""

from __future__ import annotations

from pyspark.sql import functions as F

from granary import vocab
from granary.catalog.base import CHECK_ONLY, VIEWS, register
from granary.catalog.search import long
from granary.catalog.texts import sql_list
from granary.functions import text as T
from granary.operators import graph as G
from granary.operators.context import chunk_results

# ---- nodes --------------------------------------------------------------------------

CHECK_ONLY["v_entries"] = """
    SELECT *, CASE WHEN contains(qualname, '.') THEN substr(qualname, 1,
        length(qualname) - length(split_part(qualname, '.', -1)) - 1) ELSE '' END AS owner,
      split_part(qualname, '.', -1) AS tail, lower(symbol_id) AS key
    FROM (SELECT chunk_id AS seq, symbol_id, qualname, module, kind,
        row_number() OVER (PARTITION BY symbol_id ORDER BY chunk_id) AS n
      FROM {v_chunks} WHERE source_type = 'generated') AS s WHERE n = 1"""
CHECK_ONLY["v_nodes"] = """
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS last
      FROM {v_entries}) AS e WHERE last = 1"""
# References of every form: full ids, names, tails, cut names, unknown ones.
VIEWS["v_refs"] = """
    SELECT DISTINCT CASE chunk_id % 6 WHEN 0 THEN symbol_id WHEN 1 THEN qualname
        WHEN 2 THEN upper(concat('op_', CAST(chunk_id % 50 AS STRING)))
        WHEN 3 THEN concat('s', CAST(chunk_id % 7 AS STRING), '.op_', CAST(chunk_id % 50 AS STRING))
        WHEN 4 THEN concat(' ', module, '.', qualname, ' ')
        ELSE concat('op ', CAST(chunk_id % 50 AS STRING)) END AS ref
    FROM {v_chunks}"""
_MATCHES = """
    SELECT ref, key, min(CASE WHEN key = lower(trim(ref)) THEN 0
        WHEN lower(qualname) = lower(trim(ref)) THEN 1 ELSE 2 END) AS priority
    FROM {refs} CROSS JOIN {{v_nodes}} WHERE trim(ref) <> '' AND (key = lower(trim(ref))
      OR lower(qualname) = lower(trim(ref))
      OR (contains(ref, '.') AND ends_with(lower(qualname), lower(trim(ref))))
      OR (NOT contains(ref, '.') AND (lower(tail) = lower(trim(ref))
        OR ends_with(lower(qualname), '.' || lower(trim(ref)))))) GROUP BY ref, key"""


def entries(src):
    return G.symbol_entries(G.chunk_symbols(src.view("v_chunks")))


def nodes(src):
    return G.symbol_nodes(entries(src))


@register(
    "symbol_nodes", "SELECT key, symbol_id, qualname, module, kind, owner, tail FROM {v_nodes}"
)
def symbol_nodes(src):
    return nodes(src)


@register(
    "group_symbols",
    """SELECT 'module' AS group_kind, module AS group_key, key AS symbol FROM {v_entries}
       UNION ALL SELECT 'owner', owner, key FROM {v_entries} WHERE owner <> ''
       UNION ALL SELECT 'tail', lower(tail), key FROM {v_entries}
       UNION ALL SELECT 'method', split_part(owner, '.', -1), key FROM {v_entries}
         WHERE kind = 'method' AND owner <> ''""",
)
def group_symbols(src):
    return G.group_symbols(entries(src))


@register(
    "resolve_refs",
    f"""SELECT ref, key, priority FROM ({_MATCHES.format(refs="{v_refs}").replace("{{", "{").replace("}}", "}")}) AS m""",
)
def resolve_refs(src):
    return G.resolve_refs(src.view("v_refs"), nodes(src))


@register(
    "resolve_ref_classes",
    f"""WITH m AS ({_MATCHES.format(refs="{v_refs}").replace("{{", "{").replace("}}", "}")})
       SELECT 'asked' AS part, ref AS name, lower(trim(ref)) AS value, -1 AS priority FROM {{v_refs}}
       WHERE trim(ref) <> ''
       UNION ALL SELECT 'member', lower(trim(ref)), key, min(priority) FROM m GROUP BY 2, 3""",
)
def resolve_ref_classes(src):
    """References by the text they spell, and the symbols of every text once."""
    asked, members = G.ref_classes(src.view("v_refs"), nodes(src))
    return asked.select(
        F.lit("asked").alias("part"), F.col("ref").alias("name"), F.col("text").alias("value"),
        F.lit(-1).alias("priority"),
    ).unionByName(
        members.select(
            F.lit("member").alias("part"), F.col("text").alias("name"), F.col("key").alias("value"), "priority"
        )
    )


CHECK_ONLY["v_index"] = """
    SELECT text, arg_max(symbol_id, seq * 2 + nth) AS symbol_id FROM (
      SELECT seq, 0 AS nth, lower(symbol_id) AS text, symbol_id FROM {v_records}
      UNION ALL SELECT seq, 1, lower(qualname), symbol_id FROM {v_records} WHERE qualname <> '')
      AS i GROUP BY text"""
# Symbol records some of which have an id that ends unlike their name.
VIEWS["v_records"] = """
    SELECT p_partkey AS seq, CASE WHEN p_partkey % 5 = 0
        THEN concat(module, '.', replace(qualname, '_', 'X')) ELSE symbol_id END AS symbol_id,
      CASE WHEN p_partkey % 7 = 0 THEN '' ELSE qualname END AS qualname, module, kind
    FROM {v_symbols} JOIN {part} ON seq = p_partkey"""
VIEWS["v_section_refs"] = """
    SELECT CAST(p_partkey % 97 AS BIGINT) AS section_id, p_partkey AS pos,
      CASE p_partkey % 6 WHEN 0 THEN symbol_id WHEN 1 THEN upper(qualname)
        WHEN 2 THEN concat('x.', replace(p_name, ' ', '_'), '()')
        WHEN 3 THEN replace(p_name, ' ', 'X') WHEN 4 THEN concat('no.', p_name)
        ELSE concat('q.', replace(p_name, ' ', 'x')) END AS ref
    FROM {v_symbols} JOIN {part} ON seq = p_partkey"""


@register(
    "resolve_refs_tiered",
    """WITH r AS (SELECT section_id, pos, lower(regexp_replace(trim(ref), '\\(\\)$', '')) AS whole
           FROM {v_section_refs}),
         t AS (SELECT DISTINCT lower(split_part(CASE WHEN qualname = '' THEN symbol_id
             ELSE qualname END, '.', -1)) AS tail, symbol_id FROM {v_records}),
         a AS (SELECT section_id, pos, symbol_id FROM r JOIN {v_index} AS i ON i.text = r.whole),
         m AS (SELECT *, split_part(whole, '.', -1) AS tail FROM r
           WHERE whole NOT IN (SELECT text FROM {v_index})),
         b AS (SELECT section_id, pos, symbol_id FROM m JOIN t ON t.tail = m.tail),
         c AS (SELECT section_id, pos, symbol_id FROM m JOIN {v_index} AS i
             ON ends_with(i.text, '.' || m.whole) OR ends_with(i.text, '.' || m.tail)
           WHERE m.tail NOT IN (SELECT tail FROM t))
       SELECT section_id, symbol_id, min(pos) AS pos FROM (
         SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c) AS u
       GROUP BY section_id, symbol_id""",
)
def resolve_refs_tiered(src):
    return G.resolve_refs_tiered(src.view("v_section_refs"), src.view("v_records"))


CHECK_ONLY["v_wanted"] = """
    SELECT DISTINCT unnest(preferred_symbols) AS ref FROM {v_workflows}"""
CHECK_ONLY["v_seeds"] = f"""
    SELECT DISTINCT w.id AS workflow_id, key FROM (SELECT id, unnest(preferred_symbols) AS ref
      FROM {{v_workflows}}) AS w
      JOIN ({_MATCHES.format(refs="{v_wanted}").replace("{{", "{").replace("}}", "}")}) AS m
      ON m.ref = w.ref"""


@register(
    "workflow_seeds",
    """SELECT workflow_id, key, len(ids) AS workflows FROM {v_seeds} JOIN (
         SELECT key, list(workflow_id) AS ids FROM {v_seeds} GROUP BY key) AS k USING (key)""",
)
def workflow_seeds(src):
    seeds = G.workflow_seeds(src.view("v_workflows"), nodes(src))
    counted = G.workflow_ids(seeds).select(
        "key", F.size("ids").cast("bigint").alias("workflows")
    )
    return seeds.join(counted, "key")


# Narrative chunks refer to the symbols of neighbouring chunks, and to others.
VIEWS["v_narratives"] = """
    SELECT symbol_id AS section_id, module, section_title,
      split(concat(upper(module), '.Cls', CAST((chunk_id + 1) % 7 AS STRING), '.op_',
        CAST((chunk_id + 1) % 50 AS STRING), ',', module, '.cls', CAST((chunk_id + 2) % 7 AS STRING),
        '.op_', CAST((chunk_id + 2) % 50 AS STRING), ',unknown.ref'), ',') AS resolved_symbol_ids
    FROM {v_chunks} WHERE source_type = 'narrative'"""
CHECK_ONLY["v_edges"] = """
    SELECT DISTINCT section_id, key FROM (SELECT section_id,
        lower(trim(unnest(resolved_symbol_ids))) AS key FROM {v_narratives}) AS r
    WHERE key IN (SELECT key FROM {v_nodes})"""


@register(
    "narrative_edges",
    """SELECT 'refers' AS edge_type, section_id AS src, key AS dst FROM {v_edges}
       UNION ALL SELECT 'referred_by', key, section_id FROM {v_edges}
       UNION ALL SELECT DISTINCT 'module', module, section_id FROM {v_narratives}""",
)
def narrative_edges(src):
    return G.narrative_edges(src.view("v_narratives"), nodes(src))


# ---- expansion ---------------------------------------------------------------------

CHECK_ONLY["v_graph_tokens"] = f"""
    SELECT DISTINCT question_id, t FROM (SELECT question_id,
        unnest(regexp_extract_all(lower(text), '[A-Za-z_][A-Za-z0-9_]*')) AS t FROM {{v_asks}}) AS a
    WHERE length(t) > 1 AND t NOT IN ({sql_list(vocab.GRAPH_STOPWORDS)})"""
CHECK_ONLY["v_names"] = """
    SELECT key, owner, module, tail, lower(concat_ws(' ', nullif(qualname, ''), nullif(module, ''),
      nullif(owner, ''), nullif(tail, ''))) AS names FROM {v_nodes}"""
CHECK_ONLY["v_affinity"] = """
    SELECT q.question_id, n.key, count(t) FILTER (WHERE contains(names, t)) AS affinity
    FROM {v_names} AS n CROSS JOIN {v_asks} AS q LEFT JOIN {v_graph_tokens} AS k
      ON k.question_id = q.question_id GROUP BY q.question_id, n.key"""


@register(
    "query_affinity",
    """SELECT DISTINCT question_id, key, affinity FROM {v_mapped} JOIN {v_affinity}
         USING (question_id, key)""",
)
def query_affinity(src):
    pairs = mapped_results(src).select("question_id", "key").distinct()
    rows = pairs.join(nodes(src), "key").join(ask_tokens(src), "question_id")
    scored = rows.withColumn("affinity", G.query_affinity(F.col("tokens")).cast("bigint"))
    return scored.select("question_id", "key", "affinity")


def ask_tokens(src):
    return src.view("v_asks").select(
        "question_id", T.query_tokens("text", vocab.GRAPH_STOPWORDS).alias("tokens")
    )


def mapped_results(src):
    return G.result_symbols(chunk_results(src.view("v_results"), src.view("v_chunks")), nodes(src))


CHECK_ONLY["v_owned"] = """
    SELECT DISTINCT 'owner' AS group_kind, owner AS group_key, key FROM {v_entries} WHERE owner <> ''
    UNION ALL SELECT DISTINCT 'module', module, key FROM {v_entries} WHERE module <> ''"""
CHECK_ONLY["v_related"] = """
    SELECT question_id, group_kind, group_key, key, row_number() OVER (
        PARTITION BY question_id, group_kind, group_key
        ORDER BY affinity DESC, lower(tail) DESC, key) AS nth
    FROM {v_owned} JOIN {v_affinity} USING (key) JOIN (SELECT key, tail FROM {v_nodes}) AS n
      USING (key)"""


@register(
    "best_related",
    """SELECT question_id, group_kind, group_key, key, nth FROM {v_related} WHERE nth <= 6
         AND (question_id, group_kind, group_key) IN (
           SELECT question_id, 'owner', owner FROM {v_mapped} JOIN {v_nodes} USING (key)
           UNION ALL SELECT question_id, 'module', module FROM {v_mapped} JOIN {v_nodes}
             USING (key))""",
)
def best_related(src):
    graph = graph_of(src)
    homes = mapped_results(src).select("question_id", "key").join(graph.nodes, "key")
    groups = T.row_array(
        ("group_kind", "group_key"),
        (F.lit("owner"), F.col("owner")),
        (F.lit("module"), F.col("module")),
    )
    asked = homes.select("question_id", F.inline(groups)).join(ask_tokens(src), "question_id")
    return long(G.best_related(asked, graph, 6), "nth")


def graph_of(src):
    return G.symbol_graph(src.view("v_chunks"), src.view("v_workflows"), src.view("v_narratives"))


CHECK_ONLY["v_resolved_names"] = f"""
    SELECT ref, arg_min(key, key) FILTER (WHERE priority = least_priority) AS key FROM (
      SELECT *, min(priority) OVER (PARTITION BY ref) AS least_priority FROM (
        {_MATCHES.format(refs="{v_all_names}").replace("{{", "{").replace("}}", "}")}) AS m) AS p
    GROUP BY ref"""
CHECK_ONLY["v_all_names"] = """
    SELECT DISTINCT qualname AS ref FROM {v_chunks} WHERE qualname <> ''"""
CHECK_ONLY["v_mapped"] = """
    SELECT r.question_id, r.chunk_id, r.rank, r.score, coalesce(n.key, m.key) AS key
    FROM {v_results} AS r JOIN {v_chunks} AS c ON c.chunk_id = r.chunk_id
      LEFT JOIN {v_nodes} AS n ON c.symbol_id <> '' AND n.key = lower(trim(c.symbol_id))
      LEFT JOIN {v_resolved_names} AS m ON n.key IS NULL AND m.ref = c.qualname
    WHERE coalesce(n.key, m.key) IS NOT NULL"""
CHECK_ONLY["v_preferred_seeds"] = f"""
    SELECT question_id, key FROM {{v_asks}} JOIN {{v_seeds}} USING (workflow_id)
    UNION ALL
    SELECT question_id, key FROM (SELECT question_id, unnest(preferred) AS ref FROM {{v_asks}}
        WHERE workflow_id NOT IN (SELECT workflow_id FROM {{v_seeds}})) AS u
      JOIN ({_MATCHES.format(refs="{v_ask_refs}").replace("{{", "{").replace("}}", "}")}) AS m
      ON m.ref = u.ref"""
CHECK_ONLY["v_ask_refs"] = "SELECT DISTINCT unnest(preferred) AS ref FROM {v_asks}"
CHECK_ONLY["v_retrieved_seeds"] = """
    SELECT question_id, key FROM (SELECT question_id, key, row_number() OVER (
        PARTITION BY question_id ORDER BY rank) AS n FROM {v_mapped}) AS m WHERE n <= 4"""
CHECK_ONLY["v_owner_refs"] = "SELECT DISTINCT owner AS ref FROM {v_nodes} WHERE owner <> ''"


def _near(seeds: str, kind: str, limit: int, value: float) -> str:
    return f"""SELECT s.question_id, r.key, {value}::DOUBLE AS value FROM {{{seeds}}} AS s
      JOIN {{v_nodes}} AS n ON n.key = s.key JOIN {{v_related}} AS r
        ON r.question_id = s.question_id AND r.group_kind = '{kind}' AND r.group_key = n.{kind}
      WHERE r.nth <= {limit} AND r.key <> s.key"""


CHECK_ONLY["v_gains"] = " UNION ALL ".join(
    [
        "SELECT question_id, key, 3.0::DOUBLE AS value FROM {v_preferred_seeds}",
        _near("v_preferred_seeds", "owner", 6, 1.8),
        f"""SELECT s.question_id, m.key, 1.2::DOUBLE AS value FROM {{v_preferred_seeds}} AS s
          JOIN {{v_nodes}} AS n ON n.key = s.key
          JOIN ({_MATCHES.format(refs="{v_owner_refs}").replace("{{", "{").replace("}}", "}")}) AS m
            ON m.ref = n.owner WHERE m.key <> s.key""",
        _near("v_preferred_seeds", "module", 5, 1.0),
        "SELECT question_id, key, 0.5::DOUBLE AS value FROM {v_retrieved_seeds}",
        _near("v_retrieved_seeds", "owner", 4, 0.8),
        _near("v_retrieved_seeds", "module", 3, 0.35),
    ]
)
CHECK_ONLY["v_scored"] = """
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id
        ORDER BY value DESC, affinity DESC, key) AS nth FROM (
        SELECT g.question_id, g.key, a.affinity,
          round(sum(g.value) + 0.15::DOUBLE * a.affinity, 9) AS value
        FROM {v_gains} AS g JOIN {v_affinity} AS a
          ON a.question_id = g.question_id AND a.key = g.key
        GROUP BY g.question_id, g.key, a.affinity) AS s) AS r WHERE nth <= 18"""
CHECK_ONLY["v_places"] = """
    SELECT n.key, coalesce(i.chunk_id, q.chunk_id) AS chunk_id FROM {v_nodes} AS n
      LEFT JOIN (SELECT lower(symbol_id) AS k, max(chunk_id) AS chunk_id FROM {v_chunks}
        WHERE source_type = 'generated' AND symbol_id <> '' GROUP BY 1) AS i ON i.k = n.key
      LEFT JOIN (SELECT lower(qualname) AS k, max(chunk_id) AS chunk_id FROM {v_chunks}
        WHERE source_type = 'generated' AND qualname <> '' GROUP BY 1) AS q
        ON q.k = lower(n.qualname)"""
CHECK_ONLY["v_lifted"] = """
    SELECT question_id, section_id, value FROM (SELECT *, row_number() OVER (
        PARTITION BY question_id ORDER BY value DESC, section_id) AS nth FROM (
        SELECT question_id, section_id, round(sum(value), 9) AS value FROM (
          SELECT question_id, key, value * 0.4::DOUBLE AS value FROM {v_scored} WHERE nth <= 10
          UNION ALL SELECT question_id, key, score * 0.3::DOUBLE FROM {v_mapped} WHERE rank <= 4)
          AS u JOIN {v_edges} USING (key) GROUP BY question_id, section_id) AS s) AS n
    WHERE nth <= 4"""


@register(
    "graph_expand",
    """WITH parts AS (
         SELECT question_id, chunk_id, score AS value FROM {v_results}
         UNION ALL SELECT question_id, chunk_id, value FROM {v_scored} JOIN {v_places} USING (key)
         UNION ALL SELECT l.question_id, c.chunk_id, l.value FROM {v_lifted} AS l JOIN (
           SELECT symbol_id, max(chunk_id) AS chunk_id FROM {v_chunks}
           WHERE source_type = 'narrative' GROUP BY symbol_id) AS c ON c.symbol_id = l.section_id
         UNION ALL SELECT r.question_id, p.chunk_id, r.score * 0.3::DOUBLE FROM {v_results} AS r
           JOIN {v_chunks} AS c ON c.chunk_id = r.chunk_id AND c.source_type = 'narrative'
           JOIN {v_edges} AS e ON e.section_id = c.symbol_id JOIN {v_places} AS p ON p.key = e.key),
       sums AS (SELECT question_id, chunk_id, round(sum(value), 9) AS score FROM parts
         GROUP BY question_id, chunk_id)
       SELECT question_id, s.chunk_id, round(score, 6) AS score, row_number() OVER (
         PARTITION BY question_id ORDER BY score DESC,
           CASE WHEN source_type = 'generated' THEN 0 ELSE 1 END, s.chunk_id) AS rank
       FROM sums AS s JOIN {v_chunks} AS c ON c.chunk_id = s.chunk_id""",
)
def graph_expand(src):
    asks = src.view("v_asks").withColumnRenamed("preferred", "preferred_symbols")
    grown = G.graph_expand(asks, src.view("v_results"), src.view("v_chunks"), graph_of(src))
    return long(grown.withColumn("score", F.round("score", 6)), "rank")


@register(
    "read_graph",
    """SELECT 'node' AS part, key AS a, symbol_id AS b FROM {v_nodes}
       UNION ALL SELECT 'seed', workflow_id, key FROM {v_seeds}
       UNION ALL SELECT 'entry', key, symbol_id FROM {v_entries}
       UNION ALL SELECT 'edge', section_id, key FROM {v_edges}""",
)
def read_graph(src):
    from granary.runtime import scratch_path
    from granary.sources import tables

    path = scratch_path(src.spark, "graph")
    made = graph_of(src)

    def stray(rows):
        """Rows of symbols that no node has, which reading drops."""
        return rows.unionByName(rows.withColumn("key", F.concat(F.lit("gone:"), "key")))

    tables.write_graph(path, G.SymbolGraph(stray(made.entries), made.nodes, stray(made.seeds), made.edges))
    graph = tables.read_graph(src.spark, path)
    kept = [
        graph.nodes.select(F.lit("node").alias("part"), F.col("key").alias("a"), F.col("symbol_id").alias("b")),
        graph.seeds.select(F.lit("seed").alias("part"), F.col("workflow_id").alias("a"), F.col("key").alias("b")),
        graph.entries.select(F.lit("entry").alias("part"), F.col("key").alias("a"), F.col("symbol_id").alias("b")),
        graph.edges.filter("edge_type = 'refers'").select(
            F.lit("edge").alias("part"), F.col("src").alias("a"), F.col("dst").alias("b")
        ),
    ]
    return kept[0].unionByName(kept[1]).unionByName(kept[2]).unionByName(kept[3])


# ---- preconditions and imports --------------------------------------------------------

IMPORTS = {
    "Cls1": "from pack import Cls1",
    "Cls2": "from pack import Cls2",
    "the": "from pack import the",
    "de": "from pack.fr import de",
    "und": "from pack.de import und",
    "of": "from pack import the",
}
CHECK_ONLY["v_imports"] = "SELECT * FROM (VALUES {}) AS t(name, statement)".format(
    ", ".join(f"('{k}', '{v}')" for k, v in IMPORTS.items())
)
CHECK_ONLY["v_pre"] = """
    SELECT chunk_id AS seq, symbol_id, qualname, module, kind, split_part(qualname, '.', -1) AS tail,
      CASE WHEN kind = 'method' THEN split_part(qualname, '.', 1) ELSE '' END AS owner_class
    FROM {v_chunks} WHERE source_type = 'generated'"""


def pre_entries(src):
    return G.precondition_entries(G.chunk_symbols(src.view("v_chunks")), IMPORTS)


@register(
    "precondition_nodes",
    """SELECT first_seq, symbol_id, qualname, module, kind, owner_class,
         CASE WHEN kind = 'method' THEN owner_class ELSE '' END AS owner_qualname, tail,
         coalesce(statement, '') AS import_statement
       FROM (SELECT *, min(seq) OVER (PARTITION BY symbol_id) AS first_seq,
           row_number() OVER (PARTITION BY symbol_id ORDER BY seq DESC) AS n FROM {v_pre}) AS p
         LEFT JOIN {v_imports} AS i ON i.name = split_part(qualname, '.', 1) WHERE n = 1""",
)
def precondition_nodes(src):
    return G.precondition_nodes(pre_entries(src))


def tails(src):
    return src.sql(
        "SELECT DISTINCT concat('op_', CAST(chunk_id % 60 AS STRING)) AS name FROM {v_chunks}"
    )


@register(
    "lookup_by_tail",
    """SELECT concat(' ', tail) AS name, seq, symbol_id FROM {v_pre}""",
)
def lookup_by_tail(src):
    names = tails(src).select(F.concat(F.lit(" "), F.col("name")).alias("name"))
    return G.lookup_by_tail(names, pre_entries(src))


@register(
    "class_node",
    """WITH n AS (SELECT *, row_number() OVER (PARTITION BY symbol_id ORDER BY seq DESC) AS last,
           min(seq) OVER (PARTITION BY symbol_id) AS first_seq FROM {v_pre})
       SELECT name, arg_min(symbol_id, first_seq) AS symbol_id FROM (
         SELECT DISTINCT CASE seq % 2 WHEN 0 THEN qualname ELSE tail END AS name FROM {v_pre}) AS k
       JOIN n ON last = 1 AND kind = 'class'
         AND (qualname = name OR ends_with(qualname, '.' || name)) GROUP BY name""",
)
def class_node(src):
    names = pre_entries(src).select(
        F.when(F.col("seq") % 2 == 0, F.col("qualname")).otherwise(F.col("tail")).alias("name")
    )
    return G.class_node(names, G.precondition_nodes(pre_entries(src)))


@register(
    "methods_of",
    "SELECT owner_class AS name, seq, symbol_id FROM {v_pre} WHERE kind = 'method'",
)
def methods_of(src):
    names = src.sql(
        "SELECT DISTINCT concat('Cls', CAST(chunk_id % 9 AS STRING)) AS name FROM {v_chunks}"
    )
    return G.methods_of(names, pre_entries(src))


@register(
    "read_precondition_graph",
    """WITH n AS (SELECT *, row_number() OVER (PARTITION BY symbol_id ORDER BY seq DESC) AS last,
           min(seq) OVER (PARTITION BY symbol_id) AS first_seq FROM {v_pre})
       SELECT 'node' AS part, symbol_id AS name, first_seq AS seq, qualname || '|' || module || '|'
           || kind || '|' || owner_class || '|' || tail || '|' || coalesce(statement, '') AS value
         FROM n LEFT JOIN {v_imports} AS i ON i.name = split_part(qualname, '.', 1) WHERE last = 1
       UNION ALL SELECT 'tail', ' ' || tail, seq, symbol_id FROM {v_pre}
       UNION ALL SELECT 'method', owner_class, seq, symbol_id FROM {v_pre} WHERE kind = 'method'
       UNION ALL SELECT 'class', name, -1, arg_min(symbol_id, first_seq) FROM (
         SELECT DISTINCT CASE seq % 2 WHEN 0 THEN qualname ELSE tail END AS name FROM {v_pre}) AS k
       JOIN n ON last = 1 AND kind = 'class'
         AND (qualname = k.name OR ends_with(qualname, '.' || k.name)) GROUP BY 2""",
)
def read_precondition_graph(src):
    """The stored graph: its nodes, and what its three lookups give."""
    from granary.runtime import scratch_path
    from granary.sources import tables

    path = scratch_path(src.spark, "preconditions")
    tables.write_precondition_graph(path, pre_entries(src), "symbols.jsonl")
    graph = tables.read_precondition_graph(src.spark, path)
    fields = ("qualname", "module", "kind", "owner_class", "tail", "import_statement")
    classes = graph.class_node(
        graph.tails.join(graph.nodes.select("symbol_id", "qualname"), "symbol_id").select(
            F.when(F.col("seq") % 2 == 0, F.col("qualname")).otherwise(F.col("tail")).alias("name")
        )
    )
    owners = src.sql(
        "SELECT DISTINCT concat('Cls', CAST(chunk_id % 9 AS STRING)) AS name FROM {v_chunks}"
    )
    ends = tails(src).select(F.concat(F.lit(" "), F.col("name")).alias("name"))
    parts = {
        "node": graph.nodes.select(
            F.col("symbol_id").alias("name"), F.col("first_seq").alias("seq"), F.concat_ws("|", *fields).alias("value")
        ),
        "tail": graph.lookup_by_tail(ends).withColumnRenamed("symbol_id", "value"),
        "method": graph.methods_of(owners).withColumnRenamed("symbol_id", "value"),
        "class": classes.select("name", F.lit(-1).cast("long").alias("seq"), F.col("symbol_id").alias("value")),
    }
    rows = [df.select(F.lit(part).alias("part"), "name", "seq", "value") for part, df in parts.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(rows[3])


# Texts that import one of the names in some documents.
VIEWS["v_code"] = """
    SELECT doc_id AS text_id, concat(CASE doc_id % 3 WHEN 0 THEN concat('from pack import the',
        chr(10)) WHEN 1 THEN concat('import de, pack', chr(10)) ELSE '' END,
      replace(text, ' la ', concat(chr(10), 'def la(x): '))) AS text
    FROM {documents}"""


@register(
    "imports_for_names",
    """SELECT text_id, row_number() OVER (PARTITION BY text_id ORDER BY pos) AS import_no, statement
       FROM (SELECT text_id, statement, min(i) AS pos FROM (
           SELECT text_id, name, min(i) AS i FROM (SELECT text_id, unnest(range(len(x))) AS i,
             unnest(x) AS name FROM (SELECT text_id,
               regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*') AS x FROM {v_code}) AS a) AS b
           GROUP BY text_id, name) AS n JOIN {v_imports} USING (name)
         WHERE NOT (text_id % 3 = 0 AND name = 'the') AND NOT (text_id % 3 = 1 AND name = 'de')
         GROUP BY text_id, statement) AS s""",
)
def imports_for_names(src):
    return long(G.imports_for_names(src.view("v_code"), IMPORTS), "import_no")


# Code per question that names, imports and defines some of its results.
VIEWS["v_ask_code"] = """
    SELECT question_id, concat('x = Cls1(op_1)', chr(10), 'from m import (Cls2, op_9)', chr(10),
      '  import Cls4', chr(10), 'def op_3(a): pass', chr(10), 'class Cls5: pass', chr(10),
      ' op_5 = 2', chr(10), 'éop_6 ', 'Cls', CAST(question_id % 7 AS STRING), '.run(op_',
      CAST(question_id % 50 AS STRING), ', op_0, op_5, Cls3, Cls0)', chr(10), text) AS text
    FROM {v_asks}"""
_IMPORT_ROWS = """
    SELECT question_id, rank, 'pack.' || module AS module, CASE WHEN kind = 'method'
        THEN split_part(qualname, '.', 1) ELSE split_part(qualname, '.', 2) END AS name
    FROM {v_results} JOIN {v_chunks} USING (chunk_id) WHERE source_type = 'generated'"""


def named_results(src):
    return chunk_results(src.view("v_results"), src.view("v_chunks"))


@register(
    "suggest_imports",
    f"""SELECT question_id, import_no, statement FROM (SELECT question_id, statement,
          row_number() OVER (PARTITION BY question_id ORDER BY rank) AS import_no FROM (
          SELECT question_id, 'from ' || module || ' import ' || name AS statement, min(rank) AS rank
          FROM ({_IMPORT_ROWS}) AS r JOIN {{v_ask_code}} USING (question_id)
          WHERE list_contains(regexp_extract_all(replace(text, 'é', 'x'), '\\w+'), name)
            AND name NOT IN ('Cls2', 'op_9', 'Cls4', 'op_3', 'Cls5', 'op_5', 'x')
          GROUP BY 1, 2) AS s) AS n WHERE import_no <= 6""",
)
def suggest_imports(src):
    found = G.suggest_imports(named_results(src), src.view("v_ask_code"), "pack")
    return long(found, "import_no")


@register(
    "candidate_modules",
    f"""SELECT question_id, module_no, module FROM (SELECT question_id, module,
          row_number() OVER (PARTITION BY question_id ORDER BY min(rank)) AS module_no
        FROM ({_IMPORT_ROWS}) AS r GROUP BY question_id, module) AS m WHERE module_no <= 2""",
)
def candidate_modules(src):
    return long(G.candidate_modules(named_results(src), "pack"), "module_no")
