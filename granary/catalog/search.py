"""Queries over term weights, vectors and search."""

from __future__ import annotations

from pyspark.sql import functions as F

from granary.catalog.base import CHECK_ONLY, VIEWS, register
from granary.functions.kernels import TokenHashEncoder
from granary.operators import index as I
from granary.operators import search as S
from granary.runtime import materialize

TOKEN_ROWS = (
    "unnest(list_transform(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*'), "
    "lambda t: lower(t)))"
)
CHECK_ONLY["v_tf"] = f"""
    SELECT chunk_id, term, count(*) AS tf FROM (
      SELECT chunk_id, {TOKEN_ROWS} AS term FROM {{v_chunks}}) AS t GROUP BY chunk_id, term"""
CHECK_ONLY["v_idf"] = """
    SELECT term, df, ln((1.0::DOUBLE + n) / (1.0::DOUBLE + df)) + 1.0::DOUBLE AS idf
    FROM (SELECT term, count(*) AS df FROM {v_tf} GROUP BY term) AS d
      CROSS JOIN (SELECT count(*) AS n FROM {v_chunks}) AS c"""
CHECK_ONLY["v_weights"] = """
    SELECT chunk_id, term, tf, (1.0::DOUBLE + ln(tf::DOUBLE)) * idf AS w
    FROM {v_tf} JOIN {v_idf} USING (term)"""
CHECK_ONLY["v_norms"] = """
    SELECT chunk_id, coalesce(sqrt(sum(w * w)), 1.0::DOUBLE) AS norm
    FROM {v_chunks} LEFT JOIN {v_weights} USING (chunk_id) GROUP BY chunk_id"""
CHECK_ONLY["v_query_tf"] = f"""
    SELECT query_id, term, count(*) AS tf FROM (
      SELECT query_id, {TOKEN_ROWS} AS term FROM {{v_queries}}) AS t GROUP BY query_id, term"""
CHECK_ONLY["v_query_weights"] = """
    SELECT query_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY query_id)) AS w FROM (
      SELECT query_id, term, (1.0::DOUBLE + ln(tf::DOUBLE)) * idf AS w
      FROM {v_query_tf} JOIN {v_idf} USING (term)) AS q"""
CHECK_ONLY["v_lexical"] = """
    SELECT query_id, chunk_id, round(sum(q.w * d.w) / max(norm), 9) AS score
    FROM {v_query_weights} AS q JOIN {v_weights} AS d USING (term) JOIN {v_norms} USING (chunk_id)
    GROUP BY query_id, chunk_id"""
CHECK_ONLY["v_lexical_ranked"] = """
    SELECT query_id, chunk_id, score,
      row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank
    FROM {v_lexical} WHERE score > 0"""


def _embedded(view: str, key: str) -> str:
    """Hashed token counts in 64 cells, scaled to unit length, as cells."""
    return f"""
    SELECT {key}, slot, n / sqrt(sum(n * n) OVER (PARTITION BY {key})) AS x FROM (
      SELECT {key}, CAST(('0x' || substr(md5(term), 1, 2))::INT % 64 AS BIGINT) AS slot,
        sum(tf)::DOUBLE AS n FROM {{{view}}} GROUP BY 1, 2) AS c"""


CHECK_ONLY["v_chunk_cells"] = _embedded("v_tf", "chunk_id")
CHECK_ONLY["v_query_cells"] = _embedded("v_query_tf", "query_id")
CHECK_ONLY["v_dense"] = """
    SELECT query_id, chunk_id, round(coalesce(score, 0.0::DOUBLE), 9) AS score
    FROM (SELECT query_id, chunk_id FROM {v_queries} CROSS JOIN {v_chunks}) AS p LEFT JOIN (
      SELECT query_id, chunk_id, sum(q.x * d.x) AS score
      FROM {v_query_cells} AS q JOIN {v_chunk_cells} AS d USING (slot)
      GROUP BY query_id, chunk_id) AS s USING (query_id, chunk_id)"""
CHECK_ONLY["v_dense_ranked"] = """
    SELECT query_id, chunk_id, score,
      row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank
    FROM {v_dense}"""


def _scaled(view: str, fetch: int) -> str:
    return f"""
    SELECT query_id, chunk_id, CASE WHEN max(score) OVER w - min(score) OVER w < 1e-12 THEN 1.0
        ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS score
    FROM {{{view}}} WHERE rank <= {fetch} WINDOW w AS (PARTITION BY query_id)"""


def hybrid_sql(k: int, alpha: str = "0.7", rest: str = "0.3") -> str:
    fetch = max(4 * k, 20)
    return f"""
    SELECT query_id, chunk_id, score, rank FROM (SELECT query_id, chunk_id, score,
        row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM (
        SELECT coalesce(l.query_id, d.query_id) AS query_id,
          coalesce(l.chunk_id, d.chunk_id) AS chunk_id,
          round({alpha}::DOUBLE * coalesce(d.score, 0.0) + {rest}::DOUBLE * coalesce(l.score, 0.0),
            9) AS score
        FROM ({_scaled("v_lexical_ranked", fetch)}) AS l FULL OUTER JOIN
          ({_scaled("v_dense_ranked", fetch)}) AS d
          ON l.query_id = d.query_id AND l.chunk_id = d.chunk_id) AS f) AS r
    WHERE rank <= {k}"""


CHECK_ONLY["v_hybrid_30"] = hybrid_sql(30)


def quota_sql(view: str, k: int, quota: int, extras: int) -> str:
    """Slot order by quotas, over (query_id, chunk_id, score, rank, source_type)."""
    return f"""
    SELECT query_id, chunk_id, score, slot AS rank FROM (SELECT query_id, chunk_id, score,
        row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN g = 0 THEN 0
          WHEN kind = 'G' AND nth <= s THEN 0 WHEN kind = 'P' AND nth <= least({k} - s, p, {extras})
          THEN 1 WHEN kind = 'G' THEN 2 WHEN kind = 'P' THEN 3 ELSE 4 END, rank) AS slot
      FROM (SELECT *, least({quota}, g, {k}) AS s FROM (SELECT *,
          row_number() OVER (PARTITION BY query_id, kind ORDER BY rank) AS nth,
          count(*) FILTER (WHERE kind = 'G') OVER (PARTITION BY query_id) AS g,
          count(*) FILTER (WHERE kind = 'P') OVER (PARTITION BY query_id) AS p
        FROM (SELECT query_id, chunk_id, score, rank, CASE source_type WHEN 'generated' THEN 'G'
            WHEN 'pdf' THEN 'P' ELSE 'O' END AS kind
          FROM {{{view}}} JOIN {{v_chunks}} USING (chunk_id)) AS a) AS b) AS c) AS d
    WHERE slot <= {k}"""


CHECK_ONLY["v_lexical_30"] = "SELECT * FROM {v_lexical_ranked} WHERE rank <= 30"
CHECK_ONLY["v_found"] = quota_sql("v_hybrid_30", 6, 4, 2)


def chunks(src):
    return src.view("v_chunks")


def embedded(src, view: str, key: str):
    return I.embed_chunks(src.view(view), TokenHashEncoder, key=key)


def with_kind(src, results):
    return results.join(chunks(src).select("chunk_id", "source_type"), "chunk_id")


def long(df, *names):
    for name in names:
        df = df.withColumn(name, F.col(name).cast("bigint"))
    return df


@register("document_frequency", "SELECT term, df FROM {v_idf}")
def document_frequency(src):
    return I.document_frequency(I.chunk_terms(chunks(src)))


@register("idf", "SELECT term, df, round(idf, 6) AS idf FROM {v_idf}")
def idf(src):
    table = I.idf(I.document_frequency(I.chunk_terms(chunks(src))), chunks(src))
    return table.withColumn("idf", F.round("idf", 6))


def term_tables(src):
    """Terms of the chunks and their idf, written once."""
    terms = materialize(I.chunk_terms(chunks(src)), "terms")
    return terms, materialize(I.idf(I.document_frequency(terms), chunks(src)), "idf")


@register("tf_weights", "SELECT chunk_id, term, tf, round(w, 6) AS w FROM {v_weights}")
def tf_weights(src):
    terms, table = term_tables(src)
    return long(I.tf_weights(terms, table, I.HOT_TERMS).withColumn("w", F.round("w", 6)), "tf")


@register("doc_norms", "SELECT chunk_id, round(norm, 6) AS norm FROM {v_norms}")
def doc_norms(src):
    terms, table = term_tables(src)
    norms = I.doc_norms(chunks(src), I.tf_weights(terms, table, I.HOT_TERMS))
    return norms.withColumn("norm", F.round("norm", 6))


@register(
    "embed_chunks",
    """SELECT chunk_id, slot, round(x, 6) AS x FROM {v_chunk_cells}""",
)
def embed_chunks(src):
    vectors = embedded(src, "v_chunks", "chunk_id")
    cells = vectors.select("chunk_id", F.posexplode("embedding").alias("slot", "x"))
    return long(cells.filter("x <> 0").withColumn("x", F.round("x", 6)), "slot")


@register(
    "l2_normalize",
    """SELECT vec_id, pos, round(x / sqrt(sum(x * x) OVER (PARTITION BY vec_id)), 6) AS x FROM (
         SELECT vec_id, pos - 0 AS pos, x::DOUBLE * (1 + vec_id) AS x FROM {v_vector_cells}) AS c""",
)
def l2_normalize(src):
    scaled = F.transform(
        "embedding", lambda x: x.cast("double") * (F.col("vec_id") + F.lit(1)).cast("double")
    )
    rows = src.table("embeddings").select("vec_id", I.l2_normalize(scaled).alias("v"))
    cells = rows.select("vec_id", F.posexplode("v").alias("pos", "x"))
    return long(cells.withColumn("x", F.round("x", 6)), "pos")


@register(
    "chunk_stats",
    """SELECT count(*) AS chunks, count(*) FILTER (WHERE source_type = 'pdf') AS pdf,
         count(*) FILTER (WHERE source_type = 'generated') AS generated,
         count(*) FILTER (WHERE source_type = 'narrative') AS narrative FROM {v_chunks}""",
)
def chunk_stats(src):
    return I.chunk_stats(chunks(src))


@register(
    "lexical_search",
    """SELECT query_id, chunk_id, rank, round(score, 6) AS score FROM {v_lexical_ranked}
       WHERE rank <= 5""",
)
def lexical_search(src):
    found = S.lexical_search(src.view("v_queries"), I.lexical_index(chunks(src)), 5)
    return long(found.withColumn("score", F.round("score", 6)), "rank")


@register(
    "dense_search",
    """SELECT query_id, chunk_id, rank, round(score, 6) AS score FROM (SELECT *, row_number() OVER (
           PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM (
         SELECT query_id, chunk_id,
           round(list_inner_product(q.embedding, d.embedding::DOUBLE[]), 9) AS score
         FROM {v_query_vectors} AS q CROSS JOIN {v_vectors} AS d) AS s) AS r WHERE rank <= 10""",
)
def dense_search(src):
    found = S.dense_search(src.view("v_query_vectors"), src.view("v_vectors"), 10)
    return long(found.withColumn("score", F.round("score", 6)), "rank")


@register(
    "minmax_normalize",
    f"""SELECT query_id, chunk_id, round(score, 6) AS score
        FROM ({_scaled("v_lexical_ranked", 20)}) AS s""",
)
def minmax_normalize(src):
    found = S.lexical_search(src.view("v_queries"), I.lexical_index(chunks(src)), 20)
    scaled = S.minmax_normalize(found).select("query_id", "chunk_id", "score")
    return scaled.withColumn("score", F.round("score", 6))


def hybrid(src, k: int):
    return S.hybrid_search(
        src.view("v_queries"),
        embedded(src, "v_queries", "query_id"),
        I.lexical_index(chunks(src)),
        embedded(src, "v_chunks", "chunk_id"),
        k,
    )


@register(
    "hybrid_search",
    f"SELECT query_id, chunk_id, rank, round(score, 6) AS score FROM ({hybrid_sql(6)}) AS h",
)
def hybrid_search(src):
    found = hybrid(src, 6).withColumn("score", F.round("score", 6))
    return long(found, "rank")


# Result lists in which chunks occur several times.
VIEWS["v_repeats"] = """
    SELECT CAST(floor(doc_id / 60) AS BIGINT) AS query_id, (doc_id * 7) % 25 AS chunk_id,
      doc_id AS rank, 1.0 / (1 + doc_id) AS score FROM {documents}"""


@register(
    "dedupe_results",
    """SELECT query_id, chunk_id, min(rank) AS rank FROM {v_repeats}
       GROUP BY query_id, chunk_id""",
)
def dedupe_results(src):
    return S.dedupe_results(src.view("v_repeats")).select("query_id", "chunk_id", "rank")


@register(
    "source_quota",
    f"""SELECT query_id, chunk_id, rank FROM ({quota_sql("v_lexical_30", 6, 4, 2)}) AS q""",
)
def source_quota(src):
    found = S.lexical_search(src.view("v_queries"), I.lexical_index(chunks(src)), 30)
    picked = S.source_quota(with_kind(src, found), 6)
    return long(picked.select("query_id", "chunk_id", "rank"), "rank")


def index_of(src, dense: bool = True):
    from granary.plans.retrieve import CorpusIndex

    return CorpusIndex(
        chunks=chunks(src),
        lexical=I.lexical_index(chunks(src)),
        vectors=embedded(src, "v_chunks", "chunk_id") if dense else None,
        make_encoder=TokenHashEncoder if dense else None,
    )


@register(
    "retrieve",
    """SELECT query_id, chunk_id, rank, round(score, 6) AS score, 'hybrid' AS mode_used
       FROM {v_found}""",
)
def retrieve(src):
    from granary.plans.retrieve import retrieve as run

    found = run(src.view("v_queries"), index_of(src), k=6)
    return long(found.withColumn("score", F.round("score", 6)), "rank")


@register(
    "retrieve_lexical",
    f"""SELECT query_id, chunk_id, rank, round(score, 6) AS score, 'lexical' AS mode_used
        FROM ({quota_sql("v_lexical_30", 6, 4, 2)}) AS q""",
)
def retrieve_lexical(src):
    from granary.plans.retrieve import retrieve as run

    found = run(src.view("v_queries"), index_of(src, dense=False), k=6)
    return long(found.withColumn("score", F.round("score", 6)), "rank")
