"""Registered queries of the training-data operators, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm import (
    decontaminate,
    fuzzy_lines,
    kdtree,
    langid,
    lshforest,
    mixing,
    perplexity,
    prefixtrie,
    simhash,
    spelling,
    tokencount,
    toxicity,
    warc,
)
from granary.llm.common import held_out, local_rows
from granary.runtime import materialize, scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(build: Callable[[SparkSession, str], DataFrame]):
    QUERIES[build.__name__] = build
    return build


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


@query
def op8_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Words, hits and benchmark items of every document."""
    found = decontaminate.find_contamination(
        table(spark, folder, "documents"), table(spark, folder, "benchmark")
    )
    return found.drop("hit_words")


_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ITEM_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLES["op8_decontamination"] = f"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce({_ITEM_WORDS}, []) AS w FROM documents
), i AS (
  SELECT item_id, {_ITEM_WORDS} AS w FROM benchmark
), win AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[p:p + least(len(w), 10) - 1], ' ') AS words
  FROM (SELECT item_id, w, unnest(generate_series(1, len(w) - least(len(w), 10) + 1)) AS p
        FROM i WHERE len(w) > 0)
), hit AS (
  SELECT rid, p, k, item_id
  FROM (SELECT rid, p, k, array_to_string(w[p:p + k - 1], ' ') AS words
        FROM (SELECT rid, w, k, unnest(generate_series(1, len(w) - k + 1)) AS p
              FROM d, (SELECT DISTINCT k FROM win) WHERE len(w) >= k)) x
  JOIN win USING (k, words)
), covered AS (
  SELECT rid, count(DISTINCT q) AS n FROM (SELECT rid, unnest(generate_series(p, p + k - 1)) AS q FROM hit)
  GROUP BY rid
), items AS (
  SELECT rid, count(*) AS n, string_agg(item, ',' ORDER BY item) AS list
  FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY rid
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(covered.n, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(items.n, 0) AS BIGINT) AS n_items, sha256(coalesce(items.list, '')) AS items_sha256,
  coalesce(covered.n, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (rid) LEFT JOIN items USING (rid)
"""


@query
def op7_kdtree_shards(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's shard of 24, of near equal bytes."""
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang", "source")
    placed = kdtree.kd_shards(docs, shards=24)
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


# Target weights of the tree; nodes that are not named weigh 1.
MIX_WEIGHTS = (
    (0, "domain0", 5),
    (0, "domain1", 3),
    (0, "domain2", 2),
    (1, "en", 4),
    (1, "de", 3),
    (1, "fr", 2),
    (2, "src0", 2),
)
MIX_BUDGET = 0.6
MIX_EPOCHS = 3
MIX_SEED = 7


def mix_levels() -> dict:
    """Domain, language and source of a document; the source number names the domain."""
    number = F.regexp_extract("source", "([0-9]+)$", 1)
    domain = F.when(number != "", F.concat(F.lit("domain"), (F.expr("try_cast(regexp_extract(source, '([0-9]+)$', 1) AS BIGINT)") % 3).cast("string")))
    return {"domain": domain, "lang": F.col("lang"), "source": F.col("source")}


def mix_weights(spark: SparkSession) -> DataFrame:
    return local_rows(spark, list(MIX_WEIGHTS), "level int, name string, weight long")


@query
def op3_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """Documents chosen for a mix of 60 percent of all words, up to 3 epochs a source."""
    docs = table(spark, folder, "documents")
    counted = materialize(
        docs.select("doc_id", "lang", "source", mixing.n_words(F.col("text")).alias("n_tokens")), "counted"
    )
    return mixing.mix(
        counted,
        mix_levels(),
        mix_weights(spark),
        MIX_BUDGET,
        MIX_EPOCHS,
        MIX_SEED,
        tokens=F.col("n_tokens"),
    )


def _share_sql(children: str, parent: str) -> str:
    """Split each parent's budget among rows (name, weight, cap, given)."""
    return f"""(
  SELECT *, CASE WHEN is_full THEN cap ELSE share + CASE WHEN is_open AND row_number() OVER (
      PARTITION BY {parent} ORDER BY rest DESC, name) <= open_b - sum(share) OVER (PARTITION BY {parent})
    THEN 1 ELSE 0 END END AS budget
  FROM (SELECT *, CASE WHEN is_open THEN (open_b * weight) // open_w ELSE 0 END AS share,
      CASE WHEN is_open THEN (open_b * weight) % open_w ELSE -1 END AS rest
    FROM (SELECT *, NOT is_full AND open_w > 0 AS is_open
      FROM (SELECT *, given - sum(CASE WHEN is_full THEN cap ELSE 0 END) OVER (PARTITION BY {parent}) AS open_b,
          sum(CASE WHEN is_full THEN 0 ELSE weight END) OVER (PARTITION BY {parent}) AS open_w
        FROM (SELECT *, cap * left_w <= greatest(left_b, 0) * weight AS is_full
          FROM (SELECT *, sum(weight) OVER (PARTITION BY {parent})
              - coalesce(sum(weight) OVER (PARTITION BY {parent} ORDER BY CAST(cap AS DOUBLE) / weight, name
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_w,
              given - coalesce(sum(cap) OVER (PARTITION BY {parent} ORDER BY CAST(cap AS DOUBLE) / weight, name
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_b
            FROM {children}))))))"""


_WEIGHTS_SQL = ", ".join(f"({level}, '{name}', {weight})" for level, name, weight in MIX_WEIGHTS)

ORACLES["op3_mixing"] = f"""
WITH w AS (SELECT * FROM (VALUES {_WEIGHTS_SQL}) AS t(level, node, weight)
), d AS (
  SELECT doc_id, coalesce('domain' || CAST(TRY_CAST(nullif(regexp_extract(source, '([0-9]+)$', 1), '') AS BIGINT) % 3 AS VARCHAR), 'none') AS domain,
    coalesce(lang, 'none') AS lang, coalesce(source, 'none') AS source,
    CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS HUGEINT) AS n_tokens
  FROM documents
), leaf AS (
  SELECT domain, lang, source, source AS name, sum(n_tokens) AS tokens, sum(n_tokens) * {MIX_EPOCHS} AS cap,
    coalesce(max(weight), 1) AS weight
  FROM d LEFT JOIN w ON level = 2 AND node = source GROUP BY ALL
), mid AS (
  SELECT domain, lang, lang AS name, sum(cap) AS cap, coalesce(max(w.weight), 1) AS weight
  FROM leaf LEFT JOIN w ON level = 1 AND node = lang GROUP BY domain, lang
), top AS (
  SELECT 0 AS root, domain, domain AS name, sum(cap) AS cap, coalesce(max(w.weight), 1) AS weight,
    (SELECT CAST(floor({MIX_BUDGET} * sum(tokens)) AS HUGEINT) FROM leaf) AS given
  FROM mid LEFT JOIN w ON level = 0 AND node = domain GROUP BY domain
), top_b AS (SELECT * FROM {_share_sql("top", "root")}
), mid_b AS (SELECT * FROM {_share_sql("(SELECT mid.*, top_b.budget AS given FROM mid JOIN top_b USING (domain))", "domain")}
), leaf_b AS (SELECT * FROM {_share_sql("(SELECT leaf.*, mid_b.budget AS given FROM leaf JOIN mid_b USING (domain, lang))", "domain, lang")}
), plan AS (
  SELECT domain, lang, source, CASE WHEN tokens > 0 THEN budget // tokens ELSE 0 END AS epochs,
    budget - CASE WHEN tokens > 0 THEN budget // tokens ELSE 0 END * tokens AS rest
  FROM leaf_b
), ordered AS (
  SELECT doc_id, domain, lang, source, n_tokens, epochs, rest, sum(n_tokens) OVER (PARTITION BY domain, lang, source
    ORDER BY md5('{MIX_SEED}:' || CAST(epochs AS VARCHAR) || ':' || CAST(doc_id AS VARCHAR))) AS reach,
    sum(n_tokens) OVER (PARTITION BY domain, lang, source) AS tokens
  FROM d JOIN plan USING (domain, lang, source)
)
SELECT doc_id, domain, lang, source, CAST(n_tokens AS BIGINT) AS n_tokens,
  CAST(epochs + CASE WHEN reach <= rest AND tokens > 0 THEN 1 ELSE 0 END AS INT) AS copies
FROM ordered WHERE epochs + CASE WHEN reach <= rest AND tokens > 0 THEN 1 ELSE 0 END > 0
"""


@query
def op2_simhash(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprint and near-copy component of every document."""
    return simhash.simhash_groups(table(spark, folder, "documents"))


@query
def op9_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity score of every document; a fifth of the ids is never learned from."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    learn = docs.filter(~held_out("doc_id", 5, 0))
    model = toxicity.train(learn, table(spark, folder, "labels"))
    scored = toxicity.score(docs, model, keep=["doc_id"])
    return scored.select(
        "doc_id",
        held_out("doc_id", 5, 0).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        "spans",
    )


@query
def op1_perplexity(spark: SparkSession, folder: str) -> DataFrame:
    """Base rules and perplexity band of every document."""
    return perplexity.quality(table(spark, folder, "documents"))


@query
def op5_language(spark: SparkSession, folder: str) -> DataFrame:
    """Predicted language of every document; a third of the ids is never learned from."""
    docs = table(spark, folder, "documents")
    profiles = langid.learn(docs.filter(~held_out("doc_id", 3, 1)).select("text", "lang"))
    found = langid.identify(docs.select("doc_id", "text"), profiles, keep=["doc_id"])
    return found.select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), "lang_pred", "score")


# Rank file of a public byte-level vocabulary.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


@query
def op10_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Pre-tokens and unigram tokens of every document."""
    return tokencount.token_counts(table(spark, folder, "documents"), VOCABULARY, keep=["doc_id"])


@query
def op6_warc(spark: SparkSession, folder: str) -> DataFrame:
    """Pages written to archives and read back from them."""
    path = scratch_path(spark, "warc")
    warc.write_archives(table(spark, folder, "pages"), path)
    records = materialize(warc.read_archives(spark, path, with_payload=False).drop("payload"), "records")
    return warc.resolve_revisits(records).select(
        F.col("page_id").cast("long").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        F.col("refers_to").cast("long").alias("refers_to"),
    )


@query
def op4_fuzzy_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Class of every line of every document; one line of a class is kept."""
    return fuzzy_lines.line_classes(table(spark, folder, "documents")).drop("row")


def _crc32_sql(codes: str) -> str:
    """CRC-32 of a list of bytes."""
    table = []
    for value in range(256):
        for _ in range(8):
            value = value >> 1 ^ (0xEDB88320 if value & 1 else 0)
        table.append(value)
    step = f"lambda a, b: xor(a >> 8, CAST({table} AS BIGINT[])[1 + (xor(a, b) & 255)])"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {codes}), {step}), 4294967295)"


# Letters beyond ASCII are U+00C0 to U+00FF here: two bytes, the first always C3.
_BYTES_SQL = """flatten(list_transform(string_split(named, ''),
      lambda c: CASE WHEN ord(c) < 128 THEN [CAST(ord(c) AS BIGINT)] ELSE [195, CAST(ord(c) - 64 AS BIGINT)] END))"""


@query
def op11_spelling(spark: SparkSession, folder: str) -> DataFrame:
    """Words of all documents with the more usual word that each is a variant of."""
    return spelling.spelling_groups(table(spark, folder, "documents"))


ORACLES["op11_spelling"] = f"""
WITH RECURSIVE run AS (
  SELECT doc_id, word, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all({_LOWER}, '[a-z\u00C0-\u00FF]+')) AS word FROM documents)
  WHERE length(word) >= 7 GROUP BY ALL
), hashed AS (
  SELECT word, n, {_crc32_sql(_BYTES_SQL)} AS h
  FROM (SELECT *, coalesce(CAST(doc_id AS VARCHAR), '') || ':' || word AS named FROM run)
), word AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n
  FROM (SELECT n, CASE WHEN h % 31 = 0
          THEN left(word, CAST(h % length(word) AS INT)) || substr(word, CAST(h % length(word) AS INT) + 2) ELSE word END AS word
        FROM hashed)
  WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2
), less AS (
  SELECT word, p, left(word, p - 1) || substr(word, p + 1) AS rest
  FROM (SELECT word, unnest(generate_series(1, CAST(length(word) AS INT))) AS p FROM word)
), near AS (
  SELECT a.word, b.word AS other FROM less a JOIN less b ON a.rest = b.rest AND a.p = b.p AND a.word <> b.word
  UNION SELECT less.word, word.word FROM less JOIN word ON less.rest = word.word
  UNION SELECT word.word, less.word FROM less JOIN word ON less.rest = word.word
), ranked AS (
  SELECT near.word, other, word.n, count(*) OVER (PARTITION BY near.word) AS n_near,
    row_number() OVER (PARTITION BY near.word ORDER BY word.n DESC, other) AS place
  FROM near JOIN word ON word.word = other
), formed AS (
  SELECT word.word, word.n, coalesce(n_near, 0) AS n_near,
    CASE WHEN ranked.n >= 10 * word.n THEN other END AS form, CASE WHEN ranked.n >= 10 * word.n THEN ranked.n END AS form_n
  FROM word LEFT JOIN ranked ON ranked.word = word.word AND place = 1
), led AS (
  SELECT word, word AS last, 0 AS steps FROM formed
  UNION ALL SELECT led.word, formed.form, steps + 1 FROM led JOIN formed ON formed.word = led.last WHERE formed.form IS NOT NULL
)
SELECT word, form, root, n, n_near, form_n
FROM formed JOIN (SELECT word, arg_max(last, steps) AS root FROM led GROUP BY word) USING (word)
"""


@query
def op12_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    """Every distinct beginning of the rebuilt conversations, with sums over its subtree."""
    return prefixtrie.prefix_trie(table(spark, folder, "conversations"))


ORACLES["op12_prefix_trie"] = f"""
WITH turns AS (
  SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS p
  FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations)
  WHERE conv_id IS NOT NULL
), conv AS (
  SELECT conv_id, {_crc32_sql("list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: CAST(ord(c) AS BIGINT))")} % 6 AS h
  FROM (SELECT DISTINCT conv_id FROM turns)
), rebuilt AS (
  SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY own, p) AS d
  FROM (SELECT conv.conv_id, 0 AS own, p, role, text FROM conv
          JOIN turns ON turns.conv_id = conv.conv_id - conv.conv_id % 100 AND p <= h
        UNION ALL SELECT conv.conv_id, 1, p, role, text FROM conv JOIN turns ON turns.conv_id = conv.conv_id AND p > h)
), path AS (
  SELECT conv_id, d, length(text) AS size,
    string_agg(md5(md5(role) || md5(text)), '' ORDER BY d) OVER (PARTITION BY conv_id ORDER BY d) AS key,
    coalesce(string_agg(md5(md5(role) || md5(text)), '' ORDER BY d) OVER (PARTITION BY conv_id ORDER BY d
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS above
  FROM rebuilt
  UNION ALL SELECT conv_id, 0, 0, '', NULL FROM conv
), node AS (
  SELECT key, d, min(conv_id) AS conv_id, count(*) AS n_convs, min(size) AS size, min(above) AS above FROM path GROUP BY key, d
), child AS (SELECT above AS key, count(*) AS n_children FROM node WHERE d > 0 GROUP BY above
), below AS (
  SELECT path.key, sum(CASE WHEN n_children IS NULL THEN 1 ELSE 0 END) AS n_leaves,
    sum((node.n_convs - 1) * node.size) AS saved
  FROM node LEFT JOIN child USING (key) JOIN path ON path.conv_id = node.conv_id AND path.d <= node.d GROUP BY path.key
), ends AS (
  SELECT key, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) AS ids
  FROM path JOIN (SELECT conv_id, max(d) AS d FROM path GROUP BY conv_id) USING (conv_id, d) GROUP BY key
)
SELECT node.conv_id, CAST(node.d AS BIGINT) AS depth, up.conv_id AS parent_conv_id, node.n_convs,
  CAST(coalesce(n_children, 0) AS BIGINT) AS n_children, CAST(n_leaves AS BIGINT) AS n_leaves,
  CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM node LEFT JOIN node up ON up.key = node.above LEFT JOIN child ON child.key = node.key
  JOIN below ON below.key = node.key LEFT JOIN ends ON ends.key = node.key
"""


@query
def op13_lsh_forest(spark: SparkSession, folder: str) -> DataFrame:
    """Near-copy component of every document by sets of two-word shingles."""
    return lshforest.forest_groups(table(spark, folder, "documents"))


ORACLES["op13_lsh_forest"] = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+'), []) AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[p:p + 1], ' ') AS shingle
  FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 1, 1))) AS p FROM d WHERE len(w) > 0)
), size AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), common AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y USING (shingle) WHERE x.doc_id < y.doc_id GROUP BY ALL
), link AS (
  SELECT a, b FROM common JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)
), edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link
), reach AS (
  SELECT doc_id, doc_id AS r FROM d UNION SELECT reach.doc_id, b FROM reach JOIN edge ON a = r
)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM d LEFT JOIN size USING (doc_id) JOIN (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id) USING (doc_id)
"""
