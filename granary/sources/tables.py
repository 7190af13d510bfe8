"""Index and graph directories of Parquet tables."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions import text as T
from granary.operators.graph import (
    SymbolGraph,
    class_node,
    lookup_by_tail,
    methods_of,
    precondition_nodes,
)
from granary.operators.index import LexicalIndex
from granary.schemas import chunk_row
from granary.sources.records import path_exists

VERSION = 2
CHUNKING = {"chunk_chars": 3500, "overlap_chars": 400, "generated_chunk_chars": 2400}
DEFAULTS = {"source_priority": "symbols-first", "symbols_ratio": 0.75, "max_pdf_extras": 2}


def index_meta(spark: SparkSession, sources: list[str], created_at: str | None = None) -> DataFrame:
    """One row: version, creation time, sources, retrieval and chunking defaults."""
    made = F.lit(created_at) if created_at else F.date_format(
        F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX"
    )
    return spark.range(1).select(
        F.lit(VERSION).alias("version"),
        made.alias("created_at"),
        T.strings(sources).alias("sources"),
        F.struct(*[F.lit(v).alias(k) for k, v in DEFAULTS.items()]).alias("retrieval_defaults"),
        F.struct(*[F.lit(v).alias(k) for k, v in CHUNKING.items()]).alias("chunking"),
    )


def coerce_chunks(rows: DataFrame) -> DataFrame:
    """Chunk rows as stored by any version: blanks for missing texts, NULL for
    unusable numbers, a source type for rows from before there was one."""
    page_start, page_end = T.safe_int(F.col("page_start")), T.safe_int(F.col("page_end"))
    legacy = F.when(page_start.isNotNull() | page_end.isNotNull(), "pdf").otherwise("generated")
    texts = (
        "text", "section_title", "symbol_id", "module", "qualname", "signature", "kind",
        "file_path", "summary",
    )
    return rows.select(
        *chunk_row(
            chunk_id=F.col("chunk_id"),
            source=F.coalesce(T.blank_to_null(T.strip("source")), F.lit("unknown")),
            source_type=F.coalesce(T.blank_to_null(T.strip("source_type")), legacy),
            page_start=page_start,
            page_end=page_end,
            line=T.safe_int(F.col("line")),
            example_count=F.coalesce(T.safe_int(F.col("example_count")), F.lit(0)),
            **{name: T.strip(name) for name in texts},
        )
    )


POINTER = "current"


def current_version(spark: SparkSession, path: str) -> str | None:
    """Folder of the version that readers see; a finished version is named by the
    pointer table, so one that was left half way is never read."""
    if not path_exists(spark, f"{path}/{POINTER}"):
        return None
    marks = spark.read.schema("version long, folder string").json(f"{path}/{POINTER}")
    last = marks.orderBy(F.desc("version")).first()
    return None if last is None else f"{path}/{last['folder']}"


def publish_version(spark: SparkSession, path: str, folder: str) -> None:
    """Append the version to the pointer table: one small file, committed by rename."""
    known = 0
    if path_exists(spark, f"{path}/{POINTER}"):
        known = spark.read.schema("version long, folder string").json(f"{path}/{POINTER}").agg(
            F.coalesce(F.max("version"), F.lit(0))
        ).first()[0]
    mark = spark.range(1).select(F.lit(known + 1).alias("version"), F.lit(folder).alias("folder"))
    mark.coalesce(1).write.mode("append").json(f"{path}/{POINTER}")


def write_index(
    path: str,
    chunks: DataFrame,
    lexical: LexicalIndex,
    vectors: DataFrame | None = None,
    sources: list[str] | None = None,
    created_at: str | None = None,
) -> str:
    """Chunks partitioned by source type, term tables, vectors and metadata.

    All tables go to a folder of their own, and readers see it when its name is
    written last: they read the old index until then, and go on reading it if the
    build stops half way. Chunks and vectors are clustered by id, so results
    meet few of their files. The folder of the version is returned; folders of
    earlier versions stay for readers that have them open.
    """
    if not chunks.take(1):
        raise RuntimeError("no chunks were produced for indexing")
    spark = chunks.sparkSession
    folder = f"index-{uuid.uuid4().hex}"
    to = f"{path}/{folder}"
    clustered = chunks.repartitionByRange("source_type", "chunk_id").sortWithinPartitions("source_type", "chunk_id")
    clustered.write.partitionBy("source_type").parquet(f"{to}/chunks")
    lexical.idf.write.parquet(f"{to}/idf")
    lexical.postings.write.parquet(f"{to}/postings")
    if vectors is not None:
        vectors.repartitionByRange("chunk_id").sortWithinPartitions("chunk_id").write.parquet(f"{to}/vectors")
    meta = index_meta(spark, sources or [], created_at).withColumn("posting_block", F.lit(lexical.width))
    meta.write.parquet(f"{to}/meta")
    publish_version(spark, path, folder)
    return to


def read_index(
    spark: SparkSession, path: str
) -> tuple[DataFrame, LexicalIndex, DataFrame | None, DataFrame]:
    """(chunks, lexical index, vectors or None, metadata) of the current version."""
    at = current_version(spark, path)
    if at is None:
        raise FileNotFoundError(f"index not found: {path}")
    chunks = coerce_chunks(spark.read.parquet(f"{at}/chunks"))
    meta = spark.read.parquet(f"{at}/meta")
    width = meta.select("posting_block").first()[0]
    lexical = LexicalIndex(spark.read.parquet(f"{at}/idf"), spark.read.parquet(f"{at}/postings"), width)
    has_vectors = path_exists(spark, f"{at}/vectors")
    vectors = spark.read.parquet(f"{at}/vectors") if has_vectors else None
    return chunks, lexical, vectors, meta


def write_graph(path: str, graph: SymbolGraph) -> str:
    """All tables of a graph as one version; readers see it once it is complete."""
    folder = f"graph-{uuid.uuid4().hex}"
    to = f"{path}/{folder}"
    graph.entries.write.parquet(f"{to}/entries")
    graph.nodes.write.parquet(f"{to}/nodes")
    graph.seeds.write.parquet(f"{to}/seeds")
    if graph.edges is not None:
        graph.edges.write.parquet(f"{to}/edges")
    publish_version(graph.nodes.sparkSession, path, folder)
    return to


def read_graph(spark: SparkSession, path: str) -> SymbolGraph:
    """Graph tables; seeds and group members of unknown symbols are dropped."""
    at = current_version(spark, path)
    if at is None:
        raise FileNotFoundError(f"graph not found: {path}")
    nodes = spark.read.parquet(f"{at}/nodes")
    known = nodes.select("key")
    entries = spark.read.parquet(f"{at}/entries").join(known, "key", "left_semi")
    seeds = spark.read.parquet(f"{at}/seeds").join(known, "key", "left_semi")
    edges = None
    if path_exists(spark, f"{at}/edges"):
        edges = spark.read.parquet(f"{at}/edges")
    return SymbolGraph(entries, nodes, seeds, edges)


# ---- precondition graph ---------------------------------------------------------------

# Folders that a table of names is dealt to, and files that share one of them, so
# that a name which most records have is not written by one task.
NAME_BUCKETS = 64
BUCKET_FILES = 4


@dataclass(frozen=True)
class PreconditionGraph:
    """Stored tables of symbol preconditions.

    ``nodes`` (one row per symbol) and ``tails`` (one per record) lie in folders by
    their tail, ``methods`` by their class; a lookup reads the folders of its names.
    """

    nodes: DataFrame
    tails: DataFrame
    methods: DataFrame
    meta: DataFrame
    buckets: int

    def _of(self, table: DataFrame, names: DataFrame, key: Column) -> DataFrame:
        """The folders of a table that can hold one of the names; the driver sees
        their numbers only, of which there are at most ``buckets``."""
        wanted = names.select(_bucket(key, self.buckets).alias("bucket")).distinct().collect()
        return table.filter(F.col("bucket").isin([row["bucket"] for row in wanted]))

    def lookup_by_tail(self, names: DataFrame) -> DataFrame:
        """(name, seq, symbol_id): every record that ends in the name."""
        return lookup_by_tail(names, self._of(self.tails, names, T.strip("name")))

    def class_node(self, names: DataFrame) -> DataFrame:
        """(name, symbol_id): the first class whose dotted name ends in the name.
        Such a class has the tail of the name, so it lies in that folder."""
        return class_node(names, self._of(self.nodes, names, T.tail_of("name")))

    def methods_of(self, names: DataFrame) -> DataFrame:
        """(name, seq, symbol_id): methods of a class."""
        return methods_of(names, self._of(self.methods, names, T.strip("name")))


def _bucket(name: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.coalesce(name, F.lit(""))), F.lit(buckets)).cast("int")


def write_precondition_graph(
    path: str,
    entries: DataFrame,
    source_path: str = "",
    created_at: str | None = None,
    buckets: int = NAME_BUCKETS,
) -> str:
    """Nodes, tails and class methods of ``precondition_entries`` as one version.

    An interrupted write is never read. Records without a class are in no method
    table; an empty table of entries gives an empty graph.
    """
    spark = entries.sparkSession
    folder = f"preconditions-{uuid.uuid4().hex}"
    to = f"{path}/{folder}"

    def store(rows: DataFrame, name: str, key: str) -> None:
        dealt = rows.withColumn("bucket", _bucket(F.col(key), buckets)).withColumn(
            "__file", F.pmod(F.xxhash64("symbol_id", F.lit("file")), F.lit(BUCKET_FILES))
        )
        spread_rows = dealt.repartition("bucket", "__file").drop("__file")
        spread_rows.sortWithinPartitions("bucket", key).write.partitionBy("bucket").parquet(f"{to}/{name}")

    store(precondition_nodes(entries), "nodes", "tail")
    store(entries.select("tail", "seq", "symbol_id"), "tails", "tail")
    methods = entries.filter("kind = 'method' AND owner_class <> ''")
    store(methods.select("owner_class", "kind", "seq", "symbol_id"), "methods", "owner_class")
    meta = index_meta(spark, [source_path], created_at).select(
        "version", "created_at", F.lit(source_path).alias("source_path"), F.lit(buckets).alias("buckets")
    )
    meta.write.parquet(f"{to}/meta")
    publish_version(spark, path, folder)
    return to


_NODES = (
    "first_seq long, symbol_id string, qualname string, module string, kind string, "
    "owner_class string, owner_qualname string, tail string, import_statement string, bucket int"
)
_TAILS = "tail string, seq long, symbol_id string, bucket int"
_METHODS = "owner_class string, kind string, seq long, symbol_id string, bucket int"


def read_precondition_graph(spark: SparkSession, path: str) -> PreconditionGraph:
    """The current version of a stored precondition graph."""
    at = current_version(spark, path)
    if at is None:
        raise FileNotFoundError(f"precondition graph not found: {path}")
    meta = spark.read.parquet(f"{at}/meta")
    nodes, tails, methods = (
        spark.read.schema(ddl).parquet(f"{at}/{name}")
        for name, ddl in (("nodes", _NODES), ("tails", _TAILS), ("methods", _METHODS))
    )
    return PreconditionGraph(nodes, tails, methods, meta, meta.select("buckets").first()[0])
