"""Narrative sections of a source tree, with their references, kept up to date.

Parsing is the costly part, so a store keeps the sections of every file and a
refresh parses changed files only. References are stored as they were written and
are resolved on reading, since the symbols change without the files.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions import text as T
from granary.operators import extract as X
from granary.operators.graph import resolve_refs_tiered
from granary.runtime import BROADCAST_ROWS, at_most, materialize
from granary.schemas import NARRATIVE_SCHEMA
from granary.sources import tables

# Batches of sections that a store may have before a refresh rewrites them as one.
MAX_BATCHES = 32
_COLUMNS = [part.split()[0] for part in NARRATIVE_SCHEMA.split(",")]
_PLACE = ["source_file", "section_no"]
_SECTIONS = (
    "section_id string, module string, section_title string, text string, source_file string, "
    "section_no int, raw_refs array<string>, batch string"
)
_FILES = "path string, modificationTime timestamp, batch string"


def parse_narratives(
    files: DataFrame,
    package: str,
    root_name: str,
    path_root: str = "",
    min_doc_chars: int = X.MIN_DOC_CHARS,
    min_section_chars: int = X.MIN_SECTION_CHARS,
) -> DataFrame:
    """Sections of source files (path, source) with ``section_no`` and ``raw_refs``.

    Files that do not parse or have a short docstring or none have no sections.
    """
    docs = X.extract_module_docs(X.scan_sources(files), root_name, path_root)
    sections = X.narrative_sections(docs, package, min_doc_chars, min_section_chars)
    return sections.withColumn("raw_refs", X.extract_refs("text", package)).select(
        "section_id", "module", "section_title", "text", *_PLACE, "raw_refs"
    )


def resolve_narratives(sections: DataFrame, symbols: DataFrame) -> DataFrame:
    """Sections in the narrative schema, plus ``section_no``.

    ``symbols``: seq, symbol_id, qualname. The symbols of a section are in the order
    of the references that name them first, and of one reference in that of the
    symbol records. ``sections`` is read twice, so it has to be a written table.
    """
    refs = sections.select(
        F.struct(*_PLACE).alias("section_id"), F.posexplode("raw_refs").alias("pos", "ref")
    )
    order = (
        symbols.select("seq", T.strip("symbol_id").alias("symbol_id"))
        .groupBy("symbol_id")
        .agg(F.min("seq").alias("seq"))
    )
    order = materialize(order, "symbol-order")
    found = (
        resolve_refs_tiered(refs, symbols)
        .join(F.broadcast(order) if at_most(order, BROADCAST_ROWS) else order, "symbol_id")
        .groupBy("section_id")
        .agg(F.sort_array(F.collect_list(F.struct("pos", "seq", "symbol_id"))).alias("found"))
        .select("section_id.*", F.transform("found", lambda x: x["symbol_id"]).alias("found"))
    )
    none = F.array().cast("array<string>")
    return (
        sections.join(found, _PLACE, "left")
        .withColumn("resolved_symbol_ids", F.coalesce("found", none))
        .withColumn("resolved_count", F.size("resolved_symbol_ids"))
        .select(*_COLUMNS, "section_no")
    )


def extract_narratives(
    files: DataFrame,
    symbols: DataFrame,
    package: str,
    root_name: str,
    path_root: str = "",
    min_doc_chars: int = X.MIN_DOC_CHARS,
    min_section_chars: int = X.MIN_SECTION_CHARS,
) -> DataFrame:
    """Narrative sections of source files, references found and resolved."""
    parsed = parse_narratives(files, package, root_name, path_root, min_doc_chars, min_section_chars)
    return resolve_narratives(materialize(parsed, "sections"), symbols)


def _manifest(spark: SparkSession, path: str) -> DataFrame | None:
    at = tables.current_version(spark, path)
    return None if at is None else spark.read.schema(_FILES).parquet(at)


def _stored(spark: SparkSession, path: str, manifest: DataFrame) -> DataFrame:
    """Sections of the batches that the manifest names, of its files only."""
    batches = [row["batch"] for row in manifest.select("batch").distinct().collect()]  # at most MAX_BATCHES
    if not batches:
        return spark.createDataFrame([], _SECTIONS)
    rows = spark.read.schema(_SECTIONS).parquet(*[f"{path}/sections/{b}" for b in sorted(batches)])
    live = manifest.select(F.col("path").alias("source_file"), "batch")
    return rows.join(live, ["source_file", "batch"], "left_semi")


def refresh_narratives(
    files: DataFrame,
    path: str,
    package: str,
    root_name: str,
    path_root: str = "",
    listing: DataFrame | None = None,
    max_batches: int = MAX_BATCHES,
) -> int:
    """Bring a store up to date with a source tree; the number of files parsed.

    ``files``: path, source, modificationTime. A file is parsed if the store does
    not have it with this time; sections of files that changed or left are no longer
    read. ``listing`` (path, modificationTime) replaces a reading of ``files`` for
    their times. A refresh adds one batch of sections and a manifest, and readers
    see both once the manifest's name is written; one that stops before that leaves
    the store as it was. Of rows that repeat a path the one with the latest time counts.
    """
    spark = files.sparkSession
    listed = (listing if listing is not None else files).select("path", "modificationTime")
    latest = listed.groupBy("path").agg(F.max("modificationTime").alias("modificationTime"))
    times = materialize(latest, "listing")
    known = _manifest(spark, path)
    if known is None:
        known = spark.createDataFrame([], _FILES)
    same = times.join(known, ["path", "modificationTime"])
    changed = materialize(times.join(known, ["path", "modificationTime"], "left_anti"), "changed")
    count = changed.count()
    # Texts of unchanged files are dropped where they are read.
    wanted = F.broadcast(changed) if count <= BROADCAST_ROWS else changed
    batch = f"batch-{uuid.uuid4().hex}"
    asked = files.join(wanted, ["path", "modificationTime"], "left_semi")
    parsed = parse_narratives(asked, package, root_name, path_root).withColumn("batch", F.lit(batch))
    fresh = changed.withColumn("batch", F.lit(batch))
    if not at_most(same.select("batch").distinct(), max_batches - 1):
        kept = _stored(spark, path, same).withColumn("batch", F.lit(batch))
        parsed = parsed.unionByName(kept)
        same = same.withColumn("batch", F.lit(batch))
    parsed.select(*[part.split()[0] for part in _SECTIONS.split(", ")]).write.parquet(
        f"{path}/sections/{batch}"
    )
    folder = f"files-{uuid.uuid4().hex}"
    columns = ["path", "modificationTime", "batch"]
    same.select(*columns).unionByName(fresh.select(*columns)).write.parquet(f"{path}/{folder}")
    tables.publish_version(spark, path, folder)
    return count


def read_narratives(spark: SparkSession, path: str, symbols: DataFrame) -> DataFrame:
    """Sections of a store in the narrative schema, resolved against ``symbols``."""
    manifest = _manifest(spark, path)
    if manifest is None:
        raise FileNotFoundError(f"narratives not found: {path}")
    return resolve_narratives(_stored(spark, path, manifest), symbols)
