"""Readers and writers of symbol, narrative, markdown and source files."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions import text as T
from granary.schemas import NARRATIVE_SCHEMA, SYMBOL_SCHEMA


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether any file matches, on whatever file system the path names."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = jvm_path.getFileSystem(spark._jsc.hadoopConfiguration())
    return bool(system.globStatus(jvm_path))


def _objects(spark: SparkSession, path: str, fail: bool) -> DataFrame:
    """JSON lines as ``record`` (variant), in file order by ``position``.

    Blank lines and lines that are no object are skipped. A line that is no
    JSON is an error that names it, or is skipped as well.
    """
    lines = spark.read.text(path).select(
        F.struct(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("start"),
            F.monotonically_increasing_id().alias("line"),
        ).alias("position"),
        F.col("value").alias("__raw"),
    )
    parsed = lines.filter(T.strip("__raw") != "").withColumn("record", F.try_parse_json("__raw"))
    if fail:
        message = F.concat(F.lit("malformed JSON in "), F.col("position.file"), F.lit(": "), F.left("__raw", F.lit(120)))
        broken = F.when(F.col("record").isNull(), F.raise_error(message))
        parsed = parsed.withColumn("record", F.coalesce("record", broken.cast("variant")))
    kind = F.schema_of_variant("record")
    return parsed.filter(F.startswith(kind, F.lit("OBJECT"))).select("position", "record")


def _fields(ddl: str) -> list[Column]:
    """Typed fields of a record; what does not fit its type is NULL.

    Integers may be written as text, and any scalar serves as text.
    """
    columns = []
    for part in ddl.split(","):
        name, kind = part.split()
        value = F.try_variant_get("record", f"$.{name}", kind)
        if kind == "int":
            text = F.try_variant_get("record", f"$.{name}", "string")
            value = F.coalesce(value, T.strip(text).try_cast("int"))
        columns.append(value.alias(name))
    return columns


def read_symbols_jsonl(spark: SparkSession, path: str, mode: str = "fail") -> DataFrame:
    """Symbol records of JSON lines.

    Lines that are no objects are skipped, numbers may be text, and a number
    that is none is NULL. ``fail``: a line that is no JSON or a file without
    records is an error; ``drop``: such lines are skipped too.
    """
    if mode not in ("fail", "drop"):
        raise ValueError(f"unsupported mode: {mode}")
    rows = _objects(spark, path, mode == "fail").select(*_fields(SYMBOL_SCHEMA))
    if mode == "fail" and not rows.take(1):
        raise RuntimeError(f"no symbol records in {path}")
    return rows


def read_narratives_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Narrative sections with their ``position`` in the file; a missing file
    is an empty table. Lines are read as leniently as those of symbols."""
    if not path_exists(spark, path):
        place = "position struct<file string, start long, line long>"
        return spark.createDataFrame([], f"{NARRATIVE_SCHEMA}, {place}")
    rows = _objects(spark, path, True).select(*_fields(NARRATIVE_SCHEMA), "position")
    return rows.filter(T.strip("section_id") != "")


def read_markdown(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of whole markdown files; missing or blank ones drop."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], "path string, text string")
    files = spark.read.text(path, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")).filter(
        T.strip("text") != ""
    )


def normalize_extensions(raw: str | Iterable[str]) -> list[str]:
    """Lower-case suffixes with a leading dot, sorted and distinct."""
    items = raw.split(",") if isinstance(raw, str) else list(raw)
    clean = [item.strip().lower() for item in items if item.strip()]
    if not clean:
        raise ValueError("no file extension given")
    return sorted({c if c.startswith(".") else f".{c}" for c in clean})


def _below(files: DataFrame, root: str, extensions: str | Iterable[str]) -> DataFrame:
    """Files with one of the suffixes, and their ``path`` below the root for ``full``."""
    wanted = F.lit(False)
    for suffix in normalize_extensions(extensions):
        wanted = wanted | F.endswith(F.lower("full"), F.lit(suffix))
    base = root.rstrip("/").split("://")[-1].lstrip("/")
    return files.filter(wanted).withColumn("path", F.substring_index("full", base + "/", -1))


def scan_source_tree(
    spark: SparkSession, root: str, extensions: str | Iterable[str] = (".py", ".pyx", ".spyx")
) -> DataFrame:
    """(path, source, modificationTime) of the files under a root, path relative."""
    files = spark.read.text(root, wholetext=True, recursiveFileLookup=True).select(
        F.col("_metadata.file_path").alias("full"),
        F.col("_metadata.file_modification_time").alias("modificationTime"),
        F.col("value").alias("source"),
    )
    return _below(files, root, extensions).select("path", "source", "modificationTime")


def list_source_tree(
    spark: SparkSession, root: str, extensions: str | Iterable[str] = (".py", ".pyx", ".spyx")
) -> DataFrame:
    """(path, modificationTime) of the same files, none of which is opened."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    files = reader.load(root).select(F.col("path").alias("full"), "modificationTime")
    return _below(files, root, extensions).select("path", "modificationTime")


SYMBOL_FIELDS = (
    "docstring", "example_count", "examples", "file_path", "id", "kind", "line", "module",
    "qualname", "signature", "summary",
)


def write_symbols_jsonl(symbols: DataFrame, path: str) -> None:
    """Sorted JSON lines with sorted keys; the write commits as a whole."""
    ordered = symbols.orderBy("module", "qualname", "kind", "file_path", "line")
    ordered.select(*SYMBOL_FIELDS).write.mode("overwrite").json(path)


def write_narratives_jsonl(narratives: DataFrame, path: str) -> None:
    """JSON lines of narrative sections with the number of resolved symbols."""
    columns = [part.split()[0] for part in NARRATIVE_SCHEMA.split(",")]
    counted = narratives.withColumn("resolved_count", F.size("resolved_symbol_ids"))
    counted.select(*columns).write.mode("overwrite").json(path)
