"""Arrow helpers shared by the training-data operators that run Python in tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from granary.runtime import ship_package

# Texts handed to a kernel at a time, and their characters.
ROWS = 2_048
CHARACTERS = 16_000_000


def local_rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small table held in the plan itself, so that no executor runs Python for it."""
    fields = StructType.fromDDL(schema).fields

    def literal(value) -> str:
        if value is None:
            return "NULL"
        if isinstance(value, str):
            return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
        return repr(float(value)) + "D" if isinstance(value, float) else str(value)

    lines = [f"({', '.join(map(literal, row))})" for row in rows]
    empty = f"({', '.join(['NULL'] * len(fields))})"
    names = ", ".join(f"c{i}" for i in range(len(fields)))
    casts = ", ".join(f"CAST(c{i} AS {f.dataType.simpleString()}) AS `{f.name}`" for i, f in enumerate(fields))
    table = spark.sql(f"SELECT {casts} FROM VALUES {', '.join(lines or [empty])} AS t({names})")
    return table if rows else table.limit(0)


def held_out(doc_id: str, parts: int, part: int) -> Column:
    """Whether the CRC-32 of the id as text leaves this remainder; never for a NULL id."""
    crc = F.crc32(F.col(doc_id).cast("string").cast("binary"))
    return F.coalesce(F.pmod(crc, F.lit(parts)) == part, F.lit(False))


def row_name(doc_id: str, text: str) -> Column:
    """128-bit name of a row by its id and text; rows that repeat both have the same."""
    return F.struct(
        F.xxhash64(F.lit(1), F.col(doc_id), F.col(text)).alias("a"),
        F.xxhash64(F.lit(2), F.col(doc_id), F.lit(3), F.col(text)).alias("b"),
    )


def _slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    at = size = 0
    for i, n in enumerate(pa.compute.binary_length(texts).to_pylist()):
        if i > at and (i - at >= ROWS or size + (n or 0) > CHARACTERS):
            yield at, i
            at, size = i, 0
        size += n or 0
    if at < len(texts):
        yield at, len(texts)


def map_texts(
    docs: DataFrame, keep: list[str], text: str, kernel: Callable[[], Callable], fields: str
) -> DataFrame:
    """``keep`` columns as they are plus columns computed from the texts.

    ``kernel()`` is called once per task and gives a function from a list of
    texts (None for NULL) to one list per field. Kept columns never leave
    Arrow, so ids and NULLs pass through unchanged; long texts are handed over
    in smaller lists.
    """
    ship_package()
    made = StructType.fromDDL(fields)
    rows = docs.select(*keep, F.col(text).cast("string").alias("__text"))
    schema = StructType([*rows.schema.fields[:-1], *made.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(schema)
        own = kernel()
        width = len(keep)
        for batch in batches:
            texts = batch.column(width)
            for i, j in _slices(texts):
                values = own(texts.slice(i, j - i).to_pylist())
                arrays = [batch.column(k).slice(i, j - i) for k in range(width)]
                arrays += [pa.array(v, type=target.field(width + k).type) for k, v in enumerate(values)]
                yield pa.RecordBatch.from_arrays(arrays, names=target.names)

    return rows.mapInArrow(run, schema)
