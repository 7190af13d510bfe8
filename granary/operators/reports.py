"""API reference report and refresh time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions import text as T

TABLE_HEAD = (
    "| Symbol | Kind | Signature | Examples | Source | Summary |",
    "| --- | --- | --- | ---: | --- | --- |",
)


def escape_cell(c: Column | str) -> Column:
    return F.replace(F.replace(T.or_empty(c), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit("<br>"))


def report_totals(symbols: DataFrame) -> DataFrame:
    return symbols.agg(
        F.count_distinct("module").alias("modules"),
        F.count("*").alias("symbols"),
        F.count_if(F.col("example_count") > 0).alias("with_examples"),
    )


def api_reference_report(
    symbols: DataFrame, generated_at: str = "1970-01-01T00:00:00Z", modules: int | None = None
) -> DataFrame:
    """(module, part, qualname, kind, line, text): the report line by line.

    Lines stay rows, ordered by the columns before ``text``, so a module of
    any size is written by as many tasks as its rows need. ``modules`` is the
    number of scanned modules when some of them have no symbols.
    """
    source = F.concat_ws(":", "file_path", F.col("line").cast("string"))

    def code(c: Column | str) -> Column:
        return F.concat(F.lit("`"), escape_cell(c), F.lit("`"))

    row = F.concat(
        F.lit("| "),
        F.concat_ws(
            " | ",
            code("qualname"),
            code("kind"),
            code("signature"),
            F.col("example_count").cast("string"),
            code(source),
            escape_cell("summary"),
        ),
        F.lit(" |"),
    )
    body = symbols.select(
        "module", F.lit(1).alias("part"), "qualname", "kind", "line", row.alias("text")
    )
    names = symbols.select("module").distinct()

    def framed(part: int, text: Column) -> DataFrame:
        return names.select(
            "module",
            F.lit(part).alias("part"),
            F.lit("").alias("qualname"),
            F.lit("").alias("kind"),
            F.lit(0).alias("line"),
            text.alias("text"),
        )

    title = F.concat(F.lit("## `"), F.col("module"), F.lit("`"))
    heads = framed(0, F.concat_ws("\n", title, F.lit(""), *[F.lit(h) for h in TABLE_HEAD]))
    ends = framed(2, F.lit(""))
    scanned = F.lit(modules) if modules is not None else F.col("modules")
    lines = F.concat_ws(
        "\n",
        F.lit("# API Reference"),
        F.lit(""),
        F.lit(f"- Generated: `{generated_at}`"),
        F.concat(F.lit("- Modules scanned: `"), scanned.cast("string"), F.lit("`")),
        F.concat(F.lit("- Symbols extracted: `"), F.col("symbols").cast("string"), F.lit("`")),
        F.concat(
            F.lit("- Symbols with examples: `"), F.col("with_examples").cast("string"), F.lit("`")
        ),
        F.lit(""),
    )
    top = report_totals(symbols).select(
        F.lit("").alias("module"),
        F.lit(0).alias("part"),
        F.lit("").alias("qualname"),
        F.lit("").alias("kind"),
        F.lit(0).alias("line"),
        lines.alias("text"),
    )
    return top.unionByName(heads).unionByName(body).unionByName(ends)


REPORT_ORDER = ("module", "part", "qualname", "kind", "line")


def write_report(report: DataFrame, path: str) -> None:
    """The report as markdown text files; their order is the report's order."""
    report.orderBy(*REPORT_ORDER).select("text").write.mode("overwrite").text(path)


def refresh_timestamp(files: DataFrame, column: str = "modificationTime") -> DataFrame:
    """(refreshed): latest time as ISO text, the epoch if there are no files."""
    latest = F.coalesce(F.max(column), F.lit("1970-01-01 00:00:00").cast("timestamp"))
    return files.agg(
        F.date_format(latest, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("refreshed")
    )
