"""Page rows out of any tabular source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def page_table(docs: DataFrame, key: str, pages: Column) -> DataFrame:
    """(doc_id, page, text) rows; pages count from 1, missing text is ''."""
    return docs.select(
        F.col(key).alias("doc_id"), F.posexplode_outer(pages).alias("__p", "__t")
    ).filter("__p IS NOT NULL").select(
        "doc_id",
        (F.col("__p") + 1).alias("page"),
        F.coalesce("__t", F.lit("")).alias("text"),
    )
