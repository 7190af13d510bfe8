"""Registry and rule files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions import text as T
from granary.schemas import RULE_SCHEMA
from granary.sources.records import path_exists

_FAMILY = "id string, name string, summary string, keywords array<string>"
_WORKFLOW = (
    "id string, family_id string, title string, summary string, keywords array<string>, "
    "preferred_symbols array<string>, prompt_rules array<string>, tuning_params array<string>"
)
_REGISTRY = (
    f"families array<struct<{_FAMILY.replace(' string', ':string').replace(' array', ':array')}>>, "
    f"workflows array<struct<{_WORKFLOW.replace(' string', ':string').replace(' array', ':array')}>>"
)
_RULES = (
    "global array<string>, rules array<struct<id:string,scope:string,when_any:array<string>,"
    "message:string>>"
)


def _list(name: str) -> Column:
    items = F.coalesce(F.col(name), F.array().cast("array<string>"))
    return F.filter(F.transform(items, T.strip), lambda x: x != "").alias(name)


def load_registry(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(families, workflows) of a JSON registry; rows without id, family or
    name are dropped, ids of families are upper case."""
    file = spark.read.schema(_REGISTRY).option("multiLine", "true").json(path)
    families = (
        file.select(F.posexplode("families").alias("family_no", "f"))
        .select("family_no", "f.*")
        .select(
            "family_no",
            F.upper(T.strip("id")).alias("id"),
            T.strip("name").alias("name"),
            T.strip("summary").alias("summary"),
            _list("keywords"),
        )
        .filter("id <> '' AND name <> ''")
    )
    workflows = (
        file.select(F.posexplode("workflows").alias("workflow_no", "w"))
        .select("workflow_no", "w.*")
        .select(
            "workflow_no",
            T.strip("id").alias("id"),
            F.upper(T.strip("family_id")).alias("family_id"),
            T.strip("title").alias("title"),
            T.strip("summary").alias("summary"),
            _list("keywords"),
            _list("preferred_symbols"),
            _list("prompt_rules"),
            _list("tuning_params"),
        )
        .filter("id <> '' AND family_id <> '' AND title <> ''")
    )
    return families, workflows


def load_rules(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(rules, global messages) of a JSON rule file; absent or broken: empty."""
    if not path_exists(spark, path):
        return (
            spark.createDataFrame([], RULE_SCHEMA),
            spark.createDataFrame([], "message_no int, message string"),
        )
    file = spark.read.schema(_RULES).option("multiLine", "true").json(path)
    rules = file.select(F.posexplode("rules").alias("at", "r")).select(
        (F.col("at") + 1).alias("rule_no"),
        T.strip("r.id").alias("id"),
        F.coalesce(T.blank_to_null(F.lower(T.strip("r.scope"))), F.lit("all")).alias("scope"),
        F.col("r.when_any").alias("when_any"),
        T.strip("r.message").alias("message"),
    )
    messages = file.select(F.posexplode("global").alias("message_no", "message"))
    return rules.filter("message <> '' AND size(when_any) > 0"), messages
