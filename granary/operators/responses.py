"""Tables of raw model texts to typed rows."""

from __future__ import annotations

import json
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions import text as T
from granary.operators.routing import Registry, normalize_family_id
from granary.runtime import ship_package, text_slices

# The patterns of published response parsing.
ACTIONS = ("continue", "refine_query", "stop")
FENCE = re.compile(r"```json\s*(\{.*?\})\s*```", re.DOTALL | re.IGNORECASE)
BAD_ESCAPE = re.compile(r'\\(?!["\\/bfnrt]|u[0-9a-fA-F]{4})')
COMMAND_ESCAPE = re.compile(r"\\([tnrbf])(?=[A-Za-z])")
_MARK = re.compile(r'[{}"\\]')
# What can begin an object: told before parsing, whose errors cost the length of the text.
_OBJECT = re.compile(r'\{[ \t\n\r]*["}]')
_DECODE = json.JSONDecoder().raw_decode


def _join(a: list[list[int]], b: list[list[int]]) -> list[list[int]]:
    """Open braces of two readings that go on alike, level by level from the innermost."""
    if len(a) < len(b):
        a, b = b, a
    for i in range(1, len(b) + 1):
        a[-i] += b[-i]
    return a


def _spans(text: str) -> list[tuple[int, int]]:
    """Start and end of the object at each opening brace that is closed, by start.

    A reading begins at every opening brace outside of quotes. Readings differ only in
    whether they are inside quotes now, so all of them are followed at once: by the open
    braces of those outside, of those inside, and of those past a backslash.
    """
    found: list[tuple[int, int]] = []
    outside: list[list[int]] = []
    inside: list[list[int]] | None = None
    escaped: list[list[int]] | None = None
    skipped = -1  # the place whose mark the escaped readings do not see
    for mark in _MARK.finditer(text):
        at, char = mark.start(), mark.group()
        past = None
        if escaped is not None:
            if at == skipped:
                past = escaped
            else:
                inside = escaped if inside is None else _join(inside, escaped)
            escaped = None
        if char == "{":
            outside.append([at])
        elif char == "}":
            if outside:
                found += [(start, at + 1) for start in outside.pop()]
        elif char == '"':
            outside, inside = [] if inside is None else inside, outside or None
        elif inside is not None:
            escaped, inside, skipped = inside, None, at + 1
        if past is not None:
            inside = past if inside is None else _join(inside, past)
    return sorted(found)


def _candidate(text: str) -> str:
    """The part of a response that should be its JSON object."""
    fenced = FENCE.search(text)
    if fenced:
        return fenced.group(1).strip()
    spans = _spans(text)
    for start, end in spans:
        try:
            if _OBJECT.match(text, start) and _DECODE(text, start)[1] == end:
                return text[start:end]
        except (json.JSONDecodeError, RecursionError):
            continue
    if spans:
        return text[slice(*spans[0])]
    start, end = text.find("{"), text.rfind("}")
    return (text[start : end + 1] if 0 <= start < end else text).strip()


def _object_json(text: str | None) -> tuple[str | None, str | None]:
    """(object as canonical JSON, error) of a raw response."""
    found = _candidate(text or "")
    try:
        try:
            value = json.loads(found)
        except json.JSONDecodeError as problem:
            if "Invalid \\" not in str(problem):
                raise
            value = json.loads(COMMAND_ESCAPE.sub(r"\\\\\1", BAD_ESCAPE.sub(r"\\\\", found)))
        if not isinstance(value, dict):
            return None, "Expected a JSON object."
        return json.dumps(value), None
    except (ValueError, RecursionError) as problem:
        return None, str(problem)


def parse_responses(responses: DataFrame, raw: str = "raw") -> DataFrame:
    """Adds payload (JSON text of the object, NULL on failure) and error.

    Object search and escape repair walk each text once; typed columns are
    then taken from the payload in the JVM.
    """

    @F.arrow_udf("payload string, error string")
    def parse(texts: pa.Array) -> pa.Array:
        parts: list[list[pa.Array]] = [[pa.array([], pa.string())] for _ in range(2)]
        for some in text_slices(texts):
            made = [_object_json(t) for t in some.to_pylist()]
            for part, values in zip(parts, zip(*made)):
                part.append(pa.array(values, pa.string()))
        return pa.StructArray.from_arrays([pa.concat_arrays(p) for p in parts], ["payload", "error"])

    ship_package()
    return responses.withColumn("__p", parse(raw)).withColumns(
        {"payload": F.col("__p.payload"), "error": F.col("__p.error")}
    ).drop("__p")


def _text(payload: Column, field: str) -> Column:
    return T.strip(F.get_json_object(payload, f"$.{field}"))


def _list(payload: Column, field: str) -> Column:
    items = F.from_json(F.get_json_object(payload, f"$.{field}"), "array<string>")
    return F.filter(
        F.coalesce(items, F.array().cast("array<string>")), lambda x: x.isNotNull()
    )


def response_fields(parsed: DataFrame, body: str = "code") -> DataFrame:
    """Adds the body text, citations_used and missing_info of parsed responses."""
    payload = F.col("payload")
    return parsed.withColumns(
        {
            body: _text(payload, body),
            "citations_used": _list(payload, "citations_used"),
            "missing_info": _list(payload, "missing_info"),
        }
    )


def explode_subtasks(
    plans: DataFrame, max_steps: int, fallback: str = "usage details", registry: Registry | None = None
) -> DataFrame:
    """Plan payloads to step rows: question_id, position, step_id, title,
    instruction, retrieval_query, family_id.

    ``plans``: question_id, payload, text (the fallback query). A plan without
    a usable step gives one direct-retrieval row.
    """
    raw = F.from_json(F.get_json_object("payload", "$.subtasks"), "array<string>")
    head = F.slice(F.coalesce(raw, F.array().cast("array<string>")), 1, max_steps)
    steps = F.filter(
        F.transform(head, lambda s, i: F.struct((i + 1).alias("position"), s.alias("item"))),
        lambda s: F.startswith(s["item"], F.lit("{")),
    )
    rows = plans.withColumn("__steps", steps).select(
        "question_id", F.col("text").alias("__ask"), F.explode_outer("__steps").alias("s")
    )
    item, position = F.col("s.item"), F.col("s.position")
    number = F.nullif(F.get_json_object(item, "$.step_id").try_cast("int"), F.lit(0))
    title, instruction = _text(item, "title"), _text(item, "instruction")
    label = F.coalesce(
        T.blank_to_null(title), F.concat(F.lit("Step "), position.cast("string"))
    )
    query = F.coalesce(
        T.blank_to_null(_text(item, "retrieval_query")), T.blank_to_null(instruction), label
    )
    empty = F.col("s").isNull()
    family = _text(item, "family_id")
    if registry is not None:
        family = normalize_family_id(family, registry)
    return rows.select(
        "question_id",
        F.when(empty, 1).otherwise(position).alias("position"),
        F.when(empty, 1).otherwise(F.coalesce(number, position)).alias("step_id"),
        F.when(empty, "Direct retrieval").otherwise(label).alias("title"),
        F.when(empty, "Retrieve direct evidence for the user question")
        .otherwise(instruction)
        .alias("instruction"),
        F.when(empty, F.coalesce(T.blank_to_null("__ask"), F.lit(fallback)))
        .otherwise(query)
        .alias("retrieval_query"),
        F.when(empty, "").otherwise(family).alias("family_id"),
    )


def parse_decisions(parsed: DataFrame) -> DataFrame:
    """Adds action, reason, next_query and confidence of decision payloads."""
    payload = F.col("payload")
    action = F.lower(_text(payload, "action"))
    number = F.get_json_object(payload, "$.confidence").try_cast("double")
    return parsed.withColumns(
        {
            "action": F.when(action.isin(*ACTIONS), action).otherwise("continue"),
            "reason": _text(payload, "reason"),
            "next_query": _text(payload, "next_query"),
            "confidence": F.coalesce(number, F.lit(0.0)),
        }
    )
