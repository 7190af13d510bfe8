"""Text functions as Column expressions; all of them stay in the JVM."""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from granary import vocab
from granary.runtime import let


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def or_empty(c: Column | str) -> Column:
    return F.coalesce(col(c), F.lit(""))


def strip(c: Column | str) -> Column:
    return F.btrim(or_empty(c), F.lit(vocab.SPACE_CHARS))


def rstrip(c: Column | str) -> Column:
    return F.rtrim(or_empty(c), F.lit(vocab.SPACE_CHARS))


def blank_to_null(c: Column | str) -> Column:
    return F.nullif(or_empty(c), F.lit(""))


def strings(items: Iterable[str]) -> Column:
    """Array literal; folded to one constant by the optimizer."""
    items = list(items)
    if not items:
        return F.array().cast("array<string>")
    return F.array(*[F.lit(item) for item in items])


def row_array(fields: Iterable[str], *rows: Iterable[Column]) -> Column:
    """Array of structs with the given field names, one per row."""
    fields = list(fields)
    return F.array(
        *[F.struct(*[v.alias(f) for f, v in zip(fields, row, strict=True)]) for row in rows]
    )


def contains_any(haystack: Column, needles: Iterable[str]) -> Column:
    out = F.lit(False)
    for needle in needles:
        out = out | F.contains(haystack, F.lit(needle))
    return out


def count_contained(haystack: Column, needles: Iterable[str]) -> Column:
    out = F.lit(0)
    for needle in needles:
        out = out + F.contains(haystack, F.lit(needle)).cast("int")
    return out


def tokenize(c: Column | str) -> Column:
    """ASCII identifier tokens, lower-cased, duplicates kept."""
    found = F.regexp_extract_all(or_empty(c), F.lit(vocab.IDENTIFIER), F.lit(0))
    return F.transform(found, F.lower)


def term_counts(tokens: Column) -> Column:
    """Array of (term, tf) of a token array, by sorting and measuring runs.

    Works inside the row: a chunk is never exploded or shuffled to count
    its own terms.
    """

    def measure(run):
        def build(starts):
            ends = F.concat(F.slice(starts, 2, F.size(starts)), F.array(F.size(run) + 1))
            return F.zip_with(
                starts,
                ends,
                lambda a, b: F.struct(
                    F.element_at(run, a).alias("term"), (b - a).cast("int").alias("tf")
                ),
            )

        first = F.filter(
            F.sequence(F.lit(1), F.size(run)),
            lambda i: (i == 1) | (F.get(run, i - 1) != F.get(run, i - 2)),
        )
        return let(first, build)

    empty = F.array().cast("array<struct<term:string,tf:int>>")
    return let(F.sort_array(tokens), lambda run: F.when(F.size(run) > 0, measure(run)).otherwise(empty))


def normalize_text(c: Column | str) -> Column:
    """Lower case, runs of white space as one blank, trimmed."""
    return F.trim(F.regexp_replace(F.lower(or_empty(c)), vocab.SPACE_CLASS + "+", " "))


def query_tokens(c: Column | str, stopwords: Iterable[str] = vocab.RERANK_STOPWORDS) -> Column:
    stop = list(stopwords)
    found = F.regexp_extract_all(F.lower(or_empty(c)), F.lit(vocab.IDENTIFIER), F.lit(0))
    return F.array_distinct(F.filter(found, lambda t: (F.length(t) > 1) & ~t.isin(stop)))


def token_forms(token: Column) -> Column:
    """A token and its singular, if it has one."""
    t = F.lower(strip(token))
    n = F.length(t)
    return (
        F.when(n == 0, F.array().cast("array<string>"))
        .when((n > 4) & t.endswith("ies"), F.array(t, F.concat(F.left(t, n - 3), F.lit("y"))))
        .when((n > 3) & t.endswith("s") & ~t.endswith("ss"), F.array(t, F.left(t, n - 1)))
        .otherwise(F.array(t))
    )


def split_symbol_words(c: Column | str) -> Column:
    """Words of a name: split at other characters, then at camel case."""
    parts = F.filter(F.split(strip(c), "[^A-Za-z0-9]+"), lambda p: p != "")
    words = F.transform(
        parts, lambda p: F.regexp_extract_all(p, F.lit(vocab.SYMBOL_PART), F.lit(0))
    )
    return F.transform(F.flatten(words), F.lower)


def tail_of(c: Column | str) -> Column:
    return F.substring_index(strip(c), ".", -1)


def owner_of(c: Column | str) -> Column:
    q = strip(c)
    return F.when(
        F.contains(q, F.lit(".")), F.left(q, F.length(q) - F.length(tail_of(c)) - 1)
    ).otherwise("")


def slugify(c: Column | str, length: int = 60) -> Column:
    slug = F.btrim(F.regexp_replace(F.lower(or_empty(c)), "[^a-z0-9]+", "_"), F.lit("_"))
    return F.when(slug == "", F.lit("untitled")).otherwise(F.left(slug, F.lit(length)))


def _path_parts(path: Column | str) -> Column:
    bare = F.regexp_replace(or_empty(path), r"\.(py|pyx|spyx)\z", "")
    return F.filter(F.split(bare, "/"), lambda p: p != "")


def module_name(path: Column | str) -> Column:
    """Dotted module of a path that is relative to the source root."""
    return F.array_join(_path_parts(path), ".")


def package_module_name(path: Column | str, root_name: str) -> Column:
    """Same, but an ``__init__`` file stands for its package."""

    def name(parts):
        trimmed = F.when(
            F.try_element_at(parts, F.lit(-1)) == "__init__",
            F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))),
        ).otherwise(parts)
        return F.array_join(trimmed, ".")

    joined = let(_path_parts(path), name)
    return F.when(joined == "", F.lit(root_name)).otherwise(joined)


def location_label() -> Column:
    """Where a chunk comes from, out of its own columns."""
    page_start, page_end = F.col("page_start"), F.col("page_end")
    pdf = F.col("source_type") == "pdf"
    return (
        F.when(
            (or_empty("file_path") != "") & F.col("line").isNotNull(),
            F.concat("file_path", F.lit(":"), F.col("line").cast("string")),
        )
        .when(or_empty("file_path") != "", F.col("file_path"))
        .when(
            pdf & page_start.isNotNull() & page_end.isNotNull(),
            F.concat(F.lit("pp. "), page_start.cast("string"), F.lit("-"), page_end.cast("string")),
        )
        .when(pdf & page_start.isNotNull(), F.concat(F.lit("p. "), page_start.cast("string")))
        .otherwise(F.col("source"))
    )


def truncate_output(c: Column | str, limit: int = vocab.OUTPUT_LIMIT) -> tuple[Column, Column]:
    """Text cut to ``limit`` characters including a hint, and whether it was cut."""
    text = or_empty(c)
    before, after = vocab.OUTPUT_HINT.split("{length}")
    hint = F.concat(F.lit(before), F.length(text).cast("string"), F.lit(after))
    cut = F.length(text) > limit
    short = F.when(F.length(hint) >= limit, F.left(hint, F.lit(limit))).otherwise(
        F.concat(F.left(text, F.lit(limit) - F.length(hint)), hint)
    )
    return F.when(cut, short).otherwise(text), cut


def referenced_names(c: Column | str) -> Column:
    return F.array_distinct(
        F.regexp_extract_all(or_empty(c), F.lit(vocab.IDENTIFIER), F.lit(0))
    )


def lines(c: Column | str) -> Column:
    """Lines of a text; a line end at the very end opens no further line."""

    def drop_last(parts):
        return F.when(
            F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)
        ).otherwise(parts)

    return let(F.split(or_empty(c), vocab.LINE_END), drop_last)


def unify_lines(c: Column | str) -> Column:
    """The text with every kind of line end written as a newline."""
    return F.regexp_replace(or_empty(c), vocab.LINE_END, "\n")


def nonempty_lines(c: Column | str) -> Column:
    return F.filter(F.transform(lines(c), rstrip), lambda x: x != "")


def first_nonempty_line(c: Column | str) -> Column:
    return F.coalesce(F.try_element_at(F.filter(F.transform(lines(c), strip), lambda x: x != ""), F.lit(1)), F.lit(""))


def extract_fenced_block(
    c: Column | str, languages: Iterable[str] = vocab.FENCE_LANGUAGES
) -> Column:
    """Body of the first fenced block, else the whole text."""
    pattern = "(?is)```(?:" + "|".join(languages) + r")?\s*(.*?)```"
    return F.when(
        or_empty(c).rlike(pattern), strip(F.regexp_extract(or_empty(c), pattern, 1))
    ).otherwise(strip(c))


def extract_examples(c: Column | str, prompt: str = vocab.EXAMPLE_PROMPT) -> Column:
    return F.filter(F.transform(lines(c), strip), lambda x: F.startswith(x, F.lit(prompt)))


def safe_int(c: Column) -> Column:
    """Integer or NULL; blanks and garbage are NULL."""
    return strip(c.cast("string")).try_cast("int")


def constant(value, ddl: str) -> Column:
    """Nested configuration as one constant, folded before anything runs."""
    return F.from_json(F.lit(json.dumps(value)), ddl)


def aliases_of(key: Column, aliases: Mapping[str, Iterable[str]]) -> Column:
    table = {k: list(words) for k, words in aliases.items()}
    found = F.element_at(constant(table, "map<string,array<string>>"), key)
    return F.coalesce(found, F.array().cast("array<string>"))
