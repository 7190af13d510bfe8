"""Context items, context blocks, prompts and citations per question.

A question has as many results as its retrieval cap allows (tens of rows),
so per-question arrays stay small by construction.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.functions import text as T
from granary.runtime import let

# ---- fixed values: layouts and limits ------------------------------------------------
ITEM_CHARS = 1600
BLOCK_CHARS = 2200
SEPARATOR = "\n\n---\n\n"
PLAIN_TEMPLATE = "Question:\n{question}\n\nContext:\n{context}\n"


def context_items(
    results: DataFrame, limit: int = ITEM_CHARS, by_source: bool = False
) -> DataFrame:
    """Ranked results as numbered context items.

    ``by_source`` picks the title by source type instead of by the first
    name that is there.
    """
    generated = F.col("source_type") == "generated"
    symbol = F.coalesce(T.blank_to_null("qualname"), T.blank_to_null("symbol_id"))
    section = F.coalesce(T.blank_to_null("section_title"), F.col("source"))
    title = (
        F.when(generated, F.coalesce(symbol, F.lit("unknown_symbol"))).otherwise(section)
        if by_source
        else F.coalesce(symbol, section)
    )
    number = F.row_number().over(Window.partitionBy("question_id").orderBy("rank"))
    return results.select(
        "question_id",
        number.alias("ctx_no"),
        "chunk_id",
        "source_type",
        title.alias("title"),
        T.location_label().alias("location"),
        F.when(generated, F.col("text")).otherwise(F.left("text", F.lit(limit))).alias("text"),
        "score",
    ).withColumn("context_id", F.concat(F.lit("ctx_"), F.col("ctx_no").cast("string")))


def _joined(rows: DataFrame, order: str, block: Column, name: str) -> DataFrame:
    ordered = F.sort_array(F.collect_list(F.struct(F.col(order), block.alias("b"))))
    return rows.groupBy("question_id").agg(
        F.array_join(F.transform(ordered, lambda x: x["b"]), SEPARATOR).alias(name)
    )


def context_block(
    results: DataFrame, pdf_chars: int = BLOCK_CHARS, generated_chars: int = 0
) -> DataFrame:
    """(question_id, context): results as labelled text blocks in rank order."""
    generated, pdf = F.col("source_type") == "generated", F.col("source_type") == "pdf"
    whole = F.col("text") if generated_chars <= 0 else F.left("text", F.lit(generated_chars))
    snippet = F.when(generated, whole).otherwise(F.left("text", F.lit(pdf_chars)))
    first, last = F.col("page_start").cast("string"), F.col("page_end").cast("string")

    def line(label: str, value: Column, test: Column) -> Column:
        return F.when(test & value.isNotNull(), F.concat(F.lit(label), value))

    symbol = F.coalesce(T.blank_to_null("qualname"), T.blank_to_null("symbol_id"))
    block = F.concat_ws(
        "\n",
        F.concat(F.lit("[CHUNK "), F.col("chunk_id").cast("string"), F.lit("]")),
        F.concat(F.lit("Source: "), F.col("source"), F.lit(" ("), F.col("source_type"), F.lit(")")),
        line("Pages: ", F.concat(first, F.lit("-"), last), pdf),
        line("Page: ", first, pdf & last.isNull()),
        line(
            "Section: ",
            F.coalesce(T.blank_to_null("section_title"), F.lit("(section unknown)")),
            pdf,
        ),
        line("Symbol: ", symbol, ~pdf),
        line("Signature: ", T.blank_to_null("signature"), ~pdf),
        line("Module: ", T.blank_to_null("module"), ~pdf),
        line("Kind: ", T.blank_to_null("kind"), ~pdf),
        line("Location: ", T.location_label(), ~pdf),
        F.lit("Text:"),
        snippet,
    )
    return _joined(results, "rank", block, "context")


def four_decimals(score: Column) -> Column:
    """Score text with four decimals; exact halves go to the even digit."""
    exact = score * 32 == F.floor(score * 32)
    return F.format_string("%.4f", F.when(exact, F.bround(score, 4)).otherwise(score))


def item_block(items: DataFrame) -> DataFrame:
    """(question_id, context): the same for context items, with scores."""
    block = F.concat_ws(
        "\n",
        F.concat(F.lit("["), F.col("context_id"), F.lit("]")),
        F.concat(F.lit("source_type: "), F.col("source_type")),
        F.concat(F.lit("title: "), F.col("title")),
        F.concat(F.lit("location: "), F.col("location")),
        F.concat(F.lit("score: "), four_decimals(F.col("score"))),
        F.lit("text:"),
        F.col("text"),
    )
    return _joined(items, "ctx_no", block, "context")


def build_prompts(
    questions: DataFrame, contexts: DataFrame, template: str = PLAIN_TEMPLATE
) -> DataFrame:
    """(question_id, prompt): a template with {question} and {context} filled in.

    Other ``{name}`` slots are filled from columns of ``questions``.
    """
    rows = questions.join(contexts, "question_id", "left")
    slots = {"question": F.col("text"), "context": F.col("context")}
    slots |= {c: F.col(c).cast("string") for c in questions.columns if c not in slots}
    pieces, rest = [], template
    while rest:
        found = [(rest.find("{%s}" % n), n) for n in slots if "{%s}" % n in rest]
        if not found:
            pieces.append(F.lit(rest))
            break
        at, name = min(found)
        pieces += [F.lit(rest[:at]), F.coalesce(slots[name], F.lit(""))]
        rest = rest[at + len(name) + 2 :]
    return rows.select("question_id", F.concat(*pieces).alias("prompt"))


def citations(results: DataFrame) -> DataFrame:
    """(question_id, cite_no, line): distinct citation lines in rank order."""
    pdf = F.col("source_type") == "pdf"
    first, last = F.col("page_start").cast("string"), F.col("page_end").cast("string")
    section = F.coalesce(T.blank_to_null("section_title"), F.lit("unknown"))
    symbol = F.coalesce(
        T.blank_to_null("qualname"), T.blank_to_null("symbol_id"), F.lit("unknown_symbol")
    )
    place = T.location_label()
    where = (
        F.when(
            first.isNotNull() & last.isNotNull(),
            F.concat(F.lit("- pp. "), first, F.lit("-"), last),
        )
        .when(first.isNotNull(), F.concat(F.lit("- p. "), first))
        .otherwise(F.concat(F.lit("- source: "), F.col("source")))
    )
    signed = F.when(
        T.or_empty("signature") != "", F.concat(F.lit(", signature: "), F.col("signature"))
    ).otherwise("")
    line = F.when(pdf, F.concat(where, F.lit(", section: "), section)).otherwise(
        F.concat(F.lit("- symbol: "), symbol, signed, F.lit(", source: "), place)
    )
    key = F.when(
        pdf,
        F.struct(
            F.lit("pdf").alias("a"),
            F.col("source").alias("b"),
            T.or_empty("section_title").alias("c"),
            F.col("page_start").alias("d"),
            F.col("page_end").alias("e"),
        ),
    ).otherwise(
        F.struct(
            F.lit("generated").alias("a"),
            symbol.alias("b"),
            place.alias("c"),
            F.lit(None).cast("int").alias("d"),
            F.lit(None).cast("int").alias("e"),
        )
    )
    first_of = results.groupBy("question_id", key.alias("key")).agg(
        F.min(F.struct(F.col("rank"), line.alias("line"))).alias("r")
    )
    order = Window.partitionBy("question_id").orderBy("r.rank")
    return first_of.select(
        "question_id", F.row_number().over(order).alias("cite_no"), F.col("r.line").alias("line")
    )


def order_cited_first(items: DataFrame, cited: DataFrame) -> DataFrame:
    """Items renumbered: cited ones first, both parts in their old order.

    ``cited``: question_id, context_id.
    """
    marks = cited.select("question_id", "context_id").distinct().withColumn("__c", F.lit(True))
    rows = items.join(marks, ["question_id", "context_id"], "left")
    order = Window.partitionBy("question_id").orderBy(F.col("__c").isNull(), F.col("ctx_no"))
    return rows.withColumn("place", F.row_number().over(order)).drop("__c")


def cite_by_needle(items: DataFrame, needles: Iterable[str]) -> DataFrame:
    """Items whose title, location or text contains any needle."""
    plain = [" ".join(n.lower().split()) for n in needles if n.strip()]
    hay = T.normalize_text(F.concat_ws("\n", "title", "location", "text"))
    return items.filter(
        let(hay, lambda h: F.exists(T.strings(plain), lambda n: F.contains(h, n)))
    )


def valid_citations(responses: DataFrame, items: DataFrame) -> DataFrame:
    """(question_id, cite_no, context_id): cited ids that exist, in cited order.

    ``responses``: question_id, citations_used. ``cite_no`` is the place in
    the response, also for ids after an unknown one.
    """
    cited = responses.select(
        "question_id", F.posexplode("citations_used").alias("__p", "context_id")
    )
    known = items.select("question_id", "context_id")
    return cited.join(known, ["question_id", "context_id"], "left_semi").select(
        "question_id", (F.col("__p") + 1).alias("cite_no"), "context_id"
    )


def citation_lines(valid: DataFrame, items: DataFrame) -> DataFrame:
    """(question_id, cite_no, line): numbered lines of the valid citations."""
    named = valid.join(
        items.select("question_id", "context_id", "title", "location"),
        ["question_id", "context_id"],
    )
    line = F.concat(
        F.lit("- ["), F.col("cite_no").cast("string"), F.lit("] "),
        F.col("title"), F.lit(" ("), F.col("location"), F.lit(")"),
    )
    return named.select("question_id", "cite_no", line.alias("line"))


def chunk_results(results: DataFrame, chunks: DataFrame, columns: Sequence[str] = ()) -> DataFrame:
    """Results joined with the chunk columns, late and on the chunk id only."""
    from granary.schemas import CHUNK_COLUMNS

    wanted = [c for c in (columns or CHUNK_COLUMNS) if c != "chunk_id"]
    return results.join(chunks.select("chunk_id", *wanted), "chunk_id")
