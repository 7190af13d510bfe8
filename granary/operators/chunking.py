"""Pages, symbols, markdown and narratives to chunks."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary import vocab
from granary.functions import text as T
from granary.runtime import let, materialize, ship_package, with_position
from granary.schemas import CHUNK_COLUMNS, chunk_row

CHUNK_CHARS = 3500
OVERLAP_CHARS = 400
API_CHUNK_CHARS = 2400
API_OVERLAP_CHARS = 250
PAGE_COST = 20  # characters charged per page for its marker line
PAGE_BLOCK = 4_096
CARRY_BLOCK = 65_536


# ---- pages -----------------------------------------------------------------


def detect_section_title(text: Column | str) -> Column:
    """First heading among the first 35 lines of a page, else ''."""
    number, chapter = "(?U)" + vocab.NUMBERED_HEADING, "(?U)" + vocab.CHAPTER_HEADING
    head = F.filter(
        F.transform(F.slice(T.lines(text), 1, 35), T.strip),
        lambda x: (x != "")
        & (F.length(x) <= 140)
        & ~(
            (F.upper(x) == x)
            & (F.lower(x) != x)
            & (F.size(F.split(x, vocab.SPACE_CLASS + "+")) > 10)
        ),
    )
    found = F.transform(
        head,
        lambda x: F.when(
            x.rlike(number),
            F.concat(
                F.regexp_extract(x, number, 1), F.lit(" "), T.strip(F.regexp_extract(x, number, 2))
            ),
        ).when(x.rlike(chapter), x),
    )
    return F.coalesce(
        F.try_element_at(F.filter(found, lambda x: x.isNotNull()), F.lit(1)), F.lit("")
    )


def carry_forward_section(
    pages: DataFrame, title: str = "section_title", block: int = CARRY_BLOCK
) -> DataFrame:
    """Pages without a title inherit the last one before them in their document.

    A document is cut into blocks of pages. Each block is filled on its own;
    what it inherits comes from a window over one row per block, so a
    document of any length never sits in one task.
    """
    own = T.blank_to_null(title)
    blocked = pages.withColumn("__b", F.floor(F.col("page") / block))
    inside = Window.partitionBy("doc_id", "__b").orderBy("page")
    before = (
        Window.partitionBy("doc_id").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    )
    ends = blocked.groupBy("doc_id", "__b").agg(
        F.max(F.when(own.isNotNull(), F.struct("page", own.alias("t")))).alias("last")
    )
    carried = ends.select(
        "doc_id", "__b", F.last("last.t", ignorenulls=True).over(before).alias("__carry")
    )
    filled = blocked.withColumn("__own", F.last(own, ignorenulls=True).over(inside))
    return (
        filled.join(carried, ["doc_id", "__b"])
        .withColumn(title, F.coalesce("__own", "__carry", F.lit("")))
        .drop("__b", "__own", "__carry")
    )


def _page_steps(
    lengths: np.ndarray, chunk_chars: int, overlap: int
) -> tuple[np.ndarray, np.ndarray]:
    """End and next start of the chunk that would begin at each page."""
    at = np.arange(len(lengths))
    cost = np.concatenate([[0], np.cumsum(lengths + PAGE_COST)])
    raw = np.concatenate([[0], np.cumsum(lengths)])
    end = np.maximum(at + 1, np.searchsorted(cost, cost[at] + chunk_chars, "right") - 1)
    back = np.minimum(np.searchsorted(raw, raw[end] - overlap, "right") - 1, end)
    return end, np.maximum(np.maximum(back, at), at + 1)


def page_ranges(
    pages: DataFrame,
    chunk_chars: int = CHUNK_CHARS,
    overlap_chars: int = OVERLAP_CHARS,
    block: int = PAGE_BLOCK,
) -> DataFrame:
    """(doc_id, chunk_no, page_start, page_end): greedy packing of whole pages.

    Where a chunk may begin depends on all chunks before it, but each step
    looks at few pages. Long documents are cut into blocks of pages (plus the
    pages a chunk may reach into). Every block first tabulates, for each page
    it can be entered at, where it is left and how many chunks that makes; a
    fold over these small tables gives the true entries, and the blocks emit
    their chunks in parallel.
    """
    ship_package()
    ahead = math.ceil(chunk_chars / PAGE_COST) + 2
    block = max(block, 2 * ahead)
    lengths = pages.select(
        "doc_id",
        (F.col("page") - 1).cast("bigint").alias("at"),
        F.length(T.or_empty("text")).cast("bigint").alias("n"),
    ).withColumn("block", F.floor(F.col("at") / block))
    reach = (F.col("at") % block < ahead) & (F.col("block") > 0)
    spans = lengths.withColumn(
        "block",
        F.explode(
            F.when(reach, F.array("block", F.col("block") - 1)).otherwise(F.array("block"))
        ),
    )

    # One row per block: page lengths only, at most a block and its reach long.
    ordered = F.array_sort(F.collect_list(F.struct("at", "n")))
    blocks = materialize(
        spans.groupBy("doc_id", "block").agg(ordered["n"].alias("lengths")), "page-blocks"
    )

    def walk_table(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for doc_id, number, lengths_ in frame.itertuples(index=False):
                count = len(lengths_)
                inner, last = min(block, count), count < block + ahead
                end, nxt = _page_steps(np.asarray(lengths_), chunk_chars, overlap_chars)
                leave = np.full(inner, -1, dtype=np.int64)
                made = np.ones(inner, dtype=np.int64)
                for i in range(inner - 1, -1, -1):
                    if last and end[i] >= count:
                        continue  # last chunk of the document
                    if nxt[i] >= inner:
                        leave[i] = number * block + nxt[i]
                    else:
                        leave[i], made[i] = leave[nxt[i]], 1 + made[nxt[i]]
                size = min(inner, ahead + 1)
                rows.append((doc_id, number, leave[:size], made[:size]))
            yield pd.DataFrame(rows, columns=["doc_id", "block", "leave", "made"])

    def fold(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        entry, first = 0, 0
        rows = []
        for number, leave, made in (
            frame.sort_values("block")[["block", "leave", "made"]].itertuples(index=False)
        ):
            offset = entry - int(number) * block
            rows.append((key[0], int(number), entry, first))
            first, entry = first + int(made[offset]), int(leave[offset])
            if entry < 0:
                break
        return pd.DataFrame(rows, columns=["doc_id", "block", "entry", "first"])

    def emit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for doc_id, number, lengths_, entry, first_ in frame.itertuples(index=False):
                base, count = number * block, len(lengths_)
                last = count < block + ahead
                end, nxt = _page_steps(np.asarray(lengths_), chunk_chars, overlap_chars)
                at = entry - base
                while at < min(block, count):
                    rows.append((doc_id, first_, base + at + 1, base + int(end[at])))
                    if last and end[at] >= count:
                        break
                    at, first_ = int(nxt[at]), first_ + 1
            yield pd.DataFrame(rows, columns=["doc_id", "chunk_no", "page_start", "page_end"])

    later = (
        blocks.join(blocks.filter("block > 0").select("doc_id").distinct(), "doc_id", "left_semi")
        .select("doc_id", "block", "lengths")
        .mapInPandas(
            walk_table, "doc_id bigint, block bigint, leave array<bigint>, made array<bigint>"
        )
        .groupBy("doc_id")
        .applyInPandas(fold, "doc_id bigint, block bigint, entry bigint, first bigint")
        .filter("block > 0")
    )
    zero = F.lit(0).cast("bigint")
    entered = blocks.filter("block = 0").select(
        "doc_id", "block", "lengths", zero.alias("entry"), zero.alias("first")
    )
    entered = entered.unionByName(blocks.join(later, ["doc_id", "block"]))
    return entered.mapInPandas(
        emit, "doc_id bigint, chunk_no bigint, page_start int, page_end int"
    )


def pack_pages(
    pages: DataFrame,
    chunk_chars: int = CHUNK_CHARS,
    overlap_chars: int = OVERLAP_CHARS,
    block: int = PAGE_BLOCK,
) -> DataFrame:
    """Chunks of whole pages (pages are numbered from 1 in each document)."""
    ranges = page_ranges(pages, chunk_chars, overlap_chars, block)
    wanted = ranges.withColumn("page", F.explode(F.sequence("page_start", "page_end")))
    parts = F.sort_array(
        F.collect_list(
            F.struct("page", T.or_empty("text").alias("text"), "section_title")
        )
    )
    packed = (
        wanted.join(pages.select("doc_id", "page", "text", "section_title"), ["doc_id", "page"])
        .groupBy("doc_id", "chunk_no", "page_start", "page_end")
        .agg(parts.alias("parts"))
    )
    blocks = F.transform(
        "parts",
        lambda p: F.concat(F.lit("[PAGE "), p["page"].cast("string"), F.lit("]\n"), p["text"]),
    )
    titles = F.filter(F.col("parts.section_title"), lambda t: t != "")
    return packed.select(
        "doc_id",
        "chunk_no",
        "page_start",
        "page_end",
        F.array_join(blocks, "\n\n").alias("text"),
        F.coalesce(F.try_element_at(titles, F.lit(1)), F.lit("")).alias("section_title"),
    )


def page_chunks(packed: DataFrame, source: Column | str) -> DataFrame:
    """Packed pages as chunk rows, keyed by (doc_id, chunk_no)."""
    return packed.select(
        "doc_id",
        "chunk_no",
        *chunk_row(
            text=F.col("text"),
            source=T.col(source),
            source_type=F.lit("pdf"),
            page_start=F.col("page_start"),
            page_end=F.col("page_end"),
            section_title=F.col("section_title"),
        ),
    )


# ---- symbols ------------------------------------------------------------------


def render_symbol_chunks(symbols: DataFrame, source: str = "symbols.jsonl") -> DataFrame:
    """Symbol records as chunks: a labelled text block per symbol."""
    name, ident = T.strip("qualname"), T.strip("id")
    module, kind, signature = T.strip("module"), T.strip("kind"), T.strip("signature")
    summary, docstring = T.strip("summary"), T.strip("docstring")
    examples = F.filter(
        F.transform(F.coalesce("examples", F.array().cast("array<string>")), T.strip),
        lambda x: x != "",
    )
    unknown = F.lit("unknown")
    display = F.coalesce(T.blank_to_null(name), T.blank_to_null(ident), F.lit("unknown_symbol"))

    def labelled(label: str, value: Column) -> Column:
        return F.when(value != "", F.concat(F.lit(label), value))

    keys = F.concat_ws(
        " ", *[T.blank_to_null(part) for part in (ident, name, signature, module)]
    )
    text = F.concat_ws(
        "\n",
        F.concat(F.lit("Symbol: "), display),
        F.concat(F.lit("ID: "), F.coalesce(T.blank_to_null(ident), display)),
        F.concat(F.lit("Module: "), F.coalesce(T.blank_to_null(module), unknown)),
        F.concat(F.lit("Kind: "), F.coalesce(T.blank_to_null(kind), unknown)),
        F.concat(F.lit("Signature: "), F.coalesce(T.blank_to_null(signature), unknown)),
        labelled("Summary: ", summary),
        labelled("Docstring:\n", docstring),
        let(
            examples,
            lambda e: F.when(
                F.size(e) > 0,
                F.concat(
                    F.lit("Examples:\n"),
                    F.array_join(
                        F.transform(F.slice(e, 1, 10), lambda x: F.concat(F.lit("- "), x)), "\n"
                    ),
                ),
            ),
        ),
        labelled("Search keys: ", keys),
    )
    counted = F.nullif(F.coalesce(F.col("example_count"), F.lit(0)), F.lit(0))
    return symbols.select(
        *chunk_row(
            text=T.strip(text),
            source=F.lit(source),
            source_type=F.lit("generated"),
            section_title=module,
            symbol_id=ident,
            module=module,
            qualname=name,
            signature=signature,
            kind=kind,
            file_path=T.strip("file_path"),
            line=F.col("line"),
            summary=summary,
            example_count=F.coalesce(counted, F.size(examples)),
        )
    )


# ---- markdown --------------------------------------------------------------------


def split_markdown_sections(
    docs: DataFrame, text: str = "text", default_title: str = "API Reference"
) -> DataFrame:
    """One row per ``## `` section: doc_id, section_no, title, body."""
    pieces = F.split(T.unify_lines(text), r"(?md)^(?=## )")
    heading = F.regexp_extract("piece", r"(?d)\A(.*)", 1)
    title = F.btrim(T.strip(F.ltrim(heading, F.lit("#"))), F.lit("`"))
    return (
        docs.select("doc_id", F.posexplode_outer(pieces).alias("section_no", "piece"))
        .select(
            "doc_id",
            "section_no",
            F.when(F.startswith("piece", F.lit("## ")), title)
            .otherwise(F.lit(default_title))
            .alias("title"),
            T.strip("piece").alias("body"),
        )
        .filter("body <> ''")
    )


def fixed_windows(text: Column | str, size: int, overlap: int) -> Column:
    """Array of character windows, stripped, blank ones dropped.

    The text is cut once into strides and each window joins the strides it
    covers, so the work is linear in the text however long it is.
    """
    step = max(size - overlap, 1)
    covers = math.ceil(size / step)
    value = T.or_empty(text)
    strides = F.regexp_extract_all(value, F.lit(f"(?s).{{1,{step}}}"), F.lit(0))
    beyond = F.ceil((F.length(value) - size) / F.lit(step)).cast("int")
    last = F.greatest(beyond, F.lit(0))
    windows = let(
        strides,
        lambda s: F.transform(
            F.sequence(F.lit(0), last),
            lambda i: T.strip(
                F.left(F.array_join(F.slice(s, i + 1, F.lit(covers)), ""), F.lit(size))
            ),
        ),
    )
    return F.filter(windows, lambda w: w != "")


def api_reference_chunks(
    docs: DataFrame,
    source: Column | str,
    size: int = API_CHUNK_CHARS,
    overlap: int = API_OVERLAP_CHARS,
) -> DataFrame:
    """Markdown reference as module chunks, keyed by (doc_id, chunk_no)."""
    windows = F.posexplode_outer(fixed_windows("body", size, overlap)).alias("__w", "text")
    cut = split_markdown_sections(docs).select("doc_id", "section_no", "title", windows)
    cut = cut.filter("text IS NOT NULL")
    order = F.col("section_no") * F.lit(1 << 31).cast("bigint") + F.col("__w")
    return cut.select(
        "doc_id",
        order.alias("chunk_no"),
        *chunk_row(
            text=F.col("text"),
            source=T.col(source),
            source_type=F.lit("generated"),
            section_title=F.col("title"),
            module=F.col("title"),
            kind=F.lit("module_reference"),
        ),
    )


# ---- narratives --------------------------------------------------------------------


def _windows_at_breaks(text: str, size: int, overlap: int, separator: str) -> list[str]:
    out, start = [], 0
    while start < len(text):
        end = min(len(text), start + size)
        if end < len(text):
            pause = text.rfind(separator, start + size // 2, end)
            end = pause if pause > start else end
        piece = text[start:end].strip()
        if piece:
            out.append(piece)
        if end >= len(text):
            break
        start = max(end - overlap, start + 1)
    return out


def paragraph_windows(
    text: Column, size: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS, separator: str = "\n\n"
) -> Column:
    """Windows that end at the last paragraph break of their second half.

    Each window start depends on the previous break, hence the Arrow function;
    only texts longer than one window are sent to Python.
    """

    @F.pandas_udf("array<string>")
    def cut(values: pd.Series) -> pd.Series:
        return values.map(
            lambda v: None if v is None else _windows_at_breaks(v, size, overlap, separator)
        )

    ship_package()
    long = F.length(text) > size
    return F.when(long, cut(F.when(long, text))).otherwise(F.array(text))


def narrative_windows(
    narratives: DataFrame,
    source: str = "narratives.jsonl",
    size: int = CHUNK_CHARS,
    overlap: int = OVERLAP_CHARS,
    separator: str = "\n\n",
) -> DataFrame:
    """Narrative sections as chunks with a header; rows without text or id drop."""
    ident, title, module = T.strip("section_id"), T.strip("section_title"), T.strip("module")
    origin = T.strip("source_file")
    refs = F.coalesce("resolved_symbol_ids", F.array().cast("array<string>"))
    header = F.concat_ws(
        "\n",
        F.concat(F.lit("Narrative: "), title),
        F.concat(F.lit("Module: "), F.coalesce(T.blank_to_null(module), F.lit("unknown"))),
        F.when(origin != "", F.concat(F.lit("Source: "), origin)),
        F.when(
            F.size(refs) > 0,
            F.concat(F.lit("Related symbols: "), F.array_join(F.slice(refs, 1, 15), ", ")),
        ),
    )
    full = F.concat(header, F.lit("\n\n"), T.strip("text"))
    rows = narratives.filter((T.strip("text") != "") & (ident != "")).select(
        ident.alias("section_id"),
        title.alias("title"),
        module.alias("module"),
        origin.alias("origin"),
        full.alias("full"),
        *(["position"] if "position" in narratives.columns else []),
    )
    cut = rows.withColumn("parts", paragraph_windows(F.col("full"), size, overlap, separator))
    part = cut.select("*", F.posexplode_outer("parts").alias("chunk_no", "piece"))
    part = part.filter("piece IS NOT NULL")
    sub_id = F.when(F.col("chunk_no") == 0, F.col("section_id")).otherwise(
        F.concat("section_id", F.lit(":"), F.col("chunk_no").cast("string"))
    )
    return part.select(
        "chunk_no",
        *(["position"] if "position" in narratives.columns else []),
        *chunk_row(
            text=F.col("piece"),
            source=F.lit(source),
            source_type=F.lit("narrative"),
            section_title=F.col("title"),
            symbol_id=sub_id,
            module=F.col("module"),
            kind=F.lit("narrative"),
            file_path=F.col("origin"),
        ),
    )


# ---- chunk tables -----------------------------------------------------------------------

SOURCE_ORDER = ("generated", "api", "narrative", "pdf")


def chosen_sources(mode: str, tables: dict[str, DataFrame]) -> list[str]:
    """Names of the chunk tables a source mode asks for, in the order of their chunks."""
    wanted = {
        "pdf": ("pdf",),
        "generated": ("generated", "api", "narrative"),
        "both": SOURCE_ORDER,
    }
    if mode not in wanted:
        raise ValueError(f"unsupported source mode: {mode}")
    names = [name for name in wanted[mode] if name in tables]
    if not names:
        raise ValueError("no chunk table given for this source mode")
    return names


def select_sources(mode: str, **tables: DataFrame) -> DataFrame:
    """Union of the chunk tables a source mode asks for.

    ``tables`` maps generated, api, narrative and pdf to chunk rows with
    ``doc_id`` and ``chunk_no``; the result carries their order.
    """
    parts = [
        tables[name].withColumn("source_order", F.lit(SOURCE_ORDER.index(name)))
        for name in chosen_sources(mode, tables)
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def assign_chunk_ids(rows: DataFrame) -> DataFrame:
    """Contiguous ids from 0 in the order (source_order, doc_id, chunk_no)."""
    numbered = with_position(
        rows.drop("chunk_id"), ["source_order", "doc_id", "chunk_no"], "chunk_id"
    )
    return numbered.select(*CHUNK_COLUMNS)
