"""Benchmark decontamination: test n-grams looked up in training token windows.

The normalised windows of the benchmark are hashed; training texts are scanned
window by window against that set, hits are verified word for word, and
documents or spans are removed. Built from DataFrame expressions only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.llm.common import row_name
from granary.runtime import materialize

WINDOW = 10
# Distinct window hashes handed to every executor in one pass (12 bytes each
# before the hash map). A larger benchmark is scanned for in several passes.
BROADCAST_WINDOWS = 2_000_000

UPPER = "".join(chr(c) for c in range(ord("A"), ord("Z") + 1))
# ASCII characters that are neither a digit nor a letter end a word.
BREAKS = "".join(chr(c) for c in range(128) if not chr(c).isalnum())
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def item_words(text: Column) -> Column:
    """Words of a text with A-Z lower-cased; NULL and blank texts have none.

    One character map lowers the case and turns every break into a space, so
    the split needs no regular expression.
    """
    plain = F.translate(
        F.coalesce(text, F.lit("")), UPPER + BREAKS, UPPER.lower() + " " * len(BREAKS)
    )
    return F.array_remove(F.split(plain, " "), "")


def _window_hash(words: Column, at: Column, size: int) -> Column:
    return F.xxhash64(*(F.get(words, at + j) for j in range(size)))


def benchmark_windows(
    benchmark: DataFrame, item: str = "item_id", text: str = "text", size: int = WINDOW
) -> DataFrame:
    """Distinct (hash, len, words, item_id) rows of a benchmark table.

    An item of fewer words than ``size`` is one window of its own length; an
    item without words has none.
    """
    rows = (
        benchmark.select(F.col(item).alias("item_id"), item_words(F.col(text)).alias("tokens"))
        .withColumn("len", F.least(F.size("tokens"), F.lit(size)))
        .filter("len > 0")
    )
    pieces = rows.select(
        "item_id",
        "len",
        "tokens",
        F.explode(F.sequence(F.lit(0), F.size("tokens") - F.col("len"))).alias("at"),
    ).withColumn("piece", F.slice("tokens", F.col("at") + 1, F.col("len")))
    hashes = F.coalesce(
        *(
            F.when(F.col("len") == k, _window_hash(F.col("piece"), F.lit(0), k))
            for k in range(1, size + 1)
        )
    )
    # Written once: every pass over the documents reads it several times.
    return materialize(
        pieces.select(
            hashes.alias("hash"), "len", F.concat_ws(" ", "piece").alias("words"), "item_id"
        ).distinct(),
        "windows",
    )


def window_hits(
    docs: DataFrame,
    windows: DataFrame,
    key: list[str],
    text: str = "text",
    broadcast_windows: int = BROADCAST_WINDOWS,
) -> DataFrame:
    """Verified occurrences: the key columns, ``at``, ``len`` and ``item_id``.

    Positions are generated beside the token array and probed against the
    hash set within one stage, so only hits leave it. The set is broadcast in
    parts of bounded size. A hit counts if its words equal the window's.
    """
    lengths = sorted(r["len"] for r in windows.select("len").distinct().collect())  # ten at most
    if not lengths:
        empty = docs.select(*key).limit(0)
        return empty.join(windows.select("item_id"), how="left").select(
            *key, F.lit(0).alias("at"), F.lit(0).alias("len"), "item_id"
        )
    tokens = docs.select(*key, item_words(F.col(text)).alias("tokens"))
    count = F.size("tokens")
    # Outer generators: plain ones infer a filter that computes the tokens twice.
    starts = F.when(count >= lengths[0], F.sequence(F.lit(0), count - lengths[0]))
    placed = tokens.select(*key, "tokens", F.explode_outer(starts).alias("at")).filter(
        "at IS NOT NULL"
    )
    if len(lengths) == 1:
        probed = placed.select(
            *key,
            "tokens",
            "at",
            F.lit(lengths[0]).alias("len"),
            _window_hash(F.col("tokens"), F.col("at"), lengths[0]).alias("hash"),
        )
    else:
        probes = F.array(
            *(
                F.struct(
                    F.lit(k).alias("len"),
                    _window_hash(F.col("tokens"), F.col("at"), k).alias("hash"),
                )
                for k in lengths
            )
        )
        probed = (
            placed.select(*key, "tokens", "at", F.inline_outer(probes))
            .filter(F.col("at") + F.col("len") <= count)
        )
    hashes = windows.select("hash", "len").distinct()
    passes = max(1, -(-hashes.count() // broadcast_windows))
    parts = [
        probed.join(
            F.broadcast(hashes.filter(F.pmod(F.col("hash"), F.lit(passes)) == part)),
            ["hash", "len"],
        )
        for part in range(passes)
    ]
    hits = reduce(DataFrame.unionAll, parts).withColumn(
        "words", F.concat_ws(" ", F.slice("tokens", F.col("at") + 1, F.col("len")))
    )
    return hits.drop("tokens").join(windows, ["hash", "len", "words"]).select(
        *key, "at", "len", "item_id"
    )


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    size: int = WINDOW,
    broadcast_windows: int = BROADCAST_WINDOWS,
) -> DataFrame:
    """One row per document row: words, hit words and the items they come from.

    Columns ``doc_id, n_words, n_hit, n_items, items_sha256, contaminated,
    hit_words``; ``hit_words`` lists the 0-based places of hit words. NULL and
    empty texts have no words and no hits. Rows that repeat an id or a whole
    document get a result each. Items without an id are matched but not
    listed; repeated items count once. Other columns are not read.
    """
    return _contamination(docs, benchmark, doc_id, text, item, item_text, size, broadcast_windows).drop("__row")


def _contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    size: int = WINDOW,
    broadcast_windows: int = BROADCAST_WINDOWS,
) -> DataFrame:
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), row_name(doc_id, text).alias("__row"))
    windows = benchmark_windows(benchmark, item, item_text, size)
    hits = window_hits(rows, windows, ["__row"], "text", broadcast_windows)
    found = hits.groupBy("__row").agg(
        F.collect_set(F.struct("at", "len")).alias("__places"),
        F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("__items"),
    )
    covered = F.array_sort(
        F.array_distinct(
            F.flatten(
                F.transform("__places", lambda p: F.sequence(p["at"], p["at"] + p["len"] - 1))
            )
        )
    )
    counted = rows.select("doc_id", "__row", F.size(item_words(F.col("text"))).cast("long").alias("n_words"))
    joined = counted.join(
        found.select("__row", covered.alias("__covered"), "__items"), "__row", "left"
    )
    none = F.array().cast("array<int>")
    return joined.select(
        "__row",
        "doc_id",
        "n_words",
        F.coalesce(F.size("__covered"), F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce(F.size("__items"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("__items", ","), F.lit("")), 256).alias("items_sha256"),
        F.col("__covered").isNotNull().alias("contaminated"),
        F.coalesce("__covered", none).alias("hit_words"),
    )


def remove_documents(
    docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", **options
) -> DataFrame:
    """Documents without a hit, all columns kept."""
    rows = docs.withColumn("__row", row_name(doc_id, text))
    windows = benchmark_windows(
        benchmark,
        options.get("item", "item_id"),
        options.get("item_text", "text"),
        options.get("size", WINDOW),
    )
    hits = window_hits(
        rows.select("__row", F.col(text).alias("text")),
        windows,
        ["__row"],
        "text",
        options.get("broadcast_windows", BROADCAST_WINDOWS),
    )
    return rows.join(hits.select("__row").distinct(), "__row", "left_anti").select(*docs.columns)


def remove_spans(
    docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", **options
) -> DataFrame:
    """Documents with hit words cut out, each with the break that follows it.

    All columns are kept; texts without a hit are unchanged.
    """
    found = _contamination(docs, benchmark, doc_id, text, **options).filter("contaminated")
    rows = docs.withColumn("__row", row_name(doc_id, text))
    # Rows that repeat id and text have the same hits.
    cuts = found.groupBy("__row").agg(F.first("hit_words").alias("__cut"))
    words = F.regexp_extract_all(F.col(text), F.lit(f"({WORD})"), F.lit(1))
    gaps = F.split(F.col(text), WORD)
    kept = F.transform(
        words,
        lambda w, i: F.when(F.array_contains("__cut", i), F.lit("")).otherwise(
            F.concat(w, F.get(gaps, i + 1))
        ),
    )
    cleaned = F.concat(F.get(gaps, F.lit(0)), F.array_join(kept, ""))
    return (
        rows.join(cuts, "__row", "left")
        .withColumn(text, F.when(F.col("__cut").isNull(), F.col(text)).otherwise(cleaned))
        .select(*docs.columns)
    )
