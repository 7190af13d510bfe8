"""Which phrases of a long table occur in which texts, as joins.

A phrase can only occur in a text that has its rarest byte trigram. Texts and
phrases meet by that trigram and are then compared in full, so neither side is
handed to every task and no text meets a phrase it cannot hold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.runtime import let

GRAM = 3


def _grams(raw: Column, size: int) -> Column:
    """Distinct byte strings of a length by their CRC-32; none if ``raw`` is shorter.

    Numbers, as an array of byte strings is made distinct by comparing all of them.
    """
    last = F.octet_length(raw) - (size - 1)
    places = F.when(last > 0, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(places, lambda at: F.crc32(F.substring(raw, at, F.lit(size)))))


def text_grams(texts: DataFrame, sizes: tuple[int, ...] = (1, 2, GRAM)) -> DataFrame:
    """(key, gram) of the distinct byte strings of texts (key, hay)."""
    every = let(
        F.encode("hay", "utf-8"), lambda raw: F.flatten(F.array(*(_grams(raw, size) for size in sizes)))
    )
    # The plain generator would count the grams once more for its filter.
    return texts.select("key", F.explode_outer(every).alias("gram")).filter("gram IS NOT NULL")


def anchors(needles: DataFrame, known: DataFrame) -> DataFrame:
    """(needle, gram): the gram of each needle that the fewest texts have.

    ``needles`` has needle and words, which must all occur. A word shorter than a
    trigram is a gram itself. Needles with a gram that no text has are left out.
    """
    raw = F.encode("word", "utf-8")
    size = F.octet_length(raw)
    own = F.when(size < GRAM, F.array(F.crc32(raw))).otherwise(_grams(raw, GRAM))
    words = needles.select("needle", F.explode("words").alias("word")).filter("word <> ''")
    grams = words.select("needle", F.explode(own).alias("gram")).distinct()
    times = known.join(grams.select("gram").distinct(), "gram", "left_semi").groupBy("gram").agg(F.count("*").alias("n"))
    rated = grams.join(times, "gram", "left").groupBy("needle").agg(
        F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("best")
    )
    return rated.filter("best.n > 0").select("needle", F.col("best.gram").alias("gram"))


def occurrences(texts: DataFrame, needles: DataFrame) -> DataFrame:
    """(key, needle) of the needles all of whose words occur in the text.

    ``texts``: key, hay; ``needles``: needle, words. A needle without words and a
    NULL text occur nowhere and hold nothing. A frequent gram is a skewed key that
    the adaptive join splits.
    """
    known = text_grams(texts)
    pairs = anchors(needles, known).join(known, "gram").select("key", "needle")
    both = pairs.join(needles, "needle").join(texts, "key")
    words = F.filter("words", lambda w: w != "")
    return both.filter(F.forall(words, lambda w: F.contains("hay", w))).select("key", "needle")
