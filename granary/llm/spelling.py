"""Spelling variants: words one edit apart, found over a reduced alphabet.

Letters are hashed to a few symbols, so that many words share a reduced form
and a reduced form has few one-edit neighbours. The whole neighbourhood of every
reduced form is generated once and joined with the reduced vocabulary; the words
behind two neighbouring forms are then compared as they are written.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.runtime import at_most, materialize, ship_package

# Symbols that letters are hashed to: fewer make neighbourhoods small, more make
# reduced forms rarer and so leave fewer words to compare.
SYMBOLS = 4
MIN_LENGTH = 7
MIN_COUNT = 2
# A form is used at least so many times as often as its variant.
RATIO = 10
# One in so many distinct words of a document loses a letter.
EVERY = 31
# Words a task counts before it hands them on, and neighbours made at a time.
COUNTED = 400_000
NEIGHBOURS = 1 << 20
# Reduced forms handed to every executor; more are joined by a shuffle.
BROADCAST_FORMS = 1_000_000
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
# Base of the rolling hash of reduced forms, and its inverse modulo 2**64.
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)


def damaged(run: str, crc: int, every: int) -> str:
    """The run, or without one of its code points if ``every`` divides ``crc``."""
    if crc % every:
        return run
    at = crc % len(run)
    return run[:at] + run[at + 1 :]


def count_words(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_length: int = MIN_LENGTH, every: int = EVERY
) -> DataFrame:
    """``word, n``: occurrences of every word of all texts of at least ``min_length`` letters.

    Words are maximal runs of letters A-Z, a-z and U+00C0 to U+00FF, of which only
    A-Z are lower-cased. A word loses one letter in the documents that the CRC-32 of
    id and word picks. NULL texts have no words; a NULL id counts as empty.
    Tasks add up what they read before it is shuffled.
    """
    ship_package()
    rows = docs.select(
        F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("id"), F.col(text).cast("string").alias("text")
    ).filter("text IS NOT NULL")
    # Longer runs are found whole, shorter ones cannot grow.
    find = re.compile("[a-zÀ-ÿ]{%d,}" % min_length).findall

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()

        def flush() -> pa.RecordBatch:
            made = [pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())]
            counts.clear()
            return pa.RecordBatch.from_arrays(made, names=["word", "n"])

        for batch in batches:
            for i, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                lowered = value.as_buffer().to_pybytes().translate(_LOWER).decode("utf-8", "replace")
                start = zlib.crc32(f"{i}:".encode())
                for word, n in Counter(find(lowered)).items():
                    word = damaged(word, zlib.crc32(word.encode(), start), every)
                    if len(word) >= min_length:
                        counts[word] += n
                if len(counts) >= COUNTED:
                    yield flush()
        if counts:
            yield flush()

    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


# -- reduced forms ---------------------------------------------------------


def reduce_letters(word: str, symbols: int = SYMBOLS) -> np.ndarray:
    """Symbols 1 to ``symbols`` of the letters of a word."""
    points = np.frombuffer(word.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    mixed = (points * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(40)
    return mixed % np.uint64(symbols) + np.uint64(1)


def _powers(n: int) -> np.ndarray:
    powers = np.full(n + 1, _BASE, np.uint64)
    powers[0] = 1
    return np.multiply.accumulate(powers)


def form_hash(reduced: np.ndarray) -> np.ndarray:
    """Rolling hash of reduced forms of one length, one a row."""
    return (reduced * _powers(reduced.shape[1])[:-1]).sum(axis=1, dtype=np.uint64)


def neighbourhood(reduced: np.ndarray, symbols: int = SYMBOLS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and hashes of all forms at most one edit from the rows of ``reduced``.

    A hash is a sum over places, so a form with one symbol deleted, replaced or
    inserted is hashed from the sums before and after the place. Some forms come
    more than once. Places are taken a stripe at a time.
    """
    rows, length = reduced.shape
    powers = _powers(length)
    before = np.zeros((rows, length + 1), np.uint64)
    np.cumsum(reduced * powers[:-1], axis=1, out=before[:, 1:])
    whole = before[:, -1:]
    yield np.arange(rows), whole[:, 0]
    step = max(1, NEIGHBOURS // max(1, rows * (2 * symbols + 1)))
    for at in range(0, length + 1, step):
        here = slice(at, min(at + step, length + 1))
        inside = slice(at, min(at + step, length))
        first, power = before[:, here], powers[here]
        made = [first + np.uint64(s) * power + (whole - first) * np.uint64(_BASE) for s in range(1, symbols + 1)]
        if inside.stop > inside.start:
            own = reduced[:, inside]
            made.append(before[:, inside] + (whole - before[:, inside.start + 1 : inside.stop + 1]) * np.uint64(_BACK))
            for turn in range(1, symbols):
                other = (own - np.uint64(1) + np.uint64(turn)) % np.uint64(symbols) + np.uint64(1)
                made.append(whole + (other - own) * powers[inside])
        keys = np.concatenate(made, axis=1)
        yield np.repeat(np.arange(rows), keys.shape[1]), keys.reshape(-1)


def _by_length(words: list[str], symbols: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and reduced forms of words of one length each, in bounded groups."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    for length in np.unique(lengths).tolist():
        places = np.nonzero(lengths == length)[0]
        step = max(1, NEIGHBOURS // max(1, length))
        for at in range(0, len(places), step):
            own = places[at : at + step]
            yield own, reduce_letters("".join(words[i] for i in own), symbols).reshape(len(own), length)


def with_form(words: DataFrame, symbols: int = SYMBOLS) -> DataFrame:
    """``word, n`` and the hash ``r`` of the reduced form."""
    ship_package()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = np.zeros(batch.num_rows, np.uint64)
            for own, reduced in _by_length(batch.column(0).to_pylist(), symbols):
                hashes[own] = form_hash(reduced)
            made = [batch.column(0), batch.column(1), pa.array(hashes.view(np.int64))]
            yield pa.RecordBatch.from_arrays(made, names=["word", "n", "r"])

    return words.select("word", "n").mapInArrow(run, "word string, n long, r long")


def form_neighbours(forms: DataFrame, symbols: int = SYMBOLS) -> DataFrame:
    """``r, key``: the one-edit neighbourhood of every reduced form, given by a word of it."""
    ship_package()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column(0).to_numpy()
            for own, reduced in _by_length(batch.column(1).to_pylist(), symbols):
                wide = max(1, NEIGHBOURS // (reduced.shape[1] * (2 * symbols + 1)))
                for at in range(0, len(own), wide):
                    for rows, keys in neighbourhood(reduced[at : at + wide], symbols):
                        made = [pa.array(names[own[at + rows]]), pa.array(keys.view(np.int64))]
                        yield pa.RecordBatch.from_arrays(made, names=["r", "key"])

    return forms.select("r", "word").mapInArrow(run, "r long, key long")


# -- near words ------------------------------------------------------------


def one_edit(a: str, b: str) -> Column:
    """Whether two columns differ by one code point inserted, deleted or replaced."""
    close = F.abs(F.length(a) - F.length(b)) <= 1
    return close & (F.col(a) != F.col(b)) & (F.levenshtein(F.col(a), F.col(b), 1) == 1)


def near_words(words: DataFrame, symbols: int = SYMBOLS, broadcast_forms: int = BROADCAST_FORMS) -> DataFrame:
    """Pairs ``a, n_a, b, n_b`` of distinct words (``word, n, r``) one edit apart, each once.

    Two words one edit apart have reduced forms at most one edit apart, so no pair
    is missed; words are compared in full. Forms meet by name; neither the words of
    a form nor the forms next to one are collected into a row, so a skewed form is
    split by the adaptive join.
    """
    forms = materialize(words.groupBy("r").agg(F.min("word").alias("word")), "reduced-forms")
    known = forms.select(F.col("r").alias("key"))
    if at_most(forms, broadcast_forms):
        known = F.broadcast(known)
    met = form_neighbours(forms, symbols).join(known, "key", "left_semi")
    pairs = met.select(F.least("r", "key").alias("r"), F.greatest("r", "key").alias("key")).distinct()
    pairs = materialize(pairs, "form-pairs")
    left = words.select("r", F.col("word").alias("a"), F.col("n").alias("n_a"))
    right = words.select(F.col("r").alias("key"), F.col("word").alias("b"), F.col("n").alias("n_b"))
    both = pairs.join(left, "r").join(right, "key")
    once = (F.col("r") != F.col("key")) | (F.col("a") < F.col("b"))
    return both.filter(once & one_edit("a", "b")).select("a", "n_a", "b", "n_b")


def follow(forms: DataFrame, rounds: int = 64) -> DataFrame:
    """``word, root`` of every row ``word, form``: the last word that forms lead to.

    Each round doubles the steps taken. Forms are used ever more often, so they do
    not lead back.
    """
    roots = materialize(forms.select("word", F.col("form").alias("root")), "word-roots")
    for _ in range(rounds):
        ahead = roots.select(F.col("word").alias("root"), F.col("root").alias("far"))
        step = roots.join(ahead, "root", "left").select("word", F.coalesce("far", "root").alias("root"), "far")
        roots = materialize(step, "word-roots")
        if not roots.filter("far IS NOT NULL").limit(1).count():
            return roots.select("word", "root")
        roots = roots.select("word", "root")
    raise RuntimeError(f"forms did not end in {rounds} rounds")


def spelling_groups(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    min_length: int = MIN_LENGTH,
    min_count: int = MIN_COUNT,
    ratio: int = RATIO,
    every: int = EVERY,
    symbols: int = SYMBOLS,
) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every word of the corpus.

    Words have at least ``min_length`` letters and ``min_count`` occurrences in all
    texts (``count_words``). A word's form is the near word that is used most (the
    smallest of equals) if it is used ``ratio`` times as often, else NULL; ``root``
    is where forms lead to. Repeated rows count as often as they come, empty tables
    and NULL texts give no words, and other columns are not read.
    """
    counted = count_words(docs, doc_id, text, min_length, every).filter(F.col("n") >= min_count)
    words = materialize(with_form(counted, symbols), "words")
    near = near_words(words, symbols)
    sides = F.array(
        F.struct(F.col("a").alias("word"), F.col("n_a").alias("n"), F.col("b").alias("other"), F.col("n_b").alias("m")),
        F.struct(F.col("b").alias("word"), F.col("n_b").alias("n"), F.col("a").alias("other"), F.col("n_a").alias("m")),
    )
    best = F.min(F.struct((-F.col("m")).alias("less"), "other"))
    summed = near.select(F.inline(sides)).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    most = -F.col("best.less")
    is_form = most >= ratio * F.col("n")
    placed = words.select("word", "n").join(summed, "word", "left")
    placed = materialize(
        placed.select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(is_form, F.col("best.other")).alias("form"),
            F.when(is_form, most).alias("form_n"),
        ),
        "near-counts",
    )
    roots = follow(placed.filter("form IS NOT NULL").select("word", "form"))
    return placed.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
