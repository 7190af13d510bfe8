"""Language identification by rank-order profiles of character n-grams.

The most frequent n-grams of a text, in order, are compared with the profile
of each language: the distance is the sum of how far out of place they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from granary.llm.common import map_texts
from granary.runtime import ship_package

# N-grams in a profile, of a language and of a text.
PROFILE = 400
LONGEST = 3
UNKNOWN = "und"
# A letter's class has ten bits: code points below 768 are their own class,
# the others share 256 classes. Everything but letters is a blank.
CLASS_BITS = 10
# Characters counted at a time while learning.
LEARN_CHARACTERS = 2_000_000


@lru_cache(1)
def letter_classes() -> np.ndarray:
    """Class of each code point below 65,536."""
    table = np.full(1 << 16, 32, np.int32)
    for c in range(1 << 16):
        if chr(c).isalpha():
            table[c] = c if c < 768 else 768 + c % 256
    return table


def classes_of(text: str) -> np.ndarray:
    """Classes of the lower-cased text, with one blank at each end and between words."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    inner = letter_classes()[np.minimum(points, 65_535)]
    for i in np.nonzero(points > 65_535)[0]:  # rare scripts and pictures
        inner[i] = 768 + points[i] % 256 if chr(points[i]).isalpha() else 32
    classes = np.concatenate(([32], inner, [32])).astype(np.int32)
    blank = classes == 32
    return classes[~(blank & np.concatenate(([False], blank[:-1])))]


def grams(classes: np.ndarray, longest: int = LONGEST) -> np.ndarray:
    """Packed n-grams that lie within a word and the blanks around it."""
    blank = classes == 32
    found = [classes[~blank]]
    code = classes
    for n in range(2, longest + 1):
        code = (code[:-1] << CLASS_BITS) | classes[n - 1 :]
        inner = np.zeros(len(code), bool)
        for k in range(1, n - 1):
            inner |= blank[k : k + len(code)]
        found.append(code[~inner])
    return np.concatenate(found)


def ranked(codes: np.ndarray, size: int = PROFILE) -> np.ndarray:
    """Most frequent codes first; ties in code order."""
    values, times = np.unique(codes, return_counts=True)
    if len(values) > size:
        least = np.partition(times, len(times) - size)[len(times) - size]
        values, times = values[times >= least], times[times >= least]
    return values[np.argsort(-times, kind="stable")][:size]


def learn(
    docs: DataFrame, text: str = "text", lang: str = "lang", size: int = PROFILE
) -> dict[str, list[int]]:
    """Ranked n-grams of each language, from the whole texts of all given rows.

    Rows without a text or a language are not learned from. Tasks send the
    counts of their n-grams; a profile has ``size`` entries.
    """
    ship_package()
    rows = docs.select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text")).filter(
        "lang IS NOT NULL AND text IS NOT NULL"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[str, list[np.ndarray]] = {}
        amount: dict[str, int] = {}
        known: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def settle(lang: str) -> None:
            codes, times = np.unique(np.concatenate(waiting.pop(lang)), return_counts=True)
            amount.pop(lang)
            if lang in known:
                both = np.concatenate((known[lang][0], codes))
                sums = np.concatenate((known[lang][1], times))
                codes, where = np.unique(both, return_inverse=True)
                times = np.bincount(where, sums).astype(np.int64)
            known[lang] = codes, times

        for batch in batches:
            for name, body in zip(batch.column(0).to_pylist(), batch.column(1)):
                codes = grams(classes_of(body.as_py()))
                waiting.setdefault(name, []).append(codes)
                amount[name] = amount.get(name, 0) + len(codes)
                if amount[name] >= LEARN_CHARACTERS:
                    settle(name)
        for name in list(waiting):
            settle(name)
        for name, (codes, times) in known.items():
            yield pa.RecordBatch.from_pydict(
                {
                    "lang": pa.array([name] * len(codes), pa.string()),
                    "code": codes.astype(np.int32),
                    "n": times.astype(np.int64),
                }
            )

    counts = rows.mapInArrow(run, "lang string, code int, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "code"))
    top = counts.withColumn("place", place).filter(F.col("place") <= size)
    profiles: dict[str, list[int]] = {}
    for r in top.orderBy("lang", "place").collect():  # size rows per language
        profiles.setdefault(r["lang"], []).append(r["code"])
    return profiles


class Ranker:
    """Out-of-place distances of texts to all profiles at once."""

    def __init__(self, profiles: dict[str, list[int]], size: int = PROFILE):
        self.names, self.size = sorted(profiles), size
        self.codes = np.unique(np.array([c for p in profiles.values() for c in p] or [0], np.int32))
        # The last row is for n-grams of no profile; an absent n-gram is as far as can be.
        self.places = np.full((len(self.codes) + 1, len(self.names)), -1, np.int64)
        for j, name in enumerate(self.names):
            self.places[np.searchsorted(self.codes, np.array(profiles[name], np.int32)), j] = np.arange(
                len(profiles[name])
            )

    def distances(self, own: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.codes, own), len(self.codes) - 1)
        place = self.places[np.where(self.codes[at] == own, at, len(self.codes))]
        moved = np.abs(place - np.arange(len(own))[:, None])
        return np.where(place < 0, self.size, np.minimum(moved, self.size)).sum(axis=0)

    def predict(self, text: str | None) -> tuple[str, float]:
        codes = grams(classes_of(text)) if text else np.empty(0, np.int32)
        if not len(codes) or not self.names:
            return UNKNOWN, 0.0
        own = ranked(codes, self.size)
        far = self.distances(own)
        best = int(far.argmin())
        return self.names[best], float(1.0 - far[best] / (self.size * len(own)))

    def __call__(self, texts: list[str | None]) -> list[list]:
        found = [self.predict(t) for t in texts]
        return [[f[0] for f in found], [f[1] for f in found]]


def identify(
    docs: DataFrame, profiles: dict[str, list[int]], text: str = "text", keep: list[str] | None = None
) -> DataFrame:
    """``keep`` (all columns by default) plus ``lang_pred`` and ``score``.

    The score is 1 minus the distance over the greatest one possible. NULL
    texts and texts without a letter are ``und`` with a score of 0; equal
    distances go to the language that sorts first. Input columns named like
    the new ones are replaced.
    """
    keep = [c for c in (keep or docs.columns) if c not in ("lang_pred", "score")]
    return map_texts(docs, keep, text, lambda: Ranker(profiles), "lang_pred string, score double")
