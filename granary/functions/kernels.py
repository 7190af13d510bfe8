"""Arrow kernels: term counts of texts, posting blocks, and block scoring that
keeps only each task's best rows.

A task holds a score block of at most a few million cells at a time, and
emits at most k rows per query however many chunks it has read. Texts are held
in slices, postings for one id range at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from granary.runtime import text_slices

BLOCK_CELLS = 4_000_000


# Terms whose postings leave a task together.
POSTING_ROWS = 8_192
# Bytes with A-Z lower-cased, and their kind in an identifier: 2 begins one, 1 only goes on.
LOWER = np.frombuffer(bytes(range(256)).lower(), dtype=np.uint8)
KIND = np.zeros(256, dtype=np.int8)
KIND[list(b"abcdefghijklmnopqrstuvwxyz_")] = 2
KIND[list(b"0123456789")] = 1


def _ranked(terms: pa.ChunkedArray) -> tuple[pa.Array, np.ndarray]:
    """Distinct terms in order, and the place of every term among them."""
    if not len(terms):
        return pa.array([], pa.string()), np.empty(0, dtype=np.int64)
    coded = terms.dictionary_encode().unify_dictionaries()
    names = coded.chunk(0).dictionary
    order = pc.sort_indices(names)
    rank = np.empty(len(names), dtype=np.int64)
    rank[order.to_numpy()] = np.arange(len(names))
    return names.take(order), rank[np.concatenate([c.indices.to_numpy() for c in coded.chunks])]


def _tokens(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Identifiers of all texts, lower-cased, and the texts they are from.

    They are ASCII, so the bytes are read: a run of word bytes of one text without
    the digits it begins with.
    """
    raw = [text or b"" for text in texts.cast(pa.binary()).to_pylist()]
    data = LOWER[np.frombuffer(b"".join(raw), dtype=np.uint8)]
    ends = np.cumsum([len(text) for text in raw])
    kind = KIND[data]
    word, place = kind > 0, np.arange(len(data))
    first = word.copy()
    first[1:] &= ~word[:-1]
    cuts = ends[ends < len(data)]
    first[cuts] = word[cuts]
    run = np.maximum.accumulate(np.where(first, place, -1))
    letter = np.maximum.accumulate(np.where(kind == 2, place, -1))
    keep = word & (letter >= run)
    begin = keep.copy()
    begin[1:] &= first[1:] | ~keep[:-1]
    offsets = np.append(np.flatnonzero(begin[keep]), keep.sum()).astype(np.int32)
    found = pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets), pa.py_buffer(data[keep]))
    return found, np.searchsorted(ends, np.flatnonzero(begin), side="right")


def count_kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(chunk_id, counts) of rows (chunk_id, text): what ``term_counts(tokenize(text))`` gives."""
    for batch in batches:
        at = 0
        for texts in text_slices(batch.column(1)):
            found, text = _tokens(texts)
            names, rank = _ranked(pa.chunked_array([found]))
            width = max(1, len(names))
            cells, tfs = np.unique(text * width + rank, return_counts=True)
            ends = np.cumsum(np.bincount(cells // width, minlength=len(texts)))
            pairs = pa.StructArray.from_arrays(
                [names.take(pa.array(cells % width)), pa.array(tfs, pa.int32())], names=["term", "tf"]
            )
            counts = pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pairs)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), counts], names=["chunk_id", "counts"])
            at += len(texts)


def posting_kernel(
    known: pa.Array, idf: np.ndarray
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(term, block, ids, weights) of rows (block, chunk_id, names, tfs, idf) sorted by block.

    ``names`` are terms parted by blanks. Where a row has no idf, its terms are looked
    up among the ``known``, and others left out. Weights are divided by the norm of
    their chunk, all of whose terms are in the block. One block is held at a time;
    its terms come out in order.
    """
    idf = np.append(idf, np.nan)

    def weighed(part: pa.RecordBatch) -> tuple[np.ndarray, pa.Array, np.ndarray]:
        split = pc.split_pattern(part.column(2), " ")
        sizes, terms = pc.list_value_length(split).to_numpy(), split.flatten()
        found = pc.fill_null(pc.index_in(terms, value_set=known), len(idf) - 1).to_numpy()
        own = np.repeat(part.column(4).to_numpy(zero_copy_only=False), sizes)
        own = np.where(np.isnan(own), idf[found], own)
        w = (1.0 + np.log(part.column(3).flatten().to_numpy())) * own
        keep = ~np.isnan(own)
        return np.repeat(part.column(1).to_numpy(), sizes)[keep], terms.filter(pa.array(keep)), w[keep]

    def packed(block: int, rows: list) -> Iterator[pa.RecordBatch]:
        ids, w = np.concatenate([row[0] for row in rows]), np.concatenate([row[2] for row in rows])
        _, own = np.unique(ids, return_inverse=True)
        u = w / np.sqrt(np.bincount(own, w * w))[own]
        names, rank = _ranked(pa.chunked_array([row[1] for row in rows]))
        sort = np.lexsort((ids, rank))
        ids, u = ids[sort], u[sort]
        ends = np.append(0, np.cumsum(np.bincount(rank, minlength=len(names))))
        for at in range(0, len(names), POSTING_ROWS):
            cut = ends[at : at + POSTING_ROWS + 1]
            offsets = pa.array(cut - cut[0], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    names.slice(at, len(cut) - 1),
                    pa.array(np.full(len(cut) - 1, block), pa.int64()),
                    pa.ListArray.from_arrays(offsets, pa.array(ids[cut[0] : cut[-1]], pa.int64())),
                    pa.ListArray.from_arrays(offsets, pa.array(u[cut[0] : cut[-1]], pa.float64())),
                ],
                names=["term", "block", "ids", "weights"],
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, rows = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            blocks = batch.column(0).to_numpy()
            cuts = np.flatnonzero(blocks[1:] != blocks[:-1]) + 1
            for at, end in zip([0, *cuts], [*cuts, len(blocks)]):
                if blocks[at] != place:
                    if rows:
                        yield from packed(place, rows)
                    place, rows = blocks[at], []
                rows.append(weighed(batch.slice(at, end - at)))
        if rows:
            yield from packed(place, rows)

    return run


class BestRows:
    """Running best k (score descending, id ascending) per query of one task."""

    def __init__(self, queries: int, k: int, digits: int):
        self.k, self.digits = k, digits
        self.scores = [np.empty(0) for _ in range(queries)]
        self.ids = [np.empty(0, dtype=np.int64) for _ in range(queries)]

    def add(self, scores: np.ndarray, ids: np.ndarray, positive_only: bool = False) -> None:
        """``scores`` is (rows, queries)."""
        scores = np.round(scores, self.digits)
        for q in range(scores.shape[1]):
            column = scores[:, q]
            known = self.scores[q]
            keep = column > 0 if positive_only else np.ones(len(column), dtype=bool)
            if len(known) == self.k:
                keep &= column >= known[-1]
            if not keep.any():
                continue
            s = np.concatenate([known, column[keep]])
            i = np.concatenate([self.ids[q], ids[keep]])
            order = np.lexsort((i, -s))[: self.k]
            self.scores[q], self.ids[q] = s[order], i[order]

    def batch(self, query_ids: np.ndarray) -> pa.RecordBatch:
        sizes = [len(s) for s in self.scores]
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.repeat(query_ids, sizes), pa.int64()),
                pa.array(np.concatenate(self.ids) if sizes else [], pa.int64()),
                pa.array(np.concatenate(self.scores) if sizes else [], pa.float64()),
            ],
            names=["query_id", "chunk_id", "score"],
        )


def range_kernel(
    width: int, k: int, digits: int
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Best scores of questions in ranges of ``width`` chunk ids.

    Rows (block, part, ids, weights, queries, w) come sorted by block and part: the
    postings of a term in a range and the weights of the term in the questions.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, rows = None, []

        def done() -> pa.RecordBatch:
            names = np.unique(np.concatenate([row[2] for row in rows]))
            scores = np.zeros((width, len(names)))
            for ids, weights, queries, w in rows:
                cells = np.ix_(ids - place[0] * width, np.searchsorted(names, queries))
                scores[cells] += np.outer(weights, w)
            best = BestRows(len(names), k, digits)
            best.add(scores, place[0] * width + np.arange(width), True)
            return best.batch(names)

        for batch in batches:
            keys = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
            lists = [
                (c.flatten().to_numpy(), (c.offsets.to_numpy() - c.offsets[0].as_py()).tolist())
                for c in batch.columns[2:]
            ]
            for i, own in enumerate(keys):
                if own != place:
                    if rows:
                        yield done()
                    place, rows = own, []
                rows.append([values[at[i] : at[i + 1]] for values, at in lists])
        if rows:
            yield done()

    return run


def dense_kernel(
    k: int, digits: int
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Best inner products of question blocks with chunk shards.

    Rows (shard, block, side, id, embedding) come sorted: the questions of a
    block (side 0) before the chunks it meets (side 1).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, ids, rows, best = None, [], [], None
        matrix = np.empty((0, 0))
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(i).to_numpy() for i in range(3)], axis=1)
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            for at, end in zip([0, *cuts], [*cuts, len(keys)]):
                own = tuple(keys[at, :2])
                if own != place:
                    if best is not None:
                        yield best.batch(np.concatenate(ids))
                    place, ids, rows, best = own, [], [], None
                part = batch.slice(at, end - at)
                names = part.column(3).to_numpy()
                values = part.column(4).flatten().to_numpy().reshape(len(names), -1)
                if keys[at, 2] == 0:
                    ids.append(names)
                    rows.append(values)
                    continue
                if not ids:
                    continue
                if best is None:
                    matrix = np.concatenate(rows).T
                    best = BestRows(matrix.shape[1], k, digits)
                step = max(1, BLOCK_CELLS // matrix.shape[1])
                for first in range(0, len(names), step):
                    best.add(values[first : first + step] @ matrix, names[first : first + step])
        if best is not None:
            yield best.batch(np.concatenate(ids))

    return run


class TokenHashEncoder:
    """Deterministic stand-in for an embedding model: hashed token counts.

    Any object with ``encode(list[str]) -> array`` takes its place.
    """

    def __init__(self, width: int = 64):
        self.width = width

    def encode(self, texts: list[str]) -> np.ndarray:
        import hashlib
        import re

        out = np.zeros((len(texts), self.width))
        seen: dict[str, int] = {}
        for row, text in enumerate(texts):
            for token in re.findall("[A-Za-z_][A-Za-z0-9_]*", text):
                token = token.lower()
                slot = seen.get(token)
                if slot is None:
                    slot = int(hashlib.md5(token.encode()).hexdigest()[:2], 16) % self.width
                    seen[token] = slot
                out[row, slot] += 1.0
        return out
