"""Token counts by dynamic programming over a trie of distinct pre-tokens.

Texts are cut into pre-tokens. Each distinct one is inserted in a trie; a node
holds the best unigram score of its prefix and the number of pieces it takes,
computed once from the nodes above it, however many pre-tokens share the
prefix. The count of a pre-token is that of its last node.
"""

from __future__ import annotations

import base64
import math

import regex
from pyspark.sql import DataFrame

from granary.llm.common import map_texts

# Fixed value: the pre-token pattern of the byte-level vocabularies.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Nodes of a task's trie; it is started anew beyond that.
MAX_NODES = 400_000
# Bytes of a pre-token that is inserted in the trie. Longer ones take the same
# steps over the scores of their last bytes only, and leave no nodes.
LONG_WORD = 4_096


def load_ranks(path: str) -> dict[bytes, int]:
    """Pieces with their ranks from a file of lines ``base64 rank``."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


def piece_scores(ranks: dict[bytes, int]) -> dict[bytes, float]:
    """Unigram log probabilities by Zipf's law: a piece is as likely as 1 over its place."""
    total = sum(1.0 / (rank + 1) for rank in ranks.values())
    return {piece: -math.log((rank + 1) * total) for piece, rank in ranks.items()}


def piece_ends(scores: dict[bytes, float]) -> dict[bytes, float | None]:
    """All endings of pieces, with the score of those that are pieces themselves."""
    ends: dict[bytes, float | None] = {}
    for piece in scores:
        for i in range(1, len(piece)):
            ends[piece[i:]] = None
    return ends | scores


class PrefixTrie:
    """Trie of pre-tokens with the forward score and piece count of each prefix.

    Of equal scores the one with the shorter last piece stands. A byte that no
    piece can end at costs ``unknown`` and counts as one piece. A last piece is
    sought backwards from the byte it ends at, as far as any piece has that ending.
    """

    def __init__(self, scores: dict[bytes, float], max_nodes: int = MAX_NODES, long_word: int = LONG_WORD):
        self.ends, self.max_nodes, self.long_word = piece_ends(scores), max_nodes, long_word
        self.longest = max(map(len, scores), default=1)
        self.unknown = min(scores.values(), default=0.0) - 10.0
        self.clear()

    def clear(self) -> None:
        self.edges: dict[int, int] = {}
        self.best, self.pieces = [0.0], [0]

    def count(self, word: bytes) -> int:
        """Pieces of the best segmentation; inserts the nodes that are missing."""
        if len(word) > self.long_word:
            return self.count_long(word)
        edges, best, pieces, ends = self.edges, self.best, self.pieces, self.ends
        node, path = 0, [0]
        for end, byte in enumerate(word, 1):
            key = node << 8 | byte
            below = edges.get(key)
            if below is None:
                top, n = best[node] + self.unknown, pieces[node] + 1
                for start in range(end - 1, max(-1, end - 1 - self.longest), -1):
                    piece = word[start:end]
                    if piece not in ends:
                        break
                    score = ends[piece]
                    if score is not None and best[path[start]] + score > top:
                        top, n = best[path[start]] + score, pieces[path[start]] + 1
                below = edges[key] = len(best)
                best.append(top)
                pieces.append(n)
            node = below
            path.append(node)
        return pieces[node]

    def count_long(self, word: bytes) -> int:
        """The same count without nodes: kept are the prefixes that a last piece can start at."""
        ends, kept = self.ends, self.longest + 1
        best, pieces = [0.0] * kept, [0] * kept
        for end in range(1, len(word) + 1):
            before = (end - 1) % kept
            top, n = best[before] + self.unknown, pieces[before] + 1
            for start in range(end - 1, max(-1, end - 1 - self.longest), -1):
                piece = word[start:end]
                if piece not in ends:
                    break
                score, at = ends[piece], start % kept
                if score is not None and best[at] + score > top:
                    top, n = best[at] + score, pieces[at] + 1
            best[end % kept], pieces[end % kept] = top, n
        return pieces[len(word) % kept]


class _Counts(dict):
    """Counts of known pre-tokens; unknown ones go through the trie."""

    def __init__(self, trie: PrefixTrie):
        super().__init__()
        self.trie = trie

    def __missing__(self, word: str) -> int:
        raw = word.encode("utf-8", "replace")
        if len(raw) > self.trie.long_word:
            return self.trie.count_long(raw)
        if len(self.trie.best) > self.trie.max_nodes:
            self.trie.clear()
            self.clear()
        n = self[word] = self.trie.count(raw)
        return n


class Counter:
    """Pre-tokens and tokens of texts, for the tasks."""

    def __init__(self, scores: dict[bytes, float], pattern: str = PATTERN):
        self.split = regex.compile(pattern).findall
        self.counts = _Counts(PrefixTrie(scores))

    def __call__(self, texts: list[str | None]) -> list[list[int]]:
        words, tokens = [], []
        for text in texts:
            found = self.split(text) if text else []
            words.append(len(found))
            tokens.append(sum(map(self.counts.__getitem__, found)))
        return [words, tokens]


def token_counts(
    docs: DataFrame, vocabulary: str, text: str = "text", keep: list[str] | None = None, pattern: str = PATTERN
) -> DataFrame:
    """``keep`` (all columns by default) plus ``n_pretokens`` and ``n_tokens``.

    ``vocabulary`` is the path of a rank file on the driver; its pieces (a
    fixed list) are broadcast. NULL and empty texts count 0. Counting needs
    no shuffle: every task has a trie of bounded size, which pre-tokens above
    ``LONG_WORD`` bytes do not enter. Input columns named like the new ones are
    replaced.
    """
    scores = docs.sparkSession.sparkContext.broadcast(piece_scores(load_ranks(vocabulary)))
    keep = [c for c in (keep or docs.columns) if c not in ("n_pretokens", "n_tokens")]
    return map_texts(docs, keep, text, lambda: Counter(scores.value, pattern), "n_pretokens long, n_tokens long")
