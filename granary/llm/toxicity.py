"""Toxic spans by a linear-chain conditional random field, aggregated to scores.

Labels are known per document. Words and word beginnings that single out toxic
documents label the tokens of a bounded sample; a two-state chain with hashed
word features is fitted on them in one task, and every text is then scored by
forward-backward marginals next to the data.
"""

from __future__ import annotations

import pickle
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.common import map_texts
from granary.runtime import ship_package

# Bounds of the sample that the model is fitted on: rows of each label, and
# bytes of a text in it. Scoring reads all texts whole.
SAMPLE_ROWS = 2_500
SAMPLE_BYTES = 20_000
# Bytes of word beginnings used as features next to the whole word.
BEGINNINGS = (4, 5, 6, 7, 8)
SEGMENT = 64
STEPS = 80
# Scored documents of about the same length that step together.
TOGETHER = 256
# ... and their words, padded to the longest; longer texts than these step alone,
# so many steps at a time.
CELLS = 1 << 21
LONE_WORDS = 1 << 16
LONE_STEPS = 1 << 16
# Distinct words whose scores a task keeps.
CACHE_WORDS = 400_000
OFFENDING = 0.5

_NOT_LETTERS = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))
_LETTERS = re.compile(r"[a-z\x80-\U0010ffff]+")


def folded(text: str) -> str:
    """Lower case of the same length, so that offsets stay valid."""
    low = text.lower()
    if len(low) == len(text):
        return low
    return "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def words_of(text: str | None) -> list[bytes]:
    """Runs of ASCII letters and non-ASCII characters, lower-cased, as UTF-8."""
    return folded(text or "").encode("utf-8", "replace").translate(_NOT_LETTERS).split()


def feature_hashes(word: bytes) -> list[int]:
    """Hashes of the whole word and of its beginnings; shorter words repeat the word."""
    whole = zlib.crc32(word + b"$")
    return [whole] + [zlib.crc32(word[:n] + b"^") if len(word) > n else whole for n in BEGINNINGS]


# -- the chain -------------------------------------------------------------


def marginals(odds: np.ndarray, moves: np.ndarray, real: np.ndarray | None = None) -> np.ndarray:
    """Probability of the toxic state at each step of (steps, sequences).

    With two states the forward and backward passes need one number per
    sequence, the odds of the toxic state. ``odds`` are the exponentials of
    the emission scores and ``moves`` those of the transition scores. Steps
    that are not ``real`` come after the end of their sequence.
    """
    (stay, enter), (leave, keep) = moves
    ahead, back = np.empty_like(odds), np.ones_like(odds)
    ahead[0] = odds[0] * enter / stay
    for t in range(1, len(odds)):
        before = ahead[t - 1]
        ahead[t] = odds[t] * (enter + keep * before) / (stay + leave * before)
    for t in range(len(odds) - 2, -1, -1):
        after = odds[t + 1] * back[t + 1]
        back[t] = (leave + keep * after) / (stay + enter * after)
        if real is not None:
            back[t][~real[t + 1]] = 1.0
    joint = ahead * back
    return joint / (1.0 + joint)


def _pairs(odds: np.ndarray, moves: np.ndarray, real: np.ndarray) -> np.ndarray:
    """Expected transitions (from, to), summed over (steps, sequences)."""
    (stay, enter), (leave, keep) = moves
    ahead, back = np.empty_like(odds), np.ones_like(odds)
    ahead[0] = odds[0] * enter / stay
    for t in range(1, len(odds)):
        ahead[t] = odds[t] * (enter + keep * ahead[t - 1]) / (stay + leave * ahead[t - 1])
    for t in range(len(odds) - 2, -1, -1):
        after = odds[t + 1] * back[t + 1]
        back[t] = np.where(real[t + 1], (leave + keep * after) / (stay + enter * after), 1.0)
    u, v = ahead[:-1], odds[1:] * back[1:]
    cells = np.stack([stay + 0 * u, enter * v, leave * u, keep * u * v])
    cells /= cells.sum(axis=0)
    first = odds[0] * enter / stay * back[0]
    first = first / (1 + first)
    total = (cells * real[1:]).sum(axis=(1, 2))
    total[0] += (real[0] * (1 - first)).sum()
    total[1] += (real[0] * first).sum()
    return total.reshape(2, 2)


# -- fitting ---------------------------------------------------------------


def _token_labels(docs: list[np.ndarray], toxic: np.ndarray, features: np.ndarray) -> np.ndarray:
    """Words that mark toxic documents: some feature of theirs is significantly
    more frequent in toxic documents, counted once per document."""
    base = toxic.mean()
    width = int(features.max()) + 1
    marked = np.zeros(len(features), bool)
    owner = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
    distinct = np.concatenate(docs)
    for column in features.T:
        seen = np.unique(owner * width + column[distinct])
        feature, is_toxic = seen % width, toxic[seen // width]
        n = np.bincount(feature, minlength=width).astype(float)
        k = np.bincount(feature[is_toxic], minlength=width)
        tested = max(2, int((n >= 3).sum()))
        p = np.clip(k / np.maximum(n, 1), 1e-9, 1 - 1e-9)
        surprise = n * (p * np.log(p / base) + (1 - p) * np.log((1 - p) / (1 - base)))
        marked |= ((p > 0.7) & (surprise > np.log(tested) + 4.0))[column]
    return marked


def _fit_chain(
    sequences: np.ndarray, real: np.ndarray, labels: np.ndarray, features: np.ndarray, steps: int
) -> tuple[np.ndarray, float, np.ndarray]:
    """Weights, bias and transition scores by adaptive gradient ascent with L2.

    ``sequences`` (steps, n) hold word numbers, ``labels`` their 0 or 1.
    """
    width = int(features.max()) + 1
    weights, bias = np.zeros(width), -3.0
    scores = np.zeros((2, 2))
    state = [np.full(width, 1e-4), 1e-4, np.full((2, 2), 1e-4)]
    flat, mask = sequences[real], real
    before, now = labels[:-1][real[1:]], labels[1:][real[1:]]
    seen = np.bincount(2 * before + now, minlength=4).reshape(2, 2).astype(float)
    seen[0] += np.bincount(labels[0][real[0]], minlength=2)
    truth = labels[mask]
    for _ in range(steps):
        emission = np.clip(weights[features].sum(axis=1) + bias, -20, 20)
        odds = np.where(mask, np.exp(emission)[sequences], 1.0)
        moves = np.exp(scores)
        wrong = truth - marginals(odds, moves, real)[mask]
        per_word = np.bincount(flat, wrong, len(features))
        slope = np.bincount(features.ravel(), np.repeat(per_word, features.shape[1]), width) - 0.02 * weights
        slopes = (slope, wrong.sum(), seen - _pairs(odds, moves, real) - 0.1 * scores)
        for i, s in enumerate(slopes):
            state[i] = state[i] + s * s
        weights = weights + 0.3 * slopes[0] / np.sqrt(state[0])
        bias += 0.3 * slopes[1] / np.sqrt(state[1])
        scores = scores + 0.2 * slopes[2] / np.sqrt(state[2])
        scores -= scores[0, 0]
    return weights, float(bias), scores


def _summary(p: np.ndarray) -> list[float]:
    """What the document score is made of: the highest marginal and the expected
    number of offending words, without the dust of clean ones."""
    top = float(np.clip(p.max(), 1e-5, 1 - 1e-5)) if len(p) else 1e-5
    return [1.0, np.log(float(p[p >= 0.1].sum()) + 1e-2), np.log(top / (1 - top))]


def _fit_scale(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Ridge logistic regression by Newton steps that are halved until they help."""
    beta = np.zeros(x.shape[1])
    ridge = np.array([1e-3] + [0.05] * (x.shape[1] - 1))

    def loss(b: np.ndarray) -> float:
        z = x @ b
        return float((np.logaddexp(0, z) - y * z).sum() + (ridge * b * b).sum() / 2)

    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge)
        move = np.linalg.solve(hessian, x.T @ (y - p) - ridge * beta)
        rate, best = 1.0, loss(beta)
        while rate > 1e-6 and loss(beta + rate * move) > best:
            rate /= 2
        beta = beta + rate * move
        if rate * np.abs(move).max() < 1e-6:
            break
    return beta


def fit(texts: list[str | None], toxic: np.ndarray, steps: int = STEPS) -> dict:
    """Model of a labelled sample. Every fourth text only sets the document scale."""
    toxic = np.asarray(toxic, bool)
    numbers: dict[bytes, int] = {}
    docs = [
        np.fromiter((numbers.setdefault(w, len(numbers)) for w in words_of(t)), np.int64) for t in texts
    ]
    hashes = np.array([feature_hashes(w) for w in numbers] or [feature_hashes(b"-")], np.int64)
    keys, features = np.unique(hashes, return_inverse=True)
    features = features.reshape(hashes.shape)
    scale = np.arange(len(docs)) % 4 == 3
    weights, bias, scores = np.zeros(len(keys)), -3.0, np.zeros((2, 2))
    part = [np.unique(d) for d, s in zip(docs, scale) if not s]
    known = toxic[~scale]
    if known.any() and not known.all():
        marked = _token_labels(part, known, features)
        rows, marks = [], []
        for d, t, s in zip(docs, toxic, scale):
            own = marked[d] & t
            if s or (t and not own.any()):
                continue  # a toxic text without a marked word says nothing about its tokens
            for at in range(0, len(d), SEGMENT):
                rows.append(d[at : at + SEGMENT])
                marks.append(own[at : at + SEGMENT])
        if rows:
            sequences = np.zeros((SEGMENT, len(rows)), np.int64)
            labels, real = np.zeros_like(sequences), np.zeros(sequences.shape, bool)
            for i, (r, m) in enumerate(zip(rows, marks)):
                sequences[: len(r), i], labels[: len(r), i], real[: len(r), i] = r, m, True
            weights, bias, scores = _fit_chain(sequences, real, labels, features, steps)
    emission = np.exp(np.clip(weights[features].sum(axis=1) + bias, -20, 20))
    moves = np.exp(scores)
    lines = [_summary(p) for p in _marginals_of([emission[d] for d in docs], moves)]
    use = scale if toxic[scale].any() and not toxic[scale].all() else np.ones(len(docs), bool)
    x, y = np.array(lines or [[1.0, 0, 0]]), toxic.astype(float) if len(docs) else np.zeros(1)
    if len(docs):
        x, y = x[use], y[use]
    beta = _fit_scale(x, y)
    for i in np.nonzero(beta[1:] < 0)[0] + 1:  # more evidence never lowers a score
        x[:, i] = 0.0
        beta = _fit_scale(x, y)
    used = np.abs(weights) > 1e-4
    return {"keys": keys[used], "weights": weights[used], "bias": bias, "scores": scores, "beta": beta}


def _marginals_alone(odds: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Marginals of one very long text, step by step in segments of numbers."""
    (stay, enter), (leave, keep) = moves.tolist()
    ahead, out = np.empty(len(odds)), np.empty(len(odds))
    last = None
    for at in range(0, len(odds), LONE_STEPS):
        steps = []
        for o in odds[at : at + LONE_STEPS].tolist():
            last = o * enter / stay if last is None else o * (enter + keep * last) / (stay + leave * last)
            steps.append(last)
        ahead[at : at + len(steps)] = steps
    back = 1.0
    for at in range((len(odds) - 1) // LONE_STEPS * LONE_STEPS, -1, -LONE_STEPS):
        steps = []
        for o in odds[at : at + LONE_STEPS][::-1].tolist():
            steps.append(back)
            after = o * back
            back = (leave + keep * after) / (stay + enter * after)
        joint = ahead[at : at + len(steps)] * steps[::-1]
        out[at : at + len(steps)] = joint / (1.0 + joint)
    return out


def _marginals_of(odds: list[np.ndarray], moves: np.ndarray) -> list[np.ndarray]:
    """Marginals of texts of any length; texts of similar length step together.

    What steps together is bounded by its padded size, so one long text does
    not stretch the others; a very long one steps alone.
    """
    out: list[np.ndarray] = [np.empty(0)] * len(odds)
    order = sorted((i for i in range(len(odds)) if len(odds[i])), key=lambda i: len(odds[i]))
    while order and len(odds[order[-1]]) > LONE_WORDS:
        i = order.pop()
        out[i] = _marginals_alone(odds[i], moves)
    at = 0
    while at < len(order):
        end = at + 1
        while end < len(order) and end - at < TOGETHER and (end - at + 1) * len(odds[order[end]]) <= CELLS:
            end += 1
        own = order[at:end]
        at = end
        longest = len(odds[own[-1]])
        grid, real = np.ones((longest, len(own))), np.zeros((longest, len(own)), bool)
        for j, i in enumerate(own):
            grid[: len(odds[i]), j] = odds[i]
            real[: len(odds[i]), j] = True
        p = marginals(grid, moves, real)
        for j, i in enumerate(own):
            out[i] = p[: len(odds[i]), j]
    return out


class Scorer:
    """Scores texts with a model; keeps the emission of a bounded number of words."""

    def __init__(self, model: dict):
        # A word without a known feature falls on the sentinel of weight 0.
        self.keys = np.append(model["keys"], 1 << 33)
        self.weights, self.bias = np.append(model["weights"], 0.0), model["bias"]
        self.moves, self.beta = np.exp(model["scores"]), model["beta"]
        self.known: dict[bytes, float] = {}

    def emission(self, words: list[bytes]) -> np.ndarray:
        known = self.known
        new = set(words).difference(known)
        if new:
            if len(known) + len(new) > CACHE_WORDS:
                known.clear()
                new = set(words)
            new = list(new)
            hashes = np.array([feature_hashes(w) for w in new], np.int64)
            at = np.searchsorted(self.keys, hashes)
            weights = np.where(self.keys[at] == hashes, self.weights[at], 0.0)
            score = np.clip(weights.sum(axis=1) + self.bias, -20, 20)
            known.update(zip(new, np.exp(score).tolist()))
        return np.fromiter(map(known.__getitem__, words), np.float64, len(words))

    def __call__(self, texts: list[str | None]) -> tuple[list[float], list[list[int]]]:
        scores, spans = [], []
        for at in range(0, len(texts), TOGETHER * 4):
            part = texts[at : at + TOGETHER * 4]
            odds = [self.emission(words_of(t)) for t in part]
            for text, p in zip(part, _marginals_of(odds, self.moves)):
                value = float(np.dot(_summary(p), self.beta))
                scores.append(1 / (1 + np.exp(-np.clip(value, -30, 30))))
                spans.append(self.offsets(text, p))
        return scores, spans

    @staticmethod
    def offsets(text: str | None, p: np.ndarray) -> list[int]:
        """Start and end (characters) of each run of offending words, flattened."""
        hit = np.nonzero(p >= OFFENDING)[0]
        if not len(hit):
            return []
        found = [m.span() for m in _LETTERS.finditer(folded(text))]
        runs: list[int] = []
        last = -2
        for i in hit:
            start, end = found[i]
            if i == last + 1:
                runs[-1] = end
            else:
                runs += [start, end]
            last = i
        return runs


# -- Spark -----------------------------------------------------------------


def train(
    docs: DataFrame,
    labels: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    sample_rows: int = SAMPLE_ROWS,
    sample_bytes: int = SAMPLE_BYTES,
    steps: int = STEPS,
) -> dict:
    """Fit on at most ``sample_rows`` rows of each label, chosen by a hash of the id.

    Rows without an id, a text or a label of 0 or 1 are not learned from, nor
    are texts above ``sample_bytes``. An id labelled twice counts as toxic if
    any of its labels says so, and of rows that repeat an id the smallest text
    is learned from. Labels are joined to ids first, so only the texts of the
    sample move.
    """
    ship_package()
    known = labels.select(F.col(doc_id).alias("__id"), F.col(label).alias("__toxic")).filter("__toxic IN (0, 1)")
    known = known.groupBy("__id").agg(F.max("__toxic").cast("int").alias("__toxic"))
    short = docs.filter(F.octet_length(F.col(text)) <= sample_bytes).select(F.col(doc_id).alias("__id"))
    turn = F.xxhash64(F.col("__id"), F.lit("sample"))
    found = short.join(known, "__id").select("__id", "__toxic", turn.alias("turn")).distinct()
    chosen = None
    for value in (0, 1):
        part = found.filter(F.col("__toxic") == value).orderBy("turn", "__id").limit(sample_rows)
        chosen = part if chosen is None else chosen.unionAll(part)
    texts = docs.select(F.col(doc_id).alias("__id"), F.col(text).alias("text")).filter(
        F.octet_length("text") <= sample_bytes
    )
    # One text of an id, told before the shuffle: a task sends on as many rows as ids are chosen.
    sample = (
        texts.join(F.broadcast(chosen), "__id")
        .groupBy("__id", "turn", "__toxic")
        .agg(F.min("text").alias("text"))
        .select("turn", "text", "__toxic")
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [b for b in batches if len(b)]
        if not parts:
            return
        rows = pd.concat(parts, ignore_index=True).sort_values(["turn", "text"])
        model = fit(list(rows["text"]), rows["__toxic"].to_numpy() == 1, steps)
        yield pd.DataFrame({"model": [pickle.dumps(model)]})

    found_model = sample.repartition(1).mapInPandas(run, "model binary").collect()
    return pickle.loads(found_model[0]["model"]) if found_model else fit([], np.empty(0, bool))


def score(docs: DataFrame, model: dict, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` (all columns by default) plus ``score`` (0 to 1) and ``spans``.

    Spans are the start and end offsets of offending words, in turn. NULL and
    blank texts get the score of a text without words. Input columns named
    like the new ones are replaced.
    """
    keep = [c for c in (keep or docs.columns) if c not in ("score", "spans")]
    return map_texts(docs, keep, text, lambda: Scorer(model), "score double, spans array<int>")


def drop_toxic(
    docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", above: float = 0.5, **options
) -> DataFrame:
    """Documents that score below ``above``; all columns kept."""
    scored = score(docs, train(docs, labels, doc_id, text, **options), text)
    return scored.filter(F.col("score") < above).select(*docs.columns)
