"""SimHash near-duplicates with bit-sliced comparison.

Fingerprints are made of word shingles, equal ones collapse, and the others
are compared inside blocks that share some of their bits. A block stores its
fingerprints as vertical bit planes: one XOR per plane compares a fingerprint
with 64 others, carry-save counters add the differing bits up, and a block is
abandoned once all its distances exceed the radius. Links are joined into
components with Spark.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.llm.common import map_texts, row_name
from granary.llm.components import connected_components
from granary.llm.lshforest import BRANCH_PAIRS, across, branch_regions, tile_links
from granary.runtime import at_most, materialize, ship_package

SHINGLE = 4
RADIUS = 4
SEED = 42
BITS = 64
# Fingerprints expected in one block; more bits are shared where there are more rows.
BLOCK_ROWS = 4_096
# Blocks with more rows than this (copies that differ a little) are compared
# tile by tile.
TILE_ROWS = 4_096
# Shingle hashes turned into bits at a time.
HASH_ROWS = 1 << 15
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Fingerprint of a text; zero if it has no word.

    A-Z are lower-cased, words end at white space, and every occurrence of a
    shingle votes. A bit is set if more than half the votes set it.
    """
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[: n - 1] + 1)).tolist()
    stops = ends[-n:].tolist()
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(BITS, np.int64)
    for at in range(0, n, HASH_ROWS):
        spans = zip(starts[at : at + HASH_ROWS], stops[at : at + HASH_ROWS])
        hashes = np.fromiter((digest(line[i:j], SEED) for i, j in spans), np.uint64)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(
            axis=0, dtype=np.int32
        )
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``doc_id, fp`` (fp as a signed long) of every row. NULL and blank texts get 0."""
    def kernel():
        def make(texts: list[str | None]) -> list[np.ndarray]:
            made = np.fromiter((fingerprint(t, shingle) for t in texts), np.uint64, len(texts))
            return [made.view(np.int64)]

        return make

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return map_texts(rows, ["doc_id"], "text", kernel, "fp long")


# -- candidate blocks ------------------------------------------------------


def block_masks(rows: int, radius: int = RADIUS, block_rows: int = BLOCK_ROWS) -> list[int]:
    """Bit masks such that two fingerprints within ``radius`` agree on one of them.

    The bits are cut into radius + k pieces; two fingerprints within the
    radius differ in at most ``radius`` pieces, so they agree on some k. k is
    the least that leaves about ``block_rows`` per block of ``rows`` spread
    ones. The result of the comparison does not depend on k.
    """
    for k in range(1, BITS - radius + 1):
        if rows >> (BITS * k // (radius + k)) <= block_rows or k == 4:
            break
    edges = [BITS * i // (radius + k) for i in range(radius + k + 1)]
    pieces = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
    return [sum(chosen) for chosen in itertools.combinations(pieces, k)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


# -- bit-sliced comparison -------------------------------------------------


def bit_planes(lanes: np.ndarray) -> np.ndarray:
    """Vertical planes of (blocks, 64 w) values: word w of plane b holds bit b of 64 values."""
    blocks, width = lanes.shape
    bits = np.unpackbits(lanes.reshape(-1, 1).view(np.uint8), axis=1, bitorder="little")
    planes = np.ascontiguousarray(bits.reshape(blocks, width, BITS).transpose(2, 0, 1))
    return np.packbits(planes, axis=2, bitorder="little").view("<u8")


def near(
    queries: np.ndarray, block: np.ndarray, lanes: np.ndarray, used: np.ndarray, radius: int = RADIUS
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (query index, lane index within its block) within ``radius``, by stripes.

    ``lanes`` are (blocks, 64 w) values of which ``used`` count; a query meets
    the lanes of its own block. Each plane is XORed with the query's bit and
    added to a counter that is itself held in bit planes; ``over`` collects
    the carries that leave it. The counter starts such that it overflows just
    past the radius. After every eight planes the queries whose lanes are all
    over the radius are abandoned.
    """
    planes = bit_planes(lanes)
    words = planes.shape[2]
    ones = ~np.uint64(0)
    closed = ~np.packbits(used, axis=1, bitorder="little").view("<u8")
    width = radius.bit_length()
    room = (1 << width) - 1 - radius
    stripe = max(1, (1 << 14) // words)
    for first in range(0, len(queries), stripe):
        own = np.arange(first, min(first + stripe, len(queries)))
        wanted, home = queries[own], block[own]
        over = closed[home]
        counter = [np.full(over.shape, ones if room >> i & 1 else 0, np.uint64) for i in range(width)]
        for b in range(BITS):
            bit = -((wanted >> np.uint64(b)) & np.uint64(1)).astype(np.int64)
            carry = planes[b][home] ^ bit.view(np.uint64)[:, None]
            for i in range(width):
                counter[i], carry = counter[i] ^ carry, counter[i] & carry
            over |= carry
            if b % 8 == 7:
                alive = (over != ones).any(axis=1)
                if not alive.any():
                    break
                if alive.mean() < 0.7:
                    own, wanted, home, over = own[alive], wanted[alive], home[alive], over[alive]
                    counter = [c[alive] for c in counter]
        else:
            rows, cols = np.nonzero(over != ones)
            left = (~over[rows, cols]).astype("<u8")
            which, bit = np.nonzero(np.unpackbits(left.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
            yield own[rows[which]], cols[which] * 64 + bit


def absorb(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after joining the given pairs; a label is the least index joined."""
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return label
        a, b = a[apart], b[apart]
        parent = np.arange(len(label))
        np.minimum.at(parent, np.maximum(x[apart], y[apart]), np.minimum(x[apart], y[apart]))
        while True:
            further = parent[parent]
            if (further == parent).all():
                break
            parent = further
        label = parent[label]


def block_links(groups: list[tuple[np.ndarray, int]], radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that span the near pairs of some blocks of about the same length.

    A block is (values, split): with split 0 all its pairs are compared, else
    the first ``split`` values against the others. At most one link per value
    is returned, however many pairs are near.
    """
    width = -(-max(len(v) for v, _ in groups) // 64) * 64
    lanes = np.zeros((len(groups), width), np.uint64)
    used = np.zeros((len(groups), width), bool)
    queries, block, place = [], [], []
    for i, (values, split) in enumerate(groups):
        lanes[i, : len(values)] = values
        used[i, split : len(values)] = True
        n = split or len(values)
        queries.append(values[:n])
        block.append(np.full(n, i))
        place.append(np.arange(n))
    queries, block, place = map(np.concatenate, (queries, block, place))
    label = np.arange(lanes.size)
    for q, lane in near(queries, block, lanes, used, radius):
        label = absorb(label, block[q] * width + place[q], block[q] * width + lane)
    joined = np.nonzero(label != np.arange(lanes.size))[0]
    flat = lanes.reshape(-1)
    return flat[joined], flat[label[joined]]


# -- Spark plan ------------------------------------------------------------


def _compare(radius: int):
    """Reads rows sorted by block and compares whole blocks, many small ones at once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting: dict[int, list] = {}
        words: dict[int, int] = {}

        def flush(size: int) -> pd.DataFrame:
            a, b = block_links(waiting.pop(size), radius)
            words.pop(size)
            return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

        def close(values: list[np.ndarray], second: list[np.ndarray]) -> int | None:
            """Queue a block; the class of blocks that is ready, if any."""
            fps, other = np.concatenate(values).view(np.uint64), np.concatenate(second)
            if len(fps) < 2 or (other.any() and other.all()):
                return None
            split = 0
            if other.any():  # two tiles: the first against the second
                order = np.argsort(other, kind="stable")
                fps, split = fps[order], int((~other).sum())
            size = (len(fps) - 1) // 64
            size = 1 << size.bit_length()
            waiting.setdefault(size, []).append((fps, split))
            words[size] = words.get(size, 0) + size
            return size if words[size] >= 1 << 12 else None

        last, values, second = None, [], []
        for batch in batches:
            keys = batch[["t", "key", "lo", "hi"]].to_numpy(np.int64)
            fps, is_second = batch["fp"].to_numpy(np.int64), batch["second"].to_numpy(bool)
            cuts = np.nonzero((keys[1:] != keys[:-1]).any(axis=1))[0] + 1
            for i, j in zip([0, *cuts], [*cuts, len(keys)]):
                own = tuple(keys[i])
                if last is not None and own != last:
                    ready = close(values, second)
                    if ready is not None:
                        yield flush(ready)
                    values, second = [], []
                last = own
                values.append(fps[i:j])
                second.append(is_second[i:j])
        if values:
            close(values, second)
        for size in list(waiting):
            yield flush(size)

    return run


def _tiled(keyed: DataFrame, name: str, tile_rows: int) -> DataFrame:
    """Blocks ``t, key`` of rows cut into tiles: ``lo, hi`` name the two tiles that
    meet and ``second`` tells which a row belongs to."""
    heavy = materialize(
        keyed.groupBy("t", "key")
        .count()
        .filter(F.col("count") > tile_rows)
        .select("t", "key", F.ceil(F.col("count") / tile_rows).cast("int").alias("tiles")),
        "heavy-blocks",
    )
    tile = F.pmod(F.xxhash64(name), F.col("tiles")).cast("int")
    return (
        keyed.join(heavy, ["t", "key"], "left")
        .withColumn("tiles", F.coalesce("tiles", F.lit(1)))
        .withColumn("tile", tile)
        .select(name, "t", "key", "tile", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other"))
        .select(
            "t",
            "key",
            F.least("tile", "other").alias("lo"),
            F.greatest("tile", "other").alias("hi"),
            (F.col("tile") > F.col("other")).alias("second"),
            name,
        )
    )


def fingerprint_links(
    fps: DataFrame, radius: int = RADIUS, block_rows: int = BLOCK_ROWS, tile_rows: int = TILE_ROWS
) -> DataFrame:
    """Links ``a, b`` that connect all fingerprints within ``radius`` of each other.

    ``fps`` has distinct ``fp`` longs. All pairs that agree on one of the
    masks are compared; blocks above ``tile_rows`` are cut into tiles by a
    hash, and each two tiles meet in a block of their own, so no task holds
    more than two tiles.
    """
    ship_package()
    masks = block_masks(fps.count(), radius, block_rows)
    blocks = F.array(
        *(
            F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key"))
            for t, m in enumerate(masks)
        )
    )
    keyed = fps.select("fp", F.inline(blocks))
    dealt = _tiled(keyed, "fp", tile_rows)
    n = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    block = ["t", "key", "lo", "hi"]
    return (
        dealt.repartition(n, *block)
        .sortWithinPartitions(*block)
        .mapInPandas(_compare(radius), "a long, b long")
    )


def simhash_groups(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    shingle: int = SHINGLE,
    radius: int = RADIUS,
    block_rows: int = BLOCK_ROWS,
    tile_rows: int = TILE_ROWS,
) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every row.

    Texts link if their fingerprints differ in at most ``radius`` bits; the
    component is the smallest id reachable. NULL and blank texts have the
    fingerprint zero and link like others. Rows without an id take part, but
    never name a component unless it has no other; repeated rows are returned
    as often as they come. Other columns are not read.
    """
    marked = materialize(fingerprints(docs, doc_id, text, shingle), "fingerprints")
    distinct = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct-fingerprints")
    links = materialize(fingerprint_links(distinct.select("fp"), radius, block_rows, tile_rows), "links")
    roots = connected_components(links)
    placed = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root")
    )
    names = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = placed.join(names, "root").select("fp", "component_id")
    return marked.join(classes, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


# -- similarity of word sets -----------------------------------------------

# Words of 64 bits in a fingerprint that names candidates of a similarity.
WIDE = 8
WIDE_SHINGLE = 5
SIMILARITY = 0.8
# Chance that two texts of just the similarity share a block.
RECALL = 0.999
# Standard deviations that the distance of a candidate may lie above its mean.
DEVIATIONS = 3.5
WIDE_BLOCK_ROWS = 512
# Fingerprints of few shingles say little: texts of so many meet by their rarest
# shingles instead, which leaves out no pair.
FEW = 32
# Candidate texts handed to every executor to fetch their shingles.
BROADCAST_TEXTS = 2_000_000


def shingle_hashes(text: str | None, shingle: int = WIDE_SHINGLE) -> np.ndarray:
    """Sorted hashes of the distinct shingles of a text; none without a word."""
    tokens = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not tokens:
        return np.empty(0, np.uint64)
    n = max(1, len(tokens) - shingle + 1)
    line = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate(([0], ends[: n - 1] + 1)).tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(line[i:j], SEED) for i, j in zip(starts, ends[-n:].tolist())), np.uint64, n))


def set_name(base: np.ndarray) -> bytes:
    """128-bit name of a shingle set."""
    return xxhash.xxh3_128_digest(base.tobytes(), SEED)


def wide_fingerprint(base: np.ndarray, words: int = WIDE) -> bytes:
    """Fingerprint of ``words`` times 64 bits over the distinct shingles of a text."""
    ones = np.zeros(BITS * words, np.int64)
    step = HASH_ROWS // words
    for at in range(0, len(base), step):
        # Further hashes by mixing the first.
        mixed = base[at : at + step, None] + np.arange(words, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        mixed = (mixed ^ (mixed >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        mixed = (mixed ^ (mixed >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        mixed ^= mixed >> np.uint64(31)
        bits = np.unpackbits(mixed.view(np.uint8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int32)
    return np.packbits(2 * ones > len(base), bitorder="little").tobytes()


def differing_part(similarity: float) -> float:
    """Expected part of differing bits of two sets of a Jaccard similarity."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def sampled_bits(rows: int, similarity: float, words: int = WIDE, block_rows: int = WIDE_BLOCK_ROWS) -> np.ndarray:
    """Bit positions (tables, bits) of the blocks: as many bits as leave about
    ``block_rows`` of ``rows`` in a block, as many tables as the recall needs."""
    bits = max(1, math.ceil(math.log2(max(2, rows / block_rows))))
    agree = (1 - differing_part(similarity)) ** bits
    tables = math.ceil(math.log(1 - RECALL) / math.log(1 - agree)) if agree < 1 else 1
    draw = np.random.default_rng(SEED)
    return np.stack([draw.choice(BITS * words, bits, replace=False) for _ in range(tables)])


def _wide_compare(first_radius: int, radius: int, similarity: float, positions: np.ndarray | None):
    """Bit-sliced comparison of the first 64 bits, then all bits of the pairs that remain.

    Without ``positions`` a block returns each text with the first of its neighbours,
    else its texts that have a neighbour of another root, if that pair shares no block
    of the tables before.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stars = positions is None
        masks = [] if stars else [
            np.packbits(np.isin(np.arange(BITS * WIDE), bits), bitorder="little").view(np.uint64) for bits in positions
        ]

        def pairs(rows: list[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            block = pd.concat(rows).sort_values(["second", "node"])
            second = block["second"].to_numpy(bool)
            if len(block) < 2 or second.all():
                return
            roots = pd.factorize(block["root"])[0]
            if not roots.any():
                return
            names, sizes = block["node"].to_numpy(), block["size"].to_numpy(np.int64)
            fps = np.frombuffer(b"".join(block["wide"]), np.uint64).reshape(len(names), -1)
            split = int((~second).sum()) if second.any() else 0
            n, width = len(fps), -(-len(fps) // 64) * 64
            lanes, used = np.zeros((1, width), np.uint64), np.zeros((1, width), bool)
            lanes[0, :n] = fps[:, 0]
            used[0, split:n] = True
            queries = fps[: split or n, 0]
            rank = np.argsort(np.argsort(names, kind="stable"), kind="stable")
            first = np.full(n, n)
            for q, lane in near(queries, np.zeros(len(queries), np.int64), lanes, used, first_radius):
                small, large = np.minimum(sizes[q], sizes[lane]), np.maximum(sizes[q], sizes[lane])
                asked = (roots[q] != roots[lane]) & (small >= similarity * large - 1e-9)
                if not split:  # each pair comes twice
                    asked &= q < lane
                q, lane = q[asked], lane[asked]
                close = np.bitwise_count(fps[q] ^ fps[lane]).sum(axis=1) <= radius
                q, lane = q[close], lane[close]
                for mask in masks[: block["t"].iat[0]]:
                    met = ((fps[q] ^ fps[lane]) & mask).any(axis=1)
                    q, lane = q[met], lane[met]
                np.minimum.at(first, q, rank[lane])
                np.minimum.at(first, lane, rank[q])
            found = np.nonzero(first < n)[0]
            if len(found) and not stars:
                yield pd.DataFrame({"t": block["t"].iat[0], "key": block["key"].iat[0], "id": names[found]})
            elif len(found):
                yield pd.DataFrame({"a": names[found], "b": names[np.argsort(rank)[first[found]]]})

        last, rows = None, []
        for batch in batches:
            keys = batch[["t", "key", "lo", "hi"]].to_numpy(np.int64)
            cuts = np.nonzero((keys[1:] != keys[:-1]).any(axis=1))[0] + 1
            for i, j in zip([0, *cuts], [*cuts, len(keys)]):
                if last is not None and tuple(keys[i]) != last:
                    yield from pairs(rows)
                    rows = []
                last = tuple(keys[i])
                rows.append(batch.iloc[i:j])
        if rows:
            yield from pairs(rows)

    return run


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def wide_pairs(
    rooted: DataFrame,
    positions: np.ndarray,
    similarity: float,
    stars: bool,
    words: int = WIDE,
    tile_rows: int = TILE_ROWS,
) -> DataFrame:
    """Candidates of texts (``node, root, size, wide``) by their fingerprints.

    With ``stars`` pairs ``a, b`` of each text and one neighbour of each block, else
    ``key, id`` of the blocks in which a text has neighbours of another root. Each
    pair of neighbours meets in the first block that they share; it is not named.
    """
    ship_package()
    part = differing_part(similarity)

    def radius_of(bits: int) -> int:
        return int(bits * part + DEVIATIONS * math.sqrt(bits * part * (1 - part)))

    def name_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = np.uint64(1) << np.arange(positions.shape[1], dtype=np.uint64)
        for batch in batches:
            if not batch.num_rows:
                continue
            node, wide = batch.column(0), batch.column(1)
            raw = np.frombuffer(b"".join(wide.to_pylist()), np.uint8).reshape(batch.num_rows, -1)
            bits = np.unpackbits(raw, axis=1, bitorder="little").astype(np.uint64)
            for t, chosen in enumerate(positions):
                keys = (bits[:, chosen] * weights).sum(axis=1).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [node, pa.array(np.full(len(keys), t, np.int32)), pa.array(keys)], names=["node", "t", "key"]
                )

    keyed = rooted.select("node", "wide").mapInArrow(name_blocks, "node binary, t int, key long")
    block = ["t", "key", "lo", "hi"]
    n = int(rooted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = (
        _tiled(keyed, "node", tile_rows)
        .join(rooted, "node")
        .repartition(n, *block)
        .sortWithinPartitions(*block)
        .mapInPandas(
            _wide_compare(radius_of(BITS), radius_of(BITS * words), similarity, None if stars else positions),
            "a binary, b binary" if stars else "t int, key long, id binary",
        )
    )
    # Keys of a table are hashed with it; blocks that this made one would just meet as one.
    return _ordered(found) if stars else found.select(F.xxhash64("t", "key").alias("key"), "id").distinct()


def rarest_shingles(sets: DataFrame, similarity: float) -> DataFrame:
    """``key, node, size`` of the rarest shingles of ``sets`` (node, size, hashes).

    Of a set of n as many as n minus the least that a similar set shares, and
    one: in any one order of all shingles, two similar sets share one of these.
    """
    each = sets.select("node", "size", F.explode("hashes").alias("key"))
    times = each.groupBy("key").agg(F.count("*").alias("times")).filter("times > 1")
    shared = F.ceil(similarity * F.col("size") - 1e-9).cast("int")
    # A shingle of one text comes before all others and meets nobody.
    ranked = (
        each.join(times, "key")
        .groupBy("node", "size")
        .agg(F.sort_array(F.collect_list(F.struct("times", "key"))).alias("known"))
        .withColumn("left", F.col("size") - shared + 1 - (F.col("size") - F.size("known")))
        .filter("left > 0")
    )
    return ranked.select("node", "size", F.explode(F.slice("known", F.lit(1), F.col("left"))).alias("k")).select(
        F.col("k.key").alias("key"), "node", "size"
    )


def _alike_sizes(a: str, b: str, similarity: float) -> Column:
    return F.least(a, b) >= similarity * F.greatest(a, b) - 1e-9


def similar_sets(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs ``a, b`` whose shingle sets (``node, hashes``) have the Jaccard similarity."""

    def side(name: str) -> DataFrame:
        return sets.select(F.col("node").alias(name), F.col("hashes").alias(f"set_{name}"))

    both = pairs.join(side("a"), "a").join(side("b"), "b")
    common = F.size(F.array_intersect("set_a", "set_b"))
    whole = F.size("set_a") + F.size("set_b")
    # The common part of the union, without a division that rounds.
    return both.filter(common >= similarity * (whole - common) - 1e-9).select("a", "b")


def similar_links(
    docs: DataFrame, nodes: DataFrame, text: str, shingle: int, similarity: float, tile_rows: int = TILE_ROWS
) -> DataFrame:
    """Links ``a, b`` that connect distinct texts (``node, row, size, wide``) of the similarity.

    Fingerprints and rare shingles only name candidates; every link is
    verified on its shingle sets. First each text meets one neighbour of each
    block, then those that this left in different components meet each other:
    in small blocks pair by pair, in others as tiles of whole sets, so that no
    list of pairs grows with the square of a block.
    """

    def kernel():
        def make(texts: list[str | None]) -> list[list]:
            bases = [shingle_hashes(t, shingle) for t in texts]
            return [[set_name(b) for b in bases], [b.view(np.int64) for b in bases]]

        return make

    def sets_of(rows: DataFrame, name: str) -> DataFrame:
        """``node, hashes`` of the texts in ``rows``, read again from the documents."""
        wanted = rows.select(F.col("row").alias("__row"))
        few = at_most(wanted, BROADCAST_TEXTS)
        own = docs.select(row_name("doc_id", text).alias("__row"), F.col(text).alias("text")).join(
            F.broadcast(wanted) if few else wanted, "__row", "left_semi"
        )
        made = map_texts(own, [], "text", kernel, "node binary, hashes array<long>")
        return materialize(made.dropDuplicates(["node"]), name)

    reach = math.floor(FEW / similarity + 1e-9)
    short = nodes.filter((F.col("size") > 0) & (F.col("size") <= reach))
    brief = sets_of(short, "brief-sets").withColumn("size", F.size("hashes"))
    members = materialize(rarest_shingles(brief, similarity), "rare-shingles")
    heads = members.groupBy("key").agg(F.min("node").alias("head"), F.count("*").alias("n"))
    members = materialize(members.join(heads.filter("n > 1").drop("n"), "key"), "rare-buckets")
    sizes = nodes.select(F.col("node").alias("head"), F.col("size").alias("size_head"))
    exact = members.filter("head <> node").join(sizes, "head").filter(_alike_sizes("size", "size_head", similarity))

    long = nodes.filter(F.col("size") > FEW)
    positions = sampled_bits(long.count(), similarity)
    alone = long.select("node", F.col("node").alias("root"), "size", "wide")
    wide = materialize(wide_pairs(alone, positions, similarity, True, tile_rows=tile_rows), "wide-stars")
    stars = materialize(
        _ordered(exact.select(F.col("head").alias("a"), F.col("node").alias("b")).unionByName(wide)), "near-stars"
    )
    met = stars.select(F.col("a").alias("node")).union(stars.select("b")).distinct()
    # A text whose bucket's head is of another size has not met it, but may meet others.
    met = materialize(met.union(members.select("node")).distinct(), "met")
    sets = sets_of(nodes.join(met, "node", "left_semi"), "near-sets")
    first = materialize(similar_sets(stars, sets, similarity), "first-links")
    roots = materialize(connected_components(first), "first-roots")

    def rooted(rows: DataFrame, node: str, name: str) -> DataFrame:
        known = roots.select(F.col("node").alias("__n"), F.col("root").alias("__r"))
        joined = rows.join(known, F.col(node) == F.col("__n"), "left")
        return joined.withColumn(name, F.coalesce("__r", node)).drop("__n", "__r")

    again = rooted(long.join(met, "node", "left_semi").select("node", "size", "wide"), "node", "root")
    open_ = wide_pairs(again, positions, similarity, False, tile_rows=tile_rows)
    blocks = open_.unionByName(members.select("key", F.col("node").alias("id")))
    regions = materialize(branch_regions(rooted(blocks, "id", "root")), "open-blocks")
    # Few pairs of a block are named; larger blocks are compared tile by tile.
    few = F.col("n") * F.col("others") <= BRANCH_PAIRS
    percent = round(100 * similarity, 6)
    named = across(regions.filter(few), nodes.select(F.col("node").alias("id"), "size"), percent)
    rest = named.join(stars, ["a", "b"], "left_anti")
    second = similar_sets(rest, sets, similarity)
    large = regions.filter(~few)
    if large.limit(1).count():
        known = sets.select(F.col("node").alias("id"), "hashes")
        second = second.unionByName(tile_links(large, known, percent))
    return first.unionByName(materialize(second, "second-links"))


def similarity_groups(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    shingle: int = WIDE_SHINGLE,
    similarity: float = SIMILARITY,
) -> DataFrame:
    """``doc_id, row, component_id, stays`` of texts linked by the similarity of their shingle sets.

    Every link has the Jaccard similarity. Pairs of texts of up to ``FEW``
    shingles are all found, longer ones of just the similarity with a chance
    of ``RECALL``. NULL and blank texts are one group. ``row`` is a 128-bit
    name of id and text; in each group the row of the smallest id stays, rows without an
    id come last. Repeated rows have the same ``row``.
    """
    def kernel():
        def make(texts: list[str | None]) -> list[list]:
            bases = [shingle_hashes(t, shingle) for t in texts]
            return [[set_name(b) for b in bases], [len(b) for b in bases], [wide_fingerprint(b) for b in bases]]

        return make

    rows = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"),
        row_name(doc_id, text).alias("row"),
        F.col(text).alias("text"),
    )
    made = "node binary, size long, wide binary"
    marked = materialize(map_texts(rows, ["doc_id", "row"], "text", kernel, made), "wide-fingerprints")
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")
    # One name has one size and fingerprint.
    distinct = materialize(
        marked.groupBy("node").agg(F.min(place).alias("first"), F.min("size").alias("size"), F.min("wide").alias("wide")),
        "distinct-sets",
    )
    named_rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    nodes = distinct.select("node", F.col("first.row").alias("row"), "size", "wide")
    links = similar_links(named_rows, nodes, "text", shingle, similarity)
    roots = connected_components(links)
    placed = distinct.join(roots, "node", "left").select("node", "first", F.coalesce("root", "node").alias("root"))
    heads = placed.groupBy("root").agg(F.min("first").alias("head"))
    named = placed.join(heads, "root").select("node", "head")
    return marked.join(named, "node").select(
        "doc_id", "row", F.col("head.doc_id").alias("component_id"), (F.col("row") == F.col("head.row")).alias("stays")
    )


def drop_near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The row of each group of ``similarity_groups`` that stays; all columns kept.

    Only the names of rows that go are joined back. Rows that repeat a whole
    document are one, of which one row is kept.
    """
    groups = materialize(similarity_groups(docs, doc_id, text, **options).select("row", "stays"), "groups")
    rows = docs.withColumn("__row", row_name(doc_id, text))
    gone = groups.filter("NOT stays").select(F.col("row").alias("__row"))
    kept = rows.join(gone, "__row", "left_anti")
    if groups.filter("stays").groupBy("row").count().filter("count > 1").limit(1).count():
        kept = kept.dropDuplicates(["__row"])
    return kept.select(*docs.columns)
