"""Near duplicates by an LSH forest over MinHash signatures.

A signature is read in several orders, and each order is a tree: texts that begin
with the same values share a branch. Branches are as deep as their region asks for.
Neighbours with a common prefix are candidates, and every link is confirmed on the
whole shingle sets.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from granary.llm.common import map_texts
from granary.llm.components import connected_components
from granary.runtime import at_most, materialize, ship_package

SHINGLE = 2
# A link has 100 * common >= PERCENT * union.
PERCENT = 80
# Orders of a signature, and the values of an order that a branch may share. Two
# texts of similarity 0.8 share three values of one order of 24 with a chance of
# 1 - 3e-8, and five with 0.99993.
TREES = 24
LEAST_DEPTH = 3
DEPTH = 5
# Pairs of texts of different components that a branch may name; larger ones go deeper.
BRANCH_PAIRS = 256
# Texts of a side of a tile of a large branch, their shingles, and the shingles in
# common that are counted at a time.
TILE_TEXTS = 2_048
TILE_SHINGLES = 1 << 21
TILE_COMMON = 1 << 20
# Texts whose sets are fetched by a broadcast of their names.
BROADCAST_TEXTS = 2_000_000
SEED = 42
# Distinct words whose hashes a task remembers, and shingles hashed at a time.
WORDS = 200_000
ROWS = 8_192
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


class _WordHashes(dict):
    """Hashes of words, made once while they are remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS:
            self.clear()
        made = self[word] = xxhash.xxh64_intdigest(word, SEED)
        return made


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, hashes: dict, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles of a text; none without a word.

    A-Z are lower-cased and words end at white space. Fewer words than a shingle are
    one shingle.
    """
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    each = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    width = min(shingle, len(words))
    n = len(words) - width + 1
    made = np.full(n, width, np.uint64)
    for i in range(width):
        made = _mix(made * np.uint64(0x9E3779B97F4A7C15) + each[i : i + n])
    return np.unique(made)


def _permutations(count: int) -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(SEED)
    return (
        draw.integers(0, 1 << 31, count, np.uint32) * np.uint32(2) + np.uint32(1),
        draw.integers(0, 1 << 32, count, np.uint32),
    )


def signature(base: np.ndarray, trees: int = TREES, depth: int = DEPTH) -> bytes:
    """Least values of a shingle set under ``trees`` times ``depth`` permutations, 16 bits each."""
    factor, shift = _permutations(trees * depth)
    least = np.full(trees * depth, 0xFFFFFFFF, np.uint32)
    short = (base >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(short), ROWS):
        np.minimum(least, (short[at : at + ROWS, None] * factor ^ shift).min(axis=0), out=least)
    return least.astype(np.uint16).tobytes()


def branch_keys(signatures: np.ndarray, depth: int) -> np.ndarray:
    """Names of the branches of a depth for (texts, trees, values); the last six bits are the tree."""
    key = np.full(signatures.shape[:2], depth, np.uint64)
    for i in range(depth):
        key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + signatures[:, :, i].astype(np.uint64))
    trees = np.arange(signatures.shape[1], dtype=np.uint64)
    return (key & ~np.uint64(63)) | trees


def _branches(rows: DataFrame, depth: int, trees: int, whole: int) -> DataFrame:
    """``key, id`` of the branches of a depth of ``rows`` (id, sig[, tree])."""
    ship_package()
    one = "tree" in rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            raw = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16)
            ids = batch.column(0).to_numpy()
            keys = branch_keys(raw.reshape(len(ids), trees, whole), depth)
            if one:
                keys = keys[np.arange(len(ids)), batch.column(2).to_numpy()]
            else:
                ids = np.repeat(ids, trees)
            yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1).view(np.int64)), pa.array(ids)], names=["key", "id"])

    return rows.select("id", "sig", *(["tree"] if one else [])).mapInArrow(run, "key long, id long")


def _alike(a: Column | str, b: Column | str, percent: float) -> Column:
    """Sets of too different sizes cannot be similar."""
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a, b`` whose sets (``id, hashes``) are similar."""

    def side(name: str) -> DataFrame:
        return sets.select(F.col("id").alias(name), F.col("hashes").alias(f"set_{name}"))

    both = pairs.join(side("a"), "a").join(side("b"), "b")
    common = F.size(F.array_intersect("set_a", "set_b")).cast("long")
    union = F.size("set_a") + F.size("set_b") - common
    near = _alike(F.size("set_a"), F.size("set_b"), percent) & (100 * common >= percent * union)
    return both.filter(near).select("a", "b")


def _with_roots(rows: DataFrame, roots: DataFrame) -> DataFrame:
    known = roots.select(F.col("node").alias("id"), "root")
    return rows.join(known, "id", "left").withColumn("root", F.coalesce("root", "id"))


def _joined(roots: DataFrame, links: DataFrame) -> DataFrame:
    """``node, root`` after further links ``a, b``; only links of different components are followed."""
    for end in ("a", "b"):
        known = roots.select(F.col("node").alias(end), F.col("root").alias(f"root_{end}"))
        links = links.join(known, end, "left").withColumn(f"root_{end}", F.coalesce(f"root_{end}", end))
    apart = links.filter("root_a <> root_b").select(
        F.least("root_a", "root_b").alias("a"), F.greatest("root_a", "root_b").alias("b")
    )
    more = connected_components(materialize(apart.distinct(), "component-links"))
    moved = more.select(F.col("node").alias("root"), F.col("root").alias("to"))
    old = roots.join(moved, "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    return materialize(old.unionByName(more.join(roots.select("node"), "node", "left_anti")), "roots")


def branch_regions(rows: DataFrame) -> DataFrame:
    """``key, id, root`` of branches with several components, with the ``main`` one,
    the number of texts ``n`` and of those ``others`` outside of the main one."""
    each = rows.groupBy("key", "root").agg(F.count("*").alias("n"))
    most = F.max(F.struct("n", "root"))
    stats = each.groupBy("key").agg(most.alias("most"), F.sum("n").alias("n"), F.count("*").alias("roots")).filter("roots > 1")
    stats = stats.select("key", "n", F.col("most.root").alias("main"), (F.col("n") - F.col("most.n")).alias("others"))
    return rows.join(stats, "key")


def across(regions: DataFrame, sizes: DataFrame, percent: float) -> DataFrame:
    """Pairs ``a, b`` of texts of one branch and different components.

    Only texts outside of the main component of the branch meet the others.
    """
    sized = regions.join(sizes, "id")
    names = ["id", "root", "size"]
    left = sized.filter("root <> main").select("key", *(F.col(c).alias(f"{c}_a") for c in names))
    right = sized.select("key", *(F.col(c).alias(f"{c}_b") for c in names))
    met = left.join(right, "key").filter("root_a <> root_b").filter(_alike("size_a", "size_b", percent))
    return met.select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b")).distinct()


def _neighbours(regions: DataFrame) -> DataFrame:
    """Pairs ``a, b`` of each text and one other text of its branch, if of another component."""
    head = F.min(F.struct(F.xxhash64("id", "key").alias("h"), "id", "root")).alias("head")
    met = regions.join(regions.groupBy("key").agg(head), "key").filter("root <> head.root")
    return met.select(F.least("id", "head.id").alias("a"), F.greatest("id", "head.id").alias("b")).distinct()


def _sized(pairs: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a, b`` of sets of similar sizes."""

    def side(name: str) -> DataFrame:
        return sizes.select(F.col("id").alias(name), F.col("size").alias(f"size_{name}"))

    both = pairs.join(side("a"), "a").join(side("b"), "b")
    return both.filter(_alike("size_a", "size_b", percent)).select("a", "b")


def _union(parts: list[DataFrame]) -> DataFrame:
    return functools.reduce(DataFrame.unionByName, parts)


def spanning_links(texts: list[tuple[int, int, np.ndarray]], others: list[tuple[int, int, np.ndarray]], percent: float) -> list:
    """Links ``(other, text)`` that join the components of similar sets.

    Both lists have (id, root, sorted set). The sets of ``texts`` are laid out in one
    sorted array, so each other set is counted against all of them at once; a link is
    given only if it joins two components that earlier links have not joined.
    """
    owner = np.repeat(np.arange(len(texts)), [len(x) for _, _, x in texts])
    every = np.concatenate([x for _, _, x in texts])
    order = np.argsort(every, kind="stable")
    every, owner = every[order], owner[order]
    sizes = np.array([len(x) for _, _, x in texts])
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = parent.get(up, up)
            x = up
        return x

    made = []
    for name, root, own in others:
        first, last = np.searchsorted(every, own, "left"), np.searchsorted(every, own, "right")
        times = last - first
        total = np.cumsum(times)
        common = np.zeros(len(texts), np.int64)
        at = 0
        while at < len(own):  # a slice has the texts of one shingle at least
            end = max(at + 1, int(np.searchsorted(total, total[at] - times[at] + TILE_COMMON, "right")))
            shared = times[at:end]
            places = np.arange(shared.sum()) + np.repeat(first[at:end] - np.cumsum(shared) + shared, shared)
            common += np.bincount(owner[places], minlength=len(texts))
            at = end
        for i in np.nonzero(100 * common >= percent * (len(own) + sizes - common))[0]:
            a, b = find(root), find(texts[i][1])
            if a != b:
                parent[max(a, b)] = min(a, b)
                made.append((name, texts[i][0]))
    return made


def dealt_tiles(regions: DataFrame, sets: DataFrame, tile_texts: int, tile_shingles: int) -> DataFrame:
    """``key, i, j, other, id, root, hashes`` of the tiles of branches.

    The texts outside of the main component of a branch (``other``), and all its texts,
    are dealt into tiles by a hash; each two tiles meet. ``sets`` has ``id, hashes`` and
    ``size``; ids may be of any type.
    """
    sized = materialize(regions.join(sets.select("id", "size"), "id"), "large-branches")
    apart = F.col("root") != F.col("main")

    def tiles(condition: Column) -> Column:
        rows = F.sum(F.when(condition, 1).otherwise(0)) / tile_texts
        return F.greatest(F.ceil(rows), F.ceil(F.sum(F.when(condition, F.col("size")).otherwise(0)) / tile_shingles)).cast("int")

    counts = sized.groupBy("key").agg(tiles(F.lit(True)).alias("wide"), tiles(apart).alias("high"))
    dealt = sized.select("key", "id", "root", "main").join(counts, "key")

    def own(parts: str) -> Column:
        return F.pmod(F.xxhash64("id"), F.col(parts)).cast("int")

    def every(parts: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(parts) - 1))

    rows = dealt.select("key", every("high").alias("i"), own("wide").alias("j"), F.lit(False).alias("other"), "id", "root")
    others = dealt.filter(apart).select(
        "key", own("high").alias("i"), every("wide").alias("j"), F.lit(True).alias("other"), "id", "root"
    )
    return rows.unionByName(others).join(sets, "id").select("key", "i", "j", "other", "id", "root", "hashes")


def tile_links(
    regions: DataFrame, sets: DataFrame, percent: float, tile_texts: int = TILE_TEXTS, tile_shingles: int = TILE_SHINGLES
) -> DataFrame:
    """Links ``a, b`` that connect the similar texts of branches of any size.

    Two tiles meet in a task, which counts what the whole sets have in common and
    returns fewer links than it has components.
    """
    ship_package()
    kind = sets.schema["id"].dataType
    named = to_arrow_type(kind)
    n = int(regions.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tile = ["key", "i", "j"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, sides = None, ([], [])

        def done() -> pa.RecordBatch:
            made = spanning_links(*sides, percent) if all(sides) else []
            a, b = zip(*made) if made else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(a, named), pa.array(b, named)], names=["a", "b"])

        for batch in batches:
            names = [c.to_pylist() for c in batch.columns[:-1]]
            for *own_tile, other, name, root, hashes in zip(*names, batch.column(batch.num_columns - 1)):
                if own_tile != last:
                    if last is not None:
                        yield done()
                    last, sides = own_tile, ([], [])
                # Sets are sorted as unsigned numbers. A copy lets the batch go.
                sides[other].append((name, root, hashes.values.to_numpy().view(np.uint64).copy()))
        if last is not None:
            yield done()

    met = dealt_tiles(regions, sets.withColumn("size", F.size("hashes")), tile_texts, tile_shingles)
    return met.repartition(n, *tile).sortWithinPartitions(*tile).mapInArrow(
        run, f"a {kind.simpleString()}, b {kind.simpleString()}"
    )


def near_components(
    docs: DataFrame,
    nodes: DataFrame,
    shingle: int = SHINGLE,
    percent: int = PERCENT,
    trees: int = TREES,
    least_depth: int = LEAST_DEPTH,
    depth: int = DEPTH,
    branch_pairs: int = BRANCH_PAIRS,
) -> DataFrame:
    """``node, root`` of the texts (``id, row, size, sig``) that are linked with others.

    First each text meets one neighbour, the least text of a branch that it shares in
    most orders; this joins large groups without naming their pairs. In branches that
    are still large, each text then meets one neighbour of every branch of the last
    depth that it lies in, so those with the longest common prefixes. What lies in different components of
    a branch after that meets there if the branch is small. Larger branches go on at
    the next depth; those that are large at the last depth are compared tile by tile.
    """
    keyed = _branches(nodes, least_depth, trees, depth)
    shared = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("head")).filter("n > 1").drop("n")
    members = materialize(keyed.join(shared, "key"), "branches")
    sizes = nodes.select("id", "size")
    met = materialize(members.select("id").distinct(), "met")

    wanted = nodes.join(met, "id", "left_semi").select("row", "id")
    few = at_most(wanted, BROADCAST_TEXTS)

    def kernel():
        known = _WordHashes()
        return lambda texts: [[shingle_set(t, known, shingle).view(np.int64) for t in texts]]

    own = docs.join(F.broadcast(wanted) if few else wanted, "row")
    sets = materialize(map_texts(own, ["id"], "text", kernel, "hashes array<long>").dropDuplicates(["id"]), "sets")

    orders = members.filter("head < id").groupBy("id", "head").agg(F.count("*").alias("orders"))
    least = orders.groupBy("id").agg(F.max(F.struct("orders", (-F.col("head")).alias("less"))).alias("best"))
    stars = least.select((-F.col("best.less")).alias("a"), F.col("id").alias("b"))
    first = confirmed(_sized(stars, sizes, percent), sets, percent)
    roots = connected_components(materialize(first, "first-links"))

    small = F.col("n") * F.col("others") <= branch_pairs

    tree = F.col("key").bitwiseAND(F.lit(63)).cast("int").alias("tree")
    levels = {least_depth: members.select("key", "id")}
    regions = branch_regions(_with_roots(levels[least_depth], roots)).filter(~small)
    deepest = None
    for level in range(least_depth + 1, depth + 1):
        rows = regions.select("id", tree).join(nodes.select("id", "sig"), "id").select("id", "sig", "tree")
        levels[level] = materialize(_branches(rows, level, trees, depth), "branches")
        regions = materialize(branch_regions(_with_roots(levels[level], roots)), "prefix-regions")
        if not regions.limit(1).count():
            break
        deepest = regions
    if deepest is not None:
        stars = _neighbours(deepest)
        roots = _joined(roots, confirmed(stars, sets, percent))

    found = []
    for level in range(least_depth, depth + 1):
        regions = materialize(branch_regions(_with_roots(levels[level], roots)), "regions")
        found.append(materialize(across(regions.filter(small), sizes, percent), "branch-pairs"))
        large = regions.filter(~small)
        if not large.limit(1).count():
            large = None
            break
    links = confirmed(_union(found).distinct(), sets, percent)
    if large is not None:
        links = links.unionByName(tile_links(large, sets, percent))
    return _joined(roots, links)


def forest_groups(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    shingle: int = SHINGLE,
    percent: int = PERCENT,
    trees: int = TREES,
    least_depth: int = LEAST_DEPTH,
    depth: int = DEPTH,
    branch_pairs: int = BRANCH_PAIRS,
) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row.

    Texts link if ``percent`` of the union of their sets of distinct word shingles is
    common; the component is the smallest id reachable, and the row of that id is
    kept. Equal sets are one text. NULL and blank texts have no shingles, link with
    nothing and are kept. Rows without an id take part, but name no component unless it
    has no other id. Repeated rows are returned as often as they come. Other columns
    are not read.
    """
    if trees > 64 or not 0 < least_depth <= depth:
        raise ValueError("at most 64 orders, and a least depth of 1 to depth")

    def kernel():
        known = _WordHashes()

        def make(texts: list[str | None]) -> list[list]:
            bases = [shingle_set(t, known, shingle) for t in texts]
            names = [xxhash.xxh3_128_digest(b.tobytes(), SEED) if len(b) else None for b in bases]
            return [names, list(map(len, bases)), [signature(b, trees, depth) if len(b) else None for b in bases]]

        return make

    row = F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("-")), F.lit(":"), F.coalesce(F.col(text), F.lit("")))
    rows = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), F.unhex(F.md5(row.cast("binary"))).alias("row"), F.col(text).alias("text")
    )
    made = "node binary, n_shingles long, sig binary"
    marked = materialize(map_texts(rows, ["doc_id", "row"], "text", kernel, made), "signatures")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row"))
    nodes = (
        marked.filter("n_shingles > 0")
        .groupBy("node")
        .agg(first.alias("first"), F.min("n_shingles").alias("size"), F.min("sig").alias("sig"))
        .select("node", F.col("first.doc_id").alias("least"), F.col("first.row").alias("row"), "size", "sig")
        .withColumn("id", F.monotonically_increasing_id())
    )
    nodes = materialize(nodes, "distinct-sets")
    roots = near_components(
        rows.select("row", "text"), nodes, shingle, percent, trees, least_depth, depth, branch_pairs
    )
    placed = _with_roots(nodes.select("id", "node", "least"), roots)
    heads = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    named = placed.join(heads, "root").select("node", "component_id")
    linked = marked.select("doc_id", "n_shingles", "node").join(named, "node", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return linked.select("doc_id", "n_shingles", component.alias("component_id")).withColumn(
        "kept", F.col("doc_id").eqNullSafe(F.col("component_id"))
    )
