"""Prefix trie of conversations with sums over subtrees by centroid decomposition.

A node is a distinct beginning of conversations. Its edge to the parent makes a
forest whose components are split again and again: the total below the centroid of
a component is added to every node between the centroid and the top of the
component, then the centroid leaves and the pieces are components of at most half
the size. Large components are split with joins; those of bounded size are finished
inside tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.runtime import materialize, ship_package

# Original turns a conversation may take over, and how many ids share a donor.
TURNS = 6
FAMILY = 100
# Turns whose running key is made in one window.
BLOCK = 1_024
# Nodes of a component that a task finishes alone.
COMPONENT_NODES = 4_096
# Ids of a node joined into one piece of text before they are hashed.
IDS = 8_192


# -- turns and keys --------------------------------------------------------


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """``conv_id, p, length, c1, c2`` of every turn: its place from 1, the code points
    of its text and a 128-bit name of role and text.

    Turns are ordered by turn (NULL first), then role and text. Rows are sorted by
    range, so a long conversation spreads over tasks; a place is the place in the
    whole order less that of the conversation's first row.
    """
    spark = conversations.sparkSession
    rows = conversations.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    order = ["conv_id", "turn", "role", "text"]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = materialize(
        rows.repartitionByRange(n, *order)
        .sortWithinPartitions(*order)
        .select(
            "conv_id",
            F.length("text").cast("long").alias("length"),
            F.xxhash64(F.lit(1), "role", "text").alias("c1"),
            F.xxhash64(F.lit(2), F.length("role"), "text", "role").alias("c2"),
            F.monotonically_increasing_id().alias("mid"),
        ),
        "turns",
    )
    part = F.shiftrightunsigned("mid", 33)
    # One row per partition and conversation; most conversations lie in one partition.
    runs = placed.groupBy("conv_id", part.alias("part")).agg(F.min("mid").alias("least"), F.count("*").alias("rows"))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("shift", F.coalesce(F.sum("rows").over(before), F.lit(0))).drop("rows")
    return (
        placed.withColumn("part", part)
        .join(runs, ["conv_id", "part"])
        .select("conv_id", (F.col("mid") - F.col("least") + F.col("shift") + 1).alias("p"), "length", "c1", "c2")
    )


def rebuilt_turns(turns: DataFrame, most: int = TURNS, family: int = FAMILY) -> tuple[DataFrame, DataFrame]:
    """All conversations as ``conv_id, size`` and their rebuilt turns ``conv_id, d, length, c1, c2``.

    A conversation c takes the first h turns of conversation c - c % ``family``, where
    h is the CRC-32 of c modulo ``most``, then its own turns after its first h.
    """
    donors = turns.filter((F.col("p") < most) & (F.col("conv_id") % family == 0)).select(
        F.col("conv_id").alias("donor"), "p", "length", "c1", "c2"
    )
    given = donors.groupBy("donor").agg(F.count("*").alias("given"))
    convs = (
        turns.groupBy("conv_id")
        .agg(F.max("p").alias("own"))
        .withColumn("h", F.crc32(F.col("conv_id").cast("string").cast("binary")) % most)
        .withColumn("donor", F.col("conv_id") - F.col("conv_id") % family)
        .join(given, "donor", "left")
        .withColumn("taken", F.least("h", F.coalesce("given", F.lit(0))))
        .withColumn("size", F.col("taken") + F.greatest(F.col("own") - F.col("h"), F.lit(0)))
        .select("conv_id", "donor", "h", "taken", "size")
    )
    convs = materialize(convs, "conversations")
    first = convs.join(donors, "donor").filter("p <= taken").select("conv_id", F.col("p").alias("d"), "length", "c1", "c2")
    rest = turns.join(convs, "conv_id").filter("p > h").select(
        "conv_id", (F.col("p") - F.col("h") + F.col("taken")).alias("d"), "length", "c1", "c2"
    )
    return convs.select("conv_id", "size"), first.unionByName(rest)


def with_keys(turns: DataFrame) -> DataFrame:
    """``conv_id, d, length, k1, k2, p1, p2``: the 128-bit name of the beginning of d turns and its parent's.

    A name is the XOR of one hash per place, turn and text, so it can be made in
    blocks of a long conversation.
    """
    hashed = materialize(
        turns.select(
            "conv_id",
            "d",
            "length",
            F.xxhash64(F.lit(3), "d", "c1", "c2").alias("g1"),
            F.xxhash64("c2", "d", F.lit(4), "c1").alias("g2"),
            F.floor((F.col("d") - 1) / BLOCK).alias("block"),
        ),
        "turn-hashes",
    )
    blocks = hashed.groupBy("conv_id", "block").agg(F.bit_xor("g1").alias("x1"), F.bit_xor("g2").alias("x2"))
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(
        "conv_id", "block", *(F.coalesce(F.bit_xor(f"x{i}").over(before), F.lit(0)).alias(f"x{i}") for i in (1, 2))
    )
    inside = Window.partitionBy("conv_id", "block").orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    keyed = hashed.select(
        "*", *(F.bit_xor(f"g{i}").over(inside).alias(f"w{i}") for i in (1, 2))
    ).join(blocks, ["conv_id", "block"])
    names = [F.col(f"x{i}").bitwiseXOR(F.col(f"w{i}")).alias(f"k{i}") for i in (1, 2)]
    keyed = keyed.select("conv_id", "d", "length", "g1", "g2", *names)
    parents = [F.col(f"k{i}").bitwiseXOR(F.col(f"g{i}")).alias(f"p{i}") for i in (1, 2)]
    return keyed.select("conv_id", "d", "length", "k1", "k2", *parents)


def ids_sha256(members: DataFrame, ids: int = IDS) -> DataFrame:
    """``d, k1, k2, ends_sha256`` of ``d, k1, k2, conv_id``: hash of the ids, ascending, comma-joined.

    Ids are joined into pieces of bounded length before the shuffle by node; the
    hash then runs over the pieces in order and holds one at a time.
    """
    ship_package()
    piece = F.floor(F.col("conv_id") / ids).alias("piece")
    text = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda i: i.cast("string")), ",")
    pieces = members.groupBy("d", "k1", "k2", piece).agg(text.alias("ids"))
    n = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    node = ["d", "k1", "k2"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, None
        for batch in batches:
            made: list[tuple] = []
            for *key, value in zip(*(c.to_pylist() for c in batch.columns)):
                if key != last:
                    if last is not None:
                        made.append((*last, state.hexdigest()))
                    last, state = key, hashlib.sha256(value.encode())
                else:
                    state.update(b"," + value.encode())
            yield table(made)
        if last is not None:
            yield table([(*last, state.hexdigest())])

    def table(made: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
        columns = list(zip(*made)) or [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[*node, "ends_sha256"])

    dealt = pieces.repartition(n, *node).sortWithinPartitions(*node, "piece").select(*node, "ids")
    return dealt.mapInArrow(run, "d long, k1 long, k2 long, ends_sha256 string")


# -- centroid decomposition ------------------------------------------------


def centroid_sums(parent: list[int], values: np.ndarray) -> np.ndarray:
    """Sums of ``values`` (one row per node) over the subtrees of a tree.

    ``parent`` names an earlier node, or -1 for the top. Each component adds the
    total below its centroid to the nodes from the centroid up to its top, and is
    then split into the parts above and below.
    """
    sums = np.zeros_like(values)
    cut = [False] * len(parent)  # whether the edge to the parent is gone
    sizes = [0] * len(parent)
    waiting = [list(range(len(parent)))]  # components, parents first
    while waiting:
        nodes = waiting.pop()
        if len(nodes) == 1:
            sums[nodes[0]] += values[nodes[0]]
            continue
        for v in nodes:
            sizes[v] = 1
        for v in reversed(nodes[1:]):
            sizes[parent[v]] += sizes[v]
        # The last node that holds half of the component is the deepest such.
        centre = next(v for v in reversed(nodes) if 2 * sizes[v] >= len(nodes))
        top = {centre: centre}
        for v in nodes:  # the piece of each node: the child of the centroid it hangs from, or the upper part
            if v != centre:
                above = top.get(parent[v]) if not cut[v] else None
                if above is not None:
                    top[v] = v if above == centre else above
        below = [v for v in nodes if v in top]
        total = values[below].sum(axis=0)
        v = centre
        while True:
            sums[v] += total
            if cut[v] or parent[v] < 0:
                break
            v = parent[v]
        pieces: dict[int, list[int]] = {}
        for v in nodes:
            if v != centre:
                pieces.setdefault(top.get(v, -1), []).append(v)
        cut[centre] = True
        for first, piece in pieces.items():
            if first >= 0:
                cut[first] = True
            waiting.append(piece)
    return sums


def _finish(nodes: DataFrame) -> DataFrame:
    """``d, k1, k2`` and sums of nodes whose components (``t1, t2, td``) are of bounded size."""
    ship_package()
    component = ["td", "t1", "t2"]
    n = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    fields = ["d", "k1", "k2", "p1", "p2", "leaves", "saved"]

    def done(rows: list[np.ndarray]) -> pa.RecordBatch:
        tree = np.concatenate(rows)
        at = {(d, a, b): i for i, (d, a, b) in enumerate(tree[:, :3].tolist())}
        parent = [at.get((d - 1, a, b), -1) for d, a, b in tree[:, [0, 3, 4]].tolist()]
        sums = centroid_sums(parent, tree[:, 5:7])
        columns = [*tree[:, :3].T, *sums.T]
        return pa.RecordBatch.from_arrays(
            [pa.array(np.ascontiguousarray(c)) for c in columns], names=["d", "k1", "k2", "leaves", "saved"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, rows = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            values = np.stack([c.to_numpy() for c in batch.columns], axis=1)
            tops = values[:, :3]
            cuts = np.nonzero((tops[1:] != tops[:-1]).any(axis=1))[0] + 1
            for i, j in zip([0, *cuts], [*cuts, len(values)]):
                own = tuple(tops[i].tolist())
                if last is not None and own != last:
                    yield done(rows)
                    rows = []
                last = own
                rows.append(values[i:j, 3:])
        if rows:
            yield done(rows)

    dealt = nodes.repartition(n, *component).sortWithinPartitions(*component, "d").select(*component, *fields)
    return dealt.mapInArrow(run, "d long, k1 long, k2 long, leaves long, saved long")


def subtree_sums(paths: DataFrame, component_nodes: int = COMPONENT_NODES) -> DataFrame:
    """``d, k1, k2, leaves, saved`` summed over the subtree of every node.

    ``paths`` has a row for every conversation and every node on its way from the
    root (depth 0): ``conv_id, d, k1, k2, p1, p2, owned, leaves, saved``. A node is
    owned by its smallest conversation; what a conversation owns is the lower end of
    its path, and of its path inside any component. So the nodes below each node are
    counted by one sum over the paths, and no path is walked node by node.
    """
    node = ["d", "k1", "k2"]
    top = ["td", "t1", "t2"]
    root = [F.lit(0).cast("long").alias(c) for c in top]
    rest = paths.select(*paths.columns, *root)
    parts = []
    for _ in range(64):
        counts = rest.filter("owned").groupBy(*top).agg(F.count("*").alias("m"))
        large = materialize(counts.filter(F.col("m") > component_nodes), "large-components")
        if not large.limit(1).count():
            break
        big = materialize(rest.join(large, top), "split-paths")
        ends = big.filter("owned").groupBy("conv_id", *top).agg(F.min("d").alias("s"), F.max("d").alias("e"))
        sizes = (
            big.join(ends, ["conv_id", *top])
            .filter("d <= e")
            .groupBy(*top, "m", *node)
            .agg(F.sum(F.col("e") - F.greatest("s", "d") + 1).alias("size"))
        )
        centre = sizes.filter("2 * size >= m").groupBy(*top).agg(F.max(F.struct("d", "k1", "k2")).alias("x"))
        centre = materialize(centre.select(*top, F.col("x.d").alias("xd"), "x.k1", "x.k2"), "centroids")
        # Conversations through the centroid, with the child that each goes on to.
        at = big.join(centre.withColumnRenamed("xd", "d"), [*top, *node]).select("conv_id", *top)
        below = at.join(centre.select(*top, "xd"), top)
        marked = materialize(
            big.drop("m")
            .join(below, ["conv_id", *top], "left")
            .join(
                big.select("conv_id", *top, F.col("d").alias("cd"), F.col("k1").alias("c1"), F.col("k2").alias("c2"))
                .join(below, ["conv_id", *top])
                .filter("cd = xd + 1")
                .select("conv_id", *top, "c1", "c2"),
                ["conv_id", *top],
                "left",
            ),
            "marked-paths",
        )
        totals = marked.filter("owned AND d >= xd").groupBy(*top).agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
        owner = marked.filter("owned AND d = xd").select("conv_id", *top)
        lifted = (
            marked.filter("d <= xd")
            .join(owner, ["conv_id", *top], "left_semi")
            .select(*top, *node)
            .join(totals, top)
            .select(*node, "leaves", "saved")
        )
        parts.append(materialize(lifted, "lifted"))
        under = F.coalesce(F.col("d") > F.col("xd"), F.lit(False))
        new_top = [
            F.when(under, F.col(c)).otherwise(F.col(t)).alias(t) for t, c in (("t1", "c1"), ("t2", "c2"))
        ]
        left = marked.filter(F.coalesce(F.col("d") != F.col("xd"), F.lit(True))).select(
            *paths.columns, F.when(under, F.col("xd") + 1).otherwise(F.col("td")).alias("td"), *new_top
        )
        small = rest.join(large.select(*top), top, "left_anti")
        rest = materialize(small.unionByName(left), "paths")
    parts.append(_finish(rest.filter("owned")))
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    return every.groupBy(*node).agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))


def prefix_trie(
    conversations: DataFrame, most: int = TURNS, family: int = FAMILY, component_nodes: int = COMPONENT_NODES
) -> DataFrame:
    """One row per distinct beginning of the rebuilt conversations.

    ``conv_id`` (smallest member), ``depth``, ``parent_conv_id`` (NULL for the root),
    ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens`` and ``ends_sha256``.
    Turns are ordered by turn, NULL first, then by role and text; NULL roles and texts
    are empty. Rows without a conversation id are left out; repeated rows are turns of
    their own. No conversation gives no row; a conversation rebuilt without a turn is a
    member of the root only. Other columns are not read.
    """
    convs, rebuilt = rebuilt_turns(numbered_turns(conversations), most, family)
    zero = F.lit(0).cast("long")
    roots = convs.select("conv_id", *(zero.alias(c) for c in ("d", "length", "k1", "k2", "p1", "p2")))
    keyed = materialize(with_keys(rebuilt).unionByName(roots), "paths")
    node = ["d", "k1", "k2"]
    nodes = materialize(
        keyed.groupBy(*node).agg(
            F.min("conv_id").alias("conv_id"),
            F.count("*").alias("n_convs"),
            F.min("length").alias("length"),
            F.min("p1").alias("p1"),
            F.min("p2").alias("p2"),
        ),
        "nodes",
    )
    children = (
        nodes.filter("d > 0")
        .groupBy((F.col("d") - 1).alias("d"), F.col("p1").alias("k1"), F.col("p2").alias("k2"))
        .agg(F.count("*").alias("n_children"))
    )
    nodes = materialize(
        nodes.join(children, node, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "nodes"
    )
    owners = nodes.select(
        *node,
        F.col("conv_id").alias("owner"),
        F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("leaves"),
        ((F.col("n_convs") - 1) * F.col("length")).alias("saved"),
    )
    paths = keyed.drop("length").join(owners, node).withColumn("owned", F.col("owner") == F.col("conv_id")).drop("owner")
    sums = subtree_sums(materialize(paths, "paths"), component_nodes)
    last = keyed.select("conv_id", *node).join(
        convs.select("conv_id", F.col("size").alias("d")), ["conv_id", "d"], "left_semi"
    )
    ends = ids_sha256(last.select(*node, "conv_id"))
    above = nodes.select(
        (F.col("d") + 1).alias("d"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id")
    )
    return (
        nodes.join(above, ["d", "p1", "p2"], "left")
        .join(sums, node)
        .join(ends, node, "left")
        .select(
            "conv_id",
            F.col("d").alias("depth"),
            "parent_conv_id",
            "n_convs",
            "n_children",
            F.col("leaves").alias("n_leaves"),
            F.col("saved").alias("saved_tokens"),
            F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
        )
    )
