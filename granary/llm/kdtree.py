"""Sharding by a k-d tree over document metadata, in DataFrame expressions.

Nodes are split at distributed weighted medians along their widest metadata
dimension until every leaf is one shard of about the target bytes. Equal texts
form one point; only a group that outgrows a fraction of a shard is dealt as
several adjacent points, so that a median can pass through it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.llm.common import local_rows
from granary.runtime import BROADCAST_ROWS, at_most, materialize, with_position

# Bins of one histogram pass of a weighted median, per node. Every pass reads all
# points, and the bins of a node are few rows of one window.
BINS = 4_096
# A cut is good enough once its bin weighs less than this part of a shard.
TOLERANCE = 1 / 500
# Groups above this part of a shard are dealt as several points.
PIECE = 1 / 16
# Rows numbered together when slots are given out.
SLOT_ROWS = 8_192
# A coordinate has 31 bits of metadata above 32 bits that part equal metadata.
LEVELS = (1 << 31) - 1
LOW = 1 << 32


@dataclass
class Node:
    """A part of the tree: ``shards`` leaves starting at ``first``."""

    first: int
    shards: int


def with_ranks(rows: DataFrame, names: list[str]) -> DataFrame:
    """Text columns replaced by their places among the distinct values, in text order.

    Whole values are compared, so names with a common beginning stay apart; NULL
    ranks with the empty text. Places are broadcast while they are few, and a long
    list is numbered by range partitions and joined.
    """
    for name in names:
        value = F.coalesce(F.col(name).cast("string"), F.lit(""))
        rows = rows.withColumn(name, value)
        values = materialize(rows.select(name).distinct(), "values")
        few = at_most(values, BROADCAST_ROWS)
        ranks = with_position(values, [name], "__rank", partitions=1 if few else None)
        joined = rows.join(F.broadcast(ranks) if few else ranks, name)
        rows = joined.withColumn(name, F.col("__rank").cast("long")).drop("__rank")
    return rows


def measured(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Rows with their size, checksum, group (equal texts) and a spread number."""
    raw = F.encode(F.coalesce(F.col(text), F.lit("")), "utf-8")
    return docs.select(
        "*",
        (F.octet_length(raw) + 8).cast("long").alias("__size"),
        F.crc32(raw).cast("long").alias("__crc"),
        F.xxhash64(F.col(text)).alias("__group"),
        F.xxhash64(F.col(doc_id), F.lit("slot")).alias("__deal"),
    )


def _piece(pieces: Column) -> Column:
    return F.when(pieces.isNull(), 0).otherwise(F.pmod("__deal", pieces)).cast("long")


def _points(rows: DataFrame, dims: list[Column], limit: int) -> tuple[DataFrame, DataFrame]:
    """(points, big groups). A point is a group or a piece of a big one."""
    names = [f"d{i}" for i in range(len(dims))]
    groups = materialize(
        rows.groupBy("__group").agg(
            F.sum("__size").alias("bytes"), *(F.min(d).alias(n) for d, n in zip(dims, names))
        ),
        "groups",
    )
    # At most total / limit groups can be above the limit.
    big = groups.filter(F.col("bytes") > limit).select(
        "__group", F.ceil(F.col("bytes") / F.lit(limit)).cast("long").alias("pieces")
    )
    dealt = (
        rows.select("__group", "__size", "__deal")
        .join(F.broadcast(big), "__group")
        .groupBy("__group", _piece(F.col("pieces")).alias("piece"))
        .agg(F.sum("__size").alias("bytes"))
    )
    whole = groups.filter(F.col("bytes") <= limit).select(
        "__group",
        F.lit(0).cast("long").alias("piece"),
        "bytes",
        *names,
        F.pmod("__group", F.lit(LOW)).alias("low"),
    )
    pieces = dealt.join(F.broadcast(groups.filter(F.col("bytes") > limit).drop("bytes")), "__group").select(
        "__group",
        "piece",
        "bytes",
        *names,
        (F.pmod("__group", F.lit(1 << 12)) * (1 << 20) + F.col("piece")).alias("low"),
    )
    points = whole.unionByName(pieces)
    span = groups.agg(*(F.struct(F.min(n), F.max(n)).alias(n) for n in names)).first()
    coordinates = []
    for n in names:
        lowest, highest = span[n][0] or 0, span[n][1] or 0
        scale = LEVELS / (highest - lowest) if highest > lowest else 0.0
        place = F.least(
            F.lit(LEVELS), F.floor((F.coalesce(n, F.lit(lowest)) - F.lit(lowest)) * F.lit(scale))
        )
        coordinates.append((place.cast("long") * F.lit(LOW) + F.col("low")).alias(n))
    return materialize(points.select("__group", "piece", "bytes", *coordinates), "points"), big


def _below(placed: DataFrame, level: DataFrame, names: list[str]) -> DataFrame:
    """Points with the node they belong to after one more level of cuts."""
    side = F.get(F.array(*names), F.col("axis")) > F.col("cut")
    # One row per node, so bounded by the number of shards.
    return (
        placed.join(F.broadcast(level), "node", "left")
        .withColumn("node", F.when(side, F.col("right")).otherwise(F.coalesce("left", F.col("node"))))
        .drop("axis", "cut", "left", "right")
    )


def _medians(placed: DataFrame, wanted: list[dict], shard_bytes: float, names: list[str]) -> dict[int, int]:
    """Cut of every wanted node: the last coordinate left of it.

    Each of ``wanted`` has node, axis, lo, hi and want (bytes left of the cut).
    A pass bins the coordinates of every node, finds the bin that reaches
    ``want`` and looks closer at it, until that bin is light or one point.
    """
    spark = placed.sparkSession
    schema = "node int, axis int, lo long, hi long, want double, base double"
    todo = {w["node"]: w | {"base": 0.0, "below": None} for w in wanted}
    found: dict[int, int] = {}
    order = Window.partitionBy("node").orderBy("bin")
    while todo:
        ask = local_rows(
            spark,
            [tuple(t[n] for n in ("node", "axis", "lo", "hi", "want", "base")) for t in todo.values()],
            schema,
        )
        bins = (
            placed.join(F.broadcast(ask), "node")
            .withColumn("at", F.get(F.array(*names), F.col("axis")))
            .filter("at BETWEEN lo AND hi")
            .groupBy("node", "want", "base", F.expr(f"(at - lo) DIV ((hi - lo) DIV {BINS} + 1)").alias("bin"))
            .agg(F.sum("bytes").alias("bytes"), F.min("at").alias("low"), F.max("at").alias("high"))
        )
        rows = (
            bins.withColumn("reach", F.col("base") + F.sum("bytes").over(order))
            .withColumn("before", F.lag("high").over(order))
            .withColumn("last", F.lead("bin").over(order).isNull())
            .filter("reach - bytes < want OR before IS NULL")
            .filter("reach >= want OR last")
            .collect()  # one row per node
        )
        for r in rows:
            task = todo[r["node"]]
            before = task["below"] if r["before"] is None else r["before"]
            start = r["reach"] - r["bytes"]
            if r["low"] == r["high"] or r["bytes"] <= TOLERANCE * shard_bytes:
                nearer = r["reach"] - r["want"] <= r["want"] - start or before is None
                found[r["node"]] = r["high"] if nearer else before
                del todo[r["node"]]
            else:
                task |= {"lo": r["low"], "hi": r["high"], "base": start, "below": before}
    return found


def _leaves(points: DataFrame, shards: int, shard_bytes: float, names: list[str]) -> DataFrame:
    """(group, piece, shard) of every point. The tree itself has a few numbers
    per shard and is the only thing the driver holds. Points are written with
    their node at every level, so no pass repeats the levels above it."""
    spark = points.sparkSession
    nodes = {0: Node(0, shards)}
    placed = points.withColumn("node", F.lit(0))
    while any(n.shards > 1 for n in nodes.values()):
        extents = (
            placed.groupBy("node")
            .agg(F.sum("bytes").alias("bytes"), *(F.struct(F.min(n), F.max(n)).alias(n) for n in names))
            .collect()  # one row per node
        )
        wanted = []
        for r in extents:
            node = nodes[r["node"]]
            if node.shards > 1:
                widths = [r[n][1] - r[n][0] for n in names]
                axis = widths.index(max(widths))
                lo, hi = r[names[axis]]
                want = float(r["bytes"]) * (node.shards // 2) / node.shards
                wanted.append({"node": r["node"], "axis": axis, "lo": lo, "hi": hi, "want": want})
        found = _medians(placed, wanted, shard_bytes, names)
        axes = {w["node"]: w["axis"] for w in wanted}
        level, following, free = [], {}, max(nodes) + 1
        for number, node in nodes.items():
            if number not in found:  # a leaf, or a node that got no points
                following[number] = Node(node.first, 1)
                continue
            half = node.shards // 2
            level.append((number, axes[number], found[number], free, free + 1))
            following[free] = Node(node.first, half)
            following[free + 1] = Node(node.first + half, node.shards - half)
            free += 2
        if level:
            cuts = local_rows(spark, level, "node int, axis int, cut long, left int, right int")
            placed = materialize(_below(placed, cuts, names), "placed")
        nodes = following
    firsts = local_rows(spark, [(k, n.first) for k, n in nodes.items()], "node int, shard int")
    return placed.join(F.broadcast(firsts), "node").select("__group", "piece", "shard")


def kd_shards(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    dims: tuple[str, ...] = ("lang", "source"),
    shards: int | None = None,
    target_bytes: int | None = None,
) -> DataFrame:
    """All rows and columns plus ``size``, ``text_crc32``, ``shard`` and ``slot``.

    Sizes are the UTF-8 bytes of the text plus 8; a NULL text counts no bytes
    and has the checksum of the empty text. The dimensions are the size and
    the named text columns (NULL ranks with the empty text; for equal texts
    the smallest value counts). Give ``shards`` or ``target_bytes``. Slots
    run from 0 without gaps in every shard, in no particular order. Repeated
    rows get a slot each; an empty table stays empty. Columns of these names
    that the input has are replaced.
    """
    given = docs.drop("size", "text_crc32", "shard", "slot")
    rows = measured(given, doc_id, text)
    ranked = [f"__d{i}" for i in range(len(dims))]
    narrow = materialize(
        with_ranks(
            rows.select("__size", "__group", "__deal", *(F.col(d).alias(n) for d, n in zip(dims, ranked))), ranked
        ),
        "sizes",
    )
    total, count = narrow.agg(F.sum("__size"), F.count("*")).first()
    shards = shards or max(1, -(-(total or 0) // (target_bytes or total or 1)))
    shard_bytes = max(1.0, (total or 0) / shards)
    axes = [F.col("__size"), *map(F.col, ranked)]
    points, big = _points(narrow, axes, max(1, int(shard_bytes * PIECE)))
    leaves = materialize(_leaves(points, shards, shard_bytes, [f"d{i}" for i in range(len(axes))]), "leaves")
    # Groups are cut into pieces before the join, so no key is heavy.
    pieces = F.coalesce(F.pmod("__deal", "pieces"), F.lit(0)).cast("long")

    def with_shard(these: DataFrame) -> DataFrame:
        cut = these.join(F.broadcast(big), "__group", "left").withColumn("piece", pieces)
        return cut.join(leaves, ["__group", "piece"]).withColumn("__bin", F.pmod("__deal", F.lit(bins)))

    bins = max(1, count // (shards * SLOT_ROWS))
    before = Window.partitionBy("shard").orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        with_shard(narrow.select("__group", "__deal"))
        .groupBy("shard", "__bin")
        .count()
        .select("shard", "__bin", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__start"))
    )
    place = F.row_number().over(Window.partitionBy("shard", "__bin").orderBy("__deal")) - 1
    return (
        with_shard(rows)
        .withColumn("__place", place)
        .join(starts, ["shard", "__bin"])
        .select(
            *given.columns,
            F.col("__size").alias("size"),
            F.col("__crc").alias("text_crc32"),
            "shard",
            (F.col("__start") + F.col("__place")).cast("long").alias("slot"),
        )
    )
