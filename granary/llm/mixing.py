"""Mixing sources to target weights by hierarchical budgets, as DataFrames.

Weights are propagated down a tree (domain, language, source). A node never
gets more than its subtree can supply; what it cannot take goes to its
siblings by their weights, and what a whole family cannot take has already
gone to the siblings of its parent. Each leaf then takes whole epochs and a
token prefix of one more, in a seeded order.

Budgets are integers, so the shares add up to the last token.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.runtime import at_most, materialize

SPACES = "[ \\t-\\r]+"
# Leaves handed to every executor when documents look up their share.
BROADCAST_LEAVES = 50_000


def n_words(text: Column) -> Column:
    """Words between white space; none in a NULL or blank text."""
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")).cast("long")


def _share(children: DataFrame, parent: list[str]) -> DataFrame:
    """Split each parent's budget: adds ``budget`` to rows with cap, weight, given.

    Children sorted by capacity per weight: a child is full if its share of
    what is left reaches its capacity, so the full ones come first. The rest
    is dealt by weight, with left-over tokens to the largest remainders.
    """
    big = "decimal(38,0)"
    family = Window.partitionBy(*parent)
    by_need = family.orderBy(F.col("ratio"), F.col("name"))
    earlier = by_need.rowsBetween(Window.unboundedPreceding, -1)
    rows = (
        children.withColumn("cap", F.when(F.col("weight") > 0, F.col("cap")).otherwise(0))
        .withColumn("ratio", F.when(F.col("weight") > 0, F.col("cap") / F.col("weight")).otherwise(F.lit(1e300)))
        .withColumn("left_w", F.sum("weight").over(family) - F.coalesce(F.sum("weight").over(earlier), F.lit(0)))
        .withColumn("left_b", F.col("given") - F.coalesce(F.sum("cap").over(earlier), F.lit(0)))
        .withColumn(
            "full",
            F.col("cap").cast("decimal(20,0)") * F.col("left_w").cast("decimal(18,0)")
            <= F.greatest(F.col("left_b"), F.lit(0)).cast("decimal(20,0)") * F.col("weight").cast("decimal(18,0)"),
        )
    )
    rows = (
        rows.withColumn("open_b", F.col("given") - F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0)).over(family))
        .withColumn("open_w", F.sum(F.when(F.col("full"), 0).otherwise(F.col("weight"))).over(family))
        .withColumn("product", F.col("open_b").cast("decimal(20,0)") * F.col("weight").cast("decimal(18,0)"))
        .withColumn("open", ~F.col("full") & (F.col("open_w") > 0) & (F.col("weight") > 0))
        .withColumn("share", F.when(F.col("open"), F.expr("CAST(product DIV open_w AS BIGINT)")).otherwise(0))
        .withColumn(
            "rest",
            F.when(F.col("open"), F.col("product") - (F.col("share").cast(big) * F.col("open_w"))).otherwise(F.lit(-1).cast(big)),
        )
    )
    spare = F.col("open_b") - F.sum("share").over(family)
    turn = F.row_number().over(family.orderBy(F.desc("rest"), F.col("name")))
    extra = F.when(F.col("open") & (turn <= spare), 1).otherwise(0)
    return rows.withColumn(
        "budget", F.when(F.col("full"), F.col("cap")).otherwise(F.col("share") + extra).cast("long")
    )


def leaf_budgets(
    leaves: DataFrame, levels: list[str], weights: DataFrame, budget: int, max_epochs: int
) -> DataFrame:
    """Leaves (level columns, tokens, docs) with ``budget``.

    ``weights`` has level (0 is the top), name and weight (a whole number);
    nodes without a row weigh 1, those of weight 0 get nothing.
    """
    def weight_of(nodes: DataFrame, depth: int) -> DataFrame:
        own = weights.filter(F.col("level") == depth).select(
            F.col("name").alias("__n"), F.col("weight").cast("long").alias("__w")
        )
        return (
            nodes.join(own, F.col(levels[depth]) == F.col("__n"), "left")
            .withColumn("weight", F.coalesce("__w", F.lit(1)))
            .withColumn("name", F.col(levels[depth]))
            .drop("__n", "__w")
        )

    # What a subtree can supply, from the leaves up; a weight of 0 shuts it.
    below = weight_of(leaves.withColumn("cap", F.col("tokens") * max_epochs), len(levels) - 1)
    tree = [below]
    for depth in range(len(levels) - 2, -1, -1):
        usable = F.when(F.col("weight") > 0, F.col("cap")).otherwise(0)
        below = weight_of(below.groupBy(*levels[: depth + 1]).agg(F.sum(usable).alias("cap")), depth)
        tree.insert(0, below)
    given = None
    for depth, nodes in enumerate(tree):
        if depth == 0:
            rows = nodes.withColumn("__root", F.lit(0)).withColumn("given", F.lit(budget).cast("long"))
            done = _share(rows, ["__root"])
        else:
            parent = levels[:depth]
            done = _share(nodes.join(given, parent), parent)
        given = done.select(*levels[: depth + 1], F.col("budget").alias("given"))
    return done.select(*levels, "tokens", "docs", "budget")


def _order_key(seed: int, epoch: Column, row: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), row).cast("binary"))


def _bin(key: Column, docs: Column) -> Column:
    """Slice of the seeded order: as many slices of a leaf as documents in each,
    so that both stay the square root of the leaf."""
    bins = F.floor(F.sqrt(docs.cast("double"))) + 1
    head = F.conv(F.substring(key, 1, 8), 16, 10).cast("long")
    return F.floor(head * bins / F.lit(float(1 << 32))).cast("long")


def mix(
    docs: DataFrame,
    levels: dict[str, Column],
    weights: DataFrame,
    budget: float | int,
    max_epochs: int = 4,
    seed: int = 7,
    doc_id: str = "doc_id",
    text: str = "text",
    tokens: Column | None = None,
) -> DataFrame:
    """Documents with ``n_tokens`` and ``copies`` (1 or more), all columns kept.

    ``levels`` names the nodes of the tree from the top; NULL names are the
    node ``none``. ``budget`` is a number of tokens, or a part (a float) of
    those there are. ``copies`` counts the whole epochs of the leaf plus one
    if the document is in the prefix of the last. A prefix ends before the
    document that would exceed it; documents of no words ride along. Order
    depends on seed, epoch and id alone: rows that share an id go together.
    Input columns named like the levels or the two new ones are replaced.
    """
    names = list(levels)
    new = [*names, "n_tokens", "copies"]
    given = docs.select(
        *(c for c in docs.columns if c not in new),
        *(F.coalesce(v.cast("string"), F.lit("none")).alias(k) for k, v in levels.items()),
        (n_words(F.col(text)) if tokens is None else tokens).alias("n_tokens"),
        F.coalesce(F.col(doc_id).cast("string"), F.lit("none")).alias("__row"),
    )
    # Texts are read once here; what follows works on the counts.
    counts = materialize(given.select(*names, "__row", "n_tokens"), "token-counts")
    leaves = materialize(
        counts.groupBy(*names).agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs")), "leaves"
    )
    if isinstance(budget, float):
        budget = int(budget * (leaves.agg(F.sum("tokens")).first()[0] or 0))
    plans = materialize(
        leaf_budgets(leaves, names, weights, budget, max_epochs)
        .withColumn("epochs", F.when(F.col("tokens") > 0, F.expr("budget DIV tokens")).otherwise(0))
        .withColumn("rest", F.col("budget") - F.col("epochs") * F.col("tokens"))
        .select(*names, "docs", "epochs", "rest"),
        "budgets",
    )

    def keyed(rows: DataFrame, table: DataFrame) -> DataFrame:
        small = F.broadcast(table) if at_most(table, BROADCAST_LEAVES) else table
        return (
            rows.join(small, names)
            .withColumn("__key", _order_key(seed, F.col("epochs"), F.col("__row")))
            .withColumn("__bin", _bin(F.col("__key"), F.col("docs")))
        )

    placed = keyed(counts, plans)
    per_leaf = Window.partitionBy(*names)
    bins = placed.groupBy(*names, "rest", "__bin").agg(F.sum("n_tokens").alias("bin_tokens"))
    # The first bin that the prefix cannot take whole; every leaf has one, as rest < tokens.
    edge = (
        bins.withColumn("reach", F.sum("bin_tokens").over(per_leaf.orderBy("__bin")))
        .filter("reach > rest")
        .groupBy(*names)
        .agg(F.min_by(F.struct("__bin", F.expr("reach - bin_tokens AS before")), "__bin").alias("edge"))
        .select(*names, F.col("edge.__bin").alias("__bin"), F.col("edge.before").alias("before"))
    )
    inside = placed.join(edge, [*names, "__bin"]).withColumn(
        "reach", F.col("before") + F.sum("n_tokens").over(per_leaf.orderBy("__key"))
    )
    last = inside.filter("reach <= rest").groupBy(*names).agg(F.max("__key").alias("last"))
    cut = materialize(
        plans.join(edge.withColumnRenamed("__bin", "edge"), names, "left")
        .join(last, names, "left")
        .select(*names, "docs", "epochs", "edge", "last"),
        "cuts",
    )
    within = (F.col("__bin") < F.col("edge")) | ((F.col("__bin") == F.col("edge")) & (F.col("__key") <= F.col("last")))
    copies = F.col("epochs") + F.coalesce(within, F.lit(False)).cast("int")
    return (
        keyed(given, cut)
        .withColumn("copies", copies.cast("int"))
        .filter("copies > 0")
        .select(*(c for c in docs.columns if c not in new), *new)
    )
