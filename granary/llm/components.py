"""Connected components of a link table, as joins that never gather a component."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.runtime import materialize


def connected_components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """``node, root`` for every node of ``links`` (a, b): the smallest node reachable.

    Each round takes the smallest root among a node's neighbours, hooks the
    root it had onto it and follows roots of roots once, so that chains halve
    and stars finish in one round. Every join is on a node id: the labels have
    one row per node, and the adaptive skew join splits the links of a hub,
    whose minimum is aggregated before the shuffle. Each round is written to
    the shared folder, so a lost executor repeats one round only. Self links
    are allowed, NULL ends are ignored.
    """
    both = links.filter("a IS NOT NULL AND b IS NOT NULL AND a <> b").select("a", "b")
    edges = materialize(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = materialize(
        edges.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("root")),
        "labels",
    )
    for _ in range(rounds):
        near = labels.select(F.col("node").alias("b"), F.col("root").alias("seen"))
        lowest = edges.join(near, "b").groupBy(F.col("a").alias("node")).agg(F.min("seen").alias("seen"))
        best = materialize(
            labels.join(lowest, "node").select("node", "root", F.least("root", "seen").alias("best")), "best"
        )
        # The old root learns the best label any of its members has seen.
        hooks = best.filter("best < root").groupBy(F.col("root").alias("node")).agg(F.min("best").alias("hook"))
        hooked = best.join(hooks, "node", "left").select(
            "node", "root", F.least("best", F.coalesce("hook", F.col("best"))).alias("best")
        )
        step = materialize(hooked, "hooked")
        jump = step.select(F.col("node").alias("best"), F.col("best").alias("far"))
        jumped = materialize(
            step.join(jump, "best").select("node", "root", F.least("best", "far").alias("now")), "jumped"
        )
        changed = jumped.filter("now <> root").limit(1).count()
        labels = jumped.select("node", F.col("now").alias("root"))
        if not changed:
            return labels
    raise RuntimeError(f"components did not settle in {rounds} rounds")
