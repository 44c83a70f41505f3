"""Connected components by iterative joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skerry.llm._store import materialise


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of `links`; component is its least node.

    Each round takes the least label among a node's neighbours and then the
    label of that label, so a path of n links settles in about log n rounds.
    Every round is stored, so a lost executor repeats one round only. Labels
    and links stay distributed; one number a round reaches the driver. Links
    with a null end are ignored; an empty table gives an empty result.
    """
    pairs = links.select(F.col(a).alias("src"), F.col(b).alias("dst")).dropna().filter("src <> dst")
    edges = materialise(pairs.union(pairs.select("dst", "src")).distinct())
    labels = materialise(
        edges.groupBy(F.col("src").alias("node")).agg(F.least(F.min("dst"), F.col("src")).alias("component"))
    )
    while True:
        near = (
            edges.join(labels.withColumnRenamed("node", "dst"), "dst")
            .groupBy(F.col("src").alias("node"))
            .agg(F.min("component").alias("near"))
        )
        lowered = labels.join(near, "node").select(
            "node", F.col("component").alias("old"), F.least("component", "near").alias("low")
        )
        jump = labels.select(F.col("node").alias("low"), F.col("component").alias("far"))
        moved = materialise(
            lowered.join(jump, "low", "left").select("node", "old", F.least("low", "far").alias("component"))
        )
        labels = moved.select("node", "component")
        if moved.filter("old <> component").limit(1).count() == 0:
            return labels


def merged(parts: DataFrame, links: DataFrame) -> DataFrame:
    """`parts` (node, component) with further links a, b, whose ends may be new nodes.

    Components take the place of their nodes first, so that the rounds see only
    the different pairs of components that links join.
    """
    of = lambda end: parts.select(F.col("node").alias(end), F.col("component").alias(f"of_{end}"))
    pairs = links.join(of("a"), "a", "left").join(of("b"), "b", "left")
    top = connected_components(pairs.select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b")).distinct())
    new = top.join(parts.select("node"), "node", "left_anti").select("node", F.col("node").alias("component"))
    higher = top.select(F.col("node").alias("component"), F.col("component").alias("least"))
    return materialise(parts.unionByName(new).join(higher, "component", "left").select("node", F.coalesce("least", "component").alias("component")))
