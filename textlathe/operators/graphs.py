"""Trees and graphs: components, breadth-first levels, generated trees, tallied edges."""

from __future__ import annotations

import itertools
import random

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textlathe.runtime import cut_lineage


def components(nodes: DataFrame, edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, component): the least id that a node is connected with.

    Each round every node takes the least label around it and then its label's own
    label (pointer jumping), so long chains take a logarithmic number of rounds. Lineage
    is cut by checkpoints every round; only a count of changes reaches the driver. Labels
    that still change after `rounds` rounds raise an error: no half-joined component is
    ever returned.
    """
    both = cut_lineage(edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).where("src != dst").distinct())
    label = nodes.select("id", F.col("id").alias("component"))
    for _ in range(rounds):
        seen = both.join(label, both["dst"] == label["id"]).groupBy("src").agg(F.min("component").alias("near"))
        near = label.join(seen, label["id"] == seen["src"], "left").select("id", "component", F.least("component", F.coalesce("near", "component")).alias("next"))
        jump = near.select(F.col("id").alias("k"), F.col("next").alias("far"))
        new = cut_lineage(near.join(jump, F.col("next") == F.col("k"), "left").select("id", F.col("component").alias("old"), F.least("next", F.coalesce("far", "next")).alias("component")))
        if new.where("old != component").isEmpty():
            return new.select("id", "component")
        label = new.select("id", "component")
    raise RuntimeError(f"components still change after {rounds} rounds")


def levels(edges: DataFrame, start: DataFrame, depth: int | None = None) -> DataFrame:
    """(node, level): steps from the start nodes along directed edges, cycles included.

    Every node that can be reached comes out, however deep, unless `depth` asks for the
    nodes of the first levels only.
    """
    found = cut_lineage(start.select(F.col("node"), F.lit(0).alias("level")).distinct())
    front = found
    for n in itertools.count(1) if depth is None else range(1, depth + 1):
        nxt = front.join(edges, front["node"] == edges["src"]).select(F.col("dst").alias("node")).distinct().join(found, "node", "left_anti")
        front = cut_lineage(nxt.withColumn("level", F.lit(n)))
        if front.isEmpty():
            break
        found = cut_lineage(found.unionByName(front)) if n % 10 == 0 else found.unionByName(front)
    return found


def tree(spark: SparkSession, depth: int = 4, seed: int = 1, most: int = 4) -> DataFrame:
    """A seeded random tree as rows of child-number paths."""
    rng = random.Random(seed)
    rows: list[list[int]] = [[]]
    for path in rows:
        if len(path) < depth:
            rows += [[*path, k] for k in range(rng.randint(1, most))]
    return spark.createDataFrame([(r,) for r in rows], "path array<int>")


def prefix_of(a: str, b: str):
    """Whether path a leads to path b."""
    return F.slice(F.col(b), F.lit(1), F.size(a)) == F.col(a)
