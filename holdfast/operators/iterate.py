"""Iteration helpers: lineage is cut by reliable checkpoints in the cluster's shared folder."""

from __future__ import annotations

import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def settle(df: DataFrame) -> DataFrame:
    """Compute ``df`` into the folder of ``spark.checkpoint.dir``; set one only where none is set."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(df.sparkSession.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="holdfast-"))
    return df.checkpoint(eager=True)


def fixpoint(start: DataFrame, step: Callable[[DataFrame], DataFrame], *, key: list[str], most: int = 1000) -> DataFrame:
    """Grow ``start`` by ``step(members)`` until a round adds no new key; rounds are synchronous.

    ``step`` returns candidates with the members' columns but ``round``; those already in are dropped.
    """
    members = settle(start.withColumn("round", F.lit(0)))
    for number in range(1, most + 1):
        new = settle(step(members).join(members.select(*key), key, "left_anti").withColumn("round", F.lit(number)))
        if new.isEmpty():
            return members
        members = settle(members.unionByName(new))
    raise RuntimeError(f"no fixed point within {most} rounds")


def walk(edges: DataFrame, sources: DataFrame, depth: int) -> DataFrame:
    """Level-synchronous breadth-first search of many origins: origin, node and least hops.

    ``edges`` has ``src`` and ``dst``; ``sources`` has ``origin`` and ``node``.
    """
    seen = frontier = sources.select("origin", "node").distinct().withColumn("hops", F.lit(0))
    for hop in range(1, depth + 1):
        reached = frontier.join(edges, frontier.node == edges.src).select("origin", F.col("dst").alias("node")).distinct()
        frontier = settle(reached.join(seen.select("origin", "node"), ["origin", "node"], "left_anti").withColumn("hops", F.lit(hop)))
        seen = seen.unionByName(frontier)
    return seen
