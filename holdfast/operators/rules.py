"""The ownership-percentage rule as set-at-a-time fixed points over stated and unknown shares."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .iterate import fixpoint, settle

#: Half of all shares, in ten-thousandths of a percent.
HALF = 500_000


def seeds(designations: DataFrame, lists: tuple[str, ...] = ("MAIN",)) -> DataFrame:
    """Nodes with an active designation on one of the lists."""
    return designations.filter(F.col("active") & F.col("list").isin(*lists)).select("node").distinct()


def blocked(edges: DataFrame, start: DataFrame, threshold: int = HALF) -> DataFrame:
    """node, round and held4: nodes whose blocked owners hold the threshold for every value."""

    def step(members: DataFrame) -> DataFrame:
        held = edges.join(members.select(F.col("node").alias("upper")), "upper").groupBy(F.col("lower").alias("node")).agg(F.sum("low4").alias("held4"))
        return held.filter(F.col("held4") >= threshold)

    return fixpoint(start.select("node", F.lit(None).cast("long").alias("held4")), step, key=["node"])


def possibly_blocked(edges: DataFrame, sure: DataFrame, threshold: int = HALF) -> DataFrame:
    """node, round and basis: not blocked, but some value of the shares would block them.

    Holders are the blocked nodes and those found so far.  An unknown share of a holder presumes a
    majority and decides before the sums; then every value, then some value.
    """
    base = sure.select("node")

    def step(members: DataFrame) -> DataFrame:
        holders = members.select(F.col("node").alias("upper"))
        held = edges.join(holders, "upper").groupBy(F.col("lower").alias("node")).agg(F.bool_or(F.col("low4").isNull()).alias("unknown"), F.sum("low4").alias("low"), F.sum("high4").alias("high"))
        basis = F.when(F.col("unknown"), "PRESUMED_MAJORITY").when(F.col("low") >= threshold, "AGGREGATE").when(F.col("high") >= threshold, "RANGE")
        return held.select("node", basis.alias("basis")).filter("basis IS NOT NULL")

    found = fixpoint(base.withColumn("basis", F.lit("BLOCKED")), step, key=["node"])
    return found.filter("basis <> 'BLOCKED'")


def ownership_paths(edges: DataFrame, start: DataFrame, depth: int) -> DataFrame:
    """Simple downward paths of 1 to ``depth`` hops: first, node, nodes, product and unknown.

    ``product`` is the exact product of the shares as parts of 100 to the number of hops.
    """
    step = edges.select("upper", "lower", "low4")
    now = start.select(F.col("node").alias("first"), "node", F.array("node").alias("nodes"), F.lit(1).cast("decimal(38,0)").alias("product"), F.lit(False).alias("unknown"))
    found = None
    for _ in range(depth):
        grown = now.join(step, now.node == step.upper).filter(~F.array_contains("nodes", F.col("lower")))
        now = settle(grown.select("first", F.col("lower").alias("node"), F.concat("nodes", F.array("lower")).alias("nodes"), (F.col("product") * F.coalesce("low4", F.lit(0)).cast("decimal(10,0)")).cast("decimal(38,0)").alias("product"), (F.col("unknown") | F.col("low4").isNull()).alias("unknown")))
        found = now if found is None else found.unionByName(now)
    return found


def exposure(edges: DataFrame, sure: DataFrame, depth: int = 3) -> DataFrame:
    """node, paths, largest4, total4 and has_unknown over paths from the last blocked owner.

    Blocked targets have no exposure.  Products are brought to one denominator, then summed exactly.
    """
    names = sure.select("node")
    open_edges = edges.join(names.withColumnRenamed("node", "lower"), "lower", "left_anti")
    paths = ownership_paths(open_edges, names, depth)
    hops = F.size("nodes") - 1
    scaled = F.col("product") * F.element_at(F.array(*(F.lit(10 ** (6 * (depth - h))).cast("decimal(38,0)") for h in range(1, depth + 1))), hops)
    unit = F.lit(10 ** (6 * (depth - 1))).cast("decimal(38,0)")
    stated = paths.withColumn("scaled", F.when(~F.col("unknown"), scaled.cast("decimal(38,0)")))
    return stated.groupBy("node").agg(
        F.count(F.lit(1)).alias("paths"),
        F.floor(F.max("scaled") / unit).cast("long").alias("largest4"),
        F.floor(F.sum("scaled").cast("decimal(38,0)") / unit).cast("long").alias("total4"),
        F.bool_or("unknown").alias("has_unknown"),
    )


def recommendation(nodes: DataFrame, sure: DataFrame, maybe: DataFrame, near: DataFrame) -> DataFrame:
    """ESCALATE for blocked nodes, REVIEW for those with a finding, else CLEAR."""
    out = nodes.select("node").join(sure.select("node", F.lit(True).alias("is_blocked")), "node", "left").join(maybe.select("node", F.lit(True).alias("is_possible")), "node", "left").join(near.select("node", F.lit(True).alias("is_near")), "node", "left")
    return out.select("node", F.when(F.col("is_blocked"), "ESCALATE").when(F.col("is_possible") | F.col("is_near"), "REVIEW").otherwise("CLEAR").alias("recommendation"))


def near_miss(edges: DataFrame, sure: DataFrame, floor4: int = 400_000) -> DataFrame:
    """node and held4: not blocked, held directly by blocked nodes at or above ``floor4``."""
    held = edges.join(sure.select(F.col("node").alias("upper")), "upper").groupBy(F.col("lower").alias("node")).agg(F.sum("low4").alias("held4"))
    return held.join(sure.select("node"), "node", "left_anti").filter(F.col("held4") >= floor4)
