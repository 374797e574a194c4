"""Graph queries over many targets at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .iterate import settle, walk


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, owners and holdings, zero where there are none."""
    up = edges.groupBy(F.col("lower").alias("node")).agg(F.count(F.lit(1)).alias("owners"))
    down = edges.groupBy(F.col("upper").alias("node")).agg(F.count(F.lit(1)).alias("holdings"))
    return nodes.select("node").join(up, "node", "left").join(down, "node", "left").select("node", F.coalesce("owners", F.lit(0)).alias("owners"), F.coalesce("holdings", F.lit(0)).alias("holdings"))


def owners_within(edges: DataFrame, targets: DataFrame, depth: int) -> DataFrame:
    """origin, node, hops: every owner of each target within ``depth`` hops up."""
    return walk(edges.select(F.col("lower").alias("src"), F.col("upper").alias("dst")), targets.select(F.col("node").alias("origin"), "node"), depth)


def affected(edges: DataFrame, sources: DataFrame, depth: int) -> DataFrame:
    """origin, node, hops: everything each source reaches downwards."""
    return walk(edges.select(F.col("upper").alias("src"), F.col("lower").alias("dst")), sources.select(F.col("node").alias("origin"), "node"), depth)


def cut_off(edges: DataFrame, reached: DataFrame, depth: int) -> DataFrame:
    """origin and node where the search stopped at ``depth`` although there are further owners."""
    beyond = reached.filter(F.col("hops") == depth).join(edges, reached.node == edges.lower).select("origin", "node", "upper")
    known = reached.select("origin", F.col("node").alias("upper"))
    return beyond.join(known, ["origin", "upper"], "left_anti").select("origin", "node").distinct()


def direct_owners(edges: DataFrame, targets: DataFrame) -> DataFrame:
    """The edges one hop above each target."""
    return edges.join(targets.select(F.col("node").alias("lower")).distinct(), "lower", "left_semi")


def paths_between(edges: DataFrame, pairs: DataFrame, depth: int, most: int = 50) -> DataFrame:
    """source, target, nodes and hops: simple paths of at most ``depth`` hops, either way down.

    The ``most`` shortest of each pair (a report's limit), then by their nodes.  A path only grows
    to nodes from which its end is still in reach, which one search up from the ends finds first.
    """
    if not 1 <= depth <= 10:
        raise ValueError(f"depth must be 1 to 10, not {depth}")
    given = pairs.select("source", "target").distinct().filter("source <> target")
    both = given.withColumns({"node": F.col("source"), "end": F.col("target")}).unionByName(given.withColumns({"node": F.col("target"), "end": F.col("source")}))
    both = settle(both)
    near = owners_within(edges, both.select(F.col("end").alias("node")).distinct(), depth - 1)
    near = settle(near.select(F.col("origin").alias("end"), F.col("node").alias("lower"), "hops"))
    step = edges.select(F.col("upper").alias("node"), "lower").distinct()
    now, found = both.withColumn("nodes", F.array("node")), None
    for hop in range(1, depth + 1):
        grown = now.join(step, "node").filter(~F.array_contains("nodes", F.col("lower")))
        grown = grown.join(near.filter(F.col("hops") <= depth - hop).drop("hops"), ["end", "lower"], "left_semi")
        now = settle(grown.select("source", "target", F.col("lower").alias("node"), "end", F.concat("nodes", F.array("lower")).alias("nodes")))
        done = now.filter("node = end").select("source", "target", "nodes", F.lit(hop).alias("hops"))
        found = done if found is None else found.unionByName(done)
        now = now.filter("node <> end")
    order = Window.partitionBy("source", "target").orderBy("hops", "nodes")
    return found.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most).drop("place")


def common_controllers(edges: DataFrame, group: DataFrame) -> DataFrame:
    """Owners of at least two members of a group: upper and how many."""
    held = edges.join(group.select(F.col("node").alias("lower")), "lower", "left_semi")
    return held.groupBy("upper").agg(F.countDistinct("lower").alias("members")).filter("members >= 2")


def siblings(edges: DataFrame, targets: DataFrame, most: int) -> DataFrame:
    """node, upper, sibling and how many siblings that upper gives; the first ``most`` by id (a report's limit).

    ``edges`` has a pair once.  Each upper's first ``most`` + 1 members are found before the join,
    in parts by hash first, so that an upper with very many members is no single task.
    """
    part = Window.partitionBy("upper", F.pmod(F.xxhash64("sibling"), F.lit(64))).orderBy("sibling")
    whole = Window.partitionBy("upper").orderBy("sibling")
    first = edges.select("upper", F.col("lower").alias("sibling"))
    for each in (part, whole):
        first = first.withColumn("place", F.row_number().over(each)).filter(F.col("place") <= most + 1).select("upper", "sibling")
    counts = edges.groupBy("upper").agg((F.count(F.lit(1)) - 1).alias("peers"))
    up = edges.join(targets.select(F.col("node").alias("lower")), "lower", "left_semi").select(F.col("lower").alias("node"), "upper")
    listed = first.join(counts, "upper").groupBy("upper", "peers").agg(F.sort_array(F.collect_list("sibling")).alias("members"))
    others = F.slice(F.filter("members", lambda m: m != F.col("node")), 1, most)
    return up.join(listed, "upper").select("node", "upper", F.explode(others).alias("sibling"), "peers")


def edge_ids(edges: DataFrame) -> DataFrame:
    """Edges with a stable id: 16 hex digits of the digest of the canonical JSON of their key."""
    key = F.to_json(F.array("upper", "lower", F.lit("OWNS")))
    text = F.concat(F.left(key, F.length(key) - 1), F.lit(",false]"))
    return edges.withColumn("edge_id", F.left(F.sha2(text, 256), F.lit(16)))
