"""Differences of two snapshots, digests, the event chain and quality counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def edge_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """upper, lower, kind and the shares on both sides for edges that differ."""
    b = before.select("upper", "lower", F.col("low4").alias("low_before"), F.col("high4").alias("high_before"), F.lit(True).alias("was"))
    a = after.select("upper", "lower", F.col("low4").alias("low_after"), F.col("high4").alias("high_after"), F.lit(True).alias("is"))
    both = b.join(a, ["upper", "lower"], "full_outer")
    moved = ~(F.col("low_before").eqNullSafe(F.col("low_after")) & F.col("high_before").eqNullSafe(F.col("high_after")))
    kind = F.when(F.col("was").isNull(), "ADDED").when(F.col("is").isNull(), "REMOVED").when(moved, "CHANGED")
    return both.withColumn("kind", kind).filter("kind IS NOT NULL").select("upper", "lower", "kind", "low_before", "low_after")


def rescreen(changes: DataFrame, reach: DataFrame) -> DataFrame:
    """node, changes and hops: decisions that a changed edge below ``reach``'s origin may alter."""
    hit = changes.select(F.col("lower").alias("origin")).groupBy("origin").agg(F.count(F.lit(1)).alias("n"))
    return reach.join(hit, "origin").groupBy("node").agg(F.sum("n").alias("changes"), F.min("hops").alias("hops"))


def row_digest(*columns: Column) -> Column:
    """sha256 of the row's values as a JSON list of texts, so that null, empty and marks stay apart."""
    return F.sha2(F.to_json(F.array(*(c.cast("string") for c in columns))), 256)


def bucket_digests(rows: DataFrame, key: Column, digest: Column, size: Column) -> DataFrame:
    """One digest a bucket: sha256 of its row digests in key order, without a global sort."""
    listed = rows.select(size.alias("bucket"), F.struct(key.alias("k"), digest.alias("d")).alias("r")).groupBy("bucket").agg(F.sort_array(F.collect_list("r")).alias("rows"))
    return listed.select("bucket", F.size("rows").cast("long").alias("n"), F.sha2(F.concat_ws("\n", F.transform("rows", lambda r: r.d)), 256).alias("digest"))


def chain_faults(events: DataFrame, group: str, order: str, content: Column) -> DataFrame:
    """Rows whose ``prev_hash`` is not (or null instead of) the hash of the row before, or whose ``hash`` is not their content's."""
    each = Window.partitionBy(group).orderBy(order)
    linked = F.col("prev_hash").eqNullSafe(F.coalesce(F.lag("hash").over(each), F.sha2(F.lit("genesis"), 256)))
    own = F.col("hash").eqNullSafe(F.sha2(content, 256))
    return events.withColumn("_sound", linked & own).filter(~F.col("_sound")).drop("_sound")


def histogram(values: DataFrame, value: Column, width: float) -> DataFrame:
    """bin and n: counts by steps of ``width``, with a guard for binary fractions."""
    return values.select(F.floor(value / width + 1e-9).cast("long").alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).alias("n"))


def nearest_rank(values: DataFrame, group: str, value: str, shares: tuple[float, ...]) -> DataFrame:
    """Percentiles by nearest rank in each group, exact."""
    parts = [F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {value})").alias(f"p{round(p * 100)}") for p in shares]
    return values.groupBy(group).agg(*parts, F.max(value).alias("top"))


def masked(nodes: DataFrame, label: str = "Person") -> DataFrame:
    """Nodes as a role sees them that may not see persons: pseudonyms for ids, no names."""
    hidden = F.col("label") == label
    return nodes.select(F.when(hidden, F.concat(F.lit("p:"), F.left(F.sha2("node", 256), F.lit(12)))).otherwise(F.col("node")).alias("node"), "label", F.when(hidden, "***").otherwise(F.col("name")).alias("name"), F.when(~hidden, F.col("jurisdiction")).alias("jurisdiction"))
