"""An ownership world projected from the star tables; shares are whole ten-thousandths of a percent.

Suppliers and customers are legal entities, event users are persons.  Owners are ``upper``, owned
``lower``.  ``low4`` and ``high4`` are null where the share is unknown.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """node, label, name, jurisdiction."""
    nation = table(spark, sf_dir, "nation")
    parts = []
    for source, key, letter in (("supplier", "s", "S"), ("customer", "c", "C")):
        t = table(spark, sf_dir, source)
        id_ = "s_suppkey" if key == "s" else "c_custkey"
        parts.append(t.join(nation, F.col(f"{key}_nationkey") == F.col("n_nationkey"), "left").select(F.concat(F.lit(letter), id_).alias("node"), F.lit("LegalEntity").alias("label"), F.col(f"{key}_name").alias("name"), F.col("n_name").alias("jurisdiction")))
    users = table(spark, sf_dir, "events").select("user_id").distinct()
    parts.append(users.select(F.concat(F.lit("U"), "user_id").alias("node"), F.lit("Person").alias("label"), F.concat(F.lit("User "), "user_id").alias("name"), F.lit(None).cast("string").alias("jurisdiction")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def holdings(spark: SparkSession, sf_dir: str, until: str | None = None) -> DataFrame:
    """The three largest suppliers of each customer with their share of the customer's spend."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    if until:
        orders = orders.filter(F.col("o_orderdate") < F.lit(until).cast("timestamp"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", F.round(F.col("l_extendedprice") * 100).cast("long").alias("cents"))
    spend = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_custkey", "l_suppkey").agg(F.sum("cents").alias("cents"))
    each = Window.partitionBy("o_custkey")
    ranked = spend.withColumns({"total": F.sum("cents").over(each), "place": F.row_number().over(each.orderBy(F.desc("cents"), "l_suppkey"))})
    share = F.expr("cast(cents * 1000000 div total as long)")
    return ranked.filter("place <= 3 AND total > 0").select(F.concat(F.lit("S"), "l_suppkey").alias("upper"), F.concat(F.lit("C"), "o_custkey").alias("lower"), share.alias("low4"), share.alias("high4"))


def edges(spark: SparkSession, sf_dir: str, until: str | None = None) -> DataFrame:
    """upper, lower, low4, high4: one row a pair."""
    supplier = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("b"))
    n = table(spark, sf_dir, "supplier").agg(F.count(F.lit(1)).alias("n"))
    pairs = supplier.crossJoin(F.broadcast(n)).select("b", F.explode(F.array(F.expr("b div 2"), F.expr("(3 * b + 1) % n"))).alias("a")).filter("a <> b").distinct()  # n is one row
    pct = F.expr("(20 + (37 * a + 11 * b) % 45) * 10000")
    unknown, ranged = F.expr("(a + b) % 11 = 0"), F.expr("(a + b) % 13 = 0")
    among = pairs.select(
        F.concat(F.lit("S"), "a").alias("upper"), F.concat(F.lit("S"), "b").alias("lower"),
        F.when(~unknown, F.when(ranged, pct - 100000).otherwise(pct)).alias("low4"), F.when(~unknown, F.when(ranged, pct + 100000).otherwise(pct)).alias("high4"),
    )
    customer = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("b")).filter("b % 2 = 1")
    chain = customer.select(F.concat(F.lit("C"), F.expr("(b - 1) div 2")).alias("upper"), F.concat(F.lit("C"), "b").alias("lower"), F.expr("cast((30 + (13 * b) % 60) * 10000 as long)").alias("low4")).withColumn("high4", F.col("low4"))
    return holdings(spark, sf_dir, until).unionByName(among).unionByName(chain).select("upper", "lower", F.col("low4").cast("long"), F.col("high4").cast("long"))


def designations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """node, list and whether the designation is active."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey")
    kind = F.expr("s_suppkey % 7")
    return s.filter(kind.isin(3, 5, 6)).select(F.concat(F.lit("S"), "s_suppkey").alias("node"), F.when(kind == 5, "OTHER").otherwise("MAIN").alias("list"), (kind != 6).alias("active"))


#: The same projection for the DuckDB oracle; {cut} limits the orders.
SQL = """
spend AS (SELECT o_custkey, l_suppkey, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS cents
          FROM lineitem JOIN orders ON l_orderkey = o_orderkey {cut} GROUP BY ALL),
ranked AS (SELECT *, sum(cents) OVER (PARTITION BY o_custkey) AS total,
                  row_number() OVER (PARTITION BY o_custkey ORDER BY cents DESC, l_suppkey) AS place FROM spend),
pairs AS (SELECT DISTINCT a, b FROM (SELECT s_suppkey // 2 AS a, s_suppkey AS b FROM supplier
          UNION ALL SELECT (3 * s_suppkey + 1) % (SELECT count(*) FROM supplier), s_suppkey FROM supplier) WHERE a <> b),
priced AS (SELECT a, b, (20 + (37 * a + 11 * b) % 45) * 10000 AS p, (a + b) % 11 = 0 AS unknown, (a + b) % 13 = 0 AS ranged FROM pairs),
edges AS (SELECT 'S' || l_suppkey AS upper, 'C' || o_custkey AS lower, CAST(cents * 1000000 // total AS BIGINT) AS low4,
                 CAST(cents * 1000000 // total AS BIGINT) AS high4 FROM ranked WHERE place <= 3 AND total > 0
          UNION ALL SELECT 'S' || a, 'S' || b, CASE WHEN NOT unknown THEN CASE WHEN ranged THEN p - 100000 ELSE p END END,
                 CASE WHEN NOT unknown THEN CASE WHEN ranged THEN p + 100000 ELSE p END END FROM priced
          UNION ALL SELECT 'C' || ((c_custkey - 1) // 2), 'C' || c_custkey, (30 + (13 * c_custkey) % 60) * 10000,
                 (30 + (13 * c_custkey) % 60) * 10000 FROM customer WHERE c_custkey % 2 = 1),
designated AS (SELECT 'S' || s_suppkey AS node, CASE WHEN s_suppkey % 7 = 5 THEN 'OTHER' ELSE 'MAIN' END AS list,
                 s_suppkey % 7 <> 6 AS active FROM supplier WHERE s_suppkey % 7 IN (3, 5, 6))
"""
