"""Registered queries over the star tables' ownership world, each with DuckDB SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import names as N
from ..functions import text as T
from ..functions import values as V
from ..operators import changes, graph, iterate, rules
from ..sources import world
from ..streaming import events as windows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: Date that parts the two snapshots.
CUT = "1998-01-01"
_W = "WITH " + world.SQL.replace("{cut}", "")


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def _rounds(n: int) -> str:
    """Blocked sets b0 to bn as a chain of tables, one a round."""
    out = [_W + ", b0 AS MATERIALIZED (SELECT DISTINCT node, 0 AS round, CAST(NULL AS BIGINT) AS held4 FROM designated WHERE active AND list = 'MAIN')", "e AS MATERIALIZED (SELECT * FROM edges)"]
    for i in range(1, n + 1):
        out.append(
            f"b{i} AS MATERIALIZED (SELECT * FROM b{i - 1} UNION ALL SELECT e.lower, {i}, CAST(sum(e.low4) AS BIGINT) FROM e JOIN b{i - 1} b ON b.node = e.upper "
            f"WHERE e.lower NOT IN (SELECT node FROM b{i - 1}) GROUP BY e.lower HAVING sum(e.low4) >= 500000)"
        )
    return ", ".join(out)


_ROUNDS = 24
_BLOCKED = _rounds(_ROUNDS)


def _maybe(n: int) -> str:
    out = [_BLOCKED, f"m0 AS MATERIALIZED (SELECT node, 0 AS round, 'BLOCKED' AS basis FROM b{_ROUNDS})"]
    for i in range(1, n + 1):
        out.append(
            f"m{i} AS MATERIALIZED (SELECT * FROM m{i - 1} UNION ALL SELECT node, {i}, basis FROM (SELECT e.lower AS node, CASE WHEN bool_or(e.low4 IS NULL) THEN 'PRESUMED_MAJORITY' "
            f"WHEN sum(e.low4) >= 500000 THEN 'AGGREGATE' WHEN sum(e.high4) >= 500000 THEN 'RANGE' END AS basis FROM e JOIN m{i - 1} m ON m.node = e.upper "
            f"WHERE e.lower NOT IN (SELECT node FROM m{i - 1}) GROUP BY e.lower) WHERE basis IS NOT NULL)"
        )
    return ", ".join(out)


_POSSIBLE = _maybe(_ROUNDS)
_NEAR = f"SELECT e.lower AS node, CAST(sum(e.low4) AS BIGINT) AS held4 FROM e JOIN b{_ROUNDS} b ON b.node = e.upper WHERE e.lower NOT IN (SELECT node FROM b{_ROUNDS}) GROUP BY 1 HAVING sum(e.low4) >= 400000"


def _sure(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = iterate.settle(world.edges(spark, sf_dir))
    return e, rules.blocked(e, rules.seeds(world.designations(spark, sf_dir)))


@query(_W + "SELECT upper, lower, CAST(low4 AS BIGINT) AS low4, CAST(high4 AS BIGINT) AS high4 FROM edges")
def ownership_edges(spark, sf_dir):
    return world.edges(spark, sf_dir)


@query(f"{_BLOCKED} SELECT node, CAST(round AS INTEGER) AS round, held4 FROM b{_ROUNDS}")
def blocked_set(spark, sf_dir):
    return _sure(spark, sf_dir)[1].select("node", "round", "held4")


@query(f"{_POSSIBLE} SELECT node, CAST(round AS INTEGER) AS round, basis FROM m{_ROUNDS} WHERE basis <> 'BLOCKED'")
def possibly_blocked(spark, sf_dir):
    e, sure = _sure(spark, sf_dir)
    return rules.possibly_blocked(e, sure).select("node", "round", "basis")


@query(f"{_BLOCKED} {_NEAR}")
def near_miss(spark, sf_dir):
    return rules.near_miss(*_sure(spark, sf_dir))


_NODES = "n AS (SELECT 'S' || s_suppkey AS node, 'LegalEntity' AS label, s_name AS name, n_name AS jurisdiction FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey UNION ALL SELECT 'C' || c_custkey, 'LegalEntity', c_name, n_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey UNION ALL SELECT DISTINCT 'U' || user_id, 'Person', 'User ' || user_id, NULL FROM events)"


@query(f"{_POSSIBLE}, {_NODES}, near AS ({_NEAR}) SELECT node, CASE WHEN node IN (SELECT node FROM b{_ROUNDS}) THEN 'ESCALATE' WHEN node IN (SELECT node FROM m{_ROUNDS}) OR node IN (SELECT node FROM near) THEN 'REVIEW' ELSE 'CLEAR' END AS recommendation FROM n")
def recommendation(spark, sf_dir):
    e, sure = _sure(spark, sf_dir)
    return rules.recommendation(world.nodes(spark, sf_dir), sure, rules.possibly_blocked(e, sure), rules.near_miss(e, sure))


@query(
    f"{_BLOCKED}, o AS MATERIALIZED (SELECT * FROM e WHERE lower NOT IN (SELECT node FROM b{_ROUNDS})), "
    f"p1 AS MATERIALIZED (SELECT b.node AS first, o.lower AS node, [b.node, o.lower] AS nodes, CAST(coalesce(o.low4, 0) AS HUGEINT) AS product, o.low4 IS NULL AS unknown FROM b{_ROUNDS} b JOIN o ON o.upper = b.node), "
    "p2 AS MATERIALIZED (SELECT first, o.lower AS node, list_append(nodes, o.lower) AS nodes, product * coalesce(o.low4, 0) AS product, unknown OR o.low4 IS NULL AS unknown FROM p1 JOIN o ON o.upper = p1.node WHERE NOT list_contains(nodes, o.lower)), "
    "p3 AS MATERIALIZED (SELECT first, o.lower AS node, list_append(nodes, o.lower) AS nodes, product * coalesce(o.low4, 0) AS product, unknown OR o.low4 IS NULL AS unknown FROM p2 JOIN o ON o.upper = p2.node WHERE NOT list_contains(nodes, o.lower)), "
    "a AS (SELECT node, unknown, product * 1000000000000 AS scaled FROM p1 UNION ALL SELECT node, unknown, product * 1000000 FROM p2 UNION ALL SELECT node, unknown, product FROM p3) "
    "SELECT node, count(*) AS paths, CAST(max(scaled) FILTER (NOT unknown) // 1000000000000 AS BIGINT) AS largest4, CAST(sum(scaled) FILTER (NOT unknown) // 1000000000000 AS BIGINT) AS total4, bool_or(unknown) AS has_unknown FROM a GROUP BY node"
)
def exposure(spark, sf_dir):
    return rules.exposure(*_sure(spark, sf_dir), depth=3)


@query(f"{_W}, {_NODES} SELECT n.node, (SELECT count(*) FROM edges WHERE lower = n.node) AS owners, (SELECT count(*) FROM edges WHERE upper = n.node) AS holdings FROM n")
def degree(spark, sf_dir):
    return graph.degrees(world.nodes(spark, sf_dir), world.edges(spark, sf_dir))


def _bfs(src: str, dst: str, start: str, depth: int) -> str:
    out = [_W + f", e AS MATERIALIZED (SELECT * FROM edges), r0 AS MATERIALIZED (SELECT DISTINCT node AS origin, node, 0 AS hops FROM {start})"]
    out += [f"r{i} AS MATERIALIZED (SELECT * FROM r{i - 1} UNION ALL (SELECT DISTINCT origin, e.{dst}, {i} FROM r{i - 1} r JOIN e ON e.{src} = r.node WHERE r.hops = {i - 1} AND (origin, e.{dst}) NOT IN (SELECT (origin, node) FROM r{i - 1})))" for i in range(1, depth + 1)]
    return ", ".join(out)


_CUST = "(SELECT 'C' || c_custkey AS node FROM customer)"


def _customers(spark, sf_dir):
    return world.table(spark, sf_dir, "customer").select(F.concat(F.lit("C"), "c_custkey").alias("node"))


@query(f"{_bfs('lower', 'upper', _CUST, 3)} SELECT origin, node, hops FROM r3")
def owners_within(spark, sf_dir):
    return graph.owners_within(iterate.settle(world.edges(spark, sf_dir)), _customers(spark, sf_dir), 3)


@query(f"{_bfs('lower', 'upper', _CUST, 2)} SELECT DISTINCT origin, node FROM r2 JOIN e ON e.lower = r2.node WHERE hops = 2 AND (origin, e.upper) NOT IN (SELECT (origin, node) FROM r2)")
def truncated(spark, sf_dir):
    e = iterate.settle(world.edges(spark, sf_dir))
    return graph.cut_off(e, graph.owners_within(e, _customers(spark, sf_dir), 2), 2)


@query(f"{_bfs('upper', 'lower', '(SELECT node FROM designated WHERE active)', 4)} SELECT origin, node, hops FROM r4")
def affected(spark, sf_dir):
    return graph.affected(iterate.settle(world.edges(spark, sf_dir)), world.designations(spark, sf_dir).filter("active"), 4)


@query(f"{_W} SELECT upper, count(DISTINCT lower) AS members FROM edges WHERE lower IN {_CUST} GROUP BY upper HAVING count(DISTINCT lower) >= 2")
def common_controllers(spark, sf_dir):
    return graph.common_controllers(world.edges(spark, sf_dir), _customers(spark, sf_dir))


@query(
    f"{_W}, k AS (SELECT upper, lower, row_number() OVER (PARTITION BY upper ORDER BY lower) AS place, count(*) OVER (PARTITION BY upper) - 1 AS peers FROM edges), "
    "p AS (SELECT a.lower AS node, a.upper, k.lower AS sibling, peers, row_number() OVER (PARTITION BY a.lower, a.upper ORDER BY k.lower) AS place "
    "FROM edges a JOIN k ON k.upper = a.upper AND k.place <= 51 AND k.lower <> a.lower) SELECT node, upper, sibling, peers FROM p WHERE place <= 50"
)
def siblings(spark, sf_dir):
    return graph.siblings(world.edges(spark, sf_dir), world.nodes(spark, sf_dir), 50)


@query(f"""{_W} SELECT upper, lower, CAST(low4 AS BIGINT) AS low4, CAST(high4 AS BIGINT) AS high4, left(sha256('["' || upper || '","' || lower || '","OWNS",false]'), 16) AS edge_id FROM edges""")
def edge_ids(spark, sf_dir):
    return graph.edge_ids(world.edges(spark, sf_dir))


@query(f"{_W} SELECT lower, CAST(sum(low4) AS BIGINT) AS total4 FROM edges WHERE low4 = high4 GROUP BY lower HAVING sum(low4) > 1000000")
def share_over_100(spark, sf_dir):
    return world.edges(spark, sf_dir).filter("low4 = high4").groupBy("lower").agg(F.sum("low4").alias("total4")).filter("total4 > 1000000")


_OLD = world.SQL.replace("{cut}", f"WHERE o_orderdate < TIMESTAMP '{CUT}'").replace("edges AS", "old_edges AS").replace("spend AS", "old_spend AS").replace("FROM spend", "FROM old_spend").replace("ranked AS", "old_ranked AS").replace("FROM ranked", "FROM old_ranked")
_OLD = _OLD.split("\npairs AS")[0] + "\nold_edges AS" + _OLD.split("old_edges AS")[1].split("\ndesignated AS")[0]
_DIFF = _W + ", " + _OLD.rstrip().rstrip(",") + ", d AS (SELECT coalesce(b.upper, a.upper) AS upper, coalesce(b.lower, a.lower) AS lower, CASE WHEN b.upper IS NULL THEN 'ADDED' WHEN a.upper IS NULL THEN 'REMOVED' WHEN a.low4 IS DISTINCT FROM b.low4 OR a.high4 IS DISTINCT FROM b.high4 THEN 'CHANGED' END AS kind, CAST(b.low4 AS BIGINT) AS low_before, CAST(a.low4 AS BIGINT) AS low_after FROM old_edges b FULL JOIN edges a ON a.upper = b.upper AND a.lower = b.lower)"


@query(f"{_DIFF} SELECT * FROM d WHERE kind IS NOT NULL")
def snapshot_diff(spark, sf_dir):
    return changes.edge_changes(world.edges(spark, sf_dir, CUT), world.edges(spark, sf_dir))


@query(f"{_DIFF} SELECT kind, count(*) AS n FROM d WHERE kind IS NOT NULL GROUP BY kind")
def change_counts(spark, sf_dir):
    return snapshot_diff(spark, sf_dir).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


_BLOCKS = "b AS (SELECT DISTINCT p_partkey AS id, left(t, 4) AS block FROM (SELECT p_partkey, unnest(string_split(lower(p_name), ' ')) AS t FROM part) WHERE t <> '')"


def _part_blocks(spark, sf_dir):
    return world.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.explode(T.blocks(F.col("p_name"))).alias("block"))


@query(f"WITH {_BLOCKS} SELECT id, block FROM b")
def name_blocks(spark, sf_dir):
    return _part_blocks(spark, sf_dir)


@query(f"WITH {_BLOCKS}, s AS (SELECT block, count(*) AS n FROM b GROUP BY block) SELECT block, n, CAST(coalesce(sum(n) OVER (ORDER BY n, block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS in_hand FROM s")
def probe_plan(spark, sf_dir):
    sizes = _part_blocks(spark, sf_dir).groupBy("block").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("n", "block").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.withColumn("in_hand", F.coalesce(F.sum("n").over(before), F.lit(0)))


@query(
    "WITH c AS (SELECT c_nationkey, count(*) AS n, min_by(c_name, c_custkey) FILTER (WHERE c_acctbal > 0) AS first_in_credit, string_agg(DISTINCT c_mktsegment, ';' ORDER BY c_mktsegment) AS segments FROM customer GROUP BY c_nationkey) SELECT n_name, c.n, first_in_credit, segments FROM nation LEFT JOIN c ON n_nationkey = c_nationkey"
)
def survivorship(spark, sf_dir):
    c = world.table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"), F.min_by("c_name", F.when(F.col("c_acctbal") > 0, F.col("c_custkey"))).alias("first_in_credit"), F.concat_ws(";", F.sort_array(F.collect_set("c_mktsegment"))).alias("segments"))
    return world.table(spark, sf_dir, "nation").join(c, F.col("n_nationkey") == F.col("c_nationkey"), "left").select("n_name", "n", "first_in_credit", "segments")


@query("SELECT o_custkey, o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY (o_orderstatus = 'P'), o_orderdate DESC, o_orderkey) AS place FROM orders) WHERE place = 1")
def record_winner(spark, sf_dir):
    each = Window.partitionBy("o_custkey").orderBy(F.col("o_orderstatus") == "P", F.desc("o_orderdate"), "o_orderkey")
    return world.table(spark, sf_dir, "orders").withColumn("place", F.row_number().over(each)).filter("place = 1").select("o_custkey", "o_orderkey", "o_orderstatus")


@query("SELECT code, nullif(regexp_extract(upper(trim(code)), '^([A-Z]{2})(\\s*-.*)?$', 1), '') AS jurisdiction, count(*) AS n FROM (SELECT CASE o_orderkey % 4 WHEN 0 THEN 'us-de' WHEN 1 THEN ' gb ' WHEN 2 THEN 'X1' ELSE 'fr - x' END AS code FROM orders) GROUP BY ALL")
def jurisdictions(spark, sf_dir):
    code = F.expr("CASE o_orderkey % 4 WHEN 0 THEN 'us-de' WHEN 1 THEN ' gb ' WHEN 2 THEN 'X1' ELSE 'fr - x' END")
    return world.table(spark, sf_dir, "orders").select(code.alias("code")).groupBy("code", T.jurisdiction(F.col("code")).alias("jurisdiction")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "WITH v AS (SELECT doc_id, list_transform(regexp_extract_all(coalesce(text, ''), '(?i)(?:^|[^\\d.,])(\\d{1,3}(?:\\.\\d{1,6})?)\\s*(?:%|per\\s?cent\\b)', 1), lambda t: CAST(t AS DECIMAL(9,6))) AS v FROM documents), "
    "k AS (SELECT doc_id, list_transform(list_filter(v, lambda x: x > 0 AND x <= 100), lambda x: CAST(CAST(x AS DECIMAL(7,4)) AS VARCHAR)) AS k FROM v) "
    "SELECT doc_id, len(k) AS n, array_to_string(k, ';') AS found FROM k"
)
def text_percentages(spark, sf_dir):
    found = T.percentages(F.col("text"))
    return world.table(spark, sf_dir, "documents").select("doc_id", found.alias("k")).select("doc_id", F.size("k").cast("long").alias("n"), F.concat_ws(";", "k").alias("found"))


#: Shares as registries write them, around a number of each order.
_SHARES = (
    "CASE o_orderkey % 16 WHEN 0 THEN '{n}' WHEN 1 THEN '{n},5%' WHEN 2 THEN '25-{n}' WHEN 3 THEN '25 – {n} %' WHEN 4 THEN '<{n}' WHEN 5 THEN '≤ {n}' WHEN 6 THEN '>{n}' WHEN 7 THEN '≥{n}' "
    "WHEN 8 THEN '~{n}' WHEN 9 THEN 'majority' WHEN 10 THEN '5 {n}' WHEN 11 THEN '>={n}' WHEN 12 THEN '<5-{n}' WHEN 13 THEN '{n}.12345' WHEN 14 THEN '' END"
)


def _share_texts() -> str:
    return re.sub(r"'([^']*)\{n\}([^']*)'", r"'\1' || CAST(o_custkey % 104 AS {text}) || '\2'", _SHARES)


@query(
    f"WITH t AS (SELECT o_orderkey, {_share_texts().replace('{text}', 'VARCHAR')} AS t FROM orders), "
    "p AS (SELECT o_orderkey, t, regexp_extract(trim(replace(replace(t, '%', ''), ',', '.')), '^([<>≤≥~]?)\\s*(\\d+(?:\\.\\d+)?)(?:\\s*[-–]\\s*(\\d+(?:\\.\\d+)?))?$', ['sign', 'a', 'b']) AS x FROM t), "
    "n AS (SELECT o_orderkey, t, x.sign AS sign, x.b <> '' AS pair, TRY_CAST(x.a AS DECIMAL(9,4)) AS a, TRY_CAST(x.b AS DECIMAL(9,4)) AS b FROM p WHERE x.a <> '' AND (x.sign = '' OR x.b = '')), "
    "r AS (SELECT o_orderkey, CASE WHEN sign IN ('<', '≤') THEN 0 ELSE a END AS low, CASE WHEN pair THEN b WHEN sign IN ('>', '≥') THEN 100 ELSE a END AS high, CASE sign WHEN '<' THEN '()' WHEN '≤' THEN '(]' WHEN '>' THEN '(]' ELSE '[]' END AS bounds FROM n), "
    "g AS (SELECT * FROM r WHERE high > 0 AND high <= 100 AND (low < high OR low = high AND bounds = '[]')) "
    "SELECT t.o_orderkey, t.t AS written, CAST(CASE WHEN low = high THEN high END AS DOUBLE) AS pct, CAST(low AS DOUBLE) AS low, CAST(high AS DOUBLE) AS high, bounds FROM t LEFT JOIN g ON g.o_orderkey = t.o_orderkey"
)
def share_texts(spark, sf_dir):
    rows = world.table(spark, sf_dir, "orders").select("o_orderkey", F.expr(_share_texts().replace("{text}", "STRING")).alias("written"))
    rows = rows.withColumn("s", T.share_range(F.col("written")))
    return rows.select("o_orderkey", "written", *(F.col(f"s.{n}").cast("double").alias(n) for n in ("pct", "low", "high")), "s.bounds")


@query(f"WITH {_NODES} SELECT CASE WHEN label = 'Person' THEN 'p:' || left(sha256(node), 12) ELSE node END AS node, label, CASE WHEN label = 'Person' THEN '***' ELSE name END AS name, CASE WHEN label <> 'Person' THEN jurisdiction END AS jurisdiction FROM n")
def masked_nodes(spark, sf_dir):
    return changes.masked(world.nodes(spark, sf_dir))


@query("SELECT o_orderkey // 1000 AS bucket, count(*) AS n, sha256(string_agg(sha256(CAST(to_json([CAST(o_orderkey AS VARCHAR), CAST(o_custkey AS VARCHAR), o_orderstatus]) AS VARCHAR)), chr(10) ORDER BY o_orderkey)) AS digest FROM orders GROUP BY 1")
def digest_buckets(spark, sf_dir):
    o = world.table(spark, sf_dir, "orders")
    return changes.bucket_digests(o, F.col("o_orderkey"), changes.row_digest(F.col("o_orderkey"), F.col("o_custkey"), F.col("o_orderstatus")), F.expr("o_orderkey div 1000"))


@query("WITH h AS (SELECT event_id, user_id, sha256(CAST(event_id AS VARCHAR)) AS hash, CASE WHEN event_id % 97 = 0 THEN 'x' ELSE coalesce(sha256(CAST(lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS VARCHAR)), sha256('genesis')) END AS prev_hash FROM events) SELECT event_id, user_id FROM h WHERE prev_hash = 'x'")
def chain_faults(spark, sf_dir):
    each = Window.partitionBy("user_id").orderBy("event_id")
    e = world.table(spark, sf_dir, "events").select("event_id", "user_id", F.sha2(F.col("event_id").cast("string"), 256).alias("hash"))
    e = e.withColumn("prev_hash", F.when(F.col("event_id") % 97 == 0, "x").otherwise(F.coalesce(F.lag("hash").over(each), F.sha2(F.lit("genesis"), 256))))
    return changes.chain_faults(e, "user_id", "event_id", F.col("event_id").cast("string")).select("event_id", "user_id")


@query("SELECT CAST(floor(l_discount / 0.05 + 1e-9) AS BIGINT) AS bin, count(*) AS n FROM lineitem GROUP BY 1")
def score_histogram(spark, sf_dir):
    return changes.histogram(world.table(spark, sf_dir, "lineitem"), F.col("l_discount"), 0.05)


@query("SELECT l_returnflag, quantile_disc(l_quantity, 0.5) AS p50, quantile_disc(l_quantity, 0.95) AS p95, max(l_quantity) AS top FROM lineitem GROUP BY 1")
def percentiles(spark, sf_dir):
    return changes.nearest_rank(world.table(spark, sf_dir, "lineitem"), "l_returnflag", "l_quantity", (0.5, 0.95))


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def event_windows(spark, sf_dir):
    return windows.hourly(world.table(spark, sf_dir, "events"))


@query("SELECT o_orderstatus, count(*) FILTER (WHERE o_totalprice > 100000) AS large, count(*) FILTER (WHERE o_orderpriority IS NULL) AS missing, count(DISTINCT o_custkey) AS customers FROM orders GROUP BY 1")
def quality_counts(spark, sf_dir):
    return world.table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.count_if(F.col("o_totalprice") > 100000).alias("large"), F.count_if(F.col("o_orderpriority").isNull()).alias("missing"), F.countDistinct("o_custkey").alias("customers"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity < 2 THEN 'BAD_VALUE' WHEN place > 1 THEN 'DUPLICATE_KEY' END AS reason FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber, l_quantity >= 2 ORDER BY l_partkey, l_suppkey, l_extendedprice) AS place FROM lineitem) WHERE l_quantity < 2 OR place > 1")
def reject_reasons(spark, sf_dir):
    good = F.col("l_quantity") >= 2
    each = Window.partitionBy("l_orderkey", "l_linenumber", good).orderBy("l_partkey", "l_suppkey", "l_extendedprice")
    reason = F.when(~good, "BAD_VALUE").when(F.col("place") > 1, "DUPLICATE_KEY")
    return world.table(spark, sf_dir, "lineitem").withColumn("place", F.row_number().over(each)).select("l_orderkey", "l_linenumber", reason.alias("reason")).filter("reason IS NOT NULL")


@query()
def similar_names(spark, sf_dir):
    """Pairs of different part names that share a block, scored once a pair; no SQL has this ratio."""
    names = world.table(spark, sf_dir, "part").select(F.lower("p_name").alias("name")).distinct()
    b = names.select("name", F.explode(T.blocks(F.col("name"))).alias("block"))
    pairs = b.alias("x").join(b.alias("y"), "block").filter("x.name < y.name").select(F.col("x.name").alias("a"), F.col("y.name").alias("b")).distinct()
    return pairs.withColumn("score", F.round(T.similarity("a", "b"), 6)).filter("score >= 0.85")


@query(f"{_W} SELECT upper, lower, CAST(low4 AS BIGINT) AS low4, CAST(high4 AS BIGINT) AS high4 FROM edges WHERE lower IN {_CUST}")
def direct_owners(spark, sf_dir):
    return graph.direct_owners(world.edges(spark, sf_dir), _customers(spark, sf_dir)).select("upper", "lower", "low4", "high4")


def _paths_sql(depth: int) -> str:
    pairs = "SELECT DISTINCT 'S' || (s_suppkey // 4) AS a, 'S' || s_suppkey AS b FROM supplier UNION SELECT 'C' || (c_custkey // 4), 'C' || c_custkey FROM customer"
    parts = [
        _W,
        "e AS MATERIALIZED (SELECT DISTINCT upper, lower FROM edges)",
        f"p AS (SELECT a, b FROM ({pairs}) WHERE a <> b)",
        "p0 AS (SELECT a, b, b AS t, a AS node, [a] AS nodes FROM p UNION ALL SELECT a, b, a, b, [b] FROM p)",
    ]
    for i in range(1, depth + 1):
        parts.append(
            f"p{i} AS MATERIALIZED (SELECT a, b, t, lower AS node, list_append(nodes, lower) AS nodes FROM p{i - 1} JOIN e ON upper = node "
            "WHERE node <> t AND NOT list_contains(nodes, lower))"
        )
    every = " UNION ALL ".join(f"SELECT a, b, nodes, {i} AS hops FROM p{i} WHERE node = t" for i in range(1, depth + 1))
    ranked = f"SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY hops, nodes) AS place FROM ({every})"
    return ", ".join(parts) + f" SELECT a AS source, b AS target, array_to_string(nodes, '>') AS path, CAST(hops AS INTEGER) AS hops FROM ({ranked}) WHERE place <= 50"


@query(_paths_sql(4))
def paths_between(spark, sf_dir):
    """Chains between each supplier or customer and the one at a quarter of its number."""
    parts = [
        world.table(spark, sf_dir, table).select(F.concat(F.lit(letter), F.expr(f"{key} div 4")).alias("source"), F.concat(F.lit(letter), key).alias("target"))
        for table, key, letter in (("supplier", "s_suppkey", "S"), ("customer", "c_custkey", "C"))
    ]
    found = graph.paths_between(iterate.settle(world.edges(spark, sf_dir)), parts[0].unionByName(parts[1]), 4)
    return found.select("source", "target", F.concat_ws(">", "nodes").alias("path"), "hops")


@query(
    "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'lei:' || lpad(CAST(c_custkey AS VARCHAR), 20, '0') ELSE c_mktsegment || ':' || c_custkey END AS entity_id FROM customer"
)
def entity_ids(spark, sf_dir):
    lei = F.when(F.col("c_custkey") % 3 == 0, F.lpad(F.col("c_custkey").cast("string"), 20, "0")).when(F.col("c_custkey") % 3 == 1, "")
    id_ = V.entity_id(lei, F.col("c_mktsegment"), F.col("c_custkey").cast("string"))
    return world.table(spark, sf_dir, "customer").select("c_custkey", id_.alias("entity_id"))


_DATES = (
    "CASE o_orderkey % 5 WHEN 0 THEN left(CAST(CAST(o_orderdate AS DATE) AS {text}), 4) WHEN 1 THEN left(CAST(CAST(o_orderdate AS DATE) AS {text}), 7) "
    "WHEN 2 THEN CAST(CAST(o_orderdate AS DATE) AS {text}) WHEN 3 THEN '1996-13-41' END"
)


@query(f"WITH d AS (SELECT o_orderkey, {_DATES.format(text='VARCHAR')} AS t FROM orders) SELECT o_orderkey, CAST(TRY_CAST(t AS DATE) AS VARCHAR) AS listed, t IS NULL OR t > '1996-06-01' AS active FROM d")
def designation_dates(spark, sf_dir):
    rows = world.table(spark, sf_dir, "orders").select("o_orderkey", F.expr(_DATES.format(text="STRING")).alias("t"))
    return rows.select("o_orderkey", V.full_date(F.col("t")).cast("string").alias("listed"), V.in_force(F.col("t"), "1996-06-01").alias("active"))


@query(
    f"{_W}, c AS (SELECT *, low4 % 20000 = 0 AS lc, high4 % 30000 = 0 AS hc FROM edges WHERE low4 IS NOT NULL) SELECT upper, lower, "
    "low4 > 500000 OR (low4 = 500000 AND NOT lc) AS every_above, low4 >= 500000 AS every_least, "
    "high4 > 500000 AS some_above, high4 > 500000 OR (high4 = 500000 AND hc) AS some_least FROM c"
)
def stake_tests(spark, sf_dir):
    e = world.edges(spark, sf_dir).filter("low4 IS NOT NULL")
    low, high = F.col("low4"), F.col("high4")
    low_closed, high_closed = low % 20000 == 0, high % 30000 == 0
    return e.select(
        "upper", "lower",
        V.every_meets(low, low_closed, ">", rules.HALF).alias("every_above"), V.every_meets(low, low_closed, ">=", rules.HALF).alias("every_least"),
        V.some_meets(high, high_closed, ">", rules.HALF).alias("some_above"), V.some_meets(high, high_closed, ">=", rules.HALF).alias("some_least"),
    )


@query("SELECT p_partkey, lower(p_name) AS query FROM part")
def normalised_queries(spark, sf_dir):
    typed = F.concat(F.lit("  "), F.replace(F.upper("p_name"), F.lit(" "), F.lit(" \t ")))
    return world.table(spark, sf_dir, "part").select("p_partkey", N.normalised_query(typed).alias("query"))
