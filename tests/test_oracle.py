"""Every query of the ownership world against its SQL in DuckDB, and properties of the rules."""

import glob
import os

import duckdb
import pytest

from holdfast.functions import names as name_forms
from holdfast.functions import text, values
from holdfast.operators import changes, graph, iterate, rules
from holdfast.plans import queries

SF = "/root/testdata/sf0.001"


def rows(df, columns):
    def plain(v):
        if v is None or str(v) in ("<NA>", "nan", "NaT", "None"):
            return "~"
        return str(float(v)) if hasattr(v, "__float__") and not isinstance(v, bool) and str(v) not in ("True", "False") else str(v)

    return sorted(tuple(plain(v) for v in r) for r in df[columns].itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return con


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_matches_sql(spark, duck, name):
    found, expected = queries.QUERIES[name](spark, SF).toPandas(), duck.execute(queries.SQL[name]).df()
    assert sorted(found.columns) == sorted(expected.columns)
    columns = sorted(found.columns)
    assert rows(found, columns) == rows(expected, columns)


def world(spark, edges):
    return spark.createDataFrame(edges, "upper string, lower string, low4 long, high4 long")


def test_blocked_is_least_fixed_point(spark):
    e = world(spark, [("a", "b", 500000, 500000), ("b", "c", 300000, 300000), ("a", "c", 200000, 200000), ("c", "d", 499999, 499999), ("x", "y", 900000, 900000), ("d", "b", 600000, 600000)])
    found = {r.node: r["round"] for r in rules.blocked(e, spark.createDataFrame([("a",)], "node string")).collect()}
    assert found == {"a": 0, "b": 1, "c": 2}


def test_unknown_share_presumes_before_sums(spark):
    e = world(spark, [("a", "b", None, None), ("a", "c", 400000, 600000), ("b", "d", 500000, 500000)])
    start = spark.createDataFrame([("a",)], "node string")
    found = {r.node: (r["round"], r.basis) for r in rules.possibly_blocked(e, rules.blocked(e, start)).collect()}
    assert found == {"b": (1, "PRESUMED_MAJORITY"), "c": (1, "RANGE"), "d": (2, "AGGREGATE")}


def test_exposure_of_a_chain_is_the_exact_product(spark):
    e = world(spark, [("a", "b", 400000, 400000), ("b", "c", 250000, 250000), ("c", "a", 100000, 100000)])
    sure = spark.createDataFrame([("a",)], "node string")
    assert {r.node: r.total4 for r in rules.exposure(e, sure).collect()} == {"b": 400000, "c": 100000}


def test_walk_survives_cycles(spark):
    e = iterate.settle(world(spark, [("a", "b", 1, 1), ("b", "a", 1, 1), ("b", "c", 1, 1)]))
    found = graph.affected(e, spark.createDataFrame([("a",)], "node string"), 5).collect()
    assert {(r.node, r.hops) for r in found} == {("a", 0), ("b", 1), ("c", 2)}


def test_share_ranges(spark):
    from pyspark.sql import functions as F

    none = (None, None, None, None)
    cases = {
        "50": (50, 50, 50, "[]"), "12,5": (12.5, 12.5, 12.5, "[]"), "50%": (50, 50, 50, "[]"), "~ 7": (7, 7, 7, "[]"), "25-50": (None, 25, 50, "[]"), "25–50": (None, 25, 50, "[]"),
        "<10": (None, 0, 10, "()"), "≤10": (None, 0, 10, "(]"), ">50": (None, 50, 100, "(]"), "≥50": (None, 50, 100, "[]"), "≥100": (100, 100, 100, "[]"),
        ">100": none, "0": none, "60-40": none, "abc": none, "101": none, "5 0": none, ">=50": none, "<5-10": none, "": none, "123456789": none,
    }
    rows = spark.createDataFrame([(k,) for k in [*cases, None]], "t string").select("t", text.share_range(F.col("t")).alias("s")).collect()
    found = {r.t: tuple(None if v is None else v if isinstance(v, str) else float(v) for v in r.s) for r in rows}
    assert found == {**cases, None: none}


def test_percentages_in_texts(spark):
    from pyspark.sql import functions as F

    cases = {"holds 51% and 5.5 per cent": ["51.0000", "5.5000"], "12 Percent, 0%, 101%, 1234%": ["12.0000"], "1,5% 1.2.3%": [], "5%6%": ["5.0000", "6.0000"], "7 percentage": [], None: []}
    found = {r.t: r.p for r in spark.createDataFrame([(k,) for k in cases], "t string").select("t", text.percentages(F.col("t")).alias("p")).collect()}
    assert found == cases


def test_chain_faults_sees_null_links_and_changed_content(spark):
    from hashlib import sha256

    from pyspark.sql import functions as F

    def h(s):
        return sha256(s.encode()).hexdigest()

    log = [(1, 1, "a", h("a"), h("genesis")), (1, 2, "b", h("b"), None), (1, 3, "x", h("c"), h("b")), (1, 4, "d", h("d"), h("c")), (2, 1, "a", None, h("genesis")), (2, 2, "b", h("b"), h("z"))]
    events = spark.createDataFrame(log, "g int, k int, body string, hash string, prev_hash string")
    assert {(r.g, r.k) for r in changes.chain_faults(events, "g", "k", F.col("body")).collect()} == {(1, 2), (1, 3), (2, 1), (2, 2)}


def test_row_digest_and_edge_ids_keep_values_apart(spark):
    from hashlib import sha256

    from pyspark.sql import functions as F

    rows = spark.createDataFrame([("a|b", "c"), ("a", "b|c"), ("", None), (None, ""), ('"', "\\")], "upper string, lower string")
    assert rows.select(changes.row_digest(F.col("upper"), F.col("lower")).alias("d")).distinct().count() == 5
    found = {(r.upper, r.lower): r.edge_id for r in graph.edge_ids(rows).collect()}
    assert found['"', "\\"] == sha256(b'["\\"","\\\\","OWNS",false]').hexdigest()[:16]


def test_siblings_of_a_hub(spark):
    e = world(spark, [("h", f"n{i:03}", 1, 1) for i in range(200)] + [("p", "n000", 1, 1), ("p", "n199", 1, 1), ("q", "n000", 1, 1)])
    found = [(r.node, r.upper, r.sibling, r.peers) for r in graph.siblings(e, e.select(e.lower.alias("node")), 3).collect()]
    names = [f"n{i:03}" for i in range(200)]
    expected = [(n, "h", s, 199) for n in names for s in [m for m in names if m != n][:3]] + [("n000", "p", "n199", 1), ("n199", "p", "n000", 1)]
    assert sorted(found) == sorted(expected)


def test_names():
    assert text.sorted_words_ratio("b a", "a b") == 1.0
    assert round(text.sorted_words_ratio("king kong", "hong kong"), 2) == 0.78
    assert text.fold("Ｓociété") == "societe"


def test_similar_names_match_a_plain_scan(spark):
    from itertools import combinations

    names = {r.p_name.lower() for r in spark.read.parquet(f"{SF}/part.parquet").select("p_name").collect()}
    blocks = {n: {w[:4] for w in n.split()} for n in names}
    expected = {tuple(sorted(p)) for p in combinations(names, 2) if blocks[p[0]] & blocks[p[1]] and round(text.sorted_words_ratio(*p), 6) >= 0.85}
    assert {(r.a, r.b) for r in queries.similar_names(spark, SF).collect()} == expected


def test_comparable_names():
    assert name_forms.normal_name("Müller & Söhne GmbH") == "muller sohne"
    assert name_forms.normal_name("Acme S.A.") == "acme"
    assert name_forms.normal_name("Alpha Private Limited Company") == "alpha"
    assert name_forms.normal_name("Limited") == "limited"
    assert name_forms.normal_name("Gesellschaft mit beschränkter Haftung Nord") == "nord"
    assert name_forms.name_with_form("Siemens Aktiengesellschaft") == "siemens ag"


def test_comparable_addresses():
    assert name_forms.normal_address("P.O. Box 12, The High Street") == "pobox 12 high st"
    assert name_forms.normal_address("Post  Office Box 12") == "pobox 12"
    assert name_forms.normal_address("Hauptstraße_5, Nr. 3") == "hauptstrasse 5 no 3"
    assert name_forms.normal_address("1 Rd") is None and name_forms.normal_address(None) is None


def test_name_columns(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([("Siemens AG", "SIEMENS Limited"), (None, "x"), ("", "")], "a string, b string")
    found = rows.select(name_forms.name_similarity("a", "b").alias("s"), name_forms.form_similarity("a", "b").alias("f"), name_forms.normalised_address("a").alias("d")).collect()
    assert [r.s for r in found] == [1.0, None, 1.0] and found[0].f < 1 and [r.d for r in found] == ["siemens ag", None, None]
    dates = spark.createDataFrame([(t,) for t in ("2023", "2023-02", "2023-02-30", " 2023-02-03 ", "x", None)], "t string")
    assert [str(r[0]) for r in dates.select(values.full_date(F.col("t"))).collect()] == ["None", "None", "None", "2023-02-03", "None", "None"]


def test_paths_between_both_ways_and_around_cycles(spark):
    e = world(spark, [("a", "b", 1, 1), ("b", "c", 1, 1), ("a", "c", 1, 1), ("c", "a", 1, 1), ("c", "d", 1, 1), ("a", "a", 1, 1)])
    found = graph.paths_between(e, spark.createDataFrame([("a", "c"), ("d", "b"), ("a", "a"), ("a", "zz")], "source string, target string"), 3).collect()
    assert {(r.source, r.target, ">".join(r.nodes), r.hops) for r in found} == {("a", "c", "a>c", 1), ("a", "c", "c>a", 1), ("a", "c", "a>b>c", 2), ("d", "b", "b>c>d", 2)}
    with pytest.raises(ValueError):
        graph.paths_between(e, e.selectExpr("upper AS source", "lower AS target"), 11)
