import math

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import field_name, js_number, key_of, relative_match, signed_relative_match, tolerance_match
from ledgerloom.session import job_session

CASES = [
    (100.0, 100.005, 0.01, True), (100.0, 100.01, 0.01, False), (99.99, 100.0, 0.01, False), (-1.0, 1.0, 2.0, True), (1.0, 1.0, 0.0, True),
    (float("nan"), 1.0, 1.0, False), (math.inf, math.inf, 1.0, False), (1.0, 1.0, float("nan"), False), (1.0, 1.0, -1.0, False),
    (None, 1.0, 1.0, None), (1.0, None, 1.0, None), (1.0, 1.0, None, None), (None, 1.0, float("nan"), None),
]


def test_tolerance_match_as_column_and_in_sql(spark):
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(CASES)], "i int, a double, b double, t double, want boolean")
    rows = df.select("want", tolerance_match("a", "b", F.col("t")).alias("got")).collect()
    assert [r.got for r in rows] == [c[3] for c in CASES]
    own = job_session(spark)
    for a, b, t, want in CASES:
        text = lambda x: "CAST(NULL AS DOUBLE)" if x is None else f"double('{x}')"
        assert own.sql(f"SELECT tolerance_match({text(a)}, {text(b)}, {text(t)})").first()[0] is want


def test_sql_function_is_inlined(spark):
    own = job_session(spark)
    own.range(3).createOrReplaceTempView("n")
    plan = own.sql("SELECT * FROM n WHERE tolerance_match(id, 1, 1)")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "abs(" in plan


def test_relative_matches(spark):
    df = spark.createDataFrame([(100.0, 101.0), (-100.0, 150.0), (0.0, 1.0)], "a double, b double")
    assert [tuple(r) for r in df.select(relative_match("a", "b", 0.02), signed_relative_match("a", "b", 0.02)).collect()] == [(True, True), (False, True), (None, None)]


def test_session_is_isolated_and_reads_quoted_identifiers(spark):
    own = job_session(spark)
    own.range(1).createOrReplaceTempView("only_here")
    assert own.sql('SELECT "id" FROM only_here').first()[0] == 0
    assert not spark.catalog.tableExists("only_here")
    assert own.conf.get("spark.sql.shuffle.partitions") == spark.conf.get("spark.sql.shuffle.partitions")


def test_sql_aliases(spark):
    row = job_session(spark).sql("SELECT strpos('abc', 'c'), starts_with('abc', 'ab'), sha256('x'), array_has(array('a'), 'a')").first()
    assert (row[0], row[1], row[3]) == (3, True, True) and len(row[2]) == 64


def test_keys_and_names(spark):
    df = spark.createDataFrame([(1, "a", " Invoice-No  "), (2, None, "x y")], "i long, s string, n string")
    rows = df.select(key_of(["i"]), key_of(["i", "s"]), field_name(F.col("n"))).collect()
    assert [tuple(r) for r in rows] == [("1", "1\x1fa", "invoice_no"), ("2", None, "x_y")]


@pytest.mark.parametrize("text,want", [("2024-01-15", 2024.0), (" 12.5abc", 12.5), ("-3e2x", -300.0), (".5", 0.5), ("5.", 5.0), ("x1", None), ("", None), (None, None), ("Infinity", math.inf)])
def test_leading_number(spark, text, want):
    assert spark.createDataFrame([(text,)], "s string").select(js_number("s")).first()[0] == want
