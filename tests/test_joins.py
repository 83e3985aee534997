import math
from datetime import date
from functools import reduce

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators import joins, metrics
from ledgerloom.plans import rules
from ledgerloom.sources.ranges import KeyRanges


@pytest.fixture(scope="module")
def left(spark):
    return spark.createDataFrame([(1, "a", 100.0), (2, "b", 200.0), (3, "c", 300.0), (None, "n", None)], "id int, name string, amount double")


@pytest.fixture(scope="module")
def right(spark):
    return spark.createDataFrame([(1, 100.005), (2, 200.02), (4, 1.0), (None, 5.0)], "ref_id int, paid double")


def test_join_and_orphans(left, right):
    assert joins.execute_join(left, right, "l.id = r.ref_id").count() == 2
    assert joins.execute_join(left, right, F.col("l.id") == F.col("r.ref_id")).count() == 2
    assert sorted(r["name"] for r in joins.left_orphans(left, right, "id", "ref_id").collect()) == ["c", "n"]
    assert joins.right_orphans(left, right, "id", "ref_id").count() == 2
    assert joins.left_orphans(left.limit(0), right, "id", "ref_id").count() == 0
    assert len(list(joins.batches(joins.left_orphans(left, right, ["id", "amount"], ["ref_id", "paid"])))) == 4


def test_join_keeps_equal_names(left):
    assert joins.execute_join(left, left, "l.id = r.id").columns == ["id", "name", "amount"] * 2


def test_unmatched_by_full_condition(left, right):
    assert sorted(r["name"] for r in joins.unmatched(left, right, "l.id = r.ref_id AND abs(l.amount - r.paid) <= 0.01").collect()) == ["b", "c", "n"]


def test_parts_of_a_join_are_the_join(spark):
    l = spark.createDataFrame([*((i, i % 3) for i in range(-5, 30)), (None, None)], "id int, x int")  # noqa: E741
    r = spark.createDataFrame([(i % 3, i) for i in range(6)], "y int, z int")
    ranges = KeyRanges.even("id", 0, 20, 4)
    parts = [joins.range_join(l, r, "l.x = r.y OR l.id IS NULL", ranges, i, "id") for i in range(len(ranges))]
    assert sorted(map(str, reduce(DataFrame.unionAll, parts).collect())) == sorted(map(str, joins.execute_join(l, r, "l.x = r.y OR l.id IS NULL").collect()))


@pytest.mark.parametrize("t", [0.0, 0.01, 1.0, 250.0, -1.0, math.nan])
def test_tolerance_join(spark, t):
    xs = [0.0, -0.0, 0.5, 1.0, 1.01, -249.5, 250.0, 499.99, 1e9, math.nan, math.inf, -math.inf, None]
    l = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, a double")  # noqa: E741
    r = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "j int, b double")
    got = sorted((x.i, x.j) for x in joins.tolerance_join(l, r, "a", "b", t).collect())
    ok = [i for i, x in enumerate(xs) if x is not None and math.isfinite(x)]
    assert got == [(i, j) for i in ok for j in ok if abs(xs[i] - xs[j]) <= t]


def test_tolerance_join_has_an_equality(spark):
    df = spark.range(5).withColumn("v", F.col("id").cast("double"))
    plan = joins.tolerance_join(df, df.toDF("k", "w"), "v", "w", 1.0)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    with pytest.raises(ValueError):
        joins.tolerance_join(df, df.toDF("k", "w"), "v", "w", math.inf)


@pytest.mark.parametrize("before,after", [(0, 0), (7, 7), (0, 30), (-2, 5)])
def test_window_join(spark, before, after):
    days = [date(2024, 1, d) for d in (1, 2, 8, 15, 31)] + [date(1969, 12, 30), None]
    l = spark.createDataFrame(list(enumerate(days)), "i int, a date")  # noqa: E741
    r = spark.createDataFrame(list(enumerate(days)), "j int, b date")
    got = sorted((x.i, x.j) for x in joins.window_join(l, r, "a", "b", before, after).collect())
    assert got == [(i, j) for i, x in enumerate(days) for j, y in enumerate(days) if x and y and -before <= (y - x).days <= after]


def test_best_candidate(spark):
    df = spark.createDataFrame([(1, 5, 2.0), (1, 4, 2.0), (1, 3, None), (2, 9, None)], "k int, c int, d double")
    assert sorted((r.k, r.c) for r in joins.best_candidate(df, ["k"], F.col("d"), ["c"]).collect()) == [(1, 4), (2, 9)]


def test_counts(spark, left, right):
    pairs = spark.createDataFrame([(1, 1), (1, 2), (1, 2)], "a int, b int")
    assert tuple(metrics.match_counts(pairs, left, right, F.col("a"), F.col("b")).first()) == (3, 4, 4, 3, 2)
    assert tuple(metrics.match_counts(pairs, left.limit(0), right, F.col("a"), F.col("b")).first()) == (3, 0, 4, 0, 2)
    assert tuple(metrics.match_counts(pairs.limit(0), left, right, F.col("a"), F.col("b")).first()) == (0, 4, 4, 4, 4)


def test_bands(spark):
    df = spark.createDataFrame([(90, 100), (70, 100), (69, 100), (0, 0)], "m long, n long")
    rate = metrics.match_rate(F.col("m"), F.col("n"))
    assert [(r[0], r[1]) for r in df.select(rate, metrics.match_band(rate)).collect()] == [(90.0, "Excellent"), (70.0, "Fair"), (69.0, "Needs Review"), (0.0, "Needs Review")]
    found = df.select(metrics.issues(rate, F.col("n") - F.col("m"), F.col("n"), F.lit(0), F.lit(0))).collect()
    assert [len(r[0]) for r in found] == [0, 2, 2, 1]


@pytest.mark.parametrize("t", [0.01, 1e-300, 3.0, 1e17])
def test_tolerance_join_of_large_values(spark, t):
    xs = [1e18, 1e18 + 128, -1e18, 2.0**53 * 0.02, 2.0**53 * 0.02 + 0.01, 2.0**53 * 0.02 - 0.005, 9e15, 9e15 + 1, 1e300, 1.7e308, 0.0, 5e-324]
    l = spark.createDataFrame(list(enumerate(xs)), "i int, a double")  # noqa: E741
    r = spark.createDataFrame(list(enumerate(xs)), "j int, b double")
    assert sorted((x.i, x.j) for x in joins.tolerance_join(l, r, "a", "b", t).collect()) == [(i, j) for i, x in enumerate(xs) for j, y in enumerate(xs) if abs(x - y) <= t]


def test_helper_columns_leave_others_alone(spark):
    l = spark.createDataFrame([(1, 5.0, date(2024, 1, 1), "x")], "i int, a double, d date, _BUCKET string")  # noqa: E741
    r = spark.createDataFrame([(2, 5.5, date(2024, 1, 2), "y")], "j int, b double, e date, _bucket_ string")
    assert joins.tolerance_join(l, r, "a", "b", 1.0).first().asDict() | {"a": 0} == joins.window_join(l, r, "d", "e", 0, 3).first().asDict() | {"a": 0}
    assert joins.best_candidate(l.withColumnRenamed("i", "_Rank"), ["_Rank"], F.col("a"), []).columns == ["_Rank", "a", "d", "_BUCKET"]


def test_unmatched_without_an_equality(spark):
    l = spark.createDataFrame([(1, 1.0), (1, 1.0), (2, 50.0), (3, None)], "i int, a double")  # noqa: E741
    r = spark.createDataFrame([(1, 1.5)], "j int, b double")
    rule = rules.Rule("near", (rules.Condition("a", "tolerance", "b", 1.0),))
    rest = rules.unmatched_rule(l, r, rule)
    assert sorted(x.i for x in rest.collect()) == [2, 3]
    plan = rest._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    found = rules.match_rules(l, r, [rules.Rule("low", (rules.Condition("i", "eq", "j"),)), rules.Rule("high", rule.conditions, priority=2)], "i")
    assert [(n, df.count()) for n, df in found] == [("high", 2), ("low", 0)]
