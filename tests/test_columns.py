"""Shared values by sketches and keys of several columns, against plain counting."""

import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from ledgerloom.plans import columns


def plain_keys(rows, names, most):
    found = []
    for n in range(1, most + 1):
        for s in combinations(range(len(names)), n):
            seen = [tuple(r[i] for i in s) for r in rows]
            if len(set(seen)) == len(rows) and all(x is not None for v in seen for x in v) and not any(set(k) <= set(s) for k in found):
                found.append(s)
    return sorted(tuple(names[i] for i in s) for s in found)


def keys(df, *args, **named):
    return sorted(tuple(r.key) for r in columns.find_keys(df, *args, **named).collect())


@pytest.mark.parametrize("seed", range(2))
def test_keys_as_by_plain_counting(spark, seed):
    rng = random.Random(seed)
    rows = [(i // 40, i % 40, rng.randrange(1300), rng.randrange(60), None if i == 7 else i) for i in range(1200)]
    names = ["a", "b", "c", "d e", "holed"]
    df = spark.createDataFrame(rows, "a int, b int, c int, `d e` int, holed int").repartition(3)
    assert keys(df) == plain_keys(rows, names, 3)
    assert ("a", "b") in keys(df) and not any("holed" in k for k in keys(df))


def test_keys_of_repeated_rows_hot_values_and_no_rows(spark):
    rows = [(i, 1, i % 7) for i in range(3000)]
    df = spark.createDataFrame([*rows, rows[0]], "id int, hot int, k int")
    assert keys(df) == []
    assert keys(spark.createDataFrame(rows, "id int, hot int, k int")) == [("id",)]
    assert keys(df.limit(0)) == []
    assert keys(df.select("hot"), most=1) == []
    # one pair of rows repeats all but the last column, and a value holds a third of the rows
    hot = [(i % 3 and i, i, 0) for i in range(3000)] + [(1, 1, 1)]
    assert keys(spark.createDataFrame(hot, "a int, b int, c int")) == [("b", "c")]


def test_keys_of_odd_types(spark):
    df = spark.range(50).select(F.map_from_arrays(F.array("id"), F.array("id")).alias("m"), (F.col("id") / 3).alias("f"), F.array("id").alias("xs"), F.lit("x").alias("n"), F.lit("y").alias("N.n"))
    assert keys(df) == [("f",), ("xs",)]
    nan = spark.createDataFrame([(float("nan"), 1), (float("nan"), 2)], "f double, n int")
    assert keys(nan) == [("n",)]


def overlap(left, right):
    return columns.shared_values(left, right, [(0, 0)]).first().overlap


@pytest.mark.parametrize("n,m,both", [(100, 100, 40), (30_000, 30_000, 9_000), (50_000, 9_000, 9_000), (9_000, 60_000, 3_000), (40_000, 40_000, 0)])
def test_overlap_is_near(spark, n, m, both):
    left, right = spark.range(n).repartition(5), spark.range(n - both, n - both + m)
    assert overlap(left, right) == pytest.approx(both / n, abs=0 if max(n, m) <= 4096 else 0.03)


def test_few_values_beside_many_are_counted(spark):
    left = spark.createDataFrame([(x,) for x in (5, 6, 7, -1, None, 7)], "id long")
    assert overlap(left, spark.range(200_000)) == 0.75  # of 4 distinct ones
    assert overlap(left.select(F.lit(-2)), spark.range(200_000)) == 0
    # several columns at once, some told by sketches
    both = left.select("id", F.lit("y").alias("other"))
    many = spark.range(100_000).select("id", F.lit("y").alias("z"))
    got = {(r.i, r.j): r.overlap for r in columns.shared_values(both, many, [(0, 0), (0, 1), (1, 0), (1, 1)]).collect()}
    assert got == {(0, 0): 0.75, (0, 1): 0, (1, 0): 0, (1, 1): 1}


def test_mapping_reads_all_rows(spark):
    """What the columns share stands after the first rows, and columns may be empty or have any name."""
    left = spark.range(20_000).select(F.when(F.col("id") >= 15_000, F.concat(F.lit("v"), "id")).otherwise(F.concat(F.lit("l"), F.col("id") % 5)).alias("ref no"), F.lit("").alias("void"), F.col("id").alias("a.b"))
    right = spark.range(15_000, 40_000).select(F.concat(F.lit("v"), "id").alias("ref_nr"), F.lit(None).cast("string").alias("void2"), F.col("id").alias("a-b"))
    got = {(r.left_col, r.right_col): r.score for r in columns.field_mapping(left, right).collect()}
    assert set(got) == {("ref no", "ref_nr"), ("void", "void2"), ("a.b", "a-b")}
    assert got["ref no", "ref_nr"] == pytest.approx(0.4 * 5 / 6 + 0.2 + 0.4 * 5000 / 5005, abs=0.02)
    assert columns.field_mapping(left.limit(0), right.limit(0), 0.9).count() == 0
    assert columns.field_mapping(left, right, 1.0).count() == 0


def test_sketches_are_merged_in_two_steps(spark):
    plan = columns._value_sketches(spark.range(10).repartition(4))._jdf.queryExecution().toString()
    assert "fold" in plan and "Sort [" not in plan
