import datetime as dt
import random

import pytest

from ledgerloom.operators.asof import join_asof


def brute(left, right, direction, exact=True, tolerance=None):
    out = []
    for i, k, t in left:
        fits = [(t2, j) for j, k2, t2 in right if k is not None and k == k2 and t is not None and t2 is not None and (exact or t != t2) and (tolerance is None or abs(t - t2) <= tolerance)]
        before, after = [f for f in fits if f[0] <= t], [f for f in fits if f[0] >= t]
        best = [(t - t2, 0, j) for t2, j in before] * (direction != "forward") + [(t2 - t, 1, j) for t2, j in after] * (direction != "backward")
        out.append((i, min(best)[2] if best else None))
    return sorted(out)


def rows(rng, n, keys, span):
    return [(i, rng.choice(keys), None if rng.random() < 0.05 else rng.randrange(span)) for i in range(n)]


@pytest.mark.parametrize("direction", ["backward", "forward", "nearest"])
@pytest.mark.parametrize("exact,tolerance,buckets", [(True, None, 8), (False, None, 3), (True, 4, 1), (False, 2, 20)])
def test_against_brute_force(spark, direction, exact, tolerance, buckets):
    rng = random.Random(f"{direction}{exact}{tolerance}{buckets}")
    # one key has most rows, one is on one side only, positions repeat
    left, right = rows(rng, 150, ["hot"] * 6 + ["a", "b", None, "l"], 120), rows(rng, 120, ["hot"] * 6 + ["a", "b", None, "r"], 120)
    l = spark.createDataFrame(left, "id long, k string, t long")  # noqa: E741
    r = spark.createDataFrame(right, "rid long, k string, t long")
    found = join_asof(l, r, "t", "t", ["k"], direction, tolerance, exact, ["rid"], buckets=buckets)
    assert found.columns == ["id", "k", "t", "rid", "k_right", "t_right"]
    assert sorted((x.id, x.rid) for x in found.collect()) == brute(left, right, direction, exact, tolerance)


def test_no_window_spans_a_whole_key(spark):
    l = spark.range(1000).selectExpr("id", "1 AS k", "id AS t")  # noqa: E741
    found = join_asof(l, l.selectExpr("id AS rid", "k", "t * 2 AS t"), "t", "t", ["k"], buckets=8)
    assert found.where("rid = t DIV 2").count() == 1000
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert windows and all("_bucket" in w for w in windows)


def test_dates_timestamps_and_mixed_numbers(spark):
    day = lambda n: dt.date(2024, 1, 1) + dt.timedelta(n)
    l = spark.createDataFrame([(1, day(5)), (2, day(0)), (3, None)], "id int, d date")  # noqa: E741
    r = spark.createDataFrame([(7, day(1)), (8, day(9))], "rid int, d date")
    assert {x.id: x.rid for x in join_asof(l, r, "d", "d").collect()} == {1: 7, 2: None, 3: None}
    assert {x.id: x.rid for x in join_asof(l, r, "d", "d", direction="nearest", tolerance=1).collect()} == {1: None, 2: 7, 3: None}
    for kind in ("timestamp", "timestamp_ntz"):
        a, b = (x.withColumn("d", x.d.cast(kind)) for x in (l, r))
        assert {x.id: x.rid for x in join_asof(a, b, "d", "d", direction="forward", how="inner").collect()} == {1: 8, 2: 7}
    n = spark.createDataFrame([(1, 2.5), (2, float("nan")), (3, float("inf"))], "id int, x double")
    m = spark.createDataFrame([(7, 2), (8, 3)], "rid int, y int")
    assert {x.id: x.rid for x in join_asof(n, m, "x", "y").collect()} == {1: 7, 2: None, 3: None}
    with pytest.raises(ValueError):
        join_asof(l, m, "d", "y")
    with pytest.raises(ValueError):
        join_asof(l, r, "d", "d", direction="sideways")


def test_empty_sides_and_odd_columns(spark):
    l = spark.createDataFrame([(1, 1, {"a": 1})], "id int, t int, _at map<string,int>")  # noqa: E741
    r = spark.createDataFrame([(7, 1, {"b": 2}), (6, 1, {"b": 3})], "_row int, t int, m map<string,int>")
    assert [(x.id, x._row, x.m) for x in join_asof(l, r, "t", "t").collect()] == [(1, 6, {"b": 3})]
    assert [(x.id, x._row) for x in join_asof(l, r.limit(0), "t", "t").collect()] == [(1, None)]
    assert join_asof(l.limit(0), r, "t", "t").count() == 0


def test_nearest_in_groups_is_the_nearest_as_of_join(spark):
    from ledgerloom.operators.asof import nearest_in_groups

    one = spark.range(300).selectExpr("CAST(id AS string) AS record_key", "CAST((id * 37) % 101 AS double) AS value", "IF(id % 19 = 0, NULL, id % 7) AS k")
    two = spark.range(200).selectExpr("CAST(id AS string) AS record_key", "IF(id % 17 = 0, double('NaN'), CAST((id * 53) % 89 AS double)) AS value", "id % 6 AS k")
    slow = join_asof(one, two, "value", "value", ["k"], "nearest", ties=["record_key"], how="inner").selectExpr("record_key", "record_key_right")
    fast = nearest_in_groups(one, two, ["k"]).selectExpr("record_key", "best.record_key")
    assert sorted(map(tuple, fast.collect())) == sorted(map(tuple, slow.collect()))
