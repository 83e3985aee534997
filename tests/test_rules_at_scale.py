import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators.assign import enforce, nearest_one_to_one
from ledgerloom.operators.joins import order_join, unmatched_of, without_order
from ledgerloom.plans import rules
from ledgerloom.queries import QUERIES

OPS = {"gt": lambda a, b: a > b, "gte": lambda a, b: a >= b, "lt": lambda a, b: a < b, "lte": lambda a, b: a <= b}


def sides(spark, seed=1):
    rng = random.Random(seed)
    value = lambda: None if rng.random() < 0.1 else rng.choice([float("inf"), float("-inf")]) if rng.random() < 0.05 else float(rng.randrange(30))
    l, r = [(i, i % 3, value()) for i in range(60)], [(i, i % 4, value()) for i in range(50)]  # noqa: E741
    return l, r, spark.createDataFrame(l, "id int, k int, x double"), spark.createDataFrame(r, "rid int, g int, y double")


def nested(df) -> bool:
    plan = df._jdf.queryExecution().executedPlan().toString()
    return "NestedLoop" in plan or "Cartesian" in plan


@pytest.mark.parametrize("op", OPS)
@pytest.mark.parametrize("blocks", [1, 5])
def test_order_join(spark, op, blocks):
    l, r, left, right = sides(spark)
    want = sorted((a[0], b[0]) for a in l for b in r if a[2] is not None and b[2] is not None and OPS[op](a[2], b[2]))
    found = order_join(left, right, "x", "y", op, blocks=blocks)
    assert sorted((x.id, x.rid) for x in found.collect()) == want and found.columns == ["id", "k", "x", "rid", "g", "y"]
    assert blocks == 1 or not nested(found)


@pytest.mark.parametrize("op", OPS)
@pytest.mark.parametrize("keys", [[], [("k", "g")]])
def test_rows_without_order(spark, op, keys):
    l, r, left, right = sides(spark, 2)
    r = [b for b in r if b[1] != 1 and (b[2] is None or 3 < b[2] < 25)]
    right = right.where("g <> 1 AND (y IS NULL OR y BETWEEN 4 AND 24)")
    want = sorted(a[0] for a in l if not any((not keys or a[1] == b[1]) and a[2] is not None and b[2] is not None and OPS[op](a[2], b[2]) for b in r))
    assert sorted(x.id for x in without_order(left, right, "x", "y", op, keys).collect()) == want
    rule = rules.Rule("r", (rules.Condition("x", op, "y"), *(rules.Condition(a, "eq", b) for a, b in keys)))
    assert sorted(x.id for x in rules.unmatched_rule(left, right, rule).collect()) == want
    assert without_order(left, right.limit(0), "x", "y", op, keys).count() == len(l)


def test_order_rules_have_no_nested_loop(spark):
    _, _, left, right = sides(spark)
    matched = rules.match_rule(left, right, rules.Rule("r", (rules.Condition("x", "gt", "y"), rules.Condition("k", "lte", "g"))))
    assert not nested(matched) and matched.where("NOT (x > y AND k <= g)").count() == 0 and matched.count() > 0


def test_the_order_query_reads_whole_tables(spark, sf_dir):
    """Every balance counts, not the high ones only."""
    balances = lambda name, column: [r[0] for r in spark.read.parquet(f"{sf_dir}/{name}.parquet").select(column).collect()]
    left, right = balances("customer", "c_acctbal"), balances("supplier", "s_acctbal")
    assert QUERIES["match_order_only"](spark, sf_dir).count() == sum(a > b for a in left for b in right) > 0


def test_unmatched_rows_with_any_type(spark):
    left = spark.createDataFrame([(1, {"a": 1, "b": 2}, [{"c": 1}], (1, {"d": 2})), (2, {"a": 1}, None, None), (3, None, [{}], (3, None))], "id int, m map<string,int>, n array<map<string,int>>, s struct<i:int,m:map<string,int>>")
    matched = left.where("id <> 2").alias("l").join(spark.range(1).alias("r"), F.lit(True))
    assert [x.id for x in unmatched_of(left, matched).collect()] == [2]


def greedy(pairs, pattern):
    kept, lefts, rights = [], set(), set()
    for c, a, b in sorted((c, a, b) for a, b, c in pairs if None not in (a, b, c)):
        if not (pattern in ("1:1", "M:1") and a in lefts or pattern in ("1:1", "1:N") and b in rights) and (a, b) not in {(x, y) for x, y, _ in kept}:
            kept.append((a, b, c))
            lefts.add(a)
            rights.add(b)
    return sorted(kept)


@pytest.mark.parametrize("pattern", ["1:1", "1:N", "M:1"])
@pytest.mark.parametrize("seed", [1, 2])
def test_patterns_against_greedy(spark, pattern, seed):
    rng = random.Random(seed)
    pairs = [(None if rng.random() < 0.03 else rng.randrange(25), rng.choice([0] * 10 + list(range(20))), None if rng.random() < 0.03 else float(rng.randrange(6))) for _ in range(200)]
    df = spark.createDataFrame(pairs, "left_key long, right_key long, cost double")
    assert sorted(tuple(x) for x in enforce(df, pattern).collect()) == greedy(pairs, pattern)
    assert enforce(df.limit(0), pattern).count() == 0


def test_a_chain_takes_many_rounds_and_ends(spark):
    chain = [(i, j, float(2 * i + (j - i))) for i in range(6) for j in (i, i + 1)]
    df = spark.createDataFrame(chain, "left_key long, right_key long, cost double")
    assert sorted(tuple(x) for x in enforce(df).collect()) == greedy(chain, "1:1")
    with pytest.raises(ValueError):
        enforce(df, "N:M")


def test_match_pattern(spark):
    l = spark.createDataFrame([(1, 10.0), (2, 10.4)], "id int, a double")  # noqa: E741
    r = spark.createDataFrame([(7, 10.3), (8, 10.9)], "rid int, b double")
    rule = lambda p: rules.Rule("r", (rules.Condition("a", "tolerance", "b", 1.0),), p)
    got = lambda p: sorted((x.left_key, x.right_key) for x in rules.match_pattern(l, r, rule(p), "id", "rid").collect())
    assert got("1:1") == [(1, 8), (2, 7)] and got("1:N") == [(2, 7), (2, 8)] and got("M:1") == [(1, 7), (2, 7)]


@pytest.mark.parametrize("blocks", [1, 5])
def test_one_to_one_by_position_makes_no_pairs(spark, monkeypatch, blocks):
    """Equal positions, ties before and behind, values that only differ in rounding, nulls and NaN."""
    monkeypatch.setattr(rules, "match_rule", None)
    monkeypatch.setattr(rules, "nearest_one_to_one", lambda *a: nearest_one_to_one(*a, blocks))
    rng = random.Random(3)
    value = lambda: rng.choice([0.3, 0.1 + 0.2, 7.0, float("nan"), None, float(rng.randrange(40)), rng.random() * 40])
    left, right = [(i, rng.choice(["a", "b", None]), value()) for i in range(150)], [(f"s{i}", rng.choice(["a", "b"]), value()) for i in range(60)]
    rule = rules.Rule("near", (rules.Condition("k", "eq", "g"), rules.Condition("x", "tolerance", "y", 6.0)))
    got = rules.match_pattern(spark.createDataFrame(left, "id int, k string, x double"), spark.createDataFrame(right, "rid string, g string, y double"), rule, "id", "rid")
    pairs = [(i, j, abs(x - y)) for i, k, x in left for j, g, y in right if k == g and None not in (x, y) and abs(x - y) <= 6.0]
    assert sorted(tuple(r) for r in got.collect()) == greedy(pairs, "1:1")


def test_one_to_one_of_keys_with_several_rows(spark):
    rule = rules.Rule("near", (rules.Condition("a", "tolerance", "b", 5.0),))
    left, right = spark.createDataFrame([(1, 10.0), (1, 20.0), (2, 19.0)], "id int, a double"), spark.createDataFrame([(7, 20.5), (8, 11.0)], "rid int, b double")
    assert sorted((r.left_key, r.right_key) for r in rules.match_pattern(left, right, rule, "id", "rid").collect()) == [(1, 7)]
