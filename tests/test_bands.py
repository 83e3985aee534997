import random

import pytest

from ledgerloom.plans.bands import bucketed, top_join
from ledgerloom.session import job_session


@pytest.fixture(scope="module")
def session(spark):
    own, rng = job_session(spark), random.Random(4)
    odd = [None, float("nan"), float("inf"), float("-inf"), 1e308, -1e308, 0.0, 5.0, -0.0]
    a = [(i, rng.choice(odd) if i % 10 == 0 else round(rng.uniform(-50, 50), 1), rng.uniform(0, 4), f"2024-01-{rng.randint(1, 28):02d}") for i in range(200)]
    b = [(i, rng.choice(odd) if i % 10 == 0 else round(rng.uniform(-50, 50), 1), rng.uniform(0, 4), f"2024-01-{rng.randint(1, 28):02d}") for i in range(150)]
    for name, rows in (("l", a), ("r", b)):
        own.createDataFrame(rows, "id int, x double, w double, d string").selectExpr("id", "x", "w", "to_date(d) AS d", "CAST(to_date(d) AS TIMESTAMP) AS ts", "id % 7 AS g").createOrReplaceTempView(name)
    return own


CONDITIONS = [
    "tolerance_match(l.x, r.x, 2.5)",
    "abs(l.x - r.x) < 2",
    "abs(r.x - l.x) <= r.w",
    "abs(r.x - l.x) <= l.w AND l.g <> r.g",
    "r.d BETWEEN l.d - INTERVAL 2 DAYS AND l.d + INTERVAL 1 DAY",
    "r.ts >= l.ts - INTERVAL 5 HOURS AND r.ts < l.ts + INTERVAL 1 DAY",
    "r.x >= l.x AND r.x <= l.x + l.w",
    "l.x BETWEEN r.x - r.w AND r.x",
    "l.x <= r.x AND r.x <= l.x",
]
KINDS = ["JOIN", "LEFT JOIN", "RIGHT JOIN", "LEFT SEMI JOIN", "LEFT ANTI JOIN"]


def nested(df) -> bool:
    plan = df._jdf.queryExecution().executedPlan().toString()
    return "NestedLoop" in plan or "Cartesian" in plan


@pytest.mark.parametrize("condition", CONDITIONS)
def test_same_rows_without_comparing_all(session, condition):
    for kind in KINDS:
        columns = "l.id AS a" if "SEMI" in kind or "ANTI" in kind else "l.id AS a, r.id AS b, l.x, r.x AS y"
        plain = session.sql(f"SELECT {columns} FROM l {kind} r ON {condition}")
        assert nested(plain)
        done = bucketed(plain)
        assert done.columns == plain.columns
        assert sorted(map(repr, done.collect())) == sorted(map(repr, plain.collect()))
        # the side that a join keeps must have the point; where it has the interval alone, the plan stays
        can = kind == "JOIN" or "abs" in condition and ".w" not in condition or "tolerance" in condition
        assert not (can and nested(done))


def test_joins_within_larger_queries(session):
    text = "SELECT q.g, count(*) AS n FROM (SELECT l.g, r.id FROM l JOIN r ON abs(l.x - r.x) <= 1 WHERE l.id > 5) q JOIN (SELECT DISTINCT g FROM r) s ON q.g = s.g GROUP BY q.g HAVING count(*) > 1"
    plain = session.sql(text)
    done = bucketed(plain)
    assert not nested(done) and sorted(done.collect()) == sorted(plain.collect())
    both = session.sql("SELECT a.id, b.id AS i, c.id AS j FROM l a JOIN r b ON abs(a.x - b.x) < 0.5 JOIN l c ON abs(c.x - b.x) < 0.3")
    done = bucketed(both)
    assert not nested(done) and sorted(done.collect()) == sorted(both.collect())


def test_what_needs_no_buckets_or_has_none_stays(session):
    for text in ("SELECT l.id FROM l JOIN r ON l.id = r.id AND abs(l.x - r.x) < 1", "SELECT l.id FROM l JOIN r ON l.x < r.x", "SELECT l.id FROM l FULL JOIN r ON abs(l.x - r.x) < 1", "SELECT id FROM l"):
        df = session.sql(text)
        assert bucketed(df) is df


def test_parts_of_a_join(session):
    parts = top_join(session.sql("SELECT l.id FROM l JOIN r ON l.id = r.id AND tolerance_match(l.x, r.x, 1)"))
    assert len(parts.equal) == 1 and {b.point_side for b in parts.bands} == {"left", "right"}
    assert top_join(session.sql("SELECT id FROM l")) is None
