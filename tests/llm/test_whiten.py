import math

import numpy as np
import pytest

from ledgerloom.llm import queries, whiten

SCHEMA = "vec_id long, embedding array<float>"


def plain(rows):
    """ids, x as Python integers, and V, without the library."""
    ids, xs = [], []
    for i, v in rows:
        if v is not None and all(e is not None and math.isfinite(e) for e in v):
            ids.append(i)
            xs.append([math.floor(1024 * float(np.float32(e))) + 100_000 for e in v])
    d = max(map(len, xs))
    xs = np.array([x + [100_000] * (d - len(x)) for x in xs])
    n = len(xs)
    c = (n * xs - xs.sum(axis=0)) / n
    return ids, xs, c, c.T @ c / n


def check(rows, found, k=8):
    ids, xs, c, v = plain(rows)
    n, values = len(ids), np.linalg.eigvalsh(v)[::-1]
    k = min(k, int((values > values[0] * 1e-13).sum()))
    assert len(found) == n * k
    by = {}
    for r in found:
        by.setdefault(r.component, []).append(r)
    deviation = {}
    for i, x in zip(ids, xs, strict=True):
        deviation.setdefault(i, set()).add(sum(int(e) ** 2 for e in n * x.astype(object) - xs.astype(object).sum(axis=0)))
    components = np.linalg.eigh(v)[1][:, ::-1]
    for j in range(1, k + 1):
        mine = by[j]
        assert all(r.n == n and r.deviation in deviation[r.vec_id] for r in mine)
        assert mine[0].explained == pytest.approx(values[j - 1] / values.sum(), rel=1e-9)
        assert mine[0].identity_error <= 1e-9
        w = c @ components[:, j - 1] / math.sqrt(values[j - 1])
        got, want = {r.vec_id: r.whitened for r in mine}, dict(zip(ids, w, strict=True))
        sign = math.copysign(1, sum(got[i] * want[i] for i in got))
        assert max(abs(sign * got[i] - want[i]) for i in got) < 1e-6


def test_query(spark, sf_dir):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    check(rows, queries.op11_whiten(spark, sf_dir).collect())


def steep(seed, n=400, d=40):
    """Values that fall fast, so that power passes are enough."""
    rng = np.random.default_rng(seed)
    turn = np.linalg.qr(rng.standard_normal((d, d)))[0]
    return (rng.standard_normal((n, d)) * 0.5 ** np.arange(d) * 50) @ turn


def test_power_passes_find_steep_components(spark):
    x = steep(1)
    rows = [(i, [float(e) for e in np.float32(v)]) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    model = whiten.fit(whiten.whole(df), k=3, passes=8)
    assert not model.expanded and model.passes < 8
    check(rows, whiten.op11_whiten(df, k=3).collect(), k=3)


def test_slow_components_expand_the_basis(spark):
    x = np.random.default_rng(2).standard_normal((300, 40))
    df = spark.createDataFrame([(i, [float(e) for e in v]) for i, v in enumerate(x)], SCHEMA)
    model = whiten.fit(whiten.whole(df))
    assert model.expanded and model.passes == whiten.PASSES + 1


def test_odd_vectors(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(np.float32(e)) for e in rng.standard_normal(5)]) for i in range(50)]
    odd = [(100, None), (101, [None] * 5), (102, [float("nan")] * 5), (103, [float("inf"), 0.0, 0.0, 0.0, 0.0]), (104, [1.0, 2.0]), (105, []), (None, [0.5] * 5), (7, [0.25] * 5), (7, [0.25] * 5)]
    df = spark.createDataFrame([(*r, 1, 2, "x") for r in rows + odd], SCHEMA + ", component int, n int, whitened string")
    found = whiten.op11_whiten(df).collect()
    assert {r.vec_id for r in found} == {*range(50), 104, 105, None}
    assert len(found) == 5 * 55
    unique = [r for r in found if r.vec_id not in (7, None)]
    ids, xs, c, v = plain(rows + odd)
    e, u = np.linalg.eigh(v)
    w = abs(c @ u[:, ::-1] / np.sqrt(e[::-1]))
    want = {(i, j + 1): w[a, j] for a, i in enumerate(ids) for j in range(5)}
    assert all(abs(abs(r.whitened) - want[r.vec_id, r.component]) < 1e-8 for r in unique)


def test_no_spread_and_no_rows(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0])] * 3, SCHEMA)
    assert whiten.op11_whiten(df).count() == 0
    assert whiten.op11_whiten(df.limit(1)).count() == 0 and whiten.op11_whiten(df.limit(0)).count() == 0
    line = spark.createDataFrame([(i, [float(i), 2.0 * i]) for i in range(5)], SCHEMA)
    found = whiten.op11_whiten(line).collect()
    assert {r.component for r in found} == {1} and found[0].explained == pytest.approx(1)


def test_huge_entries_stay_exact_or_null(spark):
    rows = [(0, [3e38, 0.0]), (1, [-3e38, 1.0]), (2, [5.0, 2.0])]
    found = whiten.op11_whiten(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.vec_id: r.deviation for r in found}[0] is None and all(math.isfinite(r.whitened) for r in found)
