import math
import random

import numpy as np
import pytest

from ledgerloom.llm import queries, topk


def brute(rows, k=20):
    whole = []
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            whole.append((i, [math.floor(64 * float(np.float32(x))) for x in v]))
    out = set()
    for q, v in {(i, tuple(v)) for i, v in whole if i % 20 == 0}:
        best = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), i) for i, w in whole if i != q)[:k]
        out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(best)}
    return out


def test_query(spark, sf_dir):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    assert {tuple(r) for r in queries.op10_topk(spark, sf_dir).collect()} == brute(rows)


@pytest.mark.parametrize("shard,block", [(4096, 4096), (64, 16)])
def test_ties_and_odd_vectors(spark, shard, block):
    rng = random.Random(1)
    same = [0.5, -0.25, 1.0]
    rows = [(i, [rng.uniform(-1, 1) for _ in range(3)]) for i in range(300)] + [(i, same) for i in range(300, 700)]
    rows += [(1000, None), (1020, [None, 1.0, 2.0]), (1040, [float("nan"), 1.0, 1.0]), (1060, [float("inf"), 0.0, 0.0]), (None, same), (-40, [0.0, 0.0, 0.0])]
    df = topk.whole_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    asked = df.where("pmod(vec_id, 20) = 0").selectExpr("vec_id AS query_id", "v AS q")
    assert {tuple(r) for r in topk.top_k(df, asked, shard=shard, block=block).collect()} == brute(rows)


def test_few_and_no_rows(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in topk.op10_topk(df).collect()] == [(0, 1, 1, 64 * 128)]
    assert topk.op10_topk(df.limit(0)).count() == 0 and topk.op10_topk(df.limit(1)).count() == 0


def test_repeated_rows_ask_once(spark):
    df = spark.createDataFrame([(0, [1.0]), (0, [1.0]), (1, [2.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in topk.op10_topk(df).orderBy("rank").collect()] == [(0, 1, 1, 64 * 128), (0, 2, 1, 64 * 128)]


def test_search_prunes_by_a_known_score():
    rng = np.random.default_rng(0)
    rows, q = rng.integers(-64, 64, (2000, 4)), rng.integers(-64, 64, (5, 4))
    tree = topk.Tree(np.arange(2000), rows, leaf=32)
    assert (tree.low[0] == rows.min(axis=0)).all() and (tree.high[0] == rows.max(axis=0)).all()
    scores = np.sort(q @ rows.T, axis=1)[:, ::-1]
    for known in (np.full(5, -(1 << 63)), scores[:, 19].copy()):
        at, ids, found = topk.search(tree, np.full(5, -1), q, known)
        for i in range(5):
            assert sorted(found[at == i].tolist(), reverse=True)[:20] == scores[i, :20].tolist()
            assert (q[i] @ rows[ids[at == i]].T == found[at == i]).all()


def test_large_components_stay_exact():
    a = np.array([[1 << 40, 3]], np.int64)
    assert topk._dot(a, np.array([[1 << 20], [1]], np.int64)).tolist() == [[(1 << 60) + 3]]
