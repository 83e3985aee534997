import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import queries, vptree

SCHEMA = "vec_id long, embedding array<float>"


def brute(rows, k=10, step=100):
    whole = []
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v):
            whole.append((i, np.float32(v).astype(float)))
    d = max(len(v) for _, v in whole)
    whole = [(i, np.pad(v, (0, d - len(v)))) for i, v in whole]
    out = {}
    for q, v in {(i, tuple(v)) for i, v in whole if i % step == 0}:
        out[q] = out.get(q, []) + [(float(np.sqrt(np.square(w - np.array(v)).sum())), i) for i, w in whole if i != q]
    out = {q: sorted(near)[:k] for q, near in out.items()}
    return {(q, r + 1, i, round(s, 9)) for q, near in out.items() for r, (s, i) in enumerate(near)}


def rounded(df):
    return {(r.query_id, r["rank"], r.vec_id, round(r.score, 9)) for r in df.collect()}


def test_query_recall(spark, sf_dir):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    want, got = brute(rows), rounded(queries.op13_vptree(spark, sf_dir))
    assert {(q, r) for q, r, _, _ in got} == {(q, r) for q, r, _, _ in want}
    assert len({(q, i) for q, _, i, _ in got} & {(q, i) for q, _, i, _ in want}) >= 0.95 * len(want)


def clustered(seed, n=1500, d=6):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((20, d)) * 5
    return [(i, [float(x) for x in np.float32(centres[i % 20] + rng.standard_normal(d) * 0.3)]) for i in range(n)]


@pytest.mark.parametrize("cell,cells,shard,block", [(4096, 1024, 8192, 2048), (100, 8, 60, 3)])
def test_factor_one_is_exact(spark, cell, cells, shard, block):
    rows = clustered(1)
    df = vptree.whole_vectors(spark.createDataFrame(rows, SCHEMA).repartition(3))
    found = vptree.nearest(df, F.pmod("vec_id", F.lit(100)) == 0, factor=1, cell=cell, cells=cells, shard=shard, block=block)
    assert rounded(found) == brute(rows)


def test_many_copies_and_odd_vectors(spark):
    rng = random.Random(1)
    same = [0.5, -0.25, 1.0]
    rows = [(i, [rng.uniform(-1, 1) for _ in range(3)]) for i in range(300)] + [(i, same) for i in range(300, 700)]
    rows += [(1000, None), (1100, [None, 1.0, 2.0]), (1200, [float("nan"), 1.0, 1.0]), (1300, [float("inf"), 0.0, 0.0]), (None, same), (-400, [0.0, 0.0, 0.0]), (1400, []), (1500, [0.5]), (200, [9.0, 9.0, 9.0])]
    df = spark.createDataFrame([(*r, 1, 2.0) for r in rows], SCHEMA + ", cell int, far double")
    found = vptree.nearest(vptree.whole_vectors(df), F.pmod("vec_id", F.lit(100)) == 0, factor=1, cell=100, cells=5, shard=64, block=4)
    assert rounded(found) == brute(rows)


def test_few_and_no_rows(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [3.0])], SCHEMA)
    assert [tuple(r) for r in vptree.op13_vptree(df).collect()] == [(0, 1, 1, 2.0)]
    assert vptree.op13_vptree(df.limit(0)).count() == 0 and vptree.op13_vptree(df.limit(1)).count() == 0
    twice = spark.createDataFrame([(0, [1.0])] * 2 + [(1, [3.0])] * 2, SCHEMA)
    assert sorted(tuple(r) for r in vptree.op13_vptree(twice).collect()) == [(0, 1, 1, 2.0), (0, 2, 1, 2.0)]


def test_pruning_saves_work_where_there_is_structure():
    rows = clustered(2, 4000)
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows])
    tree, q = vptree.Tree(ids, x, leaf=32), x[::100]
    exact = vptree.search(tree, ids[::100], q, np.full(len(q), np.inf), factor=1)
    relaxed = vptree.search(tree, ids[::100], q, np.full(len(q), np.inf), factor=3)
    assert exact[3] < 0.3 * len(q) * len(x) and relaxed[3] < exact[3]
    share = len(set(zip(relaxed[0], relaxed[1], strict=True)) & set(zip(exact[0], exact[1], strict=True))) / len(exact[0])
    assert share > 0.8
    # a known distance prunes from the start and loses nothing
    kth = np.array([exact[2][exact[0] == i].max() for i in range(len(q))])
    known = vptree.search(tree, ids[::100], q, kth, factor=1)
    assert known[3] <= exact[3] and (known[1] == exact[1]).all()


def test_triangle_bounds_hold():
    x = np.random.default_rng(3).standard_normal((500, 4))
    tree = vptree.Tree(np.arange(500), x, leaf=16)

    def inside(node):
        one, two = tree.child[node]
        a, b = tree.span[node]
        return tree.rows[a:b] if one < 0 else np.concatenate([inside(one), inside(two)])

    for node, point in enumerate(tree.vantage):
        if point is not None:
            for child, (least, most) in zip(tree.child[node], tree.range[node], strict=True):
                dist = vptree.distances(inside(child), point)
                assert dist.min() == least and dist.max() == most
