"""Exact top-k inner products by KD-trees per shard.

Vectors are dealt by a hash of their id over shards of about ``SHARD`` rows.  A shard's tree splits at medians of the
widest dimension down to leaves of ``LEAF`` rows; every node has the tight bounding box of its rows.  The bound of a box
for a query q is the sum of q+ times the upper and q- times the lower corner, so a block of queries is bounded by two
matrix products.  A query descends best bound first and stops at a node whose bound is below its k-th score.

Two passes: each query first searches its own shard, and the k-th score found there is propagated to the search of all
others, which prunes from the start.  Queries are sent in blocks of ``BLOCK``, so that a group, one shard with one
block, is bounded; a vector goes to every block and a query to every shard, as an exact search of all rows needs.

Defined cases: a vector that is null, or holds a null or a non-finite component, takes no part; ties go to the smaller
id; rows with equal ids and vectors are all candidates, but for the query's own id, and ask once; rows of one id with
unequal vectors ask together, so that the k best scores of any of them are returned; vectors of unequal length are
compared as if padded with zeros; an empty table gives no row.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import LONG, durable, struct

K, SHARD, LEAF, BLOCK, SCALE, QUERY_STEP = 20, 4096, 128, 4096, 64, 20
FOUND = struct(query_id=LONG, vec_id=LONG, score=LONG)


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Rows of whole numbers; int64."""
    lists = column.combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    sizes = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy().astype(np.int64)
    out = np.zeros((len(sizes), max(1, int(sizes.max(initial=0)))), np.int64)
    out[np.arange(out.shape[1]) < sizes[:, None]] = flat
    return out


class Tree:
    """Nodes in arrays: box corners, children (or -1), and the span of rows; rows are stored in node order, each leaf by id."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, leaf: int = LEAF):
        order = np.argsort(ids, kind="stable")
        self.ids, self.rows = ids[order], rows[order]
        self.low, self.high, self.child, self.span = [], [], [], []
        stack = [(np.arange(len(ids)), -1, 0)]
        place, at = [], 0
        while stack:
            own, parent, side = stack.pop()
            node = len(self.child)
            part = self.rows[own]
            low, high = part.min(axis=0), part.max(axis=0)
            self.low.append(low)
            self.high.append(high)
            self.child.append([-1, -1])
            self.span.append((at, at))
            if parent >= 0:
                self.child[parent][side] = node
            wide = int(np.argmax(high - low))
            if len(own) <= leaf or high[wide] == low[wide]:
                self.span[node] = (at, at + len(own))
                place.append(np.sort(own))
                at += len(own)
            else:
                half = np.argpartition(part[:, wide], len(own) // 2)
                stack.append((own[half[len(own) // 2 :]], node, 1))
                stack.append((own[half[: len(own) // 2]], node, 0))
        at = np.concatenate(place)
        self.ids, self.rows = self.ids[at], self.rows[at]
        self.low, self.high = np.array(self.low), np.array(self.high)


def _dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact whole-number products: in doubles while they are exact, else in Python's integers."""
    most = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * a.shape[-1]
    if most < 1 << 52:
        return (a.astype(np.float64) @ b.astype(np.float64)).astype(np.int64)
    return np.clip(a.astype(object) @ b.astype(object), -(1 << 63), (1 << 63) - 1).astype(np.int64)


def search(tree: Tree, query_ids: np.ndarray, queries: np.ndarray, kth: np.ndarray, k: int = K) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best rows for each query: position of the query, id, score.  kth: a score known to be reached by k other rows, or the least long."""
    d = max(tree.rows.shape[1], queries.shape[1])
    pad = lambda x: np.pad(x, ((0, 0), (0, d - x.shape[1])))
    rows, queries = pad(tree.rows), pad(queries)
    bounds = _dot(np.maximum(queries, 0), pad(tree.high).T) + _dot(np.minimum(queries, 0), pad(tree.low).T)
    # queries that want a leaf are scored together; a round takes each query to its next best leaf
    heaps = [[(-int(bounds[i, 0]), 0)] for i in range(len(queries))]
    best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in range(len(queries))]
    floor = kth.astype(np.int64).copy()
    active = list(range(len(queries)))
    while active:
        wanted: dict[int, list[int]] = {}
        for i in active:
            heap, row = heaps[i], bounds[i]
            while heap and -heap[0][0] >= floor[i]:
                node = heapq.heappop(heap)[1]
                one, two = tree.child[node]
                if one < 0:
                    wanted.setdefault(node, []).append(i)
                    break
                heapq.heappush(heap, (-int(row[one]), one))
                heapq.heappush(heap, (-int(row[two]), two))
        active = []
        for node, some in wanted.items():
            a, b = tree.span[node]
            score = _dot(queries[some], rows[a:b].T)
            ids = tree.ids[a:b]
            for i, s in zip(some, score, strict=True):
                fit = np.flatnonzero((s >= floor[i]) & (ids != query_ids[i]))
                if len(fit):
                    s_all, id_all = np.concatenate([best[i][0], s[fit]]), np.concatenate([best[i][1], ids[fit]])
                    if len(s_all) > k:
                        top = np.lexsort((id_all, -s_all))[:k]
                        s_all, id_all = s_all[top], id_all[top]
                    best[i] = (s_all, id_all)
                    if len(s_all) == k:
                        floor[i] = max(floor[i], int(s_all.min()))
                active.append(i)
    n = [len(b[0]) for b in best]
    join = lambda j: np.concatenate([b[j] for b in best]) if best else np.zeros(0, np.int64)
    return np.repeat(np.arange(len(queries)), n), join(1), join(0)


def _searched(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
    """One shard with one block of queries."""
    if not left.num_rows or not right.num_rows:
        at, ids, scores = (np.zeros(0, np.int64),) * 3
        query_ids = at
    else:
        query_ids = right["query_id"].to_numpy()
        at, ids, scores = search(Tree(left["vec_id"].to_numpy(), matrix(left["v"])), query_ids, matrix(right["q"]), right["kth"].to_numpy())
    return pa.table({"query_id": query_ids[at], "vec_id": ids, "score": scores})


def whole_vectors(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id and v, an array of floor(scale * x); vectors that take no part are left out."""
    x = F.col("embedding")
    finite = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != F.lit(float("inf"))))
    return vectors.where(x.isNotNull() & finite & F.col("vec_id").isNotNull()).select("vec_id", F.transform(x, lambda e: F.floor(F.lit(float(scale)) * e.cast("double"))).alias("v"))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """vectors: vec_id, v; queries: query_id, q.  query_id, rank, vec_id, score of the k best rows for each query."""
    shards = max(1, -(-vectors.count() // shard))
    blocks = max(1, -(-queries.count() // block))
    least = -(1 << 63)
    shard_of = lambda c: F.pmod(F.xxhash64(F.col(c)), F.lit(shards)).cast("int")
    block_of = F.pmod(F.xxhash64("query_id", F.lit(1)), F.lit(blocks)).cast("int")
    rows = vectors.select("vec_id", "v", shard_of("vec_id").alias("shard"))
    asked = queries.select("query_id", "q", block_of.alias("block"))

    def every(df: DataFrame, name: str, n: int) -> DataFrame:
        return df.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))

    def passed(rows: DataFrame, asked: DataFrame) -> DataFrame:
        keys = ["shard", "block"]
        return rows.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(_searched, FOUND)

    # the queries of a shard are some of its own rows, so their number is bounded too and they form one block
    home = asked.withColumn("shard", shard_of("query_id")).withColumn("block", F.lit(0))
    own = durable(passed(rows.withColumn("block", F.lit(0)), home.withColumn("kth", F.lit(least))))
    kth = own.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).otherwise(least).alias("kth"))
    known = asked.join(kth, "query_id", "left").withColumn("kth", F.coalesce("kth", F.lit(least)))
    others = every(known, "shard", shards).where(F.col("shard") != shard_of("query_id"))
    found = own.unionByName(passed(every(rows, "block", blocks), others))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10_topk(vectors: DataFrame) -> DataFrame:
    rows = whole_vectors(vectors)
    return top_k(rows, rows.where(F.pmod("vec_id", F.lit(QUERY_STEP)) == 0).select(F.col("vec_id").alias("query_id"), F.col("v").alias("q")).distinct())
