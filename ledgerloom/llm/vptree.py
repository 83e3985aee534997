"""Approximate nearest neighbours by vantage-point trees per shard.

At most ``CELLS`` pivots, rows of the table that a hash chooses, divide the space: a row goes to the cell of its nearest
pivot, and a cell of more than ``SHARD`` rows is dealt over shards by a hash of the row, so that copies of one vector, however
many, fill no task.  Each shard has a vantage-point tree: a node halves its rows at their median distance from one of
them, and knows the least and the greatest distance of either half, so that the triangle inequality bounds from below how
near a row of that half can be to a query: max(d - greatest, least - d, the node's own bound).

A query first searches its own shard; the k-th distance found there is propagated.  It then goes to the shards of those
cells, and within them to those nodes, whose bound times ``FACTOR`` doesn't exceed the k-th distance known so far.  With a
factor of 1 the search is exact; a larger one relaxes the inequality: it takes bounds for as much tighter and may lose a
neighbour.  Leaves are visited best bound first.  Distances of what is found are computed from the original vectors.
On vectors without structure, such as the test tables' (64 near-random dimensions), the 10th neighbour is about as far as
three quarters of the median row; there the inequality alone prunes 3 % of the rows, and the factor 5 about 12 %.

Sizes: a group is one shard with a block of at most about ``BLOCK`` queries; a shard is repeated only for as many blocks as
the queries that reach it fill, and a query goes only to cells that its bound lets it reach.  The pivots are the only
thing sent to all tasks, and bounded; every row is indexed.

Defined cases: a vector that is null or zero, or holds a null or a non-finite component, takes no part, nor does a row
without an id; ties go to the smaller id; rows with equal ids and vectors are all candidates, but for the query's own id,
and ask once; rows of one id with unequal vectors ask together; vectors of unequal length are compared as if padded with
zeros; an empty table gives no row; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ledgerloom.llm.common import DBL, INT, LONG, durable, map_batches, struct

K, STEP, FACTOR = 10, 100, 5.0
CELL, CELLS, SHARD, LEAF, BLOCK, CANDIDATES = 4096, 1024, 8192, 128, 2048, 8
VECTOR = T.ArrayType(DBL)


def whole_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id and v, the components as doubles, of the vectors that take part."""
    x = F.col("embedding")
    finite = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != F.lit(float("inf"))))
    return vectors.where(x.isNotNull() & F.col("vec_id").isNotNull() & finite & F.exists(x, lambda e: e != 0)).select(F.col("vec_id").cast("long"), x.cast(VECTOR).alias("v"))


def matrix(column: pa.ChunkedArray | pa.Array, d: int = 1) -> np.ndarray:
    """Rows of doubles, padded with zeros to the longest, or to d."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(lists.offsets.to_numpy())
    d = max(d, int(sizes.max(initial=0)))
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    if (sizes == d).all():
        return flat.reshape(-1, d)
    out = np.zeros((len(sizes), d))
    out[np.arange(d) < sizes[:, None]] = flat
    return out


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of each row of a from the vector b, from their differences."""
    return np.sqrt(np.square(a - b).sum(axis=-1))


class Tree:
    """Nodes in arrays, parents before children: vantage point, children (or -1), their ranges of distance, and the span of a leaf's rows."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, leaf: int = LEAF):
        order = np.argsort(ids, kind="stable")
        ids, rows = ids[order], rows[order]
        self.vantage: list[np.ndarray | None] = []
        self.child: list[list[int]] = []
        self.range: list[list[tuple[float, float]]] = []
        self.span: list[tuple[int, int]] = []
        place, at, stack = [], 0, [(np.arange(len(ids)), -1, 0)]
        while stack:
            own, parent, side = stack.pop()
            node = len(self.child)
            if parent >= 0:
                self.child[parent][side] = node
            self.child.append([-1, -1])
            self.range.append([])
            split = self._split(rows[own]) if len(own) > leaf else None
            if split is None:
                self.vantage.append(None)
                self.span.append((at, at + len(own)))
                place.append(own)
                at += len(own)
                continue
            point, dist = split
            half = np.argpartition(dist, len(own) // 2)
            parts = half[: len(own) // 2], half[len(own) // 2 :]
            self.vantage.append(point)
            self.span.append((at, at))
            self.range[node] = [(float(dist[p].min()), float(dist[p].max())) for p in parts]
            stack += [(np.sort(own[parts[1]]), node, 1), (np.sort(own[parts[0]]), node, 0)]
        chosen = np.concatenate(place) if place else np.zeros(0, np.int64)
        self.ids, self.rows = ids[chosen], rows[chosen]
        self.squares = np.square(self.rows).sum(axis=1)

    @staticmethod
    def _split(part: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """Of a few rows that from which the others' distances vary most, with these; None if they don't vary."""
        found = [(p, distances(part, p)) for p in part[np.linspace(0, len(part) - 1, CANDIDATES).astype(int)]]
        point, dist = max(found, key=lambda f: float(f[1].var()))
        return None if dist.min() == dist.max() else (point, dist)


def search(tree: Tree, query_ids: np.ndarray, queries: np.ndarray, kth: np.ndarray, k: int = K, factor: float = FACTOR) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Position of the query, id and distance of its k nearest rows, as far as the factor lets it search, and the number of rows compared.  kth: a distance within which k other rows are known, or infinity."""
    d = max(tree.rows.shape[1], queries.shape[1])
    pad = lambda x: np.pad(x, ((0, 0), (0, d - x.shape[1])))
    rows, queries, limit = pad(tree.rows), pad(queries), kth.astype(float).copy()
    n, compared = len(queries), 0
    bounds = np.full((n, len(tree.child)), np.inf)
    bounds[:, 0] = 0
    for node, (point, children) in enumerate(zip(tree.vantage, tree.child, strict=True)):
        own = bounds[:, node]
        alive = np.flatnonzero(own * factor <= limit)
        if point is None or not len(alive):
            continue
        dist = distances(queries[alive], np.pad(point, (0, d - len(point))))
        for c, (least, most) in zip(children, tree.range[node], strict=True):
            bounds[alive, c] = np.maximum(own[alive], np.maximum(dist - most, least - dist))
    leaves = np.array([i for i, p in enumerate(tree.vantage) if p is None])
    bounds = bounds[:, leaves]
    order, turn = np.argsort(bounds, axis=1, kind="stable"), 0
    best = [(np.zeros(0), np.zeros(0, np.int64)) for _ in range(n)]
    squares = np.square(queries).sum(axis=1)
    active = np.arange(n)
    while turn < len(leaves) and len(active):
        wanted = order[active, turn]
        near = bounds[active, wanted]
        go = np.isfinite(near) & (near * factor <= limit[active])
        active, wanted = active[go], wanted[go]  # bounds only grow from here on, so whoever stops is done
        for leaf in np.unique(wanted):
            some = active[wanted == leaf]
            a, b = tree.span[leaves[leaf]]
            compared += len(some) * (b - a)
            about = squares[some, None] + tree.squares[a:b] - 2 * (queries[some] @ rows[a:b].T)
            slack = 1e-9 * (squares[some, None] + tree.squares[a:b])  # more than the products can be wrong by
            hit = (about <= np.square(limit[some])[:, None] + slack) & (tree.ids[a:b] != query_ids[some, None])
            for j in np.flatnonzero(hit.any(axis=1)):
                i, found = some[j], np.flatnonzero(hit[j]) + a
                exact = distances(rows[found], queries[i])
                known, ids = np.concatenate([best[i][0], exact]), np.concatenate([best[i][1], tree.ids[found]])
                top = np.lexsort((ids, known))[:k]
                best[i] = known[top], ids[top]
                if len(top) == k:
                    limit[i] = min(limit[i], known[top[-1]])
        turn += 1
    sizes = [len(x) for x, _ in best]
    at = np.repeat(np.arange(n), sizes)
    dist, ids = (np.concatenate([x[j] for x in best]) if n else np.zeros(0) for j in (0, 1))
    within = dist <= kth[at]  # what is beyond can't be among the k nearest
    return at[within], ids[within].astype(np.int64), dist[within], compared


FOUND = struct(ask=LONG, query_id=LONG, vec_id=LONG, score=DBL)


def _searcher(k: int, factor: float):
    """One shard with one block of queries."""

    def searched(_key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return to_arrow_schema(FOUND).empty_table()
        query_ids, asks = right["query_id"].to_numpy(), right["ask"].to_numpy()
        at, ids, score, _ = search(Tree(left["vec_id"].to_numpy(), matrix(left["v"])), query_ids, matrix(right["q"]), right["kth"].to_numpy(), k, factor)
        return pa.table([asks[at], query_ids[at], ids, score], schema=to_arrow_schema(FOUND))

    return searched


def _pivots(rows: DataFrame, cells: int) -> np.ndarray:
    """At most so many unequal rows, those of least hash."""
    chosen = rows.orderBy(F.xxhash64("vec_id", F.lit(13)), "vec_id").limit(cells).select("v").toArrow()
    return np.unique(matrix(chosen["v"]), axis=0)


def _from_pivots(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances of rows from all pivots."""
    d = max(x.shape[1], pivots.shape[1])
    x, p = (np.pad(m, ((0, 0), (0, d - m.shape[1]))) for m in (x, pivots))
    return np.sqrt(np.maximum(np.square(x).sum(axis=1)[:, None] + np.square(p).sum(axis=1) - 2 * x @ p.T, 0))


def _celled(rows: DataFrame, pivots: np.ndarray) -> DataFrame:
    """rows with cell, that of the nearest pivot, and far, the distance from it."""
    schema = T.StructType([*rows.schema.fields, *struct(cell=INT, far=DBL).fields])

    def run(batches):
        for batch in batches:
            for part in (batch.slice(i, 1024) for i in range(0, batch.num_rows, 1024)):
                dist = _from_pivots(matrix(part.column("v")), pivots)
                cell = dist.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cell, pa.int32()), pa.array(dist[np.arange(len(cell)), cell])], schema=to_arrow_schema(schema))

    return map_batches(rows, run, schema)


def _reached(asked: DataFrame, pivots: np.ndarray, radius: np.ndarray, factor: float) -> DataFrame:
    """asked (ask, query_id, q, kth) once for each cell that the relaxed bound lets it reach."""
    schema = struct(ask=LONG, query_id=LONG, q=VECTOR, kth=DBL, cell=INT)

    def run(batches):
        for batch in batches:
            for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                bound = np.maximum(_from_pivots(matrix(part.column("q")), pivots) - radius, 0) * (1 - 1e-9)
                at, cell = np.nonzero(bound * factor <= part.column("kth").to_numpy()[:, None])
                for i in range(0, len(at), 4096):
                    yield pa.RecordBatch.from_arrays([*(c.take(pa.array(at[i : i + 4096])) for c in part.columns), pa.array(cell[i : i + 4096], pa.int32())], schema=to_arrow_schema(schema))

    return map_batches(asked.select("ask", "query_id", "q", "kth"), run, schema)


def nearest(vectors: DataFrame, is_query, k: int = K, factor: float = FACTOR, cell: int = CELL, cells: int = CELLS, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """vectors: vec_id, v; is_query: a condition on vec_id.  query_id, rank, vec_id, score of each query's k nearest."""
    n = vectors.count()
    pivots = _pivots(vectors, max(1, min(cells, -(-n // cell)))) if n else np.zeros((1, 1))
    rows = durable(_celled(vectors.withColumn("row", F.monotonically_increasing_id()), pivots))
    sizes = {r.cell: r for r in rows.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("radius")).collect()}  # a row for each pivot
    radius = np.array([sizes[i].radius if i in sizes else -np.inf for i in range(len(pivots))])
    parts = F.element_at(F.array(*(F.lit(-(-sizes[i].n // shard) if i in sizes else 0) for i in range(len(pivots)))), F.col("cell") + 1)
    shard_of = lambda part: F.col("cell").cast("long") * (1 << 32) + part
    dealt = rows.select("vec_id", "v", "row", shard_of(F.pmod(F.xxhash64("row"), parts)).alias("shard"))

    def passed(asked: DataFrame) -> DataFrame:
        """asked: ask, query_id, q, kth, shard."""
        blocks = durable(asked.groupBy("shard").agg(F.ceil(F.count("*") / F.lit(block)).alias("blocks")))
        many = dealt.join(blocks, "shard").select("vec_id", "v", "shard", F.explode(F.sequence(F.lit(0), F.col("blocks").cast("int") - 1)).alias("block"))
        some = asked.join(blocks, "shard").withColumn("block", F.pmod(F.xxhash64("ask", F.lit(3)), F.col("blocks")).cast("int")).drop("blocks")
        return many.groupBy("shard", "block").cogroup(some.groupBy("shard", "block")).applyInArrow(_searcher(k, factor), FOUND)

    # a vector that several rows of an id have asks once
    asks = dealt.where(is_query).groupBy(F.col("vec_id").alias("query_id"), F.col("v").alias("q")).agg(F.min_by("shard", "row").alias("home"), F.min("row").alias("ask"))
    asks = durable(asks)
    own = durable(passed(asks.select("ask", "query_id", "q", F.lit(float("inf")).alias("kth"), F.col("home").alias("shard"))))
    kth = own.groupBy("ask").agg(F.when(F.count("*") >= k, F.max("score")).otherwise(float("inf")).alias("kth"))
    known = asks.join(kth, "ask", "left").withColumn("kth", F.coalesce("kth", F.lit(float("inf"))))
    reached = _reached(known, pivots, radius, factor)
    spread = reached.select("*", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part")).select("ask", "query_id", "q", "kth", shard_of(F.col("part")).alias("shard"))
    others = spread.join(asks.select("ask", "home"), "ask").where(F.col("shard") != F.col("home")).drop("home")
    found = own.unionByName(passed(durable(others)))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op13_vptree(vectors: DataFrame) -> DataFrame:
    return nearest(whole_vectors(vectors), F.pmod("vec_id", F.lit(STEP)) == 0)
