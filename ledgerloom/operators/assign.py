"""Matches as constraints: of all candidate pairs those that leave each key as many partners as a pattern allows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.session import durable

#: Rows for each block of positions from which on rows are cut into as many as shuffles have tasks, and the most that a block has on the average.
LEAST, MOST = 4096, 1 << 19
#: Types of record keys that are ordered in Arrow as in Spark.
ORDERED = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.DateType)


def enforce(pairs: DataFrame, pattern: str = "1:1") -> DataFrame:
    """pairs: left_key, right_key, cost.  The pairs that stay, each once.

    1:N: a right key stays with its best left key; M:1: a left key with its best right key.  1:1: what taking the pairs from
    the best on, each that leaves no key twice, would give.  The best is the least cost, then left key, then right key; a pair
    without a key or a cost is none."""
    best = pairs.where("left_key IS NOT NULL AND right_key IS NOT NULL AND cost IS NOT NULL").groupBy("left_key", "right_key").agg(F.min("cost").alias("cost"))
    if pattern == "1:N":
        return _best(best, "right_key", "left_key")
    if pattern == "M:1":
        return _best(best, "left_key", "right_key")
    if pattern != "1:1":
        raise ValueError(f"unknown pattern {pattern!r}")
    return _mutual(best)


def _best(pairs: DataFrame, of: str, other: str) -> DataFrame:
    """The best pair of each key, by an aggregate, so that a hot key is reduced before the shuffle."""
    return pairs.groupBy(of).agg(F.min(F.struct("cost", other)).alias("b")).select(*(F.col(of) if c == of else F.col(f"b.{c}").alias(c) for c in ("left_key", "right_key", "cost")))


def _mutual(pairs: DataFrame) -> DataFrame:
    """Rounds: pairs that are the best of both their keys stay, and all others of these keys go.  The best pair of all is one, so rounds end."""
    rest, kept = durable(pairs), None
    while not rest.isEmpty():
        one, two = _best(rest, "left_key", "right_key"), _best(rest, "right_key", "left_key")
        found = durable(one.join(two.select("left_key", "right_key"), ["left_key", "right_key"], "left_semi"))
        kept = found if kept is None else kept.unionByName(found)
        rest = durable(rest.join(found.select("left_key"), "left_key", "left_anti").join(found.select("right_key"), "right_key", "left_anti"))
    return pairs.limit(0) if kept is None else kept


def nearest_one_to_one(rows: DataFrame, keys: list[str], threshold: float, blocks: int | None = None) -> DataFrame:
    """What ``enforce`` would leave, 1:1, of all pairs of equal keys whose positions differ by at most the threshold; the pairs aren't made.

    rows: the keys, at (a finite double), and left_key or right_key, the other null; each of these once.  left_key, right_key, cost.
    Rows are cut into blocks of position.  A pair is settled where both are the best of each other in their block and neither
    is as near to its edge, beyond which a better one might stand.  What is open goes to the next round, whose edges lie in the
    middle between those before; if less than half of a side's rows are settled, blocks are twice as large.  One block has no
    edge, so that rounds end.  Rows of one key and position are in one task."""
    width = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rest, kept, before, turn = durable(rows.withColumn("cost", F.lit(None).cast("double"))), None, None, 0
    while True:
        l, r = rest.agg(F.count("left_key"), F.count("right_key")).first()  # noqa: E741
        if not l or not r:
            return rest.select("left_key", "right_key", "cost").limit(0) if kept is None else kept
        if before is None:
            blocks = blocks or max(min(width, (l + r) // LEAST), (l + r) // MOST, 1)
        elif 2 * min(l, r) > before:
            blocks = max(blocks // 2, 1)
        else:
            blocks = max(min(blocks, max((l + r) // LEAST, (l + r) // MOST)), 1)
        before = min(l, r)
        shares = [(i + turn % 2 / 2) / blocks for i in range(1 - turn % 2, blocks)] if blocks > 1 else []
        bounds = sorted(set(rest.agg(F.percentile_approx("at", F.array(*map(F.lit, shares)), 10 * max(blocks, 100))).first()[0])) if shares else []
        block = sum((F.when(F.col("at") > b, 1).otherwise(0) for b in bounds), F.lit(0))
        settled = durable(rest.withColumn("block", block).groupBy(*keys, "block").applyInArrow(_settled(bounds, threshold, rest.columns), rest.schema))
        found = settled.where("cost IS NOT NULL").select("left_key", "right_key", "cost")
        kept = found if kept is None else kept.unionByName(found)
        rest, turn = settled.where("cost IS NULL"), turn + 1


def _settled(bounds: list[float], threshold: float, columns: list[str]):
    """Rows of one block: those matched as pairs with a cost, and those still open as they are."""

    def run(t: pa.Table) -> pa.Table:
        k = t["block"][0].as_py()
        lo, hi = bounds[k - 1] if k else -np.inf, np.nextafter(bounds[k], np.inf) if k < len(bounds) else np.inf
        own = t.select(columns).combine_chunks()
        at, right = own["at"].to_numpy(), own["left_key"].is_null().to_numpy()
        rank = np.empty(len(at), np.int64)
        for name in ("left_key", "right_key"):
            rank[pc.sort_indices(own[name]).to_numpy()[: len(at) - own[name].null_count]] = np.arange(len(at) - own[name].null_count)
        pairs, still = settle(at, rank, right, lo, hi, threshold)
        one, two = pairs[:, 0], pairs[:, 1]
        matched = own.take(one).set_column(columns.index("right_key"), own.schema.field("right_key"), own["right_key"].take(pa.array(two)))
        matched = matched.set_column(columns.index("cost"), own.schema.field("cost"), pa.chunked_array([pa.array(np.abs(at[one] - at[two]), pa.float64())]))
        return pa.concat_tables([matched, own.filter(pa.array(still))])

    return run


def settle(at: np.ndarray, rank: np.ndarray, right: np.ndarray, lo: float, hi: float, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows (left, right) that are the best of each other whatever stands at lo, hi or beyond, and a mask of the rows still open.

    From each right group of equal positions the chain of best partners is followed until two are the best of each other, or one
    is as near to an edge: it and all that lead to it stay open."""
    order, v, head, end, after, before = [], [], [], [], [], []
    for side in (False, True):
        o = np.flatnonzero(right == side)
        o = o[np.lexsort((rank[o], at[o]))]
        first = np.flatnonzero(np.r_[True, at[o][1:] != at[o][:-1]]) if len(o) else np.zeros(0, np.int64)
        order.append(o)
        v.append(at[o][first])
        head.append(first.tolist())
        end.append([*first[1:].tolist(), len(o)] if len(o) else [])
        after.append(list(range(len(first) + 1)))  # the first group from here on that has rows
        before.append(list(range(len(first) + 1)))  # one more than the last group before here that has
    near = [np.searchsorted(v[1], v[0]).tolist(), np.searchsorted(v[0], v[1]).tolist()]
    ranks = [rank[o].tolist() for o in order]
    v = [x.tolist() for x in v]
    open_ = [[False] * len(x) for x in v]

    def to(links, i):
        while links[i] != i:
            links[i] = links[links[i]]
            i = links[i]
        return i

    def best(s, i):
        """The group of the best partner, or None, and its cost."""
        x, other, o = v[s][i], v[1 - s], 1 - s
        up, down = to(after[o], near[s][i]), to(before[o], near[s][i])
        cost = min(abs(other[up] - x) if up < len(other) else np.inf, abs(other[down - 1] - x) if down else np.inf)
        if not cost <= threshold:
            return None, np.inf
        found = None
        while up < len(other) and abs(other[up] - x) == cost:  # positions apart may be as near once rounded
            if found is None or ranks[o][head[o][up]] < ranks[o][head[o][found]]:
                found = up
            up = to(after[o], up + 1)
        while down and abs(other[down - 1] - x) == cost:
            if found is None or ranks[o][head[o][down - 1]] < ranks[o][head[o][found]]:
                found = down - 1
            down = to(before[o], down - 1)
        return found, cost

    def drop(s, i):
        after[s][i] = i + 1
        before[s][i + 1] = i

    pairs = []
    for i in range(len(v[1])):
        while head[1][i] < end[1][i] and not open_[1][i]:
            path, alone = [(1, i)], False
            while path and not alone:
                s, j = path[-1]
                found, cost = best(s, j)
                edge = min(v[s][j] - lo, hi - v[s][j])
                if edge <= min(cost, threshold) or found is not None and open_[1 - s][found]:
                    for a, b in path:
                        open_[a][b] = True
                    break
                if found is None:
                    alone = True  # only the path's start can be: the others have the one before
                elif len(path) > 1 and path[-2] == (1 - s, found):
                    l, r = (j, found) if s == 0 else (found, j)  # noqa: E741
                    pairs.append((order[0][head[0][l]], order[1][head[1][r]]))
                    for a, b in ((0, l), (1, r)):
                        head[a][b] += 1
                        if head[a][b] == end[a][b]:
                            drop(a, b)
                    del path[-2:]
                else:
                    path.append((1 - s, found))
            if alone:
                head[1][i] = end[1][i]
                drop(1, i)
    still = np.zeros(len(at), bool)
    for j in range(len(v[1])):
        still[order[1][head[1][j] : end[1][j]]] = True
    # left rows are open if a right one that is open, or the edge, is within the threshold
    waiting = np.array([x for x, h, e in zip(v[1], head[1], end[1], strict=True) if h < e], float)
    x = at[order[0]]
    taken = np.array(pairs, np.int64).reshape(-1, 2)
    reach = np.minimum(x - lo, hi - x) <= threshold
    if len(waiting):
        place = np.searchsorted(waiting, x)
        reach |= np.abs(waiting[np.minimum(place, len(waiting) - 1)] - x) <= threshold
        reach |= np.abs(waiting[np.maximum(place - 1, 0)] - x) <= threshold
    still[order[0][reach]] = True
    still[taken[:, 0]] = False
    return taken, still
