"""Matching joins.  All are declarative joins for Catalyst; the two without an equality get one by bucketing."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.functions import tolerance_match
from ledgerloom.sources.ranges import KeyRanges


def execute_join(left: DataFrame, right: DataFrame, condition: str | Column) -> DataFrame:
    """Inner join on any condition over the aliases l and r; columns of both sides are kept, equal names too."""
    on = F.expr(condition) if isinstance(condition, str) else condition
    return left.alias("l").join(right.alias("r"), on, "inner")


def free_name(name: str, *frames: DataFrame) -> str:
    """A name that no column of these frames has, in any case."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def spread(df: DataFrame, *keys: str | Column) -> DataFrame:
    """Rows dealt by the keys to as many tasks as shuffles have, which AQE leaves as many: small inputs whose join makes many rows would come together in a few."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def _pairs(keys) -> list[str]:
    return [keys] if isinstance(keys, str) else list(keys)


def left_orphans(left: DataFrame, right: DataFrame, left_key, right_key) -> DataFrame:
    """Left rows without a right row of equal key; a null key has none."""
    on = reduce(Column.__and__, (F.col(f"l.{a}") == F.col(f"r.{b}") for a, b in zip(_pairs(left_key), _pairs(right_key), strict=True)))
    return left.alias("l").join(right.select(*_pairs(right_key)).alias("r"), on, "left_anti")


def right_orphans(left: DataFrame, right: DataFrame, left_key, right_key) -> DataFrame:
    return left_orphans(right, left, right_key, left_key)


def crowded_join(left: DataFrame, right: DataFrame, keys: list[tuple[str, str]], condition: Column, slices: int | None = None) -> DataFrame:
    """execute_join where few equal keys have many rows: a left row goes to one slice of its key, a right row to all, so that a key's pairs are made by many tasks."""
    n = slices or int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    name = free_name("_slice", left, right)
    l = left.withColumn(name, F.pmod(F.xxhash64(*(F.col(f"`{f.name}`") for f in left.schema.fields if plain(f.dataType))), F.lit(n)).cast("int"))  # noqa: E741
    r = right.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    l, r = spread(l, name, *(f"`{a}`" for a, _ in keys)), spread(r, name, *(f"`{b}`" for _, b in keys))  # noqa: E741
    return l.alias("l").join(r.alias("r"), (F.col(f"l.{name}") == F.col(f"r.{name}")) & condition).drop(name)


def unmatched(left: DataFrame, right: DataFrame, condition: str | Column) -> DataFrame:
    """Left rows for which no right row meets the whole condition over l and r.

    The condition needs an equality, or Spark compares all rows with all; without one, take ``unmatched_of`` of a bucketed join."""
    return left.alias("l").join(right.alias("r"), F.expr(condition) if isinstance(condition, str) else condition, "left_anti")


def comparable(column: Column, kind: T.DataType) -> Column:
    """A value that is equal where the column is, also for maps, which have no equality of their own."""
    if isinstance(kind, T.MapType):
        key, value = (lambda e: comparable(e["key"], kind.keyType)), (lambda e: comparable(e["value"], kind.valueType))
        return F.sort_array(F.transform(F.map_entries(column), lambda e: F.struct(key(e).alias("key"), value(e).alias("value"))))
    if isinstance(kind, T.ArrayType) and not plain(kind):
        return F.transform(column, lambda e: comparable(e, kind.elementType))
    if isinstance(kind, T.StructType) and not plain(kind):
        return F.when(column.isNotNull(), F.struct(*(comparable(column[f.name], f.dataType).alias(f"c{i}") for i, f in enumerate(kind.fields))))
    return column


def plain(kind: T.DataType) -> bool:
    """Whether Spark can compare values of this type."""
    if isinstance(kind, (T.MapType, T.VariantType)):
        return False
    if isinstance(kind, T.ArrayType):
        return plain(kind.elementType)
    return all(plain(f.dataType) for f in kind.fields) if isinstance(kind, T.StructType) else True


def unmatched_of(left: DataFrame, matched: DataFrame) -> DataFrame:
    """Left rows that are not among the rows, or the l side of the rows, of a join; equal rows count as one, nulls and equal maps as equal."""
    names = [f"_c{i}" for i in range(len(left.columns))]
    cells = [comparable(F.col(f"l.`{f.name}`"), f.dataType).alias(n) for f, n in zip(left.schema.fields, names, strict=True)]
    sides = matched.select(*cells).distinct().alias("m")
    on = reduce(Column.__and__, (comparable(F.col(f"l.`{f.name}`"), f.dataType).eqNullSafe(F.col(f"m.{n}")) for f, n in zip(left.schema.fields, names, strict=True)))
    return left.alias("l").join(sides, on, "left_anti")


def order_join(left: DataFrame, right: DataFrame, left_value: str, right_value: str, op: str, extra: Column | None = None, blocks: int | None = None) -> DataFrame:
    """Pairs of which the left value is gt, gte, lt or lte the right one, and no equal key.

    Both sides are cut into blocks by the right side's quantiles.  A left block meets the right blocks on its side of it, so
    that a pair of blocks is an equality; the condition is checked on the pairs, which decides only within equal blocks.  A
    row is repeated for as many blocks as it meets; the pairs themselves are as many as there are."""
    low, high = (right_value, left_value) if op in ("gt", "gte") else (left_value, right_value)
    order = {"gt": Column.__gt__, "lt": Column.__lt__, "gte": Column.__ge__, "lte": Column.__le__}[op]
    on = order(F.col(f"l.`{left_value}`"), F.col(f"r.`{right_value}`"))
    on = on if extra is None else on & extra
    n = blocks or int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    known = right.where(F.col(f"`{right_value}`").isNotNull())
    cuts = known.agg(F.percentile_approx(F.col(f"`{right_value}`"), F.array(*(F.lit(i / n) for i in range(1, n))), 1000)).first()[0] if n > 1 else None
    cuts = sorted({c for c in cuts or () if c == c})
    mine, met = free_name("_left_block", left, right), free_name("_right_block", left, right)
    block = lambda c: sum((F.when(F.col(f"`{c}`") > F.lit(cut), 1).otherwise(0) for cut in cuts), F.lit(0))
    zero, last = F.lit(0), F.lit(len(cuts))
    below = lambda c: F.explode(F.sequence(zero, block(c)))
    above = lambda c: F.explode(F.sequence(block(c), last))
    left_is_high = high == left_value
    l = left.where(F.col(f"`{left_value}`").isNotNull()).withColumn(mine, block(left_value)).withColumn(met, below(left_value) if left_is_high else above(left_value))  # noqa: E741
    r = known.withColumn(met, block(right_value)).withColumn(mine, above(right_value) if left_is_high else below(right_value))
    l, r = spread(l, mine, met), spread(r, mine, met)  # noqa: E741
    joined = l.alias("l").join(r.alias("r"), (F.col(f"l.{mine}") == F.col(f"r.{mine}")) & (F.col(f"l.{met}") == F.col(f"r.{met}")) & on)
    return joined.drop(mine, met)


def without_order(left: DataFrame, right: DataFrame, left_value: str, right_value: str, op: str, keys: list[tuple[str, str]] = ()) -> DataFrame:
    """Left rows that no right row of equal keys is ordered to as ``op`` says: the extreme right value decides, one a group."""
    order = {"gt": Column.__gt__, "lt": Column.__lt__, "gte": Column.__ge__, "lte": Column.__le__}[op]
    least = op in ("gt", "gte")
    name = free_name("_extreme", left, right)
    names = [free_name(f"_key{i}", left, right) for i in range(len(keys))]
    value = F.col(f"`{right_value}`")
    extreme = right.where(value.isNotNull()).groupBy(*(F.col(f"`{b}`").alias(n) for (_, b), n in zip(keys, names, strict=True))).agg((F.min if least else F.max)(value).alias(name))
    if keys:
        met = left.join(extreme, reduce(Column.__and__, (F.col(f"`{a}`") == F.col(n) for (a, _), n in zip(keys, names, strict=True))), "left")
    else:
        met = left.crossJoin(F.broadcast(extreme))  # one row
    return met.where(~F.coalesce(order(F.col(f"`{left_value}`"), F.col(name)), F.lit(False))).select(*(F.col(f"`{c}`") for c in left.columns))


def range_join(left: DataFrame, right: DataFrame, condition: str | Column, ranges: KeyRanges, i: int, left_key: str | None = None, right_key: str | None = None) -> DataFrame:
    """The i-th part of execute_join: key ranges over one side's key, or both sides' where both have it.

    The union over all i is execute_join, null keys and values beyond the ends included."""
    left = left.where(ranges.of(F.col(left_key or ranges.key), i)) if left_key or right_key is None else left
    right = right.where(ranges.of(F.col(right_key), i)) if right_key else right
    return execute_join(left, right, condition)


def tolerance_join(left: DataFrame, right: DataFrame, left_value: str, right_value: str, threshold: float, extra: Column | None = None, keys: list[tuple[str, str]] = ()) -> DataFrame:
    """Pairs with abs(l.value - r.value) <= threshold; keys: columns that extra asks to be equal, by which rows are dealt too.

    Values are bucketed in steps of twice the threshold; a right row is sent to its bucket and both neighbours, so that
    an equality join finds all pairs, each once.  Buckets are doubles, as a large value over a small step is no long; from
    2**53 on a bucket is a single value, and so are its neighbours, which count once.  A threshold of 0 is equality; a negative or NaN one finds nothing."""
    if not threshold >= 0:
        return execute_join(left.limit(0), right.limit(0), F.lit(True))
    l, r = F.col(f"l.{left_value}").cast("double"), F.col(f"r.{right_value}").cast("double")  # noqa: E741
    if threshold == float("inf"):
        raise ValueError("an infinite threshold matches everything")
    on = tolerance_match(l, r, threshold) if extra is None else tolerance_match(l, r, threshold) & extra
    if threshold == 0:
        return execute_join(left, right, (l == r) & on)
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
    step, name = max(2.0 * threshold, 5e-324), free_name("_bucket", left, right)
    whole = lambda q: F.when(F.abs(q) < F.lit(2.0**53), F.floor(q).cast("double")).otherwise(q)
    bucket = lambda c: whole(F.least(F.greatest(c / F.lit(step), F.lit(-1.7e308)), F.lit(1.7e308)))
    lv, rv = F.col(left_value).cast("double"), F.col(right_value).cast("double")
    dealt_left = left.where(finite(lv)).withColumn(name, bucket(lv))
    dealt_right = right.where(finite(rv)).withColumn(name, F.explode(F.array_distinct(F.array(*(bucket(rv) + float(d) for d in (-1, 0, 1))))))
    dealt_left, dealt_right = spread(dealt_left, name, *(f"`{a}`" for a, _ in keys)), spread(dealt_right, name, *(f"`{b}`" for _, b in keys))
    return dealt_left.alias("l").join(dealt_right.alias("r"), (F.col(f"l.{name}") == F.col(f"r.{name}")) & on).drop(name)


def window_join(left: DataFrame, right: DataFrame, left_date: str, right_date: str, days_before: int, days_after: int, extra: Column | None = None) -> DataFrame:
    """Pairs with r.date between l.date - days_before and l.date + days_after, bucketed by the width of the window."""
    width = days_before + days_after + 1
    if width < 1:
        return execute_join(left.limit(0), right.limit(0), F.lit(True))
    name = free_name("_bucket", left, right)
    day = lambda c: F.unix_date(c.cast("date"))
    l, r = F.col(f"l.{left_date}"), F.col(f"r.{right_date}")  # noqa: E741
    on = r.between(l - F.expr(f"INTERVAL '{days_before}' DAY"), l + F.expr(f"INTERVAL '{days_after}' DAY"))
    first = F.floor((day(F.col(left_date)) - days_before) / F.lit(width))
    last = F.floor((day(F.col(left_date)) + days_after + 1) / F.lit(width))
    dealt_left = left.where(F.col(left_date).isNotNull()).withColumn(name, F.explode(F.sequence(first, last)))
    dealt_right = right.where(F.col(right_date).isNotNull()).withColumn(name, F.floor(day(F.col(right_date)) / F.lit(width)))
    both = (F.col(f"l.{name}") == F.col(f"r.{name}")) & on
    return dealt_left.alias("l").join(dealt_right.alias("r"), both if extra is None else both & extra).drop(name)


def best_candidate(pairs: DataFrame, key: list[str], cost: Column, ties: list[str]) -> DataFrame:
    """The pair of least cost for each key; ties by the given columns."""
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(cost.asc_nulls_last(), *ties))
    name = free_name("_rank", pairs)
    return pairs.withColumn(name, rank).where(F.col(name) == 1).drop(name)


def batches(df: DataFrame) -> Iterator:
    """The rows of a result one partition at a time, so that the driver holds one partition at most."""
    return df.toLocalIterator(prefetchPartitions=True)
