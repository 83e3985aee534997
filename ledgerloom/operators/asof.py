"""As-of and nearest joins: for each left row the right row of equal keys whose position is the last before, the first after, or the nearest.

Both sides are put together and cut into buckets of position by quantiles of all rows, so that a key, however many rows it
has, is spread over the buckets.  Within a key's bucket a window carries the last (first) right row over; what a bucket
hands to the next ones is one row for each key and bucket, and a window over those fills the buckets' edges.  Only
the distinct keys and positions of the left side take part; the left rows then join what was found for theirs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.operators.joins import free_name

DIRECTIONS = ("backward", "forward", "nearest")
#: Share of a quantile's rank that the bucket bounds may be off by.
ACCURACY = 1000


def position(df: DataFrame, column: str) -> Column:
    """A date as days, a timestamp as microseconds, a number as it is; NaN and infinities are no positions."""
    kind, c = df.schema[column].dataType, F.col(f"`{column}`")
    if isinstance(kind, T.DateType):
        return F.unix_date(c).cast("long")
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(c)
    if isinstance(kind, T.TimestampNTZType):
        return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), c)
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return F.when(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), c.cast("double"))
    if isinstance(kind, T.NumericType):
        return c
    raise ValueError(f"{column!r} is {kind.simpleString()}, which has no order in time")


def join_asof(
    left: DataFrame, right: DataFrame, left_on: str, right_on: str, by: Sequence[str | tuple[str, str]] = (), direction: str = "backward",
    tolerance: float | None = None, exact: bool = True, ties: Sequence[str] = (), how: str = "left", suffix: str = "_right", buckets: int | None = None,
) -> DataFrame:
    """Left columns, and those of the right row found (with the suffix where names clash).

    by: key columns, or pairs of them; a null key or position has no partner.  tolerance: the most that positions may differ,
    in days for dates and microseconds for timestamps.  exact: whether an equal position counts.  Of right rows of one key
    and position the least by ``ties`` is taken, then by all other columns that have an order; of two as near, the one before."""
    if direction not in DIRECTIONS:
        raise ValueError(f"direction is one of {', '.join(DIRECTIONS)}")
    if how not in ("left", "inner"):
        raise ValueError("how is left or inner")
    pairs = [(b, b) if isinstance(b, str) else tuple(b) for b in by]
    name = lambda n: free_name(n, left, right)
    keys, at, payload, side, bucket = [name(f"_by{i}") for i in range(len(pairs))], name("_at"), name("_row"), name("_side"), name("_bucket")
    mixed = _mixed(left, left_on, right, right_on)
    number = lambda df, c: position(df, c).cast("double") if mixed else position(df, c)

    def dealt(df: DataFrame, columns: list[str], on: str) -> DataFrame:
        own = df.withColumns({k: F.col(f"`{c}`") for k, c in zip(keys, columns, strict=True)} | {at: number(df, on)})
        return own.where(_known([at, *keys]))

    ordered = [f.name for f in right.schema.fields if _orderable(f.dataType)]
    tie = F.struct(*(F.col(f"`{c}`") for c in [*ties, *(c for c in ordered if c not in ties)])) if ordered or ties else F.lit(0)
    whole = F.struct(*(F.col(f"`{c}`") for c in right.columns))
    r = dealt(right, [b for _, b in pairs], right_on).groupBy(*keys, at).agg(F.min_by(whole, tie).alias(payload))
    l = dealt(left, [a for a, _ in pairs], left_on).select(*keys, at).distinct()  # noqa: E741
    both = r.withColumn(side, F.lit(0)).unionByName(l.withColumn(side, F.lit(1)), allowMissingColumns=True)
    n = buckets or int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bounds = _bounds(both, at, n)
    both = both.withColumn(bucket, sum((F.when(F.col(at) > b, 1).otherwise(0) for b in bounds), F.lit(0)))
    found = {}
    here = both
    for way in ("backward", "forward") if direction == "nearest" else (direction,):
        here, column = _carried(here, keys, at, payload, side, bucket, way, exact, name(f"_{way}"))
        found[way] = column
    asked = here.where(F.col(side) == 1)
    gap = lambda c: F.abs(F.col(f"{c}.{at}").cast("double") - F.col(at).cast("double"))
    if direction == "nearest":
        one, two = found["backward"], found["forward"]
        best = F.when(F.col(one).isNull() | (gap(two) < gap(one)), F.col(two)).otherwise(F.col(one))
    else:
        best = F.col(found[direction])
    hit, mine = name("_hit"), [name(f"_key{i}") for i in range(len(keys) + 1)]
    met = asked.select(*keys, at, best.alias(hit)).where(F.col(hit).isNotNull())
    if tolerance is not None:
        met = met.where(gap(hit) <= F.lit(float(tolerance)))
    met = met.select(*(F.col(k).alias(m) for k, m in zip([*keys, at], mine, strict=True)), F.col(f"{hit}.{payload}").alias(payload))
    own = left.withColumns({k: F.col(f"`{a}`") for k, (a, _) in zip(keys, pairs, strict=True)} | {at: number(left, left_on)})
    on = [own[k] == met[m] for k, m in zip([*keys, at], mine, strict=True)]
    taken = {c.lower() for c in left.columns}
    out = [F.col(f"{payload}.`{c}`").alias(c + suffix if c.lower() in taken else c) for c in right.columns]
    return own.join(met, on, how).select(*(F.col(f"`{c}`") for c in left.columns), *out)


def _mixed(left: DataFrame, a: str, right: DataFrame, b: str) -> bool:
    one, two = left.schema[a].dataType, right.schema[b].dataType
    if isinstance(one, T.NumericType) and isinstance(two, T.NumericType):
        return type(one) is not type(two)
    if type(one) is not type(two):
        raise ValueError(f"{a!r} and {b!r} are {one.simpleString()} and {two.simpleString()}: no common order")
    return False


def _known(columns: list[str]) -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & F.col(c).isNotNull()
    return out


def _orderable(kind: T.DataType) -> bool:
    if isinstance(kind, (T.MapType, T.VariantType)):
        return False
    if isinstance(kind, T.ArrayType):
        return _orderable(kind.elementType)
    return all(_orderable(f.dataType) for f in kind.fields) if isinstance(kind, T.StructType) else True


def _bounds(rows: DataFrame, at: str, n: int) -> list:
    """At most n - 1 rising positions that cut the rows evenly; the driver gets these only."""
    if n < 2:
        return []
    found = rows.agg(F.percentile_approx(F.col(at), F.array(*(F.lit(i / n) for i in range(1, n))), ACCURACY)).first()[0]
    return sorted(set(found or ()))


def _carried(rows: DataFrame, keys: list[str], at: str, payload: str, side: str, bucket: str, way: str, exact: bool, out: str) -> tuple[DataFrame, str]:
    """rows with the right row (at, payload) that lies last before, or first after, each of them."""
    back = way == "backward"
    mark = F.when(F.col(side) == 0, F.struct(at, payload))
    # at equal positions right rows go first if they count, in either direction
    order = [F.asc(at) if back else F.desc(at), F.asc(side) if exact else F.desc(side)]
    near = Window.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    edge = F.max_by if back else F.min_by
    handed = rows.groupBy(*keys, bucket).agg(edge(mark, F.when(F.col(side) == 0, F.col(at))).alias("_handed"))
    along = Window.partitionBy(*keys).orderBy(F.asc(bucket) if back else F.desc(bucket)).rowsBetween(Window.unboundedPreceding, -1)
    given = handed.withColumn("_given", F.last("_handed", ignorenulls=True).over(along)).drop("_handed")
    names = {k: f"_given_{i}" for i, k in enumerate([*keys, bucket])}
    given = given.withColumnsRenamed(names)
    inside = rows.withColumn(out, F.last(mark, ignorenulls=True).over(near))
    met = inside.join(given, [inside[k] == given[g] for k, g in names.items()], "left")
    return met.withColumn(out, F.coalesce(out, "_given")).drop("_given", *names.values()), out


def nearest_in_groups(asked: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """asked and other: record_key, value (a double) and the keys.  asked's record_key, and as best the gap, value and record_key of the other row nearest to it.

    One shuffle of both sides: a task holds whole groups, which must be small; ``join_asof`` takes groups of any size.  Of equal
    values the least record_key counts, of two as near the one before."""
    known = lambda df: df.withColumn("value", position(df, "value")).where(_known(["value", *keys]))
    both = known(asked).withColumn("side", F.lit(1)).unionByName(known(other).withColumn("side", F.lit(0)))
    mark = F.when(F.col("side") == 0, F.struct("value", "record_key"))
    last = lambda order: F.last(mark, ignorenulls=True).over(Window.partitionBy(*keys).orderBy(order, "side", F.desc("record_key")).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    met = both.withColumn("before", last(F.asc("value"))).withColumn("after", last(F.desc("value"))).where("side = 1")
    gap = lambda c: F.abs(F.col(f"{c}.value") - F.col("value"))
    best = F.when(F.col("before").isNull() | (gap("after") < gap("before")), F.col("after")).otherwise(F.col("before"))
    met = met.select("record_key", "value", best.alias("b")).where("b IS NOT NULL")
    return met.select("record_key", F.struct(F.abs(F.col("b.value") - F.col("value")).alias("gap"), "b.value", "b.record_key").alias("best"))
