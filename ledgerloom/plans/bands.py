"""Joins whose condition has no equality but keeps one side's value within an interval of the other's.

Spark compares all rows with all there.  The optimised plan shows such a condition as comparisons of one side's expressions
with the other's: abs(x - y) <= t, or low <= y together with y <= high.  The join is then done by buckets: a row of the side
that has the point goes to its bucket, one of the side that has the interval to all that it touches, and the bucket is the
equality.  The whole condition is checked as before, so buckets only decide which rows meet."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.operators.joins import free_name, spread

#: A single interval touches at most about so many buckets.
MOST_BUCKETS = 100_000
INFINITY = float("inf")
#: Sides of which each row meets the join once at most, so that their rows can't be repeated over buckets.
KEPT_WHOLE = {"Inner": "", "LeftOuter": "left", "LeftSemi": "left", "LeftAnti": "left", "RightOuter": "right"}
HOW = {"Inner": "inner", "LeftOuter": "left_outer", "LeftSemi": "left_semi", "LeftAnti": "left_anti", "RightOuter": "right_outer"}


@dataclass(frozen=True)
class Band:
    """point_side: left or right; point lies on it, low and high on the other one."""

    point_side: str
    point: Column
    low: Column
    high: Column


@dataclass(frozen=True)
class JoinParts:
    """A join of an optimised plan: both inputs, its kind, the whole condition, equal expressions of the sides and bands."""

    left: DataFrame
    right: DataFrame
    kind: str
    condition: Column | None
    output: list[Column]
    equal: list[tuple[Column, Column]]
    bands: list[Band]


def _seq(items) -> list:
    return [items.apply(i) for i in range(items.size())]


def _name(node) -> str:
    return node.getClass().getSimpleName().rstrip("$")


def _implied(e) -> Iterator:
    """Conditions that hold wherever e does."""
    kind = _name(e)
    if kind == "And":
        yield from _implied(e.left())
        yield from _implied(e.right())
    elif kind == "CaseWhen" and e.elseValue().isDefined() and all(_name(b._2()) == "Literal" and b._2().value() in (None, False) for b in _seq(e.branches())):
        yield from _implied(e.elseValue().get())
    else:
        yield e


def _around(middle: Column, t: Column) -> tuple[Column, Column]:
    """Where abs(x - middle) <= t can hold, a little wider than doubles round; everywhere for a t that is infinite or NaN."""
    wide, slack = F.isnan(t) | (t == INFINITY), (F.abs(middle) + F.abs(t)) * 1e-12
    return F.when(wide, F.lit(-INFINITY)).otherwise(middle - t - slack), F.when(wide, F.lit(INFINITY)).otherwise(middle + t + slack)


def _plain(e):
    """abs(...) <= t may be wrapped in casts of the same number."""
    while _name(e) == "Cast" and _name(e.child()) == "Abs":
        e = e.child()
    return e


class _Reader:
    def __init__(self, df: DataFrame):
        self.session, self.jvm = df.sparkSession, df.sparkSession._jvm

    def frame(self, plan) -> DataFrame:
        from pyspark.sql.classic.dataframe import DataFrame as Classic

        return Classic(self.jvm.org.apache.spark.sql.classic.Dataset.ofRows(self.session._jsparkSession, plan), self.session)

    def column(self, e) -> Column:
        from pyspark.sql.classic.column import Column as Classic

        return Classic(self.jvm.org.apache.spark.sql.classic.ExpressionUtils.column(e))

    def parts(self, join) -> JoinParts:
        sides = {"left": join.left().outputSet(), "right": join.right().outputSet()}
        condition = join.condition().get() if join.condition().isDefined() else None

        def side(e) -> str | None:
            if e.references().isEmpty() or not e.deterministic():
                return None
            return next((s for s, out in sides.items() if e.references().subsetOf(out)), None)

        equal, bands, bounds = [], [], []
        for e in _implied(condition) if condition is not None else ():
            kind = _name(e)
            if kind in ("EqualTo", "EqualNullSafe"):
                a, b = e.left(), e.right()
                if {side(a), side(b)} == {"left", "right"}:
                    a, b = (a, b) if side(a) == "left" else (b, a)
                    equal.append((self.column(a), self.column(b)))
            elif kind in ("LessThan", "LessThanOrEqual", "GreaterThan", "GreaterThanOrEqual"):
                low, high = (e.left(), e.right()) if kind.startswith("Less") else (e.right(), e.left())
                inner = _plain(low)
                if _name(inner) == "Abs" and _name(inner.child()) == "Subtract":
                    x, y = inner.child().left(), inner.child().right()
                    near = side(high)
                    if {side(x), side(y)} == {"left", "right"} and (near is not None or high.foldable()):
                        for point, other in ((x, y), (y, x)):
                            if near in (None, side(other)):
                                bands.append(Band(side(point), self.column(point), *_around(self.column(other).cast("double"), self.column(high).cast("double"))))
                elif {side(low), side(high)} == {"left", "right"}:
                    bounds.append((low, high))
        for low, point in bounds:  # low <= point, and point <= high elsewhere
            for again, high in bounds:
                if again.semanticEquals(point) and side(low) == side(high):
                    bands.append(Band(side(point), self.column(point), self.column(low), self.column(high)))
        return JoinParts(
            self.frame(join.left()), self.frame(join.right()), _name(join.joinType()), self.column(condition) if condition is not None else None,
            [self.column(a) for a in _seq(join.output())], equal, bands)

    def rewritten(self, node):
        """The node with its joins bucketed, or None if nothing changes."""
        children = _seq(node.children())
        new = [self.rewritten(c) for c in children]
        if any(n is not None for n in new):
            node = node.withNewChildren(self.jvm.org.apache.spark.api.python.PythonUtils.toSeq([n if n is not None else c for n, c in zip(new, children, strict=True)]))
            changed = node
        else:
            changed = None
        if _name(node) == "Join" and _name(node.joinType()) in KEPT_WHOLE:
            parts = self.parts(node)
            joined = None if parts.equal else band_join(parts)
            if joined is not None:
                return joined._jdf.queryExecution().analyzed()
        return changed


def _number(df: DataFrame, c: Column) -> Column | None:
    """A value as a double in its own order, if it has one."""
    kind = df.select(c.alias("c")).schema[0].dataType
    if isinstance(kind, T.DateType):
        return F.unix_date(c).cast("double")
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(c).cast("double")
    if isinstance(kind, T.TimestampNTZType):
        return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), c).cast("double")
    return c.cast("double") if isinstance(kind, T.NumericType) else None


def sided(parts: JoinParts, band: Band) -> tuple[DataFrame, DataFrame, Column, Column, Column] | None:
    """Point side, interval side, and point, low and high as numbers of one order; None if they have none."""
    at, over = (parts.left, parts.right) if band.point_side == "left" else (parts.right, parts.left)
    point, low, high = _number(at, band.point), _number(over, band.low), _number(over, band.high)
    if point is None or low is None or high is None:
        return None
    kinds = {type(df.select(c.alias("c")).schema[0].dataType) for df, c in ((at, band.point), (over, band.low), (over, band.high))}
    if len(kinds) > 1 and not all(issubclass(k, T.NumericType) for k in kinds):
        return None  # days and microseconds, say
    return at, over, point, low, high


def band_join(parts: JoinParts) -> DataFrame | None:
    """The join by buckets of the first band that allows it; one pass over each side finds the buckets' width."""
    kept = KEPT_WHOLE[parts.kind]
    for band in parts.bands:
        if kept and band.point_side != kept:
            continue
        found = sided(parts, band)
        if found is None:
            continue
        at, over, point, low, high = found
        # NaN is above all numbers, as in Spark's order; cells are monotone, so what lies between two values lies between their cells
        point, low, high = (F.when(F.isnan(c), F.lit(INFINITY)).otherwise(c) for c in (point, low, high))
        finite = lambda c: F.abs(c) < F.lit(INFINITY)
        seen = at.where(finite(point)).agg(F.min(point), F.max(point), F.percentile_approx(F.abs(point), 0.5)).first()
        least, most, usual = (float(x or 0.0) for x in seen)
        first, last = F.greatest(low, F.lit(least)), F.least(high, F.lit(most))
        length = F.least(last - first, F.lit(1e308))
        mean, longest = (float(x or 0.0) for x in over.where(first <= last).agg(F.avg(length), F.max(length)).first())
        width = max(mean, longest / MOST_BUCKETS, usual * 2.0**-40, 1e-290)
        name = free_name("_band", parts.left, parts.right)
        cell = lambda c: F.when(finite(c), F.floor(c / F.lit(width))).when(c > 0, F.lit((1 << 63) - 1)).when(c < 0, F.lit(-(1 << 63)))
        ends = F.array_compact(F.array(F.when(low == -INFINITY, cell(low)), F.when(high == INFINITY, cell(high))))
        between = F.when(first <= last, F.sequence(cell(first), cell(last))).otherwise(F.array().cast("array<bigint>"))
        whole, dealt = at.withColumn(name, cell(point)), over.withColumn(name, F.explode(F.array_union(between, ends)))
        whole, dealt = spread(whole, name), spread(dealt, name)
        left, right = (whole, dealt) if band.point_side == "left" else (dealt, whole)
        return left.join(right, (left[name] == right[name]) & parts.condition, HOW[parts.kind]).select(*parts.output)
    return None


def bucketed(df: DataFrame) -> DataFrame:
    """df with every join of this kind done by buckets; df itself if there is none."""
    reader = _Reader(df)
    plan = reader.rewritten(df._jdf.queryExecution().optimizedPlan())
    return df if plan is None else reader.frame(plan)


def top_join(df: DataFrame) -> JoinParts | None:
    """The uppermost join of two inputs, if it is one."""
    reader, node = _Reader(df), df._jdf.queryExecution().optimizedPlan()
    while _name(node) != "Join":
        children = _seq(node.children())
        if len(children) != 1:
            return None
        node = children[0]
    return reader.parts(node)
