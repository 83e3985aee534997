"""Rules of column comparisons as join conditions."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.functions import tolerance_match
from ledgerloom.operators.assign import ORDERED, enforce, nearest_one_to_one
from ledgerloom.operators.asof import join_asof
from ledgerloom.operators.joins import execute_join, free_name, order_join, tolerance_join, unmatched_of, without_order

PATTERNS = ("1:1", "1:N", "M:1")


@dataclass(frozen=True)
class Condition:
    """op: eq, tolerance (with a threshold), gt, lt, gte, lte, contains, startswith, endswith."""

    left: str
    op: str
    right: str
    threshold: float | None = None

    def column(self) -> Column:
        """Over the aliases l and r."""
        a, b = F.col(f"l.{self.left}"), F.col(f"r.{self.right}")
        if self.op == "tolerance":
            if self.threshold is None:
                raise ValueError("a tolerance needs a threshold")
            return tolerance_match(a, b, self.threshold)
        text = {"contains": Column.contains, "startswith": Column.startswith, "endswith": Column.endswith}
        if self.op in text:
            return text[self.op](a.cast("string"), b.cast("string"))
        order = {"eq": Column.__eq__, "gt": Column.__gt__, "lt": Column.__lt__, "gte": Column.__ge__, "lte": Column.__le__}
        if self.op not in order:
            raise ValueError(f"unknown operator {self.op!r}")
        return order[self.op](a, b)


@dataclass(frozen=True)
class Rule:
    name: str
    conditions: tuple[Condition, ...]
    pattern: str = "1:1"
    priority: int = 0

    @classmethod
    def from_dict(cls, d: dict) -> Rule:
        if d.get("pattern", "1:1") not in PATTERNS:
            raise ValueError(f"unknown pattern {d['pattern']!r}")
        return cls(d["name"], tuple(Condition(c["left"], c["op"], c["right"], c.get("threshold")) for c in d["conditions"]), d.get("pattern", "1:1"), d.get("priority", 0))

    def column(self) -> Column:
        return reduce(Column.__and__, (c.column() for c in self.conditions))


ORDERS = ("gt", "lt", "gte", "lte")


def match_rule(left: DataFrame, right: DataFrame, rule: Rule) -> DataFrame:
    """Pairs that meet all conditions; a rule without an equality, or whose equal keys are few, is bucketed by its first tolerance; one without an equality is else cut into blocks by its first order."""
    equal, near = [c for c in rule.conditions if c.op == "eq"], [c for c in rule.conditions if c.op == "tolerance"]
    if equal and near and _few_keys(right, [c.right for c in equal]):
        return tolerance_join(left, right, near[0].left, near[0].right, near[0].threshold, rule.column(), [(c.left, c.right) for c in equal])
    if not equal:
        for c in rule.conditions:
            if c.op == "tolerance":
                return tolerance_join(left, right, c.left, c.right, c.threshold, rule.column())
        for c in rule.conditions:
            if c.op in ORDERS and _cut_by_quantiles(right, c.right):
                return order_join(left, right, c.left, c.right, c.op, rule.column())
    return execute_join(left, right, rule.column())


#: Rows a key has on the average from which on equal keys alone make too many pairs.
MANY = 16


def _few_keys(df: DataFrame, columns: list[str]) -> bool:
    keys, rows = df.agg(F.approx_count_distinct(F.xxhash64(*(F.col(f"`{c}`") for c in columns))), F.count("*")).first()
    return rows >= MANY * keys


def _cut_by_quantiles(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType))


def unmatched_rule(left: DataFrame, right: DataFrame, rule: Rule) -> DataFrame:
    """Left rows that meet the rule with no right row.

    Equalities and one order need no pairs: the extreme right value of each group tells.  Else by the rule's own join."""
    orders, equal = [c for c in rule.conditions if c.op in ORDERS], [c for c in rule.conditions if c.op == "eq"]
    if len(orders) == 1 and len(orders) + len(equal) == len(rule.conditions):
        return without_order(left, right, orders[0].left, orders[0].right, orders[0].op, [(c.left, c.right) for c in equal])
    return unmatched_of(left, match_rule(left, right, rule))


def match_pattern(left: DataFrame, right: DataFrame, rule: Rule, left_key: str, right_key: str) -> DataFrame:
    """left_key, right_key, cost of the rule's pairs, of which as many stay as its pattern allows: the nearest by the sum of what tolerances leave."""
    equal, near = [c for c in rule.conditions if c.op == "eq"], [c for c in rule.conditions if c.op == "tolerance"]
    if rule.pattern in ("1:N", "M:1") and len(near) == 1 and len(equal) + 1 == len(rule.conditions):
        return _nearest(left, right, rule, equal, near[0], left_key, right_key)
    if rule.pattern == "1:1" and len(near) == 1 and len(equal) + 1 == len(rule.conditions) and _settles(left, right, equal, near[0], left_key, right_key):
        sides = ((left, left_key, near[0].left, [c.left for c in equal]), (right, right_key, near[0].right, [c.right for c in equal]))
        l, r = (_side(*side).where(_finite("at")).withColumnRenamed("own", name) for side, name in zip(sides, ("left_key", "right_key"), strict=True))  # noqa: E741
        # keys that have several rows are left to pairs
        if all(df.groupBy(k).count().where("count > 1").isEmpty() for df, k in ((l, "left_key"), (r, "right_key"))):
            return nearest_one_to_one(l.unionByName(r, allowMissingColumns=True), [f"equal_{i}" for i in range(len(equal))], near[0].threshold)
    off = [F.abs(F.col(f"l.`{c.left}`").cast("double") - F.col(f"r.`{c.right}`").cast("double")) for c in rule.conditions if c.op == "tolerance"]
    cost = reduce(Column.__add__, off) if off else F.lit(0.0)
    pairs = match_rule(left, right, rule).select(F.col(f"l.`{left_key}`").alias("left_key"), F.col(f"r.`{right_key}`").alias("right_key"), cost.alias("cost"))
    return enforce(pairs, rule.pattern)


def _side(df: DataFrame, key: str, at: str, on: list[str]) -> DataFrame:
    """own, at and equal_0, equal_1, ... of the rows that can have a partner."""
    shared = [f"equal_{i}" for i in range(len(on))]
    own = df.select(F.col(f"`{key}`").alias("own"), F.col(f"`{at}`").cast("double").alias("at"), *(F.col(f"`{c}`").alias(n) for c, n in zip(on, shared, strict=True)))
    return own.where(reduce(Column.__and__, (F.col(c).isNotNull() for c in own.columns)))


def _finite(column: str) -> Column:
    return F.abs(column) < F.lit(float("inf"))


def _settles(left: DataFrame, right: DataFrame, equal: list[Condition], near: Condition, left_key: str, right_key: str) -> bool:
    """Whether 1:1 can be settled by position, without pairs: what must be equal is of one type, and the keys' order is known."""
    kind = lambda df, c: df.schema[c].dataType
    ordered = all(isinstance(kind(df, k), ORDERED) or kind(df, k) == T.StringType() for df, k in ((left, left_key), (right, right_key)))
    same = all(kind(left, c.left) == kind(right, c.right) and isinstance(kind(left, c.left), T.AtomicType) for c in equal)
    return ordered and same and near.threshold is not None and 0 <= near.threshold < float("inf")


def _nearest(left: DataFrame, right: DataFrame, rule: Rule, equal: list[Condition], near: Condition, left_key: str, right_key: str) -> DataFrame:
    """The patterns 1:N and M:1 of a rule of equalities and one tolerance: each key's nearest partner, before or after it, without the pairs."""
    if near.threshold is None:
        raise ValueError("a tolerance needs a threshold")
    shared = [f"equal_{i}" for i in range(len(equal))]
    side = lambda df, key, at, on: df.select(F.col(f"`{key}`").alias("own"), F.col(f"`{at}`").cast("double").alias("at"), *(F.col(f"`{c}`").alias(n) for c, n in zip(on, shared, strict=True))).where("own IS NOT NULL")
    l, r = side(left, left_key, near.left, [c.left for c in equal]), side(right, right_key, near.right, [c.right for c in equal])  # noqa: E741
    asked, other, names = (r, l, ("right_key", "left_key")) if rule.pattern == "1:N" else (l, r, ("left_key", "right_key"))
    ways = [join_asof(asked, other, "at", "at", shared, way, ties=["own"], how="inner") for way in ("backward", "forward")]
    cost = F.abs(F.col("at") - F.col("at_right"))
    met = ways[0].unionByName(ways[1]).where(tolerance_match("at", "at_right", near.threshold)).groupBy("own").agg(F.min(F.struct(cost.alias("cost"), F.col("own_right").alias("other"))).alias("b"))
    return met.select(F.col("own").alias(names[0]), F.col("b.other").alias(names[1]), F.col("b.cost").alias("cost")).select("left_key", "right_key", "cost")


def match_rules(left: DataFrame, right: DataFrame, rules: list[Rule], left_key: str) -> list[tuple[str, DataFrame]]:
    """Rules by falling priority, then in order: each is asked of the left rows that no earlier one has matched."""
    found, rest = [], left
    for rule in sorted(rules, key=lambda r: -r.priority):
        matched = match_rule(rest, right, rule)
        found.append((rule.name, matched))
        rest = rest.join(matched.select(F.col(f"l.`{left_key}`").alias(left_key)).distinct(), left_key, "left_anti")
    return found
