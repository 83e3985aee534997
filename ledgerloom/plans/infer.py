"""What data says about how to match it: rules from confirmed pairs, previews, named keys, cardinality."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.functions import js_number, tolerance_match
from ledgerloom.operators.asof import join_asof
from ledgerloom.operators.joins import free_name
from ledgerloom.plans.rules import ORDERS, Condition, Rule, match_rule

EXACT_SHARE, TOLERANT_SHARE, RELATIVE = 0.7, 0.5, 0.05
#: Pairs that must be confirmed before rules are inferred from them.
LEAST_PAIRS = 3


def confirmed(pairs: DataFrame, least: int = LEAST_PAIRS) -> DataFrame:
    """The pairs, if there are enough of them to infer rules from."""
    known = pairs.limit(least).count()
    if known < least:
        raise ValueError(f"rules need {least} confirmed pairs, there are {known}")
    return pairs


#: Rows of which all pairs of columns are compared at a time.
COMPARED = 512


def _compared(columns: int, others: int):
    """Batches of n left and m right columns as texts, then as numbers: for each pair of columns how many rows are equal and how many close."""

    def run(batches):
        exact, close, n = np.zeros((columns, others), np.int64), np.zeros((columns, others), np.int64), 0
        for batch in batches:
            for part in (batch.slice(i, COMPARED) for i in range(0, batch.num_rows, COMPARED)):
                n += part.num_rows
                texts = pa.concat_arrays(part.columns[: columns + others]).dictionary_encode()
                empty = texts.dictionary.index("").as_py()  # no text has the code -1
                codes = texts.indices.to_numpy().reshape(columns + others, -1)
                number = np.stack([c.fill_null(float("nan")).to_numpy(zero_copy_only=False) for c in part.columns[columns + others :]])
                a, b, x, y = codes[:columns], codes[columns:], number[:columns], number[columns:]
                for i in range(columns):
                    filled = (a[i] != empty) & (b != empty)
                    same = filled & (a[i] == b)
                    with np.errstate(all="ignore"):
                        share = np.abs(x[i] - y) / np.where(x[i] == 0, 1, np.abs(x[i]))
                    exact[i] += same.sum(axis=1)
                    close[i] += (filled & ~same & (share < RELATIVE)).sum(axis=1)
        if n:
            place, right = (m.ravel() for m in np.indices((columns, others)))
            yield pa.RecordBatch.from_pydict({"place": place, "right_place": right, "exact": exact.ravel(), "close": close.ravel(), "n": np.full(columns * others, n)})

    return run


def _number(kind: T.DataType, column: str, text: str) -> Column:
    """The number that a value's text starts with.  Whole numbers and doubles are what their texts say, so that these need no parsing; NaN is none."""
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return F.col(column).cast("double")
    if isinstance(kind, T.DoubleType):
        return F.when(~F.isnan(column), F.col(column))
    return js_number(text)


def infer_rules(pairs: DataFrame, left_columns: list[str], right_columns: list[str]) -> DataFrame:
    """pairs: a row per confirmed pair with the columns of both sides.  left_col, right_col, op, confidence, best first.

    Two columns match by eq if over 0.7 of the pairs have equal text, by tolerance if over 0.5 are within 5 % or both
    shares together exceed 0.7.  Empty cells never match but count as pairs.  Tasks compare all pairs of columns in Arrow
    batches and sum their own rows; what is shuffled is a row for each pair of columns and task."""
    text = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    columns = [*left_columns, *right_columns]
    # texts are computed before their numbers, so that a column is cast once
    # comparing costs more than moving: an even spread, which a small join's result may lack
    spread = pairs.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns))).repartition(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    cells = spread.select("*", *(text(f"c{i}").alias(f"t{i}") for i in range(len(columns))))
    cells = cells.select(*(f"t{i}" for i in range(len(columns))), *(_number(f.dataType, f"c{i}", f"t{i}").alias(f"x{i}") for i, f in enumerate(spread.schema.fields)))
    sums = cells.mapInArrow(_compared(len(left_columns), len(right_columns)), "place long, right_place long, exact long, close long, n long")
    summed = sums.groupBy("place", "right_place").agg(*(F.sum(c).alias(c) for c in ("exact", "close", "n")))
    named = lambda columns, place: F.element_at(F.array(*map(F.lit, columns)), F.col(place).cast("int") + 1)
    found = summed.select(
        "place", "right_place", named(left_columns, "place").alias("left_col"), named(right_columns, "right_place").alias("right_col"), (F.col("exact") / F.col("n")).alias("exact"), (F.col("close") / F.col("n")).alias("close"))
    op = F.when(F.col("exact") > EXACT_SHARE, "eq").when((F.col("close") > TOLERANT_SHARE) | (F.col("exact") + F.col("close") > EXACT_SHARE), "tolerance")
    scored = found.select("place", "right_place", "left_col", "right_col", op.alias("op"), F.when(F.col("exact") > EXACT_SHARE, F.col("exact")).otherwise(F.col("exact") + F.col("close")).alias("confidence"))
    return scored.where("op IS NOT NULL").orderBy(F.desc("confidence"), "place", "right_place").drop("place", "right_place")


def rules_from(pairs: DataFrame, left_columns: list[str], right_columns: list[str], least: int = LEAST_PAIRS) -> DataFrame:
    """infer_rules of pairs that a user has confirmed, of which there must be enough."""
    return infer_rules(confirmed(pairs, least), left_columns, right_columns)


def _meets_one(left: DataFrame, right: DataFrame, c: Condition) -> DataFrame:
    """Left rows that meet one condition with some right row, each once: a semi-join, never the pairs."""
    if c.op in ORDERS:
        return _ordered_with_any(left, right, c)
    if c.op == "tolerance":
        return _near_any(left, right, c)
    values = right.select(F.col(f"`{c.right}`")).distinct()
    return left.alias("l").join(values.alias("r"), c.column(), "left_semi")


def _ordered_with_any(left: DataFrame, right: DataFrame, c: Condition) -> DataFrame:
    """Left rows that an order holds for with some right row: the extreme right value tells."""
    value = F.col(f"`{c.right}`")
    extreme = right.where(value.isNotNull()).agg((F.min if c.op in ("gt", "gte") else F.max)(value).alias(c.right))
    return left.alias("l").join(F.broadcast(extreme).alias("r"), c.column(), "left_semi")  # one row


def _near_any(left: DataFrame, right: DataFrame, c: Condition) -> DataFrame:
    """Left rows with a right value within the threshold: the nearest one below or above tells."""
    name = free_name("_near", left, right)
    values = right.select(F.col(f"`{c.right}`").alias(name)).distinct()
    return join_asof(left, values, c.left, name, direction="nearest", how="inner").where(tolerance_match(c.left, name, c.threshold)).drop(name)


def preview_match(left: DataFrame, right: DataFrame, left_key: str, right_key: str, conditions: list[Condition]) -> DataFrame:
    """left_key, status, right_keys: matched if one right row meets all conditions, partial if one meets some.

    Only the pairs that meet all conditions are made, by one join; which rows meet some condition is told by a semi-join for
    each, so that a weak condition, such as an equal country, makes no pairs."""
    a = F.col(f"`{left_key}`")
    whole = match_rule(left, right, Rule("all", tuple(conditions))).select(F.col(f"l.`{left_key}`").alias("left_key"), F.col(f"r.`{right_key}`").alias("right_key")).distinct()
    full = whole.groupBy("left_key").agg(F.sort_array(F.collect_list("right_key")).alias("right_keys"))
    some = reduce(DataFrame.unionByName, (_meets_one(left, right, c).select(a.alias("left_key")) for c in conditions)).distinct().withColumn("some", F.lit(True))
    status = F.when(F.col("right_keys").isNotNull(), "matched").when(F.col("some"), "partial").otherwise("unmatched")
    rows = left.select(a.alias("left_key")).join(full, "left_key", "left").join(some, "left_key", "left")
    return rows.select("left_key", status.alias("status"), F.coalesce("right_keys", F.array().cast(f"array<{dict(right.dtypes)[right_key]}>")).alias("right_keys"))


def preview_counts(left: DataFrame, right: DataFrame, left_key: str, right_key: str, conditions: list[Condition]) -> DataFrame:
    """left_key, status, matches: as preview_match, with the number of right keys instead of the keys, so that no task holds them."""
    once = lambda df, k, cs: df.select(*(F.col(f"`{c}`") for c in dict.fromkeys([k, *cs]))).distinct()
    l, r = once(left, left_key, [c.left for c in conditions]), once(right, right_key, [c.right for c in conditions])  # noqa: E741
    pairs = match_rule(l, r, Rule("all", tuple(conditions))).select(F.col(f"l.`{left_key}`").alias("left_key"), F.col(f"r.`{right_key}`").alias("right_key"))
    if not all(df.groupBy(F.col(f"`{k}`")).count().where("count > 1").isEmpty() for df, k in ((l, left_key), (r, right_key))):
        pairs = pairs.distinct()  # a key has several rows, which may make a pair twice
    full = pairs.groupBy("left_key").agg(F.count("*").alias("matches"))
    some = reduce(DataFrame.unionByName, (_meets_one(left, right, c).select(F.col(f"`{left_key}`").alias("left_key")) for c in conditions)).distinct().withColumn("some", F.lit(True))
    status = F.when(F.col("matches").isNotNull(), "matched").when(F.col("some"), "partial").otherwise("unmatched")
    rows = left.select(F.col(f"`{left_key}`").alias("left_key")).join(full, "left_key", "left").join(some, "left_key", "left")
    return rows.select("left_key", status.alias("status"), F.coalesce("matches", F.lit(0)).cast("long").alias("matches"))


def preview_summary(preview: DataFrame) -> DataFrame:
    count = lambda s: F.count_if(F.col("status") == s).alias(s)
    return preview.agg(F.count("*").alias("total"), count("matched"), count("partial"), count("unmatched"))


def key_candidates(columns: list[str]) -> list[str]:
    named = [c for c in columns if c.lower() == "id" or c.lower().endswith("id")]
    return named or columns[:1]


def detect_key(df: DataFrame) -> DataFrame:
    """column, rows, distinct_values, is_key of the first candidate: a column named id or ending in id, else the first."""
    column = key_candidates(df.columns)[0]
    counted = df.agg(F.count("*").alias("rows"), F.count_distinct(F.col(f"`{column}`")).alias("distinct_values"))
    return counted.select(F.lit(column).alias("column"), "rows", "distinct_values", (F.col("rows") == F.col("distinct_values")).alias("is_key"))


def cardinality(pairs: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """One row: the most pairs of a left and of a right key, and the pattern they make."""
    most = lambda k, name: pairs.groupBy(k).agg(F.count("*").alias("n")).agg(F.coalesce(F.max("n"), F.lit(0)).alias(name))
    both = most(left_key, "most_per_left").crossJoin(F.broadcast(most(right_key, "most_per_right")))  # one row each
    many_right, many_left = F.col("most_per_left") > 1, F.col("most_per_right") > 1
    pattern = F.when(many_right & many_left, "N:M").when(many_right, "1:N").when(many_left, "M:1").otherwise("1:1")
    return both.withColumn("pattern", pattern)
