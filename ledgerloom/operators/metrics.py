"""Counts of a run and what they say."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EXCELLENT, FAIR, LOW_RATE, HIGH_SHARE = 90, 70, 80, 0.2


def match_counts(matched: DataFrame, left: DataFrame, right: DataFrame, left_key: Column, right_key: Column) -> DataFrame:
    """One row: pairs, totals, and keys of either side not matched: total less distinct matched keys, 0 at least."""
    pairs = matched.agg(F.count("*").alias("matched_count"), F.count_distinct(left_key).alias("_dl"), F.count_distinct(right_key).alias("_dr"))
    # three aggregates of one row each
    totals = left.agg(F.count("*").alias("total_left")).crossJoin(F.broadcast(right.agg(F.count("*").alias("total_right"))))
    less = lambda total, distinct: F.greatest(F.col(total) - F.col(distinct), F.lit(0)).cast("long")
    return totals.crossJoin(F.broadcast(pairs)).select("matched_count", "total_left", "total_right", less("total_left", "_dl").alias("unmatched_left_count"), less("total_right", "_dr").alias("unmatched_right_count"))


def match_rate(matched: Column, total: Column) -> Column:
    """Per cent of the total; 0 for none."""
    return F.when(total == 0, 0.0).otherwise(matched * 100.0 / total)


def match_band(rate: Column) -> Column:
    return F.when(rate >= EXCELLENT, "Excellent").when(rate >= FAIR, "Fair").otherwise("Needs Review")


def matched_share(matched: Column, unmatched_left: Column) -> Column:
    """Per cent of matched and unmatched left records, to one digit."""
    return F.round(match_rate(matched, matched + unmatched_left), 1)


def issues(rate: Column, unmatched_left: Column, total_left: Column, unmatched_right: Column, total_right: Column) -> Column:
    """What calls for a look: a list of texts."""
    high = lambda n, total: (n > 0) & (n / F.nullif(total, F.lit(0)) > HIGH_SHARE)
    return F.array_compact(F.array(
        F.when(rate < LOW_RATE, "Low overall match rate"),
        F.when(high(unmatched_left, total_left), "High number of unmatched left records"),
        F.when(high(unmatched_right, total_right), "High number of unmatched right records"),
    ))
