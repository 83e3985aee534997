"""Reports over runs, receivables and payments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators.metrics import match_rate


def run_summary(runs: DataFrame, recipes: DataFrame) -> DataFrame:
    """Runs with their recipe's name, match rate in per cent of left records to two digits, and duration in seconds."""
    seconds = F.unix_micros(F.col("completed_at").cast("timestamp")) - F.unix_micros(F.col("started_at").cast("timestamp"))
    rate = F.when(F.col("left_record_count") > 0, F.round(match_rate(F.col("matched_count"), F.col("left_record_count")), 2)).otherwise(0.0)
    named = runs.join(recipes.select("recipe_id", F.col("name").alias("recipe_name")), "recipe_id", "left")
    return named.withColumns({"match_rate_pct": rate, "duration_seconds": seconds / 1e6})


def aging(df: DataFrame, due: Column, as_of: str, status: Column | None = None, paid: str = "paid") -> DataFrame:
    """days_overdue and one of five buckets, for rows that aren't paid."""
    df = df.where(status != paid) if status is not None else df
    days = F.datediff(F.lit(as_of).cast("date"), due.cast("date"))
    bucket = F.when(days <= 0, "current").when(days <= 30, "1-30 days").when(days <= 60, "31-60 days").when(days <= 90, "61-90 days").otherwise("90+ days")
    return df.withColumns({"days_overdue": days, "aging_bucket": bucket})


def totals_by(df: DataFrame, keys: list[str], amount: str, date: str) -> DataFrame:
    """count, total, average, first and last date for each group, largest total first."""
    out = df.groupBy(*keys).agg(F.count("*").alias("payment_count"), F.sum(amount).alias("total_amount"), F.avg(amount).alias("avg_amount"), F.min(date).alias("first_payment"), F.max(date).alias("last_payment"))
    return out.orderBy(F.desc("total_amount"))
