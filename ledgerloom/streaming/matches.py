"""Stream-stream matching within a time window, with watermarks that bound the state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _joined(left: DataFrame, right: DataFrame, left_key: str, right_key: str, left_time: str, right_time: str, days: int, late: str, how: str) -> DataFrame:
    a, b = left.withWatermark(left_time, late).alias("l"), right.withWatermark(right_time, late).alias("r")
    near = F.col(f"r.{right_time}").between(F.col(f"l.{left_time}") - F.expr(f"INTERVAL '{days}' DAY"), F.col(f"l.{left_time}") + F.expr(f"INTERVAL '{days}' DAY"))
    return a.join(b, (F.col(f"l.{left_key}") == F.col(f"r.{right_key}")) & near, how)


def windowed_matches(left: DataFrame, right: DataFrame, left_key: str, right_key: str, left_time: str, right_time: str, days: int = 7, late: str = "1 day") -> DataFrame:
    """Pairs of equal key whose times are at most so many days apart; records later than the watermark are left out."""
    return _joined(left, right, left_key, right_key, left_time, right_time, days, late, "inner")


def unmatched_after(left: DataFrame, right: DataFrame, left_key: str, right_key: str, left_time: str, right_time: str, days: int = 7, late: str = "1 day") -> DataFrame:
    """Left records that had no match when their window had passed."""
    return _joined(left, right, left_key, right_key, left_time, right_time, days, late, "leftOuter").where(F.col(f"r.{right_key}").isNull()).select("l.*")
