"""Even splits of row counts, byte sizes and key ranges."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


def byte_ranges(size: int, parts: int) -> list[tuple[int, int]]:
    """Half-open ranges; no more than there are bytes, the last one takes the remainder."""
    if size <= 0 or parts <= 0:
        return []
    parts = min(parts, size)
    step = size // parts
    return [(i * step, size if i == parts - 1 else (i + 1) * step) for i in range(parts)]


def row_ranges(rows: int, parts: int) -> list[tuple[int, int]]:
    """(offset, count), split as byte_ranges."""
    return [(a, b - a) for a, b in byte_ranges(rows, parts)]


@dataclass(frozen=True)
class KeyRanges:
    """Ranges of a numeric key that together hold every value: the first is open below and takes nulls, the last open above."""

    key: str
    edges: tuple[int, ...]

    @classmethod
    def even(cls, key: str, least: int, most: int, parts: int) -> KeyRanges:
        """At most so many ranges of equal width between least and most."""
        if parts < 1:
            raise ValueError("at least one range is needed")
        step = max(1, -(-(most - least) // parts))
        return cls(key, tuple(e for i in range(1, parts) if (e := least + i * step) < most))

    def __len__(self) -> int:
        return len(self.edges) + 1

    def condition(self, i: int) -> Column:
        """Rows of the i-th range; each row is in exactly one."""
        return self.of(F.col(self.key), i)

    def of(self, key: Column, i: int) -> Column:
        low = key >= self.edges[i - 1] if i else None
        high = key < self.edges[i] if i < len(self.edges) else None
        if low is None:
            return F.lit(True) if high is None else high | key.isNull()
        return low if high is None else low & high

    def where(self, i: int, least: int | None = None) -> str:
        """The text form of a range with a lower bound at least, as partitioned scans take it."""
        low = least if i == 0 else self.edges[i - 1]
        parts = ([f"{self.key} >= {low}"] if low is not None else []) + ([f"{self.key} < {self.edges[i]}"] if i < len(self.edges) else [])
        return " AND ".join(parts) or "1=1"
