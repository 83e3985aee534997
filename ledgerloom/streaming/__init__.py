"""Matching as records arrive.  The batch engine needs none of this; it is an addition."""

from ledgerloom.streaming.matches import unmatched_after, windowed_matches

__all__ = ["unmatched_after", "windowed_matches"]
