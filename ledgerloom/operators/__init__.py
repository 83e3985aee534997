"""Joins, orphans and counts over two sources."""
