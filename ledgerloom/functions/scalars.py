"""Tolerances, keys and names.  All are built-in expressions, so they stay in generated code and can be pushed down."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Between the parts of a composite key.
UNIT_SEPARATOR = "\x1f"

#: SQL functions of a job session; Spark inlines their bodies into the query.
SQL_FUNCTIONS = {
    "tolerance_match": "(a DOUBLE, b DOUBLE, t DOUBLE) RETURNS BOOLEAN RETURN CASE WHEN a IS NULL OR b IS NULL OR t IS NULL THEN NULL ELSE abs(a - b) <= t AND NOT isnan(t) END",
    "relative_match": "(a DOUBLE, b DOUBLE, t DOUBLE) RETURNS BOOLEAN RETURN abs(a - b) / nullif(abs(a), 0) < t",
    "strpos": "(s STRING, part STRING) RETURNS INT RETURN instr(s, part)",
    "starts_with": "(s STRING, part STRING) RETURNS BOOLEAN RETURN startswith(s, part)",
    "sha256": "(s STRING) RETURNS STRING RETURN sha2(s, 256)",
    "array_has": "(xs ARRAY<STRING>, x STRING) RETURNS BOOLEAN RETURN array_contains(xs, x)",
}


def register(spark: SparkSession) -> SparkSession:
    for name, body in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{body}")
    return spark


def _double(x) -> Column:
    return (F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)).cast("double")


def tolerance_match(a, b, threshold) -> Column:
    """abs(a - b) <= threshold on doubles: null if any is null, false for NaN."""
    a, b, t = _double(a), _double(b), _double(threshold)
    return F.when(a.isNull() | b.isNull() | t.isNull(), None).otherwise((F.abs(a - b) <= t) & ~F.isnan(t))


def relative_match(a, b, share) -> Column:
    """abs(a - b) / abs(a) < share; null if a is 0."""
    a, b = _double(a), _double(b)
    return F.abs(a - b) / F.nullif(F.abs(a), F.lit(0.0)) < _double(share)


def signed_relative_match(a, b, share) -> Column:
    """abs(a - b) / a < share, as written in older rules: a negative a always passes."""
    a, b = _double(a), _double(b)
    return F.abs(a - b) / F.nullif(a, F.lit(0.0)) < _double(share)


def text_of(column) -> Column:
    """A value as text; null stays null.  Floating numbers below 10**20 are written as plain digits, whole ones without a fraction."""
    c = F.col(column) if isinstance(column, str) else column
    digits = F.regexp_replace(c.try_cast("decimal(38,18)").cast("string"), r"\.?0+$", "")
    floating = F.typeof(c).isin("float", "double") & (F.abs(c.try_cast("double")) < 1e20)
    return F.when(floating & digits.isNotNull(), digits).otherwise(c.cast("string"))


def key_of(columns: list) -> Column:
    """One text key of a whole primary key; null if any part is null."""
    parts = [text_of(c) for c in columns]
    return parts[0] if len(parts) == 1 else F.when(F.greatest(*(p.isNull() for p in parts)), None).otherwise(F.concat_ws(UNIT_SEPARATOR, *parts))


def field_name(column) -> Column:
    """A field name trimmed, in lower case, with - and space as _."""
    return F.lower(F.regexp_replace(F.trim(column), "[- ]", "_"))


def js_number(column) -> Column:
    """The number that a text starts with, as JavaScript's parseFloat reads it; null if none."""
    text = F.regexp_extract(text_of(column), r"^\s*([+-]?(?:Infinity|(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?))", 1)
    return F.when(text != "", text).cast("double")
