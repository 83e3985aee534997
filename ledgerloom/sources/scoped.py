"""Samples and previews of sources: filtered, limited, as text."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.sources.filters import FilterCondition, apply_filters
from ledgerloom.sources.readers import SourceError, kind_of, read_source

DEFAULT_LIMIT, MOST, PREVIEW, PREVIEW_MOST = 200, 1000, 10, 100


@dataclass(frozen=True)
class Sample:
    columns: list[str]
    rows: list[list[str]]
    total_rows: int


def as_text(df: DataFrame) -> DataFrame:
    """All columns as text, null as an empty one."""
    return df.select(*(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in df.columns))


def scoped(df: DataFrame, conditions: list[FilterCondition], dialect: str, limit: int | None = None, order: list[str] = ()) -> DataFrame:
    """The rows of a sample; with an order they are the same ones each time."""
    found = apply_filters(df, conditions, dialect)
    return as_text((found.orderBy(*order) if order else found).limit(min(DEFAULT_LIMIT if limit is None else limit, MOST)))


def load_scoped(spark: SparkSession, kind: str, uri: str, conditions: list[FilterCondition], limit: int | None = None) -> Sample:
    """At most 1000 rows.  total_rows: for CSV all rows that pass, for a database those returned."""
    if kind in ("csv", "csv_upload"):
        df = spark.read.csv(uri.replace("s3://", "s3a://", 1), header=True, inferSchema=False)
        rows = scoped(df, conditions, "csv", limit).collect()
        return Sample(df.columns, [list(r) for r in rows], apply_filters(df, conditions, "csv").count())
    if kind in ("postgres", "postgresql", "parquet"):
        df = read_source(spark, uri)
        rows = scoped(df, conditions, "sql", limit).collect()
        return Sample(df.columns, [list(r) for r in rows], len(rows))
    raise SourceError(f"no scoped loader for {kind!r}")


def preview(spark: SparkSession, uri: str, limit: int | None = None) -> Sample:
    """Columns, number of rows and the first rows, at most 100."""
    df = read_source(spark, uri)
    rows = as_text(df.limit(min(PREVIEW if limit is None else limit, PREVIEW_MOST))).collect()
    return Sample(df.columns, [list(r) for r in rows], df.count())


def profile_csv(spark: SparkSession, path: str) -> Sample:
    """A CSV upload: columns, number of rows that aren't empty, the first ten."""
    if kind_of(path) != "csv":
        raise SourceError("not a CSV file")
    df = spark.read.csv(path, header=True, inferSchema=False, multiLine=True)
    return Sample(df.columns, [list(r) for r in as_text(df.limit(PREVIEW)).collect()], df.count())


def schema_of(df: DataFrame) -> DataFrame:
    """position, name and type of each column."""
    rows = [(i, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema.fields)]
    return df.sparkSession.createDataFrame(rows, "position int, name string, type string")
