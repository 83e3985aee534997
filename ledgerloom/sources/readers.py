"""Readers by URI: PostgreSQL through JDBC, CSV and Parquet on any file system that Spark reads."""

from __future__ import annotations

import os
from dataclasses import dataclass
from urllib.parse import parse_qs, unquote, urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.sources.filters import FilterCondition, apply_filters
from ledgerloom.sources.ranges import byte_ranges


class SourceError(Exception):
    """A source can't be reached or read."""


class UnsupportedSource(SourceError):
    pass


@dataclass(frozen=True)
class S3Config:
    region: str
    access_key_id: str
    secret_access_key: str
    endpoint_url: str | None = None
    allow_http: bool = False

    @classmethod
    def from_env(cls, env=os.environ) -> S3Config:
        for name in ("AWS_ACCESS_KEY_ID", "AWS_SECRET_ACCESS_KEY"):
            if not env.get(name):
                raise SourceError(f"{name} not set")
        return cls(env.get("AWS_REGION", "us-east-1"), env["AWS_ACCESS_KEY_ID"], env["AWS_SECRET_ACCESS_KEY"], env.get("AWS_ENDPOINT_URL"), env.get("AWS_ALLOW_HTTP") in ("true", "1"))

    def spark_conf(self) -> dict[str, str]:
        conf = {"spark.hadoop.fs.s3a.access.key": self.access_key_id, "spark.hadoop.fs.s3a.secret.key": self.secret_access_key, "spark.hadoop.fs.s3a.endpoint.region": self.region, "spark.hadoop.fs.s3a.connection.ssl.enabled": str(not self.allow_http).lower()}
        return conf | ({"spark.hadoop.fs.s3a.endpoint": self.endpoint_url, "spark.hadoop.fs.s3a.path.style.access": "true"} if self.endpoint_url else {})


def parse_s3_uri(uri: str) -> tuple[str, str]:
    """Bucket and key."""
    parts = urlsplit(uri)
    if parts.scheme != "s3":
        raise SourceError("URI scheme must be s3://")
    if not parts.netloc:
        raise SourceError("missing bucket in S3 URI")
    key = parts.path.lstrip("/")
    if not key:
        raise SourceError("missing object key in S3 URI")
    return parts.netloc, key


def kind_of(uri: str) -> str:
    """postgres, csv or parquet; whatever isn't a database or a .csv is taken for Parquet."""
    scheme = urlsplit(uri).scheme
    if scheme in ("postgres", "postgresql"):
        return "postgres"
    if scheme in ("elasticsearch", "http", "https"):
        raise UnsupportedSource(f"no reader for {scheme} sources")
    return "csv" if uri.split("?")[0].lower().endswith(".csv") else "parquet"


def path_of(uri: str) -> str:
    """The path that Spark reads: s3:// goes through s3a."""
    if uri.startswith("s3://"):
        bucket, key = parse_s3_uri(uri)
        return f"s3a://{bucket}/{key}"
    return uri


def jdbc_options(uri: str, partitions: int = 4) -> dict[str, str]:
    """Options for format("jdbc").  ?table= names the table; ?partition_column=, lower= and upper= split the scan."""
    parts = urlsplit(uri)
    query = {k: v[-1] for k, v in parse_qs(parts.query).items()}
    if "table" not in query:
        raise SourceError("a PostgreSQL URI needs ?table=")
    out = {"url": f"jdbc:postgresql://{parts.hostname}:{parts.port or 5432}{parts.path}", "dbtable": query["table"], "driver": "org.postgresql.Driver", "pushDownPredicate": "true"}
    if parts.username:
        out |= {"user": unquote(parts.username), "password": unquote(parts.password or "")}
    if "partition_column" in query:
        out |= {"partitionColumn": query["partition_column"], "lowerBound": query["lower"], "upperBound": query["upper"], "numPartitions": str(partitions)}
    return out


#: About so many pages of 8 KB a part, before the number of parts is limited.
PART_PAGES = 16_384


def probe_sql(table: str) -> str:
    """One row: what kind of relation the table is, and its pages as they are now, not as last analysed."""
    name = table.replace("'", "''")
    return f"SELECT c.relkind::text AS kind, pg_relation_size(c.oid) / current_setting('block_size')::bigint AS pages FROM pg_class c WHERE c.oid = to_regclass('{name}')"


def scan_predicates(table: str, kind: str | None, pages: int, partitions: int) -> list[str]:
    """Conditions that together hold for every row of a table once, or none for a scan in one part.

    An ordinary table or materialised view is cut into ranges of pages, which the database scans as such; the last range is open,
    so that pages added after the probe are read.  Other relations have no pages of their own and are cut by a hash of the row."""
    parts = max(1, min(partitions, -(-pages // PART_PAGES) if pages > PART_PAGES * partitions else partitions))
    if parts == 1 or kind is None:
        return []
    if kind in ("r", "m"):
        edges = [a for a, _ in byte_ranges(pages, parts)][1:]
        if not edges:
            return []
        tid = lambda page: f"'({page},0)'::tid"
        inner = [f"ctid >= {tid(a)} AND ctid < {tid(b)}" for a, b in zip(edges, edges[1:], strict=False)]
        return [f"ctid < {tid(edges[0])}", *inner, f"ctid >= {tid(edges[-1])}"]
    alias = table.rpartition(".")[2]
    return [f"mod(hashtext({alias}::text)::bigint + 2147483648, {parts}) = {i}" for i in range(parts)]


def scan_in_parts(spark: SparkSession, options: dict[str, str], predicates: list[str]) -> DataFrame:
    """A JDBC table by one query for each predicate; filters and columns are pushed into each."""
    rest = {k: v for k, v in options.items() if k not in ("url", "dbtable")}
    if not predicates:
        return spark.read.format("jdbc").options(**options).load()
    return spark.read.jdbc(options["url"], options["dbtable"], predicates=predicates, properties=rest)


def read_postgres(spark: SparkSession, uri: str, partitions: int = 4) -> DataFrame:
    """A table in as many parts: by the column that the URI names, else by ranges of pages planned from one probe of the catalogue."""
    options = jdbc_options(uri, partitions)
    if "partitionColumn" in options or partitions < 2:
        return spark.read.format("jdbc").options(**options).load()
    table = options["dbtable"]
    probe = spark.read.format("jdbc").options(**{k: v for k, v in options.items() if k != "dbtable"}, query=probe_sql(table)).load().first()
    return scan_in_parts(spark, options, scan_predicates(table, probe["kind"] if probe else None, probe["pages"] if probe else 0, partitions))


#: The column that keeps a line which the declared schema can't read.
RESCUE = "_rescued"


def read_csv(spark: SparkSession, path: str, schema: str | T.StructType | None = None, infer: bool = True) -> DataFrame:
    """A CSV file with a header; cells may hold newlines.

    With a schema the file is read once: a cell that isn't of its column's type is null, and its line is kept in ``_rescued``.
    Columns go by the header's names, whatever their order; those that the file lacks are null."""
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    if schema is None:
        return reader.csv(path, inferSchema=infer)
    wanted = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    header = spark.read.option("multiLine", True).option("header", True).csv(path).columns
    kinds = {f.name.lower(): f.dataType for f in wanted}
    own = T.StructType([T.StructField(c, kinds.get(c.lower(), T.StringType())) for c in header] + [T.StructField(RESCUE, T.StringType())])
    df = reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", RESCUE).schema(own).csv(path)
    known = {c.lower(): c for c in header}
    return df.select(*((F.col(f"`{known[f.name.lower()]}`") if f.name.lower() in known else F.lit(None).cast(f.dataType)).alias(f.name) for f in wanted), RESCUE)


def bad_lines(df: DataFrame) -> DataFrame:
    """rows and bad_lines of a file read by a schema."""
    return df.agg(F.count("*").alias("rows"), F.count(RESCUE).alias("bad_lines"))


def read_source(spark: SparkSession, uri: str, filters: list[FilterCondition] = (), partitions: int = 4, schema: str | T.StructType | None = None) -> DataFrame:
    """Any source with its filters, which apply to all kinds of source and are pushed into the scan where it can take them.  schema: that of a CSV file."""
    kind = kind_of(uri)
    if kind == "postgres":
        df = read_postgres(spark, uri, partitions)
    elif kind == "csv":
        df = read_csv(spark, path_of(uri), schema, infer=not uri.startswith("s3://"))
        df = df.drop(RESCUE) if schema is not None else df
    else:
        df = spark.read.parquet(path_of(uri))
    return apply_filters(df, list(filters))


def register_source(spark: SparkSession, alias: str, uri: str, filters: list[FilterCondition] = (), partitions: int = 4, schema: str | T.StructType | None = None) -> DataFrame:
    df = read_source(spark, uri, filters, partitions, schema)
    df.createOrReplaceTempView(alias)
    return df
