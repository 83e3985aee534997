import pytest
from hypothesis import given
from hypothesis import strategies as st

from ledgerloom.sources import readers, scoped
from ledgerloom.sources.filters import FilterCondition as C
from ledgerloom.sources.ranges import KeyRanges, byte_ranges, row_ranges
from ledgerloom.sources.registry import Registry


@pytest.fixture()
def csv(tmp_path):
    path = tmp_path / "payments.csv"
    path.write_text('id,name,amount\n1,"Acme, Inc",10.5\n2,Beta,9\n3,,7\n\n4,"two\nlines",1\n')
    return str(path)


def test_ranges():
    assert byte_ranges(10, 3) == [(0, 3), (3, 6), (6, 10)]
    assert row_ranges(10, 3) == [(0, 3), (3, 3), (6, 4)]
    assert row_ranges(2, 10) == [(0, 1), (1, 1)]
    assert byte_ranges(0, 3) == byte_ranges(5, 0) == []


@given(st.integers(0, 10_000), st.integers(1, 50))
def test_ranges_cover_everything(size, parts):
    got = byte_ranges(size, parts)
    assert sum(b - a for a, b in got) == size and len(got) == min(size, parts)
    assert all(x[1] == y[0] for x, y in zip(got, got[1:], strict=False))


def test_key_ranges():
    r = KeyRanges.even("id", 0, 100, 4)
    assert [r.where(i, 0) for i in range(len(r))] == ["id >= 0 AND id < 25", "id >= 25 AND id < 50", "id >= 50 AND id < 75", "id >= 75"]
    assert KeyRanges.even("id", 0, 2, 10).edges == (1,)
    assert KeyRanges.even("id", 5, 5, 3).where(0) == "1=1"


@given(st.integers(-50, 50), st.integers(0, 80), st.integers(1, 9), st.integers(-200, 200))
def test_each_key_is_in_one_range(least, more, parts, key):
    r = KeyRanges.even("id", least, least + more, parts)
    inside = [i for i in range(len(r)) if (i == 0 or key >= r.edges[i - 1]) and (i == len(r.edges) or key < r.edges[i])]
    assert len(inside) == 1 and len(r) <= parts


@pytest.mark.parametrize("uri,kind", [("postgres://h/db?table=t", "postgres"), ("postgresql://h/db", "postgres"), ("s3://b/k.csv", "csv"), ("/x/y.CSV", "csv"), ("/x/y.parquet", "parquet"), ("/x/y", "parquet")])
def test_kinds(uri, kind):
    assert readers.kind_of(uri) == kind


def test_unsupported_source():
    with pytest.raises(readers.UnsupportedSource):
        readers.kind_of("elasticsearch://h/i")


def test_s3():
    assert readers.parse_s3_uri("s3://bucket/a/b.csv") == ("bucket", "a/b.csv")
    assert readers.path_of("s3://bucket/a.csv") == "s3a://bucket/a.csv"
    for bad in ("s3://bucket", "s3://bucket/", "s3:///k", "http://bucket/k"):
        with pytest.raises(readers.SourceError):
            readers.parse_s3_uri(bad)
    config = readers.S3Config.from_env({"AWS_ACCESS_KEY_ID": "a", "AWS_SECRET_ACCESS_KEY": "b", "AWS_ENDPOINT_URL": "http://h:9000", "AWS_ALLOW_HTTP": "1"})
    assert config.region == "us-east-1" and config.spark_conf()["spark.hadoop.fs.s3a.connection.ssl.enabled"] == "false"
    with pytest.raises(readers.SourceError):
        readers.S3Config.from_env({})


def test_jdbc_options():
    got = readers.jdbc_options("postgres://u:p%40@h:5433/db?table=t&partition_column=id&lower=0&upper=9", 8)
    assert got["url"] == "jdbc:postgresql://h:5433/db" and got["password"] == "p@" and got["numPartitions"] == "8" and got["dbtable"] == "t"
    with pytest.raises(readers.SourceError):
        readers.jdbc_options("postgres://h/db")


def test_csv_and_parquet_with_filters(spark, csv, tmp_path):
    df = readers.read_source(spark, csv, [C("amount", "gt", 8)])
    assert sorted(r.id for r in df.collect()) == ["1", "2"] or sorted(r.id for r in df.collect()) == [1, 2]
    spark.createDataFrame([(1, 100.0), (2, 200.0), (3, 300.0)], "id int, amount double").write.parquet(str(tmp_path / "p.parquet"))
    assert readers.register_source(spark, "pq", str(tmp_path / "p.parquet"), [C("amount", "gte", 200)]).count() == 2
    assert spark.table("pq").count() == 2
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        readers.read_source(spark, str(tmp_path / "none.csv")).collect()


def test_scoped_and_preview(spark, csv):
    got = scoped.load_scoped(spark, "csv", csv, [C("name", "like", "%a%")], 1)
    assert got.columns == ["id", "name", "amount"] and got.total_rows == 2 and len(got.rows) == 1
    assert scoped.load_scoped(spark, "csv_upload", csv, [C("name", "eq", "")]).rows[0][0] == "3"
    profile = scoped.profile_csv(spark, csv)
    assert profile.total_rows == 4 and profile.rows[2] == ["3", "", "7"] and profile.rows[3][1] == "two\nlines"
    assert scoped.preview(spark, csv, 1).rows == [["1", "Acme, Inc", "10.5"]]
    with pytest.raises(readers.SourceError):
        scoped.load_scoped(spark, "excel", csv, [])


def test_limits(spark):
    assert scoped.scoped(spark.range(5000), [], "sql").count() == 200
    assert scoped.scoped(spark.range(5000), [], "sql", 9999).count() == 1000


def test_registry():
    r = Registry()
    r.upsert("a", "/x.csv")
    r.upsert("b", "/y")
    r.upsert("a", "/z.csv")
    assert [s.alias for s in r.list()] == ["a", "b"] and r.resolve("a") == "/z.csv" and r.resolve("file:///q") == "file:///q"
    with pytest.raises(readers.SourceError):
        r.resolve("c")
