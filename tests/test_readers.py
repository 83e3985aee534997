import glob
import os
import re

import pyspark
import pytest
from pyspark.sql import functions as F

from ledgerloom.sources import readers

TABLE = "postgres://u:p@h:5433/db?table={}"


def holds(predicate: str, page: int) -> bool:
    """A predicate over ctid, asked of a page's rows."""
    text = predicate.replace("ctid", str(page)).replace(" AND ", " and ")
    return eval(re.sub(r"'\((\d+),0\)'::tid", r"\1", text))


@pytest.mark.parametrize("pages,parts", [(0, 4), (1, 4), (3, 4), (4, 4), (1000, 7), (10**7, 8)])
def test_page_ranges_hold_every_row_once(pages, parts):
    found = readers.scan_predicates("t", "r", pages, parts)
    assert len(found) == (0 if pages < 2 else min(pages, parts))
    for page in {0, 1, 2, pages // 2, max(0, pages - 1), pages, pages + 5}:  # pages beyond the probe too
        assert not found or sum(holds(p, page) for p in found) == 1


def test_other_relations_are_hashed():
    found = readers.scan_predicates("public.v", "v", 0, 3)
    assert found == [f"mod(hashtext(v::text)::bigint + 2147483648, 3) = {i}" for i in range(3)]
    assert readers.scan_predicates("gone", None, 0, 3) == [] and readers.scan_predicates("t", "r", 100, 1) == []
    assert "to_regclass('o''k')" in readers.probe_sql("o'k")


class Recorder:
    """Stands for a session whose reader only notes what it is asked."""

    def __init__(self, row):
        self.row, self.asked, self.read = row, [], self

    def format(self, kind):
        self.asked.append({"format": kind})
        return self

    def options(self, **more):
        self.asked[-1] |= more
        return self

    def load(self):
        return self

    def first(self):
        return self.row

    def jdbc(self, url, table, predicates, properties):
        self.asked.append({"url": url, "table": table, "predicates": predicates, "properties": properties})
        return self


def test_postgres_is_split_by_default():
    spark = Recorder({"kind": "r", "pages": 100})
    readers.read_postgres(spark, TABLE.format("orders"), 4)
    probe, scan = spark.asked
    assert "pg_class" in probe["query"] and "dbtable" not in probe
    assert len(scan["predicates"]) == 4 and scan["properties"]["user"] == "u" and scan["properties"]["pushDownPredicate"] == "true"
    named = Recorder(None)
    readers.read_postgres(named, TABLE.format("orders") + "&partition_column=id&lower=1&upper=9", 4)
    assert len(named.asked) == 1 and named.asked[0]["partitionColumn"] == "id"
    gone = Recorder(None)
    readers.read_postgres(gone, TABLE.format("gone"), 4)
    assert gone.asked[-1]["dbtable"] == "gone"  # the database says what is wrong


def test_parts_of_a_real_database(spark, tmp_path, monkeypatch):
    """Through the embedded database that Spark ships: each row once, and filters in each part's query."""
    if not glob.glob(os.path.join(os.path.dirname(pyspark.__file__), "jars", "derby-*.jar")):
        pytest.skip("no embedded database")
    options = {"url": f"jdbc:derby:{tmp_path}/db;create=true", "dbtable": "T", "driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    try:
        spark.range(100).selectExpr("id", "id % 7 AS k").write.format("jdbc").options(**options).mode("overwrite").save()
    except Exception as e:  # the driver's classes may be missing
        pytest.skip(str(e)[:80])
    edges = [(None, 30), (30, 60), (60, None)]
    predicates = [" AND ".join([f'"id" >= {a}'] * (a is not None) + [f'"id" < {b}'] * (b is not None)) for a, b in edges]
    df = readers.scan_in_parts(spark, options, predicates)
    assert df.rdd.getNumPartitions() == 3 and sorted(r.id for r in df.collect()) == list(range(100))
    some = df.where(F.col("k") == 3)
    assert "PushedFilters: [*IsNotNull(k), *EqualTo(k,3)]" in some._jdf.queryExecution().executedPlan().toString() and some.count() == 14
    assert readers.scan_in_parts(spark, options, []).count() == 100


def test_declared_schema_reads_once_and_rescues(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text('id,note,amount\n1,"two\nlines",1.5\nx,odd,2.5\n3,"say ""hi""",\n4,y,many\n')
    df = readers.read_csv(spark, str(path), "amount double, ID int, gone date, note string")
    assert df.columns == ["amount", "ID", "gone", "note", "_rescued"]
    rows = {r.note: r for r in df.collect()}
    assert rows["two\nlines"].ID == 1 and rows["two\nlines"]._rescued is None and rows['say "hi"'].amount is None
    assert rows["odd"].ID is None and rows["odd"].amount == 2.5 and "x,odd" in rows["odd"]._rescued and rows["y"].amount is None
    assert tuple(readers.bad_lines(df.cache()).first()) == (4, 2)
    source = readers.read_source(spark, str(path), schema="id int, amount double")
    assert source.columns == ["id", "amount"] and source.count() == 4
    assert readers.read_csv(spark, str(path)).count() == 4  # a newline within a cell is no line
