import os
import random

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(11)
    tongues = {"aa": ["la", "lo", "mi"], "bb": ["ku", "ko", "zed"]}

    def words(lang, n):
        return ["".join(rng.choice(tongues[lang]) for _ in range(rng.randrange(2, 9))) + str(rng.randrange(9)) * rng.randrange(2) for _ in range(n)]

    rows, passage = [], words("aa", 70)
    for i in range(200):
        lang = "aa" if i % 3 else "bb"
        text = words(lang, rng.randrange(80, 200))
        if i in (30, 60, 90):
            text[20:20] = passage
        rows.append([i, " ".join(text), lang, "s"])
    rows[5][1] = "12345 !!! 678"
    rows[6][1] = None
    rows[50][1] = rows[40][1]  # an exact copy
    near = rows[41][1].split()
    near[10] = "xyz"
    rows[51][1] = " ".join(near)  # a near copy
    rows[70][1] += " write to jane.roe@mail.example soon"
    folder = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame([(*r, len(r[1]) if r[1] else None) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(folder / "documents.parquet"))
    return rows, str(folder)


def test_stages(spark, corpus, tmp_path):
    rows, folder = corpus
    texts = {r[0]: r[1] for r in rows}
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, folder).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept[name] = docs
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    ids = {name: {r.doc_id for r in df.select("doc_id").collect()} for name, df in kept.items()}
    assert set(texts) - ids["language"] == {5, 6}
    assert ids["language"] - ids["near_copies"] == {50, 51}
    assert ids["near_copies"] == ids["repeats"] == ids["private"] == ids["sequences"]
    after = {r.doc_id: r.text for r in kept["repeats"].collect()}
    assert {k for k in after if after[k] != texts[k]} == {60, 90}
    assert {r.doc_id: r.text for r in kept["private"].collect()}[70].endswith("write to [EMAIL] soon")


def test_run_equals_its_stages(spark, corpus):
    _, folder = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, folder)
    pieces = lambda df: sorted((r.doc_id, r.piece, r.length, r.ids_crc32) for r in df.collect())
    assert pieces(corpus_pipeline.run(spark, folder)) == pieces(corpus_pipeline.STAGES[4][1](spark, docs, folder))


def test_odd_rows_and_clashing_columns(spark, odd_docs, tmp_path):
    """Nulls, repeated rows, and extra columns with the operators' names go through the chain."""
    plain = "the plain words of this text are long enough to be told from all of the others"
    more = spark.createDataFrame([(100 + i, f"{plain} number {'abcdefgh'[i] * 3} {i}", "en") for i in range(8)], "doc_id long, text string, lang string")
    docs = odd_docs.unionByName(more, allowMissingColumns=True)
    wide, columns = docs.unionByName(docs.where("doc_id = 9")), docs.columns
    for name, stage in corpus_pipeline.STAGES[:4]:
        stage(spark, wide, "").write.parquet(str(tmp_path / name))
        wide = spark.read.parquet(str(tmp_path / name))
        assert wide.columns == columns
    ids = [r.doc_id for r in wide.select("doc_id").collect()]
    assert len(ids) == len(set(ids)) and 2 not in ids and 3 not in ids
    last = corpus_pipeline.STAGES[4][1](spark, wide, "").collect()
    assert {r.doc_id for r in last} == set(ids)


def test_what_a_stage_held_goes_and_no_more(spark):
    from ledgerloom.llm import common

    mine = common.send(spark, b"mine")
    since = common.held()
    other = common.send(spark, b"other")
    table = common.stored(spark.range(3))
    common.forget(spark, since)
    assert common.held() == since and mine.value == b"mine"
    assert spark.range(1).rdd.map(lambda _: mine.value).collect() == [b"mine"]
    with pytest.raises(Exception, match="(?i)destroyed"):
        spark.range(1).rdd.map(lambda _: other.value).collect()
    assert not os.path.exists(table.inputFiles()[0].removeprefix("file:"))


def test_a_passing_table_goes_at_its_end(spark):
    from ledgerloom.llm import common

    since = common.held()
    with common.passing(spark.range(3)) as table:
        path = table.inputFiles()[0].removeprefix("file:")
        assert table.count() == 3 and os.path.exists(path)
    assert common.held() == since and not os.path.exists(path)


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
