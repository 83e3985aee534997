import gc
import os
import random
import time

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, and extra columns with names the operators use."""
    rng = random.Random(7)
    words = ["alpha", "beta", "gamma", "delta", "Straße", "été", "naïve", "x", "1234", "foo@bar.example"]
    long = " ".join(rng.choice(words) for _ in range(20_000))
    rows = [
        (1, "plain words here", "en", "s", 16), (2, None, "en", "s", None), (3, "", "de", None, 0), (4, long, "en", "s", len(long)), (5, "plain words here", "en", "s", 16),
        (None, "plain words here", "en", "s", 16), (None, None, None, None, None), (7, "  \n\t ", "fr", "s", 5), (8, "!!! 12 ??", "en", "s", 9),
        (9, "same row", "en", "s", 8), (9, "same row", "en", "s", 8), (10, "emoji 😀 中文 <|endoftext|>  end", "en", "s", 20), (-5, "negative id", None, "s", 11),
    ]
    extra = "key binary, fp long, media binary, page int, score double, lang_pred string, piece int, bucket long, row_hash long, passage_of long"
    return spark.createDataFrame([r + (b"k", 1, b"m", 2, 0.5, "zz", 3, 4, 5, 6) for r in rows], f"{SCHEMA}, {extra}")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)


@pytest.fixture(scope="session")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def texts(docs):
    return {r.doc_id: r.text for r in docs.collect()}


@pytest.fixture
def shuffle_files_of(spark):
    """What a function returns, and the shuffle files that it wrote and that stay for 20 seconds, though nothing is collected as garbage here."""
    folders = [d.getPath() for d in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    files = lambda: {f for d in folders for _, _, names in os.walk(d) for f in names if f.startswith("shuffle_")}

    def run(f):
        gc.disable()
        try:
            before, out, end = files(), f(), time.monotonic() + 20
            while (stayed := files() - before) and time.monotonic() < end:
                time.sleep(0.2)
            return out, stayed
        finally:
            gc.enable()

    return run
