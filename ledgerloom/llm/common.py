"""Helpers that the corpus operators share."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import tempfile
import uuid
import weakref
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: What goes to Python at a time.
BATCH_BYTES = "4m"
#: What a task holds of a stored table before it writes.
ROW_GROUP = 16 << 20

LONG, INT, STR, BIN, DBL, BOOL = T.LongType(), T.IntegerType(), T.StringType(), T.BinaryType(), T.DoubleType(), T.BooleanType()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see: spark.checkpoint.dir, or a temporary one where it is unset (tests on one machine)."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if named is None:
        named = sc.getCheckpointDir()
    if named is None:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="checkpoints-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return named


def durable(df: DataFrame) -> DataFrame:
    """Cuts the lineage through the shared checkpoint folder, so that a lost executor costs no recomputation of what lies before."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def tidy(spark: SparkSession) -> None:
    """From now on a query's shuffle files go when it ends, not when the driver happens to collect its garbage: operators of many steps would else fill the disk with what no step reads any more."""
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


_tables: list[str] = []
#: Weak, so that a broadcast that nothing uses any more also goes by itself.
_sent: list[weakref.ref[Broadcast]] = []


def send(spark: SparkSession, value) -> Broadcast:
    """A broadcast that ``forget`` takes from the executors and the driver."""
    sent = spark.sparkContext.broadcast(value)
    _sent.append(weakref.ref(sent))
    return sent


def stored(df: DataFrame) -> DataFrame:
    """Cuts the lineage by a table in the shared folder, which takes less room than a checkpoint for many narrow rows.  ``forget`` removes such tables."""
    return _store(df)[0]


@contextlib.contextmanager
def passing(df: DataFrame) -> Iterator[DataFrame]:
    """A stored table that goes at the end of the block, when what reads it must be written."""
    out, folder = _store(df)
    try:
        yield out
    finally:
        remove(df.sparkSession, folder)
        _tables.remove(folder)


def _store(df: DataFrame) -> tuple[DataFrame, str]:
    spark = df.sparkSession
    folder = f"{shared_dir(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    if not _tables:
        atexit.register(forget, spark)
    _tables.append(folder)
    df.write.option("parquet.block.size", ROW_GROUP).parquet(folder)
    return spark.read.schema(df.schema).parquet(folder), folder


def held() -> tuple[int, int]:
    """How many tables and broadcasts are held now, for ``forget``."""
    return len(_tables), len(_sent)


def forget(spark: SparkSession, since: tuple[int, int] = (0, 0)) -> None:
    """Removes the tables stored and the broadcasts sent since then, or all; what is read from them must be written by now.  Done at the end of the driver."""
    while len(_sent) > since[1]:
        sent = _sent.pop()()
        with contextlib.suppress(Exception):  # a stopped session can't destroy them
            if sent is not None:
                sent.destroy()
    while len(_tables) > since[0]:
        with contextlib.suppress(Exception):  # nor remove these
            remove(spark, _tables[-1])
        _tables.pop()
    if not _tables:
        atexit.unregister(forget)


def remove(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def arrow_batches(rows: Iterable[tuple], schema: pa.Schema, max_rows: int = 2048, max_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Packs tuples into record batches that stay small however long single values are."""
    held: list[tuple] = []
    size = 0
    for row in rows:
        held.append(row)
        size += sum(len(x) for x in row if isinstance(x, (str, bytes)))
        if len(held) >= max_rows or size >= max_bytes:
            yield _batch(held, schema)
            held, size = [], 0
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(col, type=f.type) for col, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def free_name(name: str, taken: list[str]) -> str:
    """A name that none of the taken ones is, in any case, as Spark's columns are."""
    taken = {t.lower() for t in taken}
    while name.lower() in taken:
        name += "_"
    return name


def map_rows(df: DataFrame, make_rows, schema: T.StructType) -> DataFrame:
    """mapInArrow over tuples: make_rows turns an iterator of input tuples into an iterator of output tuples."""
    arrow = to_arrow_schema(schema)

    return map_batches(df, lambda batches: arrow_batches(make_rows(_tuples(batches)), arrow), schema)


def map_batches(df: DataFrame, make_batches, schema: T.StructType) -> DataFrame:
    """mapInArrow in batches of BATCH_BYTES, whatever the length of texts; a task gives back its memory when it ends, as its Python process serves later tasks."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)

    def run(batches):
        try:
            yield from make_batches(batches)
        finally:
            release_memory()

    return df.mapInArrow(run, schema)


def release_memory() -> None:
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def _tuples(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for start in range(0, batch.num_rows, 256):
            yield from zip(*(c.to_pylist() for c in batch.slice(start, 256).columns), strict=True)


def whole_keys(batches, keys: list[str], rows: int = 1 << 16) -> Iterator[pa.Table]:
    """Tables of about so many rows from batches sorted by the keys, never cut within a key."""
    held: list[pa.RecordBatch] = []
    size, limit = 0, rows
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= limit:
            t = pa.Table.from_batches(held).combine_chunks()
            differs = np.zeros(t.num_rows, bool)
            for k in keys:
                c = t[k].to_numpy()
                differs |= c != c[-1]
            cut = int(np.flatnonzero(differs)[-1]) + 1 if differs.any() else 0
            if cut:
                yield t.slice(0, cut)
            held, size = t.slice(cut).combine_chunks().to_batches(), t.num_rows - cut
            limit = max(rows, 2 * size)
    if size:
        yield pa.Table.from_batches(held).combine_chunks()
