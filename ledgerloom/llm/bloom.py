"""Bloom filters of fixed size, built by Spark and sent to the tasks.

2**BITS bits whatever the number of values: with more values more others pass, which costs time, never a result, as an
exact join follows.  Values are hashed by xxhash64 as Spark does: a long as its eight bytes, little end first, a string
as UTF-8."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import map_batches, release_memory, send

BITS, REMEMBERED = 25, 200_000


def build(values: DataFrame, column: str):
    """The filter of a long or string column as a broadcast of 4 MB."""
    h, mask = F.xxhash64(column), F.lit((1 << BITS) - 1)
    places = F.array(h.bitwiseAND(mask), F.shiftrightunsigned(h, 64 - BITS).bitwiseAND(mask))
    words = values.select(F.explode(places).alias("p")).groupBy(F.shiftright("p", 5).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(p & 31 AS INT))")).alias("b"))
    bits = np.zeros(1 << BITS - 5, np.int64)
    got = words.toArrow()  # at most as many rows as the filter has words
    bits[got["w"].to_numpy()] = got["b"].to_numpy()
    del got
    release_memory()
    return send(values.sparkSession, bits.astype(np.uint32))


def holds(bits: np.ndarray, value: bytes) -> bool:
    h = xxhash.xxh64_intdigest(value, 42)
    p, q = h & (1 << BITS) - 1, h >> 64 - BITS
    return bool(int(bits[p >> 5]) >> (p & 31) & 1 and int(bits[q >> 5]) >> (q & 31) & 1)


def tester(bits: np.ndarray):
    """string -> whether it may be in the filter; answers are remembered for a bounded number of strings."""
    known: dict[str, bool] = {}

    def may(word: str) -> bool:
        got = known.get(word)
        if got is None:
            if len(known) >= REMEMBERED:
                known.clear()
            got = known[word] = holds(bits, word.encode("utf-8", "surrogatepass"))
        return got

    return may


def rows_where(df: DataFrame, column: str, sent, inside: bool = True) -> DataFrame:
    """The rows whose long column may be in the filter, or else the others, to which nulls belong."""

    def run(batches):
        bits = sent.value
        for batch in batches:
            may = np.array([x is not None and holds(bits, x.to_bytes(8, "little", signed=True)) for x in batch[column].to_pylist()], bool)
            yield batch.filter(pa.array(may if inside else ~may, pa.bool_()))

    return map_batches(df, run, df.schema)
