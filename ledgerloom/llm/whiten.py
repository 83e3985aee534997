"""Whitening of embeddings: the leading components of their covariance, found by a randomised range finder.

A random basis of ``k + OVERSAMPLE`` directions is multiplied by the covariance V in a pass over all centred rows, made
orthonormal, and multiplied again.  Every pass also gives the Rayleigh-Ritz step for the basis it was given: with Y = V Q,
the eigenpairs of Q'Y are the Ritz values and, turned by Q, the components; |V u - e u| is their residual.  Once every
wanted component's residual is ``TOLERANCE`` of its distance from its neighbours, passes end.  If they aren't after
``PASSES``, as with values that fall slowly, the basis is expanded to the full dimension: one pass then gives V itself and
Rayleigh-Ritz its eigenvectors to double precision.

A pass is one aggregate: tasks sum the products of their own rows in Arrow batches, cells of these sums are added by
Spark, and the driver gets the sum, whose size is that of the basis, whatever the number of rows.  Sums of rows are exact
whole numbers, and rows are centred as (n x - S) / n before they are multiplied.

Defined cases: a vector that is null, or holds a null or a non-finite entry, takes no part; a null id is kept; repeated
rows count and come out as often as they are there; vectors of unequal length are taken as if padded with entries 0;
scaled entries beyond 2**49 count as that; a deviation that is no long is null; components whose value is 0, for rounding, don't
exist, so that equal vectors, or one, give no row; equal values have some orthonormal components; an empty table gives no
row; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ledgerloom.llm.common import DBL, INT, LONG, map_batches, struct

K, OVERSAMPLE, PASSES, TOLERANCE, SEED = 8, 8, 4, 1e-10, 7
SCALE, SHIFT, LARGEST = 1024, 100_000, 1 << 49
WIDE = T.DecimalType(38, 0)


@dataclass(frozen=True)
class Model:
    """n rows with sums S by dimension; components (a column each) and their values, falling; trace of the covariance."""

    n: int
    sums: tuple[int, ...]
    components: np.ndarray
    values: np.ndarray
    trace: float
    passes: int
    expanded: bool


def whole(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding of the vectors that take part."""
    x = F.col("embedding")
    finite = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != F.lit(float("inf"))))
    return vectors.where(x.isNotNull() & finite).select("vec_id", "embedding")


def entries(column: pa.Array, d: int) -> np.ndarray:
    """floor(1024 c) + 100000 of each entry, int64, rows padded with entries 0 to d."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    flat = np.clip(np.floor(SCALE * flat), -LARGEST, LARGEST).astype(np.int64) + SHIFT
    if len(sizes) and (sizes == d).all():
        return flat.reshape(-1, d)
    out = np.full((len(sizes), d), SHIFT, np.int64)
    out[np.arange(d) < sizes[:, None]] = flat
    return out


def _parts(batches, rows: int = 8192) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield from (batch.slice(i, rows) for i in range(0, batch.num_rows, rows))


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """x - S / n as (n x - S) / n, exact before the division."""
    return _spread(x, n, sums).astype(np.float64) / n


def _spread(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n x - S, exact: in longs where they hold it, else in Python's integers."""
    most = n * max(1, int(np.abs(x).max(initial=0))) + int(max((abs(int(s)) for s in sums), default=0))
    return n * x - sums.astype(np.int64) if most < 1 << 62 else n * x.astype(object) - sums.astype(object)


def _sums(rows: DataFrame) -> tuple[int, np.ndarray]:
    d = rows.agg(F.coalesce(F.max(F.size("embedding")), F.lit(0))).first()[0]
    schema = struct(dimension=INT, total=WIDE)

    def run(batches):
        n, total = 0, np.zeros(d, object)
        for batch in _parts(batches):
            n += batch.num_rows
            total = total + entries(batch["embedding"], d).sum(axis=0)  # 8192 rows of at most 2**49 and a little each
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(-1, d), pa.int32()), pa.array([Decimal(int(t)) for t in (n, *total)], pa.decimal128(38, 0))], schema=to_arrow_schema(schema))

    got = {r[0]: int(r[1]) for r in map_batches(rows.select("embedding"), run, schema).groupBy("dimension").agg(F.sum("total")).collect()}  # d + 1 rows
    return got.get(-1, 0), np.array([got.get(i, 0) for i in range(d)], object)


CELLS = struct(cell=LONG, value=DBL)


def _added(rows: DataFrame, make, cells: int) -> np.ndarray:
    """The sum over all rows of an array of so many cells; make: batch -> that array.  cells depends on the dimension only."""

    def run(batches):
        total = None
        for batch in _parts(batches):
            part = make(batch)
            total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(cells)), pa.array(total)], schema=to_arrow_schema(CELLS))

    out = np.zeros(cells)
    for r in map_batches(rows.select("embedding"), run, CELLS).groupBy("cell").agg(F.sum("value").alias("value")).toLocalIterator():
        out[r.cell] = r.value
    return out


def covariance_times(rows: DataFrame, n: int, sums: np.ndarray, basis: np.ndarray | None) -> tuple[np.ndarray, float]:
    """V times the basis (None: all of the space) and the trace of V, by one pass over the centred rows."""
    d = len(sums)
    width = d if basis is None else basis.shape[1]

    def make(batch: pa.RecordBatch) -> np.ndarray:
        c = centred(entries(batch["embedding"], d), n, sums)
        return np.append((c.T @ (c if basis is None else c @ basis)).ravel(), (c * c).sum())

    got = _added(rows, make, d * width + 1) / n
    return got[:-1].reshape(d, width), float(got[-1])


def _ritz(basis: np.ndarray, product: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, bool]:
    """The k leading values and components within a basis, and whether they are components of V to the tolerance."""
    small = basis.T @ product
    values, turn = np.linalg.eigh((small + small.T) / 2)
    values, turn = values[::-1], turn[:, ::-1]
    components = basis @ turn
    residual = np.linalg.norm(product @ turn - components * values, axis=0)
    gaps = np.abs(values[:, None] - values)[:k] + np.where(np.eye(len(values), dtype=bool), np.inf, 0)[:k]
    near = gaps.min(axis=1, initial=np.inf)
    return values[:k], components[:, :k], bool((residual[:k] <= TOLERANCE * np.minimum(near, np.maximum(values[:k], 0))).all())


def fit(rows: DataFrame, k: int = K, oversample: int = OVERSAMPLE, passes: int = PASSES, seed: int = SEED) -> Model:
    """rows: embedding, as ``whole`` gives them."""
    n, sums = _sums(rows)
    d = len(sums)
    if not n or not d:
        return Model(n, tuple(int(s) for s in sums), np.zeros((d, 0)), np.zeros(0), 0.0, 0, False)
    width, done, found, trace = min(d, k + oversample), 0, False, 0.0
    values, components = np.zeros(0), np.zeros((d, 0))
    if width < d:
        basis = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, width)))[0]
        while done < passes and not found:
            product, trace = covariance_times(rows, n, sums, basis)
            values, components, found = _ritz(basis, product, min(k, d))
            basis, done = np.linalg.qr(product)[0], done + 1
    if not found:
        product, trace = covariance_times(rows, n, sums, None)
        values, components, _ = _ritz(np.eye(d), product, min(k, d))
        done += 1
    real = values > max(trace, 0.0) * d * np.finfo(float).eps
    return Model(n, tuple(int(s) for s in sums), components[:, real], values[real], trace, done, not found)


def whitener(model: Model):
    """Arrays of embeddings -> their whitened coordinates."""
    sums, turn = np.array(model.sums, object), model.components / np.sqrt(model.values)
    return lambda column: centred(entries(column, len(sums)), model.n, sums) @ turn


def identity_error(rows: DataFrame, model: Model) -> float:
    """The largest absolute entry of the whitened rows' covariance minus the identity, measured on the rows."""
    k = len(model.values)
    if not k:
        return 0.0
    apply = whitener(model)

    def make(batch: pa.RecordBatch) -> np.ndarray:
        w = apply(batch["embedding"])
        return np.concatenate([w.sum(axis=0), (w.T @ w).ravel()])  # whitened rows are centred, so this doesn't cancel

    got = _added(rows, make, k + k * k) / model.n
    mean = got[:k]
    return float(np.abs(got[k:].reshape(k, k) - np.outer(mean, mean) - np.eye(k)).max())


WHITENED = struct(vec_id=LONG, component=INT, n=LONG, deviation=LONG, whitened=DBL, explained=DBL, identity_error=DBL)


def whitened(rows: DataFrame, model: Model, error: float) -> DataFrame:
    """A row for each vector and component (WHITENED)."""
    schema, k, sums, apply = to_arrow_schema(WHITENED), len(model.values), np.array(model.sums, object), whitener(model)
    explained = model.values / model.trace if k else np.zeros(0)
    n = model.n

    def deviations(x: np.ndarray) -> list[int | None]:
        spread = _spread(x, n, sums)
        if spread.dtype == object or len(sums) * int(np.abs(spread).max(initial=0)) ** 2 >= 1 << 63:
            return [v if (v := sum(int(e) ** 2 for e in row)) < 1 << 63 else None for row in spread]
        return (spread * spread).sum(axis=1).tolist()

    def run(batches):
        for batch in _parts(batches, 1024):
            m, x = batch.num_rows, entries(batch["embedding"], len(sums))
            repeat = pa.array(np.repeat(np.arange(m), k))
            columns = [
                batch["vec_id"].take(repeat), pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()), pa.array(np.full(m * k, n)), pa.array(deviations(x), pa.int64()).take(repeat),
                pa.array(apply(batch["embedding"]).ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    if not k:
        return rows.sparkSession.createDataFrame([], WHITENED)
    return map_batches(rows.select(F.col("vec_id").cast("long"), "embedding"), run, WHITENED)


def op11_whiten(vectors: DataFrame, k: int = K) -> DataFrame:
    rows = whole(vectors)
    model = fit(rows, k)
    return whitened(rows, model, identity_error(rows, model))
