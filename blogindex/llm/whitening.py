"""Whitening of embeddings: blockwise QR, bidiagonal singular values, one projection.

Each task reduces its centred rows to one triangular matrix, block by block. These are
merged in a tree to the triangular factor of all rows, whose right singular vectors are the
directions of the covariance; the covariance itself is never formed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blogindex.llm.common import drop_stored, stored
from blogindex.llm.curves import matrix, usable_vectors
from blogindex.llm.qd import right_singular

# Triangular factors merged by one task; entries beyond which a vector takes no part.
FAN, LARGEST = 64, float(1 << 52)
# Variances below this share of the whole are rounding errors, no components.
NOTHING = 1e-13
_SCALE, _OFFSET = 64, 1_000_000


def _whole(column: pa.Array) -> np.ndarray:
    return np.floor(_SCALE * matrix(column)).astype(np.int64) + _OFFSET


def dimension_sums(rows: DataFrame) -> tuple[int, list[int]]:
    """(number of vectors, exact sum of each dimension) of the whole-number vectors."""
    def run(batches):
        n, total = 0, None
        for batch in batches:
            if batch.num_rows:
                x = _whole(batch.column(0))
                total = x.sum(axis=0) if total is None else total + x.sum(axis=0)
                n += len(x)
        if n:
            yield pa.RecordBatch.from_pydict({
                "at": pa.array(np.arange(-1, len(total)), pa.int32()), "total": pa.array(np.concatenate([[n], total]))})

    found = rows.select("v").mapInArrow(run, "at int, total bigint").groupBy("at").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("s"))
    sums = {r["at"]: int(r["s"]) for r in found.collect()}
    return sums.pop(-1, 0), [sums[i] for i in sorted(sums)]


def _parts(n: int, sums: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Quotient and remainder of each sum by n: x - S/n is (x - quotient) - remainder / n."""
    return np.array([s // n for s in sums], np.int64), np.array([s % n for s in sums], np.int64)


def _merged(factors: Iterator[np.ndarray]) -> np.ndarray | None:
    out = None
    for rows in factors:
        out = np.linalg.qr(rows if out is None else np.vstack([out, rows]), mode="r")
    return out


def triangular_factor(rows: DataFrame, n: int, sums: list[int]) -> np.ndarray:
    """R of the QR decomposition of all centred rows; no task holds more than a block and FAN factors."""
    quotient, rest = _parts(n, sums)
    width = len(sums)

    def packed(r):
        if r is not None:
            yield pa.RecordBatch.from_pydict({"r": pa.array([r.tobytes()], pa.binary()), "rows": pa.array([len(r)], pa.int32())})

    def reduce_rows(batches):
        yield from packed(_merged((_whole(b.column(0)) - quotient) - rest / n for b in batches if b.num_rows))

    def reduce_factors(batches):
        yield from packed(_merged(np.frombuffer(r, float).reshape(-1, width)
                                  for b in batches for r in b.column(0).to_pylist()))

    schema = "r binary, rows int"
    factors = stored(rows.select("v").mapInArrow(reduce_rows, schema), "factors")
    count = factors.count()
    while count > 1:
        groups = -(-count // FAN) if count > FAN else 1
        smaller = stored(factors.repartition(groups).mapInArrow(reduce_factors, schema), "factors")
        drop_stored(factors)
        factors, count = smaller, smaller.count()
    r = np.frombuffer(factors.first()["r"], float).reshape(-1, width)
    drop_stored(factors)
    return r


def _covariance_error(rows: DataFrame, directions: np.ndarray, n: int, sums: list[int]) -> float:
    """Largest absolute entry of the whitened rows' covariance less the identity."""
    quotient, rest = _parts(n, sums)
    k = directions.shape[1]

    def run(batches):
        total = np.zeros(k * k + k)
        for batch in batches:
            if batch.num_rows:
                w = ((_whole(batch.column(0)) - quotient) - rest / n) @ directions
                total += np.concatenate([(w.T @ w).ravel(), w.sum(axis=0)])
        yield pa.RecordBatch.from_pydict({"at": pa.array(np.arange(len(total)), pa.int32()), "total": pa.array(total)})

    found = rows.select("v").mapInArrow(run, "at int, total double").groupBy("at").agg(F.sum("total").alias("s")).collect()
    total = np.zeros(k * k + k)
    for r in found:
        total[r["at"]] = r["s"]
    mean = total[k * k:] / n
    return float(np.abs(total[:k * k].reshape(k, k) / n - np.outer(mean, mean) - np.eye(k)).max())


def _deviations(x: np.ndarray, quotient: np.ndarray, rest: np.ndarray, n: int) -> list[int | None]:
    """The exact sum over dimensions of (n * x - S) squared; None where it does not fit 64 bits."""
    away = x - quotient
    if x.shape[1] * (float(np.abs(away).max(initial=0)) * n + n) ** 2 < 2.0 ** 62:
        return ((n * away - rest) ** 2).sum(axis=1).tolist()
    rest = [int(v) for v in rest]
    out = [sum((n * a - r) ** 2 for a, r in zip(row, rest)) for row in away.tolist()]
    return [v if v < 1 << 63 else None for v in out]


def whiten(rows: DataFrame, components: int = 32, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of every usable vector.

    An entry c counts as the whole number floor(64 * c) + 1,000,000. The components are the
    eigenvectors of the covariance of all usable vectors, numbered by falling eigenvalue;
    there are as many as the vectors span, and at most components. Vectors that are null,
    empty, hold null or non-finite entries or entries of 2**46 and more, or have another
    length than the commonest are left out. Repeated rows count each time, a null id stays
    null, a zero vector is a vector. A table without spread (or empty) gives no rows. A
    deviation beyond 64 bits is null. Other columns are ignored.
    """
    usable = usable_vectors(rows, key, vector, zero=True) \
        .filter(F.forall("v", lambda x: F.abs(x.cast("double")) * _SCALE < LARGEST))
    schema = ("vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, "
              "identity_error double")
    n, sums = dimension_sums(usable)
    if n:
        squares, directions = right_singular(triangular_factor(usable, n, sums))
        kept = int((squares[:components] > NOTHING * squares.sum()).sum())
    if not n or not kept:
        return rows.sparkSession.createDataFrame([], schema)
    scaled = directions[:, :kept] / np.sqrt(squares[:kept] / n)
    error = _covariance_error(usable, scaled, n, sums)
    explained = squares[:kept] / squares.sum()
    quotient, rest = _parts(n, sums)

    def run(batches):
        for batch in batches:
            for low in range(0, batch.num_rows, 2000):
                part = batch.slice(low, 2000)
                x = _whole(part.column(1))
                white = ((x - quotient) - rest / n) @ scaled
                row = pa.array(np.repeat(np.arange(len(x)), kept))
                count = len(x) * kept
                yield pa.RecordBatch.from_arrays([
                    part.column(0).take(row), pa.array(np.tile(np.arange(1, kept + 1, dtype=np.int32), len(x))),
                    pa.array(np.full(count, n)), pa.array(_deviations(x, quotient, rest, n), pa.int64()).take(row),
                    pa.array(white.ravel()), pa.array(np.tile(explained, len(x))), pa.array(np.full(count, error))],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return usable.select("id", "v").mapInArrow(run, schema)
