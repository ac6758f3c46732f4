"""Embedding whitening: blockwise QR of centred rows, a bidiagonal qd solver, directions from twisted factorisations.

The fit list is each distinct quantised vector once. Its sums are exact integers; rows centred by them are reduced by QR
block by block, to one triangle a task, and triangles are stacked and reduced again, a bounded number at a time, until one
is left. Only that triangle, as wide as a vector, comes to the driver, where ``bidiagonal`` finds the singular values and
the directions of the largest. No covariance is formed, so that small components keep their accuracy. A last pass over the
fit list measures how far the whitened values' covariance is from the identity.

Rows whose vector is null or holds a null, NaN or infinite component take no part; shorter vectors count as filled up with
zeros; repeated rows each get their values, and count once in the fit. Components without variance are left out, as there
is nothing to whiten, so a table of one distinct vector gives no rows. A deviation beyond 64 bits is null.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.bidiagonal import EPS, right_vectors
from ledgerloom.llm.shared import materialize

UNIT = 256
COMPONENTS = 4
#: Rows reduced at once, and triangles stacked at once.
BLOCK, STACK = 2048, 16


def quantised(table: DataFrame, vector: str = "embedding", unit: int = UNIT, keep: tuple[str, ...] = ("vec_id",)) -> DataFrame:
    """(keep, x): floor(unit * component) of the rows that take part."""
    finite = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    x = F.transform(vector, lambda c: F.floor(c.cast("double") * unit).cast("bigint"))
    return table.where(F.col(vector).isNotNull() & finite).select(*keep, x.alias("x"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - sums, exact: 64-bit integers, or Python's where those might not do."""
    top = max(int(np.abs(x).max(initial=0)) * n, *map(abs, sums), 0)
    wide = np.int64 if top < 1 << 61 else object
    return x.astype(wide) * n - np.array(sums, wide)


def _sums(fit: DataFrame, width: int) -> tuple[int, list[int]]:
    """(rows, exact sum of each dimension); a row a dimension comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros(width, object), 0
        for batch in batches:
            x = _matrix(batch.column("x"), width)
            safe = int(np.abs(x).max(initial=0)) * len(x) < 1 << 62
            total, rows = total + (x if safe else x.astype(object)).sum(axis=0).astype(object), rows + len(x)
        yield pa.record_batch([pa.array(np.arange(width + 1)), pa.array([*map(str, total), str(rows)])], ["dimension", "total"])

    found = fit.select("x").mapInArrow(run, "dimension long, total string").groupBy("dimension").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()
    by = {r.dimension: int(r.total) for r in found}
    return by.get(width, 0), [by.get(i, 0) for i in range(width)]


def _triangle(stacked: np.ndarray, width: int) -> np.ndarray:
    r = np.linalg.qr(stacked, mode="r")
    return r if len(r) == width else np.vstack([r, np.zeros((width - len(r), width))])


def triangle(fit: DataFrame, n: int, sums: list[int]) -> np.ndarray:
    """R of the QR factorisation of the fit list's centred rows."""
    width = len(sums)

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r, some = np.zeros((width, width)), False
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                x = _matrix(batch.column("x").slice(at, BLOCK), width)
                r, some = _triangle(np.vstack([r, (_centred(x, n, sums) / n).astype(np.float64)]), width), True
        if some:
            yield pa.record_batch([pa.array([r.tobytes()], pa.binary())], ["r"])

    def stack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r, some = np.zeros((width, width)), False
        for batch in batches:
            for one in batch.column("r"):
                r, some = _triangle(np.vstack([r, np.frombuffer(one.as_py()).reshape(width, width)]), width), True
        if some:
            yield pa.record_batch([pa.array([r.tobytes()], pa.binary())], ["r"])

    parts = fit.select("x").mapInArrow(reduce, "r binary")
    tasks = fit.rdd.getNumPartitions()
    while tasks > 1:
        tasks = -(-tasks // STACK)
        parts = parts.repartition(tasks).mapInArrow(stack, "r binary")
    held = parts.collect()
    r = np.zeros((width, width))
    for row in held:
        r = _triangle(np.vstack([r, np.frombuffer(row.r).reshape(width, width)]), width)
    return r


@dataclass
class Whitening:
    """``directions`` (width x components) are unit eigenvectors of the fit list's covariance, ``values`` their eigenvalues, falling."""

    n: int
    sums: list[int]
    directions: np.ndarray
    values: np.ndarray
    trace: float
    identity_error: float = 0.0

    def of(self, x: np.ndarray) -> np.ndarray:
        """The whitened values (rows x components) of quantised vectors."""
        return (_centred(x, self.n, self.sums) / self.n).astype(np.float64) @ self.directions / np.sqrt(self.values)


def _identity_error(fit: DataFrame, model: Whitening) -> float:
    """The largest entry of the whitened fit list's covariance less the identity; each task hands on its sums."""
    width, k = len(model.sums), len(model.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, square = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            w = model.of(_matrix(batch.column("x"), width))
            total, square = total + w.sum(axis=0), square + w.T @ w
        yield pa.record_batch([pa.array(np.arange(k + k * k)), pa.array(np.r_[total, square.reshape(-1)])], ["at", "total"])

    rows = fit.select("x").mapInArrow(run, "at long, total double").groupBy("at").agg(F.sum("total").alias("total")).collect()
    flat = np.zeros(k + k * k)
    for r in rows:
        flat[r["at"]] = r.total
    mean = flat[:k] / model.n
    return float(np.abs(flat[k:].reshape(k, k) / model.n - np.outer(mean, mean) - np.eye(k)).max(initial=0.0))


def fit_whitening(vectors: DataFrame, width: int, components: int = COMPONENTS) -> Whitening:
    """The whitening of the distinct x of ``vectors``, with at most ``components`` directions."""
    fit = materialize(vectors.select("x").distinct(), "fit")
    n, sums = _sums(fit, width)
    if not n or not width:
        return Whitening(n, sums, np.zeros((width, 0)), np.zeros(0), 0.0)
    squares, directions = right_vectors(triangle(fit, n, sums), components)
    # What rounding leaves of components without variance stays below this.
    some = squares[: directions.shape[1]] > squares[0] * (EPS * max(width, 16)) ** 2
    model = Whitening(n, sums, directions[:, some], squares[: len(some)][some] / n, float(squares.sum()) / n)
    model.identity_error = _identity_error(fit, model)
    return model


def whiten(vectors: DataFrame, model: Whitening) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): a row for each vector and component."""
    width, k = len(model.sums), len(model.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                x = _matrix(part.column("x"), width)
                off = _centred(x, model.n, model.sums)
                safe = off.dtype != object and int(np.abs(off).max(initial=0)) ** 2 * width < 1 << 63
                deviation = ((off if safe else off.astype(object)) ** 2).sum(axis=1)
                fits = np.array([d < 1 << 63 for d in deviation]) if not safe else np.ones(len(deviation), bool)
                deviation = np.where(fits, deviation, 0).astype(np.int64)
                each = np.repeat(np.arange(len(x)), k)
                yield pa.record_batch(
                    [
                        part.column("vec_id").take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(len(each), model.n)),
                        pa.array(deviation[each], mask=~fits[each]), pa.array(model.of(x).reshape(-1)), pa.array(np.tile(model.values / (model.trace or 1.0), len(x))), pa.array(np.full(len(each), model.identity_error)),
                    ],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    kind = vectors.schema["vec_id"].dataType.simpleString()
    return vectors.select("vec_id", "x").mapInArrow(run, f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")


def whitened(table: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """``whiten`` of ``table`` (vec_id, a vector) by its own fit."""
    rows = quantised(table, vector)
    width, narrow = rows.agg(F.max(F.size("x")), F.min(F.size("x"))).first()
    if narrow != width:
        rows = rows.withColumn("x", F.concat("x", F.array_repeat(F.lit(0).cast("bigint"), F.lit(width) - F.size("x"))))
    return whiten(rows, fit_whitening(rows, width or 0, components))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four leading whitened components of every vector of ``embeddings``."""
    return whitened(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
