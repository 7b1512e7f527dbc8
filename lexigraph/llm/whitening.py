"""Whitening of embeddings by cyclic Jacobi rotations.

The scatter about the mean is summed on the executors, batch by batch; only sums of a fixed size (dimensions squared) reach
the driver. There rotations take every pair of dimensions in turn until no entry off the diagonal is left, which keeps small
eigenvalues accurate. The matrix of components, sorted by eigenvalue, is sent to all tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigraph.llm.common import stored, table

#: Steps a unit and offset of the whole numbers that vectors are made of.
STEPS, OFFSET = 64, 1_000_000
#: Components of each row.
COMPONENTS = 16
#: Vectors of more dimensions are refused, as their scatter is summed on one machine.
MAX_DIMENSIONS = 2048
#: Rounds of rotations; each squares the entries off the diagonal, so that ten are the most that is seen.
SWEEPS = 60


def whole_vectors(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """``rows`` with x, the vector in whole steps, without rows whose vector is null, empty or holds null, NaN or infinite entries."""
    numbers = F.transform(vector, lambda c: c.cast("double"))
    usable = F.col(vector).isNotNull() & (F.size(vector) > 0) & F.forall(numbers, lambda c: c.isNotNull() & (F.abs(c) < F.lit(float("inf"))) & ~F.isnan(c))
    return rows.where(usable).withColumn("x", F.transform(numbers, lambda c: F.floor(c * STEPS) + OFFSET))


def matrix(column: pa.Array) -> np.ndarray:
    """A column of lists of one length as rows of numbers."""
    return column.flatten().to_numpy().reshape(len(column), -1)


def summed(parts: DataFrame) -> dict[str, np.ndarray]:
    """Sums by (name, position) of partial results (name, position, value), of a fixed number."""
    found: dict[str, dict[int, float]] = {}
    for r in parts.groupBy("name", "position").agg(F.sum("value").alias("value")).collect():
        found.setdefault(r["name"], {})[r["position"]] = r["value"]
    return {k: np.array([v[i] for i in range(len(v))]) for k, v in found.items()}


PARTS = "name string, position int, value double"


def parts(**arrays: np.ndarray) -> pa.RecordBatch:
    names = np.repeat(list(arrays), [a.size for a in arrays.values()])
    return pa.RecordBatch.from_arrays(
        [pa.array(names), pa.array(np.concatenate([np.arange(a.size, dtype=np.int32) for a in arrays.values()])), pa.array(np.concatenate([a.ravel() for a in arrays.values()]))],
        names=["name", "position", "value"])


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """``x`` less its mean: the mean's whole part is taken off exactly, before the numbers are rounded."""
    base = [s // n for s in sums]
    return (x - np.array(base, dtype=np.int64)).astype(np.float64) - np.array([(s - b * n) / n for s, b in zip(sums, base, strict=True)])


def scatter(vectors: DataFrame, n: int, sums: list[int]) -> np.ndarray:
    """The covariance of ``vectors`` (x), divisor n, each task sending one matrix."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(sums), len(sums)))
        for batch in batches:
            d = centred(matrix(batch.column("x")), n, sums)
            total += d.T @ d
        yield parts(v=total)

    return summed(vectors.select("x").mapInArrow(add, PARTS))["v"].reshape(len(sums), -1) / n


def jacobi(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of a symmetric matrix, falling, and their unit eigenvectors as columns.

    A rotation makes one entry off the diagonal vanish; sweeps over all of them are repeated until each is too small against the two
    entries of the diagonal to change them.
    """
    a, e = v.copy(), np.eye(len(v))
    tiny = np.finfo(float).eps
    for _ in range(SWEEPS):
        turned = False
        for p in range(len(a) - 1):
            for q in range(p + 1, len(a)):
                if abs(a[p, q]) <= tiny * np.sqrt(abs(a[p, p] * a[q, q])) or abs(a[p, q]) < 1e-300:
                    continue
                turned = True
                ratio = (a[q, q] - a[p, p]) / (2 * a[p, q])
                t = 1 / (ratio + np.copysign(np.hypot(1, ratio), ratio))
                c = 1 / np.hypot(1, t)
                s = t * c
                a[:, [p, q]] = a[:, [p, q]] @ np.array([[c, s], [-s, c]])
                a[[p, q]] = np.array([[c, -s], [s, c]]) @ a[[p, q]]
                a[p, q] = a[q, p] = 0.0
                e[:, [p, q]] = e[:, [p, q]] @ np.array([[c, s], [-s, c]])
        if not turned:
            break
    order = np.argsort(-np.diag(a), kind="stable")
    return np.diag(a)[order], e[:, order]


def whiten(rows: DataFrame, vector: str = "embedding", key: str = "vec_id", components: int = COMPONENTS) -> DataFrame:
    """For each usable row and component: the row's key, component (from 1), n, deviation, whitened, explained and identity_error.

    Fitted on each distinct vector once, so that repeated rows weigh nothing. Vectors of another length than the commonest one (of ties the
    longest) are not usable, nor are null and empty ones and those with null, NaN or infinite entries. Rows with a null key stay. Components without variance
    (eigenvalue under 1e-12 of the largest, as of a single vector) have whitened 0 and aren't part of
    identity_error. ``deviation`` is exact; a vector so far from the mean that it doesn't fit in a long ends the job with an arithmetic error.
    Without a usable row the result is empty; extra columns are left out.
    """
    spark, usable = rows.sparkSession, whole_vectors(rows, vector)
    sizes = usable.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    out = f"{key} {dict(rows.dtypes)[key]}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if not sizes:
        return spark.createDataFrame([], out)
    d = sizes[0]["d"]
    if d > MAX_DIMENSIONS:
        raise ValueError(f"vectors of {d} dimensions; at most {MAX_DIMENSIONS} are taken")
    usable = usable.where(F.size("x") == d)
    vectors = stored(usable.select("x").distinct(), "vectors")
    got = vectors.agg(F.count("*").alias("n"), *[F.sum(F.col("x")[i]).alias(f"s{i}") for i in range(d)]).collect()[0]
    n, sums = got["n"], [got[f"s{i}"] for i in range(d)]
    v = scatter(vectors, n, sums)
    values, axes = jacobi(v)
    live = values > 1e-12 * max(values[0], 0)
    shape = np.where(live, axes / np.sqrt(np.where(live, values, 1)), 0.0)[:, :components]
    explained = values[:components] / np.trace(v) if np.trace(v) > 0 else np.zeros(min(components, d))

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((shape.shape[1], shape.shape[1]))
        for batch in batches:
            w = centred(matrix(batch.column("x")), n, sums) @ shape
            total += w.T @ w
        yield parts(w=total)

    whole = summed(vectors.select("x").mapInArrow(products, PARTS))["w"].reshape(shape.shape[1], -1) / n
    error = float(np.abs(whole - np.diag(live[:components].astype(float))).max())

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = shape.shape[1]
        for batch in batches:
            w = centred(matrix(batch.column("x")), n, sums) @ shape
            many = len(batch)
            at = pa.array(np.repeat(np.arange(many), k))
            yield pa.RecordBatch.from_arrays(
                [batch.column(key).take(at), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), many)), pa.array(np.full(many * k, n)), batch.column("deviation").take(at), pa.array(w.ravel()),
                 pa.array(np.tile(explained, many)), pa.array(np.full(many * k, error))],
                names=[key, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return usable.select(key, "x", deviation("x", n, sums).alias("deviation")).mapInArrow(project, out)


def deviation(x: str, n: int, sums: list[int]) -> Column:
    """Sum over dimensions of (n * x - S) squared, in whole numbers; what doesn't fit in a long is an error."""
    parts = F.zip_with(x, F.array(*[F.lit(s).cast("decimal(38,0)") for s in sums]), lambda c, s: c.cast("decimal(19,0)") * F.lit(n).cast("decimal(19,0)") - s)
    return F.aggregate(parts, F.lit(0).cast("decimal(38,0)"), lambda total, c: (total + c * c).cast("decimal(38,0)")).cast("long")


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))
