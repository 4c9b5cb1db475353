"""Embedding whitening by spectral divide and conquer.

Spark makes the covariance: exact integer sums for the mean, then one Gram matrix per task
of rows centred before they are multiplied. The driver splits that d x d matrix: the polar
factor of a shifted covariance is the sign of its eigenvalues, half of its sum with the
identity projects on the subspace of the larger ones, and both subspaces are split again
until each is a component. The d x k whitening matrix goes to the tasks with the UDF.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from ledgerfold.llm.common import ship
from ledgerfold.session import stored

#: Of an entry c: floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 64, 1_000_000
#: An entry whose scaled value does not fit a long with room for a difference is no number
#: that can be centred exactly.
MOST_SCALED = float(1 << 61)
#: Columns of a Gram matrix in one row of a task's partial result.
WIDE = 16
#: The largest sum of 64-bit integers that is taken without Python's own integers.
SAFE = 1 << 40
EPS = float(np.finfo(np.float64).eps)


# ---- the split of a symmetric matrix, on the driver


def sign(a: np.ndarray) -> np.ndarray:
    """The orthogonal polar factor of a symmetric matrix by dynamically weighted Halley
    steps: QR while the weights are large, Cholesky after. At most six or seven steps,
    whatever the condition; eigenvalues below rounding have no sign."""
    size = len(a)
    x = a / max(np.linalg.norm(a), np.finfo(np.float64).tiny)
    low, eye = EPS, np.eye(size)
    for _ in range(12):
        square = low * low
        d = (4 * (1 - square) / (square * square)) ** (1 / 3)
        root = np.sqrt(1 + d)
        wa = root + np.sqrt(8 - 4 * d + 8 * (2 - square) / (square * root)) / 2
        wb = (wa - 1) ** 2 / 4
        wc = wa + wb - 1
        if wc > 100:
            q, _ = np.linalg.qr(np.vstack([np.sqrt(wc) * x, eye]))
            new = wb / wc * x + (wa - wb / wc) / np.sqrt(wc) * (q[:size] @ q[size:].T)
        else:
            new = wb / wc * x + (wa - wb / wc) * np.linalg.solve(eye + wc * (x.T @ x), x.T).T
        low = min(1.0, low * (wa + wb * square) / (1 + wc * square))
        moved, x = np.linalg.norm(new - x), (new + new.T) / 2
        if low >= 1 - 4 * EPS and moved <= EPS ** (1 / 3):
            break
    return x


def _halves(a: np.ndarray, scale: float) -> tuple[np.ndarray, np.ndarray] | None:
    """Orthonormal bases of the subspaces of the larger and the smaller eigenvalues; None
    if all are equal up to rounding. Of several shifts the first is taken that leaves
    nothing between the two, or else the one that leaves least."""
    size, mean = len(a), np.trace(a) / len(a)
    spread = np.linalg.norm(a - mean * np.eye(size))
    if spread <= 4 * EPS * size * scale:
        return None
    noise = np.random.default_rng(size).standard_normal((size, size))
    best, least = None, np.inf
    step = spread / np.sqrt(size)
    for shift in (mean, np.median(np.diag(a)), *(mean + f * step for f in (0.11, -0.13, 0.37, -0.41, 0.71, -0.73))):
        projector = (sign(a - shift * np.eye(size)) + np.eye(size)) / 2
        rank = int(round(np.trace(projector)))
        if not 0 < rank < size:
            continue
        upper = projector @ noise[:, :rank]
        lower = noise[:, rank:] - projector @ noise[:, rank:]
        for _ in range(2):
            q, _ = np.linalg.qr(np.hstack([upper, lower]))
            upper, lower = projector @ q[:, :rank], q[:, rank:] - projector @ q[:, rank:]
        q, _ = np.linalg.qr(np.hstack([upper, lower]))
        upper, lower = q[:, :rank], q[:, rank:]
        between = np.linalg.norm(lower.T @ a @ upper)
        if between < least:
            best, least = (upper, lower), between
        if between <= 8 * EPS * size * scale:
            break
    return best


def leading(a: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``most`` largest eigenvalues of a symmetric matrix, falling, and their unit
    eigenvectors as columns; the largest entry of each is positive. Subspaces that only
    hold smaller ones are not split any further."""
    scale = float(np.linalg.norm(a))

    def split(block: np.ndarray, basis: np.ndarray, wanted: int) -> list[np.ndarray]:
        halves = _halves(block, scale) if len(block) > 1 else None
        if halves is None:
            return [basis[:, i] for i in range(basis.shape[1])]
        found: list[np.ndarray] = []
        for half in halves:
            if len(found) < wanted:
                own = half.T @ block @ half
                found += split((own + own.T) / 2, basis @ half, wanted - len(found))
        return found

    columns = np.array(split(a, np.eye(len(a)), most)).T.reshape(len(a), -1)
    values = np.einsum("ij,ij->j", columns, a @ columns) / np.einsum("ij,ij->j", columns, columns)
    order = np.argsort(-values, kind="stable")[:most]
    values, columns = values[order], columns[:, order] / np.linalg.norm(columns[:, order], axis=0)
    return values, columns * np.where(columns[np.abs(columns).argmax(axis=0), np.arange(columns.shape[1])] < 0, -1.0, 1.0)


# ---- on Spark


@dataclass(frozen=True)
class Whitening:
    """``x`` minus the mean (``base`` + ``rest`` / ``n``, in integers), times ``matrix``."""

    n: int
    base: tuple[int, ...]
    rest: tuple[int, ...]
    matrix: np.ndarray
    eigenvalues: np.ndarray
    trace: float
    identity_error: float


def scaled(vector: Column) -> Column:
    """x of a vector; null if it is null, empty, or holds null, non-finite or too large
    entries."""
    entry = lambda c: c.cast("double") * SCALE
    odd = F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(entry(c)) > MOST_SCALED))
    return F.when((F.size(vector) > 0) & ~odd, F.transform(vector, lambda c: F.floor(entry(c)) + F.lit(SHIFT).cast("long")))


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def _centred(x: np.ndarray, base: np.ndarray, part: np.ndarray) -> np.ndarray:
    """x minus the mean: integers are subtracted first, so no digit of a deviation goes."""
    return (x - base).astype(np.float64) - part


def _sums(fit: DataFrame, size: int) -> tuple[int, list[int]]:
    """Rows and exact sums per dimension: one row per dimension and task, added by Spark."""

    def run(batches):
        n, total = 0, np.zeros(size, object)
        for batch in batches:
            x = _matrix(batch.column(0), size)
            if len(x):
                n += len(x)
                total = total + (x.sum(axis=0) if np.abs(x).max() < SAFE else x.astype(object).sum(axis=0)).astype(object)
        rows = {"i": pa.array(range(size), pa.int32()), "s": pa.array([Decimal(int(t)) for t in total], pa.decimal128(38, 0)), "n": pa.array([n] * size, pa.int64())}
        yield pa.RecordBatch.from_pydict(rows)

    parts = fit.mapInArrow(run, "i int, s decimal(38,0), n bigint").groupBy("i").agg(F.sum("s").cast("decimal(38,0)").alias("s"), F.sum("n").alias("n"))
    rows = sorted(parts.collect())  # one per dimension
    return rows[0]["n"], [int(r["s"]) for r in rows]


def _gram(fit: DataFrame, of, size: int) -> np.ndarray:
    """The Gram matrix of (1, of(x)) over all rows: every task adds up its own, Spark adds
    those, ``WIDE`` entries of a row at a time."""
    names = [f"c{k}" for k in range(WIDE)]
    blocks = -(-(size + 1) // WIDE)

    def run(batches):
        total = np.zeros((size + 1, blocks * WIDE))
        for batch in batches:
            rows = of(batch.column(0))
            rows = np.hstack([np.ones((len(rows), 1)), rows])
            total[:, :size + 1] += rows.T @ rows
        parts = total.reshape(-1, WIDE)
        at = {"i": pa.array(np.repeat(np.arange(size + 1), blocks), pa.int32()), "b": pa.array(np.tile(np.arange(blocks), size + 1), pa.int32())}
        yield pa.RecordBatch.from_pydict(at | {c: pa.array(np.ascontiguousarray(parts[:, k])) for k, c in enumerate(names)})

    parts = fit.mapInArrow(run, "i int, b int, " + ", ".join(f"{c} double" for c in names))
    rows = parts.groupBy("i", "b").agg(*[F.sum(c).alias(c) for c in names]).collect()  # (d + 1)^2 numbers
    total = np.zeros((size + 1, blocks * WIDE))
    for r in rows:
        total[r["i"], r["b"] * WIDE:(r["b"] + 1) * WIDE] = r[2:]
    return total[:, :size + 1]


def fit(vectors: DataFrame, column: str = "embedding", most: int = 16) -> Whitening | None:
    """Learns the whitening from each distinct ``x`` of ``column`` once; None without any.

    Only vectors as long as most distinct ones count. Components whose eigenvalue is not
    above rounding are left out, so that vectors which are all alike have none.
    """
    spark = vectors.sparkSession
    ship(spark)
    x = vectors.select(scaled(F.col(f"`{column}`")).alias("x")).where("x IS NOT NULL")
    distinct = stored(x.distinct(), "distinct-vectors")
    longest = distinct.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if longest is None:
        return None
    size = longest["d"]
    rows = distinct.where(F.size("x") == size)
    n, sums = _sums(rows, size)
    base, rest = [s // n for s in sums], [s % n for s in sums]
    whole, part = np.array(base, np.int64), np.array([r / n for r in rest])
    gram = _gram(rows, lambda x: _centred(_matrix(x, size), whole, part), size)
    mean = gram[0, 1:] / n
    covariance = gram[1:, 1:] / n - np.outer(mean, mean)
    covariance = (covariance + covariance.T) / 2
    values, columns = leading(covariance, min(most, size))
    keep = values > 16 * size * EPS * max(float(values.max(initial=0.0)), np.finfo(np.float64).tiny)
    values, columns = values[keep], columns[:, keep]
    matrix, k = columns / np.sqrt(values), int(keep.sum())
    error = 0.0
    if k:
        seen = _gram(rows, lambda x: _centred(_matrix(x, size), whole, part) @ matrix, k)
        mean = seen[0, 1:] / n
        error = float(np.abs(seen[1:, 1:] / n - np.outer(mean, mean) - np.eye(k)).max())
    return Whitening(n, tuple(base), tuple(rest), matrix, values, float(np.trace(covariance)), error)


def _deviations(x: np.ndarray, model: Whitening) -> list[Decimal | None]:
    """Sums of (n x - S)^2, exact; None beyond 38 digits."""
    away = x - np.array(model.base, np.int64)
    most = (int(np.abs(away).max(initial=0)) + 1) * model.n
    if x.shape[1] * most * most < 1 << 62:
        y = away * model.n - np.array(model.rest, np.int64)
        return [Decimal(int(v)) for v in (y * y).sum(axis=1)]
    y = away.astype(object) * model.n - np.array(model.rest, object)
    return [Decimal(int(v)) if v < 10 ** 38 else None for v in (y * y).sum(axis=1)]


def whitened(vectors: DataFrame, model: Whitening | None, column: str = "embedding") -> DataFrame:
    """``vectors`` with two more columns, ``deviation`` (decimal, exact: the sum over
    dimensions of (n x - S)^2) and ``whitened`` (one number per component).

    Rows whose vector is null, empty, of another length than those learned from, or holds
    null, non-finite or unscalable entries (beyond 2^61 / 64) go; without a model all go.
    Repeated rows stay repeated; ids are not read. Columns of ``vectors`` named
    ``deviation`` or ``whitened`` are replaced.
    """
    ship(vectors.sparkSession)
    shape = "struct<deviation: decimal(38,0), whitened: array<double>>"
    size = len(model.base) if model else 0
    own = [c for c in vectors.columns if c.lower() not in ("deviation", "whitened")]

    @arrow_udf(shape)
    def run(column: pa.Array) -> pa.Array:
        x = _matrix(column, size)
        base, part = np.array(model.base, np.int64), np.array([r / model.n for r in model.rest])
        rows = _centred(x, base, part) @ model.matrix
        k = rows.shape[1]
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * k), pa.array(np.ascontiguousarray(rows).reshape(-1)))
        return pa.StructArray.from_arrays([pa.array(_deviations(x, model), pa.decimal128(38, 0)), lists], names=["deviation", "whitened"])

    rows = vectors.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("row"), scaled(F.col(f"`{column}`")).alias("x"))
    rows = rows.where(F.col("x").isNotNull() & (F.size("x") == size) & F.lit(model is not None))
    if model is None:
        return rows.select("row.*", F.lit(None).cast("decimal(38,0)").alias("deviation"), F.lit(None).cast("array<double>").alias("whitened"))
    return rows.select("row", run("x").alias("w")).select("row.*", "w.deviation", "w.whitened")


def components(vectors: DataFrame, column: str = "embedding", key: str = "vec_id", most: int = 16) -> DataFrame:
    """One row per remaining row and component, numbered from 1 by falling eigenvalue:
    ``key``, component, n, deviation (null where a long does not hold it), whitened,
    explained (the component's share of the variance) and identity_error. See ``whitened``
    for the rows that go; without a component there are no rows."""
    model = fit(vectors, column, most)
    rows = whitened(vectors.select(key, column), model, column)
    shares = F.array(*[F.lit(float(e / model.trace)) for e in model.eigenvalues]) if model and len(model.eigenvalues) else F.expr("cast(array() as array<double>)")
    rows = rows.select(key, F.col("deviation").try_cast("long").alias("deviation"), F.posexplode("whitened").alias("at", "whitened"))
    return rows.select(
        key, (F.col("at") + 1).cast("int").alias("component"), F.lit(model.n if model else 0).cast("long").alias("n"), "deviation", "whitened",
        F.get(shares, F.col("at")).alias("explained"), F.lit(model.identity_error if model else 0.0).alias("identity_error"),
    )
