"""Whitening of embeddings by a bidiagonal qd solver.

Spark sums the vectors, then every task reduces its centred rows to one triangle by QR, block after block, and triangles
meet a bounded number at a time until one is left: ``R`` with the singular values and right directions of all centred
rows, without their squares. Householder reflections make ``R`` bidiagonal, dqds finds the squared singular values to
high relative accuracy, and a twisted factorisation at each of them, cut where its pivot is least, gives the direction
of the bidiagonal matrix, which the reflections carry back. Values within ``CLUSTER`` of each other are made
orthogonal among themselves. Only matrices of dimension x dimension reach the driver, whatever the number of rows.

Entries are whole numbers ``floor(64 c) + 1000000``, so sums, deviations and centres are exact until they are centred.

Defined cases: null vectors and vectors with null or non-finite entries are dropped; so are vectors of another length
than the longest left; repeated rows count and stay; null keys stay; components without variance (to working accuracy)
have no whitened value and are left out, so a table of equal vectors, of empty vectors or of none gives no rows; a
deviation beyond a long is null; other columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from costweave.llm.caching import held
from costweave.llm.common import map_batches, table
from costweave.llm.registry import query
from costweave.session import cut_lineage

SCALE, OFFSET = 64, 1_000_000
MOST_COMPONENTS = 32
#: Triangles that meet in one task.
FAN_IN = 32
#: Entries of a block of rows that are reduced at a time.
BLOCK_ENTRIES = 1 << 20
#: Relative distance of values whose directions are made orthogonal to each other.
CLUSTER = 1e-3
EPS = float(np.finfo(float).eps)
#: e is negligible below this share of the shifts so far and its neighbours; steps per value before giving up.
NEGLIGIBLE = (10 * EPS) ** 2
MOST_STEPS = 200


# Small matrices -------------------------------------------------------------------------------------------------------


def triangle(rows: np.ndarray) -> np.ndarray:
    """R of the rows, square."""
    r = np.linalg.qr(rows, mode="r")
    return r if len(r) == r.shape[1] else np.vstack([r, np.zeros((r.shape[1] - len(r), r.shape[1]))])


def reflection(x: np.ndarray) -> tuple[np.ndarray, float]:
    """Unit vector v and value b such that (1 - 2 v vT) x = (b, 0, ..)."""
    norm = math.sqrt(x @ x)
    v = x.copy()
    if norm == 0.0:
        return v, 0.0
    b = -math.copysign(norm, x[0])
    v[0] -= b
    return v / math.sqrt(v @ v), b


def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, upper diagonal and right basis W (columns) with R = U B WT, by Householder reflections."""
    work, n = r.copy(), len(r)
    basis = np.eye(n)
    diagonal, upper = np.zeros(n), np.zeros(max(n - 1, 0))
    for k in range(n):
        v, diagonal[k] = reflection(work[k:, k])
        work[k:, k:] -= 2.0 * np.outer(v, v @ work[k:, k:])
        if k < n - 1:
            v, upper[k] = reflection(work[k, k + 1 :])
            work[k:, k + 1 :] -= 2.0 * np.outer(work[k:, k + 1 :] @ v, v)
            basis[:, k + 1 :] -= 2.0 * np.outer(basis[:, k + 1 :] @ v, v)
    return diagonal, upper, basis


def qd_step(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float], list[float]]:
    """One differential step: q and e of the factors after the shift, and the differences d on the way."""
    d = q[0] - shift
    new_q, new_e, ds = [], [], [d]
    for i in range(len(e)):
        total = d + e[i]
        ratio = q[i + 1] / total if total else 0.0
        new_q.append(total)
        new_e.append(e[i] * ratio)
        d = (d * ratio if total else q[i + 1]) - shift
        ds.append(d)
    new_q.append(d)
    return new_q, new_e, ds


def squared_singular_values(diagonal: np.ndarray, upper: np.ndarray) -> list[float]:
    """Squared singular values of an upper bidiagonal matrix by dqds, falling.

    A step without shift yields d with ``sum(1 / d)`` no less than the inverse of the least value left, so the inverse
    of the sum is a shift that never goes too far; nothing is subtracted that would cancel. Parts end where e vanishes
    next to its neighbours.
    """
    found: list[float] = []
    parts = [([x * x for x in diagonal.tolist()], [x * x for x in upper.tolist()], 0.0)]
    steps = 0
    while parts:
        q, e, shifted = parts.pop()
        while True:
            cuts = [i for i, x in enumerate(e) if x <= NEGLIGIBLE * (shifted + min(q[i], q[i + 1]))]
            if cuts:
                at = cuts[-1]
                parts.append((q[: at + 1], e[:at], shifted))
                q, e = q[at + 1 :], e[at + 1 :]
            if len(q) == 1:
                found.append(shifted + q[0])
                break
            steps += 1
            if steps > MOST_STEPS * len(diagonal):
                raise ArithmeticError("the qd steps do not converge")
            if 1.5 * q[0] < q[-1]:  # turned over, the same values; the least shall come out at the end
                q, e = q[::-1], e[::-1]
            free_q, free_e, ds = qd_step(q, e, 0.0)
            shift = 1.0 / sum(1.0 / d for d in ds) if min(ds) > 0.0 else 0.0
            if shift > 0.0:
                new_q, new_e, ds = qd_step(q, e, shift)
                if min(ds) >= 0.0:
                    q, e, shifted = new_q, new_e, shifted + shift
                    continue
            q, e = free_q, free_e
    return sorted(found, reverse=True)


def twisted_vectors(diagonal: np.ndarray, upper: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit right singular vectors (rows) of an unreduced upper bidiagonal matrix for squared singular values.

    BT B = L D LT is factorised from the top and from the bottom at every value; the two halves are joined where the
    pivot is least and solved from there outwards. Vectors of close values are made orthogonal; if little of one is left,
    the next least pivot is tried.
    """
    n, m = len(diagonal), len(values)
    d, low = diagonal * diagonal, upper / diagonal[:-1]
    tiny = EPS * EPS * float(d.max())

    def pivot(x: np.ndarray) -> np.ndarray:
        return np.where(np.abs(x) < tiny, tiny, x)

    down, s = np.zeros((n, m)), np.zeros((n, m))
    s[0] = -values
    for i in range(n - 1):
        down[i] = d[i] * low[i] / pivot(s[i] + d[i])
        s[i + 1] = down[i] * low[i] * s[i] - values
    up, p = np.zeros((n, m)), np.zeros((n, m))
    p[n - 1] = d[n - 1] - values
    for i in range(n - 2, -1, -1):
        t = d[i] / pivot(d[i] * low[i] * low[i] + p[i + 1])
        up[i] = low[i] * t
        p[i] = p[i + 1] * t - values
    order = np.argsort(np.abs(s + p + values), axis=0)
    out = np.zeros((m, n))
    for j in range(m):
        near = [i for i in range(j) if abs(values[i] - values[j]) <= CLUSTER * max(values[i], values[j])]
        for k in order[:, j]:
            z = np.zeros(n)
            z[k] = 1.0
            for i in range(k - 1, -1, -1):
                z[i] = -down[i, j] * z[i + 1]
            for i in range(k, n - 1):
                z[i + 1] = -up[i, j] * z[i]
            z /= np.abs(z).max()
            z /= math.sqrt(z @ z)
            for _ in range(2):
                z -= out[near].T @ (out[near] @ z)
            size = math.sqrt(z @ z)
            if size > 0.01:
                break
        out[j] = z / size
    return out


def directions(r: np.ndarray, most: int = MOST_COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """Squared singular values of R, falling, without those that are zero to working accuracy, and unit directions
    (columns) of the first ``most``; the largest coordinate of a direction is positive."""
    diagonal, upper, basis = bidiagonal(r)
    n, norm = len(r), float(np.abs(r).max(initial=0.0))
    if norm == 0.0:
        return np.zeros(0), np.zeros((n, 0))
    diagonal = np.where(np.abs(diagonal) < EPS * norm, EPS * norm, diagonal)
    bounds = [0, *(np.flatnonzero(np.abs(upper) <= EPS * norm) + 1).tolist(), n]
    found = []
    for a, b in zip(bounds, bounds[1:]):
        found += [(v, a, b) for v in squared_singular_values(diagonal[a:b], upper[a : b - 1])]
    found.sort(key=lambda x: -x[0])
    found = [x for x in found if x[0] > (8 * n * EPS) ** 2 * found[0][0]]
    out = np.zeros((n, min(most, len(found))))
    for a, b in zip(bounds, bounds[1:]):
        mine = [j for j in range(out.shape[1]) if found[j][1] == a]
        if mine:
            values = np.array([found[j][0] for j in mine])
            out[a:b, mine] = twisted_vectors(diagonal[a:b], upper[a : b - 1], values).T
    out = basis @ out
    if out.size:
        out *= np.sign(out[np.abs(out).argmax(axis=0), np.arange(out.shape[1])])
    return np.array([x[0] for x in found]), out


# The plan -------------------------------------------------------------------------------------------------------------


def whole_vectors(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, x): vectors as whole numbers, without null vectors and those with null, non-finite or endless entries."""
    scaled = F.transform(vector, lambda c: c.cast("double") * F.lit(float(SCALE)))
    fine = F.forall("__scaled", lambda c: F.coalesce(F.abs(c) < F.lit(2.0**52), F.lit(False)))
    marked = df.select(key, scaled.alias("__scaled")).where(F.col("__scaled").isNotNull() & fine)
    return marked.select(key, F.transform("__scaled", lambda c: F.floor(c) + OFFSET).alias("x"))


def matrix(column: pa.Array, dimension: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dimension)


class Moments:
    """Number of rows and sum of each entry of the fit list, and exact centring."""

    def __init__(self, n: int, sums: list[int]):
        self.n, self.sums = n, np.array(sums, np.int64)
        self.base = self.sums // n
        self.rest = (self.sums - self.base * n) / n

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.base) - self.rest

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over the entries of (n x - S) squared, exact; null beyond a long."""
        off = self.n * x - self.sums
        if off.size and int(np.abs(off).max()) ** 2 * off.shape[1] < 2**63:
            return (off * off).sum(axis=1).tolist()
        exact = [sum(v * v for v in row) for row in off.tolist()]
        return [v if v < 2**63 else None for v in exact]


def measured(x: DataFrame) -> tuple[Moments | None, int]:
    """Moments of the vectors of the greatest length, and that length."""
    dimension = x.agg(F.max(F.size("x"))).first()[0] or 0
    if not dimension:
        return None, 0

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, np.zeros(dimension, np.int64)
        for batch in batches:
            rows = matrix(batch.column(0), dimension)
            n, sums = n + len(rows), sums + rows.sum(axis=0)
        places = pa.array(np.arange(-1, dimension), pa.int32())
        yield pa.RecordBatch.from_arrays([places, pa.array(np.r_[n, sums])], names=["place", "total"])

    parts = map_batches(x.where(F.size("x") == dimension).select("x"), add, "place int, total long")
    totals = [r["total"] for r in parts.groupBy("place").agg(F.sum("total").alias("total")).orderBy("place").collect()]
    return Moments(totals[0], totals[1:]), dimension


def gathered(parts: DataFrame, merge) -> bytes | None:
    """One value of the column ``part`` (one per task): values meet ``FAN_IN`` at a time until few are left."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = None
        for batch in batches:
            for part in batch.column(0).to_pylist():
                whole = part if whole is None else merge(whole, part)
        if whole is not None:
            yield pa.RecordBatch.from_arrays([pa.array([whole], pa.binary())], names=["part"])

    parts = cut_lineage(parts)
    while (n := parts.count()) > FAN_IN:
        parts = cut_lineage(map_batches(parts.repartition(-(-n // FAN_IN)), meet, "part binary"))
    whole = None
    for row in parts.collect():
        whole = bytes(row["part"]) if whole is None else merge(whole, bytes(row["part"]))
    return whole


def merged_triangles(a: bytes, b: bytes) -> bytes:
    x, y = np.frombuffer(a), np.frombuffer(b)
    side = math.isqrt(len(x))
    return triangle(np.vstack([x.reshape(side, side), y.reshape(side, side)])).tobytes()


def centred_triangle(x: DataFrame, moments: Moments) -> np.ndarray:
    """R of all centred rows."""
    dimension = len(moments.sums)
    at_once = max(dimension, BLOCK_ENTRIES // dimension)

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((0, dimension))
        for batch in batches:
            rows = moments.centred(matrix(batch.column(0), dimension))
            for at in range(0, len(rows), at_once):
                r = triangle(np.vstack([r, rows[at : at + at_once]]))
        if len(r):
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes()], pa.binary())], names=["part"])

    found = gathered(map_batches(x.select("x"), reduce, "part binary"), merged_triangles)
    return np.frombuffer(found).reshape(dimension, dimension)


def merged_spread(a: bytes, b: bytes) -> bytes:
    """Count, means and centred products of two sets of rows together, from those of each."""
    x, y = np.frombuffer(a), np.frombuffer(b)
    k = math.isqrt(len(x))
    (n, mean, spread), (m, other, more) = ((z[0], z[1 : k + 1], z[k + 1 :].reshape(k, k)) for z in (x, y))
    apart = other - mean
    total = n + m
    spread = spread + more + np.outer(apart, apart) * (n * m / total)
    return np.concatenate([[total], mean + apart * (m / total), spread.ravel()]).tobytes()


def identity_error(x: DataFrame, moments: Moments, weights: np.ndarray) -> float:
    """Largest entry of the covariance of all whitened rows minus the identity."""
    dimension, k = weights.shape

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = None
        for batch in batches:
            if batch.num_rows:
                rows = moments.centred(matrix(batch.column(0), dimension)) @ weights
                mean = rows.mean(axis=0)
                rows -= mean
                part = np.concatenate([[len(rows)], mean, (rows.T @ rows).ravel()]).tobytes()
                whole = part if whole is None else merged_spread(whole, part)
        if whole is not None:
            yield pa.RecordBatch.from_arrays([pa.array([whole], pa.binary())], names=["part"])

    found = np.frombuffer(gathered(map_batches(x.select("x"), spread, "part binary"), merged_spread))
    return float(np.abs(found[k + 1 :].reshape(k, k) / found[0] - np.eye(k)).max())


OUTPUT = "component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(df: DataFrame, key: str = "vec_id", vector: str = "embedding", most: int = MOST_COMPONENTS) -> DataFrame:
    """One row per remaining row and component: its key and the columns of OUTPUT."""
    x = whole_vectors(df, key, vector)
    spark = df.sparkSession
    kind = df.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, {OUTPUT}"
    moments, dimension = measured(x)
    if moments is None:
        return spark.createDataFrame([], schema)
    x = x.where(F.size("x") == dimension)
    squares, basis = directions(centred_triangle(x, moments), most)
    if not len(squares):
        return spark.createDataFrame([], schema)
    k, n = basis.shape[1], moments.n
    weights = basis / np.sqrt(squares[:k] / n)
    explained, error = squares[:k] / squares.sum(), identity_error(x, moments, weights)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held(("whitening",), object)  # lets go of what the worker kept for another operator
        for batch in batches:
            rows = matrix(batch.column(1), dimension)
            size = len(rows)
            each = pa.array(np.repeat(np.arange(size), k))
            arrays = [
                batch.column(0).take(each),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), size)),
                pa.array(np.full(size * k, n, np.int64)),
                pa.array(moments.deviations(rows), pa.int64()).take(each),
                pa.array((moments.centred(rows) @ weights).ravel()),
                pa.array(np.tile(explained, size)),
                pa.array(np.full(size * k, error)),
            ]
            names = [key, "component", "n", "deviation", "whitened", "explained", "identity_error"]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return map_batches(x, work, schema)


@query("op13_whitening")
def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings on their first components, whitened."""
    return whiten(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))
