"""Whitening of embeddings with an exact covariance by polarisation.

Entries become integers, floor(scale * c) + shift. The fit list holds each distinct integer vector once. With n vectors and sums S,
n * x - S is an exact centred value. The squares of these values are summed exactly for every dimension and for the
sum of every pair of dimensions; twice a covariance is what the square of a pair's sum has beyond those of its two dimensions. Tasks
emit one row per pair and partition, of integers in digits of 30 bits, so that no sum overflows; the driver gets the d (d + 1) / 2
totals (a size that the dimension bounds), divides them once and takes the eigenvectors.

Defined cases: vectors that are null, empty, hold null or non-finite entries or entries whose integer has over 53 bits, or
have another length than most (of equally frequent ones the longer) take no part; repeated rows have rows of their own in the
result and count once in the fit; components whose eigenvalue is zero (up to the rounding of the largest) have a null
whitened value; a deviation beyond a long is null, an empty table gives no rows; other columns aren't read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, batch, cut, slices

BITS, DIGITS = 30, 10
_LIMIT = 1 << 53
_DIGITS = [f"d{k}" for k in range(DIGITS)]


def digits(value: int) -> list[int]:
    """value in digits of 30 bits, the lowest first; the last one has the sign."""
    out = []
    for _ in range(DIGITS - 1):
        out.append(value & ((1 << BITS) - 1))
        value >>= BITS
    return [*out, value]


def number(parts: list[int]) -> int:
    return sum(int(p) << (BITS * k) for k, p in enumerate(parts))


def integers(embeddings: DataFrame, vector: str, vec_id: str, scale: float, shift: int) -> DataFrame:
    """vec_id and x (array of long) of the vectors that take part."""
    kind = dict(embeddings.dtypes)[vec_id]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, rows = [], []
            for k, v in enumerate(b.column(1).to_pylist()):
                if v and None not in v:
                    with np.errstate(over="ignore", invalid="ignore"):
                        x = np.floor(scale * np.array(v, float))
                    if np.isfinite(x).all() and np.abs(x).max() < _LIMIT - abs(shift):
                        ids.append(k)
                        rows.append(x.astype(np.int64) + shift)
            yield batch(["vec_id", "x"], b.column(0).take(pa.array(ids, pa.int64())), pa.array([r.tolist() for r in rows], pa.list_(pa.int64())))

    found = cut(arrow_map(embeddings, [vec_id, vector], run, f"vec_id {kind}, x array<bigint>"))
    size = found.groupBy(F.size("x").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    return found.where(F.size("x") == (size["size"] if size else 0))


def _matrices(batches: Iterator[pa.RecordBatch], column: int = 0) -> Iterator[np.ndarray]:
    for b in slices(batches, 2048):
        flat = b.column(column).flatten().to_numpy(zero_copy_only=False)
        if b.num_rows:
            yield flat.reshape(b.num_rows, -1)


def _sums(fit: DataFrame) -> tuple[int, list[int], list[int], list[int]]:
    """n, and each dimension's sum, least and greatest value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, least, most = 0, None, None, None
        for x in _matrices(batches):
            s = [int(v) for v in (x >> 26).sum(0)], [int(v) for v in (x & ((1 << 26) - 1)).sum(0)]
            s = [(hi << 26) + lo for hi, lo in zip(*s, strict=True)]
            n += len(x)
            total = s if total is None else [a + c for a, c in zip(total, s, strict=True)]
            least = x.min(0) if least is None else np.minimum(least, x.min(0))
            most = x.max(0) if most is None else np.maximum(most, x.max(0))
        if n:
            rows = [digits(t) for t in total]
            yield batch(["i", "n", "least", "most", *_DIGITS], pa.array(range(len(rows)), pa.int32()), pa.array([n] * len(rows), pa.int64()), least, most, *[pa.array(c, pa.int64()) for c in zip(*rows, strict=True)])

    kinds = "i int, n bigint, least bigint, most bigint, " + ", ".join(f"{d} bigint" for d in _DIGITS)
    parts = fit.select("x").mapInArrow(run, kinds)
    rows = sorted(parts.groupBy("i").agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most"), *[F.sum(d).alias(d) for d in _DIGITS]).collect())
    return (rows[0]["n"] if rows else 0), [number([r[d] for d in _DIGITS]) for r in rows], [r["least"] for r in rows], [r["most"] for r in rows]


def square_sums(z: np.ndarray, most: int) -> list[int]:
    """The exact sum of squares of every column of z, whose entries are at most `most` in absolute value."""
    if most * most * len(z) < 1 << 62:
        return [int(v) for v in np.einsum("ij,ij->j", z, z)]
    if most < 1 << 60:
        hi, lo = z >> BITS, z & ((1 << BITS) - 1)
        step = 4  # so many squares of 30 bits stay in a long
        total = [0] * z.shape[1]
        for k in range(0, len(z), step):
            a, b = hi[k : k + step], lo[k : k + step]
            for j, (p, q, r) in enumerate(zip((a * a).sum(0), (a * b).sum(0), (b * b).sum(0), strict=True)):
                total[j] += (int(p) << (2 * BITS)) + (int(q) << (BITS + 1)) + int(r)
        return total
    return [sum(int(v) ** 2 for v in column) for column in z.T]


def _centred(x: np.ndarray, n: int, total: list[int], most: int) -> np.ndarray:
    """n * x - S, in Python's integers where a long doesn't hold it."""
    if most < 1 << 60 and max(map(abs, total), default=0) < 1 << 62:
        return n * x - np.array(total, np.int64)
    return x.astype(object) * n - np.array(total, object)


def polarised(fit: DataFrame, n: int, total: list[int], most: int) -> list[list[int]]:
    """The exact sums of (n x_i - S_i)(n x_j - S_j) over the fit list, from squares of dimensions and of sums of pairs."""
    d = len(total)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: list[list[int]] | None = None
        for x in _matrices(batches):
            y = _centred(x, n, total, most)
            new = []
            for i in range(d):
                z = y[:, i:] + y[:, i : i + 1]
                z[:, 0] = y[:, i]
                new.append(square_sums(z, 2 * most))
            sums = new if sums is None else [[a + b for a, b in zip(p, q, strict=True)] for p, q in zip(sums, new, strict=True)]
        for i, own in enumerate(sums or []):
            rows = [digits(v) for v in own]
            yield batch(["i", "j", *_DIGITS], pa.array([i] * len(own), pa.int32()), pa.array(range(i, d), pa.int32()), *[pa.array(c, pa.int64()) for c in zip(*rows, strict=True)])

    parts = fit.select("x").mapInArrow(run, "i int, j int, " + ", ".join(f"{c} bigint" for c in _DIGITS))
    found = {(r["i"], r["j"]): number([r[c] for c in _DIGITS]) for r in parts.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in _DIGITS]).collect()}
    out = [[0] * d for _ in range(d)]
    for (i, j), v in found.items():
        out[i][j] = out[j][i] = v if i == j else (v - found[i, i] - found[j, j]) // 2
    return out


@dataclass
class Model:
    n: int
    sums: list[int]
    most: int  # of |n x - S|
    values: np.ndarray  # eigenvalues, falling; zero where they are rounding
    vectors: np.ndarray  # dimension x components, unit length
    trace: float


def fit(x: DataFrame, components: int) -> Model | None:
    """The whitening of the distinct rows of x (array of long); None without rows."""
    n, total, least, most = _sums(x)
    if not n:
        return None
    bound = max(max(abs(n * lo - s), abs(n * hi - s)) for lo, hi, s in zip(least, most, total, strict=True))
    products = polarised(x, n, total, bound)
    cov = np.array([[float(Fraction(v, n**3)) for v in row] for row in products])
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1], vectors[:, ::-1]
    values = np.where(values > max(values[0], 0) * len(values) * np.finfo(float).eps, values, 0.0)
    k = min(components, len(values))
    return Model(n, total, bound, values[:k].copy(), vectors[:, :k].copy(), float(Fraction(sum(products[i][i] for i in range(len(products))), n**3)))


def _project(x: np.ndarray, m: Model) -> np.ndarray:
    """Whitened values; NaN in components without variance."""
    y = _centred(x, m.n, m.sums, m.most).astype(float) / m.n
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(m.values > 0, (y @ m.vectors) / np.sqrt(m.values), np.nan)


def identity_error(x: DataFrame, m: Model) -> float:
    """The largest absolute entry of the whitened values' covariance less the identity, over components with variance."""
    k = len(m.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram, total = np.zeros((k, k)), np.zeros(k)
        for rows in _matrices(batches):
            w = np.nan_to_num(_project(rows, m))
            gram += w.T @ w
            total += w.sum(0)
        i, j = np.indices((k, k))
        yield batch(["i", "j", "v"], i.ravel().astype(np.int32), j.ravel().astype(np.int32), gram.ravel())
        yield batch(["i", "j", "v"], np.arange(k, dtype=np.int32), np.full(k, -1, np.int32), total)

    sums = x.select("x").mapInArrow(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    gram, mean = np.zeros((k, k)), np.zeros(k)
    for r in sums:
        if r["j"] < 0:
            mean[r["i"]] = r["v"] / m.n
        else:
            gram[r["i"], r["j"]] = r["v"] / m.n
    own = m.values > 0
    off = np.abs(gram - np.outer(mean, mean) - np.eye(k))[np.ix_(own, own)]
    return float(off.max()) if off.size else 0.0


def whiten(embeddings: DataFrame, vector: str = "embedding", vec_id: str = "vec_id", scale: float = 64.0, shift: int = 1_000_000, components: int = 16) -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained and identity_error of every row that takes part."""
    rows = integers(embeddings, vector, vec_id, scale, shift)
    distinct = cut(rows.select("x").distinct())
    model = fit(distinct, components)
    kind = dict(embeddings.dtypes)[vec_id]
    schema = f"vec_id {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    if model is None:
        return embeddings.sparkSession.createDataFrame([], schema)
    error, k = identity_error(distinct, model), len(model.values)
    share = model.values / model.trace if model.trace > 0 else np.zeros(k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1024):
            if not b.num_rows:
                continue
            x = next(_matrices(iter([b]), 1))
            w = _project(x, model).ravel()
            deviation = [v if v < 1 << 63 else None for v in square_sums(_centred(x, model.n, model.sums, model.most).T, model.most)]
            each = np.repeat(np.arange(len(x)), k)
            ids, total = b.column(0).take(pa.array(each)), pa.array(deviation, pa.int64()).take(pa.array(each))
            ones = np.ones(len(each))
            yield batch(["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"], ids, np.tile(np.arange(1, k + 1, dtype=np.int32), len(x)), np.full(len(each), model.n, np.int64), total, pa.array(w, mask=np.isnan(w)), np.tile(share, len(x)), ones * error)

    return rows.select("vec_id", "x").mapInArrow(run, schema)
