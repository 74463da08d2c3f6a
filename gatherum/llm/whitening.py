"""Whitening of embeddings along leading eigenvectors, found by slicing the spectrum.

Entries become whole numbers, so sums and second moments are added without any rounding: numbers
are cut into limbs of 21 bits, limb products of 2,048 rows fit a double exactly, and Spark adds
what the partitions found. Vectors are centred on the rounded mean before they are multiplied; the
rest of the mean, below one half, is taken off in whole numbers too. The covariance is therefore
the same however the rows are spread.

The covariance has the size of the vectors, not of the table, and is diagonalised on the driver.
The pivots of an LDL-transposed factorisation of the covariance less a shift have the signs of its
eigenvalues less that shift: counting them says how many lie above. Bisection on these counts
isolates each leading eigenvalue, Rayleigh quotient iteration converges to it, and two more counts
just beside it certify that it has the number it was given. Eigenvalues that counts cannot tell
apart are taken as one of several dimensions; those within rounding of zero (16 d times 2^-52 of
the trace) have no component.

Vectors that are null, empty, hold a null, a NaN or an infinity, or an entry whose whole number
does not fit into 62 bits are dropped. So are vectors of another length than the most frequent one
(of equally frequent ones, the longest). Repeated rows and ids count as often as they occur. An
empty table, or one whose vectors are all equal, has no component and gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from fractions import Fraction
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Whole number of an entry: floor(SCALE * entry) + OFFSET; entries up to LARGEST fit.
SCALE, OFFSET, LARGEST = 1024, 100_000, 2.0**50
LIMB, BLOCK = 21, 2048
EPS = float(np.finfo(float).eps)


class Spectrum(NamedTuple):
    """Rows and sums of the whole numbers, leading eigenvalues and unit eigenvectors (columns)."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float


def _limbs(x: np.ndarray) -> list[np.ndarray]:
    """``x`` as a sum of limbs times powers of 2^21, each limb an exact double below 2^21 in size."""
    size, sign, out = np.abs(x), np.sign(x), []
    while size.any() or not out:
        out.append((sign * (size & ((1 << LIMB) - 1))).astype(float))
        size = size >> LIMB
    return out


def _whole(column: pa.Array, dim: int) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
    return np.floor(SCALE * values).astype(np.int64) + OFFSET


def _usable(vec_col: str, dim: int | None = None) -> Column:
    """Is the vector whole (and of the right size)? Null counts as no in a filter."""
    size = F.size(F.col(vec_col))
    fits = F.forall(F.col(vec_col).cast("array<double>"), lambda c: F.coalesce(F.abs(c) < LARGEST, F.lit(False)))
    return fits & (size > 0 if dim is None else size == dim)


def _added(df: DataFrame, vec_col: str, dim: int, emit: Callable[[np.ndarray], Iterator[tuple]], keys: list[str]) -> dict:
    """Sums, over all usable rows, of what ``emit`` finds in blocks: ``keys`` to whole number."""
    kind = ", ".join(f"{k} int" for k in keys) + ", value long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}
        blocks = 0

        def flush():
            for level, table in held.items():
                at = np.nonzero(table)
                places = [pa.array(a.astype(np.int32)) for a in at]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(at[0]), level, np.int32)), *places, pa.array(table[at])], names=[*keys, "value"]
                )
            held.clear()

        for batch in batches:
            x = _whole(batch.column(0), dim)
            for a in range(0, len(x), BLOCK):
                for level, table in emit(x[a : a + BLOCK]):
                    held[level] = held[level] + table if level in held else table
                blocks += 1
                if blocks % 256 == 0:  # 2^8 blocks of up to 3 products below 2^53
                    yield from flush()
        yield from flush()

    parts = df.filter(_usable(vec_col, dim)).select(F.col(vec_col).cast("array<double>").alias("v")).mapInArrow(run, kind)
    summed = parts.groupBy(*keys).agg(F.sum(F.col("value").cast("decimal(19,0)")).alias("value"))
    out: dict[tuple, int] = {}
    for *place, value in summed.toLocalIterator():
        at = tuple(place[1:])
        out[at] = out.get(at, 0) + (int(value) << (LIMB * place[0]))
    return out


def inertia(a: np.ndarray) -> int:
    """Positive eigenvalues of a symmetric matrix: positive pivots of its pivoted LDL-transposed factors."""
    a, n, k, positive = a.copy(), len(a), 0, 0
    alpha = (1 + np.sqrt(17)) / 8
    while k < n:
        own, column = abs(a[k, k]), np.abs(a[k + 1 :, k])
        most = column.max(initial=0.0)
        if max(own, most) == 0:
            k += 1
            continue
        pair = False
        if own < alpha * most:
            r = k + 1 + int(column.argmax())
            row = np.abs(a[r, k:])
            row[r - k] = 0
            if own * row.max() < alpha * most**2:
                pair = abs(a[r, r]) < alpha * row.max()
                to = k + 1 if pair else k
                a[[to, r]] = a[[r, to]]
                a[:, [to, r]] = a[:, [r, to]]
        if pair:
            block, rest = a[k : k + 2, k : k + 2], a[k + 2 :, k : k + 2]
            positive += int((np.linalg.eigvalsh(block) > 0).sum())
            a[k + 2 :, k + 2 :] -= rest @ np.linalg.solve(block, rest.T)
            k += 2
        else:
            positive += int(a[k, k] > 0)
            rest = a[k + 1 :, k]
            a[k + 1 :, k + 1 :] -= np.outer(rest, rest / a[k, k])
            k += 1
    return positive


def leading(v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` greatest positive eigenvalues of a covariance, falling, and their unit eigenvectors."""
    d, scale = len(v), float(np.trace(v))
    if not d or scale <= 0:
        return np.zeros(0), np.zeros((d, 0))
    a, eye = v / scale, np.eye(d)
    counts: dict[float, int] = {0.0: d, 1.0 + d * EPS: 0}  # shift: eigenvalues above it

    def above(shift: float) -> int:
        if shift not in counts:
            counts[shift] = inertia(a - shift * eye)
        return counts[shift]

    tight = 16 * d * EPS
    k = min(k, above(tight))
    values, vectors = np.zeros(0), np.zeros((d, 0))
    rng = np.random.default_rng(11)

    def cleaned(block: np.ndarray) -> np.ndarray:
        """Orthonormal columns, orthogonal to those found."""
        for _ in range(2):
            block = np.linalg.qr(block - vectors @ (vectors.T @ block))[0]
        return block

    def inverse(shift: float, block: np.ndarray) -> np.ndarray:
        try:
            return np.linalg.solve(a - shift * eye, block)
        except np.linalg.LinAlgError:
            return np.linalg.solve(a - (shift + EPS) * eye, block)

    while len(values) < k:
        number = len(values) + 1
        while True:
            low = max(s for s, c in counts.items() if c >= number)
            high = min(s for s, c in counts.items() if c < number)
            within = counts[low] - counts[high]
            if high - low > tight and (counts[low] != number or counts[high] != number - 1):
                above((low + high) / 2)
                continue
            shift = (low + high) / 2
            block = cleaned(rng.standard_normal((d, within)))
            for _ in range(3):
                block = cleaned(inverse(shift, block))
            if within == 1:  # Rayleigh quotients as shifts
                x, left = block[:, 0], np.inf
                for _ in range(20):
                    quotient = float(x @ a @ x)
                    now = float(np.linalg.norm(a @ x - quotient * x))
                    if now >= left / 2 or not low <= quotient <= high:
                        break
                    left, block = now, x[:, None]
                    x = cleaned(inverse(quotient, block))[:, 0]
            found, turn = np.linalg.eigh(block.T @ a @ block)
            found, block = found[::-1], block @ turn[:, ::-1]
            off = float(np.linalg.norm(a @ block - block * found, axis=0).max())
            if off <= tight and above(found[-1] - 2 * tight) >= counts[low] and above(found[0] + 2 * tight) < number:
                break
            if high - low <= tight:
                raise ArithmeticError("an eigenvalue could not be certified")
            above((low + high) / 2)
        values = np.concatenate([values, found])
        vectors = np.concatenate([vectors, block], axis=1)
    return scale * values[:k], vectors[:, :k]


def fit(df: DataFrame, vec_col: str = "embedding", k: int = 8) -> Spectrum | None:
    """Sums and leading components over all usable rows; ``None`` if there is no usable row."""
    sizes = df.filter(_usable(vec_col)).groupBy(F.size(F.col(vec_col)).alias("dim")).count()
    top = sizes.orderBy(F.desc("count"), F.desc("dim")).first()
    if top is None:
        return None
    dim, n = top
    one = lambda x: ((p, limb.sum(axis=0).astype(np.int64)) for p, limb in enumerate(_limbs(x)))
    added = _added(df, vec_col, dim, one, ["level", "i"])
    sums = [added.get((i,), 0) for i in range(dim)]
    middle = np.array([_rounded(s, n) for s in sums], np.int64)

    def products(x: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        limbs = _limbs(x - middle)
        for p, a in enumerate(limbs):
            for q, b in enumerate(limbs):
                yield p + q, (a.T @ b).astype(np.int64)

    second = _added(df, vec_col, dim, products, ["level", "i", "j"])
    rest = [s - n * int(m) for s, m in zip(sums, middle, strict=True)]
    v = np.array([
        [float(Fraction(n * second.get((i, j), 0) - rest[i] * rest[j], n * n)) for j in range(dim)] for i in range(dim)
    ])
    values, vectors = leading(v, k)
    return Spectrum(n, sums, values, vectors, float(np.trace(v)))


def _rounded(total: int, n: int) -> int:
    return (2 * total + n) // (2 * n)


def whiten(
    df: DataFrame, found: Spectrum | None, id_col: str = "vec_id", vec_col: str = "embedding", with_row: bool = False
) -> DataFrame:
    """``(key, [row,] whitened, deviation)`` for each usable row.

    ``whitened`` has the row's coordinate on each component over the root of its eigenvalue;
    ``deviation`` is the sum over dimensions of (n x - S)^2 for whole numbers x, sums S and n rows,
    exact, and null where it has more than 38 digits.
    """
    parts = [F.col(id_col).alias("key"), F.col(vec_col).cast("array<double>").alias("v")]
    if with_row:
        parts.append(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))
    dim = len(found.sums) if found else 0
    source = df.filter(_usable(vec_col, dim) if found else F.lit(False)).select(*parts)
    kept = [f"{c} {source.schema[c].dataType.simpleString()}" for c in ("key", "row") if c in source.columns]
    n, sums, values, vectors, _ = found or Spectrum(1, [], np.zeros(0), np.zeros((0, 0)), 0.0)
    middle = [_rounded(s, n) for s in sums]
    rest = [s - n * m for s, m in zip(sums, middle, strict=True)]
    toward = vectors / np.sqrt(values)
    k = len(values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre = np.array(middle, np.int64)
        for batch in batches:
            y = _whole(batch.column(1), dim) - centre
            flat = (y - np.array(rest, float) / n) @ toward
            most = n * int(np.abs(y).max(initial=0)) + max(map(abs, rest))
            if dim * most**2 < 1 << 62:
                squares = ((n * y - np.array(rest, np.int64)) ** 2).sum(axis=1).tolist()
            else:  # in Python's whole numbers
                squares = ((n * y.astype(object) - np.array(rest, object)) ** 2).sum(axis=1).tolist()
            deviation = pa.array([str(s) if s < 10**38 else None for s in squares], pa.string()).cast(pa.decimal128(38, 0))
            offsets = pa.array(np.arange(len(y) + 1) * k, pa.int32())
            own = [batch.column(0)] + ([batch.column(2)] if with_row else [])
            yield pa.RecordBatch.from_arrays(
                [*own, pa.ListArray.from_arrays(offsets, pa.array(flat.ravel())), deviation],
                names=["key", *(["row"] if with_row else []), "whitened", "deviation"],
            )

    return source.mapInArrow(run, ", ".join([*kept, "whitened array<double>, deviation decimal(38,0)"]))


def identity_error(whitened: DataFrame, k: int, column: str = "whitened") -> float:
    """The largest absolute entry of the covariance of ``k`` whitened columns less the identity."""
    pairs = [(i, j) for i in range(k) for j in range(i + 1)]
    if not pairs:
        return 0.0
    at = lambda i: F.get(F.col(column), F.lit(i))
    sums = [F.avg(at(i)) for i in range(k)] + [F.avg(at(i) * at(j)) for i, j in pairs]
    row = whitened.agg(*[c.alias(f"c{i}") for i, c in enumerate(sums)]).first()
    if row[0] is None:
        return 0.0
    return max(abs(row[k + m] - row[i] * row[j] - (i == j)) for m, (i, j) in enumerate(pairs))
