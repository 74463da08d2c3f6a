"""KMeans, mini-batch KMeans, Lloyd steps from given centres, seed sweeps and the elbow curve.

Many fits share their scans: one pass over the rows moves the centres of every open fit, so a range
of cluster counts or seeds reads the features about as often as one fit. Starts are chosen by
k-means|| (Bahmani et al. 2012) with samples drawn by a hash of id, round and seed, so a fit does
not depend on how the rows are partitioned.

What the driver holds is centres, checked against ``MAX_CENTRE_BYTES``.
"""

from __future__ import annotations

import heapq
import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gatherum.functions.sampling import hash_key, hash_sample
from gatherum.operators.corpus import cluster_sizes
from gatherum.operators.svd import ROW_BATCH, dense_batch, raw_rows
from gatherum.session import cut, ensure_checkpoint_dir, keep, parallelism, scratch

MAX_CENTRE_BYTES = 1 << 29
SWEEP_BYTES = 1 << 26  # centres, and their sums, that a task holds in one scan
STEPS_PER_JOB = 50  # mini-batches one task takes in turn
JOB_BYTES = 1 << 26  # rows that such a task holds; a larger batch is worked on by many tasks
START_ROUNDS = 4
DENSE_ROWS = 64  # candidates that are dense at a time
CELLS = 1 << 21  # products that a task holds at a time
TABLE_CELLS = 1 << 22  # of a few candidates, dense over the columns they use
ANSWER_BYTES = 1 << 20  # sums that a task hands on at a time


@dataclass
class KMeansFit:
    assignments: DataFrame  # (id, cluster)
    centers: np.ndarray  # k x d
    wcss: float


def _check_centres(k: int, width: int) -> None:
    if k < 1:
        raise ValueError("n_clusters must be at least 1")
    if k * width * 8 > MAX_CENTRE_BYTES:
        raise ValueError(
            f"{k} centres of {width} dimensions exceed {MAX_CENTRE_BYTES} bytes: reduce dimensions first"
        )


def _width(features: DataFrame) -> int:
    first = features.select(F.unwrap_udt(F.col("features")).alias("v")).select(
        F.coalesce(F.col("v.size"), F.size("v.values"))
    ).first()
    if first is None:
        raise ValueError("no rows to cluster")
    return int(first[0])


def _best_start(fit: Callable[[int], KMeansFit], seed: int, n_init: int) -> KMeansFit:
    """The fit of least cost over ``n_init`` starts; ties to the earlier one."""
    if n_init < 1:
        raise ValueError("n_init must be at least 1")
    return min((fit(seed + 7919 * i) for i in range(n_init)), key=lambda f: f.wcss)


# --- rows as they came ----------------------------------------------------------------------


class Batch:
    """A few rows: dense ones as a block, sparse ones by their entries, one row's after another's."""

    def __init__(self, values: Sequence[np.ndarray], indices: Sequence[np.ndarray] | None = None):
        self.size, self.block = len(values), None
        if indices is None:
            self.block = values if isinstance(values, np.ndarray) else np.vstack(values)
            return
        self.lengths = np.array([len(v) for v in values], dtype=np.int64)
        self.column, self.value = np.concatenate(indices), np.concatenate(values)
        self.row = np.repeat(np.arange(self.size), self.lengths)

    def squares(self) -> np.ndarray:
        if self.block is not None:
            return (self.block**2).sum(axis=1)
        return np.bincount(self.row, self.value**2, self.size)

    def times(self, table: np.ndarray, place: np.ndarray | None = None) -> np.ndarray:
        """The rows times a matrix, whose row for a column is ``place``, below 0 if it has none."""
        if self.block is not None:
            if place is None:
                return self.block @ table
            ok = place >= 0
            return self.block[:, ok] @ table[place[ok]]
        column, value, lengths = self.column, self.value, self.lengths
        if place is not None:
            there = place[column]
            ok = there >= 0
            column, value, lengths = there[ok], value[ok], np.bincount(self.row[ok], minlength=self.size)
        out, met, begin = np.zeros((self.size, table.shape[1])), table.take(column, axis=0), 0
        for own, end in zip(out, np.cumsum(lengths)):
            np.dot(value[begin:end], met[begin:end], out=own)
            begin = end
        return out

    def gaps_to(self, points: np.ndarray, square: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Squared distance of each row to the row ``at`` of ``points``, by the differences."""
        if self.block is not None:
            return ((self.block - points[at]) ** 2).sum(axis=1)
        there = points[at[self.row], self.column]
        rest = square[at] - np.bincount(self.row, there**2, self.size)  # where the row is 0
        return np.bincount(self.row, (self.value - there) ** 2, self.size) + np.maximum(rest, 0)

    def add_to(self, sums: np.ndarray, at: np.ndarray) -> None:
        """Adds each row to the row ``at`` of ``sums``."""
        if self.block is None:
            np.add.at(sums.reshape(-1), at[self.row] * sums.shape[1] + self.column, self.value)
            return
        order = np.argsort(at, kind="stable")
        found, first = np.unique(at[order], return_index=True)
        sums[found] += np.add.reduceat(self.block[order], first, axis=0)

    def entries(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        if self.block is not None:
            return _entries(self.block[i])
        own = slice(*np.searchsorted(self.row, [i, i + 1]))
        return _entries(self.value[own], self.column[own])


def row_batches(frame: pd.DataFrame, cols: int) -> Iterable[tuple[slice, Batch]]:
    """The rows ``(indices, values)`` of a frame a few at a time, and which they are.

    Their products with ``cols`` columns, for each row and each entry, are at most ``CELLS``, or
    those of one row.
    """
    values = [np.asarray(v, dtype=float) for v in frame["values"]]
    lengths = np.array([len(v) for v in values], dtype=np.int64)
    most = max(1, CELLS // max(1, cols))
    if values and all(i is None for i in frame["indices"]) and lengths.min() == lengths.max():
        step = min(ROW_BATCH, most)
        for a in range(0, len(values), step):
            yield slice(a, min(a + step, len(values))), Batch(values[a : a + step])
        return
    indices = [np.arange(m) if i is None else np.asarray(i, dtype=np.int64) for i, m in zip(frame["indices"], lengths)]
    tile = np.maximum(np.cumsum(lengths) - 1, 0) // most + np.arange(len(values)) // most
    ends = [*(np.flatnonzero(np.diff(tile)) + 1), len(values)]
    for a, b in zip([0, *ends], ends):
        if a < b:
            yield slice(a, b), Batch(values[a:b], indices[a:b])


# --- scans that many fits share -------------------------------------------------------------


def _turner(centers: np.ndarray) -> Callable[[Batch], np.ndarray]:
    """The centres by columns for a batch: a view for a block, one copy in that order for entries."""
    made: list[np.ndarray] = []

    def table(rows: Batch) -> np.ndarray:
        if rows.block is not None:
            return centers.T
        if not made:
            made.append(np.ascontiguousarray(centers.T))
        return made[0]

    return table


def _gaps(rows: Batch, table: np.ndarray, square: np.ndarray) -> np.ndarray:
    """Squared distances to all centres, the columns of ``table``, less the row's own square."""
    gap = rows.times(table)
    gap *= -2
    gap += square
    return gap


def _sweep(features: DataFrame, fits: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray, float]]:
    """Rows and sums of each cluster, and the cost, of every fit: one scan of ``features``."""
    bounds = np.cumsum([0, *map(len, fits)])
    width = fits[0].shape[1]
    held = features.sparkSession.sparkContext.broadcast((np.vstack(fits), bounds))

    def run(batches):
        centers, ends = held.value
        table, square = _turner(centers), (centers**2).sum(axis=1)
        count, sums, cost = np.zeros(len(square)), np.zeros_like(centers), np.zeros(len(ends) - 1)
        for frame in batches:
            for _, rows in row_batches(frame, len(square)):
                gap, own = _gaps(rows, table(rows), square), rows.squares()
                for f, (lo, hi) in enumerate(zip(ends[:-1], ends[1:])):
                    at = gap[:, lo:hi].argmin(axis=1)
                    cost[f] += np.maximum(own + gap[np.arange(len(at)), lo + at], 0).sum()
                    rows.add_to(sums[lo:hi], at)
                    count[lo:hi] += np.bincount(at, minlength=hi - lo)
        live = np.flatnonzero(count)
        yield pd.DataFrame({  # a fit's cost goes along as a centre without a vector
            "centre": [*live, *range(-len(cost), 0)], "n": [*count[live], *cost],
            "x": [*(sums[c].tobytes() for c in live), *[b""] * len(cost)],
        })

    def add_up(batches):
        totals: dict[int, list] = {}
        for frame in batches:
            for centre, n, x in zip(frame["centre"], frame["n"], frame["x"]):
                total = totals.setdefault(centre, [0.0, np.zeros(len(x) // 8)])
                total[0] += n
                total[1] += np.frombuffer(x)
        names, step = list(totals), max(1, ANSWER_BYTES // (8 * width))
        for a in range(0, len(names), step):
            part = names[a : a + step]
            yield pd.DataFrame({
                "centre": part, "n": [totals[c][0] for c in part], "x": [totals[c][1].tobytes() for c in part]})

    schema = "centre int, n double, x binary"
    tasks = min(bounds[-1], parallelism(features.sparkSession))
    found = raw_rows(features).mapInPandas(run, schema).repartition(int(tasks), "centre").mapInPandas(add_up, schema).toPandas()
    held.unpersist()
    count, sums, cost = np.zeros(bounds[-1]), np.zeros((bounds[-1], width)), np.zeros(len(fits))
    for centre, n, x in zip(found["centre"], found["n"], found["x"]):
        if centre < 0:
            cost[centre + len(fits)] = n
        else:
            count[centre], sums[centre] = n, np.frombuffer(x)
    return [(count[a:b], sums[a:b], float(c)) for a, b, c in zip(bounds[:-1], bounds[1:], cost)]


def _swept(
    features: DataFrame, fits: Sequence[np.ndarray], which: Iterable[int] | None = None
) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """:func:`_sweep` over the fits in ``which``, as many at a time as a task may hold; so the driver holds
    the sums of those alone. A fit may be replaced once its sums are out."""
    rest = list(range(len(fits)) if which is None else which)
    while rest:
        size, stop = 0, 0
        while stop < len(rest) and (stop == 0 or size + fits[rest[stop]].nbytes <= SWEEP_BYTES):
            size += fits[rest[stop]].nbytes
            stop += 1
        yield from _sweep(features, [fits[f] for f in rest[:stop]])
        rest = rest[stop:]


def fit_many(
    features: DataFrame, starts: Sequence[np.ndarray], max_iter: int = 100, tol: float = 1e-4
) -> list[tuple[np.ndarray, float]]:
    """Centres and cost of a Lloyd fit from each start; the fits go through the same scans.

    A fit is closed once no centre moves by more than ``tol``. A centre that loses every row
    stays where it is. ``features`` should be stored.
    """
    now = [np.asarray(s, dtype=float) for s in starts]  # replaced, never changed
    del starts
    for s in now:
        _check_centres(*s.shape)
    opened = list(range(len(now)))
    for _ in range(max_iter):
        if not opened:
            break
        moved = []
        for f, (n, sums, _) in zip(opened, _swept(features, now, opened)):
            new = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], now[f])
            if ((new - now[f]) ** 2).sum(axis=1).max() > tol**2:
                moved.append(f)
            now[f] = new
        opened = moved
    return [(c, cost) for c, (_, _, cost) in zip(now, _swept(features, now))]


# --- starts ---------------------------------------------------------------------------------


class Candidates:
    """Rows drawn as candidates, by their entries: a wide sparse row never becomes dense as a whole table."""

    def __init__(self, width: int, rows: Sequence[tuple[np.ndarray, np.ndarray]]):
        self.width = width
        self.size = np.array([len(at) for at, _ in rows], dtype=np.int64)
        self.at = np.concatenate([np.asarray(at, np.int32) for at, _ in rows])
        self.value = np.concatenate([np.asarray(v, float) for _, v in rows])
        if self.value.nbytes > MAX_CENTRE_BYTES:
            raise ValueError(f"the candidates for starts exceed {MAX_CENTRE_BYTES} bytes: reduce dimensions first")
        self.table = None  # where most entries are there, all of them
        if 2 * len(self.at) >= len(rows) * width:
            self.table = np.vstack([block for _, block in self.blocks()])

    def __len__(self) -> int:
        return len(self.size)

    def plus(self, rows: Sequence[tuple[np.ndarray, np.ndarray]]) -> Candidates:
        return Candidates(self.width, [*self.rows(), *rows])

    def rows(self) -> list[tuple[np.ndarray, np.ndarray]]:
        ends = np.cumsum(self.size)
        return [(self.at[b - n : b], self.value[b - n : b]) for b, n in zip(ends, self.size)]

    def squares(self) -> np.ndarray:
        if self.table is not None:
            return (self.table**2).sum(axis=1)
        return np.bincount(np.repeat(np.arange(len(self)), self.size), self.value**2, len(self))

    def tables(self) -> Iterable[tuple[slice, np.ndarray, np.ndarray | None]]:
        """A few candidates at a time: which, their table by columns, and the table's row for each column.

        A table holds only the columns that its candidates use, and at most ``TABLE_CELLS`` cells or
        one candidate; of candidates whose entries are mostly there, all.
        """
        if self.table is not None:
            yield slice(0, len(self)), self.table.T, None
            return
        ends, a = np.cumsum(self.size), 0
        while a < len(self):
            b = a + 1  # the columns are at most the entries
            while b < len(self) and (b + 1 - a) * min(self.width, ends[b] - ends[a] + self.size[a]) <= TABLE_CELLS:
                b += 1
            own = slice(ends[a] - self.size[a], ends[b - 1])
            used, at = np.unique(self.at[own], return_inverse=True)
            table, place = np.zeros((len(used), b - a)), np.full(self.width, -1, np.int32)
            table[at, np.repeat(np.arange(b - a), self.size[a:b])] = self.value[own]
            place[used] = np.arange(len(used))
            yield slice(a, b), table, place
            a = b

    def nearest(self, frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        """The candidate nearest to each row, ties to the lower, and the squared distance less the row's square."""
        best, at, squares = np.full(len(frame), np.inf), np.zeros(len(frame), dtype=np.int64), self.squares()
        for part, table, place in self.tables():
            for which, rows in row_batches(frame, table.shape[1]):
                gap = squares[part] - 2 * rows.times(table, place)
                near = gap.argmin(axis=1)
                least = gap[np.arange(len(near)), near]
                closer = least < best[which]
                best[which] = np.where(closer, least, best[which])
                at[which] = np.where(closer, part.start + near, at[which])
        return at, best

    def blocks(self) -> Iterable[tuple[slice, np.ndarray]]:
        """Dense rows a few at a time, and which they are."""
        if self.table is not None:
            yield slice(0, len(self)), self.table
            return
        rows = self.rows()
        for a in range(0, len(rows), DENSE_ROWS):
            block = np.zeros((len(rows[a : a + DENSE_ROWS]), self.width))
            for own, (at, value) in zip(block, rows[a : a + DENSE_ROWS]):
                own[at] = value
            yield slice(a, a + len(block)), block


def _entries(x: np.ndarray, index: Sequence[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Columns and values of a row's entries that are not 0."""
    at = np.flatnonzero(x)
    return (at if index is None else np.asarray(index)[at]).astype(np.int32), x[at]


def _weights(features: DataFrame, held: dict[int, Candidates]) -> dict[int, np.ndarray]:
    """How many rows are nearest to each candidate of each seed: one scan, and no sums of wide rows."""
    if all(c.table is not None for c in held.values()):
        return {s: n for s, (n, _, _) in zip(held, _swept(features, [c.table for c in held.values()]))}
    sent = features.sparkSession.sparkContext.broadcast(held)

    def run(batches):
        counts = {s: np.zeros(len(c)) for s, c in sent.value.items()}
        for frame in batches:
            for s, c in sent.value.items():
                counts[s] += np.bincount(c.nearest(frame)[0], minlength=len(c))
        yield pd.DataFrame([(s, n.tobytes()) for s, n in counts.items()], columns=["seed", "n"])

    found = raw_rows(features).mapInPandas(run, "seed int, n binary").toPandas()  # one short row per task and seed
    sent.unpersist()
    return {s: sum(np.frombuffer(n) for n in found["n"][found["seed"] == s]) for s in held}


def _unit(key: pd.Series) -> np.ndarray:
    """Hash keys as numbers between 0 and 1, both excluded."""
    return (np.array([int(k[:13], 16) for k in key], dtype=float) + 0.5) / 16.0**13


def _drawn(features: DataFrame, held: dict[int, Candidates], size: int, turn: int) -> dict[int, list]:
    """For each seed ``size`` rows, drawn without replacement in proportion to their cost.

    The rows of least ``-ln(u) / cost``, u a hash of id, round and seed: one scan for all seeds,
    and the same rows whatever the partitioning.
    """
    seeds = sorted(held)
    keys = [hash_key(F.concat_ws(":", "id", F.lit(str(turn))), s).alias(f"u{s}") for s in seeds]
    sent = features.sparkSession.sparkContext.broadcast(held)

    def run(batches):
        best: dict[int, list] = {s: [] for s in seeds}  # heaps of (-key, -id, row)
        for frame in batches:
            ids = frame["id"].to_numpy()
            near = {s: sent.value[s].nearest(frame)[1] for s in seeds}
            for which, rows in row_batches(frame, 1):
                own, part = rows.squares(), frame.iloc[which]
                for s in seeds:
                    cost = own + near[s][which]
                    cost = np.where(cost > 1e-12 * np.maximum(own, 1e-300), cost, 0)
                    with np.errstate(divide="ignore"):
                        key = -np.log(_unit(part[f"u{s}"])) / cost
                    for i in np.flatnonzero(np.isfinite(key)):
                        item = (-key[i], -int(ids[which.start + i]))
                        if len(best[s]) < size or item > best[s][0][:2]:
                            at, x = rows.entries(i)
                            row = (*item, at.astype(np.int32).tobytes(), x.tobytes())
                            (heapq.heappushpop if len(best[s]) >= size else heapq.heappush)(best[s], row)
        rows = [(s, -k, -i, at, x) for s in seeds for k, i, at, x in best[s]]
        yield pd.DataFrame(rows, columns=["seed", "key", "id", "at", "x"])

    def least(batches):
        best: dict[int, list] = {}
        for frame in batches:
            for s, key, i, at, x in zip(frame["seed"], frame["key"], frame["id"], frame["at"], frame["x"]):
                heap = best.setdefault(s, [])
                (heapq.heappushpop if len(heap) >= size else heapq.heappush)(heap, (-key, -i, at, x))
        rows = [(s, -k, -i, at, x) for s, heap in best.items() for k, i, at, x in heap]
        yield pd.DataFrame(rows, columns=["seed", "key", "id", "at", "x"])

    schema = "seed int, key double, id long, at binary, x binary"
    found = (
        raw_rows(features, "id", *keys).mapInPandas(run, schema)
        .repartition(len(seeds), "seed").mapInPandas(least, schema).toPandas().sort_values(["seed", "id"])
    )
    sent.unpersist()
    return {
        s: [(np.frombuffer(at, np.int32), np.frombuffer(x)) for at, x in zip(own["at"], own["x"])]
        for s, own in found.groupby("seed")
    }


def _row(points: Candidates, rows: list, i: int) -> np.ndarray:
    x = np.zeros(points.width)
    x[rows[i][0]] = rows[i][1]
    return x


def _chosen(points: Candidates, weights: np.ndarray, k: int, seed: int) -> list[int]:
    """Weighted k-means++ over the candidates. The first of them are what a smaller k gives."""
    rng, rows = np.random.default_rng(seed), points.rows()
    own, square = np.repeat(np.arange(len(points)), points.size), points.squares()

    def gaps(i: int) -> np.ndarray:
        """Squared distances to a candidate: by its differences where a row has entries, and its other entries."""
        if points.table is not None:
            return ((points.table - points.table[i]) ** 2).sum(axis=1)
        x = _row(points, rows, i)
        there = x[points.at]
        rest = square[i] - np.bincount(own, there**2, len(points))
        found = np.bincount(own, (points.value - there) ** 2, len(points)) + rest
        return np.where(found > 1e-14 * (square + square[i]), found, 0.0)  # less is rounding of a copy

    chosen = [int(rng.choice(len(points), p=weights / weights.sum()))]
    gap = gaps(chosen[0])
    while len(chosen) < k:
        mass = gap * weights
        if mass.sum() <= 0:
            break
        chosen.append(int(rng.choice(len(points), p=mass / mass.sum())))
        gap = np.minimum(gap, gaps(chosen[-1]))
    return chosen


def _settled(points: Candidates, weights: np.ndarray, chosen: list[int]) -> np.ndarray:
    """The chosen candidates after a few weighted Lloyd steps over all."""
    rows = points.rows()
    centers = np.array([_row(points, rows, i) for i in chosen])
    for _ in range(10):
        size, mass, sums = (centers**2).sum(axis=1), np.zeros(len(centers)), np.zeros_like(centers)
        for part, block in points.blocks():
            at = (size[None, :] - 2 * block @ centers.T).argmin(axis=1)
            mass += np.bincount(at, weights[part], len(centers))
            Batch(block * weights[part][:, None]).add_to(sums, at)
        centers = np.where(mass[:, None] > 0, sums / np.maximum(mass, 1e-300)[:, None], centers)
    return centers


def _plus_plus(points: Candidates, weights: np.ndarray, k: int, seed: int) -> np.ndarray:
    return _settled(points, weights, _chosen(points, weights, k, seed))


def choose_starts(features: DataFrame, wanted: Sequence[tuple[int, int]]) -> list[np.ndarray]:
    """Starting centres for each ``(k, seed)``; pairs of one seed share their candidates.

    Candidates are drawn in ``START_ROUNDS`` scans, twice the largest k of the seed in each, and
    weighted by the rows nearest to them. Fewer than k centres come back if there are fewer
    distinct rows.
    """
    width = _width(features)
    most: dict[int, int] = {}
    for k, seed in wanted:
        _check_centres(k, width)
        most[seed] = max(k, most.get(seed, 0))
    seeds = sorted(most)
    first = raw_rows(features, "id").agg(*[
        F.min_by(F.struct("indices", "values"), F.struct(hash_key("id", s), "id")).alias(f"s{s}") for s in seeds
    ]).first()
    held = {s: Candidates(width, [_entries(np.array(x["values"], dtype=float), x["indices"])]) for s, x in zip(seeds, first)}
    for turn in range(START_ROUNDS):
        new = _drawn(features, held, 2 * max(most.values()), turn)
        held = {s: c.plus(new[s]) if s in new else c for s, c in held.items()}
    weights = _weights(features, held)
    chosen = {s: _chosen(held[s], weights[s], most[s], s) for s in seeds}
    return [_settled(held[s], weights[s], chosen[s][:k]) for k, s in wanted]


# --- fits -----------------------------------------------------------------------------------


def kmeans(
    features: DataFrame, n_clusters: int, max_iter: int = 100, seed: int = 0, tol: float = 1e-4,
    n_init: int = 1,
) -> KMeansFit:
    """Seeded KMeans of ``(id, features)`` with k-means|| starting centres, the best of ``n_init``."""
    return kmeans_seeds(features, n_clusters, [seed], max_iter, tol, n_init)[0]


def kmeans_seeds(
    features: DataFrame, n_clusters: int, seeds: Iterable[int], max_iter: int = 100, tol: float = 1e-4,
    n_init: int = 1,
) -> list[KMeansFit]:
    """:func:`kmeans` for each seed; all of them go through the same scans."""
    if n_init < 1:
        raise ValueError("n_init must be at least 1")
    wanted = [(n_clusters, seed + 7919 * i) for seed in seeds for i in range(n_init)]
    with scratch():
        stored = keep(features.select("id", "features"))
        fits = fit_many(stored, choose_starts(stored, wanted), max_iter, tol)
    best = [min(fits[a : a + n_init], key=lambda f: f[1]) for a in range(0, len(fits), n_init)]
    return [KMeansFit(assign(features, centers).select("id", "cluster"), centers, cost) for centers, cost in best]


def assign(features: DataFrame, centers: np.ndarray) -> DataFrame:
    """``(id, features, cluster, sq_dist)``: nearest given centre, ties to the lower number."""
    fixed = np.asarray(centers, dtype=float)
    _check_centres(*fixed.shape)
    square = (fixed**2).sum(axis=1)

    @F.pandas_udf("cluster int, sq_dist double")
    def nearest(v: pd.DataFrame) -> pd.DataFrame:
        at, gap, table = np.zeros(len(v), dtype=int), np.zeros(len(v)), _turner(fixed)
        for which, rows in row_batches(v, len(fixed)):
            at[which] = near = _gaps(rows, table(rows), square).argmin(axis=1)
            gap[which] = rows.gaps_to(fixed, square, near)
        return pd.DataFrame({"cluster": at, "sq_dist": gap})

    v = F.unwrap_udt(F.col("features"))
    near = nearest(F.struct(v["indices"].alias("indices"), v["values"].alias("values")))
    return features.select("id", "features", near.alias("_n")).select(
        "id", "features", "_n.cluster", "_n.sq_dist"
    )


def lloyd(features: DataFrame, centers: np.ndarray, iterations: int) -> KMeansFit:
    """Lloyd steps from given centres; a centre that loses every row stays where it is."""
    [(now, cost)] = fit_many(features, [np.asarray(centers)], iterations, tol=0.0)
    return KMeansFit(assign(features, now).select("id", "cluster"), now, cost)


def wcss(assigned: DataFrame) -> DataFrame:
    """One row ``(wcss)`` of rows with ``sq_dist`` to their own centre."""
    return assigned.agg(F.sum("sq_dist").alias("wcss"))


# --- mini-batches ---------------------------------------------------------------------------


def minibatch_kmeans(
    features: DataFrame,
    n_clusters: int,
    batch_size: int = 1000,
    init_size: int = 1000,
    max_iter: int = 100,
    max_no_improvement: int | None = 10,
    seed: int = 0,
    n_init: int = 1,
    start: np.ndarray | None = None,
) -> KMeansFit:
    """KMeans on small seeded batches (Sculley 2010): each centre moves by 1/(rows seen so far).

    Goes over the whole table ``max_iter`` times, each time in a new order, unless the smoothed
    batch cost has not improved for ``max_no_improvement`` steps before. A pass is written once in
    the order of its steps (into the checkpoint folder), so a step reads its own files and not the
    table; passes of a few steps are written several at a time. Every row is then assigned in one pass. The best of ``n_init`` starts, or one from the centres in ``start``.
    """
    if n_init > 1 and start is None:
        return _best_start(
            lambda s: minibatch_kmeans(
                features, n_clusters, batch_size, init_size, max_iter, max_no_improvement, s
            ), seed, n_init)
    width = _width(features)
    _check_centres(n_clusters, width)
    n = features.count()
    if start is None:
        sample = cut(hash_sample(features, min(n, max(init_size, 3 * n_clusters)), seed, n_rows=n))
        [centers] = choose_starts(sample, [(n_clusters, seed)])
    else:
        centers = np.array(start, dtype=float)
    batch = min(batch_size, n)
    per_pass = max(1, n // batch)
    per_job = max(1, min(STEPS_PER_JOB, JOB_BYTES // (batch * width * 8)))
    wide = batch * width * 8 > JOB_BYTES
    seen = np.zeros(len(centers))
    smooth, best, stale = None, None, 0
    weight = min(1.0, 2.0 * batch / (n + 1))
    together = max(1, per_job // per_pass)  # passes that one task takes in turn
    for turn in range(0, max_iter, together):
        turns = range(turn, min(turn + together, max_iter))
        layout = _write_passes(features, per_pass, per_job, turns, seed)
        for job in range(-(-per_pass * len(turns) // per_job)):
            part = _read_job(features, layout, job)
            if part is None:
                continue
            for done in (_advance_wide if wide else _advance)(part, centers, seen):
                centers, seen = done["centers"], done["seen"]
                smooth = done["cost"] if smooth is None else smooth * (1 - weight) + done["cost"] * weight
                if best is None or smooth < best:
                    best, stale = smooth, 0
                else:
                    stale += 1
                if max_no_improvement is not None and stale >= max_no_improvement:
                    break
            else:
                continue
            break
        else:
            continue
        break
    final = assign(features, centers)
    cost = float(final.agg(F.sum("sq_dist")).first()[0])
    return KMeansFit(final.select("id", "cluster"), centers, cost)


def step_of(per_pass: int, turn: int, seed: int, id_col: str = "id"):
    """The step of pass ``turn`` that a row goes to: by its id, the pass and the seed alone."""
    digits = F.substring(hash_key(F.concat_ws(":", id_col, F.lit(str(turn))), seed + 1), 1, 12)
    return (F.conv(digits, 16, 10).cast("long") % F.lit(per_pass)).cast("int")


def _write_passes(features: DataFrame, per_pass: int, per_job: int, turns: range, seed: int) -> str:
    """All rows in the order of their steps, pass after pass, a folder for each job; returns where."""
    folder = f"{ensure_checkpoint_dir(features.sparkSession)}/pass-{uuid.uuid4().hex}"
    steps = F.array(*[step_of(per_pass, turn, seed) + i * per_pass for i, turn in enumerate(turns)])
    dealt = features.select("id", "features", F.explode(steps).alias("step")).withColumn("job", F.floor(F.col("step") / per_job).cast("int"))
    dealt.repartition("job").sortWithinPartitions("job", "step", "id").write.partitionBy("job").parquet(folder)
    return folder


def _read_job(features: DataFrame, folder: str, job: int) -> DataFrame | None:
    """``(id, features, step)`` of one job, from its own files; nothing lists or opens the others."""
    schema = features.select("id", "features", F.lit(0).alias("step")).schema
    try:
        return features.sparkSession.read.schema(schema).parquet(f"{folder}/job={job}")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None  # no row was dealt to these steps


def _moved(now: np.ndarray, total: np.ndarray, n: np.ndarray, sums: np.ndarray) -> None:
    """Each centre moves to the mean of all rows it has seen, these included."""
    total += n
    live = n > 0
    now[live] += (sums[live] - n[live, None] * now[live]) / total[live, None]


def _advance(part: DataFrame, centers: np.ndarray, seen: np.ndarray) -> list[dict]:
    """Centres after each of a few consecutive batches.

    Batches follow one another, so one task takes them in turn: at most ``JOB_BYTES`` of rows,
    however large the table is.
    """
    start, counts = centers.copy(), seen.copy()

    def walk(batches):
        frames = [f for f in batches if len(f)]
        if not frames:
            return
        frame = pd.concat(frames)
        now, total, rows = start.copy(), counts.copy(), []
        for step, batch in frame.groupby("step", sort=True):
            used, block = dense_batch(batch.sort_values("id"))
            x = np.zeros((len(block), now.shape[1]))
            x[:, used] = block
            gap = (x**2).sum(1)[:, None] - 2 * x @ now.T + (now**2).sum(1)[None, :]
            at = gap.argmin(axis=1)
            cost = float(((x - now[at]) ** 2).sum(1).mean())
            sums = np.zeros_like(now)
            np.add.at(sums, at, x)
            _moved(now, total, np.bincount(at, minlength=len(now)), sums)
            rows.append((int(step), cost, now.tobytes(), total.tobytes()))
        yield pd.DataFrame(rows, columns=["step", "cost", "centers", "seen"])

    out = raw_rows(part, "id", "step").coalesce(1).mapInPandas(
        walk, "step int, cost double, centers binary, seen binary"
    )
    return [
        {"cost": r["cost"], "centers": np.frombuffer(r["centers"]).reshape(start.shape).copy(),
         "seen": np.frombuffer(r["seen"]).copy()}
        for r in sorted(out.collect(), key=lambda r: r["step"])
    ]


def _advance_wide(part: DataFrame, centers: np.ndarray, seen: np.ndarray) -> list[dict]:
    """The same for a batch that no task should hold: its sums are added up by many."""
    now, total = centers.copy(), seen.copy()
    [(n, sums, cost)] = _sweep(part, [now])
    rows = max(n.sum(), 1)
    _moved(now, total, n, sums)
    return [{"cost": cost / rows, "centers": now, "seen": total}]


# --- many fits ------------------------------------------------------------------------------


def in_parallel(jobs: Sequence[Callable], threads: int = 4) -> list:
    """Run independent Spark actions from a few driver threads, results in order."""
    if len(jobs) == 1 or threads <= 1:
        return [job() for job in jobs]
    spark = SparkSession.getActiveSession()
    wrap = inheritable_thread_target(spark)  # jobs keep the caller's properties and tags
    with ThreadPoolExecutor(threads) as pool:
        return [f.result() for f in [pool.submit(wrap(job)) for job in jobs]]


def seed_sweep(
    features: DataFrame, n_clusters: int, seeds: Iterable[int] = range(5), max_iter: int = 100
) -> DataFrame:
    """``(seed, cluster, size)`` for one fit per seed: how much the start decides."""
    stored, seeds = cut(features), list(seeds)
    fits = fit_many(stored, choose_starts(stored, [(n_clusters, s) for s in seeds]), max_iter)
    parts = [
        cluster_sizes(assign(stored, centers)).select(F.lit(s).alias("seed"), "cluster", "size")
        for s, (centers, _) in zip(seeds, fits)
    ]
    return reduce(DataFrame.unionByName, parts)


def elbow(
    features: DataFrame, ks: Iterable[int] = range(1, 510, 10), seed: int = 0, max_iter: int = 100,
    starts: Sequence[np.ndarray] | None = None,
) -> DataFrame:
    """``(k, wcss)`` for a range of cluster counts, to choose k by eye; needs k <= rows.

    All counts are fitted in the same scans, from the centres in ``starts`` if given.
    """
    stored = cut(features)
    n = stored.count()
    ks = list(ks)
    if max(ks) > n:
        raise ValueError(f"k = {max(ks)} exceeds the {n} rows")
    if starts is None:
        starts = choose_starts(stored, [(k, seed) for k in ks])
    costs = [cost for _, cost in fit_many(stored, starts, max_iter)]
    return features.sparkSession.createDataFrame(
        [(int(k), float(c)) for k, c in zip(ks, costs)], "k int, wcss double"
    )
