"""Truncated SVD of a tall row matrix (uncentred) and the variance it keeps.

Randomised subspace iteration (Halko, Martinsson and Tropp 2011). A sketch of at most
``SKETCH_BYTES`` is sent to all tasks; a pass multiplies the rows by it inside each task and sums
the tasks' products by blocks of columns. A wider one is a table of column blocks, orthonormalised
through its l x l Gram matrix. Of that table a lane, a few of the l vectors, is sent at a time, and the
rows, which stay where they lie, are read once for each lane: what is shuffled in a pass is the
product, once for each part of the rows, and not a product for every row and block. The driver
holds a wave of lanes at most, and there is no limit on the vocabulary.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gatherum.functions.vectors import dense_entries, l2_normalise_array, sparse_entries
from gatherum.session import cut, parallelism

SKETCH_BYTES = 1 << 26  # of a sketch that is sent to every task
COLUMN_BLOCK = 1024  # columns per summed block
ROW_BATCH = 512  # rows multiplied at once inside a task
BLOCK_BYTES = 1 << 24  # of one block of a wide sketch
TILE_ROWS, TILE_ENTRIES = 1 << 14, 1 << 20  # of the rows that are packed together
CHUNK_CELLS = 1 << 18  # products that are held at a time: they stay near the processor
LANE_BYTES, WAVE_LANES = 1 << 26, 4  # vectors of a wide sketch sent at once, and how many such lanes share a scan
PART_BYTES = 1 << 29  # of the packed rows that one task reads


def dense_batch(frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The columns a batch of rows touches, and the rows dense over just those columns."""
    values = [np.asarray(v, dtype=float) for v in frame["values"]]
    if values and all(i is None for i in frame["indices"]) and len({len(v) for v in values}) == 1:
        return np.arange(len(values[0])), np.vstack(values)
    lengths = np.array([len(v) for v in values], dtype=np.int64)
    index = [np.arange(m) if i is None else np.asarray(i, dtype=np.int64)
             for i, m in zip(frame["indices"], lengths)]
    flat = np.concatenate(index).astype(np.int64) if len(index) else np.zeros(0, dtype=np.int64)
    used, at = np.unique(flat, return_inverse=True)
    block = np.zeros((len(values), len(used)))
    if len(flat):
        block[np.repeat(np.arange(len(values)), lengths), at] = np.concatenate(values)
    return used, block


def raw_rows(features: DataFrame, *keep: str | Column) -> DataFrame:
    """``(keep..., indices, values)``; no indices for a dense row."""
    return features.select(*keep, F.unwrap_udt(F.col("features")).alias("v")).select(
        *[F.col(c) for c in features.select(*keep).columns], "v.indices", "v.values"
    )


def _projected(features: DataFrame, rows: DataFrame, normalise: bool) -> DataFrame:
    x = l2_normalise_array(F.col("x")) if normalise else F.col("x")
    return rows.select("id", array_to_vector(x).alias("features"))


@dataclass
class SvdModel:
    components: np.ndarray  # D x k, columns are the right singular vectors
    singular_values: np.ndarray
    explained_variance_ratio: float
    n_rows: int

    def project(self, features: DataFrame, normalise: bool = True) -> DataFrame:
        """``(id, features)`` of k dimensions, at unit length unless told otherwise."""
        held = features.sparkSession.sparkContext.broadcast(self.components)

        def run(batches):
            axes = held.value
            for frame in batches:
                for a in range(0, len(frame), ROW_BATCH):
                    part = frame.iloc[a : a + ROW_BATCH]
                    used, block = dense_batch(part)
                    yield pd.DataFrame(
                        {"id": part["id"].to_numpy(), "x": list(block @ axes[used])}
                    )

        return _projected(features, raw_rows(features, "id").mapInPandas(run, "id long, x array<double>"), normalise)


@dataclass
class WideSvdModel:
    """The same with the components as a table ``(block, x)``: rows of ``columns`` dimensions in each block."""

    components: DataFrame
    columns: int
    width: int
    singular_values: np.ndarray
    explained_variance_ratio: float
    n_rows: int

    def project(self, features: DataFrame, normalise: bool = True) -> DataFrame:
        k = len(self.singular_values)
        products = _row_products(_packed(features), self.components, [np.eye(k)], self.width, self.columns)

        def rows(batches):
            for frame in batches:
                for ids, x in zip(frame["ids"], frame["x"]):
                    yield pd.DataFrame({"id": pd.array(ids, "Int64"), "x": list(np.frombuffer(x).reshape(-1, k))})

        return _projected(features, products.select("ids", "x").mapInPandas(rows, "id long, x array<double>"), normalise)


def fit_svd(
    features: DataFrame, n_components: int = 100, n_passes: int = 5, oversample: int = 10,
    seed: int = 0, sketch_bytes: int = SKETCH_BYTES,
) -> SvdModel | WideSvdModel:
    """The leading ``n_components`` right singular vectors. ``features`` should be stored: it is
    read ``n_passes + 2`` times."""
    shape = features.select(F.unwrap_udt(F.col("features")).alias("v")).agg(
        F.count(F.lit(1)), F.max(F.coalesce(F.col("v.size"), F.size("v.values")))
    ).first()
    n, width = int(shape[0]), int(shape[1] or 0)
    if not 1 <= n_components <= min(n, width):
        raise ValueError(
            f"n_components = {n_components} must be from 1 to min(rows, columns) = {min(n, width)}"
        )
    size = min(n_components + oversample, n, width)
    wide = width * (size + 1) * 8 > sketch_bytes
    return (_fit_wide if wide else _fit_narrow)(features, n, width, size, n_components, n_passes, seed)


def _leading(gram: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` greatest eigenvalues, falling and none negative, and their eigenvectors."""
    values, vectors = np.linalg.eigh((gram + gram.T) / 2)
    order = np.argsort(values)[::-1][:k]
    return np.maximum(values[order], 0.0), vectors[:, order]


def _share(values: np.ndarray, means: np.ndarray, square: float, mean_square: float, n: int) -> float:
    """Share of the variance that axes keep, from the means along them and the whole's squares."""
    kept = values.sum() / n - float((means**2).sum())
    whole = square / n - mean_square
    return kept / whole if whole > 0 else 0.0


def _fit_narrow(features: DataFrame, n: int, width: int, size: int, k: int, n_passes: int, seed: int) -> SvdModel:
    spark = features.sparkSession
    raw = raw_rows(features)
    basis = np.linalg.qr(np.random.default_rng(seed).standard_normal((width, size)))[0]
    mean = None
    for i in range(n_passes + 1):
        product, column_sums = _gram_times(raw, basis, with_sums=i == 0)
        if i == 0:
            mean = column_sums / n
        basis = np.linalg.qr(product)[0]
    held = spark.sparkContext.broadcast(basis)

    def small_gram(batches):
        total, square = np.zeros((size, size)), 0.0
        for frame in batches:
            for a in range(0, len(frame), ROW_BATCH):
                used, block = dense_batch(frame.iloc[a : a + ROW_BATCH])
                z = block @ held.value[used]
                total += z.T @ z
                square += float((block**2).sum())
        yield pd.DataFrame({"at": np.arange(size + 1),
                            "x": [*total, np.full(size, square)]})

    # l + 1 short rows per task, summed entry by entry
    sums = (
        raw.mapInPandas(small_gram, "at int, x array<double>")
        .select("at", F.posexplode("x").alias("j", "v"))
        .groupBy("at", "j").agg(F.sum("v").alias("v")).toPandas()
    )
    dense = np.zeros((size + 1, size))
    dense[sums["at"], sums["j"]] = sums["v"]
    gram, square = dense[:size], dense[size, 0]
    values, vectors = _leading(gram, k)
    axes = basis @ vectors
    # a fixed sign: the largest entry of each axis is positive
    axes *= np.where(axes[np.abs(axes).argmax(axis=0), np.arange(axes.shape[1])] < 0, -1.0, 1.0)
    return SvdModel(axes, np.sqrt(values), _share(values, mean @ axes, square, float((mean**2).sum()), n), n)


def _gram_times(raw: DataFrame, basis: np.ndarray, with_sums: bool):
    """``X'X basis`` (D x l), and the column sums of X when asked, from one pass."""
    spark = raw.sparkSession
    width, size = basis.shape
    held = spark.sparkContext.broadcast(basis)
    cols = size + int(with_sums)
    n_blocks = -(-width // COLUMN_BLOCK)

    def multiply(batches):
        total = np.zeros((n_blocks * COLUMN_BLOCK, cols))
        touched = np.zeros(n_blocks, dtype=bool)
        for frame in batches:
            for a in range(0, len(frame), ROW_BATCH):
                used, block = dense_batch(frame.iloc[a : a + ROW_BATCH])
                total[used, :size] += block.T @ (block @ held.value[used])
                if with_sums:
                    total[used, size] += block.sum(axis=0)
                touched[used // COLUMN_BLOCK] = True
        for b in np.flatnonzero(touched):
            part = total[b * COLUMN_BLOCK : (b + 1) * COLUMN_BLOCK]
            yield pd.DataFrame({"block": [int(b)], "x": [part.tobytes()]})

    tasks = min(n_blocks, parallelism(spark))
    summed = (
        raw.mapInPandas(multiply, _BLOCK).repartition(tasks, "block").mapInPandas(_add_blocks, _BLOCK)
    )
    out = np.zeros((n_blocks * COLUMN_BLOCK, cols))
    found = summed.toPandas()  # D x l in all: the checked sketch
    for b, x in zip(found["block"], found["x"]):
        out[b * COLUMN_BLOCK : (b + 1) * COLUMN_BLOCK] = np.frombuffer(x).reshape(-1, cols)
    held.unpersist()
    return out[:width, :size], (out[:width, size] if with_sums else None)


_BLOCK = "block int, x binary"


def _add_blocks(batches):
    """Blocks of one number added up; all of a number are in one partition."""
    sums: dict[int, np.ndarray] = {}
    for frame in batches:
        for b, x in zip(frame["block"], frame["x"]):
            part = np.frombuffer(x)
            sums[b] = sums[b] + part if b in sums else part
    for b, part in sums.items():
        yield pd.DataFrame({"block": [b], "x": [part.tobytes()]})


# --- sketches too wide to send ---------------------------------------------------------------


def _packed(features: DataFrame) -> DataFrame:
    """Rows by the tile, stored: ``(ids, sizes, column, value, turn, place)``.

    A tile holds some rows' entries one after another; ``turn`` sorts them by column, the columns of
    most entries first, and ``place`` is the tile's number. Tiles are read once for each lane of the
    sketch and never shuffled.
    """

    def tile(parts: list[pd.DataFrame]) -> pd.DataFrame:
        part = pd.concat(parts)
        value = [np.asarray(v, float) for v in part["values"]]
        sizes = np.array([len(v) for v in value], dtype=np.int32)
        index = [np.arange(m) if i is None else np.asarray(i) for i, m in zip(part["indices"], sizes)]
        column = np.concatenate(index).astype(np.int32)
        _, at, count = np.unique(column, return_inverse=True, return_counts=True)
        return pd.DataFrame({
            "ids": [[None if i != i or i is None else int(i) for i in part["id"]]], "sizes": [sizes.tobytes()],
            "column": [column.tobytes()], "value": [np.concatenate(value).tobytes()],
            "turn": [np.lexsort((at, -count[at])).astype(np.int32).tobytes()],
        })

    def pack(batches):
        held, rows, entries = [], 0, 0
        for frame in batches:
            sizes = np.array([len(v) for v in frame["values"]], dtype=np.int64)
            piece = np.cumsum(sizes) // max(1, TILE_ENTRIES // 16) + np.arange(len(sizes)) // max(1, TILE_ROWS // 16)
            for own in np.split(np.arange(len(sizes)), np.flatnonzero(np.diff(piece)) + 1):
                if not len(own):
                    continue
                more = int(sizes[own].sum())
                if held and (rows + len(own) > TILE_ROWS or entries + more > TILE_ENTRIES):
                    yield tile(held)
                    held, rows, entries = [], 0, 0
                held.append(frame.iloc[own])
                rows, entries = rows + len(own), entries + more
        if held:
            yield tile(held)

    tiles = raw_rows(features, "id").mapInPandas(pack, "ids array<long>, sizes binary, column binary, value binary, turn binary")
    return cut(tiles.withColumn("place", F.monotonically_increasing_id()))


def _rows_times(tile, held: np.ndarray) -> np.ndarray:
    """The tile's rows times a matrix."""
    ends, column, value = np.cumsum(np.frombuffer(tile.sizes, np.int32)), np.frombuffer(tile.column, np.int32), np.frombuffer(tile.value)
    out, step = np.zeros((len(ends), held.shape[1])), max(1, CHUNK_CELLS // held.shape[1])
    a = begin = 0
    while a < len(ends):
        b = max(a + 1, int(np.searchsorted(ends, begin + step, "right")))
        chunk = slice(begin, ends[b - 1])
        met, weight, lo = held.take(column[chunk], axis=0), value[chunk], 0
        for own, hi in zip(out[a:b], ends[a:b] - begin):
            np.dot(weight[lo:hi], met[lo:hi], out=own)
            lo = hi
        a, begin = b, ends[b - 1]
    return out


def _add_back(tile, product: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Adds the transposed tile times ``product`` to ``total``; returns the columns it touched."""
    sizes, turn = np.frombuffer(tile.sizes, np.int32), np.frombuffer(tile.turn, np.int32)
    if not len(turn):
        return turn
    column, value = np.frombuffer(tile.column, np.int32)[turn], np.frombuffer(tile.value)[turn]
    row, cells = np.repeat(np.arange(len(sizes)), sizes)[turn], product.shape[1]
    first = np.flatnonzero(np.append(True, column[1:] != column[:-1]))
    count = np.diff(np.append(first, len(turn)))
    touched = column[first]
    runs = np.flatnonzero(np.append(True, count[1:] != count[:-1]))
    for a, end in zip(runs, np.append(runs[1:], len(count))):  # columns of as many entries go together
        n = count[a]
        step = max(1, CHUNK_CELLS // (n * cells))
        for lo in range(a, end, step):
            hi = min(lo + step, end)
            own = slice(first[lo], first[lo] + (hi - lo) * n)
            met = product.take(row[own], axis=0).reshape(hi - lo, n, cells)
            total[touched[lo:hi]] += np.matmul(value[own].reshape(hi - lo, 1, n), met)[:, 0]
    return touched


def _lanes(cols: int, width: int) -> list[list[tuple[int, int]]]:
    """Columns of the sketch that are sent at once, as ranges of at most ``LANE_BYTES``; a few make a wave."""
    step = max(1, LANE_BYTES // (8 * width))
    lanes = [(lo, min(cols, lo + step)) for lo in range(0, cols, step)]
    return [lanes[i : i + WAVE_LANES] for i in range(0, len(lanes), WAVE_LANES)]


def _sent(sketch: DataFrame, by: list[np.ndarray], lane: tuple[int, int], width: int, columns: int):
    """One lane of the sketch times the small matrices ``by``, sent to the tasks."""
    lo, hi = lane
    out = np.zeros((-(-width // columns) * columns, hi - lo))
    found = _turned(sketch, *by[:-1], by[-1][:, lo:hi]).toPandas()  # at most LANE_BYTES, or one column
    for b, x in zip(found["block"], found["x"]):
        out[b * columns : (b + 1) * columns] = np.frombuffer(x).reshape(columns, -1)
    return sketch.sparkSession.sparkContext.broadcast(out)


def _beside(parts: list[tuple[int, bytes]], rows: int) -> bytes:
    """Parts of the same rows put next to one another in the order of their lanes."""
    return np.hstack([np.frombuffer(x).reshape(rows, -1) for _, x in sorted(parts, key=lambda p: p[0])]).tobytes()


def _gram_pass(packed: DataFrame, sketch: DataFrame, by: list[np.ndarray], width: int, columns: int) -> DataFrame:
    """``(block, x)``: ``X'X`` times the sketch.

    A task multiplies its rows by one lane and keeps that lane's sums of all columns, so what is
    shuffled is the product, once for each of the few parts that the rows are read in.
    """
    spark = packed.sparkSession
    size = packed.agg(F.sum(F.length("value") + F.length("column") + F.length("turn"))).first()[0] or 0

    def multiply(held, lo: int):
        def run(batches):
            total = np.zeros(held.value.shape)
            touched = np.zeros(len(total) // columns, dtype=bool)
            for frame in batches:
                for tile in frame.itertuples():
                    touched[_add_back(tile, _rows_times(tile, held.value), total) // columns] = True
            for b in np.flatnonzero(touched):
                yield pd.DataFrame({"block": [int(b)], "lo": [lo], "x": [total[b * columns : (b + 1) * columns].tobytes()]})

        return run

    def add_up(batches):
        sums: dict[int, dict[int, np.ndarray]] = {}
        for frame in batches:
            for b, lo, x in zip(frame["block"], frame["lo"], frame["x"]):
                own = sums.setdefault(b, {})
                own[lo] = own[lo] + np.frombuffer(x) if lo in own else np.frombuffer(x)
        for b, own in sums.items():
            yield pd.DataFrame({"block": [b], "lo": [min(own)], "x": [_beside(list(own.items()), columns)]})

    schema, done = "block int, lo int, x binary", []
    blocks = -(-width // columns)
    for wave in _lanes(by[-1].shape[1], width):
        held = [_sent(sketch, by, lane, width, columns) for lane in wave]
        parts = max(-(-parallelism(spark) // len(wave)), -(-size // PART_BYTES))
        rows = packed.select("sizes", "column", "value", "turn").coalesce(parts)
        products = reduce(DataFrame.union, [rows.mapInPandas(multiply(h, lo), schema) for h, (lo, _) in zip(held, wave)])
        done.append(cut(products.repartition(min(blocks, parallelism(spark)), "block").mapInPandas(add_up, schema)))
        for h in held:
            h.destroy()
    if len(done) == 1:
        return done[0].select("block", "x")
    together = reduce(DataFrame.union, done).repartition(min(blocks, 4 * parallelism(spark)), "block")
    return cut(together.mapInPandas(add_up, schema).select("block", "x"))


def _row_products(packed: DataFrame, sketch: DataFrame, by: list[np.ndarray], width: int, columns: int) -> DataFrame:
    """``(place, ids, x)``: each tile's rows times the sketch, stored."""

    def multiply(held: list, lo: int):
        def run(batches):
            for frame in batches:
                for tile in frame.itertuples():
                    x = np.hstack([_rows_times(tile, h.value) for h in held])
                    yield pd.DataFrame({"place": [tile.place], "lo": [lo], "ids": [tile.ids], "x": [x.tobytes()]})

        return run

    def side_by_side(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        ids = frame["ids"].iloc[0]
        return pd.DataFrame({"place": [key[0]], "ids": [ids], "x": [_beside(list(zip(frame["lo"], frame["x"])), len(ids))]})

    done = []
    for wave in _lanes(by[-1].shape[1], width):
        held = [_sent(sketch, by, lane, width, columns) for lane in wave]
        done.append(cut(packed.select("place", "ids", "sizes", "column", "value").mapInPandas(
            multiply(held, wave[0][0]), "place long, lo int, ids array<long>, x binary")))
        for h in held:
            h.destroy()
    if len(done) == 1:
        return done[0].drop("lo")
    return cut(reduce(DataFrame.union, done).groupBy("place").applyInPandas(side_by_side, "place long, ids array<long>, x binary"))


def _summed_gram(table: DataFrame, cols: int) -> np.ndarray:
    """Sum of ``x' x`` over a table's blocks of ``cols`` columns: ``cols`` short rows per task."""

    def grams(batches):
        total = np.zeros((cols, cols))
        for frame in batches:
            for x in frame["x"]:
                part = np.frombuffer(x).reshape(-1, cols)
                total += part.T @ part
        yield pd.DataFrame({"at": np.arange(cols), "x": list(total)})

    sums = (
        table.select("x").mapInPandas(grams, "at int, x array<double>").select("at", F.posexplode("x").alias("j", "v"))
        .groupBy("at", "j").agg(F.sum("v").alias("v")).toPandas()
    )
    out = np.zeros((cols, cols))
    out[sums["at"], sums["j"]] = sums["v"]
    return (out + out.T) / 2


def _turned(table: DataFrame, *by: np.ndarray) -> DataFrame:
    """Every block times small matrices, one after another."""

    def run(batches):
        for frame in batches:
            yield frame.assign(x=[reduce(np.matmul, by, np.frombuffer(x).reshape(-1, len(by[0]))).tobytes() for x in frame["x"]])

    return table.mapInPandas(run, table.schema)


def _orthonormal(table: DataFrame, cols: int) -> list[np.ndarray]:
    """Matrices that make the blocks' columns orthonormal, of the same span: through the Gram matrix, twice."""
    by: list[np.ndarray] = []
    for _ in range(2):
        values, vectors = np.linalg.eigh(_summed_gram(_turned(table, *by) if by else table, cols))
        live = values > max(values.max(initial=0.0), 1e-300) * 1e-13
        by.append(vectors[:, live] / np.sqrt(values[live]))
        cols = int(live.sum())
    return by


def _start(spark: SparkSession, width: int, size: int, columns: int, seed: int) -> DataFrame:
    """Blocks of random numbers, each from the seed and its own number; zero beyond the last column."""

    def run(batches):
        for frame in batches:
            for b in frame["id"]:
                x = np.random.default_rng([seed, int(b)]).standard_normal((columns, size))
                x[max(0, width - int(b) * columns) :] = 0
                yield pd.DataFrame({"block": [int(b)], "x": [x.tobytes()]})

    blocks = -(-width // columns)
    return spark.range(blocks, numPartitions=min(blocks, 4 * parallelism(spark))).mapInPandas(run, _BLOCK)


def _fit_wide(features: DataFrame, n: int, width: int, size: int, k: int, n_passes: int, seed: int) -> WideSvdModel:
    spark = features.sparkSession
    columns = max(1, min(width, BLOCK_BYTES // (8 * size)))
    packed = _packed(features)
    sketch = cut(_start(spark, width, size, columns, seed))
    by = _orthonormal(sketch, size)
    for _ in range(n_passes + 1):
        sketch = _gram_pass(packed, sketch, by, width, columns)
        by = _orthonormal(sketch, by[-1].shape[1])
    cols = by[-1].shape[1]
    if cols < k:
        raise ValueError(f"n_components = {k} exceeds the rank {cols} of the rows")
    products = _row_products(packed, sketch, by, width, columns)
    values, vectors = _leading(_summed_gram(products, cols), k)
    components = cut(_turned(sketch, *by, vectors))

    def sums(batches):
        total = np.zeros(cols)
        for frame in batches:
            for x in frame["x"]:
                total += np.frombuffer(x).reshape(-1, cols).sum(axis=0)
        yield pd.DataFrame({"x": [total]})

    along = products.select("x").mapInPandas(sums, "x array<double>").select(F.posexplode("x").alias("j", "v"))
    along = along.groupBy("j").agg(F.sum("v").alias("v")).toPandas()
    means = np.zeros(cols)
    means[along["j"]] = along["v"] / n
    squares = (
        sparse_entries(features) if _is_sparse(features) else dense_entries(features)
    ).groupBy("idx").agg(F.sum("w").alias("s"), F.sum(F.col("w") * F.col("w")).alias("q")).agg(
        F.sum("q"), F.sum((F.col("s") / n) * (F.col("s") / n))
    ).first()
    share = _share(values, means @ vectors, squares[0] or 0.0, squares[1] or 0.0, n)
    return WideSvdModel(components, columns, width, np.sqrt(values), share, n)


def _is_sparse(features: DataFrame) -> bool:
    first = features.select(F.unwrap_udt(F.col("features"))["indices"].isNotNull()).first()
    return bool(first and first[0])


def total_variance(entries: DataFrame, n_rows: int) -> DataFrame:
    """One row ``(variance)``: the population variances of all columns added up.

    From ``(id, idx, w)`` triples; cells that are not listed are zero.
    """
    n = F.lit(float(n_rows))
    columns = entries.groupBy("idx").agg(F.sum("w").alias("s"), F.sum(F.col("w") * F.col("w")).alias("q"))
    return columns.agg(F.sum(F.col("q") / n - (F.col("s") / n) * (F.col("s") / n)).alias("variance"))


def explained_variance(before: DataFrame, after: DataFrame, sparse: bool = False) -> DataFrame:
    """One row ``(explained_variance)``: share of the column variance that a projection keeps."""
    n = before.count()
    entries = sparse_entries(before) if sparse else dense_entries(before)
    whole = total_variance(entries, n).withColumnRenamed("variance", "whole")
    kept = total_variance(dense_entries(after), n).withColumnRenamed("variance", "kept")
    # two one-row tables side by side
    both = whole.withColumn("one", F.lit(1)).join(kept.withColumn("one", F.lit(1)), "one")
    return both.select((F.col("kept") / F.col("whole")).alias("explained_variance"))
