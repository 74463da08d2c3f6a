"""Exact neighbour joins in Euclidean space: range counts, range pairs, k nearest, nearest other.

Rows are dealt to cells around pivots that are sampled rows, so a dense region gets as many
pivots as its share of the rows. A query visits only the cells that the triangle inequality
cannot rule out (Lu et al. 2012). Cells are split by hash into blocks of about ``block_rows``
rows; neighbouring blocks travel together as one of about ``SPANS`` spans, and the queries of a
span in chunks of its size. A row is thus sent once for a span and not once for a block, a task
holds one span and one chunk of at most about ``SPAN_BYTES`` each whatever the skew, and a query
still meets only the blocks it has to. Identical rows are merged first and carry a weight; tasks return one number, one
edge of a spanning forest, or k rows per query, never all pairs of a block.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from gatherum.functions.sampling import hash_sample
from gatherum.operators.joins import lookup_join
from gatherum.operators.sparse_pairs import SparseSpace, build_sparse, expanded, is_sparse, sparse_counts, sparse_pairs
from gatherum.session import cut, keep, parallelism, scratch

MAX_PIVOT_BYTES = 1 << 24
BLOCK_BYTES = 1 << 25
MAX_BLOCK_ROWS = 4096
MIN_BLOCK_ROWS = 256
SPANS = 16  # parts of the rows that travel as one, more once they exceed SPAN_BYTES
SPAN_BYTES = 1 << 25
SPAN_BLOCKS = 62  # bits of a long
STRIP_CELLS = 1 << 20  # entries of one distance matrix held at a time
COPY_BLOCK = 1024  # copies of a row that meet others under one key


@dataclass
class Space:
    """Distinct rows in cells: ``points (id, x, weight, cell, r, block)`` with ``x`` as bytes.

    ``members (id, rep)`` maps every row to the distinct row (lowest id) that stands for it.
    """

    points: DataFrame
    members: DataFrame
    n_rows: int
    n_points: int
    width: int
    pivots: np.ndarray
    pivot_ids: np.ndarray
    cells: pd.DataFrame  # cell, n, weight, r_min, r_max, first_block, blocks
    block_rows: int

    @property
    def has_copies(self) -> bool:
        return self.n_points < self.n_rows

    @property
    def span_rows(self) -> int:
        return max(self.block_rows, min(-(-self.n_points // SPANS), SPAN_BYTES // (8 * self.width)))

    @property
    def span_blocks(self) -> int:
        """Consecutive blocks that travel together."""
        usual = self.span_rows * int(self.cells["blocks"].sum()) // self.n_points
        return max(1, min(usual, self.span_rows // self.block_rows * 2, SPAN_BLOCKS))


def _stack(column: pd.Series, width: int) -> np.ndarray:
    if len(column) == 0:
        return np.zeros((0, width))
    return np.frombuffer(b"".join(column)).reshape(-1, width)


def _squared_gaps(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    gap = (a**2).sum(1)[:, None] + (b**2).sum(1)[None, :]
    gap -= 2.0 * (a @ b.T)
    return np.maximum(gap, 0.0, out=gap)


def build_space(features: DataFrame, seed: int = 0, block_rows: int | None = None) -> Space:
    """Merge identical rows of ``(id, features)``, choose pivots, deal the rows to cells."""
    with scratch():
        return _build(features, seed, block_rows)


def _build(features: DataFrame, seed: int, block_rows: int | None) -> Space:
    spark = features.sparkSession
    rows = keep(features.select("id", vector_to_array(F.col("features")).alias("x")))
    n_rows = rows.count()
    if n_rows == 0:
        raise ValueError("no rows")
    width = len(rows.select("x").first()[0])
    groups = keep(rows.groupBy("x").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("weight")))
    n_points = groups.count()
    members = None  # set to the distinct rows themselves when nothing is repeated
    if n_points < n_rows:
        members = cut(
            lookup_join(rows, groups.select("x", F.col("id").alias("rep")), "x", n_rows=n_rows)
            .select("id", "rep")
        )
    if block_rows is None:
        fair = -(-n_points // parallelism(spark))
        widest = max(MIN_BLOCK_ROWS, min(MAX_BLOCK_ROWS, BLOCK_BYTES // (8 * width)))
        block_rows = max(MIN_BLOCK_ROWS, min(widest, fair))
    n_pivots = max(1, min(-(-n_points // block_rows), MAX_PIVOT_BYTES // (8 * width)))
    chosen = hash_sample(groups.select("id", "x"), n_pivots, seed, n_rows=n_points)
    chosen = chosen.collect()  # at most MAX_PIVOT_BYTES
    pivots = np.array([r["x"] for r in chosen], dtype=float).reshape(-1, width)
    # cells are numbered along the longest axis, so that near numbers are near in space
    axis = np.linalg.svd(pivots - pivots.mean(axis=0), full_matrices=False)[2][0]
    order = np.lexsort(([r["id"] for r in chosen], pivots @ axis))
    pivots, chosen = pivots[order], [chosen[i] for i in order]
    held = spark.sparkContext.broadcast(pivots)

    def deal(batches):
        centres = held.value
        for frame in batches:
            step = max(1, STRIP_CELLS // len(centres))
            for a in range(0, len(frame), step):
                part = frame.iloc[a : a + step]
                x = np.vstack(part["x"].to_numpy())
                gap = _squared_gaps(x, centres)
                at = gap.argmin(axis=1)
                yield pd.DataFrame(
                    {
                        "id": part["id"].to_numpy(),
                        "x": [v.tobytes() for v in x],
                        "weight": part["weight"].to_numpy(),
                        "cell": at.astype(np.int32),
                        "r": np.sqrt(((x - centres[at]) ** 2).sum(1)),
                    }
                )

    dealt = keep(
        groups.select("id", "x", "weight")
        .mapInPandas(deal, "id long, x binary, weight long, cell int, r double")
    )
    cells = (
        dealt.groupBy("cell")
        .agg(
            F.count(F.lit(1)).alias("n"), F.sum("weight").alias("weight"),
            F.min("r").alias("r_min"), F.max("r").alias("r_max"),
        )
        .toPandas().sort_values("cell").reset_index(drop=True)  # one row per pivot
    )
    cells["blocks"] = -(-cells["n"] // block_rows)
    cells["first_block"] = cells["blocks"].cumsum() - cells["blocks"]
    table = spark.createDataFrame(cells[["cell", "first_block", "blocks"]],
                                  "cell int, first_block long, blocks long")
    points = cut(
        dealt.join(F.broadcast(table), "cell").select(
            "id", "x", "weight", "cell", "r",
            (F.col("first_block") + F.pmod(F.xxhash64("id"), F.col("blocks"))).cast("int").alias("block"),
        )
    )
    ids = np.array([r["id"] for r in chosen])
    if members is None:
        members = points.select("id", F.col("id").alias("rep"))
    return Space(points, members, n_rows, n_points, width, pivots, ids, cells, block_rows)


def route(
    space: Space,
    queries: DataFrame,
    skip: Callable[[pd.DataFrame, np.ndarray, np.ndarray], np.ndarray] | None = None,
) -> DataFrame:
    """Add to each query the blocks that may hold an answer, as ``visit``: for each span a long
    whose bits tell the blocks of the span.

    ``queries`` have ``id, x, cell, radius`` and may have other columns. ``skip(rows, cells,
    pivot_gaps)`` may rule out more (a mask of rows x listed cells); ``pivot_gaps`` are the
    distances from each row's own pivot to the pivots of the listed cells.
    """
    spark = queries.sparkSession
    cells = space.cells
    held = spark.sparkContext.broadcast(
        {
            "pivots": space.pivots, "cell": cells["cell"].to_numpy(),
            "r_min": cells["r_min"].to_numpy(), "r_max": cells["r_max"].to_numpy(),
        }
    )
    width, per = space.width, space.span_blocks
    of_block = np.repeat(np.arange(len(cells)), cells["blocks"].to_numpy())  # blocks are numbered by cell
    spans = -(-len(of_block) // per)

    def look(batches):
        s = held.value
        centres = s["pivots"][s["cell"]]
        scale = 1e-6 * (1.0 + np.sqrt((centres**2).sum(1).max()))
        for frame in batches:
            step = max(1, STRIP_CELLS // len(s["cell"]))
            for a in range(0, len(frame), step):
                part = frame.iloc[a : a + step].reset_index(drop=True)
                x = _stack(part["x"], width)
                to = np.sqrt(_squared_gaps(x, centres))
                home, back = np.unique(part["cell"].to_numpy(), return_inverse=True)
                between = np.sqrt(_squared_gaps(s["pivots"][home], centres))[back]
                own = np.sqrt(((x - s["pivots"][part["cell"].to_numpy()]) ** 2).sum(1))[:, None]
                low = np.maximum(to - s["r_max"][None, :], s["r_min"][None, :] - to)
                # rows of a cell lie on its side of the plane halfway to any other pivot
                far = between > scale
                plane = (to**2 - own**2) / np.where(far, 2.0 * between, 1.0)
                low = np.where(far, np.maximum(low, plane), low)
                ok = low <= (part["radius"].to_numpy() + scale)[:, None]
                if skip is not None:
                    ok &= ~skip(part, s["cell"], between)
                bits = np.zeros((len(part), spans), dtype=np.int64)
                for n, at in enumerate(of_block):
                    bits[:, n // per] |= ok[:, at].astype(np.int64) << (n % per)
                yield part.assign(visit=list(bits))

    fields = [f for f in queries.schema.fields] + [T.StructField("visit", T.ArrayType(T.LongType()))]
    return queries.mapInPandas(look, T.StructType(fields))


ARROW = {"long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}


def _unpacked(table: pa.Table, width: int) -> tuple[pd.DataFrame, np.ndarray]:
    """The columns of a table, and its ``x`` as a matrix over the bytes that came."""
    frame = table.drop_columns(["x"]).to_pandas()
    if len(table) == 0:
        return frame, np.zeros((0, width))
    x = pa.concat_arrays(table["x"].chunks)
    start = np.frombuffer(x.buffers()[1], np.int32)[x.offset]
    return frame, np.frombuffer(x.buffers()[2], float, len(x) * width, int(start)).reshape(-1, width)


def visit(
    space: Space, routed: DataFrame, data: DataFrame, work: Callable, schema: str,
    merge: Callable[[pd.DataFrame], pd.DataFrame] | None = None,
) -> DataFrame:
    """Run ``work(queries, their x, rows, their x)`` for every block with the queries that visit it.

    A task takes a span of blocks and a chunk of its queries, and goes through it block by block;
    ``merge`` then puts together what its blocks gave. ``routed`` is read twice (to count the
    queries of a span, then to deal them), so it is stored first, a row a query. A span is
    repeated once per chunk of queries, no more.
    """
    routed = keep(routed)
    size, per, width = space.span_rows, space.span_blocks, space.width
    sent = routed.select("*", F.posexplode("visit").alias("span", "bits")).drop("visit").filter("bits <> 0")
    load = keep(  # one row per span
        sent.groupBy("span").agg(F.ceil(F.count(F.lit(1)) / F.lit(size)).cast("int").alias("chunks"))
    )
    queries = (
        sent.join(F.broadcast(load), "span")
        .withColumn("chunk", F.pmod(F.xxhash64("id", F.lit(17)), F.col("chunks")).cast("int"))
        .drop("chunks", "cell")
    )
    rows = (
        data.withColumn("span", F.floor(F.col("block") / F.lit(per)).cast("int"))
        .join(F.broadcast(load), "span")
        .withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        .drop("chunks")
    )
    kinds = pa.schema([(name, ARROW[kind]) for name, kind in (c.split() for c in schema.split(","))])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if len(left) == 0 or len(right) == 0:
            return kinds.empty_table()
        q, qx = _unpacked(left, width)
        d, dx = _unpacked(right, width)
        block, bits = d["block"].to_numpy(), q["bits"].to_numpy()
        found = []
        for b in np.unique(block):
            asked = np.flatnonzero((bits >> (b % per)) & 1)
            if len(asked):
                at = np.flatnonzero(block == b)
                found.append(work(q.iloc[asked], qx[asked], d.iloc[at], dx[at]))
        found = [f for f in found if len(f)]
        if not found:
            return kinds.empty_table()
        every = pd.concat(found, ignore_index=True)
        return pa.Table.from_pandas(every if merge is None else merge(every), kinds, preserve_index=False)

    return queries.groupBy("span", "chunk").cogroup(rows.groupBy("span", "chunk")).applyInArrow(run, schema)


def _strips(qx: np.ndarray, dx: np.ndarray):
    """Slices of the queries with their approximate squared distances and its error bound."""
    d_norm = (dx**2).sum(1)
    step = max(1, STRIP_CELLS // max(1, len(dx)))
    for a in range(0, len(qx), step):
        part = qx[a : a + step]
        q_norm = (part**2).sum(1)
        gap = q_norm[:, None] + d_norm[None, :] - 2.0 * (part @ dx.T)
        slack = 1e-12 * (1.0 + q_norm[:, None] + d_norm.max(initial=0.0)) * max(1, qx.shape[1] // 64)
        yield a, gap, slack


def _exact(qx: np.ndarray, i: np.ndarray, dx: np.ndarray, j: np.ndarray) -> np.ndarray:
    """True distances of listed pairs, by differences (no cancellation)."""
    out = np.empty(len(i))
    for a in range(0, len(i), 50_000):
        b = slice(a, a + 50_000)
        out[b] = np.sqrt(((qx[i[b]] - dx[j[b]]) ** 2).sum(1))
    return out


def _within(gap, slack, radius, qx, dx, a):
    """Mask of pairs within the radius; pairs too close to call are measured by differences."""
    limit = radius[:, None] ** 2
    inside = gap <= limit - slack
    i, j = np.nonzero(~inside & (gap <= limit + slack))
    if len(i):
        inside[i, j] = _exact(qx, i + a, dx, j) <= radius[i]
    return inside


def range_space(features: DataFrame | Space | SparseSpace) -> Space | SparseSpace:
    """The space for a range join: sparse rows stay sparse."""
    if isinstance(features, DataFrame):
        return build_sparse(features) if is_sparse(features) else build_space(features)
    return features


def neighbour_counts(features: DataFrame | Space | SparseSpace, eps: float) -> DataFrame:
    """``(id, n)``: rows within ``eps`` of every row, itself and copies counted."""
    space = range_space(features)
    with scratch():
        if isinstance(space, SparseSpace):
            return cut(expanded(space, sparse_counts(space, eps)))
        found = point_counts(space, eps)
        if space.has_copies:
            found = lookup_join(
                space.members, cut(found).withColumnRenamed("id", "rep"), "rep", n_rows=space.n_rows
            ).select("id", "n")
        return cut(found)


def point_counts(space: Space, eps: float, queries: DataFrame | None = None) -> DataFrame:
    """``(id, n)``: rows within ``eps`` of each distinct row, itself and its copies counted."""
    source = space.points if queries is None else queries
    asked = source.select("id", "x", "cell", F.lit(float(eps)).alias("radius"))

    def work(q: pd.DataFrame, qx: np.ndarray, d: pd.DataFrame, dx: np.ndarray) -> pd.DataFrame:
        weight = d["weight"].to_numpy(dtype=float)
        radius = q["radius"].to_numpy()
        found = np.zeros(len(q))
        for a, gap, slack in _strips(qx, dx):
            b = a + len(gap)
            found[a:b] = _within(gap, slack, radius[a:b], qx, dx, a) @ weight
        return pd.DataFrame({"id": q["id"].to_numpy(), "n": np.rint(found).astype(np.int64)})

    parts = visit(space, route(space, asked), space.points.select("block", "x", "weight"),
                  work, "id long, n long", lambda every: every.groupby("id", as_index=False).sum())
    return parts.groupBy("id").agg(F.sum("n").alias("n"))


def eps_join(features: DataFrame | Space | SparseSpace, eps: float, factored: bool = False) -> DataFrame:
    """``(src, dst, dist)`` with ``src < dst``: all pairs of rows at most ``eps`` apart.

    ``factored`` lists of identical rows only the lowest id, and :func:`copies` the others, so
    that a mass of copies does not square the output; the two together say the same.
    """
    space = range_space(features)
    with scratch():
        pairs = cut(sparse_pairs(space, eps) if isinstance(space, SparseSpace) else _pairs(space, eps))
        if factored or not space.has_copies:
            return pairs
        blocks = keep(space.points.select(
            F.col("id").alias("rep"), F.ceil(F.col("weight") / F.lit(COPY_BLOCK)).cast("int").alias("blocks")))
        member = cut(
            lookup_join(space.members.select("id", "rep"), blocks, "rep", n_rows=space.n_rows)
            .withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")))
        each = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))

        def copied(pairs: DataFrame, end: str, name: str) -> DataFrame:
            """The pairs with every copy of one end in its place, a block of copies at a time."""
            by_block = lookup_join(pairs.withColumnRenamed(end, "rep"), blocks, "rep").withColumn("block", each)
            return by_block.join(member.select("rep", "block", F.col("id").alias(name)), ["rep", "block"]).drop(
                "rep", "block", "blocks")

        across = copied(cut(copied(pairs, "src", "a")), "dst", "b")
        one = member.select("rep", F.col("id").alias("a"), each.alias("block"))
        inside = (
            one.join(member.select("rep", "block", F.col("id").alias("b")), ["rep", "block"])
            .filter("a < b").withColumn("dist", F.lit(0.0))
        )
        return cut(across.select("a", "b", "dist").unionByName(inside.select("a", "b", "dist")).select(
            F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst"), "dist"))


def _pairs(space: Space, eps: float) -> DataFrame:
    asked = space.points.select("id", "x", "cell", F.lit(float(eps)).alias("radius"))

    def work(q: pd.DataFrame, qx: np.ndarray, d: pd.DataFrame, dx: np.ndarray) -> pd.DataFrame:
        qid, did = q["id"].to_numpy(), d["id"].to_numpy()
        radius = q["radius"].to_numpy()
        out = []
        for a, gap, slack in _strips(qx, dx):
            b = a + len(gap)
            ok = _within(gap, slack, radius[a:b], qx, dx, a) & (qid[a:b, None] < did[None, :])
            i, j = np.nonzero(ok)
            out.append(pd.DataFrame(
                {"src": qid[i + a], "dst": did[j], "dist": _exact(qx, i + a, dx, j)}
            ))
        return pd.concat(out, ignore_index=True)

    return visit(space, route(space, asked), space.points.select("block", "id", "x"),
                 work, "src long, dst long, dist double")


def copies(features: DataFrame | Space | SparseSpace) -> DataFrame:
    """``(id, rep)`` of the rows that repeat another row; ``rep`` is the lowest id of its kind."""
    space = range_space(features)
    return space.members.filter(F.col("id") != F.col("rep"))


def _nearest(qid, qx, radius, did, dx, k):
    """Up to k rows (query, row, distance) per query, itself left out, ties by id."""
    if len(qid) == 0 or len(did) == 0:
        return pd.DataFrame({"src": [], "dst": [], "dist": []})
    src, dst, dist = [], [], []
    for a, gap, slack in _strips(qx, dx):
        b = a + len(gap)
        own = qid[a:b, None] == did[None, :]
        gap[own] = np.inf
        if gap.shape[1] > k:
            cut_at = np.partition(gap, k - 1, axis=1)[:, k - 1 : k]
        else:
            cut_at = np.full((len(gap), 1), np.inf)
        limit = np.minimum(cut_at, radius[a:b, None] ** 2) + 2 * slack
        i, j = np.nonzero((gap <= limit) & ~own)
        d = _exact(qx, i + a, dx, j)
        order = np.lexsort((did[j], d, i))
        i, j, d = i[order], j[order], d[order]
        place = np.arange(len(i)) - np.searchsorted(i, i)
        keep = (place < k) & (d <= radius[a:b][i] * (1 + 1e-9) + 1e-12)
        src.append(qid[i[keep] + a]); dst.append(did[j[keep]]); dist.append(d[keep])
    return pd.DataFrame({"src": np.concatenate(src), "dst": np.concatenate(dst),
                         "dist": np.concatenate(dist)})


def knn_points(space: Space, k: int) -> DataFrame:
    """``(src, dst, dist)``: up to k nearest other distinct rows of each distinct row."""
    width = space.width
    schema = "src long, dst long, dist double"
    points = space.points

    def inside(frame: pd.DataFrame) -> pd.DataFrame:
        x, ids = _stack(frame["x"], width), frame["id"].to_numpy()
        return _nearest(ids, x, np.full(len(ids), np.inf), ids, x, k)

    home = points.select("block", "id", "x").groupBy("block").applyInPandas(inside, schema)
    # with one block the block's own answer is the answer
    if int(space.cells["blocks"].sum()) == 1:
        return home
    # an upper bound for the k-th distance: from the own block, or from the pivots
    bound = home.groupBy("src").agg(
        F.count(F.lit(1)).alias("m"), F.max("dist").alias("kth")
    ).select(F.col("src").alias("id"), F.when(F.col("m") >= k, F.col("kth")).alias("kth"))
    held = points.sparkSession.sparkContext.broadcast((space.pivots, space.pivot_ids))

    def cap(batches):
        pivots, pivot_ids = held.value
        for frame in batches:
            radius = frame["kth"].to_numpy(dtype=float, copy=True)
            open_ = np.flatnonzero(np.isnan(radius))
            step = max(1, STRIP_CELLS // len(pivots))
            for a in range(0, len(open_), step):
                at = open_[a : a + step]
                gap = np.sqrt(_squared_gaps(_stack(frame["x"].iloc[at], width), pivots))
                gap[frame["id"].to_numpy()[at][:, None] == pivot_ids[None, :]] = np.inf
                if len(pivots) >= k:
                    radius[at] = np.partition(gap, k - 1, axis=1)[:, k - 1] * (1 + 1e-9) + 1e-6
                else:
                    radius[at] = np.inf
            yield frame[["id", "x", "cell"]].assign(radius=radius)

    asked = points.select("id", "x", "cell").join(bound, "id", "left").mapInPandas(
        cap, "id long, x binary, cell int, radius double"
    )

    def work(q: pd.DataFrame, qx: np.ndarray, d: pd.DataFrame, dx: np.ndarray) -> pd.DataFrame:
        return _nearest(q["id"].to_numpy(), qx, q["radius"].to_numpy(), d["id"].to_numpy(), dx, k)

    def merge(every: pd.DataFrame) -> pd.DataFrame:
        return every.sort_values(["src", "dist", "dst"]).groupby("src").head(k)

    near = visit(space, route(space, asked), points.select("block", "id", "x"), work, schema, merge)
    return _first_k(near, "src", k)


def _first_k(df: DataFrame, key: str, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(key).orderBy("dist", "dst"))
    return df.withColumn("_rank", rank).filter(F.col("_rank") <= k).drop("_rank")


def knn_join(features: DataFrame | Space, k: int = 2) -> DataFrame:
    """``(src, dst, dist)``: the k nearest other rows of every row, ties by lower id.

    Copies of a row are its neighbours at distance 0. The search runs on distinct rows; the
    copies are brought back through the lowest ``k + 1`` ids of each group, all that any
    answer can need.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    space = features if isinstance(features, Space) else build_space(features)
    with scratch():
        return cut(_knn_rows(space, k))


def _knn_rows(space: Space, k: int) -> DataFrame:
    near = knn_points(space, k)
    if not space.has_copies:
        return near
    near = keep(near)
    place = F.row_number().over(Window.partitionBy("rep").orderBy("id"))
    low = keep(
        space.members.withColumn("_p", place).filter(F.col("_p") <= k + 1)
        .groupBy("rep").agg(F.collect_list("id").alias("ids"))
    )
    outer = lookup_join(
        near.select("src", F.col("dst").alias("rep"), "dist"), low, "rep"
    ).select("src", F.explode("ids").alias("dst"), "dist")
    inner = low.select(F.col("rep").alias("src"), F.explode("ids").alias("dst"),
                       F.lit(0.0).alias("dist"))
    listed = (
        _first_k(outer.unionByName(inner), "src", k + 1)
        .groupBy(F.col("src").alias("rep"))
        .agg(F.array_sort(F.collect_list(F.struct("dist", "dst"))).alias("near"))
    )
    every = lookup_join(space.members, keep(listed), "rep", n_rows=space.n_rows)
    mine = F.slice(F.filter("near", lambda e: e["dst"] != F.col("id")), 1, k)
    return every.select(F.col("id").alias("src"), F.inline(mine)).select("src", "dst", "dist")


def knn_graph(features: DataFrame | Space, k: int = 2) -> DataFrame:
    """``(src, dst, w)`` with weight 1 for each of the k nearest other rows."""
    return knn_join(features, k).select("src", "dst", F.lit(1.0).alias("w"))


def nearest_foreign(
    space: Space, groups: DataFrame, core: DataFrame | None = None, hints: DataFrame | None = None
) -> DataFrame:
    """``(grp, a, b, w)``: the closest pair of each group to any other group.

    ``groups (id, grp)`` covers every distinct row. Distance is Euclidean or, with ``core (id,
    core)``, the mutual reachability ``max(core_a, core_b, dist)``. Ties go to the lower ids,
    the same way from both sides. A group's best pair with a pivot of another group, or among
    known pairs ``hints (a, b, w)``, bounds its search; cells that hold the group alone are not
    visited.
    """
    with scratch():
        return cut(_nearest_foreign(space, groups, core, hints))


def _nearest_foreign(
    space: Space, groups: DataFrame, core: DataFrame | None, hints: DataFrame | None
) -> DataFrame:
    spark = space.points.sparkSession
    width = space.width
    marked = space.points.select("id", "x", "cell", "block").join(groups, "id")
    if core is not None:
        marked = marked.join(core, "id")
    else:
        marked = marked.withColumn("core", F.lit(0.0))
    marked = keep(marked)
    pivot_table = spark.createDataFrame(
        [(int(v), i) for i, v in enumerate(space.pivot_ids)], "id long, at int"
    )
    info = marked.join(F.broadcast(pivot_table), "id").select("at", "grp", "core").toPandas()
    info = info.sort_values("at")
    spans = marked.groupBy("cell").agg(F.min("grp").alias("lo"), F.max("grp").alias("hi")).toPandas()
    n_cells = len(space.pivots)
    sole = np.full(n_cells, np.iinfo(np.int64).min)
    same = spans["lo"].to_numpy() == spans["hi"].to_numpy()
    sole[spans["cell"].to_numpy()[same]] = spans["lo"].to_numpy()[same]
    held = spark.sparkContext.broadcast(
        {"pivots": space.pivots, "ids": space.pivot_ids, "grp": info["grp"].to_numpy(),
         "core": info["core"].to_numpy(), "sole": sole}
    )

    def try_pivots(batches):
        s = held.value
        for frame in batches:
            step = max(1, STRIP_CELLS // len(s["pivots"]))
            for a in range(0, len(frame), step):
                part = frame.iloc[a : a + step]
                grp = part["grp"].to_numpy()
                gap = np.sqrt(_squared_gaps(_stack(part["x"], width), s["pivots"])) * (1 + 1e-9) + 1e-6
                w = np.maximum(np.maximum(gap, part["core"].to_numpy()[:, None]), s["core"][None, :])
                w[grp[:, None] == s["grp"][None, :]] = np.inf
                at = w.argmin(axis=1)
                best = w[np.arange(len(w)), at]
                ok = np.isfinite(best)
                yield pd.DataFrame(
                    {"grp": np.concatenate([grp[ok], s["grp"][at[ok]]]),
                     "w": np.concatenate([best[ok], best[ok]])}
                )

    found = marked.mapInPandas(try_pivots, "grp long, w double")
    if hints is not None:
        known = lookup_join(hints, groups.toDF("a", "ga"), "a")
        known = lookup_join(keep(known), groups.toDF("b", "gb"), "b").filter("ga <> gb")
        loose = F.col("w") * (1 + 1e-9) + 1e-9
        found = found.unionByName(
            known.select(F.explode(F.array("ga", "gb")).alias("grp"), loose.alias("w"))
        )
    bound = keep(
        found.groupBy("grp").agg(F.min("w").alias("radius"))
    )
    asked = lookup_join(marked.drop("block"), bound, "grp").filter(F.col("core") <= F.col("radius"))

    def skip(rows, cells, _between):
        return held.value["sole"][cells][None, :] == rows["grp"].to_numpy()[:, None]

    def work(q: pd.DataFrame, qx: np.ndarray, d: pd.DataFrame, dx: np.ndarray) -> pd.DataFrame:
        qid, did = q["id"].to_numpy(), d["id"].to_numpy()
        qg, dg = q["grp"].to_numpy(), d["grp"].to_numpy()
        qc, dc = q["core"].to_numpy(), d["core"].to_numpy()
        radius = q["radius"].to_numpy()
        out = []
        for s, gap, slack in _strips(qx, dx):
            e = s + len(gap)
            gap[qg[s:e, None] == dg[None, :]] = np.inf
            reach = np.maximum(np.maximum(gap, qc[s:e, None] ** 2), dc[None, :] ** 2)
            limit = np.minimum(reach.min(axis=1), radius[s:e] ** 2)[:, None]
            i, j = np.nonzero(np.isfinite(gap) & (reach <= limit + 2 * slack))
            w = np.maximum(np.maximum(_exact(qx, i + s, dx, j), qc[i + s]), dc[j])
            out.append(pd.DataFrame({
                "grp": qg[i + s], "w": w,
                "a": np.minimum(qid[i + s], did[j]), "b": np.maximum(qid[i + s], did[j]),
            }))
        return first(pd.concat(out, ignore_index=True))

    def first(every: pd.DataFrame) -> pd.DataFrame:
        return every.sort_values(["grp", "w", "a", "b"]).drop_duplicates("grp")

    best = visit(
        space, route(space, asked, skip), marked.select("block", "id", "x", "grp", "core"),
        work, "grp long, w double, a long, b long", first,
    )
    return best.groupBy("grp").agg(F.min(F.struct("w", "a", "b")).alias("m")).select(
        "grp", "m.a", "m.b", "m.w"
    )
