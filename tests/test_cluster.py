import tracemalloc

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from gatherum.functions import vectors
from gatherum.operators import kmeans, neighbors, scores, sparse_pairs, svd
from gatherum.operators.components import connected_components, symmetrise
from gatherum.operators.dbscan import dbscan
from gatherum.operators import hdbscan as hdbscan_module
from gatherum.operators.hdbscan import hdbscan, spanning_tree
from gatherum.operators.ward import ward, ward_tree
from gatherum.plans import catalog


def table(spark, x, parts=3):
    rows = [(i, Vectors.dense([float(v) for v in p])) for i, p in enumerate(x)]
    return spark.createDataFrame(rows, ["id", "features"]).repartition(parts)


def labels(df):
    return [r["cluster"] for r in df.orderBy("id").collect()]


def gaps(x):
    return np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))


@pytest.fixture(scope="module")
def cloud():
    """Blobs, scattered rows and copies: a third of the rows is one point."""
    rng = np.random.default_rng(1)
    return np.vstack([
        rng.normal(0, 0.2, (30, 4)), rng.normal(2, 0.2, (30, 4)), rng.uniform(-3, 5, (20, 4)),
        np.tile([1.0, 0.0, 1.0, 0.0], (40, 1)),
    ])


def brute_dbscan(x, eps, least):
    near = gaps(x) <= eps
    core = near.sum(1) >= least
    out, c = np.full(len(x), -1), 0
    for i in np.flatnonzero(core):
        if out[i] != -1:
            continue
        stack = [i]
        out[i] = c
        while stack:
            for j in np.flatnonzero(near[stack.pop()] & core):
                if out[j] == -1:
                    out[j] = c
                    stack.append(j)
        c += 1
    for i in np.flatnonzero(~core):
        touching = out[np.flatnonzero(near[i] & core)]
        if len(touching):
            out[i] = touching.min()
    return out.tolist()


def test_svd_matches_exact(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 12)) * np.linspace(3, 0.2, 12)
    model = svd.fit_svd(table(spark, x), 4, n_passes=8)
    exact = np.linalg.svd(x)
    assert model.singular_values == pytest.approx(exact[1][:4], rel=1e-8)
    assert np.abs(model.components.T @ exact[2][:4].T) == pytest.approx(np.eye(4), abs=1e-5)
    z = x @ model.components
    assert model.explained_variance_ratio == pytest.approx(z.var(0).sum() / x.var(0).sum())
    rows = model.project(table(spark, x), normalise=False).orderBy("id").collect()
    assert np.array([r["features"].toArray() for r in rows]) == pytest.approx(z)
    with pytest.raises(ValueError):
        svd.fit_svd(table(spark, x), 13)


def test_kmeans_family(spark):
    rng = np.random.default_rng(2)
    x = np.vstack([rng.normal(c, 0.1, (40, 3)) for c in (0, 3, 6)])
    df = table(spark, x)
    full = kmeans.kmeans(df, 3, seed=1)
    mini = kmeans.minibatch_kmeans(df, 3, batch_size=40, init_size=60, max_iter=7, seed=1)
    assert mini.wcss < 1.2 * full.wcss
    step = kmeans.lloyd(df, x[[0, 40, 80]], 2)
    assert labels(step.assignments) == [0] * 40 + [1] * 40 + [2] * 40
    assert step.wcss == pytest.approx(full.wcss)
    curve = [r["wcss"] for r in kmeans.elbow(df, [1, 3]).orderBy("k").collect()]
    assert curve[0] == pytest.approx(((x - x.mean(0)) ** 2).sum()) and curve[1] < curve[0]
    with pytest.raises(ValueError):
        kmeans.elbow(df, [500])


@pytest.mark.parametrize("block_bytes", [1 << 24, 800])
def test_wide_svd_matches_exact(spark, monkeypatch, block_bytes):
    """A sketch kept as a table: a million columns in one block or, for fewer columns, in many."""
    monkeypatch.setattr(svd, "BLOCK_BYTES", block_bytes)
    rng = np.random.default_rng(4)
    width = 10**6 if block_bytes > 800 else 60
    columns = np.sort(rng.choice(width, 40, replace=False))
    x = rng.normal(size=(50, 40)) * 1.6 ** -np.arange(40) * (rng.random((50, 40)) < 0.6)
    x[7] = 0  # a row without entries
    rows = [(i, Vectors.sparse(width, [(int(c), float(v)) for c, v in zip(columns, r) if v])) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, ["id", "features"]).repartition(3)
    model = svd.fit_svd(df, 3, n_passes=2, sketch_bytes=0)
    assert isinstance(model, svd.WideSvdModel) and model.columns == min(width, block_bytes // (8 * 13))
    exact = np.linalg.svd(x)
    assert model.singular_values == pytest.approx(exact[1][:3], rel=1e-6)
    z = x @ exact[2][:3].T
    assert model.explained_variance_ratio == pytest.approx(z.var(0).sum() / x.var(0).sum(), rel=1e-6)
    got = np.zeros((50, 3))
    for r in model.project(df, normalise=False).collect():
        got[r["id"]] = r["features"].toArray()
    assert np.abs(got) == pytest.approx(np.abs(z), abs=1e-4)


def test_wide_svd_sends_a_few_vectors_at_a_time(spark, monkeypatch):
    """Blocks of two columns, lanes of two vectors, waves of two lanes; a row without an id keeps none."""
    monkeypatch.setattr(svd, "BLOCK_BYTES", 16 * 14)
    monkeypatch.setattr(svd, "LANE_BYTES", 2 * 8 * 30)
    monkeypatch.setattr(svd, "WAVE_LANES", 2)
    monkeypatch.setattr(svd, "TILE_ENTRIES", 50)
    sent, send = [], svd._sent
    monkeypatch.setattr(svd, "_sent", lambda *a: sent.append(send(*a)) or sent[-1])
    rng = np.random.default_rng(5)
    x = rng.normal(size=(45, 30)) * 1.6 ** -np.arange(30) * (rng.random((45, 30)) < 0.6)
    rows = [(i or None, Vectors.sparse(30, [(c, float(v)) for c, v in enumerate(r) if v])) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, table(spark, x).schema).repartition(3)
    model = svd.fit_svd(df, 4, n_passes=2, sketch_bytes=0)
    assert len(sent) == (2 + 1) * 7 + 7  # 14 vectors by twos in each of three passes and for the rows' products
    exact = np.linalg.svd(x)
    assert model.singular_values == pytest.approx(exact[1][:4], rel=1e-6)
    found = model.project(df, normalise=False).collect()
    got = np.zeros((45, 4))
    for r in found:
        got[r["id"] or 0] = r["features"].toArray()
    assert sorted(r["id"] or 0 for r in found) == list(range(45)) and [r["id"] for r in found].count(None) == 1
    assert np.abs(got) == pytest.approx(np.abs(x @ exact[2][:4].T), abs=1e-4)


def test_fits_do_not_depend_on_partitions(spark):
    rng = np.random.default_rng(7)
    x = np.vstack([rng.normal(size=(150, 3)), np.tile([5.0, 5, 5], (60, 1))])
    fits = [kmeans.kmeans(table(spark, x, parts), 6, seed=2) for parts in (1, 5)]
    assert fits[0].centers == pytest.approx(fits[1].centers) and fits[0].wcss == pytest.approx(fits[1].wcss)
    together = kmeans.fit_many(table(spark, x), kmeans.choose_starts(table(spark, x), [(6, 2), (2, 2), (6, 3)]))
    assert together[0][0] == pytest.approx(fits[0].centers)
    for centers, cost in together:
        assert cost == pytest.approx((((x[:, None] - centers[None]) ** 2).sum(-1)).min(1).sum())
    few = kmeans.kmeans(table(spark, np.tile([1.0, 2.0], (9, 1))), 3)
    assert few.wcss == 0 and few.assignments.count() == 9  # one distinct row


def test_sparse_rows_are_assigned_like_dense_ones(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(40, 300)) * (rng.random((40, 300)) < 0.02)
    rows = [(i, Vectors.sparse(300, [(j, float(v)) for j, v in enumerate(r) if v])) for i, r in enumerate(x)]
    centers = rng.normal(size=(4, 300)) * 0.1
    got = kmeans.assign(spark.createDataFrame(rows, ["id", "features"]), centers).orderBy("id").collect()
    want = ((x[:, None] - centers[None]) ** 2).sum(-1)
    assert [r["cluster"] for r in got] == want.argmin(1).tolist()
    assert [r["sq_dist"] for r in got] == pytest.approx(want.min(1))


def test_mini_batches_by_hand_and_over_many_tasks(spark, monkeypatch):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(97, 2))
    df, start = table(spark, x), x[:3].copy()
    steps = {r["id"]: r["s"] for r in df.select("id", kmeans.step_of(4, 0, 5).alias("s")).collect()}
    now, seen = start.copy(), np.zeros(3)
    for step in range(4):
        mine = x[[i for i in range(97) if steps[i] == step]]
        at = ((mine[:, None] - now[None]) ** 2).sum(-1).argmin(1)
        for c in range(3):
            n = (at == c).sum()
            seen[c] += n
            if n:
                now[c] += (mine[at == c].sum(0) - n * now[c]) / seen[c]
    fit = lambda: kmeans.minibatch_kmeans(df, 3, batch_size=24, max_iter=1, max_no_improvement=None, seed=5, start=start)
    assert fit().centers == pytest.approx(now)
    monkeypatch.setattr(kmeans, "JOB_BYTES", 100)  # no task may hold a batch
    assert fit().centers == pytest.approx(now)


def test_label_scores_by_hand(spark):
    def run(pairs):
        df = spark.createDataFrame(pairs, "label int, cluster int")
        return tuple(scores.label_scores(df).first())

    assert run([(0, 5), (0, 5), (1, 3)]) == (1.0, 1.0, 1.0, 1.0)
    assert run([(0, 0), (1, 0), (2, 0)]) == (0.0, 1.0, 0.0, 0.0)
    assert run([(0, 0), (0, 1), (0, -1)])[:3] == (1.0, 0.0, 0.0)
    a = run([(0, 0), (0, 1), (1, 1), (1, 1)])
    b = run([(0, 0), (1, 0), (1, 1), (1, 1)])
    assert a[2] == pytest.approx(b[2]) and a[0] == pytest.approx(b[1])


def test_silhouette(spark, monkeypatch):
    x = np.array([[0.0], [1.0], [10.0], [30.0]])
    part = spark.createDataFrame([(0, 0), (1, 0), (2, 0), (3, 1)], "id long, cluster int")
    rows = {r["id"]: r["silhouette"] for r in scores.silhouette_samples(table(spark, x), part).collect()}
    assert rows[3] == 0.0  # alone in its cluster
    assert rows[0] == pytest.approx((30 - 5.5) / 30)
    one = part.withColumn("cluster", F.lit(-1))
    assert scores.silhouette(table(spark, x), one).first()[0] is None
    monkeypatch.setattr(scores, "MAX_SAMPLE_BYTES", 16)
    with pytest.raises(ValueError):
        scores.silhouette(table(spark, x), part)


def test_range_and_nearest_joins(spark, cloud, monkeypatch):
    df = table(spark, cloud)
    space = neighbors.build_space(df, block_rows=9)
    assert space.n_points == 81 and len(space.cells) > 3
    d = gaps(cloud)
    counted = {r["id"]: r["n"] for r in neighbors.neighbour_counts(space, 0.6).collect()}
    assert counted == {i: int((d[i] <= 0.6).sum()) for i in range(120)}
    want = {(i, j) for i in range(81) for j in range(i + 1, 81) if d[i, j] <= 0.6}
    short = neighbors.eps_join(space, 0.6, factored=True).collect()
    assert {(r["src"], r["dst"]) for r in short} == want
    for block in (neighbors.COPY_BLOCK, 7):  # the 40 copies under one key, and under several
        monkeypatch.setattr(neighbors, "COPY_BLOCK", block)
        every = neighbors.eps_join(space, 0.6).collect()  # copies and all their pairs
        assert len(every) == len({(r["src"], r["dst"]) for r in every})
        assert {(r["src"], r["dst"]) for r in every} == {
            (i, j) for i in range(120) for j in range(i + 1, 120) if d[i, j] <= 0.6}
    assert neighbors.copies(space).count() == 39
    for k in (1, 3):
        got = {(r["src"], r["dst"]) for r in neighbors.knn_join(space, k).collect()}
        e = d.copy()
        np.fill_diagonal(e, np.inf)
        order = np.lexsort((np.broadcast_to(np.arange(120), e.shape), e), axis=1)[:, :k]
        assert got == {(i, int(j)) for i in range(120) for j in order[i]}


@pytest.mark.parametrize("spans", [1, 3])
def test_blocks_travel_together(spark, cloud, monkeypatch, spans):
    monkeypatch.setattr(neighbors, "SPANS", spans)
    space = neighbors.build_space(table(spark, cloud), block_rows=4)
    per, blocks = space.span_blocks, int(space.cells["blocks"].sum())
    assert blocks > 12 and 4 < per <= blocks
    asked = space.points.select("id", "x", "cell", F.lit(99.0).alias("radius"))
    sent = [r["visit"] for r in neighbors.route(space, asked).collect()]
    assert len(sent) == 81 and {len(v) for v in sent} == {-(-blocks // per)}  # every row once for a span
    assert {sum(int(b).bit_count() for b in v) for v in sent} == {blocks}
    d = gaps(cloud)
    counted = {r["id"]: r["n"] for r in neighbors.neighbour_counts(space, 0.6).collect()}
    assert counted == {i: int((d[i] <= 0.6).sum()) for i in range(120)}
    np.fill_diagonal(d, np.inf)
    order = np.lexsort((np.broadcast_to(np.arange(120), d.shape), d), axis=1)[:, :3]
    got = {(r["src"], r["dst"]) for r in neighbors.knn_join(space, 3).collect()}
    assert got == {(i, int(j)) for i in range(120) for j in order[i]}
    assert labels(dbscan(space, 0.6, 5)) == brute_dbscan(cloud, 0.6, 5)


def test_nearest_ties_go_to_lower_ids(spark):
    x = np.array([[1.0, 0], [-1, 0], [0, 1], [0, -1], [0, 0]])
    got = [r["dst"] for r in neighbors.knn_join(table(spark, x), 2).filter("src = 4").orderBy("dst").collect()]
    assert got == [0, 1]


def test_dbscan(spark, cloud):
    space = neighbors.build_space(table(spark, cloud), block_rows=9)
    for eps, least in ((0.3, 4), (0.6, 5), (5.0, 3)):
        assert labels(dbscan(space, eps, least)) == brute_dbscan(cloud, eps, least)


def test_dbscan_border_and_boundary(spark):
    x = np.array([[0.0], [0.5], [1.0], [2.0], [3.0], [3.5], [4.0]])
    assert labels(dbscan(table(spark, x), 1.0, 3)) == brute_dbscan(x, 1.0, 3)
    assert labels(dbscan(table(spark, [[0], [1]]), 1.0, 2)) == [0, 0]
    assert labels(dbscan(table(spark, [[0], [5]]), 1.0, 2)) == [-1, -1]


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(50, 50)]
    df = spark.createDataFrame(edges, "src long, dst long")
    nodes = spark.createDataFrame([(i,) for i in [*range(41), 50, *range(100, 130)]], "id long")
    want = {i: 0 if i < 41 else (50 if i == 50 else 100) for i in [*range(41), 50, *range(100, 130)]}
    for small in (0, 1000):
        got = connected_components(df, nodes, task_edges=small).collect()
        assert {r["id"]: r["component"] for r in got} == want
    with pytest.raises(RuntimeError):
        connected_components(df, nodes, max_rounds=1, task_edges=0)


def test_symmetrise(spark):
    df = spark.createDataFrame([(1, 2, 1.0), (2, 1, 1.0), (1, 3, 1.0)], "src long, dst long, w double")
    assert {tuple(r) for r in symmetrise(df).collect()} == {
        (1, 2, 1.0), (2, 1, 1.0), (1, 3, 0.5), (3, 1, 0.5)}


def test_explained_variance_is_of_fitted_components(spark, tmp_path):
    x = np.random.default_rng(5).normal(size=(300, 64)) * 1.15 ** np.arange(64) + 0.5  # the first columns say least
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>").write.parquet(str(tmp_path / "embeddings.parquet"))
    z = x @ np.linalg.svd(x, full_matrices=False)[2][:16].T
    got = catalog.explained_variance_svd(spark, str(tmp_path)).first()[0]
    assert got == pytest.approx(z.var(0).sum() / x.var(0).sum(), abs=1e-3)


def test_ward(spark):
    x = np.array([[0.0, 0], [0, 0.1], [0.1, 0], [9, 9], [9, 9.1], [9.1, 9], [9, 9]])
    assert labels(ward(table(spark, x), 2)) == [0, 0, 0, 1, 1, 1, 1]
    assert labels(ward(table(spark, x), 1)) == [0] * 7
    with pytest.raises(ValueError):
        ward(table(spark, x), 7)


def test_ward_regions_agree_with_one_task(spark, cloud):
    x = cloud[:60]
    one = ward(neighbors.build_space(table(spark, x)), 2)
    space = neighbors.build_space(table(spark, x), block_rows=12)
    many = ward(space, 2, group_rows=20)
    assert labels(one) == labels(many) == [0] * 30 + [1] * 30
    assert ward_tree(space, group_rows=20).count() == 59


def test_ward_tree_is_the_same_at_every_group_size(spark):
    x = np.random.default_rng(3).normal(size=(90, 3)).round(2)  # no clear groups, so the order of merges tells
    trees = []
    for rows, group in ((4096, None), (15, 40), (30, 20)):
        tree = ward_tree(neighbors.build_space(table(spark, x), block_rows=rows), group_rows=group)
        trees.append(sorted(tuple(r) for r in tree.collect()))
    assert len(trees[0]) == 89 and all(t == trees[0] for t in trees)


def by_levels(x, size, samples):
    """HDBSCAN by components at every distance: what the operator must give."""
    n = len(x)
    d = gaps(x)
    core = np.sort(d, axis=1)[:, samples - 1]
    reach = np.maximum(np.maximum(d, core[:, None]), core[None])
    np.fill_diagonal(reach, core)
    levels = np.unique(reach)
    floor = levels[levels > 0].min() * 1e-3
    running, clusters = [], []  # (members, cluster) of the big components; cluster: members, stability, parts
    for i, t in enumerate(levels):
        seen, comps = set(), []
        for v in range(n):
            if core[v] <= t and v not in seen:
                todo, comp = [v], set()
                while todo:
                    u = todo.pop()
                    if u not in comp:
                        comp.add(u)
                        todo += [int(z) for z in np.flatnonzero(reach[u] <= t) if z not in comp]
                seen |= comp
                if len(comp) >= size:
                    comps.append(comp)
        lam = 1 / max(t, floor)
        nxt = 1 / max(levels[i + 1], floor) if i + 1 < len(levels) else 0.0
        now = []
        for comp in comps:
            parts = [c for members, c in running if members <= comp]
            if len(parts) == 1:
                c = parts[0]
            else:
                c = {"stab": 0.0, "parts": parts}
                clusters.append(c)
            c["members"], c["stab"] = comp, c["stab"] + len(comp) * (lam - nxt)
            now.append((comp, c))
        running = now
    out = np.full(n, -1)
    tops = [c for _, c in running]

    def best(c):
        below = sum(best(p) for p in c["parts"])
        c["chosen"] = c["stab"] >= below
        return max(c["stab"], below)

    def pick(c):
        if c["chosen"]:
            return [c["members"]]
        return [m for p in c["parts"] for m in pick(p)]

    for c in tops:
        best(c)
        c["chosen"] = False
    for i, members in enumerate(sorted((m for c in tops for m in pick(c)), key=min)):
        out[sorted(members)] = i
    return out.tolist()


@pytest.mark.parametrize("seed", [0, 1])
def test_hdbscan_is_exact_and_does_not_depend_on_slices(spark, seed):
    rng = np.random.default_rng(seed)
    x = np.round(np.vstack([rng.normal(0, 1, (40, 3)), rng.normal(3, 0.4, (25, 3))]), 1)
    x[60:] = x[3]  # copies, and ties from rounding
    want = by_levels(x, 4, 4)
    assert labels(hdbscan(table(spark, x), 4)) == want
    assert labels(hdbscan(table(spark, x), 4, task_edges=9)) == want


def test_hdbscan_of_edges_of_one_length(spark, monkeypatch):
    """More edges of one length than a task may hold: sums settle them, and no task sees any."""
    grid = np.array([[i, j] for i in range(5) for j in range(4)], float)
    x = np.vstack([grid, 0.5 * grid + 20, [[9.0, 9.0], [9.0, 9.0], [9.0, 10.0], [9.0, 11.0], [40.0, 0.0]]])
    assert labels(hdbscan(table(spark, x), 4, 2, task_edges=12)) == by_levels(x, 4, 2)

    def refuse(*_):
        def run(nodes, edges):
            raise AssertionError(len(edges))

        return run

    monkeypatch.setattr(hdbscan_module, "_condense", refuse)
    assert labels(hdbscan(table(spark, grid), 4, 2, task_edges=4)) == by_levels(grid, 4, 2)


def test_hdbscan(spark):
    rng = np.random.default_rng(0)
    x = np.vstack([rng.normal(0, 0.1, (12, 2)), rng.normal(4, 0.1, (12, 2)), [[20.0, -20]]])
    assert labels(hdbscan(table(spark, x), 5)) == [0] * 12 + [1] * 12 + [-1]
    space = neighbors.build_space(table(spark, x), block_rows=8)
    near = neighbors.knn_points(space, 4)
    d = gaps(x)
    core = np.sort(d, axis=1)[:, 4]
    given = spark.createDataFrame([(i, float(c)) for i, c in enumerate(core)], "id long, core double")
    tree = spanning_tree(space, given, near).collect()
    reach = np.maximum(np.maximum(d, core[:, None]), core[None])
    best, inside, total = np.full(25, np.inf), np.zeros(25, bool), 0.0
    best[0] = 0.0
    for _ in range(25):
        i = int(np.where(inside, np.inf, best).argmin())
        inside[i], total = True, total + best[i]
        best = np.minimum(best, reach[i])
    assert len(tree) == 24 and sum(r["w"] for r in tree) == pytest.approx(total)


def test_forest_connects_what_the_mask_connects():
    from gatherum.operators.dbscan import _forest

    rng = np.random.default_rng(4)
    for size in (1, 5, 30):
        for share in (0.02, 0.1, 0.5):
            masks = [rng.random((12, size)) < share for _ in range(3)]
            label = np.arange(size)
            edges = []
            for s, mask in enumerate(masks):
                rows, columns = _forest(mask, label)
                assert all(mask[i, j] for i, j in zip(rows, columns))
                edges += [((s, int(i)), int(j)) for i, j in zip(rows, columns)]
            full = [((s, int(i)), int(j)) for s, m in enumerate(masks) for i, j in np.argwhere(m)]

            def parts(pairs):
                at = {}

                def root(v):
                    while at.setdefault(v, v) != v:
                        v = at[v]
                    return v

                for a, b in pairs:
                    at[root(a)] = root(b)
                groups = {}
                for v in list(at):
                    groups.setdefault(root(v), set()).add(v)
                return {frozenset(g) for g in groups.values()}

            assert parts(edges) == parts(full)
            assert len(edges) <= sum(m.any(axis=1).sum() for m in masks) + 4 * size


def test_a_self_loop_is_a_vertex(spark):
    edges = spark.createDataFrame([(1, 2), (7, 7)], "src long, dst long")
    got = {(r["id"], r["component"]) for r in connected_components(edges).collect()}
    assert got == {(1, 1), (2, 1), (7, 7)}


def test_lookup_join_with_a_hot_key_and_salts(spark, monkeypatch):
    from gatherum.operators import joins

    monkeypatch.setattr(joins, "SALT_ROWS", 3)
    big = spark.createDataFrame([(0 if i % 3 == 0 else i % 20, i) for i in range(300)], "k long, v long")
    table_ = spark.createDataFrame([(k, k * 10) for k in range(15)], "k long, w long")
    for how in ("inner", "left"):
        got = joins.lookup_join(big, table_, "k", how, hot_share=8, small_rows=10)
        want = big.join(table_, "k", how)
        assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def _wide_rows(spark):
    """Sparse rows of 10^7 columns: near copies, exact copies, empty rows, and rows of any length."""
    rng = np.random.default_rng(3)
    columns = np.sort(rng.choice(10_000_000, 60, replace=False))
    base = np.zeros((8, 60))
    for r in base:
        r[rng.choice(60, 12, replace=False)] = rng.random(12)
    x = base[rng.integers(0, 8, 70)] * (1 + 0.6 * rng.standard_normal((70, 60)))
    x[20:24] = x[3]
    x[30:33] = 0.0
    x[40:50] *= 0.2
    rows = [(i, Vectors.sparse(10_000_000, columns[r != 0].tolist(), r[r != 0].tolist())) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, ["id", "features"]), x


def test_wide_sparse_rows_are_never_dense(spark):
    """Counts, pairs and DBSCAN of rows that would take 80 MB each when dense, against brute force."""
    df, x = _wide_rows(spark)
    gap = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    for eps in (0.3, 0.8):
        near = gap <= eps
        for space in (sparse_pairs.build_sparse(df), sparse_pairs.build_sparse(df, blocks=3)):
            assert space.n_points == len(np.unique(x, axis=0)) and space.has_copies
            counted = {r["id"]: r["n"] for r in neighbors.neighbour_counts(space, eps).collect()}
            assert counted == dict(enumerate(near.sum(1)))
            pairs = {(r["src"], r["dst"]): r["dist"] for r in neighbors.eps_join(space, eps).collect()}
            i, j = np.nonzero(np.triu(near, 1))
            assert sorted(pairs) == list(zip(i, j))
            assert np.allclose([pairs[p] for p in zip(i, j)], gap[i, j], atol=1e-12)
            assert labels(dbscan(space, eps, 4)) == list(brute_dbscan(x, eps, 4))


def test_starts_of_wide_sparse_rows_hold_their_entries_only(spark, monkeypatch):
    """Candidates that would take 3 MB each when dense, under a limit of 8 MB for all of them, with and without copies."""
    rng = np.random.default_rng(5)
    columns = np.sort(rng.choice(400_000, 40, replace=False))
    x = np.repeat(np.eye(2, 40), 30, axis=0) + 0.05 * rng.random((60, 40)) * (rng.random((60, 40)) < 0.2)
    x[10:20] = x[3]
    rows = [(i, Vectors.sparse(400_000, columns[r != 0].tolist(), r[r != 0].tolist())) for i, r in enumerate(x)]
    monkeypatch.setattr(kmeans, "MAX_CENTRE_BYTES", 8_000_000)
    fit = kmeans.kmeans(spark.createDataFrame(rows, ["id", "features"]), 2)
    found = labels(fit.assignments)
    assert len(set(found[:30])) == len(set(found[30:])) == 1 and found[0] != found[30]
    dense = kmeans.Candidates(40, [(np.arange(40, dtype=np.int32), r) for r in x])
    sparse = kmeans.Candidates(400, [(np.flatnonzero(r).astype(np.int32), r[r != 0]) for r in x])
    assert dense.table is not None and sparse.table is None
    for seed in range(3):
        a, b = (kmeans._plus_plus(c, np.ones(60), 5, seed) for c in (dense, sparse))
        assert np.allclose(a, b[:, :40], atol=1e-12) and not b[:, 40:].any()


def test_sparse_rows_are_multiplied_by_their_entries(monkeypatch):
    """Rows of 200 columns of their own, 840 MB as one block, against numpy; few products and candidates at a time."""
    rng = np.random.default_rng(2)
    column = rng.permutation(500 * 200).reshape(500, 200)
    column.sort(axis=1)
    frame = pd.DataFrame({"indices": list(column.astype(np.int32)), "values": list(rng.random((500, 200)))})
    frame.at[7, "indices"], frame.at[7, "values"] = np.zeros(0, np.int32), np.zeros(0)
    centers = rng.random((3, 500 * 200))
    monkeypatch.setattr(kmeans, "CELLS", 30_000)
    found, sums = np.zeros((500, 3)), np.zeros_like(centers)
    tracemalloc.start()
    for which, rows in kmeans.row_batches(frame, 3):
        assert len(rows.column) <= 10_000 + 200
        found[which] = rows.times(centers.T.copy())
        rows.add_to(sums, np.arange(which.start, which.stop) % 3)
    assert tracemalloc.get_traced_memory()[1] < 40_000_000
    tracemalloc.stop()
    exact = [centers[:, i] @ v for i, v in zip(frame["indices"], frame["values"])]
    assert np.allclose(found, exact) and not found[7].any()
    assert all(np.allclose(sums[r % 3][frame["indices"][r]], frame["values"][r]) for r in range(500))
    drawn = [(frame["indices"][r], frame["values"][r]) for r in range(0, 60, 3)]
    held = kmeans.Candidates(500 * 200, [*drawn, (np.arange(5, dtype=np.int32), np.ones(5))])
    monkeypatch.setattr(kmeans, "TABLE_CELLS", 5_000)
    assert len(list(held.tables())) > 3
    at, gap = held.nearest(frame)
    every = np.zeros((500, 500 * 200))
    for r in range(500):
        every[r, frame["indices"][r]] = frame["values"][r]
    table = np.vstack([block for _, block in held.blocks()])
    brute = (table**2).sum(1) - 2 * every @ table.T
    assert np.allclose(gap, brute.min(1)) and list(at) == list(brute.argmin(1))


def test_mixed_rows_and_seeds_in_the_same_scans(spark):
    """Dense rows beside sparse ones give the fit of dense ones; a seed's fit does not hang on the others."""
    rng = np.random.default_rng(4)
    x = rng.random((90, 6)) * (rng.random((90, 6)) < 0.6) + np.repeat(np.eye(3, 6) * 4, 30, axis=0)
    both = [(i, Vectors.dense(r) if i % 2 else Vectors.sparse(6, np.flatnonzero(r).tolist(), r[r != 0].tolist())) for i, r in enumerate(x)]
    df, dense = spark.createDataFrame(both, ["id", "features"]), table(spark, x)
    fits = kmeans.kmeans_seeds(df, 3, [0, 5])
    for seed, fit in zip((0, 5), fits):
        alone = kmeans.kmeans(dense, 3, seed=seed)
        assert np.allclose(fit.centers, alone.centers) and abs(fit.wcss - alone.wcss) < 1e-9
        assert labels(fit.assignments) == labels(alone.assignments)


def test_wide_svd_packs_many_rows_together(spark):
    """A tile holds rows enough for a column to have several entries; products are those of the matrix."""
    rng = np.random.default_rng(5)
    x = np.where(rng.random((3000, 40)) < 0.1, rng.normal(size=(3000, 40)), 0.0)
    rows = [(i, Vectors.sparse(40, np.flatnonzero(r).tolist(), r[r != 0].tolist())) for i, r in enumerate(x)]
    [tile] = svd._packed(spark.createDataFrame(rows, ["id", "features"]).coalesce(1)).toPandas().itertuples()
    x, by = x[np.array(tile.ids)], rng.normal(size=(40, 3))
    total = np.ones((40, 3))
    product = svd._rows_times(tile, by)
    np.testing.assert_allclose(product, x @ by, atol=1e-12)
    assert sorted(svd._add_back(tile, product, total)) == list(range(40))
    np.testing.assert_allclose(total, 1 + x.T @ x @ by, atol=1e-10)


def test_unit_rows_work_out_their_norm_once():
    """Not for every entry: that is quadratic in the length of a row."""
    assert str(vectors.l2_normalise_array(F.col("x"))).count("aggregate(") == 1


def test_sparse_blocks_are_sent_and_rows_stay(spark, monkeypatch):
    """No row is shuffled for the blocks it meets; results of a few blocks are folded; rows of one id stay apart."""
    df, x = _wide_rows(spark)
    plans, store = [], sparse_pairs.cut
    monkeypatch.setattr(sparse_pairs, "FOLD", 2)
    monkeypatch.setattr(sparse_pairs, "cut", lambda t: plans.append(t._jdf.queryExecution().toString()) or store(t))
    space = sparse_pairs.build_sparse(df, blocks=5)
    plans.clear()
    counted = {r["id"]: r["n"] for r in sparse_pairs.sparse_counts(space, 0.8).collect()}
    near = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)) <= 0.8
    assert counted == {i: near[i].sum() for i in counted} and len(counted) == space.n_points
    assert not any("CoGroup" in p for p in plans)
    assert sum("MapInPandas" in p and "Exchange" not in p for p in plans) >= 5
    twins = df.filter("id in (0, 1)").withColumn("id", F.lit(7).cast("long"))
    assert sparse_pairs.sparse_pairs(sparse_pairs.build_sparse(twins), 100.0).count() == 1


def test_rows_without_neighbours_are_not_linked(spark, monkeypatch):
    """DBSCAN of sparse rows: what is near its own copies alone meets no other row a second time."""
    x = np.diag(np.arange(1.0, 13.0))
    x[3:6] = x[2]
    x[8] = x[7] + 0.1
    rows = [(i, Vectors.sparse(12, np.flatnonzero(r).tolist(), r[r != 0].tolist())) for i, r in enumerate(x)]
    met, compare = [], sparse_pairs.compare
    monkeypatch.setattr(sparse_pairs, "compare", lambda space, rows, *a: met.append(rows.count()) or compare(space, rows, *a))
    df = spark.createDataFrame(rows, ["id", "features"])
    assert labels(dbscan(df, 0.9, 2)) == [-1, -1, 0, 0, 0, 0, -1, 1, 1, -1, -1, -1]
    assert met == [9, 2]
    assert labels(dbscan(df, 0.01, 4)) == [-1, -1, 0, 0, 0, 0] + [-1] * 6


def test_short_passes_are_written_together(spark, monkeypatch):
    """Batches of several passes go through one job; the fit is that of a job for every step."""
    x = np.random.default_rng(2).normal(size=(120, 3))
    df, written, write = table(spark, x), [], kmeans._write_passes
    monkeypatch.setattr(kmeans, "_write_passes", lambda *a: written.append(a[3]) or write(*a))
    found = []
    for steps in (1, 10):
        monkeypatch.setattr(kmeans, "STEPS_PER_JOB", steps)
        fit = kmeans.minibatch_kmeans(df, 3, batch_size=60, max_iter=6, max_no_improvement=None, seed=1, start=x[:3])
        found.append((fit.centers, labels(fit.assignments)))
    assert written == [*(range(i, i + 1) for i in range(6)), range(5), range(5, 6)]
    np.testing.assert_array_equal(found[0][0], found[1][0])
    assert found[0][1] == found[1][1]


def test_fits_are_summed_up_a_few_at_a_time(spark, monkeypatch):
    """The driver holds the centres of all fits and the sums of the few that share a scan."""
    rng, width, k = np.random.default_rng(4), 20_000, 40
    rows = [(i, Vectors.sparse(width, sorted(rng.choice(width, 5, replace=False).tolist()), rng.random(5).tolist())) for i in range(80)]
    df = spark.createDataFrame(rows, ["id", "features"]).coalesce(1)
    monkeypatch.setattr(kmeans, "SWEEP_BYTES", k * width * 8)
    starts = [rng.random((k, width)) for _ in range(8)]
    tracemalloc.start()
    fits = kmeans.fit_many(df, starts, max_iter=1)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(fits) == 8 and peak < 8 * 8 * k * width + 8 * 8 * k * width
    alone = kmeans.fit_many(df, starts[5:6], max_iter=1)
    np.testing.assert_array_equal(alone[0][0], fits[5][0])
