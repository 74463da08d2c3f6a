"""Scores of a clustering, with and without true labels.

The label scores need only the label x cluster counts: one partially aggregated groupBy.
The silhouette works on a bounded sample whose rows are spread over tasks.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatherum.functions.sampling import hash_sample
from gatherum.session import keep, parallelism, scratch

LABEL_SCORES = ("homogeneity", "completeness", "v_measure", "ari")
MAX_SAMPLE_ROWS = 20_000
MAX_SAMPLE_BYTES = 1 << 30


def contingency(aligned: DataFrame, *runs: str) -> DataFrame:
    """``(runs.., label, cluster, n)`` from rows of ``(runs.., label, cluster)``."""
    return aligned.groupBy(*runs, "label", "cluster").agg(F.count(F.lit(1)).alias("n"))


def label_scores(aligned: DataFrame, *runs: str) -> DataFrame:
    """One row per run with ``homogeneity, completeness, v_measure, ari``.

    With counts n_ck, sums of n log n over the cells and both margins give every entropy, and
    sums of n(n-1)/2 the pair counts, so the table is never joined to its margins. Noise (-1)
    is scored as a cluster like any other; rows without a label are left out.
    """
    cells = contingency(aligned.filter(F.col("label").isNotNull()), *runs)
    run_cols = [F.col(r) for r in runs]
    level = F.grouping("label") * 2 + F.grouping("cluster")
    sets = [[*run_cols, F.col("label"), F.col("cluster")], [*run_cols, F.col("label")],
            [*run_cols, F.col("cluster")], run_cols]
    margins = cells.groupingSets(sets, *run_cols, F.col("label"), F.col("cluster")).agg(
        level.alias("level"), F.sum("n").alias("m")
    )
    m = F.col("m").cast("double")
    exact = F.col("m").cast("decimal(19,0)")
    pairs = (exact * (exact - F.lit(1).cast("decimal(10,0)"))).cast("decimal(38,0)")

    def over(lv: int, value, name: str):
        return F.sum(F.when(F.col("level") == lv, value)).alias(name)

    sums = margins.groupBy(*runs).agg(
        over(0, m * F.log(m), "cell"), over(1, m * F.log(m), "lab"), over(2, m * F.log(m), "clu"),
        over(3, m, "n"),
        over(0, pairs, "cell2"), over(1, pairs, "lab2"), over(2, pairs, "clu2"),
        over(3, pairs, "all2"),
    )
    n = F.col("n")
    zero = F.lit(0.0)
    # entropies in nats; tiny negatives are rounding of an exact zero
    h_lab = F.greatest(zero, F.log(n) - F.col("lab") / n)
    h_clu = F.greatest(zero, F.log(n) - F.col("clu") / n)
    mutual = F.greatest(zero, (F.col("cell") - F.col("lab") - F.col("clu")) / n + F.log(n))
    tiny = 1e-12
    scored = sums.select(
        *runs,
        F.when(h_lab < tiny, F.lit(1.0)).otherwise(F.least(F.lit(1.0), mutual / h_lab)).alias("homogeneity"),
        F.when(h_clu < tiny, F.lit(1.0)).otherwise(F.least(F.lit(1.0), mutual / h_clu)).alias("completeness"),
        "cell2", "lab2", "clu2", "all2",
    )
    h, c = F.col("homogeneity"), F.col("completeness")
    cell2, lab2, clu2, all2 = (F.col(x).cast("double") for x in ("cell2", "lab2", "clu2", "all2"))
    expected = lab2 * clu2 / all2
    same = (F.col("cell2") == F.col("lab2")) & (F.col("cell2") == F.col("clu2"))
    return scored.select(
        *runs, h, c,
        F.when(h + c < tiny, zero).otherwise(2.0 * h * c / (h + c)).alias("v_measure"),
        F.when(same, F.lit(1.0))
        .otherwise((cell2 - expected) / ((lab2 + clu2) / 2.0 - expected))
        .alias("ari"),
    )


def metric_rows(scores: DataFrame, *runs: str) -> DataFrame:
    """Long form ``(runs.., metric, value)`` of :func:`label_scores`."""
    return scores.unpivot(list(runs), list(LABEL_SCORES), "metric", "value")


def silhouette_samples(
    features: DataFrame,
    assignments: DataFrame,
    sample_size: int = 2000,
    seed: int = 0,
    n_rows: int | None = None,
) -> DataFrame:
    """``(id, cluster, silhouette)`` of a seeded sample of rows (all rows when there are fewer).

    The sample is at most ``sample_size`` rows, so it is held by every task; each task takes a
    slice of its rows and returns one number per row. Distances are Euclidean, computed over
    chunks of the columns so that a wide sparse sample is never dense as a whole. A row alone
    in its cluster scores 0. No rows come back when there are fewer than 2 clusters, or as
    many as rows: the score has no meaning there.
    """
    if not 2 <= sample_size <= MAX_SAMPLE_ROWS:
        raise ValueError(f"sample_size must be from 2 to {MAX_SAMPLE_ROWS}")
    spark = features.sparkSession
    chosen = hash_sample(assignments.select("id", "cluster"), sample_size, seed, n_rows=n_rows)
    raw = features.join(F.broadcast(chosen), "id").select(
        "id", "cluster", F.unwrap_udt(F.col("features")).alias("v")
    )
    with scratch():
        raw = keep(raw)  # at most sample_size rows
        cells = raw.agg(F.sum(F.size("v.values").cast("long"))).first()[0] or 0
        if 16 * cells > MAX_SAMPLE_BYTES:
            raise ValueError("the sample is too wide to hold: reduce sample_size or the dimensions")
        sample = raw.select("id", "cluster", "v.indices", "v.values").orderBy("id").toPandas()
    out = "id long, cluster int, silhouette double"
    size = len(sample)
    ids, clusters = np.unique(sample["cluster"], return_inverse=True)
    if len(ids) < 2 or len(ids) >= size:
        return spark.createDataFrame([], out)
    lengths = np.array([len(v) for v in sample["values"]])
    values = np.concatenate([np.asarray(v, dtype=float) for v in sample["values"]])
    # a row without indices is dense: its cells are at 0, 1, 2, ...
    columns = np.concatenate(
        [np.arange(m) if i is None else np.asarray(i, dtype=np.int64)
         for i, m in zip(sample["indices"], lengths)]
    ).astype(np.int64)
    used, columns = np.unique(columns, return_inverse=True)
    by_column = np.argsort(columns, kind="stable")
    held = spark.sparkContext.broadcast(
        {
            "id": sample["id"].to_numpy(),
            "label": ids,
            "cluster": clusters,
            "row": np.repeat(np.arange(size), lengths)[by_column],
            "column": columns[by_column],
            "value": values[by_column],
            "width": len(used),
        }
    )
    tasks = min(size, 4 * parallelism(spark))

    def score(batches):
        s = held.value
        n = len(s["id"])
        counts = np.bincount(s["cluster"], minlength=len(s["label"]))
        square = np.bincount(s["row"], weights=s["value"] ** 2, minlength=n)
        chunk = 2048
        starts = np.searchsorted(s["column"], np.arange(0, s["width"] + chunk, chunk))
        for batch in batches:
            for part in batch["part"]:
                mine = np.arange(part, n, tasks)
                dot = np.zeros((len(mine), n))
                for a, b in zip(starts[:-1], starts[1:]):
                    block = np.zeros((n, chunk))
                    block[s["row"][a:b], s["column"][a:b] % chunk] = s["value"][a:b]
                    dot += block[mine] @ block.T
                gap = np.sqrt(np.maximum(square[mine][:, None] + square[None, :] - 2 * dot, 0.0))
                gap[np.arange(len(mine)), mine] = 0.0
                sums = np.zeros((len(mine), len(counts)))
                for c in range(len(counts)):
                    sums[:, c] = gap[:, s["cluster"] == c].sum(axis=1)
                own = s["cluster"][mine]
                at = np.arange(len(mine))
                inside = sums[at, own] / np.maximum(counts[own] - 1, 1)
                other = sums / counts
                other[at, own] = math.inf
                near = other.min(axis=1)
                top = np.maximum(inside, near)
                value = np.where(top > 0, (near - inside) / np.where(top > 0, top, 1.0), 0.0)
                value[counts[own] == 1] = 0.0
                yield pd.DataFrame(
                    {"id": s["id"][mine], "cluster": s["label"][own], "silhouette": value}
                )

    slices = spark.range(0, tasks, 1, tasks).select(F.col("id").cast("int").alias("part"))
    return slices.mapInPandas(score, out)


def silhouette(
    features: DataFrame,
    assignments: DataFrame,
    sample_size: int = 2000,
    seed: int = 0,
    n_rows: int | None = None,
) -> DataFrame:
    """One row ``(silhouette)``: the mean over the sample, null where it is undefined."""
    rows = silhouette_samples(features, assignments, sample_size, seed, n_rows)
    return rows.agg(F.avg("silhouette").alias("silhouette"))


def noise_fraction(assignments: DataFrame) -> DataFrame:
    return assignments.agg(
        F.avg(F.when(F.col("cluster") == -1, 1.0).otherwise(0.0)).alias("noise_fraction")
    )


def evaluation_summary(metrics: DataFrame) -> DataFrame:
    """``(estimator, metric, mean, std)`` over the runs of each; population deviation."""
    return metrics.groupBy("estimator", "metric").agg(
        F.avg("value").alias("mean"), F.stddev_pop("value").alias("std")
    )
