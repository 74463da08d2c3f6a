"""Connected components by repeated contraction.

Each round every vertex moves to the neighbour (or itself) that comes first in a fresh random
order, and the graph shrinks to the vertices moved to (randomised contraction, after Boegeholz,
Brand and Todor 2020). The expected number of vertices falls by a constant factor per round,
whatever the shape of the graph, so long paths and huge stars both end after a logarithmic
number of rounds. Once the shrunken graph fits a single task (``task_edges``), that task ends it.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatherum.operators.joins import SMALL_ROWS, lookup_join
from gatherum.session import cut, keep, scratch

MAX_ROUNDS = 100
TASK_EDGES = 1_000_000  # 16 MB of edges: what one task settles by itself


def symmetrise(edges: DataFrame) -> DataFrame:
    """``0.5 * (C + C')`` of a weighted edge table ``(src, dst, w)``."""
    both = edges.select("src", "dst", "w").unionByName(
        edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")
    )
    return both.groupBy("src", "dst").agg((F.sum("w") * 0.5).alias("w"))


def _simple(edges: DataFrame) -> DataFrame:
    """Each undirected edge once, no loops."""
    return (
        edges.filter(F.col("src") != F.col("dst"))
        .select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))
        .distinct()
    )


def _settle(batches):
    """``(v, to)`` with the lowest id of the component, for the edges of one task."""
    frames = [f for f in batches if len(f)]
    if not frames:
        return
    edges = pd.concat(frames)
    ids, at = np.unique(edges[["src", "dst"]].to_numpy(), return_inverse=True)
    at = at.reshape(-1, 2)
    label = np.arange(len(ids))
    while len(at):
        ends = label[at]
        at = at[ends[:, 0] != ends[:, 1]]
        ends = label[at]
        np.minimum.at(label, ends.max(axis=1, initial=0), ends.min(axis=1, initial=len(ids)))
        while (label != label[label]).any():
            label = label[label]
    yield pd.DataFrame({"v": ids, "to": ids[label]})


def connected_components(
    edges: DataFrame, nodes: DataFrame | None = None, max_rounds: int = MAX_ROUNDS,
    task_edges: int = TASK_EDGES,
) -> DataFrame:
    """``(id, component)`` with the lowest id of the component as its name.

    ``edges (src, dst)`` are undirected; ``nodes (id)`` adds vertices that have no edge. Without
    them the vertices are those of the edges, self-loops included.
    """
    if nodes is None:
        nodes = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    with scratch():
        return cut(_components(edges, nodes, max_rounds, task_edges))


def _components(
    edges: DataFrame, nodes: DataFrame, max_rounds: int, task_edges: int
) -> DataFrame:
    graph = cut(_simple(edges))
    moves: list[DataFrame] = []
    for round_no in range(max_rounds + 1):
        n_edges = graph.count()
        if n_edges == 0:
            break
        if n_edges <= task_edges:
            moves.append(keep(graph.coalesce(1).mapInPandas(_settle, "v long, to long")))
            break
        if round_no == max_rounds:
            raise RuntimeError(f"components not settled after {max_rounds} rounds")
        rank = F.xxhash64("id", F.lit(round_no))
        sides = graph.select(
            F.inline(
                F.array(
                    F.struct(F.col("src").alias("v"), F.col("dst").alias("id")),
                    F.struct(F.col("dst").alias("v"), F.col("src").alias("id")),
                )
            )
        )
        first = sides.groupBy("v").agg(F.min(F.struct(rank.alias("h"), "id")).alias("f"))
        own = F.struct(F.xxhash64("v", F.lit(round_no)).alias("h"), F.col("v").alias("id"))
        move = keep(first.select("v", F.least("f", own)["id"].alias("to")))
        moves.append(move)
        moved = lookup_join(
            graph.withColumnRenamed("src", "v"), move, "v", n_rows=n_edges
        ).select(F.col("to").alias("src"), F.col("dst").alias("v"))
        moved = lookup_join(keep(moved) if n_edges > SMALL_ROWS else moved, move, "v", n_rows=n_edges)
        graph = cut(_simple(moved.select("src", F.col("to").alias("dst"))))
    if not moves:
        return nodes.select("id", F.col("id").alias("component"))
    # follow the moves from the last round back: each table is a fraction of the one before
    ends = moves[-1]
    for move in reversed(moves[:-1]):
        ends = keep(
            lookup_join(
                move.select("v", F.col("to").alias("key")),
                ends.select(F.col("v").alias("key"), F.col("to").alias("end")),
                "key",
                "left",
            ).select("v", F.coalesce("end", "key").alias("to"))
        )
    names = ends.groupBy("to").agg(F.min("v").alias("low")).select(
        "to", F.least("low", "to").alias("component")
    )
    named = lookup_join(ends, names, "to").select(F.col("v").alias("id"), "component")
    return (
        nodes.select("id")
        .join(named, "id", "left")
        .select("id", F.coalesce("component", "id").alias("component"))
    )
