"""Sharding by a minimax contiguous partition of atomic groups.

Documents with equal texts form one atomic group. Groups are ordered by the digest of their text;
the smallest capacity that lets at most ``shards`` contiguous runs hold everything is found by
binary search with a greedy check, and the sequence is cut there. The search works on sums over
digest prefixes: first of 16 bits, then finer ones only where a cut may fall, until every cut
lies between two groups. So the driver sees a bounded table and the cuts are exact.

All null texts form one group, apart from the empty text; both have size 16. Rows with equal ids
or with a null id are separate rows. With fewer groups than shards the last shards are empty;
an empty table gives an empty result. A group larger than the even share sets the capacity.
"""

from __future__ import annotations

import bisect
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gatherum.session import cut

SHARDS, OVERHEAD = 40, 16
#: Hex digits of the first prefix and of each finer one; digits in a digest.
FIRST, STEP, DIGITS = 4, 1, 32
#: Cells in which the rows of a shard are numbered: tasks for one shard.
CELLS = 1024


def _greedy(sums: list[int], prefix: list[int], capacity: int, shards: int) -> list[int] | None:
    """Indexes at which a greedy filling starts new shards, or None if ``shards`` do not do."""
    cuts, at = [], 0
    while at < len(sums):
        nxt = bisect.bisect_right(prefix, prefix[at] + capacity) - 1
        if nxt == at or len(cuts) == shards:
            return None
        cuts.append(at)
        at = nxt
    return cuts


def smallest_capacity(sums: list[int], shards: int) -> int:
    """The least capacity for which greedy filling needs at most ``shards`` shards."""
    prefix = [0, *accumulate(sums)]
    low, high = max([*sums, -(-prefix[-1] // shards)], default=0), prefix[-1]
    while low < high:
        mid = (low + high) // 2
        if _greedy(sums, prefix, mid, shards) is None:
            low = mid + 1
        else:
            high = mid
    return low


def _open_cells(cells: list[tuple[str, int, int]], shards: int) -> set[str]:
    """Prefixes of cells with several groups in which a cut of the best partition may lie.

    With such cells as fluid the capacity can be no smaller than ``low``; with them as atoms it
    need be no larger than ``high``. Whatever the capacity between, the s-th cut lies between the
    greedy positions of the two, each of which loses at most what fluid cells allow.
    """
    sums = [size for _, size, _ in cells]
    prefix = [0, *accumulate(sums)]
    atoms = [size if n == 1 else 0 for _, size, n in cells]
    high = smallest_capacity(sums, shards)
    low = max([-(-prefix[-1] // shards), *atoms])
    found: set[str] = set()
    early, late = 0, 0  # bounds, in bytes, of where shard s ends
    for _ in range(shards):
        # least end: capacity low from the earliest start, backed off to a cell's start if it is an atom
        reach = early + low
        at = min(bisect.bisect_right(prefix, reach) - 1, len(sums))
        early = prefix[at]
        late = min(late + high, prefix[-1])
        last = min(bisect.bisect_right(prefix, late) - 1, len(sums) - 1)
        found.update(c[0] for c in cells[at : last + 1] if c[2] > 1)
        if early >= prefix[-1]:
            break
    return found


def cut_points(slim: DataFrame, shards: int) -> tuple[list[str], int]:
    """(digests at which shards after the first begin, capacity) for ``slim (digest, size)``."""
    groups = slim.groupBy("digest").agg(F.sum("size").alias("size"))
    groups = cut(groups)
    width = FIRST
    cells = _sums(groups, width)
    while True:
        wanted = _open_cells(cells, shards) if cells else set()
        if not wanted or width >= DIGITS:
            break
        fine = groups.filter(F.substring("digest", 1, width).isin(sorted(wanted))) if len(wanted) < 5000 else groups.join(
            F.broadcast(groups.sparkSession.createDataFrame([(w,) for w in wanted], "p string")),
            F.substring("digest", 1, width) == F.col("p"), "left_semi",
        )
        width += STEP
        cells = sorted([c for c in cells if c[0] not in wanted] + _sums(fine, width))
    sums = [size for _, size, _ in cells]
    capacity = smallest_capacity(sums, shards)
    begins = _greedy(sums, [0, *accumulate(sums)], capacity, shards) or []
    return [cells[i][0] for i in begins[1:]], capacity


def _sums(groups: DataFrame, width: int) -> list[tuple[str, int, int]]:
    rows = groups.groupBy(F.substring("digest", 1, width).alias("p")).agg(
        F.sum("size").alias("size"), F.count("*").alias("n"), F.min("digest").alias("d")
    ).collect()  # at most 16^4 first, then 16 for each prefix in which a cut may lie
    return sorted((r["d"] if r["n"] == 1 else r["p"], r["size"], r["n"]) for r in rows)


def assign(
    docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text",
    overhead: int = OVERHEAD, cells: int = CELLS,
) -> DataFrame:
    """``(key, size, text_crc32, shard, slot)`` for every row; slots count from 0 in each shard."""
    text = F.col(text_col).cast("string")
    slim = cut(docs.select(
        F.col(id_col).alias("key"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + overhead).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.coalesce(F.md5(text.cast("binary")), F.lit("")).alias("digest"),
    ))
    begins, _ = cut_points(slim.select("digest", "size"), shards)
    bounds = F.array(*[F.lit(b) for b in begins]).cast("array<string>")
    placed = slim.withColumn("shard", F.size(F.filter(bounds, lambda b: b <= F.col("digest")))).withColumn(
        "cell", F.pmod(F.xxhash64("key", "digest", F.lit(7)), F.lit(cells)).cast("int")
    )
    filled = placed.groupBy("shard", "cell").agg(F.count("*").alias("n"))  # shards x cells rows
    before = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = filled.select("shard", "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("shard", "cell").orderBy("key", "digest")
    return (
        placed.withColumn("rank", F.row_number().over(inside))
        .join(F.broadcast(offsets), ["shard", "cell"])
        .select("key", "size", "text_crc32", "shard", (F.col("offset") + F.col("rank") - 1).alias("slot"))
    )
