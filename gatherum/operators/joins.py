"""Joins and indexes that hold up when one key owns a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatherum.session import cut

HOT_SHARE = 256  # a key is hot when it owns more than 1/HOT_SHARE of the rows
SALT_ROWS = 50_000_000  # rows of one key that one task joins
SMALL_ROWS = 1_000_000  # below this, even one key owning every row is a light task


def lookup_join(
    big: DataFrame,
    table: DataFrame,
    key: str,
    how: str = "inner",
    n_rows: int | None = None,
    hot_share: int = HOT_SHARE,
    small_rows: int | None = None,
) -> DataFrame:
    """Join of ``big`` with ``table`` (one row per key), safe against hot keys; inner or left.

    At most ``hot_share`` keys can each own more than ``1/hot_share`` of the rows, so the hot
    part of ``table`` has a proven size and is broadcast. A cold key may still own
    ``n / hot_share`` rows; the shuffle join deals every key over as many salts as keep that
    below ``SALT_ROWS`` rows a task, which repeats ``table`` as often. No row is dropped or
    capped. ``big`` is read three times, so pass a table that is stored, not one that is dear
    to compute.
    """
    small = SMALL_ROWS if small_rows is None else small_rows
    n = big.count() if n_rows is None else n_rows
    if n <= small:
        return big.join(table, key, how)
    hot_keys = cut(big.groupBy(key).count().filter(F.col("count") > n / hot_share).select(key))
    hot_table = F.broadcast(table.join(F.broadcast(hot_keys), key))
    hot = big.join(F.broadcast(hot_keys), key, "left_semi").join(hot_table, key, how)
    cold = big.join(F.broadcast(hot_keys), key, "left_anti")
    salts = -(-n // (hot_share * SALT_ROWS))
    if salts == 1:
        return hot.unionByName(cold.join(table, key, how))
    dealt = cold.withColumn("_salt", F.pmod(F.xxhash64(*cold.columns), F.lit(salts)).cast("int"))
    copies = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return hot.unionByName(dealt.join(copies, [key, "_salt"], how).drop("_salt"))


def with_sorted_index(df: DataFrame, order_col: str, index_col: str = "idx") -> DataFrame:
    """0-based position of each row in the order of ``order_col`` (unique), without one big task.

    A range sort leaves every partition holding one run of the order; adding the sizes of the
    partitions before it turns the position inside the partition into the global one.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    run = cut(
        df.repartitionByRange(parts, order_col)
        .sortWithinPartitions(order_col)
        .withColumn("_mid", F.monotonically_increasing_id())
    )
    # monotonically_increasing_id: partition number in the upper bits, position in the lower 33
    run = run.withColumn("_part", F.shiftright("_mid", 33)).withColumn(
        "_pos", F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1))
    )
    sizes = run.groupBy("_part").count().collect()  # one row per shuffle partition
    before, offsets = 0, []
    for row in sorted(sizes, key=lambda r: r["_part"]):
        offsets.append((row["_part"], before))
        before += row["count"]
    table = spark.createDataFrame(offsets or [(0, 0)], "_part long, _before long")
    return (
        run.join(F.broadcast(table), "_part")
        .withColumn(index_col, F.col("_before") + F.col("_pos"))
        .drop("_mid", "_part", "_pos", "_before")
    )


def align(labels: DataFrame, assignments: DataFrame) -> DataFrame:
    """``(id, label, cluster)``: the true label next to the cluster of the same row."""
    return labels.select("id", "label").join(assignments.select("id", "cluster"), "id")
