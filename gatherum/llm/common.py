"""Small helpers that several operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a task works on at a time; one longer text is a piece of its own.
PIECE_BYTES = 8 << 20
BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Lower the session's limit on an Arrow batch to ``PIECE_BYTES``, if it is higher.

    Spark fills a batch up to 10,000 rows or 64 MB, and holds it on both sides of the pipe; rows
    that carry whole texts twice make that hundreds of MB for a task.
    """
    now = spark.conf.get(BATCH_CONF, "67108864b").lower().rstrip("b")
    unit = {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30, "t": 1 << 40}.get(now[-1:], 1)
    size = int(now.rstrip("kmgt") or 0) * unit
    if size <= 0 or size > PIECE_BYTES:
        spark.conf.set(BATCH_CONF, f"{PIECE_BYTES}b")


def pieces_of(batches: Iterator[pa.RecordBatch], column: str, size: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``size`` bytes of ``column``, so that a task's memory is bounded."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            done = ends[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, done + size, "right")))
            yield batch.slice(at, stop - at)
            at = stop


def held_out(id_col: str, buckets: int, bucket: int) -> Column:
    """Is crc32 of the id as text, modulo ``buckets``, equal to ``bucket``? False for a null id."""
    part = F.crc32(F.col(id_col).cast("string")) % buckets
    return F.coalesce(part == bucket, F.lit(False))


def per_row(
    df: DataFrame, id_col: str, text_col: str, compute: Callable[[list], pa.RecordBatch],
    schema: str, with_row: bool = False,
) -> DataFrame:
    """Run ``compute`` on batches of texts, without a shuffle.

    ``compute`` takes a list of texts as UTF-8 bytes (or None) and returns as many rows of
    ``schema``. The result has ``key`` (the id), those columns, and ``row``, the whole input row
    as a struct, if asked for: a struct, so that no name of the input can clash.
    """
    parts = [F.col(id_col).alias("key"), F.col(text_col).cast("string").cast("binary").alias("body")]
    if with_row:
        parts.append(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))
    source = df.select(*parts)
    kept = [f"key {df.schema[id_col].dataType.simpleString()}"]
    if with_row:
        kept.append(f"row {source.schema['row'].dataType.simpleString()}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of(batches, "body"):
            found = compute(batch.column(1).to_pylist())
            own = [batch.column(0)] + ([batch.column(2)] if with_row else [])
            names = ["key"] + (["row"] if with_row else [])
            yield pa.RecordBatch.from_arrays(
                own + found.columns, names=names + found.schema.names
            )

    return source.mapInArrow(run, ", ".join([*kept, schema]))


def table_bytes(df: DataFrame, text_col: str) -> int:
    """UTF-8 bytes of all texts, from one aggregate."""
    return df.agg(F.sum(F.octet_length(F.col(text_col).cast("string")))).first()[0] or 0


def split_words(texts: list) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Words of white-space separated texts, without a Python object for each.

    Returns for all texts, one after the other: where each text's words begin (one entry more
    than texts), the distinct words as binary, and each word's index among them.
    """
    plain = pa.array(texts, pa.binary()).cast(pa.large_binary())
    lists = pc.ascii_split_whitespace(plain.view(pa.large_string()))
    flat = lists.flatten()
    size = pc.binary_length(flat)
    real = pc.not_equal(size, 0)
    lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
    owner = np.repeat(np.arange(len(texts)), lengths)
    if not pc.all(real, min_count=0).as_py():
        flat, owner = flat.filter(real), owner[real.to_numpy(zero_copy_only=False)]
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(np.bincount(owner, minlength=len(texts)), out=starts[1:])
    coded = flat.dictionary_encode()
    return starts, coded.dictionary.view(pa.large_binary()), coded.indices.to_numpy().astype(np.int64)
