"""CSV records that span lines, read by many tasks from one large file.

Spark's own reader gives a file with multi-line fields to one task. Here lines are read by byte
ranges instead. A line begins inside a quoted field if an odd number of quotes comes before it, so
the parity at the start of each range is a running sum of one number a range; each task then puts
its own lines together, and only records that cross the border of a range are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gatherum.session import cut

#: A record's part in its range: all of it, its end, its beginning, or a range without either.
WHOLE, END, BEGINNING, MIDDLE = range(4)
PARSING = {"escape": '"', "mode": "FAILFAST"}


class _Range:
    """Puts the lines of one byte range together as they come."""

    def __init__(self, place: tuple[str, int, bool]):
        self.place, self.odd = place, place[2]
        self.open: list[str] = []
        self.kind = END if self.odd else WHOLE
        self.at = 0

    def add(self, lines: pa.Array) -> Iterator[tuple[int, int, str]]:
        """Records ``(kind, at, text)`` that end in these lines."""
        quotes = pc.count_substring(lines, '"').to_numpy()
        inside = (np.cumsum(quotes) + self.odd) % 2 == 1  # the line ends inside a quoted field
        texts = lines.to_pylist()
        first = 0
        for stop in np.flatnonzero(~inside) + 1:
            yield self.kind, self.at, "\n".join(self.open + texts[first:stop])
            self.open, self.kind, self.at, first = [], WHOLE, self.at + 1, stop
        self.open += texts[first:]
        self.odd = bool(inside[-1])

    def rest(self) -> Iterator[tuple[int, int, str]]:
        if self.open:
            yield MIDDLE if self.kind == END else BEGINNING, self.at, "\n".join(self.open)


def _put_together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now = None

    def rows(place: tuple, found: Iterator[tuple[int, int, str]]) -> pa.RecordBatch:
        found = list(found)
        return pa.RecordBatch.from_pydict({
            "file": pa.array([place[0]] * len(found), pa.string()), "start": pa.array([place[1]] * len(found), pa.int64()),
            "kind": pa.array([f[0] for f in found], pa.int32()), "at": pa.array([f[1] for f in found], pa.int64()),
            "record": pa.array([f[2] for f in found], pa.string()),
        })

    for batch in batches:
        file, start, odd = (batch.column(i) for i in range(3))
        codes = start.to_numpy()
        names = file.dictionary_encode().indices.to_numpy()
        new = np.flatnonzero((np.diff(codes) != 0) | (np.diff(names) != 0)) + 1 if len(codes) else []
        edges = [0, *new, batch.num_rows]
        for a, b in zip(edges, edges[1:], strict=False):
            if a == b:
                continue
            place = file[int(a)].as_py(), start[int(a)].as_py(), odd[int(a)].as_py()
            if now is None or now.place != place:
                if now is not None:
                    yield rows(now.place, now.rest())
                now = _Range(place)
            yield rows(place, now.add(batch.column(3).slice(a, b - a)))
    if now is not None:
        yield rows(now.place, now.rest())


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """``(file, start, at, record)``: one row per record, header lines included, blank lines not.

    ``start`` is the byte range in which a record begins and ``at`` its number there. A file whose
    quotes do not pair up is an error, and so is a range that was cut differently between the two
    scans. The table of ranges that is broadcast has one row for each
    ``spark.sql.files.maxPartitionBytes`` of input.
    """
    lines = spark.read.text(path, lineSep="\n").select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value"
    )
    quotes = F.char_length("value") - F.char_length(F.replace("value", F.lit('"'), F.lit("")))
    ranges = lines.groupBy("file", "start").agg(F.sum(quotes).alias("quotes"))
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    known = ranges.select("file", "start", (F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2 == 1).alias("odd"))
    placed = lines.join(F.broadcast(known), ["file", "start"], "left")
    odd = F.coalesce("odd", F.raise_error(F.lit("byte ranges changed between two scans")).cast("boolean"))
    parts = cut(placed.select("file", "start", odd.alias("odd"), "value").mapInArrow(  # read for the header, whole and across
        _put_together, "file string, start long, kind int, at long, record string"
    ))
    whole = parts.filter(F.col("kind") == WHOLE).drop("kind")
    across = parts.filter(F.col("kind") != WHOLE)
    # within a range an end comes before a beginning
    order = Window.partitionBy("file").orderBy("start", "at", "kind")
    numbered = across.withColumn("n", F.sum((F.col("kind") == BEGINNING).cast("int")).over(order))
    joined = numbered.groupBy("file", "n").agg(
        F.min("start").alias("start"), F.min_by("at", F.struct("start", "at")).alias("at"),
        F.array_sort(F.collect_list(F.struct("start", "at", "kind", "record"))).alias("parts"),
    )
    closed = F.element_at("parts", -1)["kind"] == END
    text = F.when(closed, F.array_join(F.col("parts.record"), "\n")).otherwise(
        F.raise_error(F.concat(F.lit("a quoted field does not end in "), F.col("file"))).cast("string")
    )
    every = whole.unionByName(joined.select("file", "start", "at", text.alias("record")))
    plain = F.regexp_replace("record", r"\r$", "")
    return every.select("file", "start", "at", plain.alias("record")).filter(F.col("record") != "")


def read_csv(spark: SparkSession, path: str, types: dict[str, T.DataType]) -> DataFrame:
    """The columns named in ``types``, and ``_order``, the order of the file, as a struct.

    Columns are found by the header, which all files must share; others are not returned. A row
    with another number of fields, or a value that is not of its column's type, is an error; an
    empty field is null, with quotes or without, as in Spark's own reader.
    """
    records = csv_records(spark, path)
    # a header begins at byte 0, so only the first range of a file is asked for it
    headers = [r[0] for r in records.filter("start = 0 AND at = 0").select("record").distinct().limit(2).collect()]
    if not headers:
        return spark.createDataFrame([], T.StructType(
            [T.StructField(n, t) for n, t in types.items()]
            + [T.StructField("_order", T.StructType([T.StructField("file", T.StringType()), T.StructField("start", T.LongType()),
                                                     T.StructField("at", T.LongType())]))]
        ))
    if len(headers) > 1:
        raise ValueError(f"the files at {path} have different headers")
    names = _header_names(headers[0])
    missing = [n for n in types if n not in names]
    if missing:
        raise ValueError(f"no column {missing} in the header {names}")
    ddl = ", ".join(f"c{i} {types.get(n, T.StringType()).simpleString()}" for i, n in enumerate(names))
    rows = records.filter("start > 0 OR at > 0")
    parsed = rows.select(
        F.struct("file", "start", "at").alias("_order"), F.from_csv("record", ddl, PARSING).alias("r")
    )
    return parsed.select(*[F.col(f"r.c{names.index(n)}").alias(n) for n in types], "_order")


def _header_names(line: str) -> list[str]:
    fields, field, quoted = [], "", False
    for c in line.removeprefix("\ufeff"):
        if c == '"':
            quoted = not quoted
        elif c == "," and not quoted:
            fields, field = [*fields, field], ""
        else:
            field += c
    return [*fields, field]
