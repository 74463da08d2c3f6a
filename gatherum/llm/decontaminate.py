"""Benchmark decontamination with one Aho-Corasick automaton over normalised test windows.

Texts and items are lower-cased (A-Z) and cut into words of letters and digits. Every window of
``n`` item words is a pattern over word numbers; the automaton reads each document once and each
occurrence is mapped back to code-point offsets of the original text.

Null or wordless documents have no words and no hit; null or wordless items give no window; an
item with a null id marks words but is not listed. Rows are judged one by one, so repeated rows
all get the same answer; an empty item table hits nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatherum.llm.common import pieces_of, table_bytes
from gatherum.session import cut

#: Item bytes per automaton: at 10-word windows some 100 MB in a worker. More items take more passes.
MAX_ITEM_BYTES = 1 << 20
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_NORMAL = bytes(
    b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A
    else b + 32 if 0x41 <= b <= 0x5A else 0x20
    for b in range(256)
)
FOUND = "n_words long, spans array<struct<first:int,last:int>>, offsets array<struct<start:int,stop:int>>, items array<string>"


def words(text: bytes | None) -> list[bytes]:
    return text.translate(_NORMAL).split() if text else []


class _Patterns:
    """Windows of the items; the automaton is built once in each Python worker."""

    def __init__(self, items: list[tuple[str | None, bytes]], n: int):
        windows: dict[tuple, set] = {}
        for item, text in items:
            w = words(text)
            for i in range(max(1, len(w) - n + 1) if w else 0):
                windows.setdefault(tuple(w[i : i + n]), set()).add(item)
        self.windows = list(windows.items())
        self.built = None

    def __getstate__(self):
        return self.windows

    def __setstate__(self, windows):
        self.windows, self.built = windows, None

    def automaton(self):
        if self.built is None:
            number: dict[bytes, int] = {}
            machine = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
            for window, items in self.windows:
                key = tuple(number.setdefault(w, len(number) + 1) for w in window)
                machine.add_word(key, (len(key), tuple(i for i in items if i is not None)))
            if self.windows:
                machine.make_automaton()
            self.built = number, machine
        return self.built


def _search(text: bytes | None, number: dict, machine) -> tuple[int, list, set]:
    """Words, merged spans of hit words (first, last), and the items met."""
    found = words(text)
    ids = [number.get(w, 0) for w in found]
    spans: list[list[int]] = []
    items: set[str] = set()
    if number and any(ids):
        for end, (length, names) in machine.iter(tuple(ids)):
            items.update(names)
            first = end - length + 1
            while spans and spans[-1][1] >= first - 1:  # a longer pattern may begin further left
                first = min(first, spans.pop()[0])
            spans.append([first, end])
    return len(found), spans, items


def _merged(spans: list) -> list:
    out: list[list[int]] = []
    for first, last in sorted(spans):
        if out and out[-1][1] >= first - 1:
            out[-1][1] = max(out[-1][1], last)
        else:
            out.append([first, last])
    return out


def _offsets(text: bytes, spans: list) -> list[tuple[int, int]]:
    at = [m.span() for m in WORD.finditer(text.decode("utf-8", "replace"))]
    return [(at[a][0], at[b][1]) for a, b in spans]


def find(
    docs: DataFrame, items: DataFrame, n: int = 10, id_col: str = "doc_id", text_col: str = "text",
    item_id: str = "item_id", item_text: str = "text", max_item_bytes: int = MAX_ITEM_BYTES,
) -> DataFrame:
    """``(row, n_words, spans, offsets, items)`` for every row of ``docs``; ``row`` is that row.

    ``spans`` are inclusive word ranges hit by any window, ``offsets`` the same as code points
    of the original text (half open), ``items`` the ids of the items found. One pass over the
    documents for each ``max_item_bytes`` of items, so what is broadcast has a fixed bound.
    """
    spark = docs.sparkSession
    wanted = items.select(
        F.col(item_id).cast("string").alias("i"),
        F.col(item_text).cast("string").cast("binary").alias("t"),
    )
    parts = max(1, -(-2 * table_bytes(items, item_text) // max_item_bytes))
    if parts == 1 or table_bytes(items, item_text) <= max_item_bytes:
        parts = 1
    state = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.col(text_col).cast("string").cast("binary").alias("body"),
        F.array().cast("array<struct<first:int,last:int>>").alias("spans"),
        F.array().cast("array<string>").alias("items"),
    )
    row_type = state.schema["row"].dataType.simpleString()
    schema = f"row {row_type}, body binary, {FOUND}"
    for part in range(parts):
        own = wanted.filter(F.pmod(F.xxhash64("i", "t"), F.lit(parts)) == part)
        sent = spark.sparkContext.broadcast(_Patterns([tuple(r) for r in own.collect()], n))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            number, machine = sent.value.automaton()
            for batch in pieces_of(batches, "body"):
                out: dict[str, list] = {"n": [], "spans": [], "offsets": [], "items": []}
                bodies = batch.column("body").to_pylist()
                for text, spans, items in zip(
                    bodies, batch.column("spans").to_pylist(), batch.column("items").to_pylist(),
                    strict=True,
                ):
                    count, new, met = _search(text, number, machine)
                    if spans:
                        new = _merged(new + [[s["first"], s["last"]] for s in spans])
                    out["n"].append(count)
                    out["spans"].append([{"first": a, "last": b} for a, b in new])
                    out["offsets"].append(
                        [{"start": a, "stop": b} for a, b in _offsets(text, new)] if new else []
                    )
                    out["items"].append(sorted(met.union(items)))
                pair = lambda a, b: pa.list_(pa.struct([(a, pa.int32()), (b, pa.int32())]))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("row"), batch.column("body"), pa.array(out["n"], pa.int64()),
                        pa.array(out["spans"], pair("first", "last")),
                        pa.array(out["offsets"], pair("start", "stop")),
                        pa.array(out["items"], pa.list_(pa.string())),
                    ],
                    names=["row", "body", "n_words", "spans", "offsets", "items"],
                )

        state = state.mapInArrow(run, schema)
        if part + 1 < parts:
            state = cut(state)
    return state.drop("body")


def report(docs: DataFrame, items: DataFrame, n: int = 10, **names) -> DataFrame:
    """One row per document: how many words are hit, by how many items, and their digest."""
    id_col = names.get("id_col", "doc_id")
    narrow = docs.select(id_col, names.get("text_col", "text"))
    found = find(narrow, items, n, **names)
    n_hit = F.aggregate("spans", F.lit(0), lambda a, s: a + s["last"] - s["first"] + 1)
    return found.select(
        F.col(f"row.{id_col}").alias(id_col),
        "n_words",
        n_hit.cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def drop_hit_words(
    docs: DataFrame, items: DataFrame, n: int = 10, max_share: float = 0.5, **names
) -> DataFrame:
    """``docs`` without contamination: hit passages are cut out of the text by their offsets.

    A document of which at least ``max_share`` of the words are hit goes as a whole; every other
    text keeps what lies outside the passages, unchanged. Columns and their order stay.
    """
    text_col = names.get("text_col", "text")
    found = find(docs, items, n, **names)
    n_hit = F.aggregate("spans", F.lit(0), lambda a, s: a + s["last"] - s["first"] + 1)
    text = F.col(f"row.`{text_col}`")
    edge = F.concat(
        F.array(F.lit(0)), F.flatten(F.transform("offsets", lambda o: F.array(o["start"], o["stop"]))),
        F.array(F.char_length(text)),
    )
    pieces = F.transform(
        F.sequence(F.lit(0), F.size("offsets")),
        lambda i: F.substring(
            text, F.element_at(edge, 2 * i + 1) + 1,
            F.element_at(edge, 2 * i + 2) - F.element_at(edge, 2 * i + 1),
        ),
    )
    rest = F.when(F.size("offsets") == 0, text).otherwise(F.array_join(pieces, ""))
    kept = found.filter((n_hit == 0) | (n_hit < F.col("n_words") * max_share))
    return kept.select(
        *[(rest if c == text_col else F.col(f"row.`{c}`")).alias(c) for c in docs.columns]
    )
