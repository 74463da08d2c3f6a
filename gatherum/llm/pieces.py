"""SentencePiece encoding and decoding as a relational lattice.

Texts are cut between any two characters that stand side by side in no piece: no piece crosses
such a place, so what lies between, an atom, is encoded alone. Atoms that are pieces, and
characters without a piece, which become bytes, are settled by a look-up in the piece table. The
other distinct atoms are exploded into substrings no longer than the longest piece, which are
equi-joined to the piece table; the edges of an atom are grouped and folded with Spark's
``aggregate``.

The model files at hand hold byte-pair merges, not unigram probabilities, so a Viterbi path over
their scores is not the model's answer. The fold goes over an atom's edges once, best score first,
and takes an edge if both its ends are still ends of parts. That is the model's own order: the
pieces inside a piece are merged before it (checked when the model is read), and what happens
between two ends that stay does not depend on what lies outside.

The documents are packed into chunks of bounded size and shuffled once; each chunk sends its open
distinct atoms to the lattice and gets their ids back, so no word occurrence is ever shuffled and
no dictionary is broadcast. The piece table has the model's fixed size. Atoms of ``MASK_CHARS``
characters and more, whose ends do not fit into a bit mask, are merged with a heap instead.

A null text has null ids, an empty one none; an empty table gives an empty result. Repeated rows
and ids are encoded row by row, and a long text is worked on a slice at a time. Decoding drops the
one space that encoding put in front; U+2581 reads as a space, as in the model.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from gatherum.llm.common import pieces_of, small_batches, table_bytes

SPACE = "▁"
#: UTF-8 bytes of text in a chunk, characters of an atom that fit in the mask, text cut at a time.
CHUNK_BYTES, MASK_CHARS, SLICE = 4 << 20, 60, 1 << 20
#: Most partitions of a shuffle; each holds more chunks beyond that.
MOST_PARTS = 1 << 14
#: An edge in one number, in the order of merging: 23 bits of place, 6 of start, 6 of size, 28 of id.
NO_PLACE = (1 << 23) - 1


class Model:
    """The pieces of a model file: merge ranks, ids and byte pieces."""

    def __init__(self, path: str):
        own = sentencepiece.SentencePieceProcessor(model_file=path)
        self.rank: dict[str, float] = {}
        self.ids: dict[str, int] = {}
        self.byte_ids = [0] * 256
        self.spelled: list[bytes] = []
        for i in range(own.get_piece_size()):
            piece = own.id_to_piece(i)
            if own.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                self.spelled.append(bytes([int(piece[3:5], 16)]))
            elif own.is_control(i) or own.is_unknown(i):
                self.spelled.append(b"")
            else:
                self.rank[piece], self.ids[piece] = -own.get_score(i), i
                self.spelled.append(piece.replace(SPACE, " ").encode())
        merged = [p for p in self.ids if len(p) > 1]
        self.chars = "".join(sorted({c for p in merged for c in p}))
        if "\n" in self.chars or any(SPACE in p.lstrip(SPACE) for p in merged) or any(c not in self.ids for c in self.chars):
            raise ValueError("a piece of this model crosses words or lines, or has a character that is no piece")
        if any(self.merges(p) != (1, self.rank[p]) for p in merged):
            raise ValueError("a piece of this model is not merged from pieces that come before it")
        equal: dict[float, list[str]] = {}
        for piece in merged:
            equal.setdefault(self.rank[piece], []).append(piece)
        for group in equal.values():
            if len(group) > 1 and not self.in_one_pass(group):
                raise ValueError("pieces of this model with equal scores are not merged from left to right")
        self.longest = max(map(len, self.ids))

    def table(self, spark: SparkSession) -> DataFrame:
        """``(piece, place, size, id)``: as many rows as the model has pieces; single characters come last."""
        places = {r: i for i, r in enumerate(sorted(set(self.rank.values())))}
        rows = pa.table({
            "piece": pa.array(self.ids),
            "place": pa.array([places[r] if len(p) > 1 else NO_PLACE for p, r in self.rank.items()], pa.int64()),
            "size": pa.array([len(p) for p in self.ids], pa.int64()),
            "id": pa.array(self.ids.values(), pa.int64()),
        })
        return spark.createDataFrame(rows.to_pandas())

    def joins(self) -> np.ndarray:
        """May these two characters stand side by side in an atom? By their place in ``chars``; row and column 0 say no."""
        at = {c: i + 1 for i, c in enumerate(self.chars)}
        out = np.zeros((len(at) + 1, len(at) + 1), bool)
        for piece in self.ids:
            for a, b in zip(piece, piece[1:], strict=False):
                out[at[a], at[b]] = True
        return out

    def merges(self, word: str) -> tuple[int, float]:
        """Parts that are left of a word, and the latest rank of a merge in it; by definition, for short words."""
        part, latest = list(word), -1.0
        while True:
            pairs = [(self.rank[a + b], i) for i, (a, b) in enumerate(zip(part, part[1:], strict=False)) if a + b in self.rank]
            if not pairs:
                return len(part), latest
            rank, i = min(pairs)
            if len(part) == 2 and rank < latest:
                return 0, rank
            latest = max(latest, rank)
            part[i : i + 2] = [part[i] + part[i + 1]]

    def in_one_pass(self, group: list[str]) -> bool:
        """Are pieces of equal score runs of one character that the fold's order merges like the model?"""
        sizes, longest = sorted(map(len, group)), max(map(len, group))
        if len({c for piece in group for c in piece}) > 1:
            return False
        for n in range(2, 3 * longest):
            left = set(range(n + 1))
            for start in range(n):
                for size in sizes:
                    if {start, start + size} <= left:
                        left -= set(range(start + 1, start + size))
            ends = sorted(left)
            if self.merge(group[0][0] * n) != [self.ids[group[0][0] * (b - a)] for a, b in zip(ends, ends[1:], strict=False)]:
                return False
        return True

    def merge(self, word: str) -> list[int]:
        """Merges of one long atom with a heap: the same answer as the fold."""
        part, nxt = list(word), [*range(1, len(word)), -1]
        prev = list(range(-1, len(word) - 1))
        heap: list[tuple] = []

        def offer(i: int) -> None:
            j = nxt[i]
            if j >= 0 and (r := self.rank.get(part[i] + part[j])) is not None:
                heapq.heappush(heap, (r, i, part[i], part[j]))

        for i in range(len(part) - 1):
            offer(i)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = nxt[i]
            if part[i] != a or j < 0 or part[j] != b:
                continue
            part[i], part[j], nxt[i] = a + b, "", nxt[j]
            if nxt[i] >= 0:
                prev[nxt[i]] = i
            offer(i)
            if prev[i] >= 0:
                offer(prev[i])
        return [self.ids[p] for p in part if p]


class Atoms:
    """Cuts texts into atoms and settles those that are pieces or have none."""

    def __init__(self, model: Model):
        self.chars, self.join, self.byte_ids = model.chars, model.joins(), model.byte_ids
        self.names = [p.replace(SPACE, " ") for p in model.ids]
        self.ids = np.array(list(model.ids.values()), np.int32)

    def cut(self, texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
        """Where each text's atoms begin, the distinct atoms (with plain spaces), and each atom's number."""
        kind = np.zeros(0x110000, np.int32)
        kind[[ord(c) for c in self.chars]] = np.arange(1, len(self.chars) + 1)
        kind[32] = kind[ord(SPACE)]
        flat, width = self.join.ravel(), len(self.join)
        counts, dictionaries, numbers = [], [], []
        for part in pieces_of([pa.record_batch([texts], names=["text"])], "text", SLICE):
            own = [" " + t.replace(SPACE, " ") if t else "" for t in part.column(0).to_pylist()]
            ends = np.cumsum([len(t) for t in own])
            joined = "".join(own)
            code = np.frombuffer(joined.encode("utf-32-le"), "<u4")
            where = kind[code]
            first = np.ones(len(code) + 1, bool)  # an atom begins here
            if len(code):
                np.logical_not(flat.take(where[:-1] * width + where[1:]), out=first[1:-1])
                first[ends[ends < len(code)]] = True
            size = np.ones(len(code) + 1, np.int64)
            for more in (0x80, 0x800, 0x10000):
                size[:-1] += code >= more
            at = np.cumsum(size) - size  # where each character is in UTF-8
            offsets = at[first] if len(code) else np.zeros(1, np.int64)
            array = pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets), pa.py_buffer(joined.encode()))
            coded = array.dictionary_encode()
            so_far = np.concatenate([[0], np.cumsum(first[:-1])])
            counts.append(np.diff(so_far[np.concatenate([[0], ends])]))
            dictionaries.append(coded.dictionary)
            numbers.append(coded.indices.to_numpy())
        if not dictionaries:
            return np.zeros(1, np.int64), pa.array([], pa.large_string()), np.empty(0, np.int32)
        every = pc.unique(pa.concat_arrays(dictionaries))
        numbers = [pc.index_in(d, every).to_numpy(zero_copy_only=False)[i] for d, i in zip(dictionaries, numbers, strict=True)]
        return np.concatenate([[0], np.cumsum(np.concatenate(counts))]), every, np.concatenate(numbers).astype(np.int32)

    def settle(self, every: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The piece's number or -1, which are characters without a piece, and the open rest: numbers in sorted order."""
        piece = pc.fill_null(pc.index_in(every, pa.array(self.names, pa.large_string())), -1).to_numpy()
        single = pc.less_equal(pc.utf8_length(every), 1).to_numpy(zero_copy_only=False) & (piece < 0)
        rest = np.flatnonzero((piece < 0) & ~single)
        return piece, single, rest[pc.array_sort_indices(every.take(pa.array(rest))).to_numpy()] if len(rest) else rest


def _buckets(atoms: list[str], buckets: int) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(a) % buckets for a in atoms), np.int64, len(atoms))


def _squeezed(raw: bytes) -> bytes:
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _plain(blob: bytes) -> bytes:
    return pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), codec="zstd", asbytes=True)


def _packed(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return _squeezed(sink.getvalue().to_pybytes())


def _unpacked(blob: bytes) -> pa.Table:
    return pa.ipc.open_stream(_plain(blob)).read_all()


def _taken(flat: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The stretches ``flat[begin : begin + size]``, one after the other."""
    ends = np.cumsum(size)
    return flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin - ends + size, size)]


def _pack_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a batch to one compressed blob for each chunk."""
    for batch in pieces_of(batches, "text"):
        table = pa.Table.from_batches([batch])
        at = batch.column("chunk").to_numpy()
        order = np.argsort(at, kind="stable")
        numbers, first = np.unique(at[order], return_index=True)
        blobs = [_packed(table.take(pa.array(rows)).drop_columns(["chunk"])) for rows in np.split(order, first[1:])] if len(at) else []
        yield pa.RecordBatch.from_pydict({"chunk": pa.array(numbers, pa.int32()), "blob": pa.array(blobs, pa.binary())})


def _text_of(blobs: list[bytes]) -> pa.Array:
    texts = [_unpacked(b).column("text").combine_chunks().cast(pa.large_string()) for b in blobs]
    return pa.concat_arrays(texts)


def _send_atoms(atoms: Atoms, buckets: int):
    """The open distinct atoms of each chunk, sorted, in one blob for each bucket."""

    def run(chunk: tuple, rows: pa.Table) -> pa.Table:
        _, every, _ = atoms.cut(_text_of(rows.column("blob").to_pylist()))
        open_ones = every.take(pa.array(atoms.settle(every)[2])).to_pylist()
        at = _buckets(open_ones, buckets)
        order = np.argsort(at, kind="stable")
        numbers, first = np.unique(at[order], return_index=True)
        blobs = [_squeezed("\n".join([open_ones[i] for i in own]).encode()) for own in np.split(order, first[1:])] if len(at) else []
        pa.default_memory_pool().release_unused()  # workers share a small memory
        return pa.table({
            "chunk": pa.array([chunk[0].as_py()] * len(blobs), pa.int32()), "bucket": pa.array(numbers, pa.int32()),
            "blob": pa.array(blobs, pa.binary()),
        })

    return run


def _sent(blobs: list[bytes]) -> tuple[pa.Array, list[int]]:
    """Atoms of all blobs, one after the other, and how many each had."""
    lists = [_plain(b).decode().split("\n") for b in blobs]
    return pa.array([a for x in lists for a in x], pa.string()), [len(x) for x in lists]


def _list_atoms(bucket: tuple, rows: pa.Table) -> pa.Table:
    """A bucket's atoms once, numbered."""
    atom = pc.unique(_sent(rows.column("blob").to_pylist())[0])
    return pa.table({
        "bucket": pa.array([bucket[0].as_py()] * len(atom), pa.int32()), "number": pa.array(np.arange(len(atom))), "atom": atom,
    })


def lattice(words: DataFrame, model: Model, *by: str) -> DataFrame:
    """``(by..., atom, ids)`` for distinct ``(by..., atom)`` of at most ``MASK_CHARS`` characters."""
    pieces = F.broadcast(model.table(words.sparkSession).withColumnRenamed("size", "piece_size"))
    spelt = words.withColumn("word", F.translate("atom", " ", SPACE)).withColumn("chars", F.char_length("word"))
    starts = spelt.select(*by, "atom", "word", "chars", F.explode(F.sequence(F.lit(0), F.col("chars") - 1)).alias("start"))
    spans = starts.select(
        *by, "atom", "start", "word",
        F.explode(F.sequence(F.lit(1), F.least(F.lit(model.longest), F.col("chars") - F.col("start")))).alias("size"),
    ).select(*by, "atom", "start", F.substring(F.col("word"), F.col("start") + 1, F.col("size")).alias("piece"))
    edge = F.col("place") * (1 << 40) + F.col("start").cast("long") * (1 << 34) + F.col("piece_size") * (1 << 28) + F.col("id")
    edges = spans.join(pieces, "piece").select(*by, "atom", edge.alias("edge"))
    grouped = edges.groupBy(*by, "atom").agg(F.sort_array(F.collect_list("edge")).alias("edges"))
    one = F.lit(1).cast("long")
    left = lambda c, n: F.call_function("shiftleft", c, n)
    start = lambda e: F.shiftright(e, 34).bitwiseAND(63).cast("int")
    size = lambda e: F.shiftright(e, 28).bitwiseAND(63).cast("int")
    ends = lambda e: left(left(one, size(e)) + 1, start(e))
    inner = lambda e: left(left(one, size(e)) - 2, start(e))

    def merged(mask: Column, e: Column) -> Column:
        """The ends of parts once the edge is taken, if both its ends are still there."""
        return F.when(mask.bitwiseAND(ends(e)) == ends(e), mask - mask.bitwiseAND(inner(e))).otherwise(mask)

    longer = F.filter("edges", lambda e: e < NO_PLACE << 40)
    folded = grouped.withColumn("mask", F.aggregate(longer, left(one, F.char_length("atom") + 1) - 1, merged))
    chosen = F.filter(
        "edges", lambda e: (F.col("mask").bitwiseAND(ends(e)) == ends(e)) & (F.col("mask").bitwiseAND(inner(e)) == 0)
    )
    placed = F.sort_array(F.transform(chosen, lambda e: e.bitwiseAND((63 << 34) + (1 << 28) - 1)))
    return folded.select(*by, "atom", F.transform(placed, lambda e: e.bitwiseAND((1 << 28) - 1).cast("int")).alias("ids"))


def _answer(model: Model):
    def run(asked: pa.Table, known: pa.Table) -> pa.Table:
        """One bucket: counts and ids of the atoms of each chunk, in the order in which they were sent."""
        names = known.column("atom").combine_chunks()
        ids = known.column("ids").combine_chunks().cast(pa.list_(pa.int32()))
        sent, counts = _sent(asked.column("blob").to_pylist())
        at = pc.fill_null(pc.index_in(sent, names), -1).to_numpy().copy()
        size = pc.list_value_length(ids).to_numpy().astype(np.int64)
        begin = np.cumsum(size) - size
        flat = ids.flatten().to_numpy().astype(np.int32)
        for i in np.flatnonzero(at < 0):  # longer than the lattice takes
            more = model.merge(sent[int(i)].as_py().replace(" ", SPACE))
            at[i], begin, size = len(size), np.append(begin, len(flat)), np.append(size, len(more))
            flat = np.append(flat, np.array(more, np.int32))
        blobs, done = [], 0
        for n in counts:
            own = at[done : done + n]
            done += n
            blobs.append(_squeezed(size[own].astype(np.int32).tobytes() + _taken(flat, begin[own], size[own]).tobytes()))
        return pa.table({"chunk": asked.column("chunk"), "bucket": asked.column("bucket"), "answer": pa.array(blobs, pa.binary())})

    return run


def _assemble(atoms: Atoms, buckets: int, schema: pa.Schema, spelled: list[bytes]):
    def run(rows: pa.Table, answers: pa.Table) -> pa.Table:
        table = pa.concat_tables([_unpacked(b) for b in rows.column("blob").to_pylist()])
        texts = table.column("text").combine_chunks().cast(pa.large_string())
        starts, every, number = atoms.cut(texts)
        piece, single, rest = atoms.settle(every)
        rest = rest[np.argsort(_buckets(every.take(pa.array(rest)).to_pylist(), buckets), kind="stable")]
        blobs = [_plain(a) for _, a in sorted(zip(answers.column("bucket").to_pylist(), answers.column("answer").to_pylist(), strict=True))]
        size, begin = np.ones(len(every), np.int64), np.zeros(len(every), np.int64)
        flat = [atoms.ids]
        begin[piece >= 0] = piece[piece >= 0]
        at = len(atoms.ids)
        for i in np.flatnonzero(single):
            own = [atoms.byte_ids[b] for b in every[int(i)].as_py().encode()]
            begin[i], size[i], at = at, len(own), at + len(own)
            flat.append(np.array(own, np.int32))
        done = 0
        for blob in blobs:  # as the atoms were sent: by bucket, then sorted
            values = np.frombuffer(blob, np.int32)
            n = int(np.searchsorted(np.arange(1, len(values) + 1) + np.cumsum(values), len(values), "left")) + 1
            own, done = rest[done : done + n], done + n
            size[own] = values[:n]
            begin[own] = at + np.cumsum(values[:n]) - values[:n]
            flat.append(values[n:])
            at += len(values) - n
        if done != len(rest):
            raise RuntimeError("a chunk did not get an answer for each of its atoms")
        flat = np.concatenate(flat)
        lists, ends, decoded = [], [0], []
        step = max(1, len(texts) * SLICE // max(1, texts.nbytes))
        for a in range(0, len(texts), step):
            b = min(len(texts), a + step)
            own = number[starts[a] : starts[b]]
            lists.append(_taken(flat, begin[own], size[own]).astype(np.int32))
            run_of = np.concatenate([[0], np.cumsum(size[own])])[starts[a : b + 1] - starts[a]]
            ends += (ends[-1] + run_of[1:]).tolist()
            if spelled:
                decoded += _spelled(lists[-1], run_of, spelled)
        gone = texts.is_null().to_numpy(zero_copy_only=False)
        ids = pa.ListArray.from_arrays(
            pa.array(np.array(ends, np.int32), mask=np.append(gone, False)), pa.array(np.concatenate(lists) if lists else np.empty(0, np.int32))
        )
        out = table.append_column("ids", ids)
        if spelled:
            out = out.append_column("decoded", pa.array(decoded, pa.string(), mask=gone))
        out = out.cast(schema)
        pa.default_memory_pool().release_unused()
        return out

    return run


def _spelled(ids: np.ndarray, ends: np.ndarray, spelled: list[bytes]) -> list[str]:
    """Texts of rows of ids that lie one after the other, without the space in front."""
    taken = pa.array(spelled, pa.large_binary()).take(pa.array(ids))
    raw = b"".join(taken.to_pylist()) if len(ids) < 64 else taken.buffers()[2].to_pybytes()[: pc.sum(pc.binary_length(taken)).as_py()]
    at = np.concatenate([[0], np.cumsum(pc.binary_length(taken).to_numpy())])[ends]
    return [raw[a:b].removeprefix(b" ").decode("utf-8", "replace") for a, b in zip(at[:-1], at[1:], strict=True)]


def encode(
    docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text",
    chunk_bytes: int = CHUNK_BYTES, decoded: bool = False,
) -> DataFrame:
    """``(key, text, ids[, decoded])`` for every row: the text, the model's ids for it, and the text of those ids."""
    small_batches(docs.sparkSession)
    model = Model(model_path)
    chunks = max(1, -(-table_bytes(docs, text_col) // chunk_bytes))
    parts = min(chunks, MOST_PARTS)
    atoms = Atoms(model)
    text = F.col(text_col).cast("string")
    source = docs.select(
        # equal rows of different partitions go to different chunks
        F.pmod(F.xxhash64(F.col(id_col), text, F.spark_partition_id()), F.lit(chunks)).cast("int").alias("chunk"),
        F.col(id_col).alias("key"), text.alias("text"),
    )
    packed = source.mapInArrow(_pack_rows, "chunk int, blob binary").repartition(parts, "chunk")
    asked = packed.groupBy("chunk").applyInArrow(
        _send_atoms(atoms, chunks), "chunk int, bucket int, blob binary"
    ).repartition(parts, "bucket")
    words = asked.groupBy("bucket").applyInArrow(_list_atoms, "bucket int, number long, atom string").repartition(parts, "bucket")
    known = lattice(words.filter(F.char_length("atom") < MASK_CHARS), model, "number", "bucket")
    answers = asked.groupBy("bucket").cogroup(known.groupBy("bucket")).applyInArrow(
        _answer(model), "chunk int, bucket int, answer binary"
    )
    key_type = source.schema["key"].dataType
    fields = [("key", to_arrow_type(key_type)), ("text", pa.string()), ("ids", pa.list_(pa.int32()))]
    kind = f"key {key_type.simpleString()}, text string, ids array<int>"
    if decoded:
        fields, kind = [*fields, ("decoded", pa.string())], f"{kind}, decoded string"
    return packed.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(
        _assemble(atoms, chunks, pa.schema(fields), model.spelled if decoded else []), kind
    )


def decode(encoded: DataFrame, model_path: str, ids_col: str = "ids") -> DataFrame:
    """``encoded`` with ``decoded`` added: the text of each row's ids; null where they are null."""
    small_batches(encoded.sparkSession)
    spelled = Model(model_path).spelled  # as many as the model has pieces
    packed = encoded.select(
        F.struct(*[F.col(f"`{c}`") for c in encoded.columns]).alias("row"), F.col(ids_col).cast("array<int>").alias("ids")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = max(1, batch.num_rows * SLICE // max(1, batch.column(1).nbytes))
            for part in (batch.slice(a, step) for a in range(0, batch.num_rows, step)):
                ids = part.column(1)
                size = pc.fill_null(pc.list_value_length(ids), 0).to_numpy()
                texts = _spelled(ids.flatten().to_numpy(), np.concatenate([[0], np.cumsum(size)]), spelled)
                gone = ids.is_null().to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string(), mask=gone)], names=["row", "decoded"])

    kind = packed.schema["row"].dataType.simpleString()
    return packed.mapInArrow(run, f"row {kind}, decoded string").select("row.*", "decoded")
