"""Near-duplicate documents by HyperMinHash.

A document is the set of its distinct word shingles. Its signature has 256 buckets; each keeps
the least shingle hash that fell into it, compressed to a leading-zero count and mantissa bits in
one byte. Bands of four slots bring similar documents together, the collision-corrected share of
equal registers estimates their Jaccard similarity, and links are confirmed on the full sets. A slot
reads a register of its own or, where that is empty, the first filled one in an order of its own over
all registers, so the bands of a short text are as independent as those of a long one.

Documents with equal sets are one class from the start, so a mass of copies costs one row. Inside
a band's bucket no pairs are listed: every member is first tried against one hub; only where a
bucket still holds several components are members of different components compared, in blocks of
bounded size. A pair at the threshold shares no band with a probability of about 6e-11 (0.85) or
5e-8 (0.8), short sets somewhat more often (README); the estimate passes pairs four and a half standard
deviations below the threshold, which drops one right at it with a probability of about 1e-5.

Ids are integers. Null or wordless texts have an empty set and are linked with nothing. Rows with
a null id are linked with nothing and have a null component. Rows with one id are one document
for naming: each is linked by its own text, and the id stands for all of them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatherum.llm.common import per_row, split_words
from gatherum.operators.components import connected_components
from gatherum.session import cut

REGISTERS, MANTISSA, BAND, BANDS = 256, 4, 4, 32
BUCKET_BITS = 8  # of a shingle's hash; the other 56 are its value
MOST_ZEROS, EMPTY = 14, np.uint8(0xFF)
#: Chance that registers of unrelated minima agree: a third for the zeros, then the mantissa.
CHANCE = 2.0**-MANTISSA / 3
#: Members of a bucket that one task compares with as many others.
BLOCK = 1000
UPPER_TO_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(texts: list, n: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text; fewer than n words are one shingle."""
    lowered = [None if t is None else t.translate(UPPER_TO_LOWER) for t in texts]
    starts, distinct, at = split_words(lowered)
    code = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in distinct.to_pylist()), np.uint64, len(distinct))[at]
    rolled = np.zeros(max(0, len(code) - n + 1), np.uint64)
    for i in range(n if len(rolled) else 0):
        rolled = _mixed(rolled + code[i : i + len(rolled)] + np.uint64(i + 1))
    out = []
    for a, b in zip(starts[:-1], starts[1:], strict=True):
        if b - a >= n:
            out.append(np.unique(rolled[a : b - n + 1]))
        elif b > a:
            short = np.zeros(1, np.uint64)
            for i, w in enumerate(code[a:b]):
                short = _mixed(short + w + np.uint64(1000 * int(b - a) + i))
            out.append(short)
        else:
            out.append(np.empty(0, np.uint64))
    return out


def signature(hashes: np.ndarray) -> np.ndarray:
    """Registers of a set: leading zeros of the least value in each bucket, and its mantissa."""
    bits = 64 - BUCKET_BITS
    least = np.full(REGISTERS, np.uint64(1) << np.uint64(bits), np.uint64)
    rest = hashes & np.uint64((1 << bits) - 1)
    np.minimum.at(least, (hashes >> np.uint64(bits)).astype(np.int64), rest)
    empty = least == np.uint64(1) << np.uint64(bits)
    length = np.frexp(np.maximum(least, np.uint64(1)).astype(np.float64))[1]  # bits of the value
    over = (np.uint64(1) << length.astype(np.uint64)) <= least  # the conversion may round up or down
    length = length + over - ((np.uint64(1) << np.maximum(length - 1, 0).astype(np.uint64)) > least)
    length = np.maximum(length, MANTISSA + 1)
    zeros = np.clip(bits - length, 0, MOST_ZEROS)
    mantissa = (least >> (length - 1 - MANTISSA).astype(np.uint64)) & np.uint64((1 << MANTISSA) - 1)
    return np.where(empty, EMPTY, (zeros.astype(np.uint64) << np.uint64(MANTISSA) | mantissa).astype(np.uint8))


def _probes() -> np.ndarray:
    """For each slot the registers in the order it tries them; the first ones are all different."""
    slots = np.arange(BANDS * BAND, dtype=np.uint64)[:, None]
    order = np.argsort(_mixed(slots * np.uint64(REGISTERS) + np.arange(REGISTERS, dtype=np.uint64) + np.uint64(1)), axis=1)
    first = np.arange(BANDS * BAND)[:, None]
    return np.concatenate([first, order[order != first].reshape(len(order), -1)], axis=1).astype(np.uint8)


PROBES = _probes()


def band_hashes(registers: np.ndarray) -> np.ndarray:
    """A hash for each band of slots, over the registers they read and what is in them."""
    filled = registers != EMPTY
    source = np.arange(BANDS * BAND)
    bare = np.flatnonzero(~filled[: BANDS * BAND])
    source[bare] = PROBES[bare, filled[PROBES[bare]].argmax(axis=1)]
    value = registers[source].astype(np.uint64) + (source.astype(np.uint64) << np.uint64(16))
    code = np.arange(BANDS, dtype=np.uint64) + np.uint64(1)
    for i in range(BAND):
        code = _mixed(code + value[i::BAND])
    return code.view(np.int64)


def estimate(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Jaccard of one signature with each of many, corrected for chance agreement."""
    both = (one != EMPTY) & (many != EMPTY)
    used = np.maximum(((one != EMPTY) | (many != EMPTY)).sum(axis=1), 1)
    return ((((one == many) & both).sum(axis=1) / used) - CHANCE) / (1 - CHANCE)


def floor_of(used: np.ndarray, sizes: np.ndarray, least: float) -> np.ndarray:
    """Least estimate that is still looked at: 4.5 standard deviations under the threshold.

    The ``used`` buckets hold a sample, without replacement, of the union of two sets of
    ``sizes`` members together, which has at most ``sizes / (1 + least)``. A pair of long texts
    right at the threshold falls below with a probability of about 1e-5.
    """
    used = np.maximum(used, 1)
    rest = np.maximum(1 - used * (1 + least) / sizes, 0)
    return least - 4.5 * np.sqrt(least * (1 - least) / used * rest + CHANCE * (1 - least) / used)


def _signatures(docs: DataFrame, n: int, id_col: str, text_col: str) -> DataFrame:
    def compute(texts: list) -> pa.RecordBatch:
        sets = shingles(texts, n)
        return pa.RecordBatch.from_pydict({
            "n": pa.array([len(s) for s in sets], pa.int64()),
            "digest": pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
            "sig": pa.array([signature(s).tobytes() if len(s) else None for s in sets], pa.binary()),
        })

    return per_row(docs, id_col, text_col, compute, "n long, digest binary, sig binary")


def _banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        codes = [band_hashes(np.frombuffer(s, np.uint8)) for s in batch.column("sig").to_pylist()]
        ids = np.repeat(batch.column("id").to_numpy(), BANDS)
        yield pa.RecordBatch.from_pydict(
            {"id": ids, "bucket": np.concatenate(codes) if codes else np.empty(0, np.int64)}
        )


def _compare(least: float):
    """Blocks ``(bucket, i, j, rows)``: candidate pairs of different components that meet here first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, bucket, left, right in zip(
                *(batch.column(c).to_pylist() for c in ("i", "j", "bucket")),
                batch.column("left"), batch.column("right"), strict=True,
            ):
                sides = []
                for side in (left, right):
                    rows = side.values
                    sig = np.frombuffer(b"".join(rows.field("sig").to_pylist()), np.uint8).reshape(-1, REGISTERS)
                    sides.append((*(rows.field(c).to_numpy() for c in ("id", "component", "n")), sig))
                (a_id, a_comp, a_n, a_sig), (b_id, b_comp, b_n, b_sig) = sides
                bands = np.stack([band_hashes(s) for s in b_sig]) if len(b_sig) else np.empty((0, BANDS), np.int64)
                found: list[tuple[int, int]] = []
                for k in range(len(a_id)):
                    alike = (b_n >= least * a_n[k] - 1e-9) & (a_n[k] >= least * b_n - 1e-9)
                    other = np.flatnonzero(alike & (b_comp != a_comp[k]) & ((b_id > a_id[k]) | (i != j)))
                    if not len(other):
                        continue
                    guess = estimate(a_sig[k], b_sig[other])
                    used = ((a_sig[k] != EMPTY) | (b_sig[other] != EMPTY)).sum(axis=1)
                    near = other[guess >= floor_of(used, a_n[k] + b_n[other], least)]
                    if len(near):
                        same = band_hashes(a_sig[k]) == bands[near]
                        first = bands[near, same.argmax(axis=1)] == bucket  # else another bucket lists it
                        found += [(int(a_id[k]), int(x)) for x in b_id[near[first]]]
                yield pa.RecordBatch.from_pydict({
                    "a": pa.array([min(p) for p in found], pa.int64()), "b": pa.array([max(p) for p in found], pa.int64()),
                })

    return run


def _blocks(members: DataFrame) -> DataFrame:
    """Members of each bucket dealt into blocks, and every pair of blocks of a bucket in a row."""
    sizes = members.groupBy("bucket").agg(
        F.count("*").alias("size"), F.min("component").alias("low"), F.max("component").alias("high")
    ).filter("low < high")  # elsewhere nothing is left to find
    n_blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    dealt = members.join(sizes.select("bucket", n_blocks.alias("blocks")), "bucket").withColumn(
        "block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    )
    held = dealt.groupBy("bucket", "block", "blocks").agg(
        F.collect_list(F.struct("id", "component", "n", "sig")).alias("rows")  # about BLOCK rows of 0.3 kB
    )
    left = held.select("bucket", F.col("block").alias("i"), F.explode(F.sequence("block", F.col("blocks") - 1)).alias("j"), F.col("rows").alias("left"))
    right = held.select("bucket", F.col("block").alias("j"), F.col("rows").alias("right"))
    return left.join(right, ["bucket", "j"])


def _confirmed(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs whose full sets are similar enough."""
    one = sets.select(F.col("id").alias("a"), F.col("items").alias("x"))
    two = sets.select(F.col("id").alias("b"), F.col("items").alias("y"))
    shared = F.size(F.array_intersect("x", "y"))
    return (
        pairs.join(one, "a").join(two, "b")
        .filter(den * shared >= num * (F.size("x") + F.size("y") - shared))
        .select(F.col("a").alias("src"), F.col("b").alias("dst"))
    )


def near_duplicates(
    docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """``(key, n_shingles, component_id, kept)`` for every row of ``docs``.

    Documents with ``den * |A and B| >= num * |A or B|`` are linked; ``component_id`` is the least
    id that can be reached, and that document is the one kept.
    """
    least = num / den
    base = cut(_signatures(docs, n, id_col, text_col).withColumn("key", F.col("key").cast("long")))
    live = base.filter(F.col("key").isNotNull() & (F.col("n") > 0))
    classes = cut(live.groupBy("digest").agg(F.min("key").alias("id"), F.first("n").alias("n"), F.first("sig").alias("sig")))

    banded = classes.select("id", "sig").mapInArrow(_banded, "id long, bucket long")
    hubs = banded.groupBy("bucket").agg(F.min("id").alias("hub"), F.max("id").alias("last")).filter("hub < last")
    members = cut(banded.join(hubs.select("bucket", "hub"), "bucket"))
    signed = members.select("id").distinct().join(classes.groupBy("id").agg(F.min_by("n", "sig").alias("n"), F.min("sig").alias("sig")), "id")
    signed = cut(signed)

    def compute_sets(texts: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict(
            {"items": pa.array([s.view(np.int64) for s in shingles(texts, n)], pa.list_(pa.int64()))}
        )

    wanted = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(
        signed.select("id"), "id", "left_semi"
    )
    sets = per_row(wanted, "id", "text", compute_sets, "items array<long>").withColumnRenamed("key", "id")
    sets = cut(sets)

    # each member and the most alike of its buckets' hubs
    tried = members.filter("id <> hub").select("id", "hub").distinct()
    alike = (
        tried.join(signed, "id").join(signed.select(F.col("id").alias("hub"), F.col("n").alias("hub_n"), F.col("sig").alias("hub_sig")), "hub")
        .mapInArrow(_guess(least), "id long, hub long, guess double")
        .groupBy("id").agg(F.max_by("hub", F.struct("guess", -F.col("hub"))).alias("hub"))
        .select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b"))
    )
    links = cut(_confirmed(alike, sets, num, den))
    vertices = signed.select("id")
    first = connected_components(links, vertices)

    # what one hub could not settle: members of different components in one bucket
    inside = members.select("id", "bucket").join(first, "id").join(signed, "id")
    pairs = _blocks(inside).mapInArrow(_compare(least), "a long, b long").distinct()
    links = links.unionByName(cut(_confirmed(pairs, sets, num, den)))
    joined = connected_components(links, vertices)

    named = classes.select("digest", "id").join(joined, "id", "left").select(
        "digest", F.coalesce("component", "id").alias("component")
    )
    own = F.when(F.col("key").isNotNull() & (F.col("n") > 0), F.col("component")).otherwise(F.col("key"))
    return base.join(named, "digest", "left").select(
        "key", F.col("n").alias("n_shingles"), own.alias("component_id"),
        F.coalesce(F.col("key") == own, F.lit(True)).alias("kept"),
    )


def _guess(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (
                np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, REGISTERS)
                for c in ("sig", "hub_sig")
            )
            used = ((a != EMPTY) | (b != EMPTY)).sum(axis=1)
            guess = estimate(a, b)
            both = batch.column("n").to_numpy() + batch.column("hub_n").to_numpy()
            good = pa.array(guess >= floor_of(used, both, least))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").filter(good), batch.column("hub").filter(good), pa.array(guess).filter(good)],
                names=["id", "hub", "guess"],
            )

    return run
