"""Substring deduplication with suffix automata of reference shards.

A window is ``n`` consecutive words; a word goes if a window over it also starts earlier (smaller
id, or earlier in the same document). The reference is all text of smaller id, so it grows with
the corpus and cannot be broadcast whole; it is cut into shards that meet the documents by a
shuffle instead. A window's shard is its anchor, the least hash among its six-word runs, so equal
windows always meet. Runs of windows with one anchor are segments, about a tenth of the words.

Copies of a whole segment are settled by its digest (128 bits with the anchor), already inside a
batch of documents where they meet there, so a passage in a third of all rows costs a row a batch.
Where segments of one anchor differ, their words go to that shard: in order of (id, place) each
is streamed through the suffix automaton of the earlier ones for its matching statistics, and
every span matched over at least ``n`` words is removed. A shard with over ``MAX_VARIANTS``
different segments (the edges of very common passages) is cut finer, into one for each window.

Null and empty texts have no words; an empty table gives an empty result. A null id comes before all
others. Rows that share an id, null ids too, are ordered by a hash of their text, and rows equal in
both count as one document: nothing of them repeats the other. Ids are integers above -2^62. A text
of 2^28 windows or more (at least half a gigabyte) is an error.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatherum.llm.common import pieces_of, split_words
from gatherum.llm.near_dedup import _mixed
from gatherum.session import cut

GRAM = 6
MAX_VARIANTS = 64
#: A segment in one number: 25 bits of its text's hash, 28 of its first window, 10 of its length - 1.
TEXT_BITS, COUNT_BITS, FIRST_BITS = 25, 10, 28
REMOVE, ASK, ASK_EACH = 0, 1, 2
NO_ID = -(1 << 63)


def _text_tag(text: bytes) -> int:
    return xxhash.xxh64_intdigest(text, seed=42) >> (64 - TEXT_BITS)  # as Spark's xxhash64


def _chained(code: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of n words, by doubling."""
    total, out, size, done = code, None, 1, 0
    while size <= n:
        if n & size:
            if out is None:
                out = total
            else:
                rest = total[done:]
                m = min(len(out), len(rest))
                out = _mixed(out[:m] * np.uint64(0x9E3779B97F4A7C15) + rest[:m] + np.uint64(size))
            done += size
        size *= 2
        if size <= n:
            half = size // 2
            total = _mixed(total[: max(0, len(total) - half)] * np.uint64(0xD6E8FEB86659FD93) + total[half:])
    return out[: max(0, len(code) - n + 1)]


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    size, low = 1, values
    while size * 2 <= width:
        low = np.minimum(low[: max(0, len(low) - size)], low[size:])
        size *= 2
    over = width - size
    return np.minimum(low[: max(0, len(low) - over)], low[over:]) if over else low


def segments(texts: list, n: int) -> dict[str, np.ndarray]:
    """Segments of all texts: ``doc`` (index), ``anchor``, ``first``, ``count``, ``digest`` (odd: repeats itself)."""
    starts, distinct, at = split_words(texts)
    code = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in distinct.to_pylist()), np.uint64, len(distinct))[at]
    none = {k: np.empty(0, np.int64) for k in ("doc", "anchor", "first", "count", "digest")}
    if len(code) < n:
        return none
    windows = _chained(code, n)
    anchor = _sliding_min(_chained(code, GRAM), n - GRAM + 1)[: len(windows)]
    lengths = np.diff(starts)
    doc = np.repeat(np.arange(len(texts)), lengths)[: len(windows)]
    place = np.arange(len(windows)) - starts[doc]
    valid = place + n <= lengths[doc]
    if not valid.any():
        return none
    windows, anchor, doc, place = windows[valid], anchor[valid], doc[valid], place[valid]
    if place.max() >> FIRST_BITS:
        raise ValueError(f"a text has more than {1 << FIRST_BITS} windows")
    new = np.ones(len(windows), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])
    head = np.flatnonzero(new)
    inside = np.arange(len(windows)) - np.repeat(head, np.diff(np.append(head, len(windows))))
    new |= (inside & ((1 << COUNT_BITS) - 1)) == 0
    head = np.flatnonzero(new)
    count = np.diff(np.append(head, len(windows)))
    inside = (np.arange(len(windows)) - np.repeat(head, count)).astype(np.uint64)
    digest = np.add.reduceat(_mixed(windows + inside * np.uint64(0xA24BAED4963EE407)), head)
    digest = _mixed(digest + count.astype(np.uint64)) & ~np.uint64(1)
    order = np.argsort(windows, kind="stable")
    own = np.cumsum(new) - 1
    again = (windows[order[1:]] == windows[order[:-1]]) & (own[order[1:]] == own[order[:-1]])
    digest[own[order[1:][again]]] |= np.uint64(1)
    return {
        "doc": doc[head], "anchor": anchor[head].view(np.int64), "first": place[head], "count": count,
        "digest": digest.view(np.int64),
    }


def _pack(tag: np.ndarray, first: np.ndarray, count: np.ndarray) -> np.ndarray:
    return (tag << (FIRST_BITS + COUNT_BITS)) | (first << COUNT_BITS) | (count - 1)


def _unpack(pack: int) -> tuple[int, int, int]:
    return (
        pack >> (FIRST_BITS + COUNT_BITS), (pack >> COUNT_BITS) & ((1 << FIRST_BITS) - 1),
        (pack & ((1 << COUNT_BITS) - 1)) + 1,
    )


def _emit_segments(n: int):
    """(anchor, digest, id, pack, settled): later copies inside the batch are settled here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of(batches, "body"):
            texts = batch.column("body").to_pylist()
            found = segments(texts, n)
            ids = batch.column("id").to_numpy()[found["doc"]] if len(texts) else np.empty(0, np.int64)
            tags = np.array([_text_tag(t) if t else 0 for t in texts], np.int64)
            pack = _pack(tags[found["doc"]], found["first"], found["count"])
            order = np.lexsort((pack, ids, found["digest"], found["anchor"]))
            anchor, digest, ids, pack = (x[order] for x in (found["anchor"], found["digest"], ids, pack))
            copy = np.zeros(len(anchor), bool)
            copy[1:] = (anchor[1:] == anchor[:-1]) & (digest[1:] == digest[:-1])
            same = np.zeros(len(anchor), bool)
            same[1:] = (ids[1:] == ids[:-1]) & (pack[1:] == pack[:-1])
            keep = ~(copy & same)  # the same row twice is one document
            run_head = np.maximum.accumulate(np.where(copy, 0, np.arange(len(copy))))
            later = copy & ~((ids == ids[run_head]) & (pack == pack[run_head]))
            anchor = np.where(later, _mixed(ids.view(np.uint64)).view(np.int64), anchor)
            yield pa.RecordBatch.from_pydict({
                "anchor": anchor[keep], "digest": digest[keep], "id": ids[keep], "pack": pack[keep],
                "settled": later[keep],
            })

    return run


def _decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Streams segments sorted by (settled, anchor, digest, id, pack); keeps at most MAX_VARIANTS of a group."""
    last = (None, None, None, None)  # anchor, digest, id and pack of the previous row
    first_of_variant = (0, 0)
    seen, held = 0, []  # variants of the open group so far, and the first of them
    for batch in batches:
        settled = batch.column("settled").to_numpy(zero_copy_only=False)
        anchor, digest, ids, pack = (batch.column(c).to_numpy() for c in ("anchor", "digest", "id", "pack"))
        out_id, out_pack, out_what = [ids[settled]], [pack[settled]], [np.full(settled.sum(), REMOVE)]

        def put(i, p, what):
            out_id.append(np.asarray(i, np.int64))
            out_pack.append(np.asarray(p, np.int64))
            out_what.append(np.full(len(out_id[-1]), what))

        anchor, digest, ids, pack = (x[~settled] for x in (anchor, digest, ids, pack))
        if len(anchor):
            new_group = np.ones(len(anchor), bool)
            new_group[1:] = anchor[1:] != anchor[:-1]
            new_group[0] = last[0] is None or anchor[0] != last[0]
            new = new_group.copy()
            new[1:] |= digest[1:] != digest[:-1]
            new[0] |= last[1] is None or digest[0] != last[1]
            head = np.maximum.accumulate(np.where(new, np.arange(len(new)), -1))
            first_id = np.where(head >= 0, ids[head], first_of_variant[0])
            first_pack = np.where(head >= 0, pack[head], first_of_variant[1])
            later = ~new & ~((ids == first_id) & (pack == first_pack))
            put(ids[later], pack[later], REMOVE)
            group = np.cumsum(new_group) - new_group[0]  # 0 is the open group, if it goes on
            base = np.zeros(group[-1] + 1, np.int64)
            if new_group[0]:
                seen, held = 0, []
            else:
                base[0] = seen
            counted = np.cumsum(new)
            begins = np.flatnonzero(new_group) if new_group[0] else np.concatenate([[0], np.flatnonzero(new_group)])
            before = counted[begins] - new[begins]
            nth = counted - before[group] + base[group]  # which variant of its group a row belongs to
            total = np.maximum.reduceat(nth, begins)
            many, huge = total[group] >= 2, total[group] > MAX_VARIANTS
            odd = (digest & 1) == 1
            put(ids[new & (many | odd) & (nth <= MAX_VARIANTS)], pack[new & (many | odd) & (nth <= MAX_VARIANTS)], ASK)
            put(ids[new & huge], pack[new & huge], ASK_EACH)
            if base[0]:
                if base[0] == 1 and total[0] >= 2 and not held[0][2]:
                    put([held[0][0]], [held[0][1]], ASK)
                if base[0] <= MAX_VARIANTS < total[0]:
                    put([h[0] for h in held], [h[1] for h in held], ASK_EACH)
            tail = np.flatnonzero(new & (group == group[-1]) & (nth <= MAX_VARIANTS))
            rows = [(int(ids[i]), int(pack[i]), bool(odd[i])) for i in tail]
            held = (held if group[-1] == 0 and not new_group[0] else []) + rows
            seen = int(total[-1])
            first_of_variant = (int(first_id[-1]), int(first_pack[-1]))
            last = (anchor[-1], digest[-1], ids[-1], pack[-1])
        yield pa.RecordBatch.from_pydict({
            "id": np.concatenate(out_id), "pack": np.concatenate(out_pack),
            "what": np.concatenate(out_what).astype(np.int32),
        })


def _asked(n: int):
    """Words of the segments asked for: whole (kind ASK, by anchor), or each window (by its digest).

    Of equal windows in a batch only the earliest is sent; the others are settled (kind REMOVE).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of(batches, "body"):
            rows: list[tuple] = []
            each_at: dict[bytes, list] = {}
            for key, body, packs, each in zip(*(batch.column(c).to_pylist() for c in ("id", "body", "ask", "each")), strict=True):
                tag, words = _text_tag(body or b""), (body or b"").split()
                for whole, wanted in ((True, packs), (False, each)):
                    for pack in wanted:
                        own, first, count = _unpack(pack)
                        if own != tag:
                            continue
                        if whole:
                            part = words[first : first + count + n - 1]
                            codes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in part[:n]), np.uint64)
                            anchor = int(_chained(codes, GRAM).min().astype(np.int64))
                            rows.append((anchor.to_bytes(8, "big", signed=True), ASK, key, tag, first, b" ".join(part)))
                        else:
                            for i in range(first, first + count):
                                code = hashlib.blake2b(b" ".join(words[i : i + n]), digest_size=16).digest()
                                each_at.setdefault(code, []).append((key, tag, i))
            for code, places in each_at.items():
                head, *later = sorted(set(places))
                rows.append((code, ASK_EACH, *head, None))
                rows += [(b"s" + at[0].to_bytes(8, "big", signed=True), REMOVE, *at, None) for at in later]
            names = ("shard", "kind", "id", "tag", "first", "words")
            kinds = (pa.binary(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in rows], kinds[i]) for i in range(6)], names=list(names)
            )

    return run


class SuffixAutomaton:
    """Online suffix automaton over words that also tracks the longest earlier match."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.len = [-1], [0]

    def _extend(self, last: int, word: bytes) -> int:
        nxt, link, length = self.next, self.link, self.len
        if word in nxt[last]:
            q = nxt[last][word]
            return q if length[q] == length[last] + 1 else self._split(last, q, word)
        new = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and word not in nxt[p]:
            nxt[p][word] = new
            p = link[p]
        if p >= 0:
            q = nxt[p][word]
            link[new] = q if length[q] == length[p] + 1 else self._split(p, q, word)
        return new

    def _split(self, p: int, q: int, word: bytes) -> int:
        clone = len(self.next)
        self.next.append(dict(self.next[q]))
        self.len.append(self.len[p] + 1)
        self.link.append(self.link[q])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = clone
            p = self.link[p]
        return clone

    def stream(self, words: list[bytes]) -> list[int]:
        """Matching statistics against everything before, and then part of it.

        Entry i is the length of the longest run ending with word i that also ended earlier.
        """
        last, state, match, out = 0, 0, 0, []
        for word in words:
            while state and word not in self.next[state]:
                state = self.link[state]
                match = self.len[state]
            if word in self.next[state]:
                state, match = self.next[state][word], match + 1
            out.append(match)
            last = self._extend(last, word)
            while state and match <= self.len[self.link[state]]:
                state = self.link[state]
        return out


def _matched(n: int):
    """Rows sorted by (shard, id, tag, first) to removed window ranges, shard by shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, machine, before = None, SuffixAutomaton(), None
        for batch in batches:
            found: list[tuple[int, int, int, int]] = []
            for own, kind, key, tag, first, words in zip(
                *(batch.column(c).to_pylist() for c in ("shard", "kind", "id", "tag", "first", "words")), strict=True
            ):
                if own != shard:
                    shard, machine, fresh = own, SuffixAutomaton(), True
                else:
                    fresh = False
                if before == (own, key, tag, first):
                    continue  # the same row twice is one document
                before = own, key, tag, first
                if kind != ASK:  # settled before, or a window whose earliest place heads its shard
                    if kind == REMOVE or not fresh:
                        found.append((key, tag, first, first))
                    continue
                low = None
                for i, length in enumerate(machine.stream(words.split(b" ")) + [0]):
                    if length >= n and low is None:
                        low = i - n + 1
                    elif length < n and low is not None:
                        found.append((key, tag, first + low, first + i - n))
                        low = None
            yield pa.RecordBatch.from_arrays(
                [pa.array([f[i] for f in found], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.int32(), pa.int32()))],
                names=["id", "tag", "first", "last"],
            )

    return run


def _cuts(n: int, with_text: bool):
    """Final pass: removed words of each row, digest of the rest, and the rest itself if asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of(batches, "body"):
            bodies = batch.column("body").to_pylist()
            packs, ranges = batch.column("removed").to_pylist(), batch.column("ranges").to_pylist()
            n_words, n_removed, digests, rest = [], [], [], []
            for body, own, more in zip(bodies, packs, ranges, strict=True):
                words = (body or b"").split()
                gone = np.zeros(len(words) + 1, np.int64)
                if own or more:
                    tag = _text_tag(body or b"")
                    spans = [(f, f + c - 1) for t, f, c in map(_unpack, own or ()) if t == tag]
                    spans += [(r["first"], r["last"]) for r in more or () if r["tag"] == tag]
                    for first, last in spans:
                        gone[first] += 1
                        gone[last + n] -= 1
                    keep = np.cumsum(gone[:-1]) == 0
                    kept = [w for w, k in zip(words, keep, strict=True) if k]
                else:
                    kept = words
                n_words.append(len(words))
                n_removed.append(len(words) - len(kept))
                joined = b" ".join(kept)
                digests.append(hashlib.sha256(joined).hexdigest())
                if with_text:
                    rest.append(body if len(kept) == len(words) else joined)
            names = ["row", "n_words", "n_removed", "kept_sha256"] + ["kept_text"] * with_text
            columns = [batch.column("row"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digests, pa.string())]
            if with_text:
                columns.append(pa.array([None if r is None else r.decode("utf-8", "replace") for r in rest], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def remove_repeats(
    docs: DataFrame, n: int = 20, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False,
) -> DataFrame:
    """``(row, n_words, n_removed, kept_sha256[, kept_text])`` for every row; ``row`` is that row.

    ``kept_text`` is the text itself where nothing goes, else the kept words joined by a space.
    """
    if n < GRAM:
        raise ValueError(f"windows of fewer than {GRAM} words are not supported")
    body = F.col(text_col).cast("string").cast("binary").alias("body")
    tag = F.shiftrightunsigned(F.xxhash64(F.col(text_col).cast("string")), 64 - TEXT_BITS)
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID) + tag).alias("id")  # null ids by their text
    source = docs.select(key, body)
    found = source.mapInArrow(_emit_segments(n), "anchor long, digest long, id long, pack long, settled boolean")
    decided = cut(
        found.repartition("anchor").sortWithinPartitions("settled", "anchor", "digest", "id", "pack")
        .mapInArrow(_decide, "id long, pack long, what int")
    )
    kinds = {REMOVE: "removed", ASK: "ask", ASK_EACH: "each"}
    lists = decided.groupBy("id").agg(*[
        F.collect_list(F.when(F.col("what") == k, F.col("pack"))).alias(name) for k, name in kinds.items()
    ])
    asked = (
        source.join(lists.filter((F.size("ask") > 0) | (F.size("each") > 0)).select("id", "ask", "each"), "id")
        .mapInArrow(_asked(n), "shard binary, kind int, id long, tag int, first int, words binary")
    )
    matched = (
        asked.repartition("shard").sortWithinPartitions("shard", "id", "tag", "first")
        .mapInArrow(_matched(n), "id long, tag int, first int, last int")
    )
    ranges = matched.groupBy("id").agg(F.collect_list(F.struct("tag", "first", "last")).alias("ranges"))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    whole = (  # the text is shuffled once, inside its row
        docs.select(key, row)
        .join(lists.select("id", "removed"), "id", "left").join(ranges, "id", "left")
        .select("row", F.col(f"row.`{text_col}`").cast("string").cast("binary").alias("body"), "removed", "ranges")
    )
    kind = whole.schema["row"].dataType.simpleString()
    schema = f"row {kind}, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text
    return whole.mapInArrow(_cuts(n, with_text), schema)
