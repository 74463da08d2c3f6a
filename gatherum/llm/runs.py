"""Periodic runs of words by Baier grouping.

A run is a longest stretch of words that repeats with a smallest period. The first phase of
Baier's suffix sorter puts the suffixes into groups and takes the groups from the greatest down;
when a group's turn comes, its context is the longest Lyndon word at each of its members. Done
under an order of the words and under its reverse, that gives both Lyndon arrays without a suffix
array, and every run has its Lyndon root in one of them. A root that is followed by a root of the
same length is extended to both sides by the longest common extension, compared in doubling steps.

A run of ``times`` periods holds each of its words ``times`` times. So a word that a text holds
less often is in no run: it only parts the text, and the sorter gets the stretches between.

The sorter is linear in the words of one text, and texts are worked on one by one, so no row
needs another and nothing is shuffled.

A null or empty text has no words, no runs and an empty collapsed text. Repeated rows and ids are
judged row by row; an empty table gives an empty result; other columns of the input are not read.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatherum.llm.common import per_row, split_words

RUN = "struct<start: long, length: long, period: long>"


def lyndon_lengths(word: list[int], kinds: int) -> list[int]:
    """Length of the longest Lyndon word at each place, by grouping; letters are 0 to ``kinds`` - 1.

    ``left`` and ``right`` link the places whose group still has to come. At its turn a place's
    right neighbour ends its context, and its left neighbour, which lies in a lower group, takes
    that context over: once for each member met, so the neighbours are dealt to new groups by how
    many they met, more being greater, right above their old groups.
    """
    n = len(word)
    left, right = list(range(-1, n - 1)), list(range(1, n + 1))
    group, size = list(word), [0] * n
    members: list[list[int]] = [[] for _ in range(kinds)]
    for i, c in enumerate(word):
        members[c].append(i)
    below, above = list(range(-1, kinds - 1)), list(range(1, kinds + 1))
    above[kinds - 1:] = [-1] if kinds else []
    turn = kinds - 1
    while turn >= 0:
        met: dict[int, int] = {}
        for i in members[turn]:  # in ascending order, as lists are filled that way
            if group[i] != turn:
                continue
            before, after = left[i], right[i]
            size[i] = after - i
            if after < n:
                left[after] = before
            if before >= 0:
                right[before] = after
                met[before] = met.get(before, 0) + 1
        dealt: dict[tuple[int, int], list[int]] = {}
        for i, k in met.items():
            if len(members[group[i]]) > 1:  # the only member of its group stays in its place
                dealt.setdefault((k, group[i]), []).append(i)
        for k, old in sorted(dealt, reverse=True):
            new, up = len(members), above[old]
            members.append(dealt[k, old])
            below.append(old)
            above.append(up)
            above[old] = new
            if up >= 0:
                below[up] = new
            for i in members[new]:
                group[i] = new
        members[turn] = []
        turn = below[turn]
    return size


def _agreement(a: np.ndarray, b: np.ndarray) -> int:
    """How many first entries are equal."""
    n, at, step = min(len(a), len(b)), 0, 32
    while at < n:
        stop = min(n, at + step)
        other = a[at:stop] != b[at:stop]
        if other.any():
            return at + int(other.argmax())
        at, step = stop, min(2 * step, 1 << 16)
    return n


def _extended(x: np.ndarray, size: np.ndarray, least: int, times: int) -> set[tuple[int, int, int]]:
    """Runs of the roots in one Lyndon array: ``(start, length, period)``."""
    n = len(x)
    here = np.flatnonzero(np.arange(n) + size < n)
    if times > 2:  # then a whole root follows a whole root
        here = here[(size[here + size[here]] == size[here]) & (x[here + size[here]] == x[here])]
    found, known = set(), {}
    for i, q in zip(here.tolist(), size[here].tolist(), strict=True):
        if i + q <= known.get(q, 0):  # a root of the run found last: two runs of a period overlap by less than it
            continue
        after = _agreement(x[i:], x[i + q :])
        if times > 2 and after < q:
            continue
        before = _agreement(x[:i][::-1], x[: i + q][::-1])
        if before + after < q:
            continue
        known[q] = i + q + after
        length = before + q + after
        if length >= max(least, times * q):
            found.add((i - before, length, q))
    return found


def find_runs(words: np.ndarray, least: int, times: int) -> list[tuple[int, int, int]]:
    """All runs of at least ``least`` words and ``times`` (2 or more) periods, by start, then period."""
    if len(words) < least:
        return []
    _, code, count = np.unique(words, return_inverse=True, return_counts=True)
    often = np.concatenate([[False], count[code] >= times, [False]])
    edges = np.flatnonzero(often[1:] != often[:-1]).reshape(-1, 2)
    edges = edges[edges[:, 1] - edges[:, 0] >= least]
    if not len(edges):
        return []
    # each stretch with the rare word behind it, so that no run crosses
    place = np.concatenate([np.arange(a, min(b + 1, len(words))) for a, b in edges])
    kinds, x = np.unique(code[place], return_inverse=True)
    found: set[tuple[int, int, int]] = set()
    for ranks in (x, len(kinds) - 1 - x):
        size = np.array(lyndon_lengths(ranks.tolist(), len(kinds)), np.int64)
        found |= _extended(x, size, least, times)
    return sorted(((int(place[s]), length, q) for s, length, q in found), key=lambda r: (r[0], r[2]))


def find(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 24, times: int = 3,
    with_row: bool = False,
) -> DataFrame:
    """``(key, [row,] n_words, runs, collapsed)`` for each row.

    ``runs`` lists every run of at least ``least`` words and ``times`` periods by start, then
    period, places counted from 0. ``collapsed`` is the text's words, joined by one space, without
    those that a run holds behind its first period.
    """
    if times < 2 or least < 1:
        raise ValueError("a run has two periods and a word at least")

    def compute(texts: list) -> pa.RecordBatch:
        starts, _, at = split_words(texts)
        runs, collapsed = [], []
        for text, a, b in zip(texts, starts[:-1], starts[1:], strict=True):
            own = find_runs(at[a:b], least, times)
            words = (text or b"").split()
            if own:
                keep = np.ones(len(words), bool)
                for start, length, period in own:
                    keep[start + period : start + length] = False
                words = compress(words, keep.tolist())
            runs.append([{"start": s, "length": n, "period": q} for s, n, q in own])
            collapsed.append(b" ".join(words))
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        return pa.RecordBatch.from_pydict({
            "n_words": np.diff(starts), "runs": pa.array(runs, kind), "collapsed": pa.array(collapsed, pa.binary()),
        })

    found = per_row(docs, id_col, text_col, compute, f"n_words long, runs array<{RUN}>, collapsed binary", with_row)
    return found.withColumn("collapsed", F.col("collapsed").cast("string"))
