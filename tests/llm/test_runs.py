"""Periodic runs against plain definitions."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from gatherum.llm import queries, runs

SF = "/root/testdata/sf0.001"


def lyndon_by_definition(x):
    """The longest Lyndon word at i ends where the next smaller suffix begins."""
    out = []
    for i in range(len(x)):
        j = i + 1
        while j < len(x) and x[j:] > x[i:]:
            j += 1
        out.append(j - i)
    return out


def runs_by_definition(x, least, times):
    found = []
    for q in range(1, len(x) // times + 1):
        i = 0
        while i + q < len(x):
            j = i
            while j + q < len(x) and x[j] == x[j + q]:
                j += 1
            length = j + q - i
            if j > i and length >= max(least, times * q):
                own = x[i : i + length]
                if not any(own[d:] == own[:-d] for d in range(1, q)):
                    found.append((i, length, q))
            i = max(j, i + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


def words_of(seed):
    rng = random.Random(seed)
    for _ in range(700):
        kinds = rng.randint(1, 4)
        x = [rng.randrange(kinds) for _ in range(rng.randint(0, 30))]
        if rng.random() < 0.5:
            x = (x[: rng.randint(1, 6)] * 8)[: rng.randint(0, 30)] + x[:9]
        yield x


def test_lyndon_words_are_those_of_the_definition():
    for x in words_of(1):
        for ranks in (x, [max(x, default=0) - c for c in x]):
            assert runs.lyndon_lengths(ranks, max(ranks, default=-1) + 1) == lyndon_by_definition(ranks)


@pytest.mark.parametrize("least,times", [(2, 2), (5, 2), (1, 3), (6, 3), (8, 4)])
def test_runs_are_those_of_the_definition(least, times):
    for x in words_of(least + 10 * times):
        assert runs.find_runs(np.array(x, np.int64), least, times) == runs_by_definition(x, least, times)


def test_long_repetitive_words():
    a, b = [0], [0, 1]
    assert runs.find_runs(np.array([7] * 50_000), 24, 3) == [(0, 50_000, 1)]
    while len(b) < 900:
        a, b = b, b + a
    for x in ([7] * 900, [1, 2] * 400 + [1], b[:800]):
        assert runs.find_runs(np.array(x, np.int64), 24, 3) == runs_by_definition(x, 24, 3)


def judged(text, least=24, times=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    found = runs_by_definition(words, least, times)
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return len(words), found, " ".join(w for i, w in enumerate(words) if i not in gone)


def test_awkward_rows(spark):
    texts = [None, "", " \n ", "a", "a b " * 30, "x" * 50_000, "word " * 300, "é\x1cb\x85 " * 40 + "end", "a a b " * 12 + "c " * 30]
    rows = list(enumerate(texts)) + [(0, "a b " * 30), (None, "a b " * 30), (4, texts[4]), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for name in ("key", "row", "body", "runs", "start", "n_words", "collapsed"):
        docs = docs.withColumn(name, F.lit(1))
    got = [(r["row"]["doc_id"], r["row"]["text"], r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"])
           for r in runs.find(docs, with_row=True).collect()]
    want = [(i, t, *judged(t)) for i, t in rows]
    by = lambda r: (str(r[0]), str(r[1]))
    assert sorted(got, key=by) == sorted(want, key=by)
    assert runs.find(docs.filter("false")).count() == 0
    with pytest.raises(ValueError):
        runs.find(docs, times=1)


def test_registered_query_is_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    table = queries.op13_runs(spark, SF)
    assert dict(table.dtypes) == {
        "doc_id": "bigint", "n_runs": "bigint", "start": "bigint", "length": "bigint", "period": "bigint",
        "exponent_milli": "bigint", "runs_sha256": "string", "collapsed_sha256": "string",
    }
    got = {r["doc_id"]: tuple(r)[1:] for r in table.collect()}
    planted = 0
    for key, text in docs:
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        h, n = zlib.crc32(str(key).encode()), len(words)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
            planted += 1
        _, found, collapsed = judged(" ".join(words))
        best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
        four = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
        listed = "".join(f"{s},{n},{q}\n" for s, n, q in found)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert got[key] == (len(found), *four, sha(listed), sha(collapsed)), key
    assert planted and len(got) == len(docs)
