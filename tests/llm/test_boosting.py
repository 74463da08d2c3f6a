"""Boosted trees over document statistics: brute-force parts, held-out labels, awkward rows."""

import math
import random
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from gatherum.llm import boosting, common, queries

AWKWARD = [None, "", " ", "\n\n", "a", "É", "one two", "x" * 50_000, "word " * 30_000, "\x00\x1c \x85 a　b", "#### $$$$ 12 !!"]


def plain_statistics(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    letters = max(1, sum(c.isalpha() for w in words for c in w))
    chars = [len(w) for w in words] or [0]
    mean = sum(chars) / max(n, 1)
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    triples = [tuple(words[i : i + 3]) for i in range(n - 2)]
    capital = [sum(c.isupper() for c in w) for w in words]
    return {
        "log_words": math.log1p(n), "log_bytes": math.log1p(len((text or "").encode())), "word_chars": mean,
        "word_chars_deviation": math.sqrt(sum((c - mean) ** 2 for c in chars) / len(chars)) if n else 0.0,
        "symbols": sum(len(re.findall(r"[#*$%&|<>{}\\^~=_@]", w)) for w in words) / max(n, 1),
        "capitals": sum(capital) / letters,
        "all_capitals": sum(c > 1 and c == sum(x.isalpha() for x in w) for c, w in zip(capital, words, strict=True)) / max(n, 1),
        "no_letter_words": sum(not any(c.isalpha() for c in w) for w in words) / max(n, 1),
        "repeated_lines": (len(lines) - len(set(lines))) / max(len(lines), 1),
        "line_words": math.log1p(n / max(len(lines), 1)),
        "distinct_words": len(set(words)) / n if n else 0.0,
        "top_word": max(map(words.count, set(words))) / n if n else 0.0,
        "doubled_words": sum(a == b for a, b in zip(words, words[1:], strict=False)) / (n - 1) if n > 1 else 0.0,
        "repeated_triples": 1 - len(set(triples)) / len(triples) if len(triples) > 1 else 0.0,
    }


def test_statistics_by_brute_force():
    rng = random.Random(9)
    texts = ["".join(rng.choice("ab AB#|\n\té3.") for _ in range(rng.randint(0, 200))) for _ in range(60)] + [t for t in AWKWARD if t is None or len(t) < 99]
    got = boosting.statistics([None if t is None else t.encode() for t in texts])
    assert got.shape == (len(texts), len(boosting.STATISTICS)) and np.isfinite(got).all()
    for row, text in zip(got, texts, strict=True):
        for name, value in plain_statistics(text).items():
            assert abs(row[boosting.STATISTICS.index(name)] - value) < 1e-9, (name, text)


def one_tree(row, feature, cut, value):
    node = 0
    while node < len(feature):
        node = 2 * node + 1 + (row[feature[node]] > cut[node])
    return value[node - len(feature)]


def test_flat_trees_are_walked_like_single_ones():
    rng = np.random.default_rng(4)
    x = rng.standard_normal((400, len(boosting.STATISTICS)))
    x[:, 3] = np.round(x[:, 3])
    y = (x[:, 0] * x[:, 1] + x[:, 3] > 0).astype(float)
    weight = rng.random(400) + 0.5
    trees = boosting.fit(x, y, weight)
    bins = boosting._binned(x, trees.edges)
    assert bins.max() < boosting.BINS
    want = [trees.base + sum(one_tree(r, *t) for t in zip(trees.feature, trees.cut, trees.value, strict=True)) for r in bins]
    assert np.abs(boosting.logits(trees, x) - want).max() < 1e-9
    assert ((boosting.logits(trees, x) > 0) == y).mean() > 0.95


def test_the_first_split_is_the_best_one():
    rng = np.random.default_rng(6)
    bins = rng.integers(0, 6, (120, 3))
    g, h = rng.standard_normal(120), rng.random(120) + 0.1
    feature, cut, value = boosting._grow(bins, g, h, 1)

    def gain(f, c):
        left = bins[:, f] <= c
        part = lambda at: g[at].sum() ** 2 / (h[at].sum() + boosting.RIDGE)
        if min(h[left].sum(), h[~left].sum()) < boosting.LEAST_WEIGHT:
            return 0
        return part(left) + part(~left) - part(left | ~left)

    best = max(gain(f, c) for f in range(3) for c in range(6))
    assert abs(gain(feature[0], cut[0]) - best) < 1e-9
    left = bins[:, feature[0]] <= cut[0]
    assert np.allclose(value, [-g[a].sum() / (h[a].sum() + boosting.RIDGE) for a in (left, ~left)])


def test_held_out_labels_and_contract(spark):
    sf = "/root/testdata/sf0.01"
    table = queries.op12_boosting(spark, sf)
    assert dict(table.dtypes) == {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"}
    marks = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = table.collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert all(r["predicted"] == (r["score"] >= 0.3) and 0 <= r["score"] <= 1 for r in rows)
    held = [r for r in rows if r["held_out"] and r["doc_id"] in marks]
    good, bad = ([r["score"] for r in held if marks[r["doc_id"]] == k] for k in (1, 0))
    assert sum(g > b for g in good for b in bad) / (len(good) * len(bad)) > 0.95
    assert sum(r["predicted"] == marks[r["doc_id"]] for r in held) / len(held) > 0.93


def test_awkward_rows(spark):
    rows = list(enumerate(AWKWARD)) + [(0, "again"), (None, "no id"), (None, None), (4, "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for name in ("key", "row", "body", "score", "y", "marked", "statistics"):
        docs = docs.withColumn(name, F.lit(1))
    marks = spark.createDataFrame([(5, 1), (6, 0), (6, 1), (7, None), (None, 1), (8, 0)], "doc_id long, quality int").withColumn("y", F.lit(0))
    for labels in (marks, marks.filter("quality = 1 and doc_id = 5"), marks.filter("false")):
        trees = boosting.train(docs, labels, ~common.held_out("doc_id", 5, 0))
        got = boosting.score(docs, trees, with_row=True).collect()
        assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
        assert len({r["score"] for r in got if r["row"]["text"] == "a"}) == 1
    assert {r["score"] for r in got} == {0.5}
    assert boosting.score(docs.filter("false"), trees).count() == 0
    assert boosting.train(docs.filter("false"), marks, F.lit(True)).value.shape[0] == 0
