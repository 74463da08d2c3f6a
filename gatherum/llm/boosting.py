"""Document quality by histogram gradient-boosted trees over document statistics.

Every text becomes a row of statistics: sizes, shares of symbols, capitals, digits and repeats. The
statistics of a bounded sample of labelled rows are cut into at most ``BINS`` bins by quantiles;
each tree is grown level by level from histograms of gradients over those bins. Trees are complete
and flattened: one array of features, one of bins and one of leaf values over all trees, so a batch
of texts goes through all trees at once, a level at a time.

Null and empty texts have zeros as statistics and are scored like any other; repeated rows get the
same score. Where labels of one document differ, the lowest counts; null labels are not learned
from. With labels of one class only, or none, every score is the smoothed share of good labels
(0.5 without labels). An empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatherum.llm.common import per_row, split_words

#: Labelled rows learned from, per class (a hash share), and the longest of them in bytes.
TRAIN_ROWS, TRAIN_BYTES = 10_000, 200_000
TREES, DEPTH, BINS, RATE, RIDGE, LEAST_WEIGHT = 80, 4, 64, 0.15, 1.0, 5.0
#: Statistics, in the order of their columns.
STATISTICS = [
    "log_words", "log_bytes", "word_chars", "word_chars_deviation", "symbols", "marks", "capitals", "all_capitals",
    "digits", "plain_words", "no_letter_words", "sentence_ends", "exclamations", "line_words", "repeated_lines",
    "distinct_words", "top_word", "doubled_words", "repeated_triples", "byte_entropy",
]
#: What is counted in each distinct word, as patterns.
PATTERNS = {
    "symbols": r"[#*$%&|<>{}\\^~=_@]", "marks": r"[.,;:!?()'\"]", "capitals": r"\p{Lu}", "digits": r"\p{Nd}",
    "letters": r"\pL", "exclamations": "!",
}


class Trees(NamedTuple):
    """Complete trees of one depth. ``edges[f]`` cuts statistic f into bins; node i has children 2i+1 and 2i+2."""

    edges: list[np.ndarray]
    feature: np.ndarray  # tree, inner node
    cut: np.ndarray  # tree, inner node: bins up to this go left
    value: np.ndarray  # tree, leaf
    base: float


def _repeats(ids: np.ndarray) -> tuple[float, float, float, float]:
    """Shares of distinct words, of the most frequent one, of words equal to the one before, of repeated triples."""
    n = len(ids)
    if not n:
        return 0.0, 0.0, 0.0, 0.0
    _, own, count = np.unique(ids, return_inverse=True, return_counts=True)
    doubled = float((own[1:] == own[:-1]).mean()) if n > 1 else 0.0
    triples = 0.0
    if n > 3:
        pair = np.unique(own[:-1].astype(np.int64) * len(count) + own[1:], return_inverse=True)[1].astype(np.int64)
        kinds = len(np.unique(pair[:-1] * len(count) + own[2:]))
        triples = 1 - kinds / (n - 2)
    return len(count) / n, count.max() / n, doubled, triples


def _lines(text: bytes) -> tuple[int, int]:
    """Lines with something in them, and those equal to an earlier one."""
    lines = [x for x in text.split(b"\n") if x.strip()]
    return len(lines), len(lines) - len(set(lines))


def _entropy(text: bytes) -> float:
    if not text:
        return 0.0
    share = np.bincount(np.frombuffer(text, np.uint8))
    share = share[share > 0] / len(text)
    return float(-(share * np.log2(share)).sum())


def statistics(texts: list) -> np.ndarray:
    """One row of ``STATISTICS`` for each text."""
    starts, distinct, at = split_words(texts)
    words = distinct.view(pa.large_string())
    n = np.diff(starts)
    per_word = np.maximum(n, 1)

    def total(of_each: np.ndarray) -> np.ndarray:
        run = np.concatenate([[0.0], np.cumsum(of_each[at].astype(float))])
        return run[starts[1:]] - run[starts[:-1]]

    chars = pc.utf8_length(words).to_numpy().astype(float)
    found = {k: pc.count_substring_regex(words, p).to_numpy().astype(float) for k, p in PATTERNS.items()}
    matches = lambda p: pc.match_substring_regex(words, p).to_numpy(zero_copy_only=False)
    letters = np.maximum(total(found["letters"]), 1)
    length = total(chars) / per_word
    spread = np.sqrt(np.maximum(total(chars**2) / per_word - length**2, 0))
    lines = np.array([_lines(t or b"") for t in texts], float).reshape(-1, 2)
    per_line = np.maximum(lines[:, 0], 1)
    repeats = np.array([_repeats(at[a:b]) for a, b in zip(starts[:-1], starts[1:], strict=True)]).reshape(-1, 4)
    share = lambda each: total(each) / per_word
    columns = {
        "log_words": np.log1p(n), "log_bytes": np.log1p([len(t or b"") for t in texts]),
        "word_chars": length, "word_chars_deviation": spread,
        "symbols": share(found["symbols"]), "marks": share(found["marks"]),
        "capitals": total(found["capitals"]) / letters,
        "all_capitals": share((found["capitals"] > 1) & (found["capitals"] == found["letters"])),
        "digits": share(found["digits"]), "plain_words": share(matches(r"^[(\"']?\pL+(['’-]\pL+)*[.,;:!?)\"']*$")),
        "no_letter_words": share(found["letters"] == 0), "sentence_ends": share(matches(r"[.!?][\"')]*$")),
        "exclamations": share(found["exclamations"]), "line_words": np.log1p(n / per_line),
        "repeated_lines": lines[:, 1] / per_line, "distinct_words": repeats[:, 0], "top_word": repeats[:, 1],
        "doubled_words": repeats[:, 2], "repeated_triples": repeats[:, 3],
        "byte_entropy": np.array([_entropy(t or b"") for t in texts]),
    }
    return np.stack([columns[c] for c in STATISTICS], axis=1) if len(texts) else np.zeros((0, len(STATISTICS)))


def _edges(x: np.ndarray) -> list[np.ndarray]:
    """Cuts between different values, at quantiles where there are more values than bins."""
    out = []
    for column in x.T:
        values = np.unique(column)
        if len(values) > BINS:
            values = np.unique(np.quantile(column, np.linspace(0, 1, BINS), method="nearest"))
        out.append((values[1:] + values[:-1]) / 2)
    return out


def _binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T, strict=True)], axis=1).astype(np.int64)


def _leaves(bins: np.ndarray, feature: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """The leaf of each row in each tree: ``(rows, trees)``, one step down for all at once."""
    inner = feature.shape[1]
    rows, tree = np.arange(len(bins))[:, None], np.arange(len(feature))[None, :]
    node = np.zeros((len(bins), len(feature)), np.int64)
    for _ in range(int(inner + 1).bit_length() - 1):
        node = 2 * node + 1 + (bins[rows, feature[tree, node]] > cut[tree, node])
    return node - inner


def logits(trees: Trees, x: np.ndarray) -> np.ndarray:
    leaf = _leaves(_binned(x, trees.edges), trees.feature, trees.cut)
    return trees.base + trees.value[np.arange(len(trees.value))[None, :], leaf].sum(axis=1)


def _grow(bins: np.ndarray, gradient: np.ndarray, curve: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One tree, level by level: the bins that go left, for each node, from histograms of its rows."""
    n, m = bins.shape
    feature = np.zeros(2**depth - 1, np.int64)
    cut = np.full(2**depth - 1, BINS, np.int64)  # a node that is not split sends all rows left
    node, columns = np.zeros(n, np.int64), np.arange(m)[None, :] * BINS
    for level in range(depth):
        nodes, first = 2**level, 2**level - 1
        slot = ((node - first)[:, None] * (m * BINS) + columns + bins).ravel()
        table = lambda v, k=nodes, s=slot: np.bincount(s, np.repeat(v, m), k * m * BINS).reshape(k, m, BINS)
        g, h = np.cumsum(table(gradient), axis=2), np.cumsum(table(curve), axis=2)
        g_all, h_all = g[:, :, -1:], h[:, :, -1:]
        gain = g**2 / (h + RIDGE) + (g_all - g) ** 2 / (h_all - h + RIDGE) - g_all**2 / (h_all + RIDGE)
        gain[(h < LEAST_WEIGHT) | (h_all - h < LEAST_WEIGHT)] = 0
        flat = gain.reshape(nodes, -1)
        best = flat.argmax(axis=1)
        split = flat[np.arange(nodes), best] > 1e-9
        feature[first : first + nodes][split] = best[split] // BINS
        cut[first : first + nodes][split] = best[split] % BINS
        node = 2 * node + 1 + (bins[np.arange(n), feature[node]] > cut[node])
    leaf = node - (2**depth - 1)
    g, h = np.bincount(leaf, gradient, 2**depth), np.bincount(leaf, curve, 2**depth)
    return feature, cut, -g / (h + RIDGE)


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, trees: int = TREES, depth: int = DEPTH) -> Trees:
    """Boosted trees under log loss."""
    share = (weight @ y + 1) / (weight.sum() + 2)
    base = float(np.log(share / (1 - share)))
    feature = np.zeros((0, 2**depth - 1), np.int64)
    grown = Trees(_edges(x) if len(x) else [np.empty(0)] * len(STATISTICS), feature, feature.copy(), np.zeros((0, 2**depth)), base)
    if len(np.unique(y)) < 2:
        return grown
    bins, z, made = _binned(x, grown.edges), np.full(len(y), base), []
    scale = weight * len(weight) / weight.sum()
    for _ in range(trees):
        p = 1 / (1 + np.exp(-z))
        f, c, v = _grow(bins, scale * (p - y), scale * p * (1 - p), depth)
        made.append((f, c, RATE * v))
        z = z + made[-1][2][_leaves(bins, f[None], c[None])[:, 0]]
    return grown._replace(**{k: np.stack([m[i] for m in made]) for i, k in enumerate(("feature", "cut", "value"))})


def train(
    docs: DataFrame, labels: DataFrame, use: Column, id_col: str = "doc_id", text_col: str = "text",
    label_col: str = "quality", rows: int = TRAIN_ROWS, max_bytes: int = TRAIN_BYTES,
) -> Trees:
    """Learn from about ``rows`` labelled documents of each class among the rows with ``use``.

    The rows are a hash share of each class, none longer than ``max_bytes``, weighted back to
    their class's size; only their statistics reach the driver.
    """
    marked = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg(
        F.min(label_col).cast("int").alias("y")
    )
    size = {r[0]: r[1] for r in marked.filter(F.col("y").isin(0, 1)).groupBy("y").count().collect()}
    share = {y: min(1.0, rows / size[y]) for y in size}
    picked = F.lit(False)
    for y, part in share.items():
        picked = picked | ((F.col("y") == y) & (F.pmod(F.xxhash64(id_col), F.lit(1 << 30)) < part * (1 << 30)))
    sample = marked.filter(picked).select(F.col(id_col).alias("key"), "y")  # about 2 x rows ids
    body = F.col(text_col).cast("string")
    fits = docs.filter(use & body.isNotNull() & (F.octet_length(body) <= max_bytes))
    pool = fits.select(F.col(id_col).alias("key"), body.alias("body")).join(F.broadcast(sample), "key").select(
        F.struct("key", "y").alias("marked"), "body"
    )
    found = per_row(pool, "marked", "body", _as_batch, "statistics array<double>").select("key.*", "statistics").toArrow()
    if not found.num_rows:
        return fit(np.zeros((0, len(STATISTICS))), np.zeros(0), np.zeros(0))
    y = found.column("y").to_numpy().astype(float)
    x = np.array(found.column("statistics").to_pylist(), float)
    order = np.lexsort((*x.T, y, found.column("key").to_numpy()))  # the same however the rows came in
    weight = np.array([1 / share[int(v)] for v in y])
    return fit(x[order], y[order], weight[order])


def _as_batch(texts: list) -> pa.RecordBatch:
    x = statistics(texts)
    offsets = pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32())
    return pa.RecordBatch.from_pydict({"statistics": pa.ListArray.from_arrays(offsets, pa.array(x.ravel()))})


def score(
    docs: DataFrame, trees: Trees, id_col: str = "doc_id", text_col: str = "text", least: float = 0.3,
    with_row: bool = False,
) -> DataFrame:
    """``(key, [row,] score, predicted)`` of every whole text; ``predicted`` is 1 from ``least`` on."""
    plain = tuple(trees)  # arrays travel with the function, whatever the worker can import

    def compute(texts: list) -> pa.RecordBatch:
        z = logits(Trees(*plain), statistics(texts))
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        return pa.RecordBatch.from_pydict({"score": p, "predicted": (p >= least).astype(np.int32)})

    return per_row(docs, id_col, text_col, compute, "score double, predicted int", with_row)
