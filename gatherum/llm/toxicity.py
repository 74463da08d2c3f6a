"""Toxicity by a convolutional text classifier in numpy.

A word's embedding is the sum of those hashed for the word and for two of its prefixes; filters over one, two and three words are max-pooled over the
whole text, and the pooled values give one logit. Thresholds are calibrated by language, guessed
from function words of the text itself, and shift the logit so that 0.5 is every threshold.

Null and empty texts have no word and get the score of all-zero pools, below 0.5 after training;
repeated rows get the same score. Labels that are null are not learned from; of several labels of
one document the highest counts, and of rows that share an id one is learned from. With no labels of
both classes the score is 0 everywhere. Of equally good thresholds the one in the widest gap is
taken. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatherum.llm.common import per_row, pieces_of, split_words

#: Labelled rows learned from, per class (a hash share), and the longest of them in bytes.
TRAIN_ROWS, TRAIN_BYTES = 3000, 200_000
BUCKETS, DIM, WIDTHS, FILTERS = 1 << 18, 8, (1, 2, 3), 8
EPOCHS, BATCH, RATE, DECAY = 5, 32, 0.1, 1e-5
SLICE = 1 << 19
COARSE_BITS = 14  # low bits of a logit that the first count for a threshold leaves out
#: Frequent function words of four languages.
FUNCTION_WORDS = {
    "en": "the of and to in is that it for was with be by this are from".split(),
    "fr": "le la les des et un une du que qui pour dans est sur par pas".split(),
    "de": "der die und das den von zu mit ist des sich auf dem nicht ein eine".split(),
    "es": "el los las que y en del se por con una su para es al lo".split(),
}
LANGUAGES = list(FUNCTION_WORDS)
PREFIXES = (4, 7)
EDGES = ".,;:!?()[]{}<>\"'*#%$&|-"


def _codes(word: str) -> tuple[int, ...]:
    """Buckets of the bare word and of its prefixes, each told apart by its length."""
    bare = word.lower().strip(EDGES)
    return tuple(zlib.crc32(bare[:n].encode(), n) % BUCKETS for n in (99, *PREFIXES))


def encode(texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Where each text begins, buckets of each distinct word, each word's row there, the guessed languages."""
    starts, distinct, at = split_words(texts)
    words = distinct.to_pylist()
    bucket = np.array([_codes(w.decode("utf-8", "replace")) for w in words], np.int32).reshape(-1, 1 + len(PREFIXES))
    own = {w.encode(): i for i, x in enumerate(LANGUAGES) for w in FUNCTION_WORDS[x]}
    tongue = np.fromiter((own.get(w.lower(), -1) for w in words), np.int8, len(words))[at]
    hits = np.zeros((len(texts), len(LANGUAGES)), np.int64)
    owner = np.repeat(np.arange(len(texts)), np.diff(starts))
    np.add.at(hits, (owner[tongue >= 0], tongue[tongue >= 0]), 1)
    return starts, bucket, at, hits.argmax(axis=1)


class Net:
    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.embed = (rng.standard_normal((BUCKETS, DIM)) * 0.1).astype(np.float32)
        self.filters = [(rng.standard_normal((w * DIM, FILTERS)) / np.sqrt(w * DIM)).astype(np.float32) for w in WIDTHS]
        self.out = np.full(len(WIDTHS) * FILTERS, 0.3, np.float32)
        self.bias = 0.0
        self.cut = np.zeros(len(LANGUAGES))
        self.tables = None

    def pooled(self, starts: np.ndarray, buckets: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Rectified maxima of every filter over each text. Long texts go slice by slice."""
        if self.tables is None:  # embedding times filter, for each place in the window
            self.tables = [
                [self.embed @ f[i * DIM : (i + 1) * DIM] for i in range(w)] for w, f in zip(WIDTHS, self.filters, strict=True)
            ]
        tables = [[sum(t[buckets[:, i]] for i in range(buckets.shape[1])) for t in own] for own in self.tables]
        best = np.zeros((len(starts) - 1, len(self.out)), np.float32)
        for a in range(0, len(ids), SLICE):
            b = min(len(ids), a + SLICE)
            lo, hi = np.searchsorted(starts, a, "right") - 1, np.searchsorted(starts, b, "left")
            for k, (w, table) in enumerate(zip(WIDTHS, tables, strict=True)):
                docs = np.arange(lo, hi)
                s, e = np.clip(starts[lo:hi], a, b), np.minimum(starts[lo + 1 : hi + 1] - (w - 1), b)
                live = e > s
                if not live.any():
                    continue
                stop = e[live].max()
                value = table[0][ids[a:stop]]
                for i in range(1, w):
                    value = value + table[i][ids[a + i : stop + i]]
                bounds = np.stack([s[live], e[live]], 1).ravel() - a
                bounds[-1] = min(bounds[-1], len(value))
                inner = bounds[:-1] if bounds[-1] == len(value) else bounds
                top = np.maximum.reduceat(value, inner, axis=0)[::2]
                cols = slice(k * FILTERS, (k + 1) * FILTERS)
                best[docs[live], cols] = np.maximum(best[docs[live], cols], top)
        return best

    def logits(self, starts: np.ndarray, buckets: np.ndarray, ids: np.ndarray) -> np.ndarray:
        return self.pooled(starts, buckets, ids) @ self.out + self.bias

    def step(self, texts: list[np.ndarray], y: np.ndarray, state: dict) -> None:
        """One Adagrad step; only the words that won a maximum get a gradient."""
        n = len(texts)
        wins, best = [], np.zeros((n, len(self.out)), np.float32)
        for d, ids in enumerate(texts):
            for k, (w, f) in enumerate(zip(WIDTHS, self.filters, strict=True)):
                if len(ids) < w:
                    continue
                e = self.embed[ids].sum(axis=1)
                x = np.concatenate([e[i : len(ids) - w + 1 + i] for i in range(w)], axis=1)
                v = x @ f
                at = v.argmax(axis=0)
                top = v[at, np.arange(FILTERS)]
                best[d, k * FILTERS : (k + 1) * FILTERS] = np.maximum(top, 0)
                wins += [(d, k, j, ids[p : p + w], x[p]) for j, (p, t) in enumerate(zip(at, top, strict=True)) if t > 0]
        z = best @ self.out + self.bias
        err = (1 / (1 + np.exp(-z)) - y) / n
        moves = [np.zeros_like(f) for f in self.filters]
        rows: dict[int, np.ndarray] = {}
        for d, k, j, ids, x in wins:
            g = err[d] * self.out[k * FILTERS + j]
            moves[k][:, j] += g * x
            for i, own in enumerate(ids):
                part = g * self.filters[k][i * DIM : (i + 1) * DIM, j]
                for bucket in own:
                    rows[bucket] = rows.get(bucket, 0) + part
        at = np.fromiter(rows, np.int64, len(rows))

        def adagrad(name, value, grad, where=slice(None)):
            total = state.setdefault(name, np.full(value.shape, 1e-6, np.float32))
            total[where] += grad**2
            value[where] -= RATE * grad / np.sqrt(total[where])

        if len(at):
            adagrad("embed", self.embed, np.stack(list(rows.values())).astype(np.float32) + DECAY * self.embed[at], at)
        for k, f in enumerate(self.filters):
            adagrad(f"f{k}", f, moves[k] + DECAY * f)
        adagrad("out", self.out, (best.T @ err).astype(np.float32) + DECAY * self.out)
        bias = np.array([self.bias], np.float32)
        adagrad("bias", bias, np.array([err.sum()], np.float32))
        self.bias = float(bias[0])


def _place(z: np.ndarray) -> np.ndarray:
    """Whole numbers in the order of float32 values, and back: the same turn of the bits of negative ones."""
    bits = z.view(np.int32)
    return np.where(bits < 0, bits ^ 0x7FFFFFFF, bits).astype(np.int32)


def _value(place: np.ndarray) -> np.ndarray:
    return _place(place.astype(np.int32).view(np.float32)).view(np.float32).astype(float)


def _errors(own: pd.DataFrame, weight: list[float]) -> np.ndarray:
    """Weighted errors of a cut before each entry and after the last."""
    fine, bad = (np.concatenate([[0], np.cumsum(own[c].to_numpy(np.int64))]) for c in ("n0", "n1"))
    return weight[1] * bad + weight[0] * (fine[-1] - fine)


def _cuts(judged: DataFrame, mass: dict[int, float]) -> dict[int | None, float]:
    """For each guessed language with 50 rows of both classes, and for all (None), the logit between two rows that
    makes the fewest errors; the middle of the widest such gap. Classes weigh as much as ``mass`` says.

    ``judged`` is ``(y, lang, at)``, ``at`` the place of a float32 logit. Rows are counted by the
    high bits of their place, and only the few counts that a best cut may lie inside are opened to
    single values: exact over all rows, and no more than these counts reach the driver.
    """
    counts = [F.sum(1 - F.col("y")).alias("n0"), F.sum("y").alias("n1")]
    keyed = judged.withColumn("b", F.shiftright("at", COARSE_BITS))
    coarse = keyed.groupBy("lang", "b").agg(*counts, F.min("at").alias("lo"), F.max("at").alias("hi")).toPandas()
    weight = [mass[c] / max(1, int(coarse[f"n{c}"].sum())) for c in (0, 1)]
    groups: dict = {None: coarse}
    for lang, own in coarse.groupby("lang"):
        if own["n0"].sum() and own["n1"].sum() and own["n0"].sum() + own["n1"].sum() >= 50:
            groups[int(lang)] = own
    slack = 1e-9 * sum(mass.values())  # for rounding of the weighted sums
    opened = set()
    for lang, own in groups.items():
        own = own.groupby("b").agg({"n0": "sum", "n1": "sum", "lo": "min", "hi": "max"}).sort_index()
        wrong = _errors(own, weight)
        inside = (wrong[:-1] - weight[0] * own["n0"] <= wrong.min() + slack) & (own["lo"] < own["hi"])
        opened |= {(int(x), int(b)) for b in own.index[inside] for x in (range(len(LANGUAGES)) if lang is None else [lang])}
    if opened:
        listed = judged.sparkSession.createDataFrame(sorted(opened), "lang int, b int")
        single = keyed.join(F.broadcast(listed), ["lang", "b"]).groupBy("lang", "b", "at").agg(*counts).toPandas()
        single = single.assign(lo=single["at"], hi=single["at"]).drop(columns="at")
        closed = [(int(x), int(b)) not in opened for x, b in zip(coarse["lang"], coarse["b"])]
        coarse = pd.concat([coarse[closed], single])
    out: dict[int | None, float] = {}
    for lang in groups:
        own = coarse if lang is None else coarse[coarse["lang"] == lang]
        # counts that are not opened for a language may be for all: whole ones and single values never overlap
        own = own.groupby("lo").agg({"n0": "sum", "n1": "sum", "hi": "max"}).sort_index().reset_index()
        if lang is None:
            own = _merged(own)
        wrong = _errors(own, weight)
        lo, hi = _value(own["lo"].to_numpy()), _value(own["hi"].to_numpy())
        below, above = np.concatenate([[lo[0] - 1], hi]), np.concatenate([lo, [hi[-1] + 1]])
        places = np.flatnonzero(wrong <= wrong.min() + slack)
        best = places[(above - below)[places].argmax()]
        out[lang] = float((np.float32(below[best]) + np.float32(above[best])) / 2)
    return out


def _merged(own: pd.DataFrame) -> pd.DataFrame:
    """Entries of several languages by their ranges: those that overlap become one."""
    apart = (own["lo"] > own["hi"].cummax().shift(fill_value=np.iinfo(np.int32).min)).cumsum()
    return own.groupby(apart.to_numpy()).agg({"n0": "sum", "n1": "sum", "lo": "min", "hi": "max"})


def train(
    docs: DataFrame, labels: DataFrame, use: Column, id_col: str = "doc_id", text_col: str = "text",
    label_col: str = "toxic", rows: int = TRAIN_ROWS, max_bytes: int = TRAIN_BYTES, seed: int = 7,
) -> Net | None:
    """Learn from about ``rows`` labelled rows of each class among those with ``use``.

    The rows are a hash share of each class, none longer than ``max_bytes``, and the net learns from
    four fifths of them. All other labelled rows with ``use`` set the thresholds, of whatever
    length; if no such fifth has both classes, all rows do. ``None`` if a class has no row.
    """
    marked = labels.filter(F.col(label_col).isNotNull()).groupBy(id_col).agg(F.max(label_col).cast("int").alias("y"))
    size = {r[0]: r[1] for r in marked.groupBy("y").count().collect()}
    if not (size.get(0) and size.get(1)):
        return None
    share = F.when(F.col("y") == 1, min(1.0, rows / size[1])).otherwise(min(1.0, rows / size[0]))
    sampled = F.pmod(F.xxhash64(id_col), F.lit(1 << 30)) < share * (1 << 30)
    sample = marked.filter(sampled)  # about 2 x rows ids
    body = F.col(text_col).cast("string").cast("binary")
    pool = (
        docs.filter(use & F.col(text_col).isNotNull()).select(id_col, body.alias("body"))
        .filter(F.length("body") <= max_bytes).join(F.broadcast(sample), id_col)
        .groupBy(id_col).agg(F.max("y").alias("y"), F.min("body").alias("body")).select("y", "body")  # the sample's rows only
    )

    def shrink(batches):
        for batch in pieces_of(batches, "body"):
            starts, buckets, at, tongue = encode(batch.column("body").to_pylist())
            flat = buckets[at].ravel()
            yield pa.RecordBatch.from_pydict({
                "y": batch.column("y"), "lang": pa.array(tongue, pa.int32()),
                "ids": pa.ListArray.from_arrays(pa.array(starts * buckets.shape[1], pa.int32()), pa.array(flat, pa.int32())),
                "h": batch.column("h"),
            })

    picked = (
        pool.withColumn("h", F.xxhash64("body"))
        .mapInArrow(shrink, "y int, lang int, ids array<int>, h long")
        .toArrow()
    )
    y, lang, h = (picked.column(c).to_numpy() for c in ("y", "lang", "h"))
    order = np.lexsort((y, h))  # the same order however the rows came in
    texts = [np.asarray(x.values).reshape(-1, 1 + len(PREFIXES)) for x in picked.column("ids")]
    texts, y, lang, h = [texts[i] for i in order], y[order], lang[order], h[order]
    hold = (h // 1024) % 5 == 0
    if len(set(y[~hold])) < 2 or len(set(y[hold])) < 2:
        hold = np.zeros(len(y), bool)
        if len(set(y)) < 2:
            return None
    net, state, rng = Net(seed), {}, np.random.default_rng(seed)
    bad, fine = np.flatnonzero(~hold & (y == 1)), np.flatnonzero(~hold & (y == 0))
    half = BATCH // 2
    for _ in range(EPOCHS):
        steps = max(1, max(len(bad), len(fine)) // half)
        for _ in range(steps):
            at = np.concatenate([rng.choice(bad, half), rng.choice(fine, half)])
            net.step([texts[i] for i in at], y[at].astype(np.float32), state)
    net.tables = None
    # the rows that the net has not learned from, by the same hashes; no text is shuffled
    fit = (F.length(body) <= max_bytes) & (F.pmod(F.shiftright(F.xxhash64(body), 10), F.lit(5)) != 0)
    tagged = docs.filter(use & F.col(text_col).isNotNull()).select(
        F.struct(F.col(id_col).alias("id"), fit.alias("fit")).alias("k"), F.col(text_col).alias("text"))
    sent = docs.sparkSession.sparkContext.broadcast({"parts": vars(net)})

    def compute(texts: list) -> pa.RecordBatch:
        starts, buckets, at, tongue = encode(texts)
        z = _net(sent.value).logits(starts, buckets, at).astype(np.float32) + np.float32(0)  # one zero
        return pa.RecordBatch.from_pydict({"at": pa.array(_place(z), pa.int32()), "lang": pa.array(tongue, pa.int32())})

    found = per_row(tagged, "k", "text", compute, "at int, lang int").select(F.col("key.id").alias(id_col), "key.fit", "at", "lang")
    found = found.join(marked, id_col).withColumn("learned", F.col("fit") & sampled if hold.any() else F.lit(False))
    found = found.groupBy(id_col).agg(
        F.max("y").alias("y"), F.max("learned").alias("learned"), F.min(F.struct("at", "lang")).alias("s"))
    judged = found.filter(~F.col("learned")).select("y", "s.lang", "s.at").persist()
    cuts = _cuts(judged, {c: float(min(rows, n)) for c, n in size.items()})
    judged.unpersist()
    sent.unpersist()
    net.cut[:] = cuts.pop(None)
    for lang, cut in cuts.items():
        net.cut[lang] = cut
    return net


def _net(own: dict) -> Net:
    """The net of plain data that was sent; the worker keeps the one built from it next to it."""
    if "net" not in own:
        own["net"] = Net.__new__(Net)
        vars(own["net"]).update(own["parts"])
    return own["net"]


def score(docs: DataFrame, net: Net | None, id_col: str = "doc_id", text_col: str = "text", with_row: bool = False) -> DataFrame:
    """``(key, [row,] score, predicted)`` of every whole text."""
    sent = docs.sparkSession.sparkContext.broadcast(net and {"parts": vars(net) | {"tables": None}})

    def compute(texts: list) -> pa.RecordBatch:
        p = np.zeros(len(texts))
        if sent.value is not None and len(texts):
            model = _net(sent.value)
            starts, buckets, at, lang = encode(texts)
            z = model.logits(starts, buckets, at) - model.cut[lang]
            p = 1 / (1 + np.exp(-np.clip(z, -30, 30).astype(float)))
        return pa.RecordBatch.from_pydict({"score": p, "predicted": (p >= 0.5).astype(np.int32)})

    return per_row(docs, id_col, text_col, compute, "score double, predicted int", with_row)
