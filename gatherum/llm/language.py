"""Language identification by prediction by partial matching over bytes.

Each language has a context tree of up to three bytes. A byte costs its code length in the
longest known context; a byte unseen there costs the escape (method C) and is looked up one byte
shorter, down to a uniform 8 bits. The statistics are frozen after training, so a text's code
length is a sum of table entries and the language with the shortest code wins.

Null texts and texts without a letter are ``und`` with score 0. Training ignores rows with a null
language or text; with none left every text is ``und``. Ties go to the first language in order.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatherum.llm.common import per_row

#: Training rows per language (as a hash share of all) and the longest of them.
TRAIN_ROWS, TRAIN_BYTES = 400, 200_000
SLICE = 1 << 18


class _Table:
    """Open-addressing table from 32-bit codes to row numbers, for whole arrays at a time."""

    def __init__(self, codes: np.ndarray):
        self.bits = max(10, int(4 * max(1, len(codes))).bit_length())
        self.row = np.full(1 << self.bits, -1, np.int32)
        self.key = np.zeros(1 << self.bits, np.uint32)
        left, slot = np.arange(len(codes)), self._slot(codes)
        while len(left):
            free = self.row[slot[left]] < 0
            first = left[free][np.unique(slot[left[free]], return_index=True)[1]]
            self.row[slot[first]], self.key[slot[first]] = first, codes[first]
            left = np.setdiff1d(left, first, assume_unique=True)
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)

    def _slot(self, codes: np.ndarray) -> np.ndarray:
        return ((codes.astype(np.uint32) * np.uint32(2654435761)) >> np.uint32(32 - self.bits)).astype(np.int64)

    def find(self, codes: np.ndarray) -> np.ndarray:
        """Row of each code, -1 where it is unknown."""
        slot = self._slot(codes)
        row = self.row[slot]
        off = np.flatnonzero((row >= 0) & (self.key[slot] != codes))
        while len(off):
            slot[off] = (slot[off] + 1) & ((1 << self.bits) - 1)
            row[off] = self.row[slot[off]]
            off = off[(row[off] >= 0) & (self.key[slot[off]] != codes[off])]
        return row


def _costs(grams: list[np.ndarray], counts: list[np.ndarray]) -> dict:
    """Frozen code lengths from each language's 4-byte grams; column i is language i."""
    n = len(grams)
    every = {
        4: np.unique(np.concatenate(grams)),
        3: np.unique(np.concatenate([g & np.uint32(0xFFFFFF) for g in grams] + [g >> np.uint32(8) for g in grams])),
    }
    cost1 = np.empty((256, n), np.float32)
    cost2, esc2 = np.empty((65536, n), np.float32), np.zeros((65536, n), np.float32)
    cost3, esc3 = np.empty((len(every[3]), n), np.float32), np.zeros((len(every[3]), n), np.float32)
    cost4 = np.empty((len(every[4]), n), np.float32)
    for i, (gram, count) in enumerate(zip(grams, counts, strict=True)):
        def order(k, gram=gram, count=count):
            """Codes of k bytes (context and symbol): counts, then the context's totals."""
            codes, at = np.unique(gram & np.uint32((1 << 8 * k) - 1), return_inverse=True)
            c = np.bincount(at, count)
            ctx, of, distinct = np.unique(codes >> np.uint32(8), return_inverse=True, return_counts=True)
            total = np.bincount(of, c)
            bits = np.log2((total + distinct)[of] / c)
            return codes, bits, ctx, np.log2((total + distinct) / distinct)

        codes, bits, _, esc = order(1)
        cost1[:, i] = esc[0] + 8
        cost1[codes, i] = bits
        codes, bits, ctx, esc = order(2)
        e1 = np.zeros(256, np.float32)
        e1[ctx] = esc
        pairs = np.arange(65536)
        cost2[:, i] = e1[pairs >> 8] + cost1[pairs & 255, i]
        cost2[codes, i] = bits
        codes, bits, ctx, esc = order(3)
        esc2[ctx, i] = esc
        cost3[:, i] = esc2[every[3] >> 8, i] + cost2[every[3] & 65535, i]
        cost3[np.searchsorted(every[3], codes), i] = bits
        codes, bits, ctx, esc = order(4)
        esc3[np.searchsorted(every[3], ctx), i] = esc
        at3 = lambda c: np.searchsorted(every[3], c)
        cost4[:, i] = esc3[at3(every[4] >> np.uint32(8)), i] + cost3[at3(every[4] & np.uint32(0xFFFFFF)), i]
        cost4[np.searchsorted(every[4], codes), i] = bits
    return {"c4": every[4], "c3": every[3], "cost2": cost2, "esc2": esc2, "cost3": cost3, "esc3": esc3, "cost4": cost4}


class Model:
    """Languages and their frozen code lengths; look-up tables are built once in each worker."""

    def __init__(self, languages: list[str], costs: dict | None):
        self.languages, self.costs, self.tables = languages, costs, None

    def byte_bits(self, codes: np.ndarray) -> np.ndarray:
        """Code length in bits, per language, of the last byte of each 4-byte code."""
        t = self.costs
        if self.tables is None:
            self.tables = _Table(t["c4"]), _Table(t["c3"])
        row = self.tables[0].find(codes)
        bits = t["cost4"][row]
        rare = np.flatnonzero(row < 0)
        if len(rare):
            code = codes[rare]
            ctx, low = self.tables[1].find(code >> np.uint32(8)), self.tables[1].find(code & np.uint32(0xFFFFFF))
            short = t["esc2"][(code >> np.uint32(8)) & np.uint32(0xFFFF)] + t["cost2"][code & np.uint32(0xFFFF)]
            short = np.where((low >= 0)[:, None], t["cost3"][low], short)
            bits[rare] = short + np.where((ctx >= 0)[:, None], t["esc3"][ctx], 0)
        return bits

    def text_bits(self, texts: list[bytes]) -> np.ndarray:
        """Total code length of each text in each language."""
        total = np.zeros((len(texts), len(self.languages)))
        joined = np.frombuffer(b"".join(b"\0\0\0" + t for t in texts), np.uint8)
        ends = np.cumsum([len(t) + 3 for t in texts], dtype=np.int64)
        begins = np.concatenate([[0], ends[:-1]]) + 3
        for a in range(3, len(joined), SLICE):
            b = min(len(joined), a + SLICE)
            w = joined[a - 3 : b].astype(np.uint32)
            bits = self.byte_bits(w[:-3] << 24 | w[1:-2] << 16 | w[2:-1] << 8 | w[3:])
            run = np.zeros((b - a + 1, bits.shape[1]))
            np.cumsum(bits, axis=0, out=run[1:])
            lo, hi = np.searchsorted(ends, a, "right"), np.searchsorted(begins, b, "left")
            s, e = np.clip(begins[lo:hi], a, b) - a, np.clip(ends[lo:hi], a, b) - a
            total[lo:hi] += run[np.maximum(e, s)] - run[s]
        return total


def _grams(texts: list) -> tuple[np.ndarray, np.ndarray]:
    joined = [np.frombuffer(b"\0\0\0" + t, np.uint8).astype(np.uint32) for t in texts if t]
    if not joined:
        return np.empty(0, np.uint32), np.empty(0, np.int64)
    codes = np.concatenate([w[:-3] << 24 | w[1:-2] << 16 | w[2:-1] << 8 | w[3:] for w in joined])
    return np.unique(codes, return_counts=True)


def train(
    docs: DataFrame, use: Column, text_col: str = "text", lang_col: str = "lang",
    rows: int = TRAIN_ROWS, max_bytes: int = TRAIN_BYTES,
) -> Model:
    """Learn from about ``rows`` rows a language among those for which ``use`` is true.

    The rows are a hash share of each language's rows, none longer than ``max_bytes``. The driver
    gets the counts of all their 4-byte grams, so ``rows`` and ``max_bytes`` bound what it holds.
    """
    body = F.col(text_col).cast("string").cast("binary")
    pool = docs.filter(use & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(lang_col).cast("string").alias("lang"), body.alias("body")
    )
    fits = pool.filter(F.length("body").between(1, max_bytes))
    sizes = {r[0]: r[1] for r in fits.groupBy("lang").count().collect()}
    if not sizes:
        return Model([], None)
    share = F.lit(0.0)
    for lang, n in sizes.items():
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, rows / n))).otherwise(share)
    picked = fits.filter(F.pmod(F.xxhash64("body"), F.lit(1 << 30)) < share * (1 << 30))

    def count(batches):
        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), object)
            bodies = batch.column(1).to_pylist()
            for lang in sorted(set(langs)):
                codes, n = _grams([bodies[i] for i in np.flatnonzero(langs == lang)])
                yield pa.RecordBatch.from_pydict(
                    {"lang": pa.array([lang] * len(codes), pa.string()), "code": codes.astype(np.int64), "n": n.astype(np.int64)}
                )

    found = (
        picked.mapInArrow(count, "lang string, code long, n long")
        .groupBy("lang", "code").agg(F.sum("n").alias("n"))
    )
    table = found.toArrow().to_pandas().sort_values(["lang", "code"])  # rows x bytes bound what is counted
    languages = sorted(table["lang"].unique())
    own = [table[table["lang"] == x] for x in languages]
    return Model(
        languages,
        _costs([t["code"].to_numpy().astype(np.uint32) for t in own], [t["n"].to_numpy().astype(float) for t in own]),
    )


def predict(
    docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", with_row: bool = False
) -> DataFrame:
    """``(key, [row,] lang_pred, score)`` for each row: best language and its posterior share."""
    sent = docs.sparkSession.sparkContext.broadcast({"languages": model.languages, "costs": model.costs})

    def compute(texts: list) -> pa.RecordBatch:
        own = sent.value  # plain data; the worker keeps the model built from it next to it
        if "model" not in own:
            own["model"] = Model(own["languages"], own["costs"])
        m = own["model"]
        known = [bool(m.languages and t and any(map(str.isalpha, t.decode("utf-8", "replace")))) for t in texts]
        lang, score = ["und"] * len(texts), np.zeros(len(texts))
        at = np.flatnonzero(known)
        if len(at):
            bits = m.text_bits([texts[i] for i in at])
            best = bits.argmin(axis=1)
            gap = np.minimum(bits - bits.min(axis=1, keepdims=True), 1000.0)
            score[at] = 1 / np.exp2(-gap).sum(axis=1)
            for i, b in zip(at, best, strict=True):
                lang[i] = m.languages[b]
        return pa.RecordBatch.from_pydict({"lang_pred": pa.array(lang, pa.string()), "score": score})

    return per_row(docs, id_col, text_col, compute, "lang_pred string, score double", with_row)
