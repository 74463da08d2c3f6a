"""TF-IDF: tokens, document frequencies, pruned vocabulary, weighted unit-length rows.

The only shuffle of the usual path is the partially aggregated document frequency. Counting
terms inside a document, weighting and normalising are then one pass over the text with the
vocabulary held by each executor. Of a vocabulary above ``broadcast_terms`` the most frequent
terms go that way and only the tokens of the others are joined by shuffle, so nothing unbounded
is ever broadcast.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml.linalg import SparseVector, VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatherum.functions.text import tokens
from gatherum.functions.vectors import dense_entries, l2_normalise, sparse_entries
from gatherum.operators.joins import with_sorted_index
from gatherum.session import cut

BROADCAST_TERMS = 1 << 18
COUNT_ROWS = 256  # documents whose counts a task holds as Python objects


def token_rows(docs: DataFrame, stop_words: str | Iterable[str] | None = None) -> DataFrame:
    """``(id, term)``, one row per token."""
    return docs.select("id", F.explode(tokens("document", stop_words)).alias("term"))


def term_counts(docs: DataFrame, stop_words: str | Iterable[str] | None = None) -> DataFrame:
    """``(id, term, tf)``. A document lies in one partition, so the map side already merges it."""
    return token_rows(docs, stop_words).groupBy("id", "term").agg(F.count(F.lit(1)).alias("tf"))


def document_frequency(docs: DataFrame, stop_words: str | Iterable[str] | None = None) -> DataFrame:
    """``(term, df)``: documents holding the term."""
    distinct = docs.select(F.explode(F.array_distinct(tokens("document", stop_words))).alias("term"))
    return distinct.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def _frequent_from(frequencies: DataFrame, most: int) -> float:
    """The lowest ``df`` such that at most ``most`` terms reach it."""
    cutoff, total = float("inf"), 0
    for r in frequencies.groupBy("df").count().orderBy(F.desc("df")).toLocalIterator():
        total += r["count"]
        if total > most:
            break
        cutoff = r["df"]
    return cutoff


def frequent_terms(frequencies: DataFrame, most: int) -> DataFrame:
    """The most frequent terms, at most ``most``; of terms that share a ``df``, all or none."""
    return frequencies.filter(F.col("df") >= F.lit(_frequent_from(frequencies, most)))


def _bound(value: int | float, n: int) -> float:
    """An int is a number of documents, a float a share of them."""
    return float(value) if isinstance(value, int) else value * n


def prune_terms(
    frequencies: DataFrame, n_docs: int, min_df: int | float = 1, max_df: int | float = 1.0
) -> DataFrame:
    """Terms with ``min_df <= df <= max_df``, both ends kept."""
    low, high = _bound(min_df, n_docs), _bound(max_df, n_docs)
    if high < low:
        raise ValueError("max_df corresponds to fewer documents than min_df")
    return frequencies.filter((F.col("df") >= F.lit(low)) & (F.col("df") <= F.lit(high)))


def smooth_idf(df_col: Column, n_docs: int) -> Column:
    """``ln((1 + n) / (1 + df)) + 1``."""
    return F.log(F.lit(1.0 + n_docs) / (F.lit(1.0) + df_col)) + F.lit(1.0)


@dataclass
class TfidfModel:
    """A fitted vocabulary: ``vocabulary`` is ``(term, idx, df, idf)`` in alphabetical order."""

    n_docs: int
    n_terms: int
    stop_words: str | Iterable[str] | None
    vocabulary: DataFrame
    terms: list[str] | None = field(default=None, repr=False)
    idf: list[float] | None = field(default=None, repr=False)
    sent_terms: int = BROADCAST_TERMS  # of a vocabulary that is not sent whole

    def counts(self, docs: DataFrame) -> DataFrame:
        """``(id, features)`` raw term counts, one row per document (zero vectors included)."""
        return self._counts_by_join(docs) if self.terms is None else self._counts_in_place(docs)

    def transform(self, docs: DataFrame) -> DataFrame:
        """``(id, features)`` TF-IDF rows at unit length; a document with no surviving term stays zero."""
        if self.terms is None:
            weighted = self._counts_by_join(docs, weighted=True)
        else:
            weighted = self._counts_in_place(docs, weighted=True)
        return l2_normalise(weighted)

    def weights(self, docs: DataFrame) -> DataFrame:
        """``(id, term, idx, w)`` triples of the TF-IDF matrix."""
        if self.terms is not None:
            names = F.broadcast(self.vocabulary.select("idx", "term"))  # at most BROADCAST_TERMS rows
            return sparse_entries(self.transform(docs)).join(names, "idx").select("id", "term", "idx", "w")
        rows, common = self._cells_in_place(docs, weighted=True)
        names = F.broadcast(common.select("idx", F.col("term").alias("name")))
        usual = F.transform("at", lambda i, n: F.struct(
            F.lit(None).cast("string").alias("term"), i.alias("idx"), F.col("w")[n].alias("w")))
        cells = F.concat(usual, F.coalesce("cells", F.array().cast("array<struct<term:string,idx:int,w:double>>")))
        rows = rows.select("id", cells.alias("cells")).withColumn(
            "norm", F.sqrt(F.aggregate("cells", F.lit(0.0), lambda t, c: t + c["w"] * c["w"])))
        triples = rows.select("id", "norm", F.inline("cells")).join(names, "idx", "left")
        return triples.select(
            "id", F.coalesce("term", "name").alias("term"), F.col("idx").cast("long"), (F.col("w") / F.col("norm")).alias("w"))

    def _cells_in_place(self, docs: DataFrame, weighted: bool) -> tuple[DataFrame, DataFrame]:
        """``(id, at, w, cells)`` of every document, and the frequent terms ``(term, idx, idf)``.

        Frequent terms are as many as may be sent to every task; they are counted where the
        document lies, as ``at`` and ``w``. Only the tokens that are not among them, few by Zipf's
        law, meet the rest of the vocabulary by a shuffle, as ``cells (term, idx, w)``.
        """
        cutoff = _frequent_from(self.vocabulary, self.sent_terms)
        common = cut(self.vocabulary.filter(F.col("df") >= F.lit(cutoff)).select("term", "idx", "idf"))
        spark = docs.sparkSession
        place = {r["term"]: (r["idx"], r["idf"] if weighted else 1.0) for r in common.collect()}  # at most sent_terms
        held = spark.sparkContext.broadcast(place)

        def count(batches):
            known = held.value
            for frame in batches:
                for a in range(0, len(frame), COUNT_ROWS):
                    part, rows = frame.iloc[a : a + COUNT_ROWS], []
                    for text in part["t"]:
                        own = Counter(text.split())
                        usual = sorted((known[t][0], n * known[t][1]) for t, n in own.items() if t in known)
                        other = [(t, n) for t, n in own.items() if t not in known]
                        rows.append(([i for i, _ in usual], [w for _, w in usual], [t for t, _ in other], [n for _, n in other]))
                    yield pd.DataFrame(rows, columns=["at", "w", "rare", "n"]).assign(id=part["id"].to_numpy())

        kind = docs.schema["id"].dataType.simpleString()
        rows = docs.select("id", F.array_join(tokens("document", self.stop_words), " ").alias("t")).mapInPandas(
            count, f"id {kind}, at array<int>, w array<double>, rare array<string>, n array<long>")
        rows = cut(rows.withColumn("place", F.monotonically_increasing_id()))
        spread = rows.select("place", F.inline(F.arrays_zip(F.col("rare").alias("term"), F.col("n").alias("n"))))
        value = F.col("n") * F.col("idf") if weighted else F.col("n").cast("double")
        rest = self.vocabulary.filter(F.col("df") < F.lit(cutoff)).select("term", "idx", "idf")
        cells = spread.join(rest, "term").groupBy("place").agg(F.collect_list(
            F.struct("term", F.col("idx").cast("int").alias("idx"), value.alias("w"))).alias("cells"))
        return rows.select("place", "id", "at", "w").join(cells, "place", "left").drop("place"), common

    def _counts_in_place(self, docs: DataFrame, weighted: bool = False) -> DataFrame:
        """Counts by the whole vocabulary, which is sent at once; a Java model would take it term by term."""
        size = self.n_terms
        held = docs.sparkSession.sparkContext.broadcast({t: i for i, t in enumerate(self.terms)})
        scale = docs.sparkSession.sparkContext.broadcast(np.array(self.idf) if weighted else None)

        @F.pandas_udf("at array<int>, w array<double>")
        def count(texts: pd.Series) -> pd.DataFrame:
            known, at, w = held.value, [], []
            for text in texts:
                own = Counter(map(known.get, text.split()))
                own.pop(None, None)  # terms that were pruned
                index = np.fromiter(own, np.int32, len(own))
                order = np.argsort(index)
                index, n = index[order], np.fromiter(own.values(), float, len(own))[order]
                at.append(index)
                w.append(n * scale.value[index] if weighted else n)
            return pd.DataFrame({"at": at, "w": w})

        def pack(at: list, w: list) -> SparseVector:
            return SparseVector(size, at, w)

        rows = docs.select("id", count(F.array_join(tokens("document", self.stop_words), " ")).alias("c"))
        return rows.select("id", F.udf(pack, VectorUDT())("c.at", "c.w").alias("features"))

    def _counts_by_join(self, docs: DataFrame, weighted: bool = False) -> DataFrame:
        size = self.n_terms
        rows, _ = self._cells_in_place(docs, weighted)

        def pack(at: list, w: list, rare: list | None, rare_w: list | None) -> SparseVector:
            index = np.array(at + (rare or []), dtype=np.int32)
            order = np.argsort(index)
            return SparseVector(size, index[order], np.array(w + (rare_w or []), dtype=float)[order])

        packed = F.udf(pack, VectorUDT())("at", "w", "cells.idx", "cells.w")  # a function on Arrow batches cannot return vectors
        return rows.select("id", packed.alias("features"))


def fit_tfidf(
    docs: DataFrame,
    min_df: int | float = 1,
    max_df: int | float = 1.0,
    stop_words: str | Iterable[str] | None = None,
    broadcast_terms: int = BROADCAST_TERMS,
) -> TfidfModel:
    """Learn the vocabulary of ``docs (id, document)``."""
    spark = docs.sparkSession
    n = docs.count()
    kept = cut(prune_terms(document_frequency(docs, stop_words), n, min_df, max_df))
    n_terms = kept.count()
    if n_terms == 0:
        raise ValueError("no terms remain after pruning: lower min_df or raise max_df")
    weighted = kept.withColumn("idf", smooth_idf(F.col("df"), n))
    if n_terms > broadcast_terms:
        indexed = with_sorted_index(weighted, "term").select("term", "idx", "df", "idf")
        return TfidfModel(n, n_terms, stop_words, cut(indexed), sent_terms=broadcast_terms)
    rows = sorted(weighted.collect(), key=lambda r: r["term"])
    table = spark.createDataFrame(
        [(r["term"], i, r["df"], r["idf"]) for i, r in enumerate(rows)],
        "term string, idx long, df long, idf double",
    )
    return TfidfModel(
        n, n_terms, stop_words, table, [r["term"] for r in rows], [r["idf"] for r in rows]
    )


def matrix_shape(features: DataFrame) -> DataFrame:
    """One row ``(n_rows, n_features, nnz, density)`` of a sparse or dense vector column."""
    raw = features.select(F.unwrap_udt(F.col("features")).alias("v"))
    width = F.coalesce(F.col("v.size"), F.size("v.values"))
    nnz = F.aggregate(
        F.col("v.values"), F.lit(0).cast("long"),
        lambda s, x: s + F.when(x != 0.0, F.lit(1)).otherwise(F.lit(0)),
    )
    return (
        raw.agg(
            F.count(F.lit(1)).alias("n_rows"),
            F.max(width).cast("long").alias("n_features"),
            F.sum(nnz).alias("nnz"),
        )
        .withColumn(
            "density",
            F.col("nnz") / (F.col("n_rows").cast("double") * F.col("n_features")),
        )
    )


def matrix_window(features: DataFrame, n_rows: int = 100, n_features: int = 1000) -> DataFrame:
    """``(row, idx, value)`` of the first rows by id and the first features, zeros included.

    The row limit comes before anything is made dense; ``row`` is the 0-based position.
    """
    first = features.orderBy("id").limit(n_rows)
    ids = [r["id"] for r in first.select("id").collect()]  # at most n_rows
    spark = features.sparkSession
    position = spark.createDataFrame(
        [(v, i) for i, v in enumerate(ids)] or [(None, None)], "id long, row int"
    )
    cells = dense_entries(first.select("id", "features")).filter(F.col("idx") < n_features)
    return cells.join(F.broadcast(position), "id").select("row", "idx", F.col("w").alias("value"))
