"""The training-data pipeline: five operators, each on what its predecessor kept.

Every stage takes documents with at least ``doc_id``, ``text`` and ``lang`` and hands all their
columns on; ``n_chars`` is kept right where it is there. An empty table goes through all stages.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gatherum.llm import decontaminate, language, near_dedup, pieces, substring_dedup
from gatherum.llm.common import small_batches
from gatherum.session import ensure_checkpoint_dir

#: Where the piece model is, and the least posterior of a language that counts as known.
PIECES = os.environ.get("PIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")
LEAST_SCORE = 0.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in one of the languages learned; null texts, texts without letters and undecided ones go.

    Needs a column ``lang`` to learn from; without a row that has one, every document goes.
    """
    small_batches(spark)
    model = language.train(docs, F.lit(True))
    judged = language.predict(docs, model, with_row=True)
    return judged.filter((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).select("row.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the least id of every group: five-word shingles, similarity 0.8 or more.

    Rows with one id stay or go together; rows with a null id stay.
    """
    small_batches(spark)
    judged = near_dedup.near_duplicates(docs, n=5, num=80, den=100)
    gone = judged.filter(~F.col("kept")).select(F.col("key").alias("doc_id")).distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages of 20 words or more that occur earlier; documents of which nothing is left go.

    Texts from which nothing is cut stay as they are, null and empty ones too.
    """
    small_batches(spark)
    judged = substring_dedup.remove_repeats(docs, with_text=True)
    kept = judged.filter((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_words")))
    return kept.select(*_counted(docs, F.col("kept_text"), lambda c: F.col(f"row.`{c}`")))


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts benchmark passages; documents that are half benchmark or more go. Null and empty texts stay."""
    small_batches(spark)
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.drop_hit_words(docs, items).select(*_counted(docs, F.col("text"), lambda c: F.col(f"`{c}`")))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document that is left; null for a null text, none for an empty one."""
    coded = pieces.encode(docs, PIECES, decoded=True)
    return coded.select(
        F.col("key").alias("doc_id"), F.size("ids").cast("long").alias("n_tokens"), "ids",
        F.col("decoded").eqNullSafe(F.col("text")).alias("round_trip"),
    )


def _counted(docs: DataFrame, text: Column, old: Callable[[str], Column]) -> list[Column]:
    """The columns of ``docs`` with another text and, if they hold one, the character count that goes with it."""
    new = {"text": text}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.char_length(text).cast(docs.schema["n_chars"].dataType)
    return [(new[c] if c in new else old(c)).alias(c) for c in docs.columns]


STAGES = [
    ("language ID", identify_language),
    ("MinHash near-dedup", drop_near_copies),
    ("substring dedup", cut_repeats),
    ("benchmark decontamination", decontaminate_benchmark),
    ("SentencePiece encoding", encode_pieces),
]

ORACLE_SQL = None  # signatures, context trees and merges are not SQL; tests compare with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is stored in the shared folder and read again."""
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
    return docs
