"""The registered queries of the training-data operators, over whole tables, and their SQL."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from gatherum.llm import boosting, decontaminate, language, licenses, near_dedup, oracles, pieces, quality, runs, shards, substring_dedup, toxicity, url_filter, whitening
from gatherum.llm.common import held_out


#: Where the public tokenizer files are; a parameter of the operators.
PIECES = os.environ.get("PIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables label documents, not pages: the label of the same number is the page's outcome."""
    outcomes = _table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("page_id"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("int").alias("bad")
    )
    return url_filter.judge(_table(spark, sf_dir, "pages"), outcomes)


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring_dedup.remove_repeats(docs).select("row.doc_id", "n_words", "n_removed", "kept_sha256")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    net = toxicity.train(docs, _table(spark, sf_dir, "labels"), ~held_out("doc_id", 5, 0))
    return toxicity.score(docs, net).select(
        F.col("key").alias("doc_id"), held_out("key", 5, 0).alias("held_out"), "score", "predicted"
    )


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return near_dedup.near_duplicates(docs, n=3, num=85, den=100).withColumnRenamed("key", "doc_id")


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = language.train(docs, ~held_out("doc_id", 3, 1))
    return language.predict(docs, model).select(
        F.col("key").alias("doc_id"), held_out("key", 3, 1).alias("held_out"), "lang_pred", "score"
    )


def op7_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = pieces.encode(_table(spark, sf_dir, "documents"), PIECES, decoded=True)
    return coded.select(
        F.col("key").alias("doc_id"), F.size("ids").cast("long").alias("n_tokens"),
        F.xxhash64("ids").alias("ids_xxh64"), F.col("decoded").eqNullSafe(F.col("text")).alias("round_trip"),
    )


def op8_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.assign(_table(spark, sf_dir, "documents")).select(
        F.col("key").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents")).select(
        F.col("key").alias("doc_id"), F.size("sentence_ids").cast("long").alias("n_sentences"),
        F.array_join("sentence_ids", ",").alias("sentence_ids"), F.array_join("licenses", ",").alias("licenses"),
    )


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(_table(spark, sf_dir, "documents"))
    return judged.select(
        F.col("key").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines",
        "n_repeat_words", "base_failed", "kept",
    )


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings")
    found = whitening.fit(rows)
    whitened = whitening.whiten(rows, found)
    values, n, trace = (found.values.tolist(), found.n, found.trace) if found else ([], 0, 1.0)
    share = F.array(*[F.lit(v / trace) for v in values]).cast("array<double>")
    return whitened.select("key", "deviation", F.posexplode("whitened").alias("at", "whitened")).select(
        F.col("key").alias("vec_id"), (F.col("at") + 1).alias("component"), F.lit(n).cast("long").alias("n"),
        F.col("deviation").try_cast("long").alias("deviation"), "whitened", F.get(share, F.col("at")).alias("explained"),
        F.lit(whitening.identity_error(whitened, len(values))).alias("identity_error"),
    )


def op12_boosting(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    trees = boosting.train(docs, _table(spark, sf_dir, "labels"), ~held_out("doc_id", 5, 0))
    return boosting.score(docs, trees).select(
        F.col("key").alias("doc_id"), held_out("key", 5, 0).alias("held_out"), "score", "predicted"
    )


def _with_periodic_tails(docs: DataFrame) -> DataFrame:
    """``(doc_id, text)``: in every tenth document by crc32 of the id, the words from some place on repeat."""
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.filter(F.split(F.col("text").cast("string"), r"[\x20\x09-\x0D]+", -1), lambda w: w != "")
    chosen = docs.select("doc_id", "text", h.alias("h")).withColumn("words", F.when(F.col("h") % 10 == 0, words))
    n, g = F.col("n").cast("long"), F.floor(F.col("h") / 10)
    placed = (
        chosen.withColumn("n", F.size("words"))
        .withColumn("a", F.when(F.col("n") > 0, g % n))
        .withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + g % 8)))
    )
    a, p = F.col("a").cast("int"), F.col("p").cast("int")
    tail = F.flatten(F.array_repeat(F.slice("words", a + 1, p), 11))  # 3 + 7 periods and a part at most
    planted = F.array_join(F.slice(F.concat(F.slice("words", 1, a), tail), 1, F.col("n")), " ")
    return placed.select("doc_id", F.when(F.col("a").isNotNull(), planted).otherwise(F.col("text")).alias("text"))


def op13_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.find(_with_periodic_tails(_table(spark, sf_dir, "documents")))
    listed = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    stronger = lambda best, r: F.when(  # noqa: E731  runs come by start, then period, so the first of equals stays
        best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r
    ).otherwise(best)
    best = F.aggregate("runs", F.lit(None).cast(runs.RUN), stronger)
    return found.withColumn("best", best).select(
        F.col("key").alias("doc_id"), F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(listed, F.lit("\n"))).otherwise(""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


QUERIES = {f.__name__: f for f in (op1_decontaminate, op2_url_filter, op3_substring_dedup, op4_toxicity, op5_near_dedup, op6_language, op7_pieces, op8_shards, op9_licenses, op10_quality, op11_whitening, op12_boosting, op13_runs)}
QUERIES["pipeline"] = corpus_pipeline.run

ORACLES: dict[str, str] = dict(oracles.ORACLES)
