import math

import numpy as np
import pytest
from pyspark.ml.feature import CountVectorizerModel, StopWordsRemover
from pyspark.sql import functions as F

from gatherum.functions import text
from gatherum.functions.sampling import hash_sample
from gatherum.operators import corpus, tfidf
from gatherum.operators.embed import HashedTokenEncoder, embed
from gatherum.operators.joins import lookup_join, with_sorted_index


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "id long, document string")


def test_stop_list_is_sparks(spark):
    assert set(text.ENGLISH_STOP_WORDS) == set(StopWordsRemover.loadDefaultStopWords("english"))
    assert "ll" in text.stop_terms("english")
    with pytest.raises(ValueError):
        text.stop_terms("klingon")


def test_tokens_are_runs_of_two(spark):
    row = docs(spark, "a b cd Ébène_9", "").select(text.tokens("document").alias("t")).collect()
    assert row[0]["t"] == ["cd", "ébène_9"] and row[1]["t"] == []


def test_clean_text(spark):
    post = "From: x\nSubject: y\n\nHello\n> quoted\nBob wrote:\nbody\n\n-- \nsig\n--\nBob"
    got = text.clean_text(docs(spark, post)).first()["document"]
    assert got == "Hello\nbody\n\n-- \nsig"
    none = text.clean_text(docs(spark, "no blank line"), ["headers"]).first()["document"]
    assert none == ""
    assert text.clean_text(docs(spark, "only"), ["footers"]).first()["document"] == "only"
    with pytest.raises(ValueError):
        text.clean_text(docs(spark, "x"), ["signature"])


def test_pruning_bounds_are_kept(spark):
    freq = spark.createDataFrame([("a1", 2), ("b1", 5), ("c1", 6), ("d1", 1)], "term string, df long")
    kept = {r["term"] for r in tfidf.prune_terms(freq, 10, 2, 0.5).collect()}
    assert kept == {"a1", "b1"}


def test_empty_document_keeps_a_zero_row(spark):
    d = docs(spark, "", "alpha beta", "alpha")
    x = {r["id"]: r["features"] for r in tfidf.fit_tfidf(d).transform(d).collect()}
    assert x[0].numNonzeros() == 0 and x[0].size == 2
    a, b = math.log(4 / 3) + 1, math.log(4 / 2) + 1
    assert x[1][0] == pytest.approx(a / math.hypot(a, b))
    assert x[2][0] == 1.0


def test_large_vocabulary_path_agrees(spark):
    d = docs(spark, "aa bb cc aa", "bb dd", "", "ee ee ff aa")
    small, large = tfidf.fit_tfidf(d), tfidf.fit_tfidf(d, broadcast_terms=1)
    assert large.terms is None
    def rows(m):
        return {(r["id"], r["term"], r["idx"], round(r["w"], 12)) for r in m.weights(d).collect()}

    assert rows(small) == rows(large)
    assert large.transform(d).count() == 4


@pytest.mark.parametrize("sent", [0, 1, 3])
def test_frequent_terms_stay_where_the_document_lies(spark, sent):
    """Rows of a vocabulary sent in part equal those of one sent whole, for repeated ids and empty texts too."""
    texts = ["aa bb aa cc", "bb", "dd ee bb", "", None, "ff aa gg", "aa aa bb zz"]
    d = spark.createDataFrame([(i % 5, t) for i, t in enumerate(texts)], "id long, document string").repartition(3)
    whole, part = tfidf.fit_tfidf(d), tfidf.fit_tfidf(d, broadcast_terms=sent)
    assert part.terms is None

    def rows(x):
        return sorted((r["id"], tuple(np.round(r["features"].toArray(), 12))) for r in x.collect())

    def triples(m):
        return sorted((r["id"], r["term"], r["idx"], round(r["w"], 12)) for r in m.weights(d).collect())

    assert rows(whole.transform(d)) == rows(part.transform(d))
    assert rows(whole.counts(d)) == rows(part.counts(d))
    assert triples(whole) == triples(part)


def test_no_terms_left_is_an_error(spark):
    with pytest.raises(ValueError):
        tfidf.fit_tfidf(docs(spark, "aa", "bb"), min_df=2)


def test_matrix_window_and_shape(spark):
    d = docs(spark, "aa bb", "bb")
    x = tfidf.fit_tfidf(d).transform(d)
    shape = tfidf.matrix_shape(x).first()
    assert (shape["n_rows"], shape["n_features"], shape["nnz"], shape["density"]) == (2, 2, 3, 0.75)
    cells = {(r["row"], r["idx"]): r["value"] for r in tfidf.matrix_window(x, 2, 1).collect()}
    assert set(cells) == {(0, 0), (1, 0)} and cells[(1, 0)] == 0.0


def test_limits(spark):
    d = docs(spark, "x", "y", "z")
    assert [r["id"] for r in corpus.limit_rows(d, 2).collect()] == [0, 1]
    assert corpus.limit_rows(d).count() == 3
    with pytest.raises(ValueError):
        corpus.limit_rows(d, -1)


def test_categories_are_numbered_by_name(spark):
    d = spark.createDataFrame([(1, "b"), (2, "a"), (3, "c")], "id long, category string")
    got = {r["id"]: r["label"] for r in corpus.filter_categories(d, ["c", "b"]).collect()}
    assert got == {1: 0, 3: 1}


def test_null_labels_are_no_group(spark):
    d = spark.createDataFrame([(1, "t", 0), (2, None, 0), (3, "t", None)],
                              "id long, document string, label int")
    assert [tuple(r) for r in corpus.label_counts(d).collect()] == [(0, 1)]


def test_sample_is_exact_and_ignores_partitioning(spark):
    d = spark.range(5000)
    a = {r["id"] for r in hash_sample(d, 200, 7).collect()}
    b = {r["id"] for r in hash_sample(d.repartition(13), 200, 7).collect()}
    assert len(a) == 200 and a == b
    assert hash_sample(d, 9000, 7).count() == 5000


def test_sorted_index(spark):
    d = spark.createDataFrame([(w,) for w in "pear fig apple kiwi".split()], "term string").repartition(3)
    got = {r["term"]: r["idx"] for r in with_sorted_index(d, "term").collect()}
    assert got == {"apple": 0, "fig": 1, "kiwi": 2, "pear": 3}


def test_hot_key_join_keeps_every_row(spark):
    big = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("key"))
    table = spark.range(0, 2990).select(F.col("id").alias("key"), (F.col("id") * 2).alias("v"))
    for how in ("inner", "left"):
        plain = big.join(table, "key", how)
        hot = lookup_join(big, table, "key", how, small_rows=0)
        assert hot.exceptAll(plain).count() == 0 and plain.exceptAll(hot).count() == 0


def test_embedding(spark):
    rows = {r["id"]: r["features"].toArray() for r in embed(docs(spark, "aa bb aa", "")).collect()}
    assert (rows[0] ** 2).sum() == pytest.approx(1.0) and not rows[1].any()
    assert HashedTokenEncoder(8)(["aa"]).shape == (1, 8)


def test_the_vocabulary_is_sent_at_once(spark, monkeypatch):
    """A Java model of the vocabulary costs the driver a call for each term."""
    def slow(*_, **__):
        raise AssertionError("term by term")

    monkeypatch.setattr(CountVectorizerModel, "from_vocabulary", slow)
    docs = spark.createDataFrame([(1, "red red blue"), (None, "blue green"), (3, None), (1 << 62, "red")], "id long, document string")
    model = tfidf.fit_tfidf(docs)
    rows = {r["id"]: r["features"].toArray().tolist() for r in model.counts(docs).collect()}
    assert rows == {1: [1, 0, 2], None: [1, 1, 0], 3: [0, 0, 0], 1 << 62: [0, 0, 1]}
