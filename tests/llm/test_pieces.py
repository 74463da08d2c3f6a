import random

import pytest
import sentencepiece
from pyspark.sql import functions as F

from gatherum.llm import pieces, queries
from gatherum.llm.queries import PIECES

TEXTS = [
    "The quick brown fox", "  lead", "a  b\n c ", " ", "", None, "\n", "x\n\n y \n", "▁a▁▁b", "naïve café ①漢字 🙂",
    "\ttab\tand　wide", "z" * 150 + " end", "hello world " * 40, "   \n   x", "the the the", "don't (stop)!!", "a\x00b",
]


@pytest.fixture(scope="module")
def encoded(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)) + [(3, "same id")], "doc_id long, text string")
    docs = docs.withColumn("ids", F.lit("clash")).withColumn("chunk", F.lit(1))
    coded = pieces.decode(pieces.encode(docs, PIECES, chunk_bytes=200), PIECES)
    return {(r["key"], r["text"]): r for r in coded.collect()}


def test_ids_are_the_library_s(encoded):
    own = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for i, text in enumerate(TEXTS):
        assert encoded[(i, text)]["ids"] == (None if text is None else own.encode(text)), repr(text)
    assert (3, "same id") in encoded


def test_round_trip(encoded):
    for (_, text), row in encoded.items():
        assert row["decoded"] == (None if text is None else text.replace("▁", " "))


def test_documents_of_the_table(spark):
    own = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for row in pieces.encode(docs, PIECES).collect():
        assert row["ids"] == own.encode(row["text"])


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert pieces.encode(empty, PIECES).count() == 0
    assert pieces.decode(pieces.encode(empty, PIECES, decoded=True), PIECES).count() == 0


def test_random_texts_and_decoding_on_the_way(spark):
    rng = random.Random(8)
    some = ["the", "inter", "nation", "al", "s", " ", "  ", "\n", ".", "...", "==", "é", "漢", "🙂", "ing", "THE", "0", "1984", "▁", "\t", "-", "aa"]
    texts = ["".join(rng.choice(some) for _ in range(rng.randint(0, 60))) for _ in range(300)]
    texts += ["".join(rng.choice("abcdefghinorst") for _ in range(n)) for n in (57, 58, 59, 60, 61, 200)] + [None, "a" * 59, "aa" * 200]
    own = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    for chunk_bytes in (1 << 23, 900):
        rows = pieces.encode(docs, PIECES, chunk_bytes=chunk_bytes, decoded=True).collect()
        assert len(rows) == len(texts)
        for row in rows:
            text = texts[row["key"]]
            assert row["ids"] == (None if text is None else own.encode(text)), repr(text)
            assert row["decoded"] == (None if text is None else text.replace("▁", " "))


def test_registered_query(spark):
    table = queries.op7_pieces(spark, "/root/testdata/sf0.001")
    assert dict(table.dtypes) == {"doc_id": "bigint", "n_tokens": "bigint", "ids_xxh64": "bigint", "round_trip": "boolean"}
    rows = table.collect()
    assert len(rows) == 200 and all(r["round_trip"] for r in rows)


def test_a_model_out_of_order_is_refused():
    model = pieces.Model(PIECES)
    assert model.merges("the") == (1, model.rank["the"])
    model.rank = {"ab": 1.0, "abc": 0.5, "bc": 2.0}
    assert model.merges("abc") != (1, 0.5)
