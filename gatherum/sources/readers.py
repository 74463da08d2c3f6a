"""Corpus readers. All return ``(id long, document string, label int)``, label null if unknown.

Ids are a hash of the row's place of origin or its content, or a column of the file when one
is named: Spark rows have no position, so list order cannot be the identity.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gatherum.functions.text import clean_text
from gatherum.operators.corpus import filter_categories, limit_rows, select_corpus, union_splits
from gatherum.operators.joins import with_sorted_index
from gatherum.sources.records import read_csv

POST_SCHEMA = T.StructType(
    [
        T.StructField("post", T.StringType()),
        T.StructField("document", T.StringType()),
        T.StructField("category", T.StringType()),
    ]
)


def _finish(df: DataFrame, limit_to: int | None, id_col: str | None, order_col: str) -> DataFrame:
    if id_col is None:
        df = with_sorted_index(df, order_col, "id")
        id_col = "id"
    return limit_rows(select_corpus(df, id_col, "document", "label"), limit_to)


def read_news(
    spark: SparkSession,
    splits: Sequence[str],
    categories: Sequence[str] | None = None,
    clean: bool = False,
    limit_to: int | None = None,
    seed: int = 3,
    file_format: str = "text",
) -> DataFrame:
    """A labelled news collection stored as several splits, taken together and shuffled.

    ``text``: ``<split>/<category>/<post>``, one file per post. ``parquet``: columns ``post``,
    ``document``, ``category``. Labels number the kept categories by name. ``clean`` strips
    headers, footers and quotes. The ids are positions in the seeded order, so a limit takes a
    random subset.
    """
    parts = []
    for path in splits:
        if file_format == "text":
            raw = spark.read.text(f"{path.rstrip('/')}/*/*", wholetext=True)
            name = F.col("_metadata.file_path")
            part = raw.select(
                name.alias("post"),
                F.col("value").alias("document"),
                F.element_at(F.split(name, "/"), -2).alias("category"),
            )
        elif file_format == "parquet":
            part = spark.read.schema(POST_SCHEMA).parquet(path)
        else:
            raise ValueError(f"unknown format {file_format!r}: text or parquet")
        parts.append(part)
    posts = filter_categories(union_splits(*parts), categories)
    if clean:
        posts = clean_text(posts)
    keyed = posts.withColumn(
        "_order", F.concat_ws(":", F.md5(F.concat_ws(":", "post", F.lit(str(seed)))), "post")
    )
    return _finish(keyed, limit_to, None, "_order")


def read_labelled_csv(
    spark: SparkSession,
    path: str,
    limit_to: int | None = None,
    id_col: str | None = None,
) -> DataFrame:
    """A CSV with columns ``Text`` and ``Label``. Quoted fields may span lines, and one large file
    is read by many tasks; a row that does not fit is an error, an empty label null."""
    types: dict = {"Text": T.StringType(), "Label": T.IntegerType()}
    if id_col:
        types[id_col] = T.LongType()
    raw = read_csv(spark, path, types)
    return _finish(raw.withColumnsRenamed({"Text": "document", "Label": "label"}), limit_to, id_col, "_order")


def read_questions_jsonl(
    spark: SparkSession,
    path: str,
    limit_to: int | None = None,
    id_col: str | None = None,
) -> DataFrame:
    """JSON lines with a ``question`` field. Other fields are not read."""
    fields = [T.StructField("question", T.StringType())]
    if id_col:
        fields.insert(0, T.StructField(id_col, T.LongType()))
    raw = spark.read.schema(T.StructType(fields)).json(path)
    named = raw.withColumnRenamed("question", "document").withColumn(
        "label", F.lit(None).cast("int")
    )
    return _finish(_keyed(named), limit_to, id_col, "_order")


def _keyed(df: DataFrame) -> DataFrame:
    """File name, block start and row number in the block: the file's own order, per file."""
    return df.withColumn(
        "_order",
        F.struct(
            F.input_file_name().alias("file"),
            F.input_file_block_start().alias("start"),
            F.monotonically_increasing_id().alias("at"),
        ),
    )
