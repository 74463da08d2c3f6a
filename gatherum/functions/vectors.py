"""Vector expressions over dense arrays and MLlib vectors."""

from __future__ import annotations

from pyspark.ml.feature import Normalizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

__all__ = [
    "array_to_vector",
    "dense_entries",
    "from_arrays",
    "l2_normalise",
    "l2_normalise_array",
    "sparse_entries",
    "squared_norm",
    "vector_to_array",
]


def from_arrays(df: DataFrame, id_col: str, array_col: str, *keep: str) -> DataFrame:
    """``(id, features)`` plus ``keep`` from a table holding an array column of numbers."""
    return df.select(
        F.col(id_col).cast("long").alias("id"),
        array_to_vector(F.col(array_col).cast("array<double>")).alias("features"),
        *keep,
    )


def squared_norm(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, v: s + v * v)


def l2_normalise_array(a: Column) -> Column:
    """The array at unit length; an all-zero array stays as it is."""
    # the norm is a variable of its own: inside the inner lambda it would be worked out for every entry
    unit = F.transform(
        F.array(F.sqrt(squared_norm(a))), lambda norm: F.when(norm > 0, F.transform(a, lambda v: v / norm)).otherwise(a))
    return unit[0]


def l2_normalise(df: DataFrame, column: str = "features") -> DataFrame:
    """Rows at unit length (MLlib vectors, sparse or dense); zero rows stay zero."""
    scaled = Normalizer(inputCol=column, outputCol="_unit", p=2.0).transform(df)
    return scaled.withColumn(column, F.col("_unit")).drop("_unit")


def sparse_entries(df: DataFrame, column: str = "features") -> DataFrame:
    """``(id, idx, w)`` triples of a sparse vector column, without a shuffle."""
    raw = df.select("id", F.unwrap_udt(F.col(column)).alias("v"))
    return raw.select(
        "id", F.inline(F.arrays_zip(F.col("v.indices").alias("idx"), F.col("v.values").alias("w")))
    ).toDF("id", "idx", "w")


def dense_entries(df: DataFrame, column: str = "features") -> DataFrame:
    """``(id, idx, w)`` triples of every cell of a vector column, zeros included."""
    return df.select("id", F.posexplode(vector_to_array(F.col(column)))).toDF("id", "idx", "w")
