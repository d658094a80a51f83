"""Vectors shared by the embedding operators: which take part, and blocks of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(embedding: Column) -> Column:
    """A vector with components, none of them NULL, NaN or infinite."""
    x = embedding.cast("array<double>")
    fine = F.forall(x, lambda v: F.coalesce(F.abs(v) < float("inf"), F.lit(False)) & ~F.isnan(F.coalesce(v, F.lit(0.0))))
    return F.coalesce(fine & (F.size(x) > 0), F.lit(False))


def read_vectors(vectors: DataFrame, id_col: str, vector_col: str, *more: Column) -> DataFrame:
    return vectors.select(F.col(id_col).cast("long").alias("vec_id"),
                          F.col(vector_col).cast("array<double>").alias("embedding"), *more)
