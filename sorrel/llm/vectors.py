"""What the operators on embeddings share: which vectors take part, and exact measures."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, embedding, dim) of the rows that take part; dim is the vector's length.

    A vector that is null, empty or zero, or that holds a null or non-finite component, takes no
    part, nor does one without an id. Vectors of different lengths have no product: operators
    compare those of one length only. Floats stay floats; other numbers become doubles.
    """
    kind = vectors.schema["embedding"].dataType.simpleString()
    e = F.col("embedding") if kind == "array<float>" else F.col("embedding").cast("array<double>")
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    label = F.col("label") if "label" in vectors.columns else F.lit(None)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), label.cast("string").alias("label"), e.alias("embedding"))
    return rows.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & fine).withColumn("dim", F.size("embedding"))


def matrix(column, width: int) -> np.ndarray:
    """A pandas column of lists as a matrix of doubles; shorter lists are followed by zeros."""
    out = np.zeros((len(column), width))
    for i, v in enumerate(column.to_numpy()):
        out[i, : len(v)] = v
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row inner products, added in the order of the components: equal vectors give equal results wherever they stand."""
    total = np.zeros(len(a))
    for k in range(a.shape[1]):
        total += a[:, k] * b[:, k]
    return total
