"""Small triangular inverses and products."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def gen_lower(spark: SparkSession, n: int) -> DataFrame:
    """(i, j, val): lower triangle of ones with the diagonal; columns are exploded inside each row."""
    j = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("j")
    return spark.range(n).select(F.col("id").alias("i"), j).select("i", "j", (F.col("i") >= F.col("j")).cast("int").alias("val"))


def _column_sweep(u: np.ndarray) -> np.ndarray:
    """Inverse of I + u for strictly upper u of shape (batch, n, n), one column at a time."""
    n = u.shape[1]
    inv = np.broadcast_to(np.eye(n, dtype=u.dtype), u.shape).copy()
    for j in range(n - 1, -1, -1):
        inv[:, :j, :] -= u[:, :j, j, None] * inv[:, j, None, :]
    return inv


def tri_inverse(matrices: DataFrame, n: int, exact: bool = False) -> DataFrame:
    """(b, i, j, val) from (b, m): inverses of unit upper triangular n x n matrices given as row-major arrays.

    What stands on and below the diagonal is not looked at. exact: in 64-bit integers, else in doubles. Matrices are
    inverted a batch at a time where they lie; nothing is shuffled.
    """
    kind = np.int64 if exact else np.float64

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                u = np.triu(np.stack(pdf["m"].to_numpy()).reshape(-1, n, n).astype(kind), 1)
                inv = _column_sweep(u)
                b = np.repeat(pdf["b"].to_numpy(), n * n)
                i, j = (np.tile(x.ravel(), len(pdf)) for x in np.indices((n, n)))
                yield pd.DataFrame({"b": b, "i": i, "j": j, "val": inv.ravel()})

    return matrices.select("b", "m").mapInPandas(run, f"b long, i long, j long, val {'long' if exact else 'double'}")


def matmul_abt(a: DataFrame, b: DataFrame) -> DataFrame:
    """(i, j, val): A times B transposed, both as (row, k, val); partial sums come before the shuffle."""
    x = a.select(F.col("row").alias("i"), "k", F.col("val").alias("u"))
    y = b.select(F.col("row").alias("j"), "k", F.col("val").alias("w"))
    return x.join(y, "k").groupBy("i", "j").agg(F.sum(F.col("u") * F.col("w")).alias("val"))
