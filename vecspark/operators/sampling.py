"""Nucleus (top-p) selection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecspark.operators.order import argsort
from vecspark.operators.scan import running


def top_p(df: DataFrame, p: float, block: int = 1 << 20) -> DataFrame:
    """(pos, idx, val, before): the least set of largest weights whose sum exceeds p of the total.

    val: non-negative weights, counts or probabilities; null counts as 0. Largest first, ties to the lowest idx; before:
    the kept weight ahead of a row.
    """
    df = df.select("idx", F.coalesce("val", F.lit(0)).alias("val"))
    down = argsort(df.select("idx", (-F.col("val")).alias("val"))).select("pos", "idx", (-F.col("val")).alias("val"))
    ahead = running(down, "val", "before", block, idx="pos", exclusive=True)
    total = df.agg(F.sum("val").alias("_t"))
    return ahead.join(F.broadcast(total)).where(F.col("before") <= F.lit(p) * F.col("_t")).drop("_t")  # one row


def top_p_sample(df: DataFrame, p: float, u: float) -> DataFrame:
    """(idx): the kept element that holds the share u, in [0, 1), of the kept weight."""
    kept = top_p(df, p)
    total = kept.agg(F.sum("val").alias("_k"))
    at = F.lit(u) * F.col("_k")
    return kept.join(F.broadcast(total)).where((F.col("before") <= at) & (at < F.col("before") + F.col("val"))).select("idx")  # one row
