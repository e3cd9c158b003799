"""Elementwise operators, differences and padding."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def vadd(x: DataFrame, y: DataFrame) -> DataFrame:
    """(idx, z): sum of two vectors by position."""
    return x.join(y.select("idx", F.col("val").alias("_y")), "idx").select("idx", (F.col("val") + F.col("_y")).alias("z"))


def diff(df: DataFrame, max_size: int = 0, fill: bool = True) -> DataFrame:
    """(idx, z): each element less the one before, by an equi-join on positions. The first keeps its value, or is left
    out with fill=False; max_size > 0 stops there."""
    x = df.where(F.col("idx") < max_size) if max_size else df
    prior = x.select((F.col("idx") + 1).alias("idx"), F.col("val").alias("_p"))
    both = x.join(prior, "idx", "left" if fill else "inner")
    return both.select("idx", (F.col("val") - F.coalesce("_p", F.lit(0))).alias("z"))


def pad_tail(df: DataFrame, align: int, n: int) -> DataFrame:
    """(idx, val) of length align: the unaligned end of a vector of n, then zeros."""
    tail = df.where(F.col("idx") >= n // align * align).select((F.col("idx") - n // align * align).alias("idx"), "val")
    return _filled(tail, align)


def pad_zero(df: DataFrame, align: int, n: int) -> DataFrame:
    """(idx, val): the vector with zeros up to a multiple of align."""
    return _filled(df.select("idx", "val"), -(-n // align) * align)


def _filled(df: DataFrame, n: int) -> DataFrame:
    return df.sparkSession.range(n).withColumnRenamed("id", "idx").join(df, "idx", "left").select("idx", F.coalesce("val", F.lit(0)).alias("val"))


def pad_batch(df: DataFrame, width: int, col: str = "vec") -> DataFrame:
    """Arrays of col with zeros up to width."""
    return df.withColumn(col, F.concat(F.col(col), F.array_repeat(F.lit(0).cast("long"), F.greatest(F.lit(0), F.lit(width) - F.size(col)))))


def unpad_batch(df: DataFrame, width: int, col: str = "vec") -> DataFrame:
    """Arrays of col cut to width."""
    return df.withColumn(col, F.slice(col, 1, width))
