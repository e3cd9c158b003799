"""Vectors from tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vecspark.operators.order import argsort


def from_table(df: DataFrame, order: str, val: str, *more: str, width: int = 1 << 16) -> DataFrame:
    """(idx, val, *more): the rows of df numbered from 0 in the ascending order of the column `order`, nulls first.

    order should hold each value once; rows that share one are numbered next to each other in the order of val.
    """
    keys = df.groupBy(F.col(order).alias("val")).agg(F.count(F.lit(1)).alias("n")).withColumn("idx", F.lit(0).cast("long"))
    first = argsort(keys, width).select(F.col("pos").alias("_pos"), F.col("val").alias("_key"))
    ahead = first.join(keys.select(F.col("val").alias("_k"), "n"), F.col("_key").eqNullSafe(F.col("_k"))).select("_pos", "_key", "n")
    cut = ahead.withColumn("_blk", F.expr(f"_pos div {int(width)}"))
    totals = cut.groupBy("_blk").agg(F.sum("n").alias("_t"))
    before = Window.orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)  # one row a block
    carry = totals.select(F.col("_blk").alias("_of"), F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_carry"))
    inside = F.sum("n").over(Window.partitionBy("_blk").orderBy("_pos").rowsBetween(Window.unboundedPreceding, -1))
    starts = cut.withColumn("_in", F.coalesce(inside, F.lit(0))).join(carry, F.col("_blk") == F.col("_of")).select("_key", (F.col("_carry") + F.col("_in")).alias("_start"))
    turn = F.row_number().over(Window.partitionBy(order).orderBy(val)) - 1
    out = df.withColumn("_turn", turn).join(starts, F.col(order).eqNullSafe(F.col("_key")))
    return out.select((F.col("_start") + F.col("_turn")).cast("long").alias("idx"), F.col(val).alias("val"), *more)


def from_array_column(df: DataFrame, row: str, array: str) -> DataFrame:
    """(row, col, val) from a column of arrays: one row of a matrix each. Null and empty arrays give nothing."""
    out = df.select(F.col(row).alias("row"), F.posexplode(F.col(array)).alias("col", "val"))
    return out.select("row", F.col("col").cast("long").alias("col"), "val")
