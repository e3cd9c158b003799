"""Sorting, top-k and stable splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vecspark.operators.scan import running, value_block, value_bounds


def argsort(df: DataFrame, width: int = 1 << 16, buckets: int = 1024) -> DataFrame:
    """(pos, val, idx): the stable ascending order of val, of any orderable number type; nulls first, NaN last.

    Approximate quantiles cut the values into blocks of about `width` rows, `buckets` of them at most; a value that is a
    quantile itself is a block of its own, cut by idx, so that a frequent value is many blocks. A row's position is the
    rows in the blocks before, of which only totals meet in one window, plus its rank in its block.
    """
    bounds = value_bounds(df, "val", width, buckets)
    at = value_block(F.col("val"), bounds)
    single = F.col("val").isNull() | (F.col("_b") % 2 == 1)
    cut = df.select("val", "idx", at.alias("_b")).withColumn("_c", F.when(single, F.expr(f"idx div {int(width)}")).otherwise(0))
    totals = cut.groupBy("_b", "_c").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_b", "_c").rowsBetween(Window.unboundedPreceding, -1)  # one row a block
    ahead = totals.select(F.col("_b").alias("_tb"), F.col("_c").alias("_tc"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_ahead"))
    rank = F.row_number().over(Window.partitionBy("_b", "_c").orderBy(F.col("val").asc_nulls_first(), "idx")) - 1
    both = cut.withColumn("_r", rank).join(ahead, (F.col("_b") == F.col("_tb")) & (F.col("_c") == F.col("_tc")))
    return both.select((F.col("_ahead") + F.col("_r")).cast("long").alias("pos"), "val", "idx")


def topk(df: DataFrame, k: int) -> DataFrame:
    """(idx, val) of the k largest values, ties to the lowest idx. More than there are rows raises nothing: all come."""
    return df.select("idx", "val").orderBy(F.desc("val"), "idx").limit(k)


def topk_pivot(df: DataFrame, k: int, block: int) -> DataFrame:
    """(blk, pivot): the k-th largest of each block of `block` positions, a lower bound of the vector's k-th largest.
    Blocks of fewer than k elements give none."""
    w = Window.partitionBy("blk").orderBy(F.desc("val"), "idx")
    cut = df.withColumn("blk", F.expr(f"idx div {int(block)}")).withColumn("_r", F.row_number().over(w))
    return cut.where(F.col("_r") == k).select("blk", F.col("val").alias("pivot"))


def split(df: DataFrame, zeros_first: bool = False, block: int = 1 << 20) -> DataFrame:
    """df with pos: rows with mask first (or last), each side in its order, by a scan of the mask instead of a sort."""
    lead = F.col("mask") != F.lit(zeros_first)
    first = running(df.withColumn("_m", lead.cast("int").cast("long")), "_m", "_z", block, exclusive=True)
    total = df.agg(F.coalesce(F.sum(lead.cast("int")), F.lit(0)).cast("long").alias("_n"))
    both = first.join(F.broadcast(total))  # one row
    return both.withColumn("pos", F.when(F.col("_m") == 1, F.col("_z")).otherwise(F.col("_n") + F.col("idx") - F.col("_z"))).drop("_m", "_z", "_n")


def bit_extract(df: DataFrame, bit: int) -> DataFrame:
    """(idx, bit): one bit of each value."""
    return df.select("idx", F.shiftright("val", bit).bitwiseAND(1).cast("int").alias("bit"))
