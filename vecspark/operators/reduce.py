"""Tiled reductions and histograms."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def reduce_tiles(df: DataFrame, tile: int, blocks: int, n: int) -> DataFrame:
    """(blk, total): exactly `blocks` sums of tile * ceil(ceil(n / tile) / blocks) elements; empty ones give 0."""
    length = tile * -(-(-(-n // tile)) // blocks) or 1
    sums = df.groupBy(F.expr(f"idx div {length}").alias("blk")).agg(F.sum("val").alias("total"))
    every = df.sparkSession.range(blocks).withColumnRenamed("id", "blk")
    return every.join(sums, "blk", "left").select("blk", F.coalesce("total", F.lit(0)).alias("total"))


def complete_blocks(df: DataFrame, sums: DataFrame, length: int) -> DataFrame:
    """(idx, z): adds to each block of `length` the sums (blk, s) of the blocks before it."""
    w = Window.orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)
    off = sums.select("blk", F.coalesce(F.sum("s").over(w), F.lit(0)).alias("off"))  # one row a block
    return df.withColumn("blk", F.expr(f"idx div {int(length)}")).join(off, "blk").select("idx", (F.col("val") + F.col("off")).alias("z"))


def complete_rows(df: DataFrame, sums: DataFrame, width: int, height: int) -> DataFrame:
    """(idx, z): turns row scans of `width` into a scan: the last values of earlier rows of the block of `height` rows,
    and the sums of earlier blocks, are added."""
    cut = df.withColumn("row", F.expr(f"idx div {int(width)}"))
    last = cut.groupBy("row").agg(F.max(F.struct("idx", "val"))["val"].alias("last")).withColumn("blk", F.expr(f"row div {int(height)}"))
    w = Window.partitionBy("blk").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    carry = last.select("row", "blk", F.coalesce(F.sum("last").over(w), F.lit(0)).alias("carry"))
    b = Window.orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)
    off = sums.select("blk", F.coalesce(F.sum("s").over(b), F.lit(0)).alias("off"))
    return cut.join(carry.join(off, "blk"), "row").select("idx", (F.col("val") + F.col("carry") + F.col("off")).alias("z"))


def histogram(df: DataFrame, bins: int) -> DataFrame:
    """(bin, n): equal bins over [min, max], the last with max; all in the last if min = max."""
    ends = df.agg(F.min("val").alias("lo"), F.max("val").alias("hi"))
    v = df.join(F.broadcast(ends))  # one row
    at = F.when(F.col("hi") == F.col("lo"), bins - 1).otherwise(F.least(F.expr(f"cast(floor((val - lo) * {int(bins)} / (hi - lo)) as int)"), F.lit(bins - 1)))
    n = v.groupBy(at.cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return df.sparkSession.range(bins).withColumnRenamed("id", "bin").join(n, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))
