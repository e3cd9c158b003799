"""Positional lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vecspark.operators.scan import value_block, value_bounds


def gather(idxs: DataFrame, values: DataFrame) -> DataFrame:
    """(idx, z): values (pos, val) at idxs (idx, pos). Positions out of bounds raise."""
    both = idxs.join(values, "pos", "left")
    return both.select("idx", F.coalesce(F.col("val"), F.raise_error(F.concat(F.lit("position out of bounds: "), F.col("pos").cast("string"))).cast("long")).alias("z"))


def gather_minus_one(idxs: DataFrame, values: DataFrame) -> DataFrame:
    """(idx, z): the value before position pos, and 0 at position 0."""
    v = values.select((F.col("pos") + 1).alias("pos"), "val")
    return idxs.join(v, "pos", "left").select("idx", F.when(F.col("pos") == 0, 0).otherwise(F.col("val")).cast("long").alias("z"))


def searchsorted(hay: DataFrame, needles: DataFrame, width: int = 1 << 16) -> DataFrame:
    """(needle_id, pos): how many keys of hay (key) are below each needle (needle_id, needle); any orderable number type.

    Keys and needles meet as one row per distinct value, so a frequent value weighs no more than a rare one; a running
    count over blocks of values, cut at approximate quantiles, does the rest. Null keys are below nothing, a null needle
    has none below.
    """
    keys = hay.where("key IS NOT NULL").groupBy(F.col("key").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    values = keys.unionByName(needles.where("needle IS NOT NULL").select(F.col("needle").alias("v"), F.lit(0).cast("long").alias("n"))).groupBy("v").agg(F.sum("n").alias("n"))
    cut = values.withColumn("_b", value_block(F.col("v"), value_bounds(hay, "key", width)))
    before = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    totals = cut.groupBy("_b").agg(F.sum("n").alias("_n"))
    ahead = totals.select(F.col("_b").alias("_t"), F.coalesce(F.sum("_n").over(before().orderBy("_b")), F.lit(0)).alias("_ahead"))  # one row a block
    inside = F.coalesce(F.sum("n").over(before("_b").orderBy("v")), F.lit(0))
    below = cut.withColumn("_in", inside).join(ahead, F.col("_b") == F.col("_t")).select("v", (F.col("_ahead") + F.col("_in")).alias("pos"))
    return needles.join(below, F.col("needle") == F.col("v"), "left").select("needle_id", F.coalesce("pos", F.lit(0)).cast("long").alias("pos"))
