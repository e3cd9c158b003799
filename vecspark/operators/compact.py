"""Order-preserving compaction, filters and counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecspark.operators.scan import positions

_COMPARE = {"lt": "<", "gt": ">", "eq": "=", "le": "<=", "ge": ">=", "ne": "<>"}


def compare(op: str, pivot: float, val: str = "val") -> Column:
    """val <op> pivot with IEEE NaN: no comparison but ne holds."""
    c = F.expr(f"{val} {_COMPARE[op]} {pivot!r}")
    nan = F.isnan(F.col(val).cast("double"))
    return (c | nan) if op == "ne" else (c & ~nan)


def compress(df: DataFrame, keep: Column | None = None, block: int = 1 << 20, expect: int | None = None) -> DataFrame:
    """(pos, idx, val) of rows where keep (or mask) holds, pos dense from 0 in the order of idx.

    With expect, a different number of rows raises when the result is read.
    """
    keep = F.col("mask") if keep is None else keep
    out = positions(df.where(keep), F.lit(True), block)
    if expect is not None:
        n = df.agg(F.count_if(keep).alias("_n"))
        out = out.join(F.broadcast(n)).withColumn("pos", F.when(F.col("_n") == expect, F.col("pos")).otherwise(F.raise_error(F.lit(f"expected {expect} elements")).cast("long")))  # one row
    return out.select("pos", "idx", "val")


def where_compare(df: DataFrame, op: str, pivot: float) -> DataFrame:
    """(idx) of the elements that compare."""
    return df.where(compare(op, pivot)).select("idx")


def mask_compare(df: DataFrame, op: str, pivot: float) -> DataFrame:
    """(idx, mask): 1 where the element compares."""
    return df.select("idx", compare(op, pivot).cast("int").alias("mask"))


def count_if(df: DataFrame, op: str, pivot: float, block: int | None = None) -> DataFrame:
    """(n): how many elements compare; with block, (blk, n) for each block of positions."""
    if block is None:
        return df.agg(F.count_if(compare(op, pivot)).alias("n"))
    return df.groupBy(F.expr(f"idx div {int(block)}").alias("blk")).agg(F.count_if(compare(op, pivot)).alias("n"))
