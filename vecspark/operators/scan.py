"""Prefix sums over (idx, val) vectors, and the two-level scan that other operators build on."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_AGG = {"sum": F.sum, "max": F.max, "min": F.min}
_TOP = 1 << 14  # block totals that one window takes; more are scanned by levels in turn


def running(df: DataFrame, val: str, out: str, block: int, idx: str = "idx", ties: Sequence[str] = (), op: str = "sum", exclusive: bool = False, depth: int = 1) -> DataFrame:
    """df with `out`, the running `op` of val in the order of (idx, *ties).

    Blocks idx div block are scanned on their own; the running op of the block totals is joined back. Only the totals,
    one row a block, meet in one window; with depth > 1 they are scanned by blocks of 2**14 first. idx is any
    non-negative integer.
    """
    add = _AGG[op]
    blk, within, of, carried = (f"_{x}{depth}" for x in ("blk", "in", "of", "carry"))
    cut = df.withColumn(blk, F.expr(f"{idx} div {int(block)}"))
    inside = Window.partitionBy(blk).orderBy(idx, *ties).rowsBetween(Window.unboundedPreceding, -1 if exclusive else 0)
    totals = cut.groupBy(blk).agg(add(val).alias("_total"))
    if depth > 1:
        carry = running(totals, "_total", carried, _TOP, idx=blk, op=op, exclusive=True, depth=depth - 1).select(F.col(blk).alias(of), carried)
    else:
        before = Window.orderBy(blk).rowsBetween(Window.unboundedPreceding, -1)
        carry = totals.select(F.col(blk).alias(of), add("_total").over(before).alias(carried))
    both = cut.withColumn(within, add(val).over(inside)).join(carry, F.col(blk) == F.col(of))
    if op == "sum":
        z = F.coalesce(within, F.lit(0)) + F.coalesce(carried, F.lit(0))
    else:
        z = (F.greatest if op == "max" else F.least)(within, carried)
    return both.withColumn(out, z).drop(blk, within, of, carried)


def scan(df: DataFrame, block: int | None = 1 << 20, start: int = 0, exclusive: bool = False, depth: int = 1) -> DataFrame:
    """(idx, z): start plus the prefix sum of val. block=None: one global window, quicker below about a million rows."""
    if block is None:
        w = Window.orderBy("idx").rowsBetween(Window.unboundedPreceding, -1 if exclusive else 0)
        return df.select("idx", (F.coalesce(F.sum("val").over(w), F.lit(0)) + start).alias("z"))
    return running(df.select("idx", "val"), "val", "z", block, exclusive=exclusive, depth=depth).select("idx", (F.col("z") + start).alias("z"))


def block_scan(df: DataFrame, length: int) -> DataFrame:
    """(idx, z): prefix sums that start anew at each multiple of length."""
    w = Window.partitionBy(F.expr(f"idx div {int(length)}")).orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    return df.select("idx", F.sum("val").over(w).alias("z"))


def batch_scan(df: DataFrame) -> DataFrame:
    """(row, col, z): prefix sums along each row of a matrix (row, col, val)."""
    w = Window.partitionBy("row").orderBy("col").rowsBetween(Window.unboundedPreceding, 0)
    return df.select("row", "col", F.sum("val").over(w).alias("z"))


def positions(df: DataFrame, keep: Column, block: int = 1 << 20) -> DataFrame:
    """df with pos: how many rows before this one, by idx, satisfy keep."""
    return running(df.withColumn("_one", F.when(keep, 1).otherwise(0).cast("long")), "_one", "pos", block, exclusive=True).drop("_one")


def value_bounds(df: DataFrame, val: str, width: int, buckets: int = 1024) -> list[list]:
    """Distinct approximate quantiles of val, ascending, in rows of 32: about one for `width` rows, `buckets` at most."""
    at = [i / (buckets + 1) for i in range(1, buckets + 1)]
    known = F.when(~F.isnan(F.col(val).cast("double")), F.col(val))
    row = df.agg(F.count(F.lit(1)).alias("n"), F.percentile_approx(known, at, 10 * buckets).alias("q")).first()
    n = min(buckets, row["n"] // width)
    found = row["q"] or []
    flat = sorted({found[i * len(found) // n] for i in range(n)}) if found else []
    return [flat[i : i + 32] for i in range(0, len(flat), 32)]


def value_block(val: Column, bounds: list[list]) -> Column:
    """A number that grows with val: even between two bounds, odd at one; -1 for null. Looks among the first bounds of rows,
    then in one row."""
    if not bounds:
        return F.when(val.isNull(), -1).otherwise(0).cast("long")
    firsts = F.array(*[F.lit(x[0]) for x in bounds])
    rows = F.array(*[F.array(*[F.lit(y) for y in x]) for x in bounds])
    row = F.size(F.filter(firsts, lambda x: x <= val))
    inside = F.element_at(rows, F.greatest(row, F.lit(1)))
    below, upto = (F.size(F.filter(inside, f)) for f in (lambda x: x < val, lambda x: x <= val))
    return F.when(val.isNull(), -1).otherwise(64 * F.greatest(row - 1, F.lit(0)) + below + upto).cast("long")
