"""Sparse matrices as (row, col, val): products and conversions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecspark.operators.gather import gather_minus_one
from vecspark.operators.scan import running
from vecspark.operators.segment import counts_to_segments


def csr_gather(a: DataFrame, x: DataFrame) -> DataFrame:
    """(row, col, z): every entry times x (col, x) at its column."""
    return a.join(x, "col").select("row", "col", (F.col("val") * F.col("x")).alias("z"))


def spmv(a: DataFrame, x: DataFrame, rows: DataFrame) -> DataFrame:
    """(row, y): the product; rows (row) without entries give 0. Entries of a row are summed before the shuffle."""
    sums = csr_gather(a, x).groupBy("row").agg(F.sum("z").alias("y"))
    return rows.join(sums, "row", "left").select("row", F.coalesce("y", F.lit(0)).alias("y"))


def spmv_via_scan(a: DataFrame, x: DataFrame, rows: DataFrame, block: int = 1 << 20) -> DataFrame:
    """spmv as gather, scan, gather at the row pointers and difference; a has idx, its row-major position."""
    z = a.join(x, "col").select("idx", "row", (F.col("val") * F.col("x")).alias("z"))
    scanned = running(z, "z", "s", block).select(F.col("idx").alias("pos"), F.col("s").alias("val"))
    counts = rows.join(a.groupBy("row").agg(F.count(F.lit(1)).alias("n")), "row", "left").select(F.col("row").alias("seg"), F.coalesce("n", F.lit(0)).alias("n"))
    seg = counts_to_segments(counts, block)
    at = lambda c: gather_minus_one(seg.select(F.col("seg").alias("idx"), F.col(c).alias("pos")), scanned)
    end, start = at("end"), at("start").withColumnRenamed("z", "z0")
    return end.join(start, "idx").select(F.col("idx").alias("row"), (F.col("z") - F.col("z0")).alias("y"))


def spmm(a: DataFrame, b: DataFrame, sums: int = 1 << 20) -> DataFrame:
    """(row, j, y): the product with a dense or sparse matrix b (col, j, x); absent where no entry meets.

    Products move to their row and j before they are summed, about `sums` of them to a task, so that no task holds the
    sums of a whole split. Rows with more than `sums` entries, if any, are few sums of many products: theirs are summed
    where they arise.
    """
    entries = a.count()
    cells, cols = b.agg(F.count(F.lit(1)), F.approx_count_distinct("col")).first()
    heavy = _heavy_rows(a, entries, sums)
    add = lambda z: z.groupBy("row", "j").agg(F.sum("z").alias("y"))
    products = lambda a: a.join(b, "col").select("row", "j", (F.col("val") * F.col("x")).alias("z"))
    light = a.where(~F.coalesce(F.col("row").isin(heavy), F.lit(False))) if heavy else a
    out = add(products(light).repartition(max(8, entries * cells // max(cols, 1) // sums), "row", "j"))
    return out.unionAll(add(products(a.where(F.col("row").isin(heavy))))) if heavy else out


def _heavy_rows(a: DataFrame, entries: int, sums: int) -> list:
    """The rows of more than `sums` entries; of those, none with less than a share of 1 in 10000."""
    if entries <= sums:
        return []
    often = a.stat.freqItems(["row"], max(sums / entries, 1e-4)).first()[0]  # these and some others
    counts = a.where(F.col("row").isin(often)).groupBy("row").agg(F.count(F.lit(1)).alias("n"))
    return [r[0] for r in counts.where(F.col("n") > sums).collect()]


def csr_to_flags(counts: DataFrame, block: int = 1 << 20) -> DataFrame:
    """(idx): where rows of (seg, n) start; empty rows share a start with the next and give no flag of their own."""
    return counts_to_segments(counts, block).where("end > start").select(F.col("start").alias("idx"))
