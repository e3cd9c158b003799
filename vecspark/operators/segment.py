"""Segmented scans and sums."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vecspark.operators.scan import running, scan


def segment_ids(df: DataFrame, block: int = 1 << 20) -> DataFrame:
    """df with seg: the number of start flags up to and with this row."""
    return running(df.withColumn("_f", F.col("flag").cast("long")), "_f", "seg", block).drop("_f")


def seg_scan(df: DataFrame, block: int = 1 << 20) -> DataFrame:
    """(idx, seg, z) from (idx, val, flag): the prefix sum starts anew at every flag. A null flag is none.

    A block keeps, besides the sum and the flags before a row, where the row's segment began in it; a segment that began
    in an earlier block has its beginning carried over the block totals. So a segment of any length is spread over many
    blocks, and the vector moves once.
    """
    to_here = Window.partitionBy("_blk").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    cut = df.select("idx", "val", F.coalesce(F.col("flag").cast("boolean"), F.lit(False)).alias("_flag"), F.expr(f"idx div {int(block)}").alias("_blk"))
    cut = cut.withColumn("_s", F.sum("val").over(to_here)).withColumn("_f", F.sum(F.col("_flag").cast("long")).over(to_here))
    mark = F.when(F.col("_flag"), F.struct(F.col("idx").alias("i"), (F.col("_s") - F.coalesce("val", F.lit(0))).alias("base")))
    cut = cut.withColumn("_mark", F.max(mark).over(to_here))
    totals = cut.groupBy("_blk").agg(F.sum("val").alias("s"), F.sum(F.col("_flag").cast("long")).alias("f"), F.max("_mark").alias("m"))
    before = Window.orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)  # one row a block
    totals = totals.withColumn("_as", F.coalesce(F.sum("s").over(before), F.lit(0))).withColumn("_af", F.coalesce(F.sum("f").over(before), F.lit(0)))
    begun = F.max(F.when(F.col("m").isNotNull(), F.struct("m.i", (F.col("m.base") + F.col("_as")).alias("base")))).over(before)
    carry = totals.select(F.col("_blk").alias("_of"), "_as", "_af", F.coalesce(begun["base"], F.lit(0)).alias("_ab"))
    both = cut.join(carry, F.col("_blk") == F.col("_of"))
    z = F.when(F.col("_mark").isNotNull(), F.col("_s") - F.col("_mark.base")).otherwise(F.col("_as") + F.coalesce("_s", F.lit(0)) - F.col("_ab"))
    return both.select("idx", (F.col("_af") + F.col("_f")).alias("seg"), z.alias("z"))


def seg_scan_revert(scanned: DataFrame, diff: DataFrame) -> DataFrame:
    """(idx, z) from a scan (idx, scan_x, seg) and the scan's value at each segment's end (seg, diff)."""
    prior = diff.select((F.col("seg") + 1).alias("seg"), "diff")
    return scanned.join(prior, "seg", "left").select("idx", (F.col("scan_x") - F.coalesce("diff", F.lit(0))).alias("z"))


def seg_sum_flags(df: DataFrame, block: int = 1 << 20) -> DataFrame:
    """(seg, total) from (idx, val, end): a flag ends a segment; what follows the last flag is left out."""
    ids = running(df.withColumn("_f", F.col("end").cast("long")), "_f", "seg", block, exclusive=True)
    sums = ids.groupBy("seg").agg(F.sum("val").alias("total"), F.max("_f").alias("_f"))
    return sums.where("_f = 1").select("seg", "total")


def seg_sum_indptr(df: DataFrame, segments: DataFrame, block: int = 64) -> DataFrame:
    """(seg, total) for segments (seg, start, end), starts ascending with seg; empty ones give 0.

    Segments meet the vector in the blocks of `block` positions that they touch, so the join is on equal blocks; sums are
    taken in each block before those of a segment meet.
    """
    touched = F.explode(F.sequence(F.expr(f"start div {int(block)}"), F.expr(f"(end - 1) div {int(block)}")))
    parts = segments.where("end > start").select("seg", "start", "end", touched.alias("_blk"))
    rows = df.select("idx", "val", F.expr(f"idx div {int(block)}").alias("_blk"))
    sums = rows.join(parts, "_blk").where("idx >= start AND idx < end").groupBy("seg").agg(F.sum("val").alias("total"))
    return segments.select("seg").join(sums, "seg", "left").select("seg", F.coalesce("total", F.lit(0)).alias("total"))


def starts_to_segments(starts: DataFrame, n: int) -> DataFrame:
    """(seg, start, end) from (seg, start): a segment ends where the next one starts, the last at n. seg is dense."""
    after = starts.select((F.col("seg") - 1).alias("seg"), F.col("start").alias("end"))
    return starts.join(after, "seg", "left").select("seg", "start", F.coalesce("end", F.lit(n)).alias("end"))


def counts_to_segments(counts: DataFrame, block: int = 1 << 20) -> DataFrame:
    """(seg, start, end) from (seg, n): row pointers as the exclusive scan of row sizes."""
    z = scan(counts.select(F.col("seg").alias("idx"), F.col("n").alias("val")), block, exclusive=True)
    return counts.join(z, F.col("seg") == F.col("idx")).select("seg", F.col("z").alias("start"), (F.col("z") + F.col("n")).alias("end"))


def number_rows(df: DataFrame, segments: DataFrame, key: str, order: list[str]) -> DataFrame:
    """df with idx: rows in the order of (key, *order), numbered through the segments of their keys."""
    w = Window.partitionBy(key).orderBy(*order)
    ranked = df.withColumn("_rn", F.row_number().over(w) - 1)
    return ranked.join(segments, F.col(key) == F.col("seg")).withColumn("idx", F.col("start") + F.col("_rn")).drop("_rn", "seg", "start", "end")
