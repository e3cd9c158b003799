"""Exact dedup by distributed most-significant-digit radix partitioning."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecspark.llm.common import condensed, materialise


def exact_groups(docs: DataFrame, first_digit: int = 128, growth: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Group rows whose texts are equal after lower-casing A-Z: (doc_id, keep_id, group_size, kept, sha).

    A group of texts that agree so far is split by its next bytes, its digit: `first_digit` bytes, then `growth`
    times as many each level, so that a text of n bytes takes O(log n) levels. A group leaves when it has one row or
    its texts have ended. Groups are told apart by their bytes alone: a group that goes on is named by the least row
    number in it. The digest in `sha` (hex) is only returned. A level counts groups with map-side pre-aggregation, so a
    group that holds a third of all rows is one row per task there, and joins the counts back (a join that adaptive
    execution splits when skewed). Only open groups carry bytes on.

    Null text counts as empty; empty texts are one group. Of equal texts the row with the largest doc_id stays; a null
    doc_id stays only if no other is there. Rows that repeat a doc_id count each: with one text they share their group's
    flags, with different texts each is in the group of its text. A very long text is a row of as many bytes in the
    shuffle of each level that it stays open. No rows in, no rows out. Other columns of docs are not looked at.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return condensed(docs.sparkSession, lambda: _groups(rows, first_digit, growth), "exact-groups")


def _groups(rows: DataFrame, width: int, growth: int) -> DataFrame:
    text = F.translate(F.coalesce("text", F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    live = rows.select("doc_id", F.encode(text, "UTF-8").alias("rest"), F.lit(0).cast("long").alias("group"), F.monotonically_increasing_id().alias("row"))
    live = live.select("doc_id", F.sha2("rest", 256).alias("sha"), "rest", "group", "row")
    done: list[DataFrame] = []
    while True:
        cut = live.withColumns({"digit": F.substring("rest", 1, width), "ended": F.length("rest") <= width})
        groups = cut.groupBy("group", "digit", "ended").agg(F.max("doc_id").alias("top"), F.count(F.lit(1)).alias("n"), F.min("row").alias("name"))
        same: Column = (F.col("c.group") == F.col("g.group")) & (F.col("c.digit") == F.col("g.digit")) & (F.col("c.ended") == F.col("g.ended"))
        level = cut.alias("c").join(groups.alias("g"), same).select(
            "c.doc_id", "c.sha", "g.top", "g.n", "g.name", "c.row", (F.col("c.ended") | (F.col("g.n") == 1)).alias("closed"),
            F.when(~F.col("c.ended") & (F.col("g.n") > 1), F.substring("rest", width + 1, 2**31 - 1)).alias("rest"),
        )
        level = materialise(level, f"radix-{width}")
        done.append(level.where("closed").select("doc_id", "top", "n", "sha"))
        live = level.where("NOT closed").select("doc_id", "sha", "rest", F.col("name").alias("group"), "row")
        width *= growth
        if live.isEmpty():
            break
    out = done[0]
    for more in done[1:]:
        out = out.unionAll(more)
    return out.select("doc_id", F.col("top").alias("keep_id"), F.col("n").alias("group_size"), F.col("doc_id").eqNullSafe(F.col("top")).alias("kept"), "sha")
