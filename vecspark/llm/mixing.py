"""Mix sources to target weights along a time-varying curriculum, with DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
#: Weight schedules, dealt to the sources in order and repeated: knots (time, relative weight), linear in between.
#: Only the shape counts: each is scaled to the mean 1, so that a source's total is its target.
SCHEDULES: tuple[tuple[tuple[float, float], ...], ...] = (
    ((0.0, 1.5), (1.0, 0.5)),
    ((0.0, 1.0), (1.0, 1.0)),
    ((0.0, 0.25), (0.5, 0.75), (1.0, 2.25)),
)
_BLOCKS = 3  # hex digits of the order key that make a block: 4096 blocks a source


def size_in_words(text: str | Column = "text") -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), most: float = 3) -> DataFrame:
    """From (source, source_size) to (source, source_size, rank, target).

    Sources in code point order, null last, get the weights in turn and share the total; target = min(most * size,
    level * weight), where the level makes the targets add up: what capped sources leave is reshared by weight until
    none is above its cap. One row a source, so the windows see aggregates only.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    at = F.row_number().over(order) - 1
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (at % len(weights) + 1).cast("int"))
    caps = sizes.withColumn("rank", at).withColumn("w", w).withColumn("cap", F.col("source_size") * float(most))
    fill = Window.orderBy(F.col("cap") / F.col("w"), "rank")
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    free = F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0))
    level = caps.withColumn("level", left / free)
    level = level.withColumn("level", F.max(F.when(F.col("level") * F.col("w") <= F.col("cap"), F.col("level"))).over(everything))
    return level.select("source", "source_size", "rank", F.least("cap", F.col("level") * F.col("w")).alias("target"))


def _when(q: Column, rank: Column, schedules: Sequence[Sequence[tuple[float, float]]]) -> Column:
    """The time at which a source has met the share q of its demand: its integrated schedule, inverted."""
    out = None
    for i, knots in enumerate(schedules):
        areas = [(t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(knots, knots[1:], strict=False)]
        total, met, inverse = sum(areas), 0.0, None
        for (t0, w0), (t1, w1), area in reversed(list(zip(knots, knots[1:], areas, strict=False))):
            met = sum(areas[: knots.index((t0, w0))])
            slope, rest = (w1 - w0) / (t1 - t0), q * total - met
            t = t0 + (rest / w0 if slope == 0 else (F.sqrt(F.greatest(F.lit(0.0), w0 * w0 + 2 * slope * rest)) - w0) / slope)
            inverse = t if inverse is None else F.when(q * total >= met + area, inverse).otherwise(t)
        mine = rank % len(schedules) == i
        out = F.when(mine, inverse) if out is None else out.when(mine, inverse)
    return out


def _planned(rows: DataFrame, weights: Sequence[float], most: float, seed: str) -> DataFrame:
    """rows, which have id, source and size, with what the mix takes of each: whole passes and extra words of one more;
    before: words of the source ahead of the row in a pass; taken, source_size, target, rank. All with _vs_ before."""
    key = F.md5(F.concat(F.lit(seed), F.coalesce(F.col("_vs_id").cast("string"), F.lit(""))))
    rows = rows.withColumn("_vs_key", key).withColumn("_vs_block", F.substring("_vs_key", 1, _BLOCKS))
    sums = rows.groupBy(F.col("_vs_source").alias("source"), F.col("_vs_block").alias("block")).agg(F.sum("_vs_size").alias("block_size"))
    targets = source_targets(sums.groupBy("source").agg(F.sum("block_size").alias("source_size")), weights, most)
    ahead = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("_vs_ahead", F.coalesce(F.sum("block_size").over(ahead), F.lit(0)))
    same = F.col("s.source").eqNullSafe(F.col("t.source"))
    plan = starts.alias("s").join(targets.alias("t"), same).select(
        F.col("s.source").alias("_vs_p_source"), F.col("block").alias("_vs_p_block"), "_vs_ahead",
        F.col("source_size").alias("_vs_source_size"), F.col("target").alias("_vs_target"), F.col("rank").alias("_vs_rank"),
    )
    inside = Window.partitionBy("_vs_source", "_vs_block").orderBy("_vs_key", "_vs_id", "_vs_size").rowsBetween(Window.unboundedPreceding, -1)
    run = rows.withColumn("_vs_inside", F.coalesce(F.sum("_vs_size").over(inside), F.lit(0)))
    both = run.join(plan, F.col("_vs_source").eqNullSafe(F.col("_vs_p_source")) & (F.col("_vs_block") == F.col("_vs_p_block")))
    passes = F.when(F.col("_vs_source_size") > 0, F.floor(F.col("_vs_target") / F.col("_vs_source_size"))).otherwise(F.lit(0)).cast("long")
    out = both.withColumn("_vs_passes", passes).withColumn("_vs_before", F.col("_vs_ahead") + F.col("_vs_inside"))
    last = F.round(F.col("_vs_target") - F.col("_vs_passes") * F.col("_vs_source_size")).cast("long")
    out = out.withColumn("_vs_extra", F.greatest(F.lit(0).cast("long"), F.least("_vs_size", last - F.col("_vs_before"))))
    return out.withColumn("_vs_taken", F.col("_vs_passes") * F.col("_vs_size") + F.col("_vs_extra"))


def mixture(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), most: float = 3, schedules: Sequence = SCHEDULES, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """How much of each document the mix takes, and when first:
    (doc_id, source, size, source_size, target, taken, repeats, position), range-sorted by position.

    A source whose target is r times its size passes floor(r) times whole over its documents, in the order of
    md5(seed + doc_id); one more pass ends at the target's last word, inside one document at most. So every source
    takes its target to the word, no document more than `most` times its size (passes then ends there), and reruns
    agree. repeats: the passes that take words of the document. position: the time in [0, 1] at which the source's
    weight schedule, integrated and inverted, has demanded the words ahead of the document in the first pass; null where
    nothing is taken, last in the order. Later passes come later by as many words; see curriculum for all of them.

    The running sum has two levels: sums of 4096 hash blocks a source, and a window inside a block, so a source with a
    third of all rows is spread over 4096 groups. Documents without words get 0; null text counts none and null source
    is a source, the last; a null doc_id is ordered as if empty. Rows that repeat a doc_id stand next to each other, the
    smaller first, and share no words. A very long text is one row of a window. No rows in, no rows out.
    """
    rows = docs.select(F.col(id_col).alias("_vs_id"), F.col(source_col).cast("string").alias("_vs_source"), size_in_words(text_col).alias("_vs_size"))
    out = _planned(rows, weights, most, seed)
    repeats = (F.when(F.col("_vs_size") > 0, F.col("_vs_passes")).otherwise(0) + F.when(F.col("_vs_extra") > 0, 1).otherwise(0)).cast("int")
    position = F.when(F.col("_vs_taken") > 0, _when(F.col("_vs_before") / F.col("_vs_target"), F.col("_vs_rank"), schedules))
    names = {"_vs_id": "doc_id", "_vs_source": "source", "_vs_size": "size", "_vs_source_size": "source_size", "_vs_target": "target", "_vs_taken": "taken"}
    out = out.select(*[F.col(c).alias(n) for c, n in names.items()], repeats.alias("repeats"), position.alias("position"))
    return out.orderBy(F.col("position").asc_nulls_last(), "doc_id")


def curriculum(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), most: float = 3, schedules: Sequence = SCHEDULES, seed: str = "mix") -> DataFrame:
    """The training stream: docs repeated as the mix takes them, range-sorted by their time of training.

    Adds size, taken, repeat (0, 1...: which pass), words (of this pass; fewer than size where the mix ends inside
    the document) and position: the time in [0, 1] at which the source's integrated weight schedule has demanded all
    words ahead of this one. Documents that the mix leaves out, or that have no words, are not in the stream; no other
    row is lost: each row of docs is planned by itself, also one that repeats another, so the words of the stream are
    those that mixture() takes. Texts move twice: to their block of a source, and to their place in the order.
    Rows keep the columns of docs; a column of docs that is called like an added one is dropped. Nulls as in mixture().
    """
    added = {"size", "taken", "repeat", "words", "position"}
    kept = docs.drop(*added).columns
    rows = docs.select(*[F.col(f"`{c}`") for c in kept], F.col("doc_id").alias("_vs_id"), F.col("source").cast("string").alias("_vs_source"), size_in_words("text").alias("_vs_size"))
    full = _planned(rows, weights, most, seed).where("_vs_taken > 0")
    full = full.withColumn("repeat", F.explode(F.sequence(F.lit(0), (F.col("_vs_passes") + F.when(F.col("_vs_extra") > 0, 0).otherwise(-1)).cast("int"))))
    words = F.when(F.col("repeat") < F.col("_vs_passes"), F.col("_vs_size")).otherwise(F.col("_vs_extra"))
    met = (F.col("repeat") * F.col("_vs_source_size") + F.col("_vs_before")) / F.col("_vs_target")
    full = full.withColumn("words", words).withColumn("position", _when(met, F.col("_vs_rank"), schedules))
    return full.select(*[F.col(f"`{c}`") for c in kept], F.col("_vs_size").alias("size"), F.col("_vs_taken").alias("taken"), "repeat", "words", "position").orderBy("position", "doc_id", "repeat")
