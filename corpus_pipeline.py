"""The corpus pipeline: quality, lines, near duplicates, decontamination, mixing.

Every stage takes any table with doc_id, text, source and n_chars and keeps its other columns. Decisions are joined back by
doc_id and a hash of the text, null-safely: rows that repeat a doc_id with other texts are judged each by its own text,
rows that repeat both are kept or dropped together, and a null doc_id is one like any other. Empty tables stay empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecspark.llm.common import materialise
from vecspark.llm.decontaminate import contaminated
from vecspark.llm.jaccard_join import near_duplicate_components
from vecspark.llm.line_dedup import dedup_lines
from vecspark.llm.mixing import curriculum
from vecspark.llm.quality import fit_quality, score_quality


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs without the rows listed by (doc_id, key)."""
    # Written first, so that the planner knows its size and shuffles the texts only if it is large.
    gone = materialise(gone.select(F.col("doc_id").alias("_id"), F.col("key").alias("_key")).distinct(), "gone")
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("_id")) & (F.xxhash64(F.col("text").cast("string")) == F.col("_key"))
    return docs.join(gone, same, "left_anti").select(*docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the quality classifier rejects.

    Null and empty texts are scored as empty ones; a null doc_id has no label and is scored; repeated rows score alike.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = fit_quality(docs, labels, F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 != 0)
    return score_quality(docs, model).where("predicted = 1").select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without repeated lines; a document that had text and has none left goes. n_chars of a shortened text is renewed.

    Null and empty texts have no lines and stay.
    """
    out = dedup_lines(docs, shortest=1).where("n_removed = 0 OR length(trim(text)) > 0")
    return out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest doc_id.

    Texts without words are in no group and stay. A row without doc_id stays only if its group has none with one.
    """
    found = near_duplicate_components(docs).where("component_id IS NOT NULL AND (doc_id IS NULL OR component_id <> doc_id)")
    return _without(docs, found)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold a benchmark item. Null and empty texts hold none and stay."""
    return _without(docs, contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training stream: sources at their target weights along the curriculum; see there for nulls and repeats."""
    return curriculum(docs)


STAGES = [
    ("quality", quality),
    ("line dedup", lines),
    ("near duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
]

#: Compression, edit similarity and tiling can't be said in SQL; tests/llm holds each stage's operator against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each on what its predecessor kept."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialise(docs, name.replace(" ", "-"))
    return docs
