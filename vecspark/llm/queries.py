"""The queries of the training-data operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecspark.llm.decontaminate import contaminated
from vecspark.llm.exact_dedup import exact_groups
from vecspark.llm.html_text import extract_text
from vecspark.llm.jaccard_join import near_duplicate_components
from vecspark.llm.language_id import fit_languages, identify_languages
from vecspark.llm.line_dedup import dedup_lines
from vecspark.llm.mixing import mixture
from vecspark.llm.preferences import conversations, format_preferences, paired_by_number, paired_by_opening
from vecspark.llm.quality import fit_quality, score_quality

from vecspark.llm.substring_dedup import dedup_substrings


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _remainder(n: int):  # noqa: ANN202
    """crc32 of doc_id as text, modulo n; a null doc_id counts as empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % n


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts of documents; see exact_groups."""
    out = exact_groups(_read(spark, sf_dir, "documents"))
    return out.select("doc_id", "keep_id", "group_size", "kept", F.col("sha").alias("text_sha256"))


OP1_SQL = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM d
"""


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that repeat, exactly or nearly, in it or in others."""
    out = dedup_lines(_read(spark, sf_dir, "documents").select("doc_id", "text"), shortest=1)
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of a document and a benchmark item that it holds."""
    out = contaminated(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "item_id", "item_words", "covered", "coverage", F.size("tiles").alias("n_tiles"))


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visible text of every page."""
    return extract_text(_read(spark, sf_dir, "pages")).select("page_id", "url", "text")


def op5_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompt and completions of every two successive conversations with one opening, and of every two by number.

    Of a completion: its segments as one text, and for each of them 1 if it is trained on, else 0.
    """
    talks = conversations(_read(spark, sf_dir, "conversations"))
    out = format_preferences(talks, paired_by_opening(talks).union(paired_by_number(talks)).distinct())
    joined = lambda c: F.concat_ws("", F.transform(c, lambda x: x["text"]))
    mask = lambda c: F.concat_ws("", F.transform(c, lambda x: x["train"].cast("int").cast("string")))
    sides = [f(c).alias(n) for c in ("chosen", "rejected") for f, n in ((joined, c), (mask, f"{c}_mask"))]
    return out.select("chosen_id", "rejected_id", "shared_turns", "prompt", *sides)


OP5_SQL = """
WITH t AS (SELECT DISTINCT conv_id, CAST(turn AS INTEGER) AS turn, role, text FROM conversations WHERE conv_id IS NOT NULL),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS k FROM t),
o AS (SELECT conv_id, role, text FROM n WHERE k = 1),
p AS (SELECT conv_id AS chosen_id, lead(conv_id) OVER (PARTITION BY role, text ORDER BY conv_id) AS rejected_id FROM o),
q AS (SELECT * FROM p WHERE rejected_id IS NOT NULL UNION SELECT a.conv_id, b.conv_id FROM o a JOIN o b ON b.conv_id = a.conv_id + 1 WHERE a.conv_id % 2 = 0),
c AS (SELECT q.*, n.k, n.role, n.text FROM q JOIN n ON n.conv_id = q.chosen_id),
m AS (
  SELECT c.chosen_id, c.rejected_id, count(*) AS size,
         min(c.k) FILTER (WHERE r.k IS NULL OR c.role IS DISTINCT FROM r.role OR c.text IS DISTINCT FROM r.text) AS differ
  FROM c LEFT JOIN n r ON r.conv_id = c.rejected_id AND r.k = c.k GROUP BY 1, 2),
s AS (SELECT chosen_id, rejected_id, CAST(coalesce(differ - 1, size) AS INTEGER) AS shared_turns FROM m),
g AS (
  SELECT conv_id, k, '<|im_start|>' || replace(coalesce(role, ''), '<|', '< |') || chr(10) || replace(coalesce(text, ''), '<|', '< |') || '<|im_end|>' || chr(10) AS seg,
         CASE WHEN role = 'assistant' THEN '1' ELSE '0' END AS train FROM n),
x AS (
  SELECT s.chosen_id, s.rejected_id, s.shared_turns, coalesce(string_agg(seg, '' ORDER BY k) FILTER (WHERE k <= shared_turns), '') AS prompt,
         coalesce(string_agg(seg, '' ORDER BY k) FILTER (WHERE k > shared_turns), '') AS chosen, coalesce(string_agg(train, '' ORDER BY k) FILTER (WHERE k > shared_turns), '') AS chosen_mask
  FROM s JOIN g ON g.conv_id = s.chosen_id GROUP BY 1, 2, 3),
y AS (
  SELECT s.chosen_id, s.rejected_id, coalesce(string_agg(seg, '' ORDER BY k) FILTER (WHERE k > shared_turns), '') AS rejected, coalesce(string_agg(train, '' ORDER BY k) FILTER (WHERE k > shared_turns), '') AS rejected_mask
  FROM s JOIN g ON g.conv_id = s.rejected_id GROUP BY 1, 2)
SELECT x.*, y.rejected, y.rejected_mask FROM x JOIN y ON x.chosen_id = y.chosen_id AND x.rejected_id = y.rejected_id
"""


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document; learnt from those that are not held out."""
    docs = _read(spark, sf_dir, "documents")
    model = fit_languages(docs.where(_remainder(4) != 2).select("text", "lang"))
    rows = docs.select("doc_id", (_remainder(4) == 2).alias("held_out"), "text")
    return identify_languages(rows, model).drop("text")


def op7_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the bytes that lie in repeated strings of 100 bytes."""
    out = dedup_substrings(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 5-word shingle sets have a Jaccard similarity of 0.8 or more."""
    return near_duplicate_components(_read(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document; learnt from labels of rows that are not held out."""
    docs = _read(spark, sf_dir, "documents")
    model = fit_quality(docs, _read(spark, sf_dir, "labels"), _remainder(5) != 0)
    rows = docs.select("doc_id", (_remainder(5) == 0).alias("held_out"), "text")
    return score_quality(rows, model).drop("text")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes and when, range-sorted by position."""
    out = mixture(_read(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", "taken", "repeats", F.round("position", 9).alias("position"))


OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5('mix' || coalesce(CAST(doc_id AS VARCHAR), '')) AS key FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM d GROUP BY source),
w AS (SELECT *, CASE rank % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w, source_size * 3.0::DOUBLE AS cap FROM s),
l AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER b, 0)) AS level
  FROM w WINDOW b AS (ORDER BY cap / w, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT *, least(cap, w * max(CASE WHEN level * w <= cap THEN level END) OVER ()) AS target FROM l),
p AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS passes FROM t),
r AS (
  SELECT d.doc_id, d.size, p.source_size, p.target, p.passes, p.rank,
         CAST(round(p.target - p.passes * p.source_size) AS BIGINT) AS last,
         coalesce(CAST(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS before
  FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source),
x AS (SELECT *, greatest(0, least(size, last - before)) AS extra, before / nullif(target, 0) AS q FROM r)
SELECT doc_id, size, source_size, target, passes * size + extra AS taken,
       CAST(CASE WHEN size > 0 THEN passes ELSE 0 END + CASE WHEN extra > 0 THEN 1 ELSE 0 END AS INTEGER) AS repeats,
       round(CASE WHEN passes * size + extra > 0 THEN CASE rank % 3
         WHEN 0 THEN (sqrt(greatest(0.0::DOUBLE, 2.25::DOUBLE - 2 * q)) - 1.5::DOUBLE) / -1
         WHEN 1 THEN q
         ELSE CASE WHEN q >= 0.25::DOUBLE THEN 0.5::DOUBLE + (sqrt(0.5625::DOUBLE + 6 * (q - 0.25::DOUBLE)) - 0.75::DOUBLE) / 3
                   ELSE sqrt(0.0625::DOUBLE + 2 * q) - 0.25::DOUBLE END END END, 9) AS position
FROM x
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_line_dedup": op2_line_dedup,
    "op3_decontamination": op3_decontamination,
    "op4_html_text": op4_html_text,
    "op5_preferences": op5_preferences,
    "op6_language_id": op6_language_id,
    "op7_suffix_array": op7_suffix_array,
    "op8_jaccard_join": op8_jaccard_join,
    "op9_quality": op9_quality,
    "op10_mixing": op10_mixing,
}
ORACLES: dict[str, str] = {"op1_exact_dedup": OP1_SQL, "op5_preferences": OP5_SQL, "op10_mixing": OP10_SQL}
