"""Readers and generators of sparse matrices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_matrix_market(spark: SparkSession, path: str) -> DataFrame:
    """(row, col, val) from a Matrix Market coordinate file; see parse_matrix_market."""
    return parse_matrix_market(spark.read.text(path))


def parse_matrix_market(lines: DataFrame) -> DataFrame:
    """(row, col, val) from the lines (value) of a Matrix Market coordinate file, in their order: zero-based, symmetric
    entries mirrored, patterns as 1.

    Comments begin with %. Of the other lines the first, which has three numbers, gives the size and is left out, once;
    an entry that reads the same is an entry.
    """
    head = (lines.where("value LIKE '%%MatrixMarket%'").first() or [""])[0].lower().split()
    if len(head) < 5 or head[2] != "coordinate" or head[3] == "complex" or head[4] not in ("general", "symmetric", "skew-symmetric"):
        raise ValueError(f"not a supported coordinate header: {' '.join(head)}")
    # Lines of one file keep their order in ids that grow with the partition and the line.
    body = lines.withColumn("_at", F.monotonically_increasing_id()).where("value NOT LIKE '\\%%' AND trim(value) <> ''")
    rows = body.select("_at", F.split(F.trim("value"), r"\s+").alias("f"))
    if head[3] == "pattern":  # entries have two numbers, the size three
        rows = rows.where("size(f) = 2")
    else:
        rows = rows.where(F.col("_at") != rows.agg(F.min("_at")).first()[0])
    val = F.lit(1.0) if head[3] == "pattern" else F.col("f")[2].cast("double")
    out = rows.select((F.col("f")[0].cast("long") - 1).alias("row"), (F.col("f")[1].cast("long") - 1).alias("col"), val.alias("val"))
    if head[4] == "general":
        return out
    sign = -1.0 if head[4] == "skew-symmetric" else 1.0
    return out.unionAll(out.where("row <> col").select(F.col("col").alias("row"), F.col("row").alias("col"), (F.col("val") * sign).alias("val")))


def random_matrix(spark: SparkSession, rows: int, cols: int, nnz: int, seed: int = 0, power: float = 0.0) -> DataFrame:
    """(row, col, val): nnz hashed entries, the same at every run; power > 0 crowds them into low columns."""
    u = lambda k: F.pmod(F.xxhash64("id", F.lit(seed), F.lit(k)), F.lit(1 << 53)) / float(1 << 53)
    return spark.range(nnz).select(F.floor(u(1) * rows).cast("long").alias("row"), F.floor(F.pow(u(2), F.lit(1 + power)) * cols).cast("long").alias("col"), (1 + 8 * u(3)).alias("val"))


def block_sparse(spark: SparkSession, n: int, block: int, window: int, globals_: int, random: int, seed: int = 0) -> DataFrame:
    """(row, col, val): attention-like blocks of ones: the first ones, a window at the diagonal, and hashed ones."""
    k = n // block
    b = spark.range(k).withColumnRenamed("id", "i")
    near = F.sequence(F.greatest(F.lit(0).cast("long"), F.col("i") - window), F.least(F.lit(k - 1).cast("long"), F.col("i") + window))
    far = F.transform(F.sequence(F.lit(1), F.lit(max(random, 1))), lambda x: F.pmod(F.xxhash64("i", x, F.lit(seed)), F.lit(k)))
    first = F.sequence(F.lit(0).cast("long"), F.lit(max(globals_, 1) - 1).cast("long"))
    parts = [near, *([first] if globals_ else []), *([far] if random else [])]
    blocks = b.select("i", F.explode(F.array_distinct(F.concat(*parts))).alias("j"))
    at = F.explode(F.sequence(F.lit(0), F.lit(block * block - 1)))
    cells = blocks.select("i", "j", at.alias("c"))
    return cells.select((F.col("i") * block + F.expr(f"c div {block}")).alias("row"), (F.col("j") * block + F.col("c") % block).alias("col"), F.lit(1.0).alias("val"))
