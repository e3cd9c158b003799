"""Every operator on the test tables, with DuckDB SQL for the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vecspark.operators import compact, element, gather, linalg, order, reduce, sampling, scan, segment, sparse
from vecspark.sources import matrices, vectors

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
BLOCK = 512

# SQL views of the bindings below.
_V = "v AS (SELECT event_id AS idx, user_id, CAST(round(value * 100) AS BIGINT) AS val FROM events)"
# The same in doubles: multiples of 1/64, so that sums are exact in whatever order they are taken; every 13th is negative.
_D = "d AS (SELECT idx, user_id, CASE WHEN idx % 13 = 0 THEN -val ELSE val END / 64.0::DOUBLE AS val FROM v)"
_A = "a AS (SELECT l_orderkey AS r, l_partkey AS c, CAST(l_quantity AS BIGINT) AS val, * FROM lineitem)"
_X = "x AS (SELECT p_partkey AS c, CAST(round(p_retailprice * 10) AS BIGINT) AS x FROM part)"
_CUM = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"


class Tables:
    """The test tables as vectors and matrices."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.dir = spark, sf_dir

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @property
    def v(self) -> DataFrame:
        return self.read("events").select(F.col("event_id").alias("idx"), "user_id", F.round(F.col("value") * 100).cast("long").alias("val"))

    @property
    def d(self) -> DataFrame:
        val = F.when(F.col("idx") % 13 == 0, -F.col("val")).otherwise(F.col("val")) / F.lit(64.0)
        return self.v.select("idx", "user_id", val.alias("val"))

    @property
    def n(self) -> int:
        return self.read("events").count()

    @property
    def a(self) -> DataFrame:
        return self.read("lineitem").select(F.col("l_orderkey").alias("row"), F.col("l_partkey").alias("col"), F.col("l_quantity").cast("long").alias("val"))

    @property
    def x(self) -> DataFrame:
        return self.read("part").select(F.col("p_partkey").alias("col"), F.round(F.col("p_retailprice") * 10).cast("long").alias("x"))

    @property
    def rows(self) -> DataFrame:
        return self.read("orders").select(F.col("o_orderkey").alias("row"))

    @property
    def counts(self) -> DataFrame:
        n = self.a.groupBy("row").agg(F.count(F.lit(1)).alias("n"))
        return self.rows.join(n, "row", "left").select(F.col("row").alias("seg"), F.coalesce("n", F.lit(0)).alias("n"))

    @property
    def numbered(self) -> DataFrame:
        """Entries of a in row-major order, with their position."""
        keys = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
        lines = self.read("lineitem").withColumn("row", F.col("l_orderkey"))
        out = segment.number_rows(lines, segment.counts_to_segments(self.counts, BLOCK), "row", keys)
        return out.select("idx", "row", F.col("l_partkey").alias("col"), F.col("l_quantity").cast("long").alias("val"))

    @property
    def dense(self) -> DataFrame:
        """Embeddings as whole numbers: (row, col, val)."""
        e = self.read("embeddings").select(F.col("vec_id").alias("row"), F.posexplode("embedding").alias("col", "e"))
        return e.select("row", F.col("col").cast("long").alias("col"), F.round(F.col("e").cast("double") * 100).cast("long").alias("val"))


def _add(name: str, query: Callable[[Tables], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = lambda spark, sf_dir: query(Tables(spark, sf_dir))
    if sql:
        ORACLES[name] = sql


def _with(*views: str) -> str:
    return "WITH " + ", ".join(views) + " "


# A: scans
def _scan_sql(start: int = 0, frame: str = _CUM) -> str:
    return _with(_V) + f"SELECT idx, CAST(coalesce(sum(val) OVER (ORDER BY idx {frame}), 0) + {start} AS BIGINT) AS z FROM v"


_add("scan_single", lambda t: scan.scan(t.v, BLOCK), _scan_sql())
_add("scan_starting_sum", lambda t: scan.scan(t.v, BLOCK, 1000), _scan_sql(1000))
_add("scan_multi", lambda t: scan.scan(t.v, BLOCK), _scan_sql())
_add("scan_multi_no_l2", lambda t: scan.scan(t.v, 4096), _scan_sql())
_add("scan_multi_cube", lambda t: scan.scan(t.v, 32 * 32), _scan_sql())
_add("scan_cpu", lambda t: scan.scan(t.v, 64, depth=2), _scan_sql())
_add("scan_exclusive", lambda t: scan.scan(t.v, BLOCK, exclusive=True), _scan_sql(frame="ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"))
_add("scan_batch", lambda t: scan.batch_scan(t.v.select(F.col("user_id").alias("row"), F.col("idx").alias("col"), "val")),
     _with(_V) + f"SELECT user_id AS row, idx AS col, CAST(sum(val) OVER (PARTITION BY user_id ORDER BY idx {_CUM}) AS BIGINT) AS z FROM v")
for _name, _len in (("row_scan", 128), ("block_scan", 1024)):
    _add(_name, lambda t, n=_len: scan.block_scan(t.v, n), _with(_V) + f"SELECT idx, CAST(sum(val) OVER (PARTITION BY idx // {_len} ORDER BY idx {_CUM}) AS BIGINT) AS z FROM v")


_DOUBLE_SCAN = _with(_V, _D) + f"SELECT idx, sum(val) OVER (ORDER BY idx {_CUM}) AS z FROM d"
_add("scan_double", lambda t: scan.scan(t.d, BLOCK), _DOUBLE_SCAN)
_add("scan_double_no_l2", lambda t: scan.scan(t.d, 4096, depth=2), _DOUBLE_SCAN)
_add("scan_batch_double", lambda t: scan.batch_scan(t.d.select(F.col("user_id").alias("row"), F.col("idx").alias("col"), "val")),
     _with(_V, _D) + f"SELECT user_id AS row, idx AS col, sum(val) OVER (PARTITION BY user_id ORDER BY idx {_CUM}) AS z FROM d")


# B: segments
def _flag(every: int) -> Column:
    return F.col("val") % every == 0


def _seg_sql(every: int) -> str:
    return f"s AS (SELECT idx, val, CAST(sum(CASE WHEN val % {every} = 0 THEN 1 ELSE 0 END) OVER (ORDER BY idx {_CUM}) AS BIGINT) AS seg FROM v)"


def _seg_scan_sql(every: int, columns: str = "idx, seg") -> str:
    return _with(_V, _seg_sql(every)) + f"SELECT {columns}, CAST(sum(val) OVER (PARTITION BY seg ORDER BY idx {_CUM}) AS BIGINT) AS z FROM s"


_add("seg_scan", lambda t: segment.seg_scan(t.v.withColumn("flag", _flag(97)), BLOCK), _seg_scan_sql(97))
_add("seg_scan_vec", lambda t: segment.seg_scan(t.v.withColumn("flag", _flag(997)), 4096), _seg_scan_sql(997))


def _revert(t: Tables) -> DataFrame:
    total = scan.running(segment.segment_ids(t.v.withColumn("flag", _flag(97)), BLOCK), "val", "scan_x", BLOCK)
    diff = total.groupBy("seg").agg(F.max("scan_x").alias("diff"))  # values are positive: a segment's last sum is its largest
    # Segment 0 is empty where the first element has a flag.
    return segment.seg_scan_revert(total.select("idx", "scan_x", "seg"), diff)


_add("seg_scan_double", lambda t: segment.seg_scan(t.d.withColumn("flag", F.col("idx") % 97 == 5), BLOCK),
     _with(_V, _D, f"s AS (SELECT idx, val, CAST(sum(CASE WHEN idx % 97 = 5 THEN 1 ELSE 0 END) OVER (ORDER BY idx {_CUM}) AS BIGINT) AS seg FROM d)")
     + f"SELECT idx, seg, sum(val) OVER (PARTITION BY seg ORDER BY idx {_CUM}) AS z FROM s")
_add("seg_scan_revert", _revert, _seg_scan_sql(97, "idx"))
_add("seg_sum_flags", lambda t: segment.seg_sum_flags(t.v.withColumn("end", _flag(97)), BLOCK),
     _with(_V, "s AS (SELECT val, val % 97 = 0 AS f, CAST(coalesce(sum(CASE WHEN val % 97 = 0 THEN 1 ELSE 0 END) OVER (ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS seg FROM v)")
     + "SELECT seg, CAST(sum(val) AS BIGINT) AS total FROM s GROUP BY seg HAVING bool_or(f)")
_SEG_SUM = "SELECT o_orderkey AS seg, CAST(coalesce(sum(l_quantity), 0) AS BIGINT) AS total FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1"
_add("seg_sum_indptr", lambda t: segment.seg_sum_indptr(t.numbered, segment.counts_to_segments(t.counts, BLOCK)), _SEG_SUM)
_add("seg_sum_multi_core", lambda t: segment.seg_sum_indptr(t.numbered, segment.counts_to_segments(t.counts, 4096), 256), _SEG_SUM)
_add("seg_sum_multi_cube", lambda t: segment.seg_sum_indptr(t.numbered, segment.counts_to_segments(t.counts, 1024), 128), _SEG_SUM)
_add("seg_sum_starts", lambda t: segment.seg_sum_indptr(t.numbered, segment.starts_to_segments(segment.counts_to_segments(t.counts, BLOCK).select("seg", "start"), t.read("lineitem").count())), _SEG_SUM)

# C: sparse products
_SPMV = _with(_A, _X) + "SELECT o_orderkey AS row, CAST(coalesce(sum(a.val * x.x), 0) AS BIGINT) AS y FROM orders LEFT JOIN a ON a.r = o_orderkey LEFT JOIN x ON x.c = a.c GROUP BY 1"
_add("csr_gather", lambda t: sparse.csr_gather(t.a, t.x), _with(_A, _X) + "SELECT r AS row, a.c AS col, a.val * x.x AS z FROM a JOIN x ON a.c = x.c")
for _name in ("spmv", "spmv_v2", "spmv_v2_multi_cube"):
    _add(_name, lambda t: sparse.spmv(t.a, t.x, t.rows), _SPMV)
_add("spmv_via_scan", lambda t: sparse.spmv_via_scan(t.numbered, t.x, t.rows, BLOCK), _SPMV)
_add("spmv_multi_cube", lambda t: sparse.spmv_via_scan(t.numbered, t.x, t.rows, 1024), _SPMV)
_add("spmm", lambda t: sparse.spmm(t.a, t.x.select("col", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2).cast("long"))).alias("j"), "x").withColumn("x", F.col("x") % (F.col("j") + 7))),
     _with(_A, _X) + "SELECT r AS row, CAST(j AS BIGINT) AS j, CAST(sum(val * (x % (j + 7))) AS BIGINT) AS y FROM a JOIN x ON a.c = x.c, range(3) t(j) GROUP BY 1, 2")
_add("spmv_double", lambda t: sparse.spmv(t.a.withColumn("val", F.col("val") / 8.0), t.x.withColumn("x", F.col("x") / 16.0), t.rows),
     _with(_A, _X) + "SELECT o_orderkey AS row, coalesce(sum(a.val / 8.0::DOUBLE * (x.x / 16.0::DOUBLE)), 0) AS y FROM orders LEFT JOIN a ON a.r = o_orderkey LEFT JOIN x ON x.c = a.c GROUP BY 1")
_add("csr_to_flags", lambda t: sparse.csr_to_flags(t.counts, BLOCK),
     "WITH c AS (SELECT l_orderkey AS r, count(*) AS n FROM lineitem GROUP BY 1) SELECT CAST(sum(n) OVER (ORDER BY r) - n AS BIGINT) AS idx FROM c")

# D: lookups
_add("gather", lambda t: gather.gather(t.v.select("idx", (F.col("idx") * 7 % t.n).alias("pos")), t.v.select(F.col("idx").alias("pos"), "val")),
     _with(_V) + "SELECT i.idx, v.val AS z FROM v i JOIN v ON v.idx = i.idx * 7 % (SELECT count(*) FROM v)")
_add("gather_minus_one", lambda t: gather.gather_minus_one(t.v.select("idx", (F.col("idx") * 7 % (t.n + 1)).alias("pos")), t.v.select(F.col("idx").alias("pos"), "val")),
     _with(_V) + "SELECT i.idx, coalesce(v.val, 0) AS z FROM v i LEFT JOIN v ON v.idx = i.idx * 7 % (SELECT count(*) + 1 FROM v) - 1")
_add("searchsorted", lambda t: gather.searchsorted(t.v.select(F.col("val").alias("key")), t.x.select(F.col("col").alias("needle_id"), F.col("x").alias("needle")), 1024),
     _with(_V, _X, "h AS (SELECT val, count(*) AS n FROM v GROUP BY 1)") + "SELECT c AS needle_id, CAST(coalesce(sum(n), 0) AS BIGINT) AS pos FROM x LEFT JOIN h ON h.val < x.x GROUP BY c")


def _edges(t: Tables) -> DataFrame:
    ends = t.v.agg(F.min("val").alias("lo"), F.max("val").alias("hi"))
    needles = ends.select(F.posexplode(F.array(F.col("lo") - 1, F.col("lo"), F.col("lo") + 1, F.col("hi") - 1, F.col("hi"), F.col("hi") + 1)).alias("needle_id", "needle"))
    return gather.searchsorted(t.v.select(F.col("val").alias("key")), needles.withColumn("needle_id", F.col("needle_id").cast("long")), 64)


_add("searchsorted_edges", _edges,
     _with(_V, "e AS (SELECT min(val) AS lo, max(val) AS hi FROM v)", "d AS (SELECT CAST(unnest(range(6)) AS BIGINT) AS needle_id, unnest([lo - 1, lo, lo + 1, hi - 1, hi, hi + 1]) AS needle FROM e)")
     + "SELECT needle_id, (SELECT count(*) FROM v WHERE val < needle) AS pos FROM d")

_add("searchsorted_double", lambda t: gather.searchsorted(t.d.select(F.col("val").alias("key")), t.x.select(F.col("col").alias("needle_id"), (F.col("x") / 64.0 - 100).alias("needle")), 1024),
     _with(_V, _D, _X, "h AS (SELECT val, count(*) AS n FROM d GROUP BY 1)") + "SELECT c AS needle_id, CAST(coalesce(sum(n), 0) AS BIGINT) AS pos FROM x LEFT JOIN h ON h.val < x.x / 64.0::DOUBLE - 100 GROUP BY c")


# E: order
_SORT = _with(_V) + "SELECT row_number() OVER (ORDER BY val, idx) - 1 AS pos, {} FROM v"
_add("sort_asc", lambda t: order.argsort(t.v, 1024).select("pos", "val"), _SORT.format("val"))
_add("argsort", lambda t: order.argsort(t.v, 1024).select("pos", "idx"), _SORT.format("idx"))
_DOUBLE_SORT = _with(_V, _D) + "SELECT row_number() OVER (ORDER BY val, idx) - 1 AS pos, {} FROM d"
_add("sort_double", lambda t: order.argsort(t.d, 1024).select("pos", "val"), _DOUBLE_SORT.format("val"))
_add("argsort_double", lambda t: order.argsort(t.d, 1024).select("pos", "idx"), _DOUBLE_SORT.format("idx"))
_add("argsort_few_values", lambda t: order.argsort(t.v.select("idx", F.when(F.col("val") % 3 > 0, F.col("val") % 3).alias("val")), 256),
     _with(_V) + "SELECT row_number() OVER (ORDER BY w NULLS FIRST, idx) - 1 AS pos, w AS val, idx FROM (SELECT idx, CASE WHEN val % 3 > 0 THEN val % 3 END AS w FROM v)")
_TOP = _with(_V) + "SELECT idx, val FROM v ORDER BY val DESC, idx LIMIT {}"
_add("topk_int", lambda t: order.topk(t.v, 100), _TOP.format(100))
_add("topk_k1", lambda t: order.topk(t.v, 1), _TOP.format(1))
_add("topk_sqrt", lambda t: order.topk(t.v, int(t.n**0.5)), _TOP.format("(SELECT CAST(floor(sqrt(count(*))) AS BIGINT) FROM events)"))
_add("topk_double", lambda t: order.topk(t.read("events").select(F.col("event_id").alias("idx"), F.col("value").alias("val")), 100), "SELECT event_id AS idx, value AS val FROM events ORDER BY value DESC, event_id LIMIT 100")
_add("topk_pivot", lambda t: order.topk_pivot(t.v, 32, BLOCK),
     _with(_V) + f"SELECT idx // {BLOCK} AS blk, val AS pivot FROM v QUALIFY row_number() OVER (PARTITION BY idx // {BLOCK} ORDER BY val DESC, idx) = 32")


def _mask() -> Column:
    return F.col("val") > 5000


def _split_sql(columns: str, by: str = "val <= 5000") -> str:
    return _with(_V) + f"SELECT row_number() OVER (ORDER BY {by}, idx) - 1 AS pos, {columns} FROM v"


_add("split", lambda t: order.split(t.v.withColumn("mask", _mask()), block=BLOCK).select("pos", "val"), _split_sql("val"))
_add("split_ind", lambda t: order.split(t.v.withColumn("mask", _mask()).withColumn("ind", F.col("idx") + 1), block=BLOCK).select("pos", "val", "ind"), _split_sql("val, idx + 1 AS ind"))
_add("split_zeros_first", lambda t: order.split(t.v.withColumn("mask", _mask()), True, BLOCK).select("pos", "val"), _split_sql("val", "val > 5000"))
_add("bit_extract", lambda t: order.bit_extract(t.v, 3), _with(_V) + "SELECT idx, CAST((val >> 3) & 1 AS INTEGER) AS bit FROM v")

# F: compaction, filters, counts
_PIVOT = 5000


def _compress_sql(columns: str, test: str) -> str:
    return _with(_V) + f"SELECT row_number() OVER (ORDER BY idx) - 1 AS pos, {columns} FROM v WHERE {test}"


_add("compress", lambda t: compact.compress(t.v, _mask(), BLOCK).select("pos", "val"), _compress_sql("val", "val > 5000"))
_add("compress_pos", lambda t: compact.compress(t.v, _mask(), BLOCK, t.v.where(_mask()).count()).select("pos", "val"), _compress_sql("val", "val > 5000"))
_add("compress_ind", lambda t: compact.compress(t.v.withColumn("idx", F.col("idx") * 3), _mask(), BLOCK), _compress_sql("idx * 3 AS idx, val", "val > 5000"))
_add("compress_ind_no_arange", lambda t: t.v.where(_mask()).select("idx", "val"), _with(_V) + "SELECT idx, val FROM v WHERE val > 5000")
_add("filter_ge", lambda t: compact.compress(t.v, compact.compare("ge", _PIVOT), BLOCK).select("pos", "val"), _compress_sql("val", "val >= 5000"))
_add("filter_le", lambda t: compact.compress(t.v, compact.compare("le", _PIVOT), BLOCK).select("pos", "val"), _compress_sql("val", "val <= 5000"))
_add("where_ge", lambda t: compact.where_compare(t.v, "ge", _PIVOT), _with(_V) + "SELECT idx FROM v WHERE val >= 5000")
for _op, _sign in (("lt", "<"), ("gt", ">"), ("eq", "="), ("le", "<="), ("ge", ">="), ("ne", "<>")):
    _add(f"count_if_{_op}", lambda t, op=_op: compact.count_if(t.v, op, _PIVOT), _with(_V) + f"SELECT count(*) FILTER (WHERE val {_sign} 5000) AS n FROM v")
_add("count_if_blocks", lambda t: compact.count_if(t.v, "le", _PIVOT, BLOCK), _with(_V) + f"SELECT idx // {BLOCK} AS blk, count(*) FILTER (WHERE val <= 5000) AS n FROM v GROUP BY 1")
for _op, _sign in (("ge", ">="), ("le", "<=")):
    _add(f"mask_{_op}", lambda t, op=_op: compact.mask_compare(t.v, op, _PIVOT), _with(_V) + f"SELECT idx, CAST(val {_sign} 5000 AS INTEGER) AS mask FROM v")


# G: reductions
def _tiles_sql(tile: int, blocks: int) -> str:
    return _with(_V, f"l AS (SELECT CAST({tile} * ceil(ceil(count(*) / {tile}.0) / {blocks}.0) AS BIGINT) AS len FROM v)", "s AS (SELECT idx // len AS blk, sum(val) AS s FROM v, l GROUP BY 1)") + f"SELECT b AS blk, CAST(coalesce(s, 0) AS BIGINT) AS total FROM range({blocks}) t(b) LEFT JOIN s ON s.blk = b"


_add("reduce_tiles", lambda t: reduce.reduce_tiles(t.v, 512, 40, t.n), _tiles_sql(512, 40))
_add("cube_reduce", lambda t: reduce.reduce_tiles(t.v, 32 * 32, 8, t.n), _tiles_sql(1024, 8))


def _block_sums(v: DataFrame, length: int) -> DataFrame:
    return v.groupBy(F.expr(f"idx div {length}").alias("blk")).agg(F.sum("val").alias("s"))


_add("complete_blocks", lambda t: reduce.complete_blocks(scan.block_scan(t.v, 1000).withColumnRenamed("z", "val"), _block_sums(t.v, 1000), 1000), _scan_sql())
_add("complete_rows", lambda t: reduce.complete_rows(scan.block_scan(t.v, 50).withColumnRenamed("z", "val"), _block_sums(t.v, 1000), 50, 20), _scan_sql())
for _bins in (5, 8, 16, 24, 32):
    _add(f"histogram_{_bins}", lambda t, b=_bins: reduce.histogram(t.v, b),
         _with(_V, "m AS (SELECT min(val) AS lo, max(val) AS hi FROM v)", f"h AS (SELECT CAST(CASE WHEN hi = lo THEN {_bins - 1} ELSE least((val - lo) * {_bins} // (hi - lo), {_bins - 1}) END AS BIGINT) AS bin, count(*) AS n FROM v, m GROUP BY 1)")
         + f"SELECT b AS bin, coalesce(n, 0) AS n FROM range({_bins}) t(b) LEFT JOIN h ON h.bin = b")
_add("reduce_sum", lambda t: t.v.agg(F.sum("val").alias("total")), _with(_V) + "SELECT CAST(sum(val) AS BIGINT) AS total FROM v")
_add("reduce_or", lambda t: t.v.agg(F.bit_or("val").alias("bits")), _with(_V) + "SELECT bit_or(val) AS bits FROM v")

# H: linear algebra
_add("gen_lower", lambda t: linalg.gen_lower(t.spark, 64), "SELECT i, j, CAST(i >= j AS INTEGER) AS val FROM range(64) a(i), range(64) b(j)")
_SIDE = 8


def _square(t: Tables, below: int) -> DataFrame:
    m = F.transform("embedding", lambda e, k: F.when(k % _SIDE > F.floor(k / _SIDE), F.round(e.cast("double") * 4).cast("long")).otherwise(F.lit(below).cast("long")))
    return t.read("embeddings").select(F.col("vec_id").alias("b"), F.slice(m, 1, _SIDE * _SIDE).alias("m"))


_INVERSE = f"""WITH RECURSIVE u AS (
  SELECT vec_id AS b, CAST(k // {_SIDE} AS BIGINT) AS i, CAST(k % {_SIDE} AS BIGINT) AS j, CAST(round(CAST(embedding[k + 1] AS DOUBLE) * 4) AS BIGINT) AS val
  FROM embeddings, range({_SIDE * _SIDE}) t(k) WHERE k % {_SIDE} > k // {_SIDE}),
p AS (
  SELECT 0 AS step, vec_id AS b, i, i AS j, CAST(1 AS BIGINT) AS val FROM embeddings, range({_SIDE}) t(i)
  UNION ALL
  SELECT step + 1, p.b, p.i, u.j, CAST(sum(-p.val * u.val) AS BIGINT) FROM p JOIN u ON p.b = u.b AND p.j = u.i WHERE step < {_SIDE} GROUP BY step + 1, p.b, p.i, u.j)
SELECT vec_id AS b, i, j, CAST(coalesce((SELECT sum(val) FROM p WHERE p.b = e.vec_id AND p.i = a.i AND p.j = c.j), 0) AS {{}}) AS val
FROM embeddings e, range({_SIDE}) a(i), range({_SIDE}) c(j)"""
_add("tri_inv_col_sweep", lambda t: linalg.tri_inverse(_square(t, 5), _SIDE, True), _INVERSE.format("BIGINT"))
_add("tri_inv_cube", lambda t: linalg.tri_inverse(_square(t, 1), _SIDE, False), _INVERSE.format("DOUBLE"))
_add("triu_inv_strict", lambda t: linalg.tri_inverse(_square(t, 0), _SIDE, True), _INVERSE.format("BIGINT"))


def _banded(t: Tables, n: int) -> DataFrame:
    """Unit upper triangles with two small bands above the diagonal: exact inverses of any side."""
    at = F.sequence(F.lit(0), F.lit(n * n - 1))
    band = lambda b, k: F.when((k % n - F.floor(k / n)).isin(1, 2), (F.floor(k / n) + 2 * (k % n) + b) % 3 - 1).otherwise(0).cast("long")
    return t.spark.range(3).select(F.col("id").alias("b"), F.transform(at, lambda k: band(F.col("id"), k)).alias("m"))


_BANDED = """WITH RECURSIVE u AS (
  SELECT b, i, j, CAST((i + 2 * j + b) % 3 - 1 AS BIGINT) AS val FROM range(3) t(b), range({n}) x(i), range({n}) y(j) WHERE j - i IN (1, 2)),
p AS (
  SELECT 0 AS step, b, i, i AS j, CAST(1 AS BIGINT) AS val FROM range(3) t(b), range({n}) x(i)
  UNION ALL
  SELECT step + 1, p.b, p.i, u.j, CAST(sum(-p.val * u.val) AS BIGINT) FROM p JOIN u ON p.b = u.b AND p.j = u.i WHERE step < {n} GROUP BY step + 1, p.b, p.i, u.j),
s AS (SELECT b, i, j, CAST(sum(val) AS BIGINT) AS val FROM p GROUP BY 1, 2, 3)
SELECT t.b, x.i, y.j, coalesce(s.val, 0) AS val FROM range(3) t(b), range({n}) x(i), range({n}) y(j) LEFT JOIN s ON s.b = t.b AND s.i = x.i AND s.j = y.j"""
for _n in (16, 32, 64):
    _add(f"tri_inv_{_n}", lambda t, n=_n: linalg.tri_inverse(_banded(t, n), n, True), _BANDED.replace("{n}", str(_n)))


def _gram(t: Tables) -> DataFrame:
    """Column products of the embeddings: both sides have one row a dimension, so the result has 64 x 64."""
    d = t.dense.select(F.col("col").alias("row"), F.col("row").alias("k"), "val")
    return linalg.matmul_abt(d, d)


_add("matmul_abt", _gram,
     "WITH d AS (SELECT vec_id AS k, CAST(k AS BIGINT) AS i, CAST(round(CAST(embedding[k + 1] AS DOUBLE) * 100) AS BIGINT) AS val FROM embeddings, range(64) t(k)) "
     "SELECT a.i, b.i AS j, CAST(sum(a.val * b.val) AS BIGINT) AS val FROM d a JOIN d b ON a.k = b.k GROUP BY 1, 2")  # fmt: skip

# I: elementwise
_add("vadd", lambda t: element.vadd(t.v, t.v.select("idx", (F.col("val") * 2).alias("val"))), _with(_V) + "SELECT idx, val * 3 AS z FROM v")
_add("diff", lambda t: element.diff(t.v), _with(_V) + "SELECT idx, val - coalesce(lag(val) OVER (ORDER BY idx), 0) AS z FROM v")
_add("diff_max_size", lambda t: element.diff(t.v, 100), _with(_V) + "SELECT idx, val - coalesce(lag(val) OVER (ORDER BY idx), 0) AS z FROM v WHERE idx < 100")
_add("adjacent_diff", lambda t: element.diff(t.v, fill=False), _with(_V) + "SELECT idx, val - lag(val) OVER (ORDER BY idx) AS z FROM v QUALIFY lag(val) OVER (ORDER BY idx) IS NOT NULL")
_add("copy", lambda t: t.v.select("idx", "val"), _with(_V) + "SELECT idx, val FROM v")
_add("pad_tail", lambda t: element.pad_tail(t.v, 768, t.n), _with(_V, "n AS (SELECT count(*) // 768 * 768 AS n FROM v)") + "SELECT i AS idx, coalesce(val, 0) AS val FROM range(768) t(i), n LEFT JOIN v ON v.idx = i + n.n")
_add("pad_zero", lambda t: element.pad_zero(t.v, 768, t.n), _with(_V) + "SELECT i AS idx, coalesce(val, 0) AS val FROM (SELECT unnest(range(CAST(ceil(count(*) / 768.0) * 768 AS BIGINT))) AS i FROM v) LEFT JOIN v ON v.idx = i")


def _vectors(t: Tables) -> DataFrame:
    return t.read("embeddings").select(F.col("vec_id").alias("row"), F.transform("embedding", lambda e: F.round(e.cast("double") * 100).cast("long")).alias("vec"))


_add("pad_batch", lambda t: element.pad_batch(_vectors(t), 80).select("row", F.posexplode("vec").alias("col", "val")),
     "SELECT vec_id AS row, CAST(k AS INTEGER) AS col, coalesce(CAST(round(CAST(embedding[k + 1] AS DOUBLE) * 100) AS BIGINT), 0) AS val FROM embeddings, range(80) t(k)")
_add("unpad_batch", lambda t: element.unpad_batch(element.pad_batch(_vectors(t), 80), 50).select("row", F.posexplode("vec").alias("col", "val")),
     "SELECT vec_id AS row, CAST(k AS INTEGER) AS col, CAST(round(CAST(embedding[k + 1] AS DOUBLE) * 100) AS BIGINT) AS val FROM embeddings, range(50) t(k)")
_add("arange", lambda t: t.spark.range(1000).select((F.lit(5) + F.col("id") * 3).alias("val")), "SELECT 5 + i * 3 AS val FROM range(1000) t(i)")
_add("cast_float", lambda t: t.v.select("idx", F.col("val").cast("double").alias("val")), _with(_V) + "SELECT idx, CAST(val AS DOUBLE) AS val FROM v")
_add("abs", lambda t: t.v.select("idx", F.abs(F.col("val") - 5000).alias("val")), _with(_V) + "SELECT idx, abs(val - 5000) AS val FROM v")

# J: top-p
_TOP_P = _with(_V, "d AS (SELECT *, row_number() OVER w - 1 AS pos, CAST(coalesce(sum(val) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before, sum(val) OVER () AS total FROM v WINDOW w AS (ORDER BY val DESC, idx))", "k AS (SELECT * FROM d WHERE before <= 0.5 * total)")
_add("top_p_set", lambda t: sampling.top_p(t.v, 0.5, BLOCK).select("idx", "before"), _TOP_P + "SELECT idx, before FROM k")


def _weights(t: Tables) -> DataFrame:
    kept = sampling.top_p(t.v, 0.5, BLOCK)
    total = kept.agg(F.sum("val").alias("k"))
    return kept.join(F.broadcast(total)).select("idx", F.round(F.col("val") / F.col("k"), 9).alias("weight"))  # one row


_add("top_p_weights", _weights, _TOP_P + "SELECT idx, round(val / CAST(sum(val) OVER () AS DOUBLE), 9) AS weight FROM k")
_add("top_p_sample", lambda t: sampling.top_p_sample(t.v, 0.5, 0.625), _TOP_P + "SELECT idx FROM (SELECT idx, before, val, 0.625 * sum(val) OVER () AS t FROM k) WHERE before <= t AND t < before + val")
_add("top_p_probabilities", lambda t: sampling.top_p(t.v.select("idx", (F.col("val") / F.lit(float(1 << 20))).alias("val")), 0.5, BLOCK).select("idx", "before"),
     _TOP_P + "SELECT idx, before / 1048576.0::DOUBLE AS before FROM k")

# K: sources
_add("from_table", lambda t: vectors.from_table(t.read("orders").select("o_orderkey", F.col("o_custkey").alias("cust")), "o_orderkey", "cust", width=1024),
     "SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS idx, o_custkey AS val FROM orders")
_add("from_array_column", lambda t: vectors.from_array_column(t.read("embeddings"), "vec_id", "embedding").select("row", "col", F.col("val").cast("double").alias("val")),
     "SELECT vec_id AS row, CAST(k AS BIGINT) AS col, CAST(embedding[k + 1] AS DOUBLE) AS val FROM embeddings, range(64) t(k)")


def _market(t: Tables) -> DataFrame:
    """Orders and customers written as a symmetric Matrix Market file and read back."""
    head = ["%%MatrixMarket matrix coordinate real symmetric", "% a comment", "", "9 9 9"]
    top = t.spark.createDataFrame([(x,) for x in head], "value string").coalesce(1)
    body = t.read("orders").select(F.concat_ws(" ", F.col("o_orderkey") + 1, F.col("o_custkey") + 1, F.format_string("%d.5", F.col("o_orderkey") % 7)).alias("value"))
    return matrices.parse_matrix_market(top.unionAll(body).unionAll(t.spark.createDataFrame([("9 9 9",)], "value string")))


_add("matrix_market", _market,
     "WITH e AS (SELECT o_orderkey AS r, o_custkey AS c, o_orderkey % 7 + 0.5::DOUBLE AS val FROM orders UNION ALL SELECT 8, 8, 9.0::DOUBLE) "
     "SELECT r AS row, c AS col, val FROM e UNION ALL SELECT c, r, val FROM e WHERE r <> c")  # fmt: skip
_add("block_sparse", lambda t: matrices.block_sparse(t.spark, 256, 16, 1, 2, 0),
     "WITH b AS (SELECT i, j FROM range(16) x(i), range(16) y(j) WHERE abs(i - j) <= 1 OR j < 2) "
     "SELECT i * 16 + c // 16 AS row, j * 16 + c % 16 AS col, 1.0::DOUBLE AS val FROM b, range(256) t(c)")  # fmt: skip
_add("random_matrix", lambda t: matrices.random_matrix(t.spark, 1000, 500, 20_000, power=1.0))
