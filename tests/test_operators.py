"""Hand-checked vectors for every operator family."""

import pytest
from pyspark.sql import functions as F

from vecspark.operators import compact, element, gather, linalg, order, reduce, sampling, scan, segment, sparse
from vecspark.sources import vectors
from vecspark.sources.matrices import block_sparse, random_matrix, read_matrix_market

X = [3, -1, 4, 1, -5, 9, 2, 6, 5, 3]
FLAG = [0, 0, 1, 0, 0, 0, 1, 0, 1, 0]
MASK = [1, 0, 1, 1, 0, 0, 1, 0, 1, 0]


def vec(spark, values, **more):
    rows = [(i, v, *(bool(m[i]) for m in more.values())) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "idx long, val long" + "".join(f", {k} boolean" for k in more))


def got(df, key="idx", value="z"):
    return [r[value] for r in df.orderBy(key).collect()]


@pytest.mark.parametrize(("block", "depth"), [(None, 1), (1, 1), (3, 1), (3, 2), (100, 1)])
def test_scans(spark, block, depth):
    v = vec(spark, X)
    assert got(scan.scan(v, block, depth=depth)) == [3, 2, 6, 7, 2, 11, 13, 19, 24, 27]
    assert got(scan.scan(v, block, 10, depth=depth)) == [13, 12, 16, 17, 12, 21, 23, 29, 34, 37]
    assert got(scan.scan(v, block, exclusive=True, depth=depth)) == [0, 3, 2, 6, 7, 2, 11, 13, 19, 24]
    assert got(scan.scan(v.limit(0), block, depth=depth)) == []


@pytest.mark.parametrize("name", ["scan_single", "scan_starting_sum"])
def test_no_global_window_of_rows(spark, name):
    """Only block totals meet in the window without a partition."""
    from vecspark.plans import queries

    seen = []
    real = scan.scan
    scan.scan = lambda df, block=None, *a, **k: seen.append(block) or real(df, block, *a, **k)
    try:
        queries.QUERIES[name](spark, "/root/testdata/sf0.001")
    finally:
        scan.scan = real
    assert seen == [queries.BLOCK]


def test_block_scan(spark):
    assert got(scan.block_scan(vec(spark, X), 4)) == [3, 2, 6, 7, -5, 4, 6, 12, 5, 8]


@pytest.mark.parametrize("block", [1, 4, 100])
def test_segments(spark, block):
    v = vec(spark, X, flag=FLAG)
    assert got(segment.segment_ids(v, block), value="seg") == [0, 0, 1, 1, 1, 1, 2, 2, 3, 3]
    assert got(segment.seg_scan(v, block)) == [3, 2, 4, 5, 0, 9, 2, 8, 5, 8]
    assert got(segment.seg_scan(vec(spark, X, flag=[0] * 10), block)) == [3, 2, 6, 7, 2, 11, 13, 19, 24, 27]
    assert got(segment.seg_sum_flags(vec(spark, X, end=[0, 1, 0, 0, 0, 1, 0, 1, 0, 1]), block), "seg", "total") == [2, 9, 8, 8]
    ptr = [0, 0, 3, 3, 7, 10, 10]
    seg = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(zip(ptr, ptr[1:], strict=False))], "seg long, start long, end long")
    assert got(segment.seg_sum_indptr(v, seg, block), "seg", "total") == [0, 6, 0, 7, 14, 0]
    starts = spark.createDataFrame([(0, 0), (1, 4), (2, 7)], "seg long, start long")
    assert got(segment.seg_sum_indptr(vec(spark, range(1, 11)), segment.starts_to_segments(starts, 10), block), "seg", "total") == [10, 18, 27]


def test_revert(spark):
    s = spark.createDataFrame(list(zip(range(10), [3, 2, 6, 7, 2, 11, 13, 19, 24, 27], [0, 0, 1, 1, 1, 1, 2, 2, 3, 3], strict=True)), "idx long, scan_x long, seg long")
    d = spark.createDataFrame([(0, 2), (1, 11), (2, 19), (3, 27)], "seg long, diff long")
    assert got(segment.seg_scan_revert(s, d)) == [3, 2, 4, 5, 0, 9, 2, 8, 5, 8]


@pytest.mark.parametrize("block", [1, 3, 100])
def test_compaction_and_split(spark, block):
    v = vec(spark, X, mask=MASK)
    out = compact.compress(v, block=block).orderBy("pos").collect()
    assert [(r.pos, r.idx, r.val) for r in out] == [(0, 0, 3), (1, 2, 4), (2, 3, 1), (3, 6, 2), (4, 8, 5)]
    assert got(order.split(v, block=block), "pos", "val") == [3, 4, 1, 2, 5, -1, -5, 9, 6, 3]
    assert got(order.split(v, True, block), "pos", "idx") == [1, 4, 5, 7, 9, 0, 2, 3, 6, 8]
    assert got(compact.compress(v, compact.compare("le", 3), block), "pos", "val") == [3, -1, 1, -5, 2, 3]
    assert compact.compress(v, F.lit(False), block).count() == 0
    assert compact.compress(v, block=block, expect=5).count() == 5
    with pytest.raises(Exception, match="expected 4"):
        compact.compress(v, block=block, expect=4).collect()


def test_counts_and_nan(spark):
    v = vec(spark, X)
    assert [compact.count_if(v, op, 3).first().n for op in ("lt", "gt", "eq", "le", "ge", "ne")] == [4, 4, 2, 6, 6, 8]
    nan = spark.createDataFrame([(0, float("nan")), (1, 1.0)], "idx long, val double")
    assert [compact.count_if(nan, op, 1.0).first().n for op in ("lt", "gt", "eq", "le", "ge", "ne")] == [0, 0, 1, 1, 1, 1]
    assert got(compact.where_compare(v, "ge", 3), value="idx") == [0, 2, 5, 7, 8, 9]


def test_order(spark):
    v = vec(spark, X)
    for width in (1, 4, 1000):
        assert got(order.argsort(v, width), "pos", "idx") == [4, 1, 3, 6, 0, 9, 2, 8, 7, 5]
    assert [(r.idx, r.val) for r in order.topk(v, 4).collect()] == [(5, 9), (7, 6), (8, 5), (2, 4)]
    assert [(r.blk, r.pivot) for r in order.topk_pivot(v, 2, 5).orderBy("blk").collect()] == [(0, 3), (1, 6)]
    assert got(order.bit_extract(vec(spark, [5, 8, -1]), 3), value="bit") == [0, 1, 1]


def test_lookups(spark):
    hay = spark.createDataFrame([(k,) for k in [0, 0, 2, 2, 2, 5, 9, 9, 10]], "key long")
    needles = spark.createDataFrame(list(enumerate([-1, 0, 1, 2, 3, 5, 8, 9, 10, 11])), "needle_id long, needle long")
    for width in (1, 4, 1000):
        assert got(gather.searchsorted(hay, needles, width), "needle_id", "pos") == [0, 0, 2, 2, 5, 5, 6, 6, 8, 9]
    values = spark.createDataFrame([(i, 11 + i) for i in range(9)], "pos long, val long")
    idxs = spark.createDataFrame(list(enumerate([0, 0, 2, 5, 5, 5, 9, 9])), "idx long, pos long")
    assert got(gather.gather_minus_one(idxs, values)) == [0, 0, 12, 15, 15, 15, 19, 19]
    assert got(gather.gather(idxs.where("pos < 9"), values)) == [11, 11, 13, 16, 16, 16]
    with pytest.raises(Exception, match="out of bounds"):
        gather.gather(idxs, values).collect()


def test_sparse(spark):
    entries = [(0, 0, 2), (0, 2, 1), (2, 1, 3), (3, 0, 4), (3, 1, 5), (3, 2, 6)]
    a = spark.createDataFrame([(i, *e) for i, e in enumerate(entries)], "idx long, row long, col long, val long")
    x = spark.createDataFrame([(0, 1), (1, 2), (2, 3)], "col long, x long")
    rows = spark.range(4).withColumnRenamed("id", "row")
    assert got(sparse.spmv(a, x, rows), "row", "y") == [5, 0, 6, 32]
    assert got(sparse.spmv_via_scan(a, x, rows, 2), "row", "y") == [5, 0, 6, 32]


def test_spmm(spark):
    """Products move before they are summed, but for rows of many entries, whose sums are few."""
    entries = [(i % 7 if i % 3 else None, i % 5, i) for i in range(60)] + [(9, i % 5, i) for i in range(200)]
    a = spark.createDataFrame(entries, "row long, col long, val long")
    b = spark.createDataFrame([(c, j, c + 10 * j) for c in range(4) for j in range(3)], "col long, j long, x long")
    want = {}
    for row, col, val in entries:
        for j in range(3 if col < 4 else 0):
            want[row, j] = want.get((row, j), 0) + val * (col + 10 * j)
    assert sparse._heavy_rows(a, 260, 100) == [9]
    for sums in (1, 15, 100, 1 << 20):
        out = sparse.spmm(a, b, sums)
        assert out.count() == len(want) and {(r.row, r.j): r.y for r in out.collect()} == want
    tree = out._jdf.queryExecution().executedPlan().toString()
    assert tree.split("Exchange")[0].count("HashAggregate") == 2
    assert sparse.spmm(a.limit(0), b).count() == 0 == sparse.spmm(a, b.limit(0)).count()


def test_reductions(spark):
    v = vec(spark, X)
    assert got(reduce.reduce_tiles(v, 2, 4, 10), "blk", "total") == [7, 12, 8, 0]
    assert got(reduce.histogram(v, 7), "bin", "n") == [1, 0, 1, 2, 3, 2, 1]
    assert got(reduce.histogram(vec(spark, [4, 4]), 3), "bin", "n") == [0, 0, 2]
    sums = spark.createDataFrame([(0, 10), (1, 26)], "blk long, s long")
    assert got(reduce.complete_blocks(vec(spark, range(1, 9)), sums, 4)) == [1, 2, 3, 4, 15, 16, 17, 18]
    assert got(reduce.complete_rows(vec(spark, [1, 3, 3, 7, 5, 11, 7, 15]), sums, 2, 2)) == [1, 3, 6, 10, 15, 21, 28, 36]


def test_linalg(spark):
    m = spark.createDataFrame([(0, [9, 1, 2, 7, 9, 3, 7, 7, 9])], "b long, m array<long>")
    assert got(linalg.tri_inverse(m, 3, True).withColumn("k", F.col("i") * 3 + F.col("j")), "k", "val") == [1, -1, 1, 0, 1, -3, 0, 0, 1]
    a = spark.createDataFrame([(0, 0, 1), (0, 1, 2), (1, 0, 3), (1, 1, 4)], "row long, k long, val long")
    b = spark.createDataFrame([(0, 0, 5), (0, 1, 6), (1, 0, 7), (1, 1, 8), (2, 0, 9), (2, 1, 10)], "row long, k long, val long")
    assert got(linalg.matmul_abt(a, b).withColumn("k", F.col("i") * 3 + F.col("j")), "k", "val") == [17, 23, 29, 39, 53, 67]
    assert linalg.gen_lower(spark, 3).agg(F.sum("val")).first()[0] == 6


def test_elementwise(spark):
    v = vec(spark, X)
    assert got(element.diff(v)) == [3, -4, 5, -3, -6, 14, -7, 4, -1, -2]
    assert got(element.diff(v, 3)) == [3, -4, 5]
    assert got(element.diff(v, fill=False)) == [-4, 5, -3, -6, 14, -7, 4, -1, -2]
    assert got(element.pad_tail(v, 4, 10), value="val") == [5, 3, 0, 0]
    assert got(element.pad_zero(v, 4, 10), value="val") == [*X, 0, 0]
    assert got(element.vadd(v, v)) == [2 * x for x in X]


def test_top_p(spark):
    v = vec(spark, [5, 40, 10, 30, 15])
    assert sorted(r.idx for r in sampling.top_p(v, 0.5).collect()) == [1, 3]
    assert [r.idx for r in sampling.top_p_sample(v, 0.5, 0.6).collect()] == [3]


def test_sources(spark, tmp_path):
    f = tmp_path / "m.mtx"
    f.write_text("%%MatrixMarket matrix coordinate real symmetric\n% note\n3 3 2\n2 1 4.5\n3 3 1\n")
    assert sorted((r.row, r.col, r.val) for r in read_matrix_market(spark, str(f)).collect()) == [(0, 1, 4.5), (1, 0, 4.5), (2, 2, 1.0)]
    r = random_matrix(spark, 10, 20, 50, power=1.0)
    assert r.count() == 50 and r.where("row between 0 and 9 and col between 0 and 19").count() == 50
    assert block_sparse(spark, 8, 2, 0, 1, 0).count() == 4 * (1 + 3 * 2)


def test_argsort_any_numbers(spark):
    values = [2.5, None, float("nan"), -1.0, 2.5, float("inf"), None, -0.0, 0.0, -1e300]
    df = spark.createDataFrame(list(enumerate(values)), "idx long, val double")
    for width in (1, 2, 3, 100):
        assert got(order.argsort(df, width), "pos", "idx") == [1, 6, 9, 3, 7, 8, 0, 4, 5, 2]
    wide = spark.createDataFrame([(0, 2**62), (1, -(2**62)), (2, 2**62 + 1), (3, 2**62)], "idx long, val long")
    assert got(order.argsort(wide, 1), "pos", "idx") == [1, 0, 3, 2]
    same = spark.range(1000).select(F.col("id").alias("idx"), F.lit(7).alias("val"))
    assert got(order.argsort(same, 64), "pos", "idx") == list(range(1000))


def test_probabilities(spark):
    df = spark.createDataFrame([(0, 0.125), (1, 0.5), (2, None), (3, 0.25), (4, 0.125)], "idx long, val double")
    assert sorted(r.idx for r in sampling.top_p(df, 0.7, 2).collect()) == [1, 3]


def test_seg_scan_one_segment(spark):
    v = vec(spark, X, flag=[0] * 10)
    assert got(segment.seg_scan(v, 3)) == [3, 2, 6, 7, 2, 11, 13, 19, 24, 27]


def test_matrix_market_size_line_again(spark, tmp_path):
    f = tmp_path / "m.mtx"
    f.write_text("%%MatrixMarket matrix coordinate integer general\n3 3 2\n3 3 2\n1 2 5\n")
    assert sorted((r.row, r.col, r.val) for r in read_matrix_market(spark, str(f)).collect()) == [(0, 1, 5.0), (2, 2, 2.0)]


def test_from_table(spark):
    df = spark.createDataFrame([(30, "c"), (10, "a"), (20, "b"), (None, "z")], "k long, v string")
    for width in (1, 2, 100):
        assert got(vectors.from_table(df, "k", "v", width=width), "idx", "val") == ["z", "a", "b", "c"]
