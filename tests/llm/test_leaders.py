"""Large keys: what their rows name, what is told once, and how few rounds settle them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tests.llm.test_sketches import _things
from vecspark.llm import components
from vecspark.llm.line_dedup import _rare
from vecspark.llm.words import mix


def test_rows_of_a_large_key_name_a_leader():
    """Two families of sixty near copies that share a pair of words: all but a few rows name one of their own family."""
    lines = [[1, 2, *(f * 100 + w for w in range(10, 30)), 10_000 + i] for f in (0, 1) for i in range(60)]
    thing, ones = _things(lines), np.ones(120, np.int64)
    dealt = components.deal(np.full(120, 7, np.uint64), thing, ones * 23, ones, np.zeros(120, bool), 1, ones)
    rows = [x for b in components._meet(80, True)(iter([dealt])) for x in b.to_pylist() if x["key"] is not None]
    family = {t: i // 60 for i, t in enumerate(thing.tolist())}
    led = [x for x in rows if x["b"] is not None]
    assert {x["a"] for x in rows} == set(family) and len({x["b"] for x in led}) <= 2 * components.LEADERS
    assert sum(family[x["a"]] == family[x["b"]] for x in led) > 90


def test_a_repeated_pair_of_frequent_words_is_told_once():
    n = 40
    h = mix(np.array([1, 2] * (n // 2), np.uint64))
    levels = np.full(1 << 18, 9, np.uint8)
    every = _rare(h, np.array([0, n]), 80, levels, 9)
    once = _rare(h, np.array([0, n]), 80, levels, 8)
    assert len(set(every[0].tolist())) == len(every[0]) > 10 and len(once[0]) == 1 and set(once[0].tolist()) < set(every[0].tolist())


def test_a_key_of_one_component_and_few_others_is_settled_at_once(spark):
    """Three hundred things of a key, linked but for three: they meet all others in one round, not in three."""
    name = lambda i: b"%03d" % i
    rows = spark.createDataFrame([(1, i, 5) for i in range(300)], "key long, id long, n int")
    prints = spark.createDataFrame([(i, name(i), 5, 0) for i in range(300)], "id long, name binary, n int, p0 long")
    pairs = spark.createDataFrame([(i, 0) for i in range(1, 297)], "a long, b long")
    met = []

    def judge(p):
        met.append({(bytes(r.a), bytes(r.b)) for r in p.collect()})
        return p.where(~(F.col("b") >= F.lit(name(297)))) if len(met) == 1 else p.where((F.col("a") == F.lit(name(8))) & (F.col("b") == F.lit(name(298))))

    out = {bytes(r.v): bytes(r.component) for r in components.similar_components(pairs, rows, prints, ["p0"], lambda x, y: F.lit(True), judge).collect()}
    assert len(met) == 2 and met[1] == {(name(i), name(j)) for i in range(300) for j in (297, 298, 299) if i < j}
    assert set(out) == {name(i) for i in range(297)} | {name(298)} and set(out.values()) == {name(0)}
