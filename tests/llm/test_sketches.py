"""Sketches in the names of lines: what they refuse, that no linked pair is lost, and what a crowd gives."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tests.llm.test_places import _met
from vecspark.llm import components
from vecspark.llm.line_dedup import _ids, _keys, edit_distance
from vecspark.llm.words import mix


def _things(lines):
    h = mix(np.concatenate(lines).astype(np.uint64) + np.uint64(7))
    begin = np.r_[0, np.cumsum([len(x) for x in lines])]
    return _ids(_keys(h, begin), h, begin)


def test_sketches_of_linked_lines_leave_room():
    rng = np.random.default_rng(3)
    for _ in range(300):
        x = rng.integers(0, 50, rng.integers(5, 40)).tolist()
        y = list(x)
        for _ in range(len(x) // 5):
            at, kind = int(rng.integers(0, len(y))), rng.integers(0, 3)
            y[at : at + (kind > 0)] = [int(rng.integers(0, 50))] if kind < 2 else []
        most = 20 * max(len(x), len(y)) // 100
        if edit_distance(x, y, most) <= most:
            a, b = _things([x, y]) >> components.NAME_BITS
            assert int(a ^ b).bit_count() <= 2 * most - abs(len(x) - len(y))


def test_a_key_of_unlike_lines_gives_neither_pairs_nor_rows():
    """A hundred lines that share a pair of words and no more: before, 4950 pairs or a hundred rows."""
    rng = np.random.default_rng(4)
    lines = [[1, 2, *rng.integers(3, 10**9, 6).tolist()] for _ in range(100)]
    ones = np.ones(100, np.int64)
    pairs, groups = _met(np.full(100, 7, np.uint64), _things(lines), ones * 8, ones, ones * 0)
    assert len(pairs) < 50 and not groups


def test_a_crowd_of_like_lines_gives_rows():
    lines = [[1, 2, 3, 4, 5, 6, 7, 8, 9, i + 10] for i in range(60)]
    ones = np.ones(60, np.int64)
    thing = _things(lines)
    pairs, groups = _met(np.full(60, 7, np.uint64), thing, ones * 10, ones, ones)
    assert not pairs and groups == [set(thing.tolist())]


def test_leaders(spark):
    """The first by name always leads; of a small key all do; of a large one about k."""
    rows = [(1, b"%04d" % i, b"0000", 1000) for i in range(1000)] + [(2, b"%04d" % i, b"0003", 7) for i in range(3, 10)]
    where = spark.createDataFrame(rows, "key long, name binary, first binary, size long")
    count = lambda k: {r.key: (r.n, r.low) for r in components._led(where, k).where("leads").groupBy("key").agg(F.count("*").alias("n"), F.min("name").alias("low")).collect()}
    assert count(1) == {1: (1, b"0000"), 2: (1, b"0003")}
    many = count(64)
    assert many[2] == (7, b"0003") and 30 < many[1][0] < 110 and many[1][1] == b"0000"
