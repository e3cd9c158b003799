"""Keys of many things: what is settled at the key, what is told of it, and how the rest meets leaders."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.test_places import _met
from tests.llm.test_sketches import _things
from vecspark.llm import components
from vecspark.llm.line_dedup import PAIR_BITS, PARITY, _alike, _pair, _rare, _room
from vecspark.llm.words import mix


def test_a_crowd_of_few_matches_is_settled_at_its_key():
    """Six hundred lines that share a pair of words, thirty of them with a near copy: before, six hundred rows of a large key."""
    rng = np.random.default_rng(6)
    lines = [[1, 2, *rng.integers(3, 10**9, 10).tolist()] for _ in range(600)]
    near = [[*x[:-1], 7] for x in lines[:30]]
    thing, ones = _things(lines + near), np.ones(630, np.int64)
    pairs, groups = _met(np.full(630, 7, np.uint64), thing, ones * 12, ones, ones * 0)
    wanted = {tuple(sorted((int(thing[i]), int(thing[600 + i])))) for i in range(30)}
    assert not groups and wanted <= pairs and len(pairs) < 630 * components.SMALL // 2


def test_blocks_of_a_crowd_lose_no_pair(monkeypatch):
    """Sizes from 10 to 5000 words in one key, few pairs looked at at once: the same as one by one."""
    monkeypatch.setattr(components, "PAIRS", 64)
    rng = np.random.default_rng(8)
    n = np.sort(rng.integers(10, 30, 150))
    n[-20:] = rng.integers(4000, 5000, 20)
    thing = (rng.integers(0, 1 << 24, 150) << components.NAME_BITS) | rng.permutation(150)
    place = rng.integers(0, 9, 150)
    pairs, groups = _met(np.full(150, 7, np.uint64), thing, n, np.ones(150, np.int64), place)
    want = set()
    for i in range(150):
        for j in range(i + 1, 150):
            longer, by = max(n[i], n[j]), abs(n[i] - n[j])
            p, q = (i, j) if n[i] <= n[j] else (j, i)
            edits, shift = longer // 5, place[p] - place[q]
            if (longer - by) * 5 >= longer * 4 and int((thing[i] ^ thing[j]) >> 32).bit_count() <= 2 * edits - by and abs(shift) + abs(-by - shift) <= edits:
                want.add((min(int(thing[i]), int(thing[j])), max(int(thing[i]), int(thing[j]))))
    assert not groups and pairs == want and len(want) > 50


def test_repeated_pairs_are_one_token_with_their_number():
    """Two lines of one word: before, a token for each of hundreds of repeats; the matches stay as many."""
    h = mix(np.array([5] * 400 + [5] * 360, np.uint64))
    begin, n = np.array([0, 400, 760]), np.array([400, 360])
    levels = np.full(1 << 18, 9, np.uint8)
    gram, line, _, spot, times, asked = _rare(h, begin, 80, levels, once=True)
    each = _rare(h, begin, 80, levels)
    assert line.tolist() == [0, 1] and gram[0] == gram[1] and times.tolist() == np.bincount(each[1]).tolist() and asked.tolist() == each[4].tolist()
    dealt = components.deal(gram, line, n[line], asked[line], np.zeros(2, bool), 1, spot, times)
    (found,) = [x for b in components._meet(80, True)(iter([dealt])) for x in b.to_pylist()]
    assert found["c"] == times.min() >= found["n"] == asked.min() > 1


def test_a_counted_passage_comes_last_in_the_prefix():
    """A passage of rare words that stands in many lines: its pairs look rare by their words and are not."""
    h = mix(np.arange(40, dtype=np.uint64) + np.uint64(3))
    levels = np.full(1 << 18, 30, np.uint8)
    levels[(h[:9] >> np.uint64(46)).astype(np.int64)] = 2
    table = np.zeros(1 << PAIR_BITS, np.uint8)
    passage = _pair(h, np.arange(8))
    table[(passage >> np.uint64(64 - PAIR_BITS)).astype(np.int64)] = 40
    told = lambda pairs: set(_rare(h, np.array([0, 40]), 80, levels, pairs=pairs, once=True)[0].tolist())
    assert set(passage.tolist()) <= told(None) and not set(passage.tolist()) & told((table, 60, 20))
    assert len(told(None)) == len(told((table, 60, 20)))


@pytest.mark.parametrize("cells", [(16384, 1024), (7, 3)])
def test_rows_meet_leaders_by_arrays_as_in_the_join(spark, monkeypatch, cells):
    monkeypatch.setattr(components, "ROWS", cells[0])
    monkeypatch.setattr(components, "LEADS", cells[1])
    rng = np.random.default_rng(9)
    name = lambda i: bytes(mix(np.array([i, i + 1000], np.uint64)).tobytes())
    bits = rng.integers(-(1 << 63), 1 << 63, (6, 4))
    rows = []
    for key in (1, 2):
        for i in range(key * 5, 60):
            p = bits[i % 6] ^ (1 << rng.integers(0, 63, 4))
            rows.append((key, [-7, 1][: i // 3 % 3] if key == 2 else [], name(i), name(i % 9), int(20 + i % 4), *p.tolist(), name(key * 5), 60 - key * 5, bool(i % 3 == 0)))
    where = spark.createDataFrame(rows, "key long, before array<long>, name binary, comp binary, n int, p0 long, p1 long, p2 long, p3 long, first binary, size long, leads boolean")
    joined = components._meetings(where, where.where("leads"), lambda x, y: _room(x, y, 80)).distinct()
    beside = components._beside(where, F.lit(20), PARITY, _alike(80)).distinct()
    pairs = lambda f: {(bytes(r.a), bytes(r.b)) for r in f.collect()}
    assert pairs(joined) == pairs(beside) and 20 < joined.count() < 1000 and beside.where(F.col("a") >= F.col("b")).isEmpty()
