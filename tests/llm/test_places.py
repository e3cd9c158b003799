"""Places of shared keys: what they refuse, and that no linked pair is lost."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from vecspark.llm import components
from vecspark.llm.line_dedup import _rare, _shared, edit_distance
from vecspark.llm.words import mix


def _met(key, thing, n, low, place, percent=80):
    """Pairs with enough matches, and sets of things that share a large key."""
    cold = np.zeros(len(key), bool)
    dealt = components.deal(key, thing, n, low, cold, 1, place)
    found = [x for b in components._meet(percent, True)(iter([dealt])) for x in b.to_pylist()]
    pairs, groups = {}, {}
    for x in found:
        if x["key"] is None:
            c, need = pairs.get((x["a"], x["b"]), (0, x["n"]))
            pairs[x["a"], x["b"]] = c + x["c"], min(need, x["n"])
        else:
            groups.setdefault(x["key"], set()).add(x["a"])
    return {p for p, (c, need) in pairs.items() if c >= need}, list(groups.values())


def test_keys_at_far_places_are_no_match():
    key, ones = np.full(3, 7, np.uint64), np.ones(3, np.int64)
    pairs, groups = _met(key, np.array([1, 2, 3]), ones * 20, ones, np.array([0, 2, 15]))
    assert pairs == {(1, 2)} and not groups
    pairs, _ = _met(key, np.array([1, 2, 3]), ones * 20, ones, np.array([0, 2, components.ANYWHERE]))
    assert pairs == {(1, 2), (1, 3), (2, 3)}


def test_only_things_of_like_sizes_make_a_key_large():
    thing = np.arange(60)
    ones = np.ones(60, np.int64)
    pairs, groups = _met(np.full(60, 7, np.uint64), thing, 10 * 2 ** (thing // 10), ones, ones)
    assert len(pairs) == 6 * 45 and not groups
    pairs, groups = _met(np.full(60, 7, np.uint64), thing, np.where(thing < 50, 10, 100), ones, ones)
    assert len(pairs) == 45 and groups == [set(range(50))]


def test_no_linked_pair_is_lost():
    rng = np.random.default_rng(5)
    lines = []
    for _ in range(60):
        line = rng.integers(0, rng.choice([4, 30, 400]), rng.integers(5, 60)).tolist()
        lines.append(line)
        for _ in range(3):
            other = list(line)
            for _ in range(int(rng.integers(1, len(line) // 5 + 1))):
                at, kind = int(rng.integers(0, len(other))), rng.integers(0, 3)
                other[at : at + (kind > 0)] = [int(rng.integers(0, 400))] if kind < 2 else []
            lines.append(other if len(other) >= 5 else line)
    lines = [list(x) for x in {tuple(x) for x in lines}]
    n = np.array([len(x) for x in lines])
    h = mix(np.concatenate(lines).astype(np.uint64) + np.uint64(99))
    for percent in (80, 90, 70):
        gram, line, _, spot, asked = _rare(h, np.r_[0, np.cumsum(n)], percent, np.zeros(1 << 18, np.uint8))
        pairs, groups = _met(gram, line, n[line], asked[line], spot, percent)
        linked = 0
        for i in range(len(lines)):
            for j in range(i + 1, len(lines)):
                most = (100 - percent) * max(n[i], n[j]) // 100
                if edit_distance(lines[i], lines[j], most) <= most:
                    linked += 1
                    assert (i, j) in pairs or any(i in g and j in g for g in groups)
        assert linked > 20


def test_shared_words_of_a_batch():
    x, y = ([[1, 1, 2], [3], [], [5, -1]], [[1, 2, 2], [4], [1], [-1, 5, 5]])
    assert _shared(pa.array(x, pa.list_(pa.int32())), pa.array(y, pa.list_(pa.int32()))).tolist() == [2, 0, 0, 2]
    # A slice has offsets of its own.
    assert _shared(pa.array(x, pa.list_(pa.int32())).slice(3), pa.array(y, pa.list_(pa.int32())).slice(3)).tolist() == [2]
