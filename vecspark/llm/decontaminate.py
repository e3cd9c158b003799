"""Benchmark decontamination by greedy string tiling."""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecspark.llm.common import by_bytes, lean_batches, text_bytes
from vecspark.llm.words import NOT_WORD, constants, mix, span_hashes, words

_MULTIPLIER = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def _rolling(tokens: list[int], free: list[bool], size: int) -> Iterator[tuple[int, int]]:
    """Start and Karp-Rabin hash of every window of `size` unmarked tokens, each rolled from the one before."""
    top = pow(_MULTIPLIER, size, 1 << 64)
    h = run = 0
    for i, token in enumerate(tokens):
        if not free[i]:
            h = run = 0
            continue
        h = (h * _MULTIPLIER + token) & _MASK
        run += 1
        if run > size:
            h = (h - tokens[i - size] * top) & _MASK
        if run >= size:
            yield i - size + 1, h


def _cut(item_free: list[bool], text_free: list[bool], i: int, j: int, n: int) -> list[tuple[int, int]]:
    """Offset and length of the runs of a match that no tile has marked."""
    out, begin = [], None
    for k in range(n + 1):
        if k < n and item_free[i + k] and text_free[j + k]:
            begin = k if begin is None else begin
        elif begin is not None:
            out.append((begin, k - begin))
            begin = None
    return out


def greedy_tiles(item: list[int], text: list[int], least: int) -> list[tuple[int, int, int]]:
    """Tiles (item start, text start, length) of at least `least` tokens: longest matches first, of equal ones the first in
    the item and then in the text, none overlapping; sorted.

    Each pass looks for matches of a size or more by Karp-Rabin and takes the longest of what tiles have left of them;
    then the size is halved. Only matches that go on to neither side are extended, so repetitive texts cost their product.
    """
    free_item, free_text = [True] * len(item), [True] * len(text)
    tiles: list[tuple[int, int, int]] = []
    size = max(least, len(item))
    while size >= least:
        at: dict[int, list[int]] = {}
        for i, h in _rolling(item, free_item, size):
            at.setdefault(h, []).append(i)
        found = []
        for j, h in _rolling(text, free_text, size) if at else ():
            for i in at.get(h, ()):
                if i and j and free_item[i - 1] and free_text[j - 1] and item[i - 1] == text[j - 1]:
                    continue
                if item[i : i + size] == text[j : j + size]:
                    n = size
                    while i + n < len(item) and j + n < len(text) and free_item[i + n] and free_text[j + n] and item[i + n] == text[j + n]:
                        n += 1
                    found.append((-n, i, j))
        heapq.heapify(found)
        while found:
            n, i, j = heapq.heappop(found)
            left = _cut(free_item, free_text, i, j, -n)
            if left == [(0, -n)]:
                tiles.append((i, j, -n))
                free_item[i : i - n] = [False] * -n
                free_text[j : j - n] = [False] * -n
                continue
            for k, m in left:
                if m >= size:
                    heapq.heappush(found, (-m, i + k, j + k))
        size = size // 2 if size > 2 * least else least if size > least else size - 1
    return sorted(tiles)


def _tokens(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = text_bytes(batch.column("text"))
    starts, ends, rows = words(data, offsets, NOT_WORD)
    return span_hashes(data, starts, ends), rows


def _seeds(h: np.ndarray, rows: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of `least` tokens inside a text, and where it starts."""
    n = len(h) - least + 1
    if n <= 0:
        return h[:0], rows[:0]
    with np.errstate(over="ignore"):
        total = sum((h[j : j + n] * c for j, c in enumerate(constants(least, 3))), np.zeros(n, np.uint64))
    at = np.flatnonzero(rows[:n] == rows[least - 1 :])
    return mix(total[at]), at


def _search(items: pa.RecordBatch, least: int, coverage: float, fewest: int) -> Callable:
    h, rows = _tokens(items)
    bounds = np.searchsorted(rows, np.arange(items.num_rows + 1))
    seed, at = _seeds(h, rows, least)
    order = np.argsort(seed, kind="stable")
    seed, at = seed[order], at[order]
    ids = items.column("item_id").to_pylist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches):
            doc_ids, keys, out = batch.column("doc_id"), batch.column("key"), []
            w, row = _tokens(batch)
            mine, start = _seeds(w, row, least)
            lo, hi = np.searchsorted(seed, mine, "left"), np.searchsorted(seed, mine, "right")
            hit = np.flatnonzero(hi > lo)
            n = hi[hit] - lo[hit]
            which = np.repeat(lo[hit], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            doc_at, item_at = np.repeat(start[hit], n), at[which]
            pair = row[doc_at] * np.int64(items.num_rows) + rows[item_at] if len(doc_at) else doc_at
            order = np.argsort(pair, kind="stable")
            cuts = np.flatnonzero(np.r_[True, np.diff(pair[order]) != 0]) if len(order) else []
            for group in np.split(order, cuts[1:]) if len(order) else ():
                k, r = int(rows[item_at[group[0]]]), int(row[doc_at[group[0]]])
                size = int(bounds[k + 1] - bounds[k])
                # Tiles lie inside what the shared seeds cover, so this bound refuses without error.
                covered = np.zeros(size + least, bool)
                for j in range(least):
                    covered[item_at[group] - bounds[k] + j] = True
                if covered.sum() < coverage * size:
                    continue
                places = np.unique((doc_at[group][:, None] + np.arange(least)).ravel())
                text = w[places].astype(object)
                gaps = np.flatnonzero(np.diff(places) > 1) + 1
                text = np.insert(text, gaps, [-1 - size - 2 * len(places) - int(g) for g in gaps])
                back = np.insert(places, gaps, -1)
                first = int(np.searchsorted(row, r))
                tiles = greedy_tiles([int(x) for x in h[bounds[k] : bounds[k + 1]]], [int(x) for x in text], least)
                total = sum(t[2] for t in tiles)
                if total >= coverage * size if size >= fewest else (len(tiles), total) == (1, size):
                    spans = [{"item_start": i, "doc_start": int(back[j]) - first, "length": n} for i, j, n in tiles]
                    out.append((doc_ids[r].as_py(), keys[r].as_py(), ids[k], size, total, total / size, spans))
            if out:
                columns = list(zip(*out, strict=True))
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.list_(pa.struct([("item_start", pa.int32()), ("doc_start", pa.int32()), ("length", pa.int32())]))]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["doc_id", "key", "item_id", "item_words", "covered", "coverage", "tiles"])

    return run


def contaminated(docs: DataFrame, benchmark: DataFrame, least: int = 3, coverage: float = 0.8, fewest: int = 8, block_bytes: int = 32 << 20) -> DataFrame:
    """Documents that hold a benchmark item: (doc_id, key, item_id, item_words, covered, coverage, tiles); key: xxhash64 of the text.

    Words are runs of letters and digits, A-Z lowered. A document and an item that share a run of `least` words are a
    candidate; greedy string tiling then covers the item with the longest common runs of at least `least` words, no
    word used twice, found by running Karp-Rabin. A pair is returned if the tiles cover `coverage` of the item, in
    whatever order they stand in the document. Items of fewer than `fewest` words would be covered by chance: they must
    stand in the document as a whole, as one tile. An item of fewer than `least` words has no tile and matches nothing.

    The benchmark is sent to the tasks in blocks: its size is measured, and beyond block_bytes each block of items
    passes over the documents in turn, so no more than a block is ever held. Documents need no shuffle.

    Null and empty texts match nothing; a null doc_id or item_id is returned as it is. Each row of docs is searched
    alone, so repeated rows give repeated pairs. Of a very long text only the words that shared seeds cover are tiled; if
    they repeat, the cost is their number times the item's. An empty benchmark or no documents give no rows.
    """
    lean_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("key"), F.col("text").cast("string").alias("text"))
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-total // block_bytes))
    schema = "doc_id long, key long, item_id long, item_words int, covered int, coverage double, tiles array<struct<item_start: int, doc_start: int, length: int>>"
    out = None
    for i in range(blocks):
        block = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == i).toPandas()
        batch = pa.RecordBatch.from_arrays([pa.array(block["item_id"].astype("Int64")), pa.array(block["text"], pa.string())], names=["item_id", "text"])
        h, r = _tokens(batch)
        batch = batch.filter(pa.array(np.bincount(r, minlength=batch.num_rows) >= least))
        found = rows.mapInArrow(_search(batch, least, coverage, fewest), schema)
        out = found if out is None else out.unionAll(found)
    return out
