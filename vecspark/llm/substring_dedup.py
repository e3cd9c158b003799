"""Removal of repeated substrings with suffix arrays built by induced sorting, sharded by content."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecspark.llm.common import by_bytes, lean_batches, materialise, text_bytes
from vecspark.llm.words import constants, mix
from vecspark.operators.order import argsort

GRAM = 32  # bytes, a multiple of 8, of the anchors by which windows are dealt to shards
SLOT_BITS = 25
ANCHOR = np.uint64((1 << 40) - 1)  # anchors are counted by so many bits of their hash
SEEN = 500_000  # names of pieces that a task remembers
BLOCK = 1 << 20  # bytes of pieces sorted at once


def _words8(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on, as one integer; beyond the end: zeros."""
    padded = np.r_[data, np.zeros(16, np.uint8)]
    out = np.empty(len(data) + 8, np.uint64)
    for o in range(8):
        part = padded[o : o + (len(padded) - o) // 8 * 8].view("<u8")
        out[o::8] = part[: len(out[o::8])]
    return out[: len(data)]


def _runs(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of windows of `width` bytes, inside one text, with the same least anchor hash: hash, first, count.
    The fourth are the hashes of all grams."""
    n = len(data) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        w, k = _words8(data), constants(GRAM // 8, 7)
        gram = low = mix(sum((w[8 * j : len(data) - GRAM + 1 + 8 * j] * c for j, c in enumerate(k)), np.zeros(len(data) - GRAM + 1, np.uint64)))
    span, done = width - GRAM + 1, 1
    while done * 2 <= span:
        low = np.minimum(low[:-done], low[done:])
        done *= 2
    if span > done:
        low = np.minimum(low[: done - span], low[span - done :])
    inside = np.zeros(len(data) + 1, np.int8)
    ends = np.maximum(offsets[1:] - width + 1, offsets[:-1])
    np.add.at(inside, offsets[:-1], 1)
    np.add.at(inside, ends, -1)
    at = np.flatnonzero(np.cumsum(inside[:n], dtype=np.int8))
    if not len(at):
        return low[:0], at, at, gram
    first = np.flatnonzero(np.r_[True, (np.diff(at) > 1) | (low[at[1:]] != low[at[:-1]])])
    return low[at[first]], at[first], np.diff(np.r_[first, len(at)]), gram


def _anchors(width: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches):
            h, first, n, gram = _runs(*text_bytes(batch.column("text")), width)
            if not len(h):
                continue
            # Each place of an anchor counts: where windows of one run repeat, their anchor stands twice in it.
            size = n + width - GRAM
            ends = np.cumsum(size)
            within = np.repeat(first - (ends - size), size) + np.arange(ends[-1])
            n = np.add.reduceat((gram[within] == np.repeat(h, size)).astype(np.int64), ends - size).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array((h & ANCHOR).view(np.int64)), pa.array(n)], names=["anchor", "n"])

    return run


def _slots(anchor):  # noqa: ANN001, ANN202 - an array or a Column
    """The two bits that stand for an anchor. From its low bits: an anchor is a least hash, so its high bits are mostly 0."""
    high = F.shiftright(anchor, 15) if isinstance(anchor, Column) else anchor >> 15
    return anchor % (1 << SLOT_BITS), (anchor + 2 * high + 1) % (1 << SLOT_BITS)


def _pieces(width: int, slots: np.ndarray, whole: bool) -> Callable:
    """The names of the pieces under runs whose anchor is listed, each with its place; or the pieces with their bytes,
    equal ones once a task, and again where a later row of the task has an earlier place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, tuple] = {}
        for batch in by_bytes(batches):
            data, offsets = text_bytes(batch.column("text"))
            h, first, n, _ = _runs(data, offsets, width)
            good = np.ones(len(h), bool)
            for slot in _slots((h & ANCHOR).astype(np.int64)):
                good &= ((slots[slot >> 6] >> (slot & 63).astype(np.uint64)) & np.uint64(1)) == 1
            h, first, n = h[good], first[good], n[good]
            rows = np.searchsorted(offsets, first, side="right") - 1
            start = (first - offsets[rows]).astype(np.int32)
            docs = batch.column("doc_id").take(pa.array(rows))
            view = data.tobytes()
            pieces = [view[a : a + k + width - 1] for a, k in zip(first.tolist(), n.tolist(), strict=True)]
            names = [_name(p) for p in pieces]
            if not whole:
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), docs, pa.array(start)], names=["name", "doc_id", "start"])
                continue
            keep = []
            for i, place in enumerate(zip(names, docs.to_pylist(), start.tolist(), strict=True)):
                place = (place[1] is not None, place[1] or 0, place[2])
                if names[i] not in seen or place < seen[names[i]]:
                    seen[names[i]] = place
                    keep.append(i)
            if len(seen) > SEEN:
                seen.clear()
            at = pa.array(keep, pa.int64())
            columns = [pa.array(h.astype(np.uint32).view(np.int32)).take(at), docs.take(at), pa.array(start).take(at), pa.array([pieces[i] for i in keep], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["anchor", "doc_id", "start", "piece"])

    return run


def _deal(queues: list[list[np.ndarray]], at: np.ndarray, symbols: np.ndarray) -> None:
    """Append positions to the queue of their symbol, in order."""
    if len(at):
        order = np.argsort(symbols, kind="stable")
        at, symbols = at[order], symbols[order]
        cuts = np.flatnonzero(np.diff(symbols)) + 1
        for part, c in zip(np.split(at, cuts), symbols[np.r_[0, cuts]].tolist(), strict=True):
            queues[c].append(part)


def _induce(text: np.ndarray, is_s: np.ndarray, lms: np.ndarray, size: int) -> np.ndarray:
    """Suffix array from LMS suffixes in order: one sweep up for L suffixes, one down for S suffixes.

    The queues of a sweep hold suffixes by first symbol and leave in order of it; a wave takes all that one symbol's
    queue holds, and what it induces under the same symbol is the next wave, so numpy does the steps of a wave at once.
    """
    empty = np.zeros(0, np.int64)
    seeds: list[list[np.ndarray]] = [[] for _ in range(size)]
    _deal(seeds, lms, text[lms])
    up: list[list[np.ndarray]] = [[] for _ in range(size)]
    low: list[np.ndarray] = []
    for c in range(size):
        wave, mine = np.concatenate(up[c]) if up[c] else empty, []
        while len(wave):
            mine.append(wave)
            p = wave[wave > 0] - 1
            p = p[~is_s[p]]
            same = text[p] == c
            _deal(up, p[~same], text[p[~same]])
            wave = p[same]
        low.append(np.concatenate(mine) if mine else empty)
        for s in seeds[c]:
            p = s[s > 0] - 1
            _deal(up, p, text[p])
    down: list[list[np.ndarray]] = [[] for _ in range(size)]
    out: list[np.ndarray] = []
    for c in range(size - 1, -1, -1):
        wave, mine = np.concatenate(down[c]) if down[c] else empty, []
        if c == 0:
            wave = np.array([len(text) - 1])
        while len(wave):
            mine.append(wave)
            p = wave[wave > 0] - 1
            p = p[is_s[p]]
            same = text[p] == c
            _deal(down, p[~same], text[p[~same]])
            wave = p[same]
        p = low[c][::-1]
        p = p[p > 0] - 1
        p = p[is_s[p]]
        _deal(down, p, text[p])
        out += [*mine, low[c][::-1]]
    return np.concatenate(out)[::-1]


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Order of all suffixes of text, exact in the first `depth` symbols at least.

    text: small integers whose last, 0, stands nowhere else. LMS substrings are sorted by a first induction and named;
    the reduced string of names is ordered by doubling ranks, no further than `depth` symbols reach; a second induction
    carries that order to all suffixes.
    """
    n, size = len(text), int(text.max()) + 1
    step = np.sign(np.diff(text.astype(np.int32)))
    at = np.where(step != 0, np.arange(n - 1), n)
    nxt = np.minimum.accumulate(at[::-1])[::-1] if n > 1 else at
    is_s = np.r_[step[np.minimum(nxt, n - 2)] > 0, True] if n > 1 else np.array([True])
    lms = np.flatnonzero(is_s & np.r_[False, ~is_s[:-1]])
    if not len(lms):
        return np.arange(n)[::-1]
    first = _induce(text, is_s, lms, size)
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    order = first[is_lms[first]]
    length = np.zeros(n, np.int64)
    length[lms] = np.diff(np.r_[lms, n - 1]) + 1
    a, b = order[:-1], order[1:]
    same = length[a] == length[b]
    live, o = np.flatnonzero(same), 0
    while len(live):
        equal = text[a[live] + o] == text[b[live] + o]
        same[live[~equal]] = False
        o += 1
        live = live[equal & (length[a[live]] > o)]
    rank = np.zeros(n, np.int64)
    rank[order] = np.r_[1, 1 + np.cumsum(~same)]
    rank, reach = rank[lms], 1
    while rank.max() < len(rank) and 2 * reach < depth + 4:
        key = rank * (len(rank) + 1) + np.r_[rank[reach:], np.zeros(min(reach, len(rank)), np.int64)][: len(rank)]
        rank = np.unique(key, return_inverse=True)[1] + 1
        reach *= 2
    return _induce(text, is_s, lms[np.argsort(rank, kind="stable")], size)


def _later_windows(pieces: list[bytes], order: np.ndarray, starts: np.ndarray, width: int) -> list[tuple[int, int, int]]:
    """Runs (piece, first byte, end byte) of windows that also stand earlier, by (order of the text, position)."""
    sizes = np.array([len(p) for p in pieces])
    data = np.frombuffer(b"\xff".join(pieces) + b"\xff", np.uint8)  # 0xff is in no UTF-8 text
    text = np.r_[data.astype(np.uint16) + 1, np.uint16(0)]
    begin = np.r_[0, np.cumsum(sizes + 1)[:-1]]
    of = np.repeat(np.arange(len(pieces)), sizes + 1)
    sa = suffix_array(text, width)
    sa = sa[sa < len(data)]
    sa = sa[begin[of[sa]] + sizes[of[sa]] - sa >= width]  # whole windows
    w = _words8(data)
    same = np.ones(max(len(sa) - 1, 0), bool)
    live = np.flatnonzero(same)
    for o in [*range(0, width - 8, 8), width - 8]:  # the common prefix of neighbours, as far as it matters
        equal = w[sa[live] + o] == w[sa[live + 1] + o]
        same[live[~equal]] = False
        live = live[equal]
    heads = np.flatnonzero(np.r_[True, ~same]) if len(sa) else sa
    place = (order[of[sa]] << 32) + starts[of[sa]] + sa - begin[of[sa]]
    least = np.repeat(np.minimum.reduceat(place, heads), np.diff(np.r_[heads, len(sa)])) if len(sa) else place
    late = np.sort(sa[place != least])
    if not len(late):
        return []
    cut = np.flatnonzero(np.diff(late) > 1)
    lo, hi = late[np.r_[0, cut + 1]], late[np.r_[cut, len(late) - 1]]
    return [(int(of[a]), int(a - begin[of[a]]), int(b - begin[of[b]] + width)) for a, b in zip(lo, hi, strict=True)]


def _name(piece: bytes) -> bytes:
    return hashlib.blake2b(piece, digest_size=12).digest()


def _shards(width: int) -> Callable:
    """From pieces in order of anchor, bytes and place: the first place of each piece, with its name, and without a
    name the runs inside pieces that repeat in the same shard."""

    def settle(rows: list[tuple]) -> pa.RecordBatch:
        _, pieces, docs, starts = zip(*rows, strict=True)
        ids = sorted(set(docs), key=lambda x: (x is not None, x))
        at = {d: i for i, d in enumerate(ids)}
        found = _later_windows(list(pieces), np.array([at[d] for d in docs], np.int64), np.array(starts, np.int64), width)
        out = [(None, docs[k], starts[k] + a, starts[k] + b) for k, a, b in found]
        out += [(_name(p), d, s, s + len(p)) for p, d, s in zip(pieces, docs, starts, strict=True)]
        kinds = (pa.binary(), pa.int64(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*out, strict=True), kinds, strict=True)], names=["name", "doc_id", "lo", "hi"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        total, last = 0, (None, None)
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("anchor", "piece", "doc_id", "start")), strict=True):
                if row[:2] == last:
                    continue
                if row[0] != last[0] and total >= BLOCK:
                    yield settle(rows)
                    rows, total = [], 0
                rows.append(row)
                total, last = total + len(row[1]), row[:2]
        if rows:
            yield settle(rows)

    return run


def repeated_spans(docs: DataFrame, width: int = 100, shard_bytes: int = 8 << 20) -> DataFrame:
    """Byte ranges (doc_id, lo, hi), possibly overlapping, under `width`-byte strings that also start earlier.

    Every window of `width` bytes has an anchor, its 32-byte gram of least hash; equal windows have equal anchors, so
    the pieces of text under runs of windows with one anchor can be dealt to shards by anchor and no match is lost.
    Pieces whose anchor stands once in the corpus are left out (a bitmap of fixed size holds two bits for each of the
    others; where it is full, more pieces travel, none fewer). Equal pieces of a task travel once, with their first place, so a passage
    in a third of all documents is one piece a task. A shard keeps the first place of each piece; sorted by anchor,
    about a megabyte of whole anchors at a time gets a suffix array by induced sorting; neighbours that share `width`
    bytes are one string, of which every place but the first is returned. Other places of equal pieces are returned
    whole, by a join on names (96-bit digests) that adaptive execution splits.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(F.octet_length("text") >= width)
    anchors = rows.select("text").mapInArrow(_anchors(width), "anchor long, n int").groupBy("anchor").agg(F.sum("n").alias("n")).where("n > 1")
    bits = anchors.select(F.posexplode(F.array(*_slots(F.col("anchor")))).alias("i", "slot"), "n").withColumn("n", F.when(F.col("i") == 0, F.col("n")))
    words = bits.groupBy(F.expr("slot div 64").alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(slot % 64 as int)))").alias("b"), F.sum("n").alias("n")).toPandas()
    slots = np.zeros(1 << (SLOT_BITS - 6), np.int64)
    slots[words["w"].to_numpy(np.int64)] = words["b"].to_numpy(np.int64)
    slots = slots.view(np.uint64)

    shards = max(8, int(words["n"].fillna(0).sum()) * (width + GRAM) // shard_bytes)
    pieces = rows.mapInArrow(_pieces(width, slots, True), "anchor int, doc_id long, start int, piece binary")
    pieces = pieces.repartition(shards, "anchor").sortWithinPartitions("anchor", "piece", "doc_id", "start")
    found = materialise(pieces.mapInArrow(_shards(width), "name binary, doc_id long, lo long, hi long"), "pieces")
    first = found.where("name IS NOT NULL").select("name", F.col("doc_id").alias("d"), "lo", "hi")
    copies = rows.mapInArrow(_pieces(width, slots, False), "name binary, doc_id long, start int")
    outer = copies.join(first, "name").where(~(F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("start") == F.col("lo"))))
    outer = outer.select("doc_id", F.col("start").cast("long").alias("lo"), (F.col("start") + F.col("hi") - F.col("lo")).alias("hi"))
    return found.where("name IS NULL").select("doc_id", "lo", "hi").unionAll(outer)


def _remove(columns: list[str]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches):
            kept, n, removed, spans = [], [], [], []
            for text, ranges in zip(batch.column("text").to_pylist(), batch.column("_vs_spans").to_pylist(), strict=True):
                data = (text or "").encode()
                out, at, count, end = [], 0, 0, -1
                for lo, hi in sorted((r["lo"], r["hi"]) for r in ranges or ()):
                    if lo > end:
                        count += 1
                        out.append(data[at:lo])
                    end = at = max(end, hi)
                out.append(data[at:])
                left = b"".join(out)
                kept.append(left)
                n.append(len(data))
                removed.append(len(data) - len(left))
                spans.append(count)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(n), pa.array(removed), pa.array(spans), pa.array(kept, pa.binary())], names=[*columns, "n_bytes", "n_removed", "n_spans", "kept"])

    return run


def _numbered(docs: DataFrame) -> DataFrame:
    """docs with _vs_sid: doc_id, or where ids repeat the place of (doc_id, text) among all."""
    ids = docs.select(F.col("doc_id").cast("long").alias("val"))
    if ids.groupBy("val").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        return docs.withColumn("_vs_sid", F.col("doc_id").cast("long"))
    key = F.xxhash64(F.col("text").cast("string"))
    places = docs.select(F.col("doc_id").cast("long").alias("val"), key.alias("idx")).distinct()
    places = materialise(argsort(places), "places")
    places = places.select(F.col("pos").alias("_vs_sid"), F.col("val").alias("_vs_val"), F.col("idx").alias("_vs_idx"))
    both = docs.join(places, F.col("doc_id").cast("long").eqNullSafe(F.col("_vs_val")) & (key == F.col("_vs_idx")))
    return both.drop("_vs_val", "_vs_idx")


def dedup_substrings(docs: DataFrame, width: int = 100) -> DataFrame:
    """Each row of docs with n_bytes, n_removed, n_spans and kept, its text's bytes without repeated_spans.

    A byte goes if a `width`-byte string that covers it also starts earlier: in a smaller doc_id, or before it in the
    same text; strings are those of the input. kept may not be valid UTF-8 where a string begins inside a character.
    Null text is empty. Rows that repeat a doc_id with other texts are documents of their own, in the order of a hash of
    the text; rows that repeat both are one document: what goes from one goes from the other, and they do not count as
    copies of each other. A null doc_id comes first. A very long text is read as a whole by one task. Columns of docs with
    the added names are replaced. No rows in, no rows out.
    """
    lean_batches(docs.sparkSession)
    docs = _numbered(docs.drop("n_bytes", "n_removed", "n_spans", "kept"))
    spans = repeated_spans(docs.select(F.col("_vs_sid").alias("doc_id"), "text"), width).groupBy("doc_id").agg(F.collect_list(F.struct("lo", "hi")).alias("_vs_spans")).withColumnRenamed("doc_id", "_vs_id")
    rows = docs.join(spans, F.col("_vs_sid").eqNullSafe(F.col("_vs_id")), "left").drop("_vs_id", "_vs_sid")
    docs = docs.drop("_vs_sid")
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema]
    return rows.mapInArrow(_remove(docs.columns), ", ".join([*fields, "n_bytes long", "n_removed long", "n_spans long", "kept binary"]))
