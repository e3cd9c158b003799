"""Fuzzy line dedup: multi-match prefixes of rare word pairs, edit similarity, connected groups."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecspark.llm.common import by_bytes, condensed, lean_batches, materialise, text_bytes
from vecspark.llm.components import ANYWHERE, BUCKET, MANY, NAME_BITS, candidates, deal, in_slots, listed, similar_components, slots_of
from vecspark.llm.words import NOT_WORD, constants, mix, span_hashes, words

SKETCH_BITS = 18  # of the counters of word frequency: their size is fixed whatever the corpus
PAIR_BITS = 21  # the same for pairs of words
CROWDED = 3  # times the mean of its counters that a pair stands at least, if the counter is its own
PARTS = 16  # in which the counters move
SEEN = 500_000  # names of lines that a task remembers
BATCH = 1 << 19  # bytes of text that a task works on at once
DEALT = 250_000  # tokens that a task deals at once
HOT = 250_000  # occurrences that a word may have, besides its share, before its pairs leave their buckets
_NEWLINE = 10


def _lines(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes of a batch, the line each word is in, and of each line with words: its row and number."""
    data, offsets = text_bytes(batch.column("text"))
    starts, ends, rows = words(data, offsets, NOT_WORD)
    h = span_hashes(data, starts, ends)
    breaks = np.flatnonzero(data == _NEWLINE)
    number = np.cumsum(np.bincount(np.searchsorted(starts, breaks), minlength=len(starts) + 1)[:-1]) - np.searchsorted(breaks, offsets)[rows]
    if not len(h):
        return h, starts, rows, number
    begin = np.flatnonzero(np.r_[True, (np.diff(rows) != 0) | (np.diff(number) != 0)])
    return h, np.r_[begin, len(h)], rows[begin], number[begin]


def _keys(h: np.ndarray, begin: np.ndarray) -> list[bytes]:
    """A 128-bit name of each line's word sequence."""
    with np.errstate(over="ignore"):
        place = np.arange(len(h)) - np.repeat(begin[:-1], np.diff(begin))
        out = []
        for seed in constants(2, 5):
            weight = mix(place.astype(np.uint64) + seed) | np.uint64(1)
            out.append(mix(np.add.reduceat(mix(h ^ seed) * weight, begin[:-1]) + np.diff(begin).astype(np.uint64)))
    both = np.stack(out, axis=1).tobytes()
    return [both[i : i + 16] for i in range(0, len(both), 16)]


#: Columns of a 256-bit parity sketch of a line: bit b tells whether an odd number of its words hash to b. Two sketches
#: differ in at most as many bits as the bags of words differ in words, so it refuses pairs without error.
PARITY = [f"p{j}" for j in range(4)]


def _parity(h: np.ndarray, begin: np.ndarray) -> list[pa.Array]:
    with np.errstate(over="ignore"):
        at = mix(h ^ np.uint64(0x3C))
    bit, word = np.uint64(1) << (at & np.uint64(63)), (at >> np.uint64(6)) & np.uint64(3)
    zero = np.uint64(0)
    return [pa.array(np.bitwise_xor.reduceat(np.where(word == j, bit, zero), begin[:-1]).view(np.int64)) for j in range(len(PARITY))]


def _room(x: str, y: str, percent: int) -> Column:
    """Whether lengths and sketches of x and y leave room for an edit similarity of percent/100.

    Of at most d edits, those that change the length change the bag by one word, the others by two.
    """
    n, m = F.col(f"{x}.n"), F.col(f"{y}.n")
    most = F.floor(F.greatest(n, m) * (100 - percent) / 100)
    differ = sum((F.bit_count(F.col(f"{x}.{c}").bitwiseXOR(F.col(f"{y}.{c}"))) for c in PARITY), F.lit(0))
    return (F.least(n, m) * 100 >= F.greatest(n, m) * percent) & (differ <= 2 * most - F.abs(n - m))


def _alike(percent: int):  # noqa: ANN202
    """_room on arrays."""

    def alike(n: np.ndarray, m: np.ndarray, s: list[np.ndarray], t: list[np.ndarray]) -> np.ndarray:
        longer, by = np.maximum(n, m), np.abs(n - m)
        # Of a signed integer, bitwise_count counts the bits of its absolute value.
        differ = sum((np.bitwise_count((x ^ y).view(np.uint64)).astype(np.int16) for x, y in zip(s, t, strict=True)), np.int16(0))
        return ((longer - by) * 100 >= longer * percent) & (differ <= 2 * (longer * (100 - percent) // 100) - by)

    return alike


_NAMES = ["id", "head", "doc_id", "key", "line", "part", "counts"]
_OCCURRENCES = "id binary, head long, doc_id long, key long, line int, part int, counts binary"


def _occurrences(shortest: int):  # noqa: ANN202
    """Lines of `shortest` words or more; and after them, a part a row, the words and word pairs of all lines counted by hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, pairs = np.zeros(1 << SKETCH_BITS, np.int64), np.zeros(1 << PAIR_BITS, np.uint32)
        for batch in by_bytes(batches, limit=BATCH):
            h, begin, row, number = _lines(batch)
            if not len(h):
                continue
            total += np.bincount((h >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=len(total))
            inside = np.ones(len(h), bool)
            inside[begin[1:] - 1] = False
            inside = np.flatnonzero(inside)
            np.add.at(pairs, (_pair(h, inside) >> np.uint64(64 - PAIR_BITS)).astype(np.int64), np.uint32(1))
            keys = _keys(h, begin)
            at = np.flatnonzero(np.diff(begin) >= shortest)
            yield pa.RecordBatch.from_arrays([pa.array([keys[i] for i in at], pa.binary()), pa.array(_ids(keys, h, begin)[at]), batch.column("doc_id").take(pa.array(row[at])), batch.column("key").take(pa.array(row[at])), pa.array(number[at].astype(np.int32)), pa.nulls(len(at), pa.int32()), pa.nulls(len(at), pa.binary())], names=_NAMES)
        if total.any():
            parts = [x.tobytes() for x in total.reshape(PARTS, -1)] + [np.ascontiguousarray(x.view(np.uint8).reshape(-1, 4).T).tobytes() for x in pairs.reshape(PARTS, -1)]
            parts = [zstandard.ZstdCompressor(level=1).compress(x) for x in parts]
            empty = [pa.nulls(len(parts), kind) for kind in (pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int32())]
            yield pa.RecordBatch.from_arrays([*empty, pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.binary())], names=_NAMES)

    return run


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts summed: of words as counts, of pairs (parts PARTS and on) as levels."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, blob in zip(batch.column("part").to_pylist(), batch.column("counts").to_pylist(), strict=True):
            data = zstandard.ZstdDecompressor().decompress(blob)
            if part >= PARTS:
                data = np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).tobytes()
            sums[part] = sums.get(part, 0) + np.frombuffer(data, np.uint32 if part >= PARTS else np.int64).astype(np.int64)
    out = [(_level(x) if part >= PARTS else x).tobytes() for part, x in sums.items()]
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(out, pa.binary())], names=["part", "counts"])


def _level(count: np.ndarray) -> np.ndarray:
    return (2 * np.log2(1 + count)).astype(np.uint8)


def _counts(seen: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Words of all lines in 2**SKETCH_BITS counters by hash, and the levels of their pairs in 2**PAIR_BITS counters."""
    rows = seen.where("part IS NOT NULL").select("part", "counts").repartition(PARTS, "part").mapInArrow(_summed, "part int, counts binary").collect()
    out = np.zeros((PARTS, (1 << SKETCH_BITS) // PARTS), np.int64)
    pairs = np.zeros((PARTS, (1 << PAIR_BITS) // PARTS), np.uint8)
    for part, counts in rows:
        if part < PARTS:
            out[part] = np.frombuffer(counts, np.int64)
        else:
            pairs[part - PARTS] = np.frombuffer(counts, np.uint8)
    return out.reshape(-1), pairs.reshape(-1)


def _pair(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A hash of the words at `at` and of those that follow."""
    with np.errstate(over="ignore"):
        return mix(mix(h[at]) + h[at + 1])


def _rare(h: np.ndarray, begin: np.ndarray, percent: int, levels: np.ndarray, hot: int | None = None, pairs: tuple[np.ndarray, int, int] | None = None, once: bool = False) -> tuple[np.ndarray, ...]:
    """Prefix of each line's bag of word pairs, rare ones first: names, lines, levels, places (ANYWHERE for a pair that
    stands more than once in its line: any of them may be the one that edits leave); and the matches each line asks for.

    With m = n + j words in the partner, d edits of max(n, m) * (100 - percent) / 100 at most destroy up to 2 d of the
    n - 1 pairs of a line, or 2 d - j if the partner is longer, for j insertions destroy one pair each. Most are lost at
    one of j = 0..4 if percent is 80 or more, and a pair is left then; below that single words take the place of pairs,
    of which no more than n * (100 - percent) / 100 are lost. So lines that link share l pairs, the lesser of what they
    ask for, within prefixes of l more than can be lost; l is n / 16 + 1, but no more than must be left. A pair that
    stands k times in a line is k pairs. Of a pair of words above the level `hot` only the first of the k is told: its
    matches are not counted, and lines that share another of the k share the first. With `once` that goes for all pairs,
    and how many of the k are in the prefix is returned before the last.

    How rare a pair is follows from the levels of its words, as if these stood independently; `pairs` are levels of counted
    pairs, the level of all words and the level from which a counter tells the pair itself, as it is where a passage stands
    in many lines: such pairs come last.
    """
    n = np.diff(begin)
    line = np.repeat(np.arange(len(n)), n)
    level = levels[(h >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)].astype(np.int64)
    common = level
    edits = lambda m: m * (100 - percent) // 100
    if percent >= 80:
        lost, size = np.max([2 * edits(n + j) - j for j in range(5)], axis=0), n - 1
        inside = np.flatnonzero(line[1:] == line[:-1])
        gram = _pair(h, inside)
        common = np.minimum(level[inside], level[inside + 1])
        level, line = level[inside] + level[inside + 1], line[inside]
        if pairs is not None:
            table, every, own = pairs
            counted = table[(gram >> np.uint64(64 - PAIR_BITS)).astype(np.int64)].astype(np.int64)
            common = np.minimum(common, counted)
            level = np.where(counted >= own, counted + every, np.minimum(level, counted + every))
    else:
        lost, gram, size = edits(n), mix(h), n
    asked = np.clip(n // 16 + 1, 1, np.clip(size - lost, 1, MANY))
    if not len(gram):
        return (gram, line, common, line, line, asked) if once else (gram, line, common, line, asked)
    spot = (inside if percent >= 80 else np.arange(len(h))) - begin[line]
    # One integer sorts by line, level and the head of the name; should two names of a line agree in that, they sort in full.
    packed = (line.astype(np.uint64) << np.uint64(44)) | (level.astype(np.uint64) << np.uint64(36)) | (gram >> np.uint64(28))
    order = np.argsort(packed)
    again = packed[order[1:]] == packed[order[:-1]]
    if len(n) >= 1 << 20 or (again & (gram[order[1:]] != gram[order[:-1]])).any():
        order = np.lexsort((gram, level, line))
    gram, line, common, spot = gram[order], line[order], common[order], spot[order]
    first = np.searchsorted(line, np.arange(len(n)))
    place = np.arange(len(line))
    new = np.r_[True, (gram[1:] != gram[:-1]) | (line[1:] != line[:-1]), True]
    run = np.maximum.accumulate(np.where(new[:-1], place, 0))
    spot = np.where(new[:-1] & new[1:], np.minimum(spot, ANYWHERE), ANYWHERE)
    keep = place - first[line] < (lost + asked)[line]
    if once:
        first = np.flatnonzero(new[:-1])
        times = np.add.reduceat(keep.astype(np.int64), first)
        first, times = first[times > 0], times[times > 0]
        return gram[first], line[first], common[first], spot[first], times, asked
    with np.errstate(over="ignore"):
        gram = gram + (place - run).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    if hot is not None:
        keep &= (common <= hot) | (place == run)
    return gram[keep], line[keep], common[keep], spot[keep], asked


def _ids(keys: list[bytes], h: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """56 bits a line: a parity sketch of 24 bits, like PARITY, over 32 bits of its name. Two lines that meet by chance are
    candidates with each other's partners, no more."""
    with np.errstate(over="ignore"):
        bit = np.int64(1 << NAME_BITS) << (mix(h ^ np.uint64(0x3C)) % np.uint64(24)).astype(np.int64)
    return np.bitwise_xor.reduceat(bit, begin[:-1]) | (np.frombuffer(b"".join(keys), np.int64)[::2] & ((1 << NAME_BITS) - 1))


def _prefixes(fewest: int, percent: int, levels: np.ndarray, hot: int, pairs: tuple[np.ndarray, int, int], buckets: int):  # noqa: ANN202
    """The dealt word pairs of the prefixes of lines; equal lines of a task once, and equal pairs of a line."""

    def dealt(held: list) -> pa.RecordBatch:
        gram, thing, n, low, common, spot, times = (np.concatenate(x) for x in zip(*held, strict=True))
        return deal(gram, thing, n, low, common, buckets, spot, times)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told: set[bytes] = set()
        held, size = [], 0
        for batch in by_bytes(batches, limit=BATCH):
            h, begin, _, _ = _lines(batch)
            if not len(h):
                continue
            keys, n = _keys(h, begin), np.diff(begin)
            use = n >= fewest
            for i in np.flatnonzero(use).tolist():
                use[i] = keys[i] not in told
                if len(told) < SEEN:
                    told.add(keys[i])
            gram, line, common, spot, times, asked = _rare(h, begin, percent, levels, pairs=pairs, once=True)
            keep = use[line]
            line = line[keep]
            held.append((gram[keep], _ids(keys, h, begin)[line], n[line].astype(np.int32), asked[line].astype(np.int32), common[keep] > hot, spot[keep].astype(np.uint16), times[keep]))
            size += len(line)
            if size >= DEALT:
                yield dealt(held)
                held, size = [], 0
        if size:
            yield dealt(held)

    return run


def _fetched(fewest: int, rows: np.ndarray, lines: np.ndarray):  # noqa: ANN202
    """Name, id, length, sketch and 32-bit word hashes of lines whose slot is set, from documents whose slot is set; equal
    ones once a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_bytes(iter([batch.filter(pa.array(in_slots(rows, batch.column("key").to_numpy())))]), limit=BATCH):
                h, begin, _, _ = _lines(part)
                if not len(h):
                    continue
                keys, n = _keys(h, begin), np.diff(begin)
                ids = _ids(keys, h, begin)
                good = (n >= fewest) & in_slots(lines, ids)
                mine = pa.array(list({keys[i]: i for i in np.flatnonzero(good).tolist()}.values()), pa.int64())
                short = (h >> np.uint64(32)).astype(np.uint32).view(np.int32)
                columns = {"name": pa.array(keys, pa.binary()), "id": pa.array(ids), "n": pa.array(n.astype(np.int32)), **dict(zip(PARITY, _parity(h, begin), strict=True)), "words": pa.ListArray.from_arrays(pa.array(begin.astype(np.int32)), pa.array(short))}
                yield pa.RecordBatch.from_arrays([c.take(mine) for c in columns.values()], names=list(columns))

    return run


def edit_distance(a: list[int], b: list[int], most: int) -> int:
    """Levenshtein distance of two word sequences, or most + 1 if it is larger: furthest points on each diagonal."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > most:
        return most + 1
    first, last = 0, len(a)
    while first < last and a[first] == b[first]:
        first += 1
    while last > first and a[last - 1] == b[last - 1 + len(b) - len(a)]:
        last -= 1
    a, b = a[first:last], b[first : last + len(b) - len(a)]
    n, m = len(a), len(b)
    if not n:
        return m
    reach = {0: -1}  # diagonal (j - i) -> furthest i reached, one step before the first round
    for d in range(most + 1):
        new = {}
        for k in range(max(-d, -n), min(d, m) + 1):
            i = 0 if d == 0 else max(reach.get(k, -2) + 1, reach.get(k - 1, -2), reach.get(k + 1, -2) + 1)
            i = min(i, n, m - k)
            if i < 0 or i + k < 0:
                continue
            while i < n and i + k < m and a[i] == b[i + k]:
                i += 1
            new[k] = i
        if new.get(m - n, -1) == n:
            return d
        reach = new
    return most + 1


def _shared(x: pa.ListArray, y: pa.ListArray) -> np.ndarray:
    """Size of the common multiset of the words of x and of y, row by row."""
    names, sides = [], []
    for column, side in ((x, 1), (y, 1 << 32)):
        row = np.repeat(np.arange(len(column), dtype=np.uint64), np.diff(column.offsets.to_numpy()))
        names.append((row << np.uint64(32)) | column.flatten().to_numpy().view(np.uint32))
        sides.append(np.full(len(row), side, np.int64))
    names, sides = np.concatenate(names), np.concatenate(sides)
    if not len(names):
        return np.zeros(len(x), np.int64)
    order = np.argsort(names)
    names = names[order]
    first = np.flatnonzero(np.r_[True, names[1:] != names[:-1]])
    count = np.add.reduceat(sides[order], first)
    both = np.minimum(count & 0xFFFFFFFF, count >> 32)
    return np.bincount((names[first] >> np.uint64(32)).astype(np.int64), weights=both, minlength=len(x)).astype(np.int64)


def _verify(percent: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, 1000) for b in batches for i in range(0, b.num_rows, 1000)):
            x, y, good = batch.column("u"), batch.column("v"), []
            longest = np.maximum(*(np.diff(c.offsets.to_numpy()) for c in (x, y)))
            most = (100 - percent) * longest // 100
            # Each edit changes the multiset of words by two at most.
            for i in np.flatnonzero(longest - _shared(x, y) <= most).tolist():
                if edit_distance(x[i].values.to_numpy().tolist(), y[i].values.to_numpy().tolist(), int(most[i])) <= most[i]:
                    good.append(i)
            if good:
                yield batch.select(["a", "b"]).take(pa.array(good))

    return run


def repeated_lines(docs: DataFrame, percent: int = 80, fewest: int = 5, shortest: int | None = None) -> DataFrame:
    """Line occurrences to remove: (doc_id, key, lines array<int>), line numbers from 0, of documents that lose any; key is
    xxhash64 of the text.

    A line, parted by newlines, is normalised to its words: letters and digits, A-Z lowered. Lines of fewer than
    `shortest` words (if None: `fewest`) are left alone. Equal word sequences are one line. Two lines of `fewest` words
    or more are linked if they have an edit similarity over words (1 - distance / longer length) of percent/100, without
    exception: candidates share enough of their rarest pairs of successive words, of which so many are compared that
    edits can't destroy too many (see _rare). Of each connected group the first occurrence by doc_id and line stays.

    Rows that repeat a doc_id with other texts are documents of their own, ordered by key; rows that repeat doc_id and
    text are one document and share what goes. A null doc_id comes first. Null and empty texts have no lines. A line that
    a third of the documents share is one counted row before any join; the join back to its occurrences is one that
    adaptive execution splits. A very long text is read as a whole by one task, a few times its size in memory; a very
    long line is verified at a cost of its length times the edits allowed. No rows in, no rows out.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("key"), F.col("text").cast("string").alias("text"))
    lean_batches(docs.sparkSession)
    return condensed(docs.sparkSession, lambda: _repeated(docs, percent, fewest, fewest if shortest is None else shortest), "repeated-line-numbers")


def _repeated(docs: DataFrame, percent: int, fewest: int, shortest: int) -> DataFrame:
    seen = materialise(docs.mapInArrow(_occurrences(shortest), _OCCURRENCES), "line-occurrences")
    counts, pair_levels = _counts(seen)
    seen = seen.where("id IS NOT NULL").drop("part", "counts")
    lines = materialise(seen.groupBy("id").agg(F.count(F.lit(1)).alias("k"), F.min(F.struct("doc_id", "key", "line")).alias("first"), F.first("head").alias("head")), "lines")
    total = int(counts.sum())
    buckets = max(8, total * (2 * (100 - percent) + 6) // 100 // BUCKET)
    # Words count one more than pairs a line; for a mean that is no matter.
    known = (pair_levels, int(_level(np.array(total))), int(_level(np.array(CROWDED * total / (1 << PAIR_BITS)))) + 1)
    hot = int(_level(np.array(total / 4096 + HOT)))
    dealt = docs.select("text").mapInArrow(_prefixes(fewest, percent, _level(counts), hot, known, buckets), "bucket int, tokens binary")
    pairs, rows = candidates(dealt, buckets, percent, placed=True)
    pairs = materialise(pairs, "candidates")
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).union(rows.select("id")).distinct()
    ids = materialise(ids, "listed")
    slots = slots_of(ids, "id")  # of lines that may link: only these meet pairs and labels, and by chance of slots a few others
    likely = listed(slots, "head")
    wanted = lines.select("head", "first.key").mapInArrow(likely, "head long, key long")
    schema = "name binary, id long, n int" + "".join(f", {c} long" for c in PARITY) + ", words array<int>"
    prints = docs.select("key", "text").mapInArrow(_fetched(fewest, slots_of(wanted, "key"), slots), schema)
    prints = materialise(prints.groupBy("name").agg(*[F.first(c).alias(c) for c in ("id", "n", *PARITY, "words")]), "line-prints")

    def judge(pairs: DataFrame) -> DataFrame:
        """The pairs that are alike, by their words."""
        if pairs.isEmpty():
            return pairs
        asked = pairs.select(F.explode(F.array("a", "b")).alias("name")).distinct()
        some = prints.select("name", "words", F.xxhash64("name").alias("slot"))
        some = some.mapInArrow(listed(slots_of(asked.select(F.xxhash64("name").alias("slot")), "slot"), "slot"), some.schema)
        some = materialise(some.drop("slot").join(asked, "name"), "line-words")
        s, t = some.alias("s"), some.alias("t")
        both = pairs.join(s, F.col("a") == F.col("s.name")).join(t, F.col("b") == F.col("t.name"))
        return both.select("a", "b", F.col("s.words").alias("u"), F.col("t.words").alias("v")).mapInArrow(_verify(percent), "a binary, b binary")

    labels = similar_components(pairs, rows, prints.drop("words"), PARITY, lambda x, y: _room(x, y, percent), judge, start=4, alike=_alike(percent))
    # A line that stands once and links with none stays.
    some = lines.where("k > 1").unionAll(lines.where("k = 1").mapInArrow(likely, lines.schema))
    groups = some.join(labels, F.col("id") == F.col("v"), "left").select("id", "head", "k", "first", F.coalesce("component", "id").alias("group"))
    stays = groups.groupBy("group").agg(F.min("first").alias("stays"), F.sum("k").alias("k")).where("k > 1")
    gone = materialise(groups.select("id", "head", "group").join(stays, "group").select("id", "head", "stays"), "repeated-lines")
    seen = seen.select("id", "head", "doc_id", "key", "line").mapInArrow(listed(slots_of(gone, "head"), "head"), "id binary, head long, doc_id long, key long, line int")
    out = seen.drop("head").join(gone.drop("head"), "id")
    out = out.where(~F.struct("doc_id", "key", "line").eqNullSafe(F.col("stays")))
    return out.groupBy("doc_id", "key").agg(F.array_sort(F.collect_set("line")).alias("lines"))


def _cut(columns: list[str], others: np.ndarray | None = None):  # noqa: ANN202
    """Texts without the lines listed with them; with `others`, the texts whose slot is not set, as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, limit=1 << 21):
            gone_lines = [None] * batch.num_rows if others is not None else batch.column("_vs_lines").to_pylist()
            if others is not None:
                batch = batch.filter(pa.array(~in_slots(others, batch.column("_vs_text_key").to_numpy())))
            texts, all_lines, lost = batch.column("text").to_pylist(), [], []
            for i, gone in enumerate(gone_lines[: batch.num_rows]):
                lines = (texts[i] or "").split("\n")
                all_lines.append(len(lines) if texts[i] else 0)
                lost.append(len(gone or ()))
                if gone:
                    gone = set(gone)
                    texts[i] = "\n".join(x for j, x in enumerate(lines) if j not in gone)
            out = [pa.array(texts, pa.string()) if c == "text" else batch.column(c) for c in columns]
            yield pa.RecordBatch.from_arrays([*out, pa.array(all_lines, pa.int32()), pa.array(lost, pa.int32())], names=[*columns, "n_lines", "n_removed"])

    return run


def dedup_lines(docs: DataFrame, percent: int = 80, fewest: int = 5, shortest: int | None = None) -> DataFrame:
    """docs without the line occurrences of repeated_lines, with n_lines (before) and n_removed.

    Every row stays, also one that loses all its lines: its text is then empty. Columns of docs called n_lines or
    n_removed are replaced; a null text stays null.
    """
    docs = docs.drop("n_lines", "n_removed")
    gone = repeated_lines(docs, percent, fewest, shortest).select(F.col("doc_id").alias("_vs_id"), F.col("key").alias("_vs_key"), F.col("lines").alias("_vs_lines"))
    # Only texts whose slot is set can lose a line and are shuffled to meet their lines; the others stay where they are.
    slots = slots_of(gone, "_vs_key")
    keyed = docs.withColumn("_vs_text_key", F.xxhash64(F.col("text").cast("string")))
    some = keyed.mapInArrow(listed(slots, "_vs_text_key"), keyed.schema)
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("_vs_id")) & (F.col("_vs_text_key") == F.col("_vs_key"))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema]
    schema = ", ".join([*fields, "n_lines int", "n_removed int"])
    cut = some.join(gone, same, "left").mapInArrow(_cut(docs.columns), schema)
    return cut.unionAll(keyed.mapInArrow(_cut(docs.columns, slots), schema))
