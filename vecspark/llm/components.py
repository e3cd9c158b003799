"""Connected components, and groups of similar things: candidates by shared keys, judged without a group's all pairs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecspark.llm.common import give_back, materialise, text_bytes
from vecspark.llm.words import mix

#: Keys held by so many things or fewer give all their pairs at once: no more than 16 pairs a row. Larger ones go to
#: similar_components().
SMALL = 32
#: The same where tokens have places and sketches, which refuse most pairs at once; only things of sizes that allow a link
#: count. A key that gives more than SMALL / 2 pairs a row goes to similar_components() all the same.
CROWD = 8192
#: Pairs of a crowd that are looked at at once.
PAIRS = 1 << 18
#: Rows and leaders of a large key that meet in one cell.
ROWS, LEADS = 16384, 1024
#: Tokens of a bucket on the average; a bucket is read as a whole by one task.
BUCKET = 250_000
#: Keys of a thing that each of its rows may know, the smallest ones: 64 bytes a row for any number of keys.
LOWEST = 8
_KEY_BYTES = 5


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """One row (v, component) for each vertex of a link; component is its smallest reachable vertex.

    Each round hangs every vertex under the neighbour (or itself) of least hashed rank, contracts the links and
    drops those inside a vertex. Ranks are pseudo-random, so chains shrink by a constant factor a round too, and
    no vertex's neighbours are ever gathered: the minimum is pre-aggregated. Self links and nulls add no vertex.
    """
    rank = lambda c: F.struct(F.xxhash64(c).alias("r"), F.col(c).alias("v"))
    one = links.select(F.col(a).alias("s"), F.col(b).alias("d")).where("s <> d")
    edges = materialise(one.union(one.select("d", "s")).distinct(), "links")
    labels = edges.select(F.col("s").alias("v")).distinct().withColumn("label", F.col("v"))
    while not edges.isEmpty():
        up = edges.groupBy("s").agg(F.min(rank("d")).alias("low")).select(F.col("s").alias("x"), F.least(rank("s"), F.col("low"))["v"].alias("up"))
        up = materialise(up, "parents")
        two = up.alias("p").join(up.alias("q"), F.col("p.up") == F.col("q.x")).select(F.col("p.x").alias("x"), F.col("q.up").alias("up"))
        two = materialise(two, "parents2")
        labels = labels.join(two, F.col("label") == F.col("x"), "left").select("v", F.coalesce("up", "label").alias("label"))
        labels = materialise(labels, "labels")
        edges = (
            edges.join(two, F.col("s") == F.col("x")).select(F.col("up").alias("s"), "d")
            .join(two, F.col("d") == F.col("x")).select("s", F.col("up").alias("d"))
            .where("s <> d").distinct()
        )
        edges = materialise(edges, "links")
    least = labels.groupBy("label").agg(F.min("v").alias("component"))
    return materialise(labels.join(least, "label").select("v", "component"), "components")


_PLACED_KEY_BYTES, _PLACED_THING_BYTES = 4, 7
#: Bits of a placed thing that name it; the rest is its sketch.
NAME_BITS = 32
ANYWHERE = 0xFFFF  # the place of a key that a thing holds more than once, or too far from its beginning
MANY = 0xFFFF  # times that a token can tell, so nothing may ask for more matches


def deal(key: np.ndarray, thing: np.ndarray, n: np.ndarray, low: np.ndarray, hot: np.ndarray, buckets: int, place: np.ndarray | None = None, times: np.ndarray | None = None) -> pa.RecordBatch:
    """Rows (bucket int, tokens binary) of a batch's tokens, those of one bucket together, so that they move packed.

    A token says that the thing (64-bit id), of size n, holds the key, and that `low` keys must be shared with it. Keys
    are told apart by bucket and 40 bits: a chance meeting of two adds a candidate and takes none away. Hot keys get
    negative buckets, spread by thing. For sequences, `place` (16 bits, or ANYWHERE) tells where in its thing the key stands
    and `times` (16 bits, if None: 1) how often: two things match there as often as the one with fewer. Their things have
    56 bits, the upper 24 a parity sketch of the words, and 32 bits of a key are enough.
    """
    h = mix(key.astype(np.uint64))
    bucket = np.where(hot, -1 - (mix(thing.view(np.uint64)) >> np.uint64(40)).astype(np.int64) % buckets, (h >> np.uint64(24)).astype(np.int64) % buckets)
    if place is None:
        order = np.argsort(bucket.astype(np.int16) if buckets < 1 << 15 else bucket, kind="stable")
    else:  # tokens of one size together, so that sizes pack well
        order = np.argsort((bucket << 24) + np.minimum(n, (1 << 24) - 1))
        times = np.ones(len(key), np.uint16) if times is None else np.minimum(times[order], MANY).astype(np.uint16)
        place = place[order].astype(np.uint16)
    bucket, h, thing, n, low = bucket[order], h[order], thing[order], n[order], low[order]
    cut = np.flatnonzero(np.r_[True, np.diff(bucket) != 0, True]) if len(bucket) else np.zeros(1, np.int64)
    squeeze = zstandard.ZstdCompressor(level=1).compress
    planes = lambda a, width: np.ascontiguousarray(a.view(np.uint8).reshape(len(a), -1)[:, :width].T).tobytes()
    rows = []
    for i, j in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        names = planes(np.diff(thing[i:j], prepend=np.int64(0)), 8) if place is None else planes(thing[i:j], _PLACED_THING_BYTES)
        where = b"" if place is None else planes(place[i:j], 2) + planes(times[i:j], 2)
        rows.append(squeeze(planes(h[i:j], _KEY_BYTES if place is None else _PLACED_KEY_BYTES) + names + planes(n[i:j].astype(np.int32), 4) + planes(low[i:j].astype(np.int32), 4) + where))
    return pa.RecordBatch.from_arrays([pa.array(bucket[cut[:-1]].astype(np.int32)), pa.array(rows, pa.binary())], names=["bucket", "tokens"])


def _dealt(blobs: list[bytes], placed: bool) -> list[np.ndarray]:
    """Keys, things, sizes, least matches and, if they have them, places and times of packed tokens."""
    parts, kinds = [], [(_PLACED_KEY_BYTES if placed else _KEY_BYTES, np.int64), (_PLACED_THING_BYTES if placed else 8, np.int64), (4, np.int32), (4, np.int32), *[(2, np.int32), (2, np.int32)] * placed]
    unpack = zstandard.ZstdDecompressor().decompress
    for blob in blobs:
        data = np.frombuffer(unpack(blob), np.uint8)
        count, at, columns = len(data) // sum(width for width, _ in kinds), 0, []
        for width, kind in kinds:
            full = np.zeros((count, np.dtype(kind).itemsize), np.uint8)
            full[:, :width] = data[at : at + width * count].reshape(width, count).T
            columns.append(full.reshape(-1).view(kind))
            at += width * count
        if not placed:
            columns[1] = np.cumsum(columns[1])
        parts.append(columns)
    return [np.concatenate(c) for c in zip(*parts, strict=True)]


_FOUND = "key long, a long, b long, n int, c int"
#: Leaders that the things of a large key with places are shown to before they meet.
LEADERS = 16


def _found(key, a, b, n, c) -> pa.RecordBatch:  # noqa: ANN001
    return pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(n, pa.int32()), pa.array(c, pa.int32())], names=["key", "a", "b", "n", "c"])


def _leader(group: np.ndarray, thing: np.ndarray, at: np.ndarray, like: Callable[[np.ndarray, np.ndarray, bool], np.ndarray]) -> np.ndarray:
    """For the places `at`, of whole groups, the place of a leader of its group that it is like, or -1: leaders are the least
    by hash of those without one, so the same in all keys that some things share. First near copies find their leader,
    then leaders and the rest look for one that they are like at all."""
    out = np.full(len(group), -1, np.int64)
    at_first = at[np.lexsort((mix(thing[at].view(np.uint64)), group[at]))]
    for close in (True, False):
        left = at_first[out[at_first] < 0]
        for _ in range(LEADERS):
            if not len(left):
                break
            new = np.r_[True, group[left[1:]] != group[left[:-1]]]
            head = left[new][np.cumsum(new) - 1]
            rest, good = left != head, like(left, head, close)
            out[left[rest & good]] = head[rest & good]
            left = left[rest & ~good]
    return out[at]


def _meet(percent: int, placed: bool) -> Callable:
    """From tokens in order of bucket: pairs (a, b, n: matches asked for, c: matches here) whose sizes allow percent/100,
    and the rows (key, a, n) of keys with more than SMALL things.

    If tokens have places, those of one key stand in order of size: only keys of which some CROWD things follow a thing
    within percent/100 of its size are large, or that have more than SMALL / 2 matches a row, and each stretch of sizes
    without a wider gap is a key by itself. A key at place i of x words and at j of y is a match only if the words before
    and those after it can be made equal by the edits allowed: |i - j| + |(x - i) - (y - j)| of them at least; and if the
    sketches differ in no more bits than these edits can change: one each that changes the size, two each of the others.
    A row of a large key names in b a thing of the key that it may be like, a few for all of the key: such pairs, tried
    first, join most of a group of near copies before its keys are looked at.
    """
    most = CROWD if placed else SMALL

    def settle(bucket: int, blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
        key, thing, n, low, *place = _dealt(blobs, placed)
        none = np.zeros(0, np.int64)
        if bucket < 0:
            yield _found(-1 - key, thing, pa.nulls(len(key), pa.int64()), n, np.zeros(len(key)))
            return
        # Where the low bits of things agree by chance, a thing told twice may count twice: a candidate more, none less.
        low_bits = thing.view(np.uint64) & np.uint64(0xFFFFFF)
        if placed:
            low_bits = (np.minimum(n, 4095).astype(np.uint64) << np.uint64(12)) | (low_bits & np.uint64(0xFFF))
        order = np.argsort((key.view(np.uint64) << np.uint64(24)) | low_bits)
        # Keys of one thing give nothing.
        one = key[order]
        other = one[1:] != one[:-1]
        order = order[~(np.r_[True, other] & np.r_[other, True])]
        key, thing, n, low, *place = (x[order] for x in (key, thing, n, low, *place))
        if not len(key):
            return
        new = np.r_[True, (key[1:] != key[:-1]) | (thing[1:] != thing[:-1])]
        key, thing, n, low, *place = (x[new] for x in (key, thing, n, low, *place))
        edge = np.r_[True, key[1:] != key[:-1]]
        if placed:
            size = np.minimum(n, 4095)
            edge[1:] |= size[:-1] * 100 < size[1:] * percent
        begin = np.flatnonzero(edge)
        count = np.diff(np.r_[begin, len(key)])
        group = np.repeat(np.arange(len(begin), dtype=np.int32), count)
        large = count > most
        if placed:
            sketch = (thing >> NAME_BITS).astype(np.uint32)
            # Bits that may differ from a shorter thing: room and the size of that; 24 or more for the longest.
            room = np.where(size < 4095, 2 * (size * (100 - percent) // 100) - size, 24).astype(np.int16)
            short = size.astype(np.int16)
            if large.any():
                wide = np.zeros(len(key), bool)
                wide[:-most] = (group[most:] == group[:-most]) & (size[:-most] * 100 >= size[most:] * percent)
                large = np.logical_or.reduceat(wide, begin)

        def like(p: np.ndarray, q: np.ndarray, close: bool = False) -> np.ndarray:
            """Whether places p and q may be a match of things that link; or of near copies, with few edits."""
            longer, by = np.maximum(n[p], n[q]), n[p] - n[q]
            near = (longer - np.abs(by)) * 100 >= longer * percent
            if placed:
                edits = longer // 32 + 1 if close else longer * (100 - percent) // 100
                near &= np.bitwise_count(sketch[p] ^ sketch[q]) <= 2 * edits - np.abs(by)
                i, j = place[0][p], place[0][q]
                near &= (i == ANYWHERE) | (j == ANYWHERE) | (np.abs(i - j) + np.abs(by - i + j) <= edits)
            return near

        def within(first: int, end: int) -> tuple[np.ndarray, np.ndarray] | None:
            """The matches among places first..end of one key, or None if they are more than SMALL / 2 a row."""
            p, q, found, i = [], [], 0, first
            behind = lambda k: first + int(np.searchsorted(size[first:end], size[k] * 100 // percent, "right"))
            while i < end - 1:
                rows = min(max(PAIRS // max(behind(i) - i, 1), 1), end - 1 - i)
                stop = max(behind(i + rows - 1), i + 1)
                differ = np.bitwise_count(sketch[i : i + rows, None] ^ sketch[None, i + 1 : stop])
                u, v = np.nonzero(differ <= room[None, i + 1 : stop] + short[i : i + rows, None])
                u, v = (z[v >= u] for z in (u, v))
                u, v = u + i, v + i + 1
                near = like(u, v)
                p.append(u[near].astype(np.int32))
                q.append(v[near].astype(np.int32))
                found += len(p[-1])
                if found > SMALL // 2 * (end - first):
                    return None
                i += rows
            return np.concatenate(p), np.concatenate(q)

        crowd = (count > SMALL) & ~large if placed else np.zeros(len(begin), bool)
        x, y, at = [none.astype(np.int32)], [none.astype(np.int32)], np.flatnonzero(~(large | crowd)[group]).astype(np.int32)
        for d in range(1, SMALL):  # every place and the one d further on, inside a key
            at = at[at < len(key) - d]
            at = at[group[at] == group[at + d]]
            if placed:
                at = at[size[at] * 100 >= size[at + d] * percent]
            if not len(at):
                break
            near = like(at, at + d)
            x.append(at[near])
            y.append(at[near] + np.int32(d))
        for g in np.flatnonzero(crowd).tolist():
            pairs = within(int(begin[g]), int(begin[g] + count[g]))
            if pairs is None:
                large[g] = True
            else:
                x.append(pairs[0])
                y.append(pairs[1])
        many = large[group]
        if many.any():
            name = mix(key.view(np.uint64) + np.uint64(bucket << 40 & (1 << 64) - 1))
            if placed:
                name = mix(name + np.repeat(size[begin], count).astype(np.uint64))
            name = (name >> np.uint64(1)).view(np.int64)
            head = _leader(group, thing, np.flatnonzero(many), like) if placed else np.full(int(many.sum()), -1)
            yield _found(name[many], thing[many], pa.array(thing[head], pa.int64(), mask=head < 0), n[many], np.zeros(int(many.sum())))
        x, y = np.concatenate(x), np.concatenate(y)
        if placed:
            few = ~many[x]
            x, y = x[few], y[few]
            times = np.minimum(place[1][x], place[1][y])
        else:
            times = np.ones(len(x), np.int32)
        if len(x):
            a, b, need = np.minimum(thing[x], thing[y]), np.maximum(thing[x], thing[y]), np.minimum(low[x], low[y])
            order = np.lexsort((b, a))
            a, b, need, times = a[order], b[order], need[order], times[order]
            first = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
            yield _found(pa.nulls(len(first), pa.int64()), a[first], b[first], need[first], np.add.reduceat(times, first))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs: list[bytes] = []
        last = None
        for batch in batches:
            for bucket, blob in zip(batch.column("bucket").to_pylist(), batch.column("tokens").to_pylist(), strict=True):
                if blobs and (bucket != last or bucket < 0):
                    yield from settle(last, blobs)
                    blobs = []
                    give_back()
                blobs.append(blob)
                last = bucket
        if blobs:
            yield from settle(last, blobs)

    return run


def candidates(dealt: DataFrame, buckets: int, percent: int, placed: bool = False) -> tuple[DataFrame, DataFrame]:
    """From rows of deal(): pairs (a, b) that share as many keys as asked for, keys of SMALL things at most, or a thing and
    its leader in a large key; and the rows (key, id, n) of all other keys. Every pair that shares enough is among the first
    or shares one of the latter."""
    found = dealt.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(_meet(percent, placed), _FOUND)
    found = materialise(found, "met")
    each = found.where("b IS NOT NULL").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.when(F.col("key").isNull(), F.col("n")).otherwise(0).alias("n"), "c")
    pairs = each.groupBy("a", "b").agg(F.sum("c").alias("c"), F.min("n").alias("n")).where("c >= n").select("a", "b")
    rows = found.where("key IS NOT NULL").select("key", F.col("a").alias("id"), "n")
    hot = F.col("key") < 0  # of these, each task has told what it holds
    return pairs, rows.where(~hot).unionAll(rows.where(hot).distinct())


def similar_components(pairs: DataFrame, rows: DataFrame, prints: DataFrame, sketch: list[str], near: Callable[[str, str], Column], judge: Callable[[DataFrame], DataFrame], first: Callable[[DataFrame], DataFrame] | None = None, growth: int = 64, start: int = 1, alike: Callable[..., np.ndarray] | None = None) -> DataFrame:
    """Components (v, component) of all links among candidate pairs and among things that share a key of `rows`.

    pairs (a, b) and rows (key, id, n) name things by 64-bit ids, prints (id, name, n and the sketch columns) by names
    that never meet by chance; judge gets pairs (a, b) of names and returns those that link. near(x, y) is a test of n
    and sketch columns that no linked pair fails. first(pairs), if given, takes the place of near and judge for pairs.
    alike(n, m, sketch, sketch), if given, is the same test as near on arrays, and rows meet leaders by it (see _beside);
    names are then 16 bytes.

    First the pairs are judged. Keys whose things are all in one component drop out, without `alike` before their rows get
    sketches (of lines there are few such keys, and rows get sketches at once). Then a
    key's rows are compared with some `start`, 64, 4096... times that of them as long as they lie in different components, by the sketch
    inside the join; or, where few are outside the key's largest component, with all of these, which settles the key.
    What is left shrinks until every pair in two components has been compared, so no link between components is lost, and
    a group of copies costs one pair a copy. Two things that share many keys meet in one of them only: a row knows the
    LOWEST keys of its thing below its own, and where two rows have one of these in common they meet there.
    """
    if first is None:
        x, y = prints.alias("x"), prints.alias("y")
        close = pairs.join(x, F.col("a") == F.col("x.id")).join(y, F.col("b") == F.col("y.id")).where("x.name <> y.name").where(near("x", "y"))
        close = close.select(F.least("x.name", "y.name").alias("a"), F.greatest("x.name", "y.name").alias("b"))
        first = lambda _: judge(materialise(close, "close"))
    labels = connected_components(materialise(first(pairs), "verified"))
    known = prints.select("id", "name", *sketch).join(labels, F.col("name") == F.col("v"), "left")
    known = materialise(known.select("id", "name", F.coalesce("component", "name").alias("comp"), *sketch), "known")
    if alike is None:
        held = rows.join(known.select("id", "comp"), "id").groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"))
        rows = materialise(rows.join(held.where("lo < hi").select("key"), "key"), "held")
    columns = ["key", "before", "n", "name", "comp", *sketch]
    where = _held(rows).join(known, "id").select(*columns)
    judged, k = None, start
    while True:
        where = materialise(where, "open")
        mixed = materialise(_mixed(where, 8 * max(k, 8)), "mixed")
        if mixed.isEmpty():
            return labels
        where = _led(where.join(mixed, "key"), k)
        where = where.withColumn("leads", F.when(F.col("few"), F.col("comp") != F.col("main")).otherwise(F.col("leads")))
        new = (_meetings(where, where.where("leads"), near) if alike is None else _beside(where, F.when(F.col("few"), F.col("others")).otherwise(k), sketch, alike)).distinct()
        if judged is not None:
            new = new.join(judged, ["a", "b"], "left_anti")
        new = materialise(new, "pairs")
        told = materialise(judge(new), "verified")
        judged = new if judged is None else judged.unionAll(new)
        where = where.where("NOT leads AND NOT few").select(*columns)
        if not told.isEmpty():
            labels, moved = _merged(labels, told)
            where = where.join(moved, F.col("comp") == F.col("v"), "left").withColumn("comp", F.coalesce("component", "comp")).drop("v", "component")
        k *= growth


def _mixed(where: DataFrame, few: int) -> DataFrame:
    """Keys (key, first by name, size, main, others, few) whose rows (key, name, comp) lie in several components; main is the
    one with most of them, others the number of rows elsewhere, few whether that is no more than `few`. These, compared with all, settle the key:
    of two rows in different components one is not in main."""
    parts = where.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("rows"), F.min("name").alias("first"))
    keys = parts.groupBy("key").agg(F.max(F.struct("rows", "comp")).alias("most"), F.sum("rows").alias("size"), F.min("first").alias("first"), F.count(F.lit(1)).alias("parts"))
    others = F.col("size") - F.col("most.rows")
    return keys.where("parts > 1").select("key", "first", "size", F.col("most.comp").alias("main"), others.alias("others"), (others <= few).alias("few"))


def _led(where: DataFrame, k: int) -> DataFrame:
    """Rows (key, name, first and size of the key...) with `leads`: of the key's rows the first by name, and if k > 1 so
    many others by hash that there are some k of them; all if there are no more."""
    leads = F.col("name") == F.col("first")
    if k > 1:
        leads = leads | (F.pmod(F.xxhash64("name", F.lit(k)), F.col("size")) < k)
    return where.withColumn("leads", leads)


def _held(rows: DataFrame) -> DataFrame:
    """Rows (key, id, n) with `before`: those of the thing's LOWEST keys that are below the row's own."""
    keys = rows.groupBy("id", "n").agg(F.sort_array(F.collect_set("key")).alias("keys"))
    each = keys.select("id", "n", F.slice("keys", 1, LOWEST).alias("low"), F.explode("keys").alias("key"))
    return each.select("key", "id", "n", F.filter("low", lambda k: k < F.col("key")).alias("before"))


def _meetings(where: DataFrame, lead: DataFrame, near: Callable[[str, str], Column]) -> DataFrame:
    """Pairs (a, b) of things in two components that meet at a leader's key; those that also share a lower known key meet
    there instead."""
    met = where.alias("x").join(lead.alias("y"), "key").where("x.comp <> y.comp").where(near("x", "y") & ~F.arrays_overlap("x.before", "y.before"))
    return met.select(F.least("x.name", "y.name").alias("a"), F.greatest("x.name", "y.name").alias("b"))


def _beside(where: DataFrame, most: Column, sketch: list[str], alike: Callable[..., np.ndarray]) -> DataFrame:
    """_meetings of `where` with its leaders, some `most` of a key at most, by arrays: cells of some ROWS rows and LEADS
    leaders of a key, so that no task holds a large key."""
    blocks, parts = F.ceil(F.least("size", most) / LEADS), F.ceil(F.col("size") / ROWS)
    among = lambda seed, n: F.pmod(F.xxhash64("name", F.lit(seed)), n)
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    columns = ["name", "comp", "n", "before", *sketch]
    held = where.select("key", among(1, parts).alias("r"), each(blocks).alias("l"), F.lit(False).alias("leads"), *columns)
    lead = where.where("leads").select("key", each(parts).alias("r"), among(2, blocks).alias("l"), "leads", *columns)
    tasks = int(where.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cells = held.unionAll(lead).repartition(tasks, "key", "r", "l").sortWithinPartitions("key", "r", "l")
    met = cells.mapInArrow(_met_beside(sketch, alike), "a binary, b binary")
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def _met_beside(sketch: list[str], alike: Callable[..., np.ndarray]) -> Callable:
    def settle(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        lead = cell.column("leads").to_numpy(zero_copy_only=False)
        x, y = np.flatnonzero(~lead), np.flatnonzero(lead)
        comp = text_bytes(cell.column("comp"))[0].view(np.uint64).reshape(-1, 2)
        n, bits = cell.column("n").to_numpy(), [cell.column(c).to_numpy() for c in sketch]
        keys, count = cell.column("before").flatten().to_numpy(), np.diff(cell.column("before").offsets.to_numpy())
        none = np.iinfo(np.int64).min
        lower = np.full((LOWEST, cell.num_rows), none)
        place = np.arange(len(keys)) - np.repeat(np.cumsum(count) - count, count)
        lower[place, np.repeat(np.arange(cell.num_rows), count)] = keys
        rows = max(PAIRS // max(len(y), 1), 1)
        for part in (x[i : i + rows] for i in range(0, len(x) if len(y) else 0, rows)):
            near = alike(n[part, None], n[None, y], [b[part, None] for b in bits], [b[None, y] for b in bits])
            u, v = np.nonzero(near)
            u, v = part[u], y[v]
            apart = (comp[u] != comp[v]).any(axis=1)
            u, v = u[apart], v[apart]
            elsewhere = np.zeros(len(u), bool)  # pairs that meet at a lower key
            for i in range(LOWEST):
                for j in range(LOWEST):
                    elsewhere |= (lower[i][u] == lower[j][v]) & (lower[i][u] != none)
            if not elsewhere.all():
                name = cell.column("name")
                yield pa.RecordBatch.from_arrays([name.take(pa.array(z[~elsewhere])) for z in (u, v)], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            at = np.stack([batch.column(c).to_numpy() for c in ("key", "r", "l")])
            cut = np.flatnonzero(np.r_[True, (at[:, 1:] != at[:, :-1]).any(axis=0), True]) if batch.num_rows else []
            for i, j in zip(cut[:-1], cut[1:], strict=True):
                this = tuple(at[:, i].tolist())
                if held and this != last:
                    yield from settle(held)
                    held = []
                held.append(batch.slice(i, j - i))
                last = this
        if held:
            yield from settle(held)

    return run


def _merged(labels: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Labels (v, component) after more links (a, b), and of the components that the links touch the new ones."""
    p, q = labels.alias("p"), labels.alias("q")
    ends = links.join(p, F.col("a") == F.col("p.v"), "left").join(q, F.col("b") == F.col("q.v"), "left")
    moved = connected_components(ends.select(F.coalesce("p.component", "a").alias("a"), F.coalesce("q.component", "b").alias("b")))
    old = labels.join(moved.select(F.col("v").alias("was"), F.col("component").alias("now")), F.col("component") == F.col("was"), "left")
    fresh = moved.join(labels.select("v"), "v", "left_anti")  # things that had no link so far
    return materialise(old.select("v", F.coalesce("now", "component").alias("component")).unionAll(fresh), "merged"), moved


#: Slots of the bitmap that tells which things to fetch; its size is fixed. Where it is full, more rows travel, none fewer.
SLOT_BITS = 24


def slots_of(keys: DataFrame, column: str) -> np.ndarray:
    """One bit for each slot that holds a key (long) of the column: 2 MB for any number of keys."""
    slot = keys.select(F.col(column).bitwiseAND((1 << SLOT_BITS) - 1).alias("slot"))
    rows = slot.groupBy(F.expr("slot div 64").alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(slot % 64 as int)))").alias("b")).toPandas()
    out = np.zeros(1 << (SLOT_BITS - 6), np.int64)
    out[rows["w"].to_numpy(np.int64)] = rows["b"].to_numpy(np.int64)
    return out.view(np.uint64)


def listed(slots: np.ndarray, column: str) -> Callable:
    """For mapInArrow: the rows whose `column` (long, null: none) has its slot set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(column)
            yield batch.filter(pa.array(in_slots(slots, keys.fill_null(0).to_numpy()) & keys.is_valid().to_numpy(zero_copy_only=False)))

    return run


def in_slots(slots: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether the slots of keys are set."""
    slot = keys & ((1 << SLOT_BITS) - 1)
    return ((slots[slot >> 6] >> (slot & 63).astype(np.uint64)) & np.uint64(1)) == 1
