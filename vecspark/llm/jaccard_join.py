"""Self-join of documents on the Jaccard similarity of word shingles, by adaptive multi-match prefixes."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecspark.llm.common import by_bytes, condensed, lean_batches, materialise, text_bytes
from vecspark.llm.components import BUCKET, candidates, deal, in_slots, listed, similar_components, slots_of
from vecspark.llm.words import shingles, span_hashes, words

#: Counters of the frequency sketch: its size is fixed whatever the corpus, and so is what is sent to the tasks.
SKETCH_BITS = 18
#: Names of sets that a task remembers, to send copies once.
SEEN = 500_000

#: Columns of a 1024-bit parity sketch of a set: bit b tells whether an odd number of its shingles hash to b. Two
#: sketches differ in at most as many bits as the sets differ in shingles, so it refuses pairs without error.
PARITY = [f"bits{i}" for i in range(16)]

#: The like with 1 to 2 bits a shingle, for pairs that these leave over: a text of any length has room to be refused.
WIDE = "wide"

#: Schemes to choose from: a document's l is least_matches of its set's size times one of these.
SCHEMES = (1, 2, 4)


def least_matches(n: np.ndarray) -> np.ndarray:
    """The fewest shared prefix shingles that any scheme of a set of n shingles asks for; grows with n."""
    return n // 32 + 1


def _sets(batch: pa.RecordBatch, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every shingle occurrence in a batch."""
    data, offsets = text_bytes(batch.column("text"))
    starts, ends, rows = words(data, offsets)
    return shingles(span_hashes(data, starts, ends), rows, size)


def _distinct(h: np.ndarray, rows: np.ndarray, order: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shingles and rows in the given order, each once a row, and the bounds of the rows."""
    h, rows = h[order], rows[order]
    if len(h):
        first = np.r_[True, (h[1:] != h[:-1]) | (rows[1:] != rows[:-1])]
        h, rows = h[first], rows[first]
    return h, rows, np.searchsorted(rows, np.arange(n + 1))


def _names(h: np.ndarray, bounds: np.ndarray) -> list[bytes | None]:
    """128-bit names of the sets, from their shingles in order of hash; none for empty ones."""
    return [hashlib.blake2b(h[a:b].tobytes(), digest_size=16).digest() if b > a else None for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]


def _count(size: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << SKETCH_BITS, np.int64)
        for batch in by_bytes(batches):
            h, _ = _sets(batch, size)
            total += np.bincount((h >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["bucket", "n"])

    return run


def frequency_sketch(docs: DataFrame, size: int) -> np.ndarray:
    """Shingle counts over all documents in 2**SKETCH_BITS counters by hash; 2 MB for any corpus."""
    rows = docs.select("text").mapInArrow(_count(size), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(1 << SKETCH_BITS, np.int64)
    out[rows["bucket"].to_numpy(np.int64)] = rows["n"].to_numpy(np.int64)
    return out


def _ids(names: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(names), np.int64)[::2]


def _wide(h: np.ndarray, rows: np.ndarray, n: np.ndarray) -> list[bytes]:
    """Parity sketches of the rows' sets, of so many bits as the power of two from the set's size on, 64 at least.

    With one bit a shingle sets of a Jaccard similarity of 0.7 still differ in more bits than 0.8 allows, on the average.
    """
    bits = np.left_shift(1, np.ceil(np.log2(np.maximum(n, 64))).astype(np.int64))
    offset = np.r_[0, np.cumsum(bits)]
    at = offset[rows] + (h & (bits[rows] - 1).astype(np.uint64)).astype(np.int64)
    data = np.packbits((np.bincount(at, minlength=offset[-1]) & 1).astype(np.uint8), bitorder="little").tobytes()
    cut = (offset // 8).tolist()
    return [data[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]


def _refute(percent: int) -> Callable:
    """The pairs whose wide sketches leave room for percent/100; the wider one of two is folded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total = (batch.column("n").to_numpy() * (100 - percent)).tolist()
            good = []
            for i, (u, v) in enumerate(zip(batch.column("u").to_pylist(), batch.column("v").to_pylist(), strict=True)):
                x, y = np.frombuffer(u, np.uint64), np.frombuffer(v, np.uint64)
                while len(x) != len(y):
                    if len(x) < len(y):
                        x, y = y, x
                    x = x[: len(x) // 2] ^ x[len(x) // 2 :]
                good.append(int(np.bitwise_count(x ^ y).sum()) * (100 + percent) <= total[i])
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return run


def _print(size: int) -> Callable:
    """Of each document: size and name of its set, 64 bits of the name as id, and the parity sketches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches):
            h, rows = _sets(batch, size)
            h, rows, bounds = _distinct(h, rows, np.lexsort((h, rows)), batch.num_rows)
            names = _names(h, bounds)
            bits = np.zeros((batch.num_rows, len(PARITY)), np.uint64)
            word = ((h >> np.uint64(6)) & np.uint64(len(PARITY) - 1)).astype(np.int64)
            np.bitwise_xor.at(bits, (rows, word), np.uint64(1) << (h & np.uint64(63)))
            ids = pa.array(_ids([x or bytes(16) for x in names]), mask=np.array([x is None for x in names], bool))
            parity = [pa.array(x) for x in np.ascontiguousarray(bits.view(np.int64).T)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), pa.array(np.diff(bounds).astype(np.int32)), pa.array(names, pa.binary()), ids, pa.array(_wide(h, rows, np.diff(bounds)), pa.binary()), *parity], names=["doc_id", "key", "n", "name", "id", WIDE, *PARITY])

    return run


def _prefixes(size: int, sketch: np.ndarray, percent: int, buckets: int) -> Callable:
    """The dealt prefixes of each set in the global order (rare first), as long as its scheme needs; copies once a task."""
    mean = max(1.0, float(sketch.sum()) / len(sketch))
    excess = np.maximum(sketch - mean - 4 * np.sqrt(mean), 0.0)
    level = np.floor(np.log2(1 + excess / mean + excess / 64)).astype(np.uint64)
    hot = sketch > 64 * mean + 1000

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told: set[bytes] = set()
        for batch in by_bytes(batches):
            h, rows = _sets(batch, size)
            h, rows, bounds = _distinct(h, rows, np.lexsort((h, rows)), batch.num_rows)
            n = np.diff(bounds)
            names, new = _names(h, bounds), n > 0
            for i in np.flatnonzero(new).tolist():
                new[i] = names[i] not in told
                if len(told) < SEEN:
                    told.add(names[i])
            at = (h >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)
            order = np.lexsort((h, level[at], rows))
            h, at = h[order], at[order]
            need = -(-percent * n // 100)
            # The cost of an l-scheme: expected partners by sketch over its prefix, thinned by the matches asked for.
            heavy = np.r_[0.0, np.cumsum(excess[at])]
            best, cost = np.ones(len(n), np.int64), np.full(len(n), np.inf)
            for factor in SCHEMES:
                ell = least_matches(n) * factor
                end = np.minimum(n - need + ell, n)
                c = (heavy[bounds[:-1] + end] - heavy[bounds[:-1]]) / ell + end
                better = (c < cost) & ((ell <= need) | (factor == 1))
                best[better], cost[better] = ell[better], c[better]
            end = np.where(new, np.minimum(n - need + best, n), 0)
            keep = np.arange(len(h)) - bounds[rows] < end[rows] if len(h) else np.zeros(0, bool)
            rows = rows[keep]
            ids = _ids([x or bytes(16) for x in names])
            yield deal(h[keep], ids[rows], n[rows], best[rows], hot[at[keep]], buckets)

    return run


def _whole(size: int, slots: np.ndarray) -> Callable:
    """Names and shingles of the sets whose slot is set, each once a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(in_slots(slots, batch.column("key").to_numpy())))
            for part in by_bytes(iter([batch])):
                h, rows = _sets(part, size)
                h, rows, bounds = _distinct(h, rows, np.lexsort((h, rows)), part.num_rows)
                names = _names(h, bounds)
                values = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(h.view(np.int64)))
                once = pa.array(list({x: i for i, x in enumerate(names) if x}.values()), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()).take(once), values.take(once)], names=["name", "toks"])

    return run


def near_duplicate_components(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Link documents whose shingle sets have 100*|A∩B| >= percent*|A∪B|: (doc_id, n_shingles, component_id, key).

    Words are runs of non-white-space bytes with A-Z lowered; a set holds distinct runs of `size` words, or the whole
    sequence of a shorter text; a text without words has no set and no link. component_id is the smallest doc_id
    reachable by links, itself included; key is xxhash64 of the text.

    Equal sets are one vertex from the start, named by a digest. Shingles are ordered rare first by a fixed-size sketch
    counted over all documents. A set of n shingles takes the first n - ceil(percent*n/100) + l of them, l being the
    cheapest of a few schemes (n/32 + 1, twice and four times that) by estimated partners; two sets that link share at
    least min(l) shingles within the prefixes of that scheme. The prefixes are shuffled once, packed by bucket; shared
    prefix shingles are counted for each pair of sizes that allow a link, and pairs with too few end there, before any
    set moves. Shingles that more than 32 sets hold are not paired at once but left to similar_components, which
    loses no link between components. What remains is held against parity sketches, of 1024 bits and then of one bit or
    more a shingle, and verified on whole sets.

    Rows are told apart by their texts: rows that repeat a doc_id with other texts have their own links. Null text is
    empty. A null doc_id links like any other and never is a component_id; where no other is reachable component_id is
    null. A very long text is one set of as many shingles, 8 bytes each, in a task's memory. Columns that are not named
    are not looked at. No rows in, no rows out.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col).cast("string")).alias("key"), F.col(text_col).cast("string").alias("text"))
    lean_batches(docs.sparkSession)
    return condensed(docs.sparkSession, lambda: _components(docs, size, percent), "near-duplicate-components")


def _components(docs: DataFrame, size: int, percent: int) -> DataFrame:
    sketch = frequency_sketch(docs, size)
    fields = "doc_id long, key long, n int, name binary, id long, wide binary" + "".join(f", {c} long" for c in PARITY)
    base = materialise(docs.mapInArrow(_print(size), fields), "prints")
    buckets = max(8, int(sketch.sum()) * (100 - percent + 5) // 100 // BUCKET)
    pairs, rows = candidates(docs.select("text").mapInArrow(_prefixes(size, sketch, percent, buckets), "bucket int, tokens binary"), buckets, percent)
    pairs = materialise(pairs, "candidates")
    # From here on only sets that are in a pair or in a row, and by chance of slots a few others.
    slots = slots_of(pairs.select(F.explode(F.array("a", "b")).alias("id")).unionAll(rows.select("id")), "id")
    prints = base.mapInArrow(listed(slots, "id"), base.schema)
    prints = prints.groupBy("name").agg(*[F.first(c).alias(c) for c in ("id", "n", WIDE, *PARITY)], F.min("key").alias("key"))
    prints = materialise(prints, "sets")

    def near(x: str, y: str) -> Column:
        differ = sum((F.bit_count(F.col(f"{x}.{c}").bitwiseXOR(F.col(f"{y}.{c}"))) for c in PARITY), F.lit(0))
        n, m = F.col(f"{x}.n"), F.col(f"{y}.n")
        return (F.least(n, m) * 100 >= F.greatest(n, m) * percent) & (differ * (100 + percent) <= (n + m) * (100 - percent))

    def likely(pairs: DataFrame, by: str) -> DataFrame:
        """Pairs (a, b) of names or ids whose wide sketches leave room for a link, as names."""
        s, t = (prints.select(by, "n", "name", WIDE).alias(c) for c in "st")
        both = pairs.join(s, F.col("a") == F.col(f"s.{by}")).join(t, F.col("b") == F.col(f"t.{by}")).where("s.name <> t.name")
        both = both.select(F.least("s.name", "t.name").alias("a"), F.greatest("s.name", "t.name").alias("b"), (F.col("s.n") + F.col("t.n")).alias("n"), F.col(f"s.{WIDE}").alias("u"), F.col(f"t.{WIDE}").alias("v"))
        return materialise(both.mapInArrow(_refute(percent), "a binary, b binary"), "likely")

    def verify(pairs: DataFrame) -> DataFrame:
        """The pairs that link by their whole sets; only sets of pairs are fetched, each once."""
        if pairs.isEmpty():
            return pairs
        asked = pairs.select(F.explode(F.array("a", "b")).alias("name")).distinct()
        slots = slots_of(prints.select("name", "key").join(asked, "name"), "key")
        sets = docs.select("key", "text").mapInArrow(_whole(size, slots), "name binary, toks array<long>")
        sets = sets.join(asked, "name").groupBy("name").agg(F.first("toks").alias("toks"))
        s, t = sets.alias("s"), sets.alias("t")
        both = pairs.join(s, F.col("a") == F.col("s.name")).join(t, F.col("b") == F.col("t.name"))
        common = F.size(F.array_intersect("s.toks", "t.toks"))
        return both.where(common * 100 >= percent * (F.size("s.toks") + F.size("t.toks") - common)).select("a", "b")

    labels = similar_components(pairs, rows, prints.drop(WIDE), PARITY, near, lambda p: verify(likely(p, "name")), lambda p: verify(likely(p, "id")))
    members = base.select("doc_id", "key", "n", "name").join(labels, F.col("name") == F.col("v"), "left").select("doc_id", "key", "n", "name", F.coalesce("component", "name").alias("component"))
    least = members.where("name IS NOT NULL").groupBy("component").agg(F.min("doc_id").alias("least"))
    out = members.join(least, "component", "left")
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("name").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("component_id"), "key")
