"""Groups of things by shared keys, against brute force; things of many shared keys meet once."""

import random

from pyspark.sql import functions as F

from vecspark.llm import components


def test_crowds_against_brute_force(spark):
    """Keys of many things, things of up to 20 keys, links by a rule that no sketch knows; growth 3 makes many rounds."""
    rng = random.Random(31)
    name = lambda i: f"{i * 37 % 101:03d}".encode()
    keys = {i: set(rng.sample(range(30), rng.choice([1, 2, 5, 20]))) for i in range(60)}
    linked = {(i, j) for i in keys for j in keys if i < j and rng.random() < 0.03}
    rows = spark.createDataFrame([(k, i, 5) for i, ks in keys.items() for k in ks] * 2, "key long, id long, n int")
    prints = spark.createDataFrame([(i, name(i), 5, i % 2) for i in keys], "id long, name binary, n int, p0 long")
    pairs = spark.createDataFrame([(0, 1), (2, 3)], "a long, b long")
    truth = spark.createDataFrame([tuple(sorted((name(i), name(j)))) for i, j in linked | {(0, 1)}], "a binary, b binary")
    judge = lambda p: p.join(truth, ["a", "b"])
    out = components.similar_components(pairs, rows, prints, ["p0"], lambda x, y: F.lit(True), judge, growth=3)
    top = {i: i for i in keys}
    for i, j in linked | {(0, 1)}:
        if keys[i] & keys[j] or (i, j) == (0, 1):
            top = {v: top[j] if t == top[i] else t for v, t in top.items()}
    least = {t: min(name(v) for v in top if top[v] == t) for t in top.values()}
    got = {bytes(r.v): bytes(r.component) for r in out.collect()}
    assert {name(i): least[top[i]] for i in keys} == {name(i): got.get(name(i), name(i)) for i in keys}
    assert len(got) == out.count()


def test_things_of_many_shared_keys_meet_once(spark):
    """Forty things that hold the same twelve keys: 780 pairs, not twelve times as many."""
    rows = spark.createDataFrame([(k, i, 5) for i in range(40) for k in range(12)], "key long, id long, n int")
    where = components._held(rows).withColumn("name", F.col("id")).withColumn("comp", F.col("id")).cache()
    assert where.count() == 480 and max(len(r.before) for r in where.collect()) == components.LOWEST
    met = components._meetings(where, where, lambda x, y: F.lit(True))
    assert met.count() == 2 * 780 and met.distinct().count() == 780
