"""The opN_ queries themselves, and the cases that production tables do not hold: repeated and null ids, hostile texts."""

import random
import time
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from tests.llm.test_llm import brute_components, lower, table, words_of
from vecspark.llm.decontaminate import contaminated, greedy_tiles
from vecspark.llm.exact_dedup import exact_groups
from vecspark.llm.html_text import render
from vecspark.llm.jaccard_join import near_duplicate_components
from vecspark.llm.line_dedup import dedup_lines
from vecspark.llm.mixing import curriculum, mixture
from vecspark.llm.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Small tables with null and repeated ids, null and empty texts, copies, a long text and an extra column."""
    to, rng = str(tmp_path_factory.mktemp("tables")), random.Random(6)
    texts = [words_of(rng, rng.randint(1, 80)) for _ in range(60)]
    rows = [(i, t, ["en", "de"][i % 2], f"s{i % 4}") for i, t in enumerate(texts)]
    rows += [(5, texts[7].upper(), "en", "s0"), (5, texts[5], "en", "s1"), (None, texts[9], "en", None), (None, "other text here", None, None)]
    rows += [(70, None, None, None), (71, "", "en", "s1"), (72, "", None, "s1"), (73, words_of(rng, 5000), "en", "s2")]
    table(spark, rows).withColumn("n_chars", F.length("text").cast("long")).write.parquet(f"{to}/documents.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i in range(50)], "doc_id long, quality int, toxic int").write.parquet(f"{to}/labels.parquet")
    spark.createDataFrame([(1, texts[3]), (2, None)], "item_id long, text string").write.parquet(f"{to}/benchmark.parquet")
    spark.createDataFrame([(1, "u", "<p>a<p>b"), (2, None, None), (2, "u", ""), (None, "u", "x")], "page_id long, url string, html string").write.parquet(f"{to}/pages.parquet")
    turns = [(0, 0, "user", "q"), (0, 1, "assistant", "a"), (1, 0, "user", "q"), (1, 1, "assistant", "b"), (None, 0, "user", "q"), (4, 0, None, None)]
    spark.createDataFrame(turns, "conv_id long, turn int, role string, text string").write.parquet(f"{to}/conversations.parquet")
    return to, rows


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, folder, name):
    """Every query runs on the odd tables; one row per document where the contract says so; rows agree with the SQL."""
    to, rows = folder
    df = QUERIES[name](spark, to)
    out = df.collect()
    number = int(name[2:].split("_")[0])
    if number not in (3, 4, 5):
        assert sorted((r.doc_id for r in out), key=str) == sorted((r[0] for r in rows), key=str)
    if number in (6, 9):
        assert all(isinstance(r.held_out, bool) and 0 <= r.score <= 1 for r in out)
        assert 0 < sum(r.held_out for r in out) < len(out)
    if number == 9:
        assert all(r.predicted == int(r.score >= 0.3) for r in out)
    if number == 3:
        assert {(r.doc_id, r.item_id) for r in out} >= {(3, 1)}
    if name in ORACLES:
        con = duckdb.connect()
        for t in ("documents", "labels", "benchmark", "pages", "conversations"):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{to}/{t}.parquet/*.parquet'")
        sql = con.sql(ORACLES[name])
        key = lambda names, data: sorted((tuple(round(r[i], 6) if isinstance(r[i], float) else r[i] for i in sorted(range(len(names)), key=names.__getitem__)) for r in data), key=str)
        assert sorted(df.columns) == sorted(sql.columns) and key(df.columns, out) == key(sql.columns, sql.fetchall())


def test_op8_brute(spark, folder):
    """Rows are vertices of their own: ids that repeat with other texts keep their own links."""
    _, rows = folder
    want = brute_components([(k, t, None, None) for k, (_, t, _, _) in enumerate(rows)])
    least = defaultdict(list)
    for k, (_, c) in want.items():
        if rows[k][0] is not None:
            least[c].append(rows[k][0])
    expect = sorted(((rows[k][0], n, (min(least[c]) if least[c] else None) if n else rows[k][0]) for k, (n, c) in want.items()), key=str)
    out = near_duplicate_components(table(spark, rows)).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in out), key=str) == expect


def test_exact_repeated_ids(spark):
    a, b, z = "a" * 128, "b" * 128, "zz"
    rows = [(5, a + z, None, None), (5, b + z, None, None), (1, a + z, None, None), (2, b + z, None, None), (None, a + "y", None, None), (None, b + "y", None, None), (None, b + "Y", None, None)]
    out = exact_groups(table(spark, rows)).collect()
    assert sorted((r.group_size, r.keep_id) for r in out if r.keep_id) == [(2, 5)] * 4
    assert sorted(r.group_size for r in out if r.keep_id is None) == [1, 2, 2]


def test_lines_repeated_ids(spark):
    line = "the quick brown fox jumps over the lazy dog near the old river bank"
    rows = [(1, f"{line}\nkept line number one here", None, None), (2, f"x\n{line}", None, None), (2, "y\nanother unique line of this other text", None, None), (3, None, None, None), (4, line, None, None), (4, line, None, None)]
    out = sorted(((r.doc_id, r.text, r.n_removed) for r in dedup_lines(table(spark, rows).withColumn("n_lines", F.lit("clash"))).collect()), key=str)
    assert out == sorted([(1, rows[0][1], 0), (2, "x", 1), (2, rows[2][1], 0), (3, None, 0), (4, "", 1), (4, "", 1)], key=str)


def test_stream_takes_what_the_mix_takes(spark):
    rows = [(1, "a b c d e", None, "s0")] * 3 + [(None, "f g", None, "s0")] * 2 + [(2, "h i j", None, "s1"), (2, "k l m", None, "s1"), (3, None, None, None), (4, "", None, "s1"), (5, "n " * 40, None, None)]
    docs = table(spark, rows)
    took = sum(r.taken for r in mixture(docs).collect())
    stream = curriculum(docs).collect()
    assert sum(r.words for r in stream) == took == sum(r.n for r in [docs.agg(F.sum(F.size(F.split(F.trim(F.coalesce("text", F.lit(""))), " ")) - F.when(F.coalesce(F.trim("text"), F.lit("")) == "", 1).otherwise(0)).alias("n")).first()])
    positions = [r.position for r in mixture(docs).collect()]
    known = [p for p in positions if p is not None]
    assert known == sorted(known) and positions == known + [None] * (len(positions) - len(known))


def naive_tiles(item, text, least):
    """Greedy string tiling by its definition: the longest unmarked common run, the first of equal ones, again and again."""
    item, text, tiles = list(item), list(text), []
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for j in range(len(text)):
                n = 0
                while i + n < len(item) and j + n < len(text) and item[i + n] is not None and item[i + n] == text[j + n]:
                    n += 1
                best = max(best, (n, -i, -j))
        n, i, j = best[0], -best[1], -best[2]
        if n < least:
            return sorted(tiles)
        tiles.append((i, j, n))
        item[i : i + n] = text[j : j + n] = [None] * n


def test_tiles_brute():
    rng = random.Random(13)
    for _ in range(300):
        item, text = ([rng.randrange(rng.choice([2, 3, 8])) for _ in range(rng.randint(0, 18))] for _ in range(2))
        mine, naive = greedy_tiles(item, text, 3), naive_tiles(item, text, 3)
        assert sum(t[2] for t in mine) == sum(t[2] for t in naive), (item, text)
    start = time.time()
    greedy_tiles([1] * 800, [1] * 799, 3)
    greedy_tiles([1, 2] * 400, [2, 1] * 500, 3)
    assert time.time() - start < 20


def test_contaminated_odd(spark):
    item = "one two three four five six seven eight nine ten"
    bench = spark.createDataFrame([(7, item), (8, "red green blue"), (9, "a b")], "item_id long, text string")
    rows = [(1, f"x {item} y", None, None), (1, "clean text of the same id", None, None), (2, "the red green blue flag", None, None), (3, "red green and blue", None, None), (4, "a b", None, None), (None, item, None, None), (None, "clean", None, None), (5, "one two three " * 3000, None, None)]
    out = contaminated(table(spark, rows), bench)
    assert sorted((str(r.doc_id), r.item_id) for r in out.collect()) == [("1", 7), ("2", 8), ("None", 7)]
    from corpus_pipeline import _without

    kept = _without(table(spark, rows), out).collect()
    assert sorted(str(r.text) for r in kept) == sorted(t for k, (_, t, _, _) in enumerate(rows) if k in (1, 3, 4, 6, 7))


def test_html_hostile():
    start = time.time()
    for page in ("<a" * 20000, '<a "' * 20000, "<div>" * 20000, "<a b='\"" * 20000, "<p>x" * 20000, "<!--" * 20000, "<b " * 20000 + "x='>", "</p>" * 20000, "<table><tr>" * 2000):
        render(page)
    assert time.time() - start < 20
    assert render("<p style='visibility:hidden'>no<b style='visibility: visible'>yes</b>") == "yes"
    assert render("a < b <img alt='x > y'> c") == "a < b c"
    wide = render("<table><tr><td>" + "word " * 30 + "<td>b<tr><td>c<td>d</table>").split("\n")
    assert len({x.index("|") for x in wide}) == 1 and "".join(wide).count("word") == 30


def test_empty_tables(spark, folder, tmp_path):
    """Every query and stage on tables without rows."""
    import corpus_pipeline as p

    to, _ = folder
    for t in ("documents", "labels", "benchmark", "pages", "conversations"):
        spark.read.parquet(f"{to}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    for name, query in QUERIES.items():
        assert query(spark, str(tmp_path)).count() == 0, name
    assert p.run(spark, str(tmp_path)).count() == 0


def test_lower():
    assert lower("AÄ") == "aÄ"


def test_substrings_repeated_ids(spark):
    from vecspark.llm.substring_dedup import dedup_substrings

    a, b = "".join(chr(97 + i * i % 25) + str(i) for i in range(60)), "".join(chr(98 + i * 3 % 23) + str(i * 7) for i in range(60))
    rows = [(2, a, None, None), (2, b, None, None), (3, "x" + a, None, None), (None, "own text", None, None), (None, b[:130], None, None), (2, a, None, None)]
    out = sorted((str(r.doc_id), r.n_bytes, r.n_removed) for r in dedup_substrings(table(spark, rows)).collect())
    n, m = len(a), len(b)
    assert n >= 130 and m >= 140
    assert out == sorted([("2", n, 0), ("2", n, 0), ("2", m, 130), ("3", n + 1, n), ("None", 8, 0), ("None", 130, 0)])
