"""The training-data operators against brute force, on small tables with nulls, empty texts, repeats and odd columns."""

import hashlib
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from vecspark.llm.components import connected_components
from vecspark.llm.decontaminate import contaminated, greedy_tiles
from vecspark.llm.exact_dedup import exact_groups
from vecspark.llm.html_text import render
from vecspark.llm.jaccard_join import near_duplicate_components
from vecspark.llm.language_id import fit_languages, identify_languages
from vecspark.llm.line_dedup import dedup_lines, edit_distance
from vecspark.llm.mixing import curriculum, mixture, source_targets
from vecspark.llm.preferences import conversations, format_preferences, paired_by_number, paired_by_opening
from vecspark.llm.quality import fit_quality, score_quality
from vecspark.llm.substring_dedup import dedup_substrings, suffix_array

#: Names that operators use inside; they must not clash.
EXTRA = "doc_id long, text string, lang string, source string, n int, key string, rest string, score int"


def table(spark, rows):
    return spark.createDataFrame([(i, t, lang, src, 1, "k", "r", 7) for i, t, lang, src in rows], EXTRA)


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def words_of(rng, n):
    return " ".join(rng.choice("abcdefghij") * rng.randint(1, 4) + rng.choice("xyz") for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    texts = [words_of(rng, rng.randint(1, 60)) for _ in range(40)]
    long = words_of(rng, 20_000)
    passage = words_of(rng, 60)
    rows = [(i, t, "en", f"s{i % 3}") for i, t in enumerate(texts)]
    rows += [(100 + i, texts[i].upper(), None, None) for i in range(5)]
    near = words_of(rng, 80).split()
    for i in range(12):
        copy = list(near)
        copy[rng.randrange(80)] = "changed"
        rows.append((200 + i, " ".join(copy), "en", "s0"))
    rows += [(300 + i, f"{words_of(rng, 30)} {passage} {words_of(rng, 30)}", "en", "s1") for i in range(4)]
    rows += [(400, long, "en", "s2"), (401, long + " end", "en", "s2"), (402, "", None, "s1"), (403, None, None, None), (404, " \n\t", "en", "s1"), (405, "ab " * 200, "en", "s1"), (406, "äöü ÄÖÜ", "de", "s1")]
    return rows


def test_exact(spark, corpus):
    groups = defaultdict(list)
    for i, t, _, _ in corpus:
        groups[lower(t)].append(i)
    out = {r.doc_id: r for r in exact_groups(table(spark, corpus), 4, 4).collect()}
    assert len(out) == len(corpus)
    for t, ids in groups.items():
        for i in ids:
            assert (out[i].keep_id, out[i].group_size, out[i].kept) == (max(ids), len(ids), i == max(ids))
            assert out[i].sha == hashlib.sha256(t.encode()).hexdigest()
    odd = table(spark, [(None, "x", None, None), (1, "X", None, None), (1, "X", None, None)])
    assert [(r.keep_id, r.group_size) for r in exact_groups(odd).collect()] == [(1, 3)] * 3
    assert exact_groups(odd.limit(0)).count() == 0


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(50, 60), (60, 55), (7, 7), (None, 3)], "a long, b long")
    out = {r.v: r.component for r in connected_components(links).collect()}
    assert out == {**{i: 1 for i in range(1, 41)}, **{i: 50 for i in (50, 55, 60)}}


def brute_components(rows):
    sets = {}
    for i, t, _, _ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()
    at = {i: i for i in sets}

    def find(x):
        while at[x] != x:
            x = at[x]
        return x

    ids = sorted(sets)
    for i in ids:
        for j in ids:
            if i < j and sets[i] and sets[j]:
                c = len(sets[i] & sets[j])
                if 100 * c >= 80 * (len(sets[i]) + len(sets[j]) - c):
                    a, b = sorted((find(i), find(j)))
                    at[b] = a
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_jaccard(spark, corpus):
    out = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicate_components(table(spark, corpus)).collect()}
    assert out == brute_components(corpus)
    odd = table(spark, [(None, "a b c d e f", None, None), (2, "a b c d e f", None, None), (2, "a b c d e f", None, None)])
    assert sorted(((r.doc_id, r.component_id) for r in near_duplicate_components(odd).collect()), key=str) == [(2, 2), (2, 2), (None, 2)]  # null links like any other id
    assert near_duplicate_components(odd.limit(0)).count() == 0


def test_substrings(spark, corpus):
    seen, want = set(), {}
    for i, t, _, _ in sorted(corpus):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 99):
            if b[p : p + 100] in seen:
                gone[p : p + 100] = b"\1" * 100
            seen.add(b[p : p + 100])
        want[i] = (len(b), sum(gone), sum(1 for k, g in enumerate(gone) if g and not (k and gone[k - 1])), bytes(x for x, g in zip(b, gone, strict=True) if not g))
    out = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in dedup_substrings(table(spark, corpus)).collect()}
    assert out == want
    assert dedup_substrings(table(spark, corpus).limit(0)).count() == 0


def test_suffix_array():
    import numpy as np

    rng = random.Random(2)
    for _ in range(200):
        t = [rng.randint(1, rng.choice([1, 2, 4, 200])) for _ in range(rng.randint(0, 80))] + [0]
        assert suffix_array(np.array(t, np.uint16), 1000).tolist() == sorted(range(len(t)), key=lambda i: t[i:])


def test_edit_distance():
    def brute(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    rng = random.Random(1)
    for _ in range(500):
        a, b = ([rng.randrange(3) for _ in range(rng.randrange(9))] for _ in range(2))
        most = rng.randrange(6)
        assert edit_distance(a, b, most) == min(brute(a, b), most + 1)


def test_lines(spark):
    line = "the quick brown fox jumps over the lazy dog near the old river bank today again and again while nobody looks at it"
    rows = [
        (1, f"first line that is only here once\n{line}\nx", None, None),
        (2, f"{line.upper()}!!\nshort one\nshort one", None, None),
        (3, line.replace("lazy", "lazy very"), None, None),
        (4, None, None, None), (5, "", None, None), (None, line, None, None),
    ]
    out = {r.doc_id: r for r in dedup_lines(table(spark, rows)).collect()}
    assert out[None].text == line and out[None].n_removed == 0
    assert out[1].text == "first line that is only here once\nx" and (out[1].n_lines, out[1].n_removed) == (3, 1)
    assert out[2].text == "short one\nshort one"
    assert out[4].text is None and out[5].text == "" and len(out) == len(rows)
    assert set(EXTRA.split()[::2]) <= set(out[1].asDict())
    assert dedup_lines(table(spark, rows).limit(0)).count() == 0


@pytest.mark.parametrize("percent", [80, 60])
def test_lines_recall(spark, percent):
    """Every line that brute-force edit similarity links goes, whatever its SimHash: by one connected group at a time."""
    rng, rows, lines = random.Random(11), [], []
    for _ in range(60):
        a = [f"w{rng.randrange(60)}" for _ in range(rng.choice([5, 6, 9, 10, 14, 20, 40, 60]))]
        for _ in range(3):
            b = list(a)
            for _ in range(rng.randrange(len(a) * (100 - percent) // 100 + 2)):
                at, what = rng.randrange(len(b)), rng.randrange(3)
                b[at : at + (what != 0)] = [f"w{rng.randrange(60)}"] * (what != 2)
            lines.append(b)
    lines = [x for x in lines if len(x) >= 5]
    top = list(range(len(lines)))
    for i, a in enumerate(lines):
        for j, b in enumerate(lines[:i]):
            most = max(len(a), len(b)) * (100 - percent) // 100
            if edit_distance(a, b, most) <= most and top[i] != top[j]:
                top = [top[j] if t == top[i] else t for t in top]
    rows = [(i, " ".join(x), None, None) for i, x in enumerate(lines)]
    kept = {r.doc_id for r in dedup_lines(table(spark, rows), percent=percent).where("n_removed = 0").collect()}
    assert kept == {top.index(t) for t in top}


def test_short_lines(spark, tmp_path):
    """Exact repeats of lines of 1 to 4 words go in op2 and the pipeline, near ones stay."""
    from corpus_pipeline import lines

    from vecspark.llm.queries import op2_line_dedup

    rows = [(1, "Home\none two three four\n---\n東京都", None, None), (2, "HOME!\none two three five\n---\nhome\n東京都\nx", None, None)]
    table(spark, rows).withColumn("n_chars", F.length("text").cast("long")).write.parquet(f"{tmp_path}/documents.parquet")
    assert [r.n_removed for r in op2_line_dedup(spark, str(tmp_path)).orderBy("doc_id").collect()] == [0, 3]
    kept = lines(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), "").orderBy("doc_id").collect()
    assert kept[1].text == "one two three five\n---\nx"


def test_tiles():
    assert greedy_tiles([1, 2, 3, 4, 5, 6], [4, 5, 6, 9, 1, 2, 3], 3) == [(0, 4, 3), (3, 0, 3)]
    assert greedy_tiles([1, 1, 1, 1], [1, 1, 1], 2) == [(0, 0, 3)]
    assert greedy_tiles([1, 2], [3, 4], 1) == []


def test_contaminated(spark):
    item = "one two three four five six seven eight nine ten"
    bench = spark.createDataFrame([(7, item), (8, None), (9, ""), (10, "too short")], "item_id long, text string")
    rows = [
        (1, f"before, {item.upper()}. after", None, None), (2, "six seven eight nine ten! then one two three four five", None, None),
        (3, "one two three something else", None, None), (4, None, None, None), (5, "too short", None, None), (None, item, None, None),
        (6, "one two three four FIVE six changed eight nine ten", None, None),
    ]
    for block in (1 << 25, 8):
        out = contaminated(table(spark, rows), bench, block_bytes=block).collect()
        assert sorted((str(r.doc_id), r.item_id, r.covered) for r in out) == [("1", 7, 10), ("2", 7, 10), ("6", 7, 9), ("None", 7, 10)]
    assert contaminated(table(spark, rows), bench.limit(0)).count() == 0


def test_html():
    page = '<title>x</title><h1>Hi &amp; you</h1><p>one<p>two <b>bo</b>ld<br>next<ul><li>a<li>b<ul><li>c</ul></ul><ol start=3><li>x</ol><table><tr><th>Name<th>N<tr><td>alpha<td>1</table><div style="display: none">no</div><pre> k\n  z</pre><script>"</p>"</script>end'
    assert render(page) == "Hi & you\n\none\n\ntwo bold\nnext\n\n- a\n- b\n  - c\n\n3. x\n\nName  | N\nalpha | 1\n\n k\n  z\n\nend"
    assert render("") == "" and render("<p") == "<p" and render("</td></p><td>a") == "a"
    assert render("<div>" * 5000 + "deep") == "deep"
    assert render("<table><tr><td>a<table><tr><td>in</table><td>b</table>").split() == ["a", "|", "b", "|", "in", "|"]


def test_html_all_visible():
    assert render("<p>a</p><table>x<tr>y<div>z</div><td>c<td>d<tbody><form>f<tr><td>e</form></table>g").split() == ["a", "xy", "z", "f", "c", "|", "d", "e", "g"]
    assert render("<table><tr><td>a</table>") == "a" and render("<table>x<table><tr><td>b</table>") == "x\n\nb"
    assert render("so <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>x=2</annotation></math> holds") == "so x=2 holds"
    assert render("<svg><title>t</title><desc>no</desc><text>one</text><g><text>two</text></g></svg>") == "one\ntwo"
    assert render("in <select><option>a<option selected>b</select> or <select><option>c<option>d</select>") == "in b or c"
    assert render("<select multiple><optgroup><option>a<optgroup><option>b</select>") == "a\nb"
    assert render("<textarea>\nk &amp;\n  l</textarea>") == "k &\n  l"


def test_preferences(spark):
    turns = [(0, 0, "user", "q"), (0, 1, "assistant", "a"), (1, 0, "user", "q"), (1, 1, "assistant", "b<|im_end|>"), (1, 2, "user", None), (2, 0, "user", "q"), (2, 1, "assistant", "a"), (None, 0, "user", "q"), (0, 0, "user", "q")]
    talks = conversations(spark.createDataFrame(turns, "conv_id long, turn int, role string, text string"))
    pairs = paired_by_opening(talks)
    assert sorted((r.chosen_id, r.rejected_id) for r in pairs.collect()) == [(0, 1), (1, 2)]
    assert [(r.chosen_id, r.rejected_id) for r in paired_by_number(talks).collect()] == [(0, 1)]
    r = format_preferences(talks, pairs).where("chosen_id = 0").first()
    assert r.shared_turns == 1 and r.prompt == "<|im_start|>user\nq<|im_end|>\n"
    assert [tuple(x) for x in r.chosen] == [("<|im_start|>assistant\na<|im_end|>\n", True)]
    assert [x.train for x in r.rejected] == [True, False] and r.rejected[0].text.count("<|im_end|>") == 1
    same = format_preferences(talks, spark.createDataFrame([(0, 2)], "chosen_id long, rejected_id long")).first()
    assert same.shared_turns == 2 and same.chosen == [] and same.rejected == []


def test_languages(spark):
    rng = random.Random(3)
    make = {"en": "the and of with this that from have".split(), "de": "der die und nicht mit auf für eine".split()}
    text = lambda lang, n: " ".join(rng.choice(make[lang]) for _ in range(n))
    train = table(spark, [(i, text(lang, 30), lang, None) for i, lang in enumerate(["en", "de"] * 20)] + [(99, None, "en", None), (98, "x", None, None)])
    model = fit_languages(train.select("text", "lang"))
    mixed = text("en", 30) + " " + text("de", 15)
    out = {r.doc_id: r for r in identify_languages(table(spark, [(1, text("en", 50), None, None), (2, text("de", 50), None, None), (3, mixed, None, None), (4, None, None, None), (5, "12 !?", None, None)]), model).collect()}
    assert [out[i].lang_pred for i in range(1, 6)] == ["en", "de", "en", "und", "und"]
    assert set(out[3].languages) == {"en", "de"} and abs(out[3].score - 2 / 3) < 0.1 and out[4].score == 0
    none = fit_languages(train.limit(0).select("text", "lang"))
    assert identify_languages(train, none).where("lang_pred <> 'und'").count() == 0


def test_four_languages(spark):
    rng = random.Random(8)
    make = {"en": "the and of with this that from have".split(), "de": "der die und nicht mit auf für eine".split(), "fr": "les vous être pour dans avec plus sont".split(), "pl": "się jest nie tak było przez który jego".split()}
    text = lambda lang, n: " ".join(rng.choice(make[lang]) for _ in range(n))
    model = fit_languages(table(spark, [(i, text(lang, 60), lang, None) for i, lang in enumerate(list(make) * 10)]).select("text", "lang"))
    mixed = " ".join([text("en", 80), text("de", 40), text("fr", 40), text("pl", 40)])
    out = identify_languages(table(spark, [(1, mixed, None, None)]), model).first()
    assert set(out.languages) == set(make) and out.lang_pred == "en" and abs(out.score - 0.4) < 0.05


def test_quality(spark):
    rng = random.Random(4)
    good = [words_of(rng, 40) for _ in range(60)]
    bad = [" ".join(w.upper() + "!!" for w in words_of(rng, 40).split()) for _ in range(60)]
    docs = table(spark, [(i, t, None, None) for i, t in enumerate(good + bad)] + [(500, None, None, None), (501, "", None, None)])
    labels = spark.createDataFrame([(i, int(i < 60), 0) for i in range(100)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    out = {r.doc_id: r for r in score_quality(docs, fit_quality(docs, labels)).collect()}
    assert all(out[i].predicted == int(i < 60) for i in range(120)) and 0 <= out[500].score <= 1 and out[500].score == out[501].score
    assert {r.score for r in score_quality(docs, fit_quality(docs, labels.limit(0))).collect()} == {0.5}


def test_targets(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 100), ("c", 100), (None, 40)], "source string, source_size long")
    got = {r.source: r.target for r in source_targets(sizes).collect()}
    # a and null (weight 5 again) are capped at 30 and 120; b and c share the other 100 by 2 and 1.
    assert {k: round(v, 9) for k, v in got.items()} == {"a": 30.0, "b": round(200 / 3, 9), "c": round(100 / 3, 9), None: 120.0}


def test_mixture(spark, corpus):
    docs = table(spark, corpus)
    rows = mixture(docs).collect()
    assert len(rows) == len(corpus) and sorted(rows, key=str) == sorted(mixture(docs).collect(), key=str)
    for s in {r.source for r in rows}:
        mine = [r for r in rows if r.source == s]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= 0.5 and all(0 <= r.taken <= 3 * r.size for r in mine)
    stream = curriculum(docs).collect()
    assert sum(r.words for r in stream) == sum(r.taken for r in rows)
    assert [r.position for r in stream] == sorted(r.position for r in stream) and all(0 <= r.position <= 1 for r in stream)
    assert mixture(docs.limit(0)).count() == 0 and curriculum(docs.limit(0)).count() == 0


def test_pipeline(spark, tmp_path):
    import corpus_pipeline as p

    rng = random.Random(9)
    item = words_of(rng, 20)
    good = [(i, words_of(rng, 60), "en", f"s{i % 2}", 1) for i in range(60)]
    bad = [(100 + i, " ".join(w.upper() + "!!" for w in words_of(rng, 60).split()), "en", "s0", 1) for i in range(60)]
    plant = [(300, good[0][1] + " more", "en", "s1", 1), (301, f"{words_of(rng, 30)} {item} {words_of(rng, 30)}", "en", "s1", 1), (302, None, None, None, None)]
    docs = spark.createDataFrame(good + bad + plant, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(r[0], int(r[0] < 100), 0) for r in good + bad], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept, now = [], docs
    for _, stage in p.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path))
        assert now.columns == docs.columns
        kept.append({r.doc_id for r in now.select("doc_id").collect()})
    assert {r[0] for r in good} <= kept[0] and not kept[0] & {r[0] for r in bad}
    assert {r[0] for r in good} <= kept[-1] and not kept[-1] & {300, 301}
    assert p.run(spark, str(tmp_path)).where(F.col("words") > F.col("size")).count() == 0
