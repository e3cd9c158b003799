"""Operators that SQL can't express against plain Python: decontamination, language mixtures, compressed sizes, lines."""

import math
import random
import re

import pyarrow as pa
import zstandard

from tests.llm.test_llm import lower, table, words_of
from tests.llm.test_queries import naive_tiles
from vecspark.llm.decontaminate import contaminated
from vecspark.llm.language_id import _grams, fit_languages, identify_languages
from vecspark.llm.line_dedup import dedup_lines, edit_distance
from vecspark.llm.quality import SHAPE, fit_quality, score_quality


def test_decontamination_brute(spark):
    """Every pair whose naive tiling covers enough of the item is found, whatever the order of the passages, and no other."""
    rng = random.Random(21)
    items = [words_of(rng, rng.choice([3, 5, 8, 12, 20])) for _ in range(25)]
    rows = []
    for i in range(120):
        words = rng.choice(items).split()
        cut = rng.randrange(len(words))
        parts = [words[cut:], words[:cut]] if rng.random() < 0.5 else [words]
        for part in parts:
            for _ in range(rng.randrange(3)):
                if part:
                    part[rng.randrange(len(part))] = "zz" + "q" * rng.randrange(3)
        rows.append((i, f"{words_of(rng, 6)} {' '.join(sum(parts, []))}, {words_of(rng, 6)}".upper(), None, None))
    split = lambda t: re.findall("[0-9a-z]+", lower(t))
    want = set()
    for i, t, _, _ in rows:
        for k, item in enumerate(items):
            a, b = split(item), split(t)
            tiles = naive_tiles(a, b, 3)
            covered = sum(n for _, _, n in tiles)
            if covered >= 0.8 * len(a) if len(a) >= 8 else (len(tiles), covered) == (1, len(a)):
                want.add((i, k, covered))
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    out = contaminated(table(spark, rows), bench)
    assert {(r.doc_id, r.item_id, r.covered) for r in out.collect()} == want and len(want) > 20


def test_languages_brute(spark):
    """Expectation-maximisation word by word in plain Python, on every nested set of languages."""
    rng = random.Random(22)
    make = {"de": "der die und nicht mit auf eine".split(), "en": "the and of with this that from".split(), "pl": "jest nie tak przez kt ale".split()}
    text = lambda lang, n: " ".join(rng.choice(make[lang]) for _ in range(n))
    model = fit_languages(table(spark, [(i, text(lang, 40), lang, None) for i, lang in enumerate(list(make) * 8)]).select("text", "lang"))
    rows = [(i, " ".join(text(lang, rng.choice([0, 0, 3, 20, 60])) for lang in make) + " x", None, None) for i in range(25)]
    out = {r.doc_id: r for r in identify_languages(table(spark, rows), model).collect()}

    def mixture(words, allowed):
        share = [1 / len(allowed) if j in allowed else 0.0 for j in range(len(make))]
        for _ in range(3000):
            total = [0.0] * len(make)
            for w in words:
                joint = [s * math.exp(x - max(w)) for s, x in zip(share, w, strict=True)]
                for j, x in enumerate(joint):
                    total[j] += x / sum(joint)
            new = [x / len(words) for x in total]
            done, share = max(abs(x - y) for x, y in zip(new, share, strict=True)) < 1e-5, new
            if done:
                break
        return share, sum(max(w) + math.log(sum(s * math.exp(x - max(w)) for s, x in zip(share, w, strict=True))) for w in words)

    for i, t, _, _ in rows:
        code, starts, _ = _grams(pa.RecordBatch.from_pydict({"text": [t]}))
        ends = [*starts[1:].tolist(), len(code)]
        words = [[float(p[code[a:b]].sum(dtype=float)) for p in model.log_p] for a, b in zip(starts.tolist(), ends, strict=True)]
        full, _ = mixture(words, range(len(make)))
        order = sorted(range(len(make)), key=lambda j: -full[j])
        tried = []
        for k in range(1, len(make) + 1):
            share, fit = mixture(words, order[:k])
            tried.append((fit - 2.0 * (k - 1) * math.log(len(words) + 1), share))
        share = max(tried, key=lambda x: x[0])[1]
        assert abs(out[i].score - max(share)) < 0.02 and out[i].lang_pred == model.languages[share.index(max(share))]


def test_quality_brute(spark):
    """Scores from a plain loop over one compressor a class."""
    rng = random.Random(23)
    docs = [(i, words_of(rng, rng.randint(1, 60)) if i % 2 else " ".join(w.upper() + "!" for w in words_of(rng, 40).split()), None, None) for i in range(80)]
    docs += [(90, None, None, None), (91, "é" * 3000, None, None), (91, "other text", None, None)]
    model = fit_quality(table(spark, docs), spark.createDataFrame([(i, i % 2, 0) for i in range(80)], "doc_id long, quality int, toxic int"))
    again = fit_quality(table(spark, docs[::-1]), spark.createDataFrame([(i, i % 2, 0) for i in range(80)], "doc_id long, quality int, toxic int"))
    assert model == again

    def size(view, content):
        d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        return len(zstandard.ZstdCompressor(level=model.level, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False).compress(view))

    out = score_quality(table(spark, docs), model).collect()
    for r in out:
        t, z = (r.text or "").encode(), model.weights[0]
        for k, view in enumerate((bytes, lambda x: x.translate(SHAPE))):
            good, bad = size(view(t), view(model.good)), size(view(t), view(model.bad))
            d = (bad - good) / (good + bad)
            values = (d, d * math.log2(1 + good + bad), math.log((min(good, bad) + 8) / (len(t) + 8)))
            z += sum(w * v for w, v in zip(model.weights[1 + 3 * k : 4 + 3 * k], values, strict=True))
        assert abs(r.score - 1 / (1 + math.exp(-z))) < 1e-6 and r.predicted == int(r.score >= 0.3)


def test_lines_of_a_crowd(spark):
    """A key of more lines than are paired at once: template lines in many versions, some of which link through others."""
    rng = random.Random(24)
    base = [f"w{i}" for i in range(30)]
    lines = []
    for _ in range(150):
        b = list(base)
        for _ in range(rng.choice([1, 3, 6, 9])):
            b[rng.randrange(4, 30)] = f"v{rng.randrange(40)}"
        lines.append(b)
    top = list(range(len(lines)))
    for i, a in enumerate(lines):
        for j, b in enumerate(lines[:i]):
            if top[i] != top[j] and edit_distance(a, b, 6) <= 6:
                top = [top[j] if t == top[i] else t for t in top]
    kept = {r.doc_id for r in dedup_lines(table(spark, [(i, " ".join(x), None, None) for i, x in enumerate(lines)])).where("n_removed = 0").collect()}
    assert kept == {top.index(t) for t in top}
