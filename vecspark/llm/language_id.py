"""Language proportions of documents: expectation-maximisation over words, with n-gram likelihoods."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecspark.llm.common import by_bytes, lean_batches, text_bytes
from vecspark.llm.words import LOWER

BITS = 16
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


class LanguageModel(NamedTuple):
    """Log-likelihood of each n-gram bucket by language: languages * 2**BITS floats for any corpus."""

    languages: list[str]
    log_p: np.ndarray


def _grams(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A bucket for each letter byte with its two neighbours, where its words begin, and the row of each word."""
    data, offsets = text_bytes(batch.column("text"))
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    low = LOWER[data]
    upper = np.r_[False, data[:-1] == 0xC3] & (data >= 0x80) & (data <= 0x9E)  # capitals of Latin-1 in UTF-8
    low = np.where(_LETTER[data], low | (upper.astype(np.uint8) << 5), 0).astype(np.uint32)
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.r_[np.uint32(0), low[:-1]] * ~edge[:-1]
    after = np.r_[low[1:], np.uint32(0)] * ~edge[1:]
    code = ((before << 16 | low << 8 | after) * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)
    at = np.flatnonzero(low)
    starts = np.flatnonzero(before[at] == 0)
    return code[at].astype(np.int64), starts, np.searchsorted(offsets, at[starts], side="right") - 1


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str, np.ndarray] = {}
    for batch in by_bytes(batches):
        langs = np.array(batch.column("lang").to_pylist(), object)
        code, starts, rows = _grams(batch)
        of = np.repeat(rows, np.diff(np.r_[starts, len(code)]))
        for lang in set(langs):
            mine = code[(langs == lang)[of]] if len(code) else code
            total.setdefault(lang, np.zeros(1 << BITS, np.int64))
            total[lang] += np.bincount(mine, minlength=1 << BITS)
    for lang, n in total.items():
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(n[at])], names=["lang", "bucket", "n"])


def fit_languages(docs: DataFrame, smoothing: float = 0.5) -> LanguageModel:
    """Count letter trigrams of all rows of docs (text, lang) by language; rows with null lang teach nothing."""
    lean_batches(docs.sparkSession)
    rows = docs.where("lang IS NOT NULL").select("text", "lang").mapInArrow(_count, "lang string, bucket int, n long")
    rows = rows.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(set(rows["lang"]))
    n = np.full((len(languages), 1 << BITS), smoothing)
    n[rows["lang"].map({x: i for i, x in enumerate(languages)}).to_numpy(np.int64), rows["bucket"].to_numpy(np.int64)] += rows["n"].to_numpy(float)
    return LanguageModel(languages, np.log(n / n.sum(1, keepdims=True)).astype(np.float32))


def _mixtures(like: np.ndarray, top: np.ndarray, begin: np.ndarray, rows: np.ndarray, allowed: np.ndarray, tolerance: float) -> tuple[np.ndarray, np.ndarray]:
    """Proportions and log-likelihood for each text, languages limited to `allowed`; texts leave as they converge.

    like: each word's likelihood by language over its best one, top: the log of that one; begin: first word of a text.
    """
    share = allowed / allowed.sum(1, keepdims=True)
    left, some, at, first = np.arange(len(share)), like, rows, begin
    while len(left):
        joint = share[left][at] * some
        joint /= np.maximum(joint.sum(1), 1e-300)[:, None]
        new = np.add.reduceat(joint, first, axis=0) / np.diff(np.r_[first, len(some)])[:, None]
        moves = np.abs(new - share[left]).max(1) > tolerance
        share[left] = new
        if not moves.all():
            words = moves[at]
            left, some = left[moves], some[words]
            at = (np.cumsum(moves) - 1)[at[words]]
            first = np.searchsorted(at, np.arange(len(left)))
    total = (share[rows] * like).sum(1)
    return share, np.add.reduceat(np.log(np.maximum(total, 1e-300)) + top, begin)


def infer(batch: pa.RecordBatch, model: LanguageModel, most: int | None, penalty: float, tolerance: float) -> np.ndarray:
    """Language proportions of each text of a batch; a row of zeros where a text has no letters."""
    code, starts, word_row = _grams(batch)
    out = np.zeros((batch.num_rows, len(model.languages)))
    if not len(starts) or not model.languages:
        return out
    log_p = np.stack([np.add.reduceat(p[code], starts) for p in model.log_p], axis=1).astype(np.float64)
    top = log_p.max(1)
    like = np.exp(log_p - top[:, None])
    present, begin = np.unique(word_row, return_index=True)
    n = np.diff(np.r_[begin, len(word_row)])
    rows = np.repeat(np.arange(len(present)), n)
    share, full = _mixtures(like, top, begin, rows, np.ones((len(present), like.shape[1])), tolerance)
    order = np.argsort(-share, axis=1, kind="stable")
    rank = np.argsort(order, axis=1, kind="stable")
    best = (rank == 0).astype(float)
    # One language alone fits as the sum of its log-likelihoods. No set fits better than all languages together, so sets
    # of more are tried only where those beat it by more than the penalty of a second language.
    one = np.add.reduceat(np.take_along_axis(log_p, order[rows][:, :1], axis=1)[:, 0], begin)
    mixed = np.flatnonzero(full - penalty * np.log(n + 1) > one)
    if len(mixed):
        mine = np.isin(rows, mixed)
        sub_rows = np.searchsorted(mixed, rows[mine])
        sub_begin = np.searchsorted(sub_rows, np.arange(len(mixed)))
        fit = None
        for k in range(1, min(most or share.shape[1], share.shape[1]) + 1):
            got, log_like = _mixtures(like[mine], top[mine], sub_begin, sub_rows, (rank[mixed] < k).astype(float), tolerance)
            value = log_like - penalty * (k - 1) * np.log(n[mixed] + 1)
            if fit is None:
                fit, chosen = value, got
            else:
                better = value > fit
                fit[better], chosen[better] = value[better], got[better]
        best[mixed] = chosen
    out[present] = best
    return out


def _predict(model: LanguageModel, columns: list[str], most: int | None, penalty: float, tolerance: float) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*model.languages, "und"], object)
        for batch in by_bytes(batches):
            share = infer(batch, model, most, penalty, tolerance)
            data, offsets = text_bytes(batch.column("text"))
            ascii_letters = np.r_[0, np.cumsum(_LETTER[data] & (data < 128))]
            known = ascii_letters[offsets[1:]] > ascii_letters[offsets[:-1]]
            for i in np.flatnonzero(~known & (share.sum(1) > 0)):
                known[i] = any(c.isalpha() for c in batch.column("text")[int(i)].as_py() or "")
            share[~known] = 0
            best = share.argmax(1) if share.shape[1] else np.zeros(len(share), int)
            score = share.max(1) if share.shape[1] else np.zeros(len(share))
            lang = names[np.where(score > 0, best, len(names) - 1)]
            mix = [sorted(((names[j], float(s[j])) for j in np.flatnonzero(s)), key=lambda x: (-x[1], x[0])) for s in share]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in columns), pa.array(lang, pa.string()), pa.array(np.clip(score, 0, 1)), pa.array([[x[0] for x in m] for m in mix], pa.list_(pa.string())), pa.array([[x[1] for x in m] for m in mix], pa.list_(pa.float64()))],
                names=[*columns, "lang_pred", "score", "languages", "proportions"],
            )

    return run


def identify_languages(docs: DataFrame, model: LanguageModel, most: int | None = None, penalty: float = 2.0, tolerance: float = 1e-3) -> DataFrame:
    """docs with lang_pred, score (its proportion), languages and proportions of every whole text.

    A text's words are draws from a mixture of the languages; a word's likelihood is the product of its letter
    trigrams'. Expectation-maximisation finds the proportions, until none moves by more than `tolerance`; the language set is the one of up to `most` languages
    (None: all learnt), by proportion, with the best log-likelihood less `penalty` * log(words) for each language beyond the first.
    lang_pred is the language of most words. `und`, score 0 and empty lists where text is null or has no letter, or
    nothing was learnt. Ties go to the language first in code point order. Columns of docs with the added names are
    replaced; rows are judged alone, so repeats agree. A very long text takes a row of proportions for each of its words.
    No rows in, no rows out.
    """
    lean_batches(docs.sparkSession)
    docs = docs.drop("lang_pred", "score", "languages", "proportions")
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema]
    schema = ", ".join([*fields, "lang_pred string", "score double", "languages array<string>", "proportions array<double>"])
    return docs.mapInArrow(_predict(model, docs.columns, most, penalty, tolerance), schema)
