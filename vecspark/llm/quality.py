"""Quality by compression: which of two dictionaries, of good or of bad text, makes a document smaller?"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecspark.llm.common import lean_batches


class QualityModel(NamedTuple):
    """Dictionaries and the logistic calibration of the compressed sizes; bounded by dictionary_bytes."""

    good: bytes
    bad: bytes
    weights: tuple[float, ...]
    level: int


def _as_shape() -> bytes:
    table = np.arange(256, dtype=np.uint8)
    table[[*range(97, 123), *range(128, 256)]] = ord("a")
    table[65:91] = ord("A")
    table[48:58] = ord("0")
    table[9:14] = ord(" ")
    return table.tobytes()


#: The second view of a text: its letters, capitals and digits alike, so that layout counts in any language.
SHAPE = _as_shape()
VIEWS = (bytes, lambda t: t.translate(SHAPE))


def _compressor(content: bytes, level: int) -> zstandard.ZstdCompressor:
    d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    d.precompute_compress(level=level)
    return zstandard.ZstdCompressor(dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)


def _compressors(model: QualityModel) -> list[tuple[zstandard.ZstdCompressor, zstandard.ZstdCompressor]]:
    return [(_compressor(view(model.good), model.level), _compressor(view(model.bad), model.level)) for view in VIEWS]


def _features(texts: list[bytes], compressors: list) -> np.ndarray:
    """For the text and for its shape: the normalised difference of the compressed sizes, the same weighed by the
    text's size, and how far the better dictionary shrinks the text."""
    length = np.array([len(t) for t in texts], float)
    out = []
    for view, (good, bad) in zip(VIEWS, compressors, strict=True):
        sizes = np.array([(len(good.compress(v)), len(bad.compress(v))) for v in map(view, texts)], float).reshape(-1, 2)
        d = (sizes[:, 1] - sizes[:, 0]) / np.maximum(1.0, sizes.sum(1))
        out += [d, d * np.log2(1 + sizes.sum(1)), np.log((sizes.min(1) + 8) / (length + 8))]
    return np.stack(out, axis=1)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Newton steps for a logistic regression with intercept."""
    x = np.c_[np.ones(len(x)), x]
    w = np.zeros(x.shape[1])
    penalty = ridge * np.eye(len(w))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return w


def fit_quality(docs: DataFrame, labels: DataFrame, train: Column | None = None, per_class: int = 2000, longest: int = 20_000, dictionary_bytes: int = 1 << 18, level: int = 3) -> QualityModel:
    """Learn from labels (doc_id, quality) of rows where `train`, a condition on doc_id, holds.

    The sample is bounded: per label the `per_class` ids of least hash among those of documents of 1 to `longest` bytes
    (longer ones would crowd the dictionary), so the driver gets no more than 2 * per_class * longest bytes; of an id
    with several texts the first in byte order. Half of a class fills its dictionary; the other half calibrates. Rows with null id,
    null text or a label other than 0 and 1 are not learnt from. Without both classes every score is the share of
    label 1, or 0.5 without labels.
    """
    known = labels.where("quality IN (0, 1) AND doc_id IS NOT NULL").select("doc_id", "quality")
    if train is not None:
        known = known.where(train)
    fit = F.octet_length("text").between(1, longest)
    known = known.join(docs.where(fit).select("doc_id"), "doc_id", "left_semi")
    turn = F.xxhash64("doc_id")
    picked = None
    for q in (1, 0):
        some = known.where(F.col("quality") == q).orderBy(turn, "doc_id").limit(per_class)
        picked = some if picked is None else picked.unionAll(some)
    rows = docs.select("doc_id", "text").where(fit).join(F.broadcast(picked), "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text")).orderBy(turn, "doc_id", "quality").toPandas()
    rows = rows.drop_duplicates("doc_id")
    texts = {q: [t.encode() for t in rows.loc[rows["quality"] == q, "text"]] for q in (0, 1)}
    n = {q: len(texts[q]) for q in texts}
    if min(n.values()) < 4:
        p = n[1] / (n[0] + n[1]) if n[0] + n[1] else 0.5
        return QualityModel(b"\n" * 64, b"\n" * 64, (float(np.log(max(p, 1e-6) / max(1 - p, 1e-6))), *[0.0] * 6), level)
    content = {}
    for q in texts:
        taken, total = [], 0
        for t in texts[q][: n[q] // 2]:
            if total + len(t) <= dictionary_bytes:
                taken.append(t)
                total += len(t)
        content[q] = b"\n".join(taken) + b"\n" * 64
    # Equal sizes: a larger dictionary would shrink any text more.
    both = min(len(content[0]), len(content[1]))
    model = QualityModel(content[1][:both], content[0][:both], (), level)
    held = {q: texts[q][n[q] // 2 :] for q in texts}
    compressors = _compressors(model)
    x = np.r_[_features(held[1], compressors), _features(held[0], compressors)]
    y = np.r_[np.ones(len(held[1])), np.zeros(len(held[0]))]
    w = _logistic(x, y)
    return model._replace(weights=tuple(float(v) for v in w))


def _scores(model: QualityModel, columns: list[str], threshold: float) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressors = _compressors(model)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = [(t or "").encode() for t in part.column("text").to_pylist()]
                z = model.weights[0] + _features(texts, compressors) @ np.array(model.weights[1:])
                p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in columns), pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=[*columns, "score", "predicted"])

    return run


def score_quality(docs: DataFrame, model: QualityModel, threshold: float = 0.3) -> DataFrame:
    """docs with score (0 to 1, higher: label 1 likelier) and predicted (1 if score >= threshold, else 0).

    Every text is compressed whole. Null counts as empty; empty texts are scored by the same features, their sizes those
    of an empty frame.
    Columns of docs called score or predicted are replaced. Rows are scored alone: repeats get equal scores.
    """
    lean_batches(docs.sparkSession)
    docs = docs.drop("score", "predicted")
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema]
    return docs.mapInArrow(_scores(model, docs.columns, threshold), ", ".join([*fields, "score double", "predicted int"]))
