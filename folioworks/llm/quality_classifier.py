"""Quality classifier: random Fourier features of document statistics, ridge regression, isotonic calibration.

Each whole text becomes a few statistics (never its labels, language, source or id).
Random cosines of the standardised statistics approximate a Gaussian kernel; each
partition sums its part of the normal equations, which are of a fixed size, and the
ridge solution's scores are made monotone in the labels' mean over bins of the score
(pool adjacent violators).  All labelled rows outside the held-out fifth are used.

Held out: crc32(doc_id as text) mod 5 is 0 (a null doc_id: the empty text's crc32, 0).
Null and empty texts have statistics too (zeros) and get a score.  Very long texts are measured whole.
Texts with the same statistics have the same score.  Repeated rows are
scored, and learnt from, each.  Without any label to learn from, all scores are 0.5.
An empty table gives an empty table.  Other columns aren't looked at.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text
from ._spark import written
from .quality_rules import duplicate_lines, repeated_window_words

NAMES = (
    "log_chars log_words word_length symbols bars bangs capitals digits punctuation wide breaks repeated same_lines distinct entropy line_words top_symbol bare_words"
).split()


def _table(members: bytes) -> np.ndarray:
    t = np.zeros(256, np.int64)
    t[list(members)] = 1
    return t


_SYMBOLS, _PUNCTUATION = _table(b"#*$%&|<>"), _table(b".,;:!?'\"()-")
_CAPITALS, _LETTERS, _DIGITS = _table(bytes(range(65, 91))), _table(bytes(range(65, 91)) + bytes(range(97, 123))), _table(b"0123456789")
_CHARS = ((np.arange(256) & 0xC0) != 0x80).astype(np.int64)


def statistics(column: pa.Array) -> np.ndarray:
    """(texts, NAMES): of whole texts."""
    data, at = _text.raw(_text.text_column(column))
    starts, ends, w_at = _text.words(data, at)
    n = np.diff(w_at)
    coded = _text.strings(data, starts, ends).dictionary_encode()
    ids = coded.indices.to_numpy().astype(np.int64)
    counts = _text.byte_counts(data, at)
    chars, letters = counts @ _CHARS, counts @ _LETTERS
    some, words, size = np.maximum(chars, 1), np.maximum(n, 1), np.maximum(counts.sum(axis=1), 1)
    doc = np.repeat(np.arange(len(n)), n)
    distinct = np.bincount(np.unique(doc * max(1, len(coded.dictionary)) + ids) // max(1, len(coded.dictionary)), minlength=len(n))
    p = counts / size[:, None]
    with np.errstate(divide="ignore", invalid="ignore"):
        entropy = -np.where(p > 0, p * np.log2(p), 0).sum(axis=1)
    has_letter = (_LETTERS + (np.arange(256) >= 128))[data] > 0
    total = np.r_[0, np.cumsum(has_letter)]
    bare = _text.sums(total[ends] == total[starts], w_at)
    return np.stack(
        [
            np.log1p(chars), np.log1p(n), (counts @ (_CHARS * _text.WORD_BYTES)) / words, counts @ _SYMBOLS / some, counts[:, 0x7C] / words, counts[:, 0x21] / words,
            counts @ _CAPITALS / np.maximum(letters, 1), counts @ _DIGITS / some, counts @ _PUNCTUATION / some, (size - chars) / size, counts[:, 10] / words,
            repeated_window_words(ids, w_at, len(coded.dictionary)) / words, duplicate_lines(data, at, starts) / (counts[:, 10] + 1), distinct / words, entropy,
            np.log1p(n / (counts[:, 10] + 1)), (counts * _SYMBOLS).max(axis=1) / words, bare / words,
        ],
        axis=1,
    )


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # statistics x features
    phases: np.ndarray
    solution: np.ndarray
    knots: np.ndarray
    values: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(self.knots):
            return np.full(len(x), 0.5)
        raw = features(x, self.mean, self.scale, self.weights, self.phases) @ self.solution
        return np.interp(raw, self.knots, self.values)


def features(x: np.ndarray, mean: np.ndarray, scale: np.ndarray, weights: np.ndarray, phases: np.ndarray) -> np.ndarray:
    z = np.clip((x - mean) / scale, -8, 8)
    return np.concatenate([np.cos(z @ weights + phases) * np.sqrt(2 / len(phases)), z / 8, np.ones((len(x), 1))], axis=1)


def pool(weight: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """The non-decreasing means nearest to the given ones (pool adjacent violators)."""
    blocks: list[list[float]] = []
    for w, m in zip(weight, mean):
        blocks.append([w, m, 1])
        while len(blocks) > 1 and blocks[-2][1] >= blocks[-1][1]:
            w2, m2, n2 = blocks.pop()
            w1, m1, n1 = blocks[-1]
            blocks[-1] = [w1 + w2, (w1 * m1 + w2 * m2) / (w1 + w2), n1 + n2]
    return np.concatenate([np.full(int(n), m) for _, m, n in blocks]) if blocks else np.zeros(0)


def document_statistics(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out and the statistics ``x`` of each text."""

    def run(batches):
        for batch in batches:
            for b in _text.blocks(batch, "text"):
                x = statistics(b.column(2))
                flat = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32()), pa.array(x.astype(np.float64).ravel()))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), flat], names=["doc_id", "held_out", "x"])

    held = F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 == 0
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), held.alias("held_out"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, x array<double>")


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), len(NAMES))


def fit(train: DataFrame, n_features: int = 192, width: float = 4.0, ridge: float = 1e-3, bins: int = 1024, groups: int = 8, seed: int = 7) -> Model:
    """From rows (x, y).  What reaches the driver is of a fixed size: a few sums, ``groups`` matrices, ``bins`` counts."""
    d = len(NAMES)
    rng = np.random.default_rng(seed)
    weights, phases = rng.normal(0, 1 / width, (d, n_features)), rng.uniform(0, 2 * np.pi, n_features)
    sums = [F.count(F.lit(1))] + [f(F.col("x")[i]) for i in range(d) for f in (F.avg, F.stddev_pop)]
    n, *moments = train.agg(*sums).head()
    none = np.zeros(0)
    if not n:
        return Model(none, none, weights, phases, none, none, none)
    mean, scale = np.array(moments[::2]), np.array(moments[1::2])
    scale = np.where(scale > 1e-9, scale, 1.0)

    def part(batches):
        a, b = 0.0, 0.0
        for t in batches:
            z = features(_matrix(t.column(0)), mean, scale, weights, phases)
            a, b = a + z.T @ z, b + z.T @ t.column(1).to_numpy()
        if not np.isscalar(a):
            yield pa.RecordBatch.from_arrays([pa.array([np.c_[a, b].tobytes()], pa.binary())], names=["sums"])

    def total(batches):
        s = 0.0
        for t in batches:
            for x in t.column(0).to_pylist():
                s = s + np.frombuffer(x)
        if not np.isscalar(s):
            yield pa.RecordBatch.from_arrays([pa.array([s.tobytes()], pa.binary())], names=["sums"])

    parts = train.select("x", F.col("y").cast("double").alias("y")).mapInArrow(part, "sums binary").repartition(groups).mapInArrow(total, "sums binary").collect()
    k = n_features + d + 1
    whole = sum(np.frombuffer(r.sums) for r in parts).reshape(k, k + 1)
    penalty = np.full(k, ridge * n / n_features)
    penalty[-1] = 1e-9
    solution = np.linalg.solve(whole[:, :k] + np.diag(penalty), whole[:, k])
    low, high = -0.5, 1.5

    def scored(batches):
        for t in batches:
            raw = features(_matrix(t.column(0)), mean, scale, weights, phases) @ solution
            which = np.clip((raw - low) / (high - low) * bins, 0, bins - 1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(which), t.column(1)], names=["bin", "y"])

    counted = train.select("x", F.col("y").cast("double").alias("y")).mapInArrow(scored, "bin int, y double").groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("m")).orderBy("bin").collect()
    values = pool(np.array([r.n for r in counted], float), np.array([r.m for r in counted]))
    knots = low + (np.array([r.bin for r in counted]) + 0.5) * (high - low) / bins
    return Model(mean, scale, weights, phases, solution, knots, values)


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, doc_id: str = "doc_id", text: str = "text", label: str = "quality", **fitting) -> DataFrame:
    """doc_id, held_out, score (0 to 1, higher: label 1 likelier) and predicted of each document."""
    stats = written(document_statistics(docs, doc_id, text), "statistics")
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).alias("y")).where("y is not null")
    train = written(stats.where(~F.col("held_out")).join(known, "doc_id").select("x", "y"), "train")
    model = docs.sparkSession.sparkContext.broadcast(fit(train, **fitting))

    def run(batches):
        for b in batches:
            score = model.value.score(_matrix(b.column(2)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return stats.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
