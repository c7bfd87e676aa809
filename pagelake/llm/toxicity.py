"""Toxicity grades by cumulative-link ordinal regression."""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship
from .text import ALNUM, U64, hash_spans, lower, pieces, words

#: Words are hashed to so many features; at most so many labelled rows are learned from, those with the least hash of doc_id.
FEATURES, SAMPLE_ROWS = 1 << 20, 12_000
#: Words enter the model in rounds, those whose score statistic on what is unexplained reaches LEAST_Z and half of the round's
#: highest; with fewer than MANY rows above the lowest grade the bar falls with the square root of their number, as the statistic
#: of a word that all of them have does; strength of the penalty on weights; steps of the descent in a round.
ROUNDS, LEAST_Z, MANY, PENALTY, STEPS = 12, 6.0, 40, 1e-5, 300
#: Probability of any grade above 0 from which a document is flagged.
FLAG = 0.5
#: Bytes of the word beginnings that are features beside whole words: stems carry many endings.
BEGINNINGS = (4, 5, 6, 7, 8)


def features(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, features, row of each, value of each): the distinct words of each text, letters and digits in lower case, and their beginnings; the value is log2(1 + times that it stands there)."""
    for lo, hi, data, offsets in pieces(column):
        data = lower(data)
        s, e, rows = words(data, offsets, ALNUM)
        keys = [rows * FEATURES + (hash_spans(data, s, e) >> U64(44)).astype(np.int64)]
        for n in BEGINNINGS:
            long = np.flatnonzero(e - s > n)
            h = hash_spans(data, s[long], s[long] + n) ^ U64(0x5851F42D4C957F2D)
            keys.append(rows[long] * FEATURES + (h >> U64(44)).astype(np.int64))
        both, times = np.unique(np.concatenate(keys), return_counts=True)
        yield lo, hi, both % FEATURES, both // FEATURES, np.log2(1 + times).astype(np.float32)


def grades(labels: DataFrame) -> DataFrame:
    """(doc_id, grade) from labels whose toxic is a grade: 0 is clean, more is worse; of several labels the highest. Null or negative: no grade.

    The other label, quality, says nothing about how toxic a text is and isn't used."""
    return labels.where("doc_id IS NOT NULL AND toxic >= 0").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("grade"))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(x / 2))


def fit(rows: np.ndarray, feats: np.ndarray, values: np.ndarray, y: np.ndarray, levels: int, width: int = FEATURES) -> tuple[np.ndarray, np.ndarray]:
    """(weights, thresholds) of P(grade > k) = sigmoid(w.x - t[k]); feats are below `width`.

    Words that only come with toxic documents by being in copies of one are many, and words that make them toxic are few.
    So words are let in stagewise: of those that speak most for the grades that the model so far leaves open. Words that speak for
    clean texts stay out, so a text that has none of them isn't toxic for that."""
    n = len(y)
    least = LEAST_Z * min(1.0, math.sqrt((y > 0).sum() / MANY))
    inside = np.zeros(width, bool)
    w, t = np.zeros(width), _logit(_shares(y, levels))
    for _ in range(ROUNDS):
        eta = np.bincount(rows, w[feats] * values, n)
        p = _sigmoid(eta[:, None] - t[None])
        open_part = ((y[:, None] > np.arange(levels - 1)) - p).sum(1)
        told = np.bincount(feats, open_part[rows] * values, width)
        spread = np.bincount(feats, np.maximum((p * (1 - p)).sum(1), 0.01)[rows] * values**2, width)
        z = np.where(inside, 0.0, told / np.sqrt(np.maximum(spread, 1e-9)))
        new = z >= max(least, z.max() / 2)
        if not new.any():
            break
        inside |= new
        mine = inside[feats]
        used, local = np.unique(feats[mine], return_inverse=True)
        beta, t = _descend(rows[mine], local, values[mine], y, levels, w[used])
        w = np.zeros(width)
        w[used] = beta
    return w, t


def _shares(y: np.ndarray, levels: int) -> np.ndarray:
    """Share of rows above each grade."""
    return np.clip([(y > k).mean() for k in range(levels - 1)], 1e-6, 1 - 1e-6)


def _logit(p: np.ndarray) -> np.ndarray:
    return -np.log(p / (1 - p))


def _descend(rows: np.ndarray, local: np.ndarray, values: np.ndarray, y: np.ndarray, levels: int, beta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights of the words let in, and thresholds, by Adam on the penalised mean log-likelihood, all rows each step.

    Thresholds are the first and exponentials of steps, so they ascend: a higher grade is never likelier to be passed."""
    n, m = len(y), len(beta)
    first = _logit(_shares(y, levels))
    params = np.concatenate([beta, first[:1], np.log(np.maximum(np.diff(first), 0.1))])
    mean, square = np.zeros_like(params), np.zeros_like(params)
    every = np.arange(n)
    for step in range(1, STEPS + 1):
        beta, gap = params[:m], params[m:]
        t = np.cumsum(np.concatenate([gap[:1], np.exp(gap[1:])]))
        eta = np.bincount(rows, beta[local] * values, n)
        above = np.concatenate([np.ones((n, 1)), _sigmoid(eta[:, None] - t[None]), np.zeros((n, 1))], 1)
        p = np.maximum(above[every, y] - above[every, y + 1], 1e-12)
        slope = above * (1 - above)
        d_eta = -(slope[every, y] - slope[every, y + 1]) / p / n
        d_t = np.bincount(np.maximum(y - 1, 0), np.where(y > 0, slope[every, y] / p / n, 0.0), levels - 1)
        d_t = d_t + np.bincount(np.minimum(y, levels - 2), np.where(y < levels - 1, -slope[every, y + 1] / p / n, 0.0), levels - 1)
        d_gap = np.array([d_t[k:].sum() * (1 if k == 0 else np.exp(gap[k])) for k in range(levels - 1)])
        grad = np.concatenate([np.bincount(local, d_eta[rows] * values, m) + PENALTY * beta, d_gap])
        mean = 0.9 * mean + 0.1 * grad
        square = 0.98 * square + 0.02 * grad * grad
        params = params - 0.1 * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.98**step)) + 1e-8)
    gap = params[m:]
    return params[:m], np.cumsum(np.concatenate([gap[:1], np.exp(gap[1:])]))


class Model(NamedTuple):
    """Weights of the features `used`, thresholds, and the grades that these part; all but the weights ascend."""

    weights: np.ndarray
    thresholds: np.ndarray
    used: np.ndarray
    grades: np.ndarray


#: Of documents where nothing could be learned: no grade but 0.
NOTHING = Model(np.zeros(0, np.float32), np.zeros(0), np.zeros(0, np.int64), np.zeros(1, np.int64))


def train(docs: DataFrame, graded: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """The model, from a bounded sample of the labelled rows, whose ids go to every executor. Any two grades or more will do; with fewer nothing can be learned, and all documents have grade 0."""
    ship(docs.sparkSession)
    chosen = graded.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    rows = docs.where("doc_id IS NOT NULL").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", F.col("grade").cast("long").alias("grade"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, f, r, v in features(b.column("text")):
                per = np.bincount(r, minlength=hi - lo)
                upto = np.concatenate([[0], np.cumsum(per)])
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(lo, hi - lo), b.column("grade").slice(lo, hi - lo), pa.array([f[a:z].astype("<i4").tobytes() for a, z in zip(upto[:-1], upto[1:], strict=True)], pa.binary()), pa.array([v[a:z].astype("<f4").tobytes() for a, z in zip(upto[:-1], upto[1:], strict=True)], pa.binary())], ["doc_id", "grade", "f", "v"])

    got = sorted(rows.mapInArrow(run, "doc_id long, grade long, f binary, v binary").collect(), key=lambda r: (r["doc_id"], r["f"], r["v"]))  # at most sample_rows
    grades, y = np.unique(np.array([r["grade"] for r in got], np.int64), return_inverse=True)
    if len(grades) < 2:
        return NOTHING
    r = np.repeat(np.arange(len(got), dtype=np.int32), [len(r["f"]) // 4 for r in got])
    values = np.frombuffer(b"".join(r["v"] for r in got), "<f4")
    feats = np.frombuffer(b"".join(r["f"] for r in got), "<i4")
    del got  # the driver's memory is small
    number = np.zeros(FEATURES, np.int32)
    number[feats] = 1
    seen = np.flatnonzero(number)
    number[seen] = np.arange(len(seen))
    feats = number[feats]
    w, t = fit(r, feats, values, y, len(grades), max(1, len(seen)))
    used = np.flatnonzero(w)
    return Model(w[used].astype(np.float32), t, seen[used].astype(np.int64), grades)


def score(docs: DataFrame, model: Model, flag: float = FLAG) -> DataFrame:
    """Per document: doc_id, severity (expected grade), grade (the likeliest; of equal ones the lowest), p_toxic (any grade above 0), toxic (p_toxic >= flag).

    Every word of the whole text counts, and how often it stands; a null or empty text has the grade of no words at all. Grades are
    those of the labels, whatever their numbers; severity lies between the lowest and the highest. Repeated rows are scored alike.
    The weights go to the executors once: FEATURES numbers."""
    ship(docs.sparkSession)
    weights = np.zeros(FEATURES, np.float32)
    weights[model.used] = model.weights
    shared = docs.sparkSession.sparkContext.broadcast((weights, model.thresholds, model.grades))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, t, levels = shared.value
        for b in batches:
            for lo, hi, f, r, v in features(b.column("text")):
                eta = np.bincount(r, w[f] * v, hi - lo)
                above = np.concatenate([np.ones((hi - lo, 1)), _sigmoid(eta[:, None] - t[None]), np.zeros((hi - lo, 1))], 1)
                p = -np.diff(above, axis=1)
                toxic = above[:, np.searchsorted(levels, 0, "right")]  # the first grade above 0, or the end
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(lo, hi - lo), pa.array(p @ levels.astype(float)), pa.array(levels[p.argmax(1)].astype(np.int32)), pa.array(toxic), pa.array(toxic >= flag)], ["doc_id", "severity", "grade", "p_toxic", "toxic"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, severity double, grade int, p_toxic double, toxic boolean")
