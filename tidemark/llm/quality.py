"""Text quality by positive-unlabelled learning.

Trusted positives and unlabelled text of the training fold fit a logistic score by minimising
the unbiased risk ``pi * E_P[l(z)] + E_U[l(-z)] - pi * E_P[l(-z)]``. With the logistic loss this
is ``E_U[log(1 + exp z)] - pi * E_P[z]``, convex, and its minimum is the posterior. Newton steps
take sums over *all* rows, a pass of the cluster each. The part of the risk that stands for the
negatives, ``E_U[l(-z)] - pi * E_P[l(-z)]``, cannot be negative in truth; a step that makes it so
is halved until it is not. Labels enter as positives and as the class prior; the known negatives
of the training fold are used for nothing else.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import frames, words
from tidemark.llm.frames import staged

FOLDS = 5
CUT = 0.3
RIDGE = 1e-4
MOST_STEPS = 25
TOLERANCE = 1e-6
# Kinds of bytes: lower, upper, digit, mark, space, line end, wide.
_KIND = np.full(256, 6, np.uint8)
_KIND[:128] = 3
_KIND[97:123], _KIND[65:91], _KIND[48:58] = 0, 1, 2
_KIND[[0x20, 0x09, 0x0B, 0x0C, 0x0D]] = 4
_KIND[0x0A] = 5
FEATURES = (
    "length word_length upper digits marks wide line_ends doubled_marks ending_marks lone_marks short_words "
    "distinct_words top_word same_as_before distinct_pairs long_words capital_words marks_squared upper_squared "
    "repeats_squared doubled_root lone_root"
).split()


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0


def _per_row(rows: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(rows, values, n)


def features(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of features for each whole text; all zero for a text without words."""
    n = len(offsets) - 1
    starts, ends, rows = words.word_spans(raw, offsets)
    hashes = words.word_hashes(raw, starts, ends)
    count = np.maximum(words.row_counts(rows, n), 1).astype(float)
    kind = _KIND[raw]
    sums = np.zeros((7, n))
    for k in range(7):
        total = np.append(0, np.cumsum(kind == k))
        sums[k] = total[offsets[1:]] - total[offsets[:-1]]
    size = np.maximum(np.diff(offsets), 1)
    letters = np.maximum(sums[0] + sums[1] + sums[6], 1)
    mark = kind == 3
    doubled = np.append(0, np.cumsum(mark[1:] & (raw[1:] == raw[:-1]))) if len(raw) else np.zeros(1, int)
    ends_twice = (doubled[np.maximum(ends - 1, 0)] - doubled[starts]) > 0
    marks = np.append(0, np.cumsum(mark))
    all_marks = marks[ends] - marks[starts] == ends - starts
    length = ends - starts
    # Words and pairs by row, sorted, for distinct counts and the commonest word.
    order = np.lexsort((hashes, rows))
    h, r = hashes[order], rows[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    distinct = _per_row(r[new], np.ones(int(new.sum())), n)
    runs = np.diff(np.append(np.flatnonzero(new), len(h)))
    top = np.zeros(n)
    np.maximum.at(top, r[new], runs)
    same = np.zeros(len(h), bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (rows[1:] == rows[:-1])
    pairs, at = words.window_hashes(hashes, rows, 2)
    pair_rows = rows[at]
    order = np.lexsort((pairs, pair_rows))
    p, q = pairs[order], pair_rows[order]
    fresh = np.ones(len(p), bool)
    fresh[1:] = (p[1:] != p[:-1]) | (q[1:] != q[:-1])
    n_pairs = np.maximum(words.row_counts(pair_rows, n), 1)
    share = lambda x: _per_row(rows, x.astype(float), n) / count
    upper, some_marks = sums[1] / letters, sums[3] / size
    twice, lone, repeat = share(ends_twice), share(all_marks), share(same)
    ending = mark[np.maximum(ends - 1, 0)] & ~np.isin(raw[np.maximum(ends - 1, 0)], [0x2E, 0x2C]) if len(ends) else all_marks
    out = np.stack(
        [
            np.log1p(count),
            share(length),
            upper,
            sums[2] / size,
            some_marks,
            sums[6] / letters,
            sums[5] / count,
            twice,
            share(ending),
            lone,
            share(length <= 2),
            distinct / count,
            top / count,
            repeat,
            _per_row(q[fresh], np.ones(int(fresh.sum())), n) / n_pairs,
            share(length > 20),
            share(kind[starts] == 1) if len(starts) else repeat,
            some_marks**2,
            upper**2,
            repeat**2,
            np.sqrt(twice),
            np.sqrt(lone),
        ],
        axis=1,
    )
    out[words.row_counts(rows, n) == 0] = 0
    return out


def feature_rows(docs: DataFrame) -> DataFrame:
    """``doc_id, x`` of every row of ``docs(doc_id, text, ...)``."""

    def run(batches):
        for batch in batches:
            for part in frames.text_slices(batch, "text"):
                x = features(*frames.text_bytes(part.column("text")))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), frames.list_array(x.ravel(), np.full(len(x), x.shape[1]), pa.float64())],
                    names=["doc_id", "x"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, x array<double>")


@dataclass(frozen=True)
class QualityModel:
    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        z = _design(x, self.centre, self.scale) @ self.weights
        return 1 / (1 + np.exp(-z))


def _design(x: np.ndarray, centre: np.ndarray, scale: np.ndarray) -> np.ndarray:
    return np.concatenate([np.ones((len(x), 1)), np.clip((x - centre) / scale, -8, 8)], axis=1)


def _sums(rows: DataFrame, fn, size: int) -> np.ndarray:
    """Sum of ``fn(x, positive)`` over all rows: a vector of ``size`` for each task, added by the cluster."""

    def run(batches):
        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                x = batch.column("x").flatten().to_numpy().reshape(batch.num_rows, -1)
                total += fn(x, batch.column("positive").to_numpy(zero_copy_only=False))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(total)], names=["k", "v"])

    got = rows.select("x", "positive").mapInArrow(run, "k long, v double").groupBy("k").agg(F.sum("v").alias("v"))
    got = got.toArrow()
    out = np.zeros(size)
    out[got.column("k").to_numpy()] = got.column("v").to_numpy()
    return out


def newton(passes, width: int, prior: float) -> np.ndarray:
    """Weights of the least non-negative risk.

    ``passes(weights)`` gives, over unlabelled rows and positives: means of design rows of
    positives, the gradient and curvature of ``E_U[log(1 + exp z)]``, ``E_U[l(-z)]``,
    ``E_P[l(-z)]`` and ``E_P[l(z)]``.
    """
    weights = np.zeros(width)
    weights[0] = np.log(prior / (1 - prior))
    ridge = np.full(width, RIDGE)
    ridge[0] = 0
    at = passes(weights)
    for _ in range(MOST_STEPS):
        mean_p, gradient, curve, *_ = at
        slope = gradient - prior * mean_p + ridge * weights
        step = -np.linalg.solve(curve + np.diag(ridge + 1e-9), slope)
        risk = _risk(at, prior) + 0.5 * (ridge * weights**2).sum()
        size = 1.0
        while size > 1e-3:
            moved = weights + size * step
            new = passes(moved)
            negatives = new[3] - prior * new[4]
            if negatives >= 0 and _risk(new, prior) + 0.5 * (ridge * moved**2).sum() <= risk:
                break
            size /= 2
        else:
            break
        weights, at = moved, new
        if np.abs(size * step).max() < 1e-3 or risk - _risk(at, prior) < TOLERANCE:
            break
    return weights


def _risk(at, prior: float) -> float:
    _, _, _, unlabelled, positive_as_negative, positive = at
    return prior * positive + max(0.0, unlabelled - prior * positive_as_negative)


def fit(rows: DataFrame, prior: float) -> QualityModel:
    """Fit on ``rows(x, positive)``: every row is unlabelled text, ``positive`` marks trusted ones."""
    width = len(FEATURES)
    moments = _sums(rows, lambda x, p: np.concatenate([[len(x), p.sum()], x.sum(0), (x * x).sum(0)]), 2 + 2 * width)
    n, positives = max(moments[0], 1), max(moments[1], 1)
    centre = moments[2 : 2 + width] / n
    scale = np.sqrt(np.maximum(moments[2 + width :] / n - centre**2, 1e-12))
    d = width + 1

    def passes(weights):
        def one(x, positive):
            a = _design(x, centre, scale)
            z = a @ weights
            s = 1 / (1 + np.exp(-z))
            up, down = np.logaddexp(0, z), np.logaddexp(0, -z)
            return np.concatenate(
                [
                    a[positive].sum(0),
                    s @ a,
                    ((a * (s * (1 - s))[:, None]).T @ a).ravel(),
                    [up.sum(), up[positive].sum(), down[positive].sum()],
                ]
            )

        got = _sums(rows, one, 2 * d + d * d + 3)
        u, up, down = got[-3:]
        curve = got[2 * d : 2 * d + d * d].reshape(d, d) / n
        return got[:d] / positives, got[d : 2 * d] / n, curve, u / n, up / positives, down / positives

    return QualityModel(centre, scale, newton(passes, d, prior), prior)


def class_prior(labels: DataFrame) -> tuple[float, int]:
    """Share of trusted positives among labelled training rows, kept off 0 and 1, and their number."""
    known = labels.where("quality in (0, 1)").agg(F.avg("quality").alias("share"), F.sum("quality").alias("n")).first()
    if not known.n:
        return 0.5, 0
    return float(np.clip(known.share, 0.01, 0.99)), int(known.n)


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs(doc_id, text, ...)``.

    ``labels(doc_id, quality)`` are learnt from outside the held-out fold only, those whose
    crc32 of the id as text is 0 modulo 5. The score is the posterior of label 1, and
    ``predicted`` is 1 from ``CUT`` on. Only the text is scored.

    A null or empty text has the score of a text with all features 0. A row with a null id is
    scored, belongs to neither fold, and is not learnt from. Labels that are null or repeated
    count as given: a document with any label 1 is a positive. Without a positive to learn from
    every score is 0.5. Other columns are ignored. An empty table gives an empty result.
    """
    rows = staged(feature_rows(docs), "features")
    train = labels.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", "quality")
    prior, positives = class_prior(train)
    trusted = train.where("quality = 1").select("doc_id").distinct().withColumn("positive", F.lit(True))
    learnt = rows.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).join(trusted, "doc_id", "left")
    learnt = staged(learnt.select("x", F.coalesce("positive", F.lit(False)).alias("positive")), "learnt")
    model = fit(learnt, prior) if positives and not learnt.where("positive").isEmpty() else None

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            x = batch.column("x").flatten().to_numpy().reshape(n, len(FEATURES)) if n else np.zeros((0, len(FEATURES)))
            score = model.score(x) if model is not None else np.full(n, 0.5)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score)], names=["doc_id", "score"])

    scored = rows.mapInArrow(run, "doc_id long, score double")
    return scored.select(
        "doc_id",
        F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= CUT).cast("int").alias("predicted"),
    )
