"""Quality: Naive Bayes support vectors over n-gram indicators, fitted by dual coordinate descent."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from tracewright.llm.linear import SAMPLE_ROWS, LinearModel, bucket, chosen, class_counts, design, feature_table, labelled_sample, scored
from tracewright.llm.shared import Words, combine

SMOOTHING, COST, EPOCHS = 1.0, 1.0, 12
#: Names of the n-gram families, so that equal codes of two families differ.
_WORD, _PAIR, _END, _SHAPE, _GAP, _BEAT = (np.uint64(i) for i in range(1, 7))

_KIND = np.zeros(256, np.int64)  # 0: lower-case letters and bytes of other scripts
_KIND[65:91] = 1
_KIND[48:58] = 2
_KIND[[ord(c) for c in ".,;:!?"]] = 3
_KIND[[ord(c) for c in "#*$%&|<>@_~^=+/\\"]] = 4


def _named(family: np.uint64, *parts: np.ndarray) -> np.ndarray:
    return combine(np.full(len(parts[0]), family), *parts)


def _runs(code: np.ndarray, doc: np.ndarray, orders: tuple[int, ...], family: np.uint64) -> list[tuple[np.ndarray, np.ndarray]]:
    """n-grams of a code sequence, within texts."""
    out = []
    for k in orders:
        m = len(code) - k + 1
        if m > 0:
            ok = np.flatnonzero(doc[:m] == doc[k - 1 :])
            out.append((doc[ok], _named(family, np.full(len(ok), k, np.uint64), *(code[ok + i] for i in range(k)))))
    return out


def quality_features(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """n-grams of words, of word shapes, of word ends, and of distances to a word's last use in its text."""
    n, doc, start, end, data = len(words.start), words.doc, words.start, words.end, words.data
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = words.hashes()
    counts = []
    for kind in (1, 2, 3, 4):
        sums = np.r_[0, np.cumsum(_KIND[data] == kind)]
        counts.append(sums[end] - sums[start])
    upper, digit, mark, symbol = counts
    letters = end - start - digit - mark - symbol
    shape = ((_KIND[data[start]] == 1) * 1 + ((upper >= 2) & (upper == letters)) * 2 + (digit > 0) * 4).astype(np.uint64)
    shape += (np.minimum(symbol, 3) * 8 + np.minimum(mark, 3) * 32 + (symbol == end - start) * 128).astype(np.uint64)
    order = np.lexsort((np.arange(n), h, doc))
    gap = np.zeros(n, np.int64)
    same = (h[order][1:] == h[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    gap[order[1:][same]] = order[1:][same] - order[:-1][same]
    near = np.where(gap <= 4, gap, 3 + np.ceil(np.log2(np.maximum(gap, 1))).astype(np.int64)).astype(np.uint64)
    beat = np.zeros(n, np.uint64)
    beat[1:] = (gap[1:] > 0) & (gap[1:] == gap[:-1])
    tail = np.zeros(n, np.uint64)
    for k in range(3):
        at = np.maximum(end - 1 - k, start)
        tail = tail * np.uint64(256) + data[at].astype(np.uint64)
    found = [(doc, _named(_WORD, h)), (doc, _named(_END, tail))]
    found += _runs(h, doc, (2,), _PAIR) + _runs(shape, doc, (1, 2, 3), _SHAPE) + _runs(np.minimum(near, 8), doc, (1, 2, 3), _GAP) + _runs(beat, doc, (4, 8), _BEAT)
    return np.concatenate([d for d, _ in found]), np.concatenate([bucket(f) for _, f in found])


def dual_coordinate_descent(y: np.ndarray, rows: list[np.ndarray], ratio: np.ndarray, cost: float = COST, epochs: int = EPOCHS, seed: int = 0) -> np.ndarray:
    """Weights of the linear hinge-loss machine for texts with values ratio / |ratio| at their features; y is -1 or 1.

    The last value is a constant feature. Each step solves one dual variable, kept between 0 and its class' cost.
    """
    w, alpha, rng = np.zeros(len(ratio) + 1), np.zeros(len(y)), np.random.default_rng(seed)
    norm = [max(np.sqrt((ratio[x] ** 2).sum()), 1e-6) for x in rows]

    def example(i: int) -> tuple[np.ndarray, np.ndarray]:  # made when it is asked for: all at once would take several times the rows' memory
        return np.append(rows[i], len(ratio)), np.append(ratio[rows[i]] / norm[i], 1.0)

    square = np.array([(v * v).sum() for _, v in map(example, range(len(rows)))])
    share = {c: max((y == c).mean(), 1e-9) for c in (-1, 1)}
    limit = np.array([cost * 0.5 / share[c] for c in y])
    for _ in range(epochs):
        for i in rng.permutation(len(y)):
            p, v = example(i)
            step = np.clip(alpha[i] - (y[i] * (w[p] @ v) - 1) / square[i], 0, limit[i]) - alpha[i]
            if step:
                alpha[i] += step
                w[p] += step * y[i] * v
    return w


def fit_probability(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve through margins, targets drawn in from 0 and 1 by the class sizes."""
    n1, n0 = (y > 0).sum(), (y < 0).sum()
    target = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        g = np.array([((p - target) * margin).sum(), (p - target).sum()])
        s = p * (1 - p)
        hess = np.array([[(s * margin**2).sum() + 1e-3, (s * margin).sum()], [(s * margin).sum(), s.sum() + 1e-3]])
        step = np.linalg.solve(hess, g)
        a, b = a - np.clip(step[0], -1, 1), b - np.clip(step[1], -1, 1)
    return float(max(a, 1e-3)), float(b)


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> LinearModel:
    """Fit on at most rows labelled training rows; without features or one of the classes the model is not fitted, and
    every score is the share of class 1, but a half at least."""
    table = feature_table(labelled_sample(docs, labels, "quality", rows), quality_features)
    feature, c1, c0, n1, n0 = class_counts(table)
    if not len(feature) or not n1 or not n0:
        return LinearModel(quality_features, feature[:0], np.zeros(0), max(0.0, float(np.log((n1 + 0.5) / (n0 + 0.5)))), fitted=False)
    p, q = c1 + SMOOTHING, c0 + SMOOTHING
    ratio = np.log((p / p.sum()) / (q / q.sum()))
    label, on, _ = design(table, feature)
    y = np.where(label > 0, 1, -1)
    w = dual_coordinate_descent(y, on, ratio)
    margin = np.array([w[x] @ ratio[x] / max(np.sqrt((ratio[x] ** 2).sum()), 1e-6) for x in on]) + w[-1]
    slope, offset = fit_probability(margin, y)
    return LinearModel(quality_features, feature, w[:-1] * ratio, slope * w[-1] + offset, slope, ratio**2)


def quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **options) -> DataFrame:
    """doc_id, held_out, score in 0..1 and predicted (score >= threshold) for every row of docs.

    Null and empty texts get the score of no n-grams. Ids may be of any type; a null id is scored and never held out.
    Repeated rows repeat. Empty docs give no rows. Labels without both classes among the documents give a constant score
    of a half or more, so every row is predicted 1. Other columns of docs and labels are not read.
    """
    return scored(docs, fit(docs, labels, **options), threshold)


def with_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **options) -> DataFrame:
    """The rows of docs, unchanged, whose own text scores threshold or more; the same cases as quality().

    A model that the labels could not fit rejects nothing, whatever the threshold.
    """
    model = fit(docs, labels, **options)
    return chosen(docs, model, threshold, 1) if model.fitted else docs
