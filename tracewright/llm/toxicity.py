"""Toxicity: logistic regression with a penalty on what swapping identity terms does to a score."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame

from tracewright.llm.linear import SAMPLE_ROWS, LinearModel, bucket, chosen, class_counts, design, feature_table, labelled_sample, scored
from tracewright.llm.shared import Words

# Identity terms; each stands for the next one of its row when a counterfactual is made.
IDENTITY_TERMS = (
    ("man", "woman"),
    ("men", "women"),
    ("he", "she"),
    ("his", "her"),
    ("boy", "girl"),
    ("christian", "muslim", "jew", "hindu", "buddhist", "atheist"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("african", "european", "american", "mexican", "chinese", "indian"),
    ("er", "sie"),
    ("mann", "frau"),
    ("il", "elle"),
    ("homme", "femme"),
    ("hombre", "mujer"),
    ("él", "ella"),
)

PREFIXES = (3, 4, 5, 6, 8)
RIDGE, COUNTERFACTUAL, STEPS = 1e-3, 8.0, 300
#: Features of the model, at most; more of them only fit chance differences of the sample.
MODEL_FEATURES = 1024


def toxicity_features(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased words and their first bytes, which also catch inflected forms."""
    parts = [words.hashes(lower=True), *words.hashes(lower=True, prefixes=PREFIXES)]
    long = [np.ones(len(words.start), bool), *(words.end - words.start >= k for k in PREFIXES)]
    return np.concatenate([words.doc[ok] for ok in long]), np.concatenate([bucket(p[ok]) for p, ok in zip(parts, long)])


def identity_swap(terms: tuple[tuple[str, ...], ...] = IDENTITY_TERMS):
    """A function that gives a text with each identity term changed to the next of its row, or None if it has none."""
    follow = {t: row[(i + 1) % len(row)] for row in terms for i, t in enumerate(row)}
    pattern = re.compile(r"\b(" + "|".join(sorted(map(re.escape, follow), key=len, reverse=True)) + r")\b", re.IGNORECASE)

    def swap(text: str) -> str | None:
        out, n = pattern.subn(lambda m: follow[m[0].lower()], text)
        return out if n else None

    return swap


def fit_logistic(y: np.ndarray, on: list[np.ndarray], off: list[np.ndarray | None], size: int, ridge: float = RIDGE, counterfactual: float = COUNTERFACTUAL, steps: int = STEPS) -> tuple[np.ndarray, float]:
    """Mean log loss + ridge / sqrt(texts) |w|^2 + counterfactual * mean (change of the swapped texts' scores)^2, by scaled gradient steps."""
    w, b = np.zeros(size), 0.0
    if not len(y) or not size:
        return w, b
    row = np.repeat(np.arange(len(y)), [len(x) for x in on])
    col = np.concatenate(on)
    swapped = np.array([k for k, z in enumerate(off) if z is not None], int)
    gained = [(np.setdiff1d(off[k], on[k]), np.setdiff1d(on[k], off[k])) for k in swapped]
    change_row = np.repeat(np.arange(len(gained)), [len(a) + len(c) for a, c in gained])
    change_col = np.concatenate([np.r_[a, c] for a, c in gained]) if gained else np.zeros(0, int)
    change_sign = np.concatenate([np.r_[np.ones(len(a)), -np.ones(len(c))] for a, c in gained]) if gained else np.zeros(0)
    change_col = change_col.astype(int)
    memory, memory_b = np.full(size, 1e-8), 1e-8
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, w[col], len(y)) + b, -30, 30)))
        pull = (p - y) / len(y)
        if len(gained):
            # a score's slope here and in the swapped text, whose margin differs by the features gained and lost
            q = p[swapped]
            margin = np.log(q / (1 - q)) + np.bincount(change_row, change_sign * w[change_col], len(gained))
            other = 1 / (1 + np.exp(-np.clip(margin, -30, 30)))
            force = 2 * counterfactual / len(gained) * (other - q)
            pull[swapped] += force * (other * (1 - other) - q * (1 - q))
            moved = force * other * (1 - other)
        g = np.bincount(col, pull[row], size) + 2 * ridge * w / len(y) ** 0.5
        if len(gained):
            g += np.bincount(change_col, change_sign * moved[change_row], size)
        gb = pull.sum()
        memory += g * g
        memory_b += gb * gb
        w -= 0.3 * g / np.sqrt(memory)
        b -= 0.3 * gb / np.sqrt(memory_b)
    return w, b


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, terms: tuple[tuple[str, ...], ...] = IDENTITY_TERMS, counterfactual: float = COUNTERFACTUAL) -> LinearModel:
    """Fit on at most rows labelled training rows; without features or one of the classes the model is not fitted and
    every score is the share of class 1, but less than a half."""
    table = feature_table(labelled_sample(docs, labels, "toxic", rows), toxicity_features, identity_swap(terms))
    feature, _, _, n1, n0 = class_counts(table, MODEL_FEATURES)
    if not len(feature) or not n1 or not n0:
        return LinearModel(toxicity_features, feature[:0], np.zeros(0), min(-0.1, float(np.log((n1 + 0.5) / (n0 + 0.5)))), fitted=False)
    y, on, off = design(table, feature)
    weight, bias = fit_logistic(y, on, off, len(feature), counterfactual=counterfactual)
    return LinearModel(toxicity_features, feature, weight, bias)


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **options) -> DataFrame:
    """doc_id, held_out, score in 0..1 and predicted (score >= threshold) for every row of docs.

    Null and empty texts get the score of no words. Ids may be of any type; a null id is scored and never held out.
    Repeated rows repeat. Empty docs give no rows. Labels without both classes among the documents give a constant score
    of less than a half, so every row is predicted 0. Other columns of docs and labels are not read.
    """
    return scored(docs, fit(docs, labels, **options), threshold)


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **options) -> DataFrame:
    """The rows of docs, unchanged, whose own text scores below threshold; the same cases as toxicity().

    A model that the labels could not fit rejects nothing, whatever the threshold.
    """
    model = fit(docs, labels, **options)
    return chosen(docs, model, threshold, 0) if model.fitted else docs
