"""Shared steps of the linear text classifiers: a bounded labelled sample, hashed indicators, selection, scoring.

A feature function takes Words and gives (text index, feature) arrays, features below 2**FEATURE_BITS, in any order and
with repeats; what counts is whether a feature occurs in the whole text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm.shared import Words, is_training_row, text_slices, written

FEATURE_BITS = 20
SPACE = 1 << FEATURE_BITS
#: Labelled rows that a model is fitted on, at most; a documented bound, chosen by a hash of the id.
SAMPLE_ROWS = 12_000
#: Labelled ids that are looked for, for each row of the sample, and the most that are sent to all tasks for that.
ASKED, MOST_ASKED = 8, 1_000_000
#: Features that a model may use, at most, and the fewest sampled texts that each must occur in.
MODEL_FEATURES, LEAST_TEXTS = 1 << 15, 3

Features = Callable[[Words], tuple[np.ndarray, np.ndarray]]


def bucket(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - FEATURE_BITS)).astype(np.int64)


def distinct(doc: np.ndarray, feature: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    key = np.unique(doc.astype(np.int64) * SPACE + feature)
    return key // SPACE, key % SPACE


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, text, label) of at most rows training rows of docs that have a label, one of each id and text.

    Ids are compared as text, so they may be of any type. Rows whose id or label is null are no examples, of repeated
    labels the largest counts. Labelled ids are looked for among docs in the order of a hash, first some times as many as
    rows asks for, and more only while too few are there; so neither labels nor docs are shuffled whole.
    """
    own = lambda df: F.col("doc_id").cast("string").alias("doc_id")
    ids = (
        labels.select(own(labels), F.col(label).cast("int").alias("label"))
        .filter(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & is_training_row(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max("label").alias("label"))
    )
    total, asked = ids.count(), ASKED * rows
    while True:
        some = ids if asked >= total else ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(asked)
        some = F.broadcast(some) if asked <= MOST_ASKED else some
        # of the rows of an id, each text once; which ones are there is found out without their texts
        there = docs.select(own(docs), "text").join(some, "doc_id").select("doc_id", "label", F.xxhash64("text").alias("of")).groupBy("doc_id", "label", "of").agg(F.count("*").alias("copies"))
        there = written(there.orderBy(F.xxhash64("doc_id"), "doc_id", "of").limit(rows), "examples")
        found, most = there.agg(F.count("*"), F.max("copies")).first()
        if found >= rows or asked >= total:
            break
        asked *= ASKED
    sample = docs.select(own(docs), "text").withColumn("of", F.xxhash64("text")).join(F.broadcast(there.drop("copies")), ["doc_id", "of"])
    return (sample if (most or 1) == 1 else sample.groupBy("doc_id", "of").agg(F.min("text").alias("text"), F.min("label").alias("label"))).select("doc_id", "text", "label")


def feature_table(sample: DataFrame, features: Features, swap: Callable[[str], str | None] | None = None) -> DataFrame:
    """(label, on array<int>, off array<int>) for each sampled text: its features, and those of its swapped text, if any."""

    def lists(column: pa.Array) -> list[np.ndarray]:
        out = []
        for _, _, data, offsets in text_slices(column):
            words = Words(data, offsets)
            doc, feature = distinct(*features(words))
            out += np.split(feature.astype(np.int32), np.searchsorted(doc, np.arange(1, words.n_docs)))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            on = lists(batch.column(0))
            swapped = [swap(v.as_py() or "") if swap else None for v in batch.column(0)]
            off = iter(lists(pa.array([s for s in swapped if s is not None], pa.string())))
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(on, pa.list_(pa.int32())), pa.array([None if s is None else next(off) for s in swapped], pa.list_(pa.int32()))], ["label", "on", "off"])

    return written(sample.select("text", "label").mapInArrow(run, "label int, on array<int>, off array<int>"), "features")


def class_counts(table: DataFrame, limit: int = MODEL_FEATURES) -> tuple[np.ndarray, np.ndarray, np.ndarray, int, int]:
    """The features that differ most between the classes, at most limit, with their text counts in class 1 and 0, and the class sizes."""
    sizes = {r["label"]: r["n"] for r in table.groupBy("label").agg(F.count("*").alias("n")).collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    counts = table.select("label", F.explode("on").alias("feature")).groupBy("feature").agg(F.sum("label").alias("c1"), F.count("*").alias("c"))
    rate1, rate0 = F.col("c1") / max(n1, 1), (F.col("c") - F.col("c1")) / max(n0, 1)
    mean = F.col("c") / max(n1 + n0, 1)
    z = F.abs(rate1 - rate0) / F.sqrt(mean * (1 - mean) + F.lit(1e-9))
    # by toArrow() the first limit rows meet in a task; by collect() each partition would send as many to the driver
    rows = counts.filter(F.col("c") >= LEAST_TEXTS).orderBy(z.desc(), "feature").limit(limit).toArrow()
    feature, c1, c = (rows[x].to_numpy().astype(np.int64) for x in ("feature", "c1", "c"))
    return feature, c1.astype(float), (c - c1).astype(float), n1, n0


def design(table: DataFrame, feature: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray | None]]:
    """Labels and feature positions of the bounded sample, features not in feature left out."""
    place = np.full(SPACE, -1, np.int32)
    place[feature] = np.arange(len(feature))
    shared = table.sparkSession.sparkContext.broadcast(place)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value

        def kept(column):
            out = []
            for v in column:
                x = None if not v.is_valid else p[v.values.to_numpy()]
                out.append(None if x is None else x[x >= 0])
            return pa.array(out, pa.list_(pa.int32()))

        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), kept(batch.column(1)), kept(batch.column(2))], ["label", "on", "off"])

    rows = table.mapInArrow(run, table.schema).toArrow()  # SAMPLE_ROWS rows at most
    arrays = [[None if not v.is_valid else v.values.to_numpy() for v in rows.column(c)] for c in ("on", "off")]
    label, order = rows["label"].to_pylist(), []
    size = lambda i: (label[i], len(arrays[0][i]))
    for _, tied in groupby(sorted(range(rows.num_rows), key=size), size):  # only rows of one size need their bytes, side by side
        order += sorted(tied, key=lambda i: arrays[0][i].tobytes())
    return np.array([label[i] for i in order]), [arrays[0][i] for i in order], [arrays[1][i] for i in order]


@dataclass
class LinearModel:
    """Scores 1 / (1 + exp(-(slope * margin + bias))); with norms, the margin is divided by the root of their sum."""

    features: Features
    feature: np.ndarray
    weight: np.ndarray
    bias: float
    slope: float = 1.0
    norms: np.ndarray | None = None
    #: False where the labels gave nothing to tell the classes by.
    fitted: bool = True

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        out = []
        for values in (self.weight, self.norms):
            full = np.zeros(SPACE, np.float32)
            full[self.feature] = 0 if values is None else values
            out.append(full)
        return out[0], out[1]

    def scores(self, column: pa.Array, tables: tuple[np.ndarray, np.ndarray]) -> Iterator[tuple[int, int, np.ndarray]]:
        """(first row, last row + 1, scores) of the whole texts of a column, slice by slice."""
        w, q = tables
        used = (w != 0) | (q != 0)
        for first, last, data, offsets in text_slices(column):
            words = Words(data, offsets)
            doc, f = self.features(words)
            keep = used[f]
            doc, f = distinct(doc[keep], f[keep])
            margin = np.bincount(doc, w[f], words.n_docs)
            if self.norms is not None:
                margin = margin / np.sqrt(np.maximum(np.bincount(doc, q[f], words.n_docs), 1e-12))
            yield first, last, 1 / (1 + np.exp(-np.clip(self.slope * margin + self.bias, -30, 30)))


def _shared(docs: DataFrame, model: LinearModel):
    return docs.sparkSession.sparkContext.broadcast(model.tables()), LinearModel(model.features, np.zeros(0, int), np.zeros(0), model.bias, model.slope, None if model.norms is None else np.zeros(0))


def scored(docs: DataFrame, model: LinearModel, threshold: float) -> DataFrame:
    """doc_id, held_out, score and predicted for every whole text; one narrow pass, no shuffle."""
    shared, light = _shared(docs, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, score in light.scores(batch.column(2), shared.value):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), batch.column(1).slice(first, last - first), pa.array(score), pa.array((score >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    held_out = F.coalesce(~is_training_row(F.col("doc_id")), F.lit(False)).alias("held_out")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", held_out, "text").mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")


def chosen(docs: DataFrame, model: LinearModel, threshold: float, predicted: int) -> DataFrame:
    """The rows of docs, with all their columns, that get this prediction; one narrow pass, no join."""
    shared, light = _shared(docs, model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, score in light.scores(batch.column(at), shared.value):
                yield batch.slice(first, last - first).filter(pa.array((score >= threshold) == bool(predicted)))

    return docs.mapInArrow(run, docs.schema)
