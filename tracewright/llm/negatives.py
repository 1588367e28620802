"""Hard negatives for anchors among labelled vectors, by the threshold algorithm.

Components are integers, so scores are exact. Rows are read in blocks; a block has for each dimension the list of its
rows by that component. For an anchor the lists are read from the end that its sign asks for, rows that are seen get
their whole score, and reading stops once no unseen row can reach the last place of a window any more.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.llm.shared import written

#: Rows of a block, rows of a task, and anchors that are sent to all tasks at once (8 MB of 64 components).
BLOCK_ROWS, TASK_ROWS, CHUNK_ANCHORS = 8192, 1 << 16, 1 << 14
#: Depth of the first reading; each later one is FASTER times as deep.
FIRST_DEPTH, FASTER = 16, 4
NO_SCORE = np.iinfo(np.int64).min
NO_ID = np.iinfo(np.int64).max


class Lists:
    """Rows of integer vectors with, for each dimension, their order by descending component."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors
        self.order = np.ascontiguousarray(np.argsort(-vectors, axis=0, kind="stable").T)
        self.ordered = np.take_along_axis(np.ascontiguousarray(vectors.T), self.order, axis=1)

    def seen(self, anchor: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int | None]]:
        """(rows, scores, threshold) of each reading: rows are new, no row that is still unseen scores over the threshold; None: all are seen."""
        n, up, down = len(self.ids), np.flatnonzero(anchor > 0), np.flatnonzero(anchor < 0)
        if not len(up) + len(down) or n <= FIRST_DEPTH:
            yield np.arange(n), self.vectors @ anchor, None
            return
        done, depth, step = np.zeros(n, bool), 0, FIRST_DEPTH
        while depth < n:
            last, met = min(n, depth + step), done.copy()
            met[self.order[up, depth:last]] = True
            met[self.order[down, n - last : n - depth]] = True
            rows = np.flatnonzero(met ^ done)
            threshold = anchor[up] @ self.ordered[up, last - 1] + anchor[down] @ self.ordered[down, n - last]
            yield rows, self.vectors[rows] @ anchor, None if last == n else int(threshold)
            done, depth, step = met, last, step * FASTER


class Best:
    """The first k rows of each of an anchor's windows of scores, by descending score, then ascending id."""

    def __init__(self, windows: list[tuple[int | None, int | None]], k: int):
        self.windows, self.k = windows, k
        self.scores = [np.zeros(0, np.int64) for _ in windows]
        self.ids = [np.zeros(0, np.int64) for _ in windows]

    def bound(self, w: int) -> int | None:
        """The least score that an unseen row must have to come into window w; None: any score will do."""
        return int(self.scores[w][-1]) if len(self.scores[w]) == self.k else self.windows[w][0]

    def add(self, ids: np.ndarray, scores: np.ndarray) -> None:
        for w, (_, high) in enumerate(self.windows):
            low = self.bound(w)
            fit = np.ones(len(scores), bool) if low is None else scores >= low
            if high is not None:
                fit &= scores <= high
            if fit.any():
                s, i = np.r_[self.scores[w], scores[fit].astype(np.int64)], np.r_[self.ids[w], ids[fit]]
                order = np.lexsort((i, -s))[: self.k]
                self.scores[w], self.ids[w] = s[order], i[order]

    def closed(self, threshold: int) -> bool:
        """Whether a threshold is strictly below what each window still asks for."""
        return all(low is not None and threshold < low for low in map(self.bound, range(len(self.windows))))

    def search(self, lists: Lists, anchor: np.ndarray, keep: np.ndarray) -> None:
        """Take in what the rows of lists (where keep holds) have for these windows."""
        if not self.windows:
            return
        for rows, scores, threshold in lists.seen(anchor):
            ok = keep[rows]
            self.add(lists.ids[rows[ok]], scores[ok])
            if threshold is not None and self.closed(threshold):
                return


def _exact(vectors: np.ndarray, largest: float) -> np.ndarray:
    """The vectors in a type whose inner products with components up to largest are exact."""
    most = vectors.shape[1] * largest * float(np.abs(vectors).max(initial=0))
    if most >= 2**62:
        raise ValueError("components are too large for scores of 64 bits")
    return vectors.astype(np.float64 if most < 2**52 else np.int64)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, labels, vectors) of up to BLOCK_ROWS rows of equally many components."""
    waiting: dict[int, list] = {}
    for batch in batches:
        ids, labels = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        vectors = batch.column(2)
        size, values = vectors.value_lengths().to_numpy(), vectors.flatten().to_numpy()
        begin = np.cumsum(size) - size
        for d in np.unique(size):
            at = np.flatnonzero(size == d)
            waiting.setdefault(int(d), []).append((ids[at], labels[at], values[begin[at][:, None] + np.arange(d)]))
            if sum(len(x[0]) for x in waiting[d]) >= BLOCK_ROWS:
                yield tuple(np.concatenate(x) for x in zip(*waiting.pop(d), strict=True))
    for parts in waiting.values():
        yield tuple(np.concatenate(x) for x in zip(*parts, strict=True))


_FOUND = "anchor_id long, place int, id long, score long"


def _searched(rows: DataFrame, anchors, k: int, same_label: bool) -> DataFrame:
    """(anchor_id, place, id, score): for each anchor and window (place) the first k rows that each task has.

    anchors: a broadcast list of (id, label, vector, windows). What a task holds is one block and k rows a window, and
    the windows' bounds go from one block to the next.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(windows, k) for _, _, _, windows in anchors.value]
        by_size: dict[int, list[int]] = {}
        for i, (_, _, v, _) in enumerate(anchors.value):
            by_size.setdefault(len(v), []).append(i)
        for ids, labels, vectors in _blocks(batches):
            mine = by_size.get(vectors.shape[1], [])
            if not mine:
                continue
            vectors = _exact(vectors, max(float(np.abs(anchors.value[i][2]).max(initial=0)) for i in mine))
            lists: dict = {}
            for i in mine:
                own, label, v, _ = anchors.value[i]
                key = label if same_label else None
                if key not in lists:
                    part = labels == label if same_label else np.ones(len(ids), bool)
                    lists[key] = Lists(ids[part], vectors[part]), labels[part]
                at, of = lists[key]
                best[i].search(at, v.astype(vectors.dtype), at.ids != own if same_label else of != label)
        for i in range(0, len(best), 256):
            found = [(anchors.value[i + j][0], w, b.ids[w], b.scores[w]) for j, b in enumerate(best[i : i + 256]) for w in range(len(b.windows))]
            count = np.array([len(x[2]) for x in found], np.int64)
            if count.sum():
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array([x[0] for x in found], np.int64), count)), pa.array(np.repeat(np.array([x[1] for x in found], np.int32), count)), pa.array(np.concatenate([x[2] for x in found])), pa.array(np.concatenate([x[3] for x in found]))], ["anchor_id", "place", "id", "score"])

    found = rows.mapInArrow(run, _FOUND)
    order = Window.partitionBy("anchor_id", "place").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def usable_rows(vectors: DataFrame, id_col: str, label_col: str, vector_col: str, scale: int) -> DataFrame:
    """(id, label, vector of floor(scale * x)) of the rows that take part, one for each id."""
    v, label = F.col(vector_col), F.col(label_col)
    whole = F.transform(v, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long"))
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    some = vectors.filter(F.col(id_col).isNotNull() & label.isNotNull() & v.isNotNull() & F.coalesce(finite, F.lit(False)))
    one = some.select(F.col(id_col).cast("long").alias("id"), F.struct(label.cast("long").alias("label"), whole.alias("vector")).alias("row"))
    return one.groupBy("id").agg(F.min("row").alias("row")).select("id", "row.label", "row.vector")


def hard_negatives(
    vectors: DataFrame, is_anchor: Column, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding",
    scale: int = 256, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, chunk: int = CHUNK_ANCHORS,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    is_anchor is a condition on the column id. An anchor's positives are the first rows of its label, and each positive's negatives the
    first rows of other labels whose score s has low * p <= 100 * s <= high * p, p being the positive's score. First
    means the higher inner product of components floor(scale * x), of equal ones the smaller id.

    Rows with a null id, label, vector or component, or a component that is not finite, take no part. Of repeated ids
    the row of the least (label, vector) does. Vectors are only compared with those of as many components. Anchors
    without positives, and positives with a score below zero, give no rows. Empty tables give none.

    Anchors go to all tasks in chunks of a fixed size, each of which meets all rows in one pass without a shuffle.
    """
    spark = vectors.sparkSession
    rows = usable_rows(vectors, id_col, label_col, vector_col, scale)
    rows = rows.repartition(max(spark.sparkContext.defaultParallelism, -(-vectors.count() // TASK_ROWS)), "id")
    rows = written(rows, "vectors")
    anchors = rows.filter(is_anchor)
    parts = max(1, -(-anchors.count() // chunk))
    out = None
    for part in range(parts):
        own = anchors.filter(F.pmod(F.xxhash64("id"), F.lit(parts)) == part).toArrow().to_pydict()
        own = {i: (i, label, np.array(v, np.int64)) for i, label, v in zip(own["id"], own["label"], own["vector"], strict=True)}
        asked = spark.sparkContext.broadcast([(*a, [(None, None)]) for a in own.values()])
        first = _searched(rows, asked, positives, True).toArrow().to_pydict()
        pairs: dict = {i: [] for i in own}
        for a, p, s in zip(first["anchor_id"], first["id"], first["score"], strict=True):
            pairs[a].append((p, s))
        places = [(a, w, p, s) for a, ps in pairs.items() for w, (p, s) in enumerate(ps)]
        window = lambda s: (-(-low * s // 100), high * s // 100)
        asked = spark.sparkContext.broadcast([(*own[a], [window(s) for _, s in ps]) for a, ps in pairs.items() if any(s >= 0 for _, s in ps)])
        table = spark.createDataFrame(pa.table([pa.array(c, t) for c, t in zip(list(zip(*places, strict=True)) or [[]] * 4, (pa.int64(), pa.int32(), pa.int64(), pa.int64()), strict=True)], ["anchor_id", "place", "positive_id", "positive_score"]))
        found = _searched(rows, asked, negatives, False).join(table, ["anchor_id", "place"])
        out = found if out is None else out.unionByName(found)
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
