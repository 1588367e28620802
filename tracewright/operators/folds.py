"""Rules in which each row needs what the row before left: one sort by key and order, then one pass with a small state.

sorted_fold reads a key in one task. scanned_fold is for rules whose effect on the state can be summed up for a stretch
of rows: keys of many rows are cut into parts, which are summed up side by side, the sums are put together in order,
and then all parts are read side by side, each from the state that it begins with.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import chain
from operator import and_
from typing import Any, Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StructField, StructType

#: A key is cut where it has more than this share of all rows, so there are at most twice as many parts of such keys.
PARTS = 1024
#: But a part is not worth less than so many rows.
LEAST_ROWS = 1024
#: Bounds of parts are searched by groups of so many.
_GROUP = 32

Columns = dict[str, np.ndarray]


class Digest(Protocol):
    """Sums up what a stretch of rows does to any state that may come before it."""

    def add(self, columns: Columns) -> None: ...

    def result(self) -> Any: ...


def _changes(batch: pa.RecordBatch, key: list[int]) -> np.ndarray:
    """The rows, after the first, whose key differs from that of the row before."""
    differs = np.zeros(max(batch.num_rows - 1, 0), bool)
    for k in key:
        now, before = batch.column(k).slice(1), batch.column(k).slice(0, batch.num_rows - 1)
        differs |= pc.fill_null(pc.not_equal(now, before), False).to_numpy(zero_copy_only=False)
        differs |= pc.not_equal(pc.is_null(now), pc.is_null(before)).to_numpy(zero_copy_only=False)
    return np.flatnonzero(differs) + 1


def _runs(batch: pa.RecordBatch, names: list[str], key: list[str], read: list[str]) -> Iterator[tuple[tuple, Columns]]:
    """The key and the columns of each run of rows of one key."""
    arrays = {c: batch.column(names.index(c)).to_numpy(zero_copy_only=False) for c in read}
    places = [names.index(k) for k in key]
    cuts = [0, *_changes(batch, places).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        yield tuple(batch.column(p)[a].as_py() for p in places), {c: x[a:b] for c, x in arrays.items()}


def _added(parts: list[list], kinds: list[pa.DataType]) -> list[pa.Array]:
    return [pa.array(np.concatenate(x) if isinstance(x[0], np.ndarray) else list(chain(*x)), t) for x, t in zip(zip(*parts), kinds)]


def sorted_fold(rows: DataFrame, key: list[str], order: list[str], added: str, start: Callable[[], Any], step: Callable[[Any, Columns], list], read: list[str]) -> DataFrame:
    """rows with the columns of added (a schema), which step(state, columns) gives for a run of rows of one key.

    Rows are dealt by key and sorted, which spills; start() makes a key's state, and a key's rows come in batches, so
    neither memory nor time for a row grows with the key. columns are those in read, as arrays.
    """
    more = StructType.fromDDL(added)
    names, kinds = rows.columns, [to_arrow_type(f.dataType) for f in more.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, state = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            parts = []
            for k, columns in _runs(batch, names, key, read):
                if k != here:
                    here, state = k, start()
                parts.append(step(state, columns))
            yield pa.RecordBatch.from_arrays([*batch.columns, *_added(parts, kinds)], [*names, *more.names])

    return rows.repartition(*key).sortWithinPartitions(*key, *order).mapInArrow(run, StructType([*rows.schema.fields, *more.fields]))


def parted(rows: DataFrame, key: list[str], time: str) -> DataFrame | None:
    """rows with _part, the number of the row's part of its key, and _cut, whether the key has parts; None if no key is cut.

    Keys with more than 1 / PARTS of all rows (and more than LEAST_ROWS) are cut at quantiles of time, a number, date or
    timestamp, into parts of about that many rows. Rows of one time stay together. All bounds, 2 * PARTS at most, are
    read once, so a task that is run again cuts alike.
    """
    counts = rows.groupBy(*key).agg(F.count("*").alias("_n"))
    total, most = counts.agg(F.sum("_n"), F.max("_n")).first()
    size = max((total or 0) / PARTS, LEAST_ROWS)
    if not total or most <= size:
        return None
    named = [F.col(k).alias(f"_k{i}") for i, k in enumerate(key)]
    same = lambda right: reduce(and_, [rows[k].eqNullSafe(right[f"_k{i}"]) for i, k in enumerate(key)])
    large = counts.filter(F.col("_n") > size).select(*named, "_n")  # fewer than PARTS keys
    at = F.percentile_approx(time, [i / PARTS for i in range(1, PARTS)], 4 * PARTS)
    found = rows.join(F.broadcast(large), same(large)).groupBy(*[f"_k{i}" for i in range(len(key))], "_n").agg(at.alias("_q"))
    pieces = F.ceil(F.col("_n") / size)
    chosen = F.transform(F.sequence(F.lit(1), pieces - 1), lambda i: F.get("_q", (F.floor(i * PARTS / pieces) - 1).cast("int")))
    bounds = found.select(*[f"_k{i}" for i in range(len(key))], F.array_distinct(chosen).alias("_b")).collect()
    groups = [(*r[:-1], [r[-1][i : i + _GROUP] for i in range(0, len(r[-1]), _GROUP)]) for r in bounds if r[-1]]
    kind = rows.schema[time].dataType
    fields = [StructField(f"_k{i}", rows.schema[k].dataType) for i, k in enumerate(key)]
    cuts = rows.sparkSession.createDataFrame(groups, StructType([*fields, StructField("_b", ArrayType(ArrayType(kind)))]))
    upto = lambda x: F.size(F.filter(x, lambda b: b <= F.col(time)))
    g = upto(F.transform("_b", lambda x: x[0]))
    part = F.when(g > 0, (g - 1) * _GROUP + upto(F.get("_b", g - 1))).otherwise(0)
    out = rows.join(F.broadcast(cuts), same(cuts), "left")
    return out.select(*rows.columns, F.coalesce(part, F.lit(0)).cast("int").alias("_part"), F.col("_b").isNotNull().alias("_cut"))


def scanned_fold(rows: DataFrame, key: list[str], order: list[str], added: str, start: Callable[[], Any], step: Callable[[Any, Columns], list], read: list[str], digest: Callable[[], Digest], after: Callable[[Any, Any], None]) -> DataFrame:
    """Like sorted_fold and with the same result, but no task reads a whole key of many rows (see parted).

    digest() sums up a part, and after(state, result) changes a state as the part's rows would. A state is pickled. Equal
    times, order[0], must not matter to the state by their order, or be told apart by the rest of order. rows are read
    four times where a key is cut, twice with the columns for order and step alone.
    """
    marked = parted(rows, key, order[0])
    if marked is None:
        return sorted_fold(rows, key, order, added, start, step, read)
    piece = [*key, "_part"]
    more = StructType.fromDDL(added)
    kinds = [to_arrow_type(f.dataType) for f in more.fields]
    needed = list(dict.fromkeys([*piece, *order, *read]))

    def sum_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, now = None, None
        rest = lambda: pa.RecordBatch.from_pylist([{**dict(zip(piece, here)), "_digest": pickle.dumps(now.result())}], digests)
        for batch in batches:
            for k, columns in _runs(batch, needed, piece, read) if batch.num_rows else ():
                if k != here:
                    if now is not None:
                        yield rest()
                    here, now = k, digest()
                now.add(columns)
        if now is not None:
            yield rest()

    digested = StructType([*[rows.schema[k] for k in key], StructField("_part", IntegerType()), StructField("_digest", BinaryType())])
    digests = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in digested.fields])
    sums = marked.filter("_cut").select(*needed).repartition(*piece).sortWithinPartitions(*piece, *order).mapInArrow(sum_up, digested)

    def enter(state: Any, columns: Columns) -> list:
        out = []
        for d in columns["_digest"]:
            out.append(pickle.dumps(state))
            after(state, pickle.loads(d))
        return [out]

    states = sorted_fold(sums, key, ["_part"], "_state binary", start, enter, ["_digest"])
    heads = states.select(*[F.col(c) if c in key else F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in rows.columns], "_part", "_state")
    both = marked.select(*rows.columns, "_part", F.lit(None).cast("binary").alias("_state")).unionByName(heads)
    names = both.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, state, entered = None, None, {}
        for batch in batches:
            # the state that a part begins with comes before its rows
            is_row = pc.is_null(batch.column(names.index("_state")))
            for head in batch.filter(pc.invert(is_row)).select([*piece, "_state"]).to_pylist():
                entered[tuple(head[c] for c in piece)] = head["_state"]
            batch = batch.filter(is_row)
            if not batch.num_rows:
                continue
            parts = []
            for k, columns in _runs(batch, names, piece, read):
                if k != here:
                    here, state = k, pickle.loads(entered.pop(k)) if k in entered else start()
                parts.append(step(state, columns))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(rows_names)], *_added(parts, kinds)], [*rows_names, *more.names])

    rows_names = rows.columns
    dealt = both.repartition(*piece).sortWithinPartitions(*piece, F.col("_state").isNull(), *order)
    return dealt.mapInArrow(run, StructType([*rows.schema.fields, *more.fields]))
