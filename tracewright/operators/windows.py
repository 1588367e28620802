"""Windows over keyed, ordered events. Each function shuffles once by the key and sorts by (time, tie)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewright.operators.folds import scanned_fold


def ordered(key: list[str] | str, *order: str):
    keys = [key] if isinstance(key, str) else key
    return Window.partitionBy(*keys).orderBy(*order)


class _Anchor:
    """The first event of the current grid of windows, and the last event."""

    def __init__(self):
        self.base, self.last = None, None

    def opens_anew(self, before: float, time: float, width: float) -> bool:
        """Whether a whole window of the grid is empty between two events."""
        return time - before > width and np.floor((time - self.base) / width) - np.floor((before - self.base) / width) >= 2


class _Grids:
    """What a part's events do to the grid before them, which its phase tells: where it lies in (0, width].

    A gap between two events of a width to two closes just the grids whose phase is in an arc of the circle, and a longer
    one closes all; they go on as the grid of the event after the gap. So phases are cut into arcs (low, high, base),
    and base is the event whose grid an arc has become, or None where the grid before goes on.
    """

    def __init__(self, time: str, width: float):
        self.time, self.width = time, width
        self.first, self.last, self.arcs = None, None, [(0.0, width, None)]

    @staticmethod
    def phase(at: float, width: float) -> float:
        return at % width or width

    def _close(self, before: float, at: float) -> None:
        low = self.phase(before, self.width)
        high = low + (at - before - self.width)
        turned = high - self.width
        inside = lambda p: low < p <= high or p <= turned
        out: list[tuple] = []
        for a, b, base in self.arcs:
            ends = [b] if base is not None else [*sorted(x for x in {low, high, turned} if a < x < b), b]
            for end in ends:
                now = at if inside(end if base is None else self.phase(base, self.width)) else base
                if out and out[-1][2] == now:
                    out[-1] = (out[-1][0], end, now)
                else:
                    out.append((a, end, now))
                a = end
        self.arcs = out

    def add(self, columns: dict[str, np.ndarray]) -> None:
        t = columns[self.time].astype(float)
        if self.first is None:
            self.first = self.last = float(t[0])
        before = np.r_[self.last, t[:-1]]
        gaps = np.flatnonzero(t - before > self.width)
        sure = gaps[t[gaps] - before[gaps] >= 2 * self.width]
        if len(sure):
            self.arcs, gaps = [(0.0, self.width, float(t[sure[-1]]))], gaps[gaps > sure[-1]]
        for i in gaps.tolist():
            self._close(float(before[i]), float(t[i]))
        self.last = float(t[-1])

    def result(self) -> tuple:
        return self.first, self.last, self.arcs


def anchored_windows(events: DataFrame, key: str, time: str, tie: str, width: float) -> DataFrame:
    """Adds anchor, the start of the event's window, in the unit of time.

    The first event of a key opens a window. An event at or past its end closes it and opens the next at that end, or,
    if the event is a further width late, at the event. Late data do not occur: events are put in order first. So from
    an anchor on windows are a grid, until an event leaves a whole window of it empty; only events after a gap of more
    than a width can do that, and only these are looked at one by one. The state of a key is two times. Keys of many
    events are read in parts (folds.scanned_fold), exactly where times and width are whole numbers below 2^53; of others
    a time within a rounding error of a window's end may fall to either side.
    """

    def step(s: _Anchor, columns: dict[str, np.ndarray]) -> list:
        t = columns[time].astype(float)
        if s.base is None:
            s.base = s.last = t[0]
        before = np.r_[s.last, t[:-1]]
        base, at = np.empty(len(t)), 0
        for i in np.flatnonzero(t - before > width).tolist():
            if s.opens_anew(before[i], t[i], width):
                base[at:i], at, s.base = s.base, i, t[i]
        base[at:], s.last = s.base, t[-1]
        return [base + np.floor((t - base) / width) * width]

    def after(s: _Anchor, part: tuple) -> None:
        first, last, arcs = part
        if s.base is None or s.opens_anew(s.last, first, width):
            s.base = first
        p = _Grids.phase(s.base, width)
        became = next(base for low, high, base in arcs if low < p <= high)
        s.base, s.last = s.base if became is None else became, last

    return scanned_fold(events, [key], [time, tie], "anchor double", _Anchor, step, [time], lambda: _Grids(time, width), after)


def aligned_windows(events: DataFrame, micros: str, width_seconds: int) -> DataFrame:
    """Adds win, the number of the epoch-aligned window."""
    return events.withColumn("win", F.floor(F.col(micros) / (width_seconds * 1_000_000)).cast("long"))


def counter_deltas(snapshots: DataFrame, source: list[str], counter: list[str], time: str, value: str) -> DataFrame:
    """Adds delta of each cumulative counter; a fall is a reset and counts the new value; first snapshots and repeated times give nothing."""
    w = ordered([*source, *counter], time)
    before, then = F.lag(value).over(w), F.lag(time).over(w)
    out = snapshots.withColumn("delta", F.when(F.col(value) >= before, F.col(value) - before).otherwise(F.col(value))).withColumn("_then", then)
    return out.filter(F.col("_then").isNotNull() & (F.col(time) > F.col("_then"))).drop("_then")


def rolling_rate(rows: DataFrame, key: list[str], order: list[str], value: str, history: int) -> DataFrame:
    """Mean and population deviation of at most history rows before; without any, the row's own value and 0."""
    w = ordered(key, *order).rowsBetween(-history, -1)
    return rows.withColumn("mean", F.coalesce(F.avg(value).over(w), F.col(value).cast("double"))).withColumn("std", F.coalesce(F.stddev_pop(value).over(w), F.lit(0.0)))


def sliding_count(events: DataFrame, key: str, time: str, tie: str, width: float, capacity: int, value: str | None = None) -> DataFrame:
    """Adds events_total, the number of a key's events in the last width, the newest capacity of them at most.

    With value, also held_total: its sum over just these events. The newest capacity rows of a key are a frame of rows,
    those of the last width one of time, and the sum is over the shorter of both.
    """
    w = ordered(key, time).rangeBetween(-width, 0)
    out = events.withColumn("events_total", F.least(F.count("*").over(w), F.lit(capacity).cast("long")))
    if value is None:
        return out
    newest = F.collect_list(value).over(ordered(key, time, tie).rowsBetween(-(capacity - 1), 0))
    # rows of the same time that come later in the order are in the frame of time but not yet in that of rows
    inside = F.count("*").over(ordered(key, time, tie).rowsBetween(Window.unboundedPreceding, 0)) - F.count("*").over(ordered(key, time).rangeBetween(Window.unboundedPreceding, -width - 1))
    out = out.withColumn("_newest", newest).withColumn("_n", F.least(inside, F.lit(capacity).cast("long")).cast("int"))
    held = F.aggregate(F.slice("_newest", F.greatest(F.size("_newest") - F.col("_n") + 1, F.lit(1)), F.col("_n")), F.lit(0.0), lambda a, v: a + v)
    return out.withColumn("held_total", held).drop("_newest", "_n")


def segments(rows: DataFrame, key: list[str], start: str, end: str, width: float, regime: str | None = None) -> DataFrame:
    """Adds segment: a new one when the gap to the row before is over 2.5 widths or the regime changes; null regimes never split."""
    w = ordered(key, end)
    cut = (F.col(start) - F.lag(end).over(w)) > 2.5 * width
    if regime:
        cut = cut | (F.col(regime) != F.lag(regime).over(w))
    return rows.withColumn("segment", F.sum(F.when(cut, 1).otherwise(0)).over(w))


def history(rows: DataFrame, key: list[str], end: str, need: int, vector: str, start: str | None = None, width: float | None = None, regime: str | None = None) -> DataFrame:
    """Adds status (warming until need rows of the segment came before) and past, the need vectors before, end to end.

    With start, width and regime, as for segments(), also reset: why the row's segment began anew, temporal_gap before
    traffic_regime_change; null for rows that go on.
    """
    w = ordered([*key, "segment"], end)
    if start:
        all_rows = ordered(key, end)
        gap = (F.col(start) - F.lag(end).over(all_rows)) > 2.5 * width
        changed = F.col(regime) != F.lag(regime).over(all_rows) if regime else F.lit(False)
        rows = rows.withColumn("reset", F.when(gap, "temporal_gap").when(changed, "traffic_regime_change"))
    before = F.flatten(F.collect_list(vector).over(w.rowsBetween(-need, -1)))
    return rows.withColumn("status", F.when(F.row_number().over(w) <= need, "warming").otherwise("ready")).withColumn("past", F.when(F.col("status") == "ready", before))


def not_increasing(rows: DataFrame, key: list[str], arrival: list[str], time: str) -> DataFrame:
    """Rows whose time is not after that of the row that arrived before."""
    return rows.withColumn("_before", F.lag(time).over(ordered(key, *arrival))).filter(F.col(time) <= F.col("_before")).drop("_before")


def trailing(rows: DataFrame, end: str, duration: float) -> DataFrame:
    """The rows that end in the last duration. The one-row maximum is joined, not collected."""
    return rows.join(rows.agg(F.max(end).alias("_last")), F.col(end) >= F.col("_last") - duration).drop("_last")


def transitions(events: DataFrame, key: list[str], order: list[str], name: str, time: str, max_gap: float) -> DataFrame:
    """Rows with their predecessor in the same key, where it is at most max_gap ago."""
    w = ordered(key, *order)
    out = events.withColumn("before", F.lag(name).over(w)).withColumn("_gap", F.col(time) - F.lag(time).over(w))
    return out.filter(F.col("before").isNotNull() & (F.col("_gap") <= max_gap)).drop("_gap")


def wall_clock(events: DataFrame, reader: str, mono: str, wall: str) -> DataFrame:
    """Adds at: the reader's first wall time plus the monotonic time since."""
    first = events.groupBy(reader).agg(F.min(F.struct(mono, wall)).alias("_first"))
    return events.join(first, reader).withColumn("at", F.col(f"_first.{wall}") + F.col(mono) - F.col(f"_first.{mono}")).drop("_first")
