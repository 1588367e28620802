"""Joins by interval, by time and by order. Every range join has an equi key or a time bucket, so none is nested-loop."""

from __future__ import annotations

from collections import deque
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewright.operators.folds import scanned_fold


def pair_intervals(rows: DataFrame, key: str, kind: str, time: str, same: list[str] | None = None) -> DataFrame:
    """(key, started, ended, problem) from start and end rows of each id, whose columns in same must be equal."""
    same = same or []
    count = lambda k: F.count_if(F.col(kind) == k)
    at = lambda k: F.min(F.when(F.col(kind) == k, F.col(time)))
    g = rows.groupBy(key).agg(at("start").alias("started"), at("end").alias("ended"), count("start").alias("_s"), count("end").alias("_e"), *[(F.countDistinct(c) > 1).alias(f"_d_{c}") for c in same])
    problem = F.when((F.col("_s") > 1) | (F.col("_e") > 1), "repeated").when(F.col("_e") == 0, "no end").when(F.col("_s") == 0, "no start").when(F.col("ended") <= F.col("started"), "empty")
    for c in same:
        problem = problem.when(F.col(f"_d_{c}"), f"differs: {c}")
    return g.select(key, "started", "ended", problem.alias("problem"))


def paired(first: DataFrame, second: DataFrame, key: list[str], outcome: str, same: list[str]) -> DataFrame:
    """(key, outcome_1, outcome_2, problem) of two methods' results: trials that only one has, or that they describe differently."""
    a = first.select(*key, F.col(outcome).alias(f"{outcome}_1"), F.struct(*same).alias("_a"))
    b = second.select(*key, F.col(outcome).alias(f"{outcome}_2"), F.struct(*same).alias("_b"))
    problem = F.when(F.col("_b").isNull(), "only first").when(F.col("_a").isNull(), "only second").when(~F.col("_a").eqNullSafe(F.col("_b")), "differs")
    return a.join(b, key, "full_outer").select(*key, f"{outcome}_1", f"{outcome}_2", problem.alias("problem"))


def cells(start, end, width) -> F.Column:
    """The dyadic cells (level, number) that tile the buckets of a closed interval: cell n of level l is the buckets
    n * 2**l to (n + 1) * 2**l - 1 of a width. Each level has two at most, so an interval of m buckets has 2 log2(m) or so."""
    first, last = F.floor(start / width), F.floor(end / width) + 1
    levels = F.sequence(F.lit(0), F.floor(F.log2(F.greatest(last - first, F.lit(1)))).cast("int") + 1)

    def at(level):
        size = F.pow(F.lit(2.0), level)
        low, high = F.ceil(first / size).cast("long"), F.floor(last / size).cast("long")
        left = F.when((low < high) & (F.pmod(low, F.lit(2)) == 1), low)
        right = F.when((low < high) & (F.pmod(high, F.lit(2)) == 1) & ((high - 1 > low) | left.isNull()), high - 1)
        return F.transform(F.filter(F.array(left, right), lambda n: n.isNotNull()), lambda n: F.struct(level.alias("level"), n.alias("cell")))

    return F.filter(F.flatten(F.transform(levels, at)), lambda c: c.isNotNull())


def points_in(points: DataFrame, at: str, intervals: DataFrame, low: str, high: str, keys: list[str], width: float) -> DataFrame:
    """Rows of points and intervals of equal keys with low <= at <= high; each pair once, as an interval's cells don't overlap.

    An interval is dealt to the cells that tile it and a point to its cell of each level that intervals have, which is
    one level where they are about as long as a width.
    """
    spread = intervals.filter(F.col(low) <= F.col(high)).withColumn("_c", F.explode(cells(F.col(low), F.col(high), width)))
    levels = [r[0] for r in spread.select("_c.level").distinct().collect()]  # 60 at most
    if not levels:
        levels = [0]
    place = F.array(*[F.struct(F.lit(n).alias("level"), F.floor(F.floor(F.col(at) / width) / 2.0**n).cast("long").alias("cell")) for n in levels])
    dealt = points.withColumn("_c", F.explode(place))
    return dealt.join(spread, [*keys, "_c"]).filter((F.col(low) <= F.col(at)) & (F.col(at) <= F.col(high))).drop("_c")


def overlaps(left: DataFrame, right: DataFrame, keys: list[str], width: float) -> DataFrame:
    """Rows of left (keys, began, ended) and right (keys, started, stopped) that overlap strictly.

    Of two such intervals the later start is a point of the other one: the pairs are those where right starts inside of
    left, and those where left starts inside of right but not with it.
    """
    columns = [*keys, *[c for c in left.columns if c not in keys], *[c for c in right.columns if c not in keys]]
    strictly = (F.col("began") < F.col("stopped")) & (F.col("started") < F.col("ended"))
    one = points_in(right, "started", left, "began", "ended", keys, width).filter(strictly)
    two = points_in(left, "began", right, "started", "stopped", keys, width).filter(strictly & (F.col("began") > F.col("started")))
    return one.select(*columns).unionByName(two.select(*columns))


def contained(left: DataFrame, right: DataFrame, keys: list[str], width: float) -> DataFrame:
    """Left rows (began, ended) with the right interval (started, stopped) that holds them; without one, null."""
    more = [c for c in right.columns if c not in keys]
    found = points_in(left, "began", right, "started", "stopped", keys, width).filter(F.col("ended") <= F.col("stopped")).select(*left.columns, *more)
    held = found.select(*[F.col(c).alias(f"_{c}") for c in left.columns]).distinct()
    same = [left[c].eqNullSafe(held[f"_{c}"]) for c in left.columns]
    # equal rows have equal intervals, so rows without one are told by their values
    alone = left.join(held, reduce(and_, same), "left_anti")
    return found.unionByName(alone.select(*left.columns, *[F.lit(None).cast(right.schema[c].dataType).alias(c) for c in more]))


def asof(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, ttl: float) -> DataFrame:
    """Left with the right row's columns that is the latest up to left_time and no older than ttl; else nulls.

    One union and one ordered window instead of a range join: a key's rows are read once, in order.
    """
    more = [c for c in right.columns if c not in keys]
    l = left.select(*keys, F.col(left_time).alias("_t"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_l"), F.lit(None).alias("_r"))  # noqa: E741
    r = right.select(*keys, F.col(right_time).alias("_t"), F.lit(0).alias("_side"), F.lit(None).alias("_l"), F.struct(*more).alias("_r"))
    w = Window.partitionBy(*keys).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    seen = l.unionByName(r).withColumn("_r", F.last("_r", ignorenulls=True).over(w)).filter("_side = 1")
    fresh = F.col("_t") - F.col(f"_r.{right_time}") <= ttl
    return seen.select("_l.*", *[F.when(fresh, F.col(f"_r.{c}")).alias(c) for c in more])


class _Markers:
    """What a part of J7 does to the free markers before it: the alerts that ask for one of them, and those that it leaves."""

    def __init__(self, horizon: float):
        self.horizon, self.first, self.asking, self.free = horizon, None, [], deque()

    def add(self, columns: dict) -> None:
        for t, side, i in zip(*(columns[c].tolist() for c in ("t", "side", "id"))):
            self.first = t if self.first is None else self.first
            _expire(self.free, t, self.horizon)
            if side == 0:
                self.free.append((t, i))
            elif self.free:
                self.free.pop()
            elif t - self.first <= self.horizon:
                self.asking.append(t)

    def result(self) -> tuple:
        return self.asking, list(self.free)


def _expire(free: deque, t: float, horizon: float) -> None:
    while free and t - free[0][0] > horizon:
        free.popleft()


def attribute_greedily(alerts: DataFrame, markers: DataFrame, key: str, horizon: float) -> DataFrame:
    """(key, alert_id, marker_id): each alert, in order, takes the newest marker within horizon that none took.

    alerts (key, alert_id, at), markers (key, marker_id, marked). Both are read in one order; the state of a key is its
    free markers of the last horizon. Keys of many rows are read in parts (folds.scanned_fold): the sum of a part is its
    alerts of the first horizon that found no marker in it, and its markers of the last horizon that are free.
    """
    both = alerts.select(key, F.col("at").alias("t"), F.lit(1).alias("side"), F.col("alert_id").alias("id")).union(markers.select(key, F.col("marked"), F.lit(0), F.col("marker_id")))

    def step(free: deque, columns: dict) -> list:
        taken = []
        for t, side, i in zip(*(columns[c].tolist() for c in ("t", "side", "id"))):
            _expire(free, t, horizon)
            if side == 0:
                free.append((t, i))
            taken.append(free.pop()[1] if side and free else None)
        return [taken]

    def after(free: deque, part: tuple) -> None:
        asking, left = part
        for t in asking:
            _expire(free, t, horizon)
            if free:
                free.pop()
        free.extend(left)
        if left:
            _expire(free, left[-1][0], horizon)

    kind = both.schema["id"].dataType.simpleString()
    found = scanned_fold(both, [key], ["t", "side", "id"], f"marker_id {kind}", deque, step, ["t", "side", "id"], lambda: _Markers(horizon), after)
    return found.filter("side = 1 and marker_id is not null").select(key, F.col("id").alias("alert_id"), "marker_id")


def earliest_match(trials: DataFrame, alerts: DataFrame, keys: list[str], horizon: float, width: float) -> DataFrame:
    """Trials (trial, keys, started, stopped) with detected and latency of the first alert in [started, stopped + horizon]."""
    t = trials.withColumn("_end", F.col("stopped") + horizon)
    hits = points_in(alerts.select(*keys, "at"), "at", t, "started", "_end", keys, width).groupBy("trial").agg(F.min("at").alias("first_at"))
    return trials.join(hits, "trial", "left").withColumn("detected", F.col("first_at").isNotNull()).withColumn("latency", F.col("first_at") - F.col("started"))


def censored_horizons(intervals: DataFrame, keys: list[str], horizon: float, guard: float) -> DataFrame:
    """Adds attribution_end (the horizon, cut a guard before the key's next start, never before the own end) and censored."""
    upcoming = F.lead("started").over(Window.partitionBy(*keys).orderBy("started"))
    wanted = F.col("stopped") + horizon
    end = F.coalesce(F.least(wanted, F.greatest(F.col("stopped"), upcoming - guard)), wanted)
    return intervals.withColumn("attribution_end", end).withColumn("censored", F.col("attribution_end") < wanted)


def attribute_once(alerts: DataFrame, intervals: DataFrame, keys: list[str], width: float) -> DataFrame:
    """Alerts (keys, alert_id, at) with the one interval [started, attribution_end) that holds them; count says how many did."""
    found = points_in(alerts, "at", intervals, "started", "attribution_end", keys, width).filter(F.col("at") < F.col("attribution_end"))
    return found.groupBy("alert_id").agg(F.count("*").alias("count"), F.min("trial").alias("trial"))


def bracket_bad_rows(rows: DataFrame, key: str, order: str, time: str) -> DataFrame:
    """Rows without a valid time, with the nearest valid times around them."""
    w = Window.partitionBy(key).orderBy(order)
    before = F.last(time, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    after = F.first(time, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    return rows.withColumn("after_t", before).withColumn("before_t", after).filter(F.col(time).isNull())


def touches_phase(bad: DataFrame, phases: DataFrame, width: float) -> DataFrame:
    """Bracketed rows (after_t, before_t, null where there is no neighbour) with touches_phase: a phase [started, stopped]
    meets the closed bracket. Open ends reach as far as the phases do; brackets and phases meet by the cells of points_in()."""
    ends = F.broadcast(phases.agg(F.min("started").alias("_lo"), F.max("stopped").alias("_hi")))  # one row
    b = bad.crossJoin(ends)
    low, high = F.greatest(F.coalesce("after_t", "_lo"), "_lo"), F.least(F.coalesce("before_t", "_hi"), "_hi")
    inside = b.withColumn("_from", low).withColumn("_to", high)
    inside, marks = inside.filter("_from <= _to").select("_from", "_to", *bad.columns), phases.select("started", "stopped")
    # of two that meet, the later start is in the other one
    hits = points_in(marks, "started", inside, "_from", "_to", [], width).select(*bad.columns).union(points_in(inside, "_from", marks, "started", "stopped", [], width).select(*bad.columns))
    hits = hits.select(*[F.col(c).alias(f"_h_{c}") for c in bad.columns], F.lit(True).alias("_hit")).distinct()
    return bad.join(hits, [F.col(c).eqNullSafe(F.col(f"_h_{c}")) for c in bad.columns], "left").select(*bad.columns, F.coalesce("_hit", F.lit(False)).alias("touches_phase"))
