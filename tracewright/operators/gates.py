"""Gates, calibration, confirmation and decisions over scored windows of each key."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import deque

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.functions.syscalls import wilson
from tracewright.operators.folds import scanned_fold, sorted_fold
from tracewright.sources.files import written


def by(key: list[str], *order: str):
    return Window.partitionBy(*key).orderBy(*order)


def behaviour_gate(counts: DataFrame, limits: DataFrame, window: list[str], key: str, name: str) -> DataFrame:
    """G1: (window, gate, gate_syscall, gate_ratio): the largest ratio of a Wilson lower bound to its limit, and whether it is over 1."""
    ratio = counts.join(limits, [key, name]).withColumn("ratio", wilson(F.col("n"), F.col("total")) / F.col("limit_value"))
    top = ratio.groupBy(*window).agg(F.max(F.struct("ratio", F.col(name).alias("s"))).alias("top"))
    return top.select(*window, (F.col("top.ratio") > 1).alias("gate"), F.col("top.s").alias("gate_syscall"), F.col("top.ratio").alias("gate_ratio"))


def quality_skip(events: Column, floor: Column, age: Column, least: int, grace: float) -> Column:
    """Why a window is not judged; null if it is."""
    return F.when(events < least, "low_event_skip").when(events < floor, "collection_quality_skip").when(age < grace, "pod_startup_grace")


def _sorted_quantile(values: Column, q: float) -> Column:
    """Of a sorted array, with linear interpolation."""
    at = (F.size(values) - 1) * F.lit(q)
    low = F.floor(at).cast("int")
    a, b = F.get(values, low), F.get(values, F.least(low + 1, F.size(values) - 1))
    return a + (b - a) * (at - low)


def calibrated(rows: DataFrame, key: list[str], order: list[str], score: str, clean: Column, baseline: float, cap: int = 120, ready: int = 10, q: float = 0.995, margin: float = 0.5) -> DataFrame:
    """Adds limit: from the last cap clean scores up to here, the own one included; null until ready of them were seen.

    A clean flag does not depend on the limit, so nothing is recursive: clean rows get it from a frame of cap rows, the
    others from the clean row before them.
    """
    w = by([*key, "_clean"], *order)
    seen = F.array_sort(F.collect_list(score).over(w.rowsBetween(-(cap - 1), 0)))
    marked = rows.withColumn("_clean", clean).withColumn("_seen", F.when(F.col("_clean"), seen))
    mad = _sorted_quantile(F.array_sort(F.transform("_seen", lambda x: F.abs(x - _sorted_quantile(F.col("_seen"), 0.5)))), 0.5)
    top = _sorted_quantile(F.col("_seen"), q) + margin * F.greatest(mad, F.lit(1e-3))
    own = F.when(F.size("_seen") >= ready, F.least(F.lit(0.995), F.greatest(F.lit(baseline), top)))
    last = F.last("_own", ignorenulls=True).over(by(key, *order).rowsBetween(Window.unboundedPreceding, 0))
    return marked.withColumn("_own", own).withColumn("limit", last).drop("_clean", "_seen", "_own")


def run_length(rows: DataFrame, key: list[str], order: list[str], flag: Column, name: str = "run") -> DataFrame:
    """Adds the number of rows in a row, up to this one, for which flag holds."""
    island = F.sum(F.when(flag, 0).otherwise(1)).over(by(key, *order))
    out = rows.withColumn("_flag", flag).withColumn("_island", island)
    return out.withColumn(name, F.sum(F.when(F.col("_flag"), 1).otherwise(0)).over(by([*key, "_island"], *order))).drop("_flag", "_island")


def hysteresis(rows: DataFrame, key: list[str], order: list[str], qualifies: Column, nearly: Column) -> DataFrame:
    """Adds confirmed: two in a row qualify, or exactly one is pending and this one nearly does."""
    out = run_length(rows, key, order, qualifies)
    pending = F.lag("run").over(by(key, *order)) == 1
    return out.withColumn("confirmed", (F.col("run") >= 2) | (F.coalesce(pending, F.lit(False)) & nearly))


class _Sent:
    """The time of the last alert that was sent."""

    def __init__(self):
        self.last = None


class _Sends:
    """What a part's alerts do to the time of the last one sent before them.

    Alerts are sent again from some time on; the first one then is one of the part's first quiet or the next one. For each of
    these that may be the first, the last alert that is sent after it: (up to which time from on, last one), merged where they meet.
    """

    def __init__(self, quiet: float):
        self.quiet, self.first, self.upto, self.last = quiet, None, np.empty(0), np.empty(0)

    def _follow(self, last: np.ndarray, t: np.ndarray) -> np.ndarray:
        while True:
            i = np.searchsorted(t, last + self.quiet, side="left")
            if not (goes := i < len(t)).any():
                return last
            last = np.where(goes, t[np.minimum(i, len(t) - 1)], last)

    def add_times(self, times: np.ndarray) -> None:
        """Later times than all before, or equal to the last of them; in any order."""
        t = np.unique(times)
        if not len(t):
            return
        if self.first is None:
            self.first, self.upto, self.last = t[0], t[:0], t[:0]
        # those of the first quiet, and the next one, if none is at its end
        new = t[: np.searchsorted(t, self.first + self.quiet, side="left") + 1]
        if len(self.upto):
            new = new[new > self.upto[-1]] if self.upto[-1] < self.first + self.quiet else new[:0]
        last = np.concatenate([self._follow(self.last, t), self._follow(new, t)])
        ends = np.r_[last[1:] != last[:-1], True]
        self.upto, self.last = np.concatenate([self.upto, new])[ends], last[ends]

    def result(self) -> tuple:
        return self.upto, self.last

    @staticmethod
    def after(sent, part: tuple, quiet: float):
        """The time of the last alert after a part, whose state before is sent or None."""
        upto, last = part
        i = 0 if sent is None else int(np.searchsorted(upto, sent + quiet, side="left"))
        return last[i] if i < len(last) else sent


class _SentTimes(_Sends):
    def __init__(self, time: str, quiet: float):
        super().__init__(quiet)
        self.time = time

    def add(self, columns: dict[str, np.ndarray]) -> None:
        self.add_times(columns[self.time])


def cooldown(alerts: DataFrame, key: list[str], time: str, quiet: float) -> DataFrame:
    """Alerts that are sent: the first, then each that is at least quiet after the last one sent, and those at the same time.

    Alerts are read in order, from one that is sent to the next by binary search; the state of a key is one time. Keys of
    many alerts are read in parts (folds.scanned_fold); the sum of a part grows with its alerts of one quiet at most.
    Without quiet all are sent.
    """
    if quiet <= 0:
        return alerts

    def step(s: _Sent, columns: dict[str, np.ndarray]) -> list:
        t = columns[time]
        keep = np.zeros(len(t), bool) if s.last is None else t == s.last
        while True:
            i = 0 if s.last is None else int(np.searchsorted(t, s.last + quiet, side="left"))
            if i >= len(t):
                return [keep]
            s.last = t[i]
            keep[i : np.searchsorted(t, s.last, side="right")] = True

    def after(s: _Sent, part: tuple) -> None:
        s.last = _Sends.after(s.last, part, quiet)

    return scanned_fold(alerts, key, [time], "_sent boolean", _Sent, step, [time], lambda: _SentTimes(time, quiet), after).filter("_sent").drop("_sent")


class _Chain:
    """What a key's decisions carry on: windows in a row on each path (hard, behaviour, volume), and when it last alerted."""

    def __init__(self):
        self.counts, self.sent = (0, 0, 0), None


def _confirming(counts: tuple[int, int, int], skip, calibrating, gate, score, limit, extreme, warned, k, near, behaviour_floor, warning_floor) -> tuple[tuple[int, int, int], str, str | None, bool]:
    """The counts after a window, its decision but for the cooldown, its path, and whether it is confirmed."""
    if skip is not None:
        return (0, 0, 0), skip, None, False
    if calibrating:
        return counts, "calibrating", None, False
    hard, behaviour, volume = counts
    high = score >= limit
    if gate:
        volume = 0
        hard, path = (hard + 1, "hard_ml") if high else (k, "hysteresis_ml") if hard == 1 and score >= near * limit else (0, None)
        behaviour = behaviour + 1 if behaviour_floor < limit and score >= behaviour_floor else 0
        confirmed = hard >= k
        if not confirmed and warned and warning_floor < limit and score >= warning_floor:
            confirmed, path = True, "fast_path_behavior_ml_floor"
        elif not confirmed and behaviour >= k:
            confirmed, path = True, "behavior_persistence_ml_floor"
    else:
        hard = behaviour = 0
        volume = volume + 1 if high and extreme else 0
        if not volume:
            return (0, 0, 0), "behavior_gated" if high else "normal", None, False
        confirmed, path = volume >= k, "extreme_volume_ml"
    return (hard, behaviour, volume), "detection" if confirmed else "pending_confirmation", path, confirmed


class _Courses:
    """What a part's windows do to the counts and the last alert before them.

    Counts matter up to the largest k, or 2, so there are few; each is followed, and where two become equal they are
    followed as one. Which windows are confirmed, and so which alerts may be sent, hangs on the counts alone.
    """

    def __init__(self, read: list[str], quiet: float, most: int):
        self.read, self.most = read, max(most, 2)
        some = range(self.most + 1)
        self.starts = [(h, b, 0) for h in some for b in some] + [(0, 0, v) for v in some if v]
        self.live = {c: [i] for i, c in enumerate(self.starts)}
        self.sends = [_Sends(quiet) for _ in self.starts]

    def add(self, columns: dict[str, np.ndarray]) -> None:
        confirmed: list[list] = [[] for _ in self.starts]
        for *row, t in zip(*(columns[c].tolist() for c in self.read)):
            live: dict[tuple, list[int]] = {}
            for counts, who in self.live.items():
                now, _, _, sure = _confirming(counts, *row)
                live.setdefault(capped(now, self.most), []).extend(who)
                for i in who if sure else ():
                    confirmed[i].append(t)
            self.live = live
        for s, times in zip(self.sends, confirmed):
            s.add_times(np.array(times))

    def result(self) -> dict:
        return {self.starts[i]: (counts, *self.sends[i].result()) for counts, who in self.live.items() for i in who}


def capped(counts: tuple[int, int, int], most: int) -> tuple[int, int, int]:
    return tuple(min(n, most) for n in counts)


def decisions(rows: DataFrame, key: list[str], time: str, quiet: float) -> DataFrame:
    """Adds decision and path to windows in order of time, of which a key has one row each.

    rows have skip (why a window is not judged, or null; it starts all counts anew), calibrating (not judged either, but
    counts go on), gate, score, score_limit, extreme (more events than the learned maximum), warned (an early warning
    holds), and the policy: k (windows in a row that confirm), near (the share of the limit at which the second of two
    confirms), behaviour_floor and warning_floor (scores that confirm with persistent behaviour or with a warning; they
    count only below the limit). Confirmed windows within quiet after an alert are in cooldown, which they don't extend.

    Rows are written once, as they are read several times. Keys of many windows are read in parts (folds.scanned_fold).
    """
    read = ["skip", "calibrating", "gate", "score", "score_limit", "extreme", "warned", "k", "near", "behaviour_floor", "warning_floor", time]
    rows = written(rows, "decided")
    most = max(rows.agg(F.max("k")).first()[0] or 0, 2)

    def one(s: _Chain, *row) -> tuple[str, str | None]:
        *row, t = row
        s.counts, decision, path, confirmed = _confirming(s.counts, *row)
        if confirmed:
            if s.sent is not None and t - s.sent < quiet:
                return "cooldown", path
            s.sent = t
        return decision, path

    def step(s: _Chain, columns: dict[str, np.ndarray]) -> list:
        out = [one(s, *row) for row in zip(*(columns[c].tolist() for c in read))]
        return [[d for d, _ in out], [p for _, p in out]]

    def after(s: _Chain, part: dict) -> None:
        s.counts, *sends = part[capped(s.counts, most)]
        s.sent = _Sends.after(s.sent, sends, quiet)

    return scanned_fold(rows, key, [time], "decision string, path string", _Chain, step, read, lambda: _Courses(read, quiet, most), after)


def sequence_rule(events: DataFrame, key: str, order: list[str], name: str, time: str, network: Column, within: float, privilege: list[str], consume: list[str]) -> DataFrame:
    """(…, rule, first_time): an exec followed within some time by a privilege call, or by connect if it was of a network binary.

    The last exec before counts, unless a consuming call came since; a warning does not use it up.
    """
    mark = F.when(F.col(name) == "execve", F.struct(F.col(time).alias("t"), network.alias("network"))).when(F.col(name).isin(*consume), F.struct(F.lit(None).cast(events.schema[time].dataType).alias("t"), F.lit(False).alias("network")))
    last = F.last(mark, ignorenulls=True).over(by([key], *order).rowsBetween(Window.unboundedPreceding, -1))
    out = events.withColumn("_last", last).withColumn("first_time", F.col("_last.t"))
    rule = F.when(F.col(name).isin(*privilege), "exec_privilege").when((F.col(name) == "connect") & F.col("_last.network"), "exec_network")
    near = F.col("first_time").isNotNull() & (F.col(time) - F.col("first_time") <= within)
    return out.withColumn("rule", F.when(near, rule)).filter("rule is not null").drop("_last")


def corroborated(windows: DataFrame, counts: DataFrame, groups: DataFrame, maxima: DataFrame, window: list[str], key: str, name: str, least_mass: int) -> DataFrame:
    """(window, corroborated, groups): a group's sum is over the workload's usual one by its least excess, or all groups' mass is enough.

    groups (grp, field, minimum_excess) and maxima (key, grp, normal_max) are policy tables. known is false for a
    workload without maxima, which is an error of the policy.
    """
    sums = counts.join(groups, counts[name] == groups["field"]).groupBy(*window, "grp").agg(F.sum("n").alias("observed"), F.max("minimum_excess").alias("minimum_excess"))
    judged = sums.join(maxima, [key, "grp"], "left").withColumn("hit", F.col("observed") - F.col("normal_max") >= F.col("minimum_excess"))
    mass = counts.join(groups.select("field").distinct(), counts[name] == F.col("field")).groupBy(*window).agg(F.sum("n").alias("mass"))
    out = judged.groupBy(*window).agg(F.bool_or("hit").alias("any_hit"), F.array_sort(F.collect_list(F.when(F.col("hit"), F.col("grp")))).alias("groups"), F.bool_and(F.col("normal_max").isNotNull()).alias("known"))
    return windows.join(out, window, "left").join(mass, window, "left").select(*windows.columns, (F.coalesce("any_hit", F.lit(False)) | (F.coalesce("mass", F.lit(0)) >= least_mass)).alias("corroborated"), F.coalesce("groups", F.array().cast("array<string>")).alias("groups"), F.coalesce("known", F.lit(True)).alias("known"))


def temporal_confirmation(rows: DataFrame, key: list[str], time: str, candidate: Column, groups: str, bypass: list[str], required: int, max_gap: float) -> DataFrame:
    """Adds alert: required candidates in a row within max_gap of each other that share a group; bypass groups alert at once."""
    w = by(key, time)
    out = rows.withColumn("_c", candidate & (F.size(groups) > 0)).withColumn("_b", F.col("_c") & F.arrays_overlap(groups, F.array(*map(F.lit, bypass))))
    open_ = F.col("_c") & ~F.col("_b")
    gap = F.col(time) - F.lag(time).over(w)
    goes_on = open_ & F.lag(open_).over(w) & (gap > 0) & (gap <= max_gap) & F.arrays_overlap(groups, F.lag(groups).over(w))
    out = out.withColumn("_i", F.sum(F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1)).over(w))
    run = F.row_number().over(by([*key, "_i"], time))
    return out.withColumn("alert", F.col("_b") | (F.col("_c") & ~F.col("_b") & (run >= required))).drop("_c", "_b", "_i")


def agent_decisions(rows: DataFrame, key: str, order: list[str], score: str, time: str, minimum: float = 0.5, need: int = 2, quiet: float = 3.0, cap: int = 120, ready: int = 10) -> DataFrame:
    """(key, order..., decision, limit_now). The limit follows the scores that raised no alert, so each row needs the one before.

    An agent's rows are read in order; the state is the last cap scores, a counter and a time. The same step runs on streams.
    """

    def step(agent: AgentState, columns: dict[str, np.ndarray]) -> list:
        out = [agent.step(float(s), float(t)) for s, t in zip(columns[score], columns[time])]
        return [[d for d, _ in out], np.array([x for _, x in out], float)]

    return sorted_fold(rows.select(key, *order, score, time), [key], order, "decision string, limit_now double", lambda: AgentState(minimum, need, quiet, cap, ready), step, [score, time])


class AgentState:
    """What is remembered of an agent between its scores: the last ones, also in rising order."""

    def __init__(self, minimum: float, need: int, quiet: float, cap: int, ready: int):
        self.minimum, self.need, self.quiet, self.cap, self.ready = minimum, need, quiet, cap, ready
        self.remember([])
        self.pending, self.last = 0, None

    def remember(self, scores: list[float]) -> None:
        self.scores, self.rising = deque(scores), sorted(scores)

    @staticmethod
    def _quantile(x: list[float], first: int, q: float) -> float:
        """Of x[first:], rising, with linear interpolation."""
        at = (len(x) - first - 1) * q
        low = int(at)
        a, b = x[first + low], x[min(first + low + 1, len(x) - 1)]
        return a + (b - a) * (at - low)

    def limit(self) -> float:
        x = self.rising
        if len(x) < self.ready:
            return self.minimum
        return max(self.minimum, self._quantile(x, bisect_left(x, self._quantile(x, 0, 0.9)), 0.995) + 0.25)

    def step(self, score: float, time: float) -> tuple[str, float]:
        limit = self.limit()
        if score < limit:
            self.pending = 0
            self.scores.append(score)
            insort(self.rising, score)
            if len(self.scores) > self.cap:
                del self.rising[bisect_left(self.rising, self.scores.popleft())]
            return "normal", limit
        self.pending += 1
        if self.pending < self.need:
            return "pending", limit
        if self.last is not None and time - self.last < self.quiet:
            return "cooldown", limit
        self.pending, self.last = 0, time
        return "alert", limit


def first_sensitive(windows: DataFrame, sequence: str, start: str, end: str, names: list[str]) -> DataFrame:
    """Adds first_at: when, evenly spaced in the window, the first sensitive call of its sequence came; rows without any go."""
    at = F.array_min(F.filter(F.transform(sequence, lambda x, i: F.when(x.isin(*names), i + 1)), lambda v: v.isNotNull()))
    return windows.withColumn("_k", at).filter("_k is not null").withColumn("first_at", F.col(start) + F.col("_k") / F.size(sequence) * (F.col(end) - F.col(start))).drop("_k")
