"""Keys of many rows are read in parts with the result of a loop over the whole key."""

import random

import pytest
from pyspark.sql import functions as F

from tracewright.operators import folds, gates, joins, windows


@pytest.fixture
def small_parts(monkeypatch):
    """Many parts on few rows."""
    monkeypatch.setattr(folds, "LEAST_ROWS", 16)
    monkeypatch.setattr(folds, "PARTS", 64)


def hot(rng: random.Random, n: int) -> str | None:
    """Nine rows of ten have one key; some have none."""
    return "hot" if rng.random() < 0.9 else rng.choice(["a", None])


def test_parts_are_small_and_in_order(spark, small_parts):
    rng = random.Random(1)
    rows = [(hot(rng, i), rng.randint(0, 10**6), i) for i in range(4000)] + [("hot", None, -1)]
    d = folds.parted(spark.createDataFrame(rows, "k string, t long, i long"), ["k"], "t")
    parts = d.filter("k = 'hot'").groupBy("_part").agg(F.count("*").alias("n"), F.min("t").alias("low"), F.max("t").alias("high")).orderBy("_part").collect()
    assert len(parts) > 50 and max(p.n for p in parts) < 2.5 * 4000 / 64
    assert all(a.high < b.low for a, b in zip(parts, parts[1:]))
    assert d.count() == 4001 and d.filter("k is null and _cut").count() > 0
    assert folds.parted(spark.createDataFrame(rows[:10], "k string, t long, i long"), ["k"], "t") is None
    assert folds.parted(spark.createDataFrame([], "k string, t long"), ["k"], "t") is None


def test_equal_times_stay_together(spark, small_parts):
    rows = [("k", i % 3, i) for i in range(600)] + [("k", 7, i) for i in range(400)]
    d = folds.parted(spark.createDataFrame(rows, "k string, t long, i long"), ["k"], "t")
    assert d.groupBy("t").agg(F.countDistinct("_part").alias("n")).filter("n > 1").count() == 0


@pytest.mark.parametrize("most", [3, 12, 19, 25, 60])
def test_anchored_windows_in_parts(spark, small_parts, most):
    """Gaps below a width, between one and two, and longer ones."""
    rng = random.Random(most)
    at, rows = {}, []
    for i in range(3000):
        k = hot(rng, i)
        at[k] = at.get(k, 0) + rng.randint(0, most)
        rows.append((k, float(at[k]), i))
    want, anchors = {}, {}
    for k, t, i in rows:
        a = anchors.get(k)
        anchors[k] = t if a is None or t - a >= 20 else a + 10 if t - a >= 10 else a
        want[i] = anchors[k]
    rng.shuffle(rows)
    e = spark.createDataFrame(rows, "k string, t double, i long").repartition(5)
    assert {r.i: r.anchor for r in windows.anchored_windows(e, "k", "t", "i", 10.0).collect()} == want


def test_a_part_sums_up_any_grid_before_it():
    """The arcs of a part say for each phase what reading its events one by one gives."""
    rng = random.Random(5)
    for _ in range(200):
        times, t = [], 1000
        for _ in range(rng.randint(1, 30)):
            t += rng.randint(0, 21)
            times.append(float(t))
        grids = windows._Grids("t", 10.0)
        cut = rng.randint(0, len(times))
        for some in (times[:cut], times[cut:]):
            if some:
                grids.add({"t": windows.np.array(some)})
        first, last, arcs = grids.result()
        assert (first, last) == (times[0], times[-1]) and arcs[0][0] == 0 and arcs[-1][1] == 10
        for base in range(int(first) - 9, int(first) + 1):
            state = windows._Anchor()
            state.base = b = float(base)
            for before, t in zip(times, times[1:]):
                if state.opens_anew(before, t, 10.0):
                    state.base = t
            p = grids.phase(b, 10.0)
            became = next(x for low, high, x in arcs if low < p <= high)
            assert (b if became is None else became) % 10 == state.base % 10


@pytest.mark.parametrize("span,quiet", [(500, 20), (5000, 20), (5000, 4000), (300000, 20), (100, 20.5)])
def test_cooldown_in_parts(spark, small_parts, span, quiet):
    """Many alerts in a quiet time, few, and fewer quiet times than parts; repeated ones."""
    rng = random.Random(span)
    rows = [(hot(rng, i), rng.randint(0, span), i) for i in range(3000)]
    want, last = set(), {}
    for k, t in sorted({(str(k), t) for k, t, _ in rows}):
        if k not in last or t - last[k] >= quiet:
            last[k] = t
            want.add((k, t))
    got = gates.cooldown(spark.createDataFrame(rows, "k string, t long, i long").repartition(7), ["k"], "t", quiet).collect()
    assert {(str(r.k), r.t) for r in got} == want
    assert len(got) == sum((str(k), t) in want for k, t, _ in rows)


def test_cooldown_without_quiet_sends_all(spark):
    a = spark.createDataFrame([("k", 1), ("k", 1), ("k", 2)], "k string, t long")
    assert gates.cooldown(a, ["k"], "t", 0).count() == 3


@pytest.mark.parametrize("k", [1, 2, 4])
def test_decisions_in_parts(spark, monkeypatch, k):
    rng = random.Random(k)
    columns = "w string, t long, skip string, calibrating boolean, gate boolean, score double, score_limit double, extreme boolean, warned boolean, k int, near double, behaviour_floor double, warning_floor double"
    rows = []
    for i in range(2500):
        w = "hot" if rng.random() < 0.9 else "b"
        rows.append((w, i, "low_event_skip" if rng.random() < 0.04 else None, rng.random() < 0.1, rng.random() < 0.75, rng.random(), 0.55, rng.random() < 0.7, rng.random() < 0.1, k, 0.8, 0.3, 0.5))
    d = spark.createDataFrame(rows, columns)
    whole = {(r.w, r.t): (r.decision, r.path) for r in gates.decisions(d, ["w"], "t", 5).collect()}
    monkeypatch.setattr(folds, "LEAST_ROWS", 16)
    monkeypatch.setattr(folds, "PARTS", 64)
    assert folds.parted(d, ["w"], "t") is not None
    got = {(r.w, r.t): (r.decision, r.path) for r in gates.decisions(d.repartition(6), ["w"], "t", 5).collect()}
    assert got == whole and len({x for x, _ in got.values()}) == 7


@pytest.mark.parametrize("span,horizon", [(3000, 15.0), (3000, 900.0), (200000, 15.0)])
def test_greedy_attribution_in_parts(spark, small_parts, span, horizon):
    rng = random.Random(span)
    alerts = [(hot(rng, i), i, float(rng.randint(0, span))) for i in range(1500)]
    markers = [(hot(rng, i), 10_000 + i, float(rng.randint(0, span))) for i in range(1500)]
    want, free = set(), {}
    for k, t, side, i in sorted([(str(k), t, 1, i) for k, i, t in alerts] + [(str(k), t, 0, i) for k, i, t in markers]):
        stack = free.setdefault(k, [])
        if side == 0:
            stack.append((t, i))
        elif stack and t - stack[-1][0] <= horizon:
            want.add((i, stack.pop()[1]))
    a = spark.createDataFrame(alerts, "pod string, alert_id long, at double")
    m = spark.createDataFrame(markers, "pod string, marker_id long, marked double")
    got = {(r.alert_id, r.marker_id) for r in joins.attribute_greedily(a, m, "pod", horizon).collect()}
    assert got == want and len(got) > 100


def test_no_task_reads_a_whole_key(spark, small_parts):
    """The parts of a hot key are dealt over the tasks."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so few bytes would be one task
    rows = spark.range(4000).select(F.lit("hot").alias("k"), (F.col("id") * 3.0).alias("t"), F.col("id").alias("i"))
    tasks = windows.anchored_windows(rows, "k", "t", "i", 10.0).withColumn("task", F.spark_partition_id()).groupBy("task").count().collect()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(tasks) >= 3 and max(r["count"] for r in tasks) < 2500
