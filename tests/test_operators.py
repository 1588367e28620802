"""Operators on small cases with known results."""

import hashlib
import math
import random
import time
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewright import catalog
from tracewright.operators import contracts, gates, joins, models, outcomes, robust, sets, splits, windows


def test_anchored_windows(spark):
    e = spark.createDataFrame([("p", 1000.0, 1), ("p", 1029.9, 2), ("p", 1030.0, 3), ("p", 1200.0, 4), ("p", 1200.0, 5)], "k string, t double, i long")
    got = {r.i: r.anchor for r in windows.anchored_windows(e, "k", "t", "i", 30.0).collect()}
    assert got == {1: 1000.0, 2: 1000.0, 3: 1030.0, 4: 1200.0, 5: 1200.0}


def test_anchored_windows_like_a_loop(spark):
    rng = random.Random(3)
    rows = [(rng.choice("ab"), float(rng.randint(0, 400)), i) for i in range(120)]
    want = {}
    for k in "ab":
        a = None
        for _, t, i in sorted((r for r in rows if r[0] == k), key=lambda r: (r[1], r[2])):
            a = t if a is None or t - a >= 20 else a + 10 if t - a >= 10 else a
            want[i] = a
    e = spark.createDataFrame(rows, "k string, t double, i long")
    assert {r.i: r.anchor for r in windows.anchored_windows(e, "k", "t", "i", 10.0).collect()} == want


def test_counter_deltas(spark):
    s = spark.createDataFrame([("c", 0, 10, 100), ("c", 0, 11, 5100), ("c", 42, 10, 2), ("c", 42, 11, 5), ("d", 0, 1, 100), ("d", 0, 2, 4), ("e", 0, 1, 1), ("e", 0, 1, 1)], "src string, name int, t int, v long")
    got = {(r.src, r.name): r.delta for r in windows.counter_deltas(s, ["src"], ["name"], "t", "v").collect()}
    assert got == {("c", 0): 5000, ("c", 42): 3, ("d", 0): 4}


def rule(spark, rows, within=2.0):
    e = spark.createDataFrame([("p", float(t), i, c, b) for i, (t, c, b) in enumerate(rows)], "pod string, t double, i long, call string, net boolean")
    return [r.rule for r in gates.sequence_rule(e, "pod", ["t", "i"], "call", "t", F.col("net"), within, ["unshare", "setuid"], ["setgid"]).collect()]


def test_sequence_rule(spark):
    assert rule(spark, [(0, "connect", False), (1, "execve", False), (2, "unshare", False)]) == ["exec_privilege"]
    assert rule(spark, [(0, "execve", False), (1, "connect", False)]) == []
    assert rule(spark, [(0, "execve", True), (1, "connect", False)]) == ["exec_network"]
    assert rule(spark, [(0, "execve", False), (1, "setgid", False), (2, "setuid", False)]) == []


def test_cooldown_like_a_loop(spark):
    rng = random.Random(5)
    times = sorted(rng.randint(0, 300) for _ in range(60))
    want, last = [], None
    for t in dict.fromkeys(times):
        if last is None or t - last >= 20:
            want.append(t)
            last = t
    a = spark.createDataFrame([("p", t) for t in times], "pod string, t long")
    assert sorted(r.t for r in gates.cooldown(a, ["pod"], "t", 20).distinct().collect()) == want


def test_temporal_confirmation(spark):
    def alerts(rows):
        df = spark.createDataFrame([("s", float(t), g) for t, g in rows], "k string, t double, g array<string>")
        return gates.temporal_confirmation(df, ["k"], "t", F.lit(True), "g", ["bypass"], 2, 2.0).filter("alert").count()

    assert alerts([(0, ["a"])]) == 0 and alerts([(0, ["a"]), (1, ["a"])]) == 1
    assert alerts([(0, ["a"]), (1, ["b"])]) == 0 and alerts([(0, ["a"]), (3, ["a"])]) == 0 and alerts([(0, ["bypass"])]) == 1


def test_event_bounds(spark):
    low = spark.createDataFrame([("w", n) for n in [120] * 9 + [10000]], "w string, n long")
    assert robust.event_bounds(low, "w", "n").first().low == 60
    high = spark.createDataFrame([("w", n) for n in [100] * 9 + [150]], "w string, n long")
    assert 290 <= robust.event_bounds(high, "w", "n").first().high <= 300


def test_calibration_takes_no_poison(spark):
    rows = spark.createDataFrame([("p", i, 0.95 if i == 0 else 0.2) for i in range(12)], "p string, i int, s double")
    got = gates.calibrated(rows, ["p"], ["i"], "s", F.col("s") < 0.8, 0.1, ready=2).orderBy("i").collect()
    assert got[0].limit is None and got[-1].limit == pytest.approx(0.2 + 0.5 * 1e-3)


def test_censored_horizon(spark):
    i = spark.createDataFrame([("p", 1, 100.0, 109.0), ("p", 2, 120.0, 130.0)], "pod string, trial int, started double, stopped double")
    first = joins.censored_horizons(i, ["pod"], 20.0, 1.0).filter("trial = 1").first()
    assert first.attribution_end == 119.0 and first.censored


def test_greedy_attribution_uses_markers_once(spark):
    alerts = spark.createDataFrame([("p", 10, 5.0), ("p", 11, 6.0), ("p", 12, 40.0)], "pod string, alert_id long, at double")
    markers = spark.createDataFrame([("p", 1, 1.0), ("p", 2, 4.0), ("p", 3, 20.0)], "pod string, marker_id long, marked double")
    got = {(r.alert_id, r.marker_id) for r in joins.attribute_greedily(alerts, markers, "pod", 15.0).collect()}
    assert got == {(10, 2), (11, 1)}


def test_overlaps_like_all_pairs(spark):
    rng = random.Random(2)
    left = [(rng.choice("xy"), i, s, s + rng.randint(1, 40)) for i in range(60) for s in [rng.randint(0, 300)]]
    right = [(rng.choice("xy"), i, s, s + rng.randint(1, 90)) for i in range(40) for s in [rng.randint(0, 300)]]
    want = {(a[1], b[1]) for a in left for b in right if a[0] == b[0] and a[2] < b[3] and b[2] < a[3]}
    l = spark.createDataFrame(left, "k string, a long, began long, ended long")  # noqa: E741
    r = spark.createDataFrame(right, "k string, b long, started long, stopped long")
    rows = joins.overlaps(l, r, ["k"], 25).collect()
    assert {(x.a, x.b) for x in rows} == want and len(rows) == len(want)


def test_exact_tests(spark):
    p = lambda a, b: spark.range(1).select(outcomes.mcnemar(F.lit(a), F.lit(b)).alias("p")).first().p
    assert p(0, 0) == 1.0 and p(10, 0) == pytest.approx(2 / 1024)
    d = spark.createDataFrame([("g", 1.0), ("g", 1.0)], "g string, v double")
    assert outcomes.sign_flip(d, ["g"], "v").first().p == 0.5
    t = spark.createDataFrame([("f", "a", 0.01), ("f", "b", 0.04), ("f", "c", 0.5)], "f string, name string, p double")
    assert [round(r.adjusted, 6) for r in outcomes.holm(t, ["f"], "p", "name").orderBy("name").collect()] == [0.03, 0.08, 0.5]


def test_sign_flips_of_large_groups(spark, tmp_path):
    rows = [("ones", 1.0 if i < 40 else -1.0) for i in range(60)] + [("all", 0.3)] * 45 + [("zero", 0.0)] * 50
    d = spark.createDataFrame(rows, "g string, v double")
    got = {r.g: (r.n, r.p) for r in outcomes.sign_flip(d, ["g"], "v").collect()}
    assert got["ones"] == (60, pytest.approx(2 * sum(math.comb(60, k) for k in range(21)) / 2**60))
    assert got["all"] == (45, pytest.approx(2 / 2**45)) and got["zero"] == (50, 1.0)
    s = spark.createDataFrame([(1 + i % 2, float(2000 + 37 * i % 2900)) for i in range(100)], "s_nationkey int, s_acctbal double")
    s.write.parquet(str(tmp_path / "supplier.parquet"))
    assert {(r.s_nationkey, r.n) for r in catalog.QUERIES["t7_sign_flips"](spark, str(tmp_path)).collect()} == {(1, 50), (2, 50)}


def test_sign_flip_counts_agree(monkeypatch):
    rng = random.Random(5)
    for n in (3, 14):
        v = np.array([rng.randint(-900000, 1100000) / 100 for _ in range(n)])
        signs = ((np.arange(1 << n)[:, None] >> np.arange(n)) & 1) * 2.0 - 1
        assert outcomes.sign_flip_p(v) == (np.abs(signs @ v) >= abs(v.sum()) - 1e-9).mean()
    v = np.array([rng.randint(-900000, 1100000) / 100 for _ in range(40)])
    want = outcomes.sign_flip_p(v)
    monkeypatch.setattr(outcomes, "HALVES_ROWS", 0)
    assert outcomes.sign_flip_p(v) == pytest.approx(want, abs=2e-6)


def test_sign_flips_in_cents_like_the_whole_law():
    rng = np.random.default_rng(9)
    # all in cents, whole hundreds but for two values, and values that repeat
    for cents in (rng.integers(-40000, 70000, 60), np.append(rng.integers(-60, 100, 90) * 100, [1, 37]), np.repeat(rng.integers(-9000, 15000, 15), 8)):
        law, a, seen = np.ones(1), np.abs(cents), abs(int(cents.sum()))
        for k in a:
            law = (np.append(law, np.zeros(2 * k)) + np.append(np.zeros(2 * k), law)) / 2
        assert outcomes.sign_flip_p(cents / 100) == pytest.approx(2 * law[(int(a.sum()) + seen) // 2 * 2 :].sum(), abs=1e-11)


def test_sign_flips_where_few_values_break_whole_thousands():
    # a step of 1000.00 cents apart from one cent: sums lie in pairs, which a rounded law smears
    rng = np.random.default_rng(9)
    for few in ([1], [1, 2, 40]):
        cents = np.append(rng.integers(-20, 25, 60) * 100000, few)
        law = {0: 1.0}
        for k in cents.tolist():
            step = defaultdict(float)
            for s, share in law.items():
                step[s + k] += share / 2
                step[s - k] += share / 2
            law = step
        want = sum(share for s, share in law.items() if abs(s) >= abs(int(cents.sum())))
        assert outcomes.sign_flip_p(cents / 100) == pytest.approx(want, abs=1e-11)


def test_sign_flips_of_very_large_groups(spark):
    # S = a X + b Y of two walks, whose law is known
    a, b, up, down = 1000003, 777777, (5050, 5000), (4950, 5001)
    seen = a * (up[0] - down[0]) + b * (up[1] - down[1])
    walk = lambda n: np.exp([math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) - n * math.log(2) for k in range(n + 1)])
    m, n = up[0] + down[0], up[1] + down[1]
    least = np.ceil((seen - a * (2 * np.arange(m + 1) - m)) / b)  # Y at least so much
    tail = np.append(np.cumsum(walk(n)[::-1])[::-1], 0)
    want = 2 * (walk(m) * tail[np.clip(np.ceil((least + n) / 2), 0, n + 1).astype(int)]).sum()
    v = np.repeat([a, -a, b, -b], [up[0], down[0], up[1], down[1]]) / 100
    assert outcomes.sign_flip_p(v) == pytest.approx(want, abs=1e-9)
    rng = np.random.default_rng(4)
    d = spark.createDataFrame([(g, float(x) / 100) for g in range(20) for x in rng.integers(-500000, 500000, 2000)], "g int, v double")
    out = outcomes.sign_flip(d, ["g"], "v").withColumn("task", F.spark_partition_id()).collect()
    assert len(out) == 20 and {r.n for r in out} == {2000} and len({r.task for r in out}) > 4


def test_paired_table_and_confusion(spark):
    pairs = spark.createDataFrame([(1, True, False), (1, True, True), (1, False, True), (1, False, False)], "g int, a boolean, b boolean")
    assert outcomes.paired_table(pairs, ["g"], "a", "b").first()[1:] == (1, 1, 1, 1)
    trials = spark.createDataFrame([(1, True, True), (1, True, False)] + [(1, False, False)] * 100, "g int, attack boolean, alert boolean")
    c = outcomes.confusion(trials, ["g"], F.col("attack"), F.col("alert")).first()
    assert (c.tp, c.fn, c.fp, c.tn, c.recall) == (1, 1, 0, 100, 0.5) and c.false_rate == 0.0


def test_conformal_ties_count(spark):
    cal = spark.createDataFrame([("k", float(i), i) for i in range(1, 20)], "k string, s double, i int")
    new = spark.createDataFrame([("k", 19.0, 1), ("k", 5.0, 2), ("k", 30.0, 3)], "k string, s double, i int")
    got = {r.i: r.p for r in models.conformal(new, cal, ["k"], "s", 0.05).collect()}
    assert got == {1: pytest.approx(2 / 20), 2: pytest.approx(16 / 20), 3: pytest.approx(1 / 20)}


def test_ordered_split_takes_decimal_shares(spark):
    """0.7 of 90 rows is 63, and rows of one time are dealt by their id."""
    rows = [("p", i // 4, i) for i in range(90)]
    random.Random(8).shuffle(rows)
    split = models.ordered_split(spark.createDataFrame(rows, "pod string, t int, i int").repartition(3), ["pod"], "t", "i", 3)
    assert {r.i: r.part for r in split.collect()} == {i: "fit" if i < 60 else "both" if i < 63 else "calibration" for i in range(90)}


def test_components_reconstruct(spark):
    rng = random.Random(1)
    rows = [(0, i, [x, 2 * x, -x]) for i, x in enumerate(rng.uniform(-1, 1) for _ in range(30))]
    v = spark.createDataFrame(rows, "w int, i long, v array<double>")
    e = models.reconstruction_error(v, models.fit_components(v, "w", "v", 1), "w", "i", "v").collect()
    assert len(e) == 30 and max(r.error for r in e) < 1e-12


def test_isolation_finds_the_outlier(spark):
    rng = random.Random(4)
    rows = [(0, i, [rng.gauss(0, 1), rng.gauss(0, 1)]) for i in range(200)] + [(0, 999, [12.0, 12.0])]
    v = spark.createDataFrame(rows, "w int, i long, v array<double>")
    s = models.isolation_scores(v, "w", "i", "v", trees=24).orderBy(F.desc("isolation")).first()
    assert s.i == 999


def test_pareto_fit_is_near(spark):
    import numpy as np

    x = np.sort(np.random.default_rng(0).pareto(4, 4000))
    shape, scale = robust.fit_pareto(x)
    assert abs(shape - 0.25) < 0.08 and abs(scale - 0.25) < 0.05


def test_reconcile_and_roles(spark):
    a = spark.createDataFrame([(1, "x"), (2, "x"), (3, "x")], "id int, v string")
    b = spark.createDataFrame([(1, "x"), (2, "y"), (4, "x")], "id int, v string")
    assert {(r.id, r.problem) for r in sets.reconcile(a, b, ["id"], ["v"]).collect()} == {(2, "changed"), (3, "missing"), (4, "unexpected")}
    runs = spark.createDataFrame([("a",), ("b",), ("c",)], "run string")
    roles = spark.createDataFrame([("a", "fit"), ("b", "fit"), ("b", "test")], "run string, role string")
    assert {(r.run, r.problem) for r in splits.roles_of_runs(runs, roles, "run").collect()} == {("a", None), ("b", "several roles"), ("c", "no role")}


def test_contract_roll_up(spark):
    g = spark.createDataFrame([(1, True, False, None)], "id int, a boolean, b boolean, c boolean")
    r = contracts.roll_up(g, ["id"]).first()
    assert r.failed == "b,c" and not r.passed


def test_robust_functions_on_empty_rows(spark):
    none = spark.createDataFrame([], "w string, i long, n long, s double")
    assert robust.event_bounds(none, "w", "n").count() == 0
    assert gates.calibrated(none, ["w"], ["i"], "s", F.col("s") < 1, 0.1).count() == 0
    assert robust.threshold(none, ["w"], "s", 0.5).count() == 0


# ---------------------------------------------------------------- folds of constant state


def busy(spark, n):
    """One key that is never silent: an event each 6 seconds, in windows of 10."""
    return spark.range(n).selectExpr("'k' AS k", "id * 6D AS t", "id AS i")


def test_a_key_that_is_never_silent_takes_linear_time(spark):
    def seconds(n):
        began = time.perf_counter()
        e = windows.anchored_windows(busy(spark, n), "k", "t", "i", 10.0)
        first, last = e.agg(F.min("anchor"), F.max("anchor")).first()
        assert first == 0.0 and last == (n - 1) * 6.0 // 10 * 10
        sent = gates.cooldown(busy(spark, n).select("k", "t"), ["k"], "t", 20.0)
        assert sent.count() == -(-n // 4)
        return time.perf_counter() - began

    seconds(1000)
    assert seconds(400_000) < 6 * seconds(200_000) + 2


def test_folds_go_on_across_batches(spark):
    """Keys that end, begin and are null at the edges of small batches."""
    limit = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(limit)
    rng = random.Random(6)
    rows = [(rng.choice(["a", "b", "c", None]), float(rng.randint(0, 900)), i) for i in range(300)]
    want = {}
    for k in ("a", "b", "c", None):
        a = None
        for _, t, i in sorted((r for r in rows if r[0] == k), key=lambda r: (r[1], r[2])):
            a = t if a is None or t - a >= 20 else a + 10 if t - a >= 10 else a
            want[i] = a
    try:
        spark.conf.set(limit, "7")
        e = spark.createDataFrame(rows, "k string, t double, i long")
        assert {r.i: r.anchor for r in windows.anchored_windows(e, "k", "t", "i", 10.0).collect()} == want
    finally:
        spark.conf.set(limit, before)
    assert windows.anchored_windows(e.limit(0), "k", "t", "i", 10.0).count() == 0


def decided(rows, k=2, near=0.8, behaviour_floor=0.5, warning_floor=0.4, quiet=3):
    """The decision chain as a loop over (skip, calibrating, gate, score, limit, extreme, warned)."""
    hard = behaviour = volume = 0
    sent, out = None, []
    for t, (skip, calibrating, gate, score, limit, extreme, warned) in enumerate(rows):
        path = None
        if skip:
            hard = behaviour = volume = 0
            out.append((skip, None))
            continue
        if calibrating:
            out.append(("calibrating", None))
            continue
        if not gate:
            hard = behaviour = 0
            volume = volume + 1 if score >= limit and extreme else 0
            if volume == 0:
                out.append(("behavior_gated" if score >= limit else "normal", None))
                continue
            path, sure = "extreme_volume_ml", volume >= k
        else:
            volume = 0
            if score >= limit:
                hard, path = hard + 1, "hard_ml"
            elif hard == 1 and score >= near * limit:
                hard, path = k, "hysteresis_ml"
            else:
                hard = 0
            behaviour = behaviour + 1 if behaviour_floor < limit and score >= behaviour_floor else 0
            sure = hard >= k
            if not sure and warned and warning_floor < limit and score >= warning_floor:
                sure, path = True, "fast_path_behavior_ml_floor"
            if not sure and behaviour >= k:
                sure, path = True, "behavior_persistence_ml_floor"
        if not sure:
            out.append(("pending_confirmation", path))
        elif sent is not None and t - sent < quiet:
            out.append(("cooldown", path))
        else:
            sent = t
            out.append(("detection", path))
    return out


def test_decisions_like_a_loop(spark):
    rng = random.Random(8)
    rows = [(rng.choice([None] * 9 + ["low_event_skip"]), rng.random() < 0.1, rng.random() < 0.6, rng.random(), rng.choice([0.5, 0.6, 0.7]), rng.random() < 0.5, rng.random() < 0.3) for _ in range(600)]
    d = spark.createDataFrame([("w", t, *r, 2, 0.8, 0.5, 0.4) for t, r in enumerate(rows)], "w string, t long, skip string, calibrating boolean, gate boolean, score double, score_limit double, extreme boolean, warned boolean, k int, near double, behaviour_floor double, warning_floor double")
    got = [(r.decision, r.path) for r in gates.decisions(d, ["w"], "t", 3).orderBy("t").collect()]
    assert got == decided(rows)
    assert len({x for x, _ in got}) == 7 and len({x for _, x in got}) == 6


def test_agents_like_a_loop(spark):
    rng = random.Random(9)
    rows = [(a, i, float(i), rng.random() ** 2) for i in range(400) for a in "ab"]
    want = {}
    for a in "ab":
        scores, pending, last = [], 0, None
        for _, i, t, s in (r for r in rows if r[0] == a):
            x = np.array(scores[-120:])
            limit = 0.3 if len(x) < 10 else max(0.3, np.quantile(x[x >= np.quantile(x, 0.9)], 0.995) + 0.25)
            if s < limit:
                pending, label = 0, "normal"
                scores.append(s)
            else:
                pending += 1
                label = "pending" if pending < 2 else "cooldown" if last is not None and t - last < 3 else "alert"
                if label == "alert":
                    pending, last = 0, t
            want[a, i] = (label, pytest.approx(limit))
    d = spark.createDataFrame(rows, "a string, i long, t double, s double")
    got = {(r.a, r.i): (r.decision, r.limit_now) for r in gates.agent_decisions(d, "a", ["i"], "s", "t", minimum=0.3).collect()}
    assert got == want and len({label for label, _ in got.values()}) >= 2


def test_greedy_attribution_like_a_loop(spark):
    rng = random.Random(10)
    alerts = [(rng.choice("pq"), 1000 + i, float(rng.randint(0, 300))) for i in range(80)]
    markers = [(rng.choice("pq"), i, float(rng.randint(0, 300))) for i in range(60)]
    want = set()
    for k in "pq":
        free = []
        for t, side, i in sorted([(t, 1, i) for a, i, t in alerts if a == k] + [(t, 0, i) for a, i, t in markers if a == k]):
            if side == 0:
                free.append((t, i))
            elif near := [f for f in free if t - f[0] <= 15]:
                free.remove(near[-1])
                want.add((k, i, near[-1][1]))
    a, m = spark.createDataFrame(alerts, "pod string, alert_id long, at double"), spark.createDataFrame(markers, "pod string, marker_id long, marked double")
    assert {tuple(r) for r in joins.attribute_greedily(a, m, "pod", 15.0).collect()} == want


# ---------------------------------------------------------------- quantiles and models


def test_counted_quantiles_like_numpy(spark):
    rng = random.Random(11)
    values = {"a": [rng.gauss(0, 1) for _ in range(500)], "b": [7.0] * 30, "c": [rng.choice([1.0, 2.0, 1e6]) for _ in range(77)], "d": [3.5]}
    d = spark.createDataFrame([(k, v) for k, x in values.items() for v in x] + [("a", None)], "k string, v double")
    qs = {"low": 0.0, "med": 0.5, "high": 0.995, "top": 1.0}
    for r in robust.counted_quantiles(d, ["k"], "v", qs).collect():
        assert r.n == len(values[r.k]) and [r[n] for n in qs] == pytest.approx([np.quantile(values[r.k], q) for q in qs.values()])
    r = robust.counted_quantiles(d, [], "v", qs).first()
    assert [r[n] for n in qs] == pytest.approx([np.quantile(sum(values.values(), []), q) for q in qs.values()])
    one, two = (robust.median_and_mad(d, ["k"], "v", {"top": 0.9}, large=x).orderBy("k").collect() for x in (False, True))
    assert [(r.k, r.n, r.med, r.top, r.mad) for r in one] == [(r.k, r.n, pytest.approx(r.med), pytest.approx(r.top), pytest.approx(r.mad)) for r in two]


def test_conformal_like_counting(spark):
    rng = random.Random(13)
    cal = [(k, round(rng.random(), 2)) for k in "ab" for _ in range(60)]
    new = [(i, k, round(rng.random() * 1.4 - 0.2, 2)) for i, k in enumerate("ab" * 50)]
    c, s = spark.createDataFrame(cal, "k string, s double"), spark.createDataFrame(new, "i long, k string, s double")
    for r in models.conformal(s, c, ["k"], "s", 0.05).collect():
        assert r.p == pytest.approx((sum(x >= r.s for k, x in cal if k == r.k) + 1) / 61) and r.anomalous == (r.p <= 0.05)


def test_pareto_limits_on_a_known_tail(spark):
    """Exponential scores: the tail's quantile is known."""
    rng = np.random.default_rng(1)
    x = rng.exponential(0.05, 4000)
    d = spark.createDataFrame([("w", float(v)) for v in x], "w string, s double")
    r = robust.pareto_threshold(d, "w", "s", 0.1).first()
    mad = np.median(np.abs(x - np.median(x)))
    assert r.method == "pareto" and r.limit == pytest.approx(-0.05 * np.log(0.005) + 0.5 * mad, rel=0.12)
    shape, scale = robust.fit_pareto(np.sort(rng.exponential(2.0, 5000)))
    assert abs(shape) < 0.06 and scale == pytest.approx(2.0, rel=0.08)


def test_components_like_numpy(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(3, 6))
    x = {k: rng.normal(size=(50, 3)) @ base + rng.normal(scale=0.1, size=(50, 6)) for k in ("a", "b")}
    d = spark.createDataFrame([(k, 100 * j + i, v.tolist()) for j, (k, m) in enumerate(x.items()) for i, v in enumerate(m)], "k string, i long, v array<double>")
    got = {r.i: r.error for r in models.reconstruction_error(d, models.fit_components(d, "k", "v", 3), "k", "i", "v").collect()}
    for j, m in enumerate(x.values()):
        c = m - m.mean(axis=0)
        _, _, vt = np.linalg.svd(c, full_matrices=False)
        error = ((c - c @ vt[:3].T @ vt[:3]) ** 2).mean(axis=1)
        assert [got[100 * j + i] for i in range(50)] == pytest.approx(error.tolist(), abs=1e-9)


def test_isolated_rows_stand_out(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 4))
    x[0] = 9.0
    d = spark.createDataFrame([("a", i, v.tolist()) for i, v in enumerate(x)] + [("b", 900 + i, [0.0, 0.0, 0.0, 0.0]) for i in range(5)], "k string, i long, v array<double>")
    got = {r.i: r.isolation for r in models.isolation_scores(d, "k", "i", "v").collect()}
    assert len(got) == 305 and max((s, i) for i, s in got.items() if i < 900)[1] == 0 and got[0] > 0.6
    assert len({got[900 + i] for i in range(5)}) == 1


def test_corrupted_rows_are_told_from_real_ones(spark):
    rng = np.random.default_rng(4)
    z = rng.normal(size=(400, 1))
    x = z + rng.normal(scale=0.05, size=(400, 6))
    d = spark.createDataFrame([("w", i, v.tolist()) for i, v in enumerate(x)], "w string, i long, v array<double>")
    examples = models.corrupted(d, ["w"], "i", "v").cache()
    real, bad = ({r.i: r.features for r in examples.filter(f"label = {n}").collect()} for n in (0, 1))
    assert real == {i: pytest.approx(v.tolist()) for i, v in enumerate(x)} and set(bad) == set(real)
    changed = np.mean([a != b for i in real for a, b in zip(real[i], bad[i])])
    assert 0.15 < changed < 0.30
    from pyspark.ml.functions import array_to_vector, vector_to_array

    model = models.corruption_classifier(examples.filter("i % 4 <> 0"))
    scored = model.transform(examples.filter("i % 4 = 0").withColumn("x", array_to_vector("features"))).select("label", vector_to_array("probability")[1].alias("p")).collect()
    good, wrong = [r.p for r in scored if r.label == 0], [r.p for r in scored if r.label == 1]
    assert np.mean([a < b for a in good for b in wrong]) > 0.7
    every = models.corruption_scores(examples, "i").collect()
    good, wrong = ({r.i: r.score for r in every if r.label == n} for n in (0, 1))
    assert set(good) == set(wrong) == set(real) and len(every) == 800
    assert np.mean([a < b for a in good.values() for b in wrong.values()]) > 0.7


# ---------------------------------------------------------------- resources and sources


def test_resources_at_any_depth(spark):
    from tracewright.plans.identity import parse_agent_messages

    payloads = [
        '{"method":"tools/call","params":{"tool":"kubectl_delete","arguments":{"a":[{"PATH":{"x":["/etc",3,true,null]}}],"b":"c"}}}',
        '{"method":"tools/call","params":{"name":"","tool_name":"look","q":{"deep":[{"host":"db-secret-1"}]}}}',
        '[3, {"method":"ping"}, {"id":1}, {"method":""}, {"method":"tool/call","params":{"name":"x"}}, "y"]',
        "nothing", None, "[]", '{"method":"m","params":"text"}',
    ]
    m = spark.createDataFrame(list(enumerate(payloads)), "i long, payload string")
    got = {(r.i, r.method): r for r in parse_agent_messages(m).collect()}
    assert set(got) == {(0, "tools/call"), (1, "tools/call"), (2, "ping"), (2, "tool/call"), (6, "m")}
    digests = lambda *v: sorted(hashlib.sha256(x.encode()).hexdigest()[:16] for x in v)
    a, b = got[0, "tools/call"], got[1, "tools/call"]
    assert (a.tool, a.resources, a.high_risk) == ("kubectl_delete", digests("/etc", "3", "True"), True)
    assert (b.tool, b.resources, b.high_risk) == ("look", digests("db-secret-1"), True)
    assert got[2, "tool/call"].tool == "x" and got[2, "ping"].tool == "ping" and not got[6, "m"].high_risk and a.raw_bytes == len(payloads[0])


def test_the_same_capture_twice_is_an_error(spark):
    from tracewright.sources import files

    a = spark.createDataFrame([(1, "start", 1), (2, "end", 2)], "t long, kind string, line long")
    with pytest.raises(ValueError, match="same rows"):
        files.merged({"a": a, "b": a.orderBy(F.desc("t"))}, "t", "kind", ["start", "end"], "line")
    both = files.merged({"a": a, "b": a.withColumn("t", F.col("t") - 1)}, "t", "kind", ["start", "end"], "line").collect()
    assert [(r.t, r.kind) for r in both] == [(0, "start"), (1, "start"), (1, "end"), (2, "end")]


def test_phases_between_valid_rows(spark):
    bad = spark.createDataFrame([("a", None, 5), ("b", 11, 19), ("c", 20, None), ("d", 31, 39), ("e", None, None)], "k string, after_t long, before_t long")
    phases = spark.createDataFrame([(0, 10), (20, 30)], "started long, stopped long")
    assert {r.k: r.touches_phase for r in joins.touches_phase(bad, phases, 7).collect()} == {"a": True, "b": False, "c": True, "d": False, "e": True}


# ---------------------------------------------------------------- dyadic cells


def test_cells_tile_an_interval(spark):
    rng = random.Random(8)
    spans = [(a, a + rng.choice([0, 1, 5, 37, 4000, 10**6])) for a in (rng.randint(-5000, 5000) for _ in range(200))]
    for r in spark.createDataFrame(spans, "s long, e long").select("s", "e", joins.cells(F.col("s"), F.col("e"), 1.0).alias("c")).collect():
        covered = sorted((c.cell << c.level, (c.cell + 1) << c.level) for c in r.c)
        assert covered[0][0] == r.s and covered[-1][1] == r.e + 1 and all(a[1] == b[0] for a, b in zip(covered, covered[1:]))
        assert len(covered) <= 2 * (r.e + 1 - r.s).bit_length()


def test_overlaps_and_points_of_long_and_short_intervals(spark):
    rng = random.Random(4)
    some = lambda n, *names: [(f"k{rng.randint(0, 2)}", i, s := rng.randint(-300, 3000), s + rng.choice([0, 1, 9, 400, 2500])) for i in range(n)]  # noqa: E731, F841
    left, right = some(120), some(90)
    l = spark.createDataFrame(left, "k string, i long, began long, ended long")  # noqa: E741
    r = spark.createDataFrame(right, "k string, j long, started long, stopped long")
    for width in (10.0, 700.0):
        got = sorted((x.i, x.j) for x in joins.overlaps(l, r, ["k"], width).collect())
        assert got == sorted((i, j) for k, i, b, e in left for m, j, s, t in right if k == m and b < t and s < e)
        held = Counter((x.i, x.j) for x in joins.contained(l, r, ["k"], width).collect())
        inside = {(i, j) for k, i, b, e in left for m, j, s, t in right if k == m and s <= b and e <= t}
        assert held == Counter([*inside, *((i, None) for _, i, _, _ in left if not any(i == a for a, _ in inside))])


def test_draws_are_those_of_md5(spark):
    slots = np.arange(20_000).astype("S8")
    for iteration in (0, 9999):
        want = [int(hashlib.md5(f"15|{iteration}|{k}".encode()).hexdigest()[:8], 16) % len(slots) for k in range(len(slots))]
        assert outcomes._drawn_numbers(15, iteration, slots).tolist() == want
    column = outcomes.drawn(15, F.lit(9999), F.col("id"), F.lit(20_000))
    assert [r.k for r in spark.range(50).select("id", column.alias("k")).orderBy("id").collect()] == want[:50]


def test_draws_of_thousands_of_blocks_are_not_joined(spark):
    """A group of 6000 blocks, as suppliers at 60 times sf0.1 have, is drawn from where its array is; its rows are not shuffled."""
    blocks = spark.range(6000).select(F.lit("g").alias("g"), F.col("id").alias("block"), (F.col("id") % 997).cast("double").alias("v"))
    rows = outcomes.bootstrap(blocks, ["g"], {"mid": ("median", "v")}, 3, 3)
    assert "Join" not in rows._jdf.queryExecution().executedPlan().toString().split("MapInArrow")[0]
    k = outcomes._drawn_numbers(3, 2, np.arange(6000).astype("S8"))
    assert {r.iter: r.mid for r in rows.collect()}[2] == np.median(k % 997) and rows.count() == 3


def test_bootstraps_of_few_and_many_blocks_draw_alike(spark):
    rng = random.Random(6)
    rows = [(g, b, rng.randint(0, 9), None if rng.random() < 0.1 else rng.random()) for g, n in (("a", 7), ("b", 40), ("c", 1)) for b in range(n)]
    blocks = spark.createDataFrame(rows, "g string, block int, hits int, v double")
    asked = {"hits": ("sum", "hits"), "mid": ("median", "v")}
    runs = [{(r.g, r.iter): (r.hits, None if r.mid is None else round(r.mid, 12)) for r in outcomes.bootstrap(blocks, ["g"], asked, 50, 3, most=most).collect()} for most in (100, 10, 0)]
    assert runs[0] == runs[1] == runs[2] and len(runs[0]) == 150


def test_pareto_sums_of_parts_fit_as_the_whole(spark, monkeypatch):
    rng = np.random.default_rng(12)
    rows = [("a", float(v)) for v in rng.pareto(4, 3000)] + [("b", float(v)) for v in rng.exponential(1, 900)] + [("few", 0.5)] * 4 + [("flat", 0.25)] * 60
    d = spark.createDataFrame(rows, "k string, score double").repartition(5)
    for most in (1, 1000):
        monkeypatch.setattr(robust, "KEPT_KEYS", most)
        got = {r.k: (r.limit, r.method) for r in robust.pareto_threshold(d, "k", "score", 0.1).collect()}
        for k in "ab":
            x = np.array([v for g, v in rows if g == k])
            u, mad = np.quantile(x, 0.9), np.median(np.abs(x - np.median(x)))
            excess = np.sort(x[x > u] - u)
            shape, scale = robust.fit_pareto(excess)
            rest = 0.005 / (len(excess) / len(x))
            want = min(max(u + scale / shape * (rest**-shape - 1) + 0.5 * max(mad, 1e-3), 0.1), 0.995)
            assert got[k][1] == "pareto" and got[k][0] == pytest.approx(want, abs=1e-4)
        assert "flat" not in got and got.get("few", (None, "empirical")) == (None, "empirical")
