"""Streams in several micro-batches give what the batch forms give."""

import random

from tracewright.operators import gates
from tracewright.streaming import stateful


def write_files(spark, rows, schema, path, n):
    """Files one after the other, so that their order is that of time."""
    step = -(-len(rows) // n)
    for k in range(n):
        spark.createDataFrame(rows[k * step : (k + 1) * step], schema).coalesce(1).write.mode("append").json(path)


def test_cooldown_stream_like_batch(spark, tmp_path):
    rng = random.Random(7)
    rows = sorted((rng.choice("abc"), rng.randint(0, 500)) for _ in range(90))
    rows.sort(key=lambda r: r[1])
    schema = "pod string, t long"
    write_files(spark, rows, schema, str(tmp_path / "in"), 3)
    stream = stateful.tail(spark, str(tmp_path / "in"), spark.createDataFrame([], schema).schema, files_per_trigger=1)
    got = sorted(map(tuple, stateful.run(stateful.cooldown(stream, "pod", "t", 30), str(tmp_path / "out")).collect()))
    batch = gates.cooldown(spark.createDataFrame(rows, schema), ["pod"], "t", 30).distinct()
    assert got == sorted(map(tuple, batch.collect()))


def test_anchored_stream_keeps_its_state(spark, tmp_path):
    rows = [("p", t) for t in (1000, 1029, 1030, 1061, 1300, 1301)]
    schema = "pod string, t long"
    write_files(spark, rows, schema, str(tmp_path / "in"), 3)
    stream = stateful.tail(spark, str(tmp_path / "in"), spark.createDataFrame([], schema).schema, files_per_trigger=1)
    got = sorted(map(tuple, stateful.run(stateful.anchored_windows(stream, "pod", "t", 30), str(tmp_path / "out")).collect()))
    assert got == [("p", 1000, 2), ("p", 1030, 1), ("p", 1060, 1)]


def test_idle_key_is_flushed(spark, tmp_path):
    schema = "pod string, t long"
    write_files(spark, [("p", 1), ("p", 2)], schema, str(tmp_path / "in"), 1)
    stream = stateful.tail(spark, str(tmp_path / "in"), spark.createDataFrame([], schema).schema)
    with stateful.rocks_state(spark):
        q = stateful.anchored_windows(stream, "pod", "t", 30, idle_ms=500).writeStream.format("memory").queryName("flushed").outputMode("append").trigger(processingTime="300 milliseconds").start()
    try:
        for _ in range(120):
            q.awaitTermination(0.5)
            if spark.table("flushed").count():
                break
        assert [tuple(r) for r in spark.table("flushed").collect()] == [("p", 1, 2)]
    finally:
        q.stop()


def stream_of(spark, path, schema, files=1):
    return stateful.tail(spark, str(path), spark.createDataFrame([], schema).schema, files)


def test_idle_windows_do_not_depend_on_where_batches_end(spark, tmp_path):
    rng = random.Random(3)
    rows = [(rng.choice("abc"), 1_000_000 * t) for t in sorted(rng.randint(0, 3000) for _ in range(150))]
    schema, second = "pod string, t long", 1_000_000
    got = []
    for n in (1, 5):
        write_files(spark, rows, schema, str(tmp_path / f"in{n}"), n)
        windows = stateful.anchored_windows(stream_of(spark, tmp_path / f"in{n}", schema), "pod", "t", 60 * second, idle=60 * second)
        got.append(sorted(map(tuple, stateful.run(windows, str(tmp_path / f"out{n}")).collect())))
    want = []
    for pod in "abc":
        anchor, last, n = None, 0, 0
        for t in [t for p, t in rows if p == pod]:
            nxt = t if anchor is None or t - last >= 60 * second or t - anchor >= 120 * second else anchor + 60 * second if t - anchor >= 60 * second else anchor
            if nxt != anchor and n:
                want.append((pod, anchor, n))
                n = 0
            anchor, last, n = nxt, t, n + 1
        if last + 60 * second < rows[-1][1]:
            want.append((pod, anchor, n))
    assert got[0] == got[1] == sorted(want)


def test_agents_go_on_after_a_restart(spark, tmp_path):
    rng = random.Random(9)
    rows = [(i, rng.choice("ab"), float(i), rng.random() ** 4) for i in range(400)]
    schema = "id long, agent string, t double, score double"
    write_files(spark, rows[:200], schema, str(tmp_path / "in"), 2)
    decide = lambda: sorted((r.id, r.decision, round(r.limit_now, 9)) for r in stateful.run(stateful.agent_decisions(stream_of(spark, tmp_path / "in", schema), "agent", "t", "id", "score"), str(tmp_path / "out")).collect())
    assert len(decide()) == 200
    write_files(spark, rows[200:], schema, str(tmp_path / "in"), 2)
    batch = gates.agent_decisions(spark.createDataFrame(rows, schema), "agent", ["id"], "score", "t")
    assert decide() == sorted((r.id, r.decision, round(r.limit_now, 9)) for r in batch.collect())


def test_late_rows_are_marked_and_counted(spark, tmp_path):
    rng = random.Random(2)
    rows = [(i, rng.choice("ab"), i, i + rng.choice([0, 0, -9, 3])) for i in range(120)]
    schema = "id long, pod string, arrived long, t long"
    write_files(spark, rows, schema, str(tmp_path / "in"), 3)
    marked = stateful.run(stateful.mark_late(stream_of(spark, tmp_path / "in", schema), "pod", "t", "arrived", "id"), str(tmp_path / "out"))
    newest, late, want = {}, {"a": 0, "b": 0}, []
    for i, pod, _, t in rows:
        behind = pod in newest and t <= newest[pod]
        late[pod] += behind
        newest[pod] = max(t, newest.get(pod, t))
        want.append((pod, i, t, behind, late[pod]))
    assert sorted(map(tuple, marked.collect())) == sorted(want)
    assert {r.pod: (r.n_late, r.newest) for r in stateful.late_by_key(marked, "pod", "t").collect()} == {p: (late[p], newest[p]) for p in "ab"}


def test_windows_of_many_keys_share_buckets(spark, tmp_path, monkeypatch):
    """State rows are those of the buckets, not of the keys; a bucket's timer hands on only the keys that are silent."""
    monkeypatch.setattr(stateful, "KEY_BUCKETS", 3)
    second, schema = 1_000_000, "pod long, t long"
    rows = [(p, (1000 + t) * second) for p in range(60) for t in (p, p + 20, p + 90)] + [(None, 1005 * second), (7, 1400 * second)]
    write_files(spark, sorted(rows, key=lambda r: r[1]), schema, str(tmp_path / "in"), 4)
    windows = stateful.anchored_windows(stream_of(spark, tmp_path / "in", schema), "pod", "t", 60 * second, idle=60 * second, delay="10 seconds")
    with stateful.rocks_state(spark):
        q = windows.writeStream.format("memory").queryName("bucketed").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert max(p.stateOperators[0].numRowsTotal for p in q.recentProgress) <= 3
    want = [(p, (1000 + s) * second, n) for p in range(60) for s, n in ((p, 2), (p + 90, 1))] + [(None, 1005 * second, 1)]
    assert sorted(map(tuple, spark.table("bucketed").collect()), key=repr) == sorted(want, key=repr)
