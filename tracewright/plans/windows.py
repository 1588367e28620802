"""Queries on windows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tracewright.operators import windows as O
from tracewright.registry import query
from tracewright.sources.tables import EV, events, table

HOUR = 3600


def _counters(spark, sf_dir):
    """Running counts by pod, call and day; every tenth day the counter starts anew."""
    e = events(spark, sf_dir).withColumn("day", F.floor(F.col("us") / 86400000000).cast("long"))
    # dealt once by source and counter, which serves this window and those over the counters
    daily = e.groupBy("pod", "syscall", "day").agg(F.count("*").alias("n")).repartition("pod", "syscall")
    w = Window.partitionBy("pod", "syscall", F.floor(F.col("day") / 10)).orderBy("day")
    return daily.select("pod", "syscall", "day", F.sum("n").over(w).alias("total"))


COUNTERS_SQL = f"""{EV}, daily AS (SELECT pod, syscall, CAST(floor(us / 86400000000) AS BIGINT) AS day, count(*) AS n FROM ev GROUP BY ALL),
  counters AS (SELECT pod, syscall, day, CAST(sum(n) OVER (PARTITION BY pod, syscall, CAST(floor(day / 10) AS BIGINT) ORDER BY day) AS BIGINT) AS total FROM daily),
  deltas AS (SELECT pod, syscall, day, CASE WHEN total >= b THEN total - b ELSE total END AS delta FROM
    (SELECT *, lag(total) OVER (PARTITION BY pod, syscall ORDER BY day) AS b FROM counters) WHERE b IS NOT NULL)"""


@query(
    "w1_anchored_windows",
    f"""WITH RECURSIVE {EV}, o AS (SELECT *, row_number() OVER (PARTITION BY workload ORDER BY us, event_id) AS k FROM ev),
    f AS (SELECT workload, k, event_id, t, t AS anchor FROM o WHERE k = 1
      UNION ALL SELECT o.workload, o.k, o.event_id, o.t, CASE WHEN o.t - f.anchor >= 43200 THEN o.t WHEN o.t - f.anchor >= 21600 THEN f.anchor + 21600 ELSE f.anchor END
      FROM f JOIN o ON o.workload = f.workload AND o.k = f.k + 1)
    SELECT workload, round(anchor, 6) AS window_start, count(*) AS n, min(event_id) AS first_event FROM f GROUP BY ALL""",
)
def w1(spark, sf_dir):
    e = O.anchored_windows(events(spark, sf_dir), "workload", "t", "event_id", 6.0 * HOUR)
    return e.groupBy("workload", F.round("anchor", 6).alias("window_start")).agg(F.count("*").alias("n"), F.min("event_id").alias("first_event"))


@query("w2_aligned_windows", f"WITH {EV} SELECT workload, CAST(floor(us / 21600000000) AS BIGINT) AS win, count(*) AS n, round(sum(value), 6) AS total FROM ev GROUP BY ALL")
def w2(spark, sf_dir):
    return O.aligned_windows(events(spark, sf_dir), "us", 6 * HOUR).groupBy("workload", "win").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))


@query("w5_counter_deltas", f"WITH {COUNTERS_SQL} SELECT pod, syscall, day, delta FROM deltas")
def w5(spark, sf_dir):
    return O.counter_deltas(_counters(spark, sf_dir), ["pod"], ["syscall"], "day", "total").select("pod", "syscall", "day", "delta")


@query(
    "w6_rolling_rates",
    f"""WITH {COUNTERS_SQL} SELECT pod, syscall, day, round(coalesce(avg(delta) OVER w, delta), 6) AS mean, round(coalesce(stddev_pop(delta) OVER w, 0), 6) AS std
    FROM deltas WINDOW w AS (PARTITION BY pod, syscall ORDER BY day ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)""",
)
def w6(spark, sf_dir):
    d = O.counter_deltas(_counters(spark, sf_dir), ["pod"], ["syscall"], "day", "total")
    return O.rolling_rate(d, ["pod", "syscall"], ["day"], "delta", 5).select("pod", "syscall", "day", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@query(
    "w7_newest_events",
    f"""WITH {EV}, w AS (SELECT a.event_id, a.pod, b.value, row_number() OVER (PARTITION BY a.event_id ORDER BY b.us DESC, b.event_id DESC) AS k FROM ev a JOIN ev b ON b.pod = a.pod AND b.us >= a.us - 86400000000 AND (b.us, b.event_id) <= (a.us, a.event_id))
    SELECT event_id, pod, count(*) AS held, round(sum(value), 5) AS held_total FROM w WHERE k <= 5 GROUP BY ALL""",
)
def w7_newest(spark, sf_dir):
    """What the newest five events of the last day add up to."""
    e = O.sliding_count(events(spark, sf_dir), "pod", "us", "event_id", 24 * HOUR * 1_000_000, 5, "value")
    return e.select("event_id", "pod", F.col("events_total").alias("held"), F.round("held_total", 5).alias("held_total"))


@query(
    "w7_sliding_windows",
    f"""WITH {EV} SELECT event_id, pod, least(CAST(count(*) OVER (PARTITION BY pod ORDER BY us RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW) AS BIGINT), 5) AS events_total FROM ev""",
)
def w7(spark, sf_dir):
    return O.sliding_count(events(spark, sf_dir), "pod", "us", "event_id", 24 * HOUR * 1_000_000, 5).select("event_id", "pod", "events_total")


def _vectors(spark, sf_dir):
    """Embeddings as feature rows of ten workloads, one second apart, with gaps and changing regimes."""
    v = table(spark, sf_dir, "embeddings")
    k = F.col("vec_id")
    return v.select(k.alias("row"), F.col("label").alias("workload"), (k * 1.0 + F.floor(k / 100) * 60).alias("ended"), F.when(k % 200 < 180, F.floor(k / 50) % 3).alias("regime"), F.slice("embedding", 1, 3).alias("vec")).withColumn("began", F.col("ended") - 1)


VECTORS_SQL = """v AS (SELECT vec_id AS row, label AS workload, vec_id * 1.0 + floor(vec_id / 100) * 60 AS ended, CASE WHEN vec_id % 200 < 180 THEN floor(vec_id / 50) % 3 END AS regime, embedding FROM embeddings),
  s AS (SELECT *, CAST(sum(CASE WHEN ended - 1 - pe > 50 OR regime <> pr THEN 1 ELSE 0 END) OVER (PARTITION BY workload ORDER BY ended) AS BIGINT) AS segment FROM
    (SELECT *, lag(ended) OVER (PARTITION BY workload ORDER BY ended) AS pe, lag(regime) OVER (PARTITION BY workload ORDER BY ended) AS pr FROM v))"""


def segmented(spark, sf_dir):
    return O.segments(_vectors(spark, sf_dir), ["workload"], "began", "ended", 20.0, "regime")


@query("w8_segments", f"WITH {VECTORS_SQL} SELECT row, workload, segment FROM s")
def w8(spark, sf_dir):
    return segmented(spark, sf_dir).select("row", "workload", "segment")


@query(
    "w9_warm_up",
    f"""WITH {VECTORS_SQL} SELECT row, CASE WHEN row_number() OVER (PARTITION BY workload, segment ORDER BY ended) <= 2 THEN 'warming' ELSE 'ready' END AS status,
    coalesce(CASE WHEN ended - 1 - pe > 50 THEN 'temporal_gap' WHEN regime <> pr THEN 'traffic_regime_change' END, '') AS reset FROM s""",
)
def w9(spark, sf_dir):
    h = O.history(segmented(spark, sf_dir), ["workload"], "ended", 2, "vec", "began", 20.0, "regime")
    return h.select("row", "status", F.coalesce("reset", F.lit("")).alias("reset"))


@query(
    "w10_out_of_order",
    f"""WITH {EV}, a AS (SELECT event_id, pod, us, lag(us) OVER (PARTITION BY pod ORDER BY (event_id * 7919) % 100003, event_id) AS b FROM ev) SELECT event_id, pod FROM a WHERE us <= b""",
)
def w10(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("arrival", F.col("event_id") * 7919 % 100003)
    return O.not_increasing(e, ["pod"], ["arrival", "event_id"], "us").select("event_id", "pod")


@query(
    "w11_lagged_examples",
    f"""WITH {VECTORS_SQL}, h AS (SELECT *, row_number() OVER q AS k, lag(embedding, 2) OVER q AS b2, lag(embedding, 1) OVER q AS b1 FROM s WINDOW q AS (PARTITION BY workload, segment ORDER BY ended))
    SELECT row, CAST(i - 1 AS INT) AS i, round(CAST(list_extract(list_concat(b2[1:3], b1[1:3], embedding[1:3]), CAST(i AS INT)) AS DOUBLE), 6) AS x FROM h, unnest(generate_series(1, 9)) AS g(i) WHERE k > 2""",
)
def w11(spark, sf_dir):
    h = O.history(segmented(spark, sf_dir), ["workload"], "ended", 2, "vec").filter("status = 'ready'")
    return h.select("row", F.posexplode(F.concat("past", "vec")).alias("i", "x")).select("row", "i", F.round(F.col("x").cast("double"), 6).alias("x"))


@query("w12_trailing_slice", f"WITH {EV} SELECT event_id, workload FROM ev WHERE us >= (SELECT max(us) FROM ev) - 86400000000")
def w12(spark, sf_dir):
    return O.trailing(events(spark, sf_dir), "us", 24 * HOUR * 1_000_000).select("event_id", "workload")


@query(
    "w13_bounded_transitions",
    f"""WITH {EV}, g AS (SELECT workload, syscall, lag(syscall) OVER w AS before, us - lag(us) OVER w AS gap FROM ev WINDOW w AS (PARTITION BY pod ORDER BY us, event_id))
    SELECT workload, before, syscall, count(*) AS n FROM g WHERE before IS NOT NULL AND gap <= 21600000000 GROUP BY ALL""",
)
def w13(spark, sf_dir):
    t = O.transitions(events(spark, sf_dir), ["pod"], ["us", "event_id"], "syscall", "us", 6 * HOUR * 1_000_000)
    return t.groupBy("workload", "before", "syscall").agg(F.count("*").alias("n"))


@query(
    "w14_wall_clock",
    f"""WITH {EV}, f AS (SELECT workload, min(event_id) AS m0, arg_min(us, event_id) AS w0 FROM ev GROUP BY workload) SELECT event_id, w0 + event_id - m0 AS at FROM ev JOIN f USING (workload)""",
)
def w14(spark, sf_dir):
    return O.wall_clock(events(spark, sf_dir), "workload", "event_id", "us").select("event_id", "at")
