"""Queries on order, splits and sampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewright.operators import splits as R
from tracewright.registry import query
from tracewright.sources.tables import EV, days, events, table


@query(
    "r1_consecutive_pairs",
    f"""WITH {EV}, x AS (SELECT workload, value > 60 AS f, lead(value > 60) OVER (PARTITION BY workload ORDER BY us, event_id) AS n FROM ev) SELECT workload, count(*) FILTER (f AND n) AS pairs FROM x GROUP BY workload""",
)
def r1(spark, sf_dir):
    return R.consecutive_pairs(events(spark, sf_dir), ["workload"], ["us", "event_id"], F.col("value") > 60)


def spans(spark, sf_dir):
    e = events(spark, sf_dir)
    return e.select("event_id", "pod", F.col("us").alias("began"), (F.col("us") + (F.col("event_id") % 10 + 1) * 3_600_000_000).alias("ended"))


SP = f"{EV}, sp AS (SELECT event_id, pod, us AS began, us + (event_id % 10 + 1) * 3600000000 AS ended FROM ev)"


@query("r2_overlapping_windows", f"WITH {SP}, x AS (SELECT *, max(ended) OVER (PARTITION BY pod ORDER BY began, ended ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS e FROM sp) SELECT event_id, pod FROM x WHERE e > began")
def r2(spark, sf_dir):
    return R.overlapping(spans(spark, sf_dir), ["pod"], "began", "ended").select("event_id", "pod")


@query(
    "r3_largest_gaps",
    f"""WITH {EV}, x AS (SELECT pod, us, us - lag(us) OVER (PARTITION BY pod ORDER BY us) AS g FROM ev) SELECT pod, greatest(max(g), min(us) - 1704067200000000, 1706745600000000 - max(us)) AS max_gap FROM x GROUP BY pod""",
)
def r3(spark, sf_dir):
    return R.largest_gap(events(spark, sf_dir), ["pod"], "us", F.lit(1704067200000000), F.lit(1706745600000000))


@query(
    "r3_stable_counters",
    f"""WITH {EV}, c AS (SELECT pod, us // 864000000000 - 1972 AS restarts, pod % 4 - 1 AS build, CASE WHEN pod % 6 = 0 THEN event_id % 2 ELSE 3 END AS drops FROM ev),
    g AS (SELECT pod, min(restarts) AS r0, max(restarts) AS r1, min(build) AS b0, max(build) AS b1, min(drops) AS d0, max(drops) AS d1 FROM c GROUP BY pod)
    SELECT pod, concat_ws(',', CASE WHEN b0 <> b1 OR b0 < 0 THEN 'build' END, CASE WHEN d0 <> d1 OR d0 < 0 THEN 'drops' END, CASE WHEN r0 <> r1 OR r0 < 0 THEN 'restarts' END) AS changed FROM g""",
)
def r3_counters(spark, sf_dir):
    e = events(spark, sf_dir)
    c = e.select("pod", (F.floor(F.col("us") / 864000000000) - 1972).alias("restarts"), (F.col("pod") % 4 - 1).alias("build"), F.when(F.col("pod") % 6 == 0, F.col("event_id") % 2).otherwise(3).alias("drops"))
    return R.stable_counters(c, ["pod"], ["restarts", "build", "drops"])


@query("r4_slowest_rows", f"WITH {EV} SELECT event_id, round(value, 6) AS value FROM ev ORDER BY ev.value DESC, event_id LIMIT 20")
def r4(spark, sf_dir):
    return R.slowest(events(spark, sf_dir), "value", "event_id").select("event_id", F.round("value", 6).alias("value"))


@query(
    "r5_evenly_spaced",
    f"""WITH {EV}, x AS (SELECT event_id, workload, row_number() OVER (PARTITION BY workload ORDER BY us, event_id) - 1 AS r, count(*) OVER (PARTITION BY workload) AS n FROM ev)
    SELECT event_id, workload FROM x WHERE r IN (SELECT CAST(floor(i * (n - 1) / 9) AS BIGINT) FROM generate_series(0, 9) AS g(i))""",
)
def r5(spark, sf_dir):
    return R.evenly_spaced(events(spark, sf_dir).select("event_id", "workload", "us"), ["workload"], ["us", "event_id"], 10).select("event_id", "workload")


HELD = f"""{EV}, z AS (SELECT workload, syscall, count(*) AS n FROM ev GROUP BY ALL), b AS (SELECT *, floor(n * 0.15) AS b, n * 0.15 - floor(n * 0.15) AS rest FROM z),
  m AS (SELECT *, floor(sum(n) OVER (PARTITION BY workload) * 0.15 + 0.5) - sum(b) OVER (PARTITION BY workload) AS more, row_number() OVER (PARTITION BY workload ORDER BY round(rest, 9) DESC, syscall) AS k FROM b),
  hd AS (SELECT workload, syscall, n, greatest(1, least(CAST(b AS BIGINT) + CASE WHEN k <= more THEN 1 ELSE 0 END, n - 1)) AS held FROM m)"""


def held(spark, sf_dir):
    z = events(spark, sf_dir).groupBy("workload", "syscall").agg(F.count("*").alias("n"))
    return R.largest_remainder(z, ["workload"], "syscall", "n", 0.15)


@query("r6_stratified_allocation", f"WITH {HELD} SELECT workload, syscall, n, held FROM hd")
def r6(spark, sf_dir):
    return held(spark, sf_dir)


ROLES = f"""{HELD}, o AS (SELECT event_id, workload, syscall, us, row_number() OVER (PARTITION BY workload, syscall ORDER BY us DESC, event_id DESC) AS r FROM ev),
  rl AS (SELECT event_id, workload, syscall, us, CASE WHEN r <= held THEN 'holdout' ELSE 'fit' END AS role FROM o JOIN hd USING (workload, syscall))"""


def roles(spark, sf_dir):
    return R.hold_out(events(spark, sf_dir).select("event_id", "workload", "syscall", "us"), held(spark, sf_dir), ["workload", "syscall"], ["us", "event_id"])


@query(
    "r7_repaired_split",
    f"""WITH {ROLES}, s AS (SELECT *, us < 1704412800000000 AS s FROM rl), c AS (SELECT *, count(*) FILTER (s AND role = 'holdout') OVER w AS h, count(*) FILTER (s AND role = 'fit') OVER w AS f FROM s WINDOW w AS (PARTITION BY workload, syscall)),
    l AS (SELECT *, CASE WHEN h = 0 AND f >= 2 THEN 'holdout' WHEN f = 0 AND h >= 2 THEN 'fit' END AS lack FROM c),
    k AS (SELECT *, row_number() OVER (PARTITION BY workload, syscall, role ORDER BY CASE WHEN lack IS NOT NULL AND role <> lack AND NOT s THEN 1 ELSE 0 END, us, event_id) AS k FROM l)
    SELECT event_id, CASE WHEN lack IS NOT NULL AND k = 1 THEN CASE WHEN role = 'fit' THEN 'holdout' ELSE 'fit' END ELSE role END AS role FROM k""",
)
def r7(spark, sf_dir):
    return R.repaired(roles(spark, sf_dir), ["workload", "syscall"], ["us", "event_id"], F.col("us") < 1704412800000000).select("event_id", "role")


@query("r8_appended_phases", f"WITH {EV} SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 1 ELSE 0 END AS part FROM ev")
def r8(spark, sf_dir):
    e = events(spark, sf_dir).select("event_id")
    return R.appended(e.filter("event_id % 4 <> 0"), e.filter("event_id % 4 = 0"), "event_id").select("event_id", "part")


@query(
    "r9_run_roles",
    f"""WITH {EV}, r AS (SELECT DISTINCT pod AS run, CASE WHEN pod % 3 = 0 THEN 'fit' ELSE 'test' END AS role FROM ev WHERE pod % 11 <> 5 UNION SELECT DISTINCT pod, 'fit' FROM ev WHERE pod % 13 = 2),
    g AS (SELECT run, count(DISTINCT role) AS n, min(role) AS role FROM r GROUP BY run)
    SELECT run, CASE WHEN n = 1 THEN role END AS role, CASE WHEN n IS NULL THEN 'no role' WHEN n > 1 THEN 'several roles' END AS problem FROM (SELECT DISTINCT pod AS run FROM ev) LEFT JOIN g USING (run)""",
)
def r9(spark, sf_dir):
    runs = events(spark, sf_dir).select(F.col("pod").alias("run"))
    given = runs.filter("run % 11 <> 5").select("run", F.when(F.col("run") % 3 == 0, "fit").otherwise("test").alias("role")).union(runs.filter("run % 13 = 2").select("run", F.lit("fit")))
    return R.roles_of_runs(runs, given, "run")


@query("r10_first_rows", f"WITH {EV} SELECT event_id, workload FROM (SELECT *, row_number() OVER (PARTITION BY workload ORDER BY us, event_id) AS k FROM ev) WHERE k <= 25")
def r10(spark, sf_dir):
    return R.first_rows(events(spark, sf_dir), ["workload"], ["us", "event_id"], 25).select("event_id", "workload")


@query("r11_latest_reports", "SELECT o_custkey, max((CAST(o_orderdate AS DATE) - DATE '1970-01-01', o_orderkey))[2] AS o_orderkey FROM orders GROUP BY o_custkey")
def r11(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", days("o_orderdate").alias("day"), "o_orderkey", "o_totalprice")
    return R.latest(o, ["o_custkey"], ["day", "o_orderkey"]).select("o_custkey", "o_orderkey")
