"""Queries on joins and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewright.operators import joins as J
from tracewright.operators import sets as X
from tracewright.registry import query
from tracewright.sources.tables import EV, days, events, table

HOUR = 3_600_000_000


def injections(spark, sf_dir):
    """(trial, pod, started, stopped): each signup opens an hour."""
    e = events(spark, sf_dir).filter("syscall = 'execve'")
    return e.select(F.col("event_id").alias("trial"), "pod", F.col("us").alias("started"), (F.col("us") + HOUR).alias("stopped"))


def alerts(spark, sf_dir):
    return events(spark, sf_dir).filter("value > 60 and syscall <> 'execve'").select("pod", F.col("event_id").alias("alert_id"), F.col("us").alias("at"))


def day_windows(spark, sf_dir):
    """(win_id, pod, began, ended): six hours from each view."""
    e = events(spark, sf_dir).filter("syscall = 'read'")
    return e.select(F.col("event_id").alias("win_id"), "pod", F.col("us").alias("began"), (F.col("us") + 6 * HOUR).alias("ended"))


INJ = f"""{EV}, inj AS (SELECT event_id AS trial, pod, us AS started, us + {HOUR} AS stopped FROM ev WHERE syscall = 'execve'),
  alr AS (SELECT pod, event_id AS alert_id, us AS seen FROM ev WHERE value > 60 AND syscall <> 'execve'),
  dw AS (SELECT event_id AS win_id, pod, us AS began, us + {6 * HOUR} AS ended FROM ev WHERE syscall = 'read')"""


@query(
    "j1_metadata_join",
    """SELECT o_orderpriority, count(*) AS n, count(*) FILTER (c_custkey IS NULL) AS unresolved FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 7 <> 0) c ON c_custkey = o_custkey GROUP BY o_orderpriority""",
)
def j1(spark, sf_dir):
    c = table(spark, sf_dir, "customer").filter(F.col("c_custkey") % 7 != 0).select("c_custkey")
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderpriority")
    return o.join(c, o["o_custkey"] == c["c_custkey"], "left").groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.count_if(F.col("c_custkey").isNull()).alias("unresolved"))


@query(
    "j2_interval_pairs",
    """WITH r AS (SELECT o_custkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN 'start' ELSE 'end' END AS kind, o_orderkey AS t FROM orders),
    g AS (SELECT id, min(t) FILTER (kind = 'start') AS started, min(t) FILTER (kind = 'end') AS ended, count(*) FILTER (kind = 'start') AS s, count(*) FILTER (kind = 'end') AS e FROM r GROUP BY id)
    SELECT id, started, ended, CASE WHEN s > 1 OR e > 1 THEN 'repeated' WHEN e = 0 THEN 'no end' WHEN s = 0 THEN 'no start' WHEN ended <= started THEN 'empty' END AS problem FROM g""",
)
def j2(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), F.when(F.col("o_orderkey") % 2 == 0, "start").otherwise("end").alias("kind"), F.col("o_orderkey").alias("t"))
    return J.pair_intervals(o, "id", "kind", "t")


@query(
    "j2_consistent_pairs",
    """WITH r AS (SELECT o_custkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN 'start' ELSE 'end' END AS kind, o_orderkey AS t, o_orderpriority AS p, o_orderstatus AS s FROM orders),
    g AS (SELECT id, min(t) FILTER (kind = 'start') AS started, min(t) FILTER (kind = 'end') AS ended, count(*) FILTER (kind = 'start') AS s, count(*) FILTER (kind = 'end') AS e, count(DISTINCT p) AS ps, count(DISTINCT r.s) AS ss FROM r GROUP BY id)
    SELECT id, CASE WHEN s > 1 OR e > 1 THEN 'repeated' WHEN e = 0 THEN 'no end' WHEN s = 0 THEN 'no start' WHEN ended <= started THEN 'empty' WHEN ps > 1 THEN 'differs: priority' WHEN ss > 1 THEN 'differs: status' END AS problem FROM g""",
)
def j2_consistent(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), F.when(F.col("o_orderkey") % 2 == 0, "start").otherwise("end").alias("kind"), F.col("o_orderkey").alias("t"), F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("status"))
    return J.pair_intervals(o, "id", "kind", "t", ["priority", "status"]).select("id", "problem")


@query("j3_overlap_labels", f"WITH {INJ} SELECT win_id, trial FROM dw JOIN inj USING (pod) WHERE began < stopped AND started < ended")
def j3(spark, sf_dir):
    return J.overlaps(day_windows(spark, sf_dir), injections(spark, sf_dir), ["pod"], 6 * HOUR).select("win_id", "trial")


_REGIMES = [(f"r{k}", 19000 + 97 * k - 97 * 190, 19000 + 97 * k - 97 * 190 + 90) for k in range(0, 200)]


@query(
    "j4_contained_intervals",
    """WITH o AS (SELECT l_orderkey, l_linenumber, CAST(l_shipdate AS DATE) - DATE '1970-01-01' AS began FROM lineitem),
    r AS (SELECT 'r' || k AS regime, 19000 + 97 * k - 97 * 190 AS started, 19000 + 97 * k - 97 * 190 + 90 AS stopped FROM generate_series(0, 199) AS g(k))
    SELECT coalesce(regime, 'excluded') AS regime, count(*) AS n FROM o LEFT JOIN r ON started <= began AND began + 10 <= stopped GROUP BY ALL""",
)
def j4(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").select(days("l_shipdate").cast("long").alias("began")).withColumn("ended", F.col("began") + 10)  # noqa: E741
    r = spark.createDataFrame(_REGIMES, "regime string, started long, stopped long")
    return J.contained(l, r, [], 97).groupBy(F.coalesce("regime", F.lit("excluded")).alias("regime")).agg(F.count("*").alias("n"))


@query(
    "j5_asof",
    f"""WITH {INJ}, a AS (SELECT alert_id, pod, seen, (SELECT max(started) FROM inj WHERE inj.pod = alr.pod AND started <= seen) AS s FROM alr) SELECT alert_id, CASE WHEN seen - s <= {24 * HOUR} THEN s END AS started FROM a""",
)
def j5(spark, sf_dir):
    return J.asof(alerts(spark, sf_dir), injections(spark, sf_dir).select("pod", "started"), ["pod"], "at", "started", 24 * HOUR).select("alert_id", "started")


@query(
    "j6_injection_clock",
    f"""WITH {INJ} SELECT alert_id, round((seen - (SELECT max(started) FROM inj WHERE inj.pod = alr.pod AND started <= seen)) / 1e6, 6) AS latency FROM alr""",
)
def j6(spark, sf_dir):
    joined = J.asof(alerts(spark, sf_dir), injections(spark, sf_dir).select("pod", "started"), ["pod"], "at", "started", float("inf"))
    return joined.select("alert_id", F.round((F.col("at") - F.col("started")) / 1e6, 6).alias("latency"))


@query("j7_greedy_attribution")
def j7(spark, sf_dir):
    markers = injections(spark, sf_dir).select("pod", F.col("trial").alias("marker_id"), F.col("started").alias("marked"))
    return J.attribute_greedily(alerts(spark, sf_dir), markers, "pod", 24 * HOUR)


@query(
    "j8_earliest_match",
    f"""WITH {INJ}, m AS (SELECT trial, min(seen) AS a FROM inj JOIN alr USING (pod) WHERE seen BETWEEN started AND stopped + {12 * HOUR} GROUP BY trial)
    SELECT trial, a IS NOT NULL AS detected, round((a - started) / 1e6, 6) AS latency FROM inj LEFT JOIN m USING (trial)""",
)
def j8(spark, sf_dir):
    return J.earliest_match(injections(spark, sf_dir), alerts(spark, sf_dir), ["pod"], 12 * HOUR, 12 * HOUR).select("trial", "detected", F.round(F.col("latency") / 1e6, 6).alias("latency"))


CENSORED = f"""{INJ}, nx AS (SELECT *, lead(started) OVER (PARTITION BY pod ORDER BY started) AS upcoming FROM inj),
  cs AS (SELECT *, coalesce(least(stopped + {48 * HOUR}, greatest(stopped, upcoming - 60000000)), stopped + {48 * HOUR}) AS attribution_end FROM nx)"""


@query("j9_censored_attribution", f"WITH {CENSORED}, h AS (SELECT alert_id, count(*) AS hits, min(trial) AS trial FROM alr JOIN cs USING (pod) WHERE seen >= started AND seen < attribution_end GROUP BY alert_id) SELECT alert_id, hits, h.trial, attribution_end < stopped + {48 * HOUR} AS censored FROM h JOIN cs USING (trial)")
def j9(spark, sf_dir):
    i = J.censored_horizons(injections(spark, sf_dir), ["pod"], 48 * HOUR, 60_000_000)
    once = J.attribute_once(alerts(spark, sf_dir), i, ["pod"], 48 * HOUR)
    return once.join(i.select("trial", "censored"), "trial").select("alert_id", F.col("count").alias("hits"), "trial", "censored")


@query("j10_first_alert", f"WITH {INJ} SELECT pod, arg_min(alert_id, (seen, alert_id)) AS alert_id, min(seen) AS seen FROM alr GROUP BY pod")
def j10(spark, sf_dir):
    first = alerts(spark, sf_dir).groupBy("pod").agg(F.min(F.struct("at", "alert_id")).alias("x"))
    return first.select("pod", "x.alert_id", F.col("x.at").alias("seen"))


@query(
    "j11_unique_markers",
    f"""WITH {INJ}, h AS (SELECT alert_id, count(*) AS hits, min(trial) AS trial FROM alr JOIN inj USING (pod) WHERE seen BETWEEN started - 50000 AND started + {10 * HOUR} GROUP BY alert_id) SELECT alert_id, trial FROM h WHERE hits = 1""",
)
def j11(spark, sf_dir):
    """An event belongs to a marker if it is the only one from a little before it to some time after."""
    near = injections(spark, sf_dir).select("trial", "pod", (F.col("started") - 50_000).alias("started"), (F.col("started") + 10 * HOUR + 1).alias("attribution_end"))
    return J.attribute_once(alerts(spark, sf_dir), near, ["pod"], 10 * HOUR).filter("count = 1").select("alert_id", "trial")


@query(
    "j12_identity_checks",
    f"""WITH {INJ}, m AS (SELECT trial, inj.pod, started, min(alr.seen) AS seen, arg_min(alert_id, (alr.seen, alert_id)) AS alert_id FROM inj LEFT JOIN alr ON alr.pod = inj.pod AND seen >= started GROUP BY ALL)
    SELECT trial, seen IS NULL AS missing, coalesce(alert_id % 10 <> trial % 10, false) AS other_run, coalesce(alert_id % 3 <> trial % 3, false) AS other_binary, coalesce(seen - started < {HOUR}, false) AS early FROM m""",
)
def j12(spark, sf_dir):
    """The first alert after each injection, with a flag for each attribute of both that must agree but does not."""
    later = alerts(spark, sf_dir).select("pod", (-F.col("at")).alias("back"), "at", (F.col("alert_id") % 10).alias("run"), (F.col("alert_id") % 3).alias("binary"))
    i = injections(spark, sf_dir).withColumn("from_t", -F.col("started"))
    m = J.asof(i, later, ["pod"], "from_t", "back", float("inf"))
    other = lambda a, n: F.coalesce(F.col(a) != F.col("trial") % n, F.lit(False))
    return m.select("trial", F.col("at").isNull().alias("missing"), other("run", 10).alias("other_run"), other("binary", 3).alias("other_binary"), F.coalesce(F.col("at") - F.col("started") < HOUR, F.lit(False)).alias("early"))


@query(
    "j11_same_process",
    f"""WITH {INJ}, h AS (SELECT alert_id, count(*) AS hits, min(trial) AS trial FROM alr JOIN inj ON inj.pod = alr.pod AND trial % 3 = alert_id % 3 WHERE seen BETWEEN started - 50000 AND started + {10 * HOUR} GROUP BY alert_id) SELECT alert_id, trial FROM h WHERE hits = 1""",
)
def j11_process(spark, sf_dir):
    """J11 with the binary and its arguments among the keys that must be equal."""
    near = injections(spark, sf_dir).select("trial", "pod", (F.col("trial") % 3).alias("binary"), (F.col("started") - 50_000).alias("started"), (F.col("started") + 10 * HOUR + 1).alias("attribution_end"))
    a = alerts(spark, sf_dir).withColumn("binary", F.col("alert_id") % 3)
    return J.attribute_once(a, near, ["pod", "binary"], 10 * HOUR).filter("count = 1").select("alert_id", "trial")


@query(
    "j13_observability",
    f"""WITH {INJ}, o AS (SELECT trial, count(*) AS windows, bool_and(win_id % 2 = 0) AS all_even, CAST(sum(win_id % 7) AS BIGINT) AS process, CAST(sum(win_id % 5) AS BIGINT) AS network FROM dw JOIN inj USING (pod) WHERE began < stopped AND started < ended GROUP BY trial)
    SELECT trial, coalesce(windows, 0) AS windows, all_even, coalesce(process, 0) AS process, coalesce(network, 0) AS network FROM inj LEFT JOIN o USING (trial)""",
)
def j13(spark, sf_dir):
    """What the windows of each injection hold: their number and the sums of their counts by family."""
    i = injections(spark, sf_dir)
    w = day_windows(spark, sf_dir).withColumn("process", F.col("win_id") % 7).withColumn("network", F.col("win_id") % 5)
    o = J.overlaps(w, i, ["pod"], 6 * HOUR).groupBy("trial").agg(F.count("*").alias("windows"), F.bool_and(F.col("win_id") % 2 == 0).alias("all_even"), F.sum("process").alias("process"), F.sum("network").alias("network"))
    none = F.lit(0).cast("long")
    return i.select("trial").join(o, "trial", "left").select("trial", F.coalesce("windows", none).alias("windows"), "all_even", F.coalesce("process", none).alias("process"), F.coalesce("network", none).alias("network"))


@query(
    "j14_failures_in_scope",
    f"""WITH {INJ}, f AS (SELECT event_id, pod, us FROM ev WHERE syscall = 'setuid') SELECT event_id, EXISTS (SELECT 1 FROM inj WHERE inj.pod = f.pod AND us BETWEEN started - {HOUR} AND stopped + {HOUR}) AS in_scope FROM f""",
)
def j14(spark, sf_dir):
    f = events(spark, sf_dir).filter("syscall = 'setuid'").select("event_id", "pod", F.col("us").alias("began"), F.col("us").alias("ended"))
    guarded = injections(spark, sf_dir).select("trial", "pod", (F.col("started") - HOUR).alias("started"), (F.col("stopped") + HOUR).alias("stopped"))
    return J.contained(f, guarded, ["pod"], 3 * HOUR).groupBy("event_id").agg(F.bool_or(F.col("trial").isNotNull()).alias("in_scope"))


@query(
    "j15_phases",
    f"""WITH {EV}, p AS (SELECT k AS phase, 1704067200000000 + k * {30 * HOUR} AS a, 1704067200000000 + k * {30 * HOUR} + {24 * HOUR} AS b FROM generate_series(0, 30) AS g(k))
    SELECT event_id, phase FROM ev LEFT JOIN p ON us BETWEEN a AND b""",
)
def j15(spark, sf_dir):
    p = spark.range(31).select(F.col("id").alias("phase"), (F.col("id") * 30 * HOUR + 1704067200000000).alias("started")).withColumn("stopped", F.col("started") + 24 * HOUR)
    e = events(spark, sf_dir).select("event_id", F.col("us").alias("began"), F.col("us").alias("ended"))
    return J.contained(e, p, [], 30 * HOUR).select("event_id", "phase")


@query(
    "j16_bad_row_brackets",
    f"""WITH {EV}, b AS (SELECT event_id, pod, CASE WHEN event_id % 9 <> 0 THEN us END AS us FROM ev),
    w AS (SELECT *, last_value(us IGNORE NULLS) OVER (PARTITION BY pod ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS after_t,
      first_value(us IGNORE NULLS) OVER (PARTITION BY pod ORDER BY event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS before_t FROM b)
    SELECT event_id, after_t, before_t FROM w WHERE us IS NULL""",
)
def j16(spark, sf_dir):
    e = events(spark, sf_dir).select("event_id", "pod", F.when(F.col("event_id") % 9 != 0, F.col("us")).alias("us"))
    return J.bracket_bad_rows(e, "pod", "event_id", "us").select("event_id", "after_t", "before_t")


@query(
    "j16_phase_overlaps",
    f"""WITH {EV}, b AS (SELECT event_id, pod, CASE WHEN event_id % 9 <> 0 THEN us END AS us FROM ev),
    w AS (SELECT *, last_value(us IGNORE NULLS) OVER (PARTITION BY pod ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lo,
      first_value(us IGNORE NULLS) OVER (PARTITION BY pod ORDER BY event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS hi FROM b),
    p AS (SELECT 1704067200000000 + k * {30 * HOUR} AS a, 1704067200000000 + k * {30 * HOUR} + {6 * HOUR} AS z FROM generate_series(0, 30) AS g(k))
    SELECT event_id, EXISTS (SELECT 1 FROM p WHERE (lo IS NULL OR lo <= z) AND (hi IS NULL OR hi >= a)) AS touches_phase FROM w WHERE us IS NULL""",
)
def j16_phases(spark, sf_dir):
    """A bad row is harmless only if no phase lies between its valid neighbours."""
    p = spark.range(31).select((F.col("id") * 30 * HOUR + 1704067200000000).alias("started")).withColumn("stopped", F.col("started") + 6 * HOUR)
    e = events(spark, sf_dir).select("event_id", "pod", F.when(F.col("event_id") % 9 != 0, F.col("us")).alias("us"))
    return J.touches_phase(J.bracket_bad_rows(e, "pod", "event_id", "us"), p, 30 * HOUR).select("event_id", "touches_phase")


@query(
    "j17_paired_methods",
    """WITH a AS (SELECT doc_id, quality = 1 AS found, source AS meta FROM labels JOIN documents USING (doc_id)), b AS (SELECT doc_id, toxic = 1 AS found, CASE WHEN doc_id % 9 = 0 THEN 'other' ELSE source END AS meta FROM labels JOIN documents USING (doc_id) WHERE doc_id % 13 <> 0)
    SELECT doc_id, a.found AS first_found, b.found AS second_found, CASE WHEN b.meta IS NULL THEN 'only first' WHEN a.meta <> b.meta THEN 'differs' END AS problem FROM a LEFT JOIN b USING (doc_id)""",
)
def j17(spark, sf_dir):
    """Two methods' outcomes of a trial, each with its own record of what describes the trial; these must be equal."""
    d = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    a = d.select("doc_id", (F.col("quality") == 1).alias("found"), F.col("source").alias("meta"))
    b = d.filter("doc_id % 13 <> 0").select("doc_id", (F.col("toxic") == 1).alias("found"), F.when(F.col("doc_id") % 9 == 0, "other").otherwise(F.col("source")).alias("meta"))
    return J.paired(a, b, ["doc_id"], "found", ["meta"]).withColumnsRenamed({"found_1": "first_found", "found_2": "second_found"})


@query("j18_method_pairs", "WITH m AS (SELECT event_type AS m, count(*) AS n FROM events GROUP BY event_type) SELECT a.m AS one, b.m AS two, a.n AS n_one, b.n AS n_two FROM m a JOIN m b ON a.m < b.m")
def j18(spark, sf_dir):
    """Pairs of the few methods that all events name."""
    m = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("one")).agg(F.count("*").alias("n_one"))
    return m.join(m.select(F.col("one").alias("two"), F.col("n_one").alias("n_two")), F.col("one") < F.col("two"))


@query(
    "j19_adjacent_blocks",
    """WITH o AS (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS k FROM supplier)
    SELECT s_nationkey, (k - 1) // 2 AS block, round(max(CAST(s_acctbal AS DOUBLE)) FILTER (k % 2 = 1), 6) AS off_value, round(max(CAST(s_acctbal AS DOUBLE)) FILTER (k % 2 = 0), 6) AS on_value FROM o GROUP BY ALL""",
)
def j19(spark, sf_dir):
    return X.adjacent_pairs(table(spark, sf_dir, "supplier").withColumn("v", F.col("s_acctbal").cast("double")), ["s_nationkey"], "s_suppkey", "v").select("s_nationkey", "block", F.round("off", 6).alias("off_value"), F.round("on", 6).alias("on_value"))


@query("j20_expected_matrix", f"WITH {EV} SELECT pod, syscall, trial FROM (SELECT DISTINCT pod FROM ev), (SELECT DISTINCT syscall FROM ev), (SELECT unnest(generate_series(1, 5)) AS trial)")
def j20(spark, sf_dir):
    """Every pod, call and trial that an evaluation should have."""
    e = events(spark, sf_dir)
    trials = spark.range(1, 6).withColumnRenamed("id", "trial")
    return e.select("pod").distinct().crossJoin(e.select("syscall").distinct()).crossJoin(trials)


@query(
    "x1_id_differences",
    """SELECT 'missing' AS kind, count(*) AS n FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders) UNION ALL SELECT 'unexpected', count(*) FROM (SELECT o_custkey FROM orders EXCEPT SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0)
    UNION ALL SELECT 'both', count(*) FROM (SELECT c_custkey FROM customer INTERSECT SELECT o_custkey FROM orders)""",
)
def x1(spark, sf_dir):
    c, o = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")), table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"))
    return X.counted("missing", c.subtract(o)).union(X.counted("unexpected", o.subtract(c.filter(F.col("id") % 2 == 0)))).union(X.counted("both", c.intersect(o)))


@query(
    "x2_log_reconciliation",
    """WITH a AS (SELECT o_orderkey AS id, o_orderpriority AS v FROM orders WHERE o_orderkey % 5 <> 0), b AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 11 = 0 THEN 'X' ELSE o_orderpriority END AS v FROM orders WHERE o_orderkey % 7 <> 0)
    SELECT id, CASE WHEN b.id IS NULL THEN 'missing' WHEN a.id IS NULL THEN 'unexpected' ELSE 'changed' END AS problem FROM a FULL JOIN b USING (id) WHERE a.id IS NULL OR b.id IS NULL OR a.v <> b.v""",
)
def x2(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("v"))
    return X.reconcile(o.filter(F.col("id") % 5 != 0), o.filter(F.col("id") % 7 != 0).withColumn("v", F.when(F.col("id") % 11 == 0, "X").otherwise(F.col("v"))), ["id"], ["v"])


@query(
    "x3_coverage",
    """SELECT n_name, c_mktsegment FROM nation CROSS JOIN (SELECT DISTINCT c_mktsegment FROM customer)
    WHERE (n_nationkey, c_mktsegment) NOT IN (SELECT (c_nationkey, c_mktsegment) FROM customer WHERE c_acctbal > 0 UNION SELECT (s_nationkey, 'BUILDING') FROM supplier)""",
)
def x3(spark, sf_dir):
    """Nations without a customer in credit of some segment; a supplier stands for the building trade."""
    c = table(spark, sf_dir, "customer")
    seen = c.filter("c_acctbal > 0").select(F.col("c_nationkey").alias("n_nationkey"), "c_mktsegment").union(table(spark, sf_dir, "supplier").select("s_nationkey", F.lit("BUILDING"))).distinct()
    expected = table(spark, sf_dir, "nation").select("n_nationkey", "n_name").crossJoin(c.select("c_mktsegment").distinct())
    return expected.join(seen, ["n_nationkey", "c_mktsegment"], "left_anti").select("n_name", "c_mktsegment")


@query(
    "x3_order_coverage",
    """SELECT n_name, o_orderpriority FROM nation CROSS JOIN (SELECT DISTINCT o_orderpriority FROM orders)
    WHERE (n_nationkey, o_orderpriority) NOT IN (SELECT (c_nationkey, o_orderpriority) FROM orders JOIN customer ON c_custkey = o_custkey)""",
)
def x3_orders(spark, sf_dir):
    """Nations without an order of some priority, over all orders and customers."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderpriority")
    seen = o.join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_nationkey").alias("n_nationkey"), "o_orderpriority").distinct()
    expected = table(spark, sf_dir, "nation").select("n_nationkey", "n_name").crossJoin(o.select("o_orderpriority").distinct())
    return expected.join(seen, ["n_nationkey", "o_orderpriority"], "left_anti").select("n_name", "o_orderpriority")


@query("x4_duplicates", "SELECT o_custkey, strftime(o_orderdate, '%Y-%m-%d') AS day, count(*) AS copies, min(o_orderkey) AS kept FROM orders GROUP BY ALL HAVING count(*) > 1")
def x4(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("day", F.date_format(F.col("o_orderdate").cast("timestamp_ntz"), "yyyy-MM-dd"))
    return X.duplicates(o, ["o_custkey", "day"], "o_orderkey")
