"""Queries on data contracts (Q1 to Q12)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewright.operators import contracts as Q
from tracewright.operators.joins import pair_intervals
from tracewright.operators.splits import overlapping
from tracewright.plans.features import FREQ, WIN, frequencies
from tracewright.registry import query
from tracewright.sources.tables import EV, days, events, table


def window_rows(spark, sf_dir):
    """Windows with counts and sparse values, some of them broken on purpose."""
    f = frequencies(spark, sf_dir).groupBy(*WIN).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("syscall", "n")))).alias("counts"), F.first("total").alias("event_count"))
    k = F.col("win")
    return f.select(
        *WIN, "counts", (F.col("event_count") + F.when(k % 7 == 0, 1).otherwise(0)).alias("event_count"), k.alias("window_start"), F.when(k % 11 == 0, k).otherwise(k + 1).alias("window_end"),
        F.flatten(F.transform(F.map_entries("counts"), lambda e: F.array_repeat(e["key"], e["value"].cast("int")))).alias("_all"),
        F.array(*map(F.lit, [*Q.WINDOW_KEYS[:-1], Q.WINDOW_KEYS[-1]])).alias("_keys"),
        F.array(F.struct(F.lit(0).alias("i"), F.lit(0.5).alias("v")), F.struct(F.when(k % 5 == 0, 0).otherwise(3).alias("i"), F.when(k % 13 == 0, float("nan")).otherwise(1.0).alias("v"))).alias("sparse"),
    ).select(
        "*", F.when(k % 17 == 0, F.slice("_all", 1, F.size("_all") - 1)).otherwise(F.col("_all")).alias("sequence"),
        F.when(k % 19 == 0, F.array_append("_keys", F.lit("note"))).when(k % 23 == 0, F.array_remove("_keys", "counts")).otherwise(F.col("_keys")).alias("record_keys"),
    )


@query(
    "q1_window_contract",
    f"""WITH {FREQ}, w AS (SELECT DISTINCT workload, win FROM fr), v(problem, k) AS (VALUES ('count', 7), ('interval', 11), ('order', 5), ('finite', 13), ('sequence', 17), ('keys', 19), ('keys', 23)) SELECT DISTINCT workload, win, problem FROM w JOIN v ON win % k = 0""",
)
def q1(spark, sf_dir):
    return Q.violations(window_rows(spark, sf_dir), WIN, Q.window_rules(4))


@query(
    "q2_interval_contract",
    """WITH o AS (SELECT o_orderkey, o_totalprice, o_orderstatus, o_custkey FROM orders), v AS (SELECT o_orderkey, 'price' AS problem FROM o WHERE NOT o_totalprice > 1000 UNION ALL SELECT o_orderkey, 'status' FROM o WHERE o_orderstatus NOT IN ('F', 'O') UNION ALL SELECT o_orderkey, 'customer' FROM o WHERE NOT o_custkey > 5)
    SELECT * FROM v""",
)
def q2(spark, sf_dir):
    rules = {"price": F.col("o_totalprice") > 1000, "status": F.col("o_orderstatus").isin("F", "O"), "customer": F.col("o_custkey") > 5}
    return Q.violations(table(spark, sf_dir, "orders"), ["o_orderkey"], rules)


@query(
    "q2_injection_contract",
    """WITH r AS (SELECT o_orderkey AS line, o_custkey AS id, CASE WHEN o_orderkey % 23 = 0 THEN 'pause' WHEN o_orderkey % 2 = 0 THEN 'start' ELSE 'end' END AS kind, o_orderkey AS t FROM orders),
    f AS (SELECT *, CASE WHEN kind = 'end' AND line % 7 <> 0 THEN NULL ELSE 'x' END AS attack, CASE WHEN kind = 'end' THEN NULL WHEN line % 5 = 0 THEN 'many' WHEN line % 11 = 0 THEN NULL ELSE '7' END AS seed, CASE WHEN kind = 'end' OR line % 13 = 0 THEN 0 END AS code FROM r),
    g AS (SELECT id, min(t) FILTER (kind = 'start') AS a, min(t) FILTER (kind = 'end') AS z, count(*) FILTER (kind = 'start') AS s, count(*) FILTER (kind = 'end') AS e FROM f GROUP BY id)
    SELECT line, 'kind' AS problem FROM f WHERE kind = 'pause' UNION ALL SELECT line, 'required' FROM f WHERE (kind = 'start' AND (attack IS NULL OR seed IS NULL)) OR (kind = 'end' AND code IS NULL)
    UNION ALL SELECT line, 'forbidden' FROM f WHERE (kind = 'start' AND code IS NOT NULL) OR (kind = 'end' AND (attack IS NOT NULL OR seed IS NOT NULL)) UNION ALL SELECT line, 'seed' FROM f WHERE seed = 'many'
    UNION ALL SELECT id, CASE WHEN s > 1 OR e > 1 THEN 'repeated' WHEN e = 0 THEN 'no end' WHEN s = 0 THEN 'no start' ELSE 'empty' END FROM g WHERE s > 1 OR e > 1 OR e = 0 OR s = 0 OR z <= a""",
)
def q2_injections(spark, sf_dir):
    """Injection records against their fields by kind, and their ids against the pairing of starts and ends."""
    k = F.col("o_orderkey")
    r = table(spark, sf_dir, "orders").select(k.alias("line"), F.col("o_custkey").alias("id"), F.when(k % 23 == 0, "pause").when(k % 2 == 0, "start").otherwise("end").alias("kind"), k.alias("t"))
    line, end = F.col("line"), F.col("kind") == "end"
    r = r.withColumn("attack_type", F.when(~end | (line % 7 == 0), "x")).withColumn("seed", F.when(end, None).when(line % 5 == 0, "many").when(line % 11 == 0, None).otherwise("7")).withColumn("exit_code", F.when(end | (line % 13 == 0), 0))
    return Q.violations(r, ["line"], Q.injection_rules()).union(pair_intervals(r, "id", "kind", "t").filter("problem is not null").select("id", "problem"))


@query("q3_capture_gates", f"""WITH {EV} SELECT count(*) AS rows, count(DISTINCT workload) = 1 AS one_workload, count(DISTINCT length(workload)) = 1 AS one_width, count(*) FILTER (value > 400) AS open FROM ev""")
def q3(spark, sf_dir):
    return Q.capture_gates(events(spark, sf_dir).withColumn("width", F.length("workload")), ["workload", "width"], F.col("value") > 400)


@query("q3_capture_dimensions", f"""WITH {EV} SELECT 'workload' AS dimension, workload AS value, count(*) AS rows FROM ev GROUP BY workload UNION ALL SELECT 'syscall', syscall, count(*) FROM ev GROUP BY syscall UNION ALL SELECT 'pod', CAST(pod AS VARCHAR), count(*) FROM ev GROUP BY pod""")
def q3_dimensions(spark, sf_dir):
    return Q.dimension_counts(events(spark, sf_dir), ["workload", "syscall", "pod"])


@query(
    "q3_vector_sizes",
    "SELECT label, count(*) AS rows, count(DISTINCT len(embedding) - CASE WHEN vec_id % 97 = 0 THEN 1 ELSE 0 END) = 1 AS one_size, min(len(embedding) - CASE WHEN vec_id % 97 = 0 THEN 1 ELSE 0 END) AS size FROM embeddings GROUP BY label",
)
def q3_sizes(spark, sf_dir):
    """A capture has vectors of one size; every 97th is cut short here."""
    v = table(spark, sf_dir, "embeddings").withColumn("size", (F.size("embedding") - F.when(F.col("vec_id") % 97 == 0, 1).otherwise(0)).cast("long"))
    return v.groupBy("label").agg(F.count("*").alias("rows"), (F.countDistinct("size") == 1).alias("one_size"), F.min("size").alias("size"))


@query(
    "q4_counter_report",
    f"""WITH l AS (SELECT l_suppkey, CAST(l_shipdate AS DATE) - DATE '1970-01-01' AS s, CAST(l_shipdate AS DATE) - DATE '1970-01-01' + 1 + l_partkey % 30 AS e, CAST(l_shipdate AS DATE) - DATE '1970-01-01' + l_orderkey % 45 AS c, CASE WHEN l_partkey % 50 = 7 THEN 1 ELSE 0 END AS lost FROM lineitem),
    g AS (SELECT l_suppkey, count(*) AS rows, count(*) FILTER (e - s < 2 OR e - s > 29) AS odd_intervals, {", ".join(f"quantile_cont(greatest(0.0, CAST(c - e AS DOUBLE)), {q}) AS lag_{n}" for n, q in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99)))}, max(greatest(0.0, CAST(c - e AS DOUBLE))) AS lag_max, max(lost) AS loss FROM l GROUP BY l_suppkey)
    SELECT l_suppkey, rows, odd_intervals, round(lag_p50, 6) AS lag_p50, round(lag_p95, 6) AS lag_p95, round(lag_p99, 6) AS lag_p99, lag_max, loss, rows >= 50 AND odd_intervals = 0 AND loss = 0 AS valid FROM g""",
)
def q4_report(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").select("l_suppkey", days("l_shipdate").alias("s"), (days("l_shipdate") + 1 + F.col("l_partkey") % 30).alias("e"), (days("l_shipdate") + F.col("l_orderkey") % 45).alias("c"), F.when(F.col("l_partkey") % 50 == 7, 1).otherwise(0).alias("lost"))  # noqa: E741
    r = Q.counter_report(l, ["l_suppkey"], "s", "e", "c", ["lost"], (2, 29), 50)
    return r.select(*[F.round(c, 6).alias(c) if c in ("lag_p50", "lag_p95", "lag_p99") else c for c in r.columns])


@query(
    "q4_counter_capture",
    """WITH l AS (SELECT l_suppkey, l_orderkey * 10 + l_linenumber AS t, l_quantity, l_linenumber FROM lineitem)
    SELECT l_suppkey, count(*) AS rows, count(*) >= 50 AS enough, count(DISTINCT t) = count(*) AS monotonic, bool_and(l_linenumber < 7) AS exact FROM l GROUP BY l_suppkey""",
)
def q4(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").select("l_suppkey", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("t"), F.col("l_linenumber").alias("total"))  # noqa: E741
    return Q.counter_checks(l, ["l_suppkey"], "t", "total", F.least(F.col("total"), F.lit(6)), 50)


@query(
    "q5_contract_intervals",
    """WITH o AS (SELECT o_custkey, o_orderkey, CAST(o_orderdate AS DATE) - DATE '1970-01-01' AS a FROM orders), x AS (SELECT *, max(a + 30) OVER (PARTITION BY o_custkey ORDER BY a, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS e FROM o)
    SELECT o_custkey, count(*) AS overlaps FROM x WHERE e > a GROUP BY o_custkey""",
)
def q5(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", days("o_orderdate").alias("a")).withColumn("b", F.col("a") + 30)
    return overlapping(o, ["o_custkey"], "a", "b").groupBy("o_custkey").agg(F.count("*").alias("overlaps"))


@query(
    "q5_regime_contract",
    """WITH o AS (SELECT o_custkey, o_orderkey, o_orderpriority AS regime, CAST(o_orderdate AS DATE) - DATE '1970-01-01' AS a, CAST(o_orderdate AS DATE) - DATE '1970-01-01' + CASE WHEN o_orderkey % 10 = 1 THEN 0 ELSE 30 END AS b FROM orders),
    x AS (SELECT *, max(b) OVER (PARTITION BY o_custkey ORDER BY a, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS e, row_number() OVER (PARTITION BY o_custkey, regime ORDER BY a, o_orderkey) AS k FROM o)
    SELECT o_custkey, o_orderkey, 'order' AS problem FROM x WHERE b <= a UNION ALL SELECT o_custkey, o_orderkey, 'overlap' FROM x WHERE e > a UNION ALL SELECT o_custkey, o_orderkey, 'regime' FROM x WHERE k > 1""",
)
def q5_regimes(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.col("o_orderpriority").alias("regime"), days("o_orderdate").alias("a"))
    return Q.interval_contract(o.withColumn("b", F.col("a") + F.when(F.col("o_orderkey") % 10 == 1, 0).otherwise(30)), ["o_custkey"], "a", "b", "regime", "o_orderkey")


@query("q6_sensor_health", f"""WITH {EV} SELECT pod, count(*) FILTER (syscall = 'setuid') <= 15 AND max(value) < 400 AND count(*) > 40 AS healthy FROM ev GROUP BY pod""")
def q6(spark, sf_dir):
    s = events(spark, sf_dir).groupBy("pod").agg(F.struct(F.count_if(F.col("syscall") == "setuid").alias("errors"), F.max("value").alias("top"), F.count("*").alias("n")).alias("c"))
    return s.select("pod", ((F.col("c.errors") <= 15) & (F.col("c.top") < 400) & (F.col("c.n") > 40)).alias("healthy"))


@query(
    "q7_matrix_completeness",
    """WITH e AS (SELECT CAST(r_regionkey AS BIGINT) AS r, d FROM region, (SELECT unnest(generate_series(1, 30)) AS d)), f AS (SELECT CAST(c_nationkey % 6 AS BIGINT) AS r, c_custkey % 29 + 1 AS d, c_mktsegment AS g FROM customer), h AS (SELECT r, d, count(DISTINCT g) AS n FROM f GROUP BY ALL)
    SELECT r, d, CASE WHEN n IS NULL THEN 'missing' WHEN er IS NULL THEN 'unexpected' ELSE 'several digests' END AS problem FROM (SELECT r, d, r AS er FROM e) e FULL JOIN h USING (r, d) WHERE n IS NULL OR er IS NULL OR n > 1""",
)
def q7(spark, sf_dir):
    e = table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("r")).crossJoin(spark.range(1, 31).withColumnRenamed("id", "d"))
    f = table(spark, sf_dir, "customer").select((F.col("c_nationkey") % 6).cast("long").alias("r"), (F.col("c_custkey") % 29 + 1).cast("long").alias("d"), "c_mktsegment")
    return Q.completeness(e, f, ["r", "d"], "c_mktsegment")


@query(
    "q7_matrix_contract",
    """WITH f AS (SELECT CAST(c_nationkey % 6 AS BIGINT) AS r, c_custkey % 29 + 1 AS d, c_mktsegment AS g, CAST(c_acctbal AS DOUBLE) AS t, length(c_mktsegment) AS w FROM customer), e AS (SELECT CAST(r_regionkey AS BIGINT) AS r, d FROM region, (SELECT unnest(generate_series(1, 30)) AS d)),
    h AS (SELECT r, d, count(DISTINCT g) AS n, min(t) AS t, count(DISTINCT w) AS w FROM f GROUP BY ALL)
    SELECT r, d, CASE WHEN n IS NULL THEN 'missing' WHEN er IS NULL THEN 'unexpected' ELSE 'several digests' END AS problem FROM (SELECT r, d, r AS er FROM e) e FULL JOIN h USING (r, d) WHERE n IS NULL OR er IS NULL OR n > 1
    UNION ALL SELECT r, d, 'short' FROM h WHERE t < 0 UNION ALL SELECT r, d, 'several shapes' FROM h WHERE w > 1""",
)
def q7_contract(spark, sf_dir):
    """Q7 with the durations and shapes of what is in a cell."""
    e = table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("r")).crossJoin(spark.range(1, 31).withColumnRenamed("id", "d"))
    f = table(spark, sf_dir, "customer").select((F.col("c_nationkey") % 6).cast("long").alias("r"), (F.col("c_custkey") % 29 + 1).cast("long").alias("d"), "c_mktsegment", F.col("c_acctbal").cast("double").alias("t"), F.length("c_mktsegment").alias("w"))
    return Q.matrix_contract(e, f, ["r", "d"], "c_mktsegment", "t", "w", 0.0)


@query(
    "q8_accounting_identities",
    """WITH g AS (SELECT l_suppkey, l_returnflag, count(*) FILTER (l_discount > 0.05) AS a, count(*) AS n FROM lineitem GROUP BY ALL),
    r AS (SELECT l_suppkey, l_returnflag, a + CASE WHEN l_suppkey % 5 = 0 THEN 1 ELSE 0 END AS alerts, n - CASE WHEN l_suppkey % 7 = 0 THEN 1 ELSE 0 END AS eligible, a / n AS rate FROM g WHERE l_suppkey % 9 <> 4)
    SELECT l_suppkey, l_returnflag, coalesce(alerts = a, false) AS alerts_agree, coalesce(abs(rate - alerts / eligible) <= 1e-9, false) AS rate_agrees, coalesce(eligible = n, false) AS whole_agrees FROM g LEFT JOIN r USING (l_suppkey, l_returnflag)""",
)
def q8(spark, sf_dir):
    """A report of alert rates, in part wrong or missing, against the rows that it reports on."""
    l, big = table(spark, sf_dir, "lineitem"), F.col("l_discount") > 0.05  # noqa: E741
    key, s = ["l_suppkey", "l_returnflag"], F.col("l_suppkey")
    g = l.groupBy(*key).agg(F.count_if(big).alias("a"), F.count("*").alias("n")).filter(s % 9 != 4)
    report = g.select(*key, (F.col("a") + F.when(s % 5 == 0, 1).otherwise(0)).alias("alerts"), (F.col("n") - F.when(s % 7 == 0, 1).otherwise(0)).alias("eligible"), (F.col("a") / F.col("n")).alias("rate"))
    return Q.accounting(report, l, key, big)


@query(
    "q9_single_identity",
    f"""WITH {EV}, m AS (SELECT pod, CASE WHEN pod % 7 = 2 AND event_id % 2 = 0 THEN substr(sha256(workload), 1, 63) WHEN pod % 5 = 1 THEN sha256(syscall) ELSE sha256(workload) END AS model, CASE WHEN pod % 3 = 0 THEN us // 1296000000000 ELSE 1 END AS run FROM ev)
    SELECT pod, count(DISTINCT model) = 1 AS one_model, count(DISTINCT run) = 1 AS one_run, bool_and(regexp_matches(model, '^[0-9a-f]{{64}}$')) AS well_formed FROM m GROUP BY pod""",
)
def q9(spark, sf_dir):
    """A pod's decisions come from one model, whose digest is well formed, and one run."""
    e, pod = events(spark, sf_dir), F.col("pod")
    whole = F.sha2("workload", 256)
    model = F.when((pod % 7 == 2) & (F.col("event_id") % 2 == 0), F.substring(whole, 1, 63)).when(pod % 5 == 1, F.sha2("syscall", 256)).otherwise(whole)
    m = e.select("pod", model.alias("model"), F.when(pod % 3 == 0, F.floor(F.col("us") / 1296000000000)).otherwise(F.lit(1).cast("long")).alias("run"))
    return m.groupBy("pod").agg((F.countDistinct("model") == 1).alias("one_model"), (F.countDistinct("run") == 1).alias("one_run"), F.bool_and(F.col("model").rlike("^[0-9a-f]{64}$")).alias("well_formed"))


@query(
    "q10_marker_bounds",
    f"""WITH {EV}, m AS (SELECT workload, min(us) AS started, arg_min(pod % 3, us) AS run, arg_min(pod % 2, us) AS model FROM ev WHERE syscall = 'setuid' GROUP BY workload)
    SELECT workload, count(*) FILTER (us >= started) AS judged, count(*) FILTER (us < started) AS excluded, count(*) FILTER (us >= started AND (pod % 3 <> run OR pod % 2 <> model)) AS foreign FROM ev JOIN m USING (workload) GROUP BY workload""",
)
def q10(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("run", F.col("pod") % 3).withColumn("model", F.col("pod") % 2)
    m = e.filter("syscall = 'setuid'").groupBy("workload").agg(F.min(F.struct("us", "run", "model")).alias("m")).select("workload", F.col("m.us").alias("started"), "m.run", "m.model")
    return Q.marker_bounds(e, m, ["workload"], "us", ["run", "model"])


@query(
    "q11_gate_roll_up",
    f"""WITH {EV}, g AS (SELECT pod, count(*) > 60 AS enough, max(value) < 300 AS calm, count(DISTINCT syscall) = 5 AS varied FROM ev GROUP BY pod)
    SELECT pod, concat_ws(',', CASE WHEN NOT enough THEN 'enough' END, CASE WHEN NOT calm THEN 'calm' END, CASE WHEN NOT varied THEN 'varied' END) AS failed, enough AND calm AND varied AS passed FROM g""",
)
def q11(spark, sf_dir):
    g = events(spark, sf_dir).groupBy("pod").agg((F.count("*") > 60).alias("enough"), (F.max("value") < 300).alias("calm"), (F.countDistinct("syscall") == 5).alias("varied"))
    return Q.roll_up(g, ["pod"])


@query("q12_review_admission", "SELECT o_orderstatus, count(*) AS rejected FROM orders WHERE o_orderstatus <> 'F' GROUP BY o_orderstatus")
def q12(spark, sf_dir):
    return Q.admitted(table(spark, sf_dir, "orders"), "o_orderstatus", "F")[1]
