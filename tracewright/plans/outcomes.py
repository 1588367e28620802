"""Queries on evaluation and statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewright.functions.syscalls import Z_TWO_SIDED, wilson, wilson_sql
from tracewright.operators import outcomes as O
from tracewright.operators.robust import SKETCH_ERROR, merged_sketches, quantile_sketches, sketched_summary, summary
from tracewright.operators.sets import adjacent_pairs
from tracewright.registry import query
from tracewright.sources.tables import EV, days, events, table


def r6(*names: str):
    return [F.round(n, 6).alias(n) for n in names]


@query(
    "a26_coverage",
    f"""WITH {EV} SELECT workload, count(DISTINCT floor(t / 3600)) AS seconds_seen, CAST(floor(max(t / 3600)) - floor(min(t / 3600)) + 1 AS BIGINT) AS span_seconds,
    round(count(DISTINCT floor(t / 3600)) / (floor(max(t / 3600)) - floor(min(t / 3600)) + 1), 6) AS coverage FROM ev GROUP BY workload""",
)
def a26(spark, sf_dir):
    """Hours stand for seconds here."""
    return O.coverage(events(spark, sf_dir).withColumn("h", F.col("t") / 3600), ["workload"], "h").select("workload", "seconds_seen", "span_seconds", *r6("coverage"))


def trials(spark, sf_dir):
    """(doc_id, quality, toxic, lang, source, found): found where the document is longer than usual."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    return table(spark, sf_dir, "labels").join(d, "doc_id").withColumn("found", F.col("n_chars") > 1500)


TR = "tr AS (SELECT l.doc_id, quality, toxic, lang, source, n_chars, n_chars > 1500 AS found FROM labels l JOIN documents d USING (doc_id))"


@query(
    "a27_breakdowns",
    f"""WITH {TR}, g AS (SELECT CASE WHEN grouping(lang) = 0 THEN 'lang' WHEN grouping(source) = 0 THEN 'source' ELSE 'overall' END AS dimension, CASE WHEN grouping(lang) = 0 THEN lang WHEN grouping(source) = 0 THEN source ELSE 'all' END AS value,
    count(*) FILTER (found) AS found, count(*) AS trials FROM tr GROUP BY GROUPING SETS ((), (lang), (source)))
    SELECT dimension, value, found, trials, round({wilson_sql("found", "trials", Z_TWO_SIDED)}, 6) AS low, round({wilson_sql("found", "trials", Z_TWO_SIDED, True)}, 6) AS high FROM g""",
)
def a27(spark, sf_dir):
    return O.breakdown(trials(spark, sf_dir), ["lang", "source"], "found").select("dimension", "value", "found", "trials", *r6("low", "high"))


@query("a28_status_counts", "SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS f, count(*) FILTER (o_orderstatus = 'O') AS o, count(*) FILTER (o_orderstatus = 'P') AS p FROM orders GROUP BY o_orderpriority")
def a28(spark, sf_dir):
    p = table(spark, sf_dir, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).count().na.fill(0)
    return p.select("o_orderpriority", F.col("F").alias("f"), F.col("O").alias("o"), F.col("P").alias("p"))


@query(
    "a29_resource_rollup",
    """WITH s AS (SELECT l_suppkey, l_shipdate, sum(CAST(l_quantity AS DOUBLE)) AS v FROM lineitem GROUP BY ALL), m AS (SELECT l_suppkey, round(quantile_cont(v, 0.5), 6) AS median FROM s GROUP BY l_suppkey),
    c AS (SELECT l_suppkey, min((CAST(l_shipdate AS DATE) - DATE '1970-01-01', l_orderkey)) AS a, max((CAST(l_shipdate AS DATE) - DATE '1970-01-01', l_orderkey)) AS b FROM lineitem GROUP BY l_suppkey)
    SELECT l_suppkey, median, round(CASE WHEN b[1] > a[1] THEN (b[2] - a[2]) / (b[1] - a[1]) END, 6) AS rate FROM m JOIN c USING (l_suppkey)""",
)
def a29(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").select("l_suppkey", days("l_shipdate").alias("day"), F.col("l_quantity").cast("double").alias("v"), "l_orderkey")  # noqa: E741
    return O.resource_rollup(l, ["l_suppkey"], "day", "v").join(O.counter_rate(l, ["l_suppkey"], "day", "l_orderkey"), "l_suppkey").select("l_suppkey", *r6("median", "rate"))


@query("a30_exposure", f"WITH {EV} SELECT round(sum(v) / 3600, 4) AS hours FROM (SELECT max(t) - min(t) AS v FROM ev GROUP BY pod, floor(us / 86400000000))")
def a30(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("day", F.floor(F.col("us") / 86400000000))
    return O.exposure(e, ["pod", "day"], "t", "t").select(F.round(F.col("exposure") / 3600, 4).alias("hours"))


@query(
    "a31_integrity_counters",
    "SELECT l_linestatus, count(*) AS n, count(*) FILTER (l_returnflag = 'R') AS returned, max(CASE WHEN l_discount > 0.05 THEN l_linenumber END) AS worst FROM lineitem GROUP BY l_linestatus",
)
def a31(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    return l.groupBy("l_linestatus").agg(F.count("*").alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("returned"), F.max(F.when(F.col("l_discount") > 0.05, F.col("l_linenumber"))).alias("worst"))


@query(
    "a32_latency_summaries",
    f"""WITH {EV} SELECT syscall, workload, count(*) AS n, round(min(value), 6) AS least, {", ".join(f"round(quantile_cont(value, {q}), 6) AS {n}" for n, q in (("p50", 0.5), ("p90", 0.9), ("p95", 0.95), ("p99", 0.99), ("p999", 0.999)))},
    round(max(value), 6) AS largest, round(avg(CASE WHEN value >= 300 THEN 1.0 ELSE 0.0 END), 6) AS saturated FROM ev GROUP BY ALL""",
)
def a32(spark, sf_dir):
    s = summary(events(spark, sf_dir), ["syscall", "workload"], "value", 300, large=True)
    return s.select("syscall", "workload", "n", *r6(*s.columns[3:]))


_RANKS = {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99, "p999": 0.999}


@query(
    "a32_merged_days",
    f"""WITH {EV} SELECT workload, count(DISTINCT us // 86400000000) AS days, count(*) AS n, round(min(value), 6) AS least, round(max(value), 6) AS largest, {", ".join(f"true AS {p}_within" for p in _RANKS)} FROM ev GROUP BY workload""",
)
def a32_merged(spark, sf_dir):
    """Sketches of days merged for each workload; of each quantile, whether its true rank, counted over all rows, is within the stated error."""
    e = events(spark, sf_dir)
    daily = quantile_sketches(e.withColumn("day", F.floor(F.col("us") / 86400000000)), ["workload", "day"], "value")
    whole = sketched_summary(merged_sketches(daily, ["workload"]), ["workload"], _RANKS).join(daily.groupBy("workload").agg(F.count("*").alias("days")), "workload")
    below = [F.avg((F.col("value") < F.col(p)).cast("double")).alias(f"_{p}") for p in _RANKS]
    upto = [F.avg((F.col("value") <= F.col(p)).cast("double")).alias(f"{p}_") for p in _RANKS]
    ranks = e.select("workload", "value").join(whole.select("workload", *_RANKS), "workload").groupBy("workload").agg(*below, *upto)
    within = [F.lit(q).between(F.col(f"_{p}") - SKETCH_ERROR, F.col(f"{p}_") + SKETCH_ERROR).alias(f"{p}_within") for p, q in _RANKS.items()]
    return whole.join(ranks, "workload").select("workload", "days", "n", *r6("least", "largest"), *within)


@query(
    "t1_confusion",
    f"""WITH {TR}, c AS (SELECT lang, count(*) FILTER (toxic = 1 AND found) AS tp, count(*) FILTER (toxic = 1 AND NOT found) AS fn, count(*) FILTER (toxic = 0 AND found) AS fp, count(*) FILTER (toxic = 0 AND NOT found) AS tn FROM tr GROUP BY lang)
    SELECT *, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall, round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1, round(fp / nullif(fp + tn, 0), 6) AS false_rate FROM c""",
)
def t1(spark, sf_dir):
    c = O.confusion(trials(spark, sf_dir), ["lang"], F.col("toxic") == 1, F.col("found"))
    return c.select("lang", "tp", "fn", "fp", "tn", *r6("precision", "recall", "f1", "false_rate"))


ITERATIONS = 10_000


def source_blocks(spark, sf_dir):
    """(lang, block, hits, n, latency): a block for each source."""
    t = trials(spark, sf_dir)
    return t.groupBy("lang", F.col("source").alias("block")).agg(F.count_if("found").alias("hits"), F.count("*").alias("n"), F.sum("n_chars").alias("chars"), F.avg("n_chars").alias("mean_chars"))


def resampled_sql(seed: int) -> str:
    """Expressions bk (numbered blocks) and rs (drawn blocks) for bootstrap()."""
    return f"""{TR}, bl AS (SELECT lang, source AS block, count(*) FILTER (found) AS hits, count(*) AS n, sum(n_chars) AS chars, avg(n_chars) AS mean_chars FROM tr GROUP BY ALL),
    bk AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY block) - 1 AS k, count(*) OVER (PARTITION BY lang) AS size FROM bl),
    dr AS (SELECT lang, iter, {O.drawn_sql(seed, "size")} AS k FROM (SELECT DISTINCT lang, size FROM bk) s, unnest(generate_series(0, {ITERATIONS - 1})) AS i(iter), unnest(generate_series(0, size - 1)) AS j(slot)),
    rs AS (SELECT bk.*, dr.iter FROM dr JOIN bk USING (lang, k))"""


_CI = "SELECT lang, round(quantile_cont(v, 0.025), 6) AS low, round(quantile_cont(v, 0.975), 6) AS high FROM e GROUP BY lang"


@query("t2_bootstrap_median", f"WITH {resampled_sql(11)}, e AS (SELECT lang, iter, quantile_cont(mean_chars, 0.5) AS v FROM rs GROUP BY ALL) {_CI}")
def t2(spark, sf_dir):
    drawn = O.bootstrap(source_blocks(spark, sf_dir), ["lang"], {"v": ("median", "mean_chars")}, ITERATIONS, 11)
    return O.interval(drawn, ["lang"], "v").select("lang", *r6("low", "high"))


@query("t3_block_bootstrap", f"WITH {resampled_sql(12)}, e AS (SELECT lang, iter, sum(hits) / sum(n) AS v FROM rs GROUP BY ALL) {_CI}")
def t3(spark, sf_dir):
    drawn = O.bootstrap(source_blocks(spark, sf_dir), ["lang"], {"hits": ("sum", "hits"), "n": ("sum", "n")}, ITERATIONS, 12)
    return O.interval(drawn.withColumn("v", F.col("hits") / F.col("n")), ["lang"], "v").select("lang", *r6("low", "high"))


@query("t4_rate_bootstrap", f"WITH {resampled_sql(13)}, e AS (SELECT lang, iter, 1000 * sum(hits) / sum(chars) AS v FROM rs GROUP BY ALL) {_CI}")
def t4(spark, sf_dir):
    drawn = O.bootstrap(source_blocks(spark, sf_dir), ["lang"], {"hits": ("sum", "hits"), "chars": ("sum", "chars")}, ITERATIONS, 13)
    return O.interval(drawn.withColumn("v", 1000 * F.col("hits") / F.col("chars")), ["lang"], "v").select("lang", *r6("low", "high"))


@query(
    "t5_two_sample_bootstrap",
    f"""WITH {resampled_sql(14)}, m AS (SELECT lang, iter, quantile_cont(mean_chars, 0.5) AS v FROM rs GROUP BY ALL),
    e AS (SELECT o.lang, o.iter, 100 * (o.v / b.v - 1) AS v FROM m o JOIN m b ON b.iter = o.iter AND b.lang = 'en' WHERE o.lang <> 'en') {_CI}""",
)
def t5(spark, sf_dir):
    """Per cent of difference between the medians of an arm and the base arm."""
    m = O.bootstrap(source_blocks(spark, sf_dir), ["lang"], {"m": ("median", "mean_chars")}, ITERATIONS, 14)
    base = m.filter("lang = 'en'").select("iter", F.col("m").alias("b"))
    return O.interval(m.filter("lang <> 'en'").join(base, "iter").select("lang", (100 * (F.col("m") / F.col("b") - 1)).alias("v")), ["lang"], "v").select("lang", *r6("low", "high"))


PAIRED = f"{TR}, pt AS (SELECT source, count(*) FILTER (found AND quality = 0) AS a_only, count(*) FILTER (NOT found AND quality = 1) AS b_only, count(*) FILTER (found AND quality = 1) AS both, count(*) FILTER (NOT found AND quality = 0) AS neither FROM tr GROUP BY source)"


def paired(spark, sf_dir):
    return O.paired_table(trials(spark, sf_dir).withColumn("good", F.col("quality") == 1), ["source"], "found", "good")


MCNEMAR_SQL = "CASE WHEN a_only + b_only = 0 THEN 1.0 ELSE least(1.0, 2 * list_sum([exp(lgamma(a_only + b_only + 1.0) - lgamma(i + 1.0) - lgamma(a_only + b_only - i + 1.0) - (a_only + b_only) * ln(2.0)) FOR i IN generate_series(0, least(a_only, b_only))])) END"


@query("t6_mcnemar", f"WITH {PAIRED} SELECT source, round({MCNEMAR_SQL} + 1e-9, 6) AS p FROM pt")
def t6(spark, sf_dir):
    return paired(spark, sf_dir).select("source", F.round(O.mcnemar(F.col("a_only"), F.col("b_only")) + 1e-9, 6).alias("p"))


@query(
    "t7_sign_flips",
    """WITH d AS (SELECT s_nationkey, CAST(s_acctbal AS DOUBLE) - 3000 AS v, row_number() OVER (PARTITION BY s_nationkey ORDER BY CAST(s_acctbal AS DOUBLE)) - 1 AS k FROM supplier),
    z AS (SELECT s_nationkey, count(*) AS n, abs(avg(v)) AS seen FROM d GROUP BY s_nationkey HAVING count(*) <= 12), m AS (SELECT s_nationkey, n, seen, m FROM z, unnest(generate_series(0, (1 << n) - 1)) AS g(m)),
    x AS (SELECT s_nationkey, n, seen, m, abs(avg(CASE WHEN (m >> k) & 1 = 1 THEN -v ELSE v END)) AS a FROM m JOIN d USING (s_nationkey) GROUP BY ALL)
    SELECT s_nationkey, n, round(avg(CASE WHEN a >= seen - 1e-9 THEN 1.0 ELSE 0.0 END), 6) AS p FROM x GROUP BY ALL""",
)
def t7(spark, sf_dir):
    d = table(spark, sf_dir, "supplier").select("s_nationkey", (F.col("s_acctbal").cast("double") - 3000).alias("v"))
    return O.sign_flip(d, ["s_nationkey"], "v").select("s_nationkey", "n", *r6("p"))


@query(
    "t7_whole_units",
    """WITH d AS (SELECT s_nationkey, CAST(floor(CAST(s_acctbal AS DOUBLE) / 100) AS BIGINT) - 30 AS v FROM supplier),
    g AS (SELECT s_nationkey, count(*) AS n, CAST(abs(sum(v)) AS BIGINT) AS seen, CAST(sum(abs(v)) AS BIGINT) AS reach, list(v) AS vs FROM d GROUP BY s_nationkey),
    c AS (SELECT *, list_reduce(list_prepend([CASE WHEN i = reach THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END FOR i IN range(2 * reach + 1)], list_transform(vs, lambda v: [v::DOUBLE])),
      lambda p, v: [0.5 * coalesce(p[CAST(i - v[1] AS BIGINT)], 0) * (i - v[1] >= 1)::INT + 0.5 * coalesce(p[CAST(i + v[1] AS BIGINT)], 0) * (i + v[1] >= 1)::INT FOR i IN range(1, len(p) + 1)]) AS p FROM g)
    SELECT s_nationkey, n, round(list_sum([p[CAST(i AS BIGINT)] * (abs(i - 1 - reach) >= seen)::INT FOR i IN range(1, len(p) + 1)]), 6) AS p FROM c""",
)
def t7_whole(spark, sf_dir):
    """T7 of differences in whole hundreds, whose sums SQL can count for groups of any size."""
    d = table(spark, sf_dir, "supplier").select("s_nationkey", (F.floor(F.col("s_acctbal").cast("double") / 100) - 30).alias("v"))
    return O.sign_flip(d, ["s_nationkey"], "v").select("s_nationkey", "n", *r6("p"))


@query(
    "t8_holm",
    f"""WITH {PAIRED}, p AS (SELECT source, {MCNEMAR_SQL} AS p FROM pt), s AS (SELECT *, least(1.0, p * (count(*) OVER () - row_number() OVER (ORDER BY round(p, 9), source) + 1)) AS s FROM p)
    SELECT source, round(max(s) OVER (ORDER BY round(p, 9), source ROWS UNBOUNDED PRECEDING), 6) AS adjusted FROM s""",
)
def t8(spark, sf_dir):
    p = paired(spark, sf_dir).select(F.lit(1).alias("family"), "source", F.round(O.mcnemar(F.col("a_only"), F.col("b_only")), 9).alias("p"))
    return O.holm(p, ["family"], "p", "source").select("source", *r6("adjusted"))


@query("t9_paired_tables", f"WITH {PAIRED} SELECT * FROM pt")
def t9(spark, sf_dir):
    return paired(spark, sf_dir)


@query(
    "t9_latency_leads",
    f"""WITH {TR} SELECT source, count(*) FILTER (found AND quality = 1) AS both, round(quantile_cont(CASE WHEN found AND quality = 1 THEN n_chars / 1000.0 - (doc_id % 97) / 10.0 END, 0.5), 6) AS lead FROM tr GROUP BY source""",
)
def t9_leads(spark, sf_dir):
    """How much later one method finds what both find."""
    t = trials(spark, sf_dir).withColumn("good", F.col("quality") == 1).withColumn("la", F.col("n_chars") / 1000.0).withColumn("lb", (F.col("doc_id") % 97) / 10.0)
    return O.paired_table(t, ["source"], "found", "good", ("la", "lb")).select("source", "both", *r6("lead"))


@query(
    "t10_restricted_times",
    f"""WITH {TR} SELECT lang, round(avg(CASE WHEN found THEN n_chars / 1000.0 ELSE 10.0 END), 6) AS restricted, {", ".join(f"round(avg(CASE WHEN found AND n_chars / 1000.0 <= {c} THEN 1.0 ELSE 0.0 END), 6) AS by_{i}" for i, c in enumerate((1.6, 2.0, 3.0, 5.0, 8.0, 20.0)))} FROM tr GROUP BY lang""",
)
def t10(spark, sf_dir):
    t = trials(spark, sf_dir).withColumn("latency", F.col("n_chars") / 1000.0).withColumn("censor", F.lit(10.0))
    r = O.restricted_time(t, ["lang"], "found", "latency", "censor", [1.6, 2.0, 3.0, 5.0, 8.0, 20.0])
    return r.select("lang", *r6(*r.columns[1:]))


@query(
    "t11_overhead",
    """WITH o AS (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS k, CAST(s_acctbal AS DOUBLE) + 10000 AS v FROM supplier),
    b AS (SELECT s_nationkey, (k - 1) // 2 AS block, max(v) FILTER (k % 2 = 1) AS off_v, max(v) FILTER (k % 2 = 0) AS on_v FROM o GROUP BY ALL)
    SELECT s_nationkey, round(quantile_cont(100 * (1 - on_v / off_v), 0.5), 6) AS loss FROM b WHERE on_v IS NOT NULL GROUP BY s_nationkey""",
)
def t11(spark, sf_dir):
    """Median per cent of loss between the two rows of each block."""
    b = adjacent_pairs(table(spark, sf_dir, "supplier").withColumn("v", F.col("s_acctbal").cast("double") + 10000), ["s_nationkey"], "s_suppkey", "v")
    return b.filter("on is not null").groupBy("s_nationkey").agg(F.round(F.percentile(100 * (1 - F.col("on") / F.col("off")), 0.5), 6).alias("loss"))


@query(
    "t11_overhead_intervals",
    f"""WITH o AS (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS i, CAST(s_acctbal AS DOUBLE) + 10000 AS v, 5 + s_suppkey * 37 % 101 / 10.0 AS ms, s_nationkey % 5 AS r FROM supplier),
    b AS (SELECT r, s_nationkey * 1000000 + (i - 1) // 2 AS block, max(v) FILTER (i % 2 = 1) AS off_v, max(v) FILTER (i % 2 = 0) AS on_v, max(ms) FILTER (i % 2 = 1) AS off_ms, max(ms) FILTER (i % 2 = 0) AS on_ms FROM o GROUP BY ALL),
    x AS (SELECT r, block, 100 * (1 - on_v / off_v) AS loss, 100 * (on_ms / off_ms - 1) AS rise FROM b WHERE on_v IS NOT NULL),
    bk AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY block) - 1 AS k, count(*) OVER (PARTITION BY r) AS size FROM x),
    dr AS (SELECT r, iter, {O.drawn_sql(15, "size")} AS k FROM (SELECT DISTINCT r, size FROM bk) s, unnest(generate_series(0, {ITERATIONS - 1})) AS i(iter), unnest(generate_series(0, size - 1)) AS j(slot)),
    e AS (SELECT r, iter, quantile_cont(loss, 0.5) AS loss, quantile_cont(rise, 0.5) AS rise FROM dr JOIN bk USING (r, k) GROUP BY ALL),
    c AS (SELECT r, quantile_cont(loss, 0.025) AS loss_low, quantile_cont(loss, 0.975) AS loss_high, quantile_cont(rise, 0.025) AS rise_low, quantile_cont(rise, 0.975) AS rise_high FROM e GROUP BY r),
    m AS (SELECT r, count(*) AS blocks, quantile_cont(loss, 0.5) AS loss, quantile_cont(rise, 0.5) AS rise FROM x GROUP BY r)
    SELECT r, blocks, round(loss, 6) AS loss, round(rise, 6) AS rise, round(loss_low, 6) AS loss_low, round(loss_high, 6) AS loss_high, round(rise_low, 6) AS rise_low, round(rise_high, 6) AS rise_high FROM m JOIN c USING (r)""",
)
def t11_intervals(spark, sf_dir):
    """Throughput lost and latency gained in blocks of an off and an on row, with intervals."""
    s = table(spark, sf_dir, "supplier").select("s_nationkey", "s_suppkey", (F.col("s_acctbal").cast("double") + 10000).alias("v"), (5 + F.col("s_suppkey") * 37 % 101 / 10.0).alias("ms"))
    rate = adjacent_pairs(s, ["s_nationkey"], "s_suppkey", "v").select("s_nationkey", "block", F.col("off").alias("off_v"), F.col("on").alias("on_v"))
    both = rate.join(adjacent_pairs(s, ["s_nationkey"], "s_suppkey", "ms"), ["s_nationkey", "block"]).filter("on_v is not null")
    b = both.withColumn("r", F.col("s_nationkey") % 5).withColumn("id", F.col("s_nationkey") * 1000000 + F.col("block"))
    o = O.overhead(b, ["r"], "id", ("off_v", "on_v"), ("off", "on"), ITERATIONS, 15)
    return o.select("r", "blocks", *r6(*o.columns[2:]))


@query(
    "t12_block_sensitivity",
    f"""WITH {TR}, b AS (SELECT lang, source, bool_or(toxic = 1) AS any_alert FROM tr GROUP BY ALL), c AS (SELECT lang, count(*) FILTER (any_alert) AS k, count(*) AS n FROM b GROUP BY lang)
    SELECT lang, k, n, round({wilson_sql("k", "n", Z_TWO_SIDED)}, 6) AS low FROM c""",
)
def t12(spark, sf_dir):
    b = trials(spark, sf_dir).groupBy("lang", "source").agg(F.bool_or(F.col("toxic") == 1).alias("any_alert")).groupBy("lang").agg(F.count_if("any_alert").alias("k"), F.count("*").alias("n"))
    return b.select("lang", "k", "n", F.round(wilson(F.col("k"), F.col("n"), Z_TWO_SIDED), 6).alias("low"))


@query(
    "t13_eligible_windows",
    "SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') + count(*) FILTER (o_orderstatus = 'O' AND o_totalprice > 100000) AS eligible FROM orders GROUP BY o_orderpriority",
)
def t13(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.groupBy("o_orderpriority").agg((F.count_if(F.col("o_orderstatus") == "F") + F.count_if((F.col("o_orderstatus") == "O") & (F.col("o_totalprice") > 100000))).alias("eligible"))


@query(
    "t14_pooled_campaigns",
    f"""WITH {TR} SELECT toxic, count(DISTINCT lang) AS nodes, count(DISTINCT source) AS endpoints, count(DISTINCT lang) >= 2 AND count(DISTINCT source) >= 2 AS independent, round(avg(n_chars), 6) AS effect FROM tr GROUP BY toxic""",
)
def t14(spark, sf_dir):
    t = trials(spark, sf_dir).groupBy("toxic").agg(F.countDistinct("lang").alias("nodes"), F.countDistinct("source").alias("endpoints"), F.avg("n_chars").alias("effect"))
    return t.select("toxic", "nodes", "endpoints", ((F.col("nodes") >= 2) & (F.col("endpoints") >= 2)).alias("independent"), *r6("effect"))


@query(
    "t14_pooled_effects",
    f"""WITH {TR}, b AS (SELECT doc_id % 3 AS campaign, lang, doc_id % 2 AS arm, round(avg(n_chars) FILTER (quality = 1) - avg(n_chars) FILTER (quality = 0), 3) AS effect, min(source) AS endpoint FROM tr GROUP BY ALL),
    d AS (SELECT arm, effect AS v, lang, endpoint, campaign, row_number() OVER (PARTITION BY arm ORDER BY effect) - 1 AS k FROM b WHERE effect IS NOT NULL),
    z AS (SELECT arm, count(*) AS n, abs(avg(v)) AS seen FROM d GROUP BY arm), m AS (SELECT arm, n, seen, m FROM z, unnest(generate_series(0, (1 << n) - 1)) AS g(m)),
    x AS (SELECT arm, seen, m, abs(avg(CASE WHEN (m >> k) & 1 = 1 THEN -v ELSE v END)) AS a FROM m JOIN d USING (arm) GROUP BY ALL),
    p AS (SELECT arm, avg(CASE WHEN a >= seen - 1e-9 THEN 1.0 ELSE 0.0 END) AS p FROM x GROUP BY arm)
    SELECT arm, count(*) AS blocks, count(DISTINCT campaign) AS campaigns, count(DISTINCT campaign) >= 2 AND count(DISTINCT lang) >= 2 AND count(DISTINCT endpoint) >= 2 AS independent, round(avg(v), 6) AS effect, round(any_value(p), 6) AS p
    FROM d JOIN p USING (arm) GROUP BY arm""",
)
def t14_effects(spark, sf_dir):
    """Three campaigns of a trial on different dates, nodes and endpoints as one sample, with a sign-flip test over their blocks."""
    good, bad = (F.avg(F.when(F.col("quality") == q, F.col("n_chars"))) for q in (1, 0))
    b = trials(spark, sf_dir).groupBy((F.col("doc_id") % 3).alias("date"), "lang", (F.col("doc_id") % 2).alias("arm")).agg(F.round(good - bad, 3).alias("effect"), F.min("source").alias("endpoint")).filter("effect is not null")
    return O.pooled({f"c{k}": b.filter(F.col("date") == k) for k in range(3)}, ["arm"], "effect", ["date", "lang", "endpoint"]).select("arm", "blocks", "campaigns", "independent", *r6("effect", "p"))


@query(
    "t15_maxima_after_injection",
    f"""WITH {EV}, i AS (SELECT pod, min(us) AS started FROM ev WHERE syscall = 'execve' GROUP BY pod) SELECT pod, round(max(value), 6) AS top_value, max(us) AS last_us FROM ev JOIN i USING (pod) WHERE us > started GROUP BY pod""",
)
def t15(spark, sf_dir):
    e = events(spark, sf_dir)
    i = e.filter("syscall = 'execve'").groupBy("pod").agg(F.min("us").alias("started"))
    return e.join(i, "pod").filter("us > started").groupBy("pod").agg(F.round(F.max("value"), 6).alias("top_value"), F.max("us").alias("last_us"))
