"""Queries on features, profiles, graphs and robust limits."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tracewright.functions.syscalls import BEHAVIOUR_SYSCALLS, Z_TWO_SIDED, wilson, wilson_sql
from tracewright.operators import features as O
from tracewright.operators import robust as R
from tracewright.operators.windows import aligned_windows
from tracewright.plans.identity import AGENT_SQL, agent_messages, parse_agent_messages
from tracewright.registry import query
from tracewright.sources.files import scratch
from tracewright.sources.tables import EV, events, table

WIN = ["workload", "win"]
WEV = f"{EV}, wv AS (SELECT *, CAST(floor(us / 21600000000) AS BIGINT) AS win FROM ev)"
_NAMES = ", ".join(f"'{n}'" for n in BEHAVIOUR_SYSCALLS)
FREQ = f"{WEV}, cn AS (SELECT workload, win, syscall, count(*) AS n FROM wv GROUP BY ALL), fr AS (SELECT *, sum(n) OVER (PARTITION BY workload, win) AS total FROM cn)"


def windowed(spark, sf_dir):
    return aligned_windows(events(spark, sf_dir), "us", 6 * 3600)


def window_counts(spark, sf_dir):
    """(workload, win, syscall, n, top, amount) of each window and call, written once for plans that read it several times."""
    path = scratch(spark, "window-counts")
    w = windowed(spark, sf_dir).groupBy(*WIN, "syscall").agg(F.count("*").alias("n"), F.max("value").alias("top"), F.sum("value").alias("amount"))
    w.write.parquet(path)
    return spark.read.schema(w.schema).parquet(path)


def frequencies(spark, sf_dir, counts=None):
    """(workload, win, syscall, n, total, freq); counts are window_counts, if they are there."""
    if counts is None:
        rows = O.syscall_counts(windowed(spark, sf_dir), WIN, "syscall")
    else:
        rows = counts.select(*WIN, "syscall", "n").withColumn("total", F.sum("n").over(Window.partitionBy(*WIN)))
    return rows.withColumn("freq", F.col("n") / F.col("total"))


@query(
    "a1_vocabulary",
    f"""WITH {EV}, n AS (SELECT DISTINCT syscall AS a FROM ev), t AS (SELECT 0 AS kind, a, '' AS b, a AS term FROM n UNION ALL SELECT 1, x.a, y.a, x.a || '|' || y.a FROM n x, n y)
    SELECT term, CAST(row_number() OVER (ORDER BY kind, a, b) - 1 AS INT) AS idx FROM t""",
)
def a1(spark, sf_dir):
    return O.vocabulary(events(spark, sf_dir), "syscall")


@query(
    "a2_extended_vocabulary",
    f"""WITH {EV}, v AS (SELECT syscall AS term, CAST(row_number() OVER (ORDER BY syscall) - 1 AS INT) AS idx FROM (SELECT DISTINCT syscall FROM ev WHERE syscall <> 'read')),
    r AS (SELECT DISTINCT lower(n_name) AS term FROM nation UNION SELECT 'read'), m AS (SELECT term FROM r WHERE term NOT IN (SELECT term FROM v))
    SELECT term, idx FROM v UNION ALL SELECT term, CAST((SELECT max(idx) FROM v) + row_number() OVER (ORDER BY term) AS INT) FROM m""",
)
def a2(spark, sf_dir):
    v = O.vocabulary(events(spark, sf_dir).filter("syscall <> 'read'"), "syscall").filter(~F.col("term").contains("|"))
    required = table(spark, sf_dir, "nation").select(F.lower("n_name").alias("name")).union(spark.createDataFrame([("read",)], "name string"))
    return O.extend_vocabulary(v, required, "name")


@query(
    "a3_ngram_vectors",
    f"""WITH {WEV}, x AS (SELECT *, lead(syscall) OVER (PARTITION BY workload, win ORDER BY us, event_id) AS nx, count(*) OVER (PARTITION BY workload, win) AS n FROM wv),
    t AS (SELECT workload, win, n, syscall AS term FROM x UNION ALL SELECT workload, win, n, syscall || '|' || nx FROM x WHERE nx IS NOT NULL)
    SELECT workload, win, term, round(count(*) / any_value(n), 6) AS weight FROM t GROUP BY workload, win, term""",
)
def a3(spark, sf_dir):
    return O.ngram_weights(windowed(spark, sf_dir), WIN, ["us", "event_id"], "syscall").withColumn("weight", F.round("weight", 6))


@query("a4_syscall_counts", f"WITH {FREQ} SELECT workload, win, syscall, n, CAST(total AS BIGINT) AS total FROM fr")
def a4(spark, sf_dir):
    return frequencies(spark, sf_dir).drop("freq")


@query(
    "a5_top_syscalls",
    f"""WITH {FREQ} SELECT workload, win, syscall, rank, round(n / total, 6) AS freq FROM
    (SELECT *, CAST(row_number() OVER (PARTITION BY workload, win ORDER BY n DESC, syscall) AS INT) AS rank FROM fr) WHERE rank <= 3""",
)
def a5(spark, sf_dir):
    return O.top_syscalls(frequencies(spark, sf_dir), WIN, "syscall", 3).select(*WIN, "syscall", "rank", F.round("freq", 6).alias("freq"))


@query(
    "a6_explained_signals",
    f"""WITH {FREQ} SELECT workload, win, syscall, round(n / total, 6) AS freq, round({wilson_sql("n", "total")}, 6) AS low, CASE WHEN syscall IN ({_NAMES}) THEN 'suspicious' ELSE 'normal' END AS label FROM
    (SELECT *, row_number() OVER (PARTITION BY workload, win ORDER BY n DESC, syscall) AS rank FROM fr) WHERE rank <= 8""",
)
def a6(spark, sf_dir):
    top = O.top_syscalls(frequencies(spark, sf_dir), WIN, "syscall", 8)
    return top.select(*WIN, "syscall", F.round("freq", 6).alias("freq"), F.round(wilson(F.col("n"), F.col("total")), 6).alias("low"), F.when(F.col("syscall").isin(*BEHAVIOUR_SYSCALLS), "suspicious").otherwise("normal").alias("label"))


@query(
    "a7_profiles",
    f"""WITH {EV}, b AS (SELECT workload, lag(syscall) OVER (PARTITION BY pod ORDER BY us, event_id) AS before, syscall FROM ev),
    c AS (SELECT workload, before, syscall, count(*) AS n FROM b WHERE before IS NOT NULL GROUP BY ALL)
    SELECT workload, before, syscall, n, round(n / sum(n) OVER (PARTITION BY workload, before), 6) AS p FROM c""",
)
def a7(spark, sf_dir):
    return O.profile(events(spark, sf_dir), "pod", "workload", ["us", "event_id"], "syscall").withColumn("p", F.round("p", 6))


@query("a7_unigrams", f"WITH {EV} SELECT workload, syscall, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY workload), 6) AS p FROM ev GROUP BY workload, syscall")
def a7_unigrams(spark, sf_dir):
    return O.unigrams(events(spark, sf_dir), "workload", "syscall").withColumn("p", F.round("p", 6))


@query(
    "a8_bin_distributions",
    """WITH b AS (SELECT l_suppkey, ((l_partkey * 2654435761) & 4294967295) >> 26 AS bin, count(*) AS n FROM lineitem GROUP BY ALL) SELECT l_suppkey, bin, n, round(n / sum(n) OVER (PARTITION BY l_suppkey), 6) AS p FROM b""",
)
def a8(spark, sf_dir):
    return O.bin_distribution(table(spark, sf_dir, "lineitem"), "l_suppkey", "l_partkey").withColumn("p", F.round("p", 6))


@query("a9_suspicious_mass", f"WITH {WEV} SELECT workload, win, round(count(*) FILTER (syscall IN ({_NAMES})) / count(*), 6) AS mass FROM wv GROUP BY ALL")
def a9(spark, sf_dir):
    return O.suspicious_mass(windowed(spark, sf_dir), WIN, "syscall").withColumn("mass", F.round("mass", 6))


@query(
    "a10_wilson_bounds",
    f"""SELECT c_nationkey, count(*) AS n, round({wilson_sql("count(*) FILTER (c_acctbal < 0)", "count(*)")}, 6) AS one_sided,
    round({wilson_sql("count(*) FILTER (c_acctbal < 0)", "count(*)", Z_TWO_SIDED)}, 6) AS low, round({wilson_sql("count(*) FILTER (c_acctbal < 0)", "count(*)", Z_TWO_SIDED, True)}, 6) AS high FROM customer GROUP BY c_nationkey""",
)
def a10(spark, sf_dir):
    c = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n"), F.count_if(F.col("c_acctbal") < 0).alias("k"))
    k, n = F.col("k"), F.col("n")
    return c.select("c_nationkey", "n", F.round(wilson(k, n), 6).alias("one_sided"), F.round(wilson(k, n, Z_TWO_SIDED), 6).alias("low"), F.round(wilson(k, n, Z_TWO_SIDED, True), 6).alias("high"))


def mad_sql(rows: str, key: str, value: str, more: str = "") -> str:
    """Common table expressions s1 and st: (key, n, med, ..., mad) of rows."""
    return f"""s1 AS (SELECT {key}, count({value}) AS n, quantile_cont({value}, 0.5) AS med{more} FROM {rows} GROUP BY {key}),
    st AS (SELECT s1.*, d.mad FROM s1 JOIN (SELECT {key}, quantile_cont(abs({value} - med), 0.5) AS mad FROM {rows} JOIN s1 USING ({key}) GROUP BY {key}) d USING ({key}))"""


def train_frequencies(spark, sf_dir, counts=None):
    return frequencies(spark, sf_dir, counts).filter(F.col("win") % 2 == 0)


LIMITS_SQL = f"""{FREQ}, tf AS (SELECT workload, syscall, n / total AS freq FROM fr WHERE win % 2 = 0 AND syscall IN ({_NAMES})),
  {mad_sql("tf", "workload, syscall", "freq", ", quantile_cont(freq, 0.5) AS top")},
  lm AS (SELECT workload, syscall, least(0.95, greatest(0.20, top + greatest(0.02, 0.5 * 1.4826 * mad))) AS limit_value FROM st)"""


def limits(spark, sf_dir, counts=None):
    return R.behaviour_limits(train_frequencies(spark, sf_dir, counts), "workload", "syscall", "freq", q=0.5, floor=0.20, deviations=0.5)


@query("a11_behaviour_limits", f"WITH {LIMITS_SQL} SELECT workload, syscall, round(limit_value, 6) AS limit_value FROM lm")
def a11(spark, sf_dir):
    return limits(spark, sf_dir).withColumn("limit_value", F.round("limit_value", 6))


@query(
    "a12_tail_scale",
    f"""WITH {EV}, {mad_sql("ev", "workload", "value", ", quantile_cont(value, 0.99) AS top")}, l AS (SELECT *, greatest(top, med + 6 * 1.4826 * mad) AS tail_limit FROM st)
    SELECT workload, round(tail_limit, 6) AS tail_limit, round(greatest(tail_limit - med, abs(tail_limit) * 0.1, 1e-6), 6) AS tail_scale FROM l""",
)
def a12(spark, sf_dir):
    return R.tail_scale(events(spark, sf_dir), ["workload"], "value").select("workload", F.round("tail_limit", 6).alias("tail_limit"), F.round("tail_scale", 6).alias("tail_scale"))


SCORED = f"{EV}, sc AS (SELECT *, least(1.0, value / 400) AS score FROM ev)"


def scores(spark, sf_dir):
    return events(spark, sf_dir).withColumn("score", F.least(F.lit(1.0), F.col("value") / 400))


@query(
    "a13_thresholds",
    f"""WITH {SCORED}, {mad_sql("sc", "pod", "score", ", quantile_cont(score, 0.995) AS top")}
    SELECT pod, n, round(CASE WHEN n < 60 THEN 0.3 ELSE least(0.995, greatest(0.3, top + 0.5 * greatest(mad, 0.001))) END, 6) AS score_limit FROM st""",
)
def a13(spark, sf_dir):
    return R.threshold(scores(spark, sf_dir), ["pod"], "score", 0.3, min_samples=60).select("pod", "n", F.round("limit", 6).alias("score_limit"))


@query("a14_pareto_thresholds")
def a14(spark, sf_dir):
    return R.pareto_threshold(scores(spark, sf_dir), "workload", "score", 0.3).withColumn("limit", F.round("limit", 6))


@query(
    "a15_agent_thresholds",
    f"""WITH {SCORED}, u AS (SELECT workload, quantile_cont(score, 0.9) AS u FROM sc GROUP BY workload)
    SELECT workload, round(greatest(0.3, quantile_cont(score, 0.995) + 0.25), 6) AS score_limit FROM sc JOIN u USING (workload) WHERE score >= u GROUP BY workload""",
)
def a15(spark, sf_dir):
    return R.agent_threshold(scores(spark, sf_dir), "workload", "score", 0.3).select("workload", F.round("limit", 6).alias("score_limit"))


@query(
    "a16_event_bounds",
    f"""WITH {WEV}, c AS (SELECT workload, win, count(*) AS n FROM wv GROUP BY ALL)
    SELECT workload, greatest(1, CAST(floor(quantile_cont(n, 0.1) * 0.5) AS BIGINT)) AS low, greatest(1, CAST(ceil(quantile_cont(n, 0.99) * 2) AS BIGINT)) AS high FROM c GROUP BY workload""",
)
def a16(spark, sf_dir):
    return R.event_bounds(windowed(spark, sf_dir).groupBy(*WIN).agg(F.count("*").alias("n")), "workload", "n")


@query(
    "a17_robust_baselines",
    f"""WITH e AS (SELECT label, CAST(i - 1 AS INT) AS feature, CAST(embedding[i] AS DOUBLE) AS x FROM embeddings, unnest(generate_series(1, 64)) AS g(i)), {mad_sql("e", "label, feature", "x")}
    SELECT label, feature, round(med, 6) AS med, round(greatest(mad, 0.05), 6) AS mad FROM st WHERE n >= 3""",
)
def a17(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("feature", "x")).withColumn("x", F.col("x").cast("double"))
    return R.robust_baseline(e, ["label", "feature"], "x").select("label", "feature", F.round("med", 6).alias("med"), F.round("mad", 6).alias("mad"))


GROUPS = {"process": ["execve"], "network": ["connect"], "privilege": ["setuid", "execve"]}


def group_counts(spark, sf_dir):
    return windowed(spark, sf_dir).groupBy(*WIN).pivot("syscall", ["execve", "connect", "setuid", "read", "write"]).count().na.fill(0)


_PIV = ", ".join(f"count(*) FILTER (syscall = '{s}') AS {s}" for s in ("execve", "connect", "setuid"))
ENVELOPE_SQL = f"""{WEV}, pv AS (SELECT workload, win, {_PIV} FROM wv GROUP BY ALL),
  gv AS (SELECT workload, win, 'process' AS grp, execve AS v FROM pv UNION ALL SELECT workload, win, 'network', connect FROM pv UNION ALL SELECT workload, win, 'privilege', setuid + execve FROM pv),
  em AS (SELECT workload, grp, max(v) AS normal_max FROM gv WHERE win % 3 <> 0 GROUP BY ALL)"""


@query("a18_envelopes", f"WITH {ENVELOPE_SQL} SELECT workload, grp, normal_max FROM em")
def a18(spark, sf_dir):
    return R.envelope(group_counts(spark, sf_dir).filter(F.col("win") % 3 != 0), "workload", GROUPS)


@query(
    "a19_extended_envelopes",
    f"""WITH {ENVELOPE_SQL}, nw AS (SELECT workload, grp, max(v) AS v FROM gv WHERE win % 3 = 0 GROUP BY ALL)
    SELECT workload, grp, greatest(normal_max, v) AS normal_max, greatest(normal_max, v) IS DISTINCT FROM normal_max AS changed FROM em FULL JOIN nw USING (workload, grp)""",
)
def a19(spark, sf_dir):
    g = group_counts(spark, sf_dir)
    return R.extend_envelope(R.envelope(g.filter(F.col("win") % 3 != 0), "workload", GROUPS), R.envelope(g.filter(F.col("win") % 3 == 0), "workload", GROUPS), "workload")


_QS = ", ".join(f"round(quantile_cont(v, {q}), 6) AS {n}" for n, q in (("p50", 0.5), ("p90", 0.9), ("p95", 0.95), ("p99", 0.99), ("p999", 0.999)))


@query("a20_summaries", f"SELECT l_suppkey, count(v) AS n, round(min(v), 6) AS least, {_QS}, round(max(v), 6) AS largest, round(avg(CASE WHEN v >= 90000 THEN 1.0 ELSE 0.0 END), 6) AS saturated FROM (SELECT l_suppkey, CAST(l_extendedprice AS DOUBLE) AS v FROM lineitem) GROUP BY l_suppkey")
def a20(spark, sf_dir):
    s = R.summary(table(spark, sf_dir, "lineitem").withColumn("v", F.col("l_extendedprice").cast("double")), ["l_suppkey"], "v", 90000)
    return s.select("l_suppkey", "n", *[F.round(c, 6).alias(c) for c in s.columns[2:]])


def graph(spark, sf_dir):
    m = parse_agent_messages(agent_messages(spark, sf_dir)).withColumn("agent", F.concat(F.lit("a"), F.col("conv_id").cast("string")))
    return m.withColumn("pod", F.concat(F.lit("p"), (F.col("conv_id") % 7).cast("string"))).withColumn("t", F.col("turn") * F.lit(1.5))


GRAPH_SQL = f"""{AGENT_SQL}, gm AS (SELECT *, 'a' || conv_id AS agent, 'p' || (conv_id % 7) AS pod, turn * 1.5 AS t FROM calls),
  ed AS (SELECT pod AS src, agent AS dst, 'hosts' AS kind, count(*) AS n FROM gm GROUP BY ALL UNION ALL SELECT agent, tool, 'calls', count(*) FROM gm GROUP BY ALL
    UNION ALL SELECT tool, r, 'touches', count(*) FROM (SELECT tool, unnest(resources) AS r FROM gm) GROUP BY ALL)"""


def edges(spark, sf_dir):
    return O.graph_edges(graph(spark, sf_dir), "pod", "agent", "tool", "resources")


@query("a21_graph_edges", f"WITH {GRAPH_SQL} SELECT src, dst, kind, n FROM ed")
def a21(spark, sf_dir):
    return edges(spark, sf_dir)


@query(
    "a22_graph_nodes",
    f"""WITH {GRAPH_SQL} SELECT DISTINCT * FROM (SELECT src AS node, CASE kind WHEN 'hosts' THEN 'pod' WHEN 'calls' THEN 'agent' ELSE 'tool' END AS kind FROM ed
    UNION ALL SELECT dst, CASE kind WHEN 'hosts' THEN 'agent' WHEN 'calls' THEN 'tool' ELSE 'resource' END FROM ed)""",
)
def a22(spark, sf_dir):
    return O.graph_nodes(edges(spark, sf_dir))


@query(
    "a23_graph_features",
    f"""WITH {GRAPH_SQL}, tk AS (SELECT pod, tool, count(*) AS k FROM gm GROUP BY ALL), tp AS (SELECT *, k / sum(k) OVER (PARTITION BY pod) AS p FROM tk),
    en AS (SELECT pod, max(k) AS max_tool_calls, round(-sum(p * log2(p)), 6) + 0.0 AS tool_entropy FROM tp GROUP BY pod),
    rk AS (SELECT pod, r, count(*) AS k FROM (SELECT pod, unnest(resources) AS r FROM gm) GROUP BY ALL), rs AS (SELECT pod, count(*) AS resources, max(k) AS max_resource_touches FROM rk GROUP BY pod)
    SELECT pod, count(*) AS events_total, round(count(*) / greatest(max(t) - min(t), 1.0), 6) AS rate, count(DISTINCT agent) AS agents, count(DISTINCT tool) AS tools, coalesce(any_value(resources_n), 0) AS resources,
    count(*) FILTER (high_risk) AS high_risk_events, round(count(*) FILTER (high_risk) / count(*), 6) AS risk_ratio, any_value(max_tool_calls) AS max_tool_calls, coalesce(any_value(max_resource_touches), 0) AS max_resource_touches,
    any_value(tool_entropy) AS tool_entropy, round(sum(raw_bytes) / 1024.0, 6) AS raw_kib
    FROM gm JOIN en USING (pod) LEFT JOIN (SELECT pod, resources AS resources_n, max_resource_touches FROM rs) USING (pod) GROUP BY pod""",
)
def a23(spark, sf_dir):
    f = O.graph_features(graph(spark, sf_dir), "pod", "agent", "t")
    return f.select("pod", "events_total", F.round("rate", 6).alias("rate"), "agents", "tools", "resources", "high_risk_events", F.round("risk_ratio", 6).alias("risk_ratio"), "max_tool_calls", "max_resource_touches", (F.round("tool_entropy", 6) + 0.0).alias("tool_entropy"), F.round("raw_kib", 6).alias("raw_kib"))


@query(
    "a24_node_features",
    f"""WITH {GRAPH_SQL}, b AS (SELECT src, dst, n FROM ed UNION ALL SELECT dst, src, n FROM ed),
    nd AS (SELECT DISTINCT * FROM (SELECT src AS node, CASE kind WHEN 'hosts' THEN 'pod' WHEN 'calls' THEN 'agent' ELSE 'tool' END AS kind FROM ed UNION ALL SELECT dst, CASE kind WHEN 'hosts' THEN 'agent' WHEN 'calls' THEN 'tool' ELSE 'resource' END FROM ed)),
    dg AS (SELECT node, ln(1 + o) AS od, ln(1 + i) AS id FROM (SELECT src AS node, sum(n) AS o FROM b GROUP BY src) JOIN (SELECT dst AS node, sum(n) AS i FROM b GROUP BY dst) USING (node)),
    tk AS (SELECT tool, count(*) AS k FROM gm GROUP BY ALL), en AS (SELECT -sum(k / t * log2(k / t)) AS entropy FROM tk, (SELECT sum(k) AS t FROM tk)),
    g AS (SELECT count(*) / greatest(max(t) - min(t), 1.0) AS rate, count(DISTINCT tool) AS tools, (SELECT count(DISTINCT r) FROM (SELECT unnest(resources) AS r FROM gm)) AS resources, avg(CASE WHEN high_risk THEN 1.0 ELSE 0.0 END) AS risk FROM gm)
    SELECT node, kind, CAST(kind = 'agent' AS INT) AS is_agent, CAST(kind = 'pod' AS INT) AS is_pod, CAST(kind = 'tool' AS INT) AS is_tool, CAST(kind = 'resource' AS INT) AS is_resource, round(od, 6) AS out_degree, round(id, 6) AS in_degree,
    round(rate, 6) AS g_rate, tools AS g_tools, resources AS g_resources, round(risk, 6) AS g_risk_ratio, round(entropy, 6) AS g_tool_entropy FROM nd JOIN dg USING (node), g, en""",
)
def a24_features(spark, sf_dir):
    f = O.node_features(edges(spark, sf_dir), graph(spark, sf_dir), "agent", "t")
    rounded = ("out_degree", "in_degree", "g_rate", "g_risk_ratio", "g_tool_entropy")
    return f.select(*[F.round(c, 6).alias(c) if c in rounded else F.col(c) for c in f.columns])


@query(
    "a24_node_degrees",
    f"""WITH {GRAPH_SQL}, b AS (SELECT src, dst, n FROM ed UNION ALL SELECT dst, src, n FROM ed)
    SELECT node, round(ln(1 + o), 6) AS out_degree, round(ln(1 + i), 6) AS in_degree FROM (SELECT src AS node, sum(n) AS o FROM b GROUP BY src) JOIN (SELECT dst AS node, sum(n) AS i FROM b GROUP BY dst) USING (node)""",
)
def a24(spark, sf_dir):
    e = edges(spark, sf_dir)
    return O.node_degrees(e, O.graph_nodes(e)).select("node", F.round("out_degree", 6).alias("out_degree"), F.round("in_degree", 6).alias("in_degree"))


@query("a25_diversity", f"WITH {GRAPH_SQL} SELECT method, count(DISTINCT agent) AS agents, count(DISTINCT pod) AS pods, CAST(round(max(t) - min(t), 6) AS DOUBLE) AS span FROM gm GROUP BY method")
def a25(spark, sf_dir):
    return O.diversity(graph(spark, sf_dir), ["method"], "agent", "pod", "t").withColumn("span", F.round(F.col("span").cast("double"), 6))
