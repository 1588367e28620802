"""Queries on model application."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewright.operators import models as M
from tracewright.operators import robust as R
from tracewright.operators.features import graph_nodes, node_degrees
from tracewright.plans.features import GRAPH_SQL, SCORED, edges, mad_sql, scores
from tracewright.registry import query
from tracewright.sources.files import written
from tracewright.sources.tables import EV, events, table

LONG = "el AS (SELECT vec_id, label, CAST(i - 1 AS INT) AS feature, CAST(embedding[i] AS DOUBLE) AS x FROM embeddings, unnest(generate_series(1, 64)) AS g(i))"


def vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings")


def features(spark, sf_dir):
    """(vec_id, label, feature, x)."""
    return vectors(spark, sf_dir).select("vec_id", "label", F.posexplode("embedding").alias("feature", "x")).withColumn("x", F.col("x").cast("double"))


@query(
    "m1_standardised",
    f"""WITH {LONG}, s AS (SELECT label, feature, avg(x) AS mean, stddev_pop(x) AS std FROM el WHERE vec_id % 2 = 0 GROUP BY ALL)
    SELECT vec_id, feature, round(greatest(-10.0, least(10.0, (x - mean) / greatest(std, 0.01))), 5) AS z FROM el JOIN s USING (label, feature)""",
)
def m1(spark, sf_dir):
    x = features(spark, sf_dir)
    stats = x.filter("vec_id % 2 = 0").groupBy("label", "feature").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"))
    return M.standardised(x, stats, ["label", "feature"], "x").select("vec_id", "feature", F.round("z", 5).alias("z"))


def errors(spark, sf_dir):
    v = vectors(spark, sf_dir).select("vec_id", "label", "embedding")
    return M.reconstruction_error(v, M.fit_components(v.filter("vec_id % 2 = 0"), "label", "embedding", 16), "label", "vec_id", "embedding")


@query("m2_reconstruction_errors")
def m2(spark, sf_dir):
    return errors(spark, sf_dir).withColumn("error", F.round("error", 6))


_TAIL = f"""{EV}, {mad_sql("ev", "workload", "value", ", quantile_cont(value, 0.99) AS top")}, tl AS (SELECT *, greatest(top, med + 6 * 1.4826 * mad) AS tail_limit FROM st),
  sd AS (SELECT event_id, ev.workload, value, 1 / (1 + exp(-greatest(-60.0, least(60.0, (value - tail_limit) / greatest(tail_limit - med, abs(tail_limit) * 0.1, 1e-6) + ln(0.2 / 0.8))))) AS score FROM ev JOIN tl USING (workload))"""


def error_scores(spark, sf_dir):
    e = events(spark, sf_dir)
    joined = e.join(R.tail_scale(e, ["workload"], "value"), "workload")
    return joined.withColumn("score", M.error_score(F.col("value"), F.col("tail_limit"), F.col("tail_scale")))


@query("m3_error_scores", f"WITH {_TAIL} SELECT event_id, round(score, 6) AS score FROM sd")
def m3(spark, sf_dir):
    return error_scores(spark, sf_dir).select("event_id", F.round("score", 6).alias("score"))


@query(
    "m4_ensembles",
    f"""WITH {_TAIL} SELECT event_id, round(CASE event_id % 3 WHEN 0 THEN score WHEN 1 THEN least(1.0, value / 400) ELSE 0.8 * score + 0.2 * least(1.0, value / 400) END, 6) AS score FROM sd""",
)
def m4(spark, sf_dir):
    part = F.when(F.col("event_id") % 3 == 0, "first").when(F.col("event_id") % 3 == 1, "second").otherwise("both")
    return error_scores(spark, sf_dir).select("event_id", F.round(M.ensemble(F.col("score"), F.least(F.lit(1.0), F.col("value") / 400), part), 6).alias("score"))


@query("m5_isolation_scores")
def m5(spark, sf_dir):
    return M.isolation_scores(vectors(spark, sf_dir), "label", "vec_id", "embedding").withColumn("isolation", F.round("isolation", 6))


@query("m6_corruption_scores")
def m6(spark, sf_dir):
    """M6: every vector, as it is and corrupted, scored by the forest that has not seen it."""
    examples = M.corrupted(vectors(spark, sf_dir).withColumnRenamed("label", "workload"), ["workload"], "vec_id", "embedding")
    return M.corruption_scores(examples, "vec_id").select("vec_id", "label", F.round("score", 6).alias("score"))


@query(
    "m7_ordered_split",
    f"""WITH {EV}, x AS (SELECT event_id, row_number() OVER (PARTITION BY pod ORDER BY us) AS k, count(*) OVER (PARTITION BY pod) AS n FROM ev)
    SELECT event_id, CASE WHEN k <= floor(n * 0.7) - 3 THEN 'fit' WHEN k <= floor(n * 0.7) THEN 'both' ELSE 'calibration' END AS part FROM x WHERE n >= 60""",
)
def m7(spark, sf_dir):
    return M.ordered_split(events(spark, sf_dir), ["pod"], "us", "event_id", 3, least=60).select("event_id", "part")


@query(
    "m8_conformal_p",
    f"""WITH {SCORED}, c AS (SELECT workload, score FROM sc WHERE event_id % 2 = 0), n AS (SELECT workload, count(*) AS n FROM c GROUP BY workload), s AS (SELECT event_id, workload, score FROM sc WHERE event_id % 2 = 1)
    SELECT event_id, round(((SELECT count(*) FROM c WHERE c.workload = s.workload AND c.score >= s.score) + 1) / (n + 1) + 1e-9, 6) AS p,
    ((SELECT count(*) FROM c WHERE c.workload = s.workload AND c.score >= s.score) + 1) / (n + 1) <= 0.05 AS anomalous FROM s JOIN n USING (workload)""",
)
def m8(spark, sf_dir):
    s = scores(spark, sf_dir).select("event_id", "workload", "score")
    return M.conformal(s.filter("event_id % 2 = 1"), s.filter("event_id % 2 = 0"), ["workload"], "score", 0.05).select("event_id", F.round(F.col("p") + 1e-9, 6).alias("p"), "anomalous")


@query(
    "m9_top_three",
    f"""WITH {LONG}, {mad_sql("el", "label, feature", "x")}, z AS (SELECT vec_id, greatest(0.0, (x - med) / greatest(mad, 0.05)) AS z FROM el JOIN st USING (label, feature)),
    r AS (SELECT vec_id, z, row_number() OVER (PARTITION BY vec_id ORDER BY z DESC) AS k FROM z) SELECT vec_id, round(avg(z), 5) AS z_score FROM r WHERE k <= 3 GROUP BY vec_id""",
)
def m9(spark, sf_dir):
    x = features(spark, sf_dir)
    return M.top_three(x, R.robust_baseline(x, ["label", "feature"], "x"), ["label"], ["vec_id"], "feature", "x").select("vec_id", F.round("z_score", 5).alias("z_score"))


@query(
    "m9_contributions",
    f"""WITH {LONG}, {mad_sql("el", "label, feature", "x")}, z AS (SELECT vec_id, feature, greatest(0.0, (x - med) / greatest(mad, 0.05)) AS z FROM el JOIN st USING (label, feature)),
    r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY z DESC, feature) AS k FROM z) SELECT vec_id, CAST(k AS INT) AS place, feature, round(z, 5) AS z FROM r WHERE k <= 3""",
)
def m9_contributions(spark, sf_dir):
    """The three features that a score comes from, largest first."""
    x = features(spark, sf_dir)
    top = M.top_three(x, R.robust_baseline(x, ["label", "feature"], "x"), ["label"], ["vec_id"], "feature", "x")
    return top.select("vec_id", F.posexplode("contributions").alias("place", "c")).select("vec_id", (F.col("place") + 1).alias("place"), "c.feature", F.round("c.z", 5).alias("z"))


@query("m10_rates", f"WITH {EV} SELECT pod, round(count(*) / greatest((max(us) - min(us)) / 86400000000.0, 1.0), 6) AS per_day, round(sum(value) / greatest((max(us) - min(us)) / 86400000000.0, 1.0), 4) AS value_per_day FROM ev GROUP BY pod")
def m10(spark, sf_dir):
    """Totals over a span, of a day at least, as rates."""
    g = events(spark, sf_dir).groupBy("pod").agg(F.count("*").alias("n"), F.sum("value").alias("v"), F.greatest((F.max("us") - F.min("us")) / 86400000000.0, F.lit(1.0)).alias("d"))
    return g.select("pod", F.round(F.col("n") / F.col("d"), 6).alias("per_day"), F.round(F.col("v") / F.col("d"), 4).alias("value_per_day"))


@query(
    "m11_model_routing",
    f"""WITH {SCORED}, g AS (SELECT workload, count(*) AS n, quantile_cont(score, 0.99) AS own FROM sc GROUP BY workload), p AS (SELECT quantile_cont(score, 0.99) AS pooled FROM sc)
    SELECT workload, CASE WHEN n >= 1200 THEN 'own' ELSE 'pooled' END AS route, round(CASE WHEN n >= 1200 THEN own ELSE pooled END, 6) AS score_limit FROM g, p""",
)
def m11(spark, sf_dir):
    """Workloads with many rows have a model of their own, the others share one."""
    s = scores(spark, sf_dir)
    own, pooled = R.counted_quantiles(s, ["workload"], "score", {"own": 0.99}), R.counted_quantiles(s, [], "score", {"pooled": 0.99})
    both = own.crossJoin(F.broadcast(pooled.select("pooled")))  # one row
    many = F.col("n") >= 1200
    return both.select("workload", F.when(many, "own").otherwise("pooled").alias("route"), F.round(F.when(many, F.col("own")).otherwise(F.col("pooled")), 6).alias("score_limit"))


@query(
    "m12_neighbour_errors",
    f"""WITH {GRAPH_SQL}, b AS (SELECT src, dst, n FROM ed UNION ALL SELECT dst, src, n FROM ed),
    f AS (SELECT node, ln(1 + o) AS od, ln(1 + i) AS id FROM (SELECT src AS node, sum(n) AS o FROM b GROUP BY src) JOIN (SELECT dst AS node, sum(n) AS i FROM b GROUP BY dst) USING (node)),
    a AS (SELECT src AS node, sum(od * n) / sum(n) AS mo, sum(id * n) / sum(n) AS mi FROM b JOIN f ON f.node = dst GROUP BY src)
    SELECT node, round((pow(od - mo, 2) + pow(id - mi, 2)) / 2, 5) AS error FROM f JOIN a USING (node)""",
)
def m12(spark, sf_dir):
    e = edges(spark, sf_dir)
    return M.neighbour_error(e, node_degrees(e, graph_nodes(e)), ["out_degree", "in_degree"]).select("node", F.round("error", 5).alias("error"))


@query(
    "m12_anomalous_nodes",
    f"""WITH {GRAPH_SQL}, b AS (SELECT src, dst, n FROM ed UNION ALL SELECT dst, src, n FROM ed),
    f AS (SELECT node, ln(1 + o) AS od, ln(1 + i) AS id FROM (SELECT src AS node, sum(n) AS o FROM b GROUP BY src) JOIN (SELECT dst AS node, sum(n) AS i FROM b GROUP BY dst) USING (node)),
    a AS (SELECT src AS node, sum(od * n) / sum(n) AS mo, sum(id * n) / sum(n) AS mi FROM b JOIN f ON f.node = dst GROUP BY src), e AS (SELECT node, (pow(od - mo, 2) + pow(id - mi, 2)) / 2 AS error FROM f JOIN a USING (node)),
    l AS (SELECT quantile_cont(error, 0.99) + 0.02 AS lim FROM e) SELECT node, round(lim, 5) AS score_limit, error > lim AS anomalous FROM e, l""",
)
def m12_anomalous(spark, sf_dir):
    e = edges(spark, sf_dir)
    t = M.error_threshold(M.neighbour_error(e, node_degrees(e, graph_nodes(e)), ["out_degree", "in_degree"]))
    return t.select("node", F.round("limit", 5).alias("score_limit"), "anomalous")


NODE_KINDS = ("agent", "pod", "tool", "resource")
NODE_NAMES = [*[f"is_{k}" for k in NODE_KINDS], "degree"]


def _attended_sql(before: str) -> str:
    """One layer over bt (src, dst, n) and the features in an expression before."""
    length = lambda x: f"sqrt({' + '.join(f'pow({x}.{c}, 2)' for c in NODE_NAMES)})"
    dot = " + ".join(f"o.{c} * f.{c}" for c in NODE_NAMES)
    return f"""SELECT node, {", ".join(f"sum(w * {c}) / sum(w) AS {c}" for c in NODE_NAMES)} FROM (SELECT bt.src AS node, bt.n * exp(2.0 * ({dot}) / ({length("o")} * {length("f")})) AS w, {", ".join(f"f.{c}" for c in NODE_NAMES)}
      FROM bt JOIN {before} f ON f.node = bt.dst JOIN {before} o ON o.node = bt.src) GROUP BY node"""


@query(
    "m12_attention_errors",
    f"""WITH {GRAPH_SQL}, bt AS (SELECT src, dst, sum(n) AS n FROM (SELECT src, dst, n FROM ed UNION ALL SELECT dst, src, n FROM ed) GROUP BY ALL),
    kd AS (SELECT src AS node, CASE kind WHEN 'hosts' THEN 'pod' WHEN 'calls' THEN 'agent' ELSE 'tool' END AS kind FROM ed UNION SELECT dst, CASE kind WHEN 'hosts' THEN 'agent' WHEN 'calls' THEN 'tool' ELSE 'resource' END FROM ed),
    f0 AS (SELECT node, {", ".join(f"max(CASE WHEN kind = '{k}' THEN 1.0::DOUBLE ELSE 0.0 END) AS is_{k}" for k in NODE_KINDS)}, any_value(g) AS degree FROM kd JOIN (SELECT src AS node, ln(1 + sum(n)) AS g FROM bt GROUP BY src) USING (node) GROUP BY node),
    f1 AS MATERIALIZED ({_attended_sql("f0")}), f2 AS MATERIALIZED ({_attended_sql("f1")}),
    ab AS (SELECT {", ".join(f"coalesce(regr_slope(x.{c}, y.{c}), 0) AS b_{c}, coalesce(regr_intercept(x.{c}, y.{c}), avg(x.{c})) AS a_{c}" for c in NODE_NAMES)} FROM f0 x JOIN f2 y USING (node))
    SELECT x.node, round(({" + ".join(f"pow(x.{c} - a_{c} - b_{c} * y.{c}, 2)" for c in NODE_NAMES)}) / {len(NODE_NAMES)}, 5) AS error FROM f0 x JOIN f2 y USING (node), ab""",
)
def m12_attention(spark, sf_dir):
    """Two layers of attention over kinds and degrees; see also m12_neighbour_errors."""
    e = written(edges(spark, sf_dir), "edges")
    nodes = graph_nodes(e)
    kinds = nodes.groupBy("node").agg(*[F.max((F.col("kind") == k).cast("double")).alias(f"is_{k}") for k in NODE_KINDS])
    f = kinds.join(node_degrees(e, nodes).select("node", F.col("out_degree").alias("degree")), "node")
    return M.attention_error(e, written(f, "nodes"), NODE_NAMES).select("node", F.round("error", 5).alias("error"))


@query(
    "m13_holdout_gate",
    f"""WITH {SCORED}, x AS (SELECT *, row_number() OVER (PARTITION BY workload ORDER BY us, event_id) AS k, count(*) OVER (PARTITION BY workload) AS n FROM sc)
    SELECT workload, round(avg(CASE WHEN score >= 0.3 THEN 1.0 ELSE 0.0 END), 6) AS rate, avg(CASE WHEN score >= 0.3 THEN 1.0 ELSE 0.0 END) <= 0.08 AS passed FROM x WHERE k > floor(n * 0.8) GROUP BY workload""",
)
def m13(spark, sf_dir):
    return M.holdout_gate(scores(spark, sf_dir), ["workload"], ["us", "event_id"], F.col("score") >= 0.3, 0.08).withColumn("rate", F.round("rate", 6))


@query(
    "m14_acceptance",
    f"""WITH {SCORED}, x AS (SELECT *, coalesce(score >= 0.4 AND lag(score >= 0.4) OVER (PARTITION BY pod ORDER BY us, event_id), false) AS pair FROM sc),
    g AS (SELECT pod, quantile_cont(score, 0.5) AS med, quantile_cont(score, 0.95) AS p95, avg(CASE WHEN score >= 0.4 THEN 1.0 ELSE 0.0 END) AS ov, avg(CASE WHEN score >= 0.999 THEN 1.0 ELSE 0.0 END) AS saturated, count(*) FILTER (pair) AS pairs FROM x GROUP BY pod)
    SELECT pod, round(med + 1e-9, 6) AS med, round(p95 + 1e-9, 6) AS p95, pairs, med <= 0.5 AND p95 <= 0.4 AND ov <= 0.1 AND saturated <= 0.25 AND pairs = 0 AS accepted FROM g""",
)
def m14(spark, sf_dir):
    a = M.acceptance(scores(spark, sf_dir), ["pod"], ["us", "event_id"], "score", 0.4)
    return a.select("pod", F.round(F.col("med") + 1e-9, 6).alias("med"), F.round(F.col("p95") + 1e-9, 6).alias("p95"), "pairs", "accepted")


@query(
    "m15_clean_calibration",
    f"""WITH {SCORED}, c AS (SELECT event_id, pod, score, row_number() OVER (PARTITION BY pod ORDER BY us DESC, event_id DESC) AS k FROM sc WHERE score < 0.3 AND syscall <> 'execve') SELECT event_id, pod, round(score, 6) AS score FROM c WHERE k <= 20""",
)
def m15(spark, sf_dir):
    clean = (F.col("score") < 0.3) & (F.col("syscall") != "execve")
    return M.calibration_rows(scores(spark, sf_dir), ["pod"], ["us", "event_id"], clean, 20).select("event_id", "pod", F.round("score", 6).alias("score"))
