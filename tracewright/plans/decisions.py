"""Queries on gates, confirmation and decisions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewright.functions.syscalls import BEHAVIOUR_SYSCALLS, wilson_sql
from tracewright.operators import gates as G
from tracewright.operators import joins as J
from tracewright.operators import models as M
from tracewright.operators import windows as W
from tracewright.plans.features import ENVELOPE_SQL, FREQ, GROUPS, LIMITS_SQL, WEV, WIN, frequencies, group_counts, limits, scores, window_counts, windowed
from tracewright.operators.robust import counted_quantiles, envelope, event_bounds
from tracewright.registry import query
from tracewright.sources.tables import EV, events

_NAMES = ", ".join(f"'{n}'" for n in BEHAVIOUR_SYSCALLS)
GATES_SQL = f"""{LIMITS_SQL}, rt AS (SELECT workload, win, syscall, {wilson_sql("n", "total")} / limit_value AS ratio FROM fr JOIN lm USING (workload, syscall)),
  gt AS (SELECT workload, win, max(ratio) > 1 AS gate, arg_max(syscall, (ratio, syscall)) AS gate_syscall, max(ratio) AS gate_ratio FROM rt GROUP BY ALL)"""


def gates(spark, sf_dir, counts=None):
    return G.behaviour_gate(frequencies(spark, sf_dir, counts), limits(spark, sf_dir, counts), WIN, "workload", "syscall")


@query("g1_behaviour_gates", f"WITH {GATES_SQL} SELECT workload, win, gate, gate_syscall, round(gate_ratio, 6) AS gate_ratio FROM gt")
def g1(spark, sf_dir):
    return gates(spark, sf_dir).withColumn("gate_ratio", F.round("gate_ratio", 6))


@query("g2_mass_gate", f"WITH {WEV} SELECT workload, win, count(*) FILTER (syscall IN ({_NAMES})) / count(*) >= 0.10 AS gate FROM wv GROUP BY ALL")
def g2(spark, sf_dir):
    w = windowed(spark, sf_dir).groupBy(*WIN).agg(F.count_if(F.col("syscall").isin(*BEHAVIOUR_SYSCALLS)).alias("s"), F.count("*").alias("n"))
    return w.select(*WIN, (F.col("s") / F.col("n") >= 0.10).alias("gate"))


WINDOWS_SQL = f"{WEV}, ws AS (SELECT workload, win, count(*) AS n, least(1.0, max(value) / 400) AS score, win % 12 * 10.0 AS age FROM wv GROUP BY ALL)"


def judged(spark, sf_dir):
    """(workload, win, n, score, age) of each window."""
    w = windowed(spark, sf_dir).groupBy(*WIN).agg(F.count("*").alias("n"), F.max("value").alias("v"))
    return w.select(*WIN, "n", F.least(F.lit(1.0), F.col("v") / 400).alias("score"), (F.col("win") % 12 * F.lit(10.0)).alias("age"))


@query(
    "g3_quality_skips",
    f"""WITH {WINDOWS_SQL}, b AS (SELECT workload, greatest(1, CAST(floor(quantile_cont(n, 0.1) * 0.9) AS BIGINT)) AS low FROM ws GROUP BY workload)
    SELECT workload, win, CASE WHEN n < 4 THEN 'low_event_skip' WHEN n < low THEN 'collection_quality_skip' WHEN age < 20 THEN 'pod_startup_grace' END AS skip FROM ws JOIN b USING (workload)""",
)
def g3(spark, sf_dir):
    w = judged(spark, sf_dir)
    low = counted_quantiles(w, ["workload"], "n", {"q": 0.1}).select("workload", F.greatest(F.lit(1).cast("long"), F.floor(F.col("q") * 0.9)).alias("low"))
    return w.join(low, "workload").select(*WIN, G.quality_skip(F.col("n"), F.col("low"), F.col("age"), 4, 20.0).alias("skip"))


CALIBRATED_SQL = f"""{GATES_SQL}, ws AS (SELECT workload, win, count(*) AS n, least(1.0, max(value) / 400) AS score FROM wv GROUP BY ALL),
  cl AS (SELECT ws.*, coalesce(gate, false) AS gate, NOT coalesce(gate, false) AND score < 0.8 AS clean FROM ws LEFT JOIN gt USING (workload, win)),
  ow AS (SELECT *, CASE WHEN clean AND count(*) OVER f >= 10 THEN least(0.995, greatest(0.4, quantile_cont(score, 0.995) OVER f + 0.5 * greatest(mad(score) OVER f, 0.001))) END AS own
    FROM cl WINDOW f AS (PARTITION BY workload, clean ORDER BY win ROWS BETWEEN 119 PRECEDING AND CURRENT ROW)),
  ca AS (SELECT *, last_value(own IGNORE NULLS) OVER (PARTITION BY workload ORDER BY win ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS score_limit FROM ow)"""


def calibrated(spark, sf_dir):
    """(workload, win, n, score, gate, limit)."""
    w = judged(spark, sf_dir).join(gates(spark, sf_dir).select(*WIN, "gate"), WIN, "left").withColumn("gate", F.coalesce("gate", F.lit(False)))
    return G.calibrated(w, ["workload"], ["win"], "score", ~F.col("gate") & (F.col("score") < 0.8), 0.4)


@query("g4_calibration", f"WITH {CALIBRATED_SQL} SELECT workload, win, round(score_limit + 1e-9, 6) AS score_limit FROM ca")
def g4(spark, sf_dir):
    return calibrated(spark, sf_dir).select(*WIN, F.round(F.col("limit") + 1e-9, 6).alias("score_limit"))


#: The policy of the decision chain on these tables: quantile of the limit, least limit, gate ratio, quantile and factor of the
#: usual number of events, windows that confirm, near ratio, floors with persistent behaviour and with a warning, quiet windows.
CHAIN = {"q": 0.5, "baseline": 0.2, "ratio": 0.8, "volume": (0.5, 1.2), "k": 2, "near": 0.8, "behaviour_floor": 0.25, "warning_floor": 0.3, "quiet": 4}

_RULE_SQL = f"""{EV}, lx AS (SELECT *, last_value(CASE WHEN syscall = 'execve' THEN us WHEN syscall = 'write' THEN -1 END IGNORE NULLS) OVER w AS lt,
    last_value(CASE WHEN syscall = 'execve' THEN event_id % 2 WHEN syscall = 'write' THEN -1 END IGNORE NULLS) OVER w AS ln
    FROM ev WINDOW w AS (PARTITION BY pod ORDER BY us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
  wn AS (SELECT event_id, pod, workload, us, lt AS first_us, CASE WHEN syscall = 'setuid' THEN 'exec_privilege' WHEN syscall = 'connect' AND ln = 1 THEN 'exec_network' END AS rule FROM lx WHERE lt >= 0 AND us - lt <= 43200000000),
  wr AS (SELECT * FROM wn WHERE rule IS NOT NULL)"""


def warnings(spark, sf_dir):
    return G.sequence_rule(events(spark, sf_dir), "pod", ["us", "event_id"], "syscall", "us", F.col("event_id") % 2 == 1, 12 * 3600 * 1_000_000, ["setuid"], ["write"])


#: Scores of a window: the largest value, the mean one, and both.
COMPONENTS = ("both", "first", "second")
_C = CHAIN
CHAIN_SQL = f"""{GATES_SQL}, {_RULE_SQL.removeprefix(EV + ", ")}, ws AS (SELECT workload, win, count(*) AS n, least(1.0, max(value) / 400) AS s1, least(1.0, avg(value) / 100) AS s2, win % 12 * 10.0 AS age FROM wv GROUP BY ALL),
  bd AS (SELECT workload, greatest(1, CAST(floor(quantile_cont(n, 0.1) * 0.9) AS BIGINT)) AS low, greatest(1, CAST(ceil(quantile_cont(n, {_C["volume"][0]}) * {_C["volume"][1]}) AS BIGINT)) AS high FROM ws GROUP BY workload),
  w2 AS (SELECT ws.*, coalesce(gate_ratio > {_C["ratio"]}, false) AS gate, n > high AS extreme, CASE WHEN n < 4 THEN 'low_event_skip' WHEN n < low THEN 'collection_quality_skip' WHEN age < 20 THEN 'pod_startup_grace' END AS skip,
    coalesce((win + 1) * 21600000000 - (SELECT max(us) FROM wr WHERE wr.workload = ws.workload AND wr.us <= (ws.win + 1) * 21600000000) <= 21600000000, false) AS warned
    FROM ws JOIN bd USING (workload) LEFT JOIN gt USING (workload, win)),
  w3 AS (SELECT *, 'both' AS component, 0.8 * s1 + 0.2 * s2 AS score FROM w2 UNION ALL SELECT *, 'first', s1 FROM w2 UNION ALL SELECT *, 'second', s2 FROM w2),
  w4 AS (SELECT *, skip IS NULL AND NOT gate AND score < 0.8 AS clean FROM w3),
  w5 AS (SELECT *, CASE WHEN clean AND count(*) OVER f >= 10 THEN least(0.995, greatest({_C["baseline"]}, quantile_cont(score, {_C["q"]}) OVER f + 0.5 * greatest(mad(score) OVER f, 0.001))) END AS own
    FROM w4 WINDOW f AS (PARTITION BY component, workload, clean ORDER BY win ROWS BETWEEN 119 PRECEDING AND CURRENT ROW)),
  cw AS (SELECT *, last_value(own IGNORE NULLS) OVER (PARTITION BY component, workload ORDER BY win ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS lm FROM w5)"""


def chain_windows(spark, sf_dir, components=COMPONENTS):
    """(component, workload, win, n, score, skip, gate, extreme, warned, clean, limit): what the chain decides on, by component of the score."""
    counts = window_counts(spark, sf_dir)
    w = counts.groupBy(*WIN).agg(F.sum("n").alias("n"), F.max("top").alias("top"), (F.sum("amount") / F.sum("n")).alias("mean"))
    first, second = F.least(F.lit(1.0), F.col("top") / 400), F.least(F.lit(1.0), F.col("mean") / 100)
    bounds = event_bounds(w, "workload", "n", (0.1, 0.9), CHAIN["volume"])
    gated = gates(spark, sf_dir, counts).select(*WIN, (F.col("gate_ratio") > CHAIN["ratio"]).alias("gate"))
    w = w.join(bounds, "workload").join(gated, WIN, "left").withColumn("gate", F.coalesce("gate", F.lit(False)))
    w = w.withColumn("extreme", F.col("n") > F.col("high")).withColumn("skip", G.quality_skip(F.col("n"), F.col("low"), F.col("win") % 12 * F.lit(10.0), 4, 20.0)).withColumn("ended", (F.col("win") + 1) * 21600000000)
    w = J.asof(w, warnings(spark, sf_dir).select("workload", F.col("us").alias("warned_at")), ["workload"], "ended", "warned_at", 21600000000).withColumn("warned", F.col("warned_at").isNotNull())
    scores = F.array(*[F.struct(F.lit(c).alias("component"), M.ensemble(first, second, F.lit(c)).alias("score")) for c in components])
    w = w.select(*WIN, "n", "skip", "gate", "extreme", "warned", F.explode(scores).alias("x")).select("x.component", "x.score", *WIN, "n", "skip", "gate", "extreme", "warned")
    clean = F.col("skip").isNull() & ~F.col("gate") & (F.col("score") < 0.8)
    return G.calibrated(w.withColumn("clean", clean), ["component", "workload"], ["win"], "score", F.col("clean"), CHAIN["baseline"], q=CHAIN["q"])


CONFIRMED_SQL = f"""{CHAIN_SQL}, ql AS (SELECT *, gate AND score >= lm AS q FROM cw WHERE component = 'first' AND lm IS NOT NULL),
  il AS (SELECT *, sum(CASE WHEN q THEN 0 ELSE 1 END) OVER (PARTITION BY workload ORDER BY win) AS island FROM ql),
  rn AS (SELECT *, CAST(sum(CASE WHEN q THEN 1 ELSE 0 END) OVER (PARTITION BY workload, island ORDER BY win) AS BIGINT) AS run FROM il)"""


def over_limit(share: float = 1.0):
    return F.col("gate") & (F.col("score") >= share * F.col("limit"))


def confirming(spark, sf_dir):
    """Windows with a limit; those that calibrate do not count at all."""
    return chain_windows(spark, sf_dir, ("first",)).filter("limit is not null")


@query("g5_confirmed_alerts", f"WITH {CONFIRMED_SQL} SELECT workload, win, round(score, 6) AS score, run FROM rn WHERE run >= {_C['k']}")
def g5(spark, sf_dir):
    """Behaviour gate and a score at or over the learned limit in two or more windows in a row."""
    runs = G.run_length(confirming(spark, sf_dir), ["workload"], ["win"], over_limit())
    return runs.filter(F.col("run") >= CHAIN["k"]).select(*WIN, F.round("score", 6).alias("score"), "run")


@query(
    "g6_hysteresis",
    f"""WITH {CONFIRMED_SQL}, h AS (SELECT *, lag(run) OVER (PARTITION BY workload ORDER BY win) AS before FROM rn)
    SELECT workload, win, run >= 2 OR (coalesce(before = 1, false) AND gate AND score >= {_C["near"]} * lm) AS confirmed FROM h""",
)
def g6(spark, sf_dir):
    return G.hysteresis(confirming(spark, sf_dir), ["workload"], ["win"], over_limit(), over_limit(CHAIN["near"])).select(*WIN, "confirmed")


@query(
    "g7_volume_path",
    f"""WITH {CHAIN_SQL}, v AS (SELECT *, NOT gate AND score >= lm AND extreme AS q FROM cw WHERE component = 'first' AND lm IS NOT NULL), i AS (SELECT *, sum(CASE WHEN q THEN 0 ELSE 1 END) OVER (PARTITION BY workload ORDER BY win) AS island FROM v)
    SELECT workload, win, CAST(sum(CASE WHEN q THEN 1 ELSE 0 END) OVER (PARTITION BY workload, island ORDER BY win) AS BIGINT) AS run FROM i""",
)
def g7(spark, sf_dir):
    return G.run_length(confirming(spark, sf_dir), ["workload"], ["win"], ~F.col("gate") & (F.col("score") >= F.col("limit")) & F.col("extreme")).select(*WIN, "run")


@query("g11_sequence_rule", f"WITH {_RULE_SQL} SELECT event_id, pod, rule, first_us FROM wr")
def g11(spark, sf_dir):
    return warnings(spark, sf_dir).select("event_id", "pod", "rule", F.col("first_time").alias("first_us"))


@query(
    "g8_fused_confirmation",
    f"""WITH {CONFIRMED_SQL}, b AS (SELECT *, gate AND {_C["behaviour_floor"]} < lm AND score >= {_C["behaviour_floor"]} AS bq, gate AND warned AND {_C["warning_floor"]} < lm AND score >= {_C["warning_floor"]} AS assisted FROM rn),
    bi AS (SELECT *, sum(CASE WHEN bq THEN 0 ELSE 1 END) OVER (PARTITION BY workload ORDER BY win) AS bisland FROM b),
    br AS (SELECT *, sum(CASE WHEN bq THEN 1 ELSE 0 END) OVER (PARTITION BY workload, bisland ORDER BY win) >= {_C["k"]} AS persistent FROM bi)
    SELECT workload, win, assisted, persistent, run >= {_C["k"]} OR assisted OR persistent AS confirmed FROM br""",
)
def g8(spark, sf_dir):
    """Windows that a warning or persistent behaviour confirms at a floor below the limit."""
    rows, low, limit = confirming(spark, sf_dir), CHAIN["behaviour_floor"], F.col("limit")
    rows = G.run_length(rows, ["workload"], ["win"], over_limit(), "hard")
    rows = G.run_length(rows, ["workload"], ["win"], F.col("gate") & (limit > low) & (F.col("score") >= low), "behaviour")
    assisted = F.col("gate") & F.col("warned") & (limit > CHAIN["warning_floor"]) & (F.col("score") >= CHAIN["warning_floor"])
    persistent = F.col("behaviour") >= CHAIN["k"]
    return rows.select(*WIN, assisted.alias("assisted"), persistent.alias("persistent"), ((F.col("hard") >= CHAIN["k"]) | assisted | persistent).alias("confirmed"))


def cooldown_sql(rows: str, key: str, quiet: int) -> str:
    """The recursive walk over ordered alerts (key, t), as expressions od and cd."""
    return f"""od AS (SELECT {key}, t, row_number() OVER (PARTITION BY {key} ORDER BY t) AS i FROM (SELECT DISTINCT {key}, t FROM {rows})),
  cd AS (SELECT {key}, i, t, t AS sent FROM od WHERE i = 1 UNION ALL
    SELECT {", ".join(f"od.{k.strip()}" for k in key.split(","))}, od.i, od.t, CASE WHEN od.t - cd.sent >= {quiet} THEN od.t ELSE cd.sent END FROM cd JOIN od ON {" AND ".join(f"od.{k.strip()} = cd.{k.strip()}" for k in key.split(","))} AND od.i = cd.i + 1)"""


@query("g9_cooldown", f"WITH RECURSIVE {EV}, al AS (SELECT pod, us AS t FROM ev WHERE value > 100), {cooldown_sql('al', 'pod', 172800000000)} SELECT pod, t AS us FROM cd WHERE sent = t")
def g9(spark, sf_dir):
    return G.cooldown(events(spark, sf_dir).filter("value > 100").select("pod", "us"), ["pod"], "us", 172800000000).distinct()


@query("g12_rule_cooldown", f"WITH RECURSIVE {_RULE_SQL}, al AS (SELECT pod, rule, us AS t FROM wr), {cooldown_sql('al', 'pod, rule', 432000000000)} SELECT pod, rule, t AS us FROM cd WHERE sent = t")
def g12(spark, sf_dir):
    return G.cooldown(warnings(spark, sf_dir).select("pod", "rule", "us"), ["pod", "rule"], "us", 432000000000).distinct()


_POLICY_COLUMNS = ("policy", "component", "behaviour", "volume", "adaptive", "k")
_POLICIES = [
    ("full", "both", True, True, True, 2), ("no_behaviour", "both", False, True, True, 2), ("no_volume", "both", True, False, True, 2), ("static", "both", True, True, False, 2),
    ("one_window", "both", True, True, True, 1), ("first_only", "first", True, True, True, 2), ("second_only", "second", True, True, True, 2),
]


def decided_sql(policies: list[tuple]) -> str:
    """Expression dd (policy, workload, win, decision, path): the chain as a walk over the ordered windows of each policy and workload."""
    held = "x.skip IS NOT NULL OR x.calibrating"
    return f"""{CHAIN_SQL}, po({", ".join(_POLICY_COLUMNS)}) AS (VALUES {", ".join(str(p) for p in policies)}),
  rw AS (SELECT policy, k, cw.workload, win, skip, adaptive AND clean AND lm IS NULL AS calibrating, gate OR NOT behaviour AS gate, extreme AND volume AS extreme, warned, score,
    CASE WHEN adaptive THEN coalesce(lm, {_C["baseline"]}) ELSE {_C["baseline"]} END AS lim, row_number() OVER (PARTITION BY policy, cw.workload ORDER BY win) AS i FROM cw JOIN po USING (component)),
  dd AS (SELECT policy, workload, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS win, 0 AS c, 0 AS b, 0 AS v, CAST(NULL AS BIGINT) AS sent, CAST(NULL AS VARCHAR) AS decision, CAST(NULL AS VARCHAR) AS path FROM rw WHERE i = 1
    UNION ALL SELECT policy, workload, i, win, c1, b1, v1, CASE WHEN decision = 'detection' THEN win ELSE sent END, decision, path FROM (
      SELECT *, CASE WHEN skip IS NOT NULL THEN skip WHEN calibrating THEN 'calibrating' WHEN sure AND sent IS NOT NULL AND win - sent < {_C["quiet"]} THEN 'cooldown' WHEN sure THEN 'detection'
        WHEN gate OR v1 > 0 THEN 'pending_confirmation' WHEN score >= lim THEN 'behavior_gated' ELSE 'normal' END AS decision FROM (
        SELECT *, CASE WHEN {held.replace("x.", "")} THEN NULL WHEN NOT gate THEN CASE WHEN v1 > 0 THEN 'extreme_volume_ml' END WHEN c1 >= k THEN CASE WHEN score >= lim THEN 'hard_ml' ELSE 'hysteresis_ml' END
          WHEN fast THEN 'fast_path_behavior_ml_floor' WHEN b1 >= k THEN 'behavior_persistence_ml_floor' WHEN score >= lim THEN 'hard_ml' END AS path,
          CASE WHEN gate THEN c1 >= k OR fast OR b1 >= k ELSE v1 >= k END AS sure FROM (
          SELECT x.*, d.sent, x.warned AND {_C["warning_floor"]} < x.lim AND x.score >= {_C["warning_floor"]} AS fast,
            CASE WHEN x.skip IS NOT NULL THEN 0 WHEN x.calibrating THEN d.c WHEN NOT x.gate THEN 0 WHEN x.score >= x.lim THEN d.c + 1 WHEN d.c = 1 AND x.score >= {_C["near"]} * x.lim THEN x.k ELSE 0 END AS c1,
            CASE WHEN x.skip IS NOT NULL THEN 0 WHEN x.calibrating THEN d.b WHEN NOT x.gate THEN 0 WHEN {_C["behaviour_floor"]} < x.lim AND x.score >= {_C["behaviour_floor"]} THEN d.b + 1 ELSE 0 END AS b1,
            CASE WHEN x.skip IS NOT NULL THEN 0 WHEN x.calibrating THEN d.v WHEN x.gate THEN 0 WHEN x.score >= x.lim AND x.extreme THEN d.v + 1 ELSE 0 END AS v1
          FROM dd d JOIN rw x ON x.policy = d.policy AND x.workload = d.workload AND x.i = d.i + 1))))"""


def decided(spark, sf_dir, policies: list[tuple]):
    """The windows of each policy, a row of a fixed list, with decision and path."""
    kinds = "policy string, component string, behaviour boolean, volume boolean, adaptive boolean, k int"
    po = F.broadcast(spark.createDataFrame(policies, kinds))  # a fixed list
    rows = chain_windows(spark, sf_dir, tuple(sorted({p[1] for p in policies}))).join(po, "component")
    limit = F.when(F.col("adaptive"), F.coalesce("limit", F.lit(CHAIN["baseline"]))).otherwise(F.lit(CHAIN["baseline"]))
    rows = rows.select(
        "policy", *WIN, "skip", (F.col("adaptive") & F.col("clean") & F.col("limit").isNull()).alias("calibrating"), (F.col("gate") | ~F.col("behaviour")).alias("gate"), (F.col("extreme") & F.col("volume")).alias("extreme"), "warned",
        "score", limit.alias("score_limit"), "k", F.lit(CHAIN["near"]).alias("near"), F.lit(CHAIN["behaviour_floor"]).alias("behaviour_floor"), F.lit(CHAIN["warning_floor"]).alias("warning_floor"),
    )
    return G.decisions(rows, ["policy", "workload"], "win", CHAIN["quiet"])


@query("g10_decisions", f"WITH RECURSIVE {decided_sql(_POLICIES[:1])} SELECT workload, win, decision, coalesce(path, '') AS path FROM dd WHERE i > 0")
def g10(spark, sf_dir):
    """Each window's decision and the path that led to it."""
    return decided(spark, sf_dir, _POLICIES[:1]).select(*WIN, "decision", F.coalesce("path", F.lit("")).alias("path"))


def policy(spark):
    rows = [(g, f, 2) for g, fields in GROUPS.items() for f in fields]
    return spark.createDataFrame(rows, "grp string, field string, minimum_excess int")


CORROBORATED_SQL = f"""{ENVELOPE_SQL}, hb AS (SELECT workload, win, grp, v, v - (normal_max - 3) >= 2 AS hit FROM gv JOIN em USING (workload, grp) WHERE v > 0),
  ms AS (SELECT workload, win, execve + connect + setuid AS mass FROM pv),
  co AS (SELECT ms.workload, ms.win, coalesce(bool_or(hit), false) OR any_value(mass) >= 8 AS corroborated, coalesce(string_agg(CASE WHEN hit THEN grp END, ',' ORDER BY grp), '') AS grps FROM ms LEFT JOIN hb USING (workload, win) GROUP BY ms.workload, ms.win)"""


def corroboration(spark, sf_dir):
    g = group_counts(spark, sf_dir)
    maxima = envelope(g.filter(F.col("win") % 3 != 0), "workload", GROUPS).withColumn("normal_max", F.col("normal_max") - 3)
    return G.corroborated(g.select(*WIN), frequencies(spark, sf_dir), policy(spark), maxima, WIN, "workload", "syscall", 8)


@query("g13_corroboration", f"WITH {CORROBORATED_SQL} SELECT workload, win, corroborated, grps FROM co")
def g13(spark, sf_dir):
    return corroboration(spark, sf_dir).select(*WIN, "corroborated", F.array_join("groups", ",").alias("grps"))


@query(
    "g14_score_margin",
    f"WITH {WINDOWS_SQL}, m AS (SELECT workload, max(score) AS top FROM ws WHERE win % 5 <> 0 GROUP BY workload) SELECT workload, win, score - top >= -0.3 AS over_margin FROM ws JOIN m USING (workload)",
)
def g14(spark, sf_dir):
    w = judged(spark, sf_dir)
    top = w.filter(F.col("win") % 5 != 0).groupBy("workload").agg(F.max("score").alias("top"))
    return w.join(top, "workload").select(*WIN, (F.col("score") - F.col("top") >= -0.3).alias("over_margin"))


@query(
    "g15_statuses",
    f"""WITH {CORROBORATED_SQL}, ws AS (SELECT workload, win, least(1.0, max(value) / 400) AS score FROM wv GROUP BY ALL),
    md AS (SELECT workload FROM wv GROUP BY workload HAVING count(*) > (SELECT count(*) / 8.0 FROM wv)),
    sg AS (SELECT *, CAST(sum(CASE WHEN win - pw > 2 OR win // 28 <> pw // 28 THEN 1 ELSE 0 END) OVER (PARTITION BY workload ORDER BY win) AS BIGINT) AS segment FROM (SELECT *, lag(win) OVER (PARTITION BY workload ORDER BY win) AS pw FROM ws)),
    st AS (SELECT *, row_number() OVER (PARTITION BY workload, segment ORDER BY win) <= 2 AS warming FROM sg)
    SELECT st.workload, st.win, CASE WHEN st.workload NOT IN (SELECT workload FROM md) THEN 'collect-only' WHEN warming THEN 'warming' WHEN score >= 0.3 AND corroborated THEN 'alert' WHEN score >= 0.3 THEN 'suppressed' ELSE 'normal' END AS status
    FROM st JOIN co USING (workload, win)""",
)
def g15(spark, sf_dir):
    """collect-only: the workload has no model (too few events); warming: too few windows before it in its segment (a week's regime, without gaps)."""
    rows = judged(spark, sf_dir).join(corroboration(spark, sf_dir), WIN)
    events_of = rows.groupBy("workload").agg(F.sum("n").alias("events"))
    models = events_of.join(events_of.agg((F.sum("events") / 8.0).alias("fair")), F.col("events") > F.col("fair")).select("workload", F.lit(True).alias("modelled"))
    rows = rows.withColumn("regime", F.floor(F.col("win") / 28)).withColumn("began", F.col("win"))
    rows = W.history(W.segments(rows, ["workload"], "began", "win", 0.8, "regime"), ["workload"], "win", 2, "groups")
    odd = F.col("score") >= 0.3
    status = F.when(F.col("modelled").isNull(), "collect-only").when(F.col("status") == "warming", "warming").when(odd & F.col("corroborated"), "alert").when(odd, "suppressed").otherwise("normal")
    return rows.join(models, "workload", "left").select(*WIN, status.alias("status"))


@query(
    "g16_temporal_confirmation",
    f"""WITH {CORROBORATED_SQL}, c AS (SELECT workload, win, string_split(grps, ',') AS g, grps <> '' AS c, list_contains(string_split(grps, ','), 'network') AS b FROM co),
    l AS (SELECT *, c AND NOT b AND lag(c AND NOT b) OVER w AND win - lag(win) OVER w <= 2 AND list_has_any(g, lag(g) OVER w) AS go FROM c WINDOW w AS (PARTITION BY workload ORDER BY win)),
    i AS (SELECT *, sum(CASE WHEN coalesce(go, false) THEN 0 ELSE 1 END) OVER (PARTITION BY workload ORDER BY win) AS island FROM l)
    SELECT workload, win, b OR (c AND NOT b AND row_number() OVER (PARTITION BY workload, island ORDER BY win) >= 2) AS alert FROM i""",
)
def g16(spark, sf_dir):
    rows = corroboration(spark, sf_dir)
    return G.temporal_confirmation(rows, ["workload"], "win", F.size("groups") > 0, "groups", ["network"], 2, 2).select(*WIN, "alert")


@query("g17_agent_decisions")
def g17(spark, sf_dir):
    rows = scores(spark, sf_dir).select("pod", "us", "event_id", "score", F.col("t"))
    return G.agent_decisions(rows, "pod", ["us", "event_id"], "score", "t", quiet=86400.0).select("event_id", "pod", "decision", F.round("limit_now", 6).alias("limit_now"))


@query(
    "g18_first_sensitive",
    f"""WITH {WEV}, s AS (SELECT workload, win, list(syscall ORDER BY us, event_id) AS q FROM wv GROUP BY ALL), p AS (SELECT *, list_min(list_filter([CASE WHEN q[i] IN ('execve', 'setuid') THEN i END FOR i IN generate_series(1, len(q))], lambda x: x IS NOT NULL)) AS k FROM s)
    SELECT workload, win, round(win * 21600.0 + k / len(q) * 21600.0, 3) AS first_at FROM p WHERE k IS NOT NULL""",
)
def g18(spark, sf_dir):
    w = windowed(spark, sf_dir).groupBy(*WIN).agg(F.array_sort(F.collect_list(F.struct("us", "event_id", "syscall"))).alias("s"))
    w = w.select(*WIN, F.transform("s", lambda x: x["syscall"]).alias("sequence"), (F.col("win") * F.lit(21600.0)).alias("began"), ((F.col("win") + 1) * F.lit(21600.0)).alias("ended"))
    return G.first_sensitive(w, "sequence", "began", "ended", ["execve", "setuid"]).select(*WIN, F.round("first_at", 3).alias("first_at"))


@query(
    "g19_ablation",
    f"""WITH RECURSIVE {decided_sql(_POLICIES)} SELECT policy, workload, count(*) AS n, count(*) FILTER (decision = 'detection') AS alerts, count(*) FILTER (decision = 'pending_confirmation') AS pending,
    count(*) FILTER (path = 'extreme_volume_ml') AS by_volume FROM dd WHERE i > 0 GROUP BY ALL""",
)
def g19(spark, sf_dir):
    """The same windows under each row of a policy table: without a gate, without volume, with the baseline alone, one window, one component."""
    n = lambda c: F.count_if(c)
    d = decided(spark, sf_dir, _POLICIES).groupBy("policy", "workload")
    return d.agg(F.count("*").alias("n"), n(F.col("decision") == "detection").alias("alerts"), n(F.col("decision") == "pending_confirmation").alias("pending"), n(F.col("path") == "extreme_volume_ml").alias("by_volume"))
