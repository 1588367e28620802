"""Queries on sources, sinks and streams (S1 to S10 and the streaming forms)."""

from __future__ import annotations

import os

from pyspark.errors import AnalysisException
from pyspark.sql import Window
from pyspark.sql import functions as F

from tracewright.registry import query
from tracewright.sources import files as S
from tracewright.sources.tables import EV, events, table
from tracewright.sources.tailing import tail_lines
from tracewright.streaming import stateful as T


@query("s1_json_lines", "SELECT event_id, CAST(json_extract(props, '$.k') AS INT) AS k FROM events WHERE event_id % 17 <> 0")
def s1(spark, sf_dir):
    lines = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 17 == 0, F.concat(F.lit("{broken"), "props")).otherwise(F.col("props")).alias("line"))
    return S.json_lines(lines, "line", "k int")


@query("s2_capture_scan", f"WITH {EV} SELECT event_id, workload, syscall, round(value, 6) AS value FROM ev")
def s2(spark, sf_dir):
    path = S.scratch(spark, "capture")
    events(spark, sf_dir).select("event_id", "workload", "syscall", "value").write.json(path)
    return S.read_capture(spark, path, "event_id long, workload string, syscall string, value double").withColumn("value", F.round("value", 6))


def node_captures(spark, sf_dir):
    """The captures of all nodes, written in one pass, a folder for each."""
    path = S.scratch(spark, "nodes")
    e = events(spark, sf_dir).select("event_id", "syscall", F.col("workload").alias("node"), F.when(F.col("event_id") % 100 == 0, "other").otherwise(F.col("workload")).alias("named"))
    e.write.partitionBy("node").json(path)
    return S.read_nodes(spark, [path], "event_id long, syscall string, node string, named string", "named")


@query("s4_node_union", f"WITH {EV} SELECT workload AS node, syscall, count(*) AS n, count(*) FILTER (event_id % 100 <> 0) AS agreeing FROM ev GROUP BY ALL")
def s4(spark, sf_dir):
    return node_captures(spark, sf_dir).groupBy("node", "syscall").agg(F.count("*").alias("n"), F.count_if("node_agrees").alias("agreeing"))


@query("s4_all_nodes", f"WITH {EV} SELECT workload AS node, count(*) AS n, count(*) FILTER (event_id % 100 <> 0) AS agreeing FROM ev GROUP BY workload")
def s4_all(spark, sf_dir):
    """S4 by node alone."""
    return node_captures(spark, sf_dir).groupBy("node").agg(F.count("*").alias("n"), F.count_if("node_agrees").alias("agreeing"))


@query("s6_row_aligned", "SELECT e.vec_id, label, round(CAST(embedding[1] AS DOUBLE), 6) AS first FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id")
def s6(spark, sf_dir):
    """A matrix and its metadata meet by an explicit row number."""
    m = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row_idx"), "label", F.col("embedding")[0].cast("double").alias("first"))
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("row_idx"))
    return m.join(d, "row_idx").select(F.col("row_idx").alias("vec_id"), "label", F.round("first", 6).alias("first"))


@query("s7_csv_results", "SELECT o_orderkey, o_custkey, o_orderpriority FROM orders")
def s7(spark, sf_dir):
    path, o = S.scratch(spark, "csv"), table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    S.write_csv(o, path)
    return spark.read.option("header", True).schema(o.schema).csv(path)


@query("s8_immutable_write", "SELECT c_custkey, true AS refused FROM customer")
def s8(spark, sf_dir):
    path, c = S.scratch(spark, "once"), table(spark, sf_dir, "customer").select("c_custkey")
    S.write_once(c, path)
    try:
        S.write_once(c, path)
        refused = False
    except AnalysisException:
        refused = True
    return spark.read.parquet(path).withColumn("refused", F.lit(refused))


@query(
    "s9_canonical_merge",
    """WITH u AS (SELECT 'a' AS source, o_orderkey AS line, o_custkey % 50 AS t, CASE WHEN o_orderkey % 3 = 0 THEN 'start' ELSE 'window' END AS kind FROM orders WHERE o_orderkey % 2 = 0
    UNION ALL SELECT 'b', o_orderkey, o_custkey % 50, CASE WHEN o_orderkey % 3 = 1 THEN 'end' ELSE 'window' END FROM orders WHERE o_orderkey % 2 = 1)
    SELECT source, line, CAST(CASE kind WHEN 'start' THEN 0 WHEN 'window' THEN 1 ELSE 2 END AS INT) AS kind_rank, t FROM u""",
)
def s9(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("line"), (F.col("o_custkey") % 50).alias("t"))
    a = o.filter("line % 2 = 0").withColumn("kind", F.when(F.col("line") % 3 == 0, "start").otherwise("window"))
    b = o.filter("line % 2 = 1").withColumn("kind", F.when(F.col("line") % 3 == 1, "end").otherwise("window"))
    return S.merged({"a": a, "b": b}, "t", "kind", ["start", "window", "end"], "line").select("source", "line", "kind_rank", "t")


@query(
    "s9_merge_positions",
    """WITH u AS (SELECT 'a' AS source, o_orderkey AS line, o_custkey % 50 AS t, CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE 1 END AS r FROM orders WHERE o_orderkey % 2 = 0
    UNION ALL SELECT 'b', o_orderkey, o_custkey % 50, CASE WHEN o_orderkey % 3 = 1 THEN 2 ELSE 1 END FROM orders WHERE o_orderkey % 2 = 1)
    SELECT source, line, t, CAST(row_number() OVER (PARTITION BY t ORDER BY r, source, line) AS INT) AS position FROM u""",
)
def s9_positions(spark, sf_dir):
    """The place that each line gets among those of its time, from the order of the merged rows themselves."""
    rows = s9(spark, sf_dir).withColumn("at", F.monotonically_increasing_id())
    return rows.select("source", "line", "t", F.row_number().over(Window.partitionBy("t").orderBy("at")).alias("position"))


@query("s10_round_concat", "SELECT label, count(*) AS n, count(DISTINCT embedding) AS different, min(len(embedding)) = max(len(embedding)) AS one_width FROM embeddings GROUP BY label")
def s10(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    rounds = v.filter("vec_id % 2 = 0").unionByName(v.filter("vec_id % 2 = 1"))
    return rounds.groupBy("label").agg(F.count("*").alias("n"), F.countDistinct("embedding").alias("different"), (F.min(F.size("embedding")) == F.max(F.size("embedding"))).alias("one_width"))


@query(
    "s10_round_order",
    """WITH v AS (SELECT vec_id, 'r' || (vec_id * 7 // 100 % 9) AS round, len(embedding) - CASE WHEN vec_id % 31 = 0 THEN 1 ELSE 0 END AS w FROM embeddings),
    f AS (SELECT round, min(vec_id) AS t, min(w) AS w FROM v GROUP BY round), p AS (SELECT round, CAST(row_number() OVER (ORDER BY t, round) AS INT) AS place, first_value(w) OVER (ORDER BY t, round) AS w0 FROM f)
    SELECT vec_id, place, w = w0 AS width_agrees FROM v JOIN p USING (round)""",
)
def s10_order(spark, sf_dir):
    """Baseline rounds in the order of their first times, some rows of another width."""
    v = table(spark, sf_dir, "embeddings").withColumn("round", F.concat(F.lit("r"), (F.floor(F.col("vec_id") * 7 / 100) % 9).cast("string")))
    v = v.withColumn("embedding", F.when(F.col("vec_id") % 31 == 0, F.slice("embedding", 1, F.size("embedding") - 1)).otherwise(F.col("embedding")))
    return S.concatenated(v, "round", "vec_id", "embedding").select("vec_id", "place", "width_agrees")


#: Micro-batches that the registered streams take at least, and the files that each part is written as at most.
STREAM_PARTS, PART_FILES = 3, 4


def written_in_parts(rows, at: str, path: str) -> None:
    """rows as JSON files that come one part after the other, in order of the column at."""
    low, high = rows.agg(F.min(at), F.max(at)).first()
    for k in range(STREAM_PARTS):
        bounds = [low + (high - low + 1) * i // STREAM_PARTS for i in (k, k + 1)] if low is not None else [0, 0]
        rows.filter(F.col(at).between(bounds[0], bounds[1] - 1)).repartition(PART_FILES).write.mode("append").json(path)


def event_stream(spark, sf_dir, *columns: str):
    """The events as a stream over a folder of JSON files (S3), which are read in several micro-batches in order of time."""
    path = S.scratch(spark, "tail")
    e = events(spark, sf_dir).select("event_id", "us", "pod", "workload", "syscall", "value")
    written_in_parts(e, "us", path)
    return T.tail(spark, path, e.schema, PART_FILES).select(*columns)


@query("s3_tail", f"WITH {EV} SELECT event_id, us, pod, syscall FROM ev")
def s3_tail(spark, sf_dir):
    """S3: files are tailed, rotated under the stream's feet and written anew, with a half-written last line in between."""
    path, new = S.scratch(spark, "live").removeprefix("file://"), S.scratch(spark, "next").removeprefix("file://")
    e = events(spark, sf_dir).select("event_id", "us", "pod", "syscall")
    lines = e.select(F.to_json(F.struct(*e.columns)).alias("value"), (F.col("event_id") % 2).alias("half"))
    for half, folder in ((0, path), (1, new)):
        lines.filter(F.col("half") == half).select("value").repartition(PART_FILES).write.text(f"file://{folder}")
    stream = S.json_lines(tail_lines(spark, f"{path}/*.txt").select("value"), "value", ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in e.schema))
    out = S.scratch(spark, "tailed")
    files = sorted(f for f in os.listdir(path) if f.endswith(".txt"))
    cut = {}
    for f in files:  # the last line's end is still to come
        with open(f"{path}/{f}", "r+b") as g:
            cut[f] = g.seek(-1, 2)
            g.truncate()
    T.run(stream, out)
    for f in files:
        with open(f"{path}/{f}", "ab") as g:
            g.write(b"\n")
        os.rename(f"{path}/{f}", f"{path}/{f}.1")
    T.run(stream, out)
    for f, name in zip(sorted(f for f in os.listdir(new) if f.endswith(".txt")), [*files, *(f"{i}.txt" for i in range(PART_FILES))]):
        os.rename(f"{new}/{f}", f"{path}/{name}")
    return T.run(stream, out)


@query(
    "st_late_rows",
    f"""WITH {EV}, a AS (SELECT *, us + CASE WHEN event_id % 5 = 0 THEN 7200000000 WHEN event_id % 7 = 0 THEN 259200000000 ELSE 0 END AS arrived FROM ev),
    m AS (SELECT *, coalesce(us <= max(us) OVER (PARTITION BY workload ORDER BY arrived, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS late FROM a)
    SELECT workload, event_id, us, late, CAST(sum(late::INT) OVER (PARTITION BY workload ORDER BY arrived, event_id) AS BIGINT) AS n_late FROM m""",
)
def st_w10(spark, sf_dir):
    """W10 on a stream: every fifth event arrives two hours late and others three days; late rows are marked and counted."""
    path = S.scratch(spark, "arrivals")
    delay = F.when(F.col("event_id") % 5 == 0, 7_200_000_000).when(F.col("event_id") % 7 == 0, 259_200_000_000).otherwise(0)
    e = events(spark, sf_dir).select("event_id", "us", "workload", (F.col("us") + delay).cast("long").alias("arrived"))
    written_in_parts(e, "arrived", path)
    return T.run(T.mark_late(T.tail(spark, path, e.schema, PART_FILES), "workload", "us", "arrived", "event_id"), S.scratch(spark, "late"))


@query(
    "st_anchored_windows",
    f"""WITH RECURSIVE {EV}, o AS (SELECT *, row_number() OVER (PARTITION BY workload ORDER BY us, event_id) AS k FROM ev),
    f AS (SELECT workload, k, us, us AS anchor FROM o WHERE k = 1 UNION ALL
      SELECT o.workload, o.k, o.us, CASE WHEN o.us - f.anchor >= 43200000000 THEN o.us WHEN o.us - f.anchor >= 21600000000 THEN f.anchor + 21600000000 ELSE f.anchor END FROM f JOIN o ON o.workload = f.workload AND o.k = f.k + 1),
    g AS (SELECT workload, anchor, count(*) AS n FROM f GROUP BY ALL) SELECT workload, anchor AS window_start, n FROM g WHERE anchor < (SELECT max(anchor) FROM g h WHERE h.workload = g.workload)""",
)
def st_w1(spark, sf_dir):
    """W1 on a stream: windows that a later event has closed."""
    return T.run(T.anchored_windows(event_stream(spark, sf_dir, "workload", "us", "event_id"), "workload", "us", 6 * 3_600_000_000), S.scratch(spark, "windows"))


def walk_sql(key: str, idle: str = "") -> str:
    """Expressions o, f and g: the windows (key, anchor, n) of W1 over ev by a walk over its ordered events; idle is a first case of its choice."""
    return f"""o AS (SELECT *, row_number() OVER w AS k, lag(us) OVER w AS before FROM ev WINDOW w AS (PARTITION BY {key} ORDER BY us, event_id)),
    f AS (SELECT {key}, k, us, us AS anchor FROM o WHERE k = 1 UNION ALL
      SELECT o.{key}, o.k, o.us, CASE {idle} WHEN o.us - f.anchor >= 43200000000 THEN o.us WHEN o.us - f.anchor >= 21600000000 THEN f.anchor + 21600000000 ELSE f.anchor END FROM f JOIN o ON o.{key} = f.{key} AND o.k = f.k + 1),
    g AS (SELECT {key}, anchor, count(*) AS n, max(us) AS last FROM f GROUP BY ALL)"""


@query(
    "st_idle_flush",
    f"""WITH RECURSIVE {EV}, {walk_sql("pod", "WHEN o.us - o.before >= 21600000000 THEN o.us")}, e AS (SELECT pod, max(us) AS ended FROM ev GROUP BY pod)
    SELECT pod, anchor AS window_start, n FROM g JOIN e USING (pod) WHERE last < ended OR (ended + 21600000000) // 1000 < ((SELECT max(us) FROM ev) - 3600000000) // 1000""",
)
def st_w3(spark, sf_dir):
    """W3 on a stream: the open window of a pod that was silent for a width is handed on when the watermark shows it."""
    e = event_stream(spark, sf_dir, "pod", "us")
    return T.run(T.anchored_windows(e, "pod", "us", 21_600_000_000, idle=21_600_000_000, delay="1 hour"), S.scratch(spark, "idle"))


@query("st_departed_keys", f"""WITH RECURSIVE {EV}, {walk_sql("workload")} SELECT workload, anchor AS window_start, n FROM g""")
def st_w4(spark, sf_dir):
    """W4 on a stream: a last row of each workload says that it departs, which hands on its open window."""
    path = S.scratch(spark, "departures")
    e = events(spark, sf_dir)
    rows = e.select("workload", "us", F.lit(False).alias("departs")).unionByName(e.groupBy("workload").agg((F.max("us") + 1).alias("us")).withColumn("departs", F.lit(True)))
    rows.write.json(path)
    return T.run(T.anchored_windows(T.tail(spark, path, rows.schema), "workload", "us", 21_600_000_000, closing="departs"), S.scratch(spark, "departed"))


@query(
    "st_cooldown",
    f"""WITH RECURSIVE {EV}, od AS (SELECT pod, us, row_number() OVER (PARTITION BY pod ORDER BY us) AS i FROM ev WHERE value > 100),
    cd AS (SELECT pod, i, us, us AS sent FROM od WHERE i = 1 UNION ALL SELECT od.pod, od.i, od.us, CASE WHEN od.us - cd.sent >= 172800000000 THEN od.us ELSE cd.sent END FROM cd JOIN od ON od.pod = cd.pod AND od.i = cd.i + 1)
    SELECT pod, us FROM cd WHERE sent = us""",
)
def st_g9(spark, sf_dir):
    return T.run(T.cooldown(event_stream(spark, sf_dir, "pod", "us", "value").filter("value > 100").drop("value"), "pod", "us", 172800000000), S.scratch(spark, "cooldown"))


@query(
    "st_sequence_rule",
    f"""WITH {EV}, lx AS (SELECT *, last_value(CASE WHEN syscall = 'execve' THEN us WHEN syscall = 'write' THEN -1 END IGNORE NULLS) OVER w AS lt FROM ev WINDOW w AS (PARTITION BY pod ORDER BY us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
    SELECT event_id, pod, lt AS first_us FROM lx WHERE syscall = 'setuid' AND lt >= 0 AND us - lt <= 43200000000""",
)
def st_g11(spark, sf_dir):
    return T.run(T.sequence_rule(event_stream(spark, sf_dir, "pod", "us", "event_id", "syscall"), 43200000000, ["setuid"], ["write"]), S.scratch(spark, "rule"))


@query(
    "st_confirmation",
    f"""WITH {EV}, i AS (SELECT *, sum(CASE WHEN value > 40 THEN 0 ELSE 1 END) OVER (PARTITION BY workload ORDER BY us, event_id) AS island FROM ev)
    SELECT workload, event_id, CAST(sum(CASE WHEN value > 40 THEN 1 ELSE 0 END) OVER (PARTITION BY workload, island ORDER BY us, event_id) AS BIGINT) AS run FROM i""",
)
def st_g5(spark, sf_dir):
    e = event_stream(spark, sf_dir, "workload", "us", "event_id", "value").withColumn("hit", F.col("value") > 40)
    return T.run(T.run_length(e, "workload", "us", "event_id", "hit"), S.scratch(spark, "runs"))


@query("st_agent_decisions")
def st_g17(spark, sf_dir):
    e = event_stream(spark, sf_dir, "pod", "us", "event_id", "value").withColumn("score", F.least(F.lit(1.0), F.col("value") / 400)).drop("value")
    return T.run(T.agent_decisions(e, "pod", "us", "event_id", "score", quiet=86_400_000_000.0), S.scratch(spark, "agents"))


@query("st_deduplicated", f"WITH {EV} SELECT DISTINCT pod, syscall, CAST(floor(us / 86400000000) AS BIGINT) AS day FROM ev")
def st_x4(spark, sf_dir):
    e = event_stream(spark, sf_dir, "pod", "us", "syscall").withColumn("day", F.floor(F.col("us") / 86400000000))
    return T.run(T.deduplicated(e, ["pod", "syscall", "day"], F.timestamp_micros("us"), "60 days").select("pod", "syscall", "day"), S.scratch(spark, "unique"))


@query("st_sliding_counts", f"WITH {EV}, b AS (SELECT workload, us // 21600000000 AS q FROM ev), s AS (SELECT workload, q - k AS start FROM b, (SELECT unnest(generate_series(0, 3)) AS k)) SELECT workload, start * 21600 AS start_s, count(*) AS n FROM s WHERE (start + 4) * 21600 <= (SELECT max(us) FROM ev) / 1e6 - 3600 GROUP BY ALL")
def st_w7(spark, sf_dir):
    """W7 on a stream: sliding windows with a watermark; those that it has passed come out."""
    e = event_stream(spark, sf_dir, "workload", "us")
    return T.run(T.sliding_counts(e, ["workload"], F.timestamp_micros("us"), "1 day", "6 hours", "1 hour"), S.scratch(spark, "sliding"))


@query("st_two_sinks", f"WITH {EV} SELECT event_id, syscall, value > 200 AS alert FROM ev")
def st_s5(spark, sf_dir):
    path = S.scratch(spark, "sinks")
    e = event_stream(spark, sf_dir, "event_id", "syscall", "value").select("event_id", "syscall", (F.col("value") > 200).alias("alert"))
    T.write_decisions(e, "alert", f"{path}/decisions", f"{path}/alerts", f"{path}/checkpoint")
    alerts = spark.read.schema("event_id long, syscall string, alert boolean").parquet(f"{path}/alerts").select("event_id", "alert")
    both = spark.read.schema("event_id long, syscall string, alert boolean").parquet(f"{path}/decisions")
    return both.drop("alert").join(alerts, "event_id", "left").select("event_id", "syscall", F.coalesce("alert", F.lit(False)).alias("alert"))
