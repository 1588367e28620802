"""Queries on projection, filters and scalar rules."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import functions as F

from tracewright.functions import syscalls as S
from tracewright.registry import query
from tracewright.sources.tables import EV, events, table

_BINARIES = ["/usr/sbin/nginx", "/bin/sh", "/usr/bin/curl", "/opt/app", "/BIN/BASH"]
_KERNEL = sorted(S.KERNEL_NAMES)[:12] + ["do_exit", "sys_futex"]


def _pick(values: list[str], i) -> F.Column:
    return F.array(*map(F.lit, values))[i.cast("int")]


def _pick_sql(values: list[str], i: str) -> str:
    return "list_extract([" + ", ".join(f"'{v}'" for v in values) + f"], CAST({i} + 1 AS INT))"


@query(
    "f1_syscall_names",
    f"""WITH e AS (SELECT event_id, {_pick_sql(_KERNEL, f"event_id % {len(_KERNEL)}")} AS fn FROM events),
    m(fn, syscall) AS (VALUES {", ".join(f"('{k}', '{v}')" for k, v in S.KERNEL_NAMES.items())})
    SELECT syscall, count(*) AS n, min(event_id) AS first_event FROM e JOIN m USING (fn) GROUP BY syscall""",
)
def f1(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", S.syscall_name(_pick(_KERNEL, F.col("event_id") % len(_KERNEL))).alias("syscall"))
    return e.filter("syscall is not null").groupBy("syscall").agg(F.count("*").alias("n"), F.min("event_id").alias("first_event"))


@query(
    "f2_exec_events",
    """SELECT event_id, CASE WHEN event_type = 'signup' THEN 'execve' ELSE event_type END AS syscall, 'ns/p' || user_id AS pod
    FROM events WHERE user_id % 10 <> 3""",
)
def f2(spark, sf_dir):
    """Exec records count as execve; records without a pod go."""
    e = table(spark, sf_dir, "events")
    e = e.withColumn("pod", F.when(F.col("user_id") % 10 != 3, F.concat(F.lit("ns/p"), F.col("user_id").cast("string"))))
    return e.filter("pod is not null").select("event_id", F.when(F.col("event_type") == "signup", "execve").otherwise(F.col("event_type")).alias("syscall"), "pod")


@query(
    "f3_event_time",
    """SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 1.5 ELSE round(epoch_us(ts) / 1e6, 6) END AS seconds FROM events""",
)
def f3(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    text = F.date_format(F.col("ts").cast("timestamp_ntz"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    text = F.when(F.col("event_id") % 7 == 0, "not a time").when(F.col("event_id") % 3 == 0, F.concat(text, F.lit("999Z"))).when(F.col("event_id") % 3 == 1, F.concat(text, F.lit("+00:00"))).otherwise(text)
    return e.select("event_id", F.round(S.event_seconds(text, F.lit(1.5)), 6).alias("seconds"))


_POD = ["shop/cart-5d8c7b9f6d-x2x4z", "db/redis-0", "shop/api-gateway", "mq/kafka-broker-12", "shop/a-b-5d8c7b9f6-abc12", "solo"]


@query(
    "f4_workloads",
    f"""WITH p AS (SELECT o_orderkey AS k, {_pick_sql(_POD, f"o_orderkey % {len(_POD)}")} AS pod FROM orders)
    SELECT pod, CASE pod WHEN '{_POD[0]}' THEN 'shop/cart' WHEN '{_POD[1]}' THEN 'db/redis' WHEN '{_POD[3]}' THEN 'mq/kafka-broker'
      WHEN '{_POD[4]}' THEN 'shop/a-b' ELSE pod END AS workload, count(*) AS n FROM p GROUP BY ALL""",
)
def f4(spark, sf_dir):
    p = table(spark, sf_dir, "orders").select(_pick(_POD, F.col("o_orderkey") % len(_POD)).alias("pod"))
    return p.groupBy("pod", S.workload_of(F.col("pod")).alias("workload")).agg(F.count("*").alias("n"))


@query(
    "f5_roles",
    f"""WITH p AS (SELECT {_pick_sql(_POD, f"o_orderkey % {len(_POD)}")} || ':main' AS pod FROM orders)
    SELECT CASE WHEN pod LIKE '%kafka%' THEN 'kafka-broker' WHEN pod LIKE '%redis%' THEN 'redis' WHEN pod LIKE '%api-gateway%' THEN 'stateless-http'
      ELSE 'other-production' END AS role, split_part(list_last(string_split(pod, '/')), ':', 1) AS stable, count(*) AS n FROM p GROUP BY ALL""",
)
def f5(spark, sf_dir):
    p = table(spark, sf_dir, "orders").select(F.concat(_pick(_POD, F.col("o_orderkey") % len(_POD)), F.lit(":main")).alias("pod"))
    return p.groupBy(S.role_of(F.col("pod")).alias("role"), S.stable_workload(F.col("pod")).alias("stable")).agg(F.count("*").alias("n"))


_NS = ["prod", "kube-system", "shop", "monitoring"]


@query(
    "f6_namespace_filter",
    f"""SELECT ns, count(*) AS n FROM (SELECT {_pick_sql(_NS, "c_custkey % 4")} AS ns FROM customer)
    WHERE ns NOT IN ('kube-system', 'kube-public', 'kube-node-lease', 'cilium', 'monitoring') GROUP BY ns""",
)
def f6(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(_pick(_NS, F.col("c_custkey") % 4).alias("ns"))
    return c.filter(~F.col("ns").isin(*S.SYSTEM_NAMESPACES)).groupBy("ns").agg(F.count("*").alias("n"))


@query("f7_modelled_workloads", f"WITH {EV} SELECT event_id, workload, syscall FROM ev WHERE workload IN (SELECT workload FROM ev GROUP BY workload HAVING count(*) > (SELECT count(*) / 8.0 FROM ev))")
def f7(spark, sf_dir):
    """A semi join before any state; the list of models is a small table, which the engine may send to all tasks."""
    e = events(spark, sf_dir)
    total = e.agg((F.count("*") / 8.0).alias("fair"))
    models = e.groupBy("workload").agg(F.count("*").alias("n")).join(total, F.col("n") > F.col("fair")).select("workload")
    return e.join(models, "workload", "left_semi").select("event_id", "workload", "syscall")


@query(
    "f8_model_keys",
    """WITH p AS (SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'ns/web-' || (s_suppkey % 5) ELSE 'ns/db-' || (s_suppkey % 4) END AS pod FROM supplier),
    m(k) AS (VALUES ('ns/web-0'), ('ns/web'), ('ns/db-1'))
    SELECT s_suppkey, CASE WHEN pod IN (SELECT k FROM m) THEN pod WHEN regexp_replace(pod, '-[0-9]+$', '') IN (SELECT k FROM m) THEN regexp_replace(pod, '-[0-9]+$', '') END AS model FROM p""",
)
def f8(spark, sf_dir):
    """The model of the very key, else that of the same workload."""
    n = F.col("s_suppkey")
    p = table(spark, sf_dir, "supplier").select("s_suppkey", F.when(n % 3 == 0, F.concat(F.lit("ns/web-"), (n % 5).cast("string"))).otherwise(F.concat(F.lit("ns/db-"), (n % 4).cast("string"))).alias("pod"))
    models = F.broadcast(spark.createDataFrame([("ns/web-0",), ("ns/web",), ("ns/db-1",)], "model string"))  # a fixed list
    exact = models.select(F.col("model").alias("pod"), F.col("model").alias("exact"))
    loose = models.select(F.col("model").alias("workload"), F.col("model").alias("loose"))
    return p.join(exact, "pod", "left").withColumn("workload", S.workload_of(F.col("pod"))).join(loose, "workload", "left").select("s_suppkey", F.coalesce("exact", "loose").alias("model"))


@query(
    "f9_network_binaries",
    f"SELECT path, count(*) AS n FROM (SELECT {_pick_sql(_BINARIES, 'event_id % 5')} AS path FROM events) WHERE regexp_matches(lower(path), '({'|'.join(S.NETWORK_BINARIES)})$') GROUP BY path",
)
def f9(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(_pick(_BINARIES, F.col("event_id") % 5).alias("path"))
    return e.filter(S.is_network_binary(F.col("path"))).groupBy("path").agg(F.count("*").alias("n"))


@query(
    "f10_hash_bins",
    """SELECT ((l_partkey * 2654435761) & 4294967295) >> 26 AS bin, (((xor(l_partkey << 16, l_suppkey)) * 2654435761) & 4294967295) >> 26 AS pair_bin, count(*) AS n
    FROM lineitem GROUP BY ALL""",
)
def f10(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    return l.groupBy(S.hash_bin(F.col("l_partkey"), 6).alias("bin"), S.hash_bin_pair(F.col("l_partkey"), F.col("l_suppkey"), 6).alias("pair_bin")).agg(F.count("*").alias("n"))


def agent_messages(spark, sf_dir):
    """Conversation turns as JSON-RPC payloads: calls that name their tool in three ways, resources at several depths,
    batches, answers, entries without a method and broken text."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5("text").alias("h"))
    t = F.col("turn")
    name = F.when(t % 3 == 0, "name").when(t % 3 == 1, "tool").otherwise("tool_name")
    tool = F.when(t % 4 == 0, "kubectl_delete").when(t % 4 == 1, "read_file").otherwise("list_items")
    path = F.concat(F.lit("/"), F.substring("h", 1, 2))
    flat = F.concat(F.lit('{"path":"'), path, F.lit('"}'))
    deep = F.concat(F.lit('{"spec":{"items":[{"Path":["'), path, F.lit('",7]},{"pod":{"x":"'), F.when(t % 6 == 1, "db-credential").otherwise("web"), F.lit('"}}],"size":3}}'))
    call = F.concat(F.lit('{"jsonrpc":"2.0","id":1,"method":"tools/call","params":{"'), name, F.lit('":"'), tool, F.lit('","arguments":'), F.when(t % 2 == 0, flat).otherwise(deep), F.lit("}}"))
    payload = F.when(t % 5 == 4, "broken").when(t % 3 == 2, F.concat(F.lit("["), call, F.lit(',{"jsonrpc":"2.0","id":1,"result":{}},3,{"method":"tools/list"}]'))).otherwise(call)
    return c.select("conv_id", "turn", payload.alias("payload"))


def _plain(value) -> str:
    return value if isinstance(value, str) else str(value)


def resource_values(params: str | None) -> list[str]:
    """the single values below a resource's key at any depth, in no order; none if params is no JSON."""
    try:
        todo = [(json.loads(params), False)] if params else []
    except (ValueError, RecursionError):
        return []
    out = []
    while todo:
        value, named = todo.pop()
        if isinstance(value, dict):
            todo += [(v, named or k.lower() in S.RESOURCE_KEYS) for k, v in value.items()]
        elif isinstance(value, list):
            todo += [(v, named) for v in value]
        elif named and value is not None:
            out.append(_plain(value))
    return out


def parse_agent_messages(messages):
    """one row for each entry with a method: method, tool, resources as digests, high_risk, raw_bytes.

    A payload is an object or an array of objects; what is neither, or has no method, goes. Resources lie at any depth, so
    their values come from one Arrow pass over the parameters; all else are column functions.
    """

    def values_of(params: pd.Series) -> pd.Series:
        return params.map(resource_values)

    entry = "struct<method:string,params:string>"
    # a batch is cut into its entries as text first, so that one of another kind doesn't spoil the others
    entries = F.explode(F.when(F.ltrim("payload").startswith("["), F.from_json("payload", "array<string>")).otherwise(F.array("payload")))
    kept = [c for c in messages.columns if c != "payload"]
    rows = messages.select(*kept, F.octet_length("payload").cast("long").alias("raw_bytes"), entries.alias("e")).withColumn("e", F.from_json("e", entry)).filter("e.method is not null and e.method <> ''")
    rows = rows.select(*kept, "raw_bytes", F.col("e.method").alias("method"), F.col("e.params").alias("params"))
    named = lambda k: F.nullif(F.get_json_object("params", f"$.{k}"), F.lit(""))
    tool = F.coalesce(F.when(F.col("method").isin(*S.TOOL_METHODS), F.coalesce(named("name"), named("tool"), named("tool_name"))), F.col("method"))
    rows = rows.withColumn("tool", tool).withColumn("values", F.pandas_udf(values_of, "array<string>")("params"))
    digests = F.array_sort(F.array_distinct(F.transform("values", lambda v: F.substring(F.sha2(v, 256), 1, 16))))
    return rows.select(*kept, "method", "tool", digests.alias("resources"), S.is_high_risk(F.col("tool"), F.col("values")).alias("high_risk"), "raw_bytes")


AGENT_SQL = """c AS (SELECT conv_id, turn, substr(md5(text), 1, 2) AS h FROM conversations WHERE turn % 5 <> 4),
bodies AS (SELECT *, CASE turn % 4 WHEN 0 THEN 'kubectl_delete' WHEN 1 THEN 'read_file' ELSE 'list_items' END AS tool, CASE WHEN turn % 6 = 1 THEN 'db-credential' ELSE 'web' END AS deep,
    CASE turn % 3 WHEN 0 THEN 'name' WHEN 1 THEN 'tool' ELSE 'tool_name' END AS key FROM c),
sized AS (SELECT *, length('{"jsonrpc":"2.0","id":1,"method":"tools/call","params":{"' || key || '":"' || tool || '","arguments":' ||
    CASE WHEN turn % 2 = 0 THEN '{"path":"/' || h || '"}' ELSE '{"spec":{"items":[{"Path":["/' || h || '",7]},{"pod":{"x":"' || deep || '"}}],"size":3}}' END || '}}')
    + CASE WHEN turn % 3 = 2 THEN length('[,{"jsonrpc":"2.0","id":1,"result":{}},3,{"method":"tools/list"}]') ELSE 0 END AS raw_bytes FROM bodies),
calls AS (SELECT conv_id, turn, 'tools/call' AS method, tool,
    list_sort([substr(sha256(v), 1, 16) FOR v IN CASE WHEN turn % 2 = 0 THEN ['/' || h] ELSE ['/' || h, '7', deep] END]) AS resources,
    turn % 4 = 0 OR (turn % 2 = 1 AND turn % 6 = 1) AS high_risk, CAST(raw_bytes AS BIGINT) AS raw_bytes FROM sized
  UNION ALL SELECT conv_id, turn, 'tools/list', 'tools/list', [], false, CAST(raw_bytes AS BIGINT) FROM sized WHERE turn % 3 = 2)"""


@query("f11_agent_messages", f"WITH {AGENT_SQL} SELECT conv_id, turn, method, tool, array_to_string(resources, ',') AS resources, high_risk, raw_bytes FROM calls")
def f11(spark, sf_dir):
    return parse_agent_messages(agent_messages(spark, sf_dir)).withColumn("resources", F.array_join("resources", ","))


@query(
    "f14_techniques",
    f"""WITH {EV}, w AS (SELECT DISTINCT workload, CAST(floor(us / 86400000000) AS BIGINT) AS day, syscall FROM ev),
    r(call, id, confidence) AS (VALUES ('execve', 'T1059', 'high'), ('connect', 'T1046', 'medium'), ('setuid', 'T1548', 'high'))
    SELECT workload, day, id, confidence FROM w JOIN r ON call = syscall""",
)
def f14(spark, sf_dir):
    w = events(spark, sf_dir).groupBy("workload", F.floor(F.col("us") / 86400000000).alias("day")).agg(F.collect_set("syscall").alias("names"))
    return w.select("workload", "day", F.explode(S.techniques(F.col("names"))).alias("x")).select("workload", "day", "x.id", "x.confidence")


@query(
    "f15_sparse_vectors",
    """SELECT vec_id, CAST(i - 1 AS INT) AS i, round(round(CAST(embedding[i] AS DOUBLE), 2), 6) AS v
    FROM embeddings, unnest(generate_series(1, 64)) AS g(i) WHERE round(CAST(embedding[i] AS DOUBLE), 2) <> 0""",
)
def f15(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    pairs = S.sparse(S.dense(S.sparse(F.col("embedding"), 2), 64), 2)
    return e.select("vec_id", F.explode(pairs).alias("x")).select("vec_id", "x.i", F.round("x.v", 6).alias("v"))


@query(
    "f17_startup_grace",
    """WITH o AS (SELECT o_orderkey AS k, CAST(o_orderkey % 50 AS DOUBLE) AS ended, CAST(o_orderkey % 37 AS DOUBLE) AS created, (o_orderkey % 11) * CAST(0.002 AS DOUBLE) AS drift FROM orders)
    SELECT k, round(greatest(0.0, ended - created), 6) AS age, greatest(0.0, ended - created) < 20 AS starting, drift > 0.010 AS inconsistent FROM o""",
)
def f17(spark, sf_dir):
    k = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders").select(k.alias("k"), ((k % 50) * F.lit(1.0)).alias("ended"), ((k % 37) * F.lit(1.0)).alias("created"), ((k % 11) * F.lit(0.002)).alias("drift"))
    age = F.greatest(F.lit(0.0), F.col("ended") - F.col("created"))
    return o.select("k", F.round(age, 6).alias("age"), (age < 20).alias("starting"), (F.col("drift") > 0.010).alias("inconsistent"))


@query("f18_column_digest", """SELECT c_custkey, sha256('["' || c_mktsegment || '","' || c_custkey || '"]') AS digest FROM customer""")
def f18(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return c.select("c_custkey", F.sha2(F.to_json(F.array("c_mktsegment", F.col("c_custkey").cast("string"))), 256).alias("digest"))


@query(
    "f19_event_digest",
    """WITH s AS (SELECT event_id, event_type AS t, user_id AS u, CASE WHEN event_id % 5 = 0 THEN 'changed' ELSE event_type END AS t2, CASE WHEN event_id % 7 = 0 THEN user_id + 1 ELSE user_id END AS u2 FROM events)
    SELECT event_id, sha256('{"event_type":"' || t2 || '","user_id":' || u2 || '}') AS digest, sha256('{"event_type":"' || t2 || '","user_id":' || u2 || '}') = sha256('{"event_type":"' || t || '","user_id":' || u || '}') AS verified
    FROM s WHERE event_id % 11 <> 3""",
)
def f19(spark, sf_dir):
    """A record's id is the digest of its canonical JSON, stored when it is collected. Some records are changed and some lost
    before they are read again; verified where the digest of what is read is the stored one."""
    e = table(spark, sf_dir, "events")
    digest = F.sha2(F.to_json(F.struct("event_type", "user_id")), 256)
    stored = e.select("event_id", digest.alias("stored"))
    read = e.filter("event_id % 11 <> 3").select("event_id", F.when(F.col("event_id") % 5 == 0, "changed").otherwise(F.col("event_type")).alias("event_type"), F.when(F.col("event_id") % 7 == 0, F.col("user_id") + 1).otherwise(F.col("user_id")).alias("user_id"))
    return read.select("event_id", digest.alias("digest")).join(stored, "event_id").select("event_id", "digest", (F.col("digest") == F.col("stored")).alias("verified"))


@query(
    "f20_rule_alerts",
    """SELECT event_id, round(epoch_us(ts) / 1e6, 6) AS seconds, 'Warning' AS priority, 'Rule ' || event_type AS rule, 'shop-' || user_id AS pod
    FROM events WHERE event_id % 4 <> 0 AND user_id % 2 = 0""",
)
def f20(spark, sf_dir):
    """A rule engine's text lines: time, priority, rule, namespace and pod, only those in scope."""
    e = table(spark, sf_dir, "events")
    text = F.concat(F.date_format(F.col("ts").cast("timestamp_ntz"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"), F.lit(": Warning Rule "), F.col("event_type"), F.lit(" (ns="), F.when(F.col("event_id") % 4 == 0, "kube-system").otherwise("production"), F.lit(" pod="), F.when(F.col("user_id") % 2 == 0, "shop-").otherwise("other-"), F.col("user_id").cast("string"), F.lit(")"))
    got = lambda p: F.regexp_extract("line", p, 1)
    rows = e.select("event_id", text.alias("line")).select("event_id", F.round(S.event_seconds(got(r"^(\S+): "), F.lit(None).cast("double")), 6).alias("seconds"), got(r"^\S+: (\w+) ").alias("priority"), got(r"^\S+: \w+ (.*?) \(").alias("rule"), got(r"ns=(\S+)").alias("ns"), got(r"pod=([^)\s]+)").alias("pod"))
    return rows.filter((F.col("ns") == "production") & F.col("pod").startswith("shop")).drop("ns")


@query(
    "f22_ratio_features",
    f"""WITH {EV}, c AS (SELECT workload, count(*) AS n, count(*) FILTER (syscall = 'execve') AS x, count(*) FILTER (syscall IN ('read', 'write')) AS rw FROM ev GROUP BY workload)
    SELECT workload, round(ln(1 + n), 6) AS log_total, round(ln(1 + x), 6) AS log_exec, round(x / n, 6) AS exec_share, greatest(0, n - x - rw) AS other, round((n - rw) / n, 6) AS sensitive FROM c""",
)
def f22(spark, sf_dir):
    c = events(spark, sf_dir).groupBy("workload").agg(F.count("*").alias("n"), F.count_if(F.col("syscall") == "execve").alias("x"), F.count_if(F.col("syscall").isin("read", "write")).alias("rw"))
    n, x, rw = F.col("n"), F.col("x"), F.col("rw")
    return c.select("workload", F.round(F.log1p(n), 6).alias("log_total"), F.round(F.log1p(x), 6).alias("log_exec"), F.round(x / n, 6).alias("exec_share"), F.greatest(F.lit(0).cast("long"), n - x - rw).alias("other"), F.round((n - rw) / n, 6).alias("sensitive"))
