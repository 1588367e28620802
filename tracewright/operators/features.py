"""Aggregations over events and windows: vocabularies, n-gram vectors, profiles and graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewright.functions.syscalls import BEHAVIOUR_SYSCALLS, hash_bin


def vocabulary(names: DataFrame, name: str) -> DataFrame:
    """A1: (term, idx): the sorted names, then all ordered pairs a|b.

    Only the different names are numbered in one place; a pair's index follows from the numbers of its names, so their
    square is made and kept in parallel.
    """
    one = names.select(F.col(name).alias("a")).filter("a is not null").distinct()
    ranked = one.select("a", (F.row_number().over(Window.orderBy("a")) - 1).alias("r"))
    n = one.agg(F.count("*").cast("int").alias("n"))
    pairs = ranked.crossJoin(ranked.select(F.col("a").alias("b"), F.col("r").alias("s"))).crossJoin(n)
    return ranked.select(F.col("a").alias("term"), F.col("r").alias("idx")).union(pairs.select(F.concat_ws("|", "a", "b"), F.col("n") * (1 + F.col("r")) + F.col("s")))


def extend_vocabulary(vocab: DataFrame, required: DataFrame, name: str) -> DataFrame:
    """A2: vocab with required names that it lacks after its last index, in order."""
    new = required.select(F.col(name).alias("term")).distinct().join(vocab, "term", "left_anti")
    last = vocab.agg(F.max("idx").alias("last"))
    return vocab.unionByName(new.withColumn("k", F.row_number().over(Window.orderBy("term"))).crossJoin(last).select("term", (F.col("last") + F.col("k")).alias("idx")))


def ngram_weights(events: DataFrame, window: list[str], order: list[str], name: str) -> DataFrame:
    """A3: (window, term, weight): unigrams and adjacent pairs, both divided by the window's number of events."""
    w = Window.partitionBy(*window)
    rows = events.withColumn("_next", F.lead(name).over(w.orderBy(*order))).withColumn("_n", F.count("*").over(w))
    terms = rows.select(*window, "_n", F.explode(F.array_compact(F.array(F.col(name), F.when(F.col("_next").isNotNull(), F.concat_ws("|", name, "_next"))))).alias("term"))
    return terms.groupBy(*window, "term").agg((F.count("*") / F.first("_n")).alias("weight"))


def syscall_counts(events: DataFrame, window: list[str], name: str) -> DataFrame:
    """A4: (window, name, n, total)."""
    counts = events.groupBy(*window, name).agg(F.count("*").alias("n"))
    return counts.withColumn("total", F.sum("n").over(Window.partitionBy(*window)))


def top_syscalls(counts: DataFrame, window: list[str], name: str, k: int = 5) -> DataFrame:
    """A5: the k most frequent names of a window with their share; ties by name."""
    rank = F.row_number().over(Window.partitionBy(*window).orderBy(F.desc("n"), name))
    return counts.withColumn("rank", rank).filter(F.col("rank") <= k).withColumn("freq", F.col("n") / F.col("total"))


def profile(events: DataFrame, key: str, group: str, order: list[str], name: str) -> DataFrame:
    """(group, before, name, n, p): how often a name follows another, and its share."""
    before = F.lag(name).over(Window.partitionBy(key).orderBy(*order))
    n = events.withColumn("before", before).filter("before is not null").groupBy(group, "before", name).agg(F.count("*").alias("n"))
    return n.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy(group, "before")))


def unigrams(events: DataFrame, group: str, name: str) -> DataFrame:
    """(group, name, n, p): how often a name occurs, and its share."""
    n = events.groupBy(group, name).agg(F.count("*").alias("n"))
    return n.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy(group)))


def bin_distribution(rows: DataFrame, group: str, value: str, bits: int = 6) -> DataFrame:
    """(group, bin, p): shares of the hash bins of a number; they sum to 1."""
    n = rows.groupBy(group, hash_bin(F.col(value), bits).alias("bin")).agg(F.count("*").alias("n"))
    return n.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy(group)))


def suspicious_mass(events: DataFrame, window: list[str], name: str) -> DataFrame:
    """Share of the sensitive names."""
    return events.groupBy(*window).agg((F.count_if(F.col(name).isin(*BEHAVIOUR_SYSCALLS)) / F.count("*")).alias("mass"))


def graph_edges(messages: DataFrame, pod: str, agent: str, tool: str, resources: str) -> DataFrame:
    """(src, dst, kind, n): pod hosts agent, agent calls tool, tool touches resource."""
    pair = lambda rows, a, b, kind: rows.groupBy(F.col(a).cast("string").alias("src"), F.col(b).cast("string").alias("dst")).agg(F.count("*").alias("n")).withColumn("kind", F.lit(kind))
    touched = messages.select(tool, F.explode(resources).alias("_resource"))
    return pair(messages, pod, agent, "hosts").union(pair(messages, agent, tool, "calls")).union(pair(touched, tool, "_resource", "touches"))


def graph_nodes(edges: DataFrame) -> DataFrame:
    """(node, kind)."""
    ends = {"hosts": ("pod", "agent"), "calls": ("agent", "tool"), "touches": ("tool", "resource")}
    both = F.array(*[F.struct(F.col(c).alias("node"), F.coalesce(*[F.when(F.col("kind") == k, v[i]) for k, v in ends.items()]).alias("kind")) for i, c in enumerate(("src", "dst"))])
    return edges.select(F.explode(both).alias("x")).select("x.*").distinct()


def graph_features(messages: DataFrame, group: str, agent: str, time: str) -> DataFrame:
    """The eleven features of each group's graph: totals, rate over the observed span of at least a second, variety,
    risk, the most calls of a tool and touches of a resource, the entropy of tools in bits, and KiB.

    messages have tool, resources, high_risk and raw_bytes.
    """
    tools = messages.groupBy(group, "tool").agg(F.count("*").alias("k"))
    p = F.col("k") / F.sum("k").over(Window.partitionBy(group))
    by_tool = tools.withColumn("p", p).groupBy(group).agg(F.count("*").alias("tools"), F.max("k").alias("max_tool_calls"), (-F.sum(F.col("p") * F.log2("p"))).alias("tool_entropy"))
    touched = messages.select(group, F.explode("resources").alias("_r")).groupBy(group, "_r").agg(F.count("*").alias("k"))
    by_resource = touched.groupBy(group).agg(F.count("*").alias("resources"), F.max("k").alias("max_resource_touches"))
    base = messages.groupBy(group).agg(
        F.count("*").alias("events_total"), (F.count("*") / F.greatest(F.max(time) - F.min(time), F.lit(1.0))).alias("rate"), F.countDistinct(agent).alias("agents"),
        F.count_if("high_risk").alias("high_risk_events"), (F.count_if("high_risk") / F.count("*")).alias("risk_ratio"), (F.sum("raw_bytes") / 1024.0).alias("raw_kib"),
    )
    none = F.lit(0).cast("long")
    out = base.join(by_tool, group).join(by_resource, group, "left")
    return out.withColumn("resources", F.coalesce("resources", none)).withColumn("max_resource_touches", F.coalesce("max_resource_touches", none))


def node_features(edges: DataFrame, messages: DataFrame, agent: str, time: str) -> DataFrame:
    """(node, kind, one-hot kind, degrees, five globals): kinds as is_..., log1p of both degrees, and of the whole
    graph the event rate, the numbers of tools and resources, the share of risk and the entropy of tools; these are one row."""
    nodes = graph_nodes(edges)
    whole = graph_features(messages.withColumn("_all", F.lit(0)), "_all", agent, time)
    whole = whole.select(*[F.col(c).alias(f"g_{c}") for c in ("rate", "tools", "resources", "risk_ratio", "tool_entropy")])
    kinds = [(F.col("kind") == k).cast("int").alias(f"is_{k}") for k in ("agent", "pod", "tool", "resource")]
    return nodes.join(node_degrees(edges, nodes), "node").crossJoin(F.broadcast(whole)).select("node", "kind", *kinds, "out_degree", "in_degree", *whole.columns)


def node_degrees(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """log1p of weighted out- and in-degree, edges taken both ways."""
    both = edges.select("src", "dst", "n").union(edges.select("dst", "src", "n"))
    out = both.groupBy(F.col("src").alias("node")).agg(F.sum("n").alias("o"))
    into = both.groupBy(F.col("dst").alias("node")).agg(F.sum("n").alias("i"))
    names = nodes.select("node").distinct()
    return names.join(out, "node", "left").join(into, "node", "left").select("node", F.log1p(F.coalesce("o", F.lit(0))).alias("out_degree"), F.log1p(F.coalesce("i", F.lit(0))).alias("in_degree"))


def diversity(messages: DataFrame, group: list[str], agent: str, pod: str, time: str) -> DataFrame:
    """Distinct agents and pods and the time span."""
    return messages.groupBy(*group).agg(F.countDistinct(agent).alias("agents"), F.countDistinct(pod).alias("pods"), (F.max(time) - F.min(time)).alias("span"))
