"""Model application over feature vectors: scaling, reconstruction, isolation, conformal p values, calibration."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from decimal import Decimal
from functools import reduce
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.operators.robust import QUANTILE_BUCKETS, counted_quantiles, quantile, value_bucket
from tracewright.sources.files import written


def standardised(rows: DataFrame, stats: DataFrame, key: list[str], value: str, floor: float = 0.01, limit: float = 10.0) -> DataFrame:
    """M1: adds z: (value - mean) / max(std, floor), within ±limit; stats (key, mean, std) come from the fitting rows."""
    z = (F.col(value) - F.col("mean")) / F.greatest("std", F.lit(floor))
    return rows.join(stats, key).withColumn("z", F.greatest(F.lit(-limit), F.least(F.lit(limit), z))).drop("mean", "std")


def error_score(error: Column, limit: Column, scale: Column) -> Column:
    """M3: sigmoid of (error - limit) / scale, shifted so that an error at the limit scores 0.2."""
    x = F.greatest(F.lit(-60.0), F.least(F.lit(60.0), (error - limit) / scale + math.log(0.2 / 0.8)))
    return 1 / (1 + F.exp(-x))


def ensemble(first: Column, second: Column, component: Column) -> Column:
    """M4: 0.8 and 0.2 of two scores, or one of them alone."""
    return F.when(component == "first", first).when(component == "second", second).otherwise(0.8 * first + 0.2 * second)


#: Models up to this size, all keys together, are sent to all tasks; larger ones are joined to the rows.
MODEL_BYTES = 16 << 20


def applied(rows: DataFrame, model: DataFrame, size: Column, key: str, row_id: str, vector: str, name: str, unpack: Callable[[pd.Series], Any], score: Callable[[Any, np.ndarray], np.ndarray]) -> DataFrame:
    """(key, row_id, name): score(model of the row's key, matrix of vectors), null without a model or a vector.

    model has one row for each key; size is the bytes of a row, and unpack makes it ready for score. Models are written
    once and measured. Up to MODEL_BYTES rows are scored where they are read, without a shuffle, so a hot key is nothing
    special; beyond, by a join with one row on the model's side, which adaptive execution splits where a key is hot.
    """
    model = written(model, name)
    read = rows.select(key, row_id, vector)
    schema = f"`{key}` {rows.schema[key].dataType.simpleString()}, `{row_id}` {rows.schema[row_id].dataType.simpleString()}, `{name}` double"

    def score_all(parts: Iterator[pd.DataFrame], find: Callable[[Any, pd.Series], Any]) -> Iterator[pd.DataFrame]:
        for p in parts:
            out, there = np.full(len(p), np.nan), p[vector].notna().to_numpy()
            codes, keys = pd.factorize(p[key], use_na_sentinel=False)
            for c, k in enumerate(keys):
                at = np.flatnonzero((codes == c) & there)
                if len(at) and (m := find(None if pd.isna(k) else k, p.iloc[at[0]])) is not None:
                    out[at] = score(m, np.stack(p[vector].to_numpy()[at]).astype(float))
            yield pd.DataFrame({key: p[key], row_id: p[row_id], name: out})

    if (model.agg(F.sum(size)).first()[0] or 0) <= MODEL_BYTES:
        held = {None if pd.isna(m[key]) else m[key]: unpack(m) for _, m in model.toPandas().iterrows()}
        return read.mapInPandas(lambda parts: score_all(parts, lambda k, _: held.get(k)), schema)
    own = model.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_{c}") for c in model.columns if c != key], F.lit(True).alias("_has"))
    joined = read.join(own, read[key].eqNullSafe(own["_key"]), "left")
    plain = {c: c[1:] for c in own.columns}
    return joined.mapInPandas(lambda parts: score_all(parts, lambda _, row: unpack(row[[*plain]].rename(plain)) if row["_has"] == 1 else None), schema)


def fit_components(rows: DataFrame, key: str, vector: str, k: int) -> DataFrame:
    """M2: (key, mean, components) by principal components. Tasks send sums and products, never rows."""
    kind = rows.schema[key].dataType.simpleString()

    def sums(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}
        for p in parts:
            for g, part in p.groupby(key):
                x = np.stack(part[vector].to_numpy()).astype(float)
                n, s, c = held.get(g, (0, 0.0, 0.0))
                held[g] = (n + len(x), s + x.sum(axis=0), c + x.T @ x)
        if held:
            yield pd.DataFrame({key: list(held), "n": [v[0] for v in held.values()], "s": [v[1] for v in held.values()], "c": [v[2].ravel() for v in held.values()]})

    def solve(g: tuple, p: pd.DataFrame) -> pd.DataFrame:
        n, s = p["n"].sum(), np.sum(np.stack(p["s"].to_numpy()), axis=0)
        c = np.sum(np.stack(p["c"].to_numpy()), axis=0).reshape(len(s), len(s)) / n - np.outer(s, s) / n**2
        _, v = np.linalg.eigh(c)
        return pd.DataFrame({key: [g[0]], "mean": [s / n], "components": [v[:, ::-1][:, :k].ravel()]})

    parts = rows.select(key, vector).mapInPandas(sums, f"`{key}` {kind}, n long, s array<double>, c array<double>")
    return parts.groupBy(key).applyInPandas(solve, f"`{key}` {kind}, mean array<double>, components array<double>")


def reconstruction_error(rows: DataFrame, model: DataFrame, key: str, row_id: str, vector: str) -> DataFrame:
    """M2: (key, row_id, error): mean squared rest after projection; see applied."""

    def unpack(m: pd.Series) -> tuple[np.ndarray, np.ndarray]:
        mean = np.asarray(m["mean"], float)
        return mean, np.asarray(m["components"], float).reshape(len(mean), -1)

    def score(m: tuple[np.ndarray, np.ndarray], x: np.ndarray) -> np.ndarray:
        x = x - m[0]
        return ((x - x @ m[1] @ m[1].T) ** 2).mean(axis=1)

    return applied(rows, model, 8 * (F.size("mean") + F.size("components")), key, row_id, vector, "error", unpack, score)


def isolation_scores(rows: DataFrame, key: str, row_id: str, vector: str, trees: int = 16, sample: int = 64, seed: int = 7) -> DataFrame:
    """M5: (key, row_id, isolation): two to the minus mean path length over its usual value.

    Each tree grows from a hash-chosen sample of at most sample rows of its key, on one task; rows meet the trees of
    their key as in applied.
    """
    spread = rows.select(key, F.col(row_id).alias("_id"), F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"))
    rank = F.row_number().over(Window.partitionBy(key, "tree").orderBy(F.xxhash64("_id", "tree", F.lit(seed)), "_id"))
    # ids alone are ranked, and each task keeps the first ones of a tree, before the vectors of the few chosen are fetched
    chosen = spread.withColumn("_r", rank).filter(F.col("_r") <= sample)
    chosen = chosen.join(rows.select(key, F.col(row_id).alias("_id"), vector), [key, "_id"])
    kind = rows.schema[key].dataType.simpleString()

    def grow(g: tuple, p: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(p.sort_values("_r")[vector].to_numpy()).astype(float)
        rng, nodes = np.random.default_rng(seed + int(g[1])), []

        def split(part: np.ndarray, depth: int) -> int:
            i = len(nodes)
            nodes.append((-1, 0.0, -1, -1, len(part)))
            lo, hi = part.min(axis=0), part.max(axis=0)
            open_ = np.flatnonzero(hi > lo)
            if len(part) > 1 and depth < math.ceil(math.log2(max(sample, 2))) and len(open_):
                f = int(rng.choice(open_))
                cut = float(rng.uniform(lo[f], hi[f]))
                left = part[:, f] < cut
                if left.any() and not left.all():
                    a, b = split(part[left], depth + 1), split(part[~left], depth + 1)
                    nodes[i] = (f, cut, a, b, len(part))
            return i

        split(x, 0)
        f, cut, a, b, n = zip(*nodes)
        return pd.DataFrame({key: [g[0]], "tree": [g[1]], "size": [len(x)], "f": [list(f)], "cut": [list(cut)], "a": [list(a)], "b": [list(b)], "n": [list(n)]})

    forest = chosen.groupBy(key, "tree").applyInPandas(grow, f"`{key}` {kind}, tree int, size int, f array<int>, cut array<double>, a array<int>, b array<int>, n array<int>")
    packed = forest.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("tree", "size", "f", "cut", "a", "b", "n"))).alias("trees"))
    usual = lambda n: 0.0 if n <= 1 else 2 * (math.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n if n > 2 else 1.0

    def unpack(m: pd.Series) -> tuple[float, list[tuple]]:
        grown = [([np.asarray(t[c]) for c in ("f", "cut", "a", "b")], np.array([usual(n) for n in t["n"]])) for t in m["trees"]]
        return np.mean([usual(t["size"]) for t in m["trees"]]) or 1.0, grown

    def walk(m: tuple[float, list[tuple]], x: np.ndarray) -> np.ndarray:
        depth = np.zeros(len(x))
        for (f, cut, a, b), rest in m[1]:
            # all rows go down a level at once
            node, open_ = np.zeros(len(x), int), np.arange(len(x)) if f[0] >= 0 else np.zeros(0, int)
            while len(open_):
                at = node[open_]
                node[open_] = np.where(x[open_, f[at]] < cut[at], a[at], b[at])
                depth[open_] += 1
                open_ = open_[f[node[open_]] >= 0]
            depth += rest[node]
        return 2 ** (-(depth / len(m[1])) / m[0])

    bytes_ = F.aggregate("trees", F.lit(0), lambda n, t: n + 32 * F.size(t["f"]))
    return applied(rows, packed, bytes_, key, row_id, vector, "isolation", unpack, walk)


def corrupted(rows: DataFrame, key: list[str], order: str, vector: str, donors: float = 0.15, scaled: float = 0.08, seed: int = 3) -> DataFrame:
    """M6: (key, order, features, label): each row as it is (0) and corrupted (1): values from another row of its key, and scaled ones.

    The donor is the row whose rank is a hash-chosen shift away, so the self join has one partner for each row.
    """
    w = Window.partitionBy(*key)
    r = rows.withColumn("_k", F.row_number().over(w.orderBy(order)) - 1).withColumn("_n", F.count("*").over(w))
    shift = 1 + F.pmod(F.xxhash64(order, F.lit(seed)), F.greatest(F.col("_n") - 1, F.lit(1)))
    r = r.withColumn("_d", (F.col("_k") + shift) % F.col("_n"))
    donor = r.select(*key, F.col("_k").alias("_d"), F.col(vector).alias("_other"))
    u = lambda i, salt: F.pmod(F.xxhash64(F.col(order), i, F.lit(seed + salt)), F.lit(1_000_000)) / 1e6
    mixed = F.zip_with(F.transform(vector, lambda v, i: F.struct(v.cast("double").alias("v"), i.alias("i"))), "_other", lambda x, y: F.when(u(x["i"], 1) < donors, y.cast("double")).otherwise(x["v"]) * F.when(u(x["i"], 2) < scaled, F.pow(F.lit(2.0), 4 * u(x["i"], 3) - 2)).otherwise(1.0))
    bad = r.join(donor, [*key, "_d"]).select(*key, order, mixed.alias("features"), F.lit(1).alias("label"))
    return r.select(*key, order, F.transform(vector, lambda v: v.cast("double")).alias("features"), F.lit(0).alias("label")).unionByName(bad)


def corruption_classifier(examples: DataFrame, trees: int = 32, depth: int = 8, seed: int = 5):
    """M6: a random forest of Spark ML over corrupted() rows; its probability of class 1 is the score."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.functions import array_to_vector

    ready = examples.withColumn("x", array_to_vector("features"))
    return RandomForestClassifier(featuresCol="x", labelCol="label", numTrees=trees, maxDepth=depth, seed=seed).fit(ready)


def corruption_scores(examples: DataFrame, row_id: str, folds: int = 2, **options: int) -> DataFrame:
    """M6: adds score to all corrupted() rows. Rows are dealt to folds by a hash of their id, and each fold is scored by a
    classifier that was fitted on the others, so both forms of a row are always new to it."""
    from pyspark.ml.functions import array_to_vector, vector_to_array

    fold, out = F.pmod(F.xxhash64(row_id), F.lit(folds)), []
    for k in range(folds):
        model = corruption_classifier(examples.filter(fold != k), **options)
        scored = model.transform(examples.filter(fold == k).withColumn("x", array_to_vector("features")))
        out.append(scored.select(*examples.columns, vector_to_array("probability")[1].alias("score")))
    return reduce(DataFrame.unionByName, out)


def ordered_split(rows: DataFrame, key: list[str], order: str, tie: str, lead: int, share: float = 0.7, least: int = 10) -> DataFrame:
    """M7: adds part: fit for the first share of each sequence, then calibration, which also reads lead rows before (both); short ones go.

    The share is taken as the decimal that it is written as, so that 0.7 of 90 rows is 63. Rows of one time are in order of tie.
    """
    w = Window.partitionBy(*key)
    r = rows.withColumn("_k", F.row_number().over(w.orderBy(order, tie))).withColumn("_n", F.count("*").over(w)).filter(F.col("_n") >= least)
    cut = F.floor(F.col("_n") * F.lit(Decimal(str(share))))
    return r.withColumn("part", F.when(F.col("_k") <= cut - lead, "fit").when(F.col("_k") <= cut, "both").otherwise("calibration")).drop("_k", "_n")


def conformal(scores: DataFrame, calibration: DataFrame, key: list[str], score: str, alpha: float) -> DataFrame:
    """M8: adds p, (calibration scores at or over the score + 1) / (n + 1), and anomalous; too few calibration scores give null.

    Calibration scores are counted in buckets of a key's range. Within a bucket both sides are put in one descending
    order and counted on the way, so no pair of rows is compared and no task gets a whole key. A key without
    calibration scores gives no rows.
    """
    ends = calibration.groupBy(*key).agg(F.min(score).alias("_low"), F.max(score).alias("_high"), F.count(score).alias("_n"))
    sides = scores.select(*key, F.col(score).alias("_s"), F.lit(0).alias("_c"), F.struct(*scores.columns).alias("_row")).unionByName(calibration.select(*key, F.col(score).alias("_s"), F.lit(1).alias("_c"), F.lit(None).alias("_row")))
    both = sides.join(ends, key).withColumn("_b", value_bucket(F.col("_s"), F.col("_low"), F.col("_high")))
    counts = calibration.join(ends, key).groupBy(*key, value_bucket(F.col(score), F.col("_low"), F.col("_high")).alias("_b")).agg(F.count("*").alias("_k"))
    every = ends.select(*key, F.explode(F.sequence(F.lit(0), F.lit(QUANTILE_BUCKETS - 1))).alias("_b")).join(counts, [*key, "_b"], "left")
    above = every.select(*key, "_b", (F.sum(F.coalesce("_k", F.lit(0))).over(Window.partitionBy(*key).orderBy(F.desc("_b"))) - F.coalesce("_k", F.lit(0))).alias("_above"))
    within = F.sum("_c").over(Window.partitionBy(*key, "_b").orderBy(F.desc("_s")).rangeBetween(Window.unboundedPreceding, 0))
    p = F.when(F.col("_n") >= math.ceil(1 / alpha) - 1, (F.col("_above") + F.col("_ge") + 1) / (F.col("_n") + 1))
    found = both.withColumn("_ge", within).filter("_c = 0").join(above, [*key, "_b"])
    return found.withColumn("p", p).select("_row.*", "p", (F.col("p") <= alpha).alias("anomalous"))


def top_three(rows: DataFrame, baseline: DataFrame, key: list[str], row: list[str], feature: str, value: str) -> DataFrame:
    """M9: (row, z_score, contributions): mean of the three largest one-sided robust z of a row's features, and these
    with their features, an array of (z, feature), largest first, ties by feature."""
    z = rows.join(baseline, [*key, feature]).withColumn("_z", F.greatest(F.lit(0.0), (F.col(value) - F.col("med")) / F.col("mad")))
    three = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("_z")).alias("m"), F.col(feature).alias("f")))), 1, 3)
    top = z.groupBy(*row).agg(F.transform(three, lambda x: F.struct((-x["m"]).alias("z"), x["f"].alias("feature"))).alias("contributions"))
    return top.select(*row, (F.aggregate("contributions", F.lit(0.0), lambda a, x: a + x["z"]) / F.size("contributions")).alias("z_score"), "contributions")


def neighbour_error(edges: DataFrame, features: DataFrame, names: list[str]) -> DataFrame:
    """(node, error): mean squared difference of a node's features from the weighted mean of its neighbours'."""
    both = edges.select("src", "dst", "n").union(edges.select("dst", "src", "n"))
    around = both.join(features.select(F.col("node").alias("dst"), *names), "dst").groupBy("src").agg(*[(F.sum(F.col(c) * F.col("n")) / F.sum("n")).alias(f"_{c}") for c in names])
    mse = sum((F.pow(F.col(c) - F.col(f"_{c}"), 2) for c in names), F.lit(0.0)) / len(names)
    return features.join(around.withColumnRenamed("src", "node"), "node").select("node", mse.alias("error"))


def attention_weights(edges: DataFrame, features: DataFrame, names: list[str], sharpness: float = 2.0) -> DataFrame:
    """(node, neighbour, weight, names of the neighbour): how much a node attends to each of its neighbours, not yet divided
    by the node's sum.

    Edges (src, dst, n) count both ways, and equal ones together. A weight is n times e to sharpness times the cosine
    between the two nodes' features (0 with a node without any), so it needs no largest value of a node first: softmax
    is one sum that tasks make in part, also where a node has very many edges. Ends without features take no part.
    """
    both = edges.select("src", "dst", "n").union(edges.select("dst", "src", "n")).groupBy(F.col("src").alias("node"), F.col("dst").alias("neighbour")).agg(F.sum("n").alias("_n"))
    length = F.sqrt(sum((F.pow(F.col(c), 2) for c in names), F.lit(0.0)))
    own = features.select("node", *[F.col(c).alias(f"_{c}") for c in names], length.alias("_own"))
    other = features.select(F.col("node").alias("neighbour"), *names, length.alias("_other"))
    dot = sum((F.col(c) * F.col(f"_{c}") for c in names), F.lit(0.0))
    cosine = F.when((F.col("_own") > 0) & (F.col("_other") > 0), dot / (F.col("_own") * F.col("_other"))).otherwise(0.0)
    return both.join(other, "neighbour").join(own, "node").select("node", "neighbour", (F.col("_n") * F.exp(sharpness * cosine)).alias("weight"), *names)


def attended(edges: DataFrame, features: DataFrame, names: list[str], sharpness: float = 2.0) -> DataFrame:
    """(node, names): one layer, the mean of a node's neighbours by attention. Nodes without neighbours go."""
    return attention_weights(edges, features, names, sharpness).groupBy("node").agg(*[(F.sum(F.col("weight") * F.col(c)) / F.sum("weight")).alias(c) for c in names])


def attention_error(edges: DataFrame, features: DataFrame, names: list[str], layers: int = 2, sharpness: float = 2.0) -> DataFrame:
    """(node, error, worst): mean squared rest of a node's features after they are told from its surroundings, and the
    feature with most of it (ties: the first by name).

    Surroundings are layers of attention over neighbours; a linear map for each feature, fitted over all nodes from sums,
    leads back to the feature. features have one row for each node, with numbers that are not null. Each layer is two
    joins of edges with nodes and one aggregate; edges and features should be tables, as they are read in each.
    """
    deep = features.select("node", *names)
    for _ in range(layers):
        deep = attended(edges, deep, names, sharpness)
    pairs = written(features.select("node", *names).join(deep.select("node", *[F.col(c).alias(f"_{c}") for c in names]), "node"), "attended")
    fit = [x for c in names for x in (F.coalesce(F.regr_slope(c, f"_{c}"), F.lit(0.0)).alias(f"_b_{c}"), F.coalesce(F.regr_intercept(c, f"_{c}"), F.avg(c)).alias(f"_a_{c}"))]
    told = pairs.crossJoin(F.broadcast(pairs.agg(*fit)))  # one row
    rests = [F.struct((-F.pow(F.col(c) - F.col(f"_a_{c}") - F.col(f"_b_{c}") * F.col(f"_{c}"), 2)).alias("rest"), F.lit(c).alias("name")) for c in names]
    ranked = told.select("node", F.array_sort(F.array(*rests)).alias("_r"))
    return ranked.select("node", (F.aggregate("_r", F.lit(0.0), lambda n, r: n - r["rest"]) / len(names)).alias("error"), F.get("_r", F.lit(0))["name"].alias("worst"))


def error_threshold(errors: DataFrame, error: str = "error", q: float = 0.99, margin: float = 0.02) -> DataFrame:
    """Errors with limit, the 0.99 quantile of all + 0.02, and anomalous, whether the error is over it."""
    limit = counted_quantiles(errors, [], error, {"_q": q}).select((F.col("_q") + margin).alias("limit"))
    return errors.crossJoin(F.broadcast(limit)).withColumn("anomalous", F.col(error) > F.col("limit"))  # one row


def holdout_gate(rows: DataFrame, key: list[str], order: list[str], alert: Column, limit: float) -> DataFrame:
    """(key, rate, passed): the share of alerts among the last fifth."""
    w = Window.partitionBy(*key)
    r = rows.withColumn("_k", F.row_number().over(w.orderBy(*order))).withColumn("_n", F.count("*").over(w)).filter(F.col("_k") > F.floor(F.col("_n") * 0.8))
    return r.groupBy(*key).agg(F.avg(alert.cast("double")).alias("rate")).withColumn("passed", F.col("rate") <= limit)


def acceptance(rows: DataFrame, key: list[str], order: list[str], score: str, threshold: float) -> DataFrame:
    """(key, med, p95, over, saturated, pairs, accepted)."""
    w = Window.partitionBy(*key).orderBy(*order)
    hot = F.col(score) >= threshold
    r = rows.withColumn("_pair", hot & F.coalesce(F.lag(hot).over(w), F.lit(False)))
    g = r.groupBy(*key).agg(quantile(score, 0.5).alias("med"), quantile(score, 0.95).alias("p95"), F.avg(hot.cast("double")).alias("over"), F.avg((F.col(score) >= 0.999).cast("double")).alias("saturated"), F.count_if("_pair").alias("pairs"))
    return g.withColumn("accepted", (F.col("med") <= 0.5) & (F.col("p95") <= threshold) & (F.col("over") <= 0.10) & (F.col("saturated") <= 0.25) & (F.col("pairs") == 0))


def calibration_rows(rows: DataFrame, key: list[str], order: list[str], clean: Column, cap: int = 120) -> DataFrame:
    """The last cap clean rows of each key."""
    w = Window.partitionBy(*key).orderBy(*[F.desc(o) for o in order])
    return rows.filter(clean).withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= cap).drop("_r")
