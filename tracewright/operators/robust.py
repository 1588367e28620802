"""Robust limits and thresholds for each key. Medians and quantiles are exact; two passes give the MAD."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.functions.syscalls import BEHAVIOUR_SYSCALLS, LIMIT_FLOORS, mapping

MAD_SCALE = 1.4826


def quantile(value, *q: float) -> F.Column:
    """Exact, with linear interpolation."""
    return F.percentile(value, q[0]) if len(q) == 1 else F.percentile(value, list(q))


#: Buckets of a key's range in counted_quantiles().
QUANTILE_BUCKETS = 1024


def value_bucket(value: Column, low: Column, high: Column) -> Column:
    """The number of a value's bucket between low and high; it never falls as the value rises."""
    share = F.when(high > low, (value - low) / (high - low)).otherwise(0.0)
    return F.floor(F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0)) * (QUANTILE_BUCKETS - 1)).cast("int")


def counted_quantiles(rows: DataFrame, key: list[str], value: str, qs: dict[str, float]) -> DataFrame:
    """(key, n, the names of qs): the quantiles that percentile gives, for keys of any size; null values are left out.

    Buckets of a key's range are counted first, which tells the buckets that hold the wanted ranks. Only their values
    are then counted and ranked, so no task holds a key: percentile keeps all different values of one.
    """
    x = rows.filter(F.col(value).isNotNull()).select(*key, F.col(value).cast("double").alias("_v"))
    x = x if key else x.withColumn("_all", F.lit(0))
    keys = key or ["_all"]
    ends = x.groupBy(*keys).agg(F.min("_v").alias("_low"), F.max("_v").alias("_high"), F.count("*").alias("n"))
    x = x.join(ends, keys).withColumn("_b", value_bucket(F.col("_v"), F.col("_low"), F.col("_high")))
    buckets = x.groupBy(*keys, "n", "_b").agg(F.count("*").alias("_c"))
    buckets = buckets.withColumn("_before", F.sum("_c").over(Window.partitionBy(*keys).orderBy("_b")) - F.col("_c"))
    at = {name: (F.col("n") - 1) * F.lit(q) for name, q in qs.items()}
    ranks = F.array_distinct(F.array(*[r for p in at.values() for r in (F.floor(p), F.ceil(p))]))
    wanted = buckets.filter(F.exists(ranks, lambda r: (r >= F.col("_before")) & (r < F.col("_before") + F.col("_c")))).select(*keys, "_b", "_before")
    near = x.join(wanted, [*keys, "_b"]).groupBy(*keys, "n", "_b", "_before", "_v").agg(F.count("*").alias("_c"))
    last = F.col("_before") + F.sum("_c").over(Window.partitionBy(*keys, "_b").orderBy("_v"))
    near = near.withColumn("_last", last)
    of = lambda r: F.max(F.when((F.col("_last") - F.col("_c") <= r) & (r < F.col("_last")), F.col("_v")))
    found = near.groupBy(*keys, "n").agg(*[of(f(p)).alias(f"_{name}{i}") for name, p in at.items() for i, f in enumerate((F.floor, F.ceil))])
    return found.select(*key, "n", *[(F.col(f"_{k}0") + (F.col(f"_{k}1") - F.col(f"_{k}0")) * (p - F.floor(p))).alias(k) for k, p in at.items()])


def median_and_mad(rows: DataFrame, key: list[str], value: str, more: dict[str, float] | None = None, large: bool = False) -> DataFrame:
    """(key, n, med, ...more, mad): mad is the plain median of |value - med|, more are quantiles. large: for keys of very many rows."""
    qs = {"med": 0.5} | (more or {})
    if large:
        first = counted_quantiles(rows, key, value, qs)
        away = rows.select(*key, value).join(first.select(*key, "med"), key).select(*key, F.abs(F.col(value) - F.col("med")).alias("_d"))
        return first.join(counted_quantiles(away, key, "_d", {"mad": 0.5}).drop("n"), key)
    first = rows.groupBy(*key).agg(F.count(value).alias("n"), *[quantile(value, q).alias(k) for k, q in qs.items()])
    spread = rows.select(*key, value).join(first.select(*key, "med"), key).groupBy(*key).agg(quantile(F.abs(F.col(value) - F.col("med")), 0.5).alias("mad"))
    return first.join(spread, key)


def behaviour_limits(frequencies: DataFrame, key: str, name: str, value: str, q: float = 0.995, margin: float = 0.02, floor: float | None = None, cap: float = 0.95, deviations: float = 8.0) -> DataFrame:
    """(key, name, limit_value): quantile + max(margin, 8 or other scaled MADs), within [floor, cap]."""
    rows = frequencies.filter(F.col(name).isin(*BEHAVIOUR_SYSCALLS))
    least = F.lit(floor) if floor is not None else mapping(LIMIT_FLOORS)[F.col(name)]
    stats = median_and_mad(rows, [key, name], value, {"top": q})
    return stats.select(key, name, F.least(F.lit(cap), F.greatest(least, F.col("top") + F.greatest(F.lit(margin), deviations * MAD_SCALE * F.col("mad")))).alias("limit_value"))


def tail_scale(rows: DataFrame, key: list[str], value: str) -> DataFrame:
    """(key, tail_limit, tail_scale) of errors."""
    s = median_and_mad(rows, key, value, {"top": 0.99}, large=True)
    s = s.withColumn("tail_limit", F.greatest("top", F.col("med") + 6 * MAD_SCALE * F.col("mad")))
    return s.select(*key, "tail_limit", F.greatest(F.col("tail_limit") - F.col("med"), F.abs("tail_limit") * 0.10, F.lit(1e-6)).alias("tail_scale"))


def threshold(rows: DataFrame, key: list[str], score: str, minimum: float, margin: float = 0.5, q: float = 0.995, min_samples: int = 30) -> DataFrame:
    """(key, n, limit): quantile + margin * max(MAD, 0.001), in [minimum, 0.995]; the minimum for few scores."""
    s = median_and_mad(rows, key, score, {"top": q})
    value = F.least(F.lit(0.995), F.greatest(F.lit(minimum), F.col("top") + margin * F.greatest(F.col("mad"), F.lit(1e-3))))
    return s.select(*key, "n", F.when(F.col("n") < min_samples, F.lit(minimum)).otherwise(value).alias("limit"))


#: Values whose logarithms are summed at once, and keys whose sums a task keeps.
SUMMED_AT_ONCE, KEPT_KEYS = 4096, 1000


def pareto_grid(top: float, mean: float) -> np.ndarray:
    """Ratios shape / scale of generalised Pareto laws that are tried for exceedances of this maximum and mean."""
    return np.concatenate([-np.geomspace(1e-6, 0.999, 200) / top, np.geomspace(1e-4, 50, 400) / mean])


def best_pareto(theta: np.ndarray, mean_log: np.ndarray) -> tuple[float, float]:
    """Shape and scale of the largest likelihood on a grid, from the means of log(1 + theta * x)."""
    with np.errstate(all="ignore"):
        likelihood = -np.log(mean_log / theta) - mean_log - 1
    likelihood[~np.isfinite(likelihood) | (mean_log / theta <= 0)] = -np.inf
    k = int(np.argmax(likelihood))
    return float(mean_log[k]), float(mean_log[k] / theta[k])


def _log_sums(theta: np.ndarray, x: np.ndarray) -> np.ndarray:
    return sum((np.log1p(np.outer(theta, x[i : i + SUMMED_AT_ONCE])).sum(axis=1) for i in range(0, len(x), SUMMED_AT_ONCE)), np.zeros(len(theta)))


def fit_pareto(excess: np.ndarray) -> tuple[float, float]:
    """Shape and scale of a generalised Pareto law by its likelihood along one parameter (shape / scale)."""
    theta = pareto_grid(excess.max(), excess.mean())
    return best_pareto(theta, _log_sums(theta, excess) / len(excess))


def pareto_threshold(rows: DataFrame, key: str, score: str, minimum: float, margin: float = 0.5, q: float = 0.995, tail: float = 0.9, min_exceedances: int = 10) -> DataFrame:
    """(key, limit, method): a Pareto tail over the 0.9 quantile, extrapolated; null where it is no good fit.

    The likelihood is a sum for each point of a grid. Each task sums up the logarithms of the exceedances that it reads,
    for each key, and only these sums meet: neither shuffle nor memory grows with the number of exceedances.
    """
    s = median_and_mad(rows, [key], score, {"u": tail}, large=True)
    above = rows.select(key, score).join(s, key).filter(F.col(score) > F.col("u")).select(key, (F.col(score) - F.col("u")).cast("double").alias("excess"))
    ends = above.groupBy(key).agg(F.max("excess").alias("top"), F.avg("excess").alias("mean"), F.count("*").alias("m")).filter(F.col("m") >= min_exceedances)
    kind = rows.schema[key].dataType.simpleString()

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(held), keys), pa.array([x.tolist() for x in held.values()], pa.list_(pa.float64()))], [key, "sums"])
            held.clear()
            return out

        for batch in batches:
            keys = batch.column(0).type
            coded = batch.column(0).dictionary_encode()
            code, names = coded.indices.fill_null(-1).to_numpy(zero_copy_only=False), coded.dictionary.to_pylist()
            x, top, mean = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2, 3))
            for c in np.unique(code).tolist():
                at = np.flatnonzero(code == c)
                sums = _log_sums(pareto_grid(top[at[0]], mean[at[0]]), x[at])
                name = names[c]
                held[name] = held[name] + sums if name in held else sums
            if len(held) > KEPT_KEYS:
                yield flush()
        if held:
            yield flush()

    def fit(k: tuple, p: pd.DataFrame) -> pd.DataFrame:
        top, mean, m, n, u, mad = (p[c].iloc[0] for c in ("top", "mean", "m", "n", "u", "mad"))
        shape, scale = best_pareto(pareto_grid(top, mean), np.sum(p["sums"].to_list(), axis=0) / m)
        rest, limit, method = (1 - q) / (m / n), None, "empirical"
        tail_value = scale / shape * (rest**-shape - 1) if abs(shape) > 1e-9 else -scale * np.log(rest)
        if -1 < shape < 2 and scale > 0 and np.isfinite(tail_value):
            limit, method = float(np.clip(max(minimum, u + tail_value + margin * max(mad, 1e-3)), minimum, 0.995)), "pareto"
        return pd.DataFrame({key: [k[0]], "limit": [limit], "method": [method]})

    sums = above.join(ends.drop("m"), key).select(key, "excess", "top", "mean").mapInArrow(partial, f"`{key}` {kind}, sums array<double>")
    fitted = sums.join(ends, key).join(s, key).groupBy(key).applyInPandas(fit, f"`{key}` {kind}, limit double, method string")
    short = s.join(ends.select(key), key, "left_anti").join(above.select(key).distinct(), key, "left_semi").select(key, F.lit(None).cast("double").alias("limit"), F.lit("empirical").alias("method"))
    return fitted.unionByName(short)


def agent_threshold(rows: DataFrame, key: str, score: str, minimum: float) -> DataFrame:
    """The 0.995 quantile of the scores at or over the 0.9 quantile, + 0.25, at least minimum."""
    u = counted_quantiles(rows, [key], score, {"u": 0.9}).drop("n")
    top = counted_quantiles(rows.join(u, key).filter(F.col(score) >= F.col("u")), [key], score, {"top": 0.995})
    return top.select(key, F.greatest(F.lit(minimum), F.col("top") + 0.25).alias("limit"))


def event_bounds(rows: DataFrame, key: str, events: str, low: tuple[float, float] = (0.1, 0.5), high: tuple[float, float] = (0.99, 2.0)) -> DataFrame:
    """(key, low, high): half the 0.1 quantile and twice the 0.99 quantile of event counts, or other quantiles and factors, at least 1."""
    q = rows.groupBy(key).agg(quantile(events, low[0], high[0]).alias("q"))
    one = F.lit(1).cast("long")
    return q.select(key, F.greatest(one, F.floor(F.col("q")[0] * low[1])).alias("low"), F.greatest(one, F.ceil(F.col("q")[1] * high[1])).alias("high"))


def robust_baseline(rows: DataFrame, key: list[str], value: str, floor: float = 0.05, least: int = 3) -> DataFrame:
    """Median and MAD of each feature, the MAD at least floor; keys with fewer rows have none."""
    return median_and_mad(rows, key, value).filter(F.col("n") >= least).select(*key, "med", F.greatest("mad", F.lit(floor)).alias("mad"))


def envelope(rows: DataFrame, key: str, groups: dict[str, list[str]]) -> DataFrame:
    """(key, grp, normal_max): the largest sum of each group of counts."""
    sums = [F.struct(F.lit(g).alias("grp"), sum((F.col(c) for c in cols), F.lit(0)).cast("long").alias("v")) for g, cols in groups.items()]
    return rows.select(key, F.explode(F.array(*sums)).alias("x")).groupBy(key, "x.grp").agg(F.max("x.v").alias("normal_max"))


def extend_envelope(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """(key, grp, normal_max, changed): the larger of both, and whether that is new."""
    both = old.withColumnRenamed("normal_max", "o").join(new.withColumnRenamed("normal_max", "n"), [key, "grp"], "full_outer")
    top = F.greatest("o", "n")
    return both.select(key, "grp", top.alias("normal_max"), (~top.eqNullSafe(F.col("o"))).alias("changed"))


def summary(rows: DataFrame, key: list[str], value: str, saturated: float, approximate: bool = False, large: bool = False) -> DataFrame:
    """Count, least, quantiles, largest and the share at or over saturated. Approximate only on request; large: for keys of very many rows."""
    qs = {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99, "p999": 0.999}
    plain = [F.count(value).alias("n"), F.min(value).alias("least"), F.max(value).alias("largest"), F.avg((F.col(value) >= saturated).cast("double")).alias("saturated")]
    if large:
        s = rows.groupBy(*key).agg(*plain).join(counted_quantiles(rows, key, value, qs).drop("n"), key)
        return s.select(*key, "n", "least", *qs, "largest", "saturated")
    q = F.percentile_approx(value, list(qs.values()), 10000) if approximate else quantile(value, *qs.values())
    s = rows.groupBy(*key).agg(*plain, q.alias("_q"))
    return s.select(*key, "n", "least", *[F.col("_q")[i].alias(k) for i, k in enumerate(qs)], "largest", "saturated")


#: Size of a quantile sketch; the ranks of what it gives are off by less than SKETCH_ERROR of the rows, at 99 % confidence.
SKETCH_K, SKETCH_ERROR = 2048, 0.002


def quantile_sketches(rows: DataFrame, key: list[str], value: str, k: int = SKETCH_K) -> DataFrame:
    """(key, n, least, largest, sketch) of the values that are not null, mergeable over days or nodes.

    The sketch is a binary column of bounded size, so it can be kept in a table in place of its rows. A key without
    values gives no row. Exact quantiles (summary) stay the default.
    """
    held = rows.filter(F.col(value).isNotNull()).withColumn("_v", F.col(value).cast("double"))
    return held.groupBy(*key).agg(F.count("*").alias("n"), F.min("_v").alias("least"), F.max("_v").alias("largest"), F.kll_sketch_agg_double("_v", k).alias("sketch"))


def merged_sketches(sketches: DataFrame, key: list[str], k: int = SKETCH_K) -> DataFrame:
    """Sketches of the same columns put together by a coarser key; the bound on the error stays that of k."""
    return sketches.groupBy(*key).agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.max("largest").alias("largest"), F.kll_merge_agg_double("sketch", k).alias("sketch"))


def sketched_summary(sketches: DataFrame, key: list[str], qs: dict[str, float]) -> DataFrame:
    """(key, n, least, qs..., largest) from sketches; values are some of the rows' own."""
    return sketches.select(*key, "n", "least", *[F.kll_sketch_get_quantile_double("sketch", F.lit(q)).alias(c) for c, q in qs.items()], "largest")
