"""Evaluation of detectors: coverage, exposure, counts, and statistics by resampling and exact tests."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.functions.syscalls import Z_TWO_SIDED, wilson
from tracewright.operators.signs import share_within


def coverage(rows: DataFrame, key: list[str], end: str) -> DataFrame:
    """(key, seconds_seen, span_seconds, coverage): distinct seconds with rows over the span."""
    g = rows.groupBy(*key).agg(F.countDistinct(F.floor(end)).alias("seconds_seen"), (F.floor(F.max(end)) - F.floor(F.min(end)) + 1).alias("span_seconds"))
    return g.withColumn("coverage", F.col("seconds_seen") / F.col("span_seconds"))


def breakdown(trials: DataFrame, dims: list[str], detected: str) -> DataFrame:
    """Detected, trials and Wilson interval overall and by each dimension, in one pass of grouping sets."""
    sets = [[], *[[d] for d in dims]]
    g = trials.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(d) for d in dims]).agg(F.count_if(detected).alias("found"), F.count("*").alias("trials"), *[F.grouping(d).alias(f"_{d}") for d in dims])
    label = F.coalesce(*[F.when(F.col(f"_{d}") == 0, F.lit(d)) for d in dims], F.lit("overall"))
    level = F.coalesce(*[F.when(F.col(f"_{d}") == 0, F.coalesce(F.col(d).cast("string"), F.lit("null"))) for d in dims], F.lit("all"))
    k, n = F.col("found"), F.col("trials")
    return g.select(label.alias("dimension"), level.alias("value"), "found", "trials", wilson(k, n, Z_TWO_SIDED).alias("low"), wilson(k, n, Z_TWO_SIDED, True).alias("high"))


def resource_rollup(rows: DataFrame, group: list[str], snapshot: str, value: str) -> DataFrame:
    """Sum over replicas in each snapshot, then the median of the snapshots."""
    return rows.groupBy(*group, snapshot).agg(F.sum(value).alias("v")).groupBy(*group).agg(F.percentile("v", 0.5).alias("median"))


def counter_rate(rows: DataFrame, key: list[str], time: str, counter: str) -> DataFrame:
    """A counter's rise over the elapsed time, from the first and last row of a key."""
    g = rows.groupBy(*key).agg(F.min(F.struct(time, counter)).alias("a"), F.max(F.struct(time, counter)).alias("b"))
    return g.select(*key, F.when(F.col(f"b.{time}") > F.col(f"a.{time}"), (F.col(f"b.{counter}") - F.col(f"a.{counter}")) / (F.col(f"b.{time}") - F.col(f"a.{time}"))).alias("rate"))


def exposure(rows: DataFrame, phase: list[str], start: str, end: str) -> DataFrame:
    """One row: the sum of the phases' spans."""
    return rows.groupBy(*phase).agg((F.max(end) - F.min(start)).alias("v")).agg(F.sum("v").alias("exposure"))


def confusion(trials: DataFrame, key: list[str], attack: Column, alert: Column) -> DataFrame:
    """Counts, precision, recall, F1 and false alert rate; a ratio of nothing is null."""
    c = trials.groupBy(*key).agg(F.count_if(attack & alert).alias("tp"), F.count_if(attack & ~alert).alias("fn"), F.count_if(~attack & alert).alias("fp"), F.count_if(~attack & ~alert).alias("tn"))
    tp, fn, fp, tn = (F.col(x) for x in ("tp", "fn", "fp", "tn"))
    return c.select(*c.columns, F.try_divide(tp, tp + fp).alias("precision"), F.try_divide(tp, tp + fn).alias("recall"), F.try_divide(2 * tp, 2 * tp + fp + fn).alias("f1"), F.try_divide(fp, fp + tn).alias("false_rate"))


def drawn(seed: int, iteration: Column, slot: Column, n: Column) -> Column:
    """A number below n from md5 of seed, iteration and slot: the same on any engine."""
    text = F.concat_ws("|", F.lit(str(seed)), iteration.cast("string"), slot.cast("string"))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long") % n


def drawn_sql(seed: int, n: str) -> str:
    return f"CAST('0x' || substr(md5('{seed}|' || iter || '|' || slot), 1, 8) AS BIGINT) % {n}"


#: Blocks of a group up to which they are carried as an array; the draws of larger groups are joined with them.
ARRAY_BLOCKS = 1 << 20
#: Tasks that the iterations of a group are dealt to.
PARTS = 32
#: Draws of an iteration that are hashed at once: so few that their columns stay in a core's cache.
DRAWN_AT_ONCE = 1 << 13
#: Of md5: the bits by which each step of a round turns, the constant of each step, and the first state.
_TURNS = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))
_SINES = np.floor(2.0**32 * np.abs(np.sin(np.arange(1, 65)))).astype(np.uint32)
_STATE = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)


def _md5_heads(start: bytes, ends: np.ndarray) -> np.ndarray:
    """The first four bytes, as a number, of the md5 of start and each of ends (bytes), together 55 bytes at most."""
    width, sizes = ends.dtype.itemsize, len(start) + np.char.str_len(ends)
    block = np.zeros((len(ends), 64), np.uint8)
    block[:, : len(start)] = np.frombuffer(start, np.uint8)
    block[:, len(start) : len(start) + width] = ends.view(np.uint8).reshape(len(ends), width)
    block[np.arange(len(ends)), sizes] = 0x80
    block[:, 56:58] = (8 * sizes).astype("<u2").view(np.uint8).reshape(-1, 2)
    words = [w if w.any() else None for w in np.ascontiguousarray(block.view("<u4").T)]
    a, b, c, d = (np.full(len(ends), x, np.uint32) for x in _STATE)
    for step in range(64):
        kind = step // 16
        f = d ^ (b & (c ^ d)) if kind == 0 else c ^ (d & (b ^ c)) if kind == 1 else b ^ c ^ d if kind == 2 else c ^ (b | ~d)
        word = words[(step, 5 * step + 1, 3 * step + 5, 7 * step)[kind] % 16]
        f += a
        f += _SINES[step]
        if word is not None:
            f += word
        turn = _TURNS[kind][step % 4]
        over = f >> np.uint32(32 - turn)
        f <<= np.uint32(turn)
        f |= over
        f += b
        a, b, c, d = d, f, b, c
    return (a + np.uint32(_STATE[0])).byteswap().astype(np.int64)


def _drawn_numbers(seed: int, iteration: int, slots: np.ndarray) -> np.ndarray:
    """drawn() for all slots of an iteration: as many numbers below their number as there are slots."""
    start = b"%d|%d|" % (seed, iteration)
    return np.concatenate([_md5_heads(start, slots[k : k + DRAWN_AT_ONCE]) for k in range(0, len(slots), DRAWN_AT_ONCE)]) % len(slots)


def _estimate(kind: str, values: np.ndarray, known: np.ndarray) -> float | None:
    """The sum or the median of the known values; a sum of none is 0, a median of none is null."""
    x = values if known.all() else values[known]
    if kind == "sum":
        return float(x.sum())
    middle = [(len(x) - 1) // 2, len(x) // 2]
    return float(np.partition(x, middle)[middle].sum() / 2) if len(x) else None


def _sampled(blocks: DataFrame, group: list[str], columns: list[str], iterations: int, seed: int) -> DataFrame:
    """(group, iter, the columns' values...) of each drawn block: draws are generated from the group sizes and joined by number."""
    numbered = blocks.withColumn("_k", F.row_number().over(Window.partitionBy(*group).orderBy("block")) - 1)
    sizes = blocks.groupBy(*group).agg(F.count("*").alias("_n"))
    draws = sizes.select(*group, "_n", F.explode(F.sequence(F.lit(0), F.lit(iterations - 1))).alias("iter")).select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)).alias("slot"))
    return draws.withColumn("_k", drawn(seed, F.col("iter"), F.col("slot"), F.col("_n"))).join(numbered.select(*group, "_k", *columns), [*group, "_k"]).select(*group, "iter", *columns)


def bootstrap(blocks: DataFrame, group: list[str], estimates: dict[str, tuple[str, str]], iterations: int, seed: int, most: int = ARRAY_BLOCKS) -> DataFrame:
    """(group, iter, the estimates): each iteration draws a group's number of blocks with replacement.

    estimates: name to ("sum" or "median", column). The blocks of a group, which are sums over what was observed, are one
    array of most blocks at most. Tasks of some iterations each draw from it by the same md5 numbers as SQL can, and hold one
    iteration's draws at a time; so only groups x iterations rows are made, and none is shuffled. Groups of more blocks have
    their draws joined with them.
    """
    columns = sorted({c for _, c in estimates.values()})
    sizes = blocks.groupBy(*group).agg(F.count("*").alias("_n"))
    small = blocks.join(sizes.filter(F.col("_n") <= most).select(*group), group, "left_semi")
    arrays = small.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct("block", *columns))).alias("_b"))
    # a few rows become very many: they are dealt out before
    per = -(-iterations // PARTS)
    arrays = arrays.select(*group, *[F.col("_b")[c].cast("array<double>").alias(f"_{i}") for i, c in enumerate(columns)])
    parts = arrays.withColumn("_p", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1)))).repartition(PARTS, *group, "_p")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first = batch.column("_p").to_pylist()
            for row in range(batch.num_rows):
                held = [batch.column(f"_{i}").slice(row, 1).flatten() for i in range(len(columns))]
                known = {c: h.is_valid().to_numpy(zero_copy_only=False) for c, h in zip(columns, held)}
                values = {c: h.fill_null(0.0).to_numpy() for c, h in zip(columns, held)}
                n, iters = len(held[0]), range(first[row] * per, min(first[row] * per + per, iterations))
                slots, out = np.arange(n).astype("S8"), []
                for i in iters:
                    k = _drawn_numbers(seed, i, slots)
                    out.append([_estimate(kind, values[c][k], known[c][k]) for kind, c in estimates.values()])
                same = pa.array(np.full(len(iters), row))
                yield pa.RecordBatch.from_arrays([*[batch.column(g).take(same) for g in group], pa.array(iters, pa.int32()), *[pa.array(v, pa.float64()) for v in (zip(*out) if out else [[]] * len(estimates))]], [*group, "iter", *estimates])

    kinds = ", ".join(f"`{g}` {blocks.schema[g].dataType.simpleString()}" for g in group)
    out = parts.mapInArrow(run, f"{kinds}, iter int, " + ", ".join(f"`{name}` double" for name in estimates))
    if sizes.filter(F.col("_n") > most).isEmpty():
        return out
    large = _sampled(blocks.join(sizes.filter(F.col("_n") > most).select(*group), group, "left_semi"), group, columns, iterations, seed)
    return out.unionByName(large.groupBy(*group, "iter").agg(*[(F.sum(F.col(c).cast("double")) if kind == "sum" else F.percentile(c, 0.5)).alias(name) for name, (kind, c) in estimates.items()]))


def interval(estimates: DataFrame, group: list[str], value: str) -> DataFrame:
    """The 0.025 and 0.975 quantiles of the iterations."""
    return estimates.groupBy(*group).agg(F.percentile(value, 0.025).alias("low"), F.percentile(value, 0.975).alias("high"))


def mcnemar(only_a: Column, only_b: Column) -> Column:
    """Two-sided exact p value of discordant counts."""
    n, k = only_a + only_b, F.least(only_a, only_b)
    ln_choose = lambda m, i: F.aggregate(F.sequence(F.lit(1).cast("long"), F.greatest(i, F.lit(1)).cast("long")), F.lit(0.0), lambda s, j: s + F.when(i >= 1, F.ln((m - i + j) / j)).otherwise(F.lit(0.0)))
    tail = F.aggregate(F.sequence(F.lit(0).cast("long"), k.cast("long")), F.lit(0.0), lambda s, i: s + F.exp(ln_choose(n, i) - n * F.ln(F.lit(2.0))))
    return F.when(n == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), 2 * tail))


#: Up to so many rows the sums of sign patterns are enumerated by halves.
HALVES_ROWS = 44
#: Steps of the law of sums, added value by value: up to so many it is summed up directly, which is exact in its tail too.
DIRECT_STEPS = 1 << 30
#: Decimals are whole numbers of units up to this size; other values are rounded to a reach of so many units.
LARGEST, ROUNDED = 1 << 24, 1 << 25


def _half_sums(a: np.ndarray) -> np.ndarray:
    s = np.zeros(1)
    for x in a:
        s = np.concatenate([s + x, s - x])
    return np.sort(s)


def _unit(a: np.ndarray, reach: float) -> tuple[float, bool]:
    """A unit for the sums, and whether all values are multiples of it: they are decimals that are not too large for it."""
    for scale in 10.0 ** np.arange(7):
        whole = np.round(a * scale)
        if np.allclose(whole, a * scale, rtol=1e-9, atol=0):
            unit = np.gcd.reduce(whole.astype(np.int64)) / scale
            if a.max() / unit < LARGEST:
                return unit, True
            break
    return reach / ROUNDED, False


def _direct_share(steps: np.ndarray, counts: np.ndarray, first: int, most: int) -> float:
    """P(S >= first) for S the sum of steps with random signs; sums beyond most are cut off."""
    share = np.zeros(2 * most + 1)
    share[most], low, high = 1.0, most, most
    for k in np.repeat(steps, counts).tolist():
        k = min(k, 2 * most)
        old = share[low : high + 1] / 2
        n = len(old)
        share[low : high + 1] = 0
        down, up = min(max(k - low, 0), n), max(n - max(low + k + n - 2 * most - 1, 0), 0)
        share[low - k + down : low - k + n] += old[down:]
        share[low + k : low + k + up] += old[:up]
        low, high = max(low - k, 0), min(high + k, 2 * most)
    return float(share[most + first :].sum())


def sign_flip_p(values: np.ndarray, counts: np.ndarray | None = None) -> float:
    """The share of all 2**n sign patterns whose sum is at least as far from 0 as the sum of values, each counts times.

    Up to HALVES_ROWS values it is exact: sums of one half are looked up among the sums of the other. Beyond, the values
    are whole numbers of a unit. Where the law of their sums has few steps it is added up value by value within 9
    standard deviations, beyond which less than 1e-17 lies; else it comes from signs.share_within, within about 1e-12.
    Values that are no decimals of six places at most, or over LARGEST units, are rounded to 2**-25 of these 9
    standard deviations; the error of p was below 2e-8 in trials with 30 to 42 values.
    """
    counts = np.ones(len(values), np.int64) if counts is None else counts
    bound = abs((values * counts).sum()) - 1e-9 * counts.sum()
    a, counts = np.abs(values[values != 0]), counts[values != 0]
    n = int(counts.sum())
    if not n or bound <= 0:
        return 1.0
    if n <= HALVES_ROWS:
        a = np.repeat(a, counts)
        left, right = _half_sums(a[::2]), _half_sums(a[1::2])
        far = len(right) - np.searchsorted(right, bound - left, side="left") + np.searchsorted(right, -bound - left, side="right")
        return float(far.sum() / 2.0 ** len(a))
    reach = 9 * float(np.sqrt((a * a * counts).sum()))
    unit, exact = _unit(a, reach)
    steps, place = np.unique(np.round(a / unit).astype(np.int64), return_inverse=True)
    total, least = float((a * counts).sum()), 2.0 ** (1 - n)
    if exact:
        counts = np.bincount(place, counts).astype(np.int64)
        total, reach = int((steps * counts).sum()), min(int(reach / unit) + 1, int((steps * counts).sum()))
        first = int(np.ceil(bound / unit - 1e-6))
        first += (total - first) % 2
        if n * 2 * reach <= DIRECT_STEPS:
            return float(min(1.0, 2 * _direct_share(steps, counts, first, reach)))
    else:
        # of sums with one rounded sum the mean is moved by what was rounded, in proportion
        rest = a / unit - steps[place]
        moved = float((steps[place] * rest * counts).sum() / (steps[place] * 1.0 * steps[place] * counts).sum())
        counts = np.bincount(place, counts).astype(np.int64)
        steps, counts = steps[steps > 0], counts[steps > 0]
        first, reach = bound / unit / (1 + moved) + 1, reach / unit
    if first > reach:
        return least
    return float(min(1.0, max(least, 1 - share_within(steps, counts, first, reach))))


def sign_flip(differences: DataFrame, group: list[str], value: str) -> DataFrame:
    """(group, n, p): the share of all 2**n sign patterns whose mean is at least as far from 0, for groups of any size.

    A group's different values and their counts are in one task, and groups are dealt to 4 tasks for each core, whatever
    their bytes, since the work is not in reading them; sign_flip_p tells the cost and where values are rounded. Null
    values are left out.
    """
    names = ", ".join(f"`{c}` {differences.schema[c].dataType.simpleString()}" for c in group)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        v, c = rows["_v"].to_numpy(float), rows["_c"].to_numpy(np.int64)
        known = ~np.isnan(v)
        return rows[group].iloc[:1].assign(n=c.sum(), p=sign_flip_p(v[known], c[known]))

    counted = differences.select(*group, F.col(value).cast("double").alias("_v")).groupBy(*group, "_v").agg(F.count("*").alias("_c"))
    tasks = 4 * differences.sparkSession.sparkContext.defaultParallelism
    return counted.repartition(tasks, *group).groupBy(*group).applyInPandas(run, f"{names}, n long, p double")


def holm(tests: DataFrame, family: list[str], p: str, tie: str) -> DataFrame:
    """Adds adjusted: step-down Holm over each family."""
    w = Window.partitionBy(*family)
    step = F.least(F.lit(1.0), F.col(p) * (F.count("*").over(w) - F.row_number().over(w.orderBy(p, tie)) + 1))
    return tests.withColumn("_s", step).withColumn("adjusted", F.max("_s").over(w.orderBy(p, tie).rowsBetween(Window.unboundedPreceding, 0))).drop("_s")


def paired_table(pairs: DataFrame, group: list[str], a: str, b: str, latencies: tuple[str, str] | None = None) -> DataFrame:
    """A only, b only, both and neither; with the latencies of a and b also lead, the median of a's less b's where both found it."""
    x, y = F.col(a), F.col(b)
    more = [F.percentile(F.when(x & y, F.col(latencies[0]) - F.col(latencies[1])), 0.5).alias("lead")] if latencies else []
    return pairs.groupBy(*group).agg(*more, F.count_if(x & ~y).alias("a_only"), F.count_if(~x & y).alias("b_only"), F.count_if(x & y).alias("both"), F.count_if(~x & ~y).alias("neither"))


def overhead(blocks: DataFrame, group: list[str], block: str, rate: tuple[str, str], latency: tuple[str, str], iterations: int, seed: int) -> DataFrame:
    """(group, blocks, loss, loss_low, loss_high, rise, rise_low, rise_high): medians over blocks of the per cent of
    throughput lost and of latency gained from off to on, with bootstrap intervals of 0.95. rate and latency name (off, on)."""
    b = blocks.select(*group, F.col(block).alias("block"), (100 * (1 - F.col(rate[1]) / F.col(rate[0]))).alias("loss"), (100 * (F.col(latency[1]) / F.col(latency[0]) - 1)).alias("rise"))
    med = lambda c: F.percentile(c, 0.5)
    drawn_ = bootstrap(b, group, {"loss": ("median", "loss"), "rise": ("median", "rise")}, iterations, seed)
    ends = drawn_.groupBy(*group).agg(*[F.percentile(c, q).alias(f"{c}_{n}") for c in ("loss", "rise") for n, q in (("low", 0.025), ("high", 0.975))])
    return b.groupBy(*group).agg(F.count("*").alias("blocks"), med("loss").alias("loss"), med("rise").alias("rise")).join(ends, group)


def pooled(campaigns: dict[str, DataFrame], group: list[str], effect: str, independent: list[str]) -> DataFrame:
    """(group, blocks, campaigns, independent, effect, p): blocks of all campaigns as one sample. Independent if there are
    two or more values of each column in independent; effect is the mean of the blocks, p by sign flips over them."""
    both = reduce(DataFrame.unionByName, [d.withColumn("_campaign", F.lit(n)) for n, d in campaigns.items()])
    apart = reduce(lambda a, b: a & b, [F.countDistinct(c) >= 2 for c in independent])
    g = both.groupBy(*group).agg(F.count("*").alias("blocks"), F.countDistinct("_campaign").alias("campaigns"), apart.alias("independent"), F.avg(effect).alias("effect"))
    return g.join(sign_flip(both, group, effect).select(*group, "p"), group)


def restricted_time(trials: DataFrame, group: list[str], detected: str, latency: str, censor: str, cuts: list[float]) -> DataFrame:
    """Mean time to detection, a miss counting as the censoring time, and the share found by each cut."""
    within = [F.avg((F.col(detected) & (F.col(latency) <= c)).cast("double")).alias(f"by_{i}") for i, c in enumerate(cuts)]
    return trials.groupBy(*group).agg(F.avg(F.when(F.col(detected), F.col(latency)).otherwise(F.col(censor))).alias("restricted"), *within)
