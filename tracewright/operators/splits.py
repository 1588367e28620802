"""Order-based checks, splits, holdouts and caps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def consecutive_pairs(rows: DataFrame, key: list[str], order: list[str], flag: Column) -> DataFrame:
    """(key, pairs): how often a flagged row follows a flagged row."""
    w = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("_f", flag).withColumn("_n", F.lead("_f").over(w)).groupBy(*key).agg(F.count_if(F.col("_f") & F.coalesce("_n", F.lit(False))).alias("pairs"))


def overlapping(rows: DataFrame, key: list[str], start: str, end: str) -> DataFrame:
    """R2, Q5: rows that start before an earlier row of their key has ended."""
    w = Window.partitionBy(*key).orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("_e", F.max(end).over(w)).filter(F.col("_e") > F.col(start)).drop("_e")


def largest_gap(rows: DataFrame, key: list[str], time: str, start: Column, end: Column) -> DataFrame:
    """(key, max_gap): between rows, and from the phase's edges to the first and last."""
    w = Window.partitionBy(*key).orderBy(time)
    g = rows.withColumn("_g", F.col(time) - F.lag(time).over(w))
    return g.groupBy(*key).agg(F.greatest(F.max("_g"), F.min(time) - F.min(start), F.max(end) - F.max(time)).alias("max_gap"))


def stable_counters(rows: DataFrame, key: list[str], counters: list[str]) -> DataFrame:
    """(key, changed): which counters are not the same in all rows of a key, or below 0, in order; empty if all are sound."""
    bad = [F.when((F.min(c) != F.max(c)) | (F.min(c) < 0), F.lit(c)) for c in sorted(counters)]
    return rows.groupBy(*key).agg(F.array_join(F.array_compact(F.array(*bad)), ",").alias("changed"))


def slowest(rows: DataFrame, value: str, tie: str, k: int = 20) -> DataFrame:
    """The k largest; each task keeps k, so no full sort happens."""
    return rows.orderBy(F.desc(value), tie).limit(k)


def evenly_spaced(rows: DataFrame, key: list[str], order: list[str], k: int) -> DataFrame:
    """The rows of each key at k evenly spaced ranks, both ends included."""
    w = Window.partitionBy(*key)
    ranked = rows.withColumn("_r", F.row_number().over(w.orderBy(*order)) - 1).withColumn("_n", F.count("*").over(w))
    sizes = ranked.select(*key, "_n").distinct()
    spots = sizes.select(*key, F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("_i"), "_n").select(*key, F.floor(F.col("_i") * (F.col("_n") - 1) / max(k - 1, 1)).cast("int").alias("_r")).distinct()
    return ranked.join(spots, [*key, "_r"], "left_semi").drop("_r", "_n")


def largest_remainder(sizes: DataFrame, group: list[str], stratum: str, n: str, share: float) -> DataFrame:
    """Adds held: strata's parts of round(share * total), at least 1 and at most n - 1, by largest remainder."""
    w = Window.partitionBy(*group)
    want = F.col(n) * share
    total = F.floor(F.sum(n).over(w) * share + 0.5)
    base = sizes.withColumn("_b", F.floor(want)).withColumn("_rest", want - F.floor(want)).withColumn("_more", total - F.sum(F.floor(want)).over(w))
    rank = F.row_number().over(w.orderBy(F.desc(F.round("_rest", 9)), stratum))
    held = F.col("_b") + F.when(rank <= F.col("_more"), 1).otherwise(0)
    return base.withColumn("held", F.greatest(F.lit(1).cast("long"), F.least(held, F.col(n) - 1))).drop("_b", "_rest", "_more")


def hold_out(rows: DataFrame, sizes: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Adds role: the last held rows of each stratum are the holdout."""
    w = Window.partitionBy(*key).orderBy(*[F.desc(o) for o in order])
    return rows.withColumn("_r", F.row_number().over(w)).join(sizes.select(*key, "held"), key).withColumn("role", F.when(F.col("_r") <= F.col("held"), "holdout").otherwise("fit")).drop("_r", "held")


def repaired(rows: DataFrame, key: list[str], order: list[str], special: Column) -> DataFrame:
    """Changes role so that special rows are on both sides where a key has two or more: one row changes place with one.

    If a side has no special row, the first special row of the other side goes there, and that side's first row comes.
    """
    w = Window.partitionBy(*key)
    r = rows.withColumn("_s", special)
    here = lambda role: F.count_if(F.col("_s") & (F.col("role") == role)).over(w)
    r = r.withColumn("_h", here("holdout")).withColumn("_f", here("fit"))
    lacking = F.when((F.col("_h") == 0) & (F.col("_f") >= 2), "holdout").when((F.col("_f") == 0) & (F.col("_h") >= 2), "fit")
    r = r.withColumn("_lack", lacking)
    rank = F.row_number().over(Window.partitionBy(*key, "role").orderBy(F.when(F.col("_lack").isNotNull() & (F.col("role") != F.col("_lack")) & ~F.col("_s"), 1).otherwise(0), *order))
    swap = F.col("_lack").isNotNull() & (F.col("_r") == 1)
    return r.withColumn("_r", rank).withColumn("role", F.when(swap, F.when(F.col("role") == "fit", "holdout").otherwise("fit")).otherwise(F.col("role"))).drop("_s", "_h", "_f", "_lack", "_r")


def appended(old: DataFrame, new: DataFrame, order: str) -> DataFrame:
    """Old rows keep their place and role, new ones come after them in order."""
    return old.withColumn("part", F.lit(0)).unionByName(new.withColumn("part", F.lit(1))).withColumn("place", F.struct("part", order))


def roles_of_runs(runs: DataFrame, roles: DataFrame, run: str) -> DataFrame:
    """(run, role, problem): each run has exactly one role."""
    r = roles.groupBy(run).agg(F.countDistinct("role").alias("_n"), F.min("role").alias("role"))
    joined = runs.select(run).distinct().join(r, run, "left")
    return joined.select(run, F.when(F.col("_n") == 1, F.col("role")).alias("role"), F.when(F.col("_n").isNull(), "no role").when(F.col("_n") > 1, "several roles").alias("problem"))


def first_rows(rows: DataFrame, key: list[str], order: list[str], n: int) -> DataFrame:
    """The first n rows of each key."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter(F.col("_r") <= n).drop("_r")


def latest(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last row of each key; one pass, partly summed before the shuffle."""
    rest = [c for c in rows.columns if c not in key and c not in order]
    return rows.groupBy(*key).agg(F.max(F.struct(*order, *rest)).alias("_x")).select(*key, "_x.*")
