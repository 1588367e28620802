"""Data contracts: each check gives the rows or gates that break it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def violations(rows: DataFrame, key: list[str], rules: dict[str, Column]) -> DataFrame:
    """Q1, Q2: (key, problem): a row for each rule that a row breaks; a rule that gives null is broken."""
    found = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]))
    return rows.select(*key, F.explode(found).alias("problem"))


#: Q1: the columns of a window record, and no others.
WINDOW_KEYS = ("counts", "event_count", "pod_key", "sequence", "sparse", "window_end", "window_start")


def window_rules(size: int) -> dict[str, Column]:
    """Q1: what a window row (record_keys, window_start, window_end, event_count, counts map, sequence, sparse array of (i, v)) must keep."""
    i = F.transform("sparse", lambda x: x["i"])
    total = F.aggregate(F.map_values("counts"), F.lit(0).cast("long"), lambda a, v: a + v)
    finite = F.forall("sparse", lambda x: x["v"].isNotNull() & ~F.isnan(x["v"]) & (F.abs(x["v"]) < float("inf")))
    as_counted = F.forall(F.map_keys("counts"), lambda k: F.size(F.filter("sequence", lambda s: s == k)) == F.col("counts")[k])
    return {
        "keys": F.array_sort("record_keys") == F.array(*map(F.lit, WINDOW_KEYS)),
        "interval": F.col("window_end") > F.col("window_start"),
        "count": total == F.col("event_count"),
        "sequence": (F.size("sequence") == total) & as_counted,
        "finite": finite,
        "order": F.array_sort(F.array_distinct(i)) == i,
        "range": F.forall(i, lambda k: (k >= 0) & (k < size)),
    }


#: Q2: fields of injection records by kind: those that must be there, and those that must not.
INJECTION_FIELDS = {"start": (("attack_type", "seed"), ("exit_code",)), "end": (("exit_code",), ("attack_type", "seed"))}


def injection_rules() -> dict[str, Column]:
    """Q2: rules of start and end records (kind, attack_type, seed as text, exit_code)."""
    def of(part: int, ok) -> Column:
        rule = F.lit(True)
        for kind, fields in INJECTION_FIELDS.items():
            for f in fields[part]:
                rule = rule & ((F.col("kind") != kind) | ok(F.col(f)))
        return rule

    return {"kind": F.col("kind").isin(*INJECTION_FIELDS), "required": of(0, Column.isNotNull), "forbidden": of(1, Column.isNull), "seed": F.col("seed").isNull() | F.expr("try_cast(seed AS BIGINT)").isNotNull()}


def dimension_counts(rows: DataFrame, dims: list[str]) -> DataFrame:
    """Q3: (dimension, value, rows) for each value of each dimension, in one pass."""
    pairs = F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")) for d in dims])
    return rows.select(F.explode(pairs).alias("x")).groupBy("x.dimension", "x.value").agg(F.count("*").alias("rows"))


def counter_report(rows: DataFrame, key: list[str], start: str, end: str, emitted: str, losses: list[str], bounds: tuple[float, float], least_rows: int) -> DataFrame:
    """Q4: (key, rows, odd_intervals, lag_p50, lag_p95, lag_p99, lag_max, loss, valid): intervals outside of bounds, how long
    after its end a row came, and the largest value of any loss counter, which must be 0."""
    lag, long = F.greatest(F.lit(0.0), (F.col(emitted) - F.col(end)).cast("double")), F.col(end) - F.col(start)
    g = rows.groupBy(*key).agg(F.count("*").alias("rows"), F.count_if((long < bounds[0]) | (long > bounds[1])).alias("odd_intervals"), F.percentile(lag, [0.5, 0.95, 0.99]).alias("_q"), F.max(lag).alias("lag_max"), F.greatest(*[F.max(c) for c in losses], F.lit(0)).alias("loss"))
    valid = (F.col("rows") >= least_rows) & (F.col("odd_intervals") == 0) & (F.col("loss") == 0)
    return g.select(*key, "rows", "odd_intervals", *[F.col("_q")[i].alias(f"lag_{n}") for i, n in enumerate(("p50", "p95", "p99"))], "lag_max", "loss", valid.alias("valid"))


def interval_contract(rows: DataFrame, key: list[str], start: str, end: str, regime: str, tie: str) -> DataFrame:
    """Q5: (key, tie, problem): intervals that end before they start, overlap an earlier one, or use a regime again."""
    w = Window.partitionBy(*key).orderBy(start, tie).rowsBetween(Window.unboundedPreceding, -1)
    again = F.row_number().over(Window.partitionBy(*key, regime).orderBy(start, tie)) > 1
    r = rows.withColumn("_e", F.max(end).over(w)).withColumn("_again", again)
    ok = {"order": F.col(end) > F.col(start), "overlap": F.coalesce(F.col("_e") <= F.col(start), F.lit(True)), "regime": ~F.col("_again")}
    return violations(r, [*key, tie], ok)


def matrix_contract(expected: DataFrame, found: DataFrame, key: list[str], digest: str, duration: str, shape: str, least: float) -> DataFrame:
    """Q7: (key, problem): besides completeness(), cells with a phase shorter than least, and cells of several shapes."""
    cells = found.groupBy(*key).agg(F.min(duration).alias("_d"), F.countDistinct(shape).alias("_s"))
    more = violations(cells, key, {"short": F.col("_d") >= least, "several shapes": F.col("_s") == 1})
    return completeness(expected, found, key, digest).unionByName(more)


def accounting(report: DataFrame, rows: DataFrame, key: list[str], alert: Column, tolerance: float = 1e-9) -> DataFrame:
    """Q8: (key, alerts_agree, rate_agrees, whole_agrees): what a report (key, alerts, eligible, rate) says against rows: its
    counts, its rate as the ratio of its own counts, and whether its eligible windows are all rows."""
    g = rows.groupBy(*key).agg(F.count_if(alert).alias("_a"), F.count("*").alias("_n"))
    r = report.join(g, key, "full_outer")
    yes = lambda c: F.coalesce(c, F.lit(False))
    return r.select(*key, yes(F.col("alerts") == F.col("_a")).alias("alerts_agree"), yes(F.abs(F.col("rate") - F.col("alerts") / F.col("eligible")) <= tolerance).alias("rate_agrees"), yes(F.col("eligible") == F.col("_n")).alias("whole_agrees"))


def marker_bounds(rows: DataFrame, marker: DataFrame, key: list[str], time: str, identity: list[str]) -> DataFrame:
    """Q10: (key, judged, excluded, foreign): rows from the marker's start on, rows before it, and judged rows whose identity
    is not the marker's (key, started, identity)."""
    m = marker.select(*key, "started", F.struct(*identity).alias("_of"))
    r = rows.join(m, key).withColumn("_in", F.col(time) >= F.col("started"))
    return r.groupBy(*key).agg(F.count_if("_in").alias("judged"), F.count_if(~F.col("_in")).alias("excluded"), F.count_if(F.col("_in") & ~F.struct(*identity).eqNullSafe(F.col("_of"))).alias("foreign"))


def capture_gates(rows: DataFrame, single: list[str], opened: Column) -> DataFrame:
    """Q3, Q9: one row: for each column whether it has one value, and the number of open intervals."""
    return rows.agg(F.count("*").alias("rows"), *[(F.countDistinct(c) == 1).alias(f"one_{c}") for c in single], F.count_if(opened).alias("open"))


def counter_checks(rows: DataFrame, key: list[str], time: str, total: str, parts: Column, least_rows: int) -> DataFrame:
    """Q4: (key, rows, enough, monotonic, exact): times rise within a key and the parts sum to the total."""
    w = Window.partitionBy(*key).orderBy(time)
    r = rows.withColumn("_b", F.lag(time).over(w)).withColumn("_ok", parts == F.col(total))
    return r.groupBy(*key).agg(F.count("*").alias("rows"), (F.count("*") >= least_rows).alias("enough"), F.bool_and(F.coalesce(F.col(time) > F.col("_b"), F.lit(True))).alias("monotonic"), F.bool_and("_ok").alias("exact"))


def completeness(expected: DataFrame, found: DataFrame, key: list[str], digest: str) -> DataFrame:
    """Q7: (key, problem): missing and unexpected cells, and cells of several digests."""
    f = found.groupBy(*key).agg(F.countDistinct(digest).alias("_n"))
    e = expected.select(*key).distinct().withColumn("_e", F.lit(True))
    problem = F.when(F.col("_n").isNull(), "missing").when(F.col("_e").isNull(), "unexpected").when(F.col("_n") > 1, "several digests")
    return e.join(f, key, "full_outer").select(*key, problem.alias("problem")).filter("problem is not null")


def roll_up(gates: DataFrame, key: list[str]) -> DataFrame:
    """Q11: (key, failed, passed) of boolean columns: the names of those that do not hold, in order."""
    names = [c for c in gates.columns if c not in key]
    failed = F.array_compact(F.array(*[F.when(~F.coalesce(F.col(c), F.lit(False)), F.lit(c)) for c in names]))
    return gates.select(*key, F.array_join(failed, ",").alias("failed"), (F.size(failed) == 0).alias("passed"))


def admitted(rows: DataFrame, status: str, approved: str) -> tuple[DataFrame, DataFrame]:
    """Q12: the approved rows, and the number of the others by status."""
    return rows.filter(F.col(status) == approved), rows.filter(~F.col(status).eqNullSafe(approved)).groupBy(status).agg(F.count("*").alias("rejected"))
