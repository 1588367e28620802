"""The given tables in the shapes that the operators read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.session import ship

#: How event types stand for system calls.
SYSCALL_OF = {"signup": "execve", "purchase": "connect", "error": "setuid", "view": "read", "click": "write"}

#: SQL of events(), a common table expression named ev.
EV = (
    "ev AS (SELECT event_id, epoch_us(ts) AS us, epoch_us(ts) / 1e6 AS t, user_id AS pod, "
    "'w' || CAST(user_id % 8 AS VARCHAR) AS workload, CASE event_type "
    + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in SYSCALL_OF.items())
    + " END AS syscall, value, props FROM events)"
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(ts) -> F.Column:
    """Microseconds since 1970 of a timestamp without zone, whatever the session's zone."""
    return F.timestamp_diff("MICROSECOND", F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"), ts)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, us, t (seconds), pod, workload, syscall, value, props."""
    e = table(spark, sf_dir, "events")
    us = micros(F.col("ts").cast("timestamp_ntz"))
    return e.select(
        "event_id", us.alias("us"), (us / 1e6).alias("t"), F.col("user_id").alias("pod"),
        F.concat(F.lit("w"), (F.col("user_id") % 8).cast("string")).alias("workload"),
        F.create_map(*[F.lit(x) for kv in SYSCALL_OF.items() for x in kv])[F.col("event_type")].alias("syscall"), "value", "props",
    )


def days(column) -> F.Column:
    """Days since 1970 of a date or timestamp."""
    return F.datediff(F.to_date(column), F.lit("1970-01-01"))
