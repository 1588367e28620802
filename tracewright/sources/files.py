"""Sources and sinks: JSON lines, node captures, row-aligned tables, ordered merges, and writers."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder below spark.checkpoint.dir, which all executors share.

    Where that is unset and all tasks run in this process (tests), a local folder that is kept for the session's context.
    On a cluster without the setting it raises: executors would write to their own disks and rows would be missing.
    """
    base, sc = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        # the setting can't be changed in a running session
        base = sc._tracewright_scratch = getattr(sc, "_tracewright_scratch", None) or tempfile.mkdtemp(prefix="spark-")
    return f"{base.rstrip('/')}/tables/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table below scratch(): it is computed once, however often it is read, and its lineage ends there."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def json_lines(lines: DataFrame, column: str, schema: str) -> DataFrame:
    """The parsed records; lines that are no record of the schema go."""
    parsed = lines.withColumn("_r", F.from_json(column, f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    return parsed.filter("_r is not null and _r._bad is null").select(*[c for c in lines.columns if c != column], "_r.*").drop("_bad")


def read_capture(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """JSON records with a fixed schema; nothing is inferred."""
    return spark.read.schema(schema).json(path)


def read_nodes(spark: SparkSession, paths: list[str], schema: str, node: str) -> DataFrame:
    """Captures of several nodes, with whether each record names the node whose folder (node=<name>) it is in."""
    rows = spark.read.schema(schema).json(paths)
    folder = F.regexp_extract(F.col("_metadata.file_path"), r"node[-=]([^/]+)/", 1)
    return rows.withColumn("node_agrees", F.col(node) == folder)


def content_digest(df: DataFrame) -> tuple[int, str]:
    """Rows and a sum of row hashes, whatever the order of rows."""
    total = F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)"))
    n, digest = df.agg(F.count("*"), F.coalesce(total, F.lit(0).cast("decimal(38,0)"))).first()
    return n, str(digest)


def merged(sources: dict[str, DataFrame], time: str, kind: str, ranks: list[str], line: str) -> DataFrame:
    """Captures in one order: time, rank of the kind, source, line. The same capture twice is an error."""
    seen: dict[tuple[int, str], str] = {}
    for name, df in sources.items():
        if (other := seen.setdefault(content_digest(df), name)) != name:
            raise ValueError(f"sources {other} and {name} have the same rows")
    rank: Column = F.coalesce(*[F.when(F.col(kind) == k, i) for i, k in enumerate(ranks)], F.lit(len(ranks)))
    parts = [df.withColumn("source", F.lit(name)) for name, df in sources.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("kind_rank", rank).orderBy(time, "kind_rank", "source", line)


def concatenated(rows: DataFrame, round_: str, time: str, vector: str) -> DataFrame:
    """Adds place, the number of a row's round in order of the rounds' first times, and width_agrees, whether the row's
    vector is as wide as those of the first round. Rounds are few, so their numbering is over a small table."""
    first = rows.groupBy(round_).agg(F.min(time).alias("_t"), F.min(F.size(vector)).alias("_w"))
    w = Window.orderBy("_t", round_)
    numbered = first.select(round_, F.row_number().over(w).alias("place"), F.first("_w").over(w).alias("_w"))
    return rows.join(numbered, round_).withColumn("width_agrees", F.size(vector) == F.col("_w")).drop("_w")


def write_once(df: DataFrame, path: str) -> None:
    """Refuses to overwrite; Spark's committer stages files and renames them."""
    df.write.mode("errorifexists").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """S7."""
    df.write.mode("errorifexists").option("header", True).csv(path)
