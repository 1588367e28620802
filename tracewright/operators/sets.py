"""Set operations and pairings over ids."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def counted(kind: str, rows: DataFrame) -> DataFrame:
    """(kind, n)."""
    return rows.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n")


def reconcile(expected: DataFrame, found: DataFrame, key: list[str], values: list[str]) -> DataFrame:
    """(key, problem): missing, unexpected, changed or repeated ids of two logs."""
    a = expected.groupBy(*key).agg(F.min(F.struct(*values)).alias("_a"), F.count("*").alias("_na"))
    b = found.groupBy(*key).agg(F.min(F.struct(*values)).alias("_b"), F.count("*").alias("_nb"))
    problem = F.when(F.col("_nb").isNull(), "missing").when(F.col("_na").isNull(), "unexpected").when(F.greatest("_na", "_nb") > 1, "repeated").when(~F.col("_a").eqNullSafe(F.col("_b")), "changed")
    return a.join(b, key, "full_outer").select(*key, problem.alias("problem")).filter("problem is not null")


def duplicates(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """(key, copies, kept): keys of more than one row and the least row that a de-duplication keeps."""
    return rows.groupBy(*key).agg(F.count("*").alias("copies"), F.min(order).alias("kept")).filter("copies > 1")


def adjacent_pairs(rows: DataFrame, key: list[str], order: str, value: str) -> DataFrame:
    """(key, block, off, on): each odd row with the even one after it."""
    k = F.row_number().over(Window.partitionBy(*key).orderBy(order))
    pick = lambda odd: F.max(F.when(F.col("_k") % 2 == odd, F.col(value)))
    return rows.withColumn("_k", k).groupBy(*key, F.floor((F.col("_k") - 1) / 2).alias("block")).agg(pick(1).alias("off"), pick(0).alias("on"))


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
