"""Extendible hashing: shards are hash prefixes, and only a bucket over the byte limit is split on one more bit.

DataFrame functions only. The directory is found from a histogram over hash prefixes, never from the rows in one place.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm.shared import written

#: Bits of the hash: the first 15 hexadecimal digits of md5.
HASH_BITS = 60
#: The histogram has about 2**SPARE_BITS cells for each shard.
SPARE_BITS = 5


def hash_bits(key) -> F.Column:
    """The first HASH_BITS bits of md5 of the key as text; a null key counts as an empty text."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def _prefix(bits, depth) -> F.Column:
    return F.expr(f"shiftright({bits}, {HASH_BITS} - {depth})")


def _ends(cells: DataFrame, fine: int, coarse: int, byte_limit: int) -> DataFrame:
    """(cell, depth, shard_bytes, shard_rows, oversized) of each cell of fine bits that a bucket of coarse to fine bits holds.

    A bucket ends the splitting when it fits, or when all its rows have one hash value and no bit can part them.
    """
    ups = cells.select("cell", "bytes", "rows", "low", "high", F.explode(F.sequence(F.lit(coarse), F.lit(fine))).alias("depth"))
    ups = ups.withColumn("prefix", F.expr(f"shiftright(cell, {fine} - depth)"))
    sums = _sums(ups, "depth", "prefix")
    ends = sums.filter((F.col("bytes") <= byte_limit) | (F.col("low") == F.col("high"))).select("depth", "prefix", F.col("bytes").alias("shard_bytes"), F.col("rows").alias("shard_rows"))
    found = ups.select("cell", "depth", "prefix").join(ends, ["depth", "prefix"])
    return found.groupBy("cell").agg(F.min(F.struct("depth", "shard_bytes", "shard_rows")).alias("leaf")).select("cell", "leaf.*", (F.col("leaf.shard_bytes") > byte_limit).alias("oversized"))


def _sums(cells: DataFrame, *key: str) -> DataFrame:
    return cells.groupBy(*key).agg(F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows"), F.min("low").alias("low"), F.max("high").alias("high"))


def _leaves(cells: DataFrame, fine: int, coarse: int, byte_limit: int) -> DataFrame:
    """The ends of all cells. Buckets of a middle depth, far fewer than cells, are looked at first; only the cells of those that
    are too full go down from there, a few bits."""
    middle = max(coarse, fine - SPARE_BITS - 2)
    tops = _sums(cells.withColumn("top", F.expr(f"shiftright(cell, {fine - middle})")), "top").withColumnRenamed("top", "cell")
    upper = written(_ends(tops, middle, coarse, byte_limit), "upper-directory").withColumnRenamed("cell", "top")
    keyed = cells.withColumn("top", F.expr(f"shiftright(cell, {fine - middle})"))
    placed = keyed.select("cell", "top").join(upper, "top").drop("top")
    if middle == fine:
        return placed
    return placed.unionByName(_ends(keyed.join(upper, "top", "left_anti"), fine, middle + 1, byte_limit))


def extendible_shards(docs: DataFrame, byte_limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: id, bytes, depth (bits of its bucket), shard (their value), shard_bytes, shard_rows, oversized.

    Null and empty texts have 0 bytes. Rows with equal ids have equal hashes and stay together: such a bucket, or one
    text over the limit, is a shard of its own that may be over the limit and is then marked oversized. An empty table
    gives an empty result; other columns are not read.
    """
    kept = docs.select(F.col(id_col), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("bytes"), hash_bits(F.col(id_col)).alias("bits"))
    rows = written(kept, "shard-rows")
    total = rows.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    fine, coarse, done = min(HASH_BITS, max(1, (total // byte_limit).bit_length() + SPARE_BITS)), 0, []
    while True:
        keyed = rows.withColumn("cell", _prefix("bits", fine))
        cells = keyed.groupBy("cell").agg(F.sum("bytes").alias("bytes"), F.count("*").alias("rows"), F.min("bits").alias("low"), F.max("bits").alias("high"))
        directory = written(_leaves(cells, fine, coarse, byte_limit), "directory")
        done.append(keyed.join(directory, "cell").drop("cell").withColumn("shard", F.expr(f"shiftright(bits, {HASH_BITS} - depth)")))
        # cells that are still too full, of several hash values: more bits for their rows alone
        full = written(cells.filter((F.col("bytes") > byte_limit) & (F.col("low") < F.col("high"))).select("cell"), "full-cells")
        if full.isEmpty():
            break
        rows = keyed.join(full, "cell", "left_semi").drop("cell")
        coarse, fine = fine + 1, min(HASH_BITS, fine + 12)
    out = reduce(DataFrame.unionByName, done)
    return out.select(id_col, "bytes", "depth", "shard", "shard_bytes", "shard_rows", "oversized")


def write_shards(docs: DataFrame, path: str, byte_limit: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write docs as one folder for each shard. Ids must be unique; rows meet their shard in one shuffle."""
    shards = extendible_shards(docs, byte_limit, id_col, text_col).select(F.col(id_col), F.concat_ws("-", "depth", "shard").alias("shard"))
    docs.join(shards, id_col).repartition("shard").write.partitionBy("shard").parquet(path)
