"""What the operators of this subpackage share: written tables and numpy views of text columns."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.sources.files import scratch


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write df as Parquet into the shared folder and read it again."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def is_training_row(doc_id) -> F.Column:
    """Rows whose labels may be learnt: crc32 of doc_id as text, mod 5, is not 0."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 != 0


# ---------------------------------------------------------------- joins that hot keys don't unbalance

#: Keys at most that go to all tasks because many rows share them, and the rows from which a key is one of them.
HOT_KEYS, HOT_ROWS = 1024, 1000
#: Bits of a bitmap of keys for each key, and at least and at most: 128 KB to 128 MB.
BITS_PER_KEY, LEAST_BITS, MOST_BITS = 16, 1 << 20, 1 << 30
#: Bits of a bitmap that the driver fetches by one job: 8 MB.
FETCHED_BITS = 1 << 26


def join_uneven(rows: DataFrame, table: DataFrame, keys: list[str], n: str, total: int) -> DataFrame:
    """Inner join of rows with a table of unique keys, whose column n says how many of the total rows have a key.

    Keys of total / HOT_KEYS rows or more, so HOT_KEYS of them at most, go to all tasks; the other rows are shuffled by
    their keys. So no task gets a group that grows with the input.
    """
    is_hot = F.col(n) >= max(HOT_ROWS, -(-total // HOT_KEYS))
    hot, cold = F.broadcast(table.filter(is_hot).drop(n)), table.filter(~is_hot).drop(n)
    return rows.join(hot, keys).unionByName(rows.join(hot.select(*keys), keys, "left_anti").join(cold, keys))


def key_bit(bits: int, *keys: str) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(bits))


def key_bitmap(keys: DataFrame, *names: str) -> np.ndarray:
    """A bitmap of hash values of keys; it only thins out what is joined with them later.

    It has 16 to 32 bits for each row of keys, so about one other key in 16 is taken for one of them at most, up to the
    32 million rows for which MOST_BITS are enough. With more, what is joined later is thinned out less. The driver runs
    a job for each partition that it fetches, so the buckets are gathered in partitions of FETCHED_BITS before that.
    """
    bits = max(LEAST_BITS, min(MOST_BITS, 1 << (BITS_PER_KEY * keys.count()).bit_length()))
    bit = key_bit(bits, *names).alias("bit")
    buckets = keys.select(bit).groupBy(F.expr("bitmap_bucket_number(bit + 1)").alias("bucket")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(bit + 1))").alias("bits"))
    rows = buckets.repartition(-(-bits // FETCHED_BITS)).toLocalIterator()
    out = np.zeros(bits // 8, np.uint8)
    for r in rows:
        out[(r["bucket"] - 1) * 4096 : r["bucket"] * 4096] = np.frombuffer(r["bits"], np.uint8)
    return out


def in_bitmap(bitmap: np.ndarray, bit: np.ndarray) -> np.ndarray:
    at = bit.astype(np.int64)
    return (bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def maybe_in(bits: Broadcast, size: int = 0):
    """A function of columns that tells the rows whose key may be in a broadcast bitmap; False is sure. size: its bits, if
    they are known; else the driver reads the bitmap again."""
    size = size or 8 * len(bits.value)

    @F.pandas_udf("boolean")
    def maybe(bit: pd.Series) -> pd.Series:
        return pd.Series(in_bitmap(bits.value, bit.to_numpy()))

    return lambda *columns: maybe(key_bit(size, *columns))


# ---------------------------------------------------------------- text columns as byte arrays

#: Bytes that are handled at once; a longer text is handled alone and whole.
SLICE_BYTES = 1 << 19

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LENGTH = np.uint64(0x9E3779B97F4A7C15)
#: Its first multiples, modulo 2**64.
_LENGTHS = np.arange(9, dtype=np.uint64) * _LENGTH
#: Words of more bytes are hashed one by one.
_LONG_WORD = 256
#: Masks of the first 0 to 8 bytes of a little-endian integer.
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit integers that spreads every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_slices(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yield (first row, last row + 1, bytes, offsets) for runs of rows of about SLICE_BYTES; null counts as empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = int(np.searchsorted(offsets, offsets[first] + SLICE_BYTES, side="right")) - 1
        last = min(max(last, first + 1), len(column))
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


class Words:
    """The words [^\\x20\\x09-\\x0D]+ of some texts, as arrays: start, end, doc (index of the text)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets, n = data, offsets, len(data)
        self.n_docs = len(offsets) - 1
        word = ~_SPACE[data]
        first = word.copy()
        first[1:] &= ~word[:-1]
        last = word.copy()
        last[:-1] &= ~word[1:]
        inner = offsets[(offsets > 0) & (offsets < n)]
        first[inner] = word[inner]
        last[inner - 1] = word[inner - 1]
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.bounds = np.searchsorted(self.start, offsets)
        self.count = np.diff(self.bounds)
        self.doc = np.repeat(np.arange(self.n_docs), self.count)

    def eights(self, lower: bool = False) -> np.ndarray:
        """At each place of the data the integer of the eight bytes from there, zeros beyond the end."""
        padded = np.zeros(len(self.data) + 8, np.uint8)
        padded[: len(self.data)] = _LOWER[self.data] if lower else self.data
        return np.ndarray((len(self.data) + 1,), "<u8", padded, strides=(1,))

    def heads(self) -> np.ndarray:
        """The first eight bytes of each word, or all of a shorter one, as an integer."""
        return self.eights()[self.start] & _MASK[np.minimum(self.end - self.start, 8)]

    def hashes(self, lower: bool = False, prefixes: tuple[int, ...] = ()) -> np.ndarray | list[np.ndarray]:
        """64-bit hash of each word; with prefixes of 8 bytes at most, one array for each length (0 where the word is shorter).

        Each eight bytes are mixed in before the next, so no pattern of bytes cancels out as it does in a polynomial.
        Long words get blake2b.
        """
        at, size = self.eights(lower), self.end - self.start
        first = at[self.start] & _MASK[np.minimum(size, 8)]
        if prefixes:
            return [np.where(size < k, np.uint64(0), _mix((first & _MASK[k]) + _LENGTHS[k])) for k in prefixes]
        out = _mix(first + size.astype(np.uint64) * _LENGTH)
        rest, done = np.flatnonzero(size > 8), 8
        while len(rest) and done < _LONG_WORD:
            part = at[self.start[rest] + done] & _MASK[np.minimum(size[rest] - done, 8)]
            out[rest] = _mix(out[rest] * np.uint64(0xD6E8FEB86659FD93) + part)
            done += 8
            rest = rest[size[rest] > done]
        for i in rest:
            word = self.data[self.start[i] : self.end[i]]
            out[i] = int.from_bytes(hashlib.blake2b((_LOWER[word] if lower else word).tobytes(), digest_size=8).digest(), "little")
        return out


def chain_hash(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hash of two neighbouring blocks from their hashes."""
    return _mix(left * np.uint64(0xD6E8FEB86659FD93) + right)


def combine(*parts: np.ndarray) -> np.ndarray:
    """One hash of several aligned hashes, in order."""
    out = np.full(len(parts[0]), len(parts), np.uint64)
    for p in parts:
        out = _mix(out * np.uint64(0xD6E8FEB86659FD93) + p)
    return out
