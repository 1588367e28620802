"""Periodic runs of words in whole texts, by tiles for each octave of periods.

A text is cut into overlapping tiles for each octave of periods (s to 2s - 1, s a power of two). A tile is solved by itself:
each multiple of s in it is a boundary, from which the text is compared with itself shifted by each period of the octave
(the boundary's Z values, forwards and backwards). What tiles find are fragments; they are shuffled by text and period
and stitched to runs.

Why boundaries at multiples of s suffice: words q apart agree over length - q >= 3q >= 3s places of a run, so some boundary
has its Z value at q of 2s or more. Of two neighbouring boundaries inside a run both have. So only the outermost
boundaries of such a chain are extended, by less than s words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewright.llm.shared import Words, chain_hash, text_slices, written

#: A run has at least so many words and so many periods; the proof above needs four periods.
LEAST_WORDS, LEAST_PERIODS = 6, 4
#: Words from one tile's start to the next in the octaves of short periods; a longer text's tiles are dealt over tasks.
TILE_WORDS = 8192
#: In the octaves of longer periods a tile's stride is so many times s.
STRIDE_OCTAVE = 16
#: Tables of block hashes are kept for tiles of fewer words, and computed again when asked for in larger ones.
KEEP_TABLES = 1 << 20


class _Blocks:
    """Hashes of the 2**level words from each place."""

    def __init__(self, words: np.ndarray):
        self.levels, self.keep = [words], len(words) <= KEEP_TABLES

    def __getitem__(self, level: int) -> np.ndarray:
        if level < len(self.levels):
            return self.levels[level]
        at = len(self.levels) - 1 if self.keep else 0
        h = self.levels[at]
        for j in range(at, level):
            step = min(1 << j, len(h))
            h = chain_hash(h[: len(h) - step], h[step:])
            if self.keep:
                self.levels.append(h)
        return h


def fragments(words: np.ndarray, start: np.ndarray, end: np.ndarray, octave: int, blocks: _Blocks | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(tile, period, first, last + 1) of the stretches in tiles [start, end) of words where words a period apart are equal.

    words: 64-bit hashes. first and last are places of the earlier word of a pair, counted in words. Every stretch of
    3 periods or more is found; first (last) is cut only by the tile's start (end).
    """
    s, blocks = 1 << octave, blocks or _Blocks(words)
    none = (np.zeros(0, np.int64),) * 4
    number = np.maximum(end - start - 3 * s, -1) // s + 1
    tile = np.repeat(np.arange(len(start)), number)
    if not len(tile):
        return none
    at = start[tile] + s * (np.arange(len(tile)) - np.repeat(np.cumsum(number) - number, number))
    block, period = blocks[octave + 1], np.arange(s, 2 * s)
    found = []
    rows = max(1, (1 << 20) // s)
    for i in range(0, len(at), rows):
        c = at[i : i + rows]
        last = end[tile[i : i + rows]] - 2 * s - c
        same = block[np.minimum(c[:, None] + period, len(block) - 1)] == block[c][:, None]
        same &= period <= last[:, None]
        b, q = np.nonzero(same)
        found.append((b + i, q + s))
    b, q = (np.concatenate(x) for x in zip(*found, strict=True))
    if not len(b):
        return none
    order = np.lexsort((b, q, tile[b]))
    b, q = b[order], q[order]
    joined = (b[1:] == b[:-1] + 1) & (q[1:] == q[:-1]) & (tile[b[1:]] == tile[b[:-1]])
    head, tail = np.r_[True, ~joined], np.r_[~joined, True]
    tiles, q, first, last = tile[b[head]], q[head], at[b[head]], at[b[tail]] + 2 * s
    low, high = start[tiles], end[tiles] - q
    for level in range(octave - 1, -1, -1):
        step, h = 1 << level, blocks[level]
        before = np.maximum(first - step, 0)
        first = np.where((first - step >= low) & (h[before] == h[np.minimum(before + q, len(h) - 1)]), first - step, first)
        ok = last + step <= high
        here = np.where(ok, last, 0)
        last = np.where(ok & (h[here] == h[here + np.where(ok, q, 0)]), last + step, last)
    return tiles, q, first, last


def octaves(n: int) -> range:
    """The octaves whose shortest period can have a run in n words."""
    return range(max(0, (n // LEAST_PERIODS).bit_length()) if n >= LEAST_WORDS else 0)


def tiles_of(n: int) -> Iterator[tuple[range, int, int]]:
    """(octaves, first word, last word + 1) of the tiles of a text of n words.

    The tile from t on has s words before t, as far as the run of a boundary at t may begin, and 4s words after its
    stride, so that neighbours share more than a period. Octaves of equal strides have one tile together.
    """
    low = TILE_WORDS // STRIDE_OCTAVE
    short = [k for k in octaves(n) if 1 << k <= low]
    for group in [short, *([k] for k in octaves(n) if 1 << k > low)]:
        if group:
            s = 1 << group[-1]
            stride = max(TILE_WORDS, STRIDE_OCTAVE * s)
            for t in range(0, n, stride):
                yield range(group[0], group[-1] + 1), max(0, t - s), min(n, t + stride + 4 * s)


def _is_run(period, first, last):
    """Whether a stretch of pairs is a run by its length."""
    return last - first + period >= np.maximum(LEAST_WORDS, LEAST_PERIODS * period)


def _short_fragments(words: Words, docs: np.ndarray) -> tuple[np.ndarray, ...]:
    """(doc, period, first, last + 1), counted from the text's first word, of texts that one tile holds in each octave."""
    hashes, out = words.hashes(), []
    left, blocks = docs[words.count[docs] >= LEAST_WORDS], None
    for octave in octaves(int(words.count[left].max(initial=0))):
        longer = left[words.count[left] >= LEAST_PERIODS << octave]
        if blocks is None or words.count[longer].sum() * 2 < words.count[left].sum():
            # tables only of the words of texts that are long enough
            left = longer
            count = words.count[left]
            start = np.cumsum(count) - count
            own = hashes[np.repeat(words.bounds[left] - start, count) + np.arange(count.sum())]
            blocks = _Blocks(own)
        tile, q, first, last = fragments(own, start, start + count, octave, blocks)
        out.append((left[tile], q, first - start[tile], last - start[tile]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 4


_FRAGMENT = pa.struct([("period", pa.int64()), ("first", pa.int64()), ("last", pa.int64())])


def _hex(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def _raw(batch_column: pa.Array, i: int) -> bytes:
    v = batch_column[i].as_py()
    return v.encode() if v else b""


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, n_words, is_long, found, clean (digest of a text without fragments), text (of the others)."""
    for batch in batches:
        for first, last, data, offsets in text_slices(batch.column(1)):
            words = Words(data, offsets)
            is_long = words.count > TILE_WORDS
            doc, q, a, b = _short_fragments(words, np.flatnonzero(~is_long))
            keep = _is_run(q, a, b)  # one tile holds these texts, so nothing is cut
            order = np.argsort(doc[keep], kind="stable")
            doc, q, a, b = (x[keep][order] for x in (doc, q, a, b))
            cuts = np.searchsorted(doc, np.arange(words.n_docs + 1)).astype(np.int32)
            found = pa.ListArray.from_arrays(pa.array(cuts), pa.StructArray.from_arrays([pa.array(x) for x in (q, a, b)], fields=list(_FRAGMENT)))
            stays = is_long | (np.diff(cuts) > 0)
            raw = [data[offsets[i] : offsets[i + 1]].tobytes() for i in range(words.n_docs)]
            clean = [None if k else _hex(b" ".join(r.split())) for k, r in zip(stays, raw, strict=True)]
            text = pa.array([r.decode() if k else None for k, r in zip(stays, raw, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), pa.array(words.count.astype(np.int64)), pa.array(is_long), found, pa.array(clean, pa.string()), text], ["id", "n_words", "is_long", "found", "clean", "text"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """row, number of the tile, n_words of the text, octaves, first word, and the tile's words as numbers within their text."""
    for batch in batches:
        for row, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            for _, _, data, offsets in text_slices(pa.array([text.as_py()], pa.string())):
                _, number = np.unique(Words(data, offsets).hashes(), return_inverse=True)
                number = number.astype("<i4")
                for i, (k, lo, hi) in enumerate(tiles_of(len(number))):
                    yield pa.RecordBatch.from_pydict({"row": [row], "tile": pa.array([i], pa.int32()), "n_words": [len(number)], "low": pa.array([k.start], pa.int32()), "high": pa.array([k.stop], pa.int32()), "lo": [lo], "words": pa.array([number[lo:hi].tobytes()], pa.binary())})


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """row, period, first, last of the fragments of a tile that are cut by its edge or long enough for a run."""
    for batch in batches:
        for row, _, n, low, high, lo, raw in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True):
            words = np.frombuffer(raw, "<i4").astype(np.uint64)
            words = chain_hash(words, words)
            blocks, edge = _Blocks(words), np.array([len(words)])
            for octave in range(low, high):
                _, q, a, b = fragments(words, np.array([0]), edge, octave, blocks)
                keep = _is_run(q, a, b) | (a == 0) & (lo > 0) | (b + q == len(words)) & (lo + len(words) < n)
                q, a, b = q[keep], a[keep] + lo, b[keep] + lo
                if len(q):
                    yield pa.RecordBatch.from_pydict({"row": np.full(len(q), row), "period": q, "first": a, "last": b})


def stitched(pieces: DataFrame) -> DataFrame:
    """(row, start, length, period) of runs from fragments (row, period, first, last): those of a period that touch are one.

    A stretch that is found at a multiple of its period is the same stretch, so the smallest period stays.
    """
    before = Window.partitionBy("row", "period").orderBy("first", "last").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.max("last").over(before)
    parts = pieces.withColumn("fresh", (reach.isNull() | (F.col("first") > reach)).cast("int"))
    parts = parts.withColumn("part", F.sum("fresh").over(Window.partitionBy("row", "period").orderBy("first", "last").rowsBetween(Window.unboundedPreceding, 0)))
    whole = parts.groupBy("row", "period", "part").agg(F.min("first").alias("start"), F.max("last").alias("last"))
    length = F.col("last") - F.col("start") + F.col("period")
    runs = whole.select("row", "period", "start", length.alias("length")).filter((F.col("length") >= LEAST_WORDS) & (F.col("length") >= LEAST_PERIODS * F.col("period")))
    return runs.groupBy("row", "start", "length").agg(F.min("period").alias("period"))


_RESULT = "n_words long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def collapsed(words: list, runs: list[tuple[int, int, int]]) -> list:
    """The words that are in no run (start, length, period) after its first period."""
    edge = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    gone = np.cumsum(edge[:-1]) > 0
    return [w for w, x in zip(words, gone, strict=True) if not x]


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["n_words", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    for batch in batches:
        out = []
        for text, runs in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
            words = (text.as_py() or "").encode().split()
            runs = sorted((r["start"], r["period"], r["length"]) for r in runs or [])
            runs = [(start, length, q) for start, q, length in runs]
            best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=(None, None, None))
            lines = "".join(f"{start},{length},{q}\n" for start, length, q in runs)
            out.append([len(words), len(runs), *best, 1000 * best[1] // best[2] if runs else None, _hex(lines.encode()), _hex(b" ".join(collapsed(words, runs)))])
        columns = list(zip(*out, strict=True)) or [[]] * 8
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.string() if n.endswith("256") else pa.int64()) for c, n in zip(columns, names, strict=True))], ["id", *names])


def word_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_runs, the longest run's start, length, period and exponent_milli, runs_sha256, collapsed_sha256, n_words.

    Words are [^\\x20\\x09-\\x0D]+, compared by 64-bit hashes; a run is a stretch with smallest period q of max(6, 4q) words
    or more that no neighbour extends. Of equally long runs the one of smallest start, then period. Null and empty texts
    have no words and no runs: four nulls and the digests of the empty string. Null ids stay null, repeated rows repeat
    (rows are told apart by a number of their own, so none shares a key with another), other columns are not read.
    Texts of more than TILE_WORDS words are solved by many tasks; texts without a fragment are shuffled nowhere.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    found = "array<struct<period:long,first:long,last:long>>"
    read = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(_read, f"id {kind}, n_words long, is_long boolean, found {found}, clean string, text string")
    read = written(read.withColumn("row", F.monotonically_increasing_id()), "texts")
    short = read.filter(~F.col("is_long")).select("row", F.explode("found").alias("f")).select("row", "f.*")
    tiles = read.filter("is_long").select("row", "text").mapInArrow(_cut, "row long, tile int, n_words long, low int, high int, lo long, words binary").repartition("row", "tile")
    runs = stitched(short.unionByName(tiles.mapInArrow(_solve, "row long, period long, first long, last long")))
    lists = runs.groupBy("row").agg(F.collect_list(F.struct("start", "length", "period")).alias("runs"))
    some = read.filter("clean IS NULL").select("row", "id", "text").join(lists, "row", "left").select("id", "text", "runs").mapInArrow(_digested, f"id {kind}, {_RESULT}")
    nulls = [F.lit(None).cast("long").alias(c) for c in ("start", "length", "period", "exponent_milli")]
    none = read.filter("clean IS NOT NULL").select("id", "n_words", F.lit(0).cast("long").alias("n_runs"), *nulls, F.lit(_hex(b"")).alias("runs_sha256"), F.col("clean").alias("collapsed_sha256"))
    order = ["n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256", "n_words"]
    return none.unionByName(some).select(F.col("id").alias(id_col), *order)


def with_planted_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs in which the texts of a tenth of the ids repeat their words from some word on, periodically.

    With h the crc32 of the id as text, g = floor(h / 10) and n the number of words: if h % 10 = 0 and n > 0, word
    i >= a becomes word a + (i - a) % p, where a = g % n and p = 1 + floor((n - a) / (3 + g % 8)). Other rows stay as they
    are, also those of null ids.
    """
    h = F.crc32(F.col(id_col).cast("string").cast("binary"))
    words = F.filter(F.split(F.coalesce(F.col(text_col), F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def planted(words, g):
        n = F.size(words)
        a = (g % n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        return F.concat_ws(" ", F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(words, F.when(i < a, i).otherwise(a + (i - a) % p))))

    chosen = F.coalesce(h % 10 == 0, F.lit(False))
    # the words are made once, in a projection of their own
    rows = docs.withColumn("_words", F.when(chosen, words)).withColumn("_g", F.floor(h / 10).cast("long"))
    text = F.when(F.size("_words") > 0, planted(F.col("_words"), F.col("_g"))).otherwise(F.col(text_col))
    return rows.withColumn(text_col, text).select(*docs.columns)
