"""N-gram Jaccard self-join: a blocked sparse product of documents by shingles with size-derived bounds.

1. Every distinct shingle set becomes one row of the incidence matrix (exact copies share it).
2. Shingle counts are summed in each task, then in blocks of the shingle space, one block at a time and of bounded
   size; the most frequent ones, at most HOT_LIMIT, are sent to all tasks. Columns are ordered by that frequency, then
   by hash: any order common to all rows gives the same links.
3. A row's first n - ceil(0.75 n) + 1 columns must meet those of every row that it links with, so only these are
   multiplied. Pairs whose sizes, or whose positions in a common column, cannot reach the overlap are dropped.
4. First each row of a column is paired with one pivot, the row in which the column comes first: a text that others
   are edits of has fewer rare columns before it than they. The exact overlaps give links and components. Then only
   pairs across components are left, and they are paired by (size, position) classes first.
So a column of m near copies costs m pairs, not m squared, and no link is lost.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewright.llm.shared import Words, combine, in_bitmap, join_uneven, key_bit, key_bitmap, maybe_in, text_slices, written

SHINGLE_WORDS = 5
#: Shingles counted as frequent at most: 4 bytes and a level each, so the broadcast is bounded.
HOT_LIMIT = 1_000_000
#: A shingle in fewer sets than this is never frequent.
HOT_LEAST = 8
#: Blocks of the upper halves of shingle hashes in which counts are summed: each has 2**32 / BLOCKS values at most.
BLOCKS = 1024
#: Shingles that a task gathers before it hands on their counts.
FLUSH = 1 << 20


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of the texts one after the other, their bounds, and a hash of each set."""
    words = Words(data, offsets)
    h, count, bounds = words.hashes(lower=True), words.count, words.bounds
    k = SHINGLE_WORDS
    parts, sizes = [], np.zeros(len(count), np.int64)
    if len(h) >= k:
        shingle = combine(*(h[i : len(h) - k + 1 + i] for i in range(k)))
    for d in range(len(count)):
        n = count[d]
        if n >= k:
            part = np.unique(shingle[bounds[d] : bounds[d] + n - k + 1])
        elif n:
            part = combine(*(h[bounds[d] + i : bounds[d] + i + 1] for i in range(n)))
        else:
            continue
        parts.append(part)
        sizes[d] = len(part)
    flat = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    ends = np.r_[0, np.cumsum(sizes)]
    sums = np.r_[np.zeros(1, np.uint64), np.cumsum(combine(flat), dtype=np.uint64)]
    key = combine(sums[ends[1:]] - sums[ends[:-1]], sizes.astype(np.uint64)).view(np.int64)
    return flat, ends, key


def _packed(value: np.ndarray, count: np.ndarray) -> bytes:
    """Rising values and their counts."""
    return zlib.compress(np.concatenate([np.diff(value, prepend=value[:1] * 0), count]).astype("<u4").tobytes(), 1)


def _unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(zlib.decompress(data), "<u4").reshape(2, -1)
    return np.cumsum(both[0], dtype=np.uint64).astype(np.uint32), both[1].astype(np.int64)


def _summed(value: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values, rising, and the sums of their counts."""
    order = np.argsort(value, kind="stable")
    value = value[order]
    begin = np.flatnonzero(np.r_[True, value[1:] != value[:-1]]) if len(value) else np.zeros(0, np.int64)
    return value[begin], np.add.reduceat(count[order], begin) if len(value) else count


def _sets_and_counts(texts: DataFrame, blocks: int) -> DataFrame:
    """Rows of documents (doc_id, n, key) and rows of counts (block, counts), from one pass."""
    kind = texts.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held: list[np.ndarray] = []
        size = 0

        def flush(ids: pa.DataType):
            upper = (np.concatenate(held) >> np.uint64(32)).astype(np.uint32)
            held.clear()
            seen.clear()
            value, count = _summed(upper, np.ones(len(upper), np.int64))
            cut = np.searchsorted(value, np.arange(1, blocks, dtype=np.uint64) * np.uint64((1 << 32) // blocks))
            packed = [(k, _packed(v, c)) for k, (v, c) in enumerate(zip(np.split(value, cut), np.split(count, cut))) if len(v)]
            n = len(packed)
            return pa.RecordBatch.from_arrays([pa.nulls(n, ids), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.array([k for k, _ in packed], pa.int32()), pa.array([d for _, d in packed], pa.binary())], names)

        names = ["doc_id", "n", "key", "block", "counts"]
        ids = None
        for batch in batches:
            ids = batch.column(0).type
            for first, last, data, offsets in text_slices(batch.column(1)):
                flat, ends, key = shingle_sets(data, offsets)
                for d, k in enumerate(key.tolist()):
                    if ends[d + 1] > ends[d] and k not in seen:
                        seen.add(k)
                        held.append(flat[ends[d] : ends[d + 1]])
                        size += len(held[-1])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), pa.array(np.diff(ends), pa.int64()), pa.array(key, pa.int64()), pa.nulls(last - first, pa.int32()), pa.nulls(last - first, pa.binary())], names)
                if size >= FLUSH:
                    yield flush(ids)
                    size = 0
        if held:
            yield flush(ids)

    return texts.mapInArrow(run, f"doc_id {kind.simpleString()}, n long, key long, block int, counts binary")


def _frequent(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The upper halves of the most frequent shingle hashes, at most HOT_LIMIT, and the base-2 logarithms of their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def levels(value, count):
            level = np.floor(np.log2(count)).astype(np.uint8)
            for v in np.unique(level[count >= HOT_LEAST]).tolist():
                ids = value[(level == v) & (count >= HOT_LEAST)]
                yield pa.RecordBatch.from_arrays([pa.array([v], pa.int32()), pa.array([len(ids)], pa.int64()), pa.array([ids.tobytes()], pa.binary())], ["level", "n", "ids"])

        here, sums, held, size = None, (np.zeros(0, np.uint32), np.zeros(0, np.int64)), [], 0
        for batch in batches:
            for block, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if block != here or size > max(FLUSH, len(sums[0])):
                    # what is summed has no more values than a block, what waits no more than that or FLUSH
                    sums, held, size = _summed(*(np.concatenate(x) for x in zip(sums, *held))), [], 0
                if block != here:
                    yield from levels(*sums)
                    here, sums = block, (np.zeros(0, np.uint32), np.zeros(0, np.int64))
                held.append(_unpacked(packed))
                size += len(held[-1][0])
        yield from levels(*_summed(*(np.concatenate(x) for x in zip(sums, *held))))

    found = written(counts.repartition("block").sortWithinPartitions("block").mapInArrow(run, "level int, n long, ids binary"), "frequent")
    lowest, total = 64, 0
    for level, n in sorted(((r["level"], r["n"]) for r in found.groupBy("level").agg(F.sum("n").alias("n")).collect()), reverse=True):
        if total + n > HOT_LIMIT:
            break
        lowest, total = level, total + n
    rows = found.filter(F.col("level") >= lowest).select("level", "ids").collect()  # at most HOT_LIMIT ids
    ids = np.concatenate([np.frombuffer(r["ids"], np.uint32) for r in rows]) if rows else np.zeros(0, np.uint32)
    level = np.concatenate([np.full(len(r["ids"]) // 4, r["level"], np.uint8) for r in rows]) if rows else np.zeros(0, np.uint8)
    order = np.argsort(ids)
    return ids[order], level[order]


def _prefixes(texts: DataFrame, hot) -> DataFrame:
    """The columns (shingles) of each row (set) that are multiplied, with the row's size and the column's place in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, levels = hot.value
        seen: set[int] = set()
        for batch in batches:
            for _, _, data, offsets in text_slices(batch.column(1)):
                flat, ends, key = shingle_sets(data, offsets)
                if not len(flat):
                    continue
                level = np.zeros(len(flat), np.uint8)
                if len(ids):
                    upper = (flat >> np.uint64(32)).astype(np.uint32)
                    at = np.minimum(np.searchsorted(ids, upper), len(ids) - 1)
                    level = np.where(ids[at] == upper, levels[at], 0)
                out: list[tuple] = []
                for d, k in enumerate(key.tolist()):
                    n = int(ends[d + 1] - ends[d])
                    if not n or k in seen:
                        continue
                    seen.add(k)
                    part = slice(ends[d], ends[d + 1])
                    m = n - (3 * n + 3) // 4 + 1
                    # the hashes are sorted, so a stable sort by level orders by (level, hash)
                    out.append((flat[part][np.argsort(level[part], kind="stable")[:m]] if level[part].any() else flat[part][:m], k, n))
                if out:
                    size = [len(x[0]) for x in out]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate([x[0] for x in out]).view(np.int64)), pa.array(np.repeat([x[1] for x in out], size), pa.int64()), pa.array(np.repeat([x[2] for x in out], size), pa.int32()), pa.array(np.concatenate([np.arange(s) for s in size]), pa.int32())],
                        ["token", "key", "n", "pos"],
                    )

    return texts.mapInArrow(run, "token long, key long, n int, pos int")


def _asked_keys(bits):
    """A function of (key_bit of an id, text): the hash of the text's shingle set, as in the rows of _grouped, if the broadcast
    bitmap may mean the id, else null. One Python node does both; Spark may not move it, or it would be run twice."""

    def keys(bit: pd.Series, text: pd.Series) -> pd.Series:
        chosen = in_bitmap(bits.value, bit.to_numpy())
        parts = [shingle_sets(data, offsets)[2] for _, _, data, offsets in text_slices(pa.array(text[chosen], pa.string()))]
        out = pd.Series(np.zeros(len(text), np.int64), dtype="Int64")
        out[~chosen] = pd.NA
        out[chosen] = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        return out

    return F.pandas_udf(keys, "long").asNondeterministic()


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, all columns unchanged, with one document of each group of near duplicates: that of the least id.

    What goes is judged by id and shingle set, so rows of one id with different texts are judged on their own; if the
    least id of a group has several sets in it, that with the least hash stays. Of repeated rows, equal in id and set,
    one stays. Rows without an id stay, and so do rows without words. No rows give no rows. A bitmap of bounded size tells
    most rows that cannot go; only the others, about as many as go, are joined with what is known of their ids.
    """
    groups = written(_grouped(docs, id_col, text_col), "groups").filter("doc_id is not null")
    first = groups.filter("part is not null").groupBy("part").agg(F.min(F.struct("doc_id", "key")).alias("first"), F.count("*").alias("n"))
    linked = join_uneven(groups.filter("part is not null"), written(first, "first-of-groups"), ["part"], "n", groups.count())
    judged = linked.select("doc_id", "key", (F.struct("doc_id", "key") == F.col("first")).alias("stays"))
    judged = judged.unionByName(groups.filter("part is null").select("doc_id", "key", F.lit(True).alias("stays")))
    sets = judged.groupBy("doc_id", "key").agg(F.max("stays").alias("stays"), F.count("*").alias("copies"))
    sets = written(sets.filter(~F.col("stays") | (F.col("copies") > 1)), "judged-sets")
    if sets.isEmpty():
        return docs
    bits, size = _sent_bitmap(sets, "doc_id")
    maybe = maybe_in(bits, size)(id_col)
    asked = docs.select(F.struct("*").alias("_row"), F.col(id_col).alias("doc_id"), _asked_keys(bits)(key_bit(size, id_col), F.col(text_col)).alias("key")).filter("key is not null")
    known = asked.join(sets, ["doc_id", "key"], "left").filter("coalesce(stays, true)")
    kept = docs.filter(~maybe).unionByName(known.filter("copies is null or copies = 1").select("_row.*"))
    if sets.filter("stays").isEmpty():
        return kept
    return kept.unionByName(known.filter("copies > 1").dropDuplicates(["doc_id", "key"]).select("_row.*"))


def _sent_bitmap(keys: DataFrame, name: str) -> tuple[Broadcast, int]:
    """A broadcast key_bitmap and its bits; the driver keeps no array of it."""
    bitmap = key_bitmap(keys, name)
    return keys.sparkSession.sparkContext.broadcast(bitmap), 8 * len(bitmap)


def _sets(texts: DataFrame, doc_keys: DataFrame, keys: DataFrame) -> DataFrame:
    """The whole sets of the wanted keys, each of which doc_keys has. Documents are thinned out by a bitmap of their ids
    before they are shingled."""
    # exact copies are summed up before they meet, so that a large group of them is no large task
    wanted = written(doc_keys.groupBy("key").agg(F.min("doc_id").alias("id")).join(keys, "key"), "wanted-keys")
    bits, size = _sent_bitmap(wanted, "id")
    bit = key_bit(size, "doc_id").alias("bit")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = bits.value
        seen: set[int] = set()
        for batch in batches:
            chosen = in_bitmap(table, batch.column(2).to_numpy(zero_copy_only=False))
            if not chosen.any():
                continue
            for _, _, data, offsets in text_slices(batch.column(1).filter(pa.array(chosen))):
                flat, ends, key = shingle_sets(data, offsets)
                at_key = [(d, k) for d, k in enumerate(key.tolist()) if ends[d + 1] > ends[d] and not (k in seen or seen.add(k))]
                if at_key:
                    yield pa.RecordBatch.from_arrays([pa.array([k for _, k in at_key], pa.int64()), pa.array([flat[ends[d] : ends[d + 1]].view(np.int64) for d, _ in at_key], pa.list_(pa.int64()))], ["key", "shingles"])

    found = texts.select("doc_id", "text", bit).mapInArrow(run, "key long, shingles array<long>")
    return found.join(wanted.select("key"), "key", "left_semi").groupBy("key").agg(F.first("shingles").alias("shingles"))


def _linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Exact overlap of each pair (a, b); those with 100 * intersection >= 75 * union."""
    left, right = sets.select(F.col("key").alias("a"), F.col("shingles").alias("x")), sets.select(F.col("key").alias("b"), F.col("shingles").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    return pairs.join(left, "a").join(right, "b").filter(7 * both >= 3 * (F.size("x") + F.size("y"))).select("a", "b")


def connected_components(edges: DataFrame) -> DataFrame:
    """(key, component) for each key of edges (a, b): the least key reachable; large and small stars in turn.

    A star's centre may have a great many edges: they are joined with its least neighbour without one task for all.
    """

    def with_least(rows: DataFrame, total: int) -> DataFrame:
        least = rows.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        return join_uneven(rows, written(least, "least-neighbours"), ["u"], "n", total)

    edges = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before, now = None, (edges.count(),)
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = written(with_least(both, 2 * now[0]).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large-stars")
        small = with_least(large, now[0]).select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        edges = written(small.filter("u <> v").distinct(), "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.countDistinct("u")).first()
        if now == before or now[0] == now[2] and _is_star(edges):
            break
        before = now
    return edges.select(F.col("u").alias("key"), F.col("v").alias("component")).union(edges.select(F.col("v").alias("key"), F.col("v").alias("component")).distinct())


def _is_star(edges: DataFrame) -> bool:
    """No vertex is both a leaf and a centre."""
    return edges.join(edges.select(F.col("v").alias("u")).distinct(), "u", "left_semi").isEmpty()


def _possible(n1, pos1, n2, pos2) -> F.Column:
    """Whether the sizes, and the places of the first common column, leave room for the overlap that a link needs."""
    need = 3 * (n1 + n2)
    return (4 * F.least(n1, n2) >= 3 * F.greatest(n1, n2)) & (7 * F.least(n1 - pos1, n2 - pos2) >= need)


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", blocks: int = BLOCKS) -> DataFrame:
    """Per document: id, n_shingles (size of its set) and component_id (least id reachable by links of 0.75 or more).

    Texts are lower-cased in A-Z and cut into words; a set holds the distinct five-word shingles, or the whole
    sequence of a shorter text. Null and empty texts have an empty set and are alone. Repeated rows give repeated
    rows in one component. A null id is kept with its text's component, alone if the text is empty. An empty table
    gives an empty result; other columns are not read. Ids may be of any type that has an order. Shingles and sets are
    compared by 64-bit hashes.
    """
    rows = written(_grouped(docs, id_col, text_col, blocks), "groups")
    least = rows.filter("part is not null").groupBy("part").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("rows"))
    linked = join_uneven(rows.filter("part is not null"), written(least, "least-ids"), ["part"], "rows", rows.count())
    out = linked.select("doc_id", "n", "component_id").union(rows.filter("part is null").select("doc_id", "n", "doc_id"))
    return out.select(F.col("doc_id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")


def _grouped(docs: DataFrame, id_col: str, text_col: str, blocks: int = BLOCKS) -> DataFrame:
    """(doc_id, n, key, part) of each row: size and hash of its set, and a hash that the sets of its component share; null without words."""
    spark: SparkSession = docs.sparkSession
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    first = written(_sets_and_counts(texts, blocks), "shingle-counts")
    rows = first.filter("block is null").select("doc_id", "n", "key")
    full, empty = rows.filter("n > 0"), rows.filter("n = 0")
    hot = spark.sparkContext.broadcast(_frequent(first.filter("block is not null").select("block", "counts")))

    column = Window.partitionBy("token")
    postings = (
        _prefixes(texts, hot)
        .repartition("token")
        .groupBy("token", "key")
        .agg(F.first("n").alias("n"), F.first("pos").alias("pos"))
        .withColumn("pivot", F.min(F.struct("pos", "n", "key")).over(column))
        .withColumn("width", F.count("*").over(column))
        .filter("width > 1")
        .select("token", "key", "n", "pos", "pivot")
    )
    postings = written(postings, "postings")

    to_pivot = postings.filter((F.col("key") != F.col("pivot.key")) & _possible(F.col("n"), F.col("pos"), F.col("pivot.n"), F.col("pivot.pos")))
    tried = written(to_pivot.select(F.col("pivot.key").alias("a"), F.col("key").alias("b")).distinct(), "pivot-pairs")
    sets = written(_sets(texts, full, tried.select(F.col("a").alias("key")).union(tried.select("b")).distinct()), "sets")
    links = written(_linked(tried, sets), "links")
    parts = connected_components(links)

    placed = postings.join(parts, "key", "left").select("token", "key", "n", "pos", F.coalesce("component", "key").alias("part"))
    spread = placed.groupBy("token").agg(F.min("part").alias("low"), F.max("part").alias("high")).filter("low <> high").select("token")
    placed = written(placed.join(spread, "token", "left_semi"), "open-postings")
    classes = placed.groupBy("token", "n", "pos").agg(F.min("part").alias("low"), F.max("part").alias("high"))
    one, two = (classes.select("token", *(F.col(c).alias(f"{c}{i}") for c in ("n", "pos", "low", "high"))) for i in (1, 2))
    apart = (F.col("low1") != F.col("high1")) | (F.col("low2") != F.col("high2")) | (F.col("low1") != F.col("low2"))
    meet = one.join(two, "token").filter("(n1, pos1) <= (n2, pos2)").filter(apart & _possible(F.col("n1"), F.col("pos1"), F.col("n2"), F.col("pos2")))
    ends = [placed.select("token", F.col("n").alias(f"n{i}"), F.col("pos").alias(f"pos{i}"), F.col("key").alias(f"k{i}"), F.col("part").alias(f"part{i}")) for i in (1, 2)]
    across = meet.select("token", "n1", "pos1", "n2", "pos2").join(ends[0], ["token", "n1", "pos1"]).join(ends[1], ["token", "n2", "pos2"]).filter("part1 <> part2")
    rest = across.select(F.least("k1", "k2").alias("a"), F.greatest("k1", "k2").alias("b")).distinct().join(tried, ["a", "b"], "left_anti")
    rest = written(rest, "other-pairs")
    if not rest.isEmpty():
        keys = rest.select(F.col("a").alias("key")).union(rest.select("b")).distinct()
        more = sets.select("key", "shingles").union(_sets(texts, full, keys.join(sets, "key", "left_anti")))
        links = links.union(_linked(rest, more))
        parts = connected_components(links)

    sizes = full.groupBy("key").agg(F.count("*").alias("copies"))
    parts = sizes.join(parts, "key", "left").select("key", "copies", F.coalesce("component", "key").alias("part"))
    named = join_uneven(full, written(parts, "parts"), ["key"], "copies", full.count())
    return named.select("doc_id", "n", "key", "part").unionByName(empty.select("doc_id", "n", "key", F.lit(None).cast("long").alias("part")))
