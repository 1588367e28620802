"""Chroma audio fingerprints: filters over pitch-class frames, packed into integers, and alignment of recordings.

A recording is a column of 16-bit PCM bytes. Frames give the energy of the twelve pitch classes; the integral image of
frames by classes makes each filter, a difference of rectangle sums, a few look-ups; two bits of each filter's
quantised value are packed into one 32-bit integer a step.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm.shared import written

RATE, FRAME, HOP = 4000, 512, 256
#: Filters (kind, first class, classes, frames). Kinds: 0 sum, 1 lower and upper classes, 2 earlier and
#: later frames, 3 both, 4 middle classes and the others, 5 middle frames and the others.
FILTERS = (
    (0, 4, 3, 15), (4, 4, 6, 15), (1, 0, 4, 16), (3, 8, 2, 12), (3, 4, 4, 8), (4, 0, 3, 5), (1, 2, 2, 9), (2, 7, 3, 4),
    (2, 6, 2, 16), (2, 1, 3, 2), (5, 10, 1, 15), (3, 6, 2, 10), (2, 1, 1, 14), (3, 5, 6, 4), (1, 9, 2, 12), (3, 4, 2, 14),
)
WIDTH = 16
#: Values of each filter where its two bits change, in grey code: fixed, so that an excerpt has the codes of the whole.
#: They are the quartiles of the filters over the recordings of `embeddings` at sf0.1; those of 0
#: are moved a little, since held notes give 0 up to rounding.
CUTS = (
    (1.451, 1.812, 2.103), (-1.369, -0.639, -0.105), (-0.728, -0.096, 0.489), (-0.441, 0.001, 0.456),
    (-0.575, 0.003, 0.586), (-0.921, -0.202, -0.019), (-0.641, -0.03, 0.43), (-0.302, 0.001, 0.303),
    (-0.551, 0.001, 0.558), (-0.07, 0.001, 0.081), (-0.813, -0.197, 0.006), (-0.36, 0.001, 0.374),
    (-0.363, 0.001, 0.364), (-0.449, 0.001, 0.468), (-0.516, 0.046, 0.842), (-0.5, 0.001, 0.489),
)
#: A match: bits in error of the aligned integers, at most, and the least overlap of the shorter recording.
MAX_BIT_ERROR, LEAST_OVERLAP = 0.15, 0.5
#: Fingerprints and integers in a block, about, at most; a longer fingerprint is a block of its own.
BLOCK_ROWS, BLOCK_CODES = 256, 1 << 18
#: Agreements of pairs at all offsets that are held at once, about; recordings of each side whose pairs are screened at once.
CACHED_VALUES, SCREENED = 1 << 19, 256
#: Transforms up to this size are products with a matrix of waves.
PRODUCT_SIZE = 512
#: Bytes of spectra of queries that a task keeps, and queries that it is given, about.
KEPT_BYTES, TASK_QUERIES = 96 << 20, 4096
#: Samples of recordings of one length that are fingerprinted together, about, and frames that are transformed at once.
TOGETHER, CACHED_FRAMES = 1 << 18, 64
#: Recordings that vectors_as_audio hands on at once.
PLAYED_ROWS = 64


@cache
def _pitches() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The window of a frame, its frequencies in order of pitch class, where each class begins, and the classes that occur."""
    f = np.fft.rfftfreq(FRAME, 1 / RATE)
    ok = np.flatnonzero((f >= 55) & (f <= RATE / 2))
    pitch = np.round(12 * np.log2(f[ok] / 440)).astype(int) % 12
    order = np.argsort(pitch, kind="stable")
    classes, begins = np.unique(pitch[order], return_index=True)
    return np.hanning(FRAME), ok[order], begins, classes


def chroma(samples: np.ndarray) -> np.ndarray:
    """(..., frame, 12): energy of the twelve pitch classes in each frame, each frame's largest scaled to 1."""
    n = max(0, (samples.shape[-1] - FRAME) // HOP + 1)
    out = np.zeros((*samples.shape[:-1], n, 12))
    if not n:
        return out
    window, order, begins, classes = _pitches()
    # a few frames at once, which stay in a core's cache
    for sound, energies in zip(samples.reshape(-1, samples.shape[-1]), out.reshape(-1, n, 12)):
        frames = np.lib.stride_tricks.sliding_window_view(sound, FRAME)[::HOP]
        for k in range(0, n, CACHED_FRAMES):
            waves = np.fft.rfft(frames[k : k + CACHED_FRAMES] * window, axis=1)
            power = waves.real**2
            power += waves.imag**2
            energies[k : k + CACHED_FRAMES, classes] = np.add.reduceat(power.take(order, axis=1), begins, axis=1)
    return out / np.maximum(out.max(axis=-1, keepdims=True), 1e-9)


def filter_values(samples: np.ndarray) -> np.ndarray:
    """(filter, ..., step) for each step of a window of WIDTH frames; no step for a recording that is too short."""
    sums = np.cumsum(np.cumsum(chroma(samples), axis=-2), axis=-1)
    image = np.zeros((*sums.shape[:-2], sums.shape[-2] + 1, 13))
    image[..., 1:, 1:] = sums
    n = image.shape[-2] - WIDTH
    if n < 1:
        return np.zeros((len(FILTERS), *samples.shape[:-1], 0))
    image = np.ascontiguousarray(np.moveaxis(image, -1, 0))

    def area(t0, t1, c0, c1):
        return image[c1, ..., t1 : t1 + n] - image[c1, ..., t0 : t0 + n] - image[c0, ..., t1 : t1 + n] + image[c0, ..., t0 : t0 + n]

    out = np.zeros((len(FILTERS), *samples.shape[:-1], n))
    for k, (kind, c, h, w) in enumerate(FILTERS):
        h = min(h, 12 - c)
        whole = area(0, w, c, c + h)
        if kind == 0:
            a, b = whole, 0.0
        elif kind == 1:
            b = area(0, w, c, c + max(h // 2, 1))
            a = whole - b
        elif kind == 2:
            b = area(0, w // 2, c, c + h)
            a = whole - b
        elif kind == 3:
            a = area(0, w // 2, c, c + h // 2) + area(w // 2, w, c + h // 2, c + h)
            b = whole - a
        elif kind == 4:
            a = area(0, w, c + h // 3, c + max(2 * h // 3, h // 3 + 1))
            b = whole - a
        else:
            a = area(w // 3, max(2 * w // 3, w // 3 + 1), c, c + h)
            b = whole - a
        out[k] = np.log1p(a) - np.log1p(b)
    return out


def fingerprint(samples: np.ndarray) -> np.ndarray:
    """Packed integers, one for each step, of one recording or of several that are as long. A step's integer depends on
    the samples of its window only."""
    values = filter_values(samples)
    out = np.zeros(values.shape[1:], np.uint32)
    for value, cuts in zip(values, CUTS):
        level = np.searchsorted(cuts, value, side="right").astype(np.uint32)
        out = (out << np.uint32(2)) | (level ^ (level >> np.uint32(1)))
    return out


def fingerprints(recordings: DataFrame, id_col: str, pcm_col: str) -> DataFrame:
    """id and codes (array<long>) of each recording; null or short audio has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes: list = [[]] * batch.num_rows
            sounds = {k: np.frombuffer(v.as_buffer(), "<i2") for k, v in enumerate(batch.column(1)) if v.is_valid}
            order = sorted(sounds, key=lambda k: len(sounds[k]))
            while order:
                # some of one length at once
                length = len(sounds[order[0]])
                many = sum(len(sounds[k]) == length for k in order[: max(1, TOGETHER // max(length, 1))])
                for k, c in zip(order[:many], fingerprint(np.stack([sounds[k] for k in order[:many]]).astype(float))):
                    codes[k] = c
                order = order[many:]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([np.asarray(c, np.int64) for c in codes], pa.list_(pa.int64()))], [id_col, "codes"])

    kind = recordings.schema[id_col].dataType.simpleString()
    whole = F.substring(F.col(pcm_col), F.lit(1), (F.octet_length(pcm_col) / 2).cast("int") * 2)
    return recordings.select(id_col, whole.alias("pcm")).mapInArrow(run, f"`{id_col}` {kind}, codes array<long>")


def _smooth(n: int) -> int:
    """The least number from n on with no prime factor above 7."""
    while True:
        m = n
        for p in (2, 3, 5, 7):
            while m % p == 0:
                m //= p
        if m == 1:
            return n
        n += 1


def _spectra(codes: list[np.ndarray], size: int) -> np.ndarray:
    """(frequency, recording, 64): transforms of the bits as -1 and 1, 0 beyond the end; real parts, then imaginary ones."""
    longest = max(len(c) for c in codes)
    bits = np.zeros((len(codes), 32, longest), np.float32)
    for row, c in zip(bits, codes):
        row[:, : len(c)] = (np.unpackbits(c.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1) * np.float32(2) - 1).T
    out = np.empty((size // 2 + 1, len(codes), 64), np.float32)
    if size <= PRODUCT_SIZE:
        turns = np.arange(longest)[:, None] * np.arange(size // 2 + 1) % size * (2 * np.pi / size)
        for part, wave in enumerate((np.cos(turns), -np.sin(turns))):
            for r0 in range(0, len(codes), 64):
                out[:, r0 : r0 + 64, 32 * part : 32 * part + 32] = (bits[r0 : r0 + 64] @ wave.astype(np.float32)).transpose(2, 0, 1)
    else:
        for r0 in range(0, len(codes), 16):
            waves = np.fft.rfft(bits[r0 : r0 + 16], size, axis=2).transpose(2, 0, 1)
            out[:, r0 : r0 + 16, :32], out[:, r0 : r0 + 16, 32:] = waves.real, waves.imag
    return out


def _crossing(spectra: np.ndarray) -> np.ndarray:
    """(frequency, 2, 64, recording): with it a product of other _spectra gives real and imaginary parts of correlations."""
    turned = np.concatenate([spectra[..., 32:], -spectra[..., :32]], axis=-1)
    return np.ascontiguousarray(np.stack([spectra, turned], axis=1).transpose(0, 1, 3, 2))


def _highest(left: np.ndarray, right: np.ndarray, size: int) -> np.ndarray:
    """(left, right): a number that the bits that agree less those that differ reach at no offset, but for rounding.

    A correlation is at no place more than the sum of the magnitudes of its frequencies.
    """
    shape = left.shape[1], right.shape[3]
    out, parts = np.zeros(shape, np.float32), np.empty((2, *shape), np.float32)
    for f, (x, y) in enumerate(zip(left, right)):
        np.matmul(x * np.float32((1 if f == 0 or 2 * f == size else 2) / size), y, out=parts)
        np.multiply(parts, parts, out=parts)
        magnitude = np.add(parts[0], parts[1], out=parts[0])
        out += np.sqrt(magnitude, out=magnitude)
    return out


def alignment_size(left: list[np.ndarray], right: list[np.ndarray], least_overlap: float) -> tuple[int, int]:
    """The least overlap of any pair and the size of transforms in which no two offsets with that overlap meet."""
    sizes = [np.array([len(c) for c in x]) for x in (left, right)]
    least = max(1, int(np.ceil(least_overlap * min(sizes[0].min(), sizes[1].min()) - 1e-9)))
    return least, _smooth(int(sizes[0].max() + sizes[1].max() - least))


def best_offsets(left: list[np.ndarray], right: list[np.ndarray], max_bit_error: float, least_overlap: float, spectra: tuple[np.ndarray, np.ndarray] | None = None) -> Iterator[tuple[int, int, int, int, int, float]]:
    """(i, j, offset, matches, overlap, bit_error) of each pair that aligns, over all offsets with enough overlap.

    The bits that agree at every offset are one correlation; what comes near the limit is compared bit by bit. Pairs whose
    magnitudes cannot sum up to the limit at any offset are left out before, so the result is that of all pairs. spectra
    are _spectra of left and _crossing of right for alignment_size, if the caller has them.
    """
    m_all, n_all = (np.array([len(c) for c in x]) for x in (left, right))
    least, size = alignment_size(left, right, least_overlap)
    of_left, of_right = spectra or (_spectra(left, size), _crossing(_spectra(right, size)))
    place = np.arange(size)
    offset = np.where(place <= n_all.max() - least, place, place - size)
    per_code = 32 * (1 - 2 * max_bit_error) - 1e-3
    # some pairs at once: as many agreements as a core's cache holds
    pairs, rows = max(1, CACHED_VALUES // size), max(1, int((CACHED_VALUES // size) ** 0.5))
    screen = True
    for r0 in range(0, len(right), SCREENED):
        for q0 in range(0, len(left), SCREENED):
            x, y = of_left[:, q0 : q0 + SCREENED], of_right[..., r0 : r0 + SCREENED]
            q, r = x.shape[1], y.shape[3]
            if screen:
                shorter = np.minimum(m_all[q0 : q0 + q, None], n_all[None, r0 : r0 + r])
                # a margin of 2 for rounding, which is 0.01 or so for a correlation of some thousand
                some = np.argwhere(_highest(x, y, size) >= np.maximum(1, np.ceil(least_overlap * shorter - 1e-9)) * per_code * (1 - 1e-5) - 2)
                screen = len(some) <= q * r / 2
            if screen and len(some) <= q * r / 8:
                parts = (some[k : k + pairs].T for k in range(0, len(some), pairs))
                batches = ((i, j, np.einsum("fpk,fckp->cfp", x[:, i], y[..., j])) for i, j in parts)
            else:
                blocks = (np.mgrid[i : min(i + rows, q), j : min(j + rows, r)] for i in range(0, q, rows) for j in range(0, r, rows))
                batches = ((i.ravel(), j.ravel(), (x[:, None, i[:, 0]] @ y[..., j[0]]).transpose(1, 0, 2, 3).reshape(2, len(x), -1)) for i, j in blocks)
            for i_all, j_all, product in batches:
                agree = np.fft.irfft((product[0] + 1j * product[1]).T, size, axis=1)
                m, n = m_all[q0 + i_all][:, None], n_all[r0 + j_all][:, None]
                m, n = m[:1] if (m == m[0]).all() else m, n[:1] if (n == n[0]).all() else n
                overlap = np.minimum(m, n - offset) - np.maximum(0, -offset)
                limit = np.where((overlap >= 1) & (overlap >= least_overlap * np.minimum(m, n)), overlap * per_code - 1, np.inf)
                found: dict[tuple[int, int], tuple] = {}
                for p, k in zip(*np.unravel_index(np.flatnonzero(agree >= limit.astype(np.float32)), agree.shape)):
                    key = (q0 + int(i_all[p]), r0 + int(j_all[p]))
                    d, a, b = int(offset[k]), left[key[0]], right[key[1]]
                    start = max(0, -d)
                    n_both = min(len(a), len(b) - d) - start
                    differs = a[start : start + n_both] ^ b[start + d : start + d + n_both]
                    error = int(np.bitwise_count(differs).sum()) / (32 * n_both)
                    if error <= max_bit_error:
                        found[key] = min(found.get(key, (2.0,)), (error, -n_both, d, int((differs == 0).sum())))
                for (i, j), (error, n_both, d, matches) in found.items():
                    yield i, j, d, matches, -n_both, error


def _blocks(prints: DataFrame, id_col: str, name: str, tasks: int) -> DataFrame:
    """Rows of up to some BLOCK_ROWS fingerprints of like length, fewer where they are long, dealt to so many tasks."""
    kind = F.floor(F.log2(F.size("codes"))).cast("int")
    rows = prints.filter(F.size("codes") > 0).select(id_col, F.transform("codes", lambda c: c.cast("long")).alias("codes"), kind.alias("kind"))
    most = F.greatest(F.lit(1.0), F.least(F.lit(float(BLOCK_ROWS)), BLOCK_CODES / F.pow(F.lit(2.0), F.col("kind") + 1)))
    counts = rows.groupBy("kind").agg(F.ceil(F.count("*") / F.first(most)).alias("n"))
    parted = rows.join(F.broadcast(counts), "kind").withColumn("block", F.pmod(F.xxhash64(id_col), F.col("n")))
    # the number of tasks is given, since their work is not in the bytes that they read
    grouped = parted.repartition(tasks, "kind", "block").groupBy("kind", "block")
    return grouped.agg(F.collect_list(F.struct(F.col(id_col).alias("id"), "codes")).alias(name)).select(name, F.concat_ws(",", "kind", "block").alias(f"{name}_key")).coalesce(tasks)


def align(prints: DataFrame, id_col: str, query_step: int = 20, max_bit_error: float = MAX_BIT_ERROR, least_overlap: float = LEAST_OVERLAP) -> DataFrame:
    """Pairs of different fingerprints that align, (query, match, offset, matches, overlap, bit_error).

    Queries are the rows with is_query, against all rows. All offsets whose overlap is at least least_overlap of the shorter
    fingerprint are compared; the one with the least bit error counts, on ties the longest overlap, then the least offset.
    matches are the equal integers there. The limit of bit errors allows pairs without one equal integer, so no index can
    leave pairs out: the work is the product of queries and rows, in blocks.
    """
    kind = prints.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a task meets each block of rows with its blocks of queries one after the other
        kept: dict[tuple, np.ndarray] = {}
        last = crossing = None
        for batch in batches:
            for row in range(batch.num_rows):
                sides = []
                for column in (batch.column(0), batch.column(1)):
                    items = column.slice(row, 1).flatten()
                    ids, lists = items.field(0), items.field(1)
                    sides.append((ids, np.split(lists.flatten().to_numpy().astype(np.uint32), np.cumsum(pc.list_value_length(lists).to_numpy())[:-1])))
                (q, left), (r, right) = sides
                q, r = q.to_pylist(), r.to_pylist()
                size = alignment_size(left, right, least_overlap)[1]
                key, now = (batch.column(2)[row].as_py(), size), (batch.column(3)[row].as_py(), size)
                if now != last:
                    last, crossing = now, _crossing(_spectra(right, size))
                spectra = kept.get(key)
                if spectra is None:
                    spectra = _spectra(left, size)
                    if sum(s.nbytes for s in kept.values()) + spectra.nbytes <= KEPT_BYTES:
                        kept[key] = spectra
                found = [(q[i], r[j], *rest) for i, j, *rest in best_offsets(left, right, max_bit_error, least_overlap, (spectra, crossing)) if q[i] != r[j]]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), (items.field(0).type, items.field(0).type, pa.int32(), pa.int64(), pa.int32(), pa.float64()))], ["query", "match", "offset", "matches", "overlap", "bit_error"])

    # a task for each pair of partitions: their number follows the cores and the queries, not the shuffle's setting
    cores = prints.sparkSession.sparkContext.defaultParallelism
    queries = prints.filter("is_query")
    parts = max(1, -(-queries.count() // TASK_QUERIES))
    right, left = _blocks(prints, id_col, "right", 8 * cores), _blocks(queries, id_col, "left", parts)
    tiles = right.crossJoin(left).select("left", "right", "left_key", "right_key")
    return tiles.mapInArrow(run, f"query {kind}, match {kind}, offset int, matches long, overlap int, bit_error double")


def match_recordings(recordings: DataFrame, id_col: str, pcm_col: str, query_step: int = 20) -> DataFrame:
    """A row for each recording: id, n_codes, codes_md5, class_id, and, for queries, n_matches and best_match.

    class_id is the least id with the same codes. n_matches counts the recordings outside of the class that align with
    it, best_match is the class with the least bit error, then the least id; both are null where the id is no multiple
    of query_step. Null, empty and too short audio has no codes, is its own class and matches nothing. Null ids keep
    their class and are no queries; repeated rows repeat; no rows give no rows; other columns are not read.
    """
    prints = written(fingerprints(recordings, id_col, pcm_col).withColumn("hash", F.md5(F.concat_ws(",", F.transform("codes", lambda c: c.cast("string"))).cast("binary"))), "fingerprints")
    some = prints.filter(F.size("codes") > 0)
    query = F.coalesce(F.col(id_col) % query_step == 0, F.lit(False))
    classes = some.groupBy("hash").agg(F.min(id_col).alias("class_id"), F.count("*").alias("members"), F.max(query).alias("is_query"), F.first("codes").alias("codes"))
    classes = written(classes.filter("class_id is not null"), "classes")
    links = written(align(classes.select(F.col("class_id").alias("id"), "codes", "is_query"), "id", query_step), "alignments")
    sized = links.join(classes.select(F.col("class_id").alias("match"), "members"), "match")
    found = sized.groupBy(F.col("query").alias("class_id")).agg(F.sum("members").alias("n_matches"), F.min(F.struct(F.round("bit_error", 9), "match")).alias("best"))
    rows = prints.select(id_col, "hash", F.size("codes").alias("n_codes"))
    named = classes.select("hash", "class_id").join(found, "class_id", "left").select("hash", "class_id", "n_matches", F.col("best.match").alias("best_match"))
    out = rows.join(named, "hash", "left").withColumn("q", query)
    return out.select(
        id_col, "n_codes", F.col("hash").alias("codes_md5"), F.coalesce("class_id", id_col).alias("class_id"),
        F.when(F.col("q"), F.coalesce("n_matches", F.lit(0))).alias("n_matches"), F.when(F.col("q"), F.col("best_match")).alias("best_match"),
    )


def vectors_as_audio(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """pcm: each vector played as notes, one a value: its place picks the octave's base and its size the pitch class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = np.arange(FRAME) / RATE
        tones = (8000 * np.stack([np.sin(2 * np.pi * 220 * 2 ** (k / 12) * t) for k in range(24)])).astype("<i2")
        for whole in batches:
            # a recording has many times the bytes of its vector, so few are handed on at once
            for batch in (whole.slice(k, PLAYED_ROWS) for k in range(0, whole.num_rows, PLAYED_ROWS)):
                out = []
                for v in batch.column(1):
                    x = np.array(v.as_py() or [], float)
                    x = np.nan_to_num(x)
                    scale = np.abs(x).max() if len(x) else 0
                    note = np.floor(12 + 11.99 * x / scale).astype(int).clip(0, 23) if scale else np.zeros(len(x), int)
                    out.append(tones[note].tobytes())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], [id_col, "pcm"])

    kind = vectors.schema[id_col].dataType.simpleString()
    return vectors.select(id_col, vector_col).mapInArrow(run, f"`{id_col}` {kind}, pcm binary")
