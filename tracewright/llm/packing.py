"""Best-fit packing of token pieces into sequences by a grouping genetic algorithm on islands."""

from __future__ import annotations

import json
import random
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tracewright.llm.bpe import byte_alphabet
from tracewright.llm.shared import written

#: Pieces that one population packs. More pieces make more blocks, never larger ones.
BLOCK_ITEMS = 4096
ISLANDS, POPULATION, CHILDREN, EPOCHS = 2, 4, 6, 2
#: In each round sequences with at most so many unused tokens stay; the rest are dealt anew. The last keeps all.
SPARE_BY_ROUND = (0, 2, 8, None)

#: Children in a row that do not better an island's best, after which its epoch ends.
PATIENCE = 3
#: Displaced pieces whose pairs are tried in the place of a packed one, at most; all are tried alone and best-fitted.
PAIRED_ITEMS = 64

_ODD = re.compile("[\x1c-\x1f]")
_RUNS = re.compile(r"(\s+)")
#: Runs of more characters without a cut go to a merge that is not quadratic in them.
LONG_RUN = 10_000
#: Fixed value: how byte-level vocabularies of this kind cut text before merging.
_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class TextEncoder:
    """Ids of a byte-level vocabulary file: whole texts by the tiktoken core, those that it reads otherwise by the tokenizers library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte = {c: b for b, c in enumerate(byte_alphabet())}
        ranks = {bytes(byte[c] for c in t): i for t, i in spec["model"]["vocab"].items()}
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.whole = Tokenizer.from_file(path)
        self.core = tiktoken.Encoding("texts", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if _ODD.search(text) or any(s in text for s in self.special) or (len(text) > LONG_RUN and max(map(len, _RUNS.split(text))) > LONG_RUN):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        # "I" is 4 bytes wide, and the machines that Spark runs on are little-endian
        return array("I", self.core.encode_ordinary(text)).tobytes()


_encoders: dict[str, TextEncoder] = {}


def _encoder(path: str) -> TextEncoder:
    if path not in _encoders:
        _encoders[path] = TextEncoder(path)
    return _encoders[path]


def token_pieces(docs: DataFrame, vocabulary_path: str, capacity: int, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """item (unique), id, piece, start, length, ids_crc32 for each piece of each row. Null counts as empty."""
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, item = _encoder(vocabulary_path).encode, TaskContext.get().partitionId() << 40
        for batch in batches:
            rows, which = [], []
            for d, value in enumerate(batch.column(1)):
                ids = encode(value.as_py() or "") + end
                n = len(ids) // 4
                start, length = 0, (n - 1) % capacity + 1
                for piece in range(-(-n // capacity)):
                    rows.append((item, piece, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)])))
                    which.append(d)
                    item += 1
                    start, length = start + length, capacity
            cols = np.array(rows, np.int64).reshape(-1, 5).T
            yield pa.RecordBatch.from_arrays([pa.array(cols[0]), batch.column(0).take(pa.array(which, pa.int64())), pa.array(cols[1].astype(np.int32)), *(pa.array(c) for c in cols[2:])], ["item", id_col, "piece", "start", "length", "ids_crc32"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"item long, `{id_col}` {kind}, piece int, start long, length long, ids_crc32 long")


class Packing:
    """One individual: its bins, each a list of item numbers, and what each bin has left."""

    def __init__(self, bins: list[list[int]], left: list[int]):
        self.bins, self.left = bins, left

    def fitness(self, capacity: int) -> tuple[int, float]:
        """Fewer bins first, then fuller ones."""
        return -len(self.bins), sum((capacity - x) ** 2 for x in self.left) / max(1, len(self.bins))

    def place(self, items: list[int], size: list[int], capacity: int) -> None:
        """Best fit: each item goes to the open bin that it leaves least room in, else to a new one."""
        by_left: dict[int, list[int]] = {}
        mask = 0
        for b, x in enumerate(self.left):
            if x:
                by_left.setdefault(x, []).append(b)
                mask |= 1 << x
        for i in items:
            s = size[i]
            if fits := mask >> s:
                x = s + (fits & -fits).bit_length() - 1
                b = by_left[x].pop()
                if not by_left[x]:
                    mask ^= 1 << x
                self.bins[b].append(i)
            else:
                b, x = len(self.bins), capacity
                self.bins.append([i])
                self.left.append(0)
            x -= s
            self.left[b] = x
            if x:
                by_left.setdefault(x, []).append(b)
                mask |= 1 << x

    def exchange(self, items: list[int], size: np.ndarray, capacity: int) -> list[int]:
        """Displaced items, alone or two of them, take the place of an item whose bin they fill better; what is displaced then is returned."""
        while items:
            items = sorted(items, key=size.__getitem__)
            spots = [(b, i) for b, x in enumerate(self.left) if x for i in self.bins[b]]
            if not spots:
                break
            few = items[:: -(-len(items) // PAIRED_ITEMS)]
            u, v = np.triu_indices(len(few), 1)
            sums = size[few][u] + size[few][v]
            order = np.argsort(sums, kind="stable")
            # what goes in: a single item or a pair of them, by the tokens that it has
            new = [(i,) for i in items] + [(few[u[k]], few[v[k]]) for k in order]
            single, sums = size[items], sums[order]
            old = size[[i for _, i in spots]]
            room = old + np.array([self.left[b] for b, _ in spots])
            one, two = np.searchsorted(single, room, side="right") - 1, np.searchsorted(sums, room, side="right") - 1
            by_one = np.where(one >= 0, single[one], 0)
            by_two = np.where(two >= 0, sums[two], 0) if len(sums) else np.zeros_like(by_one)
            fill, choice = np.maximum(by_one, by_two), np.where(by_one >= by_two, one, two + len(items))
            better = np.flatnonzero(fill > old)
            better = better[np.lexsort((old[better] - fill[better], (room - fill)[better]))]
            used, touched, out = set(), set(), []
            for k in better.tolist():
                b, i = spots[k]
                if b not in touched and used.isdisjoint(new[choice[k]]):
                    used.update(new[choice[k]])
                    touched.add(b)
                    out.append(i)
                    self.bins[b].remove(i)
                    self.bins[b].extend(new[choice[k]])
                    self.left[b] = int(room[k] - fill[k])
            items = [i for i in items if i not in used] + out
            if not touched:
                break
        return items

    def without(self, drop: set[int]) -> Packing:
        keep = [b for b in range(len(self.bins)) if b not in drop]
        return Packing([list(self.bins[b]) for b in keep], [self.left[b] for b in keep])


def _largest_first(items, size: list[int], rng: random.Random, noise: float) -> list[int]:
    return sorted(items, key=(lambda i: (-size[i], i)) if not noise else lambda i: -size[i] * (1 + noise * rng.random()))


def crossover(one: Packing, two: Packing, size: list[int], capacity: int, rng: random.Random) -> Packing:
    """Whole well-filled bins of two enter one; bins of one with the same items go; what they held besides is best-fitted.

    Before that, displaced items take the place of items whose bins they fill better, so what is left to fit is small.
    """
    order = sorted(range(len(two.bins)), key=two.left.__getitem__)
    good = order[: max(1, len(order) // 2)]
    chosen = rng.sample(good, max(1, len(good) // 2))
    injected = {i for b in chosen for i in two.bins[b]}
    hit = {b for b, bin_ in enumerate(one.bins) if not injected.isdisjoint(bin_)}
    spare = [i for b in hit for i in one.bins[b] if i not in injected]
    # the emptiest bins are opened too, which is the mutation
    rest = sorted((b for b in range(len(one.bins)) if b not in hit and one.left[b]), key=lambda b: -one.left[b])[: 1 + len(one.bins) // 50]
    spare += [i for b in rest for i in one.bins[b]]
    child = one.without(hit | set(rest))
    child.bins += [list(two.bins[b]) for b in chosen]
    child.left += [two.left[b] for b in chosen]
    spare = child.exchange(spare, np.asarray(size), capacity)
    child.place(_largest_first(spare, size, rng, 0.0), size, capacity)
    return child


def evolve(population: list[Packing], size: list[int], capacity: int, rng: random.Random, children: int) -> list[Packing]:
    """Steady state: a child replaces the worst if it is better. It ends at the least possible number of bins, or without progress."""
    least, idle = -(-sum(size) // capacity), 0
    population.sort(key=lambda p: p.fitness(capacity), reverse=True)
    for _ in range(children):
        if len(population[0].bins) <= least or idle == PATIENCE:
            break
        a, b = rng.sample(range(len(population)), 2) if len(population) > 1 else (0, 0)
        child = crossover(population[min(a, b)], population[max(a, b)], size, capacity, rng)
        idle = 0 if child.fitness(capacity) > population[0].fitness(capacity) else idle + 1
        if child.fitness(capacity) > population[-1].fitness(capacity):
            population[-1] = child
            population.sort(key=lambda p: p.fitness(capacity), reverse=True)
    return population


def _frozen(p: Packing, n: int) -> bytes:
    out = np.zeros(n, "<i4")
    for b, items in enumerate(p.bins):
        out[items] = b
    return out.tobytes()


def _thawed(data: bytes, size: list[int], capacity: int) -> Packing:
    of = np.frombuffer(data, "<i4")
    order = np.argsort(of, kind="stable")
    bins = [x.tolist() for x in np.split(order, np.flatnonzero(np.diff(of[order])) + 1)]
    return Packing(bins, [capacity - sum(size[i] for i in b) for b in bins])


def _pack_round(items: DataFrame, capacity: int, blocks: int, seed: int) -> DataFrame:
    """item, sequence, offset and spare for items (item, length), each block packed by its own islands.

    A sequence's number is below 0 and made of its block, bin and round (seed), so no two are equal.
    """
    dealt = items.select("item", F.col("length").cast("int").alias("length"), F.pmod(F.xxhash64("item", F.lit(seed)), F.lit(blocks)).cast("int").alias("block"))
    dealt = dealt.withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))))
    # an island is small and takes long, so its tasks don't follow the size of what is shuffled
    spark = items.sparkSession
    tasks = min(blocks * ISLANDS, max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))

    def settle(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("item")
        size = rows["length"].tolist()
        rng = random.Random(f"{seed} {key}")
        population = []
        for k in range(POPULATION):
            p = Packing([], [])
            p.place(_largest_first(range(len(size)), size, rng, 0.0 if k == 0 and key[1] == 0 else 0.02 * (k + 1)), size, capacity)
            population.append(p)
        population = evolve(population, size, capacity, rng, CHILDREN)
        return pd.DataFrame({"block": [key[0]], "island": [key[1]], "items": [rows["item"].to_numpy()], "sizes": [rows["length"].to_numpy()], "people": [[_frozen(p, len(size)) for p in population]]})

    schema = "block int, island int, items array<long>, sizes array<int>, people array<binary>"
    state = written(dealt.repartition(tasks, "block", "island").groupBy("block", "island").applyInPandas(settle, schema), "islands")
    for epoch in range(1, EPOCHS):
        # the best of each island goes to the next one; each island is a row and evolves in a task of its own
        elite = state.select("block", F.pmod(F.col("island") + 1, F.lit(ISLANDS)).cast("int").alias("island"), F.col("people")[0].alias("elite"))

        def migrate(parts: Iterator[pd.DataFrame], epoch: int = epoch) -> Iterator[pd.DataFrame]:
            for rows in parts:
                people = []
                for row in rows.itertuples():
                    size = row.sizes.tolist()
                    population = [_thawed(p, size, capacity) for p in [*row.people[:-1], row.elite]]
                    population = evolve(population, size, capacity, random.Random(f"{seed} {epoch} {row.block} {row.island}"), CHILDREN)
                    people.append([_frozen(p, len(size)) for p in population])
                yield rows.drop(columns="elite").assign(people=people)

        moved = state.join(elite, ["block", "island"]).select("block", "island", "items", "sizes", "people", "elite").repartition(tasks, "block", "island")
        state = written(moved.mapInPandas(migrate, schema), "islands") if epoch + 1 < EPOCHS else moved.mapInPandas(migrate, schema)

    def best(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        size = rows["sizes"].iloc[0].tolist()
        p = max((_thawed(people[0], size, capacity) for people in rows["people"]), key=lambda p: p.fitness(capacity))
        ids, out = rows["items"].iloc[0], []
        for b, bin_ in enumerate(p.bins):
            at = 0
            for i in bin_:
                out.append((ids[i], -1 - (((key[0] << 20 | b) << 3) | seed), at, p.left[b]))
                at += size[i]
        return pd.DataFrame(out, columns=["item", "sequence", "offset", "spare"])

    return state.groupBy("block").applyInPandas(best, "item long, sequence long, offset long, spare long")


def pack(pieces: DataFrame, capacity: int) -> DataFrame:
    """item, sequence_id and offset for pieces (item, length) with lengths from 1 to capacity; a full piece's sequence has its number."""
    full = pieces.filter(F.col("length") == capacity).select("item", F.col("item").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    left = pieces.filter(F.col("length") < capacity).select("item", "length")
    done = []
    for k, spare in enumerate(SPARE_BY_ROUND):
        n = left.count()
        if not n:
            break
        last = spare is None or n <= BLOCK_ITEMS
        packed = written(_pack_round(left, capacity, -(-n // BLOCK_ITEMS), k), f"packed-{k}")
        keep = packed if last else packed.filter(F.col("spare") <= spare)
        done.append(keep.select("item", F.col("sequence").alias("sequence_id"), "offset"))
        if last:
            break
        left = left.join(packed.filter(F.col("spare") > spare).select("item"), "item", "left_semi")
    for more in done:
        full = full.union(more)
    return full


def packed_documents(docs: DataFrame, vocabulary_path: str, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document's pieces with their place in a sequence.

    Returns id, piece, start, length, ids_crc32, sequence_id, offset. A document is its ids and end_id; only one of
    more than capacity ids is cut, the first piece then being the short one. Null and empty texts are one piece of
    length 1. Repeated rows are packed once each. Null ids stay null; no rows give no rows; other columns are not read.
    """
    pieces = written(token_pieces(docs, vocabulary_path, capacity, end_id, id_col, text_col), "pieces")
    placed = pieces.join(pack(pieces, capacity), "item")
    return placed.select(id_col, "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
