"""BPE encoding and decoding by a contiguous rank array, for word-end vocabularies."""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Pre-tokens and words that a Python worker remembers in each of two generations.
MEMORY_PIECES, MEMORY_CHUNKS = 500_000, 150_000
#: Words of more parts are merged with a heap instead of repeated scans (the same result, without quadratic time).
SHORT_WORD = 256
_NO_RANK = 1 << 60


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in plain}
    for b in range(256):
        if b not in out:
            out[b] = chr(256 + len(out) - len(plain))
    return [out[b] for b in range(256)]


class RankArrayBPE:
    """A vocabulary file of kind BPE with byte-level characters and an end-of-word suffix."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"] or ""
        self.rank = {tuple(m.split(" ")) if isinstance(m, str) else tuple(m): i for i, m in enumerate(model["merges"])}
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = special
        self.special_pattern = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None
        self.lowers = any(n["type"] == "Lowercase" for n in spec["normalizer"]["normalizers"])
        self.pattern = regex.compile(next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"))
        self.alphabet = byte_alphabet()
        self.token = [""] * (1 + max([*self.vocab.values(), *special.values()]))
        for t, i in [*self.vocab.items(), *special.items()]:
            self.token[i] = t
        self._pieces = _Memory(self._encode_piece, MEMORY_PIECES)
        self._chunks = _Memory(self._encode_chunk, MEMORY_CHUNKS)

    def merge(self, parts: list[str]) -> list[str]:
        """Contiguous parts and, beside them, the rank of each part with its right neighbour; always the first lowest rank is joined."""
        if len(parts) > SHORT_WORD:
            return self._merge_long(parts)
        rank = self.rank.get
        ranks = [rank(pair, _NO_RANK) for pair in zip(parts, parts[1:])]
        while ranks and (low := min(ranks)) < _NO_RANK:
            i = ranks.index(low)
            parts[i] += parts.pop(i + 1)
            del ranks[i]
            if i < len(ranks):
                ranks[i] = rank((parts[i], parts[i + 1]), _NO_RANK)
            if i:
                ranks[i - 1] = rank((parts[i - 1], parts[i]), _NO_RANK)
        return parts

    def _merge_long(self, parts: list[str]) -> list[str]:
        n, rank = len(parts), self.rank.get
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(r, i, a, b) for i, (a, b) in enumerate(zip(parts, parts[1:])) if (r := rank((a, b))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i] if alive[i] else n
            if j >= n or parts[i] != a or parts[j] != b:
                continue
            parts[i], alive[j], after[i] = a + b, False, after[j]
            if after[j] < n:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (r := rank((parts[x], parts[y]))) is not None:
                    heapq.heappush(heap, (r, x, parts[x], parts[y]))
        return [p for p, ok in zip(parts, alive) if ok]

    def _encode_piece(self, piece: str) -> bytes:
        parts = [self.alphabet[b] for b in piece.encode()]
        parts[-1] += self.suffix
        return np.array([self.vocab[p] for p in self.merge(parts)], "<u4").tobytes()

    def _encode_chunk(self, chunk: str) -> bytes:
        text = unicodedata.normalize("NFC", chunk)
        if self.lowers:  # character by character: str.lower() looks at neighbours
            text = text.lower() if text.isascii() else "".join(c.lower() for c in text)
        return b"".join(map(self._pieces.get, self.pattern.findall(text)))

    def _encode_plain(self, text: str) -> bytes:
        chunks = regex.split(r"\p{White_Space}+", text) if _ODD_SPACE.search(text) else text.split()
        return b"".join(map(self._chunks.get, chunks))

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if self.special_pattern and any(s in text for s in self.special):
            return b"".join(np.array([self.special[t]], "<u4").tobytes() if t in self.special else self._encode_plain(t) for t in self.special_pattern.split(text))
        return self._encode_plain(text)

    def decode(self, ids: bytes) -> str:
        """Tokens with blanks between them, as a file without a decoder asks for."""
        return " ".join(map(self.token.__getitem__, np.frombuffer(ids, "<u4").tolist()))


#: White space for str.split() but not for the vocabulary's pattern.
_ODD_SPACE = re.compile("[\x1c-\x1f]")


class _Memory(dict):
    """What a function gave for recent keys; when full, the older generation goes."""

    def __init__(self, make, size: int):
        super().__init__()
        self.make, self.size, self.older, self.get = make, size, {}, self.__getitem__

    def __missing__(self, key):
        if (value := self.older.get(key)) is None:
            value = self.make(key)
        if len(key) <= 64:
            if len(self) >= self.size:
                self.older = dict(self)
                self.clear()
            self[key] = value
        return value


_loaded: dict[str, RankArrayBPE] = {}


def vocabulary(path: str) -> RankArrayBPE:
    """One vocabulary for each Python worker and file."""
    if path not in _loaded:
        _loaded[path] = RankArrayBPE(path)
    return _loaded[path]


def encode_decode(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """Encode every whole text and decode its ids again; one narrow pass, no shuffle.

    Returns id_col, n_tokens, ids_sha256 and decoded_sha256, and with_text also ids (array<int>) and decoded. Null
    and empty texts have no ids and an empty decoding; a null id stays null; repeated rows give repeated rows; other
    columns of docs are not read. An empty table gives an empty result.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if with_text else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, sha = vocabulary(vocabulary_path), lambda b: hashlib.sha256(b).hexdigest()
        for batch in batches:
            n, a, b, ids, texts = [], [], [], [], []
            for value in batch.column(1):
                coded = bpe.encode(value.as_py() or "")
                plain = bpe.decode(coded)
                n.append(len(coded) // 4)
                a.append(sha(coded))
                b.append(sha(plain.encode()))
                if with_text:
                    ids.append(np.frombuffer(coded, "<i4"))
                    texts.append(plain)
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())]
            names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_text:
                columns += [pa.array(ids, pa.list_(pa.int32())), pa.array(texts, pa.string())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select(id_col, text_col).mapInArrow(run, schema)
