"""Quality rules on repetition: word suffix arrays of whole texts, maximal repeats and the span they cover."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tracewright.llm.shared import Words, combine, text_slices

#: Repeats of fewer words are not counted as covered.
MIN_REPEAT_WORDS = 6
#: A text is rejected when its repeats cover more than this share of its words,
MAX_COVERED = 0.3
#: or when one repeat is longer than this many words.
MAX_LONGEST = 60

#: Texts of more words are handled without the tables of the suffix array's rounds: slower, in a few arrays of their length.
BIG = 1 << 20

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True


def longest_repeats(key: np.ndarray, doc_end: np.ndarray, big: int = BIG) -> np.ndarray:
    """For each word position, the length of the longest run from there that occurs elsewhere in its text.

    key: a hash of (text, word); doc_end: the first position after the text. The suffix array comes from prefix
    doubling that sorts only suffixes that still tie. The longest common prefixes of neighbours come from the rank
    tables of the rounds or, for more than big words, from one pass that needs no tables. They delimit the intervals
    of the maximal repeats: a place's longest repeat is the larger one of its two neighbours in the suffix array.
    """
    n, small = len(key), len(key) <= big
    if not n:
        return np.zeros(0, np.int64)
    suffix = np.argsort(key, kind="stable")
    ordered = key[suffix]
    fresh = np.r_[True, ordered[1:] != ordered[:-1]]
    begin = np.flatnonzero(fresh)
    group = np.cumsum(fresh) - 1
    rank = np.empty(n, np.int64)
    rank[suffix] = begin[group]
    tied = np.diff(np.r_[begin, n])[group] > 1
    active, tables, step = suffix[tied], [rank], 1
    first = rank
    while len(active):
        after = active + step
        second = np.where(after < doc_end[active], rank[np.minimum(after, n - 1)] + 1, 0)
        both = rank[active] * (n + 1) + second
        o = np.argsort(both, kind="stable")
        active, both = active[o], both[o]
        base = rank[active]
        at = np.arange(len(active))
        fresh = np.r_[True, base[1:] != base[:-1]]
        slot = base + at - np.maximum.accumulate(np.where(fresh, at, 0))
        suffix[slot] = active
        fresh = np.r_[True, both[1:] != both[:-1]]
        begin = np.flatnonzero(fresh)
        group = np.cumsum(fresh) - 1
        if small:
            rank = rank.copy()
            tables.append(rank)
        rank[active] = slot[begin][group]
        active = active[np.diff(np.r_[begin, len(active)])[group] > 1]
        step *= 2
    out = np.zeros(n, np.int64)
    if not small:
        common = _common_prefixes(suffix, key, doc_end)
        np.maximum.at(out, suffix[1:], common)
        np.maximum.at(out, suffix[:-1], common)
        return out
    pair = np.flatnonzero(first[suffix[1:]] == first[suffix[:-1]])
    i, j = suffix[pair], suffix[pair + 1]
    common = np.zeros(len(pair), np.int64)
    for level in range(len(tables) - 1, -1, -1):
        x, y = i + common, j + common
        inside = (x < doc_end[i]) & (y < doc_end[j])
        same = inside & (tables[level][np.minimum(x, n - 1)] == tables[level][np.minimum(y, n - 1)])
        common[same] += 1 << level
    np.maximum.at(out, i, common)
    np.maximum.at(out, j, common)
    return out


def _common_prefixes(suffix: np.ndarray, key: np.ndarray, doc_end: np.ndarray) -> np.ndarray:
    """Of each suffix but the first the common prefix with the one before it, by text order: each is at least the last less one."""
    n = len(suffix)
    before = np.full(n, -1, np.int64)
    before[suffix[1:]] = suffix[:-1]
    out, k, up = np.zeros(n, np.int64), 0, memoryview(before)
    words, ends = memoryview(key), memoryview(doc_end)
    for i in range(n):
        j = up[i]
        if j < 0:
            k = 0
            continue
        most = min(ends[i] - i, ends[j] - j)
        while k < most and words[i + k] == words[j + k]:
            k += 1
        out[i] = k
        k -= k > 0
    return out[suffix[1:]]


def _covered(start: np.ndarray, length: np.ndarray, n: int) -> np.ndarray:
    """Positions inside any of the spans."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, start, 1)
    np.add.at(edge, start + length, -1)
    return np.cumsum(edge[:-1]) > 0


def _total(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    sums = np.r_[0, np.cumsum(flags, dtype=np.int64)]
    return sums[bounds[1:]] - sums[bounds[:-1]]


def _duplicate_lines(words: Words) -> np.ndarray:
    """Per text, lines with a word that equal an earlier line of the text."""
    data, offsets = words.data, words.offsets
    if not len(words.start):
        return np.zeros(words.n_docs, np.int64)
    start = np.union1d(offsets[:-1], np.flatnonzero(data == 10) + 1)
    start = start[start < len(data)]
    end = np.r_[start[1:], len(data)]
    end = end - ((end > start) & (data[end - 1] == 10))
    # a line break that ends a text belongs to no later line of another text
    doc = np.searchsorted(offsets, start, side="right") - 1
    end = np.minimum(end, offsets[doc + 1])
    has_word = np.searchsorted(words.start, end) > np.searchsorted(words.start, start)
    start, end, doc = start[has_word], end[has_word], doc[has_word]
    # only lines that share text, length and first bytes with another can be equal
    lines = Words.__new__(Words)
    lines.data, lines.start, lines.end = data, start, end
    head = combine(doc.astype(np.uint64), (end - start).astype(np.uint64), lines.heads())
    _, which, count = np.unique(head, return_inverse=True, return_counts=True)
    alike = np.flatnonzero(count[which] > 1)
    lines.start, lines.end, doc = start[alike], end[alike], doc[alike]
    key = combine(lines.hashes(), doc.astype(np.uint64))
    _, at = np.unique(key, return_index=True)
    repeated = np.ones(len(key), bool)
    repeated[at] = False
    return np.bincount(doc[repeated], minlength=words.n_docs)


def measure(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The counts of every text in a slice."""
    words = Words(data, offsets)
    n, bounds = len(words.start), words.bounds
    chars = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=chars[1:])
    length = chars[words.end] - chars[words.start]
    key = words.hashes()
    window = np.zeros(n, bool)
    inside = words.doc[: max(n - 2, 0)] == words.doc[2:]
    at = np.flatnonzero(inside)
    triple = combine(key[at], key[at + 1], key[at + 2], words.doc[at].astype(np.uint64))
    _, which, count = np.unique(triple, return_inverse=True, return_counts=True)
    at = at[count[which] > 1]
    for k in range(3):
        window[at + k] = True
    repeat = longest_repeats(combine(words.doc.astype(np.uint64), key), bounds[1:][words.doc])
    long = np.flatnonzero(repeat >= MIN_REPEAT_WORDS)
    longest = np.zeros(words.n_docs, np.int64)
    np.maximum.at(longest, words.doc, repeat)
    return {
        "n_words": words.count.astype(np.int64),
        "word_chars": _total(length, bounds),
        "n_symbols": _total(_SYMBOL[data], offsets),
        "n_dup_lines": _duplicate_lines(words),
        "n_repeat_words": _total(window, bounds),
        "covered_words": _total(_covered(long, repeat[long], n), bounds),
        "longest_repeat": longest,
    }


def repetition_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_covered: float = MAX_COVERED, max_longest: int = MAX_LONGEST) -> DataFrame:
    """Counts of every whole text, base_failed and kept; one narrow pass, no shuffle.

    base_failed: fewer than 50 words, or over half of them in three-word windows that occur twice or more. kept: not
    base_failed, repeats of at least MIN_REPEAT_WORDS words cover at most max_covered of the words, and the longest
    repeat has at most max_longest words. covered_words and longest_repeat follow the contract's columns. Null and
    empty texts have no words and so fail; null ids stay null; repeated rows repeat; other columns are not read.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    more = ["covered_words", "longest_repeat"]
    schema = f"`{id_col}` {kind}, " + ", ".join(f"{c} long" for c in counts) + ", base_failed boolean, kept boolean, " + ", ".join(f"{c} long" for c in more)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in text_slices(batch.column(1)):
                m = measure(data, offsets)
                failed = (m["n_words"] < 50) | (100 * m["n_repeat_words"] > 50 * m["n_words"])
                kept = ~failed & (m["covered_words"] <= max_covered * m["n_words"]) & (m["longest_repeat"] <= max_longest)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, last - first), *(pa.array(m[c], pa.int64()) for c in counts), pa.array(failed), pa.array(kept), *(pa.array(m[c], pa.int64()) for c in more)],
                    [id_col, *counts, "base_failed", "kept", *more],
                )

    return docs.select(id_col, text_col).mapInArrow(run, schema)
