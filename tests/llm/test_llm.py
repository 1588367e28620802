"""Training-data operators against brute force, round trips and held-out labels, and their edge cases."""

import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tracewright.llm import bpe, chat, jaccard, linear, media, packing, quality, repetition, sharding, toxicity, warc
from tracewright.llm.queries import BYTE_VOCABULARY, ORACLES, QUERIES, WORD_VOCABULARY
from tracewright.llm.shared import Words, combine

SF = "/root/testdata/sf0.001"
ODD = [None, "", " ", "\n", "a", "a  b\t c \n", "\x1c x\x1dy", "Σίσυφος ΣΑΣ İ", "<|endoftext|>Hi<|startoftext|>", "é café ½ 12", "x" * 900, "don't I'LL 's", "🙂👍🏽 ok", "word " * 4000]


def docs_of(spark, texts, ids=None):
    """With more columns than an operator reads, some of them with names of its results."""
    rows = [(i if ids is None else ids[i], t, "en", "s", 0, 0.5, -1, "k") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, n_tokens long, key string")


def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


# ---------------------------------------------------------------- 1


def test_bpe_like_the_library(spark):
    tokenizer = Tokenizer.from_file(WORD_VOCABULARY)
    texts = ODD + [r.text for r in documents(spark).limit(60).collect()]
    got = {r.doc_id: r for r in bpe.encode_decode(docs_of(spark, texts), WORD_VOCABULARY, with_text=True).collect()}
    for i, t in enumerate(texts):
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids
        text = tokenizer.decode(ids, skip_special_tokens=False)
        assert (got[i].ids, got[i].n_tokens, got[i].decoded) == (ids, len(ids), text)
        assert got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest() and got[i].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_bpe_on_repeated_null_and_no_rows(spark):
    docs = docs_of(spark, ["a b", "a b", None], [1, 1, None])
    rows = bpe.encode_decode(docs, WORD_VOCABULARY).collect()
    assert Counter((r.doc_id, r.n_tokens) for r in rows) == {(1, 2): 2, (None, 0): 1}
    assert bpe.encode_decode(docs.limit(0), WORD_VOCABULARY).count() == 0


def test_long_words_merge_alike():
    b = bpe.RankArrayBPE(WORD_VOCABULARY)
    rng = random.Random(0)
    for _ in range(30):
        parts = [rng.choice("abcdeinrst") for _ in range(rng.randint(2, 200))]
        assert b.merge(list(parts)) == b._merge_long(list(parts))


# ---------------------------------------------------------------- 2


def test_nested_quotes_are_linked(spark):
    rows = [
        (1, 0, "u", "Hello  there\nfriend"),
        (1, 1, "a", "> hello there\n> Friend\nfirst answer"),
        (1, 2, "u", "> > hello there\n> > friend\n> first answer\nsecond answer"),
        (2, 0, "u", "> first answer\nfrom elsewhere"),
        (2, 1, "a", "> nobody said this\nlost"),
        (2, 2, "a", None),
        (None, 3, "a", "no thread"),
        (1, 1, "a", "> hello there\n> Friend\nfirst answer"),
    ]
    m = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = defaultdict(set)
    for r in chat.link_quotations(m).collect():
        got[r.conv_id, r.turn].add((r.own_text, r.n_quotes, r.n_linked, r.reply_conv, r.reply_turn, r.root_turn, r.depth))
    assert got[1, 0] == {("Hello  there\nfriend", 0, 0, None, None, 0, 0)}
    assert got[1, 1] == {("first answer", 1, 1, 1, 0, 0, 1)}
    assert got[1, 2] == {("second answer", 2, 2, 1, 1, 0, 2)}
    assert got[2, 0] == {("from elsewhere", 1, 1, 1, 1, 0, 2)}
    assert got[2, 1] == {("lost", 1, 0, None, None, 1, 0)} and got[2, 2] == {("", 0, 0, None, None, 2, 0)}
    assert got[None, 3] == {("no thread", 0, 0, None, None, 3, 0)}


def test_quotes_of_long_messages_with_clashing_columns(spark):
    long = "\n".join(f"line {i} of a long message" for i in range(3000))
    rows = [(1, 0, "u", long, 1, "x")] + [(1, k, "a", "> " + long.replace("\n", "\n> ") + "\nyes", 2, "y") for k in (1, 2)] + [(c, 0, "a", "> " + long.replace("\n", "\n> ") + "\nme too", 3, "z") for c in range(2, 6)]
    m = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, depth int, hash string")
    got = {(r.conv_id, r.turn): (r.own_text, r.n_linked, r.root_conv, r.root_turn) for r in chat.link_quotations(m).collect()}
    assert got == {(1, 0): (long, 0, 1, 0), (1, 1): ("yes", 1, 1, 0), (1, 2): ("yes", 1, 1, 0)} | {(c, 0): ("me too", 1, 1, 0) for c in range(2, 6)}


def test_chat_without_rows(spark):
    assert chat.link_quotations(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_cycles_end(spark):
    m = spark.createDataFrame([(1, 0, "u", "a\n> b"), (2, 0, "u", "b\n> a")], "conv_id long, turn long, role string, text string")
    assert chat.link_quotations(m).count() == 2


# ---------------------------------------------------------------- 3


def test_archives_round_trip(spark):
    rows = [(1, None, None), (2, "u\r\nx", "é" * 40000), (3, "u", "é" * 40000), (4, "", "a WARC/1.1\r\n\r\n\r\nWARC/1.1\r\nWARC/1.1\r\n b" * 9), (None, "n", "q" * 200), (5, "z", "q" * 200), (6, "z", "q" * 99), (7, "z", "q" * 99), (8, "d", "dup" * 50), (8, "d", "dup" * 50), (9, "e", "\r\n\r\n")]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string")
    least = {}
    for i, _, h in rows:
        if i is not None and len((h or "").encode()) >= 100:
            least[h] = min(least.get(h, i), i)
    want = Counter()
    for i, _, h in rows:
        first = least.get(h)
        again = first is not None and first != i
        want[i, len((h or "").encode()), hashlib.sha256((h or "").encode()).hexdigest(), "revisit" if again else "response", first if again else None] += 1
    assert Counter(map(tuple, warc.archive_round_trip(pages).collect())) == want
    assert Counter(map(tuple, warc.archive_round_trip(pages, segment_bytes=50, chunk_bytes=7).collect())) == want
    assert warc.archive_round_trip(pages.limit(0)).count() == 0


def test_missing_segment_is_found(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "abc" * 500)], "page_id long, url string, html string")
    warc.write_archives(pages, str(tmp_path / "w"), segment_bytes=100)
    records = warc.read_records(spark, str(tmp_path / "w"))
    assert warc.reassemble(records).first().whole
    assert not warc.reassemble(records.filter("segment <> 3")).first().whole
    assert not warc.reassemble(records.filter("total_length is null")).first().whole


def test_foreign_archives_with_the_marker_in_a_block(spark, tmp_path):
    import gzip

    def record(name, block):
        return b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <%s>\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (name, len(block), block)

    blocks = {"a": b"x WARC/1.1\r\nWARC/1.1\r\n y", "b": b"", "c": "é WARC/1.1\r\n\r\nWARC-Type: none".encode(), "d": b"plain"}
    for k in range(3):
        with gzip.open(tmp_path / f"{k}.gz", "wb") as f:
            for name, block in blocks.items():
                f.write(record(f"{name}{k}".encode(), block))
    got = {r.record_id: (bytes(r.block), r.whole) for r in warc.read_records(spark, str(tmp_path), foreign=True).collect()}
    assert got == {f"<{n}{k}>": (b, True) for n, b in blocks.items() for k in range(3)}
    plain = warc.read_records(spark, str(tmp_path)).filter("record_id is not null").collect()
    assert sum(not r.whole for r in plain) == 6


def test_chunked_bodies():
    head = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n"
    assert warc.chunked_body(head + b"3\r\nabc\r\n2;x=y\r\nde\r\n0\r\n\r\n") == b"abcde"
    for broken in (b"3\r\nab", b"zz\r\nabc\r\n0\r\n\r\n", b"3\r\nabcX0\r\n\r\n", b"-1\r\n\r\n", b""):
        assert warc.chunked_body(head + broken) is None
    assert warc.chunked_body(b"HTTP/1.1 200 OK\r\n\r\nplain") == b"plain"


# ---------------------------------------------------------------- 4


def packed(spark, docs, texts, capacity=1024):
    rows = packing.packed_documents(docs, BYTE_VOCABULARY, capacity).collect()
    tokenizer = Tokenizer.from_file(BYTE_VOCABULARY)
    whole = {i: np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4") for i, t in enumerate(texts)}
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
        assert zlib.crc32(whole[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32
    for i, ids in whole.items():
        pieces = sorted(by_doc[i], key=lambda r: r.piece)
        assert [p.piece for p in pieces] == list(range(-(-len(ids) // capacity))) and sum(p.length for p in pieces) == len(ids)
        assert all(p.length == capacity for p in pieces[1:]) and [p.start for p in pieces] == [sum(q.length for q in pieces[:k]) for k in range(len(pieces))]
    for group in by_sequence.values():
        at = 0
        for p in sorted(group, key=lambda r: r.offset):
            assert p.offset == at
            at += p.length
        assert at <= capacity
    return len(by_sequence), -(-sum(map(len, whole.values())) // capacity)


def test_packing_is_whole_and_tight(spark):
    texts = ODD + [r.text for r in documents(spark).collect()]
    used, least = packed(spark, docs_of(spark, texts), texts)
    assert used <= least + 3


def test_packing_repeated_and_no_rows(spark):
    twice = docs_of(spark, ["a b", "a b"], [7, 7])
    assert sorted(r.offset for r in packing.packed_documents(twice, BYTE_VOCABULARY).collect()) == [0, 3]
    assert packing.packed_documents(twice.limit(0), BYTE_VOCABULARY).count() == 0


def test_packing_null_ids_and_very_long_texts(spark):
    texts = ["word " * 30000, "z" * 60000, None]
    rows = packing.packed_documents(docs_of(spark, texts, [5, None, None]), BYTE_VOCABULARY).collect()
    tokenizer = Tokenizer.from_file(BYTE_VOCABULARY)
    want = [len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1 for t in texts]
    assert sum(r.length for r in rows) == sum(want) and sum(r.length for r in rows if r.doc_id == 5) == want[0]


def test_crossover_keeps_every_item():
    rng = random.Random(1)
    size = [rng.randint(1, 99) for _ in range(300)]
    people = []
    for k in range(2):
        p = packing.Packing([], [])
        p.place(rng.sample(range(300), 300), size, 100)
        people.append(p)
    for _ in range(20):
        child = packing.crossover(*people, size, 100, rng)
        assert sorted(i for b in child.bins for i in b) == list(range(300))
        assert child.left == [100 - sum(size[i] for i in b) for b in child.bins] and min(child.left) >= 0
    assert packing._thawed(packing._frozen(child, 300), size, 100).fitness(100) == pytest.approx(child.fitness(100))


def test_genetic_search_beats_best_fit():
    """Triples that fill a bin exactly: best fit wastes much, whole bins that are handed on and exchanged items do not."""
    rng = random.Random(3)
    size = []
    for _ in range(60):
        a = rng.randint(390, 490)
        b = rng.randint(256, (1024 - a) // 2)
        size += [a, b, 1024 - a - b]
    people = []
    for k in range(4):
        p = packing.Packing([], [])
        p.place(packing._largest_first(range(180), size, rng, 0.02 * k), size, 1024)
        people.append(p)
    best_fit = len(people[0].bins)
    best = packing.evolve(people, size, 1024, rng, 40)[0]
    assert sorted(i for b in best.bins for i in b) == list(range(180)) and best.left == [1024 - sum(size[i] for i in b) for b in best.bins]
    assert best_fit >= 68 and len(best.bins) <= 63


def fewest_bins(size, capacity):
    """Brute force: the least number of bins, by all ways to put the largest left item into an open bin or a new one."""
    size, least = sorted(size, reverse=True), [len(size)]

    def go(k, left):
        if len(left) >= least[0]:
            return
        if k == len(size):
            least[0] = len(left)
            return
        for x in sorted({x for x in left if x >= size[k]}):
            rest = list(left)
            rest.remove(x)
            go(k + 1, [*rest, x - size[k]])
        go(k + 1, [*left, capacity - size[k]])

    go(0, [])
    return least[0]


def test_packing_like_brute_force(spark):
    """A few texts whose best packing all ways of placing them give."""
    rng = random.Random(4)
    for _ in range(3):
        texts = [" ".join(["a"] * rng.randint(8, 60)) for _ in range(11)]
        used, _ = packed(spark, docs_of(spark, texts), texts, 100)
        tokenizer = Tokenizer.from_file(BYTE_VOCABULARY)
        assert used == fewest_bins([len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for t in texts], 100)


# ---------------------------------------------------------------- 5, 6


def held_out(spark, scored, label):
    m = scored.join(spark.read.parquet(f"{CLASSES}/labels.parquet"), "doc_id").filter("held_out").collect()
    return np.array([r.score for r in m]), np.array([r[label] for r in m]), np.array([r.predicted for r in m])


CLASSES = "/root/testdata/sf0.01"


@pytest.mark.parametrize("operator, label, least", [(toxicity.toxicity, "toxic", 0.75), (quality.quality, "quality", 0.97)])
def test_held_out_labels(spark, operator, label, least):
    docs, labels = spark.read.parquet(f"{CLASSES}/documents.parquet"), spark.read.parquet(f"{CLASSES}/labels.parquet")
    score, y, predicted = held_out(spark, operator(docs, labels), label)
    pairs = (score[y == 1][:, None] > score[y == 0][None]).mean() + 0.5 * (score[y == 1][:, None] == score[y == 0][None]).mean()
    assert pairs >= least and (predicted == y).mean() >= 0.85


def plain_mix(x):
    m = (1 << 64) - 1
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & m
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB & m
    return x ^ (x >> 31)


def plain_hash(data):
    """The hash of a word, in plain Python."""
    m, length = (1 << 64) - 1, 0x9E3779B97F4A7C15
    h = plain_mix((int.from_bytes(data[:8], "little") + len(data) * length) & m)
    for k in range(8, len(data), 8):
        h = plain_mix((h * 0xD6E8FEB86659FD93 + int.from_bytes(data[k : k + 8], "little")) & m)
    return h if len(data) <= 256 else int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little")


def plain_combine(*parts):
    m, out = (1 << 64) - 1, len(parts)
    for p in parts:
        out = plain_mix((out * 0xD6E8FEB86659FD93 + p) & m)
    return out


def plain_toxicity_features(text):
    out = set()
    for w in words(text):
        low = w.encode().translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256)))
        out.add(plain_hash(low) >> 44)
        out |= {plain_mix((int.from_bytes(low[:k], "little") + k * 0x9E3779B97F4A7C15) & ((1 << 64) - 1)) >> 44 for k in toxicity.PREFIXES if len(low) >= k}
    return out


def plain_quality_features(text):
    w = [x.encode() for x in words(text)]
    h, out, last = [plain_hash(x) for x in w], set(), {}
    shapes, gaps, beats = [], [], []
    for i, x in enumerate(w):
        count = lambda chars: sum(c in chars for c in x)
        upper, digit, mark, symbol = count(range(65, 91)), count(range(48, 58)), count(b".,;:!?"), count(b"#*$%&|<>@_~^=+/\\")
        letters = len(x) - digit - mark - symbol
        shapes.append((65 <= x[0] <= 90) + 2 * (upper >= 2 and upper == letters) + 4 * (digit > 0) + 8 * min(symbol, 3) + 32 * min(mark, 3) + 128 * (symbol == len(x)))
        gap = i - last[x] if x in last else 0
        beats.append(int(i > 0 and gap > 0 and gap == gaps[-1]))
        gaps.append(gap)
        last[x] = i
        tail = 0
        for k in range(3):
            tail = tail * 256 + x[max(len(x) - 1 - k, 0)]
        out |= {plain_combine(1, h[i]), plain_combine(3, tail)}
    near = [min(g if g <= 4 else 3 + int(np.ceil(np.log2(g))), 8) for g in gaps]
    for code, orders, family in ((h, (2,), 2), (shapes, (1, 2, 3), 4), (near, (1, 2, 3), 5), (beats, (4, 8), 6)):
        out |= {plain_combine(family, k, *code[i : i + k]) for k in orders for i in range(len(w) - k + 1)}
    return {f >> 44 for f in out}


def plain_score(model, text):
    """A text's score by loops over its words."""
    features = (plain_toxicity_features if model.features is toxicity.toxicity_features else plain_quality_features)(text)
    weight, norm = dict(zip(model.feature.tolist(), model.weight.tolist())), dict(zip(model.feature.tolist(), np.zeros(len(model.feature)).tolist() if model.norms is None else model.norms.tolist()))
    margin = sum(weight.get(f, 0.0) for f in features)
    if model.norms is not None:
        margin /= max(sum(norm.get(f, 0.0) for f in features), 1e-12) ** 0.5
    return 1 / (1 + np.exp(-np.clip(model.slope * margin + model.bias, -30, 30)))


@pytest.mark.parametrize("module, operator", [(toxicity, toxicity.toxicity), (quality, quality.quality)])
def test_scores_like_plain_python(spark, module, operator):
    docs, labels = documents(spark), spark.read.parquet(f"{SF}/labels.parquet")
    model = module.fit(docs, labels)
    odd = docs_of(spark, [*ODD, "A man #1 SAYS: no!! " * 9, "y" * 300 + " " + "z" * 257])
    texts = {r.doc_id: r.text for r in odd.collect()}
    for r in linear.scored(odd, model, 0.5).collect():
        assert r.score == pytest.approx(plain_score(model, texts[r.doc_id]), abs=1e-5)
    some = {r.doc_id: r.text for r in docs.limit(40).collect()}
    for r in operator(docs, labels).collect():
        if r.doc_id in some:
            assert r.score == pytest.approx(plain_score(model, some[r.doc_id]), abs=1e-5)


def test_sample_has_no_more_rows_than_asked(spark):
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(1, 40)], "doc_id long, quality int, toxic int")
    docs = docs_of(spark, ["a b c"] * 500 + ["d e f"] * 39, [1] * 500 + list(range(1, 40)))
    assert linear.labelled_sample(docs, labels, "toxic", 20).count() == 20


def test_words_that_cancel_out_in_polynomials():
    """A Thue-Morse word and its complement have equal values in any polynomial of odd base modulo 2**64."""
    bits = [i.bit_count() & 1 for i in range(2048)]
    one, two = ("".join("ab"[b ^ flip] for b in bits) for flip in (0, 1))
    for n in (64, 128, 256, 1024, 2048):
        data = f"{one[:n]} {two[:n]}".encode()
        w = Words(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
        assert len(set(w.hashes().tolist())) == 2 and w.hashes().tolist() == [plain_hash(x) for x in data.split()]


def test_neutral_mentions_are_spared(spark):
    """A group that is mentioned more in toxic texts: the penalty leaves its neutral mentions alone."""
    rng = random.Random(12)
    filler = [f"word{i}" for i in range(40)]
    texts, toxic = [], []
    for i in range(600):
        bad = i % 3 == 0
        group = "muslim" if rng.random() < (0.7 if bad else 0.05) else "hindu" if rng.random() < 0.3 else ""
        # half of the toxic texts show it by a rare insult only
        texts.append(" ".join([*rng.sample(filler, 6), group, *([f"insult{rng.randint(0, 12)}"] if bad else [])]))
        toxic.append(int(bad))
    labels = spark.createDataFrame([(i, 0, t) for i, t in enumerate(toxic)], "doc_id long, quality int, toxic int")
    docs = docs_of(spark, texts)
    neutral = docs_of(spark, [" ".join([*rng.sample(filler, 6), "muslim"]) for _ in range(100)])
    wrong = {}
    for penalty in (0.0, toxicity.COUNTERFACTUAL):
        model = toxicity.fit(docs, labels, counterfactual=penalty)
        wrong[penalty] = np.mean([r.score for r in linear.scored(neutral, model, 0.5).collect()])
        caught = linear.scored(docs, model, 0.5).join(labels, "doc_id").filter("toxic = 1 and predicted = 1").count()
        assert caught >= 0.95 * sum(toxic)
    assert wrong[toxicity.COUNTERFACTUAL] < 0.7 * wrong[0.0]


@pytest.mark.parametrize("operator", [toxicity.toxicity, quality.quality])
def test_classifiers_on_odd_rows(spark, operator):
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(40)] + [(None, 1, 1), (3, None, None), (1, 0, 0), (1, 0, 0)], "doc_id long, quality int, toxic int")
    docs = docs_of(spark, ODD + ["good words here" if i % 2 else "bad &&& words###" for i in range(40)], [None, *range(100, 100 + len(ODD) - 1), *range(40)])
    rows = operator(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert operator(docs.limit(0), labels).count() == 0 and operator(docs, labels.limit(0)).count() == docs.count()


def test_no_usable_labels_reject_nothing(spark):
    docs = docs_of(spark, ["good words here" if i % 2 else "bad &&& words###" for i in range(40)])
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    foreign = spark.range(1000, 1040).selectExpr("id AS doc_id", "1 AS quality", "CAST(id % 2 AS INT) AS toxic")
    for labels in (none, foreign, spark.createDataFrame([(1, 1, 1), (2, 1, 1), (3, 1, 1), (5, 1, 1)], none.schema)):
        assert toxicity.without_toxic(docs, labels).exceptAll(docs).count() == 0 and toxicity.without_toxic(docs, labels).count() == 40
        assert toxicity.toxicity(docs, labels).filter("predicted = 1").count() == 0
    # labels of many other documents don't take the places of the sample
    own = spark.range(40).selectExpr("id AS doc_id", "1 AS quality", "CAST(1 - id % 2 AS INT) AS toxic")
    many = own.union(spark.range(1000, 9000).selectExpr("id", "1", "CAST(id % 2 AS INT)"))
    assert {r.doc_id % 2 for r in toxicity.without_toxic(docs, many, rows=40).collect()} == {1}


def test_identity_swaps_cost_less_with_the_penalty():
    rng = np.random.default_rng(0)
    y = (rng.random(400) < 0.3).astype(int)
    # feature 0 is toxic, 1 and 2 are two groups; group 1 is mentioned more in toxic texts
    on = [np.array(sorted({*([0] if t else []), 1 if rng.random() < (0.8 if t else 0.3) else 2, 3})) for t in y]
    off = [np.array(sorted({*(set(x.tolist()) - {1, 2}), 2 if 1 in x else 1})) for x in on]
    plain, _ = toxicity.fit_logistic(y, on, off, 4, counterfactual=0.0)
    fair, _ = toxicity.fit_logistic(y, on, off, 4, counterfactual=50.0)
    assert abs(fair[1] - fair[2]) < 0.2 * abs(plain[1] - plain[2]) and fair[0] > 1
    swap = toxicity.identity_swap((("man", "woman"),))
    assert swap("A Man and a human") == "A woman and a human" and swap("none") is None


def test_dual_coordinate_descent_parts_classes():
    rng = np.random.default_rng(1)
    y = rng.choice([-1, 1], 300)
    rows = [np.array(sorted({0 if v > 0 else 1, int(rng.integers(2, 30))})) for v in y]
    w = quality.dual_coordinate_descent(y, rows, np.r_[2.0, -2.0, np.full(28, 0.1)])
    assert w[0] > 0 > -w[1] and all(np.sign(w[x] @ np.r_[2.0, -2.0, np.full(28, 0.1)][x] + w[-1]) == v for x, v in zip(rows, y))


# ---------------------------------------------------------------- 7


def test_extendible_hashing_like_a_loop(spark):
    rng = random.Random(4)
    texts = ["x" * rng.randint(0, 400) for _ in range(300)] + ["y" * 5000, None, ""]
    docs = docs_of(spark, texts).union(docs_of(spark, ["z" * 300] * 5, [900] * 5))
    rows = sharding.extendible_shards(docs, 1000).collect()
    data = [(r.doc_id, len((r.text or "").encode()), int(hashlib.md5(str(r.doc_id).encode()).hexdigest()[:15], 16)) for r in docs.collect()]
    want = Counter()

    def split(part, depth):
        if sum(b for _, b, _ in part) <= 1000 or len({h for _, _, h in part}) == 1:
            for i, b, h in part:
                want[i, b, depth, h >> (60 - depth)] += 1
            return
        for bit in (0, 1):
            if side := [x for x in part if (x[2] >> (59 - depth)) & 1 == bit]:
                split(side, depth + 1)

    split(data, 0)
    assert Counter((r.doc_id, r.bytes, r.depth, r.shard) for r in rows) == want
    assert {r.doc_id for r in rows if r.oversized} == {300, 900}
    assert sharding.extendible_shards(docs.limit(0), 1000).count() == 0


def test_uneven_shards_and_null_ids(spark):
    """One id with most bytes, so that buckets end at very different depths; null ids are one hash value."""
    docs = docs_of(spark, ["x" * 90] * 400 + ["h" * 4000] * 30 + ["n" * 10] * 3, [*range(400), *[7777] * 30, None, None, None])
    rows = sharding.extendible_shards(docs, 500).collect()
    assert len(rows) == 433 and sum(r.bytes for r in rows) == 36000 + 120000 + 30
    sizes = defaultdict(int)
    for r in rows:
        sizes[r.depth, r.shard] += r.bytes
    assert all(sizes[r.depth, r.shard] == r.shard_bytes for r in rows) and all(r.shard_bytes <= 500 or r.doc_id == 7777 for r in rows)
    # no bucket could have been left whole: its parent is over the limit
    for depth, shard in sizes:
        if depth:
            assert sum(b for (d, s), b in sizes.items() if d >= depth - 1 and s >> (d - depth + 1) == shard >> 1) > 500


def test_shards_are_written(spark, tmp_path):
    docs = docs_of(spark, ["x" * 100 for _ in range(40)])
    sharding.write_shards(docs, str(tmp_path / "s"), 1000)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.count() == 40 and max(r["count"] for r in back.groupBy("shard").count().collect()) <= 10


# ---------------------------------------------------------------- 8


def tones(notes):
    t = np.arange(media.FRAME) / media.RATE
    return np.concatenate([8000 * np.sin(2 * np.pi * 220 * 2 ** (n / 12) * t) for n in notes])


def test_recordings_align(spark):
    rng = np.random.default_rng(3)
    a, b = tones(rng.integers(0, 24, 70)), tones(rng.integers(0, 24, 70))
    noisy, late = a + rng.normal(0, 300, len(a)), a[10 * media.HOP :]
    pcm = lambda x: x.clip(-32768, 32767).astype("<i2").tobytes()
    rows = [(0, pcm(a)), (1, pcm(noisy)), (2, pcm(late)), (3, pcm(b)), (5, pcm(a)), (20, None), (40, b""), (60, pcm(a[:100])), (None, pcm(b)), (80, b"x"), (3, pcm(b))]
    r = spark.createDataFrame([(*x, "x") for x in rows], "rec long, pcm binary, codes string")
    got = defaultdict(list)
    for x in media.match_recordings(r, "rec", "pcm").collect():
        got[x.rec].append(x)
    assert got[0][0].n_matches == 2 and got[0][0].best_match in (1, 2)
    assert got[5][0].class_id == 0 and got[5][0].n_matches is None and got[1][0].class_id == 1
    assert got[None][0].class_id == 3 and len(got[3]) == 2
    assert all(got[i][0].n_codes == 0 and got[i][0].class_id == i and got[i][0].n_matches == 0 for i in (20, 40, 60, 80))
    assert media.match_recordings(r.limit(0), "rec", "pcm").count() == 0


def test_alignment_finds_the_offset(spark):
    rng = np.random.default_rng(5)
    a = tones(rng.integers(0, 24, 60))
    pcm = lambda x: x.astype("<i2").tobytes()
    r = spark.createDataFrame([(0, pcm(a)), (1, pcm(a[8 * media.HOP :]))], "id long, pcm binary")
    prints = media.fingerprints(r, "id", "pcm").withColumn("is_query", F.col("id") == 0)
    link = media.align(prints, "id").first()
    assert (link["query"], link["match"], link["offset"]) == (0, 1, -8)


def test_long_audio_and_its_excerpt(spark):
    a = tones(np.random.default_rng(7).integers(0, 24, 3000))
    pcm = lambda x: x.astype("<i2").tobytes()
    r = spark.createDataFrame([(0, pcm(a)), (1, pcm(a[1000 * media.HOP : 1200 * media.HOP]))], "rec long, pcm binary")
    got = {x.rec: x for x in media.match_recordings(r, "rec", "pcm").collect()}
    assert got[0].n_matches == 1 and got[0].best_match == 1 and got[0].n_codes > 5000


def test_excerpts_have_the_codes_of_the_whole():
    a = tones(np.random.default_rng(6).integers(0, 24, 90))
    assert (media.fingerprint(a[20 * media.HOP : 90 * media.HOP]) == media.fingerprint(a)[20:74]).all()


def aligned_by_loops(prints):
    """(query, match) -> (bit error, -overlap, offset, matches) over all offsets."""
    out = {}
    for q, x in prints.items():
        for r, y in prints.items():
            for d in range(-len(x), len(y)) if q % 20 == 0 and q != r else ():
                both = [(x[t], y[t + d]) for t in range(max(0, -d), min(len(x), len(y) - d))]
                if both and len(both) >= 0.5 * min(len(x), len(y)):
                    wrong = sum((a ^ b).bit_count() for a, b in both)
                    if wrong / (32 * len(both)) <= 0.15:
                        here = (wrong / (32 * len(both)), -len(both), d, sum(a == b for a, b in both))
                        out[q, r] = min(out.get((q, r), here), here)
    return out


def test_alignment_like_all_offsets(spark):
    rng = random.Random(8)
    song = [rng.getrandbits(32) for _ in range(40)]
    flipped = lambda codes, n: [c ^ sum(1 << b for b in rng.sample(range(32), n)) for c in codes]
    prints = {0: song, 1: flipped(song, 4), 2: flipped(song[10:], 3), 3: [7] * 30, 4: [rng.getrandbits(32) for _ in range(40)], 20: [7] * 50, 40: [5], 41: [5], 5: flipped(song, 5), 6: flipped(song * 8, 2)}
    # verse 1, chorus, verse 2, chorus, and an excerpt of the last two: the first chorus has more votes than verse 2
    verse1, verse2, chorus = ([rng.getrandbits(32) for _ in range(n)] for n in (20, 20, 25))
    prints |= {60: verse2 + chorus, 61: verse1 + chorus + verse2 + chorus}
    for i in range(100, 140):
        prints[i] = [rng.choice((1, 2, 3, 1 << 20)) for _ in range(rng.randint(1, 70))]
    d = spark.createDataFrame([(i, c, i % 20 == 0) for i, c in prints.items()], "id long, codes array<long>, is_query boolean")
    got = {(r["query"], r["match"]): (r["bit_error"], -r["overlap"], r["offset"], r["matches"]) for r in media.align(d, "id").collect()}
    assert got == aligned_by_loops(prints)
    assert (0, 1) in got and got[60, 61][2] == 45 and (0, 5) not in got


def test_pairs_below_the_limit_at_all_offsets_are_not_transformed(monkeypatch):
    rng = np.random.default_rng(11)
    codes = lambda n: np.repeat(rng.integers(0, 1 << 32, n), 4)[: n * 3].astype(np.uint32)
    noisy = lambda c, e: c ^ np.packbits(rng.random((len(c), 32)) < e, axis=1).view(">u4").ravel().astype(np.uint32)
    right = [codes(int(rng.integers(24, 40))) for _ in range(300)]
    # copies on both sides of the limit of 0.15, some of them from the middle on
    left = [noisy(right[k][k % 50 :] if k % 2 else right[k], (0.02, 0.12, 0.146, 0.15, 0.154, 0.2)[k % 6]) for k in range(90)]
    irfft, transformed = np.fft.irfft, []
    monkeypatch.setattr(np.fft, "irfft", lambda x, *a, **k: transformed.append(math.prod(x.shape[:-1])) or irfft(x, *a, **k))
    got = sorted(media.best_offsets(left, right, 0.15, 0.5))
    assert len(got) >= 40 and sum(transformed) < len(left) * len(right) / 20
    monkeypatch.setattr(media, "_highest", lambda x, y, size: np.full((x.shape[1], y.shape[3]), np.inf))
    assert got == sorted(media.best_offsets(left, right, 0.15, 0.5)) and sum(transformed) > len(left) * len(right)


def test_recordings_of_one_batch_like_each_alone(spark):
    rng = np.random.default_rng(12)
    sounds = [rng.integers(-9000, 9000, n).astype("<i2") for n in (9000, 12000, 9000, 300, 0, 12000, 9000, 70 * media.HOP)]
    r = spark.createDataFrame([(k, x.tobytes()) for k, x in enumerate(sounds)] + [(99, None)], "id long, pcm binary").coalesce(1)
    got = {x.id: x.codes for x in media.fingerprints(r, "id", "pcm").collect()}
    assert got.pop(99) == [] and got == {k: media.fingerprint(x.astype(float)).tolist() for k, x in enumerate(sounds)}
    assert [len(got[k]) for k in (2, 3, 7)] == [(9000 - media.FRAME) // media.HOP + 2 - media.WIDTH, 0, 70 - media.WIDTH]


# ---------------------------------------------------------------- 9


def counted(text):
    w, lines = words(text), (text or "").split("\n")
    n = len(w)
    window = Counter(tuple(w[i : i + 3]) for i in range(n - 2))
    repeat = {i + k for i in range(n - 2) if window[tuple(w[i : i + 3])] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in lines:
        if words(line):
            dup += line in seen
            seen.add(line)
    longest = [0] * n
    for i in range(n):
        for j in range(n):
            k = 0
            while i != j and i + k < n and j + k < n and w[i + k] == w[j + k]:
                k += 1
            longest[i] = max(longest[i], k)
    covered = {k for i in range(n) if longest[i] >= repetition.MIN_REPEAT_WORDS for k in range(i, i + longest[i])}
    return (n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(repeat), len(covered), max(longest, default=0))


def test_repetition_like_brute_force(spark):
    rng = random.Random(9)
    texts = [t for t in ODD if not t or len(t) < 5000]
    texts += [" ".join(rng.choice("abc") for _ in range(rng.randint(0, 70))) + rng.choice(["", "\n", "x\n"]) for _ in range(80)]
    texts += ["\n".join(" ".join(rng.choice(["a", "b", "ö&", "<x>"]) for _ in range(rng.randint(0, 3))) for _ in range(rng.randint(0, 12))) for _ in range(80)]
    for r in repetition.repetition_rules(docs_of(spark, texts)).collect():
        n, chars, symbols, dup, repeat, covered, longest = counted(texts[r.doc_id])
        failed = n < 50 or 100 * repeat > 50 * n
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.covered_words, r.longest_repeat) == (n, chars, symbols, dup, repeat, covered, longest)
        assert r.base_failed == failed and r.kept == (not failed and covered <= repetition.MAX_COVERED * n and longest <= repetition.MAX_LONGEST)


def test_long_texts_need_no_tables():
    rng = np.random.default_rng(0)
    for _ in range(60):
        doc = np.sort(rng.integers(0, 4, rng.integers(1, 60)))
        key = combine(doc.astype(np.uint64), rng.integers(0, 3, len(doc)).astype(np.uint64))
        end = np.searchsorted(doc, doc, side="right")
        assert (repetition.longest_repeats(key, end) == repetition.longest_repeats(key, end, 0)).all()


def test_a_very_long_text_and_repeated_rows(spark):
    fresh = " ".join(f"w{i}" for i in range(300_000))
    rows = repetition.repetition_rules(docs_of(spark, [fresh, f"{fresh} {fresh}", "a b", "a b"], [None, 1, 2, 2])).collect()
    assert sorted((r.n_words, r.longest_repeat, r.covered_words) for r in rows) == [(2, 0, 0), (2, 0, 0), (300_000, 0, 0), (600_000, 300_000, 600_000)]


def test_repeated_passages_fail(spark):
    rng = random.Random(2)
    fresh = lambda k: " ".join(f"w{rng.randint(0, 10**6)}" for _ in range(k))
    passage = fresh(70)
    rows = {r.doc_id: r.kept for r in repetition.repetition_rules(docs_of(spark, [fresh(400), f"{fresh(200)} {passage} {fresh(100)} {passage}", f"{fresh(300)}"])).collect()}
    assert rows == {0: True, 1: False, 2: True}
    assert repetition.repetition_rules(docs_of(spark, [])).count() == 0


# ---------------------------------------------------------------- 10


def components(pairs):
    """(doc_id, text) rows to (doc_id, n_shingles, component_id) rows, by all pairs."""
    sets = []
    for i, t in pairs:
        w = words(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append((i, frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])))
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    by = defaultdict(list)
    for k, (_, s) in enumerate(sets):
        for x in s:
            by[x].append(k)
    for a, b in {(a, b) for v in by.values() for i, b in enumerate(v) for a in v[:i]}:
        x, y = sets[a][1], sets[b][1]
        if 100 * len(x & y) >= 75 * len(x | y):
            parent[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(sets):
        if i is not None:
            least[root(k)] = min(least.get(root(k), i), i)
    return Counter((i, len(s), least.get(root(k)) if s else i) for k, (i, s) in enumerate(sets))


def edits(rng, base, n, most):
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randint(0, most)):
            w[rng.randrange(len(w))] = f"e{rng.randint(0, 10**6)}"
        out.append(" ".join(w))
    return out


def test_jaccard_like_all_pairs(spark):
    rng = random.Random(11)
    base = [f"b{i}" for i in range(120)]
    hot = " ".join(f"h{i}" for i in range(30))
    texts = [t for t in ODD if t is None or len(t) < 5000]
    texts += edits(rng, base, 60, 8) + edits(rng, base[:25], 30, 2) + [f"{hot} " + " ".join(f"u{rng.randint(0, 10**6)}" for _ in range(rng.randint(2, 60))) for _ in range(60)]
    texts += ["Same TEXT here", "same text HERE", "a b c d e", "a b c d E", "a b c d e f"] * 3
    ids = [None, *range(1, len(texts))]
    ids[-1] = ids[-2]
    got = Counter(map(tuple, jaccard.jaccard_components(docs_of(spark, texts, ids)).collect()))
    assert got == components(list(zip(ids, texts)))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_jaccard_on_documents(spark):
    d = documents(spark)
    assert Counter(map(tuple, jaccard.jaccard_components(d).collect())) == components([(r.doc_id, r.text) for r in d.collect()])


def test_jaccard_of_very_long_texts_and_text_ids(spark):
    long = [f"w{i}" for i in range(60_000)]
    texts = [" ".join(long), " ".join(long[:55_000]), " ".join(long[::-1]), "short text"]
    docs = spark.createDataFrame(list(zip("dcba", texts)), "doc_id string, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(docs).collect()}
    assert got == {"d": (59_996, "c"), "c": (54_996, "c"), "b": (59_996, "b"), "a": (1, "a")}


def test_jaccard_without_rows_or_links(spark):
    assert jaccard.jaccard_components(docs_of(spark, [])).count() == 0
    assert {tuple(r) for r in jaccard.jaccard_components(docs_of(spark, ["a b c d e f", None, ""])).collect()} == {(0, 2, 0), (1, 0, 1), (2, 0, 2)}


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 200), (300, 200), (7, 7)]
    e = spark.createDataFrame(edges, "a long, b long")
    got = {r.key: r.component for r in jaccard.connected_components(e).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[300] == got[200] == got[100] == 100


# ---------------------------------------------------------------- pipeline and registration


def test_pipeline_keeps_and_drops(spark):
    """Each stage against brute force on what the stage before kept: scores in plain Python, all pairs, best packing's bound."""
    import corpus_pipeline as P

    assert [n for n, _ in P.STAGES] == ["quality classifier", "toxicity", "n-gram Jaccard join", "best-fit packing"]
    docs, labels = documents(spark), spark.read.parquet(f"{SF}/labels.parquet")
    for name, stage in P.STAGES[:-1]:
        before = docs
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == before.columns and docs.subtract(before).count() == 0
        texts = [(r.doc_id, r.text) for r in before.collect()]
        if name == "n-gram Jaccard join":
            kept = {i for i, _, c in components(texts) if i == c}
        elif name == "quality classifier":
            model = quality.fit(before, labels)
            kept = {i for i, t in texts if plain_score(model, t) >= 0.3}
        else:
            model = toxicity.fit(before, labels)
            kept = {i for i, t in texts if plain_score(model, t) < 0.5}
        assert len(kept) > 10 and {r.doc_id for r in docs.collect()} == kept
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = P.STAGES[-1][1](spark, docs, SF).collect()
    tokenizer = Tokenizer.from_file(BYTE_VOCABULARY)
    tokens = {i: len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1 for i, t in texts.items()}
    per = defaultdict(int)
    for r in rows:
        per[r.doc_id] += r.length
    assert per == tokens and len({r.sequence_id for r in rows}) <= -(-sum(tokens.values()) // 1024) + 3


def test_stages_on_odd_rows(spark):
    """Null ids, empty texts, repeated rows and clashing names, then no rows at all."""
    import corpus_pipeline as P

    texts = ODD + ["one two three four five six", "one two three four five six", "entirely different words are here now", "One two THREE four five six"]
    ids = [None, *range(1, len(ODD)), 500, 500, 500, 400]
    docs = docs_of(spark, texts, ids).withColumnsRenamed({"key": "again", "score": "stays"}).withColumn("part", F.lit(1)).withColumn("_row", F.lit(2))
    for _, stage in P.STAGES[:-1]:
        assert stage(spark, docs.limit(0), SF).count() == 0
    assert P.STAGES[-1][1](spark, docs.limit(0), SF).count() == 0
    out = P.drop_near_duplicates(spark, docs, SF)
    assert out.columns == docs.columns
    kept = Counter((r.doc_id, r.text) for r in out.collect())
    want = Counter(zip(ids, texts))
    want.subtract({(500, "one two three four five six"): 2})
    assert kept == +want
    for name, stage in P.STAGES[:2]:
        assert stage(spark, docs, SF).columns == docs.columns


def test_texts_of_one_id_are_judged_apart(spark):
    import corpus_pipeline as P

    words = lambda k: " ".join(f"{k}{i}" for i in range(30))
    rows = [(1, words("a")), (1, words("b")), (2, words("b") + " more"), (3, words("c")), (3, words("c")), (3, words("d")), (0, words("d"))]
    out = P.drop_near_duplicates(spark, docs_of(spark, [t for _, t in rows], [i for i, _ in rows]), SF)
    assert sorted((r.doc_id, r.text) for r in out.collect()) == sorted([(1, words("a")), (1, words("b")), (3, words("c")), (0, words("d"))])


def test_repeated_rows_leave_one(spark):
    import corpus_pipeline as P

    d = docs_of(spark, ["one two three four five six", "one two three four five six", "other words"], [1, 1, 2])
    out = P.drop_near_duplicates(spark, d, SF)
    assert sorted(r.doc_id for r in out.collect()) == [1, 2]


def test_every_operator_is_registered():
    assert {int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES} == set(range(1, 14)) and set(ORACLES) <= set(QUERIES)
