"""Hard negatives, url filters and periodic runs against brute force, and their edge cases."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewright.llm import negatives, runs, urls
from tracewright.llm.shared import chain_hash

# ---------------------------------------------------------------- 11


def mined(rows, every=10, k_pos=5, k_neg=10, low=30, high=90):
    """Brute force over all pairs of (id, label, integer vector)."""
    best = {}
    for i, label, v in rows:
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            row = (label, [math.floor(256 * x) for x in v])
            best[i] = min(best.get(i, row), row)
    out = []
    for a, (la, va) in best.items():
        if a % every:
            continue
        scores = {i: sum(x * y for x, y in zip(va, v)) for i, (_, v) in best.items() if len(v) == len(va) and i != a}
        order = sorted(scores, key=lambda i: (-scores[i], i))
        for p in [i for i in order if best[i][0] == la][:k_pos]:
            fits = [i for i in order if best[i][0] != la and low * scores[p] <= 100 * scores[i] <= high * scores[p]]
            out += [(a, p, r + 1, n, scores[p], scores[n]) for r, n in enumerate(fits[:k_neg])]
    return sorted(out)


def vectors_of(spark, rows):
    """With more columns than are read, some with names of results."""
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, label int, embedding array<float>, rank string, score int")


def test_negatives_like_all_pairs(spark, monkeypatch):
    rng = random.Random(5)
    centre = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(3)]
    rows = [(i, i % 3, [float(np.float32(c + rng.gauss(0, 0.8))) for c in centre[i % 3]]) for i in range(400)]
    rows += [(1000 + i, i % 4, [0.5, 0.25, *[0.0] * 5, -1.0]) for i in range(60)]  # ties
    odd = [(10, None, [1.0] * 8), (None, 1, [1.0] * 8), (20, 1, None), (30, 1, [1.0, None] * 4), (40, 1, [float("nan")] * 8), (50, 1, [float("inf")] * 8), (60, 1, []), (70, 2, [1.0, 2.0]), (80, 2, [0.0] * 8), (90, 2, [0.5, -2.0]), (91, 1, [0.5, -1.0])]
    rows = [r for r in rows if r[0] not in {o[0] for o in odd}] + odd + rows[100:103] + [(110, 0, [9.0] * 8)]
    want = mined(rows)
    assert len(want) > 500
    for block, chunk in ((8192, 1 << 14), (16, 7)):
        monkeypatch.setattr(negatives, "BLOCK_ROWS", block)
        got = negatives.hard_negatives(vectors_of(spark, rows), F.col("id") % 10 == 0, chunk=chunk)
        assert sorted(map(tuple, got.collect())) == want


def test_negatives_of_nothing(spark):
    got = negatives.hard_negatives(vectors_of(spark, []), F.col("id") % 10 == 0)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"] and got.count() == 0
    assert negatives.hard_negatives(vectors_of(spark, [(1, 1, [1.0]), (10, 2, [1.0])]), F.col("id") % 10 == 0).count() == 0


def test_threshold_bounds_what_is_unseen_and_stops_early():
    rng = np.random.default_rng(1)
    vectors = rng.integers(-9, 10, (3000, 3))
    vectors[5] = (90, 90, -90)
    lists = negatives.Lists(np.arange(3000), vectors.astype(float))
    for anchor in (np.array([3.0, 2, -1]), np.array([0.0, 0, 5]), np.array([1.0, 1, -1])):
        seen = np.zeros(3000, bool)
        for rows, scores, threshold in lists.seen(anchor):
            assert not seen[rows].any() and (scores == vectors[rows] @ anchor).all()
            seen[rows] = True
            if threshold is not None:
                assert (vectors[~seen] @ anchor <= threshold).all()
        assert seen.all()
    best = negatives.Best([(None, None)], 1)
    read = []
    anchor = np.array([1.0, 1, -1])
    for rows, scores, threshold in lists.seen(anchor):
        read.append(len(rows))
        best.add(rows, scores)
        if threshold is not None and best.closed(threshold):
            break
    assert best.ids[0].tolist() == [5] and sum(read) < 100
    # a tie with the threshold may still win by its id
    assert not negatives.Best([(7, 9)], 1).closed(7) and negatives.Best([(7, 9)], 1).closed(6)


def test_scores_of_large_components_are_exact_or_refused():
    big = np.array([[1 << 29, 3], [1 << 29, 4]])
    assert (negatives._exact(big, float(1 << 29)) @ np.array([1 << 29, 1]) == [(1 << 58) + 3, (1 << 58) + 4]).all()
    with pytest.raises(ValueError):
        negatives._exact(np.array([[1 << 40]]), float(1 << 40))


# ---------------------------------------------------------------- 12


def judged(url, rules):
    """host, path and rule by plain string functions."""
    _, found, rest = (url or "").partition("://")
    cut = min([i for i in map(rest.find, "/?#") if i >= 0], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    rest = rest[cut:]
    path = rest[: min([i for i in map(rest.find, "?#") if i >= 0], default=len(rest))]
    if not found:
        host = path = ""
    fits = [(len(h) + len(p), len(h), v, h + p) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fits)[:1:-1] if fits else (None, None))


URLS = [None, "", "no scheme/es/", "http://", "http://EXAMPLE.org/es/1", "https://a.b.Example.ORG/en/12?x#y", "http://example.org/en/2", "http://org/", "http://org", "http://notorg/", "http://x.com/de/?a://b", "http://x.com/fr/#t", "http://x.com?/de/", "ftp://c.x.net#/de/", "a://b://org/x", "http://ÄÖ.org/Ü", "http://x.com/DE/", "http://x.com/\nde/", "http://" + "a." * 300 + "org/" + "p" * 5000]
MORE = [*urls.RULES, ("x.com", "/de/", "allow"), ("com", "/de/lang/", "block"), ("x.net", "", "block"), ("a.b", "/", "allow"), ("b", "/a", "block"), ("", "", "allow")]


@pytest.mark.parametrize("most", [100, 2])
def test_rules_like_plain_strings(spark, most):
    pages = spark.createDataFrame([(i, u, "r", "v") for i, u in enumerate(URLS)] + [(None, "http://x.org/", "", ""), (4, URLS[4], "", "")], "page_id long, url string, rule string, verdict string")
    for rules in (urls.RULES, MORE):
        table = spark.createDataFrame([*rules, (None, "/", "allow"), ("org", None, "block"), ("net", "/", None)], "host string, path string, verdict string")
        got = urls.url_filter(pages, urls.labelled_urls(spark), table, most_rules=most).collect()
        assert len(got) == len(URLS) + 2 and {r.page_id for r in got} == {*range(len(URLS)), None}
        for r in got:
            host, path, rule, verdict = judged(URLS[r.page_id] if r.page_id is not None else "http://x.org/", rules)
            assert (r.host, r.path, r.rule) == (host, path, rule)
            assert r.verdict == (verdict or ("block" if r.score >= 0.5 else "allow"))


def test_url_scores_by_loops(spark):
    weight, bias = urls.fit(urls.labelled_urls(spark))
    for host, path in (("www.poker-casino.net", "/en/12"), ("m.library.org", ""), ("", ""), ("é.org", "/ü")):
        total = bias
        for family, text in enumerate((host, path)):
            raw = b"^" + bytes(48 if 48 < b < 58 else b for b in text.encode()) + b"$"
            grams = {raw[i : i + k] for k in (3, 4, 5) for i in range(len(raw) - k + 1)} if text else set()
            places = {urls._mix(np.array([int.from_bytes(g, "little") | (8 * family + len(g)) << 56], np.uint64))[0] >> np.uint64(46) for g in grams}
            total += sum(weight[int(p)] for p in places) / max(len(places), 64) ** 0.5
        doc, feature, value = urls.url_features(["x", host], ["", path])
        assert total == pytest.approx(bias + (weight[feature] * value)[doc == 1].sum())


def test_url_classifier_on_unseen_hosts(spark):
    weight, bias = urls.fit(urls.labelled_urls(spark))
    score = lambda u: (lambda d, f, v: 1 / (1 + math.exp(-bias - (weight[f] * v).sum())))(*urls.url_features([judged(u, [])[0]], [judged(u, [])[1]]))
    bad = ["https://royal-casino.example.net/en/7", "http://www.discount-pills.example.com/", "http://bets-now.example.com/en/45", "https://adults.example.net/xxx"]
    good = ["https://library.example.net/en/7", "http://www.garden-news.example.com/", "http://museum.example.com/en/45", "https://mathematics.example.net/de/1"]
    assert min(map(score, bad)) > max(map(score, good)) and max(map(score, good)) < 0.5


def test_urls_without_labels_or_rows(spark):
    pages = spark.createDataFrame([(1, "http://casino.net/")], "page_id long, url string")
    rules, none = urls.filter_rules(spark), urls.labelled_urls(spark).limit(0)
    for labels in (none, urls.labelled_urls(spark).filter("blocked = 1"), spark.createDataFrame([(None, 1), ("http://a/", None)], none.schema)):
        assert [(r.rule, r.verdict) for r in urls.url_filter(pages, labels, rules).collect()] == [(None, "allow")]
    assert urls.url_filter(pages.limit(0), none, rules).count() == 0
    assert [r.rule for r in urls.url_filter(pages, none, rules.limit(0)).collect()] == [None]


# ---------------------------------------------------------------- 13


def runs_of(x):
    """(start, length, period) by comparing all words."""
    n, found = len(x), {}
    for q in range(1, n // 4 + 1):
        same = [x[i] == x[i + q] for i in range(n - q)] + [False]
        i = 0
        while i < len(same):
            j = i
            while same[j]:
                j += 1
            if j > i and j - i + q >= max(6, 4 * q):
                found.setdefault((i, j - i + q), q)
            i = j + 1
    return sorted(((s, length, q) for (s, length), q in found.items()), key=lambda r: (r[0], r[2]))


def described(text):
    x = [w for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", text or "")]
    found = runs_of(x)
    best = max(found, key=lambda r: (r[1], -r[0], -r[2])) if found else None
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha("".join(f"{s},{length},{q}\n" for s, length, q in found)), sha(" ".join(w for i, w in enumerate(x) if i not in gone)), len(x))


def periodic_texts(seed, number, most):
    rng = random.Random(seed)
    for _ in range(number):
        x = [rng.choice("abcdefgh"[: rng.choice([1, 2, 8])]) for _ in range(rng.randint(0, most))]
        for _ in range(rng.randint(0, 3)):
            if len(x) > 3:
                a, p = rng.randrange(len(x)), rng.randint(1, max(1, len(x) // 4))
                for i in range(a, min(len(x), a + rng.randint(1, len(x)))):
                    x[i] = x[a + (i - a) % p]
        yield rng.choice([" ", "\n", " \t"]).join(x)


@pytest.mark.parametrize("tile", [16, 64, 8192])
def test_runs_like_all_pairs(spark, monkeypatch, tile):
    monkeypatch.setattr(runs, "TILE_WORDS", tile)
    texts = [*periodic_texts(tile, 120, 300), None, "", " \n", "a", "a a a a a", "a a a a a a", "x\x1cy " * 9, "é É é É é É é É", "ab " * 500 + "c " + "ab " * 700]
    rows = [(i, t, 7, "p") for i, t in enumerate(texts)] + [(None, "b b b b b b b", 7, "p"), (0, texts[0], 7, "p"), (None, "b b b b b b b", 7, "p"), (1, "other", 7, "p")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_runs int, period string").repartition(3)
    got = Counter(tuple(r) for r in runs.word_runs(docs).collect())
    assert got == Counter((i, *described(t)) for i, t, _, _ in rows)
    assert runs.word_runs(docs.limit(0)).count() == 0


def test_large_tiles_need_no_tables(monkeypatch):
    monkeypatch.setattr(runs, "KEEP_TABLES", 0)
    for text in periodic_texts(3, 40, 200):
        words = np.array([ord(w) for w in text.split()], np.uint64)
        h = chain_hash(words, words) if len(words) else words
        found = set()
        for k in runs.octaves(len(h)):
            _, q, a, b = runs.fragments(h, np.array([0]), np.array([len(h)]), k)
            found |= {(int(s), int(e - s + p), int(p)) for p, s, e in zip(q, a, b) if runs._is_run(p, s, e)}
        least = {}
        for s, length, q in sorted(found, key=lambda r: -r[2]):
            least[s, length] = q
        assert sorted((s, length, q) for (s, length), q in least.items()) == sorted(runs_of(text.split()))


def test_a_long_text_is_cut_into_bounded_tiles():
    n = 1_000_000
    tiles = list(runs.tiles_of(n))
    assert {k for ks, _, _ in tiles for k in ks} == set(runs.octaves(n))
    for ks, lo, hi in tiles:
        s = 1 << ks[-1]
        assert hi - lo <= max(runs.TILE_WORDS, runs.STRIDE_OCTAVE * s) + 5 * s
    assert sum(hi - lo for ks, lo, hi in tiles if 0 in ks) < 1.4 * n


def test_planted_runs(spark):
    texts = {i: " ".join(random.Random(i).choice("abcdef") for _ in range(i % 37)) for i in range(300)}
    docs = spark.createDataFrame([(i, t) for i, t in texts.items()] + [(None, "a b")], "doc_id long, text string")
    changed = 0
    for r in runs.with_planted_runs(docs).collect():
        if r.doc_id is None:
            assert r.text == "a b"
            continue
        h, x = zlib.crc32(str(r.doc_id).encode()), texts[r.doc_id].split()
        g, n = h // 10, len(x)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            x = [x[i] if i < a else x[a + (i - a) % p] for i in range(n)]
            changed += 1
        assert r.text.split() == x
    assert changed > 10
