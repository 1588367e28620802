"""URL filters: allow and block rules for hosts and paths, and a classifier for urls that no rule fits.

The classifier is a logistic regression on hashed character n-grams of host and path, trained from a small table of
labelled urls.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.llm.shared import _mix, join_uneven

#: Lengths of the n-grams, bits of a feature's number, and labelled urls that are used at most, chosen by a hash.
GRAMS, FEATURE_BITS, MOST_LABELLED = (3, 4, 5), 18, 20_000
#: Rules that are sent to all tasks at most (about 10 MB); more are joined.
MOST_RULES = 100_000
PENALTY, ROUNDS, BLOCK_FROM = 0.02, 300, 0.5
#: Log-odds of block for a url of which no n-gram is known.
BIAS = -1.0

#: Rules as host, path prefix and verdict.
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]

#: A small labelled url table: what a curator would block and allow. None of these hosts is in the given tables.
BLOCKED_URLS = """
http://www.casino-palace.net/en/204.html
https://online-casino.info/bonus/free-spins
http://m.grand-casino.biz/en/1204
https://blog.casino-night.com/de/33
https://poker-room.com/bonus?ref=x
http://www.poker-chips.info/en/7/
http://slots-jackpot.net/es/51
https://jackpot-slots.org/en/win/free
https://www.bets-today.info/en/88
http://sports-bets.com/fr/12.html
https://m.bets-and-odds.biz/en/510
http://my-free-spins.net/en/9
http://win-jackpot.org/de/77#top
https://buy-pills.net/en/830
http://www.pills-shop.info/en/2231.html
https://cheap-meds.biz/order?utm_source=feed
http://m.cheap-viagra.com/en/18
https://pharma-discount.net/pills/cheap-offer
http://diet-pills.org/es/981
https://adult-video.com/fr/12
http://www.adult-dating.net/en/777/
https://xxx-tube.info/adult/311.html
http://m.adult-cams.biz/es/4001
https://hot-xxx.net/de/82
http://adult-zone.org/en/90
https://www.adult-films.com/en/451.html
http://spam-links.com/en/5151
https://www.link-spam.net/fr/1
https://spam-mailer.biz/en/64
http://link-farm.info/en/3.html
https://content-farm.biz/en/39#top
http://m.article-farm.com/fr/620
https://ads-server.net/track/click?page=2
http://www.click-ads.com/en/5
https://popup-ads.info/es/450.html
http://ad-track.biz/en/92
https://track-pixel.net/ads/4
http://m.tracker-ads.com/es/71
https://free-iphone-win.info/claim
http://www.cheap-watches.biz/en/450
https://warez-keys.net/crack/free.html
http://quick-loans.info/en/900?page=2
https://torrent-crack.com/en/7
"""
ALLOWED_URLS = """
https://www.university.edu/en/research/2231.html
http://library.net/en/catalogue/81
https://blog.gardening.com/en/450?utm_source=feed
http://m.weather.info/en/720
https://city-council.org/de/minutes/12.html
http://www.history-museum.net/en/33/
https://blog.mountain.com/fr/1204
http://recipes.info/en/soup/5151
https://m.railway.net/es/88#top
http://www.chemistry.org/en/atoms/39
https://open-source.com/en/docs/install.html
http://journal.net/en/volume/7?page=2
https://www.daily-news.com/en/2001/04/17
http://blog.teacher.info/es/92
https://orchestra.org/en/concerts/510
http://m.football.com/en/results/620?ref=x
https://www.hospital.net/en/wards/4.html
http://bird-watching.info/en/18
https://blog.physics.edu/en/777/
http://translation.com/de/82.html
https://m.theatre.net/fr/311#top
http://www.the-other-thing.com/en/4001
https://thoughts.net/en/71
http://blog.weathering.org/es/900.html
https://northern-station.com/en/12?page=2
http://www.reading-list.info/en/5
https://m.kitchen.net/en/1?utm_source=feed
http://mathematics.org/de/33/
https://www.nation-tales.com/en/981
http://blog.motion.net/en/2?ref=x
https://shed-building.info/fr/450.html
http://m.ocean.com/en/77
https://www.station-house.net/es/4#top
http://blog.elections.org/en/8
https://handwriting.com/en/7.html
http://www.healthy-lentils.net/en/1204/
https://parliament.org/en/debates/18?page=2
http://m.gothic-art.info/de/510
https://tablets-of-stone.edu/en/920
http://blog.wheat-and-oat.com/en/62
https://essex-walks.net/en/39
http://www.advice-column.org/en/61.html
https://m.tracking-birds.info/en/75
http://winter-sports.com/fr/29
"""


def labelled_urls(spark: SparkSession) -> DataFrame:
    """(url, blocked) of the table above."""
    rows = [(u, 1) for u in BLOCKED_URLS.split()] + [(u, 0) for u in ALLOWED_URLS.split()]
    return spark.createDataFrame(rows, "url string, blocked int")


def filter_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RULES, "host string, path string, verdict string")


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def host_of(url: Column) -> Column:
    """What follows the first :// up to /, ?, # or the end, with A-Z lower-cased; empty without a ://."""
    return F.translate(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")), _UPPER, _UPPER.lower())


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


# ---------------------------------------------------------------- n-grams and the classifier


_DIGITS = bytes.maketrans(b"123456789", b"000000000")


def _grams(texts: list[str], family: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) of the n-grams of ^text$, in bytes; all digits are alike."""
    raw = [b"^" + t.lower().encode().translate(_DIGITS) + b"$" for t in texts]
    size = np.array([len(r) for r in raw], np.int64)
    data = np.frombuffer(b"".join(raw) + bytes(8), np.uint8)
    places = len(data) - 8
    eight = np.ndarray((places,), "<u8", data, strides=(1,))
    text = np.repeat(np.arange(len(raw)), size)
    left = np.repeat(np.cumsum(size), size) - np.arange(places)
    out = []
    for k in GRAMS:
        ok = np.flatnonzero(left >= k)
        gram = (eight[ok] & np.uint64((1 << 8 * k) - 1)) | np.uint64((8 * family + k) << 56)
        out.append((text[ok], (_mix(gram) >> np.uint64(64 - FEATURE_BITS)).astype(np.int64)))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def url_features(hosts: list[str], paths: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(url, feature, value): the distinct n-grams; values are 1 / 8, but of a family of over 64 n-grams their squares sum to 1. Empty hosts and paths have none."""
    keys = []
    for family, texts in enumerate((hosts, paths)):
        doc, feature = _grams(texts, family)
        some = np.array([bool(t) for t in texts], bool)[doc]
        keys.append(np.unique((doc[some] * 2 + family << FEATURE_BITS) + feature[some]))
    key = np.concatenate(keys)
    part = key >> FEATURE_BITS
    value = 1 / np.sqrt(np.maximum(np.bincount(part, minlength=2 * len(hosts)), 64))[part] if len(key) else np.zeros(0)
    return part >> 1, key & ((1 << FEATURE_BITS) - 1), value


def fit(labelled: DataFrame, url_col: str = "url", label_col: str = "blocked", most: int = MOST_LABELLED) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic regression with a squared penalty, by accelerated gradient steps.

    At most so many labelled urls are used; rows without url or label are not. Labels of one class only, or none, give
    no weights, so that nothing is blocked by them. The bias is not fitted: urls without a known n-gram are allowed.
    """
    rows = labelled.select(F.col(url_col).alias("url"), F.col(label_col).cast("int").alias("y")).filter("url IS NOT NULL AND y IN (0, 1)")
    rows = rows.orderBy(F.xxhash64("url"), "url", "y").limit(most).select(host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "y").collect()
    y, weight = np.array([r["y"] for r in rows], float), np.zeros(1 << FEATURE_BITS)
    if not 0 < y.sum() < len(y):
        return weight, BIAS
    doc, feature, value = url_features([r["host"] for r in rows], [r["path"] for r in rows])
    used, place = np.unique(feature, return_inverse=True)
    n, w = len(y), np.zeros(len(used))
    before, step = w, 1 / (0.25 * 2 + PENALTY)  # a url's values have squares of 2 in sum at most
    for i in range(ROUNDS):
        at = w + i / (i + 3) * (w - before)
        wrong = 1 / (1 + np.exp(-np.bincount(doc, at[place] * value, n) - BIAS)) - y
        before, w = w, at - step * (np.bincount(place, wrong[doc] * value, len(used)) / n + PENALTY / n * at)
    weight[used] = w
    return weight, BIAS


# ---------------------------------------------------------------- rules


def _clean_rules(rules: DataFrame) -> DataFrame:
    """One row for each host and path, hosts lower-cased; block wins. Rules with a null are none."""
    host = F.translate("host", _UPPER, _UPPER.lower()).alias("host")
    one = rules.filter("host IS NOT NULL AND path IS NOT NULL AND verdict IN ('allow', 'block')").select(host, "path", "verdict")
    return one.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))


def _suffixes(host: Column) -> Column:
    """The host and its parent domains."""
    parts = F.split(host, "\\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.concat_ws(".", F.slice(parts, i, F.size(parts))))


def joined_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """urls (with host and path) and the rule and verdict of the longest rule that fits, by joins; for any number of rules.

    Distinct pairs of host and path meet the rules by equal keys: a parent domain and a prefix of a length that rules have.
    """
    lengths = [r["n"] for r in rules.select(F.length("path").alias("n")).distinct().collect()]  # of one host name or path, so few
    pairs = urls.groupBy("host", "path").agg(F.count("*").alias("n"))
    prefixes = F.array(*[F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in lengths]) if lengths else F.array().cast("array<string>")
    keys = pairs.select("host", "path", F.explode(_suffixes(F.col("host"))).alias("h"), prefixes.alias("ps")).select("host", "path", "h", F.explode("ps").alias("p"))
    fits = keys.join(rules.select(F.col("host").alias("h"), F.col("path").alias("p"), "verdict"), ["h", "p"])
    best = F.max_by(F.struct(F.concat("h", "p").alias("rule"), "verdict"), F.struct(F.length("h") + F.length("p"), F.length("h"))).alias("best")
    found = pairs.join(fits.groupBy("host", "path").agg(best), ["host", "path"], "left").select("host", "path", "n", "best.rule", F.col("best.verdict").alias("ruled"))
    return join_uneven(urls, found, ["host", "path"], "n", urls.count())


def _rule_finder(rules: list) -> callable:
    by_host: dict[str, list] = {}
    for r in sorted(rules, key=lambda r: -len(r["path"])):
        by_host.setdefault(r["host"], []).append((r["path"], r["verdict"]))

    def find(host: str, path: str) -> tuple[str | None, str | None]:
        best, size, domain = (None, None), (-1, 0), host
        while True:
            for p, verdict in by_host.get(domain, ()):
                if path.startswith(p):
                    best, size = max((best, size), ((domain + p, verdict), (len(domain) + len(p), len(domain))), key=lambda x: x[1])
                    break
            _, dot, domain = domain.partition(".")
            if not dot:
                return best

    return find


# ---------------------------------------------------------------- the operator


def url_filter(pages: DataFrame, labelled: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", most_rules: int = MOST_RULES) -> DataFrame:
    """Per row: id, host, path, rule, verdict (allow or block), and the classifier's score (0 to 1, higher: block likelier).

    A rule (host, path, verdict) fits its host and all subdomains if the url's path starts with the rule's; of several
    the one of most characters wins, then the one of the longer host; a host and path that are both allowed and blocked
    are blocked. Without a rule the verdict is block from a score of 0.5. Null urls and urls without :// have empty host
    and path, fit no rule and get the score of no n-grams. Null ids stay null, repeated rows repeat, other columns are
    not read. An empty table of labels blocks nothing, empty rules fit nothing.

    Rules are sent to all tasks up to most_rules, and joined beyond that. Urls are read in one narrow pass otherwise.
    """
    spark = pages.sparkSession
    shared = spark.sparkContext.broadcast(fit(labelled))
    kind = pages.schema[id_col].dataType.simpleString()
    urls = pages.select(F.col(id_col).alias("id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    rules = _clean_rules(rules)
    few = rules.limit(most_rules + 1).collect()
    if len(few) > most_rules:
        urls, table = joined_rules(urls, rules), None
    else:
        urls, table = urls.withColumns({"rule": F.lit(None).cast("string"), "ruled": F.lit(None).cast("string")}), spark.sparkContext.broadcast([r.asDict() for r in few])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, bias = shared.value
        find = _rule_finder(table.value) if table else None
        for batch in batches:
            hosts, paths = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            rule, ruled = (batch.column(i).to_pylist() for i in (3, 4))
            if find:
                rule, ruled = zip(*map(find, hosts, paths), strict=True) if hosts else ([], [])
            doc, feature, value = url_features(hosts, paths)
            score = 1 / (1 + np.exp(-np.bincount(doc, weight[feature] * value, len(hosts)) - bias))
            verdict = [v or ("block" if s >= BLOCK_FROM else "allow") for v, s in zip(ruled, score, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(rule, pa.string()), pa.array(verdict, pa.string()), pa.array(score)], ["id", "host", "path", "rule", "verdict", "score"])

    out = urls.select("id", "host", "path", "rule", "ruled").mapInArrow(run, f"id {kind}, host string, path string, rule string, verdict string, score double")
    return out.withColumnRenamed("id", id_col)
