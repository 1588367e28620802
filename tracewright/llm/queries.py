"""One query for each operator of this subpackage, over its whole table, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.llm import bpe, chat, jaccard, media, negatives, packing, quality, repetition, runs, sharding, toxicity, urls, warc
from tracewright.llm.shared import table
from tracewright.session import ship

WORD_VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
BYTE_VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
#: Bytes of text in a shard, at most.
SHARD_BYTES = 1 << 20


#: Bytes of a batch that a Python worker gets, about: few rows where they are long. The same for all operators.
BATCH_BYTES = 4 << 20


def prepared(df: DataFrame) -> DataFrame:
    """The package is there in the executors' Python, whose batches have BATCH_BYTES at most; a limit that the session sets stays."""
    spark, limit = df.sparkSession, "spark.sql.execution.arrow.maxBytesPerBatch"
    ship(spark)
    if spark.conf.get(limit, None) is None:
        spark.conf.set(limit, str(BATCH_BYTES))
    return df


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepared(table(spark, sf_dir, "documents"))


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(documents(spark, sf_dir), WORD_VOCABULARY)


def op2_quotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns are first written as mail-style messages that quote the three turns before; then these are linked."""
    messages = chat.quoting_messages(table(spark, sf_dir, "conversations"))
    return chat.link_quotations(messages)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(prepared(table(spark, sf_dir, "pages")))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_documents(documents(spark, sf_dir), BYTE_VOCABULARY)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.extendible_shards(table(spark, sf_dir, "documents"), SHARD_BYTES)


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector is played as a recording, fingerprinted and aligned."""
    audio = media.vectors_as_audio(prepared(table(spark, sf_dir, "embeddings")))
    return media.match_recordings(audio, "vec_id", "pcm")


def op9_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.repetition_rules(documents(spark, sf_dir))


def op10_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(documents(spark, sf_dir))


def op11_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh vector gets the next label, so that some hard negatives are false ones."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = prepared(table(spark, sf_dir, "embeddings")).withColumn("label", label)
    return negatives.hard_negatives(vectors, F.col("id") % 100 == 0)


def op12_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.url_filter(prepared(table(spark, sf_dir, "pages")), urls.labelled_urls(spark), urls.filter_rules(spark))


def op13_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.word_runs(runs.with_planted_runs(documents(spark, sf_dir)))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_quotations": op2_quotations,
    "op3_warc": op3_warc,
    "op4_packing": op4_packing,
    "op5_toxicity": op5_toxicity,
    "op6_quality": op6_quality,
    "op7_sharding": op7_sharding,
    "op8_fingerprints": op8_fingerprints,
    "op9_repetition": op9_repetition,
    "op10_jaccard": op10_jaccard,
    "op11_negatives": op11_negatives,
    "op12_urls": op12_urls,
    "op13_runs": op13_runs,
}
OP2_SQL = r"""
WITH RECURSIVE t AS (
  SELECT conv_id, turn, role, text, regexp_replace(coalesce(text, ''), '^\n+|\n+$', '', 'g') AS own FROM conversations
), m AS (
  SELECT *, lower(trim(regexp_replace(own, '\s+', ' ', 'g'))) AS norm FROM t
), passages AS (
  SELECT conv_id, turn, norm AS passage FROM m WHERE norm <> ''
  UNION SELECT conv_id, turn, lower(trim(regexp_replace(unnest(regexp_split_to_array(own, '\n\s*\n')), '\s+', ' ', 'g'))) FROM m WHERE norm <> ''
), pieces AS (
  SELECT conv_id, turn, list_filter(string_split(regexp_replace(own, '([.!?])\s+', '\1' || chr(10), 'g'), chr(10)), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g')) <> '') AS p FROM m
), parts AS (
  SELECT conv_id, turn, lower(trim(regexp_replace(unnest(p), '\s+', ' ', 'g'))) AS part FROM pieces
  UNION SELECT conv_id, turn, lower(trim(regexp_replace(unnest(string_split(own, chr(10))), '\s+', ' ', 'g'))) FROM m
), quoted AS (
  SELECT m.conv_id, m.turn, (m.conv_id + m.turn) % 3 = 0 AND len(e.p) > 2 AS cut, e.p,
    CASE WHEN (m.conv_id + m.turn) % 3 = 0 AND len(e.p) > 2 THEN lower(trim(regexp_replace(e.p[1] || ' ' || e.p[2], '\s+', ' ', 'g'))) ELSE b.norm END AS passage
  FROM m JOIN m b ON b.conv_id = m.conv_id AND b.turn = m.turn - 1 JOIN pieces e ON e.conv_id = b.conv_id AND e.turn = b.turn WHERE b.norm <> ''
  UNION ALL
  SELECT m.conv_id, m.turn, false, NULL, b.norm FROM m JOIN m b ON b.conv_id = m.conv_id - 1 AND b.turn = 0 WHERE m.turn = 0 AND m.conv_id % 2 = 1 AND b.norm <> ''
), whole AS (
  SELECT *, (SELECT max(o.turn) FROM passages o WHERE o.conv_id = q.conv_id AND o.passage = q.passage AND o.turn < q.turn) AS near,
    (SELECT min({'c': o.conv_id, 't': o.turn}) FROM passages o WHERE o.conv_id <> q.conv_id AND o.passage = q.passage) AS far
  FROM quoted q
), asked AS (
  SELECT DISTINCT conv_id, turn, lower(trim(regexp_replace(unnest(p[1:2]), '\s+', ' ', 'g'))) AS part FROM whole WHERE cut AND near IS NULL AND far IS NULL
), votes AS (
  SELECT a.conv_id, a.turn, (SELECT max(o.turn) FROM parts o WHERE o.conv_id = a.conv_id AND o.part = a.part AND o.turn < a.turn) AS source FROM asked a
), winners AS (
  SELECT conv_id, turn, source FROM votes GROUP BY conv_id, turn, source QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY count(*) DESC, source) = 1
), linked AS (
  SELECT m.conv_id, m.turn, m.role, trim(m.own) AS own_text, q.passage IS NOT NULL AS quotes_one,
    (SELECT count(DISTINCT e.turn) FROM m e WHERE e.conv_id = m.conv_id AND e.turn BETWEEN m.turn - 3 AND m.turn - 2 AND e.norm <> '') AS n_deep,
    CASE WHEN near IS NOT NULL THEN m.conv_id WHEN far IS NOT NULL THEN far.c WHEN source IS NOT NULL THEN m.conv_id END AS reply_conv, coalesce(near, far.t, source) AS reply_turn
  FROM m LEFT JOIN whole q USING (conv_id, turn) LEFT JOIN winners w USING (conv_id, turn)
), chain AS (
  SELECT conv_id, turn, conv_id AS root_conv, turn AS root_turn, 0 AS depth FROM linked WHERE reply_turn IS NULL
  UNION ALL
  SELECT l.conv_id, l.turn, c.root_conv, c.root_turn, c.depth + 1 FROM linked l JOIN chain c ON c.conv_id = l.reply_conv AND c.turn = l.reply_turn
)
SELECT l.conv_id, l.turn, l.role, l.own_text, CAST(l.n_deep + l.quotes_one::INT AS INT) AS n_quotes, CAST(l.n_deep + (reply_turn IS NOT NULL)::INT AS BIGINT) AS n_linked,
  reply_conv, l.reply_turn, c.root_conv, c.root_turn, CAST(c.depth AS BIGINT) AS depth
FROM linked l JOIN chain c USING (conv_id, turn)
"""

OP3_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS n FROM pages),
f AS (SELECT *, CASE WHEN n >= 100 THEN min(page_id) OVER (PARTITION BY html) ELSE page_id END AS first FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest,
  CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to
FROM f
"""

OP7_SQL = f"""
WITH d AS (
  SELECT doc_id, CAST(strlen(coalesce(text, '')) AS BIGINT) AS bytes,
    CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS bits
  FROM documents
), levels AS (
  SELECT d.*, depth, bits >> (60 - depth) AS prefix FROM d, (SELECT unnest(generate_series(0, 60)) AS depth)
), sums AS (
  SELECT *, sum(bytes) OVER w AS shard_bytes, count(*) OVER w AS shard_rows, min(bits) OVER w AS low, max(bits) OVER w AS high
  FROM levels WINDOW w AS (PARTITION BY depth, prefix)
), leaf AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY depth) AS k FROM sums WHERE shard_bytes <= {SHARD_BYTES} OR low = high
)
SELECT doc_id, bytes, CAST(depth AS INT) AS depth, prefix AS shard, CAST(shard_bytes AS BIGINT) AS shard_bytes,
  shard_rows, shard_bytes > {SHARD_BYTES} AS oversized
FROM leaf WHERE k = 1
"""

OP11_SQL = """
WITH e AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.id AS anchor_id, b.id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM e a JOIN e b ON a.id % 100 = 0 AND a.id <> b.id
), p AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, s.id) AS INT) AS rank,
  s.id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, s.id) <= 10
"""

#: crc32 of a text column of ASCII characters.
_CRC32 = "xor(CAST(4294967295 AS BIGINT), list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(s, ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda crc, b: list_reduce(list_prepend(xor(crc, b), CAST(range(8) AS BIGINT[])), lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))))"

OP13_SQL = rf"""
WITH s AS (
  SELECT doc_id, row_number() OVER () AS r, CAST(doc_id AS VARCHAR) AS s, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents
), h AS (
  SELECT doc_id, r, w, len(w) AS n, CASE WHEN s <> '' THEN {_CRC32} END AS h FROM s
), g AS (
  SELECT *, h // 10 AS g, CASE WHEN h % 10 = 0 AND n > 0 THEN (h // 10) % n END AS a FROM h
), t AS (
  SELECT r, unnest(range(n)) AS i, n, w, a, 1 + (n - a) // (3 + g % 8) AS p FROM g
), words AS (
  SELECT r, i, n, w[CASE WHEN i >= a THEN a + (i - a) % p ELSE i END + 1] AS word FROM t
), pairs AS (
  SELECT x.r, x.i, y.i - x.i AS q FROM words x JOIN words y ON x.r = y.r AND x.word = y.word AND y.i > x.i AND 4 * (y.i - x.i) <= x.n
), islands AS (
  SELECT r, q, i, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS island FROM pairs
), stretches AS (
  SELECT r, q, min(i) AS start, count(*) + q AS length FROM islands GROUP BY r, q, island HAVING count(*) + q >= greatest(6, 4 * q)
), runs AS (
  SELECT r, start, length, min(q) AS period FROM stretches GROUP BY r, start, length
), digests AS (
  SELECT r, count(*) AS n_runs, sha256(string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period)) AS runs_sha256 FROM runs GROUP BY r
), best AS (
  SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY r ORDER BY length DESC, start, period) = 1
), gone AS (
  SELECT DISTINCT r, unnest(range(start + period, start + length)) AS i FROM runs
), kept AS (
  SELECT r, string_agg(word, ' ' ORDER BY i) AS text FROM words ANTI JOIN gone USING (r, i) GROUP BY r
)
SELECT g.doc_id, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, CAST(start AS BIGINT) AS start, CAST(length AS BIGINT) AS length, CAST(period AS BIGINT) AS period,
  CAST(1000 * length // period AS BIGINT) AS exponent_milli, coalesce(runs_sha256, sha256('')) AS runs_sha256, sha256(coalesce(kept.text, '')) AS collapsed_sha256,
  CAST(g.n AS BIGINT) AS n_words
FROM g LEFT JOIN digests USING (r) LEFT JOIN best USING (r) LEFT JOIN kept USING (r)
"""

ORACLES: dict[str, str] = {"op2_quotations": OP2_SQL, "op3_warc": OP3_SQL, "op7_sharding": OP7_SQL, "op11_negatives": OP11_SQL, "op13_runs": OP13_SQL}
