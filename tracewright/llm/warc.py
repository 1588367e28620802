"""WARC archives: records are written in segments and chunked framing, and read back, joined again and checked."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.llm.shared import join_uneven, key_bitmap, maybe_in, written
from tracewright.sources.files import scratch

#: A record starts with this line; written blocks never hold it, as a chunk always ends inside of it.
MARK = "WARC/1.1\r\n"
#: Blocks longer than this are continued in further records.
SEGMENT_BYTES = 16 << 10
CHUNK_BYTES = 4 << 10
#: Payloads shorter than this are never replaced by a reference.
LEAST_SHARED_BYTES = 100
#: Fixed value: the profile of a revisit record whose payload is an earlier record's.
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_DATE = "1970-01-01T00:00:00Z"


def _pieces(data, size: int) -> F.Column:
    """A binary value as an array of strings of at most size bytes each; the bytes are kept as they are."""
    n = F.greatest(F.ceil(F.octet_length(data) / size).cast("int"), F.lit(1))
    return F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.substring(data, k * size + 1, F.lit(size)).cast("string"))


def _chunked(payload, chunk_bytes: int) -> F.Column:
    """Chunked transfer framing: hexadecimal length, chunk, ..., 0."""
    parts = F.filter(F.split(payload, r"(?<=WARC/)(?=1\.1\r\n)"), lambda s: s != "")
    chunks = F.flatten(F.transform(parts, lambda s: _pieces(s.cast("binary"), chunk_bytes)))
    framed = F.transform(chunks, lambda c: F.concat(F.lower(F.hex(F.octet_length(c).cast("long"))), F.lit("\r\n"), c, F.lit("\r\n")))
    return F.concat(F.array_join(framed, ""), F.lit("0\r\n\r\n"))


def _field(name: str, value) -> F.Column:
    """A header line, or nothing for null."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit("\r\n")), F.lit(""))


def _urn(column: str) -> F.Column:
    """The name of a page, without its closing mark; ids of any type, as percent-encoded text. Null for null."""
    return F.concat(F.lit("<urn:page:"), F.url_encode(F.col(column).cast("string")))


def _page(column: str, kind) -> F.Column:
    """The id in a name; null where there is none."""
    return F.when(F.col(column).startswith("<urn:page:"), F.url_decode(F.regexp_extract(column, r"^<urn:page:([^/>]*)", 1))).cast(kind)


def _marks(keys: DataFrame) -> DataFrame:
    """(id, digest, first, copied) of the rows (id, bytes, digest) that revisit first, or whose id other rows have too."""
    keys = written(keys, "payload-keys")
    total, long = keys.count(), keys.filter(F.col("bytes") >= LEAST_SHARED_BYTES).select("id", "digest")
    shared = long.groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).filter("n > 1 and first is not null")
    later = join_uneven(long, written(shared, "shared-payloads"), ["digest"], "n", total).filter("id is null or id <> first")
    pairs = keys.filter("id is not null").groupBy("id", "digest").agg(F.count("*").alias("n"))
    again = pairs.groupBy("id").agg(F.sum("n").alias("n")).filter("n > 1").select("id")
    copies = pairs.join(again, "id", "left_semi").select("id", "digest", F.lit(None).cast(keys.schema["id"].dataType).alias("first"), F.lit(True).alias("copied"))
    both = later.select("id", "digest", "first", F.lit(False).alias("copied")).unionByName(copies)
    return written(both.groupBy("id", "digest").agg(F.max("first").alias("first"), F.max("copied").alias("copied")), "payload-marks")


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", segment_bytes: int = SEGMENT_BYTES, chunk_bytes: int = CHUNK_BYTES) -> None:
    """Write gzipped WARC files below path, a record for each row or several if its block is long.

    Of rows with equal payloads of at least LEAST_SHARED_BYTES, those with the least id are responses and the others
    revisit them. Null payloads are empty. A null id, or one of several rows, still makes records of its own.
    """
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.coalesce(F.col(payload_col).cast("string"), F.lit("")).alias("payload"))
    digest = F.sha2(F.col("payload").cast("binary"), 256).alias("digest")
    marks = _marks(rows.select("id", F.octet_length("payload").cast("long").alias("bytes"), digest))
    # payloads are not shuffled, but for rows that may be marked: a bitmap of bounded size tells them by their ids
    maybe = F.lit(False) if marks.isEmpty() else maybe_in(pages.sparkSession.sparkContext.broadcast(key_bitmap(marks, "id")))("id")
    plain = rows.filter(~maybe).select("*", digest, F.lit(None).cast(pages.schema[id_col].dataType).alias("first"), F.lit(False).alias("copied"))
    asked = rows.filter(maybe).select("*", digest)
    judged = asked.join(marks, asked["id"].eqNullSafe(marks["id"]) & (asked["digest"] == marks["digest"]), "left")
    marked = plain.unionByName(judged.select(*[asked[c] for c in asked.columns], "first", F.coalesce("copied", F.lit(False)).alias("copied")))
    own = F.when(F.col("copied") | F.col("id").isNull(), F.concat(F.lit("/"), F.monotonically_increasing_id().cast("string"))).otherwise("")
    name = F.concat(F.coalesce(_urn("id"), F.lit("<urn:none:")), own, F.lit(">"))
    http = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    block = F.when(F.col("first").isNull(), F.concat(F.lit(f"{http}Transfer-Encoding: chunked\r\n\r\n"), _chunked(F.col("payload"), chunk_bytes))).otherwise(F.lit(f"{http}\r\n"))
    # the block is a column of its own before it is cut, or each piece would make it anew
    made = marked.select("id", F.regexp_replace("url", r"[\r\n]", "").alias("url"), "digest", "first", name.alias("name"), block.cast("binary").alias("block"))
    made = made.select("id", "url", "digest", "first", "name", F.octet_length("block").cast("long").alias("total"), _pieces(F.col("block"), segment_bytes).alias("pieces"))
    parts = made.withColumn("n", F.size("pieces")).select("*", F.posexplode("pieces").alias("k", "piece")).drop("pieces")
    many, start = F.col("n") > 1, F.col("k") == 0
    kind = F.when(~start, "continuation").when(F.col("first").isNull(), "response").otherwise("revisit")
    record = F.concat(
        F.lit(MARK),
        _field("WARC-Type", kind),
        _field("WARC-Record-ID", F.when(start, F.col("name")).otherwise(F.concat(F.regexp_replace("name", ">$", ""), F.lit("#"), F.col("k").cast("string"), F.lit(">")))),
        _field("WARC-Date", F.lit(_DATE)),
        _field("WARC-Target-URI", F.col("url")),
        _field("WARC-Payload-Digest", F.when(start, F.concat(F.lit("sha256:"), "digest"))),
        _field("WARC-Profile", F.when(F.col("first").isNotNull() & start, F.lit(REVISIT_PROFILE))),
        _field("WARC-Refers-To", F.when(start, F.concat(_urn("first"), F.lit(">")))),
        _field("WARC-Segment-Number", F.when(many, F.col("k") + 1)),
        _field("WARC-Segment-Origin-ID", F.when(~start, F.col("name"))),
        _field("WARC-Segment-Total-Length", F.when(~start & (F.col("k") == F.col("n") - 1), F.col("total"))),
        F.lit("Content-Type: application/http; msgtype=response\r\n"),
        _field("Content-Length", F.octet_length("piece")),
        F.lit("\r\n"),
        F.col("piece"),
    )
    parts.select(record.alias("value")).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").text(path)


_LENGTH = re.compile(rb"(?im)^content-length: *(\d+)")


def _complete(record: bytes) -> bool:
    """The block has as many bytes as the head says, or there is nothing to wait for."""
    head, found, block = record.partition(b"\r\n\r\n")
    said = _LENGTH.search(head)
    return not found or not said or len(block) >= int(said[1])


def _joined_again(lines: DataFrame, marker: str) -> DataFrame:
    """Lines (value, path), in the order of their files, with those joined again that a marker inside of a block has cut."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, of = None, None
        for batch in batches:
            out = []
            for value, path in zip(batch.column(0), batch.column(1).to_pylist()):
                if held is not None and path != of:
                    out.append(held)
                    held = None
                held, of = value.as_py() if held is None else held + marker.encode() + value.as_py(), path
                if _complete(held):
                    out.append(held)
                    held = None
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array([held], pa.binary())], ["value"])

    return lines.select(F.col("value").cast("binary"), "path").mapInArrow(run, "value binary").select(F.col("value").cast("string"))


def read_records(spark: SparkSession, path: str, marker: str = MARK, foreign: bool = False) -> DataFrame:
    """One row for each record: type, record_id, digest, refers_to, segment, origin_id, total_length, block, whole.

    Files are cut at the line that starts a record, which written blocks never hold. foreign: they may; what that cuts is
    joined again until a block has its Content-Length. That needs a file's lines in one task, as they are for gzipped
    files; in a plain file a record at the edge of two tasks may stay cut. whole is false where a block is too short.
    """
    lines = spark.read.option("lineSep", marker).text(path)
    if foreign:
        lines = _joined_again(lines.select("value", F.col("_metadata.file_path").alias("path")), marker)
    lines = lines.filter("value <> ''")
    head = F.substring_index("value", "\r\n\r\n", 1)
    rows = lines.select(F.concat(head, F.lit("\r\n")).alias("head"), F.col("value").cast("binary").alias("raw"))
    field = lambda name: F.nullif(F.regexp_extract("head", rf"(?im)^{name}: *([^\r\n]*)", 1), F.lit(""))
    size = field("Content-Length").cast("int")
    block = F.substring(F.col("raw"), F.octet_length("head") + 3, size)
    return rows.select(
        field("WARC-Type").alias("type"), field("WARC-Record-ID").alias("record_id"), F.regexp_replace(field("WARC-Payload-Digest"), "^sha256:", "").alias("digest"), field("WARC-Refers-To").alias("refers_to"),
        field("WARC-Segment-Number").cast("int").alias("segment"), field("WARC-Segment-Origin-ID").alias("origin_id"), field("WARC-Segment-Total-Length").cast("long").alias("total_length"),
        block.alias("block"), (F.octet_length(block) == size).alias("whole"),
    )


def reassemble(records: DataFrame) -> DataFrame:
    """Records as if they had not been segmented; whole also says that all segments and bytes are there.

    Only segmented records are shuffled. A group holds the segments of one record, never those of several.
    """
    single = records.filter("segment is null").select("type", "record_id", "digest", "refers_to", "block", "whole")
    parts = records.filter("segment is not null").withColumn("origin", F.coalesce("origin_id", "record_id"))
    one = F.col("segment") == 1
    groups = parts.groupBy("origin").agg(
        F.max(F.when(one, F.col("type"))).alias("type"), F.max(F.when(one, F.col("digest"))).alias("digest"), F.max(F.when(one, F.col("refers_to"))).alias("refers_to"),
        F.array_sort(F.collect_list(F.struct("segment", F.col("block").cast("string").alias("part")))).alias("parts"),
        F.max("total_length").alias("total"), F.bool_and("whole").alias("whole"), F.max("segment").alias("last"), F.countDistinct("segment").alias("different"), F.count("*").alias("n"),
    )
    joined = F.array_join(F.transform("parts", lambda p: p["part"]), "").cast("binary")
    complete = F.col("whole") & (F.col("last") == F.col("n")) & (F.col("different") == F.col("n")) & F.coalesce(F.octet_length("block") == F.col("total"), F.lit(False))
    groups = groups.withColumn("block", joined).select("type", F.col("origin").alias("record_id"), "digest", "refers_to", "block", complete.alias("whole"))
    return single.unionByName(groups)


def chunked_body(block: bytes) -> bytes | None:
    """The payload of an HTTP response; None if its framing is broken."""
    head, found, body = block.partition(b"\r\n\r\n")
    if not found:
        return None
    if b"transfer-encoding: chunked" not in head.lower():
        return body
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        try:
            size = int(body[at:end].split(b";")[0], 16) if end >= 0 else -1
        except ValueError:
            return None
        if size < 0 or end + 2 + size > len(body):
            return None
        if not size:
            return b"".join(out)
        out.append(body[end + 2 : end + 2 + size])
        at = end + 2 + size
        if body[at : at + 2] != b"\r\n":
            return None
        at += 2


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Whole records with their payload: type, record_id, digest, refers_to, payload (null if lengths or framing are wrong)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies = [chunked_body(b.as_py()) if ok.as_py() else None for b, ok in zip(batch.column(4), batch.column(5))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(bodies, pa.binary())], ["type", "record_id", "digest", "refers_to", "payload"])

    return reassemble(read_records(spark, path)).select("type", "record_id", "digest", "refers_to", "block", "whole").mapInArrow(run, "type string, record_id string, digest string, refers_to string, payload binary")


def archive_round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", path: str | None = None, **options) -> DataFrame:
    """Write pages as archives and describe what comes back, a row for each page.

    Returns id, payload_bytes, payload_digest, record_type and refers_to. Bytes and digest are those of the payload that
    was read: a revisit's are its response's. A record with wrong lengths, framing or digest raises an error. Null
    payloads are empty responses; null ids come back null; repeated rows repeat (of the least id all are responses). No
    rows give no rows; other columns are not read.
    """
    spark, kind = pages.sparkSession, pages.schema[id_col].dataType
    path = path or scratch(spark, "archives")
    write_archives(pages, path, id_col, url_col, payload_col, **options)
    back = read_archives(spark, path).select("type", _page("record_id", kind).alias("id"), _page("refers_to", kind).alias("refers_to"), "digest", F.octet_length("payload").cast("long").alias("bytes"), F.sha2("payload", 256).alias("found"))
    back = written(back, "read-records")
    sound = F.col("bytes").isNotNull() & (F.col("found") == F.col("digest"))
    responses = back.filter("type = 'response'").withColumn("bytes", F.when(sound, F.col("bytes")).otherwise(F.raise_error(F.concat(F.lit("damaged record of page "), F.col("id").cast("string"))).cast("long")))
    whole = responses.select("id", "bytes", "digest", "type", F.lit(None).cast(kind).alias("refers_to"))
    known = responses.filter("id is not null").groupBy("id", "digest").agg(F.max("bytes").alias("bytes")).withColumnRenamed("id", "refers_to")
    again = back.filter("type = 'revisit'").select("id", "digest", "type", "refers_to")
    wanted = again.groupBy("refers_to", "digest").agg(F.count("*").alias("n"))
    revisits = join_uneven(again, written(wanted.join(known, ["refers_to", "digest"]), "revisited"), ["refers_to", "digest"], "n", again.count()).select("id", "bytes", "digest", "type", "refers_to")
    return whole.union(revisits).select(F.col("id").alias(id_col), F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"), "refers_to")
