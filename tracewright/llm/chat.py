"""Quotation linking: quoted passages lead back to the messages they come from, and replies lose their quotes.

DataFrame functions only. Lines are parsed inside each row; messages meet by hashes of normalised passages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from tracewright.llm.shared import join_uneven, written

#: Turns that one as-of group spans at most before its last turn is handed on; parts large groups.
TURN_SPAN = 1024


def normalised(text) -> F.Column:
    """Lower case, runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def passage_hash(text) -> F.Column:
    return F.md5(normalised(text).cast("binary"))


def parse_quotes(messages: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds own_text (the lines without quote marks) and quotes, an array of (level, passage): the runs of equal level.

    A line's level is the number of its leading >, each with at most one blank after it. Null counts as empty.
    """
    lines = F.transform(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n"), lambda s: F.struct(F.length(F.regexp_replace(F.regexp_extract(s, r"^((?:> ?)*)", 1), " ", "")).alias("level"), F.regexp_replace(s, r"^(?:> ?)*", "").alias("line")))
    join = lambda some: F.array_join(F.transform(some, lambda x: x["line"]), "\n")
    starts = F.filter(F.sequence(F.lit(0), F.size("_lines") - 1), lambda i: (i == 0) | (F.col("_lines")[i]["level"] != F.col("_lines")[F.greatest(i - 1, F.lit(0))]["level"]))
    # the start after the k-th, or the end
    runs = F.transform("_starts", lambda s, k: F.struct(F.col("_lines")[s]["level"].alias("level"), join(F.slice(F.col("_lines"), s + 1, F.coalesce(F.get(F.col("_starts"), k + 1), F.size("_lines")) - s)).alias("passage")))
    return (
        messages.withColumn("_lines", lines)
        .withColumn("_starts", starts)
        .withColumn("own_text", F.trim(F.regexp_replace(join(F.filter("_lines", lambda x: x["level"] == 0)), r"^\n+|\n+$", "")))
        .withColumn("quotes", F.filter(runs, lambda r: (r["level"] > 0) & (normalised(r["passage"]) != "")))
        .drop("_lines", "_starts")
    )


def _last_before(quotes: DataFrame, originals: DataFrame) -> DataFrame:
    """quotes with source_turn: the last turn before their own in which the conversation has the passage."""
    sides = quotes.select("conv", "hash", "turn", "at", F.lit(None).cast("long").alias("seen")).unionByName(originals.select("conv", "hash", "turn", F.lit(None).cast("int").alias("at"), F.col("turn").alias("seen")))
    sides = sides.withColumn("span", F.floor(F.col("turn") / TURN_SPAN).cast("long"))
    spans = sides.groupBy("conv", "hash", "span").agg(F.max("seen").alias("last"))
    before = Window.partitionBy("conv", "hash").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select("conv", "hash", "span", F.max("last").over(before).alias("carried"))
    inside = Window.partitionBy("conv", "hash", "span").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    found = sides.withColumn("near", F.max("seen").over(inside)).filter("at is not null")
    return found.join(spans, ["conv", "hash", "span"]).select("conv", "turn", "at", "hash", F.coalesce("near", "carried").alias("source_turn"))


def _sources(units: DataFrame, originals: DataFrame) -> DataFrame:
    """units (conv, turn, at, hash) with source_conv and source_turn: the last earlier turn of the conversation that has
    the passage, else the least (conv, turn) of the other conversations, else null."""
    near = written(_last_before(units, originals), "near-links")
    lost = near.filter("source_turn is null").drop("source_turn")
    quoted = lost.groupBy("hash").agg(F.count("*").alias("quoted"))
    # the least turns of the two least conversations: one of them is not the message's own
    least = originals.groupBy("hash", "conv").agg(F.min("turn").alias("turn")).withColumn("k", F.row_number().over(Window.partitionBy("hash").orderBy("conv"))).filter("k <= 2")
    least = least.groupBy("hash").agg(*[F.max(F.when(F.col("k") == k, F.struct("conv", "turn"))).alias(name) for k, name in ((1, "first"), (2, "second"))])
    # a passage may be quoted by very many messages: its source is found once and then joined without one task for all
    known = written(quoted.join(least, "hash", "left"), "far-sources")
    source = F.when(F.col("first.conv") != F.col("conv"), F.col("first")).otherwise(F.col("second"))
    far = join_uneven(lost, known, ["hash"], "quoted", near.count()).withColumn("source", source)
    found = near.filter("source_turn is not null").select("conv", "turn", "at", "hash", F.col("conv").alias("source_conv"), "source_turn")
    return found.union(far.select("conv", "turn", "at", "hash", F.col("source.conv").alias("source_conv"), F.col("source.turn").alias("source_turn")))


def _parts(text) -> F.Column:
    """Hashes of a text's lines, and of its lines when they also end after each sentence."""
    pieces = F.concat(F.split(text, "\n"), F.split(F.regexp_replace(text, r"([.!?])\s+", "$1\n"), "\n"))
    return F.array_distinct(F.transform(F.filter(pieces, lambda t: normalised(t) != ""), passage_hash))


def _part_sources(quotes: DataFrame, keyed: DataFrame) -> DataFrame:
    """Sources of quoted passages that are no whole message or paragraph: each line and sentence has its source, and the
    one of most of them is the passage's, of equal ones the own conversation's, then the least (conv, turn)."""
    originals = keyed.select("conv", "turn", F.explode(_parts(F.col("own_text"))).alias("hash"))
    units = quotes.select("conv", "turn", "at", F.explode(_parts(F.col("passage"))).alias("hash"))
    votes = _sources(units, originals).filter("source_turn is not null").groupBy("conv", "turn", "at", "source_conv", "source_turn").agg(F.count("*").alias("n"))
    better = F.struct((-F.col("n")).alias("n"), (F.col("source_conv") != F.col("conv")).alias("elsewhere"), "source_conv", "source_turn")
    return votes.groupBy("conv", "turn", "at").agg(F.min(better).alias("best")).select("conv", "turn", "at", "best.source_conv", "best.source_turn")


def link_quotations(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Conversations in reply order without quotes; one row for each message.

    Returns conv_id, turn, role, own_text, n_quotes, n_linked, reply_conv and reply_turn (whose passage the first linked
    quote of level 1 is), root_conv, root_turn and depth; (root_conv, root_turn, depth, turn) is the reply order. A
    passage is looked for among whole messages and paragraphs: in the last earlier turn of its conversation, then in the
    least (conv_id, turn) of the others. If it is none of them, its lines and sentences are looked for in the same way,
    and the message that most of them come from is the source. A message without a linked quote is a root. Null texts
    are empty, messages without conv_id or turn are roots on their own; of repeated (conv_id, turn) rows each keeps its
    text, and the least quoting one gives the reply. conv_id may be of any type that can be ordered; a turn that is no
    number raises a TypeError. No rows give no rows; other columns are not read.
    """
    if not isinstance(messages.schema[turn_col].dataType, NumericType):
        raise TypeError(f"{turn_col} must be a number")
    read = messages.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    parsed = written(parse_quotes(read).drop("text"), "parsed")
    keyed = parsed.filter("conv is not null and turn is not null")
    originals = keyed.filter(normalised(F.col("own_text")) != "").select("conv", "turn", passage_hash(F.col("own_text")).alias("hash"), F.explode(F.split("own_text", r"\n\s*\n")).alias("part"))
    originals = originals.select("conv", "turn", F.explode(F.array_distinct(F.array("hash", passage_hash(F.col("part"))))).alias("hash")).distinct()
    quotes = keyed.select("conv", "turn", F.posexplode("quotes").alias("at", "quote")).select("conv", "turn", "at", F.col("quote.level").alias("level"), F.col("quote.passage").alias("passage"))
    hashed = quotes.withColumn("hash", passage_hash(F.col("passage"))).groupBy("conv", "turn", "at", "hash").agg(F.min("level").alias("level"))
    whole = written(hashed.join(_sources(hashed.drop("level"), originals), ["conv", "turn", "at", "hash"]), "whole-links")
    open_ = whole.filter("source_turn is null").select("conv", "turn", "at", "hash")
    partly = quotes.withColumn("hash", passage_hash(F.col("passage"))).join(open_, ["conv", "turn", "at", "hash"], "left_semi").groupBy("conv", "turn", "at").agg(F.min("passage").alias("passage"))
    partly = _part_sources(partly, keyed).select("conv", "turn", "at", F.col("source_conv").alias("part_conv"), F.col("source_turn").alias("part_turn"))
    linked = whole.join(partly, ["conv", "turn", "at"], "left").withColumns({"source_conv": F.coalesce("source_conv", "part_conv"), "source_turn": F.coalesce("source_turn", "part_turn")})
    replies = linked.groupBy("conv", "turn").agg(
        F.count("source_turn").alias("n_linked"),
        F.min(F.when((F.col("level") == 1) & F.col("source_turn").isNotNull(), F.struct("at", "source_conv", "source_turn"))).alias("reply"),
    )
    replies = written(replies.select("conv", "turn", "n_linked", F.col("reply.source_conv").alias("reply_conv"), F.col("reply.source_turn").alias("reply_turn")), "replies")
    trees = _roots(replies.filter("reply_turn is not null").select("conv", "turn", F.col("reply_conv").alias("up_conv"), F.col("reply_turn").alias("up_turn")))
    out = parsed.join(replies, ["conv", "turn"], "left").join(trees, ["conv", "turn"], "left")
    return out.select(
        F.col("conv").alias("conv_id"), "turn", "role", "own_text", F.size("quotes").alias("n_quotes"), F.coalesce("n_linked", F.lit(0)).alias("n_linked"),
        "reply_conv", "reply_turn", F.coalesce("up_conv", "conv").alias("root_conv"), F.coalesce("up_turn", "turn").alias("root_turn"), F.coalesce("depth", F.lit(0)).alias("depth"),
    )


def _roots(parents: DataFrame) -> DataFrame:
    """The root and depth of each message with a parent, by pointer doubling.

    A cycle (copies in two conversations that quote each other) would never end: its messages keep the pointer that
    they have when doubling adds no root.
    """
    now, left, done = written(parents.withColumn("depth", F.lit(1).cast("long")), "pointers"), None, None
    while True:
        known = now if done is None else now.unionByName(done)
        up = known.select(F.col("conv").alias("up_conv"), F.col("turn").alias("up_turn"), F.col("up_conv").alias("far_conv"), F.col("up_turn").alias("far_turn"), F.col("depth").alias("more"))
        # very many messages may have one parent, which is joined without one task for all of them
        above = written(now.groupBy("up_conv", "up_turn").agg(F.count("*").alias("n")).join(up, ["up_conv", "up_turn"], "left"), "parents")
        total, n = above.agg(F.sum("n"), F.sum(F.when(F.col("more").isNotNull(), F.col("n")))).first()
        if not n or n == left:
            return known
        left = n
        joined = written(join_uneven(now, above, ["up_conv", "up_turn"], "n", total), "joined-pointers")
        # what points to a root is not joined again
        ended = joined.filter("more is null").select(*now.columns)
        done = ended if done is None else done.unionByName(ended)
        now = joined.filter("more is not null").select("conv", "turn", F.col("far_conv").alias("up_conv"), F.col("far_turn").alias("up_turn"), (F.col("depth") + F.col("more")).alias("depth"))


def quoting_messages(conversations: DataFrame, levels: int = 3) -> DataFrame:
    """Mail-style messages from plain turns: each quotes the turn before, and that one's quotes, down to some levels.

    Where conv_id + turn is divisible by 3, of the turn before only the first two of its lines and sentences are quoted,
    if it has more. The first turns of odd conv_id quote the first turn of the conversation before. Earlier turns are met
    by (conv_id, turn); of repeated ones the least text is quoted.
    """
    base = conversations.select("conv_id", "turn", "role", "text")
    earlier = base.filter(F.col("text").isNotNull()).groupBy("conv_id", "turn").agg(F.min("text").alias("quoted"))
    out, body = base, F.coalesce(F.col("text"), F.lit(""))
    for k in range(1, levels + 1):
        out = out.join(earlier.select("conv_id", (F.col("turn") + k).alias("turn"), F.col("quoted").alias(f"quoted_{k}")), ["conv_id", "turn"], "left")
        mark, quoted = "> " * k, F.col(f"quoted_{k}")
        if k == 1:
            elsewhere = earlier.filter("turn = 0").select((F.col("conv_id") + 1).alias("conv_id"), "turn", F.col("quoted").alias("elsewhere"))
            out = out.join(elsewhere, ["conv_id", "turn"], "left")
            pieces = F.filter(F.split(F.regexp_replace(quoted, r"([.!?])\s+", "$1\n"), "\n"), lambda t: normalised(t) != "")
            partial = F.when(((F.col("conv_id") + F.col("turn")) % 3 == 0) & (F.size(pieces) > 2), F.array_join(F.slice(pieces, 1, 2), "\n")).otherwise(quoted)
            quoted = F.when((F.col("turn") == 0) & (F.col("conv_id") % 2 == 1), F.col("elsewhere")).otherwise(partial)
        body = F.concat(body, F.coalesce(F.concat(F.lit(f"\n{mark}"), F.regexp_replace(quoted, "\n", f"\n{mark}")), F.lit("")))
    return out.select("conv_id", "turn", "role", body.alias("text"))
