"""Cases in which rows, links or ids were once lost."""

import tracemalloc
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tracewright.llm import chat, linear, quality, shared, toxicity, warc
from tracewright.sources import files

MESSAGE = "conv_id long, turn long, role string, text string"


def replies(spark, rows, schema=MESSAGE):
    got = chat.link_quotations(spark.createDataFrame(rows, schema)).collect()
    return {(r.conv_id, r.turn): (r.reply_conv, r.reply_turn) for r in got}


def test_a_source_in_another_conversation_is_not_hidden_by_the_own_one(spark):
    rows = [(1, 0, "u", "> hello there\nmine"), (1, 5, "u", "Hello  there"), (2, 0, "u", "hello there"), (3, 0, "u", "hello there"), (4, 0, "u", "> hello there")]
    assert replies(spark, rows) == {(1, 0): (2, 0), (1, 5): (None, None), (2, 0): (None, None), (3, 0): (None, None), (4, 0): (1, 5)}


def test_parts_of_messages_are_linked(spark):
    text = "First line. Second thought here!\nThird line\n\nfourth: a. b"
    rows = [
        (1, 0, "u", text),
        (1, 1, "a", "> third line\n> fourth: a. b\nanswer"),  # lines
        (1, 2, "a", "> Second  thought here!\nanswer"),  # a sentence
        (1, 3, "a", "> fourth: a. b\nanswer"),  # a paragraph
        (1, 4, "a", "> nothing of it\nlost"),
        (2, 0, "u", "First line.\nother words"),
        (3, 0, "u", "> first line.\n> third line\nfrom elsewhere"),  # one part of two messages, one of the first
        (3, 1, "u", "> other words\n> something else\nhalf known"),
    ]
    assert replies(spark, rows) == {(1, 0): (None, None), (1, 1): (1, 0), (1, 2): (1, 0), (1, 3): (1, 0), (1, 4): (None, None), (2, 0): (None, None), (3, 0): (1, 0), (3, 1): (2, 0)}


def test_conversations_may_have_ids_of_text(spark):
    rows = [("b/1", 0, "u", "hello"), ("b/1", 1, "u", "> hello\nyes"), ("a", 0, "u", "> hello\nno"), (None, 0, "u", "hello")]
    assert replies(spark, rows, MESSAGE.replace("conv_id long", "conv_id string")) == {("b/1", 0): (None, None), ("b/1", 1): ("b/1", 0), ("a", 0): ("b/1", 0), (None, 0): (None, None)}
    with pytest.raises(TypeError):
        chat.link_quotations(spark.createDataFrame([("a", "x", "u", "t")], MESSAGE.replace("long", "string")))


def test_archives_keep_ids_of_text(spark):
    ids = ["a/b", "a/c", "d>e", "#1", " ", "", "ü%2F", "<urn:page:x>", "a\nb", None]
    pages = spark.createDataFrame([(i, "http://x/", "same text " * 20 if k < 3 else f"text {k}") for k, i in enumerate(ids)], "page_id string, url string, html string")
    got = warc.archive_round_trip(pages, segment_bytes=64).collect()
    assert sorted(map(str, (r.page_id for r in got))) == sorted(map(str, ids))
    assert {r.page_id: r.refers_to for r in got if r.record_type == "revisit"} == {"a/c": "a/b", "d>e": "a/b"}


def labels_of(spark, rows, kind="long"):
    return spark.createDataFrame(rows, f"doc_id {kind}, quality int, toxic int")


@pytest.mark.parametrize("value", [None, 0, 1])
def test_labels_of_one_class_reject_nothing(spark, value):
    docs = spark.createDataFrame([(i, f"some words {i} here" if i % 2 else "bad &&& ###") for i in range(40)], "doc_id long, text string")
    labels = labels_of(spark, [] if value is None else [(i, value, value) for i in range(40)])
    assert quality.with_quality(docs, labels).count() == 40 and toxicity.without_toxic(docs, labels).count() == 40
    good, bad = quality.quality(docs, labels).collect(), toxicity.toxicity(docs, labels).collect()
    assert all(r.predicted == 1 and r.score >= 0.3 for r in good) and all(r.predicted == 0 and r.score < 0.5 for r in bad)


def test_pipeline_with_labels_of_one_class(spark, tmp_path):
    texts = [f"{i} " + " ".join(f"w{i * j % 97}" for j in range(30)) for i in range(12)]
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    labels_of(spark, [(i, 0, 1) for i in range(12)]).write.parquet(f"{tmp_path}/labels.parquet")
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == set(range(12))


@pytest.mark.parametrize("kind", ["string", "long"])
def test_ids_of_any_type_and_many_copies_are_examples(spark, kind):
    name = (lambda i: f"id/{i}") if kind == "string" else (lambda i: i)
    rows = [(name(i), "good words here" if i % 2 else "bad &&& ###") for i in range(40) for _ in range(9)]
    docs = spark.createDataFrame(rows, f"doc_id {kind}, text string")
    labels = labels_of(spark, [(name(i), i % 2, 1 - i % 2) for i in range(40)], kind)
    sample = linear.labelled_sample(docs, labels, "quality").collect()
    assert len(sample) == len({r.doc_id for r in sample}) > 20
    kept = quality.with_quality(docs, labels)
    assert kept.count() == 180 and kept.filter(F.col("text") == "good words here").count() == 180
    assert {r.text for r in toxicity.without_toxic(docs, labels).select("text").distinct().collect()} == {"good words here"}
    assert quality.quality(docs, labels).schema["doc_id"].dataType.simpleString() == docs.schema["doc_id"].dataType.simpleString()


def test_samples_look_further_where_few_labelled_documents_are_there(spark, monkeypatch):
    monkeypatch.setattr(linear, "MOST_ASKED", 100)
    docs = spark.createDataFrame([(i, f"t{i % 7} {i}") for i in range(30)], "doc_id long, text string")
    labels = labels_of(spark, [(i, i % 2, 0) for i in range(5000)])
    want = {r.doc_id for r in docs.filter(shared.is_training_row(F.col("doc_id"))).collect()}
    assert {int(r.doc_id) for r in linear.labelled_sample(docs, labels, "quality", 40).collect()} == want
    assert linear.labelled_sample(docs, labels, "quality", 5).count() == 5


def test_bitmaps_grow_with_their_keys(spark, monkeypatch):
    assert len(shared.key_bitmap(spark.range(10), "id")) == 1 << 17
    monkeypatch.setattr(shared, "LEAST_BITS", 1 << 16)
    bits = shared.key_bitmap(spark.range(10_000), "id")
    assert 8 * len(bits) == 1 << 18
    maybe = shared.maybe_in(spark.sparkContext.broadcast(bits))
    assert spark.range(10_000).filter(maybe("id")).count() == 10_000
    assert spark.range(20_000, 40_000).filter(maybe("id")).count() < 1500


def test_bitmaps_are_fetched_by_few_jobs(spark):
    """One job for each partition of a shuffle filled the driver's memory with what it keeps of jobs."""
    held = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in held}
    sc = spark.sparkContext
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        sc.setJobGroup("bitmap", "")
        bits = shared.key_bitmap(spark.range(1000), "id")
        jobs = len(sc.statusTracker().getJobIdsForGroup("bitmap"))
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert 1 <= jobs < 10
    assert shared.in_bitmap(bits, np.array([r[0] for r in spark.range(1000).select(shared.key_bit(8 * len(bits), "id")).collect()])).all()


def test_fits_hold_little_besides_their_rows():
    rng = np.random.default_rng(5)
    rows = [np.sort(rng.choice(2000, 500, replace=False)).astype(np.int32) for _ in range(1000)]
    y, ratio = rng.choice([-1, 1], 1000), rng.normal(size=2000)
    tracemalloc.start()
    quality.dual_coordinate_descent(y, rows, ratio, epochs=1)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < sum(x.nbytes for x in rows) / 2


def test_chosen_features_are_the_first_by_difference(spark):
    rows = [(k % 2, [f for f in range(40) if (k * (f + 3)) % 7 < (3 if k % 2 else 2) + f % 3]) for k in range(60)]
    table = spark.createDataFrame(rows, "label int, on array<int>").repartition(5)
    c1, c = (Counter(f for label, on in rows if label >= least for f in on) for least in (1, 0))
    rate = {f: c[f] / 60 for f in c if c[f] >= 3}
    z = {f: abs(c1[f] / 30 - (c[f] - c1[f]) / 30) / (r * (1 - r) + 1e-9) ** 0.5 for f, r in rate.items()}
    feature, got1, got0, n1, n0 = linear.class_counts(table, 25)
    assert (n1, n0, feature.tolist()) == (30, 30, sorted(z, key=lambda f: (-z[f], f))[:25])
    assert got1.tolist() == [c1[f] for f in feature] and got0.tolist() == [c[f] - c1[f] for f in feature]


def test_scratch_without_a_checkpoint_folder():
    class Conf:
        def get(self, key, default):
            return default

    class Context:
        master = "local[4]"

    class Session:
        conf, sparkContext = Conf(), Context()

    a, b = (files.scratch(Session, n) for n in "ab")
    assert a.rsplit("/", 2)[0] == b.rsplit("/", 2)[0] and a != b
    Context.master = "local-cluster[3,2,1000]"
    with pytest.raises(ValueError):
        files.scratch(Session, "a")
