"""Models applied where rows are read, and quantile sketches that are merged."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewright.operators import models, robust


@pytest.fixture(scope="module")
def vectors(spark):
    """A hot key, others, one without fitting rows, a null key and a null vector."""
    rng = random.Random(2)
    rows = []
    for i in range(900):
        k = "hot" if rng.random() < 0.8 else rng.choice(["a", "b", None, "new"])
        rows.append((k, i, [rng.gauss(0, 1 + d) for d in range(5)]))
    return spark.createDataFrame([*rows, ("a", 900, None)], "k string, i long, v array<double>").cache()


@pytest.mark.parametrize("limit", [models.MODEL_BYTES, 0])
def test_models_sent_or_joined_give_the_same(spark, vectors, monkeypatch, limit):
    monkeypatch.setattr(models, "MODEL_BYTES", limit)
    fit = vectors.filter("v is not null and not (k <=> 'new')")
    got = {r.i: r.error for r in models.reconstruction_error(vectors, models.fit_components(fit.filter("k is not null"), "k", "v", 2), "k", "i", "v").collect()}
    assert len(got) == 901
    for k in ("hot", "a", "b"):
        held = vectors.filter((F.col("k") == k) & F.col("v").isNotNull()).collect()
        x = np.array([r.v for r in held])
        y = x - x.mean(axis=0)
        _, _, vt = np.linalg.svd(y, full_matrices=False)
        want = ((y - y @ vt[:2].T @ vt[:2]) ** 2).mean(axis=1)
        assert np.allclose([got[r.i] for r in held], want)
    none = vectors.filter("k is null or k = 'new' or v is null").collect()
    assert none and all(got[r.i] is None for r in none)


def test_isolation_is_the_same_sent_or_joined(spark, vectors, monkeypatch):
    full = vectors.filter("v is not null")
    score = lambda: {r.i: r.isolation for r in models.isolation_scores(full, "k", "i", "v").collect()}
    sent = score()
    monkeypatch.setattr(models, "MODEL_BYTES", 0)
    assert score() == sent and all(0 < s < 1 for i, s in sent.items() if s is not None)
    assert models.isolation_scores(full.limit(0), "k", "i", "v").count() == 0


def test_merged_sketches_are_within_the_bound_of_the_whole(spark):
    rng = random.Random(4)
    rows = [("hot" if rng.random() < 0.9 else "b", rng.randint(0, 20), rng.lognormvariate(0, 2)) for _ in range(30000)] + [("b", 3, None), ("none", 1, None)]
    d = spark.createDataFrame(rows, "k string, day int, v double").repartition(6)
    qs = {"p1": 0.01, "p50": 0.5, "p90": 0.9, "p999": 0.999}
    daily = robust.quantile_sketches(d, ["k", "day"], "v")
    got = {r.k: r for r in robust.sketched_summary(robust.merged_sketches(daily, ["k"]), ["k"], qs).collect()}
    assert set(got) == {"hot", "b"}
    for k, r in got.items():
        x = np.sort([v for kk, _, v in rows if kk == k and v is not None])
        assert (r.n, r.least, r.largest) == (len(x), x[0], x[-1])
        for name, q in qs.items():
            low, high = np.searchsorted(x, r[name], "left") / len(x), np.searchsorted(x, r[name], "right") / len(x)
            assert low - robust.SKETCH_ERROR <= q <= high + robust.SKETCH_ERROR
    assert robust.quantile_sketches(d.limit(0), ["k"], "v").count() == 0


def test_a_small_sketch_is_exact(spark):
    d = spark.createDataFrame([("k", i % 7, float(i)) for i in range(1000)], "k string, day int, v double")
    r = robust.sketched_summary(robust.merged_sketches(robust.quantile_sketches(d, ["k", "day"], "v"), ["k"]), ["k"], {"p50": 0.5, "p99": 0.99}).first()
    assert (r.p50, r.p99) == (499.0, 989.0)


def test_attention_like_a_loop(spark):
    rng = random.Random(6)
    nodes = {f"n{i}": (float(rng.randint(0, 1)), rng.random() * 3, rng.random()) for i in range(30)} | {"bare": (0.0, 0.0, 0.0), "alone": (1.0, 1.0, 1.0)}
    ends = [n for n in nodes if n != "alone"]
    edges = [(*rng.sample(ends, 2), rng.randint(1, 5)) for _ in range(80)] + [("hub", "n1", 1)] + [("n0", n, 2) for n in ends[1:]]
    e = spark.createDataFrame(edges, "src string, dst string, n long")
    f = spark.createDataFrame([(k, *v) for k, v in nodes.items()], "node string, a double, b double, c double")
    both: dict = {}
    for s, d, n in edges:
        for x, y in ((s, d), (d, s)):
            if x in nodes and y in nodes:
                both[x, y] = both.get((x, y), 0) + n

    def layer(h: dict) -> dict:
        out = {}
        for x in h:
            near = [(y, n) for (a, y), n in both.items() if a == x and y in h]
            if near:
                v = {y: np.array(h[y]) for y, _ in near}
                norm = lambda u: float(np.sqrt((np.array(u) ** 2).sum()))
                w = np.array([n * np.exp(2 * (np.dot(h[x], v[y]) / (norm(h[x]) * norm(v[y])) if norm(h[x]) * norm(v[y]) else 0.0)) for y, n in near])
                out[x] = sum(wi * v[y] for wi, (y, _) in zip(w / w.sum(), near))
        return out

    one = layer(nodes)
    got = {r.node: (r.a, r.b, r.c) for r in models.attended(e, f, ["a", "b", "c"]).collect()}
    assert set(got) == set(one) == set(nodes) - {"alone"} and all(np.allclose(got[k], one[k]) for k in one)
    weights = models.attention_weights(e, f, ["a", "b", "c"])
    total = weights.groupBy("node").agg(F.sum("weight").alias("t"))
    shares = weights.join(total, "node").groupBy("node").agg(F.sum(F.col("weight") / F.col("t")).alias("s")).collect()
    assert all(abs(r.s - 1) < 1e-9 for r in shares)
    two = layer(one)
    x, y = np.array([nodes[k] for k in two]), np.array([two[k] for k in two])
    rest = np.stack([(x[:, i] - np.polyval(np.polyfit(y[:, i], x[:, i], 1), y[:, i])) ** 2 for i in range(3)], axis=1)
    errors = {r.node: (r.error, r.worst) for r in models.attention_error(e, f, ["a", "b", "c"]).collect()}
    assert set(errors) == set(two)
    assert np.allclose([errors[k][0] for k in two], rest.mean(axis=1))
    assert [errors[k][1] for k in two] == ["abc"[i] for i in rest.argmax(axis=1)]
    assert models.attention_error(e.limit(0), f, ["a", "b", "c"]).count() == 0
