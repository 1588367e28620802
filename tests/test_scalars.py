"""Scalar rules against the values that they must give."""

from pyspark.sql import functions as F

from tracewright.functions import syscalls as S


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_kernel_names(spark):
    assert len(S.KERNEL_NAMES) == 40
    rows = spark.createDataFrame([("__x64_sys_accept4",), ("sys_writev",), ("do_exit",), (None,)], "f string")
    assert [r.x for r in rows.select(S.syscall_name(F.col("f")).alias("x")).collect()] == ["accept", "write", None, None]


def test_event_seconds(spark):
    for text, want in [("2024-01-01T00:00:00Z", 1704067200.0), ("2024-01-01T00:00:00.123456789Z", 1704067200.123456), ("2024-01-01T01:00:00+01:00", 1704067200.0), ("2024-01-01T00:00:00", 1704067200.0), ("never", 7.0)]:
        assert one(spark, S.event_seconds(F.lit(text), F.lit(7.0))) == want


def test_workloads(spark):
    for pod, want in [("ns/web-5d8c7b9f6d-x2x4z", "ns/web"), ("ns/db-0", "ns/db"), ("ns/plain", "ns/plain"), ("nothing", "nothing"), ("ns/a-b-12", "ns/a-b")]:
        assert one(spark, S.workload_of(F.lit(pod))) == want


def test_hash_bins(spark):
    assert one(spark, S.hash_bin_pair(F.lit(440), F.lit(257), 6)) in range(64)
    assert one(spark, S.hash_bin(F.lit(3).cast("long"), 6)) == ((3 * 2654435761) & 0xFFFFFFFF) >> 26


def test_wilson(spark):
    low = one(spark, S.wilson(F.lit(0), F.lit(100), S.Z_TWO_SIDED))
    high = one(spark, S.wilson(F.lit(0), F.lit(100), S.Z_TWO_SIDED, True))
    assert low == 0 and 0.03 < high < 0.04
    gate = lambda k, n: one(spark, S.wilson(F.lit(k), F.lit(n)) / 0.12) > 1
    assert not gate(2, 14) and gate(20, 100)


def test_techniques_and_risk(spark):
    ids = lambda names: [t.id for t in one(spark, S.techniques(F.array(*map(F.lit, names))))]
    assert ids(["execve", "read"]) == ["T1059"] and ids(["connect", "openat"]) == ["T1046", "T1041"]
    assert one(spark, S.is_high_risk(F.lit("kubectl"), F.array().cast("array<string>")))
    assert one(spark, S.is_high_risk(F.lit("read"), F.array(F.lit("/etc/token"))))
    assert not one(spark, S.is_high_risk(F.lit("read"), F.array(F.lit("/x"))))


def test_sparse_round_trip(spark):
    rows = spark.createDataFrame([([0.0, 1.5, 0.0, -2.0],)], "v array<double>")
    assert rows.select(S.dense(S.sparse(F.col("v")), 4).alias("x")).first().x == [0.0, 1.5, 0.0, -2.0]


def test_hash_bins_of_large_numbers(spark):
    """Products beyond a long wrap, also of negative numbers; null stays null."""
    numbers = [0, 65535, 65536, 53_000 << 16, 120_000, 2**40 + 12345, 2**63 - 1, -(2**63), -7, None]
    rows = spark.createDataFrame([(i, n) for i, n in enumerate(numbers)], "i int, n long")
    got = [tuple(r) for r in rows.select("i", S.hash_bin(F.col("n"), 6), S.hash_bin_pair(F.col("n"), F.lit(977), 6)).orderBy("i").collect()]
    bin_of = lambda n: ((n * 2654435761) & 0xFFFFFFFF) >> 26
    assert got == [(i, None if n is None else bin_of(n), None if n is None else bin_of((n << 16) ^ 977)) for i, n in enumerate(numbers)]
