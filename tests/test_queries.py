"""Registered queries against their SQL on the smallest tables."""

import math
import os

import pytest

from tracewright import catalog

SF = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")

#: One query or two of each kind here; all of them run in the driver's own comparison.
CHOSEN = ["f1_syscall_names", "f11_agent_messages", "w1_anchored_windows", "w6_rolling_rates", "a3_ngram_vectors", "a17_robust_baselines", "g5_confirmed_alerts", "g10_decisions", "g16_temporal_confirmation", "j3_overlap_labels", "j9_censored_attribution", "t3_block_bootstrap", "r7_repaired_split", "q1_window_contract", "m8_conformal_p", "x2_log_reconciliation", "s4_node_union", "st_sequence_rule", "g8_fused_confirmation", "g15_statuses", "g19_ablation", "a23_graph_features", "q2_injection_contract", "q8_accounting_identities", "st_idle_flush", "st_departed_keys"]


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 5) + 0.0
    return v


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return c


@pytest.mark.parametrize("name", CHOSEN)
def test_like_sql(spark, con, name):
    rows = catalog.QUERIES[name](spark, SF)
    cols = sorted(rows.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in rows.collect()), key=repr)
    cur = con.execute(catalog.ORACLES[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    want = sorted((tuple(plain(dict(zip(names, r))[c]) for c in cols) for r in cur.fetchall()), key=repr)
    assert got == want


@pytest.mark.parametrize("name", ["s4_all_nodes", "x3_order_coverage"])
def test_whole_tables_like_sql(spark, con, name):
    test_like_sql(spark, con, name)


def test_all_nodes_hold_all_events(spark):
    rows = catalog.QUERIES["s4_all_nodes"](spark, SF).collect()
    assert sum(r.n for r in rows) == spark.read.parquet(f"{SF}/events.parquet").count() and len(rows) > 3


def test_the_flagship_decides(spark):
    import __spark_entry__ as entry

    assert {"calibrating", "low_event_skip", "pod_startup_grace"} <= {r.decision for r in entry.entry(spark).collect()}
    rows = catalog.QUERIES["g10_decisions"](spark, SF.replace("0.001", "0.01")).collect()
    assert {r.decision for r in rows} == {"normal", "behavior_gated", "calibrating", "low_event_skip", "collection_quality_skip", "pod_startup_grace", "pending_confirmation", "detection", "cooldown"}
    assert {r.path for r in rows} == {"", "hard_ml", "hysteresis_ml", "extreme_volume_ml", "fast_path_behavior_ml_floor", "behavior_persistence_ml_floor"}


@pytest.mark.parametrize("name, column", [("f19_event_digest", "verified"), ("j12_identity_checks", "other_run"), ("q8_accounting_identities", "rate_agrees"), ("q9_single_identity", "one_model")])
def test_checks_can_fail(spark, name, column):
    assert {r[column] for r in catalog.QUERIES[name](spark, SF).select(column).distinct().collect()} == {True, False}


def test_every_oracle_has_a_query():
    assert set(catalog.ORACLES) <= set(catalog.QUERIES) and catalog.FLAGSHIP in catalog.QUERIES
