"""Hand-checked step-function cost cases (segments, totals, worker stats)."""
import pytest
from pyspark.sql import functions as F

from fleetlens.plans import cost as CO
from conftest import ts

SPAN_SCHEMA = ("cluster_name string, incarnation_idx int, span_start_ts timestamp, span_end_ts timestamp, "
               "has_explicit_create boolean, has_explicit_delete boolean")
EVENT_SCHEMA = ("cluster_name string, event_ts timestamp, state string, current_primary_workers int, "
                "target_primary_workers int, recommendation_id string")


def spans(spark, *rows):
    return spark.createDataFrame([(c, i, ts(a), ts(b), True, True) for c, i, a, b in rows], SPAN_SCHEMA)


def events(spark, *rows):
    data = [("c1", ts(t), "RECOMMENDING", cur, tgt, f"r{n}") for n, (t, cur, tgt) in enumerate(rows)]
    return CO.cost_events(spark.createDataFrame(data or [], EVENT_SCHEMA))


def pricing(spark, worker, master, fallback):
    return spark.createDataFrame([("c1", worker, master, fallback)],
                                 "cluster_name string, worker_hourly_eur double, master_hourly_eur double, "
                                 "fallback_workers double")


def test_no_events_single_fallback_segment(spark):
    sp = spans(spark, ("c1", 1, "2026-01-01T08:00:00", "2026-01-01T10:00:00"))
    segs = CO.span_segments(sp, events(spark), pricing(spark, 1.0, 0.1, 4.0)).collect()
    assert len(segs) == 1
    s = segs[0]
    assert s.workers == 4.0 and s.seg_seconds == pytest.approx(7200.0)
    assert s.worker_cost_eur + s.master_cost_eur == pytest.approx(8.2)


def test_two_events_three_segments(spark):
    sp = spans(spark, ("c1", 1, "2026-01-01T08:00:00", "2026-01-01T10:00:00"))
    ev = events(spark, ("2026-01-01T08:30:00", 3, 5), ("2026-01-01T09:00:00", 5, 2))
    segs = CO.span_segments(sp, ev, pricing(spark, 1.0, 0.1, 99.0)).orderBy("from_ts").collect()
    assert [s.workers for s in segs] == [3.0, 5.0, 2.0]
    assert [s.seg_seconds for s in segs] == [1800.0, 1800.0, 3600.0]
    total = sum(s.worker_cost_eur + s.master_cost_eur for s in segs)
    assert total == pytest.approx(6.2)


def test_worker_stats_max_of_mins(spark):
    sp = spans(spark, ("c1", 1, "2026-01-01T08:00:00", "2026-01-01T08:02:00"),
               ("c1", 2, "2026-01-01T09:00:00", "2026-01-01T09:03:00"))
    ev = events(spark, ("2026-01-01T08:01:00", 4, 2), ("2026-01-01T09:00:00", 8, 8),
                ("2026-01-01T09:02:00", 8, 5))
    st = CO.worker_stats(CO.span_segments(sp, ev, pricing(spark, 0.0, 0.0, 99.0))).collect()[0]
    assert st.avg_workers == pytest.approx(5.4, abs=0.01)
    assert (st.min_workers, st.max_workers) == (5, 8)


def test_event_on_touching_spans_belongs_to_both(spark):
    sp = spans(spark, ("c1", 1, "2026-01-01T08:00:00", "2026-01-01T09:00:00"),
               ("c1", 2, "2026-01-01T09:00:00", "2026-01-01T10:00:00"))
    ev = events(spark, ("2026-01-01T09:00:00", 3, 6))
    segs = CO.span_segments(sp, ev, pricing(spark, 1.0, 0.0, 1.0)).orderBy("from_ts").collect()
    assert [(s.incarnation_idx, s.workers, s.seg_seconds) for s in segs] == [(1, 3.0, 3600.0), (2, 6.0, 3600.0)]


def test_mixed_autoscaler_states_keep_recommending_with_target(spark):
    rows = [("c1", ts("2026-01-01T08:00:00"), st, 2, tgt, None) for st, tgt in [
        ("RECOMMENDING", 3), ("COOLDOWN", None), ("recommending", 2), ("SCALING", 4),
        ("RECOMMENDING", None), ("INITIALIZING", None)]]
    ev = CO.cost_events(spark.createDataFrame(rows, EVENT_SCHEMA))
    assert sorted(r.target_primary_workers for r in ev.collect()) == [2, 3]


def test_synthetic_span_needs_two_distinct_events(spark):
    sp = spans(spark, ("c2", 1, "2026-01-01T08:00:00", "2026-01-01T09:00:00"))
    ev = events(spark, ("2026-01-01T08:00:00", 2, 3), ("2026-01-01T08:30:00", 3, 4))
    syn = CO.synthetic_spans(sp, ev).collect()
    assert len(syn) == 1 and syn[0].synthetic and syn[0].cluster_name == "c1"
    one = events(spark, ("2026-01-01T08:00:00", 2, 3))
    assert CO.synthetic_spans(sp, one).count() == 0


def test_address_peak_and_levels(spark):
    seg = spark.createDataFrame(
        [("a", 1, ts("2026-01-01T08:00:00"), ts("2026-01-01T10:00:00"), 100.0),
         ("b", 1, ts("2026-01-01T09:00:00"), ts("2026-01-01T11:00:00"), 99.0),
         ("c", 1, ts("2026-01-01T10:00:00"), ts("2026-01-01T12:00:00"), 5.0)],
        "cluster_name string, incarnation_idx int, from_ts timestamp, to_ts timestamp, workers double")
    p = CO.address_peak(seg).collect()[0]
    assert p.peak_ips == 201.0 and p.peak_ts == ts("2026-01-01T09:00:00") and p.level == "warn"
    alive = CO.alive_at(seg, "2026-01-01 10:00:00").collect()
    assert [(r.cluster_name, r.ips) for r in alive] == [("b", 100.0), ("c", 6.0)]
