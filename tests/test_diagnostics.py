"""Exit-code signals, driver overrides and the master promotion ladder."""
from fleetlens.plans import diagnostics as DG


def test_promotion_ladder_examples(spark):
    lad = {r.machine_type: r.promoted_machine_type for r in DG.promotion_ladder(spark).collect()}
    assert len(lad) == 173
    assert lad["n2-highcpu-32"] == "n2-standard-32"      # variant step
    assert lad["n2-standard-32"] == "n2-highmem-32"      # variant step
    assert lad["n2-highmem-32"] == "n2-highmem-48"       # core step
    assert lad["e2-standard-32"] == "n2-standard-32"     # cross family (no e2-highmem-32)
    assert lad["e2-standard-16"] == "e2-highmem-16"
    assert lad["c4-highmem-288"] == "c4-highmem-288"     # nothing above: unchanged


def test_exit_signals_and_override(spark):
    rows = [("2026-01-01 10:00:00", "j1", '"c1"', "247"), ("2026-01-01 11:00:00", "j2", "c1", "247"),
            ("2026-01-01 12:00:00", "j1", "c1", "247"), ("2026-01-01 09:00:00", "j9", "c1", "1"),
            ("2026-01-01 09:00:00", "j8", "c1", "143"), ("2026-01-01 09:30:00", "j7", "c1", "143"),
            ("2026-01-01 09:00:00", "j5", "c2", "x")]
    b14 = spark.createDataFrame(rows, "timestamp string, job_id string, cluster_name string, driver_exit_code string")
    sig = {r.cluster_name: r for r in DG.exit_signals(DG.exit_codes(b14)).collect()}
    assert set(sig) == {"c1"}
    c1 = sig["c1"]
    assert (c1.eviction_count, c1.evicted_jobs, c1.sample_jobs) == (3, 2, ["j1", "j2"])
    assert c1.eviction_description == "YARN driver evicted 3 time(s) (exit 247). Sample jobs: j1, j2"
    assert (c1.dominant_exit_code, c1.dominant_count) == (143, 2)
    ov = DG.driver_overrides(DG.exit_signals(DG.exit_codes(b14))).first()
    assert (ov.driver_memory_gb, ov.driver_cores, ov.driver_memory_overhead_gb) == (8, 4, 2)
