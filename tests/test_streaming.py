"""Streams over several files in any order equal the batch queries; a restart goes on."""

import os
import uuid

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from fleetlens import binding as B
from fleetlens import registry as R
from fleetlens.session import ensure_checkpoint_dir
from fleetlens.streaming import incremental as INC


@pytest.fixture(scope="module")
def shuffled(spark, tmp_path_factory):
    """The events of sf0.001 as six files, newest rows first."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    top = tmp_path_factory.mktemp("stream")
    ev = B.table(spark, SF_SMALL, "events").toPandas().sort_values("ts", ascending=False)
    folder = top / "events.parquet"
    folder.mkdir()
    step = -(-len(ev) // 6)
    for k in range(6):
        ev.iloc[k * step : (k + 1) * step].to_parquet(folder / f"part-{k}.parquet", index=False, coerce_timestamps="us")
    return str(top)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_counts_equal_batch_and_restart(spark, shuffled):
    got = INC.stream_counts(spark, shuffled)
    want = (B.executor_events(B.table(spark, shuffled, "events"))
            .groupBy(F.window("evt_ts", "1 day")["start"].alias("window_start"), "cluster_name", "executor_event")
            .agg(F.count(F.lit(1)).alias("events")))
    assert rows(got) == rows(want)
    assert sum(r.events for r in got.collect()) == B.table(spark, shuffled, "events").count()
    assert rows(INC.stream_counts(spark, shuffled)) == rows(want)  # the second run finds its offsets


def test_executor_counts_equal_batch(spark, shuffled):
    got = INC.stream_executor_counts(spark, shuffled)
    want = R.queries()["executor_running_counts"](spark, shuffled)
    assert rows(got.select(*want.columns)) == rows(want)


def counts(spark, top):
    return rows(B.executor_events(B.table(spark, top, "events"))
                .groupBy(F.window("evt_ts", "1 day")["start"].alias("window_start"), "cluster_name", "executor_event")
                .agg(F.count(F.lit(1)).alias("events")))


def test_replaced_file_is_read(spark, tmp_path):
    ev, path, top = B.table(spark, SF_SMALL, "events").toPandas(), tmp_path / "events.parquet", str(tmp_path)
    for part in (ev.iloc[:300], ev.iloc[200:700]):
        part.to_parquet(path, index=False, coerce_timestamps="us")
        spark.catalog.refreshByPath(str(path))
        assert rows(INC.stream_counts(spark, top)) == counts(spark, top)
        want = R.queries()["executor_running_counts"](spark, top)
        assert rows(INC.stream_executor_counts(spark, top).select(*want.columns)) == rows(want)


def test_named_stream_takes_a_late_old_file(spark, tmp_path):
    ev, folder, top = B.table(spark, SF_SMALL, "events").toPandas(), tmp_path / "events.parquet", str(tmp_path)
    folder.mkdir()
    for k, days in enumerate((0, 30)):
        path = folder / f"part-{k}.parquet"
        ev.iloc[k * 300 : k * 300 + 300].to_parquet(path, index=False, coerce_timestamps="us")
        os.utime(path, times=(os.stat(path).st_mtime - days * 86400,) * 2)
        spark.catalog.refreshByPath(str(folder))
        assert rows(INC.stream_counts(spark, top, name="late")) == counts(spark, top)
        want = R.queries()["executor_running_counts"](spark, top)
        assert rows(INC.stream_executor_counts(spark, top, name="late").select(*want.columns)) == rows(want)


def test_checkpoint_folder_is_kept(spark):
    assert ensure_checkpoint_dir(spark) == ensure_checkpoint_dir(spark)
    assert uuid.uuid4().hex not in ensure_checkpoint_dir(spark)
