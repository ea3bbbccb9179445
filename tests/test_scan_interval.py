"""The bucketed operators equal their single-partition / brute-force forms."""
import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from fleetlens.operators.interval import interval_join
from fleetlens.operators.scan import bucketed_lead, bucketed_running, time_bucket
from conftest import ts


def _events(spark, n=400, keys=3, seed=7):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        # one hot key holding most rows
        k = "hot" if rnd.random() < 0.6 else f"k{rnd.randrange(keys)}"
        rows.append((i, k, rnd.randrange(0, 5 * 86400 * 1_000_000), rnd.randrange(10)))
    df = spark.createDataFrame(rows, "id long, k string, us long, v long")
    return df.withColumn("ts", F.timestamp_micros("us"))


def test_bucketed_lead_matches_window(spark):
    df = _events(spark).withColumn("b", time_bucket("ts", 3600))
    got = bucketed_lead(df, ["k"], "b", ["ts", "id"], ["ts", "v"], ["nts", "nv"])
    w = Window.partitionBy("k").orderBy("ts", "id")
    want = df.select("id", F.lead("ts").over(w).alias("nts"), F.lead("v").over(w).alias("nv"))
    a = sorted(got.select("id", "nts", "nv").collect())
    b = sorted(want.collect())
    assert a == b


def test_bucketed_running_matches_range_window(spark):
    df = (_events(spark).withColumn("b", time_bucket("ts", 7200))
          .withColumn("x", F.when(F.col("v") % 3 == 0, F.col("ts"))))
    for fn, direction in [("max", "preceding"), ("min", "following")]:
        got = bucketed_running(df, ["k"], "b", "us", "x", "r", fn=fn, direction=direction)
        frame = (Window.unboundedPreceding, -1) if direction == "preceding" else (1, Window.unboundedFollowing)
        w = Window.partitionBy("k").orderBy("us").rangeBetween(*frame)
        agg = F.max if fn == "max" else F.min
        want = df.select("id", agg("x").over(w).alias("r"))
        assert sorted(got.select("id", "r").collect()) == sorted(want.collect())


def test_running_sum_without_partition(spark):
    df = _events(spark).withColumn("b", time_bucket("ts", 3600))
    got = bucketed_running(df, [], "b", "us", "v", "r", fn="sum", strict=False)
    w = Window.orderBy("us").rangeBetween(Window.unboundedPreceding, 0)
    want = df.select("id", F.sum("v").over(w).alias("r"))
    assert sorted(got.select("id", "r").collect()) == sorted(want.collect())


def test_interval_join_matches_brute_force(spark):
    rnd = random.Random(3)
    iv = []
    for i in range(60):
        s = rnd.randrange(0, 4 * 86400)
        iv.append((i, "hot" if i % 2 else "k1", s, s + rnd.randrange(0, 3 * 86400)))
    ivdf = (spark.createDataFrame(iv, "iid long, k string, s long, e long")
            .select("iid", "k", F.timestamp_seconds("s").alias("start"), F.timestamp_seconds("e").alias("end")))
    pts = _events(spark).select("id", "k", "ts")
    got = interval_join(ivdf, pts, ["k"], "start", "end", "ts", bucket_seconds=3600)
    want = ivdf.join(pts, (ivdf.k == pts.k) & pts.ts.between(ivdf.start, ivdf.end)).select("iid", "id")
    assert sorted(got.select("iid", "id").collect()) == sorted(want.collect())
    auto = interval_join(ivdf, pts, ["k"], "start", "end", "ts", bucket_seconds="auto", target_rows=2)
    assert sorted(auto.select("iid", "id").collect()) == sorted(want.collect())
    left = interval_join(ivdf, pts.filter("k = 'k1'"), ["k"], "start", "end", "ts", how="left")
    n_left = ivdf.join(pts.filter("k = 'k1'"), (ivdf.k == pts.k) & pts.ts.between(ivdf.start, ivdf.end),
                       "left").count()
    assert left.count() == n_left


def test_adaptive_widths_narrow_hot_keys(spark):
    from fleetlens.operators.interval import key_bucket_widths
    w = {r.k: r._bucket_us for r in key_bucket_widths(_events(spark), ["k"], "ts", target_rows=2).collect()}
    assert w["hot"] < w["k0"] <= 6 * 3600 * 1_000_000
