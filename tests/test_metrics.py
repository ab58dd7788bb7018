import random

from pyspark.sql import functions as F

from siftmark.operators import export, metrics
from siftmark.plans.slices import deal_in_order, previous_value, running_sum
from siftmark.sources import tables


def test_histogram_example(spark):
    df = spark.createDataFrame([("s", v) for v in (5.0, 5.01, 5000.0, 5001.0)], "service string, ms double")
    h = metrics.latency_histogram(df, ["service"], "ms")
    got = {r.le: r.bucket_count for r in h.collect()}
    assert (got["5"], got["10"], got["5000"], got["+Inf"]) == (1, 2, 3, 4)
    ordered = [r.bucket_count for r in h.orderBy("bound").collect()]
    assert ordered == sorted(ordered)
    assert metrics.histogram_quantile(h, ["service"], {"p99": 0.99, "p25": 0.25}).first()[1:] == (5000, 5)
    parts = spark.createDataFrame([("s", 5.0, 1), ("s", 10.0, 1), ("s", float("inf"), 2)], "service string, bound double, n int")
    assert [r.bucket_count for r in metrics.cumulate_buckets(parts, ["service"]).orderBy("bound").collect()] == [1, 2, 4]


def test_quantile_without_observations(spark):
    df = spark.createDataFrame([("s", 5.0, 0), ("s", float("inf"), 0)], "service string, bound double, bucket_count int")
    assert metrics.histogram_quantile(df, ["service"], {"p": 0.5}).first().p is None


def test_rate_with_reset(spark):
    rows = [("m", t, v) for t, v in ((0, 10.0), (20, 16.0), (40, 4.0), (61, 10.0))]
    df = spark.createDataFrame(rows, "metric string, t long, value double").withColumn("ts", F.timestamp_seconds("t"))
    got = metrics.counter_rate(df, ["metric"], 60).orderBy("window_start").collect()
    assert [round(r.rate * 60, 6) for r in got] == [10.0, 6.0]


def test_parts_equal_one_window(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["hot", "hot", "hot", "b", None]), rng.randrange(0, 5000), i, rng.randrange(-3, 4)) for i in range(2000)]
    df = spark.createDataFrame(rows, "k string, t long, id long, v int").withColumn("ts", F.timestamp_seconds("t"))
    total, last, want = {}, {}, {}
    for k, t, i, v in sorted(rows, key=lambda r: (r[1], r[2])):
        total[k] = total.get(k, 0) + v
        want[i] = (total[k], last.get(k))
        last[k] = v
    for parts in (1, 3, 17, None):
        s = running_sum(df, ["k"], "ts", ["id"], F.col("v"), "sum", parts)
        both = previous_value(s, ["k"], "ts", ["id"], "v", "prev", parts)
        assert {r.id: (r.sum, r.prev) for r in both.collect()} == want


def test_small_batches_carry_on(spark):
    """The scan inside a part goes on from one Arrow batch to the next."""
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        df = spark.range(500).select((F.col("id") % 3).alias("k"), F.col("id"), F.timestamp_seconds("id").alias("ts"), F.when(F.col("id") % 5 > 0, F.col("id") * 0.5).alias("v"))
        s = running_sum(df, ["k"], "ts", ["id"], F.col("v"), "sum", 2)
        rows = previous_value(s, ["k"], "ts", ["id"], "v", "prev", 2).orderBy("id").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    total, last = {}, {}
    for r in rows:
        total[r.k] = total.get(r.k, 0) + (r.v or 0)
        assert (r.sum, r.prev) == (total[r.k], last.get(r.k))
        last[r.k] = r.v


def test_one_hot_hour_is_spread(spark):
    """A key with all rows in one hour lies in many parts of about equal size."""
    df = spark.range(4000).select(F.lit("q").alias("k"), "id", F.timestamp_seconds(F.col("id") % 3600).alias("ts"))
    sizes = [r["count"] for r in deal_in_order(df, ["k"], "ts", ["id"], 8).groupBy("_part").count().collect()]
    assert len(sizes) == 8 and max(sizes) < 2 * 4000 / 8


def test_bands(spark):
    df = spark.createDataFrame([(v,) for v in (-1.0, 0.0, 5.0, 19.9, 20.0)], "v double")
    assert [r[0] for r in df.select(metrics.band(F.col("v"))).collect()] == [None, "green", "yellow", "yellow", "red"]


def test_exposition_round_trip(spark):
    rows = [
        ("svc", "ms_bucket", "histogram", "5", 3.0), ("svc", "ms_bucket", "histogram", "+Inf", 4.0), ("svc", "ms_sum", "histogram", None, 12.5),
        ("svc", "ms_count", "histogram", None, 4.0), ("svc", "seen_total", "counter", None, 7.0), ("svc", "depth", "gauge", None, -2.0),
    ]
    df = spark.createDataFrame(rows, "service string, metric string, kind string, le string, value double")
    text = export.exposition(df).orderBy("family", "place", "bound").select("text").collect()
    assert [r.text for r in text] == [
        "# TYPE svc_depth gauge", "svc_depth -2", "# TYPE svc_ms histogram", 'svc_ms_bucket{le="5"} 3', 'svc_ms_bucket{le="+Inf"} 4',
        "svc_ms_sum 12.500", "svc_ms_count 4", "# TYPE svc_seen_total counter", "svc_seen_total 7",
    ]
    lines = export.exposition(df).withColumn("ts", F.timestamp_seconds(F.lit(0))).select("service", "ts", "text")
    back = tables.parse_exposition(lines).select("service", "metric", "kind", "le", "value").collect()
    assert sorted(map(str, back)) == sorted(map(str, df.collect()))
