import json

import pytest
from pyspark.sql import functions as F

from siftmark import schemas
from siftmark.operators import audit, rollup, sequences
from siftmark.operators.scan import ScanOptions, scan_files
from siftmark.sources import rules as R
from siftmark.streaming import metrics as SM
from siftmark.streaming import scan as SS
from siftmark.streaming import sequences as SQ


def drops(df, path, order, n=3):
    """The rows as n files that arrive one after the other, in order."""
    import os
    import time

    rows = df.orderBy(*order).collect()
    step = -(-len(rows) // n)
    for i in range(n):
        part = df.sparkSession.createDataFrame(rows[i * step:(i + 1) * step], df.schema)
        part.coalesce(1).write.mode("append").parquet(f"{path}/drop")
        stamp = time.time() - 1000 + 10 * i
        for f in os.listdir(f"{path}/drop"):
            full = f"{path}/drop/{f}"
            if f.startswith("part") and os.path.getmtime(full) > stamp + 500:
                os.utime(full, (stamp, stamp))
    return f"{path}/drop"


def source(spark, df, path, order, n=3):
    folder = drops(df, path, order, n)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def finish(query):
    query.awaitTermination(300)
    assert query.exception() is None


def collected(spark, df, tmp_path, mode="append"):
    out = str(tmp_path / "out")
    finish(SS.stream_append(df, out, str(tmp_path / "cp"), True, mode))
    return spark.read.parquet(out)


@pytest.fixture(scope="module")
def events(spark):
    path = "/root/testdata/sf0.001/events.parquet"
    return spark.read.parquet(path).withColumn("ts", F.col("ts").cast("timestamp")).where("user_id < 12")


def test_scan(spark, tmp_path):
    rules = [R.Rule("R-1", R.Pattern("regex", "bad"), severity="high", category="quality", languages=("*",), message="m", enabled=True)]
    rows = [(f"j{i}", f"f{k}.py", "python", "bad\n" * (i % 3)) for i in range(6) for k in range(2)]
    df = spark.createDataFrame(rows, schemas.FILES)
    opts = ScanOptions(deps=False)
    out = str(tmp_path / "out")
    finish(SS.stream_scan(source(spark, df, str(tmp_path), ["path", "job_id"]), rules, out, str(tmp_path / "cp"), opts, True))
    for closing, some in enumerate((df.where("job_id < 'j3'"), df, df)):
        SS.close_jobs(spark, out, some, closing, opts, "key", ("slack", "email"))
    batch = scan_files(df, rules, opts)
    assert sorted(map(str, SS.read_findings(spark, out).drop("batch_id").collect())) == sorted(map(str, batch.collect()))
    one = SS.read_findings(spark, out, df.where("job_id = 'j2'"))
    assert one.count() == 4 and {r.job_id for r in one.collect()} == {"j2"}
    summary = SS.read_output(spark, out, "summary").select("job_id", "total_findings", "score", "passed")
    want = rollup.summarise(batch, df).select("job_id", "total_findings", "score", "passed")
    assert sorted(summary.collect()) == sorted(want.collect())
    assert SS.read_output(spark, out, "verdict").where("blocked").count() == 4
    log = SS.read_output(spark, out, "audit")
    assert all(r.valid for r in audit.verify_audit(log, "key").collect())
    assert {r.actor for r in log.collect()} == {"analysis-service"} and log.count() == 6
    assert json.loads(log.where("job_id = 'j1'").first().payload)["result"]["total_findings"] == 2
    box = SS.read_output(spark, out, "outbox").collect()
    assert sorted((r.target, r.state) for r in box) == [("email", "no recipients configured")] * 6 + [("slack", "ready")] * 6


def test_a_closing_reads_only_the_buckets_of_its_jobs(spark, tmp_path):
    rules = [R.Rule("R-1", R.Pattern("regex", "bad"), severity="high", category="quality", languages=("*",), message="m", enabled=True)]
    df = spark.createDataFrame([(f"j{i}", f"f{k}.py", "python", "bad\n" * (i + 1)) for i in range(5) for k in range(2)], schemas.FILES)
    out, opts = str(tmp_path / "out"), ScanOptions(deps=False, max_findings=3)
    finish(SS.stream_scan(source(spark, df, str(tmp_path), ["path", "job_id"]), rules, out, str(tmp_path / "cp"), opts, True))
    own = df.where("job_id = 'j1'")
    [bucket] = [r.b for r in own.select(SS.bucket_of(F.col("job_id")).alias("b")).distinct().collect()]
    others = {r.b for r in df.where("job_id <> 'j1'").select(SS.bucket_of(F.col("job_id")).alias("b")).collect()}
    assert bucket not in others
    for name, schema in (("partials", SS._PARTIAL), ("first", schemas.FINDINGS), ("findings", schemas.FINDINGS)):
        read = SS.read_bucketed(spark, out, name, schema, own).inputFiles()
        assert read and all(f"/bucket={bucket}/" in f for f in read)
    SS.close_jobs(spark, out, own, 0, opts)
    first = SS.read_output(spark, out, "summary").drop("batch_id").collect()
    assert [(r.job_id, r.total_findings) for r in first] == [("j1", 3)]
    SS.close_jobs(spark, out, own, 0, opts)  # a closing that runs again writes the same, its time included
    assert SS.read_output(spark, out, "summary").drop("batch_id").collect() == first
    SS.close_jobs(spark, out, own, 1, opts)
    assert SS.read_output(spark, out, "summary").count() == 1


def test_a_batch_run_again_replaces_its_output(spark, tmp_path):
    df = spark.range(3)
    for _ in range(2):
        SS.write_batch(df, str(tmp_path), "t", 4)
    assert SS.read_output(spark, str(tmp_path), "t").count() == 3


def test_audit_sink(spark, tmp_path, events):
    rows = events.select(F.format_string('{"job_id":"j%d","actor":"a"}', "user_id").alias("payload"), F.col("ts").alias("created_at"))
    out = str(tmp_path / "log")
    finish(SS.stream_audit(source(spark, rows, str(tmp_path), ["created_at"]), "k", out, str(tmp_path / "cp"), True))
    from siftmark.sources.tables import read_audit

    log = read_audit(spark, out)
    assert log.count() == rows.count() and all(r.valid for r in audit.verify_audit(log, "k").collect())


def test_metrics(spark, tmp_path, events):
    cols = ["event_type", "window_start", "requests", "errors", "p50", "p99"]
    run = lambda df: SM.stream_metrics(df, ["event_type"], "ts", "value", F.col("event_type") == "error", 3600)
    got = collected(spark, run(source(spark, events, str(tmp_path), ["ts"])), tmp_path)
    closed = events.agg(F.max("ts")).first()[0]
    want = run(events).where(F.col("window_start") < F.lit(closed) - F.expr("INTERVAL 2 HOURS")).select(cols).collect()
    late = got.where(F.col("window_start") < F.lit(closed) - F.expr("INTERVAL 2 HOURS")).select(cols).collect()
    assert sorted(map(str, late)) == sorted(map(str, want)) and len(want) > 20


def out_of_order(df, seed=5):
    """Rows in an order that is off by up to a day."""
    return df.withColumn("_place", F.unix_micros(F.col(df.columns[-1] if "ts" not in df.columns else "ts")) + F.rand(seed) * 86_400_000_000)


def arriving(spark, df, path, n=4):
    rows = out_of_order(df)
    return source(spark, rows, path, ["_place"], n).drop("_place")


def test_reuse(spark, tmp_path, events):
    stream = SQ.ReuseStream(["user_id"], "ts", "event_id", str(tmp_path / "t"), 86400, 2 * 86400)
    live = arriving(spark, events, str(tmp_path))
    finish(stream.start(live, str(tmp_path / "cp"), True))
    before = SQ.read_outcome(spark, stream.out).count()
    stream.end(live)
    stream.end(live)  # nothing is decided twice
    got = SQ.read_outcome(spark, stream.out)
    want = sequences.reuse_results(events, ["user_id"], "ts", "event_id", 86400)
    pick = lambda d: sorted((r.event_id, r.reused) for r in d.select("event_id", "reused").collect())
    assert pick(got) == pick(want) and {r for _, r in pick(want)} == {True, False}
    assert 0 < before < got.count() and SQ.late_rows(spark, stream.out).count() == 0


def test_late_and_timeless_events_go_to_the_side(spark, tmp_path):
    rows = [("k", i, t) for i, t in enumerate([0, 100, 5000, 10, None, 5100, 90])]
    df = spark.createDataFrame(rows, "k string, id long, s long").withColumn("ts", F.timestamp_seconds("s")).withColumn("drop", F.col("id"))
    stream = SQ.ReuseStream(["k"], "ts", "id", str(tmp_path / "t"), 1000, 60)
    live = source(spark, df, str(tmp_path), ["drop"], 7).drop("drop")
    finish(stream.start(live, str(tmp_path / "cp"), True))
    stream.end(live)
    assert sorted((r.id, r.reused) for r in SQ.read_outcome(spark, stream.out).collect()) == [(0, False), (1, True), (2, False), (5, True)]
    assert sorted((r.id, r.reason) for r in SQ.late_rows(spark, stream.out).collect()) == [(3, "late"), (4, "no time"), (6, "late")]


def test_a_batch_decided_again_changes_nothing(spark, tmp_path, events):
    """The last batch runs again from what the one before it left."""
    stream = SQ.ReuseStream(["user_id"], "ts", "event_id", str(tmp_path / "t"), 86400, 2 * 86400)
    live = arriving(spark, events, str(tmp_path))
    finish(stream.start(live, str(tmp_path / "cp"), True))
    rows = lambda: sorted(map(str, SQ.read_outcome(spark, stream.out).collect()))
    first = rows()
    import shutil

    shutil.rmtree(tmp_path / "cp" / "commits")  # as if the last batches had not been confirmed
    finish(stream.start(live, str(tmp_path / "cp"), True))
    assert rows() == first


def test_progress(spark, tmp_path, events):
    kind = F.expr("CASE event_type WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'failed' ELSE 'finding' END")
    steps = events.select(F.col("user_id").alias("job_id"), kind.alias("type"), F.col("event_id").alias("id"), F.col("ts").alias("at"))
    stream = SQ.ProgressStream(str(tmp_path / "t"), delay_seconds=2 * 86400, keep_seconds=90 * 86400)
    live = arriving(spark, steps, str(tmp_path))
    finish(stream.start(live, str(tmp_path / "cp"), True))
    stream.end(live)
    pick = lambda d: sorted((r.job_id, r.id) for r in d.select("job_id", "id").collect())
    assert pick(SQ.read_outcome(spark, stream.out)) == pick(sequences.job_progress(steps))


def test_metrics_with_late_rows(spark, tmp_path, events):
    log = source(spark, events.withColumn("_place", F.hash("event_id")), str(tmp_path), ["_place"], 3).drop("_place")
    error = F.col("event_type") == "error"
    out = str(tmp_path / "t")
    finish(SM.run_metrics(log, ["event_type"], out, str(tmp_path / "cp"), "ts", "value", error, 3600, 5 * 86400, available_now=True))
    cols = ["event_type", "window_start", "requests", "errors", "p50", "p99"]
    read = lambda repaired: SM.read_metrics(spark, out, ["event_type"], "ts", "value", error, 3600, repaired=repaired).select(cols)
    want = SM.stream_metrics(events, ["event_type"], "ts", "value", error, 3600).select(cols)
    assert sorted(map(str, read(True).collect())) == sorted(map(str, want.collect()))
    late = SM.late_rows(spark, out).count()
    assert 0 < late and read(False).agg(F.sum("requests")).first()[0] + late == events.count()


def test_latest_status(spark, tmp_path):
    rows = [("j", "queued", 1), ("j", "done", 5), ("k", "running", 2)]
    df = spark.createDataFrame(rows, "job_id string, type string, id long").withColumn("at", F.timestamp_seconds("id"))
    out = collected(spark, SQ.stream_latest_status(source(spark, df, str(tmp_path), ["id"], 1)), tmp_path, "update")
    assert {r.job_id: r.status for r in out.collect()} == {"j": "done", "k": "running"}


def test_arriving_parts_are_written_by_many_tasks(spark, tmp_path):
    """Every part is one micro-batch, whatever number of files holds it; a part may have fewer rows than tasks."""
    from workload import queries

    rows = spark.range(0, 1000, 1, 5).withColumn("text", F.col("id").cast("string"))
    part = F.when(F.col("id") < 2, 0).when(F.col("id") < 500, 1).otherwise(3)
    stream, got = queries._arriving(rows, "parts", part, 4), []
    running = stream.writeStream.foreachBatch(lambda df, i: got.append((i, df.count(), df.select(F.input_file_name()).distinct().count())))
    running.option("checkpointLocation", str(tmp_path)).trigger(availableNow=True).start().awaitTermination()
    assert [n for _, n, _ in got] == [2, 498, 0, 500]
    assert got[1][2] == got[3][2] == 5
