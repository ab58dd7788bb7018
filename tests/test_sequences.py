import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftmark.operators import sequences as Q

MS = 1_000


def plain_reuse(times, ttl):
    stored, out = None, []
    for t in times:
        hit = stored is not None and t <= stored + ttl
        if not hit:
            stored = t
        out.append(hit)
    return out


def streams(seed, n=400):
    rng = random.Random(seed)
    t, out = 0, []
    mode = 1
    for _ in range(n):
        if rng.random() < 0.05:
            mode = rng.choice([0, 1, 10, 100, 1000, 20000])
        t += rng.randrange(0, mode * 2 + 1) * MS
        out.append(t)
    return out


@pytest.mark.parametrize("seed", range(60))
@pytest.mark.parametrize("cut", [7, 60, 200, 1000])
def test_parts_compose(seed, cut):
    """Describing parts and running through them equals one event after the other."""
    times = np.array(streams(seed), dtype=np.int64)
    specs = [(Q.Reuse(500 * MS), plain_reuse(times.tolist(), 500 * MS))]
    for spec, expected in specs:
        state, got = None, []
        for a in range(0, len(times), cut):
            part = times[a:a + cut]
            flags, _ = spec.apply(part, state)
            got += flags.tolist()
            row = dict(zip("abcdef", spec.summarise(part)[:6]))
            row["xs"], row["ys"] = spec.summarise(part)[6:]
            state = spec.advance(state, type("S", (), row))
        assert got == expected


def frame(spark, rows):
    df = spark.createDataFrame(rows, "k string, us long, id long")
    return df.withColumn("ts", F.timestamp_micros("us"))


def test_reuse_example(spark):
    h = 3_600_000_000
    rows = [("r", t, i) for i, t in enumerate([0, h, 2 * h, 2 * h + 1_000_000, 4 * h])]
    got = Q.reuse_results(frame(spark, rows), ["k"], "ts", "id").orderBy("id").collect()
    assert [r.reused for r in got] == [False, True, True, False, True]


@pytest.mark.parametrize("slice_seconds", [1, 5, 100000])
def test_hot_key_is_cut_exactly(spark, slice_seconds):
    rows, expected = [], {}
    i = 0
    for k, seed in (("hot", 1), ("hot2", 2), ("a", 3), ("b", 4)):
        times = streams(seed, 3000 if k.startswith("hot") else 50)
        reuse = plain_reuse(times, 2_000_000)
        for t, r in zip(times, reuse):
            rows.append((k, t, i))
            expected[i] = r
            i += 1
    random.Random(0).shuffle(rows)
    df = frame(spark, rows).repartition(4)
    got = {r.id: r.reused for r in Q.reuse_results(df, ["k"], "ts", "id", 2, slice_seconds).collect()}
    assert got == expected


def test_null_keys_are_kept(spark):
    got = Q.reuse_results(frame(spark, [(None, 0, 1), (None, 5, 2), ("x", 5, 3)]), ["k"], "ts", "id").collect()
    assert sorted((r.id, r.reused) for r in got) == [(1, False), (2, True), (3, False)]


def test_progress_stops_at_the_first_terminal_event(spark):
    rows = [("j", "status_change", 1), ("j", "finding", 2), ("j", "done", 3), ("j", "finding", 4), ("k", "finding", 1)]
    ev = spark.createDataFrame(rows, "job_id string, type string, id long").withColumn("at", F.timestamp_seconds("id"))
    kept = Q.job_progress(ev)
    assert sorted((r.job_id, r.id) for r in kept.collect()) == [("j", 1), ("j", 2), ("j", 3), ("k", 1)]
    assert {r.job_id: r.status for r in Q.latest_status(kept).collect()} == {"j": "done", "k": "finding"}
