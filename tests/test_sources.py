import hashlib
import hmac
import json

import pytest
from pyspark.sql import functions as F

from siftmark import schemas
from siftmark.operators import audit
from siftmark.sources import files as S
from siftmark.sources import ingest, tables


def put(root, path, data):
    p = root / path
    p.parent.mkdir(parents=True, exist_ok=True)
    p.write_bytes(data if isinstance(data, bytes) else data.encode())


def test_source_tree(spark, tmp_path):
    for path in ("repo/a.go", "repo/src/b.PY", "repo/.env", "repo/.github/w.yml", "repo/_x.rs", "other/c.txt", "repo/sp ace/d.sql"):
        put(tmp_path, path, "text " + path)
    for path in ("repo/.git/config", "repo/node_modules/m.js", "repo/src/vendor/v.go", "repo/i.PNG", "repo/.cache/x.py", "repo/dist/d.js", "repo/.h/bin/e.py"):
        put(tmp_path, path, "skipped")
    put(tmp_path, "repo/exact.txt", b"x" * (1 << 20))
    put(tmp_path, "repo/large.txt", b"x" * ((1 << 20) + 1))
    put(tmp_path, "repo/.large", b"x" * ((1 << 20) + 1))
    put(tmp_path, "repo/bad.txt", b"ok \xff\xfe")
    large = {("repo", "large.txt"), ("repo", ".large")}
    assert large < {(r.job_id, r.path) for r in S.read_source_tree(spark, str(tmp_path)).select("job_id", "path").collect()}
    left_out = {(r.path, r.reason) for r in S.skipped_files(spark, str(tmp_path), max_bytes=1 << 20).collect()}
    assert {("large.txt", "too large"), ("i.PNG", "binary"), ("node_modules/m.js", "skipped folder")} <= left_out
    got = {(r.job_id, r.path): r for r in S.read_source_tree(spark, str(tmp_path), max_bytes=1 << 20).collect()}
    assert set(got) == {
        ("repo", "a.go"), ("repo", "src/b.PY"), ("repo", ".env"), ("repo", ".github/w.yml"), ("repo", "_x.rs"), ("other", "c.txt"),
        ("repo", "exact.txt"), ("repo", "bad.txt"), ("repo", "sp ace/d.sql"),
    }
    assert got["repo", "src/b.PY"].language == "python" and got["repo", ".env"].language == "unknown"
    assert got["repo", ".github/w.yml"].content == "text repo/.github/w.yml"
    assert not got["repo", "bad.txt"].valid_utf8 and got["repo", "a.go"].valid_utf8
    one = S.read_source_tree(spark, str(tmp_path / "repo"), job_id="j", include_hidden=False, max_bytes=1 << 20)
    assert {(r.job_id, r.path) for r in one.collect()} == {("j", p) for p in ("a.go", "src/b.PY", "exact.txt", "bad.txt", "sp ace/d.sql")}


def test_one_repository_is_listed_by_many_tasks(spark, tmp_path):
    for i in range(40):
        put(tmp_path, f"repo/d{i % 8}/e{i}/f.py", f"text {i}")
    (tmp_path / "repo" / "loop").symlink_to(tmp_path / "repo")  # links to folders are not followed
    listed = S.list_tree(spark, str(tmp_path))
    rows = listed.collect()
    assert len(rows) == 40 and len({r.task for r in rows}) > 1
    wanted = spark.createDataFrame([("repo", "d1/e1/f.py"), ("repo", "gone.py")], "job_id string, path string")
    assert [r.path for r in S.read_source_tree(spark, str(tmp_path), only=wanted).collect()] == ["d1/e1/f.py"]
    with pytest.raises(ValueError):
        S.read_source_tree(spark, str(tmp_path / "not there"))
    (tmp_path / "empty").mkdir()
    assert S.read_source_tree(spark, str(tmp_path / "empty")).collect() == []


def test_stored_samples(spark, tmp_path, capsys):
    rows = [("s", "m", "gauge", None, t, float(t)) for t in (0, 90_000, 180_000, 270_000)]
    df = spark.createDataFrame(rows, "service string, metric string, kind string, le string, t long, value double").withColumn("ts", F.timestamp_seconds("t"))
    for batch, part in (("a", df.where("t < 100000")), ("b", df.where("t > 100000")), ("a", df.where("t < 100000"))):
        tables.append_metric_samples(part, str(tmp_path), batch)
    assert tables.read_metric_samples(spark, str(tmp_path)).count() == 4
    some = tables.read_metric_samples(spark, str(tmp_path), "1970-01-02 00:00:00", "1970-01-03 02:00:00")
    assert sorted(r.value for r in some.collect()) == [90_000.0, 180_000.0]
    some.explain("formatted")
    assert "PartitionFilters: [isnotnull(day" in capsys.readouterr().out


def test_languages(spark):
    cases = {"a.go": "go", "x/y.TSX": "typescript", "a.tar.gz": "unknown", "Makefile": "unknown", "d.py/README": "unknown", "k.kts": "kotlin", ".h": "c", "p.proto": "protobuf"}
    df = spark.createDataFrame([(p,) for p in cases], "path string")
    assert {r.path: r.language for r in S.tag_language(df).collect()} == cases


def test_prefixes_and_changes(spark):
    df = spark.createDataFrame([("j", p, "x", "") for p in ("a/b", "a/c", "ab", "z")], schemas.FILES)
    left = lambda d: sorted(r.path for r in d.collect())
    assert left(S.exclude_prefixes(df, ["a/", " ", ""])) == ["ab", "z"]
    assert left(S.exclude_prefixes(df, ["a/c"] + [f"n{i}" * (i % 3 + 1) for i in range(90)])) == ["a/b", "ab", "z"]
    assert left(S.exclude_prefixes(df, [])) == ["a/b", "a/c", "ab", "z"]
    changes = [spark.createDataFrame([(p,) for p in ps], "path string") for ps in (["z", "z", "gone"], [" ab ", ""])]
    assert left(S.changed_files(df, *changes)) == ["ab", "z"]
    assert left(S.changed_files(df)) == ["a/b", "a/c", "ab", "z"]
    per_job = spark.createDataFrame([("j", "z"), ("k", "ab")], "job_id string, path string")
    assert left(S.changed_files(df, per_job)) == ["z"]


SECRET = "hook"


def delivery(action="opened", event="pull_request", secret=SECRET, name="own/er/repo", body=None):
    doc = {"action": action, "number": 7, "more": [1], "pull_request": {"head": {"sha": "s", "ref": "b", "repo": {"clone_url": "u", "full_name": name}}}}
    body = json.dumps(doc) if body is None else body
    return body, event, "sha256=" + hmac.new(secret.encode(), body.encode(), hashlib.sha256).hexdigest()


def test_webhooks(spark):
    sent = [
        delivery(), delivery("reopened", name="alone"), delivery("closed"), delivery(event="ping"), delivery(secret="other"),
        delivery(body="{no json"), delivery(event="push"), delivery(body='{"action":"opened"}'),
    ]
    raw = spark.createDataFrame(sent, "body string, event string, signature string").withColumn("received_at", F.timestamp_seconds(F.lit(0)))
    jobs, rejects = ingest.ingest_webhooks(raw, SECRET)
    assert sorted((j.repo_owner, j.repo_name, j.commit_sha, j.pr_number, j.status) for j in jobs.collect()) == [
        ("", "", "", 0, "queued"), ("alone", "", "s", 7, "queued"), ("own", "er/repo", "s", 7, "queued"),
    ]
    assert jobs.schema.fieldNames() == schemas.JOBS.fieldNames()
    assert sorted(r.reason for r in rejects.collect()) == ["ignored action", "ignored event", "ignored event", "invalid payload", "invalid signature"]
    assert ingest.ingest_webhooks(raw)[0].count() == 4  # without a secret nothing is checked
    assert [r.valid for r in audit.verify_webhooks(raw, SECRET).collect()].count(False) == 1
    big = raw.limit(1).withColumn("body", F.repeat(F.lit("x"), (10 << 20) + 1))
    assert ingest.ingest_webhooks(big)[1].first().reason == "body too large"


def test_manual_jobs(spark):
    rows = [("u", "s", "b", None), ("u", "s", None, None), ("", "s", "b", None), ("u", None, "b", None)]
    jobs, rejects = ingest.ingest_manual_jobs(spark.createDataFrame(rows, schemas.MANUAL_REQUESTS))
    got = jobs.collect()
    assert len(got) == 2 and all(j.created_at and j.source == "manual" for j in got) and got[0].id != got[1].id
    assert rejects.count() == 2


@pytest.mark.parametrize("secret", ["s", "", "k" * 64, "k" * 65, "ключ"])
def test_hmac(spark, secret):
    from siftmark.functions.signing import hmac_hex, signature_valid, signing_key

    texts = ["", "{}", "naïve ✓", "x" * 300]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    want = {t: hmac.new(secret.encode(), t.encode(), hashlib.sha256).hexdigest() for t in texts}
    signed = df.withColumn("s", hmac_hex(F.col("t"), signing_key(spark, secret)))
    assert {r.t: r.s for r in signed.collect()} == want
    ok = lambda data, sig, key: [r[0] for r in signed.select(signature_valid(data, sig, signing_key(spark, key))).collect()]
    assert all(ok(F.col("t"), F.col("s"), secret))
    assert not any(ok(F.concat("t", F.lit(" ")), F.col("s"), secret) + ok(F.col("t"), F.lit(""), secret) + ok(F.col("t"), F.col("s"), secret + "x"))


def test_plans_hold_no_secret(spark):
    """Neither the secret nor the pads made of it appear in any form of the plan."""
    from siftmark.functions.signing import _pads

    df = audit.audit_entries(spark.range(3).select(F.col("id").cast("string").alias("payload"), F.current_timestamp().alias("created_at")), "topsecret")
    plan = df._jdf.queryExecution().toString() + df._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("extended"))
    assert df.count() == 3
    for part in (b"topsecret", *(p[:9] for p in _pads("topsecret"))):
        for shown in (part.hex(), " ".join(f"{b:02x}" for b in part), part.decode("latin-1")):
            assert shown.lower() not in plan.lower()


def test_signed_columns_are_told_apart(spark):
    rows = [("1", "a", None, "b"), ("2", "a", "b", None)]
    df = spark.createDataFrame(rows, "id string, job_id string, event_type string, actor string").withColumns({"payload": F.lit("p"), "created_at": F.current_timestamp()})
    signed = audit.audit_entries(df, "k", ("job_id", "event_type", "actor")).collect()
    assert signed[0].signature != signed[1].signature


def test_audit_log(spark, tmp_path):
    path = str(tmp_path / "log")
    rows = [(json.dumps({"job_id": f"j{i % 3}", "event_type": "done", "actor": i if i % 2 else f"a{i}"}), f"2024-01-0{i % 4 + 1} 10:00:0{i}") for i in range(8)]
    events = spark.createDataFrame(rows, "payload string, created_at string").withColumn("created_at", F.col("created_at").cast("timestamp"))
    audit.append_audit(events, "k", path, "one")
    audit.append_audit(events, "k", path, "one")
    audit.append_audit(events.limit(0), "k", path, "two")
    log = tables.read_audit(spark, path)
    assert log.count() == 8
    first = log.where("actor = ''").first()
    assert first.job_id.startswith("j") and first.event_type == "done"
    page = audit.query_audit(log, limit=2, offset=1, since="2024-01-02 00:00:00", until="2024-01-03 10:00:02")
    assert [str(r.created_at) for r in page.collect()] == ["2024-01-02 10:00:05", "2024-01-02 10:00:01"]
    assert "PartitionFilters: [isnotnull(dt" in page._jdf.queryExecution().toString()
    assert audit.query_audit(log, limit=5, offset=99).collect() == []
    assert audit.query_audit(log, limit=0, job_id="j1").count() == 3
    assert all(r.valid for r in audit.verify_audit(log, "k").collect())
    ids = log.select("id").limit(2).union(spark.createDataFrame([("unknown",)], "id string"))
    assert sorted(r.valid for r in audit.verify_audit(log, "k", ids).collect()) == [False, True, True]
    counts = audit.verification_counts(audit.verify_audit(log, "wrong")).first()
    assert (counts.verified, counts.failed) == (8, 8)
    kept = audit.audit_entries(events.withColumn("signature", F.lit("given")), "k")
    assert {r.signature for r in kept.collect()} == {"given"}
