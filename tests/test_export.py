import json

from pyspark.sql import functions as F

from siftmark import schemas
from siftmark.operators import export, rollup
from siftmark.plans.scan_job import run_scan, scan_corpus
from siftmark.sources import rules as R


def rows(n, severity="low", job="j"):
    return [(job, f"R-{i % 3}", "name", "quality", severity, f"dir/f{i:03d}", i + 1, 2, "msg", "snip" if i % 2 else "", "", 0, i % 3, 0) for i in range(n)]


def made(spark, data):
    return spark.createDataFrame(data, schemas.FINDINGS)


def results(spark, data, *jobs):
    ids = spark.createDataFrame([(j,) for j in jobs], "job_id string")
    out = rollup.summarise(made(spark, data), ids)
    return out.withColumns({
        "repo_owner": F.lit("o"), "repo_name": F.lit("r"), "commit_sha": F.lit("0123456789"), "duration_ms": F.lit(5).cast("long"),
        "completed_at": F.timestamp_seconds(F.lit(60)),
    })


def test_documents_in_parts_hold_everything(spark):
    data = rows(43) + rows(2, "critical", "k")
    found, res = made(spark, data), results(spark, data, "j", "k", "clean")
    docs = export.sarif_documents(found, res, [R.Rule("R-0", R.Pattern("regex", "x"), name="n", message="m")], per_part=10).collect()
    runs = [(d.job_id, json.loads(d.json)["runs"][0]) for d in docs]
    uris = [x["locations"][0]["physicalLocation"]["artifactLocation"]["uri"] for j, r in runs if j == "j" for x in r["results"]]
    assert sorted(uris) == sorted(r[5] for r in data if r[0] == "j")
    assert all(len(r["results"]) <= 10 for _, r in runs) and [r["results"] for j, r in runs if j == "clean"] == [[]]
    assert runs[0][1]["tool"]["driver"]["rules"] == [{"id": "R-0", "name": "n", "shortDescription": {"text": "m"}}]
    texts = export.text_reports(found, res, per_part=10).where("job_id = 'j'").orderBy("part").collect()
    assert [t.text.startswith("siftmark report for j: clean") for t in texts] == [True] + [False] * 4
    assert sum(t.text.count(" low msg (R-") for t in texts) == 43
    parsed = [json.loads(d.json) for d in export.json_results(found, res, per_part=10).orderBy("job_id", "part").collect()]
    assert [f["file"] for d in parsed if d["job_id"] == "j" for f in d["findings"]] == [f"dir/f{i:03d}" for i in range(43)]
    one = next(f for d in parsed for f in d["findings"] if f["file"] == "dir/f000")
    assert "snippet" not in one and "fix_suggestion" not in one
    assert {d["job_id"]: d["summary"]["total_findings"] for d in parsed} == {"j": 43, "k": 2, "clean": 0}


def test_large_job_keeps_its_order(spark):
    """20,000 findings of one job in one file: the same parts and order as in a small one."""
    data = [("j", "R-0", "name", "quality", "low", "f", i + 1, 2, "msg", "", "", 0, 0, 0) for i in range(20000)]
    parts = export.json_results(made(spark, data).repartition(7), results(spark, data, "j"), per_part=1500).orderBy("part").collect()
    assert [p.part for p in parts] == list(range(14))
    assert [f["line"] for p in parts for f in json.loads(p.json)["findings"]] == list(range(1, 20001))
    capped = rollup.cap_findings(made(spark, data).repartition(5), 5000).orderBy("rank").collect()
    assert [(r.rank, r.line) for r in capped] == [(i, i) for i in range(1, 5001)]


def test_short_forms(spark):
    data = rows(60) + rows(1, "high", "k")
    found, res = made(spark, data), results(spark, data, "j", "k", "clean")
    runs = {(r.job_id, r.part): json.loads(r.json) for r in export.checkrun_payloads(found, res).collect()}
    assert [len(runs["j", i]["output"]["annotations"]) for i in (0, 1)] == [50, 10] and runs["j", 1]["conclusion"] == "success"
    assert runs["k", 0]["conclusion"] == "failure" and runs["k", 0]["output"]["title"] == "Findings block, 90 of 100 points"
    assert runs["k", 0]["output"]["annotations"][0]["annotation_level"] == "failure"
    assert runs["clean", 0]["output"]["annotations"] == [] and runs["clean", 0]["completed_at"] == "1970-01-01T00:01:00Z"
    bodies = {r.job_id: r.body for r in export.pr_comments(found, res).collect()}
    assert bodies["j"].count("1. dir/") == 10 and "50 more are" in bodies["j"] and "at 01234567" in bodies["j"]
    assert "1. " not in bodies["clean"] and "more are" not in bodies["k"]
    chat = {r.job_id: json.loads(r.json)["attachments"][0] for r in export.chat_messages(res).collect()}
    assert chat["k"]["color"] == export.COLOURS[False] and chat["j"]["ts"] == 60 and "o/r is clean" in chat["j"]["text"]
    mail = {r.job_id: r for r in export.mail_messages(res).collect()}
    assert "blocked" in mail["k"].subject and "60 findings:\nlow 60\n" in mail["j"].body
    assert " low msg (R-" in export.text_lines(found).first().text
    line = {r.job_id: r.text for r in export.annotations(found).collect()}
    assert line["k"] == "::error file=dir/f000,line=1,col=2,title=[R-0] name::msg"


def test_reports_name_the_rest(spark):
    data = rows(20)
    out = rollup.job_report(rollup.summarise(made(spark, data)), made(spark, data)).first()
    assert len(out.top_findings) == 15 and out.more == 5
    listed = rollup.job_list(rollup.summarise(made(spark, data)), spark.createDataFrame([("j", "o", "r")], "job_id string, repo_owner string, repo_name string"))
    assert listed.first().repo == "o/r"


def test_caps_in_two_steps(spark):
    data = rows(300) + rows(5, job="k")
    kept = rollup.cap_findings(made(spark, data), 120).orderBy("job_id", "rank").collect()
    want = [("j", f"dir/f{i:03d}", i + 1) for i in range(120)] + [("k", f"dir/f{i:03d}", i + 1) for i in range(5)]
    assert [(r.job_id, r.file, r.rank) for r in kept] == want


def test_stored_scan_equals_lazy_scan(spark, tmp_path):
    rules = R.check_rules(spark, [R.Rule("R-1", R.Pattern("regex", "bad"), severity="high", languages=("*",), enabled=True)])
    files = spark.createDataFrame([("a", "x", "go", "bad\nbad"), ("b", "y", "go", "good")], schemas.FILES)
    lazy, stored = scan_corpus(files, rules), run_scan(spark, files, rules, str(tmp_path))
    for name in ("findings", "summary", "verdict"):
        assert sorted(map(str, getattr(lazy, name).collect())) == sorted(map(str, getattr(stored, name).collect()))
