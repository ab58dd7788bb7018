"""One query per operator, each over whole tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from siftmark.functions.signing import signing_key, webhook_signature
from siftmark.functions.text import extension, truncate_bytes
from siftmark.operators import audit, backtest, deps, export, metrics, rollup, scan, sequences
from siftmark.plans import trigrams
from siftmark.plans.scan_job import append_scan, read_scans, run_scan, scan_corpus, spread
from siftmark.sources import files as file_source
from siftmark.sources import ingest, pattern_types, rules as rule_source, tables
from siftmark.streaming import metrics as stream_metric
from siftmark.streaming import scan as stream_scans
from siftmark.streaming import sequences as stream_sequences
from workload import inputs
from workload.inputs import OPTIONS, SECRET, THRESHOLD, documents, events, pack, pages, table, turns

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
PLACE = ["job_id", "file", "line", "column", "rule_id"]
DAY = 86400
PER_PART = 40  # so that the jobs of small tables have several parts


def query(fn: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        inputs.prepare(spark)
        return fn(spark, sf_dir)

    QUERIES[fn.__name__] = run
    return run


def _naive(*names: str) -> list[Column]:
    """Times without zone, as the tables have them."""
    return [F.col(n).cast("timestamp_ntz").alias(n) for n in names]


def _findings(spark, sf_dir) -> DataFrame:
    return scan.scan_files(spread(documents(spark, sf_dir)), pack(spark, "prose"), OPTIONS)


def _jobs(spark, sf_dir) -> DataFrame:
    return documents(spark, sf_dir).select("job_id").distinct()


def _summary(spark, sf_dir) -> DataFrame:
    return rollup.summarise(_findings(spark, sf_dir), _jobs(spark, sf_dir))


def _results(spark, sf_dir) -> DataFrame:
    return inputs.job_details(_summary(spark, sf_dir))


def _stored(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """(findings, summary) for queries that need both: scanned once, into a stored table."""
    out = run_scan(spark, documents(spark, sf_dir), pack(spark, "prose"), inputs.scratch(spark, "scan"), OPTIONS)
    return out.findings, out.summary


_COUNTS = ["total_findings", "n_critical", "n_high", "n_medium", "n_low", "n_info"]

# -- scans ---------------------------------------------------------------------


@query
def rule_listing(spark, sf_dir):
    """The pack and how many files of the corpus each rule looks at."""
    listed = rule_source.rules_frame(spark, pack(spark, "prose")).select("rule_id", "severity", "category", "name", "enabled")
    used = scan.rules_for(documents(spark, sf_dir), pack(spark, "prose")).groupBy("rule_id").agg(F.count(F.lit(1)).alias("files"))
    return listed.join(used, "rule_id", "left").fillna(0, ["files"])


@query
def line_listing(spark, sf_dir):
    lines = scan.drop_comment_lines(scan.explode_lines(scan.drop_suppressed_files(documents(spark, sf_dir))))
    return lines.select("job_id", "path", "language", "line", F.octet_length("text").cast("long").alias("bytes"))


@query
def scan_regex(spark, sf_dir):
    found = scan.scan_regex(spread(documents(spark, sf_dir)), pack(spark, "prose"))
    return found.select(*PLACE, "severity", "category", "rule_name", "message", "snippet", "fix_suggestion")


@query
def scan_required(spark, sf_dir):
    return scan.scan_required(spread(documents(spark, sf_dir)), pack(spark, "prose")).select(*PLACE, "severity", "message", "snippet")


@query
def scan_secrets(spark, sf_dir):
    return scan.scan_secrets(spread(documents(spark, sf_dir)), THRESHOLD).select(*PLACE, "severity", "message", "snippet", "match_idx")


@query
def scan_pages(spark, sf_dir):
    return scan.scan_files(spread(pages(spark, sf_dir)), pack(spark, "weakness"), OPTIONS).select(*PLACE, "severity", "message")


@query
def scan_turns(spark, sf_dir):
    """Many small jobs: one per conversation, also those without findings."""
    files = turns(spark, sf_dir)
    return scan_corpus(files, pack(spark, "prose"), OPTIONS).summary.select("job_id", *_COUNTS, "score", "passed")


@query
def scan_corpus_summary(spark, sf_dir):
    """Flagship: rules, secrets and dependencies of all jobs to score and gate."""
    result = scan_corpus(documents(spark, sf_dir), pack(spark, "prose"), OPTIONS)
    return result.summary.select("job_id", *_COUNTS, "score", "passed", "exit_code")


@query
def scan_corpus_limited(spark, sf_dir):
    """The limit cuts before the summary."""
    opts = scan.ScanOptions(entropy_threshold=THRESHOLD, max_findings=100, exclude=("src1/", "src2/", "src10/1"), spread=True)
    return scan_corpus(documents(spark, sf_dir), pack(spark, "prose"), opts).summary.select("job_id", *_COUNTS, "score", "passed")


@query
def scan_long_texts(spark, sf_dir):
    """Texts above 4,000 bytes cut into ranges of seven lines and dealt over the tasks: the findings stay the same."""
    opts = replace(OPTIONS, long_text=4000, long_texts=scan.DEALT, range_lines=7)
    return scan.scan_files(spread(documents(spark, sf_dir)), pack(spark, "prose"), opts).select(*PLACE, "message", "snippet")


@query
def stored_long_texts(spark, sf_dir):
    """A stored scan of which the longest documents are listed in the one pass and dealt after it."""
    opts = replace(OPTIONS, long_text=20_000, range_lines=50)
    found = run_scan(spark, documents(spark, sf_dir), pack(spark, "prose"), inputs.scratch(spark, "scan"), opts).findings
    return found.select(*PLACE, "message")


def _own_kinds() -> list[rule_source.Rule]:
    """Rules of two kinds that this workload adds: lines longer than `max`, and lines with `max` or more digits."""
    digits = lambda line: F.length(F.regexp_replace(line, "[^0-9]", ""))
    pattern_types.register(pattern_types.PatternType(
        "max_length", line=lambda p, line: F.length(line) > p.max, file=lambda p, body: F.length(body) > p.max,
        place=lambda p, line: F.octet_length(F.substring(line, 1, p.max)) + 1,
    ))
    pattern_types.register(pattern_types.PatternType("digits", line=lambda p, line: digits(line) >= p.max))
    made = lambda i, kind, most, langs, **kw: rule_source.Rule(
        i, pattern_types.Pattern(kind, "", most, **kw), i.lower(), category="style", severity="low", languages=langs, message=f"{kind} {most}", enabled=True)
    return [
        made("OWN-1", "max_length", 120, ("*",)), made("OWN-2", "digits", 12, ("en", "de")), made("OWN-3", "digits", 8, ("*",), negate=True),
        rule_source.Rule("OWN-4", pattern_types.Pattern("regex", "[0-9]{4}"), "own-4", category="style", severity="info", languages=("*",), message="number", enabled=True),
    ]


@query
def scan_own_kinds(spark, sf_dir):
    """Pattern types of one's own beside a regular expression, as line and file tests."""
    rules = rule_source.check_rules(spark, _own_kinds())
    return scan.scan_files(spread(documents(spark, sf_dir)), rules, replace(OPTIONS, secrets=False)).select(*PLACE, "severity", "message")


# -- file trees, stored trigrams, scans side by side ----------------------------


def _tree(spark, sf_dir) -> str:
    """The documents as files of a source tree: folders of a hundred, some hidden, some left out by name."""
    docs = table(spark, sf_dir, "documents")
    doc = F.col("doc_id")
    folder = F.when(doc % 11 == 0, "node_modules").when(doc % 7 == 0, F.concat(F.lit(".h"), F.floor(doc / 100))).otherwise(F.concat(F.lit("d"), F.floor(doc / 100)))
    name = F.concat(F.when(doc % 5 == 0, ".f").otherwise("f"), doc, F.when(doc % 13 == 0, ".png").when(doc % 2 == 0, ".py").otherwise(".txt"))
    files = docs.select(F.concat_ws("/", "source", F.lit("src"), folder, name).alias("path"), F.col("text").alias("content"))
    return inputs.write_tree(spread(files, "path"), inputs.scratch(spark, "tree"))


@query
def tree_scan(spark, sf_dir):
    """A tree written from the documents and read back."""
    files = file_source.read_source_tree(spark, _tree(spark, sf_dir))
    return files.select("job_id", "path", "language", F.octet_length("content").cast("long").alias("bytes"), F.sha2("content", 256).alias("digest"))


@query
def tree_skipped(spark, sf_dir):
    left = file_source.skipped_files(spark, _tree(spark, sf_dir), max_bytes=20000)
    return left.select("job_id", "path", F.col("length").cast("long").alias("bytes"), "reason")


@query
def candidate_scan(spark, sf_dir):
    """Rules with literals on the files that the stored trigrams name; the other rules on all files."""
    files, rules = documents(spark, sf_dir), pack(spark, "prose")
    out = inputs.scratch(spark, "trigrams")
    trigrams.build_trigrams(spread(files), out, "v1")
    of_names = lambda names: file_source.changed_files(files, names)
    found = trigrams.scan_candidates(spark, of_names, rules, out, "v1", OPTIONS)
    rest = {r.rule_id for r in trigrams.candidates(spark, rules, out, "v1")[1]}
    others = [r if r.rule_id in rest else replace(r, enabled=False) for r in rules]
    return found.unionByName(scan.scan_files(spread(files), others, OPTIONS)).select(*PLACE)


@query
def scan_history(spark, sf_dir):
    """Two scans side by side in one table; one of them ran before, with more findings."""
    out = inputs.scratch(spark, "history")
    files = documents(spark, sf_dir)
    append_scan(spark, files, pack(spark, "prose"), out, date(2024, 2, 1), "nightly", OPTIONS)
    append_scan(spark, files, pack(spark, "prose"), out, date(2024, 2, 2), "nightly", OPTIONS)
    few = replace(OPTIONS, max_findings=20)
    append_scan(spark, files, pack(spark, "prose"), out, date(2024, 2, 2), "nightly", few)
    append_scan(spark, files, pack(spark, "prose"), out, date(2024, 2, 2), "other", replace(OPTIONS, secrets=False))
    second = read_scans(spark, out, "findings").where(F.col("day") == F.lit("2024-02-02").cast("date"))
    counts = second.groupBy("scan_id", "job_id").agg(F.count(F.lit(1)).alias("n"))
    sums = read_scans(spark, out, "summary").where("day = DATE '2024-02-02'").select("scan_id", "job_id", "total_findings", "score")
    return sums.join(counts, ["scan_id", "job_id"], "left").fillna(0, ["n"])


# -- choosing files ------------------------------------------------------------


@query
def changed_scan(spark, sf_dir):
    """Only documents that one of two change lists names; some of the names are of no document."""
    labels = table(spark, sf_dir, "labels")
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    path = F.concat_ws("/", "source", F.concat(F.col("doc_id"), F.lit(".txt"))).alias("path")
    poor = labels.where("quality = 0").join(docs, "doc_id").select(path)
    toxic = labels.where("toxic = 1").join(docs, "doc_id").select(path)
    gone = labels.select(F.concat(F.lit("gone/"), F.col("doc_id"), F.lit(".txt")).alias("path"))
    kept = file_source.changed_files(documents(spark, sf_dir), poor, toxic, gone)
    return scan.scan_files(spread(kept), pack(spark, "prose"), OPTIONS).select(*PLACE)


@query
def exclude_scan(spark, sf_dir):
    kept = file_source.exclude_prefixes(documents(spark, sf_dir), ["src1/", "src3", "", "none/"])
    return scan.scan_files(spread(kept), pack(spark, "prose"), OPTIONS).select(*PLACE)


@query
def tag_language(spark, sf_dir):
    suffix = F.expr("CASE lang WHEN 'en' THEN '.PY' WHEN 'fr' THEN '.tar.go' WHEN 'de' THEN '.d/README' ELSE '.odd' END")
    named = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.col("source"), F.lit("."), F.col("doc_id"), suffix).alias("path"))
    return file_source.tag_language(named).select("doc_id", "path", "language", extension(F.col("path")).alias("extension"))


# -- roll-ups ------------------------------------------------------------------


@query
def summary_by_job(spark, sf_dir):
    flat = lambda c: F.array_join(F.transform(F.map_entries(c), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    out = _summary(spark, sf_dir)
    return out.select("job_id", *_COUNTS, flat("by_severity").alias("severities"), flat("by_category").alias("categories"), "score", "passed")


@query
def policy_verdict(spark, sf_dir):
    return rollup.policy_verdict(_findings(spark, sf_dir), _jobs(spark, sf_dir))


@query
def policy_messages(spark, sf_dir):
    return rollup.policy_messages(_findings(spark, sf_dir)).select("job_id", "kind", "text", "rule_id", "reason")


@query
def policy_documents(spark, sf_dir):
    """Errors and warnings per job as arrays in finding order, whole."""
    nested = rollup.nested_verdict(_findings(spark, sf_dir), PER_PART)
    return nested.select("job_id", "part", F.array_join("errors", "\n").alias("errors"), F.sha2(F.array_join("warnings", "\n"), 256).alias("warnings"), F.size("rules").alias("n_rules"))


@query
def gate_by_level(spark, sf_dir):
    summary = _summary(spark, sf_dir)
    levels = ["critical", "high", "medium", "low", "never", "other"]
    wide = summary
    for level in levels:
        wide = rollup.gate(wide, level).withColumnRenamed("exit_code", f"code_{level}").drop("fail_on")
    return wide.select("job_id", *[f"code_{level}" for level in levels])


@query
def job_listing(spark, sf_dir):
    return rollup.job_list(_summary(spark, sf_dir), inputs.job_details(_jobs(spark, sf_dir)))


@query
def capped_findings(spark, sf_dir):
    return rollup.cap_findings(_findings(spark, sf_dir), 15).select("rank", *PLACE)


@query
def job_report(spark, sf_dir):
    details = inputs.job_details(_jobs(spark, sf_dir))
    findings, summary = _stored(spark, sf_dir)
    out = rollup.job_report(summary, findings, details)
    return out.select("job_id", "repo_owner", "repo_name", "score", "passed", "total_findings", "duration_ms",
                      F.array_join("top_findings", "\n").alias("top"), "more")


@query
def top_rules(spark, sf_dir):
    return rollup.finding_groups(_findings(spark, sf_dir), "rule_id", "severity", top=10)


@query
def top_files(spark, sf_dir):
    return rollup.finding_groups(_findings(spark, sf_dir), "file", top=25)


@query
def severity_totals(spark, sf_dir):
    return rollup.severity_totals(_findings(spark, sf_dir)).select("severity", "findings", F.col("rank").cast("int").alias("rank"))


@query
def findings_cube(spark, sf_dir):
    return rollup.finding_cube(_findings(spark, sf_dir))


@query
def findings_by_quality(spark, sf_dir):
    """Findings against the labels of the documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat_ws("/", "source", F.concat(F.col("doc_id"), F.lit(".txt"))).alias("file"))
    per_file = _findings(spark, sf_dir).groupBy("file").agg(F.count(F.lit(1)).alias("n"))
    joined = table(spark, sf_dir, "labels").join(docs, "doc_id").join(per_file, "file", "left")
    return joined.groupBy("quality", "toxic").agg(F.count(F.lit(1)).alias("files"), F.sum(F.coalesce("n", F.lit(0).cast("long"))).alias("findings"))


# -- rule tests and dependencies -----------------------------------------------

def _examples(spark, sf_dir) -> DataFrame:
    labelled = spread(table(spark, sf_dir, "documents"), "doc_id").join(table(spark, sf_dir, "labels"), "doc_id")
    ids = [r.rule_id for r in pack(spark, "prose")]
    return labelled.select(
        F.explode(F.array(*[F.lit(i) for i in ids])).alias("rule_id"), (F.col("quality") == 0).alias("expected_fire"),
        F.col("text").alias("snippet"), "doc_id",
    )


@query
def rule_backtest(spark, sf_dir):
    return backtest.backtest_rules(_examples(spark, sf_dir), pack(spark, "prose"))[0]


@query
def rule_backtest_failures(spark, sf_dir):
    return backtest.backtest_rules(_examples(spark, sf_dir), pack(spark, "prose"))[1].select("doc_id", "rule_id", "expected_fire", "fired")


def _manifests(spark, sf_dir) -> DataFrame:
    """Five manifests per part, naming the part with its size as version and without."""
    key, size = F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    f = F.format_string
    texts = {
        "requirements.txt": f("# part\np%s==%s.0\nfree-%s\n-r more.txt\n", key, size, key),
        "package.json": f('{"name":"x","dependencies":{"p%s":"^%s.0.0","free-%s":"*"},"devDependencies":{"dev-%s":"latest"}}', key, size, key, key),
        "go.mod": f("module m\n\nrequire x.org/p%s v%s.0.0\nrequire (\n\tx.org/in%s v1.0.0 // indirect\n\tx.org/free%s\n)\n", key, size, key, key),
        "Cargo.toml": f('[package]\nversion = "9"\n[dependencies]\np%s = "%s.0"\nfree-%s = { path = "../x" }\n[dev-dependencies]\nd%s = { version = "%s" }\n', key, size, key, key, size),
        "pom.xml": f("<project><dependencies>\n<dependency><groupId>g</groupId><artifactId>p%s</artifactId><version>%s</version></dependency>\n<dependency><groupId>g</groupId><artifactId>free%s</artifactId></dependency></dependencies></project>", key, size, key),
    }
    rows = F.array(*[F.struct(F.concat(key, F.lit("/" + name)).alias("path"), text.alias("content")) for name, text in texts.items()])
    return spread(table(spark, sf_dir, "part"), "p_partkey").select(F.col("p_brand").alias("job_id"), F.inline(rows)).withColumn("language", F.lit("unknown"))


@query
def dependency_inventory(spark, sf_dir):
    """What each manifest declares; `dependency_versions` looks further, in the poms above."""
    return deps.declared_dependencies(_manifests(spark, sf_dir))


@query
def unpinned_deps(spark, sf_dir):
    found = deps.scan_unpinned(deps.inventory_dependencies(_manifests(spark, sf_dir)))
    return found.select("job_id", "file", "line", "column", "rule_id", "severity", "category", "message")


@query
def unpinned_scan(spark, sf_dir):
    """The same findings out of the one-pass scan, per job."""
    return scan_corpus(_manifests(spark, sf_dir), [], OPTIONS).summary.select("job_id", "n_medium", "total_findings", "score", "passed")


def _workspaces(spark, sf_dir) -> DataFrame:
    """A pom per brand with properties and managed versions, and manifests of all sections per part below it."""
    parts = spread(table(spark, sf_dir, "part"), "p_partkey")
    key, size = F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    f = F.format_string
    dep = lambda name, version="": f"<dependency><groupId>g</groupId><artifactId>{name}</artifactId>{version and f'<version>{version}</version>'}</dependency>"
    texts = {
        "pom.xml": f(
            "<project><parent><version>%s</version></parent><properties><own.v>%s.1</own.v></properties><dependencies>"
            + dep("own%s", "${own.v}") + dep("managed") + dep("deep%s", "x-${deep}") + dep("rel", "${project.version}")
            + dep("gone", "${missing}") + dep("none") + "</dependencies></project>", size, size, key, key),
        "Cargo.toml": f(
            "[dependencies.tab%s]\nversion = \"%s\"\nfeatures = []\n\n[build-dependencies]\ncc%s = \"1\"\n[target.'cfg(unix)'.dependencies]\n"
            "nix%s = { version = \"0.%s\" }\n[dev-dependencies.free%s]\npath = \"../x\"\n", key, size, key, key, size, key),
        "package.json": f('{"peerDependencies":{"peer%s":">=%s"},"optionalDependencies":{"opt%s":"*"},"scripts":{"a":"b"}}', key, size, key),
    }
    rows = F.array(*[F.struct(F.concat(F.lit("mods/m"), key, F.lit("/" + name)).alias("path"), text.alias("content")) for name, text in texts.items()])
    own = parts.select(F.col("p_brand").alias("job_id"), F.inline(rows))
    number = F.regexp_extract("p_brand", "([0-9]+)", 1)
    roof = parts.select("p_brand", number.alias("n")).distinct().select(F.col("p_brand").alias("job_id"), F.inline(F.array(
        F.struct(F.lit("pom.xml").alias("path"), f(
            "<project><version>7</version><properties><lib.v>2.%s</lib.v><deep>${lib.v}</deep><missing.v>0</missing.v></properties><dependencyManagement><dependencies>"
            + dep("managed", "${lib.v}") + "</dependencies></dependencyManagement></project>", "n").alias("content")),
        F.struct(F.lit("mods/pom.xml").alias("path"), f("<project><properties><deep>near-%s</deep></properties></project>", "n").alias("content")),
    )))
    return own.unionByName(roof).withColumn("language", F.lit("unknown"))


@query
def dependency_versions(spark, sf_dir):
    """Versions that properties and parents of the tree tell, and the sections of every kind."""
    return deps.inventory_dependencies(_workspaces(spark, sf_dir))


@query
def manifest_rejects(spark, sf_dir):
    """A fifth of the parts has manifests that cannot be read."""
    broken = (F.col("path").rlike("^[0-9]+/") & (F.substring_index("path", "/", 1).cast("long") % 5 == 0))
    cut = F.expr("substring(content, 1, length(content) - 1)")
    text = F.when(F.col("path").endswith("package.json"), F.replace("content", F.lit("}}"), F.lit("},}")))
    text = text.when(F.col("path").endswith("pom.xml"), cut).when(F.col("path").endswith("go.mod"), F.regexp_replace("content", r"\)\n$", ""))
    text = text.when(F.col("path").endswith("Cargo.toml"), F.replace("content", F.lit("[dev-dependencies]"), F.lit("[dev-dependencies")))
    files = _manifests(spark, sf_dir).withColumn("content", F.when(broken, F.coalesce(text, "content")).otherwise(F.col("content")))
    return deps.manifest_rejects(files)


# -- whole jobs: marked texts and manifests ------------------------------------


def _whole_jobs(spark, sf_dir) -> DataFrame:
    """Documents with suppression markers, told by the id, and manifests in the same jobs."""
    docs = table(spark, sf_dir, "documents")
    first = F.substring_index("text", "\n", 1)
    rest = F.substring(F.col("text"), F.length(first) + 1, F.length("text"))
    behind = lambda marker: F.concat(first, F.lit(marker), rest)
    blank = lambda n: F.concat(F.lit("\n" * n + "scan:ignore-file\n"), "text")
    forms = [
        F.col("text"), behind(" scan:ignore"), behind(" scan:ignore TXT-303, TXT-302"), behind(" scan:ignore TXT-999"),
        behind(" scan:ignore TXT-302 here"), blank(9), blank(10),
    ]
    marked = docs.withColumn("text", F.get(F.array(*forms), (F.col("doc_id") % 7).cast("int")))
    lists = _manifests(spark, sf_dir)
    part = F.substring_index("path", "/", 1).cast("long")
    lists = lists.select(F.concat(F.lit("src"), part % 20).alias("job_id"), F.concat(F.lit("deps/"), "path").alias("path"), "language", "content")
    return inputs.as_files(marked).unionByName(lists)


@query
def scan_whole_jobs(spark, sf_dir):
    """Rules, required patterns, secrets and dependencies of one corpus, numbered per job in finding order."""
    found = scan.scan_files(spread(_whole_jobs(spark, sf_dir)), pack(spark, "prose"), OPTIONS)
    return rollup.number_findings(found).select("number", *PLACE, "message", "phase")


@query
def scan_whole_summary(spark, sf_dir):
    result = scan_corpus(_whole_jobs(spark, sf_dir), pack(spark, "prose"), OPTIONS)
    return result.summary.select("job_id", *_COUNTS, "score", "passed", "exit_code")


# -- ingest --------------------------------------------------------------------


def _deliveries(spark, sf_dir) -> DataFrame:
    o = spread(table(spark, sf_dir, "orders"), "o_orderkey")
    action = F.expr("CASE o_orderstatus WHEN 'O' THEN 'opened' WHEN 'P' THEN 'synchronize' ELSE 'closed' END")
    repo = F.expr("CASE o_orderpriority WHEN '3-MEDIUM' THEN 'alone' ELSE concat('cust', o_custkey, '/repo/', o_orderkey) END")
    body = F.format_string(
        '{"action":"%s","number":%d,"pull_request":{"head":{"sha":"%s","ref":"main","repo":{"clone_url":"https://x/%d.git","full_name":"%s"}}}}',
        action, "o_orderkey", F.md5(F.col("o_orderkey").cast("string")), "o_custkey", repo,
    )
    cut = F.when(F.col("o_orderpriority") == "4-NOT SPECIFIED", F.substring(body, F.lit(1), F.length(body) - 1)).otherwise(body)
    out = o.select("o_orderkey", "o_orderpriority", cut.alias("body"), F.col("o_orderdate").cast("timestamp").alias("received_at"))
    event = F.expr("CASE o_orderpriority WHEN '1-URGENT' THEN 'ping' ELSE 'pull_request' END")
    signed = F.when(F.col("o_orderpriority") == "5-LOW", "sha256=00").otherwise(webhook_signature(F.col("body"), signing_key(spark, SECRET)))
    return out.withColumn("event", event).withColumn("signature", signed)


@query
def webhook_jobs(spark, sf_dir):
    jobs, _ = ingest.ingest_webhooks(_deliveries(spark, sf_dir), SECRET)
    return jobs.select("id", "source", "repo_url", "repo_owner", "repo_name", "commit_sha", "branch", "pr_number", "status", *_naive("created_at"))


@query
def webhook_rejects(spark, sf_dir):
    return ingest.ingest_webhooks(_deliveries(spark, sf_dir), SECRET)[1].select("o_orderkey", "reason")


@query
def webhook_verify(spark, sf_dir):
    return audit.verify_webhooks(_deliveries(spark, sf_dir), SECRET).select("o_orderkey", "valid")


def _requests(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.expr("CASE o_orderstatus WHEN 'F' THEN '' ELSE concat('https://x/', o_custkey) END").alias("repo_url"),
        F.expr("CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE md5(cast(o_orderkey AS string)) END").alias("commit_sha"),
        F.lit("main").alias("branch"), F.col("o_orderdate").cast("timestamp").alias("created_at"),
    )


@query
def manual_jobs(spark, sf_dir):
    jobs, _ = ingest.ingest_manual_jobs(_requests(spark, sf_dir))
    return jobs.select("id", "source", "repo_url", "commit_sha", "branch", "status", *_naive("created_at"))


@query
def manual_rejects(spark, sf_dir):
    rejects = ingest.ingest_manual_jobs(_requests(spark, sf_dir))[1]
    return rejects.groupBy("reason").agg(F.count(F.lit(1)).alias("n"), F.count("commit_sha").alias("with_commit"))


# -- audit log -----------------------------------------------------------------


def _entries(spark, sf_dir) -> DataFrame:
    e = events(spark, sf_dir).select(
        F.concat(F.lit("e"), F.col("event_id")).alias("id"), F.concat(F.lit("job-"), F.col("user_id")).alias("job_id"),
        "event_type", F.concat(F.lit("user-"), F.col("user_id")).alias("actor"), F.col("props").alias("payload"),
        F.col("ts").alias("created_at"),
    )
    return audit.audit_entries(e, SECRET)


@query
def audit_signed(spark, sf_dir):
    return _entries(spark, sf_dir).select("id", "job_id", "event_type", "actor", "payload", "signature", *_naive("created_at"))


@query
def audit_lifted(spark, sf_dir):
    """Job, event type and actor come out of the payload; what is no string becomes ''."""
    e = events(spark, sf_dir)
    actor = F.when(F.col("event_type") == "error", F.col("user_id").cast("string")).otherwise(F.concat(F.lit('"u'), F.col("user_id"), F.lit('"')))
    payload = F.format_string('{"job_id":"j%d","event_type":"%s","actor":%s,"n":%d}', "user_id", "event_type", actor, "event_id")
    return audit.audit_entries(e.select(payload.alias("payload"), F.col("ts").alias("created_at")), SECRET).select(
        "job_id", "event_type", "actor", "payload", "signature")


@query
def audit_query(spark, sf_dir):
    page = audit.query_audit(_entries(spark, sf_dir), limit=50, offset=20, event_type="error",
                             since="2024-01-05 00:00:00", until="2024-01-25 12:00:00")
    return page.select("id", "job_id", "event_type", *_naive("created_at"))


@query
def audit_stored(spark, sf_dir):
    """The log appended in two batches, one of them twice, and asked for a range of days."""
    path = inputs.scratch(spark, "audit-log")
    entries = _entries(spark, sf_dir)
    for batch, part in (("a", F.col("created_at") < "2024-01-15"), ("b", F.col("created_at") >= "2024-01-15"), ("a", F.col("created_at") < "2024-01-15")):
        audit.append_audit(entries.where(part), SECRET, path, batch)
    log = audit.filter_audit(tables.read_audit(spark, path), since="2024-01-14 06:00:00", until="2024-01-16 18:00:00")
    return log.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"))


@query
def audit_by_job(spark, sf_dir):
    return audit.query_audit(_entries(spark, sf_dir), limit=0, job_id="job-7", actor="user-7").select("id", *_naive("created_at"))


@query
def audit_listing(spark, sf_dir):
    """The log as a listing, with ids of several bytes a character that are too long for their column."""
    sign = F.concat(F.lit("\u00e9\u4e2d\U0001f600"), F.col("event_id").cast("string"))
    long = F.concat(F.repeat(F.lit("x"), (F.col("event_id") % 5).cast("int")), F.repeat(sign, 3))
    entries = _entries(spark, sf_dir).withColumn("event_id", F.substring("id", 2, 20).cast("long"))
    entries = entries.withColumn("id", F.when(F.col("event_id") % 3 == 0, long).otherwise(F.col("id")))
    return audit.list_audit(entries.withColumn("job_id", F.concat("job_id", F.lit("-of-a-long-name-"), "event_id")))


@query
def text_heads(spark, sf_dir):
    """The first bytes of every document, cut between characters."""
    return table(spark, sf_dir, "documents").select("doc_id", truncate_bytes(F.col("text"), 61).alias("head"))


def _tampered(spark, sf_dir) -> DataFrame:
    """Clicks have a changed payload, signups no signature."""
    e = _entries(spark, sf_dir)
    payload = F.when(F.col("event_type") == "click", F.concat("payload", F.lit(" "))).otherwise(F.col("payload"))
    return e.withColumn("payload", payload).withColumn("signature", F.when(F.col("event_type") == "signup", "").otherwise(F.col("signature")))


@query
def audit_verify(spark, sf_dir):
    return audit.verify_audit(_tampered(spark, sf_dir), SECRET)


@query
def audit_verify_ids(spark, sf_dir):
    """Asked for by id; orders have ids the log does not know."""
    asked = table(spark, sf_dir, "orders").select(F.concat(F.lit("e"), F.col("o_orderkey")).alias("id"))
    return audit.verify_audit(_tampered(spark, sf_dir), SECRET, asked)


@query
def audit_verify_counts(spark, sf_dir):
    return audit.verification_counts(audit.verify_audit(_tampered(spark, sf_dir), SECRET))


# -- metrics -------------------------------------------------------------------


@query
def latency_histogram(spark, sf_dir):
    h = metrics.latency_histogram(events(spark, sf_dir), ["event_type"], "value")
    return h.select("event_type", "le", "bucket_count", F.round("total_sum", 4).alias("total_sum"), "total_count")


@query
def bucket_counts(spark, sf_dir):
    """Counts per whole number of a value, cumulated per type and day."""
    e = events(spark, sf_dir).select("event_type", F.to_date("ts").alias("day"), F.floor("value").alias("bound"))
    counts = e.groupBy("event_type", "day", "bound").agg(F.count(F.lit(1)).alias("n"))
    return metrics.cumulate_buckets(counts, ["event_type", "day"])


@query
def histogram_quantile(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("day", F.to_date("ts"))
    h = metrics.latency_histogram(e, ["event_type", "day"], "value")
    out = metrics.histogram_quantile(h, ["event_type", "day"], {"p50": 0.5, "p99": 0.99})
    return out.select("event_type", "day", F.round("p50", 6).alias("p50"), F.round("p99", 6).alias("p99"))


@query
def service_counters(spark, sf_dir):
    status = F.when(F.col("event_type") == "error", 500).otherwise(200)
    out = metrics.service_counters(
        events(spark, sf_dir).withColumn("service", F.lit("gateway")), metrics.request_counters(status), ["service"], "ts", "5 minutes", "value",
    )
    return out.select("service", *_naive("window_start"), "http_requests_total", "http_errors_total", F.round("latency_sum", 4).alias("latency_sum"))


@query
def event_counters(spark, sf_dir):
    kinds = F.expr("CASE event_type WHEN 'signup' THEN 'queued' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' WHEN 'view' THEN 'evaluated' ELSE 'inserted' END")
    log = events(spark, sf_dir).withColumn("type", kinds).withColumn("service", F.lit("analysis"))
    counts = metrics.service_counters(log, metrics.event_counters(), ["service"], "ts", "1 hour")
    out = metrics.counter_samples(counts, ["service"], list(metrics.EVENT_COUNTERS))
    return out.select("service", *_naive("window_start"), "metric", "value")


@query
def counter_rate(spark, sf_dir):
    """Each user's values as samples of a counter that is reset often."""
    out = metrics.counter_rate(events(spark, sf_dir), ["user_id"], 3600, "ts", "value", ("event_id",))
    return out.select("user_id", *_naive("window_start"), F.round("rate", 9).alias("rate"))


@query
def latest_value(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("value", F.when(F.col("event_type") != "view", F.col("value")))
    out = metrics.latest_value(e, ["user_id"], "ts", "value", ("event_id",))
    return out.select("user_id", "latest", *_naive("at"), metrics.band(F.col("latest")).alias("band"))


def _move() -> Column:
    return F.expr("CASE WHEN event_type IN ('signup', 'click') THEN 1 WHEN event_type IN ('purchase', 'error') THEN -1 ELSE 0 END")


@query
def queue_depth(spark, sf_dir):
    """All events move one queue, the hottest key there can be."""
    e = events(spark, sf_dir).withColumn("queue", F.lit("q"))
    out = metrics.queue_depth(e, ["queue"], "ts", "event_id", _move())
    return out.select("queue", "event_id", "depth", metrics.band(F.col("depth")).alias("band"))


@query
def queue_depth_hot(spark, sf_dir):
    """One queue that all its events reach in one hour."""
    near = F.timestamp_seconds(F.lit(1704067200) + F.col("event_id") * 7919 % 3600)
    e = events(spark, sf_dir).withColumn("queue", F.lit("q")).withColumn("ts", near)
    return metrics.queue_depth(e, ["queue"], "ts", "event_id", _move()).select("event_id", "depth")


@query
def read_samples(spark, sf_dir):
    """Samples stored in two batches, one of them twice, and asked for a range of days."""
    path = inputs.scratch(spark, "samples")
    e = events(spark, sf_dir)
    samples = e.select(
        F.col("event_type").alias("service"), F.lit("value").alias("metric"), F.lit("gauge").alias("kind"),
        F.lit(None).cast("string").alias("le"), "ts", "value",
    )
    for batch, part in (("a", F.col("ts") < "2024-01-10"), ("b", F.col("ts") >= "2024-01-10"), ("a", F.col("ts") < "2024-01-10")):
        tables.append_metric_samples(samples.where(part), path, batch)
    found = tables.read_metric_samples(spark, path, "2024-01-05 12:00:00", "2024-01-20 06:00:00")
    return found.groupBy("service", "metric", "kind").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query
def inflight_requests(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("service", F.lit("gateway")).withColumn("value", F.col("value") * 1000)
    out = metrics.inflight(e, ["service"], "ts", "event_id", "value")
    return out.select("event_id", "move", "inflight")


# -- sequences -----------------------------------------------------------------


def _as_steps(e: DataFrame) -> DataFrame:
    kind = F.expr("CASE event_type WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'failed' WHEN 'view' THEN 'finding' ELSE 'status_change' END")
    return e.select(F.col("user_id").alias("job_id"), kind.alias("type"), F.col("ts").alias("at"), F.col("event_id").alias("id"))


def _progress(spark, sf_dir) -> DataFrame:
    return _as_steps(events(spark, sf_dir))


@query
def job_progress(spark, sf_dir):
    return sequences.job_progress(_progress(spark, sf_dir)).select("job_id", "id", "type", *_naive("at"))


@query
def latest_status(spark, sf_dir):
    return sequences.latest_status(sequences.job_progress(_progress(spark, sf_dir))).select("job_id", "status", *_naive("since"))


@query
def reuse_results(spark, sf_dir):
    out = sequences.reuse_results(events(spark, sf_dir), ["user_id"], "ts", "event_id", DAY, 5 * DAY)
    return out.select("user_id", "event_id", "reused")


# -- exports -------------------------------------------------------------------


@query
def export_annotations(spark, sf_dir):
    return export.annotations(_findings(spark, sf_dir)).select("job_id", "text")


@query
def export_json_lines(spark, sf_dir):
    return export.finding_json_lines(_findings(spark, sf_dir))


def _digests(documents: DataFrame, column: str = "json") -> DataFrame:
    return documents.select("job_id", "part", F.sha2(column, 256).alias("digest"))


@query
def export_json_results(spark, sf_dir):
    return _digests(export.json_results(*_stored(spark, sf_dir), PER_PART))


@query
def export_sarif_results(spark, sf_dir):
    return export.sarif_results(_findings(spark, sf_dir)).select("job_id", "json")


@query
def export_sarif_documents(spark, sf_dir):
    return _digests(export.sarif_documents(*_stored(spark, sf_dir), pack(spark, "prose"), PER_PART))


@query
def export_text_lines(spark, sf_dir):
    return export.text_lines(_findings(spark, sf_dir)).select("job_id", "text")


@query
def export_text_heads(spark, sf_dir):
    return export.text_head(_summary(spark, sf_dir))


@query
def export_text_reports(spark, sf_dir):
    return _digests(export.text_reports(*_stored(spark, sf_dir), PER_PART), "text")


@query
def export_checkrun(spark, sf_dir):
    """All requests of each check run; their annotations add up to the findings."""
    findings, summary = _stored(spark, sf_dir)
    out = export.checkrun_payloads(findings, inputs.job_details(summary))
    notes = F.json_array_length(F.get_json_object("json", "$.output.annotations")).cast("long")
    return out.select("job_id", "part", notes.alias("notes"), F.sha2("json", 256).alias("digest"))


@query
def export_pr_comment(spark, sf_dir):
    findings, summary = _stored(spark, sf_dir)
    return export.pr_comments(findings, inputs.job_details(summary))


@query
def export_chat(spark, sf_dir):
    return export.chat_messages(_results(spark, sf_dir))


@query
def export_mail(spark, sf_dir):
    return export.mail_messages(_results(spark, sf_dir))


@query
def notify_outbox(spark, sf_dir):
    asked = _results(spark, sf_dir).withColumn("targets", F.array(F.lit("slack"), F.lit("email"), F.lit("pager")))
    return export.notifications(asked)


def _samples(spark, sf_dir) -> DataFrame:
    h = metrics.latency_histogram(events(spark, sf_dir), ["event_type"], "value")
    row = lambda metric, le, value: F.struct(F.lit(metric).alias("metric"), le.alias("le"), value.cast("double").alias("value"))
    none = F.lit(None).cast("string")
    cells = F.array(
        row("request_ms_bucket", F.col("le"), F.col("bucket_count")),
        row("request_ms_sum", none, F.col("total_sum")), row("request_ms_count", none, F.col("total_count")),
    )
    long = h.select(F.col("event_type").alias("service"), F.inline(cells))
    kind = F.lit("histogram")
    total = events(spark, sf_dir).groupBy(F.col("event_type").alias("service")).agg(F.count(F.lit(1)).cast("double").alias("value"))
    counter = total.select("service", F.lit("seen_total").alias("metric"), none.alias("le"), "value", F.lit("counter").alias("kind"))
    return long.distinct().withColumn("kind", kind).unionByName(counter)


@query
def export_exposition(spark, sf_dir):
    return export.exposition(_samples(spark, sf_dir)).select("service", "text")


@query
def read_exposition(spark, sf_dir):
    """Written as metric text and read back."""
    lines = export.exposition(_samples(spark, sf_dir)).withColumn("ts", F.lit(inputs.DONE_AT).cast("timestamp"))
    return tables.parse_exposition(lines.select("service", "ts", "text")).select("service", "metric", "kind", "le", "value")


# -- streams, run until the given files are used up ------------------------------


def _stream(spark, sf_dir, name: str, order: str, files: int = 4, mixed: bool = False) -> DataFrame:
    """The table as files that arrive one after the other, each a micro-batch of its own.

    With `mixed` every tenth row comes a file later than its time says.
    """
    rows = table(spark, sf_dir, name)
    at = F.col(order).cast("timestamp").cast("double") if dict(rows.dtypes)[order].startswith("timestamp") else F.col(order).cast("double")
    low, high = rows.agg(F.min(at), F.max(at)).first()
    low, width = low or 0.0, ((high or 0.0) - (low or 0.0)) / files or 1.0
    part = F.floor((at - low) / width)
    if mixed:
        part = part + F.when(F.col("event_id") % 10 == 0, 1).otherwise(0)
    return _arriving(rows, name, F.coalesce(F.least(F.lit(files - 1), part), F.lit(0)), files)


def _arriving(rows: DataFrame, name: str, part: Column, files: int) -> DataFrame:
    """A micro-batch per part: each is written as the same number of files, by as many tasks as read the rows."""
    spark = rows.sparkSession
    folder = inputs.scratch(spark, f"arriving-{name}")
    pieces = max(1, rows.rdd.getNumPartitions())
    dealt = rows if pieces == 1 else rows.repartition(pieces)
    for i in range(files):  # files are taken in the order in which they were written
        dealt.where(part == i).coalesce(pieces).write.mode("append").parquet(folder)
        # A piece without rows, of a small part, has no file: empty ones stand for these.
        for _ in range((i + 1) * pieces - len(spark.read.schema(rows.schema).parquet(folder).inputFiles())):
            rows.limit(0).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", pieces).parquet(folder)


def _drain(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """All rows the stream has written when its input is used up."""
    spark = stream.sparkSession
    out = inputs.scratch(spark, name)
    running = stream_scans.stream_append(stream, f"{out}/rows", f"{out}/checkpoint", True, mode)
    running.awaitTermination()
    return spark.read.option("basePath", f"{out}/rows").parquet(f"{out}/rows/batch_id=*")


@query
def stream_scan(spark, sf_dir):
    """The documents as arriving files; every job has files in all micro-batches and is closed once."""
    out = inputs.scratch(spark, "stream_scan")
    files = inputs.as_files(_stream(spark, sf_dir, "documents", "doc_id"))
    stream_scans.stream_scan(files, pack(spark, "prose"), out, f"{out}/checkpoint", OPTIONS, available_now=True).awaitTermination()
    jobs = stream_scans.seen_jobs(spark, out)
    for closing in range(2):  # the second time nothing is left to close
        stream_scans.close_jobs(spark, out, jobs, closing, OPTIONS, SECRET)
    result = stream_scans.read_output(spark, out, "summary").join(stream_scans.read_output(spark, out, "outbox").select("job_id", "target"), "job_id")
    return result.select("job_id", *_COUNTS, "score", "passed")


@query
def stream_metrics(spark, sf_dir):
    log = _stream(spark, sf_dir, "events", "ts")
    live = stream_metric.stream_metrics(log, ["event_type"], "ts", "value", F.col("event_type") == "error", 3600)
    out = stream_scans.latest_rows(_drain(live, "stream_metrics", "update"), ["event_type", "window_start"])
    return out.select("event_type", *_naive("window_start"), "requests", "errors", F.round("requests_per_second", 9).alias("rate"),
                      F.round("p50", 6).alias("p50"), F.round("p99", 6).alias("p99"))


@query
def stream_late(spark, sf_dir):
    """Files that each hold all times: rows behind the watermark are counted apart, and a repair run adds them."""
    rows, keys = table(spark, sf_dir, "events"), ["event_type"]
    out = inputs.scratch(spark, "stream_late")
    log = _arriving(rows, "events", F.pmod(F.col("event_id"), F.lit(4)), 4)
    error = F.col("event_type") == "error"
    stream_metric.run_metrics(log, keys, f"{out}/tables", f"{out}/checkpoint", "ts", "value", error, 3600, 20 * DAY, available_now=True).awaitTermination()
    total = lambda repaired, name: stream_metric.read_metrics(
        spark, f"{out}/tables", keys, "ts", "value", error, 3600, repaired=repaired).groupBy(*keys).agg(F.sum("requests").alias(name))
    late = stream_metric.late_rows(spark, f"{out}/tables").groupBy(*keys).agg(F.count(F.lit(1)).alias("late"))
    counts = total(False, "in_time").join(late, keys, "full").join(total(True, "repaired"), keys, "full")
    return counts.fillna(0)


def _run_to_end(stream, rows: DataFrame, out: str) -> DataFrame:
    """The outcome of all rows once the stream and what waited have ended."""
    stream.start(rows, f"{out}/checkpoint", available_now=True).awaitTermination()
    stream.end(rows)
    return stream_sequences.read_outcome(rows.sparkSession, stream.out)


@query
def stream_reuse(spark, sf_dir):
    """Events that come in files out of order, decided in the order of their times."""
    out = inputs.scratch(spark, "stream_reuse")
    stream = stream_sequences.ReuseStream(["user_id"], "ts", "event_id", f"{out}/tables", DAY, 16 * DAY)
    return _run_to_end(stream, _stream(spark, sf_dir, "events", "ts", mixed=True), out).select("user_id", "event_id", "reused")


@query
def stream_progress(spark, sf_dir):
    """The same for the progress of jobs."""
    out = inputs.scratch(spark, "stream_progress")
    stream = stream_sequences.ProgressStream(f"{out}/tables", delay_seconds=16 * DAY, keep_seconds=90 * DAY)
    rows = _as_steps(_stream(spark, sf_dir, "events", "ts", mixed=True))
    return _run_to_end(stream, rows, out).select("job_id", "id", "type", *_naive("at"))


@query
def stream_latest_status(spark, sf_dir):
    live = stream_sequences.stream_latest_status(_as_steps(_stream(spark, sf_dir, "events", "ts")))
    out = stream_scans.latest_rows(_drain(live, "stream_latest_status", "update"), ["job_id"])
    return out.select("job_id", "status", *_naive("since"))


@query
def stream_audit(spark, sf_dir):
    """Entries signed as they arrive, then read back and verified."""
    e = _stream(spark, sf_dir, "events", "ts").select(
        F.concat(F.lit("e"), F.col("event_id")).alias("id"), F.concat(F.lit("job-"), F.col("user_id")).alias("job_id"),
        "event_type", F.lit("").alias("actor"), F.col("props").alias("payload"), F.col("ts").cast("timestamp").alias("created_at"),
    )
    out = inputs.scratch(spark, "stream_audit")
    stream_scans.stream_audit(e, SECRET, f"{out}/log", f"{out}/checkpoint", True).awaitTermination()
    log = tables.read_audit(spark, f"{out}/log")
    return log.select("id", "signature", *_naive("created_at")).join(audit.verify_audit(log, SECRET), "id")
