import json
import random

import pytest
from pyspark.sql import functions as F

from siftmark import schemas
from siftmark.functions.dialect import PatternError, translate
from siftmark.operators import backtest, deps, rollup, scan
from siftmark.plans.scan_job import scan_corpus
from siftmark.sources import rules as R

MARK = "scan:ignore"


def rule(match, languages=("*",), rule_id="R-1", severity="high", **kw):
    pattern = R.Pattern("regex", match, 0, kw.pop("negate", False))
    return R.Rule(rule_id, pattern, severity=severity, languages=tuple(languages), message="m",
                  category=kw.pop("category", "security"), enabled=kw.pop("enabled", True), **kw)


def files(spark, *rows):
    """rows of (path, language, content) in one job."""
    return spark.createDataFrame([("j", *r) for r in rows], schemas.FILES)


def found(spark, rules, *rows, **opts):
    opts = scan.ScanOptions(secrets=opts.pop("secrets", False), deps=opts.pop("deps", False), **opts)
    out = scan.scan_files(files(spark, *rows), R.check_rules(spark, rules), opts)
    return out.orderBy("job_id", *scan.finding_order()).collect()


def test_match(spark):
    [f] = found(spark, [rule(r"\beval\s*\(", ["javascript"])], ("app.js", "javascript", "eval(userInput);"))
    assert (f.line, f.column, f.severity, f.file, f.snippet) == (1, 1, "high", "app.js", "eval(userInput);")


def test_disabled_and_language(spark):
    assert found(spark, [rule("password", enabled=False)], ("c.go", "go", 'password = "secret"')) == []
    got = found(spark, [rule(r"panic\(", ["GO"])], ("a.go", "go", "panic(1)"), ("a.js", "javascript", "panic(1)"))
    assert [f.file for f in got] == ["a.go"]
    assert found(spark, [rule("x", [])], ("a", "go", "x")) == []
    got = found(spark, [rule("TODO.*security")], *[(f"f{i}", l, "// TODO: fix security") for i, l in enumerate(["go", "python", "rust"])])
    assert len(got) == 3


def test_required_pattern(spark):
    r = [rule("SPDX-License-Identifier", ["go"], negate=True)]
    assert found(spark, r, ("a.go", "go", "// SPDX-License-Identifier: MIT\n")) == []
    [f] = found(spark, r, ("a.go", "go", "package a\n"))
    assert (f.line, f.column, f.snippet) == (1, 1, "")
    assert len(found(spark, r, ("a.go", "go", ""))) == 1
    assert found(spark, r, ("a.go", "go", f"{MARK}-file\n")) == []
    assert len(found(spark, r, ("a.go", "go", f"package a // {MARK}\n"))) == 1


def test_lines_and_columns(spark):
    got = found(spark, [rule(r"secret\s*=")], ("f", "x", "secret = 1\nno\nsecret = 2\n"))
    assert [f.line for f in got] == [1, 3]
    got = found(spark, [rule("x")], ("f", "x", "x x"))
    assert [(f.line, f.column) for f in got] == [(1, 1)]
    [f] = found(spark, [rule("==")], ("f", "x", "é😀 a == b"))
    assert f.column == 10


ENDS = [("x\r\n", [1]), ("x\n\n", [1]), ("a\nx", [2]), ("", []), ("x\r", [1]), ("x\r\r\n", []), ("\n\nx\n", [3])]


def test_line_ends(spark):
    got = found(spark, [rule("x$")], *[(f"f{i}", "x", t) for i, (t, _) in enumerate(ENDS)])
    assert [[f.line for f in got if f.file == f"f{i}"] for i in range(len(ENDS))] == [l for _, l in ENDS]


def test_empty_lines_are_lines(spark):
    rows = [("f1", "x", ""), ("f2", "x", "\n"), ("f3", "x", "a\n\n"), ("f4", "x", "a")]
    got = found(spark, [rule("^$")], *rows)
    assert [(f.file, f.line) for f in got] == [("f2", 1), ("f3", 2)]


def test_markers(spark):
    tails = {"": 0, " R-1": 0, " R-2": 1, " R-1 because": 1, " R-2, R-1": 0}
    rows = [(f"f{i}", "x", f"bad // {MARK}{t}") for i, t in enumerate(tails)]
    rows += [("head10", "x", "\n" * 9 + f"// {MARK}-file\nbad\n"), ("head11", "x", "\n" * 10 + f"// {MARK}-file\nbad\n")]
    hits = {f.file for f in found(spark, [rule("bad")], *rows)}
    assert hits == {f"f{i}" for i, n in enumerate(tails.values()) if n} | {"head11"}


def test_literals_and_rare_syntax(spark):
    text = "a+b (c)\n1?\n[x]\u00e9\n"
    cases = [("literal", "+b (", [1]), ("literal", "[x]", [3]), ("literal", ".", []), ("regex", "(?U)a.*b", [1]), ("regex", "^[[:^alpha:]]", [2, 3]), ("regex", "[^[:^digit:]]", [2]), ("regex", "x{0,1000}y", [])]
    for kind, match, lines in cases:
        r = R.Rule("R-1", R.Pattern(kind, match), severity="low", languages=("*",), enabled=True)
        assert sorted(f.line for f in scan.scan_files(files(spark, ("f", "x", text)), R.check_rules(spark, [r]), scan.ScanOptions(secrets=False, deps=False)).collect()) == lines, match


def test_marker_does_not_hide_secrets(spark):
    token = "xK9pL2mN5qR8sT1uV4wX7yZ0aB3cD6eF"
    got = found(spark, [], ("f", "x", f"// {MARK}-file\nkey = \"{token}\"  // {MARK}\n"), secrets=True, entropy_threshold=4.0)
    assert [f.rule_id for f in got] == ["ENT-001"]


DIALECT = [
    (r"\bmd5", "émd5", 1), (r"\bmd5", "amd5", 0), (r"a\sb", "a\x0bb", 0), (r"a\sb", "a\tb", 1), ("(?i)kk", "kK", 1),
    ("[[]x", "[x", 1), ("[a&&b]", "&", 1), (r"a{", "a{", 1), (r"\v", "\x0b", 1), (r"(?P<n>ab)+$", "xabab", 1),
    (r"\Qa.b\E", "a.b", 1), (r"\Qa.b\E", "axb", 0), (r"[[:digit:]]{2}", "a12", 1), (r"[^\S]x", " x", 1), (r"a.b", "a b", 1),
    (r"(?s)a.b", "a\x85b", 1), (r"x\B", "xy", 1), (r"(?i:AB)c", "abc", 1), (r"(?i:AB)c", "abC", 0), (r"\pL+\x{41}", "éA", 1),
    (r"localStorage\([^,]+,.*(?i)(token|key)", "localStorage(a, KEY)", 1), (r"^\s{2,}if\b", "  if x", 1),
    (r"ab*c", "ac", 1), (r"(?i)straße", "STRASSE", 0), ("a|b(c|d)", "bd", 1), (r"\.unwrap\(\)", "x.unwrap()", 1),
]


def test_dialect(spark):
    """All patterns in one scan: pattern i only looks at file i."""
    rules = [rule(p, [f"l{i}"], f"R-{i}") for i, (p, _, _) in enumerate(DIALECT)]
    rows = [(f"f{i}", f"l{i}", "0\n" + t + "\n0") for i, (_, t, _) in enumerate(DIALECT)]
    hits = [f.file for f in found(spark, rules, *rows)]
    assert {(p, t): hits.count(f"f{i}") for i, (p, t, _) in enumerate(DIALECT)} == {(p, t): n for p, t, n in DIALECT}


@pytest.mark.parametrize("pattern", ["[invalid", "(a", "a)", "a**", "a++", "(?=x)", "(?<!x)", r"\1", "*a", r"\8", "a\\", "a{1001}", "a{2,1001}", "[[:^nope:]]"])
def test_bad_patterns_name_their_rule(spark, pattern):
    with pytest.raises(R.RulePackError, match="R-9"):
        R.check_rules(spark, [rule(pattern, rule_id="R-9", enabled=False)])
    with pytest.raises(PatternError):
        translate(pattern)


def test_double_ids_are_refused(spark):
    with pytest.raises(R.RulePackError, match="twice"):
        R.check_rules(spark, [rule("a"), rule("b")])


def test_other_pattern_types_find_nothing(spark):
    r = R.Rule("R-1", R.Pattern("ast", "[x"), languages=("*",), enabled=True)
    assert found(spark, [r], ("f", "x", "[x")) == []


def test_many_rules_use_several_masks(spark):
    rules = [rule(f"w{i}\\b", rule_id=f"R-{i:03d}") for i in range(150)]
    got = found(spark, rules, ("f", "x", "\n".join(f"w{i}" for i in range(0, 150, 7))))
    assert sorted(f.rule_id for f in got) == [f"R-{i:03d}" for i in range(0, 150, 7)]


def test_walk_order(spark):
    rows = [(p, "x", "b\na") for p in ("a-b/f", "a/z", "a.txt", "a/b/c")]
    got = found(spark, [rule("a", rule_id="A"), rule("b", rule_id="B")], *rows)
    assert [(f.file, f.rule_id) for f in got] == [
        (p, r) for p in ("a/b/c", "a/z", "a-b/f", "a.txt") for r in ("A", "B")
    ]


KEY = "xK9pL2mN5qR8sT1uV4wX7yZ0aB3cD6eFgHiJkLmN6789"


SECRETS = [
    (f'const apiKey = "{KEY}"', 4.5, 1), ('const env = "production"', 4.5, 0), (f'// const apiKey = "{KEY}"', 4.5, 0),
    (f'  # k = "{KEY}"', 4.5, 0), (f"a: '{KEY}', b = \"short\", c=\"{KEY[::-1]}\"", 4.5, 2),
    ('token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"', 4.5, 0), ('token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"', 3.0, 1),
    (f'"{KEY}"', 4.5, 0), (f'k = "{KEY}!"', 4.5, 0), (f'k = "{KEY}"', 0, 1), (f'{"k" * 500} {KEY}', 4.5, 0),
]


def test_secrets(spark):
    for threshold in {t for _, t, _ in SECRETS}:
        cases = [(f"f{i}", text, n) for i, (text, t, n) in enumerate(SECRETS) if t == threshold]
        got = found(spark, [], *[(p, "x", text) for p, text, _ in cases], secrets=True, entropy_threshold=threshold)
        assert {p: sum(f.file == p for f in got) for p, _, _ in cases} == {p: n for p, _, n in cases}
        for f in got:
            assert (f.rule_id, f.severity, f.column) == ("ENT-001", "high", 1)
            assert "***" in f.message and KEY not in f.message


@pytest.mark.parametrize("text, low, high", [
    ("abcd", 2.0, 2.0), ("aaaa", 0, 0), ("", 0, 0), ("xK9pL2mN5qR8sT1uV4wX7yZ0aB3cD6eF", 4.0, 5.1), ("password", 0, 4.5),
])
def test_entropy(spark, text, low, high):
    from siftmark.functions.entropy import shannon

    assert low <= spark.createDataFrame([(text,)], "t string").select(shannon(F.col("t"))).first()[0] <= high


def test_entropy_text_is_cut(spark):
    from siftmark.functions.entropy import entropy_text, redact

    df = spark.createDataFrame([(4.999, "abcdefghijkl"), (3.05, "12345678")], "e double, v string")
    got = df.select(entropy_text(F.col("e")), redact(F.col("v"))).collect()
    assert [tuple(r) for r in got] == [("4.99", "abcd***ijkl"), ("3.05", "***")]


MANIFESTS = [
    ("requirements.txt", "flask\nrequests==2.28.0 # pin\n# no\n-r x.txt\n\nnumpy[extra]>=1.2\n", [("flask", ""), ("requests", "2.28.0"), ("numpy", "1.2")]),
    ("web/package.json", '{"dependencies": {"a": "^1.0", "b": "*"}, "devDependencies": {"c": "latest", "d": ""}}', [("a", "^1.0"), ("b", ""), ("c", ""), ("d", "")]),
    ("go.mod", "module m\n\nrequire x.org/a v1.0.0\nrequire (\n\tx.org/b v2.0.0 // indirect\n\tx.org/c\n)\n", [("x.org/a", "v1.0.0"), ("x.org/b", "v2.0.0"), ("x.org/c", "")]),
    ("Cargo.toml", '[package]\nname = "p"\nversion = "1"\n\n[dependencies]\nserde = "1.0"\nlocal = { path = "../l" }\nrand = { version = "0.8", features = ["x"] }\n[dev-dependencies]\nany = "*"\n[profile]\nz = "1"\n',
     [("serde", "1.0"), ("local", ""), ("rand", "0.8"), ("any", "")]),
    ("pom.xml", "<project><dependencies><dependency><groupId>g</groupId><artifactId>a</artifactId></dependency><!-- <dependency></dependency> -->\n<dependency><groupId>g</groupId><artifactId>b</artifactId><version> 1.2 </version></dependency></dependencies></project>",
     [("g:a", ""), ("g:b", "1.2")]),
    ("package.json", "not json", []), ("notes.txt", "flask\n", []),
]


def test_dependencies(spark):
    fs = files(spark, *[(p if i < 5 else f"d{i}/{p}", "x", c) for i, (p, c, _) in enumerate(MANIFESTS)])
    got = {}
    for r in deps.inventory_dependencies(fs).collect():
        got.setdefault(r.path.split("/")[-1], []).append((r.name, r.version))
    # Versions come by joins, so rows have no order.
    assert {p: sorted(d) for p, d in got.items()} == {p.split("/")[-1]: sorted(d) for p, _, d in MANIFESTS if d}
    direct = deps.scan_unpinned(deps.inventory_dependencies(fs)).select("file", "message").collect()
    scanned = scan.scan_files(fs, [], scan.ScanOptions(secrets=False)).select("file", "message").collect()
    assert sorted(direct) == sorted(scanned) and len(direct) == 1 + 3 + 1 + 2 + 1
    strict = deps.inventory_dependencies(fs, strict=True).where("name = 'numpy'").first()
    assert strict.version == ""


PIPELINE = [
    rule(r"""(?i)password\s*=\s*["'][^"']{4,}["']""", rule_id="P-1", severity="critical"),
    rule(r"fmt\.Println\(", ["go"], rule_id="P-2", severity="low", category="quality"),
    rule(r"\beval\s*\(", ["javascript"], rule_id="P-3"),
]


CASES = {
    "clean": [("main.go", "go", "package main\n\nfunc main() {\n}\n")],
    "secret": [("config.go", "go", 'const password = "supersecret123"\nvar dbPassword = "hunter2_production"\n')],
    "debug": [("debug.go", "go", 'func foo() { fmt.Println("debug") }\n')],
    "many": [("a.go", "go", 'fmt.Println("a")\n'), ("b.go", "go", 'fmt.Println("b")\n'), ("c.js", "javascript", "eval(x);\n")],
    "deps": [("requirements.txt", "unknown", "flask\nrequests==2.28.0\n")],
}


def test_pipeline(spark):
    """All cases as jobs of one scan."""
    fs = spark.createDataFrame([(job, *f) for job, rows in CASES.items() for f in rows], schemas.FILES)
    got = {r.job_id: r for r in scan_corpus(fs, R.check_rules(spark, PIPELINE)).summary.collect()}
    s = got["clean"]
    assert (s.passed, s.score, s.total_findings, s.by_severity) == (True, 100, 0, {})
    s = got["secret"]
    assert (s.passed, s.by_severity["critical"], s.score) == (False, 2, 60)
    s = got["debug"]
    assert (s.passed, s.n_low, s.score, s.exit_code) == (True, 1, 99, 0)
    s = got["many"]
    assert (s.total_findings, s.by_category, s.exit_code) == (3, {"quality": 2, "security": 1}, 1)
    s = got["deps"]
    assert (s.n_medium, s.score) == (1, 96)


def made(spark, *severities):
    rows = [("j", f"r{i}", "n", "security", s, "f", 1, 1, "m", "", "", 0, i, 0) for i, s in enumerate(severities)]
    return spark.createDataFrame(rows, schemas.FINDINGS)


def test_score_and_gate(spark):
    jobs = {"mixed": ["critical", "high", "medium", "low"] + ["info"] * 9, "worst": ["critical"] * 6, "info": ["info"], "high": ["high"]}
    found = None
    for job, severities in jobs.items():
        part = made(spark, *severities).withColumn("job_id", F.lit(job))
        found = part if found is None else found.unionByName(part)
    wide = rollup.summarise(found)
    for level in ("critical", "high", "medium", "low", "never", "other"):
        wide = rollup.gate(wide, level).withColumnRenamed("exit_code", level).drop("fail_on")
    got = {r.job_id: r for r in rollup.gate(wide, "").collect()}
    assert got["mixed"].score == 65 and not got["mixed"].passed and got["worst"].score == 0
    codes = lambda r: [r[level] for level in ("critical", "high", "exit_code", "medium", "low", "never", "other")]
    assert codes(got["info"]) == [0, 0, 0, 0, 1, 0, 0]
    assert codes(got["high"]) == [0, 1, 1, 1, 1, 0, 0]
    assert codes(got["mixed"]) == [1, 1, 1, 1, 1, 0, 0]


def test_parts_lose_nothing(spark):
    many = made(spark, *["low"] * 57).withColumn("file", F.concat(F.lit("f"), F.col("rule_seq").cast("string")))
    parts = rollup.nested_verdict(many, per_part=10).collect()
    assert sum(len(p.warnings) for p in parts) == 57
    assert max(len(p.rules) for p in parts) <= 10 and len(parts) > 5
    [one] = rollup.nested_verdict(many, per_part=100).collect()
    assert [r.rule_id for r in one.rules] == [r.rule_id for r in many.orderBy(*scan.finding_order()).collect()]


def test_limit_cuts_before_the_summary(spark):
    fs = files(spark, ("a.go", "go", 'fmt.Println("a")\nfmt.Println("b")\nPassword = "abcdef"'))
    out = scan_corpus(fs, R.check_rules(spark, PIPELINE), scan.ScanOptions(max_findings=2))
    assert out.summary.first().by_severity == {"critical": 1, "low": 1}
    assert out.verdict.first().n_warnings == 1


def test_backtest(spark):
    rules = R.load_rules(spark, R.PACKS + "/prose") + R.load_rules(spark, R.PACKS + "/weakness")
    report, failing = backtest.backtest_rules(backtest.inline_examples(spark, rules), rules)
    assert failing.collect() == []
    assert report.count() >= 3
    wrong = spark.createDataFrame([("TXT-105", True, "nothing"), ("TXT-901", True, "$X == $X"), ("NO-1", True, "x"), ("TXT-501", True, "no end")],
                                  "rule_id string, expected_fire boolean, snippet string")
    report, failing = backtest.backtest_rules(wrong, rules)
    assert sorted(r.rule_id for r in failing.collect()) == ["NO-1", "TXT-105", "TXT-901"]
    assert {r.rule_id: (r.total, r.passed, r.failed) for r in report.collect()}["TXT-501"] == (1, 1, 0)


def test_pack_loading(spark, tmp_path):
    (tmp_path / "b.yaml").write_text('rules:\n  - {id: B-1, pattern: {type: regex, match: b}, fix_suggestion: do}\n')
    (tmp_path / "a.yaml").write_text('rules:\n  - {id: A-1, enabled: true, languages: ["*"], pattern: {type: regex, match: a, max: 3}}\n')
    (tmp_path / "c.yml").write_text("rules: [")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "d.yaml").write_text("rules: [")
    got = R.load_rules(spark, str(tmp_path))
    assert [(r.rule_id, r.enabled, r.fix) for r in got] == [("A-1", True, ""), ("B-1", False, "do")]
    assert R.rules_from_frame(R.read_rule_pack(spark, str(tmp_path))) == got
    assert R.load_rules(spark, f"file://{tmp_path}") == got
    (tmp_path / "e.yaml").write_text("rules: [")
    with pytest.raises(R.RulePackError, match="e.yaml"):
        R.load_rules(spark, str(tmp_path))


LONG = "".join(f"line {i} {'bad' if i % 97 == 0 else 'good'}{chr(13) if i % 11 == 0 else ''}\n" for i in range(3000))


@pytest.mark.parametrize("tail", ["", "\n", "\n\n", "bad", "bad\r"])
def test_long_texts_in_ranges(spark, tail):
    """Cut into ranges, a text gives the same findings, also those of the whole text and of its last line."""
    rules = [rule("bad$"), rule("needed", negate=True, rule_id="R-2"), rule("^$", rule_id="R-3"), rule("never there", rule_id="R-4")]
    rows = [("long.txt", "x", LONG + tail), ("short.txt", "x", "bad"), ("off.txt", "x", f"{MARK}-file\n" + LONG), ("empty.txt", "x", "")]
    plain = found(spark, rules, *rows)
    for lines in (1, 7, 1000, 5000):
        assert found(spark, rules, *rows, long_text=100, long_texts=scan.DEALT, range_lines=lines) == plain
    assert len(plain) > 25
    listed = [f for f in found(spark, rules, *rows, long_text=100, long_texts=scan.LISTED) if f.phase == scan.PHASE_LISTED]
    assert [f.file for f in listed] == ["long.txt", "off.txt"]


def test_stored_scans_deal_long_texts(spark, tmp_path):
    from siftmark.plans.scan_job import run_scan

    rules = R.check_rules(spark, [rule("bad$"), rule("needed", negate=True, rule_id="R-2")])
    df = files(spark, ("long.txt", "x", LONG), ("short.txt", "x", "bad"))
    plain = scan.scan_files(df, rules, scan.ScanOptions(secrets=False, deps=False))
    for most in (0, 10):
        opts = scan.ScanOptions(secrets=False, deps=False, long_text=100, range_lines=40, max_findings=most)
        got = run_scan(spark, df, rules, str(tmp_path / str(most)), opts).findings
        want = rollup.cap_findings(plain, most).drop("rank")
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_a_long_text_is_spread_over_tasks(spark):
    df = files(spark, ("long.txt", "x", LONG))
    out = scan.scan_files(df, R.check_rules(spark, [rule("good")]), scan.ScanOptions(secrets=False, deps=False, long_text=100, long_texts=scan.DEALT, range_lines=50))
    assert out.withColumn("task", F.spark_partition_id()).select("task").distinct().count() > 1


def test_one_split_per_text_however_many_rules(spark, capsys):
    """No rule has a row or a copy of the text of its own: the plan has one generator, behind all tests."""
    rules = [rule(f"word{i}", rule_id=f"R-{i}") for i in range(30)]
    scan.scan_files(files(spark, ("f", "x", "t")), R.check_rules(spark, rules), scan.ScanOptions(secrets=False, deps=False)).explain()
    plan = capsys.readouterr().out
    assert plan.count("Generate") == 1 and "Exchange" not in plan


def test_own_pattern_types(spark):
    from siftmark.sources import pattern_types as P

    P.register(P.PatternType("max_length", line=lambda p, line: F.length(line) > p.max, file=lambda p, body: F.length(body) > p.max,
                             place=lambda p, line: F.lit(p.max + 1), check=_positive))
    try:
        made = lambda i, most, **kw: R.Rule(i, R.Pattern("max_length", "", most, **kw), severity="low", languages=("*",), enabled=True, message="m")
        rows = [("a", "x", "short\n" + "y" * 30 + f"\n{'z' * 40} // {MARK}\n"), ("b", "x", "ab"), ("c", "x", "")]
        got = found(spark, [made("L-1", 20), rule("y+"), made("L-2", 25, negate=True)], *rows)
        assert [(f.rule_id, f.file, f.line, f.column) for f in got] == [("L-1", "a", 2, 21), ("R-1", "a", 2, 1), ("L-2", "b", 1, 1), ("L-2", "c", 1, 1)]
        with pytest.raises(R.RulePackError, match="L-0"):
            R.check_rules(spark, [made("L-0", 0)])
        examples = spark.createDataFrame([("L-1", True, "x" * 21), ("L-1", False, "x"), ("L-2", True, "x")], "rule_id string, expected_fire boolean, snippet string")
        assert [r.failed for r in backtest.backtest_rules(examples, [made("L-1", 20), made("L-2", 25, negate=True)])[0].collect()] == [0, 0]
    finally:
        P.unregister("max_length")
    assert found(spark, [made("L-1", 20)], ("a", "x", "y" * 30)) == []  # an unknown type finds nothing
    with pytest.raises(ValueError):
        P.register(P.PatternType("neither"))


def _positive(pattern):
    if pattern.max <= 0:
        raise ValueError("max must be positive")


MORE_MANIFESTS = [
    ("package.json", '{"dependencies":{"a":"1"},"peerDependencies":{"b":">=2"},"optionalDependencies":{"c":"*"}}', [("a", "1"), ("b", ">=2"), ("c", "")]),
    ("Cargo.toml", "[dependencies.one]\nversion = '1.2'\nfeatures = ['x']\n[dependencies.two]\npath = '..'\n[build-dependencies]\nthree = \"3\"\n[target.'cfg(unix)'.dev-dependencies]\nfour = { version = \"4\" }\n[package]\nversion = \"9\"\n",
     [("one", "1.2"), ("two", ""), ("three", "3"), ("four", "4")]),
    ("pom.xml", "<project><version>7</version><properties><a.v>1</a.v><b>${a.v}.2</b></properties><dependencyManagement><dependencies><dependency><groupId>g</groupId><artifactId>m</artifactId><version>5</version></dependency></dependencies></dependencyManagement><dependencies>"
     "<dependency><groupId>g</groupId><artifactId>m</artifactId></dependency><dependency><groupId>g</groupId><artifactId>p</artifactId><version>${b}</version></dependency><dependency><groupId>g</groupId><artifactId>s</artifactId><version>${project.version}</version></dependency></dependencies></project>",
     [("g:m", "5"), ("g:p", "1.2"), ("g:s", "7")]),
]


@pytest.mark.parametrize("path, text, want", MORE_MANIFESTS)
def test_sections_and_own_versions(spark, path, text, want):
    got = deps.declared_dependencies(files(spark, (path, "unknown", text))).collect()
    assert sorted((d.name, d.version) for d in got) == sorted(want)


def pom(*body):
    return "<project>" + "".join(body) + "</project>"


def dependency(name, version=None):
    return f"<dependency><groupId>g</groupId><artifactId>{name}</artifactId>{f'<version>{version}</version>' if version else ''}</dependency>"


def test_versions_of_parents(spark):
    """The nearest pom above tells; other jobs and folders beside do not."""
    managed = lambda *d: "<dependencyManagement><dependencies>" + "".join(d) + "</dependencies></dependencyManagement>"
    rows = [
        ("j", "pom.xml", pom("<properties><v>1</v><w>${v}0</w></properties>", managed(dependency("m", "${w}")))),
        ("j", "a/pom.xml", pom("<properties><v>2</v></properties>")),
        ("j", "a/b/pom.xml", pom("<dependencies>", dependency("x", "${v}"), dependency("m"), dependency("n"), dependency("y", "${none}"), "</dependencies>")),
        ("j", "c/pom.xml", pom("<dependencies>", dependency("x", "${v}"), "</dependencies>")),
        ("k", "a/b/pom.xml", pom("<dependencies>", dependency("x", "${v}"), "</dependencies>")),
        ("k", "requirements.txt", "flask\n"),
    ]
    df = spark.createDataFrame([(j, p, "unknown", t) for j, p, t in rows], schemas.FILES)
    got = {(d.job_id, d.path, d.name): d.version for d in deps.inventory_dependencies(df).collect()}
    assert got == {
        ("j", "a/b/pom.xml", "g:x"): "2", ("j", "a/b/pom.xml", "g:m"): "20", ("j", "a/b/pom.xml", "g:n"): "", ("j", "a/b/pom.xml", "g:y"): "",
        ("j", "c/pom.xml", "g:x"): "1", ("k", "a/b/pom.xml", "g:x"): "", ("k", "requirements.txt", "flask"): "",
    }


def test_manifests_that_cannot_be_read(spark):
    rows = [
        ("a/package.json", '{"dependencies": {"a": "1"},}', "no JSON object"), ("b/package.json", "[1]", "no JSON object"), ("c/package.json", "{}", None),
        ("a/pom.xml", "<project><dependencies>", "no whole project element"), ("b/pom.xml", pom(), None), ("a/go.mod", "require (\n x.org/a v1\n", "open require block"),
        ("b/go.mod", "require (\n x.org/a v1\n)\n", None), ("a/Cargo.toml", "[dependencies\na = '1'\n", "open section header"), ("b/Cargo.toml", "[dependencies]\n", None),
        ("requirements.txt", "x", None), ("go.mod.txt", "require (", None),
    ]
    got = {r.path: r.reason for r in deps.manifest_rejects(files(spark, *[(p, "x", t) for p, t, _ in rows])).collect()}
    assert got == {p: r for p, _, r in rows if r}


def test_truncate_bytes(spark):
    from siftmark.functions.text import truncate_bytes

    texts = ["", "abc", "é" * 10, "中文字符" * 3, "a\U0001f600b\U0001f600", "xxxxxxxxxxxxxxx", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for n in (1, 2, 3, 4, 5, 8, 15, 100):
        want = [t if t is None or len(t.encode()) <= n else t.encode()[:n - 1].decode("utf-8", "ignore") + "…" for t in texts]
        assert [r[0] for r in df.select(truncate_bytes(F.col("t"), n)).collect()] == want
    with pytest.raises(ValueError):
        truncate_bytes(F.col("t"), 0)


def test_scans_side_by_side(spark, tmp_path, capsys):
    from datetime import date

    from siftmark.plans.scan_job import append_scan, read_scans

    df = files(spark, ("a", "x", "bad\nbad"), ("b", "x", "bad"))
    rules, opts, out = R.check_rules(spark, [rule("bad")]), scan.ScanOptions(secrets=False, deps=False), str(tmp_path)
    append_scan(spark, df, rules, out, date(2024, 1, 1), "one", opts)
    append_scan(spark, df.where("path = 'a'"), rules, out, date(2024, 1, 2), "one", opts)
    append_scan(spark, df, rules, out, date(2024, 1, 2), "two", opts)
    append_scan(spark, df.where("path = 'none'"), rules, out, date(2024, 1, 1), "one", opts)  # runs again and finds nothing
    counts = read_scans(spark, out, "findings").groupBy("day", "scan_id").count().collect()
    assert {(str(r.day), r.scan_id): r["count"] for r in counts} == {("2024-01-02", "one"): 2, ("2024-01-02", "two"): 3}
    one = read_scans(spark, out, "findings").where("day = DATE '2024-01-02' AND scan_id = 'two'")
    one.explain("formatted")
    plan = capsys.readouterr().out
    assert "PartitionFilters: [isnotnull(day" in plan
    assert all("/day=2024-01-02/scan_id=two/" in r[0] for r in one.select(F.input_file_name()).collect())
    assert read_scans(spark, out, "summary").where("scan_id = 'two'").first().total_findings == 3
    with pytest.raises(ValueError):
        append_scan(spark, df, rules, out, date(2024, 1, 1), "a/b", opts)


def test_candidates_find_what_all_files_find(spark, tmp_path):
    from siftmark.plans import trigrams

    rows = [("a", "x", "the Secret = 'x'"), ("b", "x", "nothing"), ("c", "x", "SECRET"), ("d", "x", "sec ret cret ecr"), ("h", "x", "sec ret"), ("e", "x", ""), ("f", "y", "a password here"), ("g", "x", "é password é")]
    df = files(spark, *rows)
    rules = R.check_rules(spark, [rule("(?i)secret", rule_id="R-1"), rule("password", rule_id="R-2"), rule("[0-9]", rule_id="R-3"), rule("x", negate=True, rule_id="R-4")])
    trigrams.build_trigrams(df, str(tmp_path), "v1")
    named, rest = trigrams.candidates(spark, rules, str(tmp_path), "v1")
    assert [r.rule_id for r in rest] == ["R-3", "R-4"]
    assert {(r.path, r.rule_id) for r in named.collect()} == {("a", "R-1"), ("c", "R-1"), ("d", "R-1"), ("f", "R-2"), ("g", "R-2")}
    asked = []
    read = lambda names: (asked.append({r.path for r in names.collect()}), df.join(names, ["job_id", "path"], "left_semi"))[1]
    opts = scan.ScanOptions(secrets=False, deps=False)
    got = trigrams.scan_candidates(spark, read, rules, str(tmp_path), "v1", opts)
    want = scan.scan_files(df, rules, opts).where("rule_id IN ('R-1', 'R-2')")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and asked == [{"a", "c", "d", "f", "g"}]
    with pytest.raises(ValueError):
        trigrams.candidates(spark, rules, str(tmp_path), "v2")


def test_trigrams_are_stored_by_block(spark, tmp_path):
    """One row per block and trigram says which files hold it, however many they are."""
    from siftmark.plans import trigrams

    rng = random.Random(5)
    texts = ["".join(rng.choice("abC é\n~") for _ in range(rng.randrange(40))) for _ in range(300)] + [None, "", "ab", "ABC"]
    names = [("j" if i % 2 else None, f"f{i}") for i in range(len(texts))]
    files = spark.createDataFrame([(j, p, "x", t) for (j, p), t in zip(names, texts)], schemas.FILES).coalesce(1)
    trigrams.build_trigrams(files, str(tmp_path), "v1")
    stored = spark.read.parquet(f"{tmp_path}/version=v1")
    rows, want = stored.where("gram is not null").collect(), set()
    for name, text in zip(names, texts):
        low = (text or "").lower()
        want |= {(low[i:i + 3], *name) for i in range(len(low) - 2) if all(" " <= c <= "~" for c in low[i:i + 3])}
    who = {(r.block, r.members[0]): (r.job_id, r.path) for r in stored.where("gram is null").collect()}
    assert sorted(who.values(), key=str) == sorted(names, key=str)
    assert {(r.gram, *who[r.block, m]) for r in rows for m in r.members} == want
    assert len(rows) == len({g for g, _, _ in want}) and sum(len(r.members) for r in rows) == len(want)


def test_line_tests_of_rules_with_a_literal(spark):
    """The literal is looked for before the expression; letters that fold to i for the engine do not hide a hit."""
    rules = R.check_rules(spark, [
        R.Rule("A", R.Pattern("regex", r"(?i)\bvie de\b"), languages=("*",), enabled=True),
        R.Rule("B", R.Pattern("regex", "de|xx"), languages=("*",), enabled=True),
        R.Rule("C", R.Pattern("regex", r"[a-z]+@b"), languages=("*",), enabled=True),
        R.Rule("D", R.Pattern("regex", "(?i)mit", negate=True), languages=("*",), enabled=True),
    ])
    text = "vie de\nvİe de\nVıE DE\nla vied e\nxx aa@b\n"
    files = spark.createDataFrame([("j", "a", "x", text), ("j", "b", "x", "mıt"), ("j", "c", "x", "MiT\n")], schemas.FILES)
    got = sorted((r.file, r.rule_id, r.line, r.column) for r in scan.scan_files(files, rules).collect())
    assert got == [("a", "A", 1, 1), ("a", "A", 2, 1), ("a", "A", 3, 1), ("a", "B", 1, 5), ("a", "B", 2, 6), ("a", "B", 5, 1), ("a", "C", 5, 4), ("a", "D", 1, 1)]
    assert translate("[a-z]+@b").search == "(?dm)[a-z]@b" and translate("[a-z]+?@").search == "(?dm)[a-z]+?@"


def test_numbering_scans_once(spark):
    """Dealing findings by ranges of their order does not compute them a second time."""
    files = spark.createDataFrame([("j", f"f{i}", "x", "abc\nabc\n") for i in range(50)], schemas.FILES).repartition(4, "path")
    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    rules = R.check_rules(spark, [R.Rule("A", R.Pattern("regex", "b"), languages=("*",), enabled=True)])
    numbered = rollup.number_findings(scan.scan_files(files.mapInArrow(seen, files.schema), rules)).collect()
    assert sorted(r.number for r in numbered) == list(range(1, 101)) and read.value == 50


def test_package_json_is_parsed_once(spark):
    files = spark.createDataFrame([("j", "package.json", "x", '{"dependencies":{"a":"1"},"peerDependencies":{"b":"*"}}')], schemas.FILES)
    found = deps.declared_dependencies(files)
    assert [(r.name, r.version) for r in found.collect()] == [("a", "1"), ("b", "")]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("from_json") == 1
