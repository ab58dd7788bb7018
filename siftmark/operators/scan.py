"""The scan: rules, required patterns, secrets and dependencies in one pass over the files.

File level: every rule is tried once on the whole text (a plain substring test
first, where the pattern has one), which leaves the few rules that can hit some line.
Required patterns and manifests are decided on the whole text in the same projection.
Only texts with such rules are split into lines, once. The remaining rules travel as an
array of numbers beside the lines, and each is tried on all lines in turn; patterns are
data there, so the plan does not grow with the pack beyond the file level. Rows are made
for hits only. No shuffle, one read of the input.

Texts above `long_text` bytes may go a way of their own: they are cut into ranges of lines,
each with the number of lines before it, and the ranges are dealt over all tasks. They are
picked by a second read of the input. `run_scan` lists them in its one pass, as rows of a phase
of their own, and reads only those again; a scan that is not stored is asked for it (`dealt`).
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from siftmark.functions import entropy, text
from siftmark.operators import deps as manifests
from siftmark.sources.rules import Rule

PHASE_RULES, PHASE_SECRETS, PHASE_DEPS, PHASE_LISTED = 0, 1, 2, -1
IN_PLACE, DEALT, LISTED = "in place", "dealt", "listed"
# Fixed values of the finding for a secret.
SECRET = {
    "rule_id": "ENT-001", "name": "High-entropy string (possible secret)", "category": "security",
    "severity": "high", "fix": "Move to an environment variable or secrets manager.",
}
_SECRET_SEARCH = r"""[:=][\t\n\f\r ]*["'][^"'\t\n\f\r ]{12,}["']"""
_ITEM = {"rule": "int", "whole": "boolean", "idx": "int", "detail": "string", "line": "int", "place": "int", "text": "string"}
_ROW = f"struct<{','.join(f'{name}:{kind}' for name, kind in _ITEM.items())}>"
_ITEMS = f"array<{_ROW}>"
_INTS = "array<int>"
_PIECES = "array<struct<before:int,body:string>>"
_META = ["rule_id", "name", "category", "severity", "message", "fix"]


@dataclass(frozen=True)
class ScanOptions:
    """What a scan does; each part can be switched off."""

    rules: bool = True
    secrets: bool = True
    deps: bool = True
    entropy_threshold: float = entropy.DEFAULT_THRESHOLD
    marker: str = text.DEFAULT_MARKER
    strict_deps: bool = False
    max_findings: int = 0
    fail_on: str = "high"
    exclude: tuple[str, ...] = field(default=())
    spread: bool = False  # the files come straight from storage, maybe in few large splits
    long_text: int = 32 << 20  # texts of more bytes are long
    long_texts: str = IN_PLACE  # scanned by the task that reads them, or DEALT in ranges of lines, or only LISTED
    range_lines: int = 20_000  # lines of a range

    @property
    def threshold(self) -> float:
        return self.entropy_threshold if self.entropy_threshold > 0 else entropy.DEFAULT_THRESHOLD


def applies_to(rule: Rule, lowered_language: Column) -> Column | None:
    """The rule's languages hold `*` (None: no test) or the file's language in any case; an
    empty list fits nothing."""
    if "*" in rule.languages:
        return None
    return lowered_language.isin(sorted({l.lower() for l in rule.languages}))


def _any(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests) if tests else F.lit(False)


def _all(*tests: Column | None) -> Column:
    return reduce(lambda a, b: a & b, [t for t in tests if t is not None])


def _may_hit(rule: Rule, body: Column, lowered: Column) -> Column | None:
    """No false negatives; the substring tests spare most texts the regex. None: any text may hit."""
    pattern = rule.translated
    if pattern is None:
        return rule.kind.file(rule.pattern, body) if rule.kind.file else None
    literals = [(lowered if fold else body).contains(text) for text, fold in pattern.literals]
    return _all(_any(literals) if literals else None, body.rlike(pattern.search))


def _folded(text: Column, lowered: Column, literal: Column | str) -> Column:
    """The text holds the literal in any case, as the regex engine sees it: it also takes two Turkish letters for i."""
    return lowered.contains(literal) | text.contains("\u0130") | text.contains("\u0131")


def _never_hits(rule: Rule, content: Column, body: Column) -> Column:
    """No place of a text fits the rule's pattern."""
    if rule.translated is not None:
        lowered = F.lower(content)
        literals = [_folded(content, lowered, text) if fold else content.contains(text) for text, fold in rule.translated.literals]
        return ~_all(_any(literals) if literals else None, content.rlike(rule.translated.line))
    test = lambda line: rule.kind.line(rule.pattern, line)
    return F.when(content == "", True).otherwise(~F.exists(text.split_lines(body), test))


def _numbers(tests: list[Column], numbers: list[int]) -> Column:
    """The numbers of the tests that hold, as array<int>."""
    if not tests:
        return F.array().cast(_INTS)
    order = F.from_json(F.lit(json.dumps(numbers)), _INTS)
    return F.array_compact(F.transform(F.array(*tests), lambda t, i: F.when(t, F.get(order, i))))


def _item(rule: Column, whole: bool, **fields: Column) -> Column:
    """One hit; what is not given is null."""
    given = {"rule": rule, "whole": F.lit(whole), "idx": F.lit(0), **fields}
    return F.struct(*[given.get(name, F.lit(None)).alias(name) for name in _ITEM]).cast(_ROW)


def _constants(rows: list[dict], fields: list[str], number: Column) -> Column:
    """The row with that number out of a table of texts, kept as one constant in the plan."""
    schema = ",".join(f"{f}:string" for f in fields)
    return F.get(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>"), number)


def _pattern_rows(rules: list[Rule]) -> list[dict]:
    rows = [{"first": r.translated.first, "line": r.translated.line, **_only_literal(r)} if r.translated else {} for r in rules]
    return [*rows, {"line": entropy.ASSIGNMENT}]


def _only_literal(rule: Rule) -> dict:
    """The literal that every hit of a rule contains, if there is just one, under the name of the test that it needs."""
    literals = rule.translated.literals
    return {"folded" if literals[0][1] else "plain": literals[0][0]} if len(literals) == 1 else {}


def _whole_items(content: Column, body: Column, lang: Column, off: Column, rules: list[Rule], opts: ScanOptions) -> Column:
    """Hits of whole texts: required patterns that are missing, dependencies without a version."""
    none, items = F.array().cast(_ITEMS), []
    required = [(i, r) for i, r in enumerate(rules) if r.active and r.languages and r.pattern.negate] if opts.rules else []
    if required:
        tests = [_all(applies_to(r, lang), _never_hits(r, content, body)) for _, r in required]
        missing = F.when(~off, _numbers(tests, [i for i, _ in required])).otherwise(F.array().cast(_INTS))
        items.append(F.transform(missing, lambda i: _item(i, True)))
    if opts.deps:
        found = manifests.manifest_deps(F.col("path"), content, opts.strict_deps)
        unpinned = F.transform(
            F.filter(found, lambda d: d["version"] == ""),
            lambda d, i: _item(F.lit(len(rules) + 1), True, idx=i, detail=d["name"]),
        )
        items.append(F.when(manifests.is_manifest(F.col("path")), F.coalesce(unpinned, none)).otherwise(none))
    return F.concat(*items) if items else none


def _texts(files: DataFrame, rules: list[Rule], opts: ScanOptions) -> DataFrame:
    """(job_id, path, lang, off, full, before, body, whole): the texts, long ones as several ranges of lines.

    `full` says that the text is not empty. Hits of the whole text go with its first range.
    """
    content, body, off = F.col("content"), F.col("body"), F.col("off")
    prepared = files.select("job_id", "path", F.lower("language").alias("lang"), "content", text.line_body(content).alias("body"))
    texts = prepared.select("*", text.file_suppressed(body, opts.marker).alias("off"))
    head = ["job_id", "path", "lang", "off", (content != "").alias("full")]
    whole = _whole_items(content, body, F.col("lang"), off, rules, opts).alias("whole")
    size = F.coalesce(F.octet_length(content), F.lit(0))
    if opts.long_texts == IN_PLACE:
        return texts.select(*head, F.lit(0).alias("before"), "body", whole)
    if opts.long_texts == LISTED:
        listed = F.array(_item(F.lit(len(rules) + 2), True))
        some = F.when(size > opts.long_text, listed).otherwise(whole).alias("whole")
        return texts.select("job_id", "path", "lang", "off", ((content != "") & (size <= opts.long_text)).alias("full"), F.lit(0).alias("before"), "body", some)
    short = texts.where(size <= opts.long_text).select(*head, F.lit(0).alias("before"), "body", whole)
    long = texts.where(size > opts.long_text)
    joined = lambda lines: F.concat(F.array_join(lines, "\n"), F.lit("\n"))
    pieces = text.let(text.split_lines(body), lambda lines: F.transform(
        F.sequence(F.lit(0), F.size(lines) - 1, F.lit(opts.range_lines)),
        lambda k: F.struct(k.alias("before"), joined(F.slice(lines, k + 1, opts.range_lines)).alias("body")),
    ))
    cut = long.select(*head, whole, F.inline(pieces.cast(_PIECES)))
    first = F.when(F.col("before") == 0, F.col("whole")).otherwise(F.array().cast(_ITEMS))
    cut = cut.select("job_id", "path", "lang", "off", "full", "before", "body", first.alias("whole"))
    tasks = max(files.sparkSession.sparkContext.defaultParallelism, int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return short.unionByName(cut.repartition(tasks, "job_id", "path", "before"))


def _hits(files: DataFrame, rules: list[Rule], opts: ScanOptions) -> DataFrame:
    """(job_id, path, rule, whole, idx, detail, line, place, text): one row per hit.

    `rule` is the position in the pack; the two numbers behind stand for secrets and
    dependencies. A hit of a whole text has no line text.
    """
    active = [(i, r) for i, r in enumerate(rules) if r.active and r.languages] if opts.rules else []
    by_line = [(i, r) for i, r in active if not r.pattern.negate]
    body, before, lang, none = F.col("body"), F.col("before"), F.col("lang"), F.array().cast(_ITEMS)
    texts = _texts(files, rules, opts).withColumn("lowered", F.lower("body"))

    likely = F.array().cast(_INTS)
    if by_line:
        tests = [_all(F.lit(True), applies_to(r, lang), _may_hit(r, body, F.col("lowered"))) for _, r in by_line]
        likely = F.when(~F.col("off") & F.col("full"), _numbers(tests, [i for i, _ in by_line])).otherwise(likely)
    if opts.secrets:
        own = F.when(body.rlike(_SECRET_SEARCH) & F.col("full"), F.array(F.lit(len(rules)))).otherwise(F.array().cast(_INTS))
        likely = F.concat(likely, own)
    tried = texts.select("job_id", "path", "before", "body", "whole", likely.alias("likely"))

    custom = [(i, r) for i, r in by_line if r.translated is None]
    patterns = _pattern_rows(rules)

    def hits_of(lines: Column) -> Column:
        def by_regex(i: Column) -> Column:
            def fits(p):
                # A test by place compiles a pattern once for all lines of a text.
                first = lambda l: p["first"].isNull() | (F.regexp_instr(l["text"], p["first"]) > 0)
                holds = lambda l: F.when(p["plain"].isNotNull(), l["text"].contains(p["plain"])).when(
                    p["folded"].isNotNull(), _folded(l["text"], F.lower(l["text"]), p["folded"])).otherwise(True)
                return F.filter(lines, lambda l: holds(l) & first(l) & (F.regexp_instr(l["text"], p["line"]) > 0))

            found = text.let(_constants(patterns, ["first", "line", "plain", "folded"], i), fits)
            return F.transform(found, lambda l: _item(i, False, line=l["line"], text=l["text"]))

        regexes = F.array_except("likely", F.array(*[F.lit(i) for i, _ in custom])) if custom else F.col("likely")
        parts = [F.flatten(F.transform(regexes, by_regex))]
        for i, r in custom:
            place = r.kind.place or (lambda pattern, line: F.lit(1))
            found = F.filter(lines, lambda l: r.kind.line(r.pattern, l["text"]))
            rows = F.transform(found, lambda l: _item(F.lit(i), False, line=l["line"], text=l["text"], place=place(r.pattern, l["text"])))
            parts.append(F.when(F.array_contains("likely", i), rows).otherwise(none))
        return F.concat(*parts)

    lines = F.transform(text.split_lines(body), lambda t, k: F.struct((before + k + 1).alias("line"), t.alias("text")))
    in_lines = F.when(F.size("likely") > 0, text.let(lines, hits_of)).otherwise(none)
    # The outer form keeps Catalyst from deriving a filter that would evaluate the tests twice.
    rows = tried.select("job_id", "path", F.explode_outer(F.concat("whole", in_lines)).alias("item")).where(F.col("item").isNotNull())
    return rows.select("job_id", "path", "item.*")


def scan_files(files: DataFrame, rules: list[Rule], opts: ScanOptions = ScanOptions()) -> DataFrame:
    """All findings of the files, as one row each (`siftmark.schemas.FINDINGS`)."""
    meta_rows = [dict(zip(_META, (r.rule_id, r.name, r.category, r.severity, r.message, r.fix))) for r in rules]
    meta_rows += [{k: SECRET.get(k, "") for k in _META}, {k: manifests.UNPINNED[k] for k in _META}, {k: "" for k in _META}]
    rule, detail, line = F.col("rule"), F.col("detail"), F.col("text")
    is_secret, is_dep = rule == len(rules), rule == len(rules) + 1
    on_line = ~F.col("whole") & ~is_secret

    hits = _hits(files, rules, opts).withColumn("meta", _constants(meta_rows, _META, rule))
    hits = hits.withColumn("line", F.coalesce("line", F.lit(1))).withColumn("text", F.coalesce("text", F.lit("")))
    regex = _constants(_pattern_rows(rules), ["first", "line"], rule)["line"]
    if opts.rules:
        quiet = text.line_suppressed(line, F.col("meta.rule_id"), opts.marker)
        hits = hits.where(~(on_line & line.contains(opts.marker) & quiet))
    secret_text = F.lit("")
    if opts.secrets:
        values = F.posexplode_outer(F.when(is_secret, entropy.secret_values(line))).alias("nth", "value")
        hits = hits.select("*", values).where(~is_secret | F.col("value").isNotNull())
        hits = hits.withColumn("bits", F.when(is_secret, entropy.shannon(F.col("value"))))
        hits = hits.where(~is_secret | (F.col("bits") >= opts.threshold))
        hits = hits.withColumn("idx", F.coalesce("nth", "idx"))
        secret_text = F.concat(
            F.lit("High-entropy string detected (entropy="), entropy.entropy_text(F.col("bits")),
            F.lit("). Possible hardcoded secret: "), entropy.redact(F.col("value")),
        )
    message = F.col("meta.message")
    return hits.select(
        "job_id", F.col("meta.rule_id").alias("rule_id"), F.col("meta.name").alias("rule_name"),
        F.col("meta.category").alias("category"), F.col("meta.severity").alias("severity"),
        F.col("path").alias("file"), "line",
        F.when(on_line, F.coalesce("place", text.byte_column(line, regex))).otherwise(1).alias("column"),
        F.when(is_secret, secret_text).when(is_dep, F.concat(message, detail)).otherwise(message).alias("message"),
        F.when(F.col("whole"), "").otherwise(text.trim_unicode(line)).alias("snippet"),
        F.col("meta.fix").alias("fix_suggestion"),
        F.when(is_secret, PHASE_SECRETS).when(is_dep, PHASE_DEPS).when(rule > len(rules), PHASE_LISTED).otherwise(PHASE_RULES).alias("phase"),
        F.when(is_secret | is_dep, 0).otherwise(rule).alias("rule_seq"), F.col("idx").alias("match_idx"),
    )


def explode_lines(files: DataFrame) -> DataFrame:
    """lines(job_id, path, language, line, text), numbered from 1."""
    lines = F.when(F.col("content") != "", text.split_lines(text.line_body(F.col("content"))))
    out = files.select("job_id", "path", "language", F.posexplode(lines).alias("pos", "text"))
    return out.select("job_id", "path", "language", (F.col("pos") + 1).alias("line"), "text")


def drop_suppressed_files(files: DataFrame, marker: str = text.DEFAULT_MARKER) -> DataFrame:
    """Files without the whole-file marker in their first ten lines."""
    return files.where(~text.file_suppressed(text.line_body(F.col("content")), marker))


def drop_comment_lines(lines: DataFrame) -> DataFrame:
    return lines.where(~entropy.is_comment(F.col("text")))


def rules_for(files: DataFrame, rules: list[Rule]) -> DataFrame:
    """(job_id, path, language, rule_id): the enabled rules that look at each file.

    Told from the rule pack's language lists, without a join.
    """
    lang = F.lower("language")
    fits = [(r.rule_id, applies_to(r, lang)) for r in rules if r.enabled and r.languages]
    ids = F.array_compact(F.array(*[F.lit(i) if t is None else F.when(t, F.lit(i)) for i, t in fits]))
    return files.select("job_id", "path", "language", F.explode(ids).alias("rule_id"))


def scan_regex(files: DataFrame, rules: list[Rule], marker: str = text.DEFAULT_MARKER) -> DataFrame:
    """At most one finding per rule and line."""
    keep = [r if not r.pattern.negate else _off(r) for r in rules]
    return scan_files(files, keep, ScanOptions(secrets=False, deps=False, marker=marker))


def scan_required(files: DataFrame, rules: list[Rule], marker: str = text.DEFAULT_MARKER) -> DataFrame:
    """One finding per file in which a required pattern occurs nowhere."""
    keep = [r if r.pattern.negate else _off(r) for r in rules]
    return scan_files(files, keep, ScanOptions(secrets=False, deps=False, marker=marker))


def scan_secrets(files: DataFrame, threshold: float = entropy.DEFAULT_THRESHOLD) -> DataFrame:
    """Quoted, assigned values whose entropy reaches the threshold."""
    return scan_files(files, [], ScanOptions(rules=False, deps=False, entropy_threshold=threshold))


def _off(rule: Rule) -> Rule:
    return replace(rule, enabled=False)


def finding_order(path: str = "file") -> list[Column]:
    """Finding order inside a job: phase, directory walk, rule, line, match."""
    return [F.col("phase"), text.path_order(F.col(path)), F.col("rule_seq"), F.col("line"), F.col("match_idx")]
