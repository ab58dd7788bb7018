"""Rule packs: YAML documents to a checked, ordered list of rules."""

from __future__ import annotations

import os
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F

from siftmark import schemas
from siftmark.functions.dialect import PatternError, Translated
from siftmark.sources.pattern_types import Pattern, PatternType, kind_of

PACKS = os.path.join(os.path.dirname(os.path.dirname(__file__)), "packs")
_MAX_PACK_BYTES = 64 << 20


class RulePackError(ValueError):
    """A pack that must not be used: unreadable, ambiguous or with a bad pattern."""


@dataclass(frozen=True)
class RuleTests:
    passing: tuple[str, ...] = ()
    failing: tuple[str, ...] = ()


@dataclass(frozen=True)
class Rule:
    rule_id: str
    pattern: Pattern
    name: str = ""
    description: str = ""
    category: str = ""
    severity: str = ""
    languages: tuple[str, ...] = ()
    message: str = ""
    fix: str = ""
    enabled: bool = False
    tests: RuleTests = field(default_factory=RuleTests)

    @property
    def kind(self) -> PatternType | None:
        return kind_of(self.pattern)

    @property
    def supported(self) -> bool:
        """Unknown pattern types may stand in a pack; they yield no findings."""
        return self.kind is not None

    @property
    def active(self) -> bool:
        return self.enabled and self.supported

    @property
    def translated(self) -> Translated | None:
        """The regular expression of the rule; None for kinds that test in columns of their own."""
        kind = self.kind
        return kind.translate(self.pattern) if kind is not None and kind.translate else None


def rule_from_mapping(doc: dict) -> Rule:
    pattern, tests = doc.get("pattern") or {}, doc.get("tests") or {}
    text = {k: str(doc.get(k) or "") for k in ("name", "description", "category", "severity", "message")}
    return Rule(
        rule_id=str(doc.get("id") or ""),
        pattern=Pattern(
            str(pattern.get("type") or ""), str(pattern.get("match") or ""),
            int(pattern.get("max") or 0), bool(pattern.get("negate", False)),
        ),
        languages=tuple(str(l) for l in doc.get("languages") or ()),
        fix=str(doc.get("fix") or doc.get("fix_suggestion") or ""),
        enabled=bool(doc.get("enabled", False)),
        tests=RuleTests(tuple(tests.get("pass") or ()), tuple(tests.get("fail") or ())),
        **text,
    )


def _check_size(size: int, directory: str) -> None:
    if size > _MAX_PACK_BYTES:
        raise RulePackError(f"rule pack of {size} bytes in {directory}")


def _documents(spark: SparkSession, directory: str) -> list[tuple[str, str]]:
    """(file name, text) of every *.yaml directly in the directory, by name."""
    if "://" not in directory:
        names = sorted(n for n in os.listdir(directory) if n.endswith(".yaml"))
        paths = [(n, os.path.join(directory, n)) for n in names]
        paths = [(name, path) for name, path in paths if os.path.isfile(path)]
        _check_size(sum(os.path.getsize(path) for _, path in paths), directory)
        texts = []
        for name, path in paths:
            with open(path, encoding="utf-8") as f:
                texts.append((name, f.read()))
        return texts
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.yaml").load(directory)
    size = found.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    _check_size(size, directory)
    rows = found.select("path", "content").collect()
    return sorted((r.path.rsplit("/", 1)[1], bytes(r.content).decode("utf-8")) for r in rows)


def check_rules(spark: SparkSession, rules: list[Rule]) -> list[Rule]:
    """Refuse double ids and patterns that do not compile, also of disabled rules."""
    seen: set[str] = set()
    for rule in rules:
        if rule.rule_id in seen:
            raise RulePackError(f"rule id {rule.rule_id!r} is used twice")
        seen.add(rule.rule_id)
        try:
            rule.translated
            if rule.supported and rule.kind.check:
                rule.kind.check(rule.pattern)
        except (PatternError, ValueError) as e:
            raise RulePackError(f"rule {rule.rule_id}: {e}") from e
    _compile_all(spark, tuple((r.rule_id, r.translated) for r in rules if r.translated))
    return rules


_compiled: set[Translated] = set()


def _compile_all(spark: SparkSession, items: tuple[tuple[str, Translated], ...]) -> None:
    """Let the engine compile the patterns on an empty text, once per process."""
    todo = [(i, t) for i, t in items if t not in _compiled]
    if not todo:
        return

    def probe(part):
        spark.sql("SELECT '' AS t").select(
            *[F.col("t").rlike(x) for _, t in part for x in (t.line, t.search)]
        ).collect()

    try:
        probe(todo)
    except Exception as first:
        for item in todo:
            try:
                probe([item])
            except Exception as e:
                raise RulePackError(f"rule {item[0]}: pattern does not compile: {item[1].line}") from e
        raise first
    _compiled.update(t for _, t in todo)


def load_rules(spark: SparkSession, directory: str) -> list[Rule]:
    """All rules of a directory, in file name order and then by position."""
    try:
        import yaml
    except ImportError as e:  # pragma: no cover
        raise RulePackError("reading YAML rule packs needs the yaml module") from e
    rules = []
    for name, text in _documents(spark, directory):
        try:
            doc = yaml.safe_load(text) or {}
            rules += [rule_from_mapping(r) for r in doc.get("rules") or ()]
        except (yaml.YAMLError, AttributeError, TypeError, ValueError) as e:
            raise RulePackError(f"cannot parse rule file {name}: {e}") from e
    return check_rules(spark, rules)


def rules_frame(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    """The pack as a relation, for listing and for joins on rule_id."""
    rows = []
    for seq, r in enumerate(rules):
        p = asdict(r.pattern)
        rows.append((
            seq, r.rule_id, r.name, r.description, r.category, r.severity, list(r.languages),
            (p["type"], p["match"], p["max"], p["negate"]), r.message, r.fix, r.enabled,
            (list(r.tests.passing), list(r.tests.failing)), r.supported,
        ))
    return spark.createDataFrame(rows, schemas.RULES)


def read_rule_pack(spark: SparkSession, directory: str) -> DataFrame:
    return rules_frame(spark, load_rules(spark, directory))


def rules_from_frame(rules: DataFrame) -> list[Rule]:
    """Back from a relation (for packs kept in a table). Rules are a bounded dimension."""
    out = []
    for r in rules.orderBy("rule_seq").toLocalIterator():
        if len(out) >= 100_000:
            raise RulePackError("more than 100000 rules")
        p, t = r["pattern"], r["tests"]
        out.append(Rule(
            r["rule_id"], Pattern(p["type"], p["match"], p["max"], p["negate"]), r["name"], r["description"],
            r["category"], r["severity"], tuple(r["languages"] or ()), r["message"], r["fix"], r["enabled"],
            RuleTests(tuple(t["pass"] or ()), tuple(t["fail"] or ())) if t else RuleTests(),
        ))
    return out
