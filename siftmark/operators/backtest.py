"""Rules against labelled examples: does each fire where it should and only there?"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from siftmark.functions import text
from siftmark.sources.rules import Rule


def inline_examples(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    """The packs' own fixtures as examples(rule_id, expected_fire, snippet)."""
    rows = [(r.rule_id, fire, s) for r in rules for fire, ss in ((False, r.tests.passing), (True, r.tests.failing)) for s in ss]
    return spark.createDataFrame(rows, "rule_id string, expected_fire boolean, snippet string")


def _as_rows(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    rows = [
        (r.rule_id, r.supported, r.pattern.negate, r.translated.line if r.translated else None, r.translated.search if r.translated else None)
        for r in rules
    ]
    return spark.createDataFrame(rows, "rule_id string, supported boolean, negate boolean, line string, search string")


def judge_examples(examples: DataFrame, rules: list[Rule], marker: str = text.DEFAULT_MARKER) -> DataFrame:
    """Examples with `fired` and `ok`; an example of an unknown rule has null for both.

    Enabled, language and file suppression do not matter here, line suppression does. The rules
    are rows, so the plan grows only with rules of kinds that test in columns of their own.
    """
    known = _as_rows(examples.sparkSession, rules).withColumnRenamed("rule_id", "_rule")
    rows = examples.join(known, F.col("rule_id") == F.col("_rule"), "left")
    snippet, body = F.col("snippet"), text.line_body(F.col("snippet"))
    loud = lambda l: ~text.line_suppressed(l, F.col("rule_id"), marker)
    hit = lambda l: (F.regexp_instr(l, F.col("line")) > 0) & loud(l)
    lines = F.when(F.length(snippet) > 0, text.split_lines(body)).otherwise(F.array().cast("array<string>"))
    fired = F.when(~F.col("supported"), False)
    for rule in rules:
        if rule.supported and rule.translated is None:
            test = lambda l: rule.kind.line(rule.pattern, l)
            own = ~F.exists(lines, test) if rule.pattern.negate else F.exists(lines, lambda l: test(l) & loud(l))
            fired = fired.when(F.col("rule_id") == rule.rule_id, own)
    fired = fired.when(F.col("negate"), ~F.rlike(snippet, F.col("line"))).when(
        F.col("supported"), F.rlike(body, F.col("search")) & F.exists(lines, hit)
    )
    judged = rows.withColumn("fired", fired).select(*examples.columns, "fired")
    return judged.withColumn("ok", F.col("fired") == F.col("expected_fire"))


def backtest_rules(
    examples: DataFrame, rules: list[Rule], marker: str = text.DEFAULT_MARKER,
) -> tuple[DataFrame, DataFrame]:
    """(report per rule, failing examples)."""
    judged = judge_examples(examples, rules, marker)
    report = judged.groupBy("rule_id").agg(
        F.count(F.lit(1)).alias("total"), F.count_if("ok").alias("passed"),
        F.count_if(~F.coalesce("ok", F.lit(False))).alias("failed"),
    )
    return report, judged.where(~F.coalesce("ok", F.lit(False)))
