import random
import re
import string

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from siftmark import schemas
from siftmark.operators import scan
from siftmark.sources import rules as R

SF = "/root/testdata/sf0.001"


def test_keys():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert all(re.match(r"op\d+_|pipeline$", n) for n in set(entry.queries()) - set(entry.oracle_sql()))


@pytest.mark.parametrize("name", ["scan_corpus_summary", "scan_pages", "policy_documents", "audit_lifted", "queue_depth", "reuse_results"])
def test_equal_to_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    from check_oracle import TABLES, canon

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = canon(entry.queries()[name](spark, SF).toPandas()), canon(con.sql(entry.oracle_sql()[name]).df())
    assert list(got.columns) == list(want.columns) and got.equals(want)


def test_scan_against_plain_python(spark):
    """Random texts and simple patterns, line by line with Python's own regex engine."""
    rng = random.Random(11)
    patterns = [r"\bab", r"a+b$", r"(?i)xy", r"^c", r"[bc]{2}", r"a.c", r"\w\s\w", r"b|cc"]
    rules = R.check_rules(spark, [R.Rule(f"R-{i}", R.Pattern("regex", p), languages=("*",), enabled=True) for i, p in enumerate(patterns)])
    texts = ["".join(rng.choice("aabbccxXyY  \n\n\r-") for _ in range(rng.randrange(0, 200))) for _ in range(120)]
    want = set()
    for k, t in enumerate(texts):
        lines = t.split("\n")
        for n, line in enumerate(lines[:-1] if lines[-1] == "" else lines, 1):
            line = line[:-1] if line.endswith("\r") else line
            for i, p in enumerate(patterns):
                m = re.search(p.replace("$", r"\Z").replace(".", r"[^\n]"), line, re.ASCII)
                if m:
                    want.add((f"f{k}", n, m.start() + 1, f"R-{i}", line.strip(string.whitespace)))
    files = spark.createDataFrame([("j", f"f{k}", "x", t) for k, t in enumerate(texts)], schemas.FILES)
    got = scan.scan_files(files, rules).collect()
    assert {(r.file, r.line, r.column, r.rule_id, r.snippet) for r in got} == want and len(got) == len(want) > 500
