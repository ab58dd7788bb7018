"""Operators that look at one document at a time: quality rules, languages, toxicity, licences."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from siftmark.llm import language_id, license_scan, quality_rules, toxicity
from siftmark.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_measures(text):
    text = text or ""
    ws = WORD.findall(text)
    windows = list(zip(ws, ws[1:], ws[2:]))
    twice = {w for w, n in Counter(windows).items() if n > 1}
    covered = {i + k for i, w in enumerate(windows) if w in twice for k in range(3)}
    lines = [l for l in text.split("\n") if WORD.search(l)]
    failed = len(ws) < 50 or 100 * len(covered) > 50 * len(ws)
    return (len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), failed)


def test_base_measures(spark, edge_docs):
    got = quality_rules.clean_lines(edge_docs).collect()
    assert len(got) == edge_docs.count()
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute_measures(r.text), r.doc_id
        assert not (r.kept and r.base_failed)
    assert quality_rules.clean_lines(edge_docs.limit(0)).collect() == []


@pytest.mark.parametrize("line, good", [
    ("This is a sentence that ends well.", True), ('He said "so it is."', True), ("no mark at the end", False),
    ("Home | About | News | Contact.", False), ("We use cookies to make this site better.", False),
    ("Back to top", False), ("BUY!! NOW!! CHEAP!!", False), ("Really!! That is all.", True), ("Wirklich…", True),
])
def test_line_rules(spark, line, good):
    body = "\n".join([line, "x"])
    row = quality_rules.clean_lines(spark.createDataFrame([(1, body)], "doc_id long, text string")).collect()[0]
    assert (line in row.clean_text.split("\n")) == good


def test_documents_losing_too_much_go(spark):
    prose = "\n".join(" ".join(f"w{i}x{k}" for k in range(14)) + "." for i in range(20))
    menu = "\n".join(f"Link {i} | Link {i + 1} | Link {i + 2} | and more of the same {i}" for i in range(40))
    rows = [(1, prose), (2, prose + "\n" + menu), (3, menu)]
    got = {r.doc_id: r.kept for r in quality_rules.clean_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: True, 2: False, 3: False}


def test_quality_is_native(spark, sf):
    plan = QUERIES["op1_quality_rules"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Exchange", plan)


def test_language(spark, sf, edge_docs):
    model = language_id.fit(edge_docs.select("doc_id", "text", "lang"), language_id.Settings(max_docs=40))
    got = language_id.predict(edge_docs, model, ["doc_id", "lang", "score"][:2]).collect()
    for r in got:
        assert r.lang_pred in model.languages + ["und"] and 0 <= r.score <= 1
    by_id = {r.doc_id: r.lang_pred for r in got}
    assert by_id[9001] == by_id[9002] == by_id[9004] == "und" and by_id[9005] != "und"
    none = language_id.fit(edge_docs.where("lang is null").select("doc_id", "text", "lang"))
    assert {r.lang_pred for r in language_id.predict(edge_docs, none, ["doc_id"]).collect()} == {"und"}
    assert language_id.predict(edge_docs.limit(0), model, ["doc_id"]).collect() == []


def test_language_held_out(spark, sf):
    got = QUERIES["op6_language_id"](spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id")
    held = got.where("held_out").select(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert held >= 0.95


def test_language_chunks_agree():
    text = "Das ist ein längerer Text über Sprachen. " * 300
    whole = language_id.counts(text, 512)
    before, language_id._CHUNK = language_id._CHUNK, 100
    try:
        assert (language_id.counts(text, 512) == whole).all()
    finally:
        language_id._CHUNK = before


@pytest.fixture(scope="module")
def toxic_docs(spark):
    import random

    rng = random.Random(5)
    vocabulary = ["".join(rng.choices("abdeilmnorstu", k=rng.randint(2, 7))) for _ in range(400)]
    rows, labels = [], []
    for i in range(600):
        words = rng.choices(vocabulary, k=rng.randint(40, 120))
        bad = i % 5 == 0
        if bad:
            for _ in range(4):
                words[rng.randrange(len(words))] = rng.choice(["vileword", "nastyword"])
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_toxicity_finds_planted(spark, toxic_docs):
    docs, labels = toxic_docs
    rows = toxicity.training_rows(docs.where("doc_id < 400"), labels, "toxic", toxicity.Settings())
    model = toxicity.fit(docs, rows)
    held = toxicity.score(docs.where("doc_id >= 400"), model, ["doc_id"]).join(labels, "doc_id").collect()
    assert sum(r.predicted == r.toxic for r in held) >= 0.97 * len(held)
    odd = spark.createDataFrame([(1, None, "a"), (1, None, "a"), (2, "", "b"), (3, "vileword " * 50000, "c")], "doc_id long, text string, score string")
    got = toxicity.score(odd, model, odd.columns).collect()
    assert len(got) == 4 and all(0 <= r.score <= 1 for r in got) and got[0] == got[1]
    assert toxicity.drop_toxic(odd, model).columns == odd.columns
    assert toxicity.drop_toxic(docs.limit(0), model).collect() == []


def test_toxicity_without_labels(spark, toxic_docs):
    docs, labels = toxic_docs
    for few in (labels.limit(0), labels.where("toxic = 1"), labels.withColumn("toxic", F.lit(None).cast("int"))):
        model = toxicity.fit(docs, toxicity.training_rows(docs, few, "toxic", toxicity.Settings()))
        assert toxicity.score(docs, model, ["doc_id"]).agg(F.max("score"), F.sum("predicted")).first() == (pytest.approx(0.0, abs=1e-9), 0)


def test_licenses(spark):
    files = [
        (1, "Some text.\nLicensed under the Apache License, Version 2.0.\nMore.", "a/b/LICENSE"), (2, "plain", "a/b/c/x.txt"),
        (3, "Released under the MIT License.", "a/b/y.txt"), (4, "plain", "a/z.txt"), (5, "plain", "top.txt"),
        (6, None, "a/b/n.txt"), (7, "", None), (2, "plain", "a/b/c/x.txt"), (8, "license plates of the country were all new", "d/e.txt"),
        (9, "Released under the MIT License.", "COPYING"),
    ]
    table = spark.createDataFrame(files, "doc_id long, text string, path string").withColumn("own", F.lit("clash"))
    got = {(r.doc_id, r.path): (r.own, r.license, r.license_dir) for r in license_scan.scan_licenses(table, "doc_id").collect()}
    assert license_scan.scan_licenses(table, "doc_id").count() == len(files)
    assert got[(1, "a/b/LICENSE")] == ("Apache-2.0", "Apache-2.0", None)
    assert got[(2, "a/b/c/x.txt")] == (None, "Apache-2.0", "a/b")
    assert got[(3, "a/b/y.txt")] == ("MIT", "MIT", None)
    assert got[(4, "a/z.txt")] == (None, "MIT", "") and got[(5, "top.txt")] == (None, "MIT", "")
    assert got[(6, "a/b/n.txt")] == (None, "Apache-2.0", "a/b") and got[(7, None)] == (None, None, None)
    assert got[(8, "d/e.txt")][0] is None
    assert license_scan.scan_licenses(table.limit(0), "doc_id").collect() == []


def test_license_texts_and_headers(spark):
    """Whole licence files, wrapped and unwrapped headers and SPDX tags, which no one-line statement comes near."""
    import textwrap

    from siftmark.llm import license_texts

    wholes = [(name, text) for name, text in license_texts.whole_texts()]
    headers = [(name, text) for name, text in license_texts.HEADERS]
    files, want = [], {}

    def add(path, text, own):
        files.append((len(files), text, path))
        want[path] = own

    for i, (name, text) in enumerate(wholes):
        add(f"w{i}/COPYING", f"Copyright (c) 2020 Some One. All rights reserved.\n\n{text}", name)
    for i, (name, text) in enumerate(headers):
        add(f"h{i}/a.c", "/*\n" + "\n".join(f" * {l}" for l in textwrap.wrap(text, 60)) + "\n */\nint main() {}\n" * 30, name)
        add(f"h{i}/b.txt", "Some words before. " * 50 + text + " And many other words follow here." * 50, name)
    add("t/a.py", "# SPDX-License-Identifier: ISC\nx = 1", "ISC")
    add("t/b.c", "/* SPDX-License-Identifier: LGPL-2.1-or-later */", "LGPL-2.1")
    add("t/c.rs", "// SPDX-License-Identifier: (MIT OR Apache-2.0)", "MIT OR Apache-2.0")
    add("t/d/LICENSE", "GNU GENERAL PUBLIC LICENSE\n   Version 3, 29 June 2007\n\nsee elsewhere", "GPL-3.0")
    add("t/e.txt", "This work is licensed under the GNU General\nPublic License,\nversion 3 and more of it", "GPL-3.0")
    add("t/f.txt", "The driving licence of the car was new.", None)
    table = spark.createDataFrame(files, "doc_id long, text string, path string")
    got = {r.path: r.own for r in license_scan.scan_licenses(table, "doc_id").collect()}
    assert {p: (got[p], o) for p, o in want.items() if got[p] != o} == {}


def test_training_rows_are_the_first_of_each_class(spark, toxic_docs):
    """The first ids by hash, and no window that brings all ids of a class into one task."""
    docs, labels = toxic_docs
    rows = toxicity.training_rows(docs, labels, "toxic", toxicity.Settings(max_docs=(50, 20)))
    order = labels.withColumn("h", F.xxhash64(F.lit("toxicity"), "doc_id")).orderBy("h").collect()
    want = [r.doc_id for r in order if not r.toxic][:50] + [r.doc_id for r in order if r.toxic][:20]
    assert sorted(r.doc_id for r in rows.collect()) == sorted(want)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrdered" in plan and "Window" not in plan


def test_padded_lines_end_as_sentences(spark):
    lines = ["A padded line." + " " * 40, "Tabs too!" + "\t" * 13 + "\r", "Quoted (deeply.)" + ")\"" * 9 + "  ", "no mark" + " " * 40, '"' * 15]
    row = quality_rules.clean_lines(spark.createDataFrame([(1, "\n".join(lines))], "doc_id long, text string")).collect()[0]
    assert row.clean_text.split("\n") == lines[:3]


def rare_case():
    """1,000 training and 500 held-out texts; a fifth is toxic, with four of 200 words that about four texts share."""
    rng = random.Random(1)
    vocabulary, weights = [f"w{i}" for i in range(3000)], [1 / (i + 5) for i in range(3000)]
    toxic, rows = [f"t{i}" for i in range(200)], []
    for i in range(1500):
        words, y = rng.choices(vocabulary, weights, k=rng.randint(40, 160)), int(rng.random() < 0.2)
        for t in rng.sample(toxic, 4) if y else ():
            words.insert(rng.randrange(len(words)), t)
        rows.append((i, " ".join(words), y))
    return rows


def test_toxicity_of_rare_words(spark):
    docs = spark.createDataFrame(rare_case(), "doc_id long, text string, toxic int")
    rows = toxicity.training_rows(docs.where("doc_id < 1000"), docs.select("doc_id", "toxic"), "toxic", toxicity.Settings())
    model = toxicity.fit(docs.select("doc_id", "text"), rows)
    held = toxicity.score(docs.where("doc_id >= 1000"), model, ["doc_id", "toxic"]).collect()
    caught = [r.predicted for r in held if r.toxic]
    false = [r.predicted for r in held if not r.toxic]
    assert sum(caught) >= 0.9 * len(caught) and sum(false) <= 0.02 * len(false)


def brute_models(texts, corpus, settings):
    """P_y(w) of all words of the corpus by the definition, without classes of counts above 4 and 63."""
    grams = lambda text: set(zip(["", *text.split()], text.split()))
    shared = Counter(w for t in corpus for _, w in grams(t))
    total, kinds, d = sum(shared.values()), len(shared), settings.discount
    rate = {w: (n - d + d * kinds / (kinds + 1)) / total for w, n in shared.items()}
    out = []
    for y in (0, 1):
        own = Counter(w for t, label in texts if label == y for _, w in grams(t))
        size = sum(own.values())
        least = min(1.0, d * len(own) / size)
        cell = lambda n: n if n < 5 else 4 + int(2 * math.log2(n / 4))
        seen = Counter((cell(own[w]), n) for w, n in shared.items())
        chance = Counter()
        for w, n in shared.items():
            e = size * sum(rate[v] for v in shared if shared[v] == n) / sum(shared[v] == n for v in shared)
            for c in range(0, 60):
                chance[cell(c), n] += math.exp(c * math.log(e) - e - math.lgamma(c + 1))
        moved = {}
        for w, n in shared.items():
            e = size * rate[w]
            f = min(1.0, (chance[cell(own[w]), n] + 0.5) / (seen[cell(own[w]), n] + 0.5))
            got = max((1 - f) * own[w] + f * e, least * e)
            moved[w] = got if abs(math.log(got / e)) > settings.spread else e
        rest = size * d * kinds / (kinds + 1) / total  # words that the corpus does not have
        whole = (sum(moved.values()) + rest) / size
        out.append({w: v / size / whole for w, v in moved.items()} | {None: rest / size / whole})
    return out


def test_toxicity_models_are_distributions(spark):
    """The words' log ratios are those of two brute-force models whose probabilities sum to one."""
    rng = random.Random(7)
    rows = []
    for i in range(240):
        y = i % 3 == 0
        words = rng.choices([f"w{k}" for k in range(40)], [1 / (k + 1) for k in range(40)], k=rng.randint(3, 12))
        rows.append((i, " ".join(words + (["bad", f"t{i % 12}"] if y else [])), int(y), True))
    docs = spark.createDataFrame(rows, "doc_id long, text string, y int, fit boolean")
    settings = toxicity.Settings(spread=0.2)
    model = toxicity.fit(docs, docs.unionAll(docs.withColumn("fit", F.lit(False))), settings)
    low, high = brute_models([(t, y) for _, t, y, _ in rows], [t for _, t, _, _ in rows], settings)
    assert sum(low.values()) == pytest.approx(1, abs=1e-9) and sum(high.values()) == pytest.approx(1, abs=1e-9)
    ratio = {w: math.log(high[w] / low[w]) for w in high}
    assert model.rest == pytest.approx(ratio[None], abs=1e-6)  # both leave out counts of no chance, at other places
    assert {w: model.words.get(w, model.rest) for w in ratio if w} == pytest.approx({w: r for w, r in ratio.items() if w}, abs=1e-6)
    assert model.words["bad"] > 1


CLASHING = [
    "row", "text_", "fp", "n", "root", "wid", "wfp", "winner", "f", "w", "d", "leaks", "_leaks", "item_id", "rates", "last_rank", "_id", "_source", "_size",
    "_rank", "_rate", "_level", "_s", "_copies", "bin", "more", "_more", "_key", "_of", "key", "spans", "beside", "clean", "evidence", "_evidence", "score", "h",
    "_fp", "_n", "value", "words", "rank", "target_",
]


def test_stages_leave_columns_with_any_name(spark, sf):
    """Extra columns that are named like the stages' own keep their values in every stage."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 40")
    odd = docs.select("*", *[F.concat(F.lit(f"{c}-"), F.col("doc_id")).alias(c) for c in CLASHING])
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, odd, sf)
        plain = {r.doc_id for r in stage(spark, docs, sf).select("doc_id").collect()}
        rows = got.select("doc_id", *CLASHING).collect()
        assert {r.doc_id for r in rows} == plain, name
        assert all(r[c] == f"{c}-{r.doc_id}" for r in rows for c in CLASHING), name
