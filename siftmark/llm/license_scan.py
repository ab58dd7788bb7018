"""Licence scan: headers and licence files against templates, then inheritance down the directories.

Lines with a licence word, and the whole text of licence files that have such a line, are compared with one-line
statements. Files with such a line are also compared, each passage with the templates of its own kind
(`license_texts`): whole licence files with whole licences; headers, however wrapped, commented or joined with other
text, with headers of the same length, from the words on that headers start with; the same for the titles of
licence files. An SPDX tag names its licence itself. Whole texts go before tags, these before headers, titles
and lines; GNU versions are told apart, `-only` and `-or-later` are not.

Distinct passages, counted once however many files share them, become sparse TF-IDF vectors; their cosines with
the templates are a join on terms and a sum. Lines are weighted by the lines of the corpus, the other kinds by
the templates, so that a file's licence does not hang on other files. A file without a licence of its own gets
that of the nearest directory above it that holds a licence file: the ancestors of distinct directories are
joined by path.

Everything is DataFrame expressions; texts are scanned once and never shuffled, and only the template table,
a constant, is small by definition. Joins leave skew to adaptive execution.

Defined results: null and empty texts have no passages; a null path has no directory and inherits nothing.
Ties go to the higher cosine, then to the licence, then to the path, by code point. Repeated rows are judged one by
one; every row gives one row. Input columns other than key, text and path are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from siftmark.llm import license_texts
from siftmark.llm.common import let, materialise

# Statements by which works name their licence, one line each.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC0-1.0", "This work is dedicated to the public domain under CC0 1.0 Universal"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("LGPL-2.1", "This library is licensed under the GNU Lesser General Public License, version 2.1"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("LicenseRef-Proprietary", "All rights reserved"),
)
TRIGGER = r"(?i)licen[sc]e|copyright|spdx-|all rights reserved|public domain|hereby granted|redistribution and use"
# Kinds of passages in the order in which they count.
KINDS = ("text", "tag", "header", "title", "line")
TAG = r"(?i)SPDX-License-Identifier:[\x20\t]*([^\r\n]*)"
LICENSE_FILE = r"(?i)^(licen[sc]e|copying|unlicense)([-._].*)?$"


@dataclass(frozen=True)
class Settings:
    cosine: float = 0.75


def _terms(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda t: t != "")


def directory(path: Column) -> Column:
    """The path up to its last slash; empty at the top."""
    return F.regexp_replace(path, r"/?[^/]*$", "")


def _vectors(passages: DataFrame, idf: DataFrame) -> DataFrame:
    """passage, term, weight: TF-IDF of unit length."""
    counted = passages.select("passage", F.explode(_terms(F.col("body"))).alias("term")).groupBy("passage", "term").agg(F.count("*").alias("tf"))
    weighted = counted.join(idf, "term").withColumn("w", F.col("tf") * F.col("idf"))
    norm = weighted.groupBy(F.col("passage").alias("p")).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return weighted.join(norm, F.col("passage") == F.col("p")).select("passage", "term", (F.col("w") / F.col("norm")).alias("w"))


def match_templates(bodies: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """body, license and cosine of the distinct bodies that come near a template; bodies has a column body."""
    spark: SparkSession = bodies.sparkSession
    templates = spark.createDataFrame([(f"t{i}", name, text) for i, (name, text) in enumerate(TEMPLATES)], "passage string, license string, body string")
    distinct = bodies.select(F.sha2("body", 256).alias("passage"), "body").distinct()
    both = distinct.unionByName(templates.select("passage", "body"))
    terms = both.select("passage", F.explode(F.array_distinct(_terms(F.col("body")))).alias("term"))
    total = both.agg(F.count("*").alias("n"))
    idf = terms.groupBy("term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(total))  # one row
    idf = materialise(idf.select("term", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf")), "license-idf")
    vectors = _vectors(both, idf)
    mine = vectors.join(distinct.select("passage"), "passage", "left_semi")
    theirs = vectors.join(F.broadcast(templates.select("passage", "license")), "passage")
    theirs = theirs.select(F.col("passage").alias("template"), "license", "term", F.col("w").alias("v"))
    cosines = mine.join(theirs, "term").groupBy("passage", "template", "license").agg(F.sum(F.col("w") * F.col("v")).alias("cosine"))
    best = cosines.where(F.col("cosine") >= settings.cosine).groupBy("passage").agg(
        F.min(F.struct(-F.round("cosine", 9), F.col("license"))).alias("b")
    )
    return distinct.join(best, "passage").select("body", F.col("b.license").alias("license"), (-F.col("b.col1")).alias("cosine"))


def _words(text: str) -> list[str]:
    return [t for t in re.split("[^a-z0-9]+", text.lower()) if t]


def _from_anchor(kind: str, text: str) -> list[str]:
    """The words of a template from the first words on that its kind is looked for by; none without such words."""
    body = " ".join(_words(text))
    starts = [m.start() for a in license_texts.ANCHORS[kind] if (m := re.search(rf"\b{a}\b", body))]
    return body[min(starts):].split(" ") if starts else []


@cache
def _templates() -> tuple[list[tuple[str, str, list[str]]], dict[str, float], float]:
    """(kind, license, words) of the templates of whole passages, the idf of their terms, and that of any other term."""
    out = [("text", name, _words(text)) for name, text in license_texts.whole_texts()]
    out += [("header", name, _from_anchor("header", text)) for name, text in license_texts.HEADERS]
    # One-line statements may be wrapped as well; what two licences have in common does not count as a header.
    out += [("header", name, _from_anchor("header", text)) for name, text in TEMPLATES if re.search("(?i)(licensed|released) under|dedicated to", text)]
    out += [("line", name, _from_anchor("header", text)) for name, text in TEMPLATES if "Redistribution" in text]
    out += [("title", name, _from_anchor("title", text)) for name, text in license_texts.TITLES]
    out = [t for t in out if t[2]]
    df = Counter(t for _, _, words in out for t in set(words))
    return out, {t: math.log((1 + len(out)) / (1 + n)) + 1 for t, n in df.items()}, math.log(1 + len(out)) + 1


def _lengths(kind: str) -> list[int]:
    """The lengths of windows, which are those of the templates: a shorter one may end before a version, a longer one is diluted."""
    return sorted({len(words) for k, _, words in _templates()[0] if k == kind})


def _windows(norm: Column, kinds: list[str], anchors: str) -> Column:
    """(kind, body): the words that follow where a template of the kinds may start, in the lengths of their templates."""
    starts = "|".join(license_texts.ANCHORS[anchors])
    longest = max(n for k in kinds for n in _lengths(k))
    pattern = rf"(?<![a-z0-9])(?=(?:{starts})(?![a-z0-9]))(?=([a-z0-9]++(?: [a-z0-9]++){{0,{longest - 1}}}))"
    cuts = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(n).alias("n")) for k in kinds for n in _lengths(k)])
    cut = lambda ws: F.transform(cuts, lambda c: F.struct(c["kind"].alias("kind"), F.array_join(F.slice(ws, 1, c["n"]), " ").alias("body")))
    found = F.transform(F.regexp_extract_all(norm, F.lit(pattern), F.lit(1)), lambda w: F.split(w, " "))
    return F.array_distinct(F.flatten(F.transform(found, cut)))


def _gain(term: str, kinds: tuple[str, ...], cosine: float) -> str:
    """What a term adds to (1 - c^2) seen - c^2 unseen, at most; seen is the energy of terms that templates of the kinds hold."""
    templates, idf, other = _templates()
    mine = sorted({t for k, _, words in templates if k in kinds for t in words}, key=lambda t: (idf[t], t))
    rest = sorted(set(idf) - set(mine))
    listed = lambda terms: ", ".join(f"'{t}'" for t in terms)
    width = -(-len(mine) // 6)
    whens = [f"WHEN {term} IN ({listed(band)}) THEN {idf[band[-1]] ** 2 * (1 - cosine**2)!r}D" for band in (mine[i:i + width] for i in range(0, len(mine), width))]
    if rest:
        whens.append(f"WHEN {term} IN ({listed(rest)}) THEN {-min(idf[t] for t in rest) ** 2 * cosine**2!r}D")
    return f"CASE {' '.join(whens)} ELSE {-other**2 * cosine**2!r}D END"


def _may_match(passages: str, kinds: tuple[str, ...], settings: Settings) -> Column:
    """Without the passages whose terms outside all templates alone keep them from the cosine (Cauchy-Schwarz)."""
    add = f"a.sum + a.n * a.n * {_gain('a.prev', kinds, settings.cosine - 1e-6)}"
    return F.expr(f"""filter({passages}, p -> aggregate(
        array_sort(split(p.body, ' ')), named_struct('prev', '', 'n', 0D, 'sum', 0D),
        (a, t) -> if(t = a.prev, named_struct('prev', t, 'n', a.n + 1D, 'sum', a.sum), named_struct('prev', t, 'n', 1D, 'sum', {add})),
        a -> {add}) >= 0)""")


def match_passages(found: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """passage, kind, license and cosine of the distinct passages that come near a template of their kind."""
    spark: SparkSession = found.sparkSession
    templates, idf, other = _templates()
    vectors = []
    for i, (kind, name, words) in enumerate(templates):
        weights = {t: n * idf[t] for t, n in Counter(words).items()}
        norm = math.sqrt(sum(w * w for w in weights.values()))
        vectors += [(kind, i, name, t, w / norm) for t, w in weights.items()]
    theirs = spark.createDataFrame(vectors, "kind string, template int, license string, term string, v double")
    rates = spark.createDataFrame(list(idf.items()), "term string, idf double")
    counted = found.select("passage", "kind", "body").distinct().select("passage", "kind", F.explode(F.split("body", " ")).alias("term"))
    counted = counted.groupBy("passage", "kind", "term").agg(F.count("*").alias("tf"))
    weighted = counted.join(F.broadcast(rates), "term", "left").withColumn("w", F.col("tf") * F.coalesce("idf", F.lit(other)))
    weighted = materialise(weighted.select("passage", "kind", "term", "w"), "license-weights")
    norms = weighted.groupBy("passage").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    dots = weighted.join(F.broadcast(theirs), ["kind", "term"]).groupBy("passage", "kind", "template", "license").agg(F.sum(F.col("w") * F.col("v")).alias("dot"))
    cosines = dots.join(norms, "passage").withColumn("cosine", F.round(F.col("dot") / F.col("norm"), 9)).where(F.col("cosine") >= settings.cosine)
    best = cosines.groupBy("passage", "kind").agg(F.min(F.struct((-F.col("cosine")).alias("c"), F.col("license"))).alias("b"))
    return best.select("passage", "kind", F.col("b.license").alias("license"), (-F.col("b.c")).alias("cosine"))


def _tagged(text: Column) -> Column:
    """The licence or expression that an SPDX tag names, without the marks of a comment; null without a tag."""
    said = F.regexp_replace(F.regexp_extract(text, TAG, 1), r"[\x20\t]*(?:\*+/|--+>|[\x20\t\"'.,;#]+)[\x20\t]*$", "")
    said = F.regexp_replace(F.trim(said), r"^\(([^()]*)\)$", "$1")
    one = F.regexp_replace(said, r"(?i)^([A-Z]*GPL-[0-9.]+|GFDL-[0-9.]+)(?:-only|-or-later|\+)$", "$1")
    return F.when(one.rlike(r"^[A-Za-z0-9(][A-Za-z0-9 .+:()-]*$"), one)


def scan_licenses(files: DataFrame, key: str, settings: Settings = Settings()) -> DataFrame:
    """key, path, own (the file's licence), cosine, license (own or inherited) and license_dir, for every row of key, text, path."""
    lines = F.filter(F.split("text", "\n"), lambda l: l.rlike(TRIGGER))
    name = F.substring_index("path", "/", -1)
    is_file = F.coalesce(name.rlike(LICENSE_FILE), F.lit(False))
    rows = files.select(F.col(key).alias("_key"), "path", directory(F.col("path")).alias("dir"), is_file.alias("is_file"), "text", lines.alias("lines"))
    # Passages hold words joined by blanks.
    hits, none = F.size("lines") > 0, F.array().cast("array<struct<kind:string,body:string>>")
    rows = rows.withColumn("norm", F.when(hits, F.array_join(_terms(F.col("text")), " "))).withColumn("tag", F.when(hits, _tagged(F.col("text"))))
    rows = rows.withColumn("windows", let(F.col("norm"), lambda norm: F.concat(
        _windows(norm, ["header", "line"], "header"), F.when(F.col("is_file"), _windows(norm, ["title"], "title")).otherwise(none)
    )))
    rows = rows.withColumn("whole", F.when(F.col("is_file") & hits, F.array(F.struct(F.lit("text").alias("kind"), F.col("norm").alias("body")))))
    few = [F.coalesce(_may_match(c, kinds, settings), none) for c, kinds in (("whole", ("text",)), ("windows", ("header", "line", "title")))]
    rows = rows.withColumn("passages", F.concat(*few))
    bodies = F.when(F.col("is_file") & (F.size("lines") > 0), F.array_append("lines", F.col("text"))).otherwise(F.col("lines"))
    rows = rows.withColumn("bodies", F.array_distinct(F.coalesce(bodies, F.array().cast("array<string>"))))
    rows = rows.withColumn("_rid", F.monotonically_increasing_id()).select("_rid", "_key", "path", "dir", "is_file", "bodies", "passages", "tag")
    rows = materialise(rows, "license-files")

    found = rows.where("size(bodies) > 0").select("_rid", F.explode("bodies").alias("body"))
    matched = materialise(match_templates(found.select("body"), settings), "license-matches")
    own = found.join(matched.withColumnRenamed("body", "b"), F.col("body") == F.col("b")).select("_rid", F.lit("line").alias("kind"), "license", "cosine")
    parts = rows.where("size(passages) > 0").select("_rid", F.explode("passages").alias("p")).select("_rid", "p.kind", "p.body")
    parts = parts.withColumn("passage", F.sha2(F.concat_ws(" ", "kind", "body"), 256))
    whole = materialise(match_passages(parts, settings), "license-passages").withColumnRenamed("kind", "k").withColumnRenamed("passage", "q")
    own = own.unionByName(parts.join(whole, F.col("passage") == F.col("q")).select("_rid", "kind", "license", "cosine"))
    own = own.unionByName(rows.where("tag is not null").select("_rid", F.lit("tag").alias("kind"), F.col("tag").alias("license"), F.lit(1.0).alias("cosine")))
    order = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    own = own.groupBy(F.col("_rid").alias("r")).agg(F.min(F.struct(order.alias("k"), (-F.col("cosine")).alias("c"), F.col("license"))).alias("m"))
    own = own.select("r", F.col("m.license").alias("own"), (-F.col("m.c")).alias("cosine"))
    rows = materialise(rows.drop("bodies", "passages", "tag").join(own, F.col("_rid") == F.col("r"), "left").drop("r"), "license-own")

    # One licence per directory: of its licence files, the nearest to a template.
    holders = rows.where("is_file and own is not null").groupBy(F.col("dir").alias("holder")).agg(
        F.min(F.struct((-F.col("cosine")).alias("c"), F.col("own"), F.col("path"))).alias("h")
    ).select("holder", F.col("h.own").alias("given"))
    parts = F.split("dir", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.concat_ws("/", F.slice(parts, 1, n)))
    dirs = rows.where("dir is not null").select("dir").distinct().select("dir", F.explode(F.array_distinct(above)).alias("ancestor"))
    near = dirs.join(holders, F.col("ancestor") == F.col("holder")).groupBy(F.col("dir").alias("d")).agg(
        F.max(F.struct(F.length("ancestor").alias("n"), F.col("given"), F.col("holder"))).alias("h")
    ).select("d", F.col("h.given").alias("given"), F.col("h.holder").alias("holder"))
    joined = rows.join(near, F.col("dir") == F.col("d"), "left")
    return joined.select(
        F.col("_key").alias(key), "path", "own", "cosine", F.coalesce("own", "given").alias("license"),
        F.when(F.col("own").isNull(), F.col("holder")).alias("license_dir"),
    )
