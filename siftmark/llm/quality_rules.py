"""Quality rules, line first: drop lines that fail, then documents that lost too much.

Everything is DataFrame expressions over one document at a time: no shuffle, no Python.

Defined results: a null or empty text has no words, fails the base rule and keeps no text. Ties and
repeated rows do not matter, since a row is judged alone; every input row gives one output row. Null
values in other columns pass through. Input columns that bear the name of a result are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from siftmark.llm.common import WORD, let, words

SYMBOLS = "[#*$%&|<>]+"
BLANKS = " \t\n\x0b\f\r"
CLOSING = "\"'”’»)]"
SENTENCE_ENDS = tuple(".!?…。！？")
# Whole lines of menus, and phrases of page furniture, in lower case.
MENU_LINES = (
    "home", "menu", "search", "log in", "login", "sign in", "sign up", "register", "next", "previous", "back to top",
    "contact us", "about us", "site map", "skip to content", "read more", "share this",
)
BOILERPLATE = (
    "cookie policy", "we use cookies", "privacy policy", "terms of use", "terms of service", "all rights reserved",
    "enable javascript", "javascript is disabled", "lorem ipsum", "subscribe to our newsletter", "click here to",
    "follow us on", "powered by",
)


@dataclass(frozen=True)
class LineRules:
    """max_loss: share of the characters of all lines that the rules may remove before the document goes."""

    max_loss: float = 0.5
    max_separators: int = 2
    max_shouts: int = 2
    min_words: int = 50


def fails_punctuation(line: Column, rules: LineRules) -> Column:
    """The line does not end as a sentence does, or shouts: doubled marks again and again."""
    # Trailing white space, then closing marks, however many.
    rest = F.rtrim(F.rtrim(line, F.lit(BLANKS)), F.lit(CLOSING))
    return ~F.substring(rest, -1, 1).isin(*SENTENCE_ENDS) | line.rlike(f"(?:[!?][!?][^!?]*){{{rules.max_shouts + 1}}}")


def fails_navigation(line: Column, low: Column, rules: LineRules) -> Column:
    """A row of links between separators, or a line that is one entry of a menu."""
    return line.rlike(f"(?:[|»›•][^|»›•]*){{{rules.max_separators + 1}}}") | (
        (F.length(line) <= 40) & F.trim(low).isin(*MENU_LINES)
    )


def fails_boilerplate(low: Column) -> Column:
    found = F.contains(low, F.lit(BOILERPLATE[0]))
    for phrase in BOILERPLATE[1:]:
        found = found | F.contains(low, F.lit(phrase))
    return found


def repeated_words(ws: Column) -> Column:
    """Words inside a 3-word window that the text has twice or more.

    Hashes tell most texts, which repeat nothing. In the others the windows themselves are sorted with
    their places, so equal ones are neighbours; the places found are sorted again and each covers the
    words up to the next one, three at most.
    """
    last = F.size(ws) - 3
    hashes = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(ws[i], ws[i + 1], ws[i + 2]))
    repeats = let(hashes, lambda h: F.size(F.array_distinct(h)) < F.size(h))
    windows = F.transform(
        F.sequence(F.lit(0), last),
        lambda i: F.struct(F.concat_ws(" ", ws[i], ws[i + 1], ws[i + 2]).alias("w"), i.alias("at")),
    )
    same = lambda x, y: F.coalesce(x["w"] == y["w"], F.lit(False))
    places = let(F.sort_array(windows), lambda s: F.transform(F.filter(
        s, lambda x, i: same(F.get(s, i - 1), x) | same(F.get(s, i + 1), x)
    ), lambda x: x["at"]))
    covered = let(F.sort_array(places), lambda p: F.aggregate(
        F.transform(p, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1) - x, F.lit(3)))),
        F.lit(0), lambda total, x: total + x,
    ))
    return F.when(last < 1, 0).when(repeats, covered).otherwise(0)


def clean_lines(docs: DataFrame, text: str = "text", rules: LineRules = LineRules()) -> DataFrame:
    """docs with the base measures, the verdict and clean_text, the lines that pass."""
    body = F.coalesce(F.col(text), F.lit(""))
    names = [c for c in docs.columns]
    step = docs.select(
        *names, words(body).alias("_words"),
        F.filter(F.split(body, "\n"), lambda l: l.rlike(WORD)).alias("_lines"),
    )
    # The lower-cased copy is made once for all phrases.
    both = F.transform("_lines", lambda l: F.struct(l.alias("line"), F.lower(l).alias("low")))
    passes = lambda x: ~(
        fails_punctuation(x["line"], rules) | fails_navigation(x["line"], x["low"], rules) | fails_boilerplate(x["low"])
    )
    chars = lambda lines: F.aggregate(lines, F.lit(0), lambda n, l: n + F.length(l))
    measures = {
        "n_words": F.size("_words").cast("long"),
        "word_chars": F.length(F.concat_ws("", "_words")).cast("long"),
        "n_symbols": (F.length(body) - F.length(F.regexp_replace(body, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "n_repeat_words": repeated_words(F.col("_words")).cast("long"),
        "_good": F.transform(F.filter(both, passes), lambda x: x["line"]),
        "_chars": chars(F.col("_lines")),
    }
    step = step.select(*[c for c in names if c not in measures], "_lines", *[v.alias(k) for k, v in measures.items()])
    failed = (F.col("n_words") < rules.min_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    verdict = {
        "n_lines": F.size("_lines").cast("long"), "n_good_lines": F.size("_good").cast("long"),
        "base_failed": failed,
        "kept": ~failed & (chars(F.col("_good")) >= (1 - rules.max_loss) * F.col("_chars")),
        "clean_text": F.concat_ws("\n", "_good"),
    }
    rest = [c for c in step.columns if c not in verdict and c not in ("_lines", "_good", "_chars")]
    return step.select(*rest, *[v.alias(k) for k, v in verdict.items()])
