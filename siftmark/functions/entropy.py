"""Expressions of the secret scan: candidate values and their Shannon entropy."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from siftmark.functions.text import trim_unicode

# Fixed values of the secret scan: threshold, assignment form, alphabet.
DEFAULT_THRESHOLD = 4.5
ASSIGNMENT = r"""[\w\-\x{17F}\x{212A}][\t\n\f\r ]*[:=][\t\n\f\r ]*["']([^"'\t\n\f\r ]{12,})["']"""
CANDIDATE = r"^[A-Za-z0-9+/=_\-]{12,}\z"
COMMENT_STARTS = ["//", "#", "*"]

# One word character before the separator is enough: how far the name reaches to
# the left changes neither the value nor where the next match may start.


def is_comment(line: Column) -> Column:
    bare = trim_unicode(line)
    return reduce(lambda a, b: a | b, [bare.startswith(c) for c in COMMENT_STARTS])


def secret_values(line: Column) -> Column:
    """All candidate values assigned on the line, in order; none on comment lines."""
    values = F.filter(F.regexp_extract_all(line, F.lit(ASSIGNMENT), F.lit(1)), lambda v: v.rlike(CANDIDATE))
    return F.when(is_comment(line), F.array().cast("array<string>")).otherwise(values)


def shannon(value: Column) -> Column:
    """Entropy in bits per character; 0 for the empty string."""
    chars = F.split(value, "")
    total = F.length(value)

    def weight(c):
        return F.size(F.filter(chars, lambda y: y == c)) / total

    bits = F.aggregate(
        F.transform(F.array_distinct(chars), weight), F.lit(0.0), lambda acc, p: acc - p * F.log2(p)
    )
    return F.when(total > 0, F.round(bits, 12)).otherwise(0.0)


def redact(value: Column) -> Column:
    return F.when(F.length(value) <= 8, F.lit("***")).otherwise(
        F.concat(F.left(value, F.lit(4)), F.lit("***"), F.right(value, F.lit(4)))
    )


def entropy_text(bits: Column) -> Column:
    """Two decimals, cut and not rounded."""
    hundredths = F.floor(bits * 100)
    return F.format_string("%d.%02d", F.floor(hundredths / 100), F.pmod(hundredths, F.lit(100)))
