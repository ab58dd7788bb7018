"""Column expressions over file texts: lines, suppression markers, trimming, offsets."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

DEFAULT_MARKER = "scan:ignore"
# The code points with the Unicode property White_Space.
WHITE_SPACE = (
    "\t\n\v\f\r \u0085\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def trim_unicode(col: Column) -> Column:
    """Strip Unicode white space on both sides (`trim` strips blanks only)."""
    return F.btrim(col, F.lit(WHITE_SPACE))


def line_body(content: Column) -> Column:
    """The text with CRLF as LF, and without a carriage return at its very end.

    Together with `split_lines` one carriage return is gone per line.
    """
    unix = F.replace(content, F.lit("\r\n"), F.lit("\n"))
    return F.when(unix.endswith("\r"), F.substring(unix, F.lit(1), F.length(unix) - 1)).otherwise(unix)


def last_newline_off(body: Column) -> Column:
    """The text without one newline at its very end."""
    return F.when(body.endswith("\n"), F.substring(body, F.lit(1), F.length(body) - 1)).otherwise(body)


def split_lines(body: Column) -> Column:
    """The lines; no empty one follows the last newline. Empty content needs a guard by
    the caller, because splitting '' gives one empty line, not none."""
    return F.split(last_newline_off(body), "\n", -1)


def let(value: Column, body) -> Column:
    """body(value), with the value computed once however often body names it."""
    return F.get(F.transform(F.array(value), body), 0)


def file_suppressed(body: Column, marker: str) -> Column:
    """The whole-file marker stands in one of the first ten lines."""
    token = marker + "-file"
    head = F.slice(F.split(body, "\n", 11), 1, 10)
    return F.when(body.contains(token), F.exists(head, lambda l: l.contains(token))).otherwise(False)


def line_suppressed(line: Column, rule_id: Column, marker: str) -> Column:
    """The first marker on the line has nothing behind it, or a comma list with the rule's id."""
    at = F.instr(line, marker)
    rest = trim_unicode(F.substring(line, at + len(marker), F.length(line)))
    listed = F.array_contains(F.transform(F.split(rest, ","), trim_unicode), rule_id)
    return F.when(at > 0, (rest == "") | listed).otherwise(False)


def byte_column(line: Column, line_regex: Column) -> Column:
    """1 + byte offset of the first match."""
    before = F.regexp_extract_all(line, F.concat(F.lit(r"\A([\s\S]*?)(?:"), line_regex, F.lit(")")), F.lit(1))
    return F.octet_length(F.get(before, 0)) + F.lit(1)


def truncate_bytes(col: Column, n: int, mark: str = "\u2026") -> Column:
    """Texts of at most n bytes as they are, longer ones cut to n - 1 bytes with the mark behind.

    The cut goes back to the start of a character that it would split, so the result is valid UTF-8.
    """
    if n < 1:
        raise ValueError("texts cannot be cut to less than one byte")
    raw = col.cast("binary")

    def splits(keep: int) -> Column:
        """The byte behind the first `keep` ones goes on with a character."""
        return F.hex(F.substring(raw, keep + 1, 1)).between("80", "BF")

    keep = F.lit(max(n - 4, 0))
    for k in range(max(n - 3, 0), n):  # a character has at most three bytes behind its first one
        keep = F.when(~splits(k), F.lit(k)).otherwise(keep)
    cut = F.substring(raw, F.lit(1), keep).cast("string")
    return F.when(F.octet_length(col) <= n, col).otherwise(F.concat(cut, F.lit(mark)))


def extension(path: Column) -> Column:
    """Lower-cased suffix of the last path segment from its last dot, '' without one."""
    return F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))


def path_order(path: Column) -> Column:
    """Sorts like a directory walk: segment by segment (NUL sorts before any name byte)."""
    return F.replace(path, F.lit("/"), F.lit("\0"))


def literal_map(entries: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in entries.items() for x in pair])
