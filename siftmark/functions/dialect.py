"""Rule patterns are written in RE2 syntax; Spark matches with java.util.regex.

`translate` rewrites one pattern so that Java finds what RE2 would find:
ASCII word boundaries, RE2's white space set, `$` only at the very end, Unicode
case folding, literal brackets in classes. Constructs RE2 does not have
(look-around, back references, possessive repeats) are refused, so a pack means
the same everywhere.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

_WORD = "[0-9A-Za-z_]"
_AT_WORD_EDGE = f"(?:(?<={_WORD})(?!{_WORD})|(?<!{_WORD})(?={_WORD}))"
_NOT_WORD_EDGE = f"(?:(?<={_WORD})(?={_WORD})|(?<!{_WORD})(?!{_WORD}))"
_SPACE = r"\t\n\f\r "
_NOT_SPACE = r"\x00-\x08\x0B\x0E-\x1F!-\x{10FFFF}"
_MOST_REPEATS = 1000
_REPEAT = re.compile(r"\{\d+(,\d*)?\}")
_GROUP_NAME = re.compile(r"\(\?P?<[A-Za-z_]\w*>")
_FIRST_RUN = re.compile(r"^(\[(?:[^\[\]\\&]|\\.)+\])\+(?![+?])")
_FLAGS = re.compile(r"\(\?([imsU]*)(?:-([imsU]+))?([:)])")
_POSIX = re.compile(r"\[:(\^?)([a-z]+):\]")
# POSIX class names of RE2 and their members.
_POSIX_SETS = {
    "alnum": "0-9A-Za-z", "alpha": "A-Za-z", "ascii": r"\x00-\x7F", "blank": r"\t ",
    "cntrl": r"\x00-\x1F\x7F", "digit": "0-9", "graph": "!-~", "lower": "a-z", "print": " -~",
    "punct": r"!-/:-@\[-`{-~", "space": r"\t\n\x0B\f\r ", "upper": "A-Z", "word": "0-9A-Za-z_",
    "xdigit": "0-9A-Fa-f",
}


class PatternError(ValueError):
    """The pattern is not valid in the rule dialect."""


@dataclass(frozen=True)
class Translated:
    line: str  # to be matched against one line, or one whole text
    search: str  # matches a text whenever `line` matches one of its lines, and maybe others
    # Every match contains one of these (text, fold); a folded one is lower case and is
    # looked up in lower-cased text. Empty when nothing is known.
    literals: tuple[tuple[str, bool], ...]

    @property
    def first(self) -> str | None:
        """A cheaper test to try on a line before `line`; None where it would not be cheaper."""
        return self.search if _AT_WORD_EDGE in self.line or _NOT_WORD_EDGE in self.line else None


class _Scanner:
    def __init__(self, pattern: str, per_line: bool):
        self.src = pattern
        self.per_line = per_line
        self.pos = 0
        self.out: list[str] = []
        self.multiline = False
        self.fold = False
        self.saved: list[tuple[bool, bool]] = []
        self.runs: list[tuple[str, bool]] = []
        self.run = ""
        self.branches: list[list[tuple[str, bool]]] = []
        self.repeatable = False

    # -- literal runs outside any group, used as a cheap pre-test ------------
    def _end_run(self):
        if self.run:
            self.runs.append((self.run, self.fold))
        self.run = ""

    def _end_branch(self):
        self.branches.append(self.runs)
        self.runs = []

    def _emit(self, text: str, literal: str | None = None):
        self.out.append(text)
        self.repeatable = True
        if literal is None or self.saved:
            self._end_run()
        else:
            self.run += literal

    def _fail(self, why: str):
        raise PatternError(f"{why} in pattern {self.src!r}")

    def scan(self) -> str:
        while self.pos < len(self.src):
            ch = self.src[self.pos]
            handler = {
                "\\": self._escape, "[": self._klass, "(": self._open, ")": self._close,
                "*": self._repeat, "+": self._repeat, "?": self._repeat, "{": self._brace,
            }.get(ch)
            if handler:
                handler()
                continue
            self.pos += 1
            if ch == "|":
                self._end_run()
                if not self.saved:
                    self._end_branch()
                self.out.append("|")
                self.repeatable = False
            elif ch == "^":
                self._emit("^")
            elif ch == "$":
                self._emit("$" if self.multiline or not self.per_line else r"\z")
            elif ch == ".":
                self._emit(".")
            else:
                self._emit("\\" + ch if ch in "]}" else ch, ch)
        if self.saved:
            self._fail("missing closing parenthesis")
        self._end_run()
        self._end_branch()
        return "".join(self.out)

    def _open(self):
        self._end_run()
        named = _GROUP_NAME.match(self.src, self.pos)
        flags = _FLAGS.match(self.src, self.pos)
        if named:
            opener, self.pos = "(", named.end()
        elif flags:
            # U swaps greedy and lazy, which changes neither whether a pattern matches nor where it starts.
            on, off, tail = flags.group(1).replace("U", ""), (flags.group(2) or "").replace("U", ""), flags.group(3)
            self.pos = flags.end()
            if tail == ":":
                self.saved.append((self.multiline, self.fold))
            self.multiline = "m" in on or (self.multiline and "m" not in off)
            self.fold = "i" in on or (self.fold and "i" not in off)
            if not self.per_line:
                off = off.replace("m", "")
            text = on.replace("i", "iu") + ("-" + off.replace("i", "iu") if off else "")
            if tail == ")":
                self.out.append(f"(?{text})" if text else "")
                self.repeatable = False
            else:
                self.out.append(f"(?{text}:")
                self.repeatable = False
            return
        elif self.src.startswith("(?", self.pos):
            self._fail("unsupported group")
        else:
            opener, self.pos = "(", self.pos + 1
        self.saved.append((self.multiline, self.fold))
        self.out.append(opener)
        self.repeatable = False

    def _close(self):
        if not self.saved:
            self._fail("unexpected closing parenthesis")
        self.multiline, self.fold = self.saved.pop()
        self.pos += 1
        self.out.append(")")
        self.repeatable = True

    def _repeat(self, token: str | None = None):
        if not self.repeatable:
            self._fail("repeat without an operand")
        token = token or self.src[self.pos]
        self.pos += len(token)
        optional = token in "*?" or re.match(r"\{0+[,}]", token)
        if self.run and not self.saved:
            if optional:
                self.run = self.run[:-1]
            self._end_run()
        lazy = self.src.startswith("?", self.pos)
        self.pos += lazy
        self.out.append(token + ("?" if lazy else ""))
        self.repeatable = False

    def _brace(self):
        repeat = _REPEAT.match(self.src, self.pos)
        if repeat:
            if any(int(n) > _MOST_REPEATS for n in re.findall(r"\d+", repeat.group(0))):
                self._fail("repeat above 1000")
            self._repeat(repeat.group(0))
        else:
            self.pos += 1
            self._emit(r"\{", "{")

    def _code_point(self) -> str | None:
        """Numeric and control escapes, shared by classes and plain text."""
        rest = self.src[self.pos + 1:]
        for rx, base in ((r"x\{([0-9A-Fa-f]+)\}", 16), (r"x([0-9A-Fa-f]{2})", 16), (r"(0[0-7]{0,2})", 8)):
            m = re.match(rx, rest)
            if m:
                self.pos += 1 + m.end()
                return "\\x{%X}" % int(m.group(1), base)
        named = {"a": r"\x07", "f": r"\f", "t": r"\t", "n": r"\n", "r": r"\r", "v": r"\x0B"}
        if rest[:1] in named:
            self.pos += 2
            return named[rest[0]]
        return None

    def _property(self) -> str | None:
        m = re.match(r"\\([pP])(?:\{(\^?)(\w+)\}|(\w))", self.src[self.pos:])
        if not m:
            return None
        self.pos += m.end()
        name = m.group(3) or m.group(4)
        negative = (m.group(1) == "P") != bool(m.group(2))
        return "\\%s{%s}" % ("P" if negative else "p", name if len(name) <= 2 else "Is" + name)

    def _escape(self):
        nxt = self.src[self.pos + 1:self.pos + 2]
        if not nxt:
            self._fail("trailing backslash")
        if nxt == "Q":
            end = self.src.find("\\E", self.pos + 2)
            body = self.src[self.pos + 2:] if end < 0 else self.src[self.pos + 2:end]
            self.pos = len(self.src) if end < 0 else end + 2
            for ch in body:
                self._emit(ch if ch.isalnum() or ord(ch) > 127 else "\\" + ch, ch)
            return
        special = self._code_point() or self._property()
        if special:
            self._emit(special)
            return
        self.pos += 2
        if nxt in "bB":
            # a search may find too much, so it goes without the costly word edges
            edge = _AT_WORD_EDGE if nxt == "b" else _NOT_WORD_EDGE
            repeated = self.src[self.pos:self.pos + 1] in ("*", "+", "?", "{")
            self._emit(edge if self.per_line else "(?:)" if repeated else "")
        elif nxt == "s":
            self._emit(f"[{_SPACE}]")
        elif nxt == "S":
            self._emit(f"[^{_SPACE}]")
        elif nxt in "dDwW":
            self._emit("\\" + nxt)
        elif nxt == "A":
            self._emit("\\A" if self.per_line else "^")
        elif nxt == "z":
            self._emit("\\z" if self.per_line else "$")
        elif nxt.isalnum() or ord(nxt) > 127:
            self._fail(f"unsupported escape \\{nxt}")
        else:
            self._emit("\\" + nxt, nxt)

    def _klass(self):
        out = ["["]
        self.pos += 1
        if self.src.startswith("^", self.pos):
            out.append("^")
            self.pos += 1
        first = True
        while True:
            if self.pos >= len(self.src):
                self._fail("missing closing bracket")
            ch = self.src[self.pos]
            posix = _POSIX.match(self.src, self.pos)
            if ch == "]" and not first:
                self.pos += 1
                break
            first = False
            if posix:
                if posix.group(2) not in _POSIX_SETS:
                    self._fail("unsupported class name")
                members = _POSIX_SETS[posix.group(2)]
                out.append(f"[^{members}]" if posix.group(1) else members)
                self.pos = posix.end()
            elif ch == "\\":
                nxt = self.src[self.pos + 1:self.pos + 2]
                special = self._code_point() or self._property()
                if special:
                    out.append(special)
                    continue
                self.pos += 2
                if nxt == "s":
                    out.append(_SPACE)
                elif nxt == "S":
                    out.append(_NOT_SPACE)
                elif nxt in set("dDwW"):
                    out.append("\\" + nxt)
                elif not nxt or nxt.isalnum() or ord(nxt) > 127:
                    self._fail(f"unsupported escape \\{nxt}")
                else:
                    out.append("\\" + nxt)
            else:
                self.pos += 1
                out.append("\\" + ch if ch in "[]&^" else ch)
        out.append("]")
        self._emit("".join(out))


def _best_literal(runs: list[tuple[str, bool]]) -> tuple[str, bool] | None:
    best = None
    for text, fold in runs:
        if fold:
            # s and k also fold to letters outside ASCII, so they end a run
            text = max((p.lower() for p in re.split(r"[sSkK]|[^\x00-\x7F]", text)), key=len)
        telling = len(text) > 1 or (len(text) == 1 and not text.isalnum() and text != " ")
        if telling and (best is None or len(text) > len(best[0])):
            best = (text, fold)
    return best


def translate(pattern: str) -> Translated:
    per_line = _Scanner(pattern, per_line=True)
    line = "(?d)" + per_line.scan()
    # A text with a match of X+Y has one of XY, which costs no way back over each run of X.
    search = "(?dm)" + _FIRST_RUN.sub(r"\1", _Scanner(pattern, per_line=False).scan())
    found = [_best_literal(runs) for runs in per_line.branches]
    return Translated(line, search, tuple(found) if all(found) else ())
