"""ECMA-262 patterns as Java, Python and RE2 patterns: unanchored search, per code point.

Java and Python match by backtracking, which can take exponential time, and in Java overflow the stack, where a repeated group
repeats or branches within. Such patterns are matched by RE2 instead, in linear time, where RE2 can express them.
"""

from __future__ import annotations

import re
from functools import lru_cache
from re import _constants as ops
from re import _parser as parser

import pyarrow as pa
import pyarrow.compute as pc

from quern.plans.schema import SchemaError

_SPACE = r"\t\n\x0B\f\r \xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF"
#: what a class escape stands for, inside brackets
_SETS = {"d": "0-9", "w": "A-Za-z0-9_", "s": _SPACE}


def _translate(pattern: str, end: str, to: str) -> str:
    out, i, inside, java = [], 0, False, to == "java"
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            if i + 1 == len(pattern):
                raise SchemaError("pattern ends in a backslash")
            e = pattern[i + 1]
            i += 2
            if e.lower() in _SETS:
                body = _SETS[e.lower()]
                if to == "re2":
                    body = re.sub(r"\\u(....)", r"\\x{\1}", body)
                if e.islower():
                    out.append(body if inside else f"[{body}]")
                elif not inside:
                    out.append(f"[^{body}]")
                else:
                    out.append(f"[^{body}]" if java else "\\" + e)  # RE2 and Python know fewer spaces, but no class within a class
            elif to == "re2" and e == "u" and re.fullmatch("[0-9a-fA-F]{4}", pattern[i : i + 4]):
                out.append(f"\\x{{{pattern[i : i + 4]}}}")
                i += 4
            elif e in "bBtnrfv0123456789xu" or e == "c":
                out.append("\\x0B" if e == "v" else "\\x00" if e == "0" else "\\x08" if e == "b" and inside else "\\" + e)
            else:
                out.append(re.escape(e) if not e.isalnum() else e)
            continue
        if inside:
            if c == "]":
                inside = False
            out.append("\\" + c if c in "[&~|" and c != "]" else c)
        elif c == "[":
            inside = True
            if pattern.startswith("[^]", i):
                out.append("(?s:.)")
                inside, i = False, i + 2
            elif pattern.startswith("[]", i):
                out.append(r"[^\x00-\x{10FFFF}]" if to == "re2" else "(?!)")
                inside, i = False, i + 1
            else:
                out.append("[^" if pattern.startswith("[^", i) else "[")
                i += pattern.startswith("[^", i)
        elif c == "$":
            out.append(end)
        elif c == ".":
            out.append(r"[^\n\r\u2028\u2029]")
        elif pattern.startswith(("(?<=", "(?<!"), i):
            raise SchemaError("patterns have no look-behind")
        elif pattern.startswith("(?<", i) and not java:
            out.append("(?P<")
            i += 2
        else:
            out.append(c)
        i += 1
    if inside:
        raise SchemaError("pattern has an open bracket")
    return "".join(out)


def to_java(pattern: str) -> str:
    to_python(pattern)  # rejects what is not a pattern at all
    return _translate(pattern, r"\z", "java")


def to_python(pattern: str) -> re.Pattern:
    try:
        return re.compile(_translate(pattern, r"\Z", "python"))
    except re.error as e:
        raise SchemaError(f"not a pattern: {pattern}: {e}") from None


def _backtracks(parts: parser.SubPattern, repeated: bool = False) -> bool:
    """Whether an unbounded repetition holds another one, an option or a branch."""
    for op, value in parts:
        if op in (ops.MAX_REPEAT, ops.MIN_REPEAT):
            low, high, inner = value
            if repeated and low != high or _backtracks(inner, repeated or high == ops.MAXREPEAT):
                return True
        elif op is ops.BRANCH:
            if repeated or any(_backtracks(b, repeated) for b in value[1]):
                return True
        elif op is ops.SUBPATTERN and _backtracks(value[3], repeated):
            return True
    return False


class Linear:
    """A pattern matched by RE2."""

    def __init__(self, pattern: str):
        self.pattern = pattern
        self.search("")

    def search(self, text: str) -> bool:
        return pc.match_substring_regex(pa.array([text], pa.string()), self.pattern)[0].as_py()


@lru_cache(maxsize=4096)
def linear(pattern: str) -> Linear | None:
    """The pattern for RE2, if backtracking might be slow and RE2 can express it."""
    if not _backtracks(parser.parse(to_python(pattern).pattern)):
        return None
    try:
        return Linear(_translate(pattern, r"\z", "re2"))
    except pa.ArrowInvalid:  # look-ahead or a back-reference
        return None


def searcher(pattern: str) -> re.Pattern | Linear:
    return linear(pattern) or to_python(pattern)
