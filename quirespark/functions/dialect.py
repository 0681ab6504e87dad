"""Python regular expressions as Java ones, as far as Spark's built-in functions can run them."""

from __future__ import annotations

import re
from dataclasses import dataclass
from re import _parser

from py4j.protocol import Py4JJavaError
from pyspark import SparkContext
from pyspark.errors import IllegalArgumentException


@dataclass(frozen=True)
class Pattern:
    """source: as given; java: for Spark's functions; groups: number of groups; exact: Java can't express it, so Python has to run it; least: characters that every match has."""

    source: str
    java: str
    groups: int
    exact: bool
    least: int = 0


#: Escapes that mean something else in Java; fixed values.
ESCAPES = {"\\Z": "\\z", "\\v": "\\x0B"}
#: A character by its octal number, which Java writes otherwise.
OCTAL = re.compile(r"\\(0[0-7]{0,2}|[1-3][0-7]{2})")
QUANTIFIER = re.compile(r"\{(\d*)(,?)(\d*)\}")
#: Openings that only Python has: conditionals, and flags that change other rules.
ONLY_PYTHON = re.compile(r"\(\?\(|\(\?[a-zA-Z]*[aLx]|\\N\{|\\U")


def _in_class(pattern: str, at: int) -> tuple[str, int]:
    """A bracket expression from pattern[at] on, with brackets and & escaped; where it ends."""
    end, out = at + 1, "["
    if pattern[end] == "^":
        out, end = out + "^", end + 1
    first = True
    while first or pattern[end] != "]":
        c, first = pattern[end], False
        if c == "\\":
            if m := OCTAL.match(pattern, end):
                out, end = out + f"\\x{{{int(m[1], 8):x}}}", m.end()
                continue
            two = pattern[end : end + 2]
            out += "\\x08" if two == "\\b" else ESCAPES.get(two, two)
            end += 2
            continue
        out += "\\" + c if c in "[]&" else c
        end += 1
    return out + "]", end + 1


def pattern(source: str) -> Pattern:
    """Checks and translates; ValueError for what Python rejects. Classes are Unicode ones, and only a newline ends a line."""
    try:
        groups = re.compile(source).groups
    except re.error as e:
        raise ValueError(f"Invalid regex pattern: {e}") from e
    out, at = "", 0
    while at < len(source):
        rest = source[at:]
        if m := OCTAL.match(source, at):
            out += f"\\x{{{int(m[1], 8):x}}}"
            at = m.end()
        elif rest[0] == "\\":
            out += ESCAPES.get(rest[:2], rest[:2])
            at += 2
        elif rest[0] == "[":
            part, at = _in_class(source, at)
            out += part
        elif rest.startswith("(?P<"):
            name, at = rest[4 : rest.index(">")], at + rest.index(">") + 1
            out += f"(?<{_name(name)}>"
        elif rest.startswith("(?P="):
            name, at = rest[4 : rest.index(")")], at + rest.index(")") + 1
            out += f"\\k<{_name(name)}>"
        elif rest.startswith("(?#"):
            at += rest.index(")") + 1
        elif rest[0] == "{":
            m = QUANTIFIER.match(rest)
            if m and (m[1] or m[2]) and out:
                out += f"{{{m[1] or 0}{m[2]}{m[3]}}}"
                at += m.end()
            else:  # no quantifier: the brace itself
                out += "\\{"
                at += 1
        else:
            out += rest[0]
            at += 1
    java = "(?Ud)" + out
    return Pattern(source, java, groups, bool(ONLY_PYTHON.search(source)) or not _java_takes(java), _parser.parse(source).getwidth()[0])


def _java_takes(java: str) -> bool:
    """Whether Java compiles the translation; what it refuses is left to Python. Without a running Spark there is nobody to ask."""
    sc = SparkContext._active_spark_context
    if sc is None or sc._jvm is None:
        return True
    try:
        sc._jvm.java.util.regex.Pattern.compile(java)
    except (Py4JJavaError, IllegalArgumentException):
        return False
    return True


def _name(name: str) -> str:
    """Java's group names have letters and digits only."""
    return "".join(c if c.isascii() and c.isalnum() else f"x{ord(c):x}x" for c in "g" + name)


def patterns(given: list[str]) -> list[Pattern]:
    """Blank ones are left out, and numbers go by what is left."""
    return [pattern(p) for p in given if p and p.strip()]
