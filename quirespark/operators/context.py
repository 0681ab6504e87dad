"""Named tests on the lines around a heading, for the context filters of a blueprint.

A test says how many lines it looks back and ahead, and makes a column from the lines at places
relative to the heading (null beyond the document). All tests of a blueprint are read from one window,
so that lines are dealt out once, by document; neighbours are raw lines, before exclusions.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import SPACE


@dataclass(frozen=True)
class Context:
    """before, after: how many lines the test looks at; test: from a function of a place (-1: the line before, 0: the line itself) to a boolean column."""

    before: int
    after: int
    test: Callable[[Callable[[int], Column]], Column]


def blank(line: Column) -> Column:
    return F.rlike(line, F.lit(f"\\A{SPACE}*\\z"))


def _edge_or(line: Column, test: Column) -> Column:
    """A place beyond the document counts as satisfied."""
    return line.isNull() | test


LIST = "^[ \\t\\x{3000}]*(?:[-*•・]|[(（]?[0-9０-９a-zA-Z]{1,3}[.)）])[ \\t\\x{3000}]"

#: Filters by name; callers add their own.
CONTEXTS = {
    "followed by an indented line": Context(0, 1, lambda at: F.rlike(at(1), F.lit("^[ \\t\\x{3000}]+[^ \\t\\x{3000}]"))),
    "followed by a list": Context(0, 1, lambda at: F.rlike(at(1), F.lit(LIST))),
    "followed by an empty line": Context(0, 1, lambda at: _edge_or(at(1), blank(at(1)))),
    "between empty lines": Context(1, 1, lambda at: _edge_or(at(-1), blank(at(-1))) & _edge_or(at(1), blank(at(1)))),
    "followed by a longer line": Context(0, 1, lambda at: F.length(at(1)) > F.length(at(0))),
}


def neighbours(names: list[str], known: dict[str, Context]) -> dict[int, Column]:
    """The lines around each line that these tests look at, as columns over one window, by place."""
    used = [known[n] for n in names]
    w = Window.partitionBy("doc_id").orderBy("line_number")
    places = [k for k in range(-max((c.before for c in used), default=0), max((c.after for c in used), default=0) + 1) if k]
    return {k: F.lag("line", -k).over(w) if k < 0 else F.lead("line", k).over(w) for k in places}
