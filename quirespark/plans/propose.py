"""Blueprints from a corpus: statistics of families of heading patterns, and a proposer that may be replaced."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from ..operators.audit import pattern_stats
from .blueprint import Blueprint, HierarchyRule, ValidationRules

#: Families of headings with their place in a hierarchy, outermost first.
FAMILIES = [
    ("markdown 1", "^# .+"), ("markdown 2", "^## .+"), ("markdown 3", "^### .+"), ("chapter", "^第[0-9０-９一二三四五六七八九十]+章.*"), ("Chapter", "^Chapter [0-9IVXLC]+.*"),
    ("1.", "^[0-9]+\\. .+"), ("1.1", "^[0-9]+\\.[0-9]+\\.? .+"), ("1.1.1", "^[0-9]+\\.[0-9]+\\.[0-9]+\\.? .+"), ("bracket", "^【[^】]+】.*"), ("(1)", "^\\([0-9]+\\).*"), ("[A]", "^\\[[A-Z]\\].*"), ("square", "^■.*"),
]


def propose(lines: DataFrame, least: int = 2, choose: Callable[[list], list[str]] | None = None, max_length: int = 100) -> Blueprint:
    """Levels from the families with at least `least` lines, in the families' order; choose: picks names from the statistics instead (a person, a model)."""
    stats = pattern_stats(lines, [p for _, p in FAMILIES]).collect()  # a row a family at most
    n = {r.pattern_index: r.n_lines for r in stats}
    names = choose(stats) if choose else [name for k, (name, _) in enumerate(FAMILIES) if n.get(k, 0) >= least]
    rules = [HierarchyRule(i + 1, name, dict(FAMILIES)[name], i or None, None, ValidationRules(max_length=max_length)) for i, name in enumerate(names)]
    return Blueprint(rules)
