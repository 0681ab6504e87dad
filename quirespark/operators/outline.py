"""Headings by a blueprint, their parents, places among siblings, paths, and the sections' text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import search
from ..functions.dialect import pattern
from ..functions.text import SPACE
from ..plans.blueprint import Blueprint, HierarchyRule
from .context import CONTEXTS, Context, neighbours


def _found(rule: HierarchyRule) -> Column:
    """What the rule's pattern finds in the line."""
    return search.first(F.col("line"), pattern(rule.regex), at_start=bool(rule.validation_rules is not None and rule.validation_rules.requires_line_start))


def _holds(rule: HierarchyRule, heading: Column, previous: Column, contexts: dict[str, Context]) -> Column:
    """Whether the line is a heading by this rule, whose pattern finds `heading`."""
    v, line = rule.validation_rules, F.col("line")
    tests = [heading.isNotNull()]
    if v is not None:
        if v.max_length is not None:
            tests.append(F.length(heading) <= v.max_length)
        if v.requires_prev_empty_line:
            tests.append(previous.isNull() | F.rlike(previous, F.lit(f"\\A{SPACE}*\\z")))
        tests += [F.contains(heading, F.lit(x)) for x in v.must_contain or []]
        tests += [~F.contains(heading, F.lit(x)) for x in v.must_not_contain or []]
        tests += [~F.endswith(line, F.lit(x)) for x in v.must_not_end_with or []]
        tests += [F.coalesce(contexts[n].test(lambda k: F.col(f"_at{k}") if k else line), F.lit(False)) for n in v.context_filters or [] if n in contexts]
    return reduce(lambda a, b: a & b, tests)


def excluded(bp: Blueprint) -> Column:
    """Whether a line falls under an exclusion rule."""
    found = [search.holds(F.col("line"), pattern(r.regex)) for r in (bp.global_exclusion_rules or {}).values()]
    return reduce(lambda a, b: a | b, found, F.lit(False))


def _taken(lines: DataFrame, bp: Blueprint, contexts: dict[str, Context]) -> DataFrame:
    """lines less excluded ones, with _heading0, _heading1 and so on: what each rule takes for a heading, or null. Steps are columns of their own, so that each pattern runs once a line."""
    previous = F.col("_previous")
    needs = any(r.validation_rules and r.validation_rules.requires_prev_empty_line for r in bp.hierarchy_structure)
    if needs:
        lines = lines.withColumn("_previous", F.lag("line").over(Window.partitionBy("doc_id").orderBy("line_number")))
    filters = [n for r in bp.hierarchy_structure if r.validation_rules for n in r.validation_rules.context_filters or []]
    around = neighbours([n for n in filters if n in contexts], contexts)
    lines = lines.withColumns({f"_at{k}": c for k, c in around.items()}) if around else lines
    rules = list(enumerate(bp.hierarchy_structure))
    lines = lines.where(~excluded(bp))
    lines = lines.withColumns({f"_found{i}": _found(r) for i, r in rules}) if rules else lines
    lines = lines.withColumns({f"_heading{i}": F.when(_holds(r, F.col(f"_found{i}"), previous, contexts), F.col(f"_found{i}")) for i, r in rules}) if rules else lines
    return lines.drop("_previous", *[f"_at{k}" for k in around], *[f"_found{i}" for i, _ in rules])


def _unevaluated(rule: HierarchyRule, contexts: dict[str, Context]) -> Column:
    v = rule.validation_rules
    return F.array(*[F.lit(x) for x in (v.context_filters if v else None) or [] if x not in contexts]).cast("array<string>")


def _in_order(bp: Blueprint) -> list[tuple[int, HierarchyRule]]:
    """Rules with their places in the blueprint, lowest level first."""
    return sorted(enumerate(bp.hierarchy_structure), key=lambda r: (r[1].level, r[0]))


def classify(lines: DataFrame, bp: Blueprint, contexts: dict[str, Context] = CONTEXTS) -> DataFrame:
    """lines less excluded ones, with hits: (level, place in the blueprint, name, heading, unevaluated filters) of each rule that holds, lowest level first. The line before is the raw one; a document's first line counts as after an empty one. contexts: the context filters that can be tested; others are carried along."""
    found = []
    for i, r in _in_order(bp):
        heading = F.col(f"_heading{i}")
        found.append(F.when(heading.isNotNull(), F.struct(F.lit(r.level).alias("level"), F.lit(i).alias("place"), F.lit(r.name).alias("name"), heading.alias("heading"), _unevaluated(r, contexts).alias("unevaluated_filters"))))
    return _taken(lines, bp, contexts).withColumn("hits", F.array_compact(F.array(*found))).drop(*[f"_heading{i}" for i, _ in _in_order(bp)])


def headings(lines: DataFrame, bp: Blueprint, contexts: dict[str, Context] = CONTEXTS) -> DataFrame:
    """doc_id, line_number, level, name, heading, hit_levels, unevaluated_filters: a line with several hits has the lowest level, the first rule on ties."""
    rules = _in_order(bp)
    hit = lambda i: F.col(f"_heading{i}").isNotNull()
    by = lambda value: reduce(lambda rest, r: F.when(hit(r[0]), value(*r)).otherwise(rest), reversed(rules), F.lit(None))
    # Lines without a hit go by a generator, as a filter would run the patterns once more.
    some = reduce(lambda a, b: a | b, [hit(i) for i, _ in rules], F.lit(False))
    c = _taken(lines, bp, contexts).select("doc_id", "line_number", *[f"_heading{i}" for i, _ in rules], F.explode(F.when(some, F.array(F.lit(True)))))
    levels = F.array_compact(F.array(*[F.when(hit(i), F.lit(r.level)) for i, r in rules]).cast("array<int>"))
    return c.select("doc_id", "line_number", by(lambda i, r: F.lit(r.level)).cast("int").alias("level"), by(lambda i, r: F.lit(r.name)).cast("string").alias("name"), by(lambda i, r: F.col(f"_heading{i}")).cast("string").alias("heading"), levels.alias("hit_levels"), by(lambda i, r: _unevaluated(r, contexts)).cast("array<string>").alias("unevaluated_filters"))


def outline(found: DataFrame, bp: Blueprint) -> DataFrame:
    """headings with parent_line (0: the root), orphan, ordinal (from 0) and path.

    The parent is the last heading of the rule's parent level; where a heading of a level above that
    one came later, or no heading of the parent level came, it is the latest of those above (or the
    root) and the heading is an orphan. A parent level has to be below the rule's own level.
    """
    parent_of: dict[int, int | None] = {}
    for r in bp.hierarchy_structure:
        if r.parent_level is not None and r.parent_level >= r.level:
            raise ValueError(f"{r.name}: parent level {r.parent_level} is not above level {r.level}")
        parent_of.setdefault(r.level, r.parent_level)
    before = Window.partitionBy("doc_id").orderBy("line_number").rowsBetween(Window.unboundedPreceding, -1)
    last = lambda test: F.coalesce(F.last(F.when(test, F.col("line_number")), ignorenulls=True).over(before), F.lit(0))
    parent, orphan = F.lit(0), F.lit(False)
    for level, p in parent_of.items():
        if p is not None:
            own, above = last(F.col("level") == p), last(F.col("level") < p)
            parent = F.when(F.col("level") == level, F.greatest(own, above)).otherwise(parent)
            orphan = F.when(F.col("level") == level, (own == 0) | (above > own)).otherwise(orphan)
    placed = found.withColumns({"parent_line": parent, "orphan": orphan})
    siblings = Window.partitionBy("doc_id", "parent_line").orderBy("line_number")
    # The parent is the last heading before of the parent level or above it. Level by level its path is at hand: the windows are alike, so headings are dealt out once.
    out = placed.withColumn("ordinal", F.row_number().over(siblings) - 1).withColumn("path", F.when(F.lit(False), F.array(F.lit(0))))
    for level in sorted(parent_of):
        p = parent_of[level]
        up = F.array().cast("array<int>") if p is None else F.coalesce(F.last(F.when(F.col("level") <= p, F.col("path")), ignorenulls=True).over(before), F.array().cast("array<int>"))
        out = out.withColumn("path", F.when(F.col("level") == level, F.array_append(up, F.col("ordinal"))).otherwise(F.col("path")))
    return out


def sections(lines: DataFrame, placed: DataFrame, summary: int = 200) -> DataFrame:
    """placed with end_line, body (lines up to the next heading, joined by newlines) and content_summary: the body's first characters."""
    heads = placed.select("doc_id", "line_number", F.struct(*placed.columns).alias("_head"))
    up_to = Window.partitionBy("doc_id").orderBy("line_number").rowsBetween(Window.unboundedPreceding, 0)
    marked = lines.join(heads, ["doc_id", "line_number"], "left")
    marked = marked.withColumn("_section", F.last(F.when(F.col("_head").isNotNull(), F.col("line_number")), ignorenulls=True).over(up_to)).where(F.col("_section").isNotNull())
    text = F.when(F.col("_head").isNull(), F.struct("line_number", "line"))
    body = F.array_join(F.transform(F.sort_array(F.collect_list(text)), lambda x: x["line"]), "\n")
    one = marked.groupBy("doc_id", "_section").agg(F.first("_head", ignorenulls=True).alias("_head"), F.max("line_number").alias("end_line"), body.alias("body"))
    return one.select("_head.*", "end_line", "body").withColumn("content_summary", F.substring("body", 1, summary))
