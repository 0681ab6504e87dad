"""Blueprints from a corpus that nobody has described: shapes of lines, how common they are, and which follows which.

A shape is what a line's beginning looks like: its indentation, and its mark with numbers as 9, roman
numbers as I and single letters as A or a; words beside a number stay ("Chapter 9", "§ 9.9", "(a)").
A line without a mark is plain. Shapes that stand in enough documents, on few enough and short enough
lines, are levels; one is above another if it comes first in most documents that have both. A
level's parent is the level above it that most often is the last one before it.

Only sums by shape, and by pair of the chosen shapes, leave Spark: `most` levels at most.
"""

from __future__ import annotations

import re

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.numbering import heading_places
from ..operators.outline import headings, outline
from .blueprint import Blueprint, HierarchyRule, ValidationRules

# Patterns in the dialect that Java and RE2 share.
INDENT, BLANKS = "^[ \\t\\x{3000}]*", " \t\u3000"
DIGITS = "[0-9０-９]+"
MARK = "^[^\\p{L}\\p{N}\\s]{0,3}[ ]?(?:(?:\\p{L}{1,12}[ ]?)?[0-9０-９]+(?:[.．-][0-9０-９]+)*[章節条項編部回]?|[IVXLCDM]+[.):\\]]|\\p{L}[.):\\]])?[^\\p{L}\\p{N}\\s]{0,3}"
ROMAN, LOWER, UPPER = "[IVXLCDM]{2,}|[IVX]", "\\p{Ll}", "[A-HJ-Z]"
DEEPEST = 8
#: What a shape's signs stand for in a pattern.
SIGNS = {"9": "[0-9０-９]+", "I": "[IVXLCDM]+", "A": "[A-Z]", "a": "[a-z]"}


def _text(line: Column) -> Column:
    return F.rtrim(F.ltrim(line, F.lit(BLANKS)), F.lit(BLANKS))


def _mark(text: Column) -> Column:
    return F.rtrim(F.regexp_extract(text, MARK, 0))


def _numbered(mark: Column) -> Column:
    """The mark with numbers as 9: with a 9 in it only if it had a number."""
    return F.when(mark != "", F.regexp_replace(mark, DIGITS, "9"))


def _shape(line: Column, text: Column, mark: Column, numbered: Column) -> Column:
    indent = F.least(F.length(line) - F.length(F.ltrim(line, F.lit(BLANKS))), F.lit(DEEPEST))
    signs = F.when(F.contains(numbered, F.lit("9")), numbered).otherwise(F.regexp_replace(F.regexp_replace(F.regexp_replace(mark, ROMAN, "I"), UPPER, "A"), LOWER, "a"))
    return F.when(text == "", None).when(mark == "", "plain").otherwise(F.concat(indent.cast("string"), F.lit(":"), signs))


def shape(line: Column) -> Column:
    """Indentation and mark, as "2:9.9."; "plain" for a line without a mark, null for a blank one."""
    text = _text(line)
    mark = _mark(text)
    return _shape(line, text, mark, _numbered(mark))


def shaped(lines: DataFrame) -> DataFrame:
    """doc_id, line_number, shape, n (the line's length) of each line. Steps are columns of their own, so that each pattern runs once a line."""
    c = F.col
    s = lines.select("doc_id", "line_number", "line", _text(c("line")).alias("_text"))
    s = s.withColumn("_mark", _mark(c("_text")))
    s = s.withColumn("_numbered", _numbered(c("_mark")))
    return s.select("doc_id", "line_number", _shape(c("line"), c("_text"), c("_mark"), c("_numbered")).alias("shape"), F.length("line").alias("n"))


def pattern_of(shape_: str) -> str:
    """A pattern for lines of a shape."""
    indent, signs = shape_.split(":", 1)
    numbered = "9" in signs
    body = "".join(SIGNS["9"] if c == "9" and numbered else SIGNS[c] if c in SIGNS and not numbered else re.escape(c) for c in signs)
    return f"^{'[ \\t　]'}{{{indent}{',' if int(indent) == DEEPEST else ''}}}{body}(?![0-9０-９.．-]*[0-9０-９]).*" if numbered else f"^[ \\t　]{{{indent}{',' if int(indent) == DEEPEST else ''}}}{body}.*"


def shape_stats(lines: DataFrame) -> DataFrame:
    """shape, n_lines, n_docs, n_long (lines over 100 characters), longest: summed by document first."""
    return _stats(shaped(lines.where(_text(F.col("line")) != "")))


def _stats(s: DataFrame) -> DataFrame:
    own = s.groupBy("doc_id", "shape").agg(F.count("*").alias("n_lines"), F.count_if(F.col("n") > 100).alias("n_long"), F.max("n").alias("longest"))
    return own.groupBy("shape").agg(F.sum("n_lines").alias("n_lines"), F.count("doc_id").alias("n_docs"), F.sum("n_long").alias("n_long"), F.max("longest").alias("longest"))


def shape_pairs(lines: DataFrame, shapes: list[str]) -> DataFrame:
    """above, below, n_first (documents in which the first line of shape `above` is before that of `below`), n_after (lines of `below` whose last line before, of these shapes but its own, is of `above`)."""
    return _pairs(shaped(lines), shapes)


def _pairs(s: DataFrame, shapes: list[str]) -> DataFrame:
    s = s.select("doc_id", "line_number", "shape").where(F.col("shape").isin(shapes))
    own = s.groupBy("doc_id", "shape").agg(F.min("line_number").alias("_first"))  # a row a document and chosen shape
    seen = F.collect_list("shape").over(Window.partitionBy("doc_id").orderBy("_first").rowsBetween(Window.unboundedPreceding, -1))
    firsts = own.select("shape", seen.alias("_seen")).select(F.explode("_seen").alias("above"), F.col("shape").alias("below")).groupBy("above", "below").agg(F.count("*").alias("n_first"))
    # Where a run of lines of one shape begins, the line before is the end of the run before.
    was = F.lag("shape").over(Window.partitionBy("doc_id").orderBy("line_number"))
    afters = s.select("shape", was.alias("_was")).where("_was <> shape").groupBy(F.col("_was").alias("above"), F.col("shape").alias("below")).agg(F.count("*").alias("n_after"))
    both = firsts.join(afters, ["above", "below"], "full")
    return both.select("above", "below", F.coalesce("n_first", F.lit(0)).alias("n_first"), F.coalesce("n_after", F.lit(0)).alias("n_after"))


def _ordered(shapes: list[str], wins) -> list[str]:
    """Outermost first: by the number of others that a shape comes before, then by how clearly."""
    beats = {a: sum(wins(a, b) > wins(b, a) for b in shapes if b != a) for a in shapes}
    clear = {a: sum(wins(a, b) - wins(b, a) for b in shapes if b != a) for a in shapes}
    return sorted(shapes, key=lambda a: (-beats[a], -clear[a], a))


def discover(lines: DataFrame, support: float = 0.2, most_lines: float = 0.5, most_long: float = 0.1, most: int = 8) -> Blueprint:
    """A blueprint of shapes that stand in a share of `support` of the documents, on at most `most_lines` of the lines, of which at most `most_long` are over 100 characters: the `most` widest spread ones."""
    # Shapes are found once, and stay on the executors' disks until the sums are taken.
    s = shaped(lines).persist(StorageLevel.DISK_ONLY)
    try:
        sums = s.agg(F.count_distinct("doc_id").alias("docs"), F.count("*").alias("lines")).first()
        stats = _stats(s.where("shape <> 'plain'")).where((F.col("n_docs") >= support * sums.docs) & (F.col("n_lines") <= most_lines * sums.lines) & (F.col("n_long") <= most_long * F.col("n_lines")))
        rows = stats.orderBy(F.desc("n_docs"), "shape").limit(most).collect()
        shapes = [r.shape for r in rows]
        longest = {r.shape: r.longest for r in rows}
        pairs = {(r.above, r.below): r for r in _pairs(s, shapes).collect()} if shapes else {}
    finally:
        s.unpersist()
    wins = lambda a, b: pairs[a, b].n_first if (a, b) in pairs else 0
    after = lambda a, b: pairs[a, b].n_after if (a, b) in pairs else 0
    ordered, level, rules = _ordered(shapes, wins), {}, []
    for i, s in enumerate(ordered):
        above = [a for a in ordered[:i] if after(a, s)]
        # Shapes that follow a level as directly as this one does, and it them, are its siblings.
        parent = max(above, key=lambda a: (after(a, s), -level[a]), default=None)
        level[s] = level[parent] + 1 if parent else 1
        rules.append(HierarchyRule(level[s], s, pattern_of(s), parent_level=level[parent] if parent else None, validation_rules=ValidationRules(max_length=max(100, longest[s]))))
    return Blueprint(sorted(rules, key=lambda r: r.level))


def review(lines: DataFrame, bp: Blueprint) -> DataFrame:
    """level, name and what the documents say of each rule: n_headings, n_docs, n_collisions (headings that other rules take as well), n_orphans, n_numbers and n_out_of_place (headings outside the longest rising run of their siblings' numbers)."""
    placed = outline(headings(lines, bp), bp).withColumn("collides", F.size("hit_levels") > 1)
    j = heading_places(placed, ["doc_id", "level", "name", "collides", "orphan"])
    # By document first, so that documents are counted without being brought together.
    own = j.groupBy("doc_id", "level", "name").agg(F.count("*").alias("n"), F.count_if("collides").alias("c"), F.count_if("orphan").alias("o"), F.count("in_place").alias("m"), F.count_if(~F.col("in_place")).alias("w"))
    return own.groupBy("level", "name").agg(F.sum("n").alias("n_headings"), F.count("doc_id").alias("n_docs"), F.sum("c").alias("n_collisions"), F.sum("o").alias("n_orphans"), F.sum("m").alias("n_numbers"), F.sum("w").alias("n_out_of_place"))


def refine(lines: DataFrame, bp: Blueprint, most_collisions: float = 0.2, most_out_of_place: float = 0.2) -> Blueprint:
    """The blueprint without rules that find nothing, of whose headings more than these shares collide with other rules or are out of place; rules below one that goes hang on its parent, and levels close up."""
    if not bp.hierarchy_structure:
        return bp
    found = {(r.level, r.name): r for r in review(lines, bp).collect()}  # a row a rule

    def stays(rule: HierarchyRule) -> bool:
        r = found.get((rule.level, rule.name))
        return r is not None and r.n_collisions <= most_collisions * r.n_headings and r.n_out_of_place <= most_out_of_place * max(1, r.n_numbers)

    kept = [r for r in bp.hierarchy_structure if stays(r)]
    levels = {old: new for new, old in enumerate(sorted({r.level for r in kept}), 1)}
    parent = {r.level: r.parent_level for r in bp.hierarchy_structure}

    def above(level: int | None) -> int | None:
        while level is not None and level not in levels:
            level = parent.get(level)
        return None if level is None else levels[level]

    rules = [HierarchyRule(levels[r.level], r.name, r.regex, above(r.parent_level), r.description, r.validation_rules) for r in kept]
    return Blueprint(rules, bp.global_exclusion_rules)
