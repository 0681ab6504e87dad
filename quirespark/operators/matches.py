"""All matches of many patterns in the lines of a corpus: table, counts, pages, payloads and a sink.

The order of matches is (document, line, pattern, place in the line). A document is the unit of
offsets, limits and payloads, so that windows stay within a document; `everywhere` pages over all.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import search
from ..functions.dialect import Pattern, patterns
from ..sources.text import lines as lines_of

ORDER = ["doc_id", "line_number", "pattern_index", "match_ord"]
MATCH = "array<struct<pattern_index:int,pattern:string,match_ord:int,full_match:string,groups:array<string>>>"


def _built_in(line: Column, no: int, p: Pattern) -> Column:
    """Matches of one pattern by Spark's functions; a group that takes no part is empty."""
    found = [F.regexp_extract_all(line, F.lit(p.java), F.lit(k)).alias(f"g{k}") for k in range(p.groups + 1)]

    def row(z, i):
        groups = F.array(*[z[f"g{k}"] for k in range(1, p.groups + 1)]) if p.groups else F.array(z["g0"])
        return F.struct(F.lit(no).alias("pattern_index"), F.lit(p.source).alias("pattern"), i.alias("match_ord"), z["g0"].alias("full_match"), groups.alias("groups"))

    return F.when(F.rlike(line, F.lit(p.java)), F.transform(F.arrays_zip(*found), row)).otherwise(F.array().cast(MATCH))


def _by_python(no: int, source: str):
    """The same by Python in Arrow batches; a group that takes no part is null."""

    @F.pandas_udf(MATCH)
    def run(line: pd.Series) -> pd.Series:
        find = re.compile(source)
        return line.map(lambda s: [{"pattern_index": no, "pattern": source, "match_ord": i, "full_match": m[0], "groups": list(m.groups()) if find.groups else [m[0]]} for i, m in enumerate(find.finditer(s))] if s is not None else [])

    return run


def match_table(lines: DataFrame, given: list[str], exact: bool = False, line_text: bool = True) -> DataFrame:
    """lines (doc_id, line_number, line) with a row a match: pattern_index, pattern, match_ord, full_match, groups (the whole match for a pattern without groups).

    exact: Python's rules in all corners, null groups above all; without it only patterns that Java can't express go to Python.
    """
    ps = patterns(given)
    if not ps:
        raise ValueError("no pattern is left")
    found = [_by_python(k, p.source)(F.col("line")) if exact or p.exact else _built_in(F.col("line"), k, p) for k, p in enumerate(ps)]
    rows = lines.select("doc_id", "line_number", "line", F.explode(F.concat(*found) if len(found) > 1 else found[0]).alias("m")).select("doc_id", "line_number", "m.*", "line")
    return rows if line_text else rows.drop("line")


def match_counts(lines: DataFrame, given: list[str], by: tuple[str, ...] = ()) -> DataFrame:
    """by, pattern_index, pattern, n_matches, n_lines: one pass in which each pattern's sums are columns, and no match or line becomes a row."""
    ps = patterns(given)
    counts = lines.select(*by, *[search.count(F.col("line"), p).alias(f"n{k}") for k, p in enumerate(ps)])
    sums = counts.groupBy(*by).agg(*[f for k in range(len(ps)) for f in (F.coalesce(F.sum(f"n{k}"), F.lit(0)).alias(f"m{k}"), F.count_if(F.col(f"n{k}") > 0).alias(f"l{k}"))])
    each = F.array(*[F.struct(F.lit(k).alias("pattern_index"), F.lit(p.source).alias("pattern"), F.col(f"m{k}").alias("n_matches"), F.col(f"l{k}").alias("n_lines")) for k, p in enumerate(ps)])
    return sums.select(*by, F.explode(each).alias("m")).select(*by, "m.*")


#: An offset up to which the first rows are found by a top-k over all partitions, and documents among which a place is looked for in one window.
TOP = 10_000


def _place(matches: DataFrame, left: int, few: int):
    """The document in which the match number `left` (from 0) stands, and its number there; None past the end. Counts by document are made once; ranges of documents are narrowed until one has a few."""
    counts = matches.groupBy("doc_id").agg(F.count("*").alias("n")).persist()
    try:
        none = counts.where("doc_id is null").first()  # null ids come first
        if none is not None and left < none.n:
            return None, left
        left -= none.n if none else 0
        some = counts.where("doc_id is not null")
        while True:
            rows = some.limit(few + 1).collect()
            if len(rows) <= few:
                for r in sorted(rows, key=lambda r: r.doc_id):
                    if left < r.n:
                        return r.doc_id, left
                    left -= r.n
                return None
            ranges = some.repartitionByRange("doc_id").groupBy(F.spark_partition_id().alias("p")).agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.sum("n").alias("n"), F.count("*").alias("docs")).collect()  # a row a partition
            if len(ranges) == 1:  # no two ranges could be told apart: all of them, by number of documents
                ranges = some.repartitionByRange(64, "doc_id").groupBy(F.spark_partition_id().alias("p")).agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.sum("n").alias("n"), F.count("*").alias("docs")).collect()
            for r in sorted(ranges, key=lambda r: r.low):
                if left < r.n:
                    some = some.where(F.col("doc_id").between(r.low, r.high))
                    break
                left -= r.n
            else:
                return None
    finally:
        counts.unpersist()


def after(matches: DataFrame, offset: int, top: int = TOP) -> DataFrame:
    """Matches of all documents without the first `offset`. No rows are brought together: the place where the rest begins is found first, for an offset over `top` by counts by document and range of documents."""
    if offset <= 0:
        return matches
    if offset <= top:
        at = matches.orderBy(*ORDER).offset(offset).limit(1).first()
    else:
        place = _place(matches, offset, top)
        at = matches.where(F.col("doc_id").eqNullSafe(F.lit(place[0]))).orderBy(*ORDER).offset(place[1]).limit(1).first() if place else None
    if at is None:
        return matches.limit(0)
    rest = F.struct(*ORDER[1:]) >= F.struct(*[F.lit(at[c]).cast(dict(matches.dtypes)[c]).alias(c) for c in ORDER[1:]])
    later = F.col("doc_id").isNotNull() if at.doc_id is None else F.col("doc_id") > F.lit(at.doc_id)
    return matches.where(later | (F.col("doc_id").eqNullSafe(F.lit(at.doc_id)) & rest))


#: Equal matches of a line and pattern.
ONCE = ["doc_id", "line_number", "pattern_index", "full_match", "groups"]


def match_page(matches: DataFrame, offset: int = 0, limit: int = 50, dedupe: bool = False, everywhere: bool = False) -> DataFrame:
    """Matches after the first `offset`, `limit` at most, of each document or of all together. dedupe: equal matches of a line and pattern count once, after the offset."""
    offset, limit = max(0, offset), max(0, limit)
    first = F.row_number().over(Window.partitionBy(*ONCE).orderBy("match_ord"))
    if everywhere:
        rest = after(matches, offset)
        if dedupe:
            rest = rest.withColumn("_again", first).where("_again = 1").drop("_again")
        return rest.orderBy(*ORDER).limit(limit)
    line = Window.partitionBy("doc_id").orderBy(*ORDER[1:])
    rest = matches.withColumn("_at", F.row_number().over(line)).where(F.col("_at") > offset).drop("_at")
    if dedupe:
        rest = rest.withColumn("_again", first).where("_again = 1").drop("_again")
    return rest.withColumn("_at", F.row_number().over(line)).where(F.col("_at") <= limit).drop("_at")


def match_payload(matches: DataFrame, offset: int = 0, limit: int = 50, dedupe: bool = False, count_only: bool = False, docs: DataFrame | None = None) -> DataFrame:
    """A row a document with matches: total_matches, matches_after_offset, returned_matches, truncated, sample (`limit` matches at most, in order). docs: its documents (doc_id) without matches have a row as well. One exchange, by document."""
    offset, limit = max(0, offset), max(0, limit)
    fields = ["line_number", "pattern_index", "match_ord", *[c for c in matches.columns if c not in ORDER]]
    m = matches
    sample = F.array().cast(f"array<struct<{', '.join(f'{c}:{k}' for c, k in m.select(*fields).dtypes)}>>")
    if not count_only and limit:
        line = Window.partitionBy("doc_id").orderBy(*ORDER[1:])
        m = m.withColumn("_rest", F.row_number().over(line) > offset)
        if dedupe:
            m = m.withColumn("_rest", F.col("_rest") & (F.row_number().over(Window.partitionBy(*ONCE, "_rest").orderBy("match_ord")) == 1))
        m = m.withColumn("_no", F.count_if("_rest").over(line.rowsBetween(Window.unboundedPreceding, 0)))
        sample = F.sort_array(F.collect_list(F.when(F.col("_rest") & (F.col("_no") <= limit), F.struct(*fields))))
    out = m.groupBy("doc_id").agg(F.count("*").alias("total_matches"), sample.alias("sample"))
    if docs is not None:
        out = docs.select("doc_id").distinct().join(out, "doc_id", "left").withColumns({"total_matches": F.coalesce("total_matches", F.lit(0)), "sample": F.coalesce("sample", F.array().cast(out.schema["sample"].dataType))})
    after_offset, n = F.greatest(F.col("total_matches") - offset, F.lit(0)).cast("long"), F.size("sample").cast("long")
    return out.select("doc_id", "total_matches", after_offset.alias("matches_after_offset"), n.alias("returned_matches"), (F.lit(not count_only) & (after_offset > n)).alias("truncated"), "sample")


def _quoted(value: Column) -> Column:
    """JSON text of a string, null too."""
    said = F.to_json(F.array(value), {"ignoreNullFields": "false"})
    return F.substring(said, F.lit(2), F.length(said) - 2)


def result_json(payload: DataFrame, given: list[str], offset: int = 0, budget: int = 8000, count_only: bool = False, dedupe: bool = False, line_text: bool = True, saved_to: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, returned_matches, truncated and json: each document's payload as JSON text, in the form of `regex_result`. The sample is its longest beginning with which the text has at most `budget` characters, found by running sums of the encoded lengths; where none fits, it is empty and the hint says so."""
    ps, offset = patterns(given), max(0, offset)
    groups = F.array(*[F.lit(p.groups) for p in ps])

    def record(m: Column) -> Column:
        n = F.element_at(groups, m["pattern_index"] + 1)
        many = F.concat(F.lit("["), F.array_join(F.transform(m["groups"], _quoted), ", "), F.lit("]"))
        parts = [F.lit('{"pattern_index": '), m["pattern_index"].cast("string"), F.lit(', "pattern": '), _quoted(m["pattern"]), F.lit(', "line_number": '), m["line_number"].cast("string"), F.lit(', "match": '), F.when(n > 1, many).otherwise(_quoted(F.get(m["groups"], F.lit(0)))), F.lit(', "full_match": '), _quoted(m["full_match"])]
        return F.concat(*parts, *([F.lit(', "line": '), _quoted(m["line"])] if line_text else []), F.lit("}"))

    said = lambda x: json.dumps(x, ensure_ascii=False)
    number = lambda c: F.col(c).cast("string")
    yes = lambda c: F.when(c, "true").otherwise("false")
    head = F.concat(F.lit('{"ok": true, "file_path": '), _quoted(F.col("doc_id").cast("string")), F.lit(f', "regex_pattern": {said(given[0] if pattern is None else pattern)}, "regex_patterns": {said([p.source for p in ps])}, "total_matches": '), number("total_matches"), F.lit(f', "offset_matches": {offset}, "matches_after_offset": '), number("matches_after_offset"), F.lit(', "returned_matches": '))
    tail = F.lit(f', "count_only": {said(count_only)}, "dedupe": {said(dedupe)}, "saved_to": {said(saved_to)}, "include_line_text": {said(line_text)}, "sample": [')
    hint, none = (f'], "hint": {said(h)}}}' for h in (HINT, NO_ROOM))
    cut = lambda k: F.lit(not count_only) & (F.col("matches_after_offset") > k)
    p = payload.select("doc_id", "matches_after_offset", F.transform("sample", record).alias("_records"), head.alias("_head"))
    fixed = F.length("_head") + len(', "truncated": ') + F.length(tail) + len(hint)
    fits = lambda k, n: fixed + F.length(k.cast("string")) + F.length(yes(cut(k))) + n <= budget
    none_yet = F.struct(F.lit(0).alias("k"), F.lit(0).alias("n"), F.when(fits(F.lit(0), F.lit(0)), 0).otherwise(-1).alias("best"))

    def step(a, x):
        k, n = a["k"] + 1, a["n"] + F.length(x) + F.when(a["k"] > 0, 2).otherwise(0)
        return F.struct(k.alias("k"), n.alias("n"), F.when(fits(k, n), k).otherwise(a["best"]).alias("best"))

    k = F.aggregate("_records", none_yet, step)["best"] if not count_only else F.lit(0)
    p = p.withColumn("_k", k.cast("int")).withColumn("returned_matches", F.greatest("_k", F.lit(0)).cast("long"))
    short = (F.col("_k") < 0) | cut(F.col("returned_matches"))
    text = F.concat("_head", number("returned_matches"), F.lit(', "truncated": '), yes(short), tail, F.array_join(F.slice("_records", F.lit(1), F.greatest("_k", F.lit(0))), ", "), F.when(F.col("_k") < 0, none).otherwise(hint))
    return p.select("doc_id", "returned_matches", short.alias("truncated"), text.alias("json"))


#: What a result says next; the second where no sample fits.
HINT, NO_ROOM = "raise offset_matches for the next matches", "no sample fits max_output_chars: count first, or save the matches"


def save_matches(matches: DataFrame, path: str, offset: int = 0) -> None:
    """JSON Lines in the order of matches, a folder of part files that are sorted among themselves; nulls stay."""
    rest = after(matches, offset).orderBy(*ORDER)
    rest.select(F.to_json(F.struct(*matches.columns), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)


def extract_regex_matches(docs: DataFrame, *args, **options) -> str:
    """`regex_result`; any failure as a text that says so."""
    try:
        return regex_result(docs, *args, **options)
    except Exception as e:
        return f"Error extracting matches: {e}"


def regex_result(docs: DataFrame, regex_pattern: str, regex_patterns: list[str] | None = None, max_matches: int = 50, offset_matches: int = 0, max_output_chars: int | None = 8000, count_only: bool = False, dedupe: bool = False, save_to: str | None = None, include_line_text: bool = True) -> str:
    """The result for docs of one text as JSON text; the sample, of max_matches at most, is cut from its end until the text has max_output_chars."""
    budget = max_output_chars if max_output_chars and max_output_chars > 0 else 8000
    offset, limit = max(0, offset_matches or 0), max(0, max_matches or 0)
    given = [p for p in (regex_patterns or [regex_pattern]) if p and p.strip()]
    if not given:
        return json.dumps({"ok": False, "error": "no pattern given"})
    for k, p in enumerate(given):
        try:
            patterns([p])
        except ValueError as e:
            return json.dumps({"ok": False, "error": f"pattern {k}: {e}", "pattern": p}, ensure_ascii=False)
    found = match_table(lines_of(docs), given, exact=True)
    if save_to:
        save_matches(found if include_line_text else found.drop("line"), save_to, offset)
    payload = match_payload(found if include_line_text else found.drop("line"), offset, limit, dedupe, count_only, docs=docs)
    row = result_json(payload, given, offset, budget, count_only, dedupe, include_line_text, save_to, regex_pattern).first()
    if row:
        return row.json
    out = {"ok": True, "file_path": "", "regex_pattern": regex_pattern, "regex_patterns": given, "total_matches": 0, "offset_matches": offset, "matches_after_offset": 0, "returned_matches": 0, "truncated": False, "count_only": count_only, "dedupe": dedupe, "saved_to": save_to, "include_line_text": include_line_text, "sample": [], "hint": HINT}
    return json.dumps(out, ensure_ascii=False)
