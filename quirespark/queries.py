"""Queries over the given tables, one or more for each operator, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .functions.text import normal_title
from .operators import audit, edits, guard, matches, numbering, outline, prefilter, summary, trace, tree
from .plans import discover
from .plans.blueprint import Blueprint
from .sources import ranges, text
from .sources.document_files import DocumentFiles
from .sources._shared import shared_folder

PATTERNS = ["[0-9]+", "([A-Za-z0-9._]+)@([A-Za-z0-9.]+)", "[A-Z][a-z]+", " ", "[a-z]+ing[.,]"]
STARTS = "^(The|Le|La|El|Der|Die|Das|That|And) "
BLUEPRINT = Blueprint(
    [
        {"level": 1, "name": "short", "regex": "^.{1,30}$", "validation_rules": {"must_not_end_with": ["?"]}},
        {"level": 2, "name": "article", "regex": STARTS + "[^.]*", "parent_level": 1, "validation_rules": {"max_length": 200, "must_not_contain": ["!"]}},
        {"level": 3, "name": "number", "regex": "[0-9]{3,}", "parent_level": 2, "validation_rules": {"requires_line_start": False, "must_contain": ["1"]}},
    ],
    {"mail": {"regex": "@"}},
)


#: A group that may take no part, and a pattern that only Python runs: the same as th|ing.
OPTIONAL, CONDITIONAL = "([0-9]+)?([A-Z])[a-z]", "(t)?(?(1)h|ing)"
AFTER_EMPTY = Blueprint([{"level": 1, "name": "after", "regex": "[A-Z][a-z]+", "validation_rules": {"requires_prev_empty_line": True, "context_filters": ["before a list"]}}])


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.lines(_docs(spark, sf_dir))


def _long(*names: str) -> list:
    return [F.col(n).cast("long").alias(n) for n in names]


def _placed(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    ls = _lines(spark, sf_dir)
    return ls, outline.outline(outline.headings(ls, BLUEPRINT), BLUEPRINT)


def _nodes(spark, sf_dir) -> DataFrame:
    ls, placed = _placed(spark, sf_dir)
    return tree.from_sections(outline.sections(ls, placed), _docs(spark, sf_dir).select("doc_id", F.concat(F.lit("doc "), "doc_id").alias("title")))


def _path(name: str = "path"):
    return F.array_join(name, ".").alias("path")


def _messages(spark, sf_dir) -> DataFrame:
    """Conversations as messages: what a user says calls a tool of that name, and an assistant's turn answers the user's turn before."""
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    call = F.struct(F.lit("ask").alias("name"), F.concat(F.lit("n="), F.length("text")).alias("args"), F.concat_ws("-", "conv_id", "turn").alias("id"))
    kind = F.when(F.col("role") == "user", "ai").when(F.col("role") == "assistant", "tool").otherwise("human")
    return c.select("conv_id", F.col("turn").alias("idx"), kind.alias("type"), F.col("text").alias("content"), F.when(F.col("role") == "user", F.array(call)).alias("tool_calls"), F.when(F.col("role") == "assistant", F.concat_ws("-", "conv_id", (F.col("turn") - 1).cast("string"))).alias("tool_call_id"), F.lit("success").alias("status"))


def line_scan(spark, sf_dir):
    return _lines(spark, sf_dir).select("doc_id", *_long("line_number"), "line")


def text_segment(spark, sf_dir):
    t = F.col("text")
    return _docs(spark, sf_dir).select("doc_id", text.segment(t, 50, 100).alias("middle"), text.segment(t, 10_000_000, 5).alias("past"), text.segment(t, -5, 7).alias("head"), F.md5(text.segment(t, 100, -1).cast("binary")).alias("rest_md5"), text.segment(t, 3, 0).alias("none"))


def default_segment(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", text.segment(F.col("text")).alias("segment"))


def char_length(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", text.char_length(F.col("text")).cast("long").alias("n_chars"))


def _table(spark, sf_dir) -> DataFrame:
    return matches.match_table(_lines(spark, sf_dir), PATTERNS)


def _shown(m: DataFrame) -> DataFrame:
    return m.select("doc_id", *_long("line_number", "pattern_index", "match_ord"), "pattern", "full_match", F.array_join("groups", "|").alias("groups"))


def regex_matches(spark, sf_dir):
    return _shown(_table(spark, sf_dir))


def regex_matches_exact(spark, sf_dir):
    return _shown(matches.match_table(_lines(spark, sf_dir), PATTERNS[:2], exact=True))


def regex_counts(spark, sf_dir):
    return matches.match_counts(_lines(spark, sf_dir), PATTERNS).select(*_long("pattern_index", "n_matches", "n_lines"), "pattern")


def regex_matches_bare(spark, sf_dir):
    return matches.match_table(_lines(spark, sf_dir), PATTERNS[:1], line_text=False).select("doc_id", *_long("line_number", "pattern_index", "match_ord"), "pattern", "full_match", F.array_join("groups", "|").alias("groups"))


def regex_null_groups(spark, sf_dir):
    m = matches.match_table(_lines(spark, sf_dir), [OPTIONAL], exact=True)
    return m.select("doc_id", *_long("line_number", "match_ord"), "full_match", F.array_join("groups", "|", "null").alias("groups"))


def regex_counts_exact(spark, sf_dir):
    return matches.match_counts(_lines(spark, sf_dir), [CONDITIONAL, OPTIONAL], by=("doc_id",)).select("doc_id", *_long("pattern_index", "n_matches", "n_lines"))


def regex_page(spark, sf_dir):
    return _shown(matches.match_page(_table(spark, sf_dir), 5, 20))


def regex_page_everywhere(spark, sf_dir):
    return _shown(matches.match_page(_table(spark, sf_dir), 100, 50, everywhere=True))


def regex_dedupe(spark, sf_dir):
    return _shown(matches.match_page(_table(spark, sf_dir), 2, 1_000_000, dedupe=True))


def regex_payload(spark, sf_dir):
    p = matches.match_payload(_table(spark, sf_dir), 3, 10, dedupe=True, docs=_docs(spark, sf_dir))
    return p.select("doc_id", *_long("total_matches", "matches_after_offset", "returned_matches"), "truncated", F.array_join(F.transform("sample", lambda m: m["full_match"]), "|").alias("sample"))


def regex_payload_count(spark, sf_dir):
    p = matches.match_payload(_table(spark, sf_dir), 3, count_only=True, docs=_docs(spark, sf_dir))
    return p.select("doc_id", *_long("total_matches", "matches_after_offset", "returned_matches"), "truncated")


def excluded_lines(spark, sf_dir):
    ls = _lines(spark, sf_dir)
    return ls.where(~outline.excluded(BLUEPRINT)).select("doc_id", *_long("line_number"), "line")


def valid_headings(spark, sf_dir):
    return outline.headings(_lines(spark, sf_dir), BLUEPRINT).select("doc_id", *_long("line_number", "level"), "name", "heading", F.array_join("hit_levels", ",").alias("hit_levels"))


def headings_after_empty_lines(spark, sf_dir):
    d = _docs(spark, sf_dir).select("doc_id", F.regexp_replace("text", "[!?] ", "\n\n").alias("text"))
    found = outline.headings(text.lines(d), AFTER_EMPTY)
    return found.select("doc_id", *_long("line_number"), "heading", F.array_join("unevaluated_filters", ",").alias("unevaluated_filters"))


def heading_outline(spark, sf_dir):
    return _placed(spark, sf_dir)[1].select("doc_id", *_long("line_number", "level", "parent_line", "ordinal"), "orphan", _path())


def sections(spark, sf_dir):
    return outline.sections(*_placed(spark, sf_dir), summary=40).select("doc_id", *_long("line_number", "end_line"), F.md5(F.col("body").cast("binary")).alias("body_md5"), "content_summary")


def audit_gaps(spark, sf_dir):
    return audit.gaps(_lines(spark, sf_dir), BLUEPRINT, 2).select("doc_id", *_long("first_line", "last_line", "n_lines"))


def audit_collisions(spark, sf_dir):
    return audit.collisions(_lines(spark, sf_dir), BLUEPRINT).select("doc_id", *_long("line_number"), "line", F.array_join("names", ",").alias("names"))


def audit_sequence(spark, sf_dir):
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_shipdate", "l_partkey", "l_suppkey")
    return audit.breaks(items, ["l_orderkey"], F.struct("l_shipdate", "l_linenumber", "l_partkey", "l_suppkey"), F.col("l_linenumber")).select("l_orderkey", *_long("number", "previous"))


def heading_sequence(spark, sf_dir):
    return audit.sequence_breaks(_placed(spark, sf_dir)[1]).select("doc_id", *_long("line_number", "number", "previous"))


def pattern_stats(spark, sf_dir):
    s = audit.pattern_stats(_lines(spark, sf_dir), PATTERNS)
    return s.select(*_long("pattern_index", "n_matches", "n_lines", "n_docs", "first_line", "last_line"), F.round("mean_line", 6).alias("mean_line"))


def page_titles(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return p.select("page_id", normal_title(F.regexp_extract("html", "<h1[^>]*>([^<]*)</h1>", 1)).alias("title"))


def tree_nodes(spark, sf_dir):
    return _nodes(spark, sf_dir).select("ast_id", _path(), "section_title", "content_summary")


def tree_children(spark, sf_dir):
    return tree.children(_nodes(spark, sf_dir), [0]).select("ast_id", *_long("index"), "section_title")


def tree_subtree(spark, sf_dir):
    return tree.subtree(_nodes(spark, sf_dir), [1]).select("ast_id", _path(), "section_title")


def tree_find_title(spark, sf_dir):
    return tree.find_by_title(_nodes(spark, sf_dir), "TH", max_results=3).select("ast_id", _path(), "section_title")


def tree_resolve(spark, sf_dir):
    n = _nodes(spark, sf_dir)
    wanted = n.where(F.size("path") == 1).select("ast_id", F.array(F.concat(F.lit("doc "), "ast_id"), F.concat(F.lit(" "), "section_title", F.lit("  "))).alias("titles"))
    return tree.resolve(n, wanted, 2).groupBy("ast_id", _path()).agg(F.count("*").alias("n"))


def tree_titles(spark, sf_dir):
    n = _nodes(spark, sf_dir)
    return tree.titles_of(n, n.select("ast_id", "path")).select("ast_id", _path(), F.array_join("titles", " / ").alias("titles"))


def tree_insert(spark, sf_dir):
    n = _nodes(spark, sf_dir)
    edits = n.where(F.size("path") == 0).select("ast_id", "path", F.lit(0).alias("position"), F.lit("Start").alias("section_title"), F.lit("new").alias("content_summary"))
    return tree.insert(n, edits).select("ast_id", _path(), "section_title", "content_summary")


def tree_insert_middle(spark, sf_dir):
    n = _nodes(spark, sf_dir)
    edits = n.where(F.col("path") == F.array(F.lit(0))).select("ast_id", tree.root_path().alias("path"), F.lit(1).alias("position"), F.lit("Middle").alias("section_title"), F.lit("new").alias("content_summary"))
    return tree.insert(n, edits).select("ast_id", _path(), "section_title", "content_summary")


def tree_upsert_new(spark, sf_dir):
    n = _nodes(spark, sf_dir)
    edits = n.where(F.size("path") == 0).select("ast_id", "path", F.lit("A title of its own").alias("section_title"), F.lit("new").alias("content_summary"))
    return tree.upsert(n, edits).select("ast_id", _path(), "section_title", "content_summary")


def tree_upsert(spark, sf_dir):
    n = _nodes(spark, sf_dir)
    edits = n.where(F.col("path") == F.array(F.lit(0))).select("ast_id", tree.root_path().alias("path"), F.concat(F.lit(" "), "section_title").alias("section_title"), F.lit(" note").alias("content_summary"))
    return tree.upsert(n, edits).select("ast_id", _path(), "section_title", "content_summary")


def tree_update(spark, sf_dir):
    n = _nodes(spark, sf_dir)
    edits = n.where(F.col("path") == F.array(F.lit(0))).select("ast_id", "path", F.concat(F.lit("new "), "section_title").alias("section_title"), F.lit(None).cast("string").alias("content_summary"))
    return tree.update(n, edits).select("ast_id", _path(), "section_title", "content_summary")


def tree_append_summary(spark, sf_dir):
    n = _nodes(spark, sf_dir)
    edits = n.where(F.size("path") == 2).where(F.col("path") == F.array(F.lit(0), F.lit(0))).select("ast_id", "path", F.lit("\n more ").alias("append_text"))
    return tree.append_summary(n, edits).select("ast_id", _path(), "section_title", "content_summary")


def tree_json(spark, sf_dir):
    n = tree.nodes_from_json(tree.nodes_to_json(_nodes(spark, sf_dir)))
    return n.select("ast_id", _path(), "section_title", "content_summary")


def tree_json_meta(spark, sf_dir):
    d = _docs(spark, sf_dir).where("doc_id is not null").select(F.col("doc_id").cast("string").alias("ast_id"), F.concat("source", F.lit(".txt")).alias("file_name"), (F.col("doc_id") % 7).alias("rev"), F.lit("2024-01-01T00:00:00+00:00").alias("updated_at"))
    roots = d.select("ast_id", tree.root_path().alias("path"), F.col("file_name").alias("section_title"), F.lit("").alias("content_summary"))
    return tree.meta_from_json(tree.nodes_to_json(roots, d))


def trace_log(spark, sf_dir):
    t = trace.flatten_trace(_messages(spark, sf_dir))
    return t.select("conv_id", *_long("idx", "call_ord"), "type", "tool_call_id", "tool_name", "args", "content", "ai_content", "output", "status")


def line_scan_ranges(spark, sf_dir):
    """All documents, in order, as one text in many files, read by ranges."""
    at = shared_folder(spark, "text")
    d = _docs(spark, sf_dir).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    d.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text").select("text").write.text(at)
    return ranges.scan_lines(spark, at, together=True).select("line_number", "char_start", "line", "ended")


STEMS = ["tion", "ing", "ment", "heit", "keit", "lich", "ción", "mente", "eaux", "ung", "able", "ness", "ther", "sch", "que", "ous"]
MANY = [p for s in STEMS for p in (f"[a-z]*{s}[.,]", f"^[A-Z][a-z]*{s}", f"({s}|[0-9]{s[0]})([a-z]*)")] + ["[0-9]{4,}"]


def regex_many(spark, sf_dir):
    m = prefilter.match_many(_lines(spark, sf_dir), MANY, line_text=False)
    return m.select("doc_id", *_long("line_number", "pattern_index", "match_ord"), "full_match", F.array_join("groups", "|").alias("groups"))


def regex_page_far(spark, sf_dir):
    return _shown(matches.match_page(_table(spark, sf_dir), matches.TOP * 2, 50, everywhere=True))


#: A pattern with braces that are none of Java's, and one with a comment.
ODD = ["[a-z]{2}{", "(?#a shout)[A-Z]{4,}!", "a{,2}re", "\\0"]


def regex_odd_patterns(spark, sf_dir):
    return matches.match_counts(_lines(spark, sf_dir), ODD, by=("doc_id",)).select("doc_id", *_long("pattern_index", "n_matches", "n_lines"))


def regex_json(spark, sf_dir):
    given, docs = [PATTERNS[0], PATTERNS[2]], _docs(spark, sf_dir)
    p = matches.match_payload(matches.match_table(_lines(spark, sf_dir), given, line_text=False), 1, 40, docs=docs)
    return matches.result_json(p, given, 1, 1200, line_text=False).select("doc_id", "returned_matches", "truncated", "json")


def line_shapes(spark, sf_dir):
    return discover.shape_stats(_lines(spark, sf_dir)).select("shape", *_long("n_lines", "n_docs", "n_long", "longest"))


#: What stands for the number of an item without one: over four times any number.
NUMBERLESS = 2**40


def _ledger(spark, sf_dir) -> DataFrame:
    """A customer's orders and their items as lines of a text."""
    c = F.col
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_custkey", "o_orderkey", "o_orderpriority")
    i = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", F.coalesce(c("l_linenumber").cast("long") * 4, F.lit(NUMBERLESS)).alias("n"))
    i = i.repartition("l_orderkey").groupBy("l_orderkey").agg(F.collect_list("n").alias("items"))
    o = o.join(i, c("o_orderkey") == c("l_orderkey"), "left").repartition("o_custkey")
    # Orders are dealt out by customer with their items as numbers; lines are made, and counted, where they end up. Orders of one key have their items together, after the orders.
    one = Window.partitionBy("o_custkey", "o_orderkey")
    items = F.when(c("items").isNull(), 0).otherwise(F.size("items") * 2)
    o = o.withColumns({"m": items, "k": F.count("*").over(one), "j": F.row_number().over(one.orderBy("o_orderpriority"))})
    up_to = F.sum(c("m") + 1).over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))  # orders of this key, too
    o = o.withColumn("start", up_to - c("k") * (c("m") + 1))
    # Four times a number less one is an item, and one more its packing.
    halves = F.concat(F.transform("items", lambda x: x - 1), F.transform("items", lambda x: x + 1))
    halves = F.sort_array(F.when(c("k") > 1, F.flatten(F.array_repeat(halves, c("k").cast("int")))).otherwise(halves))
    o = o.withColumn("halves", F.when((c("j") == 1) & (c("m") > 0), halves).otherwise(F.array().cast("array<bigint>")))
    o = o.withColumn("early", F.when(F.get("halves", F.lit(0)) < 0, F.size(F.filter("halves", lambda x: x < 0))).otherwise(0))
    rows = o.select("o_custkey", "o_orderkey", "o_orderpriority", "start", "k", "j", "early", F.posexplode(F.concat(F.array(F.lit(0).cast("long")), c("halves"))).alias("at", "n"))
    number = c("start") + F.when(c("n") == 0, c("early") + c("j")).when(c("n") < 0, c("at")).otherwise(c("at") + c("k"))
    item = F.when(c("n") < NUMBERLESS - 1, F.concat(F.lit("  ("), F.shiftright(c("n") + 1, 2), F.lit(") item")))
    line = F.when(c("n") == 0, F.concat(F.lit("§ "), "o_orderkey", F.lit(" "), "o_orderpriority")).when(F.pmod("n", F.lit(4)) == 3, item).otherwise("packed as ordered")
    return rows.select(c("o_custkey").alias("doc_id"), number.cast("int").alias("line_number"), line.alias("line"))


def discovered_headings(spark, sf_dir):
    """Headings by a blueprint that is found in the texts themselves."""
    ls = _ledger(spark, sf_dir)
    bp = discover.discover(ls)
    placed = outline.outline(outline.headings(ls, bp), bp)
    return placed.select("doc_id", *_long("line_number", "level", "parent_line"), "name", "orphan", _path())


def blueprint_review(spark, sf_dir):
    """What the texts say of a blueprint that is found in them."""
    ls = _ledger(spark, sf_dir)
    return discover.review(ls, discover.discover(ls)).select(*_long("level", "n_headings", "n_docs", "n_collisions", "n_orphans", "n_numbers", "n_out_of_place"), "name")


def _edit_log(nodes: DataFrame) -> DataFrame:
    """Seven edits of each tree, of which paths depend on those before, and two fail."""
    e = lambda no, action, path=None, titles=None, position=None, title=None, summary=None, more=None: F.struct(F.lit(no).alias("edit_no"), F.lit(action).alias("action"), (F.array(*map(F.lit, path)) if path is not None else F.lit(None)).cast("array<int>").alias("path"), (titles if titles is not None else F.lit(None)).cast("array<string>").alias("titles"), F.lit(position).cast("int").alias("position"), F.lit(title).cast("string").alias("section_title"), F.lit(summary).cast("string").alias("content_summary"), F.lit(more).cast("string").alias("append_text"), F.lit(True).alias("create_missing"))
    each = [e(1, "append_child", [], position=0, title="Start", summary="new"), e(2, "append_child", [], position=0, title="Before", summary="b"), e(3, "update_node", [2], title="Renamed"), e(4, "append_to_summary", [1], more=" more"), e(5, "append_child", [], position=1_000_000, title="no", summary=""), e(6, "upsert_child", [], title=" Start ", summary="x"), e(7, "ensure_path", titles=F.array(F.concat(F.lit("doc "), "ast_id"), F.lit("Before"), F.lit("Deep")))]
    return nodes.where(F.size("path") == 0).select("ast_id", F.explode(F.array(*each)).alias("e")).select("ast_id", "e.*")


def tree_edit_log(spark, sf_dir):
    n = _nodes(spark, sf_dir)
    return edits.nodes_after(edits.replay(n, _edit_log(n))).select("ast_id", _path(), "section_title", "content_summary")


def tree_edit_outcomes(spark, sf_dir):
    n = _nodes(spark, sf_dir)
    return edits.outcomes(edits.replay(n, _edit_log(n))).select("ast_id", "edit_no", "action", "ok", "op", _path(), "rev")


def tree_files(spark, sf_dir):
    """Trees written as JSON, a file each, and read back."""
    spark.dataSource.register(DocumentFiles)
    at = shared_folder(spark, "trees")
    trees = tree.nodes_to_json(_nodes(spark, sf_dir)).withColumnsRenamed({"ast_id": "name", "json": "text"})
    trees.write.format("document_files").option("suffix", ".json").mode("append").save(at)
    back = spark.read.format("document_files").option("suffix", ".json").load(at).withColumnsRenamed({"name": "ast_id", "text": "json"})
    return tree.nodes_from_json(back).select("ast_id", _path(), "section_title", "content_summary")


BEFORE_LONGER = Blueprint([{"level": 1, "name": "head", "regex": "[A-Z][a-z]+", "validation_rules": {"context_filters": ["followed by a longer line", "said in words"]}}])


def headings_in_context(spark, sf_dir):
    found = outline.headings(_lines(spark, sf_dir), BEFORE_LONGER)
    return found.select("doc_id", *_long("line_number"), "heading", F.array_join("unevaluated_filters", ",").alias("unevaluated_filters"))


def numbers_out_of_place(spark, sf_dir):
    """Items of an order by date: how many of their numbers are in the longest rising run."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_shipdate", "l_partkey", "l_suppkey")
    w = Window.partitionBy("l_orderkey").orderBy("l_shipdate", "l_linenumber", "l_partkey", "l_suppkey")
    rows = items.select("l_orderkey", F.row_number().over(w).alias("place"), F.array("l_linenumber").alias("number"))
    return numbering.in_place(rows, ["l_orderkey"], "place", "number").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.count_if("in_place").alias("n_in_place"))


def extractive_summaries(spark, sf_dir):
    s = outline.sections(*_placed(spark, sf_dir))
    return summary.extract(s, ["doc_id", "line_number"], length=300).select("doc_id", *_long("line_number"), "summary")


def _guarded(spark, sf_dir) -> guard.Batch:
    """Tokens of each tree, good and bad, and seven uses of them, of which one succeeds."""
    n = _nodes(spark, sf_dir)
    ids = _docs(spark, sf_dir).select(F.col("doc_id").cast("string").alias("ast_id"), "doc_id")
    meta = ids.select("ast_id", (F.col("doc_id") % 3).alias("rev"), F.lit(None).cast("timestamp").alias("updated_at"))
    now, path = F.lit("2024-01-01 12:00:00").cast("timestamp"), lambda *p: F.array(*map(F.lit, p)).cast("array<int>")
    t = lambda name, purpose, at, minutes: F.struct(F.lit(name).alias("name"), F.lit(purpose).alias("purpose"), at.alias("path"), F.lit(minutes).alias("minutes"))
    tokens = meta.select("ast_id", "rev", F.explode(F.array(t("a", "append_child", path(), 5), t("b", "update_node", path(), 5), t("c", "append_child", path(), -1), t("d", "append_child", path(0), 5))).alias("t"))
    tokens = tokens.select(F.concat("t.name", "ast_id").alias("token"), "ast_id", "t.purpose", "t.path", F.col("rev").alias("issued_rev"), (now + F.make_dt_interval(mins=F.col("t.minutes"))).alias("expires_at"))
    e = lambda no, name, action, at, position=None: F.struct(F.lit(no).alias("no"), F.lit(name).alias("name"), F.lit(action).alias("action"), at.alias("path"), F.lit(position).cast("int").alias("position"))
    uses = [e(1, "c", "append_child", path()), e(2, "c", "append_child", path()), e(3, "b", "append_child", path()), e(4, "d", "append_child", path(0), 99), e(5, "a", "append_child", path(), 0), e(6, "b", "update_node", path()), e(7, "d", "append_child", path(0))]
    batch = ids.select("ast_id", "doc_id", F.explode(F.array(*uses)).alias("e")).select("ast_id", (F.col("doc_id") * 10 + F.col("e.no")).alias("edit_no"), F.concat("e.name", "ast_id").alias("token"), "e.action", "e.path", "e.position", F.lit("New").alias("section_title"), F.lit("text").alias("content_summary"))
    return guard.commit(n, meta, tokens, batch, now)


def tree_guarded_outcomes(spark, sf_dir):
    return _guarded(spark, sf_dir).outcomes.select("ast_id", "edit_no", "action", "ok", "error", "rev")


def tree_guarded_nodes(spark, sf_dir):
    return _guarded(spark, sf_dir).nodes.select("ast_id", _path(), "section_title", "content_summary")


def _ensured(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Lists of titles of each tree: two share a new node, one leads on from a node that is there."""
    n = _nodes(spark, sf_dir)
    lists = lambda *each: F.posexplode(F.array(*[F.array(*[F.lit(x) if isinstance(x, str) else x for x in xs]) for xs in each])).alias("no", "titles")
    wanted = n.where(F.size("path") == 0).select("ast_id", lists(["New A", "Deep"], [F.col("section_title"), "New  B"], [" New A ", "Other", ""]))
    below = n.where(F.col("path") == F.array(F.lit(0))).select("ast_id", F.lit(3).alias("no"), F.array("section_title", F.lit("Kid")).alias("titles"))
    return tree.ensure_paths(n, wanted.unionByName(below), 3)


def tree_ensure_paths(spark, sf_dir):
    return _ensured(spark, sf_dir)[0].select("ast_id", _path(), "section_title", "content_summary")


def tree_ensured_lists(spark, sf_dir):
    return _ensured(spark, sf_dir)[1].select("ast_id", *_long("no"), _path(), "created")


QUERIES = [blueprint_review, tree_ensure_paths, tree_ensured_lists, tree_files, headings_in_context, numbers_out_of_place, extractive_summaries, tree_guarded_outcomes, tree_guarded_nodes, line_scan_ranges, regex_many, regex_page_far, regex_odd_patterns, regex_json, line_shapes, discovered_headings, tree_edit_log, tree_edit_outcomes, line_scan, text_segment, default_segment, char_length, regex_matches, regex_matches_exact, regex_matches_bare, regex_null_groups, regex_counts, regex_counts_exact, regex_page, regex_page_everywhere, regex_dedupe, regex_payload, regex_payload_count, excluded_lines, valid_headings, headings_after_empty_lines, heading_outline, sections, audit_gaps, audit_collisions, audit_sequence, heading_sequence, pattern_stats, page_titles, tree_nodes, tree_children, tree_subtree, tree_find_title, tree_resolve, tree_titles, tree_insert, tree_insert_middle, tree_upsert, tree_upsert_new, tree_update, tree_append_summary, tree_json, tree_json_meta, trace_log]


def queries() -> dict:
    return {f.__name__: f for f in QUERIES}


# SQL

L = """L AS (SELECT doc_id, unnest(range(1, len(a) + 1)) AS line_number, unnest(a) AS line FROM (
  SELECT doc_id, CASE WHEN t = '' THEN [] ELSE string_split(regexp_replace(t, '\\n\\z', ''), chr(10)) END AS a
  FROM (SELECT doc_id, regexp_replace(text, '\\r\\n?', chr(10), 'g') AS t FROM documents WHERE text IS NOT NULL)))"""


def _m(found: list[int], head: str = L) -> str:
    """CTE M: all matches."""
    parts = []
    for k in found:
        p = PATTERNS[k]
        groups = f"unnest(regexp_extract_all(line, '{p}', 1)) || '|' || unnest(regexp_extract_all(line, '{p}', 2))" if "(" in p else f"unnest(regexp_extract_all(line, '{p}'))"
        parts.append(f"SELECT doc_id, line_number, CAST({k} AS BIGINT) AS pattern_index, unnest(range(0, len(regexp_extract_all(line, '{p}')))) AS match_ord, '{p}' AS pattern, unnest(regexp_extract_all(line, '{p}')) AS full_match, {groups} AS groups FROM L")
    return f"{head}, M AS ({' UNION ALL '.join(parts)})"


USED = [k for k, p in enumerate(PATTERNS) if p.strip()]
RENUMBERED = {k: i for i, k in enumerate(USED)}
SHOWN = "doc_id, line_number, pattern_index, match_ord, pattern, full_match, groups"
ALL = _m(USED).replace("CAST(4 AS BIGINT)", f"CAST({RENUMBERED[4]} AS BIGINT)")
EVERY = "doc_id, line_number, pattern_index, match_ord"
IN_DOC = "line_number, pattern_index, match_ord"

C = L + """, C AS (SELECT *,
   regexp_matches(line, '^.{1,30}$') AND NOT ends_with(line, '?') AS h1,
   regexp_matches(line, '^(The|Le|La|El|Der|Die|Das|That|And) [^.]*') AND length(regexp_extract(line, '^(The|Le|La|El|Der|Die|Das|That|And) [^.]*')) <= 200
     AND NOT contains(regexp_extract(line, '^(The|Le|La|El|Der|Die|Das|That|And) [^.]*'), '!') AS h2,
   regexp_matches(line, '[0-9]{3,}') AND contains(regexp_extract(line, '[0-9]{3,}'), '1') AS h3
  FROM L WHERE NOT regexp_matches(line, '@')),
H AS (SELECT doc_id, line_number, CAST(CASE WHEN h1 THEN 1 WHEN h2 THEN 2 ELSE 3 END AS BIGINT) AS level,
  CASE WHEN h1 THEN 'short' WHEN h2 THEN 'article' ELSE 'number' END AS name,
  CASE WHEN h1 THEN line WHEN h2 THEN regexp_extract(line, '^(The|Le|La|El|Der|Die|Das|That|And) [^.]*') ELSE regexp_extract(line, '[0-9]{3,}') END AS heading,
  concat_ws(',', CASE WHEN h1 THEN '1' END, CASE WHEN h2 THEN '2' END, CASE WHEN h3 THEN '3' END) AS hit_levels
  FROM C WHERE h1 OR h2 OR h3)"""
O = C + """, W AS (SELECT *, coalesce(max(CASE WHEN level = 1 THEN line_number END) OVER b, 0) AS l1, coalesce(max(CASE WHEN level = 2 THEN line_number END) OVER b, 0) AS l2
  FROM H WINDOW b AS (PARTITION BY doc_id ORDER BY line_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
P AS (SELECT *, CASE level WHEN 1 THEN 0 WHEN 2 THEN l1 ELSE greatest(l1, l2) END AS parent_line,
  CASE level WHEN 1 THEN false WHEN 2 THEN l1 = 0 ELSE l2 = 0 OR l1 > l2 END AS orphan FROM W),
N AS (SELECT *, row_number() OVER (PARTITION BY doc_id, parent_line ORDER BY line_number) - 1 AS ordinal FROM P),
A AS (SELECT x.*, concat_ws('.', CAST(z.ordinal AS VARCHAR), CAST(y.ordinal AS VARCHAR), CAST(x.ordinal AS VARCHAR)) AS path
  FROM N x LEFT JOIN N y ON x.doc_id = y.doc_id AND x.parent_line = y.line_number LEFT JOIN N z ON y.doc_id = z.doc_id AND y.parent_line = z.line_number)"""


def _sections(summary: int) -> str:
    return O + f""", S AS (SELECT L.doc_id, L.line_number AS here, L.line, max(N.line_number) OVER (PARTITION BY L.doc_id ORDER BY L.line_number) AS head, N.line_number IS NOT NULL AS is_head
  FROM L LEFT JOIN N ON L.doc_id = N.doc_id AND L.line_number = N.line_number),
B AS (SELECT doc_id, head AS line_number, max(here) AS end_line, coalesce(string_agg(CASE WHEN NOT is_head THEN line END, chr(10) ORDER BY here), '') AS body FROM S WHERE head IS NOT NULL GROUP BY doc_id, head),
X AS (SELECT A.*, end_line, body, substring(body, 1, {summary}) AS content_summary FROM A JOIN B ON A.doc_id = B.doc_id AND A.line_number = B.line_number)"""


T = _sections(200) + """, T AS (SELECT CAST(doc_id AS VARCHAR) AS ast_id, path, heading AS section_title, content_summary FROM X
  UNION ALL SELECT CAST(doc_id AS VARCHAR), '', 'doc ' || doc_id, '' FROM documents),
K AS (SELECT *, CASE WHEN path = '' THEN CAST([] AS BIGINT[]) ELSE CAST(string_split(path, '.') AS BIGINT[]) END AS p FROM T)"""
NORMAL = "trim(regexp_replace({}, '\\s+', ' ', 'g'))"


def _many() -> str:
    each = []
    for k, p in enumerate(MANY):
        groups = f"unnest(regexp_extract_all(line, '{p}', 1)) || '|' || unnest(regexp_extract_all(line, '{p}', 2))" if "(" in p else f"unnest(regexp_extract_all(line, '{p}'))"
        each.append(f"SELECT doc_id, line_number, CAST({k} AS BIGINT) AS pattern_index, unnest(range(0, len(regexp_extract_all(line, '{p}')))) AS match_ord, unnest(regexp_extract_all(line, '{p}')) AS full_match, {groups} AS groups FROM L")
    return f"WITH {L} " + " UNION ALL ".join(each)


def _json() -> str:
    """Records as texts, running sums of their lengths, and the last one with which the whole fits."""
    q = lambda c: f"CAST(to_json({c}) AS VARCHAR)"
    record = f"'{{\"pattern_index\": ' || i || ', \"pattern\": ' || {q('pattern')} || ', \"line_number\": ' || line_number || ', \"match\": ' || {q('full_match')} || ', \"full_match\": ' || {q('full_match')} || '}}'"
    head = f"'{{\"ok\": true, \"file_path\": \"' || doc_id || '\", \"regex_pattern\": \"{PATTERNS[0]}\", \"regex_patterns\": [\"{PATTERNS[0]}\", \"{PATTERNS[2]}\"], \"total_matches\": ' || total || ', \"offset_matches\": 1, \"matches_after_offset\": ' || rest || ', \"returned_matches\": '"
    middle = "', \"truncated\": '"
    tail = "', \"count_only\": false, \"dedupe\": false, \"saved_to\": null, \"include_line_text\": false, \"sample\": ['"
    hint = f"'], \"hint\": \"{matches.HINT}\"}}'"
    return _m([0, 2]) + f""", R AS (SELECT doc_id, pattern_index // 2 AS i, pattern, line_number, match_ord, full_match, row_number() OVER (PARTITION BY doc_id ORDER BY line_number, pattern_index, match_ord) - 1 AS n FROM M),
S AS (SELECT doc_id, n, {record} AS record FROM R WHERE n BETWEEN 1 AND 40),
V AS (SELECT doc_id, n, record, sum(length(record)) OVER w + 2 * (n - 1) AS so_far FROM S WINDOW w AS (PARTITION BY doc_id ORDER BY n)),
T AS (SELECT d.doc_id, count(M.doc_id) AS total, greatest(count(M.doc_id) - 1, 0) AS rest FROM (SELECT DISTINCT doc_id FROM documents) d LEFT JOIN M ON d.doc_id = M.doc_id GROUP BY d.doc_id),
H AS (SELECT *, {head} AS head FROM T),
K AS (SELECT H.doc_id, max(CASE WHEN length(head) + length({middle}) + length({tail}) + length({hint}) + length(CAST(n AS VARCHAR)) + CASE WHEN rest > n THEN 4 ELSE 5 END + so_far <= 1200 THEN n END) AS k FROM H JOIN V ON H.doc_id = V.doc_id GROUP BY H.doc_id),
J AS (SELECT H.*, coalesce(k, 0) AS k, coalesce((SELECT string_agg(record, ', ' ORDER BY n) FROM V WHERE V.doc_id = H.doc_id AND n <= k), '') AS sample FROM H LEFT JOIN K ON H.doc_id = K.doc_id)
SELECT doc_id, CAST(k AS BIGINT) AS returned_matches, rest > k AS truncated, head || CAST(k AS BIGINT) || {middle} || CASE WHEN rest > k THEN 'true' ELSE 'false' END || {tail} || sample || {hint} AS json FROM J"""


def _shapes() -> str:
    q = lambda s: s.replace("'", "''")
    mark = f"rtrim(regexp_extract(t, '{q(discover.MARK)}'), ' ')"
    return L + f""", X AS (SELECT doc_id, line, least(length(regexp_extract(line, '{discover.INDENT}')), {discover.DEEPEST}) AS indent, regexp_replace(line, '{discover.INDENT}|[ \\t\\x{{3000}}]+$', '', 'g') AS t FROM L),
Y AS (SELECT *, {mark} AS mark FROM X WHERE t <> ''),
Z AS (SELECT doc_id, length(line) AS n, CASE WHEN mark = '' THEN 'plain' ELSE indent || ':' || CASE WHEN regexp_matches(mark, '{discover.DIGITS}') THEN regexp_replace(mark, '{discover.DIGITS}', '9', 'g') ELSE regexp_replace(regexp_replace(regexp_replace(mark, '{discover.ROMAN}', 'I', 'g'), '{discover.UPPER}', 'A', 'g'), '{discover.LOWER}', 'a', 'g') END END AS shape FROM Y)
SELECT shape, count(*) AS n_lines, count(DISTINCT doc_id) AS n_docs, count(*) FILTER (n > 100) AS n_long, max(n) AS longest FROM Z GROUP BY shape"""


LEDGER = """O AS (SELECT o_custkey, o_orderkey, 0 AS n FROM orders UNION ALL SELECT o_custkey, o_orderkey, l_linenumber * 2 - x.x FROM orders JOIN lineitem ON l_orderkey = o_orderkey, (VALUES (0), (1)) x(x)),
E AS (SELECT o_custkey AS doc_id, o_orderkey, n, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey, n) AS line_number FROM O),
G AS (SELECT *, max(CASE WHEN n = 0 THEN line_number END) OVER (PARTITION BY doc_id ORDER BY line_number) AS top FROM E WHERE n % 2 = 1 OR n = 0),
Q AS (SELECT *, dense_rank() OVER (PARTITION BY doc_id ORDER BY top) - 1 AS a, row_number() OVER (PARTITION BY doc_id, top ORDER BY line_number) - 2 AS b FROM G)
SELECT doc_id, line_number, CAST(CASE n WHEN 0 THEN 1 ELSE 2 END AS BIGINT) AS level, CASE n WHEN 0 THEN 0 ELSE top END AS parent_line, CASE n WHEN 0 THEN '0:§ 9' ELSE '2:(9)' END AS name, false AS orphan, CASE n WHEN 0 THEN CAST(a AS VARCHAR) ELSE a || '.' || b END AS path FROM Q"""

EDITED = """SELECT ast_id, '' AS path, section_title, content_summary FROM K WHERE len(p) = 0
UNION ALL SELECT ast_id, x.path, x.title, x.summary FROM K, (VALUES ('0', 'Before', 'b'), ('0.0', 'Deep', ''), ('1', 'Start', 'new' || chr(10) || 'more' || chr(10) || 'x')) x(path, title, summary) WHERE len(p) = 0
UNION ALL SELECT ast_id, concat_ws('.', CAST(p[1] + 2 AS VARCHAR), CAST(p[2] AS VARCHAR), CAST(p[3] AS VARCHAR)), CASE WHEN path = '0' THEN 'Renamed' ELSE section_title END, content_summary FROM K WHERE len(p) > 0"""
OUTCOMES = """
SELECT ast_id, CAST(e.no AS BIGINT) AS edit_no, action, ok AND (e.no <> 3 OR had) AS ok, CASE WHEN e.no <> 3 OR had THEN op END AS op, CASE WHEN e.no <> 3 OR had THEN path END AS path, CAST(rev - CASE WHEN e.no >= 3 AND NOT had THEN 1 ELSE 0 END AS BIGINT) AS rev
FROM F, (VALUES (1, 'append_child', true, 'created', '0', 1), (2, 'append_child', true, 'created', '0', 2), (3, 'update_node', true, 'updated', '2', 3), (4, 'append_to_summary', true, 'appended', '1', 4), (5, 'append_child', false, NULL, NULL, 4), (6, 'upsert_child', true, 'appended', '1', 5), (7, 'ensure_path', true, 'created', '0.0', 6)) e(no, action, ok, op, path, rev)"""


def _summaries() -> str:
    sentence, words = summary.SENTENCE, summary.WORDS
    return _sections(40) + f""", Q9 AS (SELECT doc_id, line_number, list_filter(list_transform(regexp_extract_all(body, '{sentence}'), lambda s: trim(s, ' ')), lambda s: regexp_matches(s, '{words}')) AS a FROM X),
S9 AS (SELECT doc_id, line_number, unnest(range(0, len(a))) AS place, unnest(a) AS sentence FROM Q9),
V9 AS (SELECT doc_id, line_number, place, unnest(regexp_extract_all(lower(sentence), '{words}')) AS word FROM S9),
F9 AS (SELECT word, length(bin((SELECT count(*) FROM X) // count(*))) - 1 AS weight FROM (SELECT DISTINCT doc_id, line_number, word FROM V9) GROUP BY word),
R9 AS (SELECT doc_id, line_number, place, CAST(sum(weight) * 100 AS BIGINT) // count(*) + {summary.BONUS} // (place + 1) AS score FROM V9 JOIN F9 USING (word) GROUP BY doc_id, line_number, place),
U9 AS (SELECT S9.*, sum(length(sentence) + 1) OVER (PARTITION BY S9.doc_id, S9.line_number ORDER BY score DESC, S9.place) - 1 AS upto FROM S9 JOIN R9 ON S9.doc_id = R9.doc_id AND S9.line_number = R9.line_number AND S9.place = R9.place)
SELECT X.doc_id, X.line_number, coalesce(string_agg(sentence, ' ' ORDER BY place) FILTER (upto <= 300), '') AS summary FROM X LEFT JOIN U9 ON X.doc_id = U9.doc_id AND X.line_number = U9.line_number GROUP BY X.doc_id, X.line_number"""


NEW = ", N9 AS (SELECT ast_id, count(*) FILTER (len(p) = 1) AS top, count(*) FILTER (len(p) = 2 AND p[1] = 0) AS below FROM K GROUP BY ast_id)"
HAD = ", F AS (SELECT ast_id, count(*) FILTER (len(p) = 1) > 0 AS had FROM K GROUP BY ast_id)"


def oracle_sql() -> dict[str, str]:
    w = "WITH "
    return {
        "blueprint_review": "WITH J AS (SELECT o_custkey, o_orderkey, l_linenumber FROM orders JOIN lineitem ON l_orderkey = o_orderkey), K AS (SELECT o_custkey, o_orderkey, count(*) AS n, count(DISTINCT l_linenumber) AS d FROM J GROUP BY ALL) SELECT CAST(1 AS BIGINT) AS level, '0:§ 9' AS name, count(*) AS n_headings, count(DISTINCT o_custkey) AS n_docs, CAST(0 AS BIGINT) AS n_collisions, CAST(0 AS BIGINT) AS n_orphans, count(*) AS n_numbers, CAST(0 AS BIGINT) AS n_out_of_place FROM orders UNION ALL SELECT CAST(2 AS BIGINT), '2:(9)', CAST(sum(n) AS BIGINT), count(DISTINCT o_custkey), CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(sum(n) AS BIGINT), CAST(sum(n - d) AS BIGINT) FROM K",
        "tree_ensure_paths": w + T + NEW + " SELECT ast_id, path, section_title, content_summary FROM T UNION ALL SELECT ast_id, CASE WHEN kid THEN '0.' || below ELSE concat_ws('.', CAST(top + a AS VARCHAR), b) END, title, '' FROM N9, (VALUES (0, NULL, 'New A', false), (0, '0', 'Deep', false), (0, '1', 'Other', false), (1, NULL, 'New  B', false), (0, NULL, 'Kid', true)) x(a, b, title, kid) WHERE NOT kid OR top > 0",
        "tree_ensured_lists": w + T + NEW + " SELECT ast_id, no, CASE WHEN no = 3 THEN '0.' || below ELSE concat_ws('.', CAST(top + a AS VARCHAR), b) END AS path, true AS created FROM N9, (VALUES (CAST(0 AS BIGINT), 0, '0'), (1, 1, NULL), (2, 0, '1'), (3, 0, NULL)) x(no, a, b) WHERE no < 3 OR top > 0",
        "tree_files": w + T + " SELECT ast_id, path, section_title, content_summary FROM T",
        "headings_in_context": w + L + ", P AS (SELECT *, lead(line) OVER (PARTITION BY doc_id ORDER BY line_number) AS b FROM L) SELECT doc_id, line_number, regexp_extract(line, '^[A-Z][a-z]+') AS heading, 'said in words' AS unevaluated_filters FROM P WHERE regexp_matches(line, '^[A-Z][a-z]+') AND length(b) > length(line)",
        "numbers_out_of_place": "WITH RECURSIVE i AS (SELECT l_orderkey, l_linenumber AS v, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_partkey, l_suppkey) AS p FROM lineitem), r AS (SELECT l_orderkey, p, v, 1 AS n FROM i UNION SELECT i.l_orderkey, i.p, i.v, r.n + 1 FROM r JOIN i ON i.l_orderkey = r.l_orderkey AND i.p > r.p AND i.v > r.v) SELECT l_orderkey, (SELECT count(*) FROM i WHERE i.l_orderkey = r.l_orderkey) AS n, CAST(max(r.n) AS BIGINT) AS n_in_place FROM r GROUP BY l_orderkey",
        "extractive_summaries": w + _summaries(),
        "tree_guarded_outcomes": w + T + HAD + " SELECT ast_id, CAST(ast_id AS BIGINT) * 10 + no AS edit_no, action, no = 5 AS ok, CASE WHEN no = 4 AND NOT had THEN 'no node at the path' ELSE error END AS error, CAST(ast_id AS BIGINT) % 3 + CASE WHEN no >= 5 THEN 1 ELSE 0 END AS rev FROM F, (VALUES (1, 'append_child', 'token has expired'), (2, 'append_child', 'unknown token'), (3, 'append_child', 'token is for another purpose'), (4, 'append_child', 'position is out of range'), (5, 'append_child', NULL), (6, 'update_node', 'token is of another revision'), (7, 'append_child', 'unknown token')) e(no, action, error)",
        "tree_guarded_nodes": w + T + " SELECT ast_id, '' AS path, section_title, content_summary FROM K WHERE len(p) = 0 UNION ALL SELECT ast_id, '0', 'New', 'text' FROM K WHERE len(p) = 0 UNION ALL SELECT ast_id, concat_ws('.', CAST(p[1] + 1 AS VARCHAR), CAST(p[2] AS VARCHAR), CAST(p[3] AS VARCHAR)), section_title, content_summary FROM K WHERE len(p) > 0",
        "line_scan_ranges": "WITH D AS (SELECT row_number() OVER (ORDER BY doc_id NULLS FIRST, text) AS d, string_split(regexp_replace(coalesce(text, '') || chr(10), '\\r\\n?', chr(10), 'g'), chr(10)) AS a FROM documents), U AS (SELECT d, unnest(range(1, len(a))) AS i, unnest(a[1:len(a) - 1]) AS line FROM D) SELECT row_number() OVER w AS line_number, CAST(coalesce(sum(length(line) + 1) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS char_start, line, true AS ended FROM U WINDOW w AS (ORDER BY d, i)",
        "regex_many": _many(),
        "regex_page_far": w + ALL + f" SELECT {SHOWN} FROM M ORDER BY {EVERY} LIMIT 50 OFFSET 20000",
        "regex_odd_patterns": w + L + ", N AS (SELECT doc_id, p.k, len(CASE p.k WHEN 0 THEN regexp_extract_all(line, '[a-z]{2}\\{') WHEN 1 THEN regexp_extract_all(line, '[A-Z]{4,}!') WHEN 2 THEN regexp_extract_all(line, 'a{0,2}re') ELSE [] END) AS n FROM L, (VALUES (0), (1), (2), (3)) p(k)) SELECT doc_id, CAST(k AS BIGINT) AS pattern_index, CAST(sum(n) AS BIGINT) AS n_matches, count(*) FILTER (n > 0) AS n_lines FROM N GROUP BY doc_id, k",
        "regex_json": w + _json(),
        "line_shapes": w + _shapes(),
        "discovered_headings": w + LEDGER,
        "tree_edit_log": w + T + " " + EDITED,
        "tree_edit_outcomes": w + T + HAD + OUTCOMES,
        "line_scan": w + L + " SELECT doc_id, line_number, line FROM L",
        "text_segment": "SELECT doc_id, substring(text, 51, 100) AS middle, '' AS past, substring(text, 1, 7) AS head, md5(substring(text, 101)) AS rest_md5, '' AS none FROM documents",
        "default_segment": "SELECT doc_id, substring(text, 1, 100) AS segment FROM documents",
        "char_length": "SELECT doc_id, length(text) AS n_chars FROM documents",
        "regex_matches": w + ALL + f" SELECT {SHOWN} FROM M",
        "regex_matches_exact": w + _m([0, 1]) + f" SELECT {SHOWN} FROM M",
        "regex_matches_bare": w + _m([0]) + f" SELECT {SHOWN} FROM M",
        "regex_null_groups": w + L + ", G AS (SELECT doc_id, line_number, regexp_extract_all(line, '([0-9]+)?([A-Z])[a-z]') AS f, regexp_extract_all(line, '([0-9]+)?([A-Z])[a-z]', 1) AS a, regexp_extract_all(line, '([0-9]+)?([A-Z])[a-z]', 2) AS b FROM L), U AS (SELECT doc_id, line_number, unnest(range(0, len(f))) AS match_ord, unnest(f) AS full_match, unnest(a) AS a, unnest(b) AS b FROM G) SELECT doc_id, line_number, match_ord, full_match, CASE WHEN coalesce(a, '') = '' THEN 'null' ELSE a END || '|' || b AS groups FROM U",
        "regex_counts_exact": w + L + ", G AS (SELECT doc_id, len(regexp_extract_all(line, 'th|ing')) AS a, len(regexp_extract_all(line, '([0-9]+)?([A-Z])[a-z]')) AS b FROM L) SELECT doc_id, CAST(0 AS BIGINT) AS pattern_index, CAST(sum(a) AS BIGINT) AS n_matches, count(*) FILTER (a > 0) AS n_lines FROM G GROUP BY doc_id UNION ALL SELECT doc_id, CAST(1 AS BIGINT), CAST(sum(b) AS BIGINT), count(*) FILTER (b > 0) FROM G GROUP BY doc_id",
        "regex_counts": w + ALL + " SELECT pattern_index, pattern, count(*) AS n_matches, count(DISTINCT (doc_id, line_number)) AS n_lines FROM M GROUP BY ALL",
        "regex_page": w + ALL + f" SELECT {SHOWN} FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY {IN_DOC}) AS n FROM M) WHERE n > 5 AND n <= 25",
        "regex_page_everywhere": w + ALL + f" SELECT {SHOWN} FROM M ORDER BY {EVERY} LIMIT 50 OFFSET 100",
        "regex_dedupe": w + ALL + f" SELECT {SHOWN} FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, line_number, pattern_index, full_match, groups ORDER BY match_ord) AS k FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY {IN_DOC}) AS n FROM M) WHERE n > 2) WHERE k = 1",
        "regex_payload": w + ALL + f""", R AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY {IN_DOC}) AS n FROM M),
D AS (SELECT *, row_number() OVER (PARTITION BY doc_id, line_number, pattern_index, full_match, groups ORDER BY match_ord) AS k FROM R WHERE n > 3),
E AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY {IN_DOC}) AS i FROM D WHERE k = 1),
G AS (SELECT doc_id, count(*) AS returned_matches, string_agg(full_match, '|' ORDER BY {IN_DOC}) AS sample FROM E WHERE i <= 10 GROUP BY doc_id),
Q AS (SELECT doc_id, count(*) AS total_matches, greatest(count(*) - 3, 0) AS matches_after_offset FROM M GROUP BY doc_id)
SELECT doc_id, coalesce(total_matches, 0) AS total_matches, coalesce(matches_after_offset, 0) AS matches_after_offset, coalesce(returned_matches, 0) AS returned_matches, coalesce(matches_after_offset, 0) > coalesce(returned_matches, 0) AS truncated, coalesce(sample, '') AS sample
FROM (SELECT DISTINCT doc_id FROM documents) LEFT JOIN Q USING (doc_id) LEFT JOIN G USING (doc_id)""",
        "regex_payload_count": w + ALL + " SELECT d.doc_id, count(M.doc_id) AS total_matches, greatest(count(M.doc_id) - 3, 0) AS matches_after_offset, CAST(0 AS BIGINT) AS returned_matches, false AS truncated FROM (SELECT DISTINCT doc_id FROM documents) d LEFT JOIN M USING (doc_id) GROUP BY d.doc_id",
        "excluded_lines": w + L + " SELECT doc_id, line_number, line FROM L WHERE NOT regexp_matches(line, '@')",
        "valid_headings": w + C + " SELECT doc_id, line_number, level, name, heading, hit_levels FROM H",
        "headings_after_empty_lines": w + L.replace("regexp_replace(text, ", "regexp_replace(regexp_replace(text, '[!?] ', chr(10) || chr(10), 'g'), ") + ", P AS (SELECT *, lag(line) OVER (PARTITION BY doc_id ORDER BY line_number) AS b FROM L) SELECT doc_id, line_number, regexp_extract(line, '^[A-Z][a-z]+') AS heading, 'before a list' AS unevaluated_filters FROM P WHERE regexp_matches(line, '^[A-Z][a-z]+') AND (b IS NULL OR trim(b) = '')",
        "heading_outline": w + O + " SELECT doc_id, line_number, level, parent_line, ordinal, orphan, path FROM A",
        "sections": w + _sections(40) + " SELECT doc_id, line_number, end_line, md5(body) AS body_md5, content_summary FROM X",
        "audit_gaps": w + C + ", G AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_number) AS a FROM C), R AS (SELECT *, a - row_number() OVER (PARTITION BY doc_id ORDER BY line_number) AS r FROM G WHERE NOT (h1 OR h2 OR h3)) SELECT doc_id, min(line_number) AS first_line, max(line_number) AS last_line, count(*) AS n_lines FROM R GROUP BY doc_id, r HAVING count(*) >= 2",
        "audit_collisions": w + C + " SELECT doc_id, line_number, line, concat_ws(',', CASE WHEN h1 THEN 'short' END, CASE WHEN h2 THEN 'article' END, CASE WHEN h3 THEN 'number' END) AS names FROM C WHERE CAST(h1 AS INT) + CAST(h2 AS INT) + CAST(h3 AS INT) > 1",
        "audit_sequence": "SELECT * FROM (SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS number, CAST(lag(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_partkey, l_suppkey) AS BIGINT) AS previous FROM lineitem) WHERE number - previous <> 1",
        "heading_sequence": w + O + ", Y AS (SELECT doc_id, line_number, parent_line, level, CAST(list_extract(string_split(regexp_extract(heading, '[0-9]{1,9}(?:\\.[0-9]{1,9})*'), '.'), -1) AS BIGINT) AS number FROM A WHERE regexp_matches(heading, '[0-9]')), Z AS (SELECT *, lag(number) OVER (PARTITION BY doc_id, parent_line, level ORDER BY line_number) AS previous FROM Y) SELECT doc_id, line_number, number, previous FROM Z WHERE number - previous <> 1",
        "pattern_stats": w + ALL + ", Y AS (SELECT pattern_index, doc_id, line_number, count(*) AS n FROM M GROUP BY ALL) SELECT pattern_index, CAST(sum(n) AS BIGINT) AS n_matches, count(*) AS n_lines, count(DISTINCT doc_id) AS n_docs, min(line_number) AS first_line, max(line_number) AS last_line, round(avg(line_number), 6) AS mean_line FROM Y GROUP BY pattern_index",
        "page_titles": f"SELECT page_id, {NORMAL.format("regexp_extract(html, '<h1[^>]*>([^<]*)</h1>', 1)")} AS title FROM pages",
        "tree_nodes": w + T + " SELECT ast_id, path, section_title, content_summary FROM T",
        "tree_children": w + T + " SELECT ast_id, p[2] AS index, section_title FROM K WHERE len(p) = 2 AND p[1] = 0",
        "tree_subtree": w + T + " SELECT ast_id, path, section_title FROM K WHERE p[1] = 1",
        "tree_find_title": w + T + " SELECT ast_id, path, section_title FROM (SELECT *, row_number() OVER (PARTITION BY ast_id ORDER BY p) AS n FROM K WHERE contains(lower(section_title), 'th')) WHERE n <= 3",
        "tree_resolve": w + T + f", V AS (SELECT ast_id, p[1] AS i, {NORMAL.format('section_title')} AS t, first_value(p[1]) OVER (PARTITION BY ast_id, {NORMAL.format('section_title')} ORDER BY p[1]) AS f FROM K WHERE len(p) = 1) SELECT ast_id, CASE WHEN t = '' THEN '' ELSE CAST(f AS VARCHAR) END AS path, count(*) AS n FROM V GROUP BY 1, 2",
        "tree_titles": w + T + " SELECT x.ast_id, x.path, coalesce(string_agg(y.section_title, ' / ' ORDER BY len(y.p)), '') AS titles FROM K x LEFT JOIN K y ON x.ast_id = y.ast_id AND len(y.p) > 0 AND len(y.p) <= len(x.p) AND x.p[1:len(y.p)] = y.p GROUP BY x.ast_id, x.path",
        "tree_insert": w + T + " SELECT ast_id, CASE WHEN path = '' THEN '' ELSE concat_ws('.', CAST(p[1] + 1 AS VARCHAR), CAST(p[2] AS VARCHAR), CAST(p[3] AS VARCHAR)) END AS path, section_title, content_summary FROM K UNION ALL SELECT ast_id, '0', 'Start', 'new' FROM K WHERE path = ''",
        "tree_insert_middle": w + T + " SELECT ast_id, CASE WHEN path = '' OR p[1] < 1 THEN path ELSE concat_ws('.', CAST(p[1] + 1 AS VARCHAR), CAST(p[2] AS VARCHAR), CAST(p[3] AS VARCHAR)) END AS path, section_title, content_summary FROM K UNION ALL SELECT ast_id, '1', 'Middle', 'new' FROM K WHERE path = '0'",
        "tree_upsert_new": w + T + " SELECT ast_id, path, section_title, content_summary FROM T UNION ALL SELECT ast_id, CAST(count(*) FILTER (len(p) = 1) AS VARCHAR), 'A title of its own', 'new' FROM K GROUP BY ast_id",
        "tree_upsert": w + T + " SELECT ast_id, path, section_title, CASE WHEN path <> '0' THEN content_summary WHEN content_summary = '' THEN ' note' ELSE regexp_replace(content_summary, '\\s+\\z', '') || chr(10) || 'note' END AS content_summary FROM T",
        "tree_update": w + T + " SELECT ast_id, path, CASE WHEN path = '0' THEN 'new ' || section_title ELSE section_title END AS section_title, content_summary FROM T",
        "tree_append_summary": w + T + " SELECT ast_id, path, section_title, CASE WHEN path <> '0.0' THEN content_summary WHEN content_summary = '' THEN chr(10) || ' more ' ELSE regexp_replace(content_summary, '\\s+\\z', '') || chr(10) || 'more ' END AS content_summary FROM T",
        "tree_json": w + T + " SELECT ast_id, path, section_title, content_summary FROM T",
        "tree_json_meta": "SELECT CAST(doc_id AS VARCHAR) AS ast_id, source || '.txt' AS file_name, doc_id % 7 AS rev, '2024-01-01T00:00:00+00:00' AS updated_at FROM documents",
        "trace_log": """WITH c AS (SELECT *, conv_id || '-' || turn AS id, conv_id || '-' || (turn - 1) AS answers FROM conversations), r AS (SELECT conv_id, answers, text FROM c WHERE role = 'assistant')
SELECT c.conv_id, turn AS idx, CAST(0 AS BIGINT) AS call_ord, CASE role WHEN 'user' THEN 'tool_call' WHEN 'assistant' THEN 'tool_result' ELSE 'human_message' END AS type,
  CASE role WHEN 'user' THEN c.id WHEN 'assistant' THEN c.answers END AS tool_call_id, CASE WHEN role = 'user' THEN 'ask' END AS tool_name, CASE WHEN role = 'user' THEN 'n=' || length(c.text) END AS args,
  CASE WHEN role NOT IN ('user', 'assistant') THEN c.text END AS content, CASE WHEN role = 'user' THEN c.text END AS ai_content, r.text AS output,
  CASE WHEN role = 'assistant' OR role = 'user' AND r.conv_id IS NOT NULL THEN 'success' END AS status
FROM c LEFT JOIN r ON c.role = 'user' AND c.conv_id = r.conv_id AND c.id = r.answers""",
    }
