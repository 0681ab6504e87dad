"""Blueprints, outlines, audits, trees and traces on small cases."""

import json
import random

import pytest
from pyspark.sql import functions as F

from quirespark.operators import audit, matches, outline, trace, tree
from quirespark.plans.blueprint import Blueprint
from quirespark.sources import text
from quirespark.sources.tree_store import TOKEN_LIFE, TreeStore

LEVELS = Blueprint([{"level": 1, "name": "one", "regex": "#1 .*"}, {"level": 2, "name": "two", "regex": "#2 .*", "parent_level": 1}, {"level": 3, "name": "three", "regex": "#3 .*", "parent_level": 2}])


def lines(spark, *texts):
    return text.lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))


def test_blueprint():
    bp = Blueprint([{"level": 1, "name": "a", "regex": "x"}, {"level": 1, "name": "b", "regex": "y", "validation_rules": None}], {"e": {"regex": "z"}})
    assert bp.rule_by_level(1).name == "a" and bp.rule_by_level(2) is None and Blueprint.from_json(bp.to_json()) == bp
    assert bp.hierarchy_structure[0].validation_rules.requires_line_start is True
    for bad in ({"level": 1, "name": "a", "regex": "("},):
        with pytest.raises(ValueError, match="Invalid regex"):
            Blueprint([bad])


def test_outline_and_orphans(spark):
    t = "\n".join(f"#{k} h{i}" for i, k in enumerate([1, 2, 1, 3, 2, 3]))
    o = outline.outline(outline.headings(lines(spark, t), LEVELS), LEVELS).orderBy("line_number").collect()
    assert [r.parent_line for r in o] == [0, 1, 0, 3, 3, 5]
    assert [r.orphan for r in o] == [False, False, False, True, False, False]
    assert [list(r.path) for r in o] == [[0], [0, 0], [1], [1, 0], [1, 1], [1, 1, 0]]
    with pytest.raises(ValueError):
        outline.outline(outline.headings(lines(spark, t), LEVELS), Blueprint([{"level": 1, "name": "x", "regex": "x", "parent_level": 1}]))


def test_validation_rules(spark):
    def found(rules, t, regex="H.*"):
        bp = Blueprint([{"level": 1, "name": "h", "regex": regex, "validation_rules": rules}], {"no": {"regex": "^skip"}})
        return [r.line_number for r in outline.headings(lines(spark, t), bp).orderBy("line_number").collect()]

    t = "H1\nx H2\n 　\nH3.\nHlonger\nskip H\nH!"
    assert found({}, t) == [1, 4, 5, 7] and found(None, t) == [1, 2, 4, 5, 7]
    assert found({"requires_line_start": False}, t) == [1, 2, 4, 5, 7]
    assert found({"max_length": 3}, t) == [1, 4, 7]
    assert found({"requires_prev_empty_line": True}, t) == [1, 4]
    assert found({"must_contain": ["H", "l"]}, t) == [5]
    assert found({"must_not_contain": ["1", "!"]}, t) == [4, 5]
    assert found({"must_not_end_with": [".", "!"]}, t) == [1, 5]
    bp = Blueprint([{"level": 1, "name": "h", "regex": "H", "validation_rules": {"context_filters": ["before a list"]}}])
    assert outline.headings(lines(spark, "H"), bp).first().unevaluated_filters == ["before a list"]


def test_sections(spark):
    ls = lines(spark, "intro\n#1 a\nb\n\nc\n#2 d\n#1 e\nf", "no heading")
    s = outline.sections(ls, outline.outline(outline.headings(ls, LEVELS), LEVELS), 2).orderBy("line_number").collect()
    assert [(r.line_number, r.end_line, r.body, r.content_summary) for r in s] == [(2, 5, "b\n\nc", "b\n"), (6, 6, "", ""), (7, 8, "f", "f")]


def test_audits(spark):
    bp = Blueprint([{"level": 1, "name": "a", "regex": "[0-9]+\\."}, {"level": 2, "name": "b", "regex": "[0-9]+\\.[0-9]+", "parent_level": 1}])
    ls = lines(spark, "x\ny\n1. a\n1.1 b\nz\n2. c\n4. d", "p\nq", "１. a\n２. b\n４. c")
    assert sorted((r.doc_id, r.first_line, r.last_line) for r in audit.gaps(ls, bp).collect()) == [(0, 1, 2), (0, 5, 5), (1, 1, 2), (2, 1, 3)]
    assert [(r.line_number, list(r.names)) for r in audit.collisions(ls, bp).collect()] == [(4, ["a", "b"])]
    wide = Blueprint([{"level": 1, "name": "a", "regex": "\\d+\\. .*"}])
    found = audit.sequence_breaks(outline.outline(outline.headings(ls, wide), wide)).collect()
    assert sorted((r.doc_id, r.line_number, r.previous, r.number) for r in found) == [(0, 7, 2, 4), (2, 3, 2, 4)]


def test_trace(spark):
    call = lambda *ids: [("f", "{}", i) for i in ids]
    rows = [(1, 0, "human", "q", None, None, None), (1, 1, "ai", "go", call("a", "b"), None, None), (1, 2, "tool", "old", None, "a", "error"), (1, 3, "tool", "new", None, "a", "success"), (1, 4, "ai", "done", [], None, None), (1, 5, "system", "s", None, None, None)]
    m = spark.createDataFrame(rows, "conv_id long, idx int, type string, content string, tool_calls array<struct<name:string,args:string,id:string>>, tool_call_id string, status string")
    said = json.loads(trace.as_json(trace.flatten_trace(m)).where("idx = 4").first().json)
    assert said["type"] == "ai_thought" and said["content"] == "done" and "output" in said and said["output"] is None
    got = [(r.type, r.idx, r.call_ord, r.content, r.output, r.status) for r in trace.flatten_trace(m).orderBy("idx", "call_ord").collect()]
    assert got == [("human_message", 0, 0, "q", None, None), ("tool_call", 1, 0, None, "new", "success"), ("tool_call", 1, 1, None, None, None), ("tool_result", 2, 0, None, None, "error"), ("tool_result", 3, 0, None, None, "success"), ("ai_thought", 4, 0, "done", None, None)]


JSON = '{"root": {"section_title": "R", "children": [{"section_title": "X", "content_summary": "x"}, {"section_title": "X", "content_summary": "y", "children": [{"section_title": "c"}]}]}}'


def test_tree_json_and_titles(spark):
    n = tree.nodes_from_json(spark.createDataFrame([("t", JSON)], "ast_id string, json string"))
    again = tree.nodes_from_json(tree.nodes_to_json(n))
    key = lambda rows: sorted((list(r.path), r.section_title, r.content_summary) for r in rows)
    assert key(n.collect()) == key(again.collect())
    wanted = spark.createDataFrame([("t", x) for x in (["R"], [], [" X "], ["R", "X"], ["X", "c"], ["", "X"], ["x"])], "ast_id string, titles array<string>")
    got = {tuple(r.titles): r.path for r in tree.resolve(n, wanted, 2).collect()}
    assert got == {("R",): [], (): [], (" X ",): [0], ("R", "X"): [0], ("X", "c"): None, ("", "X"): [0], ("x",): None}
    t = {tuple(r.path): list(r.titles) for r in tree.titles_of(n, n.select("ast_id", "path")).collect()}
    assert t == {(): [], (0,): ["X"], (1,): ["X"], (1, 0): ["X", "c"]}
    assert [list(r.path) for r in tree.find_by_title(n, "x", max_results=0).collect()] == [[0]] and not tree.find_by_title(n, "").take(1)
    with pytest.raises(Exception, match="not a list"):
        tree.nodes_from_json(spark.createDataFrame([("t", '{"root": {"children": 3}}')], "ast_id string, json string")).collect()


EDIT = "ast_id string, path array<int>, position int, section_title string, content_summary string"


def test_tree_edits_that_cannot_be(spark):
    """Two edits of one tree, a node that isn't there and a place outside fail; edits of other trees change nothing."""
    n = tree.nodes_from_json(spark.createDataFrame([("t", JSON), ("u", JSON)], "ast_id string, json string"))
    edit = lambda *rows: spark.createDataFrame(list(rows), EDIT)
    for bad, what in (([("t", [], 0, "a", "b"), ("t", [0], 0, "a", "b")], "more than one edit"), ([("t", [7], 0, "a", "b")], "no node"), ([("t", [], 3, "a", "b")], "out of range"), ([("t", [], -1, "a", "b")], "out of range")):
        with pytest.raises(Exception, match=what):
            tree.insert(n, edit(*bad)).collect()
    with pytest.raises(Exception, match="no node"):
        tree.update(n, edit(("t", [7], None, "a", "b"))).collect()
    key = lambda df: sorted((r.ast_id, list(r.path), r.section_title, r.content_summary) for r in df.collect())
    assert key(tree.insert(n, edit(("x", [], 0, "a", "b")))) == key(tree.upsert(n, edit().limit(0))) == key(n)
    got = key(tree.insert(n, edit(("t", [], 1, "mid", "m"))))
    assert [(p, t) for a, p, t, _ in got if a == "t"] == [([], "R"), ([0], "X"), ([1], "mid"), ([2], "X"), ([2, 0], "c")] and [x for x in got if x[0] == "u"] == [x for x in key(n) if x[0] == "u"]
    up = key(tree.upsert(n, edit(("t", [], None, " X\u3000", " more"), ("u", [1], None, "new", "s"))))
    assert [(p, s) for a, p, _, s in up if a == "t"] == [([], ""), ([0], "x\nmore"), ([1], "y"), ([1, 0], "")]
    assert [(p, t) for a, p, t, _ in up if a == "u"] == [([], "R"), ([0], "X"), ([1], "X"), ([1, 0], "c"), ([1, 1], "new")]


def test_tree_json_with_meta(spark):
    made = spark.createDataFrame([("t", '{"file_name": "f", "__meta__": {"rev": 4, "updated_at": "now"}, "root": {"section_title": "R"}}'), ("u", JSON)], "ast_id string, json string")
    meta = tree.meta_from_json(made)
    assert sorted(map(tuple, meta.collect())) == [("t", "f", 4, "now"), ("u", None, 0, None)]
    got = {r.ast_id: json.loads(r.json) for r in tree.nodes_to_json(tree.nodes_from_json(made), meta).collect()}
    assert got["t"] == {"file_name": "f", "__meta__": {"rev": 4, "updated_at": "now"}, "root": {"section_title": "R", "content_summary": "", "children": []}}
    assert got["u"]["file_name"] is None and got["u"]["__meta__"] == {"rev": 0, "updated_at": None}


def test_patterns_that_only_python_runs(spark):
    """Counts, statistics, headings and exclusions go to Python where Java can't express the pattern."""
    ls = lines(spark, "ab\nac\nxb\nb\nc", "(?")
    p = r"(a)?(?(1)b|c)"
    assert [(r.n_matches, r.n_lines) for r in matches.match_counts(ls, ["b", p]).orderBy("pattern_index").collect()] == [(3, 3), (3, 3)]
    s = audit.pattern_stats(ls, [p]).first()
    assert (s.n_matches, s.n_lines, s.n_docs, s.first_line, s.last_line) == (3, 3, 1, 1, 5)
    bp = Blueprint([{"level": 1, "name": "h", "regex": p}], {"no": {"regex": r"(x)?(?(1)b|\Z\A)"}})
    assert [(r.line_number, r.heading) for r in outline.headings(ls, bp).orderBy("line_number").collect()] == [(1, "ab"), (5, "c")]
    assert ls.where(~outline.excluded(bp)).count() == 5


def test_tree_edits_follow_a_model(spark):
    """Random edits against nested lists."""
    rng = random.Random(3)
    model = {"section_title": "R", "content_summary": "", "children": []}
    nodes = spark.createDataFrame([("t", [], "R", "")], tree.SCHEMA)
    for k in range(6):
        at, node = [], model
        while node["children"] and rng.random() < 0.6:
            i = rng.randrange(len(node["children"]))
            at, node = [*at, i], node["children"][i]
        if k % 3 < 2:
            pos = rng.choice([None, rng.randint(0, len(node["children"]))])
            node["children"].insert(len(node["children"]) if pos is None else pos, {"section_title": f"n{k}", "content_summary": "s", "children": []})
            nodes = tree.insert(nodes, spark.createDataFrame([("t", at, pos, f"n{k}", "s")], "ast_id string, path array<int>, position int, section_title string, content_summary string"))
        else:
            node["content_summary"] = f"u{k}"
            nodes = tree.update(nodes, spark.createDataFrame([("t", at, None, f"u{k}")], tree.SCHEMA))
        nodes = spark.createDataFrame(nodes.collect(), tree.SCHEMA)
    assert tree.nested(nodes.collect()) == model


def test_tree_store(spark, tmp_path):
    now = [0.0]
    s = TreeStore(spark, str(tmp_path / "t"), clock=lambda: now[0])
    with pytest.raises(FileNotFoundError):
        s.load()
    s.init("doc.txt")
    meta = s.load_meta("append_child", [])
    assert meta["rev"] == 0 and s.append_child(meta["edit_token"], "A", "a \n") == {"ok": True, "rev": 1, "updated_at": "1970-01-01T00:00:00+00:00"}
    with pytest.raises(PermissionError, match="unknown"):
        s.append_child(meta["edit_token"], "A", "a")
    token = s.load_meta("upsert_child")["edit_token"]
    with pytest.raises(PermissionError, match="purpose"):
        s.append_child(token, "B", "b")
    with pytest.raises(PermissionError, match="node"):
        s.upsert_child(token, "B", "b", path=[0])
    assert s.upsert_child(token, " A", " b")["rev"] == 2 and s.load([0])["content_summary"] == "a\nb"
    late = s.load_meta("update_node", titles=["A"])["edit_token"]
    now[0] = TOKEN_LIFE + 1
    with pytest.raises(PermissionError, match="ended"):
        s.update_node(late, "Z", titles=["A"])
    stale, fresh = s.load_meta("append_to_summary", [0])["edit_token"], s.load_meta("ensure_path")["edit_token"]
    assert s.ensure_path(fresh, ["doc.txt", "A", "new"], create_missing=True, default_summary="d") == {"path": [0, 0], "created": True, "ok": True, "rev": 3, "updated_at": "1970-01-01T00:10:01+00:00"}
    assert s.load([0, 0])["content_summary"] == "d" and s.list_children(include_children=False) == s.load_meta("x", include_children=False)["children"] == []
    with pytest.raises(PermissionError, match="revision"):
        s.append_to_summary(stale, "x", [0])
    with pytest.raises(ValueError):
        s.append_child(s.load_meta("append_child")["edit_token"], "B", "b", position=9)
    with pytest.raises(ValueError):
        s.load([-1])
    assert s.find_by_title("NEW") == [{"path": [0, 0], "section_title": "new"}] and s.list_children(titles=["A"]) == [{"index": 0, "section_title": "new"}]
    assert s.resolve_path(["A", "new"]) == [0, 0]
    whole = json.loads(s.to_json())
    assert list(whole) == ["file_name", "__meta__", "root"] and whole["file_name"] == "doc.txt" and whole["__meta__"] == {"rev": 3, "updated_at": "1970-01-01T00:10:01+00:00"}
    assert s.call("nothing")["ok"] is False and s.call("load", path=[9])["error"].startswith("no node") and s.call("find_by_title", query="A")["result"][0]["path"] == [0]
    old = s.load_meta("append_child")["edit_token"]
    s.init("again.txt")
    with pytest.raises(PermissionError, match="revision"):
        s.append_child(old, "B", "b")


def test_tree_of_sections(spark):
    ls = lines(spark, "#1 a\ntext\n#2 b")
    n = tree.from_sections(outline.sections(ls, outline.outline(outline.headings(ls, LEVELS), LEVELS)))
    assert sorted((list(r.path), r.section_title) for r in n.collect()) == [([], "0"), ([0], "#1 a"), ([0, 0], "#2 b")]
    assert n.where(F.col("ast_id") == "0").count() == 3
