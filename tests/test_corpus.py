"""Line ranges, edit logs, many patterns, discovery and results as JSON, against plain Python."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from quirespark.functions import dialect
from quirespark.operators import audit, edits, matches, outline, prefilter, tree
from quirespark.plans import discover
from quirespark.sources import ranges, text


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


# Ranges

FILES = {"a": "﻿A\r\nB\rC\n\nD E\n", "b": "", "c": "\n", "d": "x", "e": "é\r\n\r\n\r\rz\r", "f": "﻿q", "g": "end\r\n", "i": "﻿x\r"}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at, rng = tmp_path_factory.mktemp("ranges"), random.Random(1)
    files = FILES | {"h": "".join(rng.choice(["abc", "é", "\r\n", "\n", "\r", "\U0001f7e2", "  ", "w"]) for _ in range(9000))}
    for k, v in files.items():
        (at / k).write_bytes(v.encode())
    before = {c: spark.conf.get(c) for c in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1024")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield str(at), {k: re.sub("\r\n?", "\n", v) for k, v in files.items()}
    for c, v in before.items():
        spark.conf.set(c, v)


@pytest.mark.parametrize("most", [0, 1000])
def test_ranges_give_the_lines_of_files(spark, folder, monkeypatch, most):
    monkeypatch.setattr(ranges, "MOST_BROADCAST", most)
    assert ranges.ranges(spark, folder[0]).where("file like '%/h'").count() > 10
    got = ranges.scan_lines(spark, folder[0]).collect()
    for k, t in folder[1].items():
        rows = sorted((r for r in got if r.file.endswith("/" + k)), key=lambda r: r.line_number)
        parts = t.split("\n")
        want, at = [], 0
        for i, p in enumerate(parts[:-1] if parts[-1] == "" else parts):
            want.append((i + 1, at, p, at + len(p) < len(t)))
            at += len(p) + 1
        assert [(r.line_number, r.char_start, r.line, r.ended) for r in rows] == want


def test_ranges_together_and_segments(spark, folder):
    every = ranges.scan_lines(spark, folder[0], together=True).orderBy("line_number").collect()
    assert [r.line_number for r in every] == list(range(1, len(every) + 1))
    lines = ranges.scan_lines(spark, folder[0])
    for start, length in ((0, 5), (7, 100), (300, 2000), (9000, None), (10**7, 5), (-3, 4), (3000, -1), (5, 0)):
        pieces = sorted(ranges.segment_pieces(lines, start, length).collect(), key=lambda r: r.line_number)
        for k, t in folder[1].items():
            begin = max(start, 0)
            want = t[begin:] if length is not None and length < 0 else t[begin : begin + (100 if length is None else length)]
            assert "".join(r.piece for r in pieces if r.file.endswith("/" + k)) == want


def test_ranges_refuse_other_encodings(spark, tmp_path):
    (tmp_path / "x").write_bytes(b"ok\n\xff\xfe\xfa\n")
    with pytest.raises(Exception, match="not UTF-8"):
        ranges.scan_lines(spark, str(tmp_path)).collect()


# Edits

NODE = "ast_id string, path array<int>, section_title string, content_summary string"
LOG = "ast_id string, edit_no int, action string, path array<int>, titles array<string>, position int, section_title string, content_summary string, append_text string, create_missing boolean"


def plain_replay(nodes, log):
    """The same by nested dictionaries, an edit after the other."""
    norm = lambda t: " ".join((t or "").split())
    trees, out = {}, []
    for name, path, title, summary in sorted(nodes, key=lambda n: (n[0], n[1])):
        node = {"t": title, "s": summary, "kids": []}
        if path:
            kids = trees[name]["kids"]
            for i in path[:-1]:
                kids = kids[i]["kids"]
            kids.append(node)
        else:
            trees[name] = node
    for name, no, action, path, titles, position, title, summary, more, make in sorted(log, key=lambda e: (e[0], e[1])):
        root = trees.get(name)

        def go(to):
            node = root
            for i in to:
                if i < 0 or i >= len(node["kids"]):
                    return None
                node = node["kids"][i]
            return node

        def look(create):
            at, left = [], [t for t in titles if t.strip()]
            left = left[1:] if left and norm(left[0]) == norm(root["t"]) else left
            for t in left:
                kids = go(at)["kids"]
                same = [i for i, k in enumerate(kids) if norm(k["t"]) == norm(t)]
                if not same and not create:
                    return None
                if not same:
                    kids.append({"t": t, "s": summary or "", "kids": []})
                at.append(same[0] if same else len(kids) - 1)
            return at

        join = lambda old: f"{old.rstrip()}\n{(summary if action == 'upsert_child' else more).lstrip()}" if old else (summary if action == "upsert_child" else more)
        ok, where = False, None
        if root is not None:
            if action == "ensure_path":
                where = look(make) if titles else None
                ok = where is not None
            else:
                where = look(False) if titles else path or []
                node = go(where) if where is not None and titles != [] else None
                kids = node and node["kids"]
                if node is None:
                    pass
                elif action == "append_child" and summary is not None and (position is None or 0 <= position <= len(kids)):
                    at = len(kids) if position is None else position
                    kids.insert(at, {"t": title, "s": summary, "kids": []})
                    ok, where = True, [*where, at]
                elif action == "upsert_child" and title and summary is not None:
                    same = [i for i, k in enumerate(kids) if norm(k["t"]) == norm(title)]
                    if same:
                        kids[same[0]]["s"] = join(kids[same[0]]["s"])
                    else:
                        kids.append({"t": title, "s": summary, "kids": []})
                    ok, where = True, [*where, same[0] if same else len(kids) - 1]
                elif action == "update_node" and (title is not None or summary is not None):
                    node["t"], node["s"] = node["t"] if title is None else title, node["s"] if summary is None else summary
                    ok = True
                elif action == "append_to_summary" and more is not None:
                    node["s"], ok = join(node["s"]), True
        out.append((name, no, ok, where if ok else None))
    after = []

    def walk(name, node, path):
        after.append((name, path, node["t"], node["s"]))
        for i, k in enumerate(node["kids"]):
            walk(name, k, [*path, i])

    for name, root in trees.items():
        walk(name, root, [])
    return after, out


def test_edit_logs_follow_a_plain_replay(spark):
    rng = random.Random(5)
    titles = ["a", "b", " a ", "c　d", "c d", None, ""]
    nodes = []
    for n in range(12):
        for path in ([], [0], [1], [0, 0], [0, 1], [1, 0], [0, 1, 0]):
            nodes.append((f"t{n:02d}", path, "root" if not path else rng.choice(titles), rng.choice(["", "old ", "x\n"])))
    log = []
    for n in range(14):
        for no in range(40 if n != 3 else 400):
            action = rng.choice(["append_child", "upsert_child", "update_node", "append_to_summary", "ensure_path", "other"])
            path = [rng.randrange(-1, 3) for _ in range(rng.randrange(4))]
            named = rng.choice([None, None, [], ["root", rng.choice("abz")], [rng.choice("abz"), rng.choice("abz"), " "]])
            log.append((f"t{n:02d}", no, action, path or None, named, rng.choice([None, None, 0, 1, 5, -1]), rng.choice(["a", "new", None, ""]), rng.choice(["s", " s", None, ""]), rng.choice([" more", None, ""]), rng.choice([True, False, None])))
    replayed = edits.replay(spark.createDataFrame(nodes, NODE).repartition(5), spark.createDataFrame(log, LOG).repartition(7)).cache()
    after, out = plain_replay(nodes, log)
    got = [(r.ast_id, list(r.path), r.section_title, r.content_summary) for r in edits.nodes_after(replayed).collect()]
    assert sorted(got, key=repr) == sorted(after, key=repr)
    done = edits.outcomes(replayed).collect()
    assert sorted((r.ast_id, r.edit_no, r.ok, None if r.path is None else list(r.path)) for r in done) == sorted(out)
    assert all((r.error is None) == r.ok for r in done) and {r.error for r in done if r.ast_id == "t13"} == {"no such tree"}
    assert edits.replay(spark.createDataFrame([], NODE), spark.createDataFrame([], LOG)).collect() == []


def test_many_lists_of_titles_follow_a_plain_replay(spark):
    rng = random.Random(6)
    titles = ["a", "b", " a ", "c　d", "c d", "", "root", "e"]
    nodes = [(f"t{n}", path, "root" if not path else rng.choice(titles[:5]), "s") for n in range(10) for path in ([], [0], [1], [0, 0], [0, 1])]
    lists = [(f"t{n}", no, [rng.choice(titles) for _ in range(rng.randrange(1, 5))]) for n in range(12) for no in range(rng.randrange(0, 14))]
    log = [(t, no, "ensure_path", None, names, None, None, "", None, True) for t, no, names in lists]
    want, out = plain_replay(nodes, log)
    every, found = tree.ensure_paths(spark.createDataFrame(nodes, NODE), spark.createDataFrame(lists, "ast_id string, no int, titles array<string>"), 4)
    assert sorted(((r.ast_id, list(r.path), r.section_title, r.content_summary) for r in every.collect()), key=repr) == sorted(want, key=repr)
    got = found.collect()
    assert sorted((r.ast_id, r.no, True, list(r.path)) for r in got) == sorted(x for x in out if x[2])
    had = {(t, tuple(p)) for t, p, *_ in nodes}
    assert all(r.created == ((r.ast_id, tuple(r.path)) not in had) for r in got)


# Many patterns


def test_needed_texts():
    n = prefilter.needed
    assert n("abc") == {"abc"} and n("x*abcd+e") == {"abc"} and n("(?:foo|bar)[0-9]") == {"foo", "bar"} and n("(?i)abc") is None
    assert n("a?b*") is None and n("(?:abc)?") is None and n("(abc){2}x") == {"abc"} and n("(?i:abc)de") == {"de"} and n("[ab]c|d") is None
    assert n("abc(?=def)") == {"abc"} and n("(?:ab|c)zzz") == {"zzz"}


def test_many_patterns_follow_single_ones(spark):
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(200)]
    given = [rng.choice(["{}", r"\b{}\b", "({})?{}x", "(?:{}|{}z)[0-9]*", "{}+(?P<n>.)?"]).replace("{}", "%s") for _ in words]
    given = [g.replace("%s", w) for g, w in zip(given, words)] + ["[0-9]+", "(?i)ABC", " ", "x*"]
    lines = [" ".join(rng.choice(words + ["x9", "Abc", "é1"]) + rng.choice(["", "x", "z7"]) for _ in range(rng.randrange(12))) for _ in range(120)] + [""]
    ls = text.lines(docs(spark, "\n".join(lines), None, ""))
    got, want = (sorted(map(repr, map(tuple, d.select("doc_id", "line_number", "pattern_index", "pattern", "match_ord", "full_match", "groups", "line").collect()))) for d in (prefilter.match_many(ls, given), matches.match_table(ls, given, exact=True)))
    assert got == want and "line" not in prefilter.match_many(ls, given, line_text=False).columns
    runs = {r.pattern_index: r.n_runs for r in prefilter.match_many(ls, given, counted=True).collect()}
    always = [k for k, p in enumerate(dialect.patterns(given)) if prefilter.needed(p.source) is None]
    assert all(runs[k] == ls.count() for k in always) and sum(runs.values()) < 0.1 * len(given) * ls.count()


# Dialect

ODD = ["a{", "a{b", "a{,}", "(?#note)a", r"\0", "{a}", "a{1,2}{", r"\101", r"[\0-\07]", "a{2}", "b{,2}", "a{ 1}", "a}"]


def test_odd_patterns(spark):
    lines = ["a{", "a{b", "aaa", "a{,}", "x\x00y", "{a}", "aa{", "A\x05", "bb", "a{ 1}", "a}"]
    ls = text.lines(docs(spark, "\n".join(lines)))
    want = sorted((n, k, i, m[0]) for n, line in enumerate(lines, 1) for k, p in enumerate(ODD) for i, m in enumerate(re.finditer(p, line)))
    got = matches.match_table(ls, ODD).collect()
    assert sorted((r.line_number, r.pattern_index, r.match_ord, r.full_match) for r in got) == want
    counts = {r.pattern_index: r.n_matches for r in matches.match_counts(ls, ODD).collect()}
    assert counts == {k: sum(1 for _, q, *_ in want if q == k) for k in range(len(ODD))}
    assert {r.pattern_index for r in audit.pattern_stats(ls, ODD).collect()} == {q for _, q, *_ in want}


def test_what_java_refuses_goes_to_python(spark):
    assert dialect.pattern("(a)(?(1)b|c)").exact and not dialect.pattern("a{b").exact
    assert not dialect._java_takes("(?Ud)a{b")


# Paging and JSON


def test_places_far_off(spark):
    d = docs(spark, *["a " * (k % 7) for k in range(60)]).union(spark.createDataFrame([(None, "a a a a")], "doc_id long, text string"))
    m = matches.match_table(text.lines(d), ["a"])
    whole = [(r.doc_id, r.line_number, r.match_ord) for r in m.orderBy(*matches.ORDER).collect()]
    for offset in (1, 3, 4, 5, 50, 100, len(whole) - 1, len(whole), len(whole) + 5):
        got = [(r.doc_id, r.line_number, r.match_ord) for r in matches.after(m, offset, top=2).orderBy(*matches.ORDER).collect()]
        assert got == whole[offset:], offset


def plain_result(name, t, given, limit, offset, budget, count_only, dedupe, line_text):
    """The result by json and re: samples go from the end until the text fits."""
    found = []
    for n, line in enumerate(t.split("\n")[: None if t and not t.endswith("\n") else -1], 1):
        for k, p in enumerate(given):
            for m in re.finditer(p, line):
                match = m[0] if not m.re.groups else m[1] if m.re.groups == 1 else list(m.groups())
                found.append({"pattern_index": k, "pattern": p, "line_number": n, "match": match, "full_match": m[0]} | ({"line": line} if line_text else {}))
    rest, sample = found[offset:], []
    for r in rest:
        if not count_only and len(sample) < limit and not (dedupe and r in sample):
            sample.append(r)
    out = {"ok": True, "file_path": str(name), "regex_pattern": given[0], "regex_patterns": given, "total_matches": len(found), "offset_matches": offset, "matches_after_offset": len(rest), "returned_matches": len(sample), "truncated": not count_only and len(rest) > len(sample), "count_only": count_only, "dedupe": dedupe, "saved_to": None, "include_line_text": line_text, "sample": sample, "hint": matches.HINT}
    said = lambda: json.dumps(out, ensure_ascii=False)
    while not count_only and len(said()) > budget and sample:
        sample.pop()
        out |= {"returned_matches": len(sample), "truncated": True}
    if not count_only and len(said()) > budget:
        out |= {"sample": [], "returned_matches": 0, "truncated": True, "hint": matches.NO_ROOM}
    return said()


def test_results_as_json(spark):
    given = ["[a-z]+", r"(\d)(x)?", r"(q)?\"", "none"]
    texts = ['ab 1x 2 "q" é\\ \x07\t/', "no 3x\nmore \U0001f7e2 4 words here", "!", "", "z" * 300 + "\n" + "word " * 60]
    d = docs(spark, *texts)
    m = matches.match_table(text.lines(d), given, exact=True)
    for offset, limit, budget, dedupe, bare, count_only in ((0, 50, 8000, False, False, False), (1, 5, 700, False, False, False), (0, 50, 1500, True, True, False), (0, 50, 10, False, False, False), (2, 3, 620, False, True, False), (0, 0, 8000, False, False, False), (0, 5, 8000, False, False, True)):
        payload = matches.match_payload(m.drop("line") if bare else m, offset, limit, dedupe, count_only, docs=d)
        got = {r.doc_id: r for r in matches.result_json(payload, given, offset, budget, count_only, dedupe, line_text=not bare).collect()}
        for i, t in enumerate(texts):
            want = plain_result(i, t, given, limit, offset, budget, count_only, dedupe, not bare)
            told = json.loads(want)
            assert got[i].json == want and got[i].returned_matches == told["returned_matches"] and got[i].truncated == told["truncated"]
        assert matches.regex_result(docs(spark, texts[0]), given[0], given, limit, offset, budget, count_only, dedupe, include_line_text=not bare) == got[0].json
    assert json.loads(matches.regex_result(docs(spark), "a"))["total_matches"] == 0


# Discovery


def test_shapes(spark):
    cases = {"1. One": "0:9.", "  1.2.3 x": "2:9.9.9", "§ 4 Text": "0:§ 9", "(a) x": "0:(a)", "IV. x": "0:I.", "B) x": "0:A)", "Chapter 12": "0:Chapter 9", "第３章 x": "0:第9章", "■ x": "0:■", "<<7>> x": "0:<<9>>", "## x": "0:##", "Plain text.": "plain", "   ": None, "a b": "plain", "【1】x": "0:【9】"}
    got = {r.line: r.s for r in spark.createDataFrame([(k,) for k in cases], "line string").select("line", discover.shape(F.col("line")).alias("s")).collect()}
    assert got == cases
    for line, s in cases.items():
        if s and s != "plain":
            assert re.match(discover.pattern_of(s), line), (line, s)
    assert not re.match(discover.pattern_of("0:9.9"), "1.2.3 x") and not re.match(discover.pattern_of("0:9."), "1.2 x")


def test_review_and_refinement(spark):
    from quirespark.plans.blueprint import Blueprint

    t = "# 1. a\n* 1\n* 2\n* 9\n* 3\n# 2. b\n* 1\n## 5 c\n## 4 d\n## 3 e"
    bp = Blueprint([{"level": 1, "name": "top", "regex": "# .*"}, {"level": 2, "name": "sub", "regex": "## .*", "parent_level": 1}, {"level": 3, "name": "item", "regex": "[*] .*", "parent_level": 2}, {"level": 4, "name": "none", "regex": "zzz", "parent_level": 3}, {"level": 5, "name": "again", "regex": "# 2.*", "parent_level": 1}])
    ls = text.lines(docs(spark, t, t, "nothing"))
    got = {r.name: tuple(r)[2:] for r in discover.review(ls, bp).collect()}
    assert got == {"top": (4, 2, 2, 0, 4, 0), "sub": (6, 2, 0, 0, 6, 4), "item": (10, 2, 0, 10, 10, 2)}
    new = discover.refine(ls, bp, most_collisions=0.5)
    assert [(r.level, r.name, r.parent_level) for r in new.hierarchy_structure] == [(1, "top", None), (2, "item", 1)]
    assert discover.refine(ls, Blueprint([])).hierarchy_structure == []


def test_discovery_finds_planted_levels(spark):
    rng = random.Random(8)

    def text_of(n):
        out = ["Some opening words that are not a heading at all."]
        for a in range(1, rng.randrange(2, 5)):
            out.append(f"<<{a}>> Part of the book")
            for b in range(1, rng.randrange(2, 4)):
                out.append(f"Teil {a}-{b}: heading")
                for c in range(rng.randrange(1, 4)):
                    out.append(f"  {'abc'[c]}] point")
                    out += ["Body text goes on and on in plain words, line after line."] * rng.randrange(1, 4)
        return "\n".join(out)

    d = docs(spark, *[text_of(n) for n in range(30)], "7 stray number", "", None)
    bp = discover.discover(text.lines(d))
    assert [(r.level, r.name, r.parent_level) for r in bp.hierarchy_structure] == [(1, "0:<<9>>", None), (2, "0:Teil 9-9:", 1), (3, "2:a]", 2)]
    placed = outline.outline(outline.headings(text.lines(d), bp), bp)
    assert placed.where("orphan").count() == 0 and placed.where("level = 3").count() == sum(t.count("] point") for t in (r.text or "" for r in d.collect()))
    assert discover.discover(text.lines(docs(spark, "", None))).hierarchy_structure == []


def test_discovery_and_review_make_the_lines_once(spark):
    """Lines may be dear, and so are the patterns on them."""
    from quirespark.plans.blueprint import Blueprint

    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(line):
        made.add(1)
        return line

    ls = text.lines(docs(spark, *["1. One\nwords\n\n (a) x\nmore\n (b) y\nwords"] * 20))
    counted = ls.withColumn("line", seen("line"))
    bp = discover.discover(counted)
    assert [(r.level, r.name, r.parent_level) for r in bp.hierarchy_structure] == [(1, "0:9.", None), (2, "1:(a)", 1)] and made.value == 140
    got = {r.name: tuple(r)[2:] for r in discover.review(counted, bp).collect()}
    assert got == {"0:9.": (20, 20, 0, 0, 20, 0), "1:(a)": (40, 20, 0, 0, 40, 0)} and made.value == 280
    assert outline.outline(outline.headings(ls, Blueprint([])), Blueprint([])).count() == 0


def test_patterns_run_once_a_line(spark):
    """By the plan: no pattern stands in it more than once."""
    from quirespark.plans.blueprint import Blueprint

    ls = text.lines(docs(spark, "H1 a\nb", "", None))
    bp = Blueprint([{"level": 1, "name": "h", "regex": "H1.*"}, {"level": 2, "name": "maybe empty", "regex": "zz*|$", "parent_level": 1}])
    found = outline.headings(ls, bp)
    assert [tuple(r)[:6] for r in found.orderBy("doc_id", "line_number").collect()] == [(0, 1, 1, "h", "H1 a", [1])]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("H1.*") == 1
    shapes = discover.shape_stats(ls)._jdf.queryExecution().executedPlan().toString()
    assert shapes.count("IVXLCDM]+[.)") == 1


def test_ledger_against_plain_python(spark, tmp_path):
    """Orders of one key, without items or keys, items without a number or before the first."""
    from quirespark import queries

    orders = [(1, 1, "a"), (1, 1, "b"), (2, 1, "c"), (3, 2, "x"), (3, 1, "y"), (None, 3, "n"), (5, None, "m"), (7, 7, "z")]
    items = [(1, 1), (1, 1), (1, 2), (2, -1), (2, 3), (2, None), (3, 1), (5, 4), (9, 1), (None, 1)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame(items, "l_orderkey long, l_linenumber int").write.parquet(f"{tmp_path}/lineitem.parquet")
    want = {}
    for key, customer, priority in orders:
        mine = [((key or 0), 0, None if key is None else f"§ {key} {priority}")]
        for k, n in items:
            if k == key is not None:
                far = 10**9
                mine += [(key, far if n is None else 2 * n - 1, None if n is None else f"  ({n}) item"), (key, far + 1 if n is None else 2 * n, "packed as ordered")]
        want.setdefault(customer, []).extend(mine)
    got = {}
    for r in queries._ledger(spark, str(tmp_path)).orderBy("doc_id", "line_number").collect():
        got.setdefault(r.doc_id, []).append(r.line)
        assert r.line_number == len(got[r.doc_id])
    assert got == {c: [x[2] for x in sorted(rows, key=lambda x: x[:2])] for c, rows in want.items()}


# Context, numbering, summaries


def test_context_filters(spark):
    from quirespark.operators.context import Context
    from quirespark.plans.blueprint import Blueprint

    def found(filters, t, contexts=None):
        bp = Blueprint([{"level": 1, "name": "h", "regex": "H.*", "validation_rules": {"context_filters": filters}}], {"no": {"regex": "^skip"}})
        rows = outline.headings(text.lines(docs(spark, t)), bp, **({"contexts": contexts} if contexts else {})).orderBy("line_number").collect()
        return [r.line_number for r in rows], {x for r in rows for x in r.unevaluated_filters}

    t = "H1\n  in\nH2\nskip\n  in\nH3\n\nH4\n\n- a\nH5\n1. b\nHH6\nHH longer than it"
    assert found(["followed by an indented line"], t) == ([1], set())
    assert found(["followed by a list"], t) == ([11], set())
    assert found(["between empty lines"], t) == ([8], set()) and found(["followed by an empty line"], t)[0] == [6, 8, 14]
    assert found(["followed by a longer line", "in words"], t) == ([1, 3, 11, 13], {"in words"})
    own = {"two before is H1": Context(2, 0, lambda at: at(-2) == "H1")}
    assert found(["two before is H1", "followed by a list"], t, own) == ([3], {"followed by a list"})


def test_numbers_out_of_place(spark):
    from quirespark.operators import numbering

    assert [numbering.roman(x) for x in ("iv", "XIX", "IIX", "", "MCM")] == [4, 19, None, None, 1900]
    rng = random.Random(4)
    groups = {g: [rng.randrange(12) for _ in range(rng.randrange(1, 9))] for g in range(60)}
    rows = [(g, i, [n // 4, n % 4]) for g, ns in groups.items() for i, n in enumerate(ns)] + [(99, 0, None)]
    got = numbering.in_place(spark.createDataFrame(rows, "g long, i long, n array<int>").repartition(5), ["g"], "i", "n").collect()
    for g, ns in groups.items():
        kept = [r.in_place for r in sorted((r for r in got if r.g == g), key=lambda r: r.i)]
        best = max(sum(m >> i & 1 for i in range(len(ns))) for m in range(1 << len(ns)) if (s := [n for i, n in enumerate(ns) if m >> i & 1]) == sorted(set(s)))
        run = [n for n, k in zip(ns, kept) if k]
        assert len(kept) == len(ns) and run == sorted(set(run)) and len(run) == best
    assert all(r.g != 99 for r in got)
    placed = spark.createDataFrame([(1, 0, 1, i, h) for i, h in enumerate(["I. a", "II. b", "X. no", "III) c", "IV. d"])] + [(2, 0, 1, i, h) for i, h in enumerate(["A. a", "C. b", "B. no", "D. d"])] + [(3, 0, 1, i, h) for i, h in enumerate(["2.9 a", "2.10 b", "１.1 no", "第三章 x", "plain"])], "doc_id long, parent_line int, level int, line_number int, heading string")
    out = {(r.doc_id, r.line_number): r.in_place for r in numbering.heading_places(placed).collect()}
    assert [k for k, v in out.items() if not v] in ([(1, 2), (2, 1), (3, 2)], [(2, 1), (1, 2), (3, 2)]) or {k for k, v in out.items() if not v} == {(1, 2), (2, 1), (3, 2)}
    assert (3, 4) not in out


def test_numbers_out_of_place_over_batches(spark):
    """Groups that go over batches, numbers that only rise and others, and columns that are carried."""
    from quirespark.operators import numbering

    rng = random.Random(5)
    rows, want = [], {}
    for g in [None, *range(40)]:
        kind, at = rng.randrange(5), 0
        ns = []
        for _ in range(rng.choice([1, 2, 7, 60])):
            at += rng.randrange(3)
            ns.append(([at], None) if kind == 0 or rng.random() < 0.5 else [(None, None), ([rng.randrange(9)], None), (None, "b"), ([at, 1], None)][kind - 1])
        for i, (n, m) in enumerate(ns):
            rows.append((g, i, n, m, f"{g} {i}"))
        values = numbering.tuples([n for n, _ in ns], [m for _, m in ns])
        kept = iter(numbering.longest([v for v in values if v is not None]))
        want |= {(g, i): (None if v is None else list(v), None if v is None else next(kept), f"{g} {i}") for i, v in enumerate(values)}
    rng.shuffle(rows)
    d = spark.createDataFrame(rows, "g long, i long, n array<int>, m string, c string")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for size in (3, 10_000):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
            got = {(r.g, r.i): (r.in_place, r.c) for r in numbering.in_place(d, ["g"], "i", "n", "m", carried=["c", "i", "g"]).collect()}
            assert got == {k: v[1:] for k, v in want.items()}
            got = {(r.g, r.i): (r.number, r.in_place) for r in numbering.in_place(d, ["g"], "i", "n", "m").collect()}
            assert got == {k: v[:2] for k, v in want.items() if v[0] is not None}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_extracted_summaries(spark, monkeypatch):
    from collections import Counter

    from quirespark.operators import summary

    rng = random.Random(9)
    words = [f"w{i}" for i in range(60)]
    bodies = [" ".join(" ".join(rng.choices(words, weights=[60 - i for i in range(60)], k=rng.randrange(1, 9))) + rng.choice([".", "!", "?\n"]) for _ in range(rng.randrange(0, 9))) for _ in range(40)] + ["", None, "!!! ...", "x" * 300 + ". Short one."]
    d = spark.createDataFrame(list(enumerate(bodies)), "k long, body string")
    said = [[s for x in re.findall(r"[^.!?\n]+[.!?]*", b or "") if re.search(r"[^\s.,;:!?\"()]", s := x.strip(" "))] for b in bodies]
    split = lambda s: re.findall(r"[^\s.,;:!?\"()]+", s.lower())
    df = Counter(w for ss in said for w in {w for s in ss for w in split(s)})
    n, want = len(bodies), {}
    for k, ss in enumerate(said):
        score = [sum((n // df[w]).bit_length() - 1 for w in split(s)) * 100 // len(split(s)) + 300 // (i + 1) for i, s in enumerate(ss)]
        upto, kept = -1, []
        for i in sorted(range(len(ss)), key=lambda i: (-score[i], i)):
            upto += len(ss[i]) + 1
            kept += [i] if upto <= 60 else []
        want[k] = " ".join(ss[i] for i in sorted(kept))
    for frequent in (2, 256):
        monkeypatch.setattr(summary, "FREQUENT", frequent)
        assert {r.k: r.summary for r in summary.extract(d, ["k"], length=60).collect()} == want


# Guarded batches


def test_guarded_batches_follow_a_model(spark):
    from datetime import datetime, timedelta

    from quirespark.operators import guard

    rng = random.Random(12)
    now = datetime(2024, 1, 1, 12)
    trees = [f"t{k}" for k in range(8)]
    nodes = [(t, p, "x", "s") for t in trees for p in ([], [0], [1], [0, 0])]
    meta = [(t, k % 3, None) for k, t in enumerate(trees)]
    rev = {t: r for t, r, _ in meta}
    tokens = []
    for k in range(120):
        t = rng.choice(trees)
        tokens.append((f"k{k}", t, rng.choice(guard.PURPOSES), rng.choice([[], [0], [1], [5]]), rev[t] if rng.random() < 0.8 else rev[t] - 1, now + timedelta(minutes=rng.choice([-1, 5, 5, 5]))))
    batch = []
    for no in range(400):
        k = rng.randrange(130)
        name, t, purpose, path, *_ = tokens[k] if k < 120 else (f"k{k}", rng.choice(trees), "append_child", [], 0, None)
        if rng.random() < 0.3:
            t = rng.choice([*trees, "t99"])
        if rng.random() < 0.2:
            purpose = rng.choice([*guard.PURPOSES, "other"])
        if rng.random() < 0.2:
            path = rng.choice([[], [0], [7]])
        batch.append((t, no, name, purpose, path, rng.choice([None, 0, 9]), rng.choice(["n", "n", None]), rng.choice(["b", "b", None]), rng.choice(["c", None])))
    # The same, an edit after the other.
    left, at, want, done = {t[0]: t for t in tokens}, dict(rev), [], {}
    kids = {(t, tuple(p)): sum(q[:-1] == p and q != [] for _, q, *_ in nodes if _ == t) for t, p, *_ in nodes}
    for t, no, name, action, path, position, title, summary, more in batch:
        bad = {"append_child": summary is None, "upsert_child": not title or summary is None, "update_node": title is None and summary is None, "append_to_summary": more is None}
        error = "unknown action" if action not in bad else "no such tree" if t not in at else "title or text is missing" if bad[action] else None
        tok = left.get(name)
        if error is None and tok is None:
            error = "unknown token"
        elif error is None and now > tok[5]:
            error = "token has expired"
            del left[name]
        elif error is None:
            error = "token is of another tree" if tok[1] != t else "token is of another revision" if tok[4] != at[t] else "token is for another purpose" if tok[2] != action else "token is for another node" if tok[3] != path else None
            if error is None:
                del left[name]
                n = kids.get((t, tuple(path)))
                error = "no node at the path" if n is None else "position is out of range" if action == "append_child" and position is not None and not 0 <= position <= n else None
                if error is None:
                    at[t] += 1
                    done[t] = no
        want.append((t, no, error is None, error, at.get(t)))
    d = lambda rows, schema: spark.createDataFrame(rows, schema)
    got = guard.commit(d(nodes, NODE), d(meta, "ast_id string, rev long, updated_at timestamp"), d(tokens, "token string, ast_id string, purpose string, path array<int>, issued_rev long, expires_at timestamp"), d(batch, "ast_id string, edit_no int, token string, action string, path array<int>, position int, section_title string, content_summary string, append_text string"), F.lit(now))
    assert sorted((r.ast_id, r.edit_no, r.ok, r.error, r.rev) for r in got.outcomes.collect()) == sorted(want)
    assert {r.ast_id: (r.rev, r.updated_at) for r in got.meta.collect()} == {t: (at[t], now if t in done else None) for t in trees}
    assert {r.token for r in got.tokens.collect()} == set(left) and len(done) > 3 and len({w[3] for w in want}) > 8
    log = [(t, no, action, path, None, *rest, None) for t, no, _, action, path, *rest in batch if done.get(t) == no]
    after, _ = plain_replay(nodes, log)
    assert sorted(((r.ast_id, list(r.path), r.section_title, r.content_summary) for r in got.nodes.collect()), key=repr) == sorted(after, key=repr)


def test_versions(spark, tmp_path):
    from quirespark.operators import guard

    root = f"file://{tmp_path}/store"
    one, two = spark.range(3), spark.range(5)
    assert guard.version(spark, root) == 0 and guard.publish(spark, root, 0, {"n": one})
    assert guard.version(spark, root) == 1 and guard.publish(spark, root, 1, {"n": two})
    assert not guard.publish(spark, root, 1, {"n": one})  # another writer was first
    assert guard.version(spark, root) == 2 and guard.read_version(spark, root, 2, "n").count() == 5 and guard.read_version(spark, root, 1, "n").count() == 3
    meta = spark.createDataFrame([("a", 4)], "ast_id string, rev long")
    t = guard.issue(spark.createDataFrame([("a", "append_child", None), ("b", "x", None)], "ast_id string, purpose string, path array<int>"), meta, F.current_timestamp()).collect()
    assert len(t) == 1 and t[0].issued_rev == 4 and list(t[0].path) == [] and len(t[0].token) == 36


# Files


def test_document_files(spark, tmp_path):
    from quirespark.sources.document_files import DocumentFiles

    spark.dataSource.register(DocumentFiles)
    at = str(tmp_path / "files")
    rows = [(f"a/{k} é", "x" * k + "\né") for k in range(40)] + [("none", None)]
    d = spark.createDataFrame(rows, "name string, text string").repartition(4)
    d.write.format("document_files").option("suffix", ".json").mode("append").save(at)
    read = lambda **o: spark.read.format("document_files").options(suffix=".json", **o).load(at)
    assert sorted(map(tuple, read().collect())) == sorted((n, t or "") for n, t in rows) and read(group_bytes=100).rdd.getNumPartitions() > 10
    with pytest.raises(Exception, match="has to have a name"):
        spark.createDataFrame([(None, "x"), ("y", "z")], d.schema).coalesce(1).write.format("document_files").option("suffix", ".json").mode("append").save(at)
    assert len(list((tmp_path / "files").glob("*.json"))) == 41
    spark.createDataFrame([("only", "1")], d.schema).write.format("document_files").option("suffix", ".json").mode("overwrite").save(at)
    assert [tuple(r) for r in read().collect()] == [("only", "1")] and (tmp_path / "files" / "_SUCCESS").exists()
    # Trees, a file each.
    nodes = spark.createDataFrame([("t1", [], "r", ""), ("t1", [0], "é", "s"), ("t2", [], None, "")], NODE)
    spark_trees = tree.nodes_to_json(nodes).withColumnsRenamed({"ast_id": "name", "json": "text"})
    spark_trees.write.format("document_files").option("suffix", ".ast").mode("append").save(at)
    back = spark.read.format("document_files").option("suffix", ".ast").load(at).withColumnsRenamed({"name": "ast_id", "text": "json"})
    assert sorted(map(str, tree.nodes_from_json(back).collect())) == sorted(map(str, nodes.collect()))
