"""Lines, segments, patterns and matches against plain Python."""

import json
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quirespark.functions import dialect, text as ft
from quirespark.operators import audit, matches
from quirespark.plans.propose import propose
from quirespark.sources import text
from quirespark.streaming.ingest import stream_matches, text_stream


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_lines(spark):
    got = text.lines(docs(spark, "﻿A\r\nB\rC\n\nD E\n", "", None, "\n", "x")).orderBy("doc_id", "line_number").collect()
    assert [(r.doc_id, r.line_number, r.line) for r in got] == [(0, 1, "﻿A"), (0, 2, "B"), (0, 3, "C"), (0, 4, ""), (0, 5, "D E"), (3, 1, ""), (4, 1, "x")]


def test_segments(spark):
    t = F.col("text")
    d = docs(spark, "\U0001f7e2ab\r\nc" + "z" * 200)
    s = lambda *a: text.segment(t, *a)
    r = d.select(s(1, 1).alias("a"), s(999, 5).alias("b"), s(0, 0).alias("c"), s(3, -1).alias("d"), s(-5, 2).alias("e"), s().alias("f"), text.char_length(t).alias("n")).first()
    assert (r.a, r.b, r.c, r.d, r.e, len(r.f), r.n) == ("a", "", "", "\nc" + "z" * 200, "\U0001f7e2a", 100, 205)


def test_read_corpus(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("﻿é\r\n".encode())
    assert text.read_corpus(spark, str(tmp_path)).first().text == "﻿é\r\n"
    assert text.read_pages(spark, str(tmp_path), lambda b: ["one", "two"]).first().text == "one\ntwo"
    (tmp_path / "b.txt").write_bytes(b"\xff\xfe\xfa")
    with pytest.raises(Exception, match="not UTF-8"):
        text.read_corpus(spark, str(tmp_path)).collect()


CASES = ["(a)?b", "x*", r"\d+", "[a[b]+", "(?P<n>a+)(?P=n)", "a{,2}b", r"\bw\w*", "[^]a]+", "[]x]+", "a&&b", "[a&&b]+", "^ab|b$", "(?i)É", r"[\b]|\v", r"a\Z", r"(a)(?(1)b|c)", "."]
LINES = ["ab b", "xa", "１2", "[b[a", "aaaa", "aab b", "w1 we", "é É", "a&&b&", "", "x]a", "a b", "ab\r", "\x08\x0b", "ba"]


@pytest.mark.parametrize("exact", [False, True])
def test_matches_follow_python(spark, exact):
    ls = text.lines(docs(spark, "\n".join(LINES).replace("\r", "")))
    got = matches.match_table(ls, CASES, exact).orderBy(*matches.ORDER).collect()
    want = []
    for n, line in enumerate("\n".join(LINES).replace("\r", "").split("\n"), 1):
        for k, p in enumerate(CASES):
            for i, m in enumerate(re.finditer(p, line)):
                groups = list(m.groups()) or [m[0]]
                java = not exact and not dialect.pattern(p).exact
                want.append((n, k, i, m[0], [g or "" for g in groups] if java else groups))
    assert [(r.line_number, r.pattern_index, r.match_ord, r.full_match, list(r.groups)) for r in got] == want


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text("ab1é .[　", max_size=12), min_size=1, max_size=5))
def test_random_lines(spark, found):
    ps = ["a+", "[ab]1", r"\s", r"\w+", "(é)|(b)"]
    ls = spark.createDataFrame([(1, i, x) for i, x in enumerate(found)], "doc_id long, line_number int, line string")
    got = {(r.line_number, r.pattern_index, r.match_ord, r.full_match) for r in matches.match_table(ls, ps).collect()}
    assert got == {(i, k, j, m[0]) for i, x in enumerate(found) for k, p in enumerate(ps) for j, m in enumerate(re.finditer(p, x))}


def test_patterns():
    assert [p.source for p in dialect.patterns(["", " ", "a"])] == ["a"]
    with pytest.raises(ValueError, match="Invalid regex"):
        dialect.pattern("(")


def test_payload(spark):
    d = docs(spark, "aa b\nab aa\nnone")
    out = json.loads(matches.extract_regex_matches(d, "a", max_matches=3, offset_matches=1, dedupe=True))
    assert (out["total_matches"], out["matches_after_offset"], out["returned_matches"], out["truncated"]) == (5, 4, 2, True)
    assert [(m["line_number"], m["match"]) for m in out["sample"]] == [(1, "a"), (2, "a")]
    groups = json.loads(matches.extract_regex_matches(d, "z", ["(b)?(a)", "(x)?b"]))["sample"]
    assert groups[0]["match"] == [None, "a"] and [m["match"] for m in groups if m["pattern_index"] == 1] == [None, None]
    counted = json.loads(matches.extract_regex_matches(d, "a", count_only=True))
    assert counted["sample"] == [] and counted["total_matches"] == 5 and not counted["truncated"]
    small = json.loads(matches.extract_regex_matches(d, "a", max_output_chars=400))
    assert small["returned_matches"] < 5 and small["truncated"]
    assert not json.loads(matches.extract_regex_matches(d, " "))["ok"] and json.loads(matches.extract_regex_matches(d, "a", ["b", "("]))["pattern"] == "("
    assert json.loads(matches.extract_regex_matches(docs(spark), "a"))["total_matches"] == 0


def test_pages_over_all_documents(spark, monkeypatch):
    """The rest after an offset against a plain list, by a top-k and by counts; no exchange to one partition below the limit."""
    d = spark.createDataFrame([(k, "\n".join("ab a" * (1 + (k + j) % 3) for j in range(k % 5))) for k in range(40)] + [(None, "a b\na")], "doc_id long, text string").repartition(7)
    found = matches.match_table(text.lines(d), ["a", "b"])
    rows = [(r.doc_id, r.line_number, r.pattern_index, r.match_ord, r.full_match) for r in found.orderBy(*matches.ORDER).collect()]
    for top in (matches.TOP, 0):
        monkeypatch.setattr(matches, "TOP", top)
        for offset in (0, 1, 4, 57, len(rows) - 1, len(rows), len(rows) + 5):
            rest = rows[offset:]
            key = lambda df: [(r.doc_id, r.line_number, r.pattern_index, r.match_ord, r.full_match) for r in df.collect()]
            assert key(matches.match_page(found, offset, 9, everywhere=True)) == rest[:9], (top, offset)
            once = [r for k, r in enumerate(rest) if r[:3] + r[4:] not in {x[:3] + x[4:] for x in rest[:k]}]
            assert key(matches.match_page(found, offset, 9, dedupe=True, everywhere=True)) == once[:9], (top, offset)
    assert "SinglePartition" not in matches.match_page(found, 57, 9, everywhere=True)._jdf.queryExecution().executedPlan().toString()


def test_payload_has_rows_for_documents_without_matches(spark):
    d = docs(spark, "a a b", "none here", None)
    p = {r.doc_id: r for r in matches.match_payload(matches.match_table(text.lines(d), ["a"]), 1, 5, docs=d).collect()}
    assert sorted(p) == [0, 1, 2] and (p[0].total_matches, p[0].returned_matches, p[0].truncated) == (2, 1, False)
    assert all((p[k].total_matches, p[k].matches_after_offset, p[k].truncated, list(p[k].sample)) == (0, 0, False, []) for k in (1, 2))


def test_failures_are_text(spark, tmp_path):
    assert matches.extract_regex_matches(spark.createDataFrame([(1, 2)], "doc_id long, other long"), "a").startswith("Error extracting matches: ")


def test_sink_ignores_limits(spark, tmp_path):
    at = str(tmp_path / "out")
    matches.extract_regex_matches(docs(spark, "a a a"), "(x)?a", offset_matches=1, count_only=True, save_to=at)
    rows = [json.loads(r.value) for r in spark.read.text(at).collect()]
    assert [r["match_ord"] for r in rows] == [1, 2] and rows[0]["groups"] == [None]


def test_titles_and_numbers(spark):
    rows = [("A  B",), ("A　B",), (" A B ",), (None,), ("Ａ",)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string").select(ft.normal_title(F.col("t"))).collect()]
    assert got == ["A B", "A B", "A B", "", "Ａ"]
    rows = [("2.1.3 x",), ("第１２章",), ("第十章",), ("第二十三章",), ("第十一",), ("三",), ("none",)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string").select(ft.heading_numbers(F.col("t"))).collect()]
    assert got == [[2, 1, 3], [12], [10], [23], [11], [3], None]
    j = spark.createDataFrame([("old \n", " new"), ("", " new"), (None, "x")], "a string, b string").select(ft.joined_summary(F.col("a"), F.col("b")))
    assert [r[0] for r in j.collect()] == ["old\nnew", " new", "x"]


def test_pattern_stats_and_proposal(spark):
    ls = text.lines(docs(spark, "# one\ntext\n## two\n# three\n## four", "# five"))
    s = {r.pattern: r for r in audit.pattern_stats(ls, ["^# .+", "x"]).collect()}
    assert (s["^# .+"].n_lines, s["^# .+"].n_docs, s["x"].n_matches) == (3, 2, 1)
    bp = propose(ls)
    assert [(r.level, r.name, r.parent_level) for r in bp.hierarchy_structure] == [(1, "markdown 1", None), (2, "markdown 2", 1)]


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("a1 b\nb22")
    for _ in range(2):  # what is done is not done again
        stream_matches(text_stream(spark, str(tmp_path / "in")), ["[0-9]+"], str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert sorted(r.full_match for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["1", "22"]
