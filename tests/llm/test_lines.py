"""Line-first cleaning against plain Python."""

import re
from collections import Counter

import numpy as np
import pytest

pytest.importorskip("quirespark.llm")
from quirespark.llm import lines  # noqa: E402

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def fails(line):
    n, count = len(WORD.findall(line)), lambda p: len(re.findall(p, line))
    if count(lines.SEPARATOR) >= 2 and count(lines.SEPARATOR) * 4 >= n:
        return "navigation"
    if count(lines.SYMBOL) >= 3 and count(lines.SYMBOL) * 12 >= len(line):
        return "symbols"
    if count(lines.SHOUT) >= 3 and count(lines.SHOUT) * 4 >= n:
        return "shouting"
    if len(line) <= 200 and re.search(lines.PHRASE, line):
        return "boilerplate"
    inside = re.search(r"[.!?…][\"'”’»)\]]{0,9}[\x20\x09-\x0D]|[。！？]", line)
    return None if inside or line.rstrip(" \t\r\x0b\x0c")[-1] in ".!?…。！？;:" else "punctuation"


def plain(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    twice = Counter(windows)
    repeated = len({i + k for i, w in enumerate(windows) if twice[w] > 1 for k in range(5)})
    worded = [x for x in text.split("\n") if WORD.search(x)]
    chars = lambda xs: sum(len(w) for x in xs for w in WORD.findall(x))
    lost = chars([x for x in worded if fails(x)])
    failed = len(words) < 10 or 100 * repeated > 20 * len(words)
    symbols = sum(c in "#*$%&|<>" for c in text)
    return len(words), chars([text]), symbols, len(worded) - len(set(worded)), repeated, failed, not failed and 2 * lost <= chars([text]), lost, "\n".join(x for x in worded if not fails(x))


def made(n, seed):
    rng = np.random.default_rng(seed)
    kinds = ["Home | News | About | Help", "a >> b >> c", "buy $$$ now *** %%% ok &&&.", "WOW!! GREAT!! YES!! NO!!", "All rights reserved.", "no end here", "One end. And none here", "ein Satz mit ß und ü steht hier.", "𝄞 music 漢字。", "x  y\tz \r", "  ", "", "one two three four five six.", "one two three four five six seven eight nine."]
    return ["\n".join(rng.choice(kinds, int(k))) + "\n" + " ".join(rng.choice(list("abcdefghij"), int(m))) + "." for k, m in zip(rng.integers(0, 12, n), rng.integers(0, 60, n))]


def test_against_python(spark):
    texts = [None, "", " \n\t", "\n\n", "a b c d e f g h i j.", "a b c d e a b c d e f.", "a a a a a a a a a a a a.", "q w e r t y u i o p " * 3, *made(150, 5)]
    texts += [" ".join(f"w{i % 9000}" for i in range(20000)) + ".", "x" * 200000]
    d = spark.createDataFrame([(k, t, 1) for k, t in enumerate(texts)] + [(None, texts[5], 2), (4, texts[4], 3)], "doc_id long, text string, n_words int")
    got = lines.judge(d).collect()
    assert len(got) == len(texts) + 2 and sum(r.doc_id is None for r in got) == 1
    for r in got:
        if r.doc_id is not None:
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept, r.lost_chars, r.clean) == plain(texts[r.doc_id]), texts[r.doc_id][:200]
    assert lines.judge(d.limit(0)).collect() == []


def test_clean(spark):
    body = "This is a sentence of some eight words. And one more of them.\nHome | About | Help | Next"
    d = spark.createDataFrame([(1, body, 0, "a"), (2, "Home | About | Help | Next | Last\n" * 3 + "Short one.", 0, "b"), (3, None, 0, None)], "doc_id long, text string, `a.b` int, d string")
    got = lines.clean(d)
    assert got.columns == d.columns and [(r.doc_id, r.text, r["a.b"], r.d) for r in got.collect()] == [(1, body.split("\n")[0], 0, "a")]


def test_native(spark):
    plan = lines.judge(spark.createDataFrame([(1, "a")], "doc_id long, text string"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
