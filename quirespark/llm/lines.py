"""Line-first cleaning, in DataFrame functions only: rules judge each line, failing lines go, and a document that loses too much goes whole.

Rules of a line, in this order (the first that fails names it):
navigation: separators (| > » • and the like, alone) among its words, at least one for every `LINK_WORDS` words;
symbols: at least one of #*$%&|<>{} for every `SYMBOL_CHARS` characters, three at least;
shouting: a run of ! or ? at at least one of every `SHOUT_WORDS` words, three at least;
boilerplate: short lines with phrases of licences, cookies, scripts and placeholders, or braces;
punctuation: no end of a sentence, neither in its last characters nor inside.
Lines without a word are neither judged nor kept. A document goes if it fails the base rules or if
more than `most_lost` of the characters of its words stood in failing lines.

Repeated five-word windows are found within a text by hashes; where two hashes are equal, the windows
are sorted as texts, so that no collision counts. Nothing is exchanged: all work is by row.

Defined cases: a null text has no words and fails; null ids and repeated rows keep a row each; an
empty table gives no rows; other columns are ignored by `judge` and kept by `clean`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import WORD, table

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: Words of a window, words that a document has at least, and percent of its words in repeated windows at most.
WINDOW, LEAST_WORDS, MOST_REPEATED = 5, 10, 20
LINK_WORDS, SYMBOL_CHARS, SHOUT_WORDS, BOILERPLATE_CHARS = 4, 12, 4, 200

# Patterns of the rules, in the dialect that Java and RE2 share.
SEPARATOR = "(?:^|[\\x20\\x09-\\x0D])(?:[|>»›•·‣/\\\\-]|::|->|=>)(?:[\\x20\\x09-\\x0D]|$)"
SYMBOL = "[#*$%&|<>{}]"
SHOUT = "[!?]{2,}"
PHRASE = "(?i)all rights reserved|privacy policy|terms of (?:use|service)|cookie|javascript|lorem ipsum|licensed under|copyright|©|subscribe to|click here|sign up|log in|read more|[{}]"
ENDS = "[.!?…。！？;:][\"'”’»)\\]]{0,9}$"
STOPS = "[.!?…][\"'”’»)\\]]{0,9}[\\x20\\x09-\\x0D]|[。！？]"
RULES = ["navigation", "symbols", "shouting", "boilerplate", "punctuation"]


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def bare(text: Column, chars: str) -> Column:
    """The text without these characters."""
    return F.translate(text, chars, "")


def failure(line: Column) -> Column:
    """The name of the first rule that the line fails; null if it stays."""
    n_words, n_chars = F.regexp_count(line, F.lit(WORD)), F.length(line)
    links, symbols, shouts = (F.regexp_count(line, F.lit(p)) for p in (SEPARATOR, SYMBOL, SHOUT))
    return (
        F.when((links >= 2) & (links * LINK_WORDS >= n_words), RULES[0])
        .when((symbols >= 3) & (symbols * SYMBOL_CHARS >= n_chars), RULES[1])
        .when((shouts >= 3) & (shouts * SHOUT_WORDS >= n_words), RULES[2])
        .when((n_chars <= BOILERPLATE_CHARS) & F.rlike(line, F.lit(PHRASE)), RULES[3])
        .when(~F.rlike(F.right(F.rtrim(line, F.lit(SPACES)), F.lit(10)), F.lit(ENDS)) & ~F.rlike(line, F.lit(STOPS)), RULES[4])
    )


def _repeated(words: Column) -> Column:
    """Words in windows that the text has twice or more."""
    starts = F.sequence(F.lit(1), F.size(words) - (WINDOW - 1))

    def among(hashes: Column) -> Column:
        windows = F.transform(starts, lambda i: F.struct(F.array_join(F.slice(words, i, WINDOW), " ").alias("w"), i.alias("i")))

        def places(s: Column) -> Column:
            twice = F.filter(s, lambda x, j: (F.get(s, j - 1)["w"] == x["w"]) | F.coalesce(F.get(s, j + 1)["w"] == x["w"], F.lit(False)))
            return F.sort_array(F.transform(twice, lambda x: x["i"]))

        def covered(p: Column) -> Column:
            each = F.transform(p, lambda x, j: F.least(F.lit(WINDOW), F.coalesce(F.get(p, j + 1) - x, F.lit(WINDOW))))
            return F.aggregate(each, F.lit(0), lambda a, x: a + x)

        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(_let(_let(F.sort_array(windows), places), covered))

    hashes = F.transform(starts, lambda i: F.xxhash64(*[F.get(words, i + (k - 1)) for k in range(WINDOW)]))
    return F.when(F.size(words) <= WINDOW, F.lit(0)).otherwise(_let(hashes, among)).cast("long")


def _judged(text: Column, most_lost: float) -> Column:
    """Counts, lines with their failures, and verdicts, as a struct."""
    worded = F.filter(F.split(text, "\n", -1), lambda x: F.rlike(x, F.lit(WORD)))
    lines = F.transform(worded, lambda x: F.struct(x.alias("line"), failure(x).alias("fails"), F.length(bare(x, SPACES)).alias("chars")))

    def counted(words: Column, ls: Column) -> Column:
        n_words, chars = F.size(words).cast("long"), F.length(bare(text, SPACES)).cast("long")
        kept = F.filter(ls, lambda x: x["fails"].isNull())
        lost = F.aggregate(ls, F.lit(0), lambda a, x: a + F.when(x["fails"].isNotNull(), x["chars"]).otherwise(0)).cast("long")
        n_failed = (F.size(ls) - F.size(kept)).cast("long")
        clean = F.array_join(F.transform(kept, lambda x: x["line"]), "\n")

        def whole(repeated: Column) -> Column:
            failed = (n_words < LEAST_WORDS) | (100 * repeated > MOST_REPEATED * n_words)
            return F.struct(
                n_words.alias("n_words"), chars.alias("word_chars"), (F.length(text) - F.length(bare(text, SYMBOLS))).cast("long").alias("n_symbols"),
                (F.size(ls) - F.size(F.array_distinct(F.transform(ls, lambda x: x["line"])))).cast("long").alias("n_dup_lines"), repeated.alias("n_repeat_words"),
                failed.alias("base_failed"), (~failed & (lost <= most_lost * chars)).alias("kept"), n_failed.alias("n_failed_lines"), lost.alias("lost_chars"), clean.alias("clean"),
                F.array_sort(F.array_distinct(F.array_compact(F.transform(ls, lambda x: x["fails"])))).alias("failures"))

        return _let(_repeated(words), whole)

    return _let(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), lambda words: _let(lines, lambda ls: counted(words, ls)))


def judge(docs: DataFrame, most_lost: float = 0.5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, the counts of a text, its verdicts, and clean: the lines that stay."""
    t = F.coalesce(F.col(text), F.lit(""))
    # A generator keeps the whole struct in one place, whichever of its fields are asked for.
    return docs.select(key, F.explode(F.array(_judged(t, most_lost))).alias("_j")).select(key, "_j.*")


def clean(docs: DataFrame, most_lost: float = 0.5, text: str = "text") -> DataFrame:
    """docs that are kept, with the lines of their text that stay."""
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("d"))
    j = d.select("d", F.explode(F.array(_judged(F.coalesce(F.col("d")[text], F.lit("")), most_lost))).alias("j")).where("j.kept")
    return j.select(*[F.col("j.clean").alias(c) if c == text else F.col("d")[c].alias(c) for c in docs.columns])


def op12_lines(spark, sf_dir):
    return judge(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_failed_lines", "lost_chars", F.array_join("failures", ",").alias("failures"))
