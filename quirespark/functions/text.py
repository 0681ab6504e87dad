"""Column functions on texts, titles and numbers in headings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Python counts it.
SPACE = "(?U)[\\s\\x1c-\\x1f]"


def normal_title(title: Column) -> Column:
    """White space, wide one too, becomes single spaces; none at the ends; null is empty."""
    return F.trim(F.regexp_replace(F.coalesce(title, F.lit("")), SPACE + "+", " "))


def same_title(a: Column, b: Column) -> Column:
    return normal_title(a) == normal_title(b)


def stripped_left(text: Column) -> Column:
    return F.regexp_replace(text, "\\A" + SPACE + "+", "")


def stripped_right(text: Column) -> Column:
    return F.regexp_replace(text, SPACE + "+\\z", "")


def joined_summary(old: Column, new: Column) -> Column:
    """The new text on a line of its own after the old one."""
    old = F.coalesce(old, F.lit(""))
    return F.when(old == "", new).otherwise(F.concat(stripped_right(old), F.lit("\n"), stripped_left(new)))


WIDE, KANJI = "０１２３４５６７８９", "〇一二三四五六七八九"


def dotted_number(heading: Column) -> Column:
    """The first number in digits, with its dots; empty without one."""
    narrow = F.when(F.octet_length(heading) == F.length(heading), heading).otherwise(F.translate(heading, WIDE, "0123456789"))
    return F.regexp_extract(narrow, "[0-9]{1,9}(?:\\.[0-9]{1,9})*", 0)


def heading_numbers(heading: Column, dotted: Column | None = None) -> Column:
    """The first number of a heading, dots apart, as an array: 2.1.3, wide digits, or kanji up to 99; null without one. dotted: its `dotted_number`, if that is a column already."""
    dotted = dotted_number(heading) if dotted is None else dotted
    kanji = F.regexp_extract(heading, f"[{KANJI}十]+", 0)
    tens, ones = F.substring_index(kanji, "十", 1), F.substring_index(kanji, "十", -1)
    number = lambda s, none: F.when(s == "", none).otherwise(F.translate(s, KANJI, "0123456789").try_cast("int"))
    value = F.when(F.contains(kanji, F.lit("十")), number(tens, F.lit(1)) * 10 + number(ones, F.lit(0))).otherwise(number(kanji, F.lit(None)))
    some = F.when(F.contains(dotted, F.lit(".")), F.transform(F.split(dotted, "\\."), lambda x: x.cast("int"))).otherwise(F.array(dotted.cast("int")))
    return F.when(dotted != "", some).when(value.isNotNull(), F.array(value))
