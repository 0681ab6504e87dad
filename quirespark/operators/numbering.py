"""Which headings are out of place: the longest run of increasing numbers among siblings.

Numbers are compared as tuples: 2.10 comes after 2.9, wide and Chinese digits count, roman numbers and
letters do where no digits stand; whether siblings like C or I are letters or roman is decided by all of
them. Siblings are dealt out and sorted; a task goes through them as a stream, holding the numbers of
one parent's children.
"""

from __future__ import annotations

import re
from bisect import bisect_left

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import dotted_number, heading_numbers

ROMAN = {"I": 1, "V": 5, "X": 10, "L": 50, "C": 100, "D": 500, "M": 1000}
WELL_FORMED = re.compile(r"M*(CM|CD|D?C{0,3})(XC|XL|L?X{0,3})(IX|IV|V?I{0,3})")


def roman(text: str) -> int | None:
    """The value of a well-formed roman number."""
    if not text or not WELL_FORMED.fullmatch(text.upper()):
        return None
    values = [ROMAN[c] for c in text.upper()]
    return sum(-v if v < max(values[i + 1 :], default=0) else v for i, v in enumerate(values))


def tuples(numbers: list[list[int] | None], marks: list[str | None]) -> list[tuple[int, ...] | None]:
    """Siblings' numbers as tuples: digits where a heading has them; else its mark as a roman number if all bare marks among the siblings are, and as a letter if all are single ones."""
    bare = [m for n, m in zip(numbers, marks) if n is None and m]
    letters = [len(m) == 1 for m in bare]
    as_roman = bool(bare) and all(roman(m) for m in bare) and (not all(letters) or "I" in (bare[0].upper(),))
    out: list[tuple[int, ...] | None] = []
    for n, m in zip(numbers, marks):
        if n is not None:
            out.append(tuple(n))
        elif m and as_roman:
            out.append((roman(m),))
        elif m and len(m) == 1:
            out.append((ord(m.upper()) - 64,))
        else:
            out.append(None)
    return out


def longest(values: list) -> list[bool]:
    """Which of the values are in the longest strictly increasing run; of several, the one whose values end lowest."""
    tails, ends, before = [], [], [-1] * len(values)
    for i, v in enumerate(values):
        k = bisect_left(tails, v)
        before[i] = ends[k - 1] if k else -1
        tails[k:k + 1], ends[k:k + 1] = [v], [i]
    out, i = [False] * len(values), ends[-1] if ends else -1
    while i >= 0:
        out[i], i = True, before[i]
    return out


def _changes(b: pa.RecordBatch, fields: list[str]) -> np.ndarray:
    """For each row but the first: whether it differs from the one before; nulls are alike."""
    out = np.zeros(max(b.num_rows - 1, 0), bool)
    for c in fields:
        x = b.column(c)
        there = x.is_valid().to_numpy(zero_copy_only=False)
        differ = pc.not_equal(x.slice(1), x.slice(0, len(out))).fill_null(False).to_numpy(zero_copy_only=False)
        out |= differ | (there[1:] != there[:-1])
    return out


def _whole(batches, fields: list[str]):
    """Batches of whole groups, from ones whose rows are in order of their groups."""
    held, key = [], None
    for b in batches:
        if not b.num_rows:
            continue
        begins = [b.column(c)[0].as_py() for c in fields]
        if held and begins != key:
            yield pa.concat_batches(held)
            held = []
        cuts = np.flatnonzero(_changes(b, fields))
        if cuts.size:
            last = int(cuts[-1]) + 1
            yield pa.concat_batches([*held, b.slice(0, last)])
            held, b = [], b.slice(last)
        held.append(b)
        key = [b.column(c)[0].as_py() for c in fields]
    if held:
        yield pa.concat_batches(held)


def _judged(b: pa.RecordBatch, fields: list[str], every: bool):
    """b's rows that have a number (all, if `every`) as (rows' places, numbers, in_place): those of groups whose single numbers never fall, all at once, and the others."""
    n, number, marks = b.num_rows, b.column("number"), b.column("mark")
    group = np.concatenate([[0], np.cumsum(_changes(b, fields))])
    sizes = pc.list_value_length(number).fill_null(-1).to_numpy(zero_copy_only=False)
    flat = number.flatten()
    at = np.cumsum(np.maximum(sizes, 0)) - np.maximum(sizes, 0)
    single = sizes == 1
    single[single] = flat.is_valid().to_numpy(zero_copy_only=False)[at[single]]
    value = np.zeros(n, np.int64)
    value[single] = flat.fill_null(0).to_numpy(zero_copy_only=False)[at[single]]
    bare = (sizes < 0) & ~pc.not_equal(marks, "").fill_null(False).to_numpy(zero_copy_only=False)  # neither a number nor a mark
    some = np.flatnonzero(~bare)
    g, v = group[some], value[some]
    same = g[1:] == g[:-1]
    falls = ~single[some]
    falls[1:] |= same & (v[1:] < v[:-1])
    slow = np.zeros(int(group[-1]) + 1, bool)
    slow[g[falls]] = True
    # In a run that never falls, the last of equal numbers is in the longest run.
    good = np.ones(len(some), bool)
    good[:-1] = ~same | (v[1:] != v[:-1])
    placed = np.zeros(n, bool)
    placed[some] = good
    quick = np.flatnonzero(~slow[group] & (every | ~bare))
    yield quick, number.take(pa.array(quick)), pa.array(placed[quick], pa.bool_(), mask=bare[quick])
    rest = np.flatnonzero(slow[group])
    if rest.size:
        ns, ms = number.take(pa.array(rest)).to_pylist(), marks.take(pa.array(rest)).to_pylist()
        cuts = [0, *(np.flatnonzero(np.diff(group[rest])) + 1).tolist(), len(rest)]
        values, flags = [], []
        for a, z in zip(cuts, cuts[1:]):
            mine = tuples(ns[a:z], ms[a:z])
            values += mine
            kept = iter(longest([v for v in mine if v is not None]))
            flags += [None if v is None else next(kept) for v in mine]
        left = [i for i, v in enumerate(values) if every or v is not None]
        yield rest[left], pa.array([None if values[i] is None else list(values[i]) for i in left], number.type), pa.array([flags[i] for i in left], pa.bool_())


def in_place(rows: DataFrame, within: list[str], order: str, number: str, mark: str | None = None, dealt: list[str] | None = None, carried: list[str] | None = None) -> DataFrame:
    """(within, order, number, in_place) of rows that have a number: whether it is in the longest increasing run of its group. number: an array of integers, null without one; mark: what stands in its stead, a letter or roman number. order: a long; of equal places the smaller number is first.

    dealt: those of `within` by which rows are dealt out; rows that lie so already stay there. carried: columns to return with in_place in place of those, of rows without a number, too.
    """
    kinds, every, carried = dict(rows.dtypes), carried is not None, carried or []
    r = rows.select(*within, F.col(order).cast("long").alias(order), F.col(number).cast("array<long>").alias("number"), (F.col(mark) if mark else F.lit(None)).cast("string").alias("mark"), *[c for c in carried if c not in (*within, order)])
    fields = [*carried, "in_place"] if every else [*within, order, "number", "in_place"]
    kinds |= {order: "bigint", "number": "array<bigint>", "in_place": "boolean"}

    def run(batches):
        for b in _whole(batches, within):
            for at, numbers, flags in _judged(b, within, every):
                judged = {"number": numbers, "in_place": flags}
                out = pa.RecordBatch.from_arrays([judged[c] if c in judged else b.column(c).take(pa.array(at)) for c in fields], fields)
                for k in range(0, len(at), 4096):
                    yield out.slice(k, 4096)

    shape = ", ".join(f"`{c}` {kinds[c]}" for c in fields)
    return r.repartition(*(dealt or within)).sortWithinPartitions(*within, order, "number", "mark").mapInArrow(run, shape)


def heading_places(placed: DataFrame, carried: list[str] | None = None) -> DataFrame:
    """doc_id, parent_line, level, line_number, number, in_place: numbered headings of an outline among their siblings. carried: as in `in_place`."""
    mark = F.regexp_extract("heading", "^[^\\p{L}\\p{N}]*([IVXLCDMivxlcdm]+|\\p{Lu}|[a-z])[.):\\]]", 1)
    rows = placed.withColumns({"_dotted": dotted_number(F.col("heading")), "_mark": mark})
    rows = rows.withColumns({"_number": heading_numbers(F.col("heading"), F.col("_dotted")), "_mark": F.when(F.col("_mark") != "", F.col("_mark"))})
    return in_place(rows, ["doc_id", "parent_line", "level"], "line_number", "_number", "_mark", ["doc_id"], carried)
