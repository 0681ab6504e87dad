"""Matches of very many patterns: one automaton finds which patterns a line can match at all.

Of each pattern's syntax tree it is worked out which texts every match has to hold at least one of.
An Aho-Corasick automaton over the texts of all patterns runs once over a line, and only patterns
whose texts occur are run. Patterns without such a text (classes, ignored case) run on every line.
"""

from __future__ import annotations

import re
from re import _constants as C
from re import _parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dialect import patterns

#: Texts shorter than this are no help.
LEAST = 2
#: Most texts of one pattern.
MOST = 64


def needed(source: str) -> frozenset[str] | None:
    """Texts of which every match holds at least one; None if no such texts are known."""
    tree = _parser.parse(source)
    return None if tree.state.flags & (re.IGNORECASE | re.VERBOSE) else _of(tree)


def _better(a: frozenset[str] | None, b: frozenset[str] | None) -> frozenset[str] | None:
    """The more telling of two sets: its shortest text is longer, or it has fewer texts."""
    worth = lambda s: (min(map(len, s)), -len(s))
    return b if a is None else a if b is None or worth(a) >= worth(b) else b


def _of(items) -> frozenset[str] | None:
    best, run = None, ""
    for op, arg in [*items, (None, None)]:
        if op is C.LITERAL:
            run += chr(arg)
            continue
        if len(run) >= LEAST:
            best = _better(best, frozenset([run]))
        run, found = "", None
        if op is C.SUBPATTERN:
            found = None if arg[1] & re.IGNORECASE else _of(arg[3])
        elif op is C.ATOMIC_GROUP:
            found = _of(arg)
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT) and arg[0] > 0:
            found = _of(arg[2])
        elif op is C.BRANCH:
            sets = [_of(x) for x in arg[1]]
            if all(sets) and sum(map(len, sets)) <= MOST:
                found = frozenset().union(*sets)
        best = _better(best, found)
    return best


def match_many(lines: DataFrame, given: list[str], line_text: bool = True, counted: bool = False) -> DataFrame:
    """The rows of `match_table(lines, given, exact=True)`. counted: instead, the number of lines on which each pattern ran (pattern_index, n_runs)."""
    ps = patterns(given)
    if not ps:
        raise ValueError("no pattern is left")
    sources = [p.source for p in ps]

    fields = ["doc_id", "line_number", "pattern_index", "pattern", "match_ord", "full_match", "groups", *(["line"] if line_text else [])]

    def run(batches):
        import ahocorasick

        found = [re.compile(s) for s in sources]
        texts: dict[str, set[int]] = {}
        always = set()
        for k, s in enumerate(sources):
            some = needed(s)
            if some is None:
                always.add(k)
            for t in some or ():
                texts.setdefault(t, set()).add(k)
        automaton, owners = ahocorasick.Automaton(), list(texts.values())
        for i, t in enumerate(texts):
            automaton.add_word(t, i)
        if texts:
            automaton.make_automaton()
        runs = [0] * len(sources)
        names = pa.array(sources)
        for b in batches:
            # A run is a line and a pattern with their number of matches.
            held, full, flat, sizes = [], [], [], []

            def rows(b=b):
                at, k, n = (np.array(x, dtype=np.int64) for x in zip(*held))
                line, pattern = pa.array(np.repeat(at, n)), pa.array(np.repeat(k, n))
                begins = np.repeat(np.cumsum(n) - n, n)
                groups = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.repeat(sizes, n))]), pa.int32()), pa.array(flat, pa.string()))
                order = pa.array((np.arange(len(begins)) - begins).astype(np.int32))
                cols = [b.column("doc_id").take(line), b.column("line_number").take(line), pattern.cast(pa.int32()), names.take(pattern), order, pa.array(full, pa.string()), groups]
                return pa.RecordBatch.from_arrays([*cols, *([b.column("line").take(line)] if line_text else [])], fields)

            length = 0
            for i, line in enumerate(b.column("line")):
                line = line.as_py()
                if line is None:
                    continue
                ks = always.union(*[owners[h] for h in {h for _, h in automaton.iter(line)}]) if texts else always
                for k in sorted(ks):
                    runs[k] += 1
                    p = found[k]
                    if counted:
                        continue
                    if p.groups:
                        ms = list(p.finditer(line))
                        mine = [m[0] for m in ms]
                        for m in ms:
                            flat += m.groups()
                    else:
                        mine = [m[0] for m in p.finditer(line)]
                        flat += mine
                    if mine:
                        held.append((i, k, len(mine)))
                        sizes.append(max(p.groups, 1))
                        full += mine
                        length += len(line) * len(mine) if line_text else 0
                # A batch has some matches, or some text of lines that stand beside their matches.
                if len(full) >= 8192 or length > 8 << 20:
                    yield rows()
                    held, full, flat, sizes, length = [], [], [], [], 0
            if held:
                yield rows()
        if counted:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(sources)), pa.int32()), pa.array(runs, pa.int64())], ["pattern_index", "n_runs"])

    rows = lines.select("doc_id", F.col("line_number").cast("int").alias("line_number"), "line")
    if counted:
        return rows.mapInArrow(run, "pattern_index int, n_runs long").groupBy("pattern_index").agg(F.sum("n_runs").alias("n_runs"))
    kind = dict(lines.dtypes)["doc_id"]
    return rows.mapInArrow(run, f"doc_id {kind}, line_number int, pattern_index int, pattern string, match_ord int, full_match string, groups array<string>" + (", line string" if line_text else ""))
