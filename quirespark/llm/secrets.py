"""Secret scans with multipart credential linking, in DataFrame functions only.

Parts of credentials are found by patterns and carry a role: identifier, secret or endpoint.
Base kinds (assign, access, hex) are reported always. Weak kinds are reported only when
complementary parts stand within `gap` code points in the same text: an identifier next to a
secret, a bare key next to an identifier or endpoint, an endpoint with both an identifier and a
secret. A part does not complement one that it overlaps, and an endpoint's two parts don't overlap
each other. The interval join walks the begins and ends of each text's parts in order and looks at
the parts within `gap` on either side, of which it needs the first end and the last begin by role, so
that no pairs are formed and work grows with the number of parts.

Defined cases: a null text is empty and has no spans; null ids and repeated rows keep a row each;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import table

# Kinds in order, with pattern, group whose length counts, least length, role.
ASSIGN = "(?:(?i:password|passwd|secret|token|api_?key))[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
KINDS = [
    ("assign", ASSIGN, 1, 12, "secret"),
    ("access", "AKIA[A-Z0-9]+", 0, 18, "identifier"),
    ("hex", "[0-9a-f]{16,}", 0, 16, "secret"),
    ("identifier", "(?:(?i:client_id|access_key_id|account_id|username|user_id|login))[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9_.@-]+)", 1, 3, "identifier"),
    ("key", "(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/])", 0, 40, "secret"),
    ("endpoint", "https?://[^\\s\"'<>]+", 0, 11, "endpoint"),
]
N_BASE = 3


def _worth(kind: str, text: Column, low: Column) -> Column:
    """Whether a text can hold a part of this kind: a cheap test before the pattern runs."""
    some = lambda *words: F.greatest(*[F.contains(low, F.lit(w)) for w in words])
    return {
        "assign": some("password", "passwd", "secret", "token", "apikey", "api_key"),
        "access": F.contains(text, F.lit("AKIA")),
        "hex": F.rlike(text, F.lit("[0-9a-f]{16}")),
        "identifier": some("client_id", "access_key_id", "account_id", "username", "user_id", "login"),
        "key": F.rlike(text, F.lit("[A-Za-z0-9+/]{40}")),
        "endpoint": F.contains(text, F.lit("://")),
    }[kind]


def _parts(no: int, text: Column, low: Column) -> Column:
    """Each match of a kind: its length, the length of the text since the match before, and whether it counts."""
    kind, pattern, group, least, _ = KINDS[no]
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    between = F.split(text, pattern, -1)
    good = F.transform(value, lambda v: F.length(v) >= least)
    if kind == "key":  # a bare run of letters is no key
        good = F.transform(found, lambda m: F.rlike(m, F.lit("[A-Z]")) & F.rlike(m, F.lit("[a-z]")) & F.rlike(m, F.lit("[0-9]")))
    both = F.arrays_zip(F.transform(found, F.length).alias("n"), F.transform(F.slice(between, 1, F.size(found)), F.length).alias("gap"), good.alias("good"))
    rows = F.transform(both, lambda x, i: F.struct(F.lit(no).alias("kind"), i.alias("i"), x["n"].alias("n"), x["gap"].alias("gap"), x["good"].alias("good")))
    return F.when(_worth(kind, text, low), rows).otherwise(F.array().cast(_SCHEMA))


_SCHEMA = "array<struct<kind:int,i:int,n:int,gap:int,good:boolean>>"


def _found(docs: DataFrame, gap: int, text: bool) -> DataFrame:
    """A row a reported part: row_no, kind, start, end; and one a document, of kind -1, which alone has its columns as struct `doc`."""
    t = F.coalesce("text", F.lit(""))
    own = [F.col("`" + c.replace("`", "``") + "`") for c in (docs.columns if text else ["doc_id"])]
    d = docs.select(F.struct(*own).alias("doc"), t.alias("t")).withColumn("row_no", F.monotonically_increasing_id()).withColumn("low", F.lower("t"))
    parts = F.concat(*[_parts(k, F.col("t"), F.col("low")) for k in range(len(KINDS))])
    # A first part without a kind carries the document, once.
    none = F.expr("array(named_struct('kind', -1, 'i', 0, 'n', 0, 'gap', 0, 'good', false))").cast(_SCHEMA)
    d = d.select("row_no", "doc", F.explode(F.concat(none, parts)).alias("p")).select("row_no", F.when(F.col("p.kind") < 0, F.col("doc")).alias("doc"), "p.*")
    runs = Window.partitionBy("row_no", "kind").orderBy("i")
    d = d.withColumn("end", F.sum(F.col("gap") + F.col("n")).over(runs).cast("int")).withColumn("start", F.col("end") - F.col("n"))
    d = d.where("good or kind < 0")
    # Each part stands at its begin and at its end. What ends within `gap` before a begin, and what begins within `gap`
    # after an end, is near the part and disjoint from it; frames hold as many parts as fit into the gap.
    edges = F.when(F.col("kind") < 0, F.array(F.struct(F.lit(-1).alias("at"), F.lit(False).alias("opens")))).otherwise(
        F.array(F.struct(F.col("end").alias("at"), F.lit(False).alias("opens")), F.struct(F.col("start").alias("at"), F.lit(True).alias("opens"))))
    d = d.select("row_no", "doc", "kind", "start", "end", F.explode(edges).alias("e")).select("row_no", "doc", "kind", "start", "end", "e.*")
    line = Window.partitionBy("row_no").orderBy("at")
    sides = {"before": (F.col("opens"), ~F.col("opens"), line.rangeBetween(-gap, 0)), "after": (~F.col("opens"), F.col("opens"), line.rangeBetween(0, gap))}
    cols = []
    for side, (here, there, frame) in sides.items():
        for role in ("identifier", "secret", "endpoint"):
            has = there & F.col("kind").isin([k for k, x in enumerate(KINDS) if x[4] == role])
            # The first end and the last begin among those near on this side.
            cols += [F.when(here, f(F.when(has, F.col(c))).over(frame)).alias(f"{side}_{role}_{c}") for f, c in ((F.min, "end"), (F.max, "start"))]
    names = [f"{side}_{role}_{c}" for side in sides for role in ("identifier", "secret", "endpoint") for c in ("end", "start")]
    d = d.select("row_no", "doc", "kind", "start", "end", *cols)
    d = d.groupBy("row_no", "kind", "start", "end").agg(F.max_by("doc", F.when(F.col("kind") < 0, 1)).alias("doc"), *[F.max(c).alias(c) for c in names])
    on = lambda side, role: F.col(f"{side}_{role}_end").isNotNull()
    near = lambda role: on("before", role) | on("after", role)
    # Two of one side are disjoint if one ends before the other begins; those of two sides are.
    apart = lambda side, a, b: F.coalesce(F.col(f"{side}_{a}_end") <= F.col(f"{side}_{b}_start"), F.lit(False))
    i, s = "identifier", "secret"
    both = (on("before", i) & on("after", s)) | (on("before", s) & on("after", i))
    for side in sides:
        both = both | apart(side, i, s) | apart(side, s, i)
    ok = F.when(F.col("kind") < N_BASE, True).when(F.col("kind") == 3, near("secret")).when(F.col("kind") == 4, near("identifier") | near("endpoint")).otherwise(both)
    return d.where(ok).select("row_no", "doc", "kind", "start", "end")


def scan(docs: DataFrame, gap: int = 200) -> DataFrame:
    """A row a document: doc_id, base and linked: arrays of (start, kind, end), code points, end exclusive."""
    span = F.struct("start", "kind", "end")
    base = F.sort_array(F.collect_list(F.when(F.col("kind").between(0, N_BASE - 1), span))).alias("base")
    linked = F.sort_array(F.collect_list(F.when(F.col("kind") >= N_BASE, span))).alias("linked")
    rows = _found(docs, gap, text=False).groupBy("row_no").agg(F.max_by("doc", F.when(F.col("kind") < 0, 1)).alias("doc"), base, linked)
    return rows.select("doc.doc_id", "base", "linked")


def _said(spans: Column) -> Column:
    names = F.array(*[F.lit(k[0]) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def report(docs: DataFrame, gap: int = 200) -> DataFrame:
    n = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    every = F.sort_array(F.concat("base", "linked"))
    return scan(docs, gap).select(
        "doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"), F.sha2(_said(F.col("base")), 256).alias("base_sha256"),
        _said(every).alias("spans"), F.size("linked").cast("long").alias("n_linked"))


#: Code points of the blocks that a text is cut into once, so that no piece of it is looked for from its begin.
BLOCK = 4096


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _piece(blocks: Column, begin: Column, end: Column) -> Column:
    """Characters from begin to end of a text in blocks."""
    i, j = F.floor(begin / BLOCK).cast("int"), F.floor(end / BLOCK).cast("int")
    one = lambda k: F.coalesce(F.get(blocks, k), F.lit(""))
    first, inner = F.substring(one(i), begin - i * BLOCK + 1, F.when(i == j, end - begin).otherwise(F.lit(BLOCK))), F.array_join(F.slice(blocks, i + 2, F.greatest(j - i - 1, F.lit(0))), "")
    return F.when(i == j, first).otherwise(F.concat(first, inner, F.substring(one(j), F.lit(1), end - j * BLOCK)))


def redact(docs: DataFrame, gap: int = 200) -> DataFrame:
    """docs with every reported span of the text replaced by its kind in brackets; overlapping spans become one."""
    names = F.array(*[F.lit(k[0]) for k in KINDS])
    order = Window.partitionBy("row_no").orderBy("start", "kind", "end").rowsBetween(Window.unboundedPreceding, -1)
    # What spans before a part cover; a part that begins within that is in one of them.
    s = _found(docs, gap, text=True).withColumn("covered", F.coalesce(F.max("end").over(order), F.lit(0)))
    fresh = F.when((F.col("kind") >= 0) & (F.col("start") >= F.col("covered")), F.struct("start", "kind", "covered"))
    s = s.groupBy("row_no").agg(F.max_by("doc", F.when(F.col("kind") < 0, 1)).alias("doc"), F.sort_array(F.collect_list(fresh)).alias("spans"), F.max("end").alias("stop"))
    text = F.coalesce(F.col("doc.text"), F.lit(""))

    def masked(blocks: Column) -> Column:
        each = F.transform("spans", lambda x: F.concat(_piece(blocks, x["covered"], x["start"]), F.lit("["), F.element_at(names, x["kind"] + 1), F.lit("]")))
        return F.concat(F.array_join(each, ""), _piece(blocks, F.col("stop"), F.length(text)))

    new = F.when(F.size("spans") > 0, _let(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0)), masked)).otherwise(F.col("doc.text"))
    return s.select(*[(new if c == "text" else F.col("doc")[c]).alias(c) for c in docs.columns])


def op3_secrets(spark, sf_dir):
    return report(table(spark, sf_dir, "documents"))
