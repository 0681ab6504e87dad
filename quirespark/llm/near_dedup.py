"""Near-duplicate groups by SuperMinHash, banding, verification on full sets and union-find.

A document's set holds its distinct shingles of `words` consecutive words. Documents with equal
sets are one class, and the work is done on classes:

1. SuperMinHash: each element ranks the signature's places by a permutation of its own, in step j it
   offers j plus a fraction to its j-th place, and the steps stop once no offer can lower a place any
   more. 32 bands of 4 places miss a pair of similarity 0.8 once in 20 million.
2. Of classes that share a bucket with another one: the number of shingles that no other of them has.
   Such a shingle is in no intersection, so a class with over a fifth of them is linked with nothing.
3. In each bucket the class with the smallest share of shingles of its own is the hub, and all
   members are compared with it. Linked members form components.
4. Members that are not in their hub's component are compared with the members of other components
   in their buckets, save pairs that cannot reach the threshold given the sizes, the numbers of own
   shingles, and how each differs from the hub. So no link between bucket mates is lost, and groups
   of copies don't form pairs.

Defined cases: a null or empty text, or one without words, has an empty set and is linked with
nothing; with fewer words than a shingle the whole sequence is one; null ids are never smallest,
and a group of them alone has a null component and is not kept; repeated rows are in one class;
an empty table gives no rows; doc_id is an integer (of other types, what doesn't cast to long counts as
null); other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import WORD, bytes_of, chunks, cut, spread_join, table
from ._fields import among, bit_field
from ._keys import hashes, mixed, vocabulary

PLACES, ROWS = 128, 4
#: Elements whose permutations are worked on side by side.
SIDE = 40_000


def shingled(texts: list[bytes], words: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Each text's distinct shingles as sorted 64-bit keys; two fingerprints of each set."""
    seq, distinct, begins = vocabulary(t.lower().split() for t in texts)
    h = hashes(distinct)
    sets = []
    if len(seq):
        x = h[seq]
        k = x.copy()
        for i in range(1, words):
            k = mixed(k[:-1], x[i:])
    for b, e in zip(begins[:-1], begins[1:]):
        if e - b >= words:
            sets.append(np.unique(k[b : e - words + 1]))
        elif e > b:
            one = h[seq[b : b + 1]]
            for i in range(b + 1, e):
                one = mixed(one, h[seq[i : i + 1]])
            sets.append(mixed(one, int(e - b)))
        else:
            sets.append(np.zeros(0, dtype=np.uint64))
    marks = np.zeros((len(sets), 2), dtype=np.uint64)
    n = np.array([len(s) for s in sets])
    full = np.flatnonzero(n)
    if len(full):
        every, at = np.concatenate(sets), (np.cumsum(n) - n)[full]
        for j in (0, 1):
            marks[full, j] = mixed(np.add.reduceat(mixed(every, j + 1), at), n[full].astype(np.uint64))
    return sets, marks


def _fids(f1: np.ndarray, f2: np.ndarray) -> pa.Array:
    return pa.array([a + b for a, b in zip((x.tobytes() for x in f1), (x.tobytes() for x in f2))], pa.binary())


def superminhash(sets: list[np.ndarray], places: int = PLACES) -> np.ndarray:
    """Sets x places: the signatures of non-empty sets."""
    n = np.array([len(s) for s in sets], dtype=np.int64)
    key, of = np.concatenate(sets), np.repeat(np.arange(len(sets)), n)
    out = np.full((len(sets), places), np.inf)
    perm = np.tile(np.arange(places, dtype=np.uint8), (len(key), 1))
    rows = np.arange(len(key))
    for j in range(places):
        k = j + (mixed(key, 2 * j + 1) % np.uint64(places - j)).astype(np.int64)
        place = perm[rows, k].copy()
        perm[rows, k] = perm[rows, j]
        offer = j + (mixed(key, 2 * j + 2) >> np.uint64(11)).astype(np.float64) * 2.0**-53
        np.minimum.at(out.reshape(-1), of * places + place, offer)
        busy = out.max(axis=1) >= j + 1  # the next offers are j + 1 at least
        if not busy.any():
            break
        if not busy.all():
            stay = busy[of]
            if stay.mean() < 0.7:
                key, of, perm = key[stay], of[stay], perm[stay]
                rows = np.arange(len(key))
    return out


def _signed(words: int):
    """Task function: (doc_id, mark, text) to doc_id, mark, n, fid and, of a class's first text at hand, its band keys."""

    def run(batches):
        for b in chunks(batches, limit=1 << 20):
            sets, marks = shingled(bytes_of(b.column("text")), words)
            fids = _fids(marks[:, 0], marks[:, 1]).to_pylist()
            n = np.array([len(s) for s in sets], dtype=np.int64)
            first: dict[bytes, int] = {}
            for i in np.flatnonzero(n).tolist():
                first.setdefault(fids[i], i)
            bands: list = [None] * len(sets)
            mine, held = [], 0
            for k, i in enumerate(first.values(), start=1):
                mine.append(i)
                held += len(sets[i])
                if held >= SIDE or k == len(first):
                    sig = superminhash([sets[j] for j in mine]).view(np.uint64).reshape(len(mine), -1, ROWS)
                    band = np.tile(np.arange(sig.shape[1], dtype=np.uint64), (len(mine), 1))
                    for r in range(ROWS):
                        band = mixed(band, sig[:, :, r])
                    for j, keys in zip(mine, band.view(np.int64)):
                        bands[j] = keys
                    mine, held = [], 0
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("mark"), pa.array(n), pa.array(fids, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], ["doc_id", "mark", "n", "fid", "bands"])

    return run


def _sets(words: int, wanted):
    """Task function: (number, text) to fid and set of the texts whose number is in the field `wanted` or null; texts without words go."""

    def run(batches):
        for b in chunks(batches, limit=1 << 20):
            number = b.column("number")
            b = b.filter(pa.array(among(wanted.value, number.fill_null(0).to_numpy()) | number.is_null().to_numpy(zero_copy_only=False)))
            sets, marks = shingled(bytes_of(b.column("text")), words)
            full = [i for i, s in enumerate(sets) if len(s)]
            yield pa.RecordBatch.from_arrays([_fids(marks[full, 0], marks[full, 1]), pa.array([sets[i].tobytes() for i in full], pa.binary())], ["fid", "set"])

    return run


def _elements(batches):
    """Task function: a row an element of each set, with the class's number."""
    for b in batches:
        for c in chunks([b], "set", 1 << 20):
            raw = c.column("set").to_pylist()
            number = np.frombuffer(b"".join(c.column("fid").to_pylist()), dtype=np.int64)[::2]
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(b"".join(raw), dtype=np.int64)), pa.array(np.repeat(number, [len(r) // 8 for r in raw]))], ["key", "class"])


def alone(sets: DataFrame) -> DataFrame:
    """(fid, alone): for each class how many elements of its set no other of these classes has; classes are told apart by half their fingerprints."""
    found = sets.mapInArrow(_elements, "key long, class long").groupBy("key").agg(F.min("class").alias("class"), F.max("class").alias("_top"))
    own = found.where(F.col("class") == F.col("_top")).groupBy("class").agg(F.count("*").alias("alone"))
    classes = sets.select("fid").mapInArrow(lambda it: (pa.RecordBatch.from_arrays([b.column(0), pa.array(np.frombuffer(b"".join(b.column(0).to_pylist()), dtype=np.int64)[::2])], ["fid", "class"]) for b in it), "fid binary, class long")
    return classes.join(own.hint("merge"), "class", "left").select("fid", F.coalesce("alone", F.lit(0)).alias("alone"))


def _overlaps(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) of classes with the size of their intersection, and whether they are linked."""

    def run(batches):
        for b in batches:
            both, linked = [], []
            for x, y in zip(b.column("set_a").to_pylist(), b.column("set_b").to_pylist()):
                x, y = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
                both.append(len(np.intersect1d(x, y, assume_unique=True)))
                linked.append(100 * both[-1] >= 80 * (len(x) + len(y) - both[-1]))
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(both, pa.int64()), pa.array(linked, pa.bool_())], ["a", "b", "both", "linked"])

    s = sets.select("fid", "set")
    both = pairs.join(s.select(F.col("fid").alias("a"), F.col("set").alias("set_a")).hint("merge"), "a")
    both = spread_join(both, s.select(F.col("fid").alias("b"), F.col("set").alias("set_b")), ["b"], ["a"])
    return both.select("a", "b", "set_a", "set_b").mapInArrow(run, "a binary, b binary, both long, linked boolean")


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of all nodes of edges (a, b): equal labels within a component.

    Union-find within each partition leaves a forest; then every node's larger and smaller
    neighbours move to its smallest one by turns until nothing changes.
    """

    def forest(batches):
        up: dict[bytes, bytes] = {}

        def top(x):
            while up.setdefault(x, x) != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        for batch in batches:
            for x, y in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
                x, y = top(x), top(y)
                if x != y:
                    up[max(x, y)] = min(x, y)
        out = [(x, top(x)) for x in list(up)]
        for i in range(0, len(out), 10_000):
            a, b = zip(*out[i : i + 10_000])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])

    e = cut(edges.mapInArrow(forest, "a binary, b binary").where("a != b").distinct())
    while True:
        both = e.union(e.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        new = spread_join(both.where("b > a"), least, ["a"], ["b"]).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = new.groupBy("a").agg(F.min("b").alias("m"))
        new = new.join(least.hint("merge"), "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where("a != b").distinct()
        e, old = cut(new), e
        if e.count() == old.count() and e.join(old.hint("merge"), ["a", "b"], "left_anti").isEmpty():
            break
    return e.select(F.col("a").alias("node"), F.col("b").alias("label")).union(e.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())


def _possible(x: str, y: str) -> Column:
    """Whether classes x and y can be linked, by sizes and shingles of their own: the intersection is at most `most`, and 1.8 times it has to reach 0.8 times the sum of sizes."""
    most = F.least(F.col(f"{x}.n") - F.col(f"{x}.alone"), F.col(f"{y}.n") - F.col(f"{y}.alone"))
    return 9 * most >= 4 * (F.col(f"{x}.n") + F.col(f"{y}.n"))


def _beyond_hub(x: str, y: str) -> Column:
    """Whether classes x and y of a hub's bucket can be linked, by what they lack of the hub and have besides it: in their intersection is the hub less what either lacks, and what both have besides."""
    shared = lambda c: F.coalesce(F.col(f"{c}_both"), F.least(F.col(f"{c}.n") - F.col(f"{c}.alone"), F.col("hub.n") - F.col("hub.alone")))
    besides = lambda c: F.col(f"{c}.n") - F.coalesce(F.col(f"{c}_both"), F.lit(0)) - F.col(f"{c}.alone")
    most = F.least(shared(x), shared(y)) + F.least(besides(x), besides(y))
    return 9 * most >= 4 * (F.col(f"{x}.n") + F.col(f"{y}.n"))


def _known(df: DataFrame, x: str, label: DataFrame, stars: DataFrame) -> DataFrame:
    """df with the component of struct x, and the size of its intersection with the hub where that was computed."""
    df = df.join(label.select(F.col("node").alias("_n"), F.col("label").alias("_l")).hint("merge"), F.col(f"{x}.fid") == F.col("_n"), "left")
    df = df.withColumn(f"{x}_label", F.coalesce("_l", F.col(f"{x}.fid"))).drop("_n", "_l")
    s = stars.select(F.col("a").alias("_a"), F.col("b").alias("_b"), F.col("both").alias(f"{x}_both"))
    return df.join(s.hint("merge"), (F.col(f"{x}.fid") == F.col("_a")) & (F.col("hub.fid") == F.col("_b")), "left").drop("_a", "_b")


def _grouped(docs: DataFrame, words: int) -> tuple[DataFrame, DataFrame]:
    """(a row a document: doc_id, mark (hash of the text), n, fid; a row a class: fid, rep (smallest id), label (equal within a component))."""
    d = docs.select(F.col("doc_id").try_cast("long").alias("doc_id"), "text")
    info = cut(d.select("doc_id", F.xxhash64("text").alias("mark"), "text").mapInArrow(_signed(words), "doc_id long, mark long, n long, fid binary, bands array<long>"))
    classes = cut(info.where("n > 0").groupBy("fid").agg(F.min("doc_id").alias("rep"), F.max("n").alias("n"), F.max("bands").alias("bands")))
    keys = classes.select("fid", F.explode("bands").alias("key"))
    shared = keys.groupBy("key").agg(F.count("*").alias("size")).where("size > 1").select("key")
    mates = cut(keys.join(shared.hint("merge"), "key", "left_semi").select("fid").distinct().join(classes.hint("merge"), "fid"))
    # One text for each class with bucket mates: by its smallest id, which a bit field knows; texts without id are few and are looked at one by one.
    number = F.xxhash64("doc_id")
    wanted = docs.sparkSession.sparkContext.broadcast(bit_field(mates.where("rep is not null").select(F.xxhash64("rep").alias("number")), "number"))
    texts = d.select(F.when(F.col("doc_id").isNotNull(), number).alias("number"), "text")
    sets = cut(texts.mapInArrow(_sets(words, wanted), "fid binary, set binary").dropDuplicates(["fid"]).join(mates.hint("merge"), "fid"))
    wanted.destroy()
    able = alone(sets).join(sets.hint("merge"), "fid").where("5 * (n - alone) >= 4 * n")
    sets = cut(able.select("fid", "set", "bands", "rep", "n", "alone"))
    members = sets.select(F.explode("bands").alias("key"), F.struct("fid", "n", "alone").alias("x"))
    hub = F.min(F.struct(F.col("x.alone") / F.col("x.n"), F.struct("x.fid", "x.n", "x.alone").alias("x"))).getField("x")
    buckets = members.groupBy("key").agg(F.count("*").alias("size"), hub.alias("hub"), F.min("x.n").alias("least")).where("size > 1").drop("size")
    inside = members.join(buckets.hint("merge"), "key").where("x.fid != hub.fid")
    stars = cut(_overlaps(inside.where(_possible("x", "hub")).select(F.col("x.fid").alias("a"), F.col("hub.fid").alias("b")).distinct(), sets))
    links = stars.where("linked").select("a", "b")
    label = components(links)
    # Members outside their hub's component that could be linked with the bucket's smallest set.
    rest = inside.where(4 * F.col("least") <= 5 * F.col("x.n") - 9 * F.col("x.alone"))
    rest = _known(rest, "x", label, stars).join(label.select(F.col("node").alias("h"), F.col("label").alias("hub_label")).hint("merge"), F.col("hub.fid") == F.col("h"), "left")
    rest = rest.where(F.col("x_label") != F.coalesce("hub_label", F.col("hub.fid")))
    bands = lambda df, x: df.join(sets.select(F.col("fid").alias("f"), F.col("bands").alias(f"{x}_bands")).hint("merge"), F.col(f"{x}.fid") == F.col("f")).drop("f")
    rest = cut(bands(rest.select("key", "x", "hub", "x_label", "x_both"), "x"))
    near = members.withColumnRenamed("x", "y").join(rest.select("key", "hub").distinct().hint("merge"), "key").where("y.fid != hub.fid")
    near = bands(_known(near, "y", label, stars), "y").drop("hub")
    # A pair is looked at in the first bucket that it has in common.
    more = rest.join(near.hint("merge"), "key").where(F.col("x_label") != F.col("y_label")).where(_possible("x", "y")).where(_beyond_hub("x", "y"))
    more = more.where(F.element_at(F.array_intersect("x_bands", "y_bands"), 1) == F.col("key"))
    more = more.select(F.least("x.fid", "y.fid").alias("a"), F.greatest("x.fid", "y.fid").alias("b")).distinct()
    late = cut(_overlaps(more, sets).where("linked").select("a", "b"))
    whole = label if late.isEmpty() else components(links.union(late))
    rep = classes.select("fid", "rep").join(whole.withColumnRenamed("node", "fid").hint("merge"), "fid", "left")
    return info.drop("bands"), rep.withColumn("label", F.coalesce("label", "fid"))


def groups(docs: DataFrame, words: int = 5) -> DataFrame:
    """A row a document of docs (doc_id, text): doc_id, n_shingles, class_id, component_id, kept."""
    info, classes = _grouped(docs, words)
    classes = cut(classes)
    smallest = classes.groupBy("label").agg(F.min("rep").alias("component_id"))
    found = spread_join(classes, smallest, ["label"], ["fid"]).select("fid", F.col("rep").alias("class_id"), "component_id")
    full = spread_join(info.where("n > 0"), found, ["fid"], ["doc_id", "mark"])
    out = full.select("doc_id", "n", "class_id", "component_id").unionByName(info.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("component_id")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "class_id", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def keep_one(docs: DataFrame, words: int = 5) -> DataFrame:
    """docs with one row of each group: that with the smallest id, then hash of its text; rows without id come last. Rows with equal ids and equal texts are one; rows without words are in no group and stay."""
    info, classes = _grouped(docs, words)
    rows = spread_join(info.where("n > 0"), classes.select("fid", "label"), ["fid"], ["doc_id", "mark"])
    named = rows.select("label", F.isnull("doc_id").cast("int").alias("_none"), F.coalesce("doc_id", F.lit(0)).alias("_id"), F.col("mark").alias("_mark"))
    first = named.groupBy("label").agg(F.min(F.struct("_none", "_id", "_mark")).alias("k")).select("k.*")
    by = ["_id", "_none", "_mark"]
    # The row travels as a struct, so that its columns may have any names.
    d = docs.select(F.struct("*").alias("doc"), F.coalesce(F.col("doc_id").try_cast("long"), F.lit(0)).alias("_id"), F.col("doc_id").try_cast("long").isNull().cast("int").alias("_none"), F.xxhash64("text").alias("_mark"))
    # Of rows with equal ids and texts the one whose other columns hash least.
    others = [F.col("doc")[c] for c, kind in docs.dtypes if c not in ("doc_id", "text") and "map<" not in kind and "variant" not in kind]
    one = Window.partitionBy(*by).orderBy(F.xxhash64(*others) if others else F.lit(0))
    words_in = F.rlike(F.coalesce("doc.text", F.lit("")), F.lit(WORD))
    kept = d.where(words_in).join(first.hint("merge"), by, "left_semi").withColumn("_no", F.row_number().over(one)).where("_no = 1").select("doc").unionByName(d.where(~words_in).select("doc"))
    return kept.select(*[F.col("doc")[c].alias(c) for c in docs.columns])


def op4_near_dedup(spark, sf_dir):
    return groups(table(spark, sf_dir, "documents"), words=4)
