"""Benchmark decontamination by a prefix-filtered join of item windows with whole documents.

An item's windows are its runs of `window` consecutive words (a shorter item is one window). Words are
ordered by how rare they are in all documents. A window is contained in a document only if its rarest
two words are there at their distance, so these and the distance are the window's prefix, on which it
is joined with the documents. Length and position give the one place where the window would have to
stand, and the words there are compared one by one.

A task finds the prefixes in its texts: places of words that are the rarest of some window, and for
each distance the pairs that some window has. It knows them by two bit fields of bounded size (`_fields.BITS`),
which are all that is broadcast; what a bit field lets through by chance falls in the join. Counts of
rarity, windows, prefixes and findings are tables, so the benchmark's size has no bound, and documents
are read twice whatever it is.

Defined cases: words are runs of a-z, 0-9 and non-ASCII characters after lower-casing A-Z, and are
compared by 64-bit hashes, a window by those of all its words; a null or empty text has no words and
is clean; an item without words or with a null id is left out (a null id cannot be reported); repeated
items and rows count once in items and keep a row each in documents; an empty benchmark leaves all
clean; doc_id is an integer (what doesn't cast to long counts as null); other columns are ignored or, in `clean`, kept.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import bytes_of, chunks, cut, spread_join, table
from ._fields import among, bit_field
from ._keys import hashes, mixed, vocabulary

#: a-z, 0-9 and bytes from 0x80 stand for themselves, A-Z for a-z, all else for a space.
FOLD = bytes(c if c >= 0x80 or chr(c).isdigit() or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
#: Rows up to which a list of found documents is broadcast, for want of an exchange of all texts.
FEW = 500_000


def words(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


def _encoded(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the distinct words, all texts' words as places among them, and where each text begins."""
    seq, distinct, begins = vocabulary(map(words, bytes_of(batch.column("text"))))
    return hashes(distinct), seq, begins


def _windows(window: int):
    """Task function: (item, text) to (item, seq): the hashes of each window's words."""

    def run(batches):
        for b in chunks(batches):
            h, seq, begins = _encoded(b)
            for item, x, y in zip(b.column("item").to_pylist(), begins[:-1].tolist(), begins[1:].tolist()):
                n = min(window, y - x)
                if n:
                    seen = np.unique(np.lib.stride_tricks.sliding_window_view(h[seq[x:y]], n), axis=0).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array([item] * len(seen)), pa.ListArray.from_arrays(np.arange(0, seen.size + 1, n, dtype=np.int32), pa.array(seen.ravel()))], ["item", "seq"])

    return run


def prefix_key(rare: np.ndarray, second: np.ndarray, distance) -> np.ndarray:
    return mixed(mixed(rare, second), (np.asarray(distance, dtype=np.int64) + 4096).astype(np.uint64) + np.zeros(len(rare), dtype=np.uint64))


def _keyed(batches):
    """Task function: (seq, place, second) with the key of the prefix."""
    for b in batches:
        seqs, place, second = b.column("seq").to_pylist(), b.column("place").to_numpy(), b.column("second").to_numpy()
        word = lambda at: np.array([s[k] for s, k in zip(seqs, at)], dtype=np.int64).view(np.uint64)
        key = prefix_key(word(place), word(second), second - place) if len(seqs) else np.zeros(0, dtype=np.uint64)
        yield pa.RecordBatch.from_arrays([b.column("seq"), b.column("place"), pa.array(key.view(np.int64)), pa.array(word(place).view(np.int64))], ["seq", "place", "key", "rare"])


def _counts(held):
    """Task function: how often each word that the field lets through stands in the texts of a task, summed up a few million words at a time."""

    def rows(found: list) -> pa.RecordBatch:
        keys, which = np.unique(np.concatenate([k for k, _ in found]), return_inverse=True)
        n = np.bincount(which, np.concatenate([c for _, c in found]), len(keys)).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n)], ["word", "n"])

    def run(batches):
        found, size = [], 0
        for b in chunks(batches):
            h, seq, _ = _encoded(b)
            some = np.flatnonzero(among(held.value, h))
            found.append((h[some], np.bincount(seq, minlength=len(h))[some]))
            size += len(some)
            if size > 1 << 21:
                yield rows(found)
                found, size = [], 0
        if found:
            yield rows(found)

    return run


def prefixed(docs: DataFrame, benchmark: DataFrame, window: int) -> DataFrame:
    """Distinct windows (seq, place of the rarest word, key of the prefix, rare: that word), with `items`: the ids of the items that have them."""
    spark = docs.sparkSession
    items = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("string").alias("item"), "text").distinct()
    each = cut(items.mapInArrow(_windows(window), "item string, seq array<long>"))
    own = each.select(F.explode("seq").alias("word")).distinct()
    field = spark.sparkContext.broadcast(bit_field(own, "word"))
    counts = docs.select("text").mapInArrow(_counts(field), "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    rarity = cut(own.join(counts.hint("merge"), "word", "left").select("word", F.coalesce("n", F.lit(0)).alias("n")))
    field.destroy()
    w = each.groupBy("seq").agg(F.collect_set("item").alias("items"))
    placed = spread_join(w.select("seq", F.posexplode("seq").alias("at", "word")), rarity, ["word"], ["seq", "at"])
    order = F.sort_array(F.collect_list(F.struct("n", "word", "at")))
    rare = placed.groupBy("seq").agg(order.alias("o")).select("seq", F.get("o", F.lit(0))["at"].alias("place"), F.coalesce(F.get("o", F.lit(1))["at"], F.get("o", F.lit(0))["at"]).alias("second"))
    return cut(rare.mapInArrow(_keyed, "seq array<long>, place int, key long, rare long").join(w.hint("merge"), "seq"))


FOUND = "doc_id long, mark long, n_words long, at int, lead int, key long, context array<long>"


def _prefixes(rare, keys, window: int):
    """Task function: (doc_id, mark, text) to a row of FOUND for each text, with n_words, and for each prefix in it: the place of its rarest word, the words around (`lead` of them before), and the key."""

    def run(batches):
        for b in chunks(batches):
            h, seq, begins = _encoded(b)
            n = len(begins) - 1
            none = lambda t: pa.nulls(n, t)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("mark"), pa.array(np.diff(begins), pa.int64()), none(pa.int32()), none(pa.int32()), none(pa.int64()), none(pa.list_(pa.int64()))], NAMES)
            if not len(seq):
                continue
            at = np.flatnonzero(among(rare.value, h)[seq])
            doc = np.searchsorted(begins, at, side="right") - 1
            x, low, high = h[seq], begins[doc], begins[doc + 1]
            found = []
            for d in range(1 - window, window):
                k = np.flatnonzero((at + d >= low) & (at + d < high))
                key = prefix_key(x[at[k]], x[at[k] + d], d)
                ok = among(keys.value, key)
                found.append((k[ok], key[ok]))
            k, key = (np.concatenate(c) for c in zip(*found))
            for i in range(0, len(k), 20_000):
                p, kk = at[k[i : i + 20_000]], key[i : i + 20_000]
                first, last = np.maximum(p - window + 1, low[k[i : i + 20_000]]), np.minimum(p + window, high[k[i : i + 20_000]])
                size = last - first
                ends = np.concatenate([[0], np.cumsum(size)])
                around = x[np.arange(ends[-1]) - np.repeat(ends[:-1], size) + np.repeat(first, size)]
                of = pa.array(doc[k[i : i + 20_000]])
                yield pa.RecordBatch.from_arrays([
                    b.column("doc_id").take(of), b.column("mark").take(of), pa.nulls(len(p), pa.int64()), pa.array(p - low[k[i : i + 20_000]], pa.int32()), pa.array(p - first, pa.int32()),
                    pa.array(kk.view(np.int64)), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(around.view(np.int64)))], NAMES)

    return run


NAMES = [x.split()[0] for x in FOUND.split(", ")]


def _named(df: DataFrame) -> DataFrame:
    return df.withColumns({"_id": F.coalesce(F.col("doc_id").try_cast("long"), F.lit(0)), "_none": F.col("doc_id").isNull()})


BY = ["_id", "_none", "mark"]


def occurrences(docs: DataFrame, benchmark: DataFrame, window: int) -> tuple[DataFrame, DataFrame]:
    """(a row a document: doc_id, mark (hash of the text), n_words; a row a window's occurrence in a document: doc_id, mark, start, end, items)."""
    sc = docs.sparkSession.sparkContext
    d = docs.select(F.col("doc_id").try_cast("long").alias("doc_id"), "text")
    w = prefixed(d, benchmark, window)
    rare, keys = sc.broadcast(bit_field(w.select("rare").distinct(), "rare")), sc.broadcast(bit_field(w.select("key").distinct(), "key"))
    found = cut(d.select("doc_id", F.xxhash64("text").alias("mark"), "text").mapInArrow(_prefixes(rare, keys, window), FOUND))
    rare.destroy()
    keys.destroy()
    met = spread_join(found.where("key is not null").select("doc_id", "mark", "at", "lead", "key", "context"), w.select("key", "seq", "place", "items"), ["key"], ["doc_id", "mark", "at"])
    n, start = F.size("seq"), F.col("lead") - F.col("place")
    inside = (start >= 0) & (start + n <= F.size("context"))
    met = met.where(inside).where(F.slice("context", F.greatest(start, F.lit(0)) + 1, n) == F.col("seq"))
    begin = F.col("at") - F.col("place")
    # Of equal rows of documents one is enough.
    hits = met.select("doc_id", "mark", begin.alias("start"), (begin + n).alias("end"), "items").dropDuplicates(["doc_id", "mark", "start", "end"])
    return found.where("key is null").select("doc_id", "mark", "n_words"), hits


def contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """A row a document of docs (doc_id, text): doc_id, n_words, hits: word ranges that lie in some window of an item, end exclusive; items: ids of items with such windows."""
    texts, hits = occurrences(docs, benchmark, window)
    hits = cut(_named(hits))
    line = Window.partitionBy(*BY).orderBy("start", "end")
    reach = F.max("end").over(line.rowsBetween(Window.unboundedPreceding, -1))
    ranges = hits.withColumn("fresh", F.coalesce((F.col("start") > reach).cast("int"), F.lit(1))).withColumn("no", F.sum("fresh").over(line))
    ranges = ranges.groupBy(*BY, "no").agg(F.min("start").alias("start"), F.max("end").alias("end")).groupBy(*BY).agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("hits"))
    items = hits.select(*BY, F.explode("items").alias("item")).distinct().groupBy(*BY).agg(F.sort_array(F.collect_list("item")).alias("items"))
    out = _named(texts).join(ranges.join(items.hint("merge"), BY).hint("merge"), BY, "left")
    return out.select("doc_id", "n_words", _or_empty("hits", "array<struct<start:int,end:int>>"), _or_empty("items", "array<string>"))


def _or_empty(column: str, kind: str) -> Column:
    return F.coalesce(F.col(column), F.array().cast(kind)).alias(column)


def clean(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """docs without those that contain a window of an item."""
    bad = cut(_named(occurrences(docs, benchmark, window)[1]).select(*BY).distinct())
    bad = F.broadcast(bad) if bad.count() <= FEW else bad.hint("merge")
    # The row travels as a struct, so that its columns may have any names.
    d = docs.select(F.struct("*").alias("doc"), F.coalesce(F.col("doc_id").try_cast("long"), F.lit(0)).alias("_id"), F.col("doc_id").try_cast("long").isNull().alias("_none"), F.xxhash64("text").alias("mark"))
    return d.join(bad, BY, "left_anti").select(*[F.col("doc")[c].alias(c) for c in docs.columns])


def op9_decontaminate(spark, sf_dir):
    found = contaminated(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda a, h: a + h["end"] - h["start"])
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))
