"""Mixing sources to target weights.

Each source's words form one stream, in a fixed pseudorandom order of its documents, and the stream
is cut into blocks of `block_words` words (fewer in a source of under 16 such blocks; the last block
may be shorter). A source's target in words is taken in passes over its blocks; each pass takes the
whole blocks in the order of a pseudorandom permutation of its own, then the short one. These are the
source's slots; the last one takes only as many words as are left, so that a source's words are its
target's, rounded. Each source's slots are dealt to the output shards by a multinomial draw: given
the sources' totals, the counts by shard are what multinomial draws of every shard over the sources
give. Slots and blocks meet in a join by (source, block index).

Sources are a table: their order, weights, targets and slots are made by aggregates and joins, of
which the driver sees a few sums, so their number has no bound.

Defined cases: a null text has no words; a null source is a source of its own, after all others;
null ids and repeated rows are documents like any other; an empty table gives no rows; columns
beyond doc_id, text and source are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import WORD, cut, partitions, spread_join, table

#: Each source's stream is summed up in this many pieces side by side.
CHUNKS = 4096
#: Slots of one shard and source are dealt to tasks in runs of this many.
RUN = 8192
#: Rounds of the index permutation.
ROUNDS = 24
#: Whole blocks that a source has at least, as far as it has words.
LEAST_BLOCKS = 16


def ranked(sources: DataFrame, weights) -> DataFrame:
    """sources (source, n) with source_no, by code point and null last, and the weight of that place, weights repeating. Range partitions are numbered by themselves and then moved on by the counts of those before."""
    by = [F.col("source").isNull(), F.col("source")]
    s = cut(sources.repartitionByRange(partitions(sources.sparkSession), *by).withColumn("part", F.spark_partition_id()))
    within = Window.partitionBy("part").orderBy(*by)
    counts = s.groupBy("part").agg(F.count("*").alias("c"))  # a row a partition
    before = counts.select("part", F.coalesce(F.sum("c").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    s = s.withColumn("i", F.row_number().over(within) - 1).join(before, "part").withColumn("source_no", F.col("i") + F.col("before"))
    w = F.array(*[F.lit(float(x)) for x in weights])
    return s.select("source_no", "source", "n", F.get(w, F.pmod("source_no", F.lit(len(weights))).cast("int")).alias("weight"))


def with_targets(sources: DataFrame, most: float) -> DataFrame:
    """sources (n, weight) with target: shares of the sum of sizes by weight; a source stops at `most` times its size, and what is over goes to the others by weight. Each round is one sum over the sources."""
    first = sources.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("weight"), F.lit(0.0)).alias("w")).first()
    share = first.n / first.w if first.w else 0.0
    while True:
        stops = most * F.col("n") < share * F.col("weight")
        r = sources.agg(F.coalesce(F.sum(F.when(stops, F.col("n"))), F.lit(0)).alias("n"), F.coalesce(F.sum(F.when(~stops, F.col("weight"))), F.lit(0.0)).alias("w")).first()
        new = (first.n - most * r.n) / r.w if r.w else share
        if new <= share * (1 + 1e-12):
            return sources.withColumn("target", F.when(stops, most * F.col("n")).otherwise(share * F.col("weight")))
        share = new


def permuted(index: Column, n: Column, *seeds: Column) -> Column:
    """The image of index under a pseudorandom permutation of 0..n-1: in each round, an index and its partner swap or stay together."""

    def step(x, k):
        partner = F.pmod(F.xxhash64(k, *seeds) - x, n)
        return F.when(F.xxhash64(k, F.greatest(x, partner), *seeds) % 2 == 0, partner).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), index.cast("long"), step)


def drawn(sources: DataFrame, shards: int, seed: int) -> DataFrame:
    """(source_no, shard, start, count): each source's slots dealt to the shards by a multinomial draw, a run of slots each."""

    def run(frames):
        for f in (f for f in frames if len(f)):
            counts = np.stack([np.random.default_rng([seed, no]).multinomial(n, even) for no, n in zip(f["source_no"], f["slots"])])
            row, shard = np.nonzero(counts)
            yield pd.DataFrame({"source_no": f["source_no"].to_numpy()[row], "shard": shard.astype(np.int32), "start": (np.cumsum(counts, axis=1) - counts)[row, shard], "count": counts[row, shard]})

    even = np.full(shards, 1 / shards)
    return sources.where("slots > 0").select("source_no", "slots").mapInPandas(run, "source_no long, shard int, start long, count long")


class Mix:
    """A mix of docs (doc_id, text, source). weights: by source in code point order, null last, repeating; most: times that a word is taken at most.

    sources: one row a source; slots: the output's slots, with the block that each takes and how many of its words.
    """

    def __init__(self, docs: DataFrame, weights=(1.0, 2.0, 3.0), most: int = 3, block_words: int = 256, shards: int = 64, seed: int = 7):
        self.docs = docs.select("doc_id", "source", "text", F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long").alias("size"), F.xxhash64("text").alias("mark"))
        self.sized = cut(self.docs.drop("text"))
        b = F.greatest(F.least(F.lit(block_words), F.floor(F.col("n") / LEAST_BLOCKS)), F.lit(1)).cast("long")
        s = with_targets(ranked(self.sized.groupBy("source").agg(F.sum("size").alias("n")), weights), float(most))
        s = s.withColumns({"block_words": b, "words": F.least(F.round("target").cast("long"), most * F.col("n"))})
        s = s.withColumn("full", F.floor(F.col("n") / F.col("block_words"))).withColumn("short", F.col("n") - F.col("full") * F.col("block_words"))
        s = s.withColumn("passes", F.when(F.col("n") > 0, F.floor(F.col("words") / F.col("n"))).otherwise(0).cast("long")).withColumn("rest", F.col("words") - F.col("passes") * F.col("n"))
        s = s.withColumn("a_pass", F.col("full") + (F.col("short") > 0).cast("long")).withColumn("slots", F.col("passes") * F.col("a_pass") + F.ceil(F.col("rest") / F.col("block_words")))
        self.sources = cut(s.withColumnRenamed("n", "source_size"))
        self.slots = self._slots(shards, seed)

    def _slots(self, shards: int, seed: int) -> DataFrame:
        plan = drawn(self.sources, shards, seed).withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.col("count") - 1, F.lit(RUN).cast("long"))))
        j = F.explode(F.sequence(F.col("start") + F.col("run"), F.col("start") + F.least(F.col("count"), F.col("run") + RUN) - 1))
        one = spread_join(plan, self.sources.select("source_no", "source", "block_words", "full", "short", "a_pass", "slots", "words", "source_size", "passes", "rest"), ["source_no"], ["shard", "run"])
        # A run is a small row and much work: a given number of partitions is not coalesced by its size.
        one = one.repartition(partitions(self.docs.sparkSession), "shard", "source_no", "run").withColumn("j", j)
        one = one.withColumn("pass", F.floor(F.col("j") / F.col("a_pass"))).withColumn("i", F.col("j") - F.col("pass") * F.col("a_pass"))
        block = F.when(F.col("i") < F.col("full"), permuted(F.col("i"), F.greatest("full", F.lit(1)), F.lit(seed), F.col("source_no"), F.col("pass"))).otherwise(F.col("i"))
        whole = F.when(F.col("i") < F.col("full"), F.col("block_words")).otherwise(F.col("short"))
        n_words = F.when(F.col("pass") == F.col("passes"), F.least(whole, F.col("rest") - F.col("i") * F.col("block_words"))).otherwise(whole)
        return one.select("shard", "source_no", "source", "j", "pass", block.alias("block"), n_words.alias("n_words"), (n_words < whole).alias("partial"))

    def documents(self, text: bool = False) -> DataFrame:
        """Documents with their source's row and begins, the number of words before them in its stream; text: with the text."""
        s = (self.docs if text else self.sized).withColumns({"_source": F.coalesce("source", F.lit("")), "_none": F.isnull("source")})
        by = self.sources.select(F.coalesce("source", F.lit("")).alias("_source"), F.isnull("source").alias("_none"), "source_no", "source_size", "target", "block_words")
        s = s.withColumn("order", F.xxhash64(F.lit("order"), "doc_id")).withColumn("chunk", F.pmod("order", F.lit(CHUNKS)).cast("int"))
        sums = self.sized.withColumn("chunk", F.pmod(F.xxhash64(F.lit("order"), "doc_id"), F.lit(CHUNKS)).cast("int")).groupBy("source", "chunk").agg(F.sum("size").alias("n"))
        before = Window.partitionBy("source").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
        sums = sums.select(F.coalesce("source", F.lit("")).alias("_source"), F.isnull("source").alias("_none"), "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("chunk_begins"))
        # A chunk of a source is one 4096th of it: what the streams' pieces need is a row a chunk.
        keyed = sums.join(by.hint("merge"), ["_source", "_none"])
        inner = Window.partitionBy("_source", "_none", "chunk").orderBy("order", "doc_id", "mark").rowsBetween(Window.unboundedPreceding, -1)
        s = s.withColumn("in_chunk", F.coalesce(F.sum("size").over(inner), F.lit(0)))
        return s.join(keyed.hint("merge"), ["_source", "_none", "chunk"]).withColumn("begins", F.col("chunk_begins") + F.col("in_chunk")).drop("_source", "_none", "chunk", "order", "mark", "chunk_begins", "in_chunk")

    def pieces(self, text: bool = False) -> DataFrame:
        """A row for each block that a document's words fall into: words from `word` on, n_words of them, `off` words after the block's begin; text: with the words."""
        d = self.documents(text).where("size > 0")
        b = F.col("block_words")
        ends, first = F.col("begins") + F.col("size"), F.floor(F.col("begins") / b)
        cols = ["source_no", "doc_id", "begins"]
        if text:
            d = d.withColumn("words", F.filter(F.split("text", "[\\x20\\x09-\\x0D]+"), lambda w: w != ""))
        starts = F.transform(F.sequence(first, F.floor((ends - 1) / b)), lambda k: F.struct(
            k.alias("block"), (F.greatest(k * b, F.col("begins")) - F.col("begins")).cast("int").alias("word"), (F.greatest(k * b, F.col("begins")) - k * b).cast("int").alias("off"),
            (F.least((k + 1) * b, ends) - F.greatest(k * b, F.col("begins"))).cast("int").alias("n_words")))
        if text:
            starts = F.transform(starts, lambda p: p.withField("text", F.array_join(F.slice("words", p["word"] + 1, p["n_words"]), " ")))
        return d.select(*cols, F.explode(starts).alias("p")).select(*cols, "p.*")

    def taken(self) -> DataFrame:
        """Documents with source_size, target and taken: the words that the mix takes of each, repeats counted."""
        times = self.slots.groupBy("source_no", "block").agg(F.count_if(~F.col("partial")).alias("times"), F.coalesce(F.max(F.when(F.col("partial"), F.col("n_words"))), F.lit(0)).alias("some"))
        got = self.pieces().join(times.hint("merge"), ["source_no", "block"])  # slots grow with the input, whatever size the optimizer takes them for
        words = F.col("times") * F.col("n_words") + F.greatest(F.least(F.col("some") - F.col("off"), F.col("n_words")), F.lit(0))
        got = got.groupBy("source_no", "begins").agg(F.sum(words).alias("got"))
        got = got.withColumn("has", F.lit(True))
        docs = self.documents().select("doc_id", "source", "size", "source_size", "target", "source_no", "begins", (F.col("size") > 0).alias("has"))
        return docs.join(got.hint("merge"), ["source_no", "begins", "has"], "left").select("doc_id", "source", "size", "source_size", "target", F.coalesce("got", F.lit(0)).cast("long").alias("taken"))

    def blocks(self) -> DataFrame:
        """The mix itself: a row a slot, with its words as one text and the documents that they come from."""
        p = F.struct("off", "begins", "doc_id", "word", "n_words", "text")
        whole = self.pieces(text=True).groupBy("source_no", "block").agg(F.sort_array(F.collect_list(p)).alias("p"))
        out = self.slots.join(whole.hint("merge"), ["source_no", "block"])
        words = F.array_join("p.text", " ")
        return out.select(
            "shard", "j", "source", "block", "pass", "n_words", F.transform(F.filter("p", lambda x: x["off"] < F.col("n_words")), lambda x: x["doc_id"]).alias("doc_ids"),
            F.when(F.col("partial"), F.array_join(F.slice(F.split(words, " "), 1, F.col("n_words").cast("int")), " ")).otherwise(words).alias("text"))


def op2_mixing(spark, sf_dir):
    return Mix(table(spark, sf_dir, "documents")).taken().drop("source")
