"""Substring dedup by sliding sentence spans.

A text is cut into sentences: after . ! ? and their full-width forms, and at line ends. From every
sentence on, and up to every sentence, the shortest run of at least `RUN` sentences and at least
`least_words` words is hashed (all of a shorter text); so each sentence of a repeated passage
of that size is in a run that lies within the passage. With least_words = 0 these are simply all runs
of RUN sentences. Runs meet over all documents; of equal runs the first, by doc_id and place, stays,
and sentences that any other covers are removed.

So that a passage within long sentences is found as well, a sentence of over `long` words is also cut
into pieces, after words whose hash is the least of the seven around them: cuts follow the content
and not the place, and a passage is cut alike wherever it stands. (There equal words in a row count
as one, three or more end with a cut, and where words come again within three they are cut every
eight words.) From every piece on, and up to every piece, the shortest run of at least three pieces
or sentences and at least `LEAST_WORDS` words is hashed besides, and pieces that it covers are removed
in the same way.

In scripts without spaces every character is cut off like a word; two of Chinese or Japanese, and
four of Thai, Lao, Khmer or Burmese, count as a word, a piece as one word at least.

Runs are rows with a 128-bit hash. A task puts out the first of equal runs of its texts alone, and
the rest as repeats already, so that a frequent run weighs a row a chunk of text in the exchange,
and runs whose hash no other chunk has stay out of it. A document is known by its id and a hash of its
text; what is to be removed goes back to it in one join.

Defined cases: a null text has no sentences and stays null; doc_id is an integer (what doesn't
cast to long counts as null); null ids come after all ids; of rows with equal ids the one with the smaller hash of
its text is first; repeated rows lose all they share with the first; of equal sentences in a row
that make a repeated run the first stays; an empty table gives no rows; case and white space don't
tell sentences apart; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import chunks, cut, table
from ._fields import among, bit_field
from ._keys import mixed

RUN, LEAST_WORDS, LONG, AROUND, STEP, MOST = 3, 12, 16, 3, 8, 32
BREAK = re.compile(r"(?<=[.!?])[^\S\n]+|[。！？｡．]+[」』”’）】》]*[^\S\n]*|\s*\n\s*")
TOKEN = re.compile(r"\S+\s*")
#: Letters written without spaces: about two of PAIRED a word, about four of FOURS.
PAIRED, FOURS = "\u3005-\u3007\u3040-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff", "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff"
UNSPACED = re.compile(f"[{PAIRED}{FOURS}]")
#: Such a letter with the full-width marks after it, or what stands between white space and such letters.
UNIT = re.compile(f"([{PAIRED}])[\u3001-\u3004\u3008-\u303f\uff01-\uff0f\uff1a-\uff20\uff3b-\uff40\uff5b-\uff65]*\\s*|([{FOURS}])\\s*|[^\\s{PAIRED}{FOURS}]+\\s*")
LAST = np.iinfo(np.int64).max


def picked(words: list[str]) -> list[int]:
    """Places of the words after which a long sentence is cut: the least hash of AROUND words on either side, of equal ones the first; equal words in a row count as one there, and three or more end with a cut.

    Stretches of words that are each among the AROUND before are cut at their ends and every STEP words from their begin, and pieces of over MOST words every MOST.
    """
    h = [zlib.crc32(w.encode()) for w in words]
    n = len(h)
    last = [i for i in range(n - 1) if h[i] != h[i + 1]] + [n - 1]  # of each run of equal words
    v = [h[i] for i in last]
    at = set()
    for j in range(3, len(v) - 3):  # what stands beyond the sentence's ends has no say
        x = v[j]
        if x < v[j - 1] and x < v[j - 2] and x < v[j - 3] and x <= v[j + 1] and x <= v[j + 2] and x <= v[j + 3]:
            at.add(last[j])
    if len(v) < n:
        at.update(i for before, i in zip([-1, *last], last) if i - before >= 3)
    if len(set(h)) <= n - STEP:
        begin = None
        for t in range(n + 1):
            again = t < n and h[t] in h[max(0, t - AROUND) : t]
            if again and begin is None:
                begin = t
            elif not again and begin is not None:
                if t - begin >= STEP:
                    at.update(range(begin - 1, t - 1, STEP))
                    at.add(t - 1)
                begin = None
    out = []
    for i in [*sorted(i for i in at if i < n - 1), n - 1]:
        out += [*range((out[-1] if out else -1) + MOST, i, MOST), i]
    return out[:-1]


def sentences(text: str, long: int | None = LONG) -> tuple[list[int], list[bytes], list[int], list[bool]]:
    """Ends of the pieces, which together are the whole text; their words in lower case; their numbers of words; whether a sentence ends there. long: sentences of more words are cut; None: none are."""
    long = len(text) if long is None else long
    ends, keys, sizes, last = [], [], [], []
    unspaced = not text.isascii() and UNSPACED.search(text) is not None

    def add(end: int, words: list[str], size: int | None = None) -> None:
        if words:
            ends.append(end)
            keys.append(" ".join(words).encode())
            sizes.append(len(words) if size is None else size)
            last.append(False)
        elif ends:
            ends[-1] = end

    at = 0
    for stop in [*(m.end() for m in BREAK.finditer(text)), len(text)]:
        if unspaced and UNSPACED.search(text, at, stop):
            found = list(UNIT.finditer(text, at, stop))
            words = [m[0].strip().lower() for m in found]
            quarters = [4 if m.lastindex is None else 2 if m.lastindex == 1 else 1 for m in found]
            begin = 0
            for i in [*(picked(words) if sum(quarters) > 4 * long else []), len(words) - 1]:
                add(found[i].end() if i < len(words) - 1 else stop, words[begin : i + 1], max(1, (sum(quarters[begin : i + 1]) + 2) // 4))
                begin = i + 1
            last[-1:] = [True] * bool(last)
            at = stop
            continue
        words = text[at:stop].lower().split()
        if len(words) > long:
            places = [m.end() for m in TOKEN.finditer(text, at, stop)]
            begin = 0
            for i in picked(words):
                add(places[i], words[begin : i + 1])
                begin = i + 1
            add(stop, words[begin:])
        else:
            add(stop, words)
        last[-1:] = [True] * bool(last)
        at = stop
    if ends:
        ends[-1] = len(text)
    return ends, keys, sizes, last


def runs(size: np.ndarray, last: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends, in pieces, of all runs of one text: from each sentence on and up to each, the shortest run of RUN sentences (all, of a shorter text) and `least` words; from each piece on the shortest run of RUN pieces and LEAST_WORDS words, if a piece of a sentence is in it."""
    n = len(size)
    total = np.concatenate([[0], np.cumsum(size)])
    stops = np.concatenate([[0], np.flatnonzero(last) + 1])  # where sentences begin and end
    whole, k = total[stops], len(stops) - 1
    i, few = np.arange(k), min(RUN, k)
    end = np.maximum(i + few, np.searchsorted(whole, whole[:-1] + least))
    begin = np.minimum(i + 1 - few, np.searchsorted(whole, whole[1:] - least, side="right") - 1)
    on = end <= k
    # Up to a sentence, only what is not also a run from a sentence on.
    up = (begin >= 0) & (end[np.maximum(begin, 0)] != i + 1)
    x, y = stops[np.concatenate([i[on], begin[up]])], stops[np.concatenate([end[on], i[up] + 1])]
    if n > k:
        upto = np.maximum(np.arange(n) + min(n, RUN), np.searchsorted(total, total[:-1] + LEAST_WORDS))
        parts = np.concatenate([[0], np.cumsum(~(last & np.concatenate([[True], last[:-1]])))])
        some = np.flatnonzero(upto <= n)
        some = some[parts[upto[some]] > parts[some]]
        x, y = np.concatenate([x, some]), np.concatenate([y, upto[some]])
    return x, y


ROW = "doc_id long, mark long, n int, ends array<int>, sizes array<int>, first int, pieces int, k1 long, k2 long"
_KINDS = {"long": pa.int64(), "int": pa.int32(), "array<int>": pa.list_(pa.int32())}
_NAMES, _TYPES = zip(*((x.split()[0], _KINDS[x.split()[1]]) for x in ROW.split(", ")))


def _runs(batches, least: int, long: int | None):
    """Task function: (doc_id, mark, text) to rows of ROW: one about each text (n: its sentences; ends and sizes of its pieces), and one for each run (its first piece, number of pieces, and hash, which is null where an earlier text or place of the chunk has the same run)."""
    from xxhash import xxh3_128_digest

    for b in chunks(batches):
        texts = b.column("text").to_pylist()
        number = np.array([LAST if i is None else i for i in b.column("doc_id").to_pylist()], dtype=np.int64)
        mark = b.column("mark").to_numpy()
        words, begins, lengths, counts, whole, firsts, done = [], [], [], [], [], [], 0
        for t in texts:
            e, k, s, last = sentences(t, long) if t else ([], [], [], [])
            whole.append((sum(last), e, s))
            counts.append(0)
            if e:
                x, y = runs(np.array(s), np.array(last), min(least, sum(s)))
                begins.append(x + done)
                lengths.append(y - x)
                counts[-1] = len(x)
            words += k
            firsts.append(done)
            done += len(k)
        nothing = lambda n, at: [pa.nulls(n, t) for t in _TYPES[at]]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("mark"), *[pa.array(x, t) for x, t in zip(zip(*whole), _TYPES[2:5])], *nothing(len(texts), slice(5, None))], _NAMES)
        if not begins:
            continue
        h = np.frombuffer(b"".join(map(xxh3_128_digest, words)), dtype=np.uint64).reshape(-1, 2)
        begin, length, doc = np.concatenate(begins), np.concatenate(lengths), np.repeat(np.arange(len(texts)), counts)
        key = np.zeros((len(begin), 2), dtype=np.uint64)
        for j in range(int(length.max())):
            has = np.flatnonzero(length > j) if j else slice(None)
            key[has] = mixed(key[has], h[begin[has] + j])
        first = begin - np.array(firsts)[doc]
        o = np.lexsort((length, first, mark[doc], number[doc], key[:, 1], key[:, 0]))
        k, place = key[o], np.stack([number[doc], mark[doc], first, length], axis=1)[o]
        fresh = np.concatenate([[True], (k[1:] != k[:-1]).any(axis=1)])
        at = np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
        again = np.zeros(len(o), dtype=bool)
        again[o] = (place != place[at]).any(axis=1)  # rows with equal ids and texts are one document here
        of = pa.array(doc)
        yield pa.RecordBatch.from_arrays([b.column("doc_id").take(of), b.column("mark").take(of), *nothing(len(o), slice(2, 5)), pa.array(first, pa.int32()), pa.array(length, pa.int32()), *[pa.array(key[:, j].view(np.int64), mask=again) for j in (0, 1)]], _NAMES)


def _without(batches):
    """Task function: a document with its pieces and its runs to be removed to what stays of it; of a repeated row (`copied`) nothing stays, as the runs cover all sentences."""
    for b in batches:
        gone, words, texts, changed = [], [], [], []
        text = b.column("text")
        for i, (ends, sizes, r, copied) in enumerate(zip(*(b.column(c).to_pylist() for c in ("ends", "sizes", "r", "copied")))):
            drop = np.zeros(len(ends or []) + 1, dtype=np.int64)
            for x in r or []:
                drop[x["first"]] += 1
                drop[x["first"] + x["pieces"]] -= 1
            drop = np.full(len(drop) - 1, True) if copied else np.cumsum(drop)[:-1] > 0
            gone.append(int(drop.sum()))
            words.append(int(np.array(sizes or [], dtype=np.int64)[drop].sum()))
            changed.append(gone[-1] > 0)
            if changed[-1]:
                t, at = text[i].as_py(), [0, *ends]
                texts.append("".join(t[at[j] : at[j + 1]] for j in np.flatnonzero(~drop)))
        text = pc.replace_with_mask(text, pa.array(changed, pa.bool_()), pa.array(texts, text.type))
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n"), pa.array(gone, pa.int64()), pa.array(words, pa.int64()), text], ["doc_id", "n_sentences", "n_removed", "words_removed", "text"])


def remove_repeats(docs: DataFrame, least_words: int = LEAST_WORDS, long: int | None = LONG) -> DataFrame:
    """A row a document: doc_id, n_sentences, n_removed (pieces of the text, mostly sentences), words_removed and the text that stays. least_words: shorter runs of sentences are lengthened to so many words; with 0 every run of RUN sentences counts. long: sentences of more words are cut into pieces too; None: none are."""
    d = docs.select(F.col("doc_id").try_cast("long").alias("doc_id"), F.xxhash64("text").alias("mark"), "text")
    found = cut(d.mapInArrow(partial(_runs, least=least_words, long=long), ROW))
    # A run whose hash stands in one chunk alone is no repeat: a bit field keeps most of these out of the exchange of whole rows.
    twice = cut(found.where("k1 is not null").groupBy("k1").agg(F.count("*").alias("c")).where("c > 1").select("k1"))
    field = docs.sparkSession.sparkContext.broadcast(bit_field(twice, "k1"))
    run = found.select("doc_id", "mark", "first", "pieces", "k1", "k2").where("first is not null")
    met = run.where("k1 is not null").mapInArrow(lambda it: (b.filter(pa.array(among(field.value, b.column("k1").to_numpy()))) for b in it), run.schema)
    # Rows of one document are ties, and a copy's rows with the same places rank first as well.
    place = Window.partitionBy("k1", "k2").orderBy(F.col("doc_id").asc_nulls_last(), "mark", "first", "pieces")
    again = met.withColumn("rank", F.rank().over(place)).where("rank > 1").drop("rank").unionByName(run.where("k1 is null"))
    by = ["_id", "_none", "mark"]
    named = lambda df: df.withColumns({"_id": F.coalesce("doc_id", F.lit(0)), "_none": F.col("doc_id").isNull()})
    gone = named(again).groupBy(*by).agg(F.collect_list(F.struct("first", "pieces")).alias("r"))
    about = named(found.where("n is not null")).select(*by, "n", "ends", "sizes").dropDuplicates(by).join(gone.hint("merge"), by, "left")
    whole = named(d).join(about.hint("merge"), by).withColumn("copy", F.row_number().over(Window.partitionBy(*by).orderBy("mark")))
    whole = whole.withColumn("copied", (F.col("copy") > 1) & (F.size("sizes") > 0))
    touched = F.col("r").isNotNull() | F.col("copied")
    whole = whole.select("doc_id", "text", F.col("n").cast("long").alias("n"), *[F.when(touched, F.col(c)).alias(c) for c in ("ends", "sizes")], "r", "copied")
    return whole.mapInArrow(_without, "doc_id long, n_sentences long, n_removed long, words_removed long, text string")


def op7_spans(spark, sf_dir):
    return remove_repeats(table(spark, sf_dir, "documents"))
