"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy.

A word's embedding is the sum of the embeddings of its hashed prefixes and of the whole word. Long
words, and words with letters of scripts without spaces, also come as pieces from each of their
characters on, after the text's words, so that the filters see every part of them.
Filters of several widths slide over the words, each keeps its largest value over the whole text
(max pooling), and a dense layer gives the score. Since a filter is linear in each of its words,
its terms are computed once a distinct word. All labelled rows are learned from, none is sampled.
Tasks turn them into packs of some thousand rows, as numbers and without texts. The counts that a model
starts from cover all packs; then, in rounds, each pack trains the model further by itself, and the mean
of what the packs changed is the next round's model. On the fifth of the rows that training leaves
out, scores are shifted so that 0.5 parts the labels best, and a decision threshold is set by language,
both by histograms of all of these rows. The language chooses a threshold only; it is no input of a score.

Defined cases: a null or empty text pools to zero and gets the score that goes with it; labels
with null id or value are left out; of repeated labels the highest counts; without labels of both
kinds every score is the share of ones (0.5 without labels); repeated rows keep a row each; an
empty table gives no rows; columns beyond doc_id, text and lang are ignored.
"""

from __future__ import annotations

import re
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import bytes_of, chunks, crc_mod, cut, table
from ._fields import among, bit_field
from ._keys import hashes, vocabulary
from .decontaminate import words

#: Rows and bytes of a pack, whole texts whatever their size.
PACK, PACK_BYTES = 4096, 32 << 20
#: Results of tasks that are added up in one place.
FAN = 8
#: Bins of a histogram of scores, by unit of log odds.
FINE = 64
BUCKETS, DIM, FILTERS, WIDTHS, PREFIXES = 1 << 16, 8, 8, (1, 2, 3), (3, 4, 5, 6, 8)
#: Words of more bytes come in pieces as well, of so many bytes: three letters of most scripts without spaces.
BYTES, PIECE = 16, 9
#: Letters of scripts without spaces, in UTF-8: Chinese, Japanese; Thai, Lao; Burmese, Khmer.
UNSPACED = re.compile(rb"[\xe3-\xe9]|\xef[\xa4-\xab\xbd\xbe]|\xf0[\xa0-\xbf]|\xe0[\xb8-\xbb]|\xe1[\x80-\x82\x9e\x9f]")


def tokens(text: bytes) -> list[bytes]:
    """The words, then the pieces of each word that is long or unspaced, after empty words that keep the filters from reaching over."""
    out = words(text)
    mixed = not text.isascii() and UNSPACED.search(text) is not None
    for w in [w for w in out if len(w) > BYTES or mixed and UNSPACED.search(w)]:
        out += [b""] * (max(WIDTHS) - 1)
        out += [w[i : i + PIECE] for i, c in enumerate(w) if c & 0xC0 != 0x80]
    return out


def buckets(distinct: list[bytes]) -> np.ndarray:
    """By word: the bucket of each prefix and of the whole; 0 where the word is shorter or empty."""
    if not distinct:
        return np.zeros((0, len(PREFIXES) + 1), dtype=np.int64)
    n = np.fromiter(map(len, distinct), dtype=np.int64, count=len(distinct))
    top = max(PREFIXES)
    m = np.frombuffer(b"".join(w[:top].ljust(top, b"\0") for w in distinct), dtype=np.uint8).reshape(-1, top).astype(np.uint64)
    h = np.full(len(n), 1469598103934665603, dtype=np.uint64)
    out = []

    def fold(x, k):
        x = (x ^ np.uint64(k)) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(32)
        return (x % np.uint64(BUCKETS - 1) + np.uint64(1)).astype(np.int64)

    for k in range(top):
        h = np.where(k < n, (h ^ m[:, k]) * np.uint64(1099511628211), h)
        if k + 1 in PREFIXES:
            out.append(np.where(n >= k + 1, fold(h, k + 1), 0))
    return np.stack([*out, np.where(n > 0, fold(hashes(distinct), 99), 0)], axis=1)


def laid_out(lists: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """All texts' words as numbers one after another, each followed by gaps of the widest filter; begins, ends, distinct words (a gap's number is their count)."""
    seen: dict[bytes, int] = {}
    add, gap = seen.setdefault, [-1] * (max(WIDTHS) - 1)
    flat: list[int] = []
    begins, ends = [], []
    for ws in lists:
        begins.append(len(flat))
        flat.extend([add(w, len(seen)) for w in ws])
        ends.append(len(flat))
        flat.extend(gap)
    a = np.array(flat, dtype=np.int32)
    a[a < 0] = len(seen)
    return a, np.array(begins, dtype=np.int64), np.array(ends, dtype=np.int64), list(seen)


def _features(field):
    """Task function: texts of ids in the field, as numbers: each token's place among the text's distinct tokens, and their buckets."""

    def run(batches):
        for b in batches:
            b = b.filter(pa.array(among(field.value, b.column("number").to_numpy())))
            for part in (b.slice(i, 1) for i in range(b.num_rows)):
                seq, distinct, _ = vocabulary([tokens(bytes_of(part.column("text"))[0])])
                rest = [part.column(c) for c in ("doc_id", "lang", "mark")]
                yield pa.RecordBatch.from_arrays([*rest, pa.array([seq.tobytes()], pa.binary()), pa.array([buckets(distinct).astype(np.uint16).tobytes()], pa.binary())], ["doc_id", "lang", "mark", "seq", "feats"])

    return run


PACKED = "rest boolean, y binary, langs array<string>, a binary, begins binary, ends binary, feats binary"


def _packs(rows: int):
    """Task function: labelled texts of `_features` in packs, those for training and the rest apart."""

    def made(rest: bool, held: list[dict]) -> pa.RecordBatch:
        a, begins, ends, feats = joined([SimpleNamespace(**r) for r in held])
        y = np.array([r["y"] for r in held], dtype=np.int8)
        raw = [pa.array([x.tobytes()], pa.binary()) for x in (y, a, begins, ends, feats.astype(np.uint16))]
        return pa.RecordBatch.from_arrays([pa.array([rest]), raw[0], pa.array([[r["lang"] or "" for r in held]], pa.list_(pa.string())), *raw[1:]], ["rest", "y", "langs", "a", "begins", "ends", "feats"])

    def run(batches):
        held, size = {False: [], True: []}, {False: 0, True: 0}
        for b in batches:
            for r in (b.slice(i, 1).to_pylist()[0] for i in range(b.num_rows)):
                k, n = r["rest"], len(r["seq"]) + len(r["feats"])
                if held[k] and (len(held[k]) >= rows or size[k] + n > PACK_BYTES):
                    yield made(k, held[k])
                    held[k], size[k] = [], 0
                held[k].append(r)
                size[k] += n
        for k in (False, True):
            if held[k]:
                yield made(k, held[k])

    return run


def _unpacked(b: pa.RecordBatch, i: int) -> tuple[tuple, np.ndarray, list[str]]:
    """What `joined` gives, labels and languages of a pack."""
    r = b.slice(i, 1).to_pylist()[0]
    a, begins, ends = np.frombuffer(r["a"], dtype=np.int32), *(np.frombuffer(r[c], dtype=np.int64) for c in ("begins", "ends"))
    return (a, begins, ends, np.frombuffer(r["feats"], dtype=np.uint16).reshape(-1, len(PREFIXES) + 1).astype(np.int64)), np.frombuffer(r["y"], dtype=np.int8).astype(np.int64), r["langs"]


def summed(packs: DataFrame, of) -> np.ndarray | None:
    """The sum of the vectors of(texts, y, langs) of all packs: by task, by groups of FAN tasks and of groups, the last FAN by the driver; None without packs."""

    def task(batches):
        total = None
        for b in batches:
            for i in range(b.num_rows):
                one = of(*_unpacked(b, i))
                total = one if total is None else total + one
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["task", "sums"])

    def merge(key: tuple, t: pa.Table) -> pa.Table:
        t = t.sort_by("task")
        return pa.table({"task": pa.array([key[0].as_py()], pa.int32()), "sums": pa.array([sum(np.frombuffer(x.as_buffer()) for x in t.column("sums")).tobytes()], pa.binary())})

    groups, each = packs.rdd.getNumPartitions(), packs.mapInArrow(task, "task int, sums binary")
    while True:  # once at least, so that the driver never gets tasks' own results
        groups = max(1, -(-groups // FAN))
        each = each.groupBy(F.pmod("task", F.lit(groups))).applyInArrow(merge, "task int, sums binary")
        if groups <= FAN:
            break
    each = each.collect()
    return sum(np.frombuffer(r.sums) for r in sorted(each, key=lambda r: r.task)) if each else None


def joined(rows: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """What `laid_out` gives, of rows of `_features`, and the buckets of the distinct tokens."""
    gap, width = max(WIDTHS) - 1, len(PREFIXES) + 1
    each = [np.frombuffer(r.feats, dtype=np.uint16).reshape(-1, width) for r in rows]
    feats, which = np.unique(np.concatenate([*each, np.zeros((0, width), np.uint16)]), axis=0, return_inverse=True)
    flat, begins, ends, at, done = [], [], [], 0, 0
    for r, f in zip(rows, each):
        seq = which[done : done + len(f)][np.frombuffer(r.seq, dtype=np.int32)].astype(np.int32)
        flat += [seq, np.full(gap, len(feats), dtype=np.int32)]
        begins.append(at)
        ends.append(at + len(seq))
        at, done = ends[-1] + gap, done + len(f)
    return np.concatenate([*flat, np.zeros(0, np.int32)]), np.array(begins, dtype=np.int64), np.array(ends, dtype=np.int64), feats.astype(np.int64)


def embed(model: dict, feats: np.ndarray) -> np.ndarray:
    """Words x DIM, with a last row of zeros for gaps."""
    e = model["E"][np.where(model["on"][feats], feats, 0)].sum(axis=1)
    return np.vstack([e, np.zeros((1, DIM), dtype=np.float32)])


def pooled(model: dict, p: np.ndarray, a: np.ndarray, begins: np.ndarray, ends: np.ndarray, where: bool = False):
    """Texts x (widths * FILTERS): largest filter values above zero; where: also their positions."""
    full = np.flatnonzero(ends > begins)
    out = np.zeros((len(begins), len(WIDTHS) * FILTERS), dtype=np.float32)
    at = np.zeros(out.shape, dtype=np.int64)
    if not len(full):
        return (out, at) if where else out
    cuts = np.stack([begins[full], ends[full]], axis=1).ravel()
    text = np.repeat(np.arange(len(full)), (ends - begins)[full]) if where else None
    inside = np.concatenate([np.arange(x, y) for x, y in zip(begins[full], ends[full])]) if where else None
    for k, w in enumerate(WIDTHS):
        q = np.ascontiguousarray(np.einsum("ud,odf->ofu", p, model["W"][k]))
        for f in range(FILTERS):
            v = q[0, f][a]
            for o in range(1, w):
                v[:-o] += q[o, f][a[o:]]
            m = np.maximum.reduceat(v, cuts)[::2]
            col = k * FILTERS + f
            out[full, col] = np.maximum(m + model["b"][col], 0)
            if where:
                tops = np.flatnonzero(v[inside] == m[text])
                _, first = np.unique(text[tops], return_index=True)
                at[full, col] = inside[tops[first]]
    return (out, at) if where else out


def forward(model: dict, pools: np.ndarray) -> np.ndarray:
    # Row by row, as a matrix product rounds by the number of rows: equal texts score alike.
    return 1 / (1 + np.exp(-np.clip((pools.astype(np.float64) * model["v"]).sum(axis=1) + model["c"][0], -30, 30)))


def counted(texts: tuple, y: np.ndarray, langs: list[str] | None = None) -> np.ndarray:
    """By label, texts that hold each bucket; then texts by label."""
    a, begins, ends, feats = texts
    df = np.zeros((2, BUCKETS))
    for x, z, t in zip(begins, ends, y):
        df[t, np.unique(feats[np.unique(a[x:z])])] += 1
    return np.concatenate([df.ravel(), np.bincount(y, minlength=2)])


def start(counts: np.ndarray, seed: int = 5) -> dict:
    """The model that training begins with, by the counts of all texts. Buckets found in fewer than three texts stay off."""
    rng = np.random.default_rng(seed)
    df, n = counts[:-2].reshape(2, BUCKETS), counts[-2:]
    total = np.maximum(1, n)
    on = df.sum(axis=0) >= 3
    on[0] = False
    odds = np.log((df[1] + 1) / (total[1] + 2)) - np.log((df[0] + 1) / (total[0] + 2))
    e = rng.normal(0, 0.05, (BUCKETS, DIM)).astype(np.float32)
    e[:, 0] = np.where(on, np.clip(odds, -2, 4), 0) * 0.2  # a start from how much more often toxic texts hold the bucket
    e[0] = 0
    model = {"E": e, "on": on, "W": [rng.normal(0, 0.3, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS], "b": np.zeros(len(WIDTHS) * FILTERS, dtype=np.float32), "v": rng.normal(0, 0.3, len(WIDTHS) * FILTERS).astype(np.float32), "c": np.array([np.log(total[1] / total[0])], dtype=np.float32)}
    for k in range(len(WIDTHS)):
        model["W"][k][:, 0, 0], model["v"][k * FILTERS] = 1.0, 1.0
    return model


def batches_of(order: np.ndarray, lens: np.ndarray, batch: int, words: int = 1 << 20):
    """Cuts of the order with `batch` texts and `words` words at most; a longer text stands alone."""
    first = held = 0
    for i, m in enumerate(order):
        if i > first and (i - first == batch or held + lens[m] > words):
            yield order[first:i]
            first, held = i, 0
        held += lens[m]
    if first < len(order):
        yield order[first:]


def params_of(model: dict) -> list[np.ndarray]:
    return [model["E"], *model["W"], model["b"], model["v"], model["c"]]


def train(model: dict, texts: tuple, y: np.ndarray, epochs: int = 10, rate: float = 0.01, seed: int = 5) -> dict:
    """Trains the model further by Adam on log loss over texts as `joined` gives them, in three batches an epoch at least."""
    rng = np.random.default_rng(seed)
    a, begins, ends, feats = texts
    feats = np.vstack([feats, np.zeros((1, len(PREFIXES) + 1), dtype=np.int64)])
    model = {"E": model["E"].copy(), "on": model["on"], "W": [x.copy() for x in model["W"]], **{k: model[k].copy() for k in "bvc"}}
    params, batch = params_of(model), min(256, max(8, -(-len(y) // 3)))
    first, second, step = [np.zeros_like(x) for x in params], [np.zeros_like(x) for x in params], 0
    for _ in range(epochs):
        for mine in batches_of(rng.permutation(len(begins)), ends - begins, batch):
            lens = ends[mine] - begins[mine] + max(WIDTHS) - 1
            where = np.concatenate([np.arange(begins[m], begins[m] + n) for m, n in zip(mine, lens)])
            u, local = np.unique(a[where], return_inverse=True)
            b0 = np.cumsum(lens) - lens
            fe = feats[u]
            fe = np.where(model["on"][fe], fe, 0)
            p = model["E"][fe].sum(axis=1)
            pool, at = pooled(model, p, local, b0, b0 + lens - (max(WIDTHS) - 1), where=True)
            err = ((forward(model, pool) - y[mine]) / len(mine)).astype(np.float32)
            dv, dc = pool.T @ err, np.array([err.sum()], dtype=np.float32)
            dpool = np.where(pool > 0, err[:, None] * model["v"], 0).astype(np.float32)
            dp, dw = np.zeros_like(p), [np.zeros_like(x) for x in model["W"]]
            for k, w in enumerate(WIDTHS):
                for o in range(w):
                    d = dpool[:, k * FILTERS : (k + 1) * FILTERS]
                    word = local[np.minimum(at[:, k * FILTERS : (k + 1) * FILTERS] + o, len(local) - 1)]
                    dw[k][o] = np.einsum("nf,nfd->df", d, p[word])
                    np.add.at(dp, word.ravel(), (d[:, :, None] * model["W"][k][o].T[None]).reshape(-1, DIM))
            de = np.zeros_like(model["E"])
            some = np.flatnonzero(np.abs(dp).sum(axis=1))
            np.add.at(de, fe[some].ravel(), np.repeat(dp[some], fe.shape[1], axis=0))
            de[0] = 0
            step += 1
            for x, g, m1, m2 in zip(params, [de, *dw, dpool.sum(axis=0), dv, dc], first, second):
                m1 += 0.1 * (g - m1)
                m2 += 0.01 * (g * g - m2)
                x -= rate * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-7) + (1e-4 * rate * x if x.ndim > 1 else 0)
    return model


def cutoff(bins: pa.Table) -> float:
    """The threshold with the best F1, of bins of scores with their counts (n), ones, lowest and highest score; 0.5 with fewer than ten rows of either label."""
    n, ones, low, high = (bins.column(c).to_numpy() for c in ("n", "ones", "low", "high"))
    if min(ones.sum(), (n - ones).sum()) < 10:
        return 0.5
    o = np.argsort(-low, kind="stable")
    f1 = 2 * np.cumsum(ones[o]) / (np.cumsum(n[o]) + ones.sum())
    k = int(f1.argmax())
    return float((low[o[k]] + (high[o[k + 1]] if k + 1 < len(o) else 0)) / 2)


def logit(p: float) -> float:
    return float(np.log(p / (1 - p)))


def _binned(model):
    """Task function: (lang, bin, score, y) of the texts of packs."""

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                texts, y, langs = _unpacked(b, i)
                p = predicted(model.value, *texts)
                yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(np.floor(np.log(p / (1 - p)) * FINE).astype(np.int32)), pa.array(p), pa.array(y)], ["lang", "bin", "score", "y"])

    return run


def fit(docs: DataFrame, labels: DataFrame, pack: int = PACK) -> tuple[dict, dict[str, float]]:
    """(model, threshold by language, where a language has ten rows of either label).

    Learns from all labelled rows whose crc32 of the id is not 0 modulo 5; of rows with equal ids one, by the hash of its text.
    """
    spark = docs.sparkSession
    key = F.xxhash64(F.col("doc_id").cast("string"))
    marks = labels.where("doc_id is not null and toxic is not null").where(crc_mod(F.col("doc_id")) != 0).groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("y"))
    # The field keeps unlabelled texts out of the exchange; the join is exact.
    field = spark.sparkContext.broadcast(bit_field(marks.select(key.alias("number")), "number"))
    texts = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), "text", F.xxhash64("text").alias("mark"), key.alias("number")).where("doc_id is not null")
    found = texts.mapInArrow(_features(field), f"doc_id {dict(docs.dtypes)['doc_id']}, lang string, mark long, seq binary, feats binary")
    parts = max(1, -(-marks.count() // pack))
    one = Window.partitionBy("doc_id").orderBy("mark", "lang")
    rows = found.repartition(parts, "doc_id").join(marks.repartition(parts, "doc_id").hint("merge"), "doc_id").withColumn("_no", F.row_number().over(one)).where("_no = 1")
    rows = rows.withColumn("rest", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(5)) == 4).sortWithinPartitions("doc_id").select("rest", "y", "lang", "seq", "feats")
    packs = cut(rows.mapInArrow(_packs(pack), PACKED))

    # (training's, the rest's) sums: counts of buckets and labels.
    mine, rest = packs.where("not rest"), packs.where("rest")
    counts, left = summed(mine, counted), summed(rest, counted)
    n, n_left = (np.zeros(2) if x is None else x[-2:] for x in (counts, left))
    if (n + n_left).min() > 0 and n.min() == 0:  # hardly a row of a label: training takes all
        mine, counts, n = packs, left if counts is None else counts + left, n + n_left
    if n.min() == 0:
        share = float(n[1] + n_left[1]) / float((n + n_left).sum()) if (n + n_left).sum() else 0.5
        flat = {"E": np.zeros((BUCKETS, DIM), np.float32), "on": np.zeros(BUCKETS, bool), "W": [np.zeros((w, DIM, FILTERS), np.float32) for w in WIDTHS], "b": np.zeros(len(WIDTHS) * FILTERS, np.float32), "v": np.zeros(len(WIDTHS) * FILTERS, np.float32), "c": np.array([np.log((share + 1e-3) / (1 - share + 1e-3))], np.float32)}
        return flat, {}
    model = start(counts)
    # One pack trains to the end at once. Of many packs every round goes through all rows, once if they are many.
    rounds, epochs = (1, 10) if n.sum() <= pack and mine.count() == 1 else (5, 2 if n.sum() <= 8 * pack else 1)
    for k in range(rounds):
        model = averaged(mine, model, epochs, 0.01 * 0.7**k, 5 + k)
    # The scores of texts that training has not seen are lower: 0.5 becomes what parts these best.
    held = spark.sparkContext.broadcast(model)
    bins = rest.mapInArrow(_binned(held), "lang string, bin int, score double, y long").groupBy("lang", "bin").agg(F.count("*").alias("n"), F.sum("y").alias("ones"), F.min("score").alias("low"), F.max("score").alias("high"))
    bins = cut(bins)
    every = bins.groupBy("bin").agg(F.sum("n").alias("n"), F.sum("ones").alias("ones"), F.min("low").alias("low"), F.max("high").alias("high")).toArrow()
    shift = logit(min(max(cutoff(every), 0.01), 0.99))
    model["c"] = (model["c"] - shift).astype(np.float32)
    enough = bins.groupBy("lang").agg(F.sum("ones").alias("a"), F.sum("n").alias("b")).where("a >= 10 and b - a >= 10").select("lang")
    by_lang = bins.join(enough, "lang").groupBy("lang").applyInArrow(lambda t: pa.table({"lang": t.column("lang").slice(0, 1), "least": [cutoff(t)]}), "lang string, least double")
    return model, {r.lang: float(1 / (1 + np.exp(shift - logit(r.least)))) for r in by_lang.orderBy("lang").collect()}


def averaged(packs: DataFrame, model: dict, epochs: int, rate: float, seed: int) -> dict:
    """A round: the model with the mean of what training on each pack alone changes, by the packs' rows; of a bucket, over the packs that hold it."""
    held = packs.sparkSession.sparkContext.broadcast(model)

    def change(texts, y, langs):
        old = held.value
        new = train(old, texts, y, epochs, rate, seed)
        has = np.zeros(BUCKETS)
        has[np.unique(texts[3])] = len(y)
        moved = [b.astype(np.float64) - a for a, b in zip(params_of(old), params_of(new))]
        return np.concatenate([has, (moved[0] * has[:, None]).ravel(), *(len(y) * x.ravel() for x in moved[1:]), [len(y)]])

    total = summed(packs, change)
    has, at, out = np.maximum(total[:BUCKETS], 1), BUCKETS, []
    for k, x in enumerate(params_of(model)):
        by = has[:, None] if k == 0 else total[-1]
        out.append((x + total[at : at + x.size].reshape(x.shape) / by).astype(np.float32))
        at += x.size
    held.unpersist()
    return {"E": out[0], "on": model["on"], "W": out[1:-3], "b": out[-3], "v": out[-2], "c": out[-1]}


def predicted(model: dict, a: np.ndarray, begins: np.ndarray, ends: np.ndarray, feats: np.ndarray) -> np.ndarray:
    return forward(model, pooled(model, embed(model, feats), a, begins, ends))


def predict(model: dict, lists: list[list[bytes]]) -> np.ndarray:
    a, begins, ends, distinct = laid_out(lists)
    return predicted(model, a, begins, ends, buckets(distinct))


def score(docs: DataFrame, model: dict, kept: tuple[str, ...] = ("doc_id", "lang")) -> DataFrame:
    """The columns `kept` of docs, and score."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size: BUCKETS x DIM and the filters

    def run(batches):
        for b in chunks(batches):
            p = predict(held.value, [tokens(t) for t in bytes_of(b.column("text"))])
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(p, pa.float64())], names=[*kept, "score"])

    kinds = dict(docs.dtypes)
    return docs.select(*kept, "text").mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in kept), "score double"]))


def op10_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    model, by_lang = fit(docs, table(spark, sf_dir, "labels"))
    least = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in by_lang.items() for x in kv]), F.coalesce("lang", F.lit(""))), F.lit(0.5)) if by_lang else F.lit(0.5)
    return score(docs, model).select(
        "doc_id", (crc_mod(F.col("doc_id")) == 0).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"),
        least.alias("lang_threshold"), F.when(F.col("score") >= least, 1).otherwise(0).alias("flagged"))
