"""LM scoring by deleted interpolation.

A word's probability after a context is a mixture of maximum-likelihood estimates, of the pair, of
the word, and of the uniform distribution over the vocabulary and one unknown word:
    p(w | u) = l2 c(u w) / c(u) + l1 c(w) / N + l0 / (V + 1).
The weights depend on the bucket (power of two) of the context's count. They are learned by
expectation-maximisation on training documents held out for that purpose: one in `TUNE`, whose
pairs are looked up in counts without them. Scores use counts of all training documents.

Documents are tokenised once, into batches of about `BATCH` bytes of text and of one role each
(training, held out of it for the mixture, not in training), which are written as a table. Each
distinct word and pair of a batch goes, with its count there, to the part of the key space that it
falls into, so that a frequent one weighs no more than an entry a batch. The number of parts grows
with the number of tokens: a part has about `PART` entries, whatever the size of the corpus, and a
row holds the entries of one batch and part, so rows are never more than entries. Counts go back to
the batches in the order in which the keys came. The mixture's input is a histogram over (bucket,
quantised estimates), whose size has a bound that does not depend on the data.

Defined cases: a null text is empty and is one end token; doc_id is an integer (other types are
cast to long, and rows where that fails count as rows without an id); a null id counts as empty
text for the choice of training documents and for what is held out; repeated rows are documents of
their own; without training documents all counts are zero and the uniform estimate decides; an
empty table gives no rows; other columns are ignored. A document is one batch at most, so it has
to fit into a task.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import bytes_of, chunks, crc_mod, cut, table
from ._keys import hashes, mixed, vocabulary
from ._packed import cuts, narrow, pack, packed_keys, unpack, unpacked_keys

#: Keys of the end token and of the context before the first word; words hash to other values but by chance.
END, START = np.uint64(0xE7D), np.uint64(0x57A27)
#: Training documents of which one is held out for the mixture.
TUNE = 10
#: Steps of the quantised estimates in an octave; their last level stands for zero.
STEPS, LEVELS = 4, 160
NONE, TRAIN, HELD = 0, 1, 2
#: Bytes of text in a batch, and entries (distinct words and pairs of a batch) in a part of the key space, about.
BATCH, PART = 8 << 20, 1 << 20
#: Rows of the exchange. kind: WORD or PAIR (counts of these keys), LESS + either (the same without the held-out part), OWN (what a batch keeps), DISTINCT (training words of a part, in n).
SCHEMA = "batch long, part int, role int, kind int, docs long, n long, data binary"
NAMES = [c.split()[0] for c in SCHEMA.split(", ")]
TYPES = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
WORD, PAIR, LESS, OWN, DISTINCT = 0, 1, 2, 9, 10


def roles(ids: list, mod: int, rest: int) -> np.ndarray:
    """By document: not in training, in training, or held out of training for the mixture."""
    crc = np.array([zlib.crc32(b"" if i is None else str(i).encode()) for i in ids], dtype=np.int64)
    return np.where(crc % mod == rest, NONE, np.where((crc // mod) % TUNE == 0, HELD, TRAIN))


def _rows(found: Iterator[tuple], limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The rows in record batches of about `limit` bytes."""
    held, size = [], 0
    make = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), TYPES)], NAMES)
    for r in found:
        held.append(r)
        size += len(r[-1] or b"") + 64
        if size >= limit:
            yield make()
            held, size = [], 0
    if held:
        yield make()


def _tokenised(role: int, ids: list, texts: list[bytes]) -> tuple[int, bytes]:
    """Tokens of a batch, and its own data: sorted keys of the distinct words, each token's place among them, tokens by document, ids."""
    seq, distinct, begins = vocabulary(t.lower().split() for t in texts)
    h = np.concatenate([hashes(distinct), [END]])
    order = np.argsort(h, kind="stable")
    rank = np.empty(len(h), dtype=np.int64)
    rank[order] = np.arange(len(h))
    # The end token stands after each document's words.
    seq = np.insert(rank[seq] if len(seq) else np.zeros(0, dtype=np.int64), begins[1:], rank[-1])
    none = np.array([i is None for i in ids])
    return len(seq), pack(*packed_keys(h[order]), narrow(seq), narrow(np.diff(begins) + 1), np.array([0 if i is None else i for i in ids], dtype=np.int64), none)


def _batches(mod: int, rest: int):
    def run(batches):
        first = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32
        held: dict[int, list] = {k: [[], [], 0] for k in (NONE, TRAIN, HELD)}

        def found():
            n = 0
            for b in chunks(batches):
                ids, texts = b.column("doc_id").to_pylist(), bytes_of(b.column("text"))
                for i, t, role in zip(ids, texts, roles(ids, mod, rest).tolist()):
                    h = held[role]
                    if h[2] and h[2] + len(t) > BATCH:
                        yield (first + n, -1, role, OWN, len(h[0]), *_tokenised(role, h[0], h[1]))
                        n, held[role] = n + 1, [[], [], 0]
                        h = held[role]
                    h[0].append(i)
                    h[1].append(t)
                    h[2] += len(t) + 1
            for role, h in held.items():
                if h[0]:
                    yield (first + n, -1, role, OWN, len(h[0]), *_tokenised(role, h[0], h[1]))
                    n += 1

        yield from _rows(found())

    return run


def _own(data: bytes):
    first, steps, seq, length, ids, none = unpack(data)
    return unpacked_keys(first, steps), seq.astype(np.int64), length.astype(np.int64), ids, none.astype(bool)


def pairs(keys: np.ndarray, seq: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys of the pairs (word before, word), and each token's pair as a number among them."""
    before = np.roll(seq, 1)
    before[np.cumsum(length) - length] = len(keys)
    both, inverse = np.unique(before * (len(keys) + 1) + seq, return_inverse=True)
    k = mixed(np.append(keys, START)[both // (len(keys) + 1)], keys[both % (len(keys) + 1)])
    order = np.argsort(k)
    rank = np.empty(len(k), dtype=np.int64)
    rank[order] = np.arange(len(k))
    return k[order], rank[inverse]


def _questions(parts: int):
    """Task function: a batch's distinct keys with their counts in it, by part of the key space; a batch that is not in training only asks."""

    def found(batches):
        for b in batches:
            for number, role, data in zip(*(b.column(c).to_pylist() for c in ("batch", "role", "data"))):
                keys, seq, length, _, _ = _own(data)
                for kind, (k, of) in ((WORD, (keys, seq)), (PAIR, pairs(keys, seq, length))):
                    n = [] if role == NONE else [narrow(np.bincount(of, minlength=len(k)))]
                    at = cuts(k, parts)
                    for part in np.flatnonzero(np.diff(at)).tolist():
                        s = slice(at[part], at[part + 1])
                        yield number, part, role, kind, 0, 0, pack(*packed_keys(k[s]), *[x[s] for x in n])

    return lambda batches: _rows(found(batches))


def _answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each row of one part: the counts of its keys in all of training; for held-out ones those without the held-out part as well."""
    asked = []
    for b in batches:
        asked += zip(*(b.column(c).to_pylist() for c in ("batch", "part", "role", "kind")), map(unpack, b.column("data").to_pylist()))

    def found():
        for kind in (WORD, PAIR):
            mine = [(batch, part, role, unpacked_keys(a[0], a[1]), a[2] if role != NONE else None) for batch, part, role, k, a in asked if k == kind]
            if not mine:
                continue
            every, which = np.unique(np.concatenate([m[3] for m in mine]), return_inverse=True)
            total, at = np.zeros((2, len(every)), dtype=np.int64), np.cumsum([0, *(len(m[3]) for m in mine)])
            for m, a, b in zip(mine, at[:-1], at[1:]):
                if m[2] != NONE:
                    total[int(m[2] == HELD), which[a:b]] += m[4]  # keys of a row are distinct
            for (batch, part, role, *_), a, b in zip(mine, at[:-1], at[1:]):
                yield batch, part, role, kind, 0, 0, pack(narrow(total[0, which[a:b]] + total[1, which[a:b]]))
                if role == HELD:
                    yield batch, part, role, LESS + kind, 0, 0, pack(narrow(total[0, which[a:b]]))
            if kind == WORD:
                yield -1, mine[0][1], NONE, DISTINCT, 0, int((total.sum(axis=0) > 0).sum()), None

    yield from _rows(found())


def _together(got: list[tuple], kinds: tuple[int, int]):
    """What comes back to a batch: its own arrays, and counts by word and by pair."""
    counts = [np.concatenate([unpack(d)[0].astype(np.int64) for _, _, d in sorted(r for r in got if r[0] == k)]) for k in kinds]
    return *_own(next(d for k, _, d in got if k == OWN)), *counts


def _bucket(c: np.ndarray) -> np.ndarray:
    return np.where(c > 0, np.log2(np.maximum(c, 1)).astype(np.int64) + 1, 0)


def _level(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """Quantised -log2(part / whole)."""
    with np.errstate(divide="ignore", invalid="ignore"):
        x = np.round(-STEPS * np.log2(part / np.maximum(whole, 1)))
    return np.where(part > 0, np.minimum(x, LEVELS - 1), LEVELS).astype(np.int64)


def _returned(rows: DataFrame, finish, schema: str) -> DataFrame:
    """finish(rows of one batch as (kind, part, data)) gives the batch's part of the result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("kind", "part", "data")))]
        yield from finish(got).to_batches()

    return rows.select("batch", "kind", "part", "data").groupBy("batch").applyInArrow(run, schema)


def _histogram(tokens: int, docs: int):
    """Of a held-out batch's tokens: rows (bucket and levels of the pair's and the word's estimates as one code, tokens). tokens, docs: of training without the held-out part."""

    def finish(got: list[tuple]) -> pa.Table:
        keys, seq, length, _, _, word, pair = _together(got, (LESS + WORD, LESS + PAIR))
        _, of = pairs(keys, seq, length)
        before = np.roll(word[seq], 1)
        before[np.cumsum(length) - length] = docs
        b, p, w = _bucket(before), _level(pair[of], before), _level(word[seq], np.full(len(seq), tokens))
        code, n = np.unique((b * (LEVELS + 1) + p) * (LEVELS + 1) + w, return_counts=True)
        return pa.table({"code": pa.array(code), "n": pa.array(n.astype(np.int64))})

    return finish


def mixture(code: np.ndarray, n: np.ndarray, vocabulary_size: int, rounds: int = 60) -> np.ndarray:
    """Weights (uniform, word, pair) by bucket: EM for all buckets together, then for each with ten tokens' worth of the common weights as a prior. Bucket 0 has no pair estimate."""
    b, p, w = code // (LEVELS + 1) ** 2, code // (LEVELS + 1) % (LEVELS + 1), code % (LEVELS + 1)
    value = lambda x: np.where(x < LEVELS, 2.0 ** (-x / STEPS), 0.0)
    e = np.stack([np.full(len(n), 1.0 / (vocabulary_size + 1)), value(w), value(p)], axis=1)

    def em(weights, rows, prior):
        for _ in range(rounds):
            share = e[rows] * weights
            share *= (n[rows] / share.sum(axis=1))[:, None]
            weights = (share.sum(axis=0) + prior) / (share.sum() + prior.sum())
        return weights

    start = np.array([0.1, 0.4, 0.5])
    common = em(start, slice(None), np.full(3, 1e-3)) if len(n) else start
    out = np.tile(common, (66, 1))
    for k in np.unique(b):
        out[k] = em(common, np.flatnonzero(b == k), 10 * common)
    out[0] = [out[0, 0], out[0, 1] + out[0, 2], 0] if not (b == 0).any() else out[0] / out[0, :2].sum() * [1, 1, 0]
    return out


def _scores(weights: np.ndarray, tokens: int, docs: int, distinct: int):
    def finish(got: list[tuple]) -> pa.Table:
        keys, seq, length, ids, none, word, pair = _together(got, (WORD, PAIR))
        _, of = pairs(keys, seq, length)
        begins = np.cumsum(length) - length
        c = word[seq]
        before = np.roll(c, 1)
        before[begins] = docs
        l0, l1, l2 = weights[_bucket(before)].T
        p = l2 * pair[of] / np.maximum(before, 1) + l1 * c / max(tokens, 1) + l0 / (distinct + 1)
        if not tokens:
            p = np.full(len(c), 1.0 / (distinct + 1))
        base = np.log10((c + 0.5) / (tokens + 0.5 * (distinct + 1)))
        add = lambda x: np.add.reduceat(x, begins)
        return pa.table({
            "doc_id": pa.array(ids, mask=none), "n_tokens": pa.array(length), "n_known": pa.array(add((c > 0).astype(np.int64))),
            "train_tokens": pa.array(np.full(len(ids), tokens, dtype=np.int64)), "base_score": pa.array(add(base)), "score": pa.array(add(np.log10(p)))})

    return finish


def score(docs: DataFrame, mod: int = 5, rest: int = 1) -> DataFrame:
    """A row a document of docs (doc_id, text); documents whose crc32 of the id leaves `rest` modulo `mod` take no part in training."""
    own = cut(docs.select(F.col("doc_id").try_cast("long").alias("doc_id"), "text").mapInArrow(_batches(mod, rest), SCHEMA))
    got = {r.role: (r.tokens, r.docs) for r in own.groupBy("role").agg(F.sum("n").alias("tokens"), F.sum("docs").alias("docs")).collect()}
    parts = 1 + sum(t for t, _ in got.values()) // PART
    asked = own.mapInArrow(_questions(parts), SCHEMA)
    answers = cut(asked.groupBy("part").applyInArrow(_answers, SCHEMA))
    distinct = answers.where(F.col("kind") == DISTINCT).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n
    train, held = got.get(TRAIN, (0, 0)), got.get(HELD, (0, 0))
    less = answers.where(F.col("kind").isin(LESS + WORD, LESS + PAIR)).unionByName(own.where(F.col("role") == HELD))
    # Its rows number codes at most: buckets times the square of the levels.
    hist = _returned(less, _histogram(*train), "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).toPandas().sort_values("code")
    weights = mixture(hist["code"].to_numpy(dtype=np.int64), hist["n"].to_numpy(dtype=np.float64), distinct)
    schema = "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    found = _returned(answers.where(F.col("kind").isin(WORD, PAIR)).unionByName(own), _scores(weights, train[0] + held[0], train[1] + held[1], distinct), schema)
    return found.select("doc_id", (crc_mod(F.col("doc_id"), mod) == rest).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op1_language_model(spark, sf_dir):
    return score(table(spark, sf_dir, "documents"))
