"""The registered queries on a small folder of tables, and the pipeline against plain Python."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("quirespark.llm")
import corpus_pipeline  # noqa: E402
from quirespark.llm import _common, language_model, mixing, rules  # noqa: E402
from quirespark.llm import queries as registered  # noqa: E402

from .test_operators import BASE, LONG, SECRET_TEXTS, brute_groups, brute_hits, linked_spans, plain_targets, prose, split  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, score double, `a.b` string, label long, s int, n_words int"


def documents():
    rng = np.random.default_rng(31)
    texts = [None, "", " \n\t", "One", BASE, BASE, BASE.upper(), LONG, *[t for t in SECRET_TEXTS if t]]
    texts += [prose(int(n), rng) if k % 4 else prose(int(n), rng).upper().replace(" ", "!! ") for k, n in enumerate(rng.integers(5, 90, 200))]
    texts += [texts[30] + " more", texts[31] + " " + prose(3, rng), "x " + prose(60, np.random.default_rng(77)) + " y", prose(60, np.random.default_rng(77)).upper()]
    return [(k, t, ["en", None, "de"][k % 3], ["a", "b", None, "é", "zz"][k % 5] if k % 3 else "a", 0.5, "m", 1, 2, 3) for k, t in enumerate(texts)] + [(None, BASE, "en", None, 0.5, "m", 1, 2, 3), (None, texts[40], "en", "b", 0.5, "m", 1, 2, 3), (9, texts[9], "en", "b", 0.5, "m", 1, 2, 3)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("tables")
    docs = documents()
    rng = np.random.default_rng(32)
    labels = [(k, int(t is not None and "!!" not in t), int(k % 7 == 0)) for k, t, *_ in docs[: len(docs) - 3]] + [(None, 1, 1), (5, None, None)]
    items = [(1, prose(60, np.random.default_rng(77))), (2, "short one"), (3, None), (None, "none"), (4, prose(20, rng))]
    vectors = [(k, [float(x) for x in rng.normal(size=6)], 0) for k in range(120)] + [(500, None, 0), (600, [0.0] * 6, 0)]
    page = [(k, f"http://x/{k}", "<p>" + "y" * (k % 5 * 60) + "</p>") for k in range(30)] + [(40, None, None)]
    for name, rows, schema in (("documents", docs, SCHEMA), ("labels", labels, "doc_id long, quality int, toxic int"), ("benchmark", items, "item_id long, text string"), ("embeddings", vectors, "vec_id long, embedding array<float>, label int"), ("pages", page, "page_id long, url string, html string")):
        df = spark.createDataFrame(rows, schema)
        df = df.withColumn("n_chars", F.length("text").cast("long")) if name == "documents" else df
        df.repartition(3).write.parquet(f"{at}/{name}.parquet")
    empty = tmp_path_factory.mktemp("none")
    for name in ("documents", "labels", "benchmark", "embeddings", "pages"):
        spark.read.parquet(f"{at}/{name}.parquet").limit(0).write.parquet(f"{empty}/{name}.parquet")
    return str(at), str(empty)


COLUMNS = {
    "op1_language_model": "doc_id:bigint held_out:boolean n_tokens:bigint n_known:bigint train_tokens:bigint base_score:double score:double",
    "op2_mixing": "doc_id:bigint size:bigint source_size:bigint target:double taken:bigint",
    "op3_secrets": "doc_id:bigint n_assign:bigint n_access:bigint n_hex:bigint base_sha256:string spans:string",
    "op4_near_dedup": "doc_id:bigint n_shingles:bigint component_id:bigint kept:boolean",
    "op5_neighbours": "query_id:bigint rank:int vec_id:bigint score:double",
    "op6_quality": "doc_id:bigint held_out:boolean score:double predicted:int",
    "op7_spans": "doc_id:bigint n_removed:bigint text:string",
    "op8_warc": "page_id:bigint payload_bytes:bigint payload_digest:string record_type:string refers_to:bigint",
    "op9_decontaminate": "doc_id:bigint n_words:bigint n_hit:bigint n_items:bigint items_sha256:string contaminated:boolean",
    "op10_toxicity": "doc_id:bigint held_out:boolean score:double predicted:int",
    "op11_whitening": "vec_id:bigint component:int n:bigint deviation:bigint whitened:double explained:double identity_error:double",
    "op12_lines": "doc_id:bigint n_words:bigint word_chars:bigint n_symbols:bigint n_dup_lines:bigint n_repeat_words:bigint base_failed:boolean kept:boolean",
    "op13_manifest": "doc_id:bigint leaf:string subroot:string root:string proof_sha256:string folded_root:string verified:boolean",
}


@pytest.mark.parametrize("name", list(COLUMNS))
def test_queries(spark, folder, name):
    """Columns, a row a document (or as the contract says), what follows from other columns; empty tables give no rows."""
    query = registered.queries()[name]
    df = query(spark, folder[0])
    kinds = dict(df.dtypes)
    assert {c.split(":")[0]: c.split(":")[1] for c in COLUMNS[name].split()}.items() <= kinds.items()
    rows, docs = df.collect(), documents()
    if "doc_id" in kinds:
        assert collections.Counter(r.doc_id for r in rows) == collections.Counter(d[0] for d in docs)
    for r in rows if "held_out" in kinds else []:
        crc = zlib.crc32(b"" if r.doc_id is None else str(r.doc_id).encode()) % 5
        assert r.held_out == (crc == (1 if name.startswith("op1_") else 0))
        if "predicted" in kinds:
            assert 0 <= r.score <= 1 and r.predicted == int(r.score >= (0.3 if name == "op6_quality" else 0.5))
    if name == "op9_decontaminate":
        want = collections.Counter()
        items = [(1, prose(60, np.random.default_rng(77))), (2, "short one"), (4, prose(20, np.random.default_rng(32)))]
        for i, t, *_ in docs:
            if t != LONG:
                n, hit, names = brute_hits(t, items)
                want[i, n, hit, hashlib.sha256(",".join(names).encode()).hexdigest()] += 1
        assert collections.Counter((r.doc_id, r.n_words, r.n_hit, r.items_sha256) for r in rows if r.n_words < 20_000) == want
    assert query(spark, folder[1]).collect() == []


def test_language_model_scores(spark, folder, monkeypatch):
    """Scores by a plain mixture with given weights, and what the mixture learns from, counted one by one."""
    seen = {}
    weights = np.tile([0.1, 0.3, 0.6], (66, 1))
    weights[0] = [0.3, 0.7, 0]

    def mixture(code, n, vocabulary_size, rounds=60):
        seen.update(hist=dict(zip(code.tolist(), n.tolist())), v=vocabulary_size)
        return weights

    monkeypatch.setattr(language_model, "mixture", mixture)
    docs = [d[:2] for d in documents()]
    got = language_model.score(spark.read.parquet(f"{folder[0]}/documents.parquet")).collect()
    crc = lambda i: zlib.crc32(b"" if i is None else str(i).encode())
    tokens = lambda t: ["<s>", *split(t), "</s>"]
    role = lambda i: "none" if crc(i) % 5 == 1 else "held" if crc(i) // 5 % language_model.TUNE == 0 else "train"
    count = {kept: (collections.Counter(), collections.Counter()) for kept in ("less", "all")}
    for i, t in docs:
        w = tokens(t)
        for kept in [[], ["less", "all"], ["all"]][["none", "train", "held"].index(role(i))]:
            count[kept][0].update(w)
            count[kept][1].update(zip(w, w[1:]))
    one, two = count["all"]
    n, v = sum(one.values()) - one["<s>"], len(set(one) - {"<s>"})

    def score(t):
        w, total = tokens(t), 0.0
        for a, b in zip(w, w[1:]):
            l0, l1, l2 = weights[int(math.log2(one[a])) + 1 if one[a] else 0]
            total += math.log10(l2 * two[a, b] / max(one[a], 1) + l1 * one[b] / n + l0 / (v + 1))
        return total

    want = sorted((str(i), round(score(t), 5)) for i, t in docs)
    assert sorted((str(r.doc_id), round(r.score, 5)) for r in got) == want and seen["v"] == v
    one, two = count["less"]
    n = sum(one.values()) - one["<s>"]
    level = lambda part, whole: min(round(-4 * math.log2(part / whole)), 159) if part else 160
    hist = collections.Counter()
    for i, t in docs:
        if role(i) == "held":
            w = tokens(t)
            for a, b in zip(w, w[1:]):
                hist[((int(math.log2(one[a])) + 1 if one[a] else 0) * 161 + level(two[a, b], max(one[a], 1))) * 161 + level(one[b], n)] += 1
    assert seen["hist"] == dict(hist)


def masked(t):
    spans, out, at = linked_spans(t), [], 0
    for a, k, b in spans:
        if a >= at:
            out += [t[at:a], f"[{['assign', 'access', 'hex', 'identifier', 'key', 'endpoint'][k]}]"]
        at = max(at, b)
    return "".join([*out, t[at:]]) if spans else t


def test_pipeline(spark, folder):
    """Each stage against plain Python on what its predecessor kept; the mix holds the words of what is left, as often as its targets say."""
    at, empty = folder
    docs, rows = spark.read.parquet(f"{at}/documents.parquet"), documents()
    plain = lambda df: sorted(((r.doc_id, r.text, r.source, r.lang, r.score, r['a.b'], r.label, r.s, r.n_words) for r in df.collect()), key=str)
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality classifier", "near dedup", "decontamination", "secrets", "mixing"]
    model = rules.fit(docs, spark.read.parquet(f"{at}/labels.parquet"))
    marks = {r.doc.text: r.score for r in rules.score(docs, model).collect()}
    shown = lambda kept: sorted([(i, t, src, lang, *rest) for i, t, lang, src, *rest in kept], key=str)
    left = [r for r in rows if marks[r[1]] >= 0.3]
    for stage, rule in zip([f for _, f in corpus_pipeline.STAGES[:4]], ["quality", "near", "benchmark", "mask"]):
        new = stage(spark, docs, at)
        assert new.columns == docs.columns
        got = plain(new)
        if rule == "near":
            full = [r for r in left if split(r[1])]
            # brute_groups gives the smallest id of each group; one row of each stays.
            by = collections.Counter(c for *_, c, kept in brute_groups([r[:2] for r in full], 5) if kept)
            assert collections.Counter(str(r[0]) for r in got if split(r[1]) and r[0] is not None) == collections.Counter(by.keys())
            left = [next(r for r in left if r[:4] == (g[0], g[1], g[3], g[2])) for g in got]
        elif rule == "benchmark":
            items = [(1, prose(60, np.random.default_rng(77))), (2, "short one"), (4, prose(20, np.random.default_rng(32)))]
            left = [r for r in left if r[1] == LONG or not brute_hits(r[1], items)[1]]
        elif rule == "mask":
            left = [(r[0], masked(r[1]) if r[1] else r[1], *r[2:]) for r in left]
        assert got == shown(left), rule
        docs = spark.createDataFrame([(i, t, lang, src, *rest) for i, t, src, lang, *rest in got], SCHEMA)
    before = len(_common.MADE)
    out = corpus_pipeline.run(spark, at).collect()
    assert len(_common.MADE) == before + 1  # the result alone is left
    sizes = collections.Counter()
    for _, t, _, src, *_ in left:
        sizes[src] += len(re.findall("[^\x20\x09-\x0d]+", t or ""))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = dict(zip(order, plain_targets([sizes[s] for s in order], [1, 2, 3, 1, 2, 3])))
    taken = collections.Counter()
    for r in out:
        assert len(r.text.split(" ")) == r.n_words
        taken[r.source] += r.n_words
    assert {s: taken[s] for s in order} == {s: min(round(t), 3 * sizes[s]) for s, t in want.items()}
    had = {s: collections.Counter(w for _, t, _, src, *_ in left if src == s for w in re.findall("[^\x20\x09-\x0d]+", t or "")) for s in order}
    for s in order:
        used = collections.Counter(w for r in out if r.source == s for w in r.text.split(" "))
        assert all(n <= 3 * had[s][w] for w, n in used.items())
    assert corpus_pipeline.run(spark, empty).collect() == []
    assert corpus_pipeline.ORACLE_SQL is None and mixing.LEAST_BLOCKS > 0
