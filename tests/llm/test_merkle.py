"""The manifest against a plain tree."""

import zlib
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("quirespark.llm")
from quirespark.llm import _common, merkle  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, grp string"
H = lambda s: sha256(s.encode()).hexdigest()


def leaf(row, text):
    said = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    return H("".join(map(said, (row[0], row[3], row[2], row[4], text))))


def climb(nodes):
    """Root of a list, and each place's siblings (left, right) upwards."""
    ways, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, k in enumerate(at):
            run = k // 3 * 3
            ways[i].append(("".join(nodes[run:k]), "".join(nodes[k + 1 : run + 3])))
        nodes, at = [H("".join(nodes[i : i + 3])) for i in range(0, len(nodes), 3)], [k // 3 for k in at]
    return nodes[0], ways


def plain(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[3], []).append((r[0] is not None, r[0] or 0, leaf(r, r[1]), r))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: climb([x[2] for x in sorted(groups[s], key=lambda x: x[:3])]) for s in names}
    root, over = climb([trees[s][0] for s in names])
    out = []
    for s, up in zip(names, over):
        for (_, _, own, r), way in zip(sorted(groups[s], key=lambda x: x[:3]), trees[s][1]):
            even = zlib.crc32(str("" if r[0] is None else r[0]).encode()) % 2 == 0
            at = leaf(r, r[1].replace("\n", "") if even and r[1] is not None else r[1])
            for left, right in way + up:
                at = H(left + at + right)
            out.append((r[0], own, trees[s][0], root, H("".join(a + b for a, b in way + up)), at, at == root))
    return out


def check(spark, rows, bucket=merkle.BUCKET):
    d = spark.createDataFrame(rows, SCHEMA).repartition(3)
    tampered = F.when(_common.crc_mod(F.col("doc_id"), 2) == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    got = sorted(map(repr, map(tuple, merkle.manifest(d, tampered, bucket).collect())))
    assert got == sorted(map(repr, plain(rows)))


def made(ids, sources, seed=1):
    rng = np.random.default_rng(seed)
    return [(i, None if k % 11 == 0 else "line\n" * int(rng.integers(0, 3)) + f"é{k}", None if k % 5 == 0 else "de", sources[k % len(sources)], None if k % 7 == 0 else k, "x") for k, i in enumerate(ids)]


def test_sources_ids_and_repeats(spark):
    odd = [-(2**63), 2**63 - 1, 0, -1, 5, 5, None, None, 10**15]
    rows = made(odd + list(range(40, 140)), ["a", "é", None, "", "a", "b\x00", "b"])
    check(spark, rows + rows[:6] + rows[:3])


def test_buckets_are_split(spark, monkeypatch):
    # Dense, sparse and equal ids in one large source, equal rows among them, and many sources; histograms of many levels.
    monkeypatch.setattr(merkle, "DIGIT", 24)
    rng = np.random.default_rng(2)
    rows = made([*range(300), *map(int, rng.integers(-(2**62), 2**62, 100)), *[7] * 60], ["big"])
    check(spark, rows + [rows[5]] * 30 + made(range(1000, 1090), [f"host{k:02d}" for k in range(45)]), bucket=16)


def test_several_rounds(spark, monkeypatch):
    monkeypatch.setattr(merkle, "LEVELS", 2)
    check(spark, made(range(100), ["one"]) + made(range(200, 340), [f"s{k}" for k in range(100)]))


@pytest.mark.parametrize("n", [0, 1, 4])
def test_small(spark, n):
    check(spark, made(range(n), ["one"])) if n else check_empty(spark)


def check_empty(spark):
    d = spark.createDataFrame([], SCHEMA)
    assert merkle.manifest(d, F.col("text")).collect() == [] and merkle.manifest(d).columns[0] == "doc_id"


def test_untouched(spark):
    rows = made(range(30), ["a", "b"])
    assert all(r.verified for r in merkle.manifest(spark.createDataFrame(rows, SCHEMA)).collect())
