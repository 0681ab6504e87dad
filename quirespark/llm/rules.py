"""Quality classifier: a sparse ensemble of rules over text statistics.

Shallow boosted trees are grown on a bounded sample of labelled rows; every path from a root to a
node is a conjunctive rule. A lasso logistic regression over the rules keeps few of them, and the
model is compiled into one Spark column expression, so that scoring is a plain projection.

Defined cases: a null text is empty and gets a score; labels with null id or quality are left out;
of repeated labels the highest counts; without labels of both kinds every score is the share of
ones (0.5 without labels); repeated rows keep a row each; an empty table gives no rows; other
columns of documents are kept by `keep` and ignored by `score`.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import WORD, crc_mod, table

#: Labelled rows that a fit takes at most, by the hash of their ids.
SAMPLE = 20_000


def statistics(text: Column) -> dict[str, Column]:
    """Counts over the whole text; ratios are taken of them in `features`."""
    count = lambda p: F.regexp_count(text, F.lit(p)).cast("double")
    return {
        "chars": F.length(text).cast("double"),
        "words": count(WORD),
        "upper": count("\\p{Lu}"),
        "lower": F.length(F.regexp_replace(text, "\\P{Ll}++", "")).cast("double"),  # most of a text: no array of single letters
        "digits": count("[0-9]"),
        "stops": count("[.?,;:]"),
        "bangs": count("!"),
        "odd": count("[#$%&*|<>{}\\[\\]\\\\^~=+_@/-]"),
        "lines": count("\\n"),
        "twice": count("(?<![^\\x20\\x09-\\x0D])([^\\x20\\x09-\\x0D]++)\\x20(?=\\1(?![^\\x20\\x09-\\x0D]))"),
    }


def features(s: dict[str, Column]) -> dict[str, Column]:
    """Statistics on which the rules stand."""
    c, w, letters = F.greatest(s["chars"], F.lit(1.0)), F.greatest(s["words"], F.lit(1.0)), F.greatest(s["upper"] + s["lower"], F.lit(1.0))
    return {
        "words": s["words"], "word_length": s["chars"] / w, "upper_share": s["upper"] / letters, "letter_share": (s["upper"] + s["lower"]) / c,
        "digit_share": s["digits"] / c, "stops_per_word": s["stops"] / w, "bangs_per_word": s["bangs"] / w, "odd_per_word": s["odd"] / w,
        "words_per_line": s["words"] / (s["lines"] + 1), "twice_share": s["twice"] / w, "odd": s["odd"], "bangs": s["bangs"], "twice": s["twice"],
    }


def _held(made: dict[str, Column], name: str) -> Column:
    """The columns as one struct that a generator puts out: no filter above it is pushed below it, so that what it holds is computed once a row, however often it is named."""
    return F.explode(F.array(F.struct(*[F.coalesce(v, F.lit(0.0)).alias(k) for k, v in made.items()]))).alias(name)


def _with_features(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """(doc, f): df's row and its features as structs, each statistic and feature being computed once."""
    made = statistics(F.coalesce("text", F.lit("")))
    d = df.select(F.struct("*").alias("doc"), _held(made, "s"))
    f = features({k: F.col("s")[k] for k in made})
    return d.select("doc", _held(f, "f")), list(f)


Rule = tuple[tuple[int, bool, float], ...]  # (feature, above, cut), all of which hold


def grow(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, rate: float = 0.2, bins: int = 32, leaf: int = 10) -> list[Rule]:
    """Paths of boosted regression trees on the logistic gradient."""
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    code = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)  # code > k: above cuts[k]
    score, rules = np.full(len(y), math.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))), {}

    def split(rows, path, left, add):
        p = 1 / (1 + np.exp(-score[rows]))
        g, h = y[rows] - p, np.maximum(p * (1 - p), 1e-6)
        if path:
            rules[tuple(sorted(path))] = None
        best = (1e-6, None, None)
        if left and len(rows) >= 2 * leaf:
            total = g.sum() ** 2 / h.sum()
            for j, c in enumerate(cuts):
                if not len(c):
                    continue
                gs, hs, ns = (np.cumsum(np.bincount(code[rows, j], v, len(c) + 1))[:-1] for v in (g, h, np.ones(len(rows))))
                ok = (ns >= leaf) & (len(rows) - ns >= leaf)
                gain = np.where(ok, gs**2 / np.maximum(hs, 1e-9) + (g.sum() - gs) ** 2 / np.maximum(h.sum() - hs, 1e-9) - total, 0)
                if gain.max() > best[0]:
                    best = (gain.max(), j, int(gain.argmax()))
        if best[1] is None:
            add[rows] += rate * g.sum() / (h.sum() + 1)
            return
        _, j, k = best
        up = code[rows, j] > k
        split(rows[~up], [*path, (j, False, float(cuts[j][k]))], left - 1, add)
        split(rows[up], [*path, (j, True, float(cuts[j][k]))], left - 1, add)

    for _ in range(trees):
        add = np.zeros(len(y))
        split(np.arange(len(y)), [], depth, add)
        score += add
    return list(rules)


def holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    return np.logical_and.reduce([(x[:, j] > c) if above else (x[:, j] <= c) for j, above, c in rule])


def lasso(z: np.ndarray, y: np.ndarray, penalty: float, steps: int = 400) -> tuple[float, np.ndarray]:
    """Logistic regression with an L1 penalty by accelerated proximal gradient; the intercept is free."""
    n, m = z.shape
    w, b, v, c, t = np.zeros(m), math.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)), np.zeros(m), 0.0, 1.0
    c = b
    norm = np.ones(m)
    for _ in range(12):
        norm = z.T @ (z @ norm)
        norm /= np.linalg.norm(norm) + 1e-12
    rate = 4 * n / (np.linalg.norm(z @ norm) ** 2 + n)
    for _ in range(steps):
        e = 1 / (1 + np.exp(-(z @ v + c))) - y
        w2, b2 = v - rate * (z.T @ e) / n, c - rate * e.mean()
        w2 = np.sign(w2) * np.maximum(np.abs(w2) - rate * penalty, 0)
        t2 = (1 + math.sqrt(1 + 4 * t * t)) / 2
        v, c = w2 + (t - 1) / t2 * (w2 - w), b2 + (t - 1) / t2 * (b2 - b)
        w, b, t = w2, b2, t2
    return b, w


@dataclass
class Ensemble:
    names: list[str]
    bias: float
    rules: list[tuple[Rule, float]]

    def score(self) -> Column:
        """Probability of label 1, over the struct f of features."""
        total = F.lit(self.bias)
        for rule, weight in self.rules:
            test = F.lit(True)
            for j, above, c in rule:
                f = F.col("f")[self.names[j]]
                test = test & ((f > c) if above else (f <= c))
            total = total + F.when(test, weight).otherwise(0.0)
        return 1 / (1 + F.exp(-total))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, penalty: float = 1e-3) -> Ensemble:
    """Learns from labelled rows whose crc32 of the id is not 0 modulo 5, `sample` at most by the hash of their ids; of rows with equal ids one, by its features."""
    marks = labels.where("doc_id is not null and quality is not null").where(crc_mod(F.col("doc_id")) != 0)
    marks = marks.groupBy("doc_id").agg(F.max("quality").alias("_y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # The join's small side has `sample` rows at most, and so has its result, a row an id.
    rows, names = _with_features(docs.select("doc_id", "text").join(F.broadcast(marks), "doc_id"))
    one = Window.partitionBy("doc_id").orderBy("f")
    rows = rows.select("doc.doc_id", "doc._y", "f").withColumn("_no", F.row_number().over(one)).where("_no = 1")
    got = rows.select("doc_id", "_y", "f.*").toPandas().sort_values("doc_id")
    y = got["_y"].to_numpy(dtype=float)
    share = float(y.mean()) if len(y) else 0.5
    flat = Ensemble(names, math.log((share + 1e-3) / (1 - share + 1e-3)), [])
    if len(y) < 20 or share in (0.0, 1.0):
        return flat
    x = got[names].to_numpy(dtype=float)
    rules = grow(x, y)
    if not rules:
        return flat
    z = np.stack([holds(r, x) for r in rules], axis=1).astype(np.float32)
    b, w = lasso(z, y, penalty)
    return Ensemble(names, float(b), [(r, float(v)) for r, v in zip(rules, w) if v])


def score(docs: DataFrame, model: Ensemble) -> DataFrame:
    """(doc, score): each row of docs as a struct, and its score."""
    return _with_features(docs)[0].select("doc", model.score().alias("score"))


def keep(docs: DataFrame, model: Ensemble, least: float = 0.3) -> DataFrame:
    return score(docs, model).where(F.col("score") >= least).select(*[F.col("doc")[c].alias(c) for c in docs.columns])


def op6_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    s = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return s.select("doc.doc_id", (crc_mod(F.col("doc.doc_id")) == 0).alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))
