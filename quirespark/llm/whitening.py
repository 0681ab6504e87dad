"""Whitening of embeddings: a covariance in two passes over exact integers, its eigenvectors, a projection.

A vector's entries become integers x = floor(scale * entry). The fit list has each distinct x once.
The first pass sums it exactly and gives the mean; the second sums outer products of centred blocks
by matrix products in numpy. Partial results, a row a partition, are merged by treeAggregate. LAPACK's
symmetric eigh runs on the driver, on a matrix of the vectors' length squared, whatever the number of
rows. Tasks project all rows. A third pass measures the covariance of what comes out.

Defined cases: vectors that are null, empty or hold null or non-finite entries, or entries whose x
is beyond 64 bits, take no part. Where vectors differ in length, the length with most entries in the
fit list counts (the longer on ties), and other rows take no part. Components whose eigenvalue is
nothing but rounding have no whitened values, so that there are fewer of them than asked for when the
fit list has less directions; an empty table or a single distinct vector gives no rows. A null id and
repeated rows keep their rows. A deviation beyond 64 bits is null. Other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import cut, table

#: Integer steps of an entry of one.
SCALE = 256
#: Longs that a double has exactly.
EXACT = 1 << 53


def _integers(column: pa.Array, scale: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of the rows that take part, their lengths, and their integers one after another."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    entries = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    with np.errstate(over="ignore", invalid="ignore"):
        x = np.floor(entries * scale)
        fine = (x >= -(2.0**63)) & (x < 2.0**63)
    owner = np.repeat(np.arange(len(lengths)), lengths)
    keep = (lengths > 0) & (np.bincount(owner[~fine], minlength=len(lengths)) == 0)
    return np.flatnonzero(keep), lengths[keep], x[keep[owner]].astype(np.int64)


def integers(vectors: DataFrame, column: str = "embedding", scale: int = SCALE) -> DataFrame:
    """x: each distinct vector of integers once, as the bytes of its little-endian longs."""

    def run(batches):
        for b in batches:
            _, lengths, x = _integers(b.column(0), scale)
            at = np.concatenate([[0], np.cumsum(lengths * 8)]).astype(np.int64)
            data = x.astype("<i8").tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([data[i:j] for i, j in zip(at, at[1:])], pa.binary())], ["x"])

    return vectors.select(F.col(column).alias("x")).mapInArrow(run, "x binary").distinct()


def _blocks(batches, length: int):
    """Vectors of that length as matrices of longs, a batch each."""
    for b in batches:
        rows = [v for v in b.column(0).to_pylist() if len(v) == 8 * length]
        if rows:
            yield np.frombuffer(b"".join(rows), dtype="<i8").reshape(len(rows), length)


def _sums(fit: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """Number and exact sums of the vectors of each length: halves of 32 bits are summed in 64."""

    def run(batches):
        found: dict[int, list] = {}
        for b in batches:
            rows = b.column(0).to_pylist()
            for length in {len(v) >> 3 for v in rows}:
                x = np.frombuffer(b"".join(v for v in rows if len(v) >> 3 == length), dtype="<i8").reshape(-1, length)
                high, low = (x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0)
                n, sums = found.get(length, (0, [0] * length))
                found[length] = (n + len(x), [s + (h << 32) + w for s, h, w in zip(sums, high.tolist(), low.tolist())])
        yield from (pa.RecordBatch.from_arrays([pa.array([k]), pa.array([n]), pa.array([[str(s) for s in sums]])], ["length", "n", "sums"]) for k, (n, sums) in found.items())

    def add(a: dict, r) -> dict:
        return merged(a, {r["length"]: (r["n"], [int(s) for s in r["sums"]])})

    def merged(a: dict, b: dict) -> dict:
        out = dict(a)
        for k, (n, sums) in b.items():
            m, old = out.get(k, (0, [0] * k))
            out[k] = (m + n, [s + t for s, t in zip(old, sums)])
        return out

    return fit.mapInArrow(run, "length long, n long, sums array<string>").rdd.treeAggregate({}, add, merged)


def _products(fit: DataFrame, length: int, block) -> np.ndarray:
    """The sum of z'z over the rows z of block(matrix of longs) of all vectors."""

    def run(batches):
        total = None
        for x in _blocks(batches, length):
            z = block(x)
            part = z.T @ z
            total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["z"])

    def add(a, r):
        part = np.frombuffer(bytes(r["z"]))
        return part if a is None else a + part

    total = fit.mapInArrow(run, "z binary").rdd.treeAggregate(None, add, lambda a, b: b if a is None else a if b is None else a + b)
    k = int(round(len(total) ** 0.5))
    return total.reshape(k, k)


@dataclass
class Whitening:
    """n: vectors in the fit list; sums: of each dimension, exact; values, vectors: eigenvalues, falling, with unit eigenvectors as rows; trace: of the covariance; identity_error: largest entry of the whitened fit list's covariance minus the identity."""

    scale: int
    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float = 0.0

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x less the mean: its whole part is taken off exactly, so that large offsets lose no digits."""
        whole = [(2 * s + self.n) // (2 * self.n) for s in self.sums]
        rest = np.array([(s - self.n * m) / self.n for s, m in zip(self.sums, whole)])
        if len(x) and max(abs(int(x.min())), abs(int(x.max())), *map(abs, whole)) < EXACT:
            return x.astype(np.float64) - np.array(whole, dtype=np.float64) - rest
        return (x.astype(object) - np.array(whole, dtype=object)).astype(np.float64) - rest

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n * x - sum)^2, exact; None beyond 64 bits."""
        if not len(x):
            return []
        most = self.n * max(abs(int(x.min())), abs(int(x.max()))) + max(map(abs, self.sums))
        if most**2 * len(self.sums) < 2**63:
            return ((self.n * x - np.array(self.sums, dtype=np.int64)) ** 2).sum(axis=1).tolist()
        exact = [sum((self.n * v - s) ** 2 for v, s in zip(row, self.sums)) for row in x.tolist()]
        return [v if v < 2**63 else None for v in exact]

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.vectors.T / np.sqrt(self.values)


def fit(vectors: DataFrame, column: str = "embedding", components: int = 4, scale: int = SCALE) -> Whitening | None:
    """The whitening of the distinct vectors; None without any."""
    distinct = cut(integers(vectors, column, scale))
    sums = _sums(distinct)
    if not sums:
        return None
    length = max(sums, key=lambda k: (sums[k][0], k))
    n, total = sums[length]
    w = Whitening(scale, n, total, np.zeros(0), np.zeros((0, length)), 0.0)
    cov = _products(distinct, length, w.centred) / n
    values, axes = np.linalg.eigh((cov + cov.T) / 2)
    values, axes = values[::-1], axes.T[::-1]
    real = int((values > values[0] * length * np.finfo(float).eps).sum()) if values[0] > 0 else 0
    k = min(components, real)
    w.values, w.vectors, w.trace = values[:k].copy(), axes[:k].copy(), float(np.trace(cov))
    if k:
        # A column of ones beside the whitened ones gives their sums along with the products.
        both = _products(distinct, length, lambda x: np.hstack([w.whitened(x), np.ones((len(x), 1))])) / n
        mean = both[:k, k]
        w.identity_error = float(np.abs(both[:k, :k] - np.outer(mean, mean) - np.eye(k)).max())
    return w


def whiten(vectors: DataFrame, w: Whitening | None, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """A row a vector that takes part: key, deviation, whitened (an array, a value a component)."""
    kind = dict(vectors.dtypes)[key]
    shape = f"{key} {kind}, deviation long, whitened array<double>"
    if w is None or not len(w.values):
        return vectors.select(key).limit(0).select(key, F.lit(None).cast("long").alias("deviation"), F.lit(None).cast("array<double>").alias("whitened"))
    known = vectors.sparkSession.sparkContext.broadcast(w)

    def run(batches):
        w = known.value
        length = len(w.sums)
        for b in batches:
            rows, lengths, x = _integers(b.column(1), w.scale)
            own = lengths == length
            x = x[np.repeat(own, lengths)].reshape(-1, length)
            values = w.whitened(x)
            out = pa.ListArray.from_arrays(pa.array(np.arange(0, values.size + 1, values.shape[1]), pa.int32()), pa.array(values.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows[own])), pa.array(w.deviation(x), pa.int64()), out], [key, "deviation", "whitened"])

    return vectors.select(key, column).mapInArrow(run, shape)


def op11_whitening(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    w = fit(e)
    rows = whiten(e, w).select("vec_id", "deviation", F.posexplode("whitened").alias("i", "whitened"))
    shares = F.array(*[F.lit(float(v / w.trace)) for v in w.values]) if w is not None and len(w.values) else F.array().cast("array<double>")
    return rows.select("vec_id", (F.col("i") + 1).cast("int").alias("component"), F.lit(w.n if w else 0).cast("long").alias("n"), "deviation", "whitened", F.get(shares, F.col("i")).alias("explained"), F.lit(w.identity_error if w else 0.0).alias("identity_error"))
