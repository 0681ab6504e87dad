"""Nearest neighbours with score-aware anisotropic quantisation; what the tables can't rule out is measured exactly.

Vectors are centred at the medians of a bounded sample, and their directions are coded: the product
quantiser has 16 centroids (four bits) for each pair of dimensions and is fitted on that sample so that
the part of the residual that lies along a vector, which changes large inner products most, weighs
more than the rest. Every vector is coded, with the length that leaves a residual across the vector
alone, and with the length of that residual. A code and its table entries give the distance from a
query to the coded point; less the residual's length it is a bound that no vector falls below.

Codes stand in blocks with their vectors, queries in blocks of their own, which meet on a grid. A task
keeps the queries of its place and passes the blocks of codes by them: for a query's first block the
`pool` best by the tables are measured, later k of each; then whatever the bound allows to be among the k
nearest. So all of the nearest are found, whatever the vectors look like; where the tables part
little (clusters much narrower than their distance from the middle), more has to be measured, by a matrix
product first.

Equal vectors are one entry with their smallest ids (k + 1, enough for any query's k), so that a
common vector neither crowds out others nor gathers in one task.

Defined cases: vec_id is an integer (another type fails the job). Vectors that are null, empty, zero,
hold a null or non-finite component or are of another length than most take no part, neither do null
ids; repeated rows with an id count once; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import partitions, table

CENTROIDS, PAIR = 16, 2
#: Rows of the fit at most, by the hash of their ids.
SAMPLE = 8192


def fit(x: np.ndarray, ratio: float = 4.0, rounds: int = 6, seed: int = 3) -> np.ndarray:
    """Centroids: pairs x 16 x 2. ratio: weight of residuals along a vector against those across it."""
    rng = np.random.default_rng(seed)
    n, d = x.shape
    m = d // PAIR
    parts = x.reshape(n, m, PAIR)
    c = parts[rng.integers(0, n, (CENTROIDS, m)), np.arange(m)].transpose(1, 0, 2).copy()
    u = (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)).reshape(n, m, PAIR)
    codes = _nearest(parts, c)
    for _ in range(8):  # plain k-means as a start
        for j in range(m):
            for k in range(CENTROIDS):
                mine = codes[:, j] == k
                c[j, k] = parts[mine, j].mean(axis=0) if mine.any() else parts[rng.integers(0, n), j]
        codes = _nearest(parts, c)
    more = ratio - 1
    for _ in range(rounds):
        codes = assign(x, c, ratio, codes)
        # The centroids of all pairs together: one linear system.
        size = m * CENTROIDS * PAIR
        g = np.zeros((n, size), dtype=np.float32)
        col = (np.arange(m)[None, :] * CENTROIDS + codes)[:, :, None] * PAIR + np.arange(PAIR)
        np.put_along_axis(g, col.reshape(n, -1), u.reshape(n, -1).astype(np.float32), axis=1)
        count, total = np.zeros(size), np.zeros(size)
        np.add.at(count, col.ravel(), 1)
        np.add.at(total, col.ravel(), parts.ravel())
        h = np.diag(count + 1e-3) + more * (g.T @ g)
        rhs = total + 1e-3 * c.ravel() + more * (g.T @ (u * parts).sum(axis=(1, 2)).astype(np.float32))
        c = np.linalg.solve(h, rhs).reshape(m, CENTROIDS, PAIR)
    return c


def _nearest(parts: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.stack([((parts[:, j, None] - c[j][None]) ** 2).sum(axis=2).argmin(axis=1) for j in range(c.shape[0])], axis=1)


def assign(x: np.ndarray, c: np.ndarray, ratio: float = 4.0, codes: np.ndarray | None = None, sweeps: int = 2) -> np.ndarray:
    """Codes by coordinate descent on |r|^2 + (ratio - 1) (r.u)^2, r being the residual and u the vector's direction."""
    n, m = len(x), c.shape[0]
    parts = x.reshape(n, m, PAIR)
    u = (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)).reshape(n, m, PAIR)
    codes = _nearest(parts, c) if codes is None else codes.copy()
    along = ((parts - c[np.arange(m), codes]) * u).sum(axis=(1, 2))
    for _ in range(sweeps):
        for j in range(m):
            r = parts[:, j, None] - c[j][None]
            part = (r * u[:, j, None]).sum(axis=2)
            rest = along - part[np.arange(n), codes[:, j]]
            codes[:, j] = ((r**2).sum(axis=2) + (ratio - 1) * (rest[:, None] + part) ** 2).argmin(axis=1)
            along = rest + part[np.arange(n), codes[:, j]]
    return codes


def scan(q: np.ndarray, c: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Queries x entries: inner products of queries with codes, by table entries."""
    m = c.shape[0]
    t = np.einsum("qmp,mkp->mqk", q.reshape(len(q), m, PAIR), c).astype(np.float32)
    s = np.zeros((len(q), len(codes)), dtype=np.float32)
    for j in range(m):
        s += t[j][:, codes[:, j]]
    return s


def directions(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def coded(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the directions of centred vectors, and by row: the code's factor, its length times that, the residual's length."""
    u = directions(x)
    codes = assign(u, c)
    hat = c[np.arange(c.shape[0]), codes].reshape(len(x), -1)
    size, along = np.linalg.norm(x, axis=1), (u * hat).sum(axis=1)
    factor = size / np.where(along > 0.2, along, 1)
    return codes, np.stack([factor, factor * np.linalg.norm(hat, axis=1), np.linalg.norm(x - factor[:, None] * hat, axis=1)], axis=1)


class Best:
    """The k nearest of what a block of queries has met so far, by distance and id; a query's own id is left out."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, middle: np.ndarray, k: int):
        self.ids, self.vectors, self.k = ids, vectors, k
        self.centred = vectors - middle
        self.size = np.linalg.norm(self.centred, axis=1)
        self.slack = 1e-12 * (self.size + np.linalg.norm(middle))  # more than rounding moves a distance
        self.found = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)  # query's place, id, distance
        self.far = np.full(len(ids), np.inf)  # each query's k-th distance

    def measure(self, at: np.ndarray, col: np.ndarray, block: Block) -> None:
        """Takes the distances of pairs (query, entry of the block) from the vectors as given."""
        d = np.zeros(len(at))
        for i in range(0, len(at), 4096):
            d[i : i + 4096] = np.sqrt(((block.vectors[col[i : i + 4096]].astype(np.float64) - self.vectors[at[i : i + 4096]]) ** 2).sum(axis=1))
        near = d <= self.far[at]
        at, col, d = at[near], col[near], d[near]
        n = block.many[col]
        place = np.repeat(block.first[col] - np.cumsum(n) + n, n) + np.arange(n.sum())
        q, ids, d = np.repeat(at, n), block.ids[place], np.repeat(d, n)
        other = ids != self.ids[q]
        q, ids, d = (np.concatenate([a, b[other]]) for a, b in zip(self.found, (q, ids, d)))
        order = np.lexsort((ids, d, q))
        q, ids, d = q[order], ids[order], d[order]
        start = np.searchsorted(q, np.arange(len(self.ids)))
        rank = np.arange(len(q)) - start[q]
        self.far[q[rank == self.k - 1]] = d[rank == self.k - 1]
        self.found = q[rank < self.k], ids[rank < self.k], d[rank < self.k]

    def meet(self, block: Block, c: np.ndarray, pool: int) -> None:
        for i in range(0, len(self.ids), 64):
            self._meet(np.arange(i, min(i + 64, len(self.ids))), block, c, pool)

    def _meet(self, mine: np.ndarray, block: Block, c: np.ndarray, pool: int) -> None:
        size, n = self.size[mine, None], len(block.factor)
        wide = np.zeros((len(mine), c.shape[0] * PAIR))
        wide[:, : self.centred.shape[1]] = directions(self.centred[mine])
        product = scan(wide, c, block.codes) * block.factor
        square = size**2 + block.length**2 - 2 * size * product  # from the query to the coded point
        first = min(n, pool if np.isinf(self.far[mine]).any() else self.k + 1)
        guess = square - block.residual**2
        col = np.argpartition(guess, first - 1, axis=1)[:, :first] if first < n else np.tile(np.arange(n), (len(mine), 1))
        self.measure(np.repeat(mine, first), col.ravel(), block)
        # Single-precision sums of the tables differ by less than this; what isn't a finite bound rules nothing out.
        square -= 2.4e-7 * (c.shape[0] + 4) * size * block.length + 1e-12 * (size**2 + block.length**2)
        far = (self.far[mine] + self.slack[mine])[:, None] + 1e-12 * block.size
        bound = np.sqrt(np.maximum(square, 0)) - block.residual
        left = ~((bound > far) & np.isfinite(bound))
        np.put_along_axis(left, col, False, axis=1)
        if left.sum() > left.size // 16:
            square = size**2 + block.size**2 - 2 * (self.centred[mine] @ block.centred.T)
            left &= ~((square - 1e-12 * (size**2 + block.size**2) > far**2) & np.isfinite(square))
        at, col = np.nonzero(left)
        self.measure(mine[at], col, block)


class Block:
    """Vectors with their codes and ids."""

    def __init__(self, vectors: np.ndarray, middle: np.ndarray, codes: np.ndarray, lengths: np.ndarray, many: np.ndarray, ids: np.ndarray):
        self.vectors, self.codes, self.many, self.ids = vectors, codes, many, ids
        self.factor, self.length, self.residual = lengths.T
        self.first = np.cumsum(many) - many
        self.centred = vectors - middle
        self.size = np.linalg.norm(self.centred, axis=1)


def _packed(a: np.ndarray) -> bytes:
    return (a[:, ::2] | (a[:, 1::2] << 4) if a.shape[1] % 2 == 0 else a).astype(np.uint8).tobytes()


def _unpacked(raw: bytes, n: int, m: int) -> np.ndarray:
    a = np.frombuffer(raw, dtype=np.uint8).reshape(n, -1)
    if m % 2:
        return a
    out = np.empty((n, m), dtype=np.uint8)
    out[:, ::2], out[:, 1::2] = a & 15, a >> 4
    return out


def _usable(vectors: DataFrame) -> DataFrame:
    good = F.col("embedding").isNotNull() & (F.size("embedding") > 0) & F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))) & F.exists("embedding", lambda v: v != 0)
    return vectors.where(F.col("vec_id").isNotNull() & good).select("vec_id", "embedding")


def entries(v: DataFrame, k: int) -> DataFrame:
    """Distinct vectors with their k + 1 smallest ids. Batches and then salted groups keep only so many, so that no group is gathered whole."""
    kept = k + 1

    def local(it):
        for p in it:
            p["ids"] = p["vec_id"]
            p["key"] = [np.asarray(e, dtype=np.float64).tobytes() for e in p["embedding"]]
            p = p.drop_duplicates(["key", "vec_id"]).sort_values("vec_id")
            g = p.groupby("key", sort=False)
            first = g.head(1)[["embedding", "key"]].set_index("key")
            ids = g.head(kept).groupby("key", sort=False)["vec_id"].agg(list)
            yield pd.DataFrame({"embedding": first["embedding"], "ids": ids.reindex(first.index)}).reset_index(drop=True)

    few = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, kept).alias("ids")
    # -0.0 and 0.0 are one number.
    kind = dict(v.dtypes)["embedding"]
    even = v.withColumn("embedding", F.transform("embedding", lambda x: x + F.lit(0.0)).cast(kind))
    rows = even.mapInPandas(local, f"embedding {kind}, ids array<long>").withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(64)))
    return rows.groupBy("embedding", "salt").agg(few).groupBy("embedding").agg(few)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, pool: int = 400, query_block: int = 512, code_block: int = 4096, span_bytes: int = 64 << 20, sample: int = SAMPLE) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest of vectors (vec_id, embedding) to each row of queries, itself left out.

    pool: entries a query, best by the tables, that are measured before any bound is known. span_bytes: what the queries of one task's place may hold.
    """
    spark = vectors.sparkSession
    v, q = _usable(vectors), _usable(queries).dropDuplicates(["vec_id"])
    schema = "query_id long, rank int, vec_id long, score double"
    length = v.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if length is None:
        return spark.createDataFrame([], schema)
    d = length.d
    wide = d + d % PAIR
    v, q = v.where(F.size("embedding") == d), q.where(F.size("embedding") == d)
    some = v.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).collect()
    x = np.array([r.embedding for r in some], dtype=np.float64)
    middle = np.median(x, axis=0)
    c = fit(directions(np.pad(x - middle, ((0, 0), (0, wide - d)))))
    m = c.shape[0]
    tasks = partitions(spark)
    kind = np.float32 if dict(v.dtypes)["embedding"] == "array<float>" else np.float64

    def code(it):
        for p in it:
            for i in range(0, len(p), code_block):
                part = p.iloc[i : i + code_block]
                a = np.stack(part["embedding"].to_list()).astype(kind)
                codes, lengths = coded(np.pad(a - middle, ((0, 0), (0, wide - d))), c)
                ids = part["ids"].to_list()
                raw = _packed(codes.astype(np.uint8)), lengths.tobytes(), np.array([len(x) for x in ids], dtype=np.int64).tobytes(), np.concatenate(ids).astype(np.int64).tobytes()
                yield pd.DataFrame({"no": [int(ids[0][0])], "ids": [raw[3]], "vectors": [a.tobytes()], **{n: [r] for n, r in zip(("codes", "lengths", "many"), raw)}})

    def gather(it):
        for p in it:
            for i in range(0, len(p), query_block):
                part = p.iloc[i : i + query_block]
                a = np.stack(part["embedding"].to_list()).astype(kind)
                yield pd.DataFrame({"no": [int(part["vec_id"].iloc[0])], "ids": [part["vec_id"].to_numpy(dtype=np.int64).tobytes()], "vectors": [a.tobytes()]})

    # A grid of cells x spans: a block of codes goes to one cell of every span, a block of queries to all cells of its span.
    q_parts = max(1, -(-q.count() // query_block))
    per_span = max(1, span_bytes // (query_block * (20 * d + 24 * k + 40)))
    spans = -(-q_parts // per_span)
    cells = max(1, -(-tasks // spans))

    def search(it):
        held, where = [], None
        for b in it:
            for r in b.to_pylist():
                if where != (r["cell"], r["span"]):
                    yield from said(held)
                    held, where = [], (r["cell"], r["span"])
                ids, a = np.frombuffer(r["ids"], dtype=np.int64), np.frombuffer(r["vectors"], dtype=kind).reshape(-1, d)
                if r["codes"] is None:
                    held.append(Best(ids, a.astype(np.float64), middle, k))
                    continue
                many = np.frombuffer(r["many"], dtype=np.int64)
                block = Block(a, middle, _unpacked(r["codes"], len(many), m), np.frombuffer(r["lengths"]).reshape(-1, 3), many, ids)
                with np.errstate(over="ignore", invalid="ignore"):
                    for best in held:
                        best.meet(block, c, pool)
        yield from said(held)

    def said(held: list):
        for best in held:
            at, ids, score = best.found
            yield pa.RecordBatch.from_arrays([pa.array(best.ids[at]), pa.array(ids), pa.array(score)], ["query_id", "vec_id", "score"])

    raw = "codes binary, lengths binary, many binary"
    codes = entries(v, k).repartition(tasks, F.get("ids", F.lit(0))).mapInPandas(code, f"no long, ids binary, vectors binary, {raw}")
    codes = codes.withColumn("cell", F.pmod(F.xxhash64("no"), F.lit(cells)).cast("int")).withColumn("span", F.explode(F.sequence(F.lit(0), F.lit(spans - 1))))
    blocks = q.repartitionByRange(q_parts, F.xxhash64("vec_id")).mapInPandas(gather, "no long, ids binary, vectors binary").withColumn("span", F.floor(F.spark_partition_id() / per_span).cast("int"))
    blocks = blocks.withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(cells - 1))))
    # A place's queries come before its codes.
    both = blocks.withColumn("part", F.lit(0)).unionByName(codes.withColumn("part", F.lit(1)), allowMissingColumns=True)
    near = both.repartition(tasks, "cell", "span").sortWithinPartitions("cell", "span", "part", "no").mapInArrow(search, "query_id long, vec_id long, score double")
    nearest_first = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return near.withColumn("rank", F.row_number().over(nearest_first)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_neighbours(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    return nearest(v, v.where("vec_id % 100 = 0"))
