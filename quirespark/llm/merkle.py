"""Merkle manifest of a dataset: a hash tree over documents by source, and over sources, with a proof a document.

Ranks come without a global sort. Histograms of the leading digits of doc_id are added up digit by
digit, from the longest prefix to the shortest: a row's rank is the number of rows with smaller
digits under each of its prefixes, plus its place among the rows of its own prefix. Prefixes grow
until none has more than `BUCKET` rows, so that no window has more rows than that or digits than a
histogram; rows with equal ids go on by the digest of their leaf and then by row. The rank's digits in
the base of the fan-out are the path of a leaf in a trie. Nodes that share all but the last `LEVELS`
digits are one piece: pieces are reduced to their node, longest prefixes first, until each source has
one node. Then proofs come down the same pieces. Sources are ranked and reduced in the same way.

Defined cases: doc_id is an integer. A null field is `-`; rows with equal ids stand by digest, null
ids first; equal rows are leaves of their own; a null id counts as an empty text in the choice of
tampered rows; a null source is a source, before all others; an empty table gives no rows; other
columns are ignored. Should more than `BUCKET` sources agree in their first 56 bytes, these are sorted
in one task.
"""

from __future__ import annotations

from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import crc_mod, cut, partitions, table

FANOUT = 3
#: Levels of the trie that are reduced at once: a piece has FANOUT to the power of LEVELS nodes at most.
LEVELS = 6
#: Rows of a prefix at most, bits of a digit, and bits by which prefixes grow.
BUCKET, DIGIT, GROWTH = 1 << 10, 12, 3
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def _said(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(text: Column) -> Column:
    """Digest of a document's fields with this text."""
    return F.sha2(F.concat(*[_said(F.col(c) if c != "text" else text) for c in FIELDS]), 256)


def leaves(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """doc_id, grp (a text that orders sources as bytes, null first), row_no, leaf and now, the leaf with the tampered text, as bytes."""
    grp = F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("grp")
    first = F.unhex(leaf(F.col("text")))
    now = first if tampered is None else F.when(tampered.eqNullSafe(F.col("text")), first).otherwise(F.unhex(leaf(tampered)))
    return docs.select("doc_id", grp, first.alias("leaf"), now.alias("now"), F.monotonically_increasing_id().alias("row_no"))


def _prefixes(keys: list[tuple[Column, int]], bits: int) -> list[Column]:
    """The leading bits of the keys (longs with so many bits that differ) taken together, a column a key."""
    out = []
    for key, width in keys:
        used = max(0, min(bits, width))
        out.append(F.shiftright(key, width - used) if used else F.lit(0).cast("long"))
        bits -= width
    return out


def _before(counts: DataFrame, keys: list[tuple[str, int]], bits: int) -> DataFrame:
    """counts (grp, prefixes of `bits` bits as b0, b1, ..., n) with before: the rows of the group under smaller prefixes, and total: all its rows."""
    names = [f"b{i}" for i in range(len(keys))]
    if bits <= DIGIT:
        group = Window.partitionBy("grp")
        before = F.coalesce(F.sum("n").over(group.orderBy(*names).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        return counts.withColumns({"before": before, "total": F.sum("n").over(group)})
    # The same prefixes without their last digit.
    up, left, passed = [], bits - DIGIT, 0
    for i, (_, width) in enumerate(keys):
        have, want = max(0, min(bits - passed, width)), max(0, min(left - passed, width))
        up.append((F.shiftright(f"b{i}", have - want) if want else F.lit(0).cast("long")).alias(f"u{i}"))
        passed += width
    tops = [f"u{i}" for i in range(len(keys))]
    own = counts.select("*", *up)
    above = own.groupBy("grp", *tops).agg(F.sum("n").alias("n")).select("grp", *[F.col(u).alias(b) for u, b in zip(tops, names)], "n")
    above = _before(above, keys, left).select("grp", *[F.col(b).alias(u) for u, b in zip(tops, names)], F.col("before").alias("_above"), "total")
    among = Window.partitionBy("grp", *tops).orderBy(*names).rowsBetween(Window.unboundedPreceding, -1)
    within = own.withColumn("_within", F.coalesce(F.sum("n").over(among), F.lit(0)))
    return within.join(above, ["grp", *tops]).withColumn("before", F.col("_above") + F.col("_within")).drop("_above", "_within", *tops)


def _width(low: int | None, high: int | None) -> int:
    """Bits in which longs of this range differ."""
    if low is None:
        return 0
    return 64 if low < 0 <= high else (low ^ high).bit_length()


def ranked(rows: DataFrame, keys: list[Column], order: list[str], bucket: int = BUCKET) -> DataFrame:
    """rows (grp, ...), read more than once, with rank (from 0, by `order` within a group) and n, the rows of the group. keys: longs, none null, in the order that `order` has."""
    r = rows.select("*", *[k.cast("long").alias(f"_k{i}") for i, k in enumerate(keys)])
    ends = r.agg(*[f(f"_k{i}") for i in range(len(keys)) for f in (F.min, F.max)], F.count("*")).first()
    widths = [(f"_k{i}", _width(ends[2 * i], ends[2 * i + 1])) for i in range(len(keys))]
    names, total = [f"b{i}" for i in range(len(keys))], sum(w for _, w in widths)
    # So many bits do if ids are evenly spread; where they aren't, prefixes grow.
    bits = min(total, max(0, ends[-1] // bucket).bit_length())
    while True:
        marks = [c.alias(b) for c, b in zip(_prefixes([(F.col(k), w) for k, w in widths], bits), names)]
        counts = r.select("grp", *marks).groupBy("grp", *names).agg(F.count("*").alias("n"))
        if bits >= total or (counts.agg(F.max("n")).first()[0] or 0) <= bucket:
            break
        bits = min(bits + GROWTH, total)
    counts = _before(counts, widths, bits).drop("n").withColumnRenamed("total", "n")
    r = r.select(*rows.columns, *marks).join(counts.hint("shuffle_hash"), ["grp", *names])
    place = F.row_number().over(Window.partitionBy("grp", *names).orderBy(*order)) - 1
    return r.withColumn("rank", F.col("before") + place).drop("before", *names)


def _joined(digests: list[bytes]) -> bytes:
    return sha256("".join(d.hex() for d in digests).encode()).digest()


def _tree(nodes: list[bytes], levels: int) -> list[list[bytes]]:
    """Nodes level by level: so many times, each FANOUT of them become one."""
    out = [nodes]
    for _ in range(levels):
        nodes = [_joined(nodes[i : i + FANOUT]) for i in range(0, len(nodes), FANOUT)]
        out.append(nodes)
    return out


def height(n: int) -> int:
    """Levels above n nodes until one is left."""
    h = 0
    while n > 1:
        n, h = -(-n // FANOUT), h + 1
    return h


def _pieces(batches, names: list[str]):
    """Rows of a sorted partition, a piece (grp, piece) at a time, as lists by column."""
    held: dict[str, list] = {}
    at = None
    for b in batches:
        cols = {c: b.column(c).to_pylist() for c in names}
        marks = list(zip(cols["grp"], cols["piece"]))
        i = 0
        while i < len(marks):
            j = i
            while j < len(marks) and marks[j] == marks[i]:
                j += 1
            if marks[i] != at:
                if held:
                    yield held
                held, at = {c: [] for c in names}, marks[i]
            for c in names:
                held[c] += cols[c][i:j]
            i = j
    if held:
        yield held


def _batches(rows, schema: pa.Schema, size: int = 4096):
    """Arrow batches of rows given as tuples."""
    held = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held), schema)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held), schema)], schema=schema)


def _in_pieces(cells: DataFrame) -> DataFrame:
    """Each piece in one partition, in the order of ranks."""
    return cells.repartition(partitions(cells.sparkSession), "grp", "piece").sortWithinPartitions("grp", "piece", "rank")


def _piece() -> Column:
    return F.floor(F.col("rank") / F.lit(FANOUT**LEVELS)).cast("long").alias("piece")


#: Nodes of a table: their group, place in it, the group's number of nodes, digest.
NODE = ["grp", "rank", "n", "node"]


def _up(nodes: DataFrame) -> DataFrame:
    """nodes (grp, rank, n, node) reduced by LEVELS, or to one node a group."""
    schema = pa.schema([("grp", pa.string()), ("rank", pa.int64()), ("n", pa.int64()), ("node", pa.binary())])

    def tops(batches):
        for p in _pieces(batches, ["grp", "piece", "n", "node"]):
            n = p["n"][0]
            levels = min(LEVELS, height(n))
            yield p["grp"][0], p["piece"][0], -(-n // FANOUT**levels), _tree(p["node"], levels)[-1][0]

    return _in_pieces(nodes.select(*NODE, _piece())).mapInArrow(lambda batches: _batches(tops(batches), schema), "grp string, rank long, n long, node binary")


def reduced(nodes: DataFrame, most: int) -> list[DataFrame]:
    """Tables of nodes (grp, rank, n, node), each written: the given ones, then those above, until each group has one. most: nodes of the largest group."""
    tables = [nodes]
    while most > 1:
        tables.append(cut(_up(tables[-1])))
        most = -(-most // FANOUT**LEVELS)
    return tables


#: What a node meets on its way to the top, lowest level first: digests of its siblings one after another, and how many of them stand on its left.
PATH = "array<struct<left:int,others:binary>>"


def _ways(nodes: DataFrame, above: DataFrame, fields: list[str], make, schema: str, arrow: pa.Schema) -> DataFrame:
    """Rows make(piece's columns, number of the node, its path to the top, top) for each node. above: (grp, rank, path, top) of the nodes above, one a piece; it comes first among the piece's rows."""
    cells = nodes.select(*NODE, *fields, _piece())
    heads = above.select("grp", F.col("rank").alias("piece"), F.lit(-1).cast("long").alias("rank"), "path", "top")
    names = ["grp", "piece", "rank", "n", "node", *fields, "path", "top"]

    def rows(batches):
        for p in _pieces(batches, names):
            up = [(s["left"], s["others"]) for s in p["path"][0]]
            levels = _tree(p["node"][1:], min(LEVELS, height(p["n"][1])))[:-1]
            steps = []
            for level in levels:
                cuts = [level[i : i + FANOUT] for i in range(0, len(level), FANOUT)]
                steps.append([(k, b"".join(g[:k] + g[k + 1 :])) for g in cuts for k in range(len(g))])
            for i in range(len(p["node"]) - 1):
                yield make(p, i + 1, [s[i // FANOUT**k] for k, s in enumerate(steps)] + up, p["top"][0])

    both = cells.unionByName(heads, allowMissingColumns=True).select(*names)
    return _in_pieces(both).mapInArrow(lambda batches: _batches(rows(batches), arrow), schema)


def _down(nodes: DataFrame, above: DataFrame) -> DataFrame:
    """(grp, rank, path, top) of nodes."""
    arrow = pa.schema([("grp", pa.string()), ("rank", pa.int64()), ("path", pa.list_(pa.struct([("left", pa.int32()), ("others", pa.binary())]))), ("top", pa.binary())])

    def make(p, i, path, top):
        return p["grp"][i], p["rank"][i], [{"left": k, "others": o} for k, o in path], top

    return cut(_ways(nodes, above, [], make, f"grp string, rank long, path {PATH}, top binary", arrow))


def _down_to_first(tables: list[DataFrame], top: DataFrame) -> DataFrame:
    """(grp, rank, path, top) of the nodes above those of the first table, from those of each group's one node; of these where the first table has no others."""
    for nodes in reversed(tables[1:-1]):
        top = _down(nodes, top)
    return top


def manifest(docs: DataFrame, tampered: Column | None = None, bucket: int = BUCKET) -> DataFrame:
    """A row a document: doc_id, leaf, subroot, root, proof_sha256, folded_root (of the leaf with the tampered text and the original siblings), verified."""
    rows = cut(leaves(docs, tampered))
    long = lambda hexes: F.conv(hexes, 16, 10).cast("long")
    size = rows.groupBy("grp").agg(F.count("*").alias("n")).agg(F.count("*").alias("groups"), F.max("n").alias("most")).first()
    keys = [F.col("doc_id").isNotNull(), F.coalesce("doc_id", F.lit(0)), long(F.substring(F.hex("leaf"), 1, 15)), F.col("row_no")]
    nodes = cut(ranked(rows, keys, ["doc_id", "leaf", "row_no"], bucket).select("grp", "rank", "n", F.col("leaf").alias("node"), "doc_id", "now"))
    tables = reduced(nodes, size.most or 0)
    # The sources' nodes are the leaves of one more tree, whose one group is "".
    names = tables[-1].select(F.lit("").alias("grp"), F.col("grp").alias("name"), "node")
    name = F.rpad(F.hex(F.col("name").cast("binary")), 112, "0")
    subroots = cut(ranked(names, [long(F.substring(name, 1 + 14 * i, 14)) for i in range(8)], ["name"], bucket))
    over = reduced(subroots, size.groups)
    last = over[-1].first()
    root = last.node.hex() if last else ""
    ways = over[-1].select("grp", "rank", F.array().cast(PATH).alias("path"), F.lit(None).cast("binary").alias("top"))
    ways = _down(subroots, _down_to_first(over, ways)) if len(over) > 1 else ways
    tops = subroots.join(ways.select("rank", "path"), "rank").select(F.col("name").alias("grp"), F.lit(0).cast("long").alias("rank"), "path", F.col("node").alias("top"))
    tops = _down_to_first(tables, cut(tops))
    kind = dict(docs.dtypes)["doc_id"]
    id_type = {"bigint": pa.int64(), "int": pa.int32(), "smallint": pa.int16(), "tinyint": pa.int8()}[kind]
    arrow = pa.schema([("doc_id", id_type), *[(c, pa.string()) for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")], ("verified", pa.bool_())])

    def make(p, i, path, top):
        at, said = p["now"][i].hex(), []
        for k, others in path:
            said.append(others.hex())
            at = sha256((said[-1][: 64 * k] + at + said[-1][64 * k :]).encode()).hexdigest()
        return p["doc_id"][i], p["node"][i].hex(), top.hex(), root, sha256("".join(said).encode()).hexdigest(), at, at == root

    return _ways(nodes, tops, ["doc_id", "now"], make, f"doc_id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean", arrow)


def op13_manifest(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    tampered = F.when(crc_mod(F.col("doc_id"), 2) == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    return manifest(docs, tampered)
