"""Bit fields: sets of 64-bit numbers that tasks can test, of a size that does not grow with the data.

A field lets through all of its numbers and, by chance, some others, so that an exact join has to
follow. Beyond BITS / 64 numbers it gets fuller and lets through more; results stay the same.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of a field: 64 an entry, and so many at most.
BITS = 1 << 28


def _places(size: int):
    """The two bits of a 64-bit number in a field: of numpy arrays and of columns alike."""
    return lambda x: x & (size - 1), lambda x: (x >> 32) & (size - 1)


def bit_field(df: DataFrame, column: str) -> np.ndarray:
    """Bytes with the bits of all values of a column. Blocks of 8 KB are made by tasks; the driver gets BITS at most."""
    size = 1 << int(min(np.log2(BITS), max(16, np.ceil(np.log2(64 * max(1, df.count()))))))
    c = F.col(column)
    bit = F.explode(F.array(c.bitwiseAND(F.lit(size - 1)), F.shiftright(c, 32).bitwiseAND(F.lit(size - 1)))).alias("bit")

    def block(t: pa.Table) -> pa.Table:
        bits = np.zeros(1 << 16, dtype=np.uint8)
        bits[t.column("bit").to_numpy() & 0xFFFF] = 1
        return pa.table({"block": t.column("block").slice(0, 1), "data": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())})

    rows = df.select(bit).distinct().withColumn("block", F.shiftright("bit", 16)).groupBy("block").applyInArrow(block, "block long, data binary").collect()
    out = np.zeros(size >> 3, dtype=np.uint8)
    for r in rows:
        out[r.block << 13 : (r.block + 1) << 13] = np.frombuffer(r.data, dtype=np.uint8)
    return out


def among(field: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Whether the field has both bits of each number."""
    x = x.view(np.int64)
    ok = np.ones(len(x), dtype=bool)
    for place in _places(len(field) << 3):
        at = place(x)
        ok &= (field[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
    return ok
