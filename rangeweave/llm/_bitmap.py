"""A set of 64-bit keys as a bitmap of bounded size in the shared folder.

It only spares work: a key of the set always passes, others pass now and then, and an exact join follows.  However many
keys there are, a worker holds ``MOST_BITS / 8`` bytes at most, and nothing goes through the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import filesystem, written
from ._text import U64, mix

LEAST_BITS, MOST_BITS = 1 << 20, 1 << 29
BLOCK_BITS = 1 << 18


def _places(keys: np.ndarray, bits: int) -> np.ndarray:
    return np.stack([mix(keys, s) & U64(bits - 1) for s in (101, 102, 103)]).astype(np.int64)


def build(keys: DataFrame, column: str) -> str:
    """Write the bitmap of a column of keys; returns its place for ``test``."""
    count = keys.count()
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (16 * count).bit_length()))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 1 << 16):
                at = np.unique(_places(batch.column(0)[i : i + (1 << 16)].to_numpy().view(U64), bits))
                yield pa.RecordBatch.from_arrays([pa.array(at // BLOCK_BITS), pa.array((at % BLOCK_BITS).astype(np.int32))], ["block", "place"])

    def gathered(table: pa.Table) -> pa.Table:
        flags = np.zeros(BLOCK_BITS, bool)
        flags[table.column("place").to_numpy()] = True
        return pa.table({"block": table.column("block")[:1], "bits": pa.array([np.packbits(flags, bitorder="little").tobytes()], pa.binary())})

    rows = keys.select(F.col(column).cast("long")).mapInArrow(spread, "block long, place int").distinct()
    out = written(rows.groupBy("block").applyInArrow(gathered, "block long, bits binary"), f"bitmap-{bits}")
    files = out.inputFiles()
    return files[0].rsplit("/", 1)[0]


@lru_cache(1)
def _load(uri: str) -> tuple[int, np.ndarray]:
    fs, path = filesystem(uri)
    bits = int(uri.rsplit("/", 1)[1].split("-")[1])
    flags = np.zeros(bits // 8, np.uint8)
    t = pq.read_table(path, filesystem=fs, columns=["block", "bits"])
    for b, blob in zip(t.column("block").to_pylist(), t.column("bits")):
        flags[b * BLOCK_BITS // 8 : (b + 1) * BLOCK_BITS // 8] = np.frombuffer(blob.as_buffer(), np.uint8)
    return bits, flags


def test(uri: str, keys: np.ndarray) -> np.ndarray:
    """Which keys may be in the set."""
    bits, flags = _load(uri)
    out = np.ones(len(keys), bool)
    for at in _places(keys, bits):
        out &= (flags[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
    return out
