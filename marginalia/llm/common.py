"""What the operators share: shared storage, shipping code, hashing and text helpers."""

from __future__ import annotations

import contextlib
import ctypes

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.shipping import ship
from marginalia.storage import materialise, numbered, shared_dir

__all__ = ["materialise", "numbered", "shared_dir", "ship"]  # used by the operators from here

#: Rows of an Arrow batch are cut into pieces of at most so many characters.
PIECE_CHARS = 4_000_000


def hot_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """An equi-join on ``on`` of which a key may hold a large part of the rows.

    An aggregate's exchange on the join key would serve the join too, and adaptive execution does not split such a
    partition. With the hash of the key as a further key both sides get an exchange of the join's own, which it splits.
    """
    both = [d.withColumn("_hot", F.xxhash64(*on)) for d in (left, right)]
    return both[0].join(both[1], [*on, "_hot"], how).drop("_hot")


def text_or_empty(df: DataFrame, text: str = "text"):
    return F.coalesce(F.col(text), F.lit(""))


def pieces(batch: pa.RecordBatch, column: str = "text", chars: int = PIECE_CHARS):
    """Slices of ``batch`` whose texts together stay near ``chars`` bytes (a longer text comes alone)."""
    n = batch.num_rows
    if not n:
        return
    sizes = np.nan_to_num(np.asarray(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False), dtype="float64"))
    begin, total = 0, 0.0
    for i, s in enumerate(sizes):
        if i > begin and total + s > chars:
            yield batch.slice(begin, i - begin)
            begin, total = i, 0.0
        total += s
    yield batch.slice(begin, n - begin)


def trim() -> None:
    """Give freed memory back to the system: a Python worker stays for later tasks, also of other stages."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def mapped(df: DataFrame, spec, schema: str) -> DataFrame:
    """``mapInArrow`` over pieces of bounded size; ``spec(batch) -> RecordBatch | None``."""
    ship(df.sparkSession)

    def run(batches):
        for b in batches:
            for p in pieces(b):
                out = spec(p)
                if out is not None:
                    yield out
        trim()

    return df.mapInArrow(run, schema)


def with_columns(batch: pa.RecordBatch, new: dict[str, pa.Array], drop: tuple[str, ...] = ()) -> pa.RecordBatch:
    """``batch`` without ``drop``, and with ``new`` columns at its end."""
    keep = [n for n in batch.schema.names if n not in drop and n not in new]
    return pa.RecordBatch.from_arrays([batch.column(n) for n in keep] + list(new.values()), names=keep + list(new))


U64 = np.uint64


def mix64(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit integers (multiply and xor-shift rounds)."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(33)
    x *= U64(0xFF51AFD7ED558CCD)
    x ^= x >> U64(33)
    x *= U64(0xC4CEB9FE1A85EC53)
    x ^= x >> U64(33)
    return x


#: A-Z to a-z on bytes; every other byte stays.
LOWER_BYTES = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def texts(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """The UTF-8 bytes of a column's texts; null counts as empty."""
    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]
