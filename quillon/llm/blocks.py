"""Texts in blocks, and tables of hash keys partitioned over buckets.

A block is a few megabytes of whole texts, chosen by hash. What a block
has to say about its keys (n-grams, symbols, windows) goes to the buckets as
sorted, delta-packed arrays, at most one entry for each key and block: a key
that fills a third of the corpus costs its bucket one entry a block. What
the buckets answer comes back to the block in the order in which it asked.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_BYTES = 4 << 20
BUCKET_BLOCKS = 4
#: Bytes of text that a task takes, whatever the session's number of shuffle partitions.
TASK_BYTES = 32 << 20


def plan(docs: DataFrame, text: str, block_bytes: int = BLOCK_BYTES) -> tuple[int, int]:
    """Numbers of blocks and of bucket bits for the whole of the texts."""
    total = docs.agg(F.sum(F.octet_length(F.col(f"`{text}`"))).alias("n")).first()["n"] or 0
    n = max(16, math.ceil(total / block_bytes))
    return n, max(4, math.ceil(math.log2(n / BUCKET_BLOCKS)))


def in_blocks(docs: DataFrame, id: str, text: str, n: int, rest: dict[str, str] | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(__block, __id, __text) and further columns by new names, dealt by block to tasks; null texts as they are."""
    id_, text_ = F.col(f"`{id}`"), F.col(f"`{text}`")
    more = [F.col(f"`{old}`").alias(new) for new, old in (rest or {}).items()]
    blocked = docs.select(F.pmod(F.xxhash64(id_, text_), F.lit(n)).cast("int").alias("__block"), id_.alias("__id"), text_.alias("__text"), *more)
    return dealt(blocked, n, block_bytes)


def dealt(rows: DataFrame, n: int, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Rows in tasks of TASK_BYTES of text: block b in task b modulo their number, so that all have as many blocks.

    Answers dealt alike meet their texts without moving these again.
    """
    return rows.repartitionById(max(1, math.ceil(n * block_bytes / TASK_BYTES)), F.col("__block"))


def pack(values: np.ndarray) -> bytes:
    """Unsigned integers as byte planes, as many as the largest needs."""
    values = np.ascontiguousarray(values, dtype=np.uint64)
    planes = max(1, (int(values.max(initial=0)).bit_length() + 7) // 8)
    return bytes([planes]) + values.view(np.uint8).reshape(-1, 8)[:, :planes].T.tobytes()


def unpack(data: bytes) -> np.ndarray:
    planes = data[0]
    n = (len(data) - 1) // planes
    out = np.zeros((n, 8), dtype=np.uint8)
    out[:, :planes] = np.frombuffer(data, dtype=np.uint8, offset=1).reshape(planes, n).T
    return out.view(np.uint64).reshape(n)


def pack_sorted(values: np.ndarray) -> bytes:
    """Ascending integers, at least one: the first whole, the others as differences."""
    values = np.ascontiguousarray(values, dtype=np.uint64)
    return values[:1].tobytes() + pack(np.diff(values))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(np.concatenate((np.frombuffer(data[:8], dtype=np.uint64), unpack(data[8:]))), dtype=np.uint64)


def bucket_bounds(keys: np.ndarray, bits: int) -> np.ndarray:
    """Where each bucket begins in sorted keys, and the end."""
    return np.searchsorted(keys >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64))
