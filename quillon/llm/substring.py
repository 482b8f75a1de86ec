"""Removal of word passages that already stand earlier in the corpus.

A passage is a window of WIDTH words. Three plans of the same kind follow one
another in a single job, over texts in blocks (see blocks.py):

1. Recompression names the parts of every text; a bucket says which
   names occur twice or more in the corpus.
2. A window that holds the whole context of a name that occurs once cannot
   occur elsewhere. All others go, as hashes of 96 bits of all their words, to
   buckets that find which have an earlier start: this verifies them.
3. The words that such windows cover leave their texts.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.blocks import bucket_bounds, dealt, in_blocks, pack, pack_sorted, plan, unpack, unpack_sorted
from quillon.llm.recompress import open_windows, rounds
from quillon.llm.words import U, splitmix, window_hashes, window_starts, word_hashes

WIDTH = 20
#: Two leave fewer windows to verify than one, three or four (978,772, 928,306, 1,052,826 and 3,119,343 of 3,826,688 on sf0.1): higher symbols need more context than a window has.
ROUNDS = 2

_NO_ID = np.iinfo(np.int64).max


class _Block:
    """A block's texts in the order of ids (null last) and, for equal ids, of texts."""

    def __init__(self, table: pa.Table):
        ids = table.column("__id").to_pylist()
        texts = table.column("__text").to_pylist()
        order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0, texts[i] or ""))
        self.order = order
        self.ids = np.array([_NO_ID if ids[i] is None else ids[i] for i in order], dtype=np.int64)
        self.texts = [(texts[i] or "").encode() for i in order]
        self.words, self.counts = word_hashes(self.texts)
        self.first = np.cumsum(self.counts) - self.counts

    def windows(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts of the windows within one text, and all windows' hashes."""
        return window_starts(self.counts, width), window_hashes(self.words, width)

    def check(self, width: int, starts: np.ndarray) -> np.ndarray:
        """32 more bits of the words of the windows at starts."""
        return window_hashes(self.words, width, seed=77)[starts] >> U(32)

    def place(self, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Id and start within its text of the windows at starts."""
        doc = np.searchsorted(self.first, starts, side="right") - 1
        return self.ids[doc], starts - self.first[doc]


def _rows(columns: dict[str, tuple[list, pa.DataType]]) -> pa.Table:
    return pa.table({k: pa.array(v, t) for k, (v, t) in columns.items()})


def _names(width: int, n_rounds: int, bits: int):
    """Block to buckets: the names of its symbols, each with whether it occurs twice within."""

    def work(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        b = _Block(table)
        s = rounds(b.words, b.counts, n_rounds)
        names, counts = np.unique(s.name[s.right - s.left <= width], return_counts=True)
        bounds = bucket_bounds(names, bits)
        used = np.flatnonzero(np.diff(bounds))
        parts = [slice(bounds[i], bounds[i + 1]) for i in used]
        return _rows({"bucket": (used.tolist(), pa.int32()), "__block": ([key[0].as_py()] * len(used), pa.int32()), "names": ([pack_sorted(names[p]) for p in parts], pa.binary()), "twice": ([np.packbits(counts[p] > 1).tobytes() for p in parts], pa.binary())})

    return work


def _repeated(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """Bucket to blocks: for each name that a block sent, whether the corpus has it twice."""
    names = [unpack_sorted(x) for x in table.column("names").to_pylist()]
    twice = [np.unpackbits(np.frombuffer(x, np.uint8))[: len(n)] for x, n in zip(table.column("twice").to_pylist(), names, strict=True)]
    _, back = np.unique(np.concatenate(names), return_inverse=True)
    seen = np.bincount(back, weights=1.0 + np.concatenate(twice))[back] > 1
    ends = np.cumsum([len(n) for n in names])
    flags = [np.packbits(x).tobytes() for x in np.split(seen, ends[:-1])]
    return _rows({"__block": (table.column("__block").to_pylist(), pa.int32()), "bucket": ([key[0].as_py()] * len(flags), pa.int32()), "flags": (flags, pa.binary())})


def _candidates(width: int, n_rounds: int, bits: int):
    """Block to buckets: its windows that may stand elsewhere, each with its first place in the block."""

    def work(key: tuple[pa.Scalar, ...], table: pa.Table, answers: pa.Table) -> pa.Table:
        b = _Block(table)
        s = rounds(b.words, b.counts, n_rounds)
        safe = s.right - s.left <= width
        names = np.unique(s.name[safe])
        flags = dict(zip(answers.column("bucket").to_pylist(), answers.column("flags").to_pylist(), strict=True))
        sizes = np.diff(bucket_bounds(names, bits))
        known = [np.unpackbits(np.frombuffer(flags[i], np.uint8))[: sizes[i]] for i in np.flatnonzero(sizes)]
        repeated = np.ones(len(s.name), dtype=bool)
        if len(names):
            repeated[safe] = np.concatenate(known)[np.searchsorted(names, s.name[safe])].astype(bool)
        starts, hashes = b.windows(width)
        starts = open_windows(s, repeated, starts, width)
        keys, first = np.unique(hashes[starts], return_index=True)
        places = starts[first]
        check = b.check(width, places)
        bounds = bucket_bounds(keys, bits)
        used = np.flatnonzero(np.diff(bounds))
        parts = [slice(bounds[i], bounds[i + 1]) for i in used]
        heads = []
        for p in parts:  # the ids and first words of those texts that the part names
            doc, at = np.unique(np.searchsorted(b.first, places[p], side="right") - 1, return_inverse=True)
            heads.append((b.ids[doc].tobytes(), pack(at), pack(places[p] - b.first[doc][at])))
        return _rows(
            {
                "bucket": (used.tolist(), pa.int32()),
                "__block": ([key[0].as_py()] * len(used), pa.int32()),
                "keys": ([pack_sorted(keys[p]) for p in parts], pa.binary()),
                "checks": ([pack(check[p]) for p in parts], pa.binary()),
                "ids": ([h[0] for h in heads], pa.binary()),
                "docs": ([h[1] for h in heads], pa.binary()),
                "starts": ([h[2] for h in heads], pa.binary()),
            }
        )

    return work


def _earlier(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """Bucket to blocks: the places (id, start) of windows that another block has earlier."""
    get = lambda name, f: [f(x) for x in table.column(name).to_pylist()]
    keys = get("keys", unpack_sorted)
    owner = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
    keys, checks = np.concatenate(keys), np.concatenate(get("checks", unpack))
    ids = np.concatenate([np.frombuffer(i, np.int64)[d.astype(np.int64)] for i, d in zip(table.column("ids").to_pylist(), get("docs", unpack), strict=True)])
    starts = np.concatenate(get("starts", unpack)).astype(np.int64)
    order = np.lexsort((starts, ids, checks, keys))
    k, c = keys[order], checks[order]
    new = np.ones(len(k), dtype=bool)
    new[1:] = (k[1:] != k[:-1]) | (c[1:] != c[:-1])
    head = order[np.maximum.accumulate(np.where(new, np.arange(len(k)), 0))]
    late = np.zeros(len(k), dtype=bool)
    late[order] = (ids[head] != ids[order]) | (starts[head] != starts[order])
    blocks = table.column("__block").to_pylist()
    found = [np.flatnonzero(late & (owner == i)) for i in range(len(blocks))] if len(blocks) < 64 else [np.flatnonzero(late[a:b]) + a for a, b in _ranges(owner, len(blocks))]
    keep = [i for i, f in enumerate(found) if len(f)]
    return _rows({"__block": ([blocks[i] for i in keep], pa.int32()), "late_ids": ([ids[found[i]].tobytes() for i in keep], pa.binary()), "late_starts": ([pack(starts[found[i]]) for i in keep], pa.binary())})


def _ranges(owner: np.ndarray, n: int) -> list[tuple[int, int]]:
    bounds = np.searchsorted(owner, np.arange(n + 1))
    return list(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True))


def _covered(b: _Block, answers: pa.Table, width: int) -> np.ndarray:
    """Which words of the block stand in a window with an earlier start."""
    starts, hashes = b.windows(width)
    own = hashes[starts]
    late = np.zeros(len(b.words) + 1, dtype=bool)
    # Later than another window of the same block.
    if len(starts):
        check = b.check(width, starts)
        ids, at = b.place(starts)
        order = np.lexsort((at, ids, check, own))
        new = np.ones(len(order), dtype=bool)
        new[1:] = (own[order][1:] != own[order][:-1]) | (check[order][1:] != check[order][:-1])
        head = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
        late[starts[order]] = (ids[head] != ids[order]) | (at[head] != at[order])
    # Later than a window of another block: places by id and start.
    for ids, at in zip(answers.column("late_ids").to_pylist(), answers.column("late_starts").to_pylist(), strict=True):
        ids, at = np.frombuffer(ids, np.int64), unpack(at).astype(np.int64)
        low, high = np.searchsorted(b.ids, ids), np.searchsorted(b.ids, ids, side="right")
        late[b.first[low] + at] = True
        for i in np.flatnonzero(high - low > 1):  # ids that stand for several rows
            for doc in range(low[i] + 1, high[i]):
                if at[i] < b.counts[doc]:
                    late[b.first[doc] + at[i]] = True
    change = np.zeros(len(b.words) + width + 1, dtype=np.int32)
    at = np.flatnonzero(late)
    change[at] += 1
    change[at + width] -= 1
    return np.cumsum(change)[: len(b.words)] > 0


def _kept(width: int, whole: bool, as_is: bool, rest: list[str]):
    """Block to rows: the texts without the covered words, and the columns rest as they were."""

    def work(key: tuple[pa.Scalar, ...], table: pa.Table, answers: pa.Table) -> pa.Table:
        b = _Block(table)
        covered = _covered(b, answers, width)
        removed, out = [], []
        for text, at, n in zip(b.texts, b.first.tolist(), b.counts.tolist(), strict=True):
            gone = covered[at : at + n]
            k = int(gone.sum())
            if k or not as_is:
                words = text.split()
                kept = b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g] if k else words)
            else:
                kept = text
            removed.append(k)
            out.append(kept.decode() if whole else hashlib.sha256(kept).hexdigest())
        order = pa.array(b.order, pa.int64())
        columns = {c: table.column(c).take(order) for c in ["__id", *rest]}
        columns |= {"n_words": pa.array(b.counts, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "__out": pa.array(out, pa.string())}
        return pa.table(columns)

    return work


def remove_repeats(docs: DataFrame, id: str = "doc_id", text: str = "text", into: str = "kept_text", width: int = WIDTH, n_rounds: int = ROUNDS, digest: bool = False, as_is: bool = False) -> DataFrame:
    """docs without text, with n_words, n_removed and the kept words joined by spaces (digest: their SHA-256).

    as_is: texts that lose nothing stay as they are (null ones become empty).
    Other columns of docs go through; those of the results' names are replaced.

    A word goes if a window of width words that covers it starts earlier
    elsewhere: in a smaller id, or earlier in the same text. Windows are judged
    on the input. Null and empty texts, and texts of fewer than width words,
    keep all they have. The id is an integer; null ids come last. Rows with
    equal ids count as one document: a window at the same start in two of them
    removes nothing. A text longer than a block makes its block larger. An empty
    table gives an empty result.
    """
    n_blocks, bits = plan(docs, text)
    made = {"n_words", "n_removed", into.lower()}
    others = [f for f in docs.schema.fields if f.name not in (id, text) and f.name.lower() not in made]
    rest = [f"__c{i}" for i in range(len(others))]
    rows = in_blocks(docs.withColumn(id, F.col(f"`{id}`").cast("long")), id, text, n_blocks, {c: f.name for c, f in zip(rest, others, strict=True)})
    blocks = rows.groupBy("__block")
    names = blocks.applyInArrow(_names(width, n_rounds, bits), "bucket int, __block int, names binary, twice binary")
    flags = names.groupBy("bucket").applyInArrow(_repeated, "__block int, bucket int, flags binary")
    some = blocks.cogroup(dealt(flags, n_blocks).groupBy("__block")).applyInArrow(_candidates(width, n_rounds, bits), "bucket int, __block int, keys binary, checks binary, ids binary, docs binary, starts binary")
    late = some.groupBy("bucket").applyInArrow(_earlier, "__block int, late_ids binary, late_starts binary")
    schema = ", ".join(["__id long", *[f"{c} {f.dataType.simpleString()}" for c, f in zip(rest, others, strict=True)], "n_words long, n_removed long, __out string"])
    kept = blocks.cogroup(dealt(late, n_blocks).groupBy("__block")).applyInArrow(_kept(width, not digest, as_is, rest), schema)
    return kept.select(F.col("__id").cast(docs.schema[id].dataType).alias(id), *[F.col(c).alias(f.name) for c, f in zip(rest, others, strict=True)], "n_words", "n_removed", F.col("__out").alias(into))
