"""Language-model scores of documents by stupid backoff over the corpus's own n-grams.

One table holds the counts of all orders, partitioned over buckets by the
n-gram's hash. Every block of texts joins it with its n-grams, each once,
and sums the scores of its documents' words:

    S(w | h) = count(h w) / count(h)     if count(h w) is at least min_count
             = backoff * S(w | h')       otherwise, h' being h without its first word

down to count(w) / all words. Near the start of a text, histories are shorter.

Orders 1 and 2 are counted first, then one order after the other: an n-gram
can't reach min_count unless the two that it begins and ends with have
reached it, so only such n-grams are sent. This changes no score.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.blocks import bucket_bounds, dealt, in_blocks, pack, pack_sorted, plan, unpack, unpack_sorted
from quillon.llm.words import window_hashes, window_starts, word_hashes

ORDER = 3
MIN_COUNT = 2
BACKOFF = 0.4
#: Larger blocks repeat more of their n-grams and so send fewer.
BLOCK_BYTES = 8 << 20
#: Where the words of the whole corpus are counted: apart from all n-grams. Keys are 64 bits of hash, whatever the input's size.
TOTAL = -1


class _Block:
    """A block's n-grams; the bucket of order k's key i is numbered (k, i)."""

    def __init__(self, table: pa.Table, order: int, bits: int):
        self.ids = table.column("__id")
        self.words, self.counts = word_hashes([(t or "").encode() for t in table.column("__text").to_pylist()])
        self.order, self.bits = order, bits
        self.grams = [window_hashes(self.words, k) for k in range(1, order + 1)]  # by start, across texts too
        self.starts = [window_starts(self.counts, k) for k in range(1, order + 1)]
        self.found = [np.zeros(len(g)) for g in self.grams]  # corpus counts by start, as far as they are known

    def asked(self, k: int, min_count: int) -> np.ndarray:
        """Starts of the n-grams of order k that the corpus may have min_count times or more."""
        at = self.starts[k - 1]
        if k < 3:
            return at
        below = self.found[k - 2]
        return at[(below[at] >= min_count) & (below[at + 1] >= min_count)]

    def learn(self, answers: pa.Table, orders: list[int], min_count: int) -> None:
        """Fills found for these orders from the buckets' answers."""
        own = {(k, i): t for k, i, t in zip(*(answers.column(c).to_pylist() for c in ("gram", "bucket", "totals")), strict=True)}
        for k in orders:
            at = self.asked(k, min_count)
            keys, back = np.unique(self.grams[k - 1][at], return_inverse=True)
            if len(keys):
                used = np.flatnonzero(np.diff(bucket_bounds(keys, self.bits)))
                self.found[k - 1][at] = np.concatenate([unpack(zlib.decompress(own[k, i])) for i in used])[back]
        self.total = float(unpack(zlib.decompress(own[0, TOTAL]))[0]) if (0, TOTAL) in own else 0.0


_ASK = "gram int, bucket int, __block int, grams binary, counts binary"
_ANSWER = "__block int, gram int, bucket int, totals binary"


def _ask(order: int, bits: int, min_count: int, orders: list[int]):
    """Block to buckets: its n-grams of these orders, each once, with counts."""

    def work(key: tuple[pa.Scalar, ...], table: pa.Table, answers: pa.Table | None = None) -> pa.Table:
        b = _Block(table, order, bits)
        if answers is not None:
            b.learn(answers, list(range(1, orders[0])), min_count)
        rows = [] if answers is not None else [(0, TOTAL, pack_sorted(np.ones(1)), np.array([len(b.words)]))]
        for k in orders:
            keys, counts = np.unique(b.grams[k - 1][b.asked(k, min_count)], return_counts=True)
            bounds = bucket_bounds(keys, bits)
            rows += [(k, i, pack_sorted(keys[bounds[i] : bounds[i + 1]]), counts[bounds[i] : bounds[i + 1]]) for i in np.flatnonzero(np.diff(bounds)).tolist()]
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
        columns = zip(*[(k, i, key[0].as_py(), grams, zlib.compress(pack(n), 6)) for k, i, grams, n in rows], strict=True) if rows else [[]] * 5
        return pa.table({c.split()[0]: pa.array(v, t) for c, v, t in zip(_ASK.split(", "), columns, kinds, strict=True)})

    return work if orders[0] > 1 else lambda key, table: work(key, table)


def _count(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """A bucket of the count table, joined back to the blocks that asked."""
    grams = [unpack_sorted(x) for x in table.column("grams").to_pylist()]
    counts = [unpack(zlib.decompress(x)) for x in table.column("counts").to_pylist()]
    _, back = np.unique(np.concatenate(grams), return_inverse=True)
    total = np.bincount(back, weights=np.concatenate(counts).astype(np.float64)).astype(np.uint64)[back]
    parts = np.split(total, np.cumsum([len(g) for g in grams])[:-1])
    return pa.table({"__block": table.column("__block"), "gram": table.column("gram"), "bucket": table.column("bucket"), "totals": pa.array([zlib.compress(pack(p), 6) for p in parts], pa.binary())})


def log_scores(b: _Block, counts: list[np.ndarray], total: float, min_count: int, backoff: float) -> np.ndarray:
    """Log score of every word of the block; counts: of each order's n-grams, by start."""
    n = len(b.words)
    at = np.arange(n)
    first = np.repeat(np.cumsum(b.counts) - b.counts, b.counts)
    score = np.log(counts[0] / total)  # order 1
    for k in range(2, b.order + 1):
        start = at - (k - 1)
        has = np.flatnonzero(start >= first)
        c = counts[k - 1][start[has]]
        context = counts[k - 2][start[has]]
        score[has] = np.where(c >= min_count, np.log(np.maximum(c, 1) / np.maximum(context, 1)), score[has] + np.log(backoff))
    return score


def _score(order: int, bits: int, min_count: int, backoff: float):
    def work(key: tuple[pa.Scalar, ...], table: pa.Table, answers: pa.Table) -> pa.Table:
        b = _Block(table, order, bits)
        b.learn(answers, list(range(1, order + 1)), min_count)
        scores = log_scores(b, b.found, b.total, min_count, backoff) if len(b.words) else np.empty(0)
        doc = np.repeat(np.arange(len(b.counts)), b.counts)
        sums = np.bincount(doc, scores, len(b.counts))
        return pa.table({"__id": b.ids, "n_words": pa.array(b.counts, pa.int64()), "log_score": pa.array(sums, pa.float64())})

    return work


def score(docs: DataFrame, id: str = "doc_id", text: str = "text", order: int = ORDER, min_count: int = MIN_COUNT, backoff: float = BACKOFF) -> DataFrame:
    """Per row: id, n_words, log_score (natural log, summed) and mean_log_score.

    Null and empty texts have log_score 0 and a null mean. Repeated rows count
    in the tables as often as they stand there and get equal scores. Ids of
    any type, null too, go through as they are; other columns of docs, whatever
    their names, don't. A text longer than a block makes its block larger. An
    empty table gives an empty result.
    """
    n_blocks, bits = plan(docs, text, BLOCK_BYTES)
    bits += 2  # a block has more n-grams than windows or names: smaller buckets
    blocks = in_blocks(docs, id, text, n_blocks, block_bytes=BLOCK_BYTES).groupBy("__block")
    count = lambda asked: asked.groupBy("gram", "bucket").applyInArrow(_count, _ANSWER)
    known = count(blocks.applyInArrow(_ask(order, bits, min_count, list(range(1, min(order, 2) + 1))), _ASK))
    for k in range(3, order + 1):
        asked = blocks.cogroup(dealt(known, n_blocks, BLOCK_BYTES).groupBy("__block")).applyInArrow(_ask(order, bits, min_count, [k]), _ASK)
        known = known.union(count(asked))
    kind = docs.schema[id].dataType.simpleString()
    scored = blocks.cogroup(dealt(known, n_blocks, BLOCK_BYTES).groupBy("__block")).applyInArrow(_score(order, bits, min_count, backoff), f"__id {kind}, n_words long, log_score double")
    return scored.select(F.col("__id").alias(id), "n_words", "log_score", F.when(F.col("n_words") > 0, F.col("log_score") / F.col("n_words")).alias("mean_log_score"))
