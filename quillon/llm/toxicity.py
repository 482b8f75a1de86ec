"""Toxicity scores from a factorization machine over hashed terms.

A score is the logistic of w0 + sum of w[i] + sum over pairs of <v[i], v[j]>
for the hashed terms (words, and word beginnings for inflected forms) that a
text contains. The pair part finds texts in which two terms only together
mean something, which no sum of weights can.

The machine is fitted on the driver by AdaGrad, on at most MAX_TRAIN
labelled rows, those whose ids hash lowest: the only bound, and a parameter.
All terms of these rows take part. A term's input is a weight between 0 and 1
instead of presence alone: near 1 where its counts differ between the labels
(chi square) far more than chance has it, or where it is frequent, as such a
term may tell nothing alone and yet do so in pairs; near 0 where neither holds.
The model has a row for each bucket at most, so it is sent to all executors.
Scoring covers all rows and all of their text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.bpe import slices
from quillon.llm.words import term_hashes

BUCKET_BITS = 20
MAX_TRAIN = 12_000
#: Chi square, and share of rows, at which a term's weight is a quarter.
CHI, SHARE = 14.0, 0.05
#: A weight below this is 0: it moves no score by as much as a thousandth of what a telling term does.
LEAST_WEIGHT = 0.001
RANK = 6
EPOCHS = 12
LEAST_STEPS = 500
BATCH = 256
RATE = 0.1
DECAY = 1e-4


@dataclass
class Machine:
    buckets: np.ndarray  # sorted hash buckets, one for each row of w and v
    w0: float
    w: np.ndarray
    v: np.ndarray

    def __post_init__(self) -> None:
        self.slot = np.full(1 << BUCKET_BITS, -1, dtype=np.int32)
        self.slot[self.buckets] = np.arange(len(self.buckets))

    def places(self, text: bytes) -> np.ndarray:
        """Rows of the model for the text's terms, each once."""
        at = self.slot[term_hashes(text) >> np.uint64(64 - BUCKET_BITS)]
        return np.unique(at[at >= 0])

    def score(self, text: bytes) -> float:
        at = self.places(text)
        v = self.v[at]
        total = self.w0 + float(self.w[at].sum()) + 0.5 * float(((v.sum(axis=0) ** 2) - (v**2).sum(axis=0)).sum())
        return float(1 / (1 + np.exp(-np.clip(total, -30, 30))))


def weigh(rows: list[np.ndarray], y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of the rows that have a weight and that not every row has, ascending, and their weights."""
    size, n, k = 1 << BUCKET_BITS, len(y), float(y.sum())
    with_term, toxic = np.zeros(size), np.zeros(size)
    for r, label in zip(rows, y, strict=True):  # a row names a bucket once
        with_term[r] += 1
        toxic[r] += label
    expected = with_term * k / n
    chi = (toxic - expected) ** 2 / np.maximum(expected * (1 - k / n) * (1 - with_term / n), 1e-9)
    share = with_term / n
    weight = np.maximum(chi / (chi + CHI), share / (share + SHARE)) ** 2
    buckets = np.flatnonzero((weight >= LEAST_WEIGHT) & (with_term > 0) & (with_term < n))
    return buckets, weight[buckets].astype(np.float32)


def fit(rows: list[np.ndarray], y: np.ndarray, seed: int = 5) -> Machine:
    """rows: each text's buckets. With one label only, the machine gives that label's share (smoothed)."""
    y = np.asarray(y, dtype=np.float64)
    share = (y.sum() + 0.5) / (len(y) + 1)
    w0 = float(np.log(share / (1 - share)))
    buckets, x = weigh(rows, y) if 0 < y.sum() < len(y) else (np.empty(0, dtype=np.int64), np.empty(0, dtype=np.float32))
    rng = np.random.default_rng(seed)
    w, v = np.zeros(len(buckets), dtype=np.float32), rng.normal(0, 0.01, (len(buckets), RANK)).astype(np.float32)
    model = Machine(buckets, w0, w, v)
    if not len(buckets):
        return model
    places = [at[at >= 0] for at in (model.slot[r] for r in rows)]
    g0, gw, gv = 1e-3, np.full(len(w), 1e-3, dtype=np.float32), np.full(v.shape, 1e-3, dtype=np.float32)
    weight = np.where(y == 1, 0.5 / max(share, 0.05), 0.5 / max(1 - share, 0.05))
    for _ in range(max(EPOCHS, -(-LEAST_STEPS * BATCH // len(y)))):
        order = rng.permutation(len(y))
        for first in range(0, len(order), BATCH):
            own = order[first : first + BATCH]
            doc = np.repeat(np.arange(len(own)), [len(places[i]) for i in own])
            at = np.concatenate([places[i] for i in own])
            xs = x[at]
            vx = v[at] * xs[:, None]
            sums = np.stack([np.bincount(doc, vx[:, f], len(own)) for f in range(RANK)], axis=1)
            square = np.bincount(doc, (vx**2).sum(axis=1), len(own))
            total = w0 + np.bincount(doc, w[at] * xs, len(own)) + 0.5 * ((sums**2).sum(axis=1) - square)
            error = (1 / (1 + np.exp(-np.clip(total, -30, 30))) - y[own]) * weight[own] / len(own)
            e = error[doc] * xs
            used, back = np.unique(at, return_inverse=True)
            dw = np.bincount(back, e, len(used)) + DECAY * w[used]
            dv = np.stack([np.bincount(back, e * (sums[doc, f] - vx[:, f]), len(used)) for f in range(RANK)], axis=1) + DECAY * v[used]
            g0, gw[used], gv[used] = g0 + error.sum() ** 2, gw[used] + dw**2, gv[used] + dv**2
            w0 -= RATE * error.sum() / np.sqrt(g0)
            w[used] -= RATE * dw / np.sqrt(gw[used])
            v[used] -= RATE / 4 * dv / np.sqrt(gv[used])
    # A term's weight is the same in every text: it goes into the model's rows.
    return Machine(buckets, float(w0), (w * x).astype(np.float64), (v * x[:, None]).astype(np.float64))


def held_out(id: Column) -> Column:
    """Rows that never train: crc32 of the id as text, modulo 5, is 0."""
    return F.crc32(id.cast("string").cast("binary")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "toxic", most: int = MAX_TRAIN) -> Machine:
    """Fits on labelled rows that are not held out; null labels and ids don't count.

    A repeated label row counts as often as it stands there, and so does a
    document whose id is repeated; never more than `most` of them are gathered,
    those of lowest hash. Without any labelled row, or on empty tables, the
    machine scores everything 0.5 or less. Texts of any length are read whole;
    what is gathered is a row's set of buckets, of 2^BUCKET_BITS at most.
    """
    rows = labels.select(F.col(f"`{id}`").alias("__id"), F.col(f"`{label}`").cast("int").alias("__y")).where("__id IS NOT NULL AND __y IS NOT NULL").where(~held_out(F.col("__id")))
    chosen = rows.orderBy(F.xxhash64("__id"), "__id", "__y").limit(most)
    texts = docs.select(F.col(f"`{id}`").alias("__id"), F.col(f"`{text}`").alias("__text"))

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, run in slices(batch, "__text"):
                own = [np.unique(term_hashes(t) >> np.uint64(64 - BUCKET_BITS)).astype(np.int32).tobytes() for t in run]
                yield pa.RecordBatch.from_arrays([batch.column("__id").slice(first, len(run)), batch.column("__y").slice(first, len(run)), pa.array(own, pa.binary())], names=["__id", "__y", "__terms"])

    kind = docs.schema[id].dataType.simpleString()
    # At most `most` rows of two numbers: their size is bounded by the parameter.
    own = texts.join(F.broadcast(chosen), "__id").mapInArrow(terms, f"__id {kind}, __y int, __terms binary")
    # Ids may be repeated in docs: a top-n keeps what is gathered within the parameter.
    found = own.orderBy(F.xxhash64("__id"), "__id", "__y", F.xxhash64("__terms")).limit(most).toArrow().combine_chunks().sort_by([("__id", "ascending"), ("__y", "ascending"), ("__terms", "ascending")])
    rows = [np.frombuffer(t.as_buffer(), dtype=np.int32) if t.is_valid and len(t.as_py()) else np.empty(0, dtype=np.int32) for t in found.column("__terms")]
    return fit(rows, found.column("__y").to_numpy().clip(0, 1))


def score(docs: DataFrame, model: Machine, text: str = "text") -> DataFrame:
    """docs (same columns) with score and predicted; null text counts as empty.

    Texts are scored whole, however long. Columns of docs named score or
    predicted are replaced. Equal texts get
    equal scores, ties at 0.5 are predicted 1; an empty table gives an empty one.
    """
    docs = docs.drop("score", "predicted")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + ", score double, predicted int"
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = shared.value
        for batch in batches:
            for first, run in slices(batch, text):
                scores = np.array([use.score(t) for t in run])
                part = batch.slice(first, len(run))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))], names=[*part.schema.names, "score", "predicted"])

    return docs.mapInArrow(work, schema)
