"""Removal of byte strings that occur twice or more, by prefix doubling.

Suffixes are sorted only where they begin at anchors: places that the bytes
around them choose, so that equal strings have them at equal places. Texts fall
into phrases between anchors. A suffix's first rank is that of its first BASE
phrases; then pairs of ranks, that of the run at an anchor and that of the run
beside it, are sorted and ranked again, so that runs double until they are
unique or past the threshold. Unique runs are not sent again. Ranks number the
repeated runs, in the order of their sorted pairs within a bucket.

What the ranks say about the windows of WIDTH bytes that start in one phrase:
* all lie in a run that occurs twice: all of them go;
* a run that all of them hold occurs once: none goes;
* else, at the ends of repeated passages, the windows themselves are sent as
  hashes of 96 bits, once for each different one of a block. So that they meet
  the same windows within longer runs, one phrase of each such run sends its
  windows too, unless all places of what they have in common lie in that run.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.blocks import dealt, in_blocks, pack, pack_sorted, plan, unpack, unpack_sorted
from quillon.llm.common import cut_lineage, remove, scratch
from quillon.llm.words import U, span_hashes, splitmix, window_hashes

WIDTH = 400
#: An anchor's eight bytes hash to one of EVERY, and no such place lies in the APART bytes before it.
EVERY, APART, AHEAD = 12, 8, 8
#: Phrases of a first run.
BASE = 4

_ODD = U(0xD6E8FEB86659FD93)
_MANY = np.iinfo(np.int64).max
#: More phrases than a run that decides has: anchors are APART, and windows below this many phrases of that.
_LONGEST = 1 << 12


def levels(width: int) -> int:
    """How often runs double, the first included, until they hold as many phrases as a window with one on each side can."""
    return max(1, ((width // (APART + 1) + 3) // BASE).bit_length())


def _eight(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each offset, zeros after the end."""
    held = np.zeros(len(data) + 8, dtype=np.uint8)
    held[: len(data)] = data
    return np.ndarray((len(data),), dtype="<u8", buffer=held, strides=(1,))


class Phrases(NamedTuple):
    """Phrases of several texts, end to end; sizes and counts are bytes and phrases of each text."""

    start: np.ndarray
    end: np.ndarray
    stop: np.ndarray  # end of the phrase's text
    counts: np.ndarray


def phrases_of(lengths: np.ndarray, counts: np.ndarray) -> Phrases:
    end = np.cumsum(lengths)
    last = np.cumsum(counts) - 1
    return Phrases(end - lengths, end, np.repeat(end[last], counts) if len(counts) else end, counts)


def parse(data: np.ndarray, sizes: np.ndarray) -> Phrases:
    """Cuts texts (end to end in data) at their anchors."""
    stops = np.cumsum(sizes)
    begins = stops - sizes
    hits = np.flatnonzero(_eight(data) * U(0x9E3779B97F4A7C15) + U(0x632BE59BD9B4E019) < U((1 << 64) // EVERY)) if len(data) else np.zeros(0, dtype=np.int64)
    text = np.searchsorted(stops, hits, side="right")
    whole = hits + AHEAD <= stops[text]
    hits, text = hits[whole], text[whole]
    free = np.ones(len(hits), dtype=bool)
    free[1:] = (np.diff(hits) > APART) | (text[1:] != text[:-1])
    start = np.union1d(begins, hits[free])
    counts = np.diff(np.searchsorted(start, np.append(begins, stops[-1:])))
    return phrases_of(np.diff(np.append(start, stops[-1:])), counts)


class Runs:
    """Which runs of phrases decide on the windows that start in each phrase."""

    def __init__(self, p: Phrases, width: int):
        n = len(p.start)
        self.low, self.high = p.start, np.minimum(p.end - 1, p.stop - width)
        self.some = self.high >= self.low
        self.ended = self.some & (self.high < p.end - 1)  # by the text's end
        # The least run from a phrase that holds all these windows.
        self.outer = np.where(self.some, np.searchsorted(p.end, self.high + width) - np.arange(n) + 1, 0)
        # The largest run between anchors that all of them hold with the bytes that make these anchors.
        self.first = np.searchsorted(p.start, self.high + APART)
        self.inner = np.where(self.some, np.searchsorted(p.start, self.low + width - AHEAD, side="right") - 1 - self.first, 0)
        self.left = np.repeat(np.cumsum(p.counts), p.counts) - np.arange(n)  # phrases from here to the text's end

    def starts(self, j: int) -> np.ndarray:
        """Phrases that begin a run of level j, of BASE << j phrases."""
        return np.flatnonzero(self.left >= (BASE << j))

    def ends_of(self, which: str, j: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Phrases whose outer or inner run is covered by two runs of level j, and where these begin."""
        length = getattr(self, which)
        own = np.flatnonzero(self.some & (length >= BASE << j) & (length < BASE << (j + 1)))
        at = own if which == "outer" else self.first[own]
        return own, at, at + length[own] - (BASE << j)

    def pairs(self, ranks: list[np.ndarray], j: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Phrases from which a run of level j may be repeated, and the ranks of its halves."""
        at = self.starts(j)
        a, b = ranks[j - 1][at], ranks[j - 1][at + (BASE << (j - 1))]
        ok = (a > 0) & (b > 0)
        return at[ok], a[ok], b[ok]

    def outer_pairs(self, ranks: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Phrases whose outer run may be repeated; ranks of its first and last part, the latter with its length and whether the text ended it."""
        found = []
        for j, r in enumerate(ranks):
            own, x, y = self.ends_of("outer", j)
            ok = (r[x] > 0) & (r[y] > 0)
            own, x, y = own[ok], x[ok], y[ok]
            found.append((own, r[x], (r[y] * U(_LONGEST) + self.outer[own].astype(np.uint64)) * U(2) + self.ended[own].astype(np.uint64)))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))  # type: ignore[return-value]

    def common(self, counts: list[np.ndarray]) -> np.ndarray:
        """For each phrase: how often a run occurs that all its windows hold, as far as ranks tell; 0 if it occurs once."""
        out = np.where(self.some, _MANY, 0)
        for j in range(len(counts)):
            own, x, y = self.ends_of("inner", j)
            out[own] = np.minimum(counts[j][x], counts[j][y])
        return out


class Keys:
    """Pairs of numbers, each different one once, dealt to buckets by hash and sorted within."""

    def __init__(self, a: np.ndarray, b: np.ndarray, bits: int):
        bucket = splitmix(a ^ splitmix(b)) >> U(64 - bits)
        order = np.lexsort((b, a, bucket))
        a, b, bucket = a[order], b[order], bucket[order]
        new = np.ones(len(a), dtype=bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        head = np.flatnonzero(new)
        self.inverse = np.empty(len(a), dtype=np.int64)
        self.inverse[order] = np.cumsum(new) - 1
        self.leader = order[head]  # lexsort is stable: the first of those that were given
        self.a, self.b, self.times = a[head], b[head], np.diff(np.append(head, len(a)))
        self.bounds = np.searchsorted(bucket[head], np.arange((1 << bits) + 1, dtype=np.uint64))
        self.used = np.flatnonzero(np.diff(self.bounds))

    def messages(self, block: int) -> pa.Table:
        parts = [slice(self.bounds[i], self.bounds[i + 1]) for i in self.used]
        return pa.table(
            {
                "bucket": pa.array(self.used, pa.int32()),
                "__block": pa.array([block] * len(parts), pa.int32()),
                "a": pa.array([pack_sorted(self.a[p]) for p in parts], pa.binary()),
                "b": pa.array([pack(self.b[p]) for p in parts], pa.binary()),
                "times": pa.array([pack(self.times[p]) for p in parts], pa.binary()),
            }
        )

    def answers(self, table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each pair that was given, 0 if it occurs once: its rank (1 if there are none) and how often it occurs (or 0); whether it leads."""
        rows = {r["bucket"]: r for r in table.select(["bucket", "flags", "ranks", "counts", "leads"]).to_pylist()}
        rank, count = np.zeros(len(self.a), dtype=np.uint64), np.zeros(len(self.a), dtype=np.int64)
        leads = np.zeros(len(self.a), dtype=bool)
        for i in self.used.tolist():
            part, r = slice(self.bounds[i], self.bounds[i + 1]), rows[i]
            bits = lambda x: np.unpackbits(np.frombuffer(x, np.uint8))[: part.stop - part.start].astype(bool)  # noqa: B023, E731
            on = bits(r["flags"])
            rank[part][on] = unpack_sorted(r["ranks"]) if r["ranks"] else U(1)
            count[part][on] = unpack(r["counts"]).astype(np.int64) if r["counts"] else 0
            if r["leads"]:
                leads[part] = bits(r["leads"])
        first = np.zeros(len(self.inverse), dtype=bool)
        first[self.leader] = leads
        return rank[self.inverse], count[self.inverse], first


_MESSAGE = "bucket int, __block int, a binary, b binary, times binary"
_ANSWER = "__block int, bucket int, flags binary, ranks binary, counts binary, leads binary"
#: What blocks want to know of a pair besides whether it occurs twice.
_RANKS, _LEADS, _FLAGS = "ranks", "leads", "flags"


def _rerank(bits: int, want: str) -> Callable[[tuple[pa.Scalar, ...], pa.Table], pa.Table]:
    """Bucket to blocks: which pairs occur twice or more; their ranks in sorted order, or which block leads."""

    def work(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        bucket = key[0].as_py()
        a = [unpack_sorted(x) for x in table.column("a").to_pylist()]
        sizes = [len(x) for x in a]
        block = np.repeat(table.column("__block").to_numpy(), sizes)
        a, b, times = np.concatenate(a), *(np.concatenate([unpack(x) for x in table.column(c).to_pylist()]) for c in ("b", "times"))
        order = np.lexsort((block, b, a))
        new = np.ones(len(a), dtype=bool)
        new[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
        group = np.cumsum(new) - 1
        count = np.add.reduceat(times[order].astype(np.int64), np.flatnonzero(new))
        of = np.empty(len(a), dtype=np.int64)
        of[order] = group
        lead = np.zeros(len(a), dtype=bool)
        lead[order[new]] = True
        rank = (np.cumsum(count > 1) - 1) * (1 << bits) + bucket + 1
        ends = np.cumsum(sizes)
        rows: dict[str, list[bytes]] = {"flags": [], "ranks": [], "counts": [], "leads": []}
        for i, j in zip((ends - sizes).tolist(), ends.tolist(), strict=True):
            on = count[of[i:j]] > 1
            some = of[i:j][on]
            rows["flags"].append(np.packbits(on).tobytes())
            rows["ranks"].append(pack_sorted(rank[some].astype(np.uint64)) if want == _RANKS and len(some) else b"")
            rows["counts"].append(pack(count[some]) if want != _FLAGS else b"")
            rows["leads"].append(np.packbits(lead[i:j]).tobytes() if want == _LEADS else b"")
        return pa.table({"__block": table.column("__block"), "bucket": pa.array([bucket] * len(sizes), pa.int32()), **{c: pa.array(x, pa.binary()) for c, x in rows.items()}})

    return work


class _Block:
    """A block's texts in the order of ids and texts; those long enough for a window, end to end."""

    def __init__(self, table: pa.Table, width: int):
        ids, texts = table.column("__id").to_pylist(), table.column("__text").to_pylist()
        self.order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0, texts[i] or ""))
        self.texts = [(texts[i] or "").encode() for i in self.order]
        self.sizes = np.array([len(t) for t in self.texts], dtype=np.int64)
        self.long = np.flatnonzero(self.sizes >= width)
        self.data = np.frombuffer(b"".join(self.texts[i] for i in self.long.tolist()), dtype=np.uint8)
        self.phrases = parse(self.data, self.sizes[self.long])

    def first_runs(self) -> np.ndarray:
        """Hashes of the BASE phrases from each phrase, as far as there are so many."""
        return window_hashes(span_hashes(self.data, self.phrases.start, self.phrases.end), BASE)


def _first_keys(b: _Block, width: int, bits: int) -> tuple[np.ndarray, Keys]:
    at = Runs(b.phrases, width).starts(0)
    return at, Keys(b.first_runs()[at], np.zeros(len(at), dtype=np.uint64), bits)


def _first(width: int, bits: int):
    def work(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        return _first_keys(_Block(table, width), width, bits)[1].messages(key[0].as_py())

    return work


_STATE = "__block int, lengths binary, counts binary, ranks array<binary>, times array<binary>"


class _State:
    """A block's phrases, and for each level the ranks of the runs that are repeated and how often they occur."""

    def __init__(self, p: Phrases, width: int):
        self.phrases, self.runs = p, Runs(p, width)
        self.ranks: list[np.ndarray] = []
        self.times: list[np.ndarray] = []

    def add(self, at: np.ndarray, ranks: np.ndarray, times: np.ndarray) -> None:
        for held, new, kind in ((self.ranks, ranks, np.uint64), (self.times, times, np.int64)):
            held.append(np.zeros(len(self.phrases.start) + 1, dtype=kind))
            held[-1][at] = new

    def row(self, block: int) -> pa.Table:
        p = self.phrases
        on = [r > 0 for r in self.ranks]
        ranks = [np.packbits(x).tobytes() + pack(r[x]) for x, r in zip(on, self.ranks, strict=True)]
        times = [pack(r[x]) for x, r in zip(on, self.times, strict=True)]
        return pa.table({"__block": pa.array([block], pa.int32()), "lengths": pa.array([pack(p.end - p.start)], pa.binary()), "counts": pa.array([pack(p.counts)], pa.binary()), "ranks": pa.array([ranks], pa.list_(pa.binary())), "times": pa.array([times], pa.list_(pa.binary()))})

    @classmethod
    def of(cls, row: dict, width: int) -> _State:
        s = cls(phrases_of(unpack(row["lengths"]).astype(np.int64), unpack(row["counts"]).astype(np.int64)), width)
        n = len(s.phrases.start) + 1
        for ranks, times in zip(row["ranks"], row["times"], strict=True):
            bits = (n + 7) // 8
            at = np.flatnonzero(np.unpackbits(np.frombuffer(ranks[:bits], np.uint8))[:n])
            s.add(at, unpack(ranks[bits:]), unpack(times).astype(np.int64))
        return s


def _ranked(width: int, bits: int):
    def work(key: tuple[pa.Scalar, ...], table: pa.Table, answers: pa.Table) -> pa.Table:
        b = _Block(table, width)
        at, keys = _first_keys(b, width, bits)
        state = _State(b.phrases, width)
        state.add(at, *keys.answers(answers)[:2])
        return state.row(key[0].as_py())

    return work


def _pairs(width: int, bits: int, level: int | None):
    """Blocks' pairs of ranks to buckets; level None: those of the outer runs."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                s = _State.of(row, width)
                _, a, b = s.runs.outer_pairs(s.ranks) if level is None else s.runs.pairs(s.ranks, level)
                yield from Keys(a, b, bits).messages(row["__block"]).to_batches()

    return work


def _doubled(width: int, bits: int, level: int):
    def work(key: tuple[pa.Scalar, ...], table: pa.Table, answers: pa.Table) -> pa.Table:
        row = table.to_pylist()[0]
        s = _State.of(row, width)
        at, a, b = s.runs.pairs(s.ranks, level)
        s.add(at, *Keys(a, b, bits).answers(answers)[:2])
        return s.row(row["__block"])

    return work


def _decided(width: int, bits: int):
    """A block's phrases whose windows all go, those that the ranks leave open, and those that send their windows."""

    def work(key: tuple[pa.Scalar, ...], table: pa.Table, answers: pa.Table) -> pa.Table:
        row = table.to_pylist()[0]
        s = _State.of(row, width)
        at, a, b = s.runs.outer_pairs(s.ranks)
        _, count, leads = Keys(a, b, bits).answers(answers)
        n = len(s.phrases.start)
        outer, first = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=bool)
        outer[at], first[at] = count, leads
        common, sure = s.runs.common(s.times), outer > 1
        sent = (common > 0) & (~sure | s.runs.ended | (first & (common > outer)))
        return pa.table({"__block": pa.array([row["__block"]], pa.int32()), **{c: pa.array([np.packbits(x).tobytes()], pa.binary()) for c, x in (("sure", sure), ("sent", sent))}})

    return work


def _spread(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """All numbers from low to high, both included, of each pair."""
    n = high - low + 1
    return np.repeat(low - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


def byte_window_hashes(data: np.ndarray, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """64 and 32 bits of the width bytes from each place of at (ascending)."""
    if not len(at):
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.uint64)
    # Only the bytes that some window covers, end to end; windows lie within one stretch.
    edge = np.flatnonzero(np.diff(at) > width)
    low, high = at[np.append(0, edge + 1)], at[np.append(edge, len(at) - 1)] + width - 1
    covered = _spread(low, high)
    x = splitmix(_eight(data[covered]))
    own = np.searchsorted(covered, at)
    out = []
    for seed in (0, 77):
        power, span, held, total = (splitmix(x + U(seed)) if seed else x), 8, 0, None
        while True:
            if (width // 8 * 8) & span:
                part = power[own + held]
                total = part if total is None else splitmix(total * _ODD + part)
                held += span
            if 2 * span > width:
                break
            power = splitmix(power[:-span] * _ODD + power[span:])
            span *= 2
        if width % 8:
            total = splitmix(total * _ODD + x[own + width - 8])
        out.append(total)
    return out[0], out[1] >> U(32)


def _open_keys(b: _Block, flags: dict, width: int, bits: int) -> tuple[np.ndarray, np.ndarray, Keys]:
    """Phrases whose windows all go, the windows that are sent, and their keys."""
    n = len(b.phrases.start)
    of = lambda name: np.flatnonzero(np.unpackbits(np.frombuffer(flags[name], np.uint8))[:n])
    sent = of("sent")
    high = np.minimum(b.phrases.end - 1, b.phrases.stop - width)
    at = _spread(b.phrases.start[sent], high[sent])
    return of("sure"), at, Keys(*byte_window_hashes(b.data, at, width), bits)


def _windows(width: int, bits: int):
    def work(key: tuple[pa.Scalar, ...], table: pa.Table, decided: pa.Table) -> pa.Table:
        return _open_keys(_Block(table, width), decided.to_pylist()[0], width, bits)[2].messages(key[0].as_py())

    return work


def _cut(width: int, bits: int, digest: bool, rest: list[str]):
    """Block to rows: the bytes that no repeated window covers."""

    def work(key: tuple[pa.Scalar, ...], table: pa.Table, answers: pa.Table) -> pa.Table:
        b = _Block(table, width)
        decided = answers.filter(pc.is_valid(answers.column("sure"))).to_pylist()[0]
        sure, at, keys = _open_keys(b, decided, width, bits)
        late = at[keys.answers(answers.filter(pc.is_valid(answers.column("flags"))))[0] > 0]
        high = np.minimum(b.phrases.end - 1, b.phrases.stop - width)
        change = np.zeros(len(b.data) + 1, dtype=np.int32)
        np.add.at(change, b.phrases.start[sure], 1)
        np.add.at(change, high[sure] + width, -1)
        np.add.at(change, late, 1)
        np.add.at(change, late + width, -1)
        gone = np.cumsum(change[:-1]) > 0
        removed, spans = np.zeros(len(b.texts), dtype=np.int64), np.zeros(len(b.texts), dtype=np.int64)
        kept, begin = list(b.texts), 0
        for i in b.long.tolist():
            own = gone[begin : begin + int(b.sizes[i])]
            if own.any():
                removed[i] = own.sum()
                spans[i] = int(own[0]) + int((own[1:] & ~own[:-1]).sum())
                kept[i] = b.data[begin : begin + int(b.sizes[i])][~own].tobytes()
            begin += int(b.sizes[i])
        order = pa.array(b.order, pa.int64())
        columns = {c: table.column(c).take(order) for c in ["__id", *rest]}
        columns |= {"n_bytes": pa.array(b.sizes, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(spans, pa.int64())}
        columns["__out"] = pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string()) if digest else pa.array(kept, pa.binary())
        return pa.table(columns)

    return work


def remove_repeated_bytes(docs: DataFrame, id: str = "doc_id", text: str = "text", into: str = "kept", width: int = WIDTH, digest: bool = False) -> DataFrame:
    """docs without text, with n_bytes, n_removed, n_spans and the kept bytes (digest: their SHA-256).

    Texts are UTF-8 bytes. A byte goes if a string of width bytes that covers it
    starts at another place too, in any row or in the same one; overlapping
    places count, and strings are judged on the input. What is left may end
    within a character, so it is binary. n_spans counts the stretches that went.
    Null texts are empty; texts under width bytes, empty ones included, keep all
    they have. Repeated rows are copies of each other, whatever their ids; ids
    are integers, and null ids stay null. Other columns go through; those of the
    results' names are replaced. A text longer than a block makes its block
    larger. An empty table gives an empty result. width is 64 at least.
    """
    spark = docs.sparkSession
    n_blocks, bits = plan(docs, text)
    made = {"n_bytes", "n_removed", "n_spans", into.lower()}
    others = [f for f in docs.schema.fields if f.name not in (id, text) and f.name.lower() not in made]
    rest = [f"__c{i}" for i in range(len(others))]
    rows = in_blocks(docs.withColumn(id, F.col(f"`{id}`").cast("long")), id, text, n_blocks, {c: f.name for c, f in zip(rest, others, strict=True)})
    blocks = rows.groupBy("__block")
    by_block = lambda df: dealt(df, n_blocks).groupBy("__block")
    ask = lambda messages, want: messages.groupBy("bucket").applyInArrow(_rerank(bits, want), _ANSWER)

    first = ask(blocks.applyInArrow(_first(width, bits), _MESSAGE), _RANKS)
    path = scratch(spark, "ranks")
    blocks.cogroup(by_block(first)).applyInArrow(_ranked(width, bits), _STATE).write.parquet(path)
    for level in range(1, levels(width)):
        state = spark.read.parquet(path)
        answers = ask(state.mapInArrow(_pairs(width, bits, level), _MESSAGE), _RANKS)
        new = scratch(spark, "ranks")
        by_block(state).cogroup(by_block(answers)).applyInArrow(_doubled(width, bits, level), _STATE).write.parquet(new)
        remove(spark, path)
        path = new
    state = spark.read.parquet(path)
    answers = ask(state.mapInArrow(_pairs(width, bits, None), _MESSAGE), _LEADS)
    decided = cut_lineage(by_block(state).cogroup(by_block(answers)).applyInArrow(_decided(width, bits), "__block int, sure binary, sent binary"))
    remove(spark, path)

    windows = ask(blocks.cogroup(by_block(decided)).applyInArrow(_windows(width, bits), _MESSAGE), _FLAGS)
    said = decided.unionByName(windows, allowMissingColumns=True)
    schema = ", ".join(["__id long", *[f"{c} {f.dataType.simpleString()}" for c, f in zip(rest, others, strict=True)], "n_bytes long, n_removed long, n_spans long", f"__out {'string' if digest else 'binary'}"])
    kept = blocks.cogroup(by_block(said)).applyInArrow(_cut(width, bits, digest, rest), schema)
    return kept.select(F.col("__id").cast(docs.schema[id].dataType).alias(id), *[F.col(c).alias(f.name) for c, f in zip(rest, others, strict=True)], "n_bytes", "n_removed", "n_spans", F.col("__out").alias(into))
