"""Repair of conversations whose turns are blank, repeated, cut or out of order.

A repaired conversation has role initials (s?(ua)+)?. Each row is kept, given
another role or deleted, rows are inserted, and the cheapest such edits are
found by dynamic programming over four states: nothing yet, after the system
row, after a user row, after an assistant row.

Rows are sorted by range over (conversation, turn, role, text), so that a
conversation of any length is spread over tasks as pieces. The program needs
one byte a row; pieces send it these, and hashes to find repeated rows. It is
run for many conversations at once, bucketed by length, as a time-major tensor:
one vectorised step a turn for all conversations of a bucket, backwards for
costs and forwards for edits. The edits return to the pieces, which alone hold
the texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import cut_lineage, remove, scratch

KEEP, REROLE, DELETE, INSERT, CUT = 0, 3, 4, 3, 3
#: A row's role initial.
SYSTEM, USER, ASSISTANT, OTHER = range(4)
#: States, and where a row of an initial leads from each of them (-1: nowhere).
START, AFTER_S, AFTER_U, AFTER_A = range(4)
_BY_INITIAL = np.array([[AFTER_S, AFTER_U, -1, -1], [-1, AFTER_U, -1, -1], [-1, -1, AFTER_A, -1], [-1, AFTER_U, -1, -1]])
#: Where an inserted row, or one given the role that fits, leads: to user, but after a user row to assistant.
_FITTING = np.array([AFTER_U, AFTER_U, AFTER_A, AFTER_U])
_NEVER = 1 << 40
#: Rows that one call of the program takes, but for a single longer conversation.
PROGRAM_ROWS = 1 << 17

#: Edits of a plan: kept, deleted, given the role user or assistant, and inserted rows of these roles.
_PLAN = {"keep": ord("K"), "delete": ord("D"), "rerole": np.array([ord("U"), ord("U"), ord("A"), ord("U")], np.uint8), "insert": np.array([ord("u"), ord("u"), ord("a"), ord("u")], np.uint8)}
_AUDIT = bytes.maketrans(b"UAua", b"RRII")
#: Row marks: the initial in two bits, then blank and cut.
_BLANK, _CUT = 4, 8

_INK = r"[^\x20\x09-\x0D]"
_STOP = r"[.!?]"


def damage(rows: DataFrame, id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(id, turn, role, text) with faults set by the CRC-32 of id:turn modulo 20; null roles and texts are one space.

    0 drops a row, 1 empties it, 2 takes its full stops and marks away, 3
    repeats it, 4 makes its role user. Null ids and turns are one space in the
    key, and stay null.
    """
    col = {c: F.col(f"`{c}`") for c in (id, turn, role, text)}
    space = F.lit(" ")
    key = F.concat(F.coalesce(col[id].cast("string"), space), F.lit(":"), F.coalesce(col[turn].cast("string"), space))
    fault = F.crc32(key.cast("binary")) % 20
    body = F.coalesce(col[text], space)
    rows = rows.select(
        col[id].alias(id),
        col[turn].alias(turn),
        F.when(fault == 4, "user").otherwise(F.coalesce(col[role], space)).alias(role),
        F.when(fault == 1, "").when(fault == 2, F.regexp_replace(body, _STOP, "")).otherwise(body).alias(text),
        F.when(fault == 0, 0).when(fault == 3, 2).otherwise(1).alias("__times"),
    )
    return rows.where("__times > 0").withColumn("__times", F.explode(F.sequence(F.lit(1), "__times"))).drop("__times")


def _marks(role: Column, text: Column) -> Column:
    first = F.substring(role, 1, 1)
    initial = F.when(first == "s", SYSTEM).when(first == "u", USER).when(first == "a", ASSISTANT).otherwise(OTHER)
    ink = F.regexp_replace(text, r"[\x20\x09-\x0D]+", "")
    return (initial + F.when(ink == "", _BLANK).otherwise(0) + F.when(~F.substring(ink, -1, 1).rlike(_STOP), _CUT).otherwise(0)).cast("tinyint")


def _runs(values: pa.Array) -> np.ndarray:
    """Where runs of equal values begin, and the end."""
    n = len(values)
    if n < 2:
        return np.array([0, n][: n + 1])
    before, after = values[:-1], values[1:]
    same = pc.fill_null(pc.equal(before, after), False)
    same = pc.or_(same, pc.and_(before.is_null(), after.is_null()))
    return np.concatenate(([0], np.flatnonzero(~same.to_numpy(zero_copy_only=False)) + 1, [n]))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows to pieces: the rows of one conversation within one batch, numbered in order."""
    number = TaskContext.get().partitionId() << 40
    for batch in batches:
        at = _runs(batch.column("id"))
        count = len(at) - 1
        if count < 1:
            continue
        turns = batch.column("turn")
        values = pc.fill_null(turns, 0).to_numpy(zero_copy_only=False).astype("<i8")
        nulls = np.add.reduceat(turns.is_null().to_numpy(zero_copy_only=False).astype(np.int64), at[:-1])
        bytes_of = {"marks": batch.column("marks").to_numpy(zero_copy_only=False).astype("i1"), "h": batch.column("h").to_numpy(zero_copy_only=False).astype("<i8"), "g": batch.column("g").to_numpy(zero_copy_only=False).astype("<i8"), "turns": values}
        cut = {name: pa.array([x[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary()) for name, x in bytes_of.items()}
        offsets = pa.array(at, pa.int32())
        lists = {name: pa.ListArray.from_arrays(offsets, batch.column(name)) for name in ("role", "text")}
        columns = {"id": batch.column("id").take(pa.array(at[:-1])), "piece": pa.array(number + np.arange(count), pa.int64()), "nulls": pa.array(nulls, pa.int64()), **cut, **lists}
        number += count
        yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def costs(initials: np.ndarray, gone: np.ndarray, extra: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The least cost from each turn and state to the end: (turns + 1, conversations, 4), backwards in time.

    initials, gone (rows that have to be deleted) and extra (what a row costs
    that stays) are (turns, conversations); rows from lengths on don't count.
    """
    turns, n = initials.shape
    out = np.empty((turns + 1, n, 4), dtype=np.int64)
    out[turns] = np.array([0, 2 * INSERT, INSERT, 0])
    next_of = _BY_INITIAL.T  # by initial: from each state
    who = np.arange(n)[:, None]
    for t in range(turns - 1, -1, -1):
        after = out[t + 1]
        to = next_of[initials[t]]
        kept = np.where(to >= 0, after[who, to], _NEVER) + extra[t][:, None]
        stay = np.minimum(kept, after[:, _FITTING] + (REROLE + extra[t])[:, None])
        best = np.minimum(np.where(gone[t][:, None], _NEVER, stay), after + DELETE)
        for _ in range(2):  # two inserts lead from any state to any other that is worth it
            best = np.minimum(best, best[:, _FITTING] + INSERT)
        out[t] = np.where((t < lengths)[:, None], best, after)
    return out


def trace(back: np.ndarray, initials: np.ndarray, gone: np.ndarray, extra: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Plans (turns + 1, conversations, 3): up to two inserts before each row, then what happens to it; 0 where nothing.

    Of the cheapest edits those come first whose letters (delete, insert, keep, rerole) do.
    """
    turns, n = initials.shape
    plan = np.zeros((turns + 1, n, 3), dtype=np.uint8)
    state = np.zeros(n, dtype=np.int64)
    who = np.arange(n)
    next_of = _BY_INITIAL.T
    for t in range(turns + 1):
        rows = t < lengths if t < turns else np.zeros(n, dtype=bool)
        here = rows | (t == lengths)
        open_ = here.copy()
        for slot in range(3):
            best = back[t, who, state]
            if t < turns:
                after = back[t + 1]
                drop = open_ & rows & (after[who, state] + DELETE == best)
                plan[t, drop, 2] = _PLAN["delete"]
                open_ &= ~drop
            if slot < 2:
                put = open_ & (back[t, who, _FITTING[state]] + INSERT == best)
                plan[t, put, slot] = _PLAN["insert"][state[put]]
                state = np.where(put, _FITTING[state], state)
                turn_over = open_ & ~put
            else:
                turn_over = open_
            if t < turns:
                best = back[t, who, state]
                to = next_of[initials[t], state]
                keep = turn_over & rows & (to >= 0) & (after[who, np.maximum(to, 0)] + extra[t] == best)
                plan[t, keep, 2] = _PLAN["keep"]
                other = turn_over & rows & ~keep
                plan[t, other, 2] = _PLAN["rerole"][state[other]]
                state = np.where(keep, to, np.where(other, _FITTING[state], state))
            open_ &= ~turn_over
            if not open_.any():
                break
    return plan


class Conversations:
    """Rows of several conversations, one after another: marks, hashes of role and text, and turns."""

    def __init__(self, marks: np.ndarray, h: np.ndarray, g: np.ndarray, turns: np.ndarray, nulls: np.ndarray, lengths: np.ndarray):
        self.lengths = lengths
        self.first = np.cumsum(lengths) - lengths
        of = np.repeat(np.arange(len(lengths)), lengths)
        at = np.arange(len(of))
        self.blank = (marks & _BLANK) > 0
        order = np.lexsort((at, g, h, of))
        again = np.zeros(len(of), dtype=bool)
        again[order[1:]] = (of[order][1:] == of[order][:-1]) & (h[order][1:] == h[order][:-1]) & (g[order][1:] == g[order][:-1])
        self.again = again & ~self.blank
        self.cut = ((marks & _CUT) > 0) & ~self.blank & ~self.again
        self.initial = (marks & 3).astype(np.int64)
        pair = self.initial[:-1] * 4 + self.initial[1:]
        legal = np.isin(pair, [SYSTEM * 4 + USER, USER * 4 + ASSISTANT, ASSISTANT * 4 + USER])
        self.odd = np.append((of[1:] == of[:-1]) & ~legal, False) if len(of) else np.zeros(0, dtype=bool)
        self.gaps = [self._gaps(turns[a + k : a + n]) for a, n, k in zip(self.first.tolist(), lengths.tolist(), nulls.tolist(), strict=True)]

    @staticmethod
    def _gaps(turns: np.ndarray) -> int:
        return int(turns[-1]) - int(turns[0]) + 1 - (1 + int((turns[1:] != turns[:-1]).sum())) if len(turns) else 0

    def count(self, what: np.ndarray) -> list[int]:
        total = np.concatenate(([0], np.cumsum(what)))
        return (total[self.first + self.lengths] - total[self.first]).tolist()

    def repair(self) -> tuple[np.ndarray, list[list[bytes]]]:
        """Costs, and for each conversation the edits of every row, with those before it, and those at the end."""
        cost = np.zeros(len(self.lengths), dtype=np.int64)
        plans: list[list[bytes]] = [[] for _ in self.lengths]
        size = np.maximum(self.lengths, 1)
        bucket = np.ceil(np.log2(size)).astype(np.int64)
        for b in np.unique(bucket):
            members = np.flatnonzero(bucket == b)
            step = max(1, PROGRAM_ROWS >> int(b))
            for i in range(0, len(members), step):
                some = members[i : i + step]
                lengths = self.lengths[some]
                turns = int(lengths.max())
                t = np.arange(turns)[:, None]
                inside = t < lengths
                at = np.where(inside, self.first[some] + t, 0)
                take = lambda x: np.where(inside, x[at], 0)  # noqa: B023, E731
                initials, gone, extra = take(self.initial), take(self.blank | self.again).astype(bool), CUT * take(self.cut)
                back = costs(initials, gone, extra, lengths)
                cost[some] = back[0, :, START]
                plan = trace(back, initials, gone, extra, lengths)
                for j, c in enumerate(some.tolist()):
                    own = plan[: int(lengths[j]) + 1, j]
                    plans[c] = [bytes(r[r > 0]) for r in own]
        return cost, plans


_STATS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _program(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces without texts, sorted by conversation and number: the plan of each, with its conversation's figures."""
    held: list[list] = []  # conversations: lists of pieces
    rows = 0
    last: tuple | None = None
    for batch in batches:
        for r in batch.to_pylist():
            if last is None or last[0] != r["id"]:
                if rows >= PROGRAM_ROWS:
                    yield _solved(held, batch.schema.field("id").type)
                    held, rows = [], 0
                held.append([])
                last = (r["id"],)
            held[-1].append(r)
            rows += len(r["marks"])
        kind = batch.schema.field("id").type
    if held:
        yield _solved(held, kind)


def _solved(held: list[list], kind: pa.DataType) -> pa.RecordBatch:
    pieces = [p for c in held for p in c]
    whole = lambda name, dtype: np.frombuffer(b"".join(p[name] for p in pieces), dtype)
    lengths = np.array([sum(len(p["marks"]) for p in c) for c in held])
    nulls = np.array([sum(p["nulls"] for p in c) for c in held])
    found = Conversations(whole("marks", "i1"), whole("h", "<i8"), whole("g", "<i8"), whole("turns", "<i8"), nulls, lengths)
    cost, plans = found.repair()
    figures = dict(zip(_STATS, [found.gaps, found.count(found.blank), found.count(found.again), found.count(found.cut), found.count(found.odd), cost.tolist()], strict=True))
    out: dict[str, list] = {name: [] for name in ("piece", "n_pieces", "plan", "audit", *_STATS)}
    for i, c in enumerate(held):
        audit = b"".join(plans[i]).translate(_AUDIT).decode()
        at = 0
        for j, p in enumerate(c):
            end = at + len(p["marks"])
            edits = plans[i][at : end + (j == len(c) - 1)]
            at = end
            out["piece"].append(p["piece"])
            out["n_pieces"].append(len(c))
            out["plan"].append(b"".join(edits).decode())
            out["audit"].append(None if j else audit)
            for name in _STATS:
                out[name].append(figures[name][i])
    kinds = {"plan": pa.string(), "audit": pa.string()}
    return pa.RecordBatch.from_arrays([pa.array(x, kinds.get(n, pa.int64())) for n, x in out.items()], list(out))


def repaired(plan: str, roles: list[str], texts: list[str]) -> list[tuple[str, str]]:
    """The rows that a plan makes of a piece."""
    out, at = [], 0
    for edit in plan:
        if edit in "ua":
            out.append(("user" if edit == "u" else "assistant", ""))
            continue
        if edit != "D":
            out.append((roles[at] if edit == "K" else "user" if edit == "U" else "assistant", texts[at]))
        at += 1
    return out


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces with plans: their repaired lines, or the hash of these where the piece is a whole conversation."""
    for batch in batches:
        lines, hashes = [], []
        for plan, roles, texts, n in zip(*(batch.column(c).to_pylist() for c in ("plan", "role", "text", "n_pieces")), strict=True):
            made = [f"{role}:{text}" for role, text in repaired(plan, roles, texts)]
            hashes.append(hashlib.sha256("\n".join(made).encode()).hexdigest() if n == 1 else None)
            lines.append("".join("\n" + x for x in made) if n > 1 else None)
        names = ["id", "piece", "audit", *_STATS]
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(lines, pa.string()), pa.array(hashes, pa.string())], [*names, "lines", "sha"])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces sorted by conversation and number: one row a conversation, its hash made piece by piece."""
    names = ["id", "audit", *_STATS]
    row: dict | None = None
    digest, begun = hashlib.sha256(), False
    for batch in batches:
        done = []
        for r in batch.to_pylist():
            if r["audit"] is not None:  # a conversation's first piece
                if row is not None:
                    done.append({**row, "sha": row["sha"] or digest.hexdigest()})
                row, digest, begun = {c: r[c] for c in (*names, "sha")}, hashlib.sha256(), False
            lines = (r["lines"] or "").encode()
            digest.update(lines if begun else lines[1:])
            begun |= bool(lines)
        schema = pa.schema([batch.schema.field(c) for c in (*names, "sha")])
        yield pa.RecordBatch.from_pylist(done, schema)
    if row is not None:
        yield pa.RecordBatch.from_pylist([{**row, "sha": row["sha"] or digest.hexdigest()}], schema)


def repair(rows: DataFrame, id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row a conversation: id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Rows are taken by turn (null turns first), equal turns by role and text;
    repeated rows stay and count as duplicates. Null roles and texts are one
    space. Null ids are one conversation. A row's first fault counts: blank
    (no word), duplicate (role and text stood earlier), truncated (the last
    character that is no space isn't one of .!?). Roles are told by their first
    letter. Of equally cheap edits those whose letters (D, I, K, R) come first
    are taken. Other columns are left out; an empty table gives an empty result.

    Texts of a conversation are spread over tasks, but its audit is one value
    of a row, so the program holds a conversation's 25 bytes a row in one task,
    and the hash of a conversation of many pieces is made in one task, piece by
    piece.
    """
    spark = rows.sparkSession
    space = F.lit(" ")
    flat = rows.select(F.col(f"`{id}`").alias("id"), F.col(f"`{turn}`").cast("long").alias("turn"), F.coalesce(F.col(f"`{role}`"), space).alias("role"), F.coalesce(F.col(f"`{text}`"), space).alias("text"))
    marked = flat.withColumns({"marks": _marks(F.col("role"), F.col("text")), "h": F.xxhash64("role", "text"), "g": F.xxhash64("text", F.lit(1), "role")})
    key = ["id", "turn", "role", "text"]
    kind = f"id {rows.schema[id].dataType.simpleString()}"
    stats = ", ".join(f"{c} long" for c in _STATS)
    path = scratch(spark, "pieces")
    ordered = marked.repartitionByRange(*key).sortWithinPartitions(*key)
    ordered.mapInArrow(_pieces, f"{kind}, piece long, nulls long, marks binary, h binary, g binary, turns binary, role array<string>, text array<string>").write.parquet(path)
    pieces = spark.read.parquet(path)
    plans = pieces.drop("role", "text").repartition("id").sortWithinPartitions("id", "piece").mapInArrow(_program, f"piece long, n_pieces long, plan string, audit string, {stats}")
    lines = pieces.select("id", "piece", "role", "text").join(plans, "piece").mapInArrow(_lines, f"{kind}, piece long, audit string, {stats}, lines string, sha string")
    done = lines.repartition("id").sortWithinPartitions("id", "piece").mapInArrow(_hashed, f"{kind}, audit string, {stats}, sha string")
    result = cut_lineage(done.select(F.col("id").alias(id), *_STATS, "audit", F.col("sha").alias("repaired_sha256")))
    remove(spark, path)
    return result


def repair_damaged(rows: DataFrame, id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The repair of damage(rows): a row for each conversation of rows, also for those of which no row is left."""
    found = repair(damage(rows, id, turn, role, text), id, turn, role, text)
    all_ids = rows.select(F.col(f"`{id}`").alias("__id")).distinct()
    empty = {"audit": F.lit(""), "repaired_sha256": F.lit(hashlib.sha256(b"").hexdigest())}
    joined = all_ids.join(found, F.col("__id").eqNullSafe(F.col(f"`{id}`")), "left")
    return joined.select(F.col("__id").alias(id), *[F.coalesce(F.col(c), empty.get(c, F.lit(0).cast("long"))).alias(c) for c in found.columns if c != id])
