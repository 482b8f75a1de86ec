"""Delta Lloyd, conversation repair and byte-string dedup against plain Python."""

import hashlib
import heapq
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.llm import conversations, lloyd, suffixes

# Lloyd


def plain_lloyd(rows, k, rounds, width):
    kept = [(i, [math.floor(256 * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in kept[:k]]
    for r in range(rounds + 1):
        far = [[sum((x - c) ** 2 for x, c in zip(v, z, strict=True)) for z in centroids] for _, v in kept]
        own = [d.index(min(d)) for d in far]
        if r == rounds:
            break
        for j in range(len(centroids)):
            mine = [v for (_, v), o in zip(kept, own, strict=True) if o == j]
            if mine:
                centroids[j] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    least = [min(d) for d in far]
    per = Counter()
    for o, d in zip(own, least, strict=True):
        per[o] += d
    return sorted(((i, o, d, per[o], sum(least), hashlib.sha256(",".join(map(str, centroids[o])).encode()).hexdigest()) for (i, _), o, d in zip(kept, own, least, strict=True)), key=repr)


def test_lloyd_equals_plain_rounds(spark):
    rnd = random.Random(5)
    rows = [(i, [rnd.choice([-1, 0, 1]) * 2.0 + rnd.gauss(0, 0.4) for _ in range(6)]) for i in range(400)]
    rows += rows[:30]  # repeated rows
    rows += [(1000 + i, rows[7][1]) for i in range(150)]  # one very common vector
    rows += [(None, [0.5] * 6), (2000, None), (2001, []), (2002, [1.0] * 5), (2003, [1.0] * 7), (2004, [None] + [1.0] * 5), (2005, [float("nan")] * 6), (2006, [float("inf")] * 6), (2007, [1e30] * 6), (2008, [-0.001] * 6)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("cluster", F.lit("x")).withColumn("distance", F.lit(1))
    want = plain_lloyd([(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows if i != 2007], 9, 5, 6)
    found = lloyd.cluster(frame.repartition(7), k=9, width=6)
    assert found.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted((tuple(r) for r in found.collect()), key=repr) == want


def test_lloyd_with_few_and_no_vectors(spark):
    kind = "vec_id long, embedding array<float>"
    few = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, [-3.0, 0.0])], kind)
    assert sorted(tuple(r) for r in lloyd.cluster(few, width=2).select("vec_id", "distance").collect()) == [(1, 0), (2, 0), (3, 0)]
    assert lloyd.cluster(few.limit(0), width=2).collect() == []
    assert lloyd.cluster(few, width=3).collect() == []


def test_a_changed_round_equals_a_full_one():
    rng = np.random.default_rng(3)
    for _ in range(40):
        v, c = rng.integers(-4, 5, (60, 3)), rng.integers(-4, 5, (8, 3))
        far = lloyd.distances(v, c)
        owner, least = far.argmin(1), far.min(1)
        changed = np.flatnonzero(rng.random(8) < 0.4)
        if not len(changed):
            continue
        c = c.copy()
        c[changed] = rng.integers(-4, 5, (len(changed), 3))
        got = lloyd.reassign(v, owner, least, c, changed)
        want = lloyd.distances(v, c)
        assert (got[0] == want.argmin(1)).all() and (got[1] == want.min(1)).all()


def test_distances_are_exact_for_large_numbers():
    v = np.array([[1 << 26, -(1 << 26)], [3, 4]])
    c = np.array([[-(1 << 26), 1 << 26], [0, 0]])
    assert lloyd.distances(v, c).tolist() == [[2 * (1 << 27) ** 2, 2 << 52], [(3 + (1 << 26)) ** 2 + ((1 << 26) - 4) ** 2, 25]]


# Conversations

NEXT = {("", "s"): "S", ("", "u"): "U", ("S", "u"): "U", ("U", "a"): "A", ("A", "u"): "U"}
FIT = {"": "u", "S": "u", "U": "a", "A": "u"}
NAMES = {"u": "user", "a": "assistant"}
EMPTY = hashlib.sha256(b"").hexdigest()


def damaged(rows):
    out = []
    for c, t, r, x in rows:
        r, x = " " if r is None else r, " " if x is None else x
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        x = "" if k == 1 else re.sub("[.!?]", "", x) if k == 2 else x
        out += [(c, t, "user" if k == 4 else r, x)] * {0: 0, 3: 2}.get(k, 1)
    return out


def cheapest(rows):
    """Dijkstra over (row, state), by cost and then by letters."""
    if not rows:
        return (0, 0, 0, 0, 0, 0, "", EMPTY)
    faults, seen = [], set()
    for _, r, x in rows:
        ink = re.sub(r"[\x20\x09-\x0D]+", "", x)
        faults.append("blank" if not ink else "duplicate" if (r, x) in seen else "truncated" if ink[-1] not in ".!?" else "")
        seen.add((r, x))
    heap, done = [(0, "", 0, "", ())], set()
    while True:
        cost, audit, i, state, out = heapq.heappop(heap)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == len(rows) and state in ("", "A"):
            break
        fit = FIT[state]
        heapq.heappush(heap, (cost + 3, audit + "I", i, NEXT[state, fit], (*out, f"{NAMES[fit]}:")))
        if i < len(rows):
            _, r, x = rows[i]
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, state, out))
            if faults[i] in ("", "truncated"):
                extra = 3 * (faults[i] == "truncated")
                if (state, r[:1]) in NEXT:
                    heapq.heappush(heap, (cost + extra, audit + "K", i + 1, NEXT[state, r[:1]], (*out, f"{r}:{x}")))
                heapq.heappush(heap, (cost + 3 + extra, audit + "R", i + 1, NEXT[state, fit], (*out, f"{NAMES[fit]}:{x}")))
    turns = [t for t, _, _ in rows if t is not None]
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())


def repaired_plainly(rows):
    per = {c: [] for c, *_ in rows}
    for c, t, r, x in damaged(rows):
        per[c].append((t, r, x))
    for own in per.values():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    return {c: cheapest(own) for c, own in per.items()}


def odd_conversations():
    rnd = random.Random(1)
    rows = []
    for c in [*range(150), None]:
        for i in range(rnd.choice([1, 2, 3, 5, 9, 20])):
            rows.append((c, rnd.choice([None, i, i, i, i, rnd.randrange(9)]), rnd.choice([None, "system", "user", "assistant", "user", "assistant", "tool", "", "x"]), rnd.choice([None, "", "a.", "b", "c!", "d ?", "e\n", "  ", "f. \t", "g.", "h.", "é."])))
    rows += rows[:40]
    rows += [(500, i, "user" if i % 2 else "assistant", f"{i % 70}.") for i in range(700)]  # a conversation with a large share of the rows
    return rows


@pytest.mark.parametrize("batch", [10_000, 3])
def test_repair_equals_dijkstra(spark, batch):
    """Batches of 3 rows make every conversation one of many pieces."""
    rows = odd_conversations()
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("cost", F.lit("x")).withColumn("piece", F.lit(1))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        found = conversations.repair_damaged(frame)
        got = {r["conv_id"]: tuple(r)[1:] for r in found.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256").collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got == repaired_plainly(rows)


def test_repair_of_long_texts_and_of_nothing(spark):
    rows = [(1, 1, "user", "x" * 3_000_000 + "."), (1, 2, "assistant", "y!"), (2, None, None, None)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: (r["cost"], r["audit"], r["repaired_sha256"]) for r in conversations.repair(frame).collect()}
    assert got[1] == (0, "KK", hashlib.sha256(f"user:{'x' * 3_000_000}.\nassistant:y!".encode()).hexdigest())
    assert got[2] == (4, "D", EMPTY)
    assert conversations.repair_damaged(frame.limit(0)).collect() == []


# Bytes


def plain_cut(rows, width):
    texts = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(d[j : j + width] for _, d in texts for j in range(len(d) - width + 1))
    out = []
    for i, d in texts:
        change = np.zeros(len(d) + 1, dtype=int)
        for j in range(len(d) - width + 1):
            if seen[d[j : j + width]] > 1:
                change[j] += 1
                change[j + width] -= 1
        gone = np.cumsum(change[:-1]) > 0
        spans = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        out.append((i, len(d), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(d, np.uint8)[~gone].tobytes()).hexdigest()))
    return sorted(out, key=repr)


def shared_passages():
    rnd = random.Random(3)
    words = lambda n: " ".join("".join(rnd.choice("abcdeé") for _ in range(rnd.randrange(1, 9))) for _ in range(n))
    base = [words(200) for _ in range(6)]
    rows = []
    for i in range(120):
        parts = [words(rnd.randrange(60))]
        for _ in range(rnd.randrange(3)):
            b, x = rnd.choice(base), rnd.randrange(600)
            parts += [b[x : x + rnd.choice([60, 64, 65, 200, 390, 400, 401, 450, 700])], words(rnd.randrange(30))]
        rows.append((i, rnd.choice(["", " "]).join(parts)))
    rows += [(300, "a" * 5000), (301, "a" * 399), (302, "ab" * 1000), (303, None), (304, ""), (305, "a" * 400), (306, "z" * 400), (307, "\n".join(["- item"] * 300))]
    rows += [(None, base[0]), (308, base[0]), (308, base[0]), (309, "é" * 300), (310, "x" * 100 + "é" * 300)]
    near = base[1].split(" ")  # near copies, each with a word of its own
    rows += [(400 + i, " ".join([*near[: 5 * i], f"own{i}", *near[5 * i + 1 :]])) for i in range(30)]
    return rows


@pytest.mark.parametrize("width", [400, 64, 101])
def test_byte_dedup_equals_plain_counts(spark, width):
    rows = shared_passages()
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    found = suffixes.remove_repeated_bytes(frame, into="kept_sha256", width=width, digest=True)
    assert sorted((tuple(r) for r in found.collect()), key=repr) == plain_cut(rows, width)


def test_byte_dedup_returns_bytes_and_other_columns(spark):
    rows = [(1, "q" + "é" * 250, "en", "a"), (2, "z" + "é" * 250, None, "b"), (3, "short", "de", None)]
    frame = spark.createDataFrame(rows, "doc_id int, text string, lang string, n_spans string")
    found = suffixes.remove_repeated_bytes(frame)
    assert found.columns == ["doc_id", "lang", "n_bytes", "n_removed", "n_spans", "kept"]
    got = {r["doc_id"]: (r["lang"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in found.collect()}
    assert got == {1: ("en", 500, 1, b"q"), 2: (None, 500, 1, b"z"), 3: ("de", 0, 0, b"short")}
    assert suffixes.remove_repeated_bytes(frame.limit(0)).collect() == []


def test_windows_of_equal_bytes_have_equal_hashes():
    rng = np.random.default_rng(1)
    data = rng.integers(97, 99, 5000).astype(np.uint8)
    data[3000:3600] = data[100:700]
    at = np.sort(rng.choice(4600, 2000, replace=False))
    for width in (64, 100, 400):
        h = list(zip(*(x.tolist() for x in suffixes.byte_window_hashes(data, at, width)), strict=True))
        by = {}
        for i, x in zip(at.tolist(), h, strict=True):
            by.setdefault(data[i : i + width].tobytes(), set()).add(x)
        assert all(len(x) == 1 for x in by.values()) and len(set(h)) == len(by)
