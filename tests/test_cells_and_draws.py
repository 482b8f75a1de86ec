"""Interval operators in cells against the same without, and sliding elements against plain Python."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillon.operators import inference, intervals, orders

CELLS = [None, 7, 40, 1000]


def rows(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)


def spans(spark, n, seed, longest=90):
    rnd = random.Random(seed)
    own = [(c, s, s + rnd.randrange(1, longest)) for c, s in ((rnd.choice("ab"), rnd.randrange(600)) for _ in range(n))]
    return spark.createDataFrame(own, "chrom string, start long, end long")


@pytest.mark.parametrize("cell", CELLS[1:])
def test_cells_change_nothing(spark, cell):
    """Pieces are up to 90 wide, so that they span up to thirteen cells of 7."""
    a, b = spans(spark, 60, 1), spans(spark, 40, 2)
    bins = a.select("chrom", (F.floor(F.col("start") / 10) * 10).alias("bin_start")).distinct().withColumn("bin_end", F.col("bin_start") + 10)
    assert rows(intervals.merge(a, cell=cell)) == rows(intervals.merge(a))
    left, right = intervals.merge(a), intervals.merge(b)
    assert rows(intervals.subtract(left, right, cell)) == rows(intervals.subtract(left, right))
    assert rows(intervals.label_bins_sweep(bins, b, cell=cell)) == rows(intervals.label_bins_sweep(bins, b)) == rows(intervals.label_bins(bins, b, width=33))
    assert rows(intervals.as_of(bins, b, cell)) == rows(intervals.as_of(bins, b))
    assert rows(intervals.contiguous_runs(bins, cell=cell)) == rows(intervals.contiguous_runs(bins))
    labelled = bins.withColumn("label", F.col("bin_start") % 70 != 0)
    assert rows(intervals.domains(labelled, cell=cell)) == rows(intervals.domains(labelled))
    centres = intervals.domain_centres(labelled, cell=cell)
    by = {(r["chrom"], r["run"]): r for r in intervals.domains(labelled).collect()}
    found = {(r["chrom"], r["run"]): r["centre"] for r in centres.collect()}
    assert found == {k: r["start"] + 10 * ((r["n_bins"] + 1) // 2 - 1) for k, r in by.items()}


def test_no_window_orders_a_whole_chrom(spark):
    a, b = spans(spark, 60, 1), spans(spark, 40, 2)
    plan = intervals.subtract(a, b, 50)._jdf.queryExecution().optimizedPlan().toString()
    ordered = [line for line in plan.splitlines() if "Window [" in line]
    assert ordered and all("__cell" in line for line in ordered)


def test_overlaps_are_all_pairs_once(spark):
    a, b = spans(spark, 70, 3), spans(spark, 70, 4).withColumn("tag", F.monotonically_increasing_id())
    got = Counter((r["chrom"], r["start"], r["end"], r["r_start"], r["r_end"], r["r_tag"]) for r in intervals.overlaps(a, b, cell=13).collect())
    want = Counter((x["chrom"], x["start"], x["end"], y["start"], y["end"], y["tag"]) for x in a.collect() for y in b.collect() if x["chrom"] == y["chrom"] and x["start"] < y["end"] and x["end"] > y["start"])
    assert got == want


def test_first_window_by_cells(spark):
    windows = spans(spark, 50, 5, 200)
    points = spark.createDataFrame([(i, random.Random(i).choice("abz"), random.Random(i + 9).randrange(800)) for i in range(200)], "id int, chrom string, pos long")
    found = {r["id"]: (r["win_start"], r["win_end"]) for r in intervals.first_containing(points, windows, 20, 32).collect()}
    own = windows.collect()
    want = {}
    for p in points.collect():
        hit = [(w["start"], w["end"]) for w in own if w["chrom"] == p["chrom"] and w["start"] + 20 <= p["pos"] < w["end"] - 20]
        if hit:
            want[p["id"]] = min(hit)
    assert found == want
    plan = intervals.first_containing(points, windows, 20, 32)._jdf.queryExecution().optimizedPlan().toString()
    assert "__at" in next(line for line in plan.splitlines() if "Join Inner" in line)


def test_n_runs_of_many_runs_in_a_piece(spark):
    text = ("ACGT" + "N" * 5 + "n") * 3000
    frame = spark.createDataFrame([("a", 0, text), ("a", len(text), "NNAC"), ("b", 0, "ACGT")], "chrom string, offset long, sequence string")
    got = rows(intervals.n_runs(frame, 6))
    assert len(got) == 3000 and got[0][0] == "a" and max(got, key=lambda r: r[1])[1:] == (29994, 30002)


def plain_null(bins, elements, codes, offsets, draws, n):
    """(draw, concept) to the largest folded area over features, each by all pairs of bins."""
    features = sorted({f for _, f, v in codes if v > 0})
    value = {(i, f): v for i, f, v in codes}
    out = {}
    for d in range(draws):
        for concept in sorted({c for c, *_ in elements}):
            pieces = []
            for c, chrom, s, e in elements:
                if c == concept and (d, chrom) in offsets:
                    low, high, off = offsets[d, chrom]
                    width, at = min(e - s, high - low), low + (s - low + off) % (high - low)
                    pieces += [(chrom, at, min(at + width, high)), (chrom, low, low + at + width - high)]
            pos = {i for i, chrom, a, b in bins if any(chrom == c and s < b and e > a and e > s for c, s, e in pieces)}
            best = 0.5
            if 0 < len(pos) < n:
                for f in features:
                    p, q = [value.get((i, f), 0) for i in pos], [value.get((i, f), 0) for i, *_ in bins if i not in pos]
                    area = sum((x > y) + 0.5 * (x == y) for x in p for y in q) / (len(p) * len(q))
                    best = max(best, area, 1 - area)
            out[d, concept] = best
    return out


def test_sliding_elements_and_their_null(spark):
    rnd = random.Random(11)
    bins = [(i, "ab"[i % 2], i // 2 * 10, i // 2 * 10 + 10) for i in range(40)]
    elements = [("x", "a", 15, 47), ("x", "b", 0, 9), ("y", "a", 180, 200), ("y", "a", 60, 61), ("z", "b", 0, 200), ("z", "a", 0, 200)]
    codes = [(i, f, round(rnd.choice([1.0, 2.0, 3.0, 0.5]), 1)) for i in range(40) for f in range(6) if rnd.random() < (0.3, 0.1, 0.05, 0.6, 0.02, 0.9)[f]]
    own = spark.createDataFrame(bins, "id int, chrom string, bin_start long, bin_end long")
    parts = spark.createDataFrame(elements, "concept string, chrom string, start long, end long")
    fired = spark.createDataFrame(codes, "id int, feature int, value float")
    domains = intervals.concept_domains(own)
    draws = 25
    positives = inference.shifted_positives(own, parts, domains, draws, "s", cell=16)
    found = {(r["draw"], r["concept"]): r["value"] for r in inference.sparse_null(fired, positives, parts.select("concept").distinct(), own, draws).collect()}
    offsets = {(r["draw"], r["chrom"]): (r["low"], r["high"], r["offset"]) for r in inference.shift_offsets(domains, draws, "s").collect()}
    want = plain_null(bins, elements, [(i, f, v) for i, f, v in codes], offsets, draws, len(bins))
    assert found == {k: pytest.approx(v) for k, v in want.items()}
    assert all(v == 0.5 for (_, c), v in found.items() if c == "z")  # no negatives: undefined


def test_dense_null_equals_sparse_where_all_fire(spark):
    rnd = random.Random(12)
    own = spark.createDataFrame([(i, "a", i * 10, i * 10 + 10) for i in range(30)], "id int, chrom string, bin_start long, bin_end long")
    parts = spark.createDataFrame([("x", "a", 30, 110), ("y", "a", 5, 6)], "concept string, chrom string, start long, end long")
    full = spark.createDataFrame([(i, f, 0.1 + rnd.randrange(9)) for i in range(30) for f in range(4)], "id int, feature int, value float")
    positives = inference.shifted_positives(own, parts, intervals.concept_domains(own), 12, "s").persist()
    concepts = parts.select("concept").distinct()
    from quillon.operators.ranks import average_rank

    close = lambda f: sorted((r["draw"], r["concept"], round(r["value"], 9)) for r in f.collect())
    assert close(inference.sparse_null(full, positives, concepts, own, 12)) == close(inference.dense_null(average_rank(full), positives, concepts, own, 12))


def test_scan_equals_plain_windows(spark):
    frame = spans(spark, 80, 9).withColumn("n", F.col("end") - F.col("start")).groupBy("chrom", "start").agg(F.sum("n").alias("n"))
    into = {"a": ("sum", "n"), "b": ("max", "n"), "c": ("sum_before", "n"), "d": ("max_before", "n"), "e": ("lag", "start"), "f": ("lead", "start")}
    whole = rows(intervals.scan(frame, ("chrom",), "start", into))
    assert all(rows(intervals.scan(frame, ("chrom",), "start", into, cell)) == whole for cell in CELLS[1:])
    assert orders.same(frame, frame.select("chrom", F.lit(1).alias("x")).distinct(), ["chrom"]).count() == frame.count()
