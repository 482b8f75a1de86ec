"""Sequence and motif operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.scalar import gc_fraction
from quillon.operators.intervals import merge

BASES = ("A", "C", "G", "T")


def sequence_windows(sequences: DataFrame, width: int, step: int) -> DataFrame:
    """(id, start, window) of sequences (id, sequence): whole windows every step bases.

    A sequence is cut in one pass into pieces of a few thousand bases, each
    with what its last windows need of the next, so that no row of a window
    carries the sequence and the work is in proportion to its length.
    """
    size = step * max(1, -(-max(4096, width) // step))
    pieces = F.regexp_extract_all("sequence", F.lit(f"(?s).{{1,{size}}}"), F.lit(0))
    cut = sequences.where(F.length("sequence") >= width).select("id", pieces.alias("p"))
    longer = F.transform("p", lambda x, i: F.struct(F.length(x).alias("n"), F.concat(x, F.coalesce(F.substring(F.get("p", i + 1), 1, width - 1), F.lit(""))).alias("bases")))
    chunks = cut.select("id", F.posexplode(longer).alias("chunk", "c")).select("id", "chunk", "c.*")
    last = F.least(F.col("n") - 1, F.length("bases") - width)
    starts = F.when(last >= 0, F.sequence(F.lit(0), last, F.lit(step)))
    placed = chunks.select("id", "chunk", "bases", F.explode(starts).alias("at"))
    return placed.select("id", (F.col("chunk") * size + F.col("at")).alias("start"), F.substring("bases", F.col("at") + 1, F.lit(width)).alias("window"))


def cpg_windows(sequences: DataFrame, width: int = 200, step: int = 100, least_gc: float = 0.5, least_ratio: float = 0.6) -> DataFrame:
    """Windows rich in C and G with more CG pairs than expected: (id, start, end, gc, ratio)."""
    count = lambda s: F.length("window") - F.length(F.replace("window", F.lit(s), F.lit("")))
    w = sequence_windows(sequences, width, step).select("id", "start", count("C").alias("c"), count("G").alias("g"), (count("CG") / 2).alias("cg"))
    ratio = F.when(F.col("c") * F.col("g") > 0, F.col("cg") * width / (F.col("c") * F.col("g"))).otherwise(0.0)
    scored = w.select("id", "start", (F.col("start") + width).alias("end"), ((F.col("c") + F.col("g")) / F.lit(float(width))).alias("gc"), ratio.alias("ratio"))
    return scored.where((F.col("gc") >= least_gc) & (F.col("ratio") >= least_ratio))


def base_counts(sequences: DataFrame, width: int) -> DataFrame:
    """(pos, base, w): weighted counts of each base at the first width positions of (sequence, weight)."""
    letters = sequences.where(F.length("sequence") >= width).select("weight", F.posexplode(F.split(F.substring("sequence", 1, width), "")).alias("pos", "base"))
    return letters.where(F.col("base").isin(*BASES)).groupBy("pos", "base").agg(F.sum("weight").alias("w"))


def position_weights(counts: DataFrame, pseudocount: float = 0.25) -> DataFrame:
    """(pos, base, p) from (pos, base, w)."""
    every = counts.select("pos").distinct().select("pos", F.explode(F.array(*[F.lit(b) for b in BASES])).alias("base"))
    full = every.join(counts, ["pos", "base"], "left").withColumn("w", F.coalesce("w", F.lit(0.0)) + pseudocount)
    return full.select("pos", "base", (F.col("w") / F.sum("w").over(Window.partitionBy("pos"))).alias("p"))


def information(weights: DataFrame) -> DataFrame:
    """(pos, base, height): p times the position's information in bits."""
    bits = F.greatest(2 + F.sum(F.when(F.col("p") > 0, F.col("p") * F.log2("p"))).over(Window.partitionBy("pos")), F.lit(0.0))
    return weights.select("pos", "base", (F.col("p") * bits).alias("height"))


def log_odds(weights: DataFrame) -> DataFrame:
    """(pos, base, score) against a uniform background."""
    return weights.select("pos", "base", F.log2(F.col("p") / 0.25).alias("score"))


def consensus(weights: DataFrame) -> DataFrame:
    order = Window.partitionBy("pos").orderBy(F.desc("p"), "base")
    best = weights.withColumn("r", F.row_number().over(order)).where("r = 1")
    return best.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "base"))), lambda x: x["base"]), "").alias("consensus"))


#: Hits of a motif that leave a scan together, at most.
HITS = 1 << 14


def _pieces(sequences: DataFrame, width: int, size: int) -> DataFrame:
    """(id, at, bases) of (id, sequence): pieces of size places with what their last windows need of the next."""
    parts = F.regexp_extract_all("sequence", F.lit(f"(?s).{{1,{size}}}"), F.lit(0))
    cut = sequences.where(F.length("sequence") >= width).select("id", parts.alias("p"))
    longer = F.transform("p", lambda x, i: F.concat(x, F.coalesce(F.substring(F.get("p", i + 1), 1, width - 1), F.lit(""))))
    return cut.select("id", F.posexplode(longer).alias("i", "bases")).select("id", (F.col("i").cast("long") * size).alias("at"), "bases")


def scan_motif(sequences: DataFrame, scores: DataFrame, width: int, ratio: float = 0.8, threshold: float | None = None, piece: int = 1 << 16) -> DataFrame:
    """Places of sequences (id, sequence) where either strand scores ratio of the motif's maximum (or threshold) or more.

    Result: id, start, end, strand, score, window. Windows with other letters
    than A, C, G and T score nowhere; letters of either case count. A piece of a
    sequence is a row; its letters become numbers and its places' scores one
    array, position by position of the motif. Places that can't reach the
    threshold with the best of what is left are dropped on the way, and only
    hits leave the scan. A motif is a small table: width rows of four scores.
    """
    table = np.zeros((width, 5))
    for row in scores.collect():  # width * 4 rows
        table[row["pos"], BASES.index(row["base"])] = row["score"]
    most = float(table[:, :4].max(axis=1).sum())
    least = most * ratio if threshold is None else threshold
    flip = table[::-1][:, [3, 2, 1, 0, 4]]
    code = np.full(256, 4, dtype=np.uint8)
    for i, b in enumerate(BASES):
        code[[ord(b), ord(b.lower())]] = i

    def strand(codes: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rest = np.append(np.cumsum(t[::-1, :4].max(axis=1))[::-1][1:], 0.0) + 1e-9
        at = np.arange(len(codes) - width + 1)
        total = np.zeros(len(at))
        for j in range(width):
            letter = codes[at + j]
            total = total + t[j][letter]
            go = (letter < 4) & (total + rest[j] >= least)
            at, total = at[go], total[go]
        hit = total >= least
        return at[hit], total[hit]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, places, texts = batch.column("id"), batch.column("at"), batch.column("bases")
            for i in range(batch.num_rows):  # a piece's hits at a time, whatever the batch holds
                letters = texts[i].as_py().upper()
                if len(letters) < width:
                    continue
                codes = code[np.frombuffer(letters.encode("ascii", "replace"), dtype=np.uint8)]
                for name, t in (("+", table), ("-", flip)):
                    found, value = strand(codes, t)
                    for x in range(0, len(found), HITS):
                        some = found[x : x + HITS]
                        begin = some + places[i].as_py()
                        window = [letters[y : y + width] for y in some.tolist()]
                        columns = [pa.repeat(ids[i], len(some)), pa.array(begin, pa.int64()), pa.array(begin + width), pa.repeat(name, len(some)), pa.array(value[x : x + HITS]), pa.array(window, pa.string())]
                        yield pa.RecordBatch.from_arrays(columns, ["id", "start", "end", "strand", "score", "window"])

    kind = sequences.schema["id"].dataType.simpleString()
    return _pieces(sequences, width, piece).mapInArrow(work, f"id {kind}, start long, end long, strand string, score double, window string")


def in_scan_order(hits: DataFrame) -> DataFrame:
    """Hits by sequence, start, and falling score."""
    return hits.orderBy("id", "start", F.desc("score"), "strand")


def best_hits(hits: DataFrame) -> DataFrame:
    """Each sequence's hit of the largest score, the first of equals (forward strand first)."""
    best = F.max(F.struct("score", (-F.col("start")).alias("s"), (F.col("strand") == "+").alias("plus"), "end", "strand", "window")).alias("h")
    return hits.groupBy("id").agg(best).select("id", (-F.col("h.s")).alias("start"), "h.end", "h.strand", "h.score", "h.window")


def gc_bins(chunks: DataFrame, width: int) -> DataFrame:
    """(chrom, bin_start, gc) of chunks (chrom, start, bases): whole bins of width; gc is null with letters other than A, C, G, T.

    Chunks begin at multiples of width, and all but a chrom's last are of whole bins.
    """
    bins = chunks.select("chrom", "start", F.posexplode(F.regexp_extract_all("bases", F.lit(f"(?s).{{{width}}}"), F.lit(0))).alias("i", "b"))
    return bins.select("chrom", (F.col("start") + F.col("i") * width).cast("long").alias("bin_start"), gc_fraction(F.col("b")).alias("gc"))


def gc_quantile_bins(chunks: DataFrame, width: int, quantile: float, least: int = 10) -> DataFrame:
    """Merged bins (chrom, start, end) of chunks (chrom, start, bases) in the top share of GC of their own chrom.

    The threshold is the exact quantile over a chrom's known bins; chroms with
    fewer than least of them have none. A single histogram row for each value
    of GC (at most width + 1 a chrom) decides it, whatever the chrom's length.
    """
    if not 0 < quantile < 1:
        raise ValueError("quantile has to lie between 0 and 1")
    bins = gc_bins(chunks, width).where("gc IS NOT NULL")
    values = bins.groupBy("chrom", "gc").agg(F.count(F.lit(1)).alias("n"))
    upto = Window.partitionBy("chrom").orderBy("gc")
    ranked = values.withColumns({"upto": F.sum("n").over(upto), "all": F.sum("n").over(Window.partitionBy("chrom"))})
    at = F.lit(quantile) * (F.col("all") - 1)
    of = lambda rank: F.min(F.when(F.col("upto") > rank, F.col("gc")))  # noqa: E731  the value of that rank, from 0
    edges = ranked.groupBy("chrom", "all").agg(of(F.floor(at)).alias("a"), of(F.ceil(at)).alias("b")).where(F.col("all") >= least)
    edges = edges.select("chrom", (F.col("a") + (F.col("b") - F.col("a")) * (at - F.floor(at))).alias("edge"))
    high = bins.join(edges, "chrom").where("gc >= edge")
    return merge(high.select("chrom", F.col("bin_start").alias("start"), (F.col("bin_start") + width).alias("end")), validate=False)
