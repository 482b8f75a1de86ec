"""Comparison of motif matrices as a relation of alignments, against shuffled queries.

A motif is a row with a matrix of positions by A, C, G, T. Flattened by
positions, a shift by one position is a shift by four numbers, and the reverse
complement is the flat array backwards. An alignment is a row (motif, query,
strand, offset); its score is the Pearson correlation of the two overlapping
slices, from six sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LETTERS = 4
LEAST_OVERLAP = 5


def _sums(x: Column, y: Column) -> Column:
    """Sums of x, y, xx, yy and xy over two arrays of one length, in one pass."""
    zero = F.struct(*[F.lit(0.0).alias(c) for c in ("x", "y", "xx", "yy", "xy")])
    pairs = F.zip_with(x, y, lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    add = lambda s, p: F.struct((s["x"] + p["a"]).alias("x"), (s["y"] + p["b"]).alias("y"), (s["xx"] + p["a"] * p["a"]).alias("xx"), (s["yy"] + p["b"] * p["b"]).alias("yy"), (s["xy"] + p["a"] * p["b"]).alias("xy"))
    return F.aggregate(pairs, zero, add)


def correlation(x: Column, y: Column, least_spread: float = 1e-12) -> Column:
    """Pearson's r of two arrays of one length; null where either hardly varies."""
    n, s = F.size(x).cast("double"), _sums(x, y)
    spread = lambda square, total: F.sqrt(F.greatest(square / n - (total / n) * (total / n), F.lit(0.0)))
    a, b = spread(s["xx"], s["x"]), spread(s["yy"], s["y"])
    return F.when((a > least_spread) & (b > least_spread), (s["xy"] / n - (s["x"] / n) * (s["y"] / n)) / (a * b))


def shuffled(query: DataFrame, n: int, seed: str = "motif") -> DataFrame:
    """(draw, flat): the query (matrix) as draw -1, and n times with its positions in a hashed order."""
    draws = F.explode(F.sequence(F.lit(-1), F.lit(n - 1))).alias("draw")
    key = lambda i: F.when(F.col("draw") < 0, i.cast("long")).otherwise(F.xxhash64(F.lit(seed), F.col("draw"), i))
    order = F.array_sort(F.transform("matrix", lambda m, i: F.struct(key(i).alias("k"), i.alias("i"), m.alias("m"))))
    return query.select("matrix", draws).select("draw", F.flatten(F.transform(order, lambda o: o["m"])).alias("flat"))


def alignments(motifs: DataFrame, queries: DataFrame, least: int = LEAST_OVERLAP) -> DataFrame:
    """(matrix_id, draw, strand, offset, score) of motifs (matrix_id, matrix) and queries (draw, flat).

    offset is the query's position against which the motif's first one stands.
    The queries are one matrix and its shuffles: as many small rows as asked
    for, sent to every task; the motifs are never moved.
    """
    strands = F.array(F.struct(F.lit("+").alias("strand"), F.flatten("matrix").alias("y")), F.struct(F.lit("-").alias("strand"), F.reverse(F.flatten("matrix")).alias("y")))
    sides = motifs.select("matrix_id", F.explode(strands).alias("s")).select("matrix_id", "s.strand", "s.y")
    pairs = sides.join(F.broadcast(queries.withColumnRenamed("flat", "x")))
    n, m = F.size("x") / LETTERS, F.size("y") / LETTERS
    offsets = F.when((n >= least) & (m >= least), F.sequence((least - m).cast("int"), (n - least).cast("int")))
    placed = pairs.withColumn("offset", F.explode_outer(offsets))
    low = F.greatest("offset", F.lit(0))
    width = F.least(n, F.col("offset") + m) - low
    part = lambda c, at: F.slice(c, (at * LETTERS + 1).cast("int"), (width * LETTERS).cast("int"))
    score = F.when(width >= least, correlation(part("x", low), part("y", low - F.col("offset"))))
    return placed.select("matrix_id", "draw", "strand", "offset", score.alias("score"))


def match_motifs(motifs: DataFrame, query: DataFrame, n_null: int = 200, seed: str = "motif", top: int | None = 10) -> DataFrame:
    """(matrix_id, score, strand, offset, p, null_p95), best first; at most top rows, all if None.

    A motif's score is its best alignment on either strand, -1 without any. p
    is the share of shuffles whose best motif scores as high, the query itself
    counted in; null_p95 the 95th percentile of these best scores.
    """
    scored = alignments(motifs, shuffled(query, n_null, seed))
    rank = F.struct(F.coalesce("score", F.lit(-1.0)).alias("score"), (F.col("strand") == "+").alias("plus"), (-F.col("offset")).alias("first"))
    best = scored.groupBy("matrix_id", "draw").agg(F.max(rank).alias("b"))
    nulls = best.where("draw >= 0").groupBy("draw").agg(F.max("b.score").alias("null"))
    table = nulls.agg(F.sort_array(F.collect_list("null")).alias("nulls"), F.percentile("null", 0.95).alias("null_p95"))  # n_null numbers
    hits = F.size(F.filter("nulls", lambda x: x >= F.col("score")))
    own = best.where("draw < 0").select("matrix_id", F.col("b.score").alias("score"), F.when(F.col("b.plus"), "+").otherwise("-").alias("strand"), (-F.col("b.first")).alias("offset"))
    found = own.join(F.broadcast(table)).select("matrix_id", "score", "strand", "offset", ((1 + hits) / F.lit(1.0 + n_null)).alias("p"), "null_p95")
    return found if top is None else found.orderBy(F.desc("score"), "matrix_id").limit(top)
