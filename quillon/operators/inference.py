"""Permutation nulls, false-discovery control and paired statistics."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.scalar import directed, draw
from quillon.operators.intervals import circular_shift, merge, overlaps
from quillon.operators.orders import before, numbered, same, tied_ranks
from quillon.operators.ranks import average_rank


def empirical_p(observed: DataFrame, null: DataFrame, on: str) -> DataFrame:
    """observed (on, value) with p = (1 + draws of null (on, value) at or above) / (1 + draws)."""
    n = null.select(F.col(on), F.col("value").alias("__null"))
    joined = observed.join(n, on, "left")
    above = F.sum(F.when(F.col("__null") >= F.col("value"), 1).otherwise(0))
    return joined.groupBy(on, "value").agg(((1 + above) / (1.0 + F.count("__null"))).alias("p"))


def benjamini_hochberg(tests: DataFrame, q: float = 0.05, family: str | None = None) -> DataFrame:
    """tests (id, p, ...) with rank and significant; equal p in the order of id.

    family: a column; the tests of each of its values are ranked and counted
    apart. Null p are no tests: their rank is null, and they aren't significant.
    The tests are persisted, as they are read several times.
    """
    tests = tests.persist()
    keys = (family,) if family else ()
    known = tests.where("p IS NOT NULL")
    counts = before(known.groupBy(*keys, "p").agg(F.count(F.lit(1)).alias("__n")), keys, "p", {"__b": ("sum", "__n")})
    sizes = known.groupBy(*keys).agg(F.count(F.lit(1)).alias("__m"))
    upto = F.col("__b") + F.col("__n")
    last = same(counts, sizes, list(keys)).groupBy(*keys).agg(F.max(F.when(F.col("p") <= F.lit(q) * upto / F.col("__m").cast("double"), upto)).alias("__last"))
    tied = same(same(tests, counts.drop("__n"), [*keys, "p"], "left"), last, list(keys), "left") if keys else same(tests, counts.drop("__n"), ["p"], "left").join(last, F.lit(True), "left")
    within = Window.partitionBy(*keys, "p").orderBy("id")
    rank = F.when(F.col("p").isNotNull(), F.col("__b").cast("int") + F.row_number().over(within))
    return tied.withColumn("rank", rank).withColumn("significant", F.coalesce(F.col("rank") <= F.col("__last"), F.lit(False))).drop("__b", "__last")


def hashed_offsets(runs: DataFrame, draws: int, seed: str) -> DataFrame:
    """(draw, run, n, offset): for each draw an offset within each run (run, n)."""
    each = runs.select("run", "n", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw"))
    return each.withColumn("offset", F.pmod(draw(F.lit(seed), F.col("draw"), F.col("run")), F.col("n")))


def roll_labels(labels: DataFrame, offsets: DataFrame) -> DataFrame:
    """labels (run, i, id, concept, y) turned within their run by every draw's offset: (draw, id, concept, y)."""
    places = labels.select("run", "i", "id").distinct()
    turned = places.join(offsets, "run").select("draw", "run", "id", F.pmod(F.col("i") - F.col("offset"), F.col("n")).alias("i"))
    return turned.join(labels.select("run", "i", "concept", "y"), ["run", "i"]).select("draw", "id", "concept", "y")


def rolled_positives(labels: DataFrame, places: DataFrame, offsets: DataFrame) -> DataFrame:
    """(draw, concept, id) of the positives of roll_labels alone: labels (run, i, concept, y), places (run, i, id)."""
    moved = labels.where("y = 1").select("run", "i", "concept").join(offsets, "run")
    return moved.select("draw", "concept", "run", F.pmod(F.col("i") + F.col("offset"), F.col("n")).alias("i")).join(places.select("run", "i", "id"), ["run", "i"]).select("draw", "concept", "id")


def shift_offsets(domains: DataFrame, draws: int, seed: str) -> DataFrame:
    """(draw, chrom, low, high, offset): for each draw how far the elements of each domain (chrom, low, high) slide."""
    each = domains.where("high > low").select("chrom", "low", "high", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw"))
    return each.withColumn("offset", F.pmod(draw(F.lit(seed), F.col("draw"), F.col("chrom"), F.col("low")), F.col("high") - F.col("low")))


#: Parts of a domain whose elements are moved by tasks of their own.
_SPREAD = 16


def _arcs(elements: DataFrame, domains: DataFrame) -> DataFrame:
    """(chrom, low, high, concept, start, end, gap): what elements cover of each domain, as a circle, in disjoint parts.

    gap is the way back to the end of the part before, round the domain's ends for the first one.
    """
    own = overlaps(domains.select("chrom", F.col("low").alias("start"), F.col("high").alias("end")), elements.select("chrom", "start", "end", "concept"))
    spans = own.select("chrom", F.col("start").alias("low"), F.col("end").alias("high"), F.col("r_start").alias("start"), F.col("r_end").alias("end"), F.col("r_concept").alias("concept"))
    keys = ("chrom", "low", "high", "concept")
    parts = merge(circular_shift(spans.withColumn("offset", F.lit(0).cast("long"))).drop("offset"), keys, validate=False)
    each = Window.partitionBy(*keys)
    last = F.lag("end").over(each.orderBy("start"))
    return parts.withColumn("gap", F.col("start") - F.coalesce(last, F.col("low") - F.col("high") + F.max("end").over(each)))


def _moved(arcs: DataFrame, domains: DataFrame, draws: int, seed: str) -> DataFrame:
    """(draw, concept, chrom, low, start, end, before): arcs moved in every draw, and where what comes before in the domain ends.

    A row becomes draws rows here, so the number of tasks is given: by the size of its input it would be one.
    """
    tasks = int(arcs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    offset = F.transform(F.sequence(F.lit(0), F.lit(draws - 1)), lambda d: F.pmod(draw(F.lit(seed), d, F.col("chrom"), F.col("low")), F.col("high") - F.col("low")))
    offsets = domains.where("high > low").select("chrom", "low", offset.alias("offsets"), F.explode(F.sequence(F.lit(0), F.lit(_SPREAD - 1))).alias("__part"))
    dealt = arcs.withColumn("__part", F.pmod(F.hash("concept", "start"), F.lit(_SPREAD))).repartition(tasks, "chrom", "low", "__part")
    each = dealt.join(offsets, ["chrom", "low", "__part"]).select("chrom", "low", "high", "concept", "start", "end", "gap", F.posexplode("offsets").alias("draw", "offset"))
    first = F.col("start") - F.col("low") + F.col("offset")
    begin = F.col("low") + F.pmod(first, F.col("high") - F.col("low"))
    moved = circular_shift(each.withColumn("before", begin - F.col("gap")))
    # A wrapped end comes first in its domain; a whole that begins at low does too, as nothing ends between.
    return moved.select("draw", "concept", "chrom", "low", "start", "end", F.when(F.col("start") == F.col("low"), F.col("low")).otherwise(F.col("before")).alias("before"))


def shifted_positives(bins: DataFrame, elements: DataFrame, domains: DataFrame, draws: int, seed: str, cell: int = 1 << 10) -> DataFrame:
    """(draw, concept, id): bins (id, chrom, bin_start, bin_end) that a draw's elements (concept, chrom, start, end) overlap.

    In a draw all elements of a domain slide by one offset and wrap at its ends,
    so that their number, lengths and distances stay. All draws are labelled by
    one join on (chrom, cell). Of the elements that overlap a bin the first one
    gives the row, so that rows are not compared to be distinct, except for bins
    of several domains. Further columns of bins, which its id determines, are kept.
    """
    kept = [c for c in bins.columns if c not in ("id", "chrom", "bin_start", "bin_end")]
    whole = domains.where("high > low").select("chrom", F.col("low").alias("start"), F.col("high").alias("end"))
    met = overlaps(whole, bins.select("id", "chrom", F.col("bin_start").alias("start"), F.col("bin_end").alias("end"), *kept))
    inside = met.select("chrom", F.col("start").alias("low"), F.greatest("start", "r_start").alias("start"), F.least("end", "r_end").alias("end"), F.col("r_id").alias("id"), *[F.col(f"r_{c}").alias(c) for c in kept])
    marked = inside.withColumn("shared", F.count(F.lit(1)).over(Window.partitionBy("id")) > 1)
    moved = _moved(_arcs(elements, domains), domains, draws, seed)

    def found(rows: DataFrame) -> DataFrame:  # the bins are few beside the moved elements, which are not ordered
        pairs = overlaps(moved, rows.hint("shuffle_hash"), ("chrom", "low"), cell).where("r_start >= before")
        return pairs.select("draw", "concept", F.col("r_id").alias("id"), *[F.col(f"r_{c}").alias(c) for c in kept])

    return found(marked.where(~F.col("shared"))).union(found(marked.where("shared")).dropDuplicates(["draw", "concept", "id"]))


def _every_draw(concepts: DataFrame, draws: int) -> DataFrame:
    return concepts.select("concept", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw"))


def _sparse_null(codes: DataFrame, sums: DataFrame, concepts: DataFrame, bins: DataFrame, draws: int) -> DataFrame:
    """sparse_null of sums (draw, concept, feature, a, rs): a draw's positives that fire and their ranks' sum, and a row without feature and rs for all positives."""
    sizes = codes.where("value > 0").groupBy("feature").agg(F.count(F.lit(1)).alias("m"))
    falling = before(sizes.groupBy((-F.col("m")).alias("__f")).agg(F.count(F.lit(1)).alias("__n")), (), "__f", {"__b": ("sum", "__n")})
    at = F.col("__b") + F.row_number().over(Window.partitionBy("m").orderBy("feature"))
    placed = sizes.join(falling, -F.col("m") == F.col("__f")).select("feature", "m", at.alias("place"))
    total = bins.agg(F.count(F.lit(1)).alias("__all"))
    each = Window.partitionBy("draw", "concept")
    own = sums.join(placed, "feature", "left").join(total, F.lit(True))
    own = own.withColumn("p", F.max(F.when(F.col("feature").isNull(), F.col("a"))).over(each)).where("p < __all")
    own = own.withColumn("q", (F.col("__all") - F.col("p")).cast("double")).withColumn("__i", F.row_number().over(each.orderBy(F.col("place").asc_nulls_last())))
    a, b, p, q = F.col("a"), F.col("m") - F.col("a"), F.col("p"), F.col("q")
    wins = a * (q - b) + 0.5 * (p - a) * (q - b) + F.col("rs") - a * (a + 1) / 2
    scored = own.groupBy("draw", "concept").agg(F.max("q").alias("q"), F.max(directed(wins / (p * q))).alias("__v"), F.count_if(F.col("place") == F.col("__i")).alias("__first"))
    rest = scored.withColumn("place", F.col("__first") + 1).join(placed.select("place", "m"), "place", "left")
    value = rest.select("draw", "concept", F.greatest("__v", F.lit(0.5) + F.col("m") / (2 * F.col("q")), F.lit(0.5)).alias("value"))
    return _every_draw(concepts, draws).join(value, ["draw", "concept"], "left").withColumn("value", F.coalesce("value", F.lit(0.5)))


def sparse_null(codes: DataFrame, positives: DataFrame, concepts: DataFrame, bins: DataFrame, draws: int) -> DataFrame:
    """(draw, concept, value): the largest folded area over all features that fire, for each draw's positives (draw, concept, id).

    codes (id, feature, value) are ranked once for all draws, and only bins that
    are positive in a draw meet them. A feature that fires on none of them has
    the area 1/2 + m / 2n, of m bins on which it fires and n negatives: of these
    the one with the largest m counts, the first in the order of m that the
    draw's features leave out. A draw without both classes is worth 1/2.
    """
    ranked = average_rank(codes.where("value > 0")).select("id", "feature", "rk")
    count = F.count(F.lit(1)).cast("double").alias("a")
    hits = positives.join(ranked, "id").groupBy("draw", "concept", "feature").agg(count, F.sum("rk").alias("rs"))
    n = positives.groupBy("draw", "concept").agg(count)
    return _sparse_null(codes, hits.unionByName(n, allowMissingColumns=True), concepts, bins, draws)


def shifted_sparse_null(codes: DataFrame, bins: DataFrame, elements: DataFrame, domains: DataFrame, draws: int, seed: str, cell: int = 1 << 10) -> DataFrame:
    """sparse_null of shifted_positives, for the concepts of elements.

    Bins take their codes' ranks along, so that the positives of all draws
    become sums where they are found; no row of a bin and draw is shuffled.
    """
    ranked = average_rank(codes.where("value > 0")).groupBy("id").agg(F.collect_list(F.struct("feature", "rk")).alias("fired"))
    own = bins.select("id", "chrom", "bin_start", "bin_end").join(ranked, "id", "left")
    itself = F.struct(F.lit(None).cast(codes.schema["feature"].dataType).alias("feature"), F.lit(None).cast("double").alias("rk"))
    fired = F.explode(F.when(F.col("fired").isNull(), F.array(itself)).otherwise(F.concat(F.array(itself), F.col("fired"))))
    positives = shifted_positives(own, elements, domains, draws, seed, cell)
    sums = positives.select("draw", "concept", fired.alias("f")).groupBy("draw", "concept", F.col("f.feature").alias("feature")).agg(F.count(F.lit(1)).cast("double").alias("a"), F.sum("f.rk").alias("rs"))
    return _sparse_null(codes, sums, elements.select("concept").distinct(), bins, draws)


def dense_null(ranked: DataFrame, positives: DataFrame, concepts: DataFrame, bins: DataFrame, draws: int) -> DataFrame:
    """As sparse_null, of ranks (id, feature, rk) that every bin has for every feature; these too are made once."""
    total = bins.agg(F.count(F.lit(1)).cast("double").alias("__all"))
    sums = positives.join(ranked.select("id", "feature", "rk"), "id").groupBy("draw", "concept", "feature").agg(F.count(F.lit(1)).cast("double").alias("p"), F.sum("rk").alias("rs"))
    p, q = F.col("p"), F.col("__all") - F.col("p")
    area = F.when(q > 0, (F.col("rs") - p * (p + 1) / 2) / (p * q))
    value = sums.join(total, F.lit(True)).groupBy("draw", "concept").agg(F.max(directed(area)).alias("value"))
    return _every_draw(concepts, draws).join(value, ["draw", "concept"], "left").withColumn("value", F.coalesce("value", F.lit(0.5)))


def cluster_permutation(sites: DataFrame, draws: int, seed: str) -> DataFrame:
    """Of sites (cluster, i, effect, y), equal-sized clusters: observed mean difference, p.

    A draw hands every cluster the labels of another one, by hash order; draws
    that leave a class empty count as no hit.
    """
    diff = F.avg(F.when(F.col("y") == 1, F.col("effect"))) - F.avg(F.when(F.col("y") == 0, F.col("effect")))
    observed = sites.agg(diff.alias("observed"))
    clusters = sites.select("cluster").distinct()
    slots = numbered(clusters, (), "cluster", (), "slot").select(F.col("cluster").alias("to"), "slot")
    each = clusters.select("cluster", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw"))
    mixed = each.withColumn("slot", F.row_number().over(Window.partitionBy("draw").orderBy(draw(F.lit(seed), F.col("draw"), F.col("cluster")), "cluster")))
    plan = mixed.join(slots, "slot").select("draw", "to", "cluster")
    labels = plan.join(sites.select("cluster", "i", "y"), "cluster").select("draw", F.col("to").alias("cluster"), "i", "y")
    null = labels.join(sites.select("cluster", "i", "effect"), ["cluster", "i"]).groupBy("draw").agg(diff.alias("null"))
    joined = null.join(observed, F.lit(True))
    hits = F.sum(F.when(F.abs("null") >= F.abs("observed"), 1).otherwise(0))
    return joined.groupBy("observed").agg(((1 + hits) / F.lit(1.0 + draws)).alias("p"))


def paired_stats(deltas: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Per keys of (keys, delta): n, mean, median, t and share of negatives.

    t is null for fewer than two or only zero deltas, infinite where all are equal.
    """
    d = F.col("delta")
    sums = deltas.groupBy(*keys).agg(F.count(d).alias("n"), F.avg(d).alias("mean"), F.percentile(d, 0.5).alias("median"), F.stddev_samp(d).alias("sd"), F.avg((d < 0).cast("double")).alias("negative"))
    t = F.when((F.col("n") < 2) | ((F.col("sd") == 0) & (F.col("mean") == 0)), None).when(F.col("sd") == 0, F.signum("mean") * float("inf")).otherwise(F.col("mean") / (F.col("sd") / F.sqrt("n")))
    return sums.select(*keys, "n", "mean", "median", t.alias("t"), "negative")


def wilcoxon_w(deltas: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Per keys: pairs that aren't zero, the smaller signed rank sum and the sum over tie groups of t^3 - t."""
    some = deltas.where("delta <> 0").select(*keys, F.abs("delta").alias("__a"), (F.col("delta") > 0).cast("long").alias("up"))
    tied = tied_ranks(some, keys, "__a", ("up",), split=True)
    n, t = F.col("n"), F.col("n").cast("double")
    up, down = F.sum(F.col("rk") * F.col("up")), F.sum(F.col("rk") * (n - F.col("up")))
    return tied.groupBy(*keys).agg(F.sum("n").alias("n"), F.least(up, down).alias("w"), F.sum(t * t * t - t).alias("ties"))


def erfc(x: Column) -> Column:
    """1 less the error function, for x of 0 or more: a series up to 2, a continued fraction above."""
    square = x * x
    begin = F.struct(x.alias("term"), x.alias("sum"))

    def add(s: Column, k: Column) -> Column:
        term = s["term"] * 2 * square / (2 * k + 1)
        return F.struct(term.alias("term"), (s["sum"] + term).alias("sum"))

    series = 1 - F.aggregate(F.sequence(F.lit(1), F.lit(60)), begin, add, lambda s: s["sum"]) * F.exp(-square) * (2 / math.sqrt(math.pi))
    fraction = F.aggregate(F.sequence(F.lit(80), F.lit(1)), F.lit(0.0), lambda t, k: k / 2 / (x + t), lambda t: F.exp(-square) / (x + t) / math.sqrt(math.pi))
    return F.when(x <= 2, series).otherwise(fraction)


def _log_gamma_step(a: Column) -> Column:
    """log of gamma(a + 1/2) / gamma(a): an asymptotic series sixteen steps further on, and the steps back."""
    b = a + 16
    far = F.log(b) / 2 - 1 / (8 * b) + 1 / (192 * F.pow(b, F.lit(3))) - 1 / (640 * F.pow(b, F.lit(5))) + 17 / (14336 * F.pow(b, F.lit(7)))
    for i in range(16):
        far = far + F.log((a + i) / (a + (i + 0.5)))
    return far


def _beta_fraction(a: Column, b: Column, x: Column) -> Column:
    """The continued fraction of the incomplete beta function, from its end; as many steps as the larger argument needs.

    A step names what it carries once, and the arguments are made once a row, not once a step.
    """

    def fraction(s: Column) -> Column:
        a, b, x = s["a"], s["b"], s["x"]

        def step(t: Column, m: Column) -> Column:
            odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
            return m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) / (1 + odd / (1 + t))

        steps = F.sequence((60 + 3 * F.sqrt(F.greatest(a, b))).cast("int"), F.lit(1))
        return F.aggregate(steps, F.lit(0.0), step, lambda t: 1 / (1 - (a + b) * x / (a + 1) / (1 + t)))

    return F.get(F.transform(F.array(F.struct(a.alias("a"), b.alias("b"), x.alias("x"))), fraction), F.lit(0))


def student_p(t: Column, n: Column) -> Column:
    """Two-sided p of a one-sample t statistic with n - 1 degrees of freedom; 1 for a null t or fewer than two rows, 0 for an infinite t."""
    df = (n - 1).cast("double")
    a, half = F.greatest(df, F.lit(1.0)) / 2, F.lit(0.5)
    x = df / (df + t * t)
    front = F.exp(_log_gamma_step(a) - 0.5 * math.log(math.pi) + a * F.log(x) + F.log1p(-x) / 2)
    inner = F.when(x < (a + 1) / (a + 2.5), front * _beta_fraction(a, half, x) / a).otherwise(1 - front * _beta_fraction(half, a, 1 - x) / 0.5)
    p = F.when(x >= 1, 1.0).when(x <= 0, 0.0).otherwise(inner)
    return F.when(t.isNull() | (n < 2), 1.0).when(F.abs(t) == float("inf"), 0.0).otherwise(p)


#: Pairs up to which signed ranks without ties have their exact distribution.
EXACT = 50


def signed_rank_table(rows: DataFrame) -> DataFrame:
    """(n, below): for 1 to EXACT pairs, how likely a signed rank sum of 0, 1, ... or less is. rows: any frame of the session."""
    n = rows.sparkSession.range(1, EXACT + 1).select(F.col("id").alias("n"))
    at = lambda c, i: F.coalesce(F.get(c, i), F.lit(0.0))

    def longer(c: Column, k: Column) -> Column:  # how many subsets of 1..k have each sum
        return F.transform(F.sequence(F.lit(0), F.size(c) + k - 1), lambda i: at(c, i) + at(c, i - k))

    counts = F.aggregate(F.sequence(F.lit(1), F.col("n").cast("int")), F.array(F.lit(1.0)), longer)
    share = n.select("n", F.posexplode(F.transform(counts, lambda c: c / F.pow(F.lit(2.0), F.col("n")))).alias("w", "share"))
    summed = share.withColumn("below", F.sum("share").over(Window.partitionBy("n").orderBy("w")))
    return summed.groupBy("n").agg(F.transform(F.sort_array(F.collect_list(F.struct("w", "below"))), lambda s: s["below"]).alias("below"))


def with_p_values(stats: DataFrame, rows: str = "n", t: str = "t", pairs: str = "w_n", w: str = "w", ties: str = "ties") -> DataFrame:
    """stats with t_p and w_p, both two-sided.

    w_p: exact up to EXACT pairs without ties, by a table of EXACT rows; the
    normal approximation with tie correction otherwise; 1 without pairs.
    """
    n, w_, tied = F.col(pairs).cast("double"), F.col(w), F.coalesce(F.col(ties), F.lit(0.0))
    table = signed_rank_table(stats).select(F.col("n").alias("__n"), "below")  # EXACT rows
    joined = stats.join(F.broadcast(table), F.col(pairs).cast("long") == F.col("__n"), "left")
    exact = F.least(F.lit(1.0), 2 * F.get("below", F.floor(w_).cast("int")))
    spread = F.sqrt(F.greatest(n * (n + 1) * (2 * n + 1) / 24 - tied / 48, F.lit(0.0)))
    normal = F.when(spread == 0, 1.0).otherwise(erfc(F.abs(w_ - n * (n + 1) / 4) / spread / math.sqrt(2)))
    p = F.when(F.coalesce(n, F.lit(0.0)) == 0, 1.0).when((n <= EXACT) & (tied == 0), exact).otherwise(normal)
    return joined.withColumn("t_p", student_p(F.col(t), F.col(rows))).withColumn("w_p", p).drop("__n", "below")


def paired_tests(deltas: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Per keys of (keys, delta): paired_stats, w, w_n (pairs that aren't zero), t_p and w_p; w is 0 where no pair is left."""
    signed = wilcoxon_w(deltas, keys).withColumnRenamed("n", "w_n")
    both = same(paired_stats(deltas, keys), signed, list(keys), "left")
    tested = with_p_values(both)
    return tested.withColumns({"w": F.coalesce("w", F.lit(0.0)), "w_n": F.coalesce("w_n", F.lit(0))}).drop("ties")
