"""Tables of results: top rows, shares, frontiers, profiles, run comparisons, panels, draws."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.operators.orders import before, numbered, same


def top_rows(codes: DataFrame, n: int) -> DataFrame:
    """The n rows of largest value for each feature of (id, feature, value), with rank."""
    order = Window.partitionBy("feature").orderBy(F.desc("value"), "id")
    return codes.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def concept_shares(top: DataFrame, labels: DataFrame) -> DataFrame:
    """Per feature of top (id, feature) the concept with the largest share of rows, the first of equals by name."""
    shares = top.select("id", "feature").join(labels, "id").groupBy("feature", "concept").agg(F.avg(F.col("y").cast("double")).alias("share"))
    order = Window.partitionBy("feature").orderBy(F.desc("share"), "concept")
    first = shares.withColumn("r", F.row_number().over(order)).where("r = 1")
    return first.select("feature", F.when(F.col("share") > 0, F.col("concept")).otherwise("none").alias("dominant"), "share")


def memorisation_gap(unseen: DataFrame, trained: DataFrame) -> DataFrame:
    """Of two runs (concept, value): their values and the gap, trained less unseen."""
    a, b = unseen.select("concept", F.col("value").alias("value_unseen")), trained.select("concept", F.col("value").alias("value_trained"))
    return a.join(b, "concept").withColumn("gap", F.col("value_trained") - F.col("value_unseen"))


def pareto(points: DataFrame, cost: str, loss: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Points for which no cheaper one has as low a loss; one of those of equal cost and loss."""
    least = points.groupBy(*keys, F.col(cost).alias("__cost")).agg(F.min(F.struct(loss, *[c for c in points.columns if c != loss])).alias("__p"))
    best = before(least.withColumn("__loss", F.col("__p").getField(loss)), keys, "__cost", {"__least": ("min", "__loss")})
    kept = best.where(F.col("__least").isNull() | (F.col("__loss") < F.col("__least")))
    return kept.select(*[F.col("__p").getField(c).alias(c) for c in points.columns])


def ecdf(values: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """(keys, value, above): the share of values at or after each, in order of value and, for equal ones, id."""
    sizes = values.groupBy(*keys).agg(F.count(F.lit(1)).cast("double").alias("__m"))
    placed = same(numbered(values, keys, "value", ("id",), "__i"), sizes, list(keys))
    return placed.withColumn("above", 1 - (F.col("__i") - 1) / F.col("__m")).drop("__i", "__m")


def max_pool(profile: DataFrame, points: int, keys: tuple[str, ...]) -> DataFrame:
    """Profile (keys, start, value) as at most points groups of neighbours: first start and largest value."""
    sizes = profile.groupBy(*keys).agg(F.count(F.lit(1)).alias("__m"))
    placed = same(numbered(profile, keys, "start", ("value",), "__i"), sizes, list(keys))
    i, n = F.col("__i") - 1, F.col("__m")
    part = F.when(n <= points, i).otherwise(F.floor(i * points / n)).cast("long")
    return placed.withColumn("part", part).groupBy(*keys, "part").agg(F.min("start").alias("start"), F.max("value").alias("value"))


#: Concepts whose names begin so belong to one cell line (fixed values).
CELL_LINES = ("K562", "GM12878", "HepG2", "A549", "H1", "MCF-7")
#: Concepts that are exploratory whatever their prevalence (fixed values).
EXPLORATORY = ("cCRE_pELS", "cCRE_dELS")


def role(concept: Column, prevalence: Column, low: float = 0.001, high: float = 0.03, exploratory: tuple[str, ...] = EXPLORATORY, cell_lines: tuple[str, ...] = CELL_LINES) -> Column:
    """A concept's role in a panel from its name and prevalence."""
    of_cell = F.lit(False)
    for line in cell_lines:
        of_cell = of_cell | concept.startswith(f"{line}_")
    return (
        F.when(concept == "blacklist", "artifact_control")
        .when(concept.startswith("shuffled_"), "negative_control")
        .when(concept.isin(*exploratory) | of_cell | (prevalence > high), "exploratory")
        .when(prevalence >= low, "confirmatory")
        .otherwise("excluded_too_rare")
    )


def draw_splits(pool: DataFrame, key: str, counts: list[tuple[str, int]], ties: tuple[str, ...] = ()) -> DataFrame:
    """The first rows of pool in the order of key (and ties), dealt to splits without replacement."""
    ranked = numbered(pool, (), key, ties, "__r")
    split, at = F.lit(None).cast("string"), 0
    for name, n in counts:
        split = F.when((F.col("__r") > at) & (F.col("__r") <= at + n), name).otherwise(split)
        at += n
    return ranked.where(F.col("__r") <= at).withColumn("split", split).drop("__r")


def validation(bins: DataFrame, width: int) -> DataFrame:
    """One row of counts of what is wrong with coordinates (chrom, bin_start, bin_end)."""
    keys = bins.groupBy("chrom", "bin_start").count().where("count > 1").agg(F.count("*").alias("repeated"))
    wrong = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    one = bins.agg(
        F.count("*").alias("n"),
        wrong(F.col("chrom").isNull() | F.col("bin_start").isNull() | F.col("bin_end").isNull()).alias("nulls"),
        wrong(F.col("bin_end") - F.col("bin_start") != width).alias("bad_width"),
        wrong(F.col("bin_start") < 0).alias("negative"),
    )
    return one.join(keys, F.lit(True))


def complete_grids(bins: DataFrame, width: int, n: int, keys: tuple[str, ...]) -> DataFrame:
    """Groups that hold exactly n consecutive bins, all kept."""
    sums = bins.groupBy(*keys).agg(F.count("*").alias("c"), F.countDistinct("bin_start").alias("d"), F.min("bin_start").alias("low"), F.max("bin_start").alias("high"), F.min(F.col("kept").cast("int")).alias("all_kept"))
    return sums.select(*keys, ((F.col("c") == n) & (F.col("d") == n) & (F.col("high") - F.col("low") == width * (n - 1)) & (F.col("all_kept") == 1)).alias("complete"))
