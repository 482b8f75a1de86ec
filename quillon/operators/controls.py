"""Choice of control features and windows for interventions.

Feature tables have one row a feature of a dictionary; they are joined on
cells of a logarithm where a tolerance bounds the difference, so that targets
are not compared with the whole dictionary.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.scalar import draw
from quillon.operators.orders import numbered
from quillon.operators.validators import count_if

MAX_AUROC = 0.55
TOLERANCE = 0.25
SLACK = 1e-12


def cell(value: Column, tolerance: float) -> Column:
    """A cell of the logarithm as wide as the tolerance: values within it lie in the same or in the next cells."""
    return F.floor(F.log(F.greatest(value, F.lit(1e-12))) / math.log1p(tolerance))


def near_pairs(targets: DataFrame, pool: DataFrame, value: str, tolerance: float) -> DataFrame:
    """Pairs (target, t_value, pool columns) whose value differs from the target's by at most tolerance of it; never a feature with itself."""
    want = targets.select(F.col("feature").alias("target"), F.col(value).alias("t_value"))
    span = F.sequence(cell(F.col("t_value") * (1 - tolerance), tolerance) - 1, cell(F.col("t_value") * (1 + tolerance), tolerance) + 1)
    joined = want.withColumn("__cell", F.explode(span)).join(pool.withColumn("__cell", cell(F.col(value), tolerance)), "__cell").drop("__cell")
    close = F.abs(F.col(value) - F.col("t_value")) <= (tolerance + SLACK) * F.greatest(F.abs("t_value"), F.lit(1e-12))
    return joined.where(close & (F.col("feature") != F.col("target")))


def first_by(pairs: DataFrame, key: str, *order: Column | str) -> DataFrame:
    return pairs.withColumn("__r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("__r = 1").drop("__r")


def activity_matched(activity: DataFrame, targets: DataFrame, n: int, tolerance: float = TOLERANCE, seed: str = "controls") -> DataFrame:
    """(target, control, rank): for each target n features of activity (feature, rate) of near rate, drawn by hash.

    Targets are never controls. A target without any near feature draws from
    all of them: these are put in one hashed order, of which each such target
    takes n in turn from a place of its own, so that no pairs are formed.
    """
    pool = activity.join(targets.select("feature"), "feature", "left_anti")
    want = activity.join(targets.select("feature"), "feature", "left_semi")
    close = near_pairs(want, pool, "rate", tolerance)
    order = Window.partitionBy("target").orderBy(draw(F.lit(seed), F.col("target"), F.col("feature")), "feature")
    picked = close.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n).select("target", F.col("feature").alias("control"), "rank")
    lonely = want.select(F.col("feature").alias("target")).join(close.select("target").distinct(), "target", "left_anti")
    ring = numbered(pool.withColumn("__d", draw(F.lit(seed), F.col("feature"))), (), "__d", ("feature",)).select("feature", (F.col("number") - 1).cast("int").alias("place"))
    size = pool.agg(F.count("*").alias("size"))
    steps = lonely.join(size, F.lit(True)).where("size > 0").select("target", "size", F.explode(F.sequence(F.lit(1), F.least(F.lit(n), F.col("size").cast("int")))).alias("rank"))
    steps = steps.withColumn("place", F.pmod(draw(F.lit(seed), F.col("target")) + F.col("rank") - 1, F.col("size")).cast("int"))
    others = steps.join(ring, "place").select("target", F.col("feature").alias("control"), "rank")
    return picked.unionByName(others)


def low_auroc(features: DataFrame, limit: float = MAX_AUROC) -> DataFrame:
    """Features (feature, rate, max_auroc ...) that fire and tell no concept apart."""
    return features.where((F.col("rate") > 0) & F.col("max_auroc").isNotNull() & ~F.isnan("max_auroc") & (F.col("max_auroc") < limit))


def low_auroc_control(features: DataFrame, targets: DataFrame, tolerance: float = TOLERANCE, seed: str = "1234") -> DataFrame:
    """(target, control, n_candidates): one low-AUROC feature of near rate for each target, drawn by hash."""
    pairs = near_pairs(features.join(targets.select("feature"), "feature", "left_semi"), low_auroc(features), "rate", tolerance)
    pairs = pairs.withColumn("n_candidates", F.count("*").over(Window.partitionBy("target")))
    best = first_by(pairs, "target", draw(F.lit(seed), F.col("target"), F.col("feature")), "feature")
    return best.select("target", F.col("feature").alias("control"), "n_candidates")


def local_rate_control(features: DataFrame, targets: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """(target, control, difference) of features (feature, rate, max_auroc, fired): from the pool of near overall rate, the one whose local count is nearest, within the tolerance."""
    own = features.join(targets.select("feature"), "feature", "left_semi").where("fired > 0 AND rate > 0")
    pairs = near_pairs(own, low_auroc(features), "rate", TOLERANCE).join(own.select(F.col("feature").alias("target"), F.col("fired").alias("t_fired")), "target")
    pairs = pairs.withColumn("difference", F.abs(F.col("fired") - F.col("t_fired")) / F.col("t_fired")).where((F.col("fired") > 0) & (F.col("difference") <= tolerance + SLACK))
    return first_by(pairs, "target", "difference", F.abs(F.col("rate") - F.col("t_value")), "feature").select("target", F.col("feature").alias("control"), "difference")


def local_strength_control(features: DataFrame, targets: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """(target, control, rate_difference, strength_difference): the low-AUROC feature nearest in local count and strength, both within the tolerance."""
    own = features.join(targets.select("feature"), "feature", "left_semi").where("fired > 0 AND strength > 0")
    quiet = features.where((F.col("fired") > 0) & F.col("max_auroc").isNotNull() & (F.col("max_auroc") < MAX_AUROC))
    mine = own.select(F.col("feature").alias("target"), F.col("strength").alias("t_strength"))
    pairs = near_pairs(own, quiet, "fired", tolerance).join(mine, "target")
    a = (F.abs(F.col("fired") - F.col("t_value")) / F.col("t_value")).alias("rate_difference")
    b = (F.abs(F.col("strength") - F.col("t_strength")) / F.col("t_strength")).alias("strength_difference")
    pairs = pairs.select("target", "feature", a, b).where(F.col("strength_difference") <= tolerance + SLACK)
    best = first_by(pairs, "target", F.greatest("rate_difference", "strength_difference"), F.col("rate_difference") + F.col("strength_difference"), "feature")
    return best.select("target", F.col("feature").alias("control"), "rate_difference", "strength_difference")


def nearest_dose(norms: DataFrame, low: float = 0.75, high: float = 1.25) -> DataFrame:
    """(target, control, scale, within): for each feature of (feature, l2) the other one of nearest size, by the ratio's logarithm; the lower feature of equals.

    In the order of sizes the nearest one is the next smaller or larger size, or
    one of the same; each size is one row, so that no pairs are formed. The
    sizes are persisted, as they are read several times.
    """
    norms = norms.persist()
    sizes = norms.where("l2 > 0").groupBy("l2").agg(F.min("feature").alias("first"), F.count(F.lit(1)).alias("n"))
    order = Window.orderBy("l2")  # a row a size: a dictionary's features at most
    sizes = sizes.withColumns({"down": F.lag("l2").over(order), "up": F.lead("l2").over(order)})
    second = norms.join(sizes.where("n > 1").select("l2", "first"), "l2").where(F.col("feature") > F.col("first")).groupBy("l2").agg(F.min("feature").alias("second"))
    of = sizes.select(F.col("l2").alias("c"), F.col("first").alias("control"))
    own = norms.select(F.col("feature").alias("target"), "l2").join(sizes, "l2").join(second, "l2", "left")
    equal = own.select("target", F.col("l2").alias("t"), F.col("l2").alias("c"), F.when(F.col("target") == F.col("first"), F.col("second")).otherwise(F.col("first")).alias("control")).where("control IS NOT NULL")
    beside = None
    for side in ("down", "up"):
        one = own.where(F.col(side).isNotNull()).select("target", F.col("l2").alias("t"), F.col(side).alias("c")).join(of, "c").select("target", "t", "c", "control")
        beside = one if beside is None else beside.unionByName(one)
    d = F.abs(F.log(F.round(F.col("c") / F.col("t"), 9)))
    best = first_by(equal.unionByName(beside).withColumn("d", d), "target", "d", "control")
    scale = F.col("t") / F.col("c")
    return best.select("target", "control", scale.alias("scale"), scale.between(low, high).alias("within"))


def window_controls(target: DataFrame, candidates: DataFrame, order: DataFrame, low: float = 0.75, high: float = 1.25, least: float = 1e-8) -> DataFrame:
    """Per window the candidate feature that is active wherever the target is and moves as much there.

    target (win, bin, l2), candidates (win, bin, feature, l2), order (feature,
    dev_rank). Nearest by the logarithm of the ratio, then dev_rank, feature.
    """
    active = target.where(F.col("l2") > least).select("win", "bin", F.col("l2").alias("t_l2"))
    need = active.groupBy("win").agg(F.count("*").alias("n_active"), F.sum("t_l2").alias("t_sum"))
    there = active.join(candidates, ["win", "bin"]).groupBy("win", "feature").agg(count_if(F.col("l2") > least).alias("n_both"), F.sum("l2").alias("c_sum"))
    rated = there.join(need, "win").withColumn("ratio", F.col("c_sum") / F.col("t_sum")).where((F.col("n_both") == F.col("n_active")) & F.col("ratio").between(low, high))
    best = first_by(rated.join(order, "feature"), "win", F.abs(F.log(F.round("ratio", 9))), "dev_rank", "feature")
    return best.select("win", F.col("feature").alias("control"), "ratio", "n_active")


def window_classes(bins: DataFrame, keys: tuple[str, ...], n_bins: int) -> DataFrame:
    """Per window of bins (keys, kept, y): kept bins, positives, and its class: incomplete, both, present or absent.

    incomplete: not n_bins bins, or some not kept; both: positives and
    negatives; present: positives only; absent: none.
    """
    sums = bins.groupBy(*keys).agg(F.count("*").alias("n"), count_if(F.col("kept")).alias("n_kept"), count_if(F.col("kept") & (F.col("y") == 1)).alias("n_pos"))
    kind = F.when((F.col("n") != n_bins) | (F.col("n_kept") != n_bins), "incomplete").when(F.col("n_pos") == 0, "absent").when(F.col("n_pos") == F.col("n_kept"), "present").otherwise("both")
    return sums.withColumn("kind", kind)


def choose_window(bins: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """The first window in key order that has kept bins of both classes (one row; empty if there is none)."""
    sums = bins.where("kept").groupBy(*keys).agg(F.sum("y").alias("p"), F.count("*").alias("n")).where("p > 0 AND p < n")
    return sums.orderBy(*keys).limit(1).select(*keys, F.col("p").cast("long").alias("n_pos"), "n")


def cohort_plan(classes: DataFrame, keys: tuple[str, ...], n_present: int, seed: str = "cohort") -> DataFrame:
    """All complete windows without positives (mode inject) and n_present with some (mode ablate), drawn by hash."""
    absent = classes.where("kind = 'absent'").withColumn("mode", F.lit("inject"))
    present = classes.where("kind IN ('both', 'present')")
    drawn = present.orderBy(draw(F.lit(seed), *[F.col(k) for k in keys]), *keys).limit(n_present).withColumn("mode", F.lit("ablate"))
    return absent.unionByName(drawn).select(*keys, "mode", "n_pos")


def relabel_mismatches(made: DataFrame, known: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """One row: bins of known (keys, y) that made (keys, y) labels too, and how many differ."""
    both = known.select(*keys, F.col("y").alias("__y")).join(made.select(*keys, "y"), list(keys))
    return both.agg(F.count("*").alias("n"), count_if(~F.col("y").eqNullSafe(F.col("__y"))).alias("n_differ"))


def firing_strengths(codes: DataFrame, positives: DataFrame, norms: DataFrame) -> DataFrame:
    """Per feature of codes (id, feature, value) over the positive rows (id): how often it fires, and the sum of codes times its direction's norm."""
    own = codes.join(positives.select("id").distinct(), "id", "left_semi").join(norms, "feature")
    v = F.col("value").cast("double")
    return own.groupBy("feature").agg(count_if(v > 0).alias("fired"), F.sum(v * F.col("norm")).alias("strength"))


def random_directions(ids: int, width: int, seed: str = "null") -> list[Column]:
    """Uniform coordinates in [-1, 1) for direction number `id`, one column each: the null of nearest-cosine agreement."""
    return [(draw(F.lit(seed), F.col("id"), F.lit(i)) / float(1 << 31) - 1.0) for i in range(width)]
