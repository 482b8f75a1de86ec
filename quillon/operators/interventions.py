"""Edits of activation vectors, and summaries of what interventions did."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.scalar import guarded_ratio
from quillon.operators.validators import count_if

LEAST = 1e-8


def inject(code: Column, level: Column) -> Column:
    """What a code becomes when its level is injected: the larger of both."""
    return F.greatest(code, level)


def matched_dose(target_norm: Column, control_norm: Column, least: float = LEAST) -> Column:
    """The factor that brings the control's change to the target's norm; fails where the control hardly moves."""
    return F.when(F.abs(control_norm) > least, target_norm / control_norm).otherwise(F.raise_error(F.lit("the control does not move")).cast("double"))


def selected_features(codes: DataFrame, features: DataFrame) -> DataFrame:
    """Codes of chosen features only; the semi join prunes before anything is shuffled."""
    return codes.join(F.broadcast(features.select("feature").distinct()), "feature", "left_semi")  # a handful, chosen by name


def feature_profile(codes: DataFrame, grid: DataFrame, feature: int) -> DataFrame:
    """(id, value) of one feature for every row of grid (id): 0 where it doesn't fire."""
    own = codes.where(F.col("feature") == feature).select("id", F.col("value").cast("double").alias("value"))
    return grid.join(own, "id", "left").select("id", F.coalesce("value", F.lit(0.0)).alias("value"))


def active_support(codes: DataFrame, mask: DataFrame, n_least: int = 1) -> DataFrame:
    """Per feature: rows of the mask (id) in which it is active, and whether that is enough to measure it."""
    own = codes.where("value > 0").join(mask.select("id").distinct(), "id", "left_semi")
    return own.groupBy("feature").agg(F.count("*").alias("n_active")).withColumn("measurable", F.col("n_active") >= n_least)


def remove_at(vectors: DataFrame, codes: DataFrame, positions: DataFrame, direction: Column) -> DataFrame:
    """vectors (id, vec) less their code times the direction at the sampled positions (id); untouched elsewhere."""
    own = codes.join(positions.select("id").distinct(), "id", "left_semi").select("id", F.col("value").cast("double").alias("code"))
    joined = vectors.join(own, "id", "left")
    cut = F.zip_with("vec", direction, lambda x, d: x.cast("double") - F.coalesce(F.col("code"), F.lit(0.0)) * d)
    return joined.select("id", cut.alias("vec"), F.col("code").isNotNull().alias("touched"))


def norm_summary(delta: DataFrame, least: float = LEAST) -> DataFrame:
    """Per group of (group, l2, other): mean norm, rows that move, and rows in which another feature moves too."""
    moves = F.col("l2") > least
    return delta.groupBy("group").agg(F.avg("l2").alias("mean_l2"), count_if(moves).alias("effective"), count_if(moves & (F.col("other") > least)).alias("coactive"))


def head_by_bin(tracks: DataFrame, pool: int = 1) -> DataFrame:
    """Per head and bin of (head, track, pos, value): the mean over tracks, positions pooled to bins."""
    return tracks.groupBy("head", F.floor(F.col("pos") / pool).cast("long").alias("bin")).agg(F.avg("value").alias("mean"))


def head_by_track(tracks: DataFrame) -> DataFrame:
    return tracks.groupBy("head", "track").agg(F.avg("value").alias("mean"), F.count("*").alias("n_bins"))


def triad(deltas: DataFrame) -> DataFrame:
    """Per class and head of (kind, head, win, delta): windows with a delta, mean, median and share of negative ones.

    Fewer than two windows give a neutral record: 0 for all three.
    """
    sums = deltas.where("delta IS NOT NULL").groupBy("kind", "head").agg(F.count("*").alias("n"), F.avg("delta").alias("mean"), F.percentile("delta", 0.5).alias("median"), F.avg((F.col("delta") < 0).cast("double")).alias("negative"))
    held = lambda c: F.when(F.col("n") >= 2, F.col(c)).otherwise(0.0).alias(c)
    every = deltas.select("kind", "head").distinct()
    return every.join(sums, ["kind", "head"], "left").select("kind", "head", F.coalesce("n", F.lit(0)).cast("long").alias("n"), *[held(c) for c in ("mean", "median", "negative")])


def consistency(values: DataFrame) -> DataFrame:
    """Per name of (name, value): n, median, how many are positive, and the share."""
    v = F.col("value")
    return values.groupBy("name").agg(F.count("value").alias("n"), F.percentile("value", 0.5).alias("median"), count_if(v > 0).alias("n_positive"), F.avg((v > 0).cast("double")).alias("positive"))


def mediation(effects: DataFrame, least: float = 1e-4, clip: float = 2.0) -> DataFrame:
    """Per head of (head, part, whole): mean and median of the guarded, clipped ratios, and how many could be measured."""
    rated = effects.withColumn("ratio", guarded_ratio(F.col("part"), F.col("whole"), least, clip))
    return rated.groupBy("head").agg(F.count("ratio").alias("n"), F.avg("ratio").alias("mean"), F.percentile("ratio", 0.5).alias("median"))


def winner(contrasts: DataFrame) -> DataFrame:
    """The feature of the largest contrast (the lowest number of equals); empty if nothing stands out."""
    return contrasts.where("contrast > 0").orderBy(F.desc("contrast"), "feature").limit(1)
