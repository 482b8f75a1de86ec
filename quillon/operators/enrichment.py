"""How much more a score has at events than around them, with intervals from resampled blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.scalar import draw
from quillon.operators.intervals import block_id, numbered_runs
from quillon.operators.orders import same


def event_blocks(bins: DataFrame, width: int, block: int, sigma: float = 1.0, radius: int = 2, cell: int | None = None) -> DataFrame:
    """(block, es, en, bs, bn): per block of positions the sum and number of event means and of background scores.

    bins: (chrom, bin_start, bin_end, label, score), bins of one width, each once. An event
    is the centre of a run of labelled bins; its mean weighs the bins of its
    contiguous run up to radius bins away by a normal kernel of sigma bins.
    Background are bins without label that no kernel reaches. Null scores count
    nowhere. Blocks are numbered by position, over all chroms together.
    Runs are persisted, as they are read three times; events and background come from one join.
    """
    runs = numbered_runs(bins.where("score IS NOT NULL"), {"run": F.lit(True), "event": F.col("label")}, cell=cell).select("chrom", "bin_start", "label", "score", "run", "event").persist()
    found = runs.where("label").groupBy("chrom", "event").agg(F.min("bin_start").alias("start"), F.count("*").alias("n"))
    centres = found.select("chrom", (F.col("start") + (F.floor((F.col("n") + 1) / 2) - 1) * width).alias("centre"))
    placed = centres.join(runs.where("label").select("chrom", F.col("bin_start").alias("centre"), "run"), ["chrom", "centre"])
    steps = F.sequence(F.col("centre") - radius * width, F.col("centre") + radius * width, F.lit(width).cast("long"))
    kernel = placed.withColumn("bin_start", F.explode(steps))
    met = runs.join(kernel, ["chrom", "run", "bin_start"], "left").where("centre IS NOT NULL OR NOT label")
    weight = F.exp(-F.pow((F.col("bin_start") - F.col("centre")) / F.lit(width * sigma), 2) / 2)
    outside = F.col("centre").isNull()
    own = F.when(~outside, F.col("chrom")).alias("chrom")  # background is summed up by block only
    events = met.groupBy(own, "centre", block_id(F.coalesce("centre", "bin_start"), block).alias("block")).agg(
        (F.sum(weight * F.col("score")) / F.sum(weight)).alias("event"), F.sum(F.when(outside, F.col("score"))).alias("bs"), F.count_if(outside).alias("bn")
    )
    total = lambda c: F.coalesce(F.sum(c), F.lit(0.0)).alias("es" if c == "event" else c)
    return events.groupBy("block").agg(total("event"), F.count("centre").alias("en"), total("bs"), F.sum("bn").alias("bn"))


def log_enrichment(blocks: DataFrame, draws: int = 2000, seed: str = "boot", confidence: float = 0.95, epsilon: float = 1e-12) -> DataFrame:
    """One row: log of the event mean over the background mean of event_blocks, its percentile interval, and the draws that count.

    A draw takes as many blocks as there are, with replacement, by hash. Draws
    without events or background don't count. All are one table (draw, block)
    joined to the blocks and summed, with the blocks themselves as draw -1.
    Without events or background all is null. The blocks are persisted, as they
    are read twice.
    """
    known = (F.sum("en") > 0) & (F.sum("bn") > 0)
    value = F.when(known, F.log((F.sum("es") / F.sum("en") + epsilon) / (F.sum("bs") / F.sum("bn") + epsilon)))
    place = (F.row_number().over(Window.orderBy("block")) - 1).cast("long")  # a row a block: the genome's length over the block's
    own = blocks.withColumns({"i": place, "n": F.count(F.lit(1)).over(Window.partitionBy())}).persist()
    slots = own.select(F.col("i").alias("slot"), "n", F.explode(F.sequence(F.lit(-1), F.lit(draws - 1))).alias("draw"))
    drawn = slots.select("draw", F.when(F.col("draw") < 0, F.col("slot")).otherwise(F.pmod(draw(F.lit(seed), F.col("draw"), F.col("slot")), F.col("n"))).alias("i"))
    found = same(drawn, own.drop("n"), ["i"]).groupBy("draw").agg(value.alias("v"))
    tail, resampled = (1 - confidence) / 2, F.when(F.col("draw") >= 0, F.col("v"))
    return found.agg(F.max(F.when(F.col("draw") < 0, F.col("v"))).alias("log_enrichment"), F.percentile(resampled, tail).alias("low"), F.percentile(resampled, 1 - tail).alias("high"), F.count(resampled).alias("n_draws"))
