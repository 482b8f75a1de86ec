"""Gene records: exons, eligibility, readouts and effect summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.operators.intervals import bin_weights, first_containing, merge


def representative_transcripts(records: DataFrame, tag: str = "MANE_Select") -> DataFrame:
    """Protein-coding transcripts of GTF records (with attributes) that carry the tag, with their first base."""
    own = records.where((F.col("feature") == "transcript") & F.col("attributes").contains(f'tag "{tag}"') & F.col("attributes").contains('gene_type "protein_coding"'))
    site = F.when(F.col("strand") == "+", F.col("start")).otherwise(F.col("end") - 1)
    return own.select("chrom", "gene", "transcript", "strand", site.alias("pos"))


def eligible_genes(transcripts: DataFrame, exons: DataFrame, windows: DataFrame, marked: DataFrame, margin: int, width: int = 128, least_bases: int = 2048, least_bins: int = 16, seed: str = "genes") -> DataFrame:
    """Transcripts whose first base lies well within a window and in no marked bin (chrom, bin_start), with enough exonic bases and bins, in hash order."""
    placed = first_containing(transcripts, windows, margin)
    bin_of = (F.floor(F.col("pos") / width) * width).alias("bin_start")
    free = placed.select("*", bin_of).join(marked.select("chrom", "bin_start").distinct(), ["chrom", "bin_start"], "left_anti").drop("bin_start")
    own = exons.join(free.select("transcript", "win_start", "win_end"), "transcript").select("transcript", F.greatest("start", "win_start").alias("start"), F.least("end", "win_end").alias("end")).where("start < end")
    merged = merge(own, ("transcript",), validate=False)
    weights = bin_weights(merged, width, ("transcript",)).groupBy("transcript").agg(F.sum("bases").alias("bases"), F.count("*").alias("bins"))
    enough = weights.where((F.col("bases") >= least_bases) & (F.col("bins") >= least_bins))
    key = F.sha2(F.concat_ws("|", F.lit(seed), "gene", "transcript"), 256)
    return free.join(enough, "transcript").withColumn("selection_hash", key).withColumn("rank", F.row_number().over(Window.orderBy("selection_hash", "gene")))


def readouts(tracks: DataFrame, sites: DataFrame, weights: DataFrame, radius: int = 2) -> DataFrame:
    """Per gene and track of (track, modality, bin, value): the mean over exonic bases for RNA, the sum around the first base otherwise."""
    near = sites.select("gene", F.explode(F.sequence(F.greatest(F.col("bin") - radius, F.lit(0)), F.col("bin") + radius)).alias("bin"))
    starts = tracks.where("modality <> 'RNA'").join(near, "bin").groupBy("gene", "track", "modality").agg(F.sum("value").alias("readout"))
    rna = tracks.where("modality = 'RNA'").join(weights, "bin").groupBy("gene", "track", "modality").agg((F.sum(F.col("value") * F.col("bases")) / F.sum("bases")).alias("readout"))
    return starts.unionByName(rna)


def effects(pairs: DataFrame) -> DataFrame:
    """Per modality of (modality, edited, original): median log2 ratio (offset .001 for RNA, else 1) and the share that rose."""
    offset = F.when(F.col("modality") == "RNA", 0.001).otherwise(1.0)
    ratio = F.log2((F.col("edited") + offset) / (F.col("original") + offset))
    return pairs.select("modality", ratio.alias("r")).groupBy("modality").agg(F.count("*").alias("n"), F.percentile("r", 0.5).alias("median_log2"), F.avg((F.col("r") > 0).cast("double")).alias("increased"))


def local_effects(bins: DataFrame) -> DataFrame:
    """Per head of (head, element, baseline, edited): mean change on and off the element over the baseline's spread, and the mean size of change."""
    d = F.col("edited") - F.col("baseline")
    spread = F.stddev_pop("baseline") + 1e-9
    return bins.groupBy("head").agg((F.avg(F.when(F.col("element"), d)) / spread).alias("on_element"), (F.avg(F.when(~F.col("element"), d)) / spread).alias("off_element"), F.avg(F.abs(d)).alias("mae"))
