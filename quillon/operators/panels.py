"""Panels of concepts: interval sets by derivation, annotation matrices, prevalence and roles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions.scalar import aligned_chrom
from quillon.operators.intervals import merge, span
from quillon.operators.reports import role

KINDS = ("ccre_class", "ccre_union", "gencode_splice", "gencode_tss_window", "gc_quantile", "shuffle_of")


def build_concept(spec: dict, builders: dict[str, Callable[[dict], DataFrame]]) -> DataFrame:
    """Merged intervals of one concept: spec["kind"] names the builder that makes them. Nothing found is an error."""
    kind = spec.get("kind")
    if kind not in builders:
        raise ValueError(f"unknown derivation {kind!r}; known: {sorted(builders)}")
    out = merge(builders[kind](spec).select("chrom", "start", "end"))
    if not out.limit(1).count():
        raise ValueError(f"{spec.get('name')}: no intervals")
    return out


def build_panel(specs: list[dict], builders: dict[str, Callable[[dict], DataFrame]]) -> DataFrame:
    """(concept, chrom, start, end) of all specs; names are unique, and all are checked before any is built."""
    names = [s.get("name") for s in specs]
    if not specs or None in names or len(set(names)) != len(names):
        raise ValueError("a panel needs specs with names of their own")
    unknown = sorted({str(s.get("kind")) for s in specs} - set(builders))
    if unknown:
        raise ValueError(f"unknown derivations {unknown}")
    out = None
    for s in specs:
        one = build_concept(s, builders).select(F.lit(s["name"]).alias("concept"), "chrom", "start", "end")
        out = one if out is None else out.unionByName(one)
    return out


def interval_summary(raw: DataFrame) -> DataFrame:
    """Per concept of raw intervals (concept, chrom, start, end): number, merged number, bases covered, and merged bases over raw ones."""
    given = raw.groupBy("concept").agg(F.count("*").alias("n"), F.sum(F.col("end") - F.col("start")).cast("long").alias("raw_bases"))
    merged = merge(raw.select("concept", "chrom", "start", "end"), ("concept", "chrom"), validate=False)
    covered = merged.groupBy("concept").agg(F.count("*").alias("n_merged"), F.sum(F.col("end") - F.col("start")).cast("long").alias("bases"))
    return given.join(covered, "concept").select("concept", "n", "n_merged", "bases", (F.col("bases") / F.col("raw_bases")).alias("merged_ratio"))


def annotation_matrix(labelled: DataFrame, concepts: list[str], keys: tuple[str, ...] = ("chrom", "bin_start")) -> DataFrame:
    """Bins (keys, concept, y) as one row a bin with a 0/1 column for each concept; one aggregation for all."""
    return labelled.groupBy(*keys).agg(*[F.max(F.when(F.col("concept") == c, F.col("y")).otherwise(0)).cast("int").alias(c) for c in concepts])


def prevalence(labelled: DataFrame) -> DataFrame:
    """Per concept of kept bins (concept, y): n, positives, prevalence and role."""
    sums = labelled.groupBy("concept").agg(F.count("*").alias("n"), F.sum("y").cast("long").alias("n_pos"), F.avg(F.col("y").cast("double")).alias("prevalence"))
    return sums.withColumn("role", role(F.col("concept"), F.col("prevalence")))


def gaps(runs: DataFrame) -> DataFrame:
    """Merged runs of unknown bases (chrom, start, end) over all sequences."""
    return merge(runs.select("chrom", "start", "end"))


def concept_bases(panel: DataFrame) -> DataFrame:
    return span(panel)


def consensus(marked: DataFrame, keys: tuple[str, ...], least: int, strict: bool = False) -> DataFrame:
    """Per bin (keys) and mark of marked (keys, mark, cell): how many cells have it, and whether least do.

    strict: fails for marks of which fewer cells than least have any bin. Marks of
    a cell named "-" stand for no cell line: their bins count as they are.
    """
    cells = marked.select(*keys, "mark", "cell").distinct()
    if strict:
        n = marked.where("cell <> '-'").groupBy("mark").agg(F.countDistinct("cell").alias("n"))
        few = n.where(F.col("n") < least).collect()  # one row a mark
        if few:
            raise ValueError("; ".join(f"{r['mark']}: {r['n']} files can't meet {least}" for r in sorted(few)))
    sums = cells.groupBy(*keys, "mark").agg(F.count(F.lit(1)).alias("cells"), F.max((F.col("cell") == "-").cast("int")).alias("__alone"))
    return sums.withColumn("consensus", (F.col("cells") >= least) | (F.col("__alone") == 1)).drop("__alone")


def align_chroms(intervals: DataFrame, bins: DataFrame) -> DataFrame:
    """intervals (chrom, ...) under the names that bins (chrom) use, chr1 or 1 and chrM or MT; unknown ones go.

    ValueError if bins have no chrom, or names with and without chr.
    """
    names = bins.select("chrom").distinct()
    n = names.agg(F.count(F.lit(1)).alias("all"), F.count_if(F.col("chrom").startswith("chr")).alias("prefixed")).first()
    if not n["all"]:
        raise ValueError("the bins have no chromosomes")
    if n["prefixed"] not in (0, n["all"]):
        raise ValueError("the bins mix names with and without chr")
    return intervals.withColumn("chrom", aligned_chrom(F.col("chrom"), n["prefixed"] > 0)).join(names, "chrom", "left_semi")


def select_tracks(catalogue: DataFrame, strand: str, assays: dict[str, str | None]) -> DataFrame:
    """Tracks (output, index, name, biosample, assay, strand, modified) of one strand, unmodified, of the asked outputs.

    assays: output to the only assay that counts, or None for any. ValueError for outputs of which no track is left.
    """
    wanted = None
    for output, assay in assays.items():
        one = (F.col("output") == output) & (F.lit(True) if assay is None else F.col("assay") == assay)
        wanted = one if wanted is None else wanted | one
    found = catalogue.where(wanted & (F.col("strand") == strand) & ~F.coalesce(F.col("modified"), F.lit(False)))
    missing = set(assays) - {r["output"] for r in found.select("output").distinct().collect()}
    if missing:
        raise ValueError(f"no tracks of {sorted(missing)}")
    return found.select("output", "index", "name", "biosample", "assay", "strand")


def unfinished(grid: DataFrame, finished: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Configurations of grid that finished lacks, each once."""
    return grid.dropDuplicates(list(keys)).join(finished.select(*keys).distinct(), list(keys), "left_anti")
