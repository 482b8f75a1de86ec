"""A concept panel from its files: the six derivations bound to the readers, and the panel built end to end."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions.sequence import gc_quantile_bins
from quillon.operators.intervals import merge, shuffle_avoiding
from quillon.operators.panels import build_concept
from quillon.sources import annotation, fasta, sinks


def verify_sources(spark: SparkSession, panel: dict, paths: dict[str, str], strict: bool = True) -> dict[str, str]:
    """Each source's state: ok, not supplied, or how its MD5 differs from the panel's; ValueError on a difference if strict."""
    report = {}
    for name, source in panel["sources"].items():
        if name not in paths:
            report[name] = "not supplied"
            continue
        got = annotation.file_digests(spark, paths[name]).first()["md5"]
        report[name] = "ok" if got == source["md5"] else f"md5 mismatch: expected {source['md5']}, got {got}"
        if strict and report[name] != "ok":
            raise ValueError(f"{name}: {report[name]}")
    return report


def builders(spark: SparkSession, panel: dict, paths: dict[str, str], built: dict[str, DataFrame], sizes: DataFrame | None, exclude: DataFrame | None) -> dict[str, Callable[[dict], DataFrame]]:
    """What makes the intervals of each kind of derivation; built holds the concepts so far, for those that shuffle one."""

    def classes(how: dict) -> DataFrame:
        bed = annotation.read_bed(spark, paths[how["source"]], strict=True, class_column=panel["sources"][how["source"]]["class_column_0based"])
        return annotation.class_intervals(bed, how["label"] if how["kind"] == "ccre_class" else None)

    def splice(how: dict) -> DataFrame:
        return annotation.splice_sites(annotation.read_gtf(spark, paths[how["source"]], ["exon"]), how["site"], int(how["flank_bp"]))

    def starts(how: dict) -> DataFrame:
        records = annotation.not_empty(annotation.read_gtf(spark, paths[how["source"]], [how.get("feature", "transcript")]), "records")
        return annotation.transcription_starts(records, int(how["window_bp"]))

    def rich(how: dict) -> DataFrame:
        width = int(panel["bin_bp"])
        chunks = fasta.read_chunks(spark, fasta.index_fasta(spark, paths[how["source"]]), chunk=width * max(1, fasta.CHUNK // width))
        return gc_quantile_bins(chunks, width, float(how["quantile"]))

    def shuffled(how: dict) -> DataFrame:
        if sizes is None:
            raise ValueError("shuffle_of needs chromosome sizes")
        own = built[how["concept"]].select("chrom", "start", "end")
        none = own.where("false")
        return shuffle_avoiding(own, sizes, exclude if exclude is not None else none, str(how["seed"])).select("chrom", "start", "end")

    return {"ccre_class": classes, "ccre_union": classes, "gencode_splice": splice, "gencode_tss_window": starts, "gc_quantile": rich, "shuffle_of": shuffled}


def build_from_files(spark: SparkSession, panel: dict, paths: dict[str, str], out: str, sizes: str | None = None, exclude: str | None = None, only: list[str] | None = None) -> DataFrame:
    """Builds a panel's concepts and writes OUT/intervals (Parquet by concept) and OUT/NAME.bed; returns one row a concept: name, role, n, bases.

    A concept whose source wasn't given is left out. One that shuffles another
    needs that built before it. Concepts have names of their own; a concept
    without intervals is an error.
    """
    names = [c["name"] for c in panel["concepts"]]
    if len(set(names)) != len(names):
        raise ValueError("names of concepts repeat")
    if unknown := set(only or []) - set(names):
        raise ValueError(f"unknown concepts {sorted(unknown)}")
    built: dict[str, DataFrame] = {}
    make = builders(spark, panel, paths, built, annotation.read_chrom_sizes(spark, sizes) if sizes else None, annotation.read_exclude(spark, exclude) if exclude else None)
    rows = []
    for concept in panel["concepts"]:
        how, name = concept["derivation"], concept["name"]
        if (only and name not in only) or (how.get("source") and how["source"] not in paths):
            continue
        if how.get("concept") and how["concept"] not in built:
            raise ValueError(f"{name}: {how['concept']} is not built")
        found = build_concept({**how, "name": name}, make)
        path = f"{out}/intervals/concept={name}"
        found.write.mode("overwrite").parquet(path)
        built[name] = spark.read.parquet(path)  # built once: bed, sums and shuffles read what was written
        sinks.write_concept_bed(built[name], f"{out}/{name}.bed", name)
        sums = built[name].agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("end") - F.col("start")).alias("bases")).first()
        rows.append((name, concept["role"], sums["n"], sums["bases"]))
    return spark.createDataFrame(rows, "concept string, role string, n long, bases long")


def read_panel(spark: SparkSession, out: str) -> DataFrame:
    """(concept, chrom, start, end) of a built panel."""
    return spark.read.parquet(f"{out}/intervals").select("concept", "chrom", "start", "end")


def windows_from_files(spark: SparkSession, folds: str, valid: str, test: str, context: int, target: int, counts: dict[str, dict[str, int]], exclude: str | None = None, seed: str = "manifest") -> DataFrame:
    """The window manifest of a fold file: territories, tiles of context bases and dealt splits (counts: held_out and trained).

    Held out is what valid and test have beyond (context - target) / 2 of the others.
    """
    from quillon.operators.intervals import territory
    from quillon.operators.manifests import build_manifest

    cut = annotation.read_exclude(spark, exclude) if exclude else None
    regions = annotation.read_folds(spark, folds)
    held, trained = territory(regions, valid, test, (context - target) // 2, cut)
    none = cut if cut is not None else merge(held).where("false")
    return build_manifest(held, trained, none, context, counts["held_out"], counts["trained"], seed)
