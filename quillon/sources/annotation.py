"""Readers of annotation text files (plain or gzip): one row a record, nothing collected."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.operators.intervals import merge
from quillon.operators.validators import check_coordinates, mask_values


def _lines(spark: SparkSession, path: str, skip: str) -> DataFrame:
    return spark.read.text(path).where(~F.col("value").rlike(skip) & (F.trim("value") != ""))


def read_bed(spark: SparkSession, path: str, strict: bool = False, class_column: int | None = None) -> DataFrame:
    """(chrom, start, end[, concept]) of a BED file.

    Lenient: skips lines that begin with # or t and records without two
    numbers. Strict: fails on short records and on end <= start. A class
    column (-1: the last) is split at commas into one row a concept; . and
    blanks don't count.
    """
    lines = _lines(spark, path, "^(#|track|browser)" if strict else "^[#t]")
    f = F.split("value", "\t")
    number = lambda i: F.try_to_number(F.trim(F.get(f, F.lit(i))), F.lit("999999999999")).cast("long")
    rows = lines.select(F.get(f, F.lit(0)).alias("chrom"), number(1).alias("start"), number(2).alias("end"), f.alias("f"))
    if strict:
        ok = F.col("start").isNotNull() & F.col("end").isNotNull() & (F.col("end") > F.col("start"))
        rows = rows.withColumn("end", F.when(ok, F.col("end")).otherwise(F.raise_error(F.concat(F.lit("bad record: "), F.array_join("f", " "))).cast("long")))
    else:
        rows = rows.where("start IS NOT NULL AND end IS NOT NULL")
    if class_column is None:
        return rows.drop("f")
    given = F.element_at("f", -1) if class_column < 0 else F.get("f", F.lit(class_column))
    named = rows.select("chrom", "start", "end", F.explode(F.split(given, ",")).alias("concept")).withColumn("concept", F.trim("concept"))
    return named.where("concept <> '' AND concept <> '.'")


def not_empty(frame: DataFrame, what: str) -> DataFrame:
    """frame, if it has a row."""
    if not frame.limit(1).count():
        raise ValueError(f"no {what}")
    return frame


def class_intervals(bed: DataFrame, label: str | None) -> DataFrame:
    """Merged intervals of one class of read_bed's rows, or of all; fails if there are none."""
    own = bed if label is None else bed.where(F.col("concept") == label)
    return merge(not_empty(own, f"intervals of {label or 'any class'}").select("chrom", "start", "end"))


def read_annotation(spark: SparkSession, path: str, width: int, mask: str = "n_mask") -> DataFrame:
    """Bins of a Parquet table with checked coordinates and the mask as booleans."""
    rows = spark.read.parquet(path)
    if mask not in rows.columns:
        raise ValueError(f"no column {mask}")
    return check_coordinates(rows, width).withColumn(mask, mask_values(F.col(mask)))


def read_exclude(spark: SparkSession, path: str) -> DataFrame:
    """The first three columns of a BED file, merged."""
    return merge(read_bed(spark, path))


def read_chrom_sizes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", schema="chrom string, size long").where("size IS NOT NULL")


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """A CSV of results with a header, types inferred."""
    return spark.read.option("header", True).option("inferSchema", True).csv(path)


def first_exons(records: DataFrame) -> DataFrame:
    """Exons numbered 1, quoted or not."""
    return records.where("feature = 'exon' AND exon_number = 1")


def read_sources(path: str, known: set[str], assembly: str = "GRCh38") -> dict[str, dict]:
    """Source files by concept from a JSON manifest of one assembly; unknown concepts fail."""
    with open(path) as f:
        manifest = json.load(f)
    if manifest.get("assembly") != assembly:
        raise ValueError(f"assembly {manifest.get('assembly')!r}, not {assembly}")
    if unknown := sorted(set(manifest["sources"]) - known):
        raise ValueError(f"unknown concepts {unknown}")
    return manifest["sources"]


def check_files(spark: SparkSession, path: str, expected: dict[str, str]) -> None:
    """Files of a folder against expected digests by name (MD5 or SHA-256, told apart by length)."""
    found = {r["path"].rsplit("/", 1)[-1]: r for r in file_digests(spark, path).collect()}  # the manifest's files
    wrong = [n for n, want in expected.items() if n not in found or want.lower() not in (found[n]["md5"], found[n]["sha256"])]
    if wrong:
        raise ValueError(f"missing or different files: {sorted(wrong)}")


def read_folds(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, start, end, fold); fails on folds other than fold0 to fold7, and on an empty file."""
    rows = not_empty(spark.read.csv(path, sep="\t", schema="chrom string, start long, end long, fold string"), "folds")
    known = F.col("fold").rlike("^fold[0-7]$")
    return rows.withColumn("fold", F.when(known, F.col("fold")).otherwise(F.raise_error(F.concat(F.lit("unknown fold "), F.coalesce("fold", F.lit("null"))))))


def read_gtf(spark: SparkSession, path: str, features: list[str] | None = None) -> DataFrame:
    """GTF records as 0-based half-open intervals, with gene, transcript and exon number, and all attributes as lists."""
    f = F.split("value", "\t")
    rows = _lines(spark, path, "^#").select(F.get(f, F.lit(0)).alias("chrom"), F.get(f, F.lit(2)).alias("feature"), (F.get(f, F.lit(3)).cast("long") - 1).alias("start"), F.get(f, F.lit(4)).cast("long").alias("end"), F.get(f, F.lit(6)).alias("strand"), F.get(f, F.lit(8)).alias("attributes"))
    if features is not None:
        rows = not_empty(rows.where(F.col("feature").isin(features)), f"records of {features}")
    one = lambda key: F.nullif(F.regexp_extract("attributes", f'{key} "?([^";]*)"?', 1), F.lit(""))
    return rows.withColumns({"gene": one("gene_id"), "transcript": one("transcript_id"), "exon_number": one("exon_number").cast("int")})


def gtf_attributes(records: DataFrame) -> DataFrame:
    """records with pairs: map of each key to the list of its values."""
    pairs = F.arrays_zip(F.regexp_extract_all("attributes", F.lit(r'(\w+) "?([^";]*)"?'), 1).alias("k"), F.regexp_extract_all("attributes", F.lit(r'(\w+) "?([^";]*)"?'), 2).alias("v"))
    keys = F.array_distinct(F.transform(pairs, lambda p: p["k"]))
    lists = F.transform(keys, lambda k: F.transform(F.filter(pairs, lambda p: p["k"] == k), lambda p: p["v"]))
    return records.withColumn("pairs", F.map_from_arrays(keys, lists))


def transcription_starts(records: DataFrame, window: int) -> DataFrame:
    """Merged windows around the first base of each record: start on +, end - 1 on -."""
    site = F.when(F.col("strand") == "+", F.col("start")).otherwise(F.col("end") - 1)
    return merge(records.select("chrom", F.greatest(site - window, F.lit(0)).alias("start"), (site + window + 1).alias("end")))


def splice_sites(exons: DataFrame, site: str, flank: int) -> DataFrame:
    """Merged flanks of intron ends: donor or acceptor, by strand."""
    order = Window.partitionBy("transcript").orderBy("start")
    gaps = exons.select("chrom", "strand", F.col("end").alias("left"), F.lead("start").over(order).alias("right")).where("right > left")
    gaps = not_empty(gaps, "introns")
    first = (F.col("strand") == "+") if site == "donor" else (F.col("strand") == "-")
    at = F.when(first, F.col("left")).otherwise(F.col("right"))
    return merge(gaps.select("chrom", F.greatest(at - flank, F.lit(0)).alias("start"), (at + flank).alias("end")))


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, sequence) of a FASTA file, upper case; the name ends at the first blank. One row a record."""
    records = spark.read.option("lineSep", ">").text(path).where(F.trim("value") != "")
    head = F.substring_index("value", "\n", 1)
    body = F.substring(F.col("value"), F.length(head) + 2, F.length("value"))
    return records.select(F.regexp_extract(head, r"^(\S+)", 1).alias("chrom"), F.upper(F.regexp_replace(body, r"\s", "")).alias("sequence"))


def chunks(sequences: DataFrame, size: int = 1 << 16) -> DataFrame:
    """(chrom, chunk, bases) of (chrom, sequence): pieces of one size, cut in one pass."""
    parts = F.regexp_extract_all("sequence", F.lit(f"(?s).{{1,{size}}}"), F.lit(0))
    return sequences.select("chrom", F.posexplode(parts).alias("chunk", "bases"))


def fetch(sequences: DataFrame, places: DataFrame, size: int = 1 << 16) -> DataFrame:
    """places (chrom, start, end, ...) with their bases; N beyond the sequence's end, null for an unknown chrom.

    Places meet only the chunks that they touch (equi join), so that no
    sequence is copied to its places.
    """
    cut = chunks(sequences, size).withColumnRenamed("bases", "__part")
    known = sequences.select("chrom", F.lit(True).alias("__known")).distinct()
    own = places.withColumn("__place", F.struct(*[F.col(c) for c in places.columns]))
    touched = own.withColumn("chunk", F.explode(F.sequence(F.floor(F.col("start") / size).cast("int"), F.floor((F.greatest(F.col("end"), F.col("start") + 1) - 1) / size).cast("int"))))
    low = F.greatest(F.col("start") - F.col("chunk") * F.lit(size).cast("long"), F.lit(0))
    high = F.least(F.col("end") - F.col("chunk") * F.lit(size).cast("long"), F.lit(size))
    piece = F.substring("__part", (low + 1).cast("int"), (high - low).cast("int"))
    joined = touched.join(cut, ["chrom", "chunk"], "left").select("chrom", "__place", F.struct("chunk", piece.alias("bases")).alias("p"))
    joined = joined.groupBy("chrom", "__place").agg(F.sort_array(F.collect_list("p")).alias("p"), F.count("*").alias("__n"))  # the pieces of one place
    width = (F.col("__place.end") - F.col("__place.start")).cast("int")
    bases = F.rpad(F.array_join(F.transform("p", lambda x: F.coalesce(x["bases"], F.lit(""))), ""), width, F.lit("N"))
    found = joined.join(known, "chrom", "left")
    return found.select(*[F.col(f"__place.{c}").alias(c) for c in places.columns], F.when(F.col("__known"), bases).alias("bases"))


def read_matrices(spark: SparkSession, path: str) -> DataFrame:
    """(matrix_id, name, pos, base, w) of a file of count matrices: >id name and four rows of numbers."""
    records = spark.read.option("lineSep", ">").text(path).where(F.trim("value") != "")
    lines = F.filter(F.split("value", "\n"), lambda x: (F.trim(x) != "") & ~x.startswith("#"))
    parts = records.select(lines.alias("l")).select(F.split(F.trim(F.get("l", F.lit(0))), r"\s+").alias("h"), F.slice("l", 2, 4).alias("rows"))
    ok = F.when(F.size("rows") == 4, F.col("rows")).otherwise(F.raise_error(F.concat(F.lit("not four rows: "), F.get("h", F.lit(0)))).cast("array<string>"))
    rows = parts.select(F.get("h", F.lit(0)).alias("matrix_id"), F.coalesce(F.get("h", F.lit(1)), F.get("h", F.lit(0))).alias("name"), F.posexplode(ok).alias("row", "line"))
    numbers = F.regexp_extract_all(F.regexp_replace("line", r"^\s*[ACGT]", ""), F.lit(r"(-?\d+\.?\d*)"), 1)
    base = F.element_at(F.array(*[F.lit(b) for b in "ACGT"]), F.col("row") + 1)
    return rows.select("matrix_id", "name", base.alias("base"), F.posexplode(numbers).alias("pos", "w")).select("matrix_id", "name", "pos", "base", F.col("w").cast("double").alias("w"))


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, md5, sha256) of whole files."""
    return spark.read.format("binaryFile").load(path).select("path", F.md5("content").alias("md5"), F.sha2("content", 256).alias("sha256"))
