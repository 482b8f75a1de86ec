"""Writers of tables, matrices, text track formats and sidecars.

Spark's commit protocol makes each written folder appear whole or not at all.
Small driver-side documents are written beside their name and then renamed.
"""

from __future__ import annotations

import json
import os
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLUE, GREY = "#2a78d6", "#8a8983"


def rgb(colour: str) -> str:
    """#rrggbb as r,g,b."""
    parts = bytes.fromhex(colour.removeprefix("#"))
    if len(parts) != 3:
        raise ValueError(f"not a colour: {colour!r}")
    return ",".join(map(str, parts))


def short_number(value: str) -> Column:
    """Six significant digits without trailing zeros; an exponent below -4 and from 6 on. Halves are rounded by their decimal digits."""
    science = F.format_string("%.5e", F.col(value).cast("double"))
    power = F.substring_index(science, "e", -1).cast("int")
    bare = lambda c: F.regexp_replace(c, r"\.?0+$", "")
    fixed = F.expr(f"format_string(concat('%.', greatest(0, 5 - CAST(substring_index(format_string('%.5e', CAST(`{value}` AS DOUBLE)), 'e', -1) AS INT)), 'f'), CAST(`{value}` AS DOUBLE))")
    plain = F.when(F.instr(fixed, ".") > 0, bare(fixed)).otherwise(fixed)
    exponent = F.concat(F.when(power < 0, "e-").otherwise("e+"), F.lpad(F.abs(power).cast("string"), F.greatest(F.lit(2), F.length(F.abs(power).cast("string"))), F.lit("0")))
    return F.when(F.col(value) == 0, "0").when(power.between(-4, 5), plain).otherwise(F.concat(bare(F.substring_index(science, "e", 1)), exponent))


def _with_header(lines: DataFrame, header: str) -> DataFrame:
    head = lines.sparkSession.range(1).select(F.lit(0).alias("part"), F.lit("").alias("chrom"), F.lit(0).cast("long").alias("start"), F.lit(header).alias("line"))
    return head.unionByName(lines.select(F.lit(1).alias("part"), "chrom", "start", "line"))


def bedgraph_lines(bins: DataFrame, name: str, description: str = "", colour: str = BLUE, drop_zeros: bool = True) -> DataFrame:
    """(part, chrom, start, line): the track line, then one line a bin (chrom, start, end, value).

    Values that aren't finite, and bins without width, fail when they are read.
    """
    v = F.col("value").cast("double")
    good = v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")) & (F.col("end") > F.col("start"))
    checked = bins.withColumn("value", F.when(good, v).otherwise(F.raise_error(F.concat(F.lit("bad bin: "), F.to_json(F.struct("chrom", "start", "end", F.col("value").cast("string"))))).cast("double")))
    rows = checked.where("value <> 0") if drop_zeros else checked
    lines = rows.select("chrom", "start", F.concat_ws("\t", "chrom", F.col("start").cast("string"), F.col("end").cast("string"), short_number("value")).alias("line"))
    return _with_header(lines, f'track type=bedGraph name="{name}" description="{description or name}" color={rgb(colour)} visibility=full autoScale=on')


def bed_lines(intervals: DataFrame, name: str, colour: str = GREY) -> DataFrame:
    """(part, chrom, start, line): the track line, then six columns an interval."""
    line = F.concat_ws("\t", "chrom", F.col("start").cast("string"), F.col("end").cast("string"), F.lit(name), F.lit("0"), F.lit("."))
    return _with_header(intervals.select("chrom", "start", line.alias("line")), f'track name="{name}" itemRgb="On" color={rgb(colour)}')


def _one_file(lines: DataFrame, path: str) -> None:
    """A track has to be one file; range partitions put it in order before."""
    lines.orderBy("part", "chrom", "start", "line").select("line").coalesce(1).write.mode("overwrite").text(path)


def write_bedgraph(bins: DataFrame, path: str, **how) -> None:
    _one_file(bedgraph_lines(bins, **how), path)


def write_bed(intervals: DataFrame, path: str, name: str, colour: str = GREY) -> None:
    _one_file(bed_lines(intervals, name, colour), path)


def write_concept_bed(intervals: DataFrame, path: str, name: str) -> int:
    """Four columns, no track line; returns the number of intervals."""
    rows = intervals.select("chrom", "start", "end", F.lit(name).alias("name"))
    rows.orderBy("chrom", "start", "end").coalesce(1).write.mode("overwrite").csv(path, sep="\t")
    return rows.count()


def write_csv(table: DataFrame, path: str) -> None:
    """A report's source table: one CSV with a header."""
    table.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_json(document: object, path: str, allow_nan: bool = False) -> None:
    """A small document, written beside its name, flushed and renamed; values that aren't finite fail unless allowed."""
    body = json.dumps(document, indent=1, sort_keys=True, allow_nan=allow_nan)
    beside = f"{path}.{uuid.uuid4().hex}"
    with open(beside, "w") as out:
        out.write(body)
        out.flush()
        os.fsync(out.fileno())
    os.replace(beside, path)


def write_matrix(matrix: np.ndarray, path: str) -> None:
    """A matrix of model size as NPY, replaced as a whole; values that aren't finite fail."""
    if not np.isfinite(matrix).all():
        raise ValueError("the matrix has values that are not finite")
    beside = f"{path}.{uuid.uuid4().hex}"
    with open(beside, "wb") as out:
        np.save(out, matrix)
    os.replace(beside, path)


def receipts(results: DataFrame, key: str, chain: str = "") -> DataFrame:
    """(key, json, sha256): one JSON line a row and the hash of its content after that of its plan (chain)."""
    body = F.to_json(F.struct(*[F.col(c) for c in results.columns]))
    return results.select(F.col(key), body.alias("json"), F.sha2(F.concat(F.lit(chain), body), 256).alias("sha256"))


def igv_track(name: str, url: str, kind: str = "wig", colour: str = BLUE) -> dict:
    return {"name": name, "url": url, "type": kind, "color": f"rgb({rgb(colour)})"}


def igv_session(genome: str, locus: str, tracks: list[dict]) -> dict:
    """A browser session; tracks need names of their own."""
    if len({t["name"] for t in tracks}) != len(tracks):
        raise ValueError("track names repeat")
    return {"genome": genome, "locus": locus, "tracks": tracks}
