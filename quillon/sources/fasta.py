"""FASTA files by ranges: byte ranges, random access by an index, and ranges that are never read.

    index = index_fasta(spark, path)
    read_chunks(spark, index, chroms=["chr1"], low=10_000_000, high=20_000_000)

A record of any length is many rows (chrom, chunk, start, bases) in many
partitions. The index has one row a record: its length, the byte of its first
base, and bases and bytes of a line, as all lines but the last have as many. It
is made by one pass over byte ranges. What isn't asked for is not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.sources.files import file_sizes, located, read_range

CHUNK = 1 << 16
RANGE_BYTES = 32 << 20
#: Partitions for each core at most, unless they would hold more than RANGE_BYTES.
PARTITIONS = 8
_BATCH = 4 << 20
_SCHEMA = "chrom string, chunk int, start long, bases string"
_NEWLINE, _HEADER = ord("\n"), ord(">")


def _plain(path: str) -> str:
    """path, if it isn't compressed: compressed files have no places that a byte range could begin at."""
    if re.search(r"\.(gz|bgz|bz2|xz|zst)$", path) or read_range(path, 0, 2) == b"\x1f\x8b":
        raise ValueError(f"compressed files can't be read by ranges: {path}")
    return path


def index_fasta(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(path, chrom, length, offset, line_bases, line_bytes) of a FASTA file or a folder of them, in the order of places.

    ValueError for compressed files. Using the index fails if a record has
    lines of unequal lengths before its last. A name ends at the first blank.
    """
    ranges = [(_plain(p), size, at) for p, size in file_sizes(path).items() for at in range(0, size, range_bytes)]
    given = spark.createDataFrame(ranges, "path string, size long, at long").repartition(max(1, len(ranges)), "path", "at")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Lines that begin in a range, as stretches of one record: their lines, bytes and first and longest line."""
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                end = min(r["size"], r["at"] + range_bytes)
                data = np.frombuffer(read_range(r["path"], r["at"], end - r["at"]), dtype=np.uint8)
                breaks = np.flatnonzero(data == _NEWLINE) + r["at"]
                before = r["at"] == 0 or read_range(r["path"], r["at"] - 1, 1) == b"\n"
                starts = np.concatenate(([r["at"]] if before else [], breaks + 1)).astype(np.int64)
                starts = starts[starts < end]
                if not len(starts):
                    continue
                last = int(starts[-1])
                tail, step = b"", 1 << 16
                while b"\n" not in tail and last + len(tail) < r["size"]:
                    tail += read_range(r["path"], last + len(tail), step)
                stop = last + (tail.index(b"\n") + 1 if b"\n" in tail else len(tail))
                ends = np.append(starts[1:], stop)
                head = data[starts - r["at"]] == _HEADER
                cuts = np.union1d([0], np.flatnonzero(head))
                for a, b in zip(cuts, np.append(cuts[1:], len(starts)), strict=True):
                    name = None
                    if head[a]:
                        line = read_range(r["path"], int(starts[a]), int(ends[a] - starts[a]))[1:]
                        name = (line.split() or [b""])[0].decode()
                        a += 1
                    size = ends[a:b] - starts[a:b]
                    rows.append((r["path"], int(starts[a - 1] if name is not None else starts[a]), name, int(b - a), int(size.sum()), int(size[0]) if b > a else None, int(size.max(initial=0)), int(starts[a]) if b > a else None, bool((size[:-1] == size.max(initial=0)).all()), int(size[-1]) if b > a else None))
            kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64()]
            names = ["path", "at", "name", "lines", "bytes", "first", "longest", "offset", "even", "last"]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    parts = given.mapInArrow(work, "path string, at long, name string, lines long, bytes long, first long, longest long, offset long, even boolean, last long")
    order = Window.partitionBy("path").orderBy("at")
    numbered = parts.withColumn("record", F.sum(F.col("name").isNotNull().cast("long")).over(order)).where("record > 0")
    own = numbered.where("lines > 0").withColumns({"final": F.row_number().over(Window.partitionBy("path", "record").orderBy(F.desc("at"))) == 1})
    width = F.max("longest")
    # All lines are of one width but the record's last, which may be shorter.
    wrong = F.max(F.when(~F.col("even") | (~F.col("final") & (F.col("last") != F.col("longest"))), 1).otherwise(0)) + F.when(F.max("longest") != F.min(F.when(F.col("final") & (F.col("lines") == 1), None).otherwise(F.col("longest"))), 1).otherwise(0)
    sums = own.groupBy("path", "record").agg(F.min("offset").alias("offset"), width.alias("line_bytes"), F.sum("bytes").alias("bytes"), F.sum("lines").alias("lines"), F.max_by("last", "at").alias("last"), F.coalesce(wrong, F.lit(0)).alias("wrong"))
    names = numbered.where("name IS NOT NULL").select("path", "record", F.col("name").alias("chrom"))
    found = names.join(sums, ["path", "record"], "left")

    def breaks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Whether lines end in one byte or two, and the last one in none, from the bytes at their ends."""
        for batch in batches:
            rows = batch.to_pylist()
            line, final = [], []
            for r in rows:
                if not r["bytes"]:
                    line.append(0)
                    final.append(0)
                    continue
                end = read_range(r["path"], r["offset"] + r["bytes"] - 2, 2) if r["bytes"] > 1 else read_range(r["path"], r["offset"], 1)
                final.append(2 if end == b"\r\n" else 1 if end.endswith(b"\n") else 0)
                first = read_range(r["path"], r["offset"] + r["line_bytes"] - 2, 2) if r["line_bytes"] > 1 else b""
                line.append((2 if first == b"\r\n" else 1) if r["lines"] > 1 else final[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(line, pa.int64()), pa.array(final, pa.int64())], [*batch.schema.names, "break_bytes", "last_break"])

    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in found.schema)
    seen = found.mapInArrow(breaks, f"{kind}, break_bytes long, last_break long")
    bad = F.raise_error(F.concat(F.lit("lines of unequal lengths in "), F.col("chrom"))).cast("long")
    length = F.when(F.coalesce(F.col("wrong"), F.lit(0)) > 0, bad).otherwise(F.coalesce(F.col("bytes") - F.col("break_bytes") * (F.col("lines") - 1) - F.col("last_break"), F.lit(0)))
    return seen.select("path", "chrom", length.alias("length"), F.coalesce("offset", F.lit(0)).alias("offset"), F.coalesce(F.col("line_bytes") - F.col("break_bytes"), F.lit(0)).alias("line_bases"), F.coalesce("line_bytes", F.lit(0)).alias("line_bytes"))


def read_chunks(spark: SparkSession, index: DataFrame, chunk: int = CHUNK, range_bytes: int = RANGE_BYTES, chroms: Iterable[str] | None = None, low: int = 0, high: int | None = None) -> DataFrame:
    """(chrom, chunk, start, bases) of indexed FASTA files, upper case.

    chroms, low and high: the records and bases asked for; other chunks are not
    read. A stretch of up to range_bytes bases of a record is one row of work.
    Stretches that lie together in a file go to one partition, as many as fill
    range_bytes, or more where that would make over PARTITIONS for each core.
    The index stays on the executors; it is persisted, as it is read twice.
    """
    step = max(1, range_bytes // chunk)
    own = index if chroms is None else index.where(F.col("chrom").isin(list(chroms)))
    until = F.col("length") if high is None else F.least(F.col("length"), F.lit(high))
    first, last = F.lit(max(0, low // chunk)).cast("long"), F.ceil(until / chunk)
    asked = own.withColumns({"first": first, "last": last}).where("first < last").persist()
    bases = asked.agg(F.coalesce(F.sum((F.col("last") - F.col("first")) * chunk), F.lit(0))).first()[0]
    most = max(-(-bases // RANGE_BYTES), PARTITIONS * spark.sparkContext.defaultParallelism)
    parts = max(1, min(-(-bases // range_bytes), most))
    begins = F.explode(F.sequence(F.col("first"), F.col("last") - 1, F.lit(step).cast("long")))
    stretches = asked.withColumn("a", begins).withColumn("b", F.least(F.col("a") + step, F.col("last")))
    byte = F.col("offset") + F.floor(F.col("a") * chunk / F.greatest("line_bases", F.lit(1))) * F.col("line_bytes")
    at = F.pmod(F.floor(byte / max(range_bytes, -(-bases // parts))) + F.hash("path"), F.lit(parts)).cast("int")
    dealt = stretches.select("path", "chrom", "length", "offset", "line_bases", "line_bytes", "a", "b", at.alias("at")).repartitionById(parts, "at").sortWithinPartitions("path", "offset", "a")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, source = None, None
        rows: list[tuple[str, int, int, str]] = []
        size = 0
        for batch in batches:
            for r in batch.to_pylist():
                if r["path"] != path:
                    if source is not None:
                        source.close()
                    path = r["path"]
                    files, name = located(path)
                    source = files.open_input_file(name)
                place = lambda x: r["offset"] + x // r["line_bases"] * r["line_bytes"] + x % r["line_bases"]  # noqa: B023, E731
                for k in range(r["a"], r["b"]):
                    a, b = k * chunk, min(r["length"], (k + 1) * chunk)
                    raw = source.read_at(place(b - 1) + 1 - place(a), place(a))
                    rows.append((r["chrom"], k, a, raw.translate(None, b"\r\n").decode("ascii").upper()))
                    size += b - a
                    if size > _BATCH or len(rows) >= 10_000:
                        yield _chunks(rows)
                        rows, size = [], 0
        if rows:
            yield _chunks(rows)
        if source is not None:
            source.close()

    return dealt.mapInArrow(work, _SCHEMA)


def _chunks(rows: list[tuple[str, int, int, str]]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, (pa.string(), pa.int32(), pa.int64(), pa.string()), strict=True)], ["chrom", "chunk", "start", "bases"])


def chrom_sizes(index: DataFrame) -> DataFrame:
    """(chrom, size) of indexed files; no sequence is read."""
    return index.select("chrom", F.col("length").alias("size"))


def chrom_file(folder: str, chrom: str) -> str:
    """The file of one chromosome in a folder of such: NAME.fa or NAME.fasta, with or without chr before the name."""
    bare = chrom.removeprefix("chr")
    names = [f"{n}.{e}" for n in dict.fromkeys((chrom, f"chr{bare}", bare)) for e in ("fa", "fasta")]
    for path in file_sizes(folder):
        if path.rsplit("/", 1)[-1] in names:
            return path
    raise FileNotFoundError(f"no file of {chrom} in {folder}: {names}")


def read_chrom(spark: SparkSession, folder: str, chrom: str, chunk: int = CHUNK) -> DataFrame:
    """The chunks of one chromosome from its own file; its record has to be the file's only one."""
    index = index_fasta(spark, chrom_file(folder, chrom))
    if index.count() != 1:
        raise ValueError(f"the file of {chrom} has other records too")
    return read_chunks(spark, index.withColumn("chrom", F.lit(chrom)), chunk)
