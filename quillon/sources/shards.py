"""Activation matrices as NPY shards, with digests of their rows, as a data source.

    write_shards(rows, folder)
    read_shards(spark, folder, tap="t", split="test")

A folder has one NPY file a shard (rows by channels, float16 or float32) and
index.parquet, with a row for each block of BLOCK rows of a shard: tap, split,
shard, first row, rows, channels, type, byte of its first value and the SHA-256
of its bytes. A read takes whole blocks by byte range and fails where the bytes
aren't those of the index, so a changed value is found by whoever reads it.
Blocks that aren't asked for are not read.
"""

from __future__ import annotations

import hashlib
import io
import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quillon.operators.orders import before
from quillon.sources.files import located

BLOCK = 4096
_SCHEMA = "tap string, split string, shard int, row long, vec array<float>"
_INDEX = "tap string, split string, shard int, file string, first long, rows long, channels long, kind string, at long, sha256 string"


def _matrix(vectors: pa.Array, kind: str) -> np.ndarray:
    """Vectors of one length as a matrix; ValueError for nulls, other lengths and values that aren't finite in that type."""
    n = len(vectors)
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(kind)
    if vectors.null_count or len(flat) % max(n, 1) or not np.isfinite(flat).all():
        raise ValueError("vectors are null, of several lengths or not finite")
    width = len(flat) // max(n, 1)
    if (np.diff(vectors.offsets.to_numpy()) != width).any():
        raise ValueError("vectors are of several lengths")
    return flat.reshape(n, width)


def write_shards(rows: DataFrame, folder: str, kind: str = "float16", block: int = BLOCK) -> DataFrame:
    """Writes rows (tap, split, shard, row, vec), row counting from 0 in each shard; returns the index.

    A shard is one file and is written by one task, a block at a time, under a
    name of its own, so that a repeated task leaves no half file behind. Rows of
    a shard have to be numbered without gaps: the index fails otherwise.
    """
    own = rows.select("tap", "split", F.col("shard").cast("int").alias("shard"), F.col("row").cast("long").alias("row"), F.col("vec").cast("array<float>").alias("vec"))
    dealt = own.repartition("tap", "split", "shard").sortWithinPartitions("tap", "split", "shard", "row")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = located(folder)
        files.create_dir(root, recursive=True)
        state: dict = {}

        def flush() -> list[tuple]:
            table = pa.concat_tables(state["held"]).combine_chunks()
            matrix = _matrix(table.column("vec").chunk(0), kind)
            numbers = table.column("row").to_numpy()
            if (numbers != state["first"] + np.arange(len(numbers))).any():
                raise ValueError(f"rows of shard {state['key']} are not 0, 1, 2, ...")
            raw = matrix.tobytes()
            if state["out"] is None:
                state["width"] = matrix.shape[1]
                state["out"] = files.open_output_stream(state["part"])
                state["out"].write(bytes(state["head"]))
            elif matrix.shape[1] != state["width"]:
                raise ValueError("vectors are of several lengths")
            state["out"].write(raw)
            row = (*state["key"], state["name"], state["first"], len(numbers), state["width"], kind, state["at"], hashlib.sha256(raw).hexdigest())
            state["first"] += len(numbers)
            state["at"] += len(raw)
            state["held"], state["n"] = [], 0
            return [row]

        def close() -> list[tuple]:
            if not state:
                return []
            found = flush() if state["n"] else []
            state["out"].close()
            # The header has the number of rows, known only now: the file is copied behind it by range.
            sink = io.BytesIO()
            np.lib.format.write_array_header_2_0(sink, {"descr": np.dtype(kind).str, "fortran_order": False, "shape": (state["first"], state["width"])})
            head = sink.getvalue()
            if len(head) > state["head"]:
                raise ValueError("the header is too long")
            with files.open_input_file(state["part"]) as source, files.open_output_stream(state["final"]) as out:
                body = head[:8] + (state["head"] - 12).to_bytes(4, "little") + head[12:-1] + b" " * (state["head"] - len(head)) + b"\n"
                out.write(body)
                source.seek(state["head"])
                while piece := source.read(1 << 24):
                    out.write(piece)
            files.delete_file(state["part"])
            state.clear()
            return found

        for batch in batches:
            table = pa.Table.from_batches([batch])
            keys = list(zip(*(batch.column(c).to_pylist() for c in ("tap", "split", "shard")), strict=True))
            cuts = [0, *[i for i in range(1, len(keys)) if keys[i] != keys[i - 1]], len(keys)]
            found: list[tuple] = []
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if state and state["key"] != keys[a]:
                    found += close()
                if not state:
                    tap, split, shard = keys[a]
                    name = f"{tap}-{split}-{shard:06d}.npy"
                    state |= {"key": keys[a], "name": name, "part": f"{root}/.{name}.part", "final": f"{root}/{name}", "out": None, "first": 0, "held": [], "n": 0, "head": 256, "at": 256, "width": 0}
                while a < b:
                    take = min(b - a, block - state["n"])
                    state["held"].append(table.slice(a, take))
                    state["n"] += take
                    a += take
                    if state["n"] == block:
                        found += flush()
            yield _index_rows(found)
        yield _index_rows(close())

    dealt.mapInArrow(work, _INDEX).write.mode("overwrite").parquet(f"{folder}/index.parquet")
    return rows.sparkSession.read.parquet(f"{folder}/index.parquet")


def _index_rows(found: list[tuple]) -> pa.RecordBatch:
    names = [x.split()[0] for x in _INDEX.split(", ")]
    kinds = [{"string": pa.string(), "int": pa.int32(), "long": pa.int64()}[x.split()[1]] for x in _INDEX.split(", ")]
    columns = list(zip(*found, strict=True)) if found else [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


@dataclass
class ShardRange(InputPartition):
    blocks: list[dict]


class ShardReader(DataSourceReader):
    def __init__(self, folder: str, index: list[dict], partition_bytes: int):
        self.folder, self.index, self.partition_bytes = folder, index, partition_bytes

    def partitions(self) -> list[ShardRange]:
        found, held, size = [], [], 0
        for r in self.index:
            own = r["rows"] * r["channels"] * np.dtype(r["kind"]).itemsize
            if held and size + own > self.partition_bytes:
                found.append(ShardRange(held))
                held, size = [], 0
            held.append(r)
            size += own
        return [*found, ShardRange(held)]

    def read(self, partition: ShardRange) -> Iterator[pa.RecordBatch]:
        files, root = located(self.folder)
        for r in partition.blocks:
            size = r["rows"] * r["channels"] * np.dtype(r["kind"]).itemsize
            with files.open_input_file(f"{root}/{r['file']}") as source:
                raw = source.read_at(size, r["at"])
            if hashlib.sha256(raw).hexdigest() != r["sha256"]:
                raise ValueError(f"{r['file']} differs from the index in rows {r['first']} to {r['first'] + r['rows'] - 1}")
            values = np.frombuffer(raw, dtype=r["kind"]).astype(np.float32)
            n = r["rows"]
            vec = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * r["channels"], pa.int32()), pa.array(values))
            yield pa.RecordBatch.from_arrays([pa.array([r["tap"]] * n), pa.array([r["split"]] * n), pa.array([r["shard"]] * n, pa.int32()), pa.array(r["first"] + np.arange(n), pa.int64()), vec], ["tap", "split", "shard", "row", "vec"])


class ShardSource(DataSource):
    """Options: path (the folder), index (JSON rows of the index), partition_bytes."""

    @classmethod
    def name(cls) -> str:
        return "npy_shards"

    def schema(self) -> str:
        return _SCHEMA

    def reader(self, schema: object) -> ShardReader:
        return ShardReader(self.options["path"], json.loads(self.options["index"]), int(self.options.get("partition_bytes", 32 << 20)))


def read_shards(spark: SparkSession, folder: str, tap: str | None = None, split: str | None = None, shards: int | None = None, rows: tuple[int, int] | None = None, partition_bytes: int = 32 << 20) -> DataFrame:
    """(tap, split, shard, row, vec) of a folder of shards, or of one tap and split, or of the blocks of a range of row numbers.

    ValueError if the index has gaps or overlaps in a shard's rows, a file
    twice, or another number of shards than asked for. The index has a row for
    each block of rows and goes through the driver.
    """
    index = spark.read.parquet(f"{folder}/index.parquet")
    for name, value in (("tap", tap), ("split", split)):
        index = index if value is None else index.where(F.col(name) == value)
    keyed = index.withColumn("__shard", F.concat_ws("|", "tap", "split", F.col("shard").cast("string")))
    placed = before(keyed.groupBy("__shard", "first").agg(F.sum("rows").alias("rows"), F.count(F.lit(1)).alias("n")), ("__shard",), "first", {"sum": ("sum", "rows")})
    if wrong := placed.where("n > 1 OR sum <> first").select("__shard").distinct().count():
        raise ValueError(f"{wrong} shards have gaps or rows twice")
    have = keyed.select("__shard").distinct().count()
    if shards is not None and have != shards:
        raise ValueError(f"{have} of {shards} shards are finished")
    spark.dataSource.register(ShardSource)
    index = index if rows is None else index.where((F.col("first") + F.col("rows") > rows[0]) & (F.col("first") < rows[1]))
    blocks = [r.asDict() for r in index.orderBy("tap", "split", "shard", "first").collect()]
    found = spark.read.format("npy_shards").option("path", folder).option("index", json.dumps(blocks)).option("partition_bytes", str(partition_bytes)).load()
    return found if rows is None else found.where((F.col("row") >= rows[0]) & (F.col("row") < rows[1]))
