"""Media columns over content-addressed payloads in tar shards.

A payload is stored once, under its SHA-256, as a grey-scale PNG of 8-bit
samples, 64 to a row, in a tar shard of the shared folder. Rows carry digest,
shard, offset and length only. Metadata columns come from range reads of the
PNG's first 33 bytes; whole payloads are read back only for features.

The task that reads a text writes its payload, once for each digest that the
task sees, so that no payload is shuffled. Of the places where several tasks
stored one digest, one is chosen for all rows. Every attempt of a task writes
files of its own, and only the rows of the attempt that counts name them, so
that a lost executor leaves unused files at most.
"""

from __future__ import annotations

import hashlib
import io
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.bpe import slices
from quillon.llm.common import cut_lineage, remove, scratch

ROW = 64
SHARD_BYTES = 64 << 20
#: Stored bytes that one task reads back.
RANGE_BYTES = 8 << 20
HEADER_BYTES = 33
_SIGNATURE = b"\x89PNG\r\n\x1a\n"


def pad(payload: bytes) -> bytes:
    """Bytes 0 up to the next multiple of ROW; an empty payload gets one row."""
    return payload + bytes(max(ROW, -(-len(payload) // ROW) * ROW) - len(payload))


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def to_png(payload: bytes) -> bytes:
    """A padded payload as an 8-bit grey PNG without filters."""
    height = len(payload) // ROW
    rows = np.zeros((height, ROW + 1), dtype=np.uint8)
    rows[:, 1:] = np.frombuffer(payload, dtype=np.uint8).reshape(height, ROW)
    return _SIGNATURE + _chunk(b"IHDR", struct.pack(">IIBBBBB", ROW, height, 8, 0, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), 6)) + _chunk(b"IEND", b"")


def png_header(head: bytes) -> tuple[int, int, int]:
    """Width, height and sample bits from a PNG's first 33 bytes."""
    if head[:8] != _SIGNATURE or head[12:16] != b"IHDR":
        raise ValueError("not a PNG")
    width, height, bits = struct.unpack(">IIB", head[16:25])
    return width, height, bits


def from_png(media: bytes) -> bytes:
    """The payload of a PNG made by to_png; checks lengths and checksums."""
    width, height, _ = png_header(media)
    at, data = 8, b""
    while at < len(media):
        (n,) = struct.unpack(">I", media[at : at + 4])
        kind, body = media[at + 4 : at + 8], media[at + 8 : at + 8 + n]
        if zlib.crc32(kind + body) != struct.unpack(">I", media[at + 8 + n : at + 12 + n])[0]:
            raise ValueError("PNG checksum")
        data += body if kind == b"IDAT" else b""
        at += 12 + n
    rows = np.frombuffer(zlib.decompress(data), dtype=np.uint8).reshape(height, width + 1)
    if rows[:, 0].any():
        raise ValueError("PNG filter")
    return rows[:, 1:].tobytes()


def feature(payload: bytes) -> str:
    """Mean, spread, byte entropy and the most frequent samples of a payload, four at most, the lower of equals first."""
    x = np.frombuffer(payload, dtype=np.uint8)
    counts = np.bincount(x, minlength=256)
    p = counts[counts > 0] / len(x)
    top = np.lexsort((np.arange(256), -counts))[: min(4, len(p))]
    return f"mean={x.mean():.4f};std={x.std():.4f};entropy={-(p * np.log2(p)).sum():.4f};top={'/'.join(map(str, top.tolist()))}"


def payload_of(text: Column) -> Column:
    """The padded UTF-8 bytes of a text column; null counts as empty."""
    whole = F.coalesce(text, F.lit("")).cast("binary")
    size = F.octet_length(whole)
    return F.rpad(whole, (F.greatest(F.lit(1), F.ceil(size / ROW)) * ROW).cast("int"), F.lit(b"\0"))


class _Shards:
    """Writes tar shards under a folder; add returns where a member's bytes are."""

    def __init__(self, folder: str, limit: int):
        self.files, self.root = pyarrow.fs.FileSystem.from_uri(folder)
        self.files.create_dir(self.root, recursive=True)
        self.limit, self.out = limit, None

    def add(self, name: str, data: bytes) -> tuple[str, int]:
        if self.out is None or self.at + len(data) > self.limit:
            self.close()
            self.name, self.at = f"{uuid.uuid4().hex}.tar", 0
            self.out = self.files.open_output_stream(f"{self.root}/{self.name}")
        info = tarfile.TarInfo(name)
        info.size = len(data)
        head = info.tobuf(tarfile.USTAR_FORMAT)
        start = self.at + len(head)
        self.out.write(head + data + bytes(-len(data) % 512))
        self.at = start + len(data) + -len(data) % 512
        return self.name, start

    def close(self) -> None:
        if self.out is not None:
            self.out.write(bytes(1024))
            self.out.close()
            self.out = None


def store(docs: DataFrame, folder: str, text: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Stores payloads, one a task and digest; returns (digest, shard, offset, length), one row a digest, by shard and offset.

    The digest is that of the padded payload. Equal texts, repeated rows and
    null next to empty texts share one member. An empty table stores nothing.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards, seen = _Shards(folder, shard_bytes), set()
        for batch in batches:
            for _, run in slices(batch, "__text"):
                rows = []
                for raw in run:
                    payload = pad(raw)
                    digest = hashlib.sha256(payload).digest()
                    if digest not in seen:
                        seen.add(digest)
                        media = to_png(payload)
                        rows.append((digest, *shards.add(f"{digest.hex()}.png", media), len(media)))
                kinds = (pa.binary(), pa.string(), pa.int64(), pa.int64())
                columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["digest", "shard", "offset", "length"])
        shards.close()

    written = docs.select(F.col(f"`{text}`").alias("__text")).mapInArrow(write, "digest binary, shard string, offset long, length long")
    members = cut_lineage(written)
    total = members.agg(F.sum("length").alias("n")).first()["n"] or 0
    places = members.groupBy("digest").agg(F.min(F.struct("shard", "offset", "length")).alias("at"))
    # Reading is dealt by bytes of the shards, not by rows of the index.
    parts = max(1, -(-total // RANGE_BYTES))
    return places.select("digest", "at.*").repartition(parts, F.col("shard"), F.floor(F.col("offset") / RANGE_BYTES)).sortWithinPartitions("shard", "offset")


def _ranges(folder: str, batch: pa.RecordBatch, most: int | None = None) -> Iterator[bytes]:
    """The bytes of each row's range, or the first most of them."""
    files, root = pyarrow.fs.FileSystem.from_uri(folder)
    name, source = None, None
    for shard, start, n in zip(*(batch.column(c).to_pylist() for c in ("shard", "offset", "length")), strict=True):
        if shard != name:
            if source is not None:
                source.close()
            name, source = shard, files.open_input_file(f"{root}/{shard}")
        yield source.read_at(n if most is None else min(n, most), start)
    if source is not None:
        source.close()


def describe(index: DataFrame, folder: str) -> DataFrame:
    """Adds width, height and bits, reading each member's header only."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [png_header(head) for head in _ranges(folder, batch, HEADER_BYTES)]
            columns = [pa.array([f[i] for f in found], pa.int32()) for i in range(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, "width", "height", "bits"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in index.schema)
    return index.mapInArrow(work, f"{schema}, width int, height int, bits int")


def features(index: DataFrame, folder: str) -> DataFrame:
    """Adds payload_bytes, payload_sha256, tail_crc32, feature and media_sha256 from the stored bytes, read back whole."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for media in _ranges(folder, batch):
                payload = from_png(media)
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-ROW:]), feature(payload), hashlib.sha256(media).hexdigest()))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string())
            columns = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, "payload_bytes", "payload_sha256", "tail_crc32", "feature", "media_sha256"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in index.schema)
    return index.mapInArrow(work, f"{schema}, payload_bytes long, payload_sha256 string, tail_crc32 long, feature string, media_sha256 string")


def media_columns(docs: DataFrame, id: str = "doc_id", text: str = "text", folder: str | None = None) -> DataFrame:
    """Per row: id, n_bytes and the stored payload's place (folder, shard, offset, length), header and features.

    folder: where the shards go (a new one in the shared folder if None). They
    stay there for the rows that point into them; discard(rows) removes them.
    Null and empty texts have n_bytes 0 and share one padded payload. Repeated
    rows and equal texts get equal values; ids of any type, null too, go
    through, other columns of docs, whatever their names, don't. A text of any
    length is one member, which a task holds whole. An empty table gives an
    empty result and no shard.
    """
    folder = folder or scratch(docs.sparkSession, "media")
    rows = docs.select(F.col(f"`{id}`").alias("__id"), F.octet_length(F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary")).cast("long").alias("n_bytes"), F.unhex(F.sha2(payload_of(F.col(f"`{text}`")), 256)).alias("digest"))
    found = features(describe(store(docs, folder, text), folder), folder)
    return rows.join(found, "digest").withColumns({id: F.col("__id"), "folder": F.lit(folder)}).drop("__id")


def fetch(rows: DataFrame) -> DataFrame:
    """rows of media_columns (any columns; folder, shard, offset, length) with media, the member's bytes, read by range."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[bytes] = [b""] * batch.num_rows
            folders = batch.column("folder").to_pylist()
            for one in sorted(set(folders)):
                own = pa.array([i for i, f in enumerate(folders) if f == one])
                for i, media in zip(own.to_pylist(), _ranges(one, batch.take(own)), strict=True):
                    found[i] = media
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.binary())], names=[*batch.schema.names, "media"])

    rows = rows.drop("media")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(work, f"{schema}, media binary")


def discard(rows: DataFrame) -> None:
    """Removes the shards that rows of media_columns point to; the rows' other columns stay of use."""
    for r in rows.select("folder").distinct().collect():  # one a run of media_columns
        remove(rows.sparkSession, r["folder"])
