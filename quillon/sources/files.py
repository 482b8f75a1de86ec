"""Byte ranges of files in any store that pyarrow opens, and a folder for files that tasks share."""

from __future__ import annotations

import re
import tempfile
import uuid

import pyarrow.fs
from pyspark.sql import SparkSession


def located(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a path or URI, and the path within it."""
    path = re.sub(r"^file:/+", "/", path)
    return pyarrow.fs.FileSystem.from_uri(path) if "://" in path else (pyarrow.fs.LocalFileSystem(), path)


def read_range(path: str, start: int, size: int) -> bytes:
    files, name = located(path)
    with files.open_input_file(name) as source:
        return source.read_at(size, start)


def file_sizes(path: str) -> dict[str, int]:
    """Files of a folder (or the one file) with their bytes, in order of name; hidden files and markers aside."""
    files, name = located(path)
    info = files.get_file_info(name)
    if info.type == pyarrow.fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.is_file else files.get_file_info(pyarrow.fs.FileSelector(name, recursive=True))
    prefix = path[: path.index("://") + 3] + path.split("://", 1)[1].split("/", 1)[0] + "/" if "://" in path and not path.startswith("file:") else ""
    return {prefix + f.path.lstrip("/") if prefix else f.path: f.size for f in sorted(found, key=lambda f: f.path) if f.is_file and not re.match(r"[._]", f.base_name)}


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share (spark.checkpoint.dir); a temporary one only in a local session without it."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="quillon-")
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"
