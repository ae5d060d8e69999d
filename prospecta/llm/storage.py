"""Files that tasks write and read in the shared folder, by URI, through pyarrow's file systems."""

from __future__ import annotations

import uuid

from pyarrow import fs
from pyspark.sql import SparkSession


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with the scheme that Spark would give it."""
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    home = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return home.makeQualified(hadoop).toString().replace("file:/", "file:///").replace("file:////", "file:///")


def make_dir(uri: str) -> None:
    home, path = fs.FileSystem.from_uri(uri)
    home.create_dir(path, recursive=True)


def write_whole(uri: str, parts: list[bytes]) -> None:
    """Write the file under another name and rename it, so a task that is lost or runs twice leaves one whole file."""
    home, path = fs.FileSystem.from_uri(uri)
    other = f"{path}.{uuid.uuid4().hex}.tmp"
    with home.open_output_stream(other) as out:
        for part in parts:
            out.write(part)
    home.move(other, path)


def open_input(uri: str):
    """A random-access file."""
    home, path = fs.FileSystem.from_uri(uri)
    return home.open_input_file(path)


def list_files(uri: str, suffix: str) -> list[tuple[str, int]]:
    """(URI, size) of the files below a folder, by name."""
    home, path = fs.FileSystem.from_uri(uri)
    found = home.get_file_info(fs.FileSelector(path, recursive=True))
    return sorted((uri.rstrip("/") + x.path[len(path.rstrip("/")) :], x.size) for x in found if x.is_file and x.path.endswith(suffix))
